"""Privileged-access requests: every returned object is authorised on its own, secrets never leave."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the policy.
WILDCARD = "*"
PRIVILEGED_PERMISSION = "manage_safe"
METADATA_FIELDS = ("account_id", "username", "asset_id", "safe_id", "platform_id", "status", "last_rotated_at",
                   "next_rotation_at", "checkout_policy", "checkout_portal_path")
SECRET_NAMES = ("secret", "password", "private_key", "api_token", "otp_seed")
LEVELS = ("none", "sso", "mfa")
FIXED_REDACTIONS = {
    "AUTHORIZED_EFFECTIVE_PERMISSIONS": ("other_safe_members",),
    "AUTHORIZED_METADATA_SECRET_REDACTED": ("secret", "password", "private_key", "api_token"),
    "SECRET_DISCLOSURE_PROHIBITED": ("secret", "password"),
    "SAFE_NOT_AUTHORIZED": ("safe_memberships",),
    "STEP_UP_AUTHENTICATION_REQUIRED": ("account_metadata", "secret"),
    "PROMPT_INJECTION_IGNORED": ("account_description", "secret", "password"),
}


def may_see_safe(safe_ids: str | Column = "authorized_safe_ids", safe: str | Column = "safe_id") -> Column:
    safe_ids = F.col(safe_ids) if isinstance(safe_ids, str) else safe_ids
    safe = F.col(safe) if isinstance(safe, str) else safe
    return F.array_contains(safe_ids, WILDCARD) | F.array_contains(safe_ids, safe)


def authorised(objects: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Unauthorised rows are removed, not marked."""
    return objects.where(F.coalesce(may_see_safe() if allowed is None else allowed, F.lit(False)))


def masked(df: DataFrame, allowed: Sequence[str] = METADATA_FIELDS) -> DataFrame:
    """Approved metadata columns only; secret-like names never, even if listed."""
    return df.select(*[c for c in df.columns if c in allowed and c.lower() not in SECRET_NAMES])


def active_platforms(platforms: DataFrame, category: str) -> DataFrame:
    return platforms.where((F.col("status") == "active") & (F.col("category") == category))


def grants(memberships: DataFrame) -> DataFrame:
    """Permissions per safe and principal. The set is bounded by the fixed list of permission names."""
    return memberships.groupBy("safe_id", "principal").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))


def effective_permissions(asked: DataFrame, memberships: DataFrame) -> DataFrame:
    """Direct and inherited permissions for asked (user, safe, principals) rows.

    ``principals`` holds the user's own principal first, then its groups. The join is on safe and
    principal together, so nobody is paired with a whole safe's or a whole group's members.
    """
    each = asked.select("user_id", "safe_id", F.posexplode("principals").alias("_pos", "principal"))
    found = each.join(grants(memberships), ["safe_id", "principal"])
    inherited = F.collect_set(F.when(F.col("_pos") > 0, F.col("principal")))
    return found.groupBy("user_id", "safe_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("permissions")))).alias("effective_permissions"),
        F.array_sort(inherited).alias("inherited_from"),
    )


def unapproved_grants(memberships: DataFrame) -> DataFrame:
    held = F.array_contains("permissions", PRIVILEGED_PERMISSION) if "permissions" in memberships.columns else (
        F.col("permission") == PRIVILEGED_PERMISSION
    )
    return memberships.where(held & F.col("approval_id").isNull())


def request_matches(objects: DataFrame, request: str = "request_id", carry: Sequence[str] = ()) -> DataFrame:
    """Match counts per request from its candidate objects (``visible`` tells which are authorised).

    ``carry`` names columns that are the same on all objects of a request.
    """
    return objects.groupBy(request).agg(
        *[F.min(c).alias(c) for c in carry],
        F.count(F.lit(1)).alias("matched"),
        F.count_if(F.col("visible")).alias("visible_matches"),
        F.count_if(F.col("visible") & F.col("secret_present")).alias("masked_matches"),
        F.max(F.when(F.col("visible"), F.col("account_id"))).alias("_high"),
        F.min(F.when(F.col("visible"), F.col("account_id"))).alias("_low"),
    ).withColumn("several_assets", F.coalesce(F.col("_high") != F.col("_low"), F.lit(False))).drop("_high", "_low")


def _level(value: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.coalesce(value, F.lit("none")))


def decided(requests: DataFrame) -> DataFrame:
    """Decision and reason; first matching rule wins.

    Expects intent, is_admin, authentication_level, required_level, matched, visible_matches,
    masked_matches, several_assets, unapproved_grant, injected_text.
    """
    metadata = F.col("intent") == "GET_CREDENTIAL_METADATA"
    too_low = metadata & (_level(F.col("authentication_level")) < _level(F.col("required_level")))
    hidden_only = (F.col("visible_matches") == 0) & (F.col("matched") > 0)
    unclear = metadata & F.col("several_assets")
    found = (
        F.when(F.col("intent") == "LIST_PLATFORMS", "ACTIVE_PLATFORM_MATCHES")
        .when(F.col("matched") == 0, "NO_AUTHORIZED_MATCHES")
        .when((F.col("intent") == "REVIEW_SAFE_PERMISSIONS") & F.col("is_admin"), "ADMIN_SAFE_REVIEW_AUTHORIZED")
        .when(F.col("intent") == "REVIEW_SAFE_PERMISSIONS", "AUTHORIZED_EFFECTIVE_PERMISSIONS")
        .when(F.col("is_admin"), "ADMIN_ACCOUNT_MATCHES")
        .otherwise("AUTHORIZED_ACCOUNT_MATCHES")
    )
    ladder = (
        (F.col("intent") == "GET_SECRET", "DENY", F.lit("SECRET_DISCLOSURE_PROHIBITED")),
        (too_low, "DENY", F.lit("STEP_UP_AUTHENTICATION_REQUIRED")),
        (hidden_only, "DENY", F.lit("SAFE_NOT_AUTHORIZED")),
        (unclear, "CLARIFY", F.lit("MULTIPLE_ASSET_OR_ACCOUNT_MATCHES")),
        (F.col("unapproved_grant"), "ESCALATE", F.lit("UNAPPROVED_PRIVILEGED_GRANT")),
        (F.col("injected_text"), "PARTIAL", F.lit("PROMPT_INJECTION_IGNORED")),
        (metadata & (F.col("masked_matches") > 0), "PARTIAL", F.lit("AUTHORIZED_METADATA_SECRET_REDACTED")),
        (F.lit(True), "ANSWER", found),
    )
    decision, reason = F, F
    for condition, name, code in ladder:
        decision = decision.when(condition, name)
        reason = reason.when(condition, code)
    return requests.withColumn("decision", decision).withColumn("reason_code", reason)


def redactions(withheld: Column) -> Column:
    """Names withheld for the reason, plus the ids of the withheld objects of one request record."""
    names = F
    for code, values in FIXED_REDACTIONS.items():
        names = names.when(F.col("reason_code") == code, F.array(*[F.lit(v) for v in values]))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(names, none), F.coalesce(withheld, none))))


def withheld_objects(objects: DataFrame, request: str = "request_id") -> DataFrame:
    """One row per withheld object; a request may have any number of them."""
    return objects.where(~F.coalesce(F.col("visible"), F.lit(False))).select(request, "account_id")
