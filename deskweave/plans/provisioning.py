"""Network rule provisioning: what is missing, what may be created, how it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskweave.operators.joins import broadcast_if_small

# Fixed values of the policy.
REASONS = {
    "NO_CHANGE": "DESIRED_STATE_ALREADY_PRESENT",
    "CREATE_FIREWALL_ONLY": "FIREWALL_STATE_MISSING",
    "CREATE_ILLUMIO_ONLY": "ILLUMIO_STATE_MISSING",
    "DEFER": "ILLUMIO_VEN_OFFLINE",
    "MANUAL_REVIEW": "EXPLICIT_DENY_CONFLICT",
}
EVERYWHERE = "0.0.0.0/0"


def missing_rules(intents: DataFrame, label_rules: DataFrame, firewall_rules: DataFrame, keys: list[str]) -> DataFrame:
    """Approved flows absent from each platform: one anti-join per platform."""
    labels = intents.join(label_rules.select(*keys), keys, "left_anti").withColumn("platform", F.lit("label"))
    firewall = intents.join(firewall_rules.select(*keys), keys, "left_anti").withColumn("platform", F.lit("firewall"))
    return labels.unionByName(firewall)


def decided(events: DataFrame) -> DataFrame:
    """Decision and reason per event; first matching rule wins.

    Expects not_approved, ip_address, unsafe_intent, agent_offline, explicit_deny, missing_label,
    missing_firewall and intents (how many approved flows the event asks for).
    """
    blocked = F.col("not_approved") | F.col("ip_address").isNull() | F.col("unsafe_intent")
    decision = (
        F.when(blocked, "BLOCK")
        .when(F.col("agent_offline"), "DEFER")
        .when(F.col("explicit_deny"), "MANUAL_REVIEW")
        .when(F.col("missing_label") & F.col("missing_firewall"), "CREATE_BOTH")
        .when(F.col("missing_firewall"), "CREATE_FIREWALL_ONLY")
        .when(F.col("missing_label"), "CREATE_ILLUMIO_ONLY")
        .otherwise("NO_CHANGE")
    )
    why_blocked = F.when(F.col("not_approved"), "POOL_OR_INTENT_NOT_APPROVED").when(
        F.col("ip_address").isNull(), "MISSING_SERVER_IP"
    ).otherwise("INTENT_DISABLED_OR_OVERBROAD")
    created = F.when(F.col("intents") > 1, "MULTIPLE_APPROVED_INTENTS_NOT_PROVISIONED").otherwise("APPROVED_INTENT_NOT_PROVISIONED")
    reason = F.when(F.col("decision") == "BLOCK", why_blocked).when(F.col("decision") == "CREATE_BOTH", created)
    for name, code in REASONS.items():
        reason = reason.when(F.col("decision") == name, code)
    return events.withColumn("decision", decision).withColumn("reason_code", reason)


def event_flags(intents: DataFrame, event: str) -> DataFrame:
    """One row per event from its flow rows: flags by partial aggregation."""
    return intents.groupBy(event).agg(
        F.bool_or(F.col("lifecycle_state") != "approved").alias("not_approved"),
        F.max("ip_address").alias("ip_address"),
        F.bool_or(F.col("intent_status") == "disabled").alias("unsafe_intent"),
        F.bool_or("agent_offline").alias("agent_offline"),
        F.bool_or("explicit_deny").alias("explicit_deny"),
        F.bool_or(~F.col("has_label_rule")).alias("missing_label"),
        F.bool_or(~F.col("has_firewall_rule")).alias("missing_firewall"),
        F.count(F.lit(1)).alias("intents"),
    )


def case_flags(cases: DataFrame) -> DataFrame:
    """The same flags from one nested event record (its flow and rule lists sit in the row)."""
    intents = F.col("approved_connectivity_intents")
    labels, firewall = F.col("existing_state.illumio_rules"), F.col("existing_state.firewall_rules")

    def live(rule: Column) -> Column:
        return F.coalesce(rule["equivalent"] & rule["enabled"], F.lit(False))

    def denies(rule: Column) -> Column:
        return F.coalesce((rule["action"] == "deny") & rule["overlaps_requested_flow"] & rule["enabled"], F.lit(False))

    wide = F.concat(F.lit("cidr:"), F.lit(EVERYWHERE))
    return cases.select(
        "*",
        ((F.col("application_pool.lifecycle_state") != "approved") | F.exists(intents, lambda i: i["status"] == "draft")).alias("not_approved"),
        F.col("server.ip_address").alias("ip_address"),
        F.exists(intents, lambda i: (i["status"] == "disabled") | (i["source"] == wide) | (i["destination"] == wide)).alias("unsafe_intent"),
        (F.col("server.ven_state") == "offline").alias("agent_offline"),
        (F.exists(labels, denies) | F.exists(firewall, denies)).alias("explicit_deny"),
        (~F.exists(labels, live)).alias("missing_label"),
        (~F.exists(firewall, live)).alias("missing_firewall"),
        F.size(intents).alias("intents"),
    )


def ordered_actions() -> Column:
    """Action texts in flow order, label platform before firewall."""
    intents = F.col("approved_connectivity_intents")

    def per_intent(label: bool, firewall: bool):
        def build(intent: Column) -> Column:
            wanted = []
            if label:
                wanted.append(F.concat(F.lit("CREATE_ILLUMIO_RULE:"), intent["intent_id"]))
            if firewall:
                wanted.append(F.concat(F.lit("CREATE_FIREWALL_RULE:"), intent["intent_id"]))
            return F.array(*wanted)

        return F.flatten(F.transform(intents, build))

    decision = F.col("decision")
    return (
        F.when(decision == "CREATE_BOTH", per_intent(True, True))
        .when(decision == "CREATE_ILLUMIO_ONLY", per_intent(True, False))
        .when(decision == "CREATE_FIREWALL_ONLY", per_intent(False, True))
        .when(decision == "DEFER", F.array(F.lit("RETRY_AFTER_VEN_ONLINE")))
        .when(decision == "MANUAL_REVIEW", F.transform(intents, lambda i: F.concat(F.lit("OPEN_SECURITY_REVIEW:"), i["intent_id"])))
        .otherwise(F.array().cast("array<string>"))
    )


def resolved_endpoints(endpoints: DataFrame, pools: DataFrame, services: DataFrame, endpoint: str = "endpoint") -> DataFrame:
    """Labels and address group of ``pool:``, ``service:``, ``label:`` and ``cidr:`` endpoints.

    ``pools`` has pool_id, labels; ``services`` has service, labels (map<string,string> each). The row
    supplies own_labels and own_ip for ``pool:self`` and zone for label endpoints.
    """
    kind = F.substring_index(endpoint, ":", 1)
    name = F.col(endpoint).substr(F.length(kind) + 2, F.length(endpoint))
    rows = endpoints.withColumn("_kind", kind).withColumn("_name", name)
    pool = pools.select(F.col("pool_id").cast("string").alias("_pool"), F.col("labels").alias("_pool_labels"))
    service = services.select(F.col("service").alias("_service"), F.col("labels").alias("_service_labels"))
    rows = rows.join(broadcast_if_small(pool), (F.col("_kind") == "pool") & (F.col("_name") == F.col("_pool")), "left")
    rows = rows.join(broadcast_if_small(service), (F.col("_kind") == "service") & (F.col("_name") == F.col("_service")), "left")
    own = F.col(endpoint) == "pool:self"
    pair = F.split("_name", "=")
    labels = (
        F.when(own, F.col("own_labels"))
        .when(F.col("_kind") == "pool", F.col("_pool_labels"))
        .when(F.col("_kind") == "service", F.col("_service_labels"))
        .when(F.col("_kind") == "label", F.create_map(F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))
    )
    group = F.concat_ws("-", F.lit("ag"), F.col("_pool_labels")["app"], F.col("_pool_labels")["role"], F.col("_pool_labels")["env"])
    address = (
        F.when(own, F.col("own_ip"))
        .when((F.col("_kind") == "pool") & F.col("_pool").isNotNull(), group)
        .when(F.col("_kind") == "service", F.concat(F.lit("ag-"), F.col("_name")))
        .when(F.col("_kind") == "label", F.concat(F.lit("ag-"), F.col("zone")))
        .when(F.col("_kind") == "cidr", F.col("_name"))
    )
    return rows.withColumn("labels", labels).withColumn("address", address).drop(
        "_kind", "_name", "_pool", "_pool_labels", "_service", "_service_labels"
    )


def rendered_rules(flows: DataFrame) -> DataFrame:
    """Label and firewall rule of a flow whose two endpoints are resolved.

    Expects intent_id, protocol, port, source_labels, destination_labels, source_address,
    destination_address, source_zone, destination_zone.
    """
    name = F.concat(F.lit("auto-"), F.col("intent_id"))
    label_rule = F.struct(
        name.alias("name"), F.col("source_labels").alias("consumers"), F.col("destination_labels").alias("providers"),
        F.array(F.struct("protocol", "port")).alias("services"), F.lit("allow").alias("action"), F.lit(True).alias("enabled"),
    )
    firewall_rule = F.struct(
        name.alias("name"), F.array("source_address").alias("source"), F.array("destination_address").alias("destination"),
        F.array(F.concat_ws("/", "protocol", F.col("port").cast("string"))).alias("services"),
        "source_zone", "destination_zone", F.lit("allow").alias("action"), F.lit(True).alias("log"),
    )
    return flows.withColumn("label_rule", label_rule).withColumn("firewall_rule", firewall_rule)


def rule_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rules that one side holds more often than the other, with both counts; no rows if the rule sets are equal.

    Rules are compared after texts are lower-cased and lists sorted, and counted, so repeated rules are told apart. Each side
    is summed map-side into one count per rule; the sides are joined by a fingerprint and the rule itself.
    """
    names = left.columns

    def plain(df: DataFrame) -> DataFrame:
        return df.select(*[
            F.array_sort(F.transform(F.col(c), F.lower)).alias(c) if t == "array<string>" else F.lower(F.col(c)).alias(c) if t == "string" else F.col(c)
            for c, t in df.select(*names).dtypes
        ])

    sides = [
        plain(df).select(F.struct(*names).alias("rule"), F.lit(n).alias("_left"), F.lit(1 - n).alias("_right"))
        for df, n in ((left, 1), (right, 0))
    ]
    counts = sides[0].unionByName(sides[1]).groupBy(F.xxhash64("rule").alias("fingerprint"), "rule").agg(
        F.sum("_left").alias("in_left"), F.sum("_right").alias("in_right"))
    return counts.where("in_left <> in_right").select("rule.*", "in_left", "in_right")


def same_rules(left: DataFrame, right: DataFrame) -> bool:
    """Rule sets are equal after arrays are sorted and text is lower-cased."""
    return rule_differences(left, right).isEmpty()
