"""Registered queries: each reads whole tables under ``sf_dir`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskweave.functions import nested as NV
from deskweave.functions import text as X
from deskweave.functions.html import html_text as html_native
from deskweave.functions.html import html_text_exact as html_exact
from deskweave.operators import documents as D
from deskweave.operators import evaluate as E
from deskweave.operators import holdout as H
from deskweave.operators import ingest as I
from deskweave.operators import ordering as O
from deskweave.operators import report as P
from deskweave.operators import retrieve as T
from deskweave.operators import scoring as N
from deskweave.operators import timeline as L
from deskweave.operators.joins import broadcast_if_small
from deskweave.operators.staging import new_stage_path, stage
from deskweave.plans import access as A
from deskweave.plans import jobs as J
from deskweave.plans import knowledge as K
from deskweave.plans import provisioning as G
from deskweave.plans import vulnerability as V
from deskweave.sources import readers as R
from deskweave.sources import stores as S
from deskweave.streaming import streams as M
from deskweave.sources.tables import KEY_REPAIR_INPUT, VIEWS, predictions_view, relation, table, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TARGETS = ("quality", "toxic")
SCENARIO = "_test_scenario"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- Evaluation -------------------------------------------------------------------------------


def _predictions(spark: SparkSession, sf: str, threshold: int = 2000) -> DataFrame:
    return E.parsed_predictions(relation(spark, sf, predictions_view(threshold)), [*TARGETS, "confidence"])


def _scored(spark: SparkSession, sf: str, threshold: int = 2000) -> DataFrame:
    return E.score(
        view(spark, sf, "v_truth"), _predictions(spark, sf, threshold), TARGETS, breakdowns=(SCENARIO, "priority")
    )


@query
def eval_overall(spark, sf):
    return P.overall(_scored(spark, sf))


@query
def eval_field_performance(spark, sf):
    return P.dashboard(_scored(spark, sf))


@query
def eval_scored(spark, sf):
    return _scored(spark, sf)


@query
def eval_coverage_vs_holdout(spark, sf):
    truth, answers = view(spark, sf, "v_truth"), _predictions(spark, sf)
    return P.overall(E.score(truth, answers, TARGETS, keep_unpredicted=True))


@query
def eval_scenario(spark, sf):
    return P.scenario_performance(_scored(spark, sf))


@query
def eval_confusion(spark, sf):
    return P.confusion(_scored(spark, sf), "quality")


@query
def eval_class_metrics(spark, sf):
    return P.class_metrics(_scored(spark, sf), "quality")


@query
def eval_macro_f1(spark, sf):
    return P.macro_f1(_scored(spark, sf), "quality")


@query
def eval_failures(spark, sf):
    return P.failures(_scored(spark, sf), 25)


@query
def eval_branch_pivot(spark, sf):
    branches = {f"branch_{t}": _scored(spark, sf, t) for t in (1000, 2000, 4000)}
    return P.branch_comparison(branches)


@query
def resolution_view(spark, sf):
    return E.resolution_decisions(_scored(spark, sf))


@query
def holdout_visible(spark, sf):
    return H.visible_rows(view(spark, sf, "v_truth"), "number", ["category"], ["priority", "short_description", "number", "category"])


@query
def holdout_sample(spark, sf):
    return H.holdout_sample(view(spark, sf, "v_truth").select("number", "priority"), 30)


@query
def holdout_summary(spark, sf):
    truth = view(spark, sf, "v_truth")
    return H.split_summary(truth, H.visible_rows(truth, "number", ["category"]), "number", ["category"])


@query
def surrogate_ids(spark, sf):
    return H.surrogate_ids(view(spark, sf, "v_truth").select("number", "seq"))


@query
def batch_numbering(spark, sf):
    return H.batch_numbers(view(spark, sf, "v_truth").select("number", "seq"), 5).groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("tickets"), F.min("number").alias("first_number"), F.max("number").alias("last_number")
    )


@query
def prediction_semi(spark, sf):
    return E.with_prediction(view(spark, sf, "v_truth"), view(spark, sf, "v_pred")).select("number", SCENARIO)


@query
def prediction_missing(spark, sf):
    return E.without_prediction(view(spark, sf, "v_truth"), view(spark, sf, "v_pred")).select("number", SCENARIO)


@query
def first_prediction_wins(spark, sf):
    return E.latest_by(view(spark, sf, "v_pred"), ["number"], "seq", last=False)


@query
def last_prediction_wins(spark, sf):
    return E.latest_by(view(spark, sf, "v_pred"), ["number"], "seq")


# --- Text and retrieval -----------------------------------------------------------------------


@query
def section_chunks(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), "text")
    return D.section_documents(files, keep=("doc_id",)).select("doc_id", "section", "title", "content")


@query
def record_documents(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("number"), "source", "lang", F.col("text").alias("description"))
    return D.record_documents(docs, "records").select("title", "content", "kind")


@query
def token_df(spark, sf):
    return T.document_frequency(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query
def term_frequency(spark, sf):
    return T.term_frequency(table(spark, sf, "documents"), "doc_id", F.col("text"))


@query
def corpus_statistics(spark, sf):
    stats = T.corpus_statistics(table(spark, sf, "documents"), F.col("text"))
    return stats.select("documents", "tokens", F.round("mean_length", 6).alias("mean_length"))


def _documents(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"),
        F.lit("incident").alias("kind"), F.lit("documents").alias("source"), F.lit("").alias("url"),
    )


def _ranked(spark, sf, k=5):
    return T.best(_documents(spark, sf), table(spark, sf, "benchmark"), k)


@query
def bm25_topk(spark, sf):
    return _ranked(spark, sf).select("item_id", "doc_id", "score", "rank")


@query
def evidence_budget(spark, sf):
    """Ranked documents joined back to their texts, cited and cut to the evidence budget."""
    ranked = T.with_documents(_ranked(spark, sf), _documents(spark, sf))
    fitted = T.evidence_budget(T.cited_sources(ranked), 6000)
    return fitted.select("item_id", "citation", "heading", F.length("evidence").alias("used"), F.md5("evidence").alias("digest"))


@query
def retrieved_sources(spark, sf):
    ranked = T.with_documents(_ranked(spark, sf, 3), _documents(spark, sf))
    return T.retrieved_sources(T.cited_sources(ranked)).withColumn("content", F.md5("content"))


@query
def literal_passages(spark, sf):
    """Documents that contain a benchmark text's words as one literal phrase."""
    docs, asked = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return T.phrase_hits(docs, "doc_id", F.col("text"), asked, "item_id", "text")


@query
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_native("html").alias("content"))


@query
def html_text_exact(spark, sf):
    return table(spark, sf, "pages").select("page_id", html_exact("html").alias("content"))


@query
def page_documents(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.lit(None).cast("string").alias("title"), "html", F.concat(F.lit("/x/"), F.col("page_id").cast("string")).alias("webui")
    )
    return D.page_documents(pages, html_native("html"), "https://kb.example.test/wiki/", "Pages", keep=("id",))


@query
def page_phrase_search(spark, sf):
    return D.phrase_filter(table(spark, sf, "pages"), "The Eriner thanea", "html", 10).select("page_id", "url")


@query
def recent_history(spark, sf):
    return T.recent_history(table(spark, sf, "conversations"), 6)


@query
def sources_union(spark, sf):
    docs = _documents(spark, sf).select("title", "kind", F.length("content").alias("size"), F.lit(0.0).alias("score"))
    pages = table(spark, sf, "pages").select(F.col("url").alias("title"), F.lit("confluence").alias("kind"), F.length("html").alias("size"))
    return D.all_documents(docs, pages)


# --- Ingest -----------------------------------------------------------------------------------


@query
def response_records(spark, sf):
    """Records of generated responses: at most as many as requested, exact copies dropped."""
    raw = relation(spark, sf, """
        SELECT doc_id AS seq, 2 AS requested, concat('```json', chr(10), '{"records":[{"source":"', source, '","lang":"', lang,
          '"},{"number":', CAST(doc_id AS string), '},"junk",{"number":-1}]}', chr(10), '```') AS response FROM documents""")
    records = I.response_records(raw).select(
        "seq", "place", F.try_variant_get("record", "$.source", "string").alias("source"),
        F.try_variant_get("record", "$.lang", "string").alias("lang"), F.try_variant_get("record", "$.number", "bigint").alias("number"),
    ).withColumn("arrival", F.col("seq") * 100 + F.col("place"))
    return I.exact_distinct(records, "arrival", ["source", "lang", "number"]).select("arrival", "source", "lang", "number")


@query
def exact_distinct(spark, sf):
    return I.exact_distinct(table(spark, sf, "documents"), "doc_id", ["text", "lang"]).select("doc_id", "lang", F.length("text").alias("size"))


@query
def key_repair(spark, sf):
    rows = relation(spark, sf, KEY_REPAIR_INPUT)
    return I.repaired_numbers(rows, "incident").select("seq", "number", "position")


@query
def sys_id_repair(spark, sf):
    rows = relation(spark, sf, """
        SELECT doc_id AS seq, doc_id + 1 AS position, md5(text) AS fingerprint, CASE WHEN length(text) % 2 = 0 THEN NULL ELSE md5(text) END AS sys_id
        FROM documents""")
    return I.repaired_sys_ids(rows, "signature").select("seq", "sys_id")


@query
def resume_union(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    stored = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return I.resume_union(stored, docs, "doc_id").select("doc_id", "lang")


@query
def redact_email(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.redact_email("text").alias("text"))


@query
def redact_fields(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", F.struct("c_mktsegment", "c_name").alias("about"))
    return I.redacted(customers, ["C_NAME"]).select(
        "c_custkey", "c_name", F.col("about.c_name").alias("inner_name"), F.col("about.c_mktsegment").alias("segment")
    )


@query
def field_distribution_top12(spark, sf):
    fields = ("lang", "source", "n_chars")
    return I.field_distribution(table(spark, sf, "documents"), fields)


@query
def continuity_summary(spark, sf):
    return I.continuity_summary(table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.nullif("lang", F.lit("fr")).alias("number")))


@query
def recent_profile(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("number"), F.col("lang").alias("category"), F.col("text").alias("state"))
    return I.recent_records(docs, 10)


@query
def rotating_examples(spark, sf):
    examples = O.numbered(table(spark, sf, "benchmark"), ["item_id"])
    batches = table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("batch_no"))
    return I.rotating_examples(batches, examples, 3).select("batch_no", "place", "item_id")


def _diagnostics(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("finish_reason"), (F.col("user_id") % 5 + 1).alias("requested"),
        F.least(F.col("user_id") % 5 + 1, F.floor(F.col("value")).cast("bigint")).alias("returned"), F.col("value").alias("completion_tokens"),
    )


@query
def response_diagnostics(spark, sf):
    return P.response_diagnostics(_diagnostics(spark, sf))


@query
def last_diagnostics(spark, sf):
    return P.last_diagnostics(_diagnostics(spark, sf))


@query
def uncached_rows(spark, sf):
    truth = view(spark, sf, "v_truth").select("number", "short_description", "priority")
    answered = E.with_prediction(truth, view(spark, sf, "v_pred"))
    columns = ["number", "short_description", "priority"]
    cache = answered.select(S.row_key(columns, "rules-v1").alias("cache_key"))
    return S.uncached(truth, cache, columns, "rules-v1").select("number", "priority")


# --- Vulnerability policy ---------------------------------------------------------------------


def _assessed(spark, sf):
    return V.assessed(V.matched_assets(view(spark, sf, "v_findings"), view(spark, sf, "v_assets")))


# What decisions need of an assessed finding; the rest is neither written nor moved.
DECISION_COLUMNS = ("event_id", "line_no", "asset_id", "vulnerability_id", "canonical_finding_id", "observed_at", "received_at", "priority", "due_at", "malformed",
                    "fix_available", "known_exploited", "validated_compensating_control", "environment")


def _finding_decisions(spark, sf):
    assessed = stage(_assessed(spark, sf).select(*DECISION_COLUMNS), "assessed")
    findings = V.with_exceptions(assessed, view(spark, sf, "v_exceptions"))
    seen = V.newest_evidence(
        findings.withColumn("seen_at", F.col("observed_at").try_cast("timestamp")), view(spark, sf, "v_inventory"),
        ["asset_id"], "seen_at", "collected_at", "version",
    )
    # Flags take the place of what they are made of before rows are moved to their finding's first receipt.
    seen = seen.withColumns({
        "fixed_in_inventory": F.col("newer_evidence") & (F.col("evidence_version") > 40),
        "late": (F.col("priority") == "P1") & (F.col("due_at") < F.lit("1996-01-01").cast("timestamp")),
        "no_fix": ~F.col("fix_available") & F.col("known_exploited"),
    }).drop("vulnerability_id", "observed_at", "seen_at", "due_at", "fix_available", "known_exploited", "evidence_at", "evidence_version", "newer_evidence")
    first = assessed.where("canonical_finding_id IS NOT NULL").groupBy("canonical_finding_id").agg(F.min("received_at").alias("first_received_at"))
    known = F.coalesce(F.col("received_at") > F.col("first_received_at"), F.lit(False))
    return V.decided(seen.join(first, "canonical_finding_id", "left").withColumns({"known_finding": known, "overdue": known & F.col("late")}).drop("late"))


@query
def asset_match(spark, sf):
    found = V.matched_assets(view(spark, sf, "v_findings"), view(spark, sf, "v_assets"))
    return found.select("event_id", "line_no", "asset_ref", "asset_id", "region")


@query
def cve_enrichment(spark, sf):
    rows = V.enriched(view(spark, sf, "v_findings").select("event_id", "line_no", "vulnerability_id"), view(spark, sf, "v_advisories"))
    return rows.select("event_id", "line_no", "vulnerability_id", "epss_rank", "parts")


@query
def exception_match(spark, sf):
    rows = V.with_exceptions(_assessed(spark, sf), view(spark, sf, "v_exceptions"))
    return rows.select("event_id", "line_no", "asset_id", "valid_exception", "expired_exception")


@query
def newest_evidence(spark, sf):
    observed = view(spark, sf, "v_incidents").select("number", (F.col("service_id")).alias("asset_id"), "opened_at")
    rows = V.newest_evidence(observed, view(spark, sf, "v_inventory"), ["asset_id"], "opened_at", "collected_at", "version")
    return rows.select("number", "asset_id", "evidence_version", "newer_evidence")


@query
def risk_score(spark, sf):
    return _assessed(spark, sf).select("event_id", "line_no", "canonical_finding_id", "risk_score", "priority", "sla_hours")


@query
def priority_sla(spark, sf):
    return _assessed(spark, sf).groupBy("priority").agg(
        F.count(F.lit(1)).alias("findings"), F.min("due_at").cast("string").alias("first_due"), F.max("due_at").cast("string").alias("last_due")
    )


@query
def finding_decision(spark, sf):
    return _finding_decisions(spark, sf).select(
        "event_id", "line_no", "decision", "dashboard_bucket", "reason_code", "ticket_action", "remediation_action",
        F.array_join("audit_events", ",").alias("audit_events"),
    )


@query
def workload_buckets(spark, sf):
    return V.workload(_finding_decisions(spark, sf))


@query
def dashboard_buckets(spark, sf):
    return _finding_decisions(spark, sf).groupBy("dashboard_bucket").agg(F.count(F.lit(1)).alias("findings"))


@query
def finding_dedup(spark, sf):
    return V.deduplicated(_assessed(spark, sf)).withColumn("first_received_at", F.col("first_received_at").cast("string"))


@query
def finding_sources(spark, sf):
    return V.finding_sources(_assessed(spark, sf))


@query
def quarantine_split(spark, sf):
    accepted, rejected = V.quarantine_split(view(spark, sf, "v_findings"))
    rows = accepted.select("scanner_id", F.lit("accepted").alias("side")).unionByName(rejected.select("scanner_id", F.lit("quarantined").alias("side")))
    return rows.groupBy("side", "scanner_id").agg(F.count(F.lit(1)).alias("findings"))


def _portfolio(spark, sf):
    return view(spark, sf, "v_portfolio").withColumn("compliance_scopes", F.split("scopes", ",")).drop("scopes")


@query
def portfolio_totals(spark, sf):
    return V.portfolio_totals(_portfolio(spark, sf))


@query
def portfolio_breakdown(spark, sf):
    return V.portfolio_breakdown(_portfolio(spark, sf))


@query
def audit_report(spark, sf):
    return V.audit_report(_portfolio(spark, sf))


@query
def audit_evidence(spark, sf):
    return V.audit_evidence(_portfolio(spark, sf))


# --- Provisioning -----------------------------------------------------------------------------


@query
def rule_gap(spark, sf):
    intents = view(spark, sf, "v_intents")
    wanted = intents.where("intent_status = 'active' AND lifecycle_state = 'approved'").select("pool_id", "intent_no", "port")
    labels, firewall = intents.where("has_label_rule"), intents.where("has_firewall_rule")
    return G.missing_rules(wanted, labels, firewall, ["pool_id", "port"])


@query
def provision_decision(spark, sf):
    return G.decided(G.event_flags(view(spark, sf, "v_intents"), "pool_id")).select("pool_id", "decision", "reason_code", "intents")


@query
def endpoint_rules(spark, sf):
    """Flows between a pool and a resolved endpoint, written as firewall rules."""
    flows = relation(spark, sf, """
        SELECT concat('INT-', CAST(l_orderkey AS string), '-', CAST(l_linenumber AS string)) AS intent_id, 'tcp' AS protocol, CAST(l_partkey AS int) AS port,
          concat('10.0.0.', CAST(l_suppkey AS string)) AS own_ip, 'app-prod' AS source_zone, 'data-prod' AS destination_zone, 'data-prod' AS zone,
          CASE l_linenumber % 5 WHEN 0 THEN concat('pool:', CAST(l_suppkey AS string)) WHEN 1 THEN concat('service:', p_brand) WHEN 2 THEN 'label:env=prod'
            WHEN 3 THEN 'cidr:10.0.0.0/8' ELSE 'pool:self' END AS endpoint
        FROM lineitem JOIN part ON l_partkey = p_partkey""").withColumn("own_labels", F.create_map(F.lit("env"), F.lit("prod")))
    pools = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("pool_id"),
        F.create_map(F.lit("app"), F.lower("s_name"), F.lit("role"), F.lit("api"), F.lit("env"), F.lit("prod")).alias("labels"),
    )
    services = table(spark, sf, "part").select(F.col("p_brand").alias("service")).distinct().select("service", F.create_map(F.lit("app"), F.col("service")).alias("labels"))
    resolved = G.resolved_endpoints(flows, pools, services).withColumnsRenamed({"labels": "destination_labels", "address": "destination_address"})
    rules = G.rendered_rules(resolved.withColumn("source_labels", F.col("own_labels")).withColumn("source_address", F.col("own_ip")))
    return rules.select(
        F.col("firewall_rule.name").alias("name"), F.array_join("firewall_rule.destination", ",").alias("destination"),
        F.array_join("firewall_rule.services", ",").alias("services"),
        F.array_join(F.array_sort(F.transform(F.map_entries("label_rule.providers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("providers"),
    )


# --- Privileged access ------------------------------------------------------------------------


def _slices(spark):
    """A number of partitions that adaptive execution does not coalesce."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _access_objects(spark, sf):
    objects = view(spark, sf, "v_access_requests").join(view(spark, sf, "v_requesters"), "user_id").join(view(spark, sf, "v_accounts"), "account_id")
    safes = F.when(F.col("is_admin"), F.array(F.lit("*"))).otherwise(F.array(F.col("authorized_safe_id").cast("string")))
    rows = objects.withColumn("authorized_safe_ids", safes).withColumn("secret_present", F.col("status") == "active")
    return rows.withColumn("visible", A.may_see_safe("authorized_safe_ids", F.col("safe_id").cast("string")))


@query
def authorised_accounts(spark, sf):
    seen = A.authorised(_access_objects(spark, sf), F.col("visible"))
    return seen.select("request_id", *A.masked(seen).columns).distinct()


@query
def withheld_objects(spark, sf):
    """Rows are spread by their pair first, over all slices: a map of the pairs of a whole read task would grow with the file."""
    found = A.withheld_objects(_access_objects(spark, sf))
    return found.repartition(_slices(spark), *found.columns).distinct()


@query
def access_decision(spark, sf):
    requests = A.request_matches(_access_objects(spark, sf), carry=("intent", "is_admin", "authentication_level"))
    return A.decided(requests.withColumns({
        "required_level": F.lit("mfa"), "unapproved_grant": F.lit(False), "injected_text": F.col("request_id") % 19 == 0,
    })).select("request_id", "matched", "visible_matches", "decision", "reason_code")


@query
def effective_permissions(spark, sf):
    """Permissions of each requester on the safes that the requests ask for."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("authorized_safe_id"), "n_regionkey")
    asked = _access_objects(spark, sf).select("user_id", "safe_id", "authorized_safe_id").distinct().join(nations, "authorized_safe_id")
    principals = F.array(F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.concat(F.lit("group-"), F.col("n_regionkey").cast("string")))
    found = A.effective_permissions(asked.select("user_id", "safe_id", principals.alias("principals")), view(spark, sf, "v_memberships"))
    return found.select("user_id", "safe_id", F.array_join("effective_permissions", ",").alias("permissions"), F.array_join("inherited_from", ",").alias("inherited_from"))


@query
def safe_review(spark, sf):
    return A.grants(view(spark, sf, "v_memberships")).select("safe_id", "principal", F.array_join("permissions", ",").alias("permissions"))


@query
def unapproved_grants(spark, sf):
    members = view(spark, sf, "v_memberships").withColumn("approval_id", F.when(F.length("principal") % 2 == 0, "APR-1"))
    return A.unapproved_grants(members).select("safe_id", "principal")


# --- Knowledge base and requests --------------------------------------------------------------


def _knowledge(spark, sf):
    rows = view(spark, sf, "v_knowledge").withColumn("access_scope", F.split("scopes", ","))
    return K.published(rows, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query
def published_documents(spark, sf):
    return _knowledge(spark, sf).select("doc_id", "status", "scopes")


def _authorised_ranking(spark, sf, k):
    """Questions of even items come from group en, others from src2; each sees only the corpus its asker may read."""
    asked = table(spark, sf, "benchmark").withColumn("groups", F.array(F.when(F.col("item_id") % 2 == 0, "en").otherwise("src2"), F.lit(K.ANYONE)))
    return T.best(_knowledge(spark, sf), asked, k, scope="access_scope", groups="groups")


@query
def authorised_retrieval(spark, sf):
    return _authorised_ranking(spark, sf, 5).select("item_id", "doc_id", "score", "rank")


@query
def verbatim_passages(spark, sf):
    docs, asked = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return T.phrase_hits(docs, "doc_id", F.col("text"), asked, "item_id", "text", phrase=F.lower("text"))


@query
def citation_quality(spark, sf):
    """Ranked documents against verbatim ones; the ranked texts hold the others, so one index serves both."""
    docs, ranked = table(spark, sf, "documents"), T.rankings(_documents(spark, sf), table(spark, sf, "benchmark"))
    expected = reduce(DataFrame.unionByName, [
        T.phrase_hits(docs, "doc_id", F.col("text"), asked, "item_id", "text", phrase=F.lower("text"), index=ranking.index) for asked, ranking in ranked])
    return K.citation_quality(T.best_of(ranked, 5).select("item_id", "doc_id"), expected, "item_id", ["doc_id"])


@query
def recurring_incidents(spark, sf):
    counts = L.trailing_counts(view(spark, sf, "v_incidents"), ["service_id", "symptom"], "opened_at", K.RECURRENCE_DAYS)
    problems = table(spark, sf, "nation").select((F.col("n_nationkey") * 2).cast("bigint").alias("service_id"), F.lit("error").alias("symptom"), F.col("n_name").alias("number"))
    found = K.recurring(counts, problems, ["service_id", "symptom"])
    return found.select("service_id", F.col("opened_at").cast("string").alias("opened_at"), "in_window", "problem_id", "create_new_problem")


@query
def request_lifecycle(spark, sf):
    rows = L.with_next_event(view(spark, sf, "v_requests"), "request_id", "at", "seq")
    return rows.select("request_id", "seq", "state", F.col("next_at").cast("string").alias("next_at"), "seconds_in_state")


@query
def request_latest_state(spark, sf):
    return L.latest_state(view(spark, sf, "v_requests"), ["request_id"], "at", ["state", "seq"], tie="seq").withColumn("at", F.col("at").cast("string"))


def _service_requests(spark, sf):
    return view(spark, sf, "v_service_requests").withColumn(
        "destination_fqdns", F.filter(F.split("destinations", ","), lambda d: d != "")
    ).withColumn("ports", F.split("port_list", ","))


@query
def missing_fields(spark, sf):
    rows = _service_requests(spark, sf)
    required = ("server_id", "application_id", "environment", "destination_fqdns", "ports", "business_justification", "requested_start", "expires_at")
    return rows.select("number", F.array_join(K.missing_fields(rows, required), ",").alias("missing"))


@query
def request_decision(spark, sf):
    rows = _service_requests(spark, sf)
    required = ("server_id", "application_id", "destination_fqdns", "business_justification")
    cases = rows.withColumn("intent", F.when(F.col("environment") == "prod", "GET_REQUEST_STATUS").otherwise("CREATE_REQUEST"))
    owned = F.array(F.concat(F.lit("APP-"), (F.col("number") % 25).cast("string")))
    cases = cases.withColumn("user_id", F.when(F.col("number") % 2 == 0, F.col("requested_by")).otherwise(F.lit(-1)))
    cases = cases.withColumn("record_visible", K.record_visible(owned)).withColumn("record_state", F.when(F.col("number") % 3 == 0, "On Hold").otherwise("Open"))
    cases = cases.withColumn("cites_retired", F.col("number") % 23 == 0).withColumn("overbroad", K.overbroad()).withColumn("missing", K.missing_fields(cases, required))
    return K.decided(cases).select("number", "decision", "reason_code", K.needs_risk_owner().alias("needs_risk_owner"))


@query
def incident_links(spark, sf):
    incidents = view(spark, sf, "v_incidents").select(
        "number", F.col("service_id").alias("related_request"), F.when(F.col("service_id") > 4, F.col("service_id")).alias("related_problem"))
    requests = table(spark, sf, "nation").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("state")).where("number % 2 = 0")
    problems = table(spark, sf, "nation").select(F.col("n_nationkey").alias("number"), F.lit("Known Error").alias("state"), F.col("n_name").alias("workaround_document_id"))
    return K.linked_incidents(incidents, requests, problems).select("number", "request_state", "problem_state", "workaround_document_id")


# --- Job graphs -------------------------------------------------------------------------------

MILESTONE, TERMINALS = 5, (6, 7)
RUN_COLUMNS = ("region", "scheduled_start", "dataset_split")
SLA_SECONDS = 6000


def _run_graph(spark, sf, columns=("*",)):
    """All job runs, written once, with the edges and the jobs of their graph; the graph is as deep as the runs are long."""
    runs = stage(view(spark, sf, "v_runs").select(*columns), "runs")
    jobs = stage(runs.select("job_no").distinct().select(
        "job_no", F.col("job_no").cast("int").alias("place"), (F.col("job_no") == MILESTONE).alias("milestone"), F.col("job_no").isin(*TERMINALS).alias("terminal")), "jobs")
    # All that the edges take from the runs is which jobs there are.
    jobs.createOrReplaceTempView("v_runs")
    edges = spark.sql(VIEWS["v_edges"]).where("parent_no > 0").select(F.col("job_no").alias("child"), F.col("parent_no").alias("parent"), F.col("parent_no").cast("int").alias("place"))
    return runs, edges, jobs


def _commands(spark, sf, paths=False):
    runs, edges, jobs = _run_graph(spark, sf)
    return J.command_runs(runs, edges, carry=RUN_COLUMNS, paths=paths), edges, jobs


def _boxes(spark, sf):
    commands, _, jobs = _commands(spark, sf, paths=True)
    return commands, J.box_runs(commands, jobs, SLA_SECONDS, carry=RUN_COLUMNS)


@query
def job_catalogue(spark, sf):
    rows = J.job_catalogue(table(spark, sf, "supplier"), "s_suppkey")
    return rows.withColumn("dependencies", F.array_join("dependencies", ","))


@query
def referential_integrity(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("child"), (F.col("l_partkey") % 100 + 1).alias("parent")).distinct()
    return J.dangling_edges(edges, view(spark, sf, "v_assets"), "asset_id")


@query
def topo_levels(spark, sf):
    """Levels of all job runs: nodes and edges are rows, whatever the number of runs."""
    runs, edges, _ = _run_graph(spark, sf, ("region_run_id", "job_no"))

    def name(job):
        return F.concat_ws(":", F.col("region_run_id").cast("string"), F.col(job).cast("string"))

    arcs = runs.select("region_run_id", F.col("job_no").alias("child")).join(broadcast_if_small(edges), "child").select(name("child").alias("child"), name("parent").alias("parent"))
    return J.topological_levels(runs.select(name("job_no").alias("node")), arcs)


@query
def run_timeline(spark, sf):
    return _commands(spark, sf, paths=True)[0].select(
        "region_run_id", "job_no", "status", "blocked_by", "eligible_seconds", "start_seconds", "end_seconds", "duration_seconds", "elapsed_seconds", "path")


@query
def blocked_jobs(spark, sf):
    return _commands(spark, sf)[0].where("status = 'BLOCKED'").select("region_run_id", "job_no", "blocked_by")


@query
def predecessor_outcomes(spark, sf):
    """Each job run with the outcome of every predecessor: one equi-join on (run, job)."""
    commands, edges, _ = _commands(spark, sf)
    runs = commands.select("region_run_id", "job_no", "status")
    parents = runs.select("region_run_id", F.col("job_no").alias("parent_no"), F.col("status").alias("parent_status"))
    arcs = broadcast_if_small(edges.select(F.col("child").alias("job_no"), F.col("parent").alias("parent_no")))
    return runs.join(arcs, "job_no").join(parents, ["region_run_id", "parent_no"]).groupBy("job_no", "parent_no", "status", "parent_status").agg(F.count(F.lit(1)).alias("runs"))


@query
def critical_path(spark, sf):
    return _boxes(spark, sf)[1].select("region_run_id", "status", "critical_path_jobs")


@query
def box_rollup(spark, sf):
    return _boxes(spark, sf)[1].select(
        "region_run_id", "status", "successful_cmd_count", "failed_cmd_count", "blocked_cmd_count", "total_retry_count", "box_duration_seconds", "delivery_duration_seconds", "delivery_sla_met")


@query
def runs_with_box(spark, sf):
    """Command runs beside their box: statuses by job."""
    commands, boxes = _boxes(spark, sf)
    joined = commands.select("region_run_id", "job_no", "status").join(boxes.select("region_run_id", F.col("status").alias("box_status")), "region_run_id")
    return joined.groupBy("job_no", "status", "box_status").agg(F.count(F.lit(1)).alias("runs"))


@query
def sla_report(spark, sf):
    boxes = J.with_times(_boxes(spark, sf)[1], "scheduled_start", {"delivery_at": "delivery_duration_seconds"})
    return boxes.groupBy("region", "dataset_split").agg(
        F.count(F.lit(1)).alias("boxes"), F.count_if("delivery_sla_met").alias("met"), F.count("delivery_at").alias("delivered"),
        F.max("delivery_at").cast("string").alias("last_delivery"), F.round(F.avg("delivery_duration_seconds"), 4).alias("mean_seconds"),
    )


KEYS = ["region", "job_no"]


def _counts(commands):
    return J.duration_counts(commands.where("dataset_split = 'train'"), KEYS)


@query
def duration_quantiles(spark, sf):
    return J.duration_quantiles(_counts(_commands(spark, sf)[0]), KEYS)


@query
def failure_rate(spark, sf):
    return J.failure_rates(_commands(spark, sf)[0].where("dataset_split = 'train'"), KEYS)


@query
def eta_backtest(spark, sf):
    commands = _commands(spark, sf)[0]
    quantiles = J.duration_quantiles(_counts(commands), KEYS)
    return J.backtest(commands.where("dataset_split = 'evaluation'"), quantiles, KEYS)


@query
def rolling_duration(spark, sf):
    rows = L.rolling_mean(view(spark, sf, "v_runs"), ["job_no"], ["scheduled_start", "region_run_id"], "duration_seconds", 5, "recent_mean")
    return rows.select("region_run_id", "job_no", F.round("recent_mean", 6).alias("recent_mean"))


NOW_SECONDS = 4000


def _snapshot(commands):
    """State of each region's newest evaluation run, a fixed time after its schedule."""
    runs = commands.where("dataset_split = 'evaluation'")
    newest = runs.groupBy("region").agg(F.max(F.struct("scheduled_start", "region_run_id")).alias("_n")).select(F.col("_n.region_run_id").alias("region_run_id"))
    now = F.lit(NOW_SECONDS)
    state = (
        F.when(F.col("end_seconds") <= now, F.col("status")).when(F.col("start_seconds") <= now, "RUNNING").otherwise("WAITING")
    )
    rows = runs.join(newest, "region_run_id", "left_semi").withColumn("state", state)
    return rows.select(
        *KEYS, F.col("state").alias("status"), F.when(F.col("state").isin("SUCCESS", "FAILED"), F.col("end_seconds")).alias("end_seconds"),
        F.when(F.col("state") == "RUNNING", now - F.col("start_seconds")).alias("elapsed_seconds"),
    )


@query
def remaining_time(spark, sf):
    commands = _commands(spark, sf)[0]
    running = _snapshot(commands).where("status = 'RUNNING'").select(*KEYS, "elapsed_seconds")
    return J.remaining_time(running, _counts(commands), KEYS)


@query
def live_eta(spark, sf):
    commands, edges, jobs = _commands(spark, sf)
    counts, snapshot = stage(_counts(commands), "counts"), _snapshot(commands)
    running = J.remaining_time(snapshot.where("status = 'RUNNING'").select(*KEYS, "elapsed_seconds"), counts, KEYS).drop("elapsed_seconds")
    states = J.duration_quantiles(counts, KEYS).join(snapshot.drop("elapsed_seconds"), KEYS, "left").join(running, KEYS, "left")
    return J.live_eta(states.withColumn("now_seconds", F.lit(NOW_SECONDS)).withColumn("sla_seconds", F.lit(SLA_SECONDS)), edges, jobs)


@query
def business_days(spark, sf):
    bounds = table(spark, sf, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return J.business_days(bounds, "a", "b").withColumn("day", F.col("day").cast("string"))


@query
def holiday_runs(spark, sf):
    """Weekday runs and volume on regional holidays (the last weekday of each year in the data)."""
    runs = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("region"), F.col("o_orderdate").cast("date").alias("business_date"), "o_totalprice")
    days = runs.where(F.weekday("business_date") < 5)
    holidays = days.groupBy("region", F.year("business_date").alias("y")).agg(F.max("business_date").alias("business_date")).select("region", "business_date")
    return J.with_holidays(days, holidays).groupBy("region", "is_regional_holiday").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("o_totalprice"), 2).alias("volume"))


@query
def state_overlay(spark, sf):
    """Newest view per user, replaced by the newest error where there is one."""
    events = table(spark, sf, "events")
    base = L.latest_state(events.where("event_type = 'view'"), ["user_id"], "ts", ["event_type", "value"], tie="event_id")
    patch = L.latest_state(events.where("event_type = 'error'"), ["user_id"], "ts", ["event_type", "value"], tie="event_id")
    patch = patch.select("user_id", "event_type", F.when(F.col("value") > 20, F.col("value")).alias("value"))
    return J.overlaid(base, patch, ["user_id"]).select("user_id", "event_type", "value", F.col("ts").cast("string").alias("ts"))


@query
def snapshot_replicas(spark, sf):
    base = L.latest_state(table(spark, sf, "events"), ["user_id"], "ts", ["event_type"], tie="event_id")
    return J.replicated(base, (0, 1, 2, 3, 4), ["ts"]).withColumn("ts", F.col("ts").cast("string"))


@query
def latest_state(spark, sf):
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return L.latest_state(table(spark, sf, "events"), ["user_id"], "ts", ["event_type", "value"], as_of, "event_id").withColumn("ts", F.col("ts").cast("string"))


@query
def normalised_values(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.normalised(F.concat(F.lit("  "), "p_type", F.lit("  Straße "), "p_name")).alias("plain"), X.slug("p_type").alias("slug"))


@query
def list_match(spark, sf):
    """Lists given as JSON text match whatever their order and case."""
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit('["'), "o_orderpriority", F.lit('", "'), "o_orderstatus", F.lit('"]')).alias("expected"),
        F.concat(F.lit(' ["'), F.lower("o_orderstatus"), F.lit('","'), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority")).otherwise("5-LOW"), F.lit('"]')).alias("actual"))
    return rows.select("o_orderkey", X.equal_after_normalising("expected", "actual").alias("same"))


@query
def active_catalogue(spark, sf):
    platforms = table(spark, sf, "part").select(F.col("p_partkey").alias("platform_id"), F.col("p_name").alias("display_name"), F.col("p_brand").alias("category"),
                                                F.when(F.col("p_size") > 10, "active").otherwise("retired").alias("status"))
    return A.active_platforms(platforms, "Brand#11").select("platform_id", "display_name")


@query
def actionable_findings(spark, sf):
    return _portfolio(spark, sf).where(F.col("state").isin(*V.ACTIONABLE_STATES)).groupBy("state", "priority").agg(F.count(F.lit(1)).alias("findings"))


@query
def prompt_rows(spark, sf):
    rows = I.compact_examples(table(spark, sf, "documents").select("doc_id", "lang", "source"))
    return rows.select("doc_id", I.prompt_rows(rows).alias("prompt"))


@query
def compact_examples(spark, sf):
    return I.compact_examples(table(spark, sf, "documents").select("doc_id", "text"))


# --- Scoring ----------------------------------------------------------------------------------


def _length_rule(rows: list[dict]) -> str:
    """A deterministic responder; it leaves some ids out of larger batches, as a model may."""
    import json

    answers = [
        {"number": r["number"], "quality": "1" if r["size"] >= 2000 else "0"}
        for r in rows if len(rows) == 1 or r["number"] % 5 != 0
    ]
    return "```json\n" + json.dumps({"predictions": answers}) + "\n```"


@query
def batched_scorer(spark, sf):
    tickets = view(spark, sf, "v_truth").select("number", F.length("description").alias("size"), "_expected_quality")
    return N.scored_by(tickets, _length_rule, ["quality"], batch_size=10)


@query
def dry_run_predictions(spark, sf):
    return N.dry_run(view(spark, sf, "v_truth"), ["quality", "toxic"])


# --- Files, and forms that other queries do not reach ------------------------------------------


def _write_texts(texts, place):
    """One file per row of ``value``."""
    texts.write.option("maxRecordsPerFile", 1).text(place)
    return place


@query
def record_files(spark, sf):
    """Customers written as JSON files of a thousand, some as arrays and some inside an object, and read back."""
    rows = table(spark, sf, "customer").select(F.expr("c_custkey div 1000").alias("part"), F.struct("c_custkey", "c_name", "c_mktsegment").alias("r"))
    lists = rows.groupBy("part").agg(F.collect_list("r").alias("records"))
    texts = lists.select(F.when(F.col("part") % 2 == 0, F.to_json("records")).otherwise(F.to_json(F.struct("records"))).alias("value"))
    found = R.read_record_files(spark, _write_texts(texts, new_stage_path(spark, "json")))
    return R.records_as(found, "c_custkey long, c_name string, c_mktsegment string").select("c_custkey", "c_name", "c_mktsegment")


@query
def table_group(spark, sf):
    """Three tables from files of JSON objects, parsed once; the files hold a thousand suppliers each, the first one all three."""
    def lists(name, key, *columns):
        rows = table(spark, sf, name).select(F.expr(key).alias("part"), F.struct(*columns).alias("r"))
        return rows.groupBy("part").agg(F.collect_list("r").alias(f"{name}s"))

    parts = lists("supplier", "s_suppkey div 1000", "s_suppkey", "s_nationkey").join(lists("nation", "0L", "n_nationkey", "n_name"), "part", "left").join(lists("region", "0L", "r_regionkey", "r_name"), "part", "left")
    texts = parts.select(F.to_json(F.struct("nations", "regions", "suppliers")).alias("value"))
    got = R.read_table_group(spark, _write_texts(texts, new_stage_path(spark, "group")), {
        "nations": "n_nationkey int, n_name string", "regions": "r_regionkey int, r_name string", "suppliers": "s_suppkey int, s_nationkey int"})
    found = [got[k].select(F.lit(k).alias("kind"), F.col(i).cast("long").alias("id"), F.col(v).cast("string").alias("value")) for k, i, v in (
        ("nations", "n_nationkey", "n_name"), ("regions", "r_regionkey", "r_name"), ("suppliers", "s_suppkey", "s_nationkey"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def csv_snapshot(spark, sf):
    """A snapshot written as CSV and read back: every column as text."""
    place = new_stage_path(spark, "csv")
    R.write_snapshot(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size"), place, "csv")
    return R.read_csv_records(spark, place)


@query
def reference_examples(spark, sf):
    """Example records by group: a group's name fills the group field where a record has none."""
    rows = table(spark, sf, "supplier").select(
        F.concat(F.lit("team-"), F.col("s_nationkey").cast("string")).alias("team"), F.col("s_suppkey"),
        F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("number"), F.when(F.col("s_suppkey") % 3 == 0, "own").alias("assignment_group"))).alias("record"))
    lists = rows.groupBy("team").agg(F.concat(F.lit("["), F.array_join(F.collect_list("record"), ","), F.lit("]")).alias("items"))
    texts = lists.select(F.concat(F.lit('{"'), "team", F.lit('":'), "items", F.lit("}")).alias("value"))
    return R.reference_examples(texts).select("example_group", F.col("record")["number"].alias("number"), F.col("record")["assignment_group"].alias("assignment_group"))


@query
def align_predictions(spark, sf):
    """Responses to batches of five ids: some name unknown ids, some batches lack their last answer."""
    truth = view(spark, sf, "v_truth").select("number", F.expr("number div 5").alias("batch"))
    item = F.struct(F.col("number"), F.concat(
        F.lit('{"number":"'), F.when(F.col("number") % 3 == 0, F.lit("X-")).otherwise(""), F.col("number").cast("string"), F.lit('","quality":"'), (F.col("number") % 2).cast("string"), F.lit('"}')).alias("text"))
    batches = truth.groupBy("batch").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = F.when(F.col("batch") % 4 == 0, F.slice("items", F.lit(1), F.size("items") - 1)).otherwise(F.col("items"))
    response = F.concat(F.lit('{"predictions":['), F.array_join(F.transform(kept, lambda i: i["text"]), ","), F.lit("]}"))
    rows = batches.select("batch", F.transform("items", lambda i: i["number"]).alias("ids"), response.alias("response"))
    return E.aligned_predictions(rows, ["quality"]).select("batch", "number", "quality")


@query
def present_column_wins(spark, sf):
    """A prediction column that is there already is kept, null or not; others come from the response."""
    given = view(spark, sf, "v_pred").withColumn("quality", F.when(F.col("number") % 2 == 0, "given"))
    return E.parsed_predictions(given, ["quality", "toxic"]).select("number", "seq", "quality", "toxic")


@query
def second_source(spark, sf):
    """Ranked documents and then pages of a second source, numbered through per question."""
    local = _ranked(spark, sf, 3).select("item_id", "doc_id", "score")
    pages = table(spark, sf, "pages").select((F.col("page_id") % 40).alias("item_id"), F.col("page_id").alias("doc_id"))
    asked = table(spark, sf, "benchmark").select("item_id")
    second = pages.join(asked, "item_id").select("item_id", "doc_id")
    return T.cited_sources(local, second).select("item_id", "doc_id", "source_priority", "citation")


@query
def current_approvers(spark, sf):
    """Who has to approve next: the first line of an order that is not approved."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", F.concat(F.lit("role-"), F.col("l_linenumber").cast("string")).alias("approver_role"), F.when(F.col("l_returnflag") == "R", "Approved").otherwise("Pending").alias("state")).alias("a"))
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("a")).alias("approval_summary"))
    return orders.select("l_orderkey", K.current_approver().alias("approver"))


@query
def fact_coverage(spark, sf):
    """Share of expected words that a labelled document's text contains."""
    labels = table(spark, sf, "labels").select("doc_id")
    facts = labels.select("doc_id", F.explode(F.array(F.lit("THE"), F.lit("tion"), F.lit("no such fact"))).alias("fact"))
    answers = table(spark, sf, "documents").select("doc_id", F.col("text").alias("answer"))
    return K.fact_coverage(answers, facts, "doc_id")


@query
def ordered_actions(spark, sf):
    """Actions of each pool in the order of its intents, label platform before firewall."""
    intents = view(spark, sf, "v_intents")
    decided = G.decided(G.event_flags(intents, "pool_id")).select("pool_id", "decision")
    name = F.concat_ws("-", F.lit("INT"), F.col("intent_no").cast("string"), F.col("port").cast("string"))
    lists = intents.groupBy("pool_id").agg(F.array_sort(F.collect_list(F.struct("intent_no", "port", name.alias("intent_id")))).alias("approved_connectivity_intents"))
    return lists.join(decided, "pool_id").select("pool_id", F.array_join(G.ordered_actions(), ",").alias("actions"))


@query
def rule_differences(spark, sf):
    """Rules of the odd lines that the even ones lack or hold less often, and the other way round."""
    rules = table(spark, sf, "lineitem").select("l_linenumber", F.concat(F.lit("RULE-"), (F.col("l_partkey") % 50).cast("string")).alias("name"), F.array("l_returnflag", "l_linestatus").alias("labels"))
    left, right = rules.where("l_linenumber % 2 = 1").drop("l_linenumber"), rules.where("l_linenumber % 2 = 0").drop("l_linenumber")
    found = G.rule_differences(left, right.select(F.lower("name").alias("name"), F.reverse("labels").alias("labels")))
    return found.withColumn("labels", F.array_join("labels", ","))


@query
def clock_texts(spark, sf):
    """ISO text of an event's time, and a schedule from a date and a clock text, null where the clock is none."""
    clock = F.when(F.col("user_id") % 7 == 0, "25:99").otherwise(F.concat(F.lpad((F.col("user_id") % 24).cast("string"), 2, "0"), F.lit(":30")))
    at = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", J.iso_text(at).alias("iso"), J.scheduled_at(F.to_date(at), clock).cast("string").alias("scheduled"))


@query
def canonical_json(spark, sf):
    """Comparison form of nested values: keys and lists sorted, texts folded."""
    nested = F.struct(F.array(F.upper("o_orderpriority"), "o_orderstatus").alias("tags"), F.concat(F.lit("  "), "o_orderstatus", F.lit(" ")).alias("a"))
    return table(spark, sf, "orders").select("o_orderkey", NV.normalised_nested(nested).alias("plain"))


@query
def missing_values(spark, sf):
    """Not-a-number becomes null; the number of predictions of a run."""
    rows = table(spark, sf, "events").select("event_id", X.nan_to_null(F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value"))).alias("value"))
    total = P.run_summary(rows.where("value IS NOT NULL"), "batch")
    return rows.groupBy(F.col("value").isNull().alias("missing")).agg(F.count(F.lit(1)).alias("events")).join(F.broadcast(total))


# --- Streams ----------------------------------------------------------------------------------


def _place(spark, label):
    return new_stage_path(spark, label)


def _event_stream(spark, sf):
    return M.table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_first_events(spark, sf):
    """Intake of one event per user, type and day."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.to_date("ts").cast("string"))
    events = _event_stream(spark, sf).withColumn("idempotency_key", key)
    kept = M.first_events(events, "idempotency_key", "ts", "60 days").select("idempotency_key")
    return M.drain_appends(kept, _place(spark, "first-events"))


@query
def stream_finding_sources(spark, sf):
    """The source list of each finding, built from a stream of scanner lines joined to tables."""
    lines = M.table_stream(spark, sf, "lineitem")
    static = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    findings = lines.join(static, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("event_id"), F.concat(F.lit("SCN-"), (F.col("l_linenumber") % 3).cast("string")).alias("scanner_id"),
        F.concat(F.lit("CVE-2099-"), (F.col("l_partkey") % 50 + 10000).cast("string")).alias("vulnerability_id"),
        F.when(F.col("l_orderkey") % 97 == 0, "not-a-timestamp").otherwise(F.col("l_shipdate").cast("string")).alias("observed_at"),
        F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("host-"), F.col("l_suppkey").cast("string"))).otherwise(
            F.concat(F.lit("ip-"), F.col("l_suppkey").cast("string"))).alias("asset_ref"),
        F.col("p_brand").alias("component"), F.col("p_size").cast("string").alias("installed_version"),
    )
    matched = V.matched_assets(findings, view(spark, sf, "v_assets"))
    named = matched.withColumn("canonical_finding_id", F.when(~V.malformed(matched.columns), V.canonical_id()))
    return M.drain_sources(named, _place(spark, "finding-sources"))


@query
def stream_stale_observations(spark, sf):
    observed = _event_stream(spark, sf).where("event_type = 'error'").select(
        F.col("event_id").alias("number"), (F.col("user_id") % 10).alias("asset_id"), F.col("ts").alias("opened_at"))
    logs = M.drain_changes(observed, _place(spark, "stale"), M.stale_outputs(view(spark, sf, "v_inventory"), ["asset_id"], "opened_at", "collected_at", "version"), "append")
    both = logs["verify"].withColumn("side", F.lit("verify")).unionByName(logs["open"].withColumn("side", F.lit("open")))
    return both.select("number", "asset_id", "side")


@query
def stream_recurring_windows(spark, sf):
    incidents = _event_stream(spark, sf).where("event_type = 'error'").select("ts", (F.col("user_id") % 10).alias("service_id"))
    keys = ["window_start", "service_id"]
    windows = M.recurring_windows(incidents, ["service_id"], "ts", f"{K.RECURRENCE_DAYS} days")
    found = M.drain_current(windows, _place(spark, "recurring"), keys, M.newest_of(keys), "update")
    return found.withColumn("window_start", F.col("window_start").cast("string"))


@query
def stream_latest_state(spark, sf):
    found = M.drain_latest(_event_stream(spark, sf), _place(spark, "latest"), ["user_id"], "ts", "event_id", ["event_type"])
    return found.withColumn("ts", F.col("ts").cast("string"))


@query
def stream_restart(spark, sf):
    """The newest event per user from a stream that stops half-way and is started again; the events lie in several files."""
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    inbox, place = _place(spark, "inbox"), _place(spark, "restart")
    found = None
    for half in (0, 1):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == half).repartition(3).write.mode("append").parquet(inbox)
        stream = M.file_stream(spark, inbox, events.schema, files_per_batch=2)
        found = M.drain_latest(stream, place, ["user_id"], "ts", "event_id", ["event_type"])
    return found.withColumn("ts", F.col("ts").cast("string"))


@query
def resumable_store(spark, sf):
    """Records written by two jobs, one of them twice, and a third that replaces records by key."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("state"))
    store = S.DatasetStore(_place(spark, "store"), rows.schema)
    for job, part in (("a", 0), ("b", 1), ("a", 0)):
        store.append(rows.where(F.col("number") % 2 == part), "one", job)
    changed = rows.where(F.col("number") % 3 == 0).withColumn("state", F.lit("changed"))
    store.replace(changed, "one", ["number"], "c")
    return store.load(spark, "one")


@query
def stream_quarantine(spark, sf):
    lines = M.table_stream(spark, sf, "lineitem").select(
        F.concat(F.lit("SCN-"), (F.col("l_linenumber") % 3).cast("string")).alias("scanner_id"),
        F.concat(F.lit("CVE-2099-"), (F.col("l_partkey") % 50 + 10000).cast("string")).alias("vulnerability_id"),
        F.when(F.col("l_orderkey") % 97 == 0, "not-a-timestamp").otherwise(F.col("l_shipdate").cast("string")).alias("observed_at"),
    )
    logs = M.drain_changes(lines, _place(spark, "quarantine"), M.quarantine_outputs(), "append")
    sides = logs["accepted"].withColumn("side", F.lit("accepted")).unionByName(logs["quarantined"].withColumn("side", F.lit("quarantined")))
    return sides.groupBy("side", "scanner_id").agg(F.count(F.lit(1)).alias("findings"))
