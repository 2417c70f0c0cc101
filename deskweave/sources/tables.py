"""The given Parquet tables and the relations that queries derive from them.

``VIEWS`` are plain projections and joins whose text is valid in Spark SQL and other ANSI engines.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "v_truth": """
        SELECT d.doc_id AS number, d.doc_id AS seq, d.text AS short_description, d.text AS description,
          d.source AS _test_scenario, d.lang AS priority, d.source AS category,
          CAST(l.quality AS string) AS _expected_quality, CAST(l.toxic AS string) AS _expected_toxic
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v_edges": """
        SELECT * FROM (VALUES (1, 0), (2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (6, 5), (7, 5)) AS e(job_no, parent_no)
        UNION ALL SELECT job_no, job_no - 2 FROM (SELECT DISTINCT job_no FROM v_runs WHERE job_no > 7) a
        UNION ALL SELECT job_no, job_no - 3 FROM (SELECT DISTINCT job_no FROM v_runs WHERE job_no > 7 AND job_no % 3 = 0) b""",
    "v_runs": """
        SELECT l.l_orderkey AS region_run_id, l.job_no, o.o_orderpriority AS region, o.o_orderdate AS scheduled_start,
          CASE WHEN o.o_orderdate < TIMESTAMP '1997-01-01 00:00:00' THEN 'train' ELSE 'evaluation' END AS dataset_split,
          CASE WHEN l.l_returnflag = 'R' AND l.job_no % 3 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS own_status,
          CAST(l.l_quantity AS bigint) * 60 AS duration_seconds, CAST(round(l.l_discount * 1000) AS bigint) AS queue_wait_seconds,
          CASE WHEN l.l_tax >= 0.07 THEN 1 ELSE 0 END AS retry_count
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS job_no FROM lineitem) l
        JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "v_assets": """
        SELECT s_suppkey AS asset_id, concat('host-', CAST(s_suppkey AS string)) AS hostname, concat('ip-', CAST(s_suppkey AS string)) AS ip_address,
          CASE WHEN s_suppkey % 3 = 0 THEN 'dev' ELSE 'prod' END AS environment, r_name AS region, s_acctbal > 0 AS internet_facing,
          CASE s_nationkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS business_criticality, s_suppkey % 2 = 0 AS regulated_data
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 20 <> 0""",
    "v_findings": """
        SELECT l_orderkey AS event_id, l_linenumber AS line_no, concat('SCN-', CAST(l_linenumber % 3 AS string)) AS scanner_id,
          concat('CVE-2099-', CAST(10000 + l_partkey % 50 AS string)) AS vulnerability_id,
          CASE WHEN l_orderkey % 2 = 0 THEN concat('host-', CAST(l_suppkey AS string)) ELSE concat('ip-', CAST(l_suppkey AS string)) END AS asset_ref,
          p_brand AS component, CAST(p_size AS string) AS installed_version, CAST(l_partkey % 101 AS double) / 10 AS cvss_score,
          l_returnflag = 'R' AS known_exploited, l_linestatus = 'O' AS active_exploitation, l_partkey % 9 <> 0 AS fix_available,
          CASE WHEN l_orderkey % 97 = 0 THEN 'not-a-timestamp' ELSE CAST(l_shipdate AS string) END AS observed_at, o_orderdate AS received_at,
          l_partkey % 11 = 0 AS validated_compensating_control
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey""",
    "v_exceptions": """
        SELECT s_suppkey AS exception_id, s_suppkey AS asset_id, concat('CVE-2099-', CAST(10000 + s_suppkey % 50 AS string)) AS vulnerability_id,
          CASE WHEN s_suppkey % 4 = 0 THEN 'expired' ELSE 'approved' END AS status,
          CASE s_nationkey % 3 WHEN 0 THEN TIMESTAMP '1996-06-30 23:59:59' WHEN 1 THEN TIMESTAMP '1998-06-30 23:59:59'
            ELSE TIMESTAMP '2000-06-30 23:59:59' END AS expires_at
        FROM supplier""",
    "v_intents": """
        SELECT l_orderkey AS pool_id, l_linenumber AS intent_no, l_partkey AS port,
          CASE l_returnflag WHEN 'R' THEN 'disabled' ELSE 'active' END AS intent_status,
          CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'approved' END AS lifecycle_state,
          CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE concat('10.0.', CAST(l_suppkey AS string)) END AS ip_address,
          l_orderkey % 33 = 0 AS agent_offline, l_partkey % 2 = 0 AS has_label_rule, l_suppkey % 3 = 0 AS has_firewall_rule, l_partkey % 41 = 0 AS explicit_deny
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_requesters": """
        SELECT c_custkey AS user_id, c_nationkey AS authorized_safe_id, c_mktsegment = 'BUILDING' AS is_admin,
          CASE WHEN c_acctbal > 0 THEN 'mfa' ELSE 'sso' END AS authentication_level FROM customer""",
    "v_accounts": """
        SELECT s_suppkey AS account_id, s_nationkey AS safe_id, s_name AS username,
          CASE WHEN s_acctbal < 0 THEN 'disabled' ELSE 'active' END AS status FROM supplier""",
    "v_memberships": """
        SELECT n_nationkey AS safe_id, concat('group-', CAST(n_regionkey AS string)) AS principal, 'list_accounts' AS permission FROM nation
        UNION ALL SELECT n_nationkey, concat('group-', CAST(n_regionkey AS string)), 'use_accounts' FROM nation WHERE n_nationkey % 2 = 0
        UNION ALL SELECT c_nationkey, concat('user-', CAST(c_custkey AS string)), 'manage_safe' FROM customer""",
    "v_access_requests": """
        SELECT o_orderkey AS request_id, o_custkey AS user_id, l_suppkey AS account_id,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'GET_SECRET' WHEN '2-HIGH' THEN 'GET_CREDENTIAL_METADATA' ELSE 'SEARCH_ACCOUNTS' END AS intent
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_portfolio": """
        SELECT concat('F-', CAST(l_orderkey AS string), '-', CAST(l_linenumber AS string)) AS finding_id,
          CASE WHEN l_returnflag = 'R' THEN 'open' WHEN l_returnflag = 'A' THEN 'closed_remediated' WHEN l_linenumber % 4 = 0 THEN 'accepted_risk'
            WHEN l_linenumber % 4 = 1 THEN 'remediation_in_progress' WHEN l_linenumber % 4 = 2 THEN 'remediation_pending_verification' ELSE 'false_positive' END AS state,
          CASE WHEN l_quantity >= 40 THEN 'P1' WHEN l_quantity >= 20 THEN 'P2' ELSE 'P3' END AS priority,
          CASE l_suppkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'uat' ELSE 'dev' END AS environment, r_name AS region,
          CASE l_partkey % 4 WHEN 0 THEN 'PCI-DSS' WHEN 1 THEN 'PCI-DSS,SOX' WHEN 2 THEN 'HIPAA' ELSE '' END AS scopes,
          CASE WHEN l_suppkey % 7 <> 0 THEN concat('T-', CAST(l_orderkey AS string)) END AS ticket_id,
          CASE WHEN l_returnflag = 'N' AND l_linenumber % 4 = 0 THEN concat('EXC-', CAST(l_suppkey AS string)) END AS exception_id,
          l_discount > 0.07 AS overdue, CASE WHEN l_suppkey % 7 <> 0 THEN l_partkey % 120 END AS detection_to_ticket_minutes
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_inventory": """
        SELECT user_id AS asset_id, ts AS collected_at, value AS version FROM events WHERE event_type <> 'error'""",
    "v_advisories": """
        SELECT concat('CVE-2099-', CAST(10000 + p_partkey % 50 AS string)) AS vulnerability_id, max(p_size) AS epss_rank, count(*) AS parts
        FROM part WHERE p_partkey % 50 < 45 GROUP BY p_partkey % 50""",
    "v_knowledge": """
        SELECT d.doc_id, concat('kb-', CAST(d.doc_id AS string)) AS title, d.text AS content, d.lang, d.source AS owner_group,
          CASE WHEN l.toxic = 1 THEN 'retired' WHEN l.quality = 1 THEN 'published' WHEN l.quality = 0 THEN 'draft' ELSE 'published' END AS status,
          TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(d.n_chars % 1000 AS int) AS effective_from,
          CASE WHEN d.source = 'src1' THEN 'all-authenticated' ELSE concat(d.lang, ',', d.source) END AS scopes
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_service_requests": """
        SELECT o_orderkey AS number, CASE WHEN o_orderstatus = 'F' THEN 'server_browsing_exception' ELSE 'REQIWAV_proxy_unblock' END AS request_type,
          o_custkey AS requested_by, concat('APP-', CAST(o_custkey % 25 AS string)) AS application_id,
          CASE WHEN o_orderpriority = '1-URGENT' THEN 'prod' ELSE 'uat' END AS environment,
          CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('SRV-', CAST(o_custkey AS string)) END AS server_id,
          CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'approved work' END AS business_justification,
          CASE o_orderkey % 11 WHEN 0 THEN '*' WHEN 1 THEN '' ELSE 'docs.example.test' END AS destinations,
          CASE WHEN o_orderkey % 13 = 0 THEN 'any' ELSE '443' END AS port_list, o_orderdate AS requested_start,
          CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' DAY * CAST(o_custkey % 60 AS int) END AS expires_at
        FROM orders""",
    "v_requests": """
        SELECT user_id AS request_id, ts AS at, event_type AS state, event_id AS seq FROM events""",
    "v_incidents": """
        SELECT event_id AS number, ts AS opened_at, user_id % 10 AS service_id, event_type AS symptom FROM events WHERE event_type = 'error'""",
    "v_sources": """
        SELECT doc_id AS source_id, 0 AS source_priority, concat('doc ', CAST(doc_id AS string)) AS title, text AS content, 'incident' AS kind FROM documents
        UNION ALL SELECT page_id, 1, url, html, 'confluence' FROM pages""",
}


def predictions_view(threshold: int = 2000) -> str:
    """Raw responses over ``v_truth``: plain, fenced, prefixed, unusable; some missing, some repeated."""
    return f"""
        SELECT number, seq,
          CASE number % 4 WHEN 0 THEN j WHEN 1 THEN concat('```json', chr(10), j, chr(10), '```') WHEN 2 THEN concat('Answer: ', j) ELSE 'no answer' END AS model_response
        FROM (SELECT number, seq, concat('{{"prediction":{{"quality":" ', CASE WHEN length(description) >= {threshold} THEN '1' ELSE '0' END, '","toxic":"0","confidence":0.5}}}}') AS j
              FROM v_truth WHERE number % 5 <> 0
              UNION ALL
              SELECT number, seq + 1000000000, '{{"quality":"1","toxic":"1"}}' AS j FROM v_truth WHERE number % 7 = 0) t"""


VIEWS["v_pred"] = predictions_view()


# Tables that queries do per-row work on, with the key most of them group by.
WORK_KEYS = {"lineitem": "l_orderkey", "documents": "doc_id", "pages": "page_id"}


# What is known about a path after its first use: schema, and whether it is read by few tasks.
_seen: dict[str, tuple[StructType, bool]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A work table read by fewer tasks than there are cores is spread by its key first.

    That is the case for a small file with one row group only; a large input has more read tasks
    than cores and is never moved. The schema is inferred once per path.
    """
    path = os.path.join(sf_dir, f"{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if path not in _seen:
        df = spark.read.parquet(path)
        _seen[path] = (df.schema, name in WORK_KEYS and df.rdd.getNumPartitions() < cores)
    schema, few_tasks = _seen[path]
    df = spark.read.schema(schema).parquet(path)
    return df.repartition(cores, WORK_KEYS[name]) if few_tasks else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived relation; Spark prunes whatever the query does not read."""
    return relation(spark, sf_dir, VIEWS[name])


def relation(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run view text with the given tables (and views it mentions) bound by name."""
    needed = [v for v in VIEWS if v in text]
    for name in needed:
        view(spark, sf_dir, name).createOrReplaceTempView(name)
    for name in TABLES:
        if name in text:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)

# Records with missing, repeated and clashing numbers, for key repair.
KEY_REPAIR_INPUT = """
    SELECT doc_id AS seq, CASE WHEN n_chars % 4 = 0 THEN NULL WHEN n_chars % 4 = 1 THEN concat('INC', CAST(1000000 + doc_id + n_chars % 37 AS string))
      WHEN n_chars % 4 = 2 THEN '' ELSE concat('OLD', lang, CAST(n_chars AS string)) END AS number
    FROM documents"""
