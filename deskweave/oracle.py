"""The same results in plain SQL, for the engine that checks them."""

from __future__ import annotations

from html.entities import html5

from deskweave.sources.tables import VIEWS, predictions_view

SQL: dict[str, str] = {}


def _ctes(*names: str, **extra: str) -> str:
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({text})" for n, text in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"


# --- Evaluation -------------------------------------------------------------------------------

_ANSWER = """
  SELECT number, seq, trim(json_extract_string(body, '$.quality')) AS quality, json_extract_string(body, '$.toxic') AS toxic,
         json_extract_string(body, '$.confidence') AS confidence
  FROM (SELECT number, seq, coalesce(json_extract(j, '$.prediction'), j) AS body
        FROM (SELECT number, seq, CAST(CASE WHEN strpos(model_response, '{') > 0
                THEN regexp_extract(model_response, '(?s)\\{.*\\}') END AS JSON) AS j FROM v_pred) x) y
"""
_RAW_ANSWER = _ANSWER.replace("trim(json_extract_string(body, '$.quality'))", "json_extract_string(body, '$.quality')")
_LAST = "SELECT * FROM answer QUALIFY row_number() OVER (PARTITION BY number ORDER BY seq DESC) = 1"
_SCORED = """
  SELECT t.number, t.seq, t._test_scenario, t.priority, p.number IS NOT NULL AS prediction_received,
    t._expected_quality AS expected_quality, p.quality AS predicted_quality, coalesce(trim(p.quality) = t._expected_quality, false) AS correct_quality,
    t._expected_toxic AS expected_toxic, p.toxic AS predicted_toxic, coalesce(p.toxic = t._expected_toxic, false) AS correct_toxic,
    p.number IS NOT NULL AND coalesce(trim(p.quality) = t._expected_quality, false) AND coalesce(p.toxic = t._expected_toxic, false) AS all_fields_correct,
    p.confidence AS predicted_confidence
  FROM v_truth t {join} JOIN last_pred p ON t.number = p.number
"""


def _scored(threshold: int = 2000, join: str = "") -> str:
    return (
        f"WITH v_truth AS ({VIEWS['v_truth']}), v_pred AS ({predictions_view(threshold)}), answer AS ({_RAW_ANSWER}),\n"
        f"last_pred AS ({_LAST}), scored AS ({_SCORED.format(join=join)})\n"
    )


_OVERALL = """SELECT count(*) AS ticket_count, round(avg(CASE WHEN prediction_received THEN 1.0 ELSE 0.0 END), 6) AS prediction_coverage,
  round(avg(CASE WHEN all_fields_correct THEN 1.0 ELSE 0.0 END), 6) AS overall_exact_match FROM scored"""
_FIELDS = """SELECT f AS field, round(sum(c) / count(*), 6) AS accuracy, round(sum(p) / count(*), 6) AS coverage,
  CAST(sum(c) AS BIGINT) AS correct, count(*) AS total FROM (
    SELECT 'quality' AS f, CASE WHEN correct_quality THEN 1.0 ELSE 0.0 END AS c, CASE WHEN predicted_quality IS NULL THEN 0.0 ELSE 1.0 END AS p FROM scored
    UNION ALL SELECT 'toxic', CASE WHEN correct_toxic THEN 1.0 ELSE 0.0 END, CASE WHEN predicted_toxic IS NULL THEN 0.0 ELSE 1.0 END FROM scored) x GROUP BY f"""

SQL["eval_overall"] = _scored() + _OVERALL
SQL["eval_coverage_vs_holdout"] = _scored(join="LEFT") + _OVERALL
SQL["eval_scored"] = _scored() + "SELECT * FROM scored"
SQL["eval_field_performance"] = _scored() + f"""SELECT *,
  concat(repeat('█', CAST(round_even(accuracy * 12, 0) AS INT)), repeat('░', 12 - CAST(round_even(accuracy * 12, 0) AS INT))) AS bar,
  format('{{:.1f}}%', accuracy * 100) AS shown FROM ({_FIELDS}) z"""
SQL["eval_scenario"] = _scored() + """SELECT coalesce(_test_scenario, 'Unspecified') AS scenario, count(*) AS tickets,
  round(avg(CASE WHEN prediction_received THEN 1.0 ELSE 0.0 END), 6) AS prediction_coverage,
  round(avg(CASE WHEN all_fields_correct THEN 1.0 ELSE 0.0 END), 6) AS all_fields_exact_match,
  round(avg((CAST(correct_quality AS INT) + CAST(correct_toxic AS INT)) / 2.0), 6) AS average_field_accuracy
  FROM scored GROUP BY 1"""
_CELLS = """SELECT coalesce(expected_quality, 'Missing') AS expected, coalesce(predicted_quality, 'Missing') AS predicted, count(*) AS tickets
  FROM scored GROUP BY 1, 2"""
SQL["eval_confusion"] = _scored() + _CELLS
_CLASSES = f"""SELECT label, support, round(CASE WHEN claimed = 0 THEN 0.0 ELSE hits / claimed END, 6) AS precision,
  round(CASE WHEN support = 0 THEN 0.0 ELSE hits / support END, 6) AS recall,
  CASE WHEN support + claimed = 0 THEN 0.0 ELSE 2.0 * hits / (support + claimed) END AS f1
  FROM (SELECT label, CAST(sum(hits) AS DOUBLE) AS hits, CAST(sum(support) AS BIGINT) AS support, CAST(sum(claimed) AS BIGINT) AS claimed FROM (
    SELECT expected AS label, CASE WHEN expected = predicted THEN tickets ELSE 0 END AS hits, tickets AS support, 0 AS claimed FROM ({_CELLS}) a
    UNION ALL SELECT predicted, 0, 0, tickets FROM ({_CELLS}) b) u WHERE label <> 'Missing' GROUP BY label) g"""
SQL["eval_class_metrics"] = _scored() + f"SELECT label, support, precision, recall, round(f1, 6) AS f1 FROM ({_CLASSES}) c"
SQL["eval_macro_f1"] = _scored() + f"""SELECT 'quality' AS field, count(*) AS classes, round(avg(f1), 5) AS macro_f1,
  (SELECT round(avg(CASE WHEN predicted_quality IS NULL THEN 1.0 ELSE 0.0 END), 6) FROM scored) AS invalid_rate FROM ({_CLASSES}) c"""
SQL["eval_failures"] = _scored() + """SELECT number, _test_scenario, prediction_received, expected_quality, predicted_quality, correct_quality,
  expected_toxic, predicted_toxic, correct_toxic, predicted_confidence FROM scored WHERE NOT all_fields_correct ORDER BY seq LIMIT 25"""
SQL["eval_branch_pivot"] = "SELECT b1.field, branch_1000, branch_2000, branch_4000 FROM " + " JOIN ".join(
    f"(SELECT field, accuracy AS branch_{t} FROM ({_scored(t)} {_FIELDS})) b{i}" + ("" if i == 1 else f" ON b1.field = b{i}.field")
    for i, t in enumerate((1000, 2000, 4000), 1)
)
SQL["resolution_view"] = _scored() + "SELECT number, predicted_confidence FROM scored"
SQL["holdout_visible"] = _ctes("v_truth") + "SELECT number, priority, short_description FROM v_truth"
SQL["holdout_sample"] = _ctes("v_truth") + "SELECT number, priority FROM v_truth ORDER BY md5(concat(CAST(number AS string), ':42')), number LIMIT 30"
SQL["holdout_summary"] = _ctes("v_truth") + """SELECT count(*) AS visible_count,
  '_expected_quality, _expected_toxic, _test_scenario, category' AS hidden_columns, 'number' AS id_field FROM v_truth"""
SQL["surrogate_ids"] = _ctes("v_truth") + """SELECT number, seq,
  concat('TEST-', lpad(CAST(row_number() OVER (ORDER BY seq) AS string), 5, '0')) AS _evaluation_id FROM v_truth"""
SQL["batch_numbering"] = _ctes("v_truth") + """SELECT batch_no, count(*) AS tickets, min(number) AS first_number, max(number) AS last_number
  FROM (SELECT number, (row_number() OVER (ORDER BY seq) - 1) // 5 + 1 AS batch_no FROM v_truth) t GROUP BY batch_no"""
_PREDICTED = "(SELECT number FROM v_pred)"
SQL["prediction_semi"] = _ctes("v_truth", "v_pred") + f"SELECT number, _test_scenario FROM v_truth WHERE number IN {_PREDICTED}"
SQL["prediction_missing"] = _ctes("v_truth", "v_pred") + f"SELECT number, _test_scenario FROM v_truth WHERE number NOT IN {_PREDICTED}"
SQL["first_prediction_wins"] = _ctes("v_truth", "v_pred") + "SELECT * FROM v_pred QUALIFY row_number() OVER (PARTITION BY number ORDER BY seq) = 1"
SQL["last_prediction_wins"] = _ctes("v_truth", "v_pred") + "SELECT * FROM v_pred QUALIFY row_number() OVER (PARTITION BY number ORDER BY seq DESC) = 1"

# --- Text and retrieval -----------------------------------------------------------------------

from deskweave.functions import text as X  # noqa: E402

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{X.TOKEN_PATTERN}'), lambda t: NOT list_contains({_STOP}, t))"


def _clean(text: str, limit: int = X.DOCUMENT_LIMIT) -> str:
    return f"substring(trim(regexp_replace({text}, '\\s+', ' ', 'g')), 1, {limit})"


SQL["section_chunks"] = f"""
WITH marked AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\n{{3,}}', chr(1), 'g'), '(^|\\n|\\x01)(#{{1,3}}\\s)', '\\1' || chr(1) || '\\2', 'g') AS t, text FROM documents),
parts AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda p: trim(p, chr(9) || chr(10) || chr(13) || ' ')), lambda p: p <> '') AS ps FROM marked)
SELECT doc_id, i AS section, concat('doc-', CAST(doc_id AS string), ' section ', CAST(i AS string)) AS title, {_clean('ps[i]')} AS content
FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM parts) x"""
SQL["record_documents"] = f"""SELECT CAST(doc_id AS string) AS title, 'incident' AS kind,
  concat('description: ', {_clean('text', 4000)}, chr(10), 'number: ', CAST(doc_id AS string), chr(10), 'source: ', source, chr(10), 'lang: ', lang) AS content FROM documents"""
SQL["token_df"] = f"SELECT term, count(*) AS documents FROM (SELECT unnest(list_distinct({_tokens('text')})) AS term FROM documents) t GROUP BY term"
SQL["term_frequency"] = f"SELECT doc_id, term, count(*) AS frequency FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) t GROUP BY ALL"
SQL["corpus_statistics"] = f"""SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS mean_length
  FROM (SELECT len({_tokens('text')}) AS n FROM documents) t"""
_DOC = "concat('doc ', CAST(doc_id AS string), ' ', text)"
_RANKED = f"""
docs AS (SELECT doc_id, lower({_DOC}) AS body, {_tokens(_DOC)} AS toks FROM documents),
stats AS (SELECT count(*) AS n, greatest(avg(len(toks)), 1.0) AS mean FROM docs),
tf AS (SELECT doc_id, length_, term, count(*) AS f FROM (SELECT doc_id, len(toks) AS length_, unnest(toks) AS term FROM docs) x GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS w FROM (SELECT item_id, unnest({_tokens('text')}) AS term FROM benchmark) x GROUP BY ALL),
phrases AS (SELECT item_id, array_to_string({_tokens('text')}, ' ') AS phrase FROM benchmark),
parts AS (
  SELECT item_id, doc_id, w * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length_ / mean))) AS part
  FROM q JOIN tf USING (term) JOIN df USING (term), stats
  UNION ALL SELECT item_id, doc_id, 2.0 FROM phrases JOIN docs ON phrase <> '' AND contains(body, phrase)),
pairs AS (SELECT item_id, doc_id, round(sum(part), 4) AS score FROM parts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM pairs WHERE score > 0)
"""
SQL["bm25_topk"] = f"WITH {_RANKED} SELECT item_id, doc_id, score, rank FROM ranked WHERE rank <= 5"
_HEAD = "concat('[S', CAST(rank AS string), '] doc ', CAST(doc_id AS string), ' | source=documents')"
SQL["evidence_budget"] = f"""WITH {_RANKED},
heads AS (SELECT item_id, rank, {_HEAD} AS heading, d.text AS content FROM ranked JOIN documents d USING (doc_id) WHERE rank <= 5),
rooms AS (SELECT *, 6000 - coalesce(sum(length(heading) + 1 + length(content)) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  - length(heading) - 2 AS room FROM heads)
SELECT item_id, concat('S', CAST(rank AS string)) AS citation, heading, length(substring(content, 1, CAST(room AS INT))) AS used,
  md5(substring(content, 1, CAST(room AS INT))) AS digest FROM rooms WHERE room > 0"""
SQL["retrieved_sources"] = f"""WITH {_RANKED} SELECT item_id, concat('S', CAST(rank AS string)) AS citation, concat('doc ', CAST(doc_id AS string)) AS title,
  'documents' AS source, 'incident' AS kind, score, '' AS url, md5(d.text) AS content FROM ranked JOIN documents d USING (doc_id) WHERE rank <= 3"""
SQL["literal_passages"] = f"""SELECT item_id, doc_id FROM (SELECT item_id, array_to_string({_tokens('text')}, ' ') AS phrase FROM benchmark) p
  JOIN documents d ON phrase <> '' AND contains(lower(d.text), phrase)"""


_NAMES = "MAP {" + ", ".join("'{}': '{}'".format(name, value.replace("'", "''")) for name, value in html5.items()) + "}"


def _entities(text: str) -> str:
    """Character references by number, hexadecimal number or whole name."""
    name = "substr(r, 2)"
    number = "CASE WHEN r[3] IN ('x', 'X') THEN CAST(concat('0x', rtrim(substr(r, 4), ';')) AS BIGINT) ELSE CAST(rtrim(substr(r, 3), ';') AS BIGINT) END"
    each = f"CASE WHEN r LIKE '&#%' THEN chr(CAST({number} AS INTEGER)) WHEN r LIKE '&_%' THEN coalesce({_NAMES}[{name}], r) ELSE r END"
    pattern = "&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|&|[^&]+"
    return f"CASE WHEN contains({text}, '&') THEN array_to_string(list_transform(regexp_extract_all({text}, '{pattern}'), lambda r: {each}), '') ELSE {text} END"


# A tag ends at the first '>' outside quotes.
_TAG_REST = """(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
_MARKUP = f"(?is)<script\\b{_TAG_REST}>.*?</script\\s*>|<style\\b{_TAG_REST}>.*?</style\\s*>|<!--.*?-->|<[a-z/!?]{_TAG_REST}>|[^<]+|<"


def _html(text: str) -> str:
    piece = (
        f"CASE WHEN regexp_matches(p, '(?is)^<(script|style)') THEN concat(' ', regexp_replace(p, '(?is)^<(?:script|style)\\b{_TAG_REST}>|</(?:script|style)\\s*>$', '', 'g'), ' ') "
        f"WHEN p LIKE '<_%' THEN ' ' ELSE {_entities('p')} END"
    )
    return f"trim(regexp_replace(array_to_string(list_transform(regexp_extract_all({_entities(text)}, '{_MARKUP}'), lambda p: {piece}), ''), '\\s+', ' ', 'g'))"


SQL["html_text"] = f"SELECT page_id, {_html('html')} AS content FROM pages"
SQL["html_text_exact"] = SQL["html_text"]
SQL["page_documents"] = f"""SELECT page_id AS id, CAST(page_id AS string) AS title, {_clean(_html('html'))} AS content, 'Pages' AS source,
  concat('https://kb.example.test/wiki/x/', CAST(page_id AS string)) AS url, 'confluence' AS kind FROM pages"""
SQL["page_phrase_search"] = "SELECT page_id, url FROM pages WHERE contains(lower(html), 'eriner thanea') ORDER BY page_id LIMIT 10"
SQL["recent_history"] = f"""SELECT conv_id, turn, CASE WHEN lower(role) IN ('machine', 'ai', 'assistant') THEN 'assistant' ELSE 'user' END AS role,
  {_clean('text', 3000)} AS content FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) t WHERE {_clean('text', 3000)} <> ''"""
SQL["sources_union"] = """SELECT concat('doc ', CAST(doc_id AS string)) AS title, 'incident' AS kind, length(text) AS size, 0.0 AS score FROM documents
  UNION ALL SELECT url, 'confluence', length(html), NULL FROM pages"""

# --- Ingest -----------------------------------------------------------------------------------

from deskweave.sources.tables import KEY_REPAIR_INPUT  # noqa: E402

SQL["response_records"] = """SELECT min(arrival) AS arrival, source, lang, number FROM (
  SELECT doc_id * 100 AS arrival, source, lang, CAST(NULL AS BIGINT) AS number FROM documents
  UNION ALL SELECT doc_id * 100 + 1, NULL, NULL, doc_id FROM documents) t GROUP BY source, lang, number"""
SQL["exact_distinct"] = "SELECT doc_id, lang, length(text) AS size FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) = 1"
SQL["key_repair"] = f"""WITH rows_ AS (SELECT *, row_number() OVER (ORDER BY seq) AS position FROM ({KEY_REPAIR_INPUT}) t),
marked AS (SELECT *, coalesce(number, '') <> '' AND row_number() OVER (PARTITION BY number ORDER BY seq) = 1 AS keeps FROM rows_),
used AS (SELECT DISTINCT CAST(substring(number, 4) AS BIGINT) AS v FROM marked WHERE keeps AND number LIKE 'INC%'),
broken AS (SELECT seq, 1000000 + position AS home, row_number() OVER (ORDER BY seq) AS i FROM marked WHERE NOT keeps),
free_ AS (SELECT v, row_number() OVER (ORDER BY v) AS idx FROM (SELECT unnest(range(1000001, 1000001 + 3 * (SELECT count(*) FROM rows_))) AS v) r WHERE v NOT IN (SELECT v FROM used)),
own AS (SELECT b.seq, b.i, min(f.idx) AS idx FROM broken b JOIN free_ f ON f.v >= b.home GROUP BY b.seq, b.i),
placed AS (SELECT seq, i + max(idx - i) OVER (ORDER BY i) AS idx FROM own)
SELECT m.seq, m.position, CASE WHEN m.keeps THEN m.number ELSE concat('INC', CAST(f.v AS string)) END AS number
FROM marked m LEFT JOIN placed p ON m.seq = p.seq LEFT JOIN free_ f ON f.idx = p.idx"""
SQL["sys_id_repair"] = """SELECT seq, CASE WHEN sys_id IS NOT NULL AND row_number() OVER (PARTITION BY sys_id ORDER BY seq) = 1 THEN sys_id
  ELSE substring(sha256(concat('signature:', CAST(seq AS string), ':', fp)), 1, 32) END AS sys_id
  FROM (SELECT doc_id AS seq, md5(text) AS fp, CASE WHEN length(text) % 2 = 0 THEN NULL ELSE md5(text) END AS sys_id FROM documents) t"""
SQL["resume_union"] = """SELECT doc_id, lang FROM (SELECT d.doc_id, d.lang, d.text, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS fresh
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id) t
  QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY fresh, doc_id) = 1"""
SQL["redact_email"] = r"""SELECT doc_id, regexp_replace(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b', '[REDACTED_EMAIL]', 'g') AS text FROM documents"""
SQL["redact_fields"] = "SELECT c_custkey, '[REDACTED_C_NAME]' AS c_name, '[REDACTED_C_NAME]' AS inner_name, c_mktsegment AS segment FROM customer"
SQL["field_distribution_top12"] = """SELECT * FROM (SELECT field, label, count(*) AS records, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, label) AS rank
  FROM (SELECT 'lang' AS field, lang AS label FROM documents UNION ALL SELECT 'source', source FROM documents
        UNION ALL SELECT 'n_chars', CAST(n_chars AS string) FROM documents) u WHERE label IS NOT NULL GROUP BY field, label) t WHERE rank <= 12"""
SQL["continuity_summary"] = """SELECT count(*) AS generated_so_far, arg_min(lang, doc_id) FILTER (lang <> 'fr') AS first_record_number,
  arg_max(lang, doc_id) FILTER (lang <> 'fr') AS latest_record_number FROM documents"""
SQL["recent_profile"] = "SELECT doc_id AS number, lang AS category, substring(text, 1, 160) AS state FROM documents ORDER BY doc_id DESC LIMIT 10"
SQL["rotating_examples"] = """SELECT batch_no, place, item_id FROM (SELECT doc_id + 1 AS batch_no, unnest([0, 1, 2]) AS place FROM documents) b
  JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM benchmark) e ON ((batch_no - 1) * 3 + place) % n = pos"""
_DIAG = """(SELECT event_id AS seq, event_type AS finish_reason, user_id % 5 + 1 AS requested,
  least(user_id % 5 + 1, CAST(floor(value) AS BIGINT)) AS returned, value AS completion_tokens FROM events) d"""
SQL["response_diagnostics"] = f"""SELECT finish_reason, count(*) AS responses, CAST(sum(requested) AS BIGINT) AS requested, CAST(sum(returned) AS BIGINT) AS returned,
  CAST(sum(CASE WHEN returned < requested THEN 1 ELSE 0 END) AS BIGINT) AS short_responses, round(avg(completion_tokens), 4) AS mean_tokens FROM {_DIAG} GROUP BY finish_reason"""
SQL["last_diagnostics"] = f"SELECT * FROM {_DIAG} ORDER BY seq DESC LIMIT 100"
SQL["uncached_rows"] = _ctes("v_truth", "v_pred") + f"SELECT number, priority FROM v_truth WHERE number NOT IN {_PREDICTED}"

# --- Vulnerability policy ---------------------------------------------------------------------

from deskweave.plans import vulnerability as V  # noqa: E402

_ASSESSED = """
matched AS (SELECT f.*, a.asset_id, a.environment, a.region, a.internet_facing, a.business_criticality, a.regulated_data
  FROM v_findings f LEFT JOIN v_assets a ON f.asset_ref = a.hostname OR f.asset_ref = a.ip_address),
scored AS (SELECT *, CASE WHEN observed_at <> 'not-a-timestamp' AND asset_id IS NOT NULL
    THEN concat('VF-', CAST(asset_id AS string), '-', vulnerability_id, '-', component, '-', installed_version) END AS canonical_finding_id,
  CASE WHEN observed_at <> 'not-a-timestamp' AND asset_id IS NOT NULL THEN CAST(least(100, greatest(0, round(cvss_score * 6)
    + CASE WHEN known_exploited THEN 15 ELSE 0 END + CASE WHEN active_exploitation THEN 10 ELSE 0 END + CASE WHEN internet_facing THEN 10 ELSE 0 END
    + CASE WHEN environment = 'prod' THEN 5 ELSE 0 END + CASE business_criticality WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 3 ELSE 0 END
    + CASE WHEN regulated_data THEN 5 ELSE 0 END - CASE WHEN validated_compensating_control THEN 15 ELSE 0 END)) AS INT) END AS risk_score FROM matched),
assessed AS (SELECT *, received_at + INTERVAL 1 HOUR * sla_hours AS due_at FROM (SELECT *,
  CASE WHEN risk_score >= 85 THEN 'P1' WHEN risk_score >= 70 THEN 'P2' WHEN risk_score >= 40 THEN 'P3' WHEN risk_score >= 0 THEN 'P4' END AS priority,
  CASE WHEN risk_score >= 85 THEN 24 WHEN risk_score >= 70 THEN 168 WHEN risk_score >= 40 THEN 720 WHEN risk_score >= 0 THEN 2160 END AS sla_hours FROM scored) s)
"""
_EXCEPTED = """
scope AS (SELECT asset_id, vulnerability_id, max(CASE WHEN status = 'approved' THEN expires_at END) AS until_ FROM v_exceptions GROUP BY ALL),
excepted AS (SELECT a.*, coalesce(a.received_at < s.until_, false) AS valid_exception,
  s.asset_id IS NOT NULL AND NOT coalesce(a.received_at < s.until_, false) AS expired_exception
  FROM assessed a LEFT JOIN scope s ON a.asset_id = s.asset_id AND a.vulnerability_id = s.vulnerability_id)
"""


def _case(column: str, values: dict, join: bool = False) -> str:
    body = " ".join(f"WHEN '{k}' THEN '{','.join(v) if join else v}'" for k, v in values.items())
    return f"CASE {column} {body} END"


_DECIDED = f"""
newest AS (SELECT asset_id, max(collected_at) AS at_, arg_max(version, (collected_at, version)) AS version FROM v_inventory GROUP BY asset_id),
first_ AS (SELECT canonical_finding_id, min(received_at) AS first_at FROM assessed WHERE canonical_finding_id IS NOT NULL GROUP BY 1),
flags AS (SELECT e.*, coalesce(n.at_ > try_cast(e.observed_at AS TIMESTAMP), false) AND n.version > 40 AS fixed, coalesce(e.received_at > f.first_at, false) AS known
  FROM excepted e LEFT JOIN newest n ON e.asset_id = n.asset_id LEFT JOIN first_ f ON e.canonical_finding_id = f.canonical_finding_id),
chosen AS (SELECT *, CASE WHEN observed_at = 'not-a-timestamp' THEN 'QUARANTINE' WHEN asset_id IS NULL THEN 'DEFER_ENRICHMENT'
  WHEN valid_exception THEN 'SUPPRESS_VALID_EXCEPTION' WHEN expired_exception THEN 'REOPEN_EXPIRED_EXCEPTION' WHEN fixed THEN 'VERIFY_AND_CLOSE'
  WHEN known AND priority = 'P1' AND due_at < TIMESTAMP '1996-01-01' THEN 'ESCALATE_OVERDUE' WHEN known THEN 'UPDATE_EXISTING'
  WHEN NOT fix_available AND known_exploited THEN 'ISOLATE_AND_ESCALATE' WHEN priority = 'P4' THEN 'TRACK_ONLY' ELSE 'CREATE_TICKET' END AS decision FROM flags),
decided AS (SELECT *, CASE decision WHEN 'QUARANTINE' THEN 'quarantined_feed_record' WHEN 'DEFER_ENRICHMENT' THEN 'unscored_missing_asset_context'
    WHEN 'SUPPRESS_VALID_EXCEPTION' THEN concat('accepted_risk_', lower(priority)) WHEN 'VERIFY_AND_CLOSE' THEN 'remediation_pending_verification'
    WHEN 'ESCALATE_OVERDUE' THEN concat('overdue_', lower(priority)) WHEN 'ISOLATE_AND_ESCALATE' THEN concat('open_actionable_', lower(priority), '_no_fix')
    WHEN 'TRACK_ONLY' THEN concat('tracked_', lower(priority))
    ELSE concat('open_actionable_', lower(priority), CASE WHEN decision = 'CREATE_TICKET' AND validated_compensating_control THEN '_with_control' ELSE '' END) END AS dashboard_bucket,
  CASE WHEN decision <> 'CREATE_TICKET' THEN {_case('decision', V.REASONS)} WHEN validated_compensating_control THEN 'RISK_REDUCED_BUT_STILL_ACTIONABLE'
    WHEN priority = 'P1' AND environment = 'prod' THEN 'CRITICAL_EXPLOITED_PRODUCTION_ASSET' END AS reason_code,
  CASE WHEN decision = 'CREATE_TICKET' THEN concat('FINDING_INGESTED,CVE_ENRICHED,', CASE WHEN validated_compensating_control THEN 'COMPENSATING_CONTROL_VALIDATED,' ELSE '' END,
    'RISK_SCORED,TICKET_CREATED,PATCH_QUEUED') ELSE {_case('decision', V.AUDIT_EVENTS, True)} END AS audit_events,
  {_case('decision', V.TICKET_ACTIONS)} AS ticket_action,
  CASE WHEN decision = 'CREATE_TICKET' THEN 'schedule_patch' ELSE {_case('decision', V.REMEDIATION_ACTIONS)} END AS remediation_action FROM chosen)
"""


def _vuln(*parts: str, extra: tuple[str, ...] = ()) -> str:
    return _ctes("v_findings", "v_assets", *extra).rstrip() + ",\n" + ",\n".join(parts) + "\n"


_ALL_DECIDED = _vuln(_ASSESSED, _EXCEPTED, _DECIDED, extra=("v_exceptions", "v_inventory"))
SQL["asset_match"] = _vuln(_ASSESSED) + "SELECT event_id, line_no, asset_ref, asset_id, region FROM matched"
SQL["cve_enrichment"] = _ctes("v_findings", "v_advisories") + """SELECT event_id, line_no, f.vulnerability_id, epss_rank, parts
  FROM v_findings f LEFT JOIN v_advisories a ON f.vulnerability_id = a.vulnerability_id"""
SQL["exception_match"] = _vuln(_ASSESSED, _EXCEPTED, extra=("v_exceptions",)) + "SELECT event_id, line_no, asset_id, valid_exception, expired_exception FROM excepted"
SQL["newest_evidence"] = _ctes("v_incidents", "v_inventory") + """SELECT number, service_id AS asset_id, version AS evidence_version, coalesce(at_ > opened_at, false) AS newer_evidence
  FROM v_incidents i LEFT JOIN (SELECT asset_id, max(collected_at) AS at_, arg_max(version, (collected_at, version)) AS version FROM v_inventory GROUP BY asset_id) n ON i.service_id = n.asset_id"""
SQL["risk_score"] = _vuln(_ASSESSED) + "SELECT event_id, line_no, canonical_finding_id, risk_score, priority, sla_hours FROM assessed"
SQL["priority_sla"] = _vuln(_ASSESSED) + """SELECT priority, count(*) AS findings, CAST(min(due_at) AS string) AS first_due, CAST(max(due_at) AS string) AS last_due
  FROM assessed GROUP BY priority"""
SQL["finding_decision"] = _ALL_DECIDED + "SELECT event_id, line_no, decision, dashboard_bucket, reason_code, ticket_action, remediation_action, audit_events FROM decided"
SQL["workload_buckets"] = _ALL_DECIDED + """SELECT decision, priority, count(*) AS findings, grouping(decision) AS all_decisions, grouping(priority) AS all_priorities
  FROM decided GROUP BY CUBE (decision, priority)"""
SQL["dashboard_buckets"] = _ALL_DECIDED + "SELECT dashboard_bucket, count(*) AS findings FROM decided GROUP BY 1"
SQL["finding_dedup"] = _vuln(_ASSESSED) + """SELECT canonical_finding_id, count(*) AS observations, count(DISTINCT scanner_id) AS scanners,
  CAST(min(received_at) AS string) AS first_received_at, max(risk_score) AS risk_score FROM assessed WHERE canonical_finding_id IS NOT NULL GROUP BY 1"""
SQL["finding_sources"] = _vuln(_ASSESSED) + """SELECT DISTINCT canonical_finding_id, concat(scanner_id, ':', CAST(event_id AS string)) AS source
  FROM assessed WHERE canonical_finding_id IS NOT NULL"""
SQL["quarantine_split"] = _ctes("v_findings") + """SELECT CASE WHEN try_cast(observed_at AS TIMESTAMP) IS NULL THEN 'quarantined' ELSE 'accepted' END AS side, scanner_id, count(*) AS findings
  FROM v_findings GROUP BY 1, 2"""
_ACTIVE = "state IN ('open', 'remediation_in_progress', 'remediation_pending_verification')"
SQL["portfolio_totals"] = _ctes("v_portfolio") + f"""SELECT count(DISTINCT finding_id) AS total_unique_findings, count(DISTINCT finding_id) FILTER ({_ACTIVE}) AS active_actionable_findings,
  count(DISTINCT finding_id) FILTER ({_ACTIVE} AND overdue) AS overdue_active_findings, count(DISTINCT finding_id) FILTER (state = 'accepted_risk') AS accepted_risk_findings,
  count(DISTINCT finding_id) FILTER (state = 'closed_remediated') AS closed_remediated_findings, round(avg(detection_to_ticket_minutes), 6) AS mean_detection_to_ticket_minutes FROM v_portfolio"""
SQL["portfolio_breakdown"] = _ctes("v_portfolio") + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS active FROM v_portfolio WHERE {_ACTIVE} GROUP BY {d}" for d in ("priority", "environment", "region")
) + " UNION ALL SELECT 'priority', 'P4', 0"
_SCOPED = "(SELECT * FROM (SELECT *, unnest(string_split(scopes, ',')) AS framework FROM v_portfolio) x WHERE framework <> '') s"
SQL["audit_report"] = _ctes("v_portfolio") + f"""SELECT framework, count(*) AS total_findings, count(*) FILTER ({_ACTIVE}) AS active_actionable, count(*) FILTER ({_ACTIVE} AND overdue) AS overdue,
  count(*) FILTER (state = 'accepted_risk') AS accepted_risk, count(*) FILTER (state = 'closed_remediated') AS closed_remediated,
  count(coalesce(ticket_id, exception_id)) AS evidence_rows FROM {_SCOPED} GROUP BY framework"""
SQL["audit_evidence"] = _ctes("v_portfolio") + f"""SELECT framework, concat(finding_id, ':', coalesce(ticket_id, exception_id)) AS evidence_ref
  FROM {_SCOPED} WHERE coalesce(ticket_id, exception_id) IS NOT NULL"""

# --- Provisioning -----------------------------------------------------------------------------

_WANTED = "SELECT pool_id, intent_no, port, '{0}' AS platform FROM v_intents w WHERE intent_status = 'active' AND lifecycle_state = 'approved' AND NOT EXISTS (SELECT 1 FROM v_intents r WHERE r.{1} AND r.pool_id = w.pool_id AND r.port = w.port)"
SQL["rule_gap"] = _ctes("v_intents") + _WANTED.format("label", "has_label_rule") + " UNION ALL " + _WANTED.format("firewall", "has_firewall_rule")
SQL["provision_decision"] = _ctes("v_intents") + """SELECT pool_id, decision, CASE decision
    WHEN 'BLOCK' THEN CASE WHEN not_approved THEN 'POOL_OR_INTENT_NOT_APPROVED' WHEN ip IS NULL THEN 'MISSING_SERVER_IP' ELSE 'INTENT_DISABLED_OR_OVERBROAD' END
    WHEN 'DEFER' THEN 'ILLUMIO_VEN_OFFLINE' WHEN 'MANUAL_REVIEW' THEN 'EXPLICIT_DENY_CONFLICT' WHEN 'CREATE_FIREWALL_ONLY' THEN 'FIREWALL_STATE_MISSING'
    WHEN 'CREATE_ILLUMIO_ONLY' THEN 'ILLUMIO_STATE_MISSING' WHEN 'NO_CHANGE' THEN 'DESIRED_STATE_ALREADY_PRESENT'
    ELSE CASE WHEN intents > 1 THEN 'MULTIPLE_APPROVED_INTENTS_NOT_PROVISIONED' ELSE 'APPROVED_INTENT_NOT_PROVISIONED' END END AS reason_code, intents
  FROM (SELECT *, CASE WHEN not_approved OR ip IS NULL OR unsafe THEN 'BLOCK' WHEN offline THEN 'DEFER' WHEN denied THEN 'MANUAL_REVIEW' WHEN no_label AND no_fw THEN 'CREATE_BOTH'
    WHEN no_fw THEN 'CREATE_FIREWALL_ONLY' WHEN no_label THEN 'CREATE_ILLUMIO_ONLY' ELSE 'NO_CHANGE' END AS decision
    FROM (SELECT pool_id, bool_or(lifecycle_state <> 'approved') AS not_approved, max(ip_address) AS ip, bool_or(intent_status = 'disabled') AS unsafe, bool_or(agent_offline) AS offline,
      bool_or(explicit_deny) AS denied, bool_or(NOT has_label_rule) AS no_label, bool_or(NOT has_firewall_rule) AS no_fw, count(*) AS intents FROM v_intents GROUP BY pool_id) g) d"""
SQL["endpoint_rules"] = """SELECT concat('auto-INT-', CAST(l_orderkey AS string), '-', CAST(l_linenumber AS string)) AS name,
  CASE l_linenumber % 5 WHEN 0 THEN concat('ag-', lower(s_name), '-api-prod') WHEN 1 THEN concat('ag-', p_brand) WHEN 2 THEN 'ag-data-prod' WHEN 3 THEN '10.0.0.0/8'
    ELSE concat('10.0.0.', CAST(l_suppkey AS string)) END AS destination, concat('tcp/', CAST(l_partkey AS string)) AS services,
  CASE l_linenumber % 5 WHEN 0 THEN concat('app=', lower(s_name), ',env=prod,role=api') WHEN 1 THEN concat('app=', p_brand) WHEN 3 THEN NULL ELSE 'env=prod' END AS providers
  FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey"""

# --- Privileged access ------------------------------------------------------------------------

_OBJECTS = """, objects AS (SELECT q.*, r.authorized_safe_id, r.is_admin, r.authentication_level, a.safe_id, a.username, a.status,
  r.is_admin OR r.authorized_safe_id = a.safe_id AS visible FROM v_access_requests q JOIN v_requesters r ON q.user_id = r.user_id JOIN v_accounts a ON q.account_id = a.account_id)
"""
_ACCESS = _ctes("v_access_requests", "v_requesters", "v_accounts", "v_memberships").rstrip() + _OBJECTS
SQL["authorised_accounts"] = _ACCESS + "SELECT DISTINCT request_id, account_id, safe_id, username, status FROM objects WHERE visible"
SQL["withheld_objects"] = _ACCESS + "SELECT DISTINCT request_id, account_id FROM objects WHERE NOT visible"
SQL["access_decision"] = _ACCESS + """SELECT request_id, matched, visible_matches, decision, reason_code FROM (
  SELECT *, CASE reason_code WHEN 'SECRET_DISCLOSURE_PROHIBITED' THEN 'DENY' WHEN 'STEP_UP_AUTHENTICATION_REQUIRED' THEN 'DENY' WHEN 'SAFE_NOT_AUTHORIZED' THEN 'DENY'
    WHEN 'MULTIPLE_ASSET_OR_ACCOUNT_MATCHES' THEN 'CLARIFY' WHEN 'PROMPT_INJECTION_IGNORED' THEN 'PARTIAL' WHEN 'AUTHORIZED_METADATA_SECRET_REDACTED' THEN 'PARTIAL' ELSE 'ANSWER' END AS decision
  FROM (SELECT *, CASE WHEN intent = 'GET_SECRET' THEN 'SECRET_DISCLOSURE_PROHIBITED' WHEN intent = 'GET_CREDENTIAL_METADATA' AND auth = 'sso' THEN 'STEP_UP_AUTHENTICATION_REQUIRED'
    WHEN visible_matches = 0 THEN 'SAFE_NOT_AUTHORIZED' WHEN intent = 'GET_CREDENTIAL_METADATA' AND accounts > 1 THEN 'MULTIPLE_ASSET_OR_ACCOUNT_MATCHES'
    WHEN request_id % 19 = 0 THEN 'PROMPT_INJECTION_IGNORED' WHEN intent = 'GET_CREDENTIAL_METADATA' AND masked > 0 THEN 'AUTHORIZED_METADATA_SECRET_REDACTED'
    WHEN is_admin THEN 'ADMIN_ACCOUNT_MATCHES' ELSE 'AUTHORIZED_ACCOUNT_MATCHES' END AS reason_code
  FROM (SELECT request_id, min(intent) AS intent, bool_or(is_admin) AS is_admin, min(authentication_level) AS auth, count(*) AS matched, count(*) FILTER (visible) AS visible_matches,
    count(*) FILTER (visible AND status = 'active') AS masked, count(DISTINCT account_id) FILTER (visible) AS accounts FROM objects GROUP BY request_id) g) h) i"""
SQL["effective_permissions"] = _ACCESS + """SELECT user_id, safe_id, string_agg(DISTINCT permission, ',' ORDER BY permission) AS permissions,
  coalesce(string_agg(DISTINCT CASE WHEN principal LIKE 'group-%' THEN principal END, ',' ORDER BY CASE WHEN principal LIKE 'group-%' THEN principal END), '') AS inherited_from
  FROM (SELECT DISTINCT user_id, o.safe_id, concat('group-', CAST(n_regionkey AS string)) AS grp FROM objects o JOIN nation ON authorized_safe_id = n_nationkey) a
  JOIN v_memberships m USING (safe_id) WHERE m.principal = concat('user-', CAST(user_id AS string)) OR m.principal = grp GROUP BY user_id, safe_id"""
SQL["safe_review"] = _ctes("v_memberships") + "SELECT safe_id, principal, string_agg(DISTINCT permission, ',' ORDER BY permission) AS permissions FROM v_memberships GROUP BY 1, 2"
SQL["unapproved_grants"] = _ctes("v_memberships") + "SELECT safe_id, principal FROM v_memberships WHERE permission = 'manage_safe' AND length(principal) % 2 = 1"

# --- Knowledge base and requests --------------------------------------------------------------

_PUBLISHED = "status = 'published' AND effective_from <= TIMESTAMP '2024-01-31 00:00:00'"
SQL["published_documents"] = _ctes("v_knowledge") + f"SELECT doc_id, status, scopes FROM v_knowledge WHERE {_PUBLISHED}"
# Written from the rule: who asks sees only the documents of their groups, and all statistics are taken over these.
SQL["authorised_retrieval"] = _ctes("v_knowledge").rstrip() + f""",
docs AS (SELECT doc_id, lower(concat(title, ' ', content)) AS body, {_tokens("concat(title, ' ', content)")} AS toks, string_split(scopes, ',') AS scope FROM v_knowledge WHERE {_PUBLISHED}),
askers AS (SELECT item_id, text, ['all-authenticated', CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'src2' END] AS groups FROM benchmark),
seen AS (SELECT item_id, doc_id, len(toks) AS length_ FROM askers JOIN docs ON list_has_any(groups, scope)),
stats AS (SELECT item_id, count(*) AS n, greatest(avg(length_), 1.0) AS mean FROM seen GROUP BY item_id),
tf AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(toks) AS term FROM docs) x GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS w FROM (SELECT item_id, unnest({_tokens('text')}) AS term FROM askers) x GROUP BY ALL),
met AS (SELECT item_id, doc_id, term, w, f, length_, count(*) OVER (PARTITION BY item_id, term) AS df FROM q JOIN tf USING (term) JOIN seen USING (item_id, doc_id)),
parts AS (SELECT item_id, doc_id, w * ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length_ / mean))) AS part FROM met JOIN stats USING (item_id)
  UNION ALL SELECT item_id, doc_id, 2.0 FROM (SELECT item_id, array_to_string({_tokens('text')}, ' ') AS phrase FROM askers) p JOIN seen USING (item_id) JOIN docs USING (doc_id) WHERE phrase <> '' AND contains(body, phrase)),
pairs AS (SELECT item_id, doc_id, round(sum(part), 4) AS score FROM parts GROUP BY ALL)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM pairs WHERE score > 0 QUALIFY rank <= 5"""
_VERBATIM = "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON trim(b.text) <> '' AND contains(lower(d.text), lower(b.text))"
SQL["verbatim_passages"] = _VERBATIM
SQL["citation_quality"] = f"""WITH {_RANKED}, returned AS (SELECT item_id, doc_id FROM ranked WHERE rank <= 5), expected AS ({_VERBATIM})
SELECT item_id, returned, expected, hits, round(CASE WHEN returned > 0 THEN hits / returned END, 6) AS precision, round(CASE WHEN expected > 0 THEN hits / expected END, 6) AS recall
FROM (SELECT coalesce(r.item_id, e.item_id) AS item_id, count(r.doc_id) AS returned, count(e.doc_id) AS expected, count(*) FILTER (r.doc_id IS NOT NULL AND e.doc_id IS NOT NULL) AS hits
  FROM returned r FULL JOIN expected e ON r.item_id = e.item_id AND r.doc_id = e.doc_id GROUP BY 1) c"""
SQL["recurring_incidents"] = _ctes("v_incidents") + """SELECT c.service_id, CAST(c.opened_at AS string) AS opened_at, c.in_window, n.n_name AS problem_id, n.n_name IS NULL AS create_new_problem
  FROM (SELECT DISTINCT service_id, opened_at, count(*) OVER (PARTITION BY service_id, symptom ORDER BY opened_at RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) AS in_window FROM v_incidents) c
  LEFT JOIN nation n ON c.service_id = n.n_nationkey * 2 WHERE c.in_window >= 3"""
SQL["request_lifecycle"] = _ctes("v_requests") + """SELECT request_id, seq, state, CAST(next_at AS string) AS next_at, date_sub('microsecond', "at", next_at) // 1000000 AS seconds_in_state
  FROM (SELECT *, lead("at") OVER (PARTITION BY request_id ORDER BY "at", seq) AS next_at FROM v_requests) t"""
SQL["request_latest_state"] = _ctes("v_requests") + """SELECT request_id, CAST("at" AS string) AS "at", state, seq FROM v_requests
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY "at" DESC, seq DESC) = 1"""
SQL["missing_fields"] = _ctes("v_service_requests") + """SELECT number, array_to_string(list_filter([CASE WHEN server_id IS NULL THEN 'server_id' END, CASE WHEN destinations = '' THEN 'destination_fqdns' END,
  CASE WHEN business_justification = '' THEN 'business_justification' END, CASE WHEN expires_at IS NULL THEN 'expires_at' END], lambda x: x IS NOT NULL), ',') AS missing FROM v_service_requests"""
SQL["request_decision"] = _ctes("v_service_requests") + """SELECT number, CASE WHEN reason_code IN ('AUTHORIZED_REQUEST_STATUS', 'AUTHORIZED_ON_HOLD_STATUS_WITH_NEXT_STEP') THEN 'SHOW_STATUS'
    WHEN reason_code = 'SERVER_BROWSING_REQUIRED_FIELDS_MISSING' THEN 'CLARIFY' WHEN reason_code LIKE 'COMPLETE%' THEN 'CREATE_REQUEST' ELSE 'DENY' END AS decision, reason_code,
    coalesce(environment = 'prod' AND expires_at - requested_start > INTERVAL 30 DAY, false) AS needs_risk_owner
  FROM (SELECT *, CASE WHEN environment = 'prod' AND NOT (number % 2 = 0 OR application_id = concat('APP-', CAST(number % 25 AS string))) THEN 'SERVICENOW_RECORD_OUTSIDE_REQUESTER_SCOPE'
    WHEN environment = 'prod' THEN CASE WHEN number % 3 = 0 THEN 'AUTHORIZED_ON_HOLD_STATUS_WITH_NEXT_STEP' ELSE 'AUTHORIZED_REQUEST_STATUS' END
    WHEN number % 23 = 0 THEN 'RETIRED_PROMPT_INJECTION_DOCUMENT_FILTERED' WHEN destinations = '*' OR port_list = 'any' OR expires_at IS NULL THEN 'PROHIBITED_OVERBROAD_NETWORK_EXCEPTION'
    WHEN server_id IS NULL OR destinations = '' OR business_justification = '' THEN 'SERVER_BROWSING_REQUIRED_FIELDS_MISSING'
    WHEN request_type = 'server_browsing_exception' THEN 'COMPLETE_BOUNDED_SERVER_BROWSING_REQUEST' ELSE 'COMPLETE_REQIWAV_REQUEST' END AS reason_code FROM v_service_requests) t"""
SQL["incident_links"] = _ctes("v_incidents") + """SELECT number, q.n_name AS request_state, CASE WHEN p.n_nationkey IS NOT NULL THEN 'Known Error' END AS problem_state, p.n_name AS workaround_document_id
  FROM v_incidents i LEFT JOIN nation q ON i.service_id = q.n_nationkey AND q.n_nationkey % 2 = 0 LEFT JOIN nation p ON i.service_id = p.n_nationkey AND i.service_id > 4"""

# --- Job graphs -------------------------------------------------------------------------------

# Written from the rules, not along the operators' frontiers: a run is blocked where a failed one can be reached
# backwards, and an end is the longest of all walks from a job without predecessors.
_COMMANDS = _ctes("v_runs", "v_edges").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
arcs AS (SELECT r.region_run_id, e.job_no AS child, e.parent_no AS parent FROM v_runs r JOIN v_edges e ON r.job_no = e.job_no
  JOIN v_runs p ON p.region_run_id = r.region_run_id AND p.job_no = e.parent_no),
hit AS (SELECT region_run_id, job_no FROM v_runs WHERE own_status <> 'SUCCESS'
  UNION SELECT a.region_run_id, a.child FROM hit h JOIN arcs a ON a.region_run_id = h.region_run_id AND a.parent = h.job_no),
culprits AS (SELECT a.region_run_id, a.child AS job_no, string_agg(CAST(a.parent AS string), ',' ORDER BY a.parent) AS blocked_by
  FROM arcs a JOIN hit h ON a.region_run_id = h.region_run_id AND a.parent = h.job_no GROUP BY a.region_run_id, a.child),
ran AS (SELECT region_run_id, job_no, queue_wait_seconds + duration_seconds AS work FROM v_runs r ANTI JOIN culprits c ON r.region_run_id = c.region_run_id AND r.job_no = c.job_no),
walks AS (SELECT r.region_run_id, r.job_no, r.work AS seconds, [r.job_no] AS back FROM ran r ANTI JOIN arcs a ON r.region_run_id = a.region_run_id AND r.job_no = a.child
  UNION ALL SELECT w.region_run_id, a.child, w.seconds + r.work, list_prepend(a.child, w.back) FROM walks w JOIN arcs a ON a.region_run_id = w.region_run_id AND a.parent = w.job_no
  JOIN ran r ON r.region_run_id = a.region_run_id AND r.job_no = a.child),
longest AS (SELECT region_run_id, job_no, max(seconds) AS end_, first(back ORDER BY seconds DESC, back) AS back FROM walks GROUP BY region_run_id, job_no),
cmds AS (SELECT r.region_run_id, r.job_no, region, scheduled_start, dataset_split, CASE WHEN c.job_no IS NOT NULL THEN 'BLOCKED' ELSE own_status END AS status, coalesce(c.blocked_by, '') AS blocked_by,
  end_ - queue_wait_seconds - duration_seconds AS eligible, end_ - duration_seconds AS start_, end_, CASE WHEN c.job_no IS NULL THEN duration_seconds END AS dur,
  CASE WHEN c.job_no IS NULL THEN retry_count ELSE 0 END AS retry, coalesce(end_, 0) AS elapsed, coalesce(array_to_string(list_reverse(back), '>'), CAST(r.job_no AS string)) AS path
  FROM v_runs r LEFT JOIN culprits c ON r.region_run_id = c.region_run_id AND r.job_no = c.job_no LEFT JOIN longest l ON r.region_run_id = l.region_run_id AND r.job_no = l.job_no)
"""
_BOXES = _COMMANDS.rstrip() + """,
boxes0 AS (SELECT region_run_id, min(region) AS region, min(scheduled_start) AS scheduled_start, min(dataset_split) AS dataset_split,
  CASE WHEN count(*) FILTER (job_no IN (6, 7) AND status = 'SUCCESS') = 2 THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  count(*) FILTER (status = 'SUCCESS') AS ok, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'BLOCKED') AS blocked, CAST(sum(retry) AS BIGINT) AS retries,
  max(end_) AS box_seconds, max(end_) FILTER (job_no = 5 AND status = 'SUCCESS') AS delivery FROM cmds GROUP BY region_run_id),
ends AS (SELECT c.region_run_id, c.path FROM cmds c JOIN boxes0 b ON c.region_run_id = b.region_run_id
  WHERE CASE WHEN b.status = 'SUCCESS' THEN c.job_no IN (6, 7) ELSE c.status = 'FAILED' END QUALIFY row_number() OVER (PARTITION BY c.region_run_id ORDER BY c.elapsed DESC, c.job_no) = 1),
boxes AS (SELECT b.*, coalesce(delivery <= 6000, false) AS met, e.path FROM boxes0 b LEFT JOIN ends e ON b.region_run_id = e.region_run_id)
"""
# Name, predecessors, base minutes and volume sensitivity of the jobs of the regional report box.
_REPORT_JOBS = """
  ('INIT', '', 4, false),
  ('EXTRACT_TRANSACTIONS', 'INIT', 36, true),
  ('EXTRACT_REFERENCE', 'INIT', 12, false),
  ('EXTRACT_CUSTOMERS', 'INIT', 20, true),
  ('VALIDATE_TRANSACTIONS', 'EXTRACT_TRANSACTIONS', 16, true),
  ('ENRICH_DATA', 'VALIDATE_TRANSACTIONS,EXTRACT_REFERENCE,EXTRACT_CUSTOMERS', 25, true),
  ('BUILD_REPORT', 'ENRICH_DATA', 32, true),
  ('PUBLISH_REPORT', 'BUILD_REPORT', 8, false),
  ('ARCHIVE', 'PUBLISH_REPORT', 10, true),
  ('SEND_STATUS', 'PUBLISH_REPORT', 3, false)"""
SQL["job_catalogue"] = f"""SELECT concat('CMD_', s_suppkey, '_', name) AS job_name, 'CMD' AS job_type, concat('BOX_SOD_', s_suppkey, '_REPORTS') AS box_name, CAST(s_suppkey AS string) AS region,
  array_to_string(list_transform(list_filter(string_split(needs, ','), lambda n: n <> ''), lambda n: concat('CMD_', s_suppkey, '_', n)), ',') AS dependencies, minutes AS base_duration_minutes,
  sensitive AS volume_sensitive, name = 'PUBLISH_REPORT' AS delivery_milestone, name IN ('ARCHIVE', 'SEND_STATUS') AS terminal_for_box
  FROM supplier CROSS JOIN (VALUES {_REPORT_JOBS}) t(name, needs, minutes, sensitive)
  UNION ALL SELECT concat('BOX_SOD_', s_suppkey, '_REPORTS'), 'BOX', NULL, CAST(s_suppkey AS string), '', NULL, NULL, NULL, NULL FROM supplier"""
SQL["referential_integrity"] = _ctes("v_assets") + """SELECT child, parent FROM (SELECT DISTINCT l_suppkey AS child, l_partkey % 100 + 1 AS parent FROM lineitem) e
  WHERE child NOT IN (SELECT asset_id FROM v_assets) OR parent NOT IN (SELECT asset_id FROM v_assets)"""
SQL["topo_levels"] = _COMMANDS.rstrip() + """,
steps AS (SELECT job_no, 0 AS level FROM v_edges WHERE parent_no = 0 UNION SELECT e.job_no, s.level + 1 FROM steps s JOIN v_edges e ON e.parent_no = s.job_no)
SELECT concat(CAST(region_run_id AS string), ':', CAST(r.job_no AS string)) AS node, l.level FROM v_runs r JOIN (SELECT job_no, max(level) AS level FROM steps GROUP BY job_no) l ON r.job_no = l.job_no"""
SQL["run_timeline"] = _COMMANDS + "SELECT region_run_id, job_no, status, blocked_by, eligible AS eligible_seconds, start_ AS start_seconds, end_ AS end_seconds, dur AS duration_seconds, elapsed AS elapsed_seconds, path FROM cmds"
SQL["blocked_jobs"] = _COMMANDS + "SELECT region_run_id, job_no, blocked_by FROM cmds WHERE status = 'BLOCKED'"
SQL["predecessor_outcomes"] = _COMMANDS + """SELECT c.job_no, e.parent_no, c.status, p.status AS parent_status, count(*) AS runs FROM cmds c JOIN v_edges e ON c.job_no = e.job_no
  JOIN cmds p ON p.region_run_id = c.region_run_id AND p.job_no = e.parent_no GROUP BY ALL"""
SQL["critical_path"] = _BOXES + "SELECT region_run_id, status, path AS critical_path_jobs FROM boxes"
SQL["box_rollup"] = _BOXES + """SELECT region_run_id, status, ok AS successful_cmd_count, failed AS failed_cmd_count, blocked AS blocked_cmd_count, retries AS total_retry_count,
  box_seconds AS box_duration_seconds, delivery AS delivery_duration_seconds, met AS delivery_sla_met FROM boxes"""
SQL["runs_with_box"] = _BOXES + "SELECT c.job_no, c.status, b.status AS box_status, count(*) AS runs FROM cmds c JOIN boxes b ON c.region_run_id = b.region_run_id GROUP BY ALL"
SQL["sla_report"] = _BOXES + """SELECT region, dataset_split, count(*) AS boxes, count(*) FILTER (met) AS met, count(delivery) AS delivered,
  CAST(max(scheduled_start + INTERVAL 1 SECOND * delivery) AS string) AS last_delivery, round(avg(delivery), 4) AS mean_seconds FROM boxes GROUP BY ALL"""
_Q = _COMMANDS.rstrip() + """,
q AS (SELECT region, job_no, count(*) AS runs, quantile_cont(dur, 0.5) AS p50, quantile_cont(dur, 0.9) AS p90 FROM cmds WHERE dataset_split = 'train' AND status = 'SUCCESS' GROUP BY ALL)
"""
SQL["duration_quantiles"] = _Q + "SELECT * FROM q"
SQL["failure_rate"] = _COMMANDS + """SELECT region, job_no, count(*) AS runs, round(avg(CASE WHEN status = 'FAILED' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate,
  round(avg(CASE WHEN retry > 0 THEN 1.0 ELSE 0.0 END), 6) AS retry_rate FROM cmds WHERE dataset_split = 'train' AND status <> 'BLOCKED' GROUP BY ALL"""
SQL["eta_backtest"] = _Q + """SELECT c.region, c.job_no, count(*) AS runs, round(avg(abs(dur - p50)), 4) AS mean_absolute_error, round(avg(CASE WHEN dur <= p90 THEN 1.0 ELSE 0.0 END), 6) AS p90_coverage
  FROM cmds c JOIN q ON c.region = q.region AND c.job_no = q.job_no WHERE dataset_split = 'evaluation' AND status = 'SUCCESS' GROUP BY ALL"""
SQL["rolling_duration"] = _ctes("v_runs") + """SELECT region_run_id, job_no, round(avg(duration_seconds) OVER (PARTITION BY job_no ORDER BY scheduled_start, region_run_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS recent_mean FROM v_runs"""
_SNAP = _Q.rstrip() + """,
newest AS (SELECT region, arg_max(region_run_id, (scheduled_start, region_run_id)) AS region_run_id FROM cmds WHERE dataset_split = 'evaluation' GROUP BY region),
snap AS (SELECT c.region, c.job_no, CASE WHEN end_ <= 4000 THEN c.status WHEN start_ <= 4000 THEN 'RUNNING' ELSE 'WAITING' END AS status, end_, 4000 - start_ AS spent
  FROM cmds c JOIN newest n ON c.region_run_id = n.region_run_id),
rest AS (SELECT s.region, s.job_no, s.spent AS elapsed_seconds, coalesce(quantile_cont(c.dur, 0.5) - s.spent, 0.0) AS remaining_p50, coalesce(quantile_cont(c.dur, 0.9) - s.spent, 0.0) AS remaining_p90
  FROM snap s LEFT JOIN cmds c ON c.region = s.region AND c.job_no = s.job_no AND c.dataset_split = 'train' AND c.status = 'SUCCESS' AND c.dur > s.spent
  WHERE s.status = 'RUNNING' GROUP BY s.region, s.job_no, s.spent)
"""
SQL["remaining_time"] = _SNAP + "SELECT * FROM rest"


SQL["live_eta"] = _SNAP.rstrip() + """,
states AS (SELECT q.region, q.job_no, s.status, q.p50, q.p90, CASE s.status WHEN 'SUCCESS' THEN s.end_ WHEN 'RUNNING' THEN 4000 + r.remaining_p50 END AS a,
  CASE s.status WHEN 'SUCCESS' THEN s.end_ WHEN 'RUNNING' THEN 4000 + r.remaining_p90 END AS b
  FROM q LEFT JOIN snap s ON q.region = s.region AND q.job_no = s.job_no LEFT JOIN rest r ON q.region = r.region AND q.job_no = r.job_no),
lines AS (SELECT c.region, c.job_no AS child, p.job_no AS parent FROM states c JOIN v_edges e ON c.job_no = e.job_no JOIN states p ON c.region = p.region AND p.job_no = e.parent_no),
halted AS (SELECT region, job_no FROM states WHERE status IN ('FAILED', 'BLOCKED') UNION SELECT l.region, l.child FROM halted h JOIN lines l ON l.region = h.region AND l.parent = h.job_no),
alive AS (SELECT s.* FROM states s ANTI JOIN halted h ON s.region = h.region AND s.job_no = h.job_no),
ways AS (SELECT region, job_no, CAST(coalesce(a, 4000 + p50) AS DOUBLE) AS a, CAST(coalesce(b, 4000 + p90) AS DOUBLE) AS b FROM alive
  UNION SELECT w.region, l.child, w.a + s.p50, w.b + s.p90 FROM ways w JOIN lines l ON l.region = w.region AND l.parent = w.job_no
  JOIN alive s ON s.region = l.region AND s.job_no = l.child AND s.a IS NULL),
etas AS (SELECT s.region, s.job_no, any_value(s.status) AS status, max(w.a) AS a, max(w.b) AS b FROM states s LEFT JOIN ways w ON s.region = w.region AND s.job_no = w.job_no GROUP BY s.region, s.job_no),
found AS (SELECT region, count(*) FILTER (job_no IN (6, 7) AND status = 'SUCCESS') = 2 AS complete,
  CASE WHEN count(*) FILTER (job_no IN (6, 7) AND status = 'SUCCESS') = 2 THEN 'complete' WHEN count(*) FILTER (status = 'FAILED') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'BLOCKED') > 0 THEN 'blocked'
    WHEN count(*) FILTER (status = 'RUNNING') > 0 THEN 'running' WHEN count(*) FILTER (status = 'SUCCESS') > 0 THEN 'waiting' ELSE 'not_started' END AS status,
  coalesce(min(job_no) FILTER (status = 'FAILED'), first(job_no ORDER BY a DESC, job_no) FILTER (status = 'RUNNING' AND a IS NOT NULL), min(job_no) FILTER (status = 'WAITING')) AS blocking,
  max(a) FILTER (job_no = 5) AS delivery_p50_seconds, max(b) FILTER (job_no = 5) AS delivery_p90_seconds,
  CASE WHEN count(a) FILTER (job_no IN (6, 7)) = 2 THEN max(a) FILTER (job_no IN (6, 7)) END AS box_p50_seconds,
  CASE WHEN count(b) FILTER (job_no IN (6, 7)) = 2 THEN max(b) FILTER (job_no IN (6, 7)) END AS box_p90_seconds FROM etas GROUP BY region)
SELECT region, status, CASE WHEN NOT complete THEN CAST(blocking AS string) END AS blocking_job, delivery_p50_seconds, delivery_p90_seconds, box_p50_seconds, box_p90_seconds,
  CASE WHEN delivery_p50_seconds IS NULL OR delivery_p50_seconds > 6000 THEN 'breach' WHEN delivery_p90_seconds > 6000 THEN 'at_risk' ELSE 'on_track' END AS sla_risk FROM found"""
SQL["business_days"] = """SELECT CAST(CAST(d AS DATE) AS string) AS day, dayname(d) AS weekday, dayofweek(d) = 1 AS is_monday, dayofweek(d) = 5 AS is_friday
  FROM (SELECT unnest(generate_series(CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS d FROM orders) t WHERE dayofweek(d) BETWEEN 1 AND 5"""
SQL["holiday_runs"] = """WITH days AS (SELECT o_orderpriority AS region, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5),
hol AS (SELECT region, year(d) AS y, max(d) AS d FROM days GROUP BY ALL)
SELECT days.region, hol.d IS NOT NULL AS is_regional_holiday, count(*) AS runs, round(sum(o_totalprice), 2) AS volume FROM days LEFT JOIN hol ON days.region = hol.region AND days.d = hol.d GROUP BY ALL"""
_LATEST = "SELECT * FROM events WHERE event_type = '{}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
SQL["state_overlay"] = f"""SELECT b.user_id, CASE WHEN p.user_id IS NOT NULL THEN p.event_type ELSE b.event_type END AS event_type,
  CASE WHEN p.user_id IS NOT NULL THEN CASE WHEN p.value > 20 THEN p.value END ELSE b.value END AS value, CAST(b.ts AS string) AS ts
  FROM ({_LATEST.format('view')}) b LEFT JOIN ({_LATEST.format('error')}) p ON b.user_id = p.user_id"""
SQL["snapshot_replicas"] = """SELECT user_id, event_type, day_offset, CAST(ts + INTERVAL 1 DAY * day_offset AS string) AS ts
  FROM (SELECT *, unnest([0, 1, 2, 3, 4]) AS day_offset FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e) r"""
SQL["latest_state"] = """SELECT user_id, CAST(ts AS string) AS ts, event_type, value FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""

# --- Scoring and streams ----------------------------------------------------------------------

SQL["batched_scorer"] = _ctes("v_truth") + "SELECT CAST(number AS string) AS number, CASE WHEN length(description) >= 2000 THEN '1' ELSE '0' END AS quality FROM v_truth"
SQL["dry_run_predictions"] = _ctes("v_truth") + "SELECT number, 'dry_run' AS _status, CAST(NULL AS string) AS quality, CAST(NULL AS string) AS toxic FROM v_truth"
SQL["stream_first_events"] = "SELECT DISTINCT concat(CAST(user_id AS string), ':', event_type, ':', CAST(CAST(ts AS DATE) AS string)) AS idempotency_key FROM events"
SQL["stream_finding_sources"] = SQL["finding_sources"]
SQL["stream_stale_observations"] = SQL["newest_evidence"].replace("version AS evidence_version, coalesce(at_ > opened_at, false) AS newer_evidence", "CASE WHEN at_ > opened_at THEN 'verify' ELSE 'open' END AS side")
SQL["stream_recurring_windows"] = """SELECT CAST(w AS string) AS window_start, service_id, count(*) AS incidents
  FROM (SELECT user_id % 10 AS service_id, date_trunc('day', ts) - INTERVAL 1 DAY * unnest(range(30)) AS w FROM events WHERE event_type = 'error') t GROUP BY ALL HAVING count(*) >= 3"""
SQL["stream_latest_state"] = """SELECT user_id, CAST(ts AS string) AS ts, event_type, event_id FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
SQL["stream_quarantine"] = SQL["quarantine_split"]
SQL["stream_restart"] = SQL["stream_latest_state"]
SQL["resumable_store"] = "SELECT o_orderkey AS number, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END AS state FROM orders"

# --- Value forms ------------------------------------------------------------------------------

SQL["normalised_values"] = """SELECT p_partkey, replace(lower(trim(regexp_replace(concat('  ', p_type, '  Straße ', p_name), '\\s+', ' ', 'g'))), 'ß', 'ss') AS plain,
  trim(regexp_replace(lower(p_type), '[^\\p{L}\\p{Nd}]+', '_', 'g'), '_') AS slug FROM part"""
SQL["list_match"] = "SELECT o_orderkey, o_custkey % 2 = 0 OR o_orderpriority = '5-LOW' AS same FROM orders"
SQL["active_catalogue"] = "SELECT p_partkey AS platform_id, p_name AS display_name FROM part WHERE p_brand = 'Brand#11' AND p_size > 10"
SQL["actionable_findings"] = _ctes("v_portfolio") + f"SELECT state, priority, count(*) AS findings FROM v_portfolio WHERE {_ACTIVE} GROUP BY ALL"
SQL["prompt_rows"] = "SELECT doc_id, CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source}) AS string) AS prompt FROM documents"
SQL["compact_examples"] = "SELECT doc_id, substring(text, 1, 500) AS text FROM documents"

# --- Files, and forms that other queries do not reach ------------------------------------------

SQL["record_files"] = "SELECT c_custkey, c_name, c_mktsegment FROM customer"
SQL["table_group"] = """SELECT 'nations' AS kind, CAST(n_nationkey AS BIGINT) AS id, n_name AS value FROM nation UNION ALL SELECT 'regions', r_regionkey, r_name FROM region
  UNION ALL SELECT 'suppliers', s_suppkey, CAST(s_nationkey AS string) FROM supplier"""
SQL["csv_snapshot"] = "SELECT CAST(p_partkey AS string) AS p_partkey, p_name, p_brand, CAST(p_size AS string) AS p_size FROM part"
SQL["reference_examples"] = """SELECT concat('team-', s_nationkey) AS example_group, CAST(s_suppkey AS string) AS number,
  CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE concat('team-', s_nationkey) END AS assignment_group FROM supplier"""
SQL["align_predictions"] = _ctes("v_truth") + """SELECT batch, CAST(number AS string) AS number, CAST(number % 2 AS string) AS quality
  FROM (SELECT number, number // 5 AS batch, row_number() OVER (PARTITION BY number // 5 ORDER BY number) AS place, count(*) OVER (PARTITION BY number // 5) AS n FROM v_truth) t
  WHERE batch % 4 <> 0 OR (place < n AND number % 3 <> 0)"""
SQL["present_column_wins"] = f"""WITH v_truth AS ({VIEWS['v_truth']}), v_pred AS ({predictions_view()}), answer AS ({_RAW_ANSWER})
SELECT number, seq, CASE WHEN number % 2 = 0 THEN 'given' END AS quality, toxic FROM answer"""
SQL["second_source"] = f"""WITH {_RANKED}, every AS (
  SELECT item_id, doc_id, 0 AS source_priority, score FROM ranked WHERE rank <= 3
  UNION ALL SELECT b.item_id, p.page_id, 1, NULL FROM pages p JOIN benchmark b ON p.page_id % 40 = b.item_id)
SELECT item_id, doc_id, source_priority, concat('S', row_number() OVER (PARTITION BY item_id ORDER BY source_priority, score DESC NULLS LAST, doc_id)) AS citation FROM every"""
SQL["current_approvers"] = """SELECT l_orderkey, CASE WHEN n IS NOT NULL THEN concat('role-', n) END AS approver
  FROM (SELECT l_orderkey, min(l_linenumber) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY l_orderkey) t"""
SQL["fact_coverage"] = """SELECT doc_id, count(*) AS facts, count(*) FILTER (found) AS found, round(avg(CASE WHEN found THEN 1.0 ELSE 0.0 END), 6) AS coverage
  FROM (SELECT l.doc_id, contains(lower(coalesce(d.text, '')), fact) AS found FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id CROSS JOIN (VALUES ('the'), ('tion'), ('no such fact')) f(fact)) t GROUP BY doc_id"""
SQL["ordered_actions"] = f"""WITH decided AS ({SQL['provision_decision']}),
names AS (SELECT pool_id, intent_no, port, concat('INT-', intent_no, '-', port) AS id FROM ({VIEWS['v_intents']}) v)
SELECT pool_id, CASE WHEN any_value(decision) = 'DEFER' THEN 'RETRY_AFTER_VEN_ONLINE' ELSE coalesce(string_agg(CASE decision
    WHEN 'CREATE_BOTH' THEN concat('CREATE_ILLUMIO_RULE:', id, ',CREATE_FIREWALL_RULE:', id) WHEN 'CREATE_ILLUMIO_ONLY' THEN concat('CREATE_ILLUMIO_RULE:', id)
    WHEN 'CREATE_FIREWALL_ONLY' THEN concat('CREATE_FIREWALL_RULE:', id) WHEN 'MANUAL_REVIEW' THEN concat('OPEN_SECURITY_REVIEW:', id) END, ',' ORDER BY intent_no, port, id), '') END AS actions
FROM names JOIN decided USING (pool_id) GROUP BY pool_id"""
SQL["rule_differences"] = """WITH rules AS (SELECT lower(concat('RULE-', l_partkey % 50)) AS name, array_to_string(list_sort([lower(l_returnflag), lower(l_linestatus)]), ',') AS labels, l_linenumber FROM lineitem)
SELECT name, labels, count(*) FILTER (l_linenumber % 2 = 1) AS in_left, count(*) FILTER (l_linenumber % 2 = 0) AS in_right FROM rules GROUP BY name, labels HAVING in_left <> in_right"""
SQL["clock_texts"] = """SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ') AS iso,
  CASE WHEN user_id % 7 <> 0 THEN CAST(CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 HOUR * (user_id % 24) + INTERVAL 30 MINUTE AS string) END AS scheduled FROM events"""
SQL["canonical_json"] = """SELECT o_orderkey, concat('{"a": "', lower(o_orderstatus), '", "tags": ["', least(lower(o_orderpriority), lower(o_orderstatus)), '", "', greatest(lower(o_orderpriority), lower(o_orderstatus)), '"]}') AS plain FROM orders"""
SQL["missing_values"] = """WITH t AS (SELECT event_id % 3 = 0 OR value IS NULL AS missing, count(*) AS events FROM events GROUP BY 1)
SELECT missing, events, 'batch' AS mode, (SELECT sum(events)::BIGINT FROM t WHERE NOT missing) AS predictions FROM t"""
