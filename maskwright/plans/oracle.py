"""SQL that DuckDB runs on the same tables, for the queries of ``catalog``."""

from __future__ import annotations

from ..operators.study import VARIANTS
from .memos import CONTEXT_SQL, GLOSSARY, LABEL_SQL, MEMO_SQL

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"
CARD = r"\b\d{4}(?:[ -]?\d{4}){3}\b"
DATE = r"\b\d{4}-\d{2}-\d{2}\b"
PHONE = r"\+\d{1,3}(?:[ -]?\d{2,7}){2,4}\b"
BASIC = [(EMAIL, "EMAIL_ADDRESS", 1.0), (IPV4, "IP_ADDRESS", 0.6), (DATE, "DATE_TIME", 0.6), (PHONE, "PHONE_NUMBER", 0.4)]
PROJECT = [(r"\b[ABCDEFGHIJKLMNOPRSTUVXYZ]{3}-\d{3}\b", "PLATE", 0.85), (r"\bINV-\d{5}\b", "INVOICE", 0.95), (r"\b\d{6}[-+A]\d{3}[0-9ABCDEFHJKLMNPRSTUVWXY]\b", "PERSONAL_ID", 0.85)]
BUSINESS = [(r"\b\d{7}-\d\b", "FI_BUSINESS_ID", 0.85), (r"\bFI\d{8}\b", "FI_VAT_NUMBER", 0.85)]
WIDE = [(r"of \d{4}-\d{2}", "ORGANIZATION", 0.6), (r"\d{3}, driver \d+", "LOCATION", 0.9), (r"INV-\d{5} of \d{4}-\d{2}-\d{2}", "PERSON", 0.95), (r"Mail [a-z.]+", "PERSON", 0.3)]


def spans(source: str, patterns, value: bool = False) -> str:
    """A query of the spans of patterns in ``source`` (doc_id, text)."""
    one = """SELECT doc_id, CAST(s AS BIGINT) AS "start", CAST(s + length(v) AS BIGINT) AS "end", '{t}' AS entity_type, CAST({sc} AS DOUBLE) AS score, v AS value FROM (
  SELECT doc_id, m[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m FROM {source}) q, unnest(range(1, len(m) + 1)) AS u(i))"""
    made = " UNION ALL ".join(one.format(p=p.replace("'", "''"), t=t, sc=sc, source=source) for p, t, sc in patterns)
    return made if value else f'SELECT doc_id, "start", "end", entity_type, score FROM ({made})'


METHOD_SPANS = "span AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({spans('memo', p)})" for m, p in (("basic", BASIC), ("rules", BASIC + PROJECT), ("rules-business", BASIC + PROJECT + BUSINESS))) + ")"
MIXED = f"span AS ({spans('memo', PROJECT + WIDE + [(DATE, 'DATE_TIME', 0.6)])})"
PLACE = """place AS (SELECT l.*, CAST(p AS BIGINT) AS "start", CAST(p + length(l.value) AS BIGINT) AS "end"
  FROM label l JOIN memo m USING (doc_id) LEFT JOIN LATERAL (SELECT i - 1 AS p FROM (SELECT unnest(range(1, length(m.text) - length(l.value) + 2)) AS i) WHERE substr(m.text, i, length(l.value)) = l.value) ON true)"""
TYPES = """CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' WHEN 'PHONE_NUMBER' THEN 'PHONE' WHEN 'DATE_TIME' THEN 'DATE' WHEN 'ORGANIZATION' THEN 'COMPANY' ELSE entity_type END"""
METHODS = "(SELECT unnest(['basic', 'rules', 'rules-business']) AS method)"


def _resolve(keys: str, source: str = "span") -> str:
    return f"""resolved AS (SELECT {keys}, min("start") AS "start", max("end") AS "end", arg_min(entity_type, (-score, "start" - "end", entity_type, "start")) AS entity_type, max(score) AS score FROM (
  SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY "start", "end", entity_type, score DESC ROWS UNBOUNDED PRECEDING) AS grp FROM (
    SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end", entity_type, score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM {source}))
  GROUP BY {keys}, grp)"""


def _touching(keys: str, source: str = "span", name: str = "merged") -> str:
    return f"""{name} AS (SELECT {keys}, min("start") AS "start", max("end") AS "end" FROM (
  SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS grp FROM (
    SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM {source}))
  GROUP BY {keys}, grp)"""


def _state(spans_of: str, typed: bool, methods: bool = True) -> str:
    on = f" AND {TYPES.replace('entity_type', 's.entity_type')} = p.type" if typed else ""
    return f"""met AS (SELECT k.method, p.doc_id, p.label_id, p.type, p.value, p.language, p.format, p.split, p.location, p."start", coalesce(bool_or(s."start" <= p."start" AND s."end" >= p."end"), false) AS held, count(s."start") > 0 AS touched
  FROM place p CROSS JOIN {METHODS} k LEFT JOIN {spans_of} s ON s.method = k.method AND s.doc_id = p.doc_id AND s."start" < p."end" AND s."end" > p."start"{on} GROUP BY ALL),
state AS (SELECT method, doc_id, label_id, type, value, language, format, split, location, count("start") AS occurrences,
  CASE WHEN count("start") > 0 AND bool_and(held) THEN 'covered' WHEN bool_or(held OR touched) THEN 'partial' ELSE '' END AS state FROM met GROUP BY ALL)"""


COUNTS = "CAST(count(*) AS BIGINT) AS planted, CAST(count(*) FILTER (WHERE state = 'covered') AS BIGINT) AS covered, CAST(count(*) FILTER (WHERE state = 'partial') AS BIGINT) AS partial"
RECALL = "count(*) FILTER (WHERE state = 'covered') / CAST(count(*) AS DOUBLE) AS recall"
TYPED = f"WITH {MEMO_SQL}, {LABEL_SQL}, {METHOD_SPANS}, {PLACE}, {_state('span', True)}"
ANY = f"WITH {MEMO_SQL}, {LABEL_SQL}, {METHOD_SPANS}, {PLACE}, {_touching('method, doc_id')}, {_state('merged', False)}"
RESOLVED = f"WITH {MEMO_SQL}, {MIXED}, {_resolve('doc_id')}"
REDACT = """SELECT m.doc_id, md5(string_agg(piece, '' ORDER BY k)) AS text_md5 FROM memo m JOIN (
  SELECT doc_id, 2 * "start" + 1 AS k, token AS piece FROM tok
  UNION ALL SELECT t.doc_id, 2 * lag_end, substr(m2.text, lag_end + 1, CAST("start" - lag_end AS BIGINT)) FROM (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY "start"), 0) AS lag_end FROM tok) t JOIN memo m2 USING (doc_id)
  UNION ALL SELECT m3.doc_id, 1000000, substr(m3.text, coalesce(e, 0) + 1) FROM memo m3 LEFT JOIN (SELECT doc_id, max("end") AS e FROM tok GROUP BY doc_id) z USING (doc_id)
) USING (doc_id) GROUP BY m.doc_id"""
VALUED = """valued AS (SELECT r.*, substr(m.text, CAST(r."start" + 1 AS BIGINT), CAST(r."end" - r."start" AS BIGINT)) AS value FROM resolved r JOIN memo m USING (doc_id))"""
GLOSS = " UNION ALL ".join(f"SELECT doc_id, strpos(text, '{t}') - 1 AS s, length('{t}') AS n FROM memo WHERE strpos(text, '{t}') > 0" for t in GLOSSARY)
SECTIONS = r"""lined AS (SELECT doc_id, pos, line, CAST(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end",
    CASE WHEN trim(line, chr(10)) = '## Document metadata' THEN 'metadata' WHEN trim(line, chr(10)) = '## Document content' THEN 'body' WHEN trim(line, chr(10)) = '## Review comments' THEN 'comment' END AS opens
  FROM (SELECT doc_id, i AS pos, CASE WHEN i < len(a) THEN a[i] || chr(10) ELSE a[i] END AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM memo) q, unnest(range(1, len(a) + 1)) AS u(i))),
region AS (SELECT doc_id, location, min("end" - length(line)) AS "start", max("end") AS "end" FROM (
  SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM (
    SELECT *, CASE WHEN location = lag(location) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS nw FROM (
      SELECT *, coalesce(last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'body') AS location FROM lined)))
  GROUP BY doc_id, r, location)"""

SQL: dict[str, str] = {
    "entity_counts": f"""SELECT d.lang, s.entity_type, CAST(count(*) AS BIGINT) AS spans, CAST(count(DISTINCT s.doc_id) AS BIGINT) AS documents
FROM ({spans('documents', [(EMAIL, 'EMAIL_ADDRESS', 1.0), (IPV4, 'IP_ADDRESS', 0.6), (CARD, 'CREDIT_CARD', 0.5)])}) s JOIN documents d USING (doc_id) GROUP BY ALL""",
    "pii_spans_email": spans("documents", [(EMAIL, "EMAIL_ADDRESS", 1.0)], True),
    "pii_spans_ipv4": spans("documents", [(IPV4, "IP_ADDRESS", 0.6)], True),
    "pii_spans_card": spans("documents", [(CARD, "CREDIT_CARD", 0.5)], True),
    "invoice_plate_id_spans": f"WITH {MEMO_SQL} {spans('memo', PROJECT)}",
    "business_vat_spans": f"WITH {MEMO_SQL} {spans('memo', BUSINESS)}",
    "glossary_spans": f"""WITH {MEMO_SQL} SELECT doc_id, CAST(s AS BIGINT) AS "start", CAST(s + n AS BIGINT) AS "end", 'ORGANIZATION' AS entity_type, CAST(1 AS DOUBLE) AS score FROM ({GLOSS})""",
    "resolved_spans": f"{RESOLVED} SELECT * FROM resolved",
    "merged_touching": f"WITH {MEMO_SQL}, {MIXED}, {_touching('doc_id')} SELECT * FROM merged",
    "routed_spans": f"WITH {MEMO_SQL}, {MIXED} SELECT * FROM span WHERE entity_type NOT IN ('PERSON', 'ORGANIZATION', 'LOCATION') UNION ALL ({spans('memo', WIDE)})",
    "dedup_max_score": f"""WITH {MEMO_SQL}, {METHOD_SPANS} SELECT doc_id, "start", "end", entity_type, max(score) AS score FROM span GROUP BY ALL""",
    "redacted_text": f"{RESOLVED}, tok AS (SELECT doc_id, \"start\", \"end\", '[' || entity_type || ']' AS token FROM resolved) {REDACT}",
    "pseudonymised_text": f"""{RESOLVED}, {VALUED}, tok AS (SELECT doc_id, "start", "end", '[' || entity_type || '_' || dense_rank() OVER (PARTITION BY doc_id, entity_type ORDER BY f) || ']' AS token
FROM (SELECT *, min("start") OVER (PARTITION BY doc_id, entity_type, value) AS f FROM valued)) {REDACT}""",
    "alias_table_corpus_scope": f"""{RESOLVED}, {VALUED} SELECT entity_type, sha256(value) AS value_sha256, CAST(row_number() OVER (PARTITION BY entity_type ORDER BY d, s) AS BIGINT) AS n
FROM (SELECT entity_type, value, min(doc_id) AS d, arg_min("start", (doc_id, "start")) AS s FROM valued GROUP BY entity_type, value)""",
    "masked_text": f"""WITH {MEMO_SQL}, span AS ({spans('memo', PROJECT)}), {_resolve('doc_id')}, tok AS (SELECT doc_id, "start", "end", repeat('█', CAST("end" - "start" AS BIGINT)) AS token FROM resolved) {REDACT}""",
    "typed_recall": f"{TYPED} SELECT method, type, language, location, format, {COUNTS}, {RECALL} FROM state GROUP BY ALL",
    "any_type_recall": f"{ANY} SELECT method, type, language, {COUNTS}, {RECALL} FROM state GROUP BY ALL",
    "recall_cube": f"{TYPED} SELECT CASE WHEN grouping(method) = 1 THEN 'all' ELSE method END AS method, CASE WHEN grouping(language) = 1 THEN 'all' ELSE language END AS language, {COUNTS}, {RECALL} FROM state GROUP BY CUBE (method, language)",
    "recall_by_split_rollup": f"{TYPED} SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type, {COUNTS}, {RECALL} FROM state GROUP BY ROLLUP (split, type)",
    "recall_grouping_sets": f"{TYPED} SELECT language, format, location, {COUNTS} FROM state GROUP BY GROUPING SETS ((language), (format), (location), (language, format))",
    "best_method": f"""{TYPED}, each AS (SELECT language AS dataset, method, count(*) FILTER (WHERE state = 'covered') / CAST(count(*) AS DOUBLE) AS r FROM state GROUP BY ALL),
means AS (SELECT method, avg(r) AS score, count(*) AS n FROM each GROUP BY method) SELECT method, round(score, 9) AS score FROM means WHERE n = (SELECT count(DISTINCT dataset) FROM each) ORDER BY score DESC, method LIMIT 1""",
    "method_pivot": f"{TYPED} SELECT type AS entity_type, " + ", ".join(f"count(*) FILTER (WHERE state = 'covered' AND method = '{m}') / CAST(count(*) FILTER (WHERE method = '{m}') AS DOUBLE) AS \"{m}\"" for m in ("basic", "rules", "rules-business")) + " FROM state GROUP BY ALL",
    "missed_values": f"""{TYPED} SELECT type, CAST(count(*) FILTER (WHERE state = 'covered') AS BIGINT) AS found, CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT value) FILTER (WHERE state <> 'covered') AS BIGINT) AS missed_values FROM state WHERE occurrences > 0 AND method = 'rules' GROUP BY ALL""",
    "mention_recall": f"""WITH {MEMO_SQL}, {LABEL_SQL}, {METHOD_SPANS}, {PLACE}, met AS (SELECT k.method, p.doc_id, p.label_id, p.type, p."start", coalesce(bool_or(s."start" <= p."start" AND s."end" >= p."end"), false) AS held, count(s."start") > 0 AS touched
  FROM place p CROSS JOIN {METHODS} k LEFT JOIN span s ON s.method = k.method AND s.doc_id = p.doc_id AND s."start" < p."end" AND s."end" > p."start" AND
    CASE p.type WHEN 'COMPANY' THEN s.entity_type = 'ORGANIZATION' WHEN 'DATE' THEN s.entity_type = 'DATE_TIME' WHEN 'EMAIL' THEN s.entity_type = 'EMAIL_ADDRESS' WHEN 'PHONE' THEN s.entity_type = 'PHONE_NUMBER' ELSE true END GROUP BY ALL)
SELECT method, type, CAST(count(*) AS BIGINT) AS mentions, CAST(count(*) FILTER (WHERE held) AS BIGINT) AS covered, CAST(count(*) FILTER (WHERE touched AND NOT held) AS BIGINT) AS partial FROM met GROUP BY ALL""",
    "typed_precision": f"""WITH {MEMO_SQL}, {LABEL_SQL}, {METHOD_SPANS}, {PLACE}, judged AS (SELECT s.method, s.doc_id, s."start", s."end", s.entity_type, CASE WHEN bool_or(p.type = {TYPES.replace('entity_type', 's.entity_type')}) THEN 'correct' WHEN count(p.type) > 0 THEN 'other' ELSE '' END AS j
  FROM span s LEFT JOIN place p ON p.doc_id = s.doc_id AND p."start" < s."end" AND p."end" > s."start" GROUP BY ALL)
SELECT method, entity_type, CAST(count(*) AS BIGINT) AS detections, CAST(count(*) FILTER (WHERE j = 'correct') AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE j = 'other') AS BIGINT) AS other_type, CAST(count(*) FILTER (WHERE j = '') AS BIGINT) AS unlabelled,
  count(*) FILTER (WHERE j = 'correct') / CAST(count(*) AS DOUBLE) AS precision FROM judged GROUP BY ALL""",
    "unlabelled_detections": f"""WITH {MEMO_SQL}, {LABEL_SQL}, {METHOD_SPANS}, {PLACE} SELECT method, entity_type, CAST(count(*) AS BIGINT) AS unlabelled FROM span s
WHERE NOT EXISTS (SELECT 1 FROM place p WHERE p.doc_id = s.doc_id AND p."start" < s."end" AND p."end" > s."start") GROUP BY ALL""",
    "over_masking": f"""WITH {MEMO_SQL}, {LABEL_SQL}, {METHOD_SPANS}, {PLACE}, {_touching('method, doc_id')}, {_touching('doc_id', '(SELECT * FROM place WHERE "start" IS NOT NULL)', 'ranges')},
per AS (SELECT m.method, m.doc_id, m."start", m."end", coalesce(sum(CASE WHEN r.doc_id IS NOT NULL THEN least(m."end", r."end") - greatest(m."start", r."start") END), 0) AS inside FROM merged m LEFT JOIN ranges r ON r.doc_id = m.doc_id AND r."start" < m."end" AND r."end" > m."start" GROUP BY ALL)
SELECT method, CAST(sum("end" - "start") AS BIGINT) AS masked_chars, CAST(sum("end" - "start" - inside) AS BIGINT) AS outside_chars FROM per GROUP BY ALL""",
    "hidden_characters": f"""WITH {MEMO_SQL}, {LABEL_SQL}, span AS ({spans('memo', BASIC + PROJECT)}), {PLACE}, {_touching('doc_id')}, per AS (SELECT p.doc_id, p.label_id, p.type, p."start", p."end", coalesce(sum(CASE WHEN m.doc_id IS NOT NULL THEN least(m."end", p."end") - greatest(m."start", p."start") END), 0) AS c
  FROM place p LEFT JOIN merged m ON m.doc_id = p.doc_id AND m."start" < p."end" AND m."end" > p."start" WHERE p."start" IS NOT NULL GROUP BY ALL)
SELECT type, CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (WHERE c = "end" - "start") AS BIGINT) AS hidden, CAST(count(*) FILTER (WHERE c > 0) AS BIGINT) AS touched, CAST(sum(c) AS BIGINT) AS covered_chars FROM per GROUP BY ALL""",
    "results_upsert": f"""{TYPED}, old AS (SELECT method, language, {COUNTS} FROM state GROUP BY ALL) SELECT * FROM old WHERE method <> 'rules' UNION ALL SELECT method, language, planted, planted, CAST(0 AS BIGINT) FROM old WHERE method = 'rules'""",
    "section_locations": f"WITH {MEMO_SQL}, {SECTIONS} SELECT * FROM region",
    "located_recall": f"""WITH {MEMO_SQL}, {LABEL_SQL}, span AS ({spans('memo', BASIC + PROJECT)}), {PLACE}, {SECTIONS}, inside AS (SELECT p.*, EXISTS (SELECT 1 FROM region r WHERE r.doc_id = p.doc_id AND r.location = p.location AND p."start" >= r."start" AND p."end" <= r."end") AS ok FROM place p),
met AS (SELECT i.doc_id, i.label_id, i.location, i.type, i."start", ok, coalesce(bool_or(s."start" <= i."start" AND s."end" >= i."end"), false) AS held, count(s."start") > 0 AS touched FROM inside i LEFT JOIN span s ON ok AND s.doc_id = i.doc_id AND s."start" < i."end" AND s."end" > i."start" AND {TYPES.replace('entity_type', 's.entity_type')} = i.type GROUP BY ALL),
lab AS (SELECT doc_id, label_id, location, type, count(*) FILTER (WHERE ok AND "start" IS NOT NULL) AS matches, count(*) FILTER (WHERE ok AND held) AS w, bool_or(touched) AS t FROM met GROUP BY ALL)
SELECT location, type, CAST(count(*) AS BIGINT) AS labels, CAST(count(*) FILTER (WHERE matches >= 1 AND w = matches) AS BIGINT) AS whole, CAST(count(*) FILTER (WHERE NOT (matches >= 1 AND w = matches) AND t) AS BIGINT) AS partial, CAST(sum(greatest(0, 1 - matches)) AS BIGINT) AS missing FROM lab GROUP BY ALL""",
    "extraction_recall": f"""WITH {MEMO_SQL}, {LABEL_SQL}, {SECTIONS}, loc AS (SELECT r.doc_id, r.location, string_agg(substr(m.text, CAST(r."start" + 1 AS BIGINT), CAST(r."end" - r."start" AS BIGINT)), chr(10) ORDER BY r."start") AS t FROM region r JOIN memo m USING (doc_id) GROUP BY ALL)
SELECT l.format, l.location, CAST(count(DISTINCT l.doc_id) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS planted, CAST(count(*) FILTER (WHERE strpos(t, l.value) > 0) AS BIGINT) AS returned, CAST(count(*) FILTER (WHERE coalesce(strpos(t, l.value), 0) = 0) AS BIGINT) AS missing,
  count(*) FILTER (WHERE strpos(t, l.value) > 0) / CAST(count(*) AS DOUBLE) AS recall FROM label l LEFT JOIN loc USING (doc_id, location) GROUP BY l.format, l.location""",
    "text_tristate": f"""WITH {MEMO_SQL}, {LABEL_SQL} SELECT type, status, CAST(count(*) AS BIGINT) AS labels FROM (SELECT l.type, CASE WHEN strpos(m.text, l.value) = 0 THEN 'NOT_EXTRACTED' WHEN strpos(regexp_replace(m.text, '{PROJECT[1][0]}', '[INVOICE]', 'g'), l.value) > 0 THEN 'MISSED' ELSE 'CHANGED_REVIEW' END AS status
FROM label l JOIN memo m USING (doc_id)) GROUP BY ALL""",
    "paired_retention": f"""WITH {MEMO_SQL}, {LABEL_SQL}, wide AS (SELECT doc_id, label_id, CASE WHEN doc_id % 13 = 0 THEN 'wrong' ELSE 'correct' END AS raw,
    CASE WHEN doc_id % 17 = 0 THEN NULL WHEN type IN ('INVOICE', 'PLATE') AND doc_id % 3 > 0 THEN 'refused' ELSE 'correct' END AS redacted, CASE WHEN type = 'INVOICE' AND doc_id % 3 > 1 THEN 'wrong' ELSE 'correct' END AS pseudonymized FROM label),
long AS (SELECT 'redacted' AS variant, raw, redacted AS score FROM wide UNION ALL SELECT 'pseudonymized', raw, pseudonymized FROM wide)
SELECT variant, CAST(count(*) FILTER (WHERE raw = 'correct' AND score IS NOT NULL) AS BIGINT) AS raw_correct, CAST(count(*) FILTER (WHERE raw = 'correct' AND score = 'correct') AS BIGINT) AS retained,
  CAST(count(*) FILTER (WHERE raw = 'correct' AND score <> 'correct') AS BIGINT) AS lost, CAST(count(*) FILTER (WHERE raw <> 'correct' AND score = 'correct') AS BIGINT) AS gained, CAST(count(*) FILTER (WHERE score IS NULL) AS BIGINT) AS incomplete,
  count(*) FILTER (WHERE raw = 'correct' AND score = 'correct') / CAST(count(*) FILTER (WHERE raw = 'correct' AND score IS NOT NULL) AS DOUBLE) AS retention FROM long GROUP BY variant""",
    "document_pairs_linkage": """SELECT CAST(a.n_nationkey AS BIGINT) AS first_id, CAST(b.n_nationkey AS BIGINT) AS second_id, a.n_regionkey = b.n_regionkey AS same_subject FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey""",
    "first_unrelated": """SELECT CAST(a.n_nationkey AS BIGINT) AS id, CAST((SELECT min(b.n_nationkey) FROM nation b WHERE b.n_regionkey <> a.n_regionkey) AS BIGINT) AS unrelated_id FROM nation a""",
    "rows_to_markdown": """SELECT '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation""",
    "normalized_markdown": r"""SELECT doc_id, md5(CASE WHEN n = '' THEN '' ELSE n || chr(10) END) AS text_md5 FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^[ \t\f\v]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS n FROM documents)""",
    "char_windows": """SELECT doc_id, CAST(p AS BIGINT) AS "offset", md5(substr(text, p + 1, 4000)) AS piece_md5 FROM documents, unnest(range(0, CAST(3600 * greatest(0, ceil((length(text) - 4000) / 3600.0)) AS BIGINT) + 1, 3600)) AS u(p) WHERE length(text) > 0""",
    "every_third_sample": """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE (n - 1) % 3 = 0""",
    "sentence_budget": """SELECT doc_id FROM (SELECT doc_id, k, sum(k) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT doc_id, length(text) - length(replace(text, '.', '')) AS k FROM documents)) WHERE s - k < 5000""",
    "ocr_cer": """SELECT p_brand, CAST(count(*) AS BIGINT) AS documents, CAST(sum(levenshtein(p_name, t)) AS BIGINT) AS edits, CAST(sum(length(p_name)) AS BIGINT) AS characters, sum(levenshtein(p_name, t)) / CAST(sum(length(p_name)) AS DOUBLE) AS cer FROM (SELECT *, replace(substr(p_name, 2), 'e', 'c') AS t FROM part) GROUP BY p_brand""",
    "word_layout": """SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(i - 1 AS BIGINT) AS idx, w[i] AS text, CAST(coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS "start", CAST(coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x) + 1)), 0) + length(w[i]) AS BIGINT) AS "end", i > 1 AND (i - 1) % 2 = 0 AS breaks
FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part) q, unnest(range(1, len(w) + 1)) AS u(i)""",
    "expand_lines": """WITH words AS (SELECT CAST(p_partkey AS BIGINT) AS doc_id, i - 1 AS idx, w[i] AS text, (i - 1) // 2 AS line FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part) q, unnest(range(1, len(w) + 1)) AS u(i))
SELECT doc_id, CAST(idx AS BIGINT) AS idx, text FROM words w WHERE EXISTS (SELECT 1 FROM words h WHERE h.doc_id = w.doc_id AND h.line = w.line AND h.text LIKE '%e%')""",
    "context_confusion": """SELECT o_orderpriority AS category, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 > 0) AS BIGINT) AS preserve_retained, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0) AS BIGINT) AS preserve_dropped,
  CAST(count(*) FILTER (WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 > 0) AS BIGINT) AS discard_retained, CAST(count(*) FILTER (WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0) AS BIGINT) AS discard_dropped FROM orders GROUP BY ALL""",
}

RULES = spans("memo", BASIC + PROJECT)
SQL |= {
    "merged_display": f"""WITH {MEMO_SQL}, {MIXED} SELECT doc_id, min("start") AS "start", max("end") AS "end", arg_min(entity_type, (-score, "start", -"end", entity_type)) AS entity_type, max(score) AS score FROM (
  SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, entity_type, score ROWS UNBOUNDED PRECEDING) AS grp FROM (
    SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, entity_type, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM span))
  GROUP BY doc_id, grp""",
    "pii_valid_cards": f"""SELECT * FROM ({spans('documents', [(CARD, 'CREDIT_CARD', 0.5)], True)}) WHERE list_sum(list_transform(range(1, 17),
  lambda i: CASE WHEN i % 2 = 1 THEN (2 * CAST(substr(regexp_replace(value, '[^0-9]', '', 'g'), i, 1) AS INT)) // 10 + (2 * CAST(substr(regexp_replace(value, '[^0-9]', '', 'g'), i, 1) AS INT)) % 10
    ELSE CAST(substr(regexp_replace(value, '[^0-9]', '', 'g'), i, 1) AS INT) END)) % 10 = 0""",
    "detection_counts": f"WITH {MEMO_SQL} SELECT doc_id, entity_type, CAST(count(*) AS BIGINT) AS detections FROM ({RULES}) GROUP BY ALL",
    "type_breakdown": f"{TYPED} SELECT type AS entity_type, method, {COUNTS}, {RECALL} FROM state GROUP BY ALL",
    "worst_types": f"""{TYPED}, t AS (SELECT type AS entity_type, {COUNTS} FROM state WHERE method = 'rules' GROUP BY ALL)
SELECT *, CASE WHEN planted = 0 THEN 'not tested' WHEN covered >= 0.95 * planted THEN 'good' WHEN covered + partial = 0 THEN 'not found' WHEN covered = 0 THEN 'partial only' WHEN covered + partial >= 0.95 * planted THEN 'often partial' ELSE 'misses' END AS verdict FROM t""",
    "headline": f"{TYPED} SELECT CAST(count(*) FILTER (WHERE state = 'covered') AS BIGINT) AS found, CAST(count(*) AS BIGINT) AS labels FROM state WHERE method = 'rules'",
    "recall_table": f"{TYPED} SELECT language AS dataset, method, {COUNTS}, {RECALL} FROM state GROUP BY ALL",
    "recall_gate": f"""{TYPED}, g AS (SELECT method, language, {RECALL} FROM state GROUP BY ALL)
SELECT CAST(count(*) AS BIGINT) AS groups, min(recall) AS least, bool_and(recall >= 0.5) AS passed FROM g WHERE method = 'rules' AND language IN ('en', 'fi')""",
    "regression_gate": f"""{TYPED}, t AS (SELECT type, count(*) FILTER (WHERE state = 'covered' AND method = 'rules') AS b, count(*) FILTER (WHERE state = 'covered' AND method = 'basic') AS a FROM state GROUP BY ALL)
SELECT coalesce(bool_or(a < b), false) AS regressed, CAST(count(*) FILTER (WHERE a < b) AS BIGINT) AS losses FROM t""",
    "policy_changes": f"""WITH {MEMO_SQL}, {MIXED}, a AS (SELECT doc_id, "start", "end", entity_type FROM span), b AS (SELECT doc_id, "start", "end", entity_type FROM ({RULES}))
SELECT 'lost' AS change, entity_type, CAST(count(*) AS BIGINT) AS spans FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL UNION ALL SELECT 'recovered', entity_type, CAST(count(*) AS BIGINT) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""",
    "missing_required": f"WITH {MEMO_SQL}, {SECTIONS} SELECT location FROM (SELECT unnest(['body', 'comment', 'footer', 'metadata']) AS location) EXCEPT SELECT location FROM region",
    "type_colours": f"WITH {MEMO_SQL}, {MIXED} SELECT entity_type, CAST((dense_rank() OVER (ORDER BY entity_type) - 1) % 12 AS BIGINT) AS colour FROM (SELECT DISTINCT entity_type FROM span)",
    "truth_values": f"WITH {MEMO_SQL}, {LABEL_SQL} SELECT doc_id, type, array_to_string(list_sort(list(DISTINCT value)), '; ') AS truth FROM label WHERE location = 'body' GROUP BY doc_id, type",
    "study_plan": f"""SELECT document_id, question_id, variant, 'request-' || lpad(CAST(row_number() OVER (ORDER BY document_id, question_id, variant) AS VARCHAR), 5, '0') AS request_id, title
FROM (SELECT CAST(n_regionkey AS BIGINT) AS document_id, CAST(n_nationkey AS BIGINT) AS question_id, r_name AS title, unnest({list(VARIANTS)}) AS variant FROM nation JOIN region ON r_regionkey = n_regionkey)""",
    "nth_of_group": f"WITH {MEMO_SQL} SELECT doc_id, language, format FROM (SELECT *, row_number() OVER (PARTITION BY language, format ORDER BY doc_id) AS r FROM memo) WHERE r = 3",
    "folded_names": r"""SELECT CAST(p_partkey AS BIGINT) AS id, regexp_replace(v, '[^\w.-]+', '_', 'g') AS safe, lower(trim(regexp_replace(v, '\s+', ' ', 'g'))) AS folded, lower(regexp_replace(v, '\s+', '', 'g')) AS stripped, sha256(v) AS key FROM (SELECT p_partkey, p_name || '  /  ' || p_type AS v FROM part)""",
    "truncated_text": f"""WITH {MEMO_SQL} SELECT doc_id, md5(CASE WHEN length(text) <= 150 THEN text ELSE rtrim(CASE WHEN n > 0 THEN substr(head, 1, length(head) - n) ELSE head END, ' ' || chr(10)) || ' (cut)' END) AS text_md5
FROM (SELECT doc_id, text, substr(text, 1, 150) AS head, strpos(reverse(substr(text, 1, 150)), chr(10)) AS n FROM memo)""",
    "clause_bounds": f"""WITH {MEMO_SQL} SELECT doc_id, "start", "end", CAST("start" - length(regexp_extract(substr(text, 1, "start"), '[^\\n.;!?]*$')) AS BIGINT) AS "left", CAST("end" + length(regexp_extract(substr(text, "end" + 1), '^[^\\n.;!?]*')) AS BIGINT) AS "right"
FROM ({spans('memo', [(DATE, 'DATE_TIME', 0.6), PROJECT[1]])}) JOIN memo USING (doc_id)""",
    "distinct_lines": f"""WITH {MEMO_SQL} SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM (
  SELECT doc_id, trim(regexp_replace(a[i], '\\s+', ' ', 'g')) AS line, min(i) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM memo) q, unnest(range(1, len(a) + 1)) AS u(i) GROUP BY doc_id, line) WHERE line <> '' GROUP BY doc_id""",
    "context_filter": f"""WITH {CONTEXT_SQL}, listed AS (
  SELECT doc_id, s1 AS s, e1 AS e, t1 AS kind, stays1 AS stays FROM context_doc UNION ALL SELECT doc_id, s2, e2, t2, stays2 FROM context_doc)
SELECT doc_id, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", kind AS entity_type, CAST(0.9 AS DOUBLE) AS score FROM listed WHERE stays""",
}
