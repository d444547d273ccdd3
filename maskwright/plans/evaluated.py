"""Queries of evaluations, frozen inputs and row forms with their SQL side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms as T
from ..operators import detect as D
from ..operators import evaluate as E
from . import catalog as K
from . import memos as M
from . import oracle as A

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


KEY = "o_orderkey"


def _orders(spark, sf_dir, **columns):
    """Rows made of the orders' keys by expressions that both engines read."""
    return K.read(spark, sf_dir, "orders").select(*(F.expr(e).alias(n) for n, e in columns.items()))


def _made(**columns) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM orders"


def _sets(keys: tuple[str, ...], sets: list[tuple[str, ...]], measures: str, source: str) -> str:
    names = ", ".join(f"CASE WHEN grouping({k}) = 1 THEN 'all' ELSE {k} END AS {k}" for k in keys)
    listed = ", ".join("(" + ", ".join(s) + ")" for s in sets)
    return f"SELECT {names}, {measures} FROM ({source}) GROUP BY GROUPING SETS ({listed})"


def _count(name: str, where: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {where}) AS BIGINT) AS {name}"


def _sum(*names: str) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)


LANGUAGE = M.FIELDS["language"]
IMAGES = {
    "doc_id": f"CAST({KEY} AS BIGINT)", "method": f"CASE WHEN {KEY} % 2 = 0 THEN 'basic' ELSE 'rules' END", "language": LANGUAGE, "words": f"CAST(10 + {KEY} % 7 AS BIGINT)",
    "words_blacked": f"CAST({KEY} % 5 AS BIGINT)", "other_words": f"CAST(({KEY} % 2) * ({KEY} % 4) AS BIGINT)", "other_words_blacked": f"CAST(({KEY} % 2) * least({KEY} % 4, {KEY} % 3) AS BIGINT)", "seconds": "CAST(0.25 AS DOUBLE)",
}


@query(f"""WITH d AS ({_made(**IMAGES)}), e AS (SELECT o_orderkey AS doc_id, o_orderkey + unnest(range(0, o_orderkey % 3)) AS x FROM orders),
p AS (SELECT doc_id, count(*) AS planted, {_count('unread', 'x % 4 = 0')}, {_count('hidden', 'x % 4 = 1')}, {_count('partial', 'x % 4 = 2')}, {_count('leaked', 'x % 4 = 3')}, {_count('text_hidden', 'x % 2 = 0')} FROM e GROUP BY 1),
j AS (SELECT d.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('planted', 'unread', 'hidden', 'partial', 'leaked', 'text_hidden'))} FROM d LEFT JOIN p USING (doc_id)),
g AS (SELECT method, language, count(*) AS documents, {_sum('planted', 'unread', 'hidden', 'partial', 'leaked', 'text_hidden', 'words', 'words_blacked', 'other_words', 'other_words_blacked')}, avg(seconds) AS seconds_per_image FROM j GROUP BY 1, 2)
SELECT *, planted - unread AS readable_before, coalesce(hidden / nullif(planted - unread, 0), 0) AS image_recall, hidden / nullif(planted, 0) AS hidden_of_planted, text_hidden / nullif(planted, 0) AS text_recall,
  coalesce(words_blacked / nullif(words, 0), 0) AS over_redaction, coalesce(other_words_blacked / nullif(other_words, 0), 0) AS other_words_redacted FROM g""")
def image_summary(spark, sf_dir):
    rows = K.read(spark, sf_dir, "orders").filter(F.col(KEY) % 3 > 0).select(F.col(KEY).cast("long").alias("doc_id"), F.explode(F.sequence(F.lit(0), (F.col(KEY) % 3 - 1).cast("int"))).alias("i"))
    x = F.col("doc_id") + F.col("i")
    state = F.when(x % 4 == 0, "unread").when(x % 4 == 1, "hidden").when(x % 4 == 2, "partial").otherwise("leaked")
    entities = rows.select("doc_id", state.alias("state"), (x % 2 == 0).alias("text_hidden"))
    return E.image_summary(_orders(spark, sf_dir, **IMAGES), entities, "method", "language")


@query("""WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS doc_id, string_split(p_name || ' ' || p_type, ' ') AS w FROM part),
v AS (SELECT doc_id, w, w[2] || ' ' || w[3] AS value FROM p), i AS (SELECT doc_id, w, value, unnest(range(1, len(w))) AS i FROM v)
SELECT doc_id, value, CAST(length(array_to_string(w[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS BIGINT) AS "start", CAST(i - 1 AS STRING) || ',' || CAST(i AS STRING) AS words FROM i WHERE w[i] || ' ' || w[i + 1] = value""")
def word_occurrences(spark, sf_dir):
    words = K._words(spark, sf_dir)
    # the second and third word of a part stand on two lines
    w = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    values = K.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", w[1], w[2]).alias("value"))
    return K.long(E.word_occurrences(words, values).select("doc_id", "value", "start", F.array_join("words", ",").alias("words")))


STAGES = {
    "stage": f"CASE WHEN {KEY} % 2 = 0 THEN 'text' ELSE 'file' END", "language": LANGUAGE, "format": M.FIELDS["format"], "entity_type": f"CASE WHEN {KEY} % 7 < 3 THEN 'PERSON' ELSE 'EMAIL' END", "location": f"CASE WHEN {KEY} % 8 = 0 THEN 'metadata' ELSE 'body' END",
    "extracted": f"{KEY} % 9 > 0", "extraction_incomplete": f"{KEY} % 9 = 1", "whole": f"{KEY} % 3 = 0", "partial": f"{KEY} % 3 = 1", "whole_occurrences": f"CAST({KEY} % 3 AS BIGINT)", "partial_occurrences": f"CAST({KEY} % 2 AS BIGINT)",
    "missed_occurrences": f"CAST({KEY} % 4 AS BIGINT)", "missing_occurrences_minimum": f"CAST({KEY} % 5 AS BIGINT)",
}
STAGE_KEYS = ("stage", "language", "format", "entity_type", "location")
STAGE_SETS = [("stage",), ("stage", "language"), ("stage", "format"), ("stage", "entity_type"), ("stage", "location")]


@query(f"""SELECT *, whole_occurrences + partial_occurrences + missed_occurrences AS occurrences, labels - whole - partial AS missed, whole / CAST(labels AS DOUBLE) AS whole_recall FROM (
{_sets(STAGE_KEYS, STAGE_SETS, 'count(*) AS labels, ' + ', '.join(_count(c, c) for c in ('extracted', 'extraction_incomplete', 'whole', 'partial')) + ', ' + _sum('whole_occurrences', 'partial_occurrences', 'missed_occurrences', 'missing_occurrences_minimum'), _made(**STAGES))})""")
def stage_summary(spark, sf_dir):
    return E.stage_summary(_orders(spark, sf_dir, **STAGES), [list(s) for s in STAGE_SETS])


CASES = {"case_id": f"CAST({KEY} AS BIGINT)", "language": LANGUAGE, "category": "o_orderpriority", "\"start\"": "0", "\"end\"": "4", "entity_type": f"CASE WHEN {KEY} % 4 = 0 THEN 'AGE' ELSE 'PERSON' END", "expect": f"CASE WHEN {KEY} % 2 = 0 THEN 'preserve_detection' ELSE 'discard_detection' END"}
KEPT, OLD, NEW = "case_id % 2 = 0", "case_id % 3 > 0", "case_id % 5 > 0"


@query(_sets(("language", "category"), [("language", "category"), ("language",), ("category",), ()], ", ".join([
    _count("preserve_total", KEPT), _count("discard_total", f"NOT {KEPT}"), _count("baseline_preserve_retained", f"{KEPT} AND {OLD}"), _count("baseline_discard_dropped", f"NOT {KEPT} AND NOT {OLD}"),
    _count("current_preserve_retained", f"{KEPT} AND {NEW}"), _count("current_discard_dropped", f"NOT {KEPT} AND NOT {NEW}"), _count("new_sensitive_losses", f"{KEPT} AND {OLD} AND NOT {NEW}"), _count("recovered_sensitive_candidates", f"{KEPT} AND NOT {OLD} AND {NEW}"),
]), _made(**CASES)))
def policy_comparison(spark, sf_dir):
    cases = _orders(spark, sf_dir, **{n.strip('"'): e for n, e in CASES.items()})
    key = ["case_id", "start", "end", "entity_type"]
    renamed = cases.filter(OLD).select(*key).withColumn("entity_type", E.candidate_type(F.col("entity_type")))
    return E.policy_comparison(cases, renamed.unionByName(renamed), cases.filter(NEW).select(*key))


CONTEXT = {"split": M.FIELDS["split"], "category": f"CASE WHEN {KEY} % 5 = 0 THEN 'STANDARD' ELSE o_orderpriority END", "state": f"CASE {KEY} % 3 WHEN 0 THEN 'covered' WHEN 1 THEN 'partial' ELSE '' END"}


@query(f"""WITH l AS ({_made(**CONTEXT)}), s AS (SELECT * FROM l UNION ALL SELECT 'all', category, state FROM l), c AS (SELECT * FROM s UNION ALL SELECT split, 'contextual', state FROM s WHERE category <> 'STANDARD')
SELECT split, category, count(*) AS planted, {_count('covered', "state = 'covered'")}, {_count('partial', "state = 'partial'")} FROM c GROUP BY 1, 2""")
def context_scores(spark, sf_dir):
    return E.context_scores(_orders(spark, sf_dir, **CONTEXT))


STATUSES = {"format": M.FIELDS["format"], "language": LANGUAGE, "type": "o_orderpriority", "status": f"CASE WHEN {KEY} % 4 = 0 OR {KEY} % 6 = 1 THEN 'NOT_EXTRACTED' WHEN {KEY} % 5 = 0 THEN 'MISSED' ELSE 'CHANGED_REVIEW' END"}


@query(f"""SELECT *, CASE WHEN total > not_extracted THEN round(changed_review / CAST(total - not_extracted AS DOUBLE) * 100, 2) ELSE 0 END AS changed_rate_percent FROM (
{_sets(('format', 'language', 'type'), [('format',), ('language',), ('type',), ('format', 'language')], 'count(*) AS total, ' + ', '.join(_count(s.lower(), f"status = '{s}'") for s in ('NOT_EXTRACTED', 'MISSED', 'CHANGED_REVIEW')), _made(**STATUSES))})""")
def status_summary(spark, sf_dir):
    return E.status_summary(_orders(spark, sf_dir, **STATUSES), [["format"], ["language"], ["type"], ["format", "language"]])


TOOLS = {"format": M.FIELDS["format"], "language": LANGUAGE, "type": "o_orderpriority", "state": f"CASE {KEY} % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'missed' END"}


@query(_sets(("format", "language", "type"), [(), ("format",), ("language",), ("type",)], "count(*) AS planted, " + ", ".join(_count(s, f"state = '{s}'") for s in ("full", "partial", "missed")).replace('AS full', 'AS "full"'), _made(**TOOLS)))
def tool_counters(spark, sf_dir):
    return E.tool_counters(_orders(spark, sf_dir, **TOOLS))


MASKING = {"language": LANGUAGE, "outside": f"CAST({KEY} % 17 AS BIGINT)", "characters": f"CAST(100 + {KEY} % 50 AS BIGINT)", "orphans": f"CAST({KEY} % 2 AS BIGINT)"}


@query(f"SELECT *, outside / CAST(characters AS DOUBLE) AS share FROM ({_sets(('language',), [('language',), ()], _sum('outside', 'characters', 'orphans'), _made(**MASKING))})")
def masking_summary(spark, sf_dir):
    return E.masking_summary(_orders(spark, sf_dir, **MASKING))


ANSWERS = {"model": M.FIELDS["language"], "error_type": f"CASE WHEN {KEY} % 6 = 0 THEN 'TimeoutError' END", "provider_valid": f"{KEY} % 4 > 0"}


@query(f"SELECT model, count(*) AS answers, count(error_type) AS errors, {_count('valid', 'error_type IS NULL AND provider_valid')} FROM ({_made(**ANSWERS)}) GROUP BY 1")
def answer_validity(spark, sf_dir):
    return E.answer_validity(_orders(spark, sf_dir, **ANSWERS), "model")


@query("SELECT CAST(size AS BIGINT) AS size, language, CAST(scale AS BIGINT) AS scale FROM unnest([8, 10, 12]) AS a(size), unnest(['en', 'fi']) AS b(language), unnest([1, 2, 3]) AS c(scale)")
def smoke_matrix(spark, sf_dir):
    return K.long(E.smoke_matrix(spark, [8, 10, 12], ["en", "fi"], [1, 2, 3]))


@query("SELECT CAST(doc_id AS STRING) AS path, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def unchanged_documents(spark, sf_dir):
    files = K.documents(spark, sf_dir).filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return E.unchanged(files, files.select("path", F.sha2("content", 256).alias("sha256")))


@query(f"WITH {M.MEMO_SQL} SELECT * FROM ({A.spans('memo', A.PROJECT)}) WHERE entity_type IN ('PERSONAL_ID', 'PLATE', 'INVOICE')")
def cached_spans(spark, sf_dir):
    memo = M.memos(spark, sf_dir).select("doc_id", "text", "language")
    cache = E.span_cache(memo, D.pattern_spans(memo.drop("language")), "rules", "c", "s")
    return K.long(E.in_profile(E.cached_spans(memo, cache, "rules", "c", "s"), "identifiers"))


@query("""SELECT CAST(p_partkey AS BIGINT) AS id, '{"a":[true,null,"å"],"b":{"x":"' || p_name || '","y":' || CAST(p_partkey AS STRING) || '}}' AS canonical, sha256('["' || p_name || '",' || CASE WHEN p_partkey % 2 = 0 THEN 'null' ELSE '""' END || ',"' || CAST(p_partkey AS STRING) || '"]') AS signature FROM part""")
def canonical_records(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    record = F.concat(F.lit('{ "b": {"y" : '), k.cast("string"), F.lit(', "x": "'), "p_name", F.lit('"},\n "a": [true, null, "\\u00e5"] }'))
    made = T.signature(F.col("p_name"), F.when(k % 2 == 0, None).otherwise(""), k)
    return K.read(spark, sf_dir, "part").select(k.alias("id"), T.canonical_json(record).alias("canonical"), made.alias("signature"))


@query(r"""SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 5 WHEN 0 THEN p_name || '/a\|b/`c|d`/' WHEN 1 THEN p_name || '/x' WHEN 2 THEN NULL WHEN 3 THEN '/' || p_name || '/`|open' ELSE NULL END AS cells FROM part""")
def table_cells(spark, sf_dir):
    k, n = F.col("p_partkey").cast("long") % 5, F.col("p_name")
    line = (
        F.when(k == 0, F.concat(F.lit(" | "), n, F.lit(r" | a\|b | `c|d` | |  "))).when(k == 1, F.concat(n, F.lit("\t|  x"))).when(k == 2, F.concat(n, F.lit(r" \| `|`")))
        .when(k == 3, F.concat(F.lit("||"), n, F.lit("|`|open"))).otherwise(F.lit(" | "))
    )
    rows = K.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), line.alias("line"))
    text = F.transform(T.table_cells(F.col("line")), lambda c: F.col("line").substr(c["start"] + 1, c["end"] - c["start"]))
    return rows.select("id", F.array_join(text, "/").alias("cells"))
