"""Named queries over the test tables, one or more for each family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detect as D
from ..operators import ordered as O
from ..operators import redact as R
from ..operators import report as G
from ..operators import score as Q
from ..operators import sections as X
from ..operators import spans as S
from ..operators import study as U
from . import memos as M

METHODS = ["basic", "rules", "rules-business"]
#: A detector of overlapping ranges, to have something to resolve.
WIDE = [(r"of \d{4}-\d{2}", "ORGANIZATION", 0.6), (r"\d{3}, driver \d+", "LOCATION", 0.9), (r"INV-\d{5} of \d{4}-\d{2}-\d{2}", "PERSON", 0.95), (r"Mail [a-z.]+", "PERSON", 0.3)]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return M.spread(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def long(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


def mixed(memo: DataFrame) -> DataFrame:
    return D.pattern_spans(memo, (*D.PROJECT, *WIDE, D.DATE))


def method_spans(memo: DataFrame) -> DataFrame:
    return D.run_methods(memo, METHODS)


def typed(spark, sf_dir) -> DataFrame:
    memo = M.memos(spark, sf_dir)
    return Q.value_states(M.places(memo), None, method_spans(memo), methods=METHODS)


def counts(states: DataFrame, *keys: str) -> DataFrame:
    return G.with_recall(G.tally(states, *keys))


@query
def entity_counts(spark, sf_dir):
    # the language travels with the id, so the texts are read once
    docs = documents(spark, sf_dir).select(F.struct("doc_id", "lang").alias("doc_id"), "text")
    found = D.pattern_spans(docs, (D.EMAIL, D.IPV4, D.CARD)).select("doc_id.*", "entity_type")
    return found.groupBy("lang", "entity_type").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("documents"))


def _pii(pattern):
    return lambda spark, sf_dir: long(D.pattern_spans(documents(spark, sf_dir), [pattern], keep_value=True))


QUERIES |= {"pii_spans_email": _pii(D.EMAIL), "pii_spans_ipv4": _pii(D.IPV4), "pii_spans_card": _pii(D.CARD)}


@query
def invoice_plate_id_spans(spark, sf_dir):
    return long(D.pattern_spans(M.memos(spark, sf_dir)))


@query
def business_vat_spans(spark, sf_dir):
    return long(D.business_spans(M.memos(spark, sf_dir)))


@query
def glossary_spans(spark, sf_dir):
    return long(D.glossary_spans(M.memos(spark, sf_dir), M.GLOSSARY))


@query
def resolved_spans(spark, sf_dir):
    return long(S.resolve(mixed(M.memos(spark, sf_dir))))


@query
def merged_touching(spark, sf_dir):
    return long(S.merge_touching(mixed(M.memos(spark, sf_dir))))


@query
def routed_spans(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    return long(S.route(mixed(memo), D.pattern_spans(memo, WIDE)))


@query
def dedup_max_score(spark, sf_dir):
    return long(S.dedup_max_score(method_spans(M.memos(spark, sf_dir)).drop("method")))


@query
def redacted_text(spark, sf_dir):
    memo = M.memos(spark, sf_dir).select("doc_id", "text")
    return R.redact(memo, mixed(memo)).select("doc_id", F.md5("text").alias("text_md5"))


@query
def pseudonymised_text(spark, sf_dir):
    memo = M.memos(spark, sf_dir).select("doc_id", "text")
    return R.pseudonymise(memo, mixed(memo)).select("doc_id", F.md5("text").alias("text_md5"))


@query
def alias_table_corpus_scope(spark, sf_dir):
    memo = M.memos(spark, sf_dir).select("doc_id", "text")
    resolved = S.resolve(mixed(memo)).join(memo.hint("merge"), "doc_id")
    valued = resolved.withColumn("value", F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")
    return R.alias_table(valued).select("entity_type", F.sha2("value", 256).alias("value_sha256"), "n")


@query
def masked_text(spark, sf_dir):
    memo = M.memos(spark, sf_dir).select("doc_id", "text")
    return D.mask_spans(memo, D.pattern_spans(memo)).select("doc_id", F.md5("text").alias("text_md5"))


@query
def typed_recall(spark, sf_dir):
    return counts(typed(spark, sf_dir), "method", "type", "language", "location", "format")


@query
def any_type_recall(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    return counts(Q.union_states(M.places(memo), None, method_spans(memo), METHODS), "method", "type", "language")


@query
def recall_cube(spark, sf_dir):
    return G.recall_cube(typed(spark, sf_dir), "method", "language")


@query
def recall_by_split_rollup(spark, sf_dir):
    return G.recall_rollup(typed(spark, sf_dir), "split", "type")


@query
def recall_grouping_sets(spark, sf_dir):
    measures = [F.count("*").alias("planted"), F.count_if(F.col("state") == "covered").alias("covered"), F.count_if(F.col("state") == "partial").alias("partial")]
    return G.grouping_sets(typed(spark, sf_dir), [["language"], ["format"], ["location"], ["language", "format"]], measures)


@query
def best_method(spark, sf_dir):
    tallied = G.tally(typed(spark, sf_dir), "language", "method").withColumnRenamed("language", "dataset")
    return G.best_method(tallied).withColumn("score", F.round("score", 9))


@query
def method_pivot(spark, sf_dir):
    return G.summary_pivot(G.tally(typed(spark, sf_dir).withColumnRenamed("type", "entity_type"), "entity_type", "method"), "entity_type", METHODS)


@query
def missed_values(spark, sf_dir):
    out = G.misses(typed(spark, sf_dir).filter("method = 'rules'"))
    return out.select("type", "found", "total", F.size("missed").cast("long").alias("missed_values"))


@query
def mention_recall(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    mentions = M.places(memo).select("doc_id", "label_id", "type", "start", "end")
    states = Q.mention_states(mentions, method_spans(memo), methods=METHODS)
    return G.tally(states, "method", "type").withColumnRenamed("planted", "mentions")


@query
def typed_precision(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    return G.precision(Q.judge(method_spans(memo), M.places(memo), None), "method", "entity_type")


@query
def unlabelled_detections(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    return S.unlabelled(method_spans(memo), M.places(memo)).groupBy("method", "entity_type").agg(F.count("*").alias("unlabelled"))


@query
def over_masking(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    per = S.outside(method_spans(memo), M.places(memo).filter("start IS NOT NULL"), orphans=False)
    return per.groupBy("method").agg(F.sum("masked_chars").alias("masked_chars"), F.sum("outside_chars").alias("outside_chars"))


@query
def hidden_characters(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    items = M.places(memo).filter("start IS NOT NULL").select("doc_id", "label_id", "type", "start", "end")
    got = Q.hidden_items(items, D.get_method("rules").run(memo))
    return got.groupBy("type").agg(F.count("*").alias("items"), F.count_if("hidden").alias("hidden"), F.count_if("touched").alias("touched"), F.sum("covered_chars").alias("covered_chars"))


@query
def results_upsert(spark, sf_dir):
    old = G.tally(typed(spark, sf_dir), "method", "language")
    new = old.filter("method = 'rules'").withColumn("covered", F.col("planted")).withColumn("partial", F.lit(0).cast("long"))
    return G.matrix_upsert(old, new, ["method"])


@query
def section_locations(spark, sf_dir):
    return long(X.locations(M.memos(spark, sf_dir)))


@query
def located_recall(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    states = Q.located_states(M.places(memo).withColumn("expected", F.lit(1)), None, X.locations(memo), D.get_method("rules").run(memo))
    return states.groupBy("location", "type").agg(F.count("*").alias("labels"), F.count_if("whole").alias("whole"), F.count_if("partial").alias("partial"), F.sum("missing").alias("missing"))


@query
def extraction_recall(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    parts = X.text_by_location(memo, X.locations(memo)).withColumnRenamed("text", "part")
    returned = M.labels(memo).join(parts.hint("merge"), ["doc_id", "location"], "left").withColumn("returned", F.coalesce(F.contains("part", "value"), F.lit(False)))
    return G.extraction(returned, "format", "location")


@query
def text_tristate(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    after = R.redact(memo.select("doc_id", "text"), D.pattern_spans(memo, [D.INVOICE])).withColumnRenamed("text", "after")
    met = M.labels(memo).join(memo.select("doc_id", "text").join(after.hint("merge"), "doc_id").hint("merge"), "doc_id")
    return met.groupBy("type", Q.tristate(F.col("text"), F.col("after"), F.col("value")).alias("status")).agg(F.count("*").alias("labels"))


@query
def paired_retention(spark, sf_dir):
    rows = M.labels(M.memos(spark, sf_dir))
    k, soft = F.col("doc_id"), F.col("type").isin("INVOICE", "PLATE")
    raw = F.when(k % 13 == 0, "wrong").otherwise("correct")
    redacted = F.when(k % 17 == 0, None).when(soft & (k % 3 > 0), "refused").otherwise("correct")
    pseudo = F.when((F.col("type") == "INVOICE") & (k % 3 > 1), "wrong").otherwise("correct")
    scored = rows.select(k.alias("document_id"), F.col("label_id").alias("question_id"), F.explode(F.create_map(F.lit("raw"), raw, F.lit("redacted"), redacted, F.lit("pseudonymized"), pseudo)).alias("variant", "score"))
    return G.paired_retention(scored)


@query
def document_pairs_linkage(spark, sf_dir):
    from ..operators.study import document_pairs

    suite = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("subject"))
    return document_pairs(suite)


@query
def first_unrelated(spark, sf_dir):
    from ..operators.study import first_unrelated as operator

    return operator(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("subject")))


@query
def rows_to_markdown(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), "n_name").alias("r")).alias("x"))
    table = F.concat(F.array(F.array(F.lit("n_nationkey"), F.lit("n_name"))), F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]))
    return rows.agg(table.alias("t")).select(T.rows_to_markdown(F.col("t")).alias("markdown"))


@query
def normalized_markdown(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(T.normalize_markdown(F.col("text"))).alias("text_md5"))


@query
def char_windows(spark, sf_dir):
    parts = documents(spark, sf_dir).select("doc_id", F.explode(T.pieces(F.col("text"), 4000, 400)).alias("w"))
    return parts.select("doc_id", F.col("w.offset").cast("long").alias("offset"), F.md5("w.piece").alias("piece_md5"))


@query
def every_third_sample(spark, sf_dir):
    return O.every_nth(documents(spark, sf_dir).select("doc_id"), ["doc_id"], 3)


@query
def sentence_budget(spark, sf_dir):
    sized = documents(spark, sf_dir).select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("."), F.lit("")))).cast("long").alias("k"))
    return O.budget(sized, ["doc_id"], F.col("k"), 5000).select("doc_id")


@query
def ocr_cer(spark, sf_dir):
    read_back = F.replace(F.expr("substring(p_name, 2)"), F.lit("e"), F.lit("c"))
    rows = read(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("reference"), read_back.alias("text"), F.array("p_name").alias("values"), F.lit(0.0).alias("seconds"), F.lit(None).cast("string").alias("error"))
    return G.ocr_summary(rows, "p_brand").select("p_brand", "documents", "edits", "characters", "cer")


def _words(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("idx", "text"))
    return rows.withColumn("line", F.struct(F.lit(0).alias("block"), F.lit(0).alias("par"), F.floor(F.col("idx") / 2).alias("line")))


@query
def word_layout(spark, sf_dir):
    return long(R.layout(_words(spark, sf_dir)).drop("line"))


@query
def expand_lines(spark, sf_dir):
    words = _words(spark, sf_dir)
    return long(R.expand_to_lines(words, words.filter(F.contains("text", F.lit("e")))).select("doc_id", "idx", "text"))


@query
def context_confusion(spark, sf_dir):
    k = F.col("o_orderkey")
    cases = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.when(k % 2 == 0, "preserve_detection").otherwise("discard_detection").alias("expect"), (k % 3 > 0).alias("retained"))
    return G.confusion(cases, "category")


@query
def merged_display(spark, sf_dir):
    return long(S.merge_display(mixed(M.memos(spark, sf_dir))))


@query
def pii_valid_cards(spark, sf_dir):
    return long(D.valid_cards(D.pattern_spans(documents(spark, sf_dir), [D.CARD], keep_value=True)))


@query
def detection_counts(spark, sf_dir):
    return G.detection_counts(D.get_method("rules").run(M.memos(spark, sf_dir)))


def by_type(spark, sf_dir, *keys: str, method: str | None = None) -> DataFrame:
    states = typed(spark, sf_dir).withColumnRenamed("type", "entity_type")
    return G.tally(states.filter(F.col("method") == method) if method else states, "entity_type", *keys)


@query
def type_breakdown(spark, sf_dir):
    return G.type_breakdown(by_type(spark, sf_dir, "method"))


@query
def worst_types(spark, sf_dir):
    return G.worst_first(by_type(spark, sf_dir, method="rules"))


@query
def headline(spark, sf_dir):
    return G.headline(typed(spark, sf_dir).filter("method = 'rules'"))


@query
def recall_table(spark, sf_dir):
    return G.recall_table(G.tally(typed(spark, sf_dir), "language", "method").withColumnRenamed("language", "dataset"))


@query
def recall_gate(spark, sf_dir):
    return G.gate(counts(typed(spark, sf_dir), "method", "language"), 0.5, method=["rules"], language=["en", "fi"])


@query
def regression_gate(spark, sf_dir):
    found = by_type(spark, sf_dir, "method")
    return G.regression_gate(found.filter("method = 'rules'"), found.filter("method = 'basic'"), ["entity_type"], ["covered"])


@query
def policy_changes(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    changed = G.policy_changes(mixed(memo), D.get_method("rules").run(memo), ["doc_id", "start", "end", "entity_type"])
    return changed.groupBy("change", "entity_type").agg(F.count("*").alias("spans"))


@query
def missing_required(spark, sf_dir):
    return G.missing_required(X.locations(M.memos(spark, sf_dir)), "location", ["body", "comment", "footer", "metadata"])


@query
def type_colours(spark, sf_dir):
    return long(G.type_colours(mixed(M.memos(spark, sf_dir))))


@query
def truth_values(spark, sf_dir):
    return U.truth_values(M.labels(M.memos(spark, sf_dir)))


@query
def study_plan(spark, sf_dir):
    papers = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("document_id"), F.col("r_name").alias("title"))
    asked = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("document_id"), F.col("n_nationkey").cast("long").alias("question_id"))
    return U.plan(papers, asked).select("document_id", "question_id", "variant", "request_id", "title")


@query
def nth_of_group(spark, sf_dir):
    return U.nth_of_group(M.memos(spark, sf_dir).select("doc_id", "language", "format"), 2, "language", "format")


@query
def folded_names(spark, sf_dir):
    name = F.concat_ws("  /  ", "p_name", "p_type")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), name.alias("v"))
    return rows.select("id", T.safe_name(F.col("v")).alias("safe"), T.collapse_fold(F.col("v")).alias("folded"), T.strip_all_fold(F.col("v")).alias("stripped"), F.sha2("v", 256).alias("key"))


@query
def truncated_text(spark, sf_dir):
    return M.memos(spark, sf_dir).select("doc_id", F.md5(T.truncate_at_line(F.col("text"), 150, " (cut)")).alias("text_md5"))


@query
def clause_bounds(spark, sf_dir):
    memo = M.memos(spark, sf_dir)
    found = D.pattern_spans(memo, [D.DATE, D.INVOICE]).join(memo.select("doc_id", "text").hint("merge"), "doc_id")
    return long(found.select("doc_id", "start", "end", T.clause(F.col("text"), F.col("start"), F.col("end")).alias("c")).select("doc_id", "start", "end", "c.left", "c.right"))


@query
def distinct_lines(spark, sf_dir):
    return M.memos(spark, sf_dir).select("doc_id", F.md5(F.array_join(T.distinct_lines(F.concat_ws(chr(10), "text", "text")), chr(10))).alias("text_md5"))


@query
def context_filter(spark, sf_dir):
    from ..operators.context import filter_context

    docs, spans = M.context_cases(spark, sf_dir)
    return long(filter_context(docs, spans))
