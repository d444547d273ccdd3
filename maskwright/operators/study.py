"""Study and usefulness: document pairs, request plans, recorded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import row_numbers
from .score import answer_state

VARIANTS = ("raw", "redacted", "pseudonymized")


def document_pairs(suite: DataFrame) -> DataFrame:
    """suite(id, subject): every pair of its documents with whether the subject is the same. A suite is a stated, small set."""
    a, b = suite.select(F.col("id").alias("first_id"), F.col("subject").alias("_a")), suite.select(F.col("id").alias("second_id"), F.col("subject").alias("_b"))
    return a.join(b, F.col("first_id") < F.col("second_id")).select("first_id", "second_id", (F.col("_a") == F.col("_b")).alias("same_subject"))


def first_unrelated(suite: DataFrame) -> DataFrame:
    """For each document the first one of another subject, from the first document of each of the two first subjects."""
    firsts = suite.groupBy("subject").agg(F.min("id").alias("first"))
    two = firsts.agg(F.slice(F.array_sort(F.collect_list(F.struct("first", "subject"))), 1, 2).alias("two"))
    met = suite.join(F.broadcast(two))
    other = F.filter("two", lambda x: x["subject"] != F.col("subject"))
    return met.select("id", F.when(F.size(other) > 0, F.element_at(other, 1)["first"]).alias("unrelated_id"))


def number_requests(requests: DataFrame, order: list[str]) -> DataFrame:
    """Requests with sequential ids request-00001 and on."""
    return row_numbers(requests, order, "_n").withColumn("request_id", F.concat(F.lit("request-"), F.lpad(F.col("_n").cast("string"), 5, "0"))).drop("_n")


def plan(documents: DataFrame, questions: DataFrame, variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """One request for each variant of each question of a document."""
    each = questions.join(documents, "document_id").withColumn("variant", F.explode(F.array(*map(F.lit, variants))))
    return number_requests(each, ["document_id", "question_id", "variant"])


def require_plan(requests: DataFrame, variants: tuple[str, ...] = VARIANTS) -> DataFrame:
    """The requests; fails unless each question has exactly one of each variant with equal truth and wording."""
    by = requests.groupBy("document_id", "question_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("variant")).alias("v"), F.countDistinct(F.to_json("ground_truth")).alias("truths"), F.countDistinct("question").alias("wordings")
    )
    fine = (F.col("n") == len(variants)) & (F.col("v") == F.array(*map(F.lit, sorted(variants)))) & (F.col("truths") == 1) & (F.col("wordings") == 1)
    checked = by.filter(F.assert_true(fine, "a question lacks a variant, or its variants differ").isNull())
    return requests.join(checked.select("document_id", "question_id"), ["document_id", "question_id"], "left_semi")


def score_recorded(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests with their recorded answer's score; an unknown or repeated answer, or a second model, fails the query."""
    per = answers.groupBy("request_id").agg(F.count("*").alias("_n"), F.first("answer").alias("answer"), F.first("refused").alias("refused"))
    known = per.join(requests.select("request_id", F.lit(True).alias("_known")), "request_id", "left")
    good = known.filter(F.assert_true((F.col("_n") == 1) & F.col("_known").isNotNull(), "an answer is unknown or repeated").isNull())
    models = answers.agg(F.countDistinct("model").alias("_m")).filter(F.assert_true(F.col("_m") <= 1, "answers of more than one model").isNull())
    met = requests.join(good.select("request_id", "answer", "refused", F.lit(True).alias("_got")), "request_id", "left").join(F.broadcast(models)).drop("_m")
    return met.withColumn("score", F.when(F.col("_got").isNull(), "unanswered").otherwise(answer_state(F.col("answer"), F.col("refused"), F.col("ground_truth")))).drop("_got")


def truth_values(labels: DataFrame) -> DataFrame:
    """(doc_id, type, truth): sorted distinct body values joined by '; '."""
    return labels.filter("location = 'body'").groupBy("doc_id", "type").agg(F.array_join(F.array_sort(F.collect_set("value")), "; ").alias("truth"))


def answer_template(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("web_search", F.explode(F.array(F.lit("no"), F.lit("yes"))))


def nth_of_group(documents: DataFrame, n: int, *groups: str) -> DataFrame:
    """The n-th document, from 0, of each group in the order of doc_id."""
    from pyspark.sql import Window

    w = Window.partitionBy(*groups).orderBy("doc_id")
    return documents.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == n + 1).drop("_r")


def prompts(documents: DataFrame, instruction: str, pair_with: str | None = None) -> DataFrame:
    """A prompt for one text, or for two texts that may share a subject."""
    body = F.concat(F.lit(instruction + "\n\n"), F.col("text"))
    return documents.withColumn("prompt", F.concat(body, F.lit("\n\n---\n\n"), F.col(pair_with)) if pair_with else body)
