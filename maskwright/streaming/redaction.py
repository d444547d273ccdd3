"""Detection and redaction over a stream of documents: document scope needs no state, so rows are handled one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detect as D


def redact_stream(docs: DataFrame, patterns=D.PROJECT, text_col: str = "text") -> DataFrame:
    """``docs`` (streaming or not) with ``[TYPE]`` for every match; where matches overlap the earlier, then the longer one counts.

    Everything happens inside a row: no aggregation, no watermark, no state.
    """
    t = F.col(text_col)
    found = F.transform(F.array_sort(F.concat(*(_typed(t, p, k) for p, k, _ in patterns))), lambda x: F.struct(x["start"].alias("start"), (-x["e"]).alias("end"), x["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    state = F.struct(F.lit(0).alias("p"), none.alias("r"))

    def step(a, x):
        return F.when(x["start"] < a["p"], a).otherwise(F.struct(x["end"].alias("p"), F.concat(a["r"], F.array(x)).alias("r")))

    def disjoint(r):
        clash = F.exists(F.transform(r, lambda x, i: (i > 0) & (x["start"] < r[F.greatest(i - 1, F.lit(0))]["end"])), lambda x: x)
        return F.when(clash, F.aggregate(r, state, step, lambda a: a["r"])).otherwise(r)

    done = T.replaced(t, T.let(found, disjoint), lambda _, r: F.concat(F.lit("["), r["kind"], F.lit("]")))
    return docs.withColumn(text_col, F.when(t.isNotNull(), done))


def _typed(text, pattern: str, kind: str):
    return F.transform(D.match_array(text, pattern), lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("e"), F.lit(kind).alias("kind")))
