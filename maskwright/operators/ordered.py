"""Global order without a single task: row numbers, running sums and digests over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows up to and including each, in ``order``.

    Rows are dealt by ranges of the order; only one total a range is summed in
    one place, and each row adds the totals of the ranges before its own.
    """
    dealt = df.withColumn("_a", amount).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).persist()
    totals = dealt.groupBy("_p").agg(F.sum("_a").alias("_t"))
    before = totals.withColumn("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    local = F.sum("_a").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_l", local).join(F.broadcast(before), "_p").withColumn(name, F.col("_l") + F.col("_b")).drop("_p", "_a", "_l", "_b")


def row_numbers(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    return running_total(df, order, F.lit(1).cast("long"), name)


def every_nth(df: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first row and every n-th after it."""
    return row_numbers(df, order, "_n").filter((F.col("_n") - 1) % n == 0).drop("_n")


def budget(df: DataFrame, order: list[str], amount: Column, most: int) -> DataFrame:
    """Rows from the start until the budget is reached; the row that crosses it is in."""
    return running_total(df.withColumn("_own", amount), order, F.col("_own"), "_s").filter(F.col("_s") - F.col("_own") < most).drop("_s", "_own")


def hash_sample(df: DataFrame, key: str, per_group: int, *groups: str) -> DataFrame:
    """A repeatable sample of ``per_group`` rows a group: those of the least key hashes."""
    w = Window.partitionBy(*groups).orderBy(F.xxhash64(key), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_group).drop("_r")


def fingerprint(docs: DataFrame, order: str, *columns: str, fanout: int = 1000, levels: int = 3) -> DataFrame:
    """One row: a digest tree over the columns in the order of a key, rows of one key in the order of their digests.

    The tree is built on row numbers, so a node has ``fanout`` children at most
    whatever the keys; the root has as many as the rows have full trees.
    """
    digest = F.sha2(F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    numbered = row_numbers(docs.select(F.col(order).alias("_o"), digest.alias("_d")), ["_o", "_d"], "_n")
    at = numbered.select((F.col("_n") - 1).alias("_k"), "_d")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_d"))), lambda x: x["_d"]), "")
    for _ in range(levels):
        at = at.groupBy(F.expr(f"_k div {int(fanout)}").alias("_g")).agg(F.sha2(joined, 256).alias("_d")).withColumnRenamed("_g", "_k")
    return at.agg(F.sha2(joined, 256).alias("fingerprint"))
