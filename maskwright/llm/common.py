"""What the operators of this folder share: tables, names and written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add.

    Rule for clashing names everywhere in this folder: an operator's result
    column replaces an input column of that name (case-insensitively).
    """
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.drop(*clash) if clash else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and
    Spark runs in one JVM (tests) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="maskwright-"))
    return sc.getCheckpointDir().rstrip("/")


_scopes: list[list[DataFrame]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/maskwright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._maskwright_path = path
    for scope in _scopes:
        scope.append(back)
    return back


def sorted_run(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` as a written table that is bucketed and sorted by ``column``, in as many buckets as a shuffle has partitions: joins and aggregations by it need no exchange."""
    spark = df.sparkSession
    name = f"maskwright_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/maskwright/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, column).sortBy(column).option("compression", "zstd").option("path", path).saveAsTable(name)
    back = spark.table(name)
    back._maskwright_path, back._maskwright_table = path, name
    for scope in _scopes:
        scope.append(back)
    return back


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns as a written table; every other table that was written on the way is deleted.

    Operators return plans that may still read the tables they wrote. Where the
    result is wanted once and whole, this leaves the result alone behind.
    """
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        out = written(build(), name)
    finally:
        _scopes.pop()
    for df in made:
        if df is not out:
            discard(df)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` or ``sorted_run`` that no later plan reads."""
    path, name = getattr(df, "_maskwright_path", None), getattr(df, "_maskwright_table", None)
    if name:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Bits of the filter of ``perhaps_in``: 4 MB, however many keys there are.
FILTER_BITS = 1 << 25


def perhaps_in(df: DataFrame, keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``df`` with the boolean ``name``, which is false only where no row of ``keys`` has the row's values of ``columns``.

    One hash of each key is a bit of a broadcast bitmap of fixed size. It spares
    rows a join that they cannot match; with very many keys it spares fewer.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    bits = keys.select(place.alias("_place")).groupBy(F.bitmap_bucket_number("_place").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.col("_bits").substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket", "left")
    return met.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


LEAST_LONG = -(2**63)


def ordered_key(number: Column, digest: Column) -> Column:
    """16 bytes that sort as ``number`` (a long) does and tell rows of one number apart by a 64-bit ``digest``."""
    eight = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    return F.concat(eight(number.bitwiseXOR(F.lit(LEAST_LONG))), eight(digest))


def number_of(key: Column) -> Column:
    """The number in an ``ordered_key``."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(LEAST_LONG))


def chunks(sizes: list[int], most: int):
    """Ranges ``(start, end)`` of consecutive rows whose sizes add up to ``most`` or are one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
