"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabularies are; every operator that needs one takes the path as a parameter.
TOKENIZERS = "/opt/tokenizers"

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: The ASCII letters of words are lower-cased, others stay.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where the session names none, a local master has a temporary one; a cluster is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="kairoframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_dir(spark: SparkSession) -> str:
    """This application's own folder for tables that cut lineage."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes this application's stored tables; to be called once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def whole(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def partitions(spark: SparkSession, chars: int, each: int) -> int:
    """How many partitions hold `each` characters; never fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(chars) // each), 1)


def bits_for(count: int, most: int = 1 << 26) -> int:
    """Bits of a filter for so many ids: 16 for each, at most `most` (8 MB)."""
    bits = 1 << 15
    while bits < most and bits < 16 * count:
        bits *= 2
    return bits


def in_filter(ids: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows with a column maybe: false only where the key is none of ids (a column of that name).

    The filter is a bitmap of fixed size, so it can be broadcast whatever the number of ids; what it lets pass by
    chance is left to an exact join afterwards, which then moves few of the rows.
    """
    bits = bits_for(ids.count())
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(bits)) + 1
    maps = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_map"))
    place = F.bitmap_bit_position(at)
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(at)).withColumn("_place", place)
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.expr("getbit(_byte, cast(_place % 8 as int)) = 1")
    joined = placed.join(F.broadcast(maps), "_bucket", "left").withColumn("_byte", byte)
    return joined.withColumn("maybe", F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).drop("_bucket", "_place", "_map", "_byte")
