"""Two-pass external shuffle of records into shards, in DataFrame functions only.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash; Spark's exchange is the
external store.  Pass two gathers each bucket, which is bounded, Fisher-Yates-shuffles it (``shuffle`` is the
JVM's inside-out Fisher-Yates) and writes it to the shared folder.  The buckets' lengths then give each record
its place in one global random order, and dealing that order out in turn makes shards whose counts differ by
at most one.

A record's place follows from its content alone, so a retried task, other file splits or another order of the input
give the same shards.  Rows that are equal in all columns fall into one bucket, where their order tells nothing; of
more than ``REPEATS`` such rows, counted by their hashes beforehand, each is salted by its place in the input.

Defined cases: null text counts as empty; null ids and ties are like any others; an empty table gives an empty result;
extra columns (but no maps, which have no hash) are carried whole inside one struct, so their names cannot clash.  The
buckets' table stays in the shared folder for as long as the result is read; ``common.forget`` deletes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_or_empty, utf8_size

#: Bytes of text that one bucket holds on average; a task holds one bucket at a time.
BUCKET_BYTES = 16 << 20
#: Equal rows that one bucket may get.
REPEATS = 1000
#: Buckets whose lengths are summed in one task.
RANGE = 4096
#: Bytes that a row counts beside its text, so that tables of empty texts get several buckets too.
ROW_BYTES = 64


def _by_key(a: Column, b: Column) -> Column:
    return F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).when(a["salt"] < b["salt"], -1).when(a["salt"] > b["salt"], 1).otherwise(0)


def external_shuffle(df: DataFrame, n_shards: int, text: str = "text", seed: int = 20240607, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``record`` (all columns of ``df``), ``size``, ``text_crc32``, ``bucket``, ``place``, ``shard`` and gapless ``slot``."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        # A task that reads a shuffle again may get its rows in another order; one that reads a file does not.
        df = durable(df, "input")
    size = utf8_size(text_or_empty(text)) + 1
    total = df.agg(F.sum(size + ROW_BYTES)).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    content = F.xxhash64(F.lit(seed), *[df[c] for c in df.columns]) if df.columns else F.lit(0).cast("long")
    hashes = df.select(content.alias("content")).groupBy(F.col("content").alias("repeated")).agg(F.count("*").alias("n"))
    # At most one row for REPEATS rows, joined by broadcast only while its file is small.
    repeated = durable(hashes.where(F.col("n") > REPEATS).select("repeated"), "repeated")
    placed = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("record"),
        size.alias("size"),
        F.crc32(F.encode(text_or_empty(text), "utf-8")).alias("text_crc32"),
        content.alias("content"),
        F.monotonically_increasing_id().alias("place_in_input"),
    )
    salt = F.when(F.col("repeated").isNotNull(), F.col("place_in_input")).otherwise(0)
    scattered = (
        placed.join(repeated, F.col("content") == F.col("repeated"), "left")
        .select("record", "size", "text_crc32", salt.alias("salt"), F.xxhash64("content", salt).alias("key"))
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(n_buckets)).cast("int"))
    )
    # Each bucket is a partition of its own; the list is sorted first, so that a retried task shuffles the same list.
    shuffled = (
        scattered.repartitionById(n_buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.collect_list(F.struct("key", "salt", "size", "text_crc32", "record")).alias("rows"))
        .select("bucket", F.size("rows").cast("long").alias("length"), F.shuffle(F.array_sort("rows", _by_key), seed).alias("rows"))
        .select("bucket", "length", F.posexplode("rows").alias("place", "row"))
        .select("bucket", "length", F.col("place").cast("long"), "row.size", "row.text_crc32", "row.record")
    )
    written = durable(shuffled, "shuffled")
    # Lengths are summed within ranges of buckets, then over the ranges: at 100 TB and 16 MB a bucket, 1600 rows.
    lengths = written.where("place = 0").select("bucket", "length", F.floor(F.col("bucket") / RANGE).alias("range"))
    inside = Window.partitionBy("range").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lengths.groupBy("range").agg(F.sum("length").alias("all")).select("range", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("first"))
    starts = lengths.withColumn("inside", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(ranges, "range").select("bucket", (F.col("first") + F.col("inside")).alias("start"))
    order = F.col("start") + F.col("place")
    return (
        written.join(starts, "bucket")
        .withColumn("shard", (order % n_shards).cast("int"))
        .withColumn("slot", F.expr(f"(start + place) div {n_shards}"))
        .select("record", "size", "text_crc32", "bucket", "place", "shard", "slot")
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write the records of :func:`external_shuffle` as one folder for each shard, in slot order inside a file."""
    shuffled.select("record.*", F.col("shard").alias("shard_id"), F.col("slot").alias("slot_id")).sortWithinPartitions("shard_id", "slot_id").write.partitionBy("shard_id").parquet(path)
