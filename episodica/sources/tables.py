"""Readers with declared contracts, resumable sinks, manifests and catalogue search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import boolean_of
from ..operators.guards import repeated_keys, require_none

INVENTORY = "episode_id long, label long, label_name string, row_count long, first_row long, last_row long, single_label string, contiguous string, monotonic string"


def read_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the file footers alone."""
    return spark.read.parquet(path).columns


def read_telemetry(spark: SparkSession, path: str, columns: Sequence[str], episode: str, wanted: DataFrame | None = None) -> DataFrame:
    """Named columns of the wanted episodes; the scan reads no others, and the ids filter it by a semi-join."""
    rows = spark.read.parquet(path).select(episode, *columns)
    return rows if wanted is None else rows.join(wanted.select(episode).distinct(), episode, "left_semi")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """A CSV inventory with parsed flags; repeated episodes and spans that do not add up are errors."""
    raw = spark.read.csv(path, header=True, schema=INVENTORY)
    out = raw.withColumns({c: boolean_of(F.col(c)) for c in ("single_label", "contiguous", "monotonic")})
    require_none(repeated_keys(out, ["episode_id"]), "repeated episode")
    require_none(out.where("row_count <> last_row - first_row + 1"), "row count and span differ")
    return out


def read_protocol(spark: SparkSession, path: str, partition: str, seed: int = -1, commissioning_n: int = -1) -> DataFrame:
    """Members of one partition of a membership table; repeated members or none are errors."""
    found = spark.read.parquet(path).where((F.col("partition") == partition) & (F.col("seed") == seed) & (F.col("commissioning_n") == commissioning_n))
    require_none(repeated_keys(found, ["episode_id"]), "repeated member")
    if not found.limit(1).count():
        raise ValueError(f"no members of {partition} for seed {seed} and size {commissioning_n}")
    return found


def require_columns(table: DataFrame, columns: Sequence[str], width: int | None = None) -> DataFrame:
    """``table`` if its names differ, hold the wanted ones and are ``width`` in number; else an error."""
    names = table.columns
    repeated = sorted({c for c in names if names.count(c) > 1})
    missing = [c for c in columns if c not in names]
    if repeated or missing or (width is not None and len(names) != width):
        raise ValueError(f"repeated columns {repeated}, missing columns {missing}, {len(names)} columns")
    return table


def read_split(spark: SparkSession, membership: str, telemetry: str, columns: Sequence[str], partition: str, seed: int | None = None, commissioning_n: int | None = None) -> DataFrame:
    """Telemetry of one named split; only commissioning takes (and needs) a seed and a size."""
    named = seed is not None and commissioning_n is not None
    if (partition == "commissioning") != named or (seed is None) != (commissioning_n is None):
        raise ValueError("commissioning needs a seed and a size, and no other split has them")
    members = read_protocol(spark, membership, partition, *((seed, commissioning_n) if named else ()))
    return read_telemetry(spark, telemetry, columns, "episode_id", members)


def save_features(features: DataFrame, path: str, version: str) -> None:
    """Write a feature table with its version; the job's commit makes the whole of it visible or none."""
    features.withColumn("feature_version", F.lit(version)).write.mode("overwrite").parquet(path)


def load_features(spark: SparkSession, path: str, version: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A saved feature table; another version, other columns or repeated episodes are errors."""
    found = spark.read.parquet(path)
    require_none(found.where(F.col("feature_version") != version).select("feature_version"), f"features are not of version {version}")
    out = found.drop("feature_version")
    if columns is not None and sorted(columns) != sorted(out.columns):
        raise ValueError(f"features have columns {sorted(out.columns)}, not {sorted(columns)}")
    require_none(repeated_keys(out, ["episode_id"]), "repeated episode")
    return out


def append_results(results: DataFrame, path: str, partition_by: Sequence[str] = ("detector",), protocol_version: str | None = None) -> None:
    """Append a batch of runs; the commit of the job is what makes it visible.

    With ``protocol_version`` the rows carry it, and a table of another version is an error.
    """
    if protocol_version is not None:
        results = results.withColumn("protocol_version", F.lit(protocol_version))
        try:
            before = results.sparkSession.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            require_none(before.where(~F.col("protocol_version").eqNullSafe(protocol_version)).select("protocol_version"), f"results are not of protocol {protocol_version}")
    results.write.mode("append").partitionBy(*partition_by).parquet(path)


def find_columns(spark: SparkSession, pattern: str, database: str | None = None) -> DataFrame:
    """``table``, ``column``, ``kind`` of all columns in the catalogue whose name matches a pattern in any case."""
    names = [t.name for t in spark.catalog.listTables(database)]
    rows = [(t, c.name, c.dataType) for t in names for c in spark.catalog.listColumns(f"{database}.{t}" if database else t)]
    return spark.createDataFrame(rows, "table string, column string, kind string").where(F.lower("column").rlike(pattern.lower()))


def write_manifest(spark: SparkSession, path: str, inputs: Sequence[str], parameters: dict[str, str]) -> DataFrame:
    """One JSON row with the parameters and the name, size and hash of every input file; returned as written."""
    files = reduce(DataFrame.unionByName, [file_hashes(spark, p) for p in inputs])
    listed = files.agg(F.array_sort(F.collect_list(F.struct("path", "length", "sha256"))).alias("files"))
    pairs = [F.lit(x) for k in sorted(parameters) for x in (k, parameters[k])]
    out = listed.select(F.create_map(*pairs).alias("parameters") if pairs else F.lit(None).cast("map<string,string>").alias("parameters"), "files")
    out.coalesce(1).write.mode("overwrite").json(path)
    return out


def union_of_folders(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """CSV files of several folders with the folder each row came from."""
    return spark.read.csv(list(paths), header=True, schema=schema).withColumn("folder", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below ``path``, for manifests."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
