"""Shared pieces of the text operators: durable intermediate tables, null-safe keys, word expressions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word, besides the blank.
OTHER_SPACES = "\t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a fresh local one only on a local master without ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="episodica-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str, most_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of any executor.

    ``most_rows`` bounds a file's rows where these are large, as a reader holds many rows of a file at once.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", most_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`durable` that nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, parent)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of ``text`` in order; splitting on one literal blank keeps off the regex engine."""
    for space in OTHER_SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def utf8_size(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s columns, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
