"""Chapters as JSON files, and the choice of a reader by the name of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_payloads(spark: SparkSession, glob: str) -> DataFrame:
    """``chapter_index``, ``path``, ``payload``: one row a file named ``NN_slug.json``, read whole and left as it is."""
    files = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    return files.select(F.regexp_extract("path", r"(\d+)_[^/]*\.json$", 1).try_cast("int").alias("chapter_index"), "path", "payload")


def input_kind(path: Column) -> Column:
    """``epub`` or ``pdf`` by the suffix, in any case; null for other files."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(suffix.isin("epub", "pdf"), suffix)


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Writes ``df`` as Parquet, replacing only the partitions it holds, so that a run can be repeated book by book."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def voice_files(files: DataFrame, active: str | None = None) -> DataFrame:
    """``name``, ``path``, ``active`` of the ``.wav`` files of a listing, previews left out."""
    base = F.regexp_extract("path", r"([^/\\]+)\.wav$", 1)
    rows = files.select(base.alias("name"), "path").filter((F.col("name") != "") & ~F.col("name").endswith(".preview"))
    return rows.withColumn("active", F.coalesce(F.col("path") == F.lit(active), F.lit(False)))


def resolve_voice(files: DataFrame, asked: str | None, configured: str | None, root: str = "") -> DataFrame:
    """One row ``path``: the voice to use, from a listing of files (``path``).

    The first that is given decides: the ``asked`` path (relative ones are under ``root``) or name, the ``configured``
    name, ``voices/default.wav``, ``voice/reference.wav``. A voice that is asked for or configured and is not there is an
    error, as is no voice at all; neither falls through. Empty counts as not given.
    """
    under = lambda p: f"{root.rstrip('/')}/{p}" if root and not p.startswith("/") else p
    named = lambda n: under(f"voices/{n}.wav")
    there = lambda p: F.coalesce(F.max(F.col("path") == F.lit(p)), F.lit(False))
    if asked:
        wanted = [under(asked)] if "/" in asked else [under(asked), named(asked)]
        missing = f"voice {asked!r} is not there"
    elif configured:
        wanted, missing = [named(configured)], f"configured voice {configured!r} is not there"
    else:
        wanted, missing = [under("voices/default.wav"), under("voice/reference.wav")], "no voice is given and there is no default"
    found = F.coalesce(*(F.when(there(p), F.lit(p)) for p in wanted), F.raise_error(F.lit(missing)))
    return files.agg(found.alias("path"))
