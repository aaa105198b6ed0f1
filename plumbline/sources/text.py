"""Text files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_corpus(
    spark: SparkSession,
    path: str,
    glob: str = "*.txt",
    id_pattern: str = r"^(.*?)(?:-v[\d.]+)?\.[^.]+$",
    version_pattern: str = r"-v(\d+(?:\.\d+)*)\.[^.]+$",
    name_at: int = -1,
) -> DataFrame:
    """One row per file: id and version from the file name, text as UTF-8 or, where the bytes are
    not valid UTF-8, as latin-1. ``name_at`` tells which part of the path holds the name, counted from
    its end; -2 is the folder of the file."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    name = F.element_at(F.split("path", "/"), name_at)
    version = F.regexp_extract(name, version_pattern, 1)
    raw = F.col("content")
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(
        F.decode(raw, "ISO-8859-1")
    )
    return files.select(
        F.regexp_extract(name, id_pattern, 1).alias("doc_id"),
        F.nullif(version, F.lit("")).alias("version"),
        text.alias("text"),
        "path",
    )
