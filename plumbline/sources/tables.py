"""Tables: reading, conforming to a target schema, slicing, checkpoints and stage manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..operators.clean import null_report


def read_table(
    spark: SparkSession,
    fmt: str,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    distinct: bool = True,
    **options,
) -> DataFrame:
    """Load parquet, CSV (with header) or any built-in format, dropping repeated whole rows."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.options(**options).load(path)
    return df.dropDuplicates() if distinct else df


def conform_schema(
    df: DataFrame,
    target: T.StructType,
    mapping: dict[str, str] | None = None,
    date_format: str | None = None,
) -> tuple[DataFrame, dict[str, list[str]]]:
    """One select that renames by ``mapping`` (source -> target), casts to the target types and
    fills absent columns with typed nulls. Returns the frame and what was mapped, missing, unused.
    """
    source_of = {t: s for s, t in (mapping or {}).items()}
    have = set(df.columns)
    out: list[Column] = []
    mapped, missing, used = [], [], set()
    for field in target.fields:
        source = source_of.get(field.name, field.name)
        if source not in have:
            missing.append(field.name)
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        used.add(source)
        mapped.append(field.name)
        c = F.col(source)
        is_text = isinstance(df.schema[source].dataType, T.StringType)
        if date_format and is_text and isinstance(field.dataType, T.DateType):
            c = F.try_to_timestamp(c, F.lit(date_format)).cast("date")
        elif is_text:
            c = c.try_cast(field.dataType)
        else:
            c = c.cast(field.dataType)
        out.append(c.alias(field.name))
    unused = [c for c in df.columns if c not in used]
    return df.select(*out), {"mapped": mapped, "missing": missing, "unused": unused}


def exclude_files(df: DataFrame, pattern: str) -> DataFrame:
    """Drop rows read from files whose name matches ``pattern``; the scan skips their bytes."""
    return df.filter(~F.col("_metadata.file_name").rlike(pattern))


def slice_period(
    df: DataFrame, date: str, max_year: int, max_month: int = 12, first_year: int | None = None
) -> DataFrame:
    """Rows up to the end of ``max_year``-``max_month`` (and from ``first_year``), written as a
    range on the date so that it reaches the scan."""
    end_year, end_month = (max_year + 1, 1) if max_month == 12 else (max_year, max_month + 1)
    kind = df.schema[date].dataType
    keep = F.col(date) < F.lit(f"{end_year:04d}-{end_month:02d}-01").cast(kind)
    if first_year is not None:
        keep = keep & (F.col(date) >= F.lit(f"{first_year:04d}-01-01").cast(kind))
    return df.filter(keep)


# The named slices as (first year, last year, last month).
NAMED_SLICES = {"3M": (2015, 2015, 3), "1Y": (2015, 2015, 12), "5Y": (2015, 2019, 12)}


def named_slice(df: DataFrame, date: str, name: str) -> DataFrame:
    first, last, month = NAMED_SLICES[name]
    return slice_period(df, date, last, month, first_year=first)


def write_checkpoint(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_checkpoint(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The stored table and its null report."""
    df = spark.read.parquet(path)
    return df, null_report(df)


def pipeline_manifest(
    stages: list[tuple[str, DataFrame]], label: Column, date: str
) -> DataFrame:
    """Per stage: rows, columns, label count and rate, date range, and the change against the
    stage before. One aggregation per stage; only the stage rows meet in a window."""

    def summary(i: int, name: str, df: DataFrame) -> DataFrame:
        present = label.cast("int")
        return df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(present).cast("long").alias("positives"),
            F.avg(present.cast("double")).alias("rate"),
            F.min(date).alias("first_date"),
            F.max(date).alias("last_date"),
        ).select(
            F.lit(i).alias("stage_no"),
            F.lit(name).alias("stage"),
            F.lit(len(df.columns)).alias("n_columns"),
            "*",
        )

    union = reduce(DataFrame.unionByName, [summary(i, n, d) for i, (n, d) in enumerate(stages)])
    w = W.partitionBy(F.lit(0)).orderBy("stage_no")
    return union.select(
        "*",
        (F.lag("rows").over(w) - F.col("rows")).alias("rows_removed"),
        (F.col("n_columns") - F.lag("n_columns").over(w)).alias("columns_added"),
    )
