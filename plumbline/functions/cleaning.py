"""Cleaning of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double_safe(c: Column) -> Column:
    """Strip everything but digits, dot and minus; what is left as a double or null."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


# The strings that mean "missing".
BLANK_TOKENS = ("", "NA")


def blank_to_null(c: Column, tokens: tuple[str, ...] = BLANK_TOKENS) -> Column:
    return F.when(~F.trim(c).isin(*tokens), c)


def parse_measure(c: Column) -> Column:
    """Observed measure: trace marker ``T`` counts as 0, a trailing quality ``s`` is dropped."""
    text = F.trim(c)
    return F.when(text == "T", F.lit(0.0)).otherwise(
        F.regexp_replace(text, "s$", "").try_cast("double")
    )


def clip_to_null(c: Column, lo, hi) -> Column:
    return F.when(c.between(lo, hi), c)


def clean_code(c: Column) -> Column:
    """Upper-case code of ``[A-Z0-9]``; empty becomes null."""
    return F.nullif(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def finite_or(c: Column, value) -> Column:
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(value).cast("double")).otherwise(c)


def log1p_clamped(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def expm1_of(c: Column) -> Column:
    return F.expm1(c)
