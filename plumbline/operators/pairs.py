"""Scores of text pairs, composite scores and preference pairs."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import once, rejoin
from .quantiles import with_quantiles

# Words that carry no keyword.
KEYWORD_STOP = ["the", "and", "or", "for", "with", "that", "this", "from", "shall", "must", "may"]
# Fixed value: a keyword token; letters of any alphabet count as word characters around it.
KEYWORD = r"(?<![\p{L}\p{N}_])[a-zA-Z][a-zA-Z0-9_-]*(?![\p{L}\p{N}_])"


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+", -1), lambda w: w != "")


def keywords(c: Column) -> Column:
    """Distinct lower-case tokens of three letters or more outside the stop list."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(KEYWORD), 0)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(*KEYWORD_STOP)))


def _closeness(a: Column, b: Column) -> Column:
    return F.coalesce(F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0)), F.lit(0.0))


def text_pair_scores(df: DataFrame, gold: str, answer: str, stopwords: list[str] = ()) -> DataFrame:
    """Word length ratio, Jaccard overlap of alphanumeric words, and closeness of keyword counts."""
    g, a = F.col(gold), F.col(answer)

    def bag(c: Column) -> Column:
        plain = F.filter(words(F.lower(c)), lambda w: w.rlike(r"^[\p{L}\p{N}]+$") & ~w.isin(*(stopwords or [""])))
        return F.array_distinct(plain)

    both = F.size(F.array_union(bag(g), bag(a)))
    kg, ka = F.size(keywords(g)), F.size(keywords(a))
    return df.withColumns(
        {
            "length_ratio": _closeness(F.size(words(g)), F.size(words(a))),
            "jaccard": F.coalesce(F.size(F.array_intersect(bag(g), bag(a))) / F.nullif(both, F.lit(0)), F.lit(0.0)),
            "keyword_score": F.when(kg == 0, 1.0).otherwise(F.greatest(1.0 - F.abs(kg - ka) / F.nullif(kg, F.lit(0)), F.lit(0.0))),
        }
    )


def _common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit per token of ``a``."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


@F.pandas_udf(T.DoubleType())
def _rouge_l(gold: pd.Series, answer: pd.Series) -> pd.Series:
    token = re.compile(r"[a-z0-9]+")

    def score(g, a):
        x, y = token.findall((g or "").lower()), token.findall((a or "").lower())
        if not x or not y:
            return 0.0
        n = _common_subsequence(x, y)
        p, r = n / len(y), n / len(x)
        return 2 * p * r / (p + r) if n else 0.0

    return pd.Series([score(g, a) for g, a in zip(gold, answer)], dtype="float64")


def rouge_l(df: DataFrame, gold: str, answer: str, name: str = "rouge_l") -> DataFrame:
    """F-measure of the longest common subsequence of lower-case tokens."""
    return df.withColumn(name, _rouge_l(gold, answer))


# Fixed value: a BLEU token is a decimal number, a word or a single sign.
BLEU_TOKEN = r"\p{Nd}+[.,]\p{Nd}+|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\s\x1C-\x1F\x85]"


def bleu(df: DataFrame, gold: str, answer: str, name: str = "bleu") -> DataFrame:
    """BLEU-4 of one pair: clipped n-gram precision and brevity penalty, no smoothing.

    Equal n-grams are numbered in their sorted order, so the clipped count of a pair is the size of an
    intersection; time grows with the sorting of the n-grams."""
    sides = {"x": gold, "y": answer}
    tokens = {f"_{s}": F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(BLEU_TOKEN), F.lit(0)) for s, c in sides.items()}
    out = once(df, **tokens)
    empty = F.array().cast("array<string>")

    def grams(s: str, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(f"_{s}") - n + 1)
        found = F.transform(starts, lambda i: F.array_join(F.slice(f"_{s}", i, F.lit(n)), " "))
        return F.array_sort(F.when(F.size(f"_{s}") >= n, found).otherwise(empty))

    def firsts(g: str) -> Column:
        places = F.when(F.size(g) > 0, F.sequence(F.lit(0), F.size(g) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: (i == 0) | (F.get(g, i) != F.get(g, i - 1)))

    def numbered(g: str, f: str) -> Column:
        def each(i: Column, j: Column) -> Column:
            stop = F.coalesce(F.get(f, j + 1), F.size(g))
            return F.transform(F.sequence(F.lit(1), stop - i), lambda k: F.concat(F.get(g, i), F.lit("\n"), k.cast("string")))

        return F.flatten(F.transform(f, each))

    made = [(s, n) for n in range(1, 5) for s in sides]
    out = once(out, **{f"_{s}{n}": grams(s, n) for s, n in made})
    out = once(out, **{f"_f{s}{n}": firsts(f"_{s}{n}") for s, n in made})
    logs = F.lit(0.0)
    for n in range(1, 5):
        hits = F.size(F.array_intersect(numbered(f"_x{n}", f"_fx{n}"), numbered(f"_y{n}", f"_fy{n}")))
        logs = logs + F.ln(F.nullif(hits, F.lit(0)) / F.nullif(F.size(f"_y{n}"), F.lit(0))) / 4
    short = F.least(F.lit(0.0), 1 - F.size("_x") / F.nullif(F.size("_y"), F.lit(0)))
    score = F.coalesce(F.exp(logs + short), F.lit(0.0))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], score.alias(name))


# --- composites -------------------------------------------------------------------------------

# Blend of columns per pillar, and pillar weights of the composite.
PILLARS = {
    "S_coverage": {"S_keyword": 0.25, "S_ontology_direct": 0.30, "S_ontology_inferred": 0.30, "S_ontology": 0.15},
    "S_sem_faith": {"S_sem": 0.40, "S_ragas_faithfulness": 0.40, "S_ragas_relevancy": 0.20},
    "S_surface": {"S_lex": 0.40, "S_len": 0.30, "S_spacy": 0.30},
}
PILLAR_WEIGHTS = {"S_coverage": 0.35, "S_sem_faith": 0.45, "S_surface": 0.20}


def harmonic_mean(parts: dict[str, Column], weights: dict[str, float], eps: float = 1e-8) -> Column:
    total = sum(weights.values())
    below = reduce(Column.__add__, [F.lit(w) / F.greatest(parts[n], F.lit(eps)) for n, w in weights.items()])
    return F.lit(total) / below


def composite_score(
    df: DataFrame, pillars: dict[str, dict[str, float]] = PILLARS, weights: dict[str, float] = PILLAR_WEIGHTS,
    name: str = "S_MDS", eps: float = 1e-8,
) -> DataFrame:
    """Pillar blends and their weighted harmonic mean."""
    blends = {
        p: reduce(Column.__add__, [F.col(c) * w for c, w in parts.items()]) for p, parts in pillars.items()
    }
    out = df.withColumns(blends)
    return out.withColumn(name, harmonic_mean({p: F.col(p) for p in weights}, weights, eps))


def score_by_group(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    base = df.groupBy(*keys).agg(F.count(score).alias("n"), F.avg(score).alias("mean"))
    return with_quantiles(base, df, keys, {"median": (score, 0.5)})


# Fixed values of the preference filter.
PREFERENCE = {"w_sem": 0.8, "w_surf": 0.2, "margin": 0.08, "sem_floor": 0.35, "score_floor": -0.5}


def preference_pairs(
    a: DataFrame, b: DataFrame, keys: list[str], prompt: str, answer: str, sem: str, surf: str,
    params: dict[str, float] = PREFERENCE,
) -> DataFrame:
    """Chosen and rejected answers of two versions.

    Metrics become z-scores over all pairs; a pair stays when one answer is good enough, the
    combined scores differ by the margin, and the semantic score agrees with the preference."""
    cols = [answer, sem, surf]
    left = a.select(*keys, prompt, *[F.col(c).alias(f"{c}_a") for c in cols])
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in cols])
    pairs = left.join(right, keys).dropna(subset=[f"{answer}_a", f"{answer}_b"])
    metrics = [f"{m}_{t}" for m in (sem, surf) for t in "ab"]
    stats = pairs.agg(
        *[F.avg(m).alias(f"_mu_{m}") for m in metrics],
        *[F.coalesce(F.nullif(F.stddev_samp(m), F.lit(0.0)), F.lit(1.0)).alias(f"_sd_{m}") for m in metrics],
    )
    z = {m: (F.col(m) - F.col(f"_mu_{m}")) / F.col(f"_sd_{m}") for m in metrics}
    scored = rejoin(pairs, stats, []).withColumns(
        {
            "score_a": z[f"{sem}_a"] * params["w_sem"] + z[f"{surf}_a"] * params["w_surf"],
            "score_b": z[f"{sem}_b"] * params["w_sem"] + z[f"{surf}_b"] * params["w_surf"],
            "_dz": z[f"{sem}_b"] - z[f"{sem}_a"],
        }
    ).dropna(subset=metrics)
    delta = F.col("score_b") - F.col("score_a")
    kept = scored.filter(
        (F.greatest(f"{sem}_a", f"{sem}_b") >= params["sem_floor"])
        & (F.greatest("score_a", "score_b") >= params["score_floor"])
        & (F.abs(delta) >= params["margin"])
        & (F.signum("_dz") == F.signum(delta))
    )
    first = F.col("score_a") > F.col("score_b")
    x, y = F.col(f"{answer}_a"), F.col(f"{answer}_b")
    return kept.select(
        *keys, prompt, F.when(first, x).otherwise(y).alias("chosen"), F.when(first, y).otherwise(x).alias("rejected"),
        delta.alias("delta"),
    )
