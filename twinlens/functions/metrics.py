"""Similarity metrics of two values: Column builders, Arrow functions where the JVM has none.

A score is a double in [0, 1]; null means that the metric abstains.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from twinlens.functions.text import folded, folded_ascii, tokens

Scorer = Callable[[Column, Column, dict], Column]


def jaro_winkler(a: str, b: str, prefix_weight: float = 0.1) -> float:
    """Jaro with half-transpositions counted exactly, and the prefix boost at any score."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    hits_a = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits_a.append(c)
                break
    m = len(hits_a)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(hits_a, (c for c, u in zip(b, used, strict=True) if u), strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * prefix_weight * (1 - jaro)


def common_subsequence_ratio(a: str, b: str) -> float:
    """2 * LCS / total length; equal texts 1, an empty one 0. Bit-parallel, so a long text costs words and not cells."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def _paired(function: Callable[[str, str], float]):
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else function(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return score


#: Letters in context and their code, in order; lower case is done, "-" is silent. The contexts and codes.
_SOUNDS = (
    ("(?<=C)K", "-"), ("CH", "x"), ("C(?=[IEY])", "s"), ("C", "k"),
    ("DG(?=[IEY]|$)", "j"), ("D", "t"),
    ("GH(?![AEIOU]|$)", "-"), ("G(?=[IEY]|$)", "j"), ("G", "k"),
    ("PH", "f"), ("P", "p"), ("Q", "k"),
    ("SH", "x"), ("S(?=I[OA])", "x"), ("S", "s"),
    ("TH", "0"), ("T(?=I[AO])", "x"), ("T", "t"),
    ("H(?=[AEIOU]|$)", "h"), ("W(?=[AEIOU]|$)", "w"), ("Y(?=[AEIOU]|$)", "y"),
    ("V", "f"), ("X", "ks"), ("Z", "s"), ("(?<=.)[AEIOU]|[HWY]|-", ""),
)


def phonetic(value: Column | str) -> Column:
    """The phonetic code of a text: of its letters A-Z, silent ones dropped; empty without any."""
    out = F.regexp_replace(F.upper(F.col(value) if isinstance(value, str) else value), "[^A-Z]", "")
    for letters, code in _SOUNDS:
        out = F.regexp_replace(out, letters, code)
    return F.upper(out)


lcs_ratio = F.pandas_udf(_paired(common_subsequence_ratio), DoubleType())


def _exact(a: Column, b: Column, p: dict) -> Column:
    mode = p["normalization"]
    norm = {"none": lambda c: c, "nfkd-lower-strip": folded, "ascii-lower-strip": folded_ascii}.get(mode, F.lower)
    return (norm(a) == norm(b)).cast("double")


def _edit(a: Column, b: Column, p: dict) -> Column:
    least = int(p["minLen"]) if int(p["minLen"]) > 0 else 3
    distance = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.when((F.length(a) >= least) & (F.length(b) >= least), distance)


def _winkler(a: Column, b: Column, p: dict) -> Column:
    weight = float(p["prefixWeight"])
    return F.pandas_udf(_paired(lambda x, y: jaro_winkler(x, y, weight)), DoubleType())(a, b)


def _jaccard(a: Column, b: Column, p: dict) -> Column:
    x, y = F.array_distinct(tokens(a, p["tokenMode"])), F.array_distinct(tokens(b, p["tokenMode"]))
    both = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - both
    return F.when(a.isNotNull() & b.isNotNull(), F.when(either > 0, both / either).otherwise(F.lit(0.0)))


def _token_sort(a: Column, b: Column, p: dict) -> Column:
    x, y = (F.array_join(F.array_sort(tokens(c, p["tokenMode"])), " ") for c in (a, b))
    return lcs_ratio(x, y)


def _phonetic(a: Column, b: Column, p: dict) -> Column:
    x, y = phonetic(a), phonetic(b)
    same = (x == y).cast("double")
    return same if p["emptyCode"] == "match" else F.when((x != "") & (y != ""), same)


def _numeric(a: Column, b: Column, p: dict) -> Column:
    x, y = a.cast("double"), b.cast("double")
    return F.greatest(F.lit(0.0), 1 - F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of stored vectors, held to [0, 1]."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot))


@dataclass(frozen=True)
class Metric:
    """A registered metric. ``score`` takes the two values and the parameters."""

    id: str
    name: str
    kinds: tuple[str, ...]
    threshold: float
    params: dict = field(default_factory=dict)
    score: Scorer = None
    multi_valued: bool = True


REGISTRY: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    REGISTRY[metric.id] = metric
    return metric


def metric(metric_id: str) -> Metric:
    if metric_id not in REGISTRY:
        raise KeyError(f"unknown metric: {metric_id}")
    return REGISTRY[metric_id]


register(Metric("exact-match", "Exact match", ("name", "identifier", "text"), 1.0, {"normalization": "nfkd-lower-strip"}, _exact))
register(Metric("edit-distance", "Edit distance", ("name", "identifier", "text"), 0.85, {"minLen": 3}, _edit))
register(Metric("jaro-winkler", "Jaro-Winkler", ("name", "identifier"), 0.88, {"prefixWeight": 0.1}, _winkler))
register(Metric("token-jaccard", "Token Jaccard", ("name", "text"), 0.5, {"tokenMode": "whitespace-lowercase"}, _jaccard))
register(Metric("token-sort-ratio", "Token sort ratio", ("name", "text"), 0.85, {"tokenMode": "whitespace-lowercase"}, _token_sort))
register(Metric("phonetic", "Phonetic", ("name",), 1.0, {"emptyCode": "match"}, _phonetic))
register(Metric("numeric-proximity", "Numeric proximity", ("numeric",), 0.95, {}, _numeric))
register(Metric("semantic-cosine", "Semantic cosine", ("name", "text"), 0.92, {}, lambda a, b, p: cosine(a, b), multi_valued=False))

_SUGGESTED = {
    "name": ("edit-distance", "jaro-winkler", "token-jaccard"),
    "text": ("token-jaccard", "semantic-cosine"),
    "identifier": ("exact-match", "edit-distance"),
    "numeric": ("numeric-proximity",),
}


def suggest_metrics(kind: str) -> tuple[str, ...]:
    return _SUGGESTED.get(kind, ())


_NATIVE_PAIRS = {"edit-distance", "numeric-proximity", "token-jaccard"}


def pair_score(metric_id: str, a: Column, b: Column, params: dict | None = None, arrays: bool = False) -> Column:
    """The score of two properties; of list values the best over the cross product, null if all abstain."""
    m = metric(metric_id)
    unknown = set(params or ()) - set(m.params)
    if unknown:
        raise ValueError(f"{metric_id} has no parameter {sorted(unknown)}")
    p = {**m.params, **(params or {})}
    if not arrays:
        return m.score(a, b, p)
    if metric_id not in _NATIVE_PAIRS and not (metric_id == "exact-match" and p["normalization"] not in ("nfkd-lower-strip",)):
        raise ValueError(f"{metric_id} scores list values through score_pairs, on exploded values")
    return F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: m.score(x, y, p)))))
