"""Scoring of candidate pairs and the surfacing rule.

Every candidate is scored on every field and metric in one pass (dense scores).
Scores depend on the two values only: distinct value pairs are scored and joined
back, so an expensive metric runs once for each.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from twinlens.functions.metrics import metric, pair_score
from twinlens.functions.text import string_values


@dataclass(frozen=True)
class MetricSpec:
    metric_id: str
    threshold: float | None = None
    params: dict = field(default_factory=dict)

    @property
    def least(self) -> float:
        return metric(self.metric_id).threshold if self.threshold is None else self.threshold


@dataclass(frozen=True)
class FieldSpec:
    name: str
    metrics: tuple[MetricSpec, ...]
    threshold: float = 0.8
    weight: float = 1.0


@dataclass(frozen=True)
class Rule:
    mode: str = "any"
    combined: float = 0.85


@dataclass(frozen=True)
class Resolution:
    """What to compare and when a pair surfaces."""

    label: str
    fields: tuple[FieldSpec, ...]
    rule: Rule = Rule()
    strategy: str = "auto"
    blocking_field: str | None = None
    prefix_length: int = 8
    session_id: str = "session"

    def fingerprint(self) -> str:
        """Of what decides which candidates there are; thresholds, weights and the rule don't."""
        shape = {"label": self.label, "blockingField": self.blocking_field, "prefixLen": self.prefix_length, "fields": [{"name": f.name, "metrics": [{"id": m.metric_id, "params": m.params} for m in f.metrics]} for f in self.fields]}
        return hashlib.sha1(json.dumps(shape, separators=(",", ":")).encode()).hexdigest()[:12]

    def rescaled(self) -> Resolution:
        """The same with field weights that sum to 1; equal ones if none is positive."""
        total = sum(max(0.0, f.weight) for f in self.fields)
        share = lambda f: max(0.0, f.weight) / total if total else 1 / len(self.fields)
        return Resolution(**{**{k: getattr(self, k) for k in asdict(self)}, "fields": tuple(FieldSpec(f.name, f.metrics, f.threshold, share(f)) for f in self.fields)})


def pair_id(session: Column | str, a: Column, b: Column) -> Column:
    """The first 12 hex digits of sha1(session|smaller id|larger id)."""
    s = F.lit(session) if isinstance(session, str) else session
    return F.substring(F.sha1(F.concat_ws("|", s, F.least(a, b), F.greatest(a, b))), 1, 12)


def legacy_pair_id(a: Column, b: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.least(a, b), F.greatest(a, b))), 1, 12)


_ONCE = {"jaro-winkler", "token-sort-ratio", "phonetic", "exact-match", "edit-distance", "token-jaccard"}


def _field_scores(pairs: DataFrame, nodes: DataFrame, spec: FieldSpec) -> DataFrame:
    """(id_a, id_b, field_name, metric_id, score) where both nodes carry the field."""
    is_array = isinstance(nodes.schema[spec.name].dataType, ArrayType)
    values = nodes.select("id", F.col(spec.name).alias("v")).where("v is not null")
    both = pairs.join(values.select(F.col("id").alias("id_a"), F.col("v").alias("va")), "id_a").join(values.select(F.col("id").alias("id_b"), F.col("v").alias("vb")), "id_b")
    text_metrics = [m for m in spec.metrics if m.metric_id in _ONCE]
    other = [m for m in spec.metrics if m.metric_id not in _ONCE]
    out = None
    if text_metrics:
        as_list = lambda c: string_values(F.col(c), is_array)
        exploded = both.select("id_a", "id_b", F.explode(as_list("va")).alias("x"), "vb").select("id_a", "id_b", "x", F.explode(as_list("vb")).alias("y")) if is_array else both.select("id_a", "id_b", F.col("va").cast("string").alias("x"), F.col("vb").cast("string").alias("y"))
        distinct = exploded.select("x", "y").distinct()
        scored = distinct.select("x", "y", *[pair_score(m.metric_id, F.col("x"), F.col("y"), m.params).alias(f"s{k}") for k, m in enumerate(text_metrics)])
        long = scored.select("x", "y", F.explode(F.array(*[F.struct(F.lit(m.metric_id).alias("metric_id"), F.col(f"s{k}").alias("score")) for k, m in enumerate(text_metrics)])).alias("e")).select("x", "y", "e.metric_id", "e.score")
        out = exploded.join(long, ["x", "y"]).select("id_a", "id_b", "metric_id", "score")
        if is_array:
            out = out.groupBy("id_a", "id_b", "metric_id").agg(F.max("score").alias("score"))
    if other:
        arrays = is_array and all(m.metric_id == "numeric-proximity" for m in other)
        columns = [F.struct(F.lit(m.metric_id).alias("metric_id"), pair_score(m.metric_id, F.col("va"), F.col("vb"), m.params, arrays).alias("score")) for m in other]
        rows = both.select("id_a", "id_b", F.explode(F.array(*columns)).alias("e")).select("id_a", "id_b", "e.metric_id", "e.score")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("field_name", F.lit(spec.name))


def dense_scores(pairs: DataFrame, nodes: DataFrame, resolution: Resolution) -> DataFrame:
    """(id_a, id_b, field_name, metric_id, score, above_threshold) of every candidate; score null where the metric abstains."""
    out = None
    for spec in resolution.fields:
        least = F.lit(None).cast("double")
        for m in spec.metrics:
            least = F.when(F.col("metric_id") == m.metric_id, F.lit(float(m.least))).otherwise(least)
        rows = _field_scores(pairs.select("id_a", "id_b"), nodes, spec).withColumn("above_threshold", F.col("score") >= least)
        out = rows if out is None else out.unionByName(rows)
    return out.select("id_a", "id_b", "field_name", "metric_id", "score", "above_threshold")


def rule_holds(score: dict[str, Column], resolution: Resolution) -> Column:
    """The rule over the best score of each field; null is a field that can't be compared.

    any: some field reaches its threshold, a missing one counting as 0. all: all
    comparable fields do, and there is one. weighted-average: the mean over
    comparable fields, weights relative to each other, reaches the combined one.
    """
    fields = resolution.fields
    reached = {f.name: F.coalesce(score[f.name], F.lit(0.0)) >= f.threshold for f in fields}
    if resolution.rule.mode == "any":
        out = F.lit(False)
        for f in fields:
            out = out | reached[f.name]
        return out
    if resolution.rule.mode == "all":
        out, some = F.lit(True), F.lit(False)
        for f in fields:
            known = score[f.name].isNotNull()
            out, some = out & (~known | reached[f.name]), some | known
        return out & some
    if resolution.rule.mode == "weighted-average":
        total, weight = F.lit(0.0), F.lit(0.0)
        for f in fields:
            w = F.when(score[f.name].isNotNull(), F.lit(float(f.weight))).otherwise(F.lit(0.0))
            total, weight = total + w * F.coalesce(score[f.name], F.lit(0.0)), weight + w
        return F.coalesce((weight > 0) & (total / F.when(weight > 0, weight) >= resolution.rule.combined), F.lit(False))
    raise ValueError(f"unknown rule: {resolution.rule.mode}")


def surfaced(pairs: DataFrame, scores: DataFrame, resolution: Resolution) -> DataFrame:
    """(pair_id, id_a, id_b, best score of each field, max_score, surfaced): all candidates, kept also below the rule."""
    best = [F.max(F.when(F.col("field_name") == f.name, F.col("score"))).alias(f"score_{f.name}") for f in resolution.fields]
    by_pair = scores.groupBy("id_a", "id_b").agg(*best)
    wide = pairs.select("id_a", "id_b").join(by_pair, ["id_a", "id_b"], "left")
    columns = {f.name: F.col(f"score_{f.name}") for f in resolution.fields}
    top = F.greatest(F.lit(0.0), *[F.coalesce(c, F.lit(0.0)) for c in columns.values()])
    return wide.select(pair_id(resolution.session_id, F.col("id_a"), F.col("id_b")).alias("pair_id"), "id_a", "id_b", *columns.values(), top.alias("max_score"), rule_holds(columns, resolution).alias("surfaced"))


def distributions(scores: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of each field and metric."""
    ranks = [F.expr(f"percentile_disc({p}) within group (order by score)").alias(f"p{int(p * 100)}") for p in (0.5, 0.75, 0.9, 0.95)]
    known = scores.where("score is not null").groupBy("id_a", "id_b", "field_name", "metric_id").agg(F.max("score").alias("score"))
    return known.groupBy("field_name", "metric_id").agg(*ranks, F.max("score").alias("max"), F.count(F.lit(1)).alias("n"))


def fraction_above(scores: DataFrame, threshold: float) -> DataFrame:
    """The exact share of scores at or above a threshold, by field and metric."""
    return scores.where("score is not null").groupBy("field_name", "metric_id").agg(F.avg((F.col("score") >= threshold).cast("double")).alias("fraction"))


def interpolated_fraction(threshold: float, p50: float, p75: float, p90: float, p95: float, top: float) -> float:
    """The share above a threshold that percentiles alone tell: linear between them."""
    if threshold <= 0:
        return 1.0
    if threshold > top:
        return 0.0
    points = [(0.0, 0.0), (p50, 0.5), (p75, 0.75), (p90, 0.9), (p95, 0.95), (top, 1.0)]
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        if threshold <= x1:
            return 1 - (y1 if x1 == x0 else y0 + (y1 - y0) * (threshold - x0) / (x1 - x0))
    return 0.0


def refilter(pairs: DataFrame, scores: DataFrame, resolution: Resolution) -> DataFrame:
    """Pairs with ``surfaced`` taken anew from stored scores; a field is comparable if it has a score.

    A decided pair that was surfaced stays. ``pairs`` has pair_id, id_a, id_b,
    verdict and surfaced; the result adds was_surfaced and kept_for_verdict.
    """
    again = surfaced(pairs, scores, resolution).select("id_a", "id_b", F.col("surfaced").alias("passes"))
    joined = pairs.withColumnRenamed("surfaced", "was_surfaced").join(again, ["id_a", "id_b"])
    kept = ~F.col("passes") & F.col("was_surfaced") & (F.coalesce("verdict", F.lit("pending")) != "pending")
    return joined.withColumn("kept_for_verdict", kept).withColumn("surfaced", F.col("passes") | kept).drop("passes")


def refilter_summary(refiltered: DataFrame) -> DataFrame:
    return refiltered.agg(
        F.count_if("surfaced").alias("surfaced"),
        F.count_if(F.col("surfaced") & ~F.col("was_surfaced")).alias("added"),
        F.count_if(~F.col("surfaced") & F.col("was_surfaced")).alias("removed"),
        F.count_if("kept_for_verdict").alias("kept_for_verdict"),
    )
