"""Resumable capture: an ordered walk in batches with a keyset cursor, and estimates."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlens.operators.blocking import PREFIX_LENGTH, PREFIX_PARTNERS, n_pairs

BATCH, CANDIDATE_BUDGET, SURFACED_BUDGET = 5_000, 100_000, 2_000
EXACT_LIMIT, LEAST_SAMPLE, MOST_SAMPLE = 50_000, 2_000, 20_000


@dataclass(frozen=True)
class CaptureState:
    cursor_value: str | None = None
    cursor_id: str | None = None
    nodes_walked: int = 0
    complete: bool = False
    fingerprint: str = ""


def ordered_batch(nodes: DataFrame, value: str, state: CaptureState, size: int = BATCH) -> DataFrame:
    """The next nodes in (value, id) order behind the cursor: a pushed-down predicate and a top-n."""
    rows = nodes.where(F.col(value).isNotNull())
    if state.cursor_value is not None:
        rows = rows.where((F.col(value) > state.cursor_value) | ((F.col(value) == state.cursor_value) & (F.col("id") > state.cursor_id)))
    return rows.orderBy(value, "id").limit(size)


def batch_pairs(batch: DataFrame, nodes: DataFrame, value: str, length: int = PREFIX_LENGTH, partners: int = PREFIX_PARTNERS) -> DataFrame:
    """Pairs of a batch's nodes with later nodes of the table that start with their prefix."""
    # Partners lie in the range from the batch's least value to the end of its last block: the rest of the table is not exploded.
    edge = batch.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if edge["lo"] is not None:
        nodes = nodes.where((F.col(value) >= edge["lo"]) & (F.substring(value, 1, length) <= edge["hi"][:length]) | F.col(value).startswith(edge["hi"]))
    walkers = batch.select(F.col("id").alias("w"), F.col(value).alias("wv"), F.substring(value, 1, length).alias("block"))
    cuts = F.transform(F.sequence(F.lit(1), F.least(F.lit(length), F.length(value))), lambda k: F.substring(F.col(value), F.lit(1), k))
    others = nodes.where(F.length(value) > 0).select(F.col("id").alias("m"), F.col(value).alias("mv"), F.explode(cuts).alias("block"))
    pairs = walkers.join(others, "block").where("wv < mv or (wv = mv and w < m)")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("w").orderBy("mv", "m"))).where(F.col("rank") <= partners)
    return ranked.select(F.least("w", "m").alias("id_a"), F.greatest("w", "m").alias("id_b"))


def capture(nodes: DataFrame, value: str, fingerprint: str, handle: Callable[[DataFrame], tuple[int, int]], state: CaptureState | None = None, batch_size: int = BATCH, candidates: int = CANDIDATE_BUDGET, surfaced: int = SURFACED_BUDGET, length: int = PREFIX_LENGTH, stop: Callable[[], bool] = lambda: False) -> CaptureState:
    """Walk until a budget is spent or the table ends; ``handle`` persists a batch's pairs and returns (candidates, surfaced).

    A state of another fingerprint, or a complete one, starts anew. Budgets are
    looked at after each batch, so they may be overshot by one.
    """
    if state is None or state.fingerprint != fingerprint or state.complete:
        state = CaptureState(fingerprint=fingerprint)
    found = shown = 0
    while found < candidates and shown < surfaced and not stop():
        batch = ordered_batch(nodes, value, state, batch_size)
        edge = batch.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col(value).alias("v"), F.col("id").alias("i"))).alias("last")).first()
        if edge["n"]:
            more = handle(batch_pairs(batch, nodes, value, length))
            found, shown = found + more[0], shown + more[1]
        ended = edge["n"] < batch_size
        state = replace(state, cursor_value=None if ended else edge["last"]["v"], cursor_id=None if ended else edge["last"]["i"], nodes_walked=state.nodes_walked + edge["n"], complete=ended)
        if ended:
            break
    return state


def coverage(walked: int, total: int) -> float:
    """Percent of pairs that a walk of so many nodes has seen."""
    return min(100.0, 100 * (1 - (1 - walked / total) ** 2)) if total else 100.0


def sample_size(n: int, candidates: int) -> int:
    if candidates <= EXACT_LIMIT:
        return n
    return min(n, max(LEAST_SAMPLE, math.floor(n * math.sqrt(EXACT_LIMIT / candidates))))


def stride_sample(nodes: DataFrame, n: int, target: int) -> DataFrame:
    """Nodes floor(i * n / target) in id order, for i below target."""
    if target >= n:
        return nodes
    ranked = nodes.withColumn("_rn", F.row_number().over(Window.orderBy("id")) - 1)
    # rn is floor(i * n / target) of some i if the next multiple of n / target below rn + 1 falls on it.
    i = F.ceil(F.col("_rn") * target / n)
    return ranked.where((i < target) & (F.floor(i * n / target) == F.col("_rn"))).drop("_rn")


def scaled_surfaced(surfaced: int, sampled: int, total: int) -> int:
    """Sampled pairs scaled by pairs, to one significant digit below 100 observed and two above."""
    if sampled >= total or n_pairs(sampled) == 0:
        return surfaced
    return rounded(surfaced * n_pairs(total) / n_pairs(sampled), surfaced)


def scaled_candidates(candidates: int, fetched: int, total: int) -> int:
    return round(candidates * total / fetched) if fetched else 0


def rounded(value: float, observed: int) -> int:
    if value < 100:
        return round(value)
    digits = 1 if observed < 100 else 2
    unit = 10 ** (math.floor(math.log10(value)) - digits + 1)
    return int(round(value / unit) * unit)


def next_pass(batch_nodes: int, batch_candidates: int, batch_surfaced: int, remaining: int) -> int:
    """Nodes that the next pass will walk before a budget is spent."""
    per_node = [CANDIDATE_BUDGET * batch_nodes / batch_candidates if batch_candidates else math.inf, SURFACED_BUDGET * batch_nodes / batch_surfaced if batch_surfaced else math.inf]
    return max(1, min(remaining, *(int(min(x, remaining)) for x in per_node)))
