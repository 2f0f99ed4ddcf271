"""Batch classification around any callable: messages, shared prefix, plan, retries, usage."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.operators.ledger import estimate, estimate_from_prompt, parallel_map

CHARS_A_TOKEN, OUTPUT_TOKENS_A_PAIR, MARGIN = 3.6, 55, 1.15


@dataclass(frozen=True)
class Settings:
    """What a user may set; the defaults."""

    batch_size: int = 20
    few_shot_count: int = 20
    cached_prefix: bool = True
    concurrency: int = 4
    excluded_labels: tuple[str, ...] = ()


def pair_blocks(pairs: DataFrame, nodes: DataFrame, scores: DataFrame, fields: list[str]) -> DataFrame:
    """(pair_id, batch, tag, block): tag, the properties of both nodes, scores to three places with a mark where they pass."""
    lines = F.array_join(F.filter(F.array(*[F.concat(F.lit(f"    {f}: "), F.col(f).cast("string")) for f in fields]), lambda x: x.isNotNull()), "\n")
    shown = nodes.select("id", F.when(lines == "", "    (no properties)").otherwise(lines).alias("shown"))
    line = F.concat(F.lit("    "), F.col("field_name"), F.lit(" · "), F.col("metric_id"), F.lit(": "), F.format_string("%.3f", "score"), F.when(F.col("above_threshold"), F.lit(" ✓")).otherwise(F.lit("")))
    listed = scores.where("score is not null").groupBy("id_a", "id_b").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("scored"))
    joined = pairs.join(shown.select(F.col("id").alias("id_a"), F.col("shown").alias("a")), "id_a", "left").join(shown.select(F.col("id").alias("id_b"), F.col("shown").alias("b")), "id_b", "left").join(listed, ["id_a", "id_b"], "left")
    text = lambda c, none: F.coalesce(F.col(c), F.lit(none))
    block = F.concat(F.lit("["), F.col("tag"), F.lit("]\n  Entity A:\n"), text("a", "    (no properties)"), F.lit("\n  Entity B:\n"), text("b", "    (no properties)"), F.lit("\n  Scores:\n"), text("scored", "    (no scores)"))
    return joined.select("pair_id", "batch", "tag", block.alias("block"))


def batch_messages(blocks: DataFrame) -> DataFrame:
    """(batch, n, message): a line that says how many pairs follow, and their blocks in order of tag. A batch holds a few dozen pairs at most."""
    number = F.substring("tag", 2, 9).cast("int")
    held = F.array_sort(F.collect_list(F.struct(number.alias("k"), "block")))
    n = F.count(F.lit(1))
    head = F.concat(F.lit("Judge each of these "), n.cast("string"), F.when(n == 1, " pair").otherwise(" pairs"), F.lit(". Give one result for each, under the tag in brackets.\n\n"))
    return blocks.groupBy("batch").agg(n.alias("n"), F.concat(head, F.array_join(F.transform(held, lambda b: b["block"]), "\n\n")).alias("message"))


def mean_block_chars(blocks: DataFrame, first: int = 25) -> DataFrame:
    """(chars): mean length of the first pairs' blocks, by pair id; null without any."""
    return blocks.orderBy("pair_id").limit(first).agg(F.avg(F.length("block")).alias("chars"))


def shared_prefix(label: str, n_nodes: int, distributions: Iterable, examples: Iterable, complete: bool = True, walked: int | None = None) -> str:
    """The text that all batches of a run share: data set, metrics with percentiles, decided examples, how far the table was compared. Equal inputs give equal bytes."""
    out = [f"Data set: {label}, {n_nodes} nodes.", "Metrics:"]
    out += [f"  {d['field_name']} · {d['metric_id']}: p50 {d['p50']:.3f}, p75 {d['p75']:.3f}, p90 {d['p90']:.3f}, p95 {d['p95']:.3f}, max {d['max']:.3f}" for d in sorted(distributions, key=lambda d: (d["field_name"], d["metric_id"]))]
    shown = [f"  {e['pair_id']}: {e['verdict']}\n{e['block']}" for e in examples]
    out += ["Decided examples:", *shown] if shown else ["No decided examples."]
    out.append("The table was compared whole." if complete else f"Only {walked or 0} nodes have been compared.")
    return "\n".join(out)


@dataclass(frozen=True)
class Plan:
    calls: int
    prefix_tokens: int
    cache_requested: bool
    cache_eligible: bool
    suggested_examples: int | None
    alternative: str | None


def plan(n_pending: int, n_decided: int, prefix_chars: int, bare_prefix_chars: int, examples: int, cache_floor: int, settings: Settings = Settings(), others: Iterable[str] = (), model: str = "") -> Plan:
    """Calls, and whether the prefix can be cached; if not, how many examples would make it so and which other model would take it.

    ``others``: models that cache a prefix of this size, cheapest first.
    """
    tokens, bare = round(prefix_chars / CHARS_A_TOKEN), round(bare_prefix_chars / CHARS_A_TOKEN)
    eligible = tokens >= cache_floor
    suggested = None
    if not eligible and 0 < examples < n_decided and tokens > bare:
        needed = math.ceil((MARGIN * cache_floor - bare) / ((tokens - bare) / examples))
        suggested = needed if needed <= n_decided else None
    alternative = None if eligible else next((m for m in others if m != model), None)
    return Plan(math.ceil(n_pending / max(1, settings.batch_size)), tokens, settings.cached_prefix, eligible, suggested, alternative)


def job_estimate(history: dict | None, other_history: dict | None, prompt_chars: float | None, units: int, concurrency: int = 4) -> dict:
    """{basis, input, output, ms}: from this model's jobs, else from other models', else from the prompt's size, else nothing.

    A history is {n, input: (mean, sd), output: (mean, sd), ms}; two samples at least.
    """
    for basis, held in (("history", history), ("history-other-model", other_history)):
        if held and held["n"] >= 2:
            return {"basis": basis, **{k: estimate(*held[k], held["n"], units) for k in ("input", "output")}, "ms": round(held["ms"] * units / max(1, concurrency)) if held.get("ms") else None}
    if prompt_chars:
        return {"basis": "prompt-size", **estimate_from_prompt(prompt_chars, OUTPUT_TOKENS_A_PAIR, units), "ms": None}
    return {"basis": "none", "input": None, "output": None, "ms": None}


def with_retries(call: Callable, waits: tuple[float, ...] = (2.0, 6.0), sleep: Callable = time.sleep):
    """``call()``, tried once more after each wait; the last error is raised."""
    for wait in waits:
        try:
            return call()
        except Exception:
            sleep(wait)
    return call()


def classify(batches: list[tuple], ask: Callable[[list], dict], settings: Settings = Settings(), caching: bool = False, stop: Callable[[], bool] = lambda: False, progress: Callable[[int, int], None] = lambda done, all_: None, sleep: Callable = time.sleep) -> dict:
    """{tag in batch: verdict} from ``ask``, which takes the items of a batch and returns verdicts by item.

    Order is kept and so many batches at most run at once. When a prefix is
    cached the first batch goes alone, so that the others find it. Items that a
    batch leaves open are asked one by one, unless it answered none at all.
    """
    out: dict = {}

    def one(batch: list) -> dict:
        if stop():
            return {}
        try:
            got = with_retries(lambda: ask(batch), sleep=sleep)
        except Exception:
            return {}
        if got and len(got) < len(batch):
            for item in [x for x in batch if x not in got]:
                if not stop():
                    try:
                        got |= with_retries(lambda item=item: ask([item]), sleep=sleep)
                    except Exception:
                        continue
        return got

    first = 1 if caching and len(batches) > 1 else 0
    for k in range(first):
        out |= one(batches[k])
        progress(1, len(batches))
    for k, got in enumerate(parallel_map(batches[first:], one, settings.concurrency)):
        out |= got
        progress(first + k + 1, len(batches))
    return out


def token_counts(usage: Column) -> list[Column]:
    """The four token columns of a usage struct; missing ones are 0."""
    names = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_creation_tokens": "cache_creation_input_tokens"}
    return [F.coalesce(usage[b].cast("long"), F.lit(0).cast("long")).alias(a) for a, b in names.items()]


def usd(x: float) -> str:
    return "$0" if x == 0 else "<$0.01" if x < 0.01 else f"${x:,.2f}"


def tokens_text(n: int) -> str:
    return str(n) if n < 1000 else f"{n / 1000:.1f}k" if n < 1_000_000 else f"{n / 1e6:.2f}M"


def duration_text(ms: float) -> str:
    seconds = round(ms / 1000)
    return f"{seconds} s" if seconds < 60 else f"{seconds // 60} min {seconds % 60} s" if seconds < 3600 else f"{seconds // 3600} h {seconds % 3600 // 60} min"
