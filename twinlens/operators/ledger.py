"""Usage ledger, pricing and the plumbing around batch classification."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.sources.scratch import materialise

TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
RESPONSE_DDL = "array<struct<tag:string,verdict:string,reason:string>>"


def usage_totals(calls: DataFrame) -> DataFrame:
    """Totals of all calls, by kind and by model, in one pass of grouping sets."""
    sums = [F.sum(c).alias(c) for c in TOKEN_COLUMNS]
    return calls.groupingSets([[], [F.col("kind")], [F.col("model")]], "kind", "model").agg(F.count(F.lit(1)).alias("calls"), *sums, F.sum("cost_usd").alias("cost_usd"), F.count_if(~F.col("priced")).alias("unpriced"))


def job_samples(jobs: DataFrame, kind: str, variant: str, model: str | None = None, concurrency: int = 4, latest: int = 20) -> DataFrame:
    """Per-unit tokens and time of the latest finished jobs of a kind."""
    rows = jobs.where((F.col("kind") == kind) & (F.col("variant") == variant) & F.col("status").isin("complete", "cancelled") & (F.col("units_completed") > 0))
    if model:
        rows = rows.where(F.col("model") == model)
    units = F.col("units_completed")
    return rows.orderBy(F.col("started_at").desc(), "id").limit(latest).select("id", (F.col("input_tokens") / units).alias("input_per_unit"), (F.col("output_tokens") / units).alias("output_per_unit"), ((F.col("ended_at") - F.col("started_at")) * concurrency / units).alias("ms_per_unit"))


def job_totals(jobs: DataFrame, calls: DataFrame) -> DataFrame:
    """Jobs with the running totals of their calls: call_count, the four token counts, cost_usd."""
    sums = calls.groupBy("job_id").agg(F.count(F.lit(1)).alias("call_count"), *[F.sum(c).alias(c) for c in TOKEN_COLUMNS], F.sum("cost_usd").alias("cost_usd"))
    kept = [c for c in jobs.columns if c not in ("call_count", *TOKEN_COLUMNS, "cost_usd")]
    joined = jobs.select(*kept).join(sums, jobs["id"] == sums["job_id"], "left").drop("job_id")
    return joined.select(*kept, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("call_count", *TOKEN_COLUMNS, "cost_usd")])


def mean_and_spread(samples: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """(mean, sd, n), in each group of ``by``; sd is that of a sample, 0 below two values."""
    return samples.groupBy(*by).agg(F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("sd"), F.count(column).alias("n"))


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with their cost: tokens per million by rate; cache writes at 1.25 times the input rate, reads at a tenth, unless a rate is given."""
    known = calls.join(prices, "model", "left")
    write = F.coalesce("cache_write_rate", F.col("input_rate") * 1.25)
    read = F.coalesce("cache_read_rate", F.col("input_rate") * 0.1)
    cost = (F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate") + F.col("cache_creation_tokens") * write + F.col("cache_read_tokens") * read) / 1e6
    return known.withColumn("priced", F.col("input_rate").isNotNull() & F.col("output_rate").isNotNull()).withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).select(*[c for c in calls.columns if c not in ("priced", "cost_usd")], "priced", "cost_usd")


def batches(pairs: DataFrame, size: int = 20, order: str = "pair_id") -> DataFrame:
    """Pending pairs with batch number and tag P1, P2, ... within it."""
    # Sorted in parallel and written out; numbers are offsets of the sorted parts plus places within them.
    held, _ = materialise(pairs.where("verdict = 'pending'").orderBy(order).withColumn("_row", F.monotonically_increasing_id()), "pending")
    held = held.withColumn("_part", F.shiftright("_row", 33))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    ranked = held.join(parts, "_part").withColumn("_rn", F.col("_before") + F.col("_row") - F.shiftleft("_part", 33)).drop("_part", "_row", "_before")
    return ranked.withColumn("batch", F.floor(F.col("_rn") / size)).withColumn("tag", F.concat(F.lit("P"), (F.col("_rn") % size + 1).cast("string"))).drop("_rn")


def few_shot(decided: DataFrame, count: int = 20) -> DataFrame:
    """Examples balanced over both verdicts, spread by stride over the score ranking, human ones before others."""
    half = math.ceil(count / 2)
    who = F.when(F.col("decided_by") == "human", 0).otherwise(1)
    w = Window.partitionBy("verdict", who).orderBy(F.col("max_score").desc(), "pair_id")
    sized = decided.where("verdict in ('duplicate', 'distinct')").withColumn("part", who).withColumn("rn", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("verdict", who)))
    human = F.max(F.when(F.col("part") == 0, F.col("n"))).over(Window.partitionBy("verdict"))
    room = F.when(F.col("part") == 0, F.least("n", F.lit(half))).otherwise(F.greatest(F.lit(0), F.lit(half) - F.coalesce(human, F.lit(0))))
    spread = sized.withColumn("room", F.least("n", room))
    i = F.ceil(F.col("rn") * F.col("room") / F.col("n"))
    taken = spread.where((F.col("room") > 0) & (i < F.col("room")) & (F.floor(i * F.col("n") / F.col("room")) == F.col("rn")))
    return taken.select("pair_id", "verdict", "part", "max_score")


def parse_responses(responses: DataFrame, asked: DataFrame) -> DataFrame:
    """(batch, tag, verdict): the first valid answer for each tag asked, null where none came. Fences around JSON are taken off."""
    bare = F.regexp_replace(F.trim("raw"), r"^```[a-zA-Z]*\s*|\s*```$", "")
    answers = responses.select("batch", F.posexplode(F.from_json(bare, RESPONSE_DDL)).alias("pos", "a")).select("batch", "pos", "a.tag", "a.verdict").where("verdict in ('duplicate', 'distinct')")
    first = answers.groupBy("batch", "tag").agg(F.min_by("verdict", "pos").alias("answer"))
    return asked.select("batch", "tag").join(first, ["batch", "tag"], "left").withColumnRenamed("answer", "verdict")


def pair_block(tag: str = "tag") -> Column:
    """The text of a pair for a prompt: tag, both displays, scores to three places."""
    scored = F.array_join(F.transform("scores", lambda s: F.format_string("%s/%s %.3f%s", s["field_name"], s["metric_id"], s["score"], F.when(s["above_threshold"], F.lit(" ✓")).otherwise(F.lit("")))), "; ")
    return F.concat(F.lit("["), F.col(tag), F.lit("]\nA: "), F.col("display_a"), F.lit("\nB: "), F.col("display_b"), F.lit("\n"), scored)


def parallel_map(items: list, function, limit: int = 4) -> list:
    """Results in order, at most ``limit`` at a time."""
    with ThreadPoolExecutor(max_workers=max(1, limit)) as pool:
        return list(pool.map(function, items))


def estimate(per_unit: float, sd: float, samples: int, units: int) -> tuple[float, float, float] | None:
    """(low, middle, high) from history, a standard deviation either way; needs two samples."""
    if samples < 2:
        return None
    return max(0.0, (per_unit - sd) * units), per_unit * units, (per_unit + sd) * units


def estimate_from_prompt(chars: int, output_hint: float, units: int) -> dict[str, tuple[float, float, float]]:
    """From the size of a prompt: 3.6 characters a token, a quarter either way in, two fifths out."""
    tokens, out = chars / 3.6 * units, output_hint * units
    return {"input": (tokens * 0.75, tokens, tokens * 1.25), "output": (out * 0.6, out, out * 1.4)}
