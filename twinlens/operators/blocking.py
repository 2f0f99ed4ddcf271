"""Candidate pairs: blocking joins of a table with itself.

Every builder takes a table with ``id`` and a value column and returns distinct
(id_a, id_b), id_a < id_b compared as strings. Values travel only as blocking
keys; other properties are joined afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.text import tokens
from twinlens.sources.scratch import materialise

MAX_CANDIDATES, EXHAUSTIVE_LIMIT, BUCKET_CAP = 5_000_000, 500_000, 500
PREFIX_PARTNERS, PREFIX_LENGTH = 50, 8
#: Rows of a chunk of a cell, the same of vectors, and cells that are few enough to be broadcast.
CHUNK, VECTOR_CHUNK, FEW_CELLS = 512, 1024, 10_000


class CandidateLimitError(ValueError):
    """More candidate pairs than the ceiling allows."""


def n_pairs(n: int) -> int:
    return n * (n - 1) // 2


def ids_as_text(nodes: DataFrame, id_col: str, *columns: str) -> DataFrame:
    return nodes.select(F.col(id_col).cast("string").alias("id"), *columns)


def choose_strategy(n: int, asked: str = "auto") -> str:
    """`exhaustive` for small tables under `auto`; an explicit `exhaustive` up to the ceiling."""
    if asked == "auto":
        return "exhaustive" if n_pairs(n) <= EXHAUSTIVE_LIMIT else "token-bucket"
    if asked not in ("exhaustive", "token-bucket", "prefix"):
        raise ValueError(f"unknown strategy: {asked}")
    if asked == "exhaustive" and n_pairs(n) > MAX_CANDIDATES:
        raise CandidateLimitError(f"{n_pairs(n)} pairs, over {MAX_CANDIDATES}")
    return asked


def _cell_units(rows: DataFrame, near: Callable[[DataFrame], DataFrame] | None = None, chunk: int = CHUNK, limit: int | None = None, what: str = "pairs in buckets") -> DataFrame:
    """The units of :func:`keyed_units`, spread over tasks."""
    units, _, n = keyed_units(rows, near, chunk, limit, what)
    return spread(units.select("a", "b", "same"), n)


def spread(units: DataFrame, n: int) -> DataFrame:
    """``n`` units, dealt over as many tasks as they are worth."""
    cores = units.sparkSession.sparkContext.defaultParallelism
    return units.repartition(max(1, min(n, max(4 * cores, min(n // 16, 4096)))))


def keyed_units(rows: DataFrame, near: Callable[[DataFrame], DataFrame] | None = None, chunk: int = CHUNK, limit: int | None = None, what: str = "pairs in buckets") -> tuple[DataFrame, DataFrame, int]:
    """(cell, i, j, a, b, same): units of work that hold every pair of a cell's rows once; ``a`` and ``b`` are arrays of items, of the cell's chunks i and j.

    Also the rows with their ``chunk``, and the number of units.

    ``rows`` has cell and item, a struct with an id. Rows of a cell are dealt over
    chunks of about ``chunk``, and a unit is two chunks, or one with itself
    (``same``): so a task holds two chunks at a time, a large cell is spread over
    many tasks, and what is shuffled for a pair is a small fraction of it. ``near``
    makes (cell, other) of the cells to be paired with another one, each once, from
    a table of cells. Pairs are counted against ``limit`` before any is made.
    """
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    if near is None:
        sizes = sizes.where("n > 1")
    sizes, _ = materialise(sizes.withColumn("k", F.ceil(F.col("n") / chunk)), "cells")
    count = sizes.agg(F.count(F.lit(1)).alias("cells"), F.sum(F.expr("cast(n as decimal(38, 0)) * (n - 1) / 2")).alias("pairs"), F.sum(F.expr("k * (k + 1) / 2")).alias("units")).first()
    if limit is not None and (count["pairs"] or 0) > limit:
        raise CandidateLimitError(f"{count['pairs']:.0f} {what}, over {limit}")
    # Sizes on disk are compressed and tell little of memory: cells are broadcast if they are few, chunks never.
    placed = rows.join(F.broadcast(sizes) if count["cells"] <= FEW_CELLS else sizes.hint("merge"), "cell").withColumn("chunk", F.pmod(F.xxhash64("item.id"), "k"))
    chunks, _ = materialise(placed.groupBy("cell", "chunk").agg(F.collect_list("item").alias("items")), "chunks")
    units, n = chunks.select("cell", F.col("chunk").alias("i"), F.col("chunk").alias("j"), F.col("items").alias("a"), F.col("items").alias("b"), F.lit(True).alias("same")), int(count["units"] or 0)
    steps = lambda lo, hi: F.explode(F.sequence(lo, hi))
    others = sizes.where("k > 1").select("cell", F.col("cell").alias("other"), "k", steps(F.lit(0), F.col("k") - 2).alias("i")).select("cell", "other", "i", steps(F.col("i") + 1, F.col("k") - 1).alias("j"))
    if near is not None:
        beside, _ = materialise(near(sizes.select("cell")).join(sizes.select("cell", "k").hint("merge"), "cell").join(sizes.select(F.col("cell").alias("other"), F.col("k").alias("k2")).hint("merge"), "other"), "near")
        others = others.unionByName(beside.select("cell", "other", "k2", steps(F.lit(0), F.col("k") - 1).alias("i")).select("cell", "other", "i", steps(F.lit(0), F.col("k2") - 1).alias("j")))
        n += int(beside.agg(F.sum(F.expr("k * k2"))).first()[0] or 0)
    left = chunks.select("cell", F.col("chunk").alias("i"), F.col("items").alias("a")).hint("merge")
    right = chunks.select(F.col("cell").alias("other"), F.col("chunk").alias("j"), F.col("items").alias("b")).hint("merge")
    return units.unionByName(others.join(left, ["cell", "i"]).join(right, ["other", "j"]).select("cell", "i", "j", "a", "b", F.lit(False).alias("same"))), placed, n


def _unit_pairs(units: DataFrame) -> DataFrame:
    """(a, b): the items of each pair, never two of one id."""
    both = units.select(F.explode("a").alias("a"), "b", "same").select("a", F.explode("b").alias("b"), "same")
    return both.where("if(same, a.id < b.id, a.id <> b.id)").select("a", "b")


def _ordered(pairs: DataFrame, *columns: Column) -> DataFrame:
    return pairs.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"), *columns)


def _ids_repeat(rows: DataFrame) -> bool:
    """Whether an id has several rows, so that a pair may come twice."""
    return bool(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def exhaustive_pairs(nodes: DataFrame, limit: int | None = MAX_CANDIDATES) -> DataFrame:
    """All pairs of a table; with ``limit`` its size is checked against it first."""
    return _ordered(_unit_pairs(_cell_units(nodes.select(F.lit(0).alias("cell"), F.struct("id").alias("item")), limit=limit, what="pairs")))


def _bucket_pairs(keyed: DataFrame, cap: int | None, limit: int | None = None, single: bool = False) -> DataFrame:
    """Pairs within buckets of (id, key); buckets over ``cap`` are left out, as the strategy defines them.

    With ``limit`` the pairs are counted from the sizes of the buckets before any
    is made. ``single``: each id has one key, so no pair comes twice. A third
    column, weight, says how many nodes an id stands for: caps count nodes, and an
    id of several in a bucket that counts is paired with itself.
    """
    keyed = keyed.distinct()
    weight = F.col("weight") if "weight" in keyed.columns else F.lit(1)
    if cap is None:
        pairs = _ordered(_unit_pairs(_cell_units(keyed.select(F.col("key").alias("cell"), F.struct("id").alias("item")), limit=limit)))
        pairs = pairs if single or not _ids_repeat(keyed) else pairs.distinct()
        return pairs.unionByName(own_pairs(keyed)) if "weight" in keyed.columns else pairs
    sizes = keyed.groupBy("key").agg(F.sum(weight).alias("size")).where(f"size between 2 and {cap}").select("key")
    keyed = keyed.join(sizes, "key")
    a, b = keyed.select("key", F.col("id").alias("id_a"), weight.alias("w")), keyed.select("key", F.col("id").alias("id_b"))
    return a.join(b, "key").where("id_a < id_b or (id_a = id_b and w > 1)").select("id_a", "id_b").distinct()


def own_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs with themselves of the ids that stand for several nodes."""
    return nodes.where("weight > 1").select(F.col("id").alias("id_a"), F.col("id").alias("id_b")).distinct()


def _weighted(nodes: DataFrame) -> list[str]:
    return ["id", "weight"] if "weight" in nodes.columns else ["id"]


def token_pairs(nodes: DataFrame, value: str, cap: int = BUCKET_CAP) -> DataFrame:
    """Pairs that share a white-space token of a bucket of 2 to ``cap`` nodes."""
    return _bucket_pairs(nodes.select(*_weighted(nodes), F.explode(tokens(F.col(value))).alias("key")), cap)


def exact_pairs(nodes: DataFrame, key: Column, limit: int | None = MAX_CANDIDATES, single: bool = False) -> DataFrame:
    """Pairs with an equal key; the key is any normalised value. Null keys pair with nothing.

    Buckets have no cap of their own; all pairs together are checked against the
    ceiling, if there is one, before they are made. ``single``: ids don't repeat.
    """
    return _bucket_pairs(nodes.select(*_weighted(nodes), key.alias("key")).where("key is not null"), None, limit, single)


def phonetic_pairs(nodes: DataFrame, code: Column, limit: int | None = MAX_CANDIDATES, single: bool = False) -> DataFrame:
    """Pairs with an equal, non-empty phonetic code; ceiling and ``single`` as in :func:`exact_pairs`."""
    return _bucket_pairs(nodes.select(*_weighted(nodes), code.alias("key")).where("key <> ''"), None, limit, single)


def numeric_pairs(nodes: DataFrame, value: str, min_score: float = 0.0, limit: int | None = MAX_CANDIDATES) -> DataFrame:
    """(id_a, id_b, score): numeric neighbours.

    A floor strictly between 0 and 1 makes it a band join: values of a pair lie in
    the same or the next logarithmic band of their sign. Without a floor every pair
    of positive score counts, which is all pairs of one sign: with ``limit`` the
    table's size is checked first. Ids may repeat; a pair's score is its best.
    """
    rows = nodes.select("id", F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    score = F.greatest(F.lit(0.0), 1 - F.abs(F.col("a.v") - F.col("b.v")) / F.greatest(F.abs("a.v"), F.abs("b.v"), F.lit(1.0))).alias("score")
    item = F.struct("id", "v").alias("item")
    if not 0 < min_score < 1:
        pairs = _ordered(_unit_pairs(_cell_units(rows.select(F.lit(0).alias("cell"), item), limit=limit, what="pairs: numeric neighbours without a floor are all pairs")), score).where("score > 0")
    else:
        # Values of size below 1 are compared on an absolute scale: they are band 0 of sign 0, which reaches into bands 0 and 1
        # of both signs. Bands are wider than the floor asks by more than a logarithm is rounded.
        step = -math.log(min_score) * (1 + 1e-6)
        band = F.floor(F.log(F.greatest(F.abs("v"), F.lit(1.0))) / step).cast("long")
        sign = F.when(F.abs("v") <= 1, 0).otherwise(F.signum("v")).cast("int")

        def beside(cells: DataFrame) -> DataFrame:
            at = F.col("cell.s") == 0
            near_zero = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(b).cast("long").alias("b")) for s in (-1, 1) for b in (0, 1)])
            return cells.select("cell", F.explode(F.when(at, near_zero).otherwise(F.array(F.struct(F.col("cell.s").alias("s"), (F.col("cell.b") + 1).alias("b"))))).alias("other"))

        units = _cell_units(rows.select(F.struct(sign.alias("s"), band.alias("b")).alias("cell"), item), beside)
        pairs = _ordered(_unit_pairs(units), score).where(F.col("score") >= min_score)
    return pairs.groupBy("id_a", "id_b").agg(F.max("score").alias("score")) if _ids_repeat(rows) else pairs


def prefix_pairs(nodes: DataFrame, value: str, length: int = PREFIX_LENGTH, partners: int = PREFIX_PARTNERS) -> DataFrame:
    """Pairs whose later value (by value, then id) starts with the earlier one's prefix; each walker has its first ``partners``.

    Case-sensitive. The work is rows times ``partners``, however large a block is;
    a walker's partners are gathered in a sorted pass over its block that spills.
    """
    if length < 1:
        raise ValueError("a prefix has a character at least")
    rows = nodes.select("id", F.col(value).cast("string").alias("v")).where("v <> ''")  # empty values pair with nothing
    # In (value, id) order the partners of a node are the rows right behind it that start with its prefix.
    order = Window.partitionBy("block").orderBy("v", "id")
    behind = F.collect_list("id").over(order.rowsBetween(1, partners))
    walks = rows.where(F.length("v") >= length).select("id", "v", F.substring("v", 1, length).alias("block")).select(F.col("id").alias("w"), behind.alias("ms"))
    # A value shorter than the prefix is its own block and meets longer ones: those blocks are the few short values that occur.
    short, _ = materialise(rows.where(F.length("v") < length).groupBy(F.col("v").alias("block")).agg(F.count(F.lit(1)).alias("walkers")), "prefix-short")
    if blocks := short.count():
        cuts = F.transform(F.sequence(F.lit(1), F.least(F.lit(length - 1), F.length("v"))), lambda k: F.substring(F.col("v"), F.lit(1), k))
        starts = rows.select("id", "v", F.explode(cuts).alias("block")).join(F.broadcast(short) if blocks <= FEW_CELLS else short.hint("merge"), "block")
        # Of each block the walkers are its first rows; their partners lie among them and right behind the last one.
        first = starts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("walkers") + partners)
        walks = walks.unionByName(first.select("v", "block", F.col("id").alias("w"), behind.alias("ms")).where("v = block").select("w", "ms"))
    pairs = walks.select("w", F.explode("ms").alias("m")).where("w <> m").select(F.least("w", "m").alias("id_a"), F.greatest("w", "m").alias("id_b"))
    return pairs.distinct() if _ids_repeat(rows) else pairs


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The clamped dot product of each pair of a unit: 0 where lengths differ or a component is missing, 1 if not a number."""

    def parts(items: pa.StructArray):
        v = items.field("v")
        flat, lengths = v.flatten(), v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        whole = np.ones(len(lengths), bool)
        if flat.null_count:
            whole[np.repeat(np.arange(len(lengths)), lengths)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
        return items.field("id"), flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), lengths, starts, whole

    for batch in batches:
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            (ids_a, x, len_a, at_a, whole_a), (ids_b, y, len_b, at_b, whole_b) = (parts(column[c][r].values) for c in ("a", "b"))
            n, score = len(ids_a), np.zeros((len(ids_a), len(ids_b)))
            for size in np.intersect1d(len_a, len_b):
                i, j = np.flatnonzero((len_a == size) & whole_a), np.flatnonzero((len_b == size) & whole_b)
                with np.errstate(invalid="ignore", over="ignore"):
                    dots = x[at_a[i][:, None] + np.arange(size)] @ y[at_b[j][:, None] + np.arange(size)].T
                score[np.ix_(i, j)] = np.where(np.isnan(dots), 1.0, np.clip(dots, 0.0, 1.0))
            ids = pa.concat_arrays([ids_a, ids_b])
            rank = pc.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy()
            first, second, step = rank[:n, None], rank[None, n:], max(1, 131_072 // max(1, len(ids_b)))
            for lo in range(0, n, step):
                i, j = np.nonzero(first[lo : lo + step] < second if column["same"][r].as_py() else first[lo : lo + step] != second)
                i += lo
                ahead = rank[i] < rank[n + j]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.where(ahead, i, n + j))), ids.take(pa.array(np.where(ahead, n + j, i))), pa.array(score[i, j])], ["id_a", "id_b", "score"])


def vector_pairs(nodes: DataFrame, vector: str, limit: int | None = MAX_CANDIDATES) -> DataFrame:
    """(id_a, id_b, score): the cosine of all pairs of a table; with ``limit`` its size is checked against it first."""
    rows = nodes.where(F.col(vector).isNotNull()).select(F.lit(0).alias("cell"), F.struct("id", F.col(vector).alias("v")).alias("item"))
    return _cell_units(rows, chunk=VECTOR_CHUNK, limit=limit, what="pairs of vectors").mapInArrow(_cosines, "id_a string, id_b string, score double")


def union_candidates(*pairs: DataFrame, limit: int | None = MAX_CANDIDATES) -> DataFrame:
    """Distinct pairs of several strategies, checked against the ceiling."""
    out = pairs[0].select("id_a", "id_b")
    for more in pairs[1:]:
        out = out.unionByName(more.select("id_a", "id_b"))
    out = out.where("id_a <> id_b").distinct()
    if limit is not None and (n := out.count()) > limit:
        raise CandidateLimitError(f"{n} pairs, over {limit}")
    return out


def token_pair_bound(nodes: DataFrame, value: str, cap: int = BUCKET_CAP) -> DataFrame:
    """(n_candidates): pairs of all buckets of 2 to ``cap`` nodes, each counted once for each token shared."""
    sizes = nodes.select("id", F.explode(F.array_distinct(tokens(F.col(value)))).alias("key")).groupBy("key").agg(F.countDistinct("id").alias("n"))
    return sizes.where(f"n between 2 and {cap}").agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("n_candidates"))


def value_pair_bound(nodes: DataFrame, value: str) -> DataFrame:
    """(n_candidates): pairs of equal raw values, without a cap."""
    sizes = nodes.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("n_candidates"))
