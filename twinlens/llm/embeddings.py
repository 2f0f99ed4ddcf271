"""Near-duplicate embeddings by a subspace pigeonhole join.

Normalised vectors are rotated and split into low-dimensional blocks. Two
vectors of cosine >= c are at squared distance <= 2 - 2c, so in some block their
squared distance is at most that block's share of the budget. Each block is
range-joined on its own: a grid over its two leading axes brings vectors
together, those within the block's radius of a neighbouring cell join it as
guests, and cells are cut into chunks so that no task holds more than a chunk of
either side. What
is within a block's budget is verified on the whole vectors in double precision
and counted in the first such block only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.operators.components import connected_components
from twinlens.sources.scratch import materialise

#: Smaller blocks would each be joined on nearly all pairs where variance is spread evenly: 5.7 times all pairs on 64 such axes with blocks of 8, 3.5 times with 16.
BLOCK_DIMS, FIT_ROWS, CHUNK = 16, 4096, 16_384
_SLACK = 1e-6


class Rotation:
    """An orthogonal basis for vectors of one length, its blocks and their shares of the budget."""

    def __init__(self, dims: int, sample: np.ndarray | None = None, block_dims: int = BLOCK_DIMS):
        n_blocks = max(1, dims // block_dims)
        if sample is not None and len(sample) >= 2:
            _, basis = np.linalg.eigh(np.cov(sample.T).reshape(dims, dims))
            basis = basis[:, ::-1]
        else:
            basis, _ = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
        # Axes are dealt out in turn: each block gets leading and trailing ones, the leading ones first.
        self.blocks = [list(range(b, dims, n_blocks)) for b in range(n_blocks)]
        self.basis = basis
        spread = np.var(sample @ basis, axis=0) if sample is not None and len(sample) >= 2 else np.ones(dims)
        share = np.array([spread[b].sum() + 1e-9 for b in self.blocks])
        self.share = 0.5 * share / share.sum() + 0.5 / n_blocks


def _unit(column: pa.Array) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for row in column.to_pylist():
        if not row or any(v is None for v in row):
            out.append(None)
            continue
        x = np.array(row, dtype=np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0.0:
            out.append(None)
            continue
        x = x / top
        out.append(x / math.sqrt(float(x @ x)))
    return out


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = _unit(batch.column(1))
        yield pa.record_batch(
            [batch.column(0), pa.array([None if u is None else u.tobytes() for u in units], pa.binary()), pa.array([None if u is None else len(u) for u in units], pa.int32())],
            names=["id", "unit", "dims"],
        )


def _cells_of(rotation: Rotation, turned: np.ndarray, block: int, budget: float) -> Iterator[tuple[int, int, bool]]:
    """Home cell of a vector in a block, and half of the neighbouring cells, of those that its radius reaches: each pair of cells meets once."""
    axes = rotation.blocks[block]
    radius = math.sqrt(budget * rotation.share[block]) * (1 + _SLACK) + 1e-12
    width = 2 * radius
    at = [float(turned[axes[k]]) if k < len(axes) else 0.0 for k in (0, 1)]
    c = [math.floor(v / width) for v in at]
    gap = [((c[k] + 1) * width - at[k], at[k] - c[k] * width) for k in (0, 1)]  # to the cell above, to the cell below
    yield c[0], c[1], True
    for i, j in ((0, 1), (1, -1), (1, 0), (1, 1)):
        away = (gap[0][0] if i else 0.0) ** 2 + (gap[1][0] if j > 0 else gap[1][1] if j < 0 else 0.0) ** 2
        if away <= radius * radius * (1 + _SLACK):
            yield c[0] + i, c[1] + j, False


_DEALT = {"block": pa.int32(), "dims": pa.int32(), "c0": pa.int32(), "c1": pa.int32(), "home": pa.bool_(), "id": pa.int64(), "weight": pa.int64(), "unit": pa.binary()}


def _deal(rotations: dict[int, Rotation], budget: float, whole: bool):
    """The memberships of each vector; ``whole`` with its id, weight and components."""
    names = list(_DEALT)[: None if whole else 5]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _DEALT]
            for vec, weight, unit, dims in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rotation = rotations.get(dims) or rotations.setdefault(dims, Rotation(dims))
                turned = np.frombuffer(unit) @ rotation.basis
                for b in range(len(rotation.blocks)):
                    for x, y, home in _cells_of(rotation, turned, b, budget):
                        for held, value in zip(out, (b, dims, x, y, home, vec, weight, unit), strict=True):
                            held.append(value)
            yield pa.record_batch([pa.array(v, t) for v, t in zip(out, _DEALT.values(), strict=True)][: len(names)], names=names)

    return deal


def _match(rotations: dict[int, Rotation], budget: float, least: float):
    """Links between a chunk of a cell's home vectors and a chunk of all its vectors."""

    def match(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": np.empty(0, np.int64), "near": np.empty(0, np.int64), "least": np.empty(0, np.int64)})
        block, dims = int(key[0]), int(key[1])
        left, right = rows[rows["role"] != 2], rows[rows["role"] != 1]
        left = left[left["home"]]
        if not len(left) or not len(right):
            return none
        rotation = rotations.get(dims) or rotations.setdefault(dims, Rotation(dims))
        x, y = (np.frombuffer(b"".join(s["unit"]), dtype=np.float64).reshape(-1, dims) for s in (left, right))
        axes = rotation.blocks[block]
        px, py = ((v @ rotation.basis[:, axes]).astype(np.float32) for v in (x, y))
        within = budget * rotation.share * (1 + _SLACK) + 1e-12
        ids_x, ids_y = left["id"].to_numpy(), right["id"].to_numpy()
        guest = ~right["home"].to_numpy()
        linked_i, linked_j = [], []
        step = max(1, (1 << 20) // len(y))
        yy = (py * py).sum(axis=1)
        for a in range(0, len(x), step):
            p = px[a : a + step]
            apart = p @ (-2 * py.T)
            apart += (p * p).sum(axis=1)[:, None]
            apart += yy
            i, j = np.nonzero(apart <= np.float32(within[block] + 1e-5))
            i += a
            # Of two vectors at home here, the pair is seen once; a guest meets each vector at home.
            keep = guest[j] | (ids_x[i] < ids_y[j])
            i, j = i[keep], j[keep]
            for c in range(0, len(i), 1 << 14):
                ii, jj = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
                u, v = x[ii], y[jj]
                near = np.einsum("ij,ij->i", u, v) >= least
                if not near.any():
                    continue
                # For each pair by itself in double precision, so that all blocks agree which comes first.
                parts = np.einsum("ij,jk->ik", u[near] - v[near], rotation.basis)
                parts = np.stack([(parts[:, ax] ** 2).sum(axis=1) for ax in rotation.blocks], axis=1)
                first = (parts <= within).argmax(axis=1) == block
                linked_i.append(ii[near][first])
                linked_j.append(jj[near][first])
        i = np.concatenate(linked_i) if linked_i else np.empty(0, np.int64)
        if not len(i):
            return none
        j = np.concatenate(linked_j)
        # What leaves the task grows with its vectors, not with its pairs.
        wx, wy = left["weight"].to_numpy(), right["weight"].to_numpy()
        ids = np.concatenate([ids_x[i], ids_y[j]])
        every, at = np.unique(ids, return_inverse=True)
        near = np.bincount(at, weights=np.concatenate([wy[j], wx[i]]), minlength=len(every)).astype(np.int64)
        return pd.DataFrame({"id": every, "near": near, "least": every[_roots(at[: len(i)], at[len(i) :], len(every))]})

    return match


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest vertex of each vertex's component, for n vertices and edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block_dims: int = BLOCK_DIMS, chunk: int = CHUNK) -> DataFrame:
    """A row per vector: id, n_links, component_id, kept, for links of cosine >= ``cosine``.

    Vectors of any length are compared whole, in double precision. Null and zero vectors, those with a null or non-finite component and rows
    with a null id link with nothing (component_id is the id itself). Vectors
    link only with vectors of their own length. Equal vectors form one class of
    a weight, so copies aren't multiplied into pairs. Every input row comes out;
    rows of one id and one direction count once in links, and each has the same
    result. Labels and other columns are not read. An empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    budget = 2.0 - 2.0 * cosine
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(_normalise, "id long, unit binary, dims int")
    held, _ = materialise(rows.withColumn("key", F.sha2("unit", 256)), "units")
    sound = held.where("id is not null and unit is not null")
    # Repeated rows count once in classes and links, and come back when the result is joined to every row.
    classes, _ = materialise(sound.select("key", "id").distinct().groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "vector-classes")
    reps, _ = materialise(sound.join(classes, ["key", "id"]).dropDuplicates(["key", "id"]).select("id", "weight", "unit", "dims"), "representatives")

    # The rotation is fitted on a bounded sample by hash; any orthogonal basis gives the same links.
    rotations: dict[int, Rotation] = {}
    sample = reps.orderBy(F.xxhash64("id")).limit(FIT_ROWS).select("unit", "dims").collect()
    for dims in {r["dims"] for r in sample}:
        rotations[dims] = Rotation(dims, np.array([np.frombuffer(r["unit"]) for r in sample if r["dims"] == dims]), block_dims)

    cell = ["block", "dims", "c0", "c1"]
    ddl = "block int, dims int, c0 int, c1 int, home boolean"
    # Chunks of a cell's home vectors and of all its vectors, by hash; only cells with someone at home count.
    counted = reps.mapInArrow(_deal(rotations, budget, False), ddl).groupBy(*cell).agg(F.count_if("home").alias("n_home"), F.count(F.lit(1)).alias("n_all")).where("n_home > 0")
    sizes, _ = materialise(counted.select(*cell, F.ceil(F.col("n_home") / chunk).cast("int").alias("homes"), F.ceil(F.col("n_all") / chunk).cast("int").alias("alls")), "cells")
    placed = reps.mapInArrow(_deal(rotations, budget, True), f"{ddl}, id long, weight long, unit binary").join(sizes, cell)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    # Role 0: a cell of one chunk, each vector once. Else role 1: a home vector, for each chunk of the others; role 2: any vector, for each home chunk.
    as_home = F.transform(F.sequence(F.lit(0), F.col("alls") - 1), lambda q: F.struct(mine("homes").alias("p"), q.alias("q"), F.lit(1).alias("role")))
    as_other = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda p: F.struct(p.alias("p"), mine("alls").alias("q"), F.lit(2).alias("role")))
    roles = F.when(F.col("alls") == 1, F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("role")))).when(F.col("home"), F.concat(as_home, as_other)).otherwise(as_other)
    sent = placed.withColumn("task", F.explode(roles)).select(*cell, "task.p", "task.q", "task.role", "home", "id", "weight", "unit")
    found, _ = materialise(sent.groupBy(*cell, "p", "q").applyInPandas(_match(rotations, budget, cosine), "id long, near long, least long"), "links")
    near = found.groupBy("id").agg(F.sum("near").alias("near"))
    comps = connected_components(found.select(F.col("id").alias("a"), F.col("least").alias("b")))
    placed_classes = classes.join(near, "id", "left").join(comps, "id", "left").select("key", F.col("weight"), F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("component", "id").alias("component"))
    return (
        held.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(placed_classes, "key", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce(F.col("near") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.expr(f"{id_col} is null or {id_col} = component_id"))
    )
