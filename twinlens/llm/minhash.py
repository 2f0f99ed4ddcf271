"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Plan: one pass over the texts gives each row a digest (a hash of id and text, set
size, a 128-bit key of its shingle set, band hashes, a short sketch). Rows of
equal sets become one class; only one row of a class is banded. In each bucket
all members are first compared with the bucket's smallest member (as many pairs
as memberships), verified links are contracted, and only buckets that still hold
several components give further pairs, across components. Pairs are confirmed
on full shingle sets rebuilt from the texts; a bitmap of the candidates keeps
other texts out of the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.sources.bitmap import bitmap_of, with_hit
from twinlens.llm.hashing import mix, shingle_set, similarity_sketch, texts_utf8, word_hashes
from twinlens.llm.memory import give_back, small_batches
from twinlens.operators.components import connected_components
from twinlens.sources.scratch import drop, materialise

#: 40 bands of 6 coordinates: a pair of similarity 0.85 shares no band with probability 6e-9, one of 0.8 with 3e-6.
BANDS, ROWS = 40, 6
#: Coordinates of a sketch: the first BANDS * ROWS make the bands, two bits of each make the packed sketch.
BINS = 1024
#: Pairs across components are verified if their two-bit sketches differ by no more than this many standard deviations over what the threshold gives.
SPREAD = 6.0
#: A verifying task holds the shingle sets of so many documents of so many shingles at most (8 MB) for their next pair.
RECENT, SHORT = 1024, 1024


def _two_bits(sketch: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, as two planes of packed longs: coordinates that differ give different bits in three of four cases."""
    mixed = mix(sketch)
    planes = [np.packbits(((mixed >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)) for k in range(2)]
    return np.concatenate([np.concatenate((p, np.zeros(-len(p) % 8, np.uint8))).view(np.int64) for p in planes])


def _digest_rows(width: int, bands: int, rows: int, bins: int):
    schema = pa.schema([("doc", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
    lanes = np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    band_no = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for doc, v, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_utf8(batch.column(2)), strict=True):
                items = shingle_set(word_hashes(raw), width) if raw is not None else ()
                row = (doc, v, len(items), None, None, None, None)
                if len(items):
                    keys = [int(mix(items + np.uint64(s)).sum(dtype=np.uint64).view(np.int64)) for s in (11, 23)]
                    sketch = similarity_sketch(items, bins)
                    hashed = mix((mix(sketch[: bands * rows].reshape(bands, rows) + lanes)).sum(axis=1, dtype=np.uint64) + band_no)
                    row = (doc, v, len(items), *keys, hashed.view(np.int64), _two_bits(sketch))
                for held, value in zip(out, row, strict=True):
                    held.append(value)
            yield pa.record_batch([pa.array(v, type=f.type) for v, f in zip(out, schema, strict=True)], schema=schema)
        give_back()

    return digest


def _verify(width: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_set, recent = None, None, {}
        for batch in batches:
            good_a, good_b = [], []
            ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            texts = zip(texts_utf8(batch.column(2)), texts_utf8(batch.column(3)), strict=True)
            for (a, b), (text_a, text_b) in zip(ids, texts, strict=True):
                if a != held:
                    held, held_set = a, shingle_set(word_hashes(text_a), width)
                other = recent.get(b)
                if other is None:
                    other = shingle_set(word_hashes(text_b), width)
                    if len(other) <= SHORT:
                        if len(recent) >= RECENT:
                            recent.clear()
                        recent[b] = other
                both = len(np.intersect1d(held_set, other, assume_unique=True))
                if den * both >= num * (len(held_set) + len(other) - both):
                    good_a.append(a)
                    good_b.append(b)
            yield pa.record_batch([pa.array(good_a, pa.int64()), pa.array(good_b, pa.int64())], schema=schema)
        recent.clear()
        give_back()

    return verify


def _differing(x: str, y: str, lanes: int) -> str:
    """SQL for in how many coordinates two sketches of two planes of ``lanes`` longs differ."""
    return " + ".join(f"bit_count(({x}[{k}] ^ {y}[{k}]) | ({x}[{k + lanes}] ^ {y}[{k + lanes}]))" for k in range(lanes))


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text, nulls told apart."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(text_col).isNull(), F.col(text_col))


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: float, bands: int, rows: int) -> tuple[DataFrame, str]:
    """(doc, v, n, component, least) of each row, written out, and its path.

    ``v`` is :func:`row_key`, ``component`` a number of the row's group (null
    without words), ``least`` the smallest id in the group, null if it has none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), row_key(id_col, text_col).alias("v"), F.col(text_col).alias("text"))
    limit = Fraction(str(threshold))
    bins = max(BINS, bands * rows)
    digests, digests_path = materialise(source.mapInArrow(_digest_rows(width, bands, rows, bins), "doc long, v long, n long, k1 long, k2 long, bands array<long>, sketch array<long>"), "digests")
    filled = digests.where("n > 0")
    order = F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), "v")  # null ids last
    classes, classes_path = materialise(filled.groupBy("k1", "k2").agg(F.min(order).alias("rep"), F.min("doc").alias("least")).select("k1", "k2", F.col("rep.v").alias("rep"), "least"), "classes")

    # One row of a class stands for it: a class of any size is one member of its buckets.
    chosen = filled.select("k1", "k2", "doc", "v", "bands").join(classes.select("k1", "k2", F.col("rep").alias("v")), ["k1", "k2", "v"]).dropDuplicates(["k1", "k2", "v"])
    members, members_path = materialise(chosen.select(order.alias("member"), F.explode("bands").alias("bucket")).select("bucket", "member.doc", "member.v"), "members")
    crowd, crowd_path = materialise(_shared_buckets(members), "buckets")
    drop(spark, members_path)
    sharing, sharing_path = bitmap_of(crowd.select("v"), "v")
    sketches = with_hit(filled.select("v", "n", "bands", "sketch"), "v", sharing).where("_hit").drop("_hit")
    sizes, sizes_path = materialise(sketches.join(crowd.select("v").distinct(), "v", "left_semi").dropDuplicates(["v"]), "sizes")

    lanes = -(-bins // 64)
    odd = 0.75 * (1 - float(limit))
    allowed = math.ceil(bins * odd + SPREAD * math.sqrt(bins * odd * (1 - odd)))
    close = f"least(x.n, y.n) * {limit.denominator}L >= {limit.numerator}L * greatest(x.n, y.n) and {_differing('x.sketch', 'y.sketch', lanes)} <= {allowed}"

    hub_pairs = crowd.where("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct()
    sized = sizes.select("v", "n", "sketch")
    hub_close = hub_pairs.join(sized.alias("x"), F.expr("a = x.v")).join(sized.alias("y"), F.expr("b = y.v")).where(close).select("a", "b")
    tested, tested_path = materialise(hub_close, "tested")
    links, links_path = materialise(_verified(source, tested, width, limit), "links")
    comps, comps_path = materialise(connected_components(links), "components")

    # Buckets that still hold several components: pairs across them whose sizes and sketches allow the threshold.
    # Sketches are compared within the join, so what it puts out are likely links and not all pairs of a bucket.
    placed = crowd.join(comps.select(F.col("id").alias("v"), "component"), "v", "left").select("bucket", "v", F.coalesce("component", "v").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    left, left_path = materialise(placed.join(mixed, "bucket").join(sizes, "v"), "mixed")
    x, y = left.alias("x"), left.alias("y")
    # A pair that shares several buckets is put out by the first of its bands only.
    once = "coalesce(get(x.bands, cast(array_position(zip_with(x.bands, y.bands, (p, q) -> p = q), true) as int) - 1) = x.bucket, true)"
    across = F.expr(f"x.bucket = y.bucket and x.v < y.v and x.component <> y.component and {close} and {once}")
    alike = (
        x.join(y, across).select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
        .join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    late, late_path = materialise(alike, "late")
    more = _verified(source, late, width, limit)
    whole, whole_path = materialise(connected_components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")

    placed_classes, placed_path = materialise(classes.join(whole.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "least", F.coalesce("component", "rep").alias("component")), "placed-classes")
    lowest = placed_classes.groupBy("component").agg(F.min("least").alias("least"))
    roots = placed_classes.select("k1", "k2", "component").join(lowest, "component")
    found = materialise(digests.select("doc", "v", "n", "k1", "k2").join(roots, ["k1", "k2"], "left").select("doc", "v", "n", "component", "least"), "grouped")
    drop(spark, digests_path, classes_path, crowd_path, sharing_path, sizes_path, tested_path, links_path, comps_path, left_path, late_path, whole_path, placed_path)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Components of documents whose sets of ``width``-word shingles have Jaccard similarity >= ``threshold``.

    Words are maximal runs without ASCII white space, A-Z lower-cased. Returns a
    row per input row: doc_id, n_shingles, component_id (smallest id reachable),
    kept (doc_id = component_id).

    Null text, empty text and text without words: an empty set, no links, kept.
    Fewer than ``width`` words: the whole sequence is the one shingle. A null id
    links like any other; its component_id is null only if no row of its
    component has an id, and then it is kept. Repeated rows and ties: equal sets
    form one class whose smallest id counts; different texts under one id are
    linked by their own sets. An empty table gives an empty result. Other
    columns are not read, whatever their names. Texts are never cut. Memory: one
    text and its shingle hashes at a time, besides Arrow batches.
    """
    found, _ = grouped(docs, id_col, text_col, width, threshold, bands, rows)
    component = F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("least"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.expr("component_id is null or doc_id <=> component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each component the row of the smallest id stays, null ids last; ties by hash of the text.

    Rows without words stay, all of them. Rows repeated under one id with one
    text give one row; different texts under one id are judged by themselves.
    Only texts that may go are shuffled.
    """
    spark = docs.sparkSession
    found, found_path = grouped(docs, id_col, text_col, width, threshold, bands, rows)
    filled = found.where("component is not null")
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "v")
    best = filled.groupBy("component").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1").select("component", F.col("best.v").alias("v"))
    stay, stay_path = materialise(best, "stay")
    # Rows of components of several rows are in question; the others stay as they are.
    asked, asked_path = materialise(filled.join(stay.select("component"), "component", "left_semi").select("v").distinct(), "asked")
    bitmap, bitmap_path = bitmap_of(asked, "v")
    rows_ = with_hit(docs.withColumn("_v", row_key(id_col, text_col)), "_v", bitmap)
    tried = rows_.where("_hit")
    out = rows_.where("not _hit").unionByName(
        tried.join(asked.withColumnRenamed("v", "_v"), "_v", "left_anti")
    ).unionByName(tried.join(stay.select(F.col("v").alias("_v")), "_v", "left_semi").dropDuplicates(["_v"]))
    drop(spark, found_path)
    return out.select(*docs.columns)


def _shared_buckets(members: DataFrame) -> DataFrame:
    """Memberships of buckets with two members or more, with the member of the smallest id (an original tends to stand before its copies); members are shuffled once, for both sides of the join."""
    dealt = members.repartition("bucket")
    hubs = dealt.groupBy("bucket").agg(F.min(F.struct("doc", "v")).alias("hub"), F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high").select("bucket", F.col("hub.v").alias("hub"))
    return dealt.join(hubs, "bucket").select("bucket", "v", "hub")


def _verified(source: DataFrame, pairs: DataFrame, width: int, limit: Fraction) -> DataFrame:
    """The pairs whose full shingle sets are as similar as asked. Texts of other rows stay out of the shuffles."""
    bitmap, _ = bitmap_of(pairs.select(F.col("a").alias("v")).distinct().unionByName(pairs.select(F.col("b").alias("v")).distinct()), "v")
    texts = with_hit(source.select("v", "text"), "v", bitmap).where("_hit")
    return (
        pairs.join(texts.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
        .mapInArrow(_verify(width, limit.numerator, limit.denominator), "a long, b long")
    )
