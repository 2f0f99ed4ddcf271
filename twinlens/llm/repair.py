"""Token-id shards in a Re-Pair grammar format with random-access decoding.

A shard is a Parquet row group of documents in ascending id order: one row with
the grammar (pairs of symbols, and how many ids each symbol stands for) and one
row per document with its symbols. A nonterminal never spans two documents, so
any document, or any range of its ids, is decoded from its own row and the
shard's rules alone. Parquet through Spark's committer gives whole files or
none when a task is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlens.llm.memory import small_batches
from twinlens.llm.tokens import default_vocabulary, vocabulary
from twinlens.sources.scratch import scratch_path

END_ID = 0
#: Ids of a shard; least repeats of a pair that is replaced: a rule is stored as two symbols and a length, so fewer don't pay.
SHARD_IDS, LEAST = 262_144, 4
#: First nonterminal: above every id of the supported vocabularies.
FIRST = 1 << 17
#: Bits of a sorted number that holds a pair and its place.
_KEY_BITS = 63


class Grammar:
    """Rules FIRST + k -> (left, right), in the order in which they were made."""

    def __init__(self, rules: np.ndarray):
        self.rules = rules
        self.lengths = np.ones(len(rules), dtype=np.int64)
        self._starts = np.zeros(len(rules), dtype=np.int64)
        self._flat = np.empty(0, dtype=np.uint32)
        # The rules of a round refer to earlier rounds only: whole rounds are expanded at once.
        highest = rules.max(axis=1).astype(np.int64) - FIRST if len(rules) else np.empty(0, np.int64)
        at = 0
        while at < len(rules):
            later = np.flatnonzero(highest[at:] >= at)
            end = at + int(later[0]) if len(later) else len(rules)
            if end == at:
                raise ValueError("a rule refers to itself or to a later one")
            sides = rules[at:end].reshape(-1)
            sizes = self.expansion_lengths(sides).reshape(-1, 2).sum(axis=1)
            body = self.expand(sides)
            self.lengths[at:end] = sizes
            self._starts[at:end] = len(self._flat) + np.cumsum(sizes) - sizes
            self._flat = np.concatenate((self._flat, body))
            at = end

    def expansion_lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), dtype=np.int64)
        high = symbols >= FIRST
        out[high] = self.lengths[symbols[high] - FIRST]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        lengths = self.expansion_lengths(symbols)
        high = symbols >= FIRST
        if not high.any():
            return symbols.astype(np.uint32)
        out = np.repeat(symbols, lengths).astype(np.uint32)
        ends = np.cumsum(lengths)
        h = np.flatnonzero(high)
        size = lengths[h]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(ends[h] - size, size) + within] = self._flat[np.repeat(self._starts[symbols[h] - FIRST], size) + within]
        return out

    def decode_range(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop of a document, expanding only the symbols that cover them."""
        ends = np.cumsum(self.expansion_lengths(symbols))
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - before : stop - before]


def compress(ids: np.ndarray, doc_starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols, symbol starts of the documents).

    Rounds go on until no pair of neighbours within documents occurs ``least``
    times without overlap. A round ranks all such pairs by how often they occur
    and replaces those occurrences that no better pair overlaps; a pair with
    fewer than ``least`` of them waits. The best pair of a round is always
    replaced wherever it occurs, as in the one-by-one method.
    """
    n = len(ids)
    symbols = ids.astype(np.int64)
    # By place: where a document begins, the places behind and before, and the rank of the pair that begins there. Place n is past the end; -1 finds it too.
    first = np.zeros(n + 1, dtype=bool)
    first[doc_starts] = True
    first[n] = True
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ranks = np.full(n + 1, n, dtype=np.int32 if n < 1 << 31 else np.int64)
    # Pairs of two old symbols only grow rarer: places of rare ones are looked at again only beside a new symbol.
    live, gone = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    live[:n] = ~first[1:]  # no pair begins at a document's last symbol
    rules: list[np.ndarray] = []
    made, place_bits = 0, n.bit_length()
    highest = int(symbols.max(initial=0))
    while True:
        at = np.flatnonzero(live)
        behind = after[at]
        left, right = symbols[at], symbols[behind]
        bits = max(highest, FIRST + made).bit_length()
        keys = (left << bits) | right
        # Of a run of one symbol every second pair counts.
        again = np.flatnonzero(left == right)
        new_run = np.concatenate(([True], behind[again[:-1]] != at[again[1:]]))[: len(again)]
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(again)), 0))
        skipped = again[(np.arange(len(again)) - run_start) % 2 == 1]
        if 2 * bits + place_bits <= _KEY_BITS:  # places are sorted along with their pairs
            keys <<= place_bits
            keys |= at
            keys[skipped] = np.iinfo(np.int64).max
            keys.sort()
            keys = keys[: len(keys) - len(skipped)]
            places = keys & ((1 << place_bits) - 1)
            keys >>= place_bits
        else:
            keys, places = np.delete(keys, skipped), np.delete(at, skipped)
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
        edge = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
        counts = np.diff(edge)
        often = counts >= least
        if not often.any():
            break
        pairs = keys[edge[:-1][often]]
        best_first = np.argsort(-counts[often], kind="stable")
        rank = np.empty(len(pairs), dtype=ranks.dtype)
        rank[best_first] = np.arange(len(pairs))
        ranks[places[np.repeat(often, counts)]] = np.repeat(rank, counts[often])
        held = ranks[at]
        common = held < n
        live[at] = common
        live[at[skipped]] = True
        at, held = at[common], held[common]
        wins = (held < ranks[before[at]]) & (held < ranks[after[at]])
        ranks[at] = n
        at, held = at[wins], held[wins]
        enough = np.bincount(held, minlength=len(pairs)) >= least
        serial = np.cumsum(enough) - 1
        kept = enough[held]
        at, held = at[kept], serial[held[kept]]
        symbols[at] = FIRST + made + held
        taken = after[at]
        live[taken], gone[taken] = False, True
        after[at] = after[taken]
        before[after[taken]] = at
        live[at] = ~first[after[at]]
        live[before[at]] = ~first[at]
        chosen = pairs[best_first][enough]
        rules.append(np.stack([chosen >> bits, chosen & ((1 << bits) - 1)], axis=1))
        made += len(chosen)
    stay = ~gone[:n]
    return (np.concatenate(rules) if rules else np.empty((0, 2), np.int64)).astype(np.uint32), symbols[stay].astype(np.uint32), np.flatnonzero(first[:n][stay])


_ROWS = pa.schema([("shard", pa.int64()), ("doc", pa.int64()), ("ordinal", pa.int64()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("n_ids", pa.int64())])
_DDL = "shard long, doc long, ordinal long, rules binary, lengths binary, symbols binary, n_ids long"


def _shard(shard: int, docs: list[pa.Array], sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    rules, symbols, starts = compress(ids, np.cumsum(sizes) - sizes)
    n = len(sizes)
    offsets = 4 * np.append(starts, len(symbols)).astype(np.int64)
    if offsets[-1] >= 1 << 31:
        raise ValueError("the symbols of a shard exceed 2 GB")
    bodies = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(symbols.astype("<u4"))])
    head = [[shard], None, [-1], [rules.astype("<u4").tobytes()], [Grammar(rules).lengths.astype("<u4").tobytes()], None, None]
    rest = [pa.array(np.full(n, shard)), pa.concat_arrays(docs), pa.array(np.arange(n)), None, None, bodies, pa.array(sizes)]
    columns = []
    for field, first, others in zip(_ROWS, head, rest, strict=True):
        first = pa.nulls(1, field.type) if first is None else pa.array(first, field.type)
        columns.append(pa.concat_arrays([first, pa.nulls(n, field.type) if others is None else others]))
    return pa.record_batch(columns, schema=_ROWS)


def _shard_rows(path: str, end_id: int, shard_ids: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        part, serial = _partition_id(), 0
        docs: list[pa.Array] = []
        bodies: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0
        for batch in batches:
            ids, ends = known.encoded_column(batch.column(1))
            own = np.diff(ends, prepend=0) + 1
            ids = np.insert(ids, ends, end_id)
            ends = np.cumsum(own)
            at = 0
            while at < batch.num_rows:
                before = int(ends[at] - own[at])
                stop = min(int(np.searchsorted(ends, before + shard_ids - total)) + 1, batch.num_rows)
                docs.append(batch.column(0).slice(at, stop - at))
                sizes.append(own[at:stop])
                bodies.append(ids[before : ends[stop - 1]])
                total += int(ends[stop - 1]) - before
                at = stop
                if total >= shard_ids:
                    yield _shard((part << 32) | serial, docs, np.concatenate(sizes), np.concatenate(bodies))
                    docs, sizes, bodies, total, serial = [], [], [], 0, serial + 1
            bodies = [x.copy() for x in bodies]  # not the whole batch's
        known.forget()
        if docs:
            yield _shard((part << 32) | serial, docs, np.concatenate(sizes), np.concatenate(bodies))

    return shards


def _partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def write_shards(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encode whole texts, append ``end_id`` to each, and write Re-Pair shards in ascending id order.

    Null texts are empty: only the end id. Null ids come first; rows repeated
    under one id are each written. A shard is closed once it holds
    ``shard_ids`` ids, so a task holds one shard and one text at a time.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = source.repartitionByRange(parts, F.col("doc").asc_nulls_first()).sortWithinPartitions(F.col("doc").asc_nulls_first())
    ordered.mapInArrow(_shard_rows(path or default_vocabulary(), end_id, shard_ids), _DDL).write.option("compression", "zstd").parquet(out)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(shard, docs, ordinals, sizes, ids) of runs of documents of one shard, in order."""
    shard, grammar = None, None
    for batch in batches:
        shards, ordinals = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        edges = np.flatnonzero(np.concatenate(([True], (shards[1:] != shards[:-1]) | (ordinals[1:] < 0), [True]))) if batch.num_rows else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if ordinals[a] < 0:
                shard, grammar = int(shards[a]), Grammar(np.frombuffer(batch.column(3)[a].as_buffer(), dtype="<u4").reshape(-1, 2))
                a += 1
            if shard != shards[b - 1]:
                raise ValueError(f"shard {shards[b - 1]}: a document came before the rules")
            if a == b:
                continue
            stored = batch.column(4).slice(a, b - a)
            offsets = np.frombuffer(stored.buffers()[1], np.int32)[stored.offset : stored.offset + len(stored) + 1]
            symbols = np.frombuffer(stored.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<u4")
            reach = np.concatenate(([0], np.cumsum(grammar.expansion_lengths(symbols))))
            sizes = np.diff(reach[(offsets - offsets[0]) >> 2])
            yield shard, batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), sizes, grammar.expand(symbols).astype("<u4")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, docs, ordinals, sizes, ids in _decode(batches):
        raw, ends = ids.tobytes(), 4 * np.cumsum(sizes)
        bodies = [raw[a:b] for a, b in zip((ends - 4 * sizes).tolist(), ends.tolist(), strict=True)]
        yield pa.record_batch([pa.array(np.full(len(sizes), shard)), docs, ordinals, pa.array(sizes), pa.array(bodies, pa.binary())], names=["shard", "doc", "ordinal", "n_ids", "ids"])


def read_shards(spark, out: str) -> DataFrame:
    """(shard, doc, ordinal, n_ids, ids): the decoded documents of a folder of shards; ids are little-endian unsigned 32-bit."""
    small_batches(spark)
    stored = spark.read.schema(_DDL).parquet(out).select("shard", "doc", "ordinal", "rules", "symbols")
    ordered = stored.repartition("shard").sortWithinPartitions("shard", "ordinal")
    return ordered.mapInArrow(_documents, "shard long, doc long, ordinal long, n_ids long, ids binary")


def encode_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, out: str | None = None) -> DataFrame:
    """Write the shards, read them back: id, start, n_tokens, ids_crc32 per document.

    ``start`` counts the ids of all documents before it: shard totals are summed
    over the few shards, offsets within a shard over its documents. Nulls,
    repeats and empty tables as in :func:`write_shards`.
    """
    spark = docs.sparkSession
    out = out or scratch_path(spark, "id-shards")
    write_shards(docs, out, id_col, text_col, path, end_id)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = None, 0
        for shard, docs_, _, sizes, ids in _decode(batches):
            if shard != now:
                now, before = shard, 0
            ends, raw = np.cumsum(sizes), memoryview(ids).cast("B")
            checks = [zlib.crc32(raw[a:b]) for a, b in zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True)]
            yield pa.record_batch([pa.array(np.full(len(sizes), shard)), docs_, pa.array(before + ends - sizes), pa.array(sizes), pa.array(checks, pa.int64())], names=["shard", "doc", "within", "n_tokens", "ids_crc32"])
            before += int(ends[-1])

    stored = spark.read.schema(_DDL).parquet(out)
    # Totals of the partitions are summed over the partitions, those of shards within each partition: no window holds all shards.
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("part", F.shiftright("shard", 32))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", earlier(Window.orderBy("part")).alias("before_part"))
    before = totals.select("shard", "part", earlier(Window.partitionBy("part").orderBy("shard")).alias("within_part")).join(parts, "part").select("shard", (F.col("before_part") + F.col("within_part")).alias("before"))
    decoded = (
        stored.select("shard", "doc", "ordinal", "rules", "symbols").repartition("shard").sortWithinPartitions("shard", "ordinal")
        .mapInArrow(digests, "shard long, doc long, within long, n_tokens long, ids_crc32 long")
    )
    return decoded.join(before, "shard").select(F.col("doc").alias(id_col), (F.col("before") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32")
