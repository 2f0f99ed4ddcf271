"""Token ids and counts of whole texts with public tokenizers.

For byte-level vocabularies texts are cut where the pre-tokenizer always parts
two characters, told by the classes of neighbouring bytes: no token spans such a
cut, so the pieces' ids joined are the text's ids. The library encodes each
distinct piece once while it is held in a bounded cache. Texts that are huge are
counted as overlapping chunks with offsets, spliced at common boundaries.
"""

from __future__ import annotations

import itertools
import json
import operator
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.memory import give_back, small_batches

#: Characters of a chunk and of the first overlap tried; texts longer than a chunk are resynchronised.
CHUNK, OVERLAP = 32_768, 512
#: Distinct pieces of the cache, and bytes of them; it starts anew beyond either.
CACHE, _CACHE_BYTES = 400_000, 16 << 20
#: Bytes of texts whose distinct pieces are looked up together; unseen pieces encoded as one string.
_WINDOW, _JOINED = 4 << 20, 200

# Bytes that byte-level vocabularies write as another character than their own.
_OTHERS = [*range(0, 33), *range(127, 161), 173]
_BYTE_NAMES = np.arange(256, dtype="<u2")
_BYTE_NAMES[_OTHERS] = 256 + np.arange(len(_OTHERS))

# Classes of bytes. Lead bytes of white space beyond ASCII are _LOOSE, like control characters: nothing is said of them.
_LOOSE, _SPACE, _NEWLINE, _LETTER, _DIGIT, _MARK, _QUOTE, _HIGH = range(8)
_CLASS = np.full(256, _LOOSE, dtype=np.uint8)
_CLASS[0x21:0x7F], _CLASS[0x80:] = _MARK, _HIGH
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]], _CLASS[0x30:0x3A] = _LETTER, _DIGIT
_CLASS[[0x20, 0x0A, 0x27]] = _SPACE, _NEWLINE, _QUOTE
_CLASS[[0xC2, 0xE1, 0xE2, 0xE3]] = _LOOSE
#: Lead bytes of two-byte characters that are letters in all versions of Unicode, but for the multiplication and division signs.
_LETTER_LEADS = np.isin(np.arange(256), [*range(0xC3, 0xCA), 0xD0, 0xD1])
_NOT_LETTERS = (0x97, 0xB7)

_CLASS = _CLASS.tobytes()
_VISIBLE = np.isin(np.arange(8), [_LETTER, _DIGIT, _MARK, _QUOTE])
#: What a pair of classes says: letters, digits and marks are runs of their own, an apostrophe may begin a contraction; three cases are looked at further.
_CUT_BETWEEN, _AFTER_SPACE, _AFTER_LINE, _AFTER_HIGH = range(1, 5)
_WHAT = np.zeros(256, dtype=np.uint8)
for _left, _ends, _meaning in (
    (_LETTER, (_DIGIT, _MARK, _QUOTE), _CUT_BETWEEN),
    (_DIGIT, (_LETTER, _MARK, _QUOTE), _CUT_BETWEEN),
    (_MARK, (_LETTER, _DIGIT), _CUT_BETWEEN),
    (_HIGH, (_DIGIT, _MARK, _QUOTE), _AFTER_HIGH),
    (_SPACE, (_LETTER, _DIGIT, _MARK, _QUOTE, _HIGH), _AFTER_SPACE),
    (_NEWLINE, (_LETTER, _DIGIT, _MARK, _QUOTE, _HIGH), _AFTER_LINE),
):
    _WHAT[[_left << 3 | c for c in _ends]] = _meaning
_WHAT = _WHAT.tobytes()
#: Pieces that are one pre-token: letters, digits or marks alone, with a space before them or not.
_ONE = r"^ ?(?:[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{400}-\x{47f}]+|[0-9]+|[!-/:-@\[-`{-~]+)$"

#: A place before which every supported vocabulary may be cut: a space between a non-space and a non-space.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """A tokenizer file of the tokenizers (.json) or sentencepiece (.model) library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = path
        if path.endswith(".json"):
            from tokenizers import Tokenizer, pre_tokenizers

            self._t = Tokenizer.from_file(path)
            self._t.no_truncation()
            self._t.no_padding()
            self._added = sorted((a.content for a in self._t.get_added_tokens_decoder().values()), key=len, reverse=True)
            self.byte_level = self._is_byte_level()
            if self.byte_level:  # each character of a token stands for a byte, but for the special ones
                words = self._t.get_vocab(with_added_tokens=False)
                self._token_bytes = np.zeros(max(self._t.get_vocab().values()) + 1, dtype=np.int64)
                for word, i in words.items():
                    self._token_bytes[i] = len(word)
                for i, added in self._t.get_added_tokens_decoder().items():
                    self._token_bytes[i] = len(added.content.encode())
                self._any_added = re.compile("|".join(map(re.escape, self._added)).encode() or rb"(?!)")
                # The same model for pieces that are one pre-token each, written as the model reads them.
                self._by_words = Tokenizer.from_file(path)
                self._by_words.no_truncation()
                self._by_words.no_padding()
                self._by_words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        elif path.endswith(".model"):
            import sentencepiece

            self._s = sentencepiece.SentencePieceProcessor(model_file=path)
            self._added, self.byte_level = [], False
        else:
            raise ValueError(f"not a .json or .model vocabulary: {path}")
        self._empty()

    def _is_byte_level(self) -> bool:
        """The byte-level pre-tokenizer alone decides where texts part, but for plain added tokens of visible ASCII."""
        state = json.loads(self._t.to_str())
        how, model = state.get("pre_tokenizer") or {}, state["model"]
        plain = all(not (a["single_word"] or a["lstrip"] or a["rstrip"]) and re.fullmatch(r"[!-~]+", a["content"]) for a in state["added_tokens"])
        by_bytes = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space", True)
        return bool(by_bytes and plain and state.get("normalizer") is None and model["type"] == "BPE" and not model.get("dropout") and not model.get("end_of_word_suffix") and all(chr(x) in model["vocab"] for x in _BYTE_NAMES.tolist()))

    def _empty(self) -> None:
        self._known: dict[str, int] = {}
        self._known_bytes = 0
        self._flat = np.empty(0, dtype="<u4")
        self._starts = np.zeros(1, dtype=np.int64)  # of each piece's ids in _flat, and their end

    def ids(self, text: str) -> list[int]:
        if self.path.endswith(".json"):
            return self._t.encode(text, add_special_tokens=False).ids
        return self._s.encode(text, add_bos=False, add_eos=False)

    def ids_with_starts(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and the character offset at which each begins."""
        if self.path.endswith(".json"):
            got = self._t.encode(text, add_special_tokens=False)
            return got.ids, [a for a, _ in got.offsets]
        got = self._s.encode(text, return_type="proto")
        begins = np.array([p.begin for p in got.pieces], dtype=np.int64)
        if not text.isascii():  # its offsets are in bytes
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            begins = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[begins]
        return [p.id for p in got.pieces], begins.tolist()

    def encoded_together(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not texts:
            return []
        ids, ends = self.encoded_column(pa.array(texts, pa.large_string()))
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encoded_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column (null: empty) one after another, and where those of each text end."""
        if not self.byte_level:
            each = [np.array(self.ids(x or ""), dtype="<u4") for x in texts.to_pylist()]
            return np.concatenate([np.empty(0, "<u4"), *each]), np.cumsum([len(x) for x in each], dtype=np.int64)
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        low, high = int(offsets[0]), int(offsets[-1])
        if low == high:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[low:high]
        offsets = offsets - low
        cut = _cuts(data)
        for content in self._added:
            for k in np.flatnonzero(pc.match_substring(texts, content).to_numpy(zero_copy_only=False)).tolist():
                self._cut_added(data, cut, int(offsets[k]), int(offsets[k + 1]))
        ends = offsets[1:][offsets[1:] > 0]
        cut[ends[data[ends - 1] == 0x20] - 1] = False  # white space at a text's end stays together
        cut[offsets] = True
        starts = np.flatnonzero(cut)  # of the pieces, and the end
        counts, out = [], []
        at = 0
        while at < len(starts) - 1:
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + _WINDOW, side="right")) - 1)
            sizes, ids = self._ids_of_pieces(data, starts[at : end + 1])
            counts.append(sizes)
            out.append(ids)
            at = end
        before = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        return out[0] if len(out) == 1 else np.concatenate(out), before[np.searchsorted(starts, offsets[1:])]

    def _cut_added(self, data: np.ndarray, cut: np.ndarray, start: int, stop: int) -> None:
        """Cut a text around its added tokens only, where they are; white space before one stays together."""
        for m in self._any_added.finditer(data[start:stop].tobytes()):
            a, b = start + m.start(), start + m.end()
            cut[a] = cut[b] = True
            cut[a + 1 : b] = False
            if a > start and data[a - 1] == 0x20:
                cut[a - 1] = False

    def _ids_of_pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids of all."""
        first, n = int(starts[0]), len(starts) - 1
        raw = pa.py_buffer(data[first : int(starts[-1])])
        coded = pa.LargeStringArray.from_buffers(n, pa.py_buffer(starts - first), raw).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self._known) > CACHE or self._known_bytes > _CACHE_BYTES:
            self._empty()
        known = self._known
        self._learn([p for p in pieces if p not in known])
        number = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))[coded.indices.to_numpy()]
        begin = self._starts[number]
        sizes = self._starts[number + 1] - begin
        place = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        place += np.arange(len(place))
        return sizes, self._flat[place]

    def forget(self) -> None:
        """Give back what the cache holds: at the end of a task, for whatever the worker does next."""
        self._empty()
        give_back()

    def _learn(self, new: list[str]) -> None:
        """Encode unseen pieces: those of one pre-token many to a string by the model alone, the others as they are."""
        one = pc.match_substring_regex(pa.array(new, pa.large_string()), _ONE).to_numpy(zero_copy_only=False).tolist() if new else []
        whole, spaced, alone = list(itertools.compress(new, one)), [], []
        if len(whole) < len(new):
            other = itertools.compress(new, map(operator.not_, one))
            for p in other:  # a cut stands between any two pieces that begin with a space and a non-space
                (spaced if len(p) > 1 and p[0] == " " and not p[1].isspace() else alone).append(p)
        found, stops, at = [np.empty(0, "<u4")], [], 0
        for tokenizer, pieces, write in ((self._by_words, whole, _as_words), (self._t, spaced, "".join)):
            groups = [pieces[k : k + _JOINED] for k in range(0, len(pieces), _JOINED)]
            encodings = tokenizer.encode_batch_fast([write(g) for g in groups], add_special_tokens=False)
            ids = np.concatenate([np.empty(0, "<u4"), *(np.array(e.ids, dtype="<u4") for e in encodings)])
            ends = np.cumsum(pc.binary_length(pa.array(pieces, pa.large_string())).to_numpy())
            stops.append(at + np.searchsorted(np.cumsum(self._token_bytes[ids]), ends) + 1)
            found.append(ids)
            at += len(ids)
        each = [np.array(e.ids, dtype="<u4") for e in self._t.encode_batch_fast(alone, add_special_tokens=False)]
        stops.append(at + np.cumsum([len(x) for x in each], dtype=np.int64))
        ids = np.concatenate([*found, *each])
        learned = [*whole, *spaced, *alone]
        self._known.update(zip(learned, range(len(self._known), len(self._known) + len(learned)), strict=True))
        self._known_bytes += int(self._token_bytes[ids].sum())
        self._starts = np.concatenate((self._starts, len(self._flat) + np.concatenate(stops)))
        self._flat = np.concatenate((self._flat, ids))

    def encoded(self, text: str) -> bytes:
        return self.encoded_all([text])[0]

    def encoded_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; those above a chunk are spliced from overlapping chunks."""
        short = iter(self.encoded_together([x for x in texts if len(x) <= CHUNK]))
        return [next(short) if len(x) <= CHUNK else np.array(resynchronised(x, self), dtype="<u4").tobytes() for x in texts]


def _cuts(data: np.ndarray) -> np.ndarray:
    """Whether the pre-tokenizer parts the bytes before and at each place, and at the end; doubtful places are not cut."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    of = np.frombuffer(data.tobytes().translate(_CLASS), np.uint8)
    pair = of[:-1] << 3
    pair |= of[1:]
    what = np.frombuffer(pair.tobytes().translate(_WHAT), np.uint8)
    cut[1:-1] = what == _CUT_BETWEEN
    # Letters beyond ASCII end at a mark, a digit or an apostrophe.
    after = np.flatnonzero(what == _AFTER_HIGH)
    after = after[after > 0]
    lead, last = data[after - 1], data[after]
    cut[after[_LETTER_LEADS[lead] & ~((lead == 0xC3) & ((last == _NOT_LETTERS[0]) | (last == _NOT_LETTERS[1])))] + 1] = True
    # Before a space that something visible follows; on both sides of a line's end between two visible characters.
    cut[np.flatnonzero(what == _AFTER_SPACE)] = True
    lines = np.flatnonzero(what == _AFTER_LINE)
    lines = lines[lines > 0]
    lines = lines[_VISIBLE[of[lines - 1]]]
    cut[lines] = cut[lines + 1] = True
    return cut


def _as_words(pieces: list[str]) -> str:
    """Pieces of one pre-token each in the characters that stand for their bytes, spaces between them."""
    raw = np.frombuffer("\n".join(pieces).encode(), dtype=np.uint8)
    names = _BYTE_NAMES[raw]
    names[raw == 0x0A] = 0x20
    return names.tobytes().decode("utf-16-le")


#: Characters of texts whose pieces are encoded together.
_TOGETHER = 1 << 20


def together(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty), cut after every ``_TOGETHER`` characters: one text at least."""
    texts, size = [], 0
    for k in range(batch.num_rows):
        texts.append(batch.column(column)[k].as_py() or "")
        size += len(texts[-1])
        if size >= _TOGETHER or k == batch.num_rows - 1:
            yield batch.slice(k + 1 - len(texts), len(texts)), texts
            texts, size = [], 0


def resynchronised(text: str, vocabulary: Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a huge text from overlapping chunks.

    Neighbouring chunks share ``overlap`` characters. They are spliced at the
    last place in the shared part where both have a token boundary and the text
    has a proven cut (a space between non-spaces, across which no token of the
    vocabulary reaches). Where none is found the overlap doubles, up to the
    rest of the text.
    """
    out: list[int] = []
    at, n = 0, len(text)
    width = chunk
    while at < n:
        end = min(n, at + width)
        # sentencepiece puts a space before what it is given: the cut's own space is left to it.
        skip = int(at > 0 and path_adds_space(vocabulary))
        ids, starts = vocabulary.ids_with_starts(text[at + skip : end])
        if end == n:
            out.extend(ids)
            break
        begins = {at + skip + s for s in starts} | ({at} if skip else set())
        shared, cut = overlap, None
        while cut is None and shared < width:
            from_ = max(at + 1, end - shared)
            places = [m.start() for m in _CUT.finditer(text, from_, end)]
            ahead = min(n, end + shared)
            right = {from_ + s for s in vocabulary.ids_with_starts(text[from_:ahead])[1]} if places else set()
            cut = next((p for p in reversed(places) if p > from_ and _boundary(p, begins) and _boundary(p, right)), None)
            shared *= 2
        if cut is None:
            width *= 2  # not one proven boundary in the chunk: widen it
            continue
        keep = next((k for k, s in enumerate(starts) if at + skip + s >= cut), len(ids))
        out.extend(ids[:keep])
        at, width = cut, chunk
    return out


def path_adds_space(vocabulary: Vocabulary) -> bool:
    return vocabulary.path.endswith(".model")


def _boundary(place: int, starts: set[int]) -> bool:
    """A token begins at the cut's space, or after it where the vocabulary drops white space."""
    return place in starts or place + 1 in starts


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """This worker's copy of a vocabulary, with its cache."""
    held = _vocabularies.get(path)
    if held is None:
        held = _vocabularies[path] = Vocabulary(path)
    return held


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, path: str | None = None) -> DataFrame:
    """A row per document: id, n_bytes (UTF-8), n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens. No begin, end or added
    special tokens; special strings inside texts as the library's default
    handles them. Ids may be null or repeat: each row is counted by itself. An
    empty table gives an empty result; other columns are not read. No shuffle.
    """
    path = path or default_vocabulary()
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for part, texts in together(batch, 1):
                sizes = [len(ids) // 4 for ids in known.encoded_all(texts)]
                yield pa.record_batch([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array([s > limit for s in sizes], pa.bool_())], names=["_id", "n_bytes", "n_tokens", "over_limit"])
        known.forget()

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    return source.mapInArrow(count, "_id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("_id", id_col)
