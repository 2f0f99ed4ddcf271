"""Language identification of mixed-language texts.

Each word's script narrows the languages it may be in. Per-word log scores (word
frequencies where the word was learned, character trigrams elsewhere) go through
a Viterbi pass with a penalty for switching; its path labels spans, and the
document's language is that of most letters on the path.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.memory import give_back, small_batches
from twinlens.llm.tokens import together
from twinlens.sources.scratch import drop, materialise

#: The classifier is fitted on the whole texts of about this many labelled rows at most, chosen by hash of text and language.
FIT_ROWS = 20_000
#: Repeats in the sample from which a word has scores of its own, and the counts added to all.
LEAST, SMOOTH = 10, 0.5
#: Log-score cost of changing the language between neighbouring words.
SWITCH = 6.0
UNDETERMINED = "und"

#: Runs of letters and of numbers that aren't decimal digits; see :func:`letters_of`.
_WORD = re.compile(r"[^\W\d_]+")

# First code points of Unicode script ranges, and the script from there on.
_SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"),
    (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Other"),
    (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x1380, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Hiragana"),
    (0x30A0, "Katakana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
    (0x20000, "Han"), (0x323B0, "Other"),
]
_SCRIPT_FROM = [a for a, _ in _SCRIPT_RANGES]


def script_of(word: str) -> str:
    """The script of a word's first letter."""
    return _SCRIPT_RANGES[bisect_right(_SCRIPT_FROM, ord(word[0])) - 1][1]


def letters_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    words = _WORD.findall(text.lower())
    if words and not "".join(words).isalpha():  # such as a superscript or a Roman numeral
        words = ["".join(run) for w in words for letter, run in groupby(w, str.isalpha) if letter]
    return words


@dataclass
class Model:
    languages: list[str]
    words: dict[str, list[float]]
    grams: dict[str, list[float]]
    unseen: list[float]
    scripts: dict[str, list[bool]]

    def __getstate__(self):
        return self.languages, self._word_no, self._word_scores, self._gram_no, self._gram_scores, self._narrow  # what a worker needs

    def __setstate__(self, state):
        self.languages, self._word_no, self._word_scores, self._gram_no, self._gram_scores, self._narrow = state

    def __post_init__(self):
        self._word_no = {w: k for k, w in enumerate(self.words)}
        self._word_scores = np.array([*self.words.values()], dtype=np.float32).reshape(len(self.words), len(self.languages))
        self._gram_no = {g: k for k, g in enumerate(self.grams)}
        self._gram_scores = np.array([*self.grams.values(), self.unseen], dtype=np.float64).reshape(len(self.grams) + 1, len(self.languages))
        self._narrow = {s: np.array([0.0 if ok else -50.0 for ok in v]) for s, v in self.scripts.items() if not all(v)}

    def scores(self, words: list[str]) -> np.ndarray:
        """Log scores of words in each language; a language never seen in a word's script is out."""
        out = np.empty((len(words), len(self.languages)))
        at = np.fromiter((self._word_no.get(w, -1) for w in words), np.int64, len(words))
        out[at >= 0] = self._word_scores[at[at >= 0]]
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            missing, number = len(self._gram_no), self._gram_no.get
            ids = [[number(w[j : j + 3], missing) for j in range(len(w) - 2)] for w in (f"^{words[k]}$" for k in unknown)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            rows = self._gram_scores[np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))]
            out[unknown] = np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None] * 2.0
        if self._narrow:
            for k, w in enumerate(words):
                held = self._narrow.get(script_of(w))
                if held is not None:
                    out[k] += held
        return out


def sample_of(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = FIT_ROWS) -> DataFrame:
    """(lang, words) of about ``max_rows`` distinct labelled texts at most, an equal quota for each language.

    A language with no more texts than its quota gives all of them, so rare ones
    are learned too. Of another, the texts whose hash lies in the share of the
    hash space that the quota is of its (sketched) number of distinct texts.
    Which texts these are depends neither on order nor on ids. Texts outside
    the sample are hashed where they are read and never moved.
    """
    hashed = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col, lang_col).alias("h"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.01).alias("n")).collect()  # a row per language
    quota = max(1, max_rows // max(1, len(sizes)))
    shares = [x for r in sizes for x in (F.lit(r["lang"]), F.lit(1.0 if r["n"] <= quota else 0.95 * quota / r["n"]))]
    place = F.shiftright(F.col("h"), 11).cast("double") / F.lit(float(1 << 53)) + F.lit(0.5)
    chosen = hashed.where(place < F.create_map(*shares)[F.col("lang")]) if shares else hashed.limit(0)
    return chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", F.split(F.lower("text"), r"[^\p{L}]+").alias("words"))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = FIT_ROWS) -> Model:
    """Learn from the whole texts of :func:`sample_of`.

    The driver receives the counts of the sample's trigrams and of its words that
    occur ``LEAST`` times; rarer words are scored by their trigrams. Both are
    bounded by the sample, whatever the size of the table.
    """
    words_of = sample_of(labelled, text_col, lang_col, max_rows).select("lang", F.explode("words").alias("word")).where("word <> ''")
    counts, counts_path = materialise(words_of.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    all_words = counts.groupBy("word").agg(F.sum("n").alias("every"))
    padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = counts.select("lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.substring(padded, k, F.lit(3)))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    heads = counts.groupBy("lang", F.substring("word", 1, 1).alias("head")).agg(F.sum("n").alias("n"))
    word_rows = counts.join(all_words.where(f"every >= {LEAST}").select("word"), "word").collect()
    gram_rows, head_rows, vocabulary = grams.collect(), heads.collect(), all_words.count()
    drop(labelled.sparkSession, counts_path)
    languages = sorted({r["lang"] for r in head_rows})
    at = {x: k for k, x in enumerate(languages)}

    def table(rows: list, column: str) -> dict[str, list[float]]:
        out: dict[str, list[float]] = {}
        for r in sorted(rows, key=lambda r: (r[column], r["lang"])):
            out.setdefault(r[column], [0.0] * len(languages))[at[r["lang"]]] += r["n"]
        return out

    def logs(counted: dict[str, list[float]], totals: list[float], kinds: int) -> tuple[dict[str, list[float]], list[float]]:
        sums = [t + SMOOTH * (kinds + 1) for t in totals]
        return {w: [math.log((c + SMOOTH) / t) for c, t in zip(v, sums, strict=True)] for w, v in counted.items()}, [math.log(SMOOTH / t) for t in sums]

    total = lambda counted: [sum(v[k] for v in counted.values()) for k in range(len(languages))]
    of_head, of_gram = table(head_rows, "head"), table(gram_rows, "gram")
    word_logs, _ = logs(table(word_rows, "word"), total(of_head), vocabulary)
    gram_logs, unseen = logs(of_gram, total(of_gram), len(of_gram))
    scripts: dict[str, list[float]] = {}
    for head, v in of_head.items():
        held = scripts.setdefault(script_of(head), [0.0] * len(languages))
        for k, c in enumerate(v):
            held[k] += c
    allowed = {s: [c >= 0.01 * t for c, t in zip(v, total(of_head), strict=True)] for s, v in scripts.items()}
    return Model(languages, word_logs, gram_logs, unseen, {s: v for s, v in allowed.items() if any(v)})


def best_paths(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The Viterbi path of each text: scores are (words, languages) matrices.

    Texts are worked through together, longest first: step t advances all that
    have a word t. From the state before, a language is reached without cost
    from itself and at the switching cost from the best one.
    """
    if not scores:
        return []
    order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
    lengths = np.array([len(scores[k]) for k in order])
    width = scores[0].shape[1]
    longest = int(lengths[0])
    alive_at = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with more than t words
    # Step-major layout: the rows of step t are those of the first alive_at[t] texts.
    step_start = np.concatenate(([0], np.cumsum(alive_at)))
    flat = np.concatenate([scores[k] for k in order])
    rank = np.repeat(np.arange(len(order)), lengths)
    step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = step_start[step] + rank
    laid = np.empty_like(flat)
    laid[place] = flat
    stay = np.empty((len(flat), width), dtype=bool)
    came = np.empty(len(flat), dtype=np.int16)
    value = laid[: alive_at[0]].copy()
    for t in range(1, longest):
        a, b = step_start[t], step_start[t + 1]
        value = value[: b - a]
        top = value.max(axis=1)
        came[a:b] = value.argmax(axis=1)
        moved = (top - switch)[:, None]
        np.greater_equal(value, moved, out=stay[a:b])
        value = np.maximum(value, moved) + laid[a:b]
        laid[a:b] = value
    path = np.empty(len(flat), dtype=np.int16)
    now = np.empty(0, dtype=np.int16)
    for t in range(longest - 1, -1, -1):
        a, b = step_start[t], step_start[t + 1]
        ended = laid[a + len(now) : b].argmax(axis=1).astype(np.int16)
        now = np.concatenate((now, ended))
        path[a:b] = now
        if t:
            now = np.where(stay[a:b][np.arange(b - a), now], now, came[a:b])
    back = path[place]
    out: list[np.ndarray] = [np.empty(0, np.int16)] * len(scores)
    for k, piece in zip(order, np.split(back, np.cumsum(lengths)[:-1]), strict=True):
        out[k] = piece
    return out


def one_language(scores: np.ndarray, switch: float) -> int | None:
    """The language of the whole Viterbi path, where it is plain that the path never switches.

    Suppose that in no stretch of words another language gains half of what a
    switch costs. A path with k >= 2 stretches has k - 1 switches at least, and
    k / 2 <= k - 1 of them outweigh what its stretches gain; a path of one other
    language loses because the best total is compared with.
    """
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], axis=0, dtype=np.float64)
    lowest = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
    before = np.concatenate((np.zeros((1, gain.shape[1])), lowest[:-1]))
    return best if (gain - before).max() < switch / 2 else None


#: Words worked through together, and distinct words whose scores a worker holds.
_TOGETHER, _HELD = 100_000, 150_000


class Labeller:
    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self._row: dict[str, int] = {}
        self._scores = np.empty((1024, len(model.languages)), dtype=np.float32)

    def _rows(self, words: list[str]) -> list[int]:
        row = self._row
        try:
            return list(map(row.__getitem__, words))
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in row]
            first = len(row)
            while first + len(new) > len(self._scores):
                self._scores = np.concatenate([self._scores, np.empty_like(self._scores)])
            self._scores[first : first + len(new)] = self.model.scores(new)
            row.update(zip(new, range(first, first + len(new)), strict=True))
            return list(map(row.__getitem__, words))

    def label(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[str, int]]]]:
        """(language, score, spans as (language, words)) of each text, in order."""
        at = 0
        while at < len(texts):
            if len(self._row) > _HELD:
                self._row.clear()
            words: list[list[str]] = []
            total = 0
            while at < len(texts) and (not words or total < _TOGETHER):
                words.append(letters_of(texts[at]) if texts[at] else [])
                total += len(words[-1])
                at += 1
            every = np.array(self._rows(list(chain.from_iterable(words))), dtype=np.int64)
            rows = np.split(every, np.cumsum([len(w) for w in words])[:-1])
            scores = [self._scores[r] for r in rows]
            plain = [one_language(x, self.switch) if len(x) else None for x in scores]
            open_ = [k for k, w in enumerate(words) if w and plain[k] is None]
            paths = dict(zip(open_, best_paths([scores[k] for k in open_], self.switch), strict=True))
            for k, w in enumerate(words):
                if not w:
                    yield UNDETERMINED, 0.0, []
                    continue
                if plain[k] is not None:
                    name = self.model.languages[plain[k]]
                    yield name, 1.0, [(name, len(w))]
                    continue
                path = paths[k]
                letters = np.bincount(path, weights=np.fromiter(map(len, w), np.float64, len(w)), minlength=len(self.model.languages))
                edge = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
                spans = list(zip((self.model.languages[p] for p in path[edge].tolist()), np.diff(np.append(edge, len(path))).tolist(), strict=True))
                best = int(letters.argmax())
                yield self.model.languages[best], float(letters[best] / letters.sum()), spans


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: id, lang_pred, score, spans (JSON list of [language, words]); and the columns of ``keep``.

    Score is the share of letters on the Viterbi path that are in the predicted
    language. Null texts and texts without a letter: `und`, 0.0, no spans. With
    no language learned every text is `und`. Nulls and repeats of the id pass
    through; an empty table gives an empty result. No shuffle.
    """
    n = len(keep)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, switch)
        for batch in batches:
            for part, texts in together(batch, 1):
                got = list(labeller.label(texts)) if model.languages else [(UNDETERMINED, 0.0, [])] * len(texts)
                columns = [part.column(0), *part.columns[2:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([json.dumps(g[2]) for g in got], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])
        del labeller
        give_back()

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)])
    types = [f.dataType.simpleString() for f in source.schema.fields]
    ddl = ", ".join([f"c0 {types[0]}", *[f"c{k + 1} {types[k + 2]}" for k in range(n)], f"c{n + 1} string", f"c{n + 2} double", f"c{n + 3} string"])
    out = source.mapInArrow(label, ddl)
    return out.select(
        F.col("c0").alias(id_col), *[F.col(f"c{k + 1}").alias(f"kept_{c}") for k, c in enumerate(keep)],
        F.col(f"c{n + 1}").alias("lang_pred"), F.col(f"c{n + 2}").alias("score"), F.col(f"c{n + 3}").alias("spans"),
    )
