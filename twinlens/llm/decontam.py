"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

The index stores postings (document, position, term) for the terms of the test
items. Each window of test words starts from its rarest term: that term's
postings, adjusted by its offset, are the possible alignments; they are
intersected with the adjusted postings of the window's second rarest term and
then with those of all other words of the item. Runs of matched words of at
least the window's length are exact phrase matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.sources.bitmap import bitmap_of, with_hit
from twinlens.sources.scratch import drop, materialise

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """Runs of digits, lower-cased letters and non-ASCII characters. The first and last element may be empty; no other."""
    return F.split(F.translate(text, _UPPER, _LOWER), _GAP)


def term_count(text: Column) -> Column:
    words = terms_of(text)
    return F.coalesce((F.size(words) - (F.element_at(words, 1) == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long"), F.lit(0).cast("long"))


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of a row's id and text: rows of one id aren't laid over each other, and null ids are like others."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("string"), F.col(text_col))


class PositionalIndex:
    """Postings (doc, pos, tid) of the documents for the vocabulary of a set of test items; ``doc`` is :func:`row_key`."""

    def __init__(self, docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str):
        words = (
            items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), F.filter(terms_of(F.col(item_text_col)), lambda w: w != "").alias("words"))
            .select("row", "item", F.size("words").alias("n"), F.posexplode("words").alias("k", "term"))
        )
        held, p1 = materialise(words, "item-words")
        vocabulary, self._vocabulary = materialise(held.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
        # One row per text, not per item row: repeated items share their alignments.
        self.words, p2 = materialise(held.join(vocabulary, "term").select("row", "item", "n", "k", "tid"), "item-terms")
        drop(docs.sparkSession, p1)
        self.postings, p3 = materialise(
            docs.select(row_key(id_col, text_col).alias("doc"), F.posexplode(terms_of(F.col(text_col))).alias("pos", "term"))
            .join(vocabulary, "term")
            .select("doc", "pos", "tid"),
            "postings",
        )
        self.paths = [p2, p3]

    def anchors(self, window: int) -> DataFrame:
        """For each window: its two rarest words, as (row, start, k, tid, rank)."""
        spark = self.words.sparkSession
        frequency, path = materialise(self.postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df")), "frequency")
        self.paths.append(path)
        rated = self.words.join(frequency, "tid", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
        spread = rated.withColumn(
            "start", F.explode(F.expr(f"sequence(greatest(0, k - {window - 1}), greatest(0, least(k, n - {window})))"))
        )
        order = Window.partitionBy("row", "start").orderBy("df", "k")
        found, path = materialise(spread.withColumn("rank", F.row_number().over(order)).where("rank <= 2").select("row", "start", "k", "tid", "rank"), "anchors")
        self.paths.append(path)
        return found


def phrase_hits(index: PositionalIndex, window: int = WINDOW, slack: int = 0) -> DataFrame:
    """(doc, item, row, from_pos, to_pos): runs of words that cover whole windows of an item; ``doc`` is the row key of the index.

    Documents and items without words have none; repeated rows share theirs.
    Empty tables give an empty result.

    ``slack`` > 0 also admits, as proximity matches, alignments whose second
    rarest word lies up to that many positions off; they are reported with the
    span between both words.
    """
    anchors = index.anchors(window)
    first = index.postings.join(anchors.where("rank = 1"), "tid").select("doc", "row", "start", (F.col("pos") - F.col("k")).alias("shift"))
    second_anchors = anchors.where("rank = 2")
    second = index.postings.join(second_anchors, "tid").select("doc", "row", "start", (F.col("pos") - F.col("k")).alias("shift"))
    # A window of one word has no second rarest; its first posting is the match.
    lonely = first.join(second_anchors.select("row", "start"), ["row", "start"], "left_anti").select("doc", "row", "shift")
    both = first.join(second, ["doc", "row", "start", "shift"], "left_semi").select("doc", "row", "shift")
    alignments, path = materialise(both.unionByName(lonely).distinct(), "alignments")
    index.paths.append(path)
    expected = alignments.join(index.words, "row").select("doc", "row", "item", "n", "shift", "k", (F.col("shift") + F.col("k")).alias("pos"), "tid")
    # Only postings of documents with an alignment are looked at further.
    aligned, path = bitmap_of(alignments.select("doc").distinct(), "doc")
    index.paths.append(path)
    postings = with_hit(index.postings, "doc", aligned).where("_hit").drop("_hit")
    matched = postings.join(expected, ["doc", "pos", "tid"]).select("doc", "row", "item", "n", "shift", "k")
    run = Window.partitionBy("doc", "row", "shift").orderBy("k")
    # Repeated rows have each posting several times: a rank without gaps counts it once.
    runs = matched.withColumn("run", F.col("k") - F.dense_rank().over(run)).groupBy("doc", "row", "item", "n", "shift", "run").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    hits = runs.where(f"hi - lo + 1 >= least(n, {window})").select("doc", "item", "row", (F.col("shift") + F.col("lo")).alias("from_pos"), (F.col("shift") + F.col("hi")).alias("to_pos"))
    if not slack:
        return hits
    near = index.postings.join(anchors.where("rank = 1"), "tid").select("doc", "row", "start", F.col("pos").alias("p1"), (F.col("pos") - F.col("k")).alias("shift"))
    other = index.postings.join(second_anchors, "tid").select("doc", "row", "start", F.col("pos").alias("p2"), (F.col("pos") - F.col("k")).alias("shift2"))
    close = near.join(other, ["doc", "row", "start"]).where(f"abs(shift - shift2) <= {slack}")
    named = close.join(index.words.select("row", "item").distinct(), "row")
    return hits.unionByName(named.select("doc", "item", "row", F.least("p1", "p2").alias("from_pos"), F.greatest("p1", "p2").alias("to_pos"))).distinct()


def _hits(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int) -> DataFrame:
    index = PositionalIndex(docs, items, id_col, text_col, item_col, item_text_col)
    hits, _ = materialise(phrase_hits(index, window).distinct(), "hits")
    drop(docs.sparkSession, *index.paths, index._vocabulary)
    return hits


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and wordless texts have no words and no hits. Each row is judged by its
    own text, whether its id is null, repeated or neither; repeated rows have the
    same result. Items without words match nothing; items with fewer words than
    the window are one window. Repeated item rows count once by their id. Empty
    tables give an empty result, or no hits. Columns not named are not read. Rows
    are told apart by a 64-bit hash of id and text.
    """
    hits = _hits(docs, items, id_col, text_col, item_col, item_text_col, window)
    # Covered positions: merge overlapping runs of a document instead of listing each word.
    order = Window.partitionBy("doc").orderBy("from_pos", "to_pos")
    reached = F.coalesce(F.max("to_pos").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    covered = hits.select("doc", "from_pos", "to_pos").distinct().withColumn("reached", reached).groupBy("doc").agg(F.sum(F.expr("greatest(0, to_pos - greatest(reached, from_pos - 1))")).cast("long").alias("n_hit"))
    found = (
        hits.select("doc", F.col("item").cast("string").alias("item")).distinct().groupBy("doc")
        .agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    )
    counted = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("doc"), term_count(F.col(text_col)).alias("n_words"))
    return (
        counted.join(covered.join(found, "doc"), "doc", "left")
        .select(
            F.col("_id").alias(id_col),
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item; nulls, repeats and empty tables as in :func:`decontaminate`.

    Only texts that a bitmap of the hits can't clear are shuffled.
    """
    hit, _ = materialise(_hits(docs, items, id_col, text_col, item_col, item_text_col, window).select(F.col("doc").alias("_key")).distinct(), "contaminated")
    bitmap, _ = bitmap_of(hit, "_key")
    rows = with_hit(docs.withColumn("_key", row_key(id_col, text_col)), "_key", bitmap)
    return rows.where("not _hit").unionByName(rows.where("_hit").join(hit, "_key", "left_anti")).select(*docs.columns)
