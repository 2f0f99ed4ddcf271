"""State of a session, review queue, exports, write-back tables and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.sources.scratch import materialise


def upsert_pairs(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """Old pairs joined with a rerun's: verdict, decision, note and all other old columns stay; a surfaced or decided pair stays surfaced.

    ``strict`` takes the rerun's word on surfaced instead. A max_score is the rerun's where it has one; ``scores``, an array,
    are the rerun's and those of other metrics and fields. Ids of 48 bits may meet, so the pair's own ids count too where they are there.
    """
    o, n = old.alias("o"), new.alias("n")
    keys = [c for c in ("pair_id", "id_a", "id_b") if c in old.columns and c in new.columns]
    both = o.join(n, [F.col(f"o.{c}") == F.col(f"n.{c}") for c in keys], "full_outer")
    either = F.coalesce("o.surfaced", F.lit(False)) | F.coalesce("n.surfaced", F.lit(False)) | (F.coalesce("o.verdict", F.lit("pending")) != "pending")
    made = {"pair_id": F.coalesce("o.pair_id", "n.pair_id"), "verdict": F.coalesce("o.verdict", F.lit("pending")), "surfaced": F.coalesce("n.surfaced", "o.surfaced") if strict else either}
    fresh = [c for c in ("id_a", "id_b", "max_score") if c in old.columns and c in new.columns]
    made |= {c: F.coalesce(f"n.{c}", f"o.{c}") for c in fresh}
    if "scores" in old.columns and "scores" in new.columns:
        key = lambda s: F.struct(s["field_name"], s["metric_id"])
        stay = F.filter("o.scores", lambda s: ~F.array_contains(F.transform("n.scores", key), key(s)))
        made["scores"] = F.when(F.col("n.scores").isNull(), F.col("o.scores")).when(F.col("o.scores").isNull(), F.col("n.scores")).otherwise(F.concat("n.scores", stay))
    return both.select(*[made.get(c, F.col(f"o.{c}")).alias(c) for c in old.columns])


def with_events(pairs: DataFrame, events: DataFrame | None) -> DataFrame:
    """Pairs with the last verdict and the last note of a log (pair_id, kind, verdict, decided_by, note, at, serial); `pending` clears time and decider."""
    if events is None:
        return pairs
    order = F.struct("serial", "at")
    verdict = F.col("kind") == "verdict"
    last = events.groupBy("pair_id").agg(
        F.max_by(F.struct("verdict", "decided_by", "at"), F.when(verdict, order)).alias("v"), F.max_by(F.struct("note"), F.when(F.col("kind") == "note", order)).alias("n")
    )
    joined = pairs.join(last, "pair_id", "left")
    decided = F.col("v.verdict") != "pending"
    made = {
        "verdict": F.coalesce("v.verdict", "verdict"), "note": F.when(F.col("n").isNotNull(), F.col("n.note")).otherwise(F.col("note")),
        "decided_at": F.when(F.col("v").isNotNull(), F.when(decided, F.col("v.at"))).otherwise(F.col("decided_at")), "decided_by": F.when(F.col("v").isNotNull(), F.when(decided, F.col("v.decided_by"))).otherwise(F.col("decided_by")),
    }
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in pairs.columns])


def reuse_legacy_ids(found: DataFrame, stored: DataFrame) -> DataFrame:
    """A run's pairs under the id that a session already has for them from before ids held the session."""
    from twinlens.operators.scoring import legacy_pair_id

    old = stored.select(F.col("pair_id").alias("_legacy"))
    return found.withColumn("_legacy", legacy_pair_id(F.col("id_a"), F.col("id_b"))).join(old.withColumn("_known", F.lit(True)), "_legacy", "left").withColumn("pair_id", F.when(F.col("_known"), F.col("_legacy")).otherwise(F.col("pair_id"))).select(*found.columns)


def upsert_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """New scores replace old ones of the same pair, metric and field; others stay."""
    keys = ["pair_id", "metric_id", "field_name"]
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def latest_verdicts(events: DataFrame) -> DataFrame:
    """The last event of each pair in an append-only log; `pending` clears time and decider."""
    last = Window.partitionBy("pair_id").orderBy(F.col("decided_at").desc(), F.col("event_id").desc())
    pending = F.col("verdict") == "pending"
    return events.withColumn("rank", F.row_number().over(last)).where("rank = 1").select("pair_id", "verdict", F.when(~pending, F.col("decided_at")).alias("decided_at"), F.when(~pending, F.col("decided_by")).alias("decided_by"))


def backfill_decided_by(pairs: DataFrame) -> DataFrame:
    """The decider of old rows: nobody while pending, the machine where the note says so, else a person."""
    return pairs.withColumn("decided_by", F.when(F.col("verdict") == "pending", None).when(F.col("note").startswith("[AI]"), "ai").otherwise("human"))


def queue(pairs: DataFrame, order: str = "pending-first", verdict: str | None = None) -> DataFrame:
    """Surfaced pairs in review order."""
    shown = pairs.where("surfaced")
    if verdict:
        shown = shown.where(F.col("verdict") == verdict)
    orders = {
        "pending-first": [(F.col("verdict") != "pending").asc(), F.col("pair_id").asc()],
        "score-desc": [F.col("max_score").desc(), F.col("pair_id").asc()],
        "score-asc": [F.col("max_score").asc(), F.col("pair_id").asc()],
        "recently-decided": [F.col("decided_at").desc_nulls_last(), F.col("pair_id").asc()],
    }
    return shown.orderBy(*orders[order])


def queue_positions(pairs: DataFrame, order: str = "pending-first", verdict: str | None = None) -> DataFrame:
    """The whole queue with each pair's ``position`` in it, counted from 1."""
    # Numbers grow from row to row of the sorted table: its partition in the high bits, the row within it below.
    held, _ = materialise(queue(pairs, order, verdict).withColumn("_row", F.monotonically_increasing_id()), "queue")
    held = held.withColumn("_part", F.shiftright("_row", 33))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    within = F.col("_row") - F.shiftleft("_part", 33)
    return held.join(counts, "_part").withColumn("position", F.col("_before") + within + 1).drop("_part", "_row", "_before")


def verdict_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def display_value(columns: list[str], extra: list[str] = ()) -> Column:
    """What a node is shown as: name, title, heading, summary or text, then the matched fields."""
    named = [c for c in ("name", "title", "heading", "summary", "text") if c in columns]
    return F.coalesce(*[F.col(c).cast("string") for c in [*named, *extra]], F.lit(""))


def export_rows(pairs: DataFrame, scores: DataFrame, keys: list[tuple[str, str]], nodes: DataFrame | None = None, fields: list[str] = ()) -> DataFrame:
    """A row per pair with a column metric_field for each of ``keys``; with ``nodes`` also both displays and node_a_, node_b_ values of ``fields``."""
    columns = [F.max(F.when((F.col("metric_id") == m) & (F.col("field_name") == f), F.col("score"))).alias(f"{m.replace('-', '_')}_{f}") for m, f in keys]
    wide = scores.groupBy("id_a", "id_b").agg(*columns)
    out = pairs.join(wide, ["id_a", "id_b"], "left")
    if nodes is not None:
        shown = display_value(nodes.columns, list(fields))
        for side in ("a", "b"):
            held = nodes.select(F.col("id").alias(f"id_{side}"), shown.alias(f"display_{side}"), *[F.col(f).cast("string").alias(f"node_{side}_{f}") for f in fields])
            out = out.join(held, f"id_{side}", "left")
    return out


def json_lines(rows: DataFrame) -> DataFrame:
    """(pair_id, json): each pair as one object, nulls left out."""
    return rows.select("pair_id", F.to_json(F.struct(*[c for c in rows.columns])).alias("json"))


def score_band(score: Column, threshold: float) -> Column:
    """green from the threshold on, amber from four fifths of it, else grey."""
    return F.when(score >= threshold, "green").when(score >= 0.8 * threshold, "amber").otherwise("grey")


def sanitised(nodes: DataFrame) -> DataFrame:
    """Properties as they are compared and stored: whole numbers as long, other numbers as double, dates and times as text; lists likewise."""
    from pyspark.sql.types import ArrayType, DataType, DateType, DayTimeIntervalType, IntegralType, NumericType, TimestampNTZType, TimestampType

    def kind(t: DataType) -> str | None:
        if isinstance(t, ArrayType):
            inner = kind(t.elementType)
            return inner and f"array<{inner}>"
        if isinstance(t, IntegralType):
            return "bigint"
        if isinstance(t, NumericType):
            return "double"
        return "string" if isinstance(t, (DateType, TimestampType, TimestampNTZType, DayTimeIntervalType)) else None

    return nodes.select(*[F.col(f.name).cast(k).alias(f.name) if (k := kind(f.dataType)) else F.col(f.name) for f in nodes.schema.fields])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def property_diff(nodes: DataFrame, a: str, b: str) -> DataFrame:
    """(key, value_a, value_b, differs) of two nodes, as JSON, values shown to 200 characters."""
    names = [c for c in nodes.columns if c != "id"]
    long = nodes.where(F.col("id").isin(a, b)).select("id", F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.to_json(F.struct(F.col(c).alias("v"))).alias("value")) for c in names])).alias("e")).select("id", "e.key", "e.value").where("value <> '{}'")
    x, y = (long.where(F.col("id") == i).select("key", F.col("value").alias(v)) for i, v in ((a, "value_a"), (b, "value_b")))
    joined = x.join(y, "key", "full_outer")
    return joined.select("key", F.substring("value_a", 1, 200).alias("value_a"), F.substring("value_b", 1, 200).alias("value_b"), (~F.col("value_a").eqNullSafe(F.col("value_b"))).alias("differs"))


def neighbours(nodes: DataFrame, edges: DataFrame, of: DataFrame) -> DataFrame:
    """(id, direction, rel_type, neighbour, display): edges out of and into each node of ``of``, repeats kept."""
    out = edges.select(F.col("src").alias("id"), F.lit("out").alias("direction"), "rel_type", F.col("dst").alias("neighbour"))
    into = edges.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), "rel_type", F.col("src").alias("neighbour"))
    near = out.unionAll(into).join(of.select("id"), "id", "left_semi")
    shown = nodes.select(F.col("id").alias("neighbour"), F.coalesce("display", "id").alias("display"))
    return near.join(shown, "neighbour").select("id", "direction", "rel_type", "neighbour", "display")


def passages(links: DataFrame, chunks: DataFrame, of: DataFrame) -> DataFrame:
    """Texts that nodes were drawn from, in order of index; a missing index counts as 0."""
    found = links.join(of.select("id"), "id", "left_semi").join(chunks.where("text is not null"), "chunk_id")
    return found.select("id", "chunk_id", F.coalesce("index", F.lit(0)).alias("index"), "text")


def write_back(pairs: DataFrame, scores: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Tables for a graph: pairs, their ends (vanished nodes dropped) and their scores."""
    decided = pairs.where("verdict <> 'pending'")
    ends = decided.select("pair_id", F.explode(F.array(F.struct(F.lit("a").alias("role"), F.col("id_a").alias("id")), F.struct(F.lit("b").alias("role"), F.col("id_b").alias("id")))).alias("e")).select("pair_id", "e.role", "e.id")
    return {
        "er_pair": decided.select("pair_id", "verdict"),
        "er_involves": ends.join(nodes.select("id"), "id", "left_semi"),
        "er_pair_score": scores.join(decided.select("pair_id", "id_a", "id_b"), ["id_a", "id_b"]).select("pair_id", "field_name", "metric_id", "score"),
    }


def high_score_distinct(pairs: DataFrame, scores: DataFrame, least: float = 0.95) -> DataFrame:
    """Scores over ``least`` of pairs judged distinct, counted by field and metric."""
    joined = scores.where(F.col("score") > least).join(pairs.where("verdict = 'distinct'").select("id_a", "id_b"), ["id_a", "id_b"])
    return joined.groupBy("field_name", "metric_id").agg(F.count(F.lit(1)).alias("n"))


def merges_without_people(audits: DataFrame) -> DataFrame:
    """Merged groups in which no pair was decided by a person."""
    return audits.where("decided_by.human = 0").select("id", "survivor_id", F.size("absorbed_ids").alias("n_absorbed"))


def partial_merges(audits: DataFrame) -> DataFrame:
    """Merges by label made before the label was compared whole."""
    return audits.where("not coalesce(capture.complete, true)").groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label")


def upsert_written_scores(old: DataFrame, new: DataFrame) -> DataFrame:
    """Written-back scores keyed by pair, field and metric: new ones replace old ones."""
    return upsert_scores(old, new.select(*old.columns))
