"""Groups of confirmed duplicates: survivors, merged properties, rewired edges, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from twinlens.operators.blocking import keyed_units, spread
from twinlens.operators.components import connected_components
from twinlens.sources.bitmap import bitmap_of, with_hit
from twinlens.sources.scratch import materialise

#: Members of a chunk when a group's pairs are made, and absorbed nodes that are few enough to be broadcast.
MEMBERS, FEW_MOVED = 256, 100_000


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): undirected, all types; a self-loop counts once."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.where("src <> dst").select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def groups(decided: DataFrame) -> DataFrame:
    """(id, component) of the pairs with verdict `duplicate`; `distinct` verdicts don't separate a group."""
    confirmed = decided.where("verdict = 'duplicate'").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return connected_components(confirmed)


def survivors(members: DataFrame, degree: DataFrame) -> DataFrame:
    """(id, component, survivor_id): of each group the member of highest degree, then smallest id."""
    rated = members.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = rated.groupBy("component").agg(F.min(F.struct((-F.col("degree")).alias("d"), F.col("id").alias("id")))["id"].alias("survivor_id"))
    return members.join(best, "component").select("id", "component", "survivor_id")


def member_pairs(members: DataFrame, decided: DataFrame) -> DataFrame:
    """(component, id_a, id_b, direct, conflict): all pairs of a group; direct ones have a `duplicate` verdict, conflicts a `distinct` one."""
    members, _ = materialise(members.select(F.col("component").alias("cell"), F.struct("id").alias("item")), "members")
    units, placed, n = keyed_units(members, chunk=MEMBERS)
    # Verdicts go to the unit that makes their pair, so pairs themselves are not shuffled.
    at = lambda s: placed.select("cell", F.col("item.id").alias(f"id_{s}"), F.col("chunk").alias(f"c_{s}")).hint("merge")
    verdicts = decided.where("id_a < id_b").groupBy("id_a", "id_b").agg(F.max((F.col("verdict") == "duplicate")).alias("dup"), F.max((F.col("verdict") == "distinct")).alias("dis"))
    inside = verdicts.join(at("a"), "id_a").join(at("b"), ["id_b", "cell"]).where("dup or dis")
    by_unit = inside.groupBy("cell", F.least("c_a", "c_b").alias("i"), F.greatest("c_a", "c_b").alias("j")).agg(F.collect_list(F.struct("id_a", "id_b", "dup", "dis")).alias("vs"))
    each = spread(units.join(by_unit.hint("merge"), ["cell", "i", "j"], "left"), n).select("cell", F.explode("a.id").alias("x"), "b", "same", F.coalesce("vs", F.array().cast(by_unit.schema["vs"].dataType)).alias("vs"))
    own = lambda flag: F.transform(F.filter("vs", lambda v: v[flag] & ((v["id_a"] == F.col("x")) | (v["id_b"] == F.col("x")))), lambda v: F.when(v["id_a"] == F.col("x"), v["id_b"]).otherwise(v["id_a"])).alias(flag)
    pairs = each.select("cell", "x", "b", "same", own("dup"), own("dis")).select("cell", "x", F.explode("b.id").alias("y"), "same", "dup", "dis").where("if(same, x < y, x <> y)")
    return pairs.select(F.col("cell").alias("component"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), F.array_contains("dup", F.col("y")).alias("direct"), F.array_contains("dis", F.col("y")).alias("conflict"))


def merge_nodes(nodes: DataFrame, cluster: DataFrame, degree: DataFrame, strategy: str = "discard", fill: bool = False) -> DataFrame:
    """Nodes after the merge: absorbed ones gone, survivors by strategy. Nodes of no group are not shuffled into one.

    discard: the survivor keeps its own properties; with ``fill`` those that it
    lacks are taken from the first absorbed member that has them. overwrite: the
    last absorbed member (by degree, highest first, then id) that has a property
    sets it. combine: each property becomes a list of the distinct values,
    survivor's first.
    """
    properties = [c for c in nodes.columns if c != "id"]
    if strategy == "discard" and not fill:
        absorbed = cluster.where("id <> survivor_id").select("id")
        return nodes.join(absorbed, "id", "left_anti").select("id", *properties)
    alone = nodes.join(cluster.select("id"), "id", "left_anti")
    placed = nodes.join(cluster.select("id", F.col("survivor_id").alias("owner")), "id")
    rank = placed.join(degree, "id", "left").withColumn("rank", F.struct((F.col("id") != F.col("owner")).alias("absorbed"), (-F.coalesce("degree", F.lit(0))).alias("d"), F.col("id").alias("i")))
    if strategy in ("discard", "overwrite"):
        # max_by and min_by skip null orders, so a missing property never stands in for one that is there.
        pick = F.max_by if strategy == "overwrite" else F.min_by
        merged = [pick(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c) for c in properties]
        together = rank.groupBy(F.col("owner").alias("_owner")).agg(*merged).select(F.col("_owner").alias("id"), *properties)
        return together.unionByName(alone.select("id", *properties))
    if strategy == "combine":
        is_list = {c: isinstance(nodes.schema[c].dataType, ArrayType) for c in properties}

        def listed(c: str):
            value = F.col(c) if is_list[c] else F.when(F.col(c).isNotNull(), F.array(c))
            held = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col("rank"), value.alias("v")))))
            return F.array_distinct(F.flatten(F.transform(held, lambda s: s["v"]))).alias(c)

        together = rank.groupBy(F.col("owner").alias("_owner")).agg(*[listed(c) for c in properties]).select(F.col("_owner").alias("id"), *properties)
        own = [F.array_distinct(F.coalesce(F.col(c) if is_list[c] else F.when(F.col(c).isNotNull(), F.array(c)), F.array().cast(together.schema[c].dataType))).alias(c) for c in properties]
        return together.unionByName(alone.select("id", *own))
    raise ValueError(f"unknown strategy: {strategy}")


def merge_display(columns: list[str]) -> Column:
    """What a member of a group is shown as: name, title, heading, summary or text, else its id."""
    return F.coalesce(*[F.col(c).cast("string") for c in ("name", "title", "heading", "summary", "text") if c in columns], F.col("id"))


def dry_run(nodes: DataFrame, decided: DataFrame, degree: DataFrame) -> DataFrame:
    """(component, id, survivor_id, display, degree, transitive): the groups that a merge would make.

    ``transitive`` marks members of a pair that no `duplicate` verdict confirms.
    """
    cluster, _ = materialise(survivors(groups(decided), degree), "cluster")
    # A member is in an unconfirmed pair unless it is confirmed with each other one: counts do, no pairs are made.
    confirmed = decided.where("verdict = 'duplicate' and id_a <> id_b").select(F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y")).distinct()
    partners = confirmed.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("partners"))
    sizes = cluster.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    shown = nodes.select("id", merge_display(nodes.columns).alias("display"))
    return (
        cluster.join(sizes, "component").join(partners, "id", "left").join(degree, "id", "left").join(shown, "id", "left")
        .select("component", "id", "survivor_id", F.coalesce("display", "id").alias("display"), F.coalesce("degree", F.lit(0)).alias("degree"), (F.coalesce("partners", F.lit(0)) < F.col("size") - 1).alias("transitive"))
    )


def merge_result(cluster: DataFrame, nodes: DataFrame, pass_id: str) -> DataFrame:
    """(merge_pass_id, applied, skipped, failed): groups whose survivor and some absorbed member are there; one that lacks an absorbed member is skipped, one that lacks its survivor failed."""
    there = cluster.join(nodes.select("id", F.lit(True).alias("there")), "id", "left")
    own = F.col("id") == F.col("survivor_id")
    by_group = there.groupBy("component").agg(F.bool_or(own & F.col("there").isNotNull()).alias("survivor"), F.count_if(~own & F.col("there").isNotNull()).alias("absorbed"))
    return by_group.agg(F.lit(pass_id).alias("merge_pass_id"), F.count_if(F.col("survivor") & (F.col("absorbed") > 0)).alias("applied"), F.count_if(F.col("survivor") & (F.col("absorbed") == 0)).alias("skipped"), F.count_if(~F.col("survivor")).alias("failed"))


def rewire(edges: DataFrame, cluster: DataFrame, keep_loops: bool = False) -> DataFrame:
    """Edges after the merge: ends moved to the survivors, equal (src, rel_type, dst) made one, the absorbed's properties last."""
    moved, _ = materialise(cluster.where("id <> survivor_id").select("id", "survivor_id"), "moved")
    few = moved.count() <= FEW_MOVED
    to = lambda end, name: (F.broadcast if few else lambda t: t.hint("merge"))(moved.select(F.col("id").alias(end), F.col("survivor_id").alias(name)))
    if few:
        out = edges.join(to("src", "s"), "src", "left")
    else:
        # Of the sources only those that a bitmap can't clear are shuffled to be looked up.
        bits, _ = bitmap_of(moved.select(F.xxhash64("id").alias("k")), "k")
        looked = with_hit(edges.withColumn("_k", F.xxhash64("src")), "_k", bits).drop("_k")
        out = looked.where("not _hit").drop("_hit").withColumn("s", F.lit(None).cast(moved.schema["survivor_id"].dataType)).unionByName(looked.where("_hit").drop("_hit").join(to("src", "s"), "src", "left"))
    out = out.join(to("dst", "d"), "dst", "left")
    # Where an end was is sent only if it moved.
    out = out.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "rel_type", F.coalesce(F.map_entries("props"), F.array().cast("array<struct<key: string, value: string>>")).alias("e"), F.when(F.col("s").isNotNull(), F.col("src")).alias("a"), F.when(F.col("d").isNotNull(), F.col("dst")).alias("b"))
    if not keep_loops:
        out = out.where("src <> dst or (a is null and b is null)")
    # One sorted pass over the edges that become one: no list is made and sorted anew on the way.
    one = Window.partitionBy("src", "rel_type", "dst").orderBy((F.col("a").isNotNull() | F.col("b").isNotNull()), F.coalesce("a", "src"), F.coalesce("b", "dst"), "e")
    held = out.select("src", "rel_type", "dst", F.row_number().over(one).alias("_rn"), F.collect_list("e").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("es")).where("_rn = 1")
    latest = F.aggregate("es", F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: ~F.array_contains(F.transform(e, lambda x: x["key"]), k)), F.map_from_entries(e)))
    return held.select("src", "rel_type", "dst", F.when(F.size("es") == 1, F.map_from_entries(F.col("es")[0])).otherwise(latest).alias("props"))


def audit(cluster: DataFrame, decided: DataFrame, scores: DataFrame, session_id: str, pass_id: str, strategy: str, complete: bool | None = None, nodes_walked: int | None = None, nodes: DataFrame | None = None, label: str | None = None) -> DataFrame:
    """A record per group: survivor, absorbed ids, scores of its pairs, who decided, how complete the comparison was.

    With ``nodes`` (as they were before the merge) also the properties of the
    survivor and of each absorbed member, as JSON, in order of absorbed ids.
    """
    absorbed = cluster.groupBy("component", "survivor_id").agg(F.array_sort(F.collect_list(F.when(F.col("id") != F.col("survivor_id"), F.col("id")))).alias("absorbed_ids"))
    inside = decided.where("verdict = 'duplicate'").join(cluster.select(F.col("id").alias("id_a"), "component"), "id_a")
    who = inside.groupBy("component").agg(F.count_if(F.col("decided_by") == "human").alias("human"), F.count_if(F.col("decided_by") == "ai").alias("ai"), F.count_if(F.col("decided_by").isNull() | ~F.col("decided_by").isin("human", "ai")).alias("unknown"))
    scored = scores.join(inside.select("id_a", "id_b", "component"), ["id_a", "id_b"]).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("metric_id", "field_name", "score", "above_threshold"))).alias("scores"))
    rows = absorbed.join(who, "component", "left").join(scored, "component", "left")
    if nodes is not None:
        shown = nodes.select("id", F.to_json(F.struct(*[c for c in nodes.columns if c != "id"])).alias("props"))
        own = F.col("id") == F.col("survivor_id")
        held = cluster.join(shown, "id").groupBy("component").agg(F.max(F.when(own, F.col("props"))).alias("survivor_props"), F.transform(F.array_sort(F.collect_list(F.when(~own, F.struct("id", "props")))), lambda s: s["props"]).alias("absorbed_props"))
        rows = rows.join(held, "component", "left")
    else:
        rows = rows.withColumn("survivor_props", F.lit(None).cast("string")).withColumn("absorbed_props", F.lit(None).cast("array<string>"))
    return rows.select(
        F.substring(F.sha1(F.concat_ws("|", F.lit(session_id), F.lit(pass_id), "survivor_id")), 1, 12).alias("id"),
        F.lit(session_id).alias("session_id"), F.lit(pass_id).alias("merge_pass_id"), F.current_timestamp().alias("timestamp"), F.lit(label).cast("string").alias("label"), "survivor_id", "survivor_props", "absorbed_ids", "absorbed_props", "scores",
        F.lit(strategy).alias("conflict_strategy"), F.struct("human", "ai", "unknown").alias("decided_by"),
        F.struct(F.lit(complete).cast("boolean").alias("complete"), F.lit(nodes_walked).cast("long").alias("nodes_walked")).alias("capture"),
    )


def audit_write_back(audits: DataFrame) -> dict[str, DataFrame]:
    """Tables for a graph: audit records, MERGED_INTO edges of records to survivors, ABSORBED edges of records to absorbed ids."""
    return {
        "er_audit_record": audits.select("id", "session_id", "merge_pass_id", "timestamp", "label", "conflict_strategy", F.col("decided_by.human").alias("human"), F.col("decided_by.ai").alias("ai"), F.col("decided_by.unknown").alias("unknown"), F.coalesce("capture.complete", F.lit(True)).alias("label_fully_compared")),
        "merged_into": audits.select(F.col("id").alias("src"), F.col("survivor_id").alias("dst"), F.lit("MERGED_INTO").alias("rel_type")),
        "absorbed": audits.select(F.col("id").alias("src"), F.explode("absorbed_ids").alias("dst"), F.lit("ABSORBED").alias("rel_type")),
    }


def audits_by_time(audits: DataFrame) -> DataFrame:
    """Audit records, the last first."""
    return audits.orderBy(F.col("timestamp").desc(), "id")
