"""Named queries over the entity-resolution operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.functions.metrics import pair_score, phonetic
from twinlens.operators import blocking, capture, components, ledger, merging, profile, review, scoring
from twinlens.operators.scoring import FieldSpec, MetricSpec, Resolution, Rule

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(spark: SparkSession, sf_dir: str, table: str, key: str, **columns: str) -> DataFrame:
    return _t(spark, sf_dir, table).select(F.col(key).cast("string").alias("id"), *[F.col(c).alias(n) for n, c in columns.items()])


def _r(column: str | Column) -> Column:
    return F.round(column, 6)


_PART = Resolution("part", (FieldSpec("name", (MetricSpec("edit-distance"), MetricSpec("token-jaccard", 0.5)), 0.95, 2.0), FieldSpec("size", (MetricSpec("numeric-proximity"),), 0.95, 1.0)), session_id="part")

# Parts as nodes, pairs that share a token, and their scores, in SQL.
_PARTS_SQL = r"""
with nodes as (select p_partkey::VARCHAR as id, p_name as name, p_size as size, list_distinct(regexp_extract_all(lower(p_name), '[^ ]+')) as toks from part),
keyed as (select distinct id, unnest(toks) as key from nodes),
kept as (select k.id, k.key from keyed k join (select key from keyed group by key having count(*) between 2 and 500) using (key)),
cand as (select distinct a.id as id_a, b.id as id_b from kept a join kept b on a.key = b.key and a.id < b.id),
vals as (select c.id_a, c.id_b, x.name as na, y.name as nb, x.toks as ta, y.toks as tb, x.size::DOUBLE as sa, y.size::DOUBLE as sb
  from cand c join nodes x on x.id = c.id_a join nodes y on y.id = c.id_b),
scores as (select id_a, id_b,
  case when length(na) >= 3 and length(nb) >= 3 then 1 - levenshtein(na, nb)::DOUBLE / greatest(length(na), length(nb), 1) end as edit,
  len(list_intersect(ta, tb))::DOUBLE / (len(ta) + len(tb) - len(list_intersect(ta, tb))) as jac,
  greatest(0, 1 - abs(sa - sb) / greatest(abs(sa), abs(sb), 1)) as num from vals),
best as (select id_a, id_b, edit, jac, num, greatest(coalesce(edit, 0), jac) as name_score from scores)
"""
_PAIR_SQL = "substr(sha1('part|' || id_a || '|' || id_b), 1, 12)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, "part", "p_partkey", name="p_name", size="p_size")


def _part_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = _parts(spark, sf_dir)
    pairs = blocking.token_pairs(nodes, "name")
    return pairs, scoring.dense_scores(pairs, nodes, _PART)


def _surface(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = Resolution(_PART.label, _PART.fields, Rule(mode, 0.85), session_id="part")
        pairs, scores = _part_scores(spark, sf_dir)
        found = scoring.surfaced(pairs, scores, spec).where("surfaced")
        return found.select("pair_id", "id_a", "id_b", _r("score_name").alias("score_name"), _r("score_size").alias("score_size"))

    run.__name__ = f"surface_{mode.replace('weighted-average', 'weighted')}_part"
    return run


for _mode, _where in (("any", "name_score >= 0.95 or num >= 0.95"), ("all", "name_score >= 0.95 and num >= 0.95"), ("weighted-average", "(2 * name_score + num) / 3 >= 0.85")):
    _query(_PARTS_SQL + f"select {_PAIR_SQL} as pair_id, id_a, id_b, round(name_score, 6) as score_name, round(num, 6) as score_size from best where {_where}")(_surface(_mode))


@_query("select a.s_suppkey::VARCHAR as id_a, b.s_suppkey::VARCHAR as id_b from supplier a join supplier b on a.s_suppkey::VARCHAR < b.s_suppkey::VARCHAR")
def block_exhaustive_supplier(spark, sf_dir):
    return blocking.exhaustive_pairs(_nodes(spark, sf_dir, "supplier", "s_suppkey"), limit=None)


@_query(_PARTS_SQL + "select id_a, id_b from cand")
def block_token_part(spark, sf_dir):
    return blocking.token_pairs(_parts(spark, sf_dir), "name")


@_query(_PARTS_SQL + "select coalesce(sum(n * (n - 1) // 2), 0)::BIGINT as n_candidates from (select count(*) as n from keyed group by key having count(*) between 2 and 500)")
def block_token_upper_bound_part(spark, sf_dir):
    return blocking.token_pair_bound(_parts(spark, sf_dir), "name")


@_query("select a.p_partkey::VARCHAR as id_a, b.p_partkey::VARCHAR as id_b from part a join part b on a.p_name = b.p_name and a.p_partkey::VARCHAR < b.p_partkey::VARCHAR")
def block_exact_part(spark, sf_dir):
    return blocking.exact_pairs(_parts(spark, sf_dir), F.col("name"), limit=None, single=True)


@_query("select a.doc_id::VARCHAR as id_a, b.doc_id::VARCHAR as id_b from documents a join documents b on md5(a.text) = md5(b.text) and a.doc_id::VARCHAR < b.doc_id::VARCHAR")
def block_exact_documents(spark, sf_dir):
    # Long texts are blocked by digest: the join's shuffle holds 32 characters a row.
    return blocking.exact_pairs(_nodes(spark, sf_dir, "documents", "doc_id", text="text"), F.md5("text"), limit=None, single=True)


def _prefix_sql(table: str, key: str, value: str, length: int) -> str:
    return f"""
with n as (select {key}::VARCHAR as id, {value} as v from {table} where {value} is not null),
p as (select a.id as w, b.id as m, row_number() over (partition by a.id order by b.v, b.id) as rn from n a join n b on starts_with(b.v, left(a.v, {length})) and (a.v < b.v or (a.v = b.v and a.id < b.id)))
select distinct least(w, m) as id_a, greatest(w, m) as id_b from p where rn <= 50"""


@_query(_prefix_sql("part", "p_partkey", "p_name", 8))
def block_prefix_part(spark, sf_dir):
    return blocking.prefix_pairs(_parts(spark, sf_dir), "name")


@_query(_prefix_sql("customer", "c_custkey", "c_name", 16))
def block_prefix_customer(spark, sf_dir):
    return blocking.prefix_pairs(_nodes(spark, sf_dir, "customer", "c_custkey", name="c_name"), "name", 16)


@_query(_prefix_sql("pages", "page_id", "url", 30))
def block_prefix_pages(spark, sf_dir):
    return blocking.prefix_pairs(_nodes(spark, sf_dir, "pages", "page_id", url="url"), "url", 30)


_NUM_SQL = "greatest(0, 1 - abs(a.{v} - b.{v}) / greatest(abs(a.{v}), abs(b.{v}), 1))"


@_query(f"select a.s_suppkey::VARCHAR as id_a, b.s_suppkey::VARCHAR as id_b, round({_NUM_SQL.format(v='s_acctbal')}, 6) as score from supplier a join supplier b on a.s_suppkey::VARCHAR < b.s_suppkey::VARCHAR where {_NUM_SQL.format(v='s_acctbal')} > 0")
def block_numeric_supplier(spark, sf_dir):
    return blocking.numeric_pairs(_nodes(spark, sf_dir, "supplier", "s_suppkey", v="s_acctbal"), "v", limit=None).withColumn("score", _r("score"))


@_query(f"select a.p_partkey::VARCHAR as id_a, b.p_partkey::VARCHAR as id_b, round({_NUM_SQL.format(v='p_retailprice')}, 6) as score from part a join part b on a.p_partkey::VARCHAR < b.p_partkey::VARCHAR where {_NUM_SQL.format(v='p_retailprice')} >= 0.95")
def block_numeric_band_part(spark, sf_dir):
    return blocking.numeric_pairs(_nodes(spark, sf_dir, "part", "p_partkey", v="p_retailprice"), "v", 0.95).withColumn("score", _r("score"))


@_query("select a.vec_id::VARCHAR as id_a, b.vec_id::VARCHAR as id_b, round(least(1, greatest(0, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 4) as score from embeddings a join embeddings b on a.vec_id::VARCHAR < b.vec_id::VARCHAR")
def block_vector_embeddings(spark, sf_dir):
    return blocking.vector_pairs(_nodes(spark, sf_dir, "embeddings", "vec_id", v="embedding"), "v", limit=None).withColumn("score", F.round("score", 4))


def _nation_pairs(spark, sf_dir) -> DataFrame:
    n = _nodes(spark, sf_dir, "nation", "n_nationkey", name="n_name")
    a, b = n.select(F.col("id").alias("id_a"), F.col("name").alias("x")), n.select(F.col("id").alias("id_b"), F.col("name").alias("y"))
    return a.join(b, F.col("id_a") < F.col("id_b"))


_NATIONS_SQL = "from nation a join nation b on a.n_nationkey::VARCHAR < b.n_nationkey::VARCHAR"


@_query(f"select a.n_nationkey::VARCHAR as id_a, b.n_nationkey::VARCHAR as id_b, round(1 - levenshtein(a.n_name, b.n_name)::DOUBLE / greatest(length(a.n_name), length(b.n_name)), 6) as score {_NATIONS_SQL}")
def metric_edit_nation(spark, sf_dir):
    return _nation_pairs(spark, sf_dir).select("id_a", "id_b", _r(pair_score("edit-distance", F.col("x"), F.col("y"))).alias("score"))


@_query(f"select a.n_nationkey::VARCHAR as id_a, b.n_nationkey::VARCHAR as id_b, (trim(regexp_replace(lower(a.n_name), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(b.n_name), '[^a-z0-9]+', ' ', 'g')))::INT::DOUBLE as score {_NATIONS_SQL}")
def metric_exact_nation(spark, sf_dir):
    return _nation_pairs(spark, sf_dir).select("id_a", "id_b", pair_score("exact-match", F.col("x"), F.col("y")).alias("score"))


@_query()
def metric_jaro_winkler_nation(spark, sf_dir):
    return _nation_pairs(spark, sf_dir).select("id_a", "id_b", _r(pair_score("jaro-winkler", F.col("x"), F.col("y"))).alias("score"))


@_query()
def metric_token_sort_nation(spark, sf_dir):
    return _nation_pairs(spark, sf_dir).select("id_a", "id_b", _r(pair_score("token-sort-ratio", F.col("x"), F.col("y"))).alias("score"))


@_query()
def metric_phonetic_part(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", phonetic("name").alias("code"))


@_query(_PARTS_SQL + "select id_a, id_b, round(jac, 6) as score from best")
def metric_jaccard_part(spark, sf_dir):
    _, scores = _part_scores(spark, sf_dir)
    return scores.where("metric_id = 'token-jaccard'").select("id_a", "id_b", _r("score").alias("score"))


@_query(_PARTS_SQL + "select id_a, id_b, round(num, 6) as score from best")
def metric_numeric_part(spark, sf_dir):
    _, scores = _part_scores(spark, sf_dir)
    return scores.where("metric_id = 'numeric-proximity'").select("id_a", "id_b", _r("score").alias("score"))


_LONG_SQL = _PARTS_SQL + ", long as (select id_a, id_b, 'name' as field_name, 'edit-distance' as metric_id, edit as score from best union all select id_a, id_b, 'name', 'token-jaccard', jac from best union all select id_a, id_b, 'size', 'numeric-proximity', num from best) "


@_query(_LONG_SQL + "select field_name, metric_id, round(quantile_disc(score, 0.5), 6) as p50, round(quantile_disc(score, 0.75), 6) as p75, round(quantile_disc(score, 0.9), 6) as p90, round(quantile_disc(score, 0.95), 6) as p95, round(max(score), 6) as max, count(*) as n from long where score is not null group by 1, 2")
def distributions_part(spark, sf_dir):
    found = scoring.distributions(_part_scores(spark, sf_dir)[1])
    return found.select("field_name", "metric_id", *[_r(c).alias(c) for c in ("p50", "p75", "p90", "p95", "max")], "n")


@_query(_LONG_SQL + "select field_name, metric_id, round(avg((score >= 0.8)::INT), 6) as fraction from long where score is not null group by 1, 2")
def fraction_above_part(spark, sf_dir):
    return scoring.fraction_above(_part_scores(spark, sf_dir)[1], 0.8).withColumn("fraction", _r("fraction"))


@_query("select greatest((select coalesce(sum(n * (n - 1) // 2), 0) from (select count(*) as n from part group by p_name)), (select count(*) * (count(*) - 1) // 2 from part))::BIGINT as n_candidates")
def candidate_widest_part(spark, sf_dir):
    nodes = _parts(spark, sf_dir)
    every = nodes.agg(F.expr("count(1) * (count(1) - 1) div 2").alias("n_candidates"))
    return blocking.value_pair_bound(nodes, "name").unionByName(every).agg(F.max("n_candidates").cast("long").alias("n_candidates"))


@_query("with r as (select doc_id::VARCHAR as id, row_number() over (order by doc_id::VARCHAR) - 1 as rn, count(*) over () as n from documents), w as (select (i * (select count(*) from documents)) // 130 as rn from range(130) t(i)) select id from r where rn in (select rn from w)")
def stride_sample_documents(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, "documents", "doc_id")
    return capture.stride_sample(nodes, nodes.count(), 130).select("id")


@_query("select c_custkey::VARCHAR as id, c_name as name from customer order by c_name, id limit 500")
def capture_batch_customer(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, "customer", "c_custkey", name="c_name")
    return capture.ordered_batch(nodes, "name", capture.CaptureState(), 500)


@_query("select c_custkey::VARCHAR as id, c_name as name from customer where (c_name, c_custkey::VARCHAR) > ('Customer#000000100', '100') order by c_name, id limit 500")
def capture_resume_customer(spark, sf_dir):
    nodes = _nodes(spark, sf_dir, "customer", "c_custkey", name="c_name")
    return capture.ordered_batch(nodes, "name", capture.CaptureState("Customer#000000100", "100"), 500)


_VERDICT_SQL = "case when substr(pair_id, 1, 1) in ('0', '1', '2') then 'duplicate' when substr(pair_id, 1, 1) in ('3', '4') then 'distinct' else 'pending' end"
_PAIRS_SQL = _PARTS_SQL + f", ids as (select *, {_PAIR_SQL} as pair_id from best), pairs as (select *, {_VERDICT_SQL} as verdict, (name_score >= 0.97 or num >= 0.97) as surfaced, greatest(name_score, num) as max_score from ids) "


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Part pairs as a session would hold them: surfaced at 0.97, verdicts by the first digit of the pair's id."""
    fields = tuple(FieldSpec(f.name, f.metrics, 0.97, f.weight) for f in _PART.fields)
    pairs, scores = _part_scores(spark, sf_dir)
    held = scoring.surfaced(pairs, scores, Resolution("part", fields, session_id="part"))
    digit = F.substring("pair_id", 1, 1)
    verdict = F.when(digit.isin("0", "1", "2"), "duplicate").when(digit.isin("3", "4"), "distinct").otherwise("pending")
    return held.withColumn("verdict", verdict), scores


@_query(_PAIRS_SQL + "select count(*) filter (p or k)::BIGINT as surfaced, count(*) filter (p and not surfaced)::BIGINT as added, count(*) filter (surfaced and not (p or k))::BIGINT as removed, count(*) filter (k)::BIGINT as kept_for_verdict from (select *, (name_score >= 0.99 or num >= 0.99) as p, not (name_score >= 0.99 or num >= 0.99) and surfaced and verdict <> 'pending' as k from pairs)")
def refilter_part(spark, sf_dir):
    held, scores = _stored(spark, sf_dir)
    fields = tuple(FieldSpec(f.name, f.metrics, 0.99, f.weight) for f in _PART.fields)
    return scoring.refilter_summary(scoring.refilter(held.select("pair_id", "id_a", "id_b", "verdict", "surfaced"), scores, Resolution("part", fields, session_id="part")))


@_query(_PAIRS_SQL.replace("pairs as (", "pairs as materialized (") + ", old as (select * from pairs where num >= 0.5), fresh as (select *, name_score >= 0.99 as s2 from pairs where num <= 0.8) select coalesce(o.pair_id, f.pair_id) as pair_id, coalesce(o.verdict, 'pending') as verdict, coalesce(o.surfaced, false) or coalesce(f.s2, false) or coalesce(o.verdict, 'pending') <> 'pending' as surfaced from old o full join fresh f on o.pair_id = f.pair_id")
def rerun_upsert_part(spark, sf_dir):
    held, _ = _stored(spark, sf_dir)
    new = held.where("score_size <= 0.8").withColumn("surfaced", F.col("score_name") >= 0.99)
    return review.upsert_pairs(held.where("score_size >= 0.5"), new).select("pair_id", "verdict", "surfaced")


@_query(_PAIRS_SQL + "select verdict, count(*) as n from pairs where surfaced group by 1")
def verdict_counts_part(spark, sf_dir):
    return review.verdict_counts(_stored(spark, sf_dir)[0].where("surfaced"))


@_query(_PAIRS_SQL + "select pair_id, verdict, row_number() over (order by verdict <> 'pending', pair_id) as position from pairs where surfaced")
def queue_pending_first_part(spark, sf_dir):
    return review.queue_positions(_stored(spark, sf_dir)[0]).select("pair_id", "verdict", "position")


@_query(_PAIRS_SQL + "select pair_id, round(max_score, 6) as max_score, row_number() over (order by round(max_score, 9) desc, pair_id) as position from pairs where surfaced")
def queue_score_desc_part(spark, sf_dir):
    held = _stored(spark, sf_dir)[0].withColumn("max_score", F.round("max_score", 9))
    return review.queue_positions(held, "score-desc").select("pair_id", _r("max_score").alias("max_score"), "position")


_EVENTS_SQL = "with e as (select event_id, user_id::VARCHAR as pair_id, ts, case event_id % 3 when 0 then 'pending' when 1 then 'duplicate' else 'distinct' end as verdict, case when event_id % 2 = 0 then 'human' else 'ai' end as decided_by from events)"


def _verdict_log(spark, sf_dir) -> DataFrame:
    third = F.col("event_id") % 3
    return _t(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("pair_id"), F.col("ts").alias("decided_at"), F.when(third == 0, "pending").when(third == 1, "duplicate").otherwise("distinct").alias("verdict"), F.when(F.col("event_id") % 2 == 0, "human").otherwise("ai").alias("decided_by"))


@_query(_EVENTS_SQL + " select pair_id, verdict, case when verdict <> 'pending' then decided_by end as decided_by from (select *, row_number() over (partition by pair_id order by ts desc, event_id desc) as rn from e) where rn = 1")
def latest_verdict_events(spark, sf_dir):
    return review.latest_verdicts(_verdict_log(spark, sf_dir)).select("pair_id", "verdict", "decided_by")


@_query(_PAIRS_SQL + "select pair_id, id_a, id_b, verdict, round(edit, 6) as edit_distance_name, round(jac, 6) as token_jaccard_name, round(num, 6) as numeric_proximity_size from pairs where surfaced")
def export_pivot_part(spark, sf_dir):
    held, scores = _stored(spark, sf_dir)
    keys = [("edit-distance", "name"), ("token-jaccard", "name"), ("numeric-proximity", "size")]
    rows = review.export_rows(held.where("surfaced").select("pair_id", "id_a", "id_b", "verdict"), scores, keys)
    return rows.select("pair_id", "id_a", "id_b", "verdict", *[_r(c).alias(c) for c in ("edit_distance_name", "token_jaccard_name", "numeric_proximity_size")])


@_query(_PAIRS_SQL + "select field_name, metric_id, count(*) as n from (select 'name' as field_name, 'edit-distance' as metric_id, edit as s, verdict from pairs union all select 'name', 'token-jaccard', jac, verdict from pairs union all select 'size', 'numeric-proximity', num, verdict from pairs) where s > 0.95 and verdict = 'distinct' group by 1, 2")
def writeback_high_score_distinct(spark, sf_dir):
    held, scores = _stored(spark, sf_dir)
    return review.high_score_distinct(held, scores)


@_query(_PAIRS_SQL + "select pair_id, role, id from (select pair_id, unnest(['a', 'b']) as role, unnest([id_a, id_b]) as id from pairs where verdict <> 'pending')")
def writeback_involves_part(spark, sf_dir):
    held, scores = _stored(spark, sf_dir)
    return review.write_back(held, scores, _parts(spark, sf_dir))["er_involves"].select("pair_id", "role", "id")


# Documents of equal text as confirmed duplicates: each linked with the next of its group.
def _document_edges(spark, sf_dir) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k"))
    first = docs.groupBy("k").agg(F.min("doc_id").alias("lo"))
    return docs.join(first, "k").where("doc_id <> lo").select(F.col("lo").alias("a"), F.col("doc_id").alias("b"))


@_query("select doc_id as id, lo as component from (select doc_id, min(doc_id) over (partition by md5(text)) as lo, count(*) over (partition by md5(text)) as n from documents) where n > 1")
def clusters_documents(spark, sf_dir):
    return components.connected_components(_document_edges(spark, sf_dir))


@_query("with recursive e as (select n_nationkey::BIGINT as a, (n_nationkey + 3)::BIGINT as b from nation), v as (select a from e union select b from e), r(id, c) as (select a, a from v union select x.o, r.c from r join (select a as i, b as o from e union select b, a from e) x on x.i = r.id) select id, min(c) as component from r group by id")
def clusters_chain(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    return components.connected_components(n.select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_nationkey") + 3).cast("long").alias("b")))


# Parts of equal name and brand as groups; degree by order lines.
_GROUP_SQL = r"""
with nodes as (select p_partkey::VARCHAR as id, p_name as name, p_size as size, case when p_partkey % 3 = 0 then null else p_type end as type from part),
g as (select p_partkey::VARCHAR as id, min(p_partkey::VARCHAR) over (partition by p_name, p_brand) as component, count(*) over (partition by p_name, p_brand) as n from part),
deg as (select l_partkey::VARCHAR as id, count(*) as degree from lineitem group by 1),
cluster as (select g.id, g.component, first_value(g.id) over (partition by g.component order by coalesce(d.degree, 0) desc, g.id) as survivor_id, coalesce(d.degree, 0) as degree from g left join deg d on g.id = d.id where g.n > 1)
"""


def _part_groups(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name", "p_brand")
    first = parts.groupBy("p_name", "p_brand").agg(F.min("id").alias("id_a"))
    decided = parts.join(first, ["p_name", "p_brand"]).where("id <> id_a").select("id_a", F.col("id").alias("id_b"), F.lit("duplicate").alias("verdict"), F.when(F.length("id") % 2 == 0, "human").otherwise("ai").alias("decided_by"))
    edges = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.col("l_partkey").cast("string").alias("dst"), F.lit("CONTAINS").alias("rel_type"), F.col("l_linenumber"))
    degree = merging.degrees(edges)
    return decided, merging.survivors(merging.groups(decided), degree), degree


@_query(_GROUP_SQL + "select id, component, survivor_id from cluster")
def survivor_part_by_degree(spark, sf_dir):
    return _part_groups(spark, sf_dir)[1].select("id", "component", "survivor_id")


@_query(_GROUP_SQL + "select a.component, a.id as id_a, b.id as id_b, a.id = a.component as direct, false as conflict from cluster a join cluster b on a.component = b.component and a.id < b.id")
def direct_transitive_pairs_part(spark, sf_dir):
    decided, cluster, _ = _part_groups(spark, sf_dir)
    return merging.member_pairs(cluster, decided)


def _merge_nodes(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("type"))


@_query(_GROUP_SQL + "select n.* from nodes n left join cluster c on n.id = c.id where c.id is null or c.id = c.survivor_id")
def merge_discard_part(spark, sf_dir):
    _, cluster, degree = _part_groups(spark, sf_dir)
    return merging.merge_nodes(_merge_nodes(spark, sf_dir), cluster, degree, "discard")


_OWNED_SQL = _GROUP_SQL + ", owned as (select coalesce(c.survivor_id, n.id) as owner, n.*, row_number() over (partition by coalesce(c.survivor_id, n.id) order by n.id <> coalesce(c.survivor_id, n.id), coalesce(c.degree, 0) desc, n.id) as rk from nodes n left join cluster c on n.id = c.id) "


@_query(_OWNED_SQL + "select owner as id, arg_max(name, rk) as name, arg_max(size, rk) as size, arg_max(type, rk) as type from owned group by owner")
def merge_overwrite_part(spark, sf_dir):
    _, cluster, degree = _part_groups(spark, sf_dir)
    return merging.merge_nodes(_merge_nodes(spark, sf_dir), cluster, degree, "overwrite")


@_query(_OWNED_SQL + "select owner as id, array_to_string(list_sort(list_distinct(list(size::VARCHAR))), ',') as sizes, coalesce(array_to_string(list_sort(list_distinct(list(type) filter (type is not null))), ','), '') as types from owned group by owner")
def merge_combine_part(spark, sf_dir):
    _, cluster, degree = _part_groups(spark, sf_dir)
    merged = merging.merge_nodes(_merge_nodes(spark, sf_dir), cluster, degree, "combine")
    joined = lambda c: F.array_join(F.array_sort(F.transform(c, lambda v: v.cast("string"))), ",")
    return merged.select("id", joined("size").alias("sizes"), joined("type").alias("types"))


@_query(_GROUP_SQL + "select 'o' || l_orderkey::VARCHAR as src, coalesce(c.survivor_id, l_partkey::VARCHAR) as dst, 'CONTAINS' as rel_type from lineitem left join cluster c on c.id = l_partkey::VARCHAR group by 1, 2")
def rewire_lineitem(spark, sf_dir):
    _, cluster, _ = _part_groups(spark, sf_dir)
    edges = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.col("l_partkey").cast("string").alias("dst"), F.lit("CONTAINS").alias("rel_type"), F.create_map(F.lit("line"), F.col("l_linenumber").cast("string")).alias("props"))
    return merging.rewire(edges, cluster).select("src", "dst", "rel_type")


@_query(_GROUP_SQL + "select survivor_id, array_to_string(list_sort(list(id) filter (id <> survivor_id)), ',') as absorbed, count(*) filter (id <> component and length(id) % 2 = 0)::BIGINT as human, count(*) filter (id <> component and length(id) % 2 <> 0)::BIGINT as ai from cluster group by survivor_id")
def audit_groups_part(spark, sf_dir):
    decided, cluster, _ = _part_groups(spark, sf_dir)
    scores = decided.select("id_a", "id_b", F.lit("exact-match").alias("metric_id"), F.lit("name").alias("field_name"), F.lit(1.0).alias("score"), F.lit(True).alias("above_threshold"))
    found = merging.audit(cluster, decided, scores, "part", "pass-1", "discard", True, 0)
    return found.select("survivor_id", F.array_join("absorbed_ids", ",").alias("absorbed"), F.col("decided_by.human").alias("human"), F.col("decided_by.ai").alias("ai"))


def _customer_neighbours(spark, sf_dir) -> DataFrame:
    orders, customers, nations = (_t(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edges = orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit("PLACED").alias("rel_type")).unionByName(customers.select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"), F.lit("IN").alias("rel_type")))
    nodes = orders.select(name("o", "o_orderkey").alias("id"), F.lit(None).cast("string").alias("display")).unionByName(nations.select(name("n", "n_nationkey").alias("id"), F.col("n_name").alias("display")))
    return review.neighbours(nodes, edges, customers.select(name("c", "c_custkey").alias("id")))


@_query("select 'c' || o_custkey::VARCHAR as id, 'out' as direction, 'PLACED' as rel_type, 'o' || o_orderkey::VARCHAR as neighbour, 'o' || o_orderkey::VARCHAR as display from orders where o_custkey in (select c_custkey from customer) union all select 'c' || c_custkey::VARCHAR, 'out', 'IN', 'n' || c_nationkey::VARCHAR, n_name from customer join nation on c_nationkey = n_nationkey")
def neighbors_customer(spark, sf_dir):
    return _customer_neighbours(spark, sf_dir)


@_query("select conv_id as id, conv_id::VARCHAR || '-' || turn::VARCHAR as chunk_id, turn as index, text from conversations where text is not null")
def passages_conversation(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").withColumn("chunk_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    links = turns.select(F.col("conv_id").alias("id"), "chunk_id")
    return review.passages(links, turns.select("chunk_id", F.col("turn").alias("index"), "text"), turns.select(F.col("conv_id").alias("id")).distinct())


@_query("select * from (values ('c_name', 'identifier'), ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'name')) t(property, kind)")
def profile_kinds_customer(spark, sf_dir):
    return profile.kinds(_t(spark, sf_dir, "customer"), "c_custkey")


@_query("select sum(n)::BIGINT as n_rows, count(*) as n_blocks, max(n) as largest from (select count(*) as n from customer group by substr(c_name, 1, 16))")
def block_suitability_customer(spark, sf_dir):
    return profile.block_suitability(_t(spark, sf_dir, "customer"), "c_name", 16)


_CALLS_SQL = "with calls as (select event_type as kind, case when user_id % 2 = 0 then 'model-a' else 'model-b' end as model, event_id % 1000 as input_tokens, event_id % 100 as output_tokens from events)"


@_query(_CALLS_SQL + " select kind, model, count(*) as calls, sum(input_tokens)::BIGINT as input_tokens, sum(output_tokens)::BIGINT as output_tokens, round(sum(case when model = 'model-a' then (input_tokens * 3 + output_tokens * 15) / 1e6 else 0 end), 6) as cost_usd, count(*) filter (model <> 'model-a')::BIGINT as unpriced from calls group by grouping sets ((), (kind), (model))")
def usage_totals_events(spark, sf_dir):
    calls = _t(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.when(F.col("user_id") % 2 == 0, "model-a").otherwise("model-b").alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"), F.lit(0).cast("long").alias("cache_read_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens"))
    prices = spark.createDataFrame([("model-a", 3.0, 15.0, None, None)], "model string, input_rate double, output_rate double, cache_write_rate double, cache_read_rate double")
    totals = ledger.usage_totals(ledger.priced(calls, prices))
    return totals.select("kind", "model", "calls", "input_tokens", "output_tokens", _r("cost_usd").alias("cost_usd"), "unpriced")


@_query("select event_type as kind, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as sd, count(value) as n from events group by 1")
def job_estimate_samples(spark, sf_dir):
    found = ledger.mean_and_spread(_t(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select(F.col("event_type").alias("kind"), _r("mean").alias("mean"), _r("sd").alias("sd"), "n")


@_query(_PAIRS_SQL + "select pair_id, (rn // 20)::BIGINT as batch, 'P' || (rn % 20 + 1)::VARCHAR as tag from (select pair_id, row_number() over (order by pair_id) - 1 as rn from pairs where verdict = 'pending')")
def batch_tags_part(spark, sf_dir):
    held, _ = _stored(spark, sf_dir)
    return ledger.batches(held).select("pair_id", "batch", "tag")


@_query("select * from (values (1, 'P1', 'duplicate'), (1, 'P2', 'distinct'), (1, 'P3', null), (2, 'P1', null)) t(batch, tag, verdict)")
def classify_parse(spark, sf_dir):
    fenced = '```json\n[{"tag":"P1","verdict":"duplicate"},{"tag":"P1","verdict":"distinct"},{"tag":"P9","verdict":"distinct"},{"tag":"P2","verdict":"distinct"},{"tag":"P3","verdict":"maybe"}]\n```'
    raw = spark.createDataFrame([(1, fenced), (2, "no answer")], "batch int, raw string")
    asked = spark.createDataFrame([(1, "P1"), (1, "P2"), (1, "P3"), (2, "P1")], "batch int, tag string")
    return ledger.parse_responses(raw, asked)


@_query("select a.n_nationkey::VARCHAR as id_a, b.n_nationkey::VARCHAR as id_b, substr(sha1('s1|' || a.n_nationkey::VARCHAR || '|' || b.n_nationkey::VARCHAR), 1, 12) as pair_id " + _NATIONS_SQL)
def pair_ids_nation(spark, sf_dir):
    return _nation_pairs(spark, sf_dir).select("id_a", "id_b", scoring.pair_id("s1", F.col("id_a"), F.col("id_b")).alias("pair_id"))


@_query("select k, round(least(100, 100 * (1 - (1 - k / 100.0::DOUBLE) ** 2)), 6) as coverage from range(0, 101, 5) t(k)")
def coverage_curve(spark, sf_dir):
    k = F.col("id")
    return spark.range(0, 101, 5).select(k.alias("k"), _r(F.least(F.lit(100.0), 100 * (1 - F.pow(1 - k / 100, F.lit(2))))).alias("coverage"))


def queries() -> dict[str, Query]:
    from twinlens.plans import further  # noqa: F401 (registers its queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
