"""Mixing sources to target weights with DataFrame functions only.

Token counts are aggregated per source (map-side combined, so a source with a
third of all rows costs one row per task), the shares are water-filled over the
small source table, and each document is emitted floor(rate) times plus one
Bernoulli copy whose coin is a hash of seed and document id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.sources.scratch import materialise

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def coin(id_text: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:id)."""
    digest = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_text, F.lit("")))), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, source_col: str, size_col: str, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): shares of all tokens by weight, held at ``cap`` times a source's size.

    The excess of held sources goes to the others by weight until none is above
    its limit. That is the level L with sum(min(limit, L * weight)) = total: with
    the sources sorted by limit / weight, the first whose limit is not below the
    level that its predecessors leave. Only one row per source enters the windows.
    """
    totals = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (turn % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * cap)
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("ceiling").over(before), F.lit(0))) / (
        F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    first = F.first(F.when(F.col("level") <= F.col("ceiling") / F.col("weight"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        ranked.withColumn("level", level)
        .withColumn("found", first)
        .select("source", "source_size", F.least(F.col("ceiling").cast("double"), F.col("found") * F.col("weight")).alias("target"))
    )


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: id, size, source_size, target, copies, taken and the columns of ``keep``.

    Null texts have size 0; a document of size 0 is taken 0 times. Null sources
    form one source, last in order. A null id tosses the coin of the empty
    string; rows repeated under one id toss alike. If nothing has a word, all
    targets are 0. An empty table gives an empty result. Columns whose names
    clash with the result's are not read unless named in ``keep``.
    """
    sized = docs.select(F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("_size"), F.col(source_col).alias("_source"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    # Written out, the table of sources has a known size: it is broadcast only below the session's threshold.
    targets, _ = materialise(source_targets(sized, "_source", "_size", weights, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    extra = F.when(coin(F.col("_id").cast("string"), seed) < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return (
        sized.join(targets, F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("_rate", rate)
        .withColumn("copies", F.when(F.col("_size") > 0, F.floor("_rate") + extra).otherwise(F.lit(0)).cast("int"))
        .select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("_size") * F.col("copies")).alias("taken"), *[F.col(f"_keep_{c}").alias(f"kept_{c}") for c in keep])
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as :func:`with_copies` says, same columns."""
    counted = with_copies(docs, id_col, text_col, source_col, weights, cap, seed, keep=tuple(docs.columns))
    repeated = counted.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents
), totals as (
  select source, sum(size)::BIGINT as source_size from sized group by source
), ranked as (
  select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::INT] as weight, source_size * 3 as ceiling from totals
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(ceiling) over before, 0))::DOUBLE
          / (sum(weight) over () - coalesce(sum(weight) over before, 0))::DOUBLE as level
  from ranked
  window before as (order by ceiling / weight, source nulls last rows between unbounded preceding and 1 preceding)
), level as (
  select arg_min(level, ceiling / weight) as found from levels where level <= ceiling / weight
), targets as (
  select source, source_size, least(ceiling::DOUBLE, found * weight) as target from levels, level
), rated as (
  select s.doc_id, s.size, t.source_size, t.target,
    case when t.source_size > 0 then least(3.0::DOUBLE, t.target / t.source_size) else 0.0::DOUBLE end as rate,
    ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE as coin
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size::BIGINT as size, source_size, target,
  case when size > 0 then size * (floor(rate) + case when coin < rate - floor(rate) then 1 else 0 end) else 0 end::BIGINT as taken
from rated
"""
