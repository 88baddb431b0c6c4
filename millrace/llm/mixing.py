"""Mixing sources to target weights by capped water-filling.

A source's target is its weighted share of the budget, clamped at ``max_epochs`` times its size; what a
clamped source can't take is shared by the others in proportion to their weights until none is above its
clamp. With the sources in ascending order of clamp / weight the clamped ones are a prefix, so the water
level follows from running sums and needs no rounds.

Every document is then taken ``floor(target / size of its source)`` times, and once more if it comes early
enough in a seeded order: documents are ordered by a hash of seed and id, and the extra copies go to the
first ones until the rest of the target is used up. That order needs a running total over a source, which
may hold most of the rows. So hashes are cut into ``BINS`` bins; totals per bin combine before the shuffle,
one bin per source holds the cut, and only that bin's rows are ordered.

Defined cases: a null text has size 0; null sources form one source, ordered last; a null doc_id hashes like
the word ``null``; repeated rows each count; an empty table gives an empty table; columns beside doc_id, text
and source pass through, also where they are called size or target (those are replaced). Only one row per
source goes to one task: sources are what a user gives weights to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import documents, n_words

BINS_HEX = 4
WEIGHTS = (5, 2, 1)


def _hash(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target): the weights repeat over the sources by code point."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    filling = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    return (
        sizes.withColumn("__w", weight.cast("long"))
        .withColumn("__cap", F.lit(max_epochs) * F.col("source_size"))
        .withColumn("__budget", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("__left", F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__open", F.sum("__w").over(after))
        .withColumn("__full", F.col("__cap") * F.col("__open") <= F.col("__left") * F.col("__w"))
        .withColumn("__spent", F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))).over(every), F.lit(0)))
        .withColumn("__weights", F.coalesce(F.sum(F.when(~F.col("__full"), F.col("__w"))).over(every), F.lit(0)))
        .withColumn("__level", F.try_divide(F.col("__budget") - F.col("__spent"), F.col("__weights").cast("double")))
        .select("source", "source_size", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.col("__level") * F.col("__w")).alias("target"))
    )


def _planned(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """``docs`` with __size, __source_size, __target and __copies, one row per input row."""
    sized = docs.withColumn("__size", n_words()).withColumn("__h", _hash(seed))
    sized = sized.withColumn("__bin", F.substring("__h", 1, BINS_HEX))
    bins = materialize(sized.groupBy("source", "__bin").agg(F.sum("__size").alias("__words")))
    goals = targets(bins.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, share, max_epochs)
    goals = goals.withColumn("__whole", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)))
    goals = goals.withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size"))
    goals = materialize(goals)
    running = F.sum("__words").over(Window.partitionBy("b.source").orderBy("__bin"))
    # the bin in which the running total passes the rest; a source without such a bin takes every document once more
    cut = (
        bins.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
        .select(F.col("b.source").alias("source"), "__bin", "__rest", (running - F.col("__words")).alias("__before"), running.alias("__through"))
        .filter((F.col("__through") > F.col("__rest")))
        .groupBy("source").agg(F.min_by(F.struct("__bin", "__before"), "__bin").alias("__cut"))
    )
    plan = goals.alias("g").join(cut.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left")
    plan = materialize(plan.select(F.col("g.source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), "__whole", "__rest", F.col("__cut.__bin").alias("__at"), F.col("__cut.__before").alias("__before")))
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("__s")))
    inside = F.coalesce(F.col("__bin") == F.col("__at"), F.lit(False))
    clear = placed.filter(~inside).withColumn("__copies", F.col("__whole") + (F.col("__at").isNull() | (F.col("__bin") < F.col("__at"))).cast("long"))
    order = Window.partitionBy("source").orderBy("__h", "doc_id", "__size")
    total = F.col("__before") + F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # a document at the edge is taken if the total then is nearer to the target than without it
    edge = placed.filter(inside).withColumn("__copies", F.col("__whole") + (total - F.col("__size") / 2 <= F.col("__rest")).cast("long"))
    out = clear.unionByName(edge)
    out = out.withColumn("__copies", F.when(F.col("__rest") > 0, F.col("__copies")).otherwise(F.col("__whole")))
    return out.select(*docs.columns, "__size", "__source_size", "__target", "__copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and copies, one row per input row."""
    made = ("size", "source_size", "target", "copies")
    return _planned(docs, **options).select(*[c for c in docs.columns if c not in made], *[F.col(f"__{c}").alias(c) for c in made])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    repeats = F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))  # no copies, no row
    return _planned(docs, **options).withColumn("__copy", repeats).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix:' || coalesce(doc_id::varchar, 'null')) as h
  from documents),
sizes as (
  select source, sum(size)::bigint as source_size,
    ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w
  from sized group by source),
filling as (
  select *, 2 * source_size as cap, 1.5::double * sum(source_size) over ()::bigint as budget,
    sum(w) over (order by (2 * source_size)::double / w, source nulls last rows between current row and unbounded following)::bigint as open_w,
    coalesce(sum(2 * source_size) over (order by (2 * source_size)::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as cap_before
  from sizes),
fulls as (select *, cap * open_w <= (budget - cap_before) * w as is_full from filling),
levels as (
  select *, (budget - coalesce(sum(cap) filter (is_full) over (), 0)::bigint) / nullif(sum(w) filter (not is_full) over (), 0)::double as level from fulls),
goals as (select source, source_size, case when is_full then cap::double else level * w end as target from levels),
parts as (
  select *, coalesce(floor(target / nullif(source_size, 0)::double), 0)::bigint as whole from goals),
run as (
  select s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as rest,
    sum(s.size) over (partition by s.source order by s.h, s.doc_id, s.size rows between unbounded preceding and current row)::bigint as through
  from sized s join parts p on s.source is not distinct from p.source)
select doc_id, size, source_size, target,
  (size * (whole + case when rest > 0 and through - size / 2.0::double <= rest then 1 else 0 end))::bigint as taken
from run
"""
