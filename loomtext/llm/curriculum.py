"""Mixing sources to time-varying target weights (operator 6).

A schedule gives each source's weight at knots of training progress t from 0 to 1; weights
are normalised at every knot and linear between. Integrated and multiplied by the token
budget they are each source's cumulative demand. A source's documents stand in a seeded
random order; the middle of a document's token interval in that order, put into the inverse
of the demand, is the document's training position. A source with less supply than demand
starts again, as often as it takes; what a source has beyond its demand gets no position.
Tokens are counted as characters of the text, or as the column size tells: SQL can count
those. What a run places is bounded by its budget of tokens, however small a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.shared import content_key, join_checked, materialise, own_names, table

SEED = "curriculum"
#: The production schedule: natural shares until here, then towards shares of a power of the natural ones.
TURN = 0.5
TEMPER = 0.5


def _units(docs: DataFrame, size: Column | None) -> DataFrame:
    """Distinct (source, doc_id, text): slim rows with their size and place in the random order."""
    size = F.length("text") if size is None else size
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), content_key(F.col("text")).alias("content"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    placed = slim.distinct().withColumn("pool", F.coalesce("source", F.lit(""))).withColumn("draw", F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    return placed.withColumn("bucket", F.substring("draw", 1, 3))


def _queued(units: DataFrame) -> DataFrame:
    """units with the tokens of their source that stand before each.

    Totals of 4,096 buckets of the random order are summed up first; so no task ever holds
    a whole source, however hot.
    """
    totals = units.groupBy("pool", "bucket").agg(F.sum("size").alias("all"))
    upto = Window.partitionBy("pool").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("base", F.coalesce(F.sum("all").over(upto), F.lit(0))).select("pool", "bucket", "base")
    within = Window.partitionBy("pool", "bucket").orderBy("draw", "doc_id", "size", "content").rowsBetween(Window.unboundedPreceding, -1)
    return units.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["pool", "bucket"]).withColumn("before", F.col("base") + F.col("inside")).drop("base", "inside")


def natural_schedule(supply: DataFrame, turn: float = TURN, temper: float = TEMPER) -> DataFrame:
    """(source, t, weight): the natural share of each source until turn, at 1 its power temper."""
    share = F.col("supply").cast("double")
    knots = F.array(*[F.struct(F.lit(t).alias("t"), w.alias("weight")) for t, w in ((0.0, share), (turn, share), (1.0, F.pow(share, F.lit(temper))))])
    return supply.select(F.col("pool").alias("source"), F.explode(knots).alias("k")).select("source", "k.t", "k.weight")


def _segments(schedule: DataFrame, budget: float) -> DataFrame:
    """A row for each source and pair of neighbouring knots, with the demand at its start and end."""
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    knots = schedule.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("pool"), F.col("t").cast("double").alias("t"), weight.alias("w")).groupBy("pool", "t").agg(F.sum("w").alias("w"))
    sums = knots.groupBy("t").agg(F.sum("w").alias("sum"))
    shares = knots.join(sums, "t").select("pool", "t", F.when(F.col("sum") > 0, F.col("w") / F.col("sum")).otherwise(0.0).alias("w"))
    by_time = Window.partitionBy("pool").orderBy("t")
    pairs = shares.select("pool", F.col("t").alias("t0"), F.lead("t").over(by_time).alias("t1"), F.col("w").alias("w0"), F.lead("w").over(by_time).alias("w1"), F.col("t").alias("t")).where("t1 IS NOT NULL")
    area = budget * (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0"))
    done = pairs.withColumn("area", area).withColumn("high", F.sum("area").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("high").over(Window.partitionBy("pool"))
    return done.select("pool", "t0", "t1", "w0", "w1", (F.col("high") - F.col("area")).alias("low"), "high", last.alias("demand"), (F.lead("t0").over(by_time).isNull()).alias("ends"))


def positions(docs: DataFrame, schedule: DataFrame | None = None, budget: float | None = None, max_epochs: int | None = None, size: Column | None = None) -> DataFrame:
    """(doc_id, source, content, epoch, position) of every document placed, once an epoch.

    schedule has (source, t, weight) with the same knots for all sources, the first at 0 and
    the last at 1; sources it lacks have the weight 0; None stands for natural_schedule().
    budget is the run's tokens; None: all that there are. max_epochs bounds repeats; what a
    source then lacks of its demand stays empty. size is each text's count of tokens, None
    for its characters. A null source is the source ''. Null and empty texts have no tokens
    and stand at their place in the order, once; at 0 if their source has none at all. A very
    long text has the position of its middle. Rows repeated with one source, doc_id and text
    count once. On ties in the random order the doc_id, the size and the content key decide.
    An empty table gives no rows.
    """
    units = materialise(_units(docs, size))
    supply = materialise(units.groupBy("pool").agg(F.sum("size").alias("supply")))
    budget = float(supply.agg(F.sum("supply")).first()[0] or 0) if budget is None else float(budget)
    segments = _segments(natural_schedule(supply) if schedule is None else schedule, budget)
    plan = materialise(segments.join(supply.where("supply > 0"), "pool"))
    epochs = F.ceil(F.col("demand") / F.col("supply"))
    epochs = F.when(F.col("size") > 0, epochs if max_epochs is None else F.least(F.lit(max_epochs), epochs)).otherwise(1).cast("int")
    placed = join_checked(_queued(units), plan, ["pool"], "inner", 160 + F.octet_length("pool")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), epochs - 1))))
    at = F.col("epoch") * F.col("supply") + F.col("before") + F.col("size") / 2.0
    here = placed.withColumn("at", at).where("at >= low AND (at < high OR (ends AND at <= high)) AND high > low")
    bare = supply.where("supply = 0").select("pool")
    lone = join_checked(units, bare, ["pool"], "left_semi", 64 + F.octet_length("pool")).select("doc_id", "source", "content", F.lit(0).alias("epoch"), F.lit(0.0).alias("position"))
    q = (F.col("at") - F.col("low")) / F.lit(budget or 1.0)
    root = F.sqrt(F.greatest(F.col("w0") * F.col("w0") + 2 * (F.col("w1") - F.col("w0")) / (F.col("t1") - F.col("t0")) * q, F.lit(0.0)))
    x = F.when(q <= 0, 0.0).otherwise(2 * q / (F.col("w0") + root))
    return here.select("doc_id", "source", "content", "epoch", F.round(F.least(F.col("t0") + x, F.col("t1")), 9).alias("position")).union(lone)


@own_names
def mixed(docs: DataFrame, schedule: DataFrame | None = None, budget: float | None = None, max_epochs: int | None = None, size: Column | None = None) -> DataFrame:
    """The rows of docs, all columns unchanged, range-sorted by training position, once for each epoch they are placed in.

    A row's epochs stand in their order; pieces.encoded_in_order() numbers them again. Nulls,
    empty and long texts, ties, repeated rows and empty tables are as in positions(); repeated
    rows have one position and all stand there.
    """
    at = positions(docs, schedule, budget, max_epochs, size).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("content").alias("__content"), F.col("epoch").alias("__epoch"), F.col("position").alias("__position"))
    at = materialise(at)
    keyed = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__from": F.col("source").cast("string"), "__key": content_key(F.col("text"))})
    on = F.col("__doc").eqNullSafe(F.col("__id")) & F.col("__from").eqNullSafe(F.col("__source")) & F.col("__key").eqNullSafe(F.col("__content"))
    return join_checked(keyed, at, on, "inner", 208 + F.coalesce(F.octet_length("__source"), F.lit(0))).orderBy("__position", "__source", "__id", "__epoch").select(*docs.columns)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(table(spark, sf_dir, "documents")).drop("content").orderBy("position", "source", "doc_id", "epoch")


QUERIES = {"op6_curriculum_mixing": op6}
SQL = {
    "op6_curriculum_mixing": f"""
with units as (
  select doc_id, source, coalesce(source, '') pool, coalesce(length(text), 0) size, md5('{SEED}' || coalesce(doc_id::varchar, '')) draw
  from (select distinct doc_id, source, text from documents)),
queued as (
  select *, coalesce(sum(size) over (partition by pool order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0) "before" from units),
supply as (select pool, sum(size)::double supply from units group by pool),
run as (select sum(supply) budget, sum(pow(supply, {TEMPER})) tempered from supply),
plan as (
  select pool, supply, budget, supply / budget w0, pow(supply, {TEMPER}) / tempered w1,
    budget * (supply / budget) * {TURN} turn, budget * (supply / budget) * {TURN} + budget * (supply / budget + pow(supply, {TEMPER}) / tempered) / 2 * {1 - TURN} demand
  from supply, run),
placed as (
  select q.*, p.*, e.epoch, e.epoch * supply + "before" + size / 2.0 "at"
  from queued q join plan p using (pool), lateral (select unnest(range(case when size > 0 and supply > 0 then ceil(demand / supply)::bigint else 1 end)) epoch) e),
solved as (
  select *, greatest(w0 * w0 + 2 * (w1 - w0) / {1 - TURN} * ("at" - turn) / budget, 0) inner_root from placed where "at" <= demand)
select doc_id, source, epoch::int epoch,
  round(case when supply = 0 then 0 when "at" < turn then least(2 * ("at" / budget) / (w0 + w0), {TURN})
    else least({TURN} + case when "at" <= turn then 0 else 2 * (("at" - turn) / budget) / (w0 + sqrt(inner_root)) end, 1) end, 9) "position"
from solved
"""
}
