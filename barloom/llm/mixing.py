"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Documents of a source queue in shuffled order (of a hash of their ids) and, where the target is
above the source's size, queue again, up to `epochs` times. A copy's virtual finish time is the
words its source has sent by then, divided by the source's target: every source reaches its target
at time 1. All copies are sorted by finish time and the mix ends where the total budget does. Copies that
finish after time 2 are left out before sorting; the budget lies at time 1 but for single documents.

Both running totals are taken in two steps so that no task holds a source or the table: totals of
buckets first (4096 of a source's hash order, and 4096 per unit of finish time), then rows inside a
bucket. Only one row, the last copy that fits, passes the driver.

Nulls and odd input: a null text has size 0 and is taken without weight; a null source is a source
of its own, last in order; a source without words has target 0; rows that repeat an id are mixed
each for itself; an empty table gives an empty result; other columns are carried by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, table
from barloom.storage import written

BUCKETS = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """(source, source_no, source_size, target) from one row (source, source_size) per source.

    Shares by weight of all words; a target stops at `epochs` times its source, and the excess goes
    to the others by weight until none is above. That is one level for all: sorted by the level at
    which each source is full, the first whose own level the rest of the words does not reach gives it.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", "source_no")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wheel = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("source_no", F.row_number().over(by_code_point)).withColumn(
        "weight", F.element_at(wheel, ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    )
    levelled = (
        ranked.withColumn("full", F.col("source_size") * epochs)
        .withColumn("full_at", F.col("full") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(onward))
        .withColumn("place", F.row_number().over(by_level))
    )
    fits = F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))
    level = F.min(fits).over(everything)["level"]
    return levelled.withColumn(
        "target", F.least(F.col("full").cast("double"), F.col("weight") * level)
    ).select("source", "source_no", "source_size", "target")


def queued(docs: DataFrame, keep: list[str], seed: str, weights, epochs: int) -> DataFrame:
    """Every row with its size, its source's size and target, and __sent: words of its source up to it."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(
        *keep,
        F.col("source").alias("__source"),
        words(F.col("text")).alias("__size"),
        key.alias("__key"),
    ).withColumn("__bucket", F.conv(F.substring("__key", 1, 3), 16, 10).cast("int"))
    sized = written(sized, "mix-sizes")
    per_bucket = written(
        sized.groupBy("__source", "__bucket").agg(F.sum("__size").alias("in_bucket")), "mix-buckets"
    )
    per_source = targets(
        per_bucket.groupBy(F.col("__source").alias("source")).agg(F.sum("in_bucket").alias("source_size")),
        weights,
        epochs,
    )
    earlier = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        per_bucket.withColumn("__before", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
        .join(per_source, F.col("__source").eqNullSafe(F.col("source")))
        .select(
            F.col("__source").alias("s"),
            F.col("__bucket").alias("b"),
            "__before",
            F.col("source_no").alias("__no"),
            F.col("source_size").alias("__source_size"),
            F.col("target").alias("__target"),
        )
    )
    inside = (
        Window.partitionBy("__source", "__bucket")
        .orderBy("__key", "__size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = sized.withColumn("__within", F.sum("__size").over(inside))
    return (
        ranked.join(
            offsets, F.col("__source").eqNullSafe(F.col("s")) & (F.col("__bucket") == F.col("b"))
        )
        .withColumn("__sent", F.col("__before") + F.col("__within"))
        .drop("s", "b", "__before", "__within", "__bucket", "__source", "__key")
    )


def place(copy: Column | int) -> Column:
    """The sort key of a document's copy: finish time, then source, words sent and copy."""
    copy = F.lit(copy) if isinstance(copy, int) else copy
    sent = F.col("__source_size") * copy + F.col("__sent")
    finish = F.when(F.col("__target") > 0, sent / F.col("__target")).otherwise(F.lit(0.0))
    return F.struct(
        finish.alias("finish"), F.col("__no").alias("no"), F.col("__sent").alias("sent"), copy.alias("copy")
    )


def last_copy(queue: DataFrame, epochs: int):
    """The place of the last copy that the budget (all words) holds, as one Row; None without words."""
    copies = (
        queue.where("__size > 0")
        .select(
            "__size",
            F.explode(F.array(*[place(e) for e in range(epochs)])).alias("at"),
        )
        .where(F.col("at.finish") <= 2.0)
        .withColumn("slot", F.floor(F.col("at.finish") * BUCKETS).cast("int"))
    )
    per_slot = copies.groupBy("slot").agg(F.sum("__size").alias("in_slot"))
    earlier = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slot.select(
        "slot", F.coalesce(F.sum("in_slot").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("slot").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = copies.withColumn("within", F.sum("__size").over(inside)).join(before, "slot")
    budget = queue.agg(F.sum("__size").alias("budget")).first()["budget"]
    return (
        running.where(F.col("before") + F.col("within") <= F.lit(budget))
        .agg(F.max("at").alias("at"))
        .first()["at"]
    )


def mix(
    docs: DataFrame,
    keep: list[str],
    seed: str = "mix:",
    weights: tuple[int, ...] = (1, 2, 3),
    epochs: int = 3,
) -> DataFrame:
    """The columns `keep` of every row with size, source_size, target, taken and copies."""
    queue = written(queued(docs, keep, seed, weights, epochs), "mix-queue")
    last = last_copy(queue, epochs)
    copies = F.lit(0)
    if last is not None:
        end = F.struct(
            F.lit(last["finish"]).alias("finish"),
            F.lit(last["no"]).alias("no"),
            F.lit(last["sent"]).cast("long").alias("sent"),
            F.lit(last["copy"]).alias("copy"),
        )
        for e in range(epochs):
            copies = copies + F.when((F.col("__target") > 0) & (place(e) <= end), 1).otherwise(0)
    return queue.select(
        *keep,
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * copies).cast("long").alias("taken"),
        copies.alias("copies"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix with their own columns; a document taken twice appears twice."""
    columns = docs.columns
    packed = docs.select("doc_id", "source", "text", F.struct(*columns).alias("__row"))
    return (
        mix(packed, ["__row"])
        .where("copies > 0")
        .select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("__row.*")
    )


def query(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mix(docs, ["doc_id"]).drop("copies")


SQL = r"""
with sized as (
  select doc_id, source, md5('mix:' || doc_id) as k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents
), ranked as (
  select source, sum(size)::bigint as s, row_number() over (order by source nulls last) as no from sized group by source
), weighted as (
  select *, (no - 1) % 3 + 1 as w, s * 3 as f, (s * 3)::double / ((no - 1) % 3 + 1) as full_at from ranked
), levels as (
  select *, row_number() over (order by full_at, no) as place,
    ((sum(s) over ()) - coalesce(sum(f) over (order by full_at, no rows between unbounded preceding and 1 preceding), 0))::double
      / (sum(w) over (order by full_at, no rows between current row and unbounded following))::double as level
  from weighted
), chosen as (select arg_min(level, place) as level from levels where level <= full_at
), goals as (
  select source, no, s, least(f::double, w * chosen.level) as target from levels, chosen
), queue as (
  select doc_id, size, s, no, target,
         sum(size) over (partition by sized.source order by k, size rows unbounded preceding)::bigint as sent
  from sized join goals on sized.source is not distinct from goals.source
), copies as (
  select doc_id, size, no, sent, e, (s * e + sent)::double / target as finish
  from queue, (values (0), (1), (2)) v(e) where target > 0
), ordered as (
  select *, sum(size) over (order by finish, no, sent, e rows unbounded preceding) as running
  from copies where finish <= 2
), took as (
  select doc_id, count(*) as n from ordered where running <= (select sum(size) from sized) group by doc_id
)
select q.doc_id, q.size, q.s as source_size, q.target, (q.size * coalesce(n, 0))::bigint as taken
from queue q left join took using (doc_id)
"""
