"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key.  Within a source the documents are range
partitioned on that key into buckets and sorted in each; bucket totals give the
distributed prefix sums of word counts, and each source is cut where its prefix
sum meets its budget.  Whole epochs are taken before the cut.

Scale: the texts are read once, by the word count; all later steps carry four
short columns.  A source's rows are spread over many key buckets, so a source
with a third of all rows is no larger a task than any other.  The one window
without a partition ranges over sources, not documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_or_empty

#: Rows that a key bucket holds on average.
BUCKET_ROWS = 1024
#: Bits of the key.
KEY_BITS = 60


def source_targets(totals: DataFrame, weights: Sequence[int], most_epochs: int) -> DataFrame:
    """Targets by water filling: every source under its ceiling gets the same amount for each unit of weight.

    ``totals`` has ``skey``, ``source`` and ``source_size``.  Sources that reach
    the ceiling of ``most_epochs`` times their size first, in order of ceiling
    by weight, are fixed there; the rest share what is left.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    levels = ranked.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(int(most_epochs)))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    levels = (
        levels.withColumn("before", F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", F.col("ceiling") * F.col("rest_weight") <= F.col("weight") * (F.col("total") - F.col("before")))
    )
    # The order makes "full" true for a leading run only; the first source after it sets the level.
    fixed = Window.partitionBy()
    levels = levels.withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("ceiling"))).over(fixed), F.lit(0))).withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(fixed))
    share = (F.col("weight") * (F.col("total") - F.col("spent"))).cast("double") / F.col("open_weight")
    return levels.select("skey", "source", "source_size", F.when(F.col("full"), F.col("ceiling").cast("double")).otherwise(share).alias("target"))


def hash_key(seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most_epochs: int = 3, seed: int = 8, size: Column | None = None) -> DataFrame:
    """How many words of each document a mix takes whose sources follow ``weights``.

    Sources sorted by code point, a null source last, weigh ``weights`` in turn.
    They share the total size; no target exceeds ``most_epochs`` times its
    source, and what is above is shared again by weight.  A source's budget is
    its target rounded to a word; ``taken`` sums to it exactly: every document
    once for each whole epoch, then documents in order of their random key, the
    last one in part.

    Returns doc_id, size, source, source_size, target, taken: one row per row of
    ``docs``.  A null text has size 0, a null doc_id gets a key like any other
    value, repeated rows have one key and are ordered by size (equal rows are
    interchangeable), an empty table gives no rows.  Other columns are ignored.
    """
    words = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long") if size is None else size
    skey = F.coalesce(F.concat(F.lit("v"), F.col("source").cast("string")), F.lit("n"))
    rows = stored(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), skey.alias("skey"), words.alias("size"), hash_key(seed).alias("key")), "mix-sizes")

    buckets = max(1, min(65536, rows.count() // BUCKET_ROWS))
    shift = 2 ** (KEY_BITS - 30)
    rows = rows.withColumn("bucket", F.floor(F.floor(F.col("key") / F.lit(shift)) * buckets / F.lit(2**30)).cast("int"))
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    totals = sums.groupBy("skey").agg(F.sum("bucket_size").alias("source_size"), F.first("source").alias("source"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    plan = source_targets(totals, weights, most_epochs).withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")).drop("source")
    starts = sums.drop("source").withColumn("start", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cuts = starts.join(plan, "skey").drop("bucket_size")

    within = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(cuts, ["skey", "bucket"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("ahead")))
    return placed.select("doc_id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words are taken, to the nearest whole number.

    Keeps the columns of ``docs``.  Rows with the same doc_id are taken alike, by
    the mean of their shares; a document without words is kept once, as it costs
    nothing.  ``doc_id`` must not be null for a row to be repeated.
    """
    plan = mix_sources(docs, **options)
    share = F.when(F.sum("size") > 0, F.floor(F.sum("taken") / F.sum("size") + 0.5)).otherwise(1).cast("int")
    copies = plan.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("mix_doc_id")).agg(share.alias("mix_copies"))
    joined = docs.join(copies, docs["doc_id"] == copies["mix_doc_id"], "left")
    times = F.coalesce(F.col("mix_copies"), F.lit(1))
    return joined.withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1))))).where(times > 0).select(*[docs[c] for c in docs.columns])


#: The same plan in DuckDB: one window over a source in place of the buckets.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM totals),
levels AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS ceiling FROM ranked),
filled AS (
  SELECT *, coalesce(sum(ceiling) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight, sum(source_size) OVER () AS total
  FROM levels WINDOW o AS (ORDER BY ceiling / weight, rank)),
marked AS (SELECT *, ceiling * rest_weight <= weight * (total - before) AS full_up FROM filled),
spent AS (SELECT *, coalesce(sum(ceiling) FILTER (full_up) OVER (), 0) AS gone, sum(weight) FILTER (NOT full_up) OVER () AS open_weight FROM marked),
targets AS (
  SELECT source, source_size, CASE WHEN full_up THEN ceiling::DOUBLE ELSE (weight * (total - gone))::DOUBLE / open_weight END AS target FROM spent),
plan AS (SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM rows)
SELECT doc_id, size, p.source_size, p.target,
       (p.epochs * size + greatest(0, least(size, p.budget - p.epochs * p.source_size - ahead)))::BIGINT AS taken
FROM placed JOIN plan p ON placed.source IS NOT DISTINCT FROM p.source
"""
