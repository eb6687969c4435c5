"""Exact deduplication by skew-safe combining.

Equal texts are combined three times, each time on digest *and* full text: in
every map task (the partial aggregation), over salted digest groups, and over
the salts.  A text that a third of all rows hold thus reaches each salt group
as one row per map task, and the last step as one row per salt.

The decision returns to the documents over the digest, which carries no text.
Should two different texts share a digest, which the text-keyed groups show,
their documents are matched on the text too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Salt groups of a digest.
SALTS = 16


def exact_groups(docs: DataFrame, text: Column | None = None, salts: int = SALTS) -> DataFrame:
    """One row per distinct text: sha, body, keep_id (largest doc_id), group_size."""
    body = text_or_empty() if text is None else text
    rows = docs.select("doc_id", body.alias("body")).select("doc_id", "body", F.sha2("body", 256).alias("sha"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    winners = rows.groupBy("sha", "salt", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return winners.groupBy("sha", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, text: Column | None = None, salts: int = SALTS) -> DataFrame:
    """Groups of equal texts; of each, the row with the largest doc_id stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256: one row per row of
    ``docs``.  A null text counts as empty.  ``group_size`` counts rows; repeated
    rows with one doc_id count each and share one verdict.  A null doc_id never
    stays unless its group has no other (keep_id is null then).  An empty table
    gives no rows; other columns are ignored.
    """
    body = text_or_empty() if text is None else text
    found = exact_groups(docs, body, salts)
    # The text leaves here unless its digest is shared; lengths stand in for it in the count.
    groups = stored(found.select("sha", "keep_id", "group_size", F.xxhash64("body").alias("check")), "exact-groups")
    clashes = groups.groupBy("sha").count().where("count > 1").select("sha")
    rows = docs.select("doc_id", F.sha2(body, 256).alias("sha"), F.xxhash64(body).alias("check"))
    if clashes.isEmpty():
        placed = rows.drop("check").join(groups.drop("check"), "sha")
    else:
        clashing = stored(clashes, "exact-clashes")
        plain = rows.drop("check").join(clashing, "sha", "left_anti").join(groups.drop("check"), "sha")
        whole = docs.select("doc_id", body.alias("body")).withColumn("sha", F.sha2("body", 256)).join(clashing, "sha", "left_semi")
        placed = plain.unionByName(whole.join(found.join(clashing, "sha", "left_semi"), ["sha", "body"]).drop("body"))
    return placed.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


ORACLE_SQL = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM rows WINDOW g AS (PARTITION BY body)
"""
