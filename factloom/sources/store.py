"""Facts, vectors and blobs at rest: Parquet folders on any filesystem that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.model import ENCODINGS, Attribute, FactSet, InPairs

BLOBS = "handle binary, bytes binary, length long"


def write_facts(facts: FactSet, path: str, mode: str = "errorifexists") -> None:
    """A folder per attribute, sorted by (e, v) within files, so entity filters skip row groups."""
    for n, a in facts.attributes.items():
        if n in facts.data:
            facts.pairs(n).sortWithinPartitions("e", "v").write.mode(mode).parquet(f"{path}/{a.id}")
    spark = next(iter(facts.data.values())).pairs().sparkSession
    rows = [(a.id, a.name, a.encoding, a.multi, a.iri or "") for a in facts.attributes.values()]
    spark.createDataFrame(rows, "id string, name string, encoding string, multi boolean, iri string").coalesce(1).write.mode(mode).parquet(f"{path}/_schema_facts")


def read_facts(spark: SparkSession, *paths: str) -> FactSet:
    """One or more folders as one set; segments that repeat a fact hold it once."""
    out: FactSet | None = None
    for path in paths:
        rows = spark.read.parquet(f"{path}/_schema_facts").distinct().collect()
        attributes = {r.name: Attribute(r.name, r.encoding, r.multi, r.iri or None) for r in rows}
        data = {r.name: InPairs(spark.read.schema(f"e string, v {ENCODINGS[r.encoding].spark}").parquet(f"{path}/{r.id}").distinct()) for r in rows}
        one = FactSet(attributes, data)
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no folders")
    return out


def compact(spark: SparkSession, target: str, *paths: str) -> None:
    """The exact union of folders as one, duplicates gone."""
    write_facts(read_facts(spark, *paths), target)


def append_facts(facts: FactSet, path: str) -> None:
    """Adds a segment; readers take the distinct union, ``compact`` makes it permanent."""
    write_facts(facts, path, "append")


class BlobStore:
    """Content-addressed payloads: handle is the SHA-256 of the bytes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _table(self) -> DataFrame:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(BLOBS).parquet(self.path) if there else self.spark.createDataFrame([], BLOBS)

    def put(self, blobs: DataFrame) -> DataFrame:
        """Stores the new ones of a column ``bytes``; returns their handles."""
        rows = blobs.select(F.unhex(F.sha2(F.col("bytes").cast("binary"), 256)).alias("handle"), F.col("bytes").cast("binary").alias("bytes")).withColumn("length", F.octet_length("bytes").cast("long")).dropDuplicates(["handle"])
        rows.join(self._table().select("handle"), "handle", "left_anti").write.mode("append").parquet(self.path)
        return rows.select("handle")

    def get(self, handles: DataFrame) -> DataFrame:
        """Rows with a column ``handle`` with their bytes."""
        return handles.join(self._table().dropDuplicates(["handle"]), "handle")

    def list(self) -> DataFrame:
        return self._table().select("handle", "length").distinct()

    def keep(self, roots: DataFrame, target: str) -> BlobStore:
        """The store with those of ``roots`` and whatever they refer to, in a new folder."""
        self._table().join(reachable(self._table(), roots), "handle", "left_semi").write.parquet(target)
        return BlobStore(self.spark, target)

    def forget(self, handles: DataFrame, target: str) -> BlobStore:
        self._table().join(handles, "handle", "left_anti").write.parquet(target)
        return BlobStore(self.spark, target)


def reachable(blobs: DataFrame, roots: DataFrame) -> DataFrame:
    """Handles reached from ``roots``: any 32 bytes of a payload, at a multiple of 32, that are a handle here refer to it."""
    from factloom.sources.scratch import stored

    at = F.explode(F.sequence(F.lit(1), F.greatest(F.col("length"), F.lit(1)), F.lit(32)))
    parts = blobs.select("handle", "bytes", at.alias("at")).select("handle", F.substring(F.col("bytes"), F.col("at").cast("int"), F.lit(32)).alias("to")).where("octet_length(to) = 32")
    links = stored(parts.join(blobs.select(F.col("handle").alias("to")).distinct(), "to", "left_semi").distinct(), "blob-links")
    newest = stored(roots.select("handle").distinct(), "blob-roots")
    seen = newest
    while not newest.isEmpty():
        newest = stored(newest.join(links, "handle").select(F.col("to").alias("handle")).distinct().join(seen, "handle", "left_anti"), "blob-reached")
        seen = seen.unionByName(newest)
    return seen
