"""Retrieval that joins with patterns: BM25, and exact cosine over vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import text as tokens
from factloom.sources.scratch import scratch_path, stored

#: Term saturation and length normalisation.
K1, B = 1.5, 0.75


#: Bytes (or terms) of rows that are counted before their postings leave Python.
_TOGETHER = 1 << 20
_COUNTED = "term string, tf long, length long, first boolean"


def _counts(terms: Callable[[bytes], list[bytes]] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc, of) as postings, row by row; ``of`` is a text that ``terms`` cuts, or an array of terms.

    Each has its row's length, and one of a row is its first; a row without
    terms has one with a null term.
    """

    def flat(docs: pa.Array, found: list[Counter]) -> pa.RecordBatch:
        held = np.array([max(len(tf), 1) for tf in found])
        term = list(chain.from_iterable(tf or (None,) for tf in found))
        first = np.zeros(len(term), bool)
        first[np.cumsum(held) - held] = True
        tfs = np.fromiter(chain.from_iterable(tf.values() or (0,) for tf in found), np.int64, len(term))
        length = np.repeat([tf.total() for tf in found], held)
        columns = [docs.take(pa.array(np.repeat(np.arange(len(found)), held))), pa.array(term, pa.binary()).cast(pa.string()), pa.array(tfs), pa.array(length, pa.int64()), pa.array(first)]
        return pa.RecordBatch.from_arrays(columns, ["doc", "term", "tf", "length", "first"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, values = batch.columns
            begin, size, found = 0, 0, []
            for k, value in enumerate(values.cast(pa.binary() if terms else pa.list_(pa.binary())), 1):
                of = value.as_py() or b""
                found.append(Counter(terms(of) if terms else [t for t in of if t is not None]))
                size += len(of)
                if size >= _TOGETHER or k == len(batch):
                    yield flat(docs.slice(begin, k - begin), found)
                    begin, size, found = k, 0, []

    return counted


def _of_docs(df: DataFrame, docs: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` whose document is (``left_semi``) or is not (``left_anti``) among ``docs``; null is a document too."""
    return df.join(docs.select(F.col("doc").alias("_doc")), F.col("doc").eqNullSafe(F.col("_doc")), how)


def _postings(counted: DataFrame) -> DataFrame:
    return counted.where("term is not null").select("doc", "term", "tf")


def _largest(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc", "term").agg(F.max("tf").alias("tf"))


def _lengths(postings: DataFrame, none: DataFrame) -> DataFrame:
    """The lengths of documents, and of those in ``none`` that have no terms."""
    return postings.select("doc", F.col("tf").alias("length")).unionByName(none).groupBy("doc").agg(F.sum("length").alias("length"))


@dataclass(frozen=True)
class BM25Index:
    """Postings (doc, term, tf) and lengths (doc, length); empty documents count too.

    Documents of one row are in ``counted`` (``_COUNTED``), as they were counted
    where their text was read, without a shuffle.  Postings and lengths of those
    put together from several rows are apart (``joint`` and ``joint_lengths``).
    """

    counted: DataFrame
    joint: DataFrame
    joint_lengths: DataFrame
    k1: float = K1
    b: float = B

    @property
    def postings(self) -> DataFrame:
        return _postings(self.counted).unionByName(self.joint)

    @property
    def lengths(self) -> DataFrame:
        return self.counted.where("first").select("doc", "length").unionByName(self.joint_lengths)

    @staticmethod
    def build(docs: DataFrame, terms: Column | Callable[[bytes], list[bytes]] = tokens.words_of, k1: float = K1, b: float = B, path: str | None = None) -> BM25Index:
        """``docs``: doc, text (or any columns for ``terms``, where it is an array and no function of the text).  Of repeated documents the largest tf of a row counts.

        Texts are tokenised once: the counted rows are written (to ``path`` to
        keep them, for ``open``) and everything else is read from there.  Only
        ids are shuffled, to find repeated documents, and the postings of those.
        """
        spark = docs.sparkSession
        path = path or scratch_path(spark, "bm25")
        array = isinstance(terms, Column)
        of = docs.select("doc", (terms if array else F.col("text")).alias("of"))
        kind = T.StructType([T.StructField("doc", of.schema["doc"].dataType), *T.StructType.fromDDL(_COUNTED)])
        of.mapInArrow(_counts(None if array else terms), kind).write.parquet(f"{path}/counted")
        counted = spark.read.schema(kind).parquet(f"{path}/counted")
        counted.where("first").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc").write.parquet(f"{path}/repeated")
        repeated = spark.read.schema(T.StructType(kind[:1])).parquet(f"{path}/repeated")
        if not repeated.isEmpty():
            _of_docs(counted, repeated, "left_anti").write.parquet(f"{path}/single")
            _largest(_postings(_of_docs(counted, repeated, "left_semi"))).write.parquet(f"{path}/joint")
        return BM25Index.open(spark, path, k1, b)

    @staticmethod
    def open(spark: SparkSession, path: str, k1: float = K1, b: float = B) -> BM25Index:
        """The index that ``build`` wrote to ``path``."""
        repeated = spark.read.parquet(f"{path}/repeated")
        none = repeated.selectExpr("doc", "0L AS length")
        if repeated.isEmpty():
            return BM25Index(spark.read.parquet(f"{path}/counted"), repeated.selectExpr("doc", "'' AS term", "0L AS tf"), none, k1, b)
        joint = spark.read.parquet(f"{path}/joint")
        return BM25Index(spark.read.parquet(f"{path}/single"), joint, _lengths(joint, none), k1, b)

    def merge(self, other: BM25Index) -> BM25Index:
        """Documents of either; of a document's term the larger tf.  Only ids are shuffled, to find documents of both, and the postings of those."""
        both = stored(_of_docs(self.lengths.select("doc"), other.lengths, "left_semi"), "bm25-both")
        counted, joint, lengths = self.counted.unionByName(other.counted), self.joint.unionByName(other.joint), self.joint_lengths.unionByName(other.joint_lengths)
        if both.isEmpty():
            return BM25Index(counted, joint, lengths, self.k1, self.b)
        larger = _largest(_of_docs(_postings(counted).unionByName(joint), both, "left_semi"))
        counted, joint, lengths = (_of_docs(df, both, "left_anti") for df in (counted, joint, lengths))
        return BM25Index(counted, joint.unionByName(larger), lengths.unionByName(_lengths(larger, both.selectExpr("doc", "0L AS length"))), self.k1, self.b)

    def doc_frequency(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def statistics(self) -> DataFrame:
        """docs, terms and average length, as one row."""
        docs = self.lengths.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))
        return docs.crossJoin(self.postings.agg(F.countDistinct("term").alias("terms")))

    def query(self, terms: Sequence[str]) -> DataFrame:
        """doc, score over the query's terms, a repeated term adding twice; documents without any don't appear."""
        # The query's terms are literals, as many as the caller wrote, so that the scan drops the others.
        asked = Counter(terms)
        held = self.postings.where(F.col("term").isin(*asked))
        times = F.create_map(*[F.lit(x) for x in chain.from_iterable(asked.items())])[F.col("term")] if asked else F.lit(0)
        df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        corpus = self.lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("avg_length"))
        rows = held.join(F.broadcast(df), "term").join(self.lengths, "doc").crossJoin(F.broadcast(corpus))
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.when(F.col("avg_length") > 0, 1 - self.b + self.b * F.col("length") / F.col("avg_length")).otherwise(1.0)
        score = idf * F.col("tf") * (self.k1 + 1) / (F.col("tf") + self.k1 * norm)
        return rows.groupBy("doc").agg(F.sum(score * times).alias("score"))

    def ranked(self, terms: Sequence[str]) -> DataFrame:
        return self.query(terms).orderBy(F.col("score").desc(), "doc")

    def matches(self, terms: Sequence[str], floor: float = 0.0) -> DataFrame:
        """doc of those that score ``floor`` or more."""
        return self.query(terms).where(F.col("score") >= floor).select("doc")


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p)


def normalised(x: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    length = F.sqrt(dot(x, x))
    return F.when(length > 0, F.transform(x, lambda a: a / length)).otherwise(F.transform(x, lambda a: a.cast("double")))


def cosine(x: Column, y: Column) -> Column:
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (size > 0), dot(x, y) / size)


def similar_to(vectors: DataFrame, probe: Sequence[float], floor: float) -> DataFrame:
    """id, score of vectors (id, vector) whose cosine with the probe is ``floor`` or more: exact, one scan."""
    x = F.array(*[F.lit(float(p)) for p in probe])
    return vectors.select("id", cosine(F.col("vector"), x).alias("score")).where(F.col("score") >= floor)


def cosine_at_least(pairs: DataFrame, vectors: DataFrame, floor: float) -> DataFrame:
    """Of pairs (a, b) that other constraints bind, those whose cosine is ``floor`` or more, with the score."""
    a, b = (vectors.select(F.col("id").alias(n), F.col("vector").alias(f"{n}_vector")) for n in "ab")
    return pairs.join(a, "a").join(b, "b").withColumn("score", cosine(F.col("a_vector"), F.col("b_vector"))).where(F.col("score") >= floor).drop("a_vector", "b_vector")
