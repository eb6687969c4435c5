"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources import scratch
from factloom.sources.scratch import scratch_path, shared_dir

#: A word of the query contracts: a run of anything but these six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "batch_word_hashes", "discard", "distinct", "driver_gives_back", "fixed_filter", "gram_hashes", "mapped", "mixed", "passes", "rows_where", "scratch_path", "shared_dir", "small_batches", "stored", "text_or_empty", "with_row_ids"]


#: Bytes of an Arrow batch between the JVM and Python while a table is written.
BATCH_BYTES = "4m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few bytes for the tables that are written inside: their buffers lie outside the heap on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, with Arrow batches of few bytes on the way."""
    with small_batches(df.sparkSession):
        out = scratch.stored(df, name)
    driver_gives_back(df.sparkSession)
    return out


def discard(df: DataFrame) -> None:
    """Deletes a stored table that nothing depends on any more."""
    jvm = df.sparkSession._jvm
    for parent in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Rows and bytes of what Python works on at a time; a row of more bytes comes alone.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to parts of at most ``SLICE_ROWS`` rows and about ``SLICE_BYTES`` bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, SLICE_ROWS)
            while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                part = part.slice(0, max(1, min(part.num_rows // 2, part.num_rows * SLICE_BYTES // part.nbytes)))
            yield part
            at += part.num_rows


def give_back() -> None:
    """Returns what a worker process no longer uses to the system, as it waits for further tasks beside others."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


#: The driver gives memory back at most every so many times the time that this takes; the earliest next time.
PAUSE = 50
_next_give_back = 0.0


def driver_gives_back(spark: SparkSession) -> None:
    """The same for the driver, both its Python and its JVM: garbage of earlier steps, and what the C library keeps of their planning and compiling.

    A JVM that cannot return the latter (before 17.0.9, or without glibc) only collects garbage.
    """
    global _next_give_back
    began = time.monotonic()
    if began < _next_give_back:
        return
    give_back()
    jvm = spark._jvm
    jvm.System.gc()
    call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # Through the interface, as the server's own class is not open to reflection.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    with suppress(Py4JError):
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    ended = time.monotonic()
    _next_give_back = ended + PAUSE * (ended - began)


def mapped(df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: str, raw: tuple[str, ...] = ()) -> DataFrame:
    """``df`` through ``rows``, which turns dicts of column lists into dicts of column lists.

    Columns named in ``raw`` come as Arrow arrays; any may be returned as one.
    Lists are cut by rows and bytes, so that long texts stay few at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def slices() -> Iterator[dict[str, list]]:
            for part in sliced(batches):
                yield {n: part.column(i) if n in raw else part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}

        for out in rows(slices()):
            yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        out = None
        give_back()

    return df.mapInArrow(run, schema)


def rows_where(docs: DataFrame, kept: Callable[[Iterator[list[str]]], Iterable[list[bool]]]) -> DataFrame:
    """The rows of ``docs`` whose text ``kept`` says yes to, all columns as they are: no join, no shuffle, no key.

    ``kept`` turns lists of texts (null: empty) into lists of answers, one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def bodies() -> Iterator[list[str]]:
            for part in sliced(batches):
                parts.append(part)
                yield [str(t) if t is not None else "" for t in part.column(part.schema.names.index("text")).to_pylist()]

        for answers in kept(bodies()):
            yield parts.pop().filter(pa.array(answers, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows with a doc_id of their own, and the others (if any), stored with ids that no other row has as ``row_id``."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    times = ids.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    most, odd = times.agg(F.max("id"), F.count(F.when(F.col("id").isNull() | (F.col("times") > 1), 1))).first()
    if not odd:
        return docs, None
    repeated = stored(times.where("times > 1 and id is not null").select("id"), "repeated-ids")
    key = docs["doc_id"].cast("long")
    others = docs.where("doc_id is null").unionByName(docs.join(repeated, key == F.col("id"), "left_semi"))
    # Above the largest doc_id, or where that leaves no room below zero, the least one.
    most = most if most is not None else 0
    if most < 2**62:
        row_id = F.monotonically_increasing_id() + F.lit(max(0, most + 1))
    else:
        row_id = F.lit(min(0, ids.agg(F.min("id")).first()[0]) - 1) - F.monotonically_increasing_id()
    return docs.where("doc_id is not null").join(repeated, key == F.col("id"), "left_anti"), stored(others.withColumn("row_id", row_id), "odd-rows")


#: Blanks of the query contracts; words of more bytes than ``_LONG`` are hashed one by one; masks of the bytes of a chunk.
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LONG = 64
_MASKS = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)


def batch_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts``, and where each text's words begin among them (and the last one's end).

    All words of a batch are hashed at once, eight bytes at a time, each step
    scrambling what the steps before gave; the length goes in first.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]) + bytes(8), np.uint8)
    blank = np.concatenate(([True], _BLANK[raw[:-8]], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    chunks = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    out = mixed(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for at in range(0, min(_LONG, int(lengths.max(initial=0))), 8):
        some = np.flatnonzero(lengths > at) if at else slice(None)
        chunk = chunks[starts[some] + at] & _MASKS[np.minimum(lengths[some] - at, 8)]
        out[some] = mixed((out[some] ^ chunk) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(at + 1))
    for k in np.flatnonzero(lengths > _LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : starts[k] + lengths[k]].tobytes())
    return out, bounds


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words, given the words' hashes; empty if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    # Doubling: a hash of the first 2k words from two of k words, so log n passes suffice.
    parts, size, block, done = None, 1, words, 0
    left = n
    while left:
        if left & 1:
            piece = block[done : done + count]
            parts = mixed(piece) if parts is None else mixed(parts * np.uint64(0x9E3779B97F4A7C15) + piece)
            done += size
        left >>= 1
        if left:
            block = mixed(block[:-size] * np.uint64(0xD6E8FEB86659FD93) + block[size:]) if len(block) > size else block[:0]
            size *= 2
    return parts


# Filters of fixed size

#: Most bits of a filter, as a power of two (16 MB).
FILTER_BITS = 27
SLICES = 64


def slot(values: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(values) >> np.uint64(64 - bits)).astype(np.int64)


def fixed_filter(values: DataFrame) -> np.ndarray:
    """A packed bitmap with a bit set for the slot of each value of a one-column long table.

    It has about 16 bits a value and ``2**FILTER_BITS`` at most: beyond that it
    lets more through, never less.  Its slices are made on the executors, so what
    reaches the driver has a fixed size.
    """
    name = values.columns[0]
    bits = int(np.clip(int(np.ceil(np.log2(max(1, values.count())))) + 4, 16, FILTER_BITS))
    width = 2**bits // SLICES

    def find(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"slot": np.unique(slot(np.array(b[name], np.int64).view(np.uint64), bits))}

    def pack(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for part, held in zip(b["part"], b["slots"], strict=True):
                bitmap = np.zeros(width, bool)
                bitmap[held.values.to_numpy() - part * width] = True
                yield {"part": [part], "bitmap": [np.packbits(bitmap).tobytes()]}

    slots = mapped(values, find, "slot long").groupBy(F.floor(F.col("slot") / F.lit(width)).alias("part")).agg(F.collect_set("slot").alias("slots"))
    packed = mapped(slots, pack, "part long, bitmap binary", raw=("slots",))
    found = {r.part: np.frombuffer(r.bitmap, np.uint8) for r in packed.collect()}
    return np.concatenate([found.get(p, np.zeros(width // 8, np.uint8)) for p in range(SLICES)])


def passes(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = slot(values, int(np.log2(len(bitmap) * 8)))
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
