"""Token ids in Parquet: list columns with chosen encodings, row groups and pages.

Documents are range partitioned on doc_id and sorted, then encoded where they
are, so texts are shuffled once and ids never.  Files hold a dictionary-encoded
list of ids beside delta-encoded metadata columns; row groups and pages are
small enough that the page index lets a reader fetch single documents' tokens,
or the metadata alone.

Positions come from the files: a running sum inside each file (its size is
bounded by the range partitioning) on top of the totals of the files before it.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, scratch_path, small_batches, stored, text_or_empty

#: Bytes of a row group, bytes and rows of a page.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 256 << 10, 256

LAYOUT = {
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.writer.version": "PARQUET_2_0",  # delta encodings
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#token_ids.list.element": "true",
    "compression": "zstd",
}

#: Blanks that are so to some Unicode tables only, and the other blanks besides space and line feed (fixed values).
UNSURE = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
ODD = "\t\x0b\x0c\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What ends a word in the strings that are cut (texts with it are not cut).
END = "\x1f"
#: A space before a non-blank, or the place before a line feed behind a non-blank, are cuts.
CUTS = re.compile(r"(?<!^) (?=\S)|(?<=\S)(?=\n)").sub
#: Letters of old scripts, or digits, are one piece, a line feed before them another.
PIECE = re.compile("\n?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]+|[0-9]+)").fullmatch
#: ASCII punctuation.
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Characters of texts that are cut into words at a time, new words that are encoded at a time.
CHARACTERS, LEARNT = 1 << 20, 16384


def blank_in(text: str, blanks: str) -> bool:
    if text.isascii():
        return any(c in text for c in blanks if c < "\x7f")
    return any(c in text for c in blanks)


def with_ends(text: str) -> str:
    """``text`` with each cut marked: a space that is cut is replaced by the mark, a line feed has it in front."""
    if "  " in text or " \n" in text or text[-1:] == " " or blank_in(text, ODD):
        return CUTS(END, text)
    marked = text[:1] + text[1:].replace(" ", END).replace("\n", END + "\n")
    if "\n\n" in text:
        # Twice, as matches don't overlap.
        marked = marked.replace("\n" + END + "\n", "\n\n").replace("\n" + END + "\n", "\n\n")
    return marked


def byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies have for bytes; ``END`` stays as it is."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden) if chr(b) != END}


def strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.LargeStringArray:
    """The strings that lie at places of ``data``."""
    lengths = ends - begins
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    held = data[np.arange(int(offsets[-1])) + np.repeat(begins - offsets[:-1], lengths)]
    return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(held))


def cut_here(stems: pa.LargeStringArray) -> np.ndarray:
    """Which words end in a digit or a letter of old scripts: punctuation behind those is a piece of its own."""
    ends = np.frombuffer(stems.buffers()[1], np.int64)[stems.offset : stems.offset + len(stems) + 1]
    data = np.concatenate((np.zeros(2, np.uint8), np.frombuffer(stems.buffers()[2] or b"", np.uint8)))
    last, before = data[ends[1:] + 1], data[ends[1:]].astype(np.int64)
    plain = np.zeros(256, bool)
    plain[[b for b in range(128) if chr(b).isalnum()]] = True
    # Characters of two bytes, of which the first tells that they are.
    point = (before & 31) << 6 | last & 63
    old = (last >= 128) & (before >= 0xC3) & (before <= 0xCA) & (point >= 0xC0) & (point <= 0x2AF) & (point != 0xD7) & (point != 0xF7)
    return (plain[last] | old) & (np.diff(ends) > 0)


class Encoder:
    """Ids of texts under a tokenizers file, remembering words between texts.

    Under the byte-level pre-tokenizer no piece reaches across a cut made before
    a space that a non-blank follows, or before a line feed behind a non-blank.
    So texts are cut there, the words of many texts are made distinct, each new
    word is encoded once by the library, and a text's ids are its words' ids
    joined.  Texts with added tokens, or with blanks on which Unicode tables
    differ, go to the library whole, as do all texts of other kinds of tokenizer.
    """

    #: Words remembered, and their ids; the first half of the words, which holds the frequent ones, outlives a clearing.
    MOST, MOST_TAILS, MOST_IDS, LONGEST = 700_000, 20_000, 8_000_000, 64

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.by_word = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        size = self.library.get_vocab_size(with_added_tokens=True)
        #: Bytes of each token: its vocabulary entry has a character for each byte.
        self.width = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        #: Ids one after the other; words by where their ids begin there, times 2 ** 32, and how many they are.
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        self.known: dict[str, int] = {"": 0}
        #: Punctuation behind words, likewise.
        self.tails: dict[str, int] = {"": 0}
        #: The library for pieces between marks, in the vocabulary's characters.
        self.of_pieces, self.characters = None, byte_characters()
        if self.by_word:
            self.of_pieces = Tokenizer.from_file(path)
            self.of_pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(END)
            for x in (self.library, self.of_pieces):
                if hasattr(x.model, "_resize_cache"):
                    x.model._resize_cache(0)  # words that were met are remembered here

    def _keep(self, ids: np.ndarray, ends: np.ndarray) -> list[int]:
        """Appends the ids of words to the pool and gives their places; ``ends`` are each word's end in ``ids``."""
        begin, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool[:begin], np.empty(self.used - begin + (begin >> 1), np.int32)])
        self.pool[begin : self.used] = ids
        lengths = np.diff(ends, prepend=0)
        return ((begin + ends - lengths << 32) + lengths).tolist()

    def _at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at places, one after the other, and how many each has."""
        lengths = places & 0xFFFFFFFF
        return self.pool[np.arange(int(lengths.sum())) + np.repeat((places >> 32) - np.cumsum(lengths) + lengths, lengths)], lengths

    def _told_apart(self, library, text: str, sizes: list[int]) -> list[int]:
        """Places of the words that a text joins, told apart by their tokens' bytes."""
        ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        return self._keep(ids, np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes)) + 1)

    def _each(self, words: list[str]) -> list[int]:
        """Places of words that are encoded each by itself."""
        rows = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        return self._keep(np.array(list(itertools.chain.from_iterable(rows)), np.int32), np.cumsum(list(map(len, rows)), dtype=np.int64))

    def _learn(self, words: list[str]) -> None:
        """Encodes new words: those of letters or digits are one piece each, or two with a line feed before them."""
        known, pieces, spaced, lines = self.known, [], [], []
        for w in words:
            (pieces if PIECE(w) else lines if w[0] == "\n" else spaced).append(w)
        for at in range(0, len(pieces), LEARNT):
            part = pieces[at : at + LEARNT]
            raw = (f"{END} " + f"{END} ".join(part)).replace(" \n", f"\n{END}").encode()
            known.update(zip(part, self._told_apart(self.of_pieces, raw.decode("latin-1").translate(self.characters), [len(w.encode()) + (w[0] != "\n") for w in part]), strict=True))
        for at in range(0, len(spaced), LEARNT):
            part = spaced[at : at + LEARNT]
            known.update(zip(part, self._told_apart(self.library, " " + " ".join(part), [len(w.encode()) + 1 for w in part]), strict=True))
        if lines:  # a blank before them would be one piece with their line feed
            known.update(zip(lines, self._each(lines), strict=True))

    def _forget(self, words: list[str]) -> None:
        """Forgets long ones of the words just learnt, and the later half of all when they are too many."""
        for w in words:
            if len(w) > self.LONGEST:
                del self.known[w]
        if len(self.known) > self.MOST or len(self.tails) > self.MOST_TAILS or self.used > self.MOST_IDS:
            first = list(itertools.islice(self.known, self.MOST // 2))
            ids, lengths = self._at(np.array([self.known[w] for w in first], np.int64))
            # The pool has ids of forgotten words too; those that are kept may still be too many.
            fits = int(np.searchsorted(np.cumsum(lengths), self.MOST_IDS // 2, "right"))
            self.pool, self.used, self.tails = np.empty(1 << 16, np.int32), 0, {"": 0}
            self.known = dict(zip(first[:fits], self._keep(ids[: int(lengths[:fits].sum())], np.cumsum(lengths[:fits])), strict=True))

    def _of_distinct(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has.  Punctuation behind a letter or digit is a piece by itself."""
        stems = pc.utf8_rtrim(words, characters=PUNCTUATION)
        cut = np.flatnonzero(cut_here(stems) & (pc.binary_length(stems).to_numpy() < pc.binary_length(words).to_numpy()))
        begins = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        ends = begins[1:].copy()
        ends[cut] = begins[cut] + pc.binary_length(stems).to_numpy()[cut]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        rows = []
        for begin, end in ((begins[:-1], ends), (ends, begins[1:])):
            parts = strings(data, begin, end).dictionary_encode()
            rows.append((parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()))
        (names, which), (tails, behind) = rows
        places = list(map(self.known.get, names))
        missed = [k for k, p in enumerate(places) if p is None]
        new = [names[k] for k in missed]
        if new:
            self._learn(new)
            for k, w in zip(missed, new, strict=True):
                places[k] = self.known[w]
        others = [t for t in tails if t not in self.tails]
        if others:
            self.tails.update(zip(others, self._each(others), strict=True))
        both = np.empty(2 * len(words), np.int64)
        both[::2] = np.array(places, np.int64)[which]
        both[1::2] = np.array([self.tails[t] for t in tails], np.int64)[behind]
        ids, lengths = self._at(both)
        self._forget(new)
        return ids, lengths[::2] + lengths[1::2]

    def _of_words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that may be cut, by their distinct words."""
        marked = list(map(with_ends, texts))
        heads = [t.partition(END)[0] for t in marked]
        first = [e.ids for e in self.library.encode_batch_fast(heads, add_special_tokens=False)]
        # The first word, which has no space before it, is left empty.
        words = pc.split_pattern(pa.array([t[len(h) :] for t, h in zip(marked, heads, strict=True)], pa.large_string()), END)
        del marked
        edges, distinct = words.offsets.to_numpy(), words.values.dictionary_encode()
        del words
        ids, lengths = self._of_distinct(distinct.dictionary)
        # A text's first word is the head's ids, which stand behind the words' ids.
        which = distinct.indices.to_numpy().copy()
        which[edges[:-1]] = len(lengths) + np.arange(len(texts))
        ids = np.concatenate((ids, np.array(list(itertools.chain.from_iterable(first)), np.int32)))
        lengths = np.concatenate((lengths, list(map(len, first)))).astype(np.int32)
        begins = (np.cumsum(lengths) - lengths).astype(np.int32)[which]
        lengths = lengths[which]
        ends = np.cumsum(lengths, dtype=np.int32)
        ids = ids[np.arange(int(ends[-1]), dtype=np.int32) + np.repeat(begins - ends + lengths, lengths)]
        return np.split(ids, ends[edges[1:-1] - 1])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        whole, cut = [], []
        for i, text in enumerate(texts):
            (whole if not self.by_word or blank_in(text, UNSURE) or any(a in text for a in self.added) else cut).append(i)
        for i, e in zip(whole, self.library.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.int32)
        if cut:
            for i, ids in zip(cut, self._of_words([texts[i] for i in cut]), strict=True):
                out[i] = ids
        return out


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder in each worker process, kept from task to task."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


def list_array(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


def parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of the texts of a bounded size, or of one text: a slice's ids stay small, yet many of its words are met again in it."""
    at = size = 0
    for k, text in enumerate(texts):
        if k > at and size + len(text) > CHARACTERS:
            yield at, k
            at, size = k, 0
        size += len(text)
    if texts:
        yield at, len(texts)


def encoded(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int = 0) -> DataFrame:
    """doc_id, n_tokens, token_ids of every whole text, ``end_id`` appended; in ascending doc_id order, file by file."""
    tail = np.array([end_id], np.int32)

    def rows(batches):
        enc = encoder(tokenizer() if callable(tokenizer) else tokenizer)
        for b in batches:
            for at, to in parts(b["body"]):
                ids = [np.concatenate([x, tail]) for x in enc.ids(b["body"][at:to])]
                yield {"doc_id": b["doc_id"][at:to], "n_tokens": [len(x) for x in ids], "token_ids": list_array(ids)}

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body")
    return mapped(ordered, rows, "doc_id long, n_tokens long, token_ids array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer: str | Callable[[], str], end_id: int = 0) -> None:
    with small_batches(docs.sparkSession):
        encoded(docs, tokenizer, end_id).write.options(**LAYOUT).parquet(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Token files, or selected documents and columns of them: both reach the scan, where the page index applies."""
    df = spark.read.schema("doc_id long, n_tokens long, token_ids array<int>").parquet(path)
    df = df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))
    return df if columns is None else df.select(*columns)


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, each from the ids that the files hold.

    ``start`` counts the ids of all documents before, in ascending doc_id order
    (a null doc_id comes first; rows with one doc_id follow each other in the
    order of their texts).
    """
    stored_rows = spark.read.schema("doc_id long, n_tokens long, token_ids array<int>").parquet(path).select("doc_id", "token_ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))

    def sums(batches):
        for b in batches:
            ends = b["token_ids"].offsets.to_numpy()
            ids = memoryview(b["token_ids"].values.to_numpy().astype("<u4", copy=False)).cast("B")
            yield {"doc_id": b["doc_id"], "file": b["file"], "at": b["at"], "n_tokens": np.diff(ends).tolist(), "ids_crc32": [zlib.crc32(ids[4 * x : 4 * y]) for x, y in itertools.pairwise(ends.tolist())]}

    # Stored, so that the ids pass to Python in small batches.
    rows = stored(mapped(stored_rows, sums, "doc_id long, file string, at long, n_tokens long, ids_crc32 long", raw=("token_ids",)), "token-sums")
    inside = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    # One row per file: the counts alone, read without the token column.
    counts = spark.read.schema("doc_id long, n_tokens long, token_ids array<int>").parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("held"), F.max(F.col("doc_id").isNull()).alias("with_null"))
    before = Window.orderBy(F.col("with_null").desc(), "least", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return rows.join(starts, "file").select("doc_id", (F.col("base") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int = 0, path: str | None = None) -> DataFrame:
    """Encodes, writes and reads back: one row per row of ``docs`` with doc_id, start, n_tokens, ids_crc32.

    A null text counts as empty (its only id is ``end_id``).  Repeated rows are
    written each; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return token_positions(spark, path)
