"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the 18-word grams in a window of 35 words the one
with the least hash.  Equal windows choose the same anchor, so a window can only
repeat where its anchor does.  The windows that choose one place follow each
other; they are its stretch.  Where all places of a repeated anchor have the same
stretch, all its windows are repeated.  Where stretches differ, every window of
each is compared with all others.  Stretches are compared by 64 bits of a hash
beside those of the anchor, windows by 96 bits of hashes of their whole word
sequence; that stands for extending matches place against place.  Runs of
repeated windows are the maximal repeats; every word in one goes.

Scale: no pairs are made.  Counts of anchors and of windows are combined before
they are shuffled, so a passage in a third of all documents is a row per task;
the join that brings counts back to stretches and windows reads a stored table
with one row a key on one side, so Spark can split a hot key of the other.  Texts
are shuffled only where a filter of fixed size says that they may have repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_word_hashes, fixed_filter, gram_hashes, mapped, mixed, passes, stored, text_or_empty, with_row_ids

#: Words of a window (the least length of a repeat).
WINDOW = 35
#: Type of the repeats of a text.
REPEATS = "repeats array<struct<start: int, end: int>>"


def gram_size(window: int) -> int:
    """Half a window: any window then holds as many grams as a gram has words."""
    return window // 2 + 1


def least_positions(grams: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` grams the position of the least one, the leftmost of equals."""
    best, size = np.arange(len(grams)), 1
    while size < span:
        step = min(size, span - size)
        left, right = best[:-step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        size += step
    return best


class Batch:
    """The words of some texts as one array of hashes, and their valid windows."""

    def __init__(self, bodies: list[str], window: int):
        words, self.bounds = batch_word_hashes([t.encode() for t in bodies])
        row = np.repeat(np.arange(len(bodies)), np.diff(self.bounds))
        size = gram_size(window)
        self.starts = np.flatnonzero(row[: max(0, len(row) - window + 1)] == row[window - 1 :]) if len(row) >= window else np.empty(0, np.int64)
        self.row = row[self.starts]
        if len(self.starts):
            grams = gram_hashes(words, size)
            at = least_positions(grams, window - size + 1)[self.starts]
            self.anchor = grams[at]
            self.hashes = gram_hashes(words, window)[self.starts]
            # The stretches: first window, number of windows, and a hash of all their words, which the outer windows cover.
            self.first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            self.length = np.diff(np.append(self.first, len(at)))
            outer = mixed(self.hashes[self.first] + self.length.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.first + self.length - 1]
            self.stretch = mixed(outer).view(np.int64)


def upper(hashes: np.ndarray) -> np.ndarray:
    """The upper 32 bits, with their sign."""
    return (hashes.view(np.int64) >> 32).astype(np.int32)


def anchor_counts(texts: DataFrame, window: int) -> DataFrame:
    """anchor, n, least, greatest: how many places chose each anchor, and the outer hashes of their stretches."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            batch = Batch(b["body"], window)
            if len(batch.starts):
                anchor, stretch = batch.anchor[batch.first], batch.stretch
                order = np.lexsort((stretch, anchor))
                anchor, stretch = anchor[order], stretch[order]
                at = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                n = np.diff(np.append(at, len(anchor)))
                yield {"anchor": anchor[at].view(np.int64), "n": n, "least": stretch[at], "greatest": stretch[at + n - 1]}

    found = mapped(texts.select("body"), rows, "anchor long, n long, least long, greatest long")
    return found.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


def sequences(texts: DataFrame, window: int, opened, known=None) -> DataFrame:
    """rid, run, low, high: windows whose anchor has stretches that differ, as runs of one, and their hashes.

    With ``known`` only those that may be repeated, and the stretches that may
    be.  A run is its first window's place (upper 32 bits) and its windows.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            batch = Batch(b["body"], window)
            if not len(batch.starts):
                continue
            chosen = np.flatnonzero(passes(opened.value, batch.anchor))
            low, high, n = batch.hashes[chosen], upper(mixed(batch.anchor[chosen])), np.ones(len(chosen), np.int64)
            if known is not None:
                chosen = np.concatenate((chosen, batch.first))
                low, high, n = np.concatenate((low, batch.anchor[batch.first])), np.concatenate((high, upper(batch.stretch))), np.concatenate((n, batch.length))
                may = passes(known.value, low)
                chosen, low, high, n = chosen[may], low[may], high[may], n[may]
            if len(chosen):
                row = batch.row[chosen]
                at = batch.starts[chosen] - batch.bounds[row]
                yield {"rid": np.array(b["rid"], np.int64)[row], "run": at << 32 | n, "low": low.view(np.int64), "high": high}

    return mapped(texts, rows, "rid long, run long, low long, high int")


def merged(runs: list[int], window: int) -> list[dict]:
    """The runs of words that the windows of ``runs`` cover: maximal, as start and end."""
    at = np.sort(np.array(runs, np.int64))
    starts = at >> 32
    ends = np.maximum.accumulate(starts + (at & 0xFFFFFFFF) - 1 + window)
    gaps = np.flatnonzero(starts[1:] > ends[:-1])
    return [{"start": s, "end": e} for s, e in zip(starts[np.concatenate(([0], gaps + 1))].tolist(), ends[np.concatenate((gaps, [-1]))].tolist(), strict=True)]


def repeats(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """rid, repeats: the maximal repeats of a text as start and end in words, for texts that have any; stored."""
    context = texts.sparkSession.sparkContext
    anchors = stored(anchor_counts(texts, window).where("n >= 2").select("anchor", "least", "greatest"), "repeated-anchors")
    opened = context.broadcast(fixed_filter(anchors.where("least <> greatest").select("anchor")))
    windows = sequences(texts, window, opened).groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("low", "high")
    stretches = anchors.where("least = greatest").select(F.col("anchor").alias("low"), F.shiftright("least", 32).cast("int").alias("high"))
    # Stored, so that both sides of the join are plain and a hot key can be split.
    repeated = stored(windows.unionByName(stretches), "repeated-sequences")
    known = context.broadcast(fixed_filter(repeated.select("low")))
    places = sequences(texts, window, opened, known).join(repeated, ["low", "high"]).groupBy("rid").agg(F.collect_list("run").alias("runs"))

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"rid": b["rid"], "repeats": [merged(runs, window) for runs in b["runs"]]}

    return stored(mapped(places, rows, f"rid long, {REPEATS}"), "repeats")


def cut(bodies: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and repeats of rows with doc_id, body and repeats (null: none)."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {k: [] for k in ("n_words", "n_removed", "kept_text", "repeats")}
            for text, runs in zip(b["body"], b["repeats"], strict=True):
                words, runs = text.encode().split(), runs or []
                edges = [0, *(e for run in runs for e in (run["start"], run["end"])), len(words)]
                kept = [w for s, e in zip(edges[::2], edges[1::2], strict=True) for w in words[s:e]]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_text"].append(b" ".join(kept).decode())
                out["repeats"].append(runs)
            yield {"doc_id": b["doc_id"], **out}

    return mapped(bodies, rows, f"doc_id long, n_words long, n_removed long, kept_text string, {REPEATS}")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Removes every word in a run of ``window`` or more words that also starts elsewhere.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by a space)
    and repeats (the maximal repeats as start and end in words): one row per row
    of ``docs``.  Words are runs of anything but six ASCII blanks, unchanged.
    All repeats are judged on the input.  Null and empty texts have no words; a
    repeated row repeats itself, so it loses all words if it has ``window`` of
    them; null doc_ids are like any other; other columns don't matter; an empty
    table gives no rows.
    """
    own, odd = with_row_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body")))
    texts = own.withColumn("rid", F.col("doc_id")).select("rid", "doc_id", "body")
    if odd is not None:
        texts = texts.unionByName(odd.withColumnRenamed("row_id", "rid"))
    found = repeats(texts.select("rid", "body"), window)
    holders = texts.sparkSession.sparkContext.broadcast(fixed_filter(found.select("rid")))

    def part(held: bool) -> DataFrame:
        """The rows that may have repeats, or those that have none for certain."""

        def rows(batches: Iterator[dict]) -> Iterator[dict]:
            for b in batches:
                chosen = pa.array(passes(holders.value, b["rid"].to_numpy().view(np.uint64)) == held)
                yield {k: column.filter(chosen) for k, column in b.items()}

        return mapped(texts, rows, "rid long, doc_id long, body string", raw=("rid", "doc_id", "body"))

    # Only texts that may have repeats are shuffled, by a merge join at any size, so that what it moves follows the input.
    joined = part(True).join(found.hint("merge"), "rid", "left").select("doc_id", "body", "repeats")
    plain = part(False).select("doc_id", "body", F.lit(None).cast(found.schema["repeats"].dataType).alias("repeats"))
    return cut(joined).unionByName(cut(plain))


ORACLE_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT rid, unnest(range(1, greatest(len(words) - 34, 0) + 1)) AS pos, words FROM rows),
windows AS (SELECT rid, pos, md5(array_to_string(words[pos:pos + 34], ' ')) AS body FROM starts),
repeated AS (SELECT rid, pos FROM windows QUALIFY count(*) OVER (PARTITION BY body) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + 35)) AS pos FROM repeated),
words AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM rows),
kept AS (SELECT w.rid, string_agg(word, ' ' ORDER BY w.pos) FILTER (g.pos IS NULL) AS body, count(g.pos) AS n_removed
         FROM words w LEFT JOIN gone g ON w.rid = g.rid AND w.pos = g.pos GROUP BY w.rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM rows LEFT JOIN kept USING (rid)
"""
