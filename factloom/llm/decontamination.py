"""Benchmark decontamination under edit distance.

The documents' words are compared with each benchmark item over windows of the
item's size.  A CGK random walk embeds a window so that a small edit distance
becomes a small Hamming distance: at step j the word under a pointer is written,
and a random bit of (j, word) says whether the pointer moves.  Repeated samples
of positions of that embedding are LSH keys; windows that share a key with an
item are candidates, and an exact edit distance over the words decides.

Windows that hold too few of the items' word pairs to be within the distance
(each edit destroys at most two) are not embedded; this loses nothing.  Windows
start at every word of a text, also where fewer words than the item has are left.

Scale: documents are read once and never shuffled.  The items are the stated
query set; they go to the tasks in blocks of bounded size, each block by a pass
of its own, so no broadcast grows with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, mixed, rows_where, stored, text_or_empty

WORDS = re.compile(r"\w+").findall
#: Edits per item word that still count as the item.
EDIT_RATE = 0.2
#: Walks, samples of each walk, positions in a sample.  With these a passage at
#: the full edit rate is found with a chance of 0.9 at least, at half of it 0.97
#: (tests/llm/test_operators.py measures both).
WALKS, SAMPLES, BITS = 4, 4, 3
#: Bytes of item text in a block.
BLOCK_BYTES = 4 << 20
#: Window sizes: an item is sought by its first words, as many as the largest of these that it has.
CLASS_RATIO = 1.15


def size_class(n: int) -> int:
    size = 1
    while max(size + 1, int(size * CLASS_RATIO)) <= n:
        size = max(size + 1, int(size * CLASS_RATIO))
    return size


class Items:
    """An index of benchmark items: their words' ids, word pairs and LSH keys by window size."""

    TABLE = 1 << 22

    def __init__(self, items: list[tuple[int, str]], edit_rate: float = EDIT_RATE, walks: int = WALKS, samples: int = SAMPLES, bits: int = BITS, seed: int = 1):
        self.edit_rate, self.walks, self.samples, self.bits, self.seed = edit_rate, walks, samples, bits, seed
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        for item, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORDS(text.lower())]
            if words:
                self.ids.append(item)
                self.words.append(np.array(words, np.int64))
        self.pairs = np.zeros(self.TABLE, bool)
        for w in self.words:
            self.pairs[self.pair_slots(w)] = True
        self.classes: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            self.classes.setdefault(size_class(len(w)), []).append(k)
        self.tables = {}
        for size, members in self.classes.items():
            prefixes = np.stack([self.words[k][:size] for k in members])
            keys = self.keys(prefixes.ravel(), np.arange(len(members)) * size, size)
            self.tables[size] = [(np.sort(row), np.array(members)[np.argsort(row, kind="stable")]) for row in keys]

    def edits(self, k: int) -> int:
        return int(self.edit_rate * len(self.words[k]))

    def pair_slots(self, words: np.ndarray) -> np.ndarray:
        a, b = words[:-1].astype(np.uint64), words[1:].astype(np.uint64)
        return (mixed(a * np.uint64(0x9E3779B97F4A7C15) + b) & np.uint64(self.TABLE - 1)).astype(np.int64)

    def keys(self, words: np.ndarray, starts: np.ndarray, size: int, begins: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """LSH keys of the windows of ``size`` words at ``starts``, blank before ``begins`` and cut off at ``ends``: one row for each walk and sample."""
        steps = 2 * size
        rng = np.random.default_rng([self.seed, size])
        keys = np.zeros((self.walks * self.samples, len(starts)), np.uint64)
        padded = np.append(words, 0)
        for walk in range(self.walks):
            chosen = np.sort(np.stack([rng.choice(steps, min(self.bits, steps), replace=False) for _ in range(self.samples)]), axis=1)
            salt = rng.integers(1, 2**63, steps, dtype=np.uint64)
            at, stop = starts.copy(), starts + size if ends is None else np.minimum(starts + size, ends)
            for j in range(int(chosen.max()) + 1):
                word = np.where(at < stop, padded[np.clip(at, 0, len(words))], -1)
                word = (word if begins is None else np.where(at < begins, 0, word)).astype(np.uint64)
                drawn = mixed(word + salt[j])
                for s in range(self.samples):
                    if j in chosen[s]:
                        row = walk * self.samples + s
                        keys[row] = mixed(keys[row] * np.uint64(0xD6E8FEB86659FD93) + word + np.uint64(j))
                at += (drawn >> np.uint64(63)).astype(np.int64)
        return keys

    def candidates(self, words: np.ndarray, document: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, start) of windows that share a key with the item.

        Windows start at every word; at a text's end they are shorter than the
        item, as those of a passage that lost words are.  Some start before the
        text's first word, as they do before a passage inside a text.
        """
        texts, before = np.flatnonzero(np.diff(bounds)), max(map(self.edits, range(len(self.words))), default=0)
        at = np.concatenate((np.arange(len(words)), (bounds[texts, None] - np.arange(1, before + 1)).ravel()))
        text = np.concatenate((document, np.repeat(texts, before)))
        begin, end = bounds[text], bounds[text + 1]
        first = np.maximum(at, begin)
        hits = np.zeros(len(words) + 1, np.int64)
        if len(words) > 1:
            near = self.pairs[self.pair_slots(words)] & (words[:-1] > 0) & (words[1:] > 0)
            hits[2:] = np.cumsum(near)
        for size, tables in self.tables.items():
            most = int(self.edit_rate * max(len(self.words[k]) for k in self.classes[size]))
            stop = np.maximum(np.minimum(at + size, end), begin)
            # A word that is missing at a text's end is one of the edits, so the bounds hold for short windows too.
            if size - 1 - 3 * most > 0:
                enough = hits[stop] - hits[first + 1] >= size - 1 - 3 * most
            else:  # too short for pairs to tell, but some of the words must occur
                known = np.append(0, np.cumsum(words > 0))
                enough = known[stop] - known[first] >= max(1, size - most)
            chosen = np.flatnonzero(enough & (stop - first >= size - most))
            for c in range(0, len(chosen), 1 << 16):
                part = chosen[c : c + (1 << 16)]
                for row, (sorted_keys, members) in zip(self.keys(words, at[part], size, begin[part], end[part]), tables, strict=True):
                    low, high = np.searchsorted(sorted_keys, row, "left"), np.searchsorted(sorted_keys, row, "right")
                    for w in np.flatnonzero(high > low):
                        for k in members[low[w] : high[w]].tolist():
                            yield k, int(first[part[w]])

    def matches(self, words: np.ndarray, document: np.ndarray, bounds: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
        """(document, item) -> (edits, near which word), the least edits and then the first place."""
        seen: dict[tuple[int, int], set[int]] = {}
        for k, start in self.candidates(words, document, bounds):
            # Starts are rounded to steps of the allowed edits: one region serves all windows in a step.
            seen.setdefault((int(document[start]), k), set()).add(start // (self.edits(k) + 1))
        found: dict[tuple[int, int], tuple[int, int]] = {}
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        for (d, k), steps in seen.items():
            e = self.edits(k)
            for s in steps:
                low = max(int(bounds[d]), s * (e + 1) - e)
                by_item.setdefault(k, []).append((d, low, min(int(bounds[d + 1]), s * (e + 1) + len(self.words[k]) + 2 * e + 1)))
        for k, regions in by_item.items():
            for begin in range(0, len(regions), 2048):
                part = regions[begin : begin + 2048]
                width = max(high - low for _, low, high in part)
                block = np.zeros((len(part), width), np.int64)
                for row, (_, low, high) in enumerate(part):
                    block[row, : high - low] = words[low:high]
                for (d, low, _), cost in zip(part, least_edits(self.words[k], block).tolist(), strict=True):
                    if cost <= self.edits(k):
                        found[d, k] = min(found.get((d, k), (cost, low)), (cost, low))
        return found


def least_edits(item: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """The least edit distance between ``item`` and any part of each region (a row; 0 matches nothing)."""
    across = np.arange(regions.shape[1] + 1)
    row = np.zeros((len(regions), regions.shape[1] + 1), np.int64)
    for i, word in enumerate(item, 1):
        step = np.empty_like(row)
        step[:, 0] = i
        step[:, 1:] = np.minimum(row[:, :-1] + (regions != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(step - across, axis=1) + across
    return row.min(axis=1)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks of about ``block_bytes`` the items make, and the blocks: as many passes as their size asks for."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("body"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def each() -> Iterator[list[tuple[int, str]]]:
        for b in range(blocks):
            part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == b)
            yield [(r.item_id, r.body) for r in part.collect()]

    return blocks, each()


def found_in(items: Items, texts: list[str]) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, near which word) of each item that a text holds."""
    known = items.vocabulary.get
    lists = [[known(w, 0) for w in WORDS(t.lower())] for t in texts]
    bounds = np.cumsum([0, *map(len, lists)])
    words = np.fromiter((w for x in lists for w in x), np.int64, int(bounds[-1]))
    document = np.repeat(np.arange(len(lists)), np.diff(bounds))
    return [(d, k, edits, int(at - bounds[d])) for (d, k), (edits, at) in sorted(items.matches(words, document, bounds).items())]


def find_contamination(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, near_word of each item that a whole text holds within ``edit_rate`` edits a word.

    Words are runs of word characters in lower case.  One row for a row of
    ``docs`` and an item, with the least edits and the first window near it.
    Items without words match nothing; null and empty texts hold nothing; a very
    long text is searched whole; repeated documents or items give repeated rows;
    null ids come through; no rows on an empty table.  Other columns don't matter.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body"))
    blocks, each = item_blocks(benchmark, block_bytes)
    out = None
    for block in each:
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def rows(batches, shipped=shipped):
            items = Items(shipped.value, edit_rate)
            for b in batches:
                found = found_in(items, b["body"])
                yield {"doc_id": [b["doc_id"][d] for d, *_ in found], "item_id": [items.ids[k] for _, k, *_ in found], "edits": [e for *_, e, _ in found], "near_word": [w for *_, w in found]}

        part = mapped(texts, rows, "doc_id long, item_id long, edits int, near_word long")
        if blocks > 1:  # a pass is done before the next block is fetched
            part = stored(part, "contamination")
            shipped.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds an item, all columns as they are.

    Each row is judged by its own text, so a row without a doc_id, or one whose
    doc_id repeats with another text, goes only if its own text holds an item.
    Null and empty texts stay; an empty table gives an empty table.
    """
    blocks, each = item_blocks(benchmark, block_bytes)
    for block in each:
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def clean(bodies, shipped=shipped):
            items = Items(shipped.value, edit_rate)
            for texts in bodies:
                held = {d for d, *_ in found_in(items, texts)}
                yield [k not in held for k in range(len(texts))]

        docs = rows_where(docs, clean)
        if blocks > 1:
            docs = stored(docs, "decontaminated")
            shipped.destroy()
    return docs
