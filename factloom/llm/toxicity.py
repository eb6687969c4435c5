"""Toxicity by the nearest labelled examples.

Examples and documents are TF-IDF vectors over all words of the sampled
examples, and every example is in the index.  Words that tell the labels apart
weigh more; none weighs less than its TF-IDF.  The index is inverted with block
maxima: similar examples stand together in blocks, each common word has its
largest weight in each block, and only blocks whose bound reaches the k-th best
cosine so far are opened; rare words are plain postings.  Candidates are
compared in full in double precision, so the neighbours are exactly the nearest.
They vote with their squared cosines against a prior; a logistic curve, fitted on
the examples with each one left out of its own vote, turns votes into calibrated
scores.

Scale: texts are read three times, for the sample, the document frequencies and
the scores, and neither stored nor shuffled.  The index is fitted on a bounded
sample of labelled rows (``EXAMPLES`` of each label, by hash), hence its
broadcast is bounded too; document frequencies count all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, rows_where, stored, text_or_empty

WORDS = re.compile(r"\w+").findall
#: Labelled rows of each label that the classifier is fitted on, at most (the documented bound of the sample).
EXAMPLES = 4096
#: Neighbours that vote; the prior's weight in a vote.
NEIGHBOURS, PRIOR_WEIGHT = 16, 0.5
#: Features of more than this share of the examples are common, ``DENSE`` of them at most; the others are postings.
COMMON_SHARE, DENSE = 0.03, 2048
#: Examples of a block; centres that similar ones are gathered around.
BLOCK, CENTRES = 16, 64
#: Words of a part of the document frequencies.
COUNTED = 8192
#: Texts whose scores are remembered for further rows with them.
REMEMBERED = 8192
#: Documents searched at a time, and characters turned to vectors at a time.
SEARCHED, CHARACTERS = 64, 1 << 20


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs of ``lengths`` from ``starts``, one run after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


@cache
def word_characters() -> np.ndarray:
    """Which code points ``WORDS`` takes into words."""
    held = np.zeros(0x110000, bool)
    points = np.flatnonzero((np.arange(len(held)) < 0xD800) | (np.arange(len(held)) > 0xDFFF))
    for word in re.finditer(r"\w+", points.astype("<u4").tobytes().decode("utf-32-le")):
        held[points[word.start() : word.end()]] = True
    return held


def words_of(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """What ``WORDS`` finds in the lower-cased texts, one after the other, and the text that each word is of."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = word_characters()[points]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    points = points[inside]
    sizes = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)
    offsets = np.concatenate((np.zeros(1, np.int64), sizes[np.cumsum(lengths) - 1]))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(points.tobytes().decode("utf-32-le").encode()))
    return words, np.searchsorted(np.cumsum([len(t) + 1 for t in low]), starts, "right")


class Features:
    """Word counts of texts over a fixed list of words."""

    def __init__(self, names: list[str]):
        self.names = names
        self.ids: dict[str, int] | None = None

    def __len__(self) -> int:
        return len(self.names)

    def __getstate__(self) -> list[str]:
        return self.names

    def __setstate__(self, names: list[str]) -> None:
        self.__init__(names)

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's entries begin (and the last one's end), their features in order, their counts."""
        if self.ids is None:
            self.ids = dict(zip(self.names, range(len(self.names)), strict=True))
        words, text = words_of(texts)
        # Distinct words of all the texts only: the looking up costs more than all else.
        distinct = words.dictionary_encode()
        names = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = np.fromiter(map(self.ids.get, names, repeat(-1)), np.int64, len(names))[distinct.indices.to_numpy()]
        width = max(1, len(self.names))
        keys = np.sort((text * width + found)[found >= 0])
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.diff(first, append=len(keys))
        keys = keys[first]
        return np.searchsorted(keys, np.arange(len(texts) + 1) * width), keys % width, times

    def parts(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, and what ``vectors`` gives) of parts of the texts of a bounded size."""
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= CHARACTERS:
                size += len(texts[to])
                to += 1
            bounds, features, times = self.vectors(texts[at:to])
            for k in range(0, to - at, SEARCHED):
                part = bounds[k : k + SEARCHED + 1]
                yield at + k, part - part[0], features[part[0] : part[-1]], times[part[0] : part[-1]]
            at = to


class BlockMaxIndex:
    """Exact nearest examples by cosine, from an inverted index with block maxima.

    Similar examples stand together in blocks of ``BLOCK``.  Rare features are
    lists of postings, added up first.  Common features have a weight for each
    example, by block, and the largest one of each block: with them a block's
    bound is known, and only blocks whose bound reaches the k-th best cosine so
    far are opened.
    """

    def __init__(self, vectors: list[dict[int, int]], idf: np.ndarray, ids: list[int], labels: list[int]):
        pairs = [(np.array(sorted(v), np.int64), np.array([v[f] for f in sorted(v)], np.float64)) for v in vectors]
        self._fill(pairs, idf, ids, labels)

    @classmethod
    def of(cls, pairs: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, ids: list[int], labels: list[int]) -> BlockMaxIndex:
        """From (features in order, counts) of each example."""
        index = cls.__new__(cls)
        index._fill(pairs, idf, ids, labels)
        return index

    def _fill(self, pairs, idf, ids, labels) -> None:
        self.idf, self.ids, self.labels = idf, np.array(ids, np.int64), np.array(labels, np.float64)
        # Examples with the same vector are searched as one, which also makes their cosines equal.
        alike: dict[tuple[bytes, bytes], list[int]] = {}
        for k, (f, n) in enumerate(pairs):
            alike.setdefault((f.tobytes(), n.tobytes()), []).append(k)
        self.rows = list(alike.values())
        own = [pairs[rows[0]] for rows in self.rows]
        order = self._side_by_side(own)
        self.rows, own = [self.rows[k] for k in order], [own[k] for k in order]
        self.begins = np.cumsum([0, *(len(f) for f, _ in own)])
        self.features = np.concatenate([np.empty(0, np.int32), *(f for f, _ in own)]).astype(np.int32)
        self.times = np.concatenate([np.empty(0, np.int32), *(n for _, n in own)]).astype(np.int32)
        self.opened = False

    def _flat(self, own: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vector, feature and weight of all entries, and the common features."""
        vector = np.repeat(np.arange(len(own)), [len(f) for f, _ in own])
        features = np.concatenate([np.empty(0, np.int64), *(f for f, _ in own)]).astype(np.int64)
        times = np.concatenate([np.empty(0), *(n for _, n in own)]).astype(float)
        return vector, features, self.weigh(vector, features, times, len(own)), self._common(features, len(own))

    def _common(self, features: np.ndarray, n: int) -> np.ndarray:
        held = np.bincount(features, minlength=len(self.idf))
        common = np.argsort(-held, kind="stable")[:DENSE]
        return common[held[common] > COMMON_SHARE * n]

    def _side_by_side(self, own: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """An order with similar vectors together: by nearest of some centres, moved a few times, then by closeness."""
        n = len(own)
        if n <= BLOCK:
            return np.arange(n)
        vector, features, weights, common = self._flat(own)
        place = np.full(len(self.idf), -1)
        place[common] = np.arange(len(common))
        inside = place[features] >= 0
        rows = np.zeros((n, len(common)), np.float32)
        rows[vector[inside], place[features[inside]]] = weights[inside]
        centres = rows[np.random.default_rng(3).choice(n, min(CENTRES, n), replace=False)]
        for _ in range(4):
            nearest = (rows @ centres.T).argmax(1)
            centres = np.stack([rows[nearest == k].sum(0) if (nearest == k).any() else c for k, c in enumerate(centres)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        close = rows @ centres.T
        nearest = close.argmax(1)
        return np.lexsort((close[np.arange(n), nearest], nearest))

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("idf", "ids", "labels", "rows", "begins", "features", "times")} | {"opened": False}

    def _open(self) -> None:
        """Blocks, their maxima and the postings, made where they are used."""
        if self.opened:
            return
        n, width = len(self.rows), len(self.idf)
        common = self._common(self.features, n)
        self.place = np.full(width, -1, np.int32)
        self.place[common] = np.arange(len(common))
        self.dense = np.zeros((-(-n // BLOCK), len(common), BLOCK), np.float32)
        self.values = np.empty(len(self.features))
        # Block by block, as a worker's memory is short.
        for k in range(len(self.dense)):
            begins = self.begins[k * BLOCK : k * BLOCK + BLOCK + 1]
            part = slice(begins[0], begins[-1])
            vector = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
            weights = self.values[part] = self.weigh(vector, self.features[part], self.times[part], BLOCK)
            place = self.place[self.features[part]]
            self.dense[k, place[place >= 0], vector[place >= 0]] = weights[place >= 0]
        self.maxima = np.ascontiguousarray(self.dense.max(axis=2).T) if n else np.zeros((len(common), 0), np.float32)
        rare = np.flatnonzero(self.place[self.features] < 0).astype(np.int32)
        rare = rare[np.argsort(self.features[rare], kind="stable")]
        self.posted = (np.searchsorted(self.begins, rare, "right") - 1).astype(np.int32)
        self.posted_weights = self.values[rare].astype(np.float32)
        self.post_begins = np.concatenate(([0], np.cumsum(np.where(self.place < 0, np.bincount(self.features, minlength=width), 0))))
        self.scratch, self.opened = np.zeros(width), True
        del self.times  # the weights take their place

    @property
    def weights(self) -> np.ndarray:
        """All weights as a matrix of features and examples."""
        self._open()
        out = np.zeros((len(self.idf), len(self.ids)))
        for u, rows in enumerate(self.rows):
            part = slice(self.begins[u], self.begins[u + 1])
            out[self.features[part, None], np.array(rows)] = self.values[part, None]
        return out

    def weigh(self, vector: np.ndarray, features: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """Weights that give each of ``n`` vectors a length of one."""
        weights = (1 + np.log(times)) * self.idf[features]
        return weights / np.sqrt(np.bincount(vector, weights * weights, n))[vector]

    def unit(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Features and weights of a vector of length one; empty without features."""
        features = np.array(sorted(counts), np.int64)
        return features, self.weigh(np.zeros(len(features), np.int64), features, np.array([counts[f] for f in features.tolist()], np.float64), 1)

    def nearest(self, counts: dict[int, int], k: int, without: int | None = None) -> list[tuple[float, int]]:
        """(cosine, row) of the k examples with the largest positive cosine; ties go to the lower row."""
        features = np.array(sorted(counts), np.int64)
        times = np.array([counts[f] for f in features.tolist()], np.float64)
        return self.nearest_of(np.array([0, len(features)]), features, times, k, [without])[0]

    def _candidates(self, bounds: np.ndarray, features: np.ndarray, weights: np.ndarray, vector: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """For each vector the examples that may be among the ``most`` nearest: all that are, and few more."""
        m, n, blocks = len(bounds) - 1, len(self.rows), len(self.dense)
        place = self.place[features]
        inside = place >= 0
        queries = np.zeros((m, self.dense.shape[1]), np.float32)
        queries[vector[inside], place[inside]] = weights[inside]
        cosines = np.zeros((m, blocks * BLOCK), np.float32)
        rare = np.flatnonzero(~inside)
        starts, ends = self.post_begins[features[rare]], self.post_begins[features[rare] + 1]
        rare, starts, lengths = rare[ends > starts], starts[ends > starts], (ends - starts)[ends > starts]
        at = runs(starts, lengths)
        posted, sums = self.posted[at], self.posted_weights[at] * np.repeat(weights[rare].astype(np.float32), lengths)
        edges = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(rare, bounds)].tolist()
        for q, (a, b) in enumerate(pairwise(edges)):
            if b > a:
                cosines[q, :n] = np.bincount(posted[a:b], sums[a:b], n)
        by_block = cosines.reshape(m, blocks, BLOCK)
        best = queries @ self.maxima + by_block.max(axis=2)

        def opened(who: np.ndarray, block: np.ndarray) -> None:
            order = np.argsort(block, kind="stable")
            who, block = who[order], block[order]
            for a, b in pairwise(np.flatnonzero(np.diff(block, prepend=-1, append=-1)).tolist() if len(block) else []):
                by_block[who[a:b], block[a]] += queries[who[a:b]] @ self.dense[block[a]]

        # The most promising blocks first: the k-th best of their cosines is a bound that most of the others don't reach.
        ahead = min(blocks, -(-most // BLOCK) + 2)
        first = np.argpartition(best, blocks - ahead, axis=1)[:, blocks - ahead :]
        opened(np.repeat(np.arange(m), ahead), first.ravel())
        seen = by_block[np.arange(m)[:, None], first].reshape(m, -1)
        # Single precision chooses more than enough.
        least = np.partition(seen, -most, axis=1)[:, -most] - 1e-5 if seen.shape[1] > most else np.zeros(m, np.float32)
        needed = best >= least[:, None] - 1e-5
        np.put_along_axis(needed, first, False, axis=1)
        opened(*np.nonzero(needed))
        np.put_along_axis(needed, first, True, axis=1)
        for q in range(m):
            block = np.flatnonzero(needed[q])
            seen = by_block[q, block].ravel()
            enough = np.partition(seen, -most)[-most] - 1e-5 if len(seen) > most else 0
            near = np.flatnonzero((seen >= enough) & (seen > 0))
            yield block[near // BLOCK] * BLOCK + near % BLOCK

    def nearest_of(self, bounds: np.ndarray, features: np.ndarray, times: np.ndarray, k: int, without: list[int | None] | None = None) -> list[list[tuple[float, int]]]:
        """``nearest`` of vectors that lie one after the other, each without the row named for it."""
        self._open()
        m = len(bounds) - 1
        if not self.rows or not len(features):
            return [[] for _ in range(m)]
        vector, out = np.repeat(np.arange(m), np.diff(bounds)), []
        weights = self.weigh(vector, features, times, m)
        for q, own in enumerate(self._candidates(bounds, features, weights, vector, k + (without is not None))):
            mine = slice(bounds[q], bounds[q + 1])
            self.scratch[features[mine]] = weights[mine]
            begins, lengths = self.begins[own], self.begins[own + 1] - self.begins[own]
            at = runs(begins, lengths)
            exact = np.add.reduceat(self.scratch[self.features[at]] * self.values[at], np.cumsum(lengths) - lengths).tolist() if len(own) else []
            self.scratch[features[mine]] = 0
            skip = None if without is None else without[q]
            near = [(round(c, 9), row) for c, u in zip(exact, own.tolist(), strict=True) for row in self.rows[u] if row != skip]
            out.append(sorted(near, key=lambda x: (-x[0], x[1]))[:k])
        return out

    def vote(self, near: list[tuple[float, int]], prior: float) -> float:
        weight = sum(c * c for c, _ in near)
        return (sum(c * c * self.labels[r] for c, r in near) + PRIOR_WEIGHT * prior) / (weight + PRIOR_WEIGHT)


def logistic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a calibration curve on the votes' log odds, by Newton's method with a weak pull to the identity."""
    x = np.stack([np.ones_like(votes), np.log(votes / (1 - votes))])
    b, start = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        gradient = x @ (weights * (labels - p)) - (b - start)
        b = b + np.linalg.solve((x * (weights * p * (1 - p))) @ x.T + np.eye(2), gradient)
    return float(b[0]), float(max(b[1], 0.05))


def calibrated(vote: float, curve: tuple[float, float]) -> float:
    vote = min(max(vote, 1e-6), 1 - 1e-6)
    return float(1 / (1 + np.exp(-(curve[0] + curve[1] * np.log(vote / (1 - vote))))))


def is_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sampled_labels(labels: DataFrame, examples: int) -> tuple[DataFrame, float]:
    """doc_id and label of the sample, at most ``examples`` of each label, and the share of label 1 in all training rows."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    training = known.where(~is_held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    count, ones = training.agg(F.count("label"), F.sum("label")).first()
    parts = [training.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), (ones or 0) / count if count else 0.0


def all_words(rows: DataFrame) -> list[str]:
    """Every word of the rows."""

    def held(batches):
        seen: set[str] = set()
        for b in batches:
            new = {w for text in b["body"] for w in WORDS(text.lower())} - seen
            seen |= new
            yield {"feature": list(new)}

    return sorted(r.feature for r in mapped(rows.select("body"), held, "feature string").distinct().collect())


def holders(texts: DataFrame, names) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many hold each word of a broadcast list: sums of packed counts, added up in two rounds."""

    def count(batches):
        held, total = np.zeros(len(names.value), np.int64), 0
        for b in batches:
            for _, _, features, _ in names.value.parts(b["body"]):
                held += np.bincount(features, minlength=len(held))
            total += len(b["body"])
        parts = [np.array([total]), *(held[k : k + COUNTED] for k in range(0, len(held), COUNTED))]
        salt = int(np.random.default_rng().integers(16))
        yield {"part": list(range(len(parts))), "salt": [salt] * len(parts), "held": [p.tobytes() for p in parts]}

    def added(salted: bool):
        def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = 0
            for b in batches:
                for raw in b.column("held"):
                    out = out + np.frombuffer(raw.as_py(), np.int64)
            yield pa.record_batch({"part": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "held": [out.tobytes()]})

        return add

    schema = "part int, salt int, held binary"
    counts = mapped(texts.select("body"), count, schema).groupBy("part", "salt").applyInArrow(added(True), schema).groupBy("part").applyInArrow(added(False), schema)
    found = {r.part: np.frombuffer(r.held, np.int64) for r in counts.collect()}
    return int(found[0][0]) if found else 0, np.concatenate([np.empty(0, np.int64), *(found[k] for k in sorted(found) if k)]) if found else np.zeros(len(names.value))


def relevance(held: list[np.ndarray], labels: list[int], width: int) -> np.ndarray:
    """One plus the root of each feature's chi-square value for the labels: what tells them apart weighs more, nothing weighs less."""
    ones, zeros = (np.bincount(np.concatenate([np.empty(0, np.int32), *(f for f, x in zip(held, labels, strict=True) if x == y)]).astype(np.int64), minlength=width) for y in (1, 0))
    n1, n0 = labels.count(1) + 1, labels.count(0) + 1
    pooled = (ones + zeros + 1) / (n1 + n0)
    variance = np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n1 + 1 / n0)
    return 1 + np.abs((ones + 0.5) / n1 - (zeros + 0.5) / n0) / np.sqrt(variance)


class Scorer:
    """What scores texts on the executors: the broadcast words and index, the prior and the calibration."""

    def __init__(self, names, index, prior: float, curve: tuple[float, float]):
        self.names, self.index, self.prior, self.curve = names, index, prior, curve

    def scores(self, batches: Iterable[list[str]]) -> Iterator[list[tuple[float, list[tuple[float, int]]]]]:
        """(score, neighbours) of each text of each batch; a text that occurs again is searched once, while it is remembered."""
        names, index, seen = self.names.value, self.index.value, {}
        for texts in batches:
            keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            if len(seen) > REMEMBERED:
                seen.clear()
            new = {k: t for k, t in zip(keys, texts, strict=True) if k not in seen}
            order = list(new)
            for at, bounds, features, times in names.parts(list(new.values())):
                for k, near in zip(order[at:], index.nearest_of(bounds, features, times, NEIGHBOURS), strict=False):
                    seen[k] = calibrated(index.vote(near, self.prior), self.curve), near
            yield [seen[k] for k in keys]


def fitted(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Scorer:
    """The classifier, from labelled rows that are not held out and the document frequencies of all ``docs``."""
    sample, prior = sampled_labels(labels, examples)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body"))
    # At most ``examples`` rows of each label, one a document: a bounded broadcast.
    rows = texts.join(F.broadcast(stored(sample, "toxic-sample")), "doc_id")
    rows = stored(rows.groupBy("doc_id", "label").agg(F.max("body").alias("body")), "toxic-examples")
    context = docs.sparkSession.sparkContext
    names = context.broadcast(Features(all_words(rows)))

    total, frequency = holders(texts, names)
    idf = np.log((1 + total) / (1 + frequency)) + 1

    def vectorise(batches):
        for b in batches:
            for at, bounds, features, times in names.value.parts(b["body"]):
                to = at + len(bounds) - 1
                cut = [slice(i, j) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield {"doc_id": b["doc_id"][at:to], "label": b["label"][at:to], "features": [features[c].astype(np.int32).tobytes() for c in cut], "times": [times[c].astype(np.int32).tobytes() for c in cut]}

    own = sorted(mapped(rows, vectorise, "doc_id long, label int, features binary, times binary").collect(), key=lambda r: r.doc_id)
    pairs = [(np.frombuffer(r.features, np.int32), np.frombuffer(r.times, np.int32)) for r in own]
    ids, known = [r.doc_id for r in own], [r.label for r in own]
    shipped = context.broadcast(BlockMaxIndex.of(pairs, idf * relevance([f for f, _ in pairs], known, len(idf)), ids, known))
    del own, pairs

    def own_votes(batches):
        index = shipped.value
        row_of = {d: k for k, d in enumerate(index.ids.tolist())}
        for b in batches:
            for at, bounds, features, times in names.value.parts(b["body"]):
                ids = b["doc_id"][at : at + len(bounds) - 1]
                near = index.nearest_of(bounds, features, times, NEIGHBOURS, [row_of[d] for d in ids])
                yield {"doc_id": ids, "vote": [index.vote(x, prior) for x in near]}

    curve = (0.0, 1.0)
    if len(set(known)) == 2:
        found = {r.doc_id: r.vote for r in mapped(rows, own_votes, "doc_id long, vote double").collect()}
        # The sample takes as many of each label; weights give each label its share of all training rows.
        sizes = {y: known.count(y) for y in (0, 1)}
        share = {1: prior / sizes[1], 0: (1 - prior) / sizes[0]}
        curve = logistic(np.clip([found[d] for d in ids], 1e-6, 1 - 1e-6), np.array(known, float), np.array([share[y] for y in known]) * len(known))

    return Scorer(names, shipped, prior, curve)


def score_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Scores of every whole text by its nearest labelled examples.

    Returns doc_id, held_out, score, predicted and evidence (the neighbours'
    doc_ids, cosines and labels): one row per row of ``docs``.  Training uses
    labelled rows that are not held out (crc32 of the doc_id's text, mod 5); a
    score comes from the text alone.  A null or empty text, or one without any
    word of the sample, has no neighbours and gets the prior's score.  Without
    training rows the prior is 0.  A null doc_id is not held out and trains
    nothing; conflicting labels count as 1; repeated rows are scored each; a very
    long text is turned to a vector by itself; other columns don't matter; an
    empty table gives no rows.
    """
    scorer = fitted(docs, labels, examples)

    def rows(batches):
        ids = []

        def bodies():
            for b in batches:
                ids.append(b["doc_id"])
                yield b["body"]

        for scored in scorer.scores(bodies()):
            index = scorer.index.value
            yield {
                "doc_id": ids.pop(),
                "score": [s for s, _ in scored],
                "evidence": [[{"doc_id": int(index.ids[r]), "cosine": c, "label": int(index.labels[r])} for c, r in near] for _, near in scored],
            }

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body"))
    scored = mapped(texts, rows, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double, label: int>>")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic, all columns as they are.

    Each row is judged by its own text, so a row without a doc_id, or one whose
    doc_id repeats with another text, goes only if its own text does.  Null and
    empty texts get the prior's score; an empty table gives an empty table.
    """
    scorer = fitted(docs, labels, **options)

    def mild(bodies: Iterator[list[str]]) -> Iterator[list[bool]]:
        for scored in scorer.scores(bodies):
            yield [score < 0.5 for score, _ in scored]

    return rows_where(docs, mild)
