"""Similarity join on word n-grams by a token-group matrix.

Documents with equal shingle sets are one.  The others are partitioned into
groups: those with a verified link to the leader of a shared min-hash key form a
cluster, those that only share a key with several others form a family, and what
resembles nothing is a group by itself.  The matrix holds, for each group, the
union of its members' tokens as far as the prefix filter needs them: a set that
is linked to a group's member shares a token of its prefix (the quarter of its
tokens that comes first in a global order, frequent ones last) with the union.
That and the tokens' places bound the overlap of a query and a group; only groups
that the bound lets through are opened, and their members are compared exactly,
those of a family with each other too.

Scale: a cluster or family of any size takes one row a token in the matrix, so a
hot one doesn't meet itself there; it is opened in blocks, each a task of bounded
documents and bytes with a bounded number of queries, which gives a forest of its
links and not all of them.  Every step is a shuffle on a key or a pass; the
filters and the list of frequent tokens that tasks get have fixed sizes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_word_hashes, discard, distinct, fixed_filter, gram_hashes, mapped, mixed, passes, stored, text_or_empty, with_row_ids
from .components import connected

#: Words of a shingle; the similarity of a link in hundredths.
SHINGLE, PERCENT = 5, 75
#: Keys of a document, each of so many min-hashes.
KEYS, KEY_HASHES = 4, 2
#: Min-hashes, of all KEYS * KEY_HASHES, in which a document and its leader agree before they are compared.
AGREEING = 5
#: Frequent tokens that the order puts last (the list's bound), and how often one is seen in a batch to count.
FREQUENT, SEEN = 200_000, 3
#: Documents that share a min-hash key, at least, to be a family.
FAMILY = 8
#: Documents of a block of a group, queries that one task compares with it, and about the tokens of either.
BLOCK, QUERIES, BLOCK_TOKENS = 256, 512, 1 << 19
#: Bytes of texts hashed at a time; tokens packed at a time, and about as many in a bucket.
PART_BYTES, PORTION = 1 << 20, 1 << 18


def shingle_sets(texts: list[str], n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The shingle set of each text, as a sorted array of 64-bit hashes."""
    part, held = [], 0
    for text in texts:
        part.append(text.encode().lower())
        held += len(part[-1])
        if held >= PART_BYTES:
            yield from _shingle_sets(part, n)
            part, held = [], 0
    yield from _shingle_sets(part, n)


def _shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    words, bounds = batch_word_hashes(texts)
    grams = gram_hashes(words, n)
    for low, high in itertools.pairwise(bounds.tolist()):
        if high - low >= n:
            yield distinct(grams[low : high - n + 1])
        else:  # the whole sequence, if there is one
            yield gram_hashes(words[low:high], high - low) ^ np.uint64(high - low) if high > low else words[:0]


def needed(size: int, percent: int) -> int:
    """The least overlap of a set of ``size`` with any set that it is linked to."""
    return -(-percent * size // 100)


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Values that two sorted sets share."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) < needed(max(len(x), len(y)), percent):
        return False
    common = in_common(x, y)
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def frequent_tokens(texts: DataFrame, n: int) -> np.ndarray:
    """Tokens in many documents, the rarer first: a list of bounded length that only steers the order."""

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            sets = list(shingle_sets(b["body"], n))
            tokens, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, int))
            often = count >= SEEN
            yield {"token": tokens[often].view(np.int64), "n": count[often]}

    counts = mapped(texts.select("body"), rows, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "token").limit(FREQUENT).select("token").toPandas()["token"].to_numpy(np.int64)
    return top[::-1].view(np.uint64).copy()


def described(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size, signature, keys, least (min-hashes) and prefix (tokens in the global order) of each document."""
    spark = texts.sparkSession
    frequent = frequent_tokens(texts, n)
    order = np.argsort(frequent)
    shipped = spark.sparkContext.broadcast((frequent[order], order))

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        known, rank = shipped.value
        salts = mixed(np.arange(1, KEYS * KEY_HASHES + 1, dtype=np.uint64))
        for b in batches:
            out = {k: [] for k in ("doc_id", "size", "signature", "keys", "least", "prefix")}
            for doc_id, tokens in zip(b["doc_id"], shingle_sets(b["body"], n), strict=True):
                size = len(tokens)
                keys, least, prefix = [], [], b""
                if size:
                    least = [int((tokens ^ s).min()) for s in salts]
                    keys = [xxhash.xxh3_64_intdigest(repr((k, least[k * KEY_HASHES : (k + 1) * KEY_HASHES])).encode()) - 2**63 for k in range(KEYS)]
                    at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
                    late = np.where(known[at] == tokens, rank[at], -1) if len(known) else np.full(size, -1)
                    prefix = tokens[np.argsort(late, kind="stable")][: size - needed(size, percent) + 1].tobytes()
                for k, v in (("doc_id", doc_id), ("size", size), ("signature", xxhash.xxh3_128_digest(tokens.tobytes())), ("keys", keys), ("least", [x - 2**63 for x in least]), ("prefix", prefix)):
                    out[k].append(v)
            yield out

    return mapped(texts, rows, "doc_id long, size long, signature binary, keys array<long>, least array<long>, prefix binary")


def parities(tokens: np.ndarray) -> bytes:
    """A set's size, and the parity of its tokens in each of some slots, four or more a token."""
    slots = 1 << max(6, (4 * len(tokens) - 1).bit_length())
    odd = np.bincount((mixed(tokens) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return len(tokens).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def most_in_common(x: bytes, y: bytes) -> tuple[int, int, int]:
    """The sizes of two sets, and a bound of their overlap: each slot whose parities differ has a token of one set only."""
    (n, u), (m, v) = ((int.from_bytes(raw[:8], "little"), np.frombuffer(raw, np.uint8, offset=8)) for raw in (x, y))
    while len(u) != len(v):  # halves of the longer one fall together
        u, v = (u, v) if len(u) > len(v) else (v, u)
        u = u[: len(u) // 2] ^ u[len(u) // 2 :]
    return n, m, min((n + m - int(np.bitwise_count(u ^ v).sum())) // 2, n, m)


def sets_of(texts: DataFrame, ids: DataFrame, n: int, rough: bool = False) -> DataFrame:
    """doc_id and tokens (bytes of the sorted set) or rough (its parities) of the documents in ``ids``.

    One pass behind a filter of fixed size, which lets a few more documents through.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(fixed_filter(ids))
    name = "rough" if rough else "tokens"

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            at = np.flatnonzero(passes(shipped.value, np.array(b["doc_id"], np.int64).view(np.uint64))).tolist()
            sets = shingle_sets([b["body"][k] for k in at], n)
            yield {"doc_id": [b["doc_id"][k] for k in at], name: [parities(x) if rough else x.tobytes() for x in sets]}

    return stored(mapped(texts, rows, f"doc_id long, {name} binary"), "sets")


def ends_of(pairs: DataFrame) -> DataFrame:
    """doc_id of both ends of each pair, repeats and all."""
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def _paired(pairs: DataFrame, sets: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) whose sets, in ``column``, pass ``test``."""
    first, second = sets.select(F.col("doc_id").alias("a"), F.col(column).alias("x")), sets.select(F.col("doc_id").alias("b"), F.col(column).alias("y"))

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        for p in batches:
            good = [test(x, y) for x, y in zip(p["x"], p["y"], strict=True)]
            yield {k: [v for v, g in zip(p[k], good, strict=True) if g] for k in ("a", "b")}

    return mapped(pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y"), rows, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    return _paired(pairs, sets, "tokens", lambda x, y: linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that may be linked, as far as parities tell; none that is linked is lost."""

    def test(x: bytes, y: bytes) -> bool:
        n, m, common = most_in_common(x, y)
        return 100 * common >= percent * (n + m - common)

    return _paired(pairs, sets, "rough", test)


def leader_pairs(documents: DataFrame) -> DataFrame:
    """(a, b): each document with the least one of every key that it shares, where most of their min-hashes agree.

    A pair that this leaves out may be linked all the same; the matrix finds it.
    """
    keyed = documents.select("doc_id", "least", F.explode("keys").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min(F.struct(F.col("doc_id").alias("b"), F.col("least").alias("b_least"))).alias("leader"), F.count(F.lit(1)).alias("held")).where("held > 1").select("key", "leader.*")
    agree = F.size(F.filter(F.zip_with("least", "b_least", lambda x, y: x == y), lambda same: same))
    return keyed.join(leaders, "key").where((F.col("doc_id") != F.col("b")) & (agree >= AGREEING)).select(F.col("doc_id").alias("a"), "b").distinct()


def cells(documents: DataFrame, kept: np.ndarray | None = None, told=None) -> DataFrame:
    """token, unit, place, least, most, large: a row for each token of the prefixes (unit, size, prefix, large), of those that ``kept`` tells only.

    ``told`` chooses rows first, in the same Python step.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(kept)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        bitmap = shipped.value
        for b in batches if told is None else told(batches):
            prefixes = [np.frombuffer(p, np.uint64) for p in b["prefix"]]
            lengths = [len(p) for p in prefixes]
            tokens = np.concatenate(prefixes) if prefixes else np.empty(0, np.uint64)
            place = np.concatenate([np.arange(k) for k in lengths]) if lengths else np.empty(0, np.int64)
            take = np.ones(len(tokens), bool) if bitmap is None else passes(bitmap, prints(tokens))
            unit, size, large = (np.repeat(np.array(b[k], kind), lengths)[take] for k, kind in (("unit", np.int64), ("size", np.int32), ("large", bool)))
            yield {"token": tokens[take].view(np.int64), "unit": unit, "place": place[take].astype(np.int32), "least": size, "most": size, "large": large}

    return mapped(documents.select("unit", "size", "prefix", "large"), rows, "token long, unit long, place int, least int, most int, large boolean")


def prints(tokens: np.ndarray) -> np.ndarray:
    """48 bits of each token; tokens that agree in them can only let more through a filter."""
    return mixed(tokens) >> np.uint64(16)


def shared_prints(documents: DataFrame, told, groups: DataFrame, buckets: int) -> DataFrame:
    """The 48 bits of every token that more than one unit has: of the documents that ``told`` chooses and of the groups.

    Tokens travel as packed bytes, six a token, by bucket; of a token's rows at
    most two leave a task's portion, so a frequent one fills no bucket.
    """

    def packed(tokens: list[np.ndarray]) -> dict:
        values, count = np.unique(prints(np.concatenate(tokens)), return_counts=True)
        values = np.repeat(values, np.minimum(count, 2))
        bucket = (mixed(values) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        values, bucket = values[order].view(np.uint8).reshape(-1, 8)[:, :6], bucket[order]
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        return {"bucket": bucket[edges[:-1]], "held": [values[x:y].tobytes() for x, y in itertools.pairwise(edges.tolist())]}

    def portions(arrays: Iterator[np.ndarray]) -> Iterator[dict]:
        portion, n = [], 0
        for tokens in arrays:
            portion.append(tokens)
            n += len(tokens)
            if n >= PORTION:
                yield packed(portion)
                portion, n = [], 0
        if n:
            yield packed(portion)

    def of_prefixes(batches: Iterator[dict]) -> Iterator[dict]:
        return portions(np.frombuffer(p, np.uint64) for b in told(batches) for p in b["prefix"])

    def of_tokens(batches: Iterator[dict]) -> Iterator[dict]:
        return portions(np.array(b["token"], np.int64).view(np.uint64) for b in batches)

    def twice(bucket: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(bucket["held"].to_pylist()), np.uint8).reshape(-1, 6)
        values = np.zeros((len(raw), 8), np.uint8)
        values[:, :6] = raw
        values = np.sort(values.reshape(-1).view(np.uint64))
        return pa.table({"print": distinct(values[1:][values[1:] == values[:-1]]).view(np.int64)})

    held = mapped(documents.select("unit", "prefix"), of_prefixes, "bucket long, held binary").unionByName(mapped(groups.select("token"), of_tokens, "bucket long, held binary"))
    return held.groupBy("bucket").applyInArrow(twice, "print long")


def matrix(documents: DataFrame, units: DataFrame, copies: DataFrame) -> DataFrame:
    """token, unit, place, least, most, large: the token-group matrix over tokens that more than one unit has.

    ``units`` has the unit of every document that is asked, and whether it has
    several members.  A document that is a unit by itself keeps its prefix where
    it is; those of groups, and copies, are told by a filter of fixed size and
    joined with their units, whose unions take a row a token.
    """
    others = units.where("large").select("doc_id").unionByName(copies.select(F.col("a").alias("doc_id")))
    shipped = documents.sparkSession.sparkContext.broadcast(fixed_filter(others))

    def told(batches: Iterator[dict], want: bool = False) -> Iterator[dict]:
        for b in batches:
            at = np.flatnonzero(passes(shipped.value, np.array(b["unit"], np.int64).view(np.uint64)) == want).tolist()
            yield {k: [v[i] for i in at] for k, v in b.items()}

    parts = documents.select(F.col("doc_id").alias("unit"), "size", "prefix", F.lit(False).alias("large"))
    grouped = mapped(parts.drop("large"), lambda batches: told(batches, True), "unit long, size long, prefix binary").withColumnRenamed("unit", "doc_id").join(units, "doc_id")
    groups = cells(grouped).groupBy("token", "unit").agg(F.min("place").alias("place"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("large").alias("large"))
    groups = stored(groups, "groups")
    tokens = documents.agg(F.sum(F.length("prefix")) / 8).first()[0] or 0
    kept = fixed_filter(stored(shared_prints(parts, told, groups, max(64, int(tokens) // PORTION)), "shared-prints"))
    bitmap = documents.sparkSession.sparkContext.broadcast(kept)

    def shared(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            at = np.flatnonzero(passes(bitmap.value, prints(np.array(b["token"], np.int64).view(np.uint64)))).tolist()
            yield {k: [v[i] for i in at] for k, v in b.items()}

    return stored(cells(parts, kept, told).unionByName(mapped(groups, shared, "token long, unit long, place int, least int, most int, large boolean")), "matrix")


def candidate_units(groups: DataFrame, percent: int) -> DataFrame:
    """(u, v, u_large, v_large): units whose overlap bound allows a link, u < v."""
    u, v = (groups.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("unit", "place", "least", "most", "large")]) for side in "uv")
    near = (F.col("u_most") * 100 >= F.col("v_least") * percent) & (F.col("v_most") * 100 >= F.col("u_least") * percent)
    # All that two linked sets share is at or after the first token that their prefixes share.
    ahead = F.least(F.col("u_most") - F.col("u_place"), F.col("v_most") - F.col("v_place")) * (100 + percent) >= (F.col("u_least") + F.col("v_least")) * percent
    pairs = u.join(v, "token").where((F.col("u_unit") < F.col("v_unit")) & near)
    pairs = pairs.groupBy("u_unit", "v_unit").agg(F.count(F.lit(1)).alias("common"), F.max("u_place").alias("i"), F.max("v_place").alias("j"), F.max(ahead).alias("ahead"), *[F.min(c).alias(c) for c in ("u_least", "v_least", "u_large", "v_large")])
    # After the last shared token of both prefixes the overlap of two single sets is at most what is left of either.
    bound = F.col("common") + F.least(F.col("u_least") - F.col("i"), F.col("v_least") - F.col("j")) - 1
    enough = bound * (100 + percent) >= (F.col("u_least") + F.col("v_least")) * percent
    return pairs.where(F.col("ahead") & (F.col("u_large") | F.col("v_large") | enough)).select(F.col("u_unit").alias("u"), F.col("v_unit").alias("v"), "u_large", "v_large")


def forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that connect what the pairs before them do not."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


class Sketches:
    """Parities of some sets as matrices, one for each number of slots, and shorter ones folded from them."""

    def __init__(self, roughs: list[bytes]):
        self.size = np.array([int.from_bytes(raw[:8], "little") for raw in roughs], np.int64)
        self.slots = np.array([len(raw) - 8 for raw in roughs])
        self.rows = {w: np.flatnonzero(self.slots == w) for w in np.unique(self.slots).tolist()}
        self.matrices = {(w, w): np.stack([np.frombuffer(roughs[k], np.uint8, offset=8) for k in rows]) for w, rows in self.rows.items()}

    def folded(self, have: int, want: int) -> np.ndarray:
        if (have, want) not in self.matrices:
            wide = self.folded(have, 2 * want)
            self.matrices[have, want] = wide[:, :want] ^ wide[:, want:]
        return self.matrices[have, want]

    def possible(self, rough: bytes, percent: int) -> np.ndarray:
        """Which sets the one of ``rough`` may be linked with; none that it is linked with is left out."""
        n, bits = int.from_bytes(rough[:8], "little"), np.frombuffer(rough, np.uint8, offset=8)
        out = np.zeros(len(self.size), bool)
        for have, rows in self.rows.items():
            x = bits
            while len(x) > have:
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            odd = np.bitwise_count(self.folded(have, len(x)) ^ x).sum(axis=1, dtype=np.int64)
            m = self.size[rows]
            common = np.minimum((n + m - odd) // 2, np.minimum(n, m))
            out[rows] = (100 * common >= percent * (n + m - common)) & (common > 0)
        return out


def _together(queries: DataFrame, members: DataFrame, sets: DataFrame, column: str, compare, schema: str) -> DataFrame:
    """``compare`` on the queries and members (doc_id, block, slice) of each block and slice, with their sets."""

    def with_sets(df: DataFrame, side: str) -> DataFrame:
        return df.join(sets, "doc_id").select(*[F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "block", "slice", column)])

    left = with_sets(queries, "query").groupBy("query_block", "query_slice")
    right = with_sets(members, "member").groupBy("member_block", "member_slice")
    return left.cogroup(right).applyInPandas(compare, schema)


def qualifying(queries: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """doc_id, block, slice, asks: the queries and members of each block that may have links, as far as parities tell."""

    def compare(key: tuple, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(m):
            sketches, ids = Sketches(m["member_rough"].tolist()), m["member_doc_id"].to_numpy()
            seen = np.zeros(len(m), bool)
            for d, rough in zip(q["query_doc_id"].tolist(), q["query_rough"], strict=True):
                near = sketches.possible(rough, percent) & (ids != d)
                if near.any():
                    seen |= near
                    out.append((d, *key, True))
            out += [(d, *key, False) for d in ids[seen].tolist()]
        return pd.DataFrame(out, columns=["doc_id", "block", "slice", "asks"]).astype({"doc_id": "int64", "block": "int64", "slice": "int64", "asks": "bool"})

    return _together(queries, members, sets, "rough", compare, "doc_id long, block long, slice long, asks boolean")


def opened(queries: DataFrame, blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of queries and members (doc_id, block, slice) of blocks that connect all that are linked.

    Each block, with a slice of its queries, is one group: its token union bounds
    the overlap, and only queries within the bound are compared with members.
    """

    def links(q: pd.DataFrame, members: pd.DataFrame) -> Iterator[tuple[int, int]]:
        held, ids = [np.frombuffer(t, np.uint64) for t in members["member_tokens"]], members["member_doc_id"].tolist()
        owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
        tokens = np.concatenate(held)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        size = np.array([len(h) for h in held])
        union = distinct(tokens)
        for d, t in zip(q["query_doc_id"].tolist(), q["query_tokens"], strict=True):
            x = np.frombuffer(t, np.uint64)
            at = np.minimum(np.searchsorted(union, x), len(union) - 1)
            x = x[union[at] == x]
            whole = len(t) // 8
            if len(x) < needed(whole, percent):
                continue
            low, high = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
            common = np.zeros(len(held), np.int64)
            # Some of the query's tokens at a time: each may be in every member.
            step = max(1, BLOCK_TOKENS // len(held))
            for k in range(0, len(x), step):
                l, n = low[k : k + step], (high - low)[k : k + step]
                common += np.bincount(owner[np.repeat(l - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(held))
            for k in np.flatnonzero((common > 0) & (100 * common >= percent * (whole + size - common))).tolist():
                if ids[k] != d:
                    yield d, ids[k]

    def compare(q: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        found = forest(links(q, members)) if len(q) and len(members) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return _together(queries, blocks, sets, "tokens", compare, "a long, b long")


def parts_of(documents, tokens, most: int) -> Column:
    """In how many parts documents go so that about ``most`` of them and ``BLOCK_TOKENS`` tokens are in each."""
    return F.greatest(F.ceil(documents / most), F.ceil(tokens / BLOCK_TOKENS))


def links_between(texts: DataFrame, groups: DataFrame, units: DataFrame, sizes: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links between documents of different units and inside families, enough to connect all that are linked."""
    candidates = stored(candidate_units(groups, percent), "candidates")
    single = candidates.where(~F.col("u_large") & ~F.col("v_large")).select(F.col("u").alias("a"), F.col("v").alias("b"))

    # The smaller unit's members are the queries, the larger unit's blocks are opened.
    def sized(side: str) -> DataFrame:
        return sizes.select(F.col("unit").alias(side), F.col("members").alias(f"{side}_members"))

    grouped = candidates.where(F.col("u_large") | F.col("v_large")).join(sized("u"), "u", "left").join(sized("v"), "v", "left").fillna(1, ["u_members", "v_members"])
    swap = F.col("u_members") > F.col("v_members")
    grouped = grouped.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("query_unit"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("unit"))
    grouped = stored(grouped.unionByName(sizes.where("family").select(F.col("unit").alias("query_unit"), "unit")), "grouped")

    blocked = units.join(sizes, "unit").withColumn("block_no", F.pmod(F.xxhash64("doc_id"), parts_of(F.col("members"), F.col("tokens"), BLOCK)))
    blocked = blocked.join(grouped.select("unit").distinct(), "unit", "left_semi")
    blocks = stored(blocked.select("doc_id", "unit", "block_no", F.xxhash64("unit", "block_no").alias("block")), "blocks")
    queries = units.select("doc_id", F.col("unit").alias("query_unit"), "size").join(grouped, "query_unit")
    # Inside a family each two blocks meet once.
    own = blocks.select("doc_id", F.col("unit").alias("query_unit"), F.col("block_no").alias("own_no"))
    queries = queries.join(own, ["doc_id", "query_unit"], "left").select("doc_id", "unit", "size", F.when(F.col("unit") == F.col("query_unit"), F.col("own_no")).otherwise(0).alias("least_no"))
    asked = queries.join(blocks.select("unit", "block", "block_no").distinct(), "unit").where("block_no >= least_no")
    asked = stored(asked.select("doc_id", "block", "size"), "asked")
    slices = asked.groupBy("block").agg(parts_of(F.count(F.lit(1)), F.sum("size"), QUERIES).alias("slices"))
    sliced = asked.drop("size").join(slices, "block").withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(1)), "slices"))
    spread = blocks.select("doc_id", "block").join(slices, "block").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))

    rough = sets_of(texts, blocks.select("doc_id").unionByName(asked.select("doc_id")).unionByName(ends_of(single)), n, rough=True)
    open_to = stored(qualifying(sliced, spread, rough, percent), "qualifying")
    close = stored(possible(single, rough, percent), "close-pairs")
    discard(rough)
    sets = sets_of(texts, open_to.select("doc_id").unionByName(ends_of(close)), n)
    links = opened(open_to.where("asks"), open_to.where("not asks"), sets, percent)
    return stored(links.unionByName(verified(close, sets, percent)), "links")


def families(alone: DataFrame) -> DataFrame:
    """doc_id, unit: of documents (doc_id, keys) those that share a key with several others, each under its most common key."""
    keyed = alone.select("doc_id", F.explode("keys").alias("key"))
    held = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") >= FAMILY)
    chosen = stored(keyed.join(held, "key").groupBy("doc_id").agg(F.max(F.struct("held", "key"))["key"].alias("key")), "families")
    names = chosen.groupBy("key").agg(F.min("doc_id").alias("unit"), F.count(F.lit(1)).alias("held")).where("held > 1")
    return chosen.join(names, "key").select("doc_id", "unit")


def similar_groups(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Components of documents whose sets of distinct ``n``-word shingles have a Jaccard similarity of ``percent`` or more.

    Words are runs of anything but six ASCII blanks, A-Z lower-cased.  A text
    with fewer words than ``n`` has its whole sequence as its one shingle; null
    and empty texts have none and are linked with nothing.  Returns doc_id,
    n_shingles and component_id (the least doc_id reachable by links): one row
    per row of ``docs``.  Rows with one doc_id are one document; a row without a
    doc_id is linked with nothing and has a null component_id.  Other columns
    don't matter; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body"))
    nameless = texts.where("doc_id is null")
    texts = texts.where("doc_id is not null")
    whole = stored(described(texts, n, percent), "described")
    every = stored(whole.drop("prefix"), "documents")
    full = every.where("size > 0")
    # Stored, so that the join below reads both sides plainly and a hot signature can be split.
    equal = stored(full.groupBy("signature").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held"), "equal-sets")
    copies = stored(full.select("doc_id", "signature").join(equal, "signature").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct(), "copies")
    # Copies need not be asked again; their set is asked under the least of them.
    asked = full.join(copies.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_anti").select("doc_id", "size", "keys", "least")

    pairs = stored(leader_pairs(asked), "leader-pairs")
    sets = sets_of(texts, ends_of(pairs), n)
    near = stored(verified(pairs, sets, percent), "leader-links")
    discard(sets)
    labels = connected(copies.unionByName(near))
    # Documents by themselves (copies don't count) may still belong to a family.
    own = asked.groupBy("doc_id").agg(F.max("size").alias("size"), F.max("keys").alias("keys"))
    clusters = own.join(labels, F.col("doc_id") == F.col("node"), "left").select("doc_id", "size", "keys", F.coalesce("component", "doc_id").alias("unit"))
    clusters = stored(clusters, "clusters")
    several = clusters.groupBy("unit").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("unit")
    kin = stored(families(clusters.join(several, "unit", "left_anti")).withColumnRenamed("unit", "family"), "kin")
    units = stored(clusters.join(kin, "doc_id", "left").select("doc_id", "size", F.coalesce("family", "unit").alias("unit"), F.col("family").isNotNull().alias("family")), "units")
    sizes = units.groupBy("unit").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("tokens"), F.max("family").alias("family"))
    sizes = stored(sizes.where("members > 1"), "unit-sizes")
    marked = units.join(sizes.select("unit", F.lit(True).alias("large")), "unit", "left").select("doc_id", "unit", F.coalesce("large", F.lit(False)).alias("large"))
    groups = matrix(whole.where("size > 0"), stored(marked, "marked-units"), copies)
    discard(whole)
    between = links_between(texts, groups, units, sizes, n, percent)
    ends = labels.select(F.col("node"), F.col("component"))
    lifted = between.join(ends.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(ends.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = connected(lifted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = merged.select(F.col("node").alias("merged_node"), F.col("component").alias("merged"))
    out = every.select("doc_id", "size").join(labels, every["doc_id"] == labels["node"], "left").withColumn("unit", F.coalesce("component", "doc_id"))
    out = out.join(merged, out["unit"] == merged["merged_node"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("merged", "unit").alias("component_id"))

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "n_shingles": [len(x) for x in shingle_sets(b["body"], n)], "component_id": pa.nulls(len(b["body"]), pa.int64())}

    return out.unionByName(mapped(nameless, count, "doc_id long, n_shingles long, component_id long"))


def without_similar(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, all columns as they are.

    Each row is a document here, also one whose doc_id is null or repeats.  Of a
    component the row with the least doc_id stays (null comes last, any one of
    rows with the same doc_id).  Null and empty texts are linked with nothing, so
    they stay; an empty table gives an empty table; a column of the name
    ``row_id`` is not allowed.
    """
    rows, odd = with_row_ids(docs)
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if odd is None:
        dropped = similar_groups(texts, **options).where("component_id <> doc_id").select(F.col("doc_id").alias("dropped_id"))
        return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")
    found = stored(similar_groups(texts.unionByName(odd.select(F.col("row_id").alias("doc_id"), "text")), **options), "row-groups")
    names = odd.select("row_id", F.col("doc_id").alias("name"), F.lit(True).alias("odd"))
    named = found.join(names, found["doc_id"] == names["row_id"], "left").withColumn("name", F.when(F.col("odd"), F.col("name")).otherwise(F.col("doc_id")))
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("name").isNull(), F.col("name"), F.col("doc_id")))["doc_id"].alias("kept_id"))
    dropped = stored(found.join(kept, "component_id").where("doc_id <> kept_id").select(F.col("doc_id").alias("dropped_id")), "dropped-rows")
    rows = rows.join(dropped, rows["doc_id"] == dropped["dropped_id"], "left_anti")
    return rows.unionByName(odd.join(dropped, odd["row_id"] == dropped["dropped_id"], "left_anti").drop("row_id"))


#: Links by the definition; components by the least doc_id of what is reachable.
ORACLE_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END) AS s FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a AS doc_id, a AS least FROM links UNION SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.least < l.b)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(min(least), t.doc_id), t.doc_id)::BIGINT AS component_id
FROM texts t LEFT JOIN sizes USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY t.doc_id, n
"""
