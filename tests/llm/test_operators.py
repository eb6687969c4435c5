"""Each operator against brute force, a round trip or SQL, with the awkward rows that it must take."""

import hashlib
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import common, decontamination, exact_dedup, mixing, ngram_join, pii, queries, substring_dedup, token_counts, token_files, toxicity, warc
from factloom.llm.common import batch_word_hashes, fixed_filter, gram_hashes, passes
from factloom.llm.components import connected
from oracle import check

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, unit string, size long"


def long_text(seed, n=3000):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(500)}" for _ in range(n))


BASE = " ".join(f"b{k}" for k in range(120))
NEAR = " ".join(["x0", "x1", *BASE.split()[2:]])
ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, NEAR), (4, ""), (5, None), (6, " \n\t"), (7, "one two"), (8, "One TWO"), (9, long_text(1)), (10, long_text(1) + " end"),
    (11, long_text(2)), (12, "é 中 \U0001f600 +49 170 1234567 a@b.co 4111 1111 1111 1111, 10.0.0.1"), (None, BASE), (None, None), (13, "same " * 60), (14, "k " + BASE + " " + long_text(3, 50)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, "clash", "clash", k) for k, (d, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name], SMALL)


# Shared parts


def test_gram_hashes_tell_sequences_apart():
    words = np.random.default_rng(0).integers(0, 4, 300).astype(np.uint64)
    for n in (1, 2, 5, 18, 35):
        known = {}
        grams = gram_hashes(words, n)
        assert len(grams) == 301 - n
        for k, g in enumerate(grams.tolist()):
            assert known.setdefault(tuple(words[k : k + n].tolist()), g) == g
        assert len(set(known.values())) == len(known)


def test_fixed_filter_misses_nothing(spark):
    bitmap = fixed_filter(spark.range(1000).select((F.col("id") * 7919).alias("v")))
    inside = (np.arange(1000) * 7919).astype(np.uint64)
    assert passes(bitmap, inside).all()
    assert passes(bitmap, inside + np.uint64(1)).mean() < 0.1
    assert not passes(fixed_filter(spark.range(0).select(F.col("id").alias("v"))), inside).any()


def test_components_of_random_graphs(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(40)]
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = connected(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {v: c for v, c in label.items() if any(a != b and v in (a, b) for a, b in edges)}


# 1


def brute_edits(item, words):
    row = [0] * (len(words) + 1)
    for i, w in enumerate(item, 1):
        step = [i]
        for j, x in enumerate(words, 1):
            step.append(min(row[j - 1] + (w != x), row[j] + 1, step[-1] + 1))
        row = step
    return min(row)


def test_contamination_equals_brute_force_where_it_is_exact(spark, docs, empty):
    rnd = random.Random(7)
    items = [(k, " ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(12, 50)))) for k in range(30)] + [(90, ""), (91, None), (92, "Solo")]
    held = [(100 + k, f"{long_text(k, 40)} {t.upper()}! {long_text(k + 50, 40)}") for k, t in items[:30]] + [(200, "so solo, so far"), (None, items[0][1])]
    df = spark.createDataFrame(held, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    found = got(decontamination.find_contamination(df, bench), "doc_id", "item_id", "edits")
    assert {(100 + k, k, 0) for k in range(30)} | {(200, 92, 0), (None, 0, 0)} <= set(found)
    texts = dict(held)
    for d, k, e in found:
        words, item = ([w.lower() for w in decontamination.WORDS(t)] for t in (texts[d], dict(items)[k]))
        assert e == brute_edits(item, words) <= int(0.2 * len(item))
    assert found == got(decontamination.find_contamination(df, bench, block_bytes=500), "doc_id", "item_id", "edits")
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert decontamination.find_contamination(df, bench.limit(0)).count() == 0
    assert decontamination.decontaminated(docs, bench).count() == len(ROWS)


@pytest.mark.parametrize(("rate", "least"), [(0.0, 1.0), (0.1, 0.97), (0.2, 0.9)])
def test_recall_over_edited_items(rate, least):
    rnd = random.Random(3)
    items = [(k, " ".join(f"w{int(rnd.paretovariate(0.6)) % 3000}" for _ in range(rnd.randrange(15, 60)))) for k in range(200)]
    index = decontamination.Items(items)
    lists = []
    for words in index.words:
        x = words.tolist()
        for _ in range(int(rate * len(words))):
            at, kind = rnd.randrange(len(x)), rnd.randrange(3)  # a word is changed, lost or added
            x[at : at + (kind < 2)] = [] if kind == 1 else [rnd.randrange(3000, 6000)]
        noise = [rnd.randrange(3000) for _ in range(80)]
        lists.append(noise[:40] + x + noise[40:])
    bounds = np.cumsum([0, *map(len, lists)])
    found = index.matches(np.array(sum(lists, [])), np.repeat(np.arange(len(lists)), np.diff(bounds)), bounds)
    assert np.mean([(k, k) in found for k in range(len(lists))]) >= least


@pytest.mark.parametrize("before", [0, 40])
@pytest.mark.parametrize(("rate", "least"), [(0.0, 1.0), (0.1, 0.97), (0.2, 0.9)])
def test_recall_over_items_that_end_a_text_and_lost_words(rate, least, before):
    """Items that are the whole text or end it, with one deletion at least."""
    rnd = random.Random(9)
    items = [(k, " ".join(f"w{int(rnd.paretovariate(0.6)) % 3000}" for _ in range(rnd.choice((15, 20, 26, 35, 48, 55))))) for k in range(200)]
    index = decontamination.Items(items)
    lists = []
    for words in index.words:
        x = words.tolist()
        for _ in range(max(1, int(rate * len(words))) if rate else 0):
            del x[rnd.randrange(len(x))]
        lists.append([rnd.randrange(3000) for _ in range(before)] + x)
    bounds = np.cumsum([0, *map(len, lists)])
    found = index.matches(np.array(sum(lists, [])), np.repeat(np.arange(len(lists)), np.diff(bounds)), bounds)
    assert np.mean([(k, k) in found for k in range(len(lists))]) >= least


def test_contamination_of_a_short_whole_text(spark):
    item = " ".join(f"i{k}" for k in range(48))
    df = spark.createDataFrame([(k, " ".join(w for j, w in enumerate(item.split()) if j != k)) for k in range(48)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert got(decontamination.find_contamination(df, bench), "doc_id", "item_id", "edits") == sorted([(k, 1, 1) for k in range(48)], key=repr)


# 2


def brute_components(rows, percent=75):
    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    label = {d: d for d, _ in sets}
    links = [(d, e) for d, x in sets for e, y in sets if x & y and 100 * len(x & y) >= percent * len(x | y)]
    for _ in sets:
        for d, e in links:
            label[d] = label[e] = min(label[d], label[e])
    return sorted([(d, len(x), label[d]) for d, x in sets] + [(None, len(shingles(t)), None) for d, t in rows if d is None], key=repr)


def test_ngram_join_equals_brute_force(spark, docs, empty):
    assert got(ngram_join.similar_groups(docs), "doc_id", "n_shingles", "component_id") == brute_components(ROWS)
    assert ngram_join.similar_groups(empty).count() == 0


def test_ngram_join_of_a_hot_family(spark, monkeypatch):
    """One large group of near copies, some at the edge of the threshold, with blocks far smaller than it."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "QUERIES", 4)
    rnd = random.Random(5)
    base = [f"h{k}" for k in range(90)]
    rows = []
    for d in range(160):
        words = base.copy()
        for _ in range(rnd.choice((0, 1, 1, 2, 2, 3))):
            words[rnd.randrange(90)] = f"n{rnd.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.similar_groups(df), "doc_id", "n_shingles", "component_id") == brute_components(rows)
    kept = ngram_join.without_similar(df)
    assert kept.count() == len({c for _, _, c in brute_components(rows)})


def test_word_hashes_tell_crafted_words_apart(spark):
    """Thue-Morse words collide under any polynomial modulo a power of two."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    long = ["x" * n for n in range(1, 140)] + ["y" * 8 + "x" * n for n in range(1, 140)]
    hashes, bounds = batch_word_hashes([" ".join([word, other, *long]).encode(), b"", (word + " \n").encode()])
    assert len(set(hashes[:-1].tolist())) == 2 + len(long) and hashes[-1] == hashes[0] and bounds.tolist() == [0, 280, 280, 281]
    rows = [(1, f"{word} " * 40), (2, f"{other} " * 40)]
    assert got(ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "component_id") == [(1, 1), (2, 2)]


@pytest.mark.parametrize("kind", ["shared middle", "subsets"])
def test_ngram_join_of_families_under_the_threshold(spark, monkeypatch, kind):
    """Rows that meet in the token join grow in proportion to such a family, not with its square."""
    met = []
    real = ngram_join.candidate_units

    def counted(groups, percent):
        met.append(groups.groupBy("token").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] or 0)
        return real(groups, percent)

    monkeypatch.setattr(ngram_join, "candidate_units", counted)
    sizes = (200, 400, 800)
    for size in sizes:
        rnd = random.Random(size)
        base = [f"c{k}" for k in range(200)]
        rows = []
        for d in range(size):
            if kind == "shared middle":
                words = [*base[:160], *(f"u{d}x{k}" for k in range(40))]
            else:  # most of the words, in blocks, so that pairs share most but too few shingles
                words = [w for k in range(0, 200, 20) if rnd.random() < 0.8 for w in base[k : k + 20]] or base
            rows.append((d, " ".join(words)))
        found = got(ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
        if size == 200:
            assert found == brute_components(rows)
    print(kind, met)
    assert met[1] <= 3 * met[0] + 2000 and met[2] <= 3 * met[1] + 2000


def test_near_duplicates_go_row_by_row(spark, docs, empty):
    """Rows with no doc_id, or one that repeats, are judged by their own texts; of a component one row stays."""
    kept = ngram_join.without_similar(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    # BASE (four rows, one without a doc_id) and NEAR are alike, and so are the pairs of short and long texts.
    assert sorted(t or "" for t in texts) == sorted(t or "" for t in ["", None, " \n\t", None, BASE, "one two", long_text(1), long_text(2), ROWS[12][1], "same " * 60, "k " + BASE + " " + long_text(3, 50)])
    assert [r.doc_id for r in kept.collect() if r.text == BASE] == [1]
    assert ngram_join.without_similar(empty).count() == 0
    plain = docs.where("doc_id > 2")
    assert sorted(r.doc_id for r in ngram_join.without_similar(plain).collect()) == [3, 4, 5, 6, 7, 9, 11, 12, 13, 14]


# 3


def test_block_max_neighbours_equal_brute_force():
    rnd = random.Random(2)
    vectors = [{rnd.randrange(40): rnd.randint(1, 4) for _ in range(rnd.randrange(6))} for _ in range(700)]
    index = toxicity.BlockMaxIndex(vectors, np.linspace(1, 3, 40), list(range(700)), [rnd.randint(0, 1) for _ in vectors])
    dense = index.weights.T[: len(index.ids)].astype(float)
    for q in vectors[:60]:
        features, weights = index.unit(q)
        cosines = dense[:, features] @ weights if len(features) else np.zeros(len(dense))
        expected = sorted((-round(float(c), 6), k) for k, c in enumerate(cosines) if c > 0)[:16]
        near = index.nearest(q, 16)
        assert [round(c, 6) for c, _ in near] == pytest.approx([-c for c, _ in expected], abs=2e-6)


def test_toxicity_scores(spark, docs, empty):
    rnd = random.Random(1)
    rows = [(k, " ".join([f"w{rnd.randrange(50)}" for _ in range(30)] + (["vilest"] * 2 if k % 4 == 0 else []))) for k in range(400)]
    labels = spark.createDataFrame([(k, None, int(k % 4 == 0)) for k, _ in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.score_toxicity(df.unionByName(docs.where("doc_id is null or doc_id > 3").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text")), labels).collect()
    assert len(found) == 400 + len([d for d, _ in ROWS if d is None or d > 3])
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == int(r.doc_id % 4 == 0)
        else:
            assert r.predicted == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(df, labels.limit(0)).collect()} == {0}


def test_toxicity_uses_every_word_and_example(spark):
    """Words that hardly tell the labels apart, and words of one example, make vectors too: each text's nearest example is its own copy."""
    rnd = random.Random(11)
    rows = [(k, " ".join([f"solo{k}x", *(f"w{rnd.randrange(60)}" for _ in range(20))])) for k in range(60)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    df = spark.createDataFrame(rows + [(1000 + k, t) for k, t in rows], "doc_id long, text string")
    evidence = {r.doc_id: r.evidence for r in toxicity.score_toxicity(df, labels).collect()}
    trained = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5]
    vectors = {k: set(t.split()) for k, t in rows}
    every = sorted(set().union(*(vectors[k] for k in trained)))
    n1 = sum(k % 4 == 0 for k in trained) + 1
    n0 = len(trained) + 2 - n1
    idf = {}
    for f in every:
        a, b = (sum(f in vectors[k] for k in trained if (k % 4 == 0) == y) for y in (True, False))
        pooled = (a + b + 1) / (n1 + n0)
        relevance = 1 + abs((a + 0.5) / n1 - (b + 0.5) / n0) / (max(pooled * (1 - pooled), 1e-9) * (1 / n1 + 1 / n0)) ** 0.5
        idf[f] = (np.log((1 + 120) / (1 + 2 * sum(f in v for v in vectors.values()))) + 1) * relevance

    def weights(k):
        counts = {}
        for w in dict(rows)[k].split():
            counts[w] = counts.get(w, 0) + 1
        v = np.array([(1 + np.log(counts[f])) * idf[f] if f in counts else 0.0 for f in every])
        return v / np.sqrt((v**2).sum())

    dense = {k: weights(k) for k, _ in rows}
    for k, _ in rows:
        expected = sorted(((-round(float(dense[k] @ dense[e]), 6), e) for e in trained))[:16]
        for d in (k, 1000 + k):
            assert [round(x.cosine, 6) for x in evidence[d]] == pytest.approx([-c for c, _ in expected], abs=2e-6)
        if k in trained:
            assert evidence[1000 + k][0].doc_id == k and evidence[1000 + k][0].cosine == pytest.approx(1)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    scored = toxicity.score_toxicity(queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels"))
    held = scored.where("held_out").join(queries.table(spark, folder, "labels"), "doc_id")
    r = held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")).alias("accuracy"), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")).first()
    assert r.accuracy > 0.96 and r.recall > 0.9 and r.wrong < 0.02


def test_words_are_counted_once_for_many_texts():
    texts = ["A b a_1 a_1", "", "Éa—éA ΑΣ, ΑΣΑ İx ǅ ²x ٣٤ 中文。日本", "\x00\U0001f600 x\U00010400y \u0301e e\u0301", "a\nb\u2028c\x1cd", "...", "unknown b"] * 3 + [chr(c) + "x" for c in range(1, 0x3000, 7)]
    names = sorted({w for t in texts for w in toxicity.WORDS(t.lower())} - {"unknown"})
    features = toxicity.Features(names)

    def told(first, bounds, held, times):
        return [{names[f]: n for f, n in zip(held[a:b].tolist(), times[a:b].tolist(), strict=True)} for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    expected = [{w: k for w, k in Counter(toxicity.WORDS(t.lower())).items() if w != "unknown"} for t in texts]
    assert told(0, *features.vectors(texts)) == expected
    at = 0
    for part in features.parts(texts):
        assert part[0] == at and len(part[1]) - 1 <= toxicity.SEARCHED
        assert told(*part) == expected[at : at + len(part[1]) - 1]
        at += len(part[1]) - 1
    assert at == len(texts)

    class Watched(dict):
        looked = 0

        def get(self, *a):
            Watched.looked += 1
            return super().get(*a)

        def __getitem__(self, word):
            Watched.looked += 1
            return super().get(word, -1)

    features.ids = Watched(features.ids)
    features.vectors(["a b unknown a_1"] * 40)
    assert Watched.looked == 4


# 4


def test_exact_dedup(spark, docs, empty):
    groups = {}
    for d, t in ROWS:
        groups.setdefault(t or "", []).append(d)
    expected = []
    for d, t in ROWS:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        expected.append((d, keep, len(groups[t or ""]), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got(exact_dedup.exact_dedup(docs), *columns) == sorted(expected, key=repr)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_dedup_tells_clashing_digests_apart(spark, docs, monkeypatch):
    """With a digest of three values, texts still differ by content."""
    real = exact_dedup.exact_dedup(docs)
    expected = got(real, "doc_id", "keep_id", "group_size", "kept")
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: F.pmod(F.xxhash64(c), F.lit(3)).cast("string"))
    assert got(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept") == expected


# 5


def test_token_counts_equal_the_tokenizer(spark, docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.zipf_vocabulary(token_files.vocabulary_path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = token_counts.Counter(vocabulary)
    rnd = random.Random(8)
    bits = ["a", "the", " ", "  ", "▁", "<unk>", "<0x0A>", "\n", "é", "中", "\U0001d518", "\U0001f600", "ing", "tion", "1", ".", "<", ">", "unk"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(15))) for _ in range(1500)]
    assert [counter.text(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    expected = sorted(((d, len(library.encode(t or "").ids)) for d, t in ROWS), key=repr)
    found = token_counts.count_tokens(docs, lambda: vocabulary)
    assert got(found, "doc_id", "n_tokens") == expected
    assert token_counts.count_tokens(empty, lambda: vocabulary).count() == 0


def test_token_count_ties_keep_the_first_start():
    counter = token_counts.Counter([("<unk>", -20.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("▁aa", -3.0)])
    assert counter.text("aa") == 1  # equal scores: the candidate with the earliest start came first


# 6


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok(m.group())] for k, (p, ok) in kinds.items()}


def test_personal_data_equals_the_patterns(spark, docs, empty):
    rnd = random.Random(5)
    bits = [*"a1234@.+-() ", "x.y", "10.0.0.1", "a@b.c", "+12 345 6789", "4111111111111111", "255.", "é"]
    anchors = pii.automaton()
    for text in ["".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(5000)] + [t or "" for _, t in ROWS]:
        found = pii.find_spans(text, anchors)
        assert {k: found[k] for k in pii.BASE} == brute_spans(text)
    rows = {r.doc_id: r for r in pii.find_personal_data(docs.where("doc_id is not null")).collect()}
    assert rows[12].values == ["a@b.co", "10.0.0.1", "4111 1111 1111 1111", "+49 170 1234567"] and rows[5].spans == ""
    assert pii.find_personal_data(empty).count() == 0


def test_added_spans_are_validated():
    anchors = pii.automaton()
    found = pii.find_spans("https://me:pw@host/ IBAN DE89 3704 0044 0532 0130 00, IBAN DE00 3704 0044 0532 0130 00 account no: 12345678", anchors)
    assert (len(found["login"]), len(found["iban"]), len(found["account"])) == (1, 1, 1)


# 7


def test_token_files(spark, docs, empty, tmp_path):
    path = queries.byte_bpe()
    library = token_files.Encoder(path).library
    texts = sorted(((d, t or "") for d, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start, expected = 0, []
    for d, t in texts:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        expected.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    folder = f"file://{tmp_path}/tokens"
    assert got(token_files.token_table(docs, queries.byte_bpe, path=folder), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=repr)
    one = token_files.read_token_files(spark, folder, [7], ["token_ids"])
    assert one.first().token_ids == [*library.encode("one two", add_special_tokens=False).ids, 0]
    assert token_files.token_table(empty, queries.byte_bpe).count() == 0
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(next(p for p in (tmp_path / "tokens").glob("*.parquet") if pq.ParquetFile(p).metadata.num_rows)).metadata.row_group(0)
    columns = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["token_ids.list.element"].has_dictionary_page
    assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index


def test_encoder_equals_the_library():
    encoder = token_files.Encoder(queries.byte_bpe())
    rnd = random.Random(1)
    bits = [" ", " ", "  ", "\n", "\t", " \n", "a", "B", "é", "1", "23", "'s", "'", ".", "!?", "中", "\U0001f600", "x" * 70, "<|endoftext|>", "\x1f", "​", "_", "word,", "Foo."]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(3000)]
    expected = encoder.library.encode_batch(texts, add_special_tokens=False)
    for at in range(0, len(texts), 64):
        for k, ids in enumerate(encoder.ids(texts[at : at + 64])):
            assert ids.tolist() == expected[at + k].ids


def test_encoder_learns_words_once_whatever_stands_behind(monkeypatch):
    encoder = token_files.Encoder(queries.byte_bpe())
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeéñß") for _ in range(7)) for _ in range(300)] + ["12", "中a", "a中", "it's", "…", "«a»", "xª", "ɏ", "×"]
    behind = ["", "", ",", ".", "!?", "'", "...", ")", "\nNext", ".\nNext", "\n", "\n\n", " \n", "  ", "\t", "\n1.", "\n's"]
    texts = [" ".join(rnd.choice(words) + rnd.choice(behind if k % 2 else behind[:10]) for _ in range(rnd.randrange(60))) for k in range(2000)]
    expected = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    ended = [f"{w}{b}" for w in words[:300] for b in behind[:8]]
    assert [x.tolist() for x in encoder.ids([" ".join(ended)])] == [encoder.library.encode(" ".join(ended), add_special_tokens=False).ids]
    assert len(encoder.known) <= 302
    assert [x.tolist() for x in encoder.ids(texts)] == expected
    monkeypatch.setattr(token_files.Encoder, "MOST", 100)
    monkeypatch.setattr(token_files.Encoder, "MOST_IDS", 200)
    small = token_files.Encoder(queries.byte_bpe())
    for at in range(0, len(texts), 50):
        assert [x.tolist() for x in small.ids(texts[at : at + 50])] == expected[at : at + 50]
        assert len(small.known) <= 100 and small.used <= 200


# 8


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    open_, target, total = set(order), {}, sum(sizes.values())
    while open_:
        share = {s: total * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            total -= 3 * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, docs, seed):
    rnd = random.Random(seed)
    rows = [(k, " ".join(["w"] * rnd.randrange(40)), rnd.choice(["a", "a", "a", "b", "c", "d", None] if seed else ["z"])) for k in range(300)]
    rows += [(5, "w w", "a"), (5, "w w", "a"), (None, "w", "b"), (301, None, "e"), (302, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bucket", F.lit("clash"))
    found = mixing.mix_sources(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = brute_targets(sizes)
    assert len(found) == len(rows)
    for s, n in sizes.items():
        mine = [r for r in found if r.source == s]
        assert {r.source_size for r in mine} == {n}
        assert all(r.target == pytest.approx(targets[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - targets[s]) <= 0.5
        assert all(r.taken <= 3 * r.size for r in mine)
    key = lambda x: sorted(map(repr, x))
    assert key(found) == key(mixing.mix_sources(df.repartition(7)).collect())
    assert mixing.mix_sources(df.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.where("doc_id is null").count() == 2


# 9


def brute_removed(rows, window):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    starts = {}
    for k, words in enumerate(lists):
        for at in range(len(words) - window + 1):
            starts.setdefault(tuple(words[at : at + window]), []).append((k, at))
    gone = [set() for _ in rows]
    for places in starts.values():
        if len(places) > 1:
            for k, at in places:
                gone[k] |= set(range(at, at + window))
    return sorted(((d, len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for (d, _), w, g in zip(rows, lists, gone, strict=True)), key=repr)


@pytest.mark.parametrize("window", [35, 6])
def test_substring_dedup(spark, docs, empty, window):
    rnd = random.Random(window)
    passage = [f"p{k}" for k in range(55)]
    rows = ROWS + [(50 + k, " ".join([f"q{rnd.randrange(9)}" for _ in range(20)] + passage[k:] + [f"q{rnd.randrange(9)}" for _ in range(20)])) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit(0)).withColumn("starts", F.lit(0))
    assert got(substring_dedup.substring_dedup(df, window), "doc_id", "n_words", "n_removed", "kept_text") == brute_removed(rows, window)
    assert substring_dedup.substring_dedup(empty, window).count() == 0


def shuffled_bytes(spark):
    """What all stages so far have written to shuffles."""
    jvm, context = spark._jvm, spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_substring_dedup_compares_copies_by_stretches(spark):
    rnd = random.Random(10)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.randrange(30, 400))) for _ in range(200)]
    rows = [(1000 * copy + k, t) for copy in range(2) for k, t in enumerate(texts)]
    # Parts of copies, so that stretches are cut at either side, and copies with other words in between.
    rows += [(5000 + k, " ".join(t.split()[9 + k % 7 : 200])) for k, t in enumerate(texts[:30])]
    rows += [(6000 + k, " ".join("x" if j % 97 == k else w for j, w in enumerate(t.split()))) for k, t in enumerate(texts[30:60])]
    df = common.stored(spark.createDataFrame(rows, "doc_id long, text string"), "texts")
    before = shuffled_bytes(spark)
    found = got(substring_dedup.substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_text")
    moved = shuffled_bytes(spark) - before
    assert found == brute_removed(rows, 35)
    # A row for each window of a text would be more.
    assert moved < 2 * sum(len(t) for _, t in rows)


def test_substring_dedup_moves_no_text_without_repeats(spark):
    rnd = random.Random(9)
    rows = [(k, " ".join(f"{rnd.getrandbits(200):050x}" for _ in range(80))) for k in range(600)]
    rows += [(1000 + k, f"{k} {rows[0][1]} {k}") for k in range(3)] + [(None, rows[1][1]), (2, rows[2][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = common.stored(df, "texts")
    before = shuffled_bytes(spark)
    found = got(substring_dedup.substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_text")
    moved = shuffled_bytes(spark) - before
    assert found == brute_removed(rows, 35)
    assert moved < 0.25 * sum(len(t) for _, t in rows)


# 10


def test_warc(spark, tmp_path):
    page = "<p>" + "é" * 600
    rows = [(1, "http://a/ü b", page), (2, None, page), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", page), (2, "u", page), (7, "u", "\r\n\r\nContent-Length: 9" * 80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    found = got(warc.warc_round_trip(pages, f"file://{tmp_path}/w", package_bytes=2000), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    expected = []
    for p, _, h in rows:
        body = (h or "").encode()
        revisit = h == page and p != 2
        expected.append((p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert found == sorted(expected, key=repr)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_zip64_directories(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    (made,) = warc.write_packages([(k, "u", b"x" * 300, None, False) for k in range(5)], f"file://{tmp_path}", 1 << 20)
    with open(made[0], "rb") as f:
        assert warc.END64 in f.read()
    fs, _ = warc.filesystem(f"file://{tmp_path}")
    with fs.open_input_file(made[0]) as file:
        records = [warc.parse_record(file.read_at(n, at)) for at, n in warc.record_ranges(file, file.size())]
    assert [h["warc-record-id"] for h, _ in records] == [f"<urn:page:{k}>" for k in range(5)]
    assert all(b.endswith(b"x" * 300) for _, b in records)


def test_reader_refuses_what_it_cannot_range_read(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.DATA, "x")
    fs, _ = warc.filesystem(f"file://{tmp_path}")
    with fs.open_input_file(f"{tmp_path}/z.zip") as file, pytest.raises(ValueError, match="not stored"):
        warc.data_start(file, warc.directory(file, file.size())[0])


def test_driver_gives_memory_back_between_steps(spark):
    jvm = spark._jvm
    lookup = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    lookup.setAccessible(True)
    unsafe = lookup.get(None)
    pid = jvm.java.lang.ProcessHandle.current().pid()

    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", open(f"/proc/{pid}/status").read())[1]) / 1024

    # As after planning and compiling: much that was small is free again, but what came last is still held.
    held = [unsafe.allocateMemory(120_000) for _ in range(1200)]
    for at in held:
        unsafe.setMemory(at, 120_000, 1)
    for at in held[:-1]:
        unsafe.freeMemory(at)
    jvm.System.gc()
    before = resident()
    common._next_give_back = 0.0
    assert common.stored(spark.range(100), "small").count() == 100
    after = resident()
    unsafe.freeMemory(held[-1])
    assert after < before - 90
