import random
import re
import struct
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from factloom.llm import decontamination, mixing, ngram_join, queries, token_files, toxicity
from test_operators import brute_components, brute_edits, brute_targets

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect_on_what_is_left(spark):
    docs = queries.table(spark, SMALL, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in docs.collect()}
        judged = docs
        docs = corpus_pipeline.common.stored(stage(spark, docs, SMALL), name)
        after = [r.doc_id for r in docs.collect()]
        kept[name] = after
        assert set(after) <= before
        if name != "token_files":
            assert docs.columns == columns
        if name == "toxicity":
            gone = {r.doc_id for r in toxicity.score_toxicity(judged, queries.table(spark, SMALL, "labels")).where("predicted = 1").collect()}
            assert before - set(after) == gone
        if name == "near_duplicates":
            groups = {r.doc_id: r.component_id for r in ngram_join.similar_groups(judged).collect()}
            assert set(after) == set(groups.values())
        if name == "decontamination":
            gone = {r.doc_id for r in decontamination.find_contamination(judged, queries.table(spark, SMALL, "benchmark")).collect()}
            assert before - set(after) == gone
        if name == "mixing":
            plan = {r.doc_id: (r.taken, r.size) for r in mixing.mix_sources(judged).collect()}
            assert all(after.count(d) == (int(taken / size + 0.5) if size else 1) for d, (taken, size) in plan.items())
    assert sorted(kept["mixing"]) == sorted(kept["token_files"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, docs.collect()))


def brute_toxic(rows, labels):
    """doc_ids that the nearest labelled rows call toxic, by dense vectors."""
    trained = [k for k in sorted(labels) if zlib.crc32(str(k).encode()) % 5]
    y = np.array([labels[k] for k in trained])

    def counts(text):
        out = Counter()
        for w in re.findall(r"\w+", text.lower()):
            out[w] += 1
        return out

    held = {d: counts(t) for d, t in rows}
    every = sorted(set().union(*(held[k] for k in trained)))
    n = np.array([[c[f] for f in every] for c in held.values()], float)
    own = n[[list(held).index(k) for k in trained]] > 0
    one, zero = own[y == 1].sum(0), own[y == 0].sum(0)
    n1, n0 = (y == 1).sum() + 1, (y == 0).sum() + 1
    pooled = (one + zero + 1) / (n1 + n0)
    relevance = 1 + abs((one + 0.5) / n1 - (zero + 0.5) / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n1 + 1 / n0))
    w = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * (np.log((1 + len(n)) / (1 + (n > 0).sum(0))) + 1) * relevance
    w /= np.maximum(np.sqrt((w**2).sum(1, keepdims=True)), 1e-12)
    row = {d: k for k, d in enumerate(held)}
    cosines = w @ w[[row[k] for k in trained]].T

    def vote(d, without=None):
        near = sorted((-round(float(c), 9), k) for k, c in enumerate(cosines[row[d]]) if c > 0 and trained[k] != without)[:16]
        return (sum(c * c * y[k] for c, k in near) + 0.5 * y.mean()) / (sum(c * c for c, _ in near) + 0.5)

    a, b = toxicity.logistic(np.array([vote(k, k) for k in trained]), y.astype(float), np.ones(len(y)))
    return {d for d in held if a + b * np.log((v := vote(d)) / (1 - v)) >= 0}


def test_stages_equal_brute_force(spark, tmp_path):
    rnd = random.Random(12)
    prose = lambda n: [f"word{rnd.randrange(400)}" for _ in range(n)]
    texts = {k: prose(60) + ([f"vile{rnd.randrange(4)}" for _ in range(8)] if k % 4 == 0 else []) for k in range(60)}
    items = {k: [f"item{k}x{j}" for j in range(30)] for k in range(4)}
    texts |= {100 + k: ["changed", *texts[4 * k + 1][1:]] for k in range(6)}
    texts |= {200 + k: prose(20) * (k % 2) + items[k][:9] + items[k][10 : 28 + k] for k in range(4)}
    texts |= {300 + k: prose(25) + items[k][:12] for k in range(4)}
    rows = [(d, " ".join(w), f"s{d % 3}") for d, w in texts.items()]
    labels = {k: int(k % 4 == 0) for k in range(60)}
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    left = [(d, t) for d, t, _ in rows]
    docs = queries.table(spark, folder, "documents")
    source = {d: s for d, _, s in rows}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.common.stored(stage(spark, docs, folder), name)
        found = sorted(r.doc_id for r in docs.collect())
        if name == "toxicity":
            gone = brute_toxic(left, labels)
            assert len(gone) >= 10
        elif name == "near_duplicates":
            gone = {d for d, _, c in brute_components(left) if d != c}
            assert len(gone) >= 5
        elif name == "decontamination":
            gone = {d for d, t in left for w in items.values() if brute_edits(w, t.split()) <= int(0.2 * len(w))}
            assert len(gone) == 4
        else:
            size = {d: len(t.split()) for d, t in left}
            sizes = Counter()
            for d, n in size.items():
                sizes[source[d]] += n
            for s, target in brute_targets(sizes).items():
                assert abs(sum(size[d] for d in found if source[d] == s) - target) <= max(size.values())
            break
        left = [(d, t) for d, t in left if d not in gone]
        assert found == sorted(d for d, _ in left), name
    library = token_files.Encoder(queries.byte_bpe()).library
    start, expected = 0, []
    for d in found:
        ids = [*library.encode(dict(left)[d], add_special_tokens=False).ids, 0]
        expected.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(expected)


LONG = " ".join(f"long{k % 7919}x{k // 7919}" for k in range(100_000))


def test_stages_take_awkward_rows(spark):
    """Nulls, repeated rows and ids, empty and very long texts, extra columns; empty tables."""
    item = queries.table(spark, SMALL, "benchmark").orderBy("item_id").first().text
    toxic = queries.table(spark, SMALL, "documents").join(queries.table(spark, SMALL, "labels").where("toxic = 1"), "doc_id").orderBy("doc_id").first().text
    own = [(1, "a b c d e f g"), (1, "another text with this id"), (2, None), (2, None), (3, ""), (None, item), (None, "harmless and without an id"), (4, LONG), (5, item), (5, "harmless with an id that repeats"), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, body string, row array<string>"
    docs = spark.createDataFrame([(d, t, None, None if k % 2 else "s", None, "clash", ["x"]) for k, (d, t) in enumerate(own)], schema)
    assert len(LONG) > 1 << 20
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        if name == "token_files":
            rows = out.collect()
            assert len(rows) == len(own) and sorted(r.doc_id for r in rows if r.doc_id) == [1, 1, 2, 2, 3, 4, 5, 5]
            continue
        assert out.columns == docs.columns
        left = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        gone = {"decontamination": [(None, item), (5, item)], "near_duplicates": [(None, item)]}.get(name, [])
        if name == "mixing":
            assert set(left) <= set(own)
        else:
            assert left == sorted([x for x in own if x not in gone], key=repr), name
    mixed = spark.createDataFrame([(None, toxic), (None, "harmless"), (7, toxic), (7, "harmless too")], "doc_id long, text string").union(queries.table(spark, SMALL, "documents").select("doc_id", "text"))
    left = {r.text for r in toxicity.without_toxic(mixed, queries.table(spark, SMALL, "labels")).collect()}
    assert {"harmless", "harmless too"} <= left
