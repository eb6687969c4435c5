import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators.model import Attribute, FactSet
from factloom.plans.query import assignments, find, pattern
from factloom.sources import json_facts, ntriples, store
from factloom.streaming.incremental import continuous, pattern_changes


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_ntriples(spark):
    x = '<http://x/s> <http://x/p> '
    got = ntriples.parse(lines(spark, x + r'"a \"q\" \\ é \U0001F600\n" .', x + '"5"^^<http://www.w3.org/2001/XMLSchema#integer> . # note', x + '"hei"@nb .', x + "_:b .", "# comment", "")).collect()
    assert [r.o for r in got] == ['a "q" \\ é 😀\n', "5", "hei", "_:b"]
    facts = ntriples.import_triples(lines(spark, x + '"5"^^<http://www.w3.org/2001/XMLSchema#integer> .', x + '"five" .', x + '"hei"@nb .')).facts
    assert set(facts.attributes) == {"http://x/p^int", "http://x/p^text", "http://x/p^id", "rdf_text", "rdf_lang"}
    assert [r.t for r in find("?t", pattern(facts, ("?s", "http://x/p^id", "?o"), ("?o", "rdf_lang", "nb"), ("?o", "rdf_text", "?t"))).collect()] == ["hei"]
    with pytest.raises(Exception, match="not a triple"):
        ntriples.parse(lines(spark, "nonsense")).collect()


def test_json_objects(spark):
    docs = spark.createDataFrame([('{"n": "x", "tags": ["a", "b"], "in": {"k": 1}, "no": null, "e": []}',), ('[{"k": 1}, {"k": 1.0}]',)], "json string")
    facts, roots = json_facts.import_objects(docs)
    assert roots.count() == 2  # {"k": 1} is one entity, written twice and nested once
    assert sorted(r.v for r in assignments(pattern(facts, ("?e", "tags", "?v"))).df.collect()) == ["a", "b"]
    with pytest.raises(Exception, match="root"):
        json_facts.import_objects(spark.createDataFrame([("5",)], "json string"))


def test_json_tree_is_lossless(spark):
    docs = spark.createDataFrame([('{"a": [1.50, null, true], "b": {"a": "x"}}',)], "json string")
    got = [(r.kind, r.field, r["index"], r.number) for r in json_facts.import_tree(docs).collect()]
    assert ("number", None, 0, "1.50") in got and ("null", None, 1, None) in got and len(got) == 7


def test_json_export_refers_back(spark):
    g = FactSet.from_rows(spark, [Attribute("name", "text"), Attribute("knows", "id", True)], [("a", "name", "A"), ("b", "name", "B"), ("a", "knows", "b"), ("b", "knows", "a")])
    assert json.loads(json_facts.export_object(g, "a")) == {"knows": {"knows": {"$ref": "a"}, "name": "B"}, "name": "A"}


def test_store_round_trip(spark, tmp_path):
    g = FactSet.from_rows(spark, [Attribute("n", "int")], [("a", "n", 1), ("b", "n", 2)])
    store.write_facts(g, f"{tmp_path}/one")
    store.append_facts(g.insert(spark, [("c", "n", 3)]), f"{tmp_path}/one")
    store.compact(spark, f"{tmp_path}/two", f"{tmp_path}/one")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/two/{g.attributes['n'].id}").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert store.read_facts(spark, f"{tmp_path}/one", f"{tmp_path}/two").count() == 3


def test_blobs_keep_what_roots_reach(spark, tmp_path):
    blobs = store.BlobStore(spark, f"{tmp_path}/blobs")
    leaf = blobs.put(spark.createDataFrame([(bytearray(b"leaf"),)], "bytes binary")).first().handle
    root = blobs.put(spark.createDataFrame([(bytearray(bytes(leaf) + b"tail"),)], "bytes binary")).first().handle
    blobs.put(spark.createDataFrame([(bytearray(b"stray"),)], "bytes binary"))
    kept = blobs.keep(spark.createDataFrame([(root,)], "handle binary"), f"{tmp_path}/kept")
    assert {bytes(r.handle) for r in kept.list().collect()} == {bytes(leaf), bytes(root)}


def test_tokenisers(spark):
    df = spark.createDataFrame([("Hello, WORLD — hello. É x_y fooBar2",)], "t string")
    row = df.select(text.words(F.col("t")), text.ngrams(F.lit("Abcd e"), 3), text.code_words(F.lit("fooBar_baz2 = x")), F.size(text.graphemes(F.lit("éa"))), text.before(F.lit("xay"), "a"), text.after(F.lit("xy"), "a"), F.size(text.bigrams(F.lit("one")))).first()
    assert row[0] == ["hello", "world", "hello", "É", "x_y", "foobar2"]
    assert row[1] == ["abc", "bcd", "e"]
    assert row[2] == ["foobar_baz2", "foo", "bar", "baz", "2", "=", "x"]
    assert tuple(row[3:]) == (2, "x", "", 0)


def test_stream_asks_each_batch_for_its_delta(spark, tmp_path):
    schema = "e string, a string, v string"
    attributes = [Attribute("link", "id", True)]
    got = {}
    for k, rows in enumerate([[("a", "link", "b")], [("b", "link", "c"), ("a", "link", "b")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ask = lambda full, delta: find(["?x", "?z"], pattern_changes(full, delta, ("?x", "link", "?y"), ("?y", "link", "?z")))
        continuous(stream, f"{tmp_path}/store", attributes, ask, lambda df, n: got.__setitem__(n, [tuple(r) for r in df.collect()]), f"{tmp_path}/check").awaitTermination()
    assert got == {0: [], 1: [("a", "c")]}


def test_json_arrays_of_any_depth_give_their_members(spark):
    docs = spark.createDataFrame([('{"a": [[[1, 2]], [[[{"c": "x"}]]], []], "b": 3}',)], "json string")
    facts, roots = json_facts.import_objects(docs)
    assert sorted(r.v for r in facts.pairs("a^number").collect()) == [1.0, 2.0]
    assert facts.pairs("a^id").count() == facts.pairs("c").count() == facts.pairs("b").count() == roots.count() == 1
