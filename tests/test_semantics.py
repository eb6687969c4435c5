"""The rules that SQL on the tables doesn't show: multiplicity, errors, sets, registers, increments, paths."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import values
from factloom.functions.text import bigrams_of, words, words_of
from factloom.operators.collection import Collection
from factloom.operators.history import Conflict, Repository
from factloom.operators.model import Attribute, FactSet, entity
from factloom.operators.paths import Automaton, PathIndex, PathSummary, Step, any_but, step
from factloom.operators.registers import ObservationOrder, StatedOrder, Unordered, sole
from factloom.operators.search import BM25Index
from factloom.plans.features import _WORDS
from factloom.plans.query import And, Filter, InRange, Or, assignments, between, count, exists, find, pattern
from factloom.streaming.incremental import pattern_changes

LINK = [Attribute("link", "id", True), Attribute("name", "short_string"), Attribute("size", "int", True)]


def facts(spark, rows):
    return FactSet.from_rows(spark, LINK, rows)


def test_witnesses_multiply_but_the_head_is_a_bag(spark):
    """Two independent witnesses of eight values each give 64 rows for each of 16 entities."""
    rows = [(f"e{k}", a, v) for k in range(16) for w in range(8) for a, v in (("link", f"w{w}"), ("size", w))]
    g = facts(spark, rows)
    bag = find(["?e"], pattern(g, ("?e", "link", "_?w"), ("?e", "size", "_?v")))
    assert (bag.count(), bag.distinct().count()) == (16 * 64, 16)


def test_or_is_a_set_over_its_variables(spark):
    rows = [(f"e{k}", "link", "x") for k in range(10)] + [(f"e{k}", "link", "y") for k in range(8, 12)]
    g = facts(spark, rows)
    assert find(["?e"], Or(pattern(g, ("?e", "link", "x")), pattern(g, ("?e", "link", "y")))).count() == 12


def test_arms_must_bind_the_same_variables(spark):
    g = facts(spark, [("a", "link", "b")])
    with pytest.raises(ValueError):
        find(["?e"], Or(pattern(g, ("?e", "link", "b")), pattern(g, ("?e", "link", "?v"))))


def test_chain_over_a_hub(spark):
    rows = [(f"a{k}", "link", "hub" if k < 200 else f"m{k}") for k in range(210)] + [("hub", "size", 1)] + [(f"m{k}", "size", 1) for k in range(200, 210)]
    assert count(pattern(facts(spark, rows), ("?a", "link", "?b"), ("?b", "size", "?c"))).first()[0] == 210


def test_errors_before_any_job(spark):
    g = facts(spark, [("a", "link", "b")])
    with pytest.raises(ValueError):
        find(["?a", "?a"], pattern(g, ("?a", "link", "?b")))
    with pytest.raises(ValueError):
        find(["?x"], pattern(g, ("?a", "link", "?b")))
    with pytest.raises(TypeError):
        pattern(g, ("?a", "size", "not a number"))
    with pytest.raises(KeyError):
        pattern(g, ("?a", "absent", "?b"))
    with pytest.raises(ValueError):
        assignments(Filter(["?a"], lambda a: a > 1))


def test_self_reference_constants_and_exists(spark):
    g = facts(spark, [("a", "link", "a"), ("a", "link", "b"), ("b", "size", 3)])
    assert [r.s for r in find(["?s"], pattern(g, ("?s", "link", "?s"))).collect()] == ["a"]
    assert find([], pattern(g, ("a", "link", "b"))).count() == 1
    assert find([], pattern(g, ("a", "link", "c"))).count() == 0
    assert exists(pattern(g, ("?s", "size", 3))) and not exists(pattern(g, ("?s", "size", 4)))
    assert find(["?s"], And(pattern(g, ("?s", "link", "?v")), between("?unbound", 1, 2))).count() == 0


triple = st.tuples(st.sampled_from(["a", "b", "c"]), st.just("link"), st.sampled_from(["a", "b", "c", "d"]))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(triple, min_size=1, max_size=8), st.sets(triple, min_size=1, max_size=8))
def test_set_algebra_and_increments(spark, x, y):
    a, b = facts(spark, x), facts(spark, y)
    held = lambda g: {(r.e, "link", r.v) for r in g.pairs("link").collect()}
    assert held(a + b) == x | y and held(a.intersect(b)) == x & y and held(a.difference(b)) == x - y
    chain = (("?p", "link", "?q"), ("?q", "link", "?r"))
    rows = lambda c: sorted(tuple(r) for r in find(["?p", "?q", "?r"], c).collect())
    new = b.difference(a)
    gained = rows(pattern_changes(a + b, new, *chain))
    assert gained == sorted(set(rows(pattern(a + b, *chain))) - set(rows(pattern(a, *chain))))


def test_increment_keeps_multiplicity_and_empty_delta_gives_nothing(spark):
    old = facts(spark, [("shakespeare", "name", "S"), ("hamlet", "link", "shakespeare")])
    new = facts(spark, [("macbeth", "link", "shakespeare"), ("macbeth", "size", 1), ("macbeth", "size", 2)])
    full = old + new
    got = find("?author", pattern_changes(full, new, ("?b", "link", "?a"), ("?a", "name", "?author"), ("?b", "size", "_?n")))
    assert [r.author for r in got.collect()] == ["S", "S"]
    assert find("?b", pattern_changes(full, facts(spark, []), ("?b", "link", "?a"))).count() == 0


def test_registers(spark):
    attributes = [Attribute("of", "id"), Attribute("key", "int"), Attribute("sees", "id", True)]
    g = FactSet.from_rows(spark, attributes, [("s1", "of", "r"), ("s2", "of", "r"), ("s3", "of", "r"), ("s1", "key", 10), ("s2", "key", 20), ("s3", "key", 20), ("s2", "sees", "s1")])
    every = spark.createDataFrame([(s,) for s in ("s1", "s2", "s3", "free")], "state string")
    got = lambda o: sorted(r.state for r in o.resolve(every).collect())
    assert got(StatedOrder(g, "of", "key")) == ["free", "s2", "s3"]
    assert got(StatedOrder(g, "of", "key", tiebreak_by_id=True)) == ["free", "s3"]
    assert got(StatedOrder(g, "of", "key", first=True)) == ["free", "s1"]
    assert got(ObservationOrder(g, "sees")) == ["free", "s2", "s3"]
    assert got(ObservationOrder(g, "sees", first=True)) == ["free", "s1", "s3"]
    assert got(Unordered(g)) == ["free", "s1", "s2", "s3"]
    assert sole(StatedOrder(g, "of", "key"), every.where("state <> 'free'"))[0] == "fork"
    assert sole(StatedOrder(g, "of", "key", first=True), every.where("state <> 'free'")) == ("sole", ["s1"])
    assert sole(Unordered(g), every.limit(0)) == ("empty", [])


def brute_paths(edges, automaton):
    out = set()
    vertices = {v for s, _, d in edges for v in (s, d)}
    for start in vertices:
        seen, todo = set(), [(start, 0)]
        while todo:
            v, p = todo.pop()
            for a, b, s in automaton.transitions:
                for x, label, y in edges:
                    ok = (label in s.labels) != s.excluded
                    u, w = (y, x) if s.backward else (x, y)
                    if a == p and ok and u == v and (w, b) not in seen:
                        seen.add((w, b))
                        todo.append((w, b))
        out |= {(start, v) for v, p in seen if p in automaton.accepting}
    return out | ({(v, v) for v in vertices} if automaton.nullable else set())


EXPRESSIONS = [step("a").plus(), step("a").then(step("b")).star(), step("a").or_(step("b").inverse()).plus(), any_but("a").then(step("a").optional()), step("a").then(step("b").or_(step("c")).star()).inverse()]


@pytest.mark.parametrize("k", range(len(EXPRESSIONS)))
def test_paths_equal_a_walk(spark, k):
    edges = [("u", "a", "v"), ("v", "b", "w"), ("w", "a", "u"), ("v", "a", "v"), ("w", "c", "x"), ("y", "b", "x")]
    df = spark.createDataFrame(edges, "src string, label string, dst string")
    automaton = EXPRESSIONS[k].compile()
    index = PathIndex.from_edges(automaton, df.where("src < 'w'"), df.where("src >= 'w'"))
    assert {(r.start, r.end) for r in index.accepted.collect()} == brute_paths(edges, automaton)


def test_path_errors(spark):
    df = spark.createDataFrame([("u", "a", "v")], "src string, label string, dst string")
    with pytest.raises(ValueError):
        PathIndex.from_edges(step("a"))
    with pytest.raises(ValueError):
        PathSummary.of(step("a").compile(), df).merge(PathSummary.of(step("b").compile(), df))
    with pytest.raises(ValueError):
        Automaton(1, frozenset([0]), frozenset([2]), ((0, 1, Step(("a",))),))


def test_products_of_one_value_are_dealt_over_tasks(spark):
    """Neither side's key is shared, so the result grows with the product: no task may have most of it."""
    rows = spark.range(300).select("id", F.lit("all").alias("v")).coalesce(1)
    g = FactSet().with_table(rows, "a", "id", {"a_v": ("text", "v")}).with_table(rows, "b", "id", {"b_v": ("text", "v")})
    found = find(["?x", "?y"], And(pattern(g, ("?x", "a_v", "?v")), pattern(g, ("?y", "b_v", "?v"))))
    assert found.distinct().count() == found.count() == 300 * 300
    tasks = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(tasks) < 300 * 300 / 3


def test_bm25_repeated_documents_take_the_larger_count(spark):
    docs = spark.createDataFrame([("d", "fox fox"), ("d", "fox den"), ("e", ""), ("f", "the quick brown fox")], "doc string, text string")
    index = BM25Index.build(docs)
    assert {(r.doc, r.term): r.tf for r in index.postings.collect()}[("d", "fox")] == 2
    assert index.statistics().first().docs == 3
    assert {r.doc for r in index.matches(["fox"], 0.0).collect()} == {"d", "f"}


def test_bm25_index_is_kept_and_opened_again(spark, tmp_path):
    docs = spark.createDataFrame([("d", "fox den"), ("e", ""), ("f", "the quick brown fox"), ("g", None)], "doc string, text string")
    built = BM25Index.build(docs, path=f"file://{tmp_path}/index")
    opened = BM25Index.open(spark, f"file://{tmp_path}/index")
    assert sorted(map(tuple, opened.query(["fox", "den"]).collect())) == sorted(map(tuple, built.query(["fox", "den"]).collect()))
    assert {r.doc: r.length for r in opened.lengths.collect()} == {"d": 2, "e": 0, "f": 4, "g": 0}


def shuffled(spark):
    """Bytes that this session has shuffled."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    listed = sc.statusStore().executorList(True)
    return sum(listed.apply(k).totalShuffleWrite() for k in range(listed.size()))


@pytest.mark.parametrize("terms", [words_of, bigrams_of, None], ids=["words", "bigrams", "array"])
def test_bm25_postings_are_not_shuffled(spark, terms):
    """Of documents of one row only ids move: building, merging and asking take less than a byte for each posting."""
    docs = spark.range(200).select(F.col("id").alias("doc"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(500)), lambda k: F.concat(F.lit("w"), F.xxhash64(k, "id").cast("string")))).alias("text"))
    terms, before = terms or words(F.col("text")), shuffled(spark)
    index = BM25Index.build(docs.where("doc < 100"), terms).merge(BM25Index.build(docs.where("doc >= 100"), terms))
    assert index.postings.count() == 200 * (499 if terms is bigrams_of else 500)
    assert index.query(["w1"]).count() == 0
    assert shuffled(spark) - before < 100_000


def test_bm25_merges_documents_of_both(spark):
    one = BM25Index.build(spark.createDataFrame([("d", "fox fox"), ("d", "den"), ("e", ""), ("f", "a b"), (None, "x")], "doc string, text string"))
    two = BM25Index.build(spark.createDataFrame([("d", "fox den den"), ("e", "!"), ("g", "c"), (None, "x y")], "doc string, text string"))
    index = one.merge(two)
    held = [tuple(r) for r in index.postings.collect()]
    assert sorted(held, key=str) == sorted([("d", "fox", 2), ("d", "den", 2), ("f", "a", 1), ("f", "b", 1), ("g", "c", 1), (None, "x", 1), (None, "y", 1)], key=str)
    assert sorted(((r.doc, r.length) for r in index.lengths.collect()), key=str) == sorted([("d", 4), ("e", 0), ("f", 2), ("g", 1), (None, 2)], key=str)
    assert index.statistics().first().docs == 5


def test_bm25_of_arrays_and_of_repeated_terms(spark):
    docs = spark.createDataFrame([(1, ["a", None, "a", "b"]), (2, None), (3, [])], "doc long, w array<string>")
    index = BM25Index.build(docs, F.col("w"))
    assert sorted(map(tuple, index.postings.collect())) == [(1, "a", 2), (1, "b", 1)]
    assert {r.doc: r.length for r in index.lengths.collect()} == {1: 3, 2: 0, 3: 0}
    twice, once = (index.query(t).first().score for t in (["a", "a"], ["a"]))
    assert abs(twice - 2 * once) < 1e-12
    assert index.query([]).count() == 0


#: A sign before a line separator doesn't end its word, in SQL either.
TEXTS = ["", "The end.", "\x0ba\x1cb c", "x!\u2028 y", "\u00a0 \u00e9T\u00c9 \u2167 \u00b2 ...", "\u4f60\u597d, (W0rld)\r\n--\t", "\x1c a-b _ _c_"]


def test_words_of_texts_equal_their_sql(spark):
    import duckdb

    for t in TEXTS:
        expected = duckdb.execute(f"SELECT {_WORDS} FROM (SELECT ?::VARCHAR AS text)", [t]).fetchall()[0][0]
        assert [w.decode() for w in words_of(t.encode())] == expected, t
        assert [w.decode() for w in bigrams_of(t.encode())] == [f"{a}\0{b}" for a, b in zip(expected, expected[1:])]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc long, text string")
    held = {(r.doc, r.term) for r in BM25Index.build(docs).postings.collect()}
    assert held == {(k, w.decode()) for k, t in enumerate(TEXTS) for w in words_of(t.encode())} and (3, "x!\u2028") in held


def test_entities_by_content():
    known = {a.name: a for a in LINK}
    one, rows = entity(known, {"name": "x", "size*": [1, 2], "link?": None})
    two, _ = entity(known, {"size*": [2, 1], "name": "x"})
    other, _ = entity(known, {"name": "x", "size*": [1, 2]}, namespace=b"n" * 32)
    assert one == two != other and len(rows) == 3
    with pytest.raises(TypeError):
        entity(known, {"name": "n" * 40})


def test_pushes_conflict_and_merge(spark, tmp_path):
    r = Repository(spark, f"file://{tmp_path}/repo")
    rows = lambda e: spark.createDataFrame([(e, "name", "x")], "e string, a string, v string")
    r.create_branch("main")
    with pytest.raises(Conflict):
        r.create_branch("main")
    a, b = r.pull("main"), r.pull("main")
    first = a.commit(rows("a"), "a", created_at=dt.datetime(2024, 1, 1))
    second = b.commit(rows("b"), "b", created_at=dt.datetime(2024, 1, 2))
    assert a.try_push() is None and b.try_push() is not None
    b.push()
    head = r.head("main")
    assert {x.id for x in r.parents(r.select(head)).collect()} == {first, second}
    assert {x.e for x in r.checkout(r.ancestors(r.select(head))).collect()} == {"a", "b"}
    assert [x.id for x in r.time_range(dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)).collect()] == [second]
    assert r.unreachable(r.select(first)).count() == 2


def test_commit_ids_tell_sets_apart(spark, tmp_path):
    """Repeated facts don't cancel, order and repeats don't matter, metafacts do."""
    r = Repository(spark, f"file://{tmp_path}/repo")
    when = dt.datetime(2024, 1, 1)
    rows = lambda *e: spark.createDataFrame([(x, "name", "x") for x in e], "e string, a string, v string")
    commit = lambda facts, meta=None: r.write_commit(facts, "m", [], created_at=when, metafacts=meta)
    assert commit(rows("a", "a", "b")) != commit(rows("c", "c", "b"))
    assert commit(rows("a", "b")) == commit(rows("b", "a", "a"))
    assert commit(rows("a"), rows("m")) != commit(rows("a"), rows("n")) != commit(rows("a"))


def test_failures_of_the_file_system_are_no_conflicts(spark, tmp_path):
    (tmp_path / "repo" / "branches").mkdir(parents=True)
    (tmp_path / "repo" / "branches" / "main").write_text("a file where a folder should be")
    r = Repository(spark, f"file://{tmp_path}/repo")
    with pytest.raises(Exception) as e:
        r._set_head("main", 0, None)
    assert not isinstance(e.value, Conflict)


def test_ranges_over_the_whole_set_compare_values_in_their_type(spark):
    g = facts(spark, [("a", "size", k) for k in range(5, 15)] + [("a", "name", "9"), ("a", "name", "m"), ("b", "link", "x")])
    found = lambda low, high, axis="v": sorted(r.v for r in find(["?v"], InRange(g, "?v", low, high, axis)).collect())
    assert found(8, 12) == ["10", "11", "12", "8", "9"]
    assert found("8", "n") == ["9", "m"]
    assert found(dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)) == []
    assert found("m", "z", "a") == ["name", "size"]
    assert found("a", "a", "e") == ["a"]


def test_collections_hold_each_fact_once_and_derive_by_member(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/collection")
    rows = lambda *e: spark.createDataFrame([(x, "name", x) for x in e], "e string, a string, v string")
    held = lambda df: sorted(r.e for r in df.collect())
    assert c.tickets() == [] and held(c.snapshot()) == []
    one, two = c.commit(rows("a", "b", "b")), c.commit(rows("b", "c"))
    assert c.commit(rows("b", "a")) == one != two and len(c.tickets()) == 2
    assert held(c.snapshot()) == ["a", "b", "c"] and held(c.snapshot(two)) == ["b", "c"]
    assert held(c.materialize(f"file://{tmp_path}/whole")) == ["a", "b", "c"]
    later = lambda f: f.where("e > 'a'").select("e")
    assert held(c.derived("later", later, verify=True)) == ["b", "c"]
    c.commit(rows("d"))
    assert held(c.derived("later", later, verify=True)) == ["b", "c", "d"]
    with pytest.raises(ValueError):
        c.derived("numbers", lambda f: f.groupBy().count(), verify=True)
    with pytest.raises(KeyError):
        c.snapshot("nothing")


def test_kept_path_indexes_follow_their_edges(spark, tmp_path):
    df = spark.createDataFrame([("u", "a", "v"), ("v", "a", "w")], "src string, label string, dst string")
    path = f"file://{tmp_path}/paths"
    ensure = lambda expression, edges: PathIndex.ensure(path, expression, edges)
    first = ensure(step("a").plus(), df)
    assert first.contains("u", "w") and ensure(step("a").plus(), df.orderBy("dst")).fingerprint == first.fingerprint
    assert not ensure(step("a").plus(), df.where("src = 'u'")).contains("u", "w")
    assert not ensure(step("a"), df).contains("u", "w")
    assert len([p for p in (tmp_path / "paths").iterdir()]) == 3


def test_rationals_are_exact(spark):
    r = lambda a, b: values.rational(F.lit(a), F.lit(b))
    pair = lambda c: c.cast("struct<num:bigint,den:bigint>")
    none = F.lit(None).cast("struct<num:decimal(38,0),den:decimal(38,0)>")
    row = spark.range(1).select(pair(values.plus(r(1, 3), r(1, 6))), pair(values.minus(r(1, 3), r(1, 2))), pair(values.times(r(2, 3), r(9, 4))), pair(values.negated(r(2, 3))), values.plus(r(1, 3), none)).first()
    assert [None if c is None else tuple(c) for c in row] == [(1, 2), (-1, 6), (3, 2), (-2, 3), None]
    big = F.lit(2**62)
    square = values.times(values.rational(big, F.lit(1)), values.rational(big, F.lit(1)))
    assert spark.range(1).select(square.getField("num").cast("string")).first()[0] == str(2**124)
    with pytest.raises(Exception, match="(?i)precision|decimal"):
        spark.range(1).select(values.times(square, square)).collect()


def test_domains_and_prefixes(spark):
    g = facts(spark, [("a", "size", 1), ("b", "size", 1), ("c", "size", 7), ("a", "name", "ab"), ("b", "name", "ac"), ("c", "name", "b")])
    assert {(r.v, r.n) for r in g.domain("size").collect()} == {(1, 2), (7, 1)}
    assert [r.v for r in g.domain("size", low=2).collect()] == [7]
    assert {r.e for r in g.domain("size", "e", high="b").collect()} == {"a", "b"}
    assert {(r.prefix, r.n) for r in g.prefixes("name", 1).collect()} == {("a", 2), ("b", 1)}
    assert g.has_prefix("name", "a") and not g.has_prefix("name", "x")


def test_ancestors_of_a_long_chain(spark, tmp_path):
    r = Repository(spark, f"file://{tmp_path}/repo")
    ids = [f"{k:02}" for k in range(24)]
    spark.createDataFrame(list(zip(ids[1:], ids)), "id string, parent string").write.parquet(f"file://{tmp_path}/repo/parents")
    assert sorted(x.id for x in r.ancestors(r.select("20")).collect()) == ids[:21]
