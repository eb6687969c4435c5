"""A query for each operator beyond the named suite, with the same question in DuckDB's SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text, values
from factloom.operators import search
from factloom.operators.collection import Collection
from factloom.operators.history import Repository
from factloom.operators.model import FactSet, content_id, reference
from factloom.operators.paths import PathIndex, PathSummary, any_but, step
from factloom.operators.registers import ObservationOrder, StatedOrder, sole_by_register
from factloom.plans.graph import nation_cycle, table, tables_as_facts
from factloom.plans.query import Among, And, Filter, Has, InRange, Is, Or, Source, Temp, assignments, between, equal, find, pattern
from factloom.sources import json_facts, ntriples, store
from factloom.sources.scratch import scratch_path
from factloom.streaming.incremental import pattern_changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def asks(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Scans and sources


@asks("SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def customers_with_nations(spark, d):
    g = tables_as_facts(spark, d)
    return find(["?name", "?nation"], pattern(g, ("?c", "c_name", "?name"), ("?c", "c_nation", "?n"), ("?n", "n_name", "?nation")))


@asks("SELECT 'order:' || o_orderkey AS o, o_totalprice AS total FROM orders WHERE o_orderstatus = 'F'")
def scan_constant_value(spark, d):
    return find(["?o", "?total"], pattern(tables_as_facts(spark, d), ("?o", "o_status", "F"), ("?o", "o_total", "?total")))


@asks("SELECT c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey = 7")
def scan_constant_entity(spark, d):
    return find(["?name", "?segment"], pattern(tables_as_facts(spark, d), ("customer:7", "c_name", "?name"), ("customer:7", "c_segment", "?segment")))


@asks("SELECT DISTINCT r_name AS v FROM region UNION SELECT n_name FROM nation")
def scan_segments_as_one_set(spark, d):
    g = tables_as_facts(spark, d)
    a = FactSet().with_pairs("name", "short_string", g.pairs("r_name"))
    b = FactSet().with_pairs("name", "short_string", g.pairs("n_name"))
    return find(["?v"], pattern(a + b, ("?e", "name", "?v"))).distinct()


@asks("SELECT s_name AS name FROM supplier WHERE s_nationkey IN (1, 3, 5)")
def source_collection(spark, d):
    g = tables_as_facts(spark, d)
    return find(["?name"], And(Has(spark, "?n", ["nation:1", "nation:3", "nation:5", "nation:3"]), pattern(g, ("?s", "s_nation", "?n"), ("?s", "s_name", "?name"))))


@asks("SELECT p_name AS name FROM part WHERE p_size IN (SELECT DISTINCT l_linenumber * 7 FROM lineitem)")
def source_table_members(spark, d):
    g = tables_as_facts(spark, d)
    sizes = table(spark, d, "lineitem").select((F.col("l_linenumber") * 7).cast("bigint").alias("v"))
    return find(["?name"], And(Has(spark, "?size", sizes), pattern(g, ("?p", "p_size", "?size"), ("?p", "p_name", "?name"))))


@asks("SELECT c_name AS name, n_orders FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def source_custom_relation(spark, d):
    g = tables_as_facts(spark, d)
    counts = lambda: table(spark, d, "orders").groupBy(reference("customer", "o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("n_orders"))
    return find(["?name", "?n_orders"], And(Source(["?c", "?n_orders"], counts), pattern(g, ("?c", "c_name", "?name"))))


@asks("SELECT 'supplier:' || s_suppkey AS e FROM supplier WHERE s_nationkey = 3")
def attribute_value_entities(spark, d):
    return tables_as_facts(spark, d).entities_with("s_nation", "nation:3", descending=True)


@asks("SELECT 'nation:' || n_nationkey AS e, a, v FROM (SELECT n_nationkey, 'n_name' AS a, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'n_region', 'region:' || n_regionkey FROM nation)")
def scan_free_attribute(spark, d):
    g = tables_as_facts(spark, d)
    part = FactSet({n: g.attributes[n] for n in ("n_name", "n_region")}, {n: g.data[n] for n in ("n_name", "n_region")})
    return find(["?e", "?a", "?v"], pattern(part, ("?e", "?a", "?v")))


@asks("SELECT 'part:' || p_partkey AS p, p_name AS name, p_size::BIGINT AS size, p_retailprice AS price FROM part")
def archive_round_trip(spark, d):
    g = tables_as_facts(spark, d)
    path = scratch_path(spark, "archive")
    names = ("p_name", "p_size", "p_price")
    part = FactSet({n: g.attributes[n] for n in names}, {n: g.data[n] for n in names})
    store.write_facts(part, path)
    store.append_facts(part, path)
    compacted = scratch_path(spark, "compacted")
    store.compact(spark, compacted, path, path)
    return find(["?p", "?name", "?size", "?price"], pattern(store.read_facts(spark, compacted), ("?p", "p_name", "?name"), ("?p", "p_size", "?size"), ("?p", "p_price", "?price")))


@asks("SELECT lower(sha256(body)) AS handle, octet_length(encode(body))::BIGINT AS length FROM (SELECT DISTINCT coalesce(text, '') AS body FROM documents)")
def blob_store(spark, d):
    blobs = store.BlobStore(spark, scratch_path(spark, "blobs"))
    rows = table(spark, d, "documents").select(F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    handles = blobs.put(rows)
    blobs.put(rows)
    return blobs.get(handles).select(F.lower(F.hex("handle")).alias("handle"), F.octet_length("bytes").cast("bigint").alias("length"))


@asks("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM (SELECT DISTINCT props FROM events) GROUP BY k")
def json_objects(spark, d):
    facts, _ = json_facts.import_objects(table(spark, d, "events").select(F.col("props").alias("json")))
    return assignments(pattern(facts, ("?e", "k", "?k"))).df.groupBy(F.col("k").cast("bigint").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@asks("SELECT kind, field, number, count(*) AS n FROM (SELECT 'object' AS kind, NULL AS field, NULL AS number FROM events UNION ALL SELECT 'number', 'k', json_extract_string(props, '$.k') FROM events) GROUP BY ALL")
def json_tree(spark, d):
    return json_facts.import_tree(table(spark, d, "events").select(F.col("props").alias("json"))).groupBy("kind", "field", "number").agg(F.count(F.lit(1)).alias("n"))


@asks("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def ntriples_import(spark, d):
    def line(s, p, o):
        return F.concat(F.lit("<http://x/"), s, F.lit("> <http://x/"), F.lit(p), F.lit("> "), o, F.lit(" ."))

    def iri(prefix, c):
        return F.concat(F.lit(f"{prefix}/"), F.col(c).cast("string"))

    def literal(c):
        return F.concat(F.lit('"'), F.col(c), F.lit('"'))

    n, r = table(spark, d, "nation"), table(spark, d, "region")
    bracket = lambda c: F.concat(F.lit("<http://x/"), c, F.lit(">"))
    lines = n.select(line(iri("n", "n_nationkey"), "name", literal("n_name")).alias("value")).unionAll(n.select(line(iri("n", "n_nationkey"), "region", bracket(iri("r", "n_regionkey"))))).unionAll(r.select(line(iri("r", "r_regionkey"), "name", literal("r_name"))))
    facts = ntriples.import_triples(lines).facts
    name, region = "http://x/name^text", "http://x/region^id"
    return find(["?name", "?region"], pattern(facts, ("?n", name, "?name"), ("?n", region, "?r"), ("?r", name, "?region")))


# Projection and predicates


@asks("SELECT count(*) AS count FROM customer JOIN orders ON c_custkey = o_custkey")
def unit_head_count(spark, d):
    return find([], pattern(tables_as_facts(spark, d), ("?o", "o_customer", "?c"), ("?c", "c_name", "?name"))).agg(F.count(F.lit(1)).alias("count"))


@asks("SELECT n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def hidden_variables_multiply(spark, d):
    return find("?nation", pattern(tables_as_facts(spark, d), ("_?c", "c_nation", "?n"), ("?n", "n_name", "?nation")))


@asks("SELECT try_cast(replace(p_brand, 'Brand#', '') AS BIGINT) AS brand, p_size::BIGINT AS size FROM part WHERE try_cast(replace(p_brand, 'Brand#', '') AS BIGINT) IS NOT NULL")
def typed_head(spark, d):
    g = tables_as_facts(spark, d)
    brand = table(spark, d, "part").select(reference("part", "p_partkey").alias("e"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("v"))
    g = g.with_pairs("brand_no", "text", brand, False)
    return find([("?brand", "bigint"), "?size"], pattern(g, ("?p", "brand_no", "?brand"), ("?p", "p_size", "?size")))


@asks("SELECT try_cast(p_name AS BIGINT) IS NOT NULL AS ok, count(*) AS n FROM part GROUP BY 1")
def typed_head_reports(spark, d):
    return find([("?name", "bigint?")], pattern(tables_as_facts(spark, d), ("?p", "p_name", "?name"))).groupBy(F.col("name.ok").alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@asks("SELECT 'part:' || p_partkey AS p, p_size::BIGINT AS size FROM part WHERE p_size BETWEEN 10 AND 12")
def range_filter(spark, d):
    return find(["?p", "?size"], And(pattern(tables_as_facts(spark, d), ("?p", "p_size", "?size")), between("?size", 10, 12)))


@asks("SELECT DISTINCT p_size::BIGINT AS size FROM part WHERE p_size BETWEEN 10 AND 20")
def range_source(spark, d):
    return find(["?size"], InRange(tables_as_facts(spark, d), "?size", 10, 20, attribute="p_size"))


@asks("SELECT c_name AS name FROM customer WHERE 'customer:' || c_custkey BETWEEN 'customer:10' AND 'customer:12'")
def entity_range(spark, d):
    g = tables_as_facts(spark, d)
    return find(["?name"], And(InRange(g, "?c", "customer:10", "customer:12", "e", "c_name"), pattern(g, ("?c", "c_name", "?name"))))


@asks("SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def variable_is_constant(spark, d):
    return find(["?name"], And(Is(spark, "?s", "BUILDING"), pattern(tables_as_facts(spark, d), ("?c", "c_segment", "?s"), ("?c", "c_name", "?name"))))


@asks("SELECT c_name AS customer, s_name AS supplier FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_custkey = s_suppkey")
def variable_equality(spark, d):
    g = tables_as_facts(spark, d)
    key = lambda c: F.element_at(F.split(c, ":"), -1)
    return find(["?customer", "?supplier"], And(pattern(g, ("?c", "c_nation", "?n"), ("?s", "s_nation", "?m"), ("?c", "c_name", "?customer"), ("?s", "s_name", "?supplier")), equal("?n", "?m"), Filter(["?c", "?s"], lambda c, s: key(c) == key(s))))


@asks("SELECT r_name AS region FROM region WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = 1 AND c_name = 'Customer#000000001')")
def constant_pattern_guards(spark, d):
    g = tables_as_facts(spark, d)
    return find(["?region"], pattern(g, ("customer:1", "c_name", "Customer#000000001"), ("?r", "r_name", "?region")))


@asks("SELECT r_name AS a, n_name AS b FROM region, nation")
def disjoint_patterns_multiply(spark, d):
    return find(["?a", "?b"], pattern(tables_as_facts(spark, d), ("?r", "r_name", "?a"), ("?n", "n_name", "?b")))


@asks("SELECT c_name AS name FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def temporary_variables(spark, d):
    g = tables_as_facts(spark, d)
    nations = find(["?n"], Temp(["?s"], pattern(g, ("?s", "s_nation", "?n")))).distinct()
    return find(["?name"], And(pattern(g, ("?s", "c_nation", "?n"), ("?s", "c_name", "?name")), Among("?n", nations)))


@asks("SELECT c_name AS name, s_name AS supplier FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def join_across_fact_sets(spark, d):
    a, b = tables_as_facts(spark, d), tables_as_facts(spark, d)
    return find(["?name", "?supplier"], And(pattern(a, ("?c", "c_nation", "?n"), ("?c", "c_name", "?name")), pattern(b, ("?s", "s_nation", "?n"), ("?s", "s_name", "?supplier"))))


# Sets


@asks("SELECT n_name AS v FROM nation WHERE n_regionkey IN (1, 2)")
def or_is_a_set(spark, d):
    g = tables_as_facts(spark, d)
    arm = lambda r: pattern(g, ("?n", "n_region", r), ("?n", "n_name", "?v"))
    return find(["?v"], Or(arm("region:1"), arm("region:2"), arm("region:1")))


def _status(spark, d, *kinds):
    rows = table(spark, d, "orders").where(F.col("o_orderstatus").isin(*kinds)).select(reference("order", "o_orderkey").alias("e"), F.col("o_orderstatus").alias("v"))
    return FactSet().with_pairs("status", "short_string", rows, False, distinct=False)


@asks("SELECT 'order:' || o_orderkey AS e, o_orderstatus AS v FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')")
def set_union(spark, d):
    return (_status(spark, d, "F", "O") + _status(spark, d, "O", "P")).pairs("status")


@asks("SELECT 'order:' || o_orderkey AS e, o_orderstatus AS v FROM orders WHERE o_orderstatus = 'O'")
def set_intersection(spark, d):
    return _status(spark, d, "F", "O").intersect(_status(spark, d, "O", "P")).pairs("status")


@asks("SELECT 'order:' || o_orderkey AS e, o_orderstatus AS v FROM orders WHERE o_orderstatus = 'F'")
def set_difference(spark, d):
    return _status(spark, d, "F", "O").difference(_status(spark, d, "O", "P")).pairs("status")


@asks("SELECT substr(c_name, 1, 17) AS prefix, count(*) AS n FROM customer GROUP BY prefix")
def prefix_counts(spark, d):
    return tables_as_facts(spark, d).pairs("c_name").select(F.substring("v", 1, 17).alias("prefix"), "v").distinct().groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


# Registers


def _events(spark, d):
    g = tables_as_facts(spark, d)
    day = table(spark, d, "events").select(reference("event", "event_id").alias("e"), F.date_trunc("day", "ts").alias("v"))
    return g.with_pairs("ev_day", "timestamp", day, False, distinct=False)


@asks("SELECT 'customer:' || user_id AS register, 'event:' || event_id AS state FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def register_last_writer_wins(spark, d):
    return StatedOrder(_events(spark, d), "ev_user", "ev_time").survivors().select("register", "state")


@asks("SELECT 'customer:' || user_id AS register, 'event:' || event_id AS state FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY ts) = 1")
def register_first_writer_wins(spark, d):
    return StatedOrder(_events(spark, d), "ev_user", "ev_time", first=True).survivors().select("register", "state")


@asks("SELECT 'customer:' || user_id AS register, 'event:' || event_id AS state FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC) = 1")
def register_ties_fork(spark, d):
    return StatedOrder(_events(spark, d), "ev_user", "ev_day").survivors().select("register", "state")


@asks("SELECT 'customer:' || user_id AS register, 'event:' || event_id AS state FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, 'event:' || event_id DESC) = 1")
def register_tiebreak_by_id(spark, d):
    return StatedOrder(_events(spark, d), "ev_user", "ev_day", tiebreak_by_id=True).survivors().select("register", "state")


@asks("WITH w AS (SELECT user_id, event_id FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC) = 1) SELECT 'customer:' || user_id AS register, CASE WHEN count(*) = 1 THEN 'sole' ELSE 'fork' END AS resolution, CASE WHEN count(*) = 1 THEN 'event:' || max(event_id) END AS state FROM w GROUP BY user_id")
def register_sole_or_fork(spark, d):
    return sole_by_register(StatedOrder(_events(spark, d), "ev_user", "ev_day"))


@asks("SELECT 'turn:' || conv_id || ':' || turn AS state FROM (SELECT DISTINCT conv_id, turn FROM conversations) a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1)")
def register_latest_observed(spark, d):
    g = tables_as_facts(spark, d)
    return ObservationOrder(g, "t_follows").resolve(g.pairs("t_role").select("e"))


@asks("SELECT ev.event_type AS type, count(*) AS n FROM (SELECT event_type FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1) ev GROUP BY type")
def register_maximal_in_query(spark, d):
    g = _events(spark, d)
    maximal = StatedOrder(g, "ev_user", "ev_time").survivors().select("state")
    return find(["?s", "?type"], And(pattern(g, ("?s", "ev_type", "?type")), Among("?s", maximal))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@asks("SELECT 'order:' || o_orderkey AS o, o_totalprice AS total FROM orders ORDER BY total DESC, o LIMIT 20")
def top_k(spark, d):
    return find(["?o", "?total"], pattern(tables_as_facts(spark, d), ("?o", "o_total", "?total"))).orderBy(F.desc("total"), "o").limit(20)


# Paths


@asks("SELECT 'nation:' || n_nationkey AS start, 'nation:' || n_nationkey AS end FROM nation UNION SELECT 'nation:' || src, 'nation:' || dst FROM (WITH RECURSIVE edges AS (SELECT n_nationkey AS src, (7 * n_nationkey + 3) % 25 AS dst FROM nation), reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src) SELECT * FROM reach)")
def path_star_adds_identity(spark, d):
    return PathSummary.of(step("next").star().compile(), nation_cycle(spark, d)).pairs()


@asks("SELECT DISTINCT 'order:' || o_orderkey AS start, 'region:' || n_regionkey AS end FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def path_sequence(spark, d):
    g = tables_as_facts(spark, d)
    edges = [g.pairs(a).select(F.col("e").alias("src"), F.lit(a).alias("label"), F.col("v").alias("dst")) for a in ("o_customer", "c_nation", "n_region")]
    every = edges[0].unionAll(edges[1]).unionAll(edges[2])
    return PathSummary.of(step("o_customer").then(step("c_nation")).then(step("n_region")).compile(), every).pairs()


@asks("SELECT DISTINCT 'nation:' || a.n_nationkey AS start, 'nation:' || b.n_nationkey AS end FROM nation a, nation b WHERE (7 * b.n_nationkey + 3) % 25 = a.n_nationkey OR (7 * a.n_nationkey + 3) % 25 = b.n_nationkey")
def path_either_way(spark, d):
    e = step("next").or_(step("next").inverse())
    return PathSummary.of(e.compile(), nation_cycle(spark, d)).pairs()


@asks("SELECT DISTINCT 'nation:' || n_nationkey AS start, 'region:' || n_regionkey AS end FROM nation UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer")
def path_any_label_but(spark, d):
    g = tables_as_facts(spark, d)
    parts = [g.pairs(a).select(F.col("e").alias("src"), F.lit(a).alias("label"), F.col("v").alias("dst")) for a in ("o_customer", "c_nation", "n_region")]
    return PathSummary.of(any_but("o_customer").compile(), parts[0].unionAll(parts[1]).unionAll(parts[2])).pairs()


@asks("WITH RECURSIVE edges AS (SELECT n_nationkey AS src, (7 * n_nationkey + 3) % 25 AS dst FROM nation), reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src) SELECT 'nation:' || src AS start FROM reach WHERE src = dst")
def path_merged_segments_diagonal(spark, d):
    edges = nation_cycle(spark, d)
    half = F.pmod(F.xxhash64("src"), F.lit(2)) == 0
    return PathIndex.from_edges(step("next").plus(), edges.where(half), edges.where(~half)).diagonal()


@asks("SELECT DISTINCT 'turn:' || a.conv_id || ':' || a.turn AS start, 'turn:' || a.conv_id || ':' || b.turn AS end FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn")
def path_conversation_chain(spark, d):
    edges = tables_as_facts(spark, d).pairs("t_follows").select(F.col("e").alias("src"), F.lit("follows").alias("label"), F.col("v").alias("dst"))
    return PathSummary.of(step("follows").plus().compile(), edges).pairs()


# Retrieval

_TERMS = ["the", "of", "and", "the"]
_BM25 = """
WITH tokens AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '[ \\t\\n\\f\\r]+'), lambda w: translate(regexp_replace(w, '^[!-/:-@\\[-`{-~]+|[!-/:-@\\[-`{-~]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT d.doc_id, coalesce(l, 0) AS l FROM documents d LEFT JOIN (SELECT doc_id, sum(tf) AS l FROM tf GROUP BY doc_id) USING (doc_id)),
corpus AS (SELECT count(*) AS n, avg(l) AS a FROM lengths),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT doc_id, sum((CASE term WHEN 'the' THEN 2 ELSE 1 END) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS score
  FROM tf JOIN df USING (term) JOIN lengths USING (doc_id), corpus WHERE term IN ('the', 'of', 'and') GROUP BY doc_id)
"""


def _bm25(spark, d):
    return search.BM25Index.build(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


@asks(_BM25 + "SELECT doc_id AS doc, round(score, 6) AS score FROM scored")
def bm25_scores(spark, d):
    return _bm25(spark, d).query(_TERMS).select("doc", F.round("score", 6).alias("score"))


@asks(_BM25 + "SELECT source, count(*) AS n FROM scored JOIN documents USING (doc_id) WHERE score >= 0.5 GROUP BY source")
def bm25_joins_pattern(spark, d):
    hits = _bm25(spark, d).matches(_TERMS, 0.5).select(reference("doc", "doc").alias("x"))
    return find(["?x", "?source"], And(Source(["?x"], lambda: hits, True), pattern(tables_as_facts(spark, d), ("?x", "d_source", "?source")))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@asks(_BM25 + "SELECT n AS docs, (SELECT count(*) FROM df) AS terms, round(a, 6) AS avg_length FROM corpus")
def bm25_statistics(spark, d):
    return _bm25(spark, d).statistics().select("docs", "terms", F.round("avg_length", 6).alias("avg_length"))


@asks("SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) >= 0.2")
def cosine_similar_to(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    probe = vectors.where("id = 0").first().vector
    return search.similar_to(vectors, probe, 0.2).select("id", F.round("score", 6).alias("score"))


@asks("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.0")
def cosine_of_bound_pairs(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pairs = vectors.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return search.cosine_at_least(pairs, vectors, 0.0).select("a", "b", F.round("score", 6).alias("score"))


@asks("SELECT substr(w, i, 3) AS term, count(*) AS n FROM (SELECT w, unnest(range(1, greatest(length(w) - 2, 1) + 1)) AS i FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM benchmark)) GROUP BY 1")
def ngram_tokens(spark, d):
    return table(spark, d, "benchmark").select(F.explode(text.ngrams(F.col("text"), 3)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@asks("WITH w AS (SELECT item_id, list_filter(list_transform(string_split_regex(text, '[ \\t\\n\\f\\r]+'), lambda w: translate(regexp_replace(w, '^[!-/:-@\\[-`{-~]+|[!-/:-@\\[-`{-~]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]')) AS w FROM benchmark) SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM w) GROUP BY bigram")
def phrase_bigrams(spark, d):
    pairs = table(spark, d, "benchmark").select(F.explode(text.bigrams(F.col("text"))).alias("bigram"))
    return pairs.groupBy(F.replace("bigram", F.lit("\0"), F.lit(" ")).alias("bigram")).agg(F.count(F.lit(1)).alias("n"))


# Reads in order, kept indexes, collections


@asks("SELECT 'nation:' || n_nationkey AS e, a, v FROM (SELECT n_nationkey, 'n_name' AS a, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'n_region', 'region:' || n_regionkey FROM nation)")
def scan_ordered(spark, d):
    g = tables_as_facts(spark, d)
    return FactSet({n: g.attributes[n] for n in ("n_name", "n_region")}, {n: g.data[n] for n in ("n_name", "n_region")}).ordered()


@asks("SELECT p_size::BIGINT AS v, count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 20 GROUP BY 1")
def domain_within_bounds(spark, d):
    return tables_as_facts(spark, d).domain("p_size", low=10, high=20)


@asks("SELECT 'order:' || l_orderkey AS e, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1")
def domain_of_entities(spark, d):
    return tables_as_facts(spark, d).domain("o_part", "e")


@asks("SELECT left(v, 6) AS prefix, count(*) AS n FROM (SELECT DISTINCT p_type AS v FROM part WHERE starts_with(p_type, 'S')) GROUP BY 1")
def prefixes_of_values(spark, d):
    return tables_as_facts(spark, d).prefixes("p_type", 6, "S")


@asks("SELECT DISTINCT 'turn:' || a.conv_id || ':' || a.turn AS start, 'turn:' || a.conv_id || ':' || b.turn AS end FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn")
def path_index_kept(spark, d):
    edges = tables_as_facts(spark, d).pairs("t_follows").select(F.col("e").alias("src"), F.lit("follows").alias("label"), F.col("v").alias("dst"))
    path = scratch_path(spark, "paths")
    PathIndex.ensure(path, step("follows").plus(), edges)
    return PathIndex.ensure(path, step("follows").plus(), edges).accepted


def _collected(spark, d):
    """The orders' statuses in two members that share those of status O."""
    c = Collection(spark, scratch_path(spark, "collection"))
    orders = table(spark, d, "orders").select(reference("order", "o_orderkey").alias("e"), F.lit("o_status").alias("a"), F.col("o_orderstatus").alias("v"))
    return c, [c.commit(orders.where(F.col("v") != left)) for left in ("F", "P")]


@asks("SELECT 'order:' || o_orderkey AS e, 'o_status' AS a, o_orderstatus AS v FROM orders")
def collection_snapshot(spark, d):
    return _collected(spark, d)[0].snapshot()


@asks("SELECT 'order:' || o_orderkey AS e, 'o_status' AS a, o_orderstatus AS v FROM orders WHERE o_orderstatus <> 'P'")
def collection_materialized(spark, d):
    c, tickets = _collected(spark, d)
    return c.materialize(scratch_path(spark, "materialized"), tickets[1])


@asks("SELECT DISTINCT o_orderstatus AS status, right(o_orderkey::VARCHAR, 1) AS digit FROM orders")
def collection_derived(spark, d):
    c, _ = _collected(spark, d)
    return c.derived("digits", lambda f: f.select(F.col("v").alias("status"), F.right("e", F.lit(1)).alias("digit")).distinct(), verify=True)


_WORDS = "list_filter(list_transform(string_split_regex(text, '[ \\t\\n\\f\\r]+'), lambda w: translate(regexp_replace(w, '^[!-/:-@\\[-`{-~]+|[!-/:-@\\[-`{-~]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))"


@asks(f"SELECT DISTINCT doc_id AS doc FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE list_contains(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), 'of the')")
def phrase_search(spark, d):
    return search.BM25Index.build(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), text.bigrams_of).matches(["of\0the"])


@asks(_BM25 + "SELECT doc_id AS doc, source, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS cosine FROM scored JOIN documents USING (doc_id) JOIN embeddings ON vec_id = doc_id WHERE score >= 0.1 AND list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) >= 0.0")
def hybrid_search(spark, d):
    """Words, a vector and a pattern at once: documents that score, whose vector is close, with their source."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    close = search.similar_to(vectors, vectors.where("id = 0").first().vector, 0.0)
    hits = _bm25(spark, d).matches(_TERMS, 0.1)
    both = hits.join(close, F.col("doc") == F.col("id")).select(reference("doc", "doc").alias("x"), "doc", F.round("score", 6).alias("cosine"))
    return find(["?doc", "?source", "?cosine"], And(Source(["?x", "?doc", "?cosine"], lambda: both, True), pattern(tables_as_facts(spark, d), ("?x", "d_source", "?source"))))


@asks(_BM25 + "SELECT doc_id AS doc, round(score, 6) AS score FROM scored")
def bm25_merged(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    halves = [search.BM25Index.build(docs.where(F.pmod("doc", F.lit(2)) == k)) for k in (0, 1)]
    return halves[0].merge(halves[1]).query(_TERMS).select("doc", F.round("score", 6).alias("score"))


# Increments

_CUT = dt.datetime(2001, 1, 1)


@asks("SELECT c_name AS name, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '2001-01-01'")
def incremental_delta_join(spark, d):
    full = tables_as_facts(spark, d)
    new = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit(_CUT))
    delta = FactSet().with_table(new, "order", "o_orderkey", {"o_customer": ("id", reference("customer", "o_custkey")), "o_total": ("float", "o_totalprice")})
    return find(["?name", "?total"], pattern_changes(full, delta, ("?o", "o_customer", "?c"), ("?o", "o_total", "?total"), ("?c", "c_name", "?name")))


@asks("SELECT c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def incremental_full_delta(spark, d):
    g = tables_as_facts(spark, d)
    return find(["?name"], pattern_changes(g, g, ("?c", "c_name", "?name"), ("?c", "c_nation", "?n"), ("?n", "n_name", "?nation")))


# History


def _history(spark, d):
    """All orders in four commits, every fourth month together; the fourth is a side branch that is merged."""
    r = Repository(spark, scratch_path(spark, "history"))
    month = (F.month("o_orderdate") - 1) % 4 + 1
    facts = table(spark, d, "orders").select(month.alias("m"), reference("order", "o_orderkey").alias("e"), F.lit("o_status").alias("a"), F.col("o_orderstatus").alias("v"))
    r.create_branch("main")
    w = r.pull("main")
    ids = [w.commit(facts.where(F.col("m") == m).drop("m"), f"month {m}", created_at=dt.datetime(1995, m, 1)) for m in (1, 2, 3)]
    w.push()
    side = r.write_commit(facts.where("m = 4").drop("m"), "side", [ids[0]], created_at=dt.datetime(1995, 4, 1))
    w.merge(side)
    w.push()
    return r, ids, side


def _months(sql: str) -> str:
    return f"SELECT 'order:' || o_orderkey AS e, 'o_status' AS a, o_orderstatus AS v FROM orders WHERE (month(o_orderdate) - 1) % 4 + 1 IN ({sql})"


@asks(_months("1, 2, 3, 4"))
def history_checkout_ancestors(spark, d):
    r, _, _ = _history(spark, d)
    return r.checkout(r.ancestors(r.select(r.head("main"))))


@asks(_months("2, 3, 4"))
def history_range(spark, d):
    r, ids, _ = _history(spark, d)
    return r.checkout(r.range(r.select(ids[0]), r.select(r.head("main"))))


@asks(_months("2, 3, 4"))
def history_symmetric_difference(spark, d):
    r, ids, side = _history(spark, d)
    return r.checkout(r.symmetric_difference(r.select(ids[2]), r.select(side)))


@asks(_months("1"))
def history_nth_ancestors(spark, d):
    r, ids, _ = _history(spark, d)
    return r.checkout(r.nth_ancestors(r.select(ids[2]), 2))


@asks(_months("2, 3"))
def history_time_range(spark, d):
    r, _, _ = _history(spark, d)
    return r.checkout(r.time_range(dt.datetime(1995, 2, 1), dt.datetime(1995, 3, 15)))


@asks("SELECT count(DISTINCT (month(o_orderdate) - 1) % 4) AS n FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def history_of_entity(spark, d):
    r, _, _ = _history(spark, d)
    key = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return r.history_of(f"order:{key}").agg(F.count(F.lit(1)).alias("n"))


# Values


@asks("SELECT event_id, date_diff('microsecond', lo, hi) AS width, lo + to_microseconds(date_diff('microsecond', lo, hi) // 2) AS middle FROM (SELECT event_id, ts AS lo, ts + INTERVAL 90 MINUTE AS hi FROM events)")
def interval_functions(spark, d):
    start = F.col("ts").cast("timestamp")
    i = values.interval(start, start + F.expr("INTERVAL 90 MINUTES"))
    return table(spark, d, "events").select("event_id", i.alias("i")).select("event_id", values.width_micros(F.col("i")).alias("width"), values.midpoint(F.col("i")).alias("middle").cast("timestamp"))


@asks("SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders")
def money_minor_units(spark, d):
    amount = values.from_minor(F.round(F.col("o_totalprice") * 100).cast("bigint"), "EUR")
    return table(spark, d, "orders").select("o_orderkey", values.to_minor(amount, "EUR").cast("bigint").alias("cents"))


@asks("SELECT p_partkey, (p_size // gcd(p_size, 12))::BIGINT AS num, (12 // gcd(p_size, 12))::BIGINT AS den FROM part")
def rational_lowest_terms(spark, d):
    r = values.rational(F.col("p_size"), F.lit(12))
    return table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", F.col("r.num").cast("bigint").alias("num"), F.col("r.den").cast("bigint").alias("den"))


@asks("SELECT o_orderkey, (c * 119 // gcd(c * 119, 10000))::BIGINT AS num, (10000 // gcd(c * 119, 10000))::BIGINT AS den FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders)")
def money_with_exact_rate(spark, d):
    """A price and 19 % of it, without rounding."""
    net = values.rational(F.round(F.col("o_totalprice") * 100).cast("bigint"), F.lit(100))
    gross = values.plus(net, values.times(net, values.rational(F.lit(19), F.lit(100))))
    return table(spark, d, "orders").select("o_orderkey", gross.alias("r")).select("o_orderkey", F.col("r.num").cast("bigint").alias("num"), F.col("r.den").cast("bigint").alias("den"))


@asks("SELECT h AS id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS uuid, h AS back FROM (SELECT right(sha256(text), 32) AS h FROM benchmark)")
def ids_as_uuids(spark, d):
    ids = table(spark, d, "benchmark").select(content_id(F.col("text").cast("binary")).alias("id")).where(values.is_id(F.col("id")))
    return ids.select("id", values.as_uuid(F.col("id")).alias("uuid"), values.from_uuid(values.as_uuid(F.col("id"))).alias("back"))
