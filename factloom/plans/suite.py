"""The named suite: 104 queries by family, each with the same question in DuckDB's SQL.

The graph's predicates play these parts: ``o_status`` is large with one value an
order, ``o_line``, ``o_part`` and ``o_supplier`` are large with many values,
``o_urgent``, ``d_toxic`` and ``r_name`` are small, ``p_size`` and ``c_balance`` are numeric,
``c_name``, ``p_name`` and ``d_text`` are texts, and ``o_date`` is a date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators.model import FactSet
from factloom.operators.paths import PathSummary, step
from factloom.plans.graph import nation_cycle, tables_as_facts
from factloom.plans.query import And, Filter, Or, Pattern, assignments, between, count, different, find, pattern, where_exists, where_not_exists, with_optional

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The predicates as SQL: each is a table of distinct (e, v).

LINES = "(SELECT DISTINCT * FROM lineitem)"
SQL = {
    "o_status": "(SELECT o_orderkey AS e, o_orderstatus AS v FROM orders)",
    "o_urgent": "(SELECT o_orderkey AS e, o_orderstatus AS v FROM orders WHERE o_orderpriority = '1-URGENT')",
    "o_customer": "(SELECT o_orderkey AS e, o_custkey AS v FROM orders)",
    "o_priority": "(SELECT o_orderkey AS e, o_orderpriority AS v FROM orders)",
    "o_line": f"(SELECT l_orderkey AS e, row_number() OVER () AS v FROM {LINES})",
    "o_part": "(SELECT DISTINCT l_orderkey AS e, l_partkey AS v FROM lineitem)",
    "o_supplier": "(SELECT DISTINCT l_orderkey AS e, l_suppkey AS v FROM lineitem)",
    "c_nation": "(SELECT c_custkey AS e, c_nationkey AS v FROM customer)",
    "c_name": "(SELECT c_custkey AS e, c_name AS v FROM customer)",
    "c_balance": "(SELECT c_custkey AS e, c_acctbal AS v FROM customer)",
    "n_region": "(SELECT n_nationkey AS e, n_regionkey AS v FROM nation)",
    "d_text": "(SELECT doc_id AS e, text AS v FROM documents)",
    "d_lang": "(SELECT doc_id AS e, lang AS v FROM documents)",
    "d_source": "(SELECT doc_id AS e, source AS v FROM documents)",
    "d_toxic": "(SELECT DISTINCT doc_id AS e, toxic AS v FROM labels)",
    "d_quality": "(SELECT DISTINCT doc_id AS e, quality AS v FROM labels)",
    "p_size": "(SELECT p_partkey AS e, p_size::BIGINT AS v FROM part)",
    "p_name": "(SELECT p_partkey AS e, p_name AS v FROM part)",
    "p_type": "(SELECT p_partkey AS e, p_type AS v FROM part)",
    "o_date": "(SELECT o_orderkey AS e, o_orderdate AS v FROM orders)",
}


def register(name: str, sql: str, query: Callable[[FactSet], DataFrame]) -> None:
    key = "suite_" + name.replace("-", "_")
    QUERIES[key] = lambda spark, sf_dir: query(tables_as_facts(spark, sf_dir))
    ORACLES[key] = sql


# A shape is a list of (subject, predicate, object) with one-letter variables, the same for both sides.

Shape = list[tuple[str, str, str]]


def clauses(shape: Shape) -> list[tuple[str, str, str]]:
    return [(f"?{s}", p, f"?{o}") for s, p, o in shape]


def sql_of(shape: Shape) -> str:
    """The natural join of a shape's predicates, with a column for each variable."""
    parts = [f"(SELECT e AS {s}, v AS {o} FROM {SQL[p]})" for s, p, o in shape]
    return " NATURAL JOIN ".join(parts)


def shared(a: Shape, b: Shape) -> list[str]:
    names = [{x for s, _, o in t for x in (s, o)} for t in (a, b)]
    return sorted(names[0] & names[1])


def joins(name: str, shape: Shape) -> None:
    register(name, f"SELECT count(*) AS count FROM {sql_of(shape)}", lambda g: count(Pattern(g, clauses(shape))))


def beside(family: str, name: str, left: Shape, right: Shape) -> None:
    """The optional, minus and exists forms of a left and a right side."""
    how = {"optional": (with_optional, "LEFT"), "minus": (where_not_exists, "ANTI"), "exists": (where_exists, "SEMI")}[family]
    sql = f"SELECT count(*) AS count FROM (SELECT * FROM {sql_of(left)}) {how[1]} JOIN (SELECT * FROM {sql_of(right)}) USING ({', '.join(shared(left, right))})"
    register(f"{family}-join-{name}", sql, lambda g: how[0](Pattern(g, clauses(left)), Pattern(g, clauses(right))).agg(F.count(F.lit(1)).alias("count")))


# 1-10: joins

joins("join-2-small-large", [("s", "o_urgent", "a"), ("s", "o_status", "b")])
joins("join-2-large-small", [("s", "o_status", "a"), ("s", "o_urgent", "b")])
joins("join-2-large-large", [("s", "o_status", "a"), ("s", "o_line", "b")])
joins("join-2-largest-result", [("s", "o_line", "a"), ("s", "o_part", "b")])
joins("join-2-large-large-with-large-result", [("s", "o_part", "a"), ("s", "o_supplier", "b")])
joins("join-2-large-large-with-small-result", [("s", "d_source", "a"), ("s", "d_toxic", "b")])
joins("join-3-star-largest-sum-of-join-sizes", [("s", "o_customer", "a"), ("s", "o_status", "b"), ("s", "o_line", "c")])
joins("join-3-chain-largest-sum-of-join-sizes", [("a", "o_customer", "b"), ("b", "c_nation", "c"), ("c", "n_region", "d")])
joins("join-xlarge-star-on-small-predicates", [("s", "d_toxic", "a"), ("s", "d_quality", "b"), ("s", "d_lang", "c"), ("s", "d_source", "d"), ("s", "d_text", "f")])
joins("join-xlarge-chain-on-small-predicates", [("a", "o_part", "b"), ("a", "o_customer", "c"), ("c", "c_nation", "d"), ("d", "n_region", "f"), ("b", "p_type", "g")])

# 11-40: optional, minus, exists

SIDES: dict[str, tuple[Shape, Shape]] = {
    "small-large": ([("s", "d_toxic", "a")], [("s", "d_source", "b")]),
    "large-small": ([("s", "d_source", "a")], [("s", "d_toxic", "b")]),
    "large-large": ([("s", "o_status", "a")], [("s", "o_line", "b")]),
    "2-large-large-with-large-result": ([("s", "o_part", "a")], [("s", "o_supplier", "b")]),
    "2-large-large-with-small-join-result-1": ([("s", "o_part", "a")], [("s", "o_urgent", "b")]),
    "2-large-large-with-small-join-result-2": ([("s", "o_urgent", "a")], [("s", "o_part", "b")]),
    "3-star-1": ([("s", "o_customer", "a"), ("s", "o_status", "b")], [("s", "o_part", "c")]),
    "3-star-2": ([("s", "o_customer", "a")], [("s", "o_urgent", "b"), ("s", "o_part", "c")]),
    "3-chain-1": ([("a", "o_part", "b"), ("a", "o_customer", "c")], [("a", "o_urgent", "d")]),
    "3-chain-2": ([("a", "o_customer", "b")], [("b", "c_nation", "c"), ("c", "n_region", "d")]),
}
for _family in ("optional", "minus", "exists"):
    for _name, (_left, _right) in SIDES.items():
        beside(_family, _name, _left, _right)

# 41-45: unions

register("union-no-constraint", f"SELECT count(*) AS count FROM (SELECT * FROM {SQL['o_status']} UNION SELECT * FROM {SQL['o_priority']})", lambda g: count(Or(pattern(g, ("?s", "o_status", "?o")), pattern(g, ("?s", "o_priority", "?o")))))
register(
    "union-constraint-from-star",
    f"SELECT ((SELECT count(*) FROM {SQL['p_size']} NATURAL JOIN (SELECT e, v AS w FROM {SQL['p_name']})) + (SELECT count(*) FROM {SQL['p_type']} NATURAL JOIN (SELECT e, v AS w FROM {SQL['p_name']})))::BIGINT AS count",
    lambda g: count(pattern(g, ("?s", "p_size", "?o"), ("?s", "p_name", "?w")), "n").unionAll(count(pattern(g, ("?s", "p_type", "?o"), ("?s", "p_name", "?w")), "n")).agg(F.sum("n").alias("count")),
)
register(
    "union-constraint-small-join",
    f"SELECT count(*) AS count FROM (SELECT * FROM {SQL['d_lang']} UNION SELECT * FROM {SQL['d_source']}) NATURAL JOIN (SELECT e, v AS w FROM {SQL['d_toxic']})",
    lambda g: count(And(Or(pattern(g, ("?s", "d_lang", "?o")), pattern(g, ("?s", "d_source", "?o"))), pattern(g, ("?s", "d_toxic", "?w")))),
)
register(
    "union-constraint-large-join",
    f"SELECT count(*) AS count FROM (SELECT * FROM {SQL['o_status']} UNION SELECT * FROM {SQL['o_priority']}) NATURAL JOIN (SELECT e, v AS w FROM {SQL['o_part']})",
    lambda g: count(And(Or(pattern(g, ("?s", "o_status", "?o")), pattern(g, ("?s", "o_priority", "?o"))), pattern(g, ("?s", "o_part", "?w")))),
)
register(
    "union-constraint-filter-restrictive",
    "SELECT ((SELECT count(*) FROM nation WHERE n_nationkey = n_regionkey) + (SELECT count(*) FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey))::BIGINT AS count",
    lambda g: (
        count(And(pattern(g, ("?s", "n_region", "?o")), Filter(["?s", "?o"], lambda s, o: F.element_at(F.split(s, ":"), -1) == F.element_at(F.split(o, ":"), -1))), "n")
        .unionAll(count(And(pattern(g, ("?s", "c_nation", "?n")), pattern(g, ("?t", "s_nation", "?n")), Filter(["?s", "?t"], lambda s, t: F.element_at(F.split(s, ":"), -1) == F.element_at(F.split(t, ":"), -1))), "n"))
        .agg(F.sum("n").alias("count"))
    ),
)

# 46-47: joins on two columns

register("multicolumn-join-small", f"SELECT count(*) AS count FROM {SQL['d_toxic']} NATURAL JOIN {SQL['d_quality']}", lambda g: count(pattern(g, ("?s", "d_toxic", "?o"), ("?s", "d_quality", "?o"))))
register("multicolumn-join-large", f"SELECT count(*) AS count FROM {SQL['o_status']} NATURAL JOIN {SQL['o_urgent']}", lambda g: count(pattern(g, ("?s", "o_status", "?o"), ("?s", "o_urgent", "?o"))))

# 48-51: groups


def top_counts(c: Pattern, group: str) -> DataFrame:
    return assignments(c).df.groupBy(F.col(group).alias("object")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "object").limit(10)


register("group-by-count-object-high-multiplicity", f"SELECT v AS object, count(*) AS count FROM {SQL['o_status']} GROUP BY v ORDER BY count DESC, object LIMIT 10", lambda g: top_counts(pattern(g, ("?s", "o_status", "?o")), "o"))
register("group-by-count-object-low-multiplicity", f"SELECT 'part:' || v AS object, count(*) AS count FROM {SQL['o_part']} GROUP BY v ORDER BY count DESC, object LIMIT 10", lambda g: top_counts(pattern(g, ("?s", "o_part", "?o")), "o"))
register("group-by-count-object-wrong-sort-order", f"SELECT a AS object, count(*) AS count FROM {sql_of([('s', 'o_priority', 'a'), ('s', 'o_part', 'b')])} GROUP BY a ORDER BY count DESC, object LIMIT 10", lambda g: top_counts(pattern(g, ("?s", "o_priority", "?a"), ("?s", "o_part", "?b")), "a"))
register(
    "group-by-complex-aggregate",
    f"SELECT a AS object, count(*) AS count, 'order:' || min(s::VARCHAR) AS min, 'order:' || max(s::VARCHAR) AS max, 'order:' || min(s::VARCHAR) AS sample FROM {sql_of([('s', 'o_priority', 'a'), ('s', 'o_part', 'b')])} GROUP BY a ORDER BY count DESC, object LIMIT 10",
    lambda g: assignments(pattern(g, ("?s", "o_priority", "?a"), ("?s", "o_part", "?b"))).df.groupBy(F.col("a").alias("object")).agg(F.count(F.lit(1)).alias("count"), F.min("s").alias("min"), F.max("s").alias("max"), F.min("s").alias("sample")).orderBy(F.desc("count"), "object").limit(10),
)

# 52-60: aggregates without groups


def whole(name: str, predicate: str, aggregate: Callable[[Column], Column], sql: str, out: str) -> None:
    register(name, f"SELECT {sql} AS {out} FROM {SQL[predicate]}", lambda g: assignments(pattern(g, ("?s", predicate, "?o"))).df.agg(aggregate(F.col("o")).alias(out)))


def exact_sum(c: Column) -> Column:
    return F.sum(c).cast("bigint")


whole("group-by-implicit-numeric-baseline", "p_size", F.count, "count(v)", "count")
whole("group-by-implicit-numeric-sum", "p_size", exact_sum, "sum(v)::BIGINT", "sum")
whole("group-by-implicit-numeric-min", "p_size", F.min, "min(v)", "min")
whole("group-by-implicit-numeric-max", "p_size", F.max, "max(v)", "max")
whole("group-by-implicit-numeric-avg", "p_size", lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)), "coalesce(round(avg(v), 6), 0.0)", "avg")
whole("group-by-implicit-string-baseline", "c_name", F.count, "count(v)", "count")
whole("group-by-implicit-string-min", "c_name", F.min, "min(v)", "min")
whole("group-by-implicit-string-max", "c_name", F.max, "max(v)", "max")
register(
    "group-by-string-groupconcat",
    "SELECT sum(length(cat))::BIGINT AS sum FROM (SELECT string_agg(p_name, ' ') AS cat FROM part GROUP BY p_brand)",
    lambda g: find(["?b", "?n"], pattern(g, ("?s", "p_brand", "?b"), ("?s", "p_name", "?n"))).groupBy("b").agg(F.listagg("n", F.lit(" ")).alias("cat")).agg(exact_sum(F.length("cat")).alias("sum")),
)

# 61-63: distinct counts

whole("distinct-count-object-high-multiplicity", "o_status", F.countDistinct, "count(DISTINCT v)", "count")
whole("distinct-count-object-low-multiplicity", "o_part", F.countDistinct, "count(DISTINCT v)", "count")
register("distinct-count-object-wrong-sort-order", f"SELECT count(DISTINCT a) AS count FROM {sql_of([('s', 'o_priority', 'a'), ('s', 'o_part', 'b')])}", lambda g: where_exists(pattern(g, ("?s", "o_priority", "?a")), pattern(g, ("?s", "o_part", "?b"))).agg(F.countDistinct("a").alias("count")))

# 64-74: strings


def matching(name: str, condition: Callable[[Column], Column], sql: str) -> None:
    register(name, f"SELECT count(*) AS count FROM {SQL['d_text']} WHERE {sql}", lambda g: count(And(pattern(g, ("?s", "d_text", "?o")), Filter(["?o"], condition))))


matching("regex-3-contains", lambda c: c.contains("ing"), "contains(v, 'ing')")
matching("regex-3-fixed", lambda c: c.rlike("ing"), "regexp_matches(v, 'ing')")
matching("regex-3", lambda c: c.rlike("i.g"), "regexp_matches(v, 'i.g')")
matching("regex-prefix-1", lambda c: c.rlike("^T"), "regexp_matches(v, '^T')")
matching("regex-prefix-2", lambda c: c.rlike("^Th"), "regexp_matches(v, '^Th')")
matching("regex-prefix-3", lambda c: c.rlike("^The"), "regexp_matches(v, '^The')")
whole("strlen", "d_text", lambda c: exact_sum(F.length(c)), "sum(length(v))::BIGINT", "checksum")
whole("strbefore", "d_text", lambda c: exact_sum(F.length(text.before(c, "a"))), "sum(CASE WHEN instr(v, 'a') > 0 THEN instr(v, 'a') - 1 ELSE 0 END)::BIGINT", "checksum")
whole("strafter", "d_text", lambda c: exact_sum(F.length(text.after(c, "a"))), "sum(CASE WHEN instr(v, 'a') > 0 THEN length(v) - instr(v, 'a') ELSE 0 END)::BIGINT", "checksum")
whole("strstarts", "d_text", lambda c: exact_sum(c.startswith("T").cast("int")), "sum(starts_with(v, 'T')::INT)::BIGINT", "count")
whole("strends", "d_text", lambda c: exact_sum(c.endswith(".").cast("int")), "sum(ends_with(v, '.')::INT)::BIGINT", "count")

# 75-79: sizes of results

for _size, _n in (("tiny", 10), ("small", 1_000), ("medium", 100_000), ("large", 1_000_000), ("xlarge", 10_000_000)):
    register(f"result-size-{_size}", f"SELECT count(*) AS count FROM (SELECT * FROM {SQL['o_line']} LIMIT {_n})", lambda g, n=_n: find(["?s", "?o"], pattern(g, ("?s", "o_line", "?o"))).limit(n).agg(F.count(F.lit(1)).alias("count")))

# 80-89: numbers

whole("numeric-baseline", "p_size", exact_sum, "sum(v)::BIGINT", "sum")
whole("numeric-abs", "c_balance", lambda c: F.sum(F.abs(c).cast("decimal(18,2)")).cast("double"), "sum(abs(v)::DECIMAL(18,2))::DOUBLE", "sum")
whole("numeric-ceil", "c_balance", lambda c: exact_sum(F.ceil(c)), "sum(ceil(v))::BIGINT", "sum")
whole("numeric-floor", "c_balance", lambda c: exact_sum(F.floor(c)), "sum(floor(v))::BIGINT", "sum")
whole("numeric-round", "c_balance", lambda c: exact_sum(F.round(c)), "sum(round(v))::BIGINT", "sum")
whole("numeric-add", "p_size", lambda c: exact_sum(c + c), "sum(v + v)::BIGINT", "sum")
whole("numeric-greater", "p_size", lambda c: exact_sum((c > 0).cast("int")), "sum((v > 0)::INT)::BIGINT", "sum")
for _share, _least in (("fifty-fifty", 25), ("seventy-thirty", 35), ("ninetyfive-five", 48)):
    register(f"numeric-filter-bin-search-{_share}", f"SELECT count(e) AS count FROM {SQL['p_size']} WHERE v >= {_least}", lambda g, least=_least: count(And(pattern(g, ("?s", "p_size", "?o")), between("?o", least, 2**62))))

# 90-92: filters

register("filter-few-results", "SELECT count(*) AS count FROM nation WHERE n_nationkey = n_regionkey", lambda g: count(And(pattern(g, ("?s", "n_region", "?o")), Filter(["?s", "?o"], lambda s, o: F.regexp_replace(s, "^nation", "region") == o))))
register("filter-many-results", "SELECT count(*) AS count FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn > 0)", lambda g: count(And(pattern(g, ("?s", "t_follows", "?o")), different("?s", "?o"))))
register("filter-language-en", f"SELECT count(*) AS count FROM {SQL['d_text']} NATURAL JOIN (SELECT e, v AS w FROM {SQL['d_lang']}) WHERE w = 'en'", lambda g: count(pattern(g, ("?s", "d_text", "?o"), ("?s", "d_lang", "en"))))

# 93-95: dates

whole("date-year", "o_date", lambda c: exact_sum(F.year(c)), "sum(year(v))::BIGINT", "sum")
whole("date-month", "o_date", lambda c: exact_sum(F.month(c)), "sum(month(v))::BIGINT", "sum")
whole("date-day", "o_date", lambda c: exact_sum(F.day(c)), "sum(day(v))::BIGINT", "sum")

# 96-100: the whole set, which SQL lists attribute by attribute.

_REFERENCES = {"n_region": "region", "c_nation": "nation", "s_nation": "nation", "o_customer": "customer", "ev_user": "customer", "o_part": "part", "o_supplier": "supplier", "o_line": "line"}
_COLUMNS = {
    ("region", "region", "r_regionkey"): {"r_name": "r_name"},
    ("nation", "nation", "n_nationkey"): {"n_name": "n_name", "n_region": "n_regionkey"},
    ("customer", "customer", "c_custkey"): {"c_name": "c_name", "c_nation": "c_nationkey", "c_balance": "c_acctbal", "c_segment": "c_mktsegment"},
    ("supplier", "supplier", "s_suppkey"): {"s_name": "s_name", "s_nation": "s_nationkey", "s_balance": "s_acctbal"},
    ("part", "part", "p_partkey"): {"p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "p_size", "p_price": "p_retailprice"},
    ("order", "orders", "o_orderkey"): {"o_customer": "o_custkey", "o_status": "o_orderstatus", "o_total": "o_totalprice", "o_date": "o_orderdate", "o_priority": "o_orderpriority", "o_urgent": "CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END"},
    ("event", "events", "event_id"): {"ev_user": "user_id", "ev_type": "event_type", "ev_value": "value", "ev_time": "ts", "ev_props": "props"},
    ("doc", "documents", "doc_id"): {"d_text": "text", "d_lang": "lang", "d_source": "source", "d_chars": "n_chars"},
    ("doc", "labels", "doc_id"): {"d_quality": "quality", "d_toxic": "toxic"},
    ("page", "pages", "page_id"): {"pg_url": "url", "pg_html": "html"},
    ("vec", "embeddings", "vec_id"): {"vec": "embedding", "vec_label": "label"},
    ("order", SQL["o_part"], "e"): {"o_part": "v"},
    ("order", SQL["o_supplier"], "e"): {"o_supplier": "v"},
    ("order", SQL["o_line"], "e"): {"o_line": "v"},
    ("turn", "(SELECT conv_id || ':' || turn AS e, role AS v FROM conversations)", "e"): {"t_role": "v"},
}


def _listed() -> str:
    rows = [
        f"SELECT DISTINCT '{prefix}:' || {key} AS e, '{a}' AS a, {repr(_REFERENCES[a] + ':') + ' || ' if a in _REFERENCES else ''}({column})::VARCHAR AS v, {a not in _REFERENCES} AS literal FROM {source}"
        for (prefix, source, key), columns in _COLUMNS.items()
        for a, column in columns.items()
    ]
    follows = "SELECT DISTINCT 'turn:' || conv_id || ':' || turn, 't_follows', 'turn:' || conv_id || ':' || (turn - 1), false FROM conversations WHERE turn > 0"
    return f"(SELECT * FROM ({' UNION ALL '.join([*rows, follows])}) WHERE v IS NOT NULL)"


_ALL = _listed()


def every(g: FactSet) -> DataFrame:
    return assignments(pattern(g, ("?s", "?p", "?o"))).df


register("number-of-triples", f"SELECT count(*) AS count FROM {_ALL}", lambda g: every(g).agg(F.count(F.lit(1)).alias("count")))
register("number-of-subjects", f"SELECT count(DISTINCT e) AS count FROM {_ALL}", lambda g: every(g).agg(F.countDistinct("s").alias("count")))
register("number-of-predicates", f"SELECT count(DISTINCT a) AS count FROM {_ALL}", lambda g: every(g).agg(F.countDistinct("p").alias("count")))
register("number-of-objects", f"SELECT count(DISTINCT v) AS count FROM {_ALL}", lambda g: every(g).agg(F.countDistinct("o").alias("count")))
register("number-of-literals", f"SELECT count(*) AS count FROM {_ALL} WHERE literal", lambda g: every(g).where(~F.col("p").isin(*[n for n, a in g.attributes.items() if a.encoding == "id"])).agg(F.count(F.lit(1)).alias("count")))

# 101-104: paths

_EDGES = "edges AS (SELECT n_nationkey AS src, (7 * n_nationkey + 3) % 25 AS dst FROM nation)"
_REACH = f"WITH RECURSIVE {_EDGES}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src)"


def path(name: str, sql: str, query: Callable[[SparkSession, str, FactSet, DataFrame], DataFrame]) -> None:
    key = "suite_" + name.replace("-", "_")
    QUERIES[key] = lambda spark, sf_dir: query(spark, sf_dir, tables_as_facts(spark, sf_dir), nation_cycle(spark, sf_dir))
    ORACLES[key] = sql


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    return PathSummary.of(step("next").plus().compile(), edges).pairs(starts)


path("transitive-path-plus", f"{_REACH} SELECT count(*) AS count FROM reach", lambda s, d, g, e: closure(e).agg(F.count(F.lit(1)).alias("count")))
path("transitive-path-plus-fixed-subject", f"{_REACH} SELECT count(*) AS count FROM reach WHERE src = 1", lambda s, d, g, e: closure(e, s.createDataFrame([("nation:1",)], "x string")).agg(F.count(F.lit(1)).alias("count")))
path("transitive-path-large-join-and-plus", f"{_REACH} SELECT count(DISTINCT (c_custkey, dst)) AS count FROM customer JOIN reach ON c_nationkey = src", lambda s, d, g, e: find(["?c", "?n"], pattern(g, ("?c", "c_nation", "?n"))).join(closure(e), F.col("n") == F.col("start")).select("c", "end").distinct().agg(F.count(F.lit(1)).alias("count")))
path("transitive-path-small-join-and-plus", f"{_REACH} SELECT count(DISTINCT (s_suppkey, dst)) AS count FROM supplier JOIN reach ON s_nationkey = src", lambda s, d, g, e: find(["?c", "?n"], pattern(g, ("?c", "s_nation", "?n"))).join(closure(e), F.col("n") == F.col("start")).select("c", "end").distinct().agg(F.count(F.lit(1)).alias("count")))
