"""The data model: encodings, attributes, fact sets and entities.

A fact is (entity, attribute, value); a fact set is a set of facts.  It is kept
vertically: each attribute is either a column of a property table (one row an
entity, so a star of attributes is one scan) or a table of (e, v) pairs.  There
are no nulls: an absent value is an absent fact.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings


@dataclass(frozen=True)
class Encoding:
    """How values of an attribute are kept: Spark type, the Python types accepted, and whether their order is the values'."""

    name: str
    spark: str
    python: tuple[type, ...]
    ordered: bool = True
    check: Callable[[object], bool] = field(default=lambda v: True, compare=False)


def _interval(v: object) -> bool:
    return isinstance(v, tuple) and len(v) == 2 and v[0] <= v[1]


def _short(v: object) -> bool:
    return len(str(v).encode()) <= 32 and "\0" not in str(v)


ENCODINGS: dict[str, Encoding] = {
    e.name: e
    for e in (
        Encoding("id", "string", (str,)),
        Encoding("short_string", "string", (str,), check=_short),
        Encoding("text", "string", (str,)),
        Encoding("boolean", "boolean", (bool,)),
        Encoding("int", "bigint", (int,)),
        Encoding("int256", "decimal(38,0)", (int, decimal.Decimal)),
        Encoding("float", "double", (float, int), ordered=False),
        Encoding("rational", "struct<num:decimal(38,0),den:decimal(38,0)>", (tuple,), ordered=False),
        Encoding("money", "decimal(38,18)", (decimal.Decimal, int)),
        Encoding("interval", "struct<lower:timestamp,upper:timestamp>", (tuple,), check=_interval),
        Encoding("timestamp", "timestamp", (dt.datetime,)),
        Encoding("duration", "decimal(38,0)", (int, decimal.Decimal)),
        Encoding("range", "struct<start:decimal(38,0),end:decimal(38,0)>", (tuple,), check=_interval),
        Encoding("line_location", "struct<l0:bigint,c0:bigint,l1:bigint,c1:bigint>", (tuple,)),
        Encoding("hash", "binary", (bytes,), ordered=False),
        Encoding("vector", "array<float>", (list,), ordered=False),
        Encoding("tensor", "struct<dims:array<bigint>,data:array<float>>", (tuple,), ordered=False),
        Encoding("bytes", "binary", (bytes,)),
        Encoding("unknown", "string", (str,), ordered=False),
    )
}


def content_id(*parts: Column | bytes) -> Column | str:
    """The last 16 bytes of a SHA-256 digest, as 32 hex digits: of a column of bytes, or of bytes."""
    if all(isinstance(p, bytes) for p in parts):
        return hashlib.sha256(b"".join(parts)).hexdigest()[32:]  # type: ignore[arg-type]
    return F.substring(F.sha2(F.concat(*parts), 256), 33, 32)


@dataclass(frozen=True)
class Attribute:
    """A name with an encoding; the id depends on both, so one name with two encodings is two attributes."""

    name: str
    encoding: str
    multi: bool = False
    iri: str | None = None
    description: str = ""

    @property
    def id(self) -> str:
        return str(content_id(f"{self.iri or self.name}\0{self.encoding}".encode()))

    def check(self, value: object) -> None:
        """Raises if a Python value does not fit, before any job runs."""
        e = ENCODINGS[self.encoding]
        if not isinstance(value, e.python) or isinstance(value, bool) and bool not in e.python or not e.check(value):
            raise TypeError(f"{value!r} does not fit {self.name}, which is {self.encoding}")


# Fact sets


@dataclass(frozen=True)
class PropertyTable:
    """Entities as rows: ``prefix:key`` is the entity; every key occurs once."""

    df: DataFrame
    prefix: str
    key: str

    def entity(self) -> Column:
        return F.concat(F.lit(f"{self.prefix}:"), F.col(self.key).cast("string"))

    def is_entity(self, constant: str) -> Column:
        """A filter on the key column itself, which reaches the scan."""
        prefix, _, key = constant.partition(":")
        if prefix != self.prefix:
            return F.lit(False)
        kind = self.df.schema[self.key].dataType
        try:
            return F.col(self.key) == F.lit(int(key) if isinstance(kind, (T.LongType, T.IntegerType)) else key)
        except ValueError:
            return F.lit(False)


@dataclass(frozen=True)
class InTable:
    """An attribute's facts in a property table: a column expression; null is absent."""

    table: PropertyTable
    value: Column
    reference: PropertyTable | None = None

    def pairs(self) -> DataFrame:
        return self.table.df.select(self.table.entity().alias("e"), self.value.alias("v")).where("v is not null")


@dataclass(frozen=True)
class InPairs:
    """An attribute's facts as distinct (e, v) rows."""

    df: DataFrame

    def pairs(self) -> DataFrame:
        return self.df


def reference(prefix: str, column: str | Column) -> Column:
    """The entity that a key column refers to; null stays null."""
    return F.concat(F.lit(f"{prefix}:"), (F.col(column) if isinstance(column, str) else column).cast("string"))


class FactSet:
    """A set of facts, by attribute."""

    def __init__(self, attributes: Mapping[str, Attribute] | None = None, data: Mapping[str, InTable | InPairs] | None = None):
        self.attributes, self.data = dict(attributes or {}), dict(data or {})

    # Building

    def with_table(self, df: DataFrame, prefix: str, key: str, columns: Mapping[str, tuple[str, str | Column]]) -> FactSet:
        """Adds a table with a unique key: attribute -> (encoding, column); only what a query asks of it is read."""
        table = PropertyTable(df, prefix, key)
        attributes = {n: Attribute(n, e) for n, (e, _) in columns.items()}
        data = {n: InTable(table, F.col(c) if isinstance(c, str) else c) for n, (_, c) in columns.items()}
        return FactSet(self.attributes | attributes, self.data | data)

    def with_pairs(self, name: str, encoding: str, df: DataFrame, multi: bool = True, distinct: bool = True) -> FactSet:
        """Adds an attribute from a table of (e, v); rows are made distinct unless they are known to be."""
        pairs = df.select(F.col("e").cast("string").alias("e"), F.col("v")).where("e is not null and v is not null")
        return FactSet(self.attributes | {name: Attribute(name, encoding, multi)}, self.data | {name: InPairs(pairs.distinct() if distinct else pairs)})

    @staticmethod
    def from_rows(spark: SparkSession, attributes: Iterable[Attribute], rows: Iterable[tuple[str, str, object]]) -> FactSet:
        """A small fact set from (entity, attribute, value) rows."""
        known = {a.name: a for a in attributes}
        held: dict[str, set] = {n: set() for n in known}
        for e, a, v in rows:
            known[a].check(v)
            held[a].add((e, tuple(v) if isinstance(v, list) else v))
        out = FactSet(known)
        for n, a in known.items():
            df = spark.createDataFrame(sorted(held[n], key=repr), f"e string, v {ENCODINGS[a.encoding].spark}")
            out.data[n] = InPairs(df)
        return out

    def insert(self, spark: SparkSession, rows: Iterable[tuple[str, str, object]]) -> FactSet:
        rows = list(rows)
        return self.union(FactSet.from_rows(spark, [self.attributes[n] for n in {a for _, a, _ in rows}], rows))

    # Reading

    def pairs(self, name: str) -> DataFrame:
        if name not in self.data:
            raise KeyError(f"no attribute {name!r}")
        return self.data[name].pairs()

    def canonical(self) -> DataFrame:
        """All facts as (e, a, v): the value as text, for patterns with a free attribute."""

        def as_text(name: str) -> DataFrame:
            v = F.col("v")
            kind = ENCODINGS[self.attributes[name].encoding].spark
            text = F.hex(v) if kind == "binary" else F.to_json(v) if kind.startswith(("struct", "array")) else v.cast("string")
            return self.pairs(name).select("e", F.lit(name).alias("a"), text.alias("v"))

        if not self.data:
            raise ValueError("an empty schema has no facts to scan")
        return reduce(DataFrame.unionAll, (as_text(n) for n in self.data))

    def ordered(self) -> DataFrame:
        return self.canonical().orderBy("e", "a", "v")

    def contains(self, e: str, a: str, v: object) -> bool:
        return a in self.data and not self.pairs(a).where((F.col("e") == e) & (F.col("v") == F.lit(v))).limit(1).isEmpty()

    def count(self) -> int:
        return sum(self.pairs(n).count() for n in self.data)

    def is_empty(self) -> bool:
        return all(self.pairs(n).limit(1).isEmpty() for n in self.data)

    def entities_with(self, a: str, v: object, descending: bool = False) -> DataFrame:
        """Entities of an attribute and a value, in order."""
        e = F.col("e").desc() if descending else F.col("e").asc()
        return self.pairs(a).where(F.col("v") == F.lit(v)).select("e").orderBy(e)

    def fingerprint(self) -> DataFrame:
        """A token that equal sets share: count and an order-free digest per attribute."""
        return self.canonical().groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("e", "a", "v")).alias("digest"))

    def attributes_as_facts(self, spark: SparkSession) -> DataFrame:
        """The schema described as facts: name, encoding and multiplicity of each attribute."""
        rows = [(a.id, k, v) for a in self.attributes.values() for k, v in (("name", a.name), ("value_encoding", a.encoding), ("tag", "multi" if a.multi else "single"), ("description", a.description)) if v]
        return spark.createDataFrame(rows, "e string, a string, v string")

    # Ordered reads

    def domain(self, a: str, axis: str = "v", low: object = None, high: object = None) -> DataFrame:
        """The distinct entities (``e``) or values (``v``) of an attribute, within inclusive bounds if given, each with its number of facts ``n``."""
        c = F.col(axis)
        within = F.lit(True)
        for bound, holds in ((low, c.__ge__), (high, c.__le__)):
            if bound is not None:
                within = within & holds(F.lit(bound))
        return self.pairs(a).where(within).groupBy(axis).agg(F.count(F.lit(1)).alias("n"))

    def prefixes(self, a: str, length: int, start: str = "", axis: str = "v") -> DataFrame:
        """The distinct beginnings of ``length`` characters among texts that begin with ``start``, each with its number of distinct texts ``n``."""
        held = self.pairs(a).select(axis).where(F.startswith(F.col(axis), F.lit(start))).distinct()
        return held.groupBy(F.substring(axis, 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))

    def has_prefix(self, a: str, start: str, axis: str = "v") -> bool:
        return not self.pairs(a).where(F.startswith(F.col(axis), F.lit(start))).limit(1).isEmpty()

    # Set algebra

    def _both(self, other: FactSet) -> dict[str, Attribute]:
        for n in self.attributes.keys() & other.attributes.keys():
            if self.attributes[n].encoding != other.attributes[n].encoding:
                raise TypeError(f"{n} has two encodings")
        return self.attributes | other.attributes

    def union(self, other: FactSet) -> FactSet:
        data = {n: InPairs(self.pairs(n).unionByName(other.pairs(n)).distinct()) if n in self.data and n in other.data else (self.data | other.data)[n] for n in self.data | other.data}
        return FactSet(self._both(other), data)

    __add__ = union

    def intersect(self, other: FactSet) -> FactSet:
        self._both(other)
        return FactSet(self.attributes, {n: InPairs(self.pairs(n).intersect(other.pairs(n))) for n in self.data if n in other.data})

    def difference(self, other: FactSet) -> FactSet:
        self._both(other)
        return FactSet(self.attributes, {n: InPairs(self.pairs(n).subtract(other.pairs(n))) if n in other.data else d for n, d in self.data.items()})

    def where_entity(self, condition: Callable[[Column], Column]) -> FactSet:
        return FactSet(self.attributes, {n: InPairs(self.pairs(n).where(condition(F.col("e")))) for n in self.data})


# Entities and fragments


def entity(attributes: Mapping[str, Attribute], values: Mapping[str, object], id: str | None = None, namespace: bytes = b"") -> tuple[str, list[tuple[str, str, object]]]:
    """An entity's id and facts.  ``name?`` skips None, ``name*`` repeats over a list; without an id the facts' content gives one."""
    facts: list[tuple[str, object]] = []
    for name, value in values.items():
        if name.endswith("?"):
            facts += [] if value is None else [(name[:-1], value)]
        elif name.endswith("*"):
            facts += [(name[:-1], v) for v in value]  # type: ignore[union-attr]
        else:
            facts.append((name, value))
    for name, value in facts:
        attributes[name].check(value)
    if id is None:
        rows = sorted({f"{attributes[n].id}\0{v!r}".encode() for n, v in facts})
        id = str(content_id(namespace, *[len(r).to_bytes(8, "big") + r for r in rows]))
    return id, [(id, n, v) for n, v in facts]


@dataclass(frozen=True)
class Fragment:
    """Facts with the entities they export, their description and blobs; fragments add up."""

    facts: FactSet
    exports: tuple[str, ...] = ()
    metafacts: FactSet = field(default_factory=FactSet)
    blobs: DataFrame | None = None

    def __add__(self, other: Fragment) -> Fragment:
        blobs = [b for b in (self.blobs, other.blobs) if b is not None]
        return replace(self, facts=self.facts + other.facts, exports=tuple(dict.fromkeys(self.exports + other.exports)), metafacts=self.metafacts + other.metafacts, blobs=reduce(lambda a, b: a.unionByName(b).distinct(), blobs) if blobs else None)
