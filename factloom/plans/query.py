"""Patterns with shared variables, compiled to DataFrames.

The answer of ``find(head, constraint)`` is a bag: one row for each complete
assignment of the constraint's variables, projected on the head.  Sources are
sets, so they join naturally without ``distinct``; only ``Or`` is made distinct,
over its variables.  Hidden variables stay columns until the projection.

A variable is written ``"?x"``; ``"_?x"`` is local to its pattern.  Any other
term is a constant.
"""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.model import ENCODINGS, FactSet, InPairs, InTable

_fresh = itertools.count()


def is_variable(term: object) -> bool:
    return isinstance(term, str) and term.startswith(("?", "_?"))


@dataclass(frozen=True)
class Relation:
    """A set of assignments of ``names``: a column each."""

    df: DataFrame
    names: frozenset[str]
    #: Variables that determine a row, where a property table says so.
    key: frozenset[str] | None = None


@dataclass(frozen=True)
class Condition:
    """A filter over variables that other constraints bind."""

    names: frozenset[str]
    apply: Callable[[DataFrame], DataFrame]


Parts = tuple[list[Relation], list[Condition]]


class Constraint:
    def parts(self) -> Parts:
        raise NotImplementedError

    def variables(self) -> frozenset[str]:
        relations, conditions = self.parts()
        return frozenset().union(*(p.names for p in (*relations, *conditions)))

    def __and__(self, other: Constraint) -> Constraint:
        return And(self, other)

    def __or__(self, other: Constraint) -> Constraint:
        return Or(self, other)


# Sources


@dataclass
class Pattern(Constraint):
    """Clauses (entity, attribute, value) over one fact set."""

    facts: FactSet
    clauses: Sequence[tuple[object, object, object]]
    _local: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for _, a, v in self.clauses:
            if not is_variable(a):
                if a not in self.facts.attributes:
                    raise KeyError(f"no attribute {a!r}")
                if not is_variable(v):
                    self.facts.attributes[a].check(v)

    def _term(self, term: object) -> object:
        if term is None:  # an anonymous entity
            return f"?_anon{next(_fresh)}"
        if isinstance(term, str) and term.startswith("_?"):
            return self._local.setdefault(term, f"?_local{next(_fresh)}_{term[2:]}")
        return term

    def parts(self) -> Parts:
        clauses = [tuple(self._term(t) for t in c) for c in self.clauses]
        stars: dict[tuple, list[tuple]] = {}
        relations = []
        for e, a, v in clauses:
            data = None if is_variable(a) else self.facts.data[a]
            if isinstance(data, InTable):
                stars.setdefault((e, id(data.table)), []).append((a, v))
            else:
                df = self.facts.canonical() if data is None else data.pairs()
                terms = [("e", e), ("v", v)] if data is not None else [("e", e), ("a", a), ("v", v)]
                relations.append(bound(df, [(F.col(c), t) for c, t in terms]))
        for (e, _), members in stars.items():
            table = self.facts.data[members[0][0]].table
            df = table.df if is_variable(e) else table.df.where(table.is_entity(e))
            values = [(self.facts.data[a].value, v) for a, v in members]
            # One scan for the whole star: the key is unique, so no join is needed.
            df = df.where(reduce(Column.__and__, (c.isNotNull() for c, _ in values)))
            star = bound(df, [(table.entity(), e), *values] if is_variable(e) else values)
            relations.append(replace(star, key=frozenset([e[1:]] if is_variable(e) else [])))
        return relations, []


def bound(df: DataFrame, terms: Sequence[tuple[Column, object]]) -> Relation:
    """``df`` with its columns matched to terms: constants and repeated variables filter, the rest are named."""
    named: dict[str, Column] = {}
    for column, term in terms:
        if not is_variable(term):
            df = df.where(column == F.lit(term))
        elif term in named:
            df = df.where(column == named[term])
        else:
            named[term] = column
    names = [n[1:] for n in named]
    if not named:  # all constant: one unit row if there is any
        return Relation(df.select(F.lit(True).alias("_unit")).limit(1), frozenset())
    return Relation(df.select(*[c.alias(n) for n, c in zip(names, named.values(), strict=True)]), frozenset(names))


@dataclass
class Has(Constraint):
    """Membership of a variable in a collection, in a mapping's keys, or in a one-column table; a set in any case."""

    spark: SparkSession
    variable: str
    values: Iterable | DataFrame
    kind: str = "string"

    def parts(self) -> Parts:
        name = self.variable[1:]
        if isinstance(self.values, DataFrame):
            df = self.values.toDF(name).where(F.col(f"`{name}`").isNotNull()).distinct()
        else:
            df = self.spark.createDataFrame([(v,) for v in set(self.values)], f"`{name}` {self.kind}")
        return [Relation(df, frozenset([name]))], []


@dataclass
class Source(Constraint):
    """A user's relation: ``build`` makes a DataFrame with a column for each variable; it is made a set."""

    names: Sequence[str]
    build: Callable[[], DataFrame]
    is_set: bool = False

    def parts(self) -> Parts:
        names = [n[1:] for n in self.names]
        if len(set(names)) < len(names):  # one variable twice: the diagonal
            df = self.build()
            return [bound(df, [(F.col(c), n) for c, n in zip(df.columns, self.names, strict=True)])], []
        df = self.build().toDF(*names)
        return [Relation(df if self.is_set else df.distinct(), frozenset(names))], []


@dataclass
class Is(Constraint):
    """A variable that is a constant."""

    spark: SparkSession
    variable: str
    value: object

    def parts(self) -> Parts:
        name = self.variable[1:]
        return [Relation(self.spark.range(1).select(F.lit(self.value).alias(name)), frozenset([name]))], []


@dataclass
class InRange(Constraint):
    """Values (of any attribute), entities or attributes of a fact set between two bounds, inclusive, as a source."""

    facts: FactSet
    variable: str
    low: object
    high: object
    axis: str = "v"
    attribute: str | None = None

    def parts(self) -> Parts:
        within = F.col(self.axis).between(F.lit(self.low), F.lit(self.high))
        if self.attribute is not None:
            df = self.facts.pairs(self.attribute).where(within)
        elif self.axis == "v":
            # Values compare in their own type; attributes of another type hold nothing between the bounds.
            fits = [n for n in self.facts.data if comparable(ENCODINGS[self.facts.attributes[n].encoding].spark, self.low, self.high)]
            df = FactSet({n: self.facts.attributes[n] for n in fits}, {n: InPairs(self.facts.pairs(n).where(within)) for n in fits})
            if not fits:
                df = self.facts.canonical().where(F.lit(False))
            else:
                df = df.canonical()
        else:
            df = self.facts.canonical().where(within)
        name = self.variable[1:]
        return [Relation(df.select(F.col(self.axis).alias(name)).distinct(), frozenset([name]))], []


def comparable(kind: str, *bounds: object) -> bool:
    """Whether values of a Spark type compare with the bounds as they are."""
    of = {bool: ("boolean",), str: ("string",), bytes: ("binary",), dt.datetime: ("timestamp",), dt.date: ("date",)}
    numbers = ("tinyint", "smallint", "int", "bigint", "long", "float", "double", "decimal")
    return all(kind.startswith(of.get(type(x), numbers if isinstance(x, (int, float, Decimal)) else ())) for x in bounds)


# Conditions


@dataclass
class Filter(Constraint):
    """A condition over variables; it binds none."""

    names: Sequence[str]
    condition: Callable[..., Column]

    def parts(self) -> Parts:
        names = [n[1:] for n in self.names]
        return [], [Condition(frozenset(names), lambda df: df.where(self.condition(*[F.col(f"`{n}`") for n in names])))]


def between(variable: str, low: object, high: object) -> Filter:
    return Filter([variable], lambda v: v.between(F.lit(low), F.lit(high)))


def equal(a: str, b: str) -> Filter:
    return Filter([a, b], lambda x, y: x == y)


def different(a: str, b: str) -> Filter:
    return Filter([a, b], lambda x, y: x != y)


@dataclass
class Among(Constraint):
    """A variable restricted to (or kept out of) a one-column table, as a semi- or anti-join."""

    variable: str
    values: DataFrame
    negated: bool = False

    def parts(self) -> Parts:
        name = self.variable[1:]
        how = "left_anti" if self.negated else "left_semi"
        return [], [Condition(frozenset([name]), lambda df: df.join(self.values.toDF(name), name, how))]


# Composition


class And(Constraint):
    def __init__(self, *members: Constraint):
        self.members = members

    def parts(self) -> Parts:
        relations, conditions = [], []
        for m in self.members:
            r, c = m.parts()
            relations += r
            conditions += c
        return relations, conditions


class Or(Constraint):
    """The set union of arms over the same variables."""

    def __init__(self, *arms: Constraint):
        self.arms = arms

    def parts(self) -> Parts:
        found = [assignments(a) for a in self.arms]
        shown = {frozenset(n for n in r.names if not n.startswith("_")) for r in found}
        if len(shown) > 1:
            raise ValueError(f"arms bind different variables: {sorted(map(sorted, shown))}")
        names = sorted(shown.pop())
        # Variables that one arm hides belong to that arm's assignments; they don't join with anything.
        df = reduce(DataFrame.unionByName, (r.df.select(*names) for r in found)).distinct()
        return [Relation(df, frozenset(names))], []


class Temp(Constraint):
    """Variables that exist inside only: equal names outside are others."""

    def __init__(self, variables: Sequence[str], inner: Constraint):
        self.renamed = {v[1:]: f"_temp{next(_fresh)}_{v[1:]}" for v in variables}
        self.inner = inner

    def parts(self) -> Parts:
        r = assignments(self.inner)
        df = r.df.select(*[F.col(f"`{n}`").alias(self.renamed.get(n, n)) for n in r.names])
        return [Relation(df, frozenset(self.renamed.get(n, n) for n in r.names))], []


def joined(relations: Sequence[Relation]) -> Relation:
    """Natural joins; a relation that shares a variable comes before one that doesn't."""
    rest = [r for r in relations if r.names]
    guards = [r for r in relations if not r.names]
    if not rest:
        out = reduce(lambda a, b: Relation(a.df.join(b.df.withColumnRenamed("_unit", "_other"), F.lit(True), "left_semi"), frozenset()), guards)
        return out
    out = rest.pop(0)
    while rest:
        k = next((k for k, r in enumerate(rest) if r.names & out.names), 0)
        r = rest.pop(k)
        shared = sorted(r.names & out.names)
        # Whether a row of one meets one row of the other at most.
        one_right, one_left = r.key is not None and r.key <= out.names, out.key is not None and out.key <= r.names
        if shared and None not in (out.key, r.key) and not one_right and not one_left:
            df = many_to_many(out.df, r.df, shared)
        else:
            df = out.df.join(r.df, shared) if shared else out.df.crossJoin(r.df)
        out = Relation(df, out.names | r.names, out.key if one_right else r.key if one_left else None)
    for g in guards:
        out = Relation(out.df.join(g.df, F.lit(True), "left_semi"), out.names, out.key)
    return out


#: Tasks that the rows of one value are dealt to, where many rows meet many.
DEALT = 16


def many_to_many(a: DataFrame, b: DataFrame, shared: list[str]) -> DataFrame:
    """The natural join of tables whose shared variables are no key of either, so that the result may be far larger than both.

    Left to Spark, a value's whole product is one task's, or all products are if
    one file of ``a`` is one task.  Here ``a`` is dealt by value and number, and
    each number has its own copy of ``b``.
    """
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    own = "_dealt"
    left = a.withColumn(own, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in a.columns]), F.lit(DEALT)))
    right = b.withColumn(own, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DEALT - 1).cast("bigint"))))
    by = [*[F.col(f"`{c}`") for c in shared], F.col(own)]
    # A stated number of partitions, as few bytes of input would be made few tasks.
    return left.repartition(tasks, *by).join(right.repartition(tasks, *by), [*shared, own]).drop(own)


def assignments(constraint: Constraint) -> Relation:
    """All assignments that satisfy a constraint."""
    relations, conditions = constraint.parts()
    if not relations:
        raise ValueError("nothing binds the variables " + ", ".join(sorted(constraint.variables())))
    out = joined(relations)
    for c in conditions:
        if not c.names <= out.names:
            return Relation(out.df.where(F.lit(False)), out.names)  # no source for a filtered variable: no assignment
        out = Relation(c.apply(out.df), out.names)
    return out


# Questions


def find(head: Sequence[str | tuple[str, str]] | str, constraint: Constraint) -> DataFrame:
    """The bag of the head's values.  ``("?x", "bigint")`` drops values that don't convert, ``("?x", "bigint?")`` reports them."""
    items = [head] if isinstance(head, str) else list(head)
    names = [(h if isinstance(h, str) else h[0])[1:] for h in items]
    if len(set(names)) < len(names):
        raise ValueError(f"a variable is projected twice: {names}")
    found = assignments(constraint)
    if missing := set(names) - found.names:
        raise ValueError(f"not bound: {sorted(missing)}")
    df, columns = found.df, []
    for h, n in zip(items, names, strict=True):
        column = F.col(f"`{n}`")
        if not isinstance(h, str):
            kind = h[1].removesuffix("?")
            value = F.expr(f"try_cast(`{n}` AS {kind})")
            if h[1].endswith("?"):
                column = F.struct(value.isNotNull().alias("ok"), value.alias("value"), F.when(value.isNull(), F.concat(F.lit(f"not a {kind}: "), column.cast("string"))).alias("error"))
            else:
                df = df.where(value.isNotNull())
                column = value
        columns.append(column.alias(n))
    return df.select(*columns) if columns else df.select(F.lit(True).alias("_unit"))


def count(constraint: Constraint, name: str = "count") -> DataFrame:
    """The number of assignments, as one row."""
    return assignments(constraint).df.agg(F.count(F.lit(1)).alias(name))


def exists(constraint: Constraint) -> bool:
    return not assignments(constraint).df.limit(1).isEmpty()


def where_exists(left: Constraint, right: Constraint) -> DataFrame:
    """Assignments of ``left`` that some assignment of ``right`` agrees with."""
    return _beside(left, right, "left_semi")


def where_not_exists(left: Constraint, right: Constraint) -> DataFrame:
    """Assignments of ``left`` that no assignment of ``right`` agrees with."""
    return _beside(left, right, "left_anti")


def with_optional(left: Constraint, right: Constraint) -> DataFrame:
    """Assignments of ``left``, each with those of ``right`` that agree, or once with nulls."""
    return _beside(left, right, "left")


def _beside(left: Constraint, right: Constraint, how: str) -> DataFrame:
    a, b = assignments(left), assignments(right)
    shared = sorted(a.names & b.names)
    if not shared:
        raise ValueError("the two sides share no variable")
    return a.df.join(b.df if how == "left" else b.df.select(*shared), shared, how)


def pattern(facts: FactSet, *clauses: tuple[object, object, object]) -> Pattern:
    return Pattern(facts, clauses)
