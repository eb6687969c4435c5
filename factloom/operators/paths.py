"""Regular paths over labelled edges.

An expression compiles to an automaton without empty steps (positions of its
steps are states, 0 is the start).  Edges and matching transitions give the arcs
of the product graph, whose closure is semi-naive: each round joins the newest
triples with the arcs and keeps what was not seen.  Rounds are written to the
shared folder, so plans stay short and lost executors cost one round.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.model import content_id
from factloom.sources.scratch import stored


@dataclass(frozen=True)
class Step:
    """An edge with one of ``labels``, or with none of them (``excluded``), forward or backward."""

    labels: tuple[str, ...]
    backward: bool = False
    excluded: bool = False

    def matches(self) -> Column:
        named = F.col("label").isin(*self.labels) if self.labels else F.lit(False)
        return ~named if self.excluded else named


@dataclass(frozen=True)
class Expr:
    """A path expression."""

    kind: str
    parts: tuple = ()

    def then(self, other: Expr) -> Expr:
        return Expr("then", (self, other))

    def or_(self, other: Expr) -> Expr:
        return Expr("or", (self, other))

    def star(self) -> Expr:
        return Expr("star", (self,))

    def plus(self) -> Expr:
        return Expr("plus", (self,))

    def optional(self) -> Expr:
        return Expr("optional", (self,))

    def inverse(self) -> Expr:
        if self.kind == "step":
            s = self.parts[0]
            return Expr("step", (Step(s.labels, not s.backward, s.excluded),))
        parts = tuple(p.inverse() for p in self.parts)
        return Expr(self.kind, parts[::-1] if self.kind == "then" else parts)

    def compile(self) -> Automaton:
        steps: list[Step] = []
        follow: set[tuple[int, int]] = set()

        def walk(e: Expr) -> tuple[bool, set[int], set[int]]:
            """Whether it matches nothing at all, and the positions that it starts and ends with."""
            if e.kind == "step":
                steps.append(e.parts[0])
                return False, {len(steps)}, {len(steps)}
            found = [walk(p) for p in e.parts]
            if e.kind == "then":
                (n1, f1, l1), (n2, f2, l2) = found
                follow.update((a, b) for a in l1 for b in f2)
                return n1 and n2, f1 | f2 if n1 else f1, l1 | l2 if n2 else l2
            if e.kind == "or":
                return any(n for n, _, _ in found), set().union(*(f for _, f, _ in found)), set().union(*(x for _, _, x in found))
            n, f, l = found[0]
            if e.kind in ("star", "plus"):
                follow.update((a, b) for a in l for b in f)
            return n or e.kind in ("star", "optional"), f, l

        nullable, first, last = walk(self)
        arcs = [(0, p, steps[p - 1]) for p in sorted(first)] + [(a, b, steps[b - 1]) for a, b in sorted(follow)]
        return Automaton(len(steps) + 1, frozenset([0]), frozenset(last) | (frozenset([0]) if nullable else frozenset()), tuple(arcs))


def step(*labels: str) -> Expr:
    return Expr("step", (Step(labels),))


def any_but(*labels: str) -> Expr:
    """A step over any label but these; without labels, over any."""
    return Expr("step", (Step(labels, excluded=True),))


@dataclass(frozen=True)
class Automaton:
    states: int
    initial: frozenset[int]
    accepting: frozenset[int]
    transitions: tuple[tuple[int, int, Step], ...]

    def __post_init__(self) -> None:
        used = self.initial | self.accepting | {s for a, b, _ in self.transitions for s in (a, b)}
        if not self.initial or any(not 0 <= s < self.states for s in used):
            raise ValueError("an automaton needs an initial state, and states within its number")

    @property
    def nullable(self) -> bool:
        return bool(self.initial & self.accepting)


@dataclass(frozen=True)
class PathSummary:
    """Product arcs of some edges; summaries of the same automaton merge before they are closed."""

    automaton: Automaton
    arcs: DataFrame
    vertices: DataFrame

    @staticmethod
    def of(automaton: Automaton, edges: DataFrame) -> PathSummary:
        """``edges``: src, label, dst."""
        arcs = [edges.where(s.matches()).select(F.col("dst" if s.backward else "src").alias("u"), F.lit(a).alias("p"), F.col("src" if s.backward else "dst").alias("w"), F.lit(b).alias("q")) for a, b, s in automaton.transitions]
        every = edges.select(F.col("src").alias("x")).unionByName(edges.select(F.col("dst").alias("x"))).distinct()
        none = edges.select(F.col("src").alias("u"), F.lit(0).alias("p"), F.col("dst").alias("w"), F.lit(0).alias("q")).where(F.lit(False))
        return PathSummary(automaton, reduce(DataFrame.unionByName, arcs, none).distinct(), every)

    def merge(self, other: PathSummary) -> PathSummary:
        if self.automaton != other.automaton:
            raise ValueError("summaries of different automata")
        return PathSummary(self.automaton, self.arcs.unionByName(other.arcs).distinct(), self.vertices.unionByName(other.vertices).distinct())

    def pairs(self, starts: DataFrame | None = None) -> DataFrame:
        """Accepted (start, end) pairs, distinct; from ``starts`` (one column) only if given."""
        a = self.automaton
        arcs = stored(self.arcs, "arcs")
        begin = arcs.where(F.col("p").isin(*a.initial)).select(F.col("u").alias("start"), F.col("w").alias("at"), F.col("q").alias("state"))
        if starts is not None:
            begin = begin.join(starts.toDF("start").distinct(), "start", "left_semi")
        newest = stored(begin.distinct(), "reached")
        rounds = [newest]
        while not newest.isEmpty():
            further = newest.join(arcs, (F.col("at") == F.col("u")) & (F.col("state") == F.col("p"))).select("start", F.col("w").alias("at"), F.col("q").alias("state")).distinct()
            seen = reduce(DataFrame.unionByName, rounds)
            newest = stored(further.join(seen, ["start", "at", "state"], "left_anti"), "reached")
            rounds.append(newest)
            if len(rounds) > 16:
                rounds = [stored(reduce(DataFrame.unionByName, rounds), "seen")]
        reached = reduce(DataFrame.unionByName, rounds).where(F.col("state").isin(*a.accepting)).select("start", F.col("at").alias("end"))
        if a.nullable:
            identity = self.vertices if starts is None else self.vertices.join(starts.toDF("x").distinct(), "x", "left_semi")
            reached = reached.unionByName(identity.select(F.col("x").alias("start"), F.col("x").alias("end")))
        return reached.distinct()


class PathIndex:
    """Accepted pairs of an expression over edges, and reads of them."""

    def __init__(self, summary: PathSummary, starts: DataFrame | None = None):
        self.summary = summary
        self.accepted = stored(summary.pairs(starts), "accepted-pairs")

    @staticmethod
    def from_edges(expression: Expr | Automaton, *edges: DataFrame) -> PathIndex:
        """An index over the union of edge sets, merged before they are closed."""
        if not edges:
            raise ValueError("no edges to index")
        automaton = expression if isinstance(expression, Automaton) else expression.compile()
        return PathIndex(reduce(PathSummary.merge, (PathSummary.of(automaton, e) for e in edges)))

    @property
    def fingerprint(self) -> str:
        """What the automaton and the source's arcs and vertices are told apart by."""
        a = self.summary.automaton
        said = (a.states, sorted(a.initial), sorted(a.accepting), sorted(map(repr, a.transitions)))
        sums = [df.agg(F.count(F.lit(1)), *(F.sum(F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)")) for seed in (1, 2))).first() for df in (self.summary.arcs, self.summary.vertices)]
        return str(content_id(repr((said, *map(tuple, sums))).encode()))

    @staticmethod
    def ensure(path: str, expression: Expr | Automaton, *edges: DataFrame) -> PathIndex:
        """The index kept under ``path`` for just these edges and this expression; it is closed and written if there is none."""
        if not edges:
            raise ValueError("no edges to index")
        automaton = expression if isinstance(expression, Automaton) else expression.compile()
        index = PathIndex.__new__(PathIndex)
        index.summary = reduce(PathSummary.merge, (PathSummary.of(automaton, e) for e in edges))
        at = f"{path}/{index.fingerprint}"
        spark = edges[0].sparkSession
        jvm = spark._jvm
        done = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            index.summary.pairs().sortWithinPartitions("start", "end").write.mode("overwrite").parquet(at)
        index.accepted = spark.read.schema("start string, end string").parquet(at)
        return index

    def contains(self, start: str, end: str) -> bool:
        return not self.accepted.where((F.col("start") == start) & (F.col("end") == end)).limit(1).isEmpty()

    def reachable_from(self, start: str) -> DataFrame:
        return self.accepted.where(F.col("start") == start).select("end")

    def reaching(self, end: str) -> DataFrame:
        return self.accepted.where(F.col("end") == end).select("start")

    def starts(self) -> DataFrame:
        return self.accepted.select("start").distinct()

    def ends(self) -> DataFrame:
        return self.accepted.select("end").distinct()

    def diagonal(self) -> DataFrame:
        return self.accepted.where("start = end").select("start")

    def counts(self) -> tuple[int, int]:
        return self.summary.vertices.count(), self.accepted.count()
