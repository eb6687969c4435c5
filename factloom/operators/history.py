"""Commit history: a DAG of commits that each carry facts, branches, and selectors.

Tables live in one folder as Parquet: ``commits`` (id, message, author, created_at,
merge), ``parents`` (id, parent), ``facts`` (commit, e, a, v) and ``metafacts``.
Appends never rewrite.  A branch is a numbered series of heads; writing the next
number fails if another writer took it, which is the compare-and-set of a push.
That needs a file system that creates a file only if there is none in one step
(local disks and HDFS do; most object stores don't, so push from one writer there).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from factloom.operators.model import content_id
from factloom.sources.scratch import stored

COMMITS = "id string, message string, author string, created_at timestamp, merge boolean"
PARENTS = "id string, parent string"
FACTS = "commit string, e string, a string, v string"


def set_digest(facts: DataFrame) -> Row:
    """What tells sets of (e, a, v) apart: their size and the sums of two independent hashes of the distinct facts."""
    distinct = facts.select("e", "a", F.col("v").cast("string").alias("v")).distinct()
    sums = [F.sum(F.xxhash64(F.lit(seed), "e", "a", "v").cast("decimal(38,0)")) for seed in (1, 2)]
    return distinct.agg(F.count(F.lit(1)), *sums).first()


class Conflict(Exception):
    """The branch has moved on."""


@dataclass
class Repository:
    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        jvm, fs = self._fs()
        return fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"))

    def table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._exists(name) else self.spark.createDataFrame([], schema)

    @property
    def commits(self) -> DataFrame:
        return self.table("commits", COMMITS)

    @property
    def parents_table(self) -> DataFrame:
        return self.table("parents", PARENTS)

    @property
    def facts(self) -> DataFrame:
        return self.table("facts", FACTS)

    @property
    def metafacts(self) -> DataFrame:
        return self.table("metafacts", FACTS)

    # Branches

    def _heads(self, name: str) -> list[int]:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/branches/{name}")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def head(self, name: str) -> str | None:
        numbers = self._heads(name)
        if not numbers:
            raise KeyError(f"no branch {name!r}")
        jvm, fs = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/branches/{name}/{numbers[-1]}"))
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or None
        finally:
            stream.close()

    def _set_head(self, name: str, number: int, commit: str | None) -> None:
        jvm, fs = self._fs()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/branches/{name}/{number}")
        try:
            out = fs.create(target, False)
        except Py4JJavaError as e:
            # Other failures (permissions, the network) are no conflict and must not be tried again for ever.
            if fs.exists(target):
                raise Conflict(f"{name} has moved on") from e
            raise
        try:
            out.write(bytearray((commit or "").encode()))
        finally:
            out.close()

    def create_branch(self, name: str, commit: str | None = None) -> None:
        self._set_head(name, 0, commit)

    def ensure_branch(self, name: str) -> str | None:
        if not self._heads(name):
            self.create_branch(name)
        return self.head(name)

    def branches(self) -> list[str]:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/branches")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def pull(self, name: str) -> Workspace:
        return Workspace(self, name, self._heads(name)[-1], self.head(name))

    # Writing

    def write_commit(self, facts: DataFrame | None, message: str, parents: list[str], author: str = "", created_at: dt.datetime | None = None, metafacts: DataFrame | None = None) -> str:
        """Appends a commit; ``facts`` are (e, a, v) rows.  Its id follows from what it holds."""
        digest = "".join("-" if df is None else str(tuple(set_digest(df))) for df in (facts, metafacts))
        stamp = created_at or (dt.datetime.now(dt.UTC).replace(tzinfo=None) if facts is not None else None)
        id = str(content_id("\0".join([digest, message, author, str(stamp), *sorted(parents)]).encode()))
        for name, df in (("facts", facts), ("metafacts", metafacts)):
            if df is not None:
                df.select(F.lit(id).alias("commit"), "e", "a", F.col("v").cast("string").alias("v")).distinct().write.mode("append").parquet(f"{self.path}/{name}")
        self.spark.createDataFrame([(id, p) for p in parents], PARENTS).write.mode("append").parquet(f"{self.path}/parents")
        # The commit's row comes last: until it is there the commit does not exist.
        self.spark.createDataFrame([(id, message, author, stamp, facts is None)], COMMITS).write.mode("append").parquet(f"{self.path}/commits")
        return id

    # Selectors: tables of one column, id

    def select(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in set(ids)], "id string")

    def parents(self, selection: DataFrame) -> DataFrame:
        return selection.join(self.parents_table, "id").select(F.col("parent").alias("id")).distinct()

    def nth_ancestors(self, selection: DataFrame, n: int) -> DataFrame:
        for _ in range(n):
            selection = self.parents(selection)
        return selection

    def _walk(self, selection: DataFrame, stop: DataFrame | None) -> DataFrame:
        """Everything that is reached through parents, without passing ``stop``."""
        parents = stored(self.parents_table, "parents")
        newest = stored(selection.distinct() if stop is None else selection.distinct().join(stop, "id", "left_anti"), "walk")
        rounds = [newest]
        while not newest.isEmpty():
            further = newest.join(parents, "id").select(F.col("parent").alias("id")).distinct()
            for known in [reduce(DataFrame.unionByName, rounds), *([] if stop is None else [stop])]:
                further = further.join(known, "id", "left_anti")
            newest = stored(further, "walk")
            rounds.append(newest)
            if len(rounds) > 16:
                rounds = [stored(reduce(DataFrame.unionByName, rounds), "walked")]
        return reduce(DataFrame.unionByName, rounds)

    def ancestors(self, selection: DataFrame) -> DataFrame:
        """The selection and all before it."""
        return self._walk(selection, None)

    def range(self, start: DataFrame | None, end: DataFrame) -> DataFrame:
        """From ``end`` back to, and without, the commits of ``start``: the walk stops there, other ways round them go on."""
        return self._walk(end, start)

    def symmetric_difference(self, a: DataFrame, b: DataFrame) -> DataFrame:
        x, y = stored(self.ancestors(a), "ancestors"), stored(self.ancestors(b), "ancestors")
        return x.join(y, "id", "left_anti").unionByName(y.join(x, "id", "left_anti"))

    @staticmethod
    def union(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).distinct()

    @staticmethod
    def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.intersect(b)

    @staticmethod
    def difference(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.subtract(b)

    def filter(self, selection: DataFrame, condition: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Commits of the selection that ``condition`` keeps, of the commits table."""
        return condition(self.commits.join(selection, "id", "left_semi")).select("id")

    def history_of(self, entity: str, selection: DataFrame | None = None) -> DataFrame:
        touched = self.facts.where(F.col("e") == entity).select(F.col("commit").alias("id")).distinct()
        return touched if selection is None else touched.join(selection, "id", "left_semi")

    def time_range(self, start: dt.datetime, end: dt.datetime) -> DataFrame:
        """Commits stamped within the bounds; merges have no stamp and never match."""
        return self.commits.where(F.col("created_at").between(F.lit(start), F.lit(end))).select("id")

    def checkout(self, selection: DataFrame, meta: bool = False) -> DataFrame:
        """The set of facts (e, a, v) of the commits; those without content add nothing."""
        facts = self.metafacts if meta else self.facts
        return facts.join(selection.select(F.col("id").alias("commit")), "commit", "left_semi").select("e", "a", "v").distinct()

    # Maintenance

    def unreachable(self, roots: DataFrame) -> DataFrame:
        return self.commits.select("id").join(self.ancestors(roots), "id", "left_anti")

    def transfer(self, target: str, selection: DataFrame) -> Repository:
        """Copies the commits, their parents and facts to another folder."""
        out = Repository(self.spark, target)
        commit = selection.select(F.col("id").alias("commit"))
        self.facts.join(commit, "commit", "left_semi").write.mode("append").parquet(f"{target}/facts")
        self.parents_table.join(selection, "id", "left_semi").write.mode("append").parquet(f"{target}/parents")
        self.commits.join(selection, "id", "left_semi").write.mode("append").parquet(f"{target}/commits")
        return out


@dataclass
class Workspace:
    """A branch as it was pulled, with commits made on top of it."""

    repository: Repository
    branch: str
    number: int
    base: str | None
    head: str | None = field(default=None)

    def __post_init__(self) -> None:
        self.head = self.base if self.head is None else self.head

    def commit(self, facts: DataFrame, message: str, **more) -> str:
        self.head = self.repository.write_commit(facts, message, [self.head] if self.head else [], **more)
        return self.head

    def merge(self, other: str) -> str:
        """Nothing to do, a fast-forward, or a commit with two parents and no content."""
        r = self.repository
        if self.head is None or self.head == other or not r.ancestors(r.select(other)).where(F.col("id") == self.head).isEmpty():
            self.head = other
        elif r.ancestors(r.select(self.head)).where(F.col("id") == other).isEmpty():
            self.head = r.write_commit(None, "", [self.head, other])
        return self.head

    def try_push(self) -> Workspace | None:
        """None when the head was set; else the branch as it is now."""
        try:
            self.repository._set_head(self.branch, self.number + 1, self.head)
        except Conflict:
            return self.repository.pull(self.branch)
        self.number, self.base = self.number + 1, self.head
        return None

    def push(self) -> None:
        """Pushes, merging what others pushed first."""
        while (now := self.try_push()) is not None:
            self.number = now.number
            if now.head:
                self.merge(now.head)
