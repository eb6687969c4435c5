"""Collections: a growing set of facts in one folder, its snapshots, and what is derived from it.

A member is a table of (e, a, v) text rows under ``members/<ticket>``; the ticket
follows from its distinct facts, so adding the same facts again adds nothing.  A
snapshot is the union of members.  A derivation is worked out for each member
once and kept beside it, which is right for functions of which the result over a
union is the union of results (selections, projections, joins with fixed tables).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.history import set_digest
from factloom.operators.model import content_id
from factloom.sources.scratch import stored

ROWS = "e string, a string, v string"


@dataclass(frozen=True)
class Collection:
    spark: SparkSession
    path: str

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _whole(self, name: str) -> bool:
        """Whether a table was written to its end; what a lost writer left is written over."""
        at, fs = self._at(f"{name}/_SUCCESS")
        return fs.exists(at)

    def commit(self, facts: DataFrame) -> str:
        """Adds facts as a member, if they are not one already; the member's ticket."""
        rows = stored(facts.select("e", "a", F.col("v").cast("string").alias("v")).distinct(), "member")
        ticket = str(content_id(str(tuple(set_digest(rows))).encode()))
        if not self._whole(f"members/{ticket}"):
            rows.write.mode("overwrite").parquet(f"{self.path}/members/{ticket}")
        return ticket

    def tickets(self) -> list[str]:
        at, fs = self._at("members")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        return [n for n in names if self._whole(f"members/{n}")]

    def member(self, ticket: str) -> DataFrame:
        if not self._whole(f"members/{ticket}"):
            raise KeyError(f"no member {ticket!r}")
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/members/{ticket}")

    def snapshot(self, *tickets: str) -> DataFrame:
        """The facts of the members that the tickets name, of all without any; each fact once."""
        parts = [self.member(t) for t in tickets or self.tickets()]
        return reduce(DataFrame.unionByName, parts).distinct() if parts else self.spark.createDataFrame([], ROWS)

    def materialize(self, path: str, *tickets: str) -> DataFrame:
        """A snapshot written as one sorted table."""
        self.snapshot(*tickets).sortWithinPartitions("e", "a", "v").write.parquet(path)
        return self.spark.read.schema(ROWS).parquet(path)

    def derived(self, name: str, derive: Callable[[DataFrame], DataFrame], *tickets: str, verify: bool = False) -> DataFrame:
        """The union of ``derive`` over members; what was worked out before under ``name`` is read.

        ``verify`` works it out over the snapshot as well and raises if that differs.
        """
        asked = list(tickets or self.tickets())
        for t in asked:
            if not self._whole(f"derived/{name}/{t}"):
                derive(self.member(t)).write.mode("overwrite").parquet(f"{self.path}/derived/{name}/{t}")
        if not asked:
            return derive(self.snapshot())
        out = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/derived/{name}/{t}") for t in asked)).distinct()
        if verify:
            whole = stored(derive(self.snapshot(*asked)).distinct(), "derived-whole")
            if not whole.exceptAll(out).isEmpty() or not out.exceptAll(whole).isEmpty():
                raise ValueError(f"{name!r} over the union is not the union of {name!r} over members")
        return out
