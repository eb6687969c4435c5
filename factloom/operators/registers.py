"""Registers: which states of a register are current.

Dominance is judged over the whole frame of facts, never over a filtered part.
Winners are found by an aggregate and a join on it rather than a window, so a
register with very many states is combined before it is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.model import FactSet


@dataclass(frozen=True)
class ObservationOrder:
    """A state is dominated once some state observes it; ``first`` turns the edges round."""

    facts: FactSet
    observes: str
    first: bool = False

    def dominated(self) -> DataFrame:
        return self.facts.pairs(self.observes).select(F.col("e" if self.first else "v").alias("state")).distinct()

    def resolve(self, candidates: DataFrame) -> DataFrame:
        """Candidates (one column) that are not dominated, by immediate edges only."""
        return candidates.toDF("state").distinct().join(self.dominated(), "state", "left_anti")


@dataclass(frozen=True)
class StatedOrder:
    """States of a register (``identity``) ordered by a key (``order``): the last wins, or the ``first``.

    Equal keys all survive unless ``tiebreak_by_id``.  States without a register
    or a key are never dominated.  A state with several keys in a register counts
    by its best.
    """

    facts: FactSet
    identity: str
    order: str
    first: bool = False
    tiebreak_by_id: bool = False

    def keyed(self) -> DataFrame:
        register = self.facts.pairs(self.identity).select(F.col("e").alias("state"), F.col("v").alias("register"))
        key = self.facts.pairs(self.order).select(F.col("e").alias("state"), F.col("v").alias("key"))
        return register.join(key, "state")

    def survivors(self) -> DataFrame:
        """register, state, key of every winner."""
        best = F.min if self.first else F.max
        by: Column = F.struct("key", "state") if self.tiebreak_by_id else F.col("key")
        keyed = self.keyed().withColumn("rank", by)
        winners = keyed.groupBy("register").agg(best("rank").alias("rank"))
        return keyed.join(winners, ["register", "rank"]).select("register", "state", "key")

    def dominated(self) -> DataFrame:
        best = F.min if self.first else F.max
        by: Column = F.struct("key", "state") if self.tiebreak_by_id else F.col("key")
        keyed = self.keyed().withColumn("rank", by)
        winners = keyed.groupBy("register").agg(best("rank").alias("best"))
        return keyed.join(winners, "register").where(F.col("rank") != F.col("best")).select("state").distinct()

    def resolve(self, candidates: DataFrame) -> DataFrame:
        return candidates.toDF("state").distinct().join(self.dominated(), "state", "left_anti")


@dataclass(frozen=True)
class Unordered:
    """Every state survives."""

    facts: FactSet

    def resolve(self, candidates: DataFrame) -> DataFrame:
        return candidates.toDF("state").distinct()


def sole(order: ObservationOrder | StatedOrder | Unordered, candidates: DataFrame) -> tuple[str, list[str]]:
    """("empty", []), ("sole", [state]) or ("fork", two of the states); at most two rows are fetched."""
    found = sorted(r.state for r in order.resolve(candidates).limit(2).collect())
    return ("empty", "sole", "fork")[len(found)], found


def sole_by_register(order: StatedOrder) -> DataFrame:
    """register, resolution and, of a sole winner, the state."""
    n = F.count(F.lit(1))
    return order.survivors().groupBy("register").agg(F.when(n == 1, "sole").otherwise("fork").alias("resolution"), F.when(n == 1, F.first("state")).alias("state"))


def observed_union(held: DataFrame | None, facts: FactSet, observes: str) -> DataFrame:
    """The maintained set of observed states: it only grows; a reader subtracts it."""
    new = facts.pairs(observes).select(F.col("v").alias("state"))
    return (new if held is None else held.unionByName(new)).distinct()
