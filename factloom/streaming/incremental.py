"""Answers that a delta adds, and the same over a stream.

With k clauses the new assignments are the union of k variants, the i-th reading
clause i from the delta and the others from the full set; the union is distinct
over all variables, and only then projected.  Nothing is remembered between
calls: late facts are just a later delta.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.model import Attribute, FactSet
from factloom.plans.query import And, Constraint, Pattern, Source, assignments


def pattern_changes(full: FactSet, delta: FactSet, *clauses: tuple[object, object, object]) -> Constraint:
    """The assignments of the clauses over ``full`` that use a fact of ``delta``."""
    if any(isinstance(t, str) and t.startswith("_?") or t is None for c in clauses for t in c):
        # Local variables stay one and the same across the variants.
        names: dict[object, str] = {}
        clauses = tuple(tuple(names.setdefault(t, f"?__{len(names)}") if isinstance(t, str) and t.startswith("_?") else f"?__anon{k}" if t is None else t for t in c) for k, c in enumerate(clauses))
    variants = []
    for i, c in enumerate(clauses):
        if isinstance(c[1], str) and not c[1].startswith("?") and c[1] not in delta.data:
            continue
        rest = [x for k, x in enumerate(clauses) if k != i]
        new = Pattern(delta, [c])
        variants.append(assignments(And(new, Pattern(full, rest)) if rest else new))
    if not variants:
        base = assignments(Pattern(full, clauses))
        return Source([f"?{n}" for n in sorted(base.names)], lambda: base.df.select(*sorted(base.names)).where(F.lit(False)), True)
    names = sorted(variants[0].names)
    df = reduce(DataFrame.unionByName, (v.df.select(*names) for v in variants)).distinct()
    return Source([f"?{n}" for n in names], lambda: df, True)


def facts_from_rows(rows: DataFrame, attributes: Sequence[Attribute]) -> FactSet:
    """A fact set from canonical (e, a, v) rows, values cast to their attributes' types."""
    from factloom.operators.model import ENCODINGS, InPairs

    return FactSet({a.name: a for a in attributes}, {a.name: InPairs(rows.where(F.col("a") == a.name).select("e", F.col("v").cast(ENCODINGS[a.encoding].spark).alias("v")).distinct()) for a in attributes})


def continuous(stream: DataFrame, store: str, attributes: Sequence[Attribute], question: Callable[[FactSet, FactSet], DataFrame], deliver: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``question(full, delta)`` on every micro-batch of (e, a, v) rows.

    Each batch is written to ``store`` under its number before the question is
    asked, so a repeated batch replaces itself; the full set is what the store
    holds up to that batch, and the delta is what no earlier batch held.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select("e", "a", "v").distinct().write.mode("overwrite").parquet(f"{store}/batch={number}")
        every = spark.read.schema("e string, a string, v string, batch long").option("basePath", store).parquet(f"{store}/batch=*").where(F.col("batch") <= number)
        # A fact belongs to the batch that brought it first.
        first = every.groupBy("e", "a", "v").agg(F.min("batch").alias("batch"))
        deliver(question(facts_from_rows(first.drop("batch"), attributes), facts_from_rows(first.where(F.col("batch") == number).drop("batch"), attributes)), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
