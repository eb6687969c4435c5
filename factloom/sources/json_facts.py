"""JSON in and out: objects as entities, a lossless tree, and export.

Importers work on a column of JSON texts, one document a row, where the rows are;
an object's id follows from its content, so equal objects are one entity.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.model import Attribute, FactSet, InPairs, content_id
from factloom.sources.scratch import stored

FACT = "e string, a string, kind string, text string, number double, flag boolean, root boolean"
ENCODING = {"text": "text", "number": "float", "flag": "boolean", "id": "id"}


def finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"not a finite number: {text}")
    return value


def leaves(held: object) -> Iterator[object]:
    """What a field holds: arrays of any depth give their members."""
    if isinstance(held, list):
        for x in held:
            yield from leaves(x)
    else:
        yield held


def object_facts(value: dict, salt: bytes, root: bool, out: list[tuple]) -> str:
    """Facts of an object, after those of the objects in it; its id.  null and [] say nothing, arrays repeat."""
    own: set[tuple] = set()
    for field, held in value.items():
        for x in leaves(held):
            if isinstance(x, dict):
                own.add((field, "id", object_facts(x, salt, False, out)))
            elif isinstance(x, bool):
                own.add((field, "flag", x))
            elif isinstance(x, (int, float)):
                own.add((field, "number", finite(x)))
            elif isinstance(x, str):
                own.add((field, "text", x))
    rows = sorted(repr(f).encode() for f in own)
    e = str(content_id(salt, *[len(r).to_bytes(8, "big") + r for r in rows]))
    for field, kind, v in own:
        out.append((e, field, kind, v if kind in ("text", "id") else None, v if kind == "number" else None, v if kind == "flag" else None, root))
    return e


def import_objects(docs: DataFrame, column: str = "json", salt: bytes = b"") -> tuple[FactSet, DataFrame]:
    """Facts of objects (or arrays of objects), and the roots (e).  A root that is neither is an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder(parse_constant=finite)
        for b in batches:
            out: list[tuple] = []
            for text in b[column]:
                if text is None:
                    continue
                value, _ = decoder.raw_decode(text.lstrip())
                for x in value if isinstance(value, list) else [value]:
                    if not isinstance(x, dict):
                        raise ValueError("the root must be an object or an array of objects")
                    object_facts(x, salt, True, out)
            yield pd.DataFrame(out, columns=[f.split()[0] for f in FACT.split(", ")])

    # Parsed once: the facts of each attribute are read from what is written here.
    rows = stored(docs.select(column).mapInPandas(parse, FACT), "json-facts")
    # Fields and kinds: as many as the documents' schema has.
    fields = rows.select("a", "kind").distinct().collect()
    attributes, data = {}, {}
    for r in fields:
        name = r.a if sum(x.a == r.a for x in fields) == 1 else f"{r.a}^{r.kind}"
        attributes[name] = Attribute(name, ENCODING[r.kind], True)
        v = F.col({"id": "text"}.get(r.kind, r.kind))
        data[name] = InPairs(rows.where((F.col("a") == r.a) & (F.col("kind") == r.kind)).select("e", v.alias("v")).distinct())
    return FactSet(attributes, data), rows.where("root").select("e").distinct()


TREE = "node string, parent string, kind string, field string, index long, text string, number string, flag boolean"


def import_tree(docs: DataFrame, column: str = "json") -> DataFrame:
    """Every JSON value as a node that keeps what objects as entities lose: nulls, order, nesting, numbers as written."""

    def nodes(text: str) -> list[tuple]:
        out: list[tuple] = []

        def walk(value: object, path: str, parent: str | None, field: str | None, index: int | None) -> None:
            node = str(content_id(text.encode(), path.encode()))
            kind, said, number, flag = "null", None, None, None
            if isinstance(value, list):  # objects come as lists of pairs behind a mark, so their order and repeats stay
                kind = "object" if value and value[0] is nodes else "array"
            elif isinstance(value, bool):
                kind, flag = "boolean", value
            elif isinstance(value, Number):
                kind, number = "number", str(value)
            elif isinstance(value, str):
                kind, said = "string", value
            out.append((node, parent, kind, field, index, said, number, flag))
            if kind == "object":
                for k, (name, v) in enumerate(value[1:]):  # type: ignore[index]
                    walk(v, f"{path}/{k}", node, name, k)
            elif kind == "array":
                for k, v in enumerate(value):  # type: ignore[arg-type]
                    walk(v, f"{path}/{k}", node, None, k)

        class Number(str):
            pass

        walk(json.loads(text, object_pairs_hook=lambda pairs: [nodes, *pairs], parse_int=Number, parse_float=Number), "", None, None, None)
        return out

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([n for t in b[column] if t is not None for n in nodes(t)], columns=[f.split()[0] for f in TREE.split(", ")]).astype({"index": "Int64", "flag": "boolean"})

    return docs.select(column).mapInPandas(parse, TREE)


def export_object(facts: FactSet, root: str) -> str:
    """An entity and what it refers to as JSON, fetched a level at a time; one met again is a {"$ref": id}.

    Booleans, numbers, texts and entities are written, other encodings skipped.
    """
    spark = next(iter(facts.data.values())).pairs().sparkSession
    held: dict[str, dict[str, list]] = {}
    shown = {n for n, a in facts.attributes.items() if a.encoding in ("boolean", "float", "int", "id", "text", "short_string")}
    frontier = {root}
    while frontier:
        asked = spark.createDataFrame([(e,) for e in frontier], "e string")
        further: set[str] = set()
        for e in frontier:
            held[e] = {}
        for n in sorted(shown):
            for r in facts.pairs(n).join(asked, "e", "left_semi").orderBy("e", "v").collect():
                held[r.e].setdefault(n, []).append(r.v)
                if facts.attributes[n].encoding == "id":
                    further.add(r.v)
        frontier = further - held.keys()
    seen: set[str] = set()

    def build(e: str) -> object:
        if e in seen:
            return {"$ref": e}
        seen.add(e)
        out = {}
        for n, values in held[e].items():
            built = [build(v) if facts.attributes[n].encoding == "id" else v for v in values]
            out[n] = built if len(built) > 1 else built[0]
        return out

    return json.dumps(build(root), ensure_ascii=False)


def export_flat(df: DataFrame) -> DataFrame:
    """Rows as JSON objects, without leaving the executors."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
