"""N-Triples: lines parsed by column expressions into facts.

An IRI is an entity by itself.  A literal's datatype chooses the encoding, hence
the attribute: one predicate with two datatypes is two attributes.  A literal
with a language is an entity of its own, with text and language.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.model import Attribute, FactSet, InPairs, content_id
from factloom.sources.scratch import stored

XSD = "http://www.w3.org/2001/XMLSchema#"
#: Datatypes and their encodings (fixed values of the standard).
ENCODING = {"string": "text", "boolean": "boolean", "integer": "int", "int": "int", "long": "int", "nonNegativeInteger": "int", "positiveInteger": "int", "decimal": "money", "double": "float", "float": "float", "dateTime": "timestamp", "date": "timestamp", "gYear": "interval"}
LINE = r'^\s*(<[^>]*>|_:[^\s]+)\s+<([^>]*)>\s+(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*\.\s*(?:#.*)?$'
LITERAL = r'^"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?$'


def unescaped(c: Column) -> Column:
    """The escapes of a literal resolved; a backslash itself last, behind a stand-in."""
    out = F.regexp_replace(c, r"\\\\", "\x00")
    for mark, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ('"', '"'), ("'", "'"), ("b", "\b"), ("f", "\f")):
        out = F.replace(out, F.lit("\\" + mark), F.lit(char))
    parts = F.split(out, r"(?=\\u[0-9A-Fa-f]{4})|(?=\\U[0-9A-Fa-f]{8})")

    def one(p: Column) -> Column:
        def code(digits: int) -> Column:
            # A code point as UTF-8 through its UTF-32 bytes.
            point = F.decode(F.unhex(F.lpad(p.substr(3, digits), 8, "0")), "UTF-32")
            return F.concat(point, p.substr(F.lit(3 + digits), F.length(p)))

        return F.when(p.rlike(r"^\\u[0-9A-Fa-f]{4}"), code(4)).when(p.rlike(r"^\\U[0-9A-Fa-f]{8}"), code(8)).otherwise(p)

    return F.replace(F.array_join(F.transform(parts, one), ""), F.lit("\x00"), F.lit("\\"))


def parse(lines: DataFrame) -> DataFrame:
    """s, p, o, kind (id, blank, literal), datatype, lang of each triple in ``lines`` (column value); other lines are errors."""
    v = F.col("value")
    blank = v.rlike(r"^\s*(#.*)?$")
    rows = lines.where(~blank).select(v, *[F.regexp_extract(v, LINE, k).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))])
    checked = rows.withColumn("s", F.when(F.col("s") == "", F.raise_error(F.concat(F.lit("not a triple: "), v))).otherwise(F.col("s")))
    o = F.col("o")
    literal = o.startswith('"')
    plain = lambda c: F.regexp_replace(c, "^<|>$", "")
    return checked.select(
        plain(F.col("s")).alias("s"), "p",
        F.when(literal, unescaped(F.regexp_extract(o, LITERAL, 1))).otherwise(plain(o)).alias("o"),
        F.when(literal, "literal").when(o.startswith("_:"), "blank").otherwise("id").alias("kind"),
        F.when(literal, F.coalesce(F.nullif(F.regexp_extract(o, LITERAL, 2), F.lit("")), F.lit(XSD + "string"))).alias("datatype"),
        F.nullif(F.regexp_extract(o, LITERAL, 3), F.lit("")).alias("lang"),
    )


@dataclass(frozen=True)
class Import:
    facts: FactSet
    uri_map: DataFrame
    triples: DataFrame


def attribute_name(p: str, encoding: str) -> str:
    return f"{p}^{encoding}"


def entity_id(c: Column) -> Column:
    """IRIs and blank nodes as ids."""
    return content_id(c.cast("binary"))


def import_triples(lines: DataFrame) -> Import:
    """Facts by (predicate, encoding).  Blank nodes that refer to each other in a circle have no content id and raise.

    A blank node's id follows from its label here: labels are unique in a file.
    """
    triples = parse(lines)
    names = F.create_map(*[F.lit(x) for k, e in ENCODING.items() for x in (XSD + k, e)])
    encoding = F.when(F.col("kind") != "literal", "id").when(F.col("lang").isNotNull(), "id").otherwise(F.coalesce(names[F.col("datatype")], F.lit("text")))
    # Parsed once: the facts of each attribute are read from what is written here.
    rows = stored(triples.withColumn("encoding", encoding), "triples")
    triples = rows.drop("encoding")
    tagged = F.concat(F.col("o"), F.lit("\0"), F.lower("lang"))
    # A schema is small by nature: one row per predicate and encoding.
    schema = rows.select("p", "encoding").distinct().collect()
    attributes, data = {}, {}
    for r in schema:
        name = attribute_name(r.p, r.encoding)
        part = rows.where((F.col("p") == r.p) & (F.col("encoding") == r.encoding))
        o = F.col("o")
        value = {
            "id": F.when(F.col("lang").isNotNull(), entity_id(tagged)).otherwise(entity_id(o)),
            "boolean": F.when(o.isin("true", "1"), True).when(o.isin("false", "0"), False),
            "int": o.try_cast("bigint"),
            "money": o.try_cast("decimal(38,18)"),
            "float": F.when(F.lower(o) == "inf", F.lit(float("inf"))).when(F.lower(o) == "-inf", F.lit(float("-inf"))).otherwise(o.try_cast("double")),
            "timestamp": o.try_cast("timestamp"),
            "interval": F.struct(F.make_timestamp(o.try_cast("int"), *[F.lit(x) for x in (1, 1, 0, 0, 0)]).alias("lower"), (F.make_timestamp(o.try_cast("int") + 1, *[F.lit(x) for x in (1, 1, 0, 0, 0)]) - F.expr("INTERVAL 1 MICROSECOND")).alias("upper")),
            "text": o,
        }[r.encoding]
        attributes[name] = Attribute(name, r.encoding, True, r.p)
        data[name] = InPairs(part.select(entity_id(F.col("s")).alias("e"), value.alias("v")).where("v is not null").distinct())
    literals = rows.where("lang is not null").select(entity_id(tagged).alias("e"), "o", F.lower("lang").alias("lang"))
    for name, column in (("rdf_text", "o"), ("rdf_lang", "lang")):
        attributes[name] = Attribute(name, "text")
        data[name] = InPairs(literals.select("e", F.col(column).alias("v")).distinct())
    iris = triples.select(F.explode(F.array(F.col("s"), F.col("p"), F.when(F.col("kind") == "id", F.col("o")))).alias("iri")).where("iri is not null and not startswith(iri, '_:')").distinct()
    return Import(FactSet(attributes, data), iris.select("iri", entity_id(F.col("iri")).alias("id")), triples)


def read_ntriples(spark: SparkSession, path: str) -> Import:
    return import_triples(spark.read.text(path))
