"""The driver tables as a fact set."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.model import FactSet, content_id, reference

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_id(df: DataFrame) -> DataFrame:
    """Lineitem has no key: a row's id is the content of all its columns, and equal rows are one."""
    whole = F.to_json(F.struct(*df.columns)).cast("binary")
    return df.withColumn("line", content_id(whole))


@lru_cache(maxsize=8)
def tables_as_facts(spark: SparkSession, sf_dir: str) -> FactSet:
    """Entities are ``table:key``, attributes are columns, foreign keys refer to entities.

    Line items serve as links from their orders: ``o_part`` and ``o_supplier`` are
    the pairs that some line makes, and multi-valued.  Plans are kept for each
    session and folder, as reading fourteen schemas takes longer than most plans.
    """
    t = {n: table(spark, sf_dir, n) for n in TABLES}
    lines = t["lineitem"]
    facts = (
        FactSet()
        .with_table(t["region"], "region", "r_regionkey", {"r_name": ("short_string", "r_name")})
        .with_table(t["nation"], "nation", "n_nationkey", {"n_name": ("short_string", "n_name"), "n_region": ("id", reference("region", "n_regionkey"))})
        .with_table(t["customer"], "customer", "c_custkey", {"c_name": ("text", "c_name"), "c_nation": ("id", reference("nation", "c_nationkey")), "c_balance": ("float", "c_acctbal"), "c_segment": ("short_string", "c_mktsegment")})
        .with_table(t["supplier"], "supplier", "s_suppkey", {"s_name": ("text", "s_name"), "s_nation": ("id", reference("nation", "s_nationkey")), "s_balance": ("float", "s_acctbal")})
        .with_table(t["part"], "part", "p_partkey", {"p_name": ("text", "p_name"), "p_brand": ("short_string", "p_brand"), "p_type": ("text", "p_type"), "p_size": ("int", F.col("p_size").cast("bigint")), "p_price": ("float", "p_retailprice")})
        .with_table(
            t["orders"], "order", "o_orderkey",
            {"o_customer": ("id", reference("customer", "o_custkey")), "o_status": ("short_string", "o_orderstatus"), "o_total": ("float", "o_totalprice"), "o_date": ("timestamp", "o_orderdate"), "o_priority": ("short_string", "o_orderpriority"), "o_urgent": ("short_string", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")))},
        )
        .with_table(t["events"], "event", "event_id", {"ev_user": ("id", reference("customer", "user_id")), "ev_type": ("short_string", "event_type"), "ev_value": ("float", "value"), "ev_time": ("timestamp", "ts"), "ev_props": ("text", "props")})
        .with_table(t["documents"], "doc", "doc_id", {"d_text": ("text", "text"), "d_lang": ("short_string", "lang"), "d_source": ("short_string", "source"), "d_chars": ("int", "n_chars")})
        .with_table(t["labels"], "doc", "doc_id", {"d_quality": ("int", F.col("quality").cast("bigint")), "d_toxic": ("int", F.col("toxic").cast("bigint"))})
        .with_table(t["pages"], "page", "page_id", {"pg_url": ("text", "url"), "pg_html": ("text", "html")})
        .with_table(t["embeddings"], "vec", "vec_id", {"vec": ("vector", "embedding"), "vec_label": ("int", F.col("label").cast("bigint"))})
    )
    order = reference("order", "l_orderkey").alias("e")
    facts = facts.with_pairs("o_part", "id", lines.select(order, reference("part", "l_partkey").alias("v")))
    facts = facts.with_pairs("o_supplier", "id", lines.select(order, reference("supplier", "l_suppkey").alias("v")))
    facts = facts.with_pairs("o_line", "id", line_id(lines).select(order, reference("line", "line").alias("v")))
    turn = t["conversations"].select("conv_id", "turn", "role", "text").withColumn("e", F.concat_ws(":", F.lit("turn"), "conv_id", "turn"))
    facts = facts.with_pairs("t_role", "short_string", turn.select("e", F.col("role").alias("v")), False)
    return facts.with_pairs("t_follows", "id", turn.where("turn > 0").select("e", F.concat_ws(":", F.lit("turn"), "conv_id", F.col("turn") - 1).alias("v")), False)


def nation_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges nation k -> nation (7k + 3) mod 25, labelled ``next``: a graph with cycles."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(reference("nation", "n_nationkey").alias("src"), F.lit("next").alias("label"), reference("nation", F.pmod(7 * k + 3, F.lit(25))).alias("dst"))
