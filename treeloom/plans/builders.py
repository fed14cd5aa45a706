"""Trees over the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.relational import Level, timestamp_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_level(spark: SparkSession, sf_dir: str) -> Level:
    """(l_orderkey, l_linenumber) is not unique, so all columns that tell lines apart order them."""
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", timestamp_text(F.col("l_shipdate")))
    scalars = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return Level("Lineitem", rows, "l_orderkey", scalars, parent="l_orderkey", order=["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])


def order_level(spark: SparkSession, sf_dir: str) -> Level:
    rows = table(spark, sf_dir, "orders").withColumn("o_orderdate", timestamp_text(F.col("o_orderdate")))
    scalars = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return Level("Order", rows, "o_orderkey", scalars, parent="o_custkey", order=["o_orderkey"], children={"lineitems": lineitem_level(spark, sf_dir)})


def customer_level(spark: SparkSession, sf_dir: str) -> Level:
    """customer - orders - lineitems; a document is a customer."""
    scalars = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    return Level("Customer", table(spark, sf_dir, "customer"), "c_custkey", scalars, children={"orders": order_level(spark, sf_dir)})


def region_level(spark: SparkSession, sf_dir: str) -> Level:
    """region - nations - customers and suppliers; a document is a region."""
    long = lambda t, *cols: table(spark, sf_dir, t).withColumns({c: F.col(c).cast("bigint") for c in cols})
    customers = Level("Customer", long("customer", "c_nationkey"), "c_custkey", ["c_custkey", "c_name"], parent="c_nationkey", order=["c_custkey"])
    suppliers = Level("Supplier", long("supplier", "s_nationkey"), "s_suppkey", ["s_suppkey", "s_name"], parent="s_nationkey", order=["s_suppkey"])
    nations = Level("Nation", long("nation", "n_nationkey", "n_regionkey"), "n_nationkey", ["n_nationkey", "n_name"], parent="n_regionkey", order=["n_nationkey"], children={"customers": customers, "suppliers": suppliers})
    return Level("Region", long("region", "r_regionkey"), "r_regionkey", ["r_regionkey", "r_name"], children={"nations": nations})


def conversation_level(spark: SparkSession, sf_dir: str) -> Level:
    """conversation - turns; a document is a conversation."""
    turns = table(spark, sf_dir, "conversations")
    turn = Level("Turn", turns, "turn", ["turn", "role", "text"], parent="conv_id", order=["turn", "role", "text"])
    return Level("Conversation", turns.select("conv_id").distinct(), "conv_id", ["conv_id"], children={"turns": turn})


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc): one document per event, typed by it, with its JSON properties inside."""
    e = table(spark, sf_dir, "events")
    head = F.to_json(F.struct(F.col("event_type").alias("@type"), "event_id", "user_id"))
    doc = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"props":'), F.coalesce("props", F.lit("null")), F.lit("}"))
    return e.select(F.col("event_id").alias("doc_id"), doc.alias("doc"))


def event_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc): the same documents as structs."""
    doc = F.struct(F.col("event_type").alias("@type"), "event_id", "user_id", F.from_json("props", "k bigint").alias("props"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), doc.alias("doc"))


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, code): texts as source code."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("code"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share: below ``spark.checkpoint.dir``; in local mode
    without that setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/treeloom-{name}-{uuid.uuid4().hex}"
