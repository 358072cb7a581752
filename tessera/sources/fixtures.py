"""The entity model over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import Attribute as A
from tessera.catalog import Catalog, Entity
from tessera.catalog import Relationship as R
from tessera.functions.scalar import epoch_micros
from tessera.store import Store


def catalog() -> Catalog:
    return Catalog.of(
        Entity("Region", "region", "r_regionkey", (A("r_name", unique=True),), (R("nations", "Nation", inverse_fk="n_regionkey", delete_rule="deny"),)),
        Entity(
            "Nation", "nation", "n_nationkey", (A("n_name", unique=True),),
            (R("region", "Region", fk="n_regionkey"), R("customers", "Customer", inverse_fk="c_nationkey", delete_rule="nullify"), R("suppliers", "Supplier", inverse_fk="s_nationkey")),
        ),
        Entity(
            "Customer", "customer", "c_custkey", (A("c_name", unique=True), A("c_acctbal", "double"), A("c_mktsegment")),
            (R("nation", "Nation", fk="c_nationkey"), R("orders", "Orders", inverse_fk="o_custkey", delete_rule="cascade")), unique=(("c_name",),),
        ),
        Entity("Supplier", "supplier", "s_suppkey", (A("s_name"), A("s_acctbal", "double")), (R("nation", "Nation", fk="s_nationkey"), R("items", "LineItem", inverse_fk="l_suppkey"))),
        Entity(
            "Part", "part", "p_partkey", (A("p_name"), A("p_brand"), A("p_type"), A("p_size", "int"), A("p_retailprice", "double")),
            (R("orders", "Orders", bridge=("lineitem", "l_partkey", "l_orderkey")), R("items", "LineItem", inverse_fk="l_partkey")),
        ),
        Entity(
            "Orders", "orders", "o_orderkey", (A("o_orderstatus"), A("o_totalprice", "double"), A("o_orderdate", "timestamp_ntz"), A("o_orderpriority")),
            (R("customer", "Customer", fk="o_custkey"), R("items", "LineItem", inverse_fk="l_orderkey", delete_rule="cascade"), R("parts", "Part", bridge=("lineitem", "l_orderkey", "l_partkey"))),
        ),
        Entity(
            "LineItem", "lineitem", "l_linenumber",
            (A("l_quantity", "double"), A("l_extendedprice", "double"), A("l_discount", "double"), A("l_tax", "double"), A("l_returnflag"), A("l_linestatus"), A("l_shipdate", "timestamp_ntz")),
            (R("order", "Orders", fk="l_orderkey"), R("part", "Part", fk="l_partkey"), R("supplier", "Supplier", fk="l_suppkey")),
        ),
        Entity("Event", "events", "event_id", (A("ts", "timestamp_ntz"), A("user_id", "bigint"), A("event_type"), A("value", "double"), A("props", composite=("k",)))),
        Entity("Document", "documents", "doc_id", (A("text"), A("lang"), A("source"), A("n_chars", "bigint"))),
        Entity("Label", "labels", "doc_id", (A("quality", "int"), A("toxic", "int")), parent="Document"),
        Entity("Embedding", "embeddings", "vec_id", (A("embedding", "array<float>"), A("label", "int"))),
        Entity("Turn", "conversations", "conv_id", (A("turn", "bigint"), A("role"), A("text"))),
    )


TABLES = "region nation customer supplier part orders lineitem events documents labels embeddings conversations".split()


def store(spark: SparkSession, sf_dir: str) -> Store:
    return Store(spark, catalog(), {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES})


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a change log: signups insert, errors delete, the others update; the microsecond is the transaction."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return e.select(
        F.col("event_id").alias("pk"),
        kind.alias("event"),
        F.lit("Event").alias("entity_name"),
        F.col("user_id").cast("string").alias("entity_pk"),
        F.when(kind == "update", "value").alias("property_names"),
        F.col("value").cast("string").alias("preserved_values"),
        epoch_micros(F.col("ts")).alias("timestamp"),
        F.when(F.col("event_type") == "view", "remote").otherwise("local").alias("author"),
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("store_identifier"),
    )
