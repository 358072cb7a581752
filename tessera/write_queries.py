"""Registered queries of the write path, links, migration, history upkeep, sync, graph edits, caches and editing state, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import Attribute, Catalog, Entity, Index, Relationship
from tessera.functions import scalar as S
from tessera.operators import graph, history, inherit, migrate, mutate, relations, sets
from tessera.operators.cache import ResultCache
from tessera.operators.ephemeral import EditingState
from tessera.operators.fetch import FetchRequest as Req
from tessera.operators.fetch import ambiguous, fetch, fetch_count, fetch_identifiers
from tessera.queries import CUSTOMER, CUT, EDGES, LOG, NOW, QUERIES, SQL, keyed_items, log_query, query
from tessera.sources.fixtures import change_log, store
from tessera.sources.shared import shared_dir
from tessera.sources.snapshots import SnapshotStore
from tessera.store import Store
from tessera.streaming import log as stream



def building() -> Column:
    return F.col("c_mktsegment") == "BUILDING"


def in_debt() -> Column:
    return F.col("c_acctbal") < -500


def labelled(parts: dict[str, DataFrame], name: str = "part") -> DataFrame:
    return reduce(DataFrame.unionAll, [df.select(F.lit(k).alias(name), "*") for k, df in parts.items()])


# --- saves --------------------------------------------------------------------------------------------------------


def _inserts(s: Store) -> mutate.SaveRequest:
    """New customers under temporary keys: those of one segment meet stored ones by name, those of another are new. New orders refer to them."""
    c = s.table("Customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')")
    name = F.when(building(), F.col("c_name")).otherwise(F.concat("c_name", F.lit("-new")))
    people = c.select((F.col("c_custkey") + 5_000_000).alias("c_custkey"), name.alias("c_name"), "c_nationkey", F.lit(0.0).alias("c_acctbal"), "c_mktsegment")
    known = c.select(F.col("c_custkey").alias("_k"))
    orders = s.table("Orders").where("o_totalprice > 400000").join(known, F.col("o_custkey") == F.col("_k"), "left")
    orders = orders.select((F.col("o_orderkey") + 50_000_000).alias("o_orderkey"), F.coalesce(F.col("_k") + 5_000_000, "o_custkey").alias("o_custkey"), "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return mutate.SaveRequest(inserted={"Customer": people, "Orders": orders})


@query(
    """SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer
    UNION ALL SELECT c_custkey + 5000000, c_name || '-new', 0 FROM customer WHERE c_mktsegment = 'MACHINERY'"""
)
def save_upserts(s):
    return mutate.save(s, _inserts(s)).tables["customer"].select("c_custkey", "c_name", "c_acctbal")


@query(
    """SELECT o_orderkey, o_custkey FROM orders UNION ALL
    SELECT o_orderkey + 50000000, CASE WHEN c_mktsegment = 'MACHINERY' THEN o_custkey + 5000000 ELSE o_custkey END FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000"""
)
def save_repairs_references(s):
    return mutate.save(s, _inserts(s)).tables["orders"].select("o_orderkey", "o_custkey")


@query(
    """SELECT 'insert' AS event, 'Customer' AS entity_name, count(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY'
    UNION ALL SELECT 'update', 'Customer', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal <> 0
    UNION ALL SELECT 'insert', 'Orders', count(*) FROM orders WHERE o_totalprice > 400000"""
)
def save_log(s):
    return mutate.save(s, _inserts(s)).changes.groupBy("event", "entity_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < -500), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
    SELECT 'update' AS event, 'Orders' AS entity_name, count(*) AS n FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'delete', 'Customer', count(*) FROM gone UNION ALL SELECT 'delete', 'Orders', count(*) FROM o
    UNION ALL SELECT 'delete', 'LineItem', count(DISTINCT l_orderkey * 10 + l_linenumber) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)"""
)
def save_updates_and_deletes(s):
    keyed = keyed_items(s)
    r = mutate.SaveRequest(
        updated={"Orders": s.table("Orders").where("o_orderstatus = 'P'").select("o_orderkey", F.lit("F").alias("o_orderstatus"))},
        deleted={"Customer": s.table("Customer").where(in_debt()).select("c_custkey")},
    )
    return mutate.save(keyed, r).changes.groupBy("event", "entity_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'c_name' AS refused FROM (SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING') WHERE n > 0")
def save_refuses_duplicates(s):
    c = s.table("Customer").where(building()).select((F.col("c_custkey") + 5_000_000).alias("c_custkey"), "c_name")
    try:
        mutate.save(s, mutate.SaveRequest(inserted={"Customer": c.unionAll(c.select(F.col("c_custkey") + 1_000_000, "c_name"))}))
    except mutate.UniqueViolation:
        return s.spark.createDataFrame([("c_name",)], "refused string")
    return s.spark.createDataFrame([], "refused string")


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, upper(c_name), c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def insert_or_replace(s):
    c = s.table("Customer")
    return mutate.insert(c, c.where(building()).withColumn("c_name", F.upper("c_name")), "c_custkey", replace=True)


@query(f"SELECT {CUSTOMER} FROM customer UNION ALL SELECT c_custkey + 5000000, c_name, c_nationkey, NULL, NULL FROM customer WHERE c_mktsegment = 'BUILDING'")
def insert_new(s):
    c = s.table("Customer")
    return mutate.insert(c, c.where(building()).select((F.col("c_custkey") + 5_000_000).alias("c_custkey"), "c_name", "c_nationkey"), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer")
def erase_column(s):
    return mutate.erase_column(s.table("Customer"), "c_acctbal", where=F.col("c_acctbal") < 0).select("c_custkey", "c_acctbal")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def decode_defaults(s):
    return mutate.decode(inherit.polymorphic(s, "Document").select("doc_id", "quality"), {"quality": -1})


@query("SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def merge_values(s):
    c = s.table("Customer")
    incoming = c.where(building()).select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") * 2).alias("c_acctbal"))
    return mutate.merge_values(c, incoming, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


# --- delete rules -------------------------------------------------------------------------------------------------

TREE = "WITH RECURSIVE node AS (SELECT p_partkey AS pk, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS up FROM part), gone(pk) AS (SELECT 2 UNION SELECT node.pk FROM node JOIN gone ON node.up = gone.pk)"


def _tree(s: Store) -> Store:
    """Parts as a tree with three children each, orders as notes on parts, lines as links between parts and suppliers."""
    c = Catalog.of(
        Entity(
            "Node", "node", "pk", (),
            (Relationship("parent", "Node", fk="up"), Relationship("children", "Node", inverse_fk="up", delete_rule="cascade"), Relationship("notes", "Note", inverse_fk="node_pk"), Relationship("tags", "Tag", bridge=("node_tag", "node_pk", "tag_pk"))),
        ),
        Entity("Note", "note", "pk", (), (Relationship("node", "Node", fk="node_pk"),)),
        Entity("Tag", "tag", "pk"),
    )
    part = F.col("p_partkey")
    return Store(
        s.spark, c,
        {
            "node": s.table("Part").select(part.alias("pk"), F.when(part > 0, F.floor((part - 1) / 3)).alias("up")),
            "note": s.table("Orders").select(F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("node_pk")),
            "tag": s.table("Supplier").select(F.col("s_suppkey").alias("pk")),
            "node_tag": s.table("LineItem").select(F.col("l_partkey").alias("node_pk"), F.col("l_suppkey").alias("tag_pk")).distinct(),
        },
    )


def _without_branch(s: Store, table: str) -> DataFrame:
    t = _tree(s)
    return mutate.apply_delete(t, mutate.plan_delete(t, "Node", s.spark.createDataFrame([(2,)], "pk long")))[table]


@query(f"{TREE} SELECT pk FROM node WHERE pk NOT IN (SELECT pk FROM gone)")
def delete_tree(s):
    return _without_branch(s, "node").select("pk")


@query(f"{TREE} SELECT o_orderkey AS pk, CASE WHEN o_custkey IN (SELECT pk FROM gone) THEN NULL ELSE o_custkey END AS node_pk FROM orders")
def delete_tree_nullify(s):
    return _without_branch(s, "note")


@query(f"{TREE} SELECT DISTINCT l_partkey AS node_pk, l_suppkey AS tag_pk FROM lineitem WHERE l_partkey NOT IN (SELECT pk FROM gone)")
def delete_tree_bridge(s):
    return _without_branch(s, "node_tag")


@query("""SELECT 'delete' AS event, 'Customer' AS entity_name, CAST(c_custkey AS VARCHAR) AS entity_pk, 'c_name,c_mktsegment' AS property_names, '["' || c_name || '","' || c_mktsegment || '"]' AS preserved_values FROM customer WHERE c_acctbal < -500""")
def delete_batch_log(s):
    kept = Entity("Customer", "customer", "c_custkey", (Attribute("c_name", preserve=True), Attribute("c_acctbal", "double"), Attribute("c_mktsegment", preserve=True)))
    return mutate.delete_where(Store(s.spark, Catalog.of(kept), {"customer": s.table("Customer")}), "Customer", in_debt())[1]


# --- links --------------------------------------------------------------------------------------------------------

BRIDGE = "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem"


def _bridge(s: Store) -> tuple[DataFrame, DataFrame]:
    items = s.table("LineItem")
    return items.select("l_orderkey", "l_partkey").distinct(), items.where("l_quantity >= 45")


@query(f"{BRIDGE} UNION SELECT l_orderkey, l_partkey + 1 FROM lineitem WHERE l_quantity >= 45")
def link_many_to_many(s):
    bridge, heavy = _bridge(s)
    return mutate.link_bridge(bridge, heavy.select("l_orderkey", F.col("l_partkey") + 1))


@query(f"{BRIDGE} EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 45")
def unlink_many_to_many(s):
    bridge, heavy = _bridge(s)
    return mutate.unlink_bridge(bridge, heavy.select("l_orderkey", "l_partkey"))


def _pairs(s: Store, owner) -> DataFrame:
    return s.table("Customer").where(building()).select(owner.alias("owner"), F.col("c_custkey").alias("related"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 7 ELSE c_nationkey END AS c_nationkey FROM customer")
def link_one_to_many(s):
    return mutate.link_many(s.table("Customer"), "c_custkey", "c_nationkey", _pairs(s, F.lit(7))).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer")
def unlink_one_to_many(s):
    return mutate.unlink_many(s.table("Customer"), "c_custkey", "c_nationkey", _pairs(s, F.col("c_nationkey"))).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' AND c_nationkey IS NOT NULL)")
def unlink_cascade(s):
    return mutate.unlink_many(s.table("Customer"), "c_custkey", "c_nationkey", _pairs(s, F.col("c_nationkey")), "cascade").select("c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE o_custkey END AS o_custkey FROM orders")
def link_to_one(s):
    changed = s.table("Orders").where("o_orderstatus = 'P' or o_orderpriority = '1-URGENT'")
    pairs = changed.select(F.col("o_orderkey").alias("owner"), F.when(F.col("o_orderstatus") != "P", 1).alias("related"))
    return mutate.link_one(s.table("Orders"), "o_orderkey", "o_custkey", pairs).select("o_orderkey", "o_custkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS related FROM customer WHERE c_nationkey = 3")
def keys_for_owner(s):
    return relations.keys_of(s, "Nation", "customers", 3).select(F.col("related").cast("string"))


@query("SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 450000")
def rows_by_key(s):
    return relations.rows_by_key(s, "Customer", s.table("Orders").where("o_totalprice > 450000").select("o_custkey")).select("c_custkey", "c_name")


@query("SELECT doc_id AS pk, CASE WHEN l.doc_id IS NULL THEN 'Document' ELSE 'Label' END AS entity FROM documents LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)")
def canonical_targets(s):
    return relations.canonical(inherit.typed_keys(s, "Document").select("pk", "entity"), s)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= -500)")
def missing_targets(s):
    return relations.missing_targets(Store(s.spark, s.catalog, s.tables | {"customer": s.table("Customer").where(~in_debt())}), "Orders", "customer")


# --- migration ----------------------------------------------------------------------------------------------------


def _renamed(s: Store) -> Catalog:
    c = s.entity("Customer")
    attributes = (Attribute("c_name", unique=True), Attribute("c_acctbal", "double"), Attribute("c_segment", original="c_mktsegment"), Attribute("c_note", default="none", optional=False))
    return Catalog(s.catalog.entities | {"Customer": replace(c, attributes=attributes)})


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment AS c_segment, 'none' AS c_note FROM customer")
def migrate_apply(s):
    return migrate.apply(s, _renamed(s)).table("Customer")


@query("SELECT 'rename attribute' AS kind, 'Customer' AS entity, 'c_segment' AS detail, 'inferred' AS style UNION ALL SELECT 'add attribute', 'Customer', 'c_note', 'compatible'")
def migrate_steps(s):
    return s.spark.createDataFrame([(x.kind, x.entity, x.detail, x.style) for x in migrate.diff(s.catalog, _renamed(s))], "kind string, entity string, detail string, style string")


@query(
    """SELECT 'Orders: o_orderstatus is not unique' AS problem FROM (SELECT 1 FROM orders GROUP BY o_orderstatus HAVING count(*) > 1 LIMIT 1)
    UNION ALL SELECT 'Orders.o_note is required, has no default, and there are rows' FROM (SELECT 1 FROM orders LIMIT 1)
    UNION ALL SELECT 'Event still has rows' FROM (SELECT 1 FROM events LIMIT 1)"""
)
def migrate_checks(s):
    o = s.entity("Orders")
    attributes = tuple(replace(a, unique=True) if a.name == "o_orderstatus" else a for a in o.attributes) + (Attribute("o_note", optional=False),)
    new = Catalog({n: e for n, e in (s.catalog.entities | {"Orders": replace(o, attributes=attributes)}).items() if n != "Event"})
    return s.spark.createDataFrame([(x,) for x in migrate.check(s, migrate.diff(s.catalog, new))], "problem string")


@query("SELECT 'unique' AS kind, 'p_brand,p_type,p_size' AS columns, CAST(p_partkey AS VARCHAR) AS pk FROM part WHERE (p_brand, p_type, p_size) IN (SELECT (p_brand, p_type, p_size) FROM part GROUP BY p_brand, p_type, p_size HAVING count(*) > 1)")
def unique_check(s):
    whole = replace(s.entity("Part"), unique=(("p_brand", "p_type", "p_size"),))
    return mutate.violations(Store(s.spark, Catalog(s.catalog.entities | {"Part": whole}), s.tables), "Part")


@query(
    """SELECT 'doc_id' AS "column", count(doc_id) AS n_values, count(doc_id) = 0 AS unused FROM documents UNION ALL SELECT 'quality', count(quality), count(quality) = 0 FROM documents LEFT JOIN labels USING (doc_id)
    UNION ALL SELECT 'never', 0, true"""
)
def unused_columns(s):
    return migrate.column_fill(inherit.polymorphic(s, "Document").select("doc_id", "quality", F.lit(None).cast("string").alias("never")))


@query("SELECT 'check' AS kind, 'c_acctbal > 0' AS columns, CAST(c_custkey AS VARCHAR) AS pk FROM customer WHERE NOT (c_acctbal > 0)")
def check_constraint(s):
    bound = replace(s.entity("Customer"), checks=("c_acctbal > 0", "c_mktsegment is not null"))
    return mutate.violations(Store(s.spark, Catalog(s.catalog.entities | {"Customer": bound}), s.tables), "Customer")


@query("SELECT 'unique' AS kind, 'c_note' AS columns, CAST(c_custkey AS VARCHAR) AS pk FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
def unique_without_case(s):
    """Notes that differ only in case, and others that don't repeat."""
    note = F.when(building(), "Same").when(F.col("c_mktsegment") == "FURNITURE", "SAME").otherwise(F.col("c_custkey").cast("string"))
    e = Entity("Noted", "noted", "c_custkey", (Attribute("c_note", unique=True, nocase=True),))
    return mutate.violations(Store(s.spark, Catalog.of(e), {"noted": s.table("Customer").select("c_custkey", note.alias("c_note"))}), "Noted")


@query("SELECT 'unique' AS kind, 'o_custkey' AS columns, CAST(o_orderkey AS VARCHAR) AS pk FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1)")
def unique_partial_index(s):
    one = replace(s.entity("Orders"), indexes=(Index(("o_custkey",), True, "o_orderstatus = 'P'"),))
    return mutate.violations(Store(s.spark, Catalog(s.catalog.entities | {"Orders": one}), s.tables), "Orders")


@query("SELECT c_custkey, c_name || '/' || c_mktsegment AS c_label, c_acctbal < 0 AS wrong FROM customer")
def generated_column(s):
    """Generated values, and those that were written over by hand."""
    e = Entity("Labelled", "labelled", "c_custkey", (Attribute("c_label", generated="concat(c_name, '/', c_mktsegment)"),))
    rows = mutate.generate(s.table("Customer"), e)
    by_hand = rows.withColumn("c_label", F.when(F.col("c_acctbal") < 0, "x").otherwise(F.col("c_label")))
    bad = mutate.violations(Store(s.spark, Catalog.of(e), {"labelled": by_hand}), "Labelled").where("kind = 'generated'").select(F.col("pk").cast("long").alias("c_custkey"), F.lit(True).alias("_bad"))
    return rows.join(bad, "c_custkey", "left").select("c_custkey", "c_label", F.coalesce("_bad", F.lit(False)).alias("wrong"))


def committed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit that keeps rows together by an index, read back by its columns."""
    s = store(spark, sf_dir)
    catalog = Catalog(s.catalog.entities | {"Orders": replace(s.entity("Orders"), indexes=(Index(("o_orderdate",)),))})
    snapshots = SnapshotStore(spark, f"{shared_dir(spark)}/commits-{uuid.uuid4().hex}")
    snapshots.commit({"orders": s.table("Orders"), "customer": s.table("Customer")}, catalog=catalog)
    snapshots.commit({"customer": s.table("Customer").where(building())})
    late = snapshots.load(catalog)
    return late.table("Orders").where("o_orderdate >= timestamp_ntz '1997-01-01'").join(late.table("Customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey")


QUERIES["committed_index"] = committed_index
SQL["committed_index"] = "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND c_mktsegment = 'BUILDING'"


# --- inheritance --------------------------------------------------------------------------------------------------


@query("SELECT 'Label' AS entity, l.doc_id, CAST(quality AS VARCHAR) AS v FROM labels l JOIN documents USING (doc_id) UNION ALL SELECT 'Document', d.doc_id, source FROM documents d JOIN labels USING (doc_id)")
def split_rows(s):
    parts = inherit.split(s, "Label", inherit.with_ancestors(s, "Label"))
    return labelled({"Label": parts["Label"].select("doc_id", F.col("quality").cast("string").alias("v")), "Document": parts["Document"].select("doc_id", F.col("source").alias("v"))}, "entity")


@query("SELECT doc_id AS pk, 'Document' AS entity FROM documents")
def upcast_keys(s):
    return inherit.upcast(inherit.concrete_types(s, "Document"), "Document")


@query("SELECT 'Label,Document' AS up, 'Document,Label' AS down, true AS unrelated")
def inheritance_path(s):
    c = s.catalog
    return s.spark.createDataFrame([(",".join(c.path("Label", "Document")), ",".join(c.path("Document", "Label")), c.path("Label", "Part") is None)], "up string, down string, unrelated boolean")


@query("SELECT doc_id FROM labels JOIN documents USING (doc_id) ORDER BY source NULLS LAST, doc_id LIMIT 30")
def sort_inherited(s):
    return fetch_identifiers(s, Req("Label", sort=[(lambda x: x.source, "asc"), (lambda x: x.doc_id, "asc")], limit=30))


# --- scans and scalars --------------------------------------------------------------------------------------------


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 GROUP BY c_nationkey")
def scan_named_sql(s):
    return s.sql("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal BETWEEN :low AND :high GROUP BY c_nationkey", {"low": 0, "high": 5000})


@query("SELECT r_regionkey AS single, true AS known, false AS unknown, (SELECT count(*) FROM nation) AS rows, (SELECT sum(n_nationkey) FROM nation) AS folded FROM region WHERE r_name = 'ASIA'")
def store_lookups(s):
    found = (s.single_key("Region", "r_name = 'ASIA'"), s.row_exists("Nation", 3), s.table_exists("nowhere") or s.row_exists("Nation", -1), s.count("Nation"), s.fold("SELECT n_nationkey FROM nation", 0, lambda n, r: n + r[0]))
    return s.spark.createDataFrame([found], "single int, known boolean, unknown boolean, rows long, folded long")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def attached_table(s):
    s.attach("archive", s.table("Orders").where("o_totalprice > 450000"))
    out = s.sql("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM archive)")
    s.detach("archive")
    return out


@query("SELECT n_nationkey AS pk, 'fixture' AS store, 'Nation' AS entity FROM nation")
def persistent_identifiers(s):
    ids = Store(s.spark, s.catalog, s.tables, "fixture").identifiers("Nation")
    return ids.select(F.col("id.key").cast("int").alias("pk"), "id.store", "id.entity")


@query("SELECT (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') > 1 AS several, false AS one")
def ambiguity_probe(s):
    found = ambiguous(s, "Customer", lambda c: c.c_mktsegment == "BUILDING"), ambiguous(s, "Region", lambda r: r.r_name == "ASIA")
    return s.spark.createDataFrame([found], "several boolean, one boolean")


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS keys FROM customer")
def random_order(s):
    return fetch(s, Req("Customer", random=True)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_custkey").alias("keys"))


@dataclass
class Limits:
    low: float
    segments: list[str]


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_mktsegment IN ('BUILDING', 'FURNITURE')")
def filter_captured(s):
    limits = Limits(9000.0, ["BUILDING", "FURNITURE"])
    return fetch_identifiers(s, Req("Customer", lambda c: (c.c_acctbal > limits.low) & c.c_mktsegment.in_(limits.segments)))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS as_text, hex(o_orderstatus) AS as_bytes FROM orders")
def cast_text_and_bytes(s):
    out = fetch(s, Req("Orders", properties=[], computed={"as_text": lambda o: o.o_orderkey.cast("string"), "as_bytes": lambda o: o.o_orderstatus.cast("binary")}))
    return out.select("o_orderkey", "as_text", F.hex("as_bytes").alias("as_bytes"))


@query("SELECT event_id, json_extract_string('{\"a''b\\\"c.d\": ' || event_id || '}', '$.\"a''b\\\"c.d\"') AS v FROM events")
def json_quoted_key(s):
    text = F.concat(F.lit('{"a\'b\\"c.d": '), F.col("event_id").cast("string"), F.lit("}"))
    return s.table("Event").select("event_id", S.json_key(text, "a'b\"c.d", "string").alias("v"))


@query(
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'integer' WHEN 'click' THEN 'real' WHEN 'error' THEN 'null' WHEN 'signup' THEN 'array' ELSE 'text' END AS kind FROM events"""
)
def json_dynamic_type(s):
    value = F.when(F.col("event_type") == "view", "7").when(F.col("event_type") == "click", "7.5").when(F.col("event_type") == "error", "null").when(F.col("event_type") == "signup", "[1]").otherwise('"7"')
    return s.table("Event").select("event_id", S.json_type(F.concat(F.lit('{"k": '), value, F.lit("}")), "k").alias("kind"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 1 OR c_nationkey = 2 THEN '1,2' ELSE '1,' || c_nationkey || ',2' END AS items FROM customer")
def ordered_union(s):
    both = s.table("Customer").select("c_custkey", F.array(F.lit(1), F.col("c_nationkey")).alias("a"), F.array(F.col("c_nationkey"), F.lit(2)).alias("b"))
    return both.select("c_custkey", F.concat_ws(",", sets.ordered_union("a", "b").cast("array<string>")).alias("items"))


# --- history ------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, 1000 AS first, 999 + count(*) AS last, count(*) AS numbers, 'save' AS author FROM customer WHERE c_mktsegment = 'BUILDING'")
def hist_record(s):
    c = s.table("Customer").where(building())
    changes = c.select(F.lit("update").alias("event"), F.lit("Customer").alias("entity_name"), F.col("c_custkey").alias("entity_pk"), F.lit("c_acctbal").alias("property_names"), F.lit(None).cast("string").alias("preserved_values"))
    rows = history.record(changes, 1000, NOW, "save", "even")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("pk").alias("first"), F.max("pk").alias("last"), F.countDistinct("pk").alias("numbers"), F.max("author").alias("author"))


@log_query(f'SELECT pk FROM log WHERE year(make_timestamp("timestamp")) BETWEEN 2023 AND 2024 AND "timestamp" >= {CUT}')
def hist_bounded_archives(log):
    low, high = history.bounds(CUT, None, (0, NOW + 400 * history.DAY))
    low, high = history.bounds(low, high, (CUT + history.DAY, NOW), union=True)
    archives = {y: log.where(S.year_of_micros(F.col("timestamp")) == y) for y in (2019, 2023, 2024, 2030)}
    wanted = [archives[y] for y in history.years_of(low, min(high, NOW), archives)]
    return history.all_logs(log.limit(0), wanted).where(F.col("timestamp") >= low).select("pk")


def hist_maintain(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    kept, cursors = history.maintain(change_log(spark, sf_dir), folder, NOW, retention=10 * history.DAY)
    count = F.count(F.lit(1)).alias("n")
    return labelled({"kept": kept.agg(count), "archived": spark.read.parquet(folder).agg(count), "cursors": cursors.agg(count)})


QUERIES["hist_maintain"] = hist_maintain
SQL["hist_maintain"] = f"""WITH log AS ({LOG}), old AS (SELECT * FROM log WHERE "timestamp" < {NOW} - {10 * history.DAY})
 SELECT 'kept' AS part, (SELECT count(*) FROM log) - (SELECT count(*) FROM old) AS n UNION ALL SELECT 'archived', count(*) FROM old
 UNION ALL SELECT 'cursors', count(DISTINCT (store_identifier, year(make_timestamp("timestamp")))) FROM old"""


@query("SELECT 5 AS hours, false AS archive, true AS purge UNION ALL SELECT 7, true, true UNION ALL SELECT 0, false, false")
def hist_due(s):
    hour = 3_600_000_000
    found = [(h, *history.due(0, 0, h * hour, 0.0, retention=30 * hour)) for h in (5, 7, 0)]
    return s.spark.createDataFrame(found, "hours int, archive boolean, purge boolean")


@log_query('SELECT pk, "timestamp" AS transaction_id, event FROM log WHERE "timestamp" IN (SELECT DISTINCT "timestamp" FROM log ORDER BY 1 LIMIT 40)')
def hist_rows(log):
    return history.history_rows(log.withColumn("store_identifier", F.lit("one")), history.HistoryRequest(limit=40, newest_first=False)).select("pk", "transaction_id", "event")


@log_query("SELECT DISTINCT entity_name FROM log")
def hist_entity_names(log):
    return history.entity_names(log)


# --- sync ---------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN 'at once' WHEN c_acctbal > -500 THEN 'later' ELSE 'waiting' END AS applied FROM orders JOIN customer ON c_custkey = o_custkey")
def sync_replay(s):
    c = s.table("Customer")
    now, parked = stream.park(s.table("Orders"), "o_custkey", c.where("c_acctbal > 0").select("c_custkey"))
    later, waiting = stream.replay(parked, "o_custkey", c.where("c_acctbal > -500").select("c_custkey"))
    return labelled({"at once": now.select("o_orderkey"), "later": later.select("o_orderkey"), "waiting": waiting.select("o_orderkey")}, "applied").select("o_orderkey", "applied")


@query("SELECT o_orderkey, CASE WHEN c_acctbal > -500 THEN o_custkey END AS o_custkey FROM orders JOIN customer ON c_custkey = o_custkey")
def sync_repair(s):
    c = s.table("Customer")
    now, waiting = stream.park(s.table("Orders"), "o_custkey", c.where("c_acctbal > 0").select("c_custkey"), required=False)
    return stream.repair(now, "o_orderkey", "o_custkey", waiting, c.where("c_acctbal > -500").select("c_custkey"))[0].select("o_orderkey", "o_custkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS entity_pk, 'c_acctbal' AS property_names FROM customer WHERE c_mktsegment <> 'BUILDING'")
def sync_column_filter(s):
    names = F.when(building(), "c_name").otherwise("c_name,c_acctbal")
    log = s.table("Customer").select(F.col("c_custkey").cast("string").alias("entity_pk"), F.lit("Customer").alias("entity_name"), F.lit("update").alias("event"), names.alias("property_names"))
    other = log.withColumn("entity_name", F.lit("Orders"))
    return stream.only(log.unionAll(other), ["Customer"], {"Customer": ["c_acctbal"]}).select("entity_pk", "property_names")


@query("SELECT 'customer-' || c_custkey AS record FROM customer WHERE c_acctbal < -500 UNION ALL SELECT 'order-' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < -500")
def sync_deleted_records(s):
    c, o = s.table("Customer"), s.table("Orders")
    key, buyer = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    records = c.select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("record"), key.alias("entity_pk"), F.lit(None).cast("string").alias("target_pk"))
    records = records.unionAll(o.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), buyer))
    return history.records_of_deleted(records, c.where(in_debt()).select(key.alias("entity_pk"))).select("record")


@query("SELECT 'n' || n_nationkey AS record FROM nation WHERE n_regionkey = 1")
def sync_projected_diff(s):
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("record")
    n = s.table("Nation")
    return history.projected_diff(n.select(name, "n_nationkey"), n.where("n_regionkey <> 1").select(name, "n_nationkey")).select("record")


@query('SELECT c_custkey + 5000000 AS "old", c_custkey AS "new" FROM customer WHERE c_mktsegment = \'BUILDING\'')
def sync_identity_conflicts(s):
    c = s.table("Customer")
    return stream.remap_conflicts(c.where(building()).select((F.col("c_custkey") + 5_000_000).alias("c_custkey"), "c_name"), c, "c_custkey", ["c_name"])


@query("SELECT doc_id, coalesce(quality, 0) AS quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NOT NULL")
def sync_defaults(s):
    return stream.with_defaults(inherit.polymorphic(s, "Document").select("doc_id", "quality", "toxic"), {"quality": 0}, ["toxic"])


@log_query("""SELECT date_trunc('day', make_timestamp("timestamp")) AS "start", event, count(*) AS n FROM log GROUP BY ALL""")
def windowed_changes(log):
    counts = stream.windowed_counts(log)
    return counts.withColumn("start", F.to_utc_timestamp("start", F.current_timezone()).cast("timestamp_ntz")) if log.sparkSession.conf.get("spark.sql.session.timeZone") != "UTC" else counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


# --- graph --------------------------------------------------------------------------------------------------------


def _node(entity: str, c: Column) -> Column:
    return F.concat(F.lit(f"{entity}:"), c.cast("string"))


@query("SELECT 'Nation:' || n_nationkey AS dst FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'Nation:' || n_nationkey FROM nation WHERE n_nationkey = 7")
def graph_edges(s):
    e = graph.build(s, EDGES[:1])
    return graph.edges_between(e, "Region:1").select("dst").unionAll(graph.edges_between(e, end="Nation:7").select("dst"))


@query(
    """WITH e AS (SELECT 'Region:' || n_regionkey AS src, 'Nation:' || n_nationkey AS dst FROM nation)
    SELECT 'set' AS part, src, dst FROM e WHERE src <> 'Region:1' UNION ALL VALUES ('set', 'Region:1', 'Nation:0'), ('set', 'Region:1', 'Nation:9')
    UNION ALL SELECT 'all', src, dst FROM e WHERE src <> 'Region:1' UNION ALL SELECT 'incoming', src, dst FROM e WHERE dst <> 'Nation:7' UNION ALL SELECT 'missing', src, dst FROM e WHERE src <> 'Region:2'"""
)
def graph_edit(s):
    e = graph.build(s, EDGES[:1])
    parts = {"set": graph.set_targets(e, "Region:1", "nations", ["Nation:0", "Nation:9", "Nation:0"]), "all": graph.remove_all(e, "Region:1"), "incoming": graph.remove_incoming(e, "Nation:7"), "missing": graph.clear_missing(e, "Region:2", [])}
    return labelled({k: df.select("src", "dst") for k, df in parts.items()})


@query("SELECT 'Region:' || r_regionkey AS owner, (SELECT string_agg('Nation:' || n_nationkey, ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS targets FROM region UNION ALL SELECT 'Region:99', NULL")
def graph_cached(s):
    owners = s.table("Region").select(_node("Region", F.col("r_regionkey")).alias("owner")).unionAll(s.spark.createDataFrame([("Region:99",)], "owner string"))
    return graph.cached_references(graph.build(s, EDGES[:1]), owners, "nations").select("owner", F.when(F.col("targets").isNotNull(), F.concat_ws(",", "targets")).alias("targets"))


@query("SELECT 'Nation:' || n_nationkey AS \"old\", 'Nation:' || (SELECT max(n_nationkey) FROM nation) AS \"new\" FROM nation WHERE n_nationkey < (SELECT max(n_nationkey) FROM nation)")
def graph_remap_chain(s):
    n = s.table("Nation")
    return graph.canonical_remap(_next(n).toDF("old", "new"))


def _next(n: DataFrame) -> DataFrame:
    """Each nation and the one after it."""
    after = n.select((F.col("n_nationkey") - 1).alias("_k"))
    return n.join(after, F.col("n_nationkey") == F.col("_k")).select(_node("Nation", F.col("n_nationkey")), _node("Nation", F.col("n_nationkey") + 1))


@query("SELECT 'Nation:' || n_nationkey AS node, n_nationkey AS depth FROM nation WHERE n_nationkey > 0")
def graph_reach_chain(s):
    edges = _next(s.table("Nation")).toDF("src", "dst").withColumns({"property": F.lit("next"), "ord": F.lit(1)})
    return graph.reachable(edges, s.spark.createDataFrame([("Nation:0",)], "node string"))


# --- caches and editing state -------------------------------------------------------------------------------------


@query("SELECT 'first' AS part, count(*) AS n FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'changed', count(*) FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' UNION ALL SELECT 'preloaded', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'hits', 1")
def cache_versions(s):
    cache, count = ResultCache(), F.count(F.lit(1)).alias("n")

    def rich() -> DataFrame:
        return fetch_identifiers(s, Req("Customer", lambda c: c.c_acctbal > 0))

    def count_of(key: str, make) -> int:
        return cache.get(s, key, ("customer",), make).agg(count).first()["n"]

    out = [("first", count_of("rich", rich))]
    count_of("rich", rich)
    cache.preload(s, "all", ("customer",), lambda: s.table("Customer"))  # stale as soon as the table is replaced
    cache.preloaded["all"][1].result()
    s.replace("customer", s.table("Customer").where(building()))
    out += [("changed", count_of("rich", rich)), ("preloaded", count_of("all", lambda: s.table("Customer"))), ("hits", cache.hits)]
    cache.clear()
    return s.spark.createDataFrame(out, "part string, n long")


@query("SELECT 'equals' AS part, 2 AS n UNION ALL SELECT 'differs', count(*) - 2 FROM customer UNION ALL SELECT 'stored', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'")
def editing_state(s):
    state, c, count = EditingState(), s.table("Customer"), F.count(F.lit(1)).alias("n")
    args = ("Customer", F.col("c_custkey"), "c_mktsegment", "BUILDING", F.col("c_mktsegment"))
    parts = {"stored": c.where(state.equals(*args)).agg(count)}
    for key, value in ((1, "BUILDING"), (2, "BUILDING"), (3, "DRAFT")):
        state.set("Customer", key, "c_mktsegment", value)
    parts |= {"equals": c.where(state.equals(*args)).agg(count), "differs": c.where(state.differs(*args)).agg(count)}
    return labelled(parts)


@query("SELECT count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def count_page_whole(s):
    return fetch_count(s, Req("Customer", lambda c: (c.c_acctbal > 0) & (c.c_mktsegment == "BUILDING")))


def blob_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts moved out to a side table and back in."""
    from tessera.sources.blobs import relocate_in, relocate_out

    folder = f"{shared_dir(spark)}/side-{uuid.uuid4().hex}"
    docs = store(spark, sf_dir).table("Document").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return relocate_in(relocate_out(docs, "doc_id", "text", folder), "doc_id", "text", folder).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


QUERIES["blob_round_trip"] = blob_round_trip
SQL["blob_round_trip"] = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest FROM documents"
