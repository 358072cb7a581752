"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import Attribute, Catalog, Entity
from tessera.expressions import evaluate, when
from tessera.functions import scalar as S
from tessera.operators import graph, history, inherit, mutate, relations, sets
from tessera.operators.fetch import FetchRequest as Req
from tessera.operators.fetch import fetch, fetch_count, fetch_identifiers, fetch_sectioned, keyset_page
from tessera.sources.fixtures import change_log, store
from tessera.sources.shared import shared_dir
from tessera.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Callable[[Store], DataFrame]], Query]:
    """Registers a function of the store under its name."""

    def add(f: Callable[[Store], DataFrame]) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(store(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return QUERIES[f.__name__]

    return add


def log_query(sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], Query]:
    """Registers a function of the change log; `log` stands for it in the SQL."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(change_log(spark, sf_dir))
        SQL[f.__name__] = f"WITH log AS ({LOG}) {sql}"
        return QUERIES[f.__name__]

    return add


LOG = """SELECT event_id AS pk, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS event,
 'Event' AS entity_name, CAST(user_id AS VARCHAR) AS entity_pk, epoch_us(ts) AS "timestamp",
 CASE WHEN event_type = 'view' THEN 'remote' ELSE 'local' END AS author,
 CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS store_identifier FROM events"""

ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
PART = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"

# --- the flagship: to-one path, to-many closure, top-k ------------------------------------------------------------


@query(
    f"""SELECT {ORDER} FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    WHERE o_totalprice > 300000 AND c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45)
    ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 10"""
)
def fetch_topk(s):
    return fetch(
        s,
        Req(
            "Orders",
            lambda o: (o.o_totalprice > 300000) & (o.customer.c_mktsegment == "BUILDING") & o.items.any(lambda i: i.l_quantity >= 45),
            sort=[(lambda o: o.o_orderdate, "desc"), (lambda o: o.o_orderkey, "asc")],
            limit=10,
        ),
    )


# --- scans and lookups --------------------------------------------------------------------------------------------


@query("SELECT * FROM nation")
def scan_entity(s):
    return fetch(s, Req("Nation"))


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_custkey = 42 LIMIT 1")
def scan_by_key(s):
    return s.by_key("Customer", 42)


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY c_mktsegment")
def scan_raw_sql(s):
    return s.sql("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > ? GROUP BY c_mktsegment", [1000])


@query(f"SELECT {PART} FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice > 910")
def scan_passthrough(s):
    return fetch(s, Req("Part", lambda p: p.sql("p_size BETWEEN 10 AND 30 AND p_retailprice > 910")))


@query("SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL AND p_size = 7")
def scan_keys(s):
    return s.keys("Part", "p_size = 7")


@query("""SELECT o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS j FROM orders""")
def scan_json_rows(s):
    return s.table("Orders").select("o_orderkey", S.json_row(["o_orderkey", "o_orderstatus"]).alias("j"))


# --- predicates ---------------------------------------------------------------------------------------------------


@query(f"SELECT {ORDER} FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
def filter_compare(s):
    return fetch(s, Req("Orders", lambda o: (o.o_totalprice >= 100000) & (o.o_totalprice < 150000)))


@query(f"SELECT {ORDER} FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND NOT (o_totalprice < 50000)")
def filter_and_or_not(s):
    return fetch(s, Req("Orders", lambda o: ((o.o_orderstatus == "F") | (o.o_orderpriority == "1-URGENT")) & ~(o.o_totalprice < 50000)))


@query(f"SELECT {ORDER} FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(s):
    return fetch(s, Req("Orders", lambda o: o.o_orderpriority.in_(["1-URGENT", "2-HIGH"])))


@query(f"SELECT {ORDER} FROM orders WHERE o_orderstatus <> 'O'")
def filter_not_equal(s):
    return fetch(s, Req("Orders", lambda o: o.o_orderstatus != "O"))


@query("SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def filter_null(s):
    return fetch_identifiers(s, Req("Document", lambda d: d.as_type("Label").quality == None))  # noqa: E711


@query("SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality <> 1")
def filter_not_equal_null(s):
    return fetch_identifiers(s, Req("Document", lambda d: d.as_type("Label").quality != 1))


@query("SELECT c_custkey FROM customer WHERE CASE WHEN c_acctbal > 0 THEN c_mktsegment = 'BUILDING' WHEN NOT c_acctbal > 0 THEN c_mktsegment = 'MACHINERY' ELSE false END")
def filter_conditional(s):
    return fetch_identifiers(s, Req("Customer", lambda c: when(c.c_acctbal > 0, c.c_mktsegment == "BUILDING", c.c_mktsegment == "MACHINERY")))


@query("SELECT doc_id FROM documents LEFT JOIN labels l USING (doc_id) WHERE CASE WHEN l.quality = 1 THEN 1 WHEN NOT l.quality = 1 THEN 2 ELSE 0 END = 0")
def filter_conditional_null(s):
    return fetch_identifiers(s, Req("Document", lambda d: when(d.as_type("Label").quality == 1, 1, 2) == 0))


@query("SELECT doc_id FROM documents LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 0) = 0")
def filter_coalesce(s):
    return fetch_identifiers(s, Req("Document", lambda d: d.as_type("Label").quality.or_else(0) == 0))


@query("SELECT doc_id FROM documents LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.quality > 0")
def optional_chain(s):
    return fetch_identifiers(s, Req("Document", lambda d: d.as_type("Label").quality.flat_map(lambda q: q > 0)))


@query("SELECT o_orderkey FROM orders WHERE true AND (o_totalprice > 400000)")
def filter_folded(s):
    from tessera.expressions import Lit

    return fetch_identifiers(s, Req("Orders", lambda o: when(Lit(1) == 1, o.o_totalprice > 400000, o.o_totalprice < 0) & (Lit(2) != 3)))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (1, 5, 9, 14) LIMIT 4")
def filter_identifier_set(s):
    return fetch_identifiers(s, Req("Orders", ids=[1, 5, 9, 14]))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9")
def filter_between(s):
    return fetch_identifiers(s, Req("Part", lambda p: p.p_size.between(5, 9)))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#1[0-3]$')")
def filter_regex(s):
    return fetch_identifiers(s, Req("Part", lambda p: p.p_brand.matches("^Brand#1[0-3]$")))


# --- strings ------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%'")
def str_contains(s):
    return fetch(s, Req("Part", lambda p: p.p_name.contains_text("RING"))).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE 'r_d%'")
def str_prefix(s):
    return fetch_identifiers(s, Req("Part", lambda p: p.p_name.starts_with("R_D")))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '#0000') AND NOT contains(c_name, '%')")
def str_escaped(s):
    return fetch_identifiers(s, Req("Customer", lambda c: c.c_name.contains_text("#0000", escape=True) & ~c.c_name.contains_text("%", escape=True)))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def str_icompare(s):
    return fetch_identifiers(s, Req("Customer", lambda c: c.c_mktsegment.compares_to("bUiLdInG")))


@query("SELECT count(*) AS n FROM documents WHERE text = ''")
def str_empty(s):
    return fetch_count(s, Req("Document", lambda d: d.text.is_empty_text()))


@query("SELECT p_partkey, p_brand || '/' || p_type AS label FROM part")
def str_concat(s):
    return fetch(s, Req("Part", computed={"label": lambda p: p.p_brand.concat("/", p.p_type)})).select("p_partkey", "label")


# --- arithmetic ---------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS v, l_quantity - 3 AS w FROM lineitem WHERE l_quantity * 2 > 95")
def math_infix(s):
    return fetch(s, Req("LineItem", lambda i: i.l_quantity * 2 > 95, computed={"v": lambda i: i.l_extendedprice * (1 - i.l_discount) + i.l_tax, "w": lambda i: i.l_quantity - 3})).select("l_orderkey", "l_linenumber", "v", "w")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / NULLIF(l_discount, 0) AS v FROM lineitem")
def math_float(s):
    return fetch(s, Req("LineItem", computed={"v": lambda i: i.l_extendedprice / i.l_discount})).select("l_orderkey", "l_linenumber", "v")


@query("SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) // NULLIF(CAST(p_size - 10 AS BIGINT), 0) AS v FROM part")
def math_int(s):
    return fetch(s, Req("Part", computed={"v": lambda p: p.p_retailprice // (p.p_size - 10)})).select("p_partkey", "v")


@query("SELECT p_partkey, CAST(p_size - 25 AS BIGINT) % 7 AS v FROM part")
def math_mod(s):
    return fetch(s, Req("Part", computed={"v": lambda p: (p.p_size - 25) % 7})).select("p_partkey", "v")


@query("SELECT c_custkey, -c_acctbal AS v, CAST(trunc(c_acctbal) AS BIGINT) AS w FROM customer")
def math_neg_cast(s):
    return fetch(s, Req("Customer", computed={"v": lambda c: -c.c_acctbal, "w": lambda c: c.c_acctbal.cast("bigint")})).select("c_custkey", "v", "w")


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y FROM events")
def year_of_epoch(s):
    return s.table("Event").select("event_id", S.year_of_micros(S.epoch_micros(F.col("ts"))).alias("y"))


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 20 DAY - INTERVAL 3 HOUR")
def calendar_ttl(s):
    return s.table("Event").where(F.col("ts") < S.before(F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"), days=20, hours=3)).select("event_id")


# --- dictionaries and arrays --------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE CAST(props->>'k' AS BIGINT) > 90")
def json_key(s):
    return fetch(s, Req("Event", lambda e: e.props.key("k", "bigint") > 90, computed={"k": lambda e: e.props.key("k", "bigint")})).select("event_id", "k")


@query("SELECT event_id, coalesce(CAST(props->>'absent' AS BIGINT), -1) AS k FROM events")
def json_key_default(s):
    return fetch(s, Req("Event", computed={"k": lambda e: e.props.key("absent", "bigint", -1)})).select("event_id", "k")


@query("SELECT event_id FROM events WHERE props->>'k' = '7'")
def composite_field(s):
    return fetch_identifiers(s, Req("Event", lambda e: e.props.k == "7"))


@query("SELECT vec_id, embedding[4] AS a, embedding[1000] AS b FROM embeddings")
def array_index(s):
    return fetch(s, Req("Embedding", computed={"a": lambda e: e.embedding.at(3), "b": lambda e: e.embedding.at(999)})).select("vec_id", "a", "b")


@query("SELECT vec_id, embedding[-2] AS a FROM embeddings")
def array_negative_index(s):
    return fetch(s, Req("Embedding", computed={"a": lambda e: e.embedding.at(-2)})).select("vec_id", "a")


@query("SELECT vec_id, embedding[3] AS a, embedding[5] AS c, 3 AS n, 0 AS z FROM embeddings")
def array_slice(s):
    df = fetch(s, Req("Embedding", computed={"part": lambda e: e.embedding.slice(2, 5), "none": lambda e: e.embedding.slice(-1, 2)}))
    return df.select("vec_id", S.element(F.col("part"), 0).alias("a"), S.element(F.col("part"), -1).alias("c"), F.size("part").alias("n"), F.size("none").alias("z"))


@query("SELECT vec_id FROM embeddings WHERE list_contains(embedding, embedding[1]) AND len(embedding) = 64")
def array_contains(s):
    return fetch_identifiers(s, Req("Embedding", lambda e: e.embedding.has(e.embedding.at(0)) & (e.embedding.length() == 64)))


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.35)) > 0")
def array_any(s):
    return fetch_identifiers(s, Req("Embedding", lambda e: e.embedding.any_value(lambda x: x > 0.35)))


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: NOT x < 0.3)) = 0")
def array_all(s):
    return fetch_identifiers(s, Req("Embedding", lambda e: e.embedding.all_values(lambda x: x < 0.3)))


@query("SELECT vec_id, list_max(embedding) AS hi, list_min(embedding) AS lo FROM embeddings")
def array_max_min(s):
    return fetch(s, Req("Embedding", computed={"hi": lambda e: e.embedding.max_value(), "lo": lambda e: e.embedding.min_value()})).select("vec_id", "hi", "lo")


# --- relationships ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0")
def to_one_path(s):
    return fetch_identifiers(s, Req("Orders", lambda o: o.customer.c_acctbal < 0))


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' OR o_totalprice > 450000")
def to_one_chain(s):
    return fetch_identifiers(s, Req("Orders", lambda o: (o.customer.nation.region.r_name == "ASIA") | (o.o_totalprice > 450000)))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def to_many_any(s):
    return fetch_identifiers(s, Req("Customer", lambda c: c.orders.any(lambda o: o.o_totalprice > 400000)))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def to_many_none(s):
    return fetch_identifiers(s, Req("Customer", lambda c: ~c.orders.any(lambda o: o.o_totalprice > 400000)))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def to_many_under_or(s):
    return fetch_identifiers(s, Req("Customer", lambda c: (c.c_acctbal > 9000) | c.orders.any(lambda o: o.o_totalprice > 450000)))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49))")
def to_many_nested(s):
    return fetch_identifiers(s, Req("Customer", lambda c: c.orders.any(lambda o: (o.o_orderstatus == "F") & o.items.any(lambda i: i.l_quantity > 49))))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_extendedprice > c_acctbal * 10 AND l_quantity > 45)")
def to_many_outer_ref(s):
    return fetch_identifiers(s, Req("Customer", lambda c: c.orders.any(lambda o: o.items.any(lambda i: (i.l_extendedprice > c.c_acctbal * 10) & (i.l_quantity > 45)))))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_size > 48)")
def many_to_many_any(s):
    return fetch_identifiers(s, Req("Orders", lambda o: o.parts.any(lambda p: p.p_size > 48)))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey = 17)")
def many_to_many_contains(s):
    return fetch_identifiers(s, Req("Orders", lambda o: o.parts.contains(17)))


@query("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def rel_count(s):
    return fetch(s, Req("Orders", computed={"n": lambda o: o.items.count()})).select("o_orderkey", "n")


@query("SELECT o_orderkey FROM orders WHERE (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') >= 3")
def rel_filtered_count(s):
    return fetch_identifiers(s, Req("Orders", lambda o: o.items.filter(lambda i: i.l_returnflag == "R").count() >= 3))


@query("SELECT o_orderkey, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders")
def rel_bridge_count(s):
    return fetch(s, Req("Orders", computed={"n": lambda o: o.parts.count()})).select("o_orderkey", "n")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def rel_is_empty(s):
    return fetch_identifiers(s, Req("Orders", lambda o: o.items.is_empty()))


@query("SELECT o_custkey AS c_custkey, min_by(o_totalprice, o_orderkey) AS a, max_by(o_totalprice, o_orderkey) AS b FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def rel_first_last(s):
    return fetch(s, Req("Customer", computed={"a": lambda c: c.orders.first("o_totalprice"), "b": lambda c: c.orders.last("o_totalprice")})).select("c_custkey", "a", "b")


def _rich(c):
    return (c.c_acctbal > 5000) & (c.c_mktsegment == "AUTOMOBILE")


@query("WITH rich AS (SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'AUTOMOBILE') SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM rich r WHERE r.c_custkey = c.c_custkey) AND c_nationkey < 10")
def predicate_compose(s):
    return fetch_identifiers(s, Req("Customer", lambda c: evaluate(_rich, c) & (c.c_nationkey < 10)))


@query("SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey AS related FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def batched_keys(s):
    owners = s.table("Orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return relations.keys_of_many(s, "Orders", "parts", owners).withColumnRenamed("owner", "o_orderkey")


@query("SELECT n_nationkey AS owner, c_custkey, c_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def batched_rows(s):
    owners = s.table("Nation").where("n_regionkey = 1").select("n_nationkey")
    return relations.rows_of_many(s, "Nation", "customers", owners).select("owner", "c_custkey", "c_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3")
def rows_for_owner(s):
    return relations.rows_of(s, "Nation", "suppliers", 3).select("s_suppkey", "s_name")


@query("SELECT l_orderkey AS o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000) GROUP BY l_orderkey UNION ALL SELECT o_orderkey, '' FROM orders WHERE o_totalprice > 400000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def proj_prefetch_many(s):
    base = fetch(s, Req("Orders", lambda o: o.o_totalprice > 400000)).select("o_orderkey")
    return relations.prefetch_many(s, "Orders", base, "parts").select("o_orderkey", F.concat_ws(",", F.col("parts").cast("array<string>")).alias("parts"))


# --- projections, counts, sorts, pages ----------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def proj_partial(s):
    return fetch(s, Req("Orders", properties=["o_orderdate"]))


@query("SELECT p_partkey FROM part WHERE p_type = 'ECONOMY'")
def proj_ids(s):
    return fetch_identifiers(s, Req("Part", lambda p: p.p_type == "ECONOMY"))


@query(f"SELECT {ORDER}, c_custkey AS customer_c_custkey, c_name AS customer_c_name, c_nationkey AS customer_c_nationkey, c_acctbal AS customer_c_acctbal, c_mktsegment AS customer_c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def proj_prefetch_one(s):
    return fetch(s, Req("Orders", prefetch=["customer"]))


@query("SELECT n_nationkey, n_name, n_regionkey, r_regionkey AS region_r_regionkey, r_name AS region_r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA'")
def proj_joined(s):
    return fetch(s, Req("Nation", lambda n: n.region.r_name != "ASIA", include_joined=True))


@query("SELECT n_nationkey AS \"base.n_nationkey\", n_name AS \"base.n_name\", n_regionkey AS \"base.n_regionkey\" FROM nation")
def proj_qualified(s):
    return fetch(s, Req("Nation", qualified=True))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def count_filtered(s):
    return fetch_count(s, Req("Orders", lambda o: o.o_orderstatus == "P"))


@query("SELECT doc_id, quality FROM (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 40)")
def sort_nulls_last(s):
    return fetch(s, Req("Document", sort=[(lambda d: d.as_type("Label").quality, "desc"), (lambda d: d.doc_id, "asc")], limit=40, computed={"quality": lambda d: d.as_type("Label").quality})).select("doc_id", "quality")


@query("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY c_name DESC, o_orderkey LIMIT 25")
def sort_related(s):
    return fetch_identifiers(s, Req("Orders", sort=[(lambda o: o.customer.c_name, "desc"), (lambda o: o.o_orderkey, "asc")], limit=25))


@query("SELECT event_id FROM events ORDER BY props->>'k' ASC NULLS LAST, event_id LIMIT 30")
def sort_composite(s):
    return fetch_identifiers(s, Req("Event", sort=[(lambda e: e.props.k, "asc"), (lambda e: e.event_id, "asc")], limit=30))


@query("SELECT o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 20")
def sort_to_one_key(s):
    return fetch_identifiers(s, Req("Orders", sort=[(lambda o: o.customer, "asc"), (lambda o: o.o_orderkey, "asc")], limit=20))


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 15 OFFSET 30")
def page_offset(s):
    return fetch_identifiers(s, Req("Customer", sort=[(lambda c: c.c_acctbal, "asc"), (lambda c: c.c_custkey, "asc")], limit=15, offset=30))


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-05' OR (ts = TIMESTAMP '2024-01-05' AND event_id > 10) ORDER BY ts, event_id LIMIT 50")
def keyset(s):
    return keyset_page(s.table("Event"), ("ts", "event_id"), (F.lit("2024-01-05").cast("timestamp_ntz"), 10), 50).select("event_id", "ts")


SECTIONS = """WITH r AS (SELECT o_orderkey, o_orderstatus AS section, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS position,
 count(*) OVER (PARTITION BY o_orderstatus) AS section_count, o_orderdate FROM orders),
 h AS (SELECT section, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS i FROM r WHERE position = 1)
 SELECT o_orderkey, section, CAST(position AS INTEGER) AS position, section_count, CAST({index} AS INTEGER) AS section_index FROM r JOIN h USING (section) WHERE {where}"""


def _sections(s, **kw):
    return fetch_sectioned(s, Req("Orders", sort=[(lambda o: o.o_orderdate, "desc")]), lambda o: o.o_orderstatus, **kw).select("o_orderkey", "section", "position", "section_count", "section_index")


@query(SECTIONS.format(index="i", where="true"))
def sectioned(s):
    return _sections(s)


@query(SECTIONS.format(index="i", where="position <= 5"))
def sectioned_limit(s):
    return _sections(s, limit=5)


@query(SECTIONS.format(index="(SELECT count(*) FROM h) - i + 1", where="position <= 3"))
def sectioned_reverse(s):
    return _sections(s, limit=3, reverse=True)


# --- inheritance --------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS pk, 'Document' AS entity, 0 AS depth FROM documents UNION ALL SELECT doc_id, 'Label', 1 FROM labels")
def union_types(s):
    return inherit.typed_keys(s, "Document")


@query("SELECT doc_id AS pk, CASE WHEN l.doc_id IS NULL THEN 'Document' ELSE 'Label' END AS entity FROM documents LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)")
def concrete_type(s):
    return inherit.concrete_types(s, "Document")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def is_type(s):
    return fetch_identifiers(s, Req("Document", lambda d: d.is_type("Label")))


@query("SELECT d.doc_id, l.doc_id AS label_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def cast_type(s):
    return fetch(s, Req("Document", computed={"label_id": lambda d: d.as_type("Label")})).select("doc_id", "label_id")


@query("SELECT d.doc_id, lang, quality, toxic, CASE WHEN l.doc_id IS NULL THEN 'Document' ELSE 'Label' END AS entity_type FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def polymorphic_fetch(s):
    return inherit.polymorphic(s, "Document").select("doc_id", "lang", "quality", "toxic", "entity_type")


@query("SELECT l.doc_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.lang = 'de' AND l.quality = 1")
def subclass_inherited(s):
    return fetch_identifiers(s, Req("Label", lambda x: (x.lang == "de") & (x.quality == 1)))


@query("SELECT l.doc_id, quality, toxic, source, n_chars FROM labels l JOIN documents d USING (doc_id)")
def subclass_rows(s):
    return fetch(s, Req("Label", properties=["quality", "toxic", "source", "n_chars"]))


@query("SELECT d.doc_id, quality AS quality, source FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id = 8 LIMIT 1")
def hierarchy_row(s):
    return inherit.hierarchy_row(s, "Document", 8).select("doc_id", "quality", "source")


@query("SELECT 'Document' AS entity, count(*) AS n FROM documents UNION ALL SELECT 'Label', count(*) FROM labels")
def subtree_counts(s):
    return inherit.subtree_counts(s).where("entity in ('Document', 'Label')")


# --- sets ---------------------------------------------------------------------------------------------------------

OLD, NEW = "SELECT c_custkey FROM customer WHERE c_acctbal > 0", "SELECT c_custkey FROM customer WHERE c_acctbal < 5000"


def _old_new(s):
    c = s.table("Customer")
    return c.where("c_acctbal > 0").select("c_custkey"), c.where("c_acctbal < 5000").select("c_custkey")


@query(f"{NEW} EXCEPT {OLD}")
def set_diff(s):
    return sets.added(*_old_new(s))


@query(f"{NEW} INTERSECT {OLD}")
def set_intersect(s):
    return sets.kept(*_old_new(s))


@query(f"{NEW} UNION {OLD}")
def set_union(s):
    return sets.union_distinct(*_old_new(s))


@query(f"SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'inserted' WHEN n.c_custkey IS NULL THEN 'deleted' ELSE 'unchanged' END AS change FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.c_custkey = n.c_custkey")
def set_classify(s):
    return sets.classify(*_old_new(s), "c_custkey")


# --- change log ---------------------------------------------------------------------------------------------------

CUT = 1_706_000_000_000_000


@log_query('SELECT "timestamp" AS transaction_id, store_identifier, min_by(author, pk) AS author, count(*) AS n_changes, min(pk) AS first_pk FROM log GROUP BY ALL ORDER BY transaction_id DESC, store_identifier LIMIT 100')
def hist_fetch(log):
    return history.fetch_history(log, history.HistoryRequest(limit=100)).select("transaction_id", "store_identifier", "author", "n_changes", F.col("changes")[0]["pk"].alias("first_pk"))


@log_query(f"SELECT \"timestamp\" AS transaction_id, store_identifier, count(*) AS n_changes FROM log WHERE \"timestamp\" >= {CUT} AND event IN ('insert', 'delete') GROUP BY ALL")
def hist_predicate(log):
    where = (F.col("timestamp") >= CUT) & F.col("event").isin("insert", "delete")
    return history.fetch_history(log, history.HistoryRequest(where)).select("transaction_id", "store_identifier", "n_changes")


@log_query("SELECT pk, event, entity_pk FROM log WHERE author = 'local' AND store_identifier = 'odd'")
def hist_by_author(log):
    return log.where("author = 'local' and store_identifier = 'odd'").select("pk", "event", "entity_pk")


@log_query('SELECT DISTINCT "timestamp" AS transaction_id FROM log WHERE "timestamp" < ' + str(CUT) + " ORDER BY 1 DESC LIMIT 64")
def hist_page(log):
    return history.page(log, CUT, 64)


NOW = 1_706_700_000_000_000


@log_query(f'SELECT pk, "timestamp", CAST(year(make_timestamp("timestamp")) AS INTEGER) AS year FROM log WHERE "timestamp" < {NOW} - {10 * history.DAY}')
def hist_archive_year(log):
    return history.archivable(log, NOW, retention=10 * history.DAY).select("pk", "timestamp", "year")


@log_query(f'SELECT pk FROM log WHERE NOT ("timestamp" < {NOW} - {10 * history.DAY})')
def hist_purge(log):
    return history.purge(log, NOW, 10 * history.DAY).select("pk")


@log_query(f"""SELECT store_identifier, CAST(2024 AS INTEGER) AS year, max("timestamp") AS cursor_timestamp, max_by(pk, "timestamp") AS cursor_identifier, false AS is_complete FROM log WHERE "timestamp" < {NOW} - {10 * history.DAY} GROUP BY 1""")
def hist_cursor(log):
    return history.new_cursors(history.archivable(log, NOW, retention=10 * history.DAY), NOW)


@log_query("""SELECT entity_name, entity_pk, coalesce(max_by(pk, CASE WHEN event IN ('insert', 'delete') THEN pk END) FILTER (event IN ('insert', 'delete')), min(pk)) AS pk FROM log GROUP BY 1, 2""")
def hist_coalesce(log):
    return history.coalesce_changes(log).select("entity_name", "entity_pk", "pk")


@log_query("SELECT store_identifier, max(pk) AS watermark FROM log GROUP BY 1")
def hist_watermark(log):
    return history.token(log)


@log_query("""SELECT pk FROM log WHERE author <> 'remote' AND "timestamp" IN (SELECT "timestamp" FROM log WHERE pk > 500 AND author <> 'remote')""")
def hist_after_watermark(log):
    return history.after_watermark(log, 500).select("pk")


@log_query('SELECT store_identifier, count(*) AS n_rows, count(DISTINCT "timestamp") AS n_transactions FROM log GROUP BY 1')
def hist_counts(log):
    return history.counts(log)


@log_query("""SELECT pk FROM log WHERE ("timestamp", store_identifier) NOT IN (SELECT ("timestamp", store_identifier) FROM log WHERE event = 'delete')""")
def hist_delete(log):
    return history.delete_history(log, F.col("event") == "delete").select("pk")


@log_query(f'SELECT pk FROM log WHERE "timestamp" >= {CUT} UNION SELECT pk FROM log WHERE "timestamp" < {CUT + history.DAY}')
def hist_union_archives(log):
    return history.all_logs(log.where(F.col("timestamp") >= CUT), [log.where(F.col("timestamp") < CUT + history.DAY)]).select("pk")


def hist_missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = store(spark, sf_dir).table("Customer").where("c_acctbal > 0")
    return history.missing_rows_deleted(change_log(spark, sf_dir), have, "c_custkey").select("pk", "event")


QUERIES["hist_missing_rows"] = hist_missing_rows
SQL["hist_missing_rows"] = f"WITH log AS ({LOG}) SELECT pk, CASE WHEN event <> 'delete' AND CAST(entity_pk AS BIGINT) NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'delete' ELSE event END AS event FROM log"

# --- mutations ----------------------------------------------------------------------------------------------------

#: A batch that comes in: rich customers with a higher balance, poor ones unchanged, those in debt under new keys.
INCOMING = "SELECT CASE WHEN c_acctbal < 0 THEN c_custkey + 10000000 ELSE c_custkey END AS c_custkey, CASE WHEN c_acctbal > 8000 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'"


def _incoming(s):
    c = s.table("Customer").where("c_mktsegment <> 'BUILDING'")
    return c.select(
        F.when(F.col("c_acctbal") < 0, F.col("c_custkey") + 10000000).otherwise(F.col("c_custkey")).alias("c_custkey"),
        F.when(F.col("c_acctbal") > 8000, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
    )


@query(f"WITH i AS ({INCOMING}) SELECT coalesce(c.c_custkey, i.c_custkey) AS c_custkey, c_name, c_nationkey, CASE WHEN i.c_custkey IS NOT NULL THEN i.c_acctbal ELSE c.c_acctbal END AS c_acctbal, c_mktsegment FROM customer c FULL JOIN i ON i.c_custkey = c.c_custkey")
def upsert_merge(s):
    return mutate.upsert(s.table("Customer"), _incoming(s), "c_custkey")


@query(f"WITH i AS ({INCOMING}) SELECT i.c_custkey, c.c_custkey IS NULL AS is_insert, CASE WHEN c.c_custkey IS NULL THEN '' ELSE 'c_acctbal' END AS changed FROM i LEFT JOIN customer c ON i.c_custkey = c.c_custkey WHERE c.c_custkey IS NULL OR i.c_acctbal IS DISTINCT FROM c.c_acctbal")
def upsert_changes(s):
    return mutate.upsert_changes(s.table("Customer"), _incoming(s), "c_custkey")


@query(f"WITH i AS ({INCOMING}) SELECT c_custkey, 'c_acctbal' AS \"column\", c.c_acctbal < i.c_acctbal AS grew FROM customer c JOIN i USING (c_custkey) WHERE c.c_acctbal IS DISTINCT FROM i.c_acctbal")
def row_diff(s):
    d = mutate.diff(s.table("Customer").select("c_custkey", "c_acctbal"), _incoming(s), "c_custkey", ["c_acctbal"])
    return d.select("c_custkey", "column", (F.col("old").cast("double") < F.col("new").cast("double")).alias("grew"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_where(s):
    return mutate.update(s.table("Orders"), {"o_orderstatus": F.lit("F")}, F.col("o_orderstatus") == "P").select("o_orderkey", "o_orderstatus")


@query(f"SELECT {ORDER} FROM orders WHERE NOT (o_totalprice < 100000)")
def delete_where(s):
    return mutate.delete(s.table("Orders"), F.col("o_totalprice") < 100000)


@query("SELECT n.c_custkey + 5 AS c_custkey, n.c_name, m.c_custkey AS match, false AS conflict FROM customer n LEFT JOIN customer m ON m.c_name = n.c_name")
def unique_match(s):
    rows = s.table("Customer").select((F.col("c_custkey") + 5).alias("c_custkey"), "c_name")
    return mutate.match_unique(s.table("Customer"), rows, "c_custkey", [("c_name",)])


@query("SELECT n.c_custkey FROM customer n WHERE EXISTS (SELECT 1 FROM customer m WHERE m.c_custkey = n.c_custkey + 1)")
def unique_conflict(s):
    c = s.table("Customer")
    rows = c.select(F.col("c_custkey").alias("was"), (F.col("c_custkey") + 1).alias("c_custkey"), "c_name")
    return mutate.match_unique(c, rows, "c_custkey", [("c_name",), ("c_custkey",)]).where("conflict").select(F.col("was").alias("c_custkey"))


def _gone(s):
    return mutate.plan_delete(s, "Customer", s.table("Customer").where("c_acctbal < -500").select("c_custkey"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < -500)")
def delete_cascade(s):
    return mutate.apply_delete(s, _gone(s))["orders"].select("o_orderkey")


def keyed_items(s):
    """The store with a key for line items that no two orders share."""
    item = replace(s.entity("LineItem"), key="l_itemkey")
    return Store(s.spark, Catalog(s.catalog.entities | {"LineItem": item}), s.tables | {"lineitem": s.table("LineItem").withColumn("l_itemkey", F.col("l_orderkey") * 10 + F.col("l_linenumber"))})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < -500)")
def delete_cascade_deep(s):
    keyed = keyed_items(s)
    return mutate.apply_delete(keyed, _gone(keyed))["lineitem"].select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE c_nationkey END AS c_nationkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def delete_nullify(s):
    d = mutate.plan_delete(s, "Nation", s.table("Nation").where("n_regionkey = 1").select("n_nationkey"))
    return mutate.apply_delete(s, d)["customer"].select("c_custkey", "c_nationkey")


@query("SELECT n_nationkey AS pk FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')")
def delete_deny_check(s):
    try:
        mutate.plan_delete(s, "Region", s.table("Region").where("r_name <> 'ASIA'").select("r_regionkey"))
    except mutate.DeleteDenied as e:
        return e.blocking
    raise AssertionError("the delete went through")


@query("SELECT 'foreign key' AS kind, 'o_custkey' AS columns, CAST(o_orderkey AS VARCHAR) AS pk FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= -500)")
def fk_check(s):
    cut = Store(s.spark, s.catalog, s.tables | {"customer": s.table("Customer").where("c_acctbal >= -500")})
    return mutate.violations(cut, "Orders").where("kind = 'foreign key'")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_check(s):
    return mutate.duplicates(s.table("LineItem"), ["l_orderkey", "l_linenumber"])


@query("SELECT 'not null' AS kind, 'quality' AS columns, CAST(doc_id AS VARCHAR) AS pk FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def nonnull_check(s):
    graded = Catalog.of(Entity("Graded", "graded", "doc_id", (Attribute("quality", "int", optional=False),)))
    return mutate.violations(Store(s.spark, graded, {"graded": inherit.polymorphic(s, "Document").select("doc_id", "quality")}), "Graded")


@query("SELECT o_orderkey AS owner, l_partkey AS related, 'linked' AS change FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 2 EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 3) UNION ALL SELECT *, 'unlinked' FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 3 EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 2)")
def link_reconcile(s):
    pairs = s.table("LineItem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("related"), "l_linenumber")
    return mutate.link_changes(pairs.where("l_linenumber <= 3"), pairs.where("l_linenumber >= 2"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) < 5 OR count(o_orderkey) > 15")
def cardinality_check(s):
    c = s.entity("Customer")
    bounded = replace(c, relationships=tuple(replace(r, min_count=5, max_count=15) if r.name == "orders" else r for r in c.relationships))
    cut = Store(s.spark, type(s.catalog)(s.catalog.entities | {"Customer": bounded}), s.tables)
    return relations.cardinality_violations(cut, "Customer", "orders").withColumnRenamed("owner", "c_custkey")


@query("SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def remap_references(s):
    ids = s.table("Customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1000000).alias("new"))
    return mutate.remap(s.table("Orders"), ["o_custkey"], ids).select("o_orderkey", "o_custkey")


# --- graph --------------------------------------------------------------------------------------------------------

EDGES = [("Region", "nations"), ("Nation", "customers"), ("Customer", "orders")]


@query("SELECT 'nations' AS property, 'Nation:' || n_nationkey AS dst FROM nation WHERE n_regionkey = 2")
def graph_out(s):
    return graph.outgoing(graph.build(s, EDGES), "Region:2").select("property", "dst")


@query("SELECT 'Customer:' || o_custkey AS src, 'orders' AS property FROM orders WHERE o_orderkey = 77")
def graph_in(s):
    return graph.incoming(graph.build(s, EDGES), "Orders:77")


@query("""SELECT 'Nation:' || n_nationkey AS node, 1 AS depth FROM nation WHERE n_regionkey = 3
 UNION ALL SELECT 'Customer:' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 3
 UNION ALL SELECT 'Orders:' || o_orderkey, 3 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 3""")
def graph_reach(s):
    roots = s.spark.createDataFrame([("Region:3",)], "node string")
    return graph.reachable(graph.build(s, EDGES), roots)


@query("""SELECT 'Customer:' || o_custkey AS node, 1 AS depth FROM orders WHERE o_orderkey = 5 UNION ALL SELECT 'Nation:' || c_nationkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 5
 UNION ALL SELECT 'Region:' || n_regionkey, 3 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey = 5""")
def graph_path(s):
    roots = s.spark.createDataFrame([("Orders:5",)], "node string")
    return graph.reachable(graph.build(s, EDGES), roots, "in")


@query("SELECT 'Region:' || n_regionkey AS src, 'nations' AS property, 'Nation:' || CASE WHEN n_regionkey = 1 THEN n_nationkey + 200 ELSE n_nationkey END AS dst FROM nation")
def graph_remap(s):
    n, name = s.table("Nation").where("n_regionkey = 1"), lambda k: F.concat(F.lit("Nation:"), (F.col("n_nationkey") + k).cast("string"))
    ids = n.select(name(0).alias("old"), name(100).alias("new")).unionAll(n.select(name(100), name(200)))  # a chain of two steps
    return graph.remap_ids(graph.build(s, EDGES[:1]), ids).select("src", "property", "dst")


@query("SELECT 'Region:' || n_regionkey AS src, 'nations' AS property, 'Nation:' || n_nationkey AS dst, 'forward' AS only FROM nation WHERE n_regionkey = 2")
def graph_integrity(s):
    e = graph.build(s, EDGES[:1])
    back = s.table("Nation").where("n_regionkey <> 2").select(F.concat(F.lit("Nation:"), F.col("n_nationkey").cast("string")).alias("dst"), F.concat(F.lit("Region:"), F.col("n_regionkey").cast("string")).alias("src"), F.lit("nations").alias("property"))
    return graph.integrity(e, back)


# --- streaming ----------------------------------------------------------------------------------------------------


def stream_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as a file stream, coalesced and counted through foreachBatch."""
    from tessera.streaming import log as stream

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    change_log(spark, sf_dir).write.parquet(f"{folder}/log")

    def send(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/sent/batch={number}")

    stream.sync(stream.read_log(spark, f"{folder}/log"), send, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/sent").groupBy("event").agg(F.count(F.lit(1)).alias("n"))


QUERIES["stream_log_counts"] = stream_log_counts
SQL["stream_log_counts"] = f"""WITH log AS ({LOG}), l AS (SELECT * FROM log WHERE author <> 'remote'),
 c AS (SELECT coalesce(max(CASE WHEN event IN ('insert', 'delete') THEN pk END), min(pk)) AS pk FROM l GROUP BY entity_name, entity_pk)
 SELECT event, count(*) AS n FROM c JOIN l USING (pk) GROUP BY event"""


@query("SELECT 1 AS layer, 'Region' AS entity UNION ALL SELECT 1, 'Nation' UNION ALL SELECT 2, 'Label'")
def insertion_layers(s):
    found = [(k + 1, n) for k, layer in enumerate(s.catalog.insertion_order()) for n in layer if n in ("Region", "Nation", "Label")]
    return s.spark.createDataFrame(found, "layer int, entity string")


@query("""WITH r AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal, c_acctbal < 0 AS deleted FROM customer WHERE c_mktsegment <> 'BUILDING')
 SELECT c.c_custkey, c.c_name, coalesce(r.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN r ON r.c_custkey = c.c_custkey WHERE NOT coalesce(r.deleted, false)""")
def sync_merge_remote(s):
    from tessera.streaming.log import merge_remote

    r = s.table("Customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), (F.col("c_acctbal") < 0).alias("deleted"), F.lit(1).alias("version"))
    stale = r.select("c_custkey", (F.col("c_acctbal") - 500).alias("c_acctbal"), F.lit(False).alias("deleted"), F.lit(0).alias("version"))
    return merge_remote(s.table("Customer"), r.unionByName(stale), "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, c_acctbal > 0 AS applied FROM orders JOIN customer ON c_custkey = o_custkey")
def sync_parked(s):
    from tessera.streaming.log import park

    now, later = park(s.table("Orders"), "o_custkey", s.table("Customer").where("c_acctbal > 0").select("c_custkey"))
    parts = [now.select("o_orderkey", F.lit(True).alias("applied")), later.select("o_orderkey", F.lit(False).alias("applied"))]
    return reduce(DataFrame.unionAll, parts)
