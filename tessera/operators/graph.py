"""The reference graph as an edge table (src, property, dst, ord) with distributed traversal. ord rises along an owner's targets and can have gaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.relations import links
from tessera.sources.shared import settled
from tessera.store import Store

#: So many tables of found levels are merged into one, so that a long path is no long union.
MERGED = 8


def node(entity: str, key) -> str:
    return f"{entity}:{key}"


def build(store: Store, relationships: list[tuple[str, str]]) -> DataFrame:
    """Edges of (entity, relationship) pairs, with nodes as `Entity:key`. Targets are in the order of their keys; whole-number keys are the order themselves, so that an owner of any number of targets needs no window."""
    parts = []
    for entity, name in relationships:
        target = store.catalog.relationship(entity, name).target
        found = links(store, entity, name)
        src, dst = F.concat(F.lit(f"{entity}:"), F.col("owner").cast("string")), F.concat(F.lit(f"{target}:"), F.col("related").cast("string"))
        place = F.col("related") if isinstance(found.schema["related"].dataType, T.IntegralType) else F.row_number().over(W.partitionBy("owner").orderBy("related"))
        parts.append(found.select(src.alias("src"), F.lit(name).alias("property"), dst.alias("dst"), place.cast("long").alias("ord")))
    return reduce(DataFrame.unionAll, parts)


def outgoing(edges: DataFrame, owner: str, prop: str | None = None) -> DataFrame:
    """Targets in order of (property, place)."""
    df = edges.where(F.col("src") == owner)
    df = df.where(F.col("property") == prop) if prop else df
    return df.select("property", "dst", "ord").orderBy("property", "ord", "dst")


def incoming(edges: DataFrame, target: str) -> DataFrame:
    return edges.where(F.col("dst") == target).select("src", "property").distinct()


def edges_between(edges: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(src, property, dst) of the edges from a node, to a node, or both; all without either."""
    df = edges if start is None else edges.where(F.col("src") == start)
    df = df if end is None else df.where(F.col("dst") == end)
    return df.select("src", "property", "dst")


def set_targets(edges: DataFrame, owner: str, prop: str, targets: list[str]) -> DataFrame:
    """Replaces an owner's targets; an empty list is known to be empty, which is the same as none here."""
    kept = edges.where(~((F.col("src") == owner) & (F.col("property") == prop)))
    rows = [(owner, prop, t, k + 1) for k, t in enumerate(dict.fromkeys(targets))]
    return kept.unionByName(edges.sparkSession.createDataFrame(rows, edges.schema)) if rows else kept


def remove_all(edges: DataFrame, owner: str) -> DataFrame:
    return edges.where(F.col("src") != owner)


def remove_incoming(edges: DataFrame, target: str) -> DataFrame:
    return edges.where(F.col("dst") != target)


def clear_missing(edges: DataFrame, owner: str, keep: list[str]) -> DataFrame:
    """Drops an owner's properties that aren't listed."""
    return edges.where((F.col("src") != owner) | F.col("property").isin(keep))


def canonical_remap(remap: DataFrame) -> DataFrame:
    """(old, new) with chains of any length followed to their ends; each round doubles the steps and is cut off from its lineage.

    An id that is replaced by two others, or by itself over other ids, is an error; one that stands for itself is no replacement."""
    at = settled(remap.select("old", "new").where("old <> new").distinct(), "remap")
    if not at.groupBy("old").count().where("count > 1").isEmpty():
        raise ValueError("an id is replaced by more than one other")
    rounds = at.count().bit_length() + 1  # the longest chain has as many steps as there are rows
    for _ in range(rounds):
        hop = at.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
        if at.join(hop, F.col("new") == F.col("_o"), "left_semi").isEmpty():
            return at
        at = settled(at.join(hop, F.col("new") == F.col("_o"), "left").select("old", F.coalesce("_n", "new").alias("new")), "remap")
        if not at.where("old = new").isEmpty():
            break
    raise ValueError("replaced ids form a cycle")


def remap_ids(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges with ids replaced at both ends; targets that fall together keep the first place."""
    m = canonical_remap(remap)
    s, d = m.toDF("_s", "_sn"), m.toDF("_d", "_dn")
    moved = (
        edges.join(s, F.col("src") == F.col("_s"), "left")
        .join(d, F.col("dst") == F.col("_d"), "left")
        .select(F.coalesce("_sn", "src").alias("src"), "property", F.coalesce("_dn", "dst").alias("dst"), "ord")
    )
    return moved.groupBy("src", "property", "dst").agg(F.min("ord").alias("ord"))


def reachable(edges: DataFrame, roots: DataFrame, direction: str = "out", max_depth: int | None = None, include_roots: bool = False, where=None) -> DataFrame:
    """(node, depth) of what the roots reach, breadth first: each level is one join and an anti join with what is known.

    direction: out, in or both; `where` filters edges; max_depth None follows edges to the end. Without include_roots a
    root appears only if a cycle leads back to it. Levels are tables of the shared folder."""
    e = edges.where(where) if where is not None else edges
    step = {"out": e.select("src", "dst"), "in": e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}
    step["both"] = step["out"].unionAll(step["in"])
    step = step[direction]
    level = roots.toDF("node").distinct()
    parts = [level.withColumn("depth", F.lit(0))] if include_roots else []
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = level.join(step, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        if parts:
            level = level.join(reduce(DataFrame.unionAll, parts), "node", "left_anti")
        level = settled(level, "level")
        if level.isEmpty():
            break
        parts.append(level.withColumn("depth", F.lit(depth)))
        if len(parts) > MERGED:
            parts = [settled(reduce(DataFrame.unionAll, parts), "levels")]
    return reduce(DataFrame.unionAll, parts) if parts else level.withColumn("depth", F.lit(0)).limit(0)


def has_path(edges: DataFrame, start: str, end: str, max_depth: int | None = None) -> bool:
    if start == end:
        return True
    roots = edges.sparkSession.createDataFrame([(start,)], "node string")
    return not reachable(edges, roots, max_depth=max_depth).where(F.col("node") == end).isEmpty()


def cached_references(edges: DataFrame, owners: DataFrame, prop: str) -> DataFrame:
    """(owner, targets): what is known for a property; null targets are misses."""
    known = edges.where(F.col("property") == prop).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("t"))
    return owners.toDF("owner").join(known, F.col("owner") == F.col("src"), "left").select("owner", F.col("t.dst").alias("targets"))


def integrity(edges: DataFrame, reverse: DataFrame) -> DataFrame:
    """Edges that the forward table (src, property, dst) and the reverse table (dst, src, property) don't both have."""
    f = edges.select("src", "property", "dst").withColumn("_f", F.lit(True))
    r = reverse.select("src", "property", "dst").withColumn("_r", F.lit(True))
    both = f.join(r, ["src", "property", "dst"], "full_outer")
    return both.where("_f is null or _r is null").select("src", "property", "dst", F.when(F.col("_f").isNull(), "reverse").otherwise("forward").alias("only"))
