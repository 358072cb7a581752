"""N-gram Jaccard join by PartEnum signatures.

Two documents link when the Jaccard similarity of their shingle sets is at least num/den. Equal sets are one class
from the start. For sets s and t that link, the sizes differ by at most den/num and the symmetric difference is at
most k(s) = floor((den - num) * |s| / num). Sets are put into bands of similar size, and a set is also put into the
next band if a set that it could link with lies there, so each such pair meets in one band. In a band:

- The feature domain is partitioned by hash into groups of N2 = 3 parts.
- Among ceil((k + 1) / 2) groups of s, one at least holds no more than K2 = 1 of the difference, so two of its three
  parts agree: s is given a signature for each 2-subset of the parts of a group, the hash of the features there.
- An empty subset would be shared by many sets, so it gets no signature: a set goes on through the groups, in a fixed
  order, until ceil((k + 1) / 2) of them have at most one empty part. Of two sets, the one that stops first is sure of
  an agreeing subset that isn't empty, and the other one has come as far. Sets that run out of groups (small ones) also
  get a signature for each of their first |s| - ceil(num * |s| / den) + 1 features in a fixed order, rare ones first:
  of two linked sets that both run out, these prefixes meet.
- The groups come in a front and a back half; features that many documents hold (from counts over all documents) fall
  in the back half, so that passages which documents share make few candidates. This order changes no result.

Candidates are sets that share a signature, the members of a bucket. A bucket whose members all share one larger bucket
(the largest that each of them is in) adds no pair and is left out.

Gathering: in each round, a set is held against one lead of its buckets that is not in its component yet, the set that
shares signatures most widely, so a group of near copies gathers around its middle. Links are merged into components,
and rounds go on while they still link a good part of what they test. Each round's work is linear in the buckets.

Then the pairs that are left are made, for sets of one bucket in different components. Members in a bucket's most
common component are only held against the others, a pair that shares some of its largest buckets is made in one of
them, and each set has a parity bitmap whose width follows the band (a bit flips for each feature that hashes there):
two bitmaps differ in no more bits than the sets in features, and the join that pairs them lets only those through that
may still link. What comes through is compared by the exact intersection, so every link between components is found,
and pairs within one are never made. All groups stay in tables of the shared folder; the driver gets counts only.

A signature that very many sets share does not meet in one task: of those that a batch of rows repeats, only the first
two go the common way (enough to know that the bucket has members), and the others are dealt out by lanes.

Nulls and edges: a null or word-free text has an empty set and links with nothing (its component is its own id); a
document of fewer than `width` words has one shingle; rows with equal ids each follow their own text; a null id stays
null, and its row still links; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import documents, prepare, shared_table, tidy
from tessera.llm.components import components
from tessera.llm.shingles import U, digest, mix, shingle_sets

NUM, DEN = 85, 100
WIDTH = 4
N2, K2 = 3, 1
BAND = 1.5
SPARE = 1.15
#: How many of the most frequent shingles are put in the back half; bounds what is broadcast (8 bytes each).
FREQUENT = 100_000
#: Up to so many ids (8 MB) are broadcast to fetch sets by id; beyond it, a shuffle join is used.
BROADCAST_IDS = 1_000_000
#: Sets that a task remembers so as not to repeat them.
SEEN = 200_000
#: Rows that a batch repeats of one signature are dealt to so many lanes.
LANES = 64
#: 64-bit words of every parity bitmap, and bits for each feature of the largest difference, which bands of large sets reach by a second, wide bitmap.
BITMAP = 16
BITS_A_DIFFERENCE = 6
#: Of a set's largest buckets, so many are compared to make a pair only once.
TOPS = 4
#: The low bits of a signature hold those of its band.
BAND_MARK = 63
#: Gathering goes on while so large a part of its tests gives links.
GATHERING = 0.1


class Scheme:
    """Signatures of sets under one threshold."""

    def __init__(self, num: int, den: int, frequent: np.ndarray):
        self.num, self.den, self.frequent = num, den, frequent
        self.edges = [-(-num // (den - num))]  # the smallest size that can link with a different set

    def k(self, n: int) -> int:
        return (self.den - self.num) * n // self.num

    def band(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * BAND)))
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def groups(self, band: int) -> int:
        """Groups in each half: what the largest set of the band needs, and some to spare."""
        return int(SPARE * (self.k(self.edges[band + 1] - 1) // (K2 + 1) + 1)) + 1

    def signatures(self, s: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The signatures by band."""
        n = len(s)
        k = self.k(n)
        if not k:
            return []
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, s), len(self.frequent) - 1)
            back = self.frequent[at] == s
            s = np.concatenate([s[~back], s[back]])
            rare = n - int(back.sum())
        else:
            rare = n
        mixed = mix(s)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed, out=sums[1:])
        return [(band, self._in_band(s, rare, sums, band, k)) for band in sorted(set(self.bands(n)))]

    def _in_band(self, s: np.ndarray, rare: int, sums: np.ndarray, band: int, k: int) -> np.ndarray:
        half = self.groups(band)
        parts = ((s >> U(32)) * U(N2 * half) >> U(32)).astype(np.int64)
        parts[rare:] += N2 * half
        counts = np.bincount(parts, minlength=2 * N2 * half)
        stops = np.cumsum(counts)
        content = (sums[stops] - sums[stops - counts]).reshape(-1, N2)
        empty = counts.reshape(-1, N2) == 0
        usable = np.cumsum(empty.sum(1) <= K2)
        need = k // (K2 + 1) + 1
        upto = int(np.searchsorted(usable, need)) + 1
        content, empty = content[:upto], empty[:upto]
        tags = (np.arange(len(content), dtype=np.uint64) + U(band << 32)) * U(N2)
        out = []
        for skipped in range(N2):
            a, b = (c for c in range(N2) if c != skipped)
            sig = mix(mix(tags + U(skipped)) + content[:, a] * U(3) + content[:, b] * U(5))
            out.append(sig[~(empty[:, a] & empty[:, b])])
        if usable[-1] < need:
            n = len(s)
            out.append(mix(s[: n + 1 + (-self.num * n // self.den)] + mix(np.array([band + (1 << 62)], np.uint64))))
        return np.concatenate(out) & ~U(BAND_MARK) | U(band & BAND_MARK)

    def words(self, band: int) -> int:
        """64-bit words of the wide bitmap of a band; 0 where the common one is wide enough."""
        bits = BITS_A_DIFFERENCE * self.k(self.edges[band + 1] - 1)
        return 0 if bits <= 64 * BITMAP else 1 << (-(-bits // 64) - 1).bit_length()

    def bands(self, n: int) -> tuple[int, int]:
        """The band of sets of n features, and the band of the largest sets that they could link with."""
        own = self.band(n)
        return own, self.band(self.den * n // self.num)


def _sets(df: DataFrame, width: int) -> DataFrame:
    """A row for each document (doc_id, text_key, n, d1, d2: digest of the set), and rows (d1: shingle, df) for shingles in several sets of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            keys = [digest(s) for s in sets]
            distinct = list({k: s for k, s in zip(keys, sets, strict=True)}.values())
            shingles, counts = np.unique(np.concatenate(distinct), return_counts=True) if distinct else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = counts >= 3
            nulls = [None] * int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column(0).to_pylist() + nulls, pa.int64()),
                    pa.array(batch.column(2).to_pylist() + nulls, pa.int64()),
                    pa.array([len(s) for s in sets] + nulls, pa.int64()),
                    pa.array(np.concatenate([np.array([k[0] for k in keys], np.int64), shingles[often].view(np.int64)])),
                    pa.array([k[1] for k in keys] + nulls, pa.int64()),
                    pa.array([None] * len(sets) + counts[often].tolist(), pa.int64()),
                ],
                ["doc_id", "text_key", "n", "d1", "d2", "df"],
            )

    return df.mapInArrow(tidy(run), "doc_id long, text_key long, n long, d1 long, d2 long, df long")


def _lanes(sigs: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """0 for the first two rows of each signature, 1 to LANES for further ones."""
    order = np.argsort(sigs, kind="stable")
    at = sigs[order]
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, int)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    out = np.zeros(len(at), np.int32)
    more = order[place >= 2]
    out[more] = 1 + (nodes[more].view(np.uint64) % U(LANES)).astype(np.int32)
    return out


def _signatures(df: DataFrame, width: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(sig, lane, node) of every set; a set that a task has already met (the last SEEN ones) is not repeated."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, seen = Scheme(num, den, shared.value), set()
        for batch in batches:
            sigs, nodes, reps = [], [], []
            if len(seen) >= SEEN:
                seen.clear()
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                node = digest(s)[0]
                if len(s) < scheme.edges[0] or node in seen:
                    continue
                seen.add(node)
                for _, own in scheme.signatures(s):
                    sigs.append(own)
                    nodes.append(node)
                    reps.append(len(own))
            if sigs:
                sig, node = np.concatenate(sigs).view(np.int64), np.repeat(np.array(nodes, np.int64), reps)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (sig, _lanes(sig, node), node)], ["sig", "lane", "node"])

    return df.mapInArrow(tidy(run), "sig long, lane int, node long")


def _bitmap(s: np.ndarray, words: int) -> np.ndarray:
    """Parity, by bit, of how many features hash there."""
    bits = np.bincount((s & U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


BITS = [f"bits{k}" for k in range(BITMAP)]


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has no more than BROADCAST_IDS rows of a few numbers."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _fetch(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, n, features, bits0, bits1, ..., own, wide_own, wide_next) of every set of nodes; the wide bitmaps are those of its own band and of the next one that it is in. Rows without an id, or with a repeated one, can bring other sets too."""
    ids = shared_table(classes.join(_small(nodes.select(F.col("node").alias("d1"))), "d1").select("doc_id").distinct(), "candidates")
    texts = docs.join(_small(ids), docs["id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, met = Scheme(num, den, np.zeros(0, np.uint64)), set()
        for batch in batches:
            if len(met) >= SEEN:
                met.clear()
            own = {}
            for s in shingle_sets(batch.column(0).to_pylist(), width):
                if len(s) >= scheme.edges[0] and (node := digest(s)[0]) not in met:
                    met.add(node)
                    own[node] = s
            maps = np.array([_bitmap(s, BITMAP) for s in own.values()], np.int64).reshape(-1, BITMAP)
            bands = [scheme.bands(len(s)) for s in own.values()]
            wide = [[_bitmap(s, w) if (w := scheme.words(b[k])) else None for s, b in zip(own.values(), bands, strict=True)] for k in range(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(own), pa.int64()), pa.array([len(s) for s in own.values()], pa.int32()), pa.array([s.tobytes() for s in own.values()], pa.binary()), *map(pa.array, maps.T), pa.array([b[0] for b in bands], pa.int32()), *(pa.array(w, pa.list_(pa.int64())) for w in wide)],
                ["node", "n", "features", *BITS, "own", "wide_own", "wide_next"],
            )

    return shared_table(texts.mapInArrow(tidy(run), f"node long, n int, features binary, {', '.join(f'{b} long' for b in BITS)}, own int, wide_own array<long>, wide_next array<long>"), "features")


def _apart(a: str, b: str):
    """Bits in which two bitmaps differ; each of their columns is named with the side's suffix."""
    return sum((F.bit_count(F.col(f"{c}{a}").bitwiseXOR(F.col(f"{c}{b}"))) for c in BITS[1:]), F.bit_count(F.col(f"{BITS[0]}{a}").bitwiseXOR(F.col(f"{BITS[0]}{b}"))))


def _likely(pairs: DataFrame, features: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may link by size and bitmap, so that whole sets are only sent for those."""
    a, b = (features.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in BITS)) for x in "ab")
    pairs = _small(pairs)
    both = b.join(pairs, "b").join(a.join(pairs.select("a").distinct(), "a", "left_semi"), "a")
    may = ((den + num) * _apart("_a", "_b") <= (den - num) * (F.col("n_a") + F.col("n_b"))) & (den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    return shared_table(both.where(may).select("a", "b"), "likely")


def _linked(pairs: DataFrame, features: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) that link, by exact intersection; a is the side that fewer sets are on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    pairs = _small(pairs)
    left = features.select(F.col("node").alias("a"), F.col("features").alias("fa")).join(pairs.select("a").distinct(), "a", "left_semi")
    right = features.select(F.col("node").alias("b"), F.col("features").alias("fb")).join(pairs, "b")
    return right.join(left, "a").select("a", "b", "fa", "fb").mapInArrow(tidy(run), "u long, v long")


def _buckets(docs: DataFrame, width: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(sig, node, c) of every signature that several sets share; c: rows of the signature, or those of a lane of it."""
    lane = W.partitionBy("sig", "lane")
    met = _signatures(docs, width, num, den, frequent).withColumns({"lo": F.min("node").over(lane), "hi": F.max("node").over(lane), "c": F.count(F.lit(1)).over(lane)})
    shared = met.where("lane > 0 or lo <> hi").dropDuplicates(["sig", "lane", "node"])
    return shared_table(shared.select("sig", "node", F.col("c").cast("int").alias("c")), "buckets")


def _live(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Buckets without those whose members all have one other bucket as their largest, and with the lead of each: (sig, node, lead: deg and node)."""
    own = buckets.select("sig", "node").join(_small(nodes), "node")
    kept = own.groupBy("sig").agg(F.min("top").alias("lo"), F.max("top").alias("hi"), F.max(F.struct("deg", "node")).alias("lead")).where("lo <> hi or lo = sig")
    return shared_table(buckets.select("sig", "node").join(kept.select("sig", "lead"), "sig"), "live")


def _placed(live: DataFrame, comps: DataFrame | None) -> DataFrame:
    """live with the component of the set and of the lead; a set without links is its own."""
    if comps is None:
        return live.withColumns({"comp": F.col("node"), "lead_comp": F.col("lead.node")})
    lead = comps.select(F.col("node").alias("_lead"), F.col("comp").alias("_comp"))
    placed = live.join(comps, "node", "left").join(lead, F.col("lead.node") == F.col("_lead"), "left")
    return placed.withColumns({"comp": F.coalesce("comp", "node"), "lead_comp": F.coalesce("_comp", "lead.node")}).drop("_lead", "_comp")


def _rest(live: DataFrame, comps: DataFrame, features: DataFrame, done: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that may still link and have not been held against each other."""
    placed = _placed(live, comps).select("sig", "node", "comp")
    parts = placed.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("c"))
    several = parts.groupBy("sig").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("c").alias("c")).where("lo <> hi")
    spread = shared_table(placed.join(several.select("sig", "main", "c"), "sig").withColumn("apart", F.col("comp") != F.col("main")), "spread")
    largest = F.slice(F.sort_array(F.collect_list(F.struct("c", "sig")), asc=False), 1, TOPS)
    tops = spread.groupBy("node").agg(largest.alias("tops")).select("node", F.col("tops.sig").alias("tops"))
    wide = F.when(F.col("sig").bitwiseAND(F.lit(BAND_MARK)) == F.col("own").bitwiseAND(F.lit(BAND_MARK)), F.col("wide_own")).otherwise(F.col("wide_next")).alias("wide")
    mapped = spread.join(tops, "node").join(features, "node").select("sig", "node", "n", "comp", "apart", "tops", wide, *BITS)
    l, r = (mapped.select("sig", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "comp", "apart", "tops", "wide", *BITS))) for x in "lr")
    wide_bits = F.aggregate(F.zip_with("wide_l", "wide_r", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    allowed = (den - num) * (F.col("n_l") + F.col("n_r"))
    common = F.array_intersect("tops_l", "tops_r")
    may = (
        (F.col("comp_l") != F.col("comp_r"))
        & (~F.col("apart_r") | (F.col("node_l") < F.col("node_r")))
        & (den * F.least("n_l", "n_r") >= num * F.greatest("n_l", "n_r"))
        & ((den + num) * _apart("_l", "_r") <= allowed)
        & ((F.size(common) == 0) | (F.array_min(common) == l["sig"]))
        & (F.col("wide_l").isNull() | ((den + num) * wide_bits <= allowed))
    )
    pairs = l.where("apart_l").join(r, (l["sig"] == r["sig"]) & may).select(F.least("node_l", "node_r").alias("a"), F.greatest("node_l", "node_r").alias("b")).distinct()
    tested = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return shared_table(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")


def grouped(df: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n, d1, d2) of every document, and (d1, d2, n, doc_id: the smallest, comp) of every class of equal sets that aren't empty."""
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = shared_table(_sets(docs.withColumn("text_key", F.xxhash64("text")), width), "sets")
    rows = sets.where("n is not null").drop("df")
    classes = shared_table(rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc_id")), "classes")
    common = sets.where("n is null").groupBy("d1").agg(F.sum("df").alias("df")).where("df >= 16").orderBy(F.desc("df"), "d1").limit(FREQUENT)
    frequent = np.sort(np.array([r["d1"] for r in common.select("d1").collect()], np.int64).view(np.uint64))

    buckets = _buckets(docs, width, num, den, frequent)
    nodes = shared_table(buckets.groupBy("node").agg(F.count(F.lit(1)).alias("deg"), F.max(F.struct("c", "sig"))["sig"].alias("top")), "nodes")
    live = _live(buckets, nodes)
    features = _fetch(docs, classes, nodes, width, num, den)

    links = done = comps = None
    while True:
        open_ = _placed(live, comps).where("comp <> lead_comp").select("lead", F.col("node").alias("b")).distinct()
        if done is not None:
            open_ = open_.join(done.select(F.struct("deg", F.col("a").alias("node")).alias("lead"), "b"), ["lead", "b"], "left_anti")
        tests = shared_table(open_.groupBy("b").agg(F.max("lead").alias("lead")).select("lead.deg", F.col("lead.node").alias("a"), "b"), "tests")
        found = shared_table(_linked(_likely(tests.select("a", "b"), features, num, den), features, num, den), "linked")
        done = tests if done is None else done.unionAll(tests)
        links = found if links is None else links.unionAll(found)
        comps = components(links)
        if found.count() <= GATHERING * tests.count():
            break
    rest = _rest(live, comps, features, done, num, den)
    if not rest.isEmpty():
        comps = components(links.unionAll(_linked(rest, features, num, den)))
    return rows, classes.join(comps, classes["d1"] == comps["node"], "left").select("d1", "d2", "n", "doc_id", F.coalesce("comp", "d1").alias("comp"))


def join(df: DataFrame, num: int = NUM, den: int = DEN, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, named = grouped(df, num, den, width, id_col, text_col)
    named = shared_table(named, "named")
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = named.join(least, "comp").select("d1", "d2", "component_id")
    return rows.join(found, ["d1", "d2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_copies(df: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """df with one row of each component: the one with the smallest id (a null id comes last), then the smallest hash of the text; rows that repeat id and text count once. Rows without words all stay."""
    rows, named = grouped(df, num, den, width)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    placed = shared_table(rows.where("n > 0").groupBy("doc_id", "text_key", "d1", "d2").agg(F.count(F.lit(1)).alias("times")).join(named.select("d1", "d2", "comp"), ["d1", "d2"]).select("comp", "times", key.alias("key")), "placed")
    head = placed.groupBy("comp").agg(F.min("key").alias("head"))
    gone = _small(shared_table(placed.join(head, "comp").where("key <> head").select("key.doc_id", "key.text_key"), "gone"))
    twice = placed.where("times > 1").select("key.doc_id", "key.text_key")

    def same(table: DataFrame):
        return keyed["doc_id"].cast("long").eqNullSafe(table["doc_id"]) & (keyed["_text_key"] == table["text_key"])

    keyed = df.withColumn("_text_key", F.xxhash64("text"))
    kept = keyed.join(gone, same(gone), "left_anti")
    keyed = kept
    if not twice.isEmpty():
        kept = keyed.join(twice, same(twice), "left_anti").unionAll(keyed.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "_text_key"]))
    return kept.drop("_text_key")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
