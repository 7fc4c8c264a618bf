"""SimHash near-dedup with a Gray-order hierarchical index.

Equal fingerprints count once. Two that differ in at most ``bits`` of 64 agree
in ``blocks - bits`` of ``blocks`` bit blocks, so distinct fingerprints are dealt
by every choice of so many blocks, and a group is searched by its own index:
fingerprints sorted by Gray rank, runs of neighbours joined to nodes that hold
the bits all their members share, level upon level. A search goes down from the
top, adds the differences in the bits that each node shares beyond its parent,
and drops a whole node once their sum exceeds the limit.

A group of over ``most`` members is cut, in Gray order, into blocks; pairs of blocks
are searched as tasks of their own. Groups report links to the smallest member
of each set that they join, never all pairs. Sets are closed over all groups by
rounds of minimum labels with pointer jumping, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FAN = 8


def fingerprint(text: bytes, n: int = 4) -> int:
    """The SimHash of a text's n-word shingles, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    count = max(1, len(words) - n + 1)
    starts = [0, *ends[: count - 1]]
    stops = [e - 1 for e in ends[n - 1 :]] or [len(line)]
    h = np.fromiter((xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, count)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 8192):
        part = h[lo : lo + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """levels[0] is the top; node i of a level has the children FAN*i to FAN*i+FAN-1 of the next."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        value, shared = fps[self.order], np.full(len(fps), ~np.uint64(0))
        levels = [(value, shared)]
        while len(value) > FAN:
            cut = np.arange(0, len(value), FAN)
            both, any_ = np.bitwise_and.reduceat(value, cut), np.bitwise_or.reduceat(value, cut)
            shared = np.bitwise_and.reduceat(shared, cut) & ~(both ^ any_)
            value = both & shared
            levels.append((value, shared))
        levels.reverse()
        self.levels = []
        for k, (v, s) in enumerate(levels):  # each node keeps only what its parent doesn't share
            above = np.uint64(0) if k == 0 else levels[k - 1][1][np.arange(len(v)) // FAN]
            self.levels.append((v, s & ~above))

    def search(self, queries: np.ndarray, limit: int, chunk: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in queries, place in fps) at most limit bits apart, in parts."""
        for lo in range(0, len(queries), chunk):
            part = queries[lo : lo + chunk]
            q, node = np.repeat(np.arange(len(part)), len(self.levels[0][0])), np.tile(np.arange(len(self.levels[0][0])), len(part))
            far = np.zeros(len(q), np.uint8)
            for k, (value, own) in enumerate(self.levels):
                if k:
                    q, far = np.repeat(q, FAN), np.repeat(far, FAN)
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    real = node < len(value)
                    q, node, far = q[real], node[real], far[real]
                far = far + np.bitwise_count((part[q] ^ value[node]) & own[node])
                near = far <= limit
                q, node, far = q[near], node[near], far[near]
            yield q + lo, self.order[node]


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that the pairs join it to."""
    label = np.arange(n)
    while True:
        new = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def group_links(fps: np.ndarray, side: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links of one group; members of side 0 and 1 are searched across, those of side 2 among themselves."""
    order = np.argsort(fps, kind="stable")
    fps, side = fps[order], side[order]
    u = fps.view(np.uint64)
    a = b = np.arange(len(fps))
    if side[0] != 2 or (side != 2).any():
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(a) or not len(b):
        return []
    label = np.arange(len(fps))
    for x, y in GrayIndex(u[b]).search(u[a], limit):  # parts are joined as they come, so pairs don't pile up
        i, j = a[x], b[y]
        apart = i != j
        if apart.any():
            label = roots(len(fps), np.concatenate([i[apart], np.arange(len(fps))]), np.concatenate([j[apart], label]))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return list(zip(fps[label[moved]].tolist(), fps[moved].tolist(), strict=True))


def _links(limit: int):
    """Over rows (t, key, x, y, fp, side) sorted by group: the links of each group."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()

        def flush():
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow)

        held, last = [], None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            keys = np.stack(cols[:4])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                key = tuple(keys[:, lo])
                if key != last and held:
                    found.update(close(held))
                    held = []
                last = key
                held.append((cols[4][lo:hi], cols[5][lo:hi]))
            if len(found) > 50_000:
                yield flush()
                found = set()
        if held:
            found.update(close(held))
        if found:
            yield flush()

    def close(held):
        if len(held) == 1 and len(held[0][0]) == 1:
            return []
        return group_links(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), limit)

    return run


def masks(bits: int, blocks: int) -> list[int]:
    """The bits of every choice of blocks - bits blocks, as signed 64-bit integers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    out = [sum(one[i] for i in chosen) for chosen in combinations(range(blocks), blocks - bits)]
    return [x - 2**64 if x >= 2**63 else x for x in out]


def similar(prints: DataFrame, count: int, bits: int = 4, most: int = 2048) -> DataFrame:
    """Links (a < b) that join just those distinct fingerprints (column fp) that chains of near ones join.

    blocks is chosen by count so that a group of evenly spread fingerprints
    has some hundreds of members at most; the links join the same sets for any
    choice. Each group of two or more is searched by its own Gray index.
    """
    spark = prints.sparkSession
    blocks = bits + 1
    while blocks < bits + 4 and count > 512 * 2 ** (64 * (blocks - bits) // blocks):
        blocks += 1
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(bits, blocks))])
    dealt = prints.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = common.written(sizes.select("t", "key", F.ceil(F.col("n") / most).cast("int").alias("parts")), "groups")
    dealt = dealt.join(sizes, ["t", "key"])
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pair = lambda p: F.struct(F.least(mine, p).alias("x"), F.greatest(mine, p).alias("y"), F.when(p == mine, 2).when(p > mine, 0).otherwise(1).cast("int").alias("side"))
    tasks = dealt.select("t", "key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair)).alias("p")).select("t", "key", "p.x", "p.y", "fp", "p.side")
    tasks = tasks.repartition(common.shuffle_width(spark), "t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y")
    return tasks.mapInArrow(_links(bits), "a long, b long")


def closed(links: DataFrame) -> DataFrame:
    """(node, root): for each linked node the smallest node that links join it to."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    both = common.written(both, "links")
    label = common.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")), "labels")
    while True:
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        new = label.join(seen, "node").select("node", "root", F.least("root", "low").alias("low"))
        up = new.select(F.col("node").alias("low"), F.col("low").alias("upper"))
        new = new.join(up, "low").select("node", F.col("upper").alias("new"), (F.col("upper") != F.col("root")).cast("long").alias("moved"))
        new, old = common.written(new, "labels"), label
        label = new.select("node", F.col("new").alias("root"))
        label._folder = new._folder
        common.discard(old)
        if not new.agg(F.sum("moved")).first()[0]:
            return label


def _prints(n: int):
    def rows(given):
        for doc_id, did, text_hash, text in given:
            yield doc_id, did, text_hash, fingerprint(text, n)

    return rows


def text_hash():
    """Tells texts of one doc_id apart; null and empty texts are one."""
    return F.xxhash64(common.utf8())


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, most: int = 2048) -> DataFrame:
    """Returns doc_id, fp (signed) and component_id, a row for each row of docs.

    A text of fewer words is one shingle; one without words, null or empty has
    the fingerprint zero and is linked like any other. component_id is the
    smallest doc_id that links reach, the row's own included; null ids come
    last, and a set of nulls only has a null component_id. Rows that repeat stay. Other columns
    are ignored. An empty table gives an empty result.
    """
    return grouped(docs, words, bits, most).select("doc_id", "fp", "component_id")


def grouped(docs: DataFrame, words: int = 4, bits: int = 4, most: int = 2048) -> DataFrame:
    """near_duplicates with text_hash and set, a number for each set of linked rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.id_key().alias("did"), text_hash().alias("text_hash"), common.utf8().alias("text"))
    prints = common.written(common.arrow_pass(texts, _prints(words), "doc_id long, did long, text_hash long, fp long"), "prints")
    distinct = common.written(prints.groupBy("fp").agg(F.min("did").alias("least")), "distinct-prints")
    label = closed(similar(distinct.select("fp"), distinct.count(), bits, most)).withColumnRenamed("node", "fp")
    rooted = distinct.join(label, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = common.written(rooted, "rooted")
    least = common.written(rooted.groupBy("root").agg(F.min("least").alias("component")), "components")
    of = common.written(rooted.join(least, "root").select("fp", "root", "component"), "component-of")
    component = F.when(F.col("component") != common.NULL_ID, F.col("component"))
    return prints.join(of, "fp").select("doc_id", "text_hash", "fp", component.alias("component_id"), F.col("root").alias("set"))


def one_of_each(docs: DataFrame, words: int = 4, bits: int = 4) -> DataFrame:
    """One row of docs, with all its columns, for each set: one whose doc_id is the set's smallest.

    Rows are judged each by its own text, so rows that share an id, or have
    none, stay if their texts are in different sets. docs meets only the rows
    that don't stay as they are, which are few next to those that do.
    """
    return leading(docs, grouped(docs, words, bits))


def leading(docs: DataFrame, found: DataFrame) -> DataFrame:
    """one_of_each for sets given by found (doc_id, text_hash, component_id, set), a row for each row of docs.

    Only the rows with a set's smallest doc_id, mostly one a set, meet their set; the others go as they
    are, so a set of any size stays spread over all tasks.
    """
    alike = found.groupBy("set", "doc_id", "text_hash", "component_id").agg(F.count("*").alias("n"))
    alike = common.written(alike, "alike")
    leads = F.when(F.col("doc_id") != common.NULL_ID, F.col("doc_id")).eqNullSafe(F.col("component_id"))
    first = alike.where(leads).groupBy("set").agg(F.min(F.struct("text_hash", "doc_id")).alias("first")).select("set", "first.text_hash", "first")
    stays = F.col("first").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    heads = alike.where(leads).join(first, ["set", "text_hash"], "left").select("doc_id", "text_hash", stays.alias("stays"), "n")
    judged = heads.unionByName(alike.where(~leads).select("doc_id", "text_hash", F.lit(False).alias("stays"), "n"))
    other = common.written(judged.where("not stays or n > 1"), "not-alone")
    mine = [common.free_name(docs, x) for x in ("_id", "_hash")]
    ids, hashes = (common.free_name(docs, x) for x in ("_of", "_with"))
    keyed = docs.withColumn(mine[0], F.col("doc_id").cast("long")).withColumn(mine[1], text_hash())
    same = F.col(mine[0]).eqNullSafe(F.col(ids)) & (F.col(mine[1]) == F.col(hashes))
    named = lambda df: df.select("doc_id", "text_hash").toDF(ids, hashes)
    kept, again = keyed.join(named(other), same, "left_anti").drop(*mine), other.where("stays")
    if again.isEmpty():
        return kept
    return kept.union(keyed.join(named(again), same, "left_semi").dropDuplicates(mine).drop(*mine))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
