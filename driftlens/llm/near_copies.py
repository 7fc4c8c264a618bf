"""Documents whose word shingles overlap, by SimHash and MinHash candidates and exact verification.

Each text becomes the set of its distinct shingles' hashes. Sets whose SimHash fingerprints
differ in at most four bits are linked by the Gray index of ``simhash``, and its links are candidates.
At lower similarities fingerprints lie further apart than it can search, so MinHash adds
candidates beside it: sets that agree in all
values of one of ``BANDS`` bands of ``ROWS`` MinHash values are candidates: at a Jaccard
similarity of 0.8 a pair misses every band with a probability of 3 in a million, above it
with less. What is linked is decided by the sets themselves.

Groups of candidates are first verified against their smallest member, and the links are
closed. Groups whose members are still in different sets are then searched (large ones in pairs
of blocks): members of different sets that agree in enough MinHash values are verified, and
sets that a link joins aren't compared again. Tasks report links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import closed, majority, similar, text_hash

BANDS, ROWS = 24, 4
_R = np.random.default_rng(17)
_A = _R.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes, n: int, memo: dict[bytes, int]) -> np.ndarray:
    """The distinct hashes of a text's n-word shingles, sorted; a shorter text is one shingle, one without words is zero."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    return np.unique(common.shingle_hashes(common.word_hashes(words, memo), min(n, len(words))))


def signature(h: np.ndarray) -> np.ndarray:
    """The upper halves of the set's MinHash values."""
    least = np.full(len(_A), ~np.uint64(0))
    for lo in range(0, len(h), 4096):
        np.minimum(least, (h[lo : lo + 4096, None] * _A + _B).min(0), out=least)
    return (common.mix(least) >> np.uint64(32)).astype(np.uint32)


def _set_id(h: np.ndarray) -> int:
    return int(common.mix(np.array([np.bitwise_xor.reduce(common.mix(h)) + np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def _sets(n: int):
    """Rows (doc_id, did, text_hash, text) to SETS; a key belongs to its band, whose number is mixed in."""
    band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def rows(given):
        memo: dict[bytes, int] = {}
        for *ids, text in given:
            h = shingles(text, n, memo)
            keys = common.mix(common.shingle_hashes(signature(h).astype(np.uint64), ROWS)[::ROWS] + band)
            yield *ids, _set_id(h), len(h), majority(h), keys.view(np.int64).tolist()

    return rows


SETS = "doc_id long, did long, text_hash long, sid long, n int, fp long, keys array<long>"


def _shingled(n: int):
    """Rows (sid, text): the set of each text that has this id, and its signature."""

    def rows(given):
        memo: dict[bytes, int] = {}
        for sid, text in given:
            h = shingles(text, n, memo)
            if _set_id(h) == sid:
                yield sid, signature(h).tobytes(), h.tobytes()

    return rows


def _verified(similarity: float):
    def rows(given):
        for a, b, x, y in given:
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if _similar(p, q, similarity):
                yield a, b

    return rows


def _similar(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= similarity * (len(p) + len(q) - both) - 1e-9


def _across(least: int, similarity: float):
    """Over rows (key, x, y, sid, root, side, sig, h) sorted by group: links between different sets, of members that agree in least MinHash values."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def close(held):
        sid, root, side = (np.concatenate([h[k] for h in held]) for k in range(3))
        sig = np.frombuffer(b"".join(s for h in held for s in h[3]), np.uint32).reshape(len(sid), -1)
        sets = [np.frombuffer(x, np.uint64) for h in held for x in h[4]]
        right, links = side != 0, []
        for i in np.flatnonzero(side != 1):
            other = np.flatnonzero(right & (root != root[i]) & ((side != 2) | (sid > sid[i])))
            for k in other[(sig[other] == sig[i]).sum(1) >= least]:
                if root[k] != root[i] and _similar(sets[i], sets[k], similarity):
                    links.append((sid[i], sid[k]))
                    root[root == root[k]] = root[i]
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:6]]
            keys = np.stack([c.astype(np.int64) for c in cols[:3]])
            sigs, sets = b.column(6).to_pylist(), b.column(7).to_pylist()
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                key = tuple(keys[:, lo])
                if key != last and held:
                    yield from close(held)
                    held = []
                last = key
                held.append((cols[3][lo:hi], cols[4][lo:hi], cols[5][lo:hi], sigs[lo:hi], sets[lo:hi]))
        if held:
            yield from close(held)
        held.clear()
        common.release()

    return run


def _verify(pairs: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of set ids whose sets, given by of (sid, h), are similar."""
    met = pairs.join(of.select(F.col("sid").alias("b"), F.col("h").alias("y")), "b").join(of.select(F.col("sid").alias("a"), F.col("h").alias("x")), "a")
    return common.written(common.arrow_pass(met.select("a", "b", "x", "y"), _verified(similarity), "a long, b long"), "verified")


def indexed(sets: DataFrame, bits: int = 4) -> DataFrame:
    """Candidates (a, b): sets (sid, fp) of equal fingerprints with the smallest of them, and the links of the Gray index between these."""
    prints = common.written(sets.groupBy("fp").agg(F.min("sid").alias("sid"), F.max("sid").alias("last")), "prints")
    equal = sets.join(prints.where("sid < last").select("fp", F.col("sid").alias("a")), "fp").where("sid <> a").select("a", F.col("sid").alias("b"))
    links = common.written(similar(prints.select("fp"), prints.count(), bits).toDF("x", "y").distinct(), "print-links")
    end = lambda p, name: prints.select(F.col("fp").alias(p), F.col("sid").alias(name))
    return common.written(equal.union(links.join(end("x", "a"), "x").join(end("y", "b"), "y").select("a", "b")).distinct(), "indexed")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, most: int = 512) -> DataFrame:
    """Returns doc_id and component_id, a row for each row of docs: sets are joined by chains of similar texts.

    component_id is the smallest doc_id of the set; null ids come last, and a set of nulls only has
    a null component_id. Texts without words are copies of each other. Needs similarity >= 0.8: candidates
    are made for that.
    """
    return grouped(docs, words, similarity, most).select("doc_id", "component_id")


def grouped(docs: DataFrame, words: int = 5, similarity: float = 0.8, most: int = 512) -> DataFrame:
    """near_copies with text_hash and set, a number for each set of linked rows.

    Shingles are hashed for all texts, but kept for candidates only, whose texts are read again.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.id_key().alias("did"), text_hash().alias("text_hash"), common.utf8().alias("text"))
    sets = common.written(common.arrow_pass(texts, _sets(words), SETS, 256), "shingle-sets")
    one = sets.select("sid", "n", "keys").dropDuplicates(["sid"])  # exact copies count once
    dealt = common.written(one.select("sid", "n", F.explode("keys").alias("key")), "dealt")
    heads = dealt.groupBy("key").agg(F.min(F.struct("sid", "n")).alias("head"), F.max("sid").alias("last")).where("head.sid < last")
    heads = common.written(heads.select("key", "head"), "heads")
    members = common.written(dealt.join(heads, "key"), "members")
    common.discard(dealt, heads)
    # one row stands for exact copies before sets meet the members, so they don't gather in a task
    near = indexed(sets.select("sid", "fp").distinct())
    candidates = members.select("sid").union(near.select("a")).union(near.select("b")).distinct()
    live = sets.groupBy("sid").agg(F.min(F.struct("did", "text_hash")).alias("of")).join(candidates, "sid", "left_semi")
    live = common.written(live.select("sid", "of.did", "of.text_hash"), "live-sets")
    read = texts.select("did", "text_hash", "text").join(live, ["did", "text_hash"]).select("sid", "text")
    shingled = common.arrow_pass(read, _shingled(words), "sid long, sig binary, h binary", 256)
    shingled = common.written(shingled.dropDuplicates(["sid"]), "live-shingles")  # rows that repeat
    alike = F.least("n", "head.n") >= similarity * F.greatest("n", "head.n") - 1e-9
    pairs = members.where((F.col("sid") != F.col("head.sid")) & alike).select(F.col("head.sid").alias("a"), F.col("sid").alias("b")).union(near).distinct()
    links = _verify(common.written(pairs, "pairs"), shingled.select("sid", "h"), similarity)
    label = closed(links).withColumnRenamed("node", "sid")

    rooted = common.written(members.join(label, "sid", "left").select("key", "sid", F.coalesce("root", "sid").alias("root")), "rooted")
    common.discard(members)
    mixed = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    mixed = common.written(mixed.select("key", F.ceil(F.col("n") / most).cast("int").alias("parts")), "mixed")
    left = rooted.join(mixed, "key")
    mine = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    pair = lambda p: F.struct(F.least(mine, p).alias("x"), F.greatest(mine, p).alias("y"), F.when(p == mine, 2).when(p > mine, 0).otherwise(1).cast("int").alias("side"))
    tasks = left.join(shingled, "sid").select("key", "sid", "root", "sig", "h", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair)).alias("p"))
    tasks = tasks.select("key", "p.x", "p.y", "sid", "root", "p.side", "sig", "h").repartition(common.shuffle_width(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y")
    # at a similarity of s, so few values agree with a probability of some 1e-7 or less
    values = BANDS * ROWS
    least = int(values * similarity - 5.5 * (values * similarity * (1 - similarity)) ** 0.5)
    links = links.union(common.written(common.small_batches(tasks).mapInArrow(_across(least, similarity), "a long, b long"), "verified"))
    common.discard(rooted, shingled)

    label = closed(links).withColumnRenamed("node", "sid")
    least_of = sets.groupBy("sid").agg(F.min("did").alias("least")).join(label, "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    least_of = common.written(least_of, "rooted")
    first = common.written(least_of.groupBy("root").agg(F.min("least").alias("component")), "components")
    of = common.written(least_of.join(first, "root").select("sid", "root", "component"), "component-of")
    component = F.when(F.col("component") != common.NULL_ID, F.col("component"))
    return sets.select("doc_id", "text_hash", "sid").join(of, "sid").select("doc_id", "text_hash", component.alias("component_id"), F.col("root").alias("set"))
