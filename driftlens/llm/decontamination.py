"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by size (number of distinct word shingles, in powers of
two). Each partition keeps a bottom-k MinHash sketch of its items, with k taken
from its largest size so that a document holding the threshold's share of an
item's shingles must hold a known number of its sketch. Documents are probed
with the hashes of all their shingles, as a sketch of a long document would
lose a short item; candidates are verified by exact shingle containment. No
item at or over the threshold is missed.

Documents are never shuffled: a block of items of bounded size is broadcast and
the documents stream past it. An index holds numbers and the items' texts only,
under 4 bytes a character of the items. Larger item sets take several
blocks, one after the other: what a block finds is written and its index taken
back before the next one is made, so memory is that of one block at any number of items.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAKS = "doc_id long, item_id long, n_shingles int, n_found int, containment double"
BLOCK_CHARS = 16_000_000


def shingle_set(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def needed(size: int | np.ndarray, threshold: float):
    return np.maximum(1, np.ceil(threshold * size - 1e-9)).astype(np.int64)


class Index:
    """Sketches of a block of items: for each shingle length the sorted hashes and whose they are.

    The items' words are kept as one run of bytes, from which a candidate's shingles are made again.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], words: int, threshold: float):
        self.words, self.threshold, self.ids = words, threshold, []
        texts, hashes, lengths, sizes, memo = [], [], [], [], {}
        for item_id, text in items:
            ws = text.lower().split()
            if ws:
                n = min(words, len(ws))
                h = np.unique(common.shingle_hashes(common.word_hashes(ws, memo, 50_000), n))
                self.ids.append(item_id)
                texts.append(b" ".join(ws))
                hashes.append(h)
                lengths.append(n)
                sizes.append(len(h))
        memo.clear()
        self.text = b"\n".join(texts)
        self.ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        del texts
        size, self.length = np.array(sizes, np.int64), np.array(lengths, np.int8)
        # the largest size of each partition decides how long its sketches are
        part = np.log2(np.maximum(1, size)).astype(np.int64)
        largest = np.zeros(64, np.int64)
        np.maximum.at(largest, part, size)
        k = 2 * (largest - needed(largest, threshold)) + 4
        kept = np.minimum(size, k[part])
        self.least = np.maximum(1, kept - (size - needed(size, threshold))).astype(np.int32)
        self.keys = {}
        for n in set(lengths):
            of = np.flatnonzero(self.length == n)
            flat = np.concatenate([hashes[i][: kept[i]] for i in of])
            owner = np.repeat(of.astype(np.int32), kept[of])
            order = np.argsort(flat, kind="stable")
            self.keys[n] = flat[order], owner[order]

    @property
    def bytes_held(self) -> int:
        arrays = [self.ends, self.length, self.least, *(a for pair in self.keys.values() for a in pair)]
        return len(self.text) + sum(a.nbytes for a in arrays)

    def shingles(self, i: int) -> set[bytes]:
        start = int(self.ends[i - 1]) if i else 0
        return shingle_set(self.text[start : int(self.ends[i]) - 1].split(b" "), int(self.length[i]))

    def search(self, words: list[bytes], memo: dict) -> list[tuple[int | None, int, int]]:
        """(item, its shingles, those found) for the items that the document holds."""
        out = []
        hashed = common.word_hashes(words, memo)
        for n, (keys, owners) in self.keys.items():
            h = common.shingle_hashes(hashed, n)
            if not len(h):
                continue
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            hit = np.unique(h[keys[at] == h])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
            item, found = np.unique(np.concatenate([owners[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]), return_counts=True)
            held = None
            for i in item[found >= self.least[item]].tolist():
                shingles = self.shingles(i)
                held = shingle_set(words, n) if held is None else held
                if (both := len(shingles & held)) >= needed(len(shingles), self.threshold):
                    out.append((self.ids[i], len(shingles), both))
        return out


def item_blocks(items: DataFrame, words: int, threshold: float, block_chars: int):
    """(number of blocks, their broadcast indexes one by one), each of about block_chars characters of text at most."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), common.utf8().alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    # each text goes by its own hash, so items without an id spread as well
    rows = rows.withColumn("b", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))

    def made():
        for b in range(blocks):
            part = [(i, bytes(t)) for i, t in rows.where(F.col("b") == b).select("item_id", "text").toLocalIterator()]
            yield spark.sparkContext.broadcast(Index(part, words, threshold))

    return blocks, made()


def _search(index):
    def rows(given):
        memo: dict[bytes, int] = {}
        for doc_id, text in given:
            for item_id, size, found in index.value.search(text.lower().split(), memo):
                yield doc_id, item_id, size, found, found / size

    return rows


def find_leaks(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Returns doc_id, item_id, n_shingles, n_found, containment, a row for each item held by a row of docs.

    Shingles are distinct runs of five words, A-Z lower-cased; an item of fewer
    words is one shingle of its own length. An item without words, or null, is
    in no document; a null or empty document holds none. Rows that repeat are
    searched each for itself, and null ids stay null. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8().alias("text"))
    blocks, indexes = item_blocks(items, words, threshold, block_chars)
    out = None
    for index in indexes:
        found = common.arrow_pass(texts, _search(index), LEAKS)
        if blocks > 1:
            found = common.written(found, "leaks")
            index.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _hits(index):
    def rows(given):
        memo: dict[bytes, int] = {}
        for key, text in given:
            if index.value.search(text.lower().split(), memo):
                yield (key,)

    return rows


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item.

    With one block of items the documents are filtered as they stream by. With more, the
    128-bit digests of the texts that hold items are gathered block by block, and docs meet them once.
    """
    blocks, indexes = item_blocks(items, words, threshold, block_chars)
    if blocks == 1:
        index = next(indexes)

        def keeper():
            memo: dict[bytes, int] = {}
            return lambda texts: [not index.value.search(t.lower().split(), memo) for t in texts]

        return common.arrow_filter(docs, keeper)
    digest, found = F.unhex(F.md5(common.utf8())), None
    for index in indexes:
        part = common.written(common.arrow_pass(docs.select(digest.alias("key"), common.utf8().alias("text")), _hits(index), "key binary").distinct(), "held")
        index.destroy()
        found = part if found is None else found.union(part)
    key = common.free_name(docs, "key")
    return docs.withColumn(key, digest).join(found.distinct().toDF(key), key, "left_anti").drop(key)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
i as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from benchmark),
item_shingles as (
  select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as s
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as k
        from (select item_id, w, least(5, len(w)) as n from i where len(w) > 0))),
doc_shingles as (
  select doc_id, n, array_to_string(w[k:k + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k
        from d, (select distinct n from item_shingles) where len(w) >= n)),
sizes as (select item_id, count(*) as size from item_shingles group by item_id),
found as (
  select doc_id, item_id, count(distinct s) as n_found
  from doc_shingles join item_shingles using (n, s) group by doc_id, item_id)
select doc_id, item_id, size::int as n_shingles, n_found::int as n_found, n_found / size as containment
from found join sizes using (item_id) where n_found >= 0.8 * size
"""
