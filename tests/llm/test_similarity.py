import random

import numpy as np
import pytest

from pyspark.sql.types import LongType, StringType, StructField, StructType

from driftlens.llm import decontamination, line_dedup, near_copies, simhash

from .helpers import docs, words


def leaks_brute(rows, items, n=5, threshold=0.8):
    out = []
    for i, t in items:
        ws = words(t or "")
        if not ws:
            continue
        size = min(n, len(ws))
        have = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)}
        for d, text in rows:
            w = words(text or "")
            both = len(have & {tuple(w[k : k + size]) for k in range(len(w) - size + 1)})
            if both >= threshold * len(have) - 1e-9 and both:
                out.append((d, i, len(have), both))
    return sorted(out, key=str)


def test_leaks_against_brute_force(spark):
    r = random.Random(1)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice((1, 3, 4, 5, 6, 15, 40))))) for k in range(40)] + [(90, None), (91, "  "), (92, "Same Item here TWICE over"), (92, "same item here twice over"), (None, "an item without an id of its own")]
    rows = []
    for k in range(80):
        text = [r.choice(vocab) for _ in range(r.choice((0, 3, 30, 300)))]
        if k % 3 == 0:
            piece = words(r.choice(items)[1] or "")
            if k % 2 and len(piece) > 10:
                piece[len(piece) // 2] = "changed"
            text[len(text) // 2 : len(text) // 2] = piece
        rows.append((k, "\n".join(text)))
    rows += [(200, None), (201, ""), (None, "x " + items[5][1]), (3, "same item here twice over"), (202, "SAME\titem here twice over " * 3)]
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = leaks_brute(rows, items)
    assert expected
    for block in (32_000_000, 300):  # one block of items, then many
        got = sorted((tuple(x)[:4] for x in decontamination.find_leaks(docs(spark, rows), table, block_chars=block).collect()), key=str)
        assert got == expected
        kept = decontamination.decontaminate(docs(spark, rows), table, block_chars=block)
        bad = {d for d, *_ in expected}
        assert sorted((x["doc_id"] for x in kept.collect()), key=str) == sorted((d for d, t in rows if not leaks_brute([(d, t)], items)), key=str)
        assert kept.columns == docs(spark, []).columns and bad
    assert decontamination.find_leaks(docs(spark, []), table).count() == 0
    assert decontamination.find_leaks(docs(spark, rows), table.where("false")).count() == 0
    assert decontamination.decontaminate(docs(spark, rows), table.where("false")).count() == len(rows)


def fingerprint_brute(text, n=4):
    import xxhash

    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - 2**64 if value >= 2**63 else value


def test_fingerprints():
    for t in ("", " \t", "one", "one two three", "One two THREE four", "a b c d e f g a b c d", "é ü ß x y z\x1fa\x85b c", "same " * 50):
        assert simhash.fingerprint(t.encode()) == fingerprint_brute(t)


def test_gray_index_finds_all_pairs_within_the_limit():
    r = np.random.default_rng(2)
    centers = r.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False)) for _ in range(900)], np.uint64)
    fps = np.unique(np.concatenate([centers[r.integers(0, 40, 900)] ^ flips, r.integers(0, 2**63, 300, dtype=np.uint64), np.array([0, 2**64 - 1, 1], np.uint64)]))
    got = {(int(a), int(b)) for q, p in simhash.GrayIndex(fps).search(fps, 4, 257) for a, b in zip(q, p, strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert got == set(zip(*map(list, np.nonzero(near)), strict=True)) or got == {(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)}


def components_brute(rows):
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    fps = np.array([fingerprint_brute(t or "") for _, t in rows]).view(np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.array(ids)
    while True:
        new = np.array([label[near[k]].min() for k in range(len(ids))])
        if (new == label).all():
            return sorted(((i, int(f), None if c == 2**63 - 1 else int(c)) for (i, _), f, c in zip(rows, fps.view(np.int64), label, strict=True)), key=str)
        label = new


@pytest.mark.parametrize("most", [2048, 7])  # whole groups, and groups cut into blocks
def test_components_against_brute_force(spark, most):
    r = random.Random(4)
    vocab = [f"t{k}" for k in range(500)]
    base = [r.choice(vocab) for _ in range(400)]
    rows = [(k, " ".join(base[: 400 - k % 3] + [r.choice(vocab)] * (k % 2))) for k in range(40)]
    rows += [(100 + k, " ".join(r.choice(vocab) for _ in range(30))) for k in range(60)]
    rows += [(300, None), (299, ""), (301, " "), (None, "a null id alone here"), (5, "again under five"), (5, "again under five")]
    r.shuffle(rows)
    got = sorted((tuple(x) for x in simhash.near_duplicates(docs(spark, rows), most=most).collect()), key=str)
    assert got == components_brute(rows)


def test_one_of_each(spark):
    rows = [(4, "a b c d e f g h"), (2, "A b c d e f g h"), (2, "a b c d e f g h"), (9, "quite another text than these"), (None, "without an id of its own")]
    kept = simhash.one_of_each(docs(spark, rows))
    assert sorted((x["doc_id"] for x in kept.collect()), key=str) == [2, 9, None]
    assert kept.columns == docs(spark, []).columns
    assert simhash.one_of_each(docs(spark, [])).count() == 0
    # rows are judged by their own texts: different ones stay, whether they share an id or have none
    rows = [(7, "one text of seven, quite long"), (7, "another text under the same id"), (None, "null id with a text"), (None, "and one more without id"), (8, "one text of seven, quite long"), (7, "one text of seven, quite long"), (None, "null id with a text"), (None, "another text under the same id")]
    for found in (simhash.one_of_each(docs(spark, rows)), simhash.leading(docs(spark, rows), near_copies.grouped(docs(spark, rows)))):
        assert sorted(((x["doc_id"], x["text"]) for x in found.collect()), key=str) == sorted([rows[k] for k in range(4)], key=str)

    # the largest number counts as no id
    top = 2**63 - 1
    rows = [(top, "one text of the last id"), (top, "one text of the last id"), (None, "one text of the last id"), (3, "another text with an id")]
    assert sorted((x["text"] for x in simhash.one_of_each(docs(spark, rows)).collect())) == ["another text with an id", "one text of the last id"]


def test_a_large_group_keeps_its_first_row_only(spark):
    rows = [(k, "the same words in all of these many texts") for k in range(3000, 0, -1)] + [(5000, "and one text that stands alone")]
    assert sorted(x["doc_id"] for x in simhash.one_of_each(docs(spark, rows)).collect()) == [1, 5000]


def test_small_groups_are_searched_by_the_index(monkeypatch):
    sizes = []
    real = simhash.GrayIndex
    monkeypatch.setattr(simhash, "GrayIndex", lambda fps: sizes.append(len(fps)) or real(fps))
    fps = np.array([5, 7, 1 << 40, 15], np.int64)
    assert simhash.group_links(fps, np.full(4, 2), 4) == [(5, 7), (5, 15), (5, 1 << 40)] and sizes == [4]
    assert simhash.group_links(fps[[0, 2]], np.full(2, 2), 2) == [] and sizes == [4, 2]


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "_text", "_key", "_did", "_drops", "_id", "_hash", "_of", "_with", "key", "set", "a b", "x.y", "keys"]
    rows = [(k, f"text of {k} only\na line that all have", *[f"{n}{k}" for n in names[2:]]) for k in range(6)] + [(9, "text of 0 only\na line that all have", *[f"{n}9" for n in names[2:]]), (10, None, *[None] * 13)]
    schema = StructType([StructField("doc_id", LongType()), *[StructField(n, StringType()) for n in names[1:]]])
    table = spark.createDataFrame(rows, schema).repartition(3)
    shorter = {r[0]: r for r in line_dedup.dedup_rows(table).collect()}
    assert {i: tuple(r)[2:] for i, r in shorter.items()} == {r[0]: r[2:] for r in rows}
    assert [shorter[k]["text"] for k in (0, 1, 9, 10)] == [rows[0][1], "text of 1 only", "", None]
    ones = simhash.one_of_each(table)
    assert ones.columns == names and sorted(map(tuple, ones.collect()), key=str) == sorted([r for r in rows if r[0] != 9], key=str)
    items = spark.createDataFrame([(0, "text of 3 only a"), (1, "quite another item of the benchmark")], "item_id long, text string")
    for block in (10**6, 20):
        clean = decontamination.decontaminate(table, items, block_chars=block)
        assert clean.columns == names and sorted(map(tuple, clean.collect()), key=str) == sorted([r for r in rows if r[0] != 3], key=str)


def test_index_holds_under_four_bytes_a_character():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice((8, 40, 120)))).encode()) for k in range(3000)]
    index = decontamination.Index(items, 5, 0.8)
    assert index.bytes_held < 4 * sum(len(t) for _, t in items)
    for k in (0, 5, 2999):
        words_ = b"before it " + items[k][1] + b" after it"
        assert [i for i, *_ in index.search(words_.split(), {})] == [k]


def test_block_choices_cover_four_differences():
    r = random.Random(9)
    for blocks in (5, 6, 7, 8):
        masks = [m % 2**64 for m in simhash.masks(4, blocks)]
        for _ in range(300):
            diff = sum(1 << b for b in r.sample(range(64), 4))
            assert any(not diff & m for m in masks)


def copy_labels(rows, n=5, similarity=0.8):
    """For each row the smallest (id, place) of its set; a null id counts as 2**63 - 1."""
    sets = [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (words(t or "") for _, t in rows)]
    label = [(2**63 - 1 if i is None else i, k) for k, (i, _) in enumerate(rows)]
    near = [[j for j, b in enumerate(sets) if len(a & b) >= similarity * len(a | b) - 1e-9] for a in sets]
    while True:
        new = [min(label[j] for j in near[k]) for k in range(len(rows))]
        if new == label:
            return label
        label = new


def copies_brute(rows, n=5, similarity=0.8):
    return sorted(((i, None if c == 2**63 - 1 else c) for (i, _), (c, _) in zip(rows, copy_labels(rows, n, similarity), strict=True)), key=str)


@pytest.mark.parametrize("most", [1024, 5])  # whole groups, and groups cut into blocks
def test_near_copies_against_brute_force(spark, most):
    import corpus_pipeline

    r = random.Random(6)
    vocab = [f"t{k}" for k in range(900)]
    rows = []
    for k in range(30):  # copies with one to four words changed, so similarities from 0.6 to 0.97; chains of copies
        base = [r.choice(vocab) for _ in range(r.choice((60, 100, 300)))]
        for j in range(6):
            rows.append((10 * k + j, " ".join(base)))
            for _ in range(r.randrange(1, 5)):
                base[r.randrange(len(base))] = r.choice(vocab)
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (None, "a null id alone here"), (5, rows[40][1])]
    r.shuffle(rows)
    want = copies_brute(rows)
    got = sorted((tuple(x) for x in near_copies.near_copies(docs(spark, rows), most=most).collect()), key=str)
    assert got == want
    assert near_copies.near_copies(docs(spark, [])).count() == 0
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "").collect()}
    assert kept == {i for i, c in want if i == c}
    four = {x["doc_id"] for x in simhash.one_of_each(docs(spark, rows)).collect()}
    assert len(four - kept) > 10  # what four bits let pass


def test_near_copies_get_candidates_from_the_gray_index(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(41)
    fps = [r.getrandbits(63) for _ in range(60)]
    fps += [f ^ (1 << r.randrange(60)) ^ (1 << r.randrange(60)) for f in fps[:30]] + fps[:10]
    sets = spark.createDataFrame(list(enumerate(fps)), "sid long, fp long")
    found = [(x["a"], x["b"]) for x in near_copies.indexed(sets).collect()]
    root = list(range(len(fps)))
    for a, b in found:
        root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    near = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    assert near and all(root[a] == root[b] for a, b in near) and all(bin(fps[a] ^ fps[b]).count("1") <= 16 for a, b in found)

    seen = []
    monkeypatch.setattr(near_copies, "indexed", lambda sets, real=near_copies.indexed: seen.append(real(sets)) or seen[-1])
    base = [f"w{r.randrange(500)}" for _ in range(300)]
    rows = [(k, " ".join(base[:-1] + [f"end{k}"])) for k in range(5)] + [(9, "something else entirely, said once")]
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "").collect()}
    assert kept == {0, 9} and seen[0].count() >= 1
