import hashlib
import re
from collections import Counter

import pytest

from driftlens.llm import quality, warc

from .helpers import docs

WS = "[\x20\x09-\x0d]+"


def base_brute(text):
    text = text or ""
    ws = [w for w in re.split(WS, text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {i + k for i in range(len(ws) - 2) if grams[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_base_against_brute_force(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, "a b"), (5, "a b c"), (6, "a b c d a b c"), (7, "x x x x x"), (8, "one\none\n one\n\n\n"), (9, "#a *b $ %&|<> é"), (10, " ".join(f"w{k}" for k in range(80))), (11, "go go " * 200), (12, "a\x1fb c\x85d \x0be\x0cf"), (None, "no id here"), (4, "a b"), (13, "\n".join(f"line {k} is a long one of many words" for k in range(4000)))]
    got = quality.judge(docs(spark, rows)).collect()
    mine = sorted(((x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) for x in got), key=str)
    assert mine == sorted(((i, *base_brute(t)) for i, t in rows), key=str)
    assert {x["doc_id"] for x in got if x["kept"]} == {10, 13} - {x["doc_id"] for x in got if x["base_failed"]}
    assert quality.judge(docs(spark, [])).count() == 0


def test_cascade_keeps_the_same_in_any_order(spark):
    text = lambda k: " ".join(f"w{j}" + "%%" * (k % 3 == 0) + "!" * (k % 5 == 0) for j in range(60 + k))
    base = quality.with_base(docs(spark, [(k, text(k)) for k in range(40)]))
    rules = quality.default_rules()
    orders = [quality.planned(base, rules), sorted(rules), sorted(rules, reverse=True)]
    assert sorted(orders[0]) == sorted(rules)
    kept = [sorted(r[0] for r in base.where(quality.cascade(rules, o).isNull()).select("doc_id").collect()) for o in orders]
    assert kept[0] == kept[1] == kept[2] and 0 < len(kept[0]) < 40
    plan = quality.judge(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("PythonUDF", "InPandas", "InArrow", "EvalPython"))


def test_runs_of_one_word_are_found_at_any_place(spark):
    other = [f"word{k}" for k in range(60)]
    rows = [(100 * size + at, " ".join(other[:at] + ["again"] * size + other[at:])) for size in (19, 20, 21, 25) for at in (*range(8), 53, 60)]
    got = {x["doc_id"]: x["rejected_by"] for x in quality.judge(docs(spark, rows)).collect()}
    assert got == {i: "one_word" if i >= 2000 else None for i, _ in rows}


PAGES = "page_id long, url string, html string, digest string, _row string"


@pytest.fixture
def pages(spark, tmp_path):
    body = "<p>" + "same text for many pages " * 10
    rows = [(5, "http://www.Example.com/a?b=1#f", body), (3, "https://example.com:443/b", body), (9, "http://example.com:8080/c d", body), (4, "http://x.org/é", "short"), (6, "http://x.org/é", "short"), (7, None, None), (8, "", ""), (None, "http://null.org/", body), (10, "http://x.org/é", "é" * 200), (5, "http://www.Example.com/a?b=1#f", body), (11, "http://x.org/é", "\r\n\r\nWARC/1.1 " * 20)]
    rows += [(100 + k, f"http://h{k % 7}.example.net/p/{k}", f"<p>page {k}" * 40) for k in range(300)]
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES).repartition(5).write.parquet(path)
    return rows, spark.read.parquet(path)


def test_archives_round_trip(pages):
    rows, table = pages
    archive = warc.write_archive(table, block_lines=20, most=20_000)
    got = warc.read_back(archive).collect()
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", []).append(2**63 if i is None else i)
    expected = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        least = min(first[h or ""])
        expected[i, len(raw), hashlib.sha256(raw).hexdigest(), None if len(raw) < 100 or least == (2**63 if i is None else i) else least] += 1
    mine = Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["refers_to"]) for x in got if x["page_id"] != 5 or x["refers_to"] == 3)
    assert mine == expected
    assert all((x["record_type"] == "revisit") == (x["refers_to"] is not None) for x in got)


def test_small_archives_are_read_by_many_tasks(pages):
    rows, table = pages
    archive = warc.write_archive(table.repartition(43), most=2_000)  # not a plain scan of files either
    files = archive.captures.select("file").distinct().count()
    got = warc.read_back(archive)
    assert files > 43 and got.rdd.getNumPartitions() > 4 and got.count() == len(rows)
    small = warc.read_back(archive, range_bytes=500)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_archives_of_any_table(spark):
    rows = [(k, f"http://a.b/{k}", "<p>" + "x" * (100 * (k % 2)), "clash") for k in range(9)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, _metadata string")
    got = {x["page_id"]: x["refers_to"] for x in warc.read_back(warc.write_archive(table)).collect()}
    assert got == {k: 1 if k % 2 and k > 1 else None for k in range(9)}


def test_lookups_by_the_index(pages):
    rows, table = pages
    archive = warc.write_archive(table, block_lines=20)
    reader = archive.reader()
    latest = {}
    for i, u, h in rows:
        key = warc.url_key(u)
        latest[key] = max(latest.get(key, (-1, "")), (2**63 if i is None else i, h or ""))
    for _, u, _ in rows:
        headers, payload = reader.lookup(u or "")
        assert payload.decode() == latest[warc.url_key(u)][1]
    assert reader.lookup("http://absent.example/") is None and reader.lookup("http://zzz.zzz/") is None
    assert len(archive.top) >= 1 and all(len(reader.lines(n, a, s)) >= 1 for _, n, a, s in archive.top)


def test_empty_archive(spark, tmp_path):
    path = f"{tmp_path}/none.parquet"
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(path)
    archive = warc.write_archive(spark.read.parquet(path))
    assert warc.read_back(archive).count() == 0 and archive.reader().lookup("http://a.b/") is None


def test_url_keys():
    assert warc.url_key("http://WWW.Example.com:80/x?q=1#frag") == "com,example,www)/x?q=1"
    assert warc.url_key("https://user@example.com:8443") == "com,example:8443)/"
    assert warc.url_key(None) == ")/" and " " not in warc.url_key("http://a.b/c d\te")
