import random
import re

import pytest
from pyspark.sql import functions as F

from driftlens.functions import taxonomy
from driftlens.operators import changes, corpus, prevalence, reports


def quota_loop(rows, quotas, scan):
    taken, seen, left = [], set(), dict(quotas)
    for rank, source, language, usable in sorted(rows)[:scan]:
        if not left.get(language) or source in seen:
            continue
        seen.add(source)
        if usable:
            left[language] -= 1
            taken.append(rank)
    return taken


def test_quota_selection_is_the_scan(spark):
    r = random.Random(6)
    for _ in range(12):
        rows = [(k, f"s{r.randrange(14)}", r.choice(("c", "cxx", "d", "none")), r.random() < 0.7) for k in range(40)]
        quotas = {"c": r.randint(1, 6), "cxx": r.randint(1, 4), "d": r.randint(1, 3)}
        df = spark.createDataFrame(rows, "rank int, source string, language string, usable boolean")
        got = sorted(x["rank"] for x in corpus.quota_topk(df, quotas, 33).collect())
        assert got == quota_loop(rows, quotas, 33)


def test_releases_pairs_and_roles(spark):
    v = spark.createDataFrame([("z", x) for x in ("1.0-1", "1.0-2", "1.10-1", "1.9-1", "2.0~rc1-1", "bad:1", "1:0.5-1")], "source string, version string")
    pairs = corpus.release_pairs(v)
    assert sorted(p["id"] for p in pairs.collect()) == ["z@1.0..1.9", "z@1.10..0.5", "z@1.9..1.10"]
    names = [("r1", "libssl3", n) for n in ("libssl3", "libssl3-dbgsym", "libssl1.1", "libcrypto4", "libcrypto4-dbgsym", "libssl-dev", "zlib-dev", "libssl-doc")] + [("r2", "libfoo5", n) for n in ("libfoo5t64", "libfoo5t64-dbgsym", "other-dev")]
    got = {x["release"]: (x["runtime"], x["dev"]) for x in corpus.roles(spark.createDataFrame(names, "release string, want string, name string")).collect()}
    assert got == {"r1": (["libssl3"], ["libssl-dev"]), "r2": (["libfoo5t64"], ["other-dev"])}


def test_budget_and_remaining(spark):
    jobs = spark.createDataFrame([("a",), ("b",)], "id string")
    sizes = spark.createDataFrame([("a", 900_000_000), ("a", None), ("b", 1)], "id string, length long")
    assert {r["id"]: r["error"] is None for r in corpus.within_budget(jobs, sizes, 2500).collect()} == {"a": False, "b": True}
    assert [r["id"] for r in corpus.remaining(jobs, jobs.where("id = 'a'"), ["id"]).collect()] == ["b"]


def symbol(link, name=None, pretty=None, version=None, result="int", params=(), function=True):
    return ("p", link, pretty or f"{link}()", name or link, version, function, result, list(params))


SYMBOLS = "k string, linkage string, pretty string, pairing string, version string, is_function boolean, return_type string, params array<string>"


def test_symbol_steps(spark):
    old = [symbol("f"), symbol("gone", version="LIB_PRIVATE_1"), symbol("_Z1gi", "g", "g(int)"), symbol("v_1_a"), symbol("v_1_b"), symbol("_ZTV1X"), symbol("same", params=["const int"]), symbol("data", function=False)]
    new = [symbol("f", result="long"), symbol("_Z1gl", "g", "g(long)"), symbol("v_2_a"), symbol("v_2_b"), symbol("fresh"), symbol("same", params=["int"]), symbol("_ZTV1Y")]
    events, tallies = changes.symbols(spark.createDataFrame(old, SYMBOLS), spark.createDataFrame(new, SYMBOLS), ["k"], mass_min=2)
    got = sorted((e["kind"], e["linkage"], e["private"]) for e in events.collect())
    assert got == [("function_signature_changed", "_Z1gi", False), ("function_signature_changed", "f", False), ("symbol_added", "fresh", False), ("symbol_removed", "data", False), ("symbol_removed", "gone", True)]
    assert [tuple(t) for t in tallies.collect()] == [("p", 2, 3, False)]


def test_rename_counts_are_the_greedy_ones(spark):
    r = random.Random(3)
    name = lambda: f"s{r.randrange(3)}_{r.randrange(9)}"
    removed, added = [("g", name()) for _ in range(30)], [("g", name()) for _ in range(25)]
    pool, n = [re.sub("[0-9]+", "#", a) for _, a in added], 0
    for _, x in removed:
        if (b := re.sub("[0-9]+", "#", x)) in pool:
            pool.remove(b)
            n += 1
    side = lambda rows: spark.createDataFrame(rows, "g string, name string")
    assert changes.renamed_counts(side(removed), side(added), ["g"], "name").first()["renamed"] == n


def test_attribution(spark):
    ch = spark.createDataFrame([("a", "T1"), ("a", "T2"), ("a", "T3"), ("b", "T1")], "g string, type_id string")
    types = spark.createDataFrame([("a", "T1", "/x/own.h"), ("a", "T2", "/usr/other.h"), ("a", "T3", None), ("b", "T1", "/x/any.h")], "g string, type_id string, declared_in string")
    own = spark.createDataFrame([("a", "own.h")], "g string, basename string")
    got = {(r["g"], r["type_id"]): r["third_party"] for r in changes.attributed(ch, types, own, ["g"]).collect()}
    assert got == {("a", "T1"): False, ("a", "T2"): True, ("a", "T3"): False, ("b", "T1"): False}


def test_objects_by_stem(spark):
    side = lambda rows: spark.createDataFrame([("r", p, s) for p, s in rows], "k string, path string, size long")
    old, new = side([("usr/liba.so.1", 5), ("usr/x/liba.so.1.2", 9), ("libb.so", 1)]), side([("liba.so.2", 4), ("libc.so.1", 2)])
    got = sorted(((r["stem"], r["old_path"], r["new_path"]) for r in changes.paired_objects(old, new, ["k"], largest=True).collect()), key=str)
    assert got == [("liba", "usr/x/liba.so.1.2", "liba.so.2"), ("libb", "libb.so", None), ("libc", None, "libc.so.1")]


def test_rescue_and_frequency_small(spark):
    long = spark.createDataFrame([("t1", "enum_case_added", 2), ("t2", "enum_case_added", 4), ("t2", "vtable_changed", 1), ("t3", "symbol_removed", 1), ("t3", "vtable_changed", 1), ("t4", "symbol_added", 9)], "id string, kind string, n bigint")
    dim = taxonomy.dimension(spark)
    got = {r["mechanism"]: tuple(r)[1:] for r in prevalence.rescue(long, dim, "evolution", "id").collect()}
    assert got == {taxonomy.LAYOUT: (3, 2, 0, 0), taxonomy.ENUM: (3, 2, 2, 1), taxonomy.DISPATCH: (3, 2, 1, 0), taxonomy.INLINE: (3, 2, 0, 0)}
    f = {r["kind"]: r for r in prevalence.frequency(long, dim).collect()}
    assert (f["enum_case_added"]["transitions"], f["enum_case_added"]["events"], f["enum_case_added"]["median"], f["enum_case_added"]["most"]) == (2, 6, 3.0, 4)
    t = spark.createDataFrame([(f"t{k}", f"s{k % 2}", k == 3) for k in range(1, 6)], "id string, source string, soname_changed boolean")
    assert prevalence.breaks(t, long, dim, "id").first()[:] == (5, 2, 1, 1, 0)
    assert prevalence.histogram(long, t, "id", "source").orderBy("source").collect()[0]["kinds"] == "symbol_added=9, enum_case_added=4, vtable_changed=1"


def test_noise_floor_and_maps(spark):
    maps = spark.createDataFrame([("a", {"x": 1, "y": 0}), ("a", {"x": 2}), ("b", {})], "id string, m map<string, int>")
    long = prevalence.long_counts(maps, ["id"], "m")
    assert [tuple(r) for r in long.collect()] == [("a", "x", 3)]
    assert prevalence.as_map(long, ["id"]).first()["counts"] == {"x": 3}
    t = spark.createDataFrame([("a", "study"), ("b", "study"), ("c", "control")], "id string, arm string")
    assert [(r["arm"], r["kind"], r["percent"]) for r in prevalence.noise_floor(long, t, "id").collect()] == [("study", "x", 50.0)]


REPORT = """Functions changes summary: 1 Removed, 1 Changed
1 Removed function:

  [D] 'function int old(int)'    {old@@LIB_PRIVATE_1}

  'struct Point at lib.h:3:1' changed:
    type size changed from 64 to 96 (in bits)
    1 data member insertion:
      'int z', at offset 64 (in bits)
    there are data member changes:
      type 'int' of 'Point::y' changed:
        entity changed
      'int y' offset changed from 32 to 64 (in bits) (by +32 bits)
    there are enumerator insertions:
      'E::A' value '1'
      'E::B' value '2'
"""


def test_report_tagging(spark):
    df = spark.createDataFrame([("r", REPORT), ("empty", ""), ("none", None)], "id string, text string")
    tree = reports.nodes(df, "id", "text")
    tags = {r["tag"]: r["n"] for r in reports.tag_counts(tree, "id").collect()}
    assert tags == {"type_size_changed": 1, "struct_field_added": 1, "struct_field_type_changed": 1, "member_offset_changed": 1, "enum_case_added": 2}
    got = {r["kind"]: r["n"] for r in reports.headline(reports.tag_counts(tree, "id"), "id").collect()}
    assert got["field_added_to_struct"] == 1 and got["enum_case_added"] == 2
    e = reports.entries(tree, "id").collect()
    assert [(x["change"], x["what"], x["name"], x["symbol"], x["private"]) for x in e] == [("D", "function int", "old(int)", "old@@LIB_PRIVATE_1", True)] or e[0]["private"]
    leaf = spark.createDataFrame([("r", "base_class_added", 1), ("r", "symbol_added", 2)], "id string, tag string, n bigint")
    full = spark.createDataFrame([("r", "base_class_added", 3), ("r", "symbol_added", 9)], "id string, tag string, n bigint")
    assert {x["tag"]: x["n"] for x in reports.merged(leaf, full, "id").collect()} == {"base_class_added": 3, "symbol_added": 2}


def test_older_matching_order(spark):
    side = lambda names: spark.createDataFrame([("k", n) for n in names], "k string, name string")
    got = reports.rename_first(side(["void f1(int)", "int g(int)", "int h()"]), side(["void f2(int)", "int g(long)", "int new()"]), ["k"]).first()
    assert (got["renamed"], got["signatures"], got["removed"], got["added"]) == (1, 1, 1, 1)


def test_declared_names(spark):
    tree = spark.createDataFrame([("r", 1, "D", "function", "void A::f(int)", "f@@V"), ("r", 2, "D", "function", "int hidden()", None)], "id string, line int, change string, what string, name string, symbol string")
    names = spark.createDataFrame([(n,) for n in ("f", "b", "c", "d", "e")], "name string")
    assert {r["line"]: r["public"] for r in reports.declared(tree, names).collect()} == {1: True, 2: False}
    assert {r["public"] for r in reports.declared(tree, names.limit(3)).collect()} == {None}


def test_lexical_scan():
    bodies, macros = reports.scan_header('#define BUF 64 // size\n#define _X 1\n#define LIB_H\n#define F(x) x\nstatic inline int twice(int v) { if (v) { return v*2; } return 0; }\n/* int no() { } */ int decl(int);\ntemplate<class T> T clampv(T x) const { return x; }')
    assert macros == [("BUF", "64")]
    assert [b[0] for b in bodies] == ["twice(int v)", "clampv(T x)"]


def test_lexical_scan_takes_linear_time():
    import time

    for text in ("f(" * 60_000, "f() {" * 40_000, "a" * 200_000, "a:" * 80_000, "(" * 100_000 + "{" * 100_000):
        began = time.process_time()
        reports.scan_header(text)
        assert time.process_time() - began < 3


def test_binaries_without_an_origin_take_up_scan_places(spark):
    r = random.Random(5)
    frame = spark.createDataFrame
    popcon = [(k, f"libn{k}", 100 - k) for k in range(60)]
    origins = {f"libn{k}": f"s{r.randrange(12)}" for k in range(60) if r.random() < 0.6}
    symbols, devs = {k for k in range(60) if r.random() < 0.7}, {f"s{k}" for k in range(12) if r.random() < 0.8}
    packages = [(origins[f"libn{k}"], f"libn{k}-dbgsym") for k in symbols if f"libn{k}" in origins] + [(s, f"{s}-dev") for s in devs]
    found = corpus.candidates(frame(popcon, "rank int, name string, installs bigint"), frame([("libn3", "libstdc++6"), ("libn9", "libstdc++6")], "name string, depends string"), frame(sorted(origins.items()), "binary string, source string"), frame(packages, "source string, name string"))
    taken, seen, left = [], set(), {"c": 5, "cxx": 2}
    for k in range(30):  # places go by, with an origin or without
        source, language = origins.get(f"libn{k}"), "cxx" if k in (3, 9) else "c"
        if source is None or not left[language] or source in seen:
            continue
        seen.add(source)
        if k in symbols and source in devs:
            left[language] -= 1
            taken.append(f"libn{k}")
    assert sorted(x["binary"] for x in corpus.quota_topk(found, {"c": 5, "cxx": 2}, 30).collect()) == sorted(taken)


@pytest.mark.parametrize("arm", ["control"])
def test_control_pairs(spark, arm):
    df = spark.createDataFrame([("s", "1.0", k) for k in (1, 2, 3)] + [("s", "2.0", 4)], "source string, upstream string, rev int")
    got = corpus.control_pairs(df, "source", "upstream", [F.desc("rev")], ["rev"]).collect()
    assert [(r["upstream"], r["new"]["rev"], r["old"]["rev"]) for r in got] == [("1.0", 3, 2)]


def symbols_loop(old, new, mass_min):
    """The four steps as loops over one pair of objects."""
    olds, news = ({x[1]: x for x in side if not re.match("_ZT[VIST]", x[1])} for side in (old, new))
    removed, added = ([x for k, x in sorted(a.items()) if k not in b] for a, b in ((olds, news), (news, olds)))
    events, plain = [], []
    for r in [x for x in removed if x[5]]:
        mate = next((x for x in added if x[5] and x[3] == r[3] and x[2] != r[2]), None)
        if mate:
            removed.remove(r), added.remove(mate)
            events.append(("function_signature_changed", r[1], f"{r[2]}  ->  {mate[2]}"))
    renamed = 0
    for r in list(removed):
        mate = next((x for x in added if re.sub("[0-9]+", "#", x[1]) == re.sub("[0-9]+", "#", r[1])), None)
        if mate:
            removed.remove(r), added.remove(mate)
            renamed += 1
    plain = [("symbol_removed", x[1], x[2]) for x in removed] + [("symbol_added", x[1], x[2]) for x in added]
    bare = lambda p: re.sub(" +", " ", re.sub(r"\b(const|volatile)\b", "", p)).strip()
    for k in olds.keys() & news.keys():
        a, b = olds[k], news[k]
        if a[5] and b[5] and (a[6] != b[6] or [*map(bare, a[7])] != [*map(bare, b[7])]):
            events.append(("function_signature_changed", k, f"{a[2]}  ->  {b[2]}"))
    return sorted(events + plain), (renamed, len(plain), renamed >= mass_min and renamed >= len(plain))


def test_symbol_steps_are_those_of_the_loops(spark):
    r = random.Random(21)
    for _ in range(5):
        def make(side):
            names = {f"{r.choice('abc')}{r.randrange(4)}_{r.randrange(30)}" for _ in range(40)}
            return [symbol(n, name=f"fn{r.randrange(6)}", pretty=f"text{r.randrange(5)}", result=r.choice(("int", "long")), params=[r.choice(("const int", "int", "char"))], function=r.random() < 0.8) for n in sorted(names)] + [symbol(f"_ZTV{side}")]  # noqa: B023
        old, new = make(1), make(2)
        events, tallies = changes.symbols(spark.createDataFrame(old, SYMBOLS), spark.createDataFrame(new, SYMBOLS), ["k"], mass_min=3)
        want, (renamed, plain, mass) = symbols_loop(old, new, 3)
        assert sorted((e["kind"], e["linkage"], e["pretty"]) for e in events.collect()) == want
        assert [tuple(t) for t in tallies.collect()] == [("p", renamed, plain, mass)]


def test_scoped_counts_and_summary(spark):
    text = "Leaf changes summary: 3 artifacts changed\nChanged leaf types summary: 2 (1 filtered out) leaf types changed\nRemoved/Changed/Added functions summary: 4 Removed, 5 Changed, 6 Added functions\n\n'struct A at own.h:3:1' changed:\n  type size changed from 64 to 96 (in bits)\n'struct B at /usr/other.h:9:1' changed:\n  type size changed from 8 to 16 (in bits)\n  1 data member insertion:\n    'int z'\nreturn type changed:\n"
    tree = reports.nodes(spark.createDataFrame([("r", text)], "id string, text string"), "id", "text")
    assert reports.summaries(tree, "id").first()[1:] == (3, 2, 4, 5, 6)
    own = spark.createDataFrame([("r", "own.h")], "id string, basename string")
    got = {(x["type"], x["tag"]): x["third_party"] for x in reports.own_and_third(reports.scoped_counts(tree, "id"), own, "id").collect()}
    assert got == {("struct A", "type_size_changed"): False, ("struct B", "type_size_changed"): True, ("struct B", "struct_field_added"): True, (None, "fn_return_type_changed"): False}


def test_candidates_builds_patterns_and_eviction(spark):
    frame = spark.createDataFrame
    popcon = frame([(1, "liba1", 9), (2, "libb2", 8), (3, "libc-dev", 7), (4, "libd1", 6)], "rank int, name string, installs bigint")
    depends = frame([("liba1", "libc6, libstdc++6"), ("libb2", "libc6")], "name string, depends string")
    origins = frame([("liba1", "a"), ("libb2", "b"), ("libc-dev", "c")], "binary string, source string")
    packages = frame([("a", "liba1-dbgsym"), ("a", "liba-dev"), ("b", "libb2-dbgsym")], "source string, name string")
    got = {r["binary"]: (r["language"], r["usable"]) for r in corpus.candidates(popcon, depends, origins, packages).collect()}
    assert got == {"liba1": ("cxx", True), "libb2": ("c", False), "libd1": ("c", False)}
    builds = frame([("n", "1.9-1", "h1"), ("n", "1.10-1", "h2"), ("n", "bad:1", "h3")], "name string, version string, hash string")
    assert [(r["version"], r["hash"]) for r in corpus.newest_builds(builds, ["name"]).collect()] == [("1.10-1", "h2")]
    named = frame([("s", "r", "libz1"), ("s", "r", "libz-dev"), ("s", "r", "other")], "source string, release string, name string")
    assert corpus.roles_by_pattern(named, frame([("s", "^libz")], "source string, pattern string")).first()["runtime"] == ["libz1"]
    entries = frame([("c", "p1", 1, 40), ("c", "p2", 2, 40), ("c", "p3", 3, 40), ("d", "p4", 1, 10)], "cache string, path string, mtime int, size int")
    assert sorted(r["path"] for r in corpus.to_evict(entries, "cache", 100).collect()) == ["p1", "p2"]
