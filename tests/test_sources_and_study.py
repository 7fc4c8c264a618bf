import gzip
import io
import json
import lzma
import tarfile

import pytest

from driftlens.plans import rendering, study
from driftlens.sources import archive, artifacts
from driftlens.streaming import incremental


def wrapped(stage, data, version="1"):
    return {"schema": f"anytool/{stage}/{version}", "tool": "t", "generated_at": "2024-01-01T00:00:00Z", "data": data}


def pair(ident, language="c", public=None, third=None, private=None, soname=("a.so.1", "a.so.1"), mass=False, error=None):
    o = {"soname": list(soname), "language": language, "public": public or {}, "third_party": third or {}, "private_node": private or {}, "symbols_version_renamed": 0, "mass_rename": mass, "coverage": {"debug_info_found": [True, True], "exported_functions": [1, 1], "mangled_functions": [0, 0]}, "type_events": [], "symbol_events": []}
    out = {"id": ident, "source": ident.split("@")[0], "upstream": ["1", "2"], "objects": [o, o | {"public": {}, "third_party": {}, "private_node": {}}], "unpaired": [[], []], "object_errors": [], "seconds": 1.0}
    return out | ({"error": error} if error else {})


@pytest.fixture
def folder(tmp_path):
    pairs, heads = tmp_path / "pairs", tmp_path / "headers"
    pairs.mkdir(), heads.mkdir()
    data = [pair("a@1..2", public={"symbol_removed": 2, "enum_case_added": 1}, third={"type_size_changed": 3}), pair("a@2..3", "cxx", public={"vtable_changed": 1}, soname=("a.so.1", "a.so.2")), pair("b@1..2", public={"symbol_added": 5}, private={"symbol_removed": 7}), pair("c@1..2", public={"symbol_version_renamed": 90}, mass=True), pair("d@1..2", error="failed")]
    for k, p in enumerate(data):
        (pairs / f"{k}.json").write_text(json.dumps(wrapped("pair", p), indent=1))
    (pairs / "other.json").write_text(json.dumps(wrapped("plan", {"jobs": []})))
    (pairs / "broken.json").write_text("{nope")
    diff = {"definitions_1": 3, "definitions_2": 3, "definitions_common": 3, "inline_body_changed": 2, "macro_value_changed": 1, "macro_value_changed_nonversion": 0, "examples": []}
    (heads / "0.json").write_text(json.dumps(wrapped("header-pair", {"id": "b@1..2", "source": "b", "upstream": ["1", "2"], "language": "c", "coverage": [{"parsed": 10, "with_fatal": 6}, {"parsed": 10}], "diff": diff}, "2")))
    return tmp_path


def test_study_figures(spark, folder):
    assert {r["file_name"] for r in artifacts.rejected(spark, f"{folder}/pairs", "pair").collect()} == {"other.json", "broken.json"}
    c = study.from_artifacts(spark, f"{folder}/pairs", f"{folder}/headers")
    s = study.analyse(c)
    assert s.corpus.first().asDict() == {"transitions": 4, "sources": 3, "kept": 3, "mass_rename": 1, "kept_sources": 2}
    assert {r["what"]: r["events"] for r in s.filtered.collect()} == {"third_party": 3, "private_node": 7}
    assert s.breaks.first()[:] == (3, 2, 1, 1, 0)
    f = {(r["language"], r["kind"]): (r["transitions"], r["events"]) for r in s.frequency.collect()}
    assert f["all", "symbol_removed"] == (1, 2) and f["cxx", "vtable_changed"] == (1, 1) and f["c", "inline_body_changed"] == (1, 2)
    assert ("all", "symbol_version_renamed") not in f
    r = {x["mechanism"]: x for x in s.rescue["inline"].collect()}
    assert r["resilient dispatch"]["sole_reason"] == 1 and r["no implicit cross-module inlining"]["sole_reason"] == 1 and r["opaque layout"]["affected"] == 3
    h = s.churn.first()
    assert (h["with_data"], h["body_events"], h["macro_changed"], h["macro_changed_nonversion"], h["poor_coverage"]) == (1, 2, 1, 0, 1)
    text = rendering.text_report(s)
    assert "breaking 2 of 3 (66.7%)" in text and "mass renames 3" in text
    assert "symbol_removed" in rendering.frequency_rows(s)
    assert rendering.filled("{{a}} {{b}}", {"a": "<"}) == "&lt; {{b}}" and rendering.percent(1, 0) == "n/a"


def test_version_stamps_do_not_count_as_macro_changes(spark, folder):
    diff = {"definitions_common": 3, "inline_body_changed": 0, "macro_value_changed": 5, "examples": []}
    for k, (ident, more) in enumerate((("a@1..2", {"macro_value_changed_nonversion": 0}), ("a@2..3", {"macro_value_changed_nonversion": 2}), ("b@1..2", {}))):
        (folder / f"headers/{k}.json").write_text(json.dumps(wrapped("header-pair", {"id": ident, "source": "x", "coverage": [], "diff": diff | more}, "2")))
    of = lambda c: {r["id"]: r["n"] for r in c.public.where("kind = 'macro_value_changed'").collect()}
    c = study.from_artifacts(spark, f"{folder}/pairs", f"{folder}/headers")
    assert of(c) == {"a@2..3": 2, "b@1..2": 5}  # without the field the whole counts
    h = study.analyse(c).churn.first()
    assert (h["macro_changed"], h["macro_events"], h["macro_changed_nonversion"]) == (3, 15, 2)
    assert of(study.from_artifacts(spark, f"{folder}/pairs", f"{folder}/headers", strict_reference=True)) == {"a@1..2": 5, "a@2..3": 5, "b@1..2": 5}


def test_artifact_round_trip(spark, tmp_path):
    df = spark.createDataFrame([([(1, 2, "libz1", "zlib", "c")],)], "libraries array<struct<rank: int, installs: bigint, binary: string, source: string, language_hint: string>>")
    artifacts.write_artifact(df, f"{tmp_path}/s", "selection")
    assert artifacts.read_artifacts(spark, f"{tmp_path}/s", "selection").select("libraries").collect() == df.collect()


def test_incremental_counts(spark, folder):
    args = (spark, f"{folder}/pairs", f"{folder}/out", f"{folder}/check")
    incremental.update_counts(*args)
    (folder / "pairs" / "9.json").write_text(json.dumps(wrapped("pair", pair("e@1..2", public={"symbol_added": 4}))))
    incremental.update_counts(*args)
    assert incremental.update_counts(*args) == 0
    got = {(r["id"], r["kind"]): r["n"] for r in incremental.counts(spark, f"{folder}/out").collect()}
    assert got["e@1..2", "symbol_added"] == 4 and got["a@1..2", "symbol_removed"] == 2


def test_popcon_and_packages(spark, tmp_path):
    (tmp_path / "p").write_text("#rank name inst\n1 libc6 500 1 2\n2 libz x 1\nx libq 3\n3 short\n\n4 libm 7\n")
    assert [tuple(r) for r in archive.read_popcon(spark, f"{tmp_path}/p").orderBy("rank").collect()] == [(1, "libc6", 500), (2, "libz", 0), (4, "libm", 7)]
    (tmp_path / "i").write_text("Package: a\nVersion: 1\nDepends: libstdc++6\n\nPackage: b\nVersion: 2\n\n")
    assert sorted(tuple(r) for r in archive.read_depends(spark, f"{tmp_path}/i").collect()) == [("a", "libstdc++6"), ("b", "")]


def deb(names):
    tar_raw = io.BytesIO()
    with tarfile.open(fileobj=tar_raw, mode="w") as tar:
        for n, body in names:
            info = tarfile.TarInfo(n)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    out = b"!<arch>\n"
    for name, body in (("debian-binary", b"2.0\n"), ("data.tar.xz", lzma.compress(tar_raw.getvalue()))):
        out += f"{name:<16}{0:<12}{0:<6}{0:<6}{'100644':<8}{len(body):<10}`\n".encode() + body + b"\n" * (len(body) % 2)
    return out


def test_packages_are_unpacked_safely(spark, tmp_path):
    (tmp_path / "debs").mkdir()
    (tmp_path / "debs/x.deb").write_bytes(deb([("./usr/lib/libx.so.1", b"\x7fELF..."), ("./usr/include/x.h", b"int x;"), ("../escape.txt", b"no"), ("/abs/escape.txt", b"no")]))
    files = archive.read_packages(spark, f"{tmp_path}/debs")
    assert sorted(r["path"] for r in files.collect()) == ["usr/include/x.h", "usr/lib/libx.so.1"]
    assert [r["path"] for r in archive.shared_objects(files).collect()] == ["usr/lib/libx.so.1"]
    assert [r["path"] for r in archive.headers(files).collect()] == ["usr/include/x.h"]
    with pytest.raises(ValueError, match="ar archive"):
        list(archive.deb_members(b"junk"))


def test_a_bad_package_does_not_fail_the_others(spark, tmp_path):
    good = deb([(f"./usr/lib/lib{k}.so", bytes([k]) * 5000) for k in range(9)])
    for name, raw in (("good", good), ("cut", good[:-150]), ("junk", b"junk")):
        (tmp_path / f"{name}.deb").write_bytes(raw)
    got = archive.read_packages(spark, f"{tmp_path}/*.deb", errors=True).collect()
    name = lambda r: r["package"].rsplit("/", 1)[-1].removesuffix(".deb")
    assert {name(r) for r in got if r["error"]} == {"cut", "junk"}
    assert sum(name(r) == "good" for r in got) == 9
    assert {name(r) for r in archive.read_packages(spark, f"{tmp_path}/*.deb").collect()} <= {"good", "cut"}


def test_compressed_text_and_preferences(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.gz").write_bytes(gzip.compress(b"one"))
    (tmp_path / "t/b.xz").write_bytes(lzma.compress(b"two"))
    (tmp_path / "t/c").write_bytes(b"three")
    assert sorted(r["text"] for r in archive.read_compressed_text(spark, f"{tmp_path}/t").collect()) == ["one", "three", "two"]
    files = spark.createDataFrame([("x", "all", "h1"), ("x", "amd64", "h2"), ("y", "i386", "h3"), ("z", "all", "h4")], "name string, architecture string, hash string")
    assert sorted((r["name"], r["hash"]) for r in archive.preferred_files(files, ["name"]).collect()) == [("x", "h2"), ("z", "h4")]


def test_page_and_command_line(spark, folder, capsys):
    import driftlens.__main__ as command

    (folder / "t.html").write_text("<p>{{breaking}} of {{transitions}} in {{unknown}}</p><table>{{verdicts}}{{rescue}}</table><ul>{{unstable}}</ul>")
    s = study.analyse(study.from_artifacts(spark, f"{folder}/pairs", f"{folder}/headers"))
    page = rendering.page(s, (folder / "t.html").read_text())
    assert "<p>2 of 4 in {{unknown}}</p>" in page and "Opaque struct layout" in page and "<li>a: 2 of 2</li>" in page
    assert page.count("<tr>") == 4 + 12
    with pytest.raises(SystemExit) as e:
        command.main(["nonsense"])
    assert e.value.code == 2


def test_elf_symbols(spark):
    from pathlib import Path

    from driftlens.sources import elf

    found = sorted(Path("/").glob("lib*/*-linux-gnu/libc.so.6"))
    if not found:
        pytest.skip("no C library to read")
    files = spark.createDataFrame([("p", "lib/libc.so.6", found[0].read_bytes()), ("p", "x.h", b"int"), ("p", "none", None)], "package string, path string, content binary")
    got = {r["linkage"]: r for r in elf.exported_symbols(files).collect()}
    assert {r["soname"] for r in got.values()} == {"libc.so.6"} and len(got) > 1000
    assert got["printf"]["is_function"] and got["printf"]["version"].startswith("GLIBC_")
    assert not got["environ"]["is_function"] if "environ" in got else True
    assert any(r["version"] == "GLIBC_PRIVATE" for r in got.values())
    with pytest.raises(ValueError, match="not an ELF"):
        elf.read(b"junk")
    raw = found[0].read_bytes()
    odd = spark.createDataFrame([("p", "good", raw), ("p", "cut", raw[:5000]), ("p", "head", raw[:20]), ("p", "text", b"int x;")], "package string, path string, content binary")
    assert {r["path"] for r in elf.exported_symbols(odd).select("path").distinct().collect()} == {"good"}
    assert {r["path"] for r in elf.unreadable(odd).collect()} == {"cut", "head"}


def test_compressed_package_indexes(spark, tmp_path):
    text = b"Package: a\nDepends: libc6\n\nPackage: b\nVersion: 1\n"
    (tmp_path / "Packages.xz").write_bytes(lzma.compress(text))
    (tmp_path / "Packages.gz").write_bytes(gzip.compress(text))
    for name in ("Packages.xz", "Packages.gz"):
        assert sorted(map(tuple, archive.read_depends(spark, str(tmp_path / name)).collect())) == [("a", "libc6"), ("b", "")]


def test_saved_answers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"package": "a", "result": [{"version": "1:2.0-1", "extra": 1}, {"version": ":bad"}]}))
    (tmp_path / "b.json").write_text("not json")
    answers = archive.read_answers(spark, str(tmp_path), "versions")
    assert sorted((r["place"], r["version"]) for r in answers.collect()) == [(0, "1:2.0-1"), (1, ":bad")]
    assert [r["version"] for r in archive.source_versions(answers).collect()] == ["1:2.0-1"]
    (tmp_path / "c.json").write_text(json.dumps({"result": [{"version": "2"}, {"source": "old", "version": "1"}]}))
    origin = archive.read_answers(spark, str(tmp_path / "c.json"), "origin").selectExpr("'libx' as binary", "place", "source", "version")
    assert [tuple(r) for r in archive.newest_origin(origin, "binary").collect()] == [("libx", "libx", "2")]


def test_summary_artifact(spark, folder, tmp_path):
    s = study.analyse(study.from_artifacts(spark, f"{folder}/pairs", f"{folder}/headers"))
    artifacts.write_artifact(study.summary_row(s), str(tmp_path / "summary"), "summary")
    row = artifacts.read_artifacts(spark, str(tmp_path / "summary"), "summary").first()
    assert tuple(row["corpus"]) == (3, 2, 1)
    assert row["filtered"] == {"third_party": 3, "private_node": 7}
    assert row["frequency"]["all"]["n"] == 3 and row["frequency"]["cxx"]["n"] == 1 and row["frequency"]["c"]["libraries"] == 2
    assert set(row["rescue"]) == {"binary", "evolution", "inline"} and len(row["rescue"]["inline"]["mechanisms"]) == 4
    text = rendering.text_report(s)
    assert "headers 3, symbols of private version nodes 7" in text
    assert any(x.startswith("vtable_changed") and " 100.0%" in x and "absorbed" in x for x in text.split("== changes, cxx")[1].splitlines())
