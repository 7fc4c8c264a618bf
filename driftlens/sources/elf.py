"""Facts of ELF files by the public specification: soname and exported dynamic symbols.

This gives names, kinds and version nodes, not types: those are in debug
information, which isn't read here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the ELF specification.
SHT_STRTAB, SHT_DYNAMIC, SHT_DYNSYM, SHT_GNU_VERDEF, SHT_GNU_VERSYM = 3, 6, 11, 0x6FFFFFFD, 0x6FFFFFFF
DT_SONAME, STT_OBJECT, STT_FUNC, STT_GNU_IFUNC = 14, 1, 2, 10
STB_LOCAL, SHN_UNDEF, HIDDEN_VERSION = 0, 0, 0x8000


def _text(raw: bytes, at: int) -> str:
    return raw[at : raw.index(b"\0", at)].decode("utf-8", "replace")


def read(raw: bytes) -> tuple[str | None, list[tuple[str, str | None, bool]]]:
    """(soname, [(name, version node, is a function)]) of a 32- or 64-bit file of either byte order."""
    if raw[:4] != b"\x7fELF":
        raise ValueError("not an ELF file")
    wide, order = raw[4] == 2, "<" if raw[5] == 1 else ">"
    unpack = lambda f, at: struct.unpack_from(order + f, raw, at)
    table = unpack("Q", 40)[0] if wide else unpack("I", 32)[0]
    entry, count = unpack("HH", 58 if wide else 46)
    sections = []
    for k in range(count):
        f = unpack("IIQQQQIIQQ" if wide else "IIIIIIIIII", table + k * entry)
        sections.append({"type": f[1], "at": f[4], "size": f[5], "link": f[6], "info": f[7], "entry": f[9]})
    of = {s["type"]: s for s in sections}
    strings = lambda s: sections[s["link"]]["at"]

    soname = None
    if s := of.get(SHT_DYNAMIC):
        for at in range(s["at"], s["at"] + s["size"], 16 if wide else 8):
            tag, value = unpack("QQ" if wide else "II", at)
            if tag == DT_SONAME:
                soname = _text(raw, strings(s) + value)
    nodes: dict[int, str] = {}
    if s := of.get(SHT_GNU_VERDEF):
        at = s["at"]
        for _ in range(s["info"]):
            _, _, index, _, _, aux, following = unpack("HHHHIII", at)
            nodes[index] = _text(raw, strings(s) + unpack("I", at + aux)[0])
            at += following
    out = []
    if s := of.get(SHT_DYNSYM):
        versions = of.get(SHT_GNU_VERSYM)
        for k in range(1, s["size"] // s["entry"]):
            at = s["at"] + k * s["entry"]
            name, info, section = (lambda f: (f[0], f[1], f[3]))(unpack("IBBHQQ", at)) if wide else (lambda f: (f[0], f[3], f[5]))(unpack("IIIBBH", at))
            if section == SHN_UNDEF or info >> 4 == STB_LOCAL or info & 15 not in (STT_OBJECT, STT_FUNC, STT_GNU_IFUNC):
                continue
            index = unpack("H", versions["at"] + 2 * k)[0] & ~HIDDEN_VERSION if versions else 0
            out.append((_text(raw, strings(s) + name), nodes.get(index) if index > 1 else None, info & 15 != STT_OBJECT))
    return soname, out


def _parsed(raw: bytes):
    """read(), or the reason why it can't: a file that is cut short or odd concerns itself only."""
    try:
        return read(raw), None
    except (struct.error, ValueError, IndexError, KeyError, ZeroDivisionError) as e:
        return None, f"{type(e).__name__}: {e}"


def unreadable(files: DataFrame) -> DataFrame:
    """package, path, error of the ELF files that exported_symbols() has to leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for package, path, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                error = _parsed(raw)[1] if raw and raw[:4] == b"\x7fELF" else None
                if error:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (package, path, error)], names=["package", "path", "error"])

    return files.select("package", "path", "content").mapInArrow(run, "package string, path string, error string")


def exported_symbols(files: DataFrame) -> DataFrame:
    """package, path, soname, linkage, version, is_function from package, path, content.

    Other files than ELF give no rows, nor do those that unreadable() reports.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for package, path, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not raw or raw[:4] != b"\x7fELF":
                    continue
                soname, found = _parsed(raw)[0] or (None, [])
                if found:
                    n = len(found)
                    names, versions, functions = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([package] * n, pa.string()), pa.array([path] * n, pa.string()), pa.array([soname] * n, pa.string()), pa.array(names, pa.string()), pa.array(versions, pa.string()), pa.array(functions, pa.bool_())], names=["package", "path", "soname", "linkage", "version", "is_function"])

    return files.select("package", "path", "content").mapInArrow(run, "package string, path string, soname string, linkage string, version string, is_function boolean")
