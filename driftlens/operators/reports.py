"""Text reports of interface comparers: rules that tag lines, trees by indentation, and totals.

Also the lexical header scan, which over-counts by its nature: use it where no
parser's facts are at hand, and say so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import scalars

#: Fixed values: (tag, pattern, how it counts) in order of precedence. n: the first group's number; child: the node's children; 1: one.
RULES: Sequence[tuple[str, str, str]] = (
    ("struct_field_added", r"^(\d+) data member insertions?:?$", "n"),
    ("struct_field_added", r"^there are data member insertions?:?$", "child"),
    ("struct_field_removed", r"^(\d+) data member deletions?:?$", "n"),
    ("struct_field_removed", r"^there are data member deletions?:?$", "child"),
    ("struct_field_type_changed", r"^type of '[^']+' changed:?$", "1"),
    ("struct_field_type_changed", r"^type '[^']*' of '[^']+' changed:?$", "1"),
    ("enum_case_added", r"^(\d+) enumerator insertions?:?$", "n"),
    ("enum_case_added", r"^there are enumerator insertions?:?$", "child"),
    ("enum_case_removed", r"^(\d+) enumerator deletions?:?$", "n"),
    ("enum_case_removed", r"^there are enumerator deletions?:?$", "child"),
    ("enum_case_changed", r"^(\d+) enumerator changes?", "n"),
    ("base_class_added", r"^(\d+) base class insertions?:?$", "n"),
    ("base_class_removed", r"^(\d+) base class deletions?:?$", "n"),
    ("member_fn_added", r"^(\d+) member function insertions?:?$", "n"),
    ("member_fn_removed", r"^(\d+) member function deletions?:?$", "n"),
    ("vtable_entry_added", r"^note that this adds a new entry to the vtable of (?:class|struct) (.+)$", "1"),
    ("vtable_entry_removed", r"^note that this removes an entry from the vtable of (?:class|struct) (.+)$", "1"),
    ("vtable_created", r"^note that a vtable was added to (?:class|struct) (.+)$", "1"),
    ("vtable_removed", r"^note that the vtable of (?:class|struct) (.+) was removed", "1"),
    ("vtable_offset_changed", r"^the vtable offset of .+ changed from (\d+) to (\d+)$", "1"),
    ("fn_param_type_changed", r"^parameter \d+ of type '.+' (?:has sub-type )?changed:?$", "1"),
    ("fn_param_added", r"^parameter \d+ of type '.+' was added$", "1"),
    ("fn_param_removed", r"^parameter \d+ of type '.+' was removed$", "1"),
    ("fn_return_type_changed", r"^return type changed:?$", "1"),
    ("type_size_changed", r"^type size changed from (\d+) to (\d+) \(in bits\)$", "1"),
    ("type_alignment_changed", r"^type alignment changed from (\d+) to (\d+)$", "1"),
    ("member_offset_changed", r"^'.+' offset changed from (\d+) to (\d+) \(in bits\)", "1"),
    ("member_offset_changed", r"^and offset changed from (\d+) to (\d+) \(in bits\)", "1"),
    ("method_became_virtual", r"^method .+ is now declared virtual$", "1"),
)
#: Which tags make up a change kind.
HEADLINE = {
    "field_added_to_struct": ("struct_field_added",),
    "field_removed_from_struct": ("struct_field_removed",),
    "field_type_changed": ("struct_field_type_changed",),
    "enum_case_added": ("enum_case_added",),
    "enum_case_removed": ("enum_case_removed",),
    "function_signature_changed": ("fn_param_type_changed", "fn_param_added", "fn_param_removed", "fn_return_type_changed", "fn_signature_changed_via_mangling"),
    "vtable_changed": ("vtable_entry_added", "vtable_entry_removed", "vtable_created", "vtable_removed", "vtable_offset_changed", "method_became_virtual"),
    "base_class_changed": ("base_class_added", "base_class_removed"),
    "symbol_added": ("symbol_added",),
    "symbol_removed": ("symbol_removed",),
    "member_offset_changed": ("member_offset_changed",),
    "type_size_changed": ("type_size_changed",),
}
#: Tags that the report of leaf changes only leaves out.
LEAF_BLIND = ("base_class_added", "base_class_removed")


def first_match(df: DataFrame, text: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """df with tag and how of the first rule that the text matches, null if none does."""
    c = F.col(text)
    tag = how = None
    for name, pattern, count in rules:
        hit = c.rlike(pattern)
        tag = F.when(hit, name) if tag is None else tag.when(hit, name)
        how = F.when(hit, count) if how is None else how.when(hit, count)
    return df.withColumn("tag", tag).withColumn("how", how)


def nodes(reports: DataFrame, key: str, text: str) -> DataFrame:
    """key, line, depth, content, parent, top: the lines of whole reports as trees by their indentation.

    parent is the line of the nearest line before with less indentation, 0 for
    none; top the line of the outermost node above, or the node's own. Blank
    lines are no nodes. A report is one row, so trees stay within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, report in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                open_: list[tuple[int, int]] = []
                for n, raw in enumerate((report or "").split("\n"), 1):
                    if not raw.strip():
                        continue
                    indent = len(raw) - len(raw.lstrip(" "))
                    while open_ and open_[-1][0] >= indent:
                        open_.pop()
                    out.append((k, n, len(open_), raw.strip(), open_[-1][1] if open_ else 0, open_[0][1] if open_ else n))
                    open_.append((indent, n))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip((key, "line", "depth", "content", "parent", "top"), r, strict=True)) for r in out], schema=schema)

    kind = dict(reports.dtypes)[key]
    schema = pa.schema([(key, pa.int64() if kind in ("bigint", "int") else pa.string()), ("line", pa.int32()), ("depth", pa.int32()), ("content", pa.string()), ("parent", pa.int32()), ("top", pa.int32())])
    return reports.select(F.col(key).cast("bigint" if kind in ("bigint", "int") else "string").alias(key), text).mapInArrow(run, f"{key} {'bigint' if kind in ('bigint', 'int') else 'string'}, line int, depth int, content string, parent int, top int")


def tag_counts(tree: DataFrame, key: str, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """key, tag, n summed over the nodes of a report."""
    return _tagged(tree, key, rules).groupBy(key, "tag").agg(F.sum("n").alias("n")).where("n > 0")


def _tagged(tree: DataFrame, key: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """key, top, tag, n for each node that a rule matches."""
    children = tree.groupBy(key, F.col("parent").alias("line")).agg(F.count("*").alias("children"))
    tagged = first_match(tree, "content", rules).where("tag is not null").join(children, [key, "line"], "left")
    n = F.when(F.col("how") == "n", F.regexp_extract("content", r"^(\d+)", 1).try_cast("bigint")).when(F.col("how") == "child", F.coalesce("children", F.lit(0))).otherwise(1)
    return tagged.select(key, "top", "tag", n.alias("n"))


#: The header of a changed type's block, with and without its place.
_BLOCK = r"^'((?:struct|class|union|enum|typedef)[^']*?)(?: at [^']*)?' changed:$"
_BLOCK_PLACE = r"^'(?:struct|class|union|enum|typedef)[^']*? at ([^':]+):\d+:\d+' changed:$"
SUMMARY = {
    "leaf_artifacts": r"^Leaf changes summary: (\d+) artifacts? changed",
    "leaf_types": r"^Changed leaf types summary: (\d+) .*leaf type",
    "fn_removed": r"functions summary: (\d+) Removed",
    "fn_changed": r"functions summary: \d+ Removed, (\d+) Changed",
    "fn_added": r"functions summary: \d+ Removed, \d+ Changed, (\d+) Added",
}


def summaries(tree: DataFrame, key: str, first: int = 8) -> DataFrame:
    """key and the figures of a report's summary, from its first lines; null where it has none."""
    found = [F.max(F.when(F.col("content").rlike(p), F.regexp_extract("content", p, 1).try_cast("int"))).alias(n) for n, p in SUMMARY.items()]
    return tree.where(F.col("line") <= first).groupBy(key).agg(*found)


def scoped_counts(tree: DataFrame, key: str, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """key, type, file, tag, n: counts within each changed type's block; type is null for what is in none."""
    heads = tree.where((F.col("depth") == 0) & F.col("content").rlike(_BLOCK))
    heads = heads.select(key, F.col("line").alias("top"), F.regexp_extract("content", _BLOCK, 1).alias("type"), F.nullif(F.regexp_extract("content", _BLOCK_PLACE, 1), F.lit("")).alias("file"))
    tagged = _tagged(tree, key, rules).join(heads, [key, "top"], "left")
    return tagged.groupBy(key, "type", "file", "tag").agg(F.sum("n").alias("n")).where("n > 0")


def own_and_third(scoped: DataFrame, own_headers: DataFrame, key: str) -> DataFrame:
    """scoped counts with third_party by the base name of the type's file; unknown files, and reports without own headers, are own."""
    own = own_headers.select(key, F.col("basename").alias("_base")).distinct().withColumn("_own", F.lit(True))
    any_ = own_headers.select(key).distinct().withColumn("_any", F.lit(True))
    out = scoped.withColumn("_base", F.substring_index("file", "/", -1)).join(own, [key, "_base"], "left").join(any_, key, "left")
    return out.withColumn("third_party", F.col("_any").isNotNull() & F.col("file").isNotNull() & F.col("_own").isNull()).drop("_base", "_own", "_any")


def merged(leaf: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """Counts of the leaf report, with what it leaves out taken from the full one where that has more."""
    other = full.where(F.col("tag").isin(*LEAF_BLIND))
    return leaf.unionByName(other).groupBy(key, "tag").agg(F.max("n").alias("n"))


def headline(tags: DataFrame, key: str) -> DataFrame:
    """key, kind, n: tags summed to change kinds; tags of no kind go."""
    spark = tags.sparkSession
    of = F.broadcast(spark.createDataFrame([(t, k) for k, ts in HEADLINE.items() for t in ts], "tag string, kind string"))
    return tags.join(of, "tag").groupBy(key, "kind").agg(F.sum("n").alias("n"))


#: An entry of a report, and a symbol in a private version node.
_ENTRY = r"^\[(A|D|C)\] '(\w[\w ]*?) (.+?)'(?:\s+\{(.+?)\})?(?: at .*)?$"

_PRIVATE = r"(?i)@@?[A-Za-z0-9_.]*(?:PRIVATE|INTERNAL)"


def entries(tree: DataFrame, key: str) -> DataFrame:
    """key, line, change (A, D or C), what, name, symbol, private: the entries of a report."""
    part = lambda k: F.regexp_extract("content", _ENTRY, k)
    private = F.col("content").rlike(_PRIVATE)
    out = tree.where(F.col("content").rlike(_ENTRY))
    return out.select(key, "line", part(1).alias("change"), part(2).alias("what"), part(3).alias("name"), F.nullif(part(4), F.lit("")).alias("symbol"), private.alias("private"))


def rename_first(removed: DataFrame, added: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """The older matching order, per keys: renamed (digits-blind), then signatures (by base name, one each), then plain."""
    from .changes import matched, only

    renames = matched(removed, added, keys, [scalars.digits_blind(name)], [name])
    left_r = only(removed, renames.select(*keys, F.col(f"r.{name}").alias(name)), keys, [name])
    left_a = only(added, renames.select(*keys, F.col(f"a.{name}").alias(name)), keys, [name])
    first = lambda df, n: df.groupBy(*keys, scalars.base_name(name).alias("base")).agg(F.count("*").alias(n))
    bases = first(left_r, "r").join(first(left_a, "a"), [*keys, "base"], "full_outer")
    both = F.col("r").isNotNull() & F.col("a").isNotNull()
    rest = bases.groupBy(*keys).agg(F.count_if(both).alias("signatures"), F.sum(F.coalesce("r", F.lit(0)) - both.cast("int")).alias("removed"), F.sum(F.coalesce("a", F.lit(0)) - both.cast("int")).alias("added"))
    return renames.groupBy(*keys).agg(F.count("*").alias("renamed")).join(rest, keys, "full_outer").fillna(0)


def declared(entries_: DataFrame, names: DataFrame, least: int = 5) -> DataFrame:
    """entries with public: declared in the library's headers, by name, base name or symbol; null with fewer than least names."""
    known = names.select("name").distinct()
    enough = known.count() >= least
    if not enough:
        return entries_.withColumn("public", F.lit(None).cast("boolean"))
    ways = entries_.select("*", F.explode(F.array_distinct(F.array("name", scalars.base_name("name"), F.element_at(F.split(scalars.base_name("name"), "::"), -1), F.coalesce(F.substring_index("symbol", "@", 1), "name")))).alias("_way"))
    hits = ways.join(known.withColumnRenamed("name", "_way").withColumn("_hit", F.lit(True)), "_way", "left")
    return hits.groupBy(*entries_.columns).agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("public"))


# The approximate header scan

_COMMENT = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?\*/', re.S)
_HEAD = re.compile(r"(?<![\w:])([A-Za-z_][\w:~]*+)\s*+\(")
_MACRO = re.compile(r"^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*)(?!\()[ \t]+(\S[^\n]*)$", re.M)
_NOT_NAMES = frozenset("if for while switch catch return sizeof defined alignas alignof decltype noexcept static_assert".split())


def scan_header(text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(name(parameters), body) of what looks like a function body, and (name, value) of macros."""
    text = _COMMENT.sub(lambda m: m[0] if m[0][0] in "\"'" else " ", text.replace("\\\n", " "))
    macros = [(n, " ".join(v.split())) for n, v in _MACRO.findall(text) if not n.startswith("_") and not n.endswith("_H")]
    code, bodies, at = re.sub(r"(?m)^[ \t]*#.*$", "", text), [], 0
    closing = _closings(code)
    while m := _HEAD.search(code, at):
        close = closing.get(m.end() - 1, -1)
        at = m.end()
        if close < 0 or m[1] in _NOT_NAMES:
            continue
        rest = re.compile(r"\s*(?:const|noexcept|override|final|&&?|->\s*[\w:<>*& ]+|:\s*\w+\s*\([^{};]*\)(?:\s*,\s*\w+\s*\([^{};]*\))*|\s)*\{").match(code, close + 1)
        if rest:
            end = closing.get(rest.end() - 1, -1)
            if end > 0:
                bodies.append((f"{m[1]}({' '.join(code[m.end() : close].split())})", " ".join(code[rest.end() : end].split())))
                at = end
    return bodies, macros


def _closings(text: str) -> dict[int, int]:
    """Where each parenthesis and brace that is closed closes, each kind by itself, in one pass."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {")": [], "}": []}
    for m in re.finditer(r"[(){}]", text):
        c = m[0]
        if c in "({":
            open_[")" if c == "(" else "}"].append(m.start())
        elif open_[c]:
            out[open_[c].pop()] = m.start()
    return out


def approximate_index(headers: DataFrame) -> DataFrame:
    """release, what (body or macro), key, fp from release, path, content, by scan_header()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for release, path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bodies, macros = scan_header(content or "")
                rows += [{"release": release, "what": w, "key": f"{path}::{n}", "value": v} for w, found in (("body", bodies), ("macro", macros)) for n, v in found]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(k, pa.string()) for k in ("release", "what", "key", "value")]))

    made = headers.select("release", "path", "content").mapInArrow(run, "release string, what string, key string, value string")
    return made.groupBy("release", "what", "key").agg(scalars.fingerprint(F.min("value")).alias("fp"))
