"""What changed between two releases: full outer joins of their facts, then rules.

Facts carry the pair and the side they belong to, so that one join covers all
pairs at once, hashed by pair and key; nothing is compared pair by pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import scalars


def outer(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], together: bool = False) -> DataFrame:
    """keys, old and new (struct of values, null where the side lacks the key); each side has a key once.

    together: both sides are partitioned alike by some of the keys, so they are grouped where they lie.
    """
    side = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    if not together:
        return side(old, "old").join(side(new, "new"), keys, "full_outer")
    # a null key equals nothing in a join, so such rows are groups of their own
    alone = F.when(F.concat(*[F.col(k).isNull().cast("string") for k in keys]).contains("true"), F.monotonically_increasing_id())
    both = side(old, "v").withColumn("n", F.lit(1)).unionByName(side(new, "v").withColumn("n", F.lit(2))).withColumn("alone", alone)
    of = lambda n: F.max(F.when(F.col("n") == n, F.col("v"))).alias(("old", "new")[n - 1])
    return both.groupBy(*keys, "alone").agg(of(1), of(2)).drop("alone")


def compared(sides: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """outer() for both sides in one table, told apart by the column side (1 or 2): one shuffle of the facts by the first key, no join."""
    of = lambda n: F.max(F.when(F.col("side") == n, F.struct(*values))).alias(("old", "new")[n - 1])
    return sides.repartition(keys[0]).groupBy(*keys).agg(of(1), of(2))


def set_changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], added: str | None, removed: str | None, changed: dict[str, Column] | None = None, together: bool = False) -> DataFrame:
    """keys and kind, a row for each change. changed gives kinds by conditions over old.* and new.*."""
    both = outer(old, new, keys, values, together)
    kinds = [F.when(F.col("old").isNull(), F.lit(added)), F.when(F.col("new").isNull(), F.lit(removed))]
    kinds += [F.when(F.col("old").isNotNull() & F.col("new").isNotNull() & c, F.lit(k)) for k, c in (changed or {}).items()]
    return both.select(*keys, F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


def differs(name: str) -> Column:
    return ~F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}"))


def members(old: DataFrame, new: DataFrame, keys: list[str], together: bool = False) -> DataFrame:
    """Data members by name: added, removed, of another type, at another offset."""
    peeled = lambda df: df.withColumn("type_name", scalars.strip_cv("type_name"))
    return set_changes(peeled(old), peeled(new), [*keys, "type_id", "name"], ["type_name", "offset_bits"], "field_added_to_struct", "field_removed_from_struct", {"field_type_changed": differs("type_name"), "member_offset_changed": differs("offset_bits")}, together)


def sizes(old: DataFrame, new: DataFrame, keys: list[str], together: bool = False) -> DataFrame:
    """Types on both sides whose size differs; types that only one side has are no change of layout."""
    return set_changes(old, new, [*keys, "type_id"], ["size_bits"], None, None, {"type_size_changed": differs("size_bits")}, together)


def bases(old: DataFrame, new: DataFrame, keys: list[str], together: bool = False) -> DataFrame:
    return set_changes(old, new, [*keys, "type_id", "base"], ["type_id"], "base_class_changed", "base_class_changed", None, together)


def enumerators(old: DataFrame, new: DataFrame, keys: list[str], together: bool = False) -> DataFrame:
    return set_changes(old, new, [*keys, "type_id", "name"], ["value"], "enum_case_added", "enum_case_removed", None, together)


def vtables(old: DataFrame, new: DataFrame, keys: list[str], together: bool = False) -> DataFrame:
    """One change for each virtual method that comes, goes or moves, and one where a class gains or loses its table."""
    virtual = lambda df: df.where("is_virtual")
    methods = set_changes(virtual(old), virtual(new), [*keys, "type_id", "method"], ["slot"], "vtable_changed", "vtable_changed", {"vtable_changed": differs("slot")}, together)
    has = lambda df: df.groupBy(*keys, "type_id").agg(F.bool_or("is_virtual").alias("virtual"))
    tables = set_changes(has(old), has(new), [*keys, "type_id"], ["virtual"], None, None, {"vtable_changed": differs("virtual")}, together)
    return methods.select(*keys, "type_id", "kind").unionByName(tables)


def on_both_sides(changes: DataFrame, old_types: DataFrame, new_types: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of types that both releases have."""
    at = [*keys, "type_id"]
    return changes.join(old_types.select(*at).distinct(), at, "left_semi").join(new_types.select(*at).distinct(), at, "left_semi")


def attributed(changes: DataFrame, types: DataFrame, own_headers: DataFrame, keys: list[str]) -> DataFrame:
    """changes with third_party: declared in a header that isn't the library's own.

    Headers are told by base name. An unknown header, or a library without any
    known ones, counts as own.
    """
    at = [*keys, "type_id"]
    declared = types.groupBy(*at).agg(F.min("declared_in").alias("declared_in"))
    named = changes.join(declared, at, "left").withColumn("basename", F.substring_index("declared_in", "/", -1))
    own = own_headers.select(*keys, "basename").distinct().withColumn("_own", F.lit(True))
    any_ = own_headers.select(*keys).distinct().withColumn("_any", F.lit(True))
    out = named.join(own, [*keys, "basename"], "left").join(any_, keys, "left")
    third = F.col("_any").isNotNull() & F.col("basename").isNotNull() & (F.col("basename") != "") & F.col("_own").isNull()
    return out.withColumn("third_party", third).drop("basename", "_own", "_any", "declared_in")


#: Kinds of changes of types, as layout_counts() and placed() have them for columns.
LAYOUT_KINDS = ("field_added_to_struct", "field_removed_from_struct", "field_type_changed", "member_offset_changed", "type_size_changed", "base_class_changed", "enum_case_added", "enum_case_removed", "vtable_changed")


def met(old: DataFrame, new: DataFrame, keys: list[str], numbers: list[str], text: str | None = None) -> DataFrame:
    """keys, in_1 and in_2 (null where a side lacks the key), each number on both sides, and same_text (null if it differs).

    The same comparison as outer(), for tables that are partitioned alike by some of the keys. Buffers of these
    groups are of fixed width, so rows are hashed where those of outer() are sorted; numbers are columns of such types.
    """
    alone = F.when(_any_null(keys), F.monotonically_increasing_id())
    side = lambda df, n: df.select(*keys, *numbers, *([text] if text else []), F.lit(n).alias("side"))
    rows = side(old, 1).unionByName(side(new, 2)).withColumn("alone", alone)
    given = {"in": F.lit(1)} | {c: F.col(c) for c in numbers}
    found = {f"{c}_{n}": F.max(F.when(F.col("side") == n, v)) for c, v in given.items() for n in (1, 2)}
    both = rows.groupBy(*keys, "alone", *([text] if text else [])).agg(*[v.alias(c) for c, v in found.items()])
    if text:
        both = both.groupBy(*keys, "alone").agg(*[F.max(c).alias(c) for c in found], F.max(F.col("in_1") + F.col("in_2")).alias("same_text"))
    return both.drop("alone")


def _any_null(keys: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])


def layout_counts(old: dict[str, DataFrame], new: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys, type_id and a count for each of LAYOUT_KINDS but sizes: what members(), bases(), enumerators() and vtables() find.

    Facts are partitioned alike by some of keys; a side may repeat a base. Those of types with a null in keys or type_id are left out.
    """
    at = [*keys, "type_id"]
    known = lambda name: (side[name].where(~_any_null(at)) for side in (old, new))
    lacks = lambda name: F.col(f"{name}_1").isNull() != F.col(f"{name}_2").isNull()
    moved = lambda name: ~F.col(f"{name}_1").eqNullSafe(F.col(f"{name}_2"))
    two = F.col("in_1").isNotNull() & F.col("in_2").isNotNull()

    peeled = [df.withColumn("type_name", scalars.strip_cv("type_name")) for df in known("members")]
    virtual = [df.withColumn("slot", F.when(F.col("is_virtual"), F.col("slot"))).withColumn("virtual", F.when(F.col("is_virtual"), 1)) for df in known("vslots")]
    rows = [
        (met(*peeled, [*at, "name"], ["offset_bits"], "type_name"), {"field_added_to_struct": F.col("in_1").isNull(), "field_removed_from_struct": F.col("in_2").isNull(), "field_type_changed": two & F.col("same_text").isNull(), "member_offset_changed": two & moved("offset_bits")}),
        (met(*known("bases"), [*at, "base"], []), {"base_class_changed": lacks("in")}),
        (met(*known("enumerators"), [*at, "name"], []), {"enum_case_added": F.col("in_1").isNull(), "enum_case_removed": F.col("in_2").isNull()}),
        (met(*virtual, [*at, "method"], ["slot", "virtual", "is_virtual"]), {"vtable_changed": lacks("virtual") | (F.col("virtual_1").isNotNull() & F.col("virtual_2").isNotNull() & moved("slot"))}),
    ]
    tables = ["in_1", "in_2", "is_virtual_1", "is_virtual_2"]
    counts = None
    for both, kinds in rows:
        # what hasn't changed counts nothing; slots also say whether a class has a table
        both = both if "vtable_changed" in kinds else both.where(reduce(lambda x, y: x | y, kinds.values()))
        part = both.select(*at, *[c.cast("int").alias(k) for k, c in kinds.items()], *(tables if "vtable_changed" in kinds else []))
        counts = part if counts is None else counts.unionByName(part, allowMissingColumns=True)
    kinds = [k for k in LAYOUT_KINDS if k != "type_size_changed"]
    counts = counts.groupBy(*at).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in kinds], *[F.max(c).alias(c) for c in tables])
    # a class that gains or loses its table
    gained = F.coalesce((two & moved("is_virtual")).cast("int"), F.lit(0))
    return counts.withColumn("vtable_changed", F.col("vtable_changed") + gained).drop(*tables)


def placed(counts: DataFrame, old_types: DataFrame, new_types: DataFrame, own_headers: DataFrame, keys: list[str]) -> DataFrame:
    """attributed(on_both_sides()) as counts: keys, kind, third_party and n of layout_counts() and of sizes().

    Changes, types and headers meet in groups, which shuffle nothing where the tables are partitioned alike by keys.
    """
    at = [*keys, "type_id"]
    rows = counts
    for n, t in enumerate((old_types, new_types), 1):
        rows = rows.unionByName(t.where(~_any_null(at)).select(*at, "declared_in", F.lit(1).alias(f"in_{n}"), F.col("size_bits").alias(f"size_{n}")), allowMissingColumns=True)
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0))
    once = [F.max(c).alias(c) for c in ("in_1", "in_2", "size_1", "size_2")]
    rows = rows.groupBy(*at).agg(F.min("declared_in").alias("declared_in"), *once, *[sums(k).alias(k) for k in LAYOUT_KINDS if k != "type_size_changed"])
    rows = rows.where("in_1 is not null and in_2 is not null").withColumn("type_size_changed", (~F.col("size_1").eqNullSafe(F.col("size_2"))).cast("bigint"))
    rows = rows.select(*keys, F.substring_index("declared_in", "/", -1).alias("basename"), *LAYOUT_KINDS)
    rows = rows.unionByName(own_headers.select(*keys, "basename", F.lit(1).alias("own")), allowMissingColumns=True)
    rows = rows.groupBy(*keys, "basename").agg(F.max("own").alias("own"), *[F.sum(k).alias(k) for k in LAYOUT_KINDS])
    foreign = F.col("own").isNull() & F.col("basename").isNotNull() & (F.col("basename") != "")
    split = [sums(F.when(foreign == third, F.col(k))).alias(f"{k}_{third}") for k in LAYOUT_KINDS for third in (False, True)]
    rows = rows.groupBy(*keys).agg(F.max("own").alias("own"), *split)
    # without any headers known, all are the library's own
    known = F.col("own").isNotNull()
    n = lambda k, third: F.when(known, F.col(f"{k}_{third}")).otherwise(F.lit(0) if third else F.col(f"{k}_False") + F.col(f"{k}_True"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(third).alias("third_party"), n(k, third).alias("n")) for k in LAYOUT_KINDS for third in (False, True)]))
    return rows.select(*keys, each.alias("c")).select(*keys, "c.*").where("n > 0")


# Symbols


def only(left: DataFrame, right: DataFrame, keys: list[str], on: list[str] | None = None) -> DataFrame:
    at = [*keys, *(on or ["linkage"])]
    return left.join(right.select(*at).distinct(), at, "left_anti")


def renamed_counts(removed: DataFrame, added: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and renamed: matches one to one between names that are equal but for digits."""
    side = lambda df, n: df.groupBy(*keys, scalars.digits_blind(name).alias("blind")).agg(F.count("*").alias(n))
    both = side(removed, "_r").join(side(added, "_a"), [*keys, "blind"])
    return both.groupBy(*keys).agg(F.sum(F.least("_r", "_a")).alias("renamed"))


def matched(removed: DataFrame, added: DataFrame, keys: list[str], by: list[Column], order: list[str]) -> DataFrame:
    """Rows of removed and added matched one to one within equal keys and by, in order: columns r and a."""
    named = [c.alias(f"_by{k}") for k, c in enumerate(by)]
    at = [*keys, *(f"_by{k}" for k in range(len(by)))]

    def ranked(df: DataFrame, name: str) -> DataFrame:
        out = df.select(*keys, *named, F.struct(*df.columns).alias(name))
        return out.withColumn("_n", F.row_number().over(Window.partitionBy(*at).orderBy(*[F.col(f"{name}.{o}") for o in order])))

    return ranked(removed, "r").join(ranked(added, "a"), [*at, "_n"]).select(*keys, "r", "a")


def symbols(old: DataFrame, new: DataFrame, keys: list[str], mass_min: int = 50) -> tuple[DataFrame, DataFrame]:
    """Symbol changes (keys, kind, linkage, pretty, version, private), and per keys renamed, plain, mass_rename.

    Functions that were removed and added under one name with other text are
    changed signatures; pairs go by order of linkage. What is left and equal
    but for digits is renamed. The rest is plain. A symbol on both sides has
    changed if its result or parameters differ without const and volatile.
    """
    found = resolved_symbols(old, new, keys)
    kind = F.when(F.col("step").isin("paired", "changed"), "function_signature_changed").when(F.col("step") == "plain", F.when(F.col("side") == 1, "symbol_removed").otherwise("symbol_added"))
    events = found.withColumn("kind", kind).where("kind is not null").select(*keys, "kind", "linkage", "pretty", "version", scalars.is_private_node("version").alias("private"))
    tallies = found.where("step in ('renamed', 'plain')").groupBy(*keys).agg(F.count_if(F.col("step") == "renamed").alias("renamed"), F.count_if(F.col("step") == "plain").alias("plain"))
    return events, tallies.withColumn("mass_rename", (F.col("renamed") >= mass_min) & (F.col("renamed") >= F.col("plain")))


def symbol_counts(old: DataFrame, new: DataFrame, keys: list[str], together: bool = False) -> DataFrame:
    """keys, kind, private, n of symbols() in one pass; renames, which always count as public, are of kind symbol_version_renamed."""
    step, renamed = F.col("step"), F.col("step") == "renamed"
    kind = F.when(renamed, "symbol_version_renamed").when(step != "plain", "function_signature_changed").when(F.col("side") == 1, "symbol_removed").otherwise("symbol_added")
    found = resolved_symbols(old, new, keys, together).select(*keys, kind.alias("kind"), (~renamed & scalars.is_private_node("version")).alias("private"))
    return found.groupBy(*keys, "kind", "private").agg(F.count("*").alias("n"))


def resolved_symbols(old: DataFrame, new: DataFrame, keys: list[str], together: bool = False) -> DataFrame:
    """keys, linkage, pretty, version, side (1 removed, 2 added, 0 both) and step: how each symbol that differs is accounted for.

    paired and renamed are said of the removed symbol of a pair only. Facts meet
    in one join; what differs is ranked twice, once by name and once by linkage
    without digits, each within one partitioning; facts that lie together by keys stay there.
    """
    dealt = lambda df, *by: df if together else df.repartition(*by)
    old, new = (df.where(~scalars.is_compiler_symbol("linkage")) for df in (old, new))
    both = outer(old, new, [*keys, "linkage"], ["pairing", "pretty", "version", "is_function", "return_type", "params"], together)
    side = F.when(F.col("new").isNull(), 1).when(F.col("old").isNull(), 2).otherwise(0)
    changed = F.col("old.is_function") & F.col("new.is_function") & signature_differs(F.col("old.return_type"), F.col("new.return_type"), F.col("old.params"), F.col("new.params"))
    one = lambda c: F.coalesce(f"old.{c}", f"new.{c}").alias(c)
    differ = both.withColumn("side", side).where((F.col("side") > 0) | changed)
    differ = differ.select(*keys, "linkage", "side", one("pairing"), F.when(F.col("side") > 0, one("pretty")).otherwise(F.concat_ws("  ->  ", "old.pretty", "new.pretty")).alias("pretty"), one("version"), one("is_function"))

    # rows that can't have a partner are groups of their own, so none of them gathers
    named = F.when((F.col("side") > 0) & F.col("is_function"), F.concat(F.lit("f"), "pairing"))
    ranked = dealt(differ.withColumn("name", F.coalesce(named, F.concat(F.lit("x"), F.col("side").cast("string"), "linkage"))), *keys, "name")
    ranked = _placed_by_linkage(ranked, [*keys, "name"], lo=F.min("pretty"), hi=F.max("pretty"), texts=F.count("pretty"))
    crowded = (F.col("n_1") > 0) & (F.col("n_2") > 0) & (F.col("n_1") + F.col("n_2") > 2)
    # of two the texts are compared; where a text is on both sides of more, which is rare, the few overloads of the name are gone through one by one
    within = _by_linkage([*keys, "name"]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    text = lambda k: F.collect_list(F.when(crowded & (F.col("side") == k), F.struct("linkage", "pretty"))).over(within)
    ranked = ranked.withColumns({"rs": text(1), "as_": text(2)})
    bare = lambda c: F.transform(c, lambda x: F.coalesce(F.concat(F.lit("t"), x["pretty"]), F.lit("")))
    alike = F.col("lo").eqNullSafe(F.col("hi")) & (F.col("texts") != 1)
    ranked = ranked.withColumn("same", F.when(crowded, F.arrays_overlap(bare(F.col("rs")), bare(F.col("as_")))).otherwise((F.col("n_1") == 1) & (F.col("n_2") == 1) & alike))
    ranked = ranked.withColumn("taken", F.max(F.when(F.col("same") & crowded & (F.col("n") == 1) & (F.col("side") == 1), _greedy())).over(within))
    mine = F.get("taken", F.col("n") - 1)
    taken = F.when(F.col("side") == 1, mine >= 0).otherwise(F.array_contains("taken", F.col("n") - 1))
    ranked = ranked.withColumn("paired", F.when(~F.col("same"), F.col("n") <= F.least("n_1", "n_2")).when(crowded, taken).otherwise(F.lit(False)))
    mate = F.max(F.when(F.col("side") == 2, F.col("pretty"))).over(Window.partitionBy(*keys, "name", "n"))
    ranked = ranked.withColumn("mate", F.when(F.col("same"), F.get("as_", mine)["pretty"]).otherwise(mate))

    left = (F.col("side") > 0) & ~F.col("paired")
    blind = F.coalesce(F.when(left, F.concat(F.lit("b"), scalars.digits_blind("linkage"))), F.concat(F.lit("x"), F.col("side").cast("string"), "linkage"))
    again = dealt(ranked.select(*keys, "linkage", "side", "pretty", "version", "paired", "mate", blind.alias("blind")), *keys, "blind")
    again = _placed_by_linkage(again, [*keys, "blind"]).withColumn("renamed", F.col("n") <= F.least("n_1", "n_2"))
    first = F.col("side") == 1
    step = F.when(F.col("side") == 0, "changed").when(F.col("paired"), F.when(first, "paired")).when(F.col("renamed"), F.when(first, "renamed")).otherwise("plain")
    pretty = F.when(step == "paired", F.concat_ws("  ->  ", "pretty", "mate")).otherwise(F.col("pretty"))
    return again.withColumn("step", step).select(*keys, "linkage", pretty.alias("pretty"), "version", "side", "step").where("step is not null")


def _by_linkage(at: list[str]) -> Window:
    return Window.partitionBy(*at).orderBy("side", "linkage")


def _placed_by_linkage(df: DataFrame, at: list[str], **more: Column) -> DataFrame:
    """df with n_1 and n_2 (rows of each side within at), n (the row's place on its side) and more: all by one sort and one window."""
    whole = _by_linkage(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = {f"n_{k}": F.count_if(F.col("side") == k) for k in (1, 2)} | more
    out = df.withColumns({c: v.over(whole) for c, v in of.items()} | {"n": F.row_number().over(_by_linkage(at))})
    return out.withColumn("n", F.col("n") - F.when(F.col("side") == 2, F.col("n_1")).otherwise(0))


def _greedy() -> Column:
    """For each of rs the place of the first of as_ that is left and has another text, -1 for none."""
    first = lambda taken, r: F.coalesce(F.get(F.filter(F.sequence(F.lit(0), F.size("as_") - 1), lambda k: ~F.array_contains(taken, k) & (F.get("as_", k)["pretty"] != r["pretty"])), 0), F.lit(-1))
    return F.aggregate("rs", F.array().cast("array<int>"), lambda acc, r: F.array_append(acc, first(acc, r)))


def signature_differs(result_1: Column, result_2: Column, params_1: Column, params_2: Column) -> Column:
    peel = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), scalars.strip_cv)
    bare = lambda c: F.coalesce(scalars.strip_cv(c), F.lit(""))
    p1, p2 = peel(params_1), peel(params_2)
    return (bare(result_1) != bare(result_2)) | (F.size(p1) != F.size(p2)) | F.exists(F.zip_with(p1, p2, lambda x, y: ~x.eqNullSafe(y)), lambda d: d)


# Shared objects


def paired_objects(old: DataFrame, new: DataFrame, keys: list[str], largest: bool = False) -> DataFrame:
    """Objects of two releases by the stem of their name: keys, stem, old and new path, null where unpaired.

    Of several with one stem the first path counts, or with largest the largest file.
    """
    pick = (lambda p: F.max_by(p, "size")) if largest else (lambda p: F.min(p))
    side = lambda df, n: df.groupBy(*keys, scalars.soname_stem("path").alias("stem")).agg(pick(F.col("path")).alias(n))
    return side(old, "old_path").join(side(new, "new_path"), [*keys, "stem"], "full_outer")


def language_by_share(symbols_of: DataFrame, keys: list[str], least: float = 0.2, over: bool = False) -> DataFrame:
    """cxx if at least (or over) that share of exported functions has a mangled name, unknown without any."""
    mangled = F.count_if(F.col("linkage").startswith("_Z"))
    return symbols_of.where("is_function").groupBy(*keys).agg(F.count("*").alias("exported"), mangled.alias("mangled")).withColumn("language", F.when(F.col("exported") == 0, "unknown").when((F.col("mangled") > least * F.col("exported")) if over else (F.col("mangled") >= least * F.col("exported")), "cxx").otherwise("c"))
