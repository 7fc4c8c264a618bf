"""Aggregates over transitions and their changes.

Counts are in long form: one row (transition, kind, n) with n > 0. A kind that a
transition lacks has no row, so prevalence is a plain count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import scalars, taxonomy


def long_counts(df: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """Maps of kind and count summed by keys and kind; zeros go."""
    return df.select(*keys, F.explode(counts).alias("kind", "n")).groupBy(*keys, "kind").agg(F.sum("n").alias("n")).where("n > 0")


def counted(changes: DataFrame, keys: list[str]) -> DataFrame:
    return changes.groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def as_map(long: DataFrame, keys: list[str], name: str = "counts") -> DataFrame:
    """Back to one map for each of keys; at most fifteen kinds each."""
    return long.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias(name))


def language_of(language: Column) -> Column:
    """Of a transition's objects: cxx if any is, else c if any is."""
    return F.when(F.bool_or(language == "cxx"), "cxx").when(F.bool_or(language == "c"), "c").otherwise("unknown")


def rollup(objects: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each transition from its objects (language, soname_1/2, debug_1/2, mass_rename)."""
    return objects.groupBy(*keys).agg(
        F.count("*").alias("objects"),
        language_of(F.col("language")).alias("language"),
        F.bool_or(F.col("soname_1") != F.col("soname_2")).alias("soname_changed"),
        F.bool_or(~F.col("debug_1") | ~F.col("debug_2")).alias("debug_info_missing"),
        F.bool_or("mass_rename").alias("mass_rename"),
    )


def _stats() -> list[Column]:
    return [F.count("*").alias("transitions"), F.sum("n").alias("events"), F.median("n").alias("median"), F.max("n").alias("most")]


def frequency(long: DataFrame, dim: DataFrame) -> DataFrame:
    """For each kind that occurs: transitions, events, median and maximum, in the taxonomy's order column."""
    return long.groupBy("kind").agg(*_stats()).join(dim.select("kind", "ord", "grp"), "kind")


def frequency_by(long: DataFrame, dim: DataFrame, by: str, total: str = "all") -> DataFrame:
    """frequency() over all and by one column, in a single pass of grouping sets."""
    sets = long.groupingSets([["kind"], ["kind", by]], "kind", by)
    out = sets.agg(*_stats(), F.grouping(by).alias("_all"))
    out = out.withColumn(by, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(by))).drop("_all")
    return out.join(dim.select("kind", "ord", "grp"), "kind")


def breaks(transitions: DataFrame, long: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """One row: transitions that break the binary interface, with and without a new soname."""
    breaking = long.join(dim.where("binary").select("kind"), "kind", "left_semi").select(key).distinct().withColumn("_b", F.lit(True))
    b = F.coalesce("_b", F.lit(False))
    out = transitions.join(breaking, key, "left")
    return out.agg(F.count("*").alias("n"), F.count_if(b).alias("breaking"), F.count_if(b & F.col("soname_changed")).alias("declared"), F.count_if(b & ~F.col("soname_changed")).alias("silent"), F.count_if(~b & F.col("soname_changed")).alias("soname_only"))


def rescued(long: DataFrame, dim: DataFrame, framing: str, key: str) -> DataFrame:
    """For each affected transition: fully (all its relevant changes are absorbed) and its mechanisms."""
    relevant = long.join(dim.where(F.col(framing)).select("kind", "mechanism", "absorbed"), "kind")
    return relevant.groupBy(key).agg(F.bool_and("absorbed").alias("fully"), F.collect_set("mechanism").alias("mechanisms"))


def rescue(long: DataFrame, dim: DataFrame, framing: str, key: str) -> DataFrame:
    """For each mechanism: affected and fully rescued transitions, those that need it, those that need only it."""
    per = rescued(long, dim, framing, key)
    flags = [(F.count_if(F.col("fully") & F.array_contains("mechanisms", m)).alias(f"n{i}"), F.count_if(F.col("fully") & (F.size("mechanisms") == 1) & F.array_contains("mechanisms", m)).alias(f"s{i}")) for i, m in enumerate(taxonomy.MECHANISMS)]
    one = per.agg(F.count("*").alias("affected"), F.count_if("fully").alias("fully_rescued"), *[c for pair in flags for c in pair])
    rows = F.array(*[F.struct(F.lit(m).alias("mechanism"), F.col(f"n{i}").alias("needed_by"), F.col(f"s{i}").alias("sole_reason")) for i, m in enumerate(taxonomy.MECHANISMS)])
    return one.select("affected", "fully_rescued", F.explode(rows).alias("m")).select("m.mechanism", "affected", "fully_rescued", "m.needed_by", "m.sole_reason")


def instability(transitions: DataFrame, long: DataFrame, dim: DataFrame, key: str, source: str) -> DataFrame:
    """For each source: breaking and all transitions."""
    breaking = long.join(dim.where("binary").select("kind"), "kind", "left_semi").select(key).distinct().withColumn("_b", F.lit(1))
    return transitions.join(breaking, key, "left").groupBy(source).agg(F.count("_b").alias("breaking"), F.count("*").alias("total"))


def most_unstable(per_source: DataFrame, source: str, top: int = 20) -> DataFrame:
    return per_source.where("breaking > 0").orderBy(F.desc("breaking"), F.desc("total"), source).limit(top)


def histogram(long: DataFrame, transitions: DataFrame, key: str, source: str, top: int = 5) -> DataFrame:
    """For each source its most frequent kinds as text."""
    per = long.join(transitions.select(key, source), key).groupBy(source, "kind").agg(F.sum("n").alias("n"))
    entry = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "kind"))), 1, top), lambda e: F.concat_ws("=", e["kind"], (-e["m"]).cast("string")))
    return per.groupBy(source).agg(F.array_join(entry, ", ").alias("kinds"))


def corpus_summary(transitions: DataFrame, key: str, source: str) -> DataFrame:
    mass = F.coalesce("mass_rename", F.lit(False))
    return transitions.agg(F.count("*").alias("transitions"), F.count_distinct(source).alias("sources"), F.count_if(~mass).alias("kept"), F.count_if(mass).alias("mass_rename"), F.count_distinct(F.when(~mass, F.col(source))).alias("kept_sources"))


def noise_floor(long: DataFrame, transitions: DataFrame, key: str) -> DataFrame:
    """For each kind the share of transitions with it, by arm (study or control)."""
    per_arm = transitions.groupBy("arm").agg(F.count("*").alias("_all"))
    hits = long.join(transitions.select(key, "arm"), key).groupBy("arm", "kind").agg(F.count("*").alias("transitions"), F.sum("n").alias("events"))
    return hits.join(F.broadcast(per_arm), "arm").withColumn("percent", scalars.percent(F.col("transitions"), F.col("_all"))).drop("_all")  # two rows
