"""Changes that only headers show: bodies of inline functions and values of macros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import scalars

from .changes import outer


def compare_definitions(old: DataFrame, new: DataFrame, keys: list[str], examples: int = 8) -> DataFrame:
    """Counters for each of keys from definitions (usr, path, name, kind, decl_fp, body_fp) of both sides.

    Examples are the first by path and name.
    """
    both = outer(old, new, [*keys, "usr"], ["path", "name", "kind", "decl_fp", "body_fp"])
    has_old, has_new = F.col("old").isNotNull(), F.col("new").isNotNull()
    common = has_old & has_new
    body, decl = common & (F.col("old.body_fp") != F.col("new.body_fp")), common & (F.col("old.decl_fp") != F.col("new.decl_fp"))
    name = F.concat_ws("::", "old.path", "old.name").alias("name")
    # the first few names by rank, so no list grows with a key's changes
    first = both.where(body).select(*keys, name).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("name"))).where(F.col("_n") <= examples)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list("name")).alias("examples"))
    counters = both.groupBy(*keys).agg(
        F.count_if(has_old).alias("definitions_1"),
        F.count_if(has_new).alias("definitions_2"),
        F.count_if(common).alias("definitions_common"),
        F.count_if(~has_old & has_new).alias("definitions_added"),
        F.count_if(has_old & ~has_new).alias("definitions_removed"),
        F.count_if(body).alias("inline_body_changed"),
        F.count_if(body & F.col("old.kind").contains("Template")).alias("inline_body_changed_template"),
        F.count_if(decl).alias("inline_decl_changed"),
    )
    return counters.join(first, keys, "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))


def compare_macros(old: DataFrame, new: DataFrame, keys: list[str], strict_reference: bool = False) -> DataFrame:
    """Counters from macros (key, value_fp). With strict_reference the figure without version stamps equals the whole."""
    both = outer(old, new, [*keys, "key"], ["value_fp"])
    has_old, has_new = F.col("old").isNotNull(), F.col("new").isNotNull()
    changed = has_old & has_new & (F.col("old.value_fp") != F.col("new.value_fp"))
    other = changed if strict_reference else changed & ~scalars.is_version_stamp("key")
    return both.groupBy(*keys).agg(
        F.count_if(has_old).alias("macros_1"),
        F.count_if(has_new).alias("macros_2"),
        F.count_if(has_old & has_new).alias("macros_common"),
        F.count_if(changed).alias("macro_value_changed"),
        F.count_if(other).alias("macro_value_changed_nonversion"),
    )


def compare_headers(definitions_1: DataFrame, definitions_2: DataFrame, macros_1: DataFrame, macros_2: DataFrame, keys: list[str]) -> DataFrame:
    out = compare_definitions(definitions_1, definitions_2, keys).join(compare_macros(macros_1, macros_2, keys), keys, "full_outer")
    return out.fillna(0)


def poor_coverage(parsed: Column, with_fatal: Column, with_errors: Column) -> Column:
    """Over half of the files parsed with errors."""
    return (parsed != 0) & (F.greatest(with_errors, with_fatal) * 2 > parsed)


def churn(pairs: DataFrame) -> DataFrame:
    """One row of totals over transitions with header data."""
    body, macro = F.col("inline_body_changed"), F.col("macro_value_changed")
    return pairs.agg(
        F.count("*").alias("with_data"),
        F.count_if(F.col("definitions_common") > 0).alias("with_definitions"),
        F.count_if(body > 0).alias("body_changed"),
        F.coalesce(F.sum(body), F.lit(0)).cast("bigint").alias("body_events"),
        F.count_if(macro > 0).alias("macro_changed"),
        F.coalesce(F.sum(macro), F.lit(0)).cast("bigint").alias("macro_events"),
        F.count_if(F.col("macro_value_changed_nonversion") > 0).alias("macro_changed_nonversion"),
        F.count_if("poor").alias("poor_coverage"),
        F.median(F.when(body > 0, body)).alias("body_median"),
        F.max(F.when(body > 0, body)).cast("bigint").alias("body_max"),
    )


def with_language(jobs: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """jobs with the language of their pair's result; cxx where there is none, so that nothing is parsed too narrowly."""
    known = pairs.groupBy(key).agg(F.min("language").alias("language"))
    return jobs.join(known, key, "left").withColumn("language", F.coalesce("language", F.lit("cxx")))
