"""The change kinds, their framings, and the mechanisms that absorb them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT, ENUM, DISPATCH, INLINE = "opaque layout", "non-frozen enum", "resilient dispatch", "no implicit cross-module inlining"
NONE, NOT_APPLICABLE = "cannot help", "n/a"
MECHANISMS = (LAYOUT, ENUM, DISPATCH, INLINE)

#: Kind, group, in the binary, evolution and inline framings, mechanism.
KINDS = (
    ("field_added_to_struct", "Layout", True, True, True, LAYOUT),
    ("field_removed_from_struct", "Layout", True, True, True, LAYOUT),
    ("field_type_changed", "Layout", True, True, True, LAYOUT),
    ("member_offset_changed", "Layout", True, True, True, LAYOUT),
    ("type_size_changed", "Layout", True, True, True, LAYOUT),
    ("base_class_changed", "Layout", True, True, True, LAYOUT),
    ("enum_case_added", "Enums", False, True, True, ENUM),
    ("enum_case_removed", "Enums", False, True, True, ENUM),
    ("vtable_changed", "Dispatch", True, True, True, DISPATCH),
    ("function_signature_changed", "Symbols", True, True, True, NONE),
    ("symbol_removed", "Symbols", True, True, True, NONE),
    ("symbol_added", "Symbols", False, False, False, NOT_APPLICABLE),
    ("symbol_version_renamed", "Symbols", False, False, False, NOT_APPLICABLE),
    ("inline_body_changed", "Header bodies", False, False, True, INLINE),
    ("macro_value_changed", "Header bodies", False, False, False, INLINE),
)
#: Why no mechanism absorbs a kind.
REASONS = {
    "function_signature_changed": "source-level API break; indirection cannot help",
    "symbol_removed": "source-level API break; indirection cannot help",
    "symbol_added": "additive; already compatible without resilience",
    "symbol_version_renamed": "library renames all symbols per release by policy",
}
GROUP_ORDER = ("Symbols", "Enums", "Layout", "Dispatch", "Header bodies")
FRAMINGS = ("binary", "evolution", "inline")
SCHEMA = "ord int, kind string, grp string, binary boolean, evolution boolean, inline boolean, mechanism string, absorbed boolean"


def verdict(mechanism: str) -> str:
    """Whether a mechanism absorbs its changes, cannot, or has nothing to absorb."""
    return "absorbed" if mechanism in MECHANISMS else "not_absorbed" if mechanism == NONE else "neutral"


def reason(kind: str) -> str:
    """The mechanism that absorbs a kind, or why none does; empty for kinds that aren't of the taxonomy."""
    mechanism = {k[0]: k[5] for k in KINDS}.get(kind, "")
    return mechanism if mechanism in MECHANISMS else REASONS.get(kind, "")


def rows() -> list[tuple]:
    return [(i, *k, k[5] in MECHANISMS) for i, k in enumerate(KINDS, 1)]


def dimension(spark: SparkSession) -> DataFrame:
    """Fifteen rows, a constant of the plan; joins to it are broadcast for its fixed size."""
    return F.broadcast(spark.createDataFrame(rows(), SCHEMA))


def values_sql() -> str:
    """The dimension as a VALUES list, for SQL beside the DataFrame form."""
    said = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return ", ".join(f"({', '.join(map(said, r))})" for r in rows())


def checked(df: DataFrame, kind: str = "kind") -> DataFrame:
    """df, failing on a kind that the taxonomy hasn't."""
    known = F.col(kind).isin([k[0] for k in KINDS])
    return df.withColumn(kind, F.when(known, F.col(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown change kind: "), F.coalesce(kind, F.lit("null"))))))
