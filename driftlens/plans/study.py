"""The whole study: artefacts of transitions to the figures of its summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import scalars, taxonomy
from driftlens.operators import changes, headers, prevalence
from driftlens.sources import artifacts


@dataclass
class Corpus:
    """transitions: a row each; public, third_party, private: counts in long form, with keys id; header_pairs: diffs by id."""

    transitions: DataFrame
    public: DataFrame
    third_party: DataFrame
    private: DataFrame
    header_pairs: DataFrame


def from_artifacts(spark: SparkSession, pairs_path: str, headers_path: str | None = None, strict_reference: bool = False, folder: str | None = None) -> Corpus:
    """Transitions without an error and with an object; header data where it exists.

    Changed macros count without version stamps; with strict_reference all of them do. With folder,
    what figures need is kept there, dealt by transition, so none parses or shuffles it again.
    """
    keep = lambda df, name: artifacts.kept_by(df, ["id"], f"{folder}/{name}") if folder else df
    macros = "macro_value_changed" if strict_reference else "macro_value_changed_nonversion"
    pairs = artifacts.read_artifacts(spark, pairs_path, "pair").where("error is null and size(objects) > 0")
    objects = pairs.select("id", "source", F.explode("objects").alias("o"))
    used = ("language", "soname", "coverage", "mass_rename", "public", "third_party", "private_node")
    objects = keep(objects.select("id", "source", F.struct(*[f"o.{c}" for c in used]).alias("o")), "objects")
    if headers_path is None:
        header_pairs = spark.createDataFrame([], f"id string, diff {artifacts.HEADER_DIFF}, coverage array<{artifacts.COVERAGE}>")
    else:
        header_pairs = artifacts.read_artifacts(spark, headers_path, "header-pair").where("error is null and diff is not null").select("id", "diff", "coverage")
        header_pairs = keep(header_pairs, "header-pairs")
    # artefacts of other tools may lack the figure without version stamps; it is the whole count then
    other = F.coalesce("diff.macro_value_changed_nonversion", "diff.macro_value_changed")
    header_pairs = header_pairs.dropDuplicates(["id"]).withColumn("diff", F.col("diff").withField("macro_value_changed_nonversion", other))
    poor = F.exists(F.coalesce("coverage", F.array().cast(f"array<{artifacts.COVERAGE}>")), lambda c: headers.poor_coverage(F.coalesce(c["parsed"], F.lit(0)), F.coalesce(c["with_fatal"], F.lit(0)), F.coalesce(c["with_errors"], F.lit(0))))
    header_pairs = header_pairs.withColumn("poor", poor)
    sides = objects.select("id", "source", "o.language", F.get("o.soname", 0).alias("soname_1"), F.get("o.soname", 1).alias("soname_2"), F.get("o.coverage.debug_info_found", 0).alias("debug_1"), F.get("o.coverage.debug_info_found", 1).alias("debug_2"), "o.mass_rename")
    transitions = prevalence.rollup(sides, ["id", "source"])
    long = lambda name: taxonomy.checked(prevalence.long_counts(objects.select("id", F.col(f"o.{name}").alias("m")), ["id"], "m"))
    inline = header_pairs.select("id", F.explode(F.array(F.struct(F.lit("inline_body_changed").alias("kind"), F.col("diff.inline_body_changed").cast("bigint").alias("n")), F.struct(F.lit("macro_value_changed").alias("kind"), F.col(f"diff.{macros}").cast("bigint").alias("n")))).alias("c")).select("id", "c.*").where("n > 0")
    inline = inline.join(transitions.select("id"), "id", "left_semi")
    return Corpus(transitions, long("public").unionByName(inline), long("third_party"), long("private_node"), header_pairs)


@dataclass
class Summary:
    """Small frames, each of a few rows."""

    corpus: DataFrame
    filtered: DataFrame
    frequency: DataFrame
    breaks: DataFrame
    rescue: dict[str, DataFrame]
    churn: DataFrame
    top_churn: DataFrame
    unstable: DataFrame
    layout_enum: DataFrame
    sizes: DataFrame


def analyse(c: Corpus) -> Summary:
    """Figures over transitions that aren't mass renames, but for those of filtered, which cover all."""
    spark = c.transitions.sparkSession
    dim = taxonomy.dimension(spark)
    good = c.transitions.where(~F.coalesce("mass_rename", F.lit(False)))
    long = c.public.join(good.select("id"), "id", "left_semi")
    filtered = c.third_party.select(F.lit("third_party").alias("what"), "n").unionByName(c.private.select(F.lit("private_node").alias("what"), "n")).groupBy("what").agg(F.sum("n").alias("events"))
    with_headers = c.header_pairs.join(good.select("id"), "id", "left_semi").select("id", "diff.*", "poor")
    top = with_headers.where("inline_body_changed > 0").orderBy(F.desc("inline_body_changed"), "id").select("id", "inline_body_changed").limit(10)
    per_source = prevalence.instability(good, long, dim, "id", "source")
    groups = long.join(dim.where("grp in ('Layout', 'Enums')").select("kind", "grp"), "kind")
    layout_enum = groups.groupBy("grp").agg(F.count_distinct("id").alias("transitions"), F.count("*").alias("summed_prevalence"))
    return Summary(
        prevalence.corpus_summary(c.transitions, "id", "source"),
        filtered,
        prevalence.frequency_by(long.join(good.select("id", "language"), "id"), dim, "language"),
        prevalence.breaks(good, long, dim, "id"),
        {f: prevalence.rescue(long, dim, f, "id") for f in taxonomy.FRAMINGS},
        headers.churn(with_headers),
        top,
        prevalence.most_unstable(per_source, "source"),
        layout_enum,
        _sizes(good),
    )


def _sizes(good: DataFrame) -> DataFrame:
    """language, n, libraries: what the shares of each language's table are of; all is every language."""
    sets = good.groupingSets([[], ["language"]], "language")
    return sets.agg(F.count("*").alias("n"), F.count_distinct("source").alias("libraries"), F.grouping("language").alias("_all")).select(F.when(F.col("_all") == 1, "all").otherwise(F.col("language")).alias("language"), "n", "libraries")


def summary_row(s: Summary) -> DataFrame:
    """The figures of a study as the one row of a summary artefact; write_artifact() writes it.

    Each part is an aggregate of one of the summary's small frames, so nothing is collected.
    """
    spark = s.corpus.sparkSession
    dim = taxonomy.dimension(spark).select("kind", "mechanism")
    entries = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v))))
    corpus = s.corpus.select(F.struct(F.col("kept").alias("transitions"), F.col("kept_sources").alias("libraries"), F.col("mass_rename").alias("mass_rename_excluded")).alias("corpus"))
    rows = F.array_sort(F.collect_list(F.struct("ord", "kind", "transitions", "events", F.col("median").cast("double").alias("median"), F.col("most").cast("bigint").alias("max"), "mechanism")))
    rows = F.transform(rows, lambda r: r.dropFields("ord"))
    tables = s.frequency.join(dim, "kind").groupBy("language").agg(rows.alias("rows")).join(s.sizes, "language")
    tables = tables.select("language", F.struct(F.col("language").alias("title"), "n", "libraries", "rows").alias("v"))
    rescued = None
    for k, f in enumerate(taxonomy.FRAMINGS):
        part = s.rescue[f].groupBy("affected", "fully_rescued").agg(F.array_sort(F.collect_list(F.struct("mechanism", "needed_by", "sole_reason"))).alias("mechanisms"))
        part = part.select(F.lit(f).alias("framing"), F.struct("affected", "fully_rescued", "mechanisms").alias("v"))
        rescued = part if k == 0 else rescued.unionByName(part)
    most = F.array_sort(F.collect_list(F.struct((-F.col("breaking")).alias("b"), (-F.col("total")).alias("t"), "source", "breaking", "total")))
    parts = [
        corpus,
        s.filtered.agg(entries("what", F.col("events").cast("bigint").alias("v")).alias("filtered")),
        tables.agg(entries("language", "v").alias("frequency")),
        s.breaks.select(F.struct("n", "breaking", "declared", "silent").alias("breaks")),
        rescued.agg(entries("framing", "v").alias("rescue")),
        s.unstable.agg(F.transform(most, lambda u: u.dropFields("b", "t")).alias("unstable")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


# From facts


KEYS = ["release_pair", "object"]


def classify_facts(old: dict[str, DataFrame], new: dict[str, DataFrame], own_headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events (keys, kind, third_party, private) and the symbol tallies of all pairs of objects.

    old and new hold the fact tables symbols, types, members, bases, vslots and
    enumerators of the two sides, each with the key columns.
    """
    layout = changes.on_both_sides(_layout(old, new), old["types"], new["types"], KEYS)
    layout = changes.attributed(layout, old["types"].unionByName(new["types"], allowMissingColumns=True), own_headers, KEYS).withColumn("private", F.lit(False))
    events, tallies = changes.symbols(old["symbols"], new["symbols"], KEYS)
    events = events.select(*KEYS, "kind", F.lit(False).alias("third_party"), "private")
    return layout.select(*KEYS, "kind", "third_party", "private").unionByName(events), tallies


def classified_counts(old: dict[str, DataFrame], new: dict[str, DataFrame], own_headers: DataFrame) -> DataFrame:
    """keys, kind, third_party, private, n: the events of classify_facts() counted, and renames as symbol_version_renamed.

    The tables are partitioned alike by some of KEYS, as artifacts.kept_by() gives them, and nothing is shuffled again.
    """
    layout = changes.placed(changes.layout_counts(old, new, KEYS), old["types"], new["types"], own_headers, KEYS)
    symbols = changes.symbol_counts(old["symbols"], new["symbols"], KEYS, True)
    return layout.select(*KEYS, "kind", "third_party", F.lit(False).alias("private"), "n").unionByName(symbols.select(*KEYS, "kind", F.lit(False).alias("third_party"), "private", "n"))


def _layout(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    found = [f(old[t], new[t], KEYS) for f, t in ((changes.members, "members"), (changes.bases, "bases"), (changes.enumerators, "enumerators"), (changes.vtables, "vslots"), (changes.sizes, "types"))]
    layout = found[0].select(*KEYS, "type_id", "kind")
    for f in found[1:]:
        layout = layout.unionByName(f.select(*KEYS, "type_id", "kind"))
    return layout


def public_counts(events: DataFrame, tallies: DataFrame) -> DataFrame:
    """keys, kind, n of public events, with renames, which always count as public."""
    renamed = tallies.where("renamed > 0").select(*KEYS, F.lit("symbol_version_renamed").alias("kind"), F.col("renamed").alias("n"))
    return prevalence.counted(events.where("not third_party and not private"), KEYS).unionByName(renamed)


def version_pairs_from(versions: DataFrame) -> DataFrame:
    from driftlens.operators import corpus

    return corpus.release_pairs(versions).withColumn("file", F.concat(scalars.index_stem("id"), F.lit(".json")))
