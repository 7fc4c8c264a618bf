"""Choosing what to study: quotas, releases in order, pairs of releases, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import scalars


def quota_topk(candidates: DataFrame, quotas: dict[str, int], scan: int, order: str = "rank", source: str = "source", language: str = "language", usable: str = "usable") -> DataFrame:
    """The best candidates by order until each language's quota is full, one for each source.

    Only the first ``scan`` count, of all languages. A source's first candidate
    stands for it, usable or not, except that a candidate of a language without
    a quota, or whose quota is full by then, doesn't. So languages are closed one
    after the other, in the order in which they fill: a closed one's later
    candidates go, and sources are made distinct again. Ties in order go by source.
    """
    by_order = [F.col(order), F.col(source)]
    quota = F.coalesce(*[F.when(F.col(language) == k, F.lit(n)) for k, n in quotas.items()], F.lit(0))
    # a limit before the row numbers: only scan rows meet in one task
    rows = candidates.orderBy(*by_order).limit(scan).withColumn("_n", F.row_number().over(Window.orderBy(*by_order)))
    rows = rows.withColumn("_quota", quota).where("_quota > 0")

    def filled(df: DataFrame) -> DataFrame:
        first = df.withColumn("_first", F.row_number().over(Window.partitionBy(source).orderBy("_n"))).where("_first = 1").where(F.col(usable))
        return first.withColumn("_fill", F.row_number().over(Window.partitionBy(language).orderBy("_n"))).drop("_first")

    for k in range(1, len(quotas)):
        full = filled(rows).where("_fill = _quota").orderBy("_n").limit(k).agg(F.count("*").alias("_full"), F.max("_n").alias("_at"), F.max_by(language, "_n").alias("_closed"))
        rows = rows.crossJoin(F.broadcast(full))  # full is one row
        rows = rows.where((F.col("_full") < k) | (F.col(language) != F.col("_closed")) | (F.col("_n") <= F.col("_at"))).drop("_full", "_at", "_closed")
    return filled(rows).where("_fill <= _quota").drop("_n", "_quota", "_fill")


def newest_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order, which should be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def latest_within_scan(df: DataFrame, keys: list[str], order: list[Column], usable: Column, scan: int = 40, keep: int = 10) -> DataFrame:
    """Of each group's first scan rows the first keep usable ones, with their place."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("_scan", F.row_number().over(w)).where(F.col("_scan") <= scan)
    return first.where(usable).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep).drop("_scan")


def consecutive_pairs(df: DataFrame, keys: list[str], order: list[Column], carry: list[str]) -> DataFrame:
    """Each row but a group's first, with the row before it: columns old and new of struct(carry)."""
    new = F.struct(*carry)
    return df.select(*keys, new.alias("new"), F.lag(new).over(Window.partitionBy(*keys).orderBy(*order)).alias("old")).where("old is not null")


def control_pairs(df: DataFrame, source: str, upstream: str, order: list[Column], carry: list[str], each: int = 3) -> DataFrame:
    """For up to each upstreams of a source, its two newest revisions: changes there are noise."""
    w = Window.partitionBy(source, upstream).orderBy(*order)
    pairs = df.select(source, upstream, F.row_number().over(w).alias("_rn"), F.struct(*carry).alias("new"), F.lead(F.struct(*carry)).over(w).alias("old"))
    pairs = pairs.where("_rn = 1 and old is not null")
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(F.col(upstream).desc()))).where(F.col("_n") <= each).drop("_rn", "_n")


def releases(versions: DataFrame) -> DataFrame:
    """(source, version) to one row for each upstream, newest revision, releases only, with its sort key."""
    parsed = versions.withColumn("_p", scalars.version_parts("version")).where("_p is not null")
    parsed = parsed.withColumn("upstream", F.col("_p.upstream")).withColumn("key", scalars.version_key("version")).drop("_p")
    return newest_per_group(parsed.where(~scalars.is_prerelease("upstream")), ["source", "upstream"], [F.col("key").desc(), F.col("version")])


def release_pairs(versions: DataFrame) -> DataFrame:
    """source, id, old, new (upstream, version) of consecutive releases in version order."""
    pairs = consecutive_pairs(releases(versions), ["source"], [F.col("key"), F.col("version")], ["upstream", "version"])
    return pairs.select("source", scalars.pair_id("source", "old.upstream", "new.upstream").alias("id"), "old", "new")


def roles(packages: DataFrame, most: int = 4) -> DataFrame:
    """runtime and dev package names of a release's wanted library.

    packages has release, want and name. A runtime package has a -dbgsym
    sibling and equals the wanted name but for digits; if none does, those that
    begin with its stem count. Dev packages that share the name's beginning are
    preferred to others. At most ``most`` each, by name.
    """
    with_symbols = packages.where(F.col("name").endswith("-dbgsym")).select("release", F.regexp_replace("name", "-dbgsym$", "").alias("name")).distinct()
    runtime = packages.where(~scalars.has_suffix("name", scalars.NON_RUNTIME_SUFFIXES)).join(with_symbols, ["release", "name"], "left_semi")
    target = scalars.digits_blind("want")
    stem = F.regexp_replace("want", "[0-9]*$", "")
    runtime = runtime.withColumn("_exact", scalars.digits_blind("name") == target).withColumn("_stem", F.col("name").startswith(F.regexp_replace(stem, "-*$", "")))
    pick = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("name"))))
    chosen = runtime.groupBy("release", "want").agg(pick(F.col("_exact")).alias("exact"), pick(F.col("_stem")).alias("stem"))
    chosen = chosen.select("release", "want", F.slice(F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("stem")), 1, most).alias("runtime"))
    devs = packages.where(F.col("name").endswith("-dev")).withColumn("_near", scalars.digits_blind("name").startswith(F.regexp_replace(target, "#*$", "")))
    devs = devs.groupBy("release", "want").agg(pick(F.col("_near")).alias("near"), F.array_sort(F.collect_set("name")).alias("all"))
    devs = devs.select("release", "want", F.slice(F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("all")), 1, most).alias("dev"))
    none = F.array().cast("array<string>")
    return packages.select("release", "want").distinct().join(chosen, ["release", "want"], "left").join(devs, ["release", "want"], "left").select("release", "want", F.coalesce("runtime", none).alias("runtime"), F.coalesce("dev", none).alias("dev"))


def with_siblings(packages: DataFrame, suffix: str = "-dbgsym") -> DataFrame:
    """Packages whose name plus suffix is a package of the same release."""
    siblings = packages.select("release", F.col("name").alias("_s")).where(F.col("_s").endswith(suffix))
    return packages.join(siblings.select("release", F.expr(f"substr(_s, 1, length(_s) - {len(suffix)})").alias("name")).distinct(), ["release", "name"], "left_semi")


def remaining(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows without a result."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def within_budget(jobs: DataFrame, sizes: DataFrame, budget_mb: float, expansion: float = 3.0) -> DataFrame:
    """jobs with mb (the sum of their files' sizes; unknown ones are 0) and error for those whose expanded size is over budget."""
    mb = sizes.groupBy("id").agg((F.sum(F.coalesce("length", F.lit(0))) / 1e6).alias("mb"))
    out = jobs.join(mb, "id", "left").withColumn("mb", F.coalesce("mb", F.lit(0.0)))
    return out.withColumn("error", F.when(F.col("mb") * expansion > budget_mb, F.lit("over the memory budget")))


def candidates(popcon: DataFrame, depends: DataFrame, origins: DataFrame, packages: DataFrame) -> DataFrame:
    """rank, installs, binary, source, language, usable: library packages by popularity, ready for quota_topk().

    origins has binary, source (a binary's newest source); packages has source
    and name. A source is usable if it has debug symbols of the binary and a dev
    package. A binary without a Depends line counts as C. One without an origin
    has no source and is never usable, but takes up its place in the scan.
    """
    named = popcon.where(scalars.is_candidate("name")).join(depends, "name", "left").withColumn("language", scalars.language_of_depends("depends"))
    placed = named.withColumnRenamed("name", "binary").join(origins.select("binary", "source"), "binary", "left")
    symbols = packages.where(F.col("name").endswith("-dbgsym")).select("source", F.regexp_replace("name", "-dbgsym$", "").alias("binary")).distinct().withColumn("_symbols", F.lit(True))
    dev = packages.where(F.col("name").endswith("-dev")).select("source").distinct().withColumn("_dev", F.lit(True))
    out = placed.join(symbols, ["source", "binary"], "left").join(dev, "source", "left")
    return out.select("rank", "installs", "binary", "source", "language", (F.col("_symbols").isNotNull() & F.col("_dev").isNotNull()).alias("usable"))


def newest_builds(builds: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's builds (version, hash) the newest version's."""
    key = scalars.version_key("version")
    rest = [c for c in builds.columns if c not in keys]
    return builds.where(key.isNotNull()).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(key, F.col("hash"))).alias("r")).select(*keys, "r.*")


def roles_by_pattern(packages: DataFrame, patterns: DataFrame, most: int = 4) -> DataFrame:
    """release, runtime: packages whose name matches their library's own pattern (source, pattern)."""
    hits = packages.join(patterns, "source").where(F.regexp("name", F.col("pattern")) & ~scalars.has_suffix("name", scalars.FIRST_SURVEY_SUFFIXES))
    return hits.groupBy("source", "release").agg(F.slice(F.array_sort(F.collect_set("name")), 1, most).alias("runtime"))


def to_evict(entries: DataFrame, cache: str, budget: int, share: float = 0.7) -> DataFrame:
    """The oldest entries (path, mtime, size) of each cache to drop so that it falls below share of its budget; none while within budget."""
    w = Window.partitionBy(cache).orderBy("mtime", "path")
    total = F.sum("size").over(Window.partitionBy(cache))
    before = total - F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return entries.withColumn("_total", total).withColumn("_left", before).where((F.col("_total") >= budget) & (F.col("_left") >= share * budget)).drop("_total", "_left")
