"""Queries over the driver's tables that exercise the library's operators.

The tables hold no interface data, so one analogy serves all: a library is a
customer, a release an order, a transition two consecutive orders of a
customer, a soname the order's status, a language the market segment. The
elements of a release are its line numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions import scalars, taxonomy
from driftlens.operators import changes, corpus, headers, prevalence, reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The analogy


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """id, source, language, soname_changed, old_key, new_key."""
    orders = table(spark, d, "orders")
    pairs = corpus.consecutive_pairs(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_orderstatus"])
    keys = [F.col(f"{s}.o_orderkey").cast("string") for s in ("old", "new")]
    pairs = pairs.select(scalars.pair_id(F.col("o_custkey").cast("string"), *keys).alias("id"), F.col("o_custkey").alias("source"), (F.col("old.o_orderstatus") != F.col("new.o_orderstatus")).alias("soname_changed"), F.col("old.o_orderkey").alias("old_key"), F.col("new.o_orderkey").alias("new_key"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.col("c_mktsegment").alias("language"))
    return pairs.join(customers, "source", "left")


def elements(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("k"), "l_quantity", "l_returnflag", "l_linestatus")
    # dealt by key, lines are grouped and joined by one shuffle
    return lines.repartition("key").groupBy("key", "k").agg(F.max("l_quantity").alias("v"), F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("s"))


def compared(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    """id, k, old, new: the elements of both sides of all transitions."""
    pairs = transitions(spark, d) if pairs is None else pairs
    return changes.compared(both_sides(spark, d, pairs), ["id", "k"], ["v", "f", "s"])


def both_sides(spark: SparkSession, d: str, pairs: DataFrame) -> DataFrame:
    """id, side (1 or 2), k, v, f, s: the facts meet each transition's two releases in one join."""
    ends = F.array(F.struct(F.lit(1).alias("side"), F.col("old_key").alias("key")), F.struct(F.lit(2).alias("side"), F.col("new_key").alias("key")))
    return pairs.select("id", F.explode(ends).alias("e")).select("id", "e.side", "e.key").join(elements(spark, d), "key").drop("key")


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """id, k, v, f, s of the old and of the new releases of all transitions."""
    facts = both_sides(spark, d, transitions(spark, d))
    return facts.where("side = 1").drop("side"), facts.where("side = 2").drop("side")


def element_changes(spark: SparkSession, d: str, inline: bool = False) -> DataFrame:
    """id, kind, n in long form."""
    both = compared(spark, d)
    k, old, new = F.col("k"), F.col("old").isNull(), F.col("new").isNull()
    group = F.when(k <= 3, 1).when(k <= 5, 2).when(k == 6, 3).when(k == 7, 4)
    pick = lambda *kinds: F.element_at(F.array(*[F.lit(x) for x in kinds]), group)
    kind = (
        F.when(old, pick("field_added_to_struct", "enum_case_added", "symbol_added", "vtable_changed"))
        .when(new, pick("field_removed_from_struct", "enum_case_removed", "symbol_removed", "vtable_changed"))
        .when((k <= 3) & (F.col("old.v") != F.col("new.v")), "field_type_changed")
        .when((k == 6) & (F.col("old.v") != F.col("new.v")), "function_signature_changed")
        .when((k == 7) & (F.col("old.f") != F.col("new.f")), "vtable_changed")
    )
    kinds = [kind]
    if inline:
        kinds.append(F.when(~old & ~new & (k <= 3) & (F.col("old.s") != F.col("new.s")), "inline_body_changed"))
    found = both.select("id", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
    return prevalence.counted(found, ["id"])


TRANSITIONS = """
o as (
  select o_custkey, o_orderkey, o_orderstatus,
         lag(o_orderkey) over w as old_key, lag(o_orderstatus) over w as old_status
  from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
t as (
  select o_custkey || '@' || old_key || '..' || o_orderkey as id, o_custkey as source, c_mktsegment as language,
         old_status <> o_orderstatus as soname_changed, old_key, o_orderkey as new_key
  from o left join customer on c_custkey = o_custkey where old_key is not null)"""
COMPARED = (
    TRANSITIONS
    + """,
e as (
  select l_orderkey as key, l_linenumber as k, max(l_quantity) as v, max(l_returnflag) as f, max(l_linestatus) as s
  from lineitem group by all),
e1 as (select id, k, v, f, s from t join e on key = old_key),
e2 as (select id, k, v, f, s from t join e on key = new_key),
b as (
  select coalesce(e1.id, e2.id) as id, coalesce(e1.k, e2.k) as k, e1.k is null as only_new, e2.k is null as only_old,
         e1.v as v1, e2.v as v2, e1.f as f1, e2.f as f2, e1.s as s1, e2.s as s2
  from e1 full join e2 on e1.id = e2.id and e1.k = e2.k)"""
)
CHANGES = (
    COMPARED
    + """,
ch as (
  select id, case
    when only_new and k <= 3 then 'field_added_to_struct' when only_new and k <= 5 then 'enum_case_added'
    when only_new and k = 6 then 'symbol_added' when only_new and k = 7 then 'vtable_changed'
    when only_old and k <= 3 then 'field_removed_from_struct' when only_old and k <= 5 then 'enum_case_removed'
    when only_old and k = 6 then 'symbol_removed' when only_old and k = 7 then 'vtable_changed'
    when k <= 3 and v1 <> v2 then 'field_type_changed' when k = 6 and v1 <> v2 then 'function_signature_changed'
    when k = 7 and f1 <> f2 then 'vtable_changed' end as kind
  from b%s),
c as (select id, kind, count(*) as n from ch where kind is not null group by all),
dim(ord, kind, grp, "binary", evolution, inline, mechanism, absorbed) as (values """
    + taxonomy.values_sql()
    + ")"
)
PLAIN = CHANGES % ""
WITH_INLINE = CHANGES % " union all select id, case when not only_new and not only_old and k <= 3 and s1 <> s2 then 'inline_body_changed' end from b"


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '1995-01-01' and l_discount > 0.05 and l_returnflag <> 'R'")
def q01_scan_filter_project(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz '1995-01-01' and l_discount > 0.05 and l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("select o_custkey, o_orderstatus, o_orderkey from orders qualify row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate desc, o_orderkey desc) = 1")
def q02_newest_per_group(spark, d):
    return corpus.newest_per_group(table(spark, d, "orders"), ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query(f"with {TRANSITIONS} select id, source, language, soname_changed, old_key, new_key from t")
def q03_consecutive_pairs(spark, d):
    return transitions(spark, d).select("id", "source", "language", "soname_changed", "old_key", "new_key")


@query("""
with s as (select o_custkey, o_orderkey, o_orderstatus, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as scan from orders)
select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc)::int as place
from s where scan <= 40 and o_orderstatus <> 'P' qualify place <= 10""")
def q04_latest_n_within_scan(spark, d):
    found = corpus.latest_within_scan(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderstatus") != "P")
    return found.select("o_custkey", "o_orderkey", "place")


@query(f"with {PLAIN} select id, kind, n from c")
def q05_element_diff_counts(spark, d):
    return element_changes(spark, d)


@query(f"with {PLAIN} select ord, kind, grp, count(*) as transitions, sum(n)::bigint as events, median(n) as median, max(n) as most from c join dim using (kind) group by all")
def q06_kind_frequency(spark, d):
    return prevalence.frequency(element_changes(spark, d), taxonomy.dimension(spark)).select("ord", "kind", "grp", "transitions", "events", "median", "most")


@query(f"""with {PLAIN},
g as (select kind, language, grouping(language) as all_, count(*) as transitions, sum(n)::bigint as events, median(n) as median, max(n) as most
      from c join t using (id) group by grouping sets ((kind), (kind, language)))
select kind, case when all_ = 1 then 'all' else language end as language, transitions, events, median, most, ord, grp from g join dim using (kind)""")
def q07_kind_frequency_by_language(spark, d):
    long = element_changes(spark, d).join(transitions(spark, d).select("id", "language"), "id")
    return prevalence.frequency_by(long, taxonomy.dimension(spark), "language")


@query(f"""with {PLAIN}, br as (select distinct id from c join dim using (kind) where "binary")
select count(*) as n, count(*) filter (br.id is not null) as breaking, count(*) filter (br.id is not null and soname_changed) as declared,
       count(*) filter (br.id is not null and not soname_changed) as silent, count(*) filter (br.id is null and soname_changed) as soname_only
from t left join br on br.id = t.id""")
def q08_breaks_declared_silent(spark, d):
    return prevalence.breaks(transitions(spark, d), element_changes(spark, d), taxonomy.dimension(spark), "id")


def _rescue_sql(framing: str, prefix: str) -> str:
    mechanisms = ", ".join(f"('{m}')" for m in taxonomy.MECHANISMS)
    return f"""with {prefix},
r as (select id, bool_and(absorbed) as fully, list(distinct mechanism) as ms from c join dim using (kind) where "{framing}" group by id)
select mechanism, count(*) as affected, count(*) filter (fully) as fully_rescued, count(*) filter (fully and list_contains(ms, mechanism)) as needed_by,
       count(*) filter (fully and len(ms) = 1 and list_contains(ms, mechanism)) as sole_reason
from r, (values {mechanisms}) as m(mechanism) group by mechanism"""


@query(_rescue_sql("binary", PLAIN))
def q09_rescue_binary(spark, d):
    return prevalence.rescue(element_changes(spark, d), taxonomy.dimension(spark), "binary", "id")


@query(_rescue_sql("evolution", PLAIN))
def q10_rescue_evolution(spark, d):
    return prevalence.rescue(element_changes(spark, d), taxonomy.dimension(spark), "evolution", "id")


@query(_rescue_sql("inline", WITH_INLINE))
def q11_rescue_inline(spark, d):
    return prevalence.rescue(element_changes(spark, d, inline=True), taxonomy.dimension(spark), "inline", "id")


@query(f"""with {PLAIN}, br as (select distinct id from c join dim using (kind) where "binary")
select source, count(br.id) as breaking, count(*) as total from t left join br on br.id = t.id group by source
having count(br.id) > 0 order by breaking desc, total desc, source limit 20""")
def q12_instability_top20(spark, d):
    per = prevalence.instability(transitions(spark, d), element_changes(spark, d), taxonomy.dimension(spark), "id", "source")
    return prevalence.most_unstable(per, "source")


_QUOTAS = {"BUILDING": 40, "MACHINERY": 25}


@query("""
with recursive ranked as (
  select row_number() over (order by c_acctbal desc, c_custkey) as n, c_nationkey * 100 + c_custkey % 60 as source, c_mktsegment as language,
         c_custkey, c_acctbal > 0 and c_custkey % 3 <> 0 as usable from customer qualify n <= 800),
-- the scan row by row: the state is which sources were seen and what was taken
scan(n, seen, b, m, took) as (
  select 0::bigint, []::bigint[], 0, 0, null::bigint
  union all
  select r.n,
         case when full_ or list_contains(seen, r.source) then seen else list_append(seen, r.source::bigint) end,
         b + (take and r.language = 'BUILDING')::int, m + (take and r.language = 'MACHINERY')::int,
         case when take then r.c_custkey end
  from (select s.*, r2.source, r2.language, r2.usable, r2.c_custkey, r2.n as rn,
               case r2.language when 'BUILDING' then s.b >= 40 when 'MACHINERY' then s.m >= 25 else true end as full_,
               not (case r2.language when 'BUILDING' then s.b >= 40 when 'MACHINERY' then s.m >= 25 else true end)
                 and not list_contains(s.seen, r2.source) and r2.usable as take
        from scan s join ranked r2 on r2.n = s.n + 1) r0(n_, seen, b, m, took_, source, language, usable, c_custkey, n, full_, take), lateral (select r0.n, r0.source, r0.language, r0.c_custkey) r)
select c_custkey, language, source::bigint as source from scan join ranked on took = c_custkey""")
def q13_quota_topk_select(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 100 + F.col("c_custkey") % 60).cast("bigint").alias("source"), F.col("c_mktsegment").alias("language"), ((F.col("c_acctbal") > 0) & (F.col("c_custkey") % 3 != 0)).alias("usable"), F.struct((-F.col("c_acctbal")).alias("a"), F.col("c_custkey").alias("b")).alias("rank"))
    return corpus.quota_topk(c, _QUOTAS, 800).select("c_custkey", "language", "source")


@query("""
select kind, blind, count(*) as n from (
  select 'url' as kind, regexp_replace(url, '[0-9]+', '#', 'g') as blind from pages
  union all select 'name', regexp_replace(c_name, '[0-9]+', '#', 'g') from customer) group by all""")
def q14_digits_blind_groups(spark, d):
    part = lambda t, kind, c: table(spark, d, t).select(F.lit(kind).alias("kind"), scalars.digits_blind(c).alias("blind"))
    return part("pages", "url", "url").unionByName(part("customer", "name", "c_name")).groupBy("kind", "blind").agg(F.count("*").alias("n"))


@query("""
with r as (select regexp_replace(url, '[0-9]+', '#', 'g') as blind, count(*) as n from pages where page_id % 2 = 0 group by 1),
a as (select regexp_replace(url, '[0-9]+', '#', 'g') as blind, count(*) as n from pages where page_id % 2 = 1 group by 1)
select 1 as grp, sum(least(r.n, a.n))::bigint as renamed from r join a using (blind)""")
def q15_rename_multiset_match(spark, d):
    pages = table(spark, d, "pages").withColumn("grp", F.lit(1))
    return changes.renamed_counts(pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1"), ["grp"], "url")


@query("select page_id, string_split(list_last(string_split(url, '/')), '.so')[1] as stem from pages")
def q16_url_stem(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.soname_stem("url").alias("stem"))


_VERSIONS = ("1.0~rc1", "1.0~rc2", "1.0", "1.0-1", "1.0-2", "1.0a", "1.0+dfsg", "1.9", "1.10", "2.0", "3.4.1-1", "3.4.1-1+b1", "9.9", "1:1.0")


@query("select v, place::bigint as place from (values " + ", ".join(f"('{v}', {k})" for k, v in enumerate(_VERSIONS, 1)) + ") as x(v, place)")
def q17_version_sort(spark, d):
    given = spark.createDataFrame([(v,) for v in sorted(_VERSIONS)], "v string")
    return given.select("v", F.row_number().over(Window.orderBy(scalars.version_key("v"))).cast("bigint").alias("place"))


@query("""
select * from (values ('1:2.3-4-5', 1, '2.3-4', '5'), ('1.0', 0, '1.0', ''), ('1.0+dfsg-3', 0, '1.0+dfsg', '3'), ('2.0~rc1', 0, '2.0~rc1', ''),
  ('', null, null, null), ('x:1.0', null, null, null), ('1:', null, null, null)) as x(v, epoch, upstream, revision)""")
def q18_version_parts(spark, d):
    given = spark.createDataFrame([(v,) for v in ("1:2.3-4-5", "1.0", "1.0+dfsg-3", "2.0~rc1", "", "x:1.0", "1:")], "v string")
    return given.withColumn("p", scalars.version_parts("v")).select("v", "p.epoch", "p.upstream", "p.revision")


@query("select fp, count(*) as n from (select substr(sha1(unnest(string_split(text, chr(10)))), 1, 16) as fp from documents) group by fp")
def q19_fingerprint_lines(spark, d):
    return table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).groupBy(scalars.fingerprint("line").alias("fp")).agg(F.count("*").alias("n"))


def _header_sides(spark, d):
    """Consecutive documents of a source as two sides of an index: whole lines, each named by its first two words and which of
    the lines that share them it is; its first sentence declares it, the whole is its body."""
    docs = table(spark, d, "documents")
    pairs = corpus.consecutive_pairs(docs, ["source"], [F.col("doc_id")], ["doc_id", "text"])
    pairs = pairs.select(F.concat_ws("@", "source", F.col("new.doc_id").cast("string")).alias("id"), F.col("old.text").alias("old"), F.col("new.text").alias("new"))

    def side(c):
        lines = pairs.select("id", F.posexplode(F.split(c, "\n")).alias("at", "line")).where("line <> ''")
        words = lines.withColumn("two", F.substring_index("line", " ", 2))
        nth = F.row_number().over(Window.partitionBy("id", "two").orderBy("at"))
        one = words.select("id", F.concat_ws("#", "two", nth.cast("string")).alias("usr"), "line")
        return one.select("id", "usr", F.lit("doc").alias("path"), F.col("usr").alias("name"), F.when(F.length("line") > 200, "FunctionTemplate").otherwise("Function").alias("kind"), scalars.fingerprint(F.substring_index("line", ". ", 1)).alias("decl_fp"), scalars.fingerprint("line").alias("body_fp"))

    return side("old"), side("new")


_HEADER_SQL = """
p as (select source || '@' || doc_id as id, lag(text) over (partition by source order by doc_id) as old, text as new from documents qualify old is not null),
l as (select id, 1 as side, unnest(string_split(old, chr(10))) as line, generate_subscripts(string_split(old, chr(10)), 1) as pos from p
      union all select id, 2, unnest(string_split(new, chr(10))), generate_subscripts(string_split(new, chr(10)), 1) from p),
n as (select id, side, line, pos, array_to_string(string_split(line, ' ')[1:2], ' ') as two from l where line <> ''),
u as (select id, side, line, two || '#' || row_number() over (partition by id, side, two order by pos) as usr from n),
b as (select coalesce(x.id, y.id) as id, coalesce(x.usr, y.usr) as usr, x.line as a, y.line as z
      from (from u where side = 1) x full join (from u where side = 2) y on x.id = y.id and x.usr = y.usr),
h as (select id, count(a) as definitions_1, count(z) as definitions_2, count(*) filter (a is not null and z is not null) as definitions_common,
             count(*) filter (a is null) as definitions_added, count(*) filter (z is null) as definitions_removed,
             count(*) filter (a <> z) as inline_body_changed, count(*) filter (a <> z and length(a) > 200) as inline_body_changed_template,
             count(*) filter (string_split(a, '. ')[1] <> string_split(z, '. ')[1]) as inline_decl_changed,
             array_to_string(list_sort(coalesce(list('doc::' || usr) filter (a <> z), []))[1:8], '|') as examples
      from b group by id)"""


@query(f"with {_HEADER_SQL} select * from h")
def q20_header_index_diff(spark, d):
    out = headers.compare_definitions(*_header_sides(spark, d), ["id"])
    return out.withColumn("examples", F.array_join("examples", "|"))


@query("""
with m as (select user_id, 'ev::' || upper(event_type) || case when event_id % 3 = 0 then '_VERSION' else '_LEVEL' end as key, event_id % 2 as side,
                  max(json_extract_string(props, '$.k')::int) as v from events group by all),
b as (select coalesce(x.user_id, y.user_id) as user_id, coalesce(x.key, y.key) as key, x.v as a, y.v as z
      from (from m where side = 0) x full join (from m where side = 1) y on x.user_id = y.user_id and x.key = y.key)
select user_id, count(a) as macros_1, count(z) as macros_2, count(*) filter (a is not null and z is not null) as macros_common,
       count(*) filter (a <> z) as macro_value_changed, count(*) filter (a <> z and key not like '%VERSION%') as macro_value_changed_nonversion
from b group by user_id""")
def q21_macro_diff_nonversion(spark, d):
    key = F.concat(F.lit("ev::"), F.upper("event_type"), F.when(F.col("event_id") % 3 == 0, "_VERSION").otherwise("_LEVEL"))
    value = F.get_json_object("props", "$.k").cast("int")
    macros = table(spark, d, "events").groupBy("user_id", key.alias("key"), (F.col("event_id") % 2).alias("side")).agg(F.max(value).alias("value_fp"))
    side = lambda k: macros.where(F.col("side") == k).select("user_id", "key", "value_fp")
    return headers.compare_macros(side(0), side(1), ["user_id"])


@query("""
select user_id, count(*) as exported, count(*) filter (event_type = 'purchase') as mangled,
       case when count(*) filter (event_type = 'purchase') >= 0.2 * count(*) then 'cxx' else 'c' end as language
from events group by user_id""")
def q22_language_by_fraction(spark, d):
    symbols = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "purchase", "_Zx").otherwise("x").alias("linkage"), F.lit(True).alias("is_function"))
    return changes.language_by_share(symbols, ["user_id"])


@query("""
select l_orderkey, count(*) as objects,
       case when bool_or(l_shipdate >= timestamp '1997-01-01') then 'cxx' when bool_or(l_quantity > 25) then 'c' else 'unknown' end as language,
       bool_or(l_returnflag <> l_linestatus) as soname_changed, bool_or(not (l_tax > 0) or not (l_discount > 0)) as debug_info_missing,
       bool_or(l_quantity > 45) as mass_rename from lineitem group by l_orderkey""")
def q23_rollup_flags(spark, d):
    language = F.when(F.col("l_shipdate") >= F.expr("timestamp_ntz '1997-01-01'"), "cxx").when(F.col("l_quantity") > 25, "c").otherwise("unknown")
    objects = table(spark, d, "lineitem").select("l_orderkey", language.alias("language"), F.col("l_returnflag").alias("soname_1"), F.col("l_linestatus").alias("soname_2"), (F.col("l_tax") > 0).alias("debug_1"), (F.col("l_discount") > 0).alias("debug_2"), (F.col("l_quantity") > 45).alias("mass_rename"))
    return prevalence.rollup(objects, ["l_orderkey"])


@query("select l_returnflag = 'R' as private, l_linestatus as kind, count(*) as n, sum(l_quantity)::bigint as quantity from lineitem group by all")
def q24_private_public_partition(spark, d):
    private = scalars.is_private_node(F.when(F.col("l_returnflag") == "R", "NODE_PRIVATE_1").otherwise("NODE_1"))
    return table(spark, d, "lineitem").groupBy(private.alias("private"), F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("""
with own as (select distinct p_partkey from part where p_size <= 10)
select l_linenumber as k, count(own.p_partkey) as own, count(*) - count(own.p_partkey) as third_party
from lineitem left join own on l_partkey = p_partkey group by 1""")
def q25_third_party_semi_anti(spark, d):
    lines = table(spark, d, "lineitem").select(F.lit(1).alias("g"), F.col("l_partkey").alias("type_id"), F.col("l_linenumber").alias("k"))
    types = table(spark, d, "part").select(F.lit(1).alias("g"), F.col("p_partkey").alias("type_id"), F.concat_ws("/", F.lit("include"), F.col("p_partkey").cast("string")).alias("declared_in"))
    own = table(spark, d, "part").where("p_size <= 10").select(F.lit(1).alias("g"), F.col("p_partkey").cast("string").alias("basename"))
    return changes.attributed(lines, types, own, ["g"]).groupBy("k").agg(F.count_if(~F.col("third_party")).alias("own"), F.count_if("third_party").alias("third_party"))


@query("""
with s as (select s_nationkey as k, min(s_name) as old_path from supplier where s_nationkey < 18 group by 1),
c as (select c_nationkey as k, min(c_name) as new_path from customer where c_nationkey > 5 group by 1)
select coalesce(s.k, c.k) as nation, old_path, new_path from s full join c on s.k = c.k""")
def q26_unpaired_full_outer(spark, d):
    side = lambda t, p, cond: table(spark, d, t).where(cond).select(F.col(f"{p}_nationkey").alias("nation"), F.lit("x").alias("stem"), F.col(f"{p}_name").alias("path"))
    return side("supplier", "s", "s_nationkey < 18").groupBy("nation").agg(F.min("path").alias("old_path")).join(side("customer", "c", "c_nationkey > 5").groupBy("nation").agg(F.min("path").alias("new_path")), "nation", "full_outer")


@query("""
with m as (select l_suppkey, l_returnflag as kind, sum(case when l_quantity > 25 then 1 else 0 end)::bigint as n from lineitem group by all)
select l_suppkey, string_agg(kind || '=' || n, ',' order by kind) as counts from m where n > 0 group by 1""")
def q27_map_sum_sparse(spark, d):
    maps = table(spark, d, "lineitem").select("l_suppkey", F.create_map("l_returnflag", F.when(F.col("l_quantity") > 25, 1).otherwise(0)).alias("counts"))
    back = prevalence.as_map(prevalence.long_counts(maps, ["l_suppkey"], "counts"), ["l_suppkey"])
    text = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return back.select("l_suppkey", F.array_join(text, ",").alias("counts"))


@query("select l_suppkey, median(l_quantity) as median, count(*) as n from lineitem group by 1")
def q28_median_even_odd(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("median"), F.count("*").alias("n"))


@query("""
select o_custkey, count(*) filter (o_orderstatus = 'F') as part, count(*) filter (o_orderpriority = '1-URGENT') as whole,
       case when count(*) filter (o_orderpriority = '1-URGENT') <> 0 then round(100.0 * count(*) filter (o_orderstatus = 'F') / count(*) filter (o_orderpriority = '1-URGENT'), 1)::double end as percent
from orders group by 1""")
def q29_pct_null_on_zero(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("part"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("whole"))
    return per.withColumn("percent", scalars.percent(F.col("part"), F.col("whole")).cast("double"))


@query("""
select 'union' as op, k from (select c_nationkey as k from customer where c_acctbal < 0 union select s_nationkey from supplier where s_acctbal < 2000)
union all select 'intersect', k from (select c_nationkey as k from customer where c_acctbal < 0 intersect select s_nationkey from supplier where s_acctbal < 2000)
union all select 'except', k from (select c_nationkey as k from customer where c_acctbal < 0 except select s_nationkey from supplier where s_acctbal < 2000)""")
def q30_set_ops(spark, d):
    c = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").where("s_acctbal < 2000").select(F.col("s_nationkey").alias("k"))
    named = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return named(c.union(s).distinct(), "union").unionByName(named(c.intersect(s), "intersect")).unionByName(named(c.subtract(s), "except"))


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def q31_plan_minus_done(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return corpus.remaining(table(spark, d, "orders"), done, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("""
select source, count(*) as parsed, count(*) filter (quality = 0) as with_fatal, count(*) filter (toxic = 1) as with_errors,
       count(*) <> 0 and greatest(count(*) filter (quality = 0), count(*) filter (toxic = 1)) * 2 > count(*) as poor
from documents join labels using (doc_id) group by source""")
def q32_coverage_poor(spark, d):
    per = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("parsed"), F.count_if(F.col("quality") == 0).alias("with_fatal"), F.count_if(F.col("toxic") == 1).alias("with_errors"))
    return per.withColumn("poor", headers.poor_coverage(F.col("parsed"), F.col("with_fatal"), F.col("with_errors")))


@query("""
select o_custkey, min(o_orderkey) as hash, o_orderstatus as architecture from orders
where o_orderstatus in ('F', 'O') group by o_custkey, o_orderstatus
qualify row_number() over (partition by o_custkey order by case o_orderstatus when 'F' then 1 else 2 end) = 1""")
def q33_arch_preference(spark, d):
    from driftlens.sources import archive

    files = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("architecture")).agg(F.min("o_orderkey").alias("hash"))
    return archive.preferred_files(files, ["o_custkey"], ("F", "O")).select("o_custkey", "hash", "architecture")


@query("select l_orderkey, array_to_string(list_sort(list(distinct l_suppkey))[1:4], ',') as roles from lineitem group by 1")
def q34_roles_capped_arrays(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_set("l_suppkey")), 1, 4).alias("r"))
    return per.select("l_orderkey", F.array_join(F.col("r").cast("array<string>"), ",").alias("roles"))


@query("""
with c as (select conv_id, list(case when length(text) % 2 = 0 then 'const ' || role else role end order by turn) as p from conversations group by 1),
y as (select c.conv_id, [replace(v, 'const ', '') for v in c.p] as p, [replace(v, 'const ', '') for v in q.p] as q from c join c as q on q.conv_id = c.conv_id - 1)
select conv_id, p <> q as changed from y""")
def q35_param_list_changed(spark, d):
    role = F.when(F.length("text") % 2 == 0, F.concat(F.lit("const "), "role")).otherwise(F.col("role"))
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role.alias("role")))).alias("p")).select("conv_id", F.col("p.role").alias("p"))
    pairs = lists.join(lists.select((F.col("conv_id") + 1).alias("conv_id"), F.col("p").alias("q")), "conv_id")
    return pairs.select("conv_id", changes.signature_differs(F.lit(""), F.lit(""), F.col("q"), F.col("p")).alias("changed"))


@query("""
with r as (select o_custkey, o_orderstatus, o_orderkey as new_key, lead(o_orderkey) over w as old_key, row_number() over w as rn
           from orders window w as (partition by o_custkey, o_orderstatus order by o_orderdate desc, o_orderkey desc))
select o_custkey, o_orderstatus, new_key, old_key from r where rn = 1 and old_key is not null
qualify row_number() over (partition by o_custkey order by o_orderstatus desc) <= 2""")
def q36_control_pairs(spark, d):
    pairs = corpus.control_pairs(table(spark, d, "orders"), "o_custkey", "o_orderstatus", [F.desc("o_orderdate"), F.desc("o_orderkey")], ["o_orderkey"], each=2)
    return pairs.select("o_custkey", "o_orderstatus", F.col("new.o_orderkey").alias("new_key"), F.col("old.o_orderkey").alias("old_key"))


@query(f"""with {_HEADER_SQL}
select count(*) as with_data, count(*) filter (definitions_common > 0) as with_definitions, count(*) filter (inline_body_changed > 0) as body_changed,
       sum(inline_body_changed)::bigint as body_events, count(*) filter (inline_decl_changed > 0) as macro_changed, sum(inline_decl_changed)::bigint as macro_events,
       count(*) filter (inline_decl_changed > 1) as macro_changed_nonversion, count(*) filter (definitions_removed * 2 > definitions_1) as poor_coverage,
       median(inline_body_changed) filter (inline_body_changed > 0) as body_median, max(inline_body_changed) filter (inline_body_changed > 0) as body_max
from h""")
def q37_header_churn_block(spark, d):
    h = headers.compare_definitions(*_header_sides(spark, d), ["id"])
    h = h.select("definitions_common", "inline_body_changed", F.col("inline_decl_changed").alias("macro_value_changed"), (F.col("inline_decl_changed") - F.when(F.col("inline_decl_changed") > 0, 1).otherwise(0)).alias("macro_value_changed_nonversion"), (F.col("definitions_removed") * 2 > F.col("definitions_1")).alias("poor"))
    return headers.churn(h)


@query(f"""with {TRANSITIONS}
select count(*) as transitions, count(distinct source) as sources, count(*) filter (not soname_changed) as kept, count(*) filter (soname_changed) as mass_rename,
       count(distinct source) filter (not soname_changed) as kept_sources from t""")
def q38_corpus_summary(spark, d):
    return prevalence.corpus_summary(transitions(spark, d).withColumn("mass_rename", F.col("soname_changed")), "id", "source")


_RULES = (("contact", r"@[a-z0-9]+\.", "1"), ("number", r"[0-9]{6,}", "1"), ("symbols", r"[%$#&*]{3}", "1"), ("shout", r"[A-Z]{6,}", "1"), ("plain", r"", "1"))


@query("""
with r as (select doc_id, case when regexp_matches(text, '@[a-z0-9]+\\.') then 'contact' when regexp_matches(text, '[0-9]{6,}') then 'number'
  when regexp_matches(text, '[%$#&*]{3}') then 'symbols' when regexp_matches(text, '[A-Z]{6,}') then 'shout' else 'plain' end as tag from documents)
select doc_id, tag from r""")
def q39_tagger_first_match(spark, d):
    return reports.first_match(table(spark, d, "documents").select("doc_id", "text"), "text", _RULES).select("doc_id", "tag")


@query("""
select vec_id, label, len(embedding) as dims, list_max(embedding) as most, list_min(embedding) as least, embedding[1] as first_value,
       list_contains(embedding, list_max(embedding)) as holds, len(list_filter(embedding, lambda x: x > 0))::int as positive from embeddings""")
def q40_embeddings_array_ops(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", "label", F.size(e).cast("bigint").alias("dims"), F.array_max(e).alias("most"), F.array_min(e).alias("least"), F.get(e, 0).alias("first_value"), F.array_contains(e, F.array_max(e)).alias("holds"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"))
