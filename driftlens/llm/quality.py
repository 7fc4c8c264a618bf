"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts are computed for every text within its row, without a shuffle. The
further rules run in an order by rejection per cost, both estimated on a sample;
a text that one rule rejects doesn't reach the next. The order decides only how
much is computed: a text is kept if no rule rejects it, in any order.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WS = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, lines (those with a word) and the base counts."""
    t = F.col("text")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(t.cast("string"), F.lit("")).alias("text"))
    out = out.select("doc_id", "text", F.filter(F.split(t, WS), lambda w: w != "").alias("words"), F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "").alias("lines"))
    # windows as (hash, place), sorted: windows found twice stand side by side
    window = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    out = out.withColumn("windows", F.when(F.size("words") > 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window))))
    same = lambda w, k: F.coalesce(F.get("windows", k)["h"] == w["h"], F.lit(False))
    out = out.withColumn("places", F.sort_array(F.transform(F.filter("windows", lambda w, k: same(w, k - 1) | same(w, k + 1)), lambda w: w["i"])))
    covered = F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3))))
    repeat = F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        "text",
        "words",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _BLANKS, "")).cast("long").alias("word_chars"),
        count_of(t, SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
    )


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def default_rules() -> dict[str, Column]:
    """Rejection rules over the columns of with_base()."""
    n = F.col("n_words")
    return {
        "symbols": 100 * F.col("n_symbols") > 30 * n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 16 * n),
        "duplicate_lines": 100 * F.col("n_dup_lines") > 30 * F.size("lines"),
        "exclamations": 100 * count_of(F.col("text"), "!") > 30 * n,
        "capitals": 100 * (F.col("word_chars") - F.length(F.regexp_replace("text", r"[\p{Lu}\s]+", ""))) > 50 * F.col("word_chars"),
        # every window of 20 words; its ends are compared first, so few are cut out
        "one_word": (n >= 20) & F.exists(F.sequence(F.lit(0), F.greatest(n.cast("int") - 20, F.lit(0))), lambda i: (F.get("words", i) == F.get("words", i + 19)) & (F.size(F.array_distinct(F.slice("words", i + 1, 20))) == 1)),
    }


def planned(base: DataFrame, rules: dict[str, Column], sample: int = 1000) -> list[str]:
    """The rules' names by rejection per cost on at most sample rows, best first."""
    # the sample goes by the hash of doc_id, so that it comes from all of the table
    some = base.where(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0).limit(sample)
    some = common.checkpointed(some)
    rows = max(1, some.count())
    share = some.agg(*[F.sum(F.coalesce(r, F.lit(False)).cast("long")).alias(k) for k, r in rules.items()]).first().asDict()
    began = time.perf_counter()
    some.agg(F.count(F.lit(1))).collect()
    idle = time.perf_counter() - began
    cost = {}
    for k, rule in rules.items():
        began = time.perf_counter()
        some.agg(F.count_if(rule)).collect()
        cost[k] = max(1e-4, time.perf_counter() - began - idle)
    return sorted(rules, key=lambda k: (-((share[k] or 0) / rows) / cost[k], k))


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules aren't evaluated then."""
    out = None
    for k in order:
        out = F.when(rules[k], F.lit(k)) if out is None else out.when(rules[k], F.lit(k))
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, min_words: int = 50, repeat_percent: int = 50, sample: int = 1000) -> DataFrame:
    """Returns doc_id, the base counts, base_failed, kept and rejected_by, a row for each row of docs.

    A null or empty text has no words and fails the base. Rows that repeat are
    judged each for itself; null ids stay null. Other columns are ignored. An
    empty table gives an empty result. Windows are told apart by 64-bit hashes
    within one text.
    """
    rules = default_rules() if rules is None else rules
    base = with_base(docs)
    order = planned(base, rules, sample)
    out = base.withColumn("base_failed", base_failed(min_words, repeat_percent))
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(rules, order)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).drop("rejected_by")


ORACLE_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
tri as (
  select doc_id, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
grams as (select doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g from tri),
twice as (select doc_id, unnest(list(i)) as i from grams group by doc_id, g having count(*) >= 2),
covered as (
  select doc_id, count(distinct p) as n from (select doc_id, i + unnest([0, 1, 2]) as p from twice) group by doc_id),
base as (
  select w.doc_id, text, words, lines, len(words) as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(n, 0) as n_repeat_words
  from w left join covered on covered.doc_id = w.doc_id),
failed as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not (base_failed
            or 100 * n_symbols > 30 * n_words
            or word_chars < 2 * n_words or word_chars > 16 * n_words
            or 100 * n_dup_lines > 30 * len(lines)
            or 100 * (length(text) - length(translate(text, '!', ''))) > 30 * n_words
            or 100 * (word_chars - length(regexp_replace(text, '[\p{Lu}\s]+', '', 'g'))) > 50 * word_chars
            or (n_words >= 20 and len(list_filter(range(0, greatest(n_words - 20, 0) + 1), lambda i: words[i + 1] = words[i + 20] and len(list_distinct(words[i + 1:i + 20])) = 1)) > 0)) as kept
from failed
"""
