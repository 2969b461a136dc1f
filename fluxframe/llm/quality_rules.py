"""Quality rules whose thresholds follow the corpus: quantile sketches for each language and source set them.

The sketch is a histogram of logarithmic buckets with 32 steps to an octave, so a quantile is off by 3 % at most and two
sketches merge by adding counts: it is built by partial aggregation, a hot source costs no more than others, and the
result is the same for any partitioning. A group's fences lie SPREAD mean deviations above and below its median, all read
off the sketch; a metric that nearly all texts have at 0 gets its spread from the few that do not. There are no fixed
cutoffs. Small groups are drawn towards their language, and a language towards all rows, by a weight that is smooth in
their rows: PRIOR rows count as much as the parent. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, maybe_broadcast, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Metric and integer expression. Shares are in thousandths, the mean word length in hundredths.
METRICS = (
    ("symbols", "n_symbols * 1000 div greatest(word_chars, 1)"),
    ("dup_lines", "n_dup_lines * 1000 div greatest(n_lines, 1)"),
    ("repeats", "n_repeat_words * 1000 div greatest(n_words, 1)"),
    ("upper", "n_upper * 1000 div greatest(word_chars, 1)"),
    ("marks", "n_marks * 1000 div greatest(word_chars, 1)"),
    ("word_length", "word_chars * 100 div greatest(n_words, 1)"),
)
#: Rows by which a group's parent counts.
PRIOR = 100
#: Mean deviations from the median to a fence: of an exponential tail 1 in 1,100 lies beyond.
SPREAD = 7
#: Bits of the place up to which a text's window hashes are sorted as plain numbers, with 52 bits of hash above them.
PLACE = 12


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper and n_marks; text_col goes.

    n_repeat_words is found without a shuffle: the hashes of a text's word windows are sorted with their places, equal
    neighbours are repeated windows, and the union of those windows is summed up. Long texts are sorted by whole 64-bit
    hashes, short ones by 52 bits with the place in the rest, so that no text has equal ones by chance.
    """
    t = F.col("_t")
    long = lambda c: c.cast("bigint")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    d = docs.withColumn("_t", text_or_empty(text_col))
    d = d.withColumns({"_w": F.filter(F.split(t, SPACE), lambda w: w != ""), "_lines": lines})
    d = d.select(
        *(c for c in docs.columns if c != text_col),
        long(F.size("_w")).alias("n_words"), long(_without(t, " \t\n\x0b\x0c\r")).alias("word_chars"),
        long(F.length(t) - _without(t, SYMBOLS)).alias("n_symbols"), long(F.length(t) - _without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"), long(F.length(t) - _without(t, "!?")).alias("n_marks"),
        long(F.size("_lines")).alias("n_lines"), long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    gram = "xxhash64(" + ", ".join(f"_h[i + {j}]" for j in range(WINDOW)) + ")"
    places = f"sequence(0, size(_h) - {WINDOW})"
    twice = lambda part: f"filter(s, (x, i) -> coalesce({part('x')} = {part('get(s, i - 1)')}, false) or coalesce({part('x')} = {part('get(s, i + 1)')}, false))"
    short = f"transform(array(sort_array(transform({places}, i -> shiftleft(shiftrightunsigned({gram}, {PLACE}), {PLACE}) | i))), s -> transform({twice(lambda x: f'shiftrightunsigned({x}, {PLACE})')}, x -> x & {(1 << PLACE) - 1}L))[0]"
    whole = f"transform(array(sort_array(transform({places}, i -> named_struct('g', {gram}, 'i', cast(i as bigint))))), s -> transform({twice(lambda x: f'{x}.g')}, x -> x.i))[0]"
    d = d.withColumn("_p", F.expr(f"sort_array(case when size(_h) < {WINDOW} then cast(array() as array<bigint>) when size(_h) < {1 << PLACE} then {short} else {whole} end)")).drop("_h")
    covered = f"aggregate(transform(_p, (p, i) -> least({WINDOW}L, coalesce(get(_p, i + 1) - p, {WINDOW}L))), 0L, (a, x) -> a + x)"
    return d.withColumn("n_repeat_words", F.expr(covered)).drop("_p")


def bucket(v: str) -> str:
    """SQL: the bucket of a non-negative integer; 64 and up have 32 to an octave."""
    return f"case when {v} < 64 then {v} else (length(bin({v})) - 6) * 32 + shiftright({v}, length(bin({v})) - 6) end"


def bucket_top(b: str) -> str:
    """SQL: the largest integer of a bucket."""
    return f"case when {b} < 64 then {b} else shiftleft({b} - (({b} - 32) div 32) * 32 + 1, cast(({b} - 32) div 32 as int)) - 1 end"


def fences(measured: DataFrame, lang: str, source: str, prior: int = PRIOR) -> DataFrame:
    """(lang, source, lo_<metric>, hi_<metric>...): the fences of every language and source."""
    shares = F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(e).alias("v")) for m, e in METRICS))
    counts = measured.select(lang, source, F.explode(shares).alias("x")).groupBy(lang, source, F.col("x.metric").alias("metric"), F.expr(bucket("x.v")).cast("bigint").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts)  # the merged sketch: some hundred rows a group

    def level(name: str, keys: list[str]) -> DataFrame:
        """Rows, median and mean deviations above and below it."""
        keys = [*keys, "metric"]
        part = ", ".join(keys)
        merged = counts.groupBy(*keys, "b").agg(F.sum("n").alias("n")).withColumn("v", F.expr(bucket_top("b")))
        ranked = merged.selectExpr("*", f"sum(n) over (partition by {part} order by b) as upto", f"sum(n) over (partition by {part}) as total")
        middle = ranked.selectExpr("*", f"min(case when upto * 2 >= total then v end) over (partition by {part}) as med")
        mean = lambda e: F.expr(f"cast(sum(n * greatest({e}, 0)) as double) / cast(max(total) as double)")
        return middle.groupBy(*keys).agg(F.max("total").cast("double").alias(f"{name}_n"), F.max("med").cast("double").alias(f"{name}_med"), mean("v - med").alias(f"{name}_up"), mean("med - v").alias(f"{name}_down"))

    own, mid, top = level("own", [lang, source]), level("mid", [lang]), level("top", [])
    j = own.join(maybe_broadcast(mid), [lang, "metric"]).join(F.broadcast(top), "metric")  # top has a row for each metric
    for x in ("med", "up", "down"):
        j = j.withColumn(x, F.expr(_drawn("own", _drawn("mid", f"top_{x}", x, prior), x, prior)))
    j = j.selectExpr(lang, source, "metric", f"round(med - {SPREAD} * down, 6) as lo", f"round(med + {SPREAD} * up, 6) as hi")
    return j.groupBy(lang, source).agg(*(F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m, _ in METRICS for side in ("lo", "hi")))


def _drawn(level: str, parent: str, stat: str, prior: int) -> str:
    """SQL: a level's statistic, drawn towards its parent's."""
    return f"(({level}_n * {level}_{stat} + {prior} * {parent}) / ({level}_n + {prior}))"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: int = PRIOR) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules) of every row.

    A null text has no words. A null language or source counts as the empty one. A very long text is measured whole, and
    its repeated windows are told by full hashes. Ties and repeated rows are judged alike, a value on a fence passes; an
    empty table gives an empty result. Other columns of docs are not looked at, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(lang_col).alias("_lang"), text_or_empty(source_col).alias("_source"), F.col(text_col).alias("_text"))
    m = cut(measure(rows, "_text"))
    table = cut(fences(m, "_lang", "_source", prior))
    # a left join: languages and sources come from m itself, and Spark can split a hot one where the fences are too many to broadcast
    j = m.join(maybe_broadcast(table), ["_lang", "_source"], "left")
    base = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    failed = F.filter(F.array(*(F.expr(f"case when {e} > hi_{name} or {e} < lo_{name} then '{name}' end") for name, e in METRICS)), lambda x: x.isNotNull())
    j = j.withColumns({"base_failed": base, "failed_rules": failed})
    return j.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"))


def quality_rules_query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    div = lambda e: e.replace(" div ", " // ")
    metric_rows = " union all ".join(f"select lang, source, '{m}' as metric, {div(e)} as v from m" for m, e in METRICS)
    b = "case when v < 64 then v else (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) end"
    top = "case when b < 64 then b else ((b - ((b - 32) // 32) * 32 + 1) << ((b - 32) // 32)) - 1 end"

    def level(name: str, keys: str) -> str:
        k = f"{keys}, " if keys else ""
        mean = lambda e: f"cast(sum(n * greatest({e}, 0)) as double) / cast(max(total) as double)"
        return f"""
{name}_c as (select {k}metric, b, {top} as v, sum(n) as n from sketch group by {k}metric, b),
{name}_r as (select *, sum(n) over (partition by {k}metric order by b) as upto, sum(n) over (partition by {k}metric) as total from {name}_c),
{name}_m as (select *, min(case when upto * 2 >= total then v end) over (partition by {k}metric) as med from {name}_r),
{name} as (select {k}metric, cast(max(total) as double) as {name}_n, cast(max(med) as double) as {name}_med, {mean("v - med")} as {name}_up, {mean("med - v")} as {name}_down from {name}_m group by {k}metric)"""

    stat = lambda x: _drawn("own", _drawn("mid", f"top_{x}", x, PRIOR), x, PRIOR)
    bad = lambda m, e: f"({div(e)}) > hi_{m} or ({div(e)}) < lo_{m}"
    sides = ", ".join(f"max(case when metric = '{m}' then {side} end) as {side}_{m}" for m, _ in METRICS for side in ("lo", "hi"))
    return rf"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
u as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from w),
g as (select doc_id, p, list(x) over (partition by doc_id order by p rows between current row and {WINDOW - 1} following) as run from u),
r as (select doc_id, p, count(*) over (partition by doc_id, array_to_string(run, ' ')) as times from g where len(run) = {WINDOW}),
c as (select doc_id, p, lead(p) over (partition by doc_id order by p) as nxt from r where times > 1),
n as (select doc_id, sum(least({WINDOW}, coalesce(nxt - p, {WINDOW}))) as n_repeat_words from c group by doc_id),
m as (select w.doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as bigint) as n_upper,
  cast(length(t) - length(regexp_replace(t, '[!?]', '', 'g')) as bigint) as n_marks, cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
  cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words from w left join n on w.doc_id = n.doc_id),
v as ({metric_rows}),
sketch as (select lang, source, metric, {b} as b, count(*) as n from v group by all),
{level('own', 'lang, source')},
{level('mid', 'lang')},
{level('top', '')},
drawn as (select own.lang, own.source, own.metric, {", ".join(f"{stat(x)} as {x}" for x in ("med", "up", "down"))}
  from own join mid on own.lang = mid.lang and own.metric = mid.metric join top on own.metric = top.metric),
f as (select lang, source, {sides} from (select lang, source, metric, round(med - {SPREAD} * down, 6) as lo, round(med + {SPREAD} * up, 6) as hi from drawn) group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or {" or ".join(bad(m, e) for m, e in METRICS)}) as kept,
  concat_ws(',', {", ".join(f"case when {bad(m, e)} then '{m}' end" for m, e in METRICS)}) as failed_rules
from m join f using (lang, source)"""


ORACLE = _oracle()
