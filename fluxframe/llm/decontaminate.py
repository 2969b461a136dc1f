"""Benchmark decontamination by winnowing.

Of every 6 consecutive 8-word fingerprints the smallest is kept (the rightmost of equal ones), so two texts that share 13
words in a row keep at least one common fingerprint at matching places (Schleimer, Wilkerson, Aiken 2003). A document's
fingerprints that some item has too are extended to the 13-word windows around them, and these are joined to the items' windows
by a digest of their words. So a phrase shorter than a window costs its fingerprints, however many documents and items have it,
and no pair of a document and an item is made before a whole window is known to be shared. Windows that the same items have
share one set of items, which a document meets once. Items of fewer than 13 words are matched whole, by one fingerprint for
each length that occurs.

Fingerprints are taken inside a row with array functions, without a shuffle. The join broadcasts the benchmark's
fingerprints if they are counted to be few, and shuffles both sides otherwise. Only texts with a common fingerprint are
read again. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, maybe_broadcast, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARED, GRAM = 13, 8
WINDOW = SHARED - GRAM + 1
#: A fingerprint packs 38 bits of hash above the low 26 bits of its place, so that one minimum finds both.
PLACE = 26
#: The same words before A-Z are lower-cased; counting them needs no copy of the text.
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(df: DataFrame, text_col: str, out: str = "words") -> DataFrame:
    return df.withColumn(out, F.regexp_extract_all(ascii_lower(text_or_empty(text_col)), F.lit(WORD), F.lit(0))).drop(text_col)


def _grams(k: int) -> str:
    """SQL: fingerprints of all k-word runs of _h."""
    mask = (1 << PLACE) - 1
    run = "xxhash64(" + ", ".join(f"_h[i + {j}]" for j in range(k)) + ")"
    return f"transform(sequence(0, size(_h) - {k}), i -> shiftleft(shiftrightunsigned({run}, {PLACE}), {PLACE}) | ({mask} - (i & {mask})))"


def fingerprints(worded: DataFrame, short: list[int], whole_only: bool) -> DataFrame:
    """worded(words, ...) with _fp, array<struct<hash, place>>.

    short: lengths below 13 whose runs are all taken. whole_only: the text itself is the run (an item), so only a text of
    exactly that length has it.
    """
    mask = (1 << PLACE) - 1
    d = worded.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
    d = d.withColumn("_g", F.expr(f"case when size(_h) >= {SHARED} then {_grams(GRAM)} else array() end"))
    pick = "least(" + ", ".join(f"_g[i + {j}]" for j in range(WINDOW)) + ")"
    hashed = lambda x, k: f"shiftrightunsigned({x}, {PLACE}) + shiftleft({k}L, {64 - PLACE})"
    windows = f"sequence(0, size(_g) - {WINDOW})"
    short_text = f"transform(array_distinct(transform({windows}, i -> {pick})), x -> named_struct('hash', {hashed('x', 0)}, 'place', cast({mask} - (x & {mask}) as int)))"
    # places above 26 bits: the window says where its smallest fingerprint is
    long_text = f"array_distinct(transform({windows}, i -> named_struct('hash', {hashed(pick, 0)}, 'place', cast(i + pmod({mask} - ({pick} & {mask}) - i, {1 << PLACE}L) as int))))"
    parts = [f"case when size(_g) < {WINDOW} then array() when size(_g) < {1 << PLACE} then {short_text} else {long_text} end"]
    for k in short:
        test = f"size(_h) = {k}" if whole_only else f"size(_h) >= {k}"
        parts.append(f"case when {test} then transform({_grams(k)}, (x, i) -> named_struct('hash', {hashed('x', k)}, 'place', i)) else array() end")
    return d.withColumn("_fp", F.expr(f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0])).drop("_h", "_g")


def _digest(start: str, n: str) -> str:
    """SQL: 128 bits that stand for n words from start on; no word holds a space."""
    return f"md5(array_join(slice(words, {start} + 1, {n}), ' '))"


def item_sets(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((window, set), (set, item)): every window of items(item, words), and the items that have it, as a set that other windows may share.

    A set is known by sums of its items' hashes, so no window gathers its items.
    """
    size = f"least({SHARED}, size(words))"
    every = f"array_distinct(transform(sequence(0, size(words) - {size}), i -> {_digest('i', size)}))"
    pairs = cut(items.select("item", F.explode_outer(F.expr(every)).alias("window")).distinct())
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "item").cast("decimal(38, 0)")).cast("string")
    sets = cut(pairs.groupBy("window").agg(F.md5(F.concat_ws(":", total(1), total(2), F.count(F.lit(1)).cast("string"))).alias("set")))
    one = sets.groupBy("set").agg(F.min("window").alias("window"))
    return sets, cut(pairs.join(one, "window").select("set", "item"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items, contaminated) of every row of docs.

    A word is hit if it lies in a run of 13 words that some item has too, or in a whole item of fewer words. items holds
    the distinct ids, as text, of the items with such a run, sorted. contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    Null and empty texts have no words; very long ones are read whole, with places beyond 26 bits told by their windows.
    Repeated rows get equal results; rows that share an id are told apart by their text. Items without an id or without words
    are passed over. Empty tables on either side are fine; other columns are not looked at, whatever their names.
    """
    items = cut(words_of(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("_t")), "_t").filter("item is not null and size(words) > 0"))
    short = sorted(r[0] for r in items.select(F.size("words")).filter(F.size("words") < SHARED).distinct().collect())  # 12 numbers at most
    item_fp = cut(fingerprints(items, short, True).select(F.explode_outer("_fp").alias("f")).select(F.col("f.hash").alias("hash")).filter("hash is not null").distinct())
    sets, members = item_sets(items)

    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    # equal rows share a key, and so their hits
    keyed = base.withColumn("_key", F.xxhash64(F.lit(1), "_id", "_t")).withColumn("_key2", F.xxhash64(F.lit(2), "_t", "_id"))
    worded = words_of(keyed, "_t")
    doc_fp = fingerprints(worded, short, False).select("_key", "_key2", F.explode_outer("_fp").alias("f")).select("_key", "_key2", F.col("f.hash").alias("hash"), F.col("f.place").alias("place"))
    # explode_outer: from explode the optimizer infers a filter, and pushing it down would compute the arrays once per element
    # a fingerprint that very many documents have: the few rows of the benchmark side are broadcast, or Spark splits the hot partition
    met = doc_fp.join(maybe_broadcast(item_fp), "hash", "left_semi").select("_key", "_key2", F.struct("place", F.shiftrightunsigned("hash", 64 - PLACE).cast("int").alias("k")).alias("m"))
    met = cut(met.groupBy("_key", "_key2").agg(F.collect_set("m").alias("_m")))  # at most a text's own fingerprints
    again = worded.join(maybe_broadcast(met.select("_key", "_key2")), ["_key", "_key2"], "left_semi").drop("_id").dropDuplicates(["_key", "_key2"])
    around = f"transform(sequence(greatest(0, m.place - {WINDOW - 1}), least(m.place, size(words) - {SHARED})), s -> named_struct('a', s, 'n', {SHARED}))"
    around = f"array_distinct(flatten(transform(_m, m -> case when m.k = 0 then {around} else array(named_struct('a', m.place, 'n', m.k)) end)))"
    digests = f"transform({around}, w -> named_struct('a', w.a, 'b', w.a + w.n, 'window', {_digest('w.a', 'w.n')}))"
    windows = met.join(again, ["_key", "_key2"]).select("_key", "_key2", F.explode_outer(F.expr(digests)).alias("w")).select("_key", "_key2", "w.*")
    runs = cut(windows.join(maybe_broadcast(sets), "window").select("_key", "_key2", "a", "b", "set"))
    spans = runs.select("_key", "_key2", "a", "b").groupBy("_key", "_key2", "a").agg(F.max("b").alias("b"))
    seen = "max(b) over (partition by _key, _key2 order by a rows between unbounded preceding and 1 preceding)"
    hits = spans.selectExpr("_key", "_key2", f"greatest(0, b - greatest(a, coalesce({seen}, a))) as n").groupBy("_key", "_key2").agg(F.sum("n").alias("n_hit"))
    named = runs.select("_key", "_key2", "set").distinct().join(maybe_broadcast(members), "set").select("_key", "_key2", "item").distinct()
    found = named.groupBy("_key", "_key2").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = cut(hits.join(found, ["_key", "_key2"]))
    n_words = F.regexp_count(text_or_empty("_t"), F.lit(_ANY_CASE)).cast("bigint").alias("n_words")
    out = keyed.select("_id", "_key", "_key2", n_words).join(maybe_broadcast(found), ["_key", "_key2"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(names).cast("bigint").alias("n_items"), names.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated rows, in the columns they had. Rows that share an id go together; rows without one stay."""
    bad = cut(contamination(docs, benchmark, id_col, text_col).filter("contaminated").select(F.col(id_col).alias("id")).distinct())
    bad = maybe_broadcast(bad)
    return docs.join(bad, docs[id_col] == bad["id"], "left_anti")


def decontamination_query(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = rf"""
with d as (select doc_id, regexp_extract_all(lower_ascii, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as ws from
  (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)),
b as (select item_id, regexp_extract_all(lower_ascii, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as ws from
  (select item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from benchmark)),
iw as (select distinct item_id, least({SHARED}, len(ws)) as k, unnest([array_to_string(ws[i:i + least({SHARED}, len(ws)) - 1], ' ') for i in range(1, len(ws) - least({SHARED}, len(ws)) + 2)]) as w from b where len(ws) > 0),
ks as (select distinct k from iw),
u as (select doc_id, unnest(ws) as x, unnest(range(1, len(ws) + 1)) as p from d),
dw as (select doc_id, p, list(x) over (partition by doc_id order by p rows between current row and {SHARED - 1} following) as run from u),
h as (select doc_id, ks.k, p, item_id from dw join ks on len(run) >= ks.k join iw on ks.k = iw.k and array_to_string(run[1:ks.k], ' ') = iw.w),
c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from h) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join c on d.doc_id = c.doc_id left join i on d.doc_id = i.doc_id"""
