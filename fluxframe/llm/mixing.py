"""Mixing of sources to target weights by Pareto order sampling.

Every source has a share of the budget in words, never more than most times its size. Within a source a document's expected
copies grow with its weight: by default the bits of its size, so that a document of ten times the words comes up only some
three times as often. The whole part of the expected copies is certain; for the rest documents are ranked by random odds
divided by the odds of their fraction, and the first ones fill what is left of the target: the sample's size is fixed in words.
The last document is taken if that brings the source nearer to its target, so a source is off by half a document at most.

No source is sorted. A source's threshold is found by counting words in ranges of the rank, then in ranges of the range in
which the target lies, until few documents are left there: these counts combine before they are shuffled, whatever the
source's share of the rows. Random numbers are digests of seed and id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, maybe_broadcast, text_or_empty

WEIGHTS = (3, 1, 2)
#: Words of the mix in percent of all words, and copies of a document at most.
BUDGET, MOST = 150, 2
SEED = "mix"
#: Bits of a rank, and of those how many one pass over the documents looks at.
BITS, STEP = 50, 10
#: Documents in the range of a source's threshold that are few enough to be ranked one by one.
FEW = 10_000


def n_words(text: Column) -> Column:
    """Words of a text; null has none. Each begins after white space or at the start."""
    parts = F.split(text, SPACE)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - (F.element_at(parts, -1) == "").cast("int") + ((F.size(parts) == 1) & (parts[0] == "")).cast("int")).cast("bigint")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of every source of rows(source, size).

    Sources are numbered by code point, null last, and weigh weights in turn. A pass gives all uncapped sources the rest of the
    budget by weight and caps those above most times their size; the passes end when none is above. Sources are numbered and
    summed up by Spark; of them the driver sees only sums.
    """
    sizes = cut(rows.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")))
    spark = rows.sparkSession
    numbered = sizes.orderBy(F.col("source").isNull(), "source").rdd.zipWithIndex().map(lambda x: (x[0]["source"], x[0]["source_size"], weights[x[1] % len(weights)]))
    left = cut(spark.createDataFrame(numbered, "source string, source_size bigint, weight bigint"))
    words = left.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    capped, share = 0, None
    above = F.lit(False)
    while True:
        r = left.agg(F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)), F.count_if(above)).first()
        weight, full, n = r
        if not weight or share is not None and n == capped:
            break
        # whole numbers up to the two divisions, so that every order of sums gives the same double
        share, capped = (budget * words - 100 * most * full) / 100.0 / weight, n
        above = F.lit(share) * F.col("weight") > most * F.col("source_size")
    target = F.when(above | F.lit(not weight), (most * F.col("source_size")).cast("double")).otherwise(F.lit(share) * F.col("weight"))
    return left.select("source", "source_size", target.alias("target"))


def _expected(rows: DataFrame, goals: DataFrame, most: int) -> DataFrame:
    """(source, weight, certain, part, rest): copies of a source's documents of a weight, and the words that parts are to fill.

    Copies are c times the weight, most at most, with c such that they sum up to the target.
    """
    own = Window.partitionBy("source").orderBy(F.desc("weight"))
    classes = rows.filter("weight > 0").groupBy("source", "weight").agg(F.sum("size").cast("bigint").alias("words"))
    named = goals.withColumnRenamed("source", "_s")
    j = classes.join(maybe_broadcast(named), _same("source", "_s")).drop("_s")
    j = j.withColumns({"_over": F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, -1)), "_under": F.sum(F.col("weight") * F.col("words")).over(own.rowsBetween(0, Window.unboundedFollowing))})
    j = j.withColumn("_c", (F.col("target") - most * F.coalesce(F.col("_over"), F.lit(0))) / F.col("_under"))
    # the first weight that is not at its most
    j = j.withColumn("_c", F.first(F.when(F.col("_c") * F.col("weight") <= most, F.col("_c")), True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    copies = F.when((F.col("target") >= most * F.col("source_size")) | F.col("_c").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("_c") * F.col("weight"))))
    j = j.withColumn("_e", copies).withColumn("certain", F.floor("_e").cast("bigint"))
    whole = Window.partitionBy("source")
    return j.select("source", "weight", "certain", (F.col("_e") - F.col("certain")).alias("part"), (F.col("target") - F.sum(F.col("certain") * F.col("words")).over(whole)).alias("rest"))


def rank(doc_id: Column, part: Column, seed: str = SEED) -> Column:
    """The Pareto rank of a document as a whole number of BITS bits: random odds by inclusion odds, squeezed into the unit interval."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))
    odds = (u / (1 - u)) / (part / (1 - part))
    return F.least(F.floor(odds / (1 + odds) * F.lit(float(1 << BITS))).cast("bigint"), F.lit((1 << BITS) - 1))


def _thresholds(sample: DataFrame, few: int) -> DataFrame:
    """(source, rank, id, size, n): of the sample, all before (rank, id, size) of a source are taken, and n of those that equal it.

    sample(source, id, size, rank, rest) is cut. A source whose sample does not reach its rest has no row: all of it is taken.
    """
    by = Window.partitionBy("source").orderBy("at")
    state = None
    for shift in range(BITS - STEP, -1, -STEP):
        inside = sample.withColumn("before", F.lit(0).cast("bigint")) if state is None else _within(sample, state)
        counts = inside.groupBy("source", F.shiftright("rank", shift).alias("at")).agg(F.sum("size").cast("bigint").alias("words"), F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        run = counts.withColumn("upto", F.col("before") + F.sum("words").over(by)).filter("upto >= rest")
        first = run.groupBy("source").agg(F.min_by(F.struct("at", (F.col("upto") - F.col("words")).alias("before"), "n"), "at").alias("x"))
        state = cut(first.select("source", F.col("x.at").alias("at"), F.lit(shift).alias("shift"), F.col("x.before").alias("before"), F.col("x.n").alias("n")))
        if (state.agg(F.max("n")).first()[0] or 0) <= few:
            break
    # documents of one rank, id and size are alike in all that the mix returns, and count as one with a number
    keys = _within(sample, state).groupBy("source", "rank", "id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    order = Window.partitionBy("source").orderBy("rank", F.col("id").asc_nulls_first(), "size")
    keys = keys.withColumn("before", F.col("before") + F.sum(F.col("n") * F.col("size")).over(order) - F.col("n") * F.col("size"))
    # of the i-th of them, taken are those with 2 * (before + i * size) + size < 2 * rest
    fit = F.ceil((2 * F.col("rest") - 2 * F.col("before") - F.col("size")) / (2 * F.col("size"))).cast("bigint")
    keys = keys.withColumn("fit", F.least(F.greatest(fit, F.lit(0)), F.col("n")))
    one = F.struct("rank", F.struct("id", "size").alias("key"), "fit")
    last = keys.groupBy("source").agg(F.coalesce(F.min(F.when(F.expr("fit < n"), one)), F.max(one)).alias("x"))
    return cut(last.select(F.col("source").alias("_s"), F.col("x.rank").alias("_rank"), F.col("x.key").alias("_key"), F.col("x.fit").alias("_fit")))


def _within(sample: DataFrame, state: DataFrame) -> DataFrame:
    """The sample's rows in the range of their source's threshold."""
    shift = state.first()
    known = state.select(F.col("source").alias("_s"), "at", "before")
    j = sample.join(maybe_broadcast(known), _same("source", "_s")).drop("_s")
    return j.filter(F.shiftright("rank", shift["shift"] if shift else 0) == F.col("at")).drop("at")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, budget: int = BUDGET, most: int = MOST, seed: str = SEED, few: int = FEW) -> DataFrame:
    """(id_col, size, source_size, target, taken) of every document: its words, its source's, and the words that the mix takes of it.

    weight_col may name a column of whole numbers by which a document's copies grow; null or less than one is one. A null or empty text
    has no words and is never taken; a very long one counts whole. A null source is a source. Rows that share an id share
    its random number; rows that share id, source and size are alike, and so many of them as fit are taken. An empty table
    gives an empty result. Other columns are not looked at, whatever their names.
    """
    doc = lambda c: F.col(f"`{c}`")
    rows = docs.select(doc(id_col).alias("id"), doc(source_col).cast("string").alias("source"), n_words(text_or_empty(f"`{text_col}`")).alias("size"), (doc(weight_col).cast("bigint") if weight_col else F.lit(None).cast("bigint")).alias("weight"))
    weight = F.coalesce(F.greatest(F.col("weight"), F.lit(1)), F.lit(1)) if weight_col else F.length(F.bin("size")).cast("bigint")
    rows = cut(rows.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0)))
    goals = cut(targets(rows, weights, budget, most))
    copies = cut(_expected(rows, goals, most))
    named = copies.select(F.col("source").alias("_s"), F.col("weight").alias("_w"), "certain", "part", "rest")
    known = rows.join(maybe_broadcast(named), _same("source", "_s") & (F.col("weight") == F.col("_w")), "left").drop("_s", "_w", "weight")
    known = cut(known.withColumn("rank", F.when(F.col("part") > 0, rank(F.col("id"), F.col("part"), seed))).withColumn("row", F.monotonically_increasing_id()))
    last = _thresholds(known.filter("rank is not null").select("source", "id", "size", "rank", "rest"), few)
    j = known.join(maybe_broadcast(last), _same("source", "_s"), "left").drop("_s")
    here, there = F.struct(F.col("rank").alias("r"), F.struct("id", "size").alias("k")), F.struct(F.col("_rank").alias("r"), F.col("_key").alias("k"))
    at = F.col("_rank").isNotNull() & (F.col("rank") == F.col("_rank")) & F.struct("id", "size").eqNullSafe(F.col("_key"))
    j = j.withColumn("_at", F.coalesce(at, F.lit(False)))
    sampled = F.when(F.col("rank").isNull(), 0).when(F.col("_rank").isNull() | (here < there), 1).otherwise(0)
    j = j.withColumn("_more", F.when(F.col("_at"), 0).otherwise(sampled))
    # which of a threshold's equal rows: a row's number is its number in its partition after those of the partitions before
    equal = cut(j.filter("_at and _fit > 0").select("source", "row", "_fit", F.shiftrightunsigned("row", 33).alias("_p")))
    ahead = equal.groupBy("source", "_p").agg(F.count(F.lit(1)).alias("n")).withColumn("ahead", F.sum("n").over(Window.partitionBy("source").orderBy("_p")) - F.col("n"))
    ahead = ahead.select(F.col("source").alias("_s"), F.col("_p").alias("_q"), "ahead")
    numbered = equal.join(maybe_broadcast(ahead), _same("source", "_s") & (F.col("_p") == F.col("_q"))).withColumn("i", F.col("ahead") + F.row_number().over(Window.partitionBy("source", "_p").orderBy("row")))
    chosen = cut(numbered.filter("i <= _fit").select(F.col("row").alias("_row")))
    j = j.join(maybe_broadcast(chosen), F.col("row") == F.col("_row"), "left").withColumn("_more", F.when(F.col("_row").isNotNull(), 1).otherwise(F.col("_more")))
    named = goals.withColumnRenamed("source", "_s")
    j = j.join(maybe_broadcast(named), _same("source", "_s"), "left")
    return j.select(F.col("id").alias(id_col), "size", "source_size", "target", ((F.coalesce(F.col("certain"), F.lit(0)) + F.col("_more")) * F.col("size")).cast("bigint").alias("taken"))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
with d as materialized (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
n as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as i from d group by source),
w as (select *, [{', '.join(map(str, WEIGHTS))}][i % {len(WEIGHTS)} + 1] as weight, sum(source_size) over () as words from n),
o as (select *, cast({BUDGET} * words - 100 * {MOST} * coalesce(sum(source_size) over (order by source_size / weight, i rows between unbounded preceding and 1 preceding), 0) as double) / 100.0
  / sum(weight) over (order by source_size / weight, i rows between current row and unbounded following) as share from w),
h as (select max(share) as share from o where share * weight <= {MOST} * source_size),
t as materialized (select source, source_size, case when share is null or share * weight > {MOST} * source_size then cast({MOST} * source_size as double) else share * weight end as target from w, h),
k as (select source, length(bin(size)) as weight, cast(sum(size) as bigint) as words from d where size > 0 group by all),
x as (select k.*, target, source_size, (target - {MOST} * coalesce(sum(words) over (partition by k.source order by weight desc rows between unbounded preceding and 1 preceding), 0))
  / sum(weight * words) over (partition by k.source order by weight desc rows between current row and unbounded following) as c from k join t on k.source is not distinct from t.source),
y as (select *, arg_max(case when c * weight <= {MOST} then c end, case when c * weight <= {MOST} then weight end) over (partition by source) as cc from x),
z as (select *, case when target >= {MOST} * source_size or cc is null then {MOST}.0::double else least({MOST}.0::double, cc * weight) end as e from y),
e as (select source, weight, cast(floor(e) as bigint) as certain, e - floor(e) as part, target - sum(cast(floor(e) as bigint) * words) over (partition by source) as rest from z),
u as (select d.*, certain, part, rest, (cast(('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 13)) as bigint) + 0.5::double) / {1 << 52}::double as u
  from d left join e on d.source is not distinct from e.source and length(bin(size)) = e.weight and size > 0),
r as (select *, case when part > 0 then (u / (1 - u)) / (part / (1 - part)) end as odds from u),
q as (select *, least(cast(floor(odds / (1 + odds) * {1 << BITS}::double) as bigint), {(1 << BITS) - 1}) as rank from r),
b as (select *, sum(case when rank is not null then size else 0 end) over (partition by source order by rank nulls last, doc_id nulls first, size rows between unbounded preceding and current row) - size as before from q)
select doc_id, size, source_size, target, cast((coalesce(certain, 0) + case when rank is not null and 2 * before + size < 2 * rest then 1 else 0 end) * size as bigint) as taken
from b join t on b.source is not distinct from t.source"""
