"""Secret scans with corpus-wide ownership: how many owners and repositories hold a value tells examples from live secrets.

A value that many owners hold, or very many repositories, was copied from a manual or a fixture; one that few hold looks
live. Candidate values are hashed, reduced to distinct (value, owner, repository) by partial aggregation, and counted, so
that a value that a third of all rows hold costs no task more than others.

Patterns run once over every text, inside the task that reads it; what leaves it are the lengths of matches and of the
pieces between them, and hashes of the values. Places are running sums of these lengths, in code points and in bytes, so
a text with very many matches costs in proportion to them. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, maybe_broadcast, text_or_empty


def _either_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


#: Kind, pattern, group of the value, least code points of the value. In the order that ties of spans take.
BASE = (
    ("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Added by this operator: public formats of vendors, signed web tokens, private keys; and opaque strings, if few hold them.
ADDED = (
    ("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("opaque", r"[A-Za-z0-9+/_-]{40,}={0,2}", 0, 40),
)
KINDS = BASE + ADDED
OPAQUE = len(KINDS) - 1
#: A value is an example from so many owners on, or from so many repositories on, whoever owns them.
COMMON_OWNERS, COMMON_REPOSITORIES = 3, 100
#: Prefilters, where a cheaper pattern than the kind's own tells whether a text can hold one.
_QUICK = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}
_MATCHES = "array<struct<rank:int,nth:int,gap:int,gap_bytes:int,size:int,size_bytes:int,good:boolean,value_hash:string>>"


def _matches(text: Column, rank: int) -> Column:
    """_MATCHES of one kind, leftmost and non-overlapping: the lengths of the piece before each match and of the match, whether it passes, and its value's hash.

    Spark has no function for the places of all matches; these lengths give them. Only texts that a prefilter lets
    through are split.
    """
    kind, pattern, group, least = KINDS[rank]
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(every(0)))
    zipped = F.arrays_zip(pieces.alias("p"), every(0).alias("m"), every(group).alias("v"))

    def one(x: Column, nth: Column) -> Column:
        good = F.length(x["v"]) >= least
        if rank == OPAQUE:  # of all of digits, capitals and small letters
            good = good & x["v"].rlike("[0-9]") & x["v"].rlike("[A-Z]") & x["v"].rlike("[a-z]")
        return F.struct(
            F.lit(rank).alias("rank"), nth.alias("nth"), F.length(x["p"]).alias("gap"), F.octet_length(x["p"]).alias("gap_bytes"),
            F.length(x["m"]).alias("size"), F.octet_length(x["m"]).alias("size_bytes"), good.alias("good"), F.when(good, F.sha2(x["v"], 256)).alias("value_hash"),
        )

    none = F.array().cast(_MATCHES)
    found = F.transform(zipped, one)
    # a text without a good match costs no row later on
    return F.when(text.rlike(_QUICK.get(kind, pattern)), F.when(F.exists(found, lambda x: x["good"]), found).otherwise(none)).otherwise(none)


def _key(*cols: Column) -> Column:
    """128 bits of a row's id and text; equal rows share it, and so their spans."""
    joined = F.concat_ws("\x00", *(F.coalesce(c.cast("string"), F.lit("\x01")) for c in cols))
    return F.md5(joined)


def ownership(held: DataFrame) -> DataFrame:
    """(value_hash, owners, repositories) of every value of held(value_hash, owner, repository)."""
    one = held.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("x"))
    per_owner = one.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    return per_owner.groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))


def _placed(rows: DataFrame) -> DataFrame:
    """The good matches of rows(_row, ..., _matches), a row each, with start and end in code points and from and upto in bytes."""
    each = rows.withColumn("m", F.explode("_matches")).select(*(c for c in rows.columns if c != "_matches"), "m.*")
    by = "partition by _row, rank order by nth rows between unbounded preceding"
    places = [f"sum(gap + size) over ({by} and current row) as end", f"sum(gap_bytes + size_bytes) over ({by} and current row) as upto"]
    return each.selectExpr("*", *places).filter("good").selectExpr("*", "end - size as start", "upto - size_bytes as `from`").drop("gap", "gap_bytes", "size", "size_bytes", "good", "nth")


def _decided(rows: DataFrame, owners: int, repositories: int) -> DataFrame:
    """(_key, _decided): the spans of every key of rows(_row, _key, _owner, _repo, _matches), by start and kind, with the decision on each.

    before is the byte up to which earlier spans of the row reach.
    """
    each = cut(_placed(rows))
    held = ownership(each.select("value_hash", F.col("_owner").alias("owner"), F.col("_repo").alias("repository")))
    common = (F.col("owners") >= owners) | (F.col("repositories") >= repositories)
    copied = cut(held.filter(common).select("value_hash", F.lit(True).alias("copied")))
    j = each.join(maybe_broadcast(copied), "value_hash", "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    j = j.filter((F.col("rank") != OPAQUE) | ~F.col("copied"))
    j = j.selectExpr("_row", "_key", "struct(start, rank, end, copied, `from`, upto, max(upto) over (partition by _row order by start, rank rows between unbounded preceding and 1 preceding) as before) as s")
    spans = j.groupBy("_row").agg(F.first("_key").alias("_key"), F.array_sort(F.collect_list("s")).alias("_decided"))
    return spans.groupBy("_key").agg(F.first("_decided").alias("_decided"))  # rows of one key have equal spans


_SPANS = "array<struct<start:bigint,kind:string,end:bigint,copied:boolean,from:bigint,upto:bigint,before:bigint>>"


def _scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None, owners: int, repositories: int) -> tuple[DataFrame, DataFrame]:
    """(_id, _key) of every row, _key null where nothing is found; and (_key, _spans as _SPANS)."""
    t = F.col("_text")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(owner_col).alias("_owner"), F.col(repo_col or id_col).alias("_repo"), F.col(text_col).alias("_t"), text_or_empty(text_col).alias("_text"))
    rows = rows.withColumn("_matches", F.concat(*(_matches(t, k) for k in range(len(KINDS)))))
    rows = rows.select("_id", "_owner", "_repo", F.monotonically_increasing_id().alias("_row"), F.when(F.size("_matches") > 0, _key(F.col("_id"), F.col("_t"))).alias("_key"), "_matches")
    rows = cut(rows)  # without the texts
    found = _decided(rows.filter("_key is not null").drop("_id"), owners, repositories)
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    out = F.transform("_decided", lambda s: F.struct(s["start"].alias("start"), names[s["rank"]].alias("kind"), s["end"].alias("end"), s["copied"].alias("copied"), s["from"].alias("from"), s["upto"].alias("upto"), s["before"].alias("before")))
    return rows.select("_id", "_key"), cut(found.select("_key", out.alias("_spans")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, owners: int = COMMON_OWNERS, repositories: int = COMMON_REPOSITORIES) -> DataFrame:
    """(id_col, spans) of every row; spans is array<struct<start, kind, end, copied>> by start and kind.

    start and end count code points. copied tells that at least so many owners or so many repositories hold the value. A
    repository is a row's repo_col with its owner; without repo_col every row is one. Null texts are empty; null owners are
    one owner. A very long text costs in proportion to its length and its matches. Repeated rows get equal spans and count
    as one repository; rows that share an id are told apart by their text. An empty table gives an empty result; columns
    not named are not looked at, whatever their names.
    """
    rows, found = _scanned(docs, id_col, text_col, owner_col, repo_col, owners, repositories)
    spans = F.transform(F.coalesce("_spans", F.array().cast(_SPANS)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["copied"].alias("copied")))
    return rows.join(maybe_broadcast(found), "_key", "left").select(F.col("_id").alias(id_col), spans.alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """text with every span masked: [secret] where it looks live, [example] where it is widely copied; overlaps are merged under the first one's mask."""

    def masked(data: Column) -> Column:
        piece = lambda at, n: F.substring(data, at + F.lit(1), n).cast("string")

        def one(s: Column) -> Column:
            before = F.coalesce(s["before"], F.lit(0)).cast("int")
            mask = F.when(s["copied"], "[example]").otherwise("[secret]")
            return F.when(s["from"] >= before, F.concat(piece(before, s["from"].cast("int") - before), mask)).otherwise("")

        last = F.array_max(F.transform(spans, lambda s: s["upto"])).cast("int")
        return F.concat(F.array_join(F.transform(spans, one), ""), piece(last, F.octet_length(data)))

    return F.when(F.size(spans) > 0, let(text.cast("binary"), masked)).otherwise(text)


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """docs with text_col masked, all rows kept in the columns they had; a null text stays null.

    The spans come back to the rows by a key of id and text: broadcast if measured to be few, else by a shuffled join.
    """
    _, found = _scanned(docs, id_col, text_col, owner_col, None, COMMON_OWNERS, COMMON_REPOSITORIES)
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_in"))
    keyed = named.withColumn("_key", _key(F.col("_in").getField(id_col), F.col("_in").getField(text_col)))
    joined = keyed.join(maybe_broadcast(found), "_key", "left")
    text = F.when(F.col("_spans").isNotNull(), redact(F.col("_in").getField(text_col).cast("string"), F.col("_spans"))).otherwise(F.col("_in").getField(text_col).cast("string"))
    return joined.select(*(text.alias(c) if c == text_col else F.col("_in").getField(c).alias(c) for c in docs.columns))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_query(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    s = F.col("spans")

    def count(test) -> Column:
        return F.size(F.filter(s, test)).cast("bigint")

    def of(kind: str):
        return lambda x: x["kind"] == kind

    base = F.filter(s, lambda x: x["kind"].isin([k[0] for k in BASE]))
    return found.select(
        "doc_id", *(count(of(k[0])).alias(f"n_{k[0]}") for k in BASE),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(s).alias("spans"),
        count(lambda x: ~x["copied"]).alias("n_live"), count(lambda x: x["copied"]).alias("n_copied"),
    )


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kinds = " union all ".join(
        f"select doc_id, owner, {rank} as rank, {quote(k)} as kind, {least} as least, unnest(range(1, len(regexp_extract_all(t, {quote(p)})) + 1)) as nth, unnest(list_slice(string_split_regex(t, {quote(p)}), 1, len(regexp_extract_all(t, {quote(p)})))) as p, unnest(regexp_extract_all(t, {quote(p)})) as m, unnest(regexp_extract_all(t, {quote(p)}, {group})) as v from d"
        for rank, (k, p, group, least) in enumerate(KINDS)
    )
    base = ", ".join(quote(k[0]) for k in BASE)
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank)"
    return f"""
with d as (select doc_id, coalesce(source, '') as owner, coalesce(text, '') as t from documents),
a as ({kinds}),
b as (select *, sum(length(p) + length(m)) over (partition by doc_id, rank order by nth) as stop from a),
c as (select doc_id, owner, rank, kind, stop - length(m) as start, stop, v from b where length(v) >= least and (rank <> {OPAQUE} or (regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')))),
o as (select v, count(distinct owner) >= {COMMON_OWNERS} or count(distinct doc_id) >= {COMMON_REPOSITORIES} as copied from c group by v),
s as (select c.*, copied from c join o on c.v = o.v where rank <> {OPAQUE} or not copied),
g as (select doc_id, {", ".join(f"count(*) filter (where kind = {quote(k[0])}) as n_{k[0]}" for k in BASE)}, {joined} filter (where kind in ({base})) as base, {joined} as spans,
  count(*) filter (where not copied) as n_live, count(*) filter (where copied) as n_copied from s group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) as n_{k[0]}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from d left join g on d.doc_id = g.doc_id"""


ORACLE = _oracle()
