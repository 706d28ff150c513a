"""Secrets in texts, told apart by who owns copies of them. DataFrame functions only.

Each text is scanned for three kinds of base spans (assignments, access keys, long hexadecimal
runs) and for bare tokens that could be credentials. Corpus-wide, the values' hashes are aggregated
by distinct repositories and owners. A value that many owners have is a copied example; a
varied one that few have looks live. A bare token that equals a base span's value elsewhere in
the corpus is added as a span of kind ``reuse``, unless it touches a base span.

Spans are in code points, end exclusive. A match's place is the sum of the lengths of the pieces and
matches before it, so the engine's own regular expressions are all that is needed.

Defined results: null and empty texts have no spans; equal rows have equal results and count once as
owners of a value; null sources own nothing; null ids are allowed; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run is one match or none, so the least length can stand in the pattern
HEX = r"[0-9a-f]{32,}"
BARE = r"(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{16,}"
KINDS = ("assign", "access", "hex", "reuse")
#: From this number of owners on a value is a copied example.
COPIED = 5
PLACEHOLDER = r"example|sample|dummy|changeme|your|xxxx|12345"

#: Characters cut out of a text at once, see _cleaned.
_CHUNK = 4096
#: Values folded at once, see _before.
_BLOCK = 64

_SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, op: Callable[[Column, Column], Column], body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function from i to ``op`` (a sum, a maximum) over 0 and the first i of ``values``: whole blocks of them, and the few after the last whole block."""
    fold = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: op(a, x.cast("bigint")))
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), block(F.size(values))), lambda j: fold(F.slice(values, j * _BLOCK + 1, F.lit(_BLOCK))))
    earlier = lambda found: F.transform(F.sequence(F.lit(0), F.size(found)), lambda j: fold(F.slice(found, F.lit(1), j)))
    at = lambda whole: lambda i: op(F.get(whole, block(i)), fold(F.slice(values, block(i) * _BLOCK + 1, F.pmod(i, F.lit(_BLOCK)))))
    return _let(blocks, lambda found: _let(earlier(found), lambda whole: body(at(whole))))


def _spans(text: Column, pattern: str, rank: int, group: int, least: int) -> Column:
    """All leftmost matches that do not overlap, whose ``group`` has at least ``least`` characters. Time is in proportion to the text."""
    p = F.lit(pattern)
    pieces = F.struct(
        F.regexp_extract_all(text, p, F.lit(0)).alias("found"), F.regexp_extract_all(text, p, F.lit(group)).alias("values"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps")
    )

    def listed(m: Column) -> Column:
        steps = F.zip_with(m["gaps"], m["found"], lambda gap, x: gap + F.coalesce(F.length(x), F.lit(0)))

        def one(before: Callable[[Column], Column]) -> Column:
            start = lambda i: before(i) + F.get(m["gaps"], i)
            return F.transform(
                F.filter(F.sequence(F.lit(0), F.size(m["found"]) - 1), lambda i: F.length(F.get(m["values"], i)) >= least),
                lambda i: _let(start(i), lambda at: F.struct(
                    at.alias("start"),
                    F.lit(rank).alias("rank"),
                    (at + (F.length(F.get(m["found"], i)) if rank < 3 else F.length(F.rtrim(F.get(m["values"], i), F.lit("."))))).alias("end"),
                    F.rtrim(F.get(m["values"], i), F.lit(".")).alias("value"),
                )),
            )

        return _let(steps, lambda s: _before(s, lambda a, x: a + x, one))

    return F.when(text.rlike(pattern), _let(pieces, listed)).otherwise(F.array()).cast(_SPAN)


def _clear(spans: Column, base: Column) -> Column:
    """The ``spans`` that no span of ``base`` touches. ``base`` is sorted; of its blocks only those that reach a span are looked into."""
    width = F.ceil(F.sqrt(F.size(base))).cast("int")
    meets = lambda t: lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])

    def block(part: Column) -> Column:
        return F.struct(F.get(part, F.lit(0))["start"].alias("start"), F.array_max(F.transform(part, lambda x: x["end"])).alias("end"), part.alias("part"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(base) - 1) / width).cast("int")), lambda j: _let(F.slice(base, j * width + 1, width), block))
    some = _let(blocks, lambda all_of: F.filter(spans, lambda t: ~F.exists(all_of, lambda x: meets(t)(x) & F.exists(x["part"], meets(t)))))
    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(some)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, repository, owner, row_hash, base, bare): each text's base spans, by start and kind, and its bare tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, 2, 8), _spans(text, ACCESS, 1, 0, 16), _spans(text, HEX, 2, 0, 32)))
    seen = docs.select("doc_id", *(c for c in ("source", "lang") if c in docs.columns), F.xxhash64(text).alias("row_hash"), base.alias("base"), _spans(text, BARE, 3, 0, 16).alias("bare"))
    owner = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    repository = F.concat_ws("/", owner, F.col("lang")) if "lang" in docs.columns else owner
    return seen.select("doc_id", F.when(owner.isNotNull(), repository).alias("repository"), owner.alias("owner"), "row_hash", "base", _clear(F.col("bare"), F.col("base")).alias("bare"))


def ownership(scanned: DataFrame, copied: int = COPIED) -> DataFrame:
    """(value_hash, n_repositories, n_owners, named, class): of each value whether a base span names it, and its class."""
    hits = scanned.select("repository", "owner", F.explode(F.concat("base", "bare")).alias("s"))
    hits = hits.select(F.sha2("s.value", 256).alias("value_hash"), "repository", "owner", (F.col("s.rank") < 3).alias("named"), _live(F.col("s.value")).alias("live"))
    return (
        hits.groupBy("value_hash")
        .agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"), F.max("named").alias("named"), F.max("live").alias("live"))
        .withColumn("class", F.when(F.col("n_owners") >= copied, "copied").when(F.col("live"), "owned").otherwise("weak"))
        .drop("live")
    )


def _live(value: Column) -> Column:
    """Whether a value looks like a credential and not like a placeholder: six different characters at least."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 6) & ~F.lower(value).rlike(PLACEHOLDER)


def find_secrets(docs: DataFrame, copied: int = COPIED) -> DataFrame:
    """(doc_id, row_hash, spans): for every row its spans (start, rank, end, value, class), by start and kind."""
    scanned = common.written(scan(docs), "secrets")
    some = (F.size("base") > 0) | (F.size("bare") > 0)
    hits = scanned.where(some).select("doc_id", "row_hash", F.explode(F.concat("base", "bare")).alias("s")).distinct()
    judged = (
        hits.withColumn("value_hash", F.sha2("s.value", 256)).join(common.written(ownership(scanned, copied), "owners"), "value_hash").where((F.col("s.rank") < 3) | F.col("named"))
        .groupBy("doc_id", "row_hash")
        .agg(F.array_sort(F.collect_list(F.struct("s.start", "s.rank", "s.end", "s.value", "class"))).alias("spans"))
        .select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "spans")
    )
    rows = scanned.where(some).select("doc_id", "row_hash").join(judged, (F.col("row_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "row_hash", "spans")
    rest = scanned.where(~some).select("doc_id", "row_hash", F.lit(None).cast(dict(rows.dtypes)["spans"]).alias("spans"))
    return rows.union(rest).withColumn("spans", F.coalesce("spans", F.array().cast(dict(rows.dtypes)["spans"])))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cleaned(text: Column, spans: Column) -> Column:
    """``text`` with a mark for each span, in one go: from the end of all earlier spans to each span, its mark, and so on. A span that begins within an earlier one has no mark."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / _CHUNK).cast("int")), lambda j: text.substr(j * _CHUNK + 1, F.lit(_CHUNK)))
    chunk = lambda i: F.floor(i / _CHUNK).cast("int")
    ends = F.transform(spans, lambda s: s["end"])

    def between(parts: Column, a: Column, b: Column) -> Column:
        """The characters from a to b, out of the chunks that hold them."""
        low = lambda c: F.greatest(a - c * _CHUNK, F.lit(0)).cast("int")
        return F.array_join(F.transform(F.sequence(chunk(a), chunk(b)), lambda c: F.substring(F.get(parts, c), low(c) + 1, (F.least(b - c * _CHUNK, F.lit(_CHUNK)) - low(c)).cast("int"))), "")

    def marked(parts: Column, before: Callable[[Column], Column]) -> Column:
        def piece(s: Column, i: Column) -> Column:
            mark = F.when(s["class"] == "copied", "[EXAMPLE]").otherwise("[SECRET]")
            return _let(before(i), lambda at: F.when(s["start"] >= at, F.concat(between(parts, at, s["start"]), mark)).otherwise(""))

        return F.concat(F.array_join(F.transform(spans, piece), ""), _let(before(F.size(spans)), lambda at: between(parts, at, F.length(text).cast("bigint"))))

    return _let(chunks, lambda parts: _let(ends, lambda e: _before(e, F.greatest, lambda before: marked(parts, before))))


def redacted(docs: DataFrame, copied: int = COPIED) -> DataFrame:
    """``docs`` with its columns; found spans are replaced by [SECRET], copied examples by [EXAMPLE]; n_chars follows."""
    key, own_id, own_hash, spans = common.fresh(docs, "row_hash", "own_id", "own_hash", "spans")
    found = common.written(find_secrets(docs, copied).where(F.size("spans") > 0).dropDuplicates(["doc_id", "row_hash"]), "spans")
    found = found.select(F.col("doc_id").alias(own_id), F.col("row_hash").alias(own_hash), F.col("spans").alias(spans))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, (F.col(key) == F.col(own_hash)) & F.col("doc_id").eqNullSafe(F.col(own_id)), "left")
    text, hit = F.col("text"), F.col(spans).isNotNull()
    out = joined.withColumn("text", F.when(hit, _cleaned(text, F.col(spans))).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*common.quoted(docs.columns))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all of ``documents``."""
    found = find_secrets(common.table(spark, sf_dir, "documents"))

    def count(field: str, value: int | str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("bigint")

    return found.select(
        "doc_id",
        *(count("rank", r).alias(f"n_{KINDS[r]}") for r in range(4)),
        *(count("class", c).alias(f"n_{c}") for c in ("copied", "owned", "weak")),
        F.sha2(_listed(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    letters = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" for c in w) for w in ("password", "passwd", "secret", "token", "api_key"))
    assign = f"({letters})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    kinds = ((assign, 0, 2, 8), ("AKIA[A-Z0-9]+", 1, 0, 16), ("[0-9a-f]+", 2, 0, 32), ("[A-Za-z0-9+/_.=-]+", 3, 0, 16))
    parts = []
    for pattern, rank, group, least in kinds:
        more = " and regexp_matches(v[i], '[0-9]') and regexp_matches(v[i], '[A-Za-z]')" if rank == 3 else ""
        parts.append(f"""
        select rid, {rank} as rank, coalesce(list_sum(list_slice(g, 1, i)), 0)::bigint + coalesce(list_sum(list_slice(m, 1, i - 1)), 0)::bigint as s, {'m[i]' if rank < 3 else 'length(rtrim(v[i], chr(46)))'} as size, rtrim(v[i], '.') as value
        from (select rid, v, g, m, unnest(range(1, len(m) + 1)) as i from (
            select rid, regexp_extract_all(text, '{pattern}', {group}) as v,
                list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x)) as m,
                list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) as g from d))
        where length(v[i]) >= {least}{more}""")
    return f"""
    with d as (select row_number() over () as rid, doc_id, source, lang, coalesce(text, '') as text from documents),
    f as ({" union all ".join(parts)}),
    c as (select * from f where rank < 3 or not exists (select 1 from f b where b.rid = f.rid and b.rank < 3 and b.s < f.s + f.size and f.s < b.s + b.size)),
    o as (select value, count(distinct source) as owners, bool_or(rank < 3) as named,
            len(list_distinct(string_split(value, ''))) >= 6 and not regexp_matches(lower(value), '{PLACEHOLDER}') as live
        from c join d using (rid) group by value),
    k as (select rid, s, rank, ['assign', 'access', 'hex', 'reuse'][rank + 1] || ':' || s || ':' || (s + size) as t,
            case when owners >= {COPIED} then 'copied' when live then 'owned' else 'weak' end as class
        from c join o using (value) where rank < 3 or named),
    a as (select rid, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex, count(*) filter (rank = 3) as n_reuse,
            count(*) filter (class = 'copied') as n_copied, count(*) filter (class = 'owned') as n_owned, count(*) filter (class = 'weak') as n_weak,
            string_agg(t, ',' order by s, rank) filter (rank < 3) as base, string_agg(t, ',' order by s, rank) as spans from k group by rid)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, coalesce(n_reuse, 0) as n_reuse,
        coalesce(n_copied, 0) as n_copied, coalesce(n_owned, 0) as n_owned, coalesce(n_weak, 0) as n_weak,
        sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from d left join a using (rid)"""


QUERIES = {"op3_secret_scans": op3_secret_scans}
ORACLE_SQL = {"op3_secret_scans": _oracle()}
