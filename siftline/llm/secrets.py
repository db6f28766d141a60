"""Secret scan with multipart credential linking, with DataFrame functions only, row by row.

Base kinds report alone. Weak kinds (bare high-entropy tokens, account names, endpoints) report only
where a complementary part lies within the same scope: an interval join of the spans of one text, within SCOPE code
points, by place in the sorted spans. Each weak span that reports is linked to its nearest complementary part.
No step is over pairs of spans. Nothing is shuffled, so neither a hot source nor a lost executor matters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points by which spans may lie apart and still share a scope.
SCOPE = 256
#: Kind, pattern, the group whose length counts, its least length.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
WEAK = [
    ("secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}", 0, 32),
    ("ident", r"""(?i:client_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3),
    ("endpoint", r"""(?:[a-z][a-z0-9+]{1,15}+://[^\x20\x09-\x0D"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])(?::[0-9]{1,5})?)""", 0, 8),
]
#: A text without any of these, in lower case, has no match of the kind.
NEEDS = {"assign": ["passw", "secret", "token", "api"], "access": ["akia"], "ident": ["client", "user", "login", "account"]}
#: Kinds that let a weak kind report.
PARTNERS = {"secret": ["access", "ident", "endpoint"], "ident": ["assign", "hex", "secret"], "endpoint": ["assign", "access", "hex", "secret"]}
ORDER = [k for k, *_ in BASE + WEAK]
SPAN = "start:int,rank:int,end:int,kind:string"
#: Spans that are summed up as one.
CHUNK = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunked(items: Column) -> Column:
    """The items in arrays of CHUNK."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / CHUNK).cast("int") - 1, F.lit(0))), lambda b: F.slice(items, b * CHUNK + 1, F.lit(CHUNK)))


def running(numbers: Column) -> Column:
    """The sum of what is before each number, by chunks: an aggregate copies its state at each step, so it must not gather an array."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)

    def within(chunks: Column, bases: Column) -> Column:
        return F.flatten(F.transform(chunks, lambda c, i: F.transform(c, lambda x, j: bases[i] + total(F.slice(c, F.lit(1), j)))))

    def bases(totals: Column) -> Column:
        return F.transform(totals, lambda x, i: total(F.slice(totals, F.lit(1), i)))

    return let(chunked(numbers), lambda chunks: let(let(F.transform(chunks, total), bases), lambda found: within(chunks, found)))


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, rank of the kind, end, kind): code points, end exclusive; leftmost non-overlapping matches, short ones dropped after matching."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.zip_with(F.transform(matches, F.length), F.transform(counted, F.length), lambda own, n: F.struct(own.alias("own"), n.alias("n")))

    def placed(steps: Column) -> Column:
        starts = running(F.transform(steps, lambda s: s["gap"] + s["own"]))
        span = lambda s, before: F.struct((before + s["gap"]).alias("start"), F.lit(ORDER.index(kind)).alias("rank"), (before + s["gap"] + s["own"]).alias("end"), F.lit(kind).alias("kind"), s["n"].alias("n"))
        return F.zip_with(steps, starts, span)

    every = let(let(both, lambda b: steps_of(text, pattern, b)), placed)
    return F.transform(F.filter(every, lambda s: s["n"] >= least), lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))


def steps_of(text: Column, pattern: str, both: Column) -> Column:
    """Array of (gap, own, n): what lies before each match, its length, and the length that counts; a running sum of the first two gives places."""
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(both))
    return F.zip_with(gaps, both, lambda gap, x: F.struct(gap.alias("gap"), x["own"].alias("own"), x["n"].alias("n")))


def links_of(weak: Column, partners: Column, scope: int) -> Column:
    """Array of (start, rank, end, kind, partner): the weak spans with a partner in scope, each with its nearest, the earlier of two as near.

    Sorted by start, of the partners that start no later than a weak span only the one that ends last matters, and
    of the others only the first.
    """
    kinds = f"array<struct<{SPAN},partner:struct<{SPAN}>>>"
    same = lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])

    def tagged(spans: Column, tag: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"], F.lit(tag).alias("weak"), s["end"], s["kind"], s["rank"]))

    def counted(events: Column) -> Column:
        before = running(F.transform(events, lambda e: 1 - e["weak"]))
        return F.filter(F.zip_with(events, before, lambda e, n: F.struct(e.alias("e"), n.alias("n"))), lambda x: x["e"]["weak"] == 1)

    def placed(x: Column, own: Column, ends: Column, tops: Column) -> Column:
        whole = F.floor(x["n"] / CHUNK).cast("int")
        last = F.greatest(F.array_max(F.slice(tops, F.lit(1), whole)), F.array_max(F.slice(ends, whole * CHUNK + 1, x["n"] - whole * CHUNK)))
        return F.struct(x["e"].alias("e"), last.alias("b"), F.get(own, x["n"]).alias("a"))

    def near(own: Column, ends: Column, tops: Column) -> Column:
        events = F.array_sort(F.concat(tagged(weak, 1), tagged(own, 0)))
        both = F.transform(let(events, counted), lambda x: placed(x, own, ends, tops))
        gaps = F.transform(both, lambda x: F.struct(x["e"].alias("e"), x["b"].alias("b"), x["a"].alias("a"), (x["e"]["start"] - x["b"]["end"]).alias("gap_b"), (x["a"]["start"] - x["e"]["end"]).alias("gap_a")))
        linked = F.filter(gaps, lambda x: F.coalesce(x["gap_b"] <= scope, F.lit(False)) | F.coalesce(x["gap_a"] <= scope, F.lit(False)))
        first = lambda x: F.coalesce(x["gap_b"] <= x["gap_a"], x["a"].isNull())
        return F.transform(linked, lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["rank"].alias("rank"), x["e"]["end"].alias("end"), x["e"]["kind"].alias("kind"), F.when(first(x), same(x["b"])).otherwise(x["a"]).alias("partner")))

    by_end = lambda own: F.transform(own, lambda s: F.struct(s["end"], s["start"], s["rank"], s["kind"]))
    found = let(F.array_sort(partners), lambda own: let(by_end(own), lambda ends: let(F.transform(chunked(ends), F.array_max), lambda tops: near(own, ends, tops))))
    return F.when((F.size(weak) > 0) & (F.size(partners) > 0), found.cast(kinds)).otherwise(F.array().cast(kinds))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Add `base` and `linked`, arrays of (start, rank, end, kind) in order, and `links`, `linked` with the nearest partner of each.

    A null or empty text has empty arrays. Rows are independent, so repeated rows each get their spans;
    an existing column named base, linked or links is replaced.
    """
    names = [c for c in docs.columns if c not in ("base", "linked", "links")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("low", F.lower("body"))
    body = F.col("body")
    none = F.array().cast(f"array<struct<{SPAN}>>")
    has = lambda kind: reduce(lambda a, b: a | b, [F.contains(F.col("low"), F.lit(x)) for x in NEEDS[kind]])
    # A short run can never count for these two, so the least length may stand in the pattern; matches stay the same.
    tight = {"access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}
    for kind, pattern, group, least in BASE + WEAK:
        pattern = tight.get(kind, pattern)
        there = has(kind) & body.rlike(pattern) if kind in NEEDS else body.rlike(pattern)
        rows = rows.withColumn(kind, F.when(there, spans_of(body, kind, pattern, group, least)).otherwise(none))
    base = F.array_sort(F.concat(*[F.col(k) for k, *_ in BASE]))
    links = F.array_sort(F.concat(*[links_of(F.col(k), F.concat(*[F.col(p) for p in PARTNERS[k]]), scope) for k, *_ in WEAK]))
    rows = rows.select("row", base.alias("base"), links.alias("links"))
    linked = F.transform("links", lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"]))
    return rows.select(*[F.col("row")[c].alias(c) for c in names], "base", linked.alias("linked"), "links")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and links (weak>partner, joined likewise)."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    place = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    found = scan_secrets(docs.select("doc_id", "text"))
    pairs = F.array_join(F.transform("links", lambda x: F.concat_ws(">", place(x), place(x["partner"]))), ",")
    return found.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "linked"))).alias("spans"), pairs.alias("links"))
