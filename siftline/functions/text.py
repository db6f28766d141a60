"""Scalar functions over strings, as columns. Lengths that gate a value count bytes, distances count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; java.util.regex.Pattern's \\s is ASCII.
BLANK = r"[\t\n\u000B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def normalize(value: Column) -> Column:
    """Without white space around it and then without quotes of either kind around it."""
    return F.btrim(trim(value), F.lit("\"'"))


def chars(value: Column) -> Column:
    """Code points, in order."""
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a code point; 0 for an empty value."""
    def of(v: Column) -> Column:
        n = F.length(v)

        def add(total: Column, c: Column) -> Column:
            p = (n - F.length(F.replace(v, c, F.lit("")))) / n
            return total - p * F.log2(p)

        return F.aggregate(F.array_distinct(chars(v)), F.lit(0.0), add)

    return let(value, of)


def redact(value: Column) -> Column:
    """The ends of a normalised value around eight stars; short ones are stars alone. Bytes count."""
    def of(v: Column) -> Column:
        raw = F.encode(v, "utf-8")
        part = lambda a, n: F.decode(F.substring(raw, a, n), "utf-8")
        return F.when(F.octet_length(v) <= 8, F.lit("*" * 8)).otherwise(F.concat(part(1, 4), F.lit("*" * 8), part(-4, 4)))

    return let(normalize(value), of)


def identifier_words(name: Column) -> Column:
    """Lower-case words of letters and digits; a capital after a small letter begins one."""
    spaced = F.regexp_replace(name, r"(\p{Ll})(?=\p{Lu})", "$1 ")
    return F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity. A fold over a's characters, as far as b has them, strikes out, in b, the first equal one within reach."""
    reach = F.greatest(F.floor(F.greatest(F.length(a), F.length(b)) / 2).cast("int") - 1, F.lit(0))
    shared = F.filter(F.transform(chars(a), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: F.contains(b, x["c"]))

    def step(s: Column, x: Column) -> Column:
        low = F.greatest(x["i"] - reach, F.lit(0))
        return let(F.instr(F.substring(s["left"], low + 1, x["i"] + reach - low + 1), x["c"]), lambda at: F.struct(
            F.when(at > 0, F.concat(F.substring(s["left"], F.lit(1), low + at - 1), F.lit("\0"), F.substring(s["left"], low + at + 1, F.length(b)))).otherwise(s["left"]).alias("left"),
            F.when(at > 0, F.concat(s["met"], x["c"])).otherwise(s["met"]).alias("met"),
        ))

    def finish(s: Column) -> Column:
        struck = F.array_join(F.filter(F.transform(chars(b), lambda c, i: F.when(F.substring(s["left"], i + 1, F.lit(1)) == "\0", c).otherwise(F.lit(""))), lambda c: c != ""), "")
        m = F.length(s["met"])
        moved = F.size(F.filter(F.zip_with(chars(s["met"]), chars(struck), lambda x, y: x != y), lambda x: x))
        return F.when(m == 0, F.lit(0.0)).otherwise((m / F.length(a) + m / F.length(b) + (m - moved / 2) / m) / 3)

    start = F.struct(b.alias("left"), F.lit("").alias("met"))
    folded = F.aggregate(shared, start, step, finish)
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(folded)


def jaro_winkler(a: Column, b: Column) -> Column:
    """With the prefix bonus at any similarity."""
    same = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.length(a) >= i) & (F.length(b) >= i) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(n))
    return let(jaro(a, b), lambda j: j + same * 0.1 * (1 - j))


def similarity(name: Column, value: Column) -> Column:
    """The larger of normalised Levenshtein and Jaro-Winkler similarity, letter case aside."""
    return let(F.struct(F.lower(name).alias("a"), F.lower(normalize(value)).alias("b")), lambda s: F.greatest(levenshtein_similarity(s["a"], s["b"]), jaro_winkler(s["a"], s["b"])))


def less_similar(name: Column, value: Column, most: float) -> Column:
    """similarity(name, value) < most. Lengths and first characters tell, where even the most characters in common were too few."""
    def of(s: Column) -> Column:
        a, b = s["a"], s["b"]
        ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
        jaro_most = (ratio + 2) / 3
        bound = F.when(F.left(a, F.lit(1)) == F.left(b, F.lit(1)), jaro_most + 0.4 * (1 - jaro_most)).otherwise(jaro_most)
        return F.when((ratio > 0) & (bound < most - 1e-9), True).otherwise(F.greatest(levenshtein_similarity(a, b), jaro_winkler(a, b)) < most)

    return let(F.struct(F.lower(name).alias("a"), F.lower(normalize(value)).alias("b")), of)


def natural_language(value: Column) -> Column:
    """Four words or more, of which four in five, punctuation aside, are letters with inner joiners."""
    words = F.filter(F.split(value, f"{BLANK}+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"""^["'.,;:!?()\[\]{}<>]+|["'.,;:!?()\[\]{}<>]+\z""", ""))
    counted = F.filter(bare, lambda w: w.rlike(r"[\p{L}\p{Nd}]"))
    alpha = F.filter(counted, lambda w: w.rlike(r"^[\p{L}'’/-]+\z"))
    return (F.size(words) >= 4) & (F.size(counted) > 0) & (F.size(alpha) * 5 >= F.size(counted) * 4)
