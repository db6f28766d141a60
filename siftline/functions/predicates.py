"""What makes a value, or a name and its value, look like a credential; all as columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, urls
from .dialect import any_literal, required_literal, sure_literals, to_java

#: Words that wrap an echoed name in a placeholder.
FILLERS = (
    "your my the a an some example sample placeholder change changeme me real actual valid test testing dummy fake insert enter put here value goes todo fixme xxx default"
).split()
PLACEHOLDER = r"\$\{[^}]*\}|\$\([^)]*\)|\{\{[^}]*\}\}|^%[A-Za-z0-9_.]+%$"
AT_VARIABLE = "@[A-Za-z0-9_.]+@"
#: Formats in which @NAME@ is filled in anywhere in a value.
FILTERED = ("xml", "properties")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def matches(value: Column, patterns: list[str]) -> Column:
    """Whether any RE2 pattern is found in the value."""
    return any_of([value.rlike(to_java(p)) for p in patterns])


def jwt(value: Column) -> Column:
    v = text.normalize(value)
    return F.startswith(v, F.lit("eyJ")) | F.contains(v, F.lit(" eyJ"))


def private_key(value: Column) -> Column:
    return F.upper(value).rlike("BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY")


def connection_string(value: Column) -> Column:
    low = F.lower(value)
    return low.rlike("(?:password|pwd)[=:]") & low.rlike("(?:user|user id|uid|username)=")


def classify(value: Column) -> Column:
    """Why a value by itself is a secret, or an empty string."""
    return text.let(text.normalize(value), lambda v: (
        F.when(jwt(v), "jwt_indicator").when(urls.has_secret_param(v), "url_secret_query_param").when(urls.has_credentials(v), "url_credentials")
        .when(private_key(v), "private_key_indicator").when(connection_string(v), "connection_string_secret_indicator").otherwise("")
    ))


def placeholder(value: Column, lang: Column) -> Column:
    at = lambda v: F.when(lang.isin(*FILTERED), v.rlike(to_java(AT_VARIABLE))).otherwise(v.rlike(to_java(f"^{AT_VARIABLE}$")))
    return text.let(text.normalize(value), lambda v: v.rlike(to_java(PLACEHOLDER)) | at(v))


def echoes_name(name: Column, value: Column) -> Column:
    """Whether the value says no more than its name, placeholder words aside."""
    own = F.array_join(text.identifier_words(name), "")
    rest = F.array_join(F.filter(text.identifier_words(value), lambda w: ~w.isin(*FILLERS)), "")
    return (own != "") & (own == rest)


def stopword(value: Column, words: list[str]) -> Column:
    """Whether the lower-case value contains any of the words: one pass over an alternation."""
    import re

    if not words:
        return F.lit(False)
    return F.lower(text.trim(value)).rlike("|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (len(w), w))))


def ignored(value: Column, prefixes: list[str], patterns: list[str]) -> Column:
    return text.let(text.normalize(value), lambda v: any_of([F.startswith(v, F.lit(p)) for p in prefixes]) | matches(v, patterns))


def name_signals(name: Column, patterns: list[str], ignore: list[str]) -> Column:
    return matches(name, patterns) & ~matches(name, ignore)


Patterns = list[tuple[str, str, list[str]]]


def low(value: Column) -> Column:
    """Lower case as pattern matching folds it."""
    return F.translate(F.lower(value), "ſ", "s")


def literal_table(patterns: Patterns) -> tuple[Column, list[int]]:
    """(order, id, literal, pattern) of those that have a sure literal, as one constant; places of the others.

    A table keeps the plan small, and a literal's absence, which is cheap to see, spares the pattern.
    """
    guarded = [(i, x) for i, x in enumerate(patterns) if required_literal(x[1]) and not x[2]]
    rows = [F.struct(F.lit(i).alias("order"), F.lit(id_).alias("id"), F.lit(required_literal(p)).alias("literal"), F.lit(to_java(p)).alias("pattern")) for i, (id_, p, _) in guarded]
    none = "array<struct<order:int,id:string,literal:string,pattern:string>>"
    return (F.array(*rows) if rows else F.array().cast(none)), [i for i in range(len(patterns)) if i not in {k for k, _ in guarded}]


def table_hits(value: Column, table: Column) -> Column:
    """The entries of a literal table whose pattern is found, in order."""
    return text.let(low(value), lambda v: F.filter(table, lambda p: F.contains(v, p["literal"]) & F.rlike(value, p["pattern"])))


def first_pattern(value: Column, patterns: Patterns) -> Column:
    """The id of the first (id, pattern, allowed) whose pattern is found and no allowed one is; null without any.

    Most values hold none of the literals, one of which a match needs; a single pass over a value tells, and spares it the patterns.
    """
    sure = [sure_literals(p) for _, p, _ in patterns]
    loose = first_of(value, patterns, [i for i, s in enumerate(sure) if not s])
    if not any(sure):
        return loose
    return F.when(low(value).rlike(any_literal(set().union(*sure))), first_of(value, patterns, range(len(patterns)))).otherwise(loose)


def first_of(value: Column, patterns: Patterns, places: Iterable[int]) -> Column:
    """first_pattern() among the patterns at these places."""
    patterns = [patterns[i] for i in places]
    if not patterns:
        return F.lit(None).cast("string")
    table, rest = literal_table(patterns)
    found = table_hits(value, table)
    hit = lambda i: value.rlike(to_java(patterns[i][1])) & (~matches(value, patterns[i][2]) if patterns[i][2] else F.lit(True))
    first = [F.when(hit(i), F.struct(F.lit(i).alias("order"), F.lit(patterns[i][0]).alias("id"))) for i in rest]
    guarded = F.try_element_at(F.transform(found, lambda p: F.struct(p["order"].alias("order"), p["id"].alias("id"))), F.lit(1))
    return (F.least(guarded, *first) if first else guarded)["id"]
