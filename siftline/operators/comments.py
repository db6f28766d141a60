"""Known credentials within comments: every occurrence, one finding for each distinct token of a comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text
from ..functions.dialect import to_java
from ..plans import patterns


def without(tokens: Column, allow: list[str]) -> Column:
    return F.filter(tokens, lambda x: ~p.matches(x["token"], allow))


def tokens_in(comment: Column) -> Column:
    """Array of (offset, order, id, token); of equal tokens the first pattern's, where it first occurs."""
    table, rest = p.literal_table(patterns.VALUE_PATTERNS)

    def tokens(pattern: Column, order: Column, id_: Column) -> Column:
        found = F.regexp_extract_all(comment, pattern, F.lit(0))
        return F.transform(found, lambda t: F.struct(t.alias("token"), order.alias("order"), id_.alias("id")))

    known = p.table_hits(comment, table)
    parts = [F.flatten(F.transform(known, lambda x: tokens(x["pattern"], x["order"], x["id"])))]
    for i in rest:
        id_, pattern, allow = patterns.VALUE_PATTERNS[i]
        own = tokens(F.lit(to_java(pattern)), F.lit(i), F.lit(id_))
        parts.append(without(own, allow) if allow else own)
    every = F.concat(*parts)
    return F.transform(every, lambda x: F.struct((F.instr(comment, x["token"]) - 1).alias("offset"), x["order"].alias("order"), x["id"].alias("id"), x["token"].alias("token")))


def firsts(tokens: Column) -> Column:
    """Of equal tokens the one of least order, where it first occurs; array_sort brings equal ones together."""
    ordered = F.array_sort(F.transform(tokens, lambda x: F.struct(x["token"], x["order"], x["offset"], x["id"])))
    return text.let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["token"] != x["token"])))


def expand_comments(candidates: DataFrame) -> DataFrame:
    """Candidates of kind comment, whose value is a comment, become one for each token, at the token's line; `found` is its pattern's id.

    Row by row, so that what makes the candidates runs once.
    """
    comment, line = F.col("value"), F.col("line")

    def placed(x: Column) -> Column:
        before = F.substring(comment, F.lit(1), x["offset"])
        at = line + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
        return F.struct(at.cast("int").alias("line"), x["token"].alias("value"), x["id"].alias("found"), (x["offset"] * 1000 + x["order"]).alias("sub"))

    other = F.array(F.struct(line.cast("int").alias("line"), comment.alias("value"), F.lit(None).cast("string").alias("found"), F.lit(0).alias("sub")))
    each = F.when(F.col("kind") == "comment", F.transform(firsts(tokens_in(comment)), placed)).otherwise(other)
    rows = candidates.withColumn("_each", F.explode(each))
    return rows.select(*[F.col("_each")[c].alias(c) if c in ("line", "value") else F.col(c) for c in candidates.columns], F.col("_each.found").alias("found"), F.col("_each.sub").alias("sub"))
