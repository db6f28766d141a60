"""Filter rules: drop or tag findings by expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import compile_bool, finding_env
from ..plans.config import RuleSet


def apply_filters(findings: DataFrame, rules: RuleSet, keep_filtered: bool = False) -> DataFrame:
    """Add `filtered` and `filtered_reason`, the first expression that drops a finding; tags append in order, each once.

    Dropped findings go, unless keep_filtered. A finding that is dropped is still tagged.
    """
    env = finding_env(F.col)
    hits = [compile_bool(f.expression, env) for f in rules.filters]
    drops = [(f, hit) for f, hit in zip(rules.filters, hits) if f.action == "filter"]
    reason = F.coalesce(*[F.when(hit, f.expression) for f, hit in drops]) if drops else F.lit(None).cast("string")
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    for f, hit in zip(rules.filters, hits):
        if f.action == "tag":
            tags = F.when(hit & ~F.array_contains(tags, f.id), F.array_append(tags, f.id)).otherwise(tags)
    dropped = reduce(lambda a, b: a | b, [hit for _, hit in drops]) if drops else F.lit(False)
    out = findings.withColumn("filtered_reason", reason).withColumn("filtered", dropped).withColumn("tags", tags)
    return out if keep_filtered else out.where(~F.col("filtered"))
