"""Candidates to findings. Every test is a column over the candidate's name, value and language.

A candidate has a kind that says which tests hold for it:
  named    its name has to signal a secret, by the rule at `rule`
  value    only its shape counts, first by first: identifiers, known patterns, detectors, entropy, hosts
  reason   a value that is a secret by itself, under a name that signals nothing to any rule
  env      like named, for the default of an environment lookup
  arg      like named, for an argument of a call, if it is one word
  default  like env, for what a lookup falls back to by an operator, if it is one word
  comment  a known pattern found in a comment
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text, urls
from ..functions.dialect import to_java
from ..functions.expressions import compile_bool, name_value_env

from ..plans import patterns
from ..plans.config import Detector, Rule, RuleSet

HIGH, INFO = "high", "info"
#: What a finding is made of, besides where it was found.
FINDING = ["level", "name_path", "value_path", "name", "value", "raw_value", "value_sha256", "entropy", "name_value_similarity", "reason"]
LONGEST_TOKEN = 200


def likely(name: Column, value: Column, lang: Column, rule: Rule, stopwords: tuple[str, ...], shape: Column | None = None) -> Column:
    """Whether a value under a telling name passes the gates. Cheap tests come first. shape: what classify says of the value, if that is known."""
    v = text.trim(value)
    tests = (v != "") & ~p.echoes_name(name, v)
    if rule.max_similarity > 0:
        tests = tests & text.less_similar(name, v, rule.max_similarity)
    plain = ~p.placeholder(v, lang) & ~text.natural_language(v) & (F.octet_length(v) >= rule.min_length)
    if rule.min_entropy > 0:
        plain = plain & (text.entropy(text.normalize(v)) >= rule.min_entropy)
    return tests & (((p.classify(v) if shape is None else shape) != "") | (plain & ~p.stopword(v, list(stopwords))))


def skipped(value: Column, lang: Column, rule: Rule) -> Column:
    return p.ignored(value, list(rule.ignore_prefixes), list(rule.ignore_values)) | p.placeholder(value, lang) | urls.plain_url(value)


def signals(name: Column, rule: Rule) -> Column:
    return p.name_signals(name, list(rule.name_patterns), list(rule.ignore_names))


#: Kinds whose name has to signal a secret, and the reason where the value's shape gives none.
NAMED = {"named": "name_indicates_secret", "env": "env_fallback_literal", "arg": "name_indicates_secret", "default": "env_fallback_literal"}
ONE_WORD = ("arg", "default")


def named_reason(name: Column, value: Column, lang: Column, rule: Rule, stopwords: tuple[str, ...], kind: Column) -> Column:
    """The reason under one rule, or null."""
    default = F.element_at(F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv]), kind)
    blank = kind.isin(*ONE_WORD) & value.rlike("[ \\t\\r\\n]")
    gate = lambda shape: ~blank & likely(name, value, lang, rule, stopwords, shape)
    reason = text.let(p.classify(value), lambda shape: F.when(shape != "", shape).when(gate(shape), default))
    return F.when(signals(name, rule) & ~skipped(value, lang, rule), reason)


def suppressed(value: Column, rules: tuple[Rule, ...]) -> Column:
    return p.any_of([p.ignored(value, list(r.ignore_prefixes), list(r.ignore_values)) for r in rules])


def detector_matches(value: Column, name: Column, d: Detector) -> Column:
    hay = F.lower(F.concat_ws(" ", value, name))
    contains = lambda words: p.any_of([F.contains(hay, F.lit(w)) for w in words])
    tests = (contains(d.keywords) if d.keywords else F.lit(True)) & ~contains(d.exclude_words)
    for _, pattern in d.patterns:
        tests = tests & value.rlike(to_java(pattern))
    java = to_java(dict(d.patterns)[d.primary])

    groups = re.compile(r"\((?!\?)|\(\?<g").search(re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "", java))
    whole = F.regexp_extract(value, java, 0)
    first = F.regexp_extract(value, java, 1) if groups else F.lit("")
    found = F.when(first != "", first).otherwise(whole)
    tests = tests & (found != "") & ~p.matches(found, list(d.exclude_patterns))
    return tests & (text.entropy(found) >= d.min_entropy) if d.min_entropy > 0 else tests


def high_entropy(value: Column, rules: tuple[Rule, ...]) -> Column:
    """high_entropy:<bits> under the first rule whose threshold the token reaches, or null."""
    e = text.entropy(value)
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        if r.high_entropy > 0:
            out = F.when((F.octet_length(value) >= r.min_length) & (e >= r.high_entropy), F.format_string("high_entropy:%.2f", e)).otherwise(out)
    return F.when((F.octet_length(value) <= LONGEST_TOKEN) & ~value.rlike("[ \\t\\r\\n]"), out)


def value_reason(name: Column, value: Column, rules: RuleSet) -> Column:
    """Why a value's shape is worth a finding, or null; value is normalised."""
    info = F.lit(None).cast("string")
    for id_, source in reversed(rules.info):
        info = F.when(compile_bool(source, name_value_env(name, value)), f"info:{id_}").otherwise(info)
    known = F.concat(F.lit("sig:"), p.first_pattern(value, patterns.VALUE_PATTERNS))
    custom = F.lit(None).cast("string")
    for d in reversed(rules.detectors):
        custom = F.when(detector_matches(value, name, d), f"custom:{d.name}").otherwise(custom)
    host = F.concat(F.lit("info:"), p.first_pattern(value, [(i, x, []) for i, x in patterns.HOSTS]))
    return F.when((value != "") & ~suppressed(value, rules.rules), F.coalesce(info, known, custom, high_entropy(value, rules.rules), host))


def by_rule(make: Callable[[Rule], Column], rules: tuple[Rule, ...]) -> Column:
    out = F.lit(None).cast("string")
    for i, r in enumerate(rules):
        out = F.when(F.col("rule") == i, make(r)).otherwise(out)
    return out


def finding_columns(df: DataFrame) -> DataFrame:
    """Complete a row with name, raw_value and reason."""
    raw = F.col("raw_value")
    return df.withColumns({
        "level": F.when(F.startswith("reason", F.lit("info:")), INFO).otherwise(HIGH), "value": text.redact(raw), "value_sha256": F.sha2(raw, 256),
        "entropy": text.round2(text.entropy(text.normalize(raw))), "name_value_similarity": text.round2(text.similarity(F.col("name"), raw)),
    })


def findings(candidates: DataFrame, rules: RuleSet) -> DataFrame:
    """candidates: kind, rule, name, value, lang, name_path, value_path and whatever says where; findings keep that."""
    name, value, lang, kind = (F.col(c) for c in ("name", "value", "lang", "kind"))
    # Spark works a column out anew wherever a branch names it, so the normalised value is bound once.
    normal = text.normalize(value)
    of_normal = text.let(normal, lambda v: (
        F.when(kind == "value", value_reason(name, v, rules))
        .when(kind == "comment", F.when(~suppressed(v, rules.rules), F.concat(F.lit("sig:"), F.col("found"))))
        .when(kind == "reason", F.when((v != "") & ~p.any_of([signals(name, r) for r in rules.rules]) & ~suppressed(v, rules.rules), F.nullif(p.classify(v), F.lit(""))))
    ))
    reason = F.when(kind.isin(*NAMED), by_rule(lambda r: named_reason(name, value, lang, r, rules.stopwords, kind), rules.rules)).otherwise(of_normal)
    raw = F.when(kind.isin("value", "reason"), normal).otherwise(value)
    # Exploded rather than filtered: a filter would be pushed below, and the reason be worked out twice.
    rows = candidates.withColumn("reason", F.explode(F.array_compact(F.array(reason)))).withColumn("raw_value", raw).drop("value")
    return finding_columns(rows)
