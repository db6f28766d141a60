"""Pairing of findings that belong together, within one file and a few findings back.

Which findings may be which part of which rule is decided by columns: expressions over one finding, and, for rules
over two, over each of the few findings before it, by lag. What is left to fold is who takes whom, in order, and
each finding only once; that depends on what was taken before, so one pass over a file's findings does it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dialect import to_java
from ..functions.expressions import compile_bool, finding_env, pair_env
from ..plans.config import SECONDARY, Matcher, RuleSet
from ..sources.extract import AS_FOUND, BY_PLACE
from . import meta
from .sink import finding_json

META = ["username", "host", "url", "client_id", "client_key"]
SCHEMA = (
    "file string, seq int, path string, line int, lang string, level string, name_path string, value_path string, name string, value string, raw_value string, value_sha256 string, "
    "entropy double, name_value_similarity double, reason string, tags array<string>, jwt string, has_meta boolean, username string, host string, url string, client_id string, client_key string, "
    "correlated array<string>"
)

NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
TYPES = [ARROW[c.split()[1]] for c in SCHEMA.split(", ")]
#: What the fold adds, and what it decides by.
ADDED, DECIDING = ("tags", "correlated"), ("primary", "partners", "pairs")
#: Findings that go back to Spark at a time, or those of one file.
BATCH_ROWS = 4096


def matcher(m: Matcher | None) -> Column:
    if m is None:
        return F.lit(False)
    if m.expression:
        return compile_bool(m.expression, finding_env(F.col))
    out = F.lit(True)
    for column, pattern in (("name", m.name), ("reason", m.reason), ("path", m.path)):
        if pattern:
            out = out & F.col(column).rlike(to_java(pattern))
    return F.coalesce(out, F.lit(False))


def bits(tests: list[Column]) -> Column:
    """A text with a 1 for each test that holds, and a 0 for each other: Python is sent few values, not arrays."""
    return F.concat(*[F.when(t, "1").otherwise("0") for t in tests]) if tests else F.lit("")


def in_order(findings: DataFrame) -> DataFrame:
    """Add `ord`, from 0 within a file: by line, then path and hash, or as found, whichever the format asks for. No line comes last."""
    structured, plain = F.col("mode") == BY_PLACE, F.col("mode") == AS_FOUND
    place = F.when(plain, 0).otherwise(F.when(F.col("line") == 0, 2**31 - 1).otherwise(F.col("line")))
    keys = [place, F.when(structured, F.col("path")), F.when(structured, F.col("value_sha256")), F.col("seq"), F.col("sub")]
    return findings.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy(*keys)) - 1)


def with_masks(findings: DataFrame, rules: RuleSet) -> DataFrame:
    """Add `primary` (a bit a rule), `partners` (one a partner of each rule), and `pairs`: a bit for each rule and each step back, if it is over two findings and holds there."""
    lagged = Window.partitionBy("file").orderBy("ord")
    flat = [m for c in rules.correlations for m in c.partners]
    out = findings.withColumn("primary", bits([matcher(c.match) for c in rules.correlations])).withColumn("partners", bits([matcher(m) for m in flat]))
    backs = range(1, rules.window + 1)
    if any(c.when for c in rules.correlations):
        asked: set[str] = set()
        for c in rules.correlations:
            if c.when:
                compile_bool(c.when, pair_env(F.col, lambda n: asked.add(n) or F.col(n)))
        out = out.withColumn("_whole", F.struct(F.lit(True).alias("_there"), *[F.col(c) for c in sorted(asked)]))
        for k in backs:
            out = out.withColumn(f"_back{k}", F.lag("_whole", k).over(lagged))
        tests = []
        for c in rules.correlations:
            if c.when:
                tests += [F.col(f"_back{k}").isNotNull() & compile_bool(c.when, pair_env(F.col, lambda n, k=k: F.col(f"_back{k}")[n])) for k in backs]
            else:
                tests += [F.lit(False) for _ in backs]
        out = out.withColumn("pairs", bits(tests)).drop("_whole", *[f"_back{k}" for k in backs])
    else:
        out = out.withColumn("pairs", F.lit(""))
    return out


def add(tags: list[str], tag: str) -> list[str]:
    return tags if not tag or tag in tags else [*tags, tag]


def enrich(primary: dict, partner: dict) -> None:
    """Fill one empty field of the primary's metadata from a partner, by what the partner's name says it is."""
    name = partner["name"].lower()
    leaf = name.rsplit(".", 1)[-1]
    if "client" in name and ("secret" in name or "key" in name):
        field, value = "client_key", partner["value"]
    elif "client" in name and "id" in name or "appid" in name or "app_id" in name:
        field, value = "client_id", partner["raw_value"]
    elif "user" in name:
        field, value = "username", partner["raw_value"]
    elif any(x in leaf for x in ("url", "uri", "endpoint")) or partner["reason"].startswith("info:") or "url" in partner["reason"]:
        field, value = "url", partner["raw_value"]
    else:
        return
    primary["has_meta"] = True
    primary[field] = primary[field] or value


def fold(rows: list[dict], rules: RuleSet, now: float) -> list[dict]:
    """A file's findings in order, with partners moved into their primaries."""
    offsets, total = [], 0
    for c in rules.correlations:
        offsets.append(total)
        total += len(c.partners)
    taken: set[int] = set()
    for i, row in enumerate(rows):
        before = range(max(0, i - rules.window), i)
        for r, c in enumerate(rules.correlations):
            if c.when:
                chosen = [j for j in before if j not in taken and row["pairs"][r * rules.window + i - j - 1] == "1"]
            elif row["primary"][r] != "1":
                continue
            else:
                chosen = []
                for k in range(len(c.partners)):
                    j = next((j for j in before if j not in taken and j not in chosen and rows[j]["partners"][offsets[r] + k] == "1"), None)
                    if j is None:
                        chosen = []
                        break
                    chosen.append(j)
            if not chosen:
                continue
            row["tags"] = add(row["tags"], c.tag)
            for j in chosen:
                taken.add(j)
                partner = rows[j]
                enrich(row, partner)
                row["correlated"].append(finding_json({**partner, "file": "", "tags": add(add(partner["tags"], c.tag), SECONDARY)}, now))
            break
    return [row for i, row in enumerate(rows) if i not in taken]


def correlate(findings: DataFrame, rules: RuleSet, now: float) -> DataFrame:
    """Top-level findings, in SCHEMA; partners are rendered into `correlated`. One file's findings meet in one task."""
    ready = with_masks(in_order(meta.with_meta(findings)), rules)

    def folded(rows: list[dict]) -> list[dict]:
        for r in rows:
            r |= {k: "" for k in META if r[k] is None} | {"tags": [], "correlated": [], "own_lang": r["lang"], "lang": ""}
        return [r | {"lang": r["own_lang"], "seq": i} for i, r in enumerate(fold(rows, rules, now))]

    def batch_of(done: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], t) for n, t in zip(NAMES, TYPES)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        done: list[dict] = []
        for batch in batches:
            for values in zip(*[c.to_pylist() for c in batch.columns]):
                r = dict(zip(batch.schema.names, values))
                if held and held[0]["file"] != r["file"]:
                    done += folded(held)
                    held = []
                held.append(r)
            if len(done) >= BATCH_ROWS:
                yield batch_of(done)
                done = []
        if held:
            done += folded(held)
        if done:
            yield batch_of(done)

    # The windows have brought each file's findings into one partition.
    return ready.sortWithinPartitions("file", "ord").select(*[n for n in NAMES if n not in ADDED], *DECIDING).mapInArrow(run, SCHEMA)
