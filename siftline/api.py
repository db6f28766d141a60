"""Scans: files or text columns in, findings out."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.comments import expand_comments
from .operators.correlate import correlate
from .operators.detect import findings
from .operators.filters import apply_filters
from .operators.sink import to_ndjson
from .plans.config import DEFAULT, RuleSet, compile_config
from .sources.code import LANGUAGES
from .sources.extract import UNREADABLE, extract, from_text, read_files
from .sources.paths import Resolver, allowed, language_column, nearest_root


def default_rules(stopwords: tuple[str, ...] = ()) -> RuleSet:
    return compile_config(DEFAULT, stopwords)


def scan_files(files: DataFrame, rules: RuleSet, keep_filtered: bool = False, now: float | None = None) -> DataFrame:
    """files: file, content. Findings with partners folded, filters applied, in order of seq within a file."""
    candidates = expand_comments(extract(files, rules))
    return apply_filters(correlate(findings(candidates, rules), rules, time.time() if now is None else now), rules, keep_filtered)


def unreadable(files: DataFrame, rules: RuleSet) -> DataFrame:
    """(file, error) of the files, as scan_files takes them, that no reader gets through; a scan goes on without them."""
    return extract(files, rules).where(F.col("kind") == UNREADABLE).select("file", F.col("value").alias("error"))


def scan_path(spark: SparkSession, root: str, rules: RuleSet, mode: str = "all", keep_filtered: bool = False, now: float | None = None) -> DataFrame:
    """Scan a file or folder. Names are judged before contents are read; mode is all, source or config."""
    if mode not in ("all", "source", "config"):
        raise ValueError(f"unknown scan mode {mode!r}")
    files = read_files(spark, os.path.abspath(root) if "://" not in root else root)
    return _scan_allowed(files, rules, mode, keep_filtered, now)


def scan_table(df: DataFrame, file: str, text: str, rules: RuleSet, keep_filtered: bool = False, now: float | None = None) -> DataFrame:
    """Scan texts in a column under the names in another, which tell their formats."""
    return scan_files(from_text(df, file, text), rules, keep_filtered, now)


def ndjson(found: DataFrame, now: float | None = None) -> DataFrame:
    return to_ndjson(found, time.time() if now is None else now).orderBy("file", "seq").select("value")


def exit_status(found: DataFrame) -> int:
    """1 if there is any finding that is not filtered, else 0."""
    return int(bool(found.where(~F.col("filtered")).limit(1).count()))


def scan_repositories(spark: SparkSession, root: str, base: RuleSet, load: Callable[[str], RuleSet], mode: str = "all", keep_filtered: bool = False, now: float | None = None) -> DataFrame:
    """Scan a folder, each file under the configuration of the nearest repository above it, where it brings one.

    The folders of repositories, not their files, are looked at by the driver; one plan for each configuration.
    """
    roots = {os.path.dirname(p) if os.path.basename(p) == ".git" else p for p in _git_entries(root)}
    resolver = Resolver(base, load, root)
    files = read_files(spark, os.path.abspath(root))
    placed = nearest_root(files, spark.createDataFrame([(r,) for r in sorted(roots)], "root string"))
    out = None
    by: dict[int, tuple[RuleSet, list[str]]] = {}
    for r in sorted(roots):
        own = resolver.of_folder(r)
        by.setdefault(id(own), (own, []))[1].append(r)
    groups = [(own, F.col("root").isin(names) | (F.col("root").isNull() if own is base else F.lit(False))) for own, names in by.values()]
    if id(base) not in by:
        groups.append((base, F.col("root").isNull()))
    for rules, belongs in groups:
        part = _scan_allowed(placed.where(belongs).drop("root"), rules, mode, keep_filtered, now)
        out = part if out is None else out.unionByName(part)
    return out


def _git_entries(root: str) -> list[str]:
    found = []
    for folder, folders, names in os.walk(os.path.abspath(root)):
        if ".git" in folders or ".git" in names:
            found.append(os.path.join(folder, ".git"))
        folders[:] = [f for f in folders if f != ".git"]
    return found


def _scan_allowed(files: DataFrame, rules: RuleSet, mode: str, keep_filtered: bool, now: float | None) -> DataFrame:
    path = F.col("file")
    keep = allowed(path, rules.allow, rules.deny) & (language_column(path) != "")
    if mode != "all":
        source = language_column(path).isin(*LANGUAGES)
        keep = keep & (source if mode == "source" else ~source)
    return scan_files(files.where(keep), rules, keep_filtered, now)
