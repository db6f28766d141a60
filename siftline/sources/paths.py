"""Which files are scanned, and under which configuration."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import any_of

#: Names of a configuration at the root of a repository.
LOCAL_NAMES = (".siftline.yaml", ".siftline.yml")


def glob_pattern(glob: str) -> str | None:
    """A glob over whole slash paths as a pattern: ** crosses slashes, * and ? do not, [..] and {a,b} as usual. None if it is malformed."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return None
            body = glob[i + 1 : end].replace("[", "\\[").replace("&", "\\&")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\":
            if i + 1 == len(glob):
                return None
            out, i = out + re.escape(glob[i + 1]), i + 1
        else:
            out += re.escape(c)
        i += 1
    return None if depth else f"(?s)^{out}\\z"


def matches_glob(path: Column, globs: tuple[str, ...]) -> Column:
    return any_of([path.rlike(p) for g in globs if (p := glob_pattern(g)) is not None])


def allowed(path: Column, allow: tuple[str, ...], deny: tuple[str, ...]) -> Column:
    """Deny globs first; then any allow glob, or all paths if there is none."""
    return ~matches_glob(path, deny) & (matches_glob(path, allow) if allow else F.lit(True))


def extension_pattern(names: dict[str, str]) -> str:
    return r"(?i)\.(?:" + "|".join(names) + r")\z"


def language_column(path: Column) -> Column:
    """The format of a file by its name, or an empty string."""
    from . import code, extract

    base = F.lower(F.element_at(F.split(path, "/"), -1))
    extension = F.regexp_extract(base, r"\.([^.]*)\z", 1)
    of = F.lit("")
    for e, lang in (extract.EXTENSIONS | code.EXTENSIONS).items():
        of = F.when(extension == e, lang).otherwise(of)
    return F.when(base.rlike(r"^\.env\z|^\.env\.|\.env\z"), "dotenv").otherwise(of)


def nearest_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Add `root`, the longest of roots.root that a file lies below, or null: each file joins on its ancestors, no pair of all is formed."""
    parts = F.split(F.col("file"), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    up = files.select("file").distinct().withColumn("root", F.explode(F.array_distinct(above)))
    best = up.join(roots.select("root").distinct(), "root").groupBy("file").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.join(best, "file", "left")


class Resolver:
    """The configuration of each directory: that of the nearest repository above it, below the scanned root, or the base."""

    def __init__(self, base, load, root: str, enabled: bool = True, names: tuple[str, ...] = LOCAL_NAMES):
        self.base, self.load, self.enabled, self.names = base, load, enabled, names
        self.root, self.known = os.path.abspath(root), {}

    def of(self, path: str):
        return self.of_folder(os.path.dirname(os.path.abspath(path))) if self.enabled else self.base

    def of_folder(self, folder: str):
        if folder not in self.known:
            if os.path.exists(os.path.join(folder, ".git")):
                own = next((os.path.join(folder, n) for n in self.names if os.path.isfile(os.path.join(folder, n))), None)
                self.known[folder] = self.load(own) if own else self.base
            else:
                up = os.path.dirname(folder)
                self.known[folder] = self.base if folder in (self.root, up) else self.of_folder(up)
        return self.known[folder]
