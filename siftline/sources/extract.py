"""Files to candidates: one row for each name and value that a test may make a finding of.

Parsing needs Python and runs once a file; every decision about a candidate is a column expression later.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import RuleSet
from . import code, formats

#: How a file's findings are put in order: by line, path and hash; by line; as they were found.
BY_PLACE, BY_LINE, AS_FOUND = 0, 1, 2
#: The kind of the one row of a file that could not be read; no test makes it a finding.
UNREADABLE = "unreadable"
SCHEMA = "file string, lang string, seq int, mode int, kind string, rule int, path string, line int, name_path string, value_path string, name string, value string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [pa.int32() if c.endswith(" int") else pa.string() for c in SCHEMA.split(", ")]
LEAVES = "file string, line int, path string, name string, value string"
#: Candidates, and bytes of the files that they come from, that go back to Spark at a time, or those of one file.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20

#: Spark holds a file's bytes in one array.
LONGEST_FILE = 2**31 - 64

#: Formats by extension.
EXTENSIONS = {"json": "json", "jsonc": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "config": "xml", "properties": "properties", "ini": "ini"}

# What a line has to look like where a file as a whole cannot be read.
JSONISH = r"""["']?([A-Za-z0-9_.-]*(secret|token|password|passwd|pwd|key|credential)[A-Za-z0-9_.-]*)["']?\s*[:=]\s*["']([^"']{8,})["']"""
JSONISH_RE = re.compile(JSONISH.replace(r"\s", r"[\t\n\f\r ]"))
YAML_RE = re.compile(r"^[\t\n\f\r ]*([A-Za-z0-9_.-]+)[\t\n\f\r ]*:[\t\n\f\r ]*(.+?)[\t\n\f\r ]*$")
ENV_RE = re.compile(r"^[\t\n\f\r ]*(?:export[\t\n\f\r ]+)?([A-Za-z_][A-Za-z0-9_.]*)[\t\n\f\r ]*=[\t\n\f\r ]*(.*?)[\t\n\f\r ]*$")


def language(path: str) -> str:
    """The format of a file by its name, or an empty string."""
    base = path[path.rfind("/") + 1 :].lower()
    if base == ".env" or base.startswith(".env.") or base.endswith(".env"):
        return "dotenv"
    extension = base.rsplit(".", 1)[1] if "." in base else ""
    return code.EXTENSIONS.get(extension) or EXTENSIONS.get(extension, "")


def is_source(path: str) -> bool:
    return language(path) in code.LANGUAGES


def normal(s: str) -> str:
    return s.strip().strip("\"'")


class Emitter:
    """Rows of one file, in the order in which they are found."""

    def __init__(self, rules: RuleSet):
        self.rules, self.rows = rules.rules, []

    def add(self, kind: str, rule: int, path: str, line: int, name_path: str, value_path: str, name: str, value: str) -> None:
        self.rows.append((len(self.rows), kind, rule, path, line, name_path, value_path, name, value))

    def value(self, path: str, line: int, name: str, value: str) -> None:
        self.add("value", -1, path, line, "value_pattern", "value_pattern", name, value)

    def pair(self, path: str, line: int, how: str, name: str, value: str) -> None:
        """A name and a value in one place: every rule, then the value's shape."""
        for i in range(len(self.rules)):
            self.add("named", i, path, line, f"{how}_key", f"{how}_value", name, value)
        self.value(path, line, name, value)

    def tree(self, root: object, lines: formats.Lines) -> None:
        self.node(root, "$", lines)

    def node(self, node: object, path: str, lines: formats.Lines) -> None:
        if isinstance(node, str):
            self.value(path, lines.get(path, 0), path.rsplit(".", 1)[-1], node)
        elif isinstance(node, list):
            for i, x in enumerate(node):
                self.node(x, f"{path}[{i}]", lines)
        elif isinstance(node, dict):
            line = lambda k: lines.get(formats.join(path, k), 0)
            # By line, those without one last; keys differ, so what comes after them is never compared.
            members = sorted([((n := lines.get(p := f"{path}.{k}", 0)) == 0, n, k.encode("utf-8", "surrogatepass"), p, k, v) for k, v in node.items()])
            for i, rule in enumerate(self.rules):
                for name_path in rule.name_paths:
                    if name := found(node, name_path):
                        for value_path in rule.value_paths:
                            if value := found(node, value_path):
                                self.add("named", i, path, line(value_path), name_path, value_path, name, value)
                for _, n, _, p, k, v in members:
                    if isinstance(v, str):
                        self.add("named", i, p, n, "map_key", "map_value", k, v)
            for _, n, _, p, _, v in members:
                if isinstance(v, str):
                    self.value(p, n, p.rsplit(".", 1)[-1], v)
                else:
                    self.node(v, p, lines)

    def xml(self, text: str) -> None:
        for event, path, line, (name, body) in formats.xml_events(text):
            if event == "start":
                last = dict(body)
                for i, rule in enumerate(self.rules):
                    for a, v in body:
                        self.add("named", i, path, line, "xml_attr", "xml_attr_value", a, normal(v))
                    for name_path in rule.name_paths:
                        for value_path in rule.value_paths:
                            if name_path in last and normal(last.get(value_path, "")):
                                self.add("named", i, path, line, name_path, value_path, last[name_path], normal(last[value_path]))
                for a, v in body:
                    self.add("reason", -1, path, line, "xml_attr", "xml_attr_value", a, v)
                for a, v in body:
                    self.value(path, line, a, v)
            elif text := body.strip():
                for i in range(len(self.rules)):
                    self.add("named", i, path, line, "xml_element", "xml_text", name, text)
                self.add("reason", -1, path, line, "xml_element", "xml_text", name, text)
                self.value(path, line, name, text)


class Leaves(Emitter):
    """The leaves of one file after another, by columns; nothing is kept for rules, and a file's leaves are in no order."""

    def __init__(self):
        self.rules, self.columns = (), ([], [], [], [], [])

    def add(self, kind: str, rule: int, path: str, line: int, name_path: str, value_path: str, name: str, value: str) -> None:
        if kind == "value":
            self.value(path, line, name, value)

    def value(self, path: str, line: int, name: str, value: str) -> None:
        _, lines, paths, names, values = self.columns
        lines.append(line)
        paths.append(path)
        names.append(name)
        values.append(value)

    def tree(self, root: object, lines: formats.Lines) -> None:
        """In no order: only findings have one."""
        _, found_lines, paths, names, values = self.columns
        todo = [("$", root)]
        while todo:
            path, node = todo.pop()
            if isinstance(node, str):
                found_lines.append(lines.get(path, 0))
                paths.append(path)
                names.append(path[path.rfind(".") + 1 :])
                values.append(node)
            elif isinstance(node, dict):
                todo += [(f"{path}.{k}", x) for k, x in node.items()]
            elif isinstance(node, list):
                todo += [(f"{path}[{i}]", x) for i, x in enumerate(node)]

    def xml(self, text: str) -> None:
        for event, path, line, (name, body) in formats.xml_events(text):
            if event == "start":
                for a, v in body:
                    self.value(path, line, a, v)
            elif text := body.strip():
                self.value(path, line, name, text)

    def file(self, path: str, content: bytes) -> None:
        files, *rest = self.columns
        try:
            emit(path, bytes(content), self)
        except Exception:  # such a file has no leaves, as in rows_of
            for values in rest:
                del values[len(files) :]
        files += [path] * (len(rest[0]) - len(files))

    def batch(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([array_of(x, pa.int32() if i == 1 else pa.string()) for i, x in enumerate(self.columns)], [c.split()[0] for c in LEAVES.split(", ")])
        for values in self.columns:
            values.clear()
        return made


def found(node: object, dotted: str) -> str:
    for part in dotted.split("."):
        node = node.get(part) if isinstance(node, dict) else None
    return node.strip() if isinstance(node, str) else ""


def cut_comment(s: str) -> str:
    s = s.strip()
    at = s.find(" #")
    return normal(s[:at] if at >= 0 else s)


def yaml_pairs(text: str) -> Iterator[tuple[int, str, str]]:
    for i, line in enumerate(text.split("\n"), 1):
        if line.strip().startswith(("#", "{{", "-}}")):
            continue
        if m := YAML_RE.match(line):
            yield i, m[1], cut_comment(m[2])


def env_pairs(text: str) -> Iterator[tuple[int, str, str]]:
    for i, line in enumerate(text.split("\n"), 1):
        m = None if line.strip().startswith("#") else ENV_RE.match(line)
        if m:
            v = m[2].strip()
            quoted = len(v) > 1 and v[0] == v[-1] and v[0] in "\"'"
            yield i, m[1], v[1:-1] if quoted else cut_comment(v)


def jsonish_pairs(text: str) -> Iterator[tuple[int, str, str]]:
    for i, line in enumerate(text.split("\n"), 1):
        for m in JSONISH_RE.finditer(line):
            yield i, m[1], m[3]


TREES = {"json": formats.json_tree, "yaml": formats.yaml_tree, "dotenv": formats.dotenv_tree, "properties": formats.properties_tree, "ini": formats.ini_tree}
PAIRS = {"json": ("jsonish", jsonish_pairs), "yaml": ("yaml", yaml_pairs), "dotenv": ("env", env_pairs), "properties": ("properties", lambda t: formats.properties_pairs(t, False))}


def emit(path: str, content: bytes, out: Emitter) -> tuple[str, int]:
    """Hand what a file holds to out; the file's format, and how its findings are put in order."""
    lang, mode = language(path), BY_PLACE
    text = content.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    if lang == "xml":
        out.xml(text)
    elif lang in TREES:
        try:
            out.tree(*TREES[lang](text))
        except (formats.Unreadable, RecursionError):
            mode = AS_FOUND
            if lang == "ini":
                for line, section, key, value in formats.ini_lines(text):
                    if value is not None:
                        out.pair(f"[{section}] line:{line}" if section else "", line, "ini", key, value)
            else:
                how, pairs = PAIRS[lang]
                for line, key, value in pairs(text):
                    out.pair("", line, how, key, value)
    elif lang:
        mode = BY_LINE
        for row in code.candidates(text, lang, len(out.rules)):
            out.add(*row)
    return lang, mode


def candidates_of(path: str, content: bytes, rules: RuleSet) -> Iterator[tuple]:
    out = Emitter(rules)
    lang, mode = emit(path, content, out)
    for seq, kind, *rest in out.rows:
        yield (path, lang, seq, mode, kind, *rest)


def rows_of(path: str, content: bytes, rules: RuleSet) -> list[tuple]:
    """The candidates of a file, or one row with the error that its reading ended in."""
    try:
        return list(candidates_of(path, bytes(content), rules))
    except Exception as e:  # whatever one file's bytes do to a parser
        return [(path, language(path), 0, AS_FOUND, UNREADABLE, -1, "", 0, "", "", "", f"{type(e).__name__}: {e}")]


def whole(s: str | None) -> str | None:
    """s with U+FFFD for halves of surrogate pairs, which no encoding has."""
    return s if s is None else s.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def array_of(values, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array(map(whole, values), kind)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([array_of(values, kind) for values, kind in zip(zip(*rows), TYPES)], COLUMNS)


def extract(files: DataFrame, rules: RuleSet) -> DataFrame:
    """files: file, content (binary). One file is parsed whole by one task; a file that cannot be read in its format has its lines read.

    A file that no reader gets through does not stop the others: it leaves one row of kind UNREADABLE, with the error as its value.
    Many small files share a batch on their way back.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                content = content.as_py()
                rows += rows_of(path.as_py(), content, rules)
                held += len(content)
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES and rows:
                    yield batch_of(rows)
                    rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return files.select("file", "content").mapInArrow(run, SCHEMA)


def leaves(files: DataFrame) -> DataFrame:
    """files as for extract: the name and value of every leaf, where it is. These are extract's rows of kind value, without what only rules ask for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = Leaves(), 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = content.as_py()
                out.file(path, content)
                held += len(content or b"")
                if (n := len(out.columns[0])) >= BATCH_ROWS or held >= BATCH_BYTES and n:
                    yield out.batch()
                    held = 0
        if out.columns[0]:
            yield out.batch()

    return files.select("file", "content").mapInArrow(run, LEAVES)


def read_files(spark, root: str) -> DataFrame:
    """file, content of every file below root, or of the one file that it is. Files that vanish or fail while they are read, and those too large for one value, are skipped."""
    df = spark.read.format("binaryFile").options(recursiveFileLookup="true", ignoreMissingFiles="true", ignoreCorruptFiles="true").load(root).where(F.col("length") < LONGEST_FILE)
    return df.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), "content")


def from_text(df: DataFrame, file: str, text: str) -> DataFrame:
    """Files out of a table: columns that name and hold them. A table of few blocks may hold very many files, so they are dealt out."""
    files = df.select(F.col(file).cast("string").alias("file"), F.encode(F.col(text), "utf-8").alias("content")).where(F.col("content").isNotNull())
    return files.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
