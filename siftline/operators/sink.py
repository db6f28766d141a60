"""Findings as NDJSON: one object a line, fields in a fixed order, empty ones left out."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .meta import claims

#: Fields that are there even when empty; the order is that of the output.
ALWAYS = ("name_path", "value_path", "name", "value", "raw_value", "value_sha256", "entropy", "name_value_similarity", "reason")
ORDER = ("file", "path", "line", "lang", "level", *ALWAYS, "tags", "filtered", "filtered_reason", "meta", "correlated")
ESCAPED = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029", "\x7f": "\x7f"}


def number(x: float) -> str:
    """The shortest decimal; whole numbers without a point."""
    x = float(x)
    if x.is_integer() and abs(x) < 1e21:
        return str(int(x))
    if 1e-6 <= abs(x) < 1e21:
        return format(x, "f") if "e" in repr(x) else repr(x)
    mantissa, exponent = repr(x).split("e") if "e" in repr(x) else format(x, "e").split("e")
    return f"{mantissa}e{exponent[0] if exponent[0] == '-' else '+'}{exponent.lstrip('+-').zfill(2)}"


def dumps(x: object) -> str:
    if isinstance(x, dict):
        return "{" + ",".join(f"{dumps(k)}:{dumps(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(dumps, x)) + "]"
    if isinstance(x, str):
        s = json.dumps(x, ensure_ascii=False)
        return "".join(ESCAPED.get(c, c) for c in s)
    if isinstance(x, bool) or x is None:
        return json.dumps(x)
    return number(x)


def meta_json(row: dict, now: float) -> str:
    parts = {}
    token = claims(row.get("jwt"), now)
    if token:
        order = ("issuer", "iat", "expiration", "is_expired", "header", "extra")
        parts["jwt"] = "{" + ",".join(f'"{k}":{dumps(token[k])}' for k in order if k in token) + "}"
    parts |= {k: dumps(row[k]) for k in ("username", "host", "url", "client_id", "client_key") if row.get(k)}
    if not parts and not row.get("has_meta"):
        return ""
    return "{" + ",".join(f'"{k}":{v}' for k, v in parts.items()) + "}"


def finding_json(row: dict, now: float) -> str:
    """One finding; row["correlated"] holds partners that are rendered already."""
    out = []
    for k in ORDER:
        if k == "meta":
            if m := meta_json(row, now):
                out.append(f'"meta":{m}')
        elif k == "correlated":
            if len(row.get(k) if row.get(k) is not None else ()):
                out.append(f'"correlated":[{",".join(row[k])}]')
        else:
            v = row.get(k)
            if v is not None and not isinstance(v, (str, bool, int, float)):
                v = list(v)
            if isinstance(v, float) and math.isnan(v):
                v = None
            if k in ALWAYS or v:
                out.append(f'"{k}":{dumps(v if v is not None else "")}')
    return "{" + ",".join(out) + "}"


def to_ndjson(findings: DataFrame, now: float) -> DataFrame:
    """(file, seq, value): a line for each finding; write.text() of value is the sink."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [finding_json(r, now) for r in batch.to_dict("records")]
            yield pd.DataFrame({"file": batch["file"], "seq": batch["seq"], "value": lines})

    return findings.mapInPandas(run, "file string, seq int, value string")
