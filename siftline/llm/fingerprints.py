"""SimHash fingerprints of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded_batches

SEED = 42
#: Hashes whose bits are counted at a time.
STEP = 1 << 16

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: bytes, size: int) -> list[bytes]:
    """Every run of `size` words, repeats included; fewer words make one shingle, no words none. Words end at ASCII white space."""
    words = text.translate(LOWER).split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(s, SEED) for s in found), "<u8", len(found))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    ones = np.zeros(64, "int64")
    for a in range(0, len(h), STEP):
        ones += np.unpackbits(h[a : a + STEP].view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def simhash(found: list[bytes]) -> int:
    """The 64 bits that are set in over half of the shingles' XXH64 hashes."""
    return majority(hashes(found))


def add_fingerprint(docs: DataFrame, size: int, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long and drop the text; a null text has no words, so fingerprint 0."""
    kept = [c for c in docs.columns if c not in (text, name)]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            fps = np.array([simhash(shingles((t.as_py() or "").encode(), size)) for t in texts], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], [*kept, name])

    bounded_batches(docs)
    fields = [f for f in docs.schema.fields if f.name in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{name}` long"])
    return docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text).alias("_text")).mapInArrow(digest, schema)
