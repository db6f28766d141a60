import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftline.llm.packing import pack_counts, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.dictionaries(st.integers(1, 24), st.integers(1, 40)))
def test_counts_are_packed_whole(counts):
    runs, total = pack_counts(counts, 24)
    fill, ranks = defaultdict(list), Counter()
    ends = {}
    for i, (length, rank, per, first, offset) in enumerate(runs):
        end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[length]
        for k in range(end - rank):
            fill[first + k // per].append((offset + k % per * length, length))
            ranks[length] += 1
        ends[length] = end
    assert ranks == Counter(counts) and len(fill) == total
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 24
    # Never worse than first-fit decreasing.
    bins: list[int] = []
    for s in sorted(Counter(counts).elements(), reverse=True):
        i = next((i for i, b in enumerate(bins) if b + s <= 24), None)
        if i is None:
            bins.append(s)
        else:
            bins[i] += s
    assert total <= len(bins) * 1.1 + 1


def test_documents(spark):
    texts = [None, "", " \t\n", "Hello, it's 1234 <|endoftext|> wörld\x1cx　y", "word " * 9000, "é ́x ﬁ 😀", *(f"some text {i} " * (i * 7 % 90) for i in range(300)), *["same text"] * 100]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "no key", 0), (3, "again", 1), (3, "again", 1)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        ends = [0, *(o + n for o, n in sorted(items))]
        assert [o for o, _ in sorted(items)] == ends[:-1] and ends[-1] <= 4096
    assert len(bins) <= sum(r.length for r in got) / 4096 + 2


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_words_alone_have_the_ids_of_their_text():
    import random

    from siftline.llm.packing import id_bytes

    rng = random.Random(0)
    alphabet = ["'", "S", "s", "ll", "re", "D", "é", "É", "ß", "ÿ", "Ø", "×", "1", "42", "!", "...", "<|", "|>", "_", "a", "Word", "ª", "µ", "\x1f", "́", "ﬁ", "中", "İ", "<|endoftext|>"]
    words = ["".join(rng.choices(alphabet, k=rng.randint(1, 6))).encode() for _ in range(5000)]
    tokenizer = Tokenizer.from_file(PATH)
    cache = id_bytes(PATH)
    for part in (words, words[:40], words[:3000]):
        want = tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids
        assert np.frombuffer(b"".join(cache.all(part)), "<u4").tolist() == want


def test_parts_are_kept_once():
    """Words that differ by capitals and punctuation alone were tokenised one by one, and kept so."""
    from siftline.llm.packing import IdCache

    cache = IdCache(PATH)
    texts = ["Stone, stone; STONE! (stone)", "stone's stone 42 \x0b stone\t'LL", "stöne <|endoftext|> ª\u0301", "", "</w> </W>x", "e\u0301 é É 中\u3000文 \x1c İ"]
    tokenizer = Tokenizer.from_file(PATH)
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(cache.all(cache.split(text))), "<u4").tolist() == ids
        if text == texts[1]:
            assert len(cache.young) == 10


def test_other_vocabularies_are_not_split(tmp_path):
    """One that keeps capitals has its own ids for them."""
    from siftline.llm.packing import IdCache

    own = Tokenizer.from_file(PATH)
    own.normalizer = None
    own.save(str(tmp_path / "own.json"))
    cache = IdCache(str(tmp_path / "own.json"))
    got = np.frombuffer(b"".join(cache.all(cache.split("Stone it's A"))), "<u4").tolist()
    assert got == own.encode("Stone it's A", add_special_tokens=False).ids != Tokenizer.from_file(PATH).encode("Stone it's A", add_special_tokens=False).ids
