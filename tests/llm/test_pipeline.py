"""The pipeline, stage by stage, against plain versions on a small fixture."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siftline.llm import toxicity

from test_similar import brute as groups
from test_substrings import brute as removed
from test_substrings import split

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    passage = " ".join(rng.choices(words, k=60))
    texts, labels = [None, "", "write to ann.lee@mail.example.com or 10.1.2.3"], []
    for i in range(500):
        own = rng.choices(words, k=rng.randint(20, 150))
        if i % 7 == 0:
            for _ in range(4):
                own.insert(rng.randrange(len(own)), rng.choice(["vile", "rotten", "abominable"]))
        labels.append((len(texts), 1, int(i % 7 == 0)))
        if i % 11 == 0:
            own += passage.split()
        if i % 13 == 0:
            own.append(f"bob{i}@mail.example.com")
        texts.append(" ".join(own))
        if i % 9 == 0:
            texts += [texts[-1], texts[-1] + " more"]
    texts.append(" ".join(rng.choices(words, k=9000)))
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, labels = corpus()
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        out[name] = (before, [tuple(r) for r in docs.collect()])
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(n == len(t or "") for _, t, _, _, n in out[name][1])
    before, after = out["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))

    def plain(text):
        scores = [model.word(w) for w in toxicity.WORD.findall((text or "").lower())]
        best = []
        for a, b, s in toxicity.segments(scores):
            e = model.rate * len(scores) * 2.718281828459045 ** (-model.decay * s)
            best += [(a, b, s, e)]
        return model.score(model.evidence(best))

    assert Counter(after) == Counter(r for r in before if plain(r[1]) < 0.5) and len(after) < len(before)
    bad = {i for i, t, *_ in rows if t and len(re.findall("vile|rotten|abominable", t)) >= 4}
    kept = {r[0] for r in after}
    assert len(bad - kept) >= 0.95 * len(bad) and len(kept) >= 0.98 * (len(rows) - len(bad))
    before, after = out["near_duplicates"]
    of = groups(before)
    assert Counter(after) == Counter(r for r in before if of[r[0]] == r[0]) and len(after) < len(before)
    before, after = out["repeated_passages"]
    want = {i: kept for i, _, _, kept in removed(before, 13)}
    assert {r[0]: split(r[1]) for r in after} == want and len(after) == len(before)
    assert sum(map(len, want.values())) < sum(len(split(r[1])) for r in before)
    before, after = out["personal_data"]
    old, new = dict((r[0], r[1]) for r in before), dict((r[0], r[1]) for r in after)
    assert old.keys() == new.keys()
    mail = re.compile(r"[\w.]+@[\w.]+|10\.1\.2\.3")
    assert any(mail.search(t or "") for t in old.values())
    for i, t in old.items():
        assert (t is None) == (new[i] is None) and mail.split(t or "")[0] == (new[i] or "")[: len(mail.split(t or "")[0])]
        assert not any(x in new[i] for x in mail.findall(t or ""))
        if t and not mail.search(t):
            assert new[i] == t
    before, after = out["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens, bins = Counter(), defaultdict(int)
    for doc, _, _, length, _, sequence, _ in after:
        tokens[doc] += length
        bins[sequence] += length
    assert tokens == Counter({i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t, *_ in before})
    assert max(bins.values()) <= 4096 and len(bins) <= sum(bins.values()) / 4096 + 2
    got = [tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()]
    assert Counter(got) == Counter(r[:5] for r in after)
