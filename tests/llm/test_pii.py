import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftline.llm import pii
from siftline.llm.pii import replace_personal_data, tweaks

SCHEMA = "doc_id long, text string, n_found long, _e string"


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])


def run(spark, texts, **how):
    rows = [(i, t, 9, "x") for i, t in enumerate(texts)]
    got = replace_personal_data(spark.createDataFrame(rows, SCHEMA), **{"secret": "test", **how}).orderBy("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(len(texts)))
    return got


SHAPES = [
    ("write to Bob.Smith7@Mail3.example.com, now", r"write to [A-Z][a-z]{2}\.[A-Z][a-z]{4}\d@[A-Z][a-z]{3}\d\.[a-z]{7}\.com, now"),
    ("éla.12@mail.example.com***", r"[àáâäåæçèéêëìíîïñòóôöùúûü][a-z]{2}\.\d\d@[a-z]{4}\.[a-z]{7}\.com\*\*\*"),
    ("call +1 (614) 555-8001%%%", r"call \+1 \(\d{3}\) \d{3}-\d{4}%%%"),
    ("(614) 555-8001 or 614-555-8001", r"\(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}"),
    ("4111 1111 1111 1111!", r"4\d{3} \d{4} \d{4} \d{4}!"),
    ("4785380592391139$$$ 4785380592391139", r"4\d{15}\$\$\$ 4\d{15}"),
    ("ssn 123-45-6789.", r"ssn \d{3}-\d{2}-\d{4}\."),
    ("Mrs. Ada Lovelace met Mr Gauss", r"Mrs\. (%s) [A-Z][a-z]+ met Mr [A-Z][a-z]+" % "|".join(pii.NAMES["latin"]["f"])),
    ("Dr Анна Иванова", r"Dr [А-Я][а-яё]+ [А-Я][а-яё-]+"),
    ("from 152.143.123.131. End", r"from (\d{1,3}\.){3}\d{1,3}\. End"),
]


def test_shapes(spark):
    got = run(spark, [t for t, _ in SHAPES])
    for (text, shape), r in zip(SHAPES, got):
        assert re.fullmatch(shape, r.text), (text, r.text)
        assert r.text != text and r.n_found == len(re.findall(" or | met |\\$ ", text)) + 1
    assert luhn(got[4].text) % 10 == 0
    assert len(set(re.findall(r"4\d{15}", got[5].text))) == 1
    assert all(int(o) < 256 for o in re.findall(r"\d+", got[9].text))


def test_left_alone(spark):
    texts = [None, "", "plain words", "v1.2.3 and 1,000 and 2024-01-02", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "a@b", "999.300.1.1", "x " * 200_000]
    assert [(r.text, r.n_found) for r in run(spark, texts)] == [(t, 0) for t in texts]


def test_coreference_and_distinctness(spark):
    numbers = [f"{4 * 10**15 + 7919 * i}" for i in range(400)]
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(600)]
    emails = [f"{a}{i}@x{i % 3}.example.org" for i in range(40) for a in ("ann", "Ann", "bob")]
    names = [f"{t} {chr(65 + i % 26)}{chr(97 + i // 26)}x{'' if i % 2 else ' Yz'}" for i in range(200) for t in ("Frau", "Herr")]
    texts = numbers + ips + emails + names + ["card " + numbers[5][:4] + "-" + "-".join(numbers[5][i : i + 4] for i in (4, 8, 12)), numbers[5]]
    got = [r.text for r in run(spark, texts)]
    seen = defaultdict(set)
    for old, new in zip(texts, got):
        seen[old.lower()].add(new.lower())
        assert new != old
    assert all(len(v) == 1 for v in seen.values())
    news = [next(iter(v)) for k, v in seen.items() if not k.startswith("card")]
    assert len(set(news)) == len(news) and not set(news) & set(seen)
    assert re.sub(r"\D", "", got[-2]) == got[-1]
    domains = defaultdict(set)
    for old, new in zip(emails, got[len(numbers) + len(ips) :]):
        domains[old.split("@")[1]].add(new.split("@")[1])
    assert len({next(iter(d)) for d in domains.values() if len(d) == 1}) == 3


@pytest.mark.parametrize("limit", [10_000, 0])
def test_clashes_are_resolved(spark, monkeypatch, limit):
    monkeypatch.setattr(pii, "TWEAKED", limit)
    monkeypatch.setattr(pii, "NAMES", {s: {"f": ["Alma"], "m": ["Emil"], "last": ["Adler", "Berger"]} for s in ("latin", "cyrillic")})
    texts = [f"Frau {a} met 7.7.7.{i}" for i, a in enumerate(["Unruh", "Vogel", "Wolf", "Unruh", "Adler", "Zorn"])]
    need = tweaks(spark.createDataFrame([(t,) for t in texts], "text string"), "k", "text").collect()
    assert need
    got = [r.text.split(" met ")[0] for r in run(spark, texts, secret="k")]
    assert got[0] == got[3] and len(set(got)) == 5 and "Frau Adler" not in got


SCRIPTS = {
    "cjk": ("张三丰@公司企业.中国", r"[\u4e00-\u9ffc]{3}@[\u4e00-\u9ffc]{4}\.中国"),
    "cjk prose": ("谢谢@小明.明天见", r"[\u4e00-\u9ffc]{2}@[\u4e00-\u9ffc]{2}\.明天见"),
    "beyond 16 bits": ("𠀀𠀁@𠮷野.中国", r"[\U00020000-\U0002a6dd]{2}@[\U00020000-\U0002a6dd][\u4e00-\u9ffc]\.中国"),
    "greek": ("Γδ@δέλτα.ελ", r"[Α-Ω][α-ω]@[α-ω][ά-ώἀ-ῷ][α-ω]{3}\.ελ"),
    "cyrillic": ("Подъёмный.ключ@ёлкаый.рф", r"[А-ЯЁ][а-яё]{8}\.[а-яё]{4}@[а-яё]{6}\.рф"),
    "hangul": ("홍길동@회사회사.한국", r"[가-힣]{3}@[가-힣]{4}\.한국"),
    "arabic": ("محمد@مثالمثال.مصر", r"\w{4}@\w{8}\.مصر"),
    "digits": ("٠١٢٣٤@दफतर.कम", r"[٠-٩]{5}@[\u0904-\u097f]{4}\.कम"),
    "latin": ("Żółć.ßẞþ@øýãő.pl", r"\w{4}\.\w{3}@\w{4}\.pl"),
    "nothing to move": ("_@-.com", r"_[0-9a-f]+@-\.com"),
    "greek name": ("Dr Γιώργος Σεφέρης", r"Dr [Α-Ω]\w{6} [Α-Ω]\w{6}"),
    "armenian name": ("Mr Արամ", r"Mr [Ա-Ֆ][ա-ֆ]{3}"),
}


def test_scripts(spark):
    got = [r.text for r in run(spark, [t for t, _ in SCRIPTS.values()])]
    for (name, (text, shape)), new in zip(SCRIPTS.items(), got):
        assert re.fullmatch(shape, new), (name, text, new)
        assert not any(a == b for a, b in zip(text.split(".")[0], new.split(".")[0]) if a.isalpha() and name == "cjk"), (name, new)
        assert new != text


def test_letters_move_within_their_alphabet(spark):
    texts = [f"{c * 3}q@x.com" for x in (pii.LETTERS[::37], "".join(chr(a) + chr(b) for a, b in pii.RANGES)) for c in x if c.lower() == c]
    frame = spark.createDataFrame([(t[0], t) for t in texts], "c string, text string")
    moved = frame.select("c", pii.shifted(F.col("c"), F.sha2("text", 256), pii.other_table()).alias("new")).collect()
    known = set(pii.LETTERS) | {chr(p) for a, b in pii.RANGES for p in range(a, b + 1)}
    assert len(moved) == len(texts) and all(len(r.new) == 1 and r.new in known for r in moved)
    assert sum(r.c != r.new for r in moved) > 0.8 * len(moved)
    assert all(unicodedata.category(r.c) == unicodedata.category(r.new) for r in moved if r.c not in pii.LETTERS[pii.STARTS[-2] - 1 :])


def test_crowded_shape(spark):
    texts = [f"{a}@{b}.com" for a in "0123456789" for b in "0123456789"]
    got = [r.text for r in run(spark, texts)]
    assert len(set(got)) == len(texts) and not set(got) & set(texts)


def test_empty(spark):
    assert replace_personal_data(spark.createDataFrame([], SCHEMA), "k").count() == 0


def test_people_keep_their_names(spark):
    texts = ["Mr John Smith", "Mr Smith", "Dr John Smith", "Mrs Mary Smith", "Prof Mary Ann Smith", "Mr John Doe"]
    got = [r.text.split(" ") for r in run(spark, texts)]
    john, smith = got[0][1:]
    assert [g[-1] for g in got[:5]] == [smith] * 5 and got[2][1] == got[5][1] == john
    assert john in pii.NAMES["latin"]["m"] and got[3][1] in pii.NAMES["latin"]["f"] and got[5][2] != smith
    assert [len(g) for g in got] == [len(t.split(" ")) for t in texts]


def test_long_and_hostile_texts(spark):
    texts = ["x@" + "a." * 200_000, "write to λμ@νξ.gr now", "see __@--.xx", "a." * 100_000 + "b@c.de", "x@" + "a-" * 100_000 + ".com"]
    got = run(spark, texts)
    assert [r.n_found for r in got] == [0, 1, 1, 0, 0]
    assert [r.text != t for r, t in zip(got, texts)] == [False, True, True, False, False]


def test_clashing_columns(spark):
    names = ["row", "body", "sha", "found", "known", "_found", "_sha", "_tweaks", "kind", "core", "n"]
    rows = [(1, "to bob@example.org", *names)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = replace_personal_data(frame, "k")
    assert got.columns == [*frame.columns, "n_found"]
    assert [got.first()[n] for n in names] == names and got.first().n_found == 1
