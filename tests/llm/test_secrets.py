import hashlib
import random
import re

from siftline.llm.secrets import BASE, ORDER, PARTNERS, SCOPE, WEAK, scan_secrets, secret_report

LIMITS = {k: (re.compile(p), g, n) for k, p, g, n in BASE}


def brute(text):
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(LIMITS.items()):
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def texts():
    rng = random.Random(5)
    parts = ["token", "TOKEN", "passwd", "Api_Key", "apikey", "secret", '"', "'", " ", "  ", "=", ":", "abc", "é😀", "\n", "AKIA", "AKIA" + "A1" * 9, "a1" * 14, "f" * 23, "zz-9=", "password", "10.1.2.3", "user=bob", "https://h/x"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate([None, "", "plain words", "token = " + "a" * 100_000, *texts()])]
    got = {r.doc_id: r for r in secret_report(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        want = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert got[i].n_assign == sum(w.startswith("assign") for w in want) and got[i].n_hex == sum(w.startswith("hex") for w in want)
        assert set(want) <= set(got[i].spans.split(",") if got[i].spans else [])


def test_weak_parts_need_a_partner(spark):
    pad = "\n" + "word " * 80
    rows = [(1, "see 10.20.30.40 now"), (2, "see 10.20.30.40 and token=abcdef123"), (3, "see 10.20.30.40" + pad + "token=abcdef123"), (2, "see 10.20.30.40 and token=abcdef123"), (None, "user=bob password=hunter22")]
    got = [(r.doc_id, "endpoint" in r.spans, "ident" in r.spans) for r in secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, False, False), (2, True, False), (3, False, False), (2, True, False), (None, False, True)], key=str)


def brute_links(text):
    """Weak spans with a partner in scope, and the distances of all such partners."""
    spans = {k: [(m.start(), m.end()) for m in re.finditer(p.replace("{32,}+", "{32,}"), text or "") if len(m.group(g)) >= n] for k, p, g, n in BASE + WEAK}
    out = {}
    for kind, *_ in WEAK:
        for a, b in spans[kind]:
            gaps = {(k, s, e): max(s - b, a - e) for k in PARTNERS[kind] for s, e in spans[k]}
            if gaps and min(gaps.values()) <= SCOPE:
                out[kind, a, b] = gaps
    return out


def test_linked_spans_match_brute_force(spark):
    rng = random.Random(9)
    key = "aB3" * 12
    parts = ["token=abcdef1", "AKIA" + "Z9" * 9, "0f" * 13, key, "user=bob", "login: ann9", "10.1.2.3", "https://h.example/x?y", "word " * 20, "word " * 60, " ", "\n", "é😀 "]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(300)]
    got = {r.doc_id: r for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(len(r.links) for r in got.values()) > 300
    for i, text in rows:
        want = brute_links(text)
        links = {(x.kind, x.start, x.end): (x.partner.kind, x.partner.start, x.partner.end) for x in got[i].links}
        assert set(links) == set(want) and len(got[i].linked) == len(want), text
        for weak, partner in links.items():
            assert want[weak][partner] <= SCOPE
            assert max(want[weak][partner], 0) == max(min(want[weak].values()), 0), (weak, partner, text)


def test_dense_text(spark):
    rows = [(1, " ".join(f"{i:024x}" for i in range(20_000)) + " user=bob " + "x" * 2_000_000)]
    r = secret_report(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert r.n_hex == 20_000 and r.spans.endswith("hex:499975:499999,ident:500000:500008") and r.links == "ident:500000:500008>hex:499975:499999"


def test_clashing_columns(spark):
    names = ["row", "body", "low", "base", "linked", "links", "_s_low", *ORDER]
    frame = spark.createDataFrame([(1, "user=bob token=abcdef1", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = scan_secrets(frame).first()
    assert all(got[n] == n for n in names if n not in ("base", "linked", "links")) and len(got["base"]) == len(got["links"]) == 1


def test_empty_table(spark):
    assert secret_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
