import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from siftline.functions import predicates, text, urls
from siftline.functions.dialect import PatternError, required_literal, to_java
from siftline.functions.expressions import ExpressionError, compile_bool, finding_env, name_value_env
from siftline.plans.patterns import HOSTS, VALUE_PATTERNS


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


def test_patterns_match_as_in_re2(spark):
    rng = random.Random(1)
    pieces = ["a", "K", "K", "é", "ghp_", "_", " ", "\n", "\x0b", "\x85", "$", "]", "[", "7", ".", "x", "\\", "ſ"]
    values = ["".join(rng.choices(pieces, k=rng.randint(0, 6))) for _ in range(400)]
    for pattern in [r"\bghp_", r"a$", "^.+$", r"\sx", r"[\s]7", "(?i)k", "(?i:k)x", r"[[:alnum:]]\.", r"[^[:space:]]]", "[]a]", r"(?P<n_1>a)x", r"(?m)a$", r"\Ba", "(?-i:K)", r"[a\]]7", "s(?i)s"]:
        want = [r[0] for r in duckdb.execute("select regexp_matches(v, ?) from (select unnest(?) v, unnest(range(?)) i) order by i", [pattern, values, len(values)]).fetchall()]
        assert column(spark, values, lambda v: v.rlike(to_java(pattern))) == want, pattern


def test_bad_patterns():
    for pattern in ["(", "[a", "a)", "\\", r"(?=a)", r"\1", "*a", "(?<=a)", "[[:nope:]]"]:
        with pytest.raises(PatternError):
            to_java(pattern)
    assert all(to_java(p) for _, p, _ in VALUE_PATTERNS) and all(to_java(p) for _, p in HOSTS)


def plain_entropy(v):
    return -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()) if v else 0.0


def plain_jaro(a, b):
    if not a and not b:
        return 1.0
    reach, used, met = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            met.append(c)
    if not met:
        return 0.0
    moved = sum(x != y for x, y in zip(met, [b[j] for j in sorted(used)]))
    return (len(met) / len(a) + len(met) / len(b) + (len(met) - moved / 2) / len(met)) / 3


def plain_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    most = max(len(a), len(b))
    prefix = next((i for i in range(4) if i >= min(len(a), len(b)) or a[i] != b[i]), 4)
    j = plain_jaro(a, b)
    return max(1 - row[-1] / most if most else 1.0, j + prefix * 0.1 * (1 - j))


def test_entropy_and_similarity(spark):
    rng = random.Random(2)
    pairs = [("", ""), ("a", ""), ("password", "password1"), ("é😀x", "x😀é")] + [tuple("".join(rng.choices("abcdé😀_1", k=rng.randint(0, 12))) for _ in "ab") for _ in range(300)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = frame.select("i", "a", "b", text.entropy(F.col("a")).alias("e"), text.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert r.e == pytest.approx(plain_entropy(r.a), abs=1e-9)
        assert r.s == pytest.approx(plain_similarity(r.a, r.b), abs=1e-9), (r.a, r.b)


def test_scalars(spark):
    assert column(spark, [" 'a\" ", "\u00a0x\u2003", '""', "'' a ''"], text.normalize) == ["a", "x", "", " a "]
    assert column(spark, ["12345678", "123456789", "ééééé"], text.redact) == ["********", "1234********6789", "éé********éé"]
    assert column(spark, ["apiKey", "API-KEY x9", "SubscriptionID", "__", "aéB"], lambda v: F.array_join(text.identifier_words(v), " ")) == ["api key", "api key x9", "subscription id", "", "aé b"]
    prose = ["one two three four", "a b c", "mother's and/or e-mail text", "x1 y2 z3 w4", "- - - word", "« ça » va très bien ici"]
    assert column(spark, prose, text.natural_language) == [True, False, True, False, True, True]


def test_urls(spark):
    cases = {
        "https://a.b/c?d=e": (True, False, False), "https://u:p@h/x": (True, True, False), "https://u@h": (True, True, False), "https://h/?api_key=1": (True, False, True), "https://h/?api_key=": (True, False, False),
        "https://h/?a;token=1": (True, False, False), "jdbc:mysql://u:p@h/": (False, False, False), "u@h": (False, False, False), "http://h:x/": (False, False, False), "http://h h/": (False, False, False),
        "http:///p": (False, False, False), "http://h/%zz": (False, False, False), "1http://h": (False, False, False), " 'http://[::1]:80/' ": (True, False, False), "http://h\x07": (False, False, False), "http://@h": (True, True, False),
    }
    values = list(cases)
    assert column(spark, values, lambda v: urls.is_url(text.normalize(v))) == [c[0] for c in cases.values()]
    assert column(spark, values, urls.has_credentials) == [c[1] for c in cases.values()]
    assert column(spark, values, urls.has_secret_param) == [c[2] for c in cases.values()]


def test_placeholders(spark):
    values = ["${A}", "x$(B)y", "{{ c }}", "%D%", "p%41ss%2F", "@E@", "http://@E@-h", "a@b.c"]
    assert column(spark, values, lambda v: predicates.placeholder(v, F.lit("json"))) == [True, True, True, True, False, True, False, False]
    assert column(spark, values, lambda v: predicates.placeholder(v, F.lit("xml")))[6]


def test_expressions(spark):
    frame = spark.createDataFrame([("db.password", "abcDEF", 3.5)], "name string, value string, entropy double")
    env = name_value_env(F.col("name"), F.col("value"))
    yes = ['name contains "pass"', 'lower(value) == "abcdef"', '"db" in words(name)', 'last(split(name, ".")) == "password"', "len(value) == 6 && not (name startsWith 'x')", 'value matches "(?i)^ABC"', "let x = upper(name); x endsWith 'WORD'",
           "1 + 2 * 3 == 7 and -1 < 0", "name in ['a', 'db.password']", 'name == "x" ? false : true', '!(value == "q") || false', "value not contains 'zz'", "name | lower() | trim() == 'db.password'", "2 ** 3 == 8", 'split(name, ".")[0] == "db"']
    assert list(frame.select(*[compile_bool(e, env).alias(str(i)) for i, e in enumerate(yes)]).first()) == [True] * len(yes)
    for bad in ["name", "nope == 1", "name == 1", "name &&", 'name contains 1', "unknown(name)", "1 <", "name matches value", "(name == 'a'", "'a' 'b'"]:
        with pytest.raises((ExpressionError, PatternError)):
            compile_bool(bad, env)
    assert set(finding_env(F.col)) == set("entropy name_value_similarity value_length line name value reason file path lang level name_path value_path".split())


def test_connection_and_keys(spark):
    values = ["Server=x;Password=1;User Id=2", "password only", "-----begin rsa private key-----", "eyJx", "Bearer eyJx", "aeyJ"]
    assert column(spark, values, predicates.classify) == ["connection_string_secret_indicator", "", "private_key_indicator", "jwt_indicator", "jwt_indicator", ""]
    assert re.compile("x")


def test_required_literals():
    cases = {r"\bghp_[0-9]{36}\b": "ghp_", "(?i)\\b[a-z0-9]+\\.fly\\.dev\\b": ".fly.dev", r"abc|def": "", "ab?cde*f": "cd", r"x[[:alnum:]]yz_w": "yz_w", "(?:AK|AS)IA": "", r"AGE-SECRET-KEY-1[A]{58}": "age-secret-key-1", "abcd{0,2}": "abc", "abcd+ef": "abcd", r"\x60abc": "abc", "[]a]bcd": "bcd"}
    for pattern, want in cases.items():
        assert required_literal(pattern) == (want if len(want) >= 3 else ""), pattern
    rest = [i for i, p, _ in VALUE_PATTERNS if not required_literal(p)]
    assert len(rest) <= 25 and sum(not required_literal(p) for _, p in HOSTS) <= 2, rest
