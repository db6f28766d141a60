"""Readers of very many small files: what they make of a file, and how many calls they need for it."""

import sys

import pytest

from siftline.plans.config import DEFAULT, compile_config
from siftline.sources import extract, formats

JSON = '{\n  "service": {\n    "password": "0a1b",\n    "hosts": ["a", "0a1b", {"b": ["c"]}]\n  },\n  "name": "auth", "value": "x\\u0041", "n": -1.5e3, "t": true, "none": null, "a.b": {}, "l": []\n}'


def calls(f):
    """Calls of Python's and of built-in functions."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def by_rules(path, content):
    return [(r[0], r[7], r[6], r[10], r[11]) for r in extract.rows_of(path, content, compile_config(DEFAULT)) if r[4] == "value"]


def leaves(path, content):
    out = extract.Leaves()
    out.file(path, content)
    return list(zip(*out.columns))


def test_json():
    tree, lines = formats.json_tree(JSON)
    assert tree == {"service": {"password": "0a1b", "hosts": ["a", "0a1b", {"b": ["c"]}]}, "name": "auth", "value": "xA", "n": 0, "t": True, "none": None, "a.b": {}, "l": []}
    service = {"$.service": 2, "$.service.password": 3, "$.service.hosts": 4, "$.service.hosts[0]": 4, "$.service.hosts[1]": 4, "$.service.hosts[2]": 4, "$.service.hosts[2].b": 4, "$.service.hosts[2].b[0]": 4}
    assert lines == {"$": 1} | service | {f"$.{k}": 6 for k in ("name", "value", "n", "t", "none", "a.b", "l")}
    assert calls(lambda: formats.json_tree(JSON)) < 250


@pytest.mark.parametrize("bad", ['{"a":1,}', "[1,]", "[,]", "{,}", '{"a" "b"}', '{"a":"b"]', '["a"}', '["a" "b"]', '"a\nb"', '"\\x"', "01", "tru", '{"a":1}{', "[" * 502 + "]" * 502])
def test_no_json(bad):
    with pytest.raises(formats.Unreadable):
        formats.strict_json(bad)


def test_deep_json():
    for text in ("[" * 501 + "]" * 501, '{"a":' * 500 + '"b"' + "}" * 500):
        assert max(map(len, formats.strict_json(text)[1])) > 1000
    with pytest.raises(formats.Unreadable):
        formats.strict_json('{"a":' * 501 + '"b"' + "}" * 501)


FILES = {
    "a.json": JSON.encode(), "b.json": b'// c\n{"token": "12345678",}', "c.json": b'x "token": "12345678"', "d.json": b'{"k": "x\\ud800y"}', "e.json": b"\xef\xbb\xbf[[\"a\"], \"b\"]",
    "a.xml": b'<a key="k" value="v"><br>t</a>', "a.env": b"export A=1\nB='x' # c", "a.properties": b"a.b=c\\\n d", "a.ini": b"[s]\nk=v", "b.ini": b"[s]\nk=v\nplain", "a.py": b"password = 'abc' # c", "a.txt": b"A=1", "b.env": b"",
}


@pytest.mark.parametrize("path", FILES)
def test_leaves(path):
    assert sorted(leaves(path, FILES[path])) == sorted(by_rules(path, FILES[path]))


def test_a_file_that_breaks_a_reader_has_no_leaves(monkeypatch):
    def broken(text):
        yield "start", "/a", 1, ("a", [("k", "v")])
        raise RuntimeError

    out = extract.Leaves()
    monkeypatch.setattr(formats, "xml_events", broken)
    for path, content in (("a.env", b"A=1"), ("a.xml", b"<a k='v'>"), ("b.env", b"B=2"), ("c.env", None)):
        out.file(path, content)
    assert list(zip(*out.columns)) == [("a.env", 1, "$.A", "A", "1"), ("b.env", 1, "$.B", "B", "2")]


def test_leaves_of_a_table(spark):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "file string, content binary")
    wanted = extract.extract(files, compile_config(DEFAULT)).where("kind = 'value'").select("file", "line", "path", "name", "value")
    assert sorted(map(tuple, extract.leaves(files).collect())) == sorted(map(tuple, wanted.collect())) and extract.leaves(files).schema == wanted.schema


XML = "<?xml version=\"1.0\"?>\n<!-- c\n--><app>\n  <x:add key=\"token\" y:value='a>b'/>\n  <password  \n on>\n0a1b &lt;<![CDATA[<c>]]></password>\n  <br>\n  <a b=c d/>\n</app>"


def test_xml():
    app = "\n  \n  \n  \n  \n"
    assert list(formats.xml_events(XML)) == [
        ("start", "/app", 3, ("app", [])), ("start", "/app/add", 4, ("add", [("key", "token"), ("value", "a>b")])), ("end", "/app/add", 4, ("add", "")),
        ("start", "/app/password", 6, ("password", [("on", "on")])), ("end", "/app/password", 6, ("password", "\n0a1b <<c>")),
        ("start", "/app/br", 8, ("br", [])), ("end", "/app/br", 8, ("br", "")), ("start", "/app/a", 9, ("a", [("b", "c"), ("d", "")])), ("end", "/app/a", 9, ("a", "")),
        ("end", "/app", 3, ("app", app)),
    ]
    assert calls(lambda: list(formats.xml_events(XML))) < 230


ENV = "# made\r\nexport CLIENT_ID=app-1\nBASE_URL=https://svc.net/api\nCLIENT_SECRET=\"0a1b0a1b0a1b0a1b\"  \nMODE=fast # no\nA-B: \"x\\\"${MODE}\\n\" C='$MODE'\n\nD=\\$MODE$CLIENT_ID\n"


def test_dotenv():
    tree, lines = formats.dotenv_tree(ENV)
    assert tree == {"CLIENT_ID": "app-1", "BASE_URL": "https://svc.net/api", "CLIENT_SECRET": "0a1b0a1b0a1b0a1b", "MODE": "fast", "A-B": 'x"fast\n', "C": "$MODE", "D": "$MODEapp-1"}
    assert lines == {"$.CLIENT_ID": 2, "$.BASE_URL": 3, "$.CLIENT_SECRET": 4, "$.MODE": 5, "$.D": 8}
    assert calls(lambda: formats.dotenv_tree(ENV)) < 120


INI = "[db3]\n; note\npassword = 0a1b\nhost: h # c\n\n[DEFAULT]\n\"a=b\" = `x\ny` z\nk = 'q' ; c\n[api]\ntoken=\"0a1b\"\nl = a\\\n  b\n[ db3 ]\nuser = u\n"


def test_ini():
    tree, lines = formats.ini_tree(INI)
    assert tree == {"db3": {"password": "0a1b", "host": "h", "user": "u"}, "a=b": "x\ny", "k": "q", "api": {"token": "0a1b", "l": "ab"}}
    assert lines == {"$.db3": 14, "$.db3.password": 3, "$.db3.host": 4, "$.DEFAULT": 6, '$.DEFAULT."a': 7, "$.DEFAULT.k": 9, "$.api": 10, "$.api.token": 11, "$.api.l": 12, "$.db3.user": 15}
    assert calls(lambda: formats.ini_tree(INI)) < 250


def test_ini_lines():
    assert list(formats.ini_lines("[db]\na = \"x\"\n# c\nplain\n= y\nb: c=d")) == [(1, "db", "", None), (2, "db", "a", "x"), (6, "db", "b", "c=d")]
    assert calls(lambda: list(formats.ini_lines(INI))) < 100


PROPERTIES = "! note\ndb.password = ab\\\n   0a1b\nx:y\na\\ b\\=c d\\u0041\\t\n#c\n=z\nk\ne = \\\\\n"


def test_properties():
    tree, lines = formats.properties_tree(PROPERTIES)
    assert tree == {"db.password": "ab0a1b", "x": "y", "a b=c": "dA\t", "k": "", "e": "\\"}
    assert lines == {"$.db.password": 2, "$.x": 4, "$.a b=c": 5, "$.k": 8, "$.e": 9}
    assert calls(lambda: formats.properties_tree(PROPERTIES)) < 120
