"""Readers of structured text: a tree of dicts, lists and scalars, and the line of each path in it.

A reader raises Unreadable where the format does not hold; the line readers then take over.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

Tree = object
Lines = dict[str, int]


class Unreadable(ValueError):
    """The text is not of its format."""


def join(base: str, key: str) -> str:
    return f"{base}.{key}" if base else key


# JSON

_BLANK, _STRING = r"[ \t\r\n]*", r'"([^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1f]*)*)"'
_SCALAR = f"{_BLANK}(?:{_STRING}" + r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)"
_END = _BLANK + r"([\]},])"
#: What a value is, a scalar or the start of a container; a member of an object and an item of an array, up to the mark after a scalar or the start of a container.
JSON_VALUE = re.compile(_SCALAR + r"|([\[{]))")
JSON_MEMBER = re.compile(f"{_BLANK}{_STRING}{_BLANK}:(?:{_SCALAR}){_END}|{_BLANK}(?=[" + r"\[{]))")
JSON_ITEM = re.compile(f"(?:{_SCALAR}){_END}|{_BLANK}(?=[" + r"\[{]))")
JSON_MARK = re.compile(_END)
DEEPEST = 500
JSON_WORDS = {"true": True, "false": False, "null": None}


def json_string(raw: str) -> str:
    return json.loads(f'"{raw}"') if "\\" in raw else raw


def json_scalar(string: str | None, other: str | None) -> Tree:
    """A string; of the others only whether they are null, true or false."""
    return JSON_WORDS.get(other, 0) if string is None else json_string(string)


def json_value(text: str, at: int, path: str, depth: int, lines: Lines, place: list[int]) -> tuple[Tree, int]:
    """The value that begins at a place, and where it ends; lines gets the line on which its first token ends. place: a place before, and its line."""
    m = JSON_VALUE.match(text, at)
    if not m:
        raise Unreadable("no JSON value")
    at = m.end()
    seen, line = place
    line += text.count("\n", seen, at)
    place[:] = at, line
    lines[path] = line
    if depth > DEEPEST:
        raise Unreadable("too deep")
    string, other, end = m.groups()
    if not end:
        return json_scalar(string, other), at
    is_object = end == "{"
    out: Tree = {} if is_object else []
    close, child_at = ("}", JSON_MEMBER.match) if is_object else ("]", JSON_ITEM.match)
    m = JSON_MARK.match(text, at)
    if m and m[1] == close:
        return out, m.end()
    end = ","
    while end == ",":
        m = child_at(text, at)
        if not m:
            raise Unreadable("no member or item")
        *key, string, other, end = m.groups()
        if is_object:
            key = json_string(key[0])
            child = f"{path}.{key}"
        else:
            child = f"{path}[{len(out)}]"
        if end:
            if depth >= DEEPEST:
                raise Unreadable("too deep")
            at = m.end(m.lastindex - 1 if string is None else m.lastindex - 2)
            seen, line = place
            line += text.count("\n", seen, at)
            place[:] = at, line
            lines[child] = line
            item, at = json_scalar(string, other), m.end()
        else:
            item, at = json_value(text, m.end(), child, depth + 1, lines, place)
            m = JSON_MARK.match(text, at)
            if not m:
                raise Unreadable("no comma")
            at, end = m.end(), m[1]
        if is_object:
            out[key] = item
        else:
            out.append(item)
    if end != close:
        raise Unreadable("no comma")
    return out, at


def strict_json(text: str) -> tuple[Tree, Lines]:
    """Strict JSON, with the line on which each value's first token ends."""
    lines: Lines = {}
    tree, at = json_value(text, 0, "$", 0, lines, [0, 1])
    if text[at:].strip(" \t\r\n"):
        raise Unreadable("more than one value")
    return tree, lines


RELAXED = re.compile(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/|,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[\]}])', re.S)


def json_tree(text: str) -> tuple[Tree, Lines]:
    """Strict JSON has lines; with comments, trailing commas or a module wrapper it has none."""
    try:
        return strict_json(text)
    except Unreadable:
        pass
    bare = re.sub(r"\A(?:module\.exports =)?(?:export default)?", "", text.strip()).strip().removesuffix(";")
    for relaxed in (RELAXED.sub(lambda m: m[1] or " ", text), bare):
        try:
            return strict_json(relaxed)[0], {}
        except Unreadable:
            continue
    raise Unreadable("no JSON")


# YAML

#: Plain scalars that are no strings: null, booleans, numbers, dates (fixed values of the core schema).
PLAIN = re.compile(
    r"(?:~|null|Null|NULL|true|True|TRUE|false|False|FALSE|[-+]?[0-9][0-9_]*|0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[-+]?(?:\.[0-9_]+|[0-9][0-9_]*(?:\.[0-9_]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)|\d{4}-\d{1,2}-\d{1,2}(?:[Tt ].*)?)?"
)


def yaml_tree(text: str) -> tuple[Tree, Lines]:
    try:
        import yaml
    except ImportError as e:
        raise Unreadable("no YAML library") from e
    lines: Lines = {}
    seen: set[int] = set()
    text_tag = "tag:yaml.org,2002:str"

    def is_string(node) -> bool:
        return isinstance(node, yaml.ScalarNode) and node.tag == text_tag and (node.style is not None or not PLAIN.fullmatch(node.value))

    def walk(node, path: str, known: bool, depth: int = 0) -> Tree:
        if depth > 200:
            raise Unreadable("too deep")
        # What an alias points to was met before, and has no line of its own.
        known = known and id(node) not in seen
        seen.add(id(node))
        if known and (path != "$" or isinstance(node, yaml.ScalarNode)):
            lines[path] = node.start_mark.line + 1
        if isinstance(node, yaml.ScalarNode):
            return node.value if is_string(node) else None
        if isinstance(node, yaml.SequenceNode):
            return [walk(x, f"{path}[{i}]", known, depth + 1) for i, x in enumerate(node.value)]
        out: dict = {}
        merged: dict = {}
        plain = True
        for k, v in node.value:
            key = getattr(k, "value", None)
            if isinstance(k, yaml.ScalarNode) and key == "<<" and k.style is None:
                for source in v.value if isinstance(v, yaml.SequenceNode) else [v]:
                    own = walk(source, path, False, depth + 1)
                    merged = {**(own if isinstance(own, dict) else {}), **merged}
                continue
            plain = plain and is_string(k)
            if not isinstance(key, str):
                continue
            if key in out:
                raise Unreadable("a key is there twice")
            out[key] = walk(v, join(path, key), known, depth + 1)
        # Keys that are no strings make a map that is not looked into.
        return {**merged, **out} if plain else None

    try:
        loader = yaml.BaseLoader(text)
        if not loader.check_node():
            return None, {}
        return walk(loader.get_node(), "$", True), lines
    except (yaml.YAMLError, RecursionError, ValueError) as e:
        raise Unreadable(str(e)) from e


# dotenv

#: A name and = at the start of a line: what follows on the line, whatever it is, is its value.
ENV_LINE = re.compile(r"^[^\S\n]*(?:export[^\S\n]+)?([A-Za-z_][A-Za-z0-9_.]*)[^\S\n]*=", re.A | re.M)
ENV_GAP = re.compile(r"(?:\s+|#[^\n]*)*")
ENV_KEY = re.compile(r"(?:export[ \t]+)?([A-Za-z0-9_.-]+)[ \t]*[=:][ \t]*", re.A)
ENV_COMMENT = re.compile(r"(?:^|\s)#")
ENV_VARIABLE = re.compile(r"(\\)?(\$)(\()?\{?([A-Z0-9_]+)?\}?")


def env_expanded(value: str, known: dict[str, str]) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return m[0][1:]
        return known.get(m[4], "") if m[4] and not m[3] else m[0]

    return ENV_VARIABLE.sub(one, value) if "$" in value else value


def dotenv_tree(text: str) -> tuple[Tree, Lines]:
    out: dict[str, str] = {}
    text = text.replace("\r\n", "\n")
    at = 0
    while True:
        at = ENV_GAP.match(text, at).end()
        if at >= len(text):
            break
        m = ENV_KEY.match(text, at)
        if not m:
            raise Unreadable("no variable name")
        key, at = m[1], m.end()
        if text.startswith(("'", '"'), at):
            quote = text[at]
            end = text.find(quote, at + 1)
            while end >= 0 and text[end - 1] == "\\":
                end = text.find(quote, end + 1)
            if end < 0:
                raise Unreadable("a quote is open")
            value = text[at + 1 : end]
            if quote == '"':
                if "\\" in value:
                    value = re.sub(r"\\([^$])", r"\1", value.replace("\\n", "\n").replace("\\r", "\r"))
                value = env_expanded(value, out)
            at = end + 1
        else:
            end = text.find("\n", at)
            line = text[at : end if end >= 0 else len(text)]
            at += len(line)
            cut = ENV_COMMENT.search(line) if "#" in line else None
            value = env_expanded((line[: cut.start()] if cut else line).strip(), out)
        out[key] = value
    lines = {}
    seen, n = 0, 1
    for m in ENV_LINE.finditer(text):
        n += text.count("\n", seen, m.end())
        seen = m.end()
        lines[f"$.{m[1]}"] = n
    return out, lines


# Java properties

ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
PROPERTY = re.compile(r"([^\\ \t\f=:]*(?:\\.[^\\ \t\f=:]*)*)[ \t\f]*(?:[=:][ \t\f]*)?(.*)", re.S)
PROPERTY_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|(.))", re.S)


def unescaped(s: str, strict: bool) -> str:
    if "\\" not in s:
        return s

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2] == "u" and strict:
            raise Unreadable("a unicode escape is malformed")
        return ESCAPES.get(m[2], m[2])

    return PROPERTY_ESCAPE.sub(one, s)


def logical_lines(text: str) -> Iterator[tuple[int, str]]:
    """Lines without comments, joined where a backslash continues them."""
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        own, start = lines[i].rstrip("\r").lstrip(" \t\f"), i + 1
        i += 1
        if not own or own[0] in "#!":
            continue
        while own.endswith("\\") and (len(own) - len(own.rstrip("\\"))) % 2:
            own = own[:-1]
            if i >= len(lines):
                break
            own += lines[i].rstrip("\r").lstrip(" \t\f")
            i += 1
        yield start, own


def properties_pairs(text: str, strict: bool) -> Iterator[tuple[int, str, str]]:
    for line, own in logical_lines(text):
        key, value = PROPERTY.match(own).groups()
        if key:
            yield line, unescaped(key, strict), unescaped(value, strict)


def properties_tree(text: str) -> tuple[Tree, Lines]:
    tree: dict = {}
    lines: Lines = {}
    for line, key, value in properties_pairs(text, True):
        tree[key] = value
        lines[f"$.{key}"] = line
    return tree, lines


# INI


def unquoted(s: str) -> str:
    s = s.strip()
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'" else s


#: A key up to the first = or :, and what follows; a key that is quoted or not, without the white space around the mark.
INI_PAIR = re.compile(r"([^=:]+)[=:](.*)", re.S)
INI_KEY = re.compile(r"""("[^"]*"|`[^`]*`|[^=:]+?)\s*[=:]\s*(.*)""", re.S)
INI_COMMENT = re.compile("[#;]")


def ini_lines(text: str) -> Iterator[tuple[int, str, str, str | None]]:
    """(line, section, key, value) of pairs, split at the first = or :; a section itself has value None."""
    section = ""
    for i, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if not line or line[0] in ";#":
            continue
        if line[0] == "[" and line[-1] == "]":
            section = line[1:-1].strip()
            yield i, section, "", None
            continue
        m = INI_PAIR.match(line)
        if m and (key := m[1].strip()):
            yield i, section, key, unquoted(m[2])


def ini_tree(text: str) -> tuple[Tree, Lines]:
    out: dict = {}
    target, lines = out, text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i].strip()
        i += 1
        if not line or line[0] in ";#":
            continue
        if line[0] == "[":
            if "]" not in line:
                raise Unreadable("a section is open")
            name = line[1 : line.rindex("]")].strip()
            if not name:
                raise Unreadable("a section has no name")
            target = out if name == "DEFAULT" else out.setdefault(name, {})
            continue
        # Only a quoted key may hold a mark; else the key ends at the first one.
        if line[0] in "\"`":
            m = INI_KEY.match(line)
            key, value = m.groups() if m else ("", "")
        else:
            m = INI_PAIR.match(line)
            key, value = (m[1].rstrip(), m[2].lstrip()) if m else ("", "")
        if not m:
            raise Unreadable("a key has no value")
        mark = '"""' if value.startswith('"""') else "`" if value.startswith("`") else ""
        if mark:
            while mark not in value[len(mark) :]:
                if i >= len(lines):
                    raise Unreadable("a value is open")
                value += "\n" + lines[i]
                i += 1
            value = value[len(mark) : value.index(mark, len(mark))]
        else:
            while value.endswith("\\") and i < len(lines):
                value = value[:-1] + lines[i].strip()
                i += 1
            if value[:1] in ("'", '"') and value[:1] in value[1:]:
                value = value[1 : value.index(value[0], 1)]
            else:
                value = unquoted(INI_COMMENT.split(value, maxsplit=1)[0] if "#" in value or ";" in value else value)
        if isinstance(target, dict):
            target[key.strip("\"`").strip()] = value
    index: Lines = {}
    for n, section, key, value in ini_lines(text):
        index[f"$.{section}" if value is None else f"$.{section}.{key}" if section else f"$.{key}"] = n
    return out, index


# XML

#: Closing, name, and all to the > outside quotes, a / before it included.
TAG = re.compile(r"<(/?)([^\s/>\"'=<]+)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
XML_ENCODING = re.compile(r"xml\s.*?encoding\s*=\s*[\"']([^\"']*)", re.S)
#: Elements of HTML that need no end.
VOID = set("basefont br area link img param hr input col frame isindex base meta".split())


def local(name: str) -> str:
    return name.split(":", 1)[1] if ":" in name[1:-1] else name


def xml_events(text: str) -> Iterator[tuple[str, str, int, object]]:
    """("start", path, line, (name, attributes)) and ("end", path, line of the start, (name, text)), until what cannot be read."""
    stack: list[tuple] = []
    at, line = 0, 1

    def end() -> tuple[str, str, int, object]:
        name, n, parts, _, path = stack.pop()
        return "end", path, n, (name, "".join(parts))

    while at < len(text):
        cut = text.find("<", at)
        if cut != at:
            chunk = text[at : cut if cut >= 0 else len(text)]
            if stack and stack[-1][3]:
                yield end()
            if stack:
                stack[-1][2].append(html.unescape(chunk))
            line += chunk.count("\n")
            at += len(chunk)
            continue
        if text.startswith(("<!", "<?"), at):
            begin, finish = next(x for x in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"), ("<!", ">")) if text.startswith(x[0], at))
            stop = text.find(finish, at + len(begin))
            if stop < 0:
                return
            body = text[at + len(begin) : stop]
            if begin == "<![CDATA[" and stack:
                stack[-1][2].append(body)
            m = XML_ENCODING.match(body) if begin == "<?" else None
            if m and m[1].lower() not in ("utf-8", ""):
                return
            line += text.count("\n", at, stop)
            at = stop + len(finish)
            continue
        m = TAG.match(text, at)
        if not m:
            return
        line += text.count("\n", at, m.end())
        at = m.end()
        close, name, rest = m.groups()
        name = local(name) if ":" in name else name
        if close:
            while stack and stack[-1][0] != name:
                yield end()
            if not stack:
                return
            yield end()
            continue
        if stack and stack[-1][3]:
            yield end()
        empty = rest.endswith("/")
        rest = rest[:-1] if empty else rest
        # Where no attribute has a value, a name is its own.
        alone = "=" not in rest
        attributes = [(local(a) if ":" in a else a, html.unescape(b or c or d or (a if alone else ""))) for a, b, c, d in ATTRIBUTE.findall(rest)] if rest else []
        path = f"{stack[-1][4]}/{name}" if stack else f"/{name}"
        stack.append((name, line, [], name.lower() in VOID and not empty, path))
        yield "start", path, line, (name, attributes)
        if empty:
            yield end()
