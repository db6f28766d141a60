"""Source code to candidates, without a grammar: a tolerant lexer for ten languages, and shapes over its tokens.

The lexer tells apart names, plain strings, strings that are filled in (dynamic), comments, numbers and marks.
Shapes are then looked for around each string: what it is assigned to, which call it is an argument of, what it
is the default of. Broken code costs the shapes around the break, nothing else.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Languages by extension.
EXTENSIONS = {e: lang for lang, es in {
    "python": "py pyi", "javascript": "js jsx cjs mjs", "typescript": "ts tsx mts cts", "go": "go", "java": "java", "c_sharp": "cs", "ruby": "rb", "php": "php", "kotlin": "kt kts", "rust": "rs",
}.items() for e in es.split()}

#: Calls that look an environment up with a default, text that refers to it, quoted keys in it.
LOOKUP = re.compile(r"(?i)(getenv|environ|lookupenv|getproperty|getordefault|getvalue|getconfig|getsecret|env[_-]?(default|var|value)|fromenv)")
REFERENCE = re.compile(r"(?i)(getenv|environ|process\.env|getenvironmentvariable|lookupenv|config(uration)?\[|env\[)")
QUOTED = re.compile(r"""["`']([^"`']+)["`']""")

MARKS = r"=>|==|===|!=|!==|<=|>=|:=|\?\?|\?:|\|\||&&|->|::|\+=|-=|\*=|\.\.|[^\s\w]"
NAME = r"[^\W\d]\w*"
NUMBER = r"\d[\w.]*"
DOUBLE, SINGLE = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"


@dataclass(frozen=True)
class Language:
    """Patterns by kind of token, tried in order; `dynamic` finds what is filled in within a string."""

    comment: str
    strings: tuple[tuple[str, str], ...]
    name: str = NAME
    dynamic: str = ""
    assign: tuple[str, ...] = ("=",)
    declared: tuple[str, ...] = ()  # an assignment counts only after one of these words
    typed: bool = False  # name: type = value
    colon: tuple[str, ...] = ()  # kinds of keys before a colon
    arrow: tuple[str, ...] = ()  # kinds of keys before =>
    member: bool = False  # a.name = value counts
    groups: tuple[str, ...] = ("[",)  # what opens a collection
    builders: str = ""  # calls that make one
    raw: tuple[str, ...] = ()  # kinds of string that count only within collections
    calls: str = "chain"  # which callees count for arguments
    lookup: bool = True  # an environment call has its default as second argument
    defaults: tuple[str, ...] = ()
    lines: bool = False  # a line end ends a statement
    keys: tuple[str, ...] = field(default=("name",))


PY_PREFIX = r"(?:[rRbBuU]|[bB][rR]|[rR][bB])?"
PY_FILL = r"(?:[fF][rR]?|[rR][fF])"
TRIPLE = r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)"
LANGUAGES = {
    "python": Language(r"\#[^\n]*", (("fill", rf"{PY_FILL}(?:{TRIPLE}|{DOUBLE}|{SINGLE})"), ("str", rf"{PY_PREFIX}(?:{TRIPLE}|{DOUBLE}|{SINGLE})")), dynamic=r"(?<!\{)\{(?!\{)", typed=True, colon=("str",), groups=("[", "(", "{"), defaults=("or",), lines=True),
    "javascript": Language(SLASHES, (("tmpl", r"`(?:[^`\\]|\\.)*`"), ("str", f"{DOUBLE}|{SINGLE}")), name=r"[^\W\d][\w$]*|\$[\w$]*", colon=("name", "str"), member=True, defaults=("||", "??")),
    "typescript": Language(SLASHES, (("tmpl", r"`(?:[^`\\]|\\.)*`"), ("str", f"{DOUBLE}|{SINGLE}")), name=r"[^\W\d][\w$]*|\$[\w$]*", typed=True, colon=("name", "str"), member=True, defaults=("||", "??")),
    "go": Language(SLASHES, (("raw", r"`[^`]*`"), ("str", DOUBLE), ("char", SINGLE)), assign=("=", ":="), colon=("name",), groups=("{",), raw=("raw",), lines=True),
    "java": Language(SLASHES, (("str", rf"\"\"\".*?\"\"\"|{DOUBLE}"), ("char", SINGLE)), groups=("{",), calls="method"),
    "c_sharp": Language(SLASHES, (("tmpl", r'\$@?"(?:[^"\\]|\\.|"")*"|@\$"(?:[^"]|"")*"'), ("verbatim", r'@"(?:[^"]|"")*"'), ("str", rf"\"\"\".*?\"\"\"|{DOUBLE}"), ("char", SINGLE)), groups=("{",), defaults=("??",)),
    "ruby": Language(r"\#[^\n]*|^=begin.*?^=end", (("fill", r'"(?:[^"\\]|\\.)*"'), ("str", SINGLE), ("sym", r":[A-Za-z_]\w*(?!:)")), name=r"@{0,2}[^\W\d]\w*[?!]?", dynamic=r"#\{", colon=("name",), arrow=("str", "fill", "sym"), calls="method", lookup=False, defaults=("||", "or"), lines=True),
    "php": Language(r"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?(?:\*/|\Z)", (("fill", r'"(?:[^"\\]|\\.)*"'), ("str", r"'(?:[^'\\]|\\.)*'")), name=r"\$?[^\W\d]\w*", dynamic=r"\$[A-Za-z_{]|\{\$", arrow=("str", "fill"), builders="array", calls="plain", lookup=False, defaults=("??", "||", "or", "?:")),
    "kotlin": Language(SLASHES, (("fill", rf"\"\"\".*?\"\"\"|{DOUBLE}"), ("char", SINGLE)), dynamic=r"(?<!\\)\$(?:[A-Za-z_]|\{)", declared=("val", "var"), typed=True, groups=(), builders="listOf|listOfNotNull|mutableListOf|arrayOf|arrayOfNulls|setOf|mutableSetOf|arrayListOf|hashSetOf|linkedSetOf|sequenceOf", calls="member", lookup=False, defaults=("?:",), lines=True),
    "rust": Language(SLASHES, (("raw", r'b?r(#*)".*?"\1'), ("str", r'b?"(?:[^"\\]|\\.)*"'), ("char", r"b?'(?:[^'\\\n]|\\.[^'\n]*)'|'[a-z_]\w*")), declared=("let", "const"), typed=True, builders="vec!", raw=("raw",), lookup=False),
}
OPEN, CLOSE = "([{", ")]}"
#: What may not follow, or stand before, a value that is a whole.
FOLLOWS = {"+", "-", "*", "/", "%", ".", "[", "(", "?", "&&", "||", "==", "===", "!=", "!==", "<", ">", "??", "?:", "|", "&", "^", "..", "=>", "=", "->"}
WORDS = {"or", "and", "if", "in", "not", "is", "for", "else", "as", "unless", "instanceof", "to"}


@dataclass
class Token:
    kind: str
    text: str
    at: int
    line: int
    mate: int = -1  # the bracket that it opens or closes with


def tokens(text: str, lang: str) -> tuple[list[Token], list[Token]]:
    """(tokens without comments, comments)."""
    spec = LANGUAGES[lang]
    kinds = [("comment", spec.comment), *spec.strings, ("name", spec.name), ("number", NUMBER), ("mark", MARKS)]
    lexer = lexers.get(lang)
    if not lexer:
        lexer = lexers[lang] = re.compile("|".join(f"(?P<{k}{i}>{p if k != 'raw' or lang != 'rust' else p.replace('(#*)', '(?P<h>#*)').replace(chr(92) + '1', '(?P=h)')})" for i, (k, p) in enumerate(kinds)), re.S | re.M)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    out, comments = [], []
    stack: list[int] = []
    for begin, end in [(0, len(text))] if lang != "php" else [(m.start(1), m.end(1)) for m in re.finditer(r"<\?(?:php|=)?(.*?)(?:\?>|\Z)", text, re.S)]:
        for m in lexer.finditer(text, begin, end):
            kind = next(k for k, v in m.groupdict().items() if v is not None and k != "h").rstrip("0123456789")
            token = Token(kind, m[0], m.start(), bisect_right(starts, m.start()))
            if kind == "comment":
                comments.append(token)
                continue
            if kind == "fill":
                token.kind = "tmpl" if spec.dynamic and re.search(spec.dynamic, m[0]) else "str" if lang in ("python", "ruby", "kotlin") else "fill"
            if kind == "mark" and m[0] in OPEN:
                stack.append(len(out))
            elif kind == "mark" and m[0] in CLOSE and stack:
                token.mate = stack.pop()
                out[token.mate].mate = len(out)
            out.append(token)
    return out, comments


lexers: dict[str, re.Pattern] = {}
PLAIN = ("str", "fill", "raw", "verbatim")


def clean(literal: str) -> str:
    """Without prefix and one layer of quotes; escapes stay."""
    s = literal.strip()
    m = re.match(r"[rRbBfFuU@$]*(?=[\"'`#])", s)
    s = s[m.end() :] if m else s
    hashes = len(s) - len(s.lstrip("#"))
    if hashes and s.endswith("#" * hashes):
        s = s[hashes:-hashes]
    for quote in ('"""', "'''", '"', "'", "`"):
        if len(s) >= 2 * len(quote) and s.startswith(quote) and s.endswith(quote):
            return s[len(quote) : -len(quote)]
    return s


def bare(name: str) -> str:
    return clean(name).lstrip(":") if name[:1] in "\"'`:" else name


class Shapes:
    """The pairs, calls and defaults of one file."""

    def __init__(self, text: str, lang: str):
        self.text, self.lang, self.spec = text, lang, LANGUAGES[lang]
        self.t, self.comments = tokens(text, lang)

    def mark(self, i: int, *values: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind in ("mark", "name") and self.t[i].text in values

    def plain(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind in PLAIN

    def ends(self, i: int) -> bool:
        """Whether a value whose last token is at i is whole."""
        if i + 1 >= len(self.t):
            return True
        after = self.t[i + 1]
        same = after.line == self.t[i].line + self.t[i].text.count("\n")
        if after.kind == "mark":
            return after.text not in FOLLOWS or (self.spec.lines and not same and after.text not in (".", "?.", "+", "||", "&&"))
        if after.kind in PLAIN or after.kind == "tmpl":
            return not same
        return not (same and after.text in WORDS)

    def target(self, i: int) -> str | None:
        """The name that the assignment mark at i gives a value to."""
        spec, j = self.spec, i - 1
        if j < 0:
            return None
        if spec.typed or self.lang == "go":
            j = self.before_type(j)
        if j < 0 or self.t[j].kind != "name":
            return None
        if self.mark(j - 1, ".", "?.", "->", "::"):
            return self.t[j].text if spec.member and not self.mark(j - 1, "->", "::") else None
        if spec.declared:
            k = j - 1
            while self.mark(k, "mut", "static"):
                k -= 1
            if not self.mark(k, *spec.declared):
                return None
        if self.lang == "php" and not self.t[j].text.startswith("$"):
            k = j - 1
            while k >= 0 and (self.t[k].kind == "name" or self.mark(k, ",")) and not self.mark(k, "const"):
                k -= 1
            if not self.mark(k, "const"):
                return None
        if self.in_parameters(j):
            return None
        return self.t[j].text

    def before_type(self, j: int) -> int:
        """From the token before an assignment back over `: type`, if there is one."""
        if self.lang == "go":
            return j - 1 if self.t[j].kind == "name" and self.t[j - 1].kind == "name" and self.mark(j - 2, "var", "const", "(") and not self.mark(j - 1, "var", "const") else j
        k, line = j, self.t[j].line
        while k > 0 and (self.t[k].kind in ("name", "number") or self.mark(k, "<", ">", "[", "]", ".", "?", "&", "|", "'", "::", ",") or self.t[k].kind == "char") and line - self.t[k].line < 2:
            k -= 1
            if self.mark(k, ":") and self.t[k - 1].kind == "name":
                return k - 1
            if self.mark(k, "=", ";", "(", "{"):
                break
        return j

    def in_parameters(self, j: int) -> bool:
        """Whether the name at j is a parameter of a function that is being declared."""
        depth = 0
        for k in range(j - 1, max(-1, j - 200), -1):
            if self.mark(k, ")", "]", "}"):
                depth += 1
            elif self.mark(k, "(", "[", "{"):
                if depth == 0:
                    if not self.mark(k, "("):
                        return False
                    word = self.t[k - 2].text if k >= 2 else ""
                    near = self.t[k - 1].text if k >= 1 else ""
                    after = self.t[self.t[k].mate + 1].text if 0 <= self.t[k].mate + 1 < len(self.t) and self.t[k].mate >= 0 else ""
                    return word in ("def", "function", "func", "fun", "fn") or near in ("function", "lambda") or (after == "=>" and self.lang in ("javascript", "typescript"))
                depth -= 1
            elif self.mark(k, ";"):
                return False
        return False

    def elements(self, i: int) -> list[int]:
        """The plain strings that are elements, one level deep, of the collection that opens at i."""
        end = self.t[i].mate if self.t[i].mate > i else -1
        out, k = [], i + 1
        while k < end:
            if self.plain(k) and self.mark(k - 1, ",", self.t[i].text) and self.mark(k + 1, ",", self.t[end].text):
                out.append(k)
            k = self.t[k].mate + 1 if self.t[k].mate > k else k + 1
        return out

    def value(self, i: int, keyed: bool = False) -> list[int]:
        """The strings that what begins at i gives to a name: one, or the elements of one collection."""
        spec = self.spec
        if self.plain(i):
            return [i] if self.ends(i) and self.t[i].kind not in spec.raw else []
        open_ = i
        if self.lang in ("java", "c_sharp") and self.mark(i, "new"):
            while open_ < len(self.t) and (self.t[open_].kind == "name" or self.mark(open_, "[", "]", "<", ">", ".")):
                open_ += 1
            if not self.mark(open_ - 1, "]"):
                return []
        elif self.lang == "go" and not self.mark(i, "{"):
            while open_ < len(self.t) and (self.t[open_].kind in ("name", "number") or self.mark(open_, "[", "]", ".", "*", "..")):
                open_ += 1
        elif spec.builders and i + 1 < len(self.t):
            name, k = self.t[i].text, i + 1
            if self.mark(k, "!"):
                name, k = name + "!", k + 1
            if re.fullmatch(spec.builders, name) and self.mark(k, "(", "["):
                return [x for x in self.elements(k)]
        if self.mark(open_, *spec.groups) and (self.lang != "go" or open_ > i):
            raw = self.lang in ("go", "rust") and not keyed
            return [x for x in self.elements(open_) if raw or self.t[x].kind not in spec.raw]
        return []

    def pairs(self) -> Iterator[tuple[str, int]]:
        """(name, index of a string) of assignments, keyword arguments and dictionary entries."""
        spec = self.spec
        for i, token in enumerate(self.t):
            if token.kind != "mark":
                continue
            if token.text in spec.assign:
                if (name := self.target(i)) is not None:
                    raw = self.lang == "rust" and self.mark(self.before_type(i - 1) - 1, "const")
                    for x in self.value(i + 1, keyed=raw or token.text == "=" and self.lang == "go"):
                        yield name, x
            elif token.text == ":" and spec.colon and i and self.t[i - 1].kind in spec.colon and self.mark(i - 2, "{", ",", "(", "["):
                if self.lang == "ruby" and self.t[i - 1].line != token.line:
                    continue
                for x in self.value(i + 1, keyed=True):
                    yield bare(self.t[i - 1].text), x
            elif token.text == "=>" and i and self.t[i - 1].kind in spec.arrow:
                for x in self.value(i + 1, keyed=True):
                    if self.lang != "php" or (self.t[x].kind == self.t[i - 1].kind and x == i + 1):
                        yield bare(self.t[i - 1].text), x

    def callee(self, i: int) -> tuple[int, str, str]:
        """Where the callee of the call that opens at i begins, its text, and its last name."""
        k = i - 1
        if k < 0 or self.t[k].kind != "name":
            return -1, "", ""
        last = self.t[k].text
        while k > 1 and self.mark(k - 1, ".", "?.", "::", "->"):
            if self.t[k - 2].mate >= 0 and self.t[k - 2].mate < k - 2:
                k = self.t[k - 2].mate
                k = k - 1 if k and self.t[k - 1].kind == "name" else k
            else:
                k -= 2
        return k, self.text[self.t[k].at : self.t[i].at].strip(), last

    def arguments(self, i: int) -> list[int]:
        """The plain strings that are whole arguments of the call that opens at i."""
        return [x for x in self.elements(i) if self.t[x].kind not in self.spec.raw]

    def lookups(self) -> Iterator[tuple[str, int]]:
        """(first argument, index of the second) of environment lookups with a default."""
        if not self.spec.lookup:
            return
        for i, token in enumerate(self.t):
            if token.text == "(" and token.kind == "mark":
                _, whole, last = self.callee(i)
                if whole and LOOKUP.search(last if self.spec.calls == "method" else whole):
                    found = self.arguments(i)
                    for a, b in zip(found, found[1:]):
                        if b == a + 2:
                            yield clean(self.t[a].text), b

    def call_arguments(self) -> Iterator[tuple[str, int]]:
        """(name, index of a string argument) of calls whose result a name is given."""
        calls = self.spec.calls
        for i, token in enumerate(self.t):
            if token.text != "(" or token.kind != "mark":
                continue
            begin, whole, last = self.callee(i)
            if begin < 1 or not whole or not self.mark(begin - 1, *self.spec.assign) or token.mate < 0:
                continue
            if calls == "plain" and whole != last or calls == "member" and whole == last:
                continue
            name = self.target(begin - 1)
            seen = last if calls == "method" else whole
            if name is None or self.spec.member and self.mark(begin - 3, ".") or LOOKUP.search(seen) or REFERENCE.search(seen):
                continue
            if self.spec.builders and re.fullmatch(self.spec.builders, last):
                continue
            for x in self.arguments(i):
                yield name, x

    def logical_defaults(self) -> Iterator[tuple[str, int]]:
        """(environment name, index of the string) where a lookup has a string to fall back to."""
        for i, token in enumerate(self.t):
            if token.text not in self.spec.defaults or not self.plain(i + 1) or token.kind not in ("mark", "name"):
                continue
            k = i
            while k > 0:
                before = self.t[k - 1]
                if before.mate >= 0 and before.mate < k - 1:
                    k = before.mate
                    continue
                if before.kind == "mark" and before.text not in (".", "?.", "::", "->", "?") or before.text in ("return", "or", "and", "echo", "print"):
                    break
                if self.spec.lines and before.line != self.t[k].line:
                    break
                k -= 1
            left = self.text[self.t[k].at : token.at].strip() if k < i else ""
            if REFERENCE.search(left):
                m = QUOTED.search(left)
                yield (m[1] if m else re.split(r"[.\[]", left)[-1].strip("[]\"'` ")), i + 1


def candidates(text: str, lang: str, rules: int) -> Iterator[tuple]:
    """(kind, rule, path, line, name_path, value_path, name, value), pass by pass."""
    s = Shapes(text, lang)
    named = list(s.pairs())
    for name, x in named:
        for r in range(rules):
            yield "named", r, "", s.t[x].line, "source_name", "source_value", name, clean(s.t[x].text)
    of: dict[int, str] = {}
    for name, x in named:
        of.setdefault(x, name)
    for x, token in enumerate(s.t):
        if token.kind in PLAIN:
            yield "value", -1, "", token.line, "value_pattern", "value_pattern", of.get(x, ""), clean(token.text)
    for kind, how, rows in (("env", "env_default", s.lookups()), ("arg", "call_arg", s.call_arguments()), ("default", "env_default", s.logical_defaults())):
        for name, x in rows:
            for r in range(rules):
                yield kind, r, "", s.t[x].line, f"{how}_name", f"{how}_value", name, clean(s.t[x].text)
    for c in s.comments:
        yield "comment", -1, "", c.line, "comment", "comment", "", c.text
