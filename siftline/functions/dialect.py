"""RE2 patterns as Java patterns of the same meaning.

Configurations are written for RE2, whose classes and boundaries are ASCII, whose `$` is the end of the text
and whose case folding is Unicode; Spark matches with Java. DuckDB uses RE2, so its SQL takes the originals.
"""

from __future__ import annotations

import re

WORD = "[0-9A-Za-z_]"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
NO_EDGE = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
SPACE = r"\t\n\f\r "
FLAGS = re.compile(r"\(\?(?P<on>[imsU]*)(?:-(?P<off>[imsU]+))?(?P<end>[:)])")
NAMED = re.compile(r"\(\?P?<(?P<name>\w+)>")
CLASS = re.compile(r"\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]", re.S)
POSIX = re.compile(r"\[:(?P<no>\^?)(?P<name>[a-z]+):\]")
#: POSIX classes in Java.
CLASSES = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit"}


class PatternError(ValueError):
    """A pattern that RE2 would refuse."""


def to_java(pattern: str) -> str:
    """The Java pattern; raises PatternError for what is no RE2 pattern."""
    out, i, in_class, first, multiline, depth = ["(?d)"], 0, False, False, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise PatternError(f"trailing backslash: {pattern!r}")
            e = pattern[i + 1]
            i += 2
            if e in "sS":
                out.append((SPACE if e == "s" else r"\S") if in_class else f"[{'^' if e == 'S' else ''}{SPACE}]")
            elif e in "bB" and not in_class:
                out.append(EDGE if e == "b" else NO_EDGE)
            elif e.isdigit() and e != "0":
                raise PatternError(f"back reference: {pattern!r}")
            else:
                out.append("\\" + e)
            first = False
            continue
        if in_class:
            if m := POSIX.match(pattern, i):
                if m["name"] not in CLASSES:
                    raise PatternError(f"unknown class: {pattern!r}")
                out.append(rf"\{'P' if m['no'] else 'p'}{{{CLASSES[m['name']]}}}")
                i, first = m.end(), False
                continue
            if c == "]" and not first:
                in_class = False
            elif c in "[&":
                c = "\\" + c
            elif c == "]":
                c = r"\]"
            first = first and c == "^"
            out.append(c)
        elif c == "[":
            in_class, first = True, True
            out.append(c)
        elif c == "(":
            depth += 1
            if m := NAMED.match(pattern, i):
                out.append(f"(?<g{m['name'].replace('_', 'U')}>")
                i = m.end()
                continue
            if m := FLAGS.match(pattern, i):
                if "U" in m["on"]:
                    raise PatternError(f"flag U: {pattern!r}")
                multiline = ("m" in m["on"] or multiline) and "m" not in (m["off"] or "")
                out.append("(?" + m["on"].replace("i", "iu") + ("-" + m["off"].replace("i", "iu") if m["off"] else "") + m["end"])
                depth -= m["end"] == ")"
                i = m.end()
                continue
            if pattern.startswith("(?", i):
                raise PatternError(f"look-around: {pattern!r}")
            out.append(c)
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError(f"unexpected ): {pattern!r}")
            out.append(c)
        elif c == "$" and not multiline:
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    if in_class or depth:
        raise PatternError(f"missing ] or ): {pattern!r}")
    if re.search(r"(?:^|\(|\|)[*+?](?!\?)", re.sub(r"\\.|\[(?:\\.|[^\]])*\]|\(\?[^)>:]*[:)>]", "x", pattern)):
        raise PatternError(f"nothing to repeat: {pattern!r}")
    return "".join(out)


def pieces_of(pattern: str) -> list[str]:
    """Characters, escapes, classes and marks of a pattern, one by one."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            n = 4 if pattern[i + 1 : i + 2] == "x" else 2
        elif pattern[i] == "[":
            n = CLASS.match(pattern, i).end() - i
        elif pattern[i] == "{":
            n = pattern.index("}", i) + 1 - i
        elif m := re.compile(r"\((?:\?(?:P?<\w+>|[imsU-]*[:)]))?").match(pattern, i):
            n = m.end() - i
        else:
            n = 1
        out.append(pattern[i : i + n])
        i += n
    return out


def is_optional(piece: str) -> bool:
    return piece in ("*", "?") or re.match(r"\{0?,|\{0\}", piece) is not None


def opened(pieces: list[str]) -> list[str]:
    """Without the brackets of groups that occur once and have one branch; other groups, and repeats, are a break."""
    out, i = [], 0
    while i < len(pieces):
        x = pieces[i]
        if x.startswith("(") and not x.endswith(")"):
            depth, end, branches = 1, i + 1, False
            while depth:
                y = pieces[end]
                depth += (y.startswith("(") and not y.endswith(")")) - (y == ")")
                branches |= depth == 1 and y == "|"
                end += 1
            after = pieces[end] if end < len(pieces) else ""
            once = not branches and not is_optional(after) and after != "+" and not after.startswith("{")
            out += opened(pieces[i + 1 : end - 1]) if once else [""]
            i = end
        else:
            out.append(x)
            i += 1
    return out


def required_literal(pattern: str) -> str:
    """The longest text, in lower case, that every match contains, or an empty string if none of three characters is sure."""
    pieces = opened(pieces_of(pattern))
    if "|" in pieces:
        return ""
    runs = [""]
    for x, after in zip(pieces, [*pieces[1:], ""]):
        literal = x[1] if len(x) == 2 and x[0] == "\\" and not x[1].isalnum() else x if len(x) == 1 and x not in ".^$*+?|)" else ""
        if x.startswith("(?"):
            continue
        if literal and not is_optional(after):
            runs[-1] += literal
        if not literal or is_optional(after) or after == "+" or after.startswith("{"):
            runs.append("")
    best = max(runs, key=len)
    return best.lower() if len(best) >= 3 else ""


def sure_literals(pattern: str) -> set[str]:
    """Texts in lower case, of two characters or more, of which every match contains one; an empty set if none are sure."""
    return _sure(pieces_of(pattern))


def _sure(pieces: list[str]) -> set[str]:
    opens = lambda x: x.startswith("(") and not x.endswith(")")
    branches, depth = [[]], 0
    for x in pieces:
        depth += opens(x) - (x == ")")
        if x == "|" and not depth:
            branches.append([])
        else:
            branches[-1].append(x)
    if len(branches) > 1:
        each = [_sure(b) for b in branches]
        return set().union(*each) if all(each) else set()
    runs, found, i, pieces = [""], [], 0, list(pieces)
    while i < len(pieces):
        x, after = pieces[i], pieces[i + 1] if i + 1 < len(pieces) else ""
        if opens(x):
            depth, end = 1, i + 1
            while depth:
                depth += opens(pieces[end]) - (pieces[end] == ")")
                end += 1
            inner, after = pieces[i + 1 : end - 1], pieces[end] if end < len(pieces) else ""
            if after in ("*", "+", "?") or after.startswith("{") or "|" in inner:
                runs.append("")
                if not is_optional(after):
                    found.append(_sure(inner))
                i = end
            else:
                pieces[i:end] = inner
            continue
        i += 1
        literal = x[1] if len(x) == 2 and x[0] == "\\" and not x[1].isalnum() else x if len(x) == 1 and x not in ".^$*+?|)" else ""
        if x.startswith("(?"):
            continue
        if literal and not is_optional(after):
            runs[-1] += literal.lower()
        if not literal or is_optional(after) or after == "+" or after.startswith("{"):
            runs.append("")
    found += [{r} for r in runs if len(r) >= 2]
    return max((f for f in found if f), key=lambda f: (min(map(len, f)) >= 3, -len(f), min(map(len, f))), default=set())


def any_literal(literals: set[str]) -> str:
    """A Java pattern that finds any of the literals: branches by their first characters, as Java tries branches one by one."""
    kept = sorted(x for x in literals if not any(y != x and y in x for y in literals))

    def branch(words: list[str]) -> str:
        if len(words) == 1:
            return re.escape(words[0])
        by: dict[str, list[str]] = {}
        for w in words:
            by.setdefault(w[0], []).append(w[1:])
        out = [re.escape(c) + branch(rest) for c, rest in by.items()]
        return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"

    return branch(kept)
