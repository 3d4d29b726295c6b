"""Secret scans: fixed patterns, and a lexer of assignments that scores literals by the names they reach."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import ready, replace_columns

KINDS = ("assign", "access", "hex", "lexed")
#: ASCII flags keep letters such as U+017F and U+212A from matching s and k.
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 or more

_OP = r"(?::=|=>|\+=|===?|!=|:(?!:)|=)"
_AHEAD = r"(?=[ \t]*+\]?[ \t]*+" + _OP + ")"
#: The lexer stops at strings, elements, comments and names before an operator; the rest it skips within one match.
_RULES = r"""
    (?:[^\w$"'`\#/<]++|(?!\b[rbufRBUF]{1,2}["'])(?![A-Za-z_$][\w$.-]*+AHEAD)[\w$.-]++["'`]?)*+
    (?:LONG|COMMENT<(?P<tag>[A-Za-z_][\w.:-]*+)(?:[ \t][^<>\n]*+)?>(?P<inside>[^<>\n]*+)</(?P=tag)[ \t]*+>|(?P<string>STRING)|(?P<name>[A-Za-z_$][\w$.-]*+)AHEAD|.|\Z)
"""
#: What is opened, and what closes it, anywhere after or (quotes) in the line.
_CLOSERS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
_QUOTES = ('"', "'", "`")


def _string(off: frozenset) -> str:
    quotes = "".join(q for q in _QUOTES if q not in off)
    opened = f"[{quotes}]" if quotes else "(?!)."
    return rf"(?:\b[rbufRBUF]{{1,2}})?(?P<q>{opened})(?P<text>(?:\\.|(?!(?P=q))[^\\\n])*+)(?P=q)"


def _long(off: frozenset) -> str:
    marks = "|".join(m for m in ('"""', "'''") if m not in off) or "(?!)."
    return rf"(?:\b[rbufRBUF]{{1,2}})?(?P<m>{marks})(?P<body>.*?)(?P=m)"


@cache
def _rules(comments: bool, off: frozenset) -> re.Pattern:
    """The lexer without what is known not to close any more."""
    comment = ""
    if comments:
        spans = ([] if "/*" in off else [r"/\*.*?\*/"]) + ([] if "<!--" in off else ["<!--.*?-->"])
        comment = "(?P<comment>" + "|".join([*spans, r"(?:(?<=\s)|(?<![\s\S]))(?:\#|//)[^\n]*+"]) + ")|"
    made = _RULES.replace("LONG", _long(off)).replace("COMMENT", comment).replace("STRING", _string(off)).replace("AHEAD", _AHEAD)
    return re.compile(made, re.ASCII | re.DOTALL | re.VERBOSE)


@cache
def _quoted(off: frozenset) -> re.Pattern:
    return re.compile(r"[ \t]*+(?:" + _long(off) + "|" + _string(off) + ")", re.ASCII | re.DOTALL)


_OPERATOR = re.compile(r"[ \t]*+\]?[ \t]*+(" + _OP + ")", re.ASCII)
_OPENED = re.compile(r"[ \t]*+(?:\b[rbufRBUF]{1,2})?([\"'`])", re.ASCII)
_IN_LINE = re.compile(r"(?:\\.|[^\\\n])*+", re.DOTALL)
_JOINED = re.compile(r"[ \t]*+(?:[+.&][ \t]*+(?:\r?\n[ \t]*+)?|\\\r?\n[ \t]*+)?(?=(?:\b[rbufRBUF]{1,2})?[\"'`])", re.ASCII)
_BARE = re.compile(r"[ \t]*+([A-Za-z0-9+/_.$=-]++)", re.ASCII)
_AFTER_TYPE = re.compile(r"[ \t]*+=(?![=>])")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.ASCII)
#: Weights of words in a target's name.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3,
    "credentials": 3, "private": 2, "auth": 2, "bearer": 2, "key": 1, "access": 1, "api": 1, "client": 1,
    "signing": 1, "encryption": 1, "salt": 1, "cert": 1, "session": 1,
}
#: Words that say the literal isn't the secret itself.
HARMLESS = {"public": 3, "file": 2, "path": 2, "name": 2, "url": 2, "length": 3, "count": 3, "type": 3, "field": 2, "header": 2, "id": 1}
PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|changeme|example|placeholder|your[-_a-z]*|none|null|true|false|todo|<.*>|\$\{.*\})\Z")
THRESHOLD = 4.0
_LEAST = 8


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORD.findall(name)]
    return sum(SENSITIVE.get(w, 0) - HARMLESS.get(w, 0) for w in words)


def literal_score(value: str) -> float:
    """-3 for a placeholder, up to 3 for long literals of many different characters and classes."""
    if len(value) < _LEAST or PLACEHOLDER.match(value) or " " in value:
        return -3.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.5, entropy / 2.5) + min(1.0, n / 24) + (classes >= 2) * 0.5


class _Open:
    """What can still close from a place of a scope on, so that each unclosed opener isn't followed to the end again.

    A comment or long string closes only up to the last closer of the scope. A quote that didn't close in its line leaves none
    that could before the line's end: any quote of its kind there was escaped, and what follows it reads as before.
    """

    def __init__(self, text: str, start: int, until: int):
        self.text, self.until = text, until
        self.last = {k: text.rfind(c, start, until) - (len(k) if k in ('"""', "'''") else 0) for k, c in _CLOSERS.items()}
        self.dead = dict.fromkeys(_QUOTES, -1)

    def off(self, at: int) -> frozenset:
        return frozenset([k for k, last in self.last.items() if at > last] + [q for q, end in self.dead.items() if at < end])

    def unclosed(self, at: int) -> None:
        """The quote at ``at`` doesn't close."""
        self.dead[self.text[at]] = _IN_LINE.match(self.text, at + 1, self.until).end()

    def quoted(self, at: int) -> re.Match | None:
        m = _quoted(self.off(at)).match(self.text, at, self.until)
        if not m and (q := _OPENED.match(self.text, at, self.until)) and q.start(1) >= self.dead[q[1]]:
            if at < self.dead[q[1]]:  # left out for a line that ended before it
                self.dead[q[1]] = -1
                return self.quoted(at)
            self.unclosed(q.start(1))
        return m


def _value(text: str, at: int, still: _Open) -> tuple[int, int, str, bool, int] | None:
    """Start, end, value, whether quoted, and where the lexer goes on, of the literal or name at ``at``; strings that are
    joined make one value."""
    m = still.quoted(at)
    if m:
        k = "body" if m["m"] else "text"
        start, end, value = m.start(k), m.end(k), [m[k]]
        while (j := _JOINED.match(text, m.end(), still.until)) and (m := still.quoted(j.end())):
            k = "body" if m["m"] else "text"
            end = m.end(k)
            value.append(m[k])
            at = m.end()
        return start, end, "".join(value), True, max(at, end + 1)
    m = _BARE.match(text, at)
    return (m.start(1), m.end(1), m[1], False, m.start(1)) if m else None


def lex(text: str) -> list[list[tuple[str, int, int, str, bool]]]:
    """Name, start, end, value and whether quoted, of each assignment in source or configuration syntax; a list for the
    text and one more for each comment and string that holds assignments of its own.

    Names are identifiers with dots and dashes, quoted keys and elements' tags, whole whatever their length. A called
    function or an indexed name is no value, nor is a string that runs over the end of the comment or string it begins in. Comments and strings are lexed alone: what they assign doesn't reach the names around them.
    """
    scopes, todo = [], [(0, len(text), True)]
    while todo:
        at, until, comments = todo.pop()
        pairs: list[tuple[str, int, int, str, bool]] = []
        still = _Open(text, at, until)

        def inner(a: int, b: int) -> None:
            if b - a > _LEAST and ("=" in text[a:b] or ":" in text[a:b]) and b - a < until - start:
                todo.append((a, b, False))

        start = at
        while at < until and (m := _rules(comments, still.off(at)).match(text, at, until)):
            before, at = at, max(m.end(), at + 1)
            if m["tag"]:
                pairs.append((m["tag"], m.start("inside"), m.end("inside"), m["inside"], True))
            elif comments and m["comment"]:
                inner(m.start("comment") + 2, m.end("comment"))
            elif m["m"]:
                inner(*m.span("body"))
            elif m["name"] or m["string"]:
                name = m["name"] or m["text"]
                op = _OPERATOR.match(text, at, until)
                if not op or op[1] in ("==", "===", "!="):
                    if m["string"]:
                        inner(*m.span("text"))
                    continue
                found = _value(text, op.end(), still)
                if found and op[1] == ":" and not found[3] and (typed := _AFTER_TYPE.match(text, found[1], until)):
                    found = _value(text, typed.end(), still)  # name: type = value
                if not found or found[1] > until:
                    at = op.end()
                    continue
                a, b, value, quoted, at = found
                if quoted:
                    inner(a, b)
                if a < b and (quoted or text[b : b + 1] not in ("(", "[")):
                    pairs.append((name, a, b, value, quoted))
            elif m.end() and (q := text[m.end() - 1]) in _QUOTES and m.end() > m.start():
                place = m.end() - 1
                if before >= still.dead[q]:
                    still.unclosed(place)
                elif place >= still.dead[q]:  # beyond the line for which it was left out
                    still.dead[q], at = -1, place
        scopes.append(pairs)
    return scopes


def _sensitive(pairs: list[tuple[str, int, int, str, bool]]) -> list[tuple[int, int]]:
    scores = {name: name_score(name) for name, *_ in pairs}
    given: dict[str, list[str]] = {}  # the names whose value a name gets
    for name, _, _, value, quoted in pairs:
        if not quoted and value in scores and value != name:
            given.setdefault(name, []).append(value)
    todo = sorted(given, key=scores.get)
    while todo:  # a constant is as sensitive as any name it reaches; each step raises a score
        name = todo.pop()
        for source in given.get(name, ()):
            if scores[source] < scores[name]:
                scores[source] = scores[name]
                todo.append(source)
    return [(a, b) for name, a, b, value, quoted in pairs if scores[name] >= 2 and (quoted or value not in scores) and scores[name] + literal_score(value) >= THRESHOLD]


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that a sensitive name gets, directly or through names assigned to names."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    return sorted({span for pairs in lex(text) if pairs for span in _sensitive(pairs)})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def render(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered)


def scan_secrets(df: DataFrame) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256, spans and n_lexed to every row, from the whole text.

    Spans are code points, end exclusive; ``lexed`` ones are literals whose target's name and look reach THRESHOLD.
    Base spans always stay. A null text counts as empty and has no spans; repeated rows get equal results; an empty
    table stays empty; columns named as an output are replaced.
    """
    ready(df.sparkSession)

    def start():
        def work(texts: pa.Array) -> list:
            rows = []
            for t in texts.to_pylist():
                t = t or ""
                base = base_spans(t)
                more = [(a, b, "lexed") for a, b in lexed_spans(t)]
                kinds = Counter(k for _, _, k in base)
                rows.append([kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(render(base).encode()).hexdigest(), render(base + more), len(more)])
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(6)]

        return work

    names = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long"
    return replace_columns(df, ["text"], names, start)
