"""Name-literal pairs of source code and configuration texts, read by a lexer in linear work.

One pass over the marks of a text (quotes, comment signs, braces, line ends, assignment signs) keeps the state: code, a
string or a comment; the open scopes; the names bound in them.  Strings may have prefixes, three quotes or back quotes;
comments are ``#``, ``//`` and ``/* */``.  Scopes are braces and the bodies of ``def`` and ``class``.

A value is a literal, a name, a call, or several of them joined by ``+`` or written side by side, or alternatives
(``or``, ``||``, ``??``).  A name stands for its last value before in its scope or an outer one; if there is none, for its first
one after in the same scope or outside all scopes.  A joined value keeps its parts, so its literals are found
through any number of steps.  Other pairs are XML elements, ``user:literal@host`` in URLs, ``--name literal``, ``#define name literal``, and
``name: x`` followed by ``value: y``.  Pairs inside strings and comments are given, too, but bind no names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_MARK = re.compile(r"""["'`{}\n#]|//|/\*|===|!==|==|!=|<=|>=|->|::|:=|=>|[=:]""")
_IGNORED = frozenset(("<=", ">=", "->", "::", "!=", "!=="))
_COMPARED = frozenset(("==", "==="))
_NAME_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-"
_BLANKS = re.compile(r"[ \t]*")
_SPACE = re.compile(r"\s*")
_PREFIX = re.compile(r"[rRbBuUfF]{1,2}(?=[\"'])")
_QUOTED = re.compile(r""""([^"\n\\]*(?:\\.[^"\n\\]*)*)"|'([^'\n\\]*(?:\\.[^'\n\\]*)*)'""")
_BACK = re.compile(r"`([^`\\]*(?:\\.[^`\\]*)*)`", re.DOTALL)
_ESCAPED = re.compile(r"""\\(["'])([^"'\\\n]*)\\\1""")
_BARE = re.compile(r"""[^\s"',;(){}\[\]<>#]+""")
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+")
_DOLLAR = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*+)\}|\$([A-Za-z_][A-Za-z0-9_]*+)(?![^\s\"',;(){}\[\]<>#])")
_OR = re.compile(r"[ \t]*(?:\|\||\?\?|or\b)[ \t]*")
_PLUS = re.compile(r"[ \t]*\+(?![+=])\s*")
_JOINED = re.compile(r"""[A-Za-z_][A-Za-z0-9_.]*+(?=\+["']|[ \t]+\+[ \t]*["'A-Za-z_]|[ \t]*\()""")
_LINE = re.compile(r"[ \t]*(?:((?:async[ \t]+)?(?:def|class)[ \t])|(?=\S))")
_DEFINE = re.compile(r"#[ \t]*define[ \t]+([A-Za-z_][A-Za-z0-9_]*+)[ \t]+")
#: Between ``:`` and ``=`` of an annotated name.
_TYPE = re.compile(r"[ \t]*(?:Optional\[|Final\[)?(?:str|string|String|bytes|any|Any|&(?:'static )?str)\]?(?:[ \t]*\|[ \t]*None)?[ \t]*\Z")
_URL = re.compile(r"://[^\s/:@]*:([^\s/@]+)@")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>([^<>]*+)</\1\s*>")
_FLAG = re.compile(r"(?<![\w-])--([A-Za-z][A-Za-z0-9_-]*+)[ \t]+(?=[^\s-])")
_LABELS, _VALUES = frozenset(("name", "key")), frozenset(("value",))
_LABEL = re.compile(r"[A-Za-z_][A-Za-z0-9_.:-]*+\Z")
_FLAT = ("string", "comment")


@dataclass(slots=True)
class Pair:
    """A name and the node of its value; ``quoted`` is false for a bare value."""

    name: str
    node: int
    quoted: bool


@dataclass(slots=True)
class Lexed:
    """Pairs in order, and the nodes that values are made of.

    ``spans[i]`` is the literal of node i, or None for a joined value, whose parts ``parts[i]`` have smaller numbers.  ``later[i]`` says
    for which node a bare name stands that is bound further on.
    """

    pairs: list[Pair] = field(default_factory=list)
    spans: list[tuple[int, int] | None] = field(default_factory=list)
    parts: dict[int, tuple[int, ...]] = field(default_factory=dict)
    later: dict[int, int] = field(default_factory=dict)


def name_before(before: str) -> str:
    """The name that ends ``before``, the text between two signs; empty if there is none."""
    before = before.rstrip(" \t")
    end = len(before)
    while end and len(before) - end < 3 and before[end - 1] in "\"'`])\\":
        end -= 1
    before = before[:end]
    return before[len(before.rstrip(_NAME_CHARS)):].lstrip("0123456789.-")


class _Scopes:
    """Names bound in the open scopes; entering, leaving, binding and asking take constant work a name."""

    def __init__(self) -> None:
        self.open: list[tuple[int, int | None, list[str]]] = [(0, None, [])]  # number, indent of the header or None, names
        self.bound: dict[str, list[tuple[int, int]]] = {}
        self.first: dict[tuple[int, str], int] = {}
        self.made = self.braces = 0

    @property
    def number(self) -> int:
        return self.open[-1][0]

    def enter(self, indent: int | None) -> None:
        self.made += 1
        self.braces += indent is None
        self.open.append((self.made, indent, []))

    def leave(self) -> None:
        _, indent, names = self.open.pop()
        self.braces -= indent is None
        for name in names:
            self.bound[name].pop()

    def brace_end(self) -> None:
        if self.braces:
            while self.open[-1][1] is not None:
                self.leave()
            self.leave()

    def line(self, indent: int, header: bool) -> None:
        while len(self.open) > 1 and self.open[-1][1] is not None and self.open[-1][1] >= indent:
            self.leave()
        if header:
            self.enter(indent)

    def bind(self, name: str, node: int) -> None:
        number, _, names = self.open[-1]
        held = self.bound.setdefault(name, [])
        if held and held[-1][0] == number:
            held[-1] = (number, node)
        else:
            held.append((number, node))
            names.append(name)
        self.first.setdefault((number, name), node)

    def find(self, name: str) -> int | None:
        held = self.bound.get(name)
        return held[-1][1] if held else None


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.out, self.scopes = text, Lexed(), _Scopes()
        self.waiting: list[tuple[int, int, str]] = []  # node, scope, name
        self.names: set[int] = set()  # nodes that are bare names
        self.run_end = self.behind = 0  # end of the last bare run; end of the string or comment
        self.dead: dict[str, tuple[int, int]] = {}  # opening sign: from here to there none closes it
        self.label: str | None = None

    def string(self, at: int) -> tuple[int, int, int] | None:
        """(start, end, position behind) of the string whose quote is at ``at``."""
        text, quote = self.text, self.text[at]
        three = quote * 3
        if quote != "`" and text.startswith(three, at) and not self.is_dead(three, at):
            end = text.find(three, at + 3)
            if end >= 0:
                return at + 3, end, end + 3
            self.dead[three] = at, len(text)
        if self.is_dead(quote, at):
            return None
        m = (_BACK if quote == "`" else _QUOTED).match(text, at)
        if m:
            return *m.span(m.lastindex), m.end()
        line = text.find("\n", at)
        self.dead[quote] = at, len(text) if quote == "`" or line < 0 else line
        return None

    def is_dead(self, sign: str, at: int) -> bool:
        start, end = self.dead.get(sign, (0, 0))
        return start <= at < end

    def node(self, start: int, end: int) -> int:
        self.out.spans.append((start, end))
        return len(self.out.spans) - 1

    def operand(self, at: int, flat: bool) -> tuple[list[int], int, bool, bool] | None:
        """(nodes, position behind, quoted, whether more may follow) of one operand."""
        text = self.text
        m = _PREFIX.match(text, at)
        at = m.end() if m else at
        c = text[at:at + 1]
        if c in ("\"", "'", "`") and c:
            found = None if flat and c == "`" else self.string(at)
            if found and not (flat and found[1] > self.behind):
                start, end, behind = found
                return ([self.node(start, end)] if start < end else []), behind, True, True
            return None
        if c == "\\" and (m := _ESCAPED.match(text, at)):
            return ([self.node(*m.span(2))] if m[2] else []), m.end(), True, False
        if c == "$" and (m := _DOLLAR.match(text, at)):
            known = self.scopes.find(m[1] or m[2])
            if known is not None:
                return [known], m.end(), True, True
            if m[1] or m[2].isupper():
                return [], m.end(), True, True
        if m := _JOINED.match(text, at):
            name, behind = m[0], m.end()
            around = _BLANKS.match(text, behind).end()
            if text[around:around + 1] == "(":
                return self.arguments(around + 1)
            known = self.scopes.find(name)
            return ([] if known is None else [known]), behind, True, True
        if at < self.run_end:
            return [self.node(at, self.run_end)], self.run_end, False, False
        if m := _BARE.match(text, at):
            self.run_end = m.end()
            m2 = _IDENT.match(text, at)
            if m2 and m2.end() == m.end():
                known = self.scopes.find(m[0])
                if known is not None:
                    return [known], m.end(), True, True
                made = self.node(at, m.end())
                self.waiting.append((made, self.scopes.number, m[0]))
                self.names.add(made)
                return [made], m.end(), False, True
            return [self.node(at, m.end())], m.end(), False, False
        return None

    def arguments(self, at: int) -> tuple[list[int], int, bool, bool]:
        """String arguments of a call up to the first thing that is no string or name; names of settings aren't literals."""
        text, nodes = self.text, []
        while True:
            at = _SPACE.match(text, at).end()
            m = _PREFIX.match(text, at)
            at = m.end() if m else at
            c = text[at:at + 1]
            found = self.string(at) if c in ("\"", "'") and c else None
            if found:
                start, end, at = found
                m = _IDENT.match(text, start, end)
                if start < end and not (m and m.end() == end and m[0].isupper()):
                    nodes.append(self.node(start, end))
            elif m := _IDENT.match(text, at):
                at = m.end()
            at = _SPACE.match(text, at).end()
            if text[at:at + 1] != ",":
                break
            at += 1
        return nodes, at + (text[at:at + 1] == ")"), True, False

    def values(self, at: int, flat: bool) -> Iterator[tuple[int, bool]]:
        """(node, quoted) of each alternative of the value at ``at``."""
        text = self.text
        at = _BLANKS.match(text, at).end()
        gap = _BLANKS
        if text[at:at + 1] == "(" and not flat:
            gap, at = _SPACE, _SPACE.match(text, at + 1).end()
        nodes, quoted, open_ = [], True, True
        while open_:
            one = self.operand(at, flat)
            if one is None:
                break
            got, at, q, open_ = one
            nodes, quoted = nodes + got, quoted and q
            if flat or not open_:
                break
            if m := _OR.match(text, at):
                yield from self.value(nodes, quoted)
                nodes, quoted, at = [], True, m.end()
            elif m := _PLUS.match(text, at):
                at = m.end()
            else:
                at = gap.match(text, at).end()
                open_ = q and text[at - 1] != "\n" and (text[at:at + 1] in ("\"", "'") and at < len(text) or bool(_PREFIX.match(text, at)))
                open_ = open_ or (gap is _SPACE and q and text[at:at + 1] in ("\"", "'") and at < len(text))
        yield from self.value(nodes, quoted)

    def value(self, nodes: list[int], quoted: bool) -> Iterator[tuple[int, bool]]:
        if len(nodes) > 1:
            nodes = [n for n in dict.fromkeys(nodes) if n not in self.names]
        if len(nodes) == 1:
            yield nodes[0], quoted
        elif nodes:
            self.out.spans.append(None)
            made = len(self.out.spans) - 1
            self.out.parts[made] = tuple(nodes)
            yield made, True

    def assign(self, names: list[str], at: int, flat: bool, binds: bool) -> None:
        node = None
        for node, quoted in self.values(at, flat):
            for name in names:
                self.out.pairs.append(Pair(name, node, quoted))
                if binds:
                    self.scopes.bind(name, node)
        if node is not None:
            self.labelled(names[0], node)

    def labelled(self, name: str, node: int) -> None:
        """``name: x`` and the next pair ``value: y`` make the pair x, y."""
        word, span = name.rpartition(".")[2].lower(), self.out.spans[node]
        if word in _VALUES and self.label:
            self.out.pairs.append(Pair(self.label, node, True))
        label = _LABEL.match(self.text, *span) if word in _LABELS and span else None
        self.label = label[0] if label else None

    def read(self) -> Lexed:
        text, scopes = self.text, self.scopes
        last = 0  # end of the last sign
        context, annotated = "code", ""
        self.new_line(0)
        for m in _MARK.finditer(text):
            mark, at = m[0], m.start()
            if context in _FLAT and at >= self.behind:
                context = "code"
            if mark in ("\"", "'", "`"):
                word = text[at - 1:at] if at else ""
                if context == "code" and (not (word.isalnum() or word == "\\") or self.prefixed(at)) and (found := self.string(at)):
                    context, self.behind = "string", found[2]
            elif mark == "#" or mark == "//" or mark == "/*":
                if context != "code":
                    continue
                if mark == "#" and (d := _DEFINE.match(text, at)):
                    self.assign([d[1]], d.end(), False, True)
                    last = max(last, d.end())
                elif mark == "/*":
                    end = -1 if self.is_dead(mark, at) else text.find("*/", at + 2)
                    if end >= 0:
                        context, self.behind = "comment", end + 2
                    else:
                        self.dead[mark] = at, len(text)
                elif at == 0 or text[at - 1].isspace() or (mark == "//" and text[at - 1] != ":"):
                    end = text.find("\n", at)
                    context, self.behind = "comment", len(text) if end < 0 else end
            elif mark == "\n":
                annotated = ""
                if context == "code":
                    self.new_line(m.end())
            elif mark == "{" or mark == "}":
                if context == "code":
                    scopes.enter(None) if mark == "{" else scopes.brace_end()
            elif mark not in _IGNORED:
                name = name_before(text[last:at])
                names = [annotated] if annotated and mark == "=" and _TYPE.match(text, last, at) else [name] if name else []
                annotated = name if mark == ":" else ""
                last = m.end()
                if names:
                    self.assign(names, last, context != "code", context == "code" and mark not in _COMPARED)
        self.run_end = 0
        for pattern in (_URL, _ELEMENT, _FLAG):
            self.forms(pattern)
        for node, scope, name in self.waiting:
            stands = scopes.first.get((scope, name), scopes.first.get((0, name)))
            if stands is not None and stands != node:
                self.out.later[node] = stands
        return self.out

    def prefixed(self, at: int) -> bool:
        """Whether the letters before a quote are the prefix of a string."""
        start = at
        while start and at - start < 3 and self.text[start - 1].isalnum():
            start -= 1
        return at - start < 3 and bool(_PREFIX.match(self.text, start)) and _PREFIX.match(self.text, start).end() == at

    def new_line(self, at: int) -> None:
        m = _LINE.match(self.text, at)
        if m:
            width = m.start(1) - at if m[1] else m.end() - at
            self.scopes.line(width, bool(m[1]))

    def forms(self, pattern: re.Pattern) -> None:
        for m in pattern.finditer(self.text):
            if pattern is _FLAG:
                one = self.operand(m.end(), False)
                for node in one[0] if one else ():
                    self.out.pairs.append(Pair(m[1], node, one[2]))
            else:
                name, (start, end) = ("password", m.span(1)) if pattern is _URL else (m[1], m.span(2))
                while start < end and self.text[start].isspace():
                    start += 1
                while start < end and self.text[end - 1].isspace():
                    end -= 1
                if start < end:
                    self.out.pairs.append(Pair(name, self.node(start, end), True))


def lexed(text: str) -> Lexed:
    return _Reader(text).read()
