"""Secret scans: patterns of known forms, and literals assigned to sensitive names."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fanplume.llm.common import map_columns

#: Fixed by the contract: kind, pattern, the group that counts, its least length. They are listed in order of output.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # runs are maximal either way
]
KINDS = [k for k, *_ in BASE] + ["literal"]

Span = tuple[int, int, str]


#: Every match of the first pattern holds one of these, in either case.
_ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _holds(text: str, parts: tuple[str, ...]) -> bool:
    """Whether one of the lower-case `parts` may stand in `text`; A-Z in either case."""
    low = text.lower()  # letters beyond ASCII may become ASCII ones, which only means a search for nothing
    return any(p in low for p in parts)


def base_spans(text: str) -> list[Span]:
    found = []
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not _holds(text, _ASSIGNED):
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    return found


#: Name parts that make a target sensitive, and how much. Parts are what is between _ - . and changes of case.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0, "encryptionkey": 1.0, "signingkey": 1.0, "bearer": 0.8, "auth": 0.6, "key": 0.5, "salt": 0.5, "pin": 0.4,
}
#: A text without any of these has no sensitive name. Of names in two parts, those that begin with "pass" count too.
_HINT = ("passw", "pwd", "passphrase", "secret", "token", "credential", "bearer", "auth", "key", "salt", "pin", *(f"pass{sign}{rest}" for sign in "_-." for rest in ("word", "wd", "phrase")))
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|change_?me|example.*|your[_-].*|none|null|true|false|todo|dummy|test|placeholder|string|number|boolean|integer|required|optional)$", re.I)


def name_score(name: str) -> float:
    """How sensitive a target name is, from 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in parts + pairs), default=0.0)


class Value:
    """What a name is assigned: spans of literals, and the values of constants that are part of it.

    Of the whole value it keeps what its score needs, so that constants of constants cost no more than others: how
    often each character stands in it, and the text itself while it is short.
    """

    SHORT, LONG = 200, 1e6

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []
        self.constants: list[Value] = []
        self.counts: Counter[str] = Counter()
        self.size = 0.0
        self.text: str | None = ""

    def add(self, part: str | Value, start: int = 0, end: int = 0) -> None:
        if isinstance(part, str):
            self.spans.append((start, end))
            counts, size, text = Counter(part), len(part), part
        else:
            self.constants.append(part)
            counts, size, text = part.counts, part.size, part.text
        self.counts.update(counts)
        self.size += size
        self.text = self.text + text if self.text is not None and text is not None and len(self.text) + len(text) <= self.SHORT else None
        if self.size > self.LONG:  # only shares count: doubling a value over and over must not make numbers without bound
            self.counts = Counter({c: n / 2 for c, n in self.counts.items()})
            self.size /= 2

    def score(self) -> float:
        """How much it looks like a secret, from 0 to 1: length and entropy, nothing for placeholders."""
        if self.size < 6 or (self.text is not None and (self.text.isspace() or _PLACEHOLDER.match(self.text))):
            return 0.0
        bits = -sum(n / self.size * math.log2(n / self.size) for n in self.counts.values() if n)
        mixed = 1.0 if any(c.isdigit() or not c.isalnum() for c in self.counts) else 0.8
        return min(1.0, bits / 3.0) * mixed * (0.7 if " " in self.counts else 1.0) * min(1.0, self.size / 8)


# All patterns below take each character a bounded number of times: names begin only where nothing of a name stands
# before, and quantifiers don't give back.
_NAME = r"[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+"
_PLAIN = rf"(?<![\w$.\-])(?:--?+)?+(?P<plain>{_NAME})"
#: A target: NAME, --NAME, "NAME" or the end of a subscript; then an assignment sign. Or `set NAME`. Or `<NAME ...>`.
_TARGET = re.compile(
    rf"""(?P<command>(?<![\w$.\-])[sS][eE][tT](?=[ \t]++[A-Za-z_$]))|<(?P<tag>{_NAME})(?:[ \t][^<>\n]*+)?+>"""
    rf"""|(?:(?<![\w\\])["'](?P<quoted>{_NAME})["']\]?|{_PLAIN})(?P<gap>[ \t]*+)(?P<sign>:=|=>|==?=?|:(?!:|//))""",
    re.A,
)
_COMMAND = re.compile(rf"[ \t]++(?P<plain>{_NAME})[ \t]++(?![=:])", re.A)
_TYPE = re.compile(r"[ \t]*+[A-Za-z_][\w.<>\[\]|, ?]{0,80}[ \t]=(?![=>])(?=[ \t]*+[\"'`(rbufRBUF])", re.A)
_STRING = re.compile(
    r"""(?:[rbufRBUF]{1,2}(?=["']))?(?:\"{3}(?P<a>(?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}(?P<b>(?:[^'\\]|\\.|'(?!''))*+)'{3}|"(?P<c>(?:[^"\\\n]|\\.)*+)"|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>(?:[^`\\]|\\.)*+)`)""", re.S
)
_WORD = re.compile(r"[^\s\"'`#;,(){}\[\]<>][^\s\"'`;,(){}\[\]<>]*+")
_WHOLE_NAME = re.compile(_NAME, re.A)
_SAME_LINE, _ANY_LINE = re.compile(r"[ \t]*+(?:\\\n[ \t]*+)?+"), re.compile(r"\s*+")
_JOIN = re.compile(r"(?:\+|\.\.)(?!=)")
#: A constant within a template or a shell's word, and a shell's default.
_HOLE = re.compile(rf"\$\{{[ \t]*+(?P<shell>{_NAME})[ \t]*+\}}|\$(?P<bare>[A-Za-z_]\w*+)|(?<!\{{)\{{[ \t]*+(?P<format>{_NAME})[ \t]*+(?:[!:=][^{{}}\n]*+)?+\}}", re.A)
_REFERENCE = re.compile(rf"\$(?:\{{(?P<braced>{_NAME})\}}|(?P<bare>[A-Za-z_]\w*+))", re.A)
_SHELL_DEFAULT = re.compile(rf"\$\{{{_NAME}:?+[\-=](?P<text>[^{{}}\s\"'$`]++)\}}", re.A)
#: A look-up whose literal is what it gives where nothing is found: NAME("X", "..."), NAME("X") or "...", NAME || "...".
_LITERAL = r"""(?:"[^"\\\n]*+"|'[^'\\\n]*+')"""
_LOOKUP = re.compile(
    rf"""(?P<name>{_NAME})(?:\(\s*+{_LITERAL}\s*+(?P<comma>,)\s*+(?=["'])|(?:\(\s*+{_LITERAL}\s*+\)|\[\s*+{_LITERAL}\s*+\])?+[ \t]*+(?:\|\||\?\?|or\b)[ \t]*+(?=["'`]))""", re.A
)
#: Last parts of the names of functions whose second argument is such a literal.
LOOKUPS = {"get", "getenv", "env", "get_env", "getProperty", "getOrDefault", "config", "pop", "setdefault"}
_BLOCK = re.compile(r"[|>][+\-]?\d?[+\-]?[ \t]*+(?:#[^\n]*+)?\n")


def _block_lines(text: str, target: int, at: int) -> tuple[list[tuple[int, int]], int]:
    """The lines (without indent) of a block scalar that begins at `at`, and its end: they are indented deeper than the line of its target."""
    begin = text.rfind("\n", 0, target) + 1
    depth = len(text[begin:target]) - len(text[begin:target].lstrip(" "))
    lines = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        own = line.strip()
        if own:
            indent = len(line) - len(line.lstrip(" "))
            if indent <= depth:
                break
            first = at + line.index(own)
            lines.append((first, first + len(own)))
        at = end + 1
    return lines, min(at, len(text))


def _add_string(text: str, s: re.Match, value: Value, known: dict[str, Value]) -> None:
    """Add the parts of a string: in templates (f"...", and $ in "..." and `...`) known constants stand for their literals."""
    k = s.lastgroup
    begin, end = s.span(k)
    form = "f" in text[s.start() : begin].lower()
    if known and (form or k in "ace"):
        for h in _HOLE.finditer(text, begin, end):
            part = known.get(h[h.lastgroup])
            if part is not None and (form or h.lastgroup != "format"):
                if h.start() > begin:
                    value.add(text[begin : h.start()], begin, h.start())
                value.add(part)
                begin = h.end()
    if begin < end or not (value.spans or value.constants):
        value.add(text[begin:end], begin, end)


def _read(text: str, at: int, value: Value, known: dict[str, Value], sure: bool) -> int:
    """Add to `value` the sum of strings and constants or the bare word at `at`; returns where it ends."""
    pos, depth, some = at, 0, False
    while True:
        pos = (_ANY_LINE if depth else _SAME_LINE).match(text, pos).end()
        if not some and text[pos : pos + 1] == "(":
            depth, pos = depth + 1, pos + 1
            continue
        s = _STRING.match(text, pos)
        if s:
            _add_string(text, s, value, known)
            pos = s.end()
        elif not some and (u := _LOOKUP.match(text, pos)) and (not u["comma"] or u["name"].rpartition(".")[2] in LOOKUPS):
            pos = u.end()
            continue
        elif (r := _REFERENCE.match(text, pos)) and r[r.lastgroup] in known:
            value.add(known[r[r.lastgroup]])
            pos = r.end()
        elif r := _SHELL_DEFAULT.match(text, pos):
            value.add(r["text"], *r.span("text"))
            pos = r.end()
        else:
            w = None if _TARGET.match(text, pos) else _WORD.match(text, pos)
            if not w:  # or a name that is assigned to in turn
                return at
            *terms, last = w[0].split("+")
            if w[0] in known:
                value.add(known[w[0]])
                pos = w.end()
            elif terms and all(t in known for t in terms) and (last in known or not last):  # a sum without spaces
                for t in filter(None, (*terms, last)):
                    value.add(known[t])
                pos = w.end() - (not last)
            elif some or depth or text[w.end() : w.end() + 1] in ("(", "[", "`"):
                return at
            elif _WHOLE_NAME.fullmatch(w[0]) and ("." in w[0] or not sure) and not any(map(str.isdigit, w[0])):
                return at  # a variable
            else:
                value.add(w[0], w.start(), w.end())
                return w.end()
        at, some = pos, True
        after = (_ANY_LINE if depth else _SAME_LINE).match(text, pos).end()
        if j := _JOIN.match(text, after):
            pos = _ANY_LINE.match(text, j.end()).end()
        elif s and text[after : after + 1] in ('"', "'"):
            pos = after
        else:
            return at


def _items(text: str, at: int, known: dict[str, Value]) -> tuple[list[Value], int]:
    """The strings, constants and their sums that stand at `at`, with commas between; and where they end."""
    found: list[Value] = []
    while True:
        pos = _ANY_LINE.match(text, at).end()
        w = _WORD.match(text, pos)
        if not (_STRING.match(text, pos) or (w and (w[0] in known or w[0].partition("+")[0] in known))):
            return found, at
        value = Value()
        end = _read(text, pos, value, known, False)
        if end <= pos:
            return found, at
        found.append(value)
        at = end
        after = _ANY_LINE.match(text, at).end()
        if text[after : after + 1] != ",":
            return found, at
        at = after + 1


def _names_before(text: str, since: int, at: int) -> list[str]:
    """Names with a comma after each that stand right before `at` on its line: a, b, c = ..."""
    *parts, blank = text[max(since, text.rfind("\n", since, at) + 1) : at].split(",")
    names: list[str] = []
    while parts and not blank.strip() and _WHOLE_NAME.fullmatch(own := parts.pop().strip(" \t([")):
        names.insert(0, own.removeprefix("const ").removeprefix("let "))
    return names


def assignments(text: str) -> list[tuple[str, Value]]:
    """Names and values in order; constants stand for their literals.

    Python, shell, JavaScript, JSON, YAML, TOML and ini share `name = value`, `name: type = value`, `"name": value`,
    `name := value` and `name => value`; besides there are YAML's block scalars, `set name value` and `<name>value</name>`.
    A value is a sum of strings and earlier names, over several lines within brackets or after a sign, or a bare word.
    Known constants within templates count as their literals. Items of a list are values of their own, and `a, b = "x", "y"`
    gives each name its own. A look-up's default is a literal: `get("X", "...")`, `NAME or "..."`, `${NAME:-...}`. Other calls, subscripts and comparisons are no literals, and neither is a bare name after ` = `, which is a variable.
    """
    known: dict[str, Value] = {}
    out = []
    at = 0
    while m := _TARGET.search(text, at):
        since, at = at, m.end()
        value = Value()
        sure = True  # a bare word is a literal
        if m["tag"]:
            name, end = m["tag"], text.find("<", at)
            if end > at and text.startswith("</" + name, end):
                own = text[at:end].strip()
                first = at + text[at:end].index(own)
                value.add(own, first, first + len(own))
                at = end
            if value.spans and value.size:
                out.append((name, value))
            continue
        if m["command"]:
            c = _COMMAND.match(text, at)
            if not c:
                continue
            name, pos, sure = c["plain"], c.end(), False
        else:
            if m["sign"].startswith("==") or (m["sign"] == "=" and m.start("sign") and text[m.start("sign") - 1] in "!<>"):
                continue
            name, pos = m["quoted"] or m["plain"], m.end()
            if m["sign"] == ":":
                typed = _TYPE.match(text, pos)
                pos = typed.end() if typed else pos
            else:
                sure = not m["gap"] and text[pos : pos + 1] not in (" ", "\t")
            block = _BLOCK.match(text, _SAME_LINE.match(text, pos).end()) if m["sign"] == ":" else None
            if block:
                lines, at = _block_lines(text, m.start(), block.end())
                for a, b in lines:
                    value.add(text[a:b], a, b)
        if not value.spans and m["sign"]:
            first = _SAME_LINE.match(text, pos).end()
            names = [*_names_before(text, since, m.start()), name] if m["sign"] == "=" and m["plain"] else [name]
            if text[first : first + 1] == "[" or len(names) > 1:
                values, end = _items(text, first + (text[first : first + 1] in ("[", "(")), known)
                if len(values) != len(names) > 1:
                    values = []
                if values:
                    for k, own in enumerate(values):
                        out.append((names[k] if len(names) > 1 else name, own))
                    if len(names) == 1:
                        for own in values:
                            value.add(own)
                        known[name] = value
                    else:
                        known.update(zip(names, values, strict=True))
                    at = max(at, end)
                    continue
        if not value.spans:
            at = max(at, _read(text, pos, value, known, sure))
        if value.spans or value.constants:
            known[name] = value
            out.append((name, value))
    return out


def literal_spans(text: str, least: float = 0.5) -> list[Span]:
    """Literals that reach `least` = sensitivity of the target's name * look of the whole value."""
    if not _holds(text, _HINT):
        return []
    found = set()
    marked: set[int] = set()
    for name, value in assignments(text):
        score = name_score(name)
        if score and score * value.score() >= least:
            todo = [value]
            while todo:  # constants are marked once, however many names they reach
                v = todo.pop()
                if id(v) not in marked:
                    marked.add(id(v))
                    found |= {(s, e, "literal") for s, e in v.spans if e > s}
                    todo += v.constants
    return sorted(found)


def spans_of(text: str | None, least: float = 0.5) -> list[Span]:
    """All spans (start, end, kind) of one text, by start and then kind as listed; none for null."""
    found = base_spans(text or "") + literal_spans(text or "", least)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def find_secrets(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Add `secrets`, an array of (start, end, kind), to `docs`; a column of that name is replaced, others pass through.

    Positions are code points, ends exclusive. Whole texts are scanned, where they lie, in time that grows with their
    length; null and empty ones give an empty array. Rows are judged one by one, so repeated rows give the same.
    """

    def fn(texts: list) -> list:
        return [[[{"start": s, "end": e, "kind": k} for s, e, k in spans_of(t, least)] for t in texts]]

    return map_columns(docs, [text_col], [T.StructField("secrets", SPANS)], fn)
