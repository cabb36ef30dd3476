"""Secret scans: fixed token patterns, and name-literal pairs read from source and configuration syntax.

One forward lexer reads names, strings, marks and bare values, and never goes
back over a text. What it pairs: ``name = value`` with ``= : := =>`` and type
annotations, quoted keys, subscripts (``env["KEY"] = ...``), calls and tuples
whose first string names the second (``set("key", "...")``), options
(``--key ...``), XML elements and key/value attributes, lists, and YAML blocks.
Adjacent or added strings are one literal.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "literal")
MIN_SCORE = 0.6

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words of a target's name, and how much each says that its value is a secret.
_SENSITIVE = {"password": 0.6, "passwd": 0.6, "pwd": 0.5, "passphrase": 0.6, "secret": 0.6, "token": 0.5, "apikey": 0.6, "credential": 0.5, "privatekey": 0.6, "accesskey": 0.6, "secretkey": 0.6, "signingkey": 0.6, "encryptionkey": 0.6, "auth": 0.3}
#: Words that also count as the end of a longer word, as in "dbpassword".
_ENDINGS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "secretkey", "accesskey", "privatekey")
_HINT = re.compile(r"(?i)pass|pwd|secret|token|key|credential|auth")
_PLACEHOLDER = re.compile(r"(?i)^(?:changeme|example|none|null|true|false|todo|your[_-].*|x+|\*+|\.+|<.*>|\$\{.*\}|%\(.*\))$")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_STRING = r"""(?P<long>\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})|(?P<string>"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\n]*`)"""
#: An open quote takes the rest of its line, so that nothing is read twice.
_TOKEN = re.compile(_STRING + r"""|(?P<open>["'`][^\n]*)|(?P<name>-{0,2}[A-Za-z_$@][\w$]*(?:[.\-'][\w$]+)*)|(?P<line>\n)|(?P<space>[^\S\n]+)|(?P<op>=>|:=|[=!<>:]=|->|[=:,()\[\]{}<>+;])|(?P<other>[^\s"'`,;(){}\[\]<>=:+A-Za-z_$@\n]+|[^\n])""")
_PART = re.compile(r"[rRbBfFuU]{0,2}(?:" + _STRING + ")")
#: Between strings that make one literal.
_JOIN = re.compile(r"[ \t]*(?:\+[ \t]*\n?|\\\n|\n(?=[ \t]+[\"']))?[ \t]*")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
_SHORT_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>=:]+""")
_BLANK = re.compile(r"[ \t]*")
_SPACE = re.compile(r"\s*")
_YAML_BLOCK = re.compile(r"[|>][+\-0-9]*[ \t]*\n")
_YAML_LINE = re.compile(r"([ \t]+)(\S[^\n]*)?(?:\n|$)|[ \t]*\n")
_YAML_ITEM = re.compile(r"[ \t]*-[ \t]+(?:\"([^\"\n]*)\"|'([^'\n]*)'|([^\s\"'#:\[\]{}]+))[ \t]*(?:\n|$)")
_ASSIGN_OPS = ("=", ":", ":=", "=>")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Tokens of one statement that are looked back at.
_BACK = 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; leftmost non-overlapping within a kind."""
    found = []
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def _inner(text: str, start: int, m: re.Match) -> tuple[int, int]:
    """The span within the quotes of a matched string."""
    quotes = 3 if m.lastgroup == "long" else 1
    return m.start(m.lastgroup) + quotes, m.end(m.lastgroup) - quotes


def _strings(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """The adjacent or added strings from here on, as spans, and where they end."""
    parts = []
    while (m := _PART.match(text, at)) is not None:
        parts.append(_inner(text, at, m))
        end = m.end()
        at = _JOIN.match(text, end).end()
    return parts, end if parts else at


def _block(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """The lines of a YAML block that starts here."""
    parts, depth = [], None
    while at < len(text) and (m := _YAML_LINE.match(text, at)) is not None:
        if m[2]:
            depth = depth or len(m[1])
            if len(m[1]) < depth:
                break
            parts.append((m.start(2), m.start(2) + len(m[2].rstrip())))
        at = m.end()
    return parts, at


def _target(text: str, back: deque) -> str | None:
    """The name that the tokens before an operator say."""
    if not back:
        return None
    kind, a, b = back[-1]
    if kind == "name":
        return text[a:b].lstrip("-")
    if kind == "string":
        return text[a + 1 : b - 1]
    if text[a:b] == "]" and len(back) >= 4 and back[-3][0] == "op" and text[back[-3][1]] == "[":
        key, owner = back[-2], back[-4]
        inner = text[key[1] + 1 : key[2] - 1] if key[0] == "string" else text[key[1] : key[2]]
        return inner if key[0] == "string" else f"{text[owner[1]:owner[2]]}.{inner}" if owner[0] == "name" else None
    return None


def literals(text: str):
    """(name, parts, quoted): each name with the spans of its literal, in text order, whatever the syntax."""
    back: deque = deque(maxlen=_BACK)
    at, typed, keyed, size = 0, None, None, len(text)
    while at < size:
        m = _TOKEN.match(text, at)
        if m is None:
            at += 1
            continue
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "line":
            back.clear()
            typed = keyed = None
            continue
        if kind == "space":
            continue
        mark = text[start:at] if kind == "op" else ""
        if mark in _ASSIGN_OPS:
            name, typed = typed if typed and mark == "=" else _target(text, back), None
            back.append((kind, start, at))
            if name is None:
                continue
            low = name.lower()
            if low in ("value", "content") and keyed:
                name = keyed
            here = _BLANK.match(text, at).end()
            parts, end = _strings(text, here)
            if parts:
                if low in ("key", "name", "id") and len(parts) == 1:
                    keyed = text[slice(*parts[0])]
                yield name, parts, True
                at = end
                back.clear()
                back.append(("string", parts[-1][0] - 1, parts[-1][1] + 1))
            elif here < size and text[here] in "[(":
                at = here + 1
                while True:
                    parts, end = _strings(text, _SPACE.match(text, at).end())
                    if not parts:
                        break
                    yield name, parts, True
                    at = _SPACE.match(text, end).end()
                    if at >= size or text[at] != ",":
                        break
                    at += 1
            elif mark == ":" and (block := _YAML_BLOCK.match(text, here)) is not None:
                parts, at = _block(text, block.end())
                if parts:
                    yield name, parts, True
            elif mark == ":" and here < size and text[here] == "\n" and _YAML_ITEM.match(text, here + 1):
                at = here + 1
                while (item := _YAML_ITEM.match(text, at)) is not None:
                    group = item.lastindex
                    yield name, [(item.start(group), item.end(group))], group < 3
                    at = item.end()
                back.clear()
            else:
                value = (_BARE if weight_of(name) else _SHORT_BARE).match(text, here)
                if value is None:
                    continue
                after = _BLANK.match(text, value.end()).end()
                identifier = _IDENTIFIER.fullmatch(text, here, value.end())
                if mark == ":" and identifier and not weight_of(value[0]) and text[after : after + 1] in ("=", "[") and text[after : after + 2] not in ("==", "=>"):
                    typed = name  # a type; the value follows
                    at = value.end()
                    continue
                if text[value.end() : value.end() + 1] not in ("(", "["):
                    yield name, [value.span()], False
                at = value.end()
                back.append(("name", here, at))
            continue
        if mark == "," and len(back) >= 2 and back[-1][0] == "string" and text[back[-2][1] : back[-2][2]] in ("(", ",") and back[-2][0] == "op":
            if text[back[-2][1]] == "(":
                parts, end = _strings(text, _BLANK.match(text, at).end())
                if parts:
                    yield text[back[-1][1] + 1 : back[-1][2] - 1], parts, True
                    at = end
        elif mark == ">" and len(back) >= 2 and back[-1][0] == "name" and text[back[-2][1] : back[-2][2]] == "<":
            name, end = text[back[-1][1] : back[-1][2]], text.find("<", at)
            line = text.find("\n", at, end) if end > 0 else 0
            if end > at and line < 0 and text[at:end].strip():
                yield name, [(at + len(text[at:end]) - len(text[at:end].lstrip()), at + len(text[at:end].rstrip()))], True
                at = end
        elif kind == "name" and text[start] == "-" and weight_of(text[start:at]):
            here = _BLANK.match(text, at).end()
            parts, end = _strings(text, here)
            value = None if parts or here == at else _BARE.match(text, here)
            if parts or value is not None and text[value.start()] not in "-=":
                yield text[start:at].lstrip("-"), parts or [value.span()], bool(parts)
                at = end if parts else value.end()
        if mark == ";":
            back.clear()
            typed = None
        else:
            back.append(("string" if kind == "string" else kind, start, m.end()))


def pairs(text: str):
    """(name, literal start, literal end, quoted) of each literal, from its first part to its last."""
    for name, parts, quoted in literals(text):
        yield name, parts[0][0], parts[-1][1], quoted


@functools.lru_cache(4096)
def weight_of(name: str) -> float:
    """How sensitive a target's name is, by its words and pairs of words."""
    words = [w.lower().removesuffix("s") if not w.lower().endswith("ss") else w.lower() for w in _WORDS.findall(name) if not w.isdigit()]
    found = [*words, *(a + b for a, b in zip(words, words[1:]))]
    return max((_SENSITIVE.get(w) or max((_SENSITIVE[e] for e in _ENDINGS if w.endswith(e)), default=0.0) for w in found), default=0.0)


def score(name: str, literal: str) -> float:
    """0 to 1: how sensitive the target name is, plus how random the literal looks."""
    weight = weight_of(name)
    if not weight or len(literal) < 6 or _PLACEHOLDER.match(literal) or weight < 0.6 and literal.isdigit():
        return 0.0
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in Counter(literal).values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, weight + 0.1 * (classes - 1) + 0.05 * min(entropy, 4.0))


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals that a sensitive name holds, directly or through names assigned from one another.

    Constants propagate in text order: a name takes the literal last assigned to
    it, and an unquoted right side that is such a name passes that literal on.
    A literal of several strings gives a span for each of them.
    """
    if not _HINT.search(text):
        return []
    known: dict[str, list[tuple[int, int]]] = {}
    found = set()
    for name, parts, quoted in literals(text):
        literal = "".join(text[a:b] for a, b in parts)
        if not quoted and literal in known:
            parts = known[literal]
            literal = "".join(text[a:b] for a, b in parts)
        elif not quoted and _IDENTIFIER.fullmatch(literal) and not re.search("[0-9]", literal):
            known.pop(name, None)
            continue
        known[name] = parts
        if score(name, literal) >= MIN_SCORE:
            found.update((a, 3, b) for a, b in parts if a < b)
    return sorted(found)


def spans_of(text: str | None) -> list[dict]:
    if not text:
        return []
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(base_spans(text) + literal_spans(text))]


SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row; spans by start, then kind in the order of KINDS, code points, end exclusive.

    One narrow pass without a shuffle, in time proportional to the text, however
    long. Null and empty texts have no spans; null or repeated ids and repeated
    rows stay as they are; other columns are dropped.
    """

    def scan(batches):
        for batch in common.sliced(batches):
            yield pa.record_batch([batch.column(0), pa.array([spans_of(x) for x in batch.column(1).to_pylist()], _ARROW)], names=[id_col, "spans"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(scan, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, spans {SPANS}")
