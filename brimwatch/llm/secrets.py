"""Secret scans by assignment-aware lexing (operator 11).

A text is read as source or configuration, whatever it is: strings, names,
operators and bare values become tokens, and from them pairs of a target name
and what is assigned to it. Joined literals are one value of several parts,
names stand for the constants assigned to them, and a literal is reported where
the name of its target is sensitive and its characters look chosen by chance or
for secrecy. The base patterns (assignments to well-known words, access key
ids, hexadecimal runs) are matched besides and always reported.

Prose has few assignments: only texts that hold part of a sensitive name and a
sign of assignment are lexed, which changes no result. Every expression used is
linear in the text.

Odd input: a null or empty text has no spans. Very long texts are read whole.
Repeated rows are scanned each; a null doc_id stays null; other columns are not
read. An empty table gives none.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.llm.common import slices

#: Kinds of spans in the order of equal starts; the last is what lexing adds.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
#: Shortest second group of an assignment.
ASSIGNED = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

# ------------------------------------------------------------------ names

#: How sensitive a part of a name, or two or three parts in a row, make it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passwort": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.6,
    "secret": 1.0, "secrets": 0.8, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0,
    "api key": 1.0, "access key": 1.0, "secret key": 1.0, "private key": 1.0, "signing key": 1.0,
    "encryption key": 1.0, "master key": 1.0, "account key": 1.0, "shared key": 0.9, "auth key": 1.0,
    "client secret": 1.0, "auth": 0.5, "authorization": 0.7, "bearer": 0.7, "connection string": 0.7,
    "salt": 0.5, "pin": 0.4, "key": 0.4, "cookie": 0.4, "session id": 0.5,
}
#: Last parts of names that speak about a secret but do not hold it.
ABOUT = frozenset(
    "name file path url uri field length len size count type kind hint policy expiry expires ttl label prompt "
    "placeholder header format regex pattern min max enabled required timeout id title text message error class "
    "column index version algorithm".split()
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_weight(name: str) -> float:
    """How likely the value of a variable, key or option of this name is a secret, 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name) if not p.isdigit()]
    if not parts or parts[-1] in ABOUT:
        return 0.0
    runs = (" ".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, min(i + 3, len(parts)) + 1))
    return max((SENSITIVE.get(r, 0.0) for r in runs), default=0.0)


# --------------------------------------------------------------- literals

#: Values that stand for a secret that is elsewhere.
STAND_IN = re.compile(
    r"(?:x{3,}|\*+|\.{3,}|-+|_+|<[^>]*>|\[[^\]]*\]|\$?\{+[^}]*\}+|%\(?\w*\)?[sd%]|\$\w+|"
    r"(?:your|my|the|some|insert|enter|put)[-_ ].*|change[-_ ]?(?:me|this|it).*|(?:place|pass)?holder|example.*|"
    r"dummy|sample|redacted|removed|hidden|none|null|nil|true|false|undefined|todo|tbd|string|required|optional|"
    r"(?:get)?env.*|process\.env.*|os\.environ.*|input|prompt|password|secret|token)",
    re.IGNORECASE,
)
_REFERENCE = re.compile(r"\$\{?(\w+)\}?|\{\{?\s*([\w.]+)\s*\}?\}|%\((\w+)\)s")


def entropy(value: str) -> float:
    """Bits per character by the characters' own shares."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def literal_weight(value: str) -> float:
    """How much a value looks like a secret, 0 to 1: variety, kinds of characters, length."""
    if len(value) < 6 or STAND_IN.fullmatch(value):
        return 0.0
    kinds = sum(
        any(test(c) for c in value)
        for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum() and not c.isspace())
    )
    variety = min(1.0, entropy(value) / 3.0)
    words = value.count(" ")
    weight = 0.5 * variety + 0.15 * min(kinds, 3) + 0.1 * min(1.0, len(value) / 16)
    return max(0.0, weight - 0.15 * words)


#: Least product of both weights that is reported.
LEAST = 0.45

# ----------------------------------------------------------------- lexing

_LEX = re.compile(
    r"""
      (?P<quote> \"\"\" | ''' | "|`|(?<!\w)' )
    | (?P<flag> (?<![\w-])--[A-Za-z][\w-]*+ )
    | (?P<open> <[A-Za-z][\w:.-]*+> )
    | (?P<name> [^\W\d][\w$]*+(?:(?:\.|::|->|-)[^\W\d][\w$]*+)*+ )
    | (?P<compare> ===?|!==?|<=|>= )
    | (?P<assign> :=|=>|\+=|\?=|=|: )
    | (?P<plus> \+(?!=)|\.\. )
    | (?P<space> [^\S\n]++ )
    | (?P<line> \n )
    | (?P<other> [0-9][\w.+/=~@%&*^!?\#-]*+ | [^\s\w]  | \w++ )
    """,
    re.VERBOSE,
)
#: What follows an opening quote, to its end.
_BODY = {
    q: re.compile(rf"([^{q[0]}\\{ends}]*+(?:\\.{more}[^{q[0]}\\{ends}]*+)*+){q}", re.DOTALL)
    for q, ends, more in (
        ('"', r"\n", ""),
        ("'", r"\n", ""),
        ("`", r"\n", ""),
        ('"""', "", '|"(?!"")'),
        ("'''", "", "|'(?!'')"),
    )
}
#: A bare value of a configuration line.
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]++")


@dataclass
class Token:
    kind: str
    start: int
    end: int
    text: str
    inner: tuple[int, int] | None = None


@dataclass
class Pair:
    """What a name is set to, in order: literals and bare words with their places, names in their stead."""

    name: str
    start: int
    parts: list[tuple[str, str, int, int]] = field(default_factory=list)  # (kind, text, start, end)


def lex(text: str) -> Iterator[Token]:
    """Tokens of a text, without blanks.

    A quote that is not closed is a sign like any other, and so are all quotes
    of its kind up to where the search for its end stopped: they are not closed
    either, which keeps the time linear.
    """
    at, hopeless = 0, dict.fromkeys(_BODY, 0)
    while at < len(text):
        m = _LEX.match(text, at)
        kind, at = m.lastgroup, m.end()
        if kind == "quote":
            q = m[0]
            body = _BODY[q].match(text, at) if m.start() >= hopeless[q] else None
            if body:
                at = body.end()
                yield Token("string", m.start(), at, text[m.start() : at], body.span(1))
                continue
            if m.start() >= hopeless[q]:
                stop = text.find("\n", at) if len(q) == 1 else -1
                hopeless[q] = stop if stop >= 0 else len(text)
            kind = "other"
        if kind != "space":
            yield Token(kind, m.start(), at, m[0])


def _value(text: str, tokens: list[Token], i: int) -> tuple[list[tuple[str, str, int, int]], int]:
    """Parts of the value that begins at token ``i``, and the token after it."""
    parts: list[tuple[str, str, int, int]] = []
    joined, inside = True, i < len(tokens) and tokens[i].text == "("
    i += inside

    def part(t: Token) -> tuple[str, str, int, int]:
        return ("literal", text[t.inner[0] : t.inner[1]], *t.inner) if t.inner else ("name", t.text, t.start, t.end)

    def adds(k: int) -> bool:
        return k + 1 < len(tokens) and tokens[k].kind == "plus" and tokens[k + 1].kind in ("string", "name")

    while i < len(tokens):
        t = tokens[i]
        if t.kind == "string" and (joined or parts[-1][0] == "literal"):
            parts.append(part(t))
            joined = False
        elif t.kind == "name" and joined and (parts or adds(i + 1)):
            parts.append(part(t))
            joined = False
        elif adds(i) and parts and not joined:
            joined = True
        elif not (t.kind == "line" and inside):
            break
        i += 1
    if parts:
        return parts, i
    t = tokens[i] if i < len(tokens) else None
    if t is None or t.kind not in ("name", "other", "assign"):
        return [], i
    found = _BARE.match(text, t.start)
    if not found:
        return [], i
    value, stop = found[0], found.end()
    kind = "name" if t.kind == "name" and stop == t.end else "bare"
    while i < len(tokens) and tokens[i].start < stop:
        i += 1
    return [(kind, value, t.start, stop)], i


def pairs(text: str) -> list[Pair]:
    """All assignments of a text, in order of their names.

    ``name = value``, ``"key": value``, ``x["key"] = value``, ``name: type = value``,
    ``--option value`` and ``<tag>value</tag>``.
    """
    tokens = list(lex(text))
    out: list[Pair] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "open" and i + 1 < len(tokens):
            stop = text.find("<", t.end)
            body = text[t.end : stop].strip() if stop > 0 else ""
            if body and text.startswith(f"</{t.text[1:]}", stop):
                start = text.index(body, t.end)
                out.append(Pair(t.text[1:-1], t.start, [("literal", body, start, start + len(body))]))
            i += 1
            continue
        if t.kind == "flag" and i + 1 < len(tokens) and tokens[i + 1].kind in ("string", "name", "other"):
            parts, i = _value(text, tokens, i + 1)
            out.append(Pair(t.text.lstrip("-"), t.start, [("bare" if p[0] == "name" else p[0], *p[1:]) for p in parts[:1]]))
            continue
        if t.kind not in ("name", "string", "flag"):
            i += 1
            continue
        name = text[t.inner[0] : t.inner[1]] if t.inner else t.text.lstrip("-")
        j = i + 1
        while j < len(tokens) and tokens[j].text in ("]", ")"):
            j += 1
        if j >= len(tokens) or tokens[j].kind != "assign" or len(name) > 80:
            i += 1
            continue
        parts, after = _value(text, tokens, j + 1)
        if (
            tokens[j].text == ":"
            and len(parts) == 1
            and parts[0][0] == "name"
            and after < len(tokens)
            and tokens[after].text == "="
        ):
            # What stood behind the colon was a type.
            parts, after = _value(text, tokens, after + 1)
        if parts:
            out.append(Pair(name, t.start, parts))
            # Names inside a value can be targets themselves: a = b = "value", {"a": {"b": 1}}.
            i = after if parts[-1][0] != "name" else j + 1
        else:
            i = j + 1
    return out


def _leaf(name: str) -> str:
    return re.split(r"\.|::|->", name)[-1]


#: Characters of a value put together from several parts that are weighed.
WEIGHED = 1024


def literals(found: list[Pair]) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """(name, value, places of its literals) of sensitive names, with constants put in for names.

    A name means its last assignment before the use, or else its first one
    after it; one that leads back to itself means nothing. A bare word that no
    constant explains is its own value, if it is not all letters of one case.
    Each place is given once, with the first name that leads to it.
    """
    where: dict[str, list[int]] = {}
    for i, p in enumerate(found):
        where.setdefault(_leaf(p.name), []).append(i)

    def source(i: int, part: tuple) -> int | None:
        kind, word = part[:2]
        reference = _REFERENCE.fullmatch(word) if kind != "name" else None
        if kind != "name" and not reference:
            return None
        at = where.get(_leaf(next(g for g in reference.groups() if g) if reference else word), [])
        k = bisect_left(at, i)
        return at[k - 1] if k else next((j for j in at[:2] if j != i), None)

    values: dict[int, str | None] = {}

    def value(i: int) -> str:
        stack = [i]
        while stack:
            k = stack[-1]
            if values.get(k) is None:
                values.setdefault(k, None)
                needed = [s for s in (source(k, p) for p in found[k].parts) if s is not None and s not in values]
                if needed:
                    stack += needed
                    continue
                parts, length = [], 0
                for p in found[k].parts:
                    s = source(k, p)
                    plain = p[0] == "literal" or len(found[k].parts) == 1 and re.search(r"\d|[a-z][A-Z]", p[1])
                    own = (values.get(s) or "") if s is not None else p[1] if plain else ""
                    parts.append(own)
                    length += len(own)
                    if length > WEIGHED:
                        break
                values[k] = parts[0] if len(parts) == 1 else "".join(parts)[:WEIGHED]
            stack.pop()
        return values[i]

    seen: set[int] = set()
    for i, p in enumerate(found):
        if name_weight(p.name) * literal_weight(value(i) if name_weight(p.name) else "") < LEAST:
            continue
        places, todo = [], [i]
        while todo:
            k = todo.pop()
            if k in seen:
                continue
            seen.add(k)
            for part in found[k].parts:
                s = source(k, part)
                if s is not None:
                    todo.append(s)
                elif part[0] != "name" or len(found[k].parts) == 1:
                    places.append(part[2:])
        yield p.name, value(i), sorted(places)


_STEMS = sorted({w for name in SENSITIVE for w in name.split(" ")[-1:]}, key=len)
_SIGNS = (":", "=", "--", "</")


def lexed(text: str) -> list[tuple[int, int]]:
    """Places of the literals that sensitive names are set to."""
    low = text.lower()
    if not any(s in text for s in _SIGNS) or not any(s in low for s in _STEMS):
        return []
    return sorted({p for _, _, places in literals(pairs(text)) for p in places if p[1] > p[0]})


_WORDS = ("passw", "secret", "token", "apikey", "api_key")


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(docs: DataFrame) -> DataFrame:
    """Per document its spans: doc_id and ``found``, a list of (kind, start, end) in code points, end exclusive."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = []
                for text in piece.column("text").to_pylist():
                    spans = sorted([*base(text), *((a, 3, b) for a, b in lexed(text))]) if text else []
                    rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(rows, span)], names=["doc_id", "found"]
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, found array<struct<kind: string, start: int, end: int>>"
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every document; see ``scan`` for the spans themselves."""
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(written(F.filter("found", lambda s: s["kind"] != KINDS[-1])), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )
