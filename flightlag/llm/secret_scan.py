"""Secret scans: fixed patterns, and an assignment-aware lexer that scores literals by their names."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightlag.llm.common import bound_batches, read_table

KINDS = ("assign", "access", "hex", "lexed")
#: Characters of a value that tell a placeholder, at least as many as the longest of PLACEHOLDERS.
HEAD = 16
#: A literal is reported from this score on.
LEAST_SCORE = 0.5

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
ASSIGN_STEMS = ("passw", "secret", "token", "api")

# Words of a name that make its value sensitive, and texts that stand for no secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "private": 0.5,
    "access": 0.4, "key": 0.5, "signature": 0.4, "salt": 0.4, "cookie": 0.4, "session": 0.3, "api": 0.3,
}
PLACEHOLDERS = frozenset(
    ["changeme", "example", "none", "null", "true", "false", "undefined", "todo", "redacted", "placeholder", "secret", "password"]
)

OPERATOR = re.compile(r"(?<![=!<>:+*/-])(?::=|=>|[:=])(?![=:/])|(?<!\+)\+=(?!=)")
# Read backwards from the operator, in the text turned round: a quote on both sides or none, and all of the name.
NAME_BACK = re.compile(r"""[ \t]*+\]?(["']?)([A-Za-z0-9_.$-]++)(?<=[A-Za-z_$])\1(?![A-Za-z0-9_.$-])""")
TERM = re.compile(
    r"""[ \t]*(?:(["'`])((?:\\.|(?!\1)[^\\\n])*)\1|([^\s"'`,;(){}\[\]#+<>|&]++)(?!\())"""
)
PLUS = re.compile(r"[ \t]*\+")
#: A type between ``name:`` and ``= "literal"``: a path, what it is made of in brackets, alternatives.
TYPE = re.compile(
    r"""[ \t]*+[&*]*+(?:'[a-z]++[ \t]++)?(?:mut[ \t]++)?[A-Za-z_][A-Za-z0-9_.]*+(?:::[A-Za-z0-9_]++)*+"""
    r"""(?:[<\[][^<>\[\]\n:="']*+[>\]]++)?+[?!]?(?:[ \t]*+\|[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+)*+[ \t]*+=[ \t]*+(?=["'`])"""
)
#: A literal of several lines, between three quotes of a kind.
TRIPLE = re.compile(r"""[ \t]*+("{3}|'{3})(.*?)\1""", re.S)
#: What opens a call or a list, and one of its arguments with what follows it.
OPEN = re.compile(r"[ \t]*+(?:(?:new|await)[ \t]++)?(?:[A-Za-z_$][A-Za-z0-9_.$:!]*+)?[ \t]*+[(\[]")
ARGUMENT = re.compile(
    r"""\s*+(?:(["'`])((?:\\.|(?!\1)[^\\\n])*+)\1|([^\s"'`,;(){}\[\]#<>|&=:]++))?\s*+(,|[)\]])"""
)
#: The name of a setting, as ``getenv`` and the like are given.
SETTING = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\Z")
#: An element with text only.
ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>([^<>\n]++)</\1>")
WORDS_OF_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*\Z")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, leftmost and without overlap per kind."""
    found = []
    lowered = text.lower()
    if any(stem in lowered for stem in ASSIGN_STEMS):
        found += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return found


Term = tuple[str, str, int, int]


def assignments(text: str) -> list[tuple[str, list[Term]]]:
    """Name and terms of each assignment: ``name = "literal" + other`` and the like.

    A term is (``literal`` or ``bare``, value, start, end). Reads ``=``, ``:``, ``:=``,
    ``=>`` and ``+=`` with plain or quoted names, as source and configuration do,
    types between name and value (``name: type = "literal"``), literals of several lines
    and elements with text. What ``+=`` adds to comes first, as a bare term of that name.
    Each literal among the arguments of a call or the items of a list is an assignment of
    its own, but for names of settings; nested calls and named arguments are read at their own
    operators.
    """
    found = [(m.start(), m[1], [("literal", m[2], *m.span(2))]) for m in ELEMENT.finditer(text)] if "</" in text else []
    back = text[::-1]
    done = 0
    for op in OPERATOR.finditer(text):
        if op.start() < done:
            continue
        name = NAME_BACK.match(back, len(text) - op.start())
        if not name:
            continue
        at = op.end()
        if op[0] == ":" and (typed := TYPE.match(text, at)):
            at = typed.end()
        given = name[2][::-1]
        if block := TRIPLE.match(text, at):
            done = block.end()
            found.append((op.start(), given, [("literal", block[2], *block.span(2))]))
        elif terms := _terms(text, at):
            if op[0] == "+=":
                terms.insert(0, ("bare", given, op.start(), op.start()))
            found.append((op.start(), given, terms))
        elif opened := OPEN.match(text, at):
            found += [(op.start(), given, [term]) for term in _arguments(text, opened.end())]
    return [(name, terms) for _, name, terms in sorted(found, key=lambda f: f[0])]


def _terms(text: str, at: int) -> list[Term]:
    terms: list[Term] = []
    while term := TERM.match(text, at):
        if term[1]:
            terms.append(("literal", term[2], term.start(2), term.end(2)))
        else:
            terms.append(("bare", term[3], term.start(3), term.end(3)))
        plus = PLUS.match(text, term.end())
        if not plus:
            break
        at = plus.end()
    return terms


def _arguments(text: str, at: int) -> Iterator[Term]:
    """Literals up to the end of the call or list, or to an argument that is more than a literal or a word."""
    while argument := ARGUMENT.match(text, at):
        if argument[1] and not SETTING.match(argument[2]):
            yield "literal", argument[2], argument.start(2), argument.end(2)
        if argument[4] != ",":
            return
        at = argument.end()


def name_weight(name: str) -> float:
    words = [w.lower() for w in WORDS_OF_NAME.findall(name)]
    together = "".join(words)
    weights = sorted((SENSITIVE[w] for w in words if w in SENSITIVE), reverse=True)
    if "apikey" in together or "accesskey" in together or "privatekey" in together:
        return 1.0
    return min(1.0, sum(weights[:2]))


def strength(value: str) -> float:
    """How much a literal looks like a secret: entropy in bits against 40, 0 for placeholders."""
    return _strength(Counter(value), len(value), value)


def _strength(counts: Counter, length: int, head: str) -> float:
    """``strength`` of a value from its characters and its first HEAD ones."""
    if length < 6 or (length <= HEAD and head.lower() in PLACEHOLDERS) or head.startswith(("${", "<", "{{", "%(")):
        return 0.0
    bits = -math.fsum(c * math.log2(c / length) for c in counts.values())
    classes = sum(any(test(c) for c in counts) for test in (str.isdigit, str.islower, str.isupper))
    spaced = 0.3 if " " in counts else 1.0
    return min(1.0, bits / 40.0) * (0.6 + 0.2 * min(classes, 2)) * spaced


class Value(NamedTuple):
    """The literals that a name stands for: a set of numbers as bits, and what their text end to end has.

    ``first`` are the numbers that the first HEAD characters come from.
    """

    node: int
    literals: int
    counts: Counter
    length: int
    first: tuple[int, ...]


class Literals:
    """Literals and the assignments that join them, none of which is copied into another."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, int], int] = {}
        self.texts: list[str] = []
        #: Of each assignment its literals, and as ~number the earlier assignments it names, in order; and its score.
        self.items: list[list[int]] = []
        self.scores: list[float] = []

    def literal(self, text: str, start: int, end: int) -> int:
        number = self.number.setdefault((start, end), len(self.texts))
        if number == len(self.texts):
            self.texts.append(text)
        return number

    def join(self, items: list[int | Value]) -> Value:
        """The value that has all literals of ``items``, each once; adds an assignment."""
        held, counts, length = 0, Counter(), 0
        for item in items:
            if isinstance(item, int):
                bit = 1 << item
                if not held & bit:
                    held |= bit
                    counts.update(self.texts[item])
                    length += len(self.texts[item])
                continue
            if not held:
                held, counts, length = item.literals, item.counts.copy(), item.length
                continue
            both = held & item.literals
            new = item.literals ^ both
            if both.bit_count() < new.bit_count():
                counts.update(item.counts)
                length += item.length
                for text in self._texts_of(both):
                    counts.subtract(text)
                    length -= len(text)
            else:
                for text in self._texts_of(new):
                    counts.update(text)
                    length += len(text)
            held |= new
        self.items.append([item if isinstance(item, int) else ~item.node for item in items])
        self.scores.append(0.0)
        return Value(len(self.items) - 1, held, counts, length, self._first(items))

    def _texts_of(self, literals: int) -> Iterator[str]:
        digits = bin(literals)[:1:-1]
        at = digits.find("1")
        while at >= 0:
            yield self.texts[at]
            at = digits.find("1", at + 1)

    def _first(self, items: list[int | Value]) -> tuple[int, ...]:
        found: dict[int, None] = {}
        length = 0
        for item in items:
            first = (item,) if isinstance(item, int) else item.first
            more = not isinstance(item, int) and sum(len(self.texts[i]) for i in first) < item.length
            if more and any(i in found for i in first):
                first = self._in_order(item.node)  # what lies behind its first ones may be needed
            for i in first:
                if i not in found:
                    found[i] = None
                    length += len(self.texts[i])
                    if length >= HEAD:
                        return tuple(found)
        return tuple(found)

    def _in_order(self, node: int) -> Iterator[int]:
        met, stack = {node}, [iter(self.items[node])]
        while stack:
            item = next(stack[-1], None)
            if item is None:
                stack.pop()
            elif item >= 0:
                yield item
            elif ~item not in met:
                met.add(~item)
                stack.append(iter(self.items[~item]))

    def score(self, value: Value, weight: float) -> None:
        head = "".join(self.texts[i] for i in value.first)
        self.scores[value.node] = weight * _strength(value.counts, value.length, head)

    def best(self) -> dict[tuple[int, int], float]:
        """Of each literal the highest score of an assignment it is in, directly or through others."""
        scores, best = self.scores.copy(), [0.0] * len(self.texts)
        for node in range(len(self.items) - 1, -1, -1):
            for item in self.items[node]:
                if item >= 0:
                    best[item] = max(best[item], scores[node])
                else:
                    scores[~item] = max(scores[~item], scores[node])
        return dict(zip(self.number, best))


def covered_by(spans: list[Span]) -> Callable[[int, int], bool]:
    """Tells whether one of ``spans`` holds all from ``start`` to ``end``: the furthest of those that begin no later does."""
    ordered = sorted((s.start, s.end) for s in spans)
    starts = [start for start, _ in ordered]
    furthest = list(accumulate((end for _, end in ordered), max, initial=-1))
    return lambda start, end: furthest[bisect_right(starts, start)] >= end


def lexed_spans(text: str, base: list[Span]) -> list[Span]:
    """Literals that a sensitive name gets, directly or through other names.

    A bare word that an earlier assignment defined stands for that one's literals,
    however many. The span is that of the literal, where it is written. Literals within
    a base span are left to it.
    """
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    values: dict[str, Value] = {}
    literals = Literals()
    for name, terms in assignments(text):
        items: list[int | Value] = []
        for kind, value, start, end in terms:
            if kind == "bare" and value in values and IDENTIFIER.match(value):
                items.append(values[value])
            elif end > start and (kind == "literal" or len(terms) == 1):
                items.append(literals.literal(value, start, end))
        values[name] = joined = literals.join(items)
        weight = name_weight(name)
        if weight and joined.length:
            literals.score(joined, weight)
    covered = covered_by(base)
    return [
        Span("lexed", start, end)
        for (start, end), score in literals.best().items()
        if score >= LEAST_SCORE and not covered(start, end)
    ]


def scan_text(text: str | None) -> list[Span]:
    """All spans in code points, end exclusive, by start and then by kind; null has none."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + lexed_spans(text, base), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPAN_TYPE = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
)


@F.pandas_udf(T.ArrayType(SPAN_TYPE))
def secret_spans(text: pd.Series) -> pd.Series:
    return pd.Series([[s._asdict() for s in scan_text(t)] for t in text])


def scan_secrets(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with an array of spans; a column of that name gives way.

    Rows are scanned where they are, without a shuffle. Null and empty texts have no
    spans, repeated rows get the same ones. A text is one unit of work.
    """
    bound_batches(docs.sparkSession)
    return docs.withColumn(name, secret_spans(F.col(text)))


def joined_spans(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs).drop("text")
    spans = F.col("secrets")

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != "lexed")
    return found.select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
    )
