"""Secret scans through a trigram inverted index.

Each rule's pattern gives a Boolean query over the trigrams that any match must hold. A
task indexes its rows in segments: a posting list per trigram that some rule asks for.
Rules intersect and unite postings, and only the candidates are searched. A rule that
no trigram is sure for searches every row. Segments never leave their task, so no
posting list grows with the corpus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetscope.llm.common import id_and_text, text_udf
from packetscope.session import ship

# more alternatives than this are not spelled out while a query is derived
_MOST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of less than ``least`` characters in ``group`` are dropped."""

    kind: str
    pattern: str
    ignore_case: bool = False  # ASCII letters only
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# fixed values: patterns and lengths of the base kinds
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ignore_case=True,
        group=2,
        least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    # a run of such letters is matched whole, so asking for 32 of them finds the same runs
    Rule("hex", r"[0-9a-f]{32,}", least=32),
)

# A query is True (anything may match), a trigram, or ("and" | "or", parts).


def _all_of(parts) -> object:
    parts = {p for p in parts if p is not True}
    return True if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))


def _any_of(parts) -> object:
    parts = set(parts)
    if True in parts or not parts:
        return True
    return parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def _holding(strings) -> object:
    """Texts that hold one of the strings."""
    return _any_of(_all_of(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


@dataclass
class _Part:
    """What is known of the strings a part of a pattern matches."""

    exact: set[str] | None  # all of them, if they are few
    starts: set[str]
    ends: set[str]
    query: object

    def opened(self) -> _Part:
        """The same without ``exact``."""
        if self.exact is None:
            return self
        return _Part(
            None, {s[:2] for s in self.exact}, {s[-2:] for s in self.exact},
            _all_of([self.query, _holding(self.exact)]),
        )


def _exactly(strings) -> _Part:
    return _Part(set(strings), set(), set(), True)


def _anything() -> _Part:
    return _Part(None, {""}, {""}, True)


def _joined(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= _MOST else None


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None:
        both = _joined(a.exact, b.exact)
        if both is not None:
            return _Part(both, set(), set(), _all_of([a.query, b.query]))
    ao, bo = a.opened(), b.opened()
    across = _joined(ao.ends, bo.starts)
    starts = _joined(a.exact, bo.starts) if a.exact is not None else ao.starts
    ends = _joined(ao.ends, b.exact) if b.exact is not None else bo.ends
    return _Part(
        None,
        {s[:2] for s in starts} if starts is not None else {""},
        {s[-2:] for s in ends} if ends is not None else {""},
        _all_of([ao.query, bo.query, True if across is None else _holding(across)]),
    )


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        union = set().union(*(p.exact for p in parts))
        if len(union) <= _MOST:
            return _Part(union, set(), set(), _any_of(p.query for p in parts))
    parts = [p.opened() for p in parts]
    return _Part(
        None, set().union(*(p.starts for p in parts)), set().union(*(p.ends for p in parts)),
        _any_of(p.query for p in parts),
    )


def _class(items) -> _Part:
    letters: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            letters.add(chr(value))
        elif str(op) == "RANGE" and value[1] - value[0] < 8:
            letters |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return _anything()
    return _exactly(letters) if letters and len(letters) <= 8 else _anything()


def _part_of(tree) -> _Part:
    whole = _exactly([""])
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            part = _exactly([chr(value)])
        elif name == "IN":
            part = _class(value)
        elif name == "SUBPATTERN":
            part = _part_of(value[-1])
        elif name == "BRANCH":
            part = _either([_part_of(branch) for branch in value[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            inner = _part_of(inner)
            if (least, most) == (1, 1):
                part = inner
            elif (least, most) == (0, 1):
                part = _either([inner, _exactly([""])])
            else:
                part = inner.opened() if least else _anything()
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            part = _exactly([""])
        else:
            part = _anything()
        whole = _then(whole, part)
    return whole


def trigram_query(rule: Rule) -> object:
    """The Boolean query every text with a match fulfils; True if there is none.

    Rules that ignore case are asked over lower-case text.
    """
    pattern = rule.pattern
    query = _part_of(parser.parse(pattern, re.ASCII)).opened().query
    return _lower(query) if rule.ignore_case else query


def _lower(query):
    if query is True:
        return True
    if isinstance(query, str):
        return query.lower()
    return (query[0], frozenset(map(_lower, query[1])))


def trigrams_in(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


class Segment:
    """Posting lists of some texts, for the trigrams that rules ask for."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self._lower: list[str] | None = None
        self._postings: dict[tuple[bool, str], np.ndarray] = {}

    def posting(self, gram: str, folded: bool) -> np.ndarray:
        """Places of the texts that hold the trigram, ascending."""
        key = (folded, gram)
        if key not in self._postings:
            if folded and self._lower is None:
                self._lower = [t.lower() for t in self.texts]
            texts = self._lower if folded else self.texts
            places = [i for i, text in enumerate(texts) if gram in text]
            self._postings[key] = np.asarray(places, np.int64)
        return self._postings[key]

    def candidates(self, query, folded: bool) -> np.ndarray:
        if query is True:
            return np.arange(len(self.texts))
        if isinstance(query, str):
            return self.posting(query, folded)
        kind, parts = query
        found = None
        for part in sorted(parts, key=repr):
            places = self.candidates(part, folded)
            if found is None:
                found = places
            elif kind == "and":
                found = np.intersect1d(found, places, assume_unique=True)
            else:
                found = np.union1d(found, places)
            if kind == "and" and not len(found):
                break
        return found


class Scanner:
    """Finds the secrets of all rules in lists of texts."""

    def __init__(self, rules=RULES):
        self.rules = [(r, r.compiled(), trigram_query(r)) for r in rules]

    def __call__(self, texts: list[str]) -> list[list[dict]]:
        segment = Segment(texts)
        found: list[list[tuple]] = [[] for _ in texts]
        for order, (rule, pattern, query) in enumerate(self.rules):
            for i in segment.candidates(query, rule.ignore_case).tolist():
                for m in pattern.finditer(texts[i]):
                    if len(m[rule.group]) >= rule.least:
                        found[i].append((m.start(), order, m.end(), rule.kind))
        return [
            [{"kind": kind, "start": start, "end": end} for start, _, end, kind in sorted(one)]
            for one in found
        ]


_KIND = "array<struct<kind string, start int, end int>>"
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
)


def secret_spans(docs: DataFrame, text_col: str = "text", rules=RULES) -> Column:
    """Spans of secrets in a text column, by start and then by rule; code points, end exclusive.

    Null and empty texts have none.
    """
    ship(docs.sparkSession)
    return text_udf(_KIND, _ARROW, lambda: Scanner(rules))(docs[text_col])


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES
) -> DataFrame:
    """``doc_id, found``: the spans of every whole text, a row per row.

    Texts without a secret have an empty list, null and empty texts too. Repeated rows
    and null ids come back as they are, other columns are not read, an empty table gives
    an empty one.
    """
    texts = id_and_text(docs, id_col, text_col)
    return texts.select("doc_id", secret_spans(texts, rules=rules).alias("found"))


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the spans as one string, and its checksum."""
    kinds = F.transform("found", lambda s: s["kind"])
    of = {
        kind: F.size(F.filter(kinds, lambda k: k == F.lit(kind))).cast("long")  # noqa: B023
        for kind in ("assign", "access", "hex")
    }
    spans = F.concat_ws(
        ",", F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    )
    kept = found.select("doc_id", *[c.alias(f"n_{k}") for k, c in of.items()], spans.alias("spans"))
    return kept.withColumn("base_sha256", F.sha2("spans", 256))


def redact(docs: DataFrame, text_col: str = "text", rules=RULES) -> Column:
    """The text with every secret replaced by its kind in brackets; overlapping spans become one.

    Null stays null.
    """
    ship(docs.sparkSession)

    def worker():
        scan = Scanner(rules)

        def run(texts):
            return [_without(text, spans) for text, spans in zip(texts, scan(texts))]

        return run

    clean = text_udf("string", pa.string(), worker)(docs[text_col])
    return F.when(docs[text_col].isNotNull(), clean)


def _without(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], f"[{span['kind']}]"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])
