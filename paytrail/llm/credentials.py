"""Secret scans through a trigram inverted index.

Each rule is a regular expression. From its syntax tree comes a Boolean query over trigrams that every match must hold. The index is built
by segment (a slice of a partition): for each trigram that any rule asks for, the sorted list of documents that hold it. A rule's query is
answered by intersecting and uniting these lists, and its expression runs over the remaining candidates only. Rules without a mandatory
trigram scan every document, by runs of their character class where they are such a run, else by the expression itself.
The index keeps ASCII letters in lower case, so it never misses a document that a rule in either case would match.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from re import _parser as parser  # the standard library's regular-expression syntax tree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytrail.llm.memory import map_texts
from paytrail.llm.words import LOWER, slices, utf8

MASK = "[SECRET]"
_MANY = 64  # more strings than this are not followed one by one

#: A query: True (every document), or ("and" | "or", parts), or a trigram.
Query = bool | bytes | tuple[str, frozenset]


def _all(parts) -> Query:
    parts = frozenset(p for p in parts if p is not True)
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _any(parts) -> Query:
    parts = frozenset(parts)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]) -> Query:
    """Every match holds one of these strings."""
    return _any(_all(x[i : i + 3] for i in range(len(x) - 2)) for x in (lowered.encode().translate(bytes(LOWER)) for lowered in strings))


def _strings(node) -> set[str] | None:
    """The texts that a part of an expression matches, if they are few, else None."""
    kind, arg = node
    kind = str(kind)
    if kind == "LITERAL":
        return {chr(arg)}
    if kind == "IN":
        out: set[str] = set()
        for k, a in arg:
            if str(k) == "LITERAL":
                out.add(chr(a))
            elif str(k) == "RANGE" and a[1] - a[0] < 8:
                out |= {chr(c) for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if kind == "SUBPATTERN":
        return _sequence_strings(arg[3])
    if kind == "BRANCH":
        each = [_sequence_strings(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if kind in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] != parser.MAXREPEAT and arg[1] <= 4:
        inner = _sequence_strings(arg[2])
        if inner is not None and sum(len(inner) ** n for n in range(arg[0], arg[1] + 1)) <= _MANY:
            return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in itertools.product(sorted(inner), repeat=n)}
        return None
    return {""} if kind == "AT" else None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > _MANY:
            return None
        out = {a + b for a in out for b in more}
    return out


def _inner(node) -> Query:
    """What a part with too many texts requires all the same."""
    kind, arg = str(node[0]), node[1]
    if kind == "SUBPATTERN":
        return _sequence(arg[3])
    if kind == "BRANCH":
        return _any(_sequence(x) for x in arg[1])
    if kind in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
        return _sequence(arg[2])
    return True


def _sequence(nodes) -> Query:
    parts, run = [], {""}
    for node in nodes:
        more = _strings(node)
        if more is not None and len(run) * len(more) <= _MANY:
            run = {a + b for a in run for b in more}
            continue
        parts.append(_of_strings(run))
        run = more if more is not None and len(more) <= _MANY else {""}
        if more is None:
            parts.append(_inner(node))
    return _all([*parts, _of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """Boolean trigram query (lower case) that holds for every text with a match."""
    return _sequence(parser.parse(pattern))


@dataclass(frozen=True)
class Rule:
    """``least``: shortest text of ``group`` that counts. ``run``: the characters, if the expression is one run of them."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    run: str = ""

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern)

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost matches that don't overlap, less those too short; code points, end exclusive."""
        return [m.span() for m in self.regex.finditer(text) if len(m[self.group]) >= self.least]


BASE = (
    Rule("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16, "0123456789abcdef"),
)
_LINE = r"(?:[\r\n]|\\[nr])"  # the break also as written in JSON and source code
_GAP = r"""(?:[\s"'`,;+>|#*]|\\[nrt])"""
#: A private key up to the END line of the same kind, or else its header fields, its runs of key characters and a shorter last one.
_PRIVATE_KEY = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END \1PRIVATE KEY-----"
    rf"|(?:(?:{_GAP}++[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+)++(?={_GAP}++[A-Za-z0-9+/=]{{16}}))?(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)*+"
    rf"(?:{_GAP}++[A-Za-z0-9+/]++=++|[^\S\r\n]*+{_LINE}{_GAP}*+[A-Za-z0-9+/=]++(?=[^\S\r\n]*+(?:{_LINE}|[\"'`]|\Z)))?)"
)
ADDED = (
    Rule("private_key", _PRIVATE_KEY),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("code_host", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"(?ai:authorization)\x20*:\x20*(?ai:bearer|basic)\x20+([A-Za-z0-9+/_.=~-]+)", 1, 12),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]*:([^\x00-\x20/@]{3,})@"),
)
RULES = BASE + ADDED


def trigrams_of(query: Query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class Segment:
    """Postings of the wanted trigrams over one slice of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, wanted: list[bytes]):
        self.docs = np.arange(len(offsets) - 1)
        self.postings: dict[bytes, np.ndarray] = {}
        if len(data) < 3 or not wanted:
            return
        low = LOWER[data].astype(np.int32)
        code = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(code)
        doc = np.searchsorted(offsets, at, "right") - 1
        within = at + 3 <= offsets[doc + 1]
        pairs = np.unique(code[at[within]].astype(np.int64) * len(offsets) + doc[within])
        number, doc = np.divmod(pairs, len(offsets))
        cuts = np.searchsorted(number, np.arange(1, len(wanted) + 2))
        self.postings = {t: doc[cuts[i] : cuts[i + 1]] for i, t in enumerate(wanted)}

    def answer(self, query: Query) -> np.ndarray:
        if query is True:
            return self.docs
        if isinstance(query, bytes):
            return self.postings.get(query, self.docs[:0])
        lists = sorted((self.answer(q) for q in query[1]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def _with_run(data: np.ndarray, offsets: np.ndarray, rule: Rule) -> np.ndarray:
    """Documents with a run of at least ``least`` of the rule's characters: a full scan of the bytes."""
    member = np.zeros(256, bool)
    member[list(rule.run.encode())] = True
    edge = np.diff(np.concatenate([[0], member[data].view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(offsets, start[end - start >= rule.least], "right") - 1
    last = np.searchsorted(offsets, end[end - start >= rule.least] - 1, "right") - 1
    return np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(doc, last)])) if len(doc) else doc


@lru_cache(maxsize=4)
def _wanted(rules: tuple[Rule, ...]) -> tuple[list[bytes], np.ndarray]:
    """The trigrams that the rules' queries hold, and the number of each by its code."""
    wanted = sorted(set().union(*(trigrams_of(r.query) for r in rules)))
    table = np.zeros(1 << 24, np.uint8 if len(wanted) < 256 else np.uint16)
    for i, t in enumerate(wanted, 1):
        table[(t[0] << 16) | (t[1] << 8) | t[2]] = i
    return wanted, table


def find(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of every match in each text, ordered by start, then rule."""
    data, offsets = utf8(texts)
    wanted, table = _wanted(rules)
    segment = Segment(data, offsets, table, wanted)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for k, rule in enumerate(rules):
        for d in (_with_run(data, offsets, rule) if rule.run else segment.answer(rule.query)).tolist():
            found[d] += [(a, k, b) for a, b in rule.spans(texts[d].as_py() or "")]
    for x in found:
        x.sort()
    return found


def mask(text: str, spans: list[tuple[int, int, int]], by: str = MASK) -> str:
    """The text with every span (united where they overlap or touch) replaced."""
    out, at, reach = [], 0, -1
    for a, _, b in spans:
        if a > reach:
            out += [text[at:a], by]
        reach = max(reach, b)
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found: array of (kind, start, end), by start, then the rules' order; one row per input row.

    Null and empty texts hold nothing. No shuffle: segments are slices of the input's own partitions.
    """
    names = [r.kind for r in rules]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                found = find(part.column("text"), rules)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([[{"kind": names[k], "start": a, "end": b} for a, k, b in x] for x in found], kind)], ["doc_id", "found"])

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_texts(rows, search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, found array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with every secret replaced by ``MASK``; ``length`` (code points) follows where a text changed. Other texts stay as they are, null included."""
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                col = part.column(text)
                found = find(col, rules)
                if any(found):
                    texts = col.to_pylist()
                    changed = {i: mask(texts[i], x) for i, x in enumerate(found) if x}
                    part = part.set_column(names.index(text), part.schema.field(text), pa.array([changed.get(i, t) for i, t in enumerate(texts)], col.type))
                    if length in names:
                        old = part.column(length)
                        part = part.set_column(names.index(length), part.schema.field(length), pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(old.to_pylist())], old.type))
                yield part

    return map_texts(docs, clean, docs.schema)


def span_text(found: str = "found", kinds: tuple[str, ...] = ()) -> Column:
    """``kind:start:end`` of the spans, comma-joined; only of ``kinds`` if any are named."""
    spans = F.filter(found, lambda x: x["kind"].isin(*kinds)) if kinds else F.col(found)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def span_count(kind: str, found: str = "found") -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
