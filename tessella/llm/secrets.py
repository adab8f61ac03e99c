"""Secrets in texts, found by one automaton for all rules.

The rules' expressions are compiled once into the transition arrays of one
minimal automaton (see automaton.py), which tasks run over all bytes in one
pass. Where it accepts, a second automaton of all rules, anchored, reads the
matches off from the byte at which the first one left its idle state: a rule's
matches are its leftmost longest ones, and don't overlap. A match counts if it
also meets the rule's second expression; one that fails still uses up its bytes.

Defined cases: a null or empty text has no spans; positions count code points of
the whole text; repeated rows and null doc_ids are each judged alone; spans of
different rules may overlap, and are listed by start, then in the rules' order;
an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm.automaton import Automaton, compiled
from tessella.llm.spread import map_arrow

#: Bytes of text that are scanned in one go.
CHUNK = 4 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    find: str  # what a match is
    keep: str  # what a match must be as a whole to count
    seen: str = ""  # what every match that counts begins with; kept short, as it decides the size of the automaton


def either(word: str) -> str:
    """The letters of a word in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"

#: The base rules come first and are fixed by the contract.
BASE = (
    Rule("assign", f"{_ASSIGN}{_VALUE}+", f"{_ASSIGN}{_VALUE}{{6,}}"),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24,}", "[0-9a-f]{24,}"),
)
#: Formats that are public and hardly occur by chance.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git", "gh[oprsu]_[A-Za-z0-9]+", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{16,}", r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("login", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]{4,}@"),
)
RULES = BASE + MORE

SPANS = "array<struct<kind:string,start:long,end:long>>"
SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

Span = tuple[int, int, int]  # start, rule, end


def machines(rules: tuple[Rule, ...]) -> tuple[Automaton, Automaton]:
    """(searching, with tag i where rule i may have a match; anchored, with tag 2 i for its match and 2 i + 1 if that counts)."""
    return compiled([r.seen or r.find for r in rules], True), compiled([x for r in rules for x in (r.find, r.keep)], False)


def matches(m: Automaton, text: bytes, rule: int, at: int, stop: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether it counts) of a rule's matches that start in a stretch of text."""
    while at < stop:
        end, tags = m.longest(text, at, 2 * rule)
        if end > at:
            yield at, end, bool(tags >> (2 * rule + 1) & 1)
        at = max(end, at + 1)


def spans(search: Automaton, anchored: Automaton, rules: int, data: np.ndarray, off: np.ndarray) -> list[list[Span]]:
    """Of each document laid end to end: its spans in code points, by start, then rule."""
    out: list[list[Span]] = [[] for _ in range(len(off) - 1)]
    state = search.states(data, off)
    tags = search.tags[state // search.width]
    hits = np.flatnonzero(tags)
    if not len(hits):
        return out
    # stretches between idle bytes, cut at the ends of documents
    start, end = K.bounds(state != 0, off)
    which = np.unique(np.searchsorted(start, hits, "right") - 1)
    of = np.searchsorted(off, start[which], "right") - 1
    for d in np.unique(of).tolist():
        text = data[off[d] : off[d + 1]]
        point = np.cumsum(np.concatenate([[0], (text & 0xC0) != 0x80]))
        held, after = text.tobytes(), [0] * rules
        for k in which[of == d].tolist():
            a, b = int(start[k] - off[d]), int(end[k] - off[d])
            seen = int(np.bitwise_or.reduce(tags[start[k] : end[k]]))
            for i in range(rules):
                if seen >> i & 1:
                    for s, e, counts in matches(anchored, held, i, max(a, after[i]), b):
                        after[i] = e
                        if counts:
                            out[d].append((int(point[s]), i, int(point[e])))
        out[d].sort()
    return out


def _scan(docs: DataFrame, rules: tuple[Rule, ...], row, arrow: pa.Schema, schema: str) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = docs.sparkSession.sparkContext.broadcast(machines(rules))  # its size depends on the rules alone

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, data, off in K.pieces(batch.column("text"), CHUNK):
                rows = [row(rules, d, s) for d, s in zip(ids[i:j], spans(*made.value, len(rules), data, off), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return map_arrow(docs, f, schema)


def _listed(rules: tuple[Rule, ...], found: list[Span]) -> str:
    return ",".join(f"{rules[i].kind}:{s}:{e}" for s, i, e in found)


def _digest(rules: tuple[Rule, ...], doc_id: int | None, found: list[Span]) -> tuple:
    base = [x for x in found if x[1] < len(BASE)]
    counts = [sum(1 for x in base if x[1] == i) for i in range(len(BASE))]
    return (doc_id, *counts, hashlib.sha256(_listed(rules, base).encode()).hexdigest(), _listed(rules, found))


def _spans(rules: tuple[Rule, ...], doc_id: int | None, found: list[Span]) -> tuple:
    return doc_id, [{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in found]


def found_in(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, spans (kind, start and end in code points, end exclusive)."""
    return _scan(docs, rules, _spans, SPANS_ARROW, f"doc_id long, spans {SPANS}")


def digest(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Per document: doc_id, counts and digest of the base spans, and all spans as one string."""
    return _scan(docs, BASE + more, _digest, DIGEST_ARROW, DIGEST)
