"""Secret scans over a trigram inverted index.

1. :func:`trigram_query` derives from a rule's regular expression the Boolean query over trigrams that
   every match implies (after Cox, "Regular Expression Matching with a Trigram Index", 2012):
   strings a part can be are kept while few, their trigrams required once they grow.
2. A task indexes its texts in blocks: :func:`postings` maps each trigram that some rule needs to
   the rows that hold it, from the block's bytes in numpy.  Posting lists are intersected, shortest first,
   and united as the query says.  They are never shuffled: a text is verified where it was read.
3. Rules verify their candidates on whole texts.  A rule without a mandatory trigram (a run of hex digits)
   scans every text.

Matches of a rule are leftmost and do not overlap; those of different rules may.  Spans count code points, the
end exclusive, and stand by start, then by rule.  A null text counts as empty; a null or repeated doc_id is a row
like others; texts of any length are read whole, in windows of ``WINDOW`` bytes for the index; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from re import _constants as op
from re import _parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

BLOCK_BYTES, WINDOW = 4 << 20, 1 << 20
#: A part that can be more strings than this is known by its trigrams only.
MOST_STRINGS = 16
ANY = True


class Rule(NamedTuple):
    """Matches of ``pattern`` count where ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Letters of key words in either case, ASCII ones only.
_KEYS = "password|passwd|secret|token|api_?key"
_EITHER = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", _KEYS)
BASE = (
    Rule("assign", f"({_EITHER})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}"),  # the runs of 32 and more among those of any length
)
#: Tokens of known shape that the base rules leave out.
ADDED = (
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "[rs]k_(live|test)_[0-9A-Za-z]{16,}"),
    Rule("jwt", "\\beyJ[A-Za-z0-9_]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
    Rule("private", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


# -- Boolean queries ----------------------------------------------------------------------


def _and(*qs):
    flat = frozenset(x for q in qs if q is not ANY for x in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q]))
    return ANY if not flat else next(iter(flat)) if len(flat) == 1 else ("and", flat)


def _or(*qs):
    if not qs or any(q is ANY for q in qs):
        return ANY
    flat = frozenset(x for q in qs for x in (q[1] if isinstance(q, tuple) and q[0] == "or" else [q]))
    return next(iter(flat)) if len(flat) == 1 else ("or", flat)


def _of_strings(strings) -> object:
    """What holding one of the strings implies."""
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


class _Part(NamedTuple):
    """What is known of the strings a part matches: all of them, or how they begin and end, and a query."""

    exact: frozenset | None
    prefix: frozenset = frozenset([b""])
    suffix: frozenset = frozenset([b""])
    query: object = ANY

    def loose(self) -> _Part:
        """The part by its ends and its trigrams."""
        if self.exact is None:
            return self
        return _Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact), _and(self.query, _of_strings(self.exact)))

    def bounded(self) -> _Part:
        out = self if self.exact is None or len(self.exact) <= MOST_STRINGS else self.loose()
        few = lambda s: s if len(s) <= MOST_STRINGS else frozenset([b""])
        return out if out.exact is not None else _Part(None, few(out.prefix), few(out.suffix), out.query)


def _cross(a, b) -> frozenset:
    return frozenset(x + y for x in a for y in b)


def _concat(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None:
        return _Part(_cross(a.exact, b.exact), query=_and(a.query, b.query)).bounded()
    meet = _of_strings(_cross(a.exact if a.exact is not None else a.suffix, b.exact if b.exact is not None else b.prefix))
    # where one side is known whole, the ends reach over it
    prefix = _cross(a.exact, b.prefix) if a.exact is not None else a.prefix
    suffix = _cross(a.suffix, b.exact) if b.exact is not None else b.suffix
    return _Part(None, frozenset(s[:2] if len(s) > 8 else s for s in prefix), frozenset(s[-2:] if len(s) > 8 else s for s in suffix), _and(a.query, b.query, meet)).bounded()


def _union(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        return _Part(frozenset().union(*(p.exact for p in parts)), query=_or(*(p.query for p in parts))).bounded()
    loose = [p.loose() for p in parts]
    return _Part(None, frozenset().union(*(p.prefix for p in loose)), frozenset().union(*(p.suffix for p in loose)), _or(*(p.query for p in loose))).bounded()


_EMPTY, _UNKNOWN = _Part(frozenset([b""])), _Part(None)


def _chars(items) -> _Part:
    if any(kind not in (op.LITERAL, op.RANGE) for kind, _ in items):
        return _UNKNOWN
    codes = [c for kind, v in items for c in ([v] if kind is op.LITERAL else range(v[0], min(v[1], v[0] + 256) + 1))]
    chars = frozenset(folded(chr(c).encode()) for c in codes)
    return _Part(chars) if len(chars) <= MOST_STRINGS else _UNKNOWN


def _part(kind, value) -> _Part:
    if kind is op.LITERAL:
        return _Part(frozenset([folded(chr(value).encode())]))
    if kind is op.IN:
        return _chars(value)
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        return _union([_sequence(b) for b in value[1]])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, inner = value[0], value[1], _sequence(value[2])
        if (low, high) == (0, 1):
            return _union([_EMPTY, inner])
        if not low:
            return _UNKNOWN
        out = _EMPTY
        for _ in range(min(low, 4)):
            out = _concat(out, inner)
        return out if low == high <= 4 else _concat(out, _UNKNOWN)
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return _EMPTY
    return _UNKNOWN  # any character, negated literals, references


def _sequence(tokens) -> _Part:
    out = _EMPTY
    for kind, value in tokens:
        out = _concat(out, _part(kind, value))
    return out


def folded(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


@cache
def trigram_query(pattern: str):
    """The query over folded trigrams (bytes) that a match implies: a trigram, ("and" | "or", parts) or ``ANY``."""
    return _sequence(parser.parse(pattern, re.ASCII)).loose().query


def trigrams_of(query) -> set[bytes]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_of(q) for q in query[1]))


# -- the index of a block -----------------------------------------------------------------

_FOLD = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def code_of(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


@cache
def _wanted(trigrams: frozenset) -> np.ndarray:
    flags = np.zeros(1 << 24, bool)
    flags[[code_of(t) for t in trigrams]] = True
    return flags


def postings(data: np.ndarray, offsets: np.ndarray, trigrams: frozenset) -> dict[bytes, np.ndarray]:
    """Rows (ascending) that hold each of the trigrams; row i is ``data[offsets[i]:offsets[i + 1]]``."""
    flags, found = _wanted(trigrams), []
    for lo in range(int(offsets[0]), int(offsets[-1]), WINDOW):
        b = _FOLD[data[lo : min(lo + WINDOW + 2, int(offsets[-1]))]].astype(np.uint32)
        if len(b) < 3:
            continue
        code = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        at = np.flatnonzero(flags[code])
        row = np.searchsorted(offsets, at + lo, "right") - 1
        within = at + lo + 3 <= offsets[row + 1]
        found.append(np.unique(code[at[within]].astype(np.int64) << 32 | row[within]))
    keys = np.unique(np.concatenate([*found, np.empty(0, np.int64)]))
    codes, rows = keys >> 32, keys & 0xFFFFFFFF
    cut = {t: np.searchsorted(codes, [code_of(t), code_of(t) + 1]) for t in trigrams}
    return {t: rows[i:j] for t, (i, j) in cut.items()}


def candidates(query, index: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Rows of a block of ``n`` that a query leaves."""
    if query is ANY:
        return np.arange(n)
    if isinstance(query, bytes):
        return index[query]
    lists = sorted((candidates(q, index, n) for q in query[1]), key=len)
    if query[0] == "or":
        return np.unique(np.concatenate(lists))
    out = lists[0]
    for rows in lists[1:]:
        out = out[np.isin(out, rows, assume_unique=True)] if len(out) else out
    return out


# -- the scan -----------------------------------------------------------------------------


def spans_of(rule: Rule, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.compile(rule.pattern, re.ASCII).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows in runs of about ``BLOCK_BYTES``; a longer text is a block of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def find(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text: str = "text") -> DataFrame:
    """(doc_id, spans): spans (kind, start, end) of all rules in each row's text."""
    queries = [trigram_query(r.pattern) for r in rules]
    needed = frozenset().union(*(trigrams_of(q) for q in queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("text").cast(pa.large_string())
            _, ends, raw = col.buffers()
            offsets = np.frombuffer(ends, np.int64, len(col) + 1, col.offset * 8)
            data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
            for i, j in _blocks(offsets):
                index = postings(data, offsets[i : j + 1], needed)
                texts, out = col.slice(i, j - i).to_pylist(), [[] for _ in range(j - i)]
                for place, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    for row in candidates(query, index, j - i).tolist():
                        out[row] += [(start, place, end) for start, end in spans_of(rule, texts[row])]
                spans = [[{"kind": rules[p].kind, "start": s, "end": e} for s, p, e in sorted(x)] for x in out]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(spans, kind)], ["doc_id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return whole.mapInArrow(run, "doc_id bigint, spans array<struct<kind string, start bigint, end bigint>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(of(*(r.kind for r in BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _rule_sql(place: int, rule: Rule) -> str:
    """(k, kind, doc, s, e) of a rule: positions from the lengths of matches and of what lies between."""
    p = rule.pattern.replace("'", "''")
    cut = f"SELECT doc, t, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {rule.group}) AS v, string_split_regex(t, '{p}') AS b FROM d"
    each = f"SELECT doc, unnest(range(1, len(m) + 1)) AS i, m, v, b FROM ({cut})"
    at = "list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT"
    return f"SELECT {place} AS k, '{rule.kind}' AS kind, doc, {at} AS s, {at} + length(m[i]) AS e FROM ({each}) WHERE length(v[i]) >= {rule.least}"


OP13_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS doc FROM documents),
s AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(BASE + ADDED))}),
g AS (SELECT doc, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM s GROUP BY doc)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc = d.doc
"""
