"""Quality by a linear-chain conditional random field over lines.

A text's lines are a chain.  Each line has features (shares of capitals, signs, digits and
white space, lengths of words and lines, words equal to those before them, a line equal to
the one before) and those of the lines before and after it.  The field labels every line
good or bad; forward-backward gives each line's probability of being good, and their mean,
weighted by length, is the document's evidence, which a logistic curve turns into a score.

Training: lines take the label of their document.  At most ``FIT_ROWS`` labelled rows are
used (half of each class, drawn by hash of doc_id), with their whole texts, as in scoring.  They
stay on the executors; limited-memory BFGS on the penalised likelihood asks them for the sum
of their gradients once a step.  The curve is set on the same rows so that the best cut lies
at ``CUT``.

Null and empty texts are one empty line.  Very long ones are read whole, one at a time, in blocks
of lines, the chain carried from block to block both ways; one line is a block at least, so a
line of many megabytes is held with about 60 bytes for each of its own.  In fitting, a text of
more than ``CHAIN_LINES`` lines is several chains.  A null doc_id is scored and not learned from; repeated
rows score alike; a score equal to the cut counts as good.  A column ``quality_score`` of the
input is replaced, other extra ones are kept.  Empty tables give no rows; with no labels, or
labels of one class, every score is that class's share (one half without any).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import labelled_sample, materialise, table

FIT_ROWS, ROUNDS, TOLERANCE, PENALTY, CUT = 6_000, 30, 2e-4, 1e-3, 0.7
BATCH_BYTES = 4_000_000
#: Lines of a batch; a longer text is alone, and read in blocks of so many.
BATCH_LINES = 50_000
#: Lines of a chain in fitting; a longer text is several.
CHAIN_LINES = 4_096
TEST_FOLD = (4, 2)

_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SIGN, _WIDE = range(7)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[128:] = _WIDE
for _c, _chars in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_SPACE, [*range(9, 14), 32]), (_STOP, map(ord, ".,;:'\"?-()"))):
    _CLASS[list(_chars)] = _c
_PLACE = np.random.Generator(np.random.PCG64(7)).integers(1 << 63, size=33, dtype=np.uint64) | np.uint64(1)
N_BASE = 14


@dataclass
class Before:
    """What a block of lines is told of the text before it: its last two words (hashes), how many
    of them there are, and the hash of its last line."""

    words: tuple[int, int] = (0, 0)
    n_words: int = 0
    line: int = 0


def _own_features(data: np.ndarray, head: np.ndarray, before: Before) -> tuple[np.ndarray, np.ndarray, Before]:
    """Features of the lines of ``data`` (each ended by a line feed) by themselves, their lengths, and
    what the next block is told.  ``head``: lines that begin a text; words and lines are compared
    within a text only."""
    stop = np.flatnonzero(data == 10)
    start = np.concatenate([[0], stop[:-1] + 1])
    cls = _CLASS[data]
    size = stop - start

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return (total[stop] - total[start]).astype(float)

    upper, lower, digit, space, points, sign, wide = (count(cls == k) for k in range(7))
    blank = cls == _SPACE
    first = ~blank
    first[1:] &= blank[:-1]
    at = np.flatnonzero(first)
    words = count(first)
    word_end = np.zeros(len(data), bool)
    word_end[:-1] = ~blank[:-1] & blank[1:]
    signed = count(word_end & ((cls == _SIGN) | (data == 33)))
    # hashes of words: equal to the word before, or the one before that
    place = np.arange(len(data), dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(data)]])))
    np.minimum(place, 32, out=place)
    letters_at = np.where(blank, np.uint8(0), data) * _PLACE[place]
    del place
    h = np.add.reduceat(letters_at, at) if len(at) else np.zeros(0, np.uint64)
    known = np.concatenate([np.array(before.words, np.uint64), h])
    alike, alike2 = h == known[1:-1], h == known[:-2]
    alike[: max(0, 1 - before.n_words)] = False
    alike2[: max(0, 2 - before.n_words)] = False
    opening = np.searchsorted(at, start[head])  # the first word of each text, or of a later one
    alike[opening[opening < len(at)]] = False
    alike2[opening[opening < len(at)]] = False
    alike2[opening[opening + 1 < len(at)] + 1] = False
    same, same2 = np.zeros(len(data), bool), np.zeros(len(data), bool)
    same[at], same2[at] = alike, alike2
    again, again2 = count(same), count(same2)
    cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
    lo, hi = np.searchsorted(at, start), np.searchsorted(at, stop)
    line_hash = cum[hi] - cum[lo]
    like = (line_hash == np.concatenate([np.array([before.line], np.uint64), line_hash[:-1]])) & (size > 0)
    like[head] = False
    n, w, letters = np.maximum(size, 1), np.maximum(words, 1), np.maximum(upper + lower + wide, 1)
    base = np.stack(
        [
            upper / letters, (upper / letters > 0.5).astype(float), np.sqrt(sign / n), np.minimum(1, 8 * sign / n), digit / n, space / n, np.minimum(1, 10 * points / n),
            signed / w, again / w, again2 / w, like, np.log1p(size) / 8, np.minimum(3, size / w / 8), (size == 0).astype(float),
        ],
        axis=1,
    )
    told = Before((int(known[-2]), int(known[-1])), min(2, before.n_words + len(h)), int(line_hash[-1]))
    return base, n.astype(float), told


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, their lengths in bytes, and lines of each text."""
    per_text = np.array([t.count(b"\n") + 1 for t in texts])
    edge = np.cumsum(per_text)
    base, n, _ = _own_features(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), edge - per_text, Before())
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[edge - per_text] = 0
    after[edge - 1] = 0
    return np.hstack([np.ones((len(base), 1)), base, before, after]), n, per_text


def line_blocks(text: bytes) -> Iterator[bytes]:
    """A text in runs of whole lines, each line ended by a line feed: of BATCH_LINES lines and of
    BATCH_BYTES at most, but for a line that is longer."""
    at = 0
    while at <= len(text):
        end, lines = at, 0
        part = text[at : at + BATCH_BYTES]
        stops = np.flatnonzero(np.frombuffer(part, np.uint8) == 10)
        lines = min(len(stops), BATCH_LINES)
        if lines:
            end = at + int(stops[lines - 1]) + 1
            yield text[at:end]
        else:
            end = text.find(b"\n", at) + 1 or len(text) + 1
            yield text[at : end - 1] + b"\n"
        at = end


def chain_marginals(node: np.ndarray, trans: np.ndarray, block: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray]]:
    """Marginals of one long chain, as :func:`forward_backward` gives them: bounds and the
    probabilities of the lines between, blocks of lines from last to first.

    Forward, each block leaves what it carries into the next; backward, a block's own sums are
    found again from what it was carried.  Within a block, runs of about its root step together:
    first the product of a run's 2 by 2 matrices, then what each run is carried, then its lines.
    """
    e = np.exp(trans - trans.max())

    def matrices(a: int, b: int) -> np.ndarray:
        z = np.clip(node[a:b], -30, 30)
        good = 1 / (1 + np.exp(-z))
        return e[None] * np.stack([1 / (1 + np.exp(z)), good], 1)[:, None, :]

    def runs_of(m: np.ndarray) -> np.ndarray:
        """(steps, runs, 2, 2): padded with the unit matrix at the end."""
        wide = max(1, int(np.sqrt(len(m))))
        steps = -(-len(m) // wide)
        whole = np.concatenate([m, np.broadcast_to(np.eye(2), (steps * wide - len(m), 2, 2))])
        return np.ascontiguousarray(whole.reshape(wide, steps, 2, 2).swapaxes(0, 1))

    def products(r: np.ndarray) -> np.ndarray:
        p = r[0]
        for m in r[1:]:
            p = p @ m
            p = p / p.sum((1, 2), keepdims=True)
        return p

    def carried(p: np.ndarray, v: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """What each run is carried, and what leaves the last."""
        out = np.empty((len(p), 2))
        for k in range(len(p) - 1, -1, -1) if back else range(len(p)):
            out[k] = v
            v = p[k] @ v if back else v @ p[k]
            v = v / v.sum()
        return out, v

    n = len(node)
    bounds = [(a, min(a + block, n)) for a in range(1, n, block)]  # the first line starts the chain
    start = 1 / (1 + np.exp(np.clip(np.array([node[0], -node[0]]), -30, 30)))
    v, starts = start, []
    for a, b in bounds:
        starts.append(v)
        _, v = carried(products(runs_of(matrices(a, b))), v, False)
    beta = np.ones(2)
    for (a, b), v in zip(reversed(bounds), reversed(starts), strict=True):
        r = runs_of(matrices(a, b))
        p = products(r)
        alphas, betas = np.empty(r.shape[:3]), np.empty(r.shape[:3])
        x, _ = carried(p, v, False)
        for t in range(len(r)):
            x = (x[:, None, :] @ r[t])[:, 0]
            x = x / x.sum(1, keepdims=True)
            alphas[t] = x
        y, beta = carried(p, beta, True)
        for t in range(len(r) - 1, -1, -1):
            betas[t] = y
            y = (r[t] @ y[:, :, None])[:, :, 0]
            y = y / y.sum(1, keepdims=True)
        both = (alphas * betas).swapaxes(0, 1).reshape(-1, 2)[: b - a]
        yield a, b, both[:, 1] / both.sum(1)
    both = start * beta
    yield 0, 1, both[1:] / both.sum()


def forward_backward(node: np.ndarray, per_text: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of all lines (label 1 is good), expected transitions and log partition sums.

    ``node``: log potentials of label 1 over label 0 of each line; chains lie one after
    another and step together, the longer ones longest.
    """
    n = len(per_text)
    order = np.argsort(-per_text, kind="stable")
    start = (np.cumsum(per_text) - per_text)[order]
    size = per_text[order]
    longest = int(size[0]) if n else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    e = np.exp(trans - trans.max())
    pot = np.stack([1 / (1 + np.exp(np.clip(node, -30, 30))), 1 / (1 + np.exp(np.clip(-node, -30, 30)))], 1)
    alpha, beta, scale = np.empty((len(node), 2)), np.ones((len(node), 2)), np.empty(len(node))
    for t in range(longest):
        i = start[: active[t]] + t
        a = pot[i] if t == 0 else (alpha[i - 1] @ e) * pot[i]
        scale[i] = a.sum(1)
        alpha[i] = a / scale[i, None]
    pair = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        i = start[: active[t]] + t
        nxt = pot[i] * beta[i] / scale[i, None]
        pair += e * (alpha[i - 1].T @ nxt)
        beta[i - 1] = nxt @ e.T
    both = alpha * beta
    logs = np.log(scale) + np.logaddexp(0, node)  # the chosen scale of potentials taken back
    logs[np.concatenate([[0], np.cumsum(per_text)[:-1]]) if n else []] -= trans.max()
    return both[:, 1] / both.sum(1), pair, logs + trans.max()


@dataclass
class Field:
    weights: np.ndarray
    trans: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def good_lines(self, x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return forward_backward(((x - self.mean) / self.spread) @ self.weights, per_text, self.trans)[0]

    def long_evidence(self, text: bytes) -> float:
        """Evidence of one text, read in blocks of lines: 16 bytes a line are held, and a block."""
        w = self.weights / self.spread
        own, left, right = w[1:].reshape(3, N_BASE)
        ground = w[0] - self.mean @ w
        lines = text.count(b"\n") + 1
        node, size = np.full(lines, ground), np.empty(lines)
        at, before = 0, Before()
        for block in line_blocks(text):
            base, n, before = _own_features(np.frombuffer(block, np.uint8), np.zeros(int(at == 0), int), before)
            end = at + len(base)
            node[at:end] += base @ own
            node[at + 1 : end + 1] += (base @ left)[: lines - at - 1]
            node[max(0, at - 1) : end - 1] += (base @ right)[int(at == 0) :]
            size[at:end] = n
            at = end
        return float(sum(p @ size[a:b] for a, b, p in chain_marginals(node, self.trans)) / size.sum())

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Evidence of texts together, or of one of any length."""
        if len(texts) == 1 and (len(texts[0]) > BATCH_BYTES or texts[0].count(b"\n") >= BATCH_LINES):
            return np.array([self.long_evidence(texts[0])])
        x, size, per_text = line_features(texts)
        p = self.good_lines(x, per_text)
        own = np.repeat(np.arange(len(texts)), per_text)
        return np.bincount(own, p * size, len(texts)) / np.bincount(own, size, len(texts))

    def score(self, texts: list[bytes]) -> np.ndarray:
        a, b = self.curve
        e = np.clip(self.evidence(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(a * np.log(e / (1 - e)) + b, -30, 30)))


def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of at most BATCH_BYTES and BATCH_LINES together; a longer text is alone."""
    at = 0
    while at < len(texts):
        end, size, lines = at, 0, 0
        while end < len(texts):
            size, lines = size + len(texts[end]), lines + texts[end].count(b"\n") + 1
            if end > at and (size > BATCH_BYTES or lines > BATCH_LINES):
                break
            end += 1
        yield at, end
        at = end


def _chains(text: bytes) -> Iterator[bytes]:
    """A text as chains of CHAIN_LINES lines at most."""
    at, n = 0, 0
    if text.count(b"\n") >= CHAIN_LINES:
        stops = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
        for n in stops[CHAIN_LINES - 1 :: CHAIN_LINES].tolist():
            yield text[at:n]
            at = n + 1
    yield text[at:]


def _labelled_lines(texts: Iterable[bytes], labels: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of whole texts of about BATCH_LINES lines: features, lengths of lines, lines of each
    chain, and each chain's label."""
    held: list[tuple[bytes, int]] = []
    lines = size = 0
    for t, y in ((chain, y) for t, y in zip(texts, labels, strict=True) for chain in _chains(t)):
        n = t.count(b"\n") + 1
        if held and (lines + n > BATCH_LINES or size + len(t) > BATCH_BYTES):
            yield *line_features([t for t, _ in held]), np.array([y for _, y in held])
            held, lines, size = [], 0, 0
        held.append((t, y))
        lines, size = lines + n, size + len(t)
    if held:
        yield *line_features([t for t, _ in held]), np.array([y for _, y in held])


Batch = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Of batches: something added up over them, as a vector.
Sum = Callable[[Callable[[Batch], np.ndarray]], np.ndarray]


def _moments(batch: Batch) -> np.ndarray:
    x = batch[0]
    return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])


def _gradient(batch: Batch, field: Field) -> np.ndarray:
    """Log-likelihood of the labels, and its gradient by weights and transitions."""
    x, _, per_text, labels = batch
    z, y = (x - field.mean) / field.spread, np.repeat(labels, per_text).astype(int)
    node = z @ field.weights
    p, pair, logs = forward_backward(node, per_text, field.trans)
    inside = np.ones(len(y), bool)
    inside[np.cumsum(per_text) - per_text] = False
    at = np.flatnonzero(inside)
    seen = np.bincount(2 * y[at - 1] + y[at], minlength=4).reshape(2, 2)
    told = (node * y).sum() + (seen * field.trans).sum() - logs.sum()
    return np.concatenate([[told], z.T @ (y - p), (seen - pair).ravel()])


def _climb(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """The least of a smooth convex function by limited-memory BFGS with backtracking."""
    f, g = value(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        if np.abs(g).max() < TOLERANCE:
            break
        d, used = -g, []
        for s, y in reversed(steps):
            a = s @ d / (s @ y)
            used.append(a)
            d = d - a * y
        if steps:
            s, y = steps[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(used), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        size = 1.0 if steps else 1 / max(1.0, float(np.abs(g).sum()))
        while True:
            f2, g2 = value(x + size * d)
            if f2 <= f + 1e-4 * size * (g @ d) or size < 1e-8:
                break
            size /= 2
        if f2 >= f:
            break
        if (g2 - g) @ d > 1e-12:
            steps = [*steps[-7:], (size * d, g2 - g)]
        x, f, g = x + size * d, f2, g2
    return x


def _trained(total: Sum) -> Field:
    """The field of greatest penalised likelihood, from sums over the labelled lines."""
    m = total(_moments)
    n, width = m[0], (len(m) - 1) // 2
    mean = m[1 : width + 1] / n
    spread = np.sqrt(np.maximum(0, m[width + 1 :] / n - mean**2))
    mean[0], spread[0] = 0, 1
    spread[spread < 1e-6] = 1
    field = Field(np.zeros(width), np.zeros((2, 2)), mean, spread)

    def put(x: np.ndarray) -> Field:
        return replace(field, weights=x[:width], trans=x[width:].reshape(2, 2))

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        own = put(x)
        g = total(lambda batch: _gradient(batch, own)) / n
        return float(PENALTY / 2 * (x @ x) - g[0]), PENALTY * x - g[1:]

    return put(_climb(value, np.zeros(width + 4)))


def _curved(field: Field, evidence: np.ndarray, labels: np.ndarray) -> Field:
    """With the curve that puts the best cut between good and bad evidence at CUT."""
    e = np.clip(evidence, 1e-6, 1 - 1e-6)
    odds = np.log(e / (1 - e))
    order = np.lexsort((labels, odds))
    s, good = odds[order], labels[order] == 1
    # the least balanced error with everything below the cut called bad
    wrong = np.concatenate([[0], np.cumsum(good)]) / good.sum() + (1 - np.concatenate([[0], np.cumsum(~good)]) / (~good).sum())
    k = int(np.median(np.flatnonzero(wrong == wrong.min())))
    cut = s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2
    slope = 1.0 / max(0.5, float(np.std(s)) / 2)
    return replace(field, curve=(slope, float(np.log(CUT / (1 - CUT)) - slope * cut)))


def fit(texts: list[bytes], labels: np.ndarray) -> Field | float:
    """A field from labelled texts at hand; only a share where there is one class or none."""
    if len(set(labels.tolist())) < 2:
        return float(labels.mean()) if len(labels) else 0.5
    field = _trained(lambda f: sum(f(b) for b in _labelled_lines(texts, labels.tolist())))
    return _curved(field, np.concatenate([field.evidence(texts[a:b]) for a, b in _batches(texts)]), labels)


def learn(docs: DataFrame, labels: DataFrame) -> Field | float:
    """Fit on at most FIT_ROWS rows of ``docs`` (doc_id, text) with ``labels`` (doc_id, quality).

    Texts and their lines stay on the executors: the driver gets sums of a task's batches, once a
    step, and two numbers a row for the curve."""
    rows = labelled_sample(docs, labels, "quality", FIT_ROWS).select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.col("quality").cast("int").alias("y"))
    rows = materialise(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "quality-texts")
    shares = rows.agg(F.count("*").alias("n"), F.avg("y").alias("good")).first()
    if not shares["n"] or shares["good"] in (0, 1):
        return float(shares["good"]) if shares["n"] else 0.5

    def total(f: Callable[[Batch], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for part in _labelled_lines((bytes(t.as_py()) for t in batch.column("text")), batch.column("y").to_pylist()):
                    out = f(part) if out is None else out + f(part)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["v"])

        parts = [np.array(r["v"]) for r in rows.mapInArrow(run, "v array<double>").collect()]  # one a task
        return sum(sorted(parts, key=lambda v: v.tolist()))  # in one order, so that reruns agree

    field = _trained(total)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [bytes(t.as_py()) for t in batch.column("text")]
            e = np.concatenate([np.empty(0), *(field.evidence(cells[a:b]) for a, b in _batches(cells))])
            yield pa.RecordBatch.from_arrays([pa.array(e), batch.column("y")], ["e", "y"])

    got = rows.mapInArrow(weigh, "e double, y int").collect()  # FIT_ROWS at most
    return _curved(field, np.array([r["e"] for r in got]), np.array([r["y"] for r in got]))


def score(docs: DataFrame, field: Field | float, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1); other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [(t or "").encode() for t in batch.column(text).to_pylist()]
            out = [np.full(b - a, field) if isinstance(field, float) else field.score(cells[a:b]) for a, b in _batches(cells)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.empty(0), *out]))], [*batch.schema.names, "quality_score"])

    docs = docs.drop("quality_score")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))


def held_out(of: int, left_out: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == left_out, F.lit(False))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(*TEST_FOLD))
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", held_out(*TEST_FOLD).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))
