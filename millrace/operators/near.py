"""Links between alike rows, found where they share a key and given as spanning forests.

:func:`links` compares the rows of each key in numpy, in one sorted pass.  Keys with more than a block
of rows are cut into blocks in a second pass, blocks are compared two by two, and every
comparison gives a spanning forest of the links it finds, never all pairs.

Two uses: signatures that differ in few bits (:func:`linked`), filed by deletion variants, and
token sets with many tokens in common (:func:`linked_sets`), filed by their rarest tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import materialise

BLOCK = 512
#: Tokens counted at once when sets are compared, and when pairs of them are.
STRIP, MOST_TOKENS = 4096, 1 << 20
#: Keys with up to so many rows are compared pair by pair, many keys at once.
SMALL = 16

#: Which rows of a table are linked: a symmetric matrix.
Near = Callable[[pa.Table], np.ndarray]
#: Which of the pairs (i, j) of a batch's rows are, or how like they are (0: no link).
Pairs = Callable[[pa.RecordBatch | pa.Table, np.ndarray, np.ndarray], np.ndarray]


def variant_keys(signature: Column, distance: int) -> Column:
    """Keys of a signature: hashes of a bit's place and its segment without it (equal keys are verified).

    A signature is cut into segments so few that of two within the distance one segment differs in
    at most one bit; each segment is filed once for each of its bits left out.
    """
    parts = distance // 2 + 1  # of ``distance`` bits over so many parts one has at most one
    cuts = [64 * i // parts for i in range(parts + 1)]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        segment = F.shiftrightunsigned(signature, lo)
        out += [F.xxhash64(F.lit(bit), segment.bitwiseAND(F.lit(((1 << (hi - lo)) - 1) & ~(1 << (bit - lo))))) for bit in range(lo, hi)]
    return F.array(*out)


def _forest(node: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the first node of each group that ``near`` (symmetric) connects."""
    free, a, b = np.ones(len(node), bool), [], []
    for i in range(len(node)):
        if free[i]:
            free[i] = False
            front = np.array([i])
            while len(front):
                front = np.flatnonzero(near[front].any(0) & free)
                free[front] = False
                a.append(node[front])
                b.append(np.full(len(front), node[i]))
    return np.concatenate([*a, node[:0]]), np.concatenate([*b, node[:0]])


def _linked(t: pa.Table, near: Near) -> np.ndarray:
    linked = near(t)
    if "part" in t.column_names:  # two blocks of a hot key; within a block its rows are compared elsewhere
        part = t.column("part").to_numpy()
        if part[0] != t.column("other")[0].as_py():
            linked = linked & (part[:, None] != part[None, :])
    return linked


def _edges(t: pa.Table, near: Near, pairs: Pairs | None = None) -> tuple[np.ndarray, ...]:
    """A spanning forest of a table's links; with ``pairs`` all of them, and how like they are."""
    linked, node = _linked(t, near), t.column("node").to_numpy()
    if pairs:
        i, j = np.nonzero(np.triu(linked, 1))
        return _scored(node, i, j, pairs(t, i, j))
    a, b = _forest(node, linked)
    return a[a != b], b[a != b]


def _scored(node: np.ndarray, i: np.ndarray, j: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, ...]:
    i, j, like = i[like > 0], j[like > 0], like[like > 0].astype(np.float64)
    return np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), like


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the runs of equal keys, and which of them are small and end within the batch."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    small = np.diff(edge) <= SMALL
    small[[0, -1]] = False
    return edge, small


def _small_edges(batch: pa.RecordBatch, key: str, pairs: Pairs) -> tuple[np.ndarray, ...]:
    """Links within the small runs of a sorted batch, and how like their ends are."""
    edge, small = _runs(batch.column(key).to_numpy())
    size, node = np.diff(edge), batch.column("node").to_numpy()
    run, small = np.repeat(np.arange(len(size)), size), np.repeat(small, size)
    both = [(at, at + k) for k in range(1, SMALL) for at in [np.flatnonzero(small[:-k] & (run[:-k] == run[k:]))]]
    i, j = (np.concatenate(x) for x in zip(*both, strict=True))
    i, j = i[node[i] != node[j]], j[node[i] != node[j]]
    return _scored(node, i, j, pairs(batch, i, j) if len(i) else np.zeros(0))


def _groups(batches: Iterator[pa.RecordBatch], key: str, most: int, small_too: bool = True) -> Iterator[tuple[int, int, pa.Table | None]]:
    """(key, rows, table) of runs of equal keys in sorted batches, of two rows and more; a run over
    ``most`` rows is counted only.  ``small_too``: also those :func:`_small_edges` compares."""
    own, held, size = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        edge, skip = _runs(k)
        skip &= (np.diff(edge) < 2) | (not small_too)
        for i, j in zip(edge[:-1][~skip].tolist(), edge[1:][~skip].tolist(), strict=True):
            if k[i] != own:
                if size > 1:
                    yield own, size, pa.Table.from_batches(held) if held else None
                own, held, size = k[i], [], 0
            size += j - i
            held = [*held, batch.slice(i, j - i)] if size <= most else []
    if size > 1:
        yield own, size, pa.Table.from_batches(held) if held else None


def _fresh_near(near: Near) -> Near:
    def masked(t: pa.Table) -> np.ndarray:
        old = ~np.asarray(t.column("fresh").to_numpy(), bool)
        return near(t) & ~(old[:, None] & old[None, :])

    return masked


def _fresh_pairs(pairs: Pairs) -> Pairs:
    def masked(t: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        fresh = np.asarray(t.column("fresh").to_numpy(zero_copy_only=False), bool)
        return pairs(t, i, j) & (fresh[i] | fresh[j])

    return masked


def links(keyed: DataFrame, near: Near, pairs: Pairs, block: int | None = None, every: bool = False) -> DataFrame:
    """(key long, node long, more columns; distinct rows) -> edges (a, b) that span what ``near``, and
    ``pairs`` alike, links among the rows of each key.

    With a boolean column ``fresh`` only links with a fresh row are sought: keys without one are left
    out before the shuffle.  ``every``: all links instead, as (a, b, jaccard), a < b, with what ``pairs`` gives.
    """
    block = block or BLOCK
    if "fresh" in keyed.columns:
        keyed, near, pairs = keyed.join(keyed.where("fresh").select("key").distinct(), "key", "left_semi"), _fresh_near(near), _fresh_pairs(pairs)
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {"a": pa.int64(), "b": pa.int64(), "jaccard": pa.float64()} if every else {"a": pa.int64(), "b": pa.int64()}
    told = "a bigint, b bigint" + ", jaccard double" * every
    schema = pa.schema([*kinds.items(), ("hot", pa.int64()), ("n", pa.int64())])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(*found: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(found[0]), pa.int64())
            return pa.RecordBatch.from_arrays([*map(pa.array, found[: len(kinds)]), none, none], schema=schema)

        found: list[tuple[np.ndarray, ...]] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    found.append(_small_edges(batch, "key", pairs))
                yield batch

        for key, n, t in _groups(watched(), "key", block, False):
            yield from (out(*found.pop()) for _ in range(len(found)))
            yield pa.RecordBatch.from_pylist([{"hot": int(key), "n": n}], schema) if t is None else out(*_edges(t, near, pairs if every else None))
        yield from (out(*f) for f in found)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, t in _groups(batches, "tile", 1 << 31):  # two blocks, of about a size by hash
            yield pa.RecordBatch.from_arrays([*map(pa.array, _edges(t, near, pairs if every else None))], list(kinds))

    by_key = keyed.repartition(tasks, "key").sortWithinPartitions("key")
    found = materialise(by_key.mapInArrow(once, f"{told}, hot bigint, n bigint"), "links")
    edges, hot = found.where("hot is null").select(*kinds), found.where("hot is not null").select(F.col("hot").alias("key"), "n")
    if hot.isEmpty():
        return edges
    met = keyed.join(hot, "key").withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("part", F.pmod(F.xxhash64(*keyed.columns), F.col("blocks")))
    met = met.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    met = met.withColumn("tile", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).drop("blocks", "n", "key")
    return edges.unionByName(met.repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(tile, told))


def _fresh(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c == "fresh"]


def linked(rows: DataFrame, by: list[str], distance: int, block: int | None = None) -> DataFrame:
    """(``by``..., node, sig; perhaps fresh) -> edges (a, b) that span the links of nodes alike in ``by``
    whose signatures differ in at most ``distance`` bits."""

    def near(t: pa.Table) -> np.ndarray:
        own, s = t.column("own").to_numpy(), t.column("sig").to_numpy().view(np.uint64)
        return (np.bitwise_count(s[:, None] ^ s[None, :]) <= distance) & (own[:, None] == own[None, :])

    def pairs(t: pa.RecordBatch, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        own, s = t.column("own").to_numpy(), t.column("sig").to_numpy().view(np.uint64)
        return (np.bitwise_count(s[i] ^ s[j]) <= distance) & (own[i] == own[j])

    keyed = rows.select(F.xxhash64(*by).alias("own"), "node", "sig", *_fresh(rows), F.explode(variant_keys(F.col("sig"), distance)).alias("key"))
    return links(keyed.withColumn("key", F.xxhash64("own", "key")), near, pairs, block)


def _overlaps(tokens: pa.ListArray, rows: np.ndarray) -> np.ndarray:
    """How many tokens each two of ``rows`` share, counted by strips of tokens."""
    tokens = tokens.take(pa.array(rows))
    n = tokens.value_lengths().to_numpy(zero_copy_only=False)
    _, token = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
    row, order = np.repeat(np.arange(len(rows)), n), np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    out = np.zeros((len(rows), len(rows)), np.float32)
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, STRIP):
        i, j = np.searchsorted(token, [lo, lo + STRIP])
        m = np.zeros((len(rows), min(STRIP, int(token[-1]) + 1 - lo)), np.float32)
        m[row[i:j], token[i:j] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)  # exact: counts stay below 2^24


def _fits(at: tuple, n: tuple, threshold: float) -> np.ndarray:
    """Whether two sets, met by the first token they share, at ``at`` of their orders, can be close by what lengths and
    places (positional filter) say: no more can be shared than the lesser part from it on."""
    need = np.ceil(threshold / (1 + threshold) * (n[0] + n[1]) - 1e-9)
    return (np.minimum(n[0], n[1]) >= threshold * np.maximum(n[0], n[1]) - 1e-9) & (np.minimum(n[0] - at[0], n[1] - at[1]) >= need)


def similarity(t: pa.RecordBatch | pa.Table, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """The Jaccard similarity of the pairs (i, j) of rows where it is ``threshold`` or more and they met by the first
    token they share (so that of all keys one finds a pair), else 0."""
    tokens = t.column("tokens")
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    n, at = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), t.column("at").to_numpy()
    out = np.zeros(len(i))
    left = np.flatnonzero(_fits((at[i], at[j]), (n[i], n[j]), threshold))
    ends = np.cumsum(n[i[left]] + n[j[left]])
    for lo, hi in _strips(ends, MOST_TOKENS):
        own = left[lo:hi]  # tokens of both sides by pair: those that stand twice are shared
        sides, m = np.concatenate([i[own], j[own]]), len(own)
        pair, token = np.repeat(np.tile(np.arange(m), 2), n[sides]), tokens.take(pa.array(sides)).flatten().to_numpy()
        place = np.arange(len(token)) - np.repeat(np.cumsum(n[sides]) - n[sides], n[sides])
        order = np.lexsort((token, pair))  # stable: of two equal tokens the first side's comes first
        token, pair, place = token[order], pair[order], place[order]
        twice = np.flatnonzero((token[1:] == token[:-1]) & (pair[1:] == pair[:-1]))
        both, first = np.bincount(pair[twice], minlength=m), np.full(m, -1)
        some = np.flatnonzero(both)
        if len(some):
            first[some] = np.minimum.reduceat(place[twice], (np.cumsum(both) - both)[some])
        like = both / (n[i[own]] + n[j[own]] - both)
        out[own] = np.where((like >= threshold) & (first == at[i[own]]), like, 0)
    return out


def _strips(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of items of about ``most`` in all, one at least; ``ends``: their sizes summed up."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def close_sets(t: pa.Table, threshold: float) -> np.ndarray:
    """Which pairs of a table's rows are close; sets that fit with nobody are not counted."""
    tokens = t.column("tokens").combine_chunks()
    n, at = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), t.column("at").to_numpy()
    fits = _fits((at[:, None], at[None, :]), (n[:, None], n[None, :]), threshold)
    np.fill_diagonal(fits, False)
    rows = np.flatnonzero(fits.any(0))
    out = np.zeros_like(fits)
    if len(rows):
        both = _overlaps(tokens, rows)
        out[np.ix_(rows, rows)] = both / (n[rows][:, None] + n[rows][None, :] - both) >= threshold
    return out & fits


def by_rarity(sets: DataFrame, by: list[str]) -> DataFrame:
    """(``by``..., node, tokens) -> (node, ranked): a set's tokens, those first that the fewest sets alike in ``by`` hold;
    (n: how many, token: a 64-bit hash of ``by`` and the token)."""
    each = sets.select("node", F.xxhash64(*by).alias("own"), F.explode("tokens").alias("t")).select("node", F.xxhash64("own", "t").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    # a set's own tokens
    return each.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked"))


def filed(sets: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(``by``..., node, tokens: distinct strings; perhaps fresh) -> (node, tokens, at, key; perhaps fresh): sets under their
    rarest tokens (prefix filter), which are at ``at`` of ``tokens``.

    Of two close sets each has one of its rarest tokens (as many as may be missing, and one) in the other.
    Tokens that no other set has are no key.
    """
    fresh = _fresh(sets)
    t = by_rarity(sets, by)
    t = t.join(sets.select("node", *fresh), "node") if fresh else t
    prefix = F.size("ranked") - F.ceil(F.size("ranked") * F.lit(threshold) - 1e-9) + 1
    first = F.posexplode(F.slice("ranked", F.lit(1), prefix.cast("int"))).alias("at", "k")
    keyed = t.select("node", F.col("ranked.token").alias("tokens"), *fresh, first)
    return keyed.where("k.n > 1").select("node", "tokens", *fresh, "at", F.col("k.token").alias("key"))


def linked_sets(sets: DataFrame, by: list[str], threshold: float, block: int | None = None) -> DataFrame:
    """(``by``..., node, tokens: distinct strings; perhaps fresh) -> edges (a, b) that span the links of nodes alike in ``by``
    whose token sets have a Jaccard similarity of ``threshold`` or more.

    Sets alike should come as one node.  Tokens are told apart by 64-bit hashes.
    """
    return links(filed(sets, by, threshold), lambda g: close_sets(g, threshold), lambda g, i, j: similarity(g, i, j, threshold) > 0, block)


def close_pairs(sets: DataFrame, by: list[str], threshold: float, block: int | None = None) -> DataFrame:
    """The same, every such pair once: (a, b, jaccard), a < b.  Pairs are never shuffled."""
    return links(filed(sets, by, threshold), lambda g: close_sets(g, threshold), lambda g, i, j: similarity(g, i, j, threshold), block, every=True)
