"""Prefix trie of conversations, family first.

A family is the conversations around one base id (``conv_id - conv_id % 100``); each is rebuilt from
the first turns of the base and its own later ones, so families share much within and little
with each other.

1. Turns become digests of role and text with the text's length; texts go no further.  They are numbered
   over ranges of (conv_id, turn), so that one conversation may be many tasks.
2. A family's own turns are cogrouped with the first turns of its base, in pieces of ``PIECE`` turns of
   each conversation: at most 199 conversations (around 0) of ``PIECE`` + 5 turns, whatever is hot.
   The rebuilt family is one packed row.
3. A node is the 128-bit sum of SHA-256 digests of (depth, turn) over its prefix; sums of pieces are
   joined to the later ones of their conversation by a window over pieces.
4. Each family builds its trie and only its nodes, summed up, are shuffled.  Nodes that more than one
   piece holds go back to these with their global counts and smallest member.
5. Every node and leaf has an owner, its smallest member.  What a subtree sums up is then a sum
   over members of what they own from there on: one pass over families and one more sum by node,
   however deep the trie is.
6. The ids that end at a node come as one sorted list a family and are hashed in order of families as a
   stream, with one family in memory.  SHA-256 of one node's ids is sequential by definition.

Null roles and texts count as empty.  Turns stand by ``turn`` (null first), those alike in it by their
digest; repeated rows are turns of their own.  Rows without conv_id belong to no conversation and are
left out.  conv_id % 100 has the sign of conv_id.  Texts of any length are hashed whole, further
columns are ignored, and an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .merkle import crc32_sql
from .shared import materialise, ranked, spread_join, table

FAMILY, MOST_BORROWED, PIECE = 100, 5, 1024
ROOT = bytes(16)

#: Arrays of a piece, packed: conversations (ascending), turns before and in the piece, whether more follow;
#: digests and code points of the turns.
FAMILIES = "base bigint, seg bigint, conv binary, first binary, size binary, more binary, elem binary, chars binary"
NODES = "node binary, depth bigint, n bigint, conv bigint, n_end bigint, base bigint, seg bigint"
PARTS = "node binary, depth bigint, conv bigint, parent bigint, n bigint, children bigint, leaves bigint, saved bigint"


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(conv_id.cast("string")) % (MOST_BORROWED + 1)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest of role and text, code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.substring(digest, 1, 16).alias("digest"), F.length(text).cast("bigint").alias("chars"))


def _pack(a: np.ndarray, kind: str = "<i8") -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def families(placed: DataFrame) -> DataFrame:
    """Numbered turns -> ``FAMILIES``, a row for each family and piece; written.

    The first turn of a piece is sent to the piece before it too, which so knows that more follow.
    """
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    t = placed.withColumn("base", base)
    own = t.withColumn("h", borrowed(F.col("conv_id"))).withColumn("seg", F.floor(F.col("idx") / PIECE))
    own = own.withColumn("seg", F.explode(F.when((F.col("idx") > 0) & (F.col("idx") % PIECE == 0), F.array("seg", F.col("seg") - 1)).otherwise(F.array("seg"))))
    head = t.where((F.col("conv_id") == F.col("base")) & (F.col("idx") < MOST_BORROWED)).select("base", "idx", "digest", "chars")
    later = own.where("seg > 0").select("base", "seg").distinct()
    head = head.withColumn("seg", F.lit(0).cast("bigint")).unionByName(head.join(later, "base"))
    head = head.select(*[F.col(c).alias(c) for c in head.columns])  # columns of its own, not those of ``own``

    def rebuild(own: pa.Table, head: pa.Table) -> pa.Table:
        if not own.num_rows:  # a base always has rows of its own in its first piece
            return pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.binary())] * 6, names)
        own, head = own.sort_by([("conv_id", "ascending"), ("idx", "ascending")]), head.sort_by("idx")
        base, seg = own.column("base")[0].as_py(), own.column("seg")[0].as_py()
        conv, idx, h, chars = (own.column(c).to_numpy() for c in ("conv_id", "idx", "h", "chars"))
        digest, head_digest, head_chars = own.column("digest").to_pylist(), head.column("digest").to_pylist(), head.column("chars").to_pylist()
        starts = np.append(0, np.flatnonzero(np.diff(conv)) + 1)
        first, size, more, elem, length = [], [], [], [], []
        for i, j in zip(starts.tolist(), np.append(starts[1:], len(conv)).tolist(), strict=True):
            follows = idx[j - 1] // PIECE > seg
            take = [k for k in range(i, j - follows) if idx[k] >= h[i]]
            lead = min(int(h[i]), len(head_digest))
            seq, n = [digest[k] for k in take], [int(chars[k]) for k in take]
            before = 0 if seg == 0 else seg * PIECE - int(h[i]) + lead
            if seg == 0:
                seq, n = head_digest[:lead] + seq, head_chars[:lead] + n
            first.append(before)
            size.append(len(seq))
            more.append(follows)
            length += n
            elem += [hashlib.sha256((before + d + 1).to_bytes(8, "little") + x).digest()[:16] for d, x in enumerate(seq)]
        row = [_pack(conv[starts]), _pack(np.array(first)), _pack(np.array(size)), _pack(np.array(more), "u1"), b"".join(elem), _pack(np.array(length))]
        return pa.table([pa.array([base], pa.int64()), pa.array([seg], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names)

    names = ["base", "seg", "conv", "first", "size", "more", "elem", "chars"]
    both = own.groupBy("base", "seg").cogroup(head.groupBy("base", "seg"))
    return materialise(both.applyInArrow(rebuild, FAMILIES), "trie-families")


class Piece:
    """A family's piece unpacked: places in the trie of its turns, conversation by conversation."""

    def __init__(self, row: dict):
        self.base, self.seg = row["base"], row["seg"]
        self.conv, self.first, self.size, self.chars = (np.frombuffer(row[c], "<i8") for c in ("conv", "first", "size", "chars"))
        self.more = np.frombuffer(row["more"], "u1").astype(bool)
        m = len(self.conv)
        self.member = np.repeat(np.arange(m), self.size)  # of each turn
        self.begin = np.cumsum(self.size) - self.size
        self.depth = self.first[self.member] + np.arange(len(self.member)) - self.begin[self.member] + 1
        total = np.zeros((len(self.member) + 1, 2), np.uint64)
        np.cumsum(np.frombuffer(row["elem"], "<u8").reshape(-1, 2), axis=0, out=total[1:])
        self.sums = total[self.begin + self.size] - total[self.begin]  # of each piece, modulo 2^64
        self.start = np.frombuffer(row["start"], "<u8").reshape(m, 2) if row.get("start") else np.zeros((m, 2), np.uint64)
        key = total[1:] - total[self.begin][self.member] + self.start[self.member]
        key = np.concatenate([self.start, key])  # the nodes pieces start at, then those of the turns
        uniq, self.at = np.unique(key, axis=0, return_inverse=True)
        self.at = self.at.ravel()
        self.nodes = [x.tobytes() for x in np.ascontiguousarray(uniq, "<u8")]
        self.turn_at, self.start_at = self.at[m:], self.at[:m]
        last = np.append(self.start_at, self.turn_at)[np.where(self.size > 0, m + self.begin + self.size - 1, np.arange(m))]
        self.end_at = np.where(self.more, -1, last)  # the node where a conversation ends in this piece
        up = np.arange(len(self.member)) - 1
        self.parent_at = np.where(up + 1 == self.begin[self.member], self.start_at[self.member], self.turn_at[up]) if len(up) else self.turn_at

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Node and member of every place that counts: all turns, and the root, once a conversation."""
        if self.seg:
            return self.turn_at, self.member
        return np.concatenate([self.start_at, self.turn_at]), np.concatenate([np.arange(len(self.conv)), self.member])

    def node_values(self) -> tuple[np.ndarray, ...]:
        """Depth, members, smallest member and ends of each node, as far as this piece counts them."""
        k = len(self.nodes)
        at, who = self.counted()
        depth, conv = np.zeros(k, np.int64), np.full(k, np.iinfo(np.int64).max)
        depth[self.start_at], depth[self.turn_at] = self.first, self.depth
        np.minimum.at(conv, at, self.conv[who])
        ends = self.end_at[self.end_at >= 0]
        return depth, np.bincount(at, minlength=k), conv, np.bincount(ends, minlength=k)


def _rows(values: list, schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "string": pa.string()}
    names = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, names, strict=True)], [n for n, _ in names])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def family_nodes(packed: DataFrame) -> DataFrame:
    """``NODES``: what each piece counts at its nodes (those it only starts at count nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            p = Piece(row)
            depth, n, conv, ends = p.node_values()
            yield _rows([p.nodes, depth, n, np.where(n > 0, conv, 0), ends, [p.base] * len(depth), [p.seg] * len(depth)], NODES)

    return packed.mapInArrow(run, NODES)


def _along(pieces: DataFrame, values: list[str], back: bool) -> DataFrame:
    """(base, seg, conv, values...) with each value summed over the conversation's pieces before (or after)."""
    w = Window.partitionBy("conv").orderBy(F.desc("seg") if back else F.asc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("base", "seg", "conv", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(v) for v in values])


def _packed_back(packed: DataFrame, pieces: DataFrame, column: str, values: list[str], modulo: bool) -> DataFrame:
    """``packed`` with ``column``: the values of its conversations, in their order, as 64-bit numbers."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("conv")
        v = np.array([t.column(c).to_numpy() for c in values])
        if modulo:  # four 32-bit limbs of two numbers
            v = v.astype(np.uint64)
            v = np.array([v[0] + (v[1] << np.uint64(32)), v[2] + (v[3] << np.uint64(32))])
        return pa.table([t.column("base").slice(0, 1), t.column("seg").slice(0, 1), pa.array([np.ascontiguousarray(v.T).tobytes()], pa.binary())], ["base", "seg", column])

    back = pieces.groupBy("base", "seg").applyInArrow(pack, f"base bigint, seg bigint, {column} binary")
    return packed.join(back, ["base", "seg"], "left")


def with_starts(packed: DataFrame, long: DataFrame) -> DataFrame:
    """Packed families with the sums that their pieces start from (``long``: bases with several pieces)."""
    schema = "base bigint, seg bigint, conv bigint, a bigint, b bigint, c bigint, d bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            p = Piece(row)
            low = np.uint64(0xFFFFFFFF)
            limbs = [(p.sums[:, i // 2] >> np.uint64(32 * (i % 2)) & low).astype(np.int64) for i in range(4)]
            yield _rows([[p.base] * len(p.conv), [p.seg] * len(p.conv), p.conv, *limbs], schema)

    limbs = ["a", "b", "c", "d"]
    return _packed_back(packed, _along(packed.join(long, "base", "left_semi").mapInArrow(run, schema), limbs, False), "start", limbs, True)


def _owned(p: Piece, row: dict) -> tuple[np.ndarray, ...]:
    """Global smallest member of each node, and what each turn's conversation owns there: the node, its
    spared code points, and whether the conversation owns the leaf it ends at."""
    _, n, conv, ends = (x.copy() for x in p.node_values())
    if row["shared"] is not None:
        place = {x: i for i, x in enumerate(p.nodes)}
        for s in row["shared"]:
            i = place[s["node"]]
            n[i], conv[i], ends[i] = s["n"], s["conv"], s["n_end"]
    owns = conv[p.turn_at] == p.conv[p.member]
    spared = owns * (n[p.turn_at] - 1) * p.chars
    end = p.end_at
    flag = (end >= 0) & (conv[end] == p.conv) & (ends[end] == n[end])
    return conv, owns, spared, flag


def long_totals(met: DataFrame) -> DataFrame:
    """(base, seg, conv, spared, leaf) of each conversation's pieces."""
    schema = "base bigint, seg bigint, conv bigint, spared bigint, leaf bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            p = Piece(row)
            _, _, spared, flag = _owned(p, row)
            total = np.append(0, np.cumsum(spared))
            yield _rows([[p.base] * len(p.conv), [p.seg] * len(p.conv), p.conv, total[p.begin + p.size] - total[p.begin], flag.astype(np.int64)], schema)

    return met.mapInArrow(run, schema)


def family_parts(met: DataFrame) -> DataFrame:
    """``PARTS``: what each piece adds to its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            p = Piece(row)
            k = len(p.nodes)
            conv, owns, spared, flag = _owned(p, row)
            depth, n, _, _ = p.node_values()
            later = np.frombuffer(row["later"], "<i8").reshape(-1, 2) if row.get("later") else np.zeros((len(p.conv), 2), np.int64)
            total = np.append(0, np.cumsum(spared))
            end = total[p.begin + p.size]  # of each piece
            from_turn = end[p.member] - total[:-1] + later[p.member, 0]
            from_start = end - total[p.begin] + later[:, 0]
            at, who = p.counted()
            here = from_turn if p.seg else np.concatenate([from_start, from_turn])
            leaves, saved, children = (np.zeros(k, np.int64) for _ in range(3))
            np.add.at(saved, at, here)
            np.add.at(leaves, at, (flag + later[:, 1])[who])
            np.add.at(children, p.parent_at, owns)
            parent = np.full(k, np.iinfo(np.int64).min)
            parent[p.turn_at] = conv[p.parent_at]
            counted = n > 0
            yield _rows([p.nodes, depth, pa.array(conv, mask=~counted), pa.array(parent, mask=(depth == 0) | ~counted), n, children, leaves, saved], PARTS)

    return met.mapInArrow(run, PARTS)


def end_lists(packed: DataFrame) -> DataFrame:
    """(node, base, ids): conversations of a family that end at a node, ascending."""
    schema = "node binary, base bigint, ids array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            p = Piece(row)
            own = np.flatnonzero(p.end_at >= 0)
            own = own[np.argsort(p.end_at[own], kind="stable")]
            cut = np.append(0, np.flatnonzero(np.diff(p.end_at[own])) + 1) if len(own) else own
            ids = np.split(p.conv[own], cut[1:]) if len(own) else []
            yield _rows([[p.nodes[p.end_at[own[i]]] for i in cut], [p.base] * len(cut), ids], schema)

    return packed.mapInArrow(run, schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of a node's ids in order, comma-joined.  Families are ranges of ids, so
    their lists follow each other; a family's lists from several pieces are merged."""
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, base, ids, h, first = None, None, [], None, True

        def flush() -> None:
            nonlocal first
            if ids:
                h.update((("" if first else ",") + ",".join(map(str, sorted(ids)))).encode())
                first = False

        for batch in batches:
            out = []
            for own, of, some in zip(*(batch.column(c).to_pylist() for c in ("node", "base", "ids")), strict=True):
                if own != node or of != base:
                    flush()
                    base, ids = of, []
                if own != node:
                    if node is not None:
                        out.append((node, h.hexdigest()))
                    node, h, first = own, hashlib.sha256(), True
                ids += some
            yield _rows([[x for x, _ in out], [x for _, x in out]], "node binary, ends_sha256 string")
        if node is not None:
            flush()
            yield _rows([[node], [h.hexdigest()]], "node binary, ends_sha256 string")

    return ends.repartition(tasks, "node").sortWithinPartitions("node", "base").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    packed = families(ranked(turns(conversations), "conv_id", ["turn", "digest"], "trie-turns"))
    long = materialise(packed.where("seg > 0").select("base").distinct(), "trie-long")
    several = not long.isEmpty()
    if several:
        packed = materialise(with_starts(packed, long), "trie-families")
    nodes = materialise(family_nodes(packed), "trie-nodes")
    n = F.count("*").alias("pieces")
    shared = nodes.groupBy("node").agg(F.sum("n").alias("n"), F.min(F.when(F.col("n") > 0, F.col("conv"))).alias("conv"), F.sum("n_end").alias("n_end"), n).where("pieces > 1")
    shared = materialise(shared.select("node", F.struct("node", "n", "conv", "n_end").alias("shared"), "pieces"), "trie-shared")
    asked = spread_join(nodes.select("node", "base", "seg"), shared, "node", "pieces").where("shared is not null")
    # a piece's nodes at most
    replies = asked.groupBy("base", "seg").agg(F.collect_list("shared").alias("shared"))
    met = packed.join(replies, ["base", "seg"], "left")
    if several:
        met = materialise(met, "trie-met")
        totals = ["spared", "leaf"]
        met = _packed_back(met, _along(long_totals(met.join(long, "base", "left_semi")), totals, True), "later", totals, False)
    whole = family_parts(met).groupBy("node").agg(
        F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent_conv_id"), F.sum("n").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    ends = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return whole.join(end_digests(end_lists(packed)), "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = f"""
WITH t AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {crc32_sql("conv_id::VARCHAR")} % {MOST_BORROWED + 1} AS h, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS say,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, base, h FROM t),
rows_of AS (SELECT c.conv_id, 0 AS part, b.pos, b.say FROM c JOIN t b ON b.conv_id = c.base AND b.pos <= c.h UNION ALL SELECT conv_id, 1, pos, say FROM t WHERE pos > h),
r AS (SELECT conv_id, say, row_number() OVER w AS d, list(say) OVER w AS pre FROM rows_of WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
p AS (SELECT conv_id, d, pre, length(say.t) AS chars FROM r UNION ALL SELECT conv_id, 0, []::STRUCT(r VARCHAR, t VARCHAR)[], 0 FROM c),
deep AS (SELECT conv_id, max(d) AS last FROM p GROUP BY 1),
n AS (SELECT p.d, p.pre, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.chars) AS chars,
  sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE deep.last = p.d), '')) AS ends_sha256 FROM p JOIN deep USING (conv_id) GROUP BY p.d, p.pre),
k AS (SELECT d - 1 AS d, pre[:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, u.conv_id AS parent_conv_id FROM n LEFT JOIN k ON k.d = n.d AND k.pre = n.pre LEFT JOIN n u ON u.d = n.d - 1 AND u.pre = n.pre[:n.d - 1]),
own AS (SELECT p.conv_id, p.d, p.pre, m.conv_id = p.conv_id AND m.n_children = 0 AS leaf, CASE WHEN m.conv_id = p.conv_id THEN (m.n_convs - 1) * m.chars ELSE 0 END AS val FROM p JOIN m ON m.d = p.d AND m.pre = p.pre),
s AS (SELECT d, pre, sum(val) OVER w AS saved, sum(leaf::INT) OVER w AS leaves FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY d DESC)),
g AS (SELECT d, pre, sum(saved) AS saved, sum(leaves) AS leaves FROM s GROUP BY 1, 2)
SELECT m.conv_id, m.d AS depth, m.parent_conv_id, m.n_convs, m.n_children, g.leaves::BIGINT AS n_leaves, g.saved::BIGINT AS saved_tokens, m.ends_sha256 FROM m JOIN g ON g.d = m.d AND g.pre = m.pre
"""
