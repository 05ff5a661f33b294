"""A Merkle manifest of a table by superblock reduction.

1. Each row becomes a leaf: the SHA-256 of its columns, each with its length.  Leaves are numbered
   within their group (language) by doc_id, over ranges of rows, not in one task a group.
2. Superblocks: indices are bucketed by fanout^k (8^3 = 512 leaves); a bucket is one task's
   small work (:func:`collapse` by ``applyInArrow``, which keeps null ids whole), and collapses k levels
   at once.  Bucket roots are leaves of the next round, so 10^11 rows take four rounds.  Subroots
   of the groups are reduced in the same way to the root.
3. Downwards a bucket meets the proof of its own root (one row a bucket, an equality join) and appends
   it to the lower proofs of its leaves, which it builds again from the leaves it holds.

A node over a run is the SHA-256 of the run's digests as hex text, joined; a last run may be
short, even of one.  A group of one leaf is that leaf.  A proof lists, level by level, a leaf's place
in its run and the run's other digests.

Every row is a leaf, repeats too.  Rows of one group stand by doc_id (null first), those alike in it by
their leaves; a null group comes before all others.  Any column may be null, texts of any length are
hashed whole, empty tables give no rows, and further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, ranked, table

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A round's blocks: group, bucket, its root, its nodes' digests end to end, what the nodes stand for.
BLOCKS = "g string, bucket bigint, root binary, nodes binary, tags array<string>, folded array<binary>"
#: A proof of node ``idx`` of group ``g``: steps up to the root, with the root of its group and of all.
PROOFS = "g string, idx bigint, steps binary, subroot binary, root binary"


def _digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _part(value: Column) -> Column:
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """Digest (32 bytes) of a row's values: byte count, colon and value of each, or a dash for null."""
    return F.unhex(F.sha2(F.concat(*[_part(v) for v in values]), 256))


def levels(nodes: list[str], alone: bool) -> list[list[str]]:
    """The nodes and, above them, ``LEVELS`` levels; for the only block of a group up to one node."""
    out = [nodes]
    while len(out[-1]) > 1 if alone else len(out) <= LEVELS:
        below = out[-1]
        out.append([_digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def _texts(nodes: bytes) -> list[str]:
    h = nodes.hex()
    return [h[i : i + 64] for i in range(0, len(h), 64)]


def _alone(bucket: int, n: int) -> bool:
    """Whether a block may end early: blocks fill in turn, so a first one with room is the only one."""
    return bucket == 0 and n < BLOCK


def collapse(nodes: DataFrame) -> DataFrame:
    """(g, idx, node, tag, folded) -> ``BLOCKS``, a row for each block of ``BLOCK`` nodes; written."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("idx")
        bucket, raw = t.column("bucket")[0].as_py(), b"".join(t.column("node").to_pylist())
        root = levels(_texts(raw), _alone(bucket, t.num_rows))[-1][0]
        one = [t.column("g")[0].as_py(), bucket, bytes.fromhex(root), raw, t.column("tag").to_pylist(), t.column("folded").to_pylist()]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.binary())]
        return pa.table([pa.array([v], k) for v, k in zip(one, kinds, strict=True)], ["g", "bucket", "root", "nodes", "tags", "folded"])

    return materialise(nodes.withColumn("bucket", F.floor(F.col("idx") / BLOCK)).groupBy("g", "bucket").applyInArrow(pack, BLOCKS), "merkle-blocks")


def reduce_up(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of all rounds, lowest first; the last round has one block a group."""
    rounds = [collapse(nodes)]
    while (rounds[-1].agg(F.max("bucket")).first()[0] or 0) > 0:
        up = rounds[-1].select("g", F.col("bucket").alias("idx"), F.col("root").alias("node"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("binary").alias("folded"))
        rounds.append(collapse(up))
    return rounds


def _steps(above: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """(place in its run, the run's others) of node ``i`` at each level."""
    out = []
    for level in above[:-1]:
        run = level[i - i % FANOUT : i - i % FANOUT + FANOUT]
        out.append((i % FANOUT, run[: i % FANOUT] + run[i % FANOUT + 1 :]))
        i //= FANOUT
    return out


def pack_steps(steps: list[tuple[int, list[str]]]) -> bytes:
    return b"".join(bytes([at, len(others)]) + bytes.fromhex("".join(others)) for at, others in steps)


def unpack_steps(packed: bytes) -> list[tuple[int, list[str]]]:
    out, i = [], 0
    while i < len(packed):
        n = packed[i + 1]
        out.append((packed[i], _texts(packed[i + 2 : i + 2 + 32 * n])))
        i += 2 + 32 * n
    return out


def fold(node: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root that a node and its proof give."""
    for at, others in steps:
        node = _digest([*others[:at], node, *others[at:]])
    return node


def _met(blocks: DataFrame, proofs: DataFrame) -> DataFrame:
    p = proofs.select(F.col("g").alias("_g"), F.col("idx").alias("_idx"), "steps", "subroot", F.col("root").alias("top"))
    return blocks.join(p, (F.col("g") == F.col("_g")) & (F.col("bucket") == F.col("_idx")))


def proofs_below(blocks: DataFrame, proofs: DataFrame) -> DataFrame:
    """Proofs of the nodes in ``blocks`` from those of the blocks' roots: lower and upper steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                above = levels(_texts(r["nodes"]), _alone(r["bucket"], len(r["nodes"]) // 32))
                n = len(above[0])
                steps = [pack_steps(_steps(above, i)) + r["steps"] for i in range(n)]
                # groups' roots are the tagged nodes of the uppermost tree
                tagged = r["tags"][0] is not None
                g, idx = (r["tags"], [0] * n) if tagged else ([r["g"]] * n, range(r["bucket"] * BLOCK, r["bucket"] * BLOCK + n))
                sub = [bytes.fromhex(x) for x in above[0]] if tagged else [r["subroot"]] * n
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(idx, pa.int64()), pa.array(steps, pa.binary()), pa.array(sub, pa.binary()), pa.array([r["top"]] * n, pa.binary())], ["g", "idx", "steps", "subroot", "root"])

    return _met(blocks, proofs).select("g", "bucket", "nodes", "tags", "steps", "subroot", "top").mapInArrow(run, PROOFS)


def _verified(blocks: DataFrame, proofs: DataFrame) -> DataFrame:
    """Rows of the lowest blocks with the digest of their proofs and the root they fold to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a block at a time
                r = batch.slice(k, 1).to_pylist()[0]
                above = levels(_texts(r["nodes"]), _alone(r["bucket"], len(r["nodes"]) // 32))
                upper, seen = unpack_steps(r["steps"]), {}
                upper_text = "".join(x for _, others in upper for x in others)
                proof, folded = [], []
                for i, own in enumerate(above[0]):
                    steps = _steps(above, i)
                    proof.append(hashlib.sha256(("".join(x for _, others in steps for x in others) + upper_text).encode()).hexdigest())
                    at_block = fold(r["folded"][i].hex() if r["folded"][i] is not None else own, steps)
                    if at_block not in seen:
                        seen[at_block] = fold(at_block, upper)
                    folded.append(seen[at_block])
                n, root = len(proof), r["top"].hex()
                cols = [r["tags"], above[0], [r["subroot"].hex()] * n, [root] * n, proof, folded]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array([f == root for f in folded])], ["tag", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "tag string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _met(blocks, proofs).select("bucket", "nodes", "tags", "folded", "steps", "subroot", "top").mapInArrow(run, schema)


def manifest(rows: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, folded) -> a row each: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``g`` (no nulls) names and orders the groups; ``folded``, where not null, is the leaf that stands in
    for a row's own when its proof is checked.
    """
    spread = ranked(rows, "g", ["doc_id", "leaf"], "merkle-leaves")
    lower = reduce_up(spread.select("g", "idx", F.col("leaf").alias("node"), F.col("doc_id").cast("string").alias("tag"), "folded"))
    none = F.lit(None).cast("binary")
    subroots = lower[-1].select(F.lit("").alias("one"), "g", "root")
    upper = reduce_up(ranked(subroots, "one", ["g"], "merkle-subroots").select(F.col("one").alias("g"), "idx", F.col("root").alias("node"), F.col("g").alias("tag"), none.alias("folded")))
    proofs = upper[-1].select("g", F.lit(0).cast("bigint").alias("idx"), F.lit(b"").alias("steps"), none.alias("subroot"), "root")
    for blocks in [*reversed(upper), *reversed(lower[1:])]:
        proofs = materialise(proofs_below(blocks, proofs), "merkle-proofs")
    return _verified(lower[0], proofs).select(F.col("tag").cast("bigint").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def document_leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, folded) of documents; where 3 divides the CRC-32 of doc_id, ``folded`` is the leaf
    with the text's A-Z lower-cased (a null doc_id is never tampered with)."""
    c = {k: F.col(k) for k in COLUMNS}
    folded = leaf([*(c[k] for k in COLUMNS[:-1]), F.translate(c["text"], UPPER, LOWER)])
    # a prefix keeps the order of languages and puts null before the empty one
    g = F.coalesce(F.concat(F.lit("="), c["lang"]), F.lit(""))
    return docs.select(g.alias("g"), c["doc_id"].cast("bigint").alias("doc_id"), leaf(list(c.values())).alias("leaf"), F.when(F.crc32(c["doc_id"].cast("string")) % 3 == 0, folded).alias("folded"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(document_leaves(table(spark, sf_dir, "documents")))


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a decimal string in SQL: bytes from the left, eight shifts each."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    turn = "CASE WHEN x >= 0 THEN xor(a, x::BIGINT) ELSE xor(a >> 1, (a & 1) * 3988292384) END"
    return f"xor(list_reduce(list_transform(list_prepend(4294967295, {steps}), lambda v: v::BIGINT), lambda a, x: {turn}), 4294967295)"


def _tree_sql(name: str, n: int) -> str:
    """CTEs <name>1 .. <name>n over <name>0 (g, idx, node): a group with one node stays as it is."""
    out = []
    for k in range(n):
        below = f"{name}{k}"
        out.append(f"{name}{k + 1} AS (SELECT g, idx // 8 AS idx, CASE WHEN max(m) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY idx)) END AS node FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {below}) GROUP BY g, idx // 8)")
    return ",\n".join(out)


def _walk_sql(out: str, start: str, tree: str, n: int) -> str:
    """CTEs <out>1 .. <out>n over <out>0 (doc, g, idx, node, proof): others of each run left and right of the walker."""
    text = []
    for k in range(n):
        side = lambda op, k=k: f"coalesce((SELECT string_agg(t.node, '' ORDER BY t.idx) FROM {tree}{k} t WHERE t.g = w.g AND t.idx // 8 = w.idx // 8 AND t.idx {op} w.idx), '')"
        text.append(f"{out}{k + 1} AS (SELECT doc, g, idx // 8 AS idx, CASE WHEN one THEN node ELSE sha256(lhs || node || rhs) END AS node, proof || lhs || rhs AS proof FROM (SELECT w.*, {side('<')} AS lhs, {side('>')} AS rhs, (SELECT count(*) FROM {tree}{k} t WHERE t.g = w.g) = 1 AS one FROM {out}{k} w))")
    return ",\n".join(text)


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in COLUMNS) + ")"
#: Levels of the languages' trees (8^7 rows each) and of the languages (8^3).
_DEEP, _TOP = 7, 3
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF} AS leaf,
  CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {_LEAF.replace("text::VARCHAR", f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS doc FROM d),
l0 AS (SELECT g, idx, leaf AS node FROM r),
{_tree_sql("l", _DEEP)},
u0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS idx, g AS lang_of, node FROM l{_DEEP}),
{_tree_sql("u", _TOP)},
w0 AS (SELECT doc, g, idx, coalesce(other, leaf) AS node, '' AS proof FROM r),
{_walk_sql("w", "r", "l", _DEEP)},
v0 AS (SELECT w.doc, '' AS g, u.idx, w.node, w.proof FROM w{_DEEP} w JOIN u0 u ON u.lang_of = w.g),
{_walk_sql("v", "w", "u", _TOP)}
SELECT r.doc_id, r.leaf, s.node AS subroot, t.node AS root, sha256(v.proof) AS proof_sha256, v.node AS folded_root, v.node = t.node AS verified
FROM r JOIN v{_TOP} v ON v.doc = r.doc JOIN u0 s ON s.lang_of = r.g CROSS JOIN u{_TOP} t
"""
