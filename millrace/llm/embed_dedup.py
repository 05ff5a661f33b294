"""Embedding near-deduplication by PCA-ordered tiled comparison.

Vectors are brought to length one in double precision and turned to principal axes (of all
valid vectors, from sums added up on the executors), so that leading coordinates carry the
most.  Equal vectors are one representative with a count.  Representatives are laid out in
cells of the first coordinate, cut into blocks; each pair of near blocks is one tile.

In a tile products are accumulated over the leading coordinates step by step.  After each step
the rest of a product is at most the product of the two suffix norms; rows and columns without
a pair that can still reach the threshold leave, and once few pairs are left they go on one by
one, each until it cannot reach the threshold.  Products that end within rounding of the
threshold are computed again from the original unit vectors.  Two unit vectors at cosine >= t
lie at most sqrt(2 - 2t) apart on any axis, so pairs of blocks further apart are not formed.

A tile returns the number of links of each row it holds and a spanning forest of its links,
not the pairs, so a group of near copies with a third of all rows costs no more than others.

Null vectors, zero ones and those with null or non-finite components link with nothing and
stay.  Vectors of unequal dimensions link only within one dimension.  Rows without vec_id link
like others; their component_id is the smallest vec_id of their component, null where none has
one, and they are not kept unless it is null.  Of repeated rows with one vec_id each counts as
a vector.  A cosine equal to the threshold links.  Extra columns are ignored.  Empty tables
give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, forest, materialise, run_bounds, spread_join, table, two_sided_forest, whole_groups

#: Blocks have up to BLOCK vectors; a smaller table is cut into about LEAST_BLOCKS.
THRESHOLD, BLOCK, LEAST_BLOCKS, STRIP = 0.9, 8192, 12, 1024
#: Leading coordinates after which the bound is asked, as parts of all; the share of pairs of
#: a strip under which they go on one by one, and the numbers held for them at once.
STEPS, FEW_PAIRS, PAIR_CELLS = (0.125, 0.25, 0.5, 0.75), 0.02, 4_000_000
SLACK = 1e-9
#: Vectors this common (a share of 1 / HOT_VECTORS of all rows) get their result by broadcast.
HOT_VECTORS = 1_000


def raw_vectors(vectors: DataFrame) -> tuple[DataFrame, np.dtype]:
    """(vec_id, embedding) -> (vec_id, raw): the numbers as bytes, null where they link with
    nothing; and the kind of number."""
    kind = np.dtype("<f4") if dict(vectors.dtypes)["embedding"] == "array<float>" else np.dtype("<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("embedding")
            out: list[bytes | None] = [None] * batch.num_rows
            flat = col.values.cast(pa.from_numpy_dtype(kind))
            bad = np.asarray(flat.is_null())
            flat = flat.fill_null(0).to_numpy(zero_copy_only=False)
            start = np.asarray(col.offsets)
            wrong = np.concatenate([[0], np.cumsum(bad | ~np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            fine = (wrong[start[1:]] == wrong[start[:-1]]) & (some[start[1:]] > some[start[:-1]]) & np.asarray(col.is_valid())
            for i in np.flatnonzero(fine).tolist():
                out[i] = flat[start[i] : start[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "raw"])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, "vec_id bigint, raw binary"), kind


def _by_dim(col: pa.Array, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a column of raw vectors: places of those of one dimension, and their unit vectors."""
    start = np.asarray(col.buffers()[1]).view(np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], kind)
    size = np.diff(start) // kind.itemsize
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        x = data[(start[:-1][at] // kind.itemsize)[:, None] + np.arange(d)].astype(float)
        x /= np.abs(x).max(1)[:, None]  # squares of the largest and least numbers would leave the range
        yield at, x / np.sqrt((x * x).sum(1))[:, None]


def _moments(raw: DataFrame, kind: np.dtype) -> dict[int, np.ndarray]:
    """Principal axes of the unit vectors of each dimension: one d x d matrix a dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_dim(batch.column("raw"), kind):
                total[x.shape[1]] = total.get(x.shape[1], 0) + x.T @ x
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(list(m))], ["d", "i", "row"])

    part = raw.select("raw").mapInArrow(sums, "d bigint, i bigint, row array<double>")
    cells = part.select("d", "i", F.posexplode("row").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in cells.collect():  # d x d numbers, whatever the number of rows
        out.setdefault(r["d"], np.zeros((r["d"], r["d"])))[r["i"], r["j"]] = r["v"]
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in out.items()}


def _pairs(acc: np.ndarray, i: np.ndarray, j: np.ndarray, at: int, steps: list[int], a: np.ndarray, b: np.ndarray, ends: tuple[dict, dict], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Carry pairs (i, j) with the products ``acc`` of their first ``at`` coordinates to the end."""
    for k in steps:
        n = max(1, PAIR_CELLS // (k - at))
        acc = acc + np.concatenate([np.einsum("ij,ij->i", a[i[s : s + n], at:k], b[j[s : s + n], at:k]) for s in range(0, len(i), n)] or [np.empty(0)])
        may = acc + ends[0][k][i] * ends[1][k][j] >= threshold - SLACK
        acc, i, j, at = acc[may], i[may], j[may], k
    return acc, i, j


def _sums(hit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``hit @ n`` by strips: numpy makes a wide copy of a boolean matrix."""
    return np.concatenate([np.empty(0, n.dtype), *(hit[i : i + STRIP] @ n for i in range(0, len(hit), STRIP))])


def _tile(u: np.ndarray, rot: np.ndarray, v: np.ndarray, vrot: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``u`` and ``v`` reach the threshold; the ``rot`` are on principal axes."""
    hit = np.zeros((len(u), len(v)), bool)
    d = u.shape[1]
    steps = sorted({max(1, int(d * part)) for part in STEPS} | {d})
    left, right = ({k: np.sqrt((x[:, k:] ** 2).sum(1)) for k in steps} for x in (rot, vrot))
    for first in range(0, len(u), STRIP):
        rows, cols = np.arange(first, min(first + STRIP, len(u))), np.arange(len(v))
        acc, at = np.zeros((len(rows), len(cols))), 0
        for s, k in enumerate(steps):
            acc += rot[rows, at:k] @ vrot[cols, at:k].T
            at = k
            may = acc + left[k][rows, None] * right[k][None, cols] >= threshold - SLACK
            if np.count_nonzero(may) <= FEW_PAIRS * may.size or k == d:
                i, j = np.nonzero(may)
                p, i, j = _pairs(acc[i, j], rows[i], cols[j], at, steps[s + 1 :], rot, vrot, (left, right), threshold)
                edge = np.abs(p - threshold) <= SLACK
                p[edge] = np.einsum("ij,ij->i", u[i[edge]], v[j[edge]])
                hit[i[p >= threshold], j[p >= threshold]] = True
                break
            r, c = may.any(1), may.any(0)
            if not (r.all() and c.all()):
                acc, rows, cols = acc[np.ix_(r, c)], rows[r], cols[c]
    return hit


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.  ``block``: vectors of a block."""
    spark = vectors.sparkSession
    raw, kind = raw_vectors(vectors)
    raw = materialise(raw, "vectors")
    axes = _moments(raw.where("raw IS NOT NULL"), kind)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, x0 = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, x in _by_dim(batch.column("raw"), kind):
                dim[at], x0[at] = x.shape[1], x @ axes[x.shape[1]][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dim), pa.array(x0)], [*batch.schema.names, "d", "x0"])

    reps = raw.where("raw IS NOT NULL").groupBy("raw").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    reps = materialise(reps.mapInArrow(turn, "raw binary, low bigint, n bigint, node bigint, d bigint, x0 double"), "vector-reps")
    block = block or min(BLOCK, max(STRIP, -(-reps.count() // LEAST_BLOCKS)))
    # blocks: a grid on the first axis, whose cells are split where they hold many
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    grid = reps.withColumn("cell", F.floor((F.col("x0") + 1) / (reach / 2)).cast("bigint"))
    cells = grid.groupBy("d", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))  # 4 / reach + 1 a dimension at most
    grid = grid.join(F.broadcast(cells), ["d", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # a row goes to the tiles of its own block: with blocks of its cell and of the two on each side
    other = cells.select(F.col("d").alias("d2"), F.col("cell").alias("cell2"), F.col("parts").alias("parts2"))
    near = grid.join(F.broadcast(other), (F.col("d") == F.col("d2")) & (F.abs(F.col("cell") - F.col("cell2")) <= 2))
    near = near.withColumn("part2", F.explode(F.expr("sequence(0L, parts2 - 1)")))
    own, far = F.struct("cell", "part"), F.struct(F.col("cell2").alias("cell"), F.col("part2").alias("part"))
    tiles = near.select("d", F.least(own, far).alias("low"), F.greatest(own, far).alias("high"), (own > far).cast("int").alias("side"), "node", "n", "raw")
    tiles = tiles.select(F.xxhash64("d", "low", "high").alias("tile"), (F.col("low") == F.col("high")).alias("same"), "side", "node", "n", "raw")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["tile"]):
            t = t.combine_chunks()
            start, stop = run_bounds(t.column("tile").to_numpy())
            for a, b in zip(start.tolist(), stop.tolist(), strict=True):
                part = t.slice(a, b - a).combine_chunks().to_batches()[0]
                (_, x), side, node, n = next(_by_dim(part.column("raw"), kind)), *(part.column(c).to_numpy(zero_copy_only=False) for c in ("side", "node", "n"))
                rot = x @ axes[x.shape[1]]
                if part.column("same")[0].as_py():
                    hit = _tile(x, rot, x, rot, threshold)
                    np.fill_diagonal(hit, False)
                    hit |= hit.T
                    links, nodes = _sums(hit, n), node
                    some = hit.any(1)
                    ea, eb = forest(node[some], hit[np.ix_(some, some)])
                else:
                    p, q = side == 0, side == 1
                    hit = _tile(x[p], rot[p], x[q], rot[q], threshold)
                    links, nodes = np.concatenate([_sums(hit, n[q]), _sums(hit.T, n[p])]), np.concatenate([node[p], node[q]])
                    keep_p, keep_q = hit.any(1), hit.any(0)
                    ea, eb = two_sided_forest(node[p][keep_p], node[q][keep_q], hit[np.ix_(keep_p, keep_q)])
                some = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([nodes[some], ea]), pa.int64()), pa.array(np.concatenate([nodes[some], eb]), pa.int64()), pa.array(np.concatenate([links[some], np.zeros(len(ea))]).astype(np.int64), pa.int64())], ["a", "b", "links"]
                )

    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = tiles.repartition(n_tasks, "tile").sortWithinPartitions("tile").mapInArrow(compare, "a bigint, b bigint, links bigint")
    found = materialise(found, "embedding-links")
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comp = components(found.where("a <> b").select("a", "b"), "embedding-components")
    roots = reps.select("node", "low").join(comp, "node").groupBy("root").agg(F.min("low").alias("component_id"))
    linked = comp.join(roots, "root").select("node", "component_id", F.lit(True).alias("linked"))
    per_rep = reps.join(links, "node", "left").join(linked, "node", "left").select("raw", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    out = spread_join(raw.where("raw IS NOT NULL"), materialise(per_rep, "vector-results"), "raw", "n", HOT_VECTORS)
    alone = raw.where("raw IS NULL").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


#: All pairs, for tables small enough.
OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v
 WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) WHERE list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON e.vec_id = c.a LEFT JOIN n ON e.vec_id = n.a
"""
