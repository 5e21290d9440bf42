"""Hard-negative mining by blocked dense products (operator 11).

Vectors become whole numbers, so an inner product has no rounding: float64 holds it below 2^53. The
anchors are cut into blocks of a fixed size. A block is broadcast and every task multiplies it with
its own rows, a slice at a time; what a task passes on are its best rows for each anchor, which merge
like sums. The first pass finds each anchor's positives. The second, with the positives' scores
broadcast beside the block, finds for each of them the best rows of other labels within its window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, read_table, stored

EXACT = 1 << 53
NONE = np.iinfo(np.int64).min  # a score that no row has


@dataclass(frozen=True)
class Mining:
    """What is mined: ``scale`` makes components whole numbers; an anchor's ``positives`` best rows of its
    label; for each of them ``negatives`` rows whose score is ``low`` to ``high`` per cent of the positive's."""

    scale: int = 256
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """``vec_id, label, dim, v``: the rows that take part, with their components as whole numbers (in doubles)."""
    whole = F.transform("vec", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
    # a null component makes the sum null; one that is not finite makes it so
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * 0.0)
    return rows.where(sound).where(total == 0.0).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.size("vec").alias("dim"), whole.alias("v"))


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products of whole-numbered rows, exactly, as int64. float64 where no partial sum can reach
    2^53; else 64-bit integers, and an error where a hundred times a score might not fit them."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(c).max(initial=0)) * a.shape[1]
    if bound < EXACT:
        return (a @ c.T).astype(np.int64)
    if bound >= 2.0**63 / 100:
        raise OverflowError("a hundred times an inner product of these vectors may not fit 64 bits")
    return a.astype(np.int64) @ c.astype(np.int64).T


class Best:
    """The k best (score, id) of each of n lists seen so far; larger scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Lists ``at`` meet a row of scores each (NONE: no row there); ids ascend along the row."""
        k = self.score.shape[1]
        some = np.flatnonzero((scores > self.score[at, -1:]).any(axis=1) | (scores == self.score[at, -1:]).any(axis=1) & (self.score[at, -1] > NONE))
        if not len(some):
            return
        at, scores = at[some], scores[some]
        if scores.shape[1] > k:  # the k-th largest, and of those equal to it the first, as ids ascend
            edge = np.partition(scores, -k, axis=1)[:, -k][:, None]
            over = scores > edge
            tie = scores == edge
            take = over | (tie & (np.cumsum(tie, axis=1) <= k - over.sum(axis=1)[:, None]))
            col = np.nonzero(take)[1].reshape(len(at), k)
            scores, ids = np.take_along_axis(scores, col, axis=1), ids[col]
        else:
            ids = np.broadcast_to(ids, scores.shape)
        s, i = np.concatenate([self.score[at], scores], axis=1), np.concatenate([self.id[at], ids], axis=1)
        order = np.lexsort((i, ~s), axis=1)[:, :k]  # ~s falls as s rises, and NONE has one too
        self.score[at], self.id[at] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of all that is held."""
        row, col = np.nonzero(self.score > NONE)
        return row, self.score[row, col], self.id[row, col]


class Block:
    """A block of anchors as it is broadcast: ids, labels and, by dimension, their matrix."""

    def __init__(self, t: pa.Table):
        self.ids, self.labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
        self.parts = []
        dims = t.column("dim").to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            self.parts.append((int(d), at, matrix(t.column("v").combine_chunks().take(pa.array(at)), int(d))))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _slices(batches: Iterator[pa.RecordBatch], block: Block, rows: int, anchors: int):
    """(anchors' places, rows' ids, rows' labels, products) of all anchors and rows of one dimension, in
    pieces of at most ``anchors`` by ``rows``; ids ascend within a piece."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, labels, dims = (b.column(i).to_numpy() for i in range(3))
        for dim, at, a in block.parts:
            own = np.flatnonzero(dims == dim)
            own = own[np.argsort(ids[own], kind="stable")]
            c = matrix(b.column(3).take(pa.array(own)), dim)
            for j in range(0, len(own), rows):
                mine = own[j : j + rows]
                for i in range(0, len(at), anchors):
                    yield at[i : i + anchors], ids[mine], labels[mine], products(a[i : i + anchors], c[j : j + rows])


def _positives(sent, m: Mining, rows: int, anchors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        best = Best(len(block.ids), m.positives)
        for at, ids, labels, s in _slices(batches, block, rows, anchors):
            s[(labels[None, :] != block.labels[at][:, None]) | (ids[None, :] == block.ids[at][:, None])] = NONE
            best.add(at, s, ids)
        row, score, i = best.entries()
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[row]), pa.array(i), pa.array(score)], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(sent, m: Mining, rows: int, anchors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, score, pid = sent.value
        best = [Best(len(block.ids), m.negatives) for _ in range(m.positives)]
        for at, ids, labels, s in _slices(batches, block, rows, anchors):
            s[labels[None, :] == block.labels[at][:, None]] = NONE
            for p, found in enumerate(best):
                # the whole numbers s with 100 * s between low * p and high * p
                there = score[at, p] > NONE
                own = np.where(there, score[at, p], 0)
                lo, hi = np.where(there, -(-m.low * own // 100), 1), np.where(there, m.high * own // 100, 0)
                some = np.flatnonzero(lo <= hi)
                if len(some):
                    inside = s[some]
                    inside[(inside < lo[some][:, None]) | (inside > hi[some][:, None])] = NONE
                    found.add(at[some], inside, ids)
        for p, found in enumerate(best):
            row, s, i = found.entries()
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[row]), pa.array(pid[row, p]), pa.array(np.full(len(row), p, np.int32)), pa.array(score[row, p]), pa.array(i), pa.array(s)], ["anchor_id", "positive_id", "place", "positive_score", "negative_id", "negative_score"])

    return run


def _first(rows: DataFrame, group: list[str], score: str, key: str, k: int) -> DataFrame:
    """The k best of each group with ``rank``; every task has cut its own to k before, so little is moved."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(score), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, m: Mining = Mining(), block_bytes: int = 16 << 20, rows: int = 2048, slice_anchors: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and
    each of its positives the best rows of another label within the window, ranked from 1.

    vectors, anchors: (vec_id, label, vec). Both are cut down to :func:`usable` rows: a null id, label or
    vector, or a component that is null or not finite, and the row takes no part. Scores are inner products of
    ``floor(scale * x)``; larger first, ties by the smaller id. An anchor's own id is never its positive;
    of repeated anchors one counts (the smallest label, then vector), of other repeated rows each. Rows
    of another dimension than the anchor's are not compared with it. An anchor without positives, and a
    positive of a negative score, whose window is empty, give no rows; neither does an empty table.
    A score must fit 64 bits a hundred times, else it is an error. Other columns are not read.

    A block of anchors has about ``block_bytes`` bytes (at most twice as many, which is checked) and is all
    that is broadcast or comes to the driver at once; a block is two passes over the vectors, each of
    which multiplies every row with the whole block. A task holds ``slice_anchors`` times ``rows`` products
    at a time, and ``positives`` times ``negatives`` entries for an anchor of the block.
    """
    spark = vectors.sparkSession
    whole = stored(usable(vectors, m.scale), "whole_vectors")
    own = usable(anchors, m.scale).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v")).alias("x")).select("vec_id", "x.*")
    n, dims = own.agg(F.count("*"), F.coalesce(F.sum(F.col("dim").cast("bigint")), F.lit(0))).first()
    blocks = max(1, -(-8 * (dims + 2 * n) // block_bytes))
    dealt = stored(own.repartition(blocks).withColumn("block", F.spark_partition_id()), "anchors")
    out = None
    for k in range(blocks):
        t = dealt.where(F.col("block") == k).drop("block").toArrow()
        if t.num_rows == 0:
            continue
        if t.nbytes > 2 * block_bytes + (1 << 20):
            raise RuntimeError(f"a block of anchors has {t.nbytes} bytes")
        block = Block(t)
        sent = spark.sparkContext.broadcast(block)
        found = whole.mapInArrow(_positives(sent, m, rows, slice_anchors), "anchor_id bigint, positive_id bigint, positive_score bigint")
        found = _first(found, ["anchor_id"], "positive_score", "positive_id", m.positives).toArrow()  # positives times the block's rows
        sent.destroy()
        score, pid = np.full((len(block.ids), m.positives), NONE), np.zeros((len(block.ids), m.positives), np.int64)
        order = np.argsort(block.ids)
        at = order[np.searchsorted(block.ids[order], found.column("anchor_id").to_numpy())]
        place = found.column("rank").to_numpy() - 1
        score[at, place], pid[at, place] = found.column("positive_score").to_numpy(), found.column("positive_id").to_numpy()
        sent = spark.sparkContext.broadcast((block, score, pid))
        near = whole.mapInArrow(_negatives(sent, m, rows, slice_anchors), "anchor_id bigint, positive_id bigint, place int, positive_score bigint, negative_id bigint, negative_score bigint")
        near = _first(near, ["anchor_id", "place", "positive_id", "positive_score"], "negative_score", "negative_id", m.negatives)
        near = stored(near.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        sent.destroy()
        out = near if out is None else out.unionByName(near)
    drop_stored(whole)
    drop_stored(dealt)
    if out is None:
        out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = e.select("vec_id", label.alias("label"), F.col("embedding").alias("vec"))
    return mine(rows, rows.where("vec_id % 100 = 0"))


def brute(rows: list[tuple], anchor_ids: set[int], m: Mining = Mining()) -> list[tuple]:
    """The same with Python's whole numbers, row by row (for tests). rows: (vec_id, label, vec)."""
    import math

    ok = [(i, y, [math.floor(m.scale * float(x)) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in sorted((r for r in ok if r[0] in anchor_ids)):
        score = [(sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in ok if len(w) == len(v)]
        for p, j in sorted(((s, j) for s, j, z in score if z == y and j != i), key=lambda x: (-x[0], x[1]))[: m.positives]:
            inside = sorted(((s, c) for s, c, z in score if z != y and m.low * p <= 100 * s <= m.high * p), key=lambda x: (-x[0], x[1]))
            out += [(i, j, r + 1, c, p, s) for r, (s, c) in enumerate(inside[: m.negatives])]
    return sorted(out)


SQL = {
    "op11_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM e a JOIN e c ON a.vec_id % 100 = 0 AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
}
