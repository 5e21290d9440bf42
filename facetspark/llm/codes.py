"""Near-duplicate embeddings by randomised-rotation binary codes (operator 12).

1. Equal vectors are one class. A class's unit vector is padded with zeros, rotated at random and kept
   as the signs of its coordinates: a corner of the hypercube. With it goes a correction factor, the
   inner product of the vector and its corner. As the other side of a pair the rotated vector is also
   kept in four bits a coordinate, rounded at random. The product of a corner and such a vector, over the
   factor, estimates the inner product of the two vectors without bias, and the factor bounds its error.
2. Classes that may be near meet in *cells*: the signs of further rotations, a few for each of several
   tables, name a class's cell in each. How many signs and tables there are follows from the number
   of classes and the ``recall`` asked for at the threshold itself; nearer pairs are found more surely.
3. In a cell, or a pair of blocks of a large one, all codes meet in one product. A pair whose upper
   bound is below the threshold is settled. Only the vectors of the others are fetched, and their
   cosines computed in double precision decide. A pair counts in the first table that brings it together.
4. A task passes on how many rows each class is linked with and the smallest class of its component
   there, never pairs; connected components of these are the groups.

Codes take about a sixth of the bytes of the vectors (at 1,024 floats), and only they go to all tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, partitions, read_table, stored
from .graph import components

QUERY_LEVELS = 15  # four bits a coordinate


@lru_cache(8)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """The part of a random rotation of ``bits`` dimensions that acts on the first ``dim``."""
    rng = np.random.Generator(np.random.PCG64([0xC0DE, bits, seed]))
    q, r = np.linalg.qr(rng.standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dim])


def code_type(bits: int) -> np.dtype:
    """Signs, four-bit coordinates, the correction factor, and the coordinates' least value and step."""
    return np.dtype([("signs", "u1", bits // 8), ("query", "u1", bits // 2), ("factor", "<f4"), ("low", "<f4"), ("step", "<f4")])


def code_bits(dim: int) -> int:
    """Coordinates of the rotated vectors: whole words, 128 at least, as the error falls with their root."""
    return max(128, -(-dim // 64) * 64)


def encode(units: np.ndarray) -> np.ndarray:
    """Codes of unit vectors, a row each."""
    bits = code_bits(units.shape[1])
    x = units @ rotation(units.shape[1], bits, 0).T
    out = np.zeros(len(x), code_type(bits))
    out["signs"] = np.packbits(x > 0, axis=1)
    out["factor"] = np.abs(x).sum(axis=1) / math.sqrt(bits)
    low = x.min(axis=1).astype(np.float32)
    step = np.maximum((x.max(axis=1) - low) / QUERY_LEVELS, 1e-9).astype(np.float32)
    at_random = np.random.Generator(np.random.PCG64([0xC0DE, bits])).random(bits)  # the same at every run
    level = np.clip(np.floor((x - low[:, None]) / step[:, None] + at_random), 0, QUERY_LEVELS).astype(np.uint8)
    out["query"] = level[:, ::2] << 4 | level[:, 1::2]
    out["low"], out["step"] = low, step
    return out


def estimate(a: np.ndarray, b: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of all a with all b, and the half widths of their confidence
    intervals: ``sure`` standard deviations of a corner's error and of the rounding together."""
    bits = a["signs"].shape[1] * 8
    signs = np.unpackbits(a["signs"], axis=1).astype(np.float32) * 2 - 1
    level = np.stack([b["query"] >> 4, b["query"] & 15], axis=2).reshape(len(b), bits).astype(np.float32)
    dots = (signs @ level.T) * b["step"] + signs.sum(axis=1)[:, None] * b["low"]
    c = np.maximum(a["factor"], 1e-6)[:, None]
    wide = np.sqrt(np.maximum(1 - c * c, 0) / (bits - 1) + b["step"] ** 2 / 4) / c
    return dots / (c * math.sqrt(bits)), sure * wide


@dataclass(frozen=True)
class Tables:
    """``tables`` tables of cells named by ``signs`` signs each."""

    tables: int
    signs: int

    @staticmethod
    def of(classes: int, threshold: float, recall: float, cell_rows: int) -> Tables:
        """Enough signs for about ``cell_rows`` classes a cell if they lie at random, and enough tables for a
        pair at the threshold to meet in one of them with probability ``recall``."""
        signs = min(28, max(4, math.ceil(math.log2(max(1, classes) / cell_rows))))
        agree = (1 - math.acos(threshold) / math.pi) ** signs
        return Tables(max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree))), signs)

    def keys(self, units: np.ndarray) -> np.ndarray:
        """The cell of each row in each table."""
        dim, need, got = units.shape[1], self.tables * self.signs, []
        bits = code_bits(dim)
        for k in range(-(-need // bits)):
            got.append(units @ rotation(dim, bits, k + 1).T > 0)
        signs = np.concatenate(got, axis=1)[:, :need].reshape(len(units), self.tables, self.signs)
        return (signs @ (1 << np.arange(self.signs))).astype("<u4")


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square is too large or too small
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


CODED = "cls bigint, dim int, code binary, cells array<bigint>, keys binary"


def _coded(tables: Tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).value_lengths().to_numpy()
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                units = unit_rows(own.column(1), int(d))
                codes, keys = encode(units), tables.keys(units)
                cells = keys.astype(np.int64) + (np.arange(tables.tables, dtype=np.int64) << 32)
                offsets = np.arange(len(units) + 1, dtype=np.int32) * tables.tables
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(np.full(len(units), d, np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.reshape(-1))), pa.array([k.tobytes() for k in keys], pa.binary())],
                    ["cls", "dim", "code", "cells", "keys"],
                )

    return run


GROUP = ["dim", "cell", "bi", "bj"]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of a sorted stream by group: (group, its rows)."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy() for i in range(len(GROUP))])
        edge = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        for a, z in zip(edge.tolist(), [*edge[1:].tolist(), b.num_rows], strict=True):
            key = tuple(keys[:, a].tolist())
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


def doubtful(group: tuple, t: pa.Table, threshold: float, sure: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the group's two sides, and which pairs of these may reach the threshold and have not met in
    an earlier table."""
    dim, cell, bi, bj = group
    kind = code_type(code_bits(dim))
    side = t.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    right = left if bi == bj else np.flatnonzero(side == 1)
    if not len(left) or not len(right) or (bi == bj and len(left) < 2):
        return left, right, np.zeros((len(left), len(right)), bool)
    codes = np.frombuffer(b"".join(t.column("code").to_pylist()), kind)
    guess, wide = estimate(codes[left], codes[right], sure)
    may = guess + wide >= threshold
    if bi == bj:
        may &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    if (earlier := cell >> 32) and may.any():
        keys = np.frombuffer(b"".join(t.column("earlier").to_pylist()), "<u4").reshape(-1, earlier)
        for k in range(earlier):
            may &= keys[left, k][:, None] != keys[right, k][None, :]
    return left, right, may


def _open(threshold: float, sure: float):
    """Codes of cells to the classes that have a pair in doubt."""
    names = [*GROUP, "side", "cls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in groups(batches):
            left, right, may = doubtful(key, t, threshold, sure)
            some = np.unique(np.concatenate([left[may.any(axis=1)], right[may.any(axis=0)]]))
            if len(some):
                yield from t.select(names).take(pa.array(some)).combine_chunks().to_batches()

    return run


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


LINKED = "cls bigint, far bigint, root bigint"


def _decide(threshold: float, sure: float):
    """The pairs in doubt, by the cosines of their vectors: per class the rows it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in groups(batches):
            left, right, may = doubtful(key, t, threshold, sure)
            if not may.any():
                continue
            units = unit_rows(t.column("vec").combine_chunks(), key[0])
            i, j = np.nonzero(may & (units[left] @ units[right].T >= threshold))
            if not len(i):
                continue
            i, j = left[i], right[j]
            cls, copies = t.column("cls").to_numpy(), t.column("copies").to_numpy()
            far = np.zeros(len(cls), np.int64)
            np.add.at(far, i, copies[j])
            np.add.at(far, j, copies[i])
            order = np.argsort(cls)  # so that the smallest place is the smallest class
            place = np.argsort(order)
            root = cls[order[roots(len(cls), place[i], place[j])[place]]]
            some = np.flatnonzero(far)
            yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(far[some]), pa.array(root[some])], ["cls", "far", "root"])

    return run


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), *GROUP).sortWithinPartitions(*GROUP)


def near_vectors(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.98, sure: float = 1.9, cell_rows: int = 256, block: int = 1024) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of vectors (vec_id, vec): how many other rows
    have a cosine of at least ``threshold`` with it, the smallest vec_id that links reach, and whether that
    is its own.

    A link is never false: the cosine in double precision decides. It may be missed: two vectors at the
    threshold meet with probability ``recall``, nearer ones more surely, equal ones always; and a pair whose
    estimate is off by more than ``sure`` deviations is not looked at (1.9 of the whole error, which for
    vectors as near as 0.9 is over four of theirs). Vectors that are null, empty, zero, or hold a null or
    a component that is not finite link with nothing, and so do vectors of different dimensions. Repeated
    rows link with each other; a null vec_id names a component only if it has no other, and is its own
    then; an empty table gives no rows; other columns are not read.

    ``cell_rows`` and :class:`Tables` fix the index, which is fitted to nothing but the number of rows. Cells
    of over ``block`` classes are joined in pairs of blocks, so no task holds more than two.
    """
    spark = vectors.sparkSession
    wrong = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * 0.0)  # 0 if all are finite
    sound = (wrong == 0.0) & F.exists("vec", lambda x: x != 0)
    base = vectors.select("vec_id", F.when(sound, F.col("vec")).alias("vec"))
    base = base.select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    classes = base.where("vec is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    tables = Tables.of(classes.count(), threshold, recall, cell_rows)
    codes = stored(classes.select("cls", "vec").mapInArrow(_coded(tables), CODED), "codes")

    cells = codes.select("cls", "dim", "code", "keys", F.posexplode("cells").alias("t", "cell"))
    cells = cells.select("dim", "cell", "cls", "code", F.expr("substring(keys, 1, 4 * t)").alias("earlier"))
    large = cells.groupBy("dim", "cell").agg(F.count("*").alias("m")).where(F.col("m") > block).select("dim", "cell", F.ceil(F.col("m") / block).cast("int").alias("nb"))
    parted = cells.join(stored(large, "large"), ["dim", "cell"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    blk = F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(F.least(o, F.col("blk")).alias("bi"), F.greatest(o, F.col("blk")).alias("bj"), F.when(o < F.col("blk"), 1).otherwise(0).alias("side")))
    parted = parted.withColumn("blk", blk).select("dim", "cell", F.inline(pairs), "cls", "code", "earlier").select(*GROUP, "side", "cls", "code", "earlier")
    open_ = stored(_dealt(parted).mapInArrow(_open(threshold, sure), "dim int, cell bigint, bi int, bj int, side int, cls bigint"), "open")

    told = codes.select("cls", "code", "keys").join(classes.select("cls", "vec", "copies"), "cls")
    asked = open_.join(told, "cls").select(*GROUP, "side", "cls", "code", F.expr("substring(keys, 1, 4 * cast(shiftright(cell, 32) as int))").alias("earlier"), "vec", "copies")
    links = stored(_dealt(asked).mapInArrow(_decide(threshold, sure), LINKED), "links")
    drop_stored(open_)
    drop_stored(codes)

    comp = components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    far = links.groupBy("cls").agg(F.sum("far").alias("far"))
    named = classes.select("cls", "h1", "h2", "rep", "copies").join(comp, F.col("cls") == F.col("node"), "left").join(far, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = stored(named.select("component", "h1", "h2", "rep", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links")), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    per = named.join(least, "component").select("h1", "h2", "n_links", "component_id")
    out = base.where("vec is not null").select("vec_id", "h1", "h2").join(per, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(base.where("vec is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec")))


def brute(rows: list[tuple], threshold: float = 0.9) -> list[tuple]:
    """The same by comparing all pairs (for tests). rows: (vec_id, vec)."""
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    size = {k: max(map(abs, rows[k][1])) for k in ok}  # so that no square is too large or too small
    rows = [(i, [x / size[k] for x in v] if k in size else v) for k, (i, v) in enumerate(rows)]
    label, links = {k: k for k in range(len(rows))}, [0] * len(rows)
    for n, a in enumerate(ok):
        for b in ok[n + 1 :]:
            x, y = rows[a][1], rows[b][1]
            if len(x) == len(y) and math.sumprod(x, y) >= threshold * math.sqrt(math.sumprod(x, x)) * math.sqrt(math.sumprod(y, y)):
                links[a] += 1
                links[b] += 1
                old = label[b]
                label = {k: label[a] if v == old else v for k, v in label.items()}
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in label if label[j] == label[k] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((i, links[k], least, i == least))
    return out


SQL = {
    "op12_binary_codes": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
ok AS (SELECT * FROM v WHERE v IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(r, t) AS (SELECT r, r FROM v UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.t),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.t GROUP BY reach.r),
n AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least.component_id, v.vec_id IS NOT DISTINCT FROM least.component_id AS kept FROM v LEFT JOIN n USING (r) JOIN least USING (r)
"""
}
