"""Exact vector search over int8 vectors.

Small expressions are built-in functions. Scans over many rows with a bounded set of seeds
multiply blocks of rows with the seeds' matrix in numpy, and each batch hands on its best only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_SEEDS = 4096


def quantise(v):
    """Unit vector to int8: round(x * 127), halves away from zero."""
    return F.transform(v, lambda x: F.round(x.cast("double") * 127).cast("tinyint"))


def dot(a, b):
    """Exact whole-number dot product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def cosine(a, b):
    return dot(a, b) / F.sqrt(dot(a, a).cast("double") * dot(b, b).cast("double"))


def project_out(v, direction):
    """v without its component along a unit direction (doubles)."""
    along = F.aggregate(F.zip_with(v, direction, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(v, direction, lambda x, y: x.cast("double") - along * y.cast("double"))


def _sent(vectors: DataFrame, seeds: DataFrame, weight: str | None = None):
    """Seeds' ids, weights and, broadcast, their matrix; at most MAX_SEEDS, which is checked."""
    rows = seeds.select("id", "vec", *[weight] * bool(weight)).limit(MAX_SEEDS + 1).collect()
    if len(rows) > MAX_SEEDS:
        raise ValueError(f"over {MAX_SEEDS} seeds; search in blocks of seeds")
    matrix = np.array([r.vec for r in rows], np.int32).reshape(len(rows), -1)
    return np.array([r.id for r in rows], np.int64), np.array([r[2] if weight else 1 for r in rows]), vectors.sparkSession.sparkContext.broadcast(matrix)


def _products(batches: Iterator[pa.RecordBatch], s: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per batch of (id, vec[, kind]): ids, kinds, and the dot products with all seeds."""
    for b in batches:
        if b.num_rows and len(s):
            x = b.column(1).flatten().to_numpy().astype(np.int32).reshape(b.num_rows, -1)
            yield b.column(0).to_numpy(), b.column(2).to_numpy() if b.num_columns > 2 else np.zeros(b.num_rows, np.int32), x @ s.T


def knn(vectors: DataFrame, seeds: DataFrame, k: int, media: str | None = None) -> DataFrame:
    """``seed, id, dot, rank``: the k nearest of each seed by dot product, ties by id; with
    ``media`` k of each media (and the column). vectors, seeds: (id, vec int8[, media]). The seeds
    (at most MAX_SEEDS) are the broadcast side, and a batch of vectors passes on at most k rows a seed; more
    seeds than that are searched for by :func:`knn_blocks`."""
    if seeds.limit(MAX_SEEDS + 1).count() > MAX_SEEDS:
        return knn_blocks(vectors, seeds, k, media)
    ids, _, sent = _sent(vectors, seeds)
    schema = "seed bigint, id bigint, dot bigint" + (f", {media} int" if media else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for own, kinds, dots in _products(batches, s):
            out = [[], [], [], []]
            for c in np.unique(kinds):
                at = np.flatnonzero(kinds == c)
                order = np.lexsort((np.broadcast_to(own[at, None], (len(at), len(s))), -dots[at]), axis=0)[:k]
                for j in range(len(s)):
                    best = at[order[:, j]]
                    out[0] += [ids[j]] * len(best)
                    out[1] += own[best].tolist()
                    out[2] += dots[best, j].tolist()
                    out[3] += [c] * len(best)
            arrays = [pa.array(out[i], pa.int64()) for i in range(3)] + ([pa.array(out[3], pa.int32())] if media else [])
            yield pa.RecordBatch.from_arrays(arrays, ["seed", "id", "dot", *[media] * bool(media)])

    near = vectors.select("id", "vec", *[media] * bool(media)).mapInArrow(run, schema)
    rank = F.row_number().over(Window.partitionBy("seed", *[media] * bool(media)).orderBy(F.desc("dot"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def scan(vectors: DataFrame, query: list[int], column: str = "vec") -> DataFrame:
    """``id, dot`` of every row with one query vector, multiplied a batch at a time."""
    q = np.array(query, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, dots in _products(batches, q[None, :]):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(dots[:, 0].astype(np.int64))], ["id", "dot"])

    return vectors.select("id", F.col(column).alias("vec")).mapInArrow(run, "id bigint, dot bigint")


def scan_spaces(vectors: DataFrame, queries: dict[str, tuple[str, list[int]]], keep: list[str]) -> DataFrame:
    """``keep`` and, for every name of queries, the dot product of a column with a query vector, in one pass. A
    query names its column."""
    sides = {n: (col, np.array(q, np.int32)) for n, (col, q) in queries.items()}
    columns = list(dict.fromkeys(col for col, _ in sides.values()))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*keep).schema) + "".join(f", {n} bigint" for n in sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = {c: b.column(b.schema.get_field_index(c)).flatten().to_numpy().astype(np.int32).reshape(b.num_rows, -1) for c in columns}
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array((x[c] @ q).astype(np.int64)) for c, q in sides.values()]], [*keep, *sides])

    return vectors.select(*keep, *columns).mapInArrow(run, schema)


def scan_stats(vectors: DataFrame, seeds: DataFrame, media: str) -> DataFrame:
    """``seed, media, n, mean, sd`` of the dot products of a seed with every row (A15, W5). Seeds as
    for :func:`knn`; a batch of vectors passes on one row of whole-number sums a seed and media."""
    ids, _, sent = _sent(vectors, seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kinds, dots in _products(batches, sent.value):
            out = [(int(i), int(c), int((kinds == c).sum()), int(x), int(y)) for c in np.unique(kinds) for d in [dots[kinds == c].astype(np.int64)] for i, x, y in zip(ids, d.sum(0), (d * d).sum(0), strict=True)]
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())] + [pa.array(x, pa.int64()) for x in cols[2:]], ["seed", media, "n", "s", "ss"])

    sums = vectors.select("id", "vec", F.col(media).cast("int").alias(media)).mapInArrow(run, f"seed bigint, {media} int, n bigint, s bigint, ss bigint")
    return sums.groupBy("seed", media).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).select(
        "seed", media, "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"), F.round(F.sqrt((F.col("ss") * F.col("n") - F.col("s") * F.col("s")).cast("double")) / F.col("n"), 6).alias("sd")
    )


def z_map(score, own_mean, own_sd, mean, sd):
    """A score of another type on the scale of the own type."""
    return F.when(sd > 0, own_mean + own_sd * (score - mean) / sd).otherwise(score)


def centroid(vectors: DataFrame, group: list[str]) -> DataFrame:
    """``group, pos, total, n``: per dimension the whole-number sum; total / n is the mean (A16). A
    task passes on one array of sums a group, not a row a dimension of every vector."""
    kinds = vectors.select(*group).schema
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kinds) + "sums array<bigint>, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(len(group)).flatten().to_numpy().astype(np.int64).reshape(b.num_rows, -1)
            keys = list(zip(*[b.column(i).to_pylist() for i in range(len(group))], strict=True)) if group else [()] * b.num_rows
            at: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                at.setdefault(k, []).append(i)
            for k, rows in at.items():
                got = total.setdefault(k, [np.zeros(x.shape[1], np.int64), 0])
                got[0] += x[rows].sum(0)
                got[1] += len(rows)
        if total:
            cols = [pa.array([k[i] for k in total], b.schema.field(i).type) for i in range(len(group))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([v[0].tolist() for v in total.values()], pa.list_(pa.int64())), pa.array([v[1] for v in total.values()], pa.int64())], [*group, "sums", "n"])

    parts = vectors.select(*group, "vec").mapInArrow(run, schema)
    return parts.select(*group, "n", F.posexplode("sums").alias("pos", "x")).groupBy(*group, "pos").agg(F.sum("x").alias("total"), F.sum("n").alias("n"))


def weighted_nearest(vectors: DataFrame, liked: DataFrame, k: int = 5) -> DataFrame:
    """``id, score``: the weighted mean of the k largest dot products with liked rows, ties by id
    (J13). liked: (id, vec, weight), a user's list, bounded like :func:`knn`'s seeds. Each row is
    finished where it is read; nothing is shuffled."""
    ids, weights, sent = _sent(vectors, liked, "weight")
    order, weights = np.argsort(ids, kind="stable"), weights.astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, dots in _products(batches, sent.value):
            dots = dots[:, order]
            best = np.argsort(-dots, axis=1, kind="stable")[:, :k]
            w = weights[order][best]
            score = (np.take_along_axis(dots, best, axis=1) * w).sum(1) / w.sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(score)], ["id", "score"])

    return vectors.select("id", "vec").mapInArrow(run, "id bigint, score double")


def _packed(df: DataFrame, blocks: int, kind: type) -> DataFrame:
    """``block, ids, kinds, matrix``: rows (id, kind, vec) in blocks of about equal size, a record each, ids ascending;
    the matrix is of numbers of ``kind``."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        one = lambda c, kind: pa.array([t.column(c).to_numpy().astype(kind).tobytes()], pa.binary())
        return pa.table({"block": t.column("block")[:1], "ids": one("id", "<i8"), "kinds": one("kind", "<i4"), "matrix": pa.array([x.tobytes()], pa.binary())})

    rows = df.select("id", "kind", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    return rows.groupBy("block").applyInArrow(pack, "block int, ids binary, kinds binary, matrix binary")


def top_columns(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest values; of equal ones the first."""
    if s.shape[1] > k:
        edge = np.partition(s, -k, axis=1)[:, -k][:, None]
        take = s > edge
        tie = s == edge
        take |= tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - take.sum(axis=1)[:, None])
        return np.nonzero(take)
    return np.nonzero(np.ones(s.shape, bool))


class _Best:
    """The k best of each of n seeds, as blocks of rows go by: largest value first, ties by id."""

    def __init__(self, n: int, k: int):
        self.k, self.value, self.id = k, np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)

    def meet(self, first: int, values: np.ndarray, ids: np.ndarray) -> None:
        """values: of the seeds from ``first`` on with the rows of a block, whose ids ascend."""
        edge = self.value[first : first + len(values), -1:]
        hits = values >= edge.astype(values.dtype)
        if np.count_nonzero(hits) > self.k * len(values):  # many at once: only a block's own best can be among them
            r, j = top_columns(values, self.k)
            own = hits[r, j]
            r, j = r[own], j[own]
        else:
            r, j = np.divmod(np.flatnonzero(hits), values.shape[1])
        if not len(r):
            return
        at = np.unique(r)
        row = np.concatenate([r, np.repeat(at, self.k)])
        value = np.concatenate([values[r, j].astype(float), self.value[first + at].ravel()])
        name = np.concatenate([ids[j], self.id[first + at].ravel()])
        order = np.lexsort((name, -value, row))
        row, value, name = row[order], value[order], name[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.value[first + row[keep], place[keep]], self.id[first + row[keep], place[keep]] = value[keep], name[keep]


def best_in_blocks(rows: DataFrame, seeds: DataFrame, k: int, score: Callable, kind: type = np.int8, row_block: int = 4096, seed_block: int = 1 << 16, slice_seeds: int = 512) -> DataFrame:
    """``seed, id, kind, value``: at least the k best rows of each kind for every seed, of any number, of which
    nothing is broadcast or comes to the driver. rows, seeds: (id, kind, vec).

    Seeds and rows are packed into blocks. A task holds one block of seeds and the best that these have met so
    far, and blocks of rows go past it one by one. All rows go past each block of seeds, if possible in one task, so
    it passes on k rows a seed; only few seeds have their rows dealt to several tasks. ``score`` gives, for seeds'
    matrix, rows' matrix and kinds, (kind, columns, values of these) in turn."""
    spark = rows.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    n, m = rows.count(), seeds.count()
    seed_block = max(1, min(seed_block, (1 << 21) // k))  # what a task holds of them
    held = max(1, -(-m // seed_block), min(tasks, -(-m // 256)))
    passing = max(1, -(-n // row_block))
    parts = min(passing, -(-tasks // held))
    cell = lambda of_seeds, of_rows: (of_seeds * parts + of_rows).alias("cell")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("other")
    ours = _packed(seeds, held, kind).select("*", every(parts)).select(cell(F.col("block"), F.col("other")), F.lit(-1).alias("sub"), "ids", "kinds", "matrix")
    theirs = _packed(rows, passing, kind).select("*", every(held)).select(cell(F.col("other"), F.col("block") % parts), F.col("block").alias("sub"), "ids", "kinds", "matrix")

    def found(seed: np.ndarray, best: dict[int, _Best]) -> Iterator[pa.RecordBatch]:
        for c, b in best.items():
            for a in range(0, len(seed), slice_seeds):
                r, j = np.nonzero(b.id[a : a + slice_seeds] >= 0)
                r += a
                yield pa.RecordBatch.from_arrays([pa.array(seed[r]), pa.array(b.id[r, j]), pa.array(np.full(len(r), c, np.int32)), pa.array(b.value[r, j])], ["seed", "id", "kind", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seed, mine, best = None, np.zeros(0, np.int64), None, {}
        for b in batches:
            for i in range(b.num_rows):
                at, sub = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                own = np.frombuffer(b.column(2)[i].as_buffer(), "<i8")
                x = np.frombuffer(b.column(4)[i].as_buffer(), kind).reshape(len(own), -1)
                if sub < 0:
                    yield from found(seed, best)
                    now, seed, mine, best = at, own.copy(), x.copy(), {}
                    continue
                if at != now:  # no seed is in this block
                    continue
                kinds = np.frombuffer(b.column(3)[i].as_buffer(), "<i4")
                for a in range(0, len(seed), slice_seeds):
                    for c, columns, values in score(mine[a : a + slice_seeds], x, kinds):
                        best.setdefault(c, _Best(len(seed), k)).meet(a, values, own[columns])
        yield from found(seed, best)

    dealt = ours.unionByName(theirs).repartition(held * parts, "cell").sortWithinPartitions("cell", "sub")
    return dealt.mapInArrow(run, "seed bigint, id bigint, kind int, value double")


def _dots_by_kind(s: np.ndarray, x: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    wide = np.float32 if s.shape[1] <= 1024 else np.float64  # exact in either
    s, x = s.astype(wide), x.astype(wide)
    for c in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == c)
        yield c, at, s @ x[at].T


def knn_blocks(vectors: DataFrame, seeds: DataFrame, k: int, media: str | None = None, admit: DataFrame | None = None, **blocks: int) -> DataFrame:
    """:func:`knn` for any number of seeds, by :func:`best_in_blocks`, which has the sizes of ``blocks``. With ``admit``
    (id) only such rows are looked at, and others are dropped as they are read."""
    if admit is not None:
        vectors = vectors.join(admit.select("id").distinct(), "id", "left_semi")
    kind = F.col(media).cast("int") if media else F.lit(0)
    near = best_in_blocks(vectors.select("id", kind.alias("kind"), "vec"), seeds.select("id", F.lit(0).alias("kind"), "vec"), k, _dots_by_kind, **blocks)
    near = near.select("seed", "id", F.col("value").cast("bigint").alias("dot"), *([F.col("kind").alias(media)] if media else []))
    rank = F.row_number().over(Window.partitionBy("seed", *[media] * bool(media)).orderBy(F.desc("dot"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def moments(vectors: DataFrame, media: str, column: str = "vec") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Of each media: how many vectors, their sum, and the sum of their outer products, in whole numbers. With
    these the mean and spread of any seed's products with all rows need no scan (A15 for many seeds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                kinds = b.column(0).to_numpy()
                for c in np.unique(kinds).tolist():
                    own = x[kinds == c]
                    got = total.setdefault(c, [0, np.zeros(x.shape[1], np.int64), np.zeros((x.shape[1],) * 2, np.int64)])
                    got[0] += len(own)
                    got[1] += own.sum(0).astype(np.int64)
                    got[2] += (own.T @ own).astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([g[0] for g in total.values()], pa.int64()), pa.array([np.concatenate([g[1], g[2].reshape(-1)]).tolist() for g in total.values()], pa.list_(pa.int64()))], ["kind", "n", "sums"])

    parts = vectors.select(F.col(media).cast("int").alias("kind"), F.col(column).alias("vec")).mapInArrow(run, "kind int, n bigint, sums array<bigint>")
    added = parts.select("kind", "n", F.posexplode("sums")).groupBy("kind", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("x"))
    out = {}
    for r in added.groupBy("kind").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("sums")).collect():  # dim + dim^2 numbers a media
        x = np.array([v.x for v in r.sums], np.int64)
        dim = int((np.sqrt(1 + 4 * len(x)) - 1) / 2 + 0.5)
        out[r.kind] = (r.n, x[:dim], x[dim:].reshape(dim, dim))
    return out


def stats_of_seeds(seeds: DataFrame, of: dict[int, tuple[int, np.ndarray, np.ndarray]], media: str, column: str = "vec") -> DataFrame:
    """``seed, media, mean, sd`` of the dot products of each seed with all other rows of each media. seeds: (id,
    media, vec); of: :func:`moments`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
            mine = (x * x).sum(1)
            for c, (n, total, outer) in of.items():
                own = (b.column(1).to_numpy() == c).astype(np.int64)
                s, ss, many = x @ total - own * mine, ((x @ outer) * x).sum(1) - own * mine * mine, np.maximum(n - own, 1)
                mean = s / many
                sd = np.sqrt(np.maximum(ss * many - s * s, 0)) / many
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), c, np.int32)), pa.array(mean), pa.array(sd)], ["seed", media, "mean", "sd"])

    return seeds.select("id", F.col(media).cast("int").alias(media), F.col(column).alias("vec")).mapInArrow(run, f"seed bigint, {media} int, mean double, sd double")


def pair_dots(pairs: DataFrame, spaces: dict[str, tuple[str, str]]) -> DataFrame:
    """pairs with a dot product for each space, named by its key, of two columns of vectors, which go; null where
    one is null. A batch is one product."""
    gone = [c for ab in spaces.values() for c in ab]
    keep = [c for c in pairs.columns if c not in gone]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keep).schema) + "".join(f", {s} bigint" for s in spaces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b.column(b.schema.get_field_index(c)) for c in keep]
            for a, z in spaces.values():
                x, y = (b.column(b.schema.get_field_index(c)) for c in (a, z))
                whole = x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False)
                dots, at = np.zeros(b.num_rows, np.int64), np.flatnonzero(whole)
                if len(at):
                    p, q = (v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(at), -1) for v in (x, y))
                    dots[at] = np.einsum("ij,ij->i", p, q)
                out.append(pa.array(dots, mask=~whole))
            yield pa.RecordBatch.from_arrays(out, [*keep, *spaces])

    return pairs.mapInArrow(run, schema)
