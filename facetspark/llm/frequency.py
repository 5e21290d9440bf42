"""Document frequencies of hashed features, answered only where they are two or more.

Each task packs its documents' hashes, a batch at a time, for the *cells* of the hash space
(6 bytes a hash); a cell counts and sends back, batch by batch, the hashes that occur at
least twice. What occurs once costs one packed hash and no answer. A hash that many
documents of a batch have is a single weighted entry, so a frequent one makes a cell grow
with the number of batches, not of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, partitions, release_shuffles, row_slices, stored

REST = 48  # hash bits that a cell stores; the cell's number is further bits, and 64 are all there are
HOT = 65535  # in the place of a row: an entry for many rows of the batch
KEY = (1 << 56) - 1


def rest_bits(cell_bits: int) -> int:
    return min(REST, 64 - cell_bits)


def cell_and_rest(h: np.ndarray, cell_bits: int) -> np.ndarray:
    """The hash's first bits: those of the cell before those that it stores."""
    return h >> np.uint64(64 - rest_bits(cell_bits) - cell_bits)


def _pack(v: np.ndarray) -> bytes:
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : REST // 8].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    six = np.frombuffer(b, np.uint8).reshape(-1, REST // 8)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, : REST // 8] = six
    return out.reshape(-1).view("<u8")


def _pack_counts(counts: np.ndarray) -> bytes:
    """The counts in as few bytes each as the largest asks for, after a byte that says how many."""
    top = counts.max(initial=0)
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _unpack_counts(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1)


ENTRIES = "cell int, batch bigint, rest binary, counts binary, weights binary, ids binary, sizes binary, hot binary, hot_rows binary"


def _entries(cell_bits: int, extract: Callable, slice_bytes: int, hot: int):
    """Texts to entries: a row a batch of documents with their ids and sizes (cell -1), and a
    row a batch and cell with the batch's shingles there. A shingle of ``hot`` or more of the
    batch's documents is one weighted entry; which documents those are stays with the batch."""
    from pyspark import TaskContext

    rest = np.uint64(rest_bits(cell_bits))
    names = ["cell", "batch", "rest", "counts", "weights", "ids", "sizes", "hot", "hot_rows"]
    types = [pa.int32(), pa.int64()] + [pa.binary()] * 7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 24
        for whole in batches:
            for b in row_slices(whole, "text", slice_bytes):
                rows, h = extract(b.column(1))
                v = cell_and_rest(h, cell_bits)
                n = b.num_rows
                ids = b.column(0)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                id_bytes = ids.fill_null(0).to_numpy().astype("<i8").tobytes() + null.astype(np.uint8).tobytes()
                order = np.lexsort((rows, v))
                sv, sr = v[order], rows[order]
                first = np.flatnonzero(np.concatenate([[True], sv[1:] != sv[:-1]])) if len(sv) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(sv)))
                many = count >= hot
                is_hot = np.repeat(many, count)
                hot_v = sv[first[many]]
                out = [(-1, serial, None, None, None, id_bytes, np.bincount(rows, minlength=n).astype("<i4").tobytes(), sv[is_hot].astype("<u8").tobytes(), sr[is_hot].astype("<u2").tobytes())]
                cv, cr = sv[~is_hot], sr[~is_hot]
                cell, hot_cell, hot_count = (cv >> rest).astype(np.int64), (hot_v >> rest).astype(np.int64), count[many]
                order = np.lexsort((cr, cell))
                cv, cr, cell = cv[order], cr[order], cell[order]
                cells = np.union1d(cell, hot_cell)
                lo, hi = np.searchsorted(cell, cells), np.searchsorted(cell, cells, "right")
                hlo, hhi = np.searchsorted(hot_cell, cells), np.searchsorted(hot_cell, cells, "right")
                for c, a, z, ha, hz in zip(cells.tolist(), lo, hi, hlo, hhi, strict=True):
                    per_row = _pack_counts(np.bincount(cr[a:z], minlength=n))
                    out.append((c, serial, _pack(np.concatenate([cv[a:z], hot_v[ha:hz]]) & ((np.uint64(1) << rest) - np.uint64(1))), per_row, hot_count[ha:hz].astype("<u4").tobytes(), None, None, None, None))
                serial += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


ANSWERS = "batch bigint, rows binary, keys binary, ids binary, sizes binary, hot binary, hot_rows binary"


def _answer(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Cells: for each batch, which of its shingles two or more documents have. A key is the
    shingle's document frequency (its logarithm, in quarters) before 56 bits of its hash, so that
    keys sort rarest first."""
    names = ["batch", "rows", "keys", "ids", "sizes", "hot", "hot_rows"]
    types = [pa.int64()] + [pa.binary()] * 6

    def cell(c: int, got: list[dict]) -> pa.RecordBatch | None:
        rest, row, src, weight = [], [], [], []
        for i, g in enumerate(got):
            v, per_row, w = _unpack(g["rest"]), _unpack_counts(g["counts"]), np.frombuffer(g["weights"], "<u4")
            rest.append(v)
            row.append(np.concatenate([np.repeat(np.arange(len(per_row), dtype=np.uint16), per_row), np.full(len(w), HOT, np.uint16)]))
            src.append(np.full(len(v), i, np.int32))
            weight.append(np.concatenate([np.ones(len(v) - len(w), np.uint32), w]))
        rest, row, src, weight = map(np.concatenate, (rest, row, src, weight))
        order = np.argsort(rest, kind="stable")
        rest = rest[order]
        first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
        df = np.add.reduceat(weight[order].astype(np.int64), first)
        length = np.diff(np.append(first, len(rest)))
        shared = np.repeat(df >= 2, length)
        if not shared.any():
            return None
        level = np.repeat(np.minimum(255, (4 * np.log2(np.maximum(df, 1))).astype(np.uint64)), length)[shared]
        keys = (level << np.uint64(56)) | (((np.uint64(c) << np.uint64(rest_bits(bits))) | rest[shared]) & np.uint64(KEY))
        at = order[shared]
        row, src = row[at], src[at]
        order = np.lexsort((keys, row, src))
        row, src, keys = row[order], src[order], keys[order]
        edge = np.searchsorted(src, np.arange(len(got) + 1))
        out = [(got[i]["batch"], row[a:z].astype("<u2").tobytes(), keys[a:z].astype("<u8").tobytes()) for i, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if z > a]
        cols = list(zip(*out, strict=True)) + [[None] * len(out)] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)

    now, got = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["cell"] < 0:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((r["batch"], None, None, r["ids"], r["sizes"], r["hot"], r["hot_rows"]), types, strict=True)], names)
                continue
            if r["cell"] != now:
                if got and (out := cell(now, got)):
                    yield out
                now, got = r["cell"], []
            got.append(r)
    if got and (out := cell(now, got)):
        yield out


class Batch:
    """A batch of documents with their answers: ``ids`` (and where they are ``null``),
    ``size`` (hashes of each), and ``keys``, sorted by document, then rarest first; document
    i has ``keys[edge[i]:edge[i + 1]]``."""

    def __init__(self, serial: int, got: list[dict]):
        head = next(g for g in got if g["ids"] is not None)
        self.serial, self.n = serial, len(head["sizes"]) // 4
        self.size = np.frombuffer(head["sizes"], "<i4").astype(np.int64)
        self.ids = np.frombuffer(head["ids"][: 8 * self.n], "<i8")
        self.null = np.frombuffer(head["ids"][8 * self.n :], np.uint8).astype(bool)
        rows = np.concatenate([np.zeros(0, np.uint16)] + [np.frombuffer(g["rows"], "<u2") for g in got if g["rows"]])
        keys = np.concatenate([np.zeros(0, np.uint64)] + [np.frombuffer(g["keys"], "<u8") for g in got if g["rows"]])
        wide = rows == HOT
        if wide.any():  # the batch knows which of its documents have the frequent hash
            hot = np.frombuffer(head["hot"], "<u8") & np.uint64(KEY)
            hot_rows = np.frombuffer(head["hot_rows"], "<u2")
            order = np.argsort(hot, kind="stable")
            hot, hot_rows = hot[order], hot_rows[order]
            own = keys[wide] & np.uint64(KEY)
            lo, hi = np.searchsorted(hot, own), np.searchsorted(hot, own, "right")
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            rows = np.concatenate([rows[~wide], hot_rows[at]])
            keys = np.concatenate([keys[~wide], np.repeat(keys[wide], hi - lo)])
        order = np.lexsort((keys, rows))
        self.keys = keys[order]
        self.edge = np.searchsorted(rows[order], np.arange(self.n + 1))


def _regroup(make: Callable[[Batch], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["batch"] != now:
                    if got:
                        yield make(Batch(now, got))
                    now, got = r["batch"], []
                got.append(r)
        if got:
            yield make(Batch(now, got))

    return run


def cell_bits(docs: DataFrame, cell_bytes: int) -> int:
    """Bits of the cell number, so that a cell stands for ``cell_bytes`` bytes of text (at most 24:
    beyond 2^24 cells they grow)."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(24, max(4, int(np.ceil(np.log2(total / cell_bytes + 1)))))


def shared_hashes(docs: DataFrame, extract: Callable, make: Callable[[Batch], pa.RecordBatch], schema: str, bits: int, slice_bytes: int = 1 << 21, hot: int = 64) -> DataFrame:
    """``make`` of every batch, stored. docs: (a bigint id, text); extract: of a column of
    texts, the row and hash of each feature; a document that has a hash twice counts twice."""
    spark = docs.sparkSession
    parts = max(partitions(spark), min(1 << bits, 1 << 20) // 8)
    entries = docs.mapInArrow(_entries(bits, extract, slice_bytes, hot), ENTRIES)
    spread = F.when(F.col("cell") < 0, F.pmod(F.xxhash64("batch"), F.lit(1 << bits)).cast("int")).otherwise(F.col("cell"))
    answers = stored(entries.repartition(parts, spread).sortWithinPartitions("cell").mapInArrow(lambda batches: _answer(batches, bits), ANSWERS), "answers")
    release_shuffles(spark)
    out = stored(answers.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(_regroup(make), schema), "shared")
    drop_stored(answers)
    release_shuffles(spark)
    return out
