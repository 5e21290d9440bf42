"""Best-fit packing of tokenised documents into fixed-length sequences (operator 9).

Each task tokenises its documents and packs their pieces online into a fixed number of open
bins. The bins' free spaces are a bitset (one bit for each amount of free space), so the
tightest bin with room is found with one shift and one lowest-bit step. When no bin has
room and all are open, the fullest closes. Bins still open when a task ends are few; their
pieces are packed once more, largest first, in a second stage.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back_memory, read_table, row_slices, stored

END = 0  # the id put after each document
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, open boolean"


class Tokens:
    """Ids of texts under a byte-level BPE vocabulary file of the ``tokenizers`` library.

    Where the same vocabulary is at hand as a rank file, texts that hold none of its special
    tokens go through ``tiktoken``, which gives the same ids at five times the speed; all
    others go through ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def default_tokens() -> Tokens:
    """The public 50k byte-level vocabulary, wherever it is installed on this machine."""
    import public_tokenizers as p

    return Tokens(p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else full pieces behind a
    first one that holds the remainder."""
    first = n if n <= size else n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


class OpenBins:
    """At most ``bins`` open bins of ``size`` tokens. ``add`` gives (bin, offset)."""

    def __init__(self, size: int, bins: int, first_id: int):
        self.size, self.bins, self.next = size, bins, first_id
        self.free = 0  # bit f is set if an open bin has f tokens free
        self.by_free: dict[int, list[int]] = {}
        self.count = 0

    def _take(self, f: int) -> int:
        stack = self.by_free[f]
        b = stack.pop()
        if not stack:
            del self.by_free[f]
            self.free &= ~(1 << f)
        self.count -= 1
        return b

    def add(self, length: int) -> tuple[int, int, int | None]:
        """Place a piece: its bin, its offset there, and the bin closed to make room, if any."""
        closed = None
        fits = self.free >> length
        if fits:
            f = length + ((fits & -fits).bit_length() - 1)
            b = self._take(f)
        else:
            f, b = self.size, self.next
            self.next += 1
            if length < self.size and self.count >= self.bins:
                fullest = (self.free & -self.free).bit_length() - 1
                closed = self._take(fullest)
        left = f - length
        if left:
            self.free |= 1 << left
            self.by_free.setdefault(left, []).append(b)
            self.count += 1
        return b, self.size - f, closed

    def open(self) -> set[int]:
        return {b for stack in self.by_free.values() for b in stack}


def tokenise_and_pack(docs: DataFrame, size: int, bins: int, tokens=default_tokens, with_ids: bool = False) -> DataFrame:
    """First stage: one row a piece with its bin. ``open`` marks pieces of bins that were
    open when the task ended. ``with_ids`` adds the ids themselves."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = tokens()
        packer = OpenBins(size, bins, TaskContext.get().partitionId() << 32)
        held: dict[int, list[tuple]] = {}  # pieces of open bins; at most bins * size of them
        done: list[tuple] = []

        def rows(pieces: list[tuple], is_open: bool) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=False)] + [pa.array([is_open] * len(pieces))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "open"]
            if with_ids:
                arrays.append(pa.array([c.astype(np.int32) for c in cols[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for whole in batches:
            for batch in row_slices(whole, "text", 1 << 20):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.append(tok.ids(text or ""), np.uint32(END)).astype("<u4")
                    for k, (start, n) in enumerate(cut(len(ids), size)):
                        part = ids[start : start + n]
                        b, offset, closed = packer.add(n)
                        if closed is not None:
                            done += held.pop(closed)
                        piece = (doc, k, start, n, zlib.crc32(part.tobytes()), b, offset) + ((part,) if with_ids else ())
                        if offset + n < size:
                            held.setdefault(b, []).append(piece)
                        else:
                            done += held.pop(b, [])
                            done.append(piece)
                if len(done) >= (256 if with_ids else 8192):
                    yield rows(done, False)
                    done = []
        if done:
            yield rows(done, False)
        if held:
            yield rows([p for b in held.values() for p in b], True)
        del tok
        give_back_memory()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, size: int = 2048, bins: int = 1024, tokens=default_tokens, with_ids: bool = False, again: int = 200_000) -> DataFrame:
    """Pack documents into sequences of at most ``size`` tokens.

    Returns a row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``
    (and ``ids`` if asked for). A null or empty text is a document of the end id alone; a very long
    one is cut into full pieces behind its first; of bins equally full the one touched last takes a
    piece; repeated rows are packed each; an empty table gives no rows; other columns, whatever their
    names, are not read.
    A task holds at most ``bins`` open bins. ``again`` is the number of left-over pieces that
    one task of the second stage takes.
    """
    first = stored(tokenise_and_pack(docs, size, bins, tokens, with_ids), "pieces")
    left = first.where("open").drop("bin", "offset", "open")
    n = first.where("open").count()
    base = 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        all_rows = list(batches)
        if not all_rows:
            return
        table = pa.Table.from_batches(all_rows).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        packer = OpenBins(size, bins, base + (TaskContext.get().partitionId() << 32))
        placed = [packer.add(x)[:2] for x in table.column("length").to_pylist()]
        table = table.append_column("sequence_id", pa.array([b for b, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        yield from table.to_batches()

    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids + ", sequence_id bigint, offset bigint"
    second = left.repartition(-(-max(n, 1) // again), F.xxhash64("doc_id", "piece", "ids_crc32")).mapInArrow(run, kinds)
    return first.where("not open").withColumnRenamed("bin", "sequence_id").select(cols).unionByName(second.select(cols))


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
