"""Removal of repeated byte strings by a distributed suffix merge sort (operator 4).

Every window of ``length`` bytes contains an *anchor*: the start of the window's smallest
k-byte hash. Equal windows have equal anchors at equal places, so it is enough to sort the
suffixes that start at anchors whose k bytes occur twice or more, as far as windows reach that
have them for an anchor.

Each task sorts its suffixes and writes, for each range of the sort order, a front-coded run: of
each suffix the length of the prefix it shares with the one before it, and the rest. Suffixes that
repeat, with the bytes left of them, within a task are marked there, and only one of them goes on. A
range's runs are combined by a loser tree that knows, of each waiting suffix, the prefix it shares
with the suffix put out last: the longer one wins without looking at a byte, and only equals are
compared, from there on. The merged order comes with its common-prefix lengths; together with the
same of the bytes left of the anchors, compared byte by byte too, they tell, for every window around
an anchor, whether it occurs elsewhere.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, drop_table, partitions, read_table, release_shuffles, row_slices, save_table, stored
from .frequency import KEY, Batch, cell_and_rest, cell_bits, shared_hashes
from .tokens import _TABLE, mix, powers, text_bytes


def _slide(x: np.ndarray, w: int, op, pad) -> np.ndarray:
    """op over x[i:i+w] for every i (beyond the end: ``pad``), in three passes."""
    n = len(x)
    rows = -(-(n + w) // w)
    full = np.full(rows * w, pad, x.dtype)
    full[:n] = x
    full = full.reshape(rows, w)
    ahead = op.accumulate(full, axis=1).reshape(-1)
    back = op.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, position in raw, hash, least, most) of the anchors of all windows that lie within a
    row; the windows of an anchor are those that start ``least`` to ``most`` bytes before it."""
    n, w = len(raw), length - k + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, inv = powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * p[:n], out=run[1:])
    h = np.full(n, 2**64 - 1, np.uint64)
    h[: n - k + 1] = np.clip(mix((run[k:] - run[: n - k + 1]) * inv[: n - k + 1]), np.uint64(1), np.uint64(2**64 - 2))
    sizes = np.diff(offsets)
    left = np.repeat(offsets[1:], sizes) - np.arange(n)  # bytes to the end of the row
    h[left < k] = 2**64 - 1
    least = _slide(h, w, np.minimum, np.uint64(2**64 - 1))
    least[left < length] = 0
    # of the windows that contain a position, the largest minimum
    most = _slide(least[::-1], w, np.maximum, np.uint64(0))[::-1]
    row = np.repeat(np.arange(len(sizes)), sizes)
    # windows of other rows can't reach here: their minimum is over positions of their own row
    at = np.flatnonzero(most == h)
    # the windows that contain an anchor and have its hash as their minimum are neighbours: a part
    # of the last run of windows with that minimum that begins at the anchor or before
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], n) - 1
    values, rank = np.unique(least[first], return_inverse=True)
    key = rank * (n + 1) + first
    order = np.argsort(key)
    own = order[np.searchsorted(key[order], np.searchsorted(values, h[at]) * (n + 1) + at, "right") - 1]
    return row[at], at, h[at], at - np.minimum(last[own], at), at - np.maximum(first[own], at - w + 1)


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, of which the first ``at`` bytes are known."""
    end = min(len(a), len(b))
    if a[at:end] == b[at:end]:
        return end
    step = 8
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step >>= 1
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


class Run:
    """A front-coded sorted run, read one string at a time."""

    __slots__ = ("lcps", "sizes", "rest", "i", "at", "now")

    def __init__(self, lcps: np.ndarray, sizes: np.ndarray, rest: bytes):
        self.lcps, self.sizes, self.rest = lcps.tolist(), sizes.tolist(), rest
        self.i, self.at, self.now = -1, 0, b""

    def step(self) -> int:
        """Move to the next string; the prefix it shares with the one before, -1 at the end."""
        self.i += 1
        if self.i == len(self.lcps):
            return -1
        lcp, size = self.lcps[self.i], self.sizes[self.i]
        self.now = self.now[:lcp] + self.rest[self.at : self.at + size]
        self.at += size
        return lcp


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    lcps, prev = np.zeros(len(strings), np.uint16), b""
    for i, s in enumerate(strings):
        lcps[i] = common(prev, s, 0)
        prev = s
    rest = [s[c:] for s, c in zip(strings, lcps.tolist(), strict=True)]
    return lcps, np.array([len(r) for r in rest], np.uint16), b"".join(rest)


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """All strings of the runs in order: (run, place in the run, prefix shared with the string
    before). A loser tree; ``lcp[r]`` is what run r's string shares with the last one put out."""
    m = 1
    while m < len(runs):
        m *= 2
    lcp = [-1] * m  # -1: the run has ended
    for r, run in enumerate(runs):
        lcp[r] = run.step()

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's lcp becomes that with the winner."""
        x, y = lcp[a], lcp[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = runs[a].now, runs[b].now
        c = common(s, t, x)
        if s[c : c + 1] > t[c : c + 1]:
            a, b = b, a
        lcp[b] = c
        return a, b

    losers = [0] * m

    def build(node: int) -> int:
        if node >= m:
            return node - m
        won, losers[node] = play(build(2 * node), build(2 * node + 1))
        return won

    top = build(1)
    while lcp[top] >= 0:
        yield top, runs[top].i, lcp[top]
        lcp[top] = runs[top].step()
        node, top = (top + m) // 2, top
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


RUNS = "range int, lcps binary, sizes binary, rest binary, lefts binary, single binary, ids binary, rids binary, ats binary, stops binary"


def _runs(length: int, k: int, bits: int, cuts: list[bytes], slice_bytes: int, chunk: int):
    """Documents with their shared anchor hashes to front-coded sorted runs, a row a range. Suffixes
    with equal bytes on both sides are one entry, which names no owner: they repeat each other, so
    their marks are made here, in a row with range -1."""
    reach, names = length - k, [c.split()[0] for c in RUNS.split(", ")]
    types = [pa.int32()] + [pa.binary()] * 9
    numbers = lambda part, j: np.array([p[j] for p in part], "<i8")

    def out(held: list[tuple]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        held.sort()
        first = [i for i in range(len(held)) if not i or held[i][:2] != held[i - 1][:2]]
        size = np.diff([*first, len(held)])
        spot = np.array([bisect_right(cuts, held[i][0][:k]) for i in first])
        rows = []
        if (size > 1).any():
            many = [held[i + j] for i, n in zip(first, size.tolist(), strict=True) if n > 1 for j in range(n)]
            at = numbers(many, 4)
            stops = at - np.array([p[5] for p in many]) + length
            rows.append((-1, *[None] * 5, numbers(many, 2).tobytes(), numbers(many, 3).tobytes(), (at - np.array([len(p[1]) for p in many])).astype("<i8").tobytes(), stops.astype("<i8").tobytes()))
        edge = np.flatnonzero(np.diff(spot, prepend=-1))
        for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(first)], strict=True):
            part = [held[i] for i in first[a:z]]
            lcps, sizes, rest = front_code([p[0] for p in part])
            lefts = b"".join(p[1].rjust(reach, b"\0") + len(p[1]).to_bytes(2, "little") for p in part)
            single = size[a:z] == 1
            one = [p for p, alone in zip(part, single.tolist(), strict=True) if alone]
            rows.append((int(spot[a]), lcps.tobytes(), sizes.tobytes(), pack(rest), pack(lefts), single.astype(np.uint8).tobytes(), *[numbers(one, j).tobytes() for j in (2, 3, 4)], None))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for whole in batches:
            for b in row_slices(whole, "text", slice_bytes):
                for i, a, raw, start, least, most in _shared_anchors(b, length, k, bits):
                    held.append((raw[a : a + length - least].tobytes(), raw[a - most : a].tobytes(), i[0], i[1], a - start, least))
                    if len(held) >= chunk:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    return run


def _shared_anchors(b: pa.RecordBatch, length: int, k: int, bits: int):
    """((doc, rid), position, bytes, the row's first byte, least, most) of anchors whose hash is
    among the row's shared hashes."""
    raw, offsets = text_bytes(b.column(2))
    row, at, h, least, most = anchors(raw, offsets, length, k)
    v = cell_and_rest(h, bits) & np.uint64(KEY)
    known = [np.frombuffer(x, "<u8") for x in b.column(3).to_pylist()]
    tag = lambda key, r: mix(key * np.uint64(0x9E3779B97F4A7C15) + r.astype(np.uint64))
    wanted = tag(np.concatenate(known) & np.uint64(KEY), np.repeat(np.arange(b.num_rows), [len(x) for x in known]))
    use = np.flatnonzero(np.isin(tag(v, row), wanted))
    ids = list(zip(b.column(0).fill_null(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    for r, a, lo, hi in zip(row[use].tolist(), at[use].tolist(), least[use].tolist(), most[use].tolist(), strict=True):
        yield ids[r], a, raw, int(offsets[r]), lo, hi


def _cuts(some: DataFrame, length: int, k: int, bits: int, slice_bytes: int, ranges: int, suffixes: int) -> list[bytes]:
    """Where ranges of the sort order begin: quantiles of the first k bytes of a sample of the
    suffixes of which 8 come to the driver for each range (2 beyond 2^17 ranges). Suffixes with
    the same k bytes are never parted, and others with the same fewer bytes are."""
    each = 8 if ranges < 1 << 17 else 2
    rate = np.uint64(max(1, suffixes // (each * ranges)))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in row_slices(whole, "text", slice_bytes):
                found = [(i[1], a, raw[a : a + k].tobytes()) for i, a, raw, *_ in _shared_anchors(b, length, k, bits)]
                where = np.array([f[0] for f in found], np.int64).astype(np.uint64) + np.array([f[1] for f in found], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                take = np.flatnonzero(mix(where) % rate == 0)
                yield pa.RecordBatch.from_arrays([pa.array([found[i][2] for i in take], pa.binary())], ["head"])

    got = sorted(bytes(r.head) for r in some.mapInArrow(heads, "head binary").collect())
    return sorted(set(got[each // 2 :: each])) if len(got) > each else []


MARKS = "doc bigint, rid bigint, start bigint, stop bigint"


def repeated(lcps: np.ndarray, rights: np.ndarray, lefts: np.ndarray, owners: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each suffix in merged order and each o from 0 to length - k: does the window that
    starts o bytes left of the anchor occur elsewhere? ``lefts``: the bytes before each
    anchor, right-aligned, and how many they are. Both sides are told apart by their bytes: by the
    shared prefixes of the merged order, and by those of a sort of the left sides."""
    reach, n = length - k, len(lcps)
    many = lefts[:, -2].astype(np.int64) + 256 * lefts[:, -1].astype(np.int64)
    back = np.ascontiguousarray(lefts[:, :reach][:, ::-1])  # the nearest byte first
    by_left = np.argsort(back.view(f"S{reach}").reshape(-1), kind="stable")
    differ = back[by_left[1:]] != back[by_left[:-1]]
    shared = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), reach)])
    found, left = np.zeros((n, reach + 1), bool), np.zeros(n, np.int64)
    for o in range(reach + 1):
        depth = length - o
        use = np.flatnonzero((rights >= depth) & (many >= o))
        if not len(use):
            continue
        left[by_left] = np.cumsum(shared < o)
        key = np.cumsum(lcps < depth)[use] * (n + 1) + left[use]
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(owners[use][order], new)
        found[use[order], o] = np.repeat(total >= 2, np.diff(np.append(new, len(s))))
    return found


def _sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks made with the runs."""
    for b in batches:
        for r in b.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], "<i8")) for c in ("ids", "rids", "ats", "stops")], ["doc", "rid", "start", "stop"])


def _marks(length: int, k: int):
    reach = length - k

    def resolve(got: list[dict]) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor().decompress
        runs = [Run(np.frombuffer(g["lcps"], np.uint16), np.frombuffer(g["sizes"], np.uint16), unpack(g["rest"])) for g in got]
        base = np.cumsum([0] + [len(r.lcps) for r in runs])
        order, lcps, rights = (np.zeros(base[-1], np.int64) for _ in range(3))
        for i, (r, place, lcp) in enumerate(merge(runs)):
            order[i], lcps[i], rights[i] = base[r] + place, lcp, len(runs[r].now)
        lefts = np.concatenate([np.frombuffer(unpack(g["lefts"]), np.uint8).reshape(-1, reach + 2) for g in got])[order]
        single = np.concatenate([np.frombuffer(g["single"], np.uint8) for g in got]).astype(bool)
        own = (np.cumsum(single) - 1)[order]  # the owner of a single entry
        single = single[order]
        ids, rids, ats = (np.concatenate([np.frombuffer(g[c], "<i8") for g in got]) for c in ("ids", "rids", "ats"))
        found = repeated(lcps, rights, lefts, np.where(single, 1, 2), length, k) & single[:, None]
        # each stretch of repeated windows covers one stretch of bytes
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        i, lo = np.nonzero(edge == 1)
        hi = np.nonzero(edge == -1)[1] - 1
        at = own[i]
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(rids[at]), pa.array(ats[at] - hi), pa.array(ats[at] - lo + length)], ["doc", "rid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["range"] != now:
                    if got:
                        yield resolve(got)
                    now, got = r["range"], []
                got.append(r)
        if got:
            yield resolve(got)

    return run


def _shared_of(b: Batch) -> pa.RecordBatch:
    some = np.flatnonzero(np.diff(b.edge))
    return pa.RecordBatch.from_arrays([pa.array(b.ids[some]), pa.array([b.keys[b.edge[i] : b.edge[i + 1]].astype("<u8").tobytes() for i in some], pa.binary())], ["rid", "keys"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their marks to the bytes that stay."""
    for b in batches:
        kept, removed, spans = [], [], []
        for text, marks in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            raw, at, parts, n = text.encode(), 0, [], 0
            stop = -1
            for m in sorted((m["start"], m["stop"]) for m in marks):
                if m[0] > stop:
                    n += 1
                    parts.append(raw[at : m[0]])
                stop = at = max(stop, m[1])
            parts.append(raw[at:])
            kept.append(b"".join(parts))
            removed.append(len(raw) - len(kept[-1]))
            spans.append(n)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["doc", "rid", "kept", "n_removed", "n_spans"])


def _cut(some: DataFrame, cuts: list[bytes], length: int, k: int, bits: int, slice_bytes: int, chunk: int, parts: int) -> DataFrame:
    """``doc, rid, kept, n_removed, n_spans`` of the texts that lose bytes, stored."""
    runs = stored(some.mapInArrow(_runs(length, k, bits, cuts, slice_bytes, chunk), RUNS), "runs")
    marks = runs.where("range >= 0").repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_marks(length, k), MARKS)
    marks = marks.unionByName(runs.where("range < 0").select("ids", "rids", "ats", "stops").mapInArrow(_sure, MARKS))
    marks = marks.groupBy("rid").agg(F.collect_set(F.struct("doc", "start", "stop")).alias("marks"))
    # equal texts go as wholes, so here a rid and a doc_id name one row
    texts = some.where("c = 1").select(F.coalesce("doc_id", F.lit(0)).alias("doc"), "rid", "text")
    met = texts.join(marks, "rid").select("doc", "rid", "text", F.expr("filter(marks, m -> m.doc = doc)").alias("marks")).where("size(marks) > 0")
    out = stored(met.mapInArrow(_cut_out, "doc bigint, rid bigint, kept binary, n_removed bigint, n_spans bigint"), "cut")
    drop_stored(runs)
    release_shuffles(out.sparkSession)
    return out


def remove_repeats(docs: DataFrame, length: int = 200, k: int = 32, cell_bytes: int = 16 << 20, range_bytes: int = 4 << 20, slice_bytes: int = 1 << 20, chunk: int = 40_000) -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which starts anywhere else too.

    Returns ``doc_id, kept, n_bytes, n_removed, n_spans``; ``kept`` is null where nothing was
    removed (the text is unchanged), and else the bytes that stay, which may end within a
    character. Texts are UTF-8 bytes; null counts as empty; matches never cross rows; repeated
    rows repeat each other; texts shorter than ``length`` stay; very long texts are read whole, one
    text's marks and its bytes in one task; an empty table gives no rows; other columns are not read.

    Equal texts are found by a 128-bit hash and only one of them takes part in the sort. Beyond that
    only texts with an anchor that occurs twice are shuffled. All else is compared byte by byte.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("rid"))
    base = rows.select("doc_id", "rid", F.octet_length("text").cast("bigint").alias("n_bytes"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    base = stored(base, "texts")
    equal = base.where(F.col("n_bytes") >= length).groupBy("t1", "t2").agg(F.count("*").alias("c"), F.min("rid").alias("rid"))
    equal = stored(equal, "equal")
    bits = cell_bits(rows, cell_bytes)

    def extract(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = text_bytes(column)
        row, _, h, _, _ = anchors(raw, offsets, length, k)
        return row, h

    shared = shared_hashes(rows.select("rid", "text"), extract, _shared_of, "rid bigint, keys binary", bits, slice_bytes)
    # were two texts to share a rid, each would have the anchors of both, which does no harm
    shared = shared.groupBy("rid").agg(F.expr("aggregate(collect_set(keys), X'', (a, x) -> concat(a, x))").alias("keys")).join(equal, "rid")
    # kept by rid in buckets, so that the marks can come to the texts later without moving them
    name = f"repeating_{uuid.uuid4().hex}"
    parts = partitions(spark)
    try:
        # a merge join deals the texts by rid, as the buckets are, so each bucket is one file; the other hashes
        # are compared in a form that does not make them join keys
        met = rows.join(shared.hint("merge"), "rid").where("((xxhash64(text) ^ t1) | (xxhash64(1, text) ^ t2)) = 0")
        save_table(met.select("doc_id", "rid", "text", "keys", "c"), name, lambda w: w.bucketBy(parts, "rid"))
        some = spark.table(name)
        release_shuffles(spark)
        volume = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(1, min(int(volume // range_bytes), 1 << 20))
        cuts = _cuts(some, length, k, bits, slice_bytes, ranges, 2 * int(volume) // (length - k)) if ranges > 1 else []
        cut = _cut(some, cuts, length, k, bits, slice_bytes, chunk, max(parts, ranges))
    finally:
        drop_table(spark, name)
    copies = equal.where("c > 1").select("t1", "t2", F.lit(True).alias("copied"))
    out = base.join(copies, ["t1", "t2"], "left").withColumn("doc", F.coalesce("doc_id", F.lit(0))).join(cut, ["doc", "rid"], "left")
    gone = F.coalesce("copied", F.lit(False))
    return out.select(
        "doc_id",
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        "rid",
    )


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(F.xxhash64("doc_id", text).alias("rid"), F.col("doc_id").alias("d"), F.sha2(text.cast("binary"), 256).alias("sha")).distinct()
    out = remove_repeats(docs)
    out = out.join(whole, (out.rid == whole.rid) & out.doc_id.eqNullSafe(whole.d), "left")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce(F.sha2("kept", 256), "sha").alias("kept_sha256"))


def brute(rows: list[tuple[int, bytes]], length: int = 200) -> list[tuple]:
    """The same by looking at every window (for tests)."""
    seen: dict[bytes, int] = {}
    for _, t in rows:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
