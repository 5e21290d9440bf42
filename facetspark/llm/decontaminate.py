"""Benchmark decontamination (operator 2).

Every window of ten consecutive words of a benchmark item is hashed into a sorted set that
is broadcast; documents are scanned with the same rolling hash and each hit is verified
word by word. A benchmark beyond ``block`` windows is scanned in blocks, one pass each, so
that what is broadcast has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, give_back_memory, read_table, row_slices, stored
from .tokens import ALNUM_WORDS, Words

WINDOW = 10
_BITS = 20


class WindowSet:
    """Windows of benchmark items: by length and hash, the phrases and the items that have each."""

    def __init__(self) -> None:
        self.found: dict[int, dict[int, dict[bytes, dict[str, None]]]] = {}
        self.size = 0

    def add(self, item: str, k: int, hash_: int, phrase: bytes) -> None:
        items = self.found.setdefault(k, {}).setdefault(hash_, {}).setdefault(phrase, {})
        if item not in items:
            items[item] = None
            self.size += 1

    def tables(self) -> list[tuple[int, np.ndarray, np.ndarray, dict]]:
        """Per length: a bit table over low hash bits (turns away nearly all windows with one
        look-up), the sorted hashes, the phrases."""
        out = []
        for k, by in sorted(self.found.items()):
            hashes = np.sort(np.fromiter(by, np.uint64, len(by)))
            bits = np.zeros(1 << _BITS, bool)
            bits[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
            out.append((k, bits, hashes, by))
        return out


def window_blocks(benchmark: DataFrame, block: int) -> Iterator[tuple[WindowSet, bool]]:
    """Blocks of at most ``block`` windows, and whether each is the last. Items come from Spark a
    partition at a time, and one of many windows may be in several blocks."""

    def windows() -> Iterator[tuple[str, int, int, bytes]]:
        rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where(F.col("text").isNotNull())
        for r in rows.toLocalIterator():
            w = Words(pa.array([r.text]), ALNUM_WORDS)
            if k := min(WINDOW, int(w.counts[0])):
                hashes, at = w.windows(k)
                for h, i in zip(hashes.tolist(), at.tolist(), strict=True):
                    yield r.item, k, h, w.phrase(i, k)

    now, more = WindowSet(), windows()
    ahead = next(more, None)
    while ahead:
        now.add(*ahead)
        ahead = next(more, None)
        if ahead and now.size >= block:
            yield now, False
            now = WindowSet()
    yield now, True


def hits_of(w: Words, tables) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words lie in a benchmark window, and the items found, by row."""
    hit = np.zeros(len(w.hash) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for k, bits, hashes, by in tables:
        h, at = w.windows(k)
        near = np.flatnonzero(bits[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        h, at = h[near], at[near]
        place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        same = hashes[place] == h
        for x, i in zip(h[same].tolist(), at[same].tolist(), strict=True):
            phrase = w.phrase(i, k)
            if known := by[x].get(phrase):
                hit[i] += 1
                hit[i + k] -= 1
                items.setdefault(int(w.row[i]), set()).update(known)
    return np.cumsum(hit[:-1]) > 0, items


def scan(docs: DataFrame, benchmark: DataFrame, block: int = 200_000, with_text: bool = False, carry: bool = False) -> DataFrame:
    """Find benchmark windows in whole texts.

    Returns ``doc_id, n_words, hit_words`` (indices of words inside a window) and ``items``
    (sorted ids), a row for each row of docs; ``with_text`` adds ``clean``, the text without
    the runs of hit words, and ``carry`` adds ``row``, the whole row as a struct.

    Null and empty texts have no words; a very long text is scanned whole, by itself; items without
    words never occur; a null item_id is named ''; of windows that overlap or that several items share
    each counts; repeated documents are scanned each, repeated items count once; an empty table gives
    no rows; other columns, whatever their names, are only carried.
    """
    spark = docs.sparkSession
    out = docs.select("doc_id", "text", F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("items"), *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry)
    kind = out.schema["row"].dataType.simpleString() if carry else ""
    schema = "doc_id bigint, text string, hit_words array<int>, items array<string>, n_words bigint, clean string" + f", row {kind}" * carry
    before = None
    for k, (found, last) in enumerate(window_blocks(benchmark, block)):
        sent = spark.sparkContext.broadcast(found.tables())
        del found

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last, more=k > 0) -> Iterator[pa.RecordBatch]:
            tables = sent.value
            give_back_memory()
            for whole in batches:
                for b in row_slices(whole, "text", 1 << 21):
                    w = Words(b.column(1), ALNUM_WORDS)
                    hit, items = hits_of(w, tables)
                    if more:
                        for row, (words, names) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                            if words:
                                hit[w.first[row] + np.array(words)] = True
                                items.setdefault(row, set()).update(names)
                    n = b.num_rows
                    at = np.flatnonzero(hit)
                    ends = np.searchsorted(at, w.first)
                    hit_words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((at - w.first[w.row[at]]).astype(np.int32)))
                    names = pa.array([sorted(items.get(r, ()), key=lambda s: s.encode()) for r in range(n)], pa.list_(pa.string()))
                    clean = cleaned(b.column(1), w, hit, np.diff(ends)) if last and with_text else pa.nulls(n, pa.string())
                    text = pa.nulls(n, pa.string()) if last else b.column(1)
                    yield pa.RecordBatch.from_arrays([b.column(0), text, hit_words, names, pa.array(w.counts, pa.int64()), clean, *b.columns[4:]], ["doc_id", "text", "hit_words", "items", "n_words", "clean", *["row"] * carry])
            give_back_memory()

        out = out.select("doc_id", "text", "hit_words", "items", *["row"] * carry).mapInArrow(run, schema)
        if not last:  # this block's result is written, and the block and the result before given back
            out = stored(out, "scanned")
            sent.destroy()
            if before is not None:
                drop_stored(before)
            before = out
    return out.select("doc_id", "n_words", "hit_words", "items", *["clean"] * with_text, *["row"] * carry)


def cleaned(texts: pa.Array, w: Words, hit: np.ndarray, n_hit: np.ndarray) -> pa.Array:
    out = texts.to_pylist()
    for row in np.flatnonzero(n_hit):
        lo, hi, base = w.first[row], w.first[row + 1], w.offsets[row]
        raw = w.raw[base : w.offsets[row + 1]].tobytes()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]])))
        kept, at = [], 0
        for a, z in edges.reshape(-1, 2):
            kept.append(raw[at : w.starts[lo + a] - base])
            at = w.ends[lo + z - 1] - base
        out[row] = b"".join([*kept, raw[at:]]).decode()
    return pa.array(out, pa.string())


def remove_documents(docs: DataFrame, benchmark: DataFrame, block: int = 200_000) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that hold no benchmark window. Null and empty
    texts hold none and stay; repeated rows fare alike; without items all rows stay; an empty table stays empty."""
    return scan(docs, benchmark, block, carry=True).where(F.size("hit_words") == 0).select("row.*")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


SQL = {
    "op2_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(i) WHERE len(w) > 0),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(1, len(w) - k + 2)) AS u(i)),
hits AS (SELECT DISTINCT r, i, k, item FROM dw JOIN bw USING (k, g)),
words AS (SELECT r, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + k)) AS u(p) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
}
