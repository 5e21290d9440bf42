"""Phrase collocations from word-id suffix arrays (operator 13).

1. A shard (a slice of a task's texts) becomes one sequence of word ids. Prefix doubling ranks its
   suffixes by their first 1, 2, 4 and 5 words; the common prefixes of neighbours in that order are cut
   into intervals, and an interval of k common words is a phrase of k words with its count.
2. A shard hands on each of its phrases once: eight bytes of hash, to one of the *cells* of the hash
   space, with a count only where it is over one. However frequent a phrase, a shard has one entry of it. A
   cell adds up the counts; of a phrase that is frequent over all shards it names one text that has it.
3. This is done twice: for words and pairs, and then for longer phrases, of which all pairs must be
   frequent. A bitmap of the frequent pairs' hashes, of a fixed size at most, is broadcast for that: what it
   lets through in error is counted in vain, nothing is lost.
4. The texts named are read again for the phrases' words. All else (cuts, scores, phrases inside others,
   the best of each language) are joins and aggregates over the frequent phrases alone.

Phrases are told apart by 64 bits of hash beside the cell's, words by 64.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read_table, release_shuffles, row_slices, stored
from .tokens import Words, mix

BREAKS = np.zeros(256, bool)  # bytes that end a piece
BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
#: Bytes of words: all but blanks, tabs and what ends a piece.
PIECE_WORDS = ~BREAKS
PIECE_WORDS[[9, 32]] = False

_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


class Shard:
    """The words of some texts with the languages of their rows, as a sequence to sort suffixes of."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        self.words = w = Words(texts, PIECE_WORDS)
        n = len(w.hash)
        self.row = w.row
        piece = np.concatenate([[0], np.cumsum(BREAKS[w.low])])[w.starts] if n else np.zeros(0, np.int64)
        last = np.ones(n, bool)
        last[:-1] = (piece[1:] != piece[:-1]) | (w.row[1:] != w.row[:-1])
        ends = np.flatnonzero(last)
        #: words from each to the end of its piece
        self.left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1
        kinds = langs.dictionary_encode()
        names = kinds.dictionary.to_pylist()
        salt = Words(pa.array([f"{x} " for x in names], pa.string()), np.ones(256, bool)).hash if names else np.zeros(0, np.uint64)
        self.lang = kinds.indices.to_numpy(zero_copy_only=False)[w.row] if n else np.zeros(0, np.int64)
        self.names = names
        # a word of another language is another word
        self.hash = mix(w.hash ^ salt[self.lang]) if n else w.hash

    def suffixes(self, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array by the first ``longest`` words of a piece, and of each suffix the words it shares
        with the one before it (no more than ``longest``)."""
        n = len(self.hash)
        ids = np.unique(self.hash, return_inverse=True)[1].astype(np.int64)
        rank, known, place = ids, 1, np.arange(n)
        while known < longest and n:
            step = min(known, longest - known)  # ranks of `known` words and, behind them, of `step` words
            ahead = np.zeros(n, np.int64)
            inside = np.flatnonzero(self.left > known)
            ahead[inside] = (rank if step == known else _again(ids, self.left, step))[inside + known] + 1
            rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            known += step
        order = np.argsort(rank, kind="stable") if n else place
        common = np.zeros(n, np.int64)
        alive = np.ones(max(n - 1, 0), bool)
        a, b = order[:-1], order[1:]
        for j in range(longest):
            alive &= (self.left[a] > j) & (self.left[b] > j)
            at = np.flatnonzero(alive)
            alive[at] = ids[a[at] + j] == ids[b[at] + j]
            common[1:] += alive
        return order, common

    def phrases(self, shortest: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each k from ``shortest`` to ``longest``: the first place of each phrase of k words, and its count."""
        order, common = self.suffixes(longest)
        for k in range(shortest, longest + 1):
            use = self.left[order] >= k
            first = np.flatnonzero((common < k)[use])
            yield k, order[use][first], np.diff(np.append(first, use.sum()))

    def keys(self, at: np.ndarray, k: int, step: np.uint64 = _STEPS[0]) -> np.ndarray:
        """A hash of the k words from each place."""
        acc = np.zeros(len(at), np.uint64)
        for j in range(k):
            acc = acc * step + self.hash[at + j]
        return mix(acc ^ np.uint64(k) ^ step)

    def only(self, bitmap: np.ndarray) -> Shard:
        """The shard without the words that are in no phrase of three or more words all of whose pairs may
        be in the bitmap; pieces end where a pair is not."""
        n = len(self.hash)
        good = np.zeros(n + 1, bool)
        pairs = np.flatnonzero(self.left > 1)
        good[pairs] = _in_bitmap(self.keys(pairs, 2), bitmap)
        ends = np.flatnonzero(~good[:n])
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1 if n else self.left
        inner = np.concatenate([[False], good[: n - 1]]) if n else good[:0]
        start = np.maximum.accumulate(np.where(~inner, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        use = np.flatnonzero(left[start] >= 3) if n else start
        out = object.__new__(Shard)
        out.words, out.names, out.row, out.lang, out.hash, out.left = self.words, self.names, self.row[use], self.lang[use], self.hash[use], left[use]
        return out


def _in_bitmap(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _again(ids: np.ndarray, left: np.ndarray, words: int) -> np.ndarray:
    """Ranks by the first ``words`` words, by single steps (words is small)."""
    rank, n = ids, len(ids)
    for j in range(1, words):
        ahead = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > j)
        ahead[inside] = ids[inside + j] + 1
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
    return rank


ENTRIES = "cell int, lang string, n bigint, keys binary, per_row binary, rids binary, many binary, rows binary"
_NAMES = ["cell", "lang", "n", "keys", "per_row", "rids", "many", "rows"]
_TYPES = [pa.int32(), pa.string(), pa.int64()] + [pa.binary()] * 5


def _entries(bits: int, shortest: int, longest: int, slice_bytes: int, sent=None):
    """Shards to entries: a row a language with its number of words (cell -1), and a row a cell with the
    shard's phrases there: those that occur once, text by text, before the others and their counts. With a
    bitmap, phrases of three or more words that it lets through, and no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in row_slices(whole, "text", slice_bytes):
                shard, out = Shard(b.column(2), b.column(1)), []
                if sent is None:
                    words = np.bincount(shard.lang, minlength=len(shard.names))
                    out = [(-1, name, int(n), *[None] * 5) for name, n in zip(shard.names, words.tolist(), strict=True) if n]
                else:
                    shard = shard.only(sent.value)
                keys, cells, rows, counts = [], [], [], []
                for k, at, count in shard.phrases(shortest, longest):
                    keys.append(shard.keys(at, k))
                    cells.append((shard.keys(at, k, _STEPS[1]) >> np.uint64(64 - bits)).astype(np.int32))
                    rows.append(shard.row[at].astype(np.int32))
                    counts.append(count)
                keys, cells, rows, counts = map(np.concatenate, (keys, cells, rows, counts))
                order = np.lexsort((rows, counts > 1, cells))
                keys, cells, rows, counts = keys[order], cells[order], rows[order], counts[order]
                rids = b.column(0).to_numpy()
                edge = np.append(np.flatnonzero(np.diff(cells, prepend=-1)), len(cells))
                for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    m = z - int((counts[a:z] > 1).sum())  # from here on: more than once
                    mine, per_row = np.unique(rows[a:m], return_counts=True)
                    known = np.union1d(mine, rows[m:z])
                    size = np.zeros(len(known), "<u4")
                    size[np.searchsorted(known, mine)] = per_row
                    out.append((int(cells[a]), None, None, keys[a:z].astype("<u8").tobytes(), size.tobytes(), rids[known].astype("<i8").tobytes(), counts[m:z].astype("<u4").tobytes(), np.searchsorted(known, rows[m:z]).astype("<u4").tobytes()))
                for i in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i : i + 64], strict=True), _TYPES, strict=True)], _NAMES)

    return run


FREQUENT = "rid bigint, h bigint, f bigint, lang string, n bigint"


def _found(rid, h, f, lang=None, n=None) -> pa.RecordBatch:
    nothing = [None] * len(f if lang is None else lang)
    return pa.RecordBatch.from_arrays([pa.array(nothing if x is None else x, t) for x, t in ((rid, pa.int64()), (h, pa.int64()), (f, pa.int64()), (lang, pa.string()), (n, pa.int64()))], ["rid", "h", "f", "lang", "n"])


def _add(cell: list[dict], least: int) -> pa.RecordBatch:
    """A cell's phrases of ``least`` occurrences or more, each with a text that has it (the smallest rid)."""
    keys, counts, rids = [], [], []
    for e in cell:
        k, per_row, own = np.frombuffer(e["keys"], "<u8"), np.frombuffer(e["per_row"], "<u4"), np.frombuffer(e["rids"], "<i8")
        many, rows = np.frombuffer(e["many"], "<u4"), np.frombuffer(e["rows"], "<u4")
        keys.append(k)
        counts.append(np.concatenate([np.ones(len(k) - len(many), np.int64), many]))
        rids.append(np.concatenate([np.repeat(own, per_row), own[rows]]))
    keys, counts, rids = map(np.concatenate, (keys, counts, rids))
    order = np.argsort(keys, kind="stable")
    keys, counts, rids = keys[order], counts[order], rids[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(counts, first)
    some = np.flatnonzero(total >= least)
    return _found(np.minimum.reduceat(rids, first)[some], keys[first[some]].view(np.int64), total[some])


def _merged(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["cell"] < 0:
                    yield _found(None, None, None, [r["lang"]], [r["n"]])
                    continue
                if r["cell"] != now:
                    if held:
                        yield _add(held, least)
                    now, held = r["cell"], []
                held.append(r)
        if held:
            yield _add(held, least)

    return run


CHUNK = 1 << 16  # bytes of a bitmap that one task makes


def _bitmap(found: DataFrame, most_bytes: int) -> np.ndarray:
    """A bitmap of the hashes: sixteen bits each, ``most_bytes`` at most. It is made in pieces by Spark."""
    n = found.count()
    size = min(most_bytes, max(CHUNK, 1 << (2 * n).bit_length()))
    at = found.select(F.col("h").bitwiseAND(8 * size - 1).alias("at"))
    at = at.select(F.floor(F.col("at") / (8 * CHUNK)).alias("chunk"), (F.col("at") % (8 * CHUNK)).alias("at"))

    def pack(t: pa.Table) -> pa.Table:
        bits = np.zeros(8 * CHUNK, bool)
        bits[t.column("at").to_numpy()] = True
        return pa.table({"chunk": t.column("chunk")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(size, np.uint8)
    for r in at.distinct().groupBy("chunk").applyInArrow(pack, "chunk bigint, bits binary").toLocalIterator():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.bits, np.uint8)
    return out


PHRASES = "lang string, words array<string>, f bigint"


def _spelt(longest: int):
    """Texts with the hashes of phrases wanted from them to these phrases' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in row_slices(whole, "text", 1 << 20):
                shard = Shard(b.column(2), b.column(1))
                asked = b.column(3)
                row = np.repeat(np.arange(b.num_rows), asked.value_lengths().to_numpy())
                h, f = (asked.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(2))
                want = {x: i for i, x in enumerate(zip(row.tolist(), h.view(np.uint64).tolist(), strict=True))}
                out, places = {}, np.arange(len(shard.hash))
                for k in range(1, longest + 1):
                    at = places[shard.left >= k]
                    keys = shard.keys(at, k)
                    near = np.flatnonzero(np.isin(keys, h.view(np.uint64)))
                    near = near[np.unique(np.stack([shard.row[at[near]].astype(np.uint64), keys[near]]), axis=1, return_index=True)[1]]
                    for p, x in zip(at[near].tolist(), keys[near].tolist(), strict=True):
                        if (i := want.get((int(shard.row[p]), x))) is not None and i not in out:
                            out[i] = (shard.names[shard.lang[p]], [shard.words.low[shard.words.starts[j] : shard.words.ends[j]].tobytes().decode() for j in range(p, p + k)], int(f[i]))
                if out:
                    cols = list(zip(*out.values(), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.int64())], ["lang", "words", "f"])

    return run


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to ``longest`` words that occur ``least`` times or more; the first ``top`` of a language."""

    longest: int = 5
    least: int = 100
    top: int = 2000
    scale: int = 1000


def phrase_counts(docs: DataFrame, m: Mining = Mining(), cell_bytes: int = 2 << 20, slice_bytes: int = 2 << 20, bitmap_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """``lang, n`` and, stored, ``lang, words, f``: all words of a language, and its phrases of 1 to
    ``longest`` words that occur ``least`` times or more, with their counts."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("lang", "text").alias("rid"), "lang", "text")
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(20, max(4, int(np.ceil(np.log2(total / cell_bytes + 1)))))
    parts = max(partitions(spark), 1 << min(bits, 18))

    def count(entries) -> DataFrame:
        cell = F.when(F.col("cell") < 0, F.pmod(F.xxhash64("lang", "n"), F.lit(1 << bits)).cast("int")).otherwise(F.col("cell"))
        dealt = rows.mapInArrow(entries, ENTRIES).repartition(parts, cell).sortWithinPartitions("cell")
        out = stored(dealt.mapInArrow(_merged(m.least), FREQUENT), "frequent")
        release_shuffles(spark)
        return out

    short = count(_entries(bits, 1, min(2, m.longest), slice_bytes))
    n = short.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    found = short.where("n is null")
    if m.longest > 2:
        sent = spark.sparkContext.broadcast(_bitmap(found, bitmap_bytes))
        found = found.unionByName(count(_entries(bits, 3, m.longest, slice_bytes, sent)))
        sent.destroy()
    asked = found.groupBy("rid").agg(F.collect_list(F.struct("h", "f")).alias("asked"))
    # equal texts share a rid; one of them is enough
    told = rows.join(asked, "rid").select("rid", "lang", "text", "asked").mapInArrow(_spelt(m.longest), PHRASES)
    return n, stored(told.groupBy("lang", "words").agg(F.max("f").alias("f")), "spelt")


def collocations(docs: DataFrame, m: Mining = Mining(), **options) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: of each language the first ``top`` phrases of 2 to
    ``longest`` words by how much more often their parts stand together than apart.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and these into words at
    blanks and tabs; phrases lie within a piece and overlap. n counts a language's words, a a phrase's
    occurrences (at least ``least``), l and r those of its two parts. A phrase is cut where its score,
    floor(scale * a * n / (l * r)), is lowest, at the first such place. Phrases that lie inside a longer one
    as frequent as they are are left out. Equal scores are ranked by a, then by the bytes of the phrase.

    A null text is empty, a null language is ``und``; empty texts have no words; a very long text is a
    shard of its own, sorted in one task; repeated rows count each; an empty table gives no rows; doc_id and
    other columns are not read. Scores are computed in decimals of 38 digits, which is exact for up to
    10^14 words of a language.

    A shard has at most ``slice_bytes`` of text, or one text; a cell stands for ``cell_bytes`` of text; the
    bitmap has ``bitmap_bytes`` at most. Beyond some 16 million frequent pairs it lets more through.
    """
    n, told = phrase_counts(docs, m, **options)
    return scored(n, told, m)


def scored(n: DataFrame, told: DataFrame, m: Mining = Mining()) -> DataFrame:
    """:func:`collocations` from the counts of words (lang, n) and of frequent phrases (lang, words, f)."""
    name = F.array_join("words", " ")
    counts = told.select("lang", name.alias("phrase"), "f")
    long = told.where(F.size("words").between(2, m.longest)).select("lang", "words", name.alias("phrase"), F.col("f").alias("a"))
    cuts = long.select("lang", "phrase", "a", F.size("words").alias("size"), F.col("words"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " ").alias("rest"))
    part = lambda side, c: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(c))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(n, "lang")
    score = F.expr(f"(cast(a as decimal(15,0)) * {m.scale}BD * cast(n as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    cuts = cuts.withColumn("score", score.cast("bigint"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    # a phrase inside a longer one that is as frequent
    size = F.size("words")
    inner = long.where(size > 2).select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda w: F.transform(F.sequence(F.lit(1), size - w + 1), lambda s: F.array_join(F.slice("words", s, w), " "))))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    best = best.join(inner, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < 100 * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = best.withColumn("rank", rank).where(F.col("rank") <= m.top)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def brute(rows: list[tuple[str | None, str | None]], m: Mining = Mining()) -> list[tuple]:
    """The same by counting all phrases (for tests). rows: (lang, text)."""
    import re

    count: dict[str, Counter] = {}
    for lang, text in rows:
        own = count.setdefault("und" if lang is None else lang, Counter())
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(w[i : i + k]) for k in range(1, m.longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cand = {p: c for p, c in f.items() if len(p) > 1 and c >= m.least}
        inside = {p[i : i + k] for p, c in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= 100 * f[p[i : i + k]]}
        rows_ = []
        for p, a in cand.items():
            if p not in inside:
                s, k = min((m.scale * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[: m.top])]
    return sorted(out)


SQL = {
    "op13_collocations": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, any_value(w[i:i + k - 1]) AS words, count(*) AS f FROM p, unnest(range(1, 6)) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, phrase, words, f FROM f WHERE f >= 100), -- parts are as frequent as their phrases at least
c AS (SELECT * FROM g WHERE k > 1),
parts AS (SELECT lang, phrase, f AS a, j, array_to_string(words[1:j], ' ') AS head, array_to_string(words[j + 1:], ' ') AS tail FROM c, unnest(range(1, k)) AS u(j)),
cuts AS (SELECT lang, parts.phrase, a, j, x.f AS l, y.f AS r, n, CAST((1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
         FROM parts JOIN n USING (lang) JOIN g x USING (lang) JOIN g y USING (lang) WHERE x.phrase = head AND y.phrase = tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT DISTINCT c.lang, array_to_string(c.words[s:s + k2 - 1], ' ') AS phrase, max(c.f) AS f FROM c, unnest(range(2, 5)) AS t(k2), unnest(range(1, 5)) AS u(s) WHERE k2 < c.k AND s + k2 - 1 <= c.k GROUP BY ALL)
SELECT best.lang, CAST(row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS BIGINT) AS rank, best.phrase, a, l, r, n, score
FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase WHERE inside.f IS NULL OR 100 * inside.f < 100 * a
QUALIFY rank <= 2000
"""
}
