"""Toxicity from the nearest labelled examples (operator 5).

Labelled texts become TF-IDF vectors over all their features (words and word beginnings), the
idf raised by how much a feature goes with a label. A text's vector has all its features too: those of no
example count in its length, with the idf of the rarest. A block-max inverted index over these examples
gives a text's exact nearest ones by cosine; blocks that cannot hold one are passed over. The
examples vote, the nearer the more; a logistic curve makes the vote a probability. The examples
themselves are the evidence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back_memory, read_table, row_slices
from .quality import class_odds, logistic_fit, sample_labelled
from .tokens import _TABLE, ALNUM_WORDS, Words, mix, powers

SLICE = 1 << 20  # bytes of text that are looked at together
FIT_SLICE = 1 << 17  # by the driver, whose memory is small
STEMS = (4, 5, 6)  # bytes of word beginnings that count as features


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all rows and the row of each: every word and, of longer words, their
    beginnings."""
    w = Words(column, ALNUM_WORDS)
    n = len(w.low)
    p, inv = powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[w.low] * p[:n], out=run[1:])
    hashes, rows = [w.hash], [w.row]
    for k in STEMS:
        long = np.flatnonzero(w.ends - w.starts > k)
        s = w.starts[long]
        hashes.append(mix((run[s + k] - run[s]) * inv[s] + np.uint64(k)))
        rows.append(w.row[long])
    return np.concatenate(hashes), np.concatenate(rows)


class BlockMaxIndex:
    """Inverted index of examples' unit vectors, in blocks of ``block`` examples.

    ``feature, example, weight`` are the entries of all vectors, every one of which is indexed. The
    ``often`` features of most examples have long lists, kept a block at a time (as the rows of a
    matrix), with each feature's largest weight in each block. The lists of all other features are
    short. A query reads its short lists in whole; a block's best sum over them and the products with
    its largest weights bound the cosines there, so a block whose bound is below the k-th best cosine
    found so far holds none of the nearest and is never scored. Examples are put in an order that has
    alike ones in one block, which makes the bounds tight.
    """

    def __init__(self, feature: np.ndarray, example: np.ndarray, weight: np.ndarray, n: int, n_features: int, often: int = 1536, block: int = 32):
        self.n, self.block, self.blocks, self.scored = n, block, max(1, -(-n // block)), [0, 0]
        top = np.sort(np.argsort(-np.bincount(feature, minlength=n_features), kind="stable")[:often])
        self.column = np.full(n_features, -1, np.int32)
        self.column[top] = np.arange(len(top))
        dense = self.column[feature] >= 0
        matrix = np.zeros((self.blocks * block, len(top)), np.float32)
        for a in range(0, len(dense), 1 << 18):  # places take more memory than what they are of
            some = slice(a, a + (1 << 18))
            own = dense[some]
            matrix[example[some][own], self.column[feature[some][own]]] = weight[some][own]
        self.order = np.concatenate([self._alike(matrix[:n]), np.arange(n, len(matrix))])
        place = np.argsort(self.order).astype(np.int32)
        matrix = matrix[self.order]
        self.matrix = matrix.reshape(self.blocks, block, len(top))
        self.top = self.matrix.max(axis=1) if len(top) else np.zeros((self.blocks, 0), np.float32)
        feature, example, weight = feature[~dense], place[example[~dense]], weight[~dense]
        order = np.argsort(feature, kind="stable")
        self.example, self.weight = example[order], weight[order].astype(np.float32)
        self.start = np.searchsorted(feature[order], np.arange(n_features + 1))

    def _alike(self, x: np.ndarray, steps: int = 4) -> np.ndarray:
        """An order of the rows that keeps alike ones together: by the nearest of some centres."""
        if len(x) <= self.block or not x.shape[1]:
            return np.arange(len(x))
        centres = x[:: self.block].copy()
        for _ in range(steps):
            best = np.argmax(x @ centres.T, axis=1)
            for c in range(len(centres)):
                if len(own := x[best == c]):
                    centres[c] = own.sum(axis=0)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        near = x @ centres.T
        return np.lexsort((np.arange(len(x)), -near.max(axis=1), np.argmax(near, axis=1)))

    def nearest(self, row: np.ndarray, feature: np.ndarray, weight: np.ndarray, rows: int, k: int, run: int = 64, touched: int = 1 << 20, first: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of ``rows`` texts (entries sorted by row) the k examples of largest positive
        cosine and their cosines, rounded to six decimals (ties: smaller index)."""
        column = self.column[feature]
        lo = self.start[feature]
        size = np.where(column < 0, self.start[feature + 1] - lo, 0)
        edge = np.searchsorted(row, np.arange(rows + 1))
        work = np.concatenate([[0], np.cumsum(size)])[edge]
        a, wide = 0, self.blocks * self.block
        while a < rows:
            z = max(a + 1, min(a + run, int(np.searchsorted(work, work[a] + touched, "right")) - 1))
            own, m = slice(edge[a], edge[z]), z - a
            r, c, x, s = row[own] - a, column[own], weight[own].astype(np.float32), size[own]
            q = np.zeros((m, self.matrix.shape[2]), np.float32)
            q[r[c >= 0], c[c >= 0]] = x[c >= 0]
            spot = np.repeat(lo[own] - (np.cumsum(s) - s), s) + np.arange(s.sum())
            cos = np.bincount(np.repeat(r * wide, s) + self.example[spot], np.repeat(x, s) * self.weight[spot], m * wide).astype(np.float32)
            cos = cos.reshape(m, self.blocks, self.block)
            bound = q @ self.top.T + cos.max(axis=2) + 1e-5  # above what rounding can add
            todo, done = bound > 2e-5, np.zeros((m, self.blocks), bool)
            if self.blocks > first:
                best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
                now = np.zeros_like(todo)
                np.put_along_axis(now, best, True, axis=1)
                self._score(cos, now, q)
                got = np.take_along_axis(cos, best[:, :, None], axis=1).reshape(m, -1)
                if got.shape[1] >= k:
                    todo &= bound >= np.partition(got, -k, axis=1)[:, -k][:, None]
                todo, done = todo & ~now, now
            self._score(cos, todo, q)
            done |= todo
            self.scored[0] += int(done.sum())
            self.scored[1] += done.size
            flat = np.round(np.minimum(np.where(done[:, :, None], cos, 0), 1.0), 6).reshape(m, wide)
            floor = np.maximum(np.partition(flat, -min(k, wide), axis=1)[:, -min(k, wide)], 1e-9)
            hit_row, hit = np.nonzero(flat >= floor[:, None])
            hit_cos, hit = flat[hit_row, hit].astype(float), self.order[hit]
            by = np.lexsort((hit, -hit_cos, hit_row))
            hit_row, hit, hit_cos = hit_row[by], hit[by], hit_cos[by]
            ends = np.searchsorted(hit_row, np.arange(m + 1))
            for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield hit[i : min(j, i + k)], hit_cos[i : min(j, i + k)]
            a = z

    def _score(self, cos: np.ndarray, todo: np.ndarray, q: np.ndarray) -> None:
        """Add the long lists' part to the cosines of the marked (row, block) pairs."""
        for b in np.flatnonzero(todo.any(axis=0)):
            rows = np.flatnonzero(todo[:, b])
            cos[rows, b] += q[rows] @ self.matrix[b].T


def distinct_examples(rows: list[tuple[int, int, str]], sketch: int = 16, same: float = 0.9) -> list[tuple[int, int, str]]:
    """Of near copies with one label only the first: a text copied a hundred times would make each
    of its words look telling. Texts are near copies if the Jaccard similarity of their features is
    at least ``same``; only those that share half of the ``sketch`` smallest features are compared."""
    seen: dict[tuple[int, int], list[int]] = {}
    held: list[np.ndarray] = []
    out = []
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.string())], ["text"])
    at = 0
    for b in row_slices(batch, "text", FIT_SLICE):
        h, row = features(b.column(0))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        ends = np.searchsorted(row, np.arange(b.num_rows + 1))
        for i in range(b.num_rows):
            own = np.unique(h[ends[i] : ends[i + 1]])
            low = [(rows[at][1], x) for x in own[:sketch].tolist()]
            met = Counter(j for x in low for j in seen.get(x, ()))
            if not any(2 * m >= len(low) and _jaccard(own, held[j]) >= same for j, m in met.items()):
                for x in low:
                    seen.setdefault(x, []).append(len(held))
                held.append(own)
                out.append(rows[at])
            at += 1
    return out


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


class NeighbourModel:
    doubt = 0.05

    def __init__(self, rows: list[tuple[int, int, str]], k: int, odds: float | None = None):
        rows = distinct_examples(sorted(rows, key=lambda r: (r[0] * 2654435761 % 2**32, r[0])))
        give_back_memory()  # of comparing examples; the driver goes on with what fitting leaves it
        fit, held = [r for i, r in enumerate(rows) if i % 4], [r for i, r in enumerate(rows) if i % 4 == 0]
        self.k, self.ids = k, np.array([r[0] for r in fit], np.int64)
        self.y = np.array([r[1] for r in fit], float)
        self._learn([r[2] for r in fit])
        give_back_memory()
        self.prior = 1 / (1 + np.exp(-(odds or 0.0)))
        self.weights = np.array([1.0, 0.0])
        if held:
            batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in held], pa.string())], ["text"])
            x = np.array([self.signal(*n) for b in row_slices(batch, "text", 1 << 19) for n in self.neighbours(b.column(0))])
            y = np.array([r[1] for r in held], float)
            self.weights = logistic_fit(x, y, ridge=1e-2)
            if odds is not None and 0 < y.sum() < len(y):  # from the sample's share of toxic texts to that of all labelled
                self.weights[-1] += odds - np.log(y.sum() / (len(y) - y.sum()))

    def _learn(self, texts: list[str]) -> None:
        """Vocabulary, weights and index. What is made on the way is as large as all entries several times over, so
        it is narrow and let go early."""
        n, y = len(texts), self.y
        h, row, count = self._distinct(texts)
        give_back_memory()
        self.vocab = np.unique(h)
        at = np.empty(len(h), np.int32)
        for a in range(0, len(h), 1 << 18):
            at[a : a + (1 << 18)] = np.searchsorted(self.vocab, h[a : a + (1 << 18)])
        df = np.bincount(at, minlength=len(self.vocab))
        del h
        give_back_memory()
        pos = np.bincount(at, y[row], len(df))
        gain = self._gain(pos, df - pos, y.sum(), n - y.sum())
        # every feature counts, those that go with a label the more; none has weight 0
        self.idf = np.log((n + 1) / df) * np.sqrt(1 + np.maximum(gain, 0))
        self.rarest = np.log(n + 1)  # of a feature of no example, as of one
        weight = self._unit(row, at, count, n).astype(np.float32)
        del count
        give_back_memory()
        self.index = BlockMaxIndex(at, row, weight, n, len(df))

    @staticmethod
    def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature hashes, rows and counts, a slice of texts at a time (the driver's memory is
        small), sorted by row."""
        parts, base = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))], 0
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        for b in row_slices(batch, "text", FIT_SLICE):
            h, row = features(b.column(0))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
            parts.append((h[new], (row[new] + base).astype(np.int32), np.diff(np.append(new, len(h))).astype(np.int32)))
            base += b.num_rows
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    @staticmethod
    def _gain(a, b, na, nb):
        """Log-likelihood ratio of a feature's counts in the two classes."""

        def part(o, e):
            return np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0.0)

        n = na + nb
        return 2 * (part(a, (a + b) * na / n) + part(b, (a + b) * nb / n) + part(na - a, (n - a - b) * na / n) + part(nb - b, (n - a - b) * nb / n))

    def _unit(self, row: np.ndarray, at: np.ndarray, count: np.ndarray, n: int, unseen: np.ndarray | None = None) -> np.ndarray:
        """Weights of the entries, so that each row's whole vector has length 1; ``unseen`` is the squared
        length of its other entries, those of features that no example has."""
        x = np.log(count)
        x += 1
        x *= self.idf[at]
        norm = np.bincount(row, x * x, n)
        x /= np.sqrt(norm if unseen is None else norm + unseen)[row]
        return x

    def neighbours(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(column)
        if not len(self.vocab):
            return iter([(np.zeros(0, np.int64), np.zeros(0))] * n)
        h, row = features(column)
        # one stable sort by hash: each hash comes from one kind of feature, whose rows ascend, so that what
        # is equal in both stands together
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(h)))
        h, row = h[first], row[first]
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        known = self.vocab[at] == h
        unseen = np.bincount(row[~known], ((1 + np.log(count[~known])) * self.rarest) ** 2, n)
        row, at, count = row[known], at[known], count[known]
        order = np.argsort(row.astype(np.uint16) if n <= 1 << 16 else row, kind="stable")
        row, at, count = row[order], at[order], count[order]
        return self.index.nearest(row, at, self._unit(row, at, count, n, unseen), n, self.k)

    def signal(self, best: np.ndarray, cos: np.ndarray) -> tuple[float]:
        """The distance-weighted votes: the logarithm of those for toxic over the others. An example votes with the
        third power of its cosine, so far ones hardly do; ``doubt`` votes are cast as all labels are, so a
        text that is like no example gets the share of toxic ones among all."""
        w = cos**3
        for_, against = float((w * self.y[best]).sum()), float((w * (1 - self.y[best])).sum())
        return (float(np.log((for_ + self.doubt * self.prior) / (against + self.doubt * (1 - self.prior)))),)

    def score(self, best: np.ndarray, cos: np.ndarray) -> float:
        z = np.dot(self.weights, [*self.signal(best, cos), 1.0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _rest(parts: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def _model(docs, labels, parts, held, per_class, max_bytes, k) -> NeighbourModel:
    learn = _rest(parts) != held
    return NeighbourModel(sample_labelled(docs, labels, "toxic", learn, per_class, max_bytes), k, class_odds(labels, "toxic", learn))


def _sent(docs, *options) -> Broadcast:
    """The fitted model for all tasks. The driver keeps nothing of it, nor what fitting has used."""
    sent = docs.sparkSession.sparkContext.broadcast(_model(docs, *options))
    give_back_memory()
    return sent


def score(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, per_class: int = 2500, max_bytes: int = 32768, k: int = 15, threshold: float = 0.7) -> DataFrame:
    """Score every whole text. Rows whose crc32(doc_id) mod ``parts`` is ``held`` never take
    part in learning; the examples are at most ``per_class`` labelled rows of each class with
    texts of at most ``max_bytes`` bytes (the bound of what is broadcast). Every row is scored.

    Returns ``doc_id, held_out, score, predicted, evidence`` (examples' ids and cosines, the
    nearest first). Null and empty texts, and texts without any known feature, have no
    neighbours and get the score of a vote without voters, which is about the share of toxic labels; very long texts are one slice of their own, read whole;
    a null doc_id is not held out; repeated rows are scored each; without labels every score is
    0.5; equal cosines go to the example that is first in the index;
    other columns are not read; an empty table gives no rows.
    """
    held_out = F.coalesce(_rest(parts) == held, F.lit(False))
    sent = _sent(docs, labels, parts, held, per_class, max_bytes, k)
    near = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        give_back_memory()  # of the stages before, and of reading the model
        for whole in batches:
            for b in row_slices(whole, "text", SLICE):
                found = list(m.neighbours(b.column(1)))
                s = np.array([m.score(*f) for f in found])
                evidence = [[(int(m.ids[i]), float(c)) for i, c in zip(*f, strict=True)] for f in found]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(evidence, near)], ["doc_id", "held_out", "score", "predicted", "evidence"])
        give_back_memory()

    schema = "doc_id bigint, held_out boolean, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double>>"
    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, per_class: int = 2500, max_bytes: int = 32768, k: int = 15, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that :func:`score` does not predict toxic.
    Rows are judged where they are read, so nothing is shuffled. Odd rows are judged as there: null and empty texts
    and those like no example stay, repeated rows fare alike, an empty table stays empty; columns of any name pass."""
    sent = _sent(docs, labels, parts, held, per_class, max_bytes, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        give_back_memory()  # of the stages before, and of reading the model
        for whole in batches:
            rows = whole.column(0)
            for b in row_slices(pa.RecordBatch.from_arrays([rows.field(at), rows], ["text", "row"]), "text", SLICE):
                clean = [m.score(*f) < threshold for f in m.neighbours(b.column(0))]
                yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(clean))], ["row"])
            give_back_memory()
        give_back_memory()

    # a batch has each text once
    at = [c.lower() for c in docs.columns].index("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.array_join(F.transform("evidence", lambda e: e["doc_id"].cast("string")), ",").alias("evidence"))
