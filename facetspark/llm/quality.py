"""Quality classifier by compression (operator 6).

Two zstandard dictionaries are built from labelled good and bad texts. A text that the
good dictionary shortens more than the bad one resembles the good texts; the normalised
difference of the two compressed sizes is mapped to a probability by a logistic curve fitted
on other labelled texts. Nothing else about a text enters its score.

A text is compressed in pieces of ``piece`` bytes, each with the fresh dictionary: in one go, all
but the beginning of a long text would be compressed by what it has said itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, row_slices

SCORED = "doc_id bigint, held_out boolean, score double, predicted int"


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression (a row of x each, last weight the constant), by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    level: int
    piece: int
    weights: tuple[float, ...]

    def difference(self, texts: list[bytes]) -> np.ndarray:
        """Per text, by how many bytes the good dictionary's pieces are smaller than the bad one's."""
        make = lambda d: zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress
        good, bad = make(self.good), make(self.bad)
        pieces = ([t[i : i + self.piece] for i in range(0, len(t), self.piece)] for t in texts)
        return np.array([sum(len(bad(p)) - len(good(p)) for p in ps) for ps in pieces], float)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """The difference over the text's bytes (in per cent), and over their square root, with which
        the difference's own error grows: long texts give firmer evidence."""
        d = self.difference(texts)
        n = np.array([max(1, len(t)) for t in texts], float)
        return np.column_stack([100 * d / n, d / np.sqrt(n)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ w[:-1] + w[-1], -30, 30)))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, learn: "F.Column", per_class: int, max_bytes: int) -> list[tuple[int, int, str]]:
    """At most ``per_class`` labelled rows of each class, the same ones at every run (the
    smallest hashes of their ids). This bound on rows for fitting is the only cap here. Of rows
    that repeat a doc_id the least text counts, of labels that contradict each other 1; Spark
    chooses, so the driver gets one row an id."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    each = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    few = each[0].unionByName(each[1])
    texts = docs.select("doc_id", "text").where(F.octet_length("text").between(1, max_bytes))
    rows = texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    return sorted((r.doc_id, r.y, r.text) for r in rows)


def class_odds(labels: DataFrame, label: str, learn: "F.Column") -> float:
    """Logarithm of the odds of label 1 among the rows that may be learnt from."""
    n = {r.y: r.n for r in labels.where(learn & F.col(label).isin(0, 1)).groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    return math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))


def fit(rows: list[tuple[int, int, str]], odds: float = 0.0, dict_bytes: int = 112 * 1024, level: int = 3, piece: int = 1024) -> CompressionModel | None:
    """Dictionaries from three rows in four, the logistic curve from the others (a class of under
    four rows gives all of them to both). The sample has its own share of each class; the curve is
    moved to the ``odds`` of all labelled rows. None if a class has no row."""
    by = {y: [t.encode() for _, v, t in rows if v == y] for y in (0, 1)}
    if not all(by.values()):
        return None
    made = {}
    for y, texts in by.items():
        own = [t for k, t in enumerate(texts) if k % 4 or len(texts) < 4]
        try:
            made[y] = zstandard.train_dictionary(min(dict_bytes, max(2048, sum(map(len, own)) // 4)), own).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself serves
            made[y] = b"".join(own)[-dict_bytes:]
    held = [(t, y) for y, texts in by.items() for k, t in enumerate(texts) if k % 4 == 0 or len(texts) < 4]
    model = CompressionModel(made[1], made[0], level, piece, ())
    w = logistic_fit(model.features([t for t, _ in held]), np.array([y for _, y in held], float))
    w[-1] += odds - math.log(sum(y for _, y in held) / sum(1 - y for _, y in held))
    return CompressionModel(made[1], made[0], level, piece, tuple(map(float, w)))


def score(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, per_class: int = 2000, max_bytes: int = 65536, threshold: float = 0.7) -> DataFrame:
    """Score every whole text. Rows whose crc32(doc_id) mod ``parts`` is ``held`` never take
    part in fitting; fitting takes at most ``per_class`` labelled rows of each class with
    texts of at most ``max_bytes`` bytes, every row is scored.

    Returns ``doc_id, held_out, score, predicted``. Null and empty texts get the score of an
    empty text (a difference of 0); very long texts are compressed whole, piece by piece, a text at a
    time; a null doc_id is not held out; equal texts have equal scores, repeated rows are scored each;
    other columns are not read. One usable labelled text a class is the least there must be: where a
    class has none every score is 0.5, at any size of the table. An empty table gives no rows.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))
    model = fit(sample_labelled(docs, labels, "quality", rest != held, per_class, max_bytes), class_odds(labels, "quality", rest != held))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries: at most 2 * dict_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in row_slices(whole, "text", 1 << 21)):
            texts = [t.encode() for t in b.column(1).fill_null("").to_pylist()]
            s = sent.value.score(texts) if sent.value else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", F.coalesce(rest == held, F.lit(False)).alias("held_out")).mapInArrow(run, SCORED)


def brute(model: CompressionModel | None, text: str | None) -> float:
    """One text's score, step by step (for tests)."""
    if model is None:
        return 0.5
    raw, sizes = (text or "").encode(), []
    for d in (model.good, model.bad):
        total = 0
        for i in range(0, len(raw), model.piece):
            total += len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(raw[i : i + model.piece]))
        sizes.append(total)
    n, d = max(1, len(raw)), sizes[1] - sizes[0]
    z = model.weights[0] * 100 * d / n + model.weights[1] * d / math.sqrt(n) + model.weights[2]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
