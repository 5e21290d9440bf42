"""Line deduplication with levelled sorted runs of line hashes (operator 8). DataFrame functions only.

The lines already seen are kept as sorted runs: tables of (hash, first document), bucketed and
sorted by hash in the shared folder, one file a bucket. A new batch's hashes are bucketed the same way,
so that merge anti-joins with the runs, which move and sort nothing, leave what no run has; that
becomes a new run of level 0. When a level has ``fan_in`` runs they are merged, by joins of the same
kind, into one of the next level, so a batch never faces more than ``fan_in`` runs a level.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop_stored, drop_table, partitions, read_table, save_table, stored

BLANKS = " \t\n\x0b\f\r"


def line_key(line):
    """A line's key: white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """While plans are made here, a bucket of one sorted file counts as sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Sorted runs of line hashes (pairs of 64-bit hashes, ``h1, h2``), each with the smallest id of a
    document that held the line when it came. A hash is in one run at most.

    With a ``name`` the runs outlive this object: another one of that name takes them up, as long
    as the catalogue keeps its tables. Without one they are dropped by whoever made them."""

    def __init__(self, spark: SparkSession, name: str | None = None, fan_in: int = 2):
        self.spark, self.fan_in = spark, fan_in
        self.name = name or f"line_runs_{uuid.uuid4().hex}"
        self.buckets, self.levels = partitions(spark), []
        for t in sorted(t.name for t in spark.catalog.listTables(pattern=f"{self.name}_b*")):
            if m := re.fullmatch(re.escape(self.name) + r"_b(\d+)_l(\d+)_[0-9a-f]+", t):
                self.buckets = int(m[1])
                self._level(int(m[2])).append(t)

    def _level(self, level: int) -> list[str]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def write(self, df: DataFrame, part: str) -> str:
        """A table bucketed and sorted by hash. df is dealt by (h1, h2) already if Spark uses as many
        partitions as there are buckets; then nothing moves here."""
        name = f"{self.name}_b{self.buckets}_{part}_{uuid.uuid4().hex}"
        with _sorted_buckets(self.spark):
            save_table(df, name, lambda w: w.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2"))
        return name

    def tables(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def batch(self, keys: DataFrame) -> str:
        """The table of a batch's distinct hashes; the only shuffle, after partial aggregation."""
        if partitions(self.spark) != self.buckets:
            keys = keys.repartition(self.buckets, "h1", "h2")
        return self.write(keys, "batch")

    def unknown(self, batch: str) -> DataFrame:
        """The rows of a batch table whose hash no run has."""
        out = self.spark.table(batch)
        for run in self.tables():
            out = out.join(self.spark.table(run).hint("merge"), ["h1", "h2"], "left_anti")
        return out

    def add(self, batch: str) -> str:
        """Write what is unknown of a batch as a run of level 0. Its table; compaction may drop it."""
        with _sorted_buckets(self.spark):
            name = self.write(self.unknown(batch).select("h1", "h2", "first"), "l0")
        self._level(0).append(name)
        return name

    def compact(self) -> None:
        """Merge the runs of every full level into one of the next. A run is dropped only after the
        one that replaces it is whole; were the driver lost in between, both would say the same."""
        level = 0
        while level < len(self.levels):
            full = self.levels[level]
            if len(full) >= self.fan_in:
                with _sorted_buckets(self.spark):
                    merged = self.spark.table(full[0])
                    for n in full[1:]:
                        run = self.spark.table(n).select("h1", "h2", F.col("first").alias("other")).hint("merge")
                        merged = merged.join(run, ["h1", "h2"], "full").select("h1", "h2", F.least("first", "other").alias("first"))
                    name = self.write(merged, f"l{level + 1}")
                self._level(level + 1).append(name)
                self.levels[level] = []
                for n in full:
                    self.drop(n)
            level += 1

    def drop(self, table: str) -> None:
        drop_table(self.spark, table)

    def drop_all(self) -> None:
        for n in self.tables():
            self.drop(n)
        self.levels = []


def _dropped(docs: DataFrame, min_chars: int, batches: int, runs: LineRuns) -> DataFrame:
    """``doc_id, text_hash, gone``: for texts that lose lines, these lines' places, ascending."""
    lines = docs.select("doc_id", _own_hash().alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "text_hash", "pos", line_key("line").alias("key")).where(F.char_length("key") >= min_chars)
    keys = keys.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    cuts = [c for c in (docs.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10000)).first()[0] or [])] if batches > 1 else []
    cuts = sorted(set(cuts))
    batch = F.lit(len(cuts))
    for k, c in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc_id") <= c, k).otherwise(batch)
    keys, drops, made = stored(keys.withColumn("batch", batch), "lines"), None, []
    try:
        for k in range(len(cuts) + 1):
            mine = keys.where(F.col("batch") == k)
            each = mine.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("null_too"))
            several = (F.col("first") != F.col("last")) | (F.col("first").isNotNull() & F.col("null_too"))
            made.append(runs.batch(each.select("h1", "h2", "first", several.alias("several"))))
            new = runs.spark.table(runs.add(made[-1])).select("h1", "h2", F.lit(True).alias("new")).hint("merge")
            # lines to drop somewhere in the batch: those a run has, and new ones of several documents
            again = runs.spark.table(made[-1]).join(new, ["h1", "h2"], "left").where("new is null or several")
            with _sorted_buckets(runs.spark):
                again = stored(again.select("h1", "h2", "new", F.col("first").alias("keeper")), "again")
            gone = mine.join(again, ["h1", "h2"]).where(F.col("new").isNull() | ~F.col("doc_id").eqNullSafe(F.col("keeper")))
            gone = gone.select("doc_id", "text_hash", "pos")
            drops = gone if drops is None else drops.unionByName(gone)
            runs.compact()
    finally:
        for n in made:
            runs.drop(n)
    drops = stored(drops.distinct().groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "drops")
    drop_stored(keys)
    return drops


def _own_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 3, fan_in: int = 2, runs: LineRuns | None = None, counts: bool = True) -> DataFrame:
    """Drop every line whose key (of at least ``min_chars`` code points) a document with a
    smaller doc_id holds too; the other lines stay, joined by newlines. With ``runs``, what they
    hold came before all of docs, and what docs hold is added to them.

    Returns ``doc_id, text, n_lines, n_dropped`` and the other columns of docs (but for columns of
    these names); without ``counts`` exactly the columns of docs, with the new text. A null text
    counts as one empty line and becomes empty; very long texts are split into lines whole, and one
    text's lines are joined again in one task; documents with a null doc_id count as one document
    that comes after all others; repeated doc_ids are one document, whose rows are treated alike; a
    line that one document holds twice stays twice; an empty table gives no rows.

    Documents enter in ``batches`` batches of ascending doc_id. Shuffled are 40 bytes a line
    twice and, once, the texts (to meet the places of their dropped lines). A line that a third of
    all documents hold is one row a task before the first shuffle and is split by Spark's skew
    handling at the second.
    """
    own = runs or LineRuns(docs.sparkSession, None, fan_in)
    try:
        drops = _dropped(docs, min_chars, batches, own)
    finally:
        if runs is None:
            own.drop_all()
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    whole = docs.select("doc_id", "text", _own_hash().alias("text_hash"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    kept = whole.alias("d").join(drops.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_hash") == F.col("g.text_hash")), "left")
    parts = F.split(F.coalesce("d.text", F.lit("")), "\n")
    # the kept lines are the stretches between dropped places
    stretches = F.expr("flatten(zip_with(array_append(gone, size(parts)), array_prepend(gone, -1), (stop, before) -> slice(parts, before + 2, stop - before - 1)))")
    out = kept.select("d.doc_id", "d.rest", "g.gone", parts.alias("parts"))
    new = {
        "doc_id": F.col("doc_id"),
        "text": F.when(F.col("gone").isNull(), F.array_join("parts", "\n")).otherwise(F.array_join(stretches, "\n")),
        "n_lines": F.size("parts").cast("bigint"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("bigint"),
    }
    if not counts:
        return out.select([new[c.lower()].alias(c) if c.lower() in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns])
    return out.select(*[c.alias(n) for n, c in new.items()], *[F.col("rest").getField(c).alias(c) for c in others if c.lower() not in new])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


KEPT_LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
f AS (SELECT key, min(doc_id) AS keeper FROM l WHERE length(key) >= 10 GROUP BY key),
k AS (SELECT r, i, line, (f.key IS NOT NULL AND l.doc_id <> f.keeper) AS gone FROM l LEFT JOIN f USING (key)),
g AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM k GROUP BY r)
"""
SQL = {
    "op8_line_dedup": KEPT_LINES
    + "SELECT d.doc_id, CAST(g.n_lines AS BIGINT) AS n_lines, CAST(g.n_dropped AS BIGINT) AS n_dropped, sha256(g.kept) AS kept_sha256 FROM d JOIN g USING (r)"
}
