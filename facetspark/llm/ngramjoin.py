"""N-gram Jaccard join by grouped prefixes (operator 10).

1. Every text becomes its set of distinct shingle hashes. The hashes go, packed, to *cells*
   of the hash space, which count in how many documents each occurs and answer only for
   those that occur in two or more. Shingles of one document alone can be in no
   intersection; they come first in the order "rarest first" and are never sent back.
2. A document whose prefix (the first n - ceil(3n/4) + 1 shingles of that order) has shared
   shingles is a candidate. Equal sets are one class; classes with identical prefix and size
   are one group. Groups that share a prefix shingle are connected, in Spark, into candidate
   sets, without listing pairs.
3. A candidate set is joined in one task, a large one in blocks: group pairs by prefix index and
   size filter, then their members are expanded and verified by exact intersection counts. What
   is linked already is not compared again. A large set goes through three steps: within
   blocks, which takes each class once; between one class of each component found so far; and
   between the blocks of those classes that still share a prefix shingle with another component,
   in bands of size, as only neighbouring bands can meet. A great group of near copies is one
   component after the second step, so that its work grows with its size and not with the square.
4. Connected components of the links give each document its component.

Shingles are told apart by 56 bits of their hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, read_table, stored
from .frequency import Batch, cell_bits, shared_hashes
from .graph import components
from .tokens import SPACE_WORDS, Words

def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of the k-word shingles of each row, sorted by row; of rows with
    fewer words, but some, the hash of the whole sequence."""
    w = Words(column, SPACE_WORDS)
    h, at = w.windows(k)
    rows = w.row[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        h = np.concatenate([h, np.array([w.whole(r) for r in short], np.uint64)])
        rows = np.concatenate([rows, short])
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], h[new]


WIDE = 8  # blocks that are joined with others are larger than those joined within: a class is copied for each of them
SETS = "row bigint, doc_id bigint, n bigint, own bigint, prefix array<bigint>, keys binary"


def _sets(threshold: tuple[int, int]):
    """Of a batch: each document's size, and for candidates the shared part of its prefix and
    all its shared keys, rarest first."""
    num, den = threshold

    def make(b: Batch) -> pa.RecordBatch:
        own = b.size - np.diff(b.edge)
        prefix = np.minimum(np.diff(b.edge), np.maximum(0, np.where(b.size > 0, b.size - -(-num * b.size // den) + 1, 0) - own))
        each = list(zip(b.edge[:-1], b.edge[1:], prefix, strict=True))
        return pa.RecordBatch.from_arrays(
            [
                pa.array((b.serial << 16) + np.arange(b.n)),
                pa.array(b.ids, mask=b.null),
                pa.array(b.size),
                pa.array(own),
                pa.array([b.keys[a : a + p].view(np.int64) if p else None for a, _, p in each], pa.list_(pa.int64())),
                pa.array([b.keys[a:z].astype("<u8").tobytes() if p else None for a, z, p in each], pa.binary()),
            ],
            ["row", "doc_id", "n", "own", "prefix", "keys"],
        )

    return make


def verify(table: pa.Table, threshold: tuple[int, int], every: bool = False, star: bool = False) -> tuple[list[int], list[int], list[int]]:
    """Links within one candidate set (or between two blocks of one), and the shingles each has in
    common: of the pairs of classes that reach the threshold those that connect labels not yet
    connected, or ``every`` one. With ``star``, instead, each linked class once with the smallest of its
    component here."""
    num, den = threshold
    cls, n = table.column("cls").to_numpy(), table.column("n").to_numpy()
    order = np.lexsort((cls, n))
    cls, n = cls[order], n[order]
    gid, side, pre, label = (table.column(c).to_numpy()[order] for c in ("gid", "side", "pre", "label"))
    keys = [np.frombuffer(k, "<u8") for k in table.column("keys").take(pa.array(order)).to_pylist()]
    m = len(cls)
    two = any(table.column(a)[0].as_py() != table.column(b)[0].as_py() for a, b in (("band", "other"), ("bi", "bj")))
    if two and side.min() == side.max():
        return [], [], []
    start = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    _, dense = np.unique(np.concatenate(keys), return_inverse=True)
    owner = np.repeat(np.arange(m), np.diff(start))
    by_key = np.argsort(dense, kind="stable")
    posting, at = owner[by_key], np.searchsorted(dense[by_key], np.arange(dense.max() + 2))
    # groups: one prefix and size; the prefix index is over groups
    _, lead, group = np.unique(gid, return_index=True, return_inverse=True)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    pk = np.concatenate([dense[start[i] : start[i] + pre[i]] for i in lead])
    pg = np.repeat(np.arange(len(lead)), pre[lead])
    order = np.argsort(pk, kind="stable")
    group_posting, group_at = pg[order], np.searchsorted(pk[order], np.arange(dense.max() + 2))
    n_group, label = n[lead], np.unique(label, return_inverse=True)[1]
    a_out, b_out, common = [], [], []
    for g in range(len(lead)):
        i0 = lead[g]
        mine = dense[start[i0] : start[i0] + pre[i0]]
        near = np.unique(np.concatenate([group_posting[group_at[x] : group_at[x + 1]] for x in mine]))
        near = near[(den * n_group[g] >= num * n_group[near]) & (den * n_group[near] >= num * n_group[g])]  # size filter
        others = np.concatenate([members[x] for x in near])
        for i in members[g]:
            j = others[others > i]
            j = j[(every | (label[j] != label[i])) & ((side[j] != side[i]) | (not two))]
            if not len(j):
                continue
            inter = np.bincount(np.concatenate([posting[at[x] : at[x + 1]] for x in dense[start[i] : start[i + 1]]]), minlength=m)[j]
            for x, c in zip(*(v[(num + den) * inter >= num * (n[i] + n[j])] for v in (j, inter)), strict=True):
                if every or label[x] != label[i]:
                    label[label == label[x]] = label[i]
                    a_out.append(int(cls[i]))
                    b_out.append(int(cls[x]))
                    common.append(int(c))
    if star:
        least = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, cls)
        other = np.flatnonzero(least[label] != cls)
        return cls[other].tolist(), least[label[other]].tolist(), [0] * len(other)
    return a_out, b_out, common


FEW = 300_000


def _few(rows: DataFrame) -> DataFrame:
    """rows of whole numbers, to be broadcast if a count says that they are few (some 30 MB), so that what
    they meet, which is wide, is not moved; else they are joined by a shuffle of both."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


class Candidates:
    """Documents as sets (``sets``), candidates as ``rows`` of ``classes`` of equal sets, and the
    classes' candidate sets: ``members`` (cls, comp, gid, pre, n)."""

    def __init__(self, docs: DataFrame, k: int, threshold: tuple[int, int], slice_bytes: int, cell_bytes: int, hot: int):
        self.threshold = threshold
        self.sets = sets = shared_hashes(docs.select("doc_id", "text"), lambda c: shingles(c, k), _sets(threshold), SETS, cell_bits(docs, cell_bytes), slice_bytes, hot)
        cand = sets.where("keys is not null")
        # equal sets, whose shingles are then all shared, are one class; any other row is its own
        ckey = F.when(F.col("own") == 0, F.concat(F.lit("="), F.md5("keys"), F.lit("/"), F.col("n").cast("string"))).otherwise(F.col("row").cast("string"))
        # groups of equal prefix and size: prefixes are told apart by 128 bits, so that only these are moved
        told = [F.xxhash64("prefix").alias("p1"), F.xxhash64(F.lit(1), "prefix").alias("p2"), F.size("prefix").alias("pre")]
        self.rows = stored(cand.select("row", "doc_id", "n", *told, ckey.alias("ckey")), "candidates")
        same = [F.first(c).alias(c) for c in ("n", "p1", "p2", "pre")]
        self.classes = stored(self.rows.groupBy("ckey").agg(F.min("row").alias("cls"), F.min("doc_id").alias("rep_id"), *same), "classes")
        groups = stored(self.classes.groupBy("n", "p1", "p2").agg(F.min("cls").alias("gid")), "groups")
        by_key = self.prefixes(groups.select("gid"), "gid")  # a group is met through one of its classes
        leads = by_key.groupBy("key").agg(F.min("gid").alias("lead"), F.count("*").alias("c")).where("c > 1").drop("c")
        comp = components(by_key.join(leads, "key").where("gid <> lead").select(F.col("gid").alias("a"), F.col("lead").alias("b")))
        members = self.classes.join(groups, ["n", "p1", "p2"]).select("cls", "gid", "pre", "n")
        members = members.join(comp, members.gid == comp.node, "left").select("cls", "gid", "pre", "n", F.coalesce("component", "gid").alias("comp"))
        self.members = stored(members, "members")
        drop_stored(groups)

    def prefixes(self, classes: DataFrame, on: str) -> DataFrame:
        """classes with a row for each ``key`` of their prefixes; ``on`` is the class."""
        own = self.sets.where("keys is not null").select(F.col("row").alias(on), "prefix")
        return _few(classes).join(own, on).select(*classes.columns, F.explode("prefix").alias("key"))

    def within(self, members: DataFrame, block: int) -> DataFrame:
        """members, each in one of its set's blocks of about ``block`` classes: a row each."""
        sizes = members.groupBy("comp").agg(F.count("*").alias("m")).where("m > 1")
        blk = F.pmod(F.xxhash64("cls"), F.ceil(F.col("m") / block)).cast("int")
        return members.join(sizes, "comp").select(*members.columns, F.lit(0).alias("band"), F.lit(0).alias("other"), blk.alias("bi"), blk.alias("bj"), F.lit(0).alias("side"))

    def between(self, members: DataFrame, block: int) -> DataFrame:
        """members in every pair of their set's blocks that may hold links. Blocks are of one band
        of size; two classes that may be linked lie in one band or in neighbouring ones."""
        num, den = self.threshold
        band = members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) * (1 - 1e-9)).cast("int"))
        sizes = stored(band.groupBy("comp", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("nb")), "bands")
        near = lambda step: sizes.select("comp", (F.col("band") - step).alias("band"), F.col("nb").alias("below" if step < 0 else "above"))
        sizes = sizes.join(near(1), ["comp", "band"], "left").join(near(-1), ["comp", "band"], "left").na.fill(0, ["above", "below"])
        rows = band.join(sizes, ["comp", "band"]).withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
        upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
        cell = lambda a, b, i, j, side: F.struct(a.alias("band"), b.alias("other"), i.alias("bi"), j.alias("bj"), side.alias("side"))
        own, blk = F.col("band"), F.col("blk")
        cells = F.concat(
            F.transform(upto("nb"), lambda o: cell(own, own, F.least(o, blk), F.greatest(o, blk), F.when(o < blk, 1).otherwise(0))),
            F.transform(upto("above"), lambda o: cell(own, own + 1, blk, o, F.lit(0))),
            F.transform(upto("below"), lambda o: cell(own - 1, own, o, blk, F.lit(1))),
        )
        return rows.withColumn("cell", F.explode(cells)).select(*members.columns, "cell.*")

    def links(self, cells: DataFrame, every: bool = False, star: bool = False) -> DataFrame:
        """``a, b, common``: what :func:`verify` finds in each cell. cells: members with label and cell."""
        keys = self.sets.where("keys is not null").select(F.col("row").alias("cls"), "keys")
        threshold = self.threshold

        def join(t: pa.Table) -> pa.Table:
            found = verify(t, threshold, every, star) if t.num_rows > 1 else ([], [], [])
            return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("a", "b", "common"), found, strict=True)})

        cells = stored(cells, "cells")
        todo = _few(cells).join(keys, "cls").select("comp", "band", "other", "bi", "bj", "side", "cls", "gid", "pre", "n", "label", "keys")
        out = stored(todo.groupBy("comp", "band", "other", "bi", "bj").applyInArrow(join, "a bigint, b bigint, common bigint"), "links")
        drop_stored(cells)
        return out

    def spanning(self, block: int) -> DataFrame:
        """``node, component`` of the linked classes, from links that span each component."""
        links = self.links(self.within(self.members.withColumn("label", F.col("cls")), block), star=True)
        large = stored(self.members.groupBy("comp").agg(F.count("*").alias("m")).where(F.col("m") > block).select("comp"), "large")
        if large.isEmpty():
            return components(links)
        hung = lambda rows, stars, on: rows.join(stars.select(F.col("a").alias(on), F.col("b").alias("to")), on, "left").withColumn("label", F.coalesce("to", on)).drop("to")
        mine = stored(hung(self.members.join(large, "comp"), links, "cls"), "labelled")
        leads = self.links(self.within(mine.where("label = cls"), block), star=True)
        labelled = stored(hung(mine, leads, "label"), "labelled")
        # classes that share a key are of one set, so keys need not be told apart by sets
        by_key = self.prefixes(labelled.select("cls", "label"), "cls")
        met = stored(by_key.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key"), "met")
        still = stored(labelled.join(by_key.select("cls", "key").join(met, "key", "left_semi").select("cls").distinct(), "cls"), "open")
        drop_stored(met)
        links = links.unionByName(leads)
        if not still.isEmpty():
            links = links.unionByName(self.links(self.between(still, WIDE * block)))
        return components(links)


def jaccard_components(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (3, 4), slice_bytes: int = 1 << 21, cell_bytes: int = 6 << 20, hot: int = 64, block: int = 512) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of shingle sets of at least
    ``threshold`` (a fraction). Returns ``doc_id, n_shingles, component_id``.

    Null, empty and blank texts have the empty set and no links; texts of fewer than k words
    are one shingle; very long texts are one slice of their own, read whole; equal texts share a
    component; a null doc_id never names a component that has another id; repeated rows are linked
    with each other; an empty table gives no rows; other columns are not read. Similarities equal
    to the threshold link.

    ``cell_bytes`` is the text that one cell of hashes stands for, ``hot`` the documents of a
    batch from which a shingle is one entry, ``block`` the classes of a block of a large set (``WIDE`` times as
    many where blocks are joined with each other).
    """
    c = Candidates(docs, k, threshold, slice_bytes, cell_bytes, hot)
    linked = c.spanning(block)
    named = c.classes.select("ckey", "cls", "rep_id").join(linked, c.classes.cls == linked.node, "left").select("ckey", "rep_id", F.coalesce("component", "cls").alias("component"))
    least = named.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    of_key = named.join(least, "component").select("ckey", "component_id")
    near = c.rows.join(of_key, "ckey").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return near.unionByName(c.sets.where("keys is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def jaccard_links(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (3, 4), slice_bytes: int = 1 << 21, cell_bytes: int = 6 << 20, hot: int = 64, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """Every link: ``a, b, common, similarity`` of classes of equal sets, and ``doc_id, n_shingles,
    class, links`` of documents: its class (null without shingles) and how many other documents it
    links with, those of its own class included. Copies are not expanded into pairs. All candidate
    pairs are verified, so this takes the square of a group of different texts that are all alike;
    :func:`jaccard_components` does not. Odd rows are treated as there."""
    c = Candidates(docs, k, threshold, slice_bytes, cell_bytes, hot)
    pairs = c.links(c.between(c.members.withColumn("label", F.col("cls")), block), every=True)
    sizes = stored(c.rows.groupBy("ckey").agg(F.count("*").alias("copies")).join(c.classes, "ckey").select("ckey", "cls", "n", "copies"), "sizes")
    both = pairs.select(F.col("a").alias("cls"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("a").alias("other")))
    far = both.join(sizes.select(F.col("cls").alias("other"), "copies"), "other").groupBy("cls").agg(F.sum("copies").alias("far"))
    per = sizes.join(far, "cls", "left").select("ckey", "cls", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    near = c.rows.join(per, "ckey").select("doc_id", F.col("n").alias("n_shingles"), F.col("cls").alias("class"), "links")
    alone = c.sets.where("keys is null").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("row")).alias("class"), F.lit(0).cast("bigint").alias("links"))
    n = lambda side: sizes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"))
    pairs = pairs.join(n("a"), "a").join(n("b"), "b").select("a", "b", "common", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("similarity"))
    return pairs, near.unionByName(alone)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, without near duplicates: of each component one row
    stays, that with the smallest doc_id (a null one comes last; of rows with that id the first as
    read). Rows without words are linked with nothing and all stay. Rows are told apart by a number
    that is written with them, so repeated doc_ids do no harm."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").alias("id"), F.col("text").alias("body"), row.alias("row")), "numbered")
    named = jaccard_components(numbered.select(F.col("number").alias("doc_id"), F.col("body").alias("text")), **options).select(F.col("doc_id").alias("number"), "component_id")
    alone = named.groupBy("component_id").agg(F.count("*").alias("c"), F.min("number").alias("number"))
    several = named.join(alone.where("c > 1").select("component_id"), "component_id").join(numbered.select("number", "id"), "number")
    best = several.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "number")).alias("best"))
    gone = stored(several.join(best, "component_id").where("number <> best.number").select("number"), "near_duplicates")
    return numbered.join(gone, "number", "left_anti").select("row.*")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


SQL = {
    "op10_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(r, t) AS (SELECT r, r FROM w UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.t),
least AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.t GROUP BY reach.r)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.component_id FROM w LEFT JOIN n USING (r) JOIN least USING (r)
"""
}
