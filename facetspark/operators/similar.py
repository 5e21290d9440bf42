"""Rows of similar titles: pooled, gated, scored, capped and merged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .ordering import cap_groups, merge_heads
from .vectors import scan_spaces, z_map


@dataclass(frozen=True)
class Knobs:
    """Weights and limits of a row. The defaults are fixed values."""

    pool_k: int = 400
    w_premise: float = 0.55
    w_plot: float = 0.45
    pool_floor_pct: int = 10
    spread_low_pct: int = 10
    spread_high_pct: int = 90
    min_confidence: float = 0.55
    tone_floor: float = 0.35
    cross_top: int = 3
    same_animation: bool = True
    mix_media: bool = True
    min_rating: float = 0.0
    min_votes: float = 0.0
    w_tone: float = 0.90
    w_noul: float = 1.60
    w_critique: float = 1.40
    w_coverage: float = 1.40
    w_maker: float = 1.20
    w_home: float = 0.15
    w_facet: float = 2.00
    w_world: float = -2.50
    w_character: float = 1.0
    w_series: float = 0.0
    w_region: float = 0.0
    w_year: float = 0.0
    w_popularity: float = 0.0
    w_structural: float = 0.0
    cap: int = 3
    window: int = 20
    max_row: int = 200

    def with_(self, **changes) -> Knobs:
        from dataclasses import replace

        return replace(self, **changes)


#: What a title may have in common with the seed, each a table (id, value) and weighted by the knob ``w_<name>``.
SIGNALS = ("tone", "noul", "critique", "coverage", "maker", "home", "facet", "world", "character", "series", "region", "year", "popularity", "structural")


def _against(vectors: DataFrame, seed: int) -> DataFrame:
    """Every other row with its dot products with one seed, in both spaces."""
    mine = vectors.where(F.col("id") == seed).select("vec", "half", "label").first()
    if mine is None:
        raise ValueError(f"no vectors of {seed}")
    spaces = scan_spaces(vectors, {"premise": ("half", list(mine.half)), "plot": ("vec", list(mine.vec))}, ["id", "label"])
    return spaces.where(F.col("id") != seed).withColumn("seed_label", F.lit(mine.label))


def premise_row(vectors: DataFrame, seed: int, pool: int = 40, size: int = 20) -> DataFrame:
    """The nearest by premise, a quarter more if also near by plot, a quarter less of another
    label; in whole quarters (M2)."""
    near = _against(vectors, seed)
    rank = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "id"))
    plot = near.orderBy(F.desc("plot"), "id").limit(size).select("id", F.lit(1).alias("in_plot"))
    top = near.orderBy(F.desc("premise"), "id").limit(pool).join(F.broadcast(plot), "id", "left")
    dotp = F.col("premise")
    score = 4 * dotp + F.when(F.col("in_plot").isNotNull(), dotp).otherwise(0) - F.when(F.col("label") != F.col("seed_label"), dotp).otherwise(0)
    return top.select("id", score.cast("bigint").alias("score")).withColumn("place", rank("score")).where(F.col("place") <= size)


def _at(values, percent: int):
    """The value at index min(n * percent // 100, n - 1) of an array's ascending order (W7); null of an empty one."""
    values = F.array_sort(values)
    return F.get(values, F.least(F.floor(F.size(values) * percent / 100), F.size(values) - 1).cast("int"))


def more_like_this(vectors: DataFrame, seed: int, labels: DataFrame, signals: dict[str, DataFrame], k: Knobs = Knobs(), nominated: DataFrame | None = None, animated: DataFrame | None = None, audience: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """``id, media, score, place, base, spread`` and a column for every signal (M3).

    The nearest ``pool_k`` of each media in both spaces and what is ``nominated`` (id, media) by shared
    makers, characters or structure are the pool. Cosines of the other media are put on the own media's
    scale; a missing one counts as the pool's ``pool_floor_pct`` percentile of the own media. Gates: ``keep``
    (id), audience (id, rating, votes) below the least, the other media if not mixed, no labels on record,
    animated (id) unlike the seed, and a tone below its floor, unless a title is unlabelled, shares a maker
    or a series, or is among the ``cross_top`` of the other media by plot; unknown passes. The score is the
    base, plus the spread of bases times the weighted signals. Each media's list is capped by leading
    subgenre, and the two are merged head by head. labels: (id, kind, value, p), kind ``subgenre`` or
    ``mood``; vectors: (id, media, vec, half); signals: see SIGNALS.

    Whatever follows the pool handles at most 4 * pool_k titles and the nominated ones; the vectors are read
    once, a batch at a time, and their dot products are written: statistics, both pools and scores read these.
    For rows of many seeds see :mod:`facetspark.operators.rows`."""
    mine = vectors.where(F.col("id") == seed).select("media", "vec", "half").first()
    if mine is None:
        raise ValueError(f"no vectors of {seed}")
    dots = scan_spaces(vectors, {"p": ("half", list(mine.half)), "l": ("vec", list(mine.vec))}, ["id", "media"])
    near = kept(dots.where(F.col("id") != seed).select("id", "media", (F.col("p") / 16129).alias("premise"), (F.col("l") / 16129).alias("plot")), "near")
    stats = {r.media: r for r in near.groupBy("media").agg(F.avg("premise").alias("pm"), F.stddev_pop("premise").alias("ps"), F.avg("plot").alias("lm"), F.stddev_pop("plot").alias("ls")).collect()}
    own = F.col("media") == F.lit(mine.media)
    rank = lambda c: F.row_number().over(Window.partitionBy("media").orderBy(F.desc(c), "id"))
    by_premise = near.withColumn("r", rank("premise")).where(F.col("r") <= k.pool_k).select("id", "media")
    by_plot = near.withColumn("r", rank("plot")).where(F.col("r") <= k.pool_k).select("id", "media", F.col("r").alias("plot_rank"))
    pool = by_premise.unionByName(by_plot, allowMissingColumns=True)
    if nominated is not None:
        pool = pool.unionByName(nominated.where(F.col("id") != seed).select("id", "media"), allowMissingColumns=True)
    pool = pool.groupBy("id", "media").agg(F.min("plot_rank").alias("plot_rank")).join(near.drop("media"), "id", "left")
    if not k.mix_media:
        pool = pool.where(own)
    if keep is not None:
        pool = pool.join(keep.select("id"), "id", "left_semi")
    if audience is not None and (k.min_rating or k.min_votes):
        pool = pool.join(audience.where((F.col("rating") < k.min_rating) | (F.col("votes") < k.min_votes)).select("id"), "id", "left_anti")
    s, o = stats.get(mine.media), next((v for m, v in stats.items() if m != mine.media), None)
    if s and o:
        lit = lambda r, c: F.lit(float(r[c]))
        pool = pool.withColumns({c: F.when(own, F.col(c)).otherwise(z_map(F.col(c), lit(s, m), lit(s, d), lit(o, m), lit(o, d))) for c, m, d in (("premise", "pm", "ps"), ("plot", "lm", "ls"))})
    pool = kept(pool, "pool")  # bounded, and so are the lists of its values
    floor = pool.agg(*[F.coalesce(_at(F.collect_list(F.when(own, F.col(c))), k.pool_floor_pct), F.lit(0.0)) for c in ("premise", "plot")]).first()
    pool = pool.withColumns({"floor_p": F.lit(floor[0]), "floor_l": F.lit(floor[1])})
    sure = labels.where(F.col("p") >= k.min_confidence)
    of = labels.groupBy("id").agg(F.max("p").alias("best"))
    dominant = sure.where("kind = 'subgenre'").groupBy("id").agg(F.min(F.struct((-F.col("p")).alias("p"), "value")).alias("x")).select("id", F.col("x.value").alias("sub"))
    pool = pool.join(of, "id").join(dominant, "id", "left")  # without labels on record a title is out
    if animated is not None and k.same_animation:
        flag = not animated.where(F.col("id") == seed).isEmpty()
        pool = pool.join(animated.select("id"), "id", "left_semi" if flag else "left_anti")
    given = {"tone": tone(sure, seed)} | {n: df for n, df in signals.items() if n in SIGNALS}
    for name, df in given.items():
        value = next(c for c in df.columns if c != "id")
        pool = pool.join(df.select("id", F.col(value).alias(name)), "id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(1.0 if name == "tone" else 0.0)))
    has = lambda name: (F.col(name) > 0) if name in given else F.lit(False)
    across = ~own & F.coalesce(F.col("plot_rank") <= k.cross_top, F.lit(False))
    in_series = has("series") if k.w_series else F.lit(False)
    pool = pool.where((F.col("best") < k.min_confidence) | has("maker") | across | in_series | (F.col("tone") >= k.tone_floor))
    pool = pool.withColumn("base", k.w_premise * F.coalesce("premise", "floor_p") + k.w_plot * F.coalesce("plot", "floor_l"))
    pool = kept(pool, "judged")
    of_own, of_all = F.collect_list(F.when(own, F.col("base"))), F.collect_list("base")
    bases = F.when(F.size(of_own) > 0, of_own).otherwise(of_all)
    low, high = pool.agg(_at(bases, k.spread_low_pct), _at(bases, k.spread_high_pct)).first()
    pool = pool.withColumn("spread", F.lit(max((high or 0.0) - (low or 0.0), 2.220446049250313e-16)))
    lift = F.lit(0.0)
    for name in given:
        lift = lift + getattr(k, f"w_{name}") * F.col(name)
    scored = pool.withColumn("score", F.round(F.col("base") + F.col("spread") * lift, 6)).withColumn("list", own.cast("int"))
    scored = scored.withColumn("pos", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id"))).withColumn("sub", F.col("sub").cast("string"))
    show = ["id", "media", "score", "base", "spread", *given]
    capped = cap_groups(scored.select("list", "pos", "sub", *show), k.cap, k.window, k.max_row).select(*show, F.col("list").alias("own"), F.lit(0).alias("list"), F.col("place").alias("pos"))
    return merge_heads(capped).where(F.col("place") <= k.max_row).select("id", "media", "score", "place", F.round("base", 6).alias("base"), F.round("spread", 6).alias("spread"), *[F.round(n, 6).alias(n) for n in given])


def noul_cosine(scores: DataFrame, seed: int, floor: float = 0.2) -> DataFrame:
    """``id, cos``: the cosine of axis scores of ``floor`` or more (F12). scores: (id, axis, p)."""
    kept = scores.where(F.col("p") >= floor)
    mine = kept.where(F.col("id") == seed).select("axis", F.col("p").alias("y"))
    norm = F.sqrt(F.lit(float(mine.agg(F.sum(F.col("y") * F.col("y"))).first()[0] or 0.0)))
    rows = kept.where(F.col("id") != seed).join(F.broadcast(mine), "axis", "left")  # one title's axes
    per = rows.groupBy("id").agg(F.sum(F.coalesce(F.col("p") * F.col("y"), F.lit(0.0))).alias("d"), F.sum(F.col("p") * F.col("p")).alias("a"))
    return per.select("id", F.round(F.when(norm > 0, F.col("d") / (F.sqrt("a") * norm)).otherwise(0.0), 6).alias("cos"))


def worth_suggesting(seeds: DataFrame, titles: DataFrame, floor: int = 150, rating: int = 5) -> DataFrame:
    """``seed, id``: titles that may be suggested beside a seed; what is unknown passes."""
    s = seeds.select(F.col("id").alias("seed"), "media", "genre", F.col("votes").alias("seed_votes"))
    unknown = F.col("votes") == 0
    return titles.join(s, ["media", "genre"]).where((F.col("id") != F.col("seed")) & (unknown | (F.col("votes") >= F.least(F.floor(F.col("seed_votes") / 10), F.lit(floor)))) & (unknown | (F.col("disc") >= rating * F.col("votes")))).select("seed", "id")


def facet_agreement(titles: DataFrame, bridge: DataFrame, seed: int) -> DataFrame:
    """``id, agreement``: of the seed's facets that a title knows, the share it has in common,
    each weighted by how rare the seed's value is (F11)."""
    n = titles.groupBy("media").agg(F.count("*").alias("n"))
    rarity = bridge.groupBy("media", "kind", "value").agg(F.count("*").alias("c")).join(F.broadcast(n), "media").select("media", "kind", "value", F.log(F.col("n") / F.col("c")).alias("w"))
    own = bridge.where(F.col("id") == seed).join(rarity, ["media", "kind", "value"]).select("kind", F.col("value").alias("mine"), "w")
    both = bridge.where(F.col("id") != seed).join(F.broadcast(own), "kind")
    return both.groupBy("id").agg(F.round(F.sum(F.when(F.col("value") == F.col("mine"), F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("agreement"))


def structural_affinity(rows: DataFrame, seed: int, span: float, limit: int) -> DataFrame:
    """``id, affinity``: 1 - the mean distance over the axes (M5, F14). rows: (id, axes)."""
    s = F.broadcast(rows.where(F.col("id") == seed).select(F.col("axes").alias("mine")))
    gap = F.aggregate(F.zip_with("axes", "mine", lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = rows.where(F.col("id") != seed).join(s, F.lit(True)).select("id", F.round(1 - gap / (F.lit(span) * F.size("axes")), 6).alias("affinity"))
    return out.orderBy(F.desc("affinity"), "id").limit(limit)


def tone(labels: DataFrame, seed: int) -> DataFrame:
    """``id, tone``: the mean over label families of the share of the seed's confidence that a
    title's labels cover; a title without labels of a family is not judged by it, and one
    without any has tone 1 (F10). labels: (id, kind, value, p)."""
    mine = labels.where(F.col("id") == seed).select("kind", F.col("value").alias("mine"), F.col("p").alias("w"))
    families = labels.where(F.col("id") != seed).select("id", "kind").distinct().join(F.broadcast(mine), "kind")
    has = labels.select("id", "kind", F.col("value").alias("mine"), F.lit(1).alias("hit")).distinct()
    per = families.join(has, ["id", "kind", "mine"], "left").groupBy("id", "kind").agg((F.sum(F.when(F.col("hit") == 1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("t"))
    return per.groupBy("id").agg(F.round(F.avg("t"), 6).alias("tone"))


def coverage(scores: DataFrame, weights: DataFrame, seed: int, holds: float = 0.7) -> DataFrame:
    """``id, coverage``: of the axes that hold for the seed (p of ``holds`` or more), weighted by
    rarity, the share of p that a title has (F12). scores: (id, axis, p); weights: (axis, idf)."""
    own = F.broadcast(scores.where((F.col("id") == seed) & (F.col("p") >= holds)).join(weights, "axis").select("axis", "idf"))
    total = own.agg(F.sum("idf")).first()[0] or 0.0
    per = scores.where(F.col("id") != seed).join(own, "axis").groupBy("id").agg(F.sum(F.col("p") * F.col("idf")).alias("x"))
    return per.select("id", F.round(F.col("x") / F.lit(total or 1.0), 6).alias("coverage"))


def centred_cosine(scores: DataFrame, seed: int) -> DataFrame:
    """``id, cos``: the cosine of axis scores, each less its axis's mean."""
    mean = F.broadcast(scores.groupBy("axis").agg(F.avg("p").alias("m")))
    c = scores.join(mean, "axis").select("id", "axis", (F.col("p") - F.col("m")).alias("x"))
    own = F.broadcast(c.where(F.col("id") == seed).select("axis", F.col("x").alias("y")))
    dots = c.where(F.col("id") != seed).join(own, "axis").groupBy("id").agg(F.sum(F.col("x") * F.col("y")).alias("d"), F.sum(F.col("x") * F.col("x")).alias("a"), F.sum(F.col("y") * F.col("y")).alias("b"))
    return dots.select("id", F.round(F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("d") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0), 4).alias("cos"))


def year_proximity(a, b):
    """2^(-gap/10)."""
    return F.pow(F.lit(2.0), -F.abs(a - b) / 10.0)


def world_gap(a, b, low: float = 0.0, high: float = 0.7):
    """How far two titles' worlds are apart, each clamped to [low, high]."""
    clamp = lambda x: F.least(F.lit(high), F.greatest(F.lit(low), x))
    return F.abs(clamp(a) - clamp(b)) / (high - low)


def origin_affinity(origins: DataFrame, seed: int) -> DataFrame:
    """``id, affinity`` by the first two countries: 1 if the first are one, .5 if any is shared, .25 if
    a region is, else 0 (F15). origins: (id, pos from 0, country, region)."""
    few = origins.where("pos < 2")
    own = F.broadcast(few.where(F.col("id") == seed).select(F.col("pos").alias("p2"), F.col("country").alias("c2"), F.col("region").alias("r2")))
    same = F.col("country") == F.col("c2")
    score = F.when(same & (F.col("pos") == 0) & (F.col("p2") == 0), 1.0).when(same, 0.5).when(F.col("region") == F.col("r2"), 0.25).otherwise(0.0)
    return few.where(F.col("id") != seed).join(own, F.lit(True)).groupBy("id").agg(F.max(score).alias("affinity"))


def maker_share(credits: DataFrame, seed: int) -> DataFrame:
    """``id, share``: of the seed's makers, the share that made a title too (F16)."""
    own = credits.where((F.col("role") == "maker") & (F.col("id") == seed)).select("entity").distinct()
    n = own.count()
    both = credits.where((F.col("role") == "maker") & (F.col("id") != seed)).select("id", "entity").distinct().join(own, "entity")
    return both.groupBy("id").agg(F.round(F.count("*") / F.lit(max(n, 1)), 6).alias("share"))


def might_also_like(own_picks: DataFrame, tail: DataFrame, keep_out: DataFrame, head: DataFrame, least: int = 3, limit: int = 200) -> DataFrame:
    """``id, place`` (M4): a seed's own picks in order, then the fan tail by score, without what is
    kept out and what the row of similar titles has already shown; nothing if under ``least``
    remain. own_picks: (id, rank); tail: (id, score); keep_out, head: (id)."""
    both = own_picks.select("id", F.lit(0).alias("part"), F.col("rank").cast("double").alias("k")).unionByName(tail.select("id", F.lit(1).alias("part"), (-F.col("score")).alias("k")))
    both = both.join(keep_out.unionByName(head).distinct(), "id", "left_anti")
    once = both.groupBy("id").agg(F.min(F.struct("part", "k")).alias("at"))
    place = F.row_number().over(Window.orderBy("at", "id"))
    out = once.orderBy("at", "id").limit(limit).withColumn("place", place).withColumn("n", F.count("*").over(Window.partitionBy()))
    return out.where(F.col("n") >= least).select("id", "place")
