"""Rows of similar titles for many seeds in one plan (M3, M5, K5), with the reason for every title that is in none.

A seed's candidates are found first and written; what scores them is then joined to these pairs of a seed and
a title only. All statistics, ranks and caps are of a seed, so tasks hold one seed's candidates at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import vectors as v
from .ordering import cap_groups, merge_heads
from .similar import SIGNALS, Knobs, _at

#: Why a title is in no row, in the order in which this is asked.
GATES = ("franchise", "kept", "audience", "unlabelled", "animation", "tone")

Signal = Callable[[DataFrame], DataFrame]


def _met(table: DataFrame, pairs: DataFrame, side: str = "id") -> DataFrame:
    """The rows of a table (id, ...) for titles on one side of the pairs, which are joined by sorting. Spark takes a
    table for as large as its files, where well packed ones are a tenth of their rows or less, and would send
    millions of these through the driver; of a semi join only the pairs' ids can be sent."""
    return table.join(pairs.select(F.col(side).alias("id")).distinct(), "id", "left_semi").hint("merge")


def nearest_both(vectors: DataFrame, seeds: DataFrame, pool_k: int) -> DataFrame:
    """``seed, id, media, plot_rank``: the nearest ``pool_k`` of each media in both spaces; plot_rank is null
    where a title is not among those by plot. vectors: (id, media, vec, half)."""
    rank = F.row_number().over(Window.partitionBy("seed", "media").orderBy(F.desc("dot"), "id"))

    def space(column: str) -> DataFrame:
        ours = vectors.select("id", "media", F.col(column).alias("vec"))
        near = v.knn(ours, ours.join(seeds, "id"), pool_k + 1, "media")  # the seed itself may be one
        return near.where("id <> seed").select("seed", "id", "media", rank.alias("r")).where(F.col("r") <= pool_k)

    both = space("half").select("seed", "id", "media", F.lit(None).cast("int").alias("plot_rank")).unionByName(space("vec").withColumnRenamed("r", "plot_rank"))
    return both.groupBy("seed", "id", "media").agg(F.min("plot_rank").alias("plot_rank"))


def candidates(vectors: DataFrame, seeds: DataFrame, k: Knobs = Knobs(), nominated: DataFrame | None = None) -> DataFrame:
    """``seed, id, media, own, plot_rank, premise, plot``, stored: every seed's pool, nearest and nominated (seed, id,
    media), with cosines on the scale of the seed's media; null for titles without a vector."""
    pool = nearest_both(vectors, seeds, k.pool_k)
    if nominated is not None:
        extra = nominated.join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi").where("id <> seed").select("seed", "id", "media", F.lit(None).cast("int").alias("plot_rank"))
        pool = pool.unionByName(extra).groupBy("seed", "id", "media").agg(F.min("plot_rank").alias("plot_rank"))
    asked = vectors.join(seeds, "id")
    side = lambda df, key, s, *more: df.select(F.col("id").alias(key), F.col("vec").alias(f"vec_{s}"), F.col("half").alias(f"half_{s}"), *more)
    pairs = pool.join(side(asked, "seed", "a", F.col("media").alias("seed_media")), "seed").join(side(vectors, "id", "b"), "id", "left")
    dots = v.pair_dots(pairs, {"premise": ("half_a", "half_b"), "plot": ("vec_a", "vec_b")})
    for space, column in (("premise", "half"), ("plot", "vec")):
        st = v.stats_of_seeds(asked, v.moments(vectors, "media", column), "media", column)
        theirs = st.select("seed", "media", F.col("mean").alias("m"), F.col("sd").alias("s"))
        ours = asked.select(F.col("id").alias("seed"), "media").join(st, ["seed", "media"]).select("seed", F.col("mean").alias("om"), F.col("sd").alias("os"))
        mapped = F.when(F.col("media") == F.col("seed_media"), F.col(space)).otherwise(v.z_map(F.col(space), F.col("om"), F.col("os"), F.col("m"), F.col("s")))
        dots = dots.join(theirs, ["seed", "media"], "left").join(ours, "seed", "left").withColumn(space, mapped / 16129).drop("m", "s", "om", "os")
    return kept(dots.select("seed", "id", "media", (F.col("media") == F.col("seed_media")).alias("own"), "plot_rank", "premise", "plot"), "candidates")


def tone_of_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``seed, id, tone``: the mean over label families of the share of the seed's confidence that a title's
    labels cover (F10). labels: (id, kind, value, p), sure ones only."""
    mine = _met(labels, pairs, "seed").select(F.col("id").alias("seed"), "kind", "value", F.col("p").alias("w"))
    theirs = _met(labels, pairs)
    families = pairs.join(theirs.select("id", "kind").distinct(), "id").join(mine, ["seed", "kind"])
    has = theirs.select("id", "kind", "value", F.lit(1).alias("hit")).distinct()
    per = families.join(has, ["id", "kind", "value"], "left").groupBy("seed", "id", "kind").agg((F.sum(F.when(F.col("hit") == 1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("t"))
    return per.groupBy("seed", "id").agg(F.round(F.avg("t"), 6).alias("tone"))


def share_of_makers(makers: DataFrame) -> Signal:
    """Of the seed's makers, the share that made a title too (F16). makers: (id, entity), each once."""

    def signal(pairs: DataFrame) -> DataFrame:
        mine = _met(makers, pairs, "seed").select(F.col("id").alias("seed"), "entity")
        n = mine.groupBy("seed").agg(F.count("*").alias("n"))
        both = pairs.join(mine, "seed").join(_met(makers, pairs), ["id", "entity"])
        return both.groupBy("seed", "id").agg(F.count("*").alias("c")).join(n, "seed").select("seed", "id", F.round(F.col("c") / F.col("n"), 6).alias("maker"))

    return signal


def agreement_of_facets(facets: DataFrame, sizes: DataFrame) -> Signal:
    """Of the seed's facets that a title knows, the share in common, weighted by how rare the seed's value is
    (F11). facets: (media, id, kind, value); sizes: (media, n), the titles of a media."""
    weight = facets.groupBy("media", "kind", "value").agg(F.count("*").alias("c")).join(sizes, "media").select("media", "kind", "value", F.log(F.col("n") / F.col("c")).alias("w"))

    def signal(pairs: DataFrame) -> DataFrame:
        mine = _met(facets, pairs, "seed").withColumnRenamed("id", "seed").join(weight, ["media", "kind", "value"]).select("seed", "kind", F.col("value").alias("mine"), "w")
        both = pairs.join(_met(facets, pairs).select("id", "kind", "value"), "id").join(mine, ["seed", "kind"])
        return both.groupBy("seed", "id").agg(F.round(F.sum(F.when(F.col("value") == F.col("mine"), F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("facet"))

    return signal


def of_profiles(profiles: DataFrame, name: str, value: Callable) -> Signal:
    """A signal from two rows of a profile (id, x): ``value`` of the seed's x and the title's."""

    def signal(pairs: DataFrame) -> DataFrame:
        mine = _met(profiles, pairs, "seed").select(F.col("id").alias("seed"), F.col("x").alias("mine"))
        both = pairs.join(mine, "seed").join(_met(profiles, pairs).select("id", "x"), "id")
        return both.select("seed", "id", value(F.col("mine"), F.col("x")).alias(name))

    return signal


def cosine_of(floor: float | None = None):
    """The cosine of two arrays of axis scores, those below ``floor`` counting as absent."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    kept_of = lambda a: a if floor is None else F.transform(a, lambda p: F.when(p >= floor, p).otherwise(0.0))

    def value(a, b):
        a, b = kept_of(a), kept_of(b)
        length = F.sqrt(add(F.transform(a, lambda x: x * x)) * add(F.transform(b, lambda x: x * x)))
        return F.when(length > 0, add(F.zip_with(a, b, lambda x, y: x * y)) / length).otherwise(0.0)

    return value


def rows(
    vectors: DataFrame,
    seeds: DataFrame,
    labels: DataFrame,
    signals: dict[str, Signal],
    k: Knobs = Knobs(),
    nominated: DataFrame | None = None,
    animated: DataFrame | None = None,
    audience: DataFrame | None = None,
    keep: DataFrame | None = None,
    franchise: DataFrame | None = None,
) -> DataFrame:
    """``seed, id, media, place, why, score, base, spread`` and a column a signal, of every candidate of every seed.

    The rules are :func:`~facetspark.operators.similar.more_like_this`'s, a seed at a time, and ``franchise`` (seed,
    id) are a seed's own that are no part of its row. Gates drop nothing: they are columns, and ``why`` is the
    first that fails (see GATES), ``length`` for what the row has no place for, and null for what is in it; only
    that has a place. seeds: (id), of any number; a seed without a vector has no row."""
    pool = candidates(vectors, seeds.select("id").distinct(), k, nominated)
    if not k.mix_media:
        pool = pool.where("own")
    pairs = pool.select("seed", "id")
    mark = lambda df, on, name: pool.join(df.select(*on, F.lit(True).alias(name)).distinct().hint("merge"), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    fails = {}
    if franchise is not None:
        pool = mark(franchise, ["seed", "id"], "in_franchise")
        fails["franchise"] = F.col("in_franchise")
    if keep is not None:
        pool = mark(_met(keep, pairs), ["id"], "is_kept")
        fails["kept"] = ~F.col("is_kept")
    if audience is not None and (k.min_rating or k.min_votes):
        pool = mark(_met(audience.where((F.col("rating") < k.min_rating) | (F.col("votes") < k.min_votes)), pairs), ["id"], "too_few")
        fails["audience"] = F.col("too_few")
    first = F.lit(True)
    for f in fails.values():
        first = first & ~f
    own = lambda c, gate: F.when(F.col("own") & gate, F.col(c))
    floor = lambda c: F.coalesce(_at(F.collect_list(own(c, first)), k.pool_floor_pct), F.lit(0.0))
    floors = pool.groupBy("seed").agg(floor("premise").alias("floor_p"), floor("plot").alias("floor_l"))
    pool = pool.join(floors, "seed")

    sure, theirs = labels.where(F.col("p") >= k.min_confidence), _met(labels, pairs)
    of = theirs.groupBy("id").agg(F.max("p").alias("best"))
    dominant = theirs.where((F.col("p") >= k.min_confidence) & (F.col("kind") == "subgenre")).groupBy("id").agg(F.min(F.struct((-F.col("p")).alias("p"), "value")).alias("x")).select("id", F.col("x.value").cast("string").alias("sub"))
    pool = pool.join(of, "id", "left").join(dominant, "id", "left")
    fails["unlabelled"] = F.col("best").isNull()
    if animated is not None and k.same_animation:
        pool = mark(_met(animated, pairs), ["id"], "drawn")
        pool = mark(_met(animated, pairs, "seed").select(F.col("id").alias("seed")), ["seed"], "seed_drawn")
        fails["animation"] = F.col("drawn") != F.col("seed_drawn")
    given = {"tone": lambda p: tone_of_pairs(p, sure)} | {n: f for n, f in signals.items() if n in SIGNALS}
    for name, signal in given.items():
        pool = pool.join(signal(pairs), ["seed", "id"], "left").withColumn(name, F.coalesce(F.col(name), F.lit(1.0 if name == "tone" else 0.0)))
    has = lambda name: (F.col(name) > 0) if name in given else F.lit(False)
    across = ~F.col("own") & F.coalesce(F.col("plot_rank") <= k.cross_top, F.lit(False))
    in_series = has("series") if k.w_series else F.lit(False)
    fails["tone"] = ~((F.col("best") < k.min_confidence) | has("maker") | across | in_series | (F.col("tone") >= k.tone_floor))
    why = F.coalesce(*[F.when(fails[g], g) for g in GATES if g in fails])
    pool = kept(pool.withColumn("why", why).withColumn("base", k.w_premise * F.coalesce("premise", "floor_p") + k.w_plot * F.coalesce("plot", "floor_l")), "judged")
    in_play = F.when(F.col("why").isNull(), F.col("base"))
    of_own, of_all = F.collect_list(F.when(F.col("own"), in_play)), F.collect_list(in_play)  # a seed's pool is bounded
    bases = pool.groupBy("seed").agg(F.array_sort(F.when(F.size(of_own) > 0, of_own).otherwise(of_all)).alias("bases"))
    spread = F.greatest(_at(F.col("bases"), k.spread_high_pct) - _at(F.col("bases"), k.spread_low_pct), F.lit(2.220446049250313e-16))
    pool = pool.join(bases.select("seed", spread.alias("spread")), "seed", "left")
    lift = F.lit(0.0)
    for name in given:
        lift = lift + getattr(k, f"w_{name}") * F.col(name)
    pool = kept(pool.withColumn("score", F.round(F.col("base") + F.col("spread") * lift, 6)), "scored")

    two = F.col("seed") * 2 + F.col("own").cast("int")
    listed = pool.where("why is null").select("seed", "id", "sub", "score", "own", two.alias("list"))
    listed = listed.withColumn("pos", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "id")))
    capped = cap_groups(listed, k.cap, k.window, k.max_row).select("seed", "id", "score", F.col("own").cast("int").alias("own"), F.col("seed").alias("list"), F.col("place").alias("pos"))
    placed = merge_heads(capped).where(F.col("place") <= k.max_row).select("seed", "id", "place")
    out = pool.join(placed, ["seed", "id"], "left")
    why = F.when(F.col("why").isNull() & F.col("place").isNull(), "length").otherwise(F.col("why"))
    return out.select("seed", "id", "media", "place", why.alias("why"), "score", F.round("base", 6).alias("base"), F.round("spread", 6).alias("spread"), *[F.round(n, 6).alias(n) for n in given])


def reasons(scored: DataFrame, titles: DataFrame, seeds: list[int]) -> DataFrame:
    """``seed, id, place, why`` of every title of the catalogue for a few seeds: its place, or the reason why it has
    none; ``far`` for one that was never a candidate. scored: :func:`rows`; titles: (id)."""
    if len(seeds) > 16:
        raise ValueError("reasons are for 16 seeds at most")
    every = titles.select("id", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])).alias("seed")).where("id <> seed")
    known = scored.where(F.col("seed").isin(seeds)).select("seed", "id", "place", "why", F.lit(True).alias("met"))
    return every.join(known, ["seed", "id"], "left").select("seed", "id", "place", F.when(F.col("met"), F.col("why")).otherwise(F.lit("far")).alias("why"))


def _agreement(s: np.ndarray, x: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lane 0: 1 - the mean gap over the axes; lane 1: gaps weighted by the seed's own axes."""
    every = np.arange(len(x))
    for lane in (0, 1):
        yield lane, every, np.stack([np.round(1 - (gap.mean(axis=1) if lane == 0 else gap @ own / own.sum()), 9) for own in s for gap in [np.abs(x - own)]])


def _by_structure(profiles: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """``seed, id, lane, agreement, r``: the k titles that agree most with a seed, broadly (lane 0: 1 - the mean gap over
    the axes) and in what the seed is about (lane 1: gaps weighted by the seed's own axes, F14). Seeds may be of any
    number: those with the same axes ask once, in blocks. Of titles with the same axes, which come by id, no more
    than the first k and a seed itself can be among its k."""
    known = profiles.where("axes is not null").select("id", "axes")
    about = F.aggregate("axes", F.lit(0.0), lambda a, x: a + x) > 0
    asked = known.join(seeds.select("id").distinct(), "id", "left_semi").where((F.size("axes") > 0) & F.coalesce(about, F.lit(False)))
    asked = asked.withColumn("of", F.min("id").over(Window.partitionBy("axes")))
    once = asked.where("id = of").select("id", F.lit(0).alias("kind"), F.col("axes").alias("vec")).distinct()
    alike = F.row_number().over(Window.partitionBy("axes").orderBy("id"))
    titles = known.withColumn("nth", alike).where(F.col("nth") <= k + 1).select("id", F.lit(0).alias("kind"), F.col("axes").alias("vec"))
    near = v.best_in_blocks(kept(titles, "profiles"), kept(once, "axes"), k + 1, _agreement, float, seed_block=1024, slice_seeds=32)
    near = near.select(F.col("seed").alias("of"), "id", F.col("kind").alias("lane"), F.col("value").alias("agreement"))
    both = asked.select(F.col("id").alias("seed"), "of").join(near.hint("merge"), "of").where("id <> seed")
    r = F.row_number().over(Window.partitionBy("seed", "lane").orderBy(F.desc("agreement"), "id"))
    return both.select("seed", "id", "lane", "agreement", r.alias("r")).where(F.col("r") <= k)


def structural_affinity(profiles: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """``seed, id, r``: the k titles that agree most in what the seed is about (M4's second branch, F14)."""
    return _by_structure(profiles, seeds, k).where("lane = 1").select("seed", "id", "r")


def structural_lanes(profiles: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """``seed, id, place, lane``: k titles a seed by structure (M5): half of them agree broadly, half in what the seed
    is about, a title once; what that leaves open is filled from both orders by turns. profiles: (id, axes from 0
    to 1). A seed without a profile or with an empty one has none."""
    both = _by_structure(profiles, seeds, 2 * k)
    # the first of both lanes by halves, lane after lane; then the rest, rank by rank
    head = F.when(F.col("lane") == 0, F.col("r") <= (k + 1) // 2).otherwise(F.col("r") <= k // 2)
    turn = F.when(head, F.struct(F.lit(0).alias("tail"), F.col("lane").alias("a"), F.col("r").alias("b"))).otherwise(F.struct(F.lit(1).alias("tail"), F.col("r").alias("a"), F.col("lane").alias("b")))
    once = both.groupBy("seed", "id").agg(F.min(F.struct(turn.alias("turn"), "lane")).alias("x"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy("x.turn", "id"))
    return once.withColumn("place", place).where(F.col("place") <= k).select("seed", "id", "place", F.col("x.lane").alias("lane"))


def mutual(of_seeds: DataFrame, of_firsts: DataFrame, n: int) -> DataFrame:
    """``seed, first, spot, mutual``: does a seed stand among the first n of the row of its row's first title (K5)? False
    for one with an empty row. Both: (seed, id, place), the second of the first titles' own rows."""
    first = of_seeds.where("place = 1").select("seed", F.col("id").alias("first"))
    back = of_firsts.where("place is not null").select(F.col("seed").alias("first"), F.col("id").alias("seed"), F.col("place").alias("spot"))
    every = of_seeds.select("seed").distinct().join(first, "seed", "left").join(back, ["first", "seed"], "left")
    return every.select("seed", "first", "spot", F.coalesce(F.col("spot") <= n, F.lit(False)).alias("mutual"))


def beats_plot(of_seeds: DataFrame, plot: DataFrame, gains: DataFrame, k: int) -> DataFrame:
    """``case, ndcg, plot, beats``: is a row strictly better than the order by plot alone (K5)? of_seeds, plot: (seed, id,
    place); gains: (seed, id, gain)."""
    from .evaluation import ndcg

    judged = lambda r: ndcg(r.where("place is not null").join(gains, ["seed", "id"], "left").select(F.col("seed").alias("case"), "place", "gain"), k)
    both = judged(of_seeds).join(judged(plot).withColumnRenamed("ndcg", "plot"), "case")
    return both.withColumn("beats", F.col("ndcg") > F.col("plot"))


def suggestions(seeds: DataFrame, fans: DataFrame, affine: DataFrame, similar: DataFrame, worth: DataFrame, limit: int = 200) -> DataFrame:
    """``seed, id, place, branch`` (M4 for many seeds): what fans picked (seed, id, place), branch 0; for a seed of which they
    say nothing, branch 1: what is affine by structure (seed, id, r), then its row of similar titles (seed, id,
    place), a title once, of which only what is worth suggesting (seed, id) stays."""
    known = fans.select("seed").distinct()
    first = fans.where(F.col("place") <= limit).select("seed", "id", "place", F.lit(0).alias("branch"))
    both = affine.select("seed", "id", F.lit(0).alias("part"), F.col("r").alias("k")).unionByName(similar.where("place is not null").select("seed", "id", F.lit(1).alias("part"), F.col("place").alias("k")))
    both = both.join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi").join(known, "seed", "left_anti").where("id <> seed").join(worth, ["seed", "id"], "left_semi")
    once = both.groupBy("seed", "id").agg(F.min(F.struct("part", "k")).alias("at"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy("at", "id"))
    second = once.withColumn("place", place).where(F.col("place") <= limit).select("seed", "id", "place", F.lit(1).alias("branch"))
    return first.unionByName(second)
