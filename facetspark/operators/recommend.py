"""Taste and billboard ranking."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import centroid, weighted_nearest


def value_shares(bridge: DataFrame) -> DataFrame:
    """``kind, value, share``: of the titles that know a kind, the share with a value."""
    n = bridge.select("kind", "media", "id").distinct().groupBy("kind").agg(F.count("*").alias("n"))
    return bridge.groupBy("kind", "value").agg(F.count("*").alias("c")).join(F.broadcast(n), "kind").select("kind", "value", F.round(F.col("c") / F.col("n"), 6).alias("share"))


def lift(bridge: DataFrame, library: DataFrame, shares: DataFrame) -> DataFrame:
    """``kind, value, lift``: log of (c + 3s) / ((n + 3)s), where c is the signed weight of a user's
    titles with the value (at least 0), n the weight of those that know the kind, s the value's
    share of the corpus (A18). library: (id, weight), one user's, which is small."""
    own = bridge.join(library, "id")
    n = own.where("weight > 0").groupBy("kind").agg(F.sum("weight").alias("n"))
    c = own.groupBy("kind", "value").agg(F.greatest(F.sum("weight"), F.lit(0)).alias("c"))
    return c.join(n, "kind").join(shares, ["kind", "value"]).select("kind", "value", F.round(F.log((F.col("c") + 3 * F.col("share")) / ((F.col("n") + 3) * F.col("share"))), 6).alias("lift"))


def freshness(days_after, behind: float = 120.0, ahead: float = 45.0):
    """exp(-d/behind) d days after release, exp(d/ahead) before it (F17, a day's precision)."""
    return F.when(days_after >= 0, F.exp(-days_after / behind)).otherwise(F.exp(days_after / ahead))


def quality(total, votes, prior: float = 6.6, weight: int = 200):
    """A rating drawn to the prior, from 0 at 6 or less to 1 at 8 or more."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((total + prior * weight) / (votes + weight) - 6) / 2))


def attention(votes, top: int = 5000):
    """Logarithmic popularity, 1 at ``top`` votes."""
    return F.least(F.lit(1.0), F.log1p(votes.cast("double")) / F.log1p(F.lit(float(top))))


def billboard_score(fit, q, fresh, arrival, buzz):
    """fit^2 (.2 + .8q)(.2 + .8 max(fresh, arrival))(1 + .1 buzz)."""
    return fit * fit * (0.2 + 0.8 * q) * (0.2 + 0.8 * F.greatest(fresh, arrival)) * (1 + 0.1 * buzz)


def logistic(x, mid: float, scale: float):
    return 1 / (1 + F.exp(-(x - mid) / scale))


def saturation(m):
    """1 - exp(-m/12): the more people in common, the less each adds."""
    return 1 - F.exp(-m / 12.0)


def merge_records(records: DataFrame, key: str, fields: list[str], flags: list[str]) -> DataFrame:
    """One record a key: each field from the first source (by ``source``, then ``pos``) that has
    it, flags if any has them (A27)."""
    order = F.struct("source", "pos")
    pick = [F.min_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return records.groupBy(key).agg(*pick, *[F.bool_or(f).alias(f) for f in flags], F.count("*").alias("sources"))


def two_phase(candidates: DataFrame, sketch: str, fit: str, wide: int, size: int, least: float) -> DataFrame:
    """The ``wide`` best by a cheap score, of these the ``size`` best by the full one that reach
    ``least`` (T9)."""
    return candidates.orderBy(F.desc(sketch), "id").limit(wide).where(F.col(fit) >= least).orderBy(F.desc(fit), "id").limit(size)


# Fixed values of the slate.
TEN, LEAD_FIT, EACH_MEDIA, POOR_QUALITY, POOR, STALE, RULE_FIT, RULE_COST = 10, 0.25, 3, 0.2, 1, 3, 0.5, 3.0


def slate(pool: DataFrame, size: int) -> DataFrame:
    """``list, id, place``: a greedy slate from each list's pool by score (T10). The first ten places go to
    titles of a fit of ``LEAD_FIT`` or more while there are any. In each run of ten, four wishes, the first
    the most important: no more than ``POOR`` of poor quality; no more than ``STALE`` stale ones; a media that
    is short of its ``EACH_MEDIA`` places, once no more places are open than are owed; and no two of one group.
    They are bought only within bounds: of the titles that fit ``RULE_FIT`` or more and whose score is at least
    a third (``RULE_COST``) of the best one's, the first that grants the most important wishes is taken, and
    the best one where no other grants more. Pools are bounded (a few hundred rows a list) and a list is one
    group of applyInPandas. pool: (list, id, media, grp, score, fit, quality, is_stale)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        left = list(pdf.sort_values(["score", "id"], ascending=[False, True]).itertuples(index=False))
        medias, out = sorted(set(pdf["media"])), []
        while left and len(out) < size:
            ten = out[len(out) - len(out) % TEN :]
            fitting = [r for r in left if len(out) >= TEN or r.fit >= LEAD_FIT]
            owed = {m: EACH_MEDIA - sum(x.media == m for x in ten) for m in medias if any(r.media == m for r in fitting)}
            owed = {m: n for m, n in owed.items() if n > 0}
            full = TEN - len(ten) <= sum(owed.values())
            poor, stale, groups = sum(x.quality < POOR_QUALITY for x in ten), sum(x.is_stale for x in ten), {x.grp for x in ten}

            def granted(r) -> tuple:
                return poor < POOR or r.quality >= POOR_QUALITY, stale < STALE or not r.is_stale, not full or r.media in owed, r.grp not in groups

            best = fitting[0] if fitting else left[0]
            if fitting:
                bought = [r for r in fitting[1:] if r.fit >= RULE_FIT and r.score * RULE_COST >= fitting[0].score]
                best = max([best, *bought], key=granted)  # of equals the first
            out.append(best)
            left.remove(best)
        return pd.DataFrame({"list": [r.list for r in out], "id": [r.id for r in out], "place": range(1, len(out) + 1)}).astype({"list": "int32", "id": "int64", "place": "int32"})

    return pool.groupBy("list").applyInPandas(pick, "list int, id bigint, place int")


# Fixed values of the billboard.
CATALOGUE_DAYS, CATALOGUE_ARRIVAL, NO_TASTE, REASON_LIFT, GOOD_QUALITY, JUDGED_ENOUGH = 730, 0.25, 0.5, 0.05, 0.65, 20


def pooled(lists: DataFrame) -> DataFrame:
    """``id, rank_standing, arrival_standing, sources``: every candidate of the lists once, with the best of
    its standings, 1 - rank/of (W13), among ranked and among arrival lists (M16). lists: (id, source, kind,
    rank from 0, of), kind ``chart``, ``arrival`` or ``offer`` (no rank counts)."""
    standing = F.greatest(F.lit(0.0), 1 - F.col("rank") / F.col("of"))
    return lists.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("kind") == "chart", standing)), F.lit(0.0)).alias("rank_standing"), F.coalesce(F.max(F.when(F.col("kind") == "arrival", standing)), F.lit(0.0)).alias("arrival_standing"), F.count_distinct("source").alias("sources"))


def billboard(pool: DataFrame, titles: DataFrame, now, fits: DataFrame | None = None, owned: DataFrame | None = None, hide: F.Column | None = None, busiest: float = 0.0) -> DataFrame:
    """``id, media, score, fit, quality, fresh, arrived, buzz, reason`` of the pool's titles that are kept (M16,
    F17-F20): not owned (id), not hidden, and judged (of a known genre) if at least ``JUDGED_ENOUGH`` are. fits:
    (id, fit, reason, reason_lift); without, or for a title without, ``NO_TASTE``. An arrival of a title out
    for over ``CATALOGUE_DAYS`` counts a quarter. Buzz is the best rank standing or logarithmic votes beside
    the ``busiest``. The reason is what lifts the score most above its floor, in logarithms, if by at least
    ``REASON_LIFT``. titles: (id, media, genre, votes, disc, first_day)."""
    rows = pool.join(titles, "id")
    if owned is not None:
        rows = rows.join(owned.select("id"), "id", "left_anti")
    if hide is not None:
        rows = rows.where(~hide)
    enough = F.count("genre").over(Window.partitionBy()) >= JUDGED_ENOUGH  # the pool is bounded
    rows = rows.withColumn("enough", enough).where(~F.col("enough") | F.col("genre").isNotNull()).drop("enough")
    if fits is not None:
        rows = rows.join(fits.select("id", "fit", F.col("reason").alias("fit_reason"), "reason_lift"), "id", "left")
    else:
        rows = rows.withColumns({"fit": F.lit(None).cast("double"), "fit_reason": F.lit(None).cast("string"), "reason_lift": F.lit(None).cast("double")})
    gone = F.datediff(now, F.col("first_day"))
    log = lambda x: F.log1p(x.cast("double"))
    popular = F.least(F.lit(1.0), log(F.col("votes")) / F.log1p(F.lit(float(busiest)))) if busiest > 0 else F.lit(0.0)
    rows = rows.withColumns(
        {
            "fit": F.coalesce("fit", F.lit(NO_TASTE)),
            "fresh": F.coalesce(freshness(gone), F.lit(0.0)),
            "arrived": F.col("arrival_standing") * F.when(gone > CATALOGUE_DAYS, CATALOGUE_ARRIVAL).otherwise(1.0),
            "quality": quality(F.col("disc"), F.col("votes")),
            "buzz": F.greatest(F.col("rank_standing"), popular),
        }
    )
    score = billboard_score(F.col("fit"), F.col("quality"), F.col("fresh"), F.col("arrived"), F.col("buzz"))
    timely = F.greatest("fresh", "arrived")
    timely_reason = F.when(F.col("arrived") >= F.col("fresh"), "arrived").when(gone < 0, "upcoming").otherwise("recent")
    floor = lambda x: F.log((0.2 + 0.8 * x) / 0.2)
    option = lambda lift, order, name, when: F.when(when, F.struct(lift.alias("lift"), F.lit(-order).alias("order"), name.alias("name")))
    options = F.array(
        option(F.col("reason_lift"), 0, F.col("fit_reason"), F.col("fit_reason").isNotNull()),
        option(floor(F.col("quality")), 1, F.lit("quality"), (F.col("quality") >= GOOD_QUALITY) & (F.col("votes") > 0)),
        option(floor(timely), 2, timely_reason, timely > 0),
        option(F.log(1 + 0.1 * F.col("buzz")), 3, F.lit("buzz"), (F.col("buzz") > 0) & (F.col("rank_standing") >= F.col("buzz"))),
    )
    best = F.array_max(F.filter(options, lambda x: x.isNotNull() & (x["lift"] >= REASON_LIFT)))
    return rows.select("id", "media", "genre", F.round(score, 6).alias("score"), *[F.round(x, 6).alias(x) for x in ("fit", "quality", "fresh", "arrived", "buzz")], best["name"].alias("reason"), gone.alias("gone"))


# Fixed values of the fit.
LIFT_PRIOR, W_SIMILAR, W_PROFILE, W_PEOPLE, THIN, MIDPOINT, REPULSION, FRANCHISE_LIFT, FIT_SAMPLE = 3.0, 0.3, 0.7, 2.0, 0.5, 2.0, 0.5, 0.5, 3000


def personal_fit(values: DataFrame, library: DataFrame, weights: dict[str, float], thin: list[str], vectors: DataFrame | None = None, credits: DataFrame | None = None, series: DataFrame | None = None, links: DataFrame | None = None, sample: int = FIT_SAMPLE) -> DataFrame:
    """``id, fit, similar, profile, people, confidence, reason, reason_lift`` of every title (M17, F22). values:
    (id, kind, value, p); library: (id, weight), one user's, a dislike weighing less than 0; credits: (id,
    entity, share); vectors: (id, vec); series: (id, series, strength); links: (id, other, strength).

    *Profile*: the lifts of a title's values, averaged within a kind by p, weighted over kinds; a value the
    library has none of has the lift of that. *Similar*: the weighted mean of the five nearest liked
    titles' cosines, less the cosine with the corpus mean. Both are standardised over at most ``sample``
    titles, those with the smallest hashes, which is the operator's definition. *People*: liked
    titles' people, the more telling the fewer titles they have. The evidence, less where a disliked title
    is nearer than the liked ones, goes through a logistic curve; a followed series lifts what is left.
    ``thin`` are the kinds that a title without a vector is judged by. The reason is the term without which
    the fit would lose most.

    One user's library is small; what is broadcast is made of it (its values, people, series)."""
    liked = library.where("weight > 0")
    known = values.where(F.col("kind").isin(*weights))
    own = known.join(library, "id")
    carried = {r.kind: r.n for r in known.select("id", "kind").distinct().join(liked, "id").groupBy("kind").agg(F.sum("weight").cast("double").alias("n")).collect()}
    counts = own.groupBy("kind", "value").agg(F.greatest(F.sum(F.col("weight") * F.col("p")), F.lit(0.0)).alias("c"))
    n = known.select("kind", "id").distinct().groupBy("kind").agg(F.count("*").alias("n"))
    shares = known.groupBy("kind", "value").agg(F.count("*").alias("c")).join(n, "kind").select("kind", "value", (F.col("c") / F.col("n")).alias("share"))
    of_kind = lambda f: F.create_map(*[F.lit(x) for k in weights for x in (k, float(f(k)))])[F.col("kind")]
    lifts = counts.join(shares, ["kind", "value"]).select("kind", "value", F.log((F.col("c") + LIFT_PRIOR * F.col("share")) / ((of_kind(lambda k: carried.get(k, 0.0)) + LIFT_PRIOR) * F.col("share"))).alias("lift"))
    unseen = of_kind(lambda k: math.log(LIFT_PRIOR / (carried.get(k, 0.0) + LIFT_PRIOR)))
    per = known.join(lifts, ["kind", "value"], "left").groupBy("id", "kind").agg((F.sum(F.col("p") * F.coalesce("lift", unseen)) / F.sum("p")).alias("x"))
    profile = per.groupBy("id").agg(F.sum(F.col("x") * of_kind(weights.get)).alias("lifted"), F.count_if(F.col("kind").isin(*thin)).alias("thin"))
    none = lambda kind="double": F.lit(None).cast(kind)
    if vectors is not None:
        e = vectors.select("id", "vec")
        near = weighted_nearest(e, e.join(liked, "id").select("id", "vec", "weight"))
        rows = profile.join(near.withColumnRenamed("score", "near"), "id", "left")
        bad = e.join(library.where("weight < 0"), "id").select("id", "vec", F.lit(1.0).alias("weight"))
        rows = rows.join(weighted_nearest(e, bad, 1).withColumnRenamed("score", "against"), "id", "left")
        mean = [r.total / r.n for r in centroid(e, []).orderBy("pos").collect()]
        hub = F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(x)) for x in mean]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        rows = rows.join(e.select("id", hub.alias("hub")), "id", "left").withColumns({"near": (F.col("near") - F.col("hub")) / 16129, "against": (F.col("against") - F.col("hub")) / 16129})
    else:
        rows = profile.withColumns({"near": none(), "against": none()})
    few = rows.orderBy((F.col("id") * 2654435761) % 4294967296, "id").limit(sample)
    st = few.agg(F.avg("near").alias("nm"), F.stddev_pop("near").alias("ns"), F.avg("lifted").alias("pm"), F.stddev_pop("lifted").alias("ps")).first()
    z = lambda c, m, s: F.when(F.lit(float(s or 0)) > 0, (F.col(c) - float(m or 0)) / float(s or 1)).when(F.col(c).isNotNull(), 0.0)
    rows = rows.withColumns({"similar": z("near", st.nm, st.ns), "against": z("against", st.nm, st.ns), "profile": z("lifted", st.pm, st.ps)})
    if credits is not None:
        titles = float(credits.select("id").distinct().count())
        followed = credits.join(liked, "id").groupBy("entity").agg(F.sum(F.col("weight") * F.col("share")).alias("followed"))
        has = credits.groupBy("entity").agg(F.count_distinct("id").alias("c")).join(followed, "entity").select("entity", (F.col("followed") * F.log(1 + titles / F.greatest("c", F.lit(1)))).alias("w"))
        met = credits.join(has, "entity").groupBy("id").agg(F.sum(F.col("share") * F.col("w")).alias("met"))
        rows = rows.join(met, "id", "left").withColumn("people", saturation(F.coalesce("met", F.lit(0.0))))
    else:
        rows = rows.withColumn("people", F.lit(0.0))
    lifted_by = None
    if series is not None:
        follows = series.join(library, "id").groupBy("series").agg(F.sum("weight").alias("w")).where("w > 0").select("series")
        lifted_by = series.join(follows, "series").select("id", "strength")
    if links is not None:
        linked = links.join(liked.select("id"), "id").select(F.col("other").alias("id"), "strength")
        lifted_by = linked if lifted_by is None else lifted_by.unionByName(linked)
    if lifted_by is not None:
        rows = rows.join(lifted_by.groupBy("id").agg(F.max("strength").alias("franchise")), "id", "left").withColumn("franchise", F.coalesce("franchise", F.lit(0.0)))
    else:
        rows = rows.withColumn("franchise", F.lit(0.0))
    seen = F.col("similar").isNotNull()
    sure = F.when(seen, 1.0).otherwise(THIN * F.col("thin") / len(thin))
    terms = {"similar": F.coalesce(W_SIMILAR * F.col("similar") * sure, F.lit(0.0)), "profile": F.when(seen, W_PROFILE * F.col("profile")).otherwise(F.col("profile")) * sure, "people": W_PEOPLE * F.col("people")}
    rows = rows.withColumns({"confidence": sure} | {f"t_{k}": t for k, t in terms.items()})
    repelled = F.coalesce(REPULSION * F.greatest(F.lit(0.0), F.col("against") - F.col("similar")), F.lit(0.0))
    rows = rows.withColumn("evidence", F.col("t_similar") + F.col("t_profile") + F.col("t_people") - repelled)

    def fitted(evidence, franchise):
        plain = 1 / (1 + F.exp(MIDPOINT - evidence))
        return plain + (1 - plain) * FRANCHISE_LIFT * franchise

    rows = rows.withColumn("raw", fitted(F.col("evidence"), F.col("franchise")))
    worth = lambda without: 2 * F.log(F.col("raw") / without)
    options = [F.struct(F.when(F.col(f"t_{k}") > 0, worth(fitted(F.col("evidence") - F.col(f"t_{k}"), F.col("franchise")))).otherwise(0.0).alias("lift"), F.lit(-i).alias("order"), F.lit(k).alias("name")) for i, k in enumerate(terms)]
    options.append(F.struct(worth(fitted(F.col("evidence"), F.lit(0.0))).alias("lift"), F.lit(-3).alias("order"), F.lit("franchise").alias("name")))
    rows = rows.withColumn("best", F.array_max(F.array(*options)))
    some = F.col("best.lift") > 0
    return rows.select("id", F.round("raw", 6).alias("fit"), *[F.round(x, 6).alias(x) for x in ("similar", "profile", "people", "confidence")], F.when(some, F.col("best.name")).alias("reason"), F.when(some, F.round("best.lift", 6)).alias("reason_lift"))
