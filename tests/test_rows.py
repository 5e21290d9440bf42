"""Rows of similar titles for many seeds, block search, structural lanes and the checks of a row's shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.operators import rows, similar
from facetspark.operators import vectors as v
from facetspark.plans import rows as plans
from facetspark.plans import vectors as pv
from facetspark.sources import catalogue as c

from .conftest import SF


@pytest.mark.parametrize("options", [{}, {"row_block": 20, "seed_block": 7, "slice_seeds": 3}])
@pytest.mark.parametrize("media", [None, "media"])
def test_block_search_finds_what_all_products_give(spark, options, media):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (150, 5))  # small numbers, so that many products are equal
    df = spark.createDataFrame([(i, i % 2, [int(a) for a in r]) for i, r in enumerate(x)], "id bigint, media int, vec array<tinyint>")
    seeds, admit = df.where("id % 3 = 0"), df.where("id % 5 <> 1")
    got = sorted((r.seed, r["media"] if media else 0, r["rank"], r.id, r.dot) for r in v.knn_blocks(df, seeds, 6, media, admit.select("id"), **options).collect())
    want = []
    for s in range(0, 150, 3):
        for m in (0, 1) if media else (0,):
            best = sorted((-int(x[s] @ x[i]), i) for i in range(150) if i % 5 != 1 and (not media or i % 2 == m))[:6]
            want += [(s, m, k + 1, i, -d) for k, (d, i) in enumerate(best)]
    assert got == sorted(want)


def test_search_for_more_seeds_than_are_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, [i % 7 - 3, i % 5 - 2]) for i in range(60)], "id bigint, vec array<tinyint>")
    few = sorted(map(tuple, v.knn(df, df, 4).collect()))
    monkeypatch.setattr(v, "MAX_SEEDS", 10)
    assert sorted(map(tuple, v.knn(df, df, 4).collect())) == few


def test_statistics_of_seeds_from_moments_are_those_of_all_products(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-9, 10, (40, 4))
    df = spark.createDataFrame([(i, i % 2, [int(a) for a in r]) for i, r in enumerate(x)], "id bigint, media int, vec array<tinyint>")
    got = {(r.seed, r["media"]): (r["mean"], r.sd) for r in v.stats_of_seeds(df.where("id < 9"), v.moments(df, "media"), "media").collect()}
    for (s, m), stat in got.items():
        d = [x[s] @ x[i] for i in range(40) if i % 2 == m and i != s]
        assert stat == pytest.approx((np.mean(d), np.std(d)))
    assert len(got) == 18


def test_a_row_is_the_same_for_one_seed_and_for_many(spark):
    """What the one-seed operator says of seed 10, and what a plan of three seeds says of it."""
    d, seed, k = SF, 10, similar.Knobs(pool_k=60)
    e, labels = pv.vectors(spark, d), pv._labels(spark, d)
    makers = c.credits(spark, d).where("role = 'maker'").select("id", "entity").distinct()
    part = c.table(spark, d, "part")
    facets = c.bridge(spark, d, {"genre", "brand", "size"})
    drawn = part.where("p_partkey % 13 = 3").select(F.col("p_partkey").alias("id"))
    nominated = similar.maker_share(c.credits(spark, d), seed).select("id", (F.col("id") % 2).cast("int").alias("media"))
    one = similar.more_like_this(e, seed, labels, {"maker": similar.maker_share(c.credits(spark, d), seed), "facet": similar.facet_agreement(c.title_keys(spark, d), facets, seed)}, k, nominated, drawn)
    signals = {"maker": rows.share_of_makers(makers), "facet": rows.agreement_of_facets(facets, c.title_keys(spark, d).groupBy("media").agg(F.count("*").alias("n")))}
    many = rows.rows(e, e.where("id in (10, 7, 20)").select("id"), labels, signals, k, nominated.withColumn("seed", F.lit(seed).cast("bigint")), drawn)
    show = ["id", "media", "place", "score", "base", "spread", "tone", "maker", "facet"]
    want = {r.id: r for r in one.select(show).collect()}
    got = {r.id: r for r in many.where("seed = 10 and place is not null").select(show).collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(got[i].place == want[i].place and got[i] == pytest.approx(want[i], abs=2e-6) for i in want)
    assert {r.seed for r in many.where("place = 1").collect()} == {7, 10, 20}


def test_every_title_has_a_place_or_a_reason(spark):
    got = plans.m3_reasons(spark, SF).groupBy("seed", "why").agg(F.count("*").alias("n"), F.min("place").alias("least")).collect()
    titles = c.table(spark, SF, "part")
    for seed in {r.seed for r in got}:
        mine = {r.why: r for r in got if r.seed == seed}
        assert sum(r.n for r in mine.values()) == titles.where(F.col("p_partkey") != seed).count() and mine[None].least == 1
        assert set(mine) - {None} <= {"far", "length", *rows.GATES}


def test_lanes_share_a_seeds_places(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((60, 3)), 1)
    x[5] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, axes array<double>")
    got = {}
    for r in rows.structural_lanes(df, df.where("id in (3, 5, 8)").select("id"), 11).orderBy("seed", "place").collect():
        got.setdefault(r.seed, []).append(r.id)
    want = {}
    for s in (3, 8):
        gap = np.abs(x - x[s])
        orders = [sorted((i for i in range(60) if i != s), key=lambda i, y=y: (-round(y[i], 9), i)) for y in (1 - gap.mean(axis=1), 1 - gap @ x[s] / x[s].sum())]
        row = list(dict.fromkeys(orders[0][:6] + orders[1][:5]))
        for at in range(60):
            for lane in orders:
                if at < len(lane) and len(row) < 11 and lane[at] not in row:
                    row.append(lane[at])
        want[s] = row
    assert got == want  # seed 5 is about nothing


def test_a_seed_stands_in_the_row_of_its_first_title(spark):
    make = lambda r: spark.createDataFrame(r, "seed int, id int, place int")
    mine = make([(1, 7, 1), (1, 8, 2), (2, 9, 1), (3, 7, None), (4, 5, 1)])
    firsts = make([(7, 6, 1), (7, 1, 3), (9, 2, 4), (5, 8, 1), (7, 3, None)])
    got = {r.seed: (r.first, r.spot, r.mutual) for r in rows.mutual(mine, firsts, 3).collect()}
    assert got == {1: (7, 3, True), 2: (9, 4, False), 3: (None, None, False), 4: (5, None, False)}


def test_a_tie_does_not_beat_plot(spark):
    make = lambda r: spark.createDataFrame(r, "seed int, id int, place int")
    gains = spark.createDataFrame([(s, i, 2 if i == 1 else 0) for s in (1, 2, 3) for i in (1, 2)], "seed int, id int, gain int")
    row, plot = make([(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 2, 1), (3, 1, 2)]), make([(1, 2, 1), (1, 1, 2), (2, 1, 1), (2, 2, 2), (3, 1, 1), (3, 2, 2)])
    assert {r.case: r.beats for r in rows.beats_plot(row, plot, gains, 10).collect()} == {1: True, 2: False, 3: False}


def test_structure_for_more_seeds_than_are_broadcast(spark, monkeypatch):
    """any number of seeds, and titles with equal axes by their ids."""
    x = [[(i % 5) / 4, (i % 3) / 2] for i in range(90)]
    df = spark.createDataFrame(list(enumerate(x)), "id bigint, axes array<double>")
    monkeypatch.setattr(v, "MAX_SEEDS", 10)
    got = {}
    for r in rows.structural_affinity(df, df.select("id"), 7).orderBy("seed", "r").collect():
        got.setdefault(r.seed, []).append(r.id)
    y = lambda s, i: -round(1 - sum(a * abs(a - b) for a, b in zip(x[s], x[i], strict=True)) / sum(x[s]), 9)
    assert got == {s: sorted((i for i in range(90) if i != s), key=lambda i: (y(s, i), i))[:7] for s in range(90) if sum(x[s])}


def test_block_search_passes_on_k_rows_a_seed(spark):
    """with many seeds the rows go past them in one task, so nothing else is passed on."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, 0, [int(a) for a in r]) for i, r in enumerate(rng.integers(-9, 9, (400, 3)))], "id bigint, kind int, vec array<tinyint>")
    assert v.best_in_blocks(df, df, 3, v._dots_by_kind, row_block=20, seed_block=20).count() == 1200


def test_rows_are_made_once_to_be_compared_with_plot(spark):
    """rows are read several times, so they are stored; before, they were computed for each reading."""
    files = plans.k5_beats_plot(spark, SF).inputFiles()
    assert any("/rows-" in f for f in files) and not any("/scored-" in f for f in files)


def test_tables_of_all_titles_are_never_sent_through_the_driver(spark, tmp_path):
    """Spark took tables for as large as their files and broadcast millions of rows at 6 GB."""

    def stored(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    pairs = stored("pairs", spark.range(40).select((F.col("id") % 4).alias("seed"), "id"))
    titles = spark.range(2000)
    signals = {
        "tone": lambda p: rows.tone_of_pairs(p, stored("labels", titles.selectExpr("id", "'mood' AS kind", "string(id % 3) AS value", "0.9D AS p"))),
        "maker": rows.share_of_makers(stored("makers", titles.selectExpr("id", "id % 7 AS entity"))),
        "facet": rows.agreement_of_facets(stored("facets", titles.selectExpr("int(id % 2) AS media", "id", "'genre' AS kind", "string(id % 5) AS value")), spark.range(2).selectExpr("int(id) AS media", "1000L AS n")),
        "home": rows.of_profiles(stored("profiles", titles.selectExpr("id", "id % 5 AS x")), "home", lambda a, b: (a == b).cast("double")),
    }
    for name, signal in signals.items():
        found = signal(pairs)
        sent = [x for x in found._jdf.queryExecution().sparkPlan().toString().split("\n") if "BroadcastHashJoin" in x and "BuildRight" in x and "LeftSemi" not in x]
        assert not [x for x in sent if "[id#" in x], (name, sent)
        assert {tuple(r) for r in found.select("seed", "id").collect()} <= {tuple(r) for r in pairs.collect()}, name
