"""Queries read by phrases; pages of lists; suggestions of seeds; limits of slates; snapshots of polls."""

from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from facetspark.operators import browse, evaluation, rows, selection
from facetspark.operators.search import Vocabulary, answer, parse
from facetspark.streaming import snapshots as sn

WORDS = Vocabulary(
    labels={"red": "shade", "slow burn": "mood", "burn": "mood"},
    plot={"long": "size"},
    countries={"french": "FR", "korean": "K", "south korean": "KR"},
    sets={"book": ("source", "BOOK"), "comic book": ("source", "COMIC")},
    places={"york": "Y", "new york": "NY", "moon": "MOON"},
)


@pytest.mark.parametrize(
    ("text", "countries", "sets", "rest", "unread"),
    [
        ("south korean heist", ("KR",), (), "heist", 0.3333),
        ("korean south heist", ("K",), (), "south heist", 0.6667),
        ("comic book heist", (), (("source", "COMIC"),), "heist", 0.3333),
        ("book heist", (), (("source", "BOOK"),), "heist", 0.5),
        ("heist set in new york", (), (("place", "NY"),), "heist", 0.2),
        ("set in the moon", (), (("place", "MOON"),), "", 0.0),
        ("set in nowhere", (), (), "set nowhere", 0.6667),
        ("slow burn heist", (), (), "slow burn heist", 0.3333),
        ("jane doe heist", (), (), "heist", 0.3333),
        ("jane heist", (), (), "jane heist", 1.0),
    ],
)
def test_the_longest_phrase_counts(text, countries, sets, rest, unread):
    p = parse(text, WORDS, frozenset({"jane doe", "doe heist", "jane"}))
    assert (p.countries, p.sets, p.rest, round(p.unread, 4)) == (countries, sets, rest, unread)


def test_a_lifting_phrase_leaves_its_words_and_the_shorter_one_in_it_is_read_too():
    p = parse("slow burn", WORDS)
    assert set(p.labels) == {"slow burn", "burn"} and p.rest == "slow burn" and p.unread == 0


def test_what_decides_is_contested_by_a_popular_title_only():
    assert not parse("french heist", WORDS).contested and not parse("red heist", WORDS, popular=True).contested
    p = parse("french heist", WORDS, popular=True)
    assert p.contested and p.countries == ("FR",) and p.rest == "french heist"


def test_a_negation_in_a_titles_name_is_a_word():
    assert parse("heist without red", WORDS).avoid == ("red",)
    assert parse("heist without red", WORDS, titled=True).avoid == ()


@pytest.fixture(scope="module")
def catalogue(spark):
    titles = spark.createDataFrame([(0, 1, "Heist", 40, 2000), (0, 2, "Frenchy Job", 30, 2001), (0, 3, "French Job", 4000, 2002), (1, 4, "Quiet", 10, None), (0, 5, "Job", 9, 1990)], "media int, id int, title string, votes int, year int")
    facts = [(1, "country", "FR"), (2, "country", "KR"), (3, "country", "KR"), (5, "source", "BOOK"), (2, "source", "COMIC"), (1, "shade", "red")]
    return titles, spark.createDataFrame([(i, k, x, 1.0) for i, k, x in facts], "id int, kind string, value string, p double")


def test_a_contested_facet_discounts_nothing(catalogue):
    titles, bridge = catalogue
    ask = lambda t: {r.id: r.score for r in answer(titles, bridge, "french job", WORDS, names=None).collect()} if t else {
        r.id: r.score for r in answer(titles.where("id <> 3"), bridge, "french job", WORDS, names=None).collect()
    }
    contested, plain = ask(True), ask(False)
    assert max(contested, key=contested.get) == 3
    assert contested[2] > 2 * plain[2]  # the Korean one is no longer discounted for not being French


def test_people_and_sets_to_avoid(spark, catalogue):
    titles, bridge = catalogue
    people = spark.createDataFrame([(9, "Jane Doe")], "entity int, name string")
    credits = spark.createDataFrame([(5, 9, "cast")], "id int, entity int, role string")
    ids = lambda text: {r.id for r in answer(titles, bridge, text, WORDS, people=people, credits=credits).collect()}
    assert 5 in ids("job") and 5 not in ids("job without jane doe") and 5 not in ids("job without book")
    assert 5 not in ids("job without 90s") and 5 in ids("job without 80s")
    assert 2 in ids("job without book") and 2 not in ids("job without comic book")


def test_a_page_of_a_list_is_in_its_order(spark):
    titles = spark.createDataFrame([(0, i) for i in range(8)], "media int, id int")
    bridge = spark.createDataFrame([(0, 0, "shade", "red", 0.6), (0, 1, "shade", "red", 1.0), (0, 2, "shade", "blue", 1.0), (0, 3, "shade", "red", 0.85), (0, 4, "shade", "green", 1.0), (0, 5, "shade", "red", 1.0), (0, 7, "shade", "blue", 0.9)], "media int, id int, kind string, value string, p double")
    ranked = spark.createDataFrame([(i, r) for r, i in enumerate([5, 0, 3, 2, 4, 1, 6], 1)], "id int, rank int")
    items = selection.parse("shade:red|blue", {"shade": selection.Kind("shade")})
    page = lambda skip: [(r.id, r.rank, r.confident, r.place) for r in browse.list_page(titles, bridge, items, ranked, skip, 4).orderBy("place").collect()]
    assert page(0) == [(5, 1, True, 1), (2, 4, True, 2), (1, 6, True, 3), (3, 3, False, 4)] and page(4) == [(0, 2, False, 5)]
    assert [r.id for r in browse.list_page(titles, bridge, [], ranked, 0, 9).orderBy("place").collect()] == [5, 0, 3, 2, 4, 1, 6]


def test_suggestions_of_a_seed_without_fans(spark):
    make = lambda r, s: spark.createDataFrame(r, s)
    seeds = make([(1,), (2,), (3,)], "id int")
    fans = make([(1, 7, 1), (1, 8, 2)], "seed int, id int, place int")
    affine = make([(1, 9, 1), (2, 5, 1), (2, 2, 2), (2, 6, 3)], "seed int, id int, r int")
    similar = make([(2, 6, 1), (2, 4, 2), (2, 3, None), (1, 4, 1)], "seed int, id int, place int")
    worth = make([(2, 6), (2, 5), (2, 4), (2, 2)], "seed int, id int")
    got = sorted(map(tuple, rows.suggestions(seeds, fans, affine, similar, worth).collect()))
    assert got == [(1, 7, 1, 0), (1, 8, 2, 0), (2, 4, 3, 1), (2, 5, 1, 1), (2, 6, 2, 1)]


def test_shared_slides_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(4)
    lists = {n: rng.sample(range(25), rng.randint(2, 10)) for n in range(60)} | {60: list(range(10)), 61: list(range(10)), 62: [99, 98]}
    df = spark.createDataFrame([(n, x, k) for n, xs in lists.items() for k, x in enumerate(xs, 1)], "list int, item int, place int")
    want = {}
    for a, b in combinations(lists, 2):
        if (n := len(set(lists[a]) & set(lists[b]))) > 3:
            want[a], want[b] = max(want.get(a, 0), n), max(want.get(b, 0), n)
    assert {r.list: r.shared for r in evaluation.shared_slides(df).collect()} == want and want[60] == 10 and 62 not in want


def test_limits_of_a_slate(spark):
    good = [(1, k, k, k % 2, k, 0.5, 0.0, 0.5, 0.5, 0.9) for k in range(1, 12)]
    bad = [(2, k, k, 0, 7, 0.0, 0.0, 0.1, 0.0, 0.1 * k) for k in range(1, 11)]
    slides = spark.createDataFrame(good + bad, "list int, place int, id int, media int, grp int, fresh double, arrived double, quality double, buzz double, fit double")
    got = {r.list: r for r in evaluation.slate_limits(slides).collect()}
    assert got[1].passes and (got[1].films, got[1].series, got[1].stacked) == (5, 5, 1)
    assert not got[2].passes and (got[2].catalogue, got[2].poor, got[2].quiet, got[2].stacked, got[2].lowest_fit) == (10, 10, 10, 10, 0.1)
    shared = spark.createDataFrame([(1, 5)], "list int, shared bigint")
    assert not {r.list: r for r in evaluation.slate_limits(slides, shared).collect()}[1].passes


ROW = "country string, market string, item int, at timestamp, tie int"
NOW = datetime(2020, 3, 1)


def ago(days):
    return NOW - timedelta(days=days)


def test_additions_are_kept_as_first_held(spark):
    held = spark.createDataFrame([("de", "x@de", 1, ago(20), 1), ("de", "x@de", 2, ago(31), 2), ("de", "x@de", 3, None, 3)], ROW)
    read = spark.createDataFrame([("de", "x@de", 1, ago(1), 4), ("de", "x@de", 4, ago(2), 6), ("de", "x@de", 4, ago(3), 7), ("de", "y@de", 1, ago(30), 8), ("de", "x@de", 5, None, 9), ("de", "x@de", 5, ago(4), 10)], ROW)
    got = {(r.market, r.item): r["at"] for r in sn.keep_added(held, read, NOW).collect()}
    assert got == {("x@de", 1): ago(20), ("x@de", 3): None, ("x@de", 4): ago(3), ("x@de", 5): ago(4)}
    assert [(r.item, r.place) for r in sn.shown(sn.keep_added(held, read, NOW), NOW + timedelta(days=11)).orderBy("place").collect()] == [(4, 1), (5, 2), (3, 3)]


def test_a_country_read_is_replaced_whole(spark):
    held = spark.createDataFrame([("de", "x@de", 1, NOW, 1), ("fr", "x@fr", 2, NOW, 2), ("it", "x@it", 3, NOW, 3)], ROW)
    read = spark.createDataFrame([("de", "x@de", 7, NOW, 1), ("de", "x@de", 7, ago(1), 2)], ROW)
    countries = spark.createDataFrame([("de",), ("it",)], "country string")
    got = sorted((r.country, r.item, r["at"]) for r in sn.replace_read(held, read, countries).collect())
    assert got == [("de", 7, ago(1)), ("fr", 2, NOW)]


def test_a_version_holds_the_countries_touched_and_readers_see_the_latest(spark, tmp_path):
    df = lambda r: spark.createDataFrame(r, ROW)
    s = sn.Snapshot(spark, f"file://{tmp_path}/s", df([]).schema)
    names = lambda x: spark.createDataFrame([(c,) for c in x], "country string")
    assert s.read().collect() == [] and s.versions() == []
    s.write(df([("de", "x", 1, NOW, 1), ("fr", "x", 2, NOW, 1)]), names(["de", "fr"]), 0)
    s.write(df([("de", "x", 3, NOW, 1)]), names(["de"]), 1)
    s.write(df([]), names(["fr"]), 2)
    items = lambda before=None: sorted((r.country, r.item) for r in s.read(before).collect())
    assert items() == [("de", 3)] and items(2) == [("de", 3), ("fr", 2)] and items(1) == [("de", 1), ("fr", 2)]
    assert sorted(p.name for p in (tmp_path / "s/version=1").iterdir() if p.is_dir()) == ["country=de"]
    s.write(df([("fr", "x", 9, NOW, 1)]), names(["fr"]), 2)  # a batch tried again
    assert items() == [("de", 3), ("fr", 9)]


def test_a_sweep_reads_what_is_due_and_writes_what_it_touches(spark, tmp_path):
    parts = 16
    make = lambda r: spark.createDataFrame(r, "id int, x int, fetched timestamp").withColumn("part", sn.part_of(F.col("id"), parts))
    held = make([(i, i, ago(40 if i == 7 else 5)) for i in range(40)])
    cache = sn.Snapshot(spark, f"file://{tmp_path}/c", held.schema, "part", "id")
    cache.write(held, held.select("part").distinct(), 0)
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id int")
    asked = []

    def read(due):
        asked.extend(sorted(r.id for r in due.collect()))
        return due.select("id", (F.col("id") + 1000).alias("x"))

    todo = sn.sweep(cache, ids([*range(1, 40), 50]), ids([3, 99]), read, NOW, 30, 1, parts)
    assert {r.id: r.reason for r in todo.collect()} == {3: "changed", 7: "expired", 50: "new"} and asked == [3, 7, 50]
    got = {r.id: (r.x, r.fetched) for r in cache.read().collect()}
    assert got == {i: (i + 1000, NOW) if i in asked else (i, ago(5)) for i in [*range(1, 40), 50]}
    touched = {r[0] for r in ids([0, 3, 7, 50]).select(sn.part_of(F.col("id"), parts)).collect()}
    assert {int(p.name.removeprefix("part=")) for p in (tmp_path / "c/version=1").iterdir() if p.is_dir()} == touched
