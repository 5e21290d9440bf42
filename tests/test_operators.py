"""Order-dependent and three-valued operators against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from facetspark.functions import scalars
from facetspark.operators import counts, feeds, graphs, ordering, people, recommend, search, selection, similar
from facetspark.operators import vectors as v
from facetspark.operators.policy import Policy

KINDS = {k.name: k for k in (selection.Kind("a", True), selection.Kind("b"))}


def titles(spark, n):
    return spark.createDataFrame([(i % 2, i, 100 - i) for i in range(n)], "media int, id bigint, attention bigint")


@pytest.mark.parametrize("seed", range(3))
def test_counts_leave_out_own_picks(spark, seed):
    rng = random.Random(seed)
    rows = [(i % 2, i, kind, val, 1.0 if rng.random() < 0.7 else 0.6) for i in range(40) for kind in "ab" if rng.random() < 0.8 for val in rng.sample("xyz", 1 if kind == "a" else 2)]
    items = selection.parse("a:x|y,b:x|z,-b:y", KINDS)
    bridge = spark.createDataFrame(rows, "media int, id bigint, kind string, value string, p double")

    def ok(t, item, tier):
        mine = [r for r in rows if r[1] == t and r[2] == item.kind]
        sure = any(r[3] in item.ids and r[4] >= 1 for r in mine)
        if item.exclude:
            return any(r[4] >= 1 for r in mine) and not sure
        return sure or (tier == "any" and any(r[3] in item.ids for r in mine))

    want = {}
    for m, t, kind, val, p in rows:
        use = [i for i in items if not (i.kind == kind and (KINDS[kind].single or (not i.exclude and len(i.ids) > 1)))]
        if all(ok(t, i, "any") for i in use):
            c = want.setdefault((kind, val), [0, 0])
            c[0] += 1
            c[1] += not (all(ok(t, i, "sure") for i in use) and p >= 1)
    got = {(r.kind, r.value): [r.total, r.likely] for r in counts.facet_counts(titles(spark, 40), bridge, items, KINDS).collect()}
    assert got == want


def test_unknown_is_neither_a_value_nor_its_exclusion(spark):
    bridge = spark.createDataFrame([(0, 0, "b", "x", 1.0), (0, 2, "b", "y", 1.0)], "media int, id bigint, kind string, value string, p double")
    find = lambda s: [r.id for r in selection.matched(titles(spark, 5), bridge, selection.parse(s, KINDS)).collect()]
    assert find("b:x") == [0] and find("-b:x") == [2]


def test_grammar():
    assert selection.canonical(selection.parse("b:z|x|x,-a:q", KINDS)) == "-a:q,b:x|z" or selection.canonical(selection.parse("b:z|x|x,-a:q", KINDS)) == selection.canonical(selection.parse("-a:q,b:x|z", KINDS))
    for bad in ("c:x", "a", "a:", "b:" + "|".join(map(str, range(17))), "a:" + "x" * 3000):
        with pytest.raises(ValueError):
            selection.parse(bad, KINDS)
    assert selection.decade("1987") == "1980" and selection.entity_id("q012") == "12"


def test_interleave_keeps_shares(spark):
    rows = [(0, i, 50 - i) for i in range(6)] + [(1, 100 + i, 50 - i) for i in range(3)]
    df = spark.createDataFrame(rows, "media int, id bigint, attention bigint")
    order = [r.media for r in ordering.interleave(df, 9).collect()]
    i = j = 0
    for m in order:  # each step takes media 0 if i * 3 <= j * 6
        want = 0 if j >= 3 or (i < 6 and i * 3 <= j * 6) else 1
        assert m == want
        i, j = i + (m == 0), j + (m == 1)


@pytest.mark.parametrize("seed", range(3))
def test_cap_and_merge_and_rerank(spark, seed):
    rng = random.Random(seed)
    rows = [(0, p, rng.choice(["", "u", "v", "w"])) for p in range(40)]
    got = [r.pos for r in ordering.cap_groups(spark.createDataFrame(rows, "list int, pos int, sub string"), 2, 8).orderBy("place").collect()]
    head, held, tail, seen = [], [], [], {}
    for _, p, s in rows:
        if len(head) >= 8:
            tail.append(p)
        elif not s or seen.get(s, 0) < 2:
            head.append(p)
        else:
            held.append(p)
        seen[s] = seen.get(s, 0) + 1
    assert got == head + held + tail
    lists = {o: [rng.randint(0, 20) for _ in range(6)] for o in (0, 1)}
    df = spark.createDataFrame([(0, o, p, float(s)) for o, x in lists.items() for p, s in enumerate(x)], "list int, own int, pos int, score double")
    got = [(r.own, r.pos) for r in ordering.merge_heads(df).orderBy("place").collect()]
    at, want = {0: 0, 1: 0}, []
    while len(want) < 12:
        o = max((o for o in (0, 1) if at[o] < 6), key=lambda o: (lists[o][at[o]], o))
        want.append((o, at[o]))
        at[o] += 1
    assert got == want
    scores = [rng.choice([None, rng.randint(0, 9)]) for _ in range(20)]
    df = spark.createDataFrame([(0, p, s) for p, s in enumerate(scores)], "list int, pos bigint, score int")
    got = [r.pos for r in ordering.rerank_fixed(df).orderBy("place").collect()]
    fixed = [p for p, s in enumerate(scores) if s is None and p < 10]
    best = sorted((p for p, s in enumerate(scores) if s is not None), key=lambda p: (-scores[p], p))
    n = len(fixed) + len(best)
    slots, it = {}, iter(best)
    for p in range(max(n, 10)):
        if p in fixed:
            slots[p] = p
        elif (x := next(it, None)) is not None:
            slots[p] = x
    rest = [p for p, s in enumerate(scores) if s is None and p >= 10]
    assert got == [slots[k] for k in sorted(slots)] + rest


def test_nearest_rank(spark):
    df = spark.createDataFrame([("g", i * i) for i in range(7)], "g string, x int")
    for pct in (0, 10, 50, 90, 100):
        assert ordering.nearest_rank(df, "g", "x", pct).first().p == [i * i for i in range(7)][min(7 * pct // 100, 6)]


def test_pages():
    for skip, limit in ((5, 10), (0, 0), (-10, 10), (0, 101)):
        with pytest.raises(ValueError):
            ordering.page(None, [], skip, limit)


def test_coarse_dates_are_in_a_range_only_as_a_whole(spark):
    rows = [(dt.date(2000, 1, 1), 1), (dt.date(2000, 1, 1), 366), (dt.date(1999, 1, 1), 10)]
    df = spark.createDataFrame(rows, "f date, n int")
    d = lambda s: F.lit(s).cast("date")
    got = [r[0] for r in df.orderBy(F.desc("f"), "n").select(people.in_range(F.col("f"), F.col("n"), d("2000-01-01"), d("2000-06-30"))).collect()]
    assert got == [True, None, False]


def test_as_of(spark):
    rng = random.Random(1)
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    left = [(rng.randint(0, 2), t(rng.randint(0, 60)), i) for i in range(40)]
    right = list({(k, m): (k, t(m), float(rng.randint(0, 9))) for k in range(3) for m in rng.sample(range(60), 8)}.values())
    got = {r.id: r.value for r in feeds.as_of(spark.createDataFrame(left, "k int, at timestamp, id bigint"), spark.createDataFrame(right, "k int, at timestamp, value double"), "k", "at").collect()}
    for k, at, i in left:
        past = [(x[1], x[2]) for x in right if x[0] == k and x[1] <= at]
        assert got[i] == (max(past)[1] if past else None)


def test_knn_equals_a_full_sort(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randint(-9, 9) for _ in range(8)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, vec array<tinyint>, media int").repartition(3)
    got = [(r.seed, r.media, r.id) for r in v.knn(df, df.where("id in (4, 5)"), 5, "media").orderBy("seed", "media", "rank").collect()]
    want = []
    for s in (4, 5):
        for m in (0, 1):
            near = sorted((r for r in rows if r[2] == m), key=lambda r: (-sum(x * y for x, y in zip(r[1], rows[s][1])), r[0]))[:5]
            want += [(s, m, r[0]) for r in near]
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_slate_follows_its_rules(spark, seed):
    rng = random.Random(seed)
    rows = [(0, i, int(rng.random() < 0.2), f"g{rng.randrange(6)}", float(rng.randint(1, 40)), rng.choice([0.1, 0.3, 0.6, 0.9]), rng.choice([0.1, 0.5, 0.9]), rng.random() < 0.5) for i in range(70)]
    df = spark.createDataFrame(rows, "list int, id bigint, media int, grp string, score double, fit double, quality double, is_stale boolean")
    got = [r.id for r in recommend.slate(df, 45).orderBy("place").collect()]
    left, out = sorted(rows, key=lambda r: (-r[4], r[1])), []
    while len(out) < 45:  # place by place, every wish spelled out
        ten, lead = out[len(out) // 10 * 10 :], len(out) < 10
        able = [r for r in left if not lead or r[5] >= 0.25]
        if not able:
            out.append(left.pop(0))
            continue
        missing = {m: 3 - len([x for x in ten if x[2] == m]) for m in (0, 1) if [r for r in able if r[2] == m]}
        owed = sum(n for n in missing.values() if n > 0) >= 10 - len(ten)
        best, most = None, None
        for r in able:
            if r is not able[0] and not (r[5] >= 0.5 and 3 * r[4] >= able[0][4]):
                continue
            wishes = [
                r[6] >= 0.2 or not [x for x in ten if x[6] < 0.2],
                not r[7] or len([x for x in ten if x[7]]) < 3,
                not owed or missing.get(r[2], 0) > 0,
                not [x for x in ten if x[3] == r[3]],
            ]
            if most is None or wishes > most:
                best, most = r, wishes
        out.append(best)
        left.remove(best)
    assert got == [r[1] for r in out]


def test_search_text():
    known = search.Vocabulary(labels={"red": "shade", "small": "shade"}, plot={"long": "size"}, countries={"french": "FR"})
    p = search.parse("red 80s movies not small and", known)
    assert (p.labels, p.avoid, p.decade, p.media, p.rest, p.text) == (("red",), ("small",), 1980, 0, "red", "red 80s movies")
    assert (p.share, p.unread) == (1 / 3, 0)
    p = search.parse("recent french long thing", known)
    assert (p.year_min, p.countries, p.plot, p.rest, p.unread) == (known.recent, ("FR",), ("long",), "long thing", 0.25)
    assert search.parse("classics", known).year_max == known.classic
    assert search.parse("not", known).avoid == () and search.parse("to be or not", known).avoid == ()


def test_short_title_queries(spark):
    names = spark.createDataFrame([(1, "Red Ring", 5), (2, "Reed", 9), (3, "Old red ring", 1)], "id bigint, name string, pop bigint")
    assert [r.id for r in search.title_matches(names, "re", 5).collect()] == [2, 1]
    assert search.title_matches(names, "r", 5).count() == 0
    assert [r.id for r in search.title_matches(names, "red ring", 5).collect()] == [1, 3]


def test_scalars(spark):
    df = spark.createDataFrame([("Ça & Là", "1999-02", "Young Dr. Ann (voice) #2"), ("Plain", "nope", "12"), (None, None, None)], "a string, b string, c string")
    got = df.select(scalars.fold(F.col("a")), scalars.partial_date(F.col("b")), scalars.character_name(F.col("c"))).collect()
    assert got[0][0] == "ca  and  la" and got[0][1] == (dt.date(1999, 2, 1), 28) and got[0][2] == "ann"
    assert got[1][0] == "plain" and got[1][1] is None and got[1][2] is None and got[2][0] is None
    mask = spark.createDataFrame([(["b", "c"],)], "n array<string>").select(scalars.source_mask(F.col("n"), ["a", "b", "c"]).alias("m"))
    assert mask.first().m == 6 and mask.select(scalars.mask_names(F.col("m"), ["a", "b", "c"])).first()[0] == ["b", "c"]


def test_tone_and_links(spark):
    labels = spark.createDataFrame([(1, "m", "x", 0.8), (1, "m", "y", 0.2), (2, "m", "x", 0.9), (3, "m", "z", 0.9)], "id bigint, kind string, value string, p double")
    assert {r.id: r.tone for r in similar.tone(labels, 1).collect()} == {2: 0.8, 3: 0.0}
    names = spark.createDataFrame([(1, "n"), (2, "n"), (3, "n"), (4, "o")], "id bigint, name string")
    assert {(r.a, r.b, r.weight) for r in graphs.name_links(names).collect()} == {(1, 2, 10.0), (1, 3, 10.0), (2, 3, 10.0)}
    assert math.isclose(graphs.name_links(names, 2, 2).count(), 0)


def test_policy():
    p = Policy.parse("kids,age=12,unknown=block")
    assert str(p) == "age=12,unknown=block,kids" and Policy.parse(str(p)) == p
    with pytest.raises(ValueError):
        Policy.parse("age")


def test_ranks_by_ranges_are_those_of_a_sort(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([5, 5, 5, 5, rng.randint(0, 30)])) for g in (0, 1, None) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, id bigint, x bigint").repartition(5)
    for up in (False, True):
        got = {(r.g, r.id): (r["rank"], r.of) for r in ordering.distributed_rank(df, "g", "x", "id", 8, up).collect()}
        for g in (0, 1, None):
            order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] if up else -r[2], r[1]))
            assert [got[r[0], r[1]] for r in order] == [(i + 1, 300) for i in range(300)]


def test_led_by_moves_only_what_must(spark):
    ranked = spark.createDataFrame([(g, i * 7 % 12, i + 1) for g in (1, 2) for i in range(12)], "list int, item int, rank int")
    leaders = ranked.where("list = 1 and item in (3, 8, 5)").selectExpr("list", "item", "item as lead")
    got = {}
    for r in feeds.led_by(ranked, leaders).collect():
        got.setdefault(r.list, []).append((r.place, r.item))
    plain = [i * 7 % 12 for i in range(12)]
    assert [i for _, i in sorted(got[1])] == [3, 5, 8] + [i for i in plain if i not in (3, 5, 8)]
    assert [i for _, i in sorted(got[2])] == plain and [p for p, _ in sorted(got[1])] == list(range(1, 13))


def test_too_many_seeds_are_an_error_where_all_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(v, "MAX_SEEDS", 2)
    e = spark.createDataFrame([(i, 0, [i, 1]) for i in range(3)], "id bigint, media int, vec array<tinyint>")
    assert v.knn(e, e, 1).count() == 3  # searched for in blocks instead
    for f in (lambda: v.scan_stats(e, e, "media"), lambda: v.weighted_nearest(e, e.selectExpr("id", "vec", "1.0 as weight"))):
        with pytest.raises(ValueError, match="over 2 seeds"):
            f()


def test_character_names(spark):
    cases = {"Young Dr. Jekyll (voice) #2": ["jekyll"], "Tom - Older / Tom": ["tom", "older"], "Spider-Man": ["spider man"], "Guard 12": ["guard"], "R2D2": ["r2d2"], "47": [], "[note] The Voice of Mr. Old Smith's Voice": ["smith"], "A (unclosed": ["a unclosed"]}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: r.n for r in df.select("c", scalars.character_names(F.col("c")).alias("n")).collect()}
    assert got == cases
    one = spark.createDataFrame([("Élodie (voix)",), ("Señor 3",)], "c string").select(scalars.character_name(F.col("c")).alias("n"))
    assert [r.n for r in one.collect()] == ["elodie", "senor"]
