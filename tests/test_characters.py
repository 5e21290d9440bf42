"""Links between titles through characters: each tier, and what is not enough for one."""

import pytest
from pyspark.sql import functions as F

from facetspark.functions.scalars import character_names
from facetspark.operators import characters as ch


def people(spark, roles):
    return ch.principals(spark.createDataFrame(roles, "id int, pos int, person int, credit string"))


def linked(spark, roles):
    return {(r.a, r.b): (r.tier, r.weight) for r in ch.character_links(people(spark, roles)).collect()}


CASES = {
    "one actor in one telling name": ([(1, 1, 100, "Jesse Pinkman"), (2, 4, 100, "JESSE PINKMAN (voice)")], 1),
    "two names, one of them whole, recast": ([(1, 1, 1, "Walter White"), (1, 2, 2, "Saul"), (2, 1, 3, "Walter White"), (2, 2, 4, "Saul")], 2),
    "one name, recast": ([(1, 1, 1, "Walter White"), (2, 1, 3, "Walter White")], None),
    "two single names billed in the top three": ([(1, 1, 1, "Walter"), (1, 2, 2, "Saul"), (2, 1, 3, "Walter"), (2, 2, 4, "Saul")], 3),
    "two single names billed lower": ([(1, 1, 1, "Walter"), (1, 2, 2, "Saul"), (2, 1, 5, "Anna"), (2, 2, 6, "Berta"), (2, 3, 3, "Walter"), (2, 4, 4, "Saul")], None),
    "three single names": ([(1, 1, 1, "Walter"), (1, 2, 2, "Saul"), (1, 3, 9, "Marie"), (2, 1, 5, "Anna"), (2, 2, 6, "Berta"), (2, 3, 3, "Walter"), (2, 4, 4, "Saul"), (2, 5, 8, "Marie")], 3),
    "a generic name alone": ([(1, 1, 100, "Max"), (2, 1, 100, "Max")], None),
    "a generic name and another person in both": ([(1, 1, 100, "Max"), (1, 5, 300, "Bartender"), (2, 1, 100, "Max"), (2, 6, 300, "Pilot")], 4),
    "a generic name billed fourth": ([(1, 1, 100, "Max"), (1, 2, 300, "Bartender"), (2, 1, 301, "Someone"), (2, 2, 300, "Pilot"), (2, 3, 302, "Another"), (2, 4, 100, "Max")], None),
    "a longer form of one word by one actor": ([(1, 1, 100, "Jesse"), (2, 1, 100, "Jesse Pinkman")], None),
    "longer forms of one word by two actors": ([(1, 1, 100, "Jesse"), (1, 2, 101, "Skyler"), (2, 1, 100, "Jesse Pinkman"), (2, 2, 101, "Skyler White")], 5),
    "a longer form of two words": ([(1, 1, 100, "Jean-Luc Picard"), (2, 1, 100, "Jean-Luc Picard of the Enterprise")], 5),
    "another rank": ([(1, 1, 100, "Captain Jean-Luc Picard"), (2, 1, 100, "Jean-Luc Picard")], 5),
    "one surname under two ranks": ([(1, 1, 100, "Detective Jones"), (2, 1, 100, "Sergeant Jones")], None),
    "another rank, recast": ([(1, 1, 100, "Captain Jean-Luc Picard"), (2, 1, 200, "Jean-Luc Picard")], None),
    "played as oneself": ([(1, 1, 100, "Himself"), (1, 2, 101, "Self"), (2, 1, 100, "Himself"), (2, 2, 101, "Self")], None),
    "accents of either form": ([(1, 1, 1, "Renée / Émile"), (2, 1, 1, "Renée - Émile")], 1),
}


@pytest.mark.parametrize("case", CASES)
def test_tiers(spark, case):
    roles, tier = CASES[case]
    got = linked(spark, roles)
    assert {k: t for k, (t, _) in got.items()} == ({} if tier is None else {(1, 2): tier})


def test_common_names_weigh_less_and_very_common_ones_do_not_link(spark):
    holmes = [(t, k, 1000 * k + t, n) for t in range(1, 41) for k, n in ((1, "Sherlock Holmes"), (2, "John Watson"))]
    got = linked(spark, holmes)
    assert len(got) == 40 * 39 // 2 and set(got.values()) == {(2, 0.75)}
    assert linked(spark, [(t, k, 1000 * k + t, n) for t in range(1, 82) for k, n in ((1, "Sherlock Holmes"), (2, "John Watson"))]) == {}


def test_a_single_name_on_twenty_titles_is_generic(spark):
    rows = people(spark, [(t, 1, t, "Doctor") for t in range(20)] + [(t, 2, 100 + t, "The Doctor Who") for t in range(3)] + [(1, 3, 7, "Bo"), (2, 3, 8, "Of The")])
    assert {r.name: (r.df, r.kind, r.core) for r in ch.names_played(rows).collect()} == {"doctor": (20, "generic", []), "the doctor who": (3, "multi", ["who"]), "bo": (1, "generic", ["bo"]), "of the": (1, "generic", [])}


def test_an_actor_of_very_many_titles_links_no_names_that_are_only_alike(spark):
    roles = [(t, 1, 100, "Jean-Luc Picard" if t % 2 else "Captain Jean-Luc Picard") for t in range(61)]
    tiers = {t for t, _ in linked(spark, roles).values()}
    assert tiers == {1} and {t for t, _ in linked(spark, roles[:60]).values()} == {1, 5}


def test_strength(spark):
    links = spark.createDataFrame([(1, 2, 1, 0.75), (1, 3, 2, 0.75), (1, 4, 2, 1.0), (2, 3, 5, 1.0), (3, 4, 3, 1.0)], "a int, b int, tier int, weight double")
    members = spark.createDataFrame([("s", 1), ("s", 4), ("t", 1), ("t", 4), ("t", 9)], "series string, id int")
    got = {(r.a, r.b): r.strength for r in ch.link_strength(links, members).collect()}
    assert got == {(1, 2): 0.75, (1, 3): 0.375, (1, 4): 1.0, (2, 3): 1.0, (3, 4): 0.5}
    assert {(r.a, r.b): r.strength for r in ch.link_strength(links).collect()}[1, 4] == 0.5


def test_principals_and_nulls(spark):
    got = people(spark, [(1, 2, 5, "Anna"), (1, 2, 5, "Berta / Anna"), (1, 1, 6, None), (1, 3, 7, "123"), (1, 9, 8, "Self"), (None, 1, 1, "X Y")]).collect()
    assert sorted((r.id or 0, r["rank"], r.person, r.oneself, sorted(r.names)) for r in got) == [(0, 1, 1, False, ["x y"]), (1, 1, 5, False, ["anna", "berta"]), (1, 2, 8, True, ["self"])]
    assert ch.character_links(people(spark, [(1, 1, 1, None)])).collect() == []


def test_marks_of_both_forms_are_folded_before_a_credit_is_split(spark):
    df = spark.createDataFrame([("Renée / Émile",), ("Ångström",)], "c string")
    assert [r.n for r in df.select(character_names(F.col("c")).alias("n")).collect()] == [["renee", "emile"], ["angstrom"]]


def test_links_are_made_once_for_their_strength(spark):
    """links are read twice, so they are stored; before, all tiers were computed for each reading."""
    from facetspark.plans import characters as plans

    from .conftest import SF

    files = plans.g6(spark, SF).inputFiles()
    assert any("/links-" in f for f in files) and not any("principals" in f for f in files)


def test_queries_leave_no_actor_out(spark, monkeypatch):
    """actors of over 60 titles were dropped from the names that are contained in one another."""
    from facetspark.plans import characters as plans

    roles = [(t, 1, 100, "Jean-Luc Picard" if t % 2 else "Captain Jean-Luc Picard") for t in range(61)]
    monkeypatch.setattr(plans, "cast", lambda spark, d: spark.createDataFrame(roles, "id int, pos int, person int, credit string"))
    across = {(a, b) for a in range(61) for b in range(a + 1, 61) if (a + b) % 2}
    assert {(r.a, r.b) for r in plans.g5_contained(spark, "").collect()} == across
    assert {(r.a, r.b) for r in plans.g5(spark, "").collect() if r.tier == 5} == across


def test_pairs_are_not_dealt(spark):
    """every pair was written for two shuffles; evidence is dealt by the smaller id, its partners packed."""
    plan = ch.character_links(people(spark, [(1, 1, 1, "A B"), (2, 1, 1, "A B")]))._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "hashpartitioning(a#" in x and ", b#" in x.split("hashpartitioning(")[1]]
