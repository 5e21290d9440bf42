"""Every registered query of the library against its SQL, on the smallest data set."""

from collections import Counter
from math import log2

import pytest

from facetspark import plans

from .conftest import SF, same


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF).toPandas()
    assert same(got, duck.execute(plans.oracle_sql()[name]).df())


def test_names_are_registered_once():
    assert set(plans.oracle_sql()) <= set(plans.queries())
    assert plans.FLAGSHIP in plans.queries()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_fan_picks_against_brute_force(spark):
    by_order = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        by_order.setdefault(r.l_orderkey, []).append(r.l_partkey)
    together = Counter((a, b) for parts in by_order.values() for a in parts for b in parts if a != b)
    ranked = {}
    for (a, b), n in together.items():
        ranked.setdefault(a, []).append((-n, b))
    picks = {a: [b for _, b in sorted(x)[:8]] for a, x in ranked.items()}
    q = plans.queries()
    assert sorted((r.src, r["rank"], r.dst) for r in q["j11_fan_picks"](spark, SF).collect()) == sorted((a, i, b) for a, x in picks.items() for i, b in enumerate(x))

    w = {(a, b): 1 / log2(i + 2) for a, x in picks.items() for i, b in enumerate(x)}
    named = Counter(b for _, b in w)
    paths = [(b2, w[10, b] * w[b, b2]) for b in picks[10] for b2 in picks[b]]
    paths += [x for a in picks if (a, 10) in w for x in [(a, 0.25 * w[a, 10])] + [(b, 0.5 * w[a, 10] * w[a, b]) for b in picks[a]]]
    paths = [x for x in paths if x[0] != 10 and x[0] not in picks[10]]
    count, total = Counter(b for b, _ in paths), Counter()
    for b, s in paths:
        total[b] += s
    tail = {b: total[b] / (named[b] + 1) ** 0.25 for b, n in count.items() if n >= 2}
    got = {r.dst: (r.score, r.paths) for r in q["g4_fan_tail"](spark, SF).collect()}
    assert got.keys() == tail.keys() and all(p == count[b] and s == pytest.approx(tail[b], abs=2e-6) for b, (s, p) in got.items())

    want = picks[10] + sorted(tail, key=lambda b: (-round(tail[b], 6), b))
    rows = q["m4_might_also_like"](spark, SF).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.place)] == [b for b in want if b % 10 not in (3, 4)][:200]
