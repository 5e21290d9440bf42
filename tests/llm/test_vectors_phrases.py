"""Hard negatives, near-duplicate vectors and collocations against brute force, with nulls, ties,
repeated rows, empty and very long input, empty tables and clashing column names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetspark.llm import codes, collocations, negatives
from facetspark.llm.tokens import Words

VECTORS = "vec_id bigint, label int, vec array<double>"


def some_vectors(seed=1, n=160, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 3)), (rng.normal(size=dim) / 3).tolist()) for i in range(n)]
    rows += [(n + i, i % 3, rows[5][2]) for i in range(30)]  # ties
    rows += [(n + 40, None, rows[0][2]), (n + 41, 1, None), (n + 42, 1, [None] * dim), (n + 43, 1, [float("nan")] * dim), (n + 44, 1, [float("inf")] + [0.0] * (dim - 1)), (None, 1, rows[1][2])]
    rows += [(n + 45, 1, [0.5] * 3), (n + 46, 0, [0.5] * 3), (n + 47, 1, [0.25] * 3), (n + 48, 0, [0.2] * 3), (n + 49, 2, []), (n + 50, 1, [0.0] * dim)]
    return rows


def clash(df):
    return df.withColumns({c: F.lit(1) for c in ("dim", "v", "block", "place", "rank", "cls", "cell", "h1", "copies", "rep", "n", "f", "words", "rid")})


# ---- hard negatives -------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"block_bytes": 700, "rows": 16, "slice_anchors": 3}])
def test_negatives_are_those_of_all_products(spark, options):
    rows = some_vectors()
    df = clash(spark.createDataFrame(rows, VECTORS)).repartition(7)
    chosen = {i for i, *_ in rows if i is not None and (i % 10 == 0 or i > 195)}
    got = negatives.mine(df, df.where(F.col("vec_id").isin(list(chosen))), **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == negatives.brute(rows, chosen) != []


def test_negatives_of_repeated_and_no_rows(spark):
    rows = some_vectors(n=40)
    df = spark.createDataFrame(rows + rows[:1], VECTORS)
    once = sorted(map(tuple, negatives.mine(df, df.where("vec_id = 0")).collect()))
    assert once == sorted(map(tuple, negatives.mine(df, spark.createDataFrame(rows[:1], VECTORS)).collect()))
    assert negatives.mine(df.limit(0), df.limit(0)).collect() == [] == negatives.mine(df, df.limit(0)).collect()


def test_products_are_exact_or_refused():
    a = np.array([[2.0**26, 1.0]])
    c = np.array([[2.0**26 + 1, 1.0]])
    assert negatives.products(a, a)[0, 0] == 2**52 + 1 and negatives.products(c, c)[0, 0] == (2**26 + 1) ** 2 + 1  # beyond 2^53 in part
    big = np.array([[2.0**40, 3.0]])
    with pytest.raises(OverflowError):
        negatives.products(big, big)


def test_best_lists_merge_like_one(spark):
    rng = np.random.default_rng(0)
    s, ids = rng.integers(0, 6, (4, 300)), np.arange(300)
    one, parts = negatives.Best(4, 7), negatives.Best(4, 7)
    one.add(np.arange(4), s, ids)
    for k in reversed(range(0, 300, 50)):
        parts.add(np.arange(4), s[:, k : k + 50], ids[k : k + 50])
    want = [sorted(((-x, i) for x, i in zip(r, ids, strict=True)))[:7] for r in s.tolist()]
    for b in (one, parts):
        assert [[(-x, i) for x, i in zip(*r, strict=True)] for r in zip(b.score.tolist(), b.id.tolist(), strict=True)] == want


def test_op11_matches_sql(spark, duck):
    from ..conftest import SF, same

    assert same(negatives.op11_hard_negatives(spark, SF).toPandas(), duck.execute(negatives.SQL["op11_hard_negatives"]).df())


# ---- near-duplicate vectors -----------------------------------------------------------------


def near_copies(seed=0, groups=40, dim=24):
    """Groups of vectors around 0.9 of each other, among others."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    out = []
    for g in range(groups):
        base = unit(rng.normal(size=dim))
        for _ in range(int(rng.integers(1, 6))):
            out.append(unit(base + unit(rng.normal(size=dim)) * rng.uniform(0, 0.6)) * rng.uniform(0.1, 9))
    return [(i, v.tolist()) for i, v in enumerate(out)]


def odd_vectors(rows):
    dim = len(rows[0][1])
    return [*rows, (900, rows[3][1]), (901, rows[3][1]), (3, rows[3][1]), (902, None), (903, []), (904, [0.0] * dim), (905, [None, *rows[0][1][1:]]), (906, [float("nan"), *rows[0][1][1:]]), (907, [float("inf"), *rows[0][1][1:]]), (908, rows[0][1][:5]), (909, rows[0][1][:5]), (None, rows[4][1]), (None, None), (910, [1e300] * dim), (911, [1e-300] * dim)]


@pytest.mark.parametrize("options", [{"recall": 0.9999}, {"recall": 0.9999, "cell_rows": 4, "block": 8}])
def test_near_vectors_equal_brute_force(spark, options):
    rows = odd_vectors(near_copies())
    df = clash(spark.createDataFrame(rows, "vec_id bigint, vec array<double>")).repartition(5)
    got = codes.near_vectors(df, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, codes.brute(rows)))


def test_recall_of_the_index_at_its_own_settings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(3000, 64))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = 0.9 + 0.01 * rng.random((3000, 1))  # as hard as links can be
    z = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * y])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(z.tolist())], "vec_id bigint, vec array<double>")
    got = {r.vec_id: r.component_id for r in codes.near_vectors(df, cell_rows=16).collect()}
    found = sum(got[i + 3000] == i for i in range(3000)) / 3000
    false = sum(c != i % 3000 and c != i for i, c in got.items())
    assert found >= 0.95 and false == 0


def test_estimates_are_unbiased_and_their_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64)) + 0.6
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = codes.encode(x)
    guess, wide = codes.estimate(c, c, 1.9)
    off = guess - x @ x.T
    other = ~np.eye(300, dtype=bool)
    assert abs(off[other].mean()) < 0.02 and (np.abs(off) > wide).mean() < 0.06
    near = other & (x @ x.T >= 0.9)
    assert not near.any() or (off[near] > -wide[near]).all()


def test_large_group_of_near_copies_is_counted_whole(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=32)
    rows = [(i, (base + 0.1 * rng.normal(size=32)).tolist()) for i in range(300)] + [(1000 + i, (-base).tolist()) for i in range(50)]
    got = {r.vec_id: r for r in codes.near_vectors(spark.createDataFrame(rows, "vec_id bigint, vec array<double>"), block=40).collect()}
    want = {i: (n, c, k) for i, n, c, k in codes.brute(rows)}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == want and want[1000] == (49, 1000, True)


def test_no_vectors(spark):
    assert codes.near_vectors(spark.createDataFrame([], "vec_id bigint, vec array<float>")).collect() == []


def test_op12_matches_sql(spark, duck):
    from ..conftest import SF, same

    assert same(codes.op12_binary_codes(spark, SF).toPandas(), duck.execute(codes.SQL["op12_binary_codes"]).df())


# ---- collocations ---------------------------------------------------------------------------


def phrases_of(seed=0, n=60):
    rng = random.Random(seed)
    words = ["new", "York", "É", "über", "a", "b", "c", "d-e", "(f)", "New", "x" * 50]
    out = [("en", None), (None, "new york new york"), ("und", "New york, NEW\tyork."), ("de", ""), ("de", " . , ;\n\r\x0b\x0c"), ("en", "a"), ("en", "a  b c a")]
    for k in range(n):
        out.append((rng.choice(["en", "de", None, ""]), "".join(rng.choice(words[: 4 + k % 8]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". ", "! "]) for _ in range(rng.randint(1, 90)))))
    return out + [out[9]] * 4 + [("fr", "the same words again and again " * 400)]


@pytest.mark.parametrize("options", [{}, {"cell_bytes": 64, "slice_bytes": 300}, {"bitmap_bytes": 1 << 16}])
@pytest.mark.parametrize("m", [collocations.Mining(least=3), collocations.Mining(least=2, top=5), collocations.Mining(longest=3, least=4)])
def test_collocations_equal_brute_force(spark, m, options):
    rows = phrases_of()
    df = clash(spark.createDataFrame([(i, a, t) for i, (a, t) in enumerate(rows)], "doc_id bigint, lang string, text string")).repartition(6)
    got = collocations.collocations(df, m, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == collocations.brute(rows, m) != []


def test_suffix_array_is_sorted_by_pieces():
    texts = [t for _, t in phrases_of()][7:30]
    shard = collocations.Shard(pa.array(texts), pa.array(["en"] * len(texts)))
    order, common = shard.suffixes(5)
    ids = np.unique(shard.hash, return_inverse=True)[1]
    suffix = [tuple(ids[i : i + min(5, shard.left[i])].tolist()) for i in range(len(ids))]
    got = [suffix[i] for i in order]
    assert got == sorted(got) and sorted(order.tolist()) == list(range(len(ids)))
    for a, b, n in zip(got, got[1:], common[1:].tolist(), strict=False):
        assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])


def test_scores_beyond_64_bits_are_exact(spark):
    n = spark.createDataFrame([("en", 10**14)], "lang string, n bigint")
    counts = [(("a",), 10**12 + 7), (("b",), 10**12 + 9), (("a", "b"), 10**12 + 1), (("b", "b"), 3)]
    told = spark.createDataFrame([("en", list(w), f) for w, f in counts], "lang string, words array<string>, f bigint")
    got = {r.phrase: r.score for r in collocations.scored(n, told).collect()}
    assert got == {"a b": 1000 * (10**12 + 1) * 10**14 // ((10**12 + 7) * (10**12 + 9)), "b b": 1000 * 3 * 10**14 // (10**12 + 9) ** 2}


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, "en", None), (2, None, "a b")], empty.schema)).collect() == []


def test_very_long_text(spark):
    text = "one two three four. " * 300_000  # 6 MB
    df = spark.createDataFrame([(1, "en", text)], "doc_id bigint, lang string, text string")
    got = [(r.phrase, r.a, r.score) for r in collocations.collocations(df, collocations.Mining(top=3)).collect()]
    assert got == [("one two three four", 300_000, 4000)]


def test_words_of_pieces():
    w = Words(pa.array(["A b\tc,d"]), collocations.PIECE_WORDS)
    assert [w.phrase(i, 1) for i in range(4)] == [b"a", b"b", b"c", b"d"]


def test_op13_matches_sql(spark, duck):
    from ..conftest import SF, same

    assert same(collocations.op13_collocations(spark, SF).toPandas(), duck.execute(collocations.SQL["op13_collocations"]).df())
