"""The stored index of names: what it finds is what a scan of all names finds, and it reads its own partitions only."""

import pytest
from pyspark.sql import functions as F

from facetspark.operators.counts import typeahead
from facetspark.operators.nameindex import NameIndex
from facetspark.operators.search import title_matches

NAMES = ["the matrix", "The Matrix Reloaded", "matrix", "mat rix", "Ma", "m", "Man & Wife", "woman in red", "red", "red red", "", None, "manhattan matinee", "Émile", "a" * 400] + [f"many the {i % 7} words {i}" for i in range(60)]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i, n, i % 9) for i, n in enumerate(NAMES)] + [(1, "The Matrix Reloaded", 1)], "id bigint, name string, pop bigint")


@pytest.fixture(scope="module")
def index(spark, names, tmp_path_factory):
    return NameIndex.build(names, f"file://{tmp_path_factory.mktemp('names')}/index", buckets=8)


@pytest.mark.parametrize("query", ["matrix", "THE  matrix", "matrlx", "red", "man", "ma", "re", "m", "", "zzz", "many the words", "aaaa", "words 5", "man and wife", "émile"])
def test_search_finds_what_a_scan_finds(names, index, query):
    want = [tuple(r) for r in title_matches(names.distinct(), query, 30).collect()]
    assert [tuple(r) for r in index.search(query, 30).collect()] == want


@pytest.mark.parametrize("query", ["mat", "red", "r", "re", "many the", "matrix rel", "words 1", "wo"])
def test_typeahead_finds_what_a_scan_finds(spark, names, index, query):
    totals = names.select(F.col("id").alias("value"), (F.col("id") % 4).alias("total")).distinct()
    all_names = names.where("name is not null").distinct().select(F.col("id").alias("value"), "name")
    want = sorted(map(tuple, typeahead(all_names, totals, query, 5).select("value", "name", "tier", "total").collect()))
    assert sorted(map(tuple, index.typeahead(totals, query, 5).select("value", "name", "tier", "total").collect())) == want


def test_only_the_partitions_of_the_querys_trigrams_are_read(index):
    grams = ["mat", "atr", "tri", "rix"]
    assert index.rarest([*grams, "qqq"], 2)[0] == "qqq"
    some = index._read("postings", index.rarest(grams, 2))
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") and "PushedFilters: [In(gram" in plan.replace("IsNotNull(gram), ", "")
    everything = index._read("postings")
    assert len(some.inputFiles()) == len(everything.inputFiles())  # a frame names all files, the scan lists fewer
    assert some.select(F.input_file_name()).distinct().count() < everything.select(F.input_file_name()).distinct().count()


