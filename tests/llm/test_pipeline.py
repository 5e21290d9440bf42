"""The pipeline and the registered queries against SQL, on the smallest data set."""

import numpy as np
import pytest

import corpus_pipeline
from facetspark.llm import decontaminate, queries
from facetspark.llm.common import read_table
from facetspark.llm.ngramjoin import jaccard_components

from ..conftest import SF, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert same(queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df())


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]


def test_each_stage_does_its_job(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    steps = [f for _, f in corpus_pipeline.STAGES]
    clean = steps[0](spark, docs, SF)
    assert clean.columns == columns and 0.75 * docs.count() < clean.count() <= docs.count()  # few labels here; test_llm has more
    lines = steps[1](spark, clean, SF)
    assert lines.columns == columns and lines.count() == clean.count()
    one = steps[2](spark, lines, SF)
    assert one.columns == columns and one.count() <= lines.count()
    raw = steps[2](spark, docs, SF)  # before line dedup has emptied the copies
    assert raw.count() < docs.count()
    left = jaccard_components(one).collect()
    assert all(r.doc_id == r.component_id for r in left)
    safe = steps[3](spark, one, SF)
    assert safe.columns == columns
    assert decontaminate.scan(safe, read_table(spark, SF, "benchmark")).where("size(hit_words) > 0").count() == 0
    packed = steps[4](spark, safe, SF).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in safe.select("doc_id").collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048 and np.all(packed.length > 0)


def test_odd_rows_go_through(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "x " * 5000, "en", "s", 10000), (3, "x " * 5000, "en", "s", 10000), (None, "y", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert docs.count() == 4  # the repeated row stays once
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 4
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_toxicity_hands_on_each_text_once(spark):
    """Before, a batch had the text both by itself and in its row."""
    from facetspark.llm import toxicity

    out = toxicity.reject(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"))
    judged = out._jdf.queryExecution().analyzed().children().head()
    assert judged.children().head().output().size() == 1
