import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from facetspark.sources import catalogue, readers
from facetspark.streaming import events


def test_export_top(spark, tmp_path):
    rows = [{"id": i, "original_title": f"t{i}", "popularity": i % 7, "adult": i % 5 == 0} for i in range(1, 30)]
    with gzip.open(tmp_path / "x.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, rows)))
    want = sorted((r for r in rows if not r["adult"]), key=lambda r: (-r["popularity"], r["id"]))[:5]
    assert [r.id for r in readers.export_top(spark, str(tmp_path / "x.json.gz"), 5).collect()] == [r["id"] for r in want]


def test_tsv_cache_expires(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("# votes\n0\t1\t7.5\t100\t2024-01-01\n0\t2\t6.0\t3\t2020-01-01\n")
    assert [r.id for r in readers.tsv_cache(spark, str(tmp_path / "v.tsv"), readers.VOTES, F.lit("2024-02-01").cast("date")).collect()] == [1]


def test_charts_drop_invalid_entries(spark, tmp_path):
    items = [{"imdb": "tt1", "title": "A"}, {"imdb": "x", "title": "B"}, {"imdb": "tt2", "title": " "}, {"imdb": "tt1", "title": "C"}, {"imdb": "tt3", "title": "D"}]
    (tmp_path / "c.json").write_text(json.dumps({"list": "p", "items": items}))
    assert [(r.rank, r.imdb, r.title) for r in readers.chart_json(spark, str(tmp_path / "c.json")).orderBy("rank").collect()] == [(0, "tt1", "A"), (1, "tt3", "D")]


def test_episodes(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"id": 5, "_embedded": {"episodes": [{"season": 1, "number": 2, "airdate": "2024-03-01"}, {"season": 1, "number": 3, "airdate": ""}]}}))
    assert [tuple(r) for r in readers.episodes_json(spark, str(tmp_path / "s.json")).orderBy("number").collect()] == [(5, 1, 2, dt.date(2024, 3, 1)), (5, 1, 3, None)]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"model": "m", "dims": 4, "files": [{"path": "a/b"}]}))
    assert readers.manifest(spark, str(tmp_path / "m.json"), "m", 4)["dims"] == 4
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "m.json"), "m", 5)
    (tmp_path / "n.json").write_text(json.dumps({"model": "m", "dims": 4, "files": [{"path": "../b"}]}))
    with pytest.raises(ValueError):
        readers.manifest(spark, str(tmp_path / "n.json"), "m", 4)


def test_authority_needs_unique_names(spark):
    seen = spark.createDataFrame([("A b", "12"), ("C", "ALL"), ("D", "16"), ("d", "18"), ("E", "?")], "name string, rating string")
    titles = spark.createDataFrame([(0, 1, "a-B"), (0, 2, "C"), (1, 3, "c"), (0, 4, "D"), (0, 5, "E")], "media int, id bigint, title string")
    assert [tuple(r) for r in readers.authority_ages(seen, titles).collect()] == [(0, 1, 12)]


def test_snapshot_checksum_and_guard(spark, tmp_path):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(9)], "a int, b string")
    out = readers.write_snapshot(df, str(tmp_path / "snap"), "v1")
    assert readers.checksum(spark.read.parquet(out)) == readers.checksum(df.repartition(3))
    assert readers.prohibited_columns(df.select(F.struct("a", "b").alias("s")), {"b"}) == ["s.b"]


def test_table_schema(spark):
    from pyspark.sql.types import StructType

    assert catalogue.table(spark, "/root/testdata/sf0.001", "region", StructType.fromDDL("r_name string")).columns == ["r_name"]
    with pytest.raises(ValueError):
        catalogue.table(spark, "/root/testdata/sf0.001", "region", StructType.fromDDL("nope string"))


def test_snapshots_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1)) for i in range(5)], "event_id bigint, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    s = events.event_stream(spark, str(tmp_path / "in"), df.schema)
    events.refresh_snapshots(events.deduplicated(s, ["event_id"]), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    assert events.unexpired(df, "ts", F.lit("2024-03-01").cast("timestamp"), 30).count() == 0


def test_older_sidecars(spark, tmp_path):
    import gzip
    import json

    facts = [{"type": "movie", "id": 1, "revision": 1, "runtime": 90}, {"type": "movie", "id": 1, "revision": 2, "released": "1999-05-01", "countries": ["FR"]}, {"type": "series", "id": 1}, {"type": "movie"}, {"type": "other", "id": 4}]
    with gzip.open(tmp_path / "facts.json.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, facts)))
    got = {(r.media, r.id): r for r in readers.facts_json(spark, str(tmp_path / "facts.json.gz")).collect()}
    assert set(got) == {(0, 1), (1, 1)} and str(got[0, 1].released) == "1999-05-01" and got[0, 1].countries == ["FR"] and got[0, 1].runtime is None and got[1, 1].makers == []
    facets = [{"type": "series", "id": 3, "facets": {"pace": {"value": "slow", "confidence": 3}, "era": {"value": "now", "confidence": 2}, "x": {"value": "y", "confidence": 1}, "scale": {"value": "z"}}}]
    (tmp_path / "facets.json").write_text("\n".join(map(json.dumps, facets)))
    rows = readers.facets_json(spark, str(tmp_path / "facets.json"), ["pace", "era", "scale"]).collect()
    assert sorted((r.media, r.id, r.kind, r.value, round(r.p, 3)) for r in rows) == [(1, 3, "era", "now", 0.667), (1, 3, "pace", "slow", 1.0)]
    few = spark.range(10)
    assert readers.checked(few.limit(6), few).count() == 6
    with pytest.raises(ValueError, match="only 2 of 10"):
        readers.checked(few.limit(2), few)


def test_prohibited_names_at_any_depth(spark):
    df = spark.createDataFrame([], "id int, `Plot_Text` string, deep array<struct<x:int, `Over-View`:string>>")
    assert readers.prohibited_columns(df, {"plottext", "overview"}) == ["Plot_Text", "deep.Over-View"]


def test_kinds_of_the_title_table_come_from_one_pass(spark):
    """before, every kind read the table for itself."""
    from facetspark.sources import kinds

    from .conftest import SF

    rows = kinds.carried(spark, SF, {*kinds.AXES, "mood", "genre"})
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
