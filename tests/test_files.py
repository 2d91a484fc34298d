"""Sinks, order over all rows and enrichment."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from awardlens.operators import order, staging
from awardlens.sources import files


def test_a_json_document_is_one_array_in_one_file(spark, tmp_path):
    df = spark.range(1000).select(F.col("id"), F.concat(F.lit('q"\n'), "id").alias("a.b")).repartition(7)
    path = f"{tmp_path}/out.json"
    files.write_json_document(df, path)
    found = json.loads(open(path).read())
    assert sorted((r["id"], r["a.b"]) for r in found) == [(i, f'q"\n{i}') for i in range(1000)]
    files.write_json_document(df.limit(0), path)
    assert json.loads(open(path).read()) == [] and not glob.glob(f"{path}.pieces*")


def test_stamped_exports_stay(spark, tmp_path):
    path = files.write_stamped(spark.range(3), str(tmp_path), "rows", "20240101")
    assert path.endswith("rows_20240101.jsonl") and spark.read.json(path).count() == 3
    files.write_stamped(spark.range(2), str(tmp_path), "rows", "20240102")
    assert spark.read.json(path).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_stamped(spark.range(2), str(tmp_path), "rows", "20240102")


def test_places_over_all_rows(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"), (F.col("id") % 3).alias("y")).repartition(9)
    rows = order.numbered(df, [F.desc("y"), F.col("x")], "place").collect()
    want = sorted(((r.y, r.x) for r in rows), key=lambda t: (-t[0], t[1]))
    assert [(r.y, r.x) for r in sorted(rows, key=lambda r: r.place)] == want and {r.place for r in rows} == set(range(1, 501))
    assert order.numbered(df.limit(0), [F.col("x")], "place").count() == 0


def test_enrichment_fails_on_records_of_unknown_keys(spark):
    firms = spark.createDataFrame([(1, "a"), (2, "b")], "firm long, name string")
    known = spark.createDataFrame([(1, 5.0)], "firm long, capital double")
    news = spark.createDataFrame([(2, 3), (9, 4)], "firm long, mentions int")
    rows = staging.enriched(firms, "firm", [known], [news]).orderBy("firm").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 5.0, None), (2, "b", None, 3)]
    with pytest.raises(ValueError, match="7"):
        staging.enriched(firms, "firm", [known.union(spark.createDataFrame([(7, 1.0)], known.schema))], [])
