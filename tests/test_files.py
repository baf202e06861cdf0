"""CSV sources with fixed schemas, vector cache and JSON results."""

import pytest

from recsift.sources import files as FS


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        FS.load_data(spark, str(tmp_path / "items.csv"), str(tmp_path / "events.csv"))


def test_required_columns(spark, tmp_path):
    p = tmp_path / "items.csv"
    p.write_text("item_id,price\n1,2.5\n")
    with pytest.raises(ValueError):
        FS.load_items(spark, str(p))


def test_events_csv_roundtrip(spark, tmp_path):
    p = tmp_path / "events.csv"
    p.write_text("user_id,item_id,event,timestamp\n1,10,save,2024-01-01 00:00:00\n2,11,order,2024-01-02 10:00:00\n")
    it = tmp_path / "items.csv"
    it.write_text("item_id,category_id,brand_id,condition_id,size_id,price,image_urls\n"
                  '10,1,2,3,4,9.99,"[""https://x.com/a.jpg""]"\n')
    items, events = FS.load_data(spark, str(it), str(p))
    assert events.count() == 2 and dict(events.dtypes)["timestamp"] == "timestamp"
    assert items.first()["image_urls"] == '["https://x.com/a.jpg"]'


def test_vector_cache_and_json(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "item_id long, v array<double>")
    FS.save_vector_cache(v, str(tmp_path), "visual")
    assert FS.load_vector_cache(spark, str(tmp_path), "visual").count() == 1
    res = spark.createDataFrame([("ndcg", 10, 0.5)], "metric string, k int, value double")
    FS.write_metrics_json(res, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first()["value"] == 0.5
