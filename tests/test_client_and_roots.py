"""Roots of projects on disk, and fields by name."""

from pyspark.sql import functions as F

from codeloom.sources import config_scan, endpoint_rules


def test_project_roots(spark, tmp_path):
    (tmp_path / "shop" / "src" / "main" / "java" / "a").mkdir(parents=True)
    (tmp_path / "shop" / "pom.xml").write_text("<project/>")
    (tmp_path / "other" / "src" / "main" / "resources").mkdir(parents=True)
    root = lambda p, r=None: config_scan.project_root(spark, str(tmp_path / p), r)
    assert root("shop/src/main/java/a/A.java") == str(tmp_path / "shop")
    assert root("other/src/main/java/B.java") == str(tmp_path / "other")
    assert root("x/y/src/C.java", "src/C.java") == str(tmp_path / "x/y")
    assert root("none/C.java") is None


def test_fields_by_name(spark):
    rows = spark.createDataFrame([(1, "a", {"topic": "b", "isExternal": "true", "nosuch": "1", "startLine": "7"}), (2, "a", None)], "pos long, topic string, fields map<string,string>")
    got = endpoint_rules.with_fields(rows.withColumn("startLine", F.lit(3))).select("pos", "topic", "isExternal", "startLine", "group").collect()
    assert sorted(map(tuple, got)) == [(1, "b", True, 3, None), (2, "a", None, 3, None)]
