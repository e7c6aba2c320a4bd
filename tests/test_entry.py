"""Every query over the reference tables agrees with its SQL."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession, functions as F

from bracken import registry
from bracken.functions import targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for p in Path(SF).iterdir():
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, SF)
    want = db.sql(registry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, want.select(*names).fetchall()))


@pytest.mark.parametrize("path,escapes", [("../x", True), ("a/../b", False), ("a/../../etc", True), ("/etc/x", True), ("C:\\x", True), ("\\\\host\\x", True), ("https://x/y", True), ("w/x.bin", False), ("./x", False), ("", False), (None, False), ("a\\..\\..\\x", True)])
def test_paths(spark, path, escapes):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(targets.path_escapes(F.col("p"))).first()[0] is escapes
