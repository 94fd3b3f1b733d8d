import numpy as np
import pandas as pd

from deltacell import schema as S
from deltacell.sources import sinks, tables

GRID = {"gt": [0.0, 10.0, 0.0, 3200.0, 0.0, -10.0], "epsg": 32633, "width": 320, "height": 320}
SCHEMA = "grid_id STRING, row INT, col INT, value DOUBLE"


def files_read(df):
    """Rows, and how many files their scan opened."""
    rows = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return rows, scan.metrics().get("numFiles").get().value(), plan


def test_a_window_opens_only_its_blocks(spark, tmp_path):
    r, c = (a.ravel() for a in np.indices((320, 320)))
    cells = spark.createDataFrame(pd.DataFrame({"grid_id": "g", "row": r.astype("int32"), "col": c.astype("int32"), "value": (r * 1000.0 + c)}))
    path = str(tmp_path / "t")
    sinks.write_index(cells, path, tile=16, block=4)
    assert spark.read.parquet(path).select("block_row", "block_col").distinct().count() == 25
    rows, files, plan = files_read(tables.read_window(spark, path, SCHEMA, [645.0, 2000.0, 1100.0, 2500.0], GRID, tile=16, block=4))
    want = {(i, j) for i in range(70, 120) for j in range(64, 110)}
    assert {(x.row, x.col) for x in rows} == want and all(x.value == x.row * 1000.0 + x.col for x in rows)
    assert files == 1 and "PartitionFilters: [" in plan and "block_row" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(tile_row,4)" in plan and "LessThanOrEqual(tile_col,6)" in plan
    whole, files, _ = files_read(tables.read_window(spark, path, SCHEMA, [0.0, 0.0, 3200.0, 3200.0], GRID, tile=16, block=4))
    assert len(whole) == 320 * 320 and files == 25
    assert tables.read_window(spark, path, SCHEMA, [9000.0, 0.0, 9100.0, 100.0], GRID, tile=16, block=4).collect() == []
    assert sorted(tables.read_cells(spark, path, SCHEMA).columns) == ["col", "grid_id", "row", "value"]


def test_sentinels_and_grids_in_one_table(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 0, None), ("a", 40, 3, 2.0), ("b", 0, 0, 1.0)], SCHEMA)
    path = str(tmp_path / "t")
    sinks.write_index(cells, path, nodata=-9999.0)
    got = tables.read_window(spark, path, SCHEMA, [0.0, 0.0, 3200.0, 3200.0], GRID, [S.INDEX_NODATA])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 0, 0, None), ("a", 40, 3, 2.0), ("b", 0, 0, 1.0)], key=str)


def test_curve_visits_each_tile_of_a_block_once(spark):
    tiles = spark.range(256).selectExpr("cast(id div 16 as int) as r", "cast(id % 16 as int) as c")
    at = {(x.r, x.c): x.k for x in tiles.select("r", "c", sinks.curve(tiles["r"], tiles["c"]).alias("k")).collect()}
    assert sorted(at.values()) == list(range(256)) and [at[p] for p in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2))] == [0, 1, 2, 3, 4]
