"""Table layouts as DDL text. Cells that hold no data are SQL NULL, never NaN and never a sentinel."""

from __future__ import annotations

GRID = "grid_id STRING, width INT, height INT, gt ARRAY<DOUBLE>, epsg INT, nodata DOUBLE"
OBS = "grid_id STRING, scene_id STRING, period STRING, band STRING, row INT, col INT, value DOUBLE"
COHERENCE = "grid_id STRING, product_id STRING, role STRING, row INT, col INT, value DOUBLE"
MASK = "grid_id STRING, mask_id STRING, row INT, col INT"
CLASSES = "grid_id STRING, row INT, col INT, cls INT, cover INT, loss INT"
INDEX = "grid_id STRING, run_id STRING, row INT, col INT, value DOUBLE"
PRODUCT = (
    "granule STRING, family STRING, platform STRING, track INT, pol STRING, spacing_m INT, pid STRING, "
    "date1 STRING, date2 STRING, burst_ids STRING, burst_key STRING, orbit_code STRING"
)
SCENE = (
    "scene_id STRING, ts TIMESTAMP, platform STRING, polarizations ARRAY<STRING>, orbit_direction STRING, "
    "relative_orbit INT, bbox ARRAY<DOUBLE>, collection STRING, assets MAP<STRING,STRING>, preview_url STRING"
)
EVENT = (
    "id INT, storm_id INT, type STRING, certainty STRING, year INT, month INT, date STRING, date_1 STRING, "
    "date_2 STRING, n_polygons INT, area_km2 DOUBLE, length_km DOUBLE, mean_width_m DOUBLE, max_width_m DOUBLE, "
    "wind_gust INT, direction STRING, near_ws STRING, ws_dist DOUBLE, geom ARRAY<ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>>>"
)
CHAIN = (
    "id INT, storm_date DATE, platform STRING, rel_orbit INT, pre DATE, post DATE, control DATE, "
    "pair_interval_days INT, control_interval_days INT, coverages ARRAY<DOUBLE>, quality STRING"
)
LANDSCAPE = (
    "id INT, forest_frac DOUBLE, water_frac DOUBLE, wetland_frac DOUBLE, crop_frac DOUBLE, "
    "slope_mean_deg DOUBLE, slope_p90_deg DOUBLE, classes MAP<INT,BIGINT>"
)

# Fixed values of the method.
INDEX_NODATA = -9999.0
DB_FLOOR = -100.0
DB_NEGATIVE_SHARE = 0.05
AMPLITUDE_OFFSET_DB = 2.9
AMPLITUDE_FIXED_DB = 3.0
LBAND_OFFSET_DB = 2.0
COHERENCE_OFFSET = 0.25
COHERENCE_FIXED = 0.25
COHERENCE_RANGE = (-0.01, 1.01)
NONFOREST_COHERENCE = 0.6
MIN_FOREST_SHARE = 0.3
MAX_WATER_SHARE = 0.5
MIN_PIXELS_10M = 27
MIN_PIXELS_80M = 6
MEDIAN_SIZE = 3
BOX_MIN_VALID = 0.30
TREE_CLASSES = (10,)
SCREENING_TREE_CLASSES = (10, 95)
COVER_TAU = 30
COVER_TAUS = (20, 30, 50)
FOREST_FRACTION = 0.5
OVERLAP_SHARE = 0.3
OUTSIDE_FOREST_FLAG = "вне_леса@Y"

# Weights of (delta VV, delta VH) in the studied index family.
INDEX_WEIGHTS = {
    "dVV": (1.0, 0.0),
    "dVH": (0.0, 1.0),
    "WI": (1.0, 1.0),
    "dpol": (-1.0, 1.0),
    "WI_vv0.5": (0.5, 1.0),
    "WI_vv1.5": (1.5, 1.0),
    "WI_vh0.5": (1.0, 0.5),
    "WI_vh1.5": (1.0, 1.5),
}
