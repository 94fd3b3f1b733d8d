"""Product, scene and file names as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deltacell.functions.geometry import bind

# Name patterns.
POL_TOKEN = r"(?:^|[-_])(vv|vh|hh|hv)(?:[-_.]|$)"
FRAME_NAME = (
    r"^S1([ABCD]?)[ABCD]?_(\d{8}T\d{6})_(\d{8}T\d{6})_([VH][VH])([A-Z]\d{3})_INT(\d{2})_G_\w{3}_([0-9A-Fa-f]{4})$"
)
BURST_NAME = (
    r"^S1([ABCD]?)[ABCD]?_(\d{3})_([0-9A-Za-z]+(?:-[0-9A-Za-z]+)*)_(IW|EW)_(\d{8})_(\d{8})_([VH][VH])"
    r"_INT(\d{2})_([0-9A-Fa-f]{4})$"
)
CSLC_V11 = (
    r"(?i)OPERA_L2_CSLC-S1_T(\d+)-(\d+)-IW(\d)_(\d{8})T(\d{6})Z_\d{8}T\d{6}Z_(S1[AB])_(VV|VH|HH|HV)_v"
)
CSLC_V10 = r"(?i)OPERA_L2_CSLC-S1_T(\d+)-(\d+)-IW(\d)_(VV|VH|HH|HV)_(\d{8})T(\d{6})Z"
SLC_NAME = r"S1([AB])_IW_SLC__1SDV_(\d{8})T(\d{6})_(\d{8})T(\d{6})_(\d{6})_([0-9A-Fa-f]{6})"
LAYER_SUFFIXES = ("_corr.tif", "_unw.tif", "_wm.tif", "_water_mask.tif")
COHERENCE_SUFFIX = "_corr.tif"
WATER_SUFFIXES = ("_wm.tif", "_water_mask.tif")
MEASURE_KEYS = ("vv", "vh", "hh", "hv")
PREVIEW_KEYS = ("rendered_preview", "preview", "thumbnail", "quicklook", "quick-look", "browse")
AUXILIARY_MARKERS = (
    "manifest", "schema", "calibration", "noise", "product", "tiepoint", "tie-point", "tie_point", "annotation",
    "preview", "thumbnail", "quick-look", "quicklook", "browse", "report", "summary", "icon", "overlay",
    "map-overlay", "ql.png",
)


def _part(name: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def polarization(path: Column) -> Column:
    """Upper-case token of a file name, empty when there is none between separators."""
    return F.upper(F.regexp_extract(F.lower(stem(path)), POL_TOKEN, 1))


def is_measurement(path: Column) -> Column:
    """Band file: tif or tiff, with a polarisation token and no auxiliary marker."""
    name = F.lower(basename(path))
    marked = F.lit(False)
    for m in AUXILIARY_MARKERS:
        marked = marked | F.contains(name, F.lit(m))
    return name.rlike(r"\.tiff?$") & ~marked & (polarization(path) != "")


def granule_candidates(path: Column) -> Column:
    """Names a product may carry: archive stem, layer name without suffix, folder, plain stem."""
    base = basename(path)
    lower = F.lower(base)
    parts = F.split(path, "/")
    parent = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    names = [F.when(lower.endswith(".zip"), stem(path))]
    for s in LAYER_SUFFIXES:
        names.append(F.when(lower.endswith(s), F.substr(base, F.lit(1), F.length(base) - len(s))))
    names += [parent, stem(path)]
    trimmed = F.transform(F.array_compact(F.array(*names)), lambda n: F.trim(n))
    return F.array_distinct(F.filter(trimmed, lambda n: n != ""))


def parse_name(name: Column) -> Column:
    """One granule name as a struct; ``family`` is NULL when neither pattern fits."""
    seen = F.struct(name.alias("name"), name.rlike(BURST_NAME).alias("burst"), name.rlike(FRAME_NAME).alias("frame"))
    return bind(seen, lambda s: _fields(s["name"], s["burst"], s["frame"]))


def _fields(name: Column, burst: Column, frame: Column) -> Column:
    b = lambda i: F.when(burst, _part(name, BURST_NAME, i))
    f = lambda i: F.when(frame, _part(name, FRAME_NAME, i))
    return F.struct(
        name.alias("granule"),
        F.when(burst, "isce").when(frame, "gamma").alias("family"),
        F.coalesce(b(1), f(1)).alias("platform"),
        b(2).cast("int").alias("track"),
        F.upper(F.coalesce(b(7), f(4))).alias("pol"),
        F.coalesce(b(8), f(6)).cast("int").alias("spacing_m"),
        F.upper(F.coalesce(b(9), f(7))).alias("pid"),
        F.coalesce(b(5), f(2)).alias("date1"),
        F.coalesce(b(6), f(3)).alias("date2"),
        b(3).alias("burst_ids"),
        F.lower(b(3)).alias("burst_key"),
        f(5).alias("orbit_code"),
    )


def parse_product(path: Column) -> Column:
    """First candidate name of a path that parses, else the first candidate with no family."""
    fits = lambda n: n.rlike(BURST_NAME) | n.rlike(FRAME_NAME)
    pick = lambda c: F.coalesce(F.get(F.filter(c, fits), F.lit(0)), F.get(c, F.lit(0)))
    return bind(bind(granule_candidates(path), pick), parse_name)


def split_slc(title: Column) -> Column:
    """Platform, start stamp and orbit key (absolute orbit modulo 175) of an SLC title."""
    f = F.split(title, "_")
    orbit = F.get(f, F.lit(7)).try_cast("int")
    return F.struct(
        F.get(f, F.lit(0)).alias("platform"),
        F.try_to_timestamp(F.get(f, F.lit(5)), F.lit("yyyyMMdd'T'HHmmss")).alias("start"),
        orbit.alias("abs_orbit"),
        (orbit % 175).alias("orbit_key"),
    )


def parse_slc(title: Column) -> Column:
    """Strict form of an SLC title; NULL fields when it does not fit."""
    p = lambda i: _part(title, SLC_NAME, i)
    return F.struct(
        F.concat(F.lit("S1"), p(1)).alias("sat"), p(2).alias("date"), p(3).alias("time"),
        p(6).cast("int").alias("abs_orbit"), p(7).alias("take"),
    )


def parse_cslc(name: Column) -> Column:
    """Burst SLC name, newer layout first."""
    new = name.rlike(CSLC_V11)
    n = lambda i: _part(name, CSLC_V11, i)
    o = lambda i: _part(name, CSLC_V10, i)
    pick = lambda a, b: F.when(new, a).otherwise(b)
    day = pick(n(4), o(5))
    return F.struct(
        pick(n(1), o(1)).cast("int").alias("track"),
        pick(n(2), o(2)).cast("int").alias("frame"),
        pick(n(3), o(3)).cast("int").alias("iw"),
        pick(n(7), o(4)).alias("pol"),
        F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)).alias("date"),
        pick(n(5), o(6)).alias("time"),
        F.when(new, n(6)).alias("sat"),
    )


def job_link(name: Column) -> Column:
    """Event id and kind of a job named ``id<N>-...``; other names give NULL."""
    event = _part(name, r"^id([^-]+)", 1)
    kind = F.when(F.contains(name, F.lit("control")), "control").when(F.contains(name, F.lit("prepost")), "prepost")
    return F.struct(event.alias("event_id"), F.when(event.isNotNull(), F.coalesce(kind, F.lit("other"))).alias("kind"))
