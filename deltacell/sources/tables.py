"""Scans of cell tables, event layers and file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltacell import schema as S
from deltacell.functions import geometry as G
from deltacell.functions import naming as N
from deltacell.functions import radiometry as R
from deltacell.operators.focal import TILE
from deltacell.operators.resample import window
from deltacell.sources.sinks import BLOCK


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.GRID).parquet(path)


def read_cells(spark: SparkSession, path: str, schema: str, bbox: Sequence[float] | None = None, grid: dict | None = None, sentinels: Sequence[float] = ()) -> DataFrame:
    """Cell table with sentinels and NaN turned to NULL; a bbox becomes a row and column range."""
    cells = spark.read.schema(schema).parquet(path)
    cells = cells.drop("block_row", "block_col")  # folders that a layout may add
    if bbox is not None:
        cells = window(cells, bbox, grid)
    if "value" in cells.columns:
        cells = cells.withColumn("value", R.clean(F.col("value"), *sentinels))
    return cells


def read_window(
    spark: SparkSession, path: str, schema: str, bbox: Sequence[float], grid: dict, sentinels: Sequence[float] = (),
    tile: int = TILE, block: int = BLOCK,
) -> DataFrame:
    """Cells of a bbox from a table of ``sinks.write_index``; empty where they miss.

    The bbox becomes a range of blocks, by which whole folders are left out, and of tiles, rows and
    columns, which go to the scan. ``tile`` and ``block`` are those the table was written with.
    """
    laid = f"{schema}, tile_row INT, tile_col INT, block_row INT, block_col INT"
    cells = spark.read.schema(laid).parquet(path)
    names = T.StructType.fromDDL(schema).fieldNames()
    bounds = G.window_bounds(list(bbox), grid["gt"], grid["width"], grid["height"])
    r0, r1, c0, c1 = bounds or (0, -1, 0, -1)
    for axis, lo, hi in (("row", r0, r1), ("col", c0, c1)):
        cells = cells.where(F.col(f"block_{axis}").between(lo // tile // block, hi // tile // block))
        cells = cells.where(F.col(f"tile_{axis}").between(lo // tile, hi // tile) & F.col(axis).between(lo, hi))
    if "value" in names:
        cells = cells.withColumn("value", R.clean(F.col("value"), *sentinels))
    return cells.select(*names)


def read_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Event layer with its fixed columns; -9999 means missing in numbers and text alike."""
    raw = spark.read.schema(S.EVENT).format(fmt).load(path)
    fixed = []
    for f in raw.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() in ("integer", "double"):
            c = F.when(c != -9999, c)
        elif f.dataType.typeName() == "string":
            c = F.when(c != "-9999", c)
        fixed.append(c.alias(f.name))
    return raw.select(*fixed)


def _single_byte_text(content: Column, encoding: str) -> Column:
    """Text of a one-byte encoding, read as Latin-1 and then exchanged letter for letter."""
    high = bytes(range(128, 256))
    return F.translate(F.decode(content, "iso-8859-1"), high.decode("iso-8859-1"), high.decode(encoding, "replace"))


def read_legacy_csv(spark: SparkSession, path: str, wanted: dict[str, str], header_line: int = 31, encoding: str = "windows-1251") -> DataFrame:
    """Semicolon text with a preamble, comment rows and decimal commas.

    ``wanted`` maps a header cell's text to ``"name TYPE"``. The header sits on line
    ``header_line`` (from 0) of each file; the files are small by nature, so each is read as one
    row and its lines keep their numbers. Numbers that do not parse are NULL.
    """
    files = spark.read.format("binaryFile").load(path).select("path", _single_byte_text(F.col("content"), encoding).alias("text"))
    files = files.withColumn("_lines", F.split("text", r"\r?\n"))
    head = F.transform(F.split(F.get("_lines", F.lit(header_line)), ";"), lambda h: F.trim(h))
    files = files.withColumn("_head", head)
    lines = files.select("path", "_head", F.posexplode("_lines").alias("line", "_text"))
    body = lines.where(
        (F.col("line") > header_line) & (F.trim("_text") != "") & ~F.col("_text").startswith("/*")
    ).withColumn("_cells", F.split("_text", ";"))
    cols = []
    for title, spec in wanted.items():
        name, kind = spec.split()
        cell = F.trim(F.get("_cells", F.array_position("_head", title).cast("int") - 1))
        if kind.lower() in ("double", "int", "bigint"):
            cell = F.replace(cell, F.lit(","), F.lit(".")).try_cast("double")
            cell = cell if kind.lower() == "double" else cell.cast(kind)
        cols.append(cell.alias(name))
    return body.select("path", "line", *cols)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths below a folder; file contents are never read because the column is pruned."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def measurement_files(paths: DataFrame) -> DataFrame:
    p = F.col("path")
    return paths.where(N.is_measurement(p)).withColumn("band", N.polarization(p)).withColumn("file", N.basename(p))


def product_layers(paths: DataFrame, product: Column) -> DataFrame:
    """Layers per product: exactly one coherence file (else an error), the first water mask if any."""
    low = F.lower(F.col("path"))
    coh = low.endswith(N.COHERENCE_SUFFIX)
    water = F.lit(False)
    for s in N.WATER_SUFFIXES:
        water = water | low.endswith(s)
    found = paths.withColumn("product", product).groupBy("product").agg(
        F.count_if(coh).alias("_n"), F.min(F.when(coh, F.col("path"))).alias("_coh"),
        F.min(F.when(water, F.col("path"))).alias("water_mask"),
    )
    n = F.col("_n")
    one = F.when(n == 1, F.col("_coh")).when(n == 0, F.raise_error(F.concat(F.lit("no coherence layer: "), "product"))).otherwise(
        F.raise_error(F.concat(F.lit("several coherence layers: "), "product"))
    )
    return found.select("product", one.alias("coherence"), "water_mask")
