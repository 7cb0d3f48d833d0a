"""Pixel layers and spatial units: cropping, zone areas, change matrices and their bounds.

Layers live in one long pixel table (layer, year, cell_row, cell_col, y, value). A raster has each
cell once, so a (cell, layer, year) is a row; that bounds every tile and every cell group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.functions.nulls import as_col, nan_to_null, strict_sum
from furrow.functions.quantiles import group_quantiles
from furrow.operators.relational import attach, place, share_of_total
from furrow.sources.stages import stage

EARTH_RADIUS_KM = 6371.0072
TILE = 256
CELL = ["cell_row", "cell_col"]


def unit_attributes(shapes: DataFrame) -> DataFrame:
    """Attribute table of a vector layer: numeric unit code, name and bounding box."""
    return shapes.select(F.expr("try_cast(CD_MUN AS BIGINT)").alias("municipality_code"),
                         F.col("NM_MUN").alias("municipality_name"), "xmin", "ymin", "xmax", "ymax")


def cell_extents(units: DataFrame, west: float, north: float, width: float, height: float
                 ) -> DataFrame:
    """Bounding boxes as inclusive row and column ranges of a north-up grid."""
    return units.withColumns({
        "row_min": F.round((F.lit(north) - F.col("ymax")) / height).cast("bigint"),
        "row_max": F.round((F.lit(north) - F.col("ymin")) / height).cast("bigint") - 1,
        "col_min": F.round((F.col("xmin") - west) / width).cast("bigint"),
        "col_max": F.round((F.col("xmax") - west) / width).cast("bigint") - 1})


def origin_units(flows: DataFrame, units: Sequence[int] | None = None) -> DataFrame:
    """Distinct origins of the flows, optionally a chosen few."""
    origins = flows.select("municipality_code").distinct()
    return origins.where(F.col("municipality_code").isin(list(units))) if units is not None else origins


def unit_tiles(units: DataFrame, tile: int = TILE) -> DataFrame:
    """Unit extents once per grid tile they touch."""
    box = units.select("municipality_code", "row_min", "row_max", "col_min", "col_max")
    rows = F.sequence(F.floor(F.col("row_min") / tile), F.floor(F.col("row_max") / tile))
    cols = F.sequence(F.floor(F.col("col_min") / tile), F.floor(F.col("col_max") / tile))
    return box.withColumn("tile_row", F.explode(rows)).withColumn("tile_col", F.explode(cols))


def crop(cells: DataFrame, units: DataFrame, tile: int = TILE) -> DataFrame:
    """Cells inside each unit's bounding box, once per unit.

    The range test is a residual of an equality on tiles, so the join is a hash or sort-merge
    join. A tile has at most tile² cells per layer and year, which bounds every join key.
    """
    boxes = stage(unit_tiles(units, tile), "unit_tiles").withColumnsRenamed(
        {"tile_row": "__tr", "tile_col": "__tc"})
    inside = ((F.floor(F.col("cell_row") / tile) == F.col("__tr"))
              & (F.floor(F.col("cell_col") / tile) == F.col("__tc"))
              & F.col("cell_row").between(F.col("row_min"), F.col("row_max"))
              & F.col("cell_col").between(F.col("col_min"), F.col("col_max")))
    return cells.join(boxes, inside).drop("__tr", "__tc", "row_min", "row_max", "col_min", "col_max")


def cell_area_km2(y: Column | str, width: float, height: float) -> Column:
    """Area of a cell of `width` × `height` degrees whose centre lies at latitude y."""
    centre, half = as_col(y), F.lit(height / 2)
    band = F.sin(F.radians(centre + half)) - F.sin(F.radians(centre - half))
    return F.lit(EARTH_RADIUS_KM ** 2) * F.radians(F.lit(width)) * band


def zone_areas(pixels: DataFrame, units: DataFrame, width: float, height: float) -> DataFrame:
    """Area of each climate zone inside each unit; pixels without a zone form a zone of their own.

    Equal rows of a unit have equal cell areas, so cells are counted per row before any sum of
    areas is taken.
    """
    zones = pixels.where(F.col("layer") == "zone").select(
        *CELL, "y", F.col("value").cast("bigint").alias("ipcc_code"))
    rows = crop(zones, units).groupBy("municipality_code", "ipcc_code", "y").agg(
        F.count(F.lit(1)).alias("n"))
    return rows.groupBy("municipality_code", "ipcc_code").agg(
        F.sum(F.col("n") * cell_area_km2("y", width, height)).alias("area_eco_zone"))


def align_layers(pixels: DataFrame, width: float, height: float, lag: int = K.LAG_YEARS,
                 years: Sequence[int] | None = None) -> DataFrame:
    """Cover and soil carbon of a year and of `lag` years before, and the earlier burn, per cell.

    A pixel of year t serves year t as "now" and year t+lag as "before": one row for each role,
    then a single aggregation per (cell, year) in place of five joins. Pixels are placed by cell, each
    once, before they multiply.
    """
    now = F.array(F.lit(0), F.lit(lag))
    if years is not None:  # years that serve none of the targets are not read
        pixels = pixels.where(F.col("year").isin(sorted({y - s for y in years for s in (0, lag)})))
    placed = place(pixels.where(F.col("layer").isin("cover", "soc", "burn")), CELL)
    roles = placed.withColumn(
        "shift", F.explode(F.when(F.col("layer") == "burn", F.array(F.lit(lag))).otherwise(now)))
    roles = roles.withColumn("target", F.col("year") + F.col("shift"))
    if years is not None:
        roles = roles.where(F.col("target").isin(list(years)))

    def slot(layer: str, shift: int) -> Column:
        return F.max(F.when((F.col("layer") == layer) & (F.col("shift") == shift), F.col("value")))

    is_cover = F.col("layer") == "cover"
    cells = roles.groupBy(*CELL, "y", F.col("target").alias("year")).agg(
        slot("cover", 0).alias("cov1"), slot("cover", lag).alias("cov0"),
        slot("soc", 0).alias("soc1"), slot("soc", lag).alias("soc0"),
        slot("burn", lag).alias("burnt"), F.count_if(is_cover).alias("covers"))
    return cells.where("covers > 0").drop("covers").withColumn(
        "area", cell_area_km2("y", width, height))


def crop_cells(aligned: DataFrame, crop_class: int = K.CROP_CLASS) -> DataFrame:
    """Cells under the crop, with the change of soil carbon."""
    return aligned.where(F.col("cov1") == crop_class).withColumn(
        "csoc", F.col("soc1") - F.col("soc0"))


def planted_cells(pixels: DataFrame, width: float, height: float, units: DataFrame | None = None,
                  lag: int = K.LAG_YEARS, years: Sequence[int] | None = None,
                  crop_class: int = K.CROP_CLASS, tile: int = TILE) -> DataFrame:
    """The rows of `crop_cells(align_layers(...))`, of the tiles that `units` touch if they are given.

    Cells under the crop lead: of the present cover only their class is shuffled, of the other layers
    only tiles that hold such a cell in the target year. Both prunings and the units' tiles are
    semi-joins with staged lists of tiles (a row per tile and year), and the units' rows and the years
    are bounds on the scan, so all of it comes before the one exchange of pixels.
    """
    on_tile = {"__tr": F.floor(F.col("cell_row") / tile), "__tc": F.floor(F.col("cell_col") / tile)}
    layers = pixels.where(F.col("layer").isin("cover", "soc", "burn"))
    if years is not None:
        layers = layers.where(F.col("year").isin(sorted({y - s for y in years for s in (0, lag)})))
    if units is not None:
        near = stage(unit_tiles(units, tile).select(
            F.col("tile_row").alias("__tr"), F.col("tile_col").alias("__tc")).distinct(), "extent_tiles")
        band = near.agg(F.min("__tr"), F.max("__tr"), F.min("__tc"), F.max("__tc")).first()
        row_0, row_1, col_0, col_1 = (x if x is not None else -1 for x in band)
        layers = layers.where(F.col("cell_row").between(row_0 * tile, (row_1 + 1) * tile - 1)
                              & F.col("cell_col").between(col_0 * tile, (col_1 + 1) * tile - 1))
        layers = layers.withColumns(on_tile).join(near, ["__tr", "__tc"], "left_semi")
    layers = layers.withColumns(on_tile)
    planted = (F.col("layer") == "cover") & (F.col("value") == crop_class)
    served = layers.where(planted) if years is None else layers.where(planted & F.col("year").isin(list(years)))
    tiles = stage(served.select("__tr", "__tc", F.col("year").alias("target")).distinct(), "planted_tiles")
    now = F.when(F.col("layer") == "soc", F.array(F.lit(0), F.lit(lag))) \
        .when(planted, F.array(F.lit(0), F.lit(lag))).otherwise(F.array(F.lit(lag)))
    roles = layers.withColumn("shift", F.explode(now)).withColumn("target", F.col("year") + F.col("shift"))
    roles = roles.join(tiles, ["__tr", "__tc", "target"], "left_semi")

    def slot(layer: str, shift: int) -> Column:
        return F.max(F.when((F.col("layer") == layer) & (F.col("shift") == shift), F.col("value")))

    roles = place(roles.select("layer", "shift", "target", "year", *CELL, "y", "value"), CELL)
    cells = roles.groupBy(*CELL, "y", F.col("target").alias("year")).agg(
        slot("cover", 0).alias("cov1"), slot("cover", lag).alias("cov0"),
        slot("soc", 0).alias("soc1"), slot("soc", lag).alias("soc0"), slot("burn", lag).alias("burnt"))
    return cells.where("cov1 IS NOT NULL").withColumns({
        "area": cell_area_km2("y", width, height), "csoc": F.col("soc1") - F.col("soc0")})


def change_matrix(cells: DataFrame, units: DataFrame) -> DataFrame:
    """Cell count, mean soil-carbon change and area by former cover, cover, burn, unit and year."""
    return crop(cells, units).groupBy("municipality_code", "year", "cov0", "cov1", "burnt").agg(
        F.count(F.lit(1)).alias("npixel"), F.avg(nan_to_null("csoc")).alias("csoc_md"),
        strict_sum("area").alias("area"))


def attach_change(origins: DataFrame, change: DataFrame) -> DataFrame:
    """Origin-years of the flows with their change rows; origins without any are kept."""
    return attach(origins, change, ["municipality_code", "year"])


def clean_cover(rows: DataFrame) -> DataFrame:
    """Missing former cover counts as crop, missing burn as 2; only forest burns count."""
    cover = F.when(F.coalesce(F.col("cov0"), F.lit(0.0)) == 0, F.lit(float(K.CROP_CLASS))) \
        .otherwise(F.col("cov0")).cast("bigint")
    burnt = F.coalesce(F.col("burnt"), F.lit(2.0)).cast("int")
    rows = rows.withColumns({"map_biomas_class_code": cover, "burnt": burnt}).drop("cov0")
    counted = (F.col("burnt") == 1) & F.col("map_biomas_class_code").isin(K.BURNABLE_CLASSES)
    return rows.withColumn("burnt1", F.when(counted, F.lit(1)).otherwise(F.lit(0)))


COVER_KEYS = ["biome", "state_code", "municipality_code", "year", "map_biomas_class_code", "burnt",
              "burnt1"]


def roll_up_cover(rows: DataFrame) -> DataFrame:
    """Hectares and unweighted mean soil-carbon change per cover class and burn state."""
    return rows.groupBy(*COVER_KEYS).agg((strict_sum("area") * 100.0).alias("area_ha"),
                                         F.avg(nan_to_null("csoc_md")).alias("csoc_md"))


def label_land_demand(rows: DataFrame) -> DataFrame:
    used = F.col("map_biomas_class_code").isin(K.LAND_USE_CLASSES)
    return rows.withColumn("luclu", F.when(used, F.lit("LU")).otherwise(F.lit("LUC")))


SCALES = [["municipality_code", "year", "luclu"], ["municipality_code", "luclu"],
          ["state_code", "year", "luclu"], ["state_code", "luclu"]]


def scale_bounds(rows: DataFrame) -> DataFrame:
    """Median, least and largest soil-carbon change at four scales (columns …0 to …3)."""
    counted = stage(rows.groupBy("state_code", "municipality_code", "year", "luclu", "csoc_md")
                    .agg(F.count(F.lit(1)).alias("n")), "soil_changes")
    out = rows
    for i, keys in enumerate(SCALES):
        marks = group_quantiles(counted, keys, "csoc_md", {
            f"csoc_me{i}": 0.5, f"csoc_min{i}": 0.0, f"csoc_max{i}": 1.0}, weight="n")
        out = attach(out, stage(marks, "scale_bounds"), keys)
    return out


def choose_bounds(rows: DataFrame) -> DataFrame:
    """One set of bounds: state where the state-year has none; else the state-year where the unit
    has none; else the unit where the unit-year has none; else the unit-year."""
    def pick(name: str) -> Column:
        unit_year, unit, state_year, state = [F.col(f"{name}{i}") for i in range(4)]
        return F.when(state_year.isNull(), state).when(unit.isNull(), state_year) \
            .when(unit_year.isNull(), unit).otherwise(unit_year)

    names = ["csoc_me", "csoc_min", "csoc_max"]
    return rows.withColumns({n: pick(n) for n in names}).drop(
        *[f"{n}{i}" for n in names for i in range(4)])


def area_shares(rows: DataFrame) -> DataFrame:
    return share_of_total(rows, "area_ha", ["municipality_code", "year"], "p_area")


def split_amazon_forest(rows: DataFrame) -> DataFrame:
    """Planted forest of the Amazon gets a class of its own."""
    return rows.withColumn("map_biomas_class_code", F.when(
        (F.col("biome") == "AMAZONIA") & (F.col("map_biomas_class_code") == 9), F.lit(10))
        .otherwise(F.col("map_biomas_class_code")).cast("bigint"))


def recode_zones(zones: DataFrame) -> DataFrame:
    """Merge and split climate zones by biome."""
    code, biome = F.col("ipcc_code"), F.col("biome")
    # fixed values: zone codes and the biomes that split them
    inland = ["AMAZONIA", "CERRADO", "CAATINGA", "PANTANAL"]
    coastal = ["MATA ATLANTICA", "PAMPA"]
    recoded = (F.when(code.isin(201, 202), 2012)
               .when((code > 400) & (code < 408), 400)
               .when((code == 100) & (biome == "AMAZONIA"), 1001)
               .when((code == 100) & biome.isin("CERRADO", "CAATINGA", "MATA ATLANTICA"), 1002)
               .when((code == 100) & biome.isin("PANTANAL", "PAMPA"), 1003)
               .when((code == 105) & biome.isin(inland), 1051)
               .when((code == 105) & biome.isin(coastal), 1052)
               .when((code == 106) & biome.isin(inland), 1061)
               .when((code == 106) & biome.isin(coastal), 1062)
               .otherwise(code))
    return zones.withColumn("ipcc_code", recoded.cast("bigint"))


def zones_by_biome(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """Units with their biome and their known climate zones."""
    biomes = rows.select("biome", "municipality_code").distinct()
    known = zones.where(F.col("ipcc_code").isNotNull())
    return attach(biomes, known, ["municipality_code"]).where(F.col("biome").isNotNull())
