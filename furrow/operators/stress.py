"""Direct land stress: occupied and transformed land, intensity and characterisation factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.functions.nulls import ratio, strict_avg, strict_sum
from furrow.functions.quantiles import group_quantiles
from furrow.operators.relational import (attach, fill_by_tier_means, keep_matches, rows_with_nulls,
                                         share_of_total, spread, widen)
from furrow.operators.sampling import triangular_draws
from furrow.sources.stages import stage

UNIT_YEAR = ["region_name", "state_code", "municipality_code", "year", "double_cropping_share",
             "soy_yield"]


def ecoregion_shares(overlaps: DataFrame) -> DataFrame:
    """Share of each unit's area that lies in each ecoregion."""
    rows = overlaps.select(
        F.expr("try_cast(CD_MUN AS BIGINT)").alias("municipality_code"),
        F.col("REALM").alias("realm"), F.col("ECO_ID").alias("eco_id"), "eco_code",
        "inter_km2").distinct()
    return share_of_total(rows, "inter_km2", ["municipality_code"], "pt_int_amun")


def land_by_class(flows: DataFrame, cover: DataFrame, parameters: DataFrame) -> DataFrame:
    """Unit-years of the flows with their area per cover class and the class's land type."""
    units = flows.select(*UNIT_YEAR).distinct()
    areas = cover.groupBy("state_code", "municipality_code", "year", "map_biomas_class_code").agg(
        strict_sum("area_ha").alias("area_lup"))
    classes = parameters.select("type_land_area", "map_biomas_class",
                                "map_biomas_class_code").distinct()
    rows = attach(units, areas, ["state_code", "municipality_code", "year"])
    return attach(rows, classes, ["map_biomas_class_code"])


def split_land(rows: DataFrame) -> DataFrame:
    """Occupied and transformed area per unit-year; one of the two being known makes the other 0."""
    forest = F.col("type_land_area") == K.FOREST_AREA_TYPE
    kind = F.when(forest, F.lit("trans")).when(~forest, F.lit("occ"))
    sums = rows.withColumn("id_land", kind).groupBy(*UNIT_YEAR, "id_land").agg(
        strict_sum("area_lup").alias("area"))
    wide = widen(sums, UNIT_YEAR, "id_land", {"occ": "occ", "trans": "trans"}, "area", False)
    known = F.col("occ").isNotNull() | F.col("trans").isNotNull()
    return wide.withColumns({c: F.when(known, F.coalesce(F.col(c), F.lit(0.0)))
                             for c in ["occ", "trans"]})


LAND_TIERS = [["municipality_code"], ["state_code", "year"], ["state_code"],
              ["region_name", "year"]]


def fill_land(rows: DataFrame) -> DataFrame:
    return fill_by_tier_means(rows, ["occ", "trans"], LAND_TIERS, "tdata_lcrop", K.LAND_LABELS)


def missing_land(rows: DataFrame) -> DataFrame:
    return rows_with_nulls(rows, ["occ"])


def classify_intensity(rows: DataFrame) -> DataFrame:
    """Habitat 4 below the first yield quartile, 2 below the third, 3 above; over all rows."""
    marks = stage(group_quantiles(rows, [], "soy_yield", {"q1": 0.25, "q3": 0.75}), "quartiles")
    first, third = marks.select("q1").scalar(), marks.select("q3").scalar()
    level = F.when(F.col("soy_yield") < first, 4).when(F.col("soy_yield") < third, 2) \
        .when(F.col("soy_yield").isNotNull(), 3)
    return rows.withColumn("habitat_id", level)


CF_KEYS = ["realm", "biome", "eco_id", "eco_name", "habitat_id", "habitat"]


def summarise_land_factors(factors: DataFrame) -> DataFrame:
    """Mean and range of the occupation and transformation factors per ecoregion and habitat."""
    kept = factors.where(F.col("habitat_id").isin(K.HABITAT_IDS))

    def strict(fn, c):
        return F.when(F.count(F.lit(1)) == F.count(c), fn(c))

    aggregates = []
    for short, c in [("occ", "cf_occ_avg_glo"), ("tra", "cf_tra_avg_glo")]:
        aggregates += [strict_avg(c).alias(f"cf_{short}_glo_md"),
                       strict(F.min, c).alias(f"cf_{short}_glo_min"),
                       strict(F.max, c).alias(f"cf_{short}_glo_max")]
    return kept.groupBy(*CF_KEYS).agg(*aggregates)


FACTOR_BOUNDS = {f"cf_{s}_glo": (f"cf_{s}_glo_min", f"cf_{s}_glo_md", f"cf_{s}_glo_max")
                 for s in ["occ", "tra"]}


def draw_land_factors(summary: DataFrame, n: int) -> DataFrame:
    """Factor draws in which all ecoregions and habitats share each sample's random number."""
    return triangular_draws(summary, FACTOR_BOUNDS, [], n, ["eco_id", "habitat_id", "habitat"],
                            shared=True)


STRESS_KEYS = ["region_name", "state_code", "municipality_code", "year", "occ", "trans",
               "double_cropping_share"]


def stress_factors(land: DataFrame, shares: DataFrame, summary: DataFrame, n: int) -> DataFrame:
    """Ecoregion-weighted factors per unit-year and sample, scaled to the observed land split.

    Ranges are joined and placed by unit and year first and drawn afterwards: no table of draws is
    joined and the sums over ecoregions shuffle no samples.
    """
    rows = keep_matches(attach(land, shares, ["municipality_code"]),
                        summary.drop("realm"), ["eco_id", "habitat_id"])
    placed = spread(rows, ["municipality_code", "year"], n)
    drawn = triangular_draws(placed, FACTOR_BOUNDS, [], n, [*STRESS_KEYS, "pt_int_amun"],
                             shared=True)
    sums = drawn.groupBy("Id_sample", *STRESS_KEYS).agg(
        strict_sum(F.col("cf_occ_glo") * F.col("pt_int_amun") * K.SEASON_FRACTION)
        .alias("cf_occ_glo"),
        strict_sum(F.col("cf_tra_glo") * F.col("pt_int_amun")).alias("cf_tra_glo"))
    whole = F.col("occ") + F.col("trans")
    return sums.withColumns({
        "cf_occ_glo": F.col("cf_occ_glo") * ratio("occ", whole) * 10000.0,
        "cf_tra_glo": F.col("cf_tra_glo") * ratio("trans", whole) * 10000.0})


def adjust_double_cropping(rows: DataFrame) -> DataFrame:
    """Transformation factor with the double-cropped part counted for one season only."""
    share, factor = F.col("double_cropping_share"), F.col("cf_tra_glo")
    return rows.withColumn("cf_tra_glo_dc",
                           factor * share * K.SEASON_FRACTION + factor * (F.lit(1.0) - share))
