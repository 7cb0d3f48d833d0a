"""Emissions from changes of natural carbon stocks, per origin, year and sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.functions.draws import high_from_sd, low_from_sd
from furrow.functions.nulls import as_col, ratio, strict_avg, strict_sum, zero_fill
from furrow.operators.grid import COVER_KEYS
from furrow.operators.relational import (attach, keep_matches, lengthen, nest_samples, rows_with_nulls,
                                         share_of_total, spread, unnest_samples)
from furrow.operators.sampling import triangular_draws
from furrow.sources.stages import stage

GASES = ["CO2", "CO", "CH4", "N2O", "NOx"]
EMISSIONS = ["CO2e_soc", "CO2e_bmb", "CH4e", "N2Oe", "NOxe"]
PARAMETER_KEY = ["map_biomas_class_code", "ipcc_code"]
DRAWS = ["soc_change", "biomass", "litter", "dead_matter", *[f"gas_{g}" for g in GASES],
         "combustion"]


def parameter_bounds(parameters: DataFrame, rule: str = "ratio") -> DataFrame:
    """Carbon parameters with null as zero and one (low, mode, high) per drawn variable."""
    measures = [c for c, t in parameters.dtypes if t == "double"]
    clean = zero_fill(parameters, measures)
    pools = {"biomass": ("agbm_ll", "agbm_value", "agbm_ul"),
             "litter": ("Litter_min", "Litter_value", "Litter_max"),
             "dead_matter": ("DOM_min", "DOM_value", "DOM_max")}
    spreads = {f"gas_{g}": (f"Gef_{g}", f"sd_{g}") for g in GASES} | {
        "combustion": ("Cf_value", "Cf_sd")}
    bounds: dict[str, Column] = {}
    for name, (low, mode, high) in pools.items():
        bounds |= {f"{name}_low": F.col(low), f"{name}_mode": F.col(mode),
                   f"{name}_high": F.col(high)}
    for name, (value, sd) in spreads.items():
        bounds |= {f"{name}_low": low_from_sd(value, sd, rule), f"{name}_mode": F.col(value),
                   f"{name}_high": high_from_sd(value, sd)}
    return clean.select("type_land_area", "map_biomas_class", *PARAMETER_KEY,
                        *[c.alias(n) for n, c in bounds.items()])


def match_zones(zones: DataFrame, cover: DataFrame, parameters: DataFrame) -> DataFrame:
    """Every zone of a unit with the cover rows and carbon parameters that apply in it.

    Zones without a match stay. A missing zone area counts 0 for forest and 1 elsewhere.
    """
    typed = keep_matches(cover, parameters, ["map_biomas_class_code"])
    rows = attach(zones, typed, ["biome", "municipality_code", "ipcc_code"])
    default = F.when(F.col("map_biomas_class_code").isNull(), F.lit(None).cast("double")) \
        .when(F.col("map_biomas_class_code") == 3, F.lit(0.0)).otherwise(F.lit(1.0))
    return rows.withColumn("area_eco_zone", F.coalesce(F.col("area_eco_zone"), default))


WEIGHT_GROUP = ["municipality_code", "year", "map_biomas_class_code", "burnt"]


def weigh_zones(rows: DataFrame) -> DataFrame:
    """Zone area as a share of its unit, year, cover and burn state."""
    return share_of_total(rows, "area_eco_zone", WEIGHT_GROUP, "p_area_bm")


CARRIED = ["municipality_code", "year", "map_biomas_class_code", "map_biomas_class", "luclu",
           "burnt", "burnt1", "area_ha", "p_area_bm", "ipcc_code"]


def draw_stocks(rows: DataFrame, n: int) -> DataFrame:
    """Sampled soil-carbon change and carbon parameters per row; invalid draws count as zero.

    The rows are joined and placed by unit and year before they multiply, and the draws are
    functions of (key, sample): neither samples nor the groupings after them shuffle anything. A
    unit-year has at most one row per cover class, burn state and zone.
    """
    variables = {"soc_change": ("csoc_min", "csoc_me", "csoc_max")} | {
        v: (f"{v}_low", f"{v}_mode", f"{v}_high") for v in DRAWS[1:]}
    keys = {v: PARAMETER_KEY for v in DRAWS[1:]} | {"soc_change": COVER_KEYS}
    placed = spread(rows, ["municipality_code", "year"], n)
    drawn = triangular_draws(placed, variables, keys, n, keep=CARRIED)
    per_mille = [v for v in DRAWS if v.startswith("gas_") or v == "combustion"]
    scaled = drawn.withColumns({v: as_col(v) / 1000.0 for v in per_mille})
    return zero_fill(scaled, [*DRAWS, "area_ha", "p_area_bm"])


def stock_emissions(rows: DataFrame) -> DataFrame:
    """Emission formulas of soil, biomass decay or burning, and the non-CO2 gases of fires."""
    change = F.col("luclu") == "LUC"
    cleared = F.when(change, F.lit(K.CLEARED_DRY_MATTER)).otherwise(F.lit(0.0))
    area = F.col("area_ha") * F.col("p_area_bm")
    fuel = F.col("biomass") + F.col("litter") + F.col("dead_matter") - cleared
    carbon = (F.col("biomass") * K.CARBON_BIOMASS + F.col("litter") * K.CARBON_LITTER
              + F.col("dead_matter") * K.CARBON_DEAD_MATTER - cleared * K.CARBON_BIOMASS)
    decayed = carbon * K.CO2_PER_C * K.KG_PER_T
    unburnt = F.col("burnt1") == 0

    def fire(gas: str) -> Column:
        return fuel * F.col("combustion") * F.col(f"gas_{gas}")

    def floored(gas: str) -> Column:
        return F.when(unburnt | (fuel < 0), F.lit(0.0)).otherwise(fire(gas)) * area

    soil = F.when(F.col("luclu") == "LU", F.col("soc_change") / 3).otherwise(F.col("soc_change"))
    return rows.withColumns({
        "CO2e_soc": soil * K.KG_PER_T,
        "CO2e_bmb": F.when(unburnt, decayed).otherwise(fire("CO2")) * area,
        "COe": floored("CO"), "CH4e": floored("CH4"), "N2Oe": floored("N2O"),
        "NOxe": floored("NOx")})


CLASS_KEYS = ["Id_sample", "municipality_code", "year", "map_biomas_class_code", "luclu",
              "map_biomas_class", "burnt", "burnt1", "area_ha"]
DEMAND_KEYS = ["Id_sample", "municipality_code", "year", "luclu", "burnt1"]


def roll_up_zones(emissions: DataFrame) -> DataFrame:
    """Zones of a cover class together: mean for soil, sums for the rest."""
    return emissions.groupBy(*CLASS_KEYS).agg(
        strict_avg("CO2e_soc").alias("CO2e_soc"),
        *[strict_sum(e).alias(e) for e in EMISSIONS[1:]])


def roll_up_classes(by_class: DataFrame) -> DataFrame:
    """Cover classes together; soil is the area-weighted mean, which needs one aggregation."""
    weighted = ratio(strict_sum(F.col("CO2e_soc") * F.col("area_ha")), strict_sum("area_ha"))
    return by_class.groupBy(*DEMAND_KEYS).agg(
        strict_sum("area_ha").alias("area_ha"), weighted.alias("CO2e_soc"),
        *[strict_sum(e).alias(e) for e in EMISSIONS[1:]])


def emissions_per_hectare(by_demand: DataFrame) -> DataFrame:
    """Totals per sample, unit and year, then every emission per hectare."""
    totals = by_demand.groupBy("Id_sample", "municipality_code", "year").agg(
        strict_sum("area_ha").alias("area_ha"),
        strict_sum(F.col("CO2e_soc") * F.col("area_ha")).alias("CO2e_soc"),
        *[strict_sum(e).alias(e) for e in EMISSIONS[1:]])
    return totals.withColumns({e: ratio(e, "area_ha") for e in EMISSIONS})


ORIGIN_KEYS = ["region_code", "region_name", "state_code", "state_name", "municipality_code",
               "municipality_name", "year"]


def origin_totals(flows: DataFrame) -> DataFrame:
    return flows.groupBy(*ORIGIN_KEYS).agg(strict_sum("soy_eq").alias("soy_eq"),
                                           strict_sum("land_use").alias("land_use"))


MEASURED = ["area_ha", *EMISSIONS]


def nested_emissions(flows: DataFrame, emissions: DataFrame, n: int) -> DataFrame:
    """Origin-years of the flows, summed, with the emissions of all their samples as one array."""
    held = nest_samples(emissions, ["municipality_code", "year"], MEASURED, n, "held")
    return attach(origin_totals(flows), stage(held, "emission_samples"), ["municipality_code", "year"])


def attach_emissions(flows: DataFrame, emissions: DataFrame, n: int) -> DataFrame:
    """Origin-years of the flows, once per sample with their emissions; they multiply last."""
    return unnest_samples(nested_emissions(flows, emissions, n), {"held": MEASURED}, n)


CARBON_TIERS = [["Id_sample", "municipality_code"], ["Id_sample", "state_code", "year"],
                ["Id_sample", "state_code"], ["Id_sample", "region_code", "year"]]


def filled_emissions(flows: DataFrame, emissions: DataFrame, n: int) -> DataFrame:
    """Origin-years once per sample, missing emissions filled by tier means within the sample.

    A tier's means are arrays of n samples per key of the tier. Rows carry their own array and those
    of the tiers; they multiply where means are summed, which combines on the map side, and in the
    last step, above which nothing is joined or shuffled.
    """
    rows = stage(nested_emissions(flows, emissions, n), "origin_emissions")
    nested = {"held": MEASURED}

    def sources(c: str) -> list[Column]:
        names = [c, *(f"{tier}_{c}" for tier in list(nested)[1:])]
        return [F.nanvl(as_col(x), F.lit(None).cast("double")) for x in names]

    for depth, tier in enumerate(CARBON_TIERS):
        known = unnest_samples(rows, nested, n)
        means = known.groupBy(*tier).agg(*[
            F.avg(F.coalesce(*sources(c))).alias(f"tier{depth}_{c}") for c in MEASURED])
        keys = [k for k in tier if k != "Id_sample"]
        values = [f"tier{depth}_{c}" for c in MEASURED]
        rows = attach(rows, stage(nest_samples(means, keys, values, n, f"tier{depth}"), "tier_means"), keys)
        nested[f"tier{depth}"] = values
    out = unnest_samples(rows, nested, n)
    reached = reduce(lambda later, i: F.when(sources("area_ha")[i].isNotNull(), F.lit(K.CARBON_LABELS[min(
        i, len(K.CARBON_LABELS) - 1)])).otherwise(later), reversed(range(len(nested))), F.lit(K.CARBON_LABELS[-1]))
    filled = {c: F.coalesce(*sources(c)) for c in MEASURED}
    return out.withColumns(filled | {"data_quality_luc_emissions": reached}).drop(
        *[v for values in list(nested.values())[1:] for v in values])


def missing_emissions(rows: DataFrame) -> DataFrame:
    return rows_with_nulls(rows, ["area_ha"])


def emissions_by_substance(rows: DataFrame) -> DataFrame:
    """Long form with the substance and carbon pool each emission is assessed as."""
    ids = [c for c in rows.columns if c not in EMISSIONS]
    long = lengthen(rows, ids, EMISSIONS, "emission", "value_emission")
    table = rows.sparkSession.createDataFrame(
        K.EMISSION_SUBSTANCES, "emission string, substance_ac string, subc1 string")
    return attach(long, table, ["emission"])
