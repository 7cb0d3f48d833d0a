"""Impact assessment: unit impacts, the master matrix of stages, and product footprints."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.functions.nulls import as_col, match, ratio, row_total, strict_avg, strict_sum
from furrow.operators.inventory import Scope
from furrow.operators.logistics import CATEGORY, LINK_KEYS
from furrow.operators.relational import (attach, keep_matches, nest_samples, stack,
                                         unnest_samples, widen)
from furrow.sources.stages import stage

# --- characterisation ------------------------------------------------------------------------


def in_scope(factors: DataFrame, approach: str = K.IMPACT_APPROACH) -> DataFrame:
    return factors.where(F.col("approach") == approach)


def background_impacts(processes: DataFrame) -> DataFrame:
    """Impact per unit process; ecotoxicity volumes become a yearly fraction of the compartment."""
    # fixed values: ecotoxicity categories and the compartment each is spread over
    compartments = {"Ecotoxicity, terrestrial, average": K.GLOBAL_SOIL,
                    "Ecotoxicity, freshwater, average": K.GLOBAL_FRESHWATER,
                    "Ecotoxicity, marine, average": K.GLOBAL_SEAWATER}
    volume_days = match(F.col("impact_category"), {
        c: v * K.DAYS_PER_YEAR for c, v in compartments.items()}, F.lit(1.0))
    in_volume = F.col("unit_impact") == "PDF.m3.d"
    rows = in_scope(processes).withColumns({
        "damage": F.coalesce(F.col("damage"), F.col("impact_category")),
        "impact": F.when(in_volume, F.col("impact") / volume_days).otherwise(F.col("impact")),
        "unit_impact": F.when(in_volume, F.lit("PDF.year")).otherwise(F.col("unit_impact"))})
    return rows.groupBy("method", "unit_impact", "impact_category", "damage", "key_sim").agg(
        strict_sum("impact").alias("impact"))


def impact_catalogue(background: DataFrame) -> DataFrame:
    return background.select("method", "damage", "impact_category", "unit_impact").distinct()


# --- master matrix ---------------------------------------------------------------------------

MASTER_KEYS = ["region_code", "region_name", "state_code", "state_name", "municipality_code",
               "municipality_name", "export_port_name_mo1", "export_port_code1",
               "import_country_name", "import_port_code", "import_port_acronym",
               "economic_region", "import_country_code", "transport_type", "year", "dummy_uf_reg"]
MASTER_SUMS = ["soy_eq", "soybean", "bean_meal", "cake", "oil", "land_use", "fob"]
MASTER_MEANS = {"soy_yield": "soy_yield", "sh_bean": "sh_bean", "sh_meal": "sh_meal",
                "sh_cake": "sh_cake", "sh_oil": "sh_oil", "sh_dcp": "double_cropping_share",
                "dom_kmeal_af": "dom_kmeal_af", "dom_oil_af": "dom_oil_af",
                "for_kmeal_af": "for_kmeal_af", "for_oil_af": "for_oil_af"}
MASTER_MEASURES = [*MASTER_SUMS, *MASTER_MEANS]


def trade_links(flows: DataFrame, units: list[int] | None = None, years: list[int] | None = None
                ) -> DataFrame:
    """Flows summed to trade links, optionally of chosen units and years."""
    if units is not None:
        flows = flows.where(F.col("municipality_code").isin(units))
    if years is not None:
        flows = flows.where(F.col("year").isin(years))
    return flows.groupBy(*MASTER_KEYS).agg(
        *[strict_sum(c).alias(c) for c in MASTER_SUMS],
        *[strict_avg(c).alias(out) for out, c in MASTER_MEANS.items()])


def category_matrix(links: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every trade link with the impact categories as one array; `master_matrix` makes a row of each.

    The catalogue is a vocabulary, so it is a constant of the plan. Until the last step a link is one
    row, whatever is attached to it: links are joined and shuffled, not links times categories.
    """
    kind = F.array(F.struct(*[F.lit(None).cast("string").alias(c) for c in CATEGORY]))
    rows = [F.struct(*[F.lit(row[c]).cast("string").alias(c) for c in CATEGORY])
            for row in catalogue.orderBy(*CATEGORY).collect()]
    return links.withColumn("categories", F.array(*rows) if rows else F.slice(kind, 1, 0))


TRANSPORT = "transport"
# nested arrays of the category matrix and the stages that each holds
NESTED = {"stress_samples": K.LAND_STAGES[:2], "carbon_samples": K.LAND_STAGES[2:],
          "farm_samples": K.FARM_STAGES, "process_samples": list(K.PROCESS_STAGES.values()),
          "power_samples": list(K.ELECTRICITY_STAGES.values()),
          "burn_samples": ["i_p_fuel_combustion_of"]}


def attach_sampled(matrix: DataFrame, table: DataFrame, keys: list[str], name: str, n: int
                   ) -> DataFrame:
    """Stage impacts of all samples as one array per key, joined before the matrix multiplies. What is
    keyed by category too comes as a list of categories with their arrays for the rest of the key."""
    nested = nest_samples(table, keys, NESTED[name], n, name)
    own, categories = [k for k in keys if k not in CATEGORY], [k for k in keys if k in CATEGORY]
    return _attach_listed(matrix, nested, own, F.struct(*categories, name), name)


def _attach_listed(matrix: DataFrame, table: DataFrame, own: list[str], entry: Column, name: str) -> DataFrame:
    """The entries of each key as one list per link; without a key, all of them (one row) to every link."""
    listed = stage(table.groupBy(*own).agg(F.collect_list(entry).alias(name)), name)
    return attach(matrix, listed, own) if own else matrix.crossJoin(listed)


def master_matrix(matrix: DataFrame, n: int) -> DataFrame:
    """A row per trade link, category and sample, the last step: every stage has been attached before
    as a list by category, with or without samples, so the multiplied rows are never joined."""
    rows = matrix.withColumn("__category", F.explode("categories")).drop("categories")
    rows = rows.withColumns({c: F.col("__category")[c] for c in CATEGORY}).drop("__category")
    types, nested = {f.name: f.dataType for f in matrix.schema}, {}

    def of_category(name: str) -> Column:
        keys = [k for k in types[name].elementType.fieldNames() if k in CATEGORY]
        same = lambda e: reduce(lambda a, b: a & b, [e[k].eqNullSafe(F.col(k)) for k in keys])
        return F.filter(F.col(name), same)

    if TRANSPORT in types:
        rows = rows.withColumn(TRANSPORT, F.explode_outer(of_category(TRANSPORT)))
        rows = rows.withColumns({c: F.col(TRANSPORT)[c] for c in K.TRANSPORT_STAGES}).drop(TRANSPORT)
    for name, stages in NESTED.items():
        if name in types:
            nested[name] = stages
            rows = rows.withColumn(name, F.get(of_category(name), F.lit(0))[name])
    return unnest_samples(rows, nested, n)


def attach_land_stress(matrix: DataFrame, stress: DataFrame, n: int) -> DataFrame:
    """Occupation and transformation factors of all samples, on the land-stress category only."""
    keys = ["region_name", "state_code", "municipality_code", "year"]
    table = stress.select("Id_sample", *keys, F.lit(K.LAND_DAMAGE).alias("damage"),
                          F.lit(K.LAND_CATEGORY).alias("impact_category"),
                          F.col("cf_occ_glo").alias("i_land_occupation"),
                          F.col("cf_tra_glo_dc").alias("i_land_transformation"))
    return attach_sampled(matrix, table, [*keys, "damage", "impact_category"], "stress_samples", n)


CARBON_KEYS = ["municipality_code", "year", "damage", "impact_category", "unit_impact"]


def carbon_stock_impacts(emissions: DataFrame, factors: DataFrame) -> DataFrame:
    """Impact of soil and above-ground carbon changes per sample, unit, year and category."""
    keys = ["Id_sample", *CARBON_KEYS]
    rows = keep_matches(emissions, in_scope(factors), ["substance_ac"])
    sums = rows.groupBy(*keys, "subc1").agg(
        strict_sum(F.col("value_emission") * F.col("value")).alias("imp"))
    return widen(sums, keys, "subc1", {"ibmb": "i_luclu_above_biomass", "iSOC": "i_luclu_soc"},
                 "imp", False)


def attach_carbon(matrix: DataFrame, carbon: DataFrame, n: int) -> DataFrame:
    """Carbon-stock impacts of all samples."""
    return attach_sampled(matrix, carbon, CARBON_KEYS, "carbon_samples", n)


def attach_transport(matrix: DataFrame, transport: DataFrame) -> DataFrame:
    """Transport impacts of a link's categories, as one list per link."""
    return _attach_listed(matrix, transport, LINK_KEYS, F.struct(*CATEGORY, *K.TRANSPORT_STAGES), TRANSPORT)


# --- farming and processing ------------------------------------------------------------------

def farm_background_impacts(rows: DataFrame, background: DataFrame, scope: Scope) -> DataFrame:
    """Upstream impact of farm inputs. Equal flows of a sample add up before they meet the
    category rows, which multiply them."""
    ids = ["Id_sample", scope.parts[0], "type_activity_data2"]
    sums = rows.groupBy(*ids, "key_sim").agg(strict_sum("recommended_value").alias("amount"))
    joined = keep_matches(sums, background, ["key_sim"])
    return joined.groupBy(*ids, *CATEGORY).agg(
        strict_sum(F.col("impact") * F.col("amount")).alias("i_frm")).where("i_frm IS NOT NULL")


def farm_field_impacts(emissions: DataFrame, factors: DataFrame, scope: Scope) -> DataFrame:
    """Impact of what fields emit."""
    ids = ["Id_sample", scope.parts[0], "type_activity_data2"]
    rows = keep_matches(emissions, in_scope(factors), ["substance_ac"])
    return rows.groupBy(*ids, *CATEGORY).agg(
        strict_sum(F.col("value_emission") * F.col("value")).alias("i_frm")) \
        .where("i_frm IS NOT NULL")


def farm_stages(background: DataFrame, field: DataFrame, scope: Scope) -> DataFrame:
    """Farm impacts as one column per activity and kind, missing ones zero."""
    def named(df: DataFrame, kind: str) -> DataFrame:
        table = {a: f"i_f_{name}_{kind}" for a, name in K.FARM_ACTIVITIES.items()}
        return df.withColumn("stage", match(F.col("type_activity_data2"), table))

    rows = stack([named(background, "pd"), named(field, "of")])
    ids = ["Id_sample", scope.parts[0], *CATEGORY]
    wide = widen(rows, ids, "stage", {s: s for s in K.FARM_STAGES}, "i_frm")
    return wide.fillna(0, subset=K.FARM_STAGES)


def attach_farming(matrix: DataFrame, state: DataFrame, region: DataFrame, n: int) -> DataFrame:
    """State impacts where the state has data, regional ones elsewhere, chosen row by row.

    Both tables carry a place key of their own kind, so one join serves both.
    """
    table = stack([
        state.withColumn("__place", F.concat(F.lit("uf-"), F.col("state_code").cast("string")))
        .drop("state_code"),
        region.withColumn("__place", F.concat(F.lit("reg-"), F.col("region_name")))
        .drop("region_name")])
    place = F.when(F.col("dummy_uf_reg") == "uf",
                   F.concat(F.lit("uf-"), F.col("state_code").cast("string"))) \
        .when(F.col("dummy_uf_reg") == "reg", F.concat(F.lit("reg-"), F.col("region_name")))
    keyed = matrix.withColumn("__place", place)
    return attach_sampled(keyed, table, ["__place", *CATEGORY], "farm_samples", n).drop("__place")


def processing_background_impacts(rows: DataFrame, background: DataFrame) -> DataFrame:
    """Upstream impact of processing inputs other than electricity, one column per input."""
    inputs = rows.where(F.col("key_sim") != "Electricity").groupBy(
        "Id_sample", "key_sim", "key_spread").agg(strict_sum("recommended_value").alias("amount"))
    joined = keep_matches(inputs, background, ["key_sim"]).withColumns({
        "stage": match(F.col("key_spread"), K.PROCESS_STAGES),
        "impact": F.col("impact") * F.col("amount")})
    names = list(K.PROCESS_STAGES.values())
    wide = widen(joined, ["Id_sample", *CATEGORY], "stage", {s: s for s in names}, "impact")
    return wide.fillna(0, subset=names)


def electricity_impacts(rows: DataFrame, background: DataFrame) -> DataFrame:
    """Impact of processing electricity by region, from the grid mixes selected by name."""
    suffix = F.regexp_replace(F.col("key_sim"), f"(?i)^.*{K.GRID_MIX}_BR_", "")
    mixes = background.where(F.col("key_sim").rlike(f"(?i){K.GRID_MIX}")).withColumn(
        "region_name", F.when(suffix.isin(K.REGIONS[:-1]), suffix).otherwise(F.lit(K.REGIONS[-1])))
    mixes = mixes.groupBy("region_name", *CATEGORY).agg(strict_sum("impact").alias("impact"))
    used = rows.where(F.col("key_sim") == "Electricity").groupBy("Id_sample", "key_spread").agg(
        strict_sum("recommended_value").alias("amount"))
    regions = F.explode(F.array(*[F.lit(r) for r in K.REGIONS]))
    joined = keep_matches(used.withColumn("region_name", regions), mixes, ["region_name"])
    joined = joined.withColumn("impact", F.col("impact") * F.col("amount"))
    return widen(joined, ["Id_sample", "region_name", *CATEGORY], "key_spread",
                 K.ELECTRICITY_STAGES, "impact")


def combustion_impacts(emissions: DataFrame, factors: DataFrame) -> DataFrame:
    rows = keep_matches(emissions, in_scope(factors), ["substance_ac"])
    return rows.groupBy("Id_sample", *CATEGORY).agg(
        strict_sum(F.col("value_emission") * F.col("value")).alias("i_p_fuel_combustion_of")) \
        .where("i_p_fuel_combustion_of IS NOT NULL")


def attach_processing(matrix: DataFrame, processing: DataFrame, electricity: DataFrame,
                      combustion: DataFrame, n: int) -> DataFrame:
    """Processing stages of all samples, by category and, for electricity, region."""
    out = attach_sampled(matrix, processing, CATEGORY, "process_samples", n)
    out = attach_sampled(out, electricity, [*CATEGORY, "region_name"], "power_samples", n)
    return attach_sampled(out, combustion, CATEGORY, "burn_samples", n)


def complete_master(master: DataFrame) -> DataFrame:
    """All stages in a stated order, missing values as zero."""
    return master.fillna(0).select("Id_sample", *MASTER_KEYS, *MASTER_MEASURES, *CATEGORY,
                                   *K.ALL_STAGES)


# --- products --------------------------------------------------------------------------------

def align_units(master: DataFrame) -> DataFrame:
    """Everything per tonne: kg stages × 1000, season correction, land stages by land per volume."""
    once = {"i_f_Amendment_of", "i_f_Amendment_pd", "i_luclu_above_biomass", "i_luclu_soc"}
    per_kg = set(K.FARM_STAGES + K.PROC_STAGES + K.MEAL_STAGES)

    def aligned(c: str) -> Column:
        x = as_col(c)
        if c in per_kg:
            x = x * K.KG_PER_T
        if c in once:
            x = x - x * F.col("sh_dcp") * K.SEASON_FRACTION
        return ratio(x * F.col("land_use"), "soy_eq") if c in K.LAND_STAGES else x

    return master.withColumns({c: aligned(c) for c in K.ALL_STAGES})


@dataclass(frozen=True)
class Product:
    """Traded product: its volume, the stages it carries and its share of crushing."""
    volume: str
    stages: tuple[str, ...]
    allocation: tuple[str, str, float] | None = None


_FIELD = (*K.LAND_STAGES, *K.FARM_STAGES)
BEANS = Product("soybean", (*_FIELD, *K.TRANSPORT_STAGES))
MEAL = Product("bean_meal", (*_FIELD, *K.MEAL_STAGES, *K.TRANSPORT_STAGES))
CAKE = Product("cake", (*_FIELD, *K.PROC_STAGES, *K.TRANSPORT_STAGES),
               ("dom_kmeal_af", "for_kmeal_af", K.MEAL_MASS))
OIL = Product("oil", (*_FIELD, *K.PROC_STAGES, *K.TRANSPORT_STAGES),
              ("dom_oil_af", "for_oil_af", K.OIL_MASS))
IDENTITY = ["Id_sample", *MASTER_KEYS, *CATEGORY]


def _footprint(rows: DataFrame, volume: str, values: dict[str, Column]) -> DataFrame:
    """Stage columns, their total and the total per tonne; zero volumes are left out."""
    traded = rows.where(as_col(volume) != 0)
    staged = traded.select(*IDENTITY, "land_use", as_col(volume),
                           *[v.alias(c) for c, v in values.items()])
    return staged.withColumn("impact", row_total(values)).withColumn(
        "impact_ton", F.col("impact") / as_col(volume))


def product_footprint(aligned: DataFrame, product: Product) -> DataFrame:
    """Footprint of one traded product from the aligned master matrix."""
    weight = as_col(product.volume)
    if product.allocation:
        home, abroad, mass = product.allocation
        factor = F.when(F.col("import_country_name") == K.DOMESTIC_COUNTRY, as_col(home)) \
            .otherwise(as_col(abroad))
        return _footprint(aligned, product.volume, {
            c: factor * as_col(c) / mass * weight for c in product.stages})
    return _footprint(aligned, product.volume, {c: as_col(c) * weight for c in product.stages})


def equivalent_footprint(aligned: DataFrame) -> DataFrame:
    """Footprint of the whole bean-equivalent volume; processing counts for its crushed shares and
    the meal variants fold into the processing stages they belong to."""
    folded = {"i_p_electricity_pd": "i_p_electricity_m_pd", "i_p_Tapwater_pd": "i_p_Tapwater_m_pd",
              "i_p_Naturalgas_pd": "i_p_Naturalgas_m_pd"}
    crushed = F.col("sh_cake") + F.col("sh_oil")

    def value(c: str) -> Column:
        x = as_col(c)
        if c in K.PROC_STAGES:
            x = x * crushed
        if c in folded:
            x = x + as_col(folded[c]) * F.col("sh_meal")
        return x * F.col("soy_eq")

    stages = [*_FIELD, *K.PROC_STAGES, *K.TRANSPORT_STAGES]
    return _footprint(aligned, "soy_eq", {c: value(c) for c in stages})
