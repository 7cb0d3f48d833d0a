"""Life-cycle inventories of farming and processing, and the emissions they cause on site."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.functions.draws import noise, stream, triangular, uniform
from furrow.functions.nulls import as_col, strict_sum, zero_fill
from furrow.operators.relational import (attach, expand_samples, join_key, lengthen, stack)
from furrow.operators.sampling import bounds_from_sd, factor_draws, number_sources
from furrow.sources.stages import stage


@dataclass(frozen=True)
class Scope:
    """Where an inventory is representative and which evidence tiers it uses."""
    name: str
    keys: tuple[str, ...]
    parts: tuple[str, ...]
    kept: tuple[int, ...]
    drawn: tuple[int, ...]
    substances: tuple[str, ...]


STATE = Scope("state", ("state_code", "type_activity_data3"),
              ("state_code", "type_activity_data2", "activity_data1"), (1, 2, 3, 4), (3, 4),
              tuple(s for s in K.FIELD_SUBSTANCES if s != "SO2"))
REGION = Scope("region", ("region_name", "type_activity_data3"),
               ("region_name", "type_activity_data2", "activity_data1"), (2, 4), (4,),
               tuple(K.FIELD_SUBSTANCES))
NATIONAL = Scope("national", ("type_activity_data2",), ("type_activity_data2", "activity_data1"),
                 (1, 2, 3, 4), (4,), tuple(K.COMBUSTION_SUBSTANCES))

MEASURES = ["recommended_value", "lower_limit", "upper_limit", "sd"]


def aggregate_inventory(inventory: DataFrame, scope: Scope) -> DataFrame:
    """Values and limits summed per scope, activity, flow and study; absent limits become null."""
    farming = F.col("stage") == "Farming"
    member = {"state": farming & F.col("state_code").isNotNull(), "region": farming,
              "national": F.col("type_activity_data2") == "crushing"}[scope.name]
    sums = inventory.where(member).groupBy(*scope.keys, "key_sim", "lca").agg(
        *[F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in MEASURES])
    return sums.withColumns({m: F.nullif(F.col(m), F.lit(0.0)) for m in MEASURES[1:]})


def identify(rows: DataFrame, scope: Scope) -> DataFrame:
    """Composite ids, the number `n` of studies per id and each study's place among them.

    The ids are for output; the texts they are made of stay beside them, so no name is ever
    parsed back out of an id.
    """
    texts = [F.coalesce(as_col(k).cast("string"), F.lit("NA")).alias(p)
             for k, p in zip([*scope.keys, "key_sim"], scope.parts)]
    rows = rows.withColumns({"id_sim": join_key("id_sim", [*scope.keys, "key_sim"]),
                             "id_sim1": join_key("id_sim1", scope.keys), CARRIED: F.struct(*texts)})
    studies = stage(number_sources(rows, ["id_sim1"], "lca"), "studies")
    return attach(rows, studies, ["id_sim1", "lca"])


def evidence_tier(rows: DataFrame) -> DataFrame:
    """4 or 3 with known uncertainty, 2 or 1 without; the even tiers have several studies."""
    known = F.col("lower_limit").isNotNull() | F.col("sd").isNotNull()
    several = F.col("n") > 1
    tier = F.when(known & several, 4).when(known, 3).when(several, 2).otherwise(1)
    return rows.withColumn("titem", tier)


def prepare(inventory: DataFrame, scope: Scope) -> DataFrame:
    """Aggregated, identified and tiered inventory rows."""
    return evidence_tier(identify(aggregate_inventory(inventory, scope), scope))


def sample_studies(rows: DataFrame, n: int) -> DataFrame:
    """Inventory rows of the study that each sample picks for their id.

    A row knows its study's place, so it decides alone whether a sample picks it; an id with one
    study is picked by every sample.
    """
    fixed = rows.withColumn("__pick", stream("source", "id_sim1"))
    many = expand_samples(fixed, n)
    place = F.floor(uniform("__pick", noise("Id_sample")) * F.col("n")) + 1
    return many.where(place == F.col("__place")).drop("__pick")


OUT = ["Id_sample", "id_sim1", "id_sim", "lca", "key_sim", "n", "titem", "recommended_value"]
#: What a composite id is made of, carried beside it.
CARRIED = "__parts"


def assemble(rows: DataFrame, scope: Scope, n: int, rule: str = "ratio") -> DataFrame:
    """One value per sampled flow: drawn within its limits for the drawn tiers, else the point."""
    kept = rows.where(F.col("titem").isin(list(scope.kept)))
    bounded = bounds_from_sd(kept, "recommended_value", "sd", "lower_limit", "upper_limit", rule,
                             10000.0 if rule == "ratio" else 1.0)
    bounded = bounded.withColumn("__draw", stream("inventory", "id_sim", "lca"))
    sampled = sample_studies(bounded, n)
    draw = triangular(uniform("__draw", noise("Id_sample")), "low", "recommended_value", "high")
    value = F.when(F.col("titem").isin(list(scope.drawn)), draw) \
        .otherwise(F.col("recommended_value"))
    return sampled.withColumn("recommended_value", value).select(*OUT, CARRIED)


def split_activity(rows: DataFrame, scope: Scope) -> DataFrame:
    """Scope, activity and flow name in place of the composite id they went into."""
    return rows.withColumns({p: F.col(f"{CARRIED}.{p}") for p in scope.parts}).drop(
        "id_sim", "id_sim1", CARRIED)


def field_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("type_activity_data2").isin(K.FIELD_TYPES))


FUELS = ["CO2", "CO2_b", "CO", "PM2.5", "NOx", "NMVOC", "SO2"]


def site_factors(factors: DataFrame, n: int) -> DataFrame:
    """Drawn field factors and fixed fuel factors, one row per sample."""
    fuel = factors.groupBy().agg(*[
        F.max(F.when(F.col("factor_key") == f"fuel_{s}", F.col("recommended_value")))
        .alias(f"fuel_{s}") for s in FUELS])
    return attach(factor_draws(factors, n), expand_samples(fuel, n), ["Id_sample"])


def attach_factors(rows: DataFrame, factors: DataFrame, contents: DataFrame, n: int) -> DataFrame:
    """Field rows with the sample's factors and the flow's nitrogen and carbon content."""
    joined = attach(rows, stage(site_factors(factors, n), "site_factors"), ["Id_sample"])
    joined = attach(joined, contents, ["activity_data1"])
    return zero_fill(joined, ["N_content", "C_content"])


def field_emissions(rows: DataFrame) -> DataFrame:
    """Emissions of fertilisers, soil correctors and diesel on the field."""
    value, nitrogen = F.col("recommended_value"), F.col("recommended_value") * F.col("N_content")
    nh3, nox = F.col("NH3_ef"), F.col("NOx_ef")
    fuelled = F.col("activity_data1") == "Diesel"
    none = F.lit(0.0)

    def burnt(substance: str, otherwise: Column) -> Column:
        return F.when(fuelled, value * as_col(f"fuel_{substance}")).otherwise(otherwise)

    direct = nitrogen * (F.lit(1.0) - nh3 + nox) * F.col("N2Od_ef")
    indirect = nitrogen * (nh3 + nox) * F.col("N2Oi_ef")
    return rows.withColumns({
        "NH3": nitrogen * nh3 * 17 / 14,
        "N2O": (direct + indirect) * 44 / 28,
        "NOx": burnt("NOx", nitrogen * nox * 46 / 14),
        "CO2": burnt("CO2", value * F.col("C_content") * F.col("C_ef") * 44 / 12),
        **{s: burnt(s, none) for s in ["CO2_b", "CO", "SO2", "NMVOC", "PM2.5"]}})


def field_totals(emissions: DataFrame, scope: Scope, with_so2: bool = False) -> DataFrame:
    """Field emissions per sample, place and activity in long form."""
    substances = K.FIELD_SUBSTANCES if with_so2 else list(scope.substances)
    ids = ["Id_sample", scope.parts[0], "type_activity_data2"]
    sums = emissions.groupBy(*ids).agg(*[strict_sum(s).alias(s) for s in substances])
    return lengthen(sums, ids, substances, "substance_ac", "value_emission")


def meal_flows(rows: DataFrame, n: int) -> DataFrame:
    """National processing rows plus the literal flows of making meal straight from beans."""
    spark = rows.sparkSession
    literal = spark.createDataFrame(
        [(i, K.MEAL_FLOW_SOURCE, k, 1, 1, v, s) for i, k, s, v in K.MEAL_FLOWS],
        "id_sim string, lca string, key_sim string, n bigint, titem int, "
        "recommended_value double, key_spread string")
    known = rows.select("Id_sample", "id_sim", "lca", "key_sim", "n", "titem", "recommended_value",
                        F.col("key_sim").alias("key_spread"))
    return stack([known, expand_samples(literal, n)])


def combustion_emissions(rows: DataFrame, factors: DataFrame, n: int) -> DataFrame:
    """Emissions of the diesel burnt in processing, per sample in long form."""
    fuel = stage(site_factors(factors, n), "site_factors")
    diesel = attach(rows.where(F.col("key_sim") == "Diesel"), fuel, ["Id_sample"])
    sums = diesel.groupBy("Id_sample").agg(*[
        strict_sum(F.col("recommended_value") * as_col(f"fuel_{s}")).alias(s)
        for s in K.COMBUSTION_SUBSTANCES])
    return lengthen(sums, ["Id_sample"], K.COMBUSTION_SUBSTANCES, "substance_ac",
                    "value_emission")
