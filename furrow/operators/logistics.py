"""Transport links, their distances and the impact of covering them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.functions.nulls import strict_sum
from furrow.operators.relational import attach, stack
from furrow.sources.stages import stage

LINK_KEYS = ["region_code", "region_name", "state_code", "state_name", "municipality_code",
             "municipality_name", "export_port_code1", "export_port_name_mo1", "import_port_code",
             "import_country_name", "transport_type", "year"]
CATEGORY = ["method", "impact_category", "unit_impact", "damage"]


def transport_links(flows: DataFrame) -> DataFrame:
    return flows.groupBy(*LINK_KEYS).agg(strict_sum("soy_eq").alias("soy_eq"),
                                         strict_sum("land_use").alias("land_use"))


def attach_domestic_distance(links: DataFrame, distances: DataFrame) -> DataFrame:
    """Road distance from origin to export port."""
    table = distances.select(F.col("from_id").alias("municipality_code"),
                             F.col("to_id").alias("export_port_code1"),
                             F.col("distance_km").alias("domestic_distance"))
    return attach(links, table, ["municipality_code", "export_port_code1"])


def international_distances(sea: DataFrame, overland: DataFrame) -> DataFrame:
    by_sea = sea.drop("port_imp", "import_port_acronym")
    by_land = overland.drop("time_h").withColumnsRenamed(
        {"from_id": "export_port_code1", "to_id": "import_country_name"})
    return stack([by_sea, by_land]).withColumnRenamed("distance_km", "international_distance")


def attach_international_distance(links: DataFrame, distances: DataFrame) -> DataFrame:
    return attach(links, distances, ["export_port_code1", "import_country_name"])


def distance_impacts(links: DataFrame, background: DataFrame) -> DataFrame:
    """Impact per tonne of covering the domestic and the international distance of each link.

    The carriers' impacts are put side by side per category, a small table, and the distances of a link
    add up, so links are shuffled once each and multiply by the categories last.
    """
    stages = {"domestic_distance": (K.LORRY, "i_domestic_transport"),
              "international_distance": (K.SHIP, "i_international_transport")}
    carriers = background.where(F.col("key_sim").isin([c for c, _ in stages.values()])).groupBy(*CATEGORY).agg(
        *[F.sum(F.when(F.col("key_sim") == c, F.col("impact"))).alias(f"__{d}") for d, (c, _) in stages.items()])
    legs = links.groupBy(*LINK_KEYS).agg(*[F.sum(d).alias(d) for d in stages])
    rows = legs.crossJoin(stage(carriers, "carriers"))
    return rows.select(*LINK_KEYS, *CATEGORY, *[
        F.coalesce(F.col(f"__{d}") * F.col(d), F.lit(0.0)).alias(out) for d, (_, out) in stages.items()])
