"""Whole runs as queries: all inputs to the five product tables, against one composed oracle."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F

from furrow.constants import ALL_STAGES, FARM_STAGES
from furrow.operators import impact as I
from furrow.plans import footprints as P
from furrow.sources.schemas import SCHEMAS
from furrow.sources.stages import stage
from verification import flow_checks as T
from verification import grid_checks as S
from verification import impact_checks as C
from verification.views import hold, load, oracle

N = 2
OWN = {"trade": "harmonised", "farm": "harmonised", "origin": "origin_h", "change": "change_h", "cover": "cover_h", "zone": "zone_h",
       "stock": "per_ha", "master": "master_h"}


def _own(text: str) -> str:
    """Point a fragment at the tables of the run and at the run's number of samples."""
    for view, table in OWN.items():
        text = re.sub(rf"\b(FROM|JOIN)\s+{re.escape(view)}\b", rf"\1 {table}", text)
    return re.sub(r"range\(1, \d+\)", f"range(1, {N + 1})", text)


def _ctes(text: str) -> str:
    text = text.strip()
    return text[5:] if text.upper().startswith("WITH ") else text


SAME = " AND ".join(f"m.{k} = {{t}}.{k}" for k in ["Id_sample", "method", "impact_category", "unit_impact", "damage"])
FLOW_PARTS = [T.HARMONISED_CTES]
EMISSION_PARTS = [
    "origin_h AS (SELECT DISTINCT biome, state_code, municipality_code, year FROM harmonised)", S.ALIGNED,
    f"change_h AS (SELECT u.municipality_code, year, cov0, cov1, burnt, count(*) AS npixel, avg(csoc) AS csoc_md, sum(area) AS area "
    f"FROM crop_cell c JOIN unit u ON {S.IN_UNIT} GROUP BY ALL)", S.CLEAN,
    "cover_h AS (SELECT * EXCLUDE (csoc_md) REPLACE (CASE WHEN biome = 'AMAZONIA' AND map_biomas_class_code = 9 THEN 10 "
    "ELSE map_biomas_class_code END AS map_biomas_class_code) FROM shared)", S.ZONES,
    f"zone_h AS (SELECT b.biome, b.municipality_code, {S.ZONE_CASE} AS ipcc_code, area_eco_zone FROM (SELECT DISTINCT biome, municipality_code "
    "FROM cover_h) b LEFT JOIN (SELECT * FROM zones WHERE ipcc_code IS NOT NULL) z ON b.municipality_code IS NOT DISTINCT FROM z.municipality_code "
    "WHERE biome IS NOT NULL)", C.EMITTED, C.ORIGINS.replace("FROM flow", "FROM harmonised"), C.CARBON_FILL, C.LONG]
IMPACT_PARTS = [
    C.STRESS, C.MATRIX, C.CF, C.FUEL, C.farm_cte("state", C.SCOPES["state"][0].substances),
    C.farm_cte("region", C.SCOPES["region"][0].substances), C.BURNT[:C.BURNT.index(C.FUEL) - 1], C.BURNT[C.BURNT.index(C.FUEL) + len(C.FUEL) + 1:],
    C.PROCESSED.strip().lstrip(","), C.DISTANCES, C.TRANSPORT[len(C.DISTANCES) + len(C.BACKGROUND) + 2:],
    "carbon_h AS (SELECT Id_sample, municipality_code, year, damage, impact_category, unit_impact, "
    "sum(value_emission * value) FILTER (WHERE subc1 = 'ibmb') AS i_luclu_above_biomass, sum(value_emission * value) FILTER (WHERE subc1 = 'iSOC') AS i_luclu_soc "
    "FROM long JOIN cfs USING (substance_ac) GROUP BY ALL)",
    "joined AS (SELECT m.*, l.cf_occ_glo AS i_land_occupation, l.cf_tra_glo * l.double_cropping_share * 0.5 + l.cf_tra_glo * (1 - l.double_cropping_share) "
    "AS i_land_transformation, k.i_luclu_above_biomass, k.i_luclu_soc, p.* EXCLUDE (Id_sample, method, impact_category, unit_impact, damage), "
    "e.i_p_electricity_pd, e.i_p_electricity_m_pd, c.i_p_fuel_combustion_of, t.i_domestic_transport, t.i_international_transport, "
    + ", ".join(f"CASE WHEN dummy_uf_reg = 'uf' THEN s.{x} WHEN dummy_uf_reg = 'reg' THEN r.{x} END AS {x}" for x in FARM_STAGES)
    + " FROM matrix m LEFT JOIN stress l ON m.Id_sample = l.Id_sample AND m.region_name = l.region_name AND m.state_code = l.state_code "
    "AND m.municipality_code = l.municipality_code AND m.year = l.year AND m.damage = 'Terrestrial ecosystems' AND m.impact_category = 'Land stress, TE, average' "
    "LEFT JOIN carbon_h k ON m.Id_sample = k.Id_sample AND m.municipality_code = k.municipality_code AND m.year = k.year AND m.damage = k.damage "
    "AND m.impact_category = k.impact_category AND m.unit_impact = k.unit_impact "
    f"LEFT JOIN processed p ON {SAME.format(t='p')} LEFT JOIN electric e ON {SAME.format(t='e')} AND m.region_name = e.region_name "
    f"LEFT JOIN combusted c ON {SAME.format(t='c')} LEFT JOIN transport t ON "
    + " AND ".join(f"m.{k} IS NOT DISTINCT FROM t.{k}" for k in [*C.D.LINK_KEYS, "method", "impact_category", "unit_impact", "damage"])
    + f" LEFT JOIN farm_state s ON {SAME.format(t='s')} AND CAST(m.state_code AS VARCHAR) = s.state_code "
    f"LEFT JOIN farm_region r ON {SAME.format(t='r')} AND m.region_name = r.region_name)",
    "master_h AS (SELECT * REPLACE (" + ", ".join(f"coalesce({x}, 0) AS {x}" for x in [*I.MASTER_MEASURES, *ALL_STAGES]) + ") FROM joined)", C.ALIGN]


def _sum(name: str, volume: str, values: dict[str, str]) -> str:
    total = " + ".join(f"({x})" for x in values.values())
    return (f"SELECT '{name}' AS product, year, impact_category, import_country_name, count(*) AS n, round(sum({volume}), 4) AS volume, "
            f"round(sum({total}) / 1000000, 6) AS impact FROM lined WHERE {volume} <> 0 GROUP BY ALL")


def _values(p: I.Product) -> dict[str, str]:
    if not p.allocation:
        return {c: f"{c} * {p.volume}" for c in p.stages}
    home, abroad, mass = p.allocation
    return {c: f"(CASE WHEN import_country_name = 'BRAZIL' THEN {home} ELSE {abroad} END) * {c} / {mass} * {p.volume}" for c in p.stages}


def full_sql() -> str:
    parts = [_own(_ctes(p)) for p in [*FLOW_PARTS, *EMISSION_PARTS, *IMPACT_PARTS]]
    ends = [_sum("equivalent", "soy_eq", C.EQUIVALENT)] + [_sum(n, p.volume, _values(p)) for n, p in P.PRODUCTS.items()]
    return "WITH " + ",\n".join(p.strip().strip(",") for p in parts) + "\n" + "\nUNION ALL ".join(ends)


def full_run(spark, sf):
    held = {"flow": hold(spark, sf, "flow"), "trade": hold(spark, sf, "trade", C.ROUTED)}
    tables = {n: load(spark, sf, n, held) for n in SCHEMAS}
    tables["pixel"] = stage(tables["pixel"], "pixel")
    products = P.run(tables, load(spark, sf, "unit"), S.WIDTH, S.HEIGHT, N)
    volume = {"equivalent": "soy_eq"} | {n: p.volume for n, p in P.PRODUCTS.items()}
    return reduce(lambda a, b: a.unionByName(b), [
        t.groupBy("year", "impact_category", "import_country_name").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum(volume[name]), 4).alias("volume"),
            F.round(F.sum("impact") / 1000000, 6).alias("impact")).withColumn("product", F.lit(name))
        for name, t in products.items()])


def checks() -> dict:
    return {"I21_full_run": (full_run, oracle(full_sql()))}
