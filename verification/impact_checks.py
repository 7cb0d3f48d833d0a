"""Carbon, land-stress, inventory, logistics and impact queries and their SQL oracles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from furrow.constants import (ALL_STAGES, FARM_ACTIVITIES, FARM_STAGES, FIELD_SUBSTANCES, LAND_STAGES, MEAL_STAGES,
                              PROC_STAGES, PROCESS_STAGES, TRANSPORT_STAGES)
from furrow.functions.nulls import strict_avg
from furrow.operators import carbon as E
from furrow.operators import impact as I
from furrow.operators import inventory as L
from furrow.operators import logistics as D
from furrow.operators import stress as B
from furrow.operators.relational import expand_samples, fill_by_tier_means
from furrow.operators.sampling import factor_draws
from furrow.sources.stages import stage
from verification import draw_sql as R
from verification.flow_checks import _q, round_sql, rounded, tier_fill_cte
from verification.grid_checks import FACTOR_SQL
from verification.views import hold, load, oracle

N = 5


def _strict(c: str) -> str:
    return f"CASE WHEN count(*) = count({c}) THEN sum({c}) END"


# --- carbon ----------------------------------------------------------------------------------

GAS = ["CO2", "CO", "CH4", "N2O", "NOx"]
PARAMETERS = "param AS (SELECT type_land_area, map_biomas_class, map_biomas_class_code, ipcc_code, " + ", ".join(
    [f"coalesce({c}, 0) AS {c}" for c in ["agbm_ll", "agbm_value", "agbm_ul", "Litter_min", "Litter_value", "Litter_max",
                                          "DOM_min", "DOM_value", "DOM_max", "Cf_value", "Cf_sd"]]
    + [f"coalesce({p}_{g}, 0) AS {p}_{g}" for g in GAS for p in ["Gef", "sd"]]) + " FROM carbon)"
MATCHED = PARAMETERS + """,
typed AS (SELECT c.*, p.* EXCLUDE (map_biomas_class_code) FROM cover c JOIN param p USING (map_biomas_class_code)),
matched AS (SELECT z.biome, z.municipality_code, z.ipcc_code,
    coalesce(z.area_eco_zone, CASE WHEN t.map_biomas_class_code = 3 THEN 0 WHEN t.map_biomas_class_code IS NOT NULL THEN 1 END) AS area_eco_zone,
    t.* EXCLUDE (biome, municipality_code, ipcc_code)
  FROM zone z LEFT JOIN typed t ON z.biome = t.biome AND z.municipality_code = t.municipality_code AND z.ipcc_code = t.ipcc_code),
weighed AS (SELECT *, area_eco_zone / nullif(CASE WHEN count(*) OVER w = count(area_eco_zone) OVER w THEN sum(area_eco_zone) OVER w END, 0) AS p_area_bm
  FROM matched WINDOW w AS (PARTITION BY municipality_code, year, map_biomas_class_code, burnt))"""
CKEY = ["biome", "state_code", "municipality_code", "year", "map_biomas_class_code", "burnt", "burnt1"]
PKEY = ["map_biomas_class_code", "ipcc_code"]
DRAWN = {"soc_change": ("csoc_min", "csoc_me", "csoc_max", ""), "biomass": ("agbm_ll", "agbm_value", "agbm_ul", ""),
         "litter": ("Litter_min", "Litter_value", "Litter_max", ""), "dead_matter": ("DOM_min", "DOM_value", "DOM_max", ""),
         **{f"gas_{g}": (f"Gef_{g} / nullif(sd_{g} * 1.96, 0)", f"Gef_{g}", f"Gef_{g} + sd_{g} * 1.96", " / 1000") for g in GAS},
         "combustion": ("Cf_value / nullif(Cf_sd * 1.96, 0)", "Cf_value", "Cf_value + Cf_sd * 1.96", " / 1000")}
STOCKS = MATCHED + ",\nsampled AS (" + R.uniforms(
    "(" + R.samples("weighed", N) + ")",
    {v: R.stream(v, *(CKEY if v == "soc_change" else PKEY)) for v in DRAWN}) + """),
stocks AS (SELECT municipality_code, year, map_biomas_class_code, map_biomas_class, luclu, burnt, burnt1, ipcc_code, Id_sample,
  coalesce(area_ha, 0) AS area_ha, coalesce(p_area_bm, 0) AS p_area_bm, """ + ", ".join(
    f"coalesce({R.triangular('u_' + v, a, c, b)}{scale}, 0) AS {v}" for v, (a, c, b, scale) in DRAWN.items()) + " FROM sampled)"
FIRE = "(CASE WHEN burnt1 = 0 OR fuel < 0 THEN 0 ELSE fuel * combustion * gas_{g} END) * area_ha * p_area_bm"
EMITTED = STOCKS + """,
fuelled AS (SELECT *, biomass + litter + dead_matter - cut AS fuel
  FROM (SELECT *, CASE WHEN luclu = 'LUC' THEN 10 ELSE 0 END AS cut FROM stocks)),
emitted AS (SELECT *, (CASE WHEN luclu = 'LU' THEN soc_change / 3 ELSE soc_change END) * 1000 AS CO2e_soc,
  (CASE WHEN burnt1 = 0 THEN (biomass * 0.47 + litter * 0.37 + dead_matter * 0.5 - cut * 0.47) * (44.0 / 12) * 1000
        ELSE fuel * combustion * gas_CO2 END) * area_ha * p_area_bm AS CO2e_bmb,
  """ + ", ".join(FIRE.format(g=g) + f" AS {g}e" for g in GAS[1:]) + """ FROM fuelled),
by_class AS (SELECT Id_sample, municipality_code, year, map_biomas_class_code, luclu, map_biomas_class, burnt, burnt1, area_ha,
  avg(CO2e_soc) AS CO2e_soc, sum(CO2e_bmb) AS CO2e_bmb, sum(CH4e) AS CH4e, sum(N2Oe) AS N2Oe, sum(NOxe) AS NOxe FROM emitted GROUP BY ALL),
weighted AS (SELECT * REPLACE (CO2e_soc * area_ha / nullif(sum(area_ha) OVER (PARTITION BY Id_sample, municipality_code, year, luclu, burnt1), 0) AS CO2e_soc)
  FROM by_class),
by_demand AS (SELECT Id_sample, municipality_code, year, luclu, burnt1, sum(area_ha) AS area_ha, """ + ", ".join(
    f"{_strict(e)} AS {e}" for e in E.EMISSIONS) + """ FROM weighted GROUP BY ALL),
per_unit AS (SELECT Id_sample, municipality_code, year, sum(area_ha) AS area_ha, """ + _strict("CO2e_soc * area_ha") + " AS CO2e_soc, " \
    + ", ".join(f"{_strict(e)} AS {e}" for e in E.EMISSIONS[1:]) + """ FROM by_demand GROUP BY ALL),
per_ha AS (SELECT Id_sample, municipality_code, year, area_ha, """ + ", ".join(
    f"{e} / nullif(area_ha, 0) AS {e}" for e in E.EMISSIONS) + " FROM per_unit)"

ORIGINS = """
totals AS (SELECT region_code, region_name, state_code, state_name, municipality_code, municipality_name, year, sum(soy_eq) AS soy_eq,
  """ + _strict("land_use") + """ AS land_use FROM flow GROUP BY ALL),
many AS (""" + R.samples("totals", N) + """),
placed AS (SELECT m.*, s.area_ha, s.CO2e_soc, s.CO2e_bmb, s.CH4e, s.N2Oe, s.NOxe FROM many m LEFT JOIN stock s
  ON m.Id_sample = s.Id_sample AND m.municipality_code = s.municipality_code AND m.year = s.year)"""
CARBON_FILL = tier_fill_cte("placed", "carbon_full", ["area_ha", *E.EMISSIONS], E.CARBON_TIERS, "data_quality_luc_emissions", [
    "estimated", "imputed based on average of the municipality", "imputed based on average of the state in each year",
    "imputed based on average of the state", "imputed based on average of the region each year"])
LONG = """
long AS (SELECT *, CASE emission WHEN 'CO2e_soc' THEN 'CO2' WHEN 'CO2e_bmb' THEN 'CO2' WHEN 'CH4e' THEN 'CH4' WHEN 'N2Oe' THEN 'N2O' ELSE 'NOx' END AS substance_ac,
  CASE emission WHEN 'CO2e_soc' THEN 'iSOC' ELSE 'ibmb' END AS subc1
  FROM carbon_full UNPIVOT INCLUDE NULLS (value_emission FOR emission IN (CO2e_soc, CO2e_bmb, CH4e, N2Oe, NOxe)))"""


def _weighed(s, d):
    return E.weigh_zones(E.match_zones(load(s, d, "zone"), load(s, d, "cover"), E.parameter_bounds(load(s, d, "carbon"))))


def _emitted(s, d):
    return E.stock_emissions(E.draw_stocks(_weighed(s, d), N))


def _by_class(s, d):
    return E.roll_up_zones(_emitted(s, d))


def _placed(s, d):
    return E.attach_emissions(load(s, d, "flow"), load(s, d, "stock"), N)


def _filled(s, d):
    return E.filled_emissions(hold(s, d, "flow", [*E.ORIGIN_KEYS, "soy_eq", "land_use"]), load(s, d, "stock"), N)


# --- land stress -----------------------------------------------------------------------------

LAND = """
units AS (SELECT DISTINCT region_name, state_code, municipality_code, year, double_cropping_share, soy_yield FROM farm),
areas AS (SELECT state_code, municipality_code, year, map_biomas_class_code, sum(area_ha) AS area_lup FROM cover GROUP BY ALL),
classed AS (SELECT u.*, a.map_biomas_class_code, a.area_lup, c.type_land_area, c.map_biomas_class FROM units u
  LEFT JOIN areas a ON u.state_code = a.state_code AND u.municipality_code = a.municipality_code AND u.year = a.year
  LEFT JOIN (SELECT DISTINCT type_land_area, map_biomas_class, map_biomas_class_code FROM carbon) c ON a.map_biomas_class_code = c.map_biomas_class_code),
halves AS (SELECT region_name, state_code, municipality_code, year, double_cropping_share, soy_yield,
  sum(area_lup) FILTER (WHERE type_land_area <> 'Natural_forest') AS o, sum(area_lup) FILTER (WHERE type_land_area = 'Natural_forest') AS t
  FROM classed GROUP BY ALL),
land AS (SELECT * EXCLUDE (o, t), CASE WHEN o IS NULL AND t IS NOT NULL THEN 0 ELSE o END AS occ,
  CASE WHEN t IS NULL AND o IS NOT NULL THEN 0 ELSE t END AS trans FROM halves)"""
LAND_FILL = LAND + "," + tier_fill_cte("land", "land_full", ["occ", "trans"], B.LAND_TIERS, "tdata_lcrop", [
    "estimated", "imputed base on average dato of the municipality", "imputed base on average of the state in each year",
    "imputed base on average of the state", "imputed base on average of the region in each year"])
INTENSE = LAND_FILL + """,
intense AS (SELECT *, CAST(CASE WHEN soy_yield < q1 THEN 4 WHEN soy_yield < q3 THEN 2 WHEN soy_yield IS NOT NULL THEN 3 END AS INT) AS habitat_id
  FROM land_full, (SELECT quantile_cont(soy_yield, 0.25) AS q1, quantile_cont(soy_yield, 0.75) AS q3 FROM land_full))"""
ECOSHARE = """
ecoshare AS (SELECT CAST(CD_MUN AS BIGINT) AS municipality_code, REALM AS realm, ECO_ID AS eco_id, eco_code, inter_km2,
  inter_km2 / sum(inter_km2) OVER (PARTITION BY CD_MUN) AS pt_int_amun FROM (SELECT DISTINCT * FROM overlap))"""
SUMMARY = """
summary AS (SELECT realm, biome, eco_id, eco_name, habitat_id, habitat, """ + ", ".join(
    f"CASE WHEN count(*) = count(cf_{s}_avg_glo) THEN {fn}(cf_{s}_avg_glo) END AS cf_{s}_glo_{tag}"
    for s in ["occ", "tra"] for fn, tag in [("avg", "md"), ("min", "min"), ("max", "max")]) + """
  FROM land_cf WHERE habitat_id IN (2, 3, 4) GROUP BY ALL),
cf_u AS (""" + R.uniforms("(" + R.samples("summary", N) + ")", {s: R.stream(f"cf_{s}_glo") for s in ["occ", "tra"]}) + """),
cf_draw AS (SELECT Id_sample, eco_id, habitat_id, habitat, """ + ", ".join(
    R.triangular(f"u_{s}", f"cf_{s}_glo_min", f"cf_{s}_glo_md", f"cf_{s}_glo_max") + f" AS cf_{s}_glo" for s in ["occ", "tra"]) + " FROM cf_u)"
STRESS = INTENSE + "," + ECOSHARE + "," + SUMMARY + """,
stress AS (SELECT * REPLACE (cf_occ_glo * (occ / nullif(occ + trans, 0)) * 10000 AS cf_occ_glo, cf_tra_glo * (trans / nullif(occ + trans, 0)) * 10000 AS cf_tra_glo)
  FROM (SELECT c.Id_sample, region_name, state_code, i.municipality_code, year, occ, trans, double_cropping_share,
          """ + _strict("cf_occ_glo * pt_int_amun * 0.5") + " AS cf_occ_glo, " + _strict("cf_tra_glo * pt_int_amun") + """ AS cf_tra_glo
        FROM intense i JOIN ecoshare e ON i.municipality_code = e.municipality_code
        JOIN cf_draw c ON c.eco_id = e.eco_id AND c.habitat_id = i.habitat_id GROUP BY ALL))"""
UNIT = "region_name, state_code, municipality_code, year, double_cropping_share, soy_yield"


def _classed(s, d):
    held = {"flow": hold(s, d, "flow", ["region_name", "state_code", "municipality_code", "year"])}
    return B.land_by_class(load(s, d, "farm", held), load(s, d, "cover"), load(s, d, "carbon"))


def _land(s, d):
    return stage(B.fill_land(stage(B.split_land(_classed(s, d)), "land")), "land_filled")


def _stress(s, d):
    return B.stress_factors(B.classify_intensity(_land(s, d)), B.ecoregion_shares(load(s, d, "overlap")),
                            B.summarise_land_factors(load(s, d, "land_cf")), N)


# --- inventory -------------------------------------------------------------------------------

SCOPES = {"state": (L.STATE, "stage = 'Farming' AND state_code IS NOT NULL"), "region": (L.REGION, "stage = 'Farming'"),
          "national": (L.NATIONAL, "type_activity_data2 = 'crushing'")}


def inventory_cte(tag: str) -> str:
    scope, where = SCOPES[tag]
    keys = ", ".join(scope.keys)
    joined = " || '-' || ".join(f"CAST({k} AS VARCHAR)" for k in scope.keys)
    limits = ", ".join(f"nullif(coalesce(sum({m}), 0), 0) AS {m}" for m in ["lower_limit", "upper_limit", "sd"])
    drawn = ", ".join(map(str, scope.drawn))
    kept = ", ".join(map(str, scope.kept))
    return f"""
i_{tag} AS (SELECT {keys}, key_sim, lca, coalesce(sum(recommended_value), 0) AS recommended_value, {limits}
  FROM inventory WHERE {where} GROUP BY ALL),
ids_{tag} AS (SELECT *, {joined} || '-' || key_sim AS id_sim, {joined} AS id_sim1 FROM i_{tag}),
st_{tag} AS (SELECT *, row_number() OVER (PARTITION BY id_sim1 ORDER BY lca) AS place, count(*) OVER (PARTITION BY id_sim1) AS n
  FROM (SELECT DISTINCT id_sim1, lca FROM ids_{tag})),
tier_{tag} AS (SELECT i.*, s.place, s.n, CAST(CASE WHEN (lower_limit IS NOT NULL OR sd IS NOT NULL) AND n > 1 THEN 4
    WHEN lower_limit IS NOT NULL OR sd IS NOT NULL THEN 3 WHEN n > 1 THEN 2 ELSE 1 END AS INT) AS titem
  FROM ids_{tag} i JOIN st_{tag} s USING (id_sim1, lca)),
u_{tag} AS ({R.uniforms('(' + R.samples(f'tier_{tag}', N) + ')', {'pick': R.stream('source', 'id_sim1'), 'draw': R.stream('inventory', 'id_sim', 'lca')})}),
pick_{tag} AS (SELECT * FROM u_{tag} WHERE floor(u_pick * n) + 1 = place),
full_{tag} AS (SELECT Id_sample, id_sim1, id_sim, lca, key_sim, n, titem, CASE WHEN titem IN ({drawn}) THEN
    {R.triangular('u_draw', 'coalesce(lower_limit, recommended_value / nullif(sd * 1.96, 0) / 10000)', 'recommended_value',
                  'coalesce(upper_limit, recommended_value + 1.96 * sd)')} ELSE recommended_value END AS recommended_value
  FROM pick_{tag} WHERE titem IN ({kept}))"""


FUEL = FACTOR_SQL[5:].replace("range(1, 21)", f"range(1, {N + 1})") + ",\nsite AS (SELECT d.*, " + ", ".join(
    f"""(SELECT max(recommended_value) FROM factors WHERE factor_key = 'fuel_{s}') AS "fuel_{s}\"""" for s in L.FUELS) + " FROM factor_draw d)"


def field_cte(tag: str) -> str:
    place = SCOPES[tag][0].parts[0]
    rest = ", ".join(f"""CASE WHEN d THEN v * "fuel_{s}" ELSE 0 END AS "{s}\"""" for s in ["CO2_b", "CO", "SO2", "NMVOC", "PM2.5"])
    return inventory_cte(tag) + f""",
act_{tag} AS (SELECT Id_sample, lca, key_sim, n, titem, recommended_value, split_part(id_sim, '-', 1) AS {place},
  split_part(id_sim, '-', 2) AS type_activity_data2, key_sim AS activity_data1 FROM full_{tag}),
fact_{tag} AS (SELECT a.*, s.* EXCLUDE (Id_sample), coalesce(c.N_content, 0) AS N_content, coalesce(c.C_content, 0) AS C_content
  FROM act_{tag} a LEFT JOIN site s ON a.Id_sample = s.Id_sample LEFT JOIN content c ON a.activity_data1 = c.activity_data1
  WHERE type_activity_data2 IN ('fertiliser', 'soil_correctors', 'machinery')),
field_{tag} AS (SELECT *, v * N_content * NH3_ef * 17 / 14 AS NH3,
    (v * N_content * (1 - NH3_ef + NOx_ef) * N2Od_ef + v * N_content * (NH3_ef + NOx_ef) * N2Oi_ef) * 44 / 28 AS N2O,
    CASE WHEN d THEN v * "fuel_NOx" ELSE v * N_content * NOx_ef * 46 / 14 END AS NOx,
    CASE WHEN d THEN v * "fuel_CO2" ELSE v * C_content * C_ef * 44 / 12 END AS CO2, {rest}
  FROM (SELECT *, recommended_value AS v, activity_data1 = 'Diesel' AS d FROM fact_{tag}))"""


def total_cte(tag: str, substances) -> str:
    place = SCOPES[tag][0].parts[0]
    names = ", ".join(f'"{s}"' for s in substances)
    sums = ", ".join(f'{_strict(chr(34) + s + chr(34))} AS "{s}"' for s in substances)
    return field_cte(tag) + f""",
total_{tag} AS (SELECT Id_sample, {place}, type_activity_data2, substance_ac, value_emission FROM
  (SELECT Id_sample, {place}, type_activity_data2, {sums} FROM field_{tag} GROUP BY ALL) q UNPIVOT INCLUDE NULLS (value_emission FOR substance_ac IN ({names})))"""


def _prepared(s, d, tag):
    return L.prepare(load(s, d, "inventory"), SCOPES[tag][0])


def _assembled(s, d, tag):
    return L.assemble(_prepared(s, d, tag), SCOPES[tag][0], N)


def _shown(s, d, tag):
    return _assembled(s, d, tag).select(*L.OUT)


def _active(s, d, tag):
    return L.split_activity(_assembled(s, d, tag), SCOPES[tag][0])


def _field(s, d, tag):
    rows = L.attach_factors(L.field_rows(_active(s, d, tag)), load(s, d, "factors"), load(s, d, "content"), N)
    return L.field_emissions(rows)


def _total(s, d, tag):
    return L.field_totals(_field(s, d, tag), SCOPES[tag][0])


def _processing(s, d):
    return L.meal_flows(_assembled(s, d, "national"), N)


def _combustion(s, d):
    return L.combustion_emissions(_processing(s, d), load(s, d, "factors"), N)


MEAL = inventory_cte("national") + """,
literal AS (SELECT * FROM (VALUES ('crushing-Electricity', 'Electricity', 0.025::DOUBLE, 'Electricity_m'),
  ('crushing-Natural_Gas_High_Pressure', 'Natural_Gas_High_Pressure', 0.095::DOUBLE / (10 * 4.184::DOUBLE), 'Natural_Gas_High_Pressure_m'),
  ('crushing-Tap_water', 'Tap_water', 0.056::DOUBLE, 'Tap_water_m')) v(id_sim, key_sim, recommended_value, key_spread)),
processing AS (SELECT Id_sample, id_sim, lca, key_sim, n, titem, recommended_value, key_sim AS key_spread FROM full_national UNION ALL
  SELECT Id_sample, id_sim, 'Ecoinvent 3.11', key_sim, 1, 1, recommended_value, key_spread FROM (""" + R.samples("literal", N) + "))"
BURNT = MEAL + "," + FUEL + """,
burnt AS (SELECT * FROM (SELECT p.Id_sample, """ + ", ".join(
    f'sum(recommended_value * "fuel_{s}") AS "{s}"' for s in ["NOx", "CO2", "CO2_b", "SO2", "NMVOC", "PM2.5"]) + """
  FROM processing p JOIN site s ON p.Id_sample = s.Id_sample WHERE key_sim = 'Diesel' GROUP BY p.Id_sample) q
  UNPIVOT INCLUDE NULLS (value_emission FOR substance_ac IN ("NOx", "CO2", "CO2_b", "SO2", "NMVOC", "PM2.5")))"""

# --- impact ----------------------------------------------------------------------------------

CAT = "method, impact_category, unit_impact, damage"
BACKGROUND = """
background AS (SELECT method, CASE WHEN unit_impact = 'PDF.m3.d' THEN 'PDF.year' ELSE unit_impact END AS unit_impact, impact_category,
  coalesce(damage, impact_category) AS damage, key_sim, sum(CASE WHEN unit_impact <> 'PDF.m3.d' THEN impact
    WHEN impact_category = 'Ecotoxicity, terrestrial, average' THEN impact / (6.40e12 * 365.25)
    WHEN impact_category = 'Ecotoxicity, freshwater, average' THEN impact / (9.90e12 * 365.25)
    WHEN impact_category = 'Ecotoxicity, marine, average' THEN impact / (6.56e16 * 365.25) ELSE impact END) AS impact
  FROM process WHERE approach = 'All_effects_100yr' GROUP BY ALL)"""
CF = "cfs AS (SELECT * FROM cf WHERE approach = 'All_effects_100yr')"
KEY = ", ".join(I.MASTER_KEYS)
LINKS = f"links AS (SELECT {KEY}, " + ", ".join(f"{_strict(c)} AS {c}" for c in I.MASTER_SUMS) + ", " + ", ".join(
    f"CASE WHEN count(*) = count({c}) THEN avg({c}) END AS {o}" for o, c in I.MASTER_MEANS.items()) + " FROM trade GROUP BY ALL)"
CATALOGUE = BACKGROUND + ", catalogue AS (SELECT DISTINCT method, damage, impact_category, unit_impact FROM background)"
MATRIX = CATALOGUE + "," + LINKS + ", pairs AS (SELECT * FROM links, catalogue), matrix AS (" + R.samples("pairs", N) + ")"


def farm_cte(tag: str, substances) -> str:
    place = SCOPES[tag][0].parts[0]
    label = " ".join(f"WHEN '{a}' THEN 'i_f_{n}_" + "{k}'" for a, n in FARM_ACTIVITIES.items())
    pivot = ", ".join(f"coalesce(sum(i_frm) FILTER (WHERE stage = '{s}'), 0) AS {s}" for s in FARM_STAGES)
    return total_cte(tag, substances) + f""",
up_{tag} AS (SELECT a.Id_sample, a.{place}, a.type_activity_data2, {CAT}, {_strict('b.impact * a.recommended_value')} AS i_frm
  FROM act_{tag} a JOIN background b USING (key_sim) GROUP BY ALL),
on_{tag} AS (SELECT t.Id_sample, t.{place}, t.type_activity_data2, {CAT}, {_strict('t.value_emission * c.value')} AS i_frm
  FROM total_{tag} t JOIN cfs c USING (substance_ac) GROUP BY ALL),
farm_{tag} AS (SELECT Id_sample, {place}, {CAT}, {pivot} FROM (
  SELECT *, CASE type_activity_data2 {label.replace('{k}', 'pd')} END AS stage FROM up_{tag} WHERE i_frm IS NOT NULL UNION ALL
  SELECT *, CASE type_activity_data2 {label.replace('{k}', 'of')} END AS stage FROM on_{tag} WHERE i_frm IS NOT NULL) GROUP BY ALL)"""


def _background(s, d):
    return I.background_impacts(load(s, d, "process"))


def _upstream(s, d, tag):
    return I.farm_background_impacts(_active(s, d, tag), _background(s, d), SCOPES[tag][0])


def _onfield(s, d, tag):
    return I.farm_field_impacts(_total(s, d, tag), load(s, d, "cf"), SCOPES[tag][0])


def _farm(s, d, tag):
    return I.farm_stages(_upstream(s, d, tag), _onfield(s, d, tag), SCOPES[tag][0])


def _matrix(s, d, trade=None):
    trade = trade or hold(s, d, "trade", [*I.MASTER_KEYS, *I.MASTER_SUMS, *I.MASTER_MEANS.values()])
    return I.category_matrix(stage(I.trade_links(trade), "links"), I.impact_catalogue(_background(s, d)))


def _master(s, d):
    return I.master_matrix(I.category_matrix(I.trade_links(load(s, d, "trade")), I.impact_catalogue(_background(s, d))), N)


#: What routes and their distances read of the trade view.
ROUTED = [*D.LINK_KEYS, "soy_eq", "land_use", "import_port_acronym"]


def _distances(s, d, trade=None):
    held = {"trade": trade or hold(s, d, "trade", ROUTED)}
    links = D.attach_domestic_distance(stage(D.transport_links(held["trade"]), "routes"), load(s, d, "road", held))
    return D.attach_international_distance(links, D.international_distances(load(s, d, "sea", held), load(s, d, "overland", held)))


TLINK = ", ".join(D.LINK_KEYS)
DISTANCES = f"""
tlinks AS (SELECT {TLINK}, sum(soy_eq) AS soy_eq, {_strict('land_use')} AS land_use FROM trade GROUP BY ALL),
abroad AS (SELECT export_port_code1, import_country_name, distance_km FROM sea UNION ALL SELECT from_id, to_id, distance_km FROM overland),
distances AS (SELECT t.*, r.distance_km AS domestic_distance, a.distance_km AS international_distance FROM tlinks t
  LEFT JOIN road r ON t.municipality_code = r.from_id AND t.export_port_code1 = r.to_id
  LEFT JOIN abroad a ON t.export_port_code1 = a.export_port_code1 AND t.import_country_name = a.import_country_name)"""
TRANSPORT = DISTANCES + "," + BACKGROUND + f""",
transport AS (SELECT {TLINK}, {CAT}, coalesce(sum(x) FILTER (WHERE key_sim = 'Transport_Freight_Lorry_32_EURO5'), 0) AS i_domestic_transport,
  coalesce(sum(x) FILTER (WHERE key_sim = 'Transport_Freight_Sea'), 0) AS i_international_transport
  FROM (SELECT d.*, {CAT}, key_sim, impact * CASE WHEN key_sim = 'Transport_Freight_Sea' THEN international_distance ELSE domestic_distance END AS x
        FROM distances d, background WHERE key_sim IN ('Transport_Freight_Lorry_32_EURO5', 'Transport_Freight_Sea')) GROUP BY ALL)"""
PROCESS_PIVOT = ", ".join(f"coalesce(sum(x) FILTER (WHERE key_spread = '{k}'), 0) AS {v}" for k, v in PROCESS_STAGES.items())
PROCESSED = f""",
processed AS (SELECT Id_sample, {CAT}, {PROCESS_PIVOT} FROM (SELECT p.Id_sample, p.key_spread, {CAT}, impact * recommended_value AS x
  FROM processing p JOIN background b USING (key_sim) WHERE key_sim <> 'Electricity') GROUP BY ALL),
electric AS (SELECT Id_sample, region_name, {CAT}, sum(x) FILTER (WHERE key_spread = 'Electricity') AS i_p_electricity_pd,
  sum(x) FILTER (WHERE key_spread = 'Electricity_m') AS i_p_electricity_m_pd FROM (SELECT p.Id_sample, key_spread, {CAT}, impact * recommended_value AS x,
    CASE b.key_sim WHEN 'Electricity_Low_Voltage_voltage_BR_Mid_western' THEN 'Mid_western' WHEN 'Electricity_Low_Voltage_voltage_BR_Northern' THEN 'Northern'
      WHEN 'Electricity_Low_Voltage_voltage_BR_North_eastern' THEN 'North_eastern' WHEN 'Electricity_Low_Voltage_voltage_BR_South_eastern' THEN 'South_eastern'
      ELSE 'Southern' END AS region_name
    FROM processing p, background b WHERE p.key_sim = 'Electricity' AND b.key_sim ILIKE '%Electricity_Low_Voltage_voltage%') GROUP BY ALL),
combusted AS (SELECT Id_sample, {CAT}, {_strict('value_emission * value')} AS i_p_fuel_combustion_of FROM burnt JOIN cfs USING (substance_ac) GROUP BY ALL)"""

ALIGN = "lined AS (SELECT * REPLACE (" + ", ".join(
    (lambda x: f"{x} AS {c}")(
        (lambda x: f"({x}) * land_use / nullif(soy_eq, 0)" if c in LAND_STAGES else x)(
            (lambda x: f"{x} - {x} * sh_dcp * 0.5" if c in ("i_f_Amendment_of", "i_f_Amendment_pd", "i_luclu_above_biomass", "i_luclu_soc") else x)(
                f"(1000 * {c})" if c in FARM_STAGES + PROC_STAGES + MEAL_STAGES else c)))
    for c in ALL_STAGES) + ") FROM master)"
IDENT = "Id_sample, " + KEY + ", " + CAT


def footprint_sql(volume: str, values: dict[str, str]) -> str:
    cols = ", ".join(f"{x} AS {c}" for c, x in values.items())
    total = " + ".join(values)
    return f"WITH {ALIGN}, f AS (SELECT {IDENT}, land_use, {volume}, {cols} FROM lined WHERE {volume} <> 0), " \
        f"t AS (SELECT *, {total} AS impact FROM f) SELECT {IDENT}, land_use, {volume}, {round_sql(values)}, round(impact, 6) AS impact, " \
        f"round(impact / {volume}, 6) AS impact_ton FROM t"


def _product_sql(p: I.Product) -> str:
    if p.allocation:
        home, abroad, mass = p.allocation
        f = f"(CASE WHEN import_country_name = 'BRAZIL' THEN {home} ELSE {abroad} END)"
        return footprint_sql(p.volume, {c: f"{f} * {c} / {mass} * {p.volume}" for c in p.stages})
    return footprint_sql(p.volume, {c: f"{c} * {p.volume}" for c in p.stages})


FOLD = {"i_p_electricity_pd": "i_p_electricity_m_pd", "i_p_Tapwater_pd": "i_p_Tapwater_m_pd", "i_p_Naturalgas_pd": "i_p_Naturalgas_m_pd"}
EQUIVALENT = {c: "(" + (f"{c} * (sh_cake + sh_oil)" if c in PROC_STAGES else c) + (f" + {FOLD[c]} * sh_meal" if c in FOLD else "") + ") * soy_eq"
              for c in [*LAND_STAGES, *FARM_STAGES, *PROC_STAGES, *TRANSPORT_STAGES]}


def _aligned(s, d):
    return I.align_units(load(s, d, "master"))


def _rounded_footprint(df, stages):
    return rounded(df, [*stages, "impact", "impact_ton"])


def checks() -> dict:
    out = {}

    def add(name, query, sql=None):
        out[name] = (query, oracle(sql) if sql else None)

    base = ["biome", "municipality_code", "ipcc_code", "state_code", "year", "map_biomas_class_code", "burnt", "burnt1", "luclu",
            "area_ha", "csoc_me", "type_land_area", "map_biomas_class", "area_eco_zone"]
    add("E01_zone_matching",
        lambda s, d: E.match_zones(load(s, d, "zone"), load(s, d, "cover"), E.parameter_bounds(load(s, d, "carbon"))).select(*base),
        f"WITH {MATCHED} SELECT {', '.join(base)} FROM matched")
    carried = ["municipality_code", "year", "map_biomas_class_code", "luclu", "burnt", "burnt1", "ipcc_code", "Id_sample"]
    add("E02_zone_weights_and_draws",
        lambda s, d: rounded(E.draw_stocks(_weighed(s, d), N).select(*carried, "area_ha", "p_area_bm", *E.DRAWS), ["p_area_bm", *E.DRAWS], 7),
        f"WITH {STOCKS} SELECT {', '.join(carried)}, area_ha, {round_sql(['p_area_bm', *DRAWN], 7)} FROM stocks")
    gases = [*E.EMISSIONS, "COe"]
    add("E03_emission_formulas", lambda s, d: rounded(_emitted(s, d).select(*carried, *gases), gases, 4),
        f"WITH {EMITTED} SELECT {', '.join(carried)}, {round_sql(gases, 4)} FROM emitted")
    add("E04_zone_rollup", lambda s, d: rounded(_by_class(s, d), E.EMISSIONS, 4),
        f"WITH {EMITTED} SELECT {', '.join(E.CLASS_KEYS)}, {round_sql(E.EMISSIONS, 4)} FROM by_class")
    add("E05_class_rollup", lambda s, d: rounded(E.roll_up_classes(_by_class(s, d)), E.EMISSIONS, 4),
        f"WITH {EMITTED} SELECT {', '.join(E.DEMAND_KEYS)}, area_ha, {round_sql(E.EMISSIONS, 4)} FROM by_demand")
    add("E06_emissions_per_hectare", lambda s, d: rounded(E.emissions_per_hectare(E.roll_up_classes(_by_class(s, d))), E.EMISSIONS, 5),
        f"WITH {EMITTED} SELECT Id_sample, municipality_code, year, area_ha, {round_sql(E.EMISSIONS, 5)} FROM per_ha")
    add("E07_origin_emissions", _placed, f"WITH {ORIGINS} SELECT * FROM placed")
    add("E08_emission_tier_fill", lambda s, d: rounded(_filled(s, d), ["area_ha", *E.EMISSIONS]),
        f"WITH {ORIGINS},{CARBON_FILL} SELECT * EXCLUDE (area_ha, {', '.join(E.EMISSIONS)}), {round_sql(['area_ha', *E.EMISSIONS])} FROM carbon_full")
    add("E08_missing_emissions", lambda s, d: E.missing_emissions(_placed(s, d)).select("municipality_code", "year", "Id_sample", "soy_eq"),
        f"WITH {ORIGINS} SELECT municipality_code, year, Id_sample, soy_eq FROM placed WHERE area_ha IS NULL")
    add("E09_emissions_by_substance",
        lambda s, d: rounded(E.emissions_by_substance(_filled(s, d)), ["area_ha", "value_emission"]),
        f"WITH {ORIGINS},{CARBON_FILL},{LONG} SELECT * EXCLUDE (area_ha, value_emission), {round_sql(['area_ha', 'value_emission'])} FROM long")

    add("B01_ecoregion_shares", lambda s, d: rounded(B.ecoregion_shares(load(s, d, "overlap")), ["pt_int_amun"]),
        f"WITH {ECOSHARE} SELECT * EXCLUDE (pt_int_amun), {round_sql(['pt_int_amun'])} FROM ecoshare")
    add("B02_land_by_class", _classed, f"WITH {LAND} SELECT * FROM classed")
    add("B03_occupied_transformed", lambda s, d: B.split_land(_classed(s, d)), f"WITH {LAND} SELECT * FROM land")
    add("B04_land_tier_fill", lambda s, d: rounded(_land(s, d), ["occ", "trans"]),
        f"WITH {LAND_FILL} SELECT {UNIT}, tdata_lcrop, {round_sql(['occ', 'trans'])} FROM land_full")
    add("B05_intensity_class", lambda s, d: B.classify_intensity(_land(s, d)).select("municipality_code", "year", "soy_yield", "habitat_id"),
        f"WITH {INTENSE} SELECT municipality_code, year, soy_yield, habitat_id FROM intense")
    marks = [f"cf_{k}_glo_{t}" for k in ["occ", "tra"] for t in ["md", "min", "max"]]
    add("B06_land_factor_summary", _q("land_cf", lambda c: rounded(B.summarise_land_factors(c), marks)),
        f"WITH {SUMMARY} SELECT {', '.join(B.CF_KEYS)}, {round_sql(marks)} FROM summary")
    add("B07_land_factor_draws", _q("land_cf", lambda c: rounded(B.draw_land_factors(B.summarise_land_factors(c), N), ["cf_occ_glo", "cf_tra_glo"])),
        f"WITH {SUMMARY} SELECT Id_sample, eco_id, habitat_id, habitat, {round_sql(['cf_occ_glo', 'cf_tra_glo'])} FROM cf_draw")
    stress_keys = "Id_sample, region_name, state_code, municipality_code, year, double_cropping_share"
    add("B08_stress_factors",
        lambda s, d: rounded(_stress(s, d), ["occ", "trans", "cf_occ_glo", "cf_tra_glo"], 5),
        f"WITH {STRESS} SELECT {stress_keys}, {round_sql(['occ', 'trans', 'cf_occ_glo', 'cf_tra_glo'], 5)} FROM stress")
    add("B09_double_cropping_factor",
        lambda s, d: rounded(B.adjust_double_cropping(_stress(s, d)).drop("occ", "trans"), ["cf_occ_glo", "cf_tra_glo", "cf_tra_glo_dc"], 5),
        f"WITH {STRESS} SELECT {stress_keys}, {round_sql(['cf_occ_glo', 'cf_tra_glo'], 5)}, round(cf_tra_glo * double_cropping_share * 0.5 "
        "+ cf_tra_glo * (1 - double_cropping_share), 5) AS cf_tra_glo_dc FROM stress")

    measures = ["recommended_value", "lower_limit", "upper_limit", "sd"]
    for tag, (scope, _) in SCOPES.items():
        keys = [*scope.keys, "key_sim", "lca"]
        add(f"L01_inventory_{tag}",
            lambda s, d, scope=scope: L.aggregate_inventory(load(s, d, "inventory"), scope),
            f"WITH {inventory_cte(tag)} SELECT {', '.join(keys)}, {', '.join(measures)} FROM i_{tag}")
        add(f"L02_ids_{tag}",
            lambda s, d, scope=scope, keys=keys: L.identify(L.aggregate_inventory(load(s, d, "inventory"), scope), scope)
            .select(*keys, "id_sim", "id_sim1", "n"),
            f"WITH {inventory_cte(tag)} SELECT {', '.join(keys)}, id_sim, id_sim1, n FROM tier_{tag}")
        add(f"L03_evidence_tier_{tag}", lambda s, d, tag=tag: _prepared(s, d, tag).select("id_sim", "lca", "n", "titem"),
            f"WITH {inventory_cte(tag)} SELECT id_sim, lca, n, titem FROM tier_{tag}")
        add(f"L04_study_resample_{tag}",
            lambda s, d, tag=tag: L.sample_studies(_prepared(s, d, tag), N).select("Id_sample", "id_sim", "lca", "titem", "recommended_value"),
            f"WITH {inventory_cte(tag)} SELECT Id_sample, id_sim, lca, titem, recommended_value FROM pick_{tag}")
        add(f"L05_assembly_{tag}", lambda s, d, tag=tag: rounded(_shown(s, d, tag), ["recommended_value"]),
            f"WITH {inventory_cte(tag)} SELECT Id_sample, id_sim1, id_sim, lca, key_sim, n, titem, {round_sql(['recommended_value'])} FROM full_{tag}")
    for tag in ["state", "region"]:
        place = SCOPES[tag][0].parts[0]
        add(f"L06_activity_split_{tag}",
            lambda s, d, tag=tag: rounded(L.field_rows(_active(s, d, tag)), ["recommended_value"]),
            f"WITH {FUEL},{field_cte(tag)} SELECT Id_sample, lca, key_sim, n, titem, {place}, type_activity_data2, activity_data1, "
            f"{round_sql(['recommended_value'])} FROM act_{tag} WHERE type_activity_data2 IN ('fertiliser', 'soil_correctors', 'machinery')")
        extra = ["N2Oi_ef", "N2Od_ef", "NH3_ef", "NOx_ef", "C_ef"]
        add(f"L07_factor_attach_{tag}",
            lambda s, d, tag=tag, place=place: rounded(L.attach_factors(L.field_rows(_active(s, d, tag)), load(s, d, "factors"), load(s, d, "content"), N)
                                          .select("Id_sample", place, "lca", "activity_data1", "N_content", "C_content", *extra), extra, 9),
            f"WITH {FUEL},{field_cte(tag)} SELECT Id_sample, {place}, lca, activity_data1, N_content, C_content, {round_sql(extra, 9)} FROM fact_{tag}")
        add(f"L08_field_emissions_{tag}",
            lambda s, d, tag=tag, place=place: rounded(_field(s, d, tag).select("Id_sample", place, "lca", "activity_data1", *[f"`{x}`" for x in FIELD_SUBSTANCES]), FIELD_SUBSTANCES),
            f"WITH {FUEL},{field_cte(tag)} SELECT Id_sample, {place}, lca, activity_data1, {round_sql(FIELD_SUBSTANCES)} FROM field_{tag}")
        add(f"L09_field_totals_{tag}", lambda s, d, tag=tag: rounded(_total(s, d, tag), ["value_emission"]),
            f"WITH {FUEL},{total_cte(tag, SCOPES[tag][0].substances)} SELECT Id_sample, {place}, type_activity_data2, substance_ac, "
            f"{round_sql(['value_emission'])} FROM total_{tag}")
    add("L10_meal_flows", lambda s, d: rounded(_processing(s, d), ["recommended_value"], 9),
        f"WITH {MEAL} SELECT Id_sample, id_sim, lca, key_sim, CAST(n AS BIGINT) AS n, CAST(titem AS INT) AS titem, key_spread, {round_sql(['recommended_value'], 9)} FROM processing")
    add("L11_combustion", lambda s, d: rounded(_combustion(s, d), ["value_emission"]),
        f"WITH {BURNT} SELECT Id_sample, substance_ac, {round_sql(['value_emission'])} FROM burnt")

    add("D01_transport_links", _q("trade", D.transport_links), f"WITH {DISTANCES} SELECT * FROM tlinks")
    add("D02_domestic_distance",
        lambda s, d: D.attach_domestic_distance(D.transport_links(load(s, d, "trade")), load(s, d, "road")),
        f"WITH {DISTANCES} SELECT * EXCLUDE (international_distance) FROM distances")
    add("D03_international_distance", _distances, f"WITH {DISTANCES} SELECT * FROM distances")
    add("D04_distance_impact", lambda s, d: rounded(D.distance_impacts(_distances(s, d), _background(s, d)), TRANSPORT_STAGES),
        f"WITH {TRANSPORT} SELECT {TLINK}, {CAT}, {round_sql(TRANSPORT_STAGES)} FROM transport")

    add("I01_factor_scope", lambda s, d: I.in_scope(load(s, d, "cf")), f"WITH {CF} SELECT * FROM cfs")
    add("I02_background_impacts", lambda s, d: rounded(_background(s, d), ["impact"]),
        f"WITH {BACKGROUND} SELECT * EXCLUDE (impact), {round_sql(['impact'])} FROM background")
    add("I03_impact_catalogue", lambda s, d: I.impact_catalogue(_background(s, d)), f"WITH {CATALOGUE} SELECT * FROM catalogue")
    add("I04_master_matrix", lambda s, d: rounded(_master(s, d), list(I.MASTER_MEANS)),
        f"WITH {MATRIX} SELECT * EXCLUDE ({', '.join(I.MASTER_MEANS)}), {round_sql(I.MASTER_MEANS)} FROM matrix")
    mkeys = ["Id_sample", "municipality_code", "export_port_code1", "import_country_name", "year", "impact_category", "damage", "unit_impact"]
    stressed = ["i_land_occupation", "i_land_transformation"]
    add("I05_land_stress",
        lambda s, d: rounded(I.master_matrix(I.attach_land_stress(_matrix(s, d), B.adjust_double_cropping(_stress(s, d)), N), N).select(*mkeys, *stressed), stressed, 5),
        f"WITH {MATRIX},{STRESS} SELECT {', '.join('m.' + k for k in mkeys)}, round(s.cf_occ_glo, 5) AS i_land_occupation, "
        "round(s.cf_tra_glo * s.double_cropping_share * 0.5 + s.cf_tra_glo * (1 - s.double_cropping_share), 5) AS i_land_transformation "
        "FROM matrix m LEFT JOIN stress s ON m.Id_sample = s.Id_sample AND m.region_name = s.region_name AND m.state_code = s.state_code "
        "AND m.municipality_code = s.municipality_code AND m.year = s.year AND m.damage = 'Terrestrial ecosystems' "
        "AND m.impact_category = 'Land stress, TE, average'")
    carbon = ["i_luclu_above_biomass", "i_luclu_soc"]
    add("I06_carbon_impact",
        lambda s, d: rounded(I.master_matrix(I.attach_carbon(_matrix(s, d), I.carbon_stock_impacts(E.emissions_by_substance(
            _filled(s, d)), load(s, d, "cf")), N), N).fillna(0).select(*mkeys, *carbon), carbon, 9),
        f"""WITH {MATRIX},{ORIGINS},{CARBON_FILL},{LONG},{CF}, k AS (SELECT Id_sample, municipality_code, year, damage, impact_category, unit_impact,
  sum(value_emission * value) FILTER (WHERE subc1 = 'ibmb') AS a, sum(value_emission * value) FILTER (WHERE subc1 = 'iSOC') AS b
  FROM long JOIN cfs USING (substance_ac) GROUP BY ALL)
SELECT {', '.join('m.' + k for k in mkeys)}, round(coalesce(a, 0), 9) AS i_luclu_above_biomass, round(coalesce(b, 0), 9) AS i_luclu_soc
FROM matrix m LEFT JOIN k ON m.Id_sample = k.Id_sample AND m.municipality_code = k.municipality_code AND m.year = k.year AND m.damage = k.damage
  AND m.impact_category = k.impact_category AND m.unit_impact = k.unit_impact""")
    for tag in ["state", "region"]:
        place = SCOPES[tag][0].parts[0]
        farm = f"WITH {FUEL},{BACKGROUND},{CF},{farm_cte(tag, SCOPES[tag][0].substances)}"
        cols = f"Id_sample, {place}, type_activity_data2, {CAT}, {round_sql(['i_frm'])}"
        add(f"I07_farm_background_{tag}", lambda s, d, tag=tag: rounded(_upstream(s, d, tag), ["i_frm"]), f"{farm} SELECT {cols} FROM up_{tag} WHERE i_frm IS NOT NULL")
        add(f"I08_farm_field_{tag}", lambda s, d, tag=tag: rounded(_onfield(s, d, tag), ["i_frm"]), f"{farm} SELECT {cols} FROM on_{tag} WHERE i_frm IS NOT NULL")
        add(f"I09_farm_stages_{tag}", lambda s, d, tag=tag: rounded(_farm(s, d, tag), FARM_STAGES),
            f"{farm} SELECT Id_sample, {place}, {CAT}, {round_sql(FARM_STAGES)} FROM farm_{tag}")
    both = f"WITH {FUEL},{MATRIX},{CF},{farm_cte('state', SCOPES['state'][0].substances)},{farm_cte('region', SCOPES['region'][0].substances)}"
    same = " AND ".join(f"m.{k} = {{t}}.{k}" for k in ["Id_sample", "method", "impact_category", "unit_impact", "damage"])
    add("I10_scope_selection",
        lambda s, d: rounded(I.master_matrix(I.attach_farming(_matrix(s, d), _farm(s, d, "state"), _farm(s, d, "region"), N), N)
                             .select(*mkeys, *FARM_STAGES), FARM_STAGES),
        both + f" SELECT {', '.join('m.' + k for k in mkeys)}, " + ", ".join(
            f"round(CASE WHEN dummy_uf_reg = 'uf' THEN s.{c} ELSE r.{c} END, 6) AS {c}" for c in FARM_STAGES)
        + f" FROM matrix m LEFT JOIN farm_state s ON {same.format(t='s')} AND CAST(m.state_code AS VARCHAR) = s.state_code "
        f"LEFT JOIN farm_region r ON {same.format(t='r')} AND m.region_name = r.region_name")
    processing = f"WITH {BURNT},{BACKGROUND},{CF}{PROCESSED}"
    pcols = list(PROCESS_STAGES.values())
    add("I11_processing_background", lambda s, d: rounded(I.processing_background_impacts(_processing(s, d), _background(s, d)), pcols),
        f"{processing} SELECT Id_sample, {CAT}, {round_sql(pcols)} FROM processed")
    ecols = ["i_p_electricity_pd", "i_p_electricity_m_pd"]
    add("I12_regional_electricity", lambda s, d: rounded(I.electricity_impacts(_processing(s, d), _background(s, d)), ecols),
        f"{processing} SELECT Id_sample, region_name, {CAT}, {round_sql(ecols)} FROM electric")
    add("I13_combustion_impact", lambda s, d: rounded(I.combustion_impacts(_combustion(s, d), load(s, d, "cf")), ["i_p_fuel_combustion_of"]),
        f"{processing} SELECT Id_sample, {CAT}, {round_sql(['i_p_fuel_combustion_of'])} FROM combusted")
    attached = [*pcols, *ecols, "i_p_fuel_combustion_of", *TRANSPORT_STAGES]

    def _staged(s, d):
        background, rows, trade = _background(s, d), _processing(s, d), hold(s, d, "trade")
        matrix = I.attach_transport(_matrix(s, d, trade), D.distance_impacts(_distances(s, d, trade), background))
        matrix = I.attach_processing(
            matrix, I.processing_background_impacts(rows, background), I.electricity_impacts(rows, background),
            I.combustion_impacts(_combustion(s, d), load(s, d, "cf")), N)
        return I.complete_master(I.master_matrix(matrix, N).withColumns({c: F.lit(0.0) for c in [*LAND_STAGES, *FARM_STAGES]}))

    add("I14_stage_attachment", lambda s, d: rounded(_staged(s, d).select(*mkeys, *attached), attached),
        f"WITH {BURNT},{MATRIX},{CF}{PROCESSED},{DISTANCES},{TRANSPORT[len(DISTANCES) + len(BACKGROUND) + 2:].strip().lstrip(',')} "
        f"SELECT {', '.join('m.' + k for k in mkeys)}, " + ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in attached)
        + f" FROM matrix m LEFT JOIN processed p ON {same.format(t='p')} LEFT JOIN electric e ON {same.format(t='e')} AND m.region_name = e.region_name "
        f"LEFT JOIN combusted c ON {same.format(t='c')} LEFT JOIN transport t ON "
        + " AND ".join(f"m.{k} = t.{k}" for k in [*D.LINK_KEYS, "method", "impact_category", "unit_impact", "damage"]))
    add("I15_unit_alignment", lambda s, d: rounded(_aligned(s, d).select("Id_sample", *I.MASTER_KEYS, *ALL_STAGES), ALL_STAGES),
        f"WITH {ALIGN} SELECT Id_sample, {KEY}, {round_sql(ALL_STAGES)} FROM lined")
    add("I16_footprint_equivalent", lambda s, d: _rounded_footprint(I.equivalent_footprint(_aligned(s, d)), EQUIVALENT),
        footprint_sql("soy_eq", EQUIVALENT))
    for name, product in [("I17_footprint_beans", I.BEANS), ("I18_footprint_meal", I.MEAL), ("I19_footprint_cake", I.CAKE),
                          ("I20_footprint_oil", I.OIL)]:
        add(name, lambda s, d, product=product: _rounded_footprint(I.product_footprint(_aligned(s, d), product), product.stages),
            _product_sql(product))
    return out
