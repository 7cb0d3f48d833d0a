"""Grid, zone and sampling queries and their SQL oracles."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from furrow.operators import grid as S
from furrow.operators import sampling as M
from furrow.operators.relational import expand_samples
from furrow.sources.stages import stage, stage_root
from furrow.sources.tables import save_pixels
from verification import draw_sql as D
from verification.flow_checks import _q, round_sql, rounded
from verification.views import load, oracle

WEST, NORTH, WIDTH, HEIGHT = -60.0, 80.0, 0.25, 0.0005
NSIM = 20

AREA = (f"(6371.0072 * 6371.0072) * radians({WIDTH}) * "
        f"(sin(radians(y + {HEIGHT} / 2)) - sin(radians(y - {HEIGHT} / 2)))")
IN_UNIT = "cell_row BETWEEN u.row_min AND u.row_max AND cell_col BETWEEN u.col_min AND u.col_max"
ALIGNED = f"""
cov AS (SELECT coalesce(a.cell_row, b.cell_row) AS cell_row, coalesce(a.cell_col, b.cell_col) AS cell_col,
    coalesce(a.y, b.y) AS y, coalesce(a.year, b.year + 3) AS year, a.value AS cov1, b.value AS cov0
  FROM (SELECT * FROM pixel WHERE layer = 'cover') a FULL JOIN (SELECT * FROM pixel WHERE layer = 'cover') b
    ON a.cell_row = b.cell_row AND a.cell_col = b.cell_col AND a.year = b.year + 3),
aligned AS (SELECT c.*, s1.value AS soc1, s0.value AS soc0, f.value AS burnt, {AREA.replace("(y ", "(c.y ")} AS area FROM cov c
  LEFT JOIN (SELECT * FROM pixel WHERE layer = 'soc') s1 ON s1.cell_row = c.cell_row AND s1.cell_col = c.cell_col AND s1.year = c.year
  LEFT JOIN (SELECT * FROM pixel WHERE layer = 'soc') s0 ON s0.cell_row = c.cell_row AND s0.cell_col = c.cell_col AND s0.year = c.year - 3
  LEFT JOIN (SELECT * FROM pixel WHERE layer = 'burn') f ON f.cell_row = c.cell_row AND f.cell_col = c.cell_col AND f.year = c.year - 3),
crop_cell AS (SELECT *, soc1 - soc0 AS csoc FROM aligned WHERE cov1 = 39)"""

CLEAN = """
linked AS (SELECT o.*, c.cov0, c.cov1, c.burnt, c.npixel, c.csoc_md, c.area FROM origin o LEFT JOIN change c
  ON o.municipality_code = c.municipality_code AND o.year = c.year),
clean AS (SELECT * EXCLUDE (cov0, burnt), CAST(CASE WHEN coalesce(cov0, 0) = 0 THEN 39 ELSE cov0 END AS BIGINT) AS map_biomas_class_code,
  CAST(coalesce(burnt, 2) AS INT) AS burnt,
  CAST(CASE WHEN burnt = 1 AND coalesce(cov0, 0) IN (3, 4, 12) THEN 1 ELSE 0 END AS INT) AS burnt1 FROM linked),
rolled AS (SELECT biome, state_code, municipality_code, year, map_biomas_class_code, burnt, burnt1,
  CASE WHEN count(*) = count(area) THEN sum(area) * 100 END AS area_ha, avg(csoc_md) AS csoc_md FROM clean GROUP BY ALL),
labelled AS (SELECT *, CASE WHEN map_biomas_class_code IN (39, 20, 40, 41, 62) THEN 'LU' ELSE 'LUC' END AS luclu FROM rolled),
scaled AS (SELECT *, """ + ", ".join(
    f"{fn}(csoc_md) OVER (PARTITION BY {', '.join(keys)}) AS {name}{i}"
    for i, keys in enumerate(S.SCALES) for fn, name in [("median", "csoc_me"), ("min", "csoc_min"), ("max", "csoc_max")]) + """
  FROM labelled),
chosen AS (SELECT biome, state_code, municipality_code, year, map_biomas_class_code, burnt, burnt1, area_ha, csoc_md, luclu, """ + ", ".join(
    f"CASE WHEN {n}2 IS NULL THEN {n}3 WHEN {n}1 IS NULL THEN {n}2 WHEN {n}0 IS NULL THEN {n}1 ELSE {n}0 END AS {n}"
    for n in ["csoc_me", "csoc_min", "csoc_max"]) + """ FROM scaled),
shared AS (SELECT *, area_ha / nullif(CASE WHEN count(*) OVER w = count(area_ha) OVER w THEN sum(area_ha) OVER w END, 0) AS p_area
  FROM chosen WINDOW w AS (PARTITION BY municipality_code, year))"""
SCALED = [f"{n}{i}" for i in range(4) for n in ["csoc_me", "csoc_min", "csoc_max"]]
CHOSEN = ["csoc_me", "csoc_min", "csoc_max"]
COVER = "biome, state_code, municipality_code, year, map_biomas_class_code, burnt, burnt1"

ZONE_CASE = """CAST(CASE WHEN ipcc_code IN (201, 202) THEN 2012 WHEN ipcc_code > 400 AND ipcc_code < 408 THEN 400
  WHEN ipcc_code = 100 AND biome = 'AMAZONIA' THEN 1001
  WHEN ipcc_code = 100 AND biome IN ('CERRADO', 'CAATINGA', 'MATA ATLANTICA') THEN 1002
  WHEN ipcc_code = 100 AND biome IN ('PANTANAL', 'PAMPA') THEN 1003
  WHEN ipcc_code = 105 AND biome IN ('AMAZONIA', 'CERRADO', 'CAATINGA', 'PANTANAL') THEN 1051
  WHEN ipcc_code = 105 AND biome IN ('MATA ATLANTICA', 'PAMPA') THEN 1052
  WHEN ipcc_code = 106 AND biome IN ('AMAZONIA', 'CERRADO', 'CAATINGA', 'PANTANAL') THEN 1061
  WHEN ipcc_code = 106 AND biome IN ('MATA ATLANTICA', 'PAMPA') THEN 1062 ELSE ipcc_code END AS BIGINT)"""
ZONES = f"""zones AS (SELECT u.municipality_code, CAST(p.value AS BIGINT) AS ipcc_code, sum({AREA}) AS area_eco_zone
  FROM pixel p JOIN unit u ON {IN_UNIT} WHERE layer = 'zone' GROUP BY ALL)"""


def linked(s, d):
    return S.attach_change(load(s, d, "origin"), load(s, d, "change"))


def labelled(s, d):
    return S.label_land_demand(S.roll_up_cover(S.clean_cover(linked(s, d))))


def bucketed(s, d):
    tag = uuid4().hex
    return save_pixels(load(s, d, "pixel"), f"pixels_{tag}", f"{stage_root(s)}/furrow/pixels-{tag}", 8)


def _zones(s, d):
    return S.zone_areas(load(s, d, "pixel"), load(s, d, "unit"), WIDTH, HEIGHT)


def checks() -> dict:
    out = {}

    def add(name, query, sql=None):
        out[name] = (query, oracle(sql) if sql else None)

    add("S01_unit_attributes",
        lambda s, d: S.cell_extents(S.unit_attributes(load(s, d, "shape")), WEST, NORTH, WIDTH, HEIGHT)
        .select("municipality_code", "municipality_name", "row_min", "row_max", "col_min", "col_max"),
        "SELECT municipality_code, municipality_name, row_min, row_max, col_min, col_max FROM unit")
    add("S02_origin_units", _q("flow", S.origin_units), "SELECT DISTINCT municipality_code FROM flow")
    add("S03_extent_crop",
        lambda s, d: S.crop(load(s, d, "pixel"), load(s, d, "unit")).groupBy("municipality_code", "layer", "year")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cell_row").alias("rows"), F.sum("cell_col").alias("cols")),
        f"SELECT u.municipality_code, layer, year, count(*) AS n, CAST(sum(cell_row) AS BIGINT) AS rows, CAST(sum(cell_col) AS BIGINT) AS cols "
        f"FROM pixel p JOIN unit u ON {IN_UNIT} GROUP BY ALL")
    add("S04_cell_area",
        _q("pixel", lambda p: p.groupBy("cell_row", "y").agg(F.count(F.lit(1)).alias("n"))
           .withColumn("area", F.round(S.cell_area_km2("y", WIDTH, HEIGHT), 7))),
        f"SELECT cell_row, y, count(*) AS n, round({AREA}, 7) AS area FROM pixel GROUP BY ALL")
    add("S05_zone_area", lambda s, d: rounded(_zones(s, d), ["area_eco_zone"]),
        f"WITH {ZONES} SELECT municipality_code, ipcc_code, {round_sql(['area_eco_zone'])} FROM zones")
    columns = ["cell_row", "cell_col", "year", "cov1", "cov0", "soc1", "soc0", "burnt"]
    add("S06_layer_alignment",
        _q("pixel", lambda p: S.align_layers(p, WIDTH, HEIGHT).select(*columns, F.round("area", 7).alias("area"))),
        f"WITH {ALIGNED} SELECT {', '.join(columns)}, round(area, 7) AS area FROM aligned")
    add("S06_bucketed_alignment",
        lambda s, d: S.align_layers(bucketed(s, d), WIDTH, HEIGHT).select(*columns, F.round("area", 7).alias("area")),
        f"WITH {ALIGNED} SELECT {', '.join(columns)}, round(area, 7) AS area FROM aligned")
    add("S07_crop_cells",
        _q("pixel", lambda p: S.planted_cells(p, WIDTH, HEIGHT).select(*columns, "csoc")),
        f"WITH {ALIGNED} SELECT {', '.join(columns)}, csoc FROM crop_cell")
    add("S08_change_matrix",
        lambda s, d: rounded(S.change_matrix(S.planted_cells(stage(load(s, d, "pixel"), "pixel"), WIDTH, HEIGHT, load(s, d, "unit")), load(s, d, "unit")),
                             ["csoc_md", "area"]),
        f"WITH {ALIGNED} SELECT u.municipality_code, year, cov0, cov1, burnt, count(*) AS npixel, round(avg(csoc), 6) AS csoc_md, "
        f"round(sum(area), 6) AS area FROM crop_cell c JOIN unit u ON {IN_UNIT} GROUP BY ALL")
    add("S09_origin_change", linked, f"WITH {CLEAN} SELECT * FROM linked")
    add("S10_cover_cleanup", lambda s, d: S.clean_cover(linked(s, d)), f"WITH {CLEAN} SELECT * FROM clean")
    add("S11_cover_rollup", lambda s, d: rounded(S.roll_up_cover(S.clean_cover(linked(s, d))), ["csoc_md"]),
        f"WITH {CLEAN} SELECT {COVER}, area_ha, {round_sql(['csoc_md'])} FROM rolled")
    add("S12_land_demand", lambda s, d: labelled(s, d).groupBy("municipality_code", "year", "luclu").agg(
        F.count(F.lit(1)).alias("n"), F.sum("area_ha").alias("area_ha")),
        f"WITH {CLEAN} SELECT municipality_code, year, luclu, count(*) AS n, sum(area_ha) AS area_ha FROM labelled GROUP BY ALL")
    add("S13_scale_bounds", lambda s, d: rounded(S.scale_bounds(labelled(s, d)).drop("csoc_md"), SCALED),
        f"WITH {CLEAN} SELECT {COVER}, area_ha, luclu, {round_sql(SCALED)} FROM scaled")
    add("S14_bounds_fallback", lambda s, d: rounded(S.choose_bounds(S.scale_bounds(labelled(s, d))).drop("csoc_md"), CHOSEN),
        f"WITH {CLEAN} SELECT {COVER}, area_ha, luclu, {round_sql(CHOSEN)} FROM chosen")
    add("S15_area_share", lambda s, d: rounded(S.area_shares(labelled(s, d)).drop("csoc_md"), ["p_area"]),
        f"WITH {CLEAN} SELECT {COVER}, area_ha, luclu, {round_sql(['p_area'])} FROM shared")
    add("S16_class_recode",
        lambda s, d: S.split_amazon_forest(labelled(s, d)).groupBy("biome", "map_biomas_class_code").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {CLEAN} SELECT biome, CASE WHEN biome = 'AMAZONIA' AND map_biomas_class_code = 9 THEN 10 ELSE map_biomas_class_code END "
        "AS map_biomas_class_code, count(*) AS n FROM labelled GROUP BY ALL")
    add("S16_zone_recode",
        lambda s, d: rounded(S.recode_zones(S.zones_by_biome(load(s, d, "origin"), _zones(s, d))), ["area_eco_zone"]),
        f"""WITH {ZONES}, z AS (SELECT b.biome, b.municipality_code, ipcc_code, area_eco_zone
  FROM (SELECT DISTINCT biome, municipality_code FROM origin) b LEFT JOIN (SELECT * FROM zones WHERE ipcc_code IS NOT NULL) z
    ON b.municipality_code = z.municipality_code WHERE biome IS NOT NULL)
SELECT biome, municipality_code, {ZONE_CASE} AS ipcc_code, {round_sql(['area_eco_zone'])} FROM z""")
    add("S17_zones_by_biome",
        lambda s, d: rounded(S.zones_by_biome(load(s, d, "origin"), _zones(s, d)), ["area_eco_zone"]),
        f"""WITH {ZONES} SELECT b.biome, b.municipality_code, ipcc_code, {round_sql(['area_eco_zone'])}
FROM (SELECT DISTINCT biome, municipality_code FROM origin) b LEFT JOIN (SELECT * FROM zones WHERE ipcc_code IS NOT NULL) z
  ON b.municipality_code = z.municipality_code WHERE biome IS NOT NULL""")

    # --- sampling ----------------------------------------------------------------------------
    add("M01_sample_expansion", _q("bounds", lambda b: expand_samples(b.select("k", "mode"), NSIM)),
        "WITH x AS (" + D.samples("(SELECT k, mode FROM bounds)", NSIM) + ") SELECT * FROM x")
    add("M02_triangular_draws",
        _q("bounds", lambda b: rounded(M.triangular_draws(b, {"draw": ("low", "mode", "high")}, ["k"], NSIM, ["k"]), ["draw"])),
        f"WITH x AS ({D.uniforms('(' + D.samples('bounds', NSIM) + ')', {'d': D.stream('draw', 'k')})}) "
        f"SELECT k, Id_sample, round({D.triangular('u_d', 'low', 'mode', 'high')}, 6) AS draw FROM x")
    add("M03_shared_draws",
        _q("bounds", lambda b: rounded(M.triangular_draws(b, {"draw": ("low", "mode", "high")}, ["k"], NSIM, ["k"], shared=True), ["draw"])),
        f"WITH x AS ({D.uniforms('(' + D.samples('bounds', NSIM) + ')', {'d': D.stream('draw')})}) "
        f"SELECT k, Id_sample, round({D.triangular('u_d', 'low', 'mode', 'high')}, 6) AS draw FROM x")
    factor_columns = [*M.FACTOR_DRAWS, "C_ef"]
    add("M04_factor_draws", _q("factors", lambda f: rounded(M.factor_draws(f, NSIM), factor_columns, 9)), FACTOR_SQL
        + f" SELECT Id_sample, {round_sql(factor_columns, 9)} FROM factor_draw")
    add("M05_study_resample",
        _q("inventory", lambda v: M.resample_sources(v, ["region_name", "type_activity_data3"], "lca", NSIM)),
        f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY region_name, type_activity_data3 ORDER BY lca) AS place,
  count(*) OVER (PARTITION BY region_name, type_activity_data3) AS n
  FROM (SELECT DISTINCT region_name, type_activity_data3, lca FROM inventory)),
x AS ({D.uniforms('(' + D.samples('p', NSIM) + ')', {'d': D.stream('source', 'region_name', 'type_activity_data3')})})
SELECT Id_sample, region_name, type_activity_data3, lca FROM x WHERE floor(u_d * n) + 1 = place""")
    both = ["low_ratio", "low_difference", "upper"]
    add("M06_bounds_from_sd",
        _q("bounds", lambda b: rounded(M.bounds_from_sd(M.bounds_from_sd(b.select("k", "mode", "sd"), "mode", "sd", rule="difference")
                                       .withColumnRenamed("low", "low_difference").drop("high"), "mode", "sd")
                                       .withColumnsRenamed({"low": "low_ratio", "high": "upper"}), both)),
        "SELECT k, mode, sd, round(mode / nullif(sd * 1.96, 0), 6) AS low_ratio, round(mode - sd * 1.96, 6) AS low_difference, "
        "round(mode + sd * 1.96, 6) AS upper FROM bounds")
    add("M07_point_repetition", _q("factors", lambda f: M.repeat_points(f, NSIM)),
        "WITH x AS (" + D.samples("factors", NSIM) + ") SELECT * FROM x")
    return out


FACTOR_SQL = """WITH f1 AS (SELECT """ + ", ".join(
    f"max({m}) FILTER (WHERE factor_key = '{k}') AS {k}_{m}" for k in ["N2Oi", "N2Od", "NH3", "NOx", "C_low", "C_high"]
    for m in ["lower_limit", "recommended_value", "upper_limit"]) + f""" FROM factors),
f2 AS ({D.uniforms('(' + D.samples('f1', NSIM) + ')', {n: D.stream(n) for n in [*M.FACTOR_DRAWS, 'C_ef']})}),
factor_draw AS (SELECT Id_sample, """ + ", ".join(
    D.triangular(f"u_{n}", f"{k}_lower_limit", f"{k}_recommended_value", f"{k}_upper_limit") + f" AS {n}"
    for n, k in M.FACTOR_DRAWS.items()) + ", " + D.triangular(
    "u_C_ef", "C_low_recommended_value", "(C_high_recommended_value + C_low_recommended_value) / 2",
    "C_high_recommended_value") + """ AS C_ef FROM f2)"""
