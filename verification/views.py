"""Input tables of the engine as SQL views over the given test tables.

Every view is one SQL text that Spark and DuckDB both accept, so a query and its oracle start from
the same rows. All values are integer arithmetic on the given columns; nulls, zeros, sentinels and
ties are put on chosen residues so that each rule of each operator is reached. Records that a view
leaves out on a residue are records its source lacks (a unit without pixels, a country without
statistics): without them no fill tier, label or unmatched join would be reached.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.constants import ALL_STAGES
from furrow.operators.impact import MASTER_KEYS
from furrow.sources.stages import stage, stage_parts, tune

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

VIEWS = {
    # trade flows as reported, with unknown origins, ports and destinations
    "flow": """
SELECT CAST(year(l.l_shipdate) AS INT) AS year,
  CASE WHEN hidden = 1 THEN NULL ELSE biome END AS biome,
  CASE WHEN hidden = 1 THEN NULL ELSE region_code END AS region_code,
  CASE WHEN hidden = 1 THEN NULL ELSE region_name END AS region_name,
  CASE WHEN hidden = 1 THEN NULL ELSE state_code END AS state_code,
  CASE WHEN hidden = 1 THEN NULL ELSE state_name END AS state_name,
  CASE WHEN hidden = 1 THEN CAST(9999999 AS BIGINT) ELSE l.municipality_code END AS municipality_code,
  CASE WHEN hidden = 1 THEN 'UNKNOWN' ELSE municipality_name END AS municipality_name,
  CAST(export_port_code AS BIGINT) AS export_port_code,
  CASE WHEN export_port_code = 99 THEN 'UNKNOWN' WHEN export_port_code = 27 THEN 'PROCESSED DOMESTICALLY'
       ELSE 'PORT ' || CAST(export_port_code AS STRING) END AS export_port_name,
  CASE WHEN export_port_code = 99 THEN 'UNKNOWN' WHEN export_port_code = 27 THEN 'PROCESSED DOMESTICALLY'
       ELSE 'PORT_MO ' || CAST(export_port_code AS STRING) END AS export_port_name_mo,
  CASE WHEN export_port_code = 99 THEN NULL WHEN export_port_code = 27 THEN CAST(9999998 AS BIGINT)
       ELSE CAST(5000 + export_port_code AS BIGINT) END AS port_municipality_code,
  'HUB ' || CAST(l.l_suppkey % 5 AS STRING) AS logistics_hub,
  'E' || CAST(l.l_partkey % 400 AS STRING) AS exporter_name,
  'I' || CAST(l.o_custkey % 400 AS STRING) AS importer_name,
  'G' || CAST(l.o_custkey % 7 AS STRING) AS importer_group,
  CAST(CASE WHEN (l.o_custkey + l.l_linenumber) % 6 = 0 THEN 999
            WHEN l.dest_region = 2 AND (l.o_custkey + l.l_linenumber) % 6 = 1 THEN 998
            ELSE 100 + l.c_nationkey * 10 + l.o_custkey % 10 END AS BIGINT) AS import_port_code,
  l.country AS import_country_name,
  'ECO ' || CAST(l.dest_region AS STRING) AS economic_region,
  'SUB ' || CAST(l.dest_region AS STRING) AS subregion,
  l.subregion_mo,
  CASE WHEN l.c_nationkey = 24 OR (l.o_custkey + l.l_linenumber) % 6 = 0
       OR (l.dest_region = 2 AND (l.o_custkey + l.l_linenumber) % 6 = 1) THEN 'UNKNOWN' ELSE 'TYPE ' || CAST(l.c_nationkey % 4 AS STRING) END AS economy_type,
  CAST(l.l_linenumber * 100 AS DOUBLE) AS fob,
  CASE WHEN (l.l_orderkey + l.l_partkey) % 6 = 0 OR l.l_suppkey % 29 = 5 AND l.l_partkey % 400 < 300
       THEN NULL ELSE l.l_quantity * 2 END AS land_use,
  l.l_quantity AS soy_eq
FROM (
  SELECT li.*, o.o_custkey, c.c_nationkey, cn.n_regionkey AS dest_region,
    CASE WHEN c.c_nationkey = 7 THEN 'BRAZIL' ELSE cn.n_name END AS country,
    CASE WHEN c.c_nationkey = 7 THEN 'Domestic' WHEN cn.n_regionkey = 2 THEN 'EU'
         ELSE 'REGION ' || CAST(cn.n_regionkey AS STRING) END AS subregion_mo,
    u.biome, u.region_code, u.region_name, u.state_code, u.state_name, u.municipality_code, u.municipality_name,
    CASE WHEN (li.l_orderkey + li.l_linenumber) % 5 = 0 OR c.c_nationkey % 8 = 0 OR cn.n_regionkey = 4
         THEN 1 ELSE 0 END AS hidden,
    CASE WHEN c.c_nationkey = 8 AND (li.l_orderkey * 3 + li.l_partkey) % 7 = 1 THEN 27
         WHEN (li.l_orderkey * 3 + li.l_partkey) % 7 = 0
              OR (li.l_suppkey % 10 = 3 AND li.l_partkey % 400 < 200) THEN 99
         ELSE 100 + p.p_size END AS export_port_code
  FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN unit u ON u.municipality_code = li.l_suppkey + 1
  JOIN part p ON li.l_partkey = p.p_partkey) l""",
    # spatial units with attributes and cell extents
    "unit": """
SELECT s_suppkey + 1 AS municipality_code, 'UNIT ' || CAST(s_suppkey AS STRING) AS municipality_name,
  CASE s_suppkey % 6 WHEN 0 THEN 'AMAZONIA' WHEN 1 THEN 'CERRADO' WHEN 2 THEN 'CAATINGA'
       WHEN 3 THEN 'MATA ATLANTICA' WHEN 4 THEN 'PANTANAL' ELSE 'PAMPA' END AS biome,
  CAST(10 + s_nationkey AS BIGINT) AS state_code, 'STATE ' || CAST(s_nationkey AS STRING) AS state_name,
  CAST(n_regionkey AS BIGINT) AS region_code,
  CASE n_regionkey WHEN 0 THEN 'Mid_western' WHEN 1 THEN 'Northern' WHEN 2 THEN 'North_eastern'
       WHEN 3 THEN 'South_eastern' ELSE 'Southern' END AS region_name,
  s_suppkey * 150 AS row_min, s_suppkey * 150 + 199 AS row_max,
  (s_suppkey * 53) % 700 AS col_min, (s_suppkey * 53) % 700 + 299 AS col_max
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "shape": """
SELECT CAST(municipality_code AS STRING) AS CD_MUN, municipality_name AS NM_MUN,
  CAST(-60 + col_min * 0.25 AS DOUBLE) AS xmin, CAST(80 - row_max * 0.0005 - 0.0005 AS DOUBLE) AS ymin,
  CAST(-60 + col_max * 0.25 + 0.25 AS DOUBLE) AS xmax, CAST(80 - row_min * 0.0005 AS DOUBLE) AS ymax FROM unit""",
    "ports": """
SELECT DISTINCT export_port_code, import_port_code, CAST(100 + export_port_code % 3 AS BIGINT) AS export_port_code1,
  'X' || CAST(export_port_code AS STRING) AS export_port_name_mo1,
  'XA' || CAST(export_port_code AS STRING) AS export_port_acronym_mo1,
  'M' || CAST(import_port_code AS STRING) AS import_port_name,
  'MA' || CAST(import_port_code AS STRING) AS import_port_acronym,
  'WORLD ' || CAST(import_port_code % 3 AS STRING) AS world_region,
  CASE WHEN import_port_code % 3 = 0 THEN 'overland' ELSE 'sea' END AS transport_type,
  CAST(-export_port_code AS DOUBLE) AS export_port_latitude, CAST(export_port_code AS DOUBLE) AS export_port_longitude,
  CAST(import_port_code AS DOUBLE) AS import_port_latitude, CAST(-import_port_code AS DOUBLE) AS import_port_longitude
FROM flow WHERE export_port_code <> 99 AND import_port_code < 998""",
    # yields per unit and year; units of one state have no yield at all
    "yields": """
SELECT state_code, municipality_code, y.year,
  CASE WHEN municipality_code % 9 = 0 OR state_code % 7 = 3 THEN 0.0
       WHEN (municipality_code + y.year) % 5 = 0 THEN NULL
       ELSE CAST(2000 + (municipality_code * 37 + y.year) % 1500 AS DOUBLE) END AS soy_yield,
  CASE WHEN (municipality_code + y.year) % 4 = 0 THEN NULL
       ELSE CAST((municipality_code + y.year) % 10 AS DOUBLE) / 16 END AS double_cropping_share
FROM unit JOIN (SELECT DISTINCT l_suppkey + 1 AS code, CAST(year(l_shipdate) AS INT) AS year FROM lineitem) y
  ON municipality_code = y.code""",
    "countries": """
SELECT CASE WHEN n_nationkey = 7 THEN 'BRAZIL' ELSE n_name END AS import_country_name,
  CAST(500 + n_nationkey AS BIGINT) AS import_country_code FROM nation""",
    "exports": """
SELECT f.year AS CO_ANO, k.import_country_code AS CO_PAIS,
  CASE CAST(f.soy_eq AS BIGINT) % 5 WHEN 0 THEN 1201 WHEN 1 THEN 1208 WHEN 2 THEN 1507 WHEN 3 THEN 2304 ELSE 1005 END AS SH4,
  f.municipality_code AS CO_MUN, CAST(f.soy_eq * 3 AS DOUBLE) AS KG_LIQUIDO
FROM flow f JOIN countries k ON f.import_country_name = k.import_country_name
WHERE (f.municipality_code + k.import_country_code) % 3 <> 0 AND f.municipality_code % 11 <> 4""",
    "crushing": """
SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
  CASE o_orderkey % 3 WHEN 0 THEN '1. Grão' WHEN 1 THEN '2. Farelo' ELSE '3. Óleo' END AS product,
  CASE o_custkey % 4 WHEN 0 THEN '2.3.5. - Consumo interno' WHEN 1 THEN '2.2.5. - Consumo interno'
       WHEN 2 THEN '2.1.4. - Sementes/Outros' ELSE '1.1 - Estoque' END AS entry,
  CAST(o_custkey % 97 AS DOUBLE) AS value FROM orders""",
    "prices": """
SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) % 3 AS INT) AS month, 'USD' AS unit,
  CASE o_orderkey % 8 WHEN 0 THEN 'Cakemeal_dom_price' WHEN 1 THEN 'Oil_dom_price' WHEN 2 THEN 'Cakemeal_for_price'
       WHEN 3 THEN 'Oil_for_price' WHEN 4 THEN 'dom_meal_c' WHEN 5 THEN 'dom_oil_c' WHEN 6 THEN 'for_meal_c'
       ELSE 'for_oil_c' END AS variable,
  CAST(SUM(CASE WHEN o_orderkey % 8 < 4 THEN 20 + o_custkey % 50 ELSE 1 + o_custkey % 7 END) AS DOUBLE) AS value
FROM orders GROUP BY year(o_orderdate), month(o_orderdate) % 3, o_orderkey % 8""",
    # long pixel table: land cover, soil carbon and burn scars by year, climate zones without year
    "cell": """
SELECT DISTINCT l_orderkey AS cell_row, l_partkey % 1000 AS cell_col FROM lineitem""",
    "pixel": """
SELECT layer, CAST(year AS INT) AS year, cell_row, cell_col, CAST(80 - (cell_row % 300000) * 0.0005 - 0.00025 AS DOUBLE) AS y, value FROM (
  SELECT 'cover' AS layer, 1995 AS year, cell_row, cell_col,
    CAST(CASE (cell_row + cell_col * 3) % 12 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 12 WHEN 3 THEN 20 WHEN 4 THEN 9
         WHEN 5 THEN 0 WHEN 6 THEN 62 WHEN 7 THEN NULL ELSE 39 END AS DOUBLE) AS value FROM cell WHERE (cell_row + cell_col) % 13 <> 0
  UNION ALL SELECT 'cover', 1998, cell_row, cell_col,
    CAST(CASE WHEN (cell_row * 3 + cell_col) % 4 = 0 THEN 3 ELSE 39 END AS DOUBLE) FROM cell WHERE (cell_row + cell_col) % 17 <> 0
  UNION ALL SELECT 'cover', 2001, cell_row, cell_col, CAST(CASE WHEN cell_col % 5 = 0 THEN 41 ELSE 39 END AS DOUBLE) FROM cell
  UNION ALL SELECT 'soc', 1995, cell_row, cell_col, CAST(38 + cell_col % 17 AS DOUBLE) FROM cell WHERE cell_col % 19 <> 0
  UNION ALL SELECT 'soc', 1998, cell_row, cell_col, CAST(40 + cell_row % 13 AS DOUBLE) FROM cell WHERE cell_row % 23 <> 0
  UNION ALL SELECT 'soc', 2001, cell_row, cell_col, CAST(41 + (cell_row + cell_col) % 11 AS DOUBLE) FROM cell
  UNION ALL SELECT 'burn', 1995, cell_row, cell_col, CAST(CASE WHEN (cell_row + 2 * cell_col) % 5 = 0 THEN 1 END AS DOUBLE) FROM cell
  UNION ALL SELECT 'burn', 1998, cell_row, cell_col, CAST(1 AS DOUBLE) FROM cell WHERE (cell_row + cell_col) % 6 = 0
  UNION ALL SELECT 'zone', 0, cell_row, cell_col,
    CAST(CASE cell_col % 9 WHEN 0 THEN 100 WHEN 1 THEN 105 WHEN 2 THEN 106 WHEN 3 THEN 201 WHEN 4 THEN 202 WHEN 5 THEN 403
         WHEN 6 THEN 300 WHEN 7 THEN NULL ELSE 100 END AS DOUBLE) FROM cell) p""",
    # change rows per unit and year, as the grid step leaves them
    "change": """
SELECT CAST(year(l_shipdate) AS INT) AS year, l_suppkey + 1 AS municipality_code,
  CAST(CASE l_partkey % 9 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 12 WHEN 3 THEN 20 WHEN 4 THEN 9 WHEN 5 THEN 0
       WHEN 6 THEN NULL ELSE 39 END AS DOUBLE) AS cov0, CAST(39 AS DOUBLE) AS cov1,
  CAST(CASE l_linenumber % 3 WHEN 0 THEN 1 ELSE NULL END AS DOUBLE) AS burnt,
  count(*) AS npixel,
  CASE WHEN l_suppkey % 8 = 1 OR (l_suppkey + year(l_shipdate)) % 5 = 0 THEN NULL
       ELSE CAST(sum(l_linenumber - 3) AS DOUBLE) END AS csoc_md,
  CAST(sum(l_quantity) AS DOUBLE) AS area
FROM lineitem WHERE (l_suppkey + year(l_shipdate)) % 7 <> 0
GROUP BY year(l_shipdate), l_suppkey, l_partkey % 9, l_linenumber % 3""",
    "origin": """
SELECT DISTINCT biome, state_code, municipality_code, year FROM flow""",
    # triangular bounds per key, some of them points, invalid or missing
    "bounds": """
SELECT p_partkey AS k, CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_size % 10 = 0 THEN p_retailprice ELSE p_retailprice - p_size END AS low,
  p_retailprice AS mode, CASE WHEN p_partkey % 17 = 0 THEN p_retailprice - 2 * p_size WHEN p_size % 10 = 0 THEN p_retailprice
       ELSE p_retailprice + 3 * p_size END AS high,
  CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 WHEN p_partkey % 13 = 0 THEN NULL ELSE 1 + p_size % 3 END AS DOUBLE) / 2 AS sd FROM part""",
    # emission factors by key
    "factors": """
SELECT CASE p_partkey % 13 WHEN 0 THEN 'N2Oi' WHEN 1 THEN 'N2Od' WHEN 2 THEN 'C_low' WHEN 3 THEN 'C_high' WHEN 4 THEN 'NH3'
       WHEN 5 THEN 'NOx' WHEN 6 THEN 'fuel_CO2' WHEN 7 THEN 'fuel_CO2_b' WHEN 8 THEN 'fuel_CO' WHEN 9 THEN 'fuel_PM2.5'
       WHEN 10 THEN 'fuel_NOx' WHEN 11 THEN 'fuel_NMVOC' ELSE 'fuel_SO2' END AS factor_key,
  CAST(min(p_size) AS DOUBLE) / 512 AS lower_limit, CAST(max(p_size) + 8 AS DOUBLE) / 512 AS upper_limit,
  CAST(CASE WHEN p_partkey % 13 = 3 THEN max(p_size) ELSE min(p_size) + 4 END AS DOUBLE) / 512 AS recommended_value
FROM part GROUP BY p_partkey % 13""",
    # life-cycle inventories: several studies per flow, bounds or deviations for some flows
    "inventory": """
SELECT CASE WHEN l_linenumber <= 5 THEN 'Farming' ELSE 'Processing' END AS stage,
  CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE state_code END AS state_code, region_name,
  act AS type_activity_data2, act AS type_activity_data3,
  CASE act WHEN 'fertiliser' THEN CASE l_partkey % 3 WHEN 0 THEN 'Urea-46-N' WHEN 1 THEN 'MAP' ELSE 'KCl' END
       WHEN 'pesticide' THEN 'Glyphosate' WHEN 'soil_correctors' THEN 'Limestone' WHEN 'sowing' THEN 'Seed' WHEN 'machinery' THEN 'Diesel'
       ELSE CASE l_partkey % 6 WHEN 0 THEN 'Hexane' WHEN 1 THEN 'Tap_water' WHEN 2 THEN 'Diesel'
            WHEN 3 THEN 'Natural_Gas_High_Pressure' WHEN 4 THEN 'Hardwood_Chips_From_Forest' ELSE 'Electricity' END END AS key_sim,
  CASE WHEN state_code % 3 = 0 AND l_linenumber <= 5 THEN 'Study 0' ELSE 'Study ' || CAST(l_partkey % 4 AS STRING) END AS lca,
  l_quantity AS recommended_value,
  CASE WHEN act = 'machinery' OR act = 'fertiliser' AND l_partkey % 3 = 0 THEN l_quantity / 2 WHEN act = 'crushing' AND l_partkey % 6 = 2 THEN l_quantity / 4 END AS lower_limit,
  CASE WHEN act = 'machinery' OR act = 'fertiliser' AND l_partkey % 3 = 0 THEN l_quantity * 2 WHEN act = 'crushing' AND l_partkey % 6 = 2 THEN l_quantity * 2 END AS upper_limit,
  CASE WHEN act IN ('fertiliser', 'soil_correctors') AND l_partkey % 3 = 1 THEN l_quantity / 8 WHEN act = 'crushing' AND l_partkey % 6 = 0 THEN l_quantity / 8 END AS sd
FROM (SELECT li.*, u.state_code, u.region_name,
        CASE l_linenumber WHEN 1 THEN 'fertiliser' WHEN 2 THEN 'pesticide' WHEN 3 THEN 'soil_correctors' WHEN 4 THEN 'sowing'
             WHEN 5 THEN 'machinery' ELSE 'crushing' END AS act
      FROM lineitem li JOIN unit u ON u.municipality_code = li.l_suppkey + 1) l""",
    # cleaned cover rows with soil-carbon bounds, carbon parameters and zone areas
    "cover": """
SELECT biome, state_code, municipality_code, year, class AS map_biomas_class_code, burnt,
  CAST(CASE WHEN burnt = 1 AND class IN (3, 4, 12) THEN 1 ELSE 0 END AS INT) AS burnt1,
  CASE WHEN class IN (39, 20) THEN 'LU' ELSE 'LUC' END AS luclu, area_ha,
  CASE WHEN state_code % 11 = 4 THEN NULL ELSE me - 5 END AS csoc_min, me AS csoc_me, me + 7 AS csoc_max
FROM (
  SELECT biome, state_code, municipality_code, CAST(year(l_shipdate) AS INT) AS year,
    CAST(CASE l_partkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 12 WHEN 3 THEN 20 WHEN 4 THEN 9 WHEN 5 THEN 50 ELSE 39 END AS BIGINT) AS class,
    CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 2 END AS INT) AS burnt,
    CAST(sum(l_quantity) AS DOUBLE) AS area_ha, CAST(count(*) % 20 AS DOUBLE) AS me
  FROM lineitem JOIN unit ON municipality_code = l_suppkey + 1 WHERE l_suppkey % 6 <> 2 OR year(l_shipdate) % 2 = 0
  GROUP BY biome, state_code, municipality_code, year(l_shipdate), l_partkey % 7, CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 2 END) c""",
    "carbon": """
SELECT CASE WHEN class IN (3, 4, 12) THEN 'Natural_forest' ELSE 'Cropland' END AS type_land_area,
  'Class ' || CAST(class AS STRING) AS map_biomas_class, class AS map_biomas_class_code, ipcc_code, CAST(1 AS INT) AS dummy_c,
  CASE WHEN class = 39 THEN NULL ELSE v END AS agbm_ll, v + 12 AS agbm_value, v + 30 AS agbm_ul,
  v / 8 AS Litter_min, v / 4 AS Litter_value, v / 2 AS Litter_max, v / 16 AS DOM_min, v / 8 AS DOM_value, v / 4 AS DOM_max,
  1500 + v AS Gef_CO2, CAST(100 AS DOUBLE) AS sd_CO2, 90 + v AS Gef_CO, CAST(20 AS DOUBLE) AS sd_CO, 6 + v / 8 AS Gef_CH4,
  CAST(2 AS DOUBLE) AS sd_CH4, v / 64 + 1 AS Gef_N2O, CAST(CASE WHEN ipcc_code = 400 THEN 0 ELSE 1 END AS DOUBLE) AS sd_N2O,
  v / 32 + 2 AS Gef_NOx, CAST(1 AS DOUBLE) AS sd_NOx, v / 128 + 0.5 AS Cf_value, CASE WHEN class = 4 THEN v / 1024 ELSE v / 1024 + 1 END AS Cf_sd
FROM (SELECT CAST(CASE p_partkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 12 WHEN 3 THEN 20 WHEN 4 THEN 9 WHEN 5 THEN 41 ELSE 39 END AS BIGINT) AS class,
        CAST(CASE p_size % 4 WHEN 0 THEN 1001 WHEN 1 THEN 1002 WHEN 2 THEN 400 ELSE 300 END AS BIGINT) AS ipcc_code,
        CAST(min(p_size) + 4 AS DOUBLE) AS v FROM part GROUP BY p_partkey % 7, p_size % 4) p""",
    "zone": """
SELECT biome, municipality_code,
  CAST(CASE l_partkey % 5 WHEN 0 THEN 1001 WHEN 1 THEN 1002 WHEN 2 THEN 400 WHEN 3 THEN 300 ELSE 999 END AS BIGINT) AS ipcc_code,
  CASE WHEN municipality_code % 5 = 2 AND l_partkey % 5 = 3 THEN NULL ELSE CAST(sum(l_quantity) AS DOUBLE) END AS area_eco_zone
FROM lineitem JOIN unit ON municipality_code = l_suppkey + 1 WHERE (l_suppkey + l_partkey % 5) % 3 <> 0
GROUP BY biome, municipality_code, l_partkey % 5""",
    # emissions per sample, unit and year; some units and years have none
    "stock": """
SELECT CAST(1 + l_linenumber % 5 AS INT) AS Id_sample, l_suppkey + 1 AS municipality_code, CAST(year(l_shipdate) AS INT) AS year,
  CAST(sum(l_quantity) AS DOUBLE) AS area_ha, CAST(sum(l_partkey % 10) AS DOUBLE) AS CO2e_soc, CAST(sum(l_partkey % 7) AS DOUBLE) AS CO2e_bmb,
  CAST(sum(l_partkey % 5) AS DOUBLE) AS CH4e, CAST(sum(l_partkey % 3) AS DOUBLE) AS N2Oe, CAST(sum(l_partkey % 2) AS DOUBLE) AS NOxe
FROM lineitem WHERE l_suppkey % 6 <> 1 AND (l_suppkey + year(l_shipdate)) % 4 <> 0 AND l_suppkey % 25 <> 7
GROUP BY l_linenumber % 5, l_suppkey, year(l_shipdate)""",
    "farm": """
SELECT f.region_name, f.state_code, f.municipality_code, f.year, y.double_cropping_share, y.soy_yield
FROM flow f JOIN yields y ON f.municipality_code = y.municipality_code AND f.year = y.year""",
    "overlap": """
SELECT CAST(l_suppkey + 1 AS STRING) AS CD_MUN, 'REALM ' || CAST(l_partkey % 2 AS STRING) AS REALM, CAST(l_partkey % 4 AS BIGINT) AS ECO_ID,
  'EC' || CAST(l_partkey % 4 AS STRING) AS eco_code, CAST(sum(l_quantity) AS DOUBLE) AS inter_km2
FROM lineitem WHERE (l_suppkey + l_partkey % 4) % 5 <> 0 GROUP BY l_suppkey, l_partkey % 4, l_partkey % 2""",
    "land_cf": """
SELECT 'REALM ' || CAST(p_partkey % 2 AS STRING) AS realm, 'B' || CAST(p_partkey % 2 AS STRING) AS biome, CAST(p_partkey % 4 AS BIGINT) AS eco_id,
  'ECO ' || CAST(p_partkey % 4 AS STRING) AS eco_name, CAST(1 + p_size % 5 AS INT) AS habitat_id, 'H' || CAST(1 + p_size % 5 AS STRING) AS habitat,
  CASE WHEN p_partkey % 997 = 5 THEN NULL ELSE p_retailprice / 1024 END AS cf_occ_avg_glo, p_retailprice / 512 AS cf_tra_avg_glo FROM part""",
    "content": """
SELECT CASE p_partkey % 3 WHEN 0 THEN 'Urea-46-N' WHEN 1 THEN 'MAP' ELSE 'Limestone' END AS activity_data1,
  CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE CAST(min(p_size) + 8 AS DOUBLE) / 64 END AS N_content,
  CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE CAST(min(p_size) + 4 AS DOUBLE) / 64 END AS C_content
FROM part GROUP BY p_partkey % 3""",
    # harmonised flows, impact factors and distances
    "trade": """
SELECT region_code, region_name, state_code, state_name, municipality_code, municipality_name,
  CAST(100 + l_partkey % 3 AS BIGINT) AS export_port_code1, 'PORT ' || CAST(l_partkey % 3 AS STRING) AS export_port_name_mo1,
  CASE WHEN c_nationkey = 7 THEN 'BRAZIL' ELSE 'LAND ' || CAST(n_regionkey AS STRING) END AS import_country_name,
  CAST(200 + n_regionkey AS BIGINT) AS import_port_code, 'A' || CAST(n_regionkey AS STRING) AS import_port_acronym,
  'ECO ' || CAST(n_regionkey AS STRING) AS economic_region, CAST(500 + n_regionkey AS BIGINT) AS import_country_code,
  CASE WHEN n_regionkey = 1 THEN 'overland' ELSE 'sea' END AS transport_type, CAST(year(l_shipdate) AS INT) AS year,
  CASE WHEN state_code IN (11, 15, 21, 29, 31) THEN 'uf' ELSE 'reg' END AS dummy_uf_reg,
  CAST(2000 + l_suppkey % 700 AS DOUBLE) AS soy_yield, CASE WHEN l_suppkey % 20 = 6 AND l_partkey % 3 = 0 THEN 0 ELSE l_quantity END AS soy_eq,
  CASE WHEN l_suppkey % 20 = 6 AND l_partkey % 3 = 0 THEN 0 ELSE l_quantity END / 4 AS soybean,
  CASE WHEN l_suppkey % 20 = 6 AND l_partkey % 3 = 0 THEN 0 ELSE l_quantity END / 8 AS bean_meal,
  CASE WHEN l_suppkey % 20 = 6 AND l_partkey % 3 = 0 THEN 0 ELSE l_quantity END / 2 AS cake,
  CASE WHEN l_suppkey % 20 = 6 AND l_partkey % 3 = 0 THEN 0 ELSE l_quantity END / 16 AS oil,
  CASE WHEN l_suppkey % 50 = 9 AND l_partkey % 40 = 0 THEN NULL ELSE l_quantity * 2 END AS land_use, CAST(l_linenumber AS DOUBLE) AS fob,
  CAST(0.25 AS DOUBLE) AS sh_bean, CAST(0.125 AS DOUBLE) AS sh_meal, CAST(0.5 AS DOUBLE) AS sh_cake, CAST(0.125 AS DOUBLE) AS sh_oil,
  CAST(l_suppkey % 8 AS DOUBLE) / 16 AS double_cropping_share, CAST(0.75 AS DOUBLE) AS dom_kmeal_af, CAST(0.25 AS DOUBLE) AS dom_oil_af,
  CAST(0.625 AS DOUBLE) AS for_kmeal_af, CAST(0.375 AS DOUBLE) AS for_oil_af
FROM lineitem JOIN unit ON municipality_code = l_suppkey + 1 JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "process": """
SELECT CASE WHEN p_size % 9 = 8 THEN 'Core_effects' ELSE 'All_effects_100yr' END AS approach,
  'LC-Impact' AS method,
  CASE p_partkey % 5 WHEN 0 THEN 'Freshwater ecosystems' WHEN 4 THEN NULL ELSE 'Terrestrial ecosystems' END AS damage,
  CASE p_partkey % 5 WHEN 0 THEN 'Ecotoxicity, freshwater, average' WHEN 1 THEN 'Ecotoxicity, terrestrial, average'
       WHEN 2 THEN 'Land stress, TE, average' WHEN 3 THEN 'Climate change, TE' ELSE 'Ecotoxicity, marine, average' END AS impact_category,
  CASE WHEN p_partkey % 5 IN (0, 1, 4) THEN 'PDF.m3.d' ELSE 'PDF.year' END AS unit_impact,
  CASE p_partkey % 19 WHEN 0 THEN 'Urea-46-N' WHEN 1 THEN 'MAP' WHEN 2 THEN 'KCl' WHEN 3 THEN 'Glyphosate' WHEN 4 THEN 'Limestone' WHEN 5 THEN 'Seed'
       WHEN 6 THEN 'Diesel' WHEN 7 THEN 'Hexane' WHEN 8 THEN 'Tap_water' WHEN 9 THEN 'Natural_Gas_High_Pressure'
       WHEN 10 THEN 'Hardwood_Chips_From_Forest' WHEN 11 THEN 'Electricity_Low_Voltage_voltage_BR_Mid_western'
       WHEN 12 THEN 'Electricity_Low_Voltage_voltage_BR_Northern' WHEN 13 THEN 'Electricity_Low_Voltage_voltage_BR_North_eastern'
       WHEN 14 THEN 'Electricity_Low_Voltage_voltage_BR_South_eastern' WHEN 15 THEN 'electricity_low_voltage_voltage_BR_Southern'
       WHEN 16 THEN 'Transport_Freight_Lorry_32_EURO5' WHEN 17 THEN 'Transport_Freight_Sea' ELSE 'Other' END AS key_sim,
  CASE p_partkey % 5 WHEN 0 THEN 9.9e12 * 365.25 WHEN 1 THEN 6.4e12 * 365.25 WHEN 4 THEN 6.56e16 * 365.25 ELSE 1e0 END * p_size / 1024 AS impact
FROM part""",
    "cf": """
SELECT CASE WHEN p_size % 9 = 8 THEN 'Core_effects' ELSE 'All_effects_100yr' END AS approach, 'LC-Impact' AS method,
  'Terrestrial ecosystems' AS damage, CASE p_partkey % 2 WHEN 0 THEN 'Climate change, TE' ELSE 'Land stress, TE, average' END AS impact_category,
  'PDF.year' AS unit_impact,
  CASE p_partkey % 9 WHEN 0 THEN 'CO2' WHEN 1 THEN 'N2O' WHEN 2 THEN 'NOx' WHEN 3 THEN 'NH3' WHEN 4 THEN 'CH4' WHEN 5 THEN 'CO2_b'
       WHEN 6 THEN 'SO2' WHEN 7 THEN 'NMVOC' ELSE 'PM2.5' END AS substance_ac, CAST(max(p_size) AS DOUBLE) / 256 AS value
FROM part GROUP BY CASE WHEN p_size % 9 = 8 THEN 'Core_effects' ELSE 'All_effects_100yr' END, p_partkey % 2, p_partkey % 9""",
    "road": """
SELECT DISTINCT municipality_code AS from_id, export_port_code1 AS to_id, CAST((municipality_code * 7 + export_port_code1 * 3) % 900 AS DOUBLE) AS distance_km,
  CAST(1 AS DOUBLE) AS time_h FROM trade WHERE municipality_code % 13 <> 2""",
    "sea": """
SELECT DISTINCT import_port_code AS port_imp, import_port_acronym, export_port_code1, import_country_name,
  CAST(5000 + (import_port_code * export_port_code1) % 4000 AS DOUBLE) AS distance_km FROM trade
WHERE transport_type = 'sea' AND import_country_name <> 'BRAZIL'
UNION ALL SELECT CAST(n_nationkey AS BIGINT), 'A', CAST(100 + n_nationkey % 3 AS BIGINT), n_name, CAST(3000 + n_nationkey * 10 AS DOUBLE) FROM nation
WHERE n_nationkey <> 7""",
    "overland": """
SELECT DISTINCT export_port_code1 AS from_id, import_country_name AS to_id, CAST(700 + export_port_code1 % 90 AS DOUBLE) AS distance_km,
  CAST(2 AS DOUBLE) AS time_h FROM trade WHERE transport_type = 'overland'""",
    # master matrix with every stage filled by integer arithmetic
    "master": """
SELECT CAST(1 + (municipality_code + year) % 3 AS INT) AS Id_sample, {keys},
  sum(soy_eq) AS soy_eq, sum(soybean) AS soybean, sum(bean_meal) AS bean_meal, sum(cake) AS cake, sum(oil) AS oil, sum(land_use) AS land_use,
  sum(fob) AS fob, max(soy_yield) AS soy_yield, max(sh_bean) AS sh_bean, max(sh_meal) AS sh_meal, max(sh_cake) AS sh_cake, max(sh_oil) AS sh_oil,
  max(double_cropping_share) AS sh_dcp, max(dom_kmeal_af) AS dom_kmeal_af, max(dom_oil_af) AS dom_oil_af,
  max(for_kmeal_af) AS for_kmeal_af, max(for_oil_af) AS for_oil_af, 'LC-Impact' AS method, 'Climate change, TE' AS impact_category,
  'PDF.year' AS unit_impact, 'Terrestrial ecosystems' AS damage,
  {stages}
FROM trade GROUP BY {keys}""",
}
VIEWS["master"] = VIEWS["master"].format(
    keys=", ".join(MASTER_KEYS),
    stages=",\n  ".join(
        f"CAST((municipality_code * {i + 3} + year * {2 * i + 1} + export_port_code1) % {17 + i} AS DOUBLE) / 64 AS {stage}"
        for i, stage in enumerate(ALL_STAGES)))


def needed(names: list[str], text: str = "") -> list[str]:
    """Views mentioned by a text or by each other, in definition-safe order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in VIEWS:
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", VIEWS[name]):
                visit(other)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if name in names or re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
            visit(name)
    return order


#: Views that others read many times, each time with another filter: written once.
STAGED = ("cell",)


def load(spark: SparkSession, sf_dir: str, name: str, held: dict[str, DataFrame] | None = None,
         part: tuple[int, int] = (0, 1)) -> DataFrame:
    """A view as a DataFrame over the parquet tables in `sf_dir`. Views in `held` are tables already, for
    all views that read them. `part` (i, n): of the orders and their lines only those with hash i of n."""
    tune(spark)
    for table in TABLES:
        frame, key = spark.read.parquet(f"{sf_dir}/{table}.parquet"), {"lineitem": "l_orderkey", "orders": "o_orderkey"}.get(table)
        if key and part[1] > 1:
            frame = frame.where(F.pmod(F.xxhash64(key), F.lit(part[1])) == part[0])
        frame.createOrReplaceTempView(table)
    held = held or {}
    for view in needed([name]):
        frame = held[view] if view in held else spark.sql(VIEWS[view])
        (stage(frame, view) if view in STAGED and view not in held else frame).createOrReplaceTempView(view)
    return spark.table(name)


#: Views with one row per line of an order, joined to that order and to rows of other tables.
BY_LINE = ("flow", "trade")
#: Lines that are joined at once, about, in so many parts at most.
LINES, PARTS = 6_000_000, 16


def hold(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] = ("*",)) -> DataFrame:
    """A view of BY_LINE (or its columns that are read) as a table, for what reads it more than once or
    shuffles much besides. It is written in parts of the orders: the joins of one part at a time are on disk."""
    assert name in BY_LINE
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    n = max(1, min(PARTS, -(-lines // LINES)))
    return stage_parts((load(spark, sf_dir, name, part=(i, n)).select(*columns) for i in range(n)), name)


def oracle(text: str) -> str:
    """An oracle query with the views it mentions prepended as common table expressions."""
    used = needed([], text)
    parts = [f"{name} AS {'MATERIALIZED ' if name in ('cell', 'pixel') else ''}({VIEWS[name]})" for name in used]
    body = text.strip()
    if body.upper().startswith("WITH "):
        parts.append(body[5:])
        return "WITH " + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
