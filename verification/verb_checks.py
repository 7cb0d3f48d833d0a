"""Relational verbs and sources as queries, with their SQL oracles."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from furrow.functions.nulls import row_total, strict_sum
from furrow.functions.quantiles import group_quantiles
from furrow.operators import relational as V
from furrow.sources import tables as IO
from furrow.sources.schemas import SCHEMAS
from furrow.sources.stages import stage_root
from verification.flow_checks import _q, rounded
from verification.views import load, oracle


def _path(spark, tag):
    return f"{stage_root(spark)}/furrow/{tag}-{uuid4().hex}"


def _csv(view, sep):
    def query(spark, sf):
        path = _path(spark, view)
        load(spark, sf, view).write.option("header", True).option("sep", sep).csv(path)
        return IO.read_delimited(spark, path, SCHEMAS[view], sep) if sep == ";" else IO.read_sheet(spark, path, SCHEMAS[view])
    return query


def _parquet(view, partitions=()):
    def query(spark, sf):
        path = _path(spark, view)
        frame = load(spark, sf, view)
        IO.write_table(frame, path, partitions)
        return IO.read_table(spark, path, SCHEMAS[view]).select(*frame.columns)
    return query


def _pixels(spark, sf):
    path = _path(spark, "pixels")
    IO.write_pixels(load(spark, sf, "pixel"), path)
    return IO.read_layer(spark, path, "cover", [1998]).select("layer", "year", "cell_row", "cell_col", "y", "value")


def _flow(fn):
    return _q("flow", fn)


def checks() -> dict:
    out = {}

    def add(name, query, sql=None):
        out[name] = (query, oracle(sql) if sql else None)

    add("V01_sheet_scan", _csv("inventory", ","), "SELECT * FROM inventory")
    add("V02_delimited_scan", _csv("exports", ";"), "SELECT * FROM exports")
    add("V03_parquet_scan", _parquet("land_cf"), "SELECT * FROM land_cf")
    add("V04_attribute_scan", _parquet("overlap"), "SELECT * FROM overlap")
    add("V05_layer_scan", _pixels, "SELECT * FROM pixel WHERE layer = 'cover' AND year = 1998")

    def lookup(f):
        table = f.sparkSession.createDataFrame([(27, "domestic"), (99, "unknown")], "export_port_code bigint, port_kind string")
        return V.attach(f.select("year", "export_port_code", "soy_eq"), table, ["export_port_code"])

    add("V06_inline_lookup", _flow(lookup),
        "SELECT year, export_port_code, soy_eq, CASE export_port_code WHEN 27 THEN 'domestic' WHEN 99 THEN 'unknown' END AS port_kind FROM flow")
    add("V07_partitioned_sink", _parquet("flow", ["year"]), "SELECT * FROM flow")
    add("V08_chunk_folder", _parquet("yields", ["year", "state_code"]), "SELECT * FROM yields")
    add("V09_projection", _flow(lambda f: f.drop("fob").select("year", "soy_eq", "land_use")), "SELECT year, soy_eq, land_use FROM flow")
    add("V10_column_removal", _q("prices", lambda p: p.drop("unit")), "SELECT * EXCLUDE (unit) FROM prices")
    add("V11_computed_column", _flow(lambda f: f.select("year", "soy_eq", (F.col("soy_eq") * 2 - F.col("fob") / 4).alias("x"))),
        "SELECT year, soy_eq, soy_eq * 2 - fob / 4 AS x FROM flow")
    add("V12_rename", _q("exports", lambda e: e.withColumnsRenamed({"CO_ANO": "year", "CO_MUN": "unit_code"})),
        "SELECT CO_ANO AS year, CO_PAIS, SH4, CO_MUN AS unit_code, KG_LIQUIDO FROM exports")
    add("V13_cast", _q("shape", lambda s: s.select("NM_MUN", F.expr("try_cast(CD_MUN AS DOUBLE)").alias("code"),
                                                   F.expr("try_cast(NM_MUN AS DOUBLE)").alias("bad"))),
        "SELECT NM_MUN, CAST(CD_MUN AS DOUBLE) AS code, TRY_CAST(NM_MUN AS DOUBLE) AS bad FROM shape")
    many = ["area_ha", "CO2e_soc", "CO2e_bmb", "CH4e"]
    add("V14_multi_column_apply", _q("stock", lambda s: s.select("Id_sample", "municipality_code", "year", *[(F.col(c) * 3).alias(c) for c in many])),
        "SELECT Id_sample, municipality_code, year, " + ", ".join(f"{c} * 3 AS {c}" for c in many) + " FROM stock")
    add("V15_filter", _flow(lambda f: f.where((F.col("export_port_code").isin(27, 99) | (F.col("soy_eq") > 45)) & F.col("land_use").isNotNull())
                            .select("year", "export_port_code", "soy_eq")),
        "SELECT year, export_port_code, soy_eq FROM flow WHERE (export_port_code IN (27, 99) OR soy_eq > 45) AND land_use IS NOT NULL")
    add("V16_pattern_filter", _q("process", lambda p: p.where(F.col("key_sim").rlike("(?i)electricity_low_voltage")).select("key_sim", "impact_category")),
        "SELECT key_sim, impact_category FROM process WHERE key_sim ILIKE '%electricity_low_voltage%'")
    add("V17_conditional", _flow(lambda f: f.select("soy_eq", "land_use", F.when(F.col("land_use").isNull(), F.lit(None)).when(F.col("land_use") > 60, "high")
                                                    .when(F.col("land_use") > 20, "mid").otherwise("low").alias("level"))),
        "SELECT soy_eq, land_use, CASE WHEN land_use > 60 THEN 'high' WHEN land_use > 20 THEN 'mid' WHEN land_use IS NOT NULL THEN 'low' END AS level FROM flow")
    add("V18_natural_left_join",
        lambda s, d: V.attach(load(s, d, "flow").select("state_code", "municipality_code", "soy_eq"),
                              load(s, d, "flow").groupBy("state_code").agg(F.count(F.lit(1)).alias("n")), ["state_code"]),
        "SELECT f.state_code, municipality_code, soy_eq, n FROM flow f LEFT JOIN (SELECT state_code, count(*) AS n FROM flow GROUP BY ALL) g "
        "ON f.state_code IS NOT DISTINCT FROM g.state_code")
    add("V19_right_join",
        lambda s, d: V.keep_facts(load(s, d, "unit").select("municipality_code", "biome"),
                                  load(s, d, "flow").select("municipality_code", "soy_eq"), ["municipality_code"]),
        "SELECT f.municipality_code, u.biome, f.soy_eq FROM flow f LEFT JOIN unit u ON f.municipality_code = u.municipality_code")

    def sides(s, d):
        p = load(s, d, "pixel")
        keys = ["layer", "year", "cell_row", "cell_col"]
        return [p.where(where).select(*keys, F.col("value").alias(name))
                for where, name in (("value > 39", "high"), ("value % 2 = 0", "even"))]

    add("V20_full_join", lambda s, d: V.align(*sides(s, d), ["layer", "year", "cell_row", "cell_col"]),
        "SELECT layer, year, cell_row, cell_col, CASE WHEN value > 39 THEN value END AS high, "
        "CASE WHEN value % 2 = 0 THEN value END AS even FROM pixel WHERE value > 39 OR value % 2 = 0")
    add("V21_hash_aggregate", _flow(lambda f: f.groupBy("year", "biome").agg(strict_sum("land_use").alias("strict"), F.sum("land_use").alias("loose"),
                                                                             F.count(F.lit(1)).alias("n"))),
        "SELECT year, biome, CASE WHEN count(*) = count(land_use) THEN sum(land_use) END AS strict, sum(land_use) AS loose, count(*) AS n FROM flow GROUP BY ALL")
    add("V22_group_value_per_row",
        lambda s, d: rounded(V.fill_by_tier_means(load(s, d, "flow").select("year", "municipality_code", "soy_eq", "land_use"), ["land_use"],
                                                  [["municipality_code"], ["year"]]), ["land_use"]),
        "WITH a AS (SELECT year, municipality_code, soy_eq, coalesce(land_use, avg(land_use) OVER (PARTITION BY municipality_code)) AS land_use FROM flow) "
        "SELECT year, municipality_code, soy_eq, round(coalesce(land_use, avg(land_use) OVER (PARTITION BY year)), 6) AS land_use FROM a")
    add("V23_distinct", _flow(lambda f: f.select("biome", "state_code", "year").distinct()), "SELECT DISTINCT biome, state_code, year FROM flow")
    add("V24_union", lambda s, d: V.stack([load(s, d, "sea").select("export_port_code1", "distance_km"),
                                           load(s, d, "overland").select("distance_km", F.col("from_id").alias("export_port_code1"))]),
        "SELECT export_port_code1, distance_km FROM sea UNION ALL SELECT from_id, distance_km FROM overland")
    add("V25_wide_pivot", _flow(lambda f: V.widen(f, ["municipality_code"], "year", {y: f"y{y}" for y in (*range(1992, 1999), 2030)}, "soy_eq")),
        "SELECT municipality_code, " + ", ".join(f"sum(soy_eq) FILTER (WHERE year = {y}) AS y{y}" for y in range(1992, 1999)) + ", "
        "CAST(NULL AS DOUBLE) AS y2030 FROM flow GROUP BY ALL")
    add("V26_unpivot", _q("stock", lambda s: V.lengthen(s, ["Id_sample", "municipality_code", "year"], many, "name", "value")),
        "SELECT Id_sample, municipality_code, year, name, value FROM stock UNPIVOT INCLUDE NULLS (value FOR name IN (area_ha, CO2e_soc, CO2e_bmb, CH4e))")
    add("V27_key_concat_split",
        _flow(lambda f: V.split_key(f.select("soy_eq", V.join_key("k", ["state_code", "year", F.concat_ws("-", "exporter_name", "import_country_name")])), "k", "abc")),
        "SELECT soy_eq, split_part(k, '-', 1) AS a, split_part(k, '-', 2) AS b, substr(k, length(split_part(k, '-', 1)) + length(split_part(k, '-', 2)) + 3) AS c "
        "FROM (SELECT soy_eq, concat_ws('-', coalesce(CAST(state_code AS VARCHAR), 'NA'), CAST(year AS VARCHAR), exporter_name, import_country_name) AS k FROM flow)")
    add("V28_parallel_explode",
        _q("bounds", lambda b: b.select("k", F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(3)).alias("i"), F.array("mode", "high", "low").alias("v"))).alias("z"))
           .select("k", F.col("z.i").alias("i"), F.col("z.v").alias("v"))),
        "SELECT k, CAST(i AS INT) AS i, v FROM (SELECT k, unnest([1, 2, 3]) AS i, unnest([mode, high, low]) AS v FROM bounds)")
    add("V29_row_number", _flow(lambda f: f.select("state_code", "municipality_code").distinct().withColumn("id_row", F.expr(
        "row_number() OVER (PARTITION BY state_code ORDER BY municipality_code)"))),
        "SELECT state_code, municipality_code, CAST(row_number() OVER (PARTITION BY state_code ORDER BY municipality_code) AS INT) AS id_row "
        "FROM (SELECT DISTINCT state_code, municipality_code FROM flow)")
    five = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    add("V30_five_number_summary", lambda s, d: rounded(group_quantiles(load(s, d, "flow").withColumn("x", F.col("land_use") / (F.col("soy_eq") + F.col("fob"))),
                                                                        ["year"], "x", five), five),
        "SELECT year, " + ", ".join(f"round(quantile_cont(land_use / (soy_eq + fob), {p}), 6) AS {n}" for n, p in five.items()) + " FROM flow GROUP BY year")
    add("V31_row_total", _q("stock", lambda s: s.select("Id_sample", "municipality_code", "year", row_total(many).alias("total"))),
        "SELECT Id_sample, municipality_code, year, " + " + ".join(many) + " AS total FROM stock")
    add("V32_loop_as_key", _flow(lambda f: f.groupBy("year", "municipality_code").agg(F.max("soy_eq").alias("top"))),
        "SELECT year, municipality_code, max(soy_eq) AS top FROM flow GROUP BY ALL")
    return out
