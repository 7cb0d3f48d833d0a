"""Trade-flow queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import flows as T
from furrow.operators.relational import attach
from furrow.plans.completion import complete_flows, complete_nodes
from verification.views import hold, load, oracle


def _candidate_sql(node: str, link: list[str], unknown: str, excluded: str | None = None) -> str:
    keys = ", ".join(link)
    return f"""
SELECT year, {keys}, candidate FROM (
  SELECT year, {keys}, CASE WHEN bool_or(v IS NULL) THEN NULL
         ELSE max({node}) FILTER (WHERE v = top) END AS candidate
  FROM (SELECT *, max(v) OVER (PARTITION BY year, {keys}) AS top
        FROM (SELECT year, {keys}, {node},
                CASE WHEN {node} IN ({excluded or unknown}) THEN 0 ELSE sum(soy_eq) END AS v
              FROM {{flows}} GROUP BY year, {keys}, {node}))
  GROUP BY year, {keys} HAVING bool_or({node} IN ({unknown})))"""


def candidate(node, link, unknown, excluded=None, flows="flow") -> str:
    return _candidate_sql(node, link, unknown, excluded).replace("{flows}", flows)


def _using(alias: str, keys: list[str]) -> str:
    return " AND ".join(f"f.{k} IS NOT DISTINCT FROM {alias}.{k}" for k in ["year", *keys])


def origin_cte(source: str = "flow") -> str:
    """filled(flow columns, code, municipality_data_quality) from the four origin tiers."""
    tiers = T.ORIGIN_TIERS
    joins = "\n".join(
        f"LEFT JOIN ({candidate('municipality_code', k, '9999999', flows=source)}) c{i} ON {_using(f'c{i}', k)}"
        for i, k in enumerate(tiers, 1))
    return f"""
SELECT f.* EXCLUDE (municipality_code),
  CASE WHEN f.municipality_code <> 9999999 THEN f.municipality_code WHEN c1.candidate <> 9999999 THEN c1.candidate
       WHEN c2.candidate <> 9999999 THEN c2.candidate WHEN c3.candidate <> 9999999 THEN c3.candidate
       ELSE c4.candidate END AS municipality_code,
  CASE WHEN f.municipality_code <> 9999999 THEN 'non_imputed' WHEN c1.candidate <> 9999999 THEN 'trader_imputed'
       WHEN c2.candidate <> 9999999 THEN 'import_country_imputed'
       WHEN c3.candidate <> 9999999 THEN 'import_region_imputed'
       ELSE 'economic_region_imputed' END AS municipality_data_quality
FROM {source} f {joins}"""


def export_cte(source: str = "flow") -> str:
    joins = "\n".join(
        f"LEFT JOIN ({candidate('export_port_code', k, '99', '99, 27', flows=source)}) c{i} ON {_using(f'c{i}', k)}"
        for i, k in enumerate(T.EXPORT_PORT_TIERS, 1))
    return f"""
SELECT f.* EXCLUDE (export_port_code),
  CASE WHEN f.export_port_code <> 99 THEN f.export_port_code WHEN c1.candidate <> 99 THEN c1.candidate
       WHEN c2.candidate <> 99 THEN c2.candidate ELSE c3.candidate END AS export_port_code,
  CASE WHEN f.export_port_code <> 99 THEN 'Non_imputed' WHEN c1.candidate <> 99 THEN 'Trader_imputed'
       WHEN c2.candidate <> 99 THEN 'Origin_imputed' ELSE 'Import_country_imputed' END AS export_port_data_quality
FROM {source} f {joins}"""


def pool_candidate(link: list[str], cell: list[str], source: str = "flow") -> str:
    keys = ", ".join(link)
    grain = ", ".join(dict.fromkeys(["year", "import_port_code", "subregion_mo", *cell, *link]))
    return f"""
SELECT year, {keys}, max(code) AS candidate FROM (
  SELECT *, CASE WHEN subregion_mo = 'EU' THEN CASE WHEN v2 = max(v2) OVER w THEN import_port_code ELSE 0 END
                 ELSE CASE WHEN v1 = max(v1) OVER w THEN import_port_code ELSE 0 END END AS code
  FROM (SELECT *, CASE WHEN subregion_mo = 'EU' THEN v1 ELSE 0 END AS v2
        FROM (SELECT {grain}, CASE WHEN import_port_code IN (998, 999) THEN 0 ELSE sum(soy_eq) END AS v1
              FROM {source} GROUP BY {grain}))
  WINDOW w AS (PARTITION BY year, {keys}))
GROUP BY year, {keys} HAVING bool_or(import_port_code IN (998, 999))"""


TRADER = ["exporter_name", "importer_name"]


def import_cte(source: str = "flow") -> str:
    return f"""
SELECT f.* EXCLUDE (import_port_code),
  CASE WHEN f.import_port_code < 998 THEN f.import_port_code WHEN c1.candidate < 998 THEN c1.candidate
       ELSE c2.candidate END AS import_port_code,
  CASE WHEN f.import_port_code < 998 THEN 'Non_imputed' WHEN c1.candidate < 998 THEN 'Trader_imputed'
       ELSE 'Port_export_imputed' END AS import_country_data_quality
FROM {source} f
LEFT JOIN ({pool_candidate(TRADER, ['import_country_name'], source)}) c1 ON {_using('c1', TRADER)}
LEFT JOIN ({pool_candidate(['export_port_code'], [], source)}) c2 ON {_using('c2', ['export_port_code'])}"""


def reattach_cte(source: str, key: str, attributes: list[str], named: str, drop: list[str] = ()) -> str:
    names = ", ".join(attributes)
    gone = ", ".join([*attributes, *drop])
    picked = ", ".join(f"a.{n}" for n in attributes)
    return f"""
SELECT {picked}, f.* EXCLUDE ({gone}) FROM {source} f
LEFT JOIN (SELECT DISTINCT {key}, {names} FROM {source} WHERE {named}) a ON a.{key} IS NOT DISTINCT FROM f.{key}"""


ROUTE_OUT = """SELECT f.* REPLACE (
  CASE WHEN subregion_mo = 'Domestic' THEN 27 ELSE export_port_code END AS export_port_code,
  CASE WHEN subregion_mo = 'Domestic' THEN 'PROCESSED DOMESTICALLY' ELSE export_port_name END AS export_port_name,
  CASE WHEN subregion_mo = 'Domestic' THEN 'PROCESSED DOMESTICALLY' ELSE export_port_name_mo END AS export_port_name_mo,
  CASE WHEN subregion_mo = 'Domestic' THEN 9999998 ELSE port_municipality_code END AS port_municipality_code)
FROM {source} f"""
ROUTE_IN = """SELECT f.* REPLACE (
  CASE WHEN export_port_code = 27 THEN 'Domestic' ELSE economic_region END AS economic_region,
  CASE WHEN export_port_code = 27 THEN 'BRAZIL' ELSE import_country_name END AS import_country_name,
  CASE WHEN export_port_code = 27 THEN 'Domestic' ELSE subregion_mo END AS subregion_mo,
  CASE WHEN export_port_code = 27 THEN 15 ELSE import_port_code END AS import_port_code)
FROM {source} f"""

NODES = f"""WITH n1 AS ({origin_cte()}),
n2 AS ({reattach_cte('n1', 'municipality_code', T.ORIGIN_ATTRIBUTES, "municipality_name <> 'UNKNOWN'")}),
n3 AS ({ROUTE_OUT.format(source='n2')}),
n4 AS ({export_cte('n3')}),
n5 AS ({reattach_cte('n4', 'export_port_code', T.EXPORT_PORT_ATTRIBUTES,
                     "export_port_name_mo IS NOT NULL AND export_port_name_mo <> 'UNKNOWN'", ['export_port_name'])}),
n6 AS ({ROUTE_IN.format(source='n5')}),
n7 AS ({import_cte('n6')}),
nodes AS ({reattach_cte('n7', 'import_port_code', T.IMPORT_PORT_ATTRIBUTES, "economy_type <> 'UNKNOWN'")})"""

LAND_USE = """
land1 AS (SELECT *, CASE WHEN land_use IS NULL THEN soy_eq * avg(land_use) OVER l / avg(soy_eq) OVER l
                    ELSE land_use END AS land_use1
          FROM {source} WINDOW l AS (PARTITION BY municipality_code, year, exporter_name, importer_name)),
land2 AS (SELECT *, CASE WHEN land_use1 IS NULL THEN soy_eq * avg(land_use1) OVER l / avg(soy_eq) OVER l
                    ELSE land_use1 END AS land_use2
          FROM land1 WINDOW l AS (PARTITION BY municipality_code, year)),
landed AS (SELECT * EXCLUDE (land_use, land_use1, land_use2), land_use2 AS land_use,
             CASE WHEN land_use IS NOT NULL THEN 'Non_imputed' WHEN land_use1 IS NOT NULL
                  THEN 'Origin_node-Year-Company imputed' ELSE 'Origin_node-Year imputed' END AS land_use_quality_data
           FROM land2)"""

YIELDS = """
y0 AS (SELECT *, nullif(soy_yield, 0) AS y FROM yields),
y1 AS (SELECT *, avg(y) OVER (PARTITION BY municipality_code) AS ym FROM y0),
y2 AS (SELECT *, avg(ym) OVER (PARTITION BY state_code, year) AS ys FROM y1),
yielded AS (SELECT state_code, municipality_code, year, coalesce(double_cropping_share, 0) AS double_cropping_share,
  CASE WHEN double_cropping_share IS NULL THEN 'imputed' ELSE 'estimated' END AS double_cropping_quality,
  avg(ys) OVER (PARTITION BY state_code) AS soy_yield,
  CASE WHEN ys IS NULL THEN 'imputed based on state data' WHEN ym IS NULL
       THEN 'imputed based on state data in the concern year' WHEN y IS NULL
       THEN 'imputed based on municipality data' ELSE 'consulted' END AS soy_yield_quality FROM y2)"""

TRADE = """
trade_stats AS (SELECT CO_ANO AS year, CO_PAIS AS import_country_code, CO_MUN AS municipality_code,
  coalesce(sum(KG_LIQUIDO) FILTER (WHERE SH4 = 1201), 0) AS soybeans_a,
  coalesce(sum(KG_LIQUIDO) FILTER (WHERE SH4 = 1208), 0) AS meal_from_beans_a,
  coalesce(sum(KG_LIQUIDO) FILTER (WHERE SH4 = 1507), 0) AS oil_a,
  coalesce(sum(KG_LIQUIDO) FILTER (WHERE SH4 = 2304), 0) AS cake_a
  FROM exports WHERE SH4 IN (1201, 1208, 1507, 2304) GROUP BY ALL)"""

CONSUMPTION = """
used AS (SELECT year,
  sum(value) FILTER (WHERE product = '1. Grão') AS soybeans_a, CAST(0 AS DOUBLE) AS meal_from_beans_a,
  sum(value) FILTER (WHERE product NOT IN ('1. Grão', '2. Farelo')) AS oil_a,
  sum(value) FILTER (WHERE product = '2. Farelo') AS cake_a
  FROM crushing WHERE entry IN ('2.3.5. - Consumo interno', '2.2.5. - Consumo interno', '2.1.4. - Sementes/Outros')
  GROUP BY year)"""

FOREIGN_SOURCE = """
traded AS (SELECT f.*, k.import_country_code, t.soybeans_a, t.meal_from_beans_a, t.oil_a, t.cake_a
  FROM {source} f LEFT JOIN countries k USING (import_country_name)
  LEFT JOIN trade_stats t ON t.year = f.year AND t.import_country_code = k.import_country_code
    AND t.municipality_code IS NOT DISTINCT FROM f.municipality_code)"""


def tier_fill_cte(source: str, out: str, columns: list[str], tiers: list[list[str]], label: str,
                  labels: list[str]) -> str:
    """Tiered mean fill as one window query per tier."""
    first = columns[0]
    ctes = [f"{out}0 AS (SELECT *, CASE WHEN {first} IS NULL THEN '{labels[1]}' ELSE '{labels[0]}' END AS {label} FROM {source})"]
    for i, tier in enumerate(tiers, 1):
        over = f"OVER (PARTITION BY {', '.join(tier)})"
        fills = [f"coalesce({c}, avg({c}) {over}) AS {c}" for c in columns]
        ctes.append(f"{out}{i}a AS (SELECT * REPLACE ({', '.join(fills)}) FROM {out}{i - 1})")
        mark = f"CASE WHEN {first} IS NULL THEN '{labels[i + 1]}' ELSE {label} END" if i + 1 < len(labels) else label
        ctes.append(f"{out}{i} AS (SELECT * REPLACE ({mark} AS {label}) FROM {out}{i}a)")
    ctes.append(f"{out} AS (SELECT * FROM {out}{len(tiers)})")
    return ",\n".join(ctes)


PRODUCTS = T.PRODUCT_COLUMNS
FILLED = tier_fill_cte("foreign_flows", "filled", PRODUCTS, T.TRADE_TIERS, "data_quality_soy_a", [
    "original data", "Imputed based on average of origin-destination link",
    "Imputed based on average of destination country in the corresponding year",
    "Imputed based on average of origin municipality in the corresponding year",
    "Imputed based on average of destination country"])
FOREIGN = "foreign_flows AS (SELECT * FROM traded WHERE import_country_name <> 'BRAZIL')"

SPLIT = """
balance AS (SELECT *, 1.031 * meal_from_beans_a AS bean_for_meal, 1.031 * oil_a / 0.19 AS bean_for_oil,
  1.031 * cake_a / 0.81 AS bean_for_cake FROM {source}),
shares AS (SELECT *, soybeans_a / nullif(d, 0) AS sh_bean, bean_for_meal / nullif(d, 0) AS sh_meal,
  bean_for_cake / nullif(d, 0) AS sh_cake, bean_for_oil / nullif(d, 0) AS sh_oil
  FROM (SELECT *, soybeans_a + bean_for_meal + bean_for_oil + bean_for_cake AS d FROM balance)),
products AS (SELECT * EXCLUDE (d), soy_eq * sh_bean AS soybean, soy_eq * sh_meal / 1.031 AS bean_meal,
  soy_eq * sh_cake * 0.81 / 1.031 AS cake, soy_eq * sh_oil * 0.19 / 1.031 AS oil,
  sh_meal + sh_oil + sh_cake AS sh_crusing_to FROM shares)"""
SPLIT_COLUMNS = ["bean_for_meal", "bean_for_oil", "bean_for_cake", "sh_bean", "sh_meal", "sh_cake", "sh_oil",
                 "soybean", "bean_meal", "cake", "oil", "sh_crusing_to"]

PRICES = """
wide AS (SELECT year, month, {picks} FROM prices GROUP BY year, month),
yearly AS (SELECT year,
  CASE WHEN count(*) = count(Cakemeal_dom_price * dom_meal_c) THEN sum(Cakemeal_dom_price * dom_meal_c) END
    / nullif(CASE WHEN count(*) = count(dom_meal_c) THEN sum(dom_meal_c) END, 0) AS Cakemeal_dom_price,
  CASE WHEN count(*) = count(Oil_dom_price * dom_oil_c) THEN sum(Oil_dom_price * dom_oil_c) END
    / nullif(CASE WHEN count(*) = count(dom_oil_c) THEN sum(dom_oil_c) END, 0) AS Oil_dom_price,
  CASE WHEN count(*) = count(Cakemeal_for_price * for_meal_c) THEN sum(Cakemeal_for_price * for_meal_c) END
    / nullif(CASE WHEN count(*) = count(for_meal_c) THEN sum(for_meal_c) END, 0) AS Cakemeal_for_price,
  CASE WHEN count(*) = count(Oil_for_price * for_oil_c) THEN sum(Oil_for_price * for_oil_c) END
    / nullif(CASE WHEN count(*) = count(for_oil_c) THEN sum(for_oil_c) END, 0) AS Oil_for_price
  FROM wide GROUP BY year),
alloc AS (SELECT year,
  Cakemeal_dom_price * 0.81 / nullif(Cakemeal_dom_price * 0.81 + Oil_dom_price * 0.19, 0) AS dom_kmeal_af,
  Oil_dom_price * 0.19 / nullif(Cakemeal_dom_price * 0.81 + Oil_dom_price * 0.19, 0) AS dom_oil_af,
  Cakemeal_for_price * 0.81 / nullif(Cakemeal_for_price * 0.81 + Oil_for_price * 0.19, 0) AS for_kmeal_af,
  Oil_for_price * 0.19 / nullif(Cakemeal_for_price * 0.81 + Oil_for_price * 0.19, 0) AS for_oil_af
  FROM yearly)""".format(picks=", ".join(
    f"max(value) FILTER (WHERE variable = '{v}') AS {v}" for v in [*T.PRICE_PAIRS, *T.PRICE_PAIRS.values()]))


def rounded(df, columns, digits=6):
    """Round computed doubles so that summation order cannot show."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in columns})


def round_sql(columns, digits=6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


KEYS = "year, municipality_code, export_port_code, import_port_code, exporter_name, importer_name, soy_eq"


def _pick(df, *extra):
    return df.select(*[k.strip() for k in KEYS.split(",")], *extra)


def _q(view, fn):
    return lambda spark, sf: fn(load(spark, sf, view))


def _table(view, fn):
    """For operators that read their input more than once: the view as a table, as a user has it."""
    return lambda spark, sf: fn(hold(spark, sf, view))


def _traded(spark, sf):
    held = {"flow": hold(spark, sf, "flow")}
    return T.attach_trade(held["flow"], load(spark, sf, "countries"), T.trade_statistics(load(spark, sf, "exports", held)))


TRADED_FROM = TRADE + "," + FOREIGN_SOURCE.format(source="flow")


def _tables(spark, sf):
    held = {"flow": hold(spark, sf, "flow")}
    return held | {n: load(spark, sf, n, held) for n in
                   ["ports", "yields", "exports", "countries", "crushing", "prices"]}


def _domestic(spark, sf):
    home, _ = T.split_by_market(_traded(spark, sf))
    return T.attach_domestic(home, T.domestic_consumption(load(spark, sf, "crushing")))


HARMONISED_SUM = ["land_use", "soy_eq", "soybean", "bean_meal", "cake", "oil"]
HARMONISED_KEYS = ["year", "state_code", "municipality_code", "export_port_code", "export_port_code1",
                   "import_port_code", "import_port_acronym", "import_country_name", "import_country_code",
                   "subregion_mo", "economy_type", "world_region", "transport_type", "dummy_uf_reg",
                   "municipality_data_quality", "export_port_data_quality", "import_country_data_quality",
                   "land_use_quality_data", "soy_yield_quality", "double_cropping_quality", "data_quality_soy_a"]


def _harmonised(spark, sf):
    flows = complete_flows(_tables(spark, sf))
    return flows.groupBy(*HARMONISED_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.sum(c), 3).alias(c) for c in HARMONISED_SUM],
        *[F.round(F.max(c), 6).alias(c) for c in ["soy_yield", "double_cropping_share", "dom_kmeal_af", "for_oil_af"]])


HARMONISED_CTES = NODES + "," + LAND_USE.format(source="nodes") + "," + YIELDS + "," + TRADE + """,
based AS (SELECT f.*, p.* EXCLUDE (export_port_code, import_port_code),
  CASE WHEN f.state_code IN (11, 15, 21, 29, 31, 35, 41, 43, 50, 51, 52) THEN 'uf' WHEN f.state_code IS NOT NULL THEN 'reg' END AS dummy_uf_reg,
  y.soy_yield, y.soy_yield_quality, y.double_cropping_share, y.double_cropping_quality
  FROM landed f LEFT JOIN ports p ON f.export_port_code IS NOT DISTINCT FROM p.export_port_code
    AND f.import_port_code IS NOT DISTINCT FROM p.import_port_code
  LEFT JOIN yielded y ON f.state_code IS NOT DISTINCT FROM y.state_code
    AND f.municipality_code IS NOT DISTINCT FROM y.municipality_code AND f.year = y.year),""" \
    + FOREIGN_SOURCE.format(source="based") + "," + FOREIGN + "," + FILLED + "," + CONSUMPTION + """,
merged AS (SELECT * FROM filled UNION ALL BY NAME
  SELECT t.* EXCLUDE (soybeans_a, meal_from_beans_a, oil_a, cake_a), u.soybeans_a, u.meal_from_beans_a, u.oil_a, u.cake_a,
    'original data' AS data_quality_soy_a
  FROM traded t LEFT JOIN used u ON t.year = u.year WHERE import_country_name = 'BRAZIL'),""" \
    + SPLIT.format(source="merged") + "," + PRICES + """,
harmonised AS (SELECT p.* REPLACE (
    CASE WHEN import_country_name = 'BRAZIL' THEN export_port_code WHEN import_country_name IS NOT NULL THEN export_port_code1 END AS export_port_code1),
    g.* EXCLUDE (year)
  FROM products p LEFT JOIN alloc g ON p.year = g.year)"""


def checks() -> dict:
    out = {}

    def add(name, query, sql=None):
        out[name] = (query, oracle(sql) if sql else None)

    add("T01_origin_by_trader",
        _q("flow", lambda f: T.dominant_link(f, "municipality_code", T.ORIGIN_TIERS[0], [9999999])),
        candidate("municipality_code", T.ORIGIN_TIERS[0], "9999999"))
    for tag, link in zip(["country", "subregion", "economy"], T.ORIGIN_TIERS[1:]):
        add(f"T02_origin_by_{tag}",
            _q("flow", lambda f, link=link: T.dominant_link(f, "municipality_code", link, [9999999])),
            candidate("municipality_code", link, "9999999"))
    add("T03_origin_cascade", _table("flow", lambda f: _pick(T.fill_origins(f))),
        f"WITH x AS ({origin_cte()}) SELECT {KEYS} FROM x")
    add("T04_origin_label",
        _table("flow", lambda f: T.fill_origins(f).groupBy("year", "import_country_name", "municipality_data_quality")
           .agg(F.count(F.lit(1)).alias("n"), F.sum("soy_eq").alias("soy_eq"))),
        f"WITH x AS ({origin_cte()}) SELECT year, import_country_name, municipality_data_quality, count(*) AS n, "
        "sum(soy_eq) AS soy_eq FROM x GROUP BY ALL")
    add("T05_reattach_origin",
        _table("flow", lambda f: _pick(T.reattach_origins(T.fill_origins(f)), *T.ORIGIN_ATTRIBUTES)),
        f"WITH n1 AS ({origin_cte()}), x AS ({reattach_cte('n1', 'municipality_code', T.ORIGIN_ATTRIBUTES, chr(39).join(['municipality_name <> ', 'UNKNOWN', '']))}) "
        f"SELECT {KEYS}, {', '.join(T.ORIGIN_ATTRIBUTES)} FROM x")
    add("T05_reattach_export_port",
        _table("flow", lambda f: _pick(T.reattach_export_ports(T.fill_export_ports(f)), *T.EXPORT_PORT_ATTRIBUTES)),
        f"WITH n4 AS ({export_cte()}), x AS ({reattach_cte('n4', 'export_port_code', T.EXPORT_PORT_ATTRIBUTES, chr(39).join(['export_port_name_mo <> ', 'UNKNOWN', '']), ['export_port_name'])}) "
        f"SELECT {KEYS}, {', '.join(T.EXPORT_PORT_ATTRIBUTES)} FROM x")
    add("T05_reattach_destination",
        _table("flow", lambda f: T.reattach_destinations(T.fill_import_ports(f))
           .groupBy("year", "import_port_code", *T.IMPORT_PORT_ATTRIBUTES)
           .agg(F.count(F.lit(1)).alias("n"), F.sum("soy_eq").alias("soy_eq"))),
        f"WITH n7 AS ({import_cte()}), x AS ({reattach_cte('n7', 'import_port_code', T.IMPORT_PORT_ATTRIBUTES, chr(39).join(['economy_type <> ', 'UNKNOWN', '']))}) "
        f"SELECT year, import_port_code, {', '.join(T.IMPORT_PORT_ATTRIBUTES)}, count(*) AS n, sum(soy_eq) AS soy_eq FROM x GROUP BY ALL")
    add("T06_route_domestic_exports",
        _q("flow", lambda f: _pick(T.route_domestic_exports(f), "export_port_name", "export_port_name_mo", "port_municipality_code")),
        f"WITH x AS ({ROUTE_OUT.format(source='flow')}) SELECT {KEYS}, export_port_name, export_port_name_mo, port_municipality_code FROM x")
    add("T06_route_domestic_imports",
        _q("flow", lambda f: _pick(T.route_domestic_imports(f), "economic_region", "import_country_name", "subregion_mo")),
        f"WITH x AS ({ROUTE_IN.format(source='flow')}) SELECT {KEYS}, economic_region, import_country_name, subregion_mo FROM x")
    for tag, link in zip(["trader", "origin", "country"], T.EXPORT_PORT_TIERS):
        add(f"T07_port_by_{tag}",
            _q("flow", lambda f, link=link: T.dominant_link(f, "export_port_code", link, [99], [99, 27])),
            candidate("export_port_code", link, "99", "99, 27"))
    add("T08_port_cascade", _table("flow", lambda f: _pick(T.fill_export_ports(f), "export_port_data_quality")),
        f"WITH x AS ({export_cte()}) SELECT {KEYS}, export_port_data_quality FROM x")
    add("T09_destination_by_trader",
        _q("flow", lambda f: T.dominant_link_by_pool(f, TRADER, ["import_country_name"])),
        pool_candidate(TRADER, ["import_country_name"]))
    add("T09_destination_by_port",
        _q("flow", lambda f: T.dominant_link_by_pool(f, ["export_port_code"], [])),
        pool_candidate(["export_port_code"], []))
    add("T10_destination_cascade", _table("flow", lambda f: _pick(T.fill_import_ports(f), "import_country_data_quality")),
        f"WITH x AS ({import_cte()}) SELECT {KEYS}, import_country_data_quality FROM x")
    add("T11_land_use_fill", _q("flow", lambda f: rounded(_pick(T.fill_land_use(f), "land_use"), ["land_use"])),
        f"WITH {LAND_USE.format(source='flow')} SELECT {KEYS}, {round_sql(['land_use'])} FROM landed")
    add("T12_land_use_label",
        _q("flow", lambda f: T.fill_land_use(f).groupBy("year", "municipality_code", "land_use_quality_data")
           .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("land_use"), 4).alias("land_use"))),
        f"WITH {LAND_USE.format(source='flow')} SELECT year, municipality_code, land_use_quality_data, count(*) AS n, "
        "round(sum(land_use), 4) AS land_use FROM landed GROUP BY ALL")
    port_columns = ["export_port_code1", "export_port_name_mo1", "import_port_acronym", "transport_type", "export_port_latitude"]
    add("T13_port_attributes",
        lambda s, d: _pick(attach(load(s, d, "flow"), load(s, d, "ports"), ["export_port_code", "import_port_code"]), *port_columns),
        f"SELECT {KEYS.replace('export_port_code', 'f.export_port_code').replace('import_port_code', 'f.import_port_code')}, "
        f"{', '.join(port_columns)} FROM flow f LEFT JOIN ports p ON f.export_port_code = p.export_port_code AND f.import_port_code = p.import_port_code")
    add("T14_state_flag", _q("flow", lambda f: T.flag_state_data(f).groupBy("state_code", "dummy_uf_reg").agg(F.count(F.lit(1)).alias("n"))),
        "SELECT state_code, CASE WHEN state_code IN (11, 15, 21, 29, 31, 35, 41, 43, 50, 51, 52) THEN 'uf' "
        "WHEN state_code IS NOT NULL THEN 'reg' END AS dummy_uf_reg, count(*) AS n FROM flow GROUP BY ALL")
    add("T15_yield_cascade",
        _q("yields", lambda y: rounded(T.complete_yields(y), ["soy_yield"]).drop("double_cropping_share")),
        f"WITH {YIELDS} SELECT state_code, municipality_code, year, {round_sql(['soy_yield'])}, soy_yield_quality FROM yielded")
    add("T16_double_cropping",
        lambda s, d: _pick(T.attach_yields(load(s, d, "flow"), T.complete_double_cropping(load(s, d, "yields"))),
                           "double_cropping_share", "double_cropping_quality"),
        f"WITH {YIELDS} SELECT {KEYS.replace('year', 'f.year').replace('municipality_code', 'f.municipality_code')}, "
        "double_cropping_share, double_cropping_quality FROM flow f LEFT JOIN yielded y ON f.state_code = y.state_code "
        "AND f.municipality_code = y.municipality_code AND f.year = y.year")
    add("T17_trade_statistics", _q("exports", T.trade_statistics), f"WITH {TRADE} SELECT * FROM trade_stats")
    add("T18_trade_attach", lambda s, d: _pick(_traded(s, d), "import_country_code", *PRODUCTS),
        f"WITH {TRADED_FROM} SELECT {KEYS}, import_country_code, {', '.join(PRODUCTS)} FROM traded")
    add("T19_market_split_domestic",
        lambda s, d: _pick(T.split_by_market(_traded(s, d))[0], "import_country_code"),
        f"WITH {TRADED_FROM} SELECT {KEYS}, import_country_code FROM traded WHERE import_country_name = 'BRAZIL'")
    add("T19_market_split_foreign",
        lambda s, d: _pick(T.split_by_market(_traded(s, d))[1], *PRODUCTS),
        f"WITH {TRADED_FROM} SELECT {KEYS}, {', '.join(PRODUCTS)} FROM traded WHERE import_country_name <> 'BRAZIL'")
    add("T20_domestic_consumption", lambda s, d: _pick(_domestic(s, d), *PRODUCTS, "data_quality_soy_a"),
        f"WITH {TRADED_FROM},{CONSUMPTION} SELECT {KEYS.replace('year', 't.year')}, "
        f"{', '.join('u.' + p for p in PRODUCTS)}, 'original data' AS data_quality_soy_a FROM traded t "
        "LEFT JOIN used u ON t.year = u.year WHERE import_country_name = 'BRAZIL'")
    add("T21_trade_tier_fill",
        lambda s, d: rounded(_pick(T.fill_trade(T.split_by_market(_traded(s, d))[1]), *PRODUCTS, "data_quality_soy_a"), PRODUCTS),
        f"WITH {TRADED_FROM},{FOREIGN},{FILLED} SELECT {KEYS}, {round_sql(PRODUCTS)}, data_quality_soy_a FROM filled")
    add("T22_residual_nulls",
        lambda s, d: _pick(T.missing_trade(T.split_by_market(_traded(s, d))[1])),
        f"WITH {TRADED_FROM},{FOREIGN} SELECT {KEYS} FROM foreign_flows WHERE soybeans_a IS NULL OR oil_a IS NULL "
        "OR cake_a IS NULL OR meal_from_beans_a IS NULL")
    add("T23_recombine",
        lambda s, d: _pick(T.recombine(_domestic(s, d), T.split_by_market(_traded(s, d))[1].withColumn("data_quality_soy_a", F.lit("raw"))),
                           *PRODUCTS, "data_quality_soy_a"),
        f"WITH {TRADED_FROM},{CONSUMPTION} SELECT {KEYS}, {', '.join(PRODUCTS)}, 'raw' AS data_quality_soy_a "
        f"FROM traded WHERE import_country_name <> 'BRAZIL' UNION ALL SELECT {KEYS.replace('year', 't.year')}, "
        f"{', '.join('u.' + p for p in PRODUCTS)}, 'original data' FROM traded t LEFT JOIN used u ON t.year = u.year "
        "WHERE import_country_name = 'BRAZIL'")
    add("T24_product_split", lambda s, d: rounded(_pick(T.split_products(_traded(s, d)), *SPLIT_COLUMNS), SPLIT_COLUMNS),
        f"WITH {TRADED_FROM},{SPLIT.format(source='traded')} SELECT {KEYS}, {round_sql(SPLIT_COLUMNS)} FROM products")
    add("T25_yearly_prices", _q("prices", lambda p: rounded(T.yearly_prices(p), list(T.PRICE_PAIRS))),
        f"WITH {PRICES} SELECT year, {round_sql(list(T.PRICE_PAIRS))} FROM yearly")
    factors = ["dom_kmeal_af", "dom_oil_af", "for_kmeal_af", "for_oil_af"]
    add("T26_allocation_factors",
        lambda s, d: rounded(_pick(attach(load(s, d, "flow"), T.allocation_factors(T.yearly_prices(load(s, d, "prices"))), ["year"]), *factors), factors),
        f"WITH {PRICES} SELECT {KEYS.replace('year', 'f.year')}, {round_sql(factors)} FROM flow f LEFT JOIN alloc g ON f.year = g.year")
    add("T27_domestic_port_keys",
        lambda s, d: _pick(T.standardise_domestic_ports(attach(load(s, d, "flow"), load(s, d, "ports"), ["export_port_code", "import_port_code"])),
                           "export_port_code1", "export_port_name_mo1", "export_port_acronym_mo1"),
        f"""SELECT {KEYS.replace('export_port_code', 'f.export_port_code').replace('import_port_code', 'f.import_port_code')},
  CASE WHEN import_country_name = 'BRAZIL' THEN f.export_port_code ELSE export_port_code1 END AS export_port_code1,
  CASE WHEN import_country_name = 'BRAZIL' THEN export_port_name_mo ELSE export_port_name_mo1 END AS export_port_name_mo1,
  CASE WHEN import_country_name = 'BRAZIL' THEN 'BRDOM' ELSE export_port_acronym_mo1 END AS export_port_acronym_mo1
FROM flow f LEFT JOIN ports p ON f.export_port_code = p.export_port_code AND f.import_port_code = p.import_port_code""")
    add("T28_harmonised_flows", _harmonised,
        HARMONISED_CTES + f" SELECT {', '.join(HARMONISED_KEYS)}, count(*) AS n, "
        + ", ".join(f"round(sum({c}), 3) AS {c}" for c in HARMONISED_SUM) + ", "
        + ", ".join(f"round(max({c}), 6) AS {c}" for c in ["soy_yield", "double_cropping_share", "dom_kmeal_af", "for_oil_af"])
        + " FROM harmonised GROUP BY ALL")
    add("T00_completed_nodes",
        _table("flow", lambda f: complete_nodes(f).groupBy(
            "year", "municipality_data_quality", "export_port_data_quality", "import_country_data_quality",
            "import_country_name", "subregion_mo").agg(F.count(F.lit(1)).alias("n"), F.sum("soy_eq").alias("soy_eq"))),
        NODES + " SELECT year, municipality_data_quality, export_port_data_quality, import_country_data_quality, "
        "import_country_name, subregion_mo, count(*) AS n, sum(soy_eq) AS soy_eq FROM nodes GROUP BY ALL")
    return out
