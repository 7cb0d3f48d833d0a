"""Trade-flow completion: unknown nodes, missing measures, product volumes and allocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.functions.nulls import as_col, match, nan_to_null, ratio, row_total, strict_sum
from furrow.operators.relational import (attach, fill_by_tier_means, keep_facts, rows_with_nulls,
                                         stack, widen)
from furrow.sources.stages import stage

ORIGIN_TIERS = [["exporter_name", "importer_name"], ["import_country_name"], ["subregion_mo"],
                ["economy_type"]]
EXPORT_PORT_TIERS = [["exporter_name", "importer_name"], ["municipality_code"],
                     ["import_country_name"]]
IMPORT_PORT_TIERS = [["exporter_name", "importer_name"], ["export_port_code"]]
IMPORT_PORT_CELLS = [["import_country_name"], []]
ORIGIN_ATTRIBUTES = ["biome", "region_code", "region_name", "state_code", "state_name",
                     "municipality_name"]
EXPORT_PORT_ATTRIBUTES = ["export_port_name_mo", "port_municipality_code"]
IMPORT_PORT_ATTRIBUTES = ["import_country_name", "economic_region", "subregion", "subregion_mo",
                          "economy_type"]
PRODUCT_COLUMNS = ["soybeans_a", "meal_from_beans_a", "oil_a", "cake_a"]
TRADE_TIERS = [["municipality_code", "import_country_name"], ["import_country_name", "year"],
               ["municipality_code", "year"], ["import_country_name"]]


# --- dominant trade links --------------------------------------------------------------------

def tier_volumes(flows: DataFrame, cells: Sequence[Sequence[str]], tiers: Sequence[Sequence[str]],
                 measure: str) -> DataFrame:
    """Volume per year, tier key and cell for all tiers in one pass over the flows.

    Grouping sets give each tier its own key; keys of the other tiers are null in its rows and
    `tier` tells the sets apart.
    """
    sets = [list(dict.fromkeys(["year", *cell, *tier])) for cell, tier in zip(cells, tiers)]
    keys = list(dict.fromkeys(k for group in sets for k in group))
    ids = [sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in group)
           for group in sets]
    tier = match(F.col("__set"), {gid: i for i, gid in enumerate(ids, 1)})
    sums = flows.groupingSets(sets, *keys).agg(strict_sum(measure).alias("volume"),
                                               F.grouping_id().alias("__set"))
    return sums.withColumn("tier", tier).drop("__set")


def dominant_links(flows: DataFrame, node: str, tiers: Sequence[Sequence[str]],
                   unknown: Sequence[int], excluded: Sequence[int] | None = None,
                   measure: str = "soy_eq") -> DataFrame:
    """Per tier, year and link: the node code that carries the largest volume.

    Excluded codes compete with volume zero, ties go to the largest code and a missing volume
    leaves the link without a candidate. Only links that have an unknown node are returned, as no
    other row asks for a candidate. Two combining aggregations, no window: a link that holds a
    third of all flows arrives at its reducer as a few partial maxima.
    """
    links = list(dict.fromkeys(k for tier in tiers for k in tier))
    competing = F.when(as_col(node).isin(list(excluded or unknown)), F.lit(0.0)) \
        .otherwise(F.col("volume"))
    best = tier_volumes(flows, [[node]] * len(tiers), tiers, measure).groupBy("tier", "year", *links).agg(
        F.when(F.count(F.lit(1)) == F.count(competing),
               F.max(F.struct(competing.alias("v"), as_col(node).alias("code")))["code"])
        .alias("candidate"),
        F.max(as_col(node).isin(list(unknown))).alias("__asked"))
    return best.where("__asked").drop("__asked")


def dominant_link(flows: DataFrame, node: str, link: Sequence[str], unknown: Sequence[int],
                  excluded: Sequence[int] | None = None, measure: str = "soy_eq") -> DataFrame:
    """`dominant_links` of a single tier."""
    return dominant_links(flows, node, [link], unknown, excluded, measure).drop("tier")


def dominant_links_by_pool(flows: DataFrame, tiers: Sequence[Sequence[str]],
                           cells: Sequence[Sequence[str]], node: str = "import_port_code",
                           pool: str = "subregion_mo",
                           unknown: Sequence[int] = K.UNKNOWN_IMPORT_PORT,
                           measure: str = "soy_eq") -> DataFrame:
    """Dominant links in which the pooled region competes only on its own volume.

    Cells of the pooled region qualify when they reach the group's largest pooled volume, other
    cells when they reach the largest volume of all; the largest qualifying code is the candidate.
    """
    links = list(dict.fromkeys(k for tier in tiers for k in tier))
    rows = tier_volumes(flows, [[node, pool, *extra] for extra in cells], tiers, measure)
    pooled = as_col(pool) == K.POOLED_REGION
    rows = rows.withColumn("v_all", F.when(as_col(node).isin(list(unknown)), F.lit(0.0))
                           .otherwise(F.col("volume")))
    rows = rows.withColumn("v_pool", F.when(pooled, F.col("v_all")).when(~pooled, F.lit(0.0)))
    pair = F.struct(F.col("v_all").alias("v"), as_col(node).alias("code"))
    best = rows.groupBy("tier", "year", *links).agg(
        F.count(F.lit(1)).alias("n"), F.count("v_all").alias("n_all"),
        F.count("v_pool").alias("n_pool"),
        F.max("v_all").alias("top_all"), F.max("v_pool").alias("top_pool"),
        F.max(F.when(~pooled, pair)).alias("other"), F.max(F.when(pooled, pair)).alias("own"),
        F.max(as_col(node).isin(list(unknown))).alias("asked"))
    code = F.greatest(
        F.when(F.col("other.v") == F.col("top_all"), F.col("other.code")).otherwise(F.lit(0)),
        F.when(F.col("own.v") == F.col("top_pool"), F.col("own.code")).otherwise(F.lit(0)))
    complete = (F.col("n") == F.col("n_all")) & (F.col("n") == F.col("n_pool"))
    return best.where("asked").select("tier", "year", *links,
                                      F.when(complete, code).alias("candidate"))


def dominant_link_by_pool(flows: DataFrame, link: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """`dominant_links_by_pool` of a single tier."""
    return dominant_links_by_pool(flows, [link], [cell]).drop("tier")


def attach_candidates(flows: DataFrame, candidates: DataFrame, tiers: Sequence[Sequence[str]]
                      ) -> DataFrame:
    """Candidate columns candidate1, candidate2, … next to every flow.

    The candidates of all tiers are worked out once; each tier then gets a stage table of its own,
    so that the size of that tier alone decides whether it is broadcast.
    """
    table = stage(candidates, "candidates")
    for i, link in enumerate(tiers, 1):
        own = table.where(F.col("tier") == i).select(
            "year", *link, F.col("candidate").alias(f"candidate{i}"))
        flows = attach(flows, stage(own, "tier_candidates"), ["year", *link])
    return flows


def tier_choice(node: str, n: int, known, results: Sequence[Column]) -> Column:
    """First known of the node and its candidates picks the result; the last one needs no test."""
    chain = F.when(known(as_col(node)), results[0])
    for i in range(1, n):
        test = known(F.col(f"candidate{i}"))
        chain = chain.when(test.isNull(), F.lit(None)).when(test, results[i])
    return F.when(known(as_col(node)).isNull(), F.lit(None)).otherwise(chain.otherwise(results[n]))


def fill_node(flows: DataFrame, node: str, candidates: DataFrame, tiers: Sequence[Sequence[str]],
              known, label: str, labels: Sequence[str]) -> DataFrame:
    """Replace unknown codes by the first known tier and record which tier that was. Rows that need
    no candidate are not joined; the others are read once more."""
    n = len(tiers)
    asks = F.coalesce(~known(as_col(node)), F.lit(False))
    kept = flows.where(~asks).withColumns({
        node: F.when(known(as_col(node)), as_col(node)), label: F.when(known(as_col(node)), F.lit(labels[0]))})
    joined = attach_candidates(flows.where(asks), candidates, tiers)
    chosen = tier_choice(node, n, known,
                         [as_col(node), *[F.col(f"candidate{i}") for i in range(1, n + 1)]])
    named = tier_choice(node, n, known, [F.lit(text) for text in labels])
    return stack([kept, joined.withColumns({node: chosen, label: named}).drop(
        *[f"candidate{i}" for i in range(1, n + 1)])])


def fill_origins(flows: DataFrame) -> DataFrame:
    candidates = dominant_links(flows, "municipality_code", ORIGIN_TIERS, K.UNKNOWN_ORIGIN)
    return fill_node(flows, "municipality_code", candidates, ORIGIN_TIERS,
                     lambda c: ~c.isin(K.UNKNOWN_ORIGIN), "municipality_data_quality",
                     K.ORIGIN_LABELS)


def fill_export_ports(flows: DataFrame) -> DataFrame:
    candidates = dominant_links(flows, "export_port_code", EXPORT_PORT_TIERS,
                                K.UNKNOWN_EXPORT_PORT, [*K.UNKNOWN_EXPORT_PORT, K.DOMESTIC_PORT])
    return fill_node(flows, "export_port_code", candidates, EXPORT_PORT_TIERS,
                     lambda c: ~c.isin(K.UNKNOWN_EXPORT_PORT), "export_port_data_quality",
                     K.EXPORT_PORT_LABELS)


def fill_import_ports(flows: DataFrame) -> DataFrame:
    candidates = dominant_links_by_pool(flows, IMPORT_PORT_TIERS, IMPORT_PORT_CELLS)
    return fill_node(flows, "import_port_code", candidates, IMPORT_PORT_TIERS,
                     lambda c: c < min(K.UNKNOWN_IMPORT_PORT), "import_country_data_quality",
                     K.IMPORT_PORT_LABELS)


def reattach(flows: DataFrame, key: str, attributes: Sequence[str], named: Column) -> DataFrame:
    """Give every row the attributes that known rows of its code carry. A code with several
    attribute rows fans out."""
    table = flows.select(key, *attributes).where(named).distinct()
    return keep_facts(stage(table, "attributes"), flows.drop(*attributes), [key])


def reattach_origins(flows: DataFrame) -> DataFrame:
    return reattach(flows, "municipality_code", ORIGIN_ATTRIBUTES,
                    F.col("municipality_name") != K.UNKNOWN_NAME)


def reattach_export_ports(flows: DataFrame) -> DataFrame:
    slim = flows.drop("export_port_name")
    return reattach(slim, "export_port_code", EXPORT_PORT_ATTRIBUTES,
                    F.col("export_port_name_mo").isNotNull()
                    & (F.col("export_port_name_mo") != K.UNKNOWN_NAME))


def reattach_destinations(flows: DataFrame) -> DataFrame:
    return reattach(flows, "import_port_code", IMPORT_PORT_ATTRIBUTES,
                    F.col("economy_type") != K.UNKNOWN_NAME)


# --- domestic routes -------------------------------------------------------------------------

def _override(flows: DataFrame, test: Column, values: dict) -> DataFrame:
    """Overwrite columns where the test holds; a missing test leaves a missing value."""
    return flows.withColumns({c: F.when(test, F.lit(v)).when(~test, as_col(c))
                              for c, v in values.items()})


def route_domestic_exports(flows: DataFrame) -> DataFrame:
    return _override(flows, F.col("subregion_mo") == K.DOMESTIC_REGION, {
        "export_port_code": K.DOMESTIC_PORT, "export_port_name": K.DOMESTIC_PORT_NAME,
        "export_port_name_mo": K.DOMESTIC_PORT_NAME,
        "port_municipality_code": K.DOMESTIC_PORT_UNIT})


def route_domestic_imports(flows: DataFrame) -> DataFrame:
    return _override(flows, F.col("export_port_code") == K.DOMESTIC_PORT, {
        "economic_region": K.DOMESTIC_REGION, "import_country_name": K.DOMESTIC_COUNTRY,
        "subregion_mo": K.DOMESTIC_REGION, "import_port_code": K.DOMESTIC_IMPORT_PORT})


def standardise_domestic_ports(flows: DataFrame) -> DataFrame:
    home = F.col("import_country_name") == K.DOMESTIC_COUNTRY
    swap = {"export_port_code1": F.col("export_port_code"),
            "export_port_name_mo1": F.col("export_port_name_mo"),
            "export_port_acronym_mo1": F.lit(K.DOMESTIC_ACRONYM)}
    return flows.withColumns({c: F.when(home, v).when(~home, as_col(c)) for c, v in swap.items()})


# --- land use and yields ---------------------------------------------------------------------

def fill_land_use(flows: DataFrame) -> DataFrame:
    """Missing land use = volume × mean land use / mean volume, by trade link then by origin.

    Both ratios come from one staged table of partial sums per link; the second tier's mean counts
    the first tier's fills, whose sum is ratio × (volume of the rows filled).
    """
    link, origin = ["municipality_code", "year", "exporter_name", "importer_name"], \
        ["municipality_code", "year"]
    clean = flows.withColumns({c: nan_to_null(c) for c in ["land_use", "soy_eq"]})
    gap = F.col("land_use").isNull()
    sums = stage(clean.groupBy(*link).agg(
        F.coalesce(F.sum("land_use"), F.lit(0.0)).alias("s_lu"), F.count("land_use").alias("k_lu"),
        F.coalesce(F.sum("soy_eq"), F.lit(0.0)).alias("s_eq"), F.count("soy_eq").alias("k_eq"),
        F.coalesce(F.sum(F.when(gap, F.col("soy_eq"))), F.lit(0.0)).alias("s_gap"),
        F.count(F.when(gap, F.col("soy_eq"))).alias("k_gap")), "land_use_sums")
    sums = sums.withColumn("ratio1", ratio(ratio("s_lu", "k_lu"), ratio("s_eq", "k_eq")))
    filled = F.col("ratio1").isNotNull()
    by_origin = sums.groupBy(*origin).agg(
        F.sum(F.col("s_lu") + F.coalesce(F.col("ratio1") * F.col("s_gap"), F.lit(0.0)))
        .alias("s_lu"),
        F.sum(F.col("k_lu") + F.when(filled, F.col("k_gap")).otherwise(F.lit(0))).alias("k_lu"),
        F.sum("s_eq").alias("s_eq"), F.sum("k_eq").alias("k_eq"))
    by_origin = by_origin.select(
        *origin, ratio(ratio("s_lu", "k_lu"), ratio("s_eq", "k_eq")).alias("ratio2"))
    out = attach(clean, sums.where("k_gap > 0").select(*link, "ratio1"), link)
    out = attach(out, stage(by_origin, "land_use_ratio"), origin)
    first, second = F.col("soy_eq") * F.col("ratio1"), F.col("soy_eq") * F.col("ratio2")
    return out.withColumns({
        "land_use": F.coalesce(F.col("land_use"), first, second),
        "land_use_quality_data": F.when(~gap, F.lit(K.LAND_USE_LABELS[0]))
        .when(first.isNotNull(), F.lit(K.LAND_USE_LABELS[1]))
        .otherwise(F.lit(K.LAND_USE_LABELS[2]))}).drop("ratio1", "ratio2")


def flag_state_data(flows: DataFrame) -> DataFrame:
    """'uf' where the state has its own inventories, 'reg' where the region stands in."""
    return flows.withColumn("dummy_uf_reg", F.when(F.col("state_code").isNull(), F.lit(None))
                            .when(F.col("state_code").isin(K.STATE_DATA_CODES), F.lit("uf"))
                            .otherwise(F.lit("reg")))


def complete_double_cropping(yields: DataFrame) -> DataFrame:
    share = nan_to_null("double_cropping_share")
    return yields.withColumns({
        "double_cropping_quality": F.when(share.isNull(), F.lit("imputed"))
        .otherwise(F.lit("estimated")),
        "double_cropping_share": F.coalesce(share, F.lit(0.0))})


def complete_yields(yields: DataFrame) -> DataFrame:
    """Yields overwritten by unit means, then state-year means of those, then state means.

    Sums and counts per (state, unit, year) carry all three levels, so the yield table itself is
    only joined to the finished means.
    """
    known = F.when(nan_to_null("soy_yield") != 0, nan_to_null("soy_yield"))
    clean = yields.withColumn("soy_yield", known)
    cells = stage(clean.groupBy("state_code", "municipality_code", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("soy_yield").alias("s"),
        F.count("soy_yield").alias("k")), "yield_cells")
    unit = stage(cells.groupBy("municipality_code").agg(
        ratio(F.sum("s"), F.sum("k")).alias("unit_mean")), "yield_units")
    state_year = stage(attach(cells, unit, ["municipality_code"])
                       .groupBy("state_code", "year").agg(
        F.sum("n").alias("n"),
        ratio(F.sum(F.col("n") * F.col("unit_mean")),
              F.sum(F.when(F.col("unit_mean").isNotNull(), F.col("n")))).alias("year_mean")),
        "yield_state_years")
    state = stage(state_year.groupBy("state_code").agg(
        ratio(F.sum(F.col("n") * F.col("year_mean")),
              F.sum(F.when(F.col("year_mean").isNotNull(), F.col("n")))).alias("state_mean")),
        "yield_states")
    out = attach(clean, unit, ["municipality_code"])
    out = attach(out, state_year.drop("n"), ["state_code", "year"])
    out = attach(out, state, ["state_code"])
    quality = F.when(F.col("year_mean").isNull(), F.lit(K.YIELD_LABELS[3])) \
        .when(F.col("unit_mean").isNull(), F.lit(K.YIELD_LABELS[2])) \
        .when(F.col("soy_yield").isNull(), F.lit(K.YIELD_LABELS[1])) \
        .otherwise(F.lit(K.YIELD_LABELS[0]))
    return out.withColumns({"soy_yield_quality": quality, "soy_yield": F.col("state_mean")}) \
        .drop("unit_mean", "year_mean", "state_mean")


def attach_yields(flows: DataFrame, yields: DataFrame) -> DataFrame:
    return attach(flows, yields, ["state_code", "municipality_code", "year"])


# --- trade statistics ------------------------------------------------------------------------

def trade_statistics(exports: DataFrame) -> DataFrame:
    """Exported mass by year, country, unit and product, missing products as zero."""
    kept = exports.where(F.col("SH4").isin(list(K.TRADE_CODES)))
    sums = kept.groupBy("CO_ANO", "CO_PAIS", "CO_MUN", "SH4").agg(
        strict_sum("KG_LIQUIDO").alias("kg"))
    wide = widen(sums, ["CO_ANO", "CO_PAIS", "CO_MUN"], "SH4", K.TRADE_CODES, "kg")
    return wide.fillna(0, subset=list(K.TRADE_CODES.values())).withColumnsRenamed({
        "CO_ANO": "year", "CO_PAIS": "import_country_code", "CO_MUN": "municipality_code"})


def attach_trade(flows: DataFrame, countries: DataFrame, statistics: DataFrame) -> DataFrame:
    ids = countries.select("import_country_name", "import_country_code")
    coded = attach(flows, ids, ["import_country_name"])
    return attach(coded, statistics, ["year", "import_country_code", "municipality_code"])


def split_by_market(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Domestic flows without trade statistics, and foreign flows; an unknown country is in
    neither."""
    home = F.col("import_country_name") == K.DOMESTIC_COUNTRY
    return flows.where(home).drop(*PRODUCT_COLUMNS), flows.where(~home)


def domestic_consumption(crushing: DataFrame) -> DataFrame:
    """Domestic use by product and year (months summed), direct meal set to zero."""
    product = match(F.col("product"), K.CRUSHING_PRODUCTS, F.lit("oil_a"))
    used = crushing.where(F.col("entry").isin(K.DOMESTIC_ENTRIES)).withColumn("product", product)
    wide = widen(used, ["year"], "product", {c: c for c in ["soybeans_a", "oil_a", "cake_a"]},
                 "value")
    return wide.withColumn("meal_from_beans_a", F.lit(0.0)).select("year", *PRODUCT_COLUMNS)


def attach_domestic(domestic: DataFrame, consumption: DataFrame) -> DataFrame:
    return attach(domestic, consumption, ["year"]).withColumn(
        "data_quality_soy_a", F.lit(K.TRADE_LABELS[0]))


def fill_trade(foreign: DataFrame) -> DataFrame:
    return fill_by_tier_means(foreign, PRODUCT_COLUMNS, TRADE_TIERS, "data_quality_soy_a",
                              K.TRADE_LABELS)


def missing_trade(foreign: DataFrame) -> DataFrame:
    return rows_with_nulls(foreign, PRODUCT_COLUMNS)


def recombine(domestic: DataFrame, foreign: DataFrame) -> DataFrame:
    return stack([domestic, foreign])


# --- products and prices ---------------------------------------------------------------------

def split_products(flows: DataFrame) -> DataFrame:
    """Bean equivalents of the four products, their shares and the volumes they imply."""
    flows = flows.withColumns({
        "bean_for_meal": K.BEAN_PER_EQ * F.col("meal_from_beans_a"),
        "bean_for_oil": K.BEAN_PER_EQ * F.col("oil_a") / K.OIL_MASS,
        "bean_for_cake": K.BEAN_PER_EQ * F.col("cake_a") / K.MEAL_MASS})
    parts = {"sh_bean": "soybeans_a", "sh_meal": "bean_for_meal", "sh_cake": "bean_for_cake",
             "sh_oil": "bean_for_oil"}
    whole = row_total(["soybeans_a", "bean_for_meal", "bean_for_oil", "bean_for_cake"])
    flows = flows.withColumns({share: ratio(part, whole) for share, part in parts.items()})
    volume = F.col("soy_eq")
    return flows.withColumns({
        "soybean": volume * F.col("sh_bean"),
        "bean_meal": volume * F.col("sh_meal") / K.BEAN_PER_EQ,
        "cake": volume * F.col("sh_cake") * K.MEAL_MASS / K.BEAN_PER_EQ,
        "oil": volume * F.col("sh_oil") * K.OIL_MASS / K.BEAN_PER_EQ,
        "sh_crusing_to": row_total(["sh_meal", "sh_oil", "sh_cake"])})


PRICE_PAIRS = {"Cakemeal_dom_price": "dom_meal_c", "Oil_dom_price": "dom_oil_c",
               "Cakemeal_for_price": "for_meal_c", "Oil_for_price": "for_oil_c"}


def yearly_prices(prices: DataFrame) -> DataFrame:
    """Volume-weighted yearly price of meal and oil, at home and abroad."""
    names = [*PRICE_PAIRS, *PRICE_PAIRS.values()]
    wide = widen(prices, ["year", "month"], "variable", {n: n for n in names}, "value", False)
    worth = {p: strict_sum(F.col(p) * F.col(q)) for p, q in PRICE_PAIRS.items()}
    sums = wide.groupBy("year").agg(
        *[total.alias(f"worth_{p}") for p, total in worth.items()],
        *[strict_sum(q).alias(q) for q in PRICE_PAIRS.values()])
    return sums.select("year", *[ratio(f"worth_{p}", q).alias(p) for p, q in PRICE_PAIRS.items()])


def allocation_factors(yearly: DataFrame) -> DataFrame:
    """Economic share of meal and oil in the value of crushed beans; each pair sums to one."""
    out = ["year"]
    for market, tag in [("dom", "dom"), ("for", "for")]:
        meal = F.col(f"Cakemeal_{tag}_price") * K.MEAL_MASS
        oil = F.col(f"Oil_{tag}_price") * K.OIL_MASS
        out += [ratio(meal, meal + oil).alias(f"{market}_kmeal_af"),
                ratio(oil, meal + oil).alias(f"{market}_oil_af")]
    return yearly.select(*out)


HARMONISED = [
    "year", "biome", "region_code", "region_name", "state_code", "state_name",
    "municipality_code", "municipality_name", "export_port_code", "export_port_name_mo",
    "export_port_code1", "export_port_name_mo1", "export_port_acronym_mo1",
    "port_municipality_code", "logistics_hub", "exporter_name", "importer_name", "importer_group",
    "import_port_acronym", "import_port_code", "import_port_name", "import_country_code",
    "import_country_name", "economic_region", "subregion", "subregion_mo", "world_region", "economy_type", "fob",
    "land_use", "soy_yield", "soy_eq", "soybean", "bean_meal", "cake", "oil", *PRODUCT_COLUMNS,
    "bean_for_meal", "bean_for_cake", "bean_for_oil", "sh_bean", "sh_meal", "sh_cake", "sh_oil",
    "sh_crusing_to", "dom_kmeal_af", "dom_oil_af", "for_kmeal_af", "for_oil_af",
    "double_cropping_share", "dummy_uf_reg", "transport_type", "export_port_latitude",
    "export_port_longitude", "import_port_latitude", "import_port_longitude",
    "municipality_data_quality",
    "export_port_data_quality", "import_country_data_quality", "land_use_quality_data",
    "soy_yield_quality", "double_cropping_quality", "data_quality_soy_a"]


def harmonise(flows: DataFrame) -> DataFrame:
    return flows.select(*HARMONISED)
