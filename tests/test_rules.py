"""Hand-computed cases: nulls, ties, zeros, fan-out, and the rules that are easy to get wrong."""

import math

import pytest
from pyspark.sql import functions as F

from furrow.functions.nulls import strict_avg, strict_sum
from furrow.operators import carbon as E
from furrow.operators import flows as T
from furrow.operators import grid as S
from furrow.operators import impact as I
from furrow.operators import inventory as L
from furrow.operators import relational as V
from furrow.operators import stress as B

FLOW = "year int, a string, code bigint, soy_eq double"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_dominant_link_ties_go_to_the_largest_code(spark):
    df = spark.createDataFrame([(1, "x", 5, 3.0), (1, "x", 8, 3.0), (1, "x", 99, 50.0)], FLOW)
    assert rows(T.dominant_link(df, "code", ["a"], [99]), "a", "candidate") == [("x", 8)]


def test_dominant_link_with_only_unknowns_stays_unknown(spark):
    df = spark.createDataFrame([(1, "x", 99, 50.0), (1, "y", 3, 1.0)], FLOW)
    assert rows(T.dominant_link(df, "code", ["a"], [99]), "a", "candidate") == [("x", 99)]


def test_dominant_link_zero_volume_tie_includes_the_unknown(spark):
    df = spark.createDataFrame([(1, "x", 5, 0.0), (1, "x", 99, 4.0)], FLOW)
    assert rows(T.dominant_link(df, "code", ["a"], [99]), "candidate") == [(99,)]


def test_dominant_link_missing_volume_gives_no_candidate(spark):
    df = spark.createDataFrame([(1, "x", 5, None), (1, "x", 7, 2.0), (1, "x", 99, 4.0)], FLOW)
    assert rows(T.dominant_link(df, "code", ["a"], [99]), "candidate") == [(None,)]


def test_null_link_key_is_a_link_of_its_own_in_every_tier(spark):
    df = spark.createDataFrame([(1, None, "p", 99, 1.0), (1, None, "p", 4, 2.0), (1, "x", None, 99, 1.0),
                                (1, "x", None, 6, 2.0)],
                               "year int, a string, b string, code bigint, soy_eq double")
    got = rows(T.dominant_links(df, "code", [["a"], ["b"]], [99]), "tier", "a", "b", "candidate")
    assert got == [(1, "x", None, 6), (1, None, None, 4), (2, None, "p", 4), (2, None, None, 6)]


def test_excluded_code_can_not_win_and_sums_come_before_the_maximum(spark):
    df = spark.createDataFrame([(1, "x", 27, 90.0), (1, "x", 5, 2.0), (1, "x", 5, 2.0),
                                (1, "x", 6, 3.0), (1, "x", 99, 1.0)], FLOW)
    assert rows(T.dominant_link(df, "code", ["a"], [99], [99, 27]), "candidate") == [(5,)]


POOL = "year int, a string, import_port_code bigint, subregion_mo string, soy_eq double"


@pytest.mark.parametrize("data, want", [
    # the pooled region qualifies on its own volume, the rest on the largest of all
    ([(1, "x", 999, "EU", 1.0), (1, "x", 7, "EU", 2.0), (1, "x", 4, "Asia", 9.0)], 7),
    # a pooled unknown with no pooled volume beside it qualifies with zero and stays unknown
    ([(1, "x", 998, "EU", 1.0), (1, "x", 4, "Asia", 9.0)], 998),
    # outside the pool only the largest volume of all qualifies
    ([(1, "x", 999, "Asia", 1.0), (1, "x", 7, "EU", 9.0), (1, "x", 4, "Asia", 3.0)], 7),
])
def test_pooled_dominant_link(spark, data, want):
    df = spark.createDataFrame(data, POOL)
    assert rows(T.dominant_link_by_pool(df, ["a"], []), "candidate") == [(want,)]


def test_cascade_takes_the_first_known_tier_and_the_last_one_unconditionally(spark):
    flows = spark.createDataFrame([(3, "a", "p"), (99, "a", "p"), (99, "b", "p"), (99, "b", "q")],
                                  "code bigint, k1 string, k2 string").withColumn("year", F.lit(1))
    table = spark.createDataFrame(
        [(1, 1, "a", None, 7), (1, 1, "b", None, 99), (2, 1, None, "p", 8), (2, 1, None, "q", 99)],
        "tier int, year int, k1 string, k2 string, candidate bigint")
    out = T.fill_node(flows, "code", table, [["k1"], ["k2"]], lambda c: ~c.isin([99]),
                      "label", ["known", "first", "second"])
    assert rows(out, "code", "label") == [
        (3, "known"), (7, "first"), (8, "second"), (99, "second")]


def test_reattach_fans_out_over_several_attribute_rows(spark):
    df = spark.createDataFrame([(1, "N", 2.0), (1, "M", 3.0), (1, "UNKNOWN", 4.0),
                                (2, "UNKNOWN", 5.0)], "code bigint, name string, v double")
    out = T.reattach(df, "code", ["name"], F.col("name") != "UNKNOWN")
    assert rows(out, "code", "name", "v") == [
        (1, "M", 2.0), (1, "M", 3.0), (1, "M", 4.0), (1, "N", 2.0), (1, "N", 3.0), (1, "N", 4.0),
        (2, None, 5.0)]


def test_land_use_fill_counts_the_first_tier_in_the_second(spark):
    schema = ("municipality_code bigint, year int, exporter_name string, importer_name string, "
              "soy_eq double, land_use double")
    df = spark.createDataFrame([(1, 1, "a", "b", 10.0, 20.0), (1, 1, "a", "b", 30.0, None),
                                (1, 1, "c", "d", 5.0, None), (2, 1, "a", "b", 4.0, None)], schema)
    out = {(r.municipality_code, r.soy_eq): (r.land_use, r.land_use_quality_data)
           for r in T.fill_land_use(df).collect()}
    assert out[1, 30.0] == (30.0 * 20.0 / 20.0, "Origin_node-Year-Company imputed")
    # mean land use of (20, 30) over mean volume of (10, 30, 5), times 5
    assert out[1, 5.0][0] == pytest.approx(5 * 25 / 15)
    assert out[1, 5.0][1] == "Origin_node-Year imputed"
    assert out[2, 4.0] == (None, "Origin_node-Year imputed")


def test_yields_are_overwritten_by_means(spark):
    schema = "state_code bigint, municipality_code bigint, year int, soy_yield double"
    df = spark.createDataFrame([(1, 1, 1, 10.0), (1, 1, 2, 20.0), (1, 2, 1, 0.0), (1, 2, 2, 0.0),
                                (2, 3, 1, None)], schema)
    out = {(r.municipality_code, r.year): (r.soy_yield, r.soy_yield_quality)
           for r in T.complete_yields(df).collect()}
    assert out[1, 1] == (15.0, "consulted")
    assert out[2, 1] == (15.0, "imputed based on state data in the concern year")
    assert out[3, 1] == (None, "imputed based on state data")


def test_tier_fill_means_include_earlier_fills_and_nan_is_missing(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", None), ("b", "x", float("nan")),
                                ("c", "y", None)], "g string, h string, v double")
    out = V.fill_by_tier_means(df, ["v"], [["g"], ["h"]], "q", ["have", "by g", "by h"])
    assert rows(out, "g", "v", "q") == [("a", 1.0, "by g"), ("a", 1.0, "have"), ("b", 1.0, "by h"),
                                        ("c", None, "by h")]


def test_null_keys_match_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, w int")
    assert rows(V.attach(left, right, ["k"]), "v", "w") == [(1, 10), (2, 20)]
    assert rows(V.align(left, right, ["k"]), "k", "v", "w") == [("a", 2, 20), (None, 1, 10)]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    out = df.groupBy("k").agg(strict_sum("v").alias("s"), strict_avg("v").alias("m"))
    assert rows(out, "k", "s", "m") == [("a", None, None), ("b", 2.0, 2.0)]


def test_cell_area_of_the_whole_globe(spark):
    area = spark.range(1).select(S.cell_area_km2(F.lit(0.0), 360.0, 180.0)).first()[0]
    assert area == pytest.approx(4 * math.pi * S.EARTH_RADIUS_KM ** 2)


def test_bounds_fallback_skips_a_usable_unit_mean(spark):
    names = [f"{n}{i}" for n in ["csoc_me", "csoc_min", "csoc_max"] for i in range(4)]
    df = spark.createDataFrame([tuple([1.0, 2.0, None, 4.0] * 3), tuple([None, 2.0, 3.0, 4.0] * 3),
                                tuple([None, None, 3.0, 4.0] * 3)],
                               ", ".join(f"{n} double" for n in names))
    assert rows(S.choose_bounds(df), "csoc_me", "csoc_max") == [(2.0, 2.0), (3.0, 3.0), (4.0, 4.0)]


def test_crop_matches_a_plain_range_join(spark):
    units = spark.createDataFrame([(1, 0, 700, 0, 3), (2, 250, 260, 2, 900)],
                                  "municipality_code bigint, row_min bigint, row_max bigint, "
                                  "col_min bigint, col_max bigint")
    cells = spark.range(0, 4000).select(((F.col("id") * 37) % 800).alias("cell_row"),
                                        ((F.col("id") * 11) % 1000).alias("cell_col"))
    got = rows(S.crop(cells, units, 64), "municipality_code", "cell_row", "cell_col")
    plain = cells.join(units, F.col("cell_row").between(F.col("row_min"), F.col("row_max"))
                       & F.col("cell_col").between(F.col("col_min"), F.col("col_max")))
    assert got == rows(plain, "municipality_code", "cell_row", "cell_col") and got


def test_one_known_half_of_land_makes_the_other_zero(spark):
    schema = "region_name string, state_code bigint, municipality_code bigint, year int, " \
        "double_cropping_share double, soy_yield double, type_land_area string, area_lup double"
    df = spark.createDataFrame([("r", 1, 1, 1, 0.1, 5.0, "Cropland", 3.0),
                                ("r", 1, 2, 1, 0.1, 5.0, None, 3.0)], schema)
    assert rows(B.split_land(df), "municipality_code", "occ", "trans") == [
        (1, 3.0, 0.0), (2, None, None)]


def test_fire_gases_are_floored_and_fire_co2_is_not(spark):
    base = {d: 1.0 for d in E.DRAWS} | {"area_ha": 2.0, "p_area_bm": 1.0, "luclu": "LUC",
                                        "burnt1": 1, "soc_change": 3.0}
    out = E.stock_emissions(spark.createDataFrame([base])).first()
    assert out.CH4e == 0.0 and out.CO2e_bmb == pytest.approx((3 - 10) * 2.0)
    assert out.CO2e_soc == 3000.0


def test_shares_and_products_add_up(spark):
    df = spark.createDataFrame([(10.0, 1.0, 2.0, 3.0, 4.0), (5.0, 0.0, 0.0, 0.0, 0.0)],
                               "soy_eq double, soybeans_a double, meal_from_beans_a double, "
                               "oil_a double, cake_a double")
    first, empty = T.split_products(df).orderBy(F.desc("soy_eq")).collect()
    assert first.sh_bean + first.sh_meal + first.sh_cake + first.sh_oil == pytest.approx(1.0)
    assert first.sh_crusing_to == pytest.approx(1.0 - first.sh_bean)
    assert empty.sh_bean is None


def test_allocation_pairs_add_up(spark):
    df = spark.createDataFrame([(1, 300.0, 700.0, 310.0, 0.0)], "year int, Cakemeal_dom_price double,"
                               "Oil_dom_price double, Cakemeal_for_price double, Oil_for_price double")
    out = T.allocation_factors(df).first()
    assert out.dom_kmeal_af + out.dom_oil_af == pytest.approx(1.0)
    assert (out.for_kmeal_af, out.for_oil_af) == (1.0, 0.0)


def test_tiers_kept_by_scope(spark):
    schema = ("stage string, state_code bigint, region_name string, type_activity_data2 string, "
              "type_activity_data3 string, key_sim string, lca string, recommended_value double, "
              "lower_limit double, upper_limit double, sd double")
    farm = lambda t, k, lca, lo, hi: ("Farming", 1, "R", t, t, k, lca, 4.0, lo, hi, None)
    df = spark.createDataFrame([
        farm("fertiliser", "Urea", "s1", 2.0, 8.0), farm("fertiliser", "Urea", "s2", 2.0, 8.0),
        farm("pesticide", "G", "s1", None, None), farm("pesticide", "G", "s2", None, None),
        farm("sowing", "Seed", "s1", None, None), farm("machinery", "Diesel", "s1", 2.0, 8.0)], schema)
    state = L.assemble(L.prepare(df, L.STATE), L.STATE, 50)
    region = L.assemble(L.prepare(df, L.REGION), L.REGION, 50)
    assert rows(state.groupBy("titem").count(), "titem", "count") == [(1, 50), (2, 50), (3, 50), (4, 50)]
    assert rows(region.groupBy("titem").count(), "titem", "count") == [(2, 50), (4, 50)]
    assert state.where("titem = 1 AND recommended_value <> 4.0").count() == 0
    assert state.where("titem >= 3 AND (recommended_value < 2 OR recommended_value > 8)").count() == 0
    assert state.where("titem = 3").select("recommended_value").distinct().count() > 40


def test_footprint_total_is_the_sum_of_its_stages(spark):
    from verification.views import load
    master = I.align_units(load(spark, "/root/testdata/sf0.001", "master"))
    out = I.product_footprint(master, I.OIL)
    wrong = out.where(F.abs(F.col("impact") - sum(F.col(c) for c in I.OIL.stages)) > 1e-6)
    assert wrong.count() == 0 and out.where("oil = 0").count() == 0
