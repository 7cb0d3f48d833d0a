"""Plans and skew: what must hold when the tables grow by orders of magnitude."""

import contextlib
import gc
import io
import re
import time
from uuid import uuid4

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow import constants as K
from furrow.functions import quantiles
from furrow.functions.quantiles import group_quantiles
from furrow.operators import carbon as E
from furrow.operators import flows as T
from furrow.operators import grid as S
from furrow.operators import impact as I
from furrow.operators import logistics as D
from furrow.operators.relational import attach, keep_matches, nest_samples, spread, unnest_samples
from furrow.sources import tables
from furrow.sources.stages import stage, stage_parts, stage_root, tune
from verification import impact_checks as C
from verification import views
from verification.grid_checks import bucketed
from verification.views import load

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("make", [T.fill_origins, T.fill_export_ports, T.fill_import_ports,
                                  T.fill_land_use, T.reattach_origins])
def test_flow_operators_use_no_window_and_no_nested_loop(spark, make):
    text = plan(make(load(spark, SF_DIR, "flow")))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert not re.search(r"\bWindow\b", text)


def test_candidates_read_only_their_columns(spark):
    path = stage_root(spark) + "/furrow/scan-test"
    load(spark, SF_DIR, "flow").write.mode("overwrite").parquet(path)
    text = plan(T.dominant_link(spark.read.parquet(path), "municipality_code",
                                ["import_country_name"], [9999999]))
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "year", "municipality_code", "import_country_name", "soy_eq"}


def test_alignment_of_five_layers_is_one_shuffle_without_joins(spark):
    text = plan(S.crop_cells(S.align_layers(load(spark, SF_DIR, "pixel"), 0.25, 0.0005)))
    body = text[:text.index("(1)")]
    joins = body.count("Join")
    base = plan(load(spark, SF_DIR, "pixel"))
    assert joins == base[:base.index("(1)")].count("Join")


def test_bucketed_pixels_align_without_any_shuffle(spark):
    text = plan(S.crop_cells(S.align_layers(bucketed(spark, SF_DIR), 0.25, 0.0005)))
    assert "Exchange" not in text


def test_samples_are_never_shuffled_on_the_way_to_emissions(spark):
    rows = C._weighed(spark, SF_DIR)
    out = E.emissions_per_hectare(E.roll_up_classes(E.roll_up_zones(
        E.stock_emissions(E.draw_stocks(rows, 5)))))
    text = plan(out)
    body = text[:text.index("\n(1)")]
    assert body.count("Exchange") == 1 and body.index("Generate") < body.index("Exchange")


def test_tiers_of_a_node_read_the_flows_once(spark):
    flows = stage(load(spark, SF_DIR, "flow"), "scan_test")
    text = plan(T.dominant_links(flows, "municipality_code", T.ORIGIN_TIERS, [9999999]))
    assert text[:text.index("\n(1)")].count("Scan parquet") == 1


def test_nested_samples_keep_their_place(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("b", 2, None), ("b", 1, 5.0),
                                ("b", 3, 6.0)], "k string, Id_sample int, v double")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    wide = attach(keys, nest_samples(df, ["k"], ["v"], 3, "held"), ["k"])
    got = {(r.k, r.Id_sample): r.v for r in unnest_samples(wide, {"held": ["v"]}, 3).collect()}
    assert got == {("a", 1): 1.0, ("a", 2): None, ("a", 3): 3.0, ("b", 1): 5.0, ("b", 2): None,
                   ("b", 3): 6.0, ("c", 1): None, ("c", 2): None, ("c", 3): None}


def test_nested_samples_return_what_left_joins_return(spark):
    """Repeated, lacking and complete samples of two tables, against left joins by key and sample."""
    one = spark.createDataFrame([("a", 1, 50.0, "x"), ("a", 1, 5.0, None), ("a", 1, 5.0, None), ("b", 2, 2.0, "y"),
                                 ("b", 1, None, None), ("b", 3, 3.0, "z"), ("c", 3, 9.0, "c")],
                                "k string, Id_sample int, v double, t string")
    two = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 3, 3), ("d", 2, 4), ("d", 2, 4)],
                                "k string, Id_sample int, w int")
    keys = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1), ("d", 1), ("e", 1), (None, 1)], "k string, id int")
    wide = attach(keys, nest_samples(one, ["k"], ["v", "t"], 3, "first"), ["k"])
    wide = attach(wide, nest_samples(two, ["k"], ["w"], 3, "second"), ["k"])
    got = unnest_samples(wide, {"first": ["v", "t"], "second": ["w"]}, 3)
    plain = keys.crossJoin(spark.range(1, 4).select(F.col("id").cast("int").alias("Id_sample")))
    want = plain.join(one, ["k", "Id_sample"], "left").join(two, ["k", "Id_sample"], "left")
    order = ["k", "id", "Id_sample", "v", "t", "w"]
    rows = lambda df: sorted(map(str, df.select(order).collect()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("bad", [0, 4, None])
def test_samples_outside_the_run_are_an_error(spark, bad):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", bad, 2.0)], "k string, Id_sample int, v double")
    with pytest.raises(Exception, match="sample outside 1..3"):
        nest_samples(df, ["k"], ["v"], 3, "held").collect()


def test_emissions_are_filled_before_rows_multiply(spark):
    text = plan(C._filled(spark, SF_DIR))
    body = text[:text.index("\n(1)")]
    above = body[:body.index("Generate")]
    assert "Join" not in above and "Exchange" not in above


def test_pixels_are_pruned_before_their_exchange(spark):
    """Class, years and extents stand below the first exchange of pixels, the bounds on the scan."""
    pixels = stage(load(spark, SF_DIR, "pixel"), "pixel_test")
    units = load(spark, SF_DIR, "unit")
    cells = S.planted_cells(pixels, 0.25, 0.0005, units, years=[1998])
    text = plan(cells)
    body = text[:text.index("\n(1)")]
    assert body.index("Exchange") < body.index("LeftSemi")
    assert body.count("LeftSemi") == 2 or body.count("Join") == 2
    scans = [line for line in text.splitlines() if "PushedFilters" in line]
    assert any("In(year, [1995,1998])" in x and "GreaterThanOrEqual(cell_row" in x and "LessThanOrEqual(cell_col" in x
               for x in scans)
    whole = S.crop_cells(S.align_layers(pixels, 0.25, 0.0005, years=[1998]))
    near = stage(S.unit_tiles(units).select("tile_row", "tile_col").distinct(), "tiles_test")
    whole = whole.withColumns({"tile_row": F.floor(F.col("cell_row") / S.TILE), "tile_col": F.floor(F.col("cell_col") / S.TILE)}) \
        .join(near, ["tile_row", "tile_col"], "left_semi").select(cells.columns)
    assert sorted(map(str, cells.collect())) == sorted(map(str, whole.collect())) and cells.count()


def test_no_units_plant_nothing(spark):
    none = load(spark, SF_DIR, "unit").limit(0)
    assert S.planted_cells(load(spark, SF_DIR, "pixel"), 0.25, 0.0005, none).count() == 0


def test_crop_is_an_equality_join(spark):
    text = plan(S.crop(load(spark, SF_DIR, "cell"), load(spark, SF_DIR, "unit")))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_hot_key_is_split_by_adaptive_execution(spark):
    """A lookup too big to broadcast: the partition of a key with most rows is split."""
    tune(spark)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB"}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        facts = spark.range(0, 400000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(7)).alias("k"),
            F.md5(F.col("id").cast("string")).alias("payload"))
        lookup = stage(facts.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "skew_test")
        joined = attach(facts, lookup, ["k"])
        assert joined.count() == 400000
        joined.collect()
        assert "skewed=true" in joined._jdf.queryExecution().executedPlan().toString().lower() \
            or "SortMergeJoin(skew=true)" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_match_brute_force_under_skew(spark, keys):
    rng = np.random.default_rng(5)
    values = [("hot", float(v)) for v in np.round(rng.lognormal(0, 3, 4000), 3)] \
        + [("hot", 5.0)] * 3000 + [("b", 1.0), ("b", 2.0)] + [("c", None), ("c", -4.0)]
    df = spark.createDataFrame(values, "g string, v double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {(r["g"] if keys else None): [r[n] for n in wanted]
           for r in group_quantiles(df, keys, "v", wanted).collect()}
    for group in {g for g, _ in values} if keys else [None]:
        data = [v for g, v in values if v is not None and (group is None or g == group)]
        assert got[group] == pytest.approx(list(np.quantile(data, list(wanted.values()))))


def _most_ranked(monkeypatch):
    """Largest number of values that are put in order for one range, by counting what `_ordered` gets."""
    seen = []
    ordered = quantiles._ordered

    def counted(counts, targets, group):
        ranges = targets.select(*group, "__low", "__high").distinct()
        rows = quantiles._within(counts, ranges, group).groupBy(*group, "__low", "__high").count()
        seen.extend(r["count"] for r in rows.collect())
        return ordered(counts, targets, group)

    monkeypatch.setattr(quantiles, "_ordered", counted)
    return seen


def test_one_outlier_does_not_put_all_values_in_one_window(spark, monkeypatch):
    seen = _most_ranked(monkeypatch)
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(0, 1, 200_000), [1e12, -1e300, 1e300]])
    df = spark.createDataFrame([(float(x),) for x in data], "v double")
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}
    got = group_quantiles(df, [], "v", wanted).first()
    assert [got[n] for n in wanted] == pytest.approx(list(np.quantile(data, list(wanted.values()))))
    assert max(seen) <= quantiles.RANKED


@pytest.mark.parametrize("ranked", [1, 3, 100])
def test_narrow_and_odd_ranges(spark, ranked):
    """Values a double can hardly tell apart, subnormal ones, ties and single values, at every bucket limit."""
    groups = {"close": [np.nextafter(1.0, 2.0), 1.0, np.nextafter(np.nextafter(1.0, 2.0), 2.0), 1.0],
              "tiny": [5e-324, 1e-323, 1.5e-323, 0.0], "ties": [2.0] * 5 + [3.0], "one": [7.0],
              "wide": [float(10.0 ** k) for k in range(-300, 300, 7)]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    wanted = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}
    got = {r.g: [r[n] for n in wanted] for r in group_quantiles(df, ["g"], "v", wanted, ranked=ranked).collect()}
    for g, vs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, list(wanted.values()))), rel=1e-12, abs=1e-322)


def test_stage_root_comes_from_the_session(spark):
    old = spark.conf.get("spark.checkpoint.dir", None)
    assert stage_root(spark)
    if old:
        assert stage_root(spark) == old.rstrip("/")


def test_multiplied_master_rows_are_neither_joined_nor_shuffled(spark):
    text = plan(C.checks()["I14_stage_attachment"][0](spark, SF_DIR))
    body = text[:text.index("\n(1)")]
    above = body[:body.index("Generate")]
    assert "Join" not in above and "Exchange" not in above


def test_tables_are_broadcast_by_what_they_take_in_memory(spark):
    tune(spark)
    rows = spark.range(600_000).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"))
    lookup = stage(rows, "compact-lookup")  # a file of about 3 MB, over 19 MB of rows
    few = stage(rows.where("id < 1000"), "small-lookup")
    assert "BroadcastHashJoin" not in plan(attach(rows.select("id"), lookup, ["id"]))
    assert "BroadcastHashJoin" in plan(attach(rows.select("id"), few, ["id"]))


def test_key_columns_are_broadcast_by_what_they_take_in_memory(spark):
    """The planner holds a key for a tenth of this file, by its type; it is nearly all of it."""
    tune(spark)
    constants = [F.lit("x").alias(f"c{i}") for i in range(5)]
    keys = stage(spark.range(600_000).select("id", *constants), "wide-lookup").select("id")
    assert "BroadcastHashJoin" not in plan(keep_matches(spark.range(600_000), keys, ["id"]))


def test_a_session_with_a_lower_broadcast_limit_keeps_it(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        for set_to, left in [("256k", "256k"), ("-1", "-1"), ("1g", "10MB"), ("20971520b", "10MB"), ("3000", "3000")]:
            spark.conf.set(key, set_to)
            tune(spark)
            assert spark.conf.get(key) == left
    finally:
        spark.conf.set(key, before)


def test_buckets_of_pixels_grow_in_number(spark, monkeypatch):
    def buckets(table):
        path = f"{stage_root(spark)}/furrow/{table}"
        pixels = spark.range(1000).selectExpr("'cover' AS layer", "id AS cell_row", "id % 7 AS cell_col")
        saved = tables.save_pixels(pixels, table, path, 8)
        assert saved.count() == 1000
        text = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
        spark.sql(f"DROP TABLE {table}")
        return int(text["Num Buckets"])

    assert buckets(f"pixels_{uuid4().hex}") == 8
    monkeypatch.setattr(tables, "ROWS_PER_BUCKET", 50)
    assert buckets(f"pixels_{uuid4().hex}") == 20


def test_cells_are_found_once_for_all_layers(spark):
    assert "Exchange" not in plan(load(spark, SF_DIR, "pixel"))


def test_tasks_read_little_and_partitions_are_many(spark):
    tune(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16MB"
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) == 200


def test_tasks_multiply_few_rows_however_many_there_are(spark):
    for rows in (1000, 3000):
        text = plan(spread(spark.range(rows), ["id"], 40_000))
        parts = int(re.search(r"hashpartitioning\(id#\d+L?, (\d+)\)", text)[1])
        assert rows * 40_000 / parts <= 500_000


def _shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return {b for b in (str(blocks.apply(i)) for i in range(blocks.size())) if b.startswith("shuffle_")}


def test_shuffle_files_of_a_stage_table_are_deleted(spark):
    gc.collect()
    before = _shuffle_files(spark)
    held = stage(spark.range(10_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "dropped")
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert held.count() == 7


@pytest.mark.parametrize("name", views.BY_LINE)
def test_views_held_in_parts_have_the_rows_of_the_view(spark, monkeypatch, name):
    monkeypatch.setattr(views, "LINES", 2000)
    parts = []
    monkeypatch.setattr(views, "stage_parts", lambda frames, tag: stage_parts(
        (parts.append(1) or f for f in frames), tag))
    held, whole = views.hold(spark, SF_DIR, name), load(spark, SF_DIR, name)
    assert len(parts) > 1 and held.count() == whole.count()
    assert held.exceptAll(whole).count() == 0 and whole.exceptAll(held).count() == 0


def test_rows_with_a_known_node_are_not_joined(spark):
    flows = spark.createDataFrame([(2000, "a", 1), (2000, "a", 99), (2000, "b", 99), (2000, None, 99), (2000, "a", None)],
                                  "year int, k string, code int")
    table = spark.createDataFrame([(1, 2000, "a", 7), (1, 2000, None, 8)], "tier int, year int, k string, candidate int")
    asked = []
    attached = T.attach_candidates
    T.attach_candidates = lambda f, *a: asked.append(f.count()) or attached(f, *a)
    try:
        out = T.fill_node(flows, "code", table, [["k"]], lambda c: c != 99, "how", ["known", "filled"])
    finally:
        T.attach_candidates = attached
    assert asked == [3]
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame(
        [(2000, "a", 1, "known"), (2000, "a", 7, "filled"), (2000, "b", None, "filled"), (2000, None, 8, "filled"),
         (2000, "a", None, None)], "year int, k string, code int, how string").collect()))


def test_links_are_one_row_until_they_multiply(spark):
    """Categories with nulls, a null unit, repeated and lacking samples, against left joins of all rows."""
    cats = [("m", "d1", "c1", "u"), ("m", None, "c2", "u"), ("m", "d3", "c3", None)]
    catalogue = spark.createDataFrame(cats, "method string, damage string, impact_category string, unit_impact string")
    links = spark.createDataFrame([(1, 2000), (2, 2000), (None, 2001)], "municipality_code int, year int")
    carbon = spark.createDataFrame([(1, 1, 2000, "d1", "c1", "u", 1.0, 2.0), (1, 1, 2000, "d1", "c1", "u", 3.0, 4.0),
                                    (2, 1, 2000, None, "c2", "u", 5.0, None), (2, None, 2001, "d3", "c3", None, 7.0, 8.0),
                                    (1, 2, 1999, "d1", "c1", "u", 9.0, 9.0)],
                                   "Id_sample int, municipality_code int, year int, damage string, impact_category string, "
                                   "unit_impact string, i_luclu_above_biomass double, i_luclu_soc double")
    wide = I.category_matrix(links, catalogue)
    assert wide.count() == 3
    got = I.master_matrix(I.attach_carbon(wide, carbon, 2), 2)
    plain = links.crossJoin(catalogue).crossJoin(spark.range(1, 3).select(F.col("id").cast("int").alias("Id_sample")))
    want = attach(plain, carbon, ["Id_sample", *I.CARBON_KEYS])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(map(str, got.select(order).collect())) == sorted(map(str, want.select(order).collect()))
    assert I.master_matrix(I.category_matrix(links, catalogue.limit(0)), 2).count() == 0


def test_distances_of_repeated_and_missing_routes_add_up(spark):
    link = {k: "x" for k in D.LINK_KEYS}
    rows = [{**link, "year": y, "domestic_distance": d, "international_distance": i}
            for y, d, i in [("1", 2.0, 3.0), ("1", 4.0, None), ("2", None, None), ("3", 1.0, 1.0)]]
    types = ", ".join([*[f"{k} string" for k in D.LINK_KEYS], "domestic_distance double", "international_distance double"])
    background = spark.createDataFrame(
        [("m", "c1", "u", "d", K.LORRY, 10.0), ("m", "c1", "u", "d", K.SHIP, 100.0), ("m", "c2", "u", None, K.LORRY, None),
         ("m", "c3", "u", "d", "Other", 1.0)], ", ".join([*[f"{k} string" for k in D.CATEGORY], "key_sim string", "impact double"]))
    links = spark.createDataFrame([tuple(r.values()) for r in rows], types)
    out = D.distance_impacts(links, background)
    text = plan(out)
    got = {(r.year, r.impact_category): (r.i_domestic_transport, r.i_international_transport) for r in out.collect()}
    assert got == {("1", "c1"): (60.0, 300.0), ("2", "c1"): (0.0, 0.0), ("3", "c1"): (10.0, 100.0),
                   ("1", "c2"): (0.0, 0.0), ("2", "c2"): (0.0, 0.0), ("3", "c2"): (0.0, 0.0)}
    body = text[:text.index("\n(1)")]
    assert body.count("- Exchange") == 1 and body.index("Join") < body.index("- Exchange")


def test_pixels_are_shuffled_once_each_by_cell(spark):
    pixels = spark.range(100).selectExpr("CASE id % 3 WHEN 0 THEN 'cover' WHEN 1 THEN 'soc' ELSE 'burn' END AS layer", "CAST(1995 AS INT) AS year", "id AS cell_row", "id % 7 AS cell_col",
                                         "CAST(id AS DOUBLE) AS y", "CAST(id AS DOUBLE) AS value")
    for text in (plan(S.align_layers(pixels, 0.25, 0.0005)), plan(S.planted_cells(pixels, 0.25, 0.0005))):
        exchanges = re.findall(r"hashpartitioning\((.*?), \d+\)", text)
        assert any(re.fullmatch(r"cell_row#\d+L?, cell_col#\d+L?", x) for x in exchanges)
        assert not any("cell_row" in x and "target" in x for x in exchanges)
    body = plan(S.align_layers(pixels, 0.25, 0.0005))
    assert body.index("Generate") < body.index("Exchange")
