"""Runs of chosen units and years, their options, and the lifetime of stage tables."""

import dataclasses
import os

import pytest

from furrow.operators import inventory as L
from furrow.plans import footprints as P
from furrow.sources.schemas import SCHEMAS
from furrow.sources.stages import lifetime, stage, stage_root, working_tables
from verification import grid_checks as S
from verification.views import load

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    found = {name: load(spark, SF_DIR, name) for name in SCHEMAS}
    return found | {name: stage(found[name], name) for name in ("flow", "pixel", "inventory")}


def _written(spark):
    root = stage_root(spark).removeprefix("file://").removeprefix("file:") + "/furrow"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_tables_of_a_lifetime_go(spark):
    frame = spark.range(3)
    outside = stage(frame, "outside")
    before = _written(spark)
    with lifetime():
        inside = stage(frame, "inside")
        assert inside.count() == 3 and len(_written(spark) - before) == 1
        with lifetime():
            stage(frame, "inner")
            assert len(_written(spark) - before) == 2
        assert len(_written(spark) - before) == 1
        with working_tables() as own:
            own(frame, "own")
            kept = own.kept(frame, "kept")
        assert kept.count() == 3 and len(_written(spark) - before) == 2
    assert _written(spark) == before and outside.count() == 3


def test_tables_of_a_broken_run_go(spark):
    before = _written(spark)
    with pytest.raises(Exception, match="broken here"):
        with lifetime():
            stage(spark.range(3), "whole")
            stage(spark.range(3).selectExpr("raise_error('broken here') AS x"), "broken")
    assert _written(spark) == before
    stage(spark.range(1), "free")
    assert len(_written(spark) - before) == 1


def _rows(products, where="true"):
    found = {}
    for name, table in products.items():
        columns = sorted(table.columns)
        rows = table.where(where).select(*columns).collect()
        found[name] = sorted((tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows))
    return found


def test_chosen_units_and_years_equal_the_whole_run(spark, tables, tmp_path):
    unit = load(spark, SF_DIR, "unit")
    whole = P.run(tables, unit, S.WIDTH, S.HEIGHT, 1)
    beans = stage(whole["beans"], "beans")
    some = [r.municipality_code for r in beans.select("municipality_code").distinct()
            .orderBy("municipality_code").collect()][::3]
    years = [beans.agg({"year": "max"}).first()[0]]
    chosen = f"municipality_code IN ({', '.join(map(str, some))}) AND year IN ({years[0]})"
    want = _rows({"beans": beans, "oil": whole["oil"]}, chosen)
    assert want["beans"] and beans.count() > len(want["beans"])

    before = _written(spark)
    P.run_to(str(tmp_path), tables, unit, S.WIDTH, S.HEIGHT, n=1, of_units=some, years=years)
    assert _written(spark) == before
    got = {name: spark.read.schema(whole[name].schema).parquet(f"{tmp_path}/{name}") for name in want}
    assert _rows(got) == want


def test_sulphur_dioxide_and_evidence_tiers(spark, tables):
    background = stage(load(spark, SF_DIR, "process").limit(0), "no_background")
    rows = {}
    narrow = dataclasses.replace(L.STATE, kept=(1, 2))
    for scope in (L.STATE, narrow):
        found = L.assemble(L.prepare(tables["inventory"], scope), scope, 2)
        rows[scope.kept] = {r.titem for r in found.select("titem").distinct().collect()}
    assert rows[(1, 2)] == rows[(1, 2, 3, 4)] & {1, 2} and rows[(1, 2)]
    assert background.count() == 0 and P.Scopes(state=narrow).region == L.REGION

    inventory = L.split_activity(L.assemble(L.prepare(tables["inventory"], L.STATE), L.STATE, 2), L.STATE)
    emitted = L.field_emissions(L.attach_factors(L.field_rows(inventory), tables["factors"],
                                                 tables["content"], 2))
    without, whole = (L.field_totals(emitted, L.STATE, so2) for so2 in (False, True))
    names = {r.substance_ac for r in whole.select("substance_ac").distinct().collect()}
    assert "SO2" in names
    assert {r.substance_ac for r in without.select("substance_ac").distinct().collect()} == names - {"SO2"}
