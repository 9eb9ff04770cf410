import pytest
from pyspark.sql import functions as F

from panelloom.sources import preparation

REGISTRY = "territory_id string, year_from int, year_to int, municipal_district_name string, region_name string, region_code string, oktmo string, municipal_district_center_lat double, municipal_district_center_lon double"


def tables(spark):
    rows = [(t, f"{y}-{m:02d}", c, 1.0 + t + m) for t in (1, 2, 3) for y, m in ((2023, 12), (2024, 1)) for c in ("food", "all") if (t, m) != (3, 1)]
    registry = [(str(t), a, b, n + str(t), "R", "20" if t == 2 else "5", "o", 1.0, None) for t in (1, 2, 3) for a, b, n in ((2018, 2024, "old"), (2024, 9999, "new"))]
    return spark.createDataFrame(rows, "territory_id long, date string, category string, value double"), spark.createDataFrame(registry, REGISTRY)


def test_panel(spark):
    rows, registry = tables(spark)
    export = preparation.canonical_rows(rows, ["food"], "all").select("period", "category", "value")
    out = preparation.prepare(rows, registry, ["food"], "all", export)
    got = out["panel"].orderBy("territory_id", "period").collect()
    assert [(r.entity_id, r.period, r.municipal_district_name, r.mo, r.food) for r in got][:2] == [("tid_1", "2023-12-01", "old1", "new1", 14.0), ("tid_1", "2024-01-01", "new1", "new1", 3.0)]
    assert {r.boundary_review_flag for r in got if r.territory_id == 2} == {preparation.CAVEATS[20]} and len(got) == 4
    assert [tuple(r) for r in out["excluded"].collect()] == [(3, 1, preparation.REASON)]
    assert out["canonical_long"].count() == rows.count()


def test_faults(spark):
    rows, registry = tables(spark)
    more = lambda *r: rows.unionByName(spark.createDataFrame([r], rows.schema))
    faults = [more(1, "2023-12", "food", 1.0), more(1, "2023-12", "odd", 1.0), more(4, "2023-12", "food", 0.0), more(4, "2024-03", "food", 1.0), rows.where("category = 'all'")]
    for bad in faults:
        with pytest.raises(Exception):  # noqa: B017
            preparation.prepare(bad, registry, ["food"], "all")["panel"].collect()
    with pytest.raises(ValueError, match="overlapping"):
        preparation.prepare(rows, registry.unionByName(registry.withColumn("year_to", F.lit(9999))), ["food"], "all")
    with pytest.raises(ValueError, match="without_interval"):
        preparation.prepare(rows, registry.where("territory_id <> '1'"), ["food"], "all")
    with pytest.raises(ValueError, match="differing"):
        preparation.prepare(rows, registry, ["food"], "all", preparation.canonical_rows(rows, ["food"], "all").limit(3))
