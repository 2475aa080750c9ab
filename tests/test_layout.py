"""Steps that start from the stored table don't shuffle points."""

from modetrace.operators import segment, trips
from modetrace.operators.features import features
from modetrace.plans.catalog import Tables
from modetrace.sources import layout

SF = "/root/testdata/sf0.001"


def test_no_exchange_and_the_same_rows(spark, tmp_path):
    t = Tables(spark, SF)
    name = layout.store(t.points, t.displacements, "cleaned_points", str(tmp_path / "cleaned"), buckets=4)
    found = features(segment.segments(trips.trips_of(layout.stored(spark, name)), "v1"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1 and "Bucketed: true" in plan
    want = t.features()
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect())) != []
    assert len([f for f in (tmp_path / "cleaned").iterdir() if f.suffix == ".parquet"]) <= 4
    assert layout.store(t.points.where("user_id < 3"), t.displacements, "cleaned_points", str(tmp_path / "again"), buckets=4) == name
    assert layout.stored(spark, name).where("user_id >= 3").count() == 0
    spark.sql("DROP TABLE cleaned_points")
