"""Farthest points where many points stand in one place."""

from pointloom.operators import sampling


def test_a_place_is_one_row(spark, monkeypatch):
    seen, keep = [], sampling.saved
    monkeypatch.setattr(sampling, "saved", lambda df, name: seen.append((name, keep(df, name))) or seen[-1][1])
    rows = [(0, 100 - i, float(i % 3), 0.0, 0.0) for i in range(90)]
    got = sampling.farthest_sample(spark.createDataFrame(rows, "scene_id int, point_id long, x double, y double, z double"), 5).orderBy("step").collect()
    assert [r.point_id for r in got] == [11, 13, 12, 11, 11]  # x is 2, 0, 1; then the smallest id again
    assert dict(seen[:1])["distances"].count() == 3
