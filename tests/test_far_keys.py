"""Orders whose numbers are so large that point_id does not fit a bigint."""

import os

from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from pointloom.plans.fixtures import Tables
from pointloom.plans.q_sampling import numbered_points
from tests.oracles import compare, connect

FAR = 53_850_000


def test_far_orders(spark, sf, tmp_path):
    for t in os.listdir(sf):
        if t != "lineitem.parquet":
            os.symlink(f"{sf}/{t}", tmp_path / t)
    spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") + FAR).write.parquet(str(tmp_path / "lineitem"))
    os.symlink(next((tmp_path / "lineitem").glob("part-*.parquet")), tmp_path / "lineitem.parquet")
    far = Tables(spark, str(tmp_path))
    near = {r.point_id for r in Tables(spark, sf).points.select("point_id").collect()}
    assert {int(r.point_id) - FAR * 10**12 for r in numbered_points(far).select("point_id").collect()} == near
    assert far.lineitem.count() == Tables(spark, sf).lineitem.count()
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), "g18_sphere_cover", queries(), oracle_sql()) == ""
