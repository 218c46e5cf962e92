from kinetrace import fixtures
from kinetrace.sources import bags, udtf, wire


def test_table_functions(spark):
    x = fixtures.joint_trajectory(64, 2, 1)
    udtf.register(spark)
    rows = [(0, wire.encode(x)), (1, b"junk"), (2, None)]
    spark.createDataFrame(rows, "id int, content binary").createOrReplaceTempView("packets")
    got = spark.sql("SELECT id, count(x) AS n, count(error) AS bad FROM packets, LATERAL packet_frames(content) GROUP BY id").collect()
    assert sorted(tuple(r) for r in got) == [(0, 128, 0), (1, 0, 1)]
    spark.createDataFrame([(bags.write_bridge(fixtures.bag_records(x, 3, 2, 32)),), (b"x",)], "content binary").createOrReplaceTempView("bag_files")
    got = spark.sql("SELECT count(index) AS n, count(error) AS bad FROM bag_files, LATERAL bag_records(content)").first()
    assert tuple(got) == (2, 1)
