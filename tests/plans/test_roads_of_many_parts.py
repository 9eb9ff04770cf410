import duckdb

from panelloom.plans import queries


def test_part_keys_as_large_as_moved_supplier_keys(spark, tmp_path):
    keys = [(1_000_001, 1), (1_000_002, 1), (1_000_001, 2), (1_000_003, 2), (7, 5)]
    spark.createDataFrame(keys, "l_partkey long, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL["road_scan"]).fetchall()
    got = queries.QUERIES["road_scan"](spark, str(tmp_path)).select("a", "b", "distance").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 2
