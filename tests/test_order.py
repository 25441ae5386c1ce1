from pyspark.sql import functions as F

from termweave.sources import order


def test_numbers_over_blocks_of_several_files(spark, tmp_path):
    lines = [f"{i},{'x' * (i % 50)}" for i in range(3000)]
    (tmp_path / "t").mkdir()
    for n, (low, high) in enumerate(((0, 1700), (1700, 1700), (1700, 1701), (1701, 3000))):
        (tmp_path / "t" / f"part-{n:05d}.csv").write_text("id,pad\n" + "".join(x + "\n" for x in lines[low:high]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        scan = spark.read.option("header", True).csv(str(tmp_path / "t"))
        assert scan.rdd.getNumPartitions() > 6
        rows = order.numbered(scan, start=10).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 3000 and all(r.row_index == int(r.id) + 10 for r in rows)


def test_parquet_empty_and_clashing_names(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(500).selectExpr("id", "id as file", "id as place", "1 as row_index").repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(path)
    rows = order.numbered(spark.read.parquet(path))
    assert rows.columns == ["id", "file", "place", "row_index"] and all(r.id == r.row_index == r.file for r in rows.collect())
    assert order.numbered(spark.read.parquet(path).where("id < 0")).collect() == []
    kept = order.numbered(spark.read.parquet(path).where("id % 3 = 0"))
    assert all(r.id == 3 * r.row_index for r in kept.collect())  # places among the rows that the scan gives


def test_indexes_first_rows_and_groups(spark, tmp_path):
    path = str(tmp_path / "q")
    spark.createDataFrame([("b ", "7", None), ("a", "x", "n1"), (" b", None, None)], "e string, t string, note string").coalesce(1).write.parquet(path)
    rows = order.numbered(spark.read.parquet(path))
    got = order.with_indexes(rows, test_index=F.col("t"), row_id=F.col("note")).orderBy("row_index").collect()
    assert [(r.test_index, r.row_id) for r in got] == [(7, "0"), (2, "n1"), (3, "2")]
    lists = {r.entity: r.records for r in order.by_entity(rows, "e", F.col("t")).collect()}
    assert lists == {"b": ["7", None], "a": ["x"]}
    assert {r.e for r in order.first_in_file(rows, ["e"]).collect()} == {"b ", "a", " b"}
