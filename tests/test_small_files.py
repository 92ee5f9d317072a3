"""Scans of many small files have few tasks, and give every file."""

from flowtab.sources import files, images, sinks

N = 150


def test_many_files_to_a_task(spark, tmp_path):
    rows = spark.range(N).selectExpr("concat(id % 3, '/', id, '.png') AS file_name", "array_repeat(int(id), 12) AS pixels", "2 AS h", "2 AS w", "3 AS c")
    files.save_files(sinks.export_images(rows), str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # one file, by its cost of opening
    try:
        scans = [images.scan_images(spark, str(tmp_path)), images.read_images(spark, str(tmp_path)), files.saved_files(spark, str(tmp_path))]
        assert [s.rdd.getNumPartitions() for s in scans] == [16] * 3
        want = sorted(f"{i % 3}/{i}.png" for i in range(N))
        assert sorted(r.rel for r in scans[0].collect()) == want == sorted(r.file_name for r in scans[2].select("file_name").collect())
        assert sorted(r.pixels[0] for r in scans[1].collect()) == list(range(N))
        assert images.count_undecodable(spark, str(tmp_path)) == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
