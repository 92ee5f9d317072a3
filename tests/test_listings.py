"""The folders of a restoration are listed one at a time, and their listings kept out of the session's cache."""

from pyspark.sql import functions as F

from flowtab.plans import evaluate, scoring
from flowtab.sources import files, images, sinks


def test_one_folder_at_a_time(spark, tmp_path, monkeypatch):
    key, root = "spark.sql.hive.manageFilesourcePartitions", str(tmp_path)
    rows = spark.range(6).selectExpr("id", "array_repeat(int(id), 12) AS pixels", "2 AS h", "2 AS w", "3 AS c")
    for role in ("rainy", "clean"):
        files.save_files(sinks.export_images(rows.withColumn("file_name", F.concat(F.lit(f"val/{role}/"), F.col("id").cast("string"), F.lit(".png")))), root)
    got = [images.role_listing(spark, root, "val", role) for role in ("condition", "target")]
    layout = images.resolve_layout(images.scan_images(spark, root), check=False).where("split = 'val'").collect()
    assert {r.role: f"{root}/{r.prefix}" for r in layout} == dict(zip(("condition", "target"), (g[0] for g in got), strict=True))
    assert [sorted(r.rel for r in g[1].collect()) for g in got] == [[f"{i}.png" for i in range(6)]] * 2
    assert images.role_listing(spark, root, "train", "target") is None
    listed, before, scan = [], spark.conf.get(key), images.single_files
    monkeypatch.setattr(images, "single_files", lambda spark, kind, folder, **how: listed.append(folder) or scan(spark, kind, folder, **how))
    made, _ = evaluate.restore_folder(spark, root, 2, scoring.predictor("condition"), 10, steps=1)
    assert made.count() == 6 and spark.conf.get(key) == before
    assert root not in listed and {f: listed.count(f) for f in listed if f.endswith(("val/rainy", "val/clean"))} == {f"{root}/val/rainy": 2, f"{root}/val/clean": 2}
