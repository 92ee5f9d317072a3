"""Single files written with commit, and folders restored from files to files."""

import json
import math
import os
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtab.operators.images import middle, resample, upscaled_size
from flowtab.plans import evaluate, scoring
from flowtab.sources import files, sinks


def rows(spark, n, parts=4):
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("a/"), (F.col("id") % 3).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit(".bin")).alias("file_name"), F.encode(F.repeat(F.lit("x"), F.col("id").cast("int")), "UTF-8").alias("content"))


def found(root):
    return {os.path.relpath(os.path.join(d, f), root): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc") and "/_staged-" not in f"{d}/"}


def test_files_and_their_mark(spark, tmp_path):
    out = str(tmp_path / "out")
    files.save_files(rows(spark, 20), out)
    want = {f"a/{i % 3}/{i}.bin": i for i in range(20)}
    assert {k: v for k, v in found(out).items() if k != files.DONE} == want
    told = json.loads((tmp_path / "out" / files.DONE).read_text())
    assert (told["files"], told["bytes"]) == (20, 190)
    assert {r.file_name: r.bytes for r in files.saved_files(spark, f"file://{out}").select("file_name", "bytes").collect() if r.file_name != files.DONE} == {k: v for k, v in want.items() if v}
    # A name is a key; other files stay, or go where the folder is overwritten.
    files.save_files(spark.createDataFrame([("a/1/1.bin", bytearray(b"new")), ("b.bin", None)], "file_name string, content binary"), out)
    assert {k: v for k, v in found(out).items() if k != files.DONE} == want | {"a/1/1.bin": 3, "b.bin": 0}
    files.save_files(rows(spark, 2), f"file://{out}", overwrite=True)
    assert {k: v for k, v in found(out).items() if k != files.DONE} == {"a/0/0.bin": 0, "a/1/1.bin": 1}
    files.save_files(rows(spark, 0), str(tmp_path / "none"))
    assert found(str(tmp_path / "none")).keys() == {files.DONE}


@pytest.mark.parametrize("name", ["../x", "/x", "_staged", None, "", "a/../../x", "."])
def test_names_stay_below_the_path(spark, tmp_path, name):
    with pytest.raises(Exception, match="no name for a file"):
        files.save_files(spark.createDataFrame([(name, bytearray(b"x"))], "file_name string, content binary"), str(tmp_path / "out"))
    assert found(str(tmp_path)) == {}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    files.save_files(rows(spark, 3), out)
    before = found(out)
    broken = rows(spark, 40).withColumn("content", F.when(F.col("file_name").endswith("/39.bin"), F.raise_error(F.lit("no more")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no more"):
        files.save_files(broken, out, overwrite=True)
    assert found(out) == before


def test_a_task_that_outlives_its_job(tmp_path):
    """It finds the job's folder gone, clears its own and fails; folders that nobody came back to are cleared after days."""
    import pyspark

    writer = files.FilesWriter(str(tmp_path), False)
    context = pyspark.TaskContext()
    context._partitionId, context._attemptNumber = 0, 0
    before, pyspark.TaskContext._taskContext = pyspark.TaskContext._taskContext, context

    def rows():
        yield {"file_name": "a.bin", "content": b"x"}
        writer.abort([])
        yield {"file_name": "b/c.bin", "content": b"y"}

    try:
        with pytest.raises(RuntimeError, match="given up"):
            writer.write(rows())
        assert list(tmp_path.iterdir()) == []
        old, new = files.FilesWriter(str(tmp_path), False), files.FilesWriter(str(tmp_path), False)
        os.utime(tmp_path / f"_staged-{old.job}", (0, 0))
        third = files.FilesWriter(str(tmp_path), False)
        third.commit([third.write(iter([{"file_name": "d.bin", "content": b"z"}])), None])
    finally:
        pyspark.TaskContext._taskContext = before
    assert {f.name for f in tmp_path.iterdir()} == {"d.bin", files.DONE, f"_staged-{new.job}"}


def test_a_retried_task_writes_each_file_once(tmp_path):
    """Tasks that fail in their first attempt, after some files; the session allows attempts, which the shared one does not."""
    out, mark = tmp_path / "out", tmp_path / "marks"
    mark.mkdir()
    code = f"""
        import os, sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark import TaskContext
        from pyspark.sql import SparkSession
        from flowtab.sources import files
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.local.dir", {str(tmp_path)!r}).getOrCreate()
        def fail_once(batches):
            import pandas as pd
            for b in batches:
                yield pd.DataFrame({{"file_name": [f"{{i}}.bin" for i in b["id"]], "content": [b"x" * int(i) for i in b["id"]]}})
            if TaskContext.get().attemptNumber() == 0:
                open(f"{mark}/{{TaskContext.get().partitionId()}}", "w").close()
                raise RuntimeError("lost")
        files.save_files(spark.range(0, 12, 1, 3).mapInPandas(fail_once, "file_name string, content binary"), {str(out)!r})
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, capture_output=True, timeout=180)
    assert len(list(mark.iterdir())) == 3
    assert {k: v for k, v in found(str(out)).items() if k != files.DONE} == {f"{i}.bin": i for i in range(12)}


@pytest.mark.parametrize("with_targets", [True, False])
def test_small_images_are_restored_in_whole_levels(spark, tmp_path, with_targets):
    """Images below the size on one side or both: as a plain version scales, cuts and scores them."""
    rng, pixels = np.random.default_rng(5), {}
    for name, (h, w) in {"a/x.png": (6, 4), "a/y.png": (3, 9), "z.png": (8, 12), "b/q.png": (2, 2)}.items():
        for role in ("rainy", "clean")[: 1 + with_targets]:
            pixels[role, name] = rng.integers(0, 256, (h, w, 3))
            file = tmp_path / "data" / "val" / role / name
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(sinks.png(pixels[role, name], h, w, 3))

    def plain(a):
        h, w = a.shape[:2]
        short = min(h, w)
        sides = (h, w) if short >= 6 else (round(h * (6 / short)), round(w * (6 / short)))
        return middle(resample(a[None], *sides), 6)[0]

    out = str(tmp_path / "out")
    made, scores = evaluate.restore_folder(spark, str(tmp_path / "data"), 6, scoring.predictor("condition"), 10, out=out, batch=2, steps=2)
    got, psnrs = {r.id: r for r in made.collect()}, []
    exported = {r.file_name: r.pixels for r in files.saved_files(spark, out).where("file_name like '%.png'").withColumn("pixels", sinks.unpng("content")).collect()}
    assert set(exported) == {"00000_0_a__x.png", "00000_0_a__y.png", "00001_0_b__q.png", "00001_0_z.png"}
    for name in {n for _, n in pixels}:
        box = plain(pixels["rainy", name])
        assert len(np.unique(box)) > 2
        assert np.allclose((np.array(got[name].pixels).reshape(box.shape) + 1) / 2 * 255, box, atol=1e-9)
        assert np.array_equal(next(v for k, v in exported.items() if k.endswith(name.replace("/", "__"))), box.ravel())
        if with_targets:
            psnrs.append(-10 * math.log10(max(1e-10, np.mean((box - plain(pixels["clean", name])) ** 2 / 255**2))))
            assert math.isclose(got[name].psnr, psnrs[-1], rel_tol=1e-9)
    assert scores.first().n == len(psnrs)
    if with_targets:
        assert math.isclose(scores.first().psnr, np.mean(psnrs), rel_tol=1e-9)


def test_sides_as_the_plain_version_has_them(spark):
    sides = [(6, 4), (3, 9), (2, 2), (5, 7), (8, 12)]
    h, w = upscaled_size(F.col("h"), F.col("w"), 6)
    got = [tuple(r) for r in spark.createDataFrame(sides, "h int, w int").select(h, w).collect()]
    assert got == [(h, w) if min(h, w) >= 6 else (round(h * (6 / min(h, w))), round(w * (6 / min(h, w)))) for h, w in sides]
