"""Files, listings and error paths of catalog and splits."""

import json

import pytest
from pyspark.sql import functions as F

from lamina.operators import patches, report, splits
from lamina.model import PatchSettings
from lamina.sources import catalog as G


def test_metadata_csv(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text("Scroll_ID, ID \n7,a\n8,b\n9,a\n,c\n")
    got = {r.id: r.scroll_id for r in G.read_case_metadata(spark, str(path)).collect()}
    assert got == {"a": "7", "b": "8", "c": "unknown"}
    path.write_text("id\n1\n")
    assert G.read_case_metadata(spark, str(path)).first().scroll_id == "unknown"
    path.write_text("name\n1\n")
    with pytest.raises(KeyError):
        G.read_case_metadata(spark, str(path))


def test_case_files(spark, tmp_path):
    for name in ("a.tif", "b.TIFF", "c.png", "d.tif"):
        (tmp_path / name).write_bytes(b"12345")
    got = {r.id: r.length for r in G.list_case_files(spark, str(tmp_path)).collect()}
    assert got == {"a": 5, "b": 5, "d": 5}


def test_empty_index_is_an_error(spark):
    ids = spark.createDataFrame([("a", "s")], "id STRING, scroll_id STRING")
    none = ids.select("id").limit(0)
    with pytest.raises(FileNotFoundError):
        G.indexed_volumes(G.build_volume_index(ids, none, none, none, none))


def test_export_writes_roles(spark, tmp_path):
    index = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "volume_id STRING, scroll_id STRING")
    held = spark.createDataFrame([("z",)], "id STRING")
    cases = G.export_cases(index, held, max_train=2)
    voxels = spark.createDataFrame([(i, 0, 0, 0) for i in "abcz"], "volume_id STRING, z INT, y INT, x INT")
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        G.read_export(spark, path)
    # What a broken run left is no version and is replaced.
    voxels.withColumnRenamed("volume_id", "case_id").withColumn("role", F.lit("train")).write.partitionBy("role").parquet(path + "/version-1")
    with pytest.raises(FileNotFoundError):
        G.read_export(spark, path)
    manifest = G.export_dataset(cases, voxels, path, "demo").first()
    assert (manifest.n_train, manifest.n_test, manifest.scrolls, manifest.n_train_rows, manifest.n_test_rows) == (2, 1, "s", 2, 1)
    kept = {("a", "train"), ("b", "train"), ("z", "test")}
    assert {(r.case_id, r.role) for r in G.read_export(spark, path)[1].collect()} == kept
    G.export_dataset(cases, voxels.limit(0), path, "demo")  # already there
    assert {(r.case_id, r.role) for r in G.read_export(spark, path)[1].collect()} == kept
    G.export_dataset(cases, voxels.filter("volume_id = 'z'"), path, "demo", 2)
    assert {r.case_id for r in G.read_export(spark, path)[1].collect()} == {"z"}
    assert G.read_export(spark, path, 1)[1].count() == 3


def test_split_files(spark, tmp_path):
    path = tmp_path / "splits.json"
    path.write_text(json.dumps([{"train": ["a", "b"], "val": ["c"]}, {"train": ["c"], "val": ["a", "b"]}], indent=2))
    cases = spark.createDataFrame([(c, "s") for c in "abc"], "case_id STRING, scroll_id STRING")
    rows = {(r.fold, r.case_id, r.role) for r in splits.read_splits(spark, str(path)).collect()}
    assert rows == {(0, "a", "train"), (0, "b", "train"), (0, "c", "val"), (1, "c", "train"), (1, "a", "val"), (1, "b", "val")}
    assert splits.resolve_splits(spark, str(path), cases).first().source == f"file:{path}"
    made = splits.resolve_splits(spark, str(tmp_path / "none.json"), cases, k=3)
    assert made.first().source == "reconstructed" and made.filter("role = 'val'").count() == 3
    check = splits.check_split(made, cases).collect()
    assert all(r.n_overlap == r.n_uncovered == 0 for r in check)


def test_holdout_errors(spark):
    cases = spark.createDataFrame([("a", "1"), ("b", "2")], "case_id STRING, scroll_id STRING")
    with pytest.raises(ValueError):
        splits.group_holdout(cases, ["9"])
    with pytest.raises(ValueError):
        splits.group_holdout(cases, ["1", "2"])


def test_errors_surface(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id STRING")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "case_id STRING, score DOUBLE")
    assert abs(report.mean_score(cases, cases, cases, scores).first().mean_score - 0.6) < 1e-9
    with pytest.raises(Exception, match="missing prediction for b"):
        report.mean_score(cases, cases.filter("case_id = 'a'"), cases, scores).collect()
    volumes = spark.createDataFrame([("v", 4, 4, 4)], "volume_id STRING, d INT, h INT, w INT")
    labels = spark.createDataFrame([("v", z, y, x, 2) for z in range(4) for y in range(4) for x in range(4)], "volume_id STRING, z INT, y INT, x INT, label INT")
    with pytest.raises(RuntimeError):
        patches.require_patches(patches.patch_index(labels, volumes, PatchSettings((4, 4, 4), (4, 4, 4))))
    with pytest.raises(ValueError):
        PatchSettings((0, 1, 1))


def test_sizes_beyond_64_bits(spark, tmp_path):
    from __spark_entry__ import queries

    keys = [(9_000_000, 899_999), (8_999_999, 3), (1, 165), (0, 5)]
    spark.createDataFrame(keys, "o_orderkey LONG, o_custkey LONG").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.id: r.size for r in queries()["format_bytes"](spark, str(tmp_path)).collect()}
    assert got == {k: _two_decimals(float(k * k * c)) for k, c in keys}


def test_sizes_round_by_their_exact_value(spark):
    from lamina.functions.columns import format_bytes

    # The first one is just below a half of a hundredth, though its shortest text ends in 5; then ties and limits.
    sizes = [5.1250591679243846e19, 1024 * 1.125, 1024 * 1.375, 1023.0, 1024.0, 1048575.0, 2.0**40, 0.0]
    rows = spark.createDataFrame([(s,) for s in sizes], "b DOUBLE").select("b", format_bytes("b").alias("size")).collect()
    assert {r.b: r["size"] for r in rows} == {s: _two_decimals(s) for s in sizes}


def _two_decimals(size):
    step = min(4, next((k for k in range(5) if size < 1024.0 ** (k + 1)), 4))
    return f"{size / 1024.0**step:.2f} {('B', 'KB', 'MB', 'GB', 'TB')[step]}"
