"""Scores of shapes with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import channels, components, score
from lamina.sources import scores as S
from lamina.streaming.incremental import announce, score_incrementally
from tests import brute as B


def shapes():
    solid = np.zeros((7, 7, 7), bool)
    solid[1:6, 1:6, 1:6] = True
    shell = solid.copy()
    shell[2:5, 2:5, 2:5] = False
    ring = np.zeros((7, 7, 7), bool)
    ring[3, 1:6, 1:6] = True
    ring[3, 2:5, 2:5] = False
    return {"solid": solid, "shell": shell, "ring": ring, "none": np.zeros((7, 7, 7), bool)}


def test_betti(spark):
    masks = shapes()
    volumes, mask = B.volumes(spark, **masks), B.frame(spark, **masks)
    euler = {r.volume_id: r.euler for r in score.euler_characteristic(mask, volumes).collect()}
    assert euler == {"solid": 1, "shell": 2, "ring": 0, "none": 0}
    got = {r.volume_id: (r.b0, r.b1, r.b2) for r in score.betti_numbers(mask, volumes).collect()}
    assert got == {"solid": (1, 0, 0), "shell": (1, 0, 1), "ring": (1, 1, 0), "none": (0, 0, 0)}


def labels_of(df):
    return df.withColumn("label", F.lit(1))


def test_self_score_and_empty(spark):
    masks = shapes()
    volumes, mask = B.volumes(spark, **masks), B.frame(spark, **masks)
    for r in score.case_score(mask, labels_of(mask), volumes).collect():
        assert (r.score, r.voi_split, r.voi_merge) == (1.0, 0.0, 0.0)
    for r in score.case_score(mask.limit(0), labels_of(mask), volumes).collect():
        assert (r.surface_dice, r.voi_score) == ((1.0, 1.0) if r.volume_id == "none" else (0.0, 0.0))


def test_ignored_voxels_count_nowhere(spark):
    m = shapes()["solid"]
    volumes = B.volumes(spark, solid=m)
    truth = B.frame(spark, solid=m).withColumn("label", F.when(F.col("x") == 3, 2).otherwise(1))
    kept = score.case_score(B.frame(spark, solid=m), truth, volumes).first()
    assert kept.score == 1.0 and kept.n_foreground == int(m.sum()) - int(m[:, :, 3].sum())


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    masks = shapes()
    volumes, mask = B.volumes(spark, **masks), B.frame(spark, **masks)
    truth = labels_of(mask.filter("x > 2"))
    path = str(tmp_path)

    def run():
        query = score_incrementally(spark, path + "/in", path + "/manifest", truth, volumes, path + "/out", path + "/state")
        query.awaitTermination()
        try:
            return {r.volume_id: r.score for r in spark.read.parquet(path + "/out").collect()}
        except Exception:  # noqa: BLE001 - nothing was scored yet
            return {}

    want = {r.volume_id: r.score for r in score.case_score(mask, truth, volumes).collect()}
    ring = mask.filter("volume_id = 'ring'")
    announce(ring, volumes.filter("volume_id = 'ring'"), path + "/manifest")
    ring.filter("z < 2").write.parquet(path + "/in")
    assert run() == {}  # half of it has landed
    ring.filter("z >= 2").write.mode("append").parquet(path + "/in")
    assert run() == {"ring": want["ring"]}
    rest = mask.filter("volume_id != 'ring'")
    rest.write.mode("append").parquet(path + "/in")
    assert set(run()) == {"ring"}  # not announced yet
    # The empty volume has no row and is scored as well.
    announce(rest, volumes.filter("volume_id != 'ring'"), path + "/manifest")
    assert run() == want and "none" in want
    assert run() == want
    assert spark.read.parquet(path + "/out").count() == len(want)


def test_scores_resume(spark, tmp_path):
    path = tmp_path / "scores.jsonl"
    path.write_text('{"case_id": "a", "score": 0.1}\nnot json\n{"case_id": "b", "score": 0.2, "extra": 1}\n{"case_id": "a", "score": 0.3}\n')
    assert {r.case_id: r.score for r in S.load_scores_latest(spark, str(path)).collect()} == {"a": 0.3, "b": 0.2}


def test_affinity_examples(spark):
    seg = np.zeros((32, 32, 32), int)
    seg[4:28, 10, 4:20] = 1
    seg[4:28, 11, 12:28] = 1
    seg[:, :, 28:] = 2
    data = [("v0", *map(int, p), int(seg[tuple(p)])) for p in np.argwhere(seg)]
    labels = spark.createDataFrame(data, "volume_id STRING, z INT, y INT, x INT, label INT")
    volumes = B.volumes(spark, v0=seg)
    parts = components.connected_components(labels.filter("label = 1"), volumes)
    assert parts.select("component").distinct().count() == 1
    offsets = ((0, 0, 1), (0, 1, 0), (1, 0, 0))

    def value(background, *key):
        t = channels.dense_affinity(channels.affinity_targets(labels, parts, volumes, offsets, background), volumes, offsets)
        names = ("z", "y", "x", "oz", "oy", "ox")
        return t.filter(" AND ".join(f"{n} = {v}" for n, v in zip(names, key))).first().affinity

    assert value(False, 10, 10, 10, 0, 0, 1) == 1
    assert value(False, 10, 10, 14, 0, 1, 0) == 1
    assert value(False, 10, 10, 27, 0, 0, 1) == -1
    assert value(False, 2, 2, 2, 1, 0, 0) == -1
    assert value(True, 2, 2, 2, 1, 0, 0) == 0
    with pytest.raises(ValueError):
        channels.affinity_targets(labels, parts, volumes, ((0, 0, 0),))


def test_highpass_of_constant_is_zero(spark):
    volumes = B.volumes(spark, v0=np.zeros((5, 6, 4)))
    cells = [("v0", z, y, x, 42.0) for z in range(5) for y in range(6) for x in range(4)]
    rows = spark.createDataFrame(cells, "volume_id STRING, z INT, y INT, x INT, intensity DOUBLE")
    # The kernel is wider than the volume, so values mirror more than once.
    out = channels.highpass_channel(rows, volumes, sigma=2.0)
    assert out.count() == 120 and out.filter("abs(highpass) > 1e-9").count() == 0
