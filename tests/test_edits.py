"""Cutting and bridging on generated geometry and against dense counterparts."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.model import BridgeSettings, UnmergeSettings
from lamina.operators import bridge, components, gate, packed, unmerge
from tests import brute as B


def dumbbell(size=6, gap=3):
    v = np.zeros((size, size, 2 * size + gap), bool)
    v[:, :, :size] = v[:, :, size + gap :] = True
    v[size // 2, size // 2, size : size + gap] = True
    return v


def test_cuts(spark):
    blob = dumbbell(5, 2)
    twin = np.zeros((5, 12, 12), bool)
    twin[:, :5] = twin[:, 7:] = blob
    masks = {"neck": dumbbell(), "solid": np.ones((8, 8, 8), bool), "twin": twin, "small": dumbbell(4)}
    settings = UnmergeSettings(min_seed_size=5, min_piece_size=5, budget=1)
    volumes = B.volumes(spark, **masks)
    proposed, info = unmerge.propose_cuts(B.frame(spark, **masks), volumes, settings)
    found = {(r.volume_id, r.component_no): r for r in info.collect()}
    assert found["neck", 1].cut and found["neck", 1].n_seeds == 2
    assert found["neck", 1].reason == "cut_into_2_pieces"
    assert B.label(B.array(proposed, masks["neck"].shape, "neck"), 26)[1] == 2
    assert found["solid", 1].reason == "not_candidate"
    assert (B.array(proposed, (8, 8, 8), "solid") == masks["solid"]).all()
    assert found["twin", 1].cut and found["twin", 2].reason == "budget_exhausted"
    counts = {r.volume_id: r for r in unmerge.cut_counts(info, volumes).collect()}
    assert (counts["twin"].n_components, counts["twin"].n_candidates, counts["twin"].n_edits) == (2, 2, 1)


def test_empty_mask(spark):
    empty = np.zeros((4, 4, 4), bool)
    volumes = B.volumes(spark, a=empty)
    mask = B.frame(spark, a=empty)
    proposed, info = unmerge.propose_cuts(mask, volumes)
    assert proposed.count() == info.count() == 0
    drawn, counts = bridge.propose_bridges(mask, volumes)
    assert drawn.count() == 0 and counts.first().n_edits == 0


def test_nearest_seed_and_boundary(spark):
    rng = np.random.default_rng(5)
    mask = rng.random((9, 10, 11)) < 0.6
    picks = [tuple(map(int, p)) for p in np.argwhere(mask)[rng.choice(mask.sum(), 12, replace=False)]]
    seeds = spark.createDataFrame(
        [("v0", 0, *p, i % 4) for i, p in enumerate(picks)],
        "volume_id STRING, component LONG, z INT, y INT, x INT, seed LONG",
    )
    voxels = B.frame(spark, v0=mask).withColumn("component", F.lit(0).cast("long"))
    split = unmerge.nearest_seed_partition(voxels, seeds)
    got = {(r.z, r.y, r.x): r.seed for r in split.collect()}
    want = {}
    for p in map(tuple, np.argwhere(mask)):
        p = tuple(map(int, p))
        want[p] = min((sum((a - b) ** 2 for a, b in zip(p, q)), i % 4) for i, q in enumerate(picks))[1]
    assert got == want
    for width in (1, 2):
        edge = np.zeros_like(mask)
        for p, s in want.items():
            for o in B.reach(6):
                if want.get(tuple(a + b for a, b in zip(p, o)), s) != s:
                    edge[p] = True
        if width == 2:
            edge = B.dilate(edge, B.ball(1))
        got_edge = unmerge.partition_boundary(split, B.volumes(spark, v0=mask), width)
        assert (B.array(got_edge, mask.shape) == edge).all()


def bars(gap, side=30):
    m = np.zeros((side, side, side), bool)
    m[5:15, 14:16, 10] = True
    m[15 + gap : 25 + gap, 14:16, 10] = True
    return m


def test_bridges(spark):
    across = np.zeros((30, 30, 30), bool)
    across[5:15, 14:16, 10] = across[19:21, 5:15, 10] = True
    masks = {"line": bars(4), "across": across, "wide": bars(20, 60), "one": bars(20)}
    volumes = B.volumes(spark, **masks)
    settings = BridgeSettings(max_gap=8, angle_tolerance=50, min_size=10, tube_radius=0)
    proposed, counts = bridge.propose_bridges(B.frame(spark, **masks), volumes, settings)
    edits = {r.volume_id: (r.n_components, r.n_edits) for r in counts.collect()}
    assert edits == {"line": (2, 1), "across": (2, 0), "wide": (2, 0), "one": (1, 0)}
    line = B.array(proposed, masks["line"].shape, "line")
    assert B.label(line, 26)[1] == 1
    thick = BridgeSettings(max_gap=8, angle_tolerance=50, min_size=10, tube_radius=2)
    tube, _ = bridge.propose_bridges(B.frame(spark, line=masks["line"]), volumes.filter("volume_id = 'line'"), thick)
    assert tube.count() > line.sum()


def test_nearest_pairs(spark):
    rng = np.random.default_rng(11)
    mask = rng.random((14, 15, 16)) < 0.04
    lab, n = B.label(mask, 26)
    data = [("v0", int(lab[tuple(p)]), *map(int, p)) for p in np.argwhere(mask)]
    points = spark.createDataFrame(data, "volume_id STRING, component INT, z INT, y INT, x INT")
    got = {
        (r.component_a, r.component_b): (r.a_z, r.a_y, r.a_x, r.b_z, r.b_y, r.b_x)
        for r in bridge.nearest_pairs_within(points, 5.0).collect()
    }
    want = {}
    for a, b in combinations(range(1, n + 1), 2):
        best = min(
            (sum(int(u - v) ** 2 for u, v in zip(p, q)), *map(int, p), *map(int, q))
            for p in np.argwhere(lab == a) for q in np.argwhere(lab == b)
        )
        if best[0] < 25:
            want[a, b] = best[1:]
    assert got == want


def test_segments(spark):
    segment = spark.createDataFrame([("v0", 1, 2, 3, 6, 5, 1), ("v0", 2, 2, 2, 2, 2, 2)], "volume_id STRING, a_z INT, a_y INT, a_x INT, b_z INT, b_y INT, b_x INT")
    volumes = B.volumes(spark, v0=np.zeros((7, 8, 9), bool))
    got = B.array(bridge.rasterize_segments(segment, volumes), (7, 8, 9))
    want = {(1, 2, 3), (2, 3, 3), (3, 3, 2), (4, 4, 2), (5, 4, 1), (6, 5, 1), (2, 2, 2)}
    assert {tuple(map(int, p)) for p in np.argwhere(got)} == want
    tube = B.array(bridge.rasterize_segments(segment, volumes, 1), (7, 8, 9))
    assert (tube == B.dilate(got, B.ball(1))).all()


def test_gate(spark):
    counts = spark.createDataFrame([("a", 2, 1, 1), ("b", 2, 0, 0), ("c", 1, 1, 1)], "volume_id STRING, n_components LONG, n_candidates LONG, n_edits LONG")
    score = lambda rows: spark.createDataFrame(rows, "volume_id STRING, score DOUBLE, voi_merge DOUBLE")
    control = score([("a", 0.5, 1.0), ("b", 0.5, 1.0), ("c", 0.5, 1.0)])
    verdicts = gate.metric_gate(counts, control, score([("a", 0.5, 0.8), ("b", 0.9, 0.1), ("c", 0.4, 1.0)]), "voi_merge")
    got = {r.volume_id: (r.accepted, r.control_score) for r in verdicts.collect()}
    assert got == {"a": (True, 0.5), "b": (False, None), "c": (False, 0.5)}
    old, new = np.zeros((2, 2, 2), bool), np.ones((2, 2, 2), bool)
    kept = gate.gated_masks(verdicts, B.frame(spark, a=old, b=old, c=old), B.frame(spark, a=new, b=new, c=new))
    assert {r.volume_id for r in kept.collect()} == {"a"}
    summary = gate.gate_summary(verdicts, "voi_merge").first()
    assert (summary.n_volumes, summary.n_with_candidates, summary.n_accepted) == (3, 2, 1)


def test_components_across_tiles(spark):
    snake = np.zeros((20, 20, 6), bool)
    for z in range(0, 20, 2):
        snake[z] = False
        snake[z, :, 2] = True
        if z + 1 < 20:
            snake[z + 1, 19 if z % 4 == 0 else 0, 2] = True
    rng = np.random.default_rng(1)
    masks = {"snake": snake, "noise": rng.random((20, 20, 6)) < 0.25, "empty": np.zeros((5, 5, 5), bool)}
    volumes = B.volumes(spark, **masks)
    for connectivity in (6, 18, 26):
        found = components.connected_components(B.frame(spark, **masks), volumes, connectivity, tile=3)
        found = found.join(components.rank_components(found, width=50), ["volume_id", "component"])
        for name, mask in masks.items():
            want, _ = B.label(mask, connectivity)
            got = np.zeros(mask.shape, int)
            for r in found.filter(F.col("volume_id") == name).collect():
                got[r.z, r.y, r.x] = r.component_no
            assert (got == want).all(), (name, connectivity)


def test_holes(spark):
    rng = np.random.default_rng(2)
    shell = np.zeros((7, 7, 7), bool)
    shell[1:6, 1:6, 1:6] = True
    shell[2:5, 2:5, 2:5] = False
    masks = {"shell": shell, "noise": rng.random((8, 9, 10)) < 0.6, "full": np.ones((3, 3, 3), bool)}
    frames = components.bounds(B.volumes(spark, **masks))
    mask = B.frame(spark, **masks)
    filled = components.fill_holes(mask, frames, tile=4)
    counts = {r.volume_id: r.n_holes for r in components.count_internal_holes(mask, frames, tile=4).collect()}
    for name, m in masks.items():
        assert (B.array(filled, m.shape, name) == B.fill(m)).all()
        assert counts[name] == B.enclosed(m)[1]


def test_morphology(spark):
    from lamina.functions.stencils import ball_spans

    rng = np.random.default_rng(4)
    masks = {"a": rng.random((6, 7, 70)) < 0.1, "b": rng.random((9, 9, 9)) < 0.5}
    volumes, mask = B.volumes(spark, **masks), B.frame(spark, **masks)
    for r in (1, 2, 3):
        grown = packed.dilate(mask, volumes, ball_spans(r))
        closed = packed.close(mask, volumes, ball_spans(r))
        worn = packed.erode(grown, ball_spans(1))
        for name, m in masks.items():
            big = B.dilate(m, B.ball(r))
            assert (B.array(grown, m.shape, name) == big).all()
            assert (B.array(closed, m.shape, name) == B.erode(big, B.ball(r))).all()
            assert (B.array(worn, m.shape, name) == B.erode(big, B.ball(1))).all()
    with pytest.raises(ValueError):
        packed.dilate(mask, volumes, ball_spans(17))


def test_cutting_moves_words_not_voxels(spark, monkeypatch):
    solid = np.zeros((9, 9, 64), bool)
    solid[1:8, 1:8, 1:30] = solid[1:8, 1:8, 33:63] = solid[4, 4, 28:35] = True
    rows, settle = [], unmerge.settle
    monkeypatch.setattr(unmerge, "settle", lambda df: rows.append(settle(df)) or rows[-1])
    proposed, info = unmerge.propose_cuts(B.frame(spark, v0=solid), B.volumes(spark, v0=solid), UnmergeSettings(min_seed_size=20, min_piece_size=20))
    found = info.collect()
    assert [(r.cut, r.n_seeds, r.reason) for r in found] == [(True, 2, "cut_into_2_pieces")]
    got = B.array(proposed, solid.shape)
    assert (got <= solid).all() and got.sum() > 0.9 * solid.sum() and not got[4, 4, 28:35].all()
    # What is written between the steps grows with lines, not with voxels.
    assert max(df.count() for df in rows) < solid.sum() / 5
