"""Line transforms, tiles, borders and quantiles on volumes wider than a word, against dense counterparts."""

import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.functions.stencils import line_reach
from lamina.model import BridgeSettings, UnmergeSettings
from lamina.operators import channels, components, distance, edits, lines, patches, quantiles, score, stats, unmerge
from lamina.sources.catalog import dense_cells
from tests import brute as B


def wide(seed, shape=(4, 6, 101), share=0.45):
    return np.random.default_rng(seed).random(shape) < share


def test_envelope():
    rng = np.random.default_rng(1)
    for length in (1, 2, 7, 40):
        cost = rng.integers(0, 300, (200, length))
        cost[rng.random(cost.shape) < 0.5] = lines.NOTHING
        for scale in (1, 5):
            best = lines.envelope(cost, scale)
            at = np.arange(length)
            for row, found in zip(cost, best):
                known = np.nonzero(row < lines.NOTHING)[0]
                if not len(known):
                    assert (found == -1).all()
                    continue
                every = scale * (at[:, None] - known[None, :]) ** 2 + row[known]
                assert (scale * (at - found) ** 2 + row[found] == every.min(axis=1)).all()


def test_envelope_is_linear_in_the_line():
    def seconds(length):
        cost = np.full((2000, length), lines.NOTHING)
        cost[:, 0] = cost[:, -1] = 0
        cost[:, 1:-1] = 10**6
        return min(_timed(lambda: lines.envelope(cost)) for _ in range(3))

    assert seconds(256) < 4 * seconds(128)


def _timed(fn):
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


def test_distances(spark):
    masks = {"noise": wide(2, share=0.8), "full": np.ones((3, 3, 40), bool), "solid": np.pad(np.ones((9, 9, 60), bool), 2), "none": np.zeros((3, 3, 3), bool)}
    out = distance.distance_transform(B.frame(spark, **masks), B.volumes(spark, **masks)).collect()
    got = {(r.volume_id, r.z, r.y, r.x): r.d2 for r in out}
    assert len(got) == len(out)
    want = {(name, *map(int, p)): d for name, m in masks.items() if not m.all() for p, d in B.distance2(m).items()}
    want |= {("full", z, y, x): None for z in range(3) for y in range(3) for x in range(40)}
    assert got == want


def test_nearest_seeds_over_gaps_and_ties(spark):
    mask = wide(3, (5, 7, 70), 0.5)
    rng = np.random.default_rng(4)
    picks = [tuple(map(int, p)) for p in np.argwhere(mask)[rng.choice(mask.sum(), 9, replace=False)]]
    names = [int(v) for v in rng.integers(-5, 1 << 40, 9)]
    names[3:5] = names[:2]
    seeds = spark.createDataFrame(
        [("v0", 0, *p, n) for p, n in zip(picks, names)], "volume_id STRING, component LONG, z INT, y INT, x INT, seed LONG")
    voxels = B.frame(spark, v0=mask, lone=mask).withColumn("component", F.lit(0).cast("long"))
    got = {(r.z, r.y, r.x): r.seed for r in unmerge.nearest_seed_partition(voxels, seeds).collect()}
    assert got == {
        tuple(map(int, p)): min((sum((int(a) - b) ** 2 for a, b in zip(p, q)), n) for q, n in zip(picks, names))[1] for p in np.argwhere(mask)}


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_components_cross_every_face(spark, connectivity):
    masks = {"a": wide(5, share=0.25), "b": wide(6, share=0.25), "line": np.ones((1, 1, 130), bool)}
    # The diagonal passes from word to word through edges and corners only.
    masks["stair"] = np.zeros((70, 2, 70), bool)
    masks["stair"][np.arange(70), np.arange(70) % 2, np.arange(70)] = True
    found = components.connected_components(B.frame(spark, **masks), B.volumes(spark, **masks), connectivity, tile=2)
    got = Counter((r.volume_id, r.component) for r in found.collect())
    want = Counter()
    for name, m in masks.items():
        lab, n = B.label(m, connectivity)
        index = np.arange(m.size).reshape(m.shape)
        for i in range(1, n + 1):
            want[name, int(index[lab == i].min())] = int((lab == i).sum())
    assert got == want


def test_many_tiles_are_labelled_at_once():
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for tile, corner in enumerate(((0, 0, 0), (64, 32, 96), (32, 0, 2048))):
        for mask in (7, 9):
            dense = rng.random((4, 5, 6)) < 0.3
            lab = B.label(dense, 26)[0]
            for p in np.argwhere(dense):
                z, y, x = map(int, p + corner)
                rows.append((tile, mask, z, y, x, x))
                first = np.argwhere(lab == lab[tuple(p)])[0] + corner
                want[tile, mask, z, y, x] = int(first[0]) << 42 | int(first[1]) << 21 | int(first[2])
    rows = [r for t in range(3) for r in rng.permutation([r for r in rows if r[0] == t]).tolist()]
    runs = pa.table(dict(zip(("tile", "mask", "z", "y", "x0", "x1"), map(pa.array, zip(*rows)))))
    starts = np.array([[r[0] for r in rows].index(t) for t in range(3)])
    got = {}
    # Runs of single voxels need their own line as a neighbour as well.
    for out in components._tile_labels([*line_reach(26), (0, 0, 1)], ["mask"])(runs, starts):
        got |= {(r["tile"], r["mask"], r["z"], r["y"], r["x0"]): r["node"] for r in out.to_pylist()}
    assert got == want


def test_holes_in_wide_volumes(spark):
    masks = {"a": wide(7, share=0.75), "box": np.pad(np.pad(np.zeros((1, 1, 64), bool), 1, constant_values=True), 1), "none": np.zeros((3, 3, 65), bool)}
    mask, volumes = B.frame(spark, **masks), B.volumes(spark, **masks)
    filled = components.fill_holes(mask, components.bounds(volumes), tile=2)
    counts = {r.volume_id: r.n_holes for r in components.count_internal_holes(mask, components.bounds(volumes), tile=2).collect()}
    for name, m in masks.items():
        assert (B.array(filled, m.shape, name) == B.fill(m)).all()
        assert counts[name] == B.enclosed(m)[1]


def test_coordinates_beyond_the_limit_are_an_error(spark):
    far = spark.createDataFrame([("v0", 0, 0, components.SIDE_LIMIT)], B.SCHEMA)
    with pytest.raises(Exception, match="coordinates"):
        components.label_runs(components.to_runs(far))


def test_overlaps_of_labels(spark):
    a, b = wide(8, share=0.3), wide(9, share=0.3)
    runs = [components.label_runs(components.to_runs(B.frame(spark, v0=m)), 6) for m in (a, b)]
    got = score.voi(*runs, B.volumes(spark, v0=a)).first()
    la, lb = B.label(a, 6)[0], B.label(b, 6)[0]
    joint = Counter(zip(la[a | b].tolist(), lb[a | b].tolist()))
    n = sum(joint.values())
    p, t = Counter(), Counter()
    for (i, j), k in joint.items():
        p[i] += k
        t[j] += k
    split = -sum(k / n * math.log2(k / p[i]) for (i, _), k in joint.items())
    merge = -sum(k / n * math.log2(k / t[j]) for (_, j), k in joint.items())
    assert got.n_foreground == n and abs(got.voi_split - split) < 1e-9 and abs(got.voi_merge - merge) < 1e-9
    kept = score.apply_ignore(B.frame(spark, v0=a), B.frame(spark, v0=b))
    assert (B.array(kept, a.shape) == (a & ~b)).all()


@pytest.mark.parametrize("few, buckets", [(20, 64), (10_000, 4096)])
def test_quantiles(spark, monkeypatch, few, buckets):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rng = np.random.default_rng(10)
    groups = {
        "ties": np.repeat([1.0, 2.0, 7.5], [50, 1, 30]), "skew": np.exp(rng.normal(0, 4, 300)), "one": np.array([-4.0]),
        "flat": np.full(40, 3.25), "wide": np.array([-1e308, -1.0, 0.0, 2.0, 1e308]), "mixed": rng.normal(size=101).round(1),
    }
    rows = [(k, float(v), n) for k, vs in groups.items() for v, n in Counter(vs.tolist()).items()]
    rows += [("ties", 1.0, 0), ("nothing", 5.0, 0)]
    df = spark.createDataFrame(rows, "g STRING, value DOUBLE, n INT")
    wanted = (0.0, 0.01, 0.3, 0.5, 0.99, 1.0)
    got = {r.g: r.q for r in quantiles.quantiles(df, ["g"], wanted).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose(got[k], np.quantile(vs, wanted), rtol=1e-9, atol=1e-9), k
    every = quantiles.quantiles(df, [], (0.5,)).first().q[0]
    assert abs(every - np.quantile(np.concatenate(list(groups.values())), 0.5)) < 1e-9


def test_domain_shift_keeps_empty_and_flat_scrolls(spark):
    rows = [("a", 0, 0, x, 5.0, 1 if x else 0) for x in range(3)] + [("b", 0, 0, x, 9.0, 2) for x in range(3)] + [("c", 0, 0, 0, 5.0, 0)]
    voxels = spark.createDataFrame(rows, "volume_id STRING, z INT, y INT, x INT, intensity DOUBLE, label INT")
    volumes = spark.createDataFrame([("a", "s1", 1, 1, 3), ("b", "s2", 1, 1, 3), ("c", "s3", 1, 1, 1)], "volume_id STRING, scroll_id STRING, d INT, h INT, w INT")
    got = {(r.scroll_a, r.scroll_b): r for r in stats.scroll_domain_shift(voxels, volumes).collect()}
    assert set(got) == {("s1", "s2"), ("s1", "s3"), ("s2", "s3")}
    assert (got["s1", "s2"].mean_diff, got["s1", "s2"].hist_l1, got["s1", "s3"].hist_l1) == (5.0, 1.0, 0.0)
    assert abs(got["s1", "s2"].surface_density_a - 2 / 3) < 1e-12 and got["s1", "s2"].surface_density_b == 0


def test_blur_over_tile_borders(spark):
    rng = np.random.default_rng(11)
    shape = (3, 9, 45)
    dense = np.where(rng.random(shape) < 0.3, rng.random(shape), 0)
    rows = [("v0", *map(int, p), float(dense[tuple(p)])) for p in np.argwhere(dense > 0)]
    voxels = spark.createDataFrame(rows, "volume_id STRING, z INT, y INT, x INT, intensity DOUBLE")
    volumes = B.volumes(spark, v0=dense > 0)
    kernel = channels.gaussian_kernel(1.5)
    want = dense
    for axis in range(3):
        n = want.shape[axis]
        reach = len(kernel) - 1
        images = [i % (2 * n) for i in range(-reach, n + reach)]
        padded = want.take([i if i < n else 2 * n - 1 - i for i in images], axis)
        want = sum(kernel[abs(k - reach)] * padded.take(range(k, k + n), axis) for k in range(2 * reach + 1))
    for tile in (4, 32):
        got = np.zeros(shape)
        for r in channels.gaussian_blur(voxels, volumes, 1.5, tile=tile).collect():
            got[r.z, r.y, r.x] = r.blurred
        assert np.allclose(got, want, atol=1e-12)
        high = np.zeros(shape)
        for r in channels.highpass_channel(voxels, volumes, 1.5, tile=tile).collect():
            high[r.z, r.y, r.x] = r.highpass
        assert np.allclose(high, dense - want, atol=1e-12)


def test_blur_treats_many_cubes_at_once(spark):
    rng = np.random.default_rng(5)
    dense = {f"v{i}": rng.random((i % 3 + 1, 5, i % 7 + 2)) for i in range(20)}
    rows = [(v, *map(int, p), float(a[p])) for v, a in dense.items() for p in np.ndindex(a.shape)]
    # Beyond the far face: not a cell of its volume, so no mirror image of one either.
    rows.append(("v0", 0, 0, 2, 100.0))
    voxels = spark.createDataFrame(rows, "volume_id STRING, z INT, y INT, x INT, intensity DOUBLE")
    out = channels.gaussian_blur(voxels, B.volumes(spark, **{v: a > 0 for v, a in dense.items()}), 1.0, tile=4)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    kernel = channels.gaussian_kernel(1.0)
    want = {}
    for v, a in dense.items():
        for axis in range(3):
            n = a.shape[axis]
            padded = a.take([i if i < n else 2 * n - 1 - i for i in (np.arange(-4, n + 4) % (2 * n))], axis)
            a = sum(kernel[abs(k - 4)] * padded.take(range(k, k + n), axis) for k in range(9))
        want |= {(v, *map(int, p)): a[p] for p in np.ndindex(a.shape)}
    got = {(r.volume_id, r.z, r.y, r.x): r.blurred for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_cells_of_one_volume_use_many_tasks(spark, monkeypatch):
    from lamina import session

    monkeypatch.setattr(session, "CELLS_A_TASK", 500)
    volumes = spark.createDataFrame([("v0", 20, 10, 50)], "volume_id STRING, d INT, h INT, w INT")
    cells = dense_cells(volumes).withColumn("task", F.spark_partition_id())
    assert cells.count() == 10_000 and cells.select("task").distinct().count() > 8


def test_percentile_normalisation(spark):
    rows = spark.createDataFrame([("v0", float(i * i)) for i in range(101)], "volume_id STRING, intensity DOUBLE")
    out = sorted(r.intensity for r in patches.normalize(rows, "percentile").collect())
    assert out[0] == 0 and abs(out[-1] - 1) < 1e-6


def test_gated_runs_keep_what_scores_better(spark):
    blobs = np.zeros((8, 8, 44), bool)
    blobs[1:7, 1:7, 1:18] = blobs[1:7, 1:7, 22:43] = True
    joined = blobs.copy()
    joined[4, 4, 18:22] = True
    masks = {"apart": joined, "whole": joined, "plain": blobs}
    truth = {"apart": blobs, "whole": joined, "plain": blobs}
    volumes = B.volumes(spark, **masks)
    labels = B.frame(spark, **truth).withColumn("label", F.lit(1))
    run = edits.gated_run(B.frame(spark, **masks), labels, volumes, UnmergeSettings(min_seed_size=20, min_piece_size=20))
    verdicts = {r.volume_id: r for r in run.verdicts.collect()}
    assert verdicts["apart"].accepted and verdicts["apart"].score_delta > 0
    assert not verdicts["whole"].accepted and verdicts["whole"].n_edits == 1
    assert not verdicts["plain"].accepted and verdicts["plain"].n_edits == 0 and verdicts["plain"].control_score is None
    assert B.label(B.array(run.masks, joined.shape, "apart"), 26)[1] == 2
    assert (B.array(run.masks, joined.shape, "whole") == joined).all() and (B.array(run.masks, blobs.shape, "plain") == blobs).all()
    scores = {(r.condition, r.volume_id): r.score for r in run.scores.collect()}
    assert len(scores) == 6 and scores["accepted", "apart"] > scores["control", "apart"]
    assert scores["accepted", "whole"] == scores["control", "whole"] == scores["control", "plain"] == 1.0
    gap = {"bars": blobs & ~np.isin(np.arange(44), range(10, 13))}
    bridged = edits.gated_run(
        B.frame(spark, **gap), B.frame(spark, bars=blobs).withColumn("label", F.lit(1)), B.volumes(spark, **gap),
        BridgeSettings(max_gap=5, min_size=20, tangent_radius=4, tube_radius=1))
    assert bridged.verdicts.first().n_edits >= 1 and {r.condition for r in bridged.scores.collect()} == {"control", "accepted"}


def _affinities(labels, parts, shape, offsets, background):
    """{(cell, offset): affinity} of every cell, -1 where the pair is invalid."""
    out = {}
    for o in offsets:
        for v in np.ndindex(*shape):
            w = tuple(int(a + b) for a, b in zip(v, o))
            ok = all(0 <= a < n for a, n in zip(w, shape)) and labels[v] != 2 and labels[w] != 2 and (background or parts[v] > 0 or parts[w] > 0)
            out[v, o] = int(parts[v] == parts[w] and parts[v] > 0) if ok else -1
    return out


def test_affinities_across_cubes_shuffle_no_pairs(spark):
    shape, rng = (5, 37, 70), np.random.default_rng(31)
    labels = rng.choice([0, 1, 2], shape, p=[0.85, 0.1, 0.05])
    parts = np.where(labels == 1, rng.integers(1, 4, shape), 0)
    rows = [("v0", *map(int, v), int(labels[v])) for v in np.ndindex(*shape) if labels[v]] + [("v0", 9, 0, 0, 2), ("v9", 0, 0, 0, 2)]
    marked = spark.createDataFrame(rows, "volume_id STRING, z INT, y INT, x INT, label INT")
    named = spark.createDataFrame([("v0", *map(int, v), int(parts[v]) << 40) for v in np.ndindex(*shape) if parts[v]] + [("v0", 0, -1, 0, 5)],
                                  "volume_id STRING, z INT, y INT, x INT, component LONG")
    empty = np.zeros((1, 2, 3), bool)  # a volume without any voxel
    volumes = B.volumes(spark, v0=np.zeros(shape, bool), v1=empty)
    offsets = ((1, 0, 0), (0, -3, 1), (0, 0, 16), (0, 2, -40))
    for background in (False, True):
        want = _affinities(labels, parts, shape, offsets, background)
        nothing = np.zeros(empty.shape, int)
        want = {("v0", *k): a for k, a in want.items()} | {("v1", *k): a for k, a in _affinities(nothing, nothing, empty.shape, offsets, background).items()}
        sparse = channels.affinity_targets(marked, named, volumes, offsets, background)
        # Only stored voxels and cubes are dealt.
        assert "hashpartitioning(volume_id" in sparse._jdf.queryExecution().toString() and "oz" not in "".join(
            line for line in sparse._jdf.queryExecution().toString().splitlines() if "hashpartitioning" in line)
        for df, kept in ((sparse, lambda a: a >= 0), (channels.all_affinity(marked, named, volumes, offsets, background), lambda a: True)):
            got = [((r.volume_id, (r.z, r.y, r.x), (r.oz, r.oy, r.ox)), r.affinity) for r in df.collect()]
            assert len(got) == len(dict(got)) and dict(got) == {k: a for k, a in want.items() if kept(a)}
