"""The cleanup chain against dense counterparts."""

import numpy as np
import pytest

from lamina.model import STAGES, CleanupSettings
from lamina.operators import cleanup, components
from tests import brute as B


def sheet(shape, rng, holes=0.25, tilt=0.3):
    """A tilted sheet, two voxels thick, with random holes."""
    mask = np.zeros(shape, bool)
    for y in range(2, shape[1] - 2):
        for x in range(2, shape[2] - 2):
            if rng.random() > holes:
                z = int(shape[0] / 2 + tilt * (y - shape[1] / 2))
                mask[max(0, z) : z + 2, y, x] = True
    return mask


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(7)
    up = sheet((12, 14, 40), rng)
    return {
        "flat": up,
        "stood": np.ascontiguousarray(np.moveaxis(up, 0, 2)[:, :20]),
        "noise": rng.random((9, 10, 11)) < 0.2,
        "solid": np.ones((5, 5, 5), bool),
    }


def test_stages_match(spark, masks):
    settings = CleanupSettings(min_size=12, closing_radius=1)
    got = cleanup.run_stages(B.frame(spark, **masks), B.volumes(spark, **masks), settings)
    assert tuple(got) == STAGES
    for name, mask in masks.items():
        want = B.clean(mask, 12, 1)
        for stage in STAGES:
            assert (B.array(got[stage], mask.shape, name) == want[stage]).all(), (name, stage)
    assert got["patch"].count() > got["closing"].count()


def test_patch_without_closing(spark, masks):
    settings = CleanupSettings(min_size=5, closing=False)
    got = cleanup.cleanup_chain(B.frame(spark, **masks), B.volumes(spark, **masks), settings, "plug")
    for name, mask in masks.items():
        assert (B.array(got, mask.shape, name) == B.clean(mask, 5, 0)["plug"]).all(), name


def test_plug(spark):
    rng = np.random.default_rng(3)
    masks = {"a": rng.random((7, 6, 70)) < 0.25, "thin": rng.random((1, 9, 9)) < 0.3}
    frames = components.bounds(B.volumes(spark, **masks))
    got = cleanup.plug_holes(B.frame(spark, **masks), frames)
    for name, mask in masks.items():
        assert (B.array(got, mask.shape, name) == B.plug(mask)).all(), name


def test_unknown_stage(spark, masks):
    with pytest.raises(ValueError):
        cleanup.run_stages(B.frame(spark, **masks), B.volumes(spark, **masks), through="nothing")


def test_plugging_spreads_one_large_component(spark, monkeypatch):
    from lamina import session
    from lamina.operators import packed

    monkeypatch.setattr(session, "CELLS_A_TASK", 1 << 12)
    cells = spark.range(40 * 40).selectExpr("'a' AS volume_id", "5L AS component", "CAST(id div 40 AS INT) AS z", "CAST(id % 40 AS INT) AS y",
                                            "CAST((id * 7) % 64 AS INT) AS x")
    # As a shuffled join before leaves them: all words of the component together.
    words = session.settle(packed.pack(cells, cleanup.PART)).repartition(7, *cleanup.PART)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = cleanup.plug_words(words, cleanup.PART, 2).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert max(sizes) < sum(sizes) / 2
