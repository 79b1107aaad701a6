"""Slow dense counterparts of the operators, for small arrays."""

from __future__ import annotations

from itertools import product

import numpy as np


def ball(r):
    n = int(r)
    return [o for o in product(range(-n, n + 1), repeat=3) if sum(v * v for v in o) <= r * r]


def reach(connectivity, ndim=3):
    limit = {6: 1, 18: 2, 26: 3, 4: 1, 8: 2}[connectivity]
    return [o for o in product((-1, 0, 1), repeat=ndim) if 0 < sum(map(abs, o)) <= limit]


def shift(mask, o):
    """``out[p] = mask[p - o]``, empty from outside."""
    out = np.zeros_like(mask)
    src = tuple(slice(max(0, -v), n - max(0, v)) for v, n in zip(o, mask.shape))
    dst = tuple(slice(max(0, v), n - max(0, -v)) for v, n in zip(o, mask.shape))
    if all(s.start < s.stop for s in src):
        out[dst] = mask[src]
    return out


def dilate(mask, offsets):
    out = np.zeros_like(mask)
    for o in offsets:
        out |= shift(mask, o)
    return out


def erode(mask, offsets):
    out = np.ones_like(mask)
    for o in offsets:
        out &= shift(mask, o)
    return out


def label(mask, connectivity):
    out = np.zeros(mask.shape, int)
    steps = reach(connectivity, mask.ndim)
    n = 0
    for start in zip(*np.nonzero(mask)):
        if out[start]:
            continue
        n += 1
        out[start] = n
        todo = [start]
        while todo:
            p = todo.pop()
            for o in steps:
                q = tuple(a + b for a, b in zip(p, o))
                if all(0 <= v < s for v, s in zip(q, mask.shape)) and mask[q] and not out[q]:
                    out[q] = n
                    todo.append(q)
    return out, n


def enclosed(mask):
    """Background parts that touch no face, as (mask of them, count)."""
    lab, n = label(~mask, 4 if mask.ndim == 2 else 6)
    faces = set()
    for axis in range(mask.ndim):
        for end in (0, -1):
            faces |= set(np.unique(np.take(lab, end, axis)))
    inner = [i for i in range(1, n + 1) if i not in faces]
    return np.isin(lab, inner), len(inner)


def fill(mask):
    return mask | enclosed(mask)[0]


def distance2(mask):
    gaps = np.argwhere(~mask)
    return {tuple(p): int(((gaps - p) ** 2).sum(1).min()) for p in np.argwhere(mask)}


def plug(mask, rounds=5):
    mask = mask.copy()
    if min(mask.shape) < 2:
        return mask
    corners = list(product((0, 1), repeat=3))
    for _ in range(rounds):
        add = set()
        for base in product(*[range(n - 1) for n in mask.shape]):
            at = [tuple(a + b for a, b in zip(base, c)) for c in corners]
            for axis, side in product(range(3), (0, 1)):
                square = [i for i, c in enumerate(corners) if c[axis] == side]
                a, b, c, d = square  # a and d lie across from each other
                for on, off in (((a, d), (b, c)), ((b, c), (a, d))):
                    if all(mask[at[i]] for i in on) and not any(mask[at[i]] for i in off):
                        add.add(at[min(off)])
        if not add:
            break
        for p in add:
            mask[p] = True
    return mask


def interpolate(at, known, values):
    lo = max(k for k in known if k < at)
    hi = min(k for k in known if k > at)
    slope = (values[hi] - values[lo]) / (hi - lo)
    return float(np.float32(slope * (at - lo) + values[lo])), min(at - lo, hi - at)


def patch(crop):
    """Fill the projected gaps of one component."""
    areas = [crop.any(axis=a).sum() for a in range(3)]
    axis = int(np.argmax(areas))
    v = np.moveaxis(crop, axis, 0).copy()
    foot = v.any(axis=0)
    gaps = enclosed(foot)[0]
    if not gaps.any():
        return crop
    before = enclosed(crop)[1]
    height, thick = {}, {}
    for r, c in zip(*np.nonzero(foot)):
        depths = np.nonzero(v[:, r, c])[0]
        height[r, c] = float(np.float32(depths.sum() / len(depths)))
        thick[r, c] = float(len(depths))
    for r, c in zip(*np.nonzero(gaps)):
        mixed = []
        row = [k for k in range(foot.shape[1]) if foot[r, k]]
        column = [k for k in range(foot.shape[0]) if foot[k, c]]
        for field in (height, thick):
            a, da = interpolate(c, row, {k: field[r, k] for k in row})
            b, db = interpolate(r, column, {k: field[k, c] for k in column})
            mixed.append((a * (1 / da) + b * (1 / db)) / (1 / da + 1 / db))
        center, half = round(mixed[0]), max(0, round(mixed[1] / 2))
        v[max(0, center - half) : min(v.shape[0] - 1, center + half) + 1, r, c] = True
    out = np.moveaxis(v, 0, axis)
    return crop if enclosed(out)[1] > before else out


def clean(mask, min_size, radius, connectivity=26):
    """Mask after each stage."""
    out = {"raw": mask}
    lab, n = label(mask, connectivity)
    big = [i for i in range(1, n + 1) if (lab == i).sum() >= min_size]
    out["remove_small"] = np.isin(lab, big)
    for name in ("closing", "patch", "plug"):
        out[name] = np.zeros_like(mask)
    for i in big:
        p = np.argwhere(lab == i)
        lo = np.maximum(p.min(0) - radius, 0)
        hi = np.minimum(p.max(0) + radius + 1, mask.shape)
        window = tuple(slice(a, b) for a, b in zip(lo, hi))
        crop = (lab == i)[window]
        if radius:
            crop = erode(dilate(crop, ball(radius)), ball(radius))
        out["closing"][window] |= crop
        crop = patch(crop) if crop.any() else crop
        out["patch"][window] |= crop
        crop = plug(crop)
        out["plug"][window] |= crop
    out["fill"] = fill(out["plug"])
    return out


def rows(mask, name="v0"):
    return [(name, int(z), int(y), int(x)) for z, y, x in zip(*np.nonzero(mask))]


SCHEMA = "volume_id STRING, z INT, y INT, x INT"


def frame(spark, **masks):
    data = [r for name, m in masks.items() for r in rows(m, name)]
    return spark.createDataFrame(data, SCHEMA)


def volumes(spark, **masks):
    data = [(name, "s0", *map(int, m.shape), "uint8") for name, m in masks.items()]
    return spark.createDataFrame(data, "volume_id STRING, scroll_id STRING, d INT, h INT, w INT, dtype STRING")


def array(df, shape, name="v0"):
    out = np.zeros(shape, bool)
    got = [(r.z, r.y, r.x) for r in df.filter(f"volume_id = '{name}'").select("z", "y", "x").collect()]
    assert len(got) == len(set(got)), "duplicate voxels"
    for p in got:
        out[p] = True
    return out
