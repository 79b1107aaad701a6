"""Component, cleanup, cutting, bridging and case score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina import session
from lamina.functions.stencils import cross_spans
from lamina.model import BridgeSettings, CleanupSettings, UnmergeSettings
from lamina.operators import bridge, cleanup, gaps, report, score, splits, unmerge
from lamina.operators import components as C
from lamina.operators import packed as P
from lamina.operators.edits import gated_run
from lamina.plans import fixtures as X
from lamina.plans.registry import query
from lamina.plans.scoring import (
    DICE_SQL,
    MASKS,
    VOI_SQL,
    betti_sql,
    dilate_sql,
    erode_sql,
    holes_sql,
    scored_masks,
)
from lamina.sources import catalog as G
from lamina.sources import scores as S
from lamina.streaming.incremental import announce, score_incrementally

PART = ["volume_id", "component"]
XYZ = "volume_id, z, y, x"
TRUTH_CC = f"""{MASKS}, {X.component_sql('cc', 'truth', 26)},
part AS MATERIALIZED (SELECT volume_id, lab AS component, z, y, x FROM cc JOIN cc_f USING (volume_id, id)),
size AS MATERIALIZED (SELECT volume_id, component, count(*) AS size FROM part GROUP BY 1, 2)"""


def _runs(spark, folder, connectivity=26):
    return C.component_runs(X.truth(spark, folder), X.volumes(spark, folder), connectivity)


@query(
    "component_stats",
    f"""{TRUTH_CC} SELECT volume_id, CAST(component AS BIGINT) AS component, count(*) AS size, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1,
min(x) AS x0, max(x) AS x1 FROM part GROUP BY 1, 2""",
)
def component_stats(spark, folder):
    return C.component_stats(_runs(spark, folder))


@query(
    "remove_small_components",
    f"""{MASKS}, {X.component_sql('cc', 'truth', 18)} SELECT {XYZ} FROM cc JOIN cc_f USING (volume_id, id)
SEMI JOIN (SELECT volume_id, lab FROM cc GROUP BY 1, 2 HAVING count(*) >= 20) USING (volume_id, lab)""",
)
def remove_small(spark, folder):
    return C.remove_small_components(X.truth(spark, folder), X.volumes(spark, folder), 20, 18)


_BIG = f"""{TRUTH_CC}, big AS MATERIALIZED (SELECT part.* FROM part SEMI JOIN (FROM size WHERE size >= 5) USING (volume_id, component))"""
_CLOSED = f"{_BIG}, {dilate_sql('wide', 'big', 2, 'volume_id, component')}, {erode_sql('shut', 'wide', 2, 'volume_id, component')}"


@query("closing", f"{_CLOSED} SELECT DISTINCT {XYZ} FROM shut")
def closing(spark, folder):
    settings = CleanupSettings(min_size=5, closing_radius=2)
    return cleanup.cleanup_chain(X.truth(spark, folder), X.volumes(spark, folder), settings, "closing")


@query("fill_holes", f"{MASKS}, {holes_sql('h', 'guess')} SELECT * FROM guess UNION ALL SELECT {XYZ} FROM h")
def fill_holes(spark, folder):
    return C.fill_holes(X.predicted(spark, folder), C.bounds(X.volumes(spark, folder)))


@query(
    "count_internal_holes",
    f"""{MASKS}, {holes_sql('h', 'guess')} SELECT volume_id, (SELECT count(DISTINCT lab) FROM h WHERE h.volume_id = v.volume_id) AS n_holes FROM volumes v""",
)
def count_holes(spark, folder):
    return C.count_internal_holes(X.predicted(spark, folder), C.bounds(X.volumes(spark, folder)))


# --- seeds -------------------------------------------------------------------------------------------
_SEEDS = "intensity > 70000"
_NEAREST = f"""{TRUTH_CC}, seed AS (SELECT part.volume_id, component, part.z, part.y, part.x, (part.z + part.y) % 3 AS s
  FROM part JOIN vox USING (volume_id, z, y, x) WHERE {_SEEDS}),
near AS MATERIALIZED (SELECT p.volume_id, p.component, p.z, p.y, p.x, CAST(arg_min(s, ((p.z-q.z)*(p.z-q.z) + (p.y-q.y)*(p.y-q.y) + (p.x-q.x)*(p.x-q.x)) * 10 + s) AS BIGINT) AS seed
  FROM part p JOIN seed q USING (volume_id, component) GROUP BY 1, 2, 3, 4, 5)"""


def _partition(spark, folder):
    parts = C.from_runs(_runs(spark, folder), keys=PART)
    marked = parts.join(X.voxels(spark, folder).filter(_SEEDS).select("volume_id", "z", "y", "x"), ["volume_id", "z", "y", "x"], "left_semi")
    seeds = marked.withColumn("seed", ((F.col("z") + F.col("y")) % 3).cast("long"))
    return unmerge.nearest_seed_partition(parts, seeds)


@query("nearest_seed_partition", f"{_NEAREST} SELECT volume_id, CAST(component AS BIGINT) AS component, z, y, x, seed FROM near", derive_once=True)
def nearest_seed_partition(spark, folder):
    return _partition(spark, folder)


@query(
    "partition_boundary",
    f"""{_NEAREST}, edge AS (SELECT DISTINCT a.volume_id, a.component, a.z, a.y, a.x FROM near a JOIN near b USING (volume_id, component)
  WHERE a.seed <> b.seed AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1), {dilate_sql('wide', 'edge', 1, 'volume_id, component')}
SELECT volume_id, CAST(component AS BIGINT) AS component, z, y, x FROM wide""",
    derive_once=True,
)
def partition_boundary(spark, folder):
    return unmerge.partition_boundary(_partition(spark, folder), X.volumes(spark, folder), 2)


_CUTS = f"""{MASKS}, {dilate_sql('grown', 'truth', 1)}, {X.component_sql('cc', 'grown', 26)},
part AS MATERIALIZED (SELECT volume_id, lab AS component, z, y, x, id FROM cc JOIN cc_f USING (volume_id, id)),
{erode_sql('core', 'grown', 1)}, {X.component_sql('sc', 'core', 26)},
blob AS MATERIALIZED (SELECT volume_id, component, id, s.lab AS seed, z, y, x FROM sc s JOIN part USING (volume_id, id)
  SEMI JOIN (SELECT volume_id, lab FROM sc GROUP BY 1, 2 HAVING count(*) >= 4) k ON k.volume_id = s.volume_id AND k.lab = s.lab),
info AS MATERIALIZED (SELECT volume_id, component, count(*) AS voxel_count, CAST(dense_rank() OVER (PARTITION BY volume_id ORDER BY component) AS INT) AS component_no,
  (SELECT count(DISTINCT seed) FROM blob b WHERE b.volume_id = part.volume_id AND b.component = part.component) AS n_seeds FROM part GROUP BY volume_id, component),
near AS MATERIALIZED (SELECT p.volume_id, p.component, p.z, p.y, p.x, arg_min(seed, ((p.z-q.z)*(p.z-q.z) + (p.y-q.y)*(p.y-q.y) + (p.x-q.x)*(p.x-q.x)) * 100000 + seed) AS seed
  FROM part p SEMI JOIN (FROM info WHERE n_seeds >= 2) USING (volume_id, component) JOIN blob q USING (volume_id, component) GROUP BY 1, 2, 3, 4, 5),
edge AS MATERIALIZED (SELECT DISTINCT a.volume_id, a.z, a.y, a.x FROM near a, (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(dz,dy,dx), near b
  WHERE b.volume_id = a.volume_id AND b.component = a.component AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND a.seed <> b.seed),
cut AS MATERIALIZED (SELECT {XYZ} FROM near ANTI JOIN edge USING (volume_id, z, y, x)), {X.component_sql('pc', 'cut', 26)},
piece AS MATERIALIZED (SELECT volume_id, component, pc.lab, count(*) AS n FROM pc JOIN part USING (volume_id, id) GROUP BY 1, 2, 3)"""
_CUT = UnmergeSettings(min_seed_size=4, min_piece_size=6)


def _cuts(spark, folder):
    volumes = X.volumes(spark, folder)
    grown = P.dilate(X.truth(spark, folder), volumes, cross_spans())
    return unmerge.propose_cuts(grown, volumes, _CUT)


@query(
    "propose_cuts",
    f"""{_CUTS} SELECT {XYZ} FROM part ANTI JOIN (FROM info WHERE n_seeds >= 2) USING (volume_id, component)
UNION ALL SELECT {XYZ} FROM pc JOIN part USING (volume_id, id) JOIN (FROM piece WHERE n >= 6) k USING (volume_id, component) WHERE k.lab = pc.lab""",
)
def propose_cuts(spark, folder):
    return _cuts(spark, folder)[0]


@query(
    "cut_diagnostics",
    f"""{_CUTS} SELECT volume_id, CAST(component AS BIGINT) AS component, component_no, voxel_count, n_seeds >= 2 AS cut, n_seeds, CASE WHEN n_seeds >= 2 THEN 'cut_into_' ||
(SELECT count(*) FROM piece p WHERE p.volume_id = info.volume_id AND p.component = info.component) || '_pieces' ELSE 'not_candidate' END AS reason FROM info""",
)
def cut_diagnostics(spark, folder):
    return _cuts(spark, folder)[1]


# --- bridges -----------------------------------------------------------------------------------------
_PAIRS = """pair AS MATERIALIZED (SELECT volume_id, a.component AS component_a, b.component AS component_b, min(({d2}, a.z, a.y, a.x, b.z, b.y, b.x)) AS p
  FROM {points} a JOIN {points} b USING (volume_id) WHERE a.component < b.component AND abs(a.z - b.z) < {gap} AND abs(a.y - b.y) < {gap} AND abs(a.x - b.x) < {gap}
  AND {d2} < {gap} * {gap} GROUP BY 1, 2, 3),
pairs AS MATERIALIZED (SELECT volume_id, component_a, component_b, sqrt(p[1]) AS distance, p[2] AS a_z, p[3] AS a_y, p[4] AS a_x, p[5] AS b_z, p[6] AS b_y, p[7] AS b_x FROM pair)"""
_D2 = "(a.z-b.z)*(a.z-b.z) + (a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)"


def _pairs_sql(points: str, gap: int) -> str:
    return _PAIRS.format(points=points, gap=gap, d2=_D2)


_PAIR_COLUMNS = "volume_id, CAST(component_a AS BIGINT) AS component_a, CAST(component_b AS BIGINT) AS component_b, round(distance, 6) AS distance, a_z, a_y, a_x, b_z, b_y, b_x"


@query("nearest_pairs_within", f"{TRUTH_CC}, {_pairs_sql('part', 4)} SELECT {_PAIR_COLUMNS} FROM pairs")
def nearest_pairs(spark, folder):
    points = C.from_runs(_runs(spark, folder), keys=PART)
    return bridge.nearest_pairs_within(points, 4.0).withColumn("distance", F.round("distance", 6))


def _tangent_sql(name: str, points: str, radius: int) -> str:
    return f"""{name}_m AS (SELECT a.volume_id, a.component, a.z, a.y, a.x, count(*) AS n, a.z - avg(b.z) AS dz, a.y - avg(b.y) AS dy, a.x - avg(b.x) AS dx
  FROM {points} a JOIN part b USING (volume_id, component) WHERE {_D2} <= {radius * radius} GROUP BY 1, 2, 3, 4, 5),
{name} AS MATERIALIZED (SELECT volume_id, component, z, y, x, {', '.join(f'CASE WHEN n >= 4 AND sqrt(dz*dz + dy*dy + dx*dx) >= 1e-6 THEN d{c} / sqrt(dz*dz + dy*dy + dx*dx) END AS t{c}' for c in 'zyx')} FROM {name}_m)"""


@query(
    "local_tangent",
    f"""{TRUTH_CC}, {_tangent_sql('t', 'part', 3)}
SELECT volume_id, CAST(component AS BIGINT) AS component, z, y, x, round(tz, 6) AS tz, round(ty, 6) AS ty, round(tx, 6) AS tx FROM t""",
)
def local_tangent(spark, folder):
    parts = C.from_runs(_runs(spark, folder), keys=PART)
    out = bridge.local_tangent(parts, parts, 3.0)
    return out.select(*PART, "z", "y", "x", *[F.round(c, 6).alias(c) for c in ("tz", "ty", "tx")])


def _line_sql(name: str, source: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT volume_id, CAST(round_even(i * ((b_z - a_z)::DOUBLE / greatest(n, 1)) + a_z, 0) AS INT) AS z,
  CAST(round_even(i * ((b_y - a_y)::DOUBLE / greatest(n, 1)) + a_y, 0) AS INT) AS y, CAST(round_even(i * ((b_x - a_x)::DOUBLE / greatest(n, 1)) + a_x, 0) AS INT) AS x
  FROM (SELECT *, UNNEST(range(n + 1)) AS i FROM (SELECT *, greatest(abs(b_z - a_z), abs(b_y - a_y), abs(b_x - a_x)) AS n FROM {source})))"""


_SEGMENTS = "volume_id, z AS a_z, y AS a_y, x AS a_x, (z * 5 + 3) % 24 AS b_z, (y * 7 + 1) % 24 AS b_y, (x * 11 + 2) % 24 AS b_x"


@query(
    "rasterize_segments",
    f"""{MASKS}, seg AS (SELECT {_SEGMENTS} FROM vox WHERE label = 1), {_line_sql('line', 'seg')}, {dilate_sql('tube', 'line', 1)} SELECT * FROM tube""",
)
def rasterize(spark, folder):
    segments = X.voxels(spark, folder).filter("label = 1").selectExpr(*_SEGMENTS.split(", "))
    return bridge.rasterize_segments(segments, X.volumes(spark, folder), 1)


_BRIDGE = BridgeSettings(max_gap=4, angle_tolerance=60, min_size=4, tangent_radius=3, tube_radius=0)
_CANDIDATES = f"""{TRUTH_CC}, large AS (SELECT part.* FROM part SEMI JOIN (FROM size WHERE size >= 4) USING (volume_id, component)),
{erode_sql('lcore', 'large', 1, 'volume_id, component')}, rim AS MATERIALIZED (FROM large ANTI JOIN lcore USING (volume_id, component, z, y, x)), {_pairs_sql('rim', 4)},
ends AS (SELECT DISTINCT volume_id, component_a AS component, a_z AS z, a_y AS y, a_x AS x FROM pairs UNION SELECT volume_id, component_b, b_z, b_y, b_x FROM pairs), {_tangent_sql('t', 'ends', 3)},
ang AS MATERIALIZED (SELECT p.*, degrees(acos(greatest(-1, least(1, (a.tz * (b_z-a_z) + a.ty * (b_y-a_y) + a.tx * (b_x-a_x)) / distance)))) AS angle_a,
  degrees(acos(greatest(-1, least(1, -(b.tz * (b_z-a_z) + b.ty * (b_y-a_y) + b.tx * (b_x-a_x)) / distance)))) AS angle_b FROM pairs p
  JOIN t a ON a.volume_id = p.volume_id AND a.component = component_a AND a.z = a_z AND a.y = a_y AND a.x = a_x
  JOIN t b ON b.volume_id = p.volume_id AND b.component = component_b AND b.z = b_z AND b.y = b_y AND b.x = b_x),
good AS MATERIALIZED (FROM ang WHERE angle_a <= 60 AND angle_b <= 60)"""


@query("bridge_candidates", f"{_CANDIDATES} SELECT {_PAIR_COLUMNS}, round(angle_a, 4) AS angle_a, round(angle_b, 4) AS angle_b FROM good")
def bridge_candidates(spark, folder):
    out = bridge.bridge_candidates(_runs(spark, folder), _BRIDGE)
    for c, n in (("distance", 6), ("angle_a", 4), ("angle_b", 4)):
        out = out.withColumn(c, F.round(c, n))
    return out


@query("propose_bridges", f"{_CANDIDATES}, {_line_sql('line', 'good')} SELECT * FROM truth UNION SELECT * FROM line")
def propose_bridges(spark, folder):
    return bridge.propose_bridges(X.truth(spark, folder), X.volumes(spark, folder), _BRIDGE)[0]


# --- cleanup -----------------------------------------------------------------------------------------
# Square across two axes p < q: a diagonal from a to b, the corner to add and the other clear corner.
_AXES = {"z": (1, 0, 0), "y": (0, 1, 0), "x": (0, 0, 1)}


def _pinches() -> str:
    out = []
    for p, q in (("z", "y"), ("z", "x"), ("y", "x")):
        P_, Q = _AXES[p], _AXES[q]
        mix = lambda i, j: tuple(i * u + j * v for u, v in zip(P_, Q))
        out.append((*mix(1, 1), *mix(0, 1), *mix(1, 0)))
        out.append((*mix(1, -1), *mix(0, -1), *mix(1, 0)))
    return "(VALUES " + ", ".join(map(str, out)) + ") o(b_z, b_y, b_x, gz, gy, gx, oz, oy, ox)"


def plug_sql(name: str, source: str, keys: str, rounds: int = 5) -> str:
    steps, last = [], source
    names = [k.strip() for k in keys.split(",")]
    on = lambda t, p: " AND ".join([f"{t}.{k} = a.{k}" for k in names] + [f"{t}.{c} = a.{c} + {p}{'_' if p == 'b' else ''}{c}" for c in "zyx"])
    for i in range(rounds):
        here = name if i == rounds - 1 else f"{name}_{i}"
        steps.append(f"""{here} AS MATERIALIZED (SELECT {keys}, z, y, x FROM {last} UNION SELECT {', '.join('a.' + k for k in names)}, a.z + gz, a.y + gy, a.x + gx
  FROM {last} a CROSS JOIN {_pinches()} JOIN {last} b ON {on('b', 'b')} ANTI JOIN {last} g ON {on('g', 'g')} ANTI JOIN {last} h ON {on('h', 'o')})""")
        last = here
    return ", ".join(steps)


@query("plug_holes", f"{MASKS}, {plug_sql('plug', 'truth', 'volume_id')} SELECT * FROM plug")
def plug_holes(spark, folder):
    return cleanup.plug_holes(X.truth(spark, folder), C.bounds(X.volumes(spark, folder)))


_CHAIN = CleanupSettings(min_size=5, closing_radius=1, patching=False)


@query(
    "cleanup_chain_unpatched",
    f"""{_BIG}, {dilate_sql('wide', 'big', 1, 'volume_id, component')}, {erode_sql('shut', 'wide', 1, 'volume_id, component')},
{plug_sql('plug', 'shut', 'volume_id, component')}, whole AS MATERIALIZED (SELECT DISTINCT {XYZ} FROM plug), {holes_sql('h', 'whole')}
SELECT * FROM whole UNION ALL SELECT {XYZ} FROM h""",
)
def cleanup_unpatched(spark, folder):
    return cleanup.cleanup_chain(X.truth(spark, folder), X.volumes(spark, folder), _CHAIN)


def patch_sql(name: str, parts: str, sizes: str, pad: int) -> str:
    """CTEs that patch ``parts(volume_id, component, z, y, x)`` as ``name``, in frames around the voxels of ``sizes``."""
    n = name
    side = X.SIDE - 1
    by_axis = lambda a, b, c: f"CASE axis WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"
    # The nearest filled cells before and after a gap cell along ``along``, on the same ``line``.
    ends = lambda along, line, tag: f"""{n}_{tag} AS MATERIALIZED (SELECT g.volume_id, g.component, g.r, g.c, max(b.{along}) FILTER (b.{along} < g.{along}) AS a,
  min(b.{along}) FILTER (b.{along} > g.{along}) AS b FROM {n}_gap g JOIN {n}_hm b ON b.volume_id = g.volume_id AND b.component = g.component AND b.{line} = g.{line} GROUP BY 1, 2, 3, 4)"""  # noqa: E731
    mixed = lambda along, line, tag: f"""{n}_{tag}v AS MATERIALIZED (SELECT e.volume_id, e.component, e.r, e.c,
  CAST(CAST((q.height - p.height) / (e.b - e.a) * (e.{along} - e.a) + p.height AS FLOAT) AS DOUBLE) AS h,
  CAST(CAST((q.thick - p.thick) / (e.b - e.a) * (e.{along} - e.a) + p.thick AS FLOAT) AS DOUBLE) AS t,
  CAST(1 AS DOUBLE) / least(e.{along} - e.a, e.b - e.{along}) AS w FROM {n}_{tag} e
  JOIN {n}_hm p ON p.volume_id = e.volume_id AND p.component = e.component AND p.{line} = e.{line} AND p.{along} = e.a
  JOIN {n}_hm q ON q.volume_id = e.volume_id AND q.component = e.component AND q.{line} = e.{line} AND q.{along} = e.b)"""  # noqa: E731
    return f"""{n}_fr AS MATERIALIZED (SELECT volume_id, component, greatest(0, min(z) - {pad}) AS z0, least({side}, max(z) + {pad}) AS z1, greatest(0, min(y) - {pad}) AS y0,
  least({side}, max(y) + {pad}) AS y1, greatest(0, min(x) - {pad}) AS x0, least({side}, max(x) + {pad}) AS x1 FROM {sizes} GROUP BY 1, 2),
{n}_in AS MATERIALIZED (SELECT * FROM {parts} JOIN {n}_fr USING (volume_id, component)),
{n}_all AS MATERIALIZED (SELECT volume_id, component, axis, r, c, count(*) AS n, sum(depth) AS total FROM (
  SELECT volume_id, component, 0 AS axis, z - z0 AS depth, y AS r, x AS c FROM {n}_in UNION ALL SELECT volume_id, component, 1, y - y0, z, x FROM {n}_in
  UNION ALL SELECT volume_id, component, 2, x - x0, z, y FROM {n}_in) GROUP BY ALL),
{n}_ax AS MATERIALIZED (SELECT volume_id, component, arg_max(axis, area * 3 - axis) AS axis FROM (SELECT volume_id, component, axis, count(*) AS area FROM {n}_all GROUP BY ALL) GROUP BY 1, 2),
{n}_hm AS MATERIALIZED (SELECT volume_id, component, axis, r, c, CAST(CAST(CAST(total AS DOUBLE) / n AS FLOAT) AS DOUBLE) AS height, CAST(n AS DOUBLE) AS thick
  FROM {n}_all JOIN {n}_ax USING (volume_id, component, axis)),
{n}_pl AS MATERIALIZED (SELECT volume_id, component, axis, {by_axis('z0', 'y0', 'x0')} AS base, {by_axis('z1 - z0', 'y1 - y0', 'x1 - x0')} AS last,
  {by_axis('y0', 'z0', 'z0')} AS r0, {by_axis('y1', 'z1', 'z1')} AS r1, {by_axis('x0', 'x0', 'y0')} AS c0, {by_axis('x1', 'x1', 'y1')} AS c1 FROM {n}_ax JOIN {n}_fr USING (volume_id, component)),
{n}_void AS MATERIALIZED (SELECT * FROM (SELECT volume_id, component, r, UNNEST(range(c0, c1 + 1)) AS c, r0, r1, c0, c1 FROM (SELECT *, UNNEST(range(r0, r1 + 1)) AS r FROM {n}_pl)) v
  ANTI JOIN {n}_hm USING (volume_id, component, r, c)),
{n}_out(volume_id, component, r, c) AS (SELECT volume_id, component, r, c FROM {n}_void WHERE r IN (r0, r1) OR c IN (c0, c1)
  UNION SELECT v.volume_id, v.component, v.r, v.c FROM {n}_out o JOIN {n}_void v ON v.volume_id = o.volume_id AND v.component = o.component AND abs(v.r - o.r) + abs(v.c - o.c) = 1),
{n}_gap AS MATERIALIZED (SELECT volume_id, component, r, c FROM {n}_void ANTI JOIN {n}_out USING (volume_id, component, r, c)),
{ends('c', 'r', 'row')}, {ends('r', 'c', 'col')}, {mixed('c', 'r', 'row')}, {mixed('r', 'c', 'col')},
{n}_at AS MATERIALIZED (SELECT volume_id, component, axis, r, c, base, last, round_even((a.h * a.w + b.h * b.w) / (a.w + b.w), 0) AS mid,
  greatest(0, round_even((a.t * a.w + b.t * b.w) / (a.w + b.w) / 2, 0)) AS half FROM {n}_rowv a JOIN {n}_colv b USING (volume_id, component, r, c) JOIN {n}_pl USING (volume_id, component)),
{n}_new AS MATERIALIZED (SELECT volume_id, component, CAST({by_axis('d', 'r', 'r')} AS INT) AS z, CAST({by_axis('r', 'd', 'c')} AS INT) AS y, CAST({by_axis('c', 'c', 'd')} AS INT) AS x
  FROM (SELECT *, base + UNNEST(range(CAST(greatest(0, mid - half) AS INT), CAST(least(last, mid + half) AS INT) + 1)) AS d FROM {n}_at)),
{n}_both AS MATERIALIZED (SELECT volume_id, component, 0 AS v, z, y, x FROM {n}_in SEMI JOIN {n}_new USING (volume_id, component)
  UNION SELECT volume_id, component, 1, z, y, x FROM {n}_in SEMI JOIN {n}_new USING (volume_id, component) UNION SELECT volume_id, component, 1, z, y, x FROM {n}_new),
{n}_air AS MATERIALIZED (SELECT * FROM (SELECT volume_id, component, v, z0, z1, y0, y1, x0, x1, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(UNNEST(range(x0, x1 + 1)) AS INT) AS x FROM (SELECT *, UNNEST(range(y0, y1 + 1)) AS y FROM (
  SELECT *, UNNEST(range(z0, z1 + 1)) AS z FROM {n}_fr SEMI JOIN {n}_new USING (volume_id, component) CROSS JOIN (VALUES (0), (1)) k(v)))) a ANTI JOIN {n}_both USING (volume_id, component, v, z, y, x)),
{n}_open(volume_id, component, v, z, y, x) AS (SELECT volume_id, component, v, z, y, x FROM {n}_air WHERE z IN (z0, z1) OR y IN (y0, y1) OR x IN (x0, x1)
  UNION SELECT a.volume_id, a.component, a.v, a.z, a.y, a.x FROM {n}_open o JOIN (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(dz,dy,dx) ON true
  JOIN {n}_air a ON a.volume_id = o.volume_id AND a.component = o.component AND a.v = o.v AND a.z = o.z + dz AND a.y = o.y + dy AND a.x = o.x + dx),
{n}_shut AS MATERIALIZED (SELECT volume_id || ':' || component || ':' || v AS volume_id, z, y, x FROM {n}_air ANTI JOIN {n}_open USING (volume_id, component, v, z, y, x)),
{X.component_sql(n + '_cc', n + '_shut', 6)},
{n}_count AS MATERIALIZED (SELECT split_part(volume_id, ':', 1) AS volume_id, CAST(split_part(volume_id, ':', 2) AS BIGINT) AS component, split_part(volume_id, ':', 3) AS v, count(DISTINCT lab) AS n FROM {n}_cc GROUP BY ALL),
{n}_bad AS (SELECT DISTINCT volume_id, component FROM {n}_count a WHERE v = '1' AND a.n > coalesce((SELECT b.n FROM {n}_count b WHERE b.volume_id = a.volume_id AND b.component = a.component AND b.v = '0'), 0)),
{n} AS MATERIALIZED (SELECT volume_id, component, z, y, x FROM {n}_in UNION SELECT volume_id, component, z, y, x FROM {n}_new ANTI JOIN {n}_bad USING (volume_id, component))"""


_LARGE = f"""{MASKS}, {X.component_sql('cc', 'truth', 18)}, part AS MATERIALIZED (SELECT volume_id, lab AS component, z, y, x FROM cc JOIN cc_f USING (volume_id, id)
  SEMI JOIN (SELECT volume_id, lab FROM cc GROUP BY 1, 2 HAVING count(*) >= 20) USING (volume_id, lab))"""


@query(
    "height_map_patch",
    f"{_LARGE}, {patch_sql('pt', 'part', 'part', 1)} SELECT volume_id, CAST(component AS BIGINT) AS component, z, y, x FROM pt",
    derive_once=True,
)
def height_map_patch(spark, folder):
    volumes = X.volumes(spark, folder)
    runs = session.settle(C.large_runs(_runs(spark, folder, 18), 20))
    return gaps.patch_gaps(C.from_runs(runs, keys=PART), cleanup.component_frames(runs, volumes, 1))


_STAGES = f"""{_LARGE}, {dilate_sql('wide', 'part', 1, 'volume_id, component')}, {erode_sql('shut', 'wide', 1, 'volume_id, component')},
{patch_sql('pt', 'shut', 'part', 1)}, {plug_sql('plug', 'pt', 'volume_id, component')}, whole AS MATERIALIZED (SELECT DISTINCT {XYZ} FROM plug), {holes_sql('h', 'whole')}"""
_STAGED = CleanupSettings(min_size=20, closing_radius=1, connectivity=18)


@query(
    "run_stages",
    f"""{_STAGES} SELECT 'raw' AS stage, {XYZ} FROM truth UNION ALL SELECT 'remove_small', {XYZ} FROM part UNION ALL SELECT DISTINCT 'closing', {XYZ} FROM shut
UNION ALL SELECT DISTINCT 'patch', {XYZ} FROM pt UNION ALL SELECT 'plug', {XYZ} FROM whole UNION ALL SELECT 'fill', {XYZ} FROM whole UNION ALL SELECT 'fill', {XYZ} FROM h""",
    derive_once=True,
)
def run_stages(spark, folder):
    stages = cleanup.run_stages(X.truth(spark, folder), X.volumes(spark, folder), _STAGED)
    return cleanup.stage_table(stages)


@query("cleanup_chain", f"{_STAGES} SELECT * FROM whole UNION ALL SELECT {XYZ} FROM h", derive_once=True)
def cleanup_chain(spark, folder):
    """The whole chain from a label map: binarised first, patched, plugged and filled."""
    labels = X.voxels(spark, folder).select("volume_id", "z", "y", "x", "label")
    return cleanup.cleanup_chain(labels, X.volumes(spark, folder), _STAGED)


# --- case scores -----------------------------------------------------------------------------------------
_F1 = ", ".join(f"CASE WHEN p.b{k} + t.b{k} > 0 THEN 2.0::DOUBLE * least(p.b{k}, t.b{k}) / (p.b{k} + t.b{k}) END AS topo_f1_dim{k}" for k in range(3))
_WEIGHTED = " + ".join(f"coalesce(topo_f1_dim{k} * {w}::DOUBLE, 0)" for k, w in enumerate((0.34, 0.33, 0.33)))
_ACTIVE = " + ".join(f"CASE WHEN topo_f1_dim{k} IS NULL THEN 0 ELSE {w}::DOUBLE END" for k, w in enumerate((0.34, 0.33, 0.33)))
_TOPO = f"""{betti_sql('bp', 'pred')}, {betti_sql('bt', 'truth')}, f1 AS (SELECT p.volume_id, {_F1} FROM bp p JOIN bt t USING (volume_id)),
topo AS MATERIALIZED (SELECT *, CASE WHEN {_ACTIVE} = 0 THEN 1 ELSE ({_WEIGHTED}) / ({_ACTIVE}) END AS topo_score FROM f1)"""
_PARTS = ["topo_score", "surface_dice", "voi_score", "voi_split", "voi_merge", "topo_f1_dim0", "topo_f1_dim1", "topo_f1_dim2"]
_CASE = f"""{MASKS}, {DICE_SQL}, {VOI_SQL}, {_TOPO}, case_scores AS MATERIALIZED (SELECT volume_id,
 round(0.3::DOUBLE * topo_score + 0.35::DOUBLE * surface_dice + 0.35::DOUBLE * voi_score, 6) AS score, {', '.join(f'round({p}, 6) AS {p}' for p in _PARTS)}, n_foreground
 FROM dice JOIN voi USING (volume_id) JOIN topo USING (volume_id))"""


@query("topo_score", f"{MASKS}, {_TOPO} SELECT volume_id, {', '.join(f'round({c}, 6) AS {c}' for c in _PARTS if 'topo' in c)} FROM topo", derive_once=True)
def topo_score(spark, folder):
    pred, truth = scored_masks(spark, folder)
    volumes = X.volumes(spark, folder)
    out = score.topo_score(score.betti_numbers(pred, volumes), score.betti_numbers(truth, volumes))
    return out.select("volume_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("case_score", f"{_CASE} SELECT * FROM case_scores", derive_once=True)
def case_score(spark, folder):
    return score.case_score(X.predicted(spark, folder), X.voxels(spark, folder), X.volumes(spark, folder))


@query("score_cases", f"{_CASE} SELECT c.*, scroll_id FROM case_scores c JOIN volumes USING (volume_id) WHERE scroll_id <> 's1'", derive_once=True)
def score_cases(spark, folder):
    volumes = X.volumes(spark, folder)
    pairs = S.score_pairs(volumes, volumes, volumes.filter("scroll_id = 's1'"))
    return score.score_cases(X.predicted(spark, folder), X.voxels(spark, folder), volumes, pairs, volumes)


_EMPTY_V0 = _CASE.replace("WHERE prob >= 0.5 AND label <> 2)", "WHERE prob >= 0.5 AND label <> 2 AND volume_id <> 'v0')")


@query("score_incrementally", f"{_EMPTY_V0} SELECT * FROM case_scores", derive_once=True)
def incremental(spark, folder):
    """One volume's prediction is empty; the others land in two parts, the second one with the announcement."""
    base = session.shared_folder(spark, "landing")
    volumes, labels = X.volumes(spark, folder), X.voxels(spark, folder)
    predictions = X.predicted(spark, folder).filter("volume_id <> 'v0'")

    def run():
        score_incrementally(spark, f"{base}/in", f"{base}/manifest", labels, volumes, f"{base}/out", f"{base}/state").awaitTermination()

    early = volumes.filter("scroll_id = 's3'")
    announce(predictions.join(early, "volume_id", "left_semi"), early, f"{base}/manifest")
    for half in ("z < 9", "z >= 9"):
        predictions.filter(half).write.mode("append").parquet(f"{base}/in")
        if half != "z < 9":
            rest = volumes.filter("scroll_id <> 's3'")
            announce(predictions.join(rest, "volume_id", "left_semi"), rest, f"{base}/manifest")
        run()
    run()
    return spark.read.parquet(f"{base}/out")


# --- gated edits from masks to scores ----------------------------------------------------------------------
# Each part is a query of its own inside the outer one, so its names stay its own.
_BASE = MASKS.split(",\npred AS")[0]
_CONTROL = "control AS MATERIALIZED (SELECT volume_id, z, y, x FROM {} WHERE z % 7 <> 3)"
_INNER_CUTS = _CUTS.removeprefix(MASKS).replace(dilate_sql("grown", "truth", 1), "grown AS (FROM control)").removeprefix(", ")
_CUT_MASK = f"""SELECT {XYZ} FROM part ANTI JOIN (FROM info WHERE n_seeds >= 2) USING (volume_id, component)
UNION ALL SELECT {XYZ} FROM pc JOIN part USING (volume_id, id) JOIN (FROM piece WHERE n >= 6) k USING (volume_id, component) WHERE k.lab = pc.lab"""
_CUT_COUNTS = """SELECT volume_id, count(i.component) AS n_components, count(*) FILTER (n_seeds >= 2) AS n_candidates, count(*) FILTER (n_seeds >= 2) AS n_edits
FROM volumes LEFT JOIN info i USING (volume_id) GROUP BY 1"""


def _scored_sql(name: str, source: str) -> str:
    rest = _CASE.removeprefix(MASKS).removeprefix(", ")
    return f"""{name} AS MATERIALIZED (WITH RECURSIVE pred AS MATERIALIZED (SELECT {XYZ} FROM {source} ANTI JOIN (FROM vox WHERE label = 2) USING ({XYZ})), {rest} SELECT * FROM case_scores)"""


def _gated_sql(control: str, inner: str, mask: str, counts: str, metric: str) -> str:
    return f"""{_BASE}, {_CONTROL.format(control)}, proposed AS MATERIALIZED (WITH RECURSIVE {inner} {mask}),
counts AS MATERIALIZED (WITH RECURSIVE {inner} {counts}), {_scored_sql('before', 'control')}, {_scored_sql('after', 'proposed')},
verdict AS MATERIALIZED (SELECT volume_id, n_components, n_candidates, n_edits, n_edits > 0 AND coalesce(a.score >= b.score, FALSE) AS accepted,
 CASE WHEN n_edits > 0 THEN b.score END AS control_score, CASE WHEN n_edits > 0 THEN a.score END AS proposed_score, CASE WHEN n_edits > 0 THEN a.score - b.score END AS score_delta,
 CASE WHEN n_edits > 0 THEN b.{metric} END AS control_{metric}, CASE WHEN n_edits > 0 THEN a.{metric} END AS proposed_{metric},
 CASE WHEN n_edits > 0 THEN a.{metric} - b.{metric} END AS {metric}_delta FROM counts JOIN before b USING (volume_id) JOIN after a USING (volume_id))"""


_ROUNDED = "round(control_score, 6) AS control_score, round(proposed_score, 6) AS proposed_score, round(score_delta, 6) AS score_delta, round(control_{m}, 6) AS control_{m}, round(proposed_{m}, 6) AS proposed_{m}, round({m}_delta, 6) AS {m}_delta"
_UNMERGE_RUN = _gated_sql("guess", _INNER_CUTS, _CUT_MASK, _CUT_COUNTS, "voi_merge")


def _unmerge_run(spark, folder):
    control = X.predicted(spark, folder).filter("z % 7 <> 3")
    return gated_run(control, X.voxels(spark, folder), X.volumes(spark, folder), _CUT)


def _round_all(df, names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


@query("unmerge_run", f"{_UNMERGE_RUN} SELECT volume_id, n_components, n_candidates, n_edits, accepted, {_ROUNDED.format(m='voi_merge')} FROM verdict", derive_once=True)
def unmerge_run(spark, folder):
    out = _unmerge_run(spark, folder).verdicts
    return _round_all(out, [c for c in out.columns if "score" in c or "voi" in c])


@query(
    "gated_masks",
    f"""{_UNMERGE_RUN} SELECT {XYZ} FROM control ANTI JOIN (FROM verdict WHERE accepted) USING (volume_id)
UNION ALL SELECT {XYZ} FROM proposed SEMI JOIN (FROM verdict WHERE accepted) USING (volume_id)""",
    derive_once=True,
)
def gated_masks(spark, folder):
    return _unmerge_run(spark, folder).masks


_INNER_BRIDGES = _CANDIDATES.removeprefix(MASKS).replace(X.component_sql("cc", "truth", 26), X.component_sql("cc", "control", 26)).removeprefix(", ")
_BRIDGE_RUN = _gated_sql(
    "truth", f"{_INNER_BRIDGES}, {_line_sql('line', 'good')}", "SELECT * FROM control UNION SELECT * FROM line",
    """SELECT volume_id, (SELECT count(DISTINCT lab) FROM cc WHERE cc.volume_id = v.volume_id) AS n_components,
(SELECT count(*) FROM good g WHERE g.volume_id = v.volume_id) AS n_candidates, (SELECT count(*) FROM good g WHERE g.volume_id = v.volume_id) AS n_edits FROM volumes v""",
    "voi_split",
)


#: What ``bridge_run`` gives, for small tables: the comparison engine takes minutes for it on larger ones.
BRIDGE_RUN_SQL = f"""{_BRIDGE_RUN}, sides AS (SELECT 'control' AS condition, * FROM before UNION ALL SELECT 'accepted', * FROM before ANTI JOIN (FROM verdict WHERE accepted) USING (volume_id)
UNION ALL SELECT 'accepted', * FROM after SEMI JOIN (FROM verdict WHERE accepted) USING (volume_id)),
g AS (SELECT condition, scroll_id, count(*) AS n, avg(score) AS score, avg(voi_split) AS voi_split FROM sides JOIN volumes USING (volume_id) GROUP BY 1, 2
 UNION ALL SELECT condition, 'ALL', count(*), avg(score), avg(voi_split) FROM sides GROUP BY 1)
SELECT c.scroll_id, c.n, round(c.score, 6) AS control_score, round(a.score, 6) AS accepted_score, round(a.score - c.score, 6) AS score_delta,
round(c.voi_split, 6) AS control_voi_split, round(a.voi_split, 6) AS accepted_voi_split, round(a.voi_split - c.voi_split, 6) AS voi_split_delta
FROM g c JOIN g a ON a.scroll_id = c.scroll_id WHERE c.condition = 'control' AND a.condition = 'accepted'"""


@query("bridge_run", derive_once=True)
def bridge_run(spark, folder):
    """Bridges end to end; the scores of both conditions are appended as case rows, read back and compared by scroll."""
    volumes = X.volumes(spark, folder)
    control = X.truth(spark, folder).filter("z % 7 <> 3")
    run = gated_run(control, X.voxels(spark, folder), volumes, _BRIDGE)
    base = session.shared_folder(spark, "case-scores")
    rows = run.scores.join(volumes.select("volume_id", "scroll_id"), "volume_id")
    sides = []
    for condition in ("control", "accepted"):
        S.append_scores(rows.filter(F.col("condition") == condition).drop("condition"), base, condition)
        sides.append(report.aggregate_by_scroll(S.load_scores_latest(spark, f"{base}/condition={condition}")))
    out = report.delta_table(*sides, "voi_split")
    return _round_all(out, [c for c in out.columns if "score" in c or "voi" in c])


@query("write_masks", f"{MASKS} SELECT 'raw' AS stage, {XYZ} FROM truth UNION ALL SELECT 'pred', {XYZ} FROM guess")
def write_masks(spark, folder):
    path = session.shared_folder(spark, "masks")
    tag = lambda df, s: df.select(F.lit(s).alias("stage"), "volume_id", "z", "y", "x")
    truth = tag(X.truth(spark, folder), "raw")
    G.write_masks(truth, path)
    # The stage that is there already is skipped.
    G.write_masks(truth.unionByName(tag(X.predicted(spark, folder), "pred")), path)
    return spark.read.parquet(path).select("stage", "volume_id", "z", "y", "x")


@query(
    "read_splits",
    f"""WITH {X.CASES_SQL}, v AS (SELECT case_id, dense_rank() OVER (ORDER BY scroll_id) - 1 AS val_fold FROM cases)
SELECT CAST(f.fold AS INT) AS fold, case_id, CASE WHEN f.fold = v.val_fold THEN 'val' ELSE 'train' END AS role, 'file:folds.json' AS source
FROM v CROSS JOIN (SELECT UNNEST(range(25)) AS fold) f""",
)
def read_splits(spark, folder):
    """The folder's name is new in every run, so what follows its unique part is compared."""
    path = session.shared_folder(spark, "splits") + "/folds.json"
    folds = splits.leave_one_group_out(X.cases(spark, folder))
    splits.write_splits(folds, path)
    found = splits.read_splits(spark, path)
    own = F.regexp_replace(F.col("source"), "^file:.*/splits-[0-9a-f]{32}/", "file:")
    return found.select("fold", "case_id", "role", own.alias("source"))
