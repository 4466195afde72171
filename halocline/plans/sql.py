"""DuckDB SQL for the named queries: index maps as stages of common table expressions, numbering by window functions."""

from __future__ import annotations

from ..operators.header import Header


WIDE = 100_000  # more than any row or column of a local grid


def spine(h: Header, name: str = "pts") -> str:
    return f"{name} AS (SELECT r AS n, (r % {h.ni})::INTEGER AS ih, (r // {h.ni})::INTEGER AS jh, (r % {h.ni} - {h.halo_w})::INTEGER AS i, (r // {h.ni} - {h.halo_s})::INTEGER AS j FROM range({h.size}) t(r))"


def fold(src: str, dst: str, h: Header, i: str = "ih", j: str = "jh", mi: str = "mi", mj: str = "mj") -> str:
    """Stages that add the master (halo frame) of (i, j)."""
    lo, hi, nx = h.halo_w, h.halo_w + h.nx, h.nx
    once = lambda c: f"CASE WHEN {c} < {lo} THEN {c} + {nx} WHEN {c} >= {hi} THEN {c} - {nx} ELSE {c} END"
    return f"""
{dst}_a AS (SELECT *, {once(i)} AS w1 FROM {src}),
{dst}_b AS (SELECT *, {j} > {h.pivot_j} OR ({j} = {h.pivot_j} AND w1 > {h.pivot_i}) AS turned FROM {dst}_a),
{dst}_c AS (SELECT *, CASE WHEN turned THEN {int(2 * h.pivot_i)} - w1 ELSE w1 END AS w2 FROM {dst}_b),
{dst} AS (SELECT * EXCLUDE (w1, w2, turned), (CASE WHEN turned THEN {once("w2")} ELSE w2 END)::INTEGER AS {mi},
          (CASE WHEN turned THEN {int(2 * h.pivot_j)} - {j} ELSE {j} END)::INTEGER AS {mj} FROM {dst}_c)"""


def masters(h: Header) -> str:
    """CTE `grid`: the spine with mi, mj, n_master and ghost."""
    return f"""{spine(h)}, {fold("pts", "folded", h)},
grid AS MATERIALIZED (SELECT *, mj::BIGINT * {h.ni} + mi AS n_master, jh < {h.halo_s} OR mi <> ih OR mj <> jh AS ghost FROM folded)"""


def owner(h: Header, parts: int, bands: int) -> str:
    each = parts // bands
    return f"""core AS (SELECT r AS n, (r % {h.nx})::INTEGER AS ix, (r // {h.nx})::INTEGER AS iy FROM range({h.nx * h.ny}) t(r)),
banded AS (SELECT *, ntile({bands}) OVER (ORDER BY n) - 1 AS band FROM core),
owner AS MATERIALIZED (SELECT n, ix, iy, (band * {each} + ntile({each}) OVER (PARTITION BY band ORDER BY ix, iy) - 1)::INTEGER AS part FROM banded)"""


def wrapped(x: str, width: int) -> str:
    return f"((({x}) % {width} + {width}) % {width})"


def turned(src: str, dst: str, h: Header, i: str, j: str, pi: str = "pi", pj: str = "pj") -> str:
    """Stages that add the core rectangle's own map of (i, j)."""
    top, half = h.ny - 1, h.nx // 2
    return f"""
{dst}_a AS (SELECT *, CASE WHEN {j} > {top} THEN 2 * {top} - {j} ELSE {j} END AS t1, CASE WHEN {j} > {top} THEN {half} ELSE 0 END AS s1 FROM {src}),
{dst} AS (SELECT * EXCLUDE (t1, s1), {wrapped(f"{i} + s1 + CASE WHEN t1 < 0 THEN {half} ELSE 0 END", h.nx)}::INTEGER AS {pi}, abs(t1)::INTEGER AS {pj} FROM {dst}_a)"""


def rectangles(h: Header, parts: int, bands: int, halo: int) -> str:
    return f"""{owner(h, parts, bands)},
rect AS (SELECT part, (min(ix) - {halo})::INTEGER AS ix_min, (max(ix) + {halo + 1})::INTEGER AS ix_max, (min(iy) - {halo})::INTEGER AS iy_min, (max(iy) + {halo + 1})::INTEGER AS iy_max, count(*) AS n_owned FROM owner GROUP BY part)"""


def rectangle_points(h: Header, parts: int, bands: int, halo: int) -> str:
    near = ""
    dist = f"{halo}" if halo < 2 else f"coalesce(d, {halo})"
    if halo >= 2:
        r = halo - 1
        near = f"""
offs AS (SELECT dx, dy FROM range({-r}, {r + 1}) a(dx), range({-r}, {r + 1}) b(dy) WHERE dx <> 0 OR dy <> 0),
seen AS (SELECT a.mypart, a.gi, a.gj, min(greatest(abs(dx), abs(dy))) AS d FROM rp a, offs o, rp b
         WHERE b.mypart = a.mypart AND b.gi = a.gi + dx AND b.gj = a.gj + dy AND b.part = a.mypart GROUP BY ALL),"""
    return f"""{rectangles(h, parts, bands, halo)},
box AS (SELECT part AS mypart, gi::INTEGER AS gi, unnest(range(iy_min, iy_max + 1))::INTEGER AS gj FROM (SELECT part, unnest(range(ix_min, ix_max + 1)) AS gi, iy_min, iy_max FROM rect)),
{turned("box", "tbox", h, "gi", "gj")},
rp AS MATERIALIZED (SELECT mypart, gi, gj, o.part, o.part <> mypart OR pi <> gi OR pj <> gj AS is_ghost FROM tbox JOIN owner o ON o.n = pj::BIGINT * {h.nx} + pi),{near}
rect_point AS MATERIALIZED (SELECT mypart, gi, gj, part, (CASE WHEN is_ghost THEN {dist} ELSE 0 END)::INTEGER AS halo, is_ghost FROM rp {"LEFT JOIN seen USING (mypart, gi, gj)" if near else ""})"""


def extents(h: Header) -> str:
    return f"""ext AS (SELECT part AS mypart, (CASE WHEN ix_min <= 0 THEN least(ix_min, {-h.halo_w}) ELSE ix_min END)::INTEGER AS ix_min,
  (CASE WHEN ix_max >= {h.nx - 1} THEN greatest(ix_max, {h.nx + h.halo_e - 1}) ELSE ix_max END)::INTEGER AS ix_max,
  (CASE WHEN iy_min <= 0 THEN {-h.halo_s} ELSE iy_min END)::INTEGER AS iy_min,
  (CASE WHEN iy_max >= {h.ny - 1} THEN greatest(iy_max, {h.ny + h.halo_n - 1}) ELSE iy_max END)::INTEGER AS iy_max FROM rect)"""


def local_points(h: Header, parts: int, bands: int, halo: int) -> str:
    w, s, nx, ny = h.halo_w, h.halo_s, h.nx, h.ny
    return f"""{rectangle_points(h, parts, bands, halo)}, {extents(h)},
lbox AS (SELECT *, gi + {w} AS fi, gj + {s} AS fj FROM (SELECT mypart, ix_min, iy_min, ix_max, iy_max, gi::INTEGER AS gi, unnest(range(iy_min, iy_max + 1))::INTEGER AS gj FROM (SELECT *, unnest(range(ix_min, ix_max + 1)) AS gi FROM ext))),
{fold("lbox", "lfold", h, "fi", "fj")},
lhal AS (SELECT *, gi >= {nx + h.halo_e} OR gj >= {ny + h.halo_n} OR gi < {-w} AS beyond FROM lfold),
lpos AS (SELECT *, CASE WHEN beyond THEN mi - {w} ELSE gi END AS hi, CASE WHEN beyond THEN mj - {s} ELSE gj END AS hj FROM lhal),
lkey AS (SELECT *, (hi < 0 AND hi >= {-w}) OR (hi >= {nx} AND hi < {nx + h.halo_e}) OR (hj < 0 AND hj >= {-s}) OR (hj >= {ny} AND hj < {ny + h.halo_n}) AS edge FROM lpos),
lnear AS (SELECT *, CASE WHEN edge THEN greatest(0, least(gi, {nx - 1})) ELSE gi END AS ki, CASE WHEN edge THEN greatest(0, least(gj, {ny - 1})) ELSE gj END AS kj,
          hi + {w} AS hih, hj + {s} AS hjh FROM lkey),
{fold("lnear", "lown", h, "hih", "hjh", "oi", "oj")},
loc AS MATERIALIZED (SELECT l.mypart, (gi_ - ix_min)::INTEGER AS ix, (gj_ - iy_min)::INTEGER AS iy, gi_ AS gi, gj_ AS gj, hi::INTEGER AS hi, hj::INTEGER AS hj,
        hjh::BIGINT * {h.ni} + hih AS n_haloed, mj::BIGINT * {h.ni} + mi AS n_master, r.part, r.halo,
        r.is_ghost OR hi <> gi_ OR hj <> gj_ AS is_ghost,
        CASE WHEN hj < 0 AND hi >= 0 AND hi < {nx} THEN r.is_ghost OR hi <> gi_ OR hj <> gj_
             ELSE r.is_ghost OR hi <> gi_ OR hj <> gj_ OR hjh < {s} OR oi <> hih OR oj <> hjh END AS is_ghost_own_halo,
        gi_ < ix_max AND gj_ < iy_max AS is_cell
        FROM (SELECT * RENAME (gi AS gi_, gj AS gj_) FROM lown) l JOIN rect_point r ON r.mypart = l.mypart AND r.gi = ki AND r.gj = kj)"""


def nodes(h: Header, parts: int, bands: int, halo: int) -> str:
    master = f"CASE WHEN is_ghost_own_halo THEN {'0' if parts == 1 else 'o.part'} ELSE l.part END"
    remote = f"CASE WHEN is_ghost_own_halo THEN {'n_master' if parts == 1 else '-1'} ELSE inode END"
    return f"""{local_points(h, parts, bands, halo)},
numb AS (SELECT *, row_number() OVER (PARTITION BY mypart ORDER BY is_ghost, iy, ix) - 1 AS inode,
         greatest(0, least(n_master % {h.ni} - {h.halo_w}, {h.nx - 1})) AS ci, greatest(0, least(n_master // {h.ni} - {h.halo_s}, {h.ny - 1})) AS cj FROM loc),
node AS MATERIALIZED (SELECT mypart, inode, l.ix, l.iy, gi, gj, hi, hj, n_master, n_haloed + 1 AS glb_idx,
         CASE WHEN is_ghost_own_halo THEN n_master ELSE n_haloed END + 1 AS master_glb_idx, ({remote})::BIGINT AS remote_idx,
         ({master})::INTEGER AS part, is_ghost_own_halo AS ghost, is_ghost, halo, is_cell
         FROM numb l JOIN owner o ON o.ix = ci AND o.iy = cj)"""


def cells(h: Header, parts: int, bands: int, halo: int, patched: bool) -> str:
    folded = f"a.gj >= {h.ny - 1} AND NOT ({'true' if patched else 'false'} AND a.gi < {h.nx // 2})"
    return f"""{nodes(h, parts, bands, halo)},
place AS MATERIALIZED (SELECT *, (mypart::BIGINT * {WIDE} + iy) * {WIDE} + ix AS k FROM node),
cell AS (SELECT a.mypart, row_number() OVER (PARTITION BY a.mypart ORDER BY a.is_ghost, a.iy, a.ix) - 1 AS jcell,
  (a.gj + {h.halo_s})::BIGINT * {h.ni} + a.gi + {h.halo_w} + 1 AS glb_idx, a.inode AS node0, b.inode AS node1, c.inode AS node2, d.inode AS node3,
  CASE WHEN {folded} THEN c.part ELSE a.part END AS part,
  (CASE WHEN a.gj < 0 THEN CASE WHEN a.gi < 0 THEN -a.gi WHEN a.gi >= {h.nx} THEN a.gi - {h.nx - 1} ELSE 0 END
        ELSE greatest(a.halo, b.halo, c.halo, d.halo) END)::INTEGER AS halo, {folded} AS f_ghost
  FROM place a JOIN place b ON b.k = a.k + 1 JOIN place c ON c.k = a.k + {WIDE + 1} JOIN place d ON d.k = a.k + {WIDE} WHERE a.is_cell)"""


def links(h: Header, parts: int, bands: int, halo: int) -> str:
    return f"""{nodes(h, parts, bands, halo)},
link AS (SELECT g.mypart, g.inode, g.part AS asked_part, g.master_glb_idx, o.inode AS remote_idx, o.part AS remote_part, o.glb_idx AS remote_glb_idx
  FROM node g LEFT JOIN node o ON NOT o.ghost AND o.mypart = g.part AND o.master_glb_idx = g.master_glb_idx WHERE g.ghost)"""


#: Test coordinates: whole and rational functions of the master, so that both engines agree to the last bit.
LON = "(73 + (mi - 1) * 2)::DOUBLE"
LAT = "-78 + mj * 168 / 149"
WATER = "((mi // 20) + (mj // 15)) % 3 <> 0"
BENT_LON = f"{LON} + CASE WHEN (mi * 5 + mj * 3) % 101 = 0 THEN -6 WHEN mi = 150 AND mj % 7 = 2 THEN 1.2 ELSE 0 END::DOUBLE"
BENT_LAT = f"{LAT} + CASE WHEN mi = 60 AND mj % 10 = 3 THEN 8 WHEN mi = 64 AND mj % 20 = 3 THEN 24 ELSE 0 END"


def corners(h: Header, lon: str, lat: str) -> str:
    """CTE `cell`: four corners with longitudes brought near the south-western one, before normalising as o_*."""
    pick = lambda a, p: f"{a}.lon AS lon_{p}, {a}.lat AS lat_{p}, {a}.water AS water_{p}"
    near = lambda p: f"lon_{p} - floor((lon_{p} - (lon_sw - 180.0)) / 360.0) * 360.0 AS x_{p}"
    return f"""{masters(h)},
geo AS (SELECT *, {lon} AS lon, {lat} AS lat, {WATER} AS water FROM grid),
quad AS (SELECT a.ih, a.jh, {pick("a", "sw")}, {pick("b", "se")}, {pick("c", "ne")}, {pick("d", "nw")} FROM geo a
  JOIN geo b ON b.n = a.n + 1 AND b.jh = a.jh JOIN geo d ON d.n = a.n + {h.ni} JOIN geo c ON c.n = a.n + {h.ni + 1} AND c.jh = a.jh + 1),
cell AS (SELECT *, lon_sw AS x_sw, {near("se")}, {near("ne")}, {near("nw")} FROM quad)"""


def classes(h: Header, lon: str = BENT_LON, lat: str = BENT_LAT, factor: float = 2.5) -> str:
    d = "greatest((x_ne - x_sw) * (x_ne - x_sw) + (lat_ne - lat_sw) * (lat_ne - lat_sw), (x_se - x_nw) * (x_se - x_nw) + (lat_se - lat_nw) * (lat_se - lat_nw))"
    limit = h.resolution * factor
    two_degree = "WHEN m.lat_max < 60 AND low > -20 AND low < 20 AND greatest(x_ne - x_nw, x_se - x_sw) > 2 * least(x_ne - x_nw, x_se - x_sw) THEN 'two_degree'" if abs(h.resolution - 2) < 0.1 else ""
    return f"""{corners(h, lon, lat)},
meas AS (SELECT *, greatest(lat_sw, lat_se, lat_ne, lat_nw) AS lat_max, {d} AS diag,
   least(x_sw, x_se, x_ne, x_nw) - floor((least(x_sw, x_se, x_ne, x_nw) + 180.0) / 360.0) * 360.0 AS low FROM cell),
kind AS (SELECT ih, jh, CASE WHEN m.lat_max < 45 AND (lat_nw - lat_sw < -1e-10 OR lat_ne - lat_se < -1e-10 OR x_ne - x_nw < -1e-10 OR x_se - x_sw < -1e-10) THEN 'quad2d'
   WHEN m.lat_max < 60 AND diag > {limit}::DOUBLE * {limit}::DOUBLE THEN 'diagonal' {two_degree} ELSE 'ok' END AS element_class,
   water_sw OR water_se OR water_ne OR water_nw AS has_water, diag > {h.resolution * 10}::DOUBLE * {h.resolution * 10}::DOUBLE AS huge FROM meas m),
elem AS (SELECT ih, jh, element_class, has_water, element_class <> 'ok' AND (NOT has_water OR huge) AS flagged FROM kind)"""
