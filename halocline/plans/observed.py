"""Named queries over the given tables on grids: location, distance, smoothing, balanced parts, hash trees and known prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.fold import bucket, core_of_linear, linear
from ..operators import balance, distance, locator, merkle, mesh, partition, points, quality, stencil, tracks
from ..operators.header import Header
from ..sources import bands, mesh_text, prefixes, record, text_grid
from ..sources.shared import scratch_path
from . import sql
from .roster import CASES, G2T, G025, Decomposition, _bent_lat, _bent_lon, _classes_3d_sql, _lat, _lon, _node_flags_sql, _values, _values_sql, query

# --- events in cells ---------------------------------------------------------------------------------------------------


def _cells(spark: SparkSession, h: Header) -> DataFrame:
    """The core cells of a sheared grid whose rows draw together to the north, with whole-number steps in longitude."""
    t = F.col("jh") / F.lit(float(h.nj))
    lon, lat = F.lit(73.0) + (F.col("ih") - 1) * F.lit(360.0 / h.nx) + F.lit(3.0) * t, F.lit(-78.0) + F.lit(166.0) * t * (F.lit(2.0) - t)
    grid = points.spine(spark, h).withColumns({"lon": lon, "lat": lat, "water": F.lit(True)})
    return quality.cell_corners(grid, h).where(F.col("ih").between(h.halo_w, h.halo_w + h.nx - 1) & F.col("jh").between(h.halo_s, int(h.pivot_j) - 1))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    lon, lat = (F.col("event_id") * 7919 % 3_600_000) / F.lit(10_000.0), (F.col("event_id") * 104_729 % 1_700_000) / F.lit(10_000.0) - F.lit(80.0)
    return e.select(F.col("event_id").alias("id"), lon.alias("lon"), lat.alias("lat"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def _located_sql(h: Header) -> str:
    """CTE `found`: events with ih and jh, each tried against every cell of the rows that hold its latitude."""
    lon = lambda di, dj: f"73.0::DOUBLE + (ih + {di} - 1) * {360.0 / h.nx}::DOUBLE + 3.0::DOUBLE * ((jh + {dj}) / {float(h.nj)}::DOUBLE)"
    lat = lambda dj: f"-78.0::DOUBLE + 166.0::DOUBLE * ((jh + {dj}) / {float(h.nj)}::DOUBLE) * (2.0::DOUBLE - ((jh + {dj}) / {float(h.nj)}::DOUBLE))"
    corner = {"sw": (0, 0), "se": (1, 0), "ne": (1, 1), "nw": (0, 1)}
    xy = ", ".join(f"{lon(*d)} AS x_{c}, {lat(d[1])} AS y_{c}" for c, d in corner.items())
    ends = [("sw", "se"), ("se", "ne"), ("ne", "nw"), ("nw", "sw")]
    inside = " AND ".join(f"(x_{b} - x_{a}) * (lat - y_{a}) - (y_{b} - y_{a}) * (px - x_{a}) >= 0" for a, b in ends)
    return f"""{sql.spine(h)}, cells AS (SELECT *, least(x_sw, x_nw) AS x0, greatest(x_se, x_ne) AS x1, least(y_sw, y_se) AS y0, greatest(y_nw, y_ne) AS y1 FROM
  (SELECT ih, jh, {xy} FROM pts WHERE ih BETWEEN {h.halo_w} AND {h.halo_w + h.nx - 1} AND jh BETWEEN {h.halo_s} AND {int(h.pivot_j) - 1})),
e AS (SELECT event_id, (event_id * 7919 % 3600000) / 10000.0::DOUBLE AS lon, (event_id * 104729 % 1700000) / 10000.0::DOUBLE - 80.0::DOUBLE AS lat, round(value * 100)::BIGINT AS cents FROM events),
turns AS (SELECT event_id, lat, lon + 360.0::DOUBLE * k AS px FROM e, range(2) t(k)),
rows AS (SELECT DISTINCT jh, y0, y1 FROM cells), met AS (SELECT event_id, lat, px, jh FROM turns JOIN rows ON lat >= y0 AND lat <= y1),
hits AS (SELECT event_id, min(jh * 100000 + ih) AS place FROM met JOIN cells USING (jh) WHERE px >= x0 - 1e-9 AND px <= x1 AND {inside} GROUP BY event_id),
found AS (SELECT e.*, (place % 100000)::INTEGER AS ih, (place // 100000)::INTEGER AS jh FROM e LEFT JOIN hits USING (event_id))"""


@query(f"WITH {_located_sql(G025)} SELECT event_id, ih, jh FROM found")
def obs_event_located(spark, sf_dir):
    """The cell of the quarter-degree grid in which each event lies."""
    return locator.located(_positions(spark, sf_dir), _cells(spark, G025)).select(F.col("id").alias("event_id"), "ih", "jh")


def _slice(v: str, size: int, k: int) -> str:
    q, r = divmod(size, k)
    return f"(CASE WHEN {v} < {r * (q + 1)} THEN ({v}) // {q + 1} ELSE {r} + ({v} - {r * (q + 1)}) // {q} END)"


@query(f"""WITH {_located_sql(G025)} SELECT CASE WHEN ih IS NULL THEN NULL ELSE ({_slice(f"(jh - {G025.halo_s})", G025.ny, 4)} * 4 + {_slice(f"(ih - {G025.halo_w})", G025.nx, 4)})::INTEGER END AS part,
count(*) AS events, sum(cents)::BIGINT AS cents FROM found GROUP BY ALL""")
def obs_event_parts(spark, sf_dir):
    """Events by the part of a decomposition into 16 in which they lie."""
    found = locator.located(_positions(spark, sf_dir), _cells(spark, G025))
    owner = partition.owners(spark, G025, 16, partitioner="regular_checkerboard")
    return locator.in_parts(found, owner, G025.halo_w, G025.halo_s).groupBy("part").agg(F.count(F.lit(1)).alias("events"), F.sum("cents").alias("cents"))


# --- distance to observations -------------------------------------------------------------------------------------------

REACH = 32


def _distance_sql(h: Header, most: int) -> str:
    top, pi, pj, w = int(h.pivot_j), int(2 * h.pivot_i), int(2 * h.pivot_j), h.halo_w
    ring = lambda x: f"({w} + (({x}) - {w} + {4 * h.nx}) % {h.nx})"
    return f"""WITH {_values_sql(h)}, area AS (SELECT n, n_master, ih, jh FROM grid WHERE ih BETWEEN {w} AND {w + h.nx - 1} AND jh BETWEEN {h.halo_s} AND {top}),
marked AS (SELECT ih, jh FROM area SEMI JOIN vals USING (n_master)),
images AS (SELECT ih, jh FROM marked UNION ALL SELECT {ring(f"{pi} - ih")}, {pj} - jh FROM marked WHERE {pj} - jh BETWEEN {top + 1} AND {top + most}),
near AS (SELECT {ring("ih + dx")} AS ih, jh + dy AS jh, min(greatest(abs(dx), abs(dy))) AS d FROM images, range({1 - most}, {most}) a(dx), range({1 - most}, {most}) b(dy)
         WHERE jh + dy BETWEEN {h.halo_s} AND {top} GROUP BY ALL)
SELECT n, coalesce(d, {most})::INTEGER AS d FROM area LEFT JOIN near USING (ih, jh) WHERE n = n_master"""


@query(_distance_sql(G025, REACH))
def obs_distance(spark, sf_dir):
    """How far every point of the quarter-degree grid is from the nearest one with an observation, up to 32 steps."""
    return distance.to_marked(spark, _values(spark, sf_dir, G025), G025, REACH)


# --- smoothing with repeated halo exchange --------------------------------------------------------------------------------

STEPS = 4


def _core_values(spark: SparkSession, sf_dir: str, h: Header) -> DataFrame:
    """(i, j, value) at core points, those whose master is another included."""
    core = points.with_master(points.spine(spark, h), h).where(F.col("i").between(0, h.nx - 1) & F.col("j").between(0, h.ny - 1))
    return core.join(_values(spark, sf_dir, h), "n_master").select("i", "j", F.col("cents").alias("value"))


def _smoothed_sql(h: Header, steps: int) -> str:
    stages = [f"s0 AS (SELECT n, coalesce(cents, 0)::BIGINT AS v FROM core LEFT JOIN vals USING (n_master))"]
    for k in range(1, steps + 1):
        stages.append(f"s{k} AS MATERIALIZED (SELECT a.n, ((4 * any_value(a.v) + sum(b.v)) // 8)::BIGINT AS v FROM s{k - 1} a JOIN near ON near.n = a.n JOIN s{k - 1} b ON b.n = near.m GROUP BY a.n)")
    return f"""WITH {_values_sql(h)}, core AS (SELECT * FROM grid WHERE i BETWEEN 0 AND {h.nx - 1} AND j BETWEEN 0 AND {h.ny - 1}),
around AS (SELECT n, (i + dx + {h.halo_w})::INTEGER AS ai, (j + dy + {h.halo_s})::INTEGER AS aj FROM core, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(dx, dy)),
{sql.fold("around", "turned", h, "ai", "aj", "ti", "tj")},
near AS (SELECT n, CASE WHEN aj < {h.halo_s} THEN n WHEN ai BETWEEN {h.halo_w} AND {h.halo_w + h.nx - 1} AND aj < {h.halo_s + h.ny} THEN aj::BIGINT * {h.ni} + ai ELSE tj::BIGINT * {h.ni} + ti END AS m FROM turned),
{", ".join(stages)} SELECT i, j, v AS value FROM s{steps} JOIN core USING (n)"""


@query(_smoothed_sql(G2T, STEPS))
def obs_smoothed(spark, sf_dir):
    """The observed sums after four steps of smoothing in 20 blocks."""
    return stencil.smoothed(spark, _core_values(spark, sf_dir, G2T), G2T, STEPS, bands=4, columns=5)


# --- parts of equal load --------------------------------------------------------------------------------------------------

PARTS, BANDS = 16, 4


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = core_of_linear(F.col("n_master"), G025)
    load = _values(spark, sf_dir, G025).select(i.alias("ix"), j.alias("iy"), F.col("n_obs").alias("load")).where(F.col("ix").between(0, G025.nx - 1) & F.col("iy").between(0, G025.ny - 1))
    return balance.owners_by_load(spark, load, G025, PARTS, BANDS)


def _owned_sql(h: Header, parts: int, bands: int) -> str:
    each = parts // bands
    upto = lambda by, order: f"coalesce(sum(load) OVER ({by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"""WITH {_values_sql(h)}, load AS (SELECT n_master % {h.ni} - {h.halo_w} AS ix, n_master // {h.ni} - {h.halo_s} AS iy, n_obs FROM vals),
core AS (SELECT r AS n, (r % {h.nx})::INTEGER AS ix, (r // {h.nx})::INTEGER AS iy FROM range({h.nx * h.ny}) t(r)),
loaded AS (SELECT n, core.ix, core.iy, coalesce(n_obs, 0)::BIGINT AS load FROM core LEFT JOIN load ON load.ix = core.ix AND load.iy = core.iy),
banded AS (SELECT *, least({upto("", "iy, ix")} * {bands} // sum(load) OVER (), {bands - 1})::INTEGER AS band FROM loaded),
owned AS (SELECT *, (band * {each} + least({upto("PARTITION BY band", "ix, iy")} * {each} // sum(load) OVER (PARTITION BY band), {each - 1}))::INTEGER AS part FROM banded)"""


@query(f"""{_owned_sql(G025, PARTS, BANDS)} SELECT part, count(*) AS points, sum(load)::BIGINT AS load, min(ix) AS ix_min, max(ix) AS ix_max, min(iy) AS iy_min, max(iy) AS iy_max FROM owned GROUP BY part""")
def obs_balanced_parts(spark, sf_dir):
    """Sixteen parts of the quarter-degree grid with as many observations each."""
    return balance.summary(_owned(spark, sf_dir))


@query(f"{_owned_sql(G025, PARTS, BANDS)} SELECT ix, iy, load, part FROM owned WHERE load > 0")
def obs_balanced_owner(spark, sf_dir):
    """The part that owns each observed point."""
    return _owned(spark, sf_dir).where("load > 0").select("ix", "iy", "load", "part")


# --- hash trees -------------------------------------------------------------------------------------------------------------


def _field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir, G025).select(F.col("n_master").alias("n"), F.col("cents").alias("value"))


def _tree_sql(size: int) -> str:
    stages = [f"t0 AS (SELECT n_master // {merkle.CHUNK} AS node, sha256(string_agg(n_master || ':' || cents, chr(10) ORDER BY n_master)) AS digest FROM vals GROUP BY ALL)"]
    levels = merkle.levels_of(size)
    for k in range(1, levels):
        stages.append(f"t{k} AS (SELECT node // {merkle.FAN} AS node, sha256(string_agg(digest, chr(10) ORDER BY node)) AS digest FROM t{k - 1} t GROUP BY t.node // {merkle.FAN})")
    return ", ".join(stages) + " " + " UNION ALL ".join(f"SELECT {k} AS level, node, digest FROM t{k}" for k in range(levels))


@query(f"WITH {_values_sql(G025)}, {_tree_sql(G025.size)}")
def obs_field_tree(spark, sf_dir):
    """The hash tree of the observed sums on the quarter-degree grid."""
    return merkle.tree(_field(spark, sf_dir), G025.size)


@query(f"WITH {_values_sql(G025)} SELECT DISTINCT n_master // {merkle.CHUNK} * {merkle.CHUNK} AS first_n, least((n_master // {merkle.CHUNK} + 1) * {merkle.CHUNK}, {G025.size})::BIGINT AS end_n FROM vals WHERE n_master % 997 = 5")
def obs_field_tree_differences(spark, sf_dir):
    """The chunks in which the observed sums differ from a copy that is off by a cent at some points and lacks others."""
    own = _field(spark, sf_dir)
    off = own.where("n % 1994 <> 5").withColumn("value", F.col("value") + (F.col("n") % 1994 == 1002).cast("int"))
    return merkle.differing(merkle.tree(own, G025.size), merkle.tree(off, G025.size), G025.size)


# --- known prefixes of URLs --------------------------------------------------------------------------------------------------

SITE, SECTION = "^(https?://[^/?#]+)", "^(https?://[^/?#]+/[^/?#]+)"
_KNOWN_SQL = f"""seen AS (SELECT DISTINCT unnest([regexp_extract(url, '{SITE}', 1), regexp_extract(url, '{SECTION}', 1)]) AS prefix FROM pages),
known AS (SELECT prefix, '/' || substr(md5(prefix), 1, 8) AS target FROM seen WHERE prefix <> '' AND substr(md5(prefix), 1, 1) < 'c')"""


def _known(pages: DataFrame) -> DataFrame:
    """Three quarters of the sites and of their sections, each with a folder of its own."""
    prefix = F.explode(F.array(F.regexp_extract("url", SITE, 1), F.regexp_extract("url", SECTION, 1))).alias("prefix")
    digest = F.md5(F.col("prefix").cast("binary"))
    return pages.select(prefix).distinct().where((F.col("prefix") != "") & (F.substring(digest, 1, 1) < "c")).select("prefix", F.concat(F.lit("/"), F.substring(digest, 1, 8)).alias("target"))


@query(f"""WITH {_KNOWN_SQL}, best AS (SELECT page_id, max_by(prefix, length(prefix)) AS prefix, max_by(target, length(prefix)) AS target FROM pages JOIN known ON starts_with(url, prefix) GROUP BY page_id)
SELECT page_id, url, prefix, CASE WHEN NOT starts_with(url, 'http') THEN url WHEN prefix IS NULL THEN '{prefixes.CACHE_FOLDER}/unknown' || regexp_extract(url, '(/[^/]*)$', 1)
ELSE '{prefixes.CACHE_FOLDER}' || target || substr(url, length(prefix) + 1) END AS path FROM pages LEFT JOIN best USING (page_id)""")
def page_cached_paths(spark, sf_dir):
    """Where every page would be kept: below its longest known site or section."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = prefixes.longest_prefix(pages, _known(pages))
    return found.select("page_id", "url", "prefix", prefixes.cached_path(F.col("url"), F.col("prefix"), F.col("target")).alias("path"))


@query("""SELECT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host, count(*) AS urls, min(url) AS first_url, max(url) AS last_url, (sum(('0x' || substr(md5(url), 1, 8))::BIGINT))::BIGINT AS digest
FROM (SELECT DISTINCT url FROM pages WHERE starts_with(url, 'http')) GROUP BY ALL""")
def page_urls_by_host(spark, sf_dir):
    """The distinct URLs of each host."""
    return prefixes.by_host(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url"))


# --- text files ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_values_sql(G2T)} SELECT n, coalesce(cents, 0)::BIGINT AS cents, cents IS NOT NULL AS observed, n = n_master AS core FROM grid LEFT JOIN vals USING (n_master)")
def obs_text_files(spark, sf_dir):
    """The observed sums on all points, written as a text grid of several files and scanned back."""
    grid = points.with_master(points.spine(spark, G2T), G2T).join(_values(spark, sf_dir, G2T), "n_master", "left")
    rows = grid.select("n", F.coalesce("cents", F.lit(0)).alias("lat"), F.col("n").alias("lon"), F.col("cents").isNotNull().alias("water"), (F.col("n") == F.col("n_master")).alias("core"))
    path = scratch_path(spark, "text-grid")
    text_grid.write_points(rows, G2T, path, files=7)
    back = text_grid.parse_points(text_grid.read_lines(spark, path), 1)
    return back.where("lon = n").select("n", F.col("lat").cast("bigint").alias("cents"), (F.col("water") != 0).alias("observed"), (F.col("core") != 0).alias("core"))


# --- fields as a data source ----------------------------------------------------------------------------------------------------


@query(f"WITH {_values_sql(G025)} SELECT n_master AS n, (n_master // {G025.ni})::INTEGER AS jh, cents FROM vals WHERE n_master // {G025.ni} BETWEEN 400 AND 600")
def obs_band_rows(spark, sf_dir):
    """A third of the rows of the observed sums, read back from a field written in bands."""
    own = _values(spark, sf_dir, G025).select(F.col("n_master").alias("n"), F.floor(F.col("n_master") / G025.ni).cast("int").alias("jh"), "cents")
    path = scratch_path(spark, "bands")
    bands.write_bands(own, path, rows=4096)
    return spark.read.format(bands.FORMAT).load(path).where("jh between 400 and 600")


# --- grid and mesh operators on the observed field ----------------------------------------------------------------------------------

_VALS = _values_sql(G2T)[len(sql.masters(G2T)) :]  # the CTE of the values alone
_OBSERVED = "LEFT JOIN vals USING (n_master)"
_FIELD = f"{_values_sql(G2T)}, geo AS (SELECT grid.*, coalesce(cents, 0) AS cents, coalesce(n_obs, 0) AS n_obs, cents IS NOT NULL AS water FROM grid {_OBSERVED})"


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points of the two-degree grid with the observed sums of their masters; water where there are any."""
    grid = points.with_master(points.spine(spark, G2T), G2T).join(_values(spark, sf_dir, G2T), "n_master", "left")
    return grid.withColumns({"water": F.col("cents").isNotNull(), "cents": F.coalesce("cents", F.lit(0)), "n_obs": F.coalesce("n_obs", F.lit(0))})


@query(f"""WITH {_FIELD}, off AS (SELECT n, n_master, cents + CASE WHEN n <> n_master AND (ih * 7 + jh * 13) % 97 = 0 THEN 5 ELSE 0 END AS cents, n_obs,
water <> (n <> n_master AND (ih * 7 + jh * 13) % 89 = 0) AS water FROM geo)
SELECT a.n, a.n_master, b.cents::BIGINT AS cents, b.n_obs::BIGINT AS n_obs, b.water, a.water <> b.water AS mask_differs, a.cents <> b.cents AS coordinates_differ FROM off a JOIN off b ON b.n = a.n_master""")
def obs_halo_repair(spark, sf_dir):
    """The observed field, off at some ghosts, repaired from the masters."""
    away, mark = F.col("n") != F.col("n_master"), F.col("ih") * 7 + F.col("jh") * 13
    off = _observed(spark, sf_dir).select("n", "n_master", (F.col("cents") + F.when(away & (mark % 97 == 0), 5).otherwise(0)).cast("double").alias("lon"), F.col("n_obs").cast("double").alias("lat"), (F.col("water") != (away & (mark % 89 == 0))).alias("water"))
    fixed = quality.halo_repaired(off)
    return fixed.select("n", "n_master", F.col("lon").cast("bigint").alias("cents"), F.col("lat").cast("bigint").alias("n_obs"), "water", "mask_differs", "coordinates_differ")


@query(f"""WITH {_FIELD} SELECT a.ih, a.jh, (a.cents + b.cents + c.cents + d.cents)::BIGINT AS cents, (a.n_obs + b.n_obs + c.n_obs + d.n_obs)::BIGINT AS n_obs, a.water OR b.water OR c.water OR d.water AS wet,
NOT (a.water AND b.water AND c.water AND d.water) AS has_land FROM geo a JOIN geo b ON b.n = a.n + 1 AND b.jh = a.jh JOIN geo d ON d.n = a.n + {G2T.ni} JOIN geo c ON c.n = a.n + {G2T.ni + 1} AND c.jh = a.jh + 1""")
def obs_cell_sums(spark, sf_dir):
    """The observed sums over the corners of every cell."""
    cells = quality.cell_corners(_observed(spark, sf_dir).select("ih", "jh", F.col("cents").alias("lon"), F.col("n_obs").alias("lat"), "water"), G2T)
    total = lambda c: sum((F.col(f"{c}_{k}") for k in quality.CORNERS[1:]), F.col(f"{c}_sw"))
    any_of = lambda f: f("water_sw") | f("water_se") | f("water_ne") | f("water_nw")
    return cells.select("ih", "jh", total("lon").alias("cents"), total("lat").alias("n_obs"), any_of(F.col).alias("wet"), any_of(lambda c: ~F.col(c)).alias("has_land"))


_OBSERVED_CLASSES = sql.classes(G2T).replace(",\ngeo AS", f"{_VALS},\ngeo AS").replace(f"{sql.WATER} AS water FROM grid", f"cents IS NOT NULL AS water FROM grid {_OBSERVED}")


@query(f"WITH {_OBSERVED_CLASSES} SELECT element_class, has_water, count(*) AS cells, count(*) FILTER (WHERE flagged) AS flagged FROM elem GROUP BY ALL")
def obs_element_classes(spark, sf_dir):
    """Classes of the bent grid's elements, wet where there are observations."""
    grid = _observed(spark, sf_dir).withColumns({"lon": _bent_lon(), "lat": _bent_lat()})
    found = quality.classified(quality.cell_corners(grid, G2T), G2T, with_3d=False)
    return found.groupBy("element_class", "has_water").agg(F.count(F.lit(1)).alias("cells"), F.count_if("flagged").alias("flagged"))


def _node_values(spark: SparkSession, sf_dir: str) -> tuple[Decomposition, DataFrame, DataFrame]:
    """A mesh in four parts with a halo of two, the observed sums on its real nodes and those that its ghosts receive."""
    d = Decomposition(spark, *CASES["_wide"])
    own = d.nodes.where("not ghost").select("mypart", "inode", (F.col("master_glb_idx") - 1).alias("n_master"))
    values = own.join(_values(spark, sf_dir, G2T), "n_master").select("mypart", "inode", F.col("cents").alias("value"))
    return d, values, mesh.exchanged(d.nodes, values)


_LINKS, _CELLS = sql.links(*CASES["_wide"]), sql.cells(*CASES["_wide"], mesh.is_patched(G2T))


@query(f"WITH {_LINKS}, {_values_sql(G2T)} SELECT g.mypart, g.inode, cents AS value FROM link g JOIN node o ON o.mypart = g.asked_part AND o.inode = g.remote_idx JOIN vals ON vals.n_master = o.master_glb_idx - 1")
def obs_mesh_exchange(spark, sf_dir):
    """The observed sums that the ghosts of a mesh receive from the nodes that own them."""
    return _node_values(spark, sf_dir)[2]


@query(f"""WITH {_CELLS}, {_values_sql(G2T)}, corner AS (SELECT mypart, jcell, part, halo, unnest([node0, node1, node2, node3]) AS inode FROM cell)
SELECT c.mypart, jcell, c.part, c.halo, coalesce(sum(cents), 0)::BIGINT AS cents, count(cents) AS observed FROM corner c JOIN node n ON n.mypart = c.mypart AND n.inode = c.inode LEFT JOIN vals ON vals.n_master = n.master_glb_idx - 1 GROUP BY ALL""")
def obs_mesh_cell_sums(spark, sf_dir):
    """The observed sums over the corners of a mesh's cells, ghosts by exchange."""
    d, own, received = _node_values(spark, sf_dir)
    corner = F.explode(F.array(*[F.col(f"node{k}") for k in range(4)])).alias("inode")
    corners = mesh.cells(d.nodes, d.h).select("mypart", "jcell", "part", "halo", corner)
    met = corners.join(own.unionByName(received), ["mypart", "inode"], "left")
    return met.groupBy("mypart", "jcell", "part", "halo").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("cents"), F.count("value").alias("observed"))


@query(f"""WITH {sql.owner(G2T, 6, 2)}, {_values_sql(G2T)}, load AS (SELECT n_master % {G2T.ni} - {G2T.halo_w} AS ix, n_master // {G2T.ni} - {G2T.halo_s} AS iy, n_obs FROM vals)
SELECT part, count(*) AS points, coalesce(sum(n_obs), 0)::BIGINT AS load, min(o.ix) AS ix_min, max(o.ix) AS ix_max, min(o.iy) AS iy_min, max(o.iy) AS iy_max FROM owner o LEFT JOIN load ON load.ix = o.ix AND load.iy = o.iy GROUP BY part""")
def obs_part_loads(spark, sf_dir):
    """Bounds, points and observations of the parts of a checkerboard, which is cut by points alone."""
    i, j = core_of_linear(F.col("n_master"), G2T)
    load = _values(spark, sf_dir, G2T).select(i.alias("ix"), j.alias("iy"), F.col("n_obs").alias("load"))
    owner = partition.owners(spark, G2T, 6, 2).join(load, ["ix", "iy"], "left").withColumn("load", F.coalesce("load", F.lit(0)))
    return balance.summary(owner)


_DECOMPOSED = "_wide"


@query(f"""WITH {sql.local_points(*CASES[_DECOMPOSED])}, {_values_sql(G2T)} SELECT mypart, halo, is_ghost, count(*) AS points, count(cents) AS observed, coalesce(sum(cents), 0)::BIGINT AS cents
FROM loc LEFT JOIN vals USING (n_master) GROUP BY mypart, halo, is_ghost""")
def obs_local_sums(spark, sf_dir):
    """The observed sums that each part holds, by distance to its own points and for ghosts and others."""
    local = Decomposition(spark, *CASES[_DECOMPOSED]).local
    met = local.join(_values(spark, sf_dir, G2T), "n_master", "left")
    return met.groupBy("mypart", "halo", "is_ghost").agg(F.count(F.lit(1)).alias("points"), F.count("cents").alias("observed"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"))


def _observed_water(text: str) -> str:
    """SQL over test points, made to take water from the observations."""
    masters = sql.masters(G2T)
    assert text.count(masters) == 1 and text.count(f"{sql.WATER} AS water FROM grid") == 1
    return text.replace(masters, masters + _VALS).replace(f"{sql.WATER} AS water FROM grid", f"cents IS NOT NULL AS water FROM grid {_OBSERVED}")


@query(f"""WITH {_observed_water(_classes_3d_sql())} SELECT count(*) FILTER (WHERE element_class <> 'ok') AS invalid_elements, count(*) FILTER (WHERE element_class = 'quad2d') AS invalid_quads_2d,
count(*) FILTER (WHERE element_class = 'quad3d') AS invalid_quads_3d, count(*) FILTER (WHERE element_class = 'diagonal') AS diagonal_too_large, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE NOT has_water) AS dry FROM elem3""")
def obs_element_statistics(spark, sf_dir):
    """Statistics of the bent grid's elements by all rules, wet where there are observations."""
    grid = _observed(spark, sf_dir).withColumns({"lon": _bent_lon(), "lat": _bent_lat()})
    return quality.statistics(quality.classified(quality.cell_corners(grid, G2T), G2T))


@query(f"WITH flagged AS ({_observed_water(_node_flags_sql(_DECOMPOSED))}) SELECT * FROM flagged")
def obs_mesh_node_flags(spark, sf_dir):
    """Places and flags of a mesh's nodes, water where there are observations."""
    grid = _observed(spark, sf_dir).withColumns({"lon": _lon(), "lat": _lat()})
    placed = mesh.with_coordinates(Decomposition(spark, *CASES[_DECOMPOSED]).nodes, grid, G2T, 73.0)
    return placed.select("mypart", "inode", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "f_ghost", "f_periodic", "f_east", "f_west", "f_bc", "f_land", "f_water")


@query(f"""WITH {_FIELD} SELECT n, ih, jh, cents::BIGINT AS cents, n_obs::BIGINT AS n_obs, ghost, water, n_obs > 3 AS invalid FROM geo WHERE n BETWEEN {30 * G2T.ni} AND {90 * G2T.ni - 1}""")
def obs_record_rows(spark, sf_dir):
    """Rows 30 to 89 of the observed field, written as a grid record with its flags and read back."""
    grid = points.with_ghost(_observed(spark, sf_dir), G2T)
    own = grid.select("n", F.col("cents").cast("double").alias("lon"), F.col("n_obs").cast("double").alias("lat"), "ghost", "water", (F.col("n_obs") > 3).alias("invalid"))
    path = scratch_path(spark, "record")
    record.write_record(own, G2T, path)
    _, back = record.read_record(spark, path)
    rows = back.where(F.col("n").between(30 * G2T.ni, 90 * G2T.ni - 1))
    return rows.select("n", "ih", "jh", F.col("lon").cast("bigint").alias("cents"), F.col("lat").cast("bigint").alias("n_obs"), "ghost", "water", "invalid")


@query(f"""WITH {_CELLS}, {_values_sql(G2T)}, corner AS (SELECT unnest([node0, node1, node2, node3]) AS inode FROM cell WHERE mypart = 0)
SELECT n.inode, n.gi::DOUBLE AS x, n.gj::DOUBLE AS y, any_value(cents)::DOUBLE AS value, count(c.inode) AS cells
FROM node n LEFT JOIN vals ON vals.n_master = n.master_glb_idx - 1 LEFT JOIN corner c ON c.inode = n.inode WHERE n.mypart = 0 GROUP BY n.inode, n.gi, n.gj""")
def obs_mesh_text(spark, sf_dir):
    """The first part's mesh with the observed sums on its nodes, ghosts by exchange, written as text and read back."""
    d, own, received = _node_values(spark, sf_dir)
    path = scratch_path(spark, "mesh-text")
    values = own.unionByName(received).where("mypart = 0").select("inode", F.col("value").cast("double").alias("value"))
    mesh_text.write_mesh(d.nodes.where("mypart = 0"), mesh.cells(d.nodes, d.h).where("mypart = 0"), path, "ij", values)
    nodes, cells, back = mesh_text.read_mesh(spark, path)
    around = cells.select(F.explode(F.array(*[f"node{k}" for k in range(4)])).alias("inode")).groupBy("inode").agg(F.count(F.lit(1)).alias("cells"))
    met = nodes.join(back, "inode", "left").join(around, "inode", "left")
    return met.select("inode", "x", "y", "value", F.coalesce("cells", F.lit(0)).cast("bigint").alias("cells"))


# --- tracks of users over the grid --------------------------------------------------------------------------------------------------

TRACK_PARTS, TRACK_BANDS = 16, 4


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A move of up to 20 columns and 15 rows for each event, on its user's track."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    return e.select(F.col("user_id").alias("track"), F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("event_id") * 7919 % 41 - 20).alias("di"), (F.col("event_id") * 104_729 % 31 - 15).alias("dj"))


def _tracks(spark: SparkSession, sf_dir: str, h: Header) -> DataFrame:
    return tracks.positions(_moves(spark, sf_dir), F.col("track") * 37 % h.nx, F.col("track") * 53 % h.ny, h)


def _tracks_sql(h: Header) -> str:
    """CTE `track`: every event's points before and after its move, by sums over all of its user's events."""
    upto = lambda c, to: f"coalesce(sum({c}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND {to}), 0)::BIGINT"
    at = lambda c, start, n, to: f"user_id * {start} % {n} + {upto(c, to)}"
    up = lambda y: sql.wrapped(y, 2 * (h.ny - 1))
    xy = ", ".join(f"{at('di', 37, h.nx, to)} AS x{k}, {up(at('dj', 53, h.ny, to))} AS y{k}" for k, to in enumerate(("1 PRECEDING", "CURRENT ROW")))
    return f"""moved AS (SELECT event_id, user_id, ts, event_id * 7919 % 41 - 20 AS di, event_id * 104729 % 31 - 15 AS dj FROM events),
placed AS (SELECT event_id, user_id, {xy} FROM moved), {sql.turned("placed", "turn0", h, "x0", "y0", "from_i", "from_j")}, {sql.turned("turn0", "track", h, "x1", "y1", "to_i", "to_j")}"""


@query(f"WITH {_tracks_sql(G025)} SELECT event_id, user_id, from_i, from_j, to_i, to_j, (to_j + {G025.halo_s})::BIGINT * {G025.ni} + to_i + {G025.halo_w} AS n FROM track")
def event_tracks(spark, sf_dir):
    """The points of the quarter-degree grid between which each event moves its user."""
    found = _tracks(spark, sf_dir, G025)
    return found.select(F.col("id").alias("event_id"), F.col("track").alias("user_id"), "from_i", "from_j", "to_i", "to_j", linear(F.col("to_i"), F.col("to_j"), G025).alias("n"))


def _part(i, j, h: Header):
    return (bucket(j, F.lit(h.ny), TRACK_BANDS) * (TRACK_PARTS // TRACK_BANDS) + bucket(i, F.lit(h.nx), TRACK_PARTS // TRACK_BANDS)).cast("int")


def _part_sql(i: str, j: str, h: Header) -> str:
    return f"({_slice(j, h.ny, TRACK_BANDS)} * {TRACK_PARTS // TRACK_BANDS} + {_slice(i, h.nx, TRACK_PARTS // TRACK_BANDS)})::INTEGER"


@query(f"""WITH {_tracks_sql(G025)} SELECT {_part_sql("from_i", "from_j", G025)} AS from_part, {_part_sql("to_i", "to_j", G025)} AS to_part, count(*) AS moves, count(DISTINCT user_id) AS tracks FROM track GROUP BY ALL""")
def event_part_crossings(spark, sf_dir):
    """How many moves lead from part to part of a decomposition into 16, and on how many tracks."""
    at = lambda end: _part(F.col(f"{end}_i"), F.col(f"{end}_j"), G025)
    return tracks.crossings(_tracks(spark, sf_dir, G025), at("from"), at("to"))


_TRACK_LON, _TRACK_LAT = f"{{}}_i * {360.0 / G025.nx}::DOUBLE", f"{{}}_j * {170.0 / (G025.ny - 1)}::DOUBLE - 80.0::DOUBLE"


@query(f"""WITH {_tracks_sql(G025)}, ends AS (SELECT user_id, {", ".join(f"{_TRACK_LON.format(e)} AS lon_{e}, {_TRACK_LAT.format(e)} AS lat_{e}" for e in ("from", "to"))} FROM track),
far AS (SELECT user_id, round(2 * {geometry.EARTH_RADIUS} * asin(sqrt(least(pow(sin(radians(lat_to - lat_from) / 2), 2) + cos(radians(lat_from)) * cos(radians(lat_to)) * pow(sin(radians(lon_to - lon_from) / 2), 2), 1.0))))::BIGINT AS metres FROM ends)
SELECT user_id, count(*) AS moves, sum(metres)::BIGINT AS metres, max(metres) AS longest FROM far GROUP BY user_id""")
def event_track_lengths(spark, sf_dir):
    """How far each user comes on the sphere, over the regular grid of the core's size."""
    place = lambda end: (F.col(f"{end}_i") * F.lit(360.0 / G025.nx), F.col(f"{end}_j") * F.lit(170.0 / (G025.ny - 1)) - F.lit(80.0))
    far = _tracks(spark, sf_dir, G025).select(F.col("track").alias("user_id"), F.round(geometry.sphere_distance(place("from"), place("to"))).cast("bigint").alias("metres"))
    return far.groupBy("user_id").agg(F.count(F.lit(1)).alias("moves"), F.sum("metres").alias("metres"), F.max("metres").alias("longest"))
