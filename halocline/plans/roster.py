"""Named queries: each a function of (spark, sf_dir), most with a twin in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions import fold, geometry
from ..operators import field, local_grid, mesh, partition, points, quality, uid
from ..operators.header import Header, derive_headers, header_of
from ..sources import record, registry, text_grid
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

G2T, G2V = header_of("ORCA2_T", 182, 149, "T"), header_of("ORCA2_V", 182, 149, "V")
G1T = header_of("ORCA1_T", 362, 292, "T")
G025 = header_of("ORCA025_T", 1442, 1021, "T")


def query(oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL if there is any."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if oracle is not None:
            ORACLES[key] = oracle
        return f

    return put


# --- registry -------------------------------------------------------------------------------------------------------

KNOWN = [registry.DEFAULT_BASE + "/v0", "https://mirror.example.org/grids"]


def _registry_values() -> str:
    rows = []
    for name, own in registry.UIDS.items():
        grid, arrangement = name.rsplit("_", 1)
        ni, nj = registry.DIMENSIONS[grid]
        url = f"{registry.DEFAULT_BASE}/v0/{grid}_{'T' if arrangement == 'W' else arrangement}.grid"
        for key in (name, own, registry.OLD_UIDS.get(name)):
            if key:
                rows.append(f"('{key}', {str(key != name).lower()}, '{registry.GRID_TYPE}', '{grid}', '{arrangement}', {ni}, {nj}, '{own}', '{url}')")
    return f"reg(key, is_uid, grid_type, grid_name, arrangement, ni, nj, uid, data_url) AS (VALUES {', '.join(rows)})"


REG = _registry_values()
ASKED = ["orca2_t", "ORCA2_T", "EORCA1_v", "eorca025_W", "D5BDE4F52FF3A9BEA5629CD9AC514410", "16076978a048410747dd7c9876677b28", "ORCA7_T", "ORCA2_X", ""]
URLS = [f"{KNOWN[0]}/ORCA2_T.grid", f"{KNOWN[1]}/v1/eORCA12_F.grid", "https://elsewhere.example.net/a/b/grid.grid", "/data/grids/ORCA1_T.grid", "relative/ORCA1_T.grid"]


@query(f"WITH {REG} SELECT * FROM reg")
def registry_scan(spark, sf_dir):
    return registry.specs(spark)


@query(f"""WITH {REG}, asked(asked) AS (VALUES {", ".join(f"('{a}')" for a in ASKED)})
SELECT asked, coalesce(u.key, n.key) AS key, coalesce(u.grid_name, n.grid_name) AS grid_name, coalesce(u.arrangement, n.arrangement) AS arrangement, coalesce(u.ni, n.ni, 0) AS ni, coalesce(u.nj, n.nj, 0) AS nj
FROM asked LEFT JOIN reg u ON u.key = lower(asked) LEFT JOIN reg n ON n.key = regexp_replace(upper(asked), '^E', 'e')""")
def registry_alias_lookup(spark, sf_dir):
    asked = spark.createDataFrame([(a,) for a in ASKED], "asked string")
    return registry.resolve(asked, registry.specs(spark)).select("asked", "key", "grid_name", "arrangement", F.coalesce("ni", F.lit(0)).alias("ni"), F.coalesce("nj", F.lit(0)).alias("nj"))


@query(f"""WITH asked(asked) AS (VALUES {", ".join(f"('{a}')" for a in ASKED)})
SELECT asked, lower(asked) AS as_uid, regexp_replace(upper(asked), '^E', 'e') AS as_name, regexp_matches(regexp_replace(upper(asked), '^E', 'e'), '{registry.NAME_PATTERN}') AS is_name FROM asked""")
def registry_name_normalise(spark, sf_dir):
    asked = spark.createDataFrame([(a,) for a in ASKED], "asked string")
    name = registry.as_name(F.col("asked"))
    return asked.select("asked", registry.as_uid(F.col("asked")).alias("as_uid"), name.alias("as_name"), name.rlike(registry.NAME_PATTERN).alias("is_name"))


@query(f"WITH {REG} SELECT DISTINCT data_url FROM reg WHERE starts_with(data_url, 'http')")
def registry_distinct_urls(spark, sf_dir):
    return registry.downloads(registry.specs(spark))


@query(f"WITH {REG} SELECT DISTINCT data_url FROM reg WHERE key IN ('ORCA2_T', 'ORCA2_W', 'eORCA1_V')")
def registry_chosen_urls(spark, sf_dir):
    return registry.downloads(registry.specs(spark), "ORCA2_T, ORCA2_W;eORCA1_V")


@query(f"""WITH {REG} SELECT key, CASE WHEN grid_name <> '' AND arrangement <> '' THEN grid_name || '_' || arrangement ELSE uid END AS name, 'Orca(' || grid_name || '_' || arrangement || ')' AS label FROM reg""")
def registry_spec_name(spark, sf_dir):
    s = registry.specs(spark)
    name = registry.spec_name(F.col("grid_name"), F.col("arrangement"), F.col("uid"))
    return s.select("key", name.alias("name"), F.format_string("Orca(%s)", name).alias("label"))


@query(f"""WITH urls(url) AS (VALUES {", ".join(f"('{u}')" for u in URLS)})
SELECT url, CASE WHEN NOT starts_with(url, 'http') THEN url {" ".join(f"WHEN starts_with(url, '{k}') THEN '{registry.CACHE_FOLDER}' || substr(url, {len(k) + 1})" for k in KNOWN)}
ELSE '{registry.CACHE_FOLDER}/unknown' || regexp_extract(url, '(/[^/]*)$', 1) END AS path FROM urls""")
def url_cached_path(spark, sf_dir):
    urls = spark.createDataFrame([(u,) for u in URLS], "url string")
    return urls.select("url", registry.cached_path(F.col("url"), KNOWN).alias("path"))


@query("""SELECT r AS n, CASE WHEN r < 1024 THEN printf('%.1f', r::DOUBLE) || ' B' WHEN r < 1048576 THEN printf('%.1f', r / 1024.0::DOUBLE) || ' KiB' WHEN r < 1073741824 THEN printf('%.1f', r / 1048576.0::DOUBLE) || ' MiB' ELSE printf('%.1f', r / 1073741824.0::DOUBLE) || ' GiB' END AS size
FROM (SELECT (i * i * i * 97 + 13)::BIGINT AS r FROM range(0, 300) t(i))""")
def pretty_sizes(spark, sf_dir):
    n = spark.range(300).select((F.col("id") * F.col("id") * F.col("id") * 97 + 13).alias("n"))
    return n.select("n", registry.pretty_bytes(F.col("n")).alias("size"))


@query(f"""WITH {REG} SELECT grid_name || '_' || arrangement AS name, concat_ws(chr(10), grid_name || '_' || arrangement || ': &' || grid_name || '_' || arrangement, '    type: ' || grid_type,
'    orca_arrangement: ' || arrangement, '    orca_name: ' || grid_name, '    dimensions: [' || ni || ',' || nj || ']', '    uid: ' || uid,
'    data: {{{{location}}}}/' || string_split(data_url, '/')[-1], uid || ': *' || grid_name || '_' || arrangement) AS yaml FROM reg WHERE NOT is_uid""")
def yaml_spec(spark, sf_dir):
    return registry.spec_yaml(registry.specs(spark).where("not is_uid"))


@query(f"WITH {REG} SELECT * FROM reg")
def registry_from_text(spark, sf_dir):
    """The registry's text, as a file would hold it, read back."""
    entries = registry.spec_yaml(registry.specs(spark).where("not is_uid"), f"{registry.DEFAULT_BASE}/v0")
    old = "\n".join(f"{key}: *{name}" for name, key in registry.OLD_UIDS.items())
    return registry.parse_specs(entries.agg(F.concat(F.array_join(F.collect_list("yaml"), "\n\n"), F.lit("\n" + old)).alias("value")))


@query(f"""WITH {REG} SELECT key, 'global' AS domain, 0.0::DOUBLE AS west, 360.0::DOUBLE AS east, (-90.0)::DOUBLE AS south, 90.0::DOUBLE AS north, grid_type AS type FROM reg""")
def grid_domain(spark, sf_dir):
    d = catalog.DOMAIN
    return registry.specs(spark).select("key", F.lit(d["type"]).alias("domain"), *[F.lit(d[k]).alias(k) for k in ("west", "east", "south", "north")], F.col("grid_type").alias("type"))


def _grids(spark: SparkSession) -> DataFrame:
    return registry.specs(spark).where("not is_uid").select(F.col("key").alias("grid"), "ni", "nj", "arrangement")


_T = "CASE arrangement WHEN 'F' THEN {F} WHEN 'U' THEN {U} WHEN 'V' THEN {V} ELSE {T} END"
_HEADERS = f"""WITH {REG}, g AS (SELECT key AS grid, arrangement, ni, nj, ni - 2 = 360 AS ff FROM reg WHERE NOT is_uid),
h AS (SELECT grid, arrangement, ni, nj, (CASE WHEN ff THEN 1 ELSE {_T.format(F=2, U=1, V=2, T=1)} END)::INTEGER AS halo_n, 1 AS halo_w, (CASE WHEN arrangement = 'F' THEN 0 ELSE 1 END)::INTEGER AS halo_s, 1 AS halo_e,
 (ni // 2 - ff::INTEGER + CASE WHEN ff THEN {_T.format(F=0, U=0, V=0.5, T=0.5)} ELSE {_T.format(F=-0.5, U=-0.5, V=0, T=0)} END)::DOUBLE AS pivot_i,
 (nj - 2 + CASE WHEN ff THEN {_T.format(F=0, U=0.5, V=0, T=0.5)} ELSE {_T.format(F=-0.5, U=0, V=-0.5, T=0)} END)::DOUBLE AS pivot_j FROM g)
SELECT *, ni - halo_w - halo_e AS nx, nj - halo_s - halo_n AS ny, ni::BIGINT * nj AS size, ni::BIGINT * nj * 16 + 2 * (ni::BIGINT * nj // 8) AS footprint FROM h"""


@query(_HEADERS)
def grid_sizes(spark, sf_dir):
    return derive_headers(_grids(spark))


@query(f"""WITH x AS ({_HEADERS}) SELECT grid, '[' || ni || ',' || nj || ']' AS dimensions, '[' || halo_n || ',' || halo_w || ',' || halo_s || ',' || halo_e || ']' AS halo, '360/' || nx AS resolution FROM x""")
def summary_report(spark, sf_dir):
    h = derive_headers(_grids(spark))
    return h.select("grid", F.format_string("[%d,%d]", "ni", "nj").alias("dimensions"), F.format_string("[%d,%d,%d,%d]", "halo_n", "halo_w", "halo_s", "halo_e").alias("halo"), F.format_string("360/%d", "nx").alias("resolution"))


# --- index maps -----------------------------------------------------------------------------------------------------


@query(f"""WITH {sql.spine(G2T)} SELECT n, i, j, (i + {G2T.halo_w})::BIGINT + (j + {G2T.halo_s})::BIGINT * {G2T.ni} AS n_again FROM pts""")
def index_roundtrip(spark, sf_dir):
    p = points.spine(spark, G2T).select("n")
    i, j = fold.core_of_linear(F.col("n"), G2T)
    return p.select("n", i.alias("i"), j.alias("j")).withColumn("n_again", fold.linear(F.col("i"), F.col("j"), G2T))


def _periodic(h: Header) -> Query:
    def run(spark, sf_dir):
        return points.with_master(points.spine(spark, h), h).select("n", "i", "j", "mi", "mj", "n_master")

    return run


for _h, _name in ((G2T, "periodic_index_t_pivot"), (G1T, "periodic_index_f_pivot"), (G2V, "periodic_index_v_half")):
    query(f"WITH {sql.masters(_h)} SELECT n, i, j, mi, mj, n_master FROM grid", _name)(_periodic(_h))


@query(f"""WITH far AS (SELECT i::INTEGER AS i, j::INTEGER AS j, (i + {G2T.halo_w})::INTEGER AS ih, (j + {G2T.halo_s})::INTEGER AS jh FROM range(-10, {G2T.nx + 11}) a(i), range(-1, {G2T.ny + 11}) b(j)),
{sql.fold("far", "f", G2T)} SELECT i, j, mj::BIGINT * {G2T.ni} + mi AS n_master FROM f""")
def periodic_beyond_halo(spark, sf_dir):
    far = spark.range(-1, G2T.ny + 11).select(F.col("id").cast("int").alias("j"), F.explode(F.sequence(F.lit(-10), F.lit(G2T.nx + 10))).alias("i"))
    pi, pj = fold.periodic(F.col("i"), F.col("j"), G2T)
    return far.withColumns({"pi": pi, "pj": pj}).select("i", "j", fold.linear(F.col("pi"), F.col("pj"), G2T).alias("n_master"))


@query(f"WITH {sql.masters(G2T)} SELECT n, i, j, ghost FROM grid")
def ghost_flags(spark, sf_dir):
    return points.with_ghost(points.spine(spark, G2T), G2T).select("n", "i", "j", "ghost")


@query(f"WITH {sql.masters(G1T)} SELECT j, count(*) AS points, count(*) FILTER (WHERE ghost) AS ghosts FROM grid GROUP BY j")
def ghost_count_by_row(spark, sf_dir):
    return points.with_ghost(points.spine(spark, G1T), G1T).groupBy("j").agg(F.count(F.lit(1)).alias("points"), F.count_if("ghost").alias("ghosts"))


@query(f"WITH {sql.masters(G025)} SELECT n_master, count(*) AS points FROM grid GROUP BY n_master HAVING count(*) > 1")
def master_fanout(spark, sf_dir):
    return points.with_master(points.spine(spark, G025), G025).groupBy("n_master").agg(F.count(F.lit(1)).alias("points")).where("points > 1")


@query(f"""WITH far AS (SELECT i::INTEGER AS gi, j::INTEGER AS gj FROM range(-4, {G2T.nx + 5}) a(i), range(-4, {G2T.ny + 5}) b(j)),
{sql.turned("far", "t", G2T, "gi", "gj")} SELECT gi, gj, pi, pj, pi <> gi OR pj <> gj AS periodic FROM t""")
def rect_periodic_ij(spark, sf_dir):
    far = spark.range(-4, G2T.ny + 5).select(F.col("id").cast("int").alias("gj"), F.explode(F.sequence(F.lit(-4), F.lit(G2T.nx + 4))).alias("gi"))
    pi, pj = fold.core_periodic(F.col("gi"), F.col("gj"), G2T)
    return far.select("gi", "gj", pi.alias("pi"), pj.alias("pj")).withColumn("periodic", (F.col("pi") != F.col("gi")) | (F.col("pj") != F.col("gj")))


@query("""SELECT r AS n, ((r % 2) + 2 * (r // 2 % 2) + 4 * (r // 4 % 2))::INTEGER AS flags, r % 2 = 1 AS ghost, r // 2 % 2 = 1 AS water, r // 4 % 2 = 1 AS invalid,
((r % 2) + 2 + 4 * (r // 4 % 2))::INTEGER AS with_water, ((r % 2) + 2 * (r // 2 % 2))::INTEGER AS without_invalid FROM range(64) t(r)""")
def flag_bits_roundtrip(spark, sf_dir):
    n = F.col("id")
    byte = fold.flag_byte(ghost=n % 2 == 1, water=F.floor(n / 2) % 2 == 1, invalid=F.floor(n / 4) % 2 == 1)
    f = F.col("flags")
    return spark.range(64).select(n.alias("n"), byte.alias("flags")).select("n", "flags", *[fold.flag_set(f, k).alias(k) for k in fold.FLAG_BITS], fold.with_flag(f, "water").alias("with_water"), fold.without_flag(f, "invalid").alias("without_invalid"))


@query(f"WITH {sql.masters(G2T)} SELECT min(n) AS first_n, max(n) AS last_n, count(*) AS points, count(DISTINCT (i, j)) AS distinct_ij FROM grid")
def scan_ends(spark, sf_dir):
    return points.spine(spark, G2T).agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.count(F.lit(1)).alias("points"), F.countDistinct("i", "j").alias("distinct_ij"))


# --- observations on grids ------------------------------------------------------------------------------------------

_CENTS = "(sum(round(l_extendedprice * 100)::BIGINT))::BIGINT AS cents, count(*) AS n_obs"


def _line_key():
    return F.col("l_orderkey") * 7 + F.col("l_linenumber")


def _values(spark, sf_dir, h: Header) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents")
    return field.on_points(rows, _line_key(), h, cents, F.count(F.lit(1)).alias("n_obs"))


def _values_sql(h: Header) -> str:
    return f"""{sql.masters(h)}, vals AS (SELECT n_master, {_CENTS} FROM lineitem JOIN grid ON n = (l_orderkey * 7 + l_linenumber) % {h.size} GROUP BY n_master)"""


@query(f"WITH {_values_sql(G2T)} SELECT * FROM vals")
def obs_node_value(spark, sf_dir):
    return _values(spark, sf_dir, G2T)


@query(f"WITH {_values_sql(G025)} SELECT * FROM vals")
def obs_node_value_quarter_degree(spark, sf_dir):
    return _values(spark, sf_dir, G025)


@query(f"WITH {_values_sql(G2T)} SELECT g.n, g.n_master, cents, n_obs FROM grid g JOIN vals USING (n_master) WHERE g.n <> g.n_master")
def obs_halo_exchange(spark, sf_dir):
    grid = points.with_master(points.spine(spark, G2T), G2T)
    return field.to_ghosts(_values(spark, sf_dir, G2T), grid).select("n", "n_master", "cents", "n_obs")


@query(f"""SELECT (event_id % {G2T.size} % {G2T.ni}) // 10 AS block_i, (event_id % {G2T.size} // {G2T.ni}) // 10 AS block_j, event_type, count(*) AS events, (sum(round(value * 100)::BIGINT))::BIGINT AS cents
FROM events GROUP BY ALL""")
def obs_event_cell(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.pmod(F.col("event_id"), F.lit(G2T.size))
    block = (F.floor((n % G2T.ni) / 10).alias("block_i"), F.floor(F.floor(n / G2T.ni) / 10).alias("block_j"))
    return e.groupBy(*block, "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


@query(f"""WITH {_values_sql(G2T)}, f AS (SELECT n_obs::DOUBLE AS value, (n_obs + CASE WHEN n_master % 10 = 0 THEN 1 ELSE 0 END)::DOUBLE AS expected FROM vals)
SELECT round(sqrt(sum((value - expected) * (value - expected))), 6) AS l2, count(*) FILTER (WHERE abs(value - expected) > 1e-6) AS mismatches FROM f""")
def field_error_norm(spark, sf_dir):
    v = _values(spark, sf_dir, G2T)
    f = v.select(F.col("n_obs").cast("double").alias("value"), (F.col("n_obs") + (F.col("n_master") % 10 == 0).cast("int")).cast("double").alias("expected"))
    return field.error_norm(f).select(F.round("l2", 6).alias("l2"), "mismatches")


# --- halo consistency and element quality -----------------------------------------------------------------------------


def _lon():
    return (F.lit(73) + (F.col("mi") - 1) * 2).cast("double")


def _lat():
    return F.lit(-78) + F.col("mj") * 168 / 149


def _water():
    return (F.floor(F.col("mi") / 20) + F.floor(F.col("mj") / 15)) % 3 != 0


def _bent_lon():
    mi, mj = F.col("mi"), F.col("mj")
    return _lon() + F.when((mi * 5 + mj * 3) % 101 == 0, -6.0).when((mi == 150) & (mj % 7 == 2), 1.2).otherwise(0.0)


def _bent_lat():
    mi, mj = F.col("mi"), F.col("mj")
    return _lat() + F.when((mi == 60) & (mj % 10 == 3), 8).when((mi == 64) & (mj % 20 == 3), 24).otherwise(0)


def _plain(spark, h: Header = G2T) -> DataFrame:
    return points.grid_points(spark, h, _lon(), _lat(), _water())


def _bent(spark) -> DataFrame:
    return points.grid_points(spark, G2T, _bent_lon(), _bent_lat(), _water())


def _disturbed(spark) -> DataFrame:
    g = _plain(spark)
    away = F.col("n") != F.col("n_master")
    lon = F.when(away & ((F.col("ih") * 7 + F.col("jh") * 13) % 97 == 0), F.col("lon") + 0.5).otherwise(F.col("lon"))
    water = F.when(away & ((F.col("ih") * 7 + F.col("jh") * 13) % 89 == 0), ~F.col("water")).otherwise(F.col("water"))
    return g.withColumns({"lon": lon, "water": water})


_DISTURBED = f"""{sql.masters(G2T)}, geo AS (SELECT *, {sql.LON} AS lon0, {sql.LAT} AS lat, {sql.WATER} AS water0 FROM grid),
dist AS (SELECT *, CASE WHEN n <> n_master AND (ih * 7 + jh * 13) % 97 = 0 THEN lon0 + 0.5::DOUBLE ELSE lon0 END AS lon,
 CASE WHEN n <> n_master AND (ih * 7 + jh * 13) % 89 = 0 THEN NOT water0 ELSE water0 END AS water FROM geo),
rep AS (SELECT a.n, a.n_master, b.lon, b.lat, b.water, a.water <> b.water AS mask_differs, a.lon <> b.lon OR a.lat <> b.lat AS coordinates_differ FROM dist a JOIN dist b ON b.n = a.n_master)"""


@query(f"WITH {_DISTURBED} SELECT n, n_master, lon, lat, water FROM rep")
def halo_consistency_repair(spark, sf_dir):
    return quality.halo_repaired(_disturbed(spark)).select("n", "n_master", "lon", "lat", "water")


@query(f"WITH {_DISTURBED} SELECT n, n_master, mask_differs, coordinates_differ FROM rep WHERE mask_differs OR coordinates_differ")
def halo_inconsistency_report(spark, sf_dir):
    return quality.halo_repaired(_disturbed(spark)).where("mask_differs or metres > 1").select("n", "n_master", "mask_differs", "coordinates_differ")


_C = ", ".join(f"{col}_{c}" for c in quality.CORNERS for col in ("lon", "lat", "water"))


@query(f"WITH {sql.corners(G2T, sql.LON, sql.LAT)} SELECT ih, jh, {_C} FROM cell")
def cell_corners(spark, sf_dir):
    return quality.cell_corners(_plain(spark), G2T)


@query(f"WITH {sql.corners(G2T, sql.LON, sql.LAT)} SELECT ih, jh, water_sw OR water_se OR water_ne OR water_nw AS wet, NOT (water_sw AND water_se AND water_ne AND water_nw) AS has_land FROM cell")
def cell_wet_dry(spark, sf_dir):
    w = [F.col(f"water_{c}") for c in quality.CORNERS]
    return quality.cell_corners(_plain(spark), G2T).select("ih", "jh", (w[0] | w[1] | w[2] | w[3]).alias("wet"), (~(w[0] & w[1] & w[2] & w[3])).alias("has_land"))


def _classes(spark, with_3d: bool = False) -> DataFrame:
    return quality.classified(quality.cell_corners(_bent(spark), G2T), G2T, with_3d=with_3d)


@query(f"WITH {sql.classes(G2T)} SELECT * FROM elem WHERE element_class <> 'ok'")
def element_class(spark, sf_dir):
    return _classes(spark).where("element_class <> 'ok'")


@query(f"""WITH {sql.classes(G2T)} SELECT count(*) FILTER (WHERE element_class <> 'ok') AS invalid_elements, count(*) FILTER (WHERE element_class = 'quad2d') AS invalid_quads_2d, count(*) FILTER (WHERE element_class = 'quad3d') AS invalid_quads_3d,
count(*) FILTER (WHERE element_class = 'diagonal') AS diagonal_too_large, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE NOT has_water) AS dry FROM elem""")
def element_statistics(spark, sf_dir):
    return quality.statistics(_classes(spark))


for _kind in ("quad2d", "diagonal", "two_degree"):
    query(f"WITH {sql.classes(G2T)} SELECT ih, jh, has_water, flagged FROM elem WHERE element_class = '{_kind}'", f"element_{_kind}")(lambda spark, sf_dir, k=_kind: _classes(spark).where(F.col("element_class") == k).select("ih", "jh", "has_water", "flagged"))


@query(f"WITH {sql.classes(G2T)} SELECT element_class, has_water, count(*) AS cells, count(*) FILTER (WHERE flagged) AS flagged FROM elem GROUP BY ALL")
def element_wet_exemption(spark, sf_dir):
    return _classes(spark).groupBy("element_class", "has_water").agg(F.count(F.lit(1)).alias("cells"), F.count_if("flagged").alias("flagged"))


def _apart_sql() -> str:
    """Corner normals of every cell on the unit sphere, and in `apart` the cells of which any pair points apart."""
    c = quality.CORNERS
    xyz = ", ".join(f"cos(radians(lat_{p})) * cos(radians(x_{p})) AS a{k}, cos(radians(lat_{p})) * sin(radians(x_{p})) AS b{k}, sin(radians(lat_{p})) AS c{k}" for k, p in enumerate(c))
    norm = []
    for k in range(4):
        u, v = (k + 1) % 4, (k - 1) % 4
        d = lambda x, q: f"({x}{q} - {x}{k})"  # noqa: E731, B023
        norm.append(f"{d('b', u)} * {d('c', v)} - {d('c', u)} * {d('b', v)} AS p{k}, {d('c', u)} * {d('a', v)} - {d('a', u)} * {d('c', v)} AS q{k}, {d('a', u)} * {d('b', v)} - {d('b', u)} * {d('a', v)} AS r{k}")
    bad = " OR ".join(f"p{a} * p{b} + q{a} * q{b} + r{a} * r{b} < -1e-12" for a in range(4) for b in range(a + 1, 4))
    return f"s AS (SELECT ih, jh, {xyz} FROM cell), t AS (SELECT ih, jh, {', '.join(norm)} FROM s), apart AS (SELECT ih, jh FROM t WHERE {bad})"


def _classes_3d_sql() -> str:
    """All four rules: the third comes before the fourth."""
    kind = "CASE WHEN element_class IN ('quad2d', 'diagonal') THEN element_class WHEN p.ih IS NOT NULL THEN 'quad3d' ELSE element_class END"
    flagged = "element_class <> 'ok' AND (NOT has_water OR huge) AS flagged"
    return f"""{sql.classes(G2T)}, {_apart_sql()}, kind3 AS (SELECT k.ih, k.jh, {kind} AS element_class, has_water, huge FROM kind k LEFT JOIN apart p ON p.ih = k.ih AND p.jh = k.jh),
elem3 AS (SELECT ih, jh, element_class, has_water, {flagged} FROM kind3)"""


@query(f"WITH {_classes_3d_sql()} SELECT * FROM elem3 WHERE element_class <> 'ok'")
def element_class_all_rules(spark, sf_dir):
    return _classes(spark, True).where("element_class <> 'ok'")


@query(f"""WITH {_classes_3d_sql()} SELECT count(*) FILTER (WHERE element_class <> 'ok') AS invalid_elements, count(*) FILTER (WHERE element_class = 'quad2d') AS invalid_quads_2d, count(*) FILTER (WHERE element_class = 'quad3d') AS invalid_quads_3d,
count(*) FILTER (WHERE element_class = 'diagonal') AS diagonal_too_large, count(*) FILTER (WHERE flagged) AS flagged, count(*) FILTER (WHERE NOT has_water) AS dry FROM elem3""")
def element_statistics_all_rules(spark, sf_dir):
    return quality.statistics(_classes(spark, True))


@query(f"""WITH {_classes_3d_sql()} SELECT '{G2T.grid}' AS grid, '360/{G2T.nx}' AS resolution, '[{G2T.ni},{G2T.nj}]' AS dimensions, '[{G2T.halo_n},{G2T.halo_w},{G2T.halo_s},{G2T.halo_e}]' AS halo, {G2T.pivot_i}::DOUBLE AS pivot_i, {G2T.pivot_j}::DOUBLE AS pivot_j,
count(*) FILTER (WHERE element_class <> 'ok') AS invalid_elements, count(*) FILTER (WHERE element_class = 'quad2d') AS invalid_quads_2d, count(*) FILTER (WHERE element_class = 'quad3d') AS invalid_quads_3d, count(*) FILTER (WHERE element_class = 'diagonal') AS diagonal_too_large FROM elem3""")
def conversion_summary(spark, sf_dir):
    """What the conversion tool reports of a grid, but for its hash."""
    h = G2T
    told = {"grid": h.grid, "resolution": f"360/{h.nx}", "dimensions": f"[{h.ni},{h.nj}]", "halo": f"[{h.halo_n},{h.halo_w},{h.halo_s},{h.halo_e}]", "pivot_i": h.pivot_i, "pivot_j": h.pivot_j}
    return quality.statistics(_classes(spark, True)).select(*[F.lit(v).alias(k) for k, v in told.items()], "invalid_elements", "invalid_quads_2d", "invalid_quads_3d", "diagonal_too_large")


@query(f"WITH {sql.corners(G2T, sql.BENT_LON, sql.BENT_LAT)}, {_apart_sql()} SELECT ih, jh FROM apart")
def element_quad3d(spark, sf_dir):
    west = F.col("lon_sw") - 180.0
    p = [(F.col("lon_sw") if c == "sw" else geometry.normalised(F.col(f"lon_{c}"), west), F.col(f"lat_{c}")) for c in quality.CORNERS]
    return quality.cell_corners(_bent(spark), G2T).where(geometry.invalid_quad_3d(*p)).select("ih", "jh")


@query(f"""WITH {sql.masters(G2T)}, geo AS (SELECT n, {sql.LON} AS lon, {sql.LAT} AS lat FROM grid)
SELECT n, round(2 * {geometry.EARTH_RADIUS} * asin(sqrt(least(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon - 80) / 2), 2), 1.0))) / 1000, 3) AS km FROM geo""")
def sphere_distance(spark, sf_dir):
    d = geometry.sphere_distance((F.lit(80.0), F.lit(10.0)), (F.col("lon"), F.col("lat")))
    return _plain(spark).select("n", F.round(d / 1000, 3).alias("km"))


# --- partitions, local grids, meshes ----------------------------------------------------------------------------------


def _owner_query(parts: int, bands: int, h: Header = G2T) -> Query:
    return lambda spark, sf_dir: partition.owners(spark, h, parts, bands)


for _parts, _bands in ((2, 1), (4, 2), (6, 2), (7, 1)):
    query(f"WITH {sql.owner(G2T, _parts, _bands)} SELECT * FROM owner", f"checkerboard_partition_{_parts}")(_owner_query(_parts, _bands))


for _parts, _bands in ((4, 2), (15, 3)):
    query(
        f"""WITH core AS (SELECT r AS n, (r % {G2T.nx})::INTEGER AS ix, (r // {G2T.nx})::INTEGER AS iy FROM range({G2T.nx * G2T.ny}) t(r)),
rows AS (SELECT iy, ntile({_bands}) OVER (ORDER BY iy) - 1 AS band FROM (SELECT DISTINCT iy FROM core)), cols AS (SELECT ix, ntile({_parts // _bands}) OVER (ORDER BY ix) - 1 AS place FROM (SELECT DISTINCT ix FROM core))
SELECT n, ix, iy, (band * {_parts // _bands} + place)::INTEGER AS part FROM core JOIN rows USING (iy) JOIN cols USING (ix)""",
        f"regular_partition_{_parts}",
    )(lambda spark, sf_dir, p=_parts, b=_bands: partition.owners(spark, G2T, p, b, "regular_checkerboard"))


@query(f"""SELECT r AS n, (r % {G2T.nx})::INTEGER AS ix, (r // {G2T.nx})::INTEGER AS iy, round(r % {G2T.nx} * 360.0::DOUBLE / {G2T.nx}, 9) AS lon, round(-80 + (r // {G2T.nx}) * 170.0::DOUBLE / {G2T.ny - 1}, 9) AS lat FROM range({G2T.nx * G2T.ny}) t(r)""")
def regular_grid(spark, sf_dir):
    return partition.regular_grid(spark, G2T).select("n", "ix", "iy", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


class Decomposition:
    """The relations from owners to mesh of one grid, number of parts and halo, each derived from the one before."""

    def __init__(self, spark: SparkSession, h: Header, parts: int, bands: int, halo: int):
        partition.check_halo(parts, halo)
        self.h, self.parts = h, parts
        self.owner = partition.owners(spark, h, parts, bands)
        self.rect = partition.rectangles(self.owner, halo)
        self.rect_points = partition.rectangle_points(self.rect, self.owner, h, halo)
        self.extents = local_grid.extents(self.rect, h)
        self.local = local_grid.local_points(self.extents, self.rect_points, h)
        self.nodes = mesh.nodes(self.local, self.owner, h, parts)


#: (suffix, grid, parts, bands, halo) of the decompositions that are queried.
CASES = {"": (G2T, 2, 1, 1), "_wide": (G2T, 4, 2, 2), "_serial": (G1T, 1, 1, 0), "_v": (G2V, 2, 1, 2)}
_LOCAL = "mypart, ix, iy, gi, gj, hi, hj, n_haloed, n_master, part, halo, is_ghost, is_ghost_own_halo, is_cell"
_NODE = "mypart, inode, gi, gj, glb_idx, master_glb_idx, remote_idx, part, ghost, halo"


QUARTER = (G025, 6, 2, 1)


def _decomposed(name: str, oracle: str, pick: Callable[[Decomposition], DataFrame], case: str) -> None:
    query(oracle, name + case)(lambda spark, sf_dir: pick(Decomposition(spark, *(QUARTER if case == "_quarter_degree" else CASES[case]))))


for _case, _c in CASES.items():
    _decomposed("rect_bounds", f"WITH {sql.rectangles(*_c)} SELECT * FROM rect", lambda d: d.rect, _case)
    _decomposed("rect_points", f"WITH {sql.rectangle_points(*_c)} SELECT * FROM rect_point", lambda d: d.rect_points, _case)
    _decomposed("local_extents", f"WITH {sql.rectangles(*_c)}, {sql.extents(_c[0])} SELECT * FROM ext", lambda d: d.extents, _case)
    _decomposed("local_points", f"WITH {sql.local_points(*_c)} SELECT {_LOCAL} FROM loc", lambda d: d.local.select(*_LOCAL.split(", ")), _case)
    _decomposed("mesh_nodes", f"WITH {sql.nodes(*_c)} SELECT {_NODE} FROM node", lambda d: d.nodes.select(*_NODE.split(", ")), _case)
    _decomposed("mesh_cells", f"WITH {sql.cells(*_c, mesh.is_patched(_c[0]))} SELECT * FROM cell", lambda d: mesh.cells(d.nodes, d.h), _case)
    if _c[1] > 1:
        _decomposed("remote_index", f"WITH {sql.links(*_c)} SELECT * FROM link", lambda d: mesh.linked(d.nodes), _case)

_decomposed("mesh_numbers", f"WITH {sql.nodes(G025, 6, 2, 1)} SELECT mypart, is_ghost, min(inode) AS first_node, max(inode) AS last_node, count(*) AS nodes, sum(inode * ((gi + 7) * 31 + gj + 11) % 1000003)::BIGINT AS digest FROM node GROUP BY ALL", lambda d: d.nodes.groupBy("mypart", "is_ghost").agg(F.min("inode").alias("first_node"), F.max("inode").alias("last_node"), F.count(F.lit(1)).alias("nodes"), F.sum(F.col("inode") * ((F.col("gi") + 7) * 31 + F.col("gj") + 11) % 1000003).alias("digest")), "_quarter_degree")
_decomposed("local_index", f"WITH {sql.local_points(*CASES['_wide'])} SELECT mypart, gi, gj, iy::BIGINT * (max(ix) OVER (PARTITION BY mypart) + 1) + ix AS n_local FROM loc", lambda d: local_grid.with_index(d.local).select("mypart", "gi", "gj", "n_local"), "_wide")
_C4 = CASES["_wide"]
_decomposed("rect_halo_distance", f"WITH {sql.rectangle_points(*_C4)} SELECT mypart, halo, count(*) AS points FROM rect_point GROUP BY ALL", lambda d: d.rect_points.groupBy("mypart", "halo").agg(F.count(F.lit(1)).alias("points")), "_wide")
_decomposed("local_ghosts", f"WITH {sql.local_points(*_C4)} SELECT mypart, gi, gj, is_ghost FROM loc WHERE is_ghost_own_halo", lambda d: d.local.where("is_ghost_own_halo").select("mypart", "gi", "gj", "is_ghost"), "_wide")
_decomposed("haloed_index", f"WITH {sql.local_points(*_C4)} SELECT mypart, gi, gj, hi, hj, n_haloed FROM loc WHERE hi <> gi OR hj <> gj", lambda d: d.local.where("hi <> gi or hj <> gj").select("mypart", "gi", "gj", "hi", "hj", "n_haloed"), "_wide")
_COUNTS = """SELECT mypart, count(*) AS nodes, count(*) FILTER (WHERE NOT is_ghost) AS real_nodes, count(*) FILTER (WHERE is_ghost) AS ghost_nodes, count(*) FILTER (WHERE is_ghost_own_halo) AS ghost_flags,
count(*) FILTER (WHERE is_cell AND NOT is_ghost) AS real_cells, count(*) FILTER (WHERE is_cell AND is_ghost) AS ghost_cells FROM loc GROUP BY mypart"""
for _case in ("", "_wide"):
    _decomposed("local_counts", f"WITH {sql.local_points(*CASES[_case])} {_COUNTS}", lambda d: local_grid.counters(d.local), _case)
_decomposed(
    "mesh_nodes_linked",
    f"""WITH {sql.links(*_C4)} SELECT n.mypart, n.inode, coalesce(l.remote_idx, n.remote_idx) AS remote_idx, coalesce(l.remote_part, n.part) AS part, coalesce(l.remote_glb_idx, n.glb_idx) AS glb_idx, n.ghost
FROM node n LEFT JOIN link l ON l.mypart = n.mypart AND l.inode = n.inode AND l.remote_idx IS NOT NULL""",
    lambda d: mesh.with_links(d.nodes).select("mypart", "inode", "remote_idx", "part", "glb_idx", "ghost"),
    "_wide",
)
_decomposed("remote_index_unresolved", f"WITH {sql.links(*_C4)} SELECT count(*) FILTER (WHERE remote_idx IS NULL) AS unresolved, count(*) AS ghosts FROM link", lambda d: mesh.linked(d.nodes).agg(F.count_if(F.col("remote_idx").isNull()).alias("unresolved"), F.count(F.lit(1)).alias("ghosts")), "_wide")
_decomposed("owner_uniqueness", f"WITH {sql.nodes(*_C4)} SELECT count(*) AS owners, count(DISTINCT (mypart, master_glb_idx)) AS distinct_owners FROM node WHERE NOT ghost", lambda d: d.nodes.where("not ghost").agg(F.count(F.lit(1)).alias("owners"), F.countDistinct("mypart", "master_glb_idx").alias("distinct_owners")), "_wide")
_decomposed("node_numbering", f"WITH {sql.nodes(*CASES[''])} SELECT mypart, is_ghost, min(inode) AS first_node, max(inode) AS last_node, count(*) AS nodes FROM node GROUP BY ALL", lambda d: d.nodes.groupBy("mypart", "is_ghost").agg(F.min("inode").alias("first_node"), F.max("inode").alias("last_node"), F.count(F.lit(1)).alias("nodes")), "")
_PATCH = mesh.is_patched(_C4[0])
_decomposed("cell_halo", f"WITH {sql.cells(*_C4, _PATCH)} SELECT mypart, halo, count(*) AS cells FROM cell GROUP BY ALL", lambda d: mesh.cells(d.nodes, d.h).groupBy("mypart", "halo").agg(F.count(F.lit(1)).alias("cells")), "_wide")
_decomposed("cell_fold_part", f"WITH {sql.cells(*_C4, _PATCH)} SELECT mypart, part, f_ghost, count(*) AS cells FROM cell GROUP BY ALL", lambda d: mesh.cells(d.nodes, d.h).groupBy("mypart", "part", "f_ghost").agg(F.count(F.lit(1)).alias("cells")), "_wide")
_decomposed("cell_numbering", f"WITH {sql.cells(*_C4, _PATCH)} SELECT mypart, min(jcell) AS first_cell, max(jcell) AS last_cell, count(DISTINCT jcell) AS cells FROM cell GROUP BY ALL", lambda d: mesh.cells(d.nodes, d.h).groupBy("mypart").agg(F.min("jcell").alias("first_cell"), F.max("jcell").alias("last_cell"), F.countDistinct("jcell").alias("cells")), "_wide")
_decomposed(
    "halo_exchange",
    f"WITH {sql.links(*_C4)} SELECT g.mypart, g.inode, o.master_glb_idx * 3 + 1 AS value FROM link g JOIN node o ON o.mypart = g.asked_part AND o.inode = g.remote_idx",
    lambda d: mesh.exchanged(d.nodes, d.nodes.where("not ghost").select("mypart", "inode", (F.col("master_glb_idx") * 3 + 1).alias("value"))),
    "_wide",
)

_FLAGS = "f_ghost, f_periodic, f_east, f_west, f_bc, f_land, f_water"


def _node_flags_sql(case: str) -> str:
    h = CASES[case][0]
    lon00 = 73.0
    norm = lambda x, w: f"({x}) - floor((({x}) - ({w})) / 360.0) * 360.0"
    grid = f"""mgrid AS (SELECT *, {sql.LON} AS lon, {sql.LAT} AS lat, {sql.WATER} AS water FROM grid),
row1 AS (SELECT jh - {h.halo_s} AS row, {norm("lon", lon00 - 180)} AS lon1 FROM mgrid WHERE ih = {1 + h.halo_w})"""
    west = lambda c: f"CASE WHEN {c} < {lon00 - 10} THEN {lon00 - 20} ELSE {lon00 - 90} END"
    return f"""WITH {sql.nodes(*CASES[case])}, {sql.masters(h)}, {grid},
place AS (SELECT x.*, m.lon AS m_lon, m.lat, a.water, r.lon1 AS lon1_master, coalesce(q.lon1, r.lon1) AS lon1_own, max(x.ix) OVER (PARTITION BY x.mypart) + 1 AS nx_local
  FROM node x JOIN mgrid m ON m.n = x.n_master JOIN mgrid a ON a.n = x.glb_idx - 1 JOIN row1 r ON r.row = x.n_master // {h.ni} - {h.halo_s} LEFT JOIN row1 q ON q.row = x.gj),
lons AS (SELECT *, {norm("m_lon", f"CASE WHEN gi < {h.nx // 2} THEN {west('lon1_master')} ELSE {lon00 + 90} END")} AS lon,
  {norm("m_lon", f"CASE WHEN gi < nx_local // 2 THEN {west('lon1_own')} ELSE {lon00 + 90} END")} AS lon_master, ghost AND glb_idx - 1 <> n_master AS moved FROM place)
SELECT mypart, inode, round(lon, 6) AS lon, round(lat, 6) AS lat, ghost AS f_ghost,
  moved AND (hi >= {h.nx} OR hi < 0 OR hj >= {h.ny}) AND NOT abs(lon_master - lon) < 1e-12 AS f_periodic,
  (moved AND hj >= {h.ny} AND lon > {lon00 + 90}) OR (hi > 0 AND hj >= {h.nx}) AS f_east,
  (moved AND hj >= {h.ny} AND NOT lon > {lon00 + 90}) OR hi <= 0 AS f_west, hi <= 0 OR hj >= {h.nx} AS f_bc, NOT water AS f_land, water AS f_water FROM lons"""


def _placed(d: Decomposition, spark: SparkSession) -> DataFrame:
    return mesh.with_coordinates(d.nodes, _plain(spark, d.h), d.h, 73.0)


for _case in ("", "_wide"):
    query(_node_flags_sql(_case), f"mesh_node_flags{_case}")(lambda spark, sf_dir, c=_case: _placed(Decomposition(spark, *CASES[c]), spark).select("mypart", "inode", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), *_FLAGS.split(", ")))


@query(_node_flags_sql("").replace("SELECT mypart, inode, round(lon, 6) AS lon", ", fl AS (SELECT mypart, inode, round(lon, 6) AS lon", 1) + f""")
SELECT c.mypart, c.jcell, bool_or(f.f_water) AS f_water, bool_or(f.f_land) AS f_land FROM
(SELECT a.mypart, row_number() OVER (PARTITION BY a.mypart ORDER BY a.is_ghost, a.iy, a.ix) - 1 AS jcell, a.ix, a.iy FROM node a WHERE a.is_cell) c
JOIN node p ON p.mypart = c.mypart AND p.ix BETWEEN c.ix AND c.ix + 1 AND p.iy BETWEEN c.iy AND c.iy + 1 JOIN fl f ON f.mypart = p.mypart AND f.inode = p.inode GROUP BY c.mypart, c.jcell""")
def mesh_cell_water(spark, sf_dir):
    d = Decomposition(spark, *CASES[""])
    return mesh.cells(_placed(d, spark), d.h, water=True).select("mypart", "jcell", "f_water", "f_land")


# --- text grids, records, hashes --------------------------------------------------------------------------------------

TINY = Header("tiny", 10, 8, 1, 1, 1, 1, 5.0, 6.0)


def tiny_lines() -> list[str]:
    """A text grid of version 2 with a few errors: core flags, coordinates and one missing master."""
    lines = [f"{TINY.ni} {TINY.nj}"]
    lo, hi = TINY.halo_w, TINY.halo_w + TINY.nx
    for j in range(TINY.nj):
        for i in range(TINY.ni):
            once = lambda x: x + TINY.nx if x < lo else x - TINY.nx if x >= hi else x
            mi, mj = once(i), j
            if mj > TINY.pivot_j or mj == TINY.pivot_j and mi > TINY.pivot_i:
                mi, mj = once(int(2 * TINY.pivot_i) - mi), int(2 * TINY.pivot_j) - mj
            core = int((mi, mj) == (i, j) and j >= TINY.halo_s)
            if j < TINY.halo_s:
                mi = mj = -1
            lat, lon = -70 + 20 * j, 10 + 36 * i
            wrong_core = core ^ ((i * 3 + j * 5) % 17 == 0 and mj >= 0)
            lines.append(f"  {lat + ((i + j) % 7 == 0) * 0.5} {lon} {int((i + j) % 3 > 0)} {wrong_core}  {i + 1} {j + 1} {mi + 1} {mj + 1} {lat} {lon}")
    return lines


V2 = tiny_lines()
V1 = [f"{TINY.ni} {TINY.nj} 4 1 1 1 1", *[" ".join(line.split()[:4]) for line in V2[1:]]]


def _lines_sql(lines: list[str]) -> str:
    return "raw(line_no, value) AS (VALUES " + ", ".join(f"({k}::BIGINT, '{v}')" for k, v in enumerate(lines)) + ")"


def _points_sql(version: int, lines: list[str]) -> str:
    f = text_grid.FIELDS[version]
    cols = ", ".join(f"w[{k + 1}]::{'INTEGER' if n[0] in 'IJ' else 'DOUBLE'} AS {n}" for k, n in enumerate(f))
    return f"{_lines_sql(lines)}, words AS (SELECT line_no, regexp_split_to_array(trim(value), '\\s+') AS w FROM raw), pt AS (SELECT line_no - 1 AS n, {cols} FROM words WHERE line_no > 0)"


def _fixed_sql(lines: list[str]) -> str:
    return f"""{_points_sql(2, lines)}, fx AS (SELECT * REPLACE (CASE WHEN core = 0 AND I = I_master AND J = J_master THEN 1 WHEN core <> 0 AND (I <> I_master OR J <> J_master) THEN 0 ELSE core END AS core,
 CASE WHEN lat <> lat_master AND J_master <> 0 THEN lat_master ELSE lat END AS lat, CASE WHEN lon <> lon_master AND J_master <> 0 THEN lon_master ELSE lon END AS lon) FROM pt),
fm AS (SELECT *, CASE WHEN core <> 0 THEN n WHEN (I_master - 1) + (J_master - 1)::BIGINT * {TINY.ni} < 0 THEN -1 ELSE (I_master - 1) + (J_master - 1)::BIGINT * {TINY.ni} END AS n_file FROM fx)"""


_FIXED = _fixed_sql(V2)


def _text(spark, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line_no bigint, value string")


def _fixed(spark, lines: list[str] = V2) -> DataFrame:
    return text_grid.file_master(text_grid.repaired(text_grid.parse_points(_text(spark, lines), 2)), TINY.ni)


@query(f"WITH {_points_sql(1, V1)} SELECT * FROM pt", "text_v1_parse")
def _text_v1(spark, sf_dir):
    return text_grid.parse_points(_text(spark, V1), 1)


@query(f"WITH {_points_sql(2, V2)} SELECT * FROM pt", "text_v2_parse")
def _text_v2(spark, sf_dir):
    return text_grid.parse_points(_text(spark, V2), 2)


@query(f"WITH {_lines_sql(V1)}, w AS (SELECT regexp_split_to_array(trim(value), '\\s+') AS w FROM raw WHERE line_no = 0) SELECT w[1]::INTEGER AS ni, w[2]::INTEGER AS nj, w[3]::INTEGER AS periodicity, w[4]::INTEGER AS halo_e, w[5]::INTEGER AS halo_w, w[6]::INTEGER AS halo_s, w[7]::INTEGER AS halo_n FROM w")
def text_v1_header(spark, sf_dir):
    return text_grid.header_fields(_text(spark, V1), 1)


@query(f"WITH {_FIXED} SELECT n, lat, lon, water, core, n_file FROM fm")
def text_v2_fix(spark, sf_dir):
    return _fixed(spark).select("n", "lat", "lon", "water", "core", "n_file")


@query(f"""WITH {_FIXED}, c AS (SELECT (n % {TINY.ni})::INTEGER AS ih, (n // {TINY.ni})::INTEGER AS jh FROM fm WHERE n_file = n), r AS (SELECT min(jh) AS low, max(jh) AS high FROM c)
SELECT ({TINY.nj - 1} - high)::INTEGER AS halo_n, min(ih)::INTEGER AS halo_w, low::INTEGER AS halo_s, ({TINY.ni - 1} - max(ih))::INTEGER AS halo_e FROM c, r WHERE jh BETWEEN low AND high GROUP BY low, high""")
def text_halo_detect(spark, sf_dir):
    return text_grid.halo_widths(_fixed(spark), TINY.ni, TINY.nj)


@query(f"WITH {_FIXED} SELECT ((I + I_master - 2) * 0.5)::DOUBLE AS pivot_i, ((J + J_master - 2) * 0.5)::DOUBLE AS pivot_j FROM fm WHERE J = {TINY.nj} AND I = {TINY.ni // 2 + 2}")
def text_pivot(spark, sf_dir):
    return text_grid.pivot(_fixed(spark), TINY.ni, TINY.nj)


def _wrong_lines() -> list[str]:
    """The same grid with masters that don't fit: none, one beyond the pivot, one at the end of the pivot's row, another
    core point; and a point that is taken for core as its master is itself."""
    t, lines = TINY, list(V2)
    for (i, j), (mi, mj) in {(3, 3): (-1, -1), (4, 3): (2, 7), (5, 3): (t.ni - 1, int(t.pivot_j)), (6, 3): (2, 2), (2, 7): (2, 7)}.items():
        w = lines[1 + j * t.ni + i].split()
        w[3] = str(int((i, j) == (mi, mj)))
        w[6:8] = str(mi + 1), str(mj + 1)
        lines[1 + j * t.ni + i] = " ".join(w)
    return lines


WRONG = _wrong_lines()


def _validate_sql(lines: list[str]) -> str:
    return f"""WITH {_fixed_sql(lines)}, p AS (SELECT n, n_file, core, (n % {TINY.ni})::INTEGER AS ih, (n // {TINY.ni})::INTEGER AS jh FROM fm WHERE n // {TINY.ni} > {TINY.halo_s}), {sql.fold("p", "pf", TINY)},
q AS (SELECT *, mj::BIGINT * {TINY.ni} + mi AS n_master, n_file % {TINY.ni} AS fi, n_file // {TINY.ni} AS fj FROM pf)
SELECT n, n_master, n_file, CASE WHEN n_master <> n_file THEN CASE WHEN n_file < 0 THEN 'no_master' WHEN fj > {TINY.pivot_j} THEN 'beyond_pivot' WHEN fj = {TINY.pivot_j} AND fi >= {TINY.ni - 2} THEN 'on_pivot_row' ELSE 'other' END END AS kind,
(core = 0) <> (n_master <> n) AS wrong_ghost FROM q WHERE n_master <> n_file OR (core = 0) <> (n_master <> n)"""


@query(_validate_sql(V2))
def text_validate(spark, sf_dir):
    return text_grid.mismatches(_fixed(spark), TINY)


@query(_validate_sql(WRONG))
def text_validate_mismatches(spark, sf_dir):
    return text_grid.mismatches(_fixed(spark, WRONG), TINY)


@query(f"WITH {sql.masters(G2T)}, g AS (SELECT n, {sql.LON} AS lon, {sql.LAT} AS lat FROM grid) SELECT count(*) AS points, count(*) = {G2T.size} AND min(n) = 0 AND max(n) = {G2T.size - 1} AND count(DISTINCT n) = {G2T.size} AS complete, count(*) FILTER (WHERE lon IS NULL OR lat IS NULL) AS missing FROM g")
def check_setup(spark, sf_dir):
    return record.check_points(_plain(spark), G2T)


@query()
def content_uid(spark, sf_dir):
    return uid.content_uid(_plain(spark), "T")


@query(f"""WITH {sql.masters(G2T)}, g AS (SELECT n, {sql.LON} AS lon, {sql.LAT} AS lat FROM grid)
SELECT count(*) AS points, (sum(('0x' || substr(md5(concat_ws(':', n, round(lat * 1000000)::BIGINT, round(lon * 1000000)::BIGINT)), 1, 8))::BIGINT))::BIGINT AS digest FROM g""")
def content_uid_text(spark, sf_dir):
    return uid.text_uid(_plain(spark))
