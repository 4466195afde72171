"""Catalog, conversion, export, location of points and the stream."""

import pytest
from pyspark.sql import functions as F

from halocline import catalog
from halocline.operators import locator, mesh, partition, quality, uid
from halocline.operators.header import Header, header_of
from halocline.plans import convert, roster
from halocline.sources import locate, mesh_text, netcdf, record, registry
from halocline.streaming import observations


def test_catalog(spark):
    assert catalog.install(spark).count() == spark.sql("SELECT count(*) FROM grid_spec").first()[0] == 74
    assert catalog.grid(spark, "orca2_t") == header_of("ORCA2_T", 182, 149, "T")
    with pytest.raises(KeyError):
        catalog.grid(spark, "nothing")
    m = catalog.generate_mesh(spark, header_of("g", 20, 15, "T"))
    assert m["nodes"].count() == 300 and m["cells"].count() == 19 * 14
    assert catalog.version_number("1.2.3") == 10203 and catalog.revision() == "not available"


def test_convert_text_grid(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\n".join(roster.V2) + "\n")
    out = convert.convert(spark, str(tmp_path / "g.txt"), "tiny", "T", str(tmp_path / "g"))
    h, back = record.read_record(spark, str(tmp_path / "g"))
    t = roster.TINY
    assert (h.ni, h.nj, h.halo_n, h.halo_w, h.halo_s, h.halo_e, h.pivot_j) == (t.ni, t.nj, 1, 1, 1, 1, t.pivot_j)
    assert back.count() == t.size and back.where("invalid").count() == out["statistics"]["flagged"] and len(out["uid"]) == 32
    assert convert.spec_of(spark, out, "tiny", "T", "g").startswith("tiny_T: &tiny_T\n    type: ")
    assert out["pivot"] == [5.0, 6.0] and convert.format_of("a.NC") == "netcdf" and convert.format_of("folder") == "record"
    again = convert.convert(spark, str(tmp_path / "g"), "tiny", "T", str(tmp_path / "g2"))
    assert again == out and record.read_record(spark, str(tmp_path / "g2"))[1].exceptAll(back).isEmpty()
    with pytest.raises(ValueError):
        convert.format_of("a.nc", "picture")
    (tmp_path / "v1.txt").write_text("\n".join(roster.V1) + "\n")
    h1, _ = convert.read_text_grid(spark, str(tmp_path / "v1.txt"), "tiny", 1, (5.0, 6.0))
    assert (h1.halo_n, h1.halo_e, h1.pivot_i) == (1, 1, 5.0)
    with pytest.raises(ValueError):
        convert.read_text_grid(spark, str(tmp_path / "v1.txt"), "tiny", 1)


def test_catalog_reads_registry_files_and_options(spark, tmp_path):
    built_in = registry.specs(spark)
    text = "### grids\n\n" + "\n\n".join(r.yaml for r in registry.spec_yaml(built_in.where("not is_uid"), f"{registry.DEFAULT_BASE}/v0").orderBy("name").collect())
    text += "\n\n" + "".join(f"{old}: *{name}\n" for name, old in registry.OLD_UIDS.items()) + "0123456789abcdef0123456789abcdef: *nobody\n"
    (tmp_path / "grids.yaml").write_text(text)
    own = f"tiny_T: &tiny_T\n    type: {registry.GRID_TYPE}\n    orca_arrangement: T\n    orca_name: tiny\n    dimensions: [10,8]\n    uid: {'0' * 32}\n    data: tiny.grid\n{'0' * 32}: *tiny_T\n"
    (tmp_path / "own.yaml").write_text(own + "other: &other\n    type: ELSE\n    orca_arrangement: T\n    orca_name: other\n    dimensions: [4,4]\n    uid: 1\n    data: x\n")
    assert registry.read_specs(spark, str(tmp_path / "grids.yaml")).exceptAll(built_in).isEmpty() and registry.read_specs(spark, str(tmp_path / "grids.yaml")).count() == 74
    plain = roster._plain(spark, roster.TINY).withColumn("invalid", F.lit(False))
    record.write_record(plain, roster.TINY, str(tmp_path / "tiny.grid"))
    spark.conf.set("halocline.grids.path", str(tmp_path / "*.yaml"))
    spark.conf.set("halocline.search.path", str(tmp_path))
    try:
        assert catalog.install(spark).count() == 77 and catalog.grid(spark, "orca2_t") == header_of("ORCA2_T", 182, 149, "T")
        with pytest.raises(KeyError):
            catalog.grid(spark, "other")
        with pytest.raises(KeyError):
            catalog.generate_mesh(spark, roster.TINY, generator="other")
        h, points, digest = catalog.load(spark, "0" * 32)
        assert (h, points.count(), digest) == (roster.TINY, 80, "0" * 32)
        real = uid.content_uid(points, "T").first()[0]
        spark.conf.set("halocline.compute.uid", "true")
        assert catalog.load(spark, "0" * 32)[2] == real and uid.checked_uid(points, "T", real, validate=True) == real
        spark.conf.set("halocline.validate.uid", "true")
        with pytest.raises(ValueError):
            catalog.load(spark, "0" * 32)
    finally:
        for name in ("grids.path", "search.path", "compute.uid", "validate.uid"):
            spark.conf.unset(f"halocline.{name}")


def test_regular_parts_and_links(spark):
    h = header_of("g", 42, 31, "T")
    owner = partition.owners(spark, h, 6, partitioner="regular_checkerboard")
    rects = partition.rectangles(owner, 0).collect()
    assert len(rects) == 6 and all((r.ix_max - r.ix_min) * (r.iy_max - r.iy_min) == r.n_owned for r in rects)
    m = catalog.generate_mesh(spark, h, 6, 1)
    nodes = m["nodes"].cache()
    owners = nodes.where("not ghost").select(F.col("mypart").alias("part"), F.col("inode").alias("remote_idx"), F.col("glb_idx").alias("own"))
    met = nodes.where("ghost").join(owners, ["part", "remote_idx"])
    assert met.count() == nodes.where("ghost").count() > 0 and met.where("glb_idx <> own").count() == 0
    assert {r.real_points for r in m["real_points"].collect()} and m["metadata"]["halo"] == 1
    grid = partition.regular_grid(spark, h).agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    assert (grid[0], round(grid[1], 9), grid[2], round(grid[3], 9)) == (-80.0, 90.0, 0.0, 351.0)


def test_mesh_text(spark, tmp_path):
    h = header_of("g", 20, 15, "T")
    m = catalog.generate_mesh(spark, h)
    nodes = m["nodes"].withColumns({"lon": F.col("gi") * 1.0, "lat": F.col("gj") * 1.0})
    mesh_text.write_mesh(nodes, m["cells"], str(tmp_path / "m"))
    lines = [x for p in sorted((tmp_path / "m").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[:5] == ["$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", "300"] and lines[-1] == "$EndElements"
    assert [int(x.split()[0]) for x in lines[5:305]] == list(range(1, 301)) and lines[305:308] == ["$EndNodes", "$Elements", "266"]
    with pytest.raises(ValueError):
        mesh_text.mesh_lines(nodes, m["cells"], "uvw")


def test_mesh_text_is_read_back(spark, tmp_path):
    m = catalog.generate_mesh(spark, header_of("g", 20, 15, "T"))
    nodes = m["nodes"].withColumns({"lon": F.col("gi") * 1.5, "lat": F.col("gj") * 0.5})
    values = spark.createDataFrame([(k, k / 4) for k in range(0, 300, 7)] + [(1, None), (None, 2.0)], "inode bigint, value double")
    mesh_text.write_mesh(nodes, m["cells"], str(tmp_path / "m"), values=values)
    own, cells, back = mesh_text.read_mesh(spark, str(tmp_path / "m"))
    same = lambda a, b: a.count() == b.count() and a.exceptAll(b).isEmpty()
    assert same(own, nodes.select(F.col("inode").cast("bigint").alias("inode"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.lit(0.0).alias("z")))
    corners = [F.col(f"node{k}").cast("bigint").alias(f"node{k}") for k in range(4)]
    assert same(cells, m["cells"].select(F.col("jcell").cast("bigint").alias("jcell"), "part", *corners))
    assert {tuple(r) for r in back.collect()} == {(k, k / 4) for k in range(0, 300, 7)}
    mesh_text.write_mesh(nodes, m["cells"], str(tmp_path / "bare"))
    assert mesh_text.read_mesh(spark, str(tmp_path / "bare"))[2].count() == 0
    (tmp_path / "none.msh").write_text("$Nodes\n0\n$EndNodes\n")
    with pytest.raises(ValueError):
        mesh_text.read_mesh(spark, str(tmp_path / "none.msh"))


def test_locator(spark):
    h = roster.G2T
    cells = quality.cell_corners(roster._plain(spark, h), h)
    where = spark.createDataFrame([(1, 74.0, 0.3), (2, 434.0, 0.3), (3, -6.9, 40.0), (4, 10.0, -89.0)], "id int, lon double, lat double")
    got = {r.id: (r.ih, r.jh) for r in locator.located(where, cells).collect()}
    assert got[1] == got[2] == (1, 69) and got[3][0] == 141 and got[4] == (None, None)


def test_wide_boxes_are_not_repeated_in_small_tiles(spark):
    """Forty boxes as wide as the globe over cells of a degree: entries stay few, and each point finds its first cell."""
    rows = [(-1 - k, 60, 1.0, 359.0, 10.0, 11.0) for k in range(40)] + [(i, j, float(i), i + 1.0, float(j), j + 1.0) for i in range(100, 130) for j in range(5, 15)]
    corners = ", ".join(f"{v} AS lon_{c}, {w} AS lat_{c}" for c, v, w in (("sw", "a", "c"), ("se", "b", "c"), ("ne", "b", "d"), ("nw", "a", "d")))
    cells = spark.createDataFrame(rows, "ih int, jh int, a double, b double, c double, d double").selectExpr("ih", "jh", *corners.split(", "))
    boxes = spark.createDataFrame(rows, "ih int, jh int, x0 double, x1 double, y0 double, y1 double")
    entries, levels = locator.quadtree(boxes, limit=8, deepest=6)
    assert entries.count() < 10_000 and entries.where("ih < 0").groupBy("ih").count().where("count > 100").count() == 0 and len(levels) > 1
    where = spark.createDataFrame([(k, 100.5 + k % 30, 5.5 + k // 30) for k in range(300)] + [(300, 99.5, 9.5)], "id int, lon double, lat double")
    got = {r.id: (r.ih, r.jh) for r in locator.located(where, cells.where("ih >= 0"), limit=8, deepest=6).collect()}
    assert got == {k: (100 + k % 30, 5 + k // 30) for k in range(300)} | {300: (None, None)}


def test_unsound_records_are_found_and_discarded(spark, tmp_path):
    h = Header("tiny", 6, 5, 1, 1, 1, 1, 3.0, 3.0)
    flags = {c: F.lit(False) for c in ("ghost", "water", "invalid")}
    points = spark.range(h.size).select(F.col("id").alias("n"), F.col("id").cast("double").alias("lon"), F.lit(0.0).alias("lat")).withColumns(flags)
    at = lambda name: tmp_path / "grids/tripolar/v0" / f"{name}.grid"
    for name in ("sound", "header", "dimensions", "points", "repeated", "unasked"):
        record.write_record(points, h, str(at(name)))
    for f in (at("header") / "header").glob("part-*.parquet"):
        f.write_bytes(b"not a record" * 20)
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    spark.createDataFrame([(n, 0.0, 0.0, 0) for n in range(h.size - 1)], record.POINTS).write.mode("overwrite").parquet(str(at("points") / "points"))
    spark.createDataFrame([(n % (h.size - 1), 0.0, 0.0, 0) for n in range(h.size)], record.POINTS).write.mode("overwrite").parquet(str(at("repeated") / "points"))
    url = lambda name: f"{locate.DEFAULT_BASE}/v0/{name}.grid"
    rows = [(url(n), 7 if n == "dimensions" else h.ni, h.nj) for n in ("sound", "header", "dimensions", "points", "repeated", "absent", "sound")]
    wanted = spark.createDataFrame([*rows, (None, 1, 1)], "data_url string, ni int, nj int")
    seen = locate.inspected(spark, wanted, str(tmp_path)).cache()
    got = {r.data_url.rpartition("/")[2][:-5]: (r.points, r.problem) for r in seen.collect()}
    n = h.size
    assert seen.count() == 6 and got == {"sound": (n, None), "header": (n, "header"), "dimensions": (n, "dimensions"), "points": (n - 1, "points"), "repeated": (n, "points"), "absent": (0, "missing")}
    assert locate.discard_unsound(spark, seen, str(tmp_path)) == sorted(map(url, ("header", "dimensions", "points", "repeated")))
    assert at("sound").exists() and at("unasked").exists() and not any(at(x).exists() for x in ("header", "dimensions", "points", "repeated"))
    seen.unpersist()
    assert locate.discard_unsound(spark, locate.inspected(spark, wanted, str(tmp_path)), str(tmp_path)) == []


def test_wrong_lengths(spark, tmp_path):
    (tmp_path / "grids/tripolar/v0").mkdir(parents=True)
    for name in "ab":
        (tmp_path / f"grids/tripolar/v0/{name}.grid").write_text("four")
    url = lambda name: f"{locate.DEFAULT_BASE}/v0/{name}.grid"
    urls = spark.createDataFrame([(url("a"), 4), (url("b"), 5), (url("c"), 6)], "data_url string, length bigint")
    assert {(r.data_url, r.length, r.bytes) for r in locate.wrong_lengths(spark, urls, str(tmp_path)).collect()} == {(url("b"), 5, 4), (url("c"), 6, None)}


def test_revision_of_an_exported_tree(monkeypatch):
    monkeypatch.setattr(catalog, "REVISION", "0123456789" * 4)
    assert catalog.revision(7) == "0123456" and catalog.revision(99) == "0123456789" * 4
    monkeypatch.setattr(catalog, "REVISION", "$Format:%H$")
    assert catalog.revision() == "not available"


def test_store(spark, tmp_path):
    (tmp_path / "grids/tripolar/v0").mkdir(parents=True)
    (tmp_path / "grids/tripolar/v0/a.grid").write_text("x")
    store = locate.GridStore([str(tmp_path / "other"), str(tmp_path)])
    assert store.locate(spark, f"{locate.DEFAULT_BASE}/v0/a.grid").endswith("/grids/tripolar/v0/a.grid")
    urls = spark.createDataFrame([(f"{locate.DEFAULT_BASE}/v0/a.grid",), (f"{locate.DEFAULT_BASE}/v0/b.grid",)], "data_url string")
    seen = {r.data_url[-6:]: (r.found, r.bytes) for r in locate.report(spark, urls, str(tmp_path)).collect()}
    assert seen == {"a.grid": (True, 1), "b.grid": (False, None)}
    with pytest.raises(FileNotFoundError):
        store.locate(spark, "https://elsewhere.example.net/b.grid")
    with pytest.raises(NotImplementedError):
        store.fetch("https://elsewhere.example.net/b.grid")
    assert netcdf.variables("W") == ("glamt", "gphit", "tmask")
    with pytest.raises(ValueError):
        netcdf.variables("X")


def test_stream(spark, tmp_path):
    h = Header("tiny", 10, 8, 1, 1, 1, 1, 5.0, 6.0)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    schema = events.schema
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = observations.windowed_on_points(stream, F.col("event_id"), F.col("value"), h, late="36500 days")
    query = out.writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    total = spark.sql("SELECT sum(observations), sum(cents) FROM seen").first()
    want = events.agg(F.count(F.lit(1)), F.sum(F.round(F.col("value") * 100).cast("bigint"))).first()
    assert tuple(total) == tuple(want)
