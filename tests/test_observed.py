"""Location, distance, smoothing, balanced parts, hash trees and prefixes against plain versions, and their plans."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import balance, distance, locator, merkle, partition, points, quality, stencil
from halocline.operators.header import Header, header_of
from halocline.plans import observed, roster
from halocline.sources import bands, prefixes, text_grid

TINY = Header("tiny", 10, 8, 1, 1, 1, 1, 5.0, 6.0)


def master_of(i, j, h):
    """Owner (halo frame) of (i, j), written without the library."""
    wrap = lambda x: x + h.nx if x < h.halo_w else x - h.nx if x >= h.halo_w + h.nx else x
    i = wrap(i)
    if j > h.pivot_j or j == h.pivot_j and i > h.pivot_i:
        i, j = wrap(int(2 * h.pivot_i) - i), int(2 * h.pivot_j) - j
    return i, j


# --- location ----------------------------------------------------------------------------------------------------------


def plain_cell(lon, lat, cells):
    """(jh, ih) of the first cell that holds a point."""
    for jh, ih, xs, ys in cells:
        px = lon - np.floor((lon - (min(xs) - 1e-9)) / 360) * 360
        if all((xs[(k + 1) % 4] - xs[k]) * (lat - ys[k]) - (ys[(k + 1) % 4] - ys[k]) * (px - xs[k]) >= 0 for k in range(4)):
            return jh, ih
    return None, None


@pytest.mark.parametrize("limit, deepest, hot", [(1, 4, 3), (4, 12, 100_000), (1000, 12, 5)])
def test_located_matches_trying_every_cell(spark, limit, deepest, hot):
    h = header_of("g", 38, 22, "T")
    cells = observed._cells(spark, h)
    corner = [(r.jh, r.ih, [r.x_sw, r.x_se, r.x_ne, r.x_nw], [r.y_sw, r.y_se, r.y_ne, r.y_nw]) for r in locator.cell_boxes(cells).collect()]
    corner.sort()
    rng = np.random.default_rng(5)
    where = [(k, float(lon), float(lat)) for k, (lon, lat) in enumerate(zip(rng.uniform(-400, 800, 60), rng.uniform(-90, 90, 60), strict=True))]
    seam = corner[-1][2][1]  # the last cell of the last row ends at the seam
    where += [(100, seam, 70.0), (101, seam - 1e-7, 70.0), (102, seam + 1e-7, 70.0), (103, seam - 360, -20.0)]
    where += [(110 + k, float(x), max(corner[-1][3]) + d) for k, (x, d) in enumerate([(80, 0.0), (80, -1e-7), (80, 1e-7), (260, -0.5), (260, 1.0)])]  # at the last row before the fold
    where += [(200 + k, 80.0 + k / 1000, 10.0) for k in range(20)]  # a hot tile
    where += [(300, None, 1.0), (301, 1.0, float("nan")), (302, float("inf"), 0.0), (303, corner[5][2][0], corner[5][3][0])]
    found = locator.located(spark.createDataFrame(where, "id int, lon double, lat double"), cells, limit, deepest, hot)
    assert not re.search("CartesianProduct|NestedLoop", found._jdf.queryExecution().executedPlan().toString())
    got = {r.id: (r.jh, r.ih) for r in found.collect()}
    assert len(got) == len(where)
    for k, lon, lat in where:
        known = lon is not None and np.isfinite(lon) and np.isfinite(lat)
        assert got[k] == (plain_cell(lon, lat, corner) if known else (None, None)), k
    assert got[111][0] is not None and got[112] == (None, None)


def test_quadtree_splits_dense_tiles(spark):
    cells = observed._cells(spark, header_of("g", 182, 149, "T"))
    entries, levels = locator.quadtree(locator.cell_boxes(cells), limit=8)
    most = entries.where(F.col("level") < max(levels)).groupBy("level", "key", "ty").count().agg(F.max("count")).first()[0]
    assert len(levels) > 1 and most <= 8
    assert entries.select("ih", "jh").distinct().count() == cells.count()


def test_parts_and_their_outlines(spark):
    h = header_of("g", 38, 22, "T")
    cells, owner = observed._cells(spark, h), partition.owners(spark, h, 4, partitioner="regular_checkerboard")
    where = spark.createDataFrame([(1, 85.0, -50.0), (2, 300.0, 60.0), (3, 0.0, -89.0)], "id int, lon double, lat double")
    got = {r.id: r.part for r in locator.in_parts(locator.located(where, cells), owner, h.halo_w, h.halo_s).collect()}
    assert got == {1: 0, 2: 3, 3: None}
    sides = locator.part_outline(cells, owner, h.halo_w, h.halo_s)
    # Around each part the sides close, and their area is the sum of the cells'.
    area = {r.part: r.a for r in sides.groupBy("part").agg(F.sum((F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("a")).collect()}
    own = locator.cell_boxes(cells).join(owner.select((F.col("ix") + h.halo_w).alias("ih"), (F.col("iy") + h.halo_s).alias("jh"), "part"), ["ih", "jh"])
    x, y = [F.col(f"x_{c}") for c in quality.CORNERS], [F.col(f"y_{c}") for c in quality.CORNERS]
    whole = {r.part: r.a for r in own.groupBy("part").agg(F.sum(sum((x[k] * y[(k + 1) % 4] - x[(k + 1) % 4] * y[k] for k in range(4)), F.lit(0.0)) / 2).alias("a")).collect()}
    assert area.keys() == whole.keys() and all(abs(area[p] - whole[p]) < 1e-6 for p in whole)
    degree = sides.select("part", F.explode(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")).groupBy("part", "p").count()
    assert degree.where("count % 2 <> 0").isEmpty()


# --- distance ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("arrangement", "TUVF")
@pytest.mark.parametrize("ni, nj", [(20, 15), (362, 12)])
def test_distance_matches_walking(spark, ni, nj, arrangement):
    """Against a walk outwards over neighbours, seam and fold included."""
    h, most = header_of("g", ni, nj, arrangement), 6
    rng = np.random.default_rng(ni + ord(arrangement))
    area = [(i, j) for i in range(h.halo_w, h.halo_w + h.nx) for j in range(h.halo_s, int(h.pivot_j) + 1)]
    owners = [p for p in area if master_of(*p, h) == p]
    marks = {owners[k] for k in rng.choice(len(owners), 3, replace=False)}
    df = spark.createDataFrame([(j * h.ni + i,) for i, j in marks], "n_master bigint")
    got = {r.n: r.d for r in distance.to_marked(spark, df, h, most).collect()}
    reached, edge = dict.fromkeys(marks, 0), set(marks)
    images = {}
    for p in area:
        images.setdefault(master_of(*p, h), []).append(p)
    for d in range(1, most):
        near = {(i + a, j + b) for o in edge for i, j in images.get(o, [o]) for a in (-1, 0, 1) for b in (-1, 0, 1) if j + b >= h.halo_s}
        edge = {m for m in (master_of(*p, h) for p in near) if m not in reached}
        reached |= dict.fromkeys(edge, d)
    assert got == {j * h.ni + i: reached.get((i, j), most) for i, j in owners}


def test_distance_without_marks_and_plan(spark):
    none = spark.createDataFrame([], "n_master bigint")
    found = distance.to_marked(spark, none, TINY, 3)
    assert {r.d for r in found.collect()} == {3}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop", text) and "unboundedfollowing" not in text.replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "")
    r = np.array([9, 9, 2, 9, 9, 9, 0, 9])
    assert distance.least_within(r, 5).tolist() == [2, 2, 2, 2, 2, 1, 0, 1]


# --- smoothing -----------------------------------------------------------------------------------------------------------


def plain_smoothed(v, h, steps):
    for _ in range(steps):
        new = {}
        for i, j in v:
            total = 4 * v[i, j]
            for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)):
                p = i + a, j + b
                if p[1] < 0:
                    p = i, j
                elif p not in v:
                    m = master_of(p[0] + h.halo_w, p[1] + h.halo_s, h)
                    p = m[0] - h.halo_w, m[1] - h.halo_s
                total += v[p]
            new[i, j] = total // 8
        v = new
    return v


@pytest.mark.parametrize("h", [TINY, header_of("v", 20, 15, "V"), header_of("f", 362, 9, "F")])
@pytest.mark.parametrize("bands, columns", [(1, 1), (2, 3)])
def test_smoothing_in_blocks_equals_the_serial_result(spark, h, bands, columns):
    rng = np.random.default_rng(2)
    v = {}
    for j in range(h.ny):
        for i in range(h.nx):
            m = master_of(i + h.halo_w, j + h.halo_s, h)
            v[i, j] = v.get((m[0] - h.halo_w, m[1] - h.halo_s), int(rng.integers(0, 10_000)))
    df = spark.createDataFrame([(i, j, x) for (i, j), x in v.items()], "i int, j int, value bigint")
    got = {(r.i, r.j): r.value for r in stencil.smoothed(spark, df, h, 3, bands, columns, buckets=3).collect()}
    assert got == plain_smoothed(v, h, 3)


def test_blocks_stay_while_rings_move(spark):
    """A step reads both tables by bucket and shuffles nothing but the values that blocks ask of each other."""
    blocks = stencil.Blocks(spark, TINY, 2, 2, buckets=3)
    field, asks = blocks.of_values(spark.createDataFrame([(1, 1, 80)], "i int, j int, value bigint")), blocks.asked()
    both = field.join(blocks.moved(field, asks).hint("shuffle_hash"), "block")
    text = both._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"Exchange (.*?),", text.partition("Initial Plan")[0] or text)
    assert len(exchanges) == 1 and "block" in exchanges[0] and text.count("Bucketed: true") == 3
    assert sum(len(r.rings) for r in blocks.moved(field, asks).collect()) == 2 * 2 * (4 + 3 + 4 + 3) - 8  # the south has no ring
    blocks.drop()
    with pytest.raises(ValueError):
        stencil.Blocks(spark, TINY, 7, 1, 1)


# --- balanced parts --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts, bands", [(6, 2), (5, None), (1, None)])
def test_parts_by_load_match_running_sums(spark, parts, bands):
    rng = np.random.default_rng(parts)
    load = {(int(i), int(j)): int(w) for i, j, w in zip(rng.integers(0, 8, 30), rng.integers(0, 6, 30), rng.integers(0, 50, 30), strict=True)}
    df = spark.createDataFrame([(i, j, w) for (i, j), w in load.items()], "ix int, iy int, load int")
    got = {(r.ix, r.iy): (r.load, r.part) for r in balance.owners_by_load(spark, df, TINY, parts, bands).collect()}
    bands = bands or {5: 1, 1: 1}[parts]
    total, before, band = sum(load.values()), 0, {}
    for p in sorted(((i, j) for i in range(8) for j in range(6)), key=lambda p: (p[1], p[0])):
        band[p] = min(before * bands // total, bands - 1)
        before += load.get(p, 0)
    for b in range(bands):
        own, each = sorted(p for p in band if band[p] == b), parts // bands
        total, before = sum(load.get(p, 0) for p in own), 0
        for p in own:
            assert got[p] == (load.get(p, 0), b * each + (min(before * each // total, each - 1) if total else 0))
            before += load.get(p, 0)


def test_parts_are_even_and_need_no_load(spark):
    loads = [r.load for r in roster.QUERIES["obs_balanced_parts"](spark, "/root/testdata/sf0.001").collect()]
    assert len(loads) == 16 and max(loads) <= 1.1 * sum(loads) / 16
    none = spark.createDataFrame([], "ix int, iy int, load int")
    assert {r.part for r in balance.owners_by_load(spark, none, TINY, 4).collect()} == {0}
    even = balance.summary(balance.owners_by_load(spark, none, TINY, 4, base=1)).collect()
    assert sorted(r.points for r in even) == [12, 12, 12, 12]
    with pytest.raises(ValueError):
        balance.owners_by_load(spark, none, TINY, 4, 3)


# --- hash trees ------------------------------------------------------------------------------------------------------------


def test_tree_root_does_not_depend_on_partitions(spark):
    values = [(n, n * n % 91) for n in range(0, 5000, 3)] + [(4999, None)]
    trees = {merkle.root(merkle.tree(spark.createDataFrame(values, "n bigint, value bigint").repartition(p), 5000, 16, 4)) for p in (1, 4, 16)}
    level = {}
    for n, v in values:
        level.setdefault(n // 16, []).append(f"{n}:{'-' if v is None else v}")
    level = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in level.items()}
    while len(level) > 1:
        up = {}
        for k in sorted(level):
            up.setdefault(k // 4, []).append(level[k])
        level = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in up.items()}
    assert trees == {level[0]}
    assert [merkle.levels_of(n, 16, 4) for n in (0, 1, 16, 17, 64, 65, 5000)] == [1, 1, 1, 2, 2, 3, 6]


def test_differences_are_found_by_descent(spark):
    one = spark.range(1000).select(F.col("id").alias("n"), (F.col("id") * 7).alias("value"))
    two = one.where("n <> 3").withColumn("value", F.when(F.col("n") == 777, 0).otherwise(F.col("value")))
    tree = lambda df: merkle.tree(df, 1000, 16, 4)
    found = lambda a, b: sorted(map(tuple, merkle.differing(tree(a), tree(b), 1000, 16, 4).collect()))
    assert found(one, two) == [(0, 16), (768, 784)] and found(one, one) == []
    assert found(one.where("n < 992"), one) == [(992, 1000)] and merkle.root(tree(one.limit(0))) is None
    assert found(one.limit(0), one.limit(0)) == []


# --- prefixes ----------------------------------------------------------------------------------------------------------------


def test_longest_prefix_of_many(spark):
    known = [(f"http://h{k}.org", f"/{k}") for k in range(1000)] + [(f"http://h{k}.org/a", f"/{k}a") for k in range(0, 1000, 2)] + [("http://h4.org/a", "/z"), (None, "/n")]
    urls = ["http://h4.org/a/b", "http://h5.org/a/b", "http://h77.org", "http://h", "ftp://x/y", "http://none.org/q/w.html", None, "", "http://h4.org/a/b"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "id int, url string")
    found = prefixes.longest_prefix(df, spark.createDataFrame(known, "prefix string, target string"))
    got = {r.id: (r.prefix, r.target) for r in found.collect()}
    assert got == {0: ("http://h4.org/a", "/4a"), 1: ("http://h5.org", "/5"), 2: ("http://h77.org", "/77"), 8: ("http://h4.org/a", "/4a")} | dict.fromkeys((3, 4, 5, 6, 7), (None, None))
    paths = {r.id: r.p for r in found.select("id", prefixes.cached_path(F.col("url"), F.col("prefix"), F.col("target")).alias("p")).collect()}
    assert paths[0] == "grids/tripolar/4a/b" and paths[5] == "grids/tripolar/unknown/w.html" and paths[4] == "ftp://x/y"
    empty = prefixes.longest_prefix(df, spark.createDataFrame([("", "/all")], "prefix string, target string"))
    assert {r.target for r in empty.where("url is not null").collect()} == {"/all"}
    assert prefixes.longest_prefix(df, spark.createDataFrame([], "prefix string, target string")).where("prefix is not null").isEmpty()


def test_points_of_the_whole_grid_have_owners(spark):
    got = {(r.ih, r.jh): (r.mi, r.mj) for r in points.with_master(points.spine(spark, TINY), TINY).collect()}
    assert got == {p: master_of(*p, TINY) for p in got}


# --- text files and numbering --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bytes_a_split", [64, 1 << 20])
def test_lines_of_several_files_are_numbered_in_order(spark, tmp_path, bytes_a_split):
    want = []
    for k, name in enumerate(("a.txt", "b.txt", "c.txt")):
        lines = [f"{name} {i} {'x' * (i % 40)}" for i in range(100 * k + 1)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_a_split))
    try:
        found = text_grid.read_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)  # what comes later may split differently
        got = found.orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.line_no for r in got] == list(range(len(want))) and [r.value for r in got] == want


@pytest.mark.parametrize("name", ["mesh_nodes_wide", "mesh_cells_wide"])
def test_numbering_computes_its_points_once(spark, name):
    text = roster.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Range (") <= 1


# --- data source ------------------------------------------------------------------------------------------------------------------


def test_bands_round_trip_and_filters_choose_bands(spark, tmp_path):
    field = spark.range(2000).select(F.col("id").alias("n"), F.floor(F.col("id") / 20).cast("int").alias("jh"), (F.col("id") * 3).alias("value"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("note"))
    path = str(tmp_path / "f")
    bands.write_bands(field, path, rows=100)
    back = spark.read.format(bands.FORMAT).load(path)
    assert back.schema.simpleString() == field.schema.simpleString() and back.exceptAll(field).isEmpty() and back.count() == 2000
    read = lambda df: df.rdd.getNumPartitions()  # noqa: E731  a partition for each band
    whole = read(back)
    assert whole >= 20
    one = back.where("jh = 42")
    assert read(one) <= 2 and sorted(r.n for r in one.collect()) == list(range(840, 860))
    assert read(back.where("n between 300 and 350")) <= 2 and back.where("n >= 300 and n < 351").count() == 51
    assert read(back.where("jh in (0, 99)")) == whole and back.where("jh in (0, 99)").count() == 40
    assert back.where("jh > 5000").count() == 0 and back.where("value = 30").count() == 1
    bands.write_bands(field.where("n < 10"), path)
    assert spark.read.format(bands.FORMAT).load(path).count() == 10
    field.where("n >= 10").write.format(bands.FORMAT).mode("append").save(path)
    assert spark.read.format(bands.FORMAT).load(path).count() == 2000
    with pytest.raises(Exception, match="need the columns"):
        field.drop("jh").write.format(bands.FORMAT).mode("overwrite").save(path)
    with pytest.raises(Exception, match="a row without jh"):
        field.withColumn("jh", F.lit(None).cast("int")).write.format(bands.FORMAT).mode("overwrite").save(path)
