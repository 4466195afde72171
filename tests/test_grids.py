"""Golden values and invariants of the grid operators."""

import pytest
from pyspark.sql import functions as F

from halocline.functions import fold, geometry
from halocline.operators import local_grid, mesh, partition, points, uid
from halocline.operators.header import Header, derive_headers, header_of
from halocline.plans import roster
from halocline.sources import record, registry, text_grid

TWO, ONE = header_of("two", 182, 149, "T"), header_of("one", 362, 292, "T")

#: Linear index of the owner of core (i, j).
OWNERS_TWO = {
    (-1, -1): 180, (179, -1): 180, (0, -1): 1, (0, 0): 183, (180, 0): 183, (179, 0): 362, (-1, 0): 362, (-10, 0): 353, (190, 0): 193,
    (0, 146): 26755, (90, 146): 26845, (91, 146): 26844, (92, 146): 26843, (179, 146): 26756, (180, 146): 26755, (-1, 146): 26756,
    (0, 145): 26573, (1, 145): 26574, (190, 145): 26583, (0, 136): 24935, (0, 156): 24935,
}
OWNERS_ONE = {
    (-1, -1): 360, (359, -1): 360, (0, -1): 1, (0, 0): 363, (360, 0): 363, (359, 0): 722, (-1, 0): 722, (-10, 0): 713, (370, 0): 373,
    (0, 289): 104981, (180, 289): 105161, (181, 289): 105162, (182, 289): 105163, (359, 289): 105340, (360, 289): 104981, (-1, 289): 105340,
    (0, 290): 105340, (1, 290): 105339, (2, 290): 105338, (180, 290): 105160, (181, 290): 105159, (182, 290): 105158, (359, 290): 104981, (360, 290): 105340, (-1, 290): 104981,
}


@pytest.mark.parametrize("h, golden", [(TWO, OWNERS_TWO), (ONE, OWNERS_ONE)])
def test_periodic_index(spark, h, golden):
    rows = spark.createDataFrame(list(golden), "i int, j int")
    pi, pj = fold.periodic(F.col("i"), F.col("j"), h)
    got = rows.withColumns({"pi": pi, "pj": pj}).select("i", "j", fold.linear(F.col("pi"), F.col("pj"), h).alias("n")).collect()
    assert {(r.i, r.j): r.n for r in got} == golden


@pytest.mark.parametrize("ni, nj", [(182, 149), (362, 292), (362, 332), (20, 15)])
@pytest.mark.parametrize("arrangement", "TUVFW")
def test_masters_are_their_own(spark, ni, nj, arrangement):
    h = header_of("g", ni, nj, arrangement)
    p = points.with_ghost(points.with_master(points.spine(spark, h), h), h)
    again = p.withColumn("m", fold.master(F.col("mi"), F.col("mj"), h))
    bad = again.agg(F.count_if((F.col("m.i") != F.col("mi")) | (F.col("m.j") != F.col("mj"))).alias("moved"), F.count_if((F.col("n_master") < 0) | (F.col("n_master") >= h.size)).alias("out"), F.count_if(~F.col("ghost") & (F.col("n") != F.col("n_master"))).alias("real")).first()
    assert tuple(bad) == (0, 0, 0)


def test_ghosts_and_sizes(spark):
    counts = {a: points.with_ghost(points.spine(spark, h), h).where("ghost").count() for a in "TUVF" for h in [header_of("g", 182, 149, a)]}
    assert counts == {"T": 747, "U": 748, "V": 838, "F": 658}
    derived = derive_headers(roster._grids(spark)).collect()
    assert len(derived) == 35
    for r in derived:
        h = header_of(r.grid, r.ni, r.nj, r.arrangement)
        assert (r.halo_n, r.halo_s, r.pivot_i, r.pivot_j, r.nx, r.ny) == (h.halo_n, h.halo_s, h.pivot_i, h.pivot_j, h.nx, h.ny)


#: Fixed values: (ix_min, ix_max, iy_min, iy_max) for 2 and 4 parts without halo.
RECTANGLES = {2: [(0, 90, 0, 147), (90, 180, 0, 147)], 4: [(0, 90, 0, 74), (89, 180, 0, 74), (0, 91, 73, 147), (90, 180, 73, 147)]}


@pytest.mark.parametrize("halo", [0, 1, 2])
@pytest.mark.parametrize("parts", [2, 4])
def test_rectangles(spark, parts, halo):
    owner = partition.owners(spark, TWO, parts)
    got = [tuple(r)[1:] for r in partition.rectangles(owner, halo).orderBy("part").collect()]
    assert got == [(a - halo, b + halo, c - halo, d + halo, 26460 // parts) for a, b, c, d in RECTANGLES[parts]]


@pytest.mark.parametrize("halo", [0, 1, 2])
def test_local_extents(spark, halo):
    rect = partition.rectangles(partition.owners(spark, TWO, 2), halo)
    got = [tuple(r)[1:] for r in local_grid.extents(rect, TWO).orderBy("mypart").collect()]
    assert got == [(-max(1, halo), 90 + halo, -1, 147 + halo), (90 - halo, 180 + halo, -1, 147 + halo)]


#: Per part (nodes, ghosts by number, ghost flags, cells).
MESHES = [
    (TWO, 1, 1, 0, [(27118, 0, 567, 26788)]),
    (TWO, 2, 1, 1, [(13950, 391, 630, 13708), (13950, 391, 719, 13708)]),
    (TWO, 2, 1, 2, [(14345, 786, 1025, 14100), (14345, 786, 1114, 14100)]),
    (TWO, 4, 2, 0, [(6992, 212, 287, 6825), (6992, 213, 287, 6825), (6975, 196, 360, 6808), (6825, 45, 299, 6660)]),
    (header_of("v", 182, 149, "V"), 2, 1, 1, [(13857, 298, 627, 13616), (13857, 298, 627, 13616)]),
]


@pytest.mark.parametrize("case", MESHES, ids=lambda c: f"{c[0].grid}-{c[1]}-{c[3]}")
def test_mesh_counts_and_links(spark, case):
    h, parts, bands, halo, golden = case
    d = roster.Decomposition(spark, h, parts, bands, halo)
    got = local_grid.counters(d.local).orderBy("mypart").collect()
    assert [(r.nodes, r.ghost_nodes, r.ghost_flags, r.real_cells + r.ghost_cells) for r in got] == golden
    if parts > 1:
        link = mesh.linked(d.nodes)
        assert link.where("remote_idx is null").count() == 0
        assert mesh.duplicate_owners(d.nodes).count() == 0
        values = d.nodes.where("not ghost").select("mypart", "inode", (F.col("master_glb_idx") * 3).alias("value"))
        off = mesh.exchanged(d.nodes, values).join(d.nodes, ["mypart", "inode"]).where("value <> master_glb_idx * 3")
        assert off.count() == 0


def test_registry(spark):
    reg = registry.specs(spark)
    assert reg.count() == 74 and reg.select("key").distinct().count() == 74
    names = reg.where("not is_uid").select("key", "uid").collect()
    asked = spark.createDataFrame([(r.key.lower(), r.uid) for r in names] + [(r.uid.upper(), r.uid) for r in names], "asked string, want string")
    assert registry.resolve(asked, reg).where("uid = want").count() == 70


def test_record_round_trip(spark, tmp_path):
    h = Header("tiny", 10, 8, 1, 1, 1, 1, 5.0, 6.0)
    p = points.grid_points(spark, h, F.col("mi") * 36.0, F.col("mj") * 10.0, F.col("mi") % 2 == 0).withColumn("invalid", F.col("n") % 7 == 0)
    record.write_record(p, h, str(tmp_path / "g"))
    h2, back = record.read_record(spark, str(tmp_path / "g"))
    assert h2 == h
    cols = ["n", "ih", "jh", "i", "j", "lon", "lat", "ghost", "water", "invalid"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, p.select(cols).collect()))
    with pytest.raises(ValueError):
        record.write_record(p.where("n > 0"), h, str(tmp_path / "bad"))


def test_text_lines_are_numbered_in_order(spark, tmp_path):
    lines = [f"{k} {'x' * (k % 50)}" for k in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = text_grid.read_lines(spark, str(tmp_path / "a.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in sorted(got, key=lambda r: r.line_no)] == lines


def test_content_uid_is_the_digest_of_the_bytes(spark):
    import hashlib
    import struct

    h = Header("tiny", 10, 8, 1, 1, 1, 1, 5.0, 6.0)
    p = points.grid_points(spark, h, F.col("mi") * 36.5, F.col("mj") * 10.25, F.lit(True))
    rows = p.orderBy("n").collect()
    want = hashlib.md5(b"T" + b"".join(struct.pack("<d", r.lat) for r in rows) + b"".join(struct.pack("<d", r.lon) for r in rows)).hexdigest()
    assert uid.content_uid(p.repartition(3), "T").first().uid == want
    assert uid.uid_matches(p, "T", want) and not uid.uid_matches(p, "W", want)
    assert uid.chunked_uid(p, "T").first().uid == uid.chunked_uid(p.repartition(5), "T").first().uid


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        header_of("x", 182, 149, "X")
    with pytest.raises(ValueError):
        partition.check_halo(1, 1)
    with pytest.raises(ValueError):
        partition.owners(spark, TWO, 3, 2)
    with pytest.raises(ValueError):
        partition.owners(spark, TWO, 2, partitioner="equal_area")


def test_quads(spark):
    lit = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    good = (lit(0, 0), lit(1, 0), lit(1, 1), lit(0, 1))
    folded = (lit(0, 0), lit(1, 0), lit(0, 1), lit(1, 1))
    r = spark.range(1).select(geometry.invalid_quad_2d(*good).alias("a"), geometry.invalid_quad_2d(*folded).alias("b"), geometry.invalid_quad_3d(*good).alias("c"), geometry.invalid_quad_3d(*folded).alias("d"), geometry.diagonal_too_large(*good, 1.0).alias("e"), geometry.diagonal_too_large(*good, 0).alias("f")).first()
    assert tuple(r) == (False, True, False, True, True, False)


def test_validation_and_classes_have_every_kind(spark):
    kinds = {r.kind for r in roster.QUERIES["text_validate_mismatches"](spark, None).collect()}
    assert kinds == {"no_master", "beyond_pivot", "on_pivot_row", "other"}
    found = roster.QUERIES["element_statistics_all_rules"](spark, None).first()
    assert min(found.invalid_quads_2d, found.invalid_quads_3d, found.diagonal_too_large) > 0
