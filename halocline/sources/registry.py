"""The grid registry: specs by name and content hash, name resolution and planning of data files.

The registry is a small dimension table of fixed size; everything joined to it broadcasts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_TYPE = "ORCA"
NAME_PATTERN = "^e?ORCA[0-9]+_[FTUVW]$"
#: Where data files lie is a setting; this is only a placeholder for plans and tests.
DEFAULT_BASE = "https://grids.example.org/tripolar"
CACHE_FOLDER = "grids/tripolar"

#: The published grids by name, their points with halo, and the content hashes of their arrangements.
DIMENSIONS = {
    "ORCA2": (182, 149),
    "ORCA1": (362, 292),
    "eORCA1": (362, 332),
    "ORCA025": (1442, 1021),
    "eORCA025": (1442, 1207),
    "ORCA12": (4322, 3059),
    "eORCA12": (4322, 3606),
}
UIDS = {
    "ORCA2_F": "174487fbace54b00d959d971e88b71e7",
    "ORCA2_T": "d5bde4f52ff3a9bea5629cd9ac514410",
    "ORCA2_U": "857f7affa3a381e3882d38d321384e49",
    "ORCA2_V": "ca637bc5dc9a54e2ea4b9750e1b79e6e",
    "ORCA2_W": "edea6f71eb558dc056b5f576d5b904f7",
    "ORCA1_F": "a832a12030c73928133553ec3a8d2a7e",
    "ORCA1_T": "f4c91b6233fe55dec992160ec12b38df",
    "ORCA1_U": "1b0f8d234753f910197c975c906b4da5",
    "ORCA1_V": "c637340454795b395f982851b840943d",
    "ORCA1_W": "d50061c43e83c46c3810002591ea21e1",
    "eORCA1_F": "3c6d95561710c6f39b394809ff6c588c",
    "eORCA1_T": "ba65665a9e68d1a8fa0352ecfcf8e496",
    "eORCA1_U": "4eb1054957dcae914e219faf9a4068e3",
    "eORCA1_V": "09131429766e7737c087d3a8d7073dc9",
    "eORCA1_W": "5c678d8f9aa2edfbf57246d11d9c1278",
    "ORCA025_F": "efbc280d8d4b6048797880da2605bacb",
    "ORCA025_T": "15c961c269ac182ca226d7195f3921ba",
    "ORCA025_U": "3f4a68bc5b54c9f867fbcc12aacc723d",
    "ORCA025_V": "9c87699ee2026c0feee07d2a972eaccd",
    "ORCA025_W": "74ca68f1c8524811f3d3aad99536adc2",
    "eORCA025_F": "770e5bbb667a253d55db8a98a3b2d3a9",
    "eORCA025_T": "983412216c9768bc794c18dc92082895",
    "eORCA025_U": "b1b2922e9b57ee9c6eeddad218b6e4f3",
    "eORCA025_V": "9b06bf73a8f14e927bd9b0f1f0c04f74",
    "eORCA025_W": "4a1ba3b11b8888aefc96992b6b1cab62",
    "ORCA12_F": "29693ad8a7af3ae3ee0f02d090f0ec7b",
    "ORCA12_T": "b117d01170ac77bca68560ab10e559de",
    "ORCA12_U": "fff193b92d94d03e847ff2fa62b493f4",
    "ORCA12_V": "986e3450774b716f6e75c1987e370b10",
    "ORCA12_W": "ccfe953619a8dd49a7f765923882a274",
    "eORCA12_F": "25da53ed581b3931fa310840fa9aefd9",
    "eORCA12_T": "1553b66f5885cf5f83ad4b4fdf25f460",
    "eORCA12_U": "3e87c826643da440b4e9d9f67588a576",
    "eORCA12_V": "cc1e3fc06a2cd18c0653e557510b8a71",
    "eORCA12_W": "462469edbd0e0586a0cf17424cc58c89",
}
#: Older hashes under which grids are still known.
OLD_UIDS = {
    "eORCA1_T": "16076978a048410747dd7c9876677b28",
    "eORCA1_U": "7378487847e050559b82d0792374a705",
    "eORCA1_V": "d9622b55f3120eafb3dbaf5c742bc56c",
    "eORCA1_W": "0067c81a4154eaa5187f9b0f53e9df7e",
}


def specs(spark: SparkSession, base: str = DEFAULT_BASE) -> DataFrame:
    """One row per key: every grid under its name and its hash, some under an older hash too."""
    rows = []
    for name, uid in UIDS.items():
        grid, arrangement = name.rsplit("_", 1)
        ni, nj = DIMENSIONS[grid]
        # W points lie over T points and share their file.
        url = f"{base}/v0/{grid}_{'T' if arrangement == 'W' else arrangement}.grid"
        for key in (name, uid, OLD_UIDS.get(name)):
            if key:
                rows.append((key, key != name, GRID_TYPE, grid, arrangement, ni, nj, uid, url))
    return spark.createDataFrame(rows, SPEC)


SPEC = "key string, is_uid boolean, grid_type string, grid_name string, arrangement string, ni int, nj int, uid string, data_url string"


def parse_specs(texts: DataFrame, column: str = "value") -> DataFrame:
    """Specs in the text of registry files, a file a row: anchored entries as spec_yaml writes them, and aliases of them.

    An alias that names no entry has no row.
    """
    text = F.regexp_replace(column, r"\r", "")
    block = F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^(\S+: *&\S+ *(?:\n[ \t]+\S.*)*)"), 1)).alias("block")
    field = lambda name: F.trim(F.regexp_extract("block", rf"(?m)^[ \t]+{name}: *(.*?) *$", 1))
    size = lambda k: F.regexp_extract("block", r"(?m)^[ \t]+dimensions: *\[ *([0-9]+) *, *([0-9]+) *\]", k).cast("int")
    own = texts.select(block).select(
        F.regexp_extract("block", r"^(\S+): *&", 1).alias("key"),
        F.regexp_extract("block", r"&(\S+)", 1).alias("anchor"),
        *[field(k).alias(c) for k, c in (("type", "grid_type"), ("orca_name", "grid_name"), ("orca_arrangement", "arrangement"))],
        size(1).alias("ni"),
        size(2).alias("nj"),
        field("uid").alias("uid"),
        field("data").alias("data_url"),
    )
    line = F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^(\S+: *\*\S+)"), 1)).alias("line")
    other = texts.select(line).select(F.regexp_extract("line", r"^(\S+):", 1).alias("alias"), F.regexp_extract("line", r"\*(\S+)", 1).alias("anchor"))
    cols = ["grid_type", "grid_name", "arrangement", "ni", "nj", "uid", "data_url"]
    rows = own.select("key", F.lit(False).alias("is_uid"), *cols)
    return rows.unionByName(other.join(own.drop("key"), "anchor").select(F.col("alias").alias("key"), F.col("alias").rlike("^[0-9a-f]{32}$").alias("is_uid"), *cols))


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """The specs of registry files (a file, a folder or a pattern)."""
    return parse_specs(spark.read.text(path, wholetext=True))


def spec_name(grid_name: Column, arrangement: Column, otherwise: Column) -> Column:
    """Name and arrangement joined, or `otherwise` if either is missing or empty."""
    there = (F.coalesce(grid_name, F.lit("")) != "") & (F.coalesce(arrangement, F.lit("")) != "")
    return F.when(there, F.concat(grid_name, F.lit("_"), arrangement)).otherwise(otherwise)


def as_uid(key: Column) -> Column:
    return F.lower(key)


def as_name(key: Column) -> Column:
    """Upper case but for a leading e."""
    return F.regexp_replace(F.upper(key), "^E", "e")


def resolve(asked: DataFrame, registry: DataFrame, key: str = "asked") -> DataFrame:
    """`asked` with its spec: by hash first, else by name; nulls where there is none."""
    by = F.broadcast(registry)
    cols = [c for c in registry.columns if c != "key"]
    first = by.select(F.col("key").alias("k1"), F.struct(*cols).alias("s1"))
    second = by.select(F.col("key").alias("k2"), F.struct(*cols).alias("s2"))
    found = asked.join(first, as_uid(F.col(key)) == F.col("k1"), "left").join(second, as_name(F.col(key)) == F.col("k2"), "left")
    return found.withColumn("spec", F.coalesce("s1", "s2")).select(*asked.columns, F.coalesce("k1", F.when(F.col("s1").isNull(), F.col("k2"))).alias("key"), *[F.col(f"spec.{c}").alias(c) for c in cols])


def cached_path(url: Column, known: list[str]) -> Column:
    """Relative path of a data file: behind the first known prefix, else by its last part; other paths are kept."""
    out = F.concat(F.lit(f"{CACHE_FOLDER}/unknown"), F.regexp_extract(url, "(/[^/]*)$", 1))
    for prefix in reversed(known):
        out = F.when(url.startswith(prefix), F.concat(F.lit(CACHE_FOLDER), F.substring(url, len(prefix) + 1, 1 << 30))).otherwise(out)
    return F.when(url.startswith("http"), out).otherwise(url)


def downloads(registry: DataFrame, grids: str = "") -> DataFrame:
    """Distinct URLs to fetch, in order, for a list of names (parted by space, comma or semicolon); all if it is empty."""
    wanted = [g for g in split_names(grids) if g]
    chosen = registry.where(F.col("key").isin(*wanted)) if wanted else registry
    return chosen.where(F.col("data_url").startswith("http")).select("data_url").distinct().orderBy("data_url")


def split_names(text: str) -> list[str]:
    return text.replace(",", " ").replace(";", " ").split()


def pretty_bytes(n: Column) -> Column:
    """A size in the largest unit of 1024 that leaves at least one."""
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    out = F.concat(F.format_string("%.1f", n / float(1024 ** (len(units) - 1))), F.lit(" " + units[-1]))
    for k in range(len(units) - 2, -1, -1):
        out = F.when(F.abs(n) < float(1024 ** (k + 1)), F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {units[k]}"))).otherwise(out)
    return out


def spec_yaml(specs_: DataFrame, location: str = "{{location}}") -> DataFrame:
    """(name, yaml): the registry entry of each spec as text."""
    name = F.concat("grid_name", F.lit("_"), "arrangement")
    lines = [
        F.concat(name, F.lit(": &"), name),
        F.concat(F.lit("    type: "), "grid_type"),
        F.concat(F.lit("    orca_arrangement: "), "arrangement"),
        F.concat(F.lit("    orca_name: "), "grid_name"),
        F.format_string("    dimensions: [%d,%d]", "ni", "nj"),
        F.concat(F.lit("    uid: "), "uid"),
        F.concat(F.lit(f"    data: {location}/"), F.substring_index("data_url", "/", -1)),
        F.concat("uid", F.lit(": *"), name),
    ]
    return specs_.select(name.alias("name"), F.concat_ws("\n", *lines).alias("yaml"))
