"""Fields in bands of grid rows as a data source of Spark's: `spark.read.format("halocline_bands")`, and the same to write.

A path holds Arrow files of one band each and `index.json` with the version, the columns and, for each band, its file and the
bounds of its row `jh` and number `n`. Filters on either are pushed down to the choice of bands; Spark still evaluates them on
what is read. Each task that writes makes its own bands, under names that no other attempt has; the index, written last
by the driver, names those of the tasks that succeeded, so that a lost or repeated task leaves nothing that is read.

Paths are local, shared, or any URI that pyarrow opens. Rows without `jh` or `n` can't be placed and raise an error.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, VERSION, KEYS = "halocline_bands", 0, ("jh", "n")
BAND = 1 << 18  # rows a band at most


def _opened(path: str):
    from pyarrow import fs

    local = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def _index(path: str) -> dict:
    files, base = _opened(path)
    with files.open_input_stream(f"{base}/index.json") as stream:
        index = json.loads(stream.read())
    if index["version"] != VERSION:
        raise ValueError(f"{path}: only version {VERSION} of the bands is known")
    return index


@dataclass
class Band(InputPartition):
    file: str


@dataclass
class Written(WriterCommitMessage):
    bands: list[dict]


class BandReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.bounds = path, []  # of (column, least, most)

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", (None,))[-1]
            if column in KEYS:
                if isinstance(f, EqualTo):
                    self.bounds.append((column, f.value, f.value))
                elif isinstance(f, In) and f.value:
                    self.bounds.append((column, min(f.value), max(f.value)))
                elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.bounds.append((column, f.value + isinstance(f, GreaterThan), None))
                elif isinstance(f, LessThan | LessThanOrEqual):
                    self.bounds.append((column, None, f.value - isinstance(f, LessThan)))
            yield f  # a band also has rows that don't pass

    def partitions(self):
        inside = lambda b: all((low is None or b[c][1] >= low) and (high is None or b[c][0] <= high) for c, low, high in self.bounds)
        return [Band(b["file"]) for b in _index(self.path)["bands"] if inside(b)]

    def read(self, partition):
        import pyarrow as pa

        if partition is not None:  # there is one where no band is left
            files, base = _opened(self.path)
            with files.open_input_file(f"{base}/{partition.file}") as source:
                yield from pa.ipc.open_file(source).read_all().to_batches()


class BandWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, rows: int, overwrite: bool):
        self.path, self.columns, self.rows, self.overwrite = path, schema.jsonValue(), rows, overwrite
        if not set(KEYS) <= set(schema.names):
            raise ValueError(f"bands need the columns {' and '.join(KEYS)}")

    def write(self, iterator):
        import pyarrow as pa
        import pyarrow.compute as pc

        files, base = _opened(self.path)
        files.create_dir(base, recursive=True)
        bands, held, size = [], [], 0

        def put():
            table = pa.Table.from_batches(held)
            band = {"file": f"band-{uuid.uuid4().hex}.arrow"}
            for key in KEYS:
                if table.column(key).null_count:
                    raise ValueError(f"a row without {key}")
                ends = pc.min_max(table.column(key)).as_py()
                band[key] = [ends["min"], ends["max"]]
            with files.open_output_stream(f"{base}/{band['file']}") as sink, pa.ipc.new_file(sink, table.schema) as out:
                out.write_table(table)
            bands.append(band)

        for batch in iterator:
            for at in range(0, batch.num_rows, self.rows):
                part = batch.slice(at, self.rows)
                if held and size + part.num_rows > self.rows:
                    put()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            put()
        return Written(bands)

    def commit(self, messages):
        files, base = _opened(self.path)
        files.create_dir(base, recursive=True)
        bands = [b for m in messages if m is not None for b in m.bands]
        if not self.overwrite:
            try:
                bands = _index(self.path)["bands"] + bands
            except FileNotFoundError:
                pass
        with files.open_output_stream(f"{base}/index.json") as sink:
            sink.write(json.dumps({"version": VERSION, "schema": self.columns, "bands": sorted(bands, key=lambda b: (b["n"], b["file"]))}).encode())

    def abort(self, messages):
        files, base = _opened(self.path)
        for band in (b for m in messages if m is not None for b in m.bands):
            files.delete_file(f"{base}/{band['file']}")


class BandSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(_index(self.options["path"])["schema"])

    def reader(self, schema: StructType) -> BandReader:
        return BandReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> BandWriter:
        return BandWriter(self.options["path"], schema, int(self.options.get("rows", BAND)), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let it push filters down to formats of this kind."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BandSource)


def write_bands(field: DataFrame, path: str, rows: int = BAND) -> None:
    """Write a field (n, jh and others) so that bands hold ranges of points; what was at the path is replaced."""
    register(field.sparkSession)
    field.repartitionByRange("n").sortWithinPartitions("n").write.format(FORMAT).option("rows", rows).mode("overwrite").save(path)
