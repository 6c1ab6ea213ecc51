"""Results in an order: written by all tasks at once, read again with their places, without bringing them into one task.

`write_ordered` deals rows to tasks by ranges of their place; each writes a part and reports its range, rows and bytes, and
the driver publishes a manifest of the parts in order, with the row and byte at which each begins. Only the manifest makes
a result: parts of failed or repeated tasks are never read, and a result that is written anew replaces the old one at once.
`read_ordered` reads the parts, numbering rows from the manifest. `joined` makes one file of them, as its byte offsets are
known: tasks copy their parts into place side by side. That needs a file system that writes within a file (a shared POSIX
folder); object stores have no such thing, and there the parts with their manifest are the result.

`numbered` gives the line number of each row of any large CSV file: blocks of files are counted, and a row's place is its
block's offset and its place in the block, so it is met by one row a block. Rows whose quoted text holds line ends would
not be cut right and are not supported, as in Spark's own split of CSV files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.window import Window

from strataflow.sources import store

MANIFEST = "_ordered.json"
CHUNK = 1 << 20


@dataclass
class Part(WriterCommitMessage, InputPartition):
    file: str
    first: int
    last: int
    rows: int
    bytes: int
    crc32: int
    first_row: int = 0
    first_byte: int = 0


NOTHING = Part("", 0, 0, 0, 0, 0)


def rendered(batch: pa.RecordBatch) -> bytes:
    """Lines of CSV; text is quoted only in batches where some of it needs quotes."""
    special = any(pc.any(pc.match_substring_regex(c, '[",\r\n]')).as_py() for c in batch.columns if pa.types.is_string(c.type))
    out = pa.BufferOutputStream()
    pacsv.write_csv(batch, out, pacsv.WriteOptions(include_header=False, quoting_style="needed" if special else "none"))
    return out.getvalue().to_pybytes()


class OrderedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.folder, self.names = options["path"], [n for n in schema.names if n != "place"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        fs, root = store.opened(self.folder)
        part, out = NOTHING, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                places = batch.column(batch.schema.get_field_index("place"))
                steps = pc.pairwise_diff(places)
                if places.null_count or (part.rows and places[0].as_py() <= part.last) or pc.any(pc.less_equal(steps, 0)).as_py():
                    raise ValueError("places must be given, differ, and come in order")
                if not part.rows:
                    part = Part(f"part-{uuid.uuid4().hex}.csv", places[0].as_py(), 0, 0, 0, 0)
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{part.file}", compression=None)
                lines = rendered(batch.select(self.names))
                out.write(lines)
                part.bytes, part.crc32 = part.bytes + len(lines), zlib.crc32(lines, part.crc32)
                part.last, part.rows = places[-1].as_py(), part.rows + batch.num_rows
        finally:
            if out is not None:
                out.close()
        return part

    def commit(self, messages: list[Part]) -> None:
        parts = sorted((m for m in messages if m.rows), key=lambda m: m.first)
        row = byte = 0
        for before, m in zip([None, *parts], parts, strict=False):
            if before is not None and m.first <= before.last:
                raise ValueError("places repeat between parts")
            m.first_row, m.first_byte = row, byte
            row, byte = row + m.rows, byte + m.bytes
        fs, root = store.opened(self.folder)
        old = store.read_json(self.folder, MANIFEST)
        store.write_json(self.folder, MANIFEST, {"columns": self.names, "rows": row, "bytes": byte, "parts": [vars(m) for m in parts]})
        for m in old["parts"] if old else []:
            store.removed(fs, f"{root}/{m['file']}")

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = store.opened(self.folder)
        for m in messages:
            if m is not None and m.rows:
                store.removed(fs, f"{root}/{m.file}")


def manifest(folder: str) -> dict:
    found = store.read_json(folder, MANIFEST)
    if found is None:
        raise FileNotFoundError(f"no result in {folder}")
    return found


class OrderedReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.folder, self.schema = options["path"], schema

    def partitions(self) -> list[Part]:
        return [Part(**m) for m in manifest(self.folder)["parts"]] or [NOTHING]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        fs, root = store.opened(self.folder)
        size = fs.get_file_info(f"{root}/{part.file}").size
        if size != part.bytes:
            raise ValueError(f"{part.file} has {size} bytes, its manifest says {part.bytes}")
        types = {f.name: pa.string() if isinstance(f.dataType, T.StringType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.int64() for f in self.schema.fields if f.name != "place"}
        with fs.open_input_stream(f"{root}/{part.file}", compression=None) as stream:
            lines = pacsv.open_csv(stream, read_options=pacsv.ReadOptions(column_names=manifest(self.folder)["columns"], block_size=CHUNK, use_threads=False), convert_options=pacsv.ConvertOptions(include_columns=list(types), column_types=types, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""]))
            at = part.first_row
            for batch in lines:
                out = {n: batch.column(batch.schema.get_field_index(n)) for n in types} | {"place": pa.array(range(at, at + batch.num_rows), pa.int64())}
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([out[n] for n in self.schema.names], names=self.schema.names)
        if at != part.first_row + part.rows:
            raise ValueError(f"{part.file} has {at - part.first_row} rows, its manifest says {part.rows}")


class Ordered(DataSource):
    """format("ordered"): option path is the result's folder; the column place orders rows and is not written."""

    @classmethod
    def name(cls) -> str:
        return "ordered"

    def reader(self, schema: T.StructType) -> OrderedReader:
        return OrderedReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> OrderedWriter:
        return OrderedWriter(self.options, schema)


def write_ordered(rows: DataFrame, folder: str) -> None:
    """Rows with a unique long `place` and other columns, as CSV parts in its order; replaces what is there."""
    rows.sparkSession.dataSource.register(Ordered)
    rows.repartitionByRange("place").sortWithinPartitions("place").write.format("ordered").mode("append").save(folder)


def read_ordered(spark: SparkSession, folder: str, columns: dict[str, str]) -> DataFrame:
    """place (from 0) and the columns asked for, as string, double or long."""
    spark.dataSource.register(Ordered)
    return spark.read.format("ordered").schema(", ".join(["place long", *(f"`{c}` {t}" for c, t in columns.items())])).load(folder)


def joined(spark: SparkSession, folder: str, name: str = "result.csv") -> str:
    """One CSV file with a header of a result's parts, beside them: (re)made as a whole, by tasks that copy side by side."""
    found = manifest(folder)
    fs, root = store.opened(folder)
    if fs.type_name != "local":
        raise ValueError(f"{folder}: one file can be put together in a shared POSIX folder only; read the parts by their manifest")
    header = (",".join(found["columns"]) + "\n").encode()
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(header)
        out.truncate(len(header) + found["bytes"])
    start = len(header)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                crc = 0
                with open(f"{root}/{row['file']}", "rb") as source, open(part, "r+b") as out:
                    out.seek(start + row["first_byte"])
                    while data := source.read(CHUNK):
                        crc = zlib.crc32(data, crc)
                        out.write(data)
                if crc != row["crc32"]:
                    raise ValueError(f"{row['file']} is not what was written")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    if found["parts"]:
        listed = spark.createDataFrame([(m["file"], m["first_byte"], m["crc32"]) for m in found["parts"]], "file string, first_byte long, crc32 long")
        n = listed.repartition(len(found["parts"]), "first_byte").mapInArrow(copied, "n long").agg(F.sum("n")).first()[0]
        if n != len(found["parts"]):
            raise ValueError(f"{n} of {len(found['parts'])} parts were copied")
    Path(part).rename(f"{root}/{name}")
    return f"{folder.rstrip('/')}/{name}"


def numbered(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """place (the row's number in its file, from 0), file and the columns of CSV files of any size."""
    rows = spark.read.schema(schema).option("header", header).option("enforceSchema", False).csv(path)
    at = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = at.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # a row for each block of a file: Spark broadcasts it below its threshold by its own measure
    return at.join(blocks, ["file", "_block"]).select((F.col("_before") + F.col("_at") - F.col("_first")).alias("place"), "file", *rows.columns)
