"""Folders of many small CSV files, one for each well, as a Spark data source.

Reading: files are packed into partitions by size; each is read as a stream of batches, of which only the asked columns are
parsed, and row_id is the line's number in its file, so nothing is shuffled or sorted. Cells are read as text first: an
empty cell, NaN or an infinity is NULL; any other text that is not a number is NULL too, and is kept in `bad_cells`, a map
from column to text (NULL for rows without any). Columns are found by the header's names; an absent one is an error, and so
is a line with another number of fields. An empty file gives no rows.

Writing: each task writes a folder of its own, a file a well (rows of a well must come together and in order, as
`write_wells` deals them), and reports only that folder; the driver then publishes one manifest of folders. Readers of a
split with manifests see the published folders only, so what failed or repeated tasks leave behind is never read; without
a manifest the files right in the split's folder are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strataflow.sources import store

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MISSING = ["", "nan", "na", "null", "none", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]
KIND = "horizontal_well.csv"
BAD = "bad_cells"
#: Files are packed up to so many bytes a partition; opening one counts as OPEN_COST bytes.
PARTITION_BYTES, OPEN_COST = 32 << 20, 1 << 18
MANIFEST = "_wells-"


def well_files(folder: str, kind: str) -> list[tuple[str, int]]:
    """(path, bytes) of a split's files of a kind: of the published folders, or else of the folder itself."""
    found = store.files_in(folder)
    manifests = [p.rpartition("/")[2] for p, _ in found if p.rpartition("/")[2].startswith(MANIFEST)]
    if manifests:
        found = [f for m in manifests for part in store.read_json(folder, m)["folders"] for f in store.files_in(f"{folder}/{part}")]
    return sorted((p, n) for p, n in found if p.endswith(f"__{kind}"))


def numbers(raw: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(values, whether the text is neither a number nor missing) of an array of text."""
    text = pc.utf8_trim_whitespace(raw)
    number = pc.match_substring_regex(text, NUMBER)
    values = pc.if_else(number, text, pa.scalar(None, pa.string())).cast(pa.float64())
    values = pc.if_else(pc.is_finite(values), values, pa.scalar(None, pa.float64()))
    missing = pc.is_in(pc.utf8_lower(text), value_set=pa.array(MISSING))
    return values, pc.and_(pc.invert(number), pc.invert(missing))


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class WellReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.folder, self.kind = options["path"], options.get("kind", KIND)
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.schema = schema

    def partitions(self) -> list[Files]:
        found, bins = well_files(self.folder, self.kind), []
        if not found:
            raise FileNotFoundError(f"no files *__{self.kind} in {self.folder}")
        room = 0
        for path, size in sorted(found, key=lambda f: (-f[1], f[0])):
            if size + OPEN_COST > room:
                bins.append([])
                room = self.most
            bins[-1].append((path, size))
            room -= size + OPEN_COST
        return [Files(b) for b in bins]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = store.opened(self.folder)
        for path, size in partition.files:
            if size:
                yield from self.batches(fs, path)

    def batches(self, fs, path: str) -> Iterator[pa.RecordBatch]:
        asked = [f for f in self.schema.fields if f.name not in ("well_id", "row_id", BAD)]
        names = [f.name for f in asked]
        convert = pacsv.ConvertOptions(include_columns=names or None, column_types={n: pa.string() for n in names}, strings_can_be_null=False, quoted_strings_can_be_null=False)
        with fs.open_input_stream(path, compression=None) as stream:
            try:
                lines = pacsv.open_csv(stream, read_options=pacsv.ReadOptions(block_size=1 << 20, use_threads=False), convert_options=convert)
            except (pa.ArrowInvalid, KeyError) as e:
                raise ValueError(f"{path}: {e}") from e
            at = 0
            for batch in lines:
                yield self.typed(batch, asked, path.rpartition("/")[2].partition("__")[0], at)
                at += batch.num_rows

    def typed(self, batch: pa.RecordBatch, asked: list[T.StructField], well: str, at: int) -> pa.RecordBatch:
        n, out, bad = batch.num_rows, {}, {}
        for f in asked:
            raw = batch.column(batch.schema.get_field_index(f.name))
            if isinstance(f.dataType, T.StringType):
                out[f.name] = pc.if_else(pc.equal(raw, ""), pa.scalar(None, pa.string()), raw)
                continue
            out[f.name], wrong = numbers(raw)
            for i in pc.indices_nonzero(wrong).to_pylist():
                bad.setdefault(i, []).append((f.name, raw[i].as_py()))
        cells = pa.map_(pa.string(), pa.string())
        out |= {"well_id": pa.array([well] * n, pa.string()), "row_id": pa.array(range(at, at + n), pa.int64()), BAD: pa.array([bad.get(i) for i in range(n)], cells) if bad else pa.nulls(n, cells)}
        return pa.RecordBatch.from_arrays([out[f.name] for f in self.schema.fields], names=self.schema.names)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int
    rows: int


class WellWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.kind, self.overwrite = options["path"], options.get("kind", KIND), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = store.opened(self.folder)
        part, done, out, current = f"part-{uuid.uuid4().hex}", set(), None, None
        files = rows = 0
        try:
            for batch in batches:
                wells = batch.column(batch.schema.get_field_index("well_id"))
                data = batch.drop_columns(["well_id", "row_id"])
                runs, at = pc.run_end_encode(wells), 0
                for run, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    if run != current:
                        if run is None or run in done or "/" in run or "__" in run:
                            raise ValueError(f"well {run!r}: its rows must come together, and its id must name a file")
                        if out is not None:
                            out.close()
                        if not files:
                            fs.create_dir(f"{root}/{part}", recursive=True)
                        out, current = pacsv.CSVWriter(fs.open_output_stream(f"{root}/{part}/{run}__{self.kind}", compression=None), data.schema, write_options=pacsv.WriteOptions(quoting_style="needed")), run
                        done.add(run)
                        files += 1
                    out.write_batch(data.slice(at, end - at))
                    at = end
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(part, files, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = store.opened(self.folder)
        before = [p for p, _ in store.files_in(self.folder) if p.rpartition("/")[2].startswith(MANIFEST)]
        kept = [m for m in messages if m is not None and m.files]
        store.write_json(self.folder, f"{MANIFEST}{uuid.uuid4().hex}.json", {"folders": [m.folder for m in kept], "files": sum(m.files for m in kept), "rows": sum(m.rows for m in kept)})
        if self.overwrite:
            for path in before:
                fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = store.opened(self.folder)
        for m in messages:
            if m is not None:
                store.removed(fs, f"{root}/{m.folder}")


class Wells(DataSource):
    """format("wells"): option path is a split's folder, kind the file names' ending, partitionBytes the packing."""

    @classmethod
    def name(cls) -> str:
        return "wells"

    def reader(self, schema: T.StructType) -> WellReader:
        return WellReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WellWriter:
        return WellWriter(self.options, overwrite)


def read_wells(spark: SparkSession, folder: str, columns: dict[str, str], kind: str = KIND, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """well_id, row_id, the columns asked for (name: double or string) and bad_cells of a split's files."""
    spark.dataSource.register(Wells)
    schema = ", ".join(["well_id string", "row_id long", *(f"`{c}` {t}" for c, t in columns.items()), f"{BAD} map<string,string>"])
    return spark.read.format("wells").schema(schema).option("kind", kind).option("partitionBytes", partition_bytes).load(folder)


def write_wells(rows: DataFrame, folder: str, kind: str = KIND, mode: str = "append") -> None:
    """Rows (well_id, row_id and other columns) as a file for each well, ordered by row_id, which is not written."""
    rows.sparkSession.dataSource.register(Wells)
    rows.repartition("well_id").sortWithinPartitions("well_id", "row_id").write.format("wells").option("kind", kind).mode(mode).save(folder)


def counted(spark: SparkSession, folder: str, kinds: dict[str, str]) -> DataFrame:
    """kind, file_count, total_bytes of a split, from its listing."""
    found = {name: well_files(folder, kind) for name, kind in kinds.items()}
    return spark.createDataFrame([(name, len(files), sum(n for _, n in files)) for name, files in found.items()], "kind string, file_count long, total_bytes long")


def bad_counts(rows: DataFrame) -> DataFrame:
    """column_name, cells: how many cells of each column are not numbers."""
    return rows.select(F.explode(BAD).alias("column_name", "cell")).groupBy("column_name").agg(F.count("*").alias("cells"))
