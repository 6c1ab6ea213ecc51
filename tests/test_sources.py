"""Well files and ordered results: pruning, bad cells, packing, commits, failed and repeated tasks, line numbers."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.sources import ordered, store, wellfiles

COLUMNS = {"md": "double", "tag": "string", "gr": "double"}


def well(folder: Path, name: str, text: str) -> None:
    folder.mkdir(exist_ok=True)
    (folder / f"{name}__horizontal_well.csv").write_text(text)


def test_cells_that_are_no_numbers(spark, tmp_path):
    well(tmp_path / "s", "a", 'md,tag,gr\n1,x,2.5\n 2 ,,nan\nabc,"q,r",-inf\n1e3,z,\n"4,5",z,1e999\n')
    well(tmp_path / "s", "b", "gr,extra,tag,md\n.5,9,t,-3.\n")
    well(tmp_path / "s", "empty", "")
    well(tmp_path / "s", "header", "md,tag,gr\n")
    rows = wellfiles.read_wells(spark, str(tmp_path / "s"), COLUMNS)
    got = {(r.well_id, r.row_id): (r.md, r.tag, r.gr, r.bad_cells) for r in rows.collect()}
    assert got == {
        ("a", 0): (1.0, "x", 2.5, None), ("a", 1): (2.0, None, None, None), ("a", 2): (None, "q,r", None, {"md": "abc"}),
        ("a", 3): (1000.0, "z", None, None), ("a", 4): (None, "z", None, {"md": "4,5"}), ("b", 0): (-3.0, "t", 0.5, None),
    }
    assert {r.column_name: r.cells for r in wellfiles.bad_counts(rows).collect()} == {"md": 2}
    assert [tuple(r) for r in wellfiles.read_wells(spark, str(tmp_path / "s"), {"gr": "double"}).filter("well_id = 'b'").collect()] == [("b", 0, 0.5, None)]
    assert wellfiles.read_wells(spark, str(tmp_path / "s"), {}).count() == 6
    plan = rows._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_faulty_files_are_named(spark, tmp_path):
    with pytest.raises(Exception, match="no files"):
        wellfiles.read_wells(spark, str(tmp_path / "none"), COLUMNS).collect()
    well(tmp_path / "s", "a", "md,tag\n1,x\n")
    with pytest.raises(Exception, match="a__horizontal_well.csv"):
        wellfiles.read_wells(spark, str(tmp_path / "s"), COLUMNS).collect()
    well(tmp_path / "t", "a", "md,tag,gr\n1,x\n")
    with pytest.raises(Exception, match="(?i)column"):
        wellfiles.read_wells(spark, str(tmp_path / "t"), COLUMNS).collect()


def test_files_are_packed_by_size(spark, tmp_path):
    for i in range(40):
        well(tmp_path / "s", f"w{i:02d}", "md,tag,gr\n" + "1,x,2\n" * (i + 1))
    cost = wellfiles.OPEN_COST
    rows = wellfiles.read_wells(spark, str(tmp_path / "s"), COLUMNS, partition_bytes=8 * cost + 4000)
    parts = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count_distinct("well_id").alias("n")).collect()]
    assert sum(parts) == 40 and max(parts) == 8
    assert rows.count() == sum(range(1, 41)) and rows.groupBy("well_id").agg((F.max("row_id") + 1 == F.count("*")).alias("ok")).filter("ok").count() == 40


def test_only_published_folders_are_read(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = spark.createDataFrame([(w, i, i / 3) for w in "abc" for i in range(5)], "well_id string, row_id long, md double")
    wellfiles.write_wells(rows, folder)
    read = lambda: sorted((r.well_id, r.row_id, r.md) for r in wellfiles.read_wells(spark, folder, {"md": "double"}).collect())
    whole = read()
    assert whole == sorted((w, i, i / 3) for w in "abc" for i in range(5))
    # a second attempt of a task and a file of an unfinished one
    writer = wellfiles.WellWriter({"path": folder}, False)
    batch = pa.RecordBatch.from_pydict({"well_id": ["a", "a", "b"], "row_id": [0, 1, 0], "md": [1.0, 2.0, 3.0]})
    again = writer.write(iter([batch]))
    assert (again.files, again.rows) == (2, 3) and read() == whole
    writer.abort([again, None])
    assert not (tmp_path / "s" / again.folder).exists()
    with pytest.raises(ValueError, match="come together"):
        writer.write(iter([batch, batch]))
    # a failing job publishes nothing
    with pytest.raises(Exception, match="(?i)zero"):
        wellfiles.write_wells(rows.withColumn("md", F.expr("1 / (row_id - 4)")), folder)
    assert read() == whole
    wellfiles.write_wells(rows.filter("well_id = 'c'"), folder, mode="overwrite")
    assert {w for w, *_ in read()} == {"c"}
    wellfiles.write_wells(rows.filter("well_id = 'a'"), folder)
    assert {w for w, *_ in read()} == {"a", "c"}


def results(spark, n: int, parts: int):
    rows = spark.range(0, n, 1, parts).select((F.col("id") * 7 - 50).alias("place"), F.concat(F.lit('a,"'), "id").alias("id"), F.when(F.col("id") % 5 > 0, F.col("id") / 7).alias("tvt"))
    return rows.orderBy(F.hash("place"))


@pytest.fixture
def small_parts(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_ordered_result_in_parts_and_in_one_file(spark, tmp_path, small_parts):
    folder = str(tmp_path / "r")
    ordered.write_ordered(results(spark, 3000, 5), folder)
    found = ordered.manifest(folder)
    assert len(found["parts"]) == 4 and found["rows"] == 3000 and [p["first_row"] for p in found["parts"]] == sorted(p["first_row"] for p in found["parts"])
    want = [(i, f'a,"{i}', i / 7 if i % 5 else None) for i in range(3000)]
    rows = ordered.read_ordered(spark, folder, {"id": "string", "tvt": "double"})
    assert sorted(map(tuple, rows.collect())) == want and "Exchange" not in rows._jdf.queryExecution().toString()
    path = ordered.joined(spark, folder)
    one = ordered.numbered(spark, path, "id string, tvt double")
    assert sorted((r.place, r.tvt) for r in one.collect()) == [(i, t) for i, _, t in want]
    assert one.select(F.spark_partition_id()).distinct().count() > 5  # many tasks
    assert Path(path).read_text().splitlines()[:3] == ["id,tvt", '"a,""0",', '"a,""1",0.14285714285714285']
    # replaced as a whole; damage is found
    ordered.write_ordered(results(spark, 40, 2), folder)
    assert ordered.read_ordered(spark, folder, {"tvt": "double"}).count() == 40 and len(list((tmp_path / "r").glob("part-*"))) == len(ordered.manifest(folder)["parts"])
    part = tmp_path / "r" / ordered.manifest(folder)["parts"][0]["file"]
    part.write_text(part.read_text().replace("a", "b"))
    with pytest.raises(Exception, match="not what was written"):
        ordered.joined(spark, folder)
    part.write_text(part.read_text() + "more,1\n")
    with pytest.raises(Exception, match="bytes"):
        ordered.read_ordered(spark, folder, {"tvt": "double"}).collect()


def test_ordered_commit(spark, tmp_path):
    folder = str(tmp_path / "r")
    writer = ordered.OrderedWriter({"path": folder}, T.StructType([T.StructField("place", T.LongType()), T.StructField("v", T.LongType())]))
    batch = lambda *places: pa.RecordBatch.from_pydict({"place": pa.array(places, pa.int64()), "v": pa.array(places, pa.int64())})
    lost = writer.write(iter([batch(1, 2), batch(3)]))  # an executor is lost after this; its task runs again elsewhere
    first, second = writer.write(iter([batch(1, 2), batch(3)])), writer.write(iter([batch(5), batch(9, 10)]))
    with pytest.raises(FileNotFoundError):
        ordered.manifest(folder)
    writer.commit([second, writer.write(iter([])), first])
    assert [p["file"] for p in ordered.manifest(folder)["parts"]] == [first.file, second.file]
    assert sorted(map(tuple, ordered.read_ordered(spark, folder, {"v": "long"}).collect())) == list(enumerate([1, 2, 3, 5, 9, 10])) and lost.file != first.file
    for bad in ([batch(3, 3)], [batch(4, 2)], [batch(1), batch(1)], [batch(None)]):
        with pytest.raises(ValueError, match="order"):
            writer.write(iter(bad))
    with pytest.raises(ValueError, match="repeat"):
        writer.commit([first, writer.write(iter([batch(2, 20)]))])
    assert ordered.manifest(folder)["rows"] == 6
    with pytest.raises(Exception):  # noqa: B017  the job fails, the old result stays
        ordered.write_ordered(spark.range(4).select(F.lit(1).cast("long").alias("place"), F.col("id").alias("v")), folder)
    assert ordered.manifest(folder)["rows"] == 6


def test_json_appears_whole(tmp_path):
    assert store.read_json(str(tmp_path), "x.json") is None
    store.write_json(str(tmp_path), "x.json", {"a": 1})
    store.write_json(f"file://{tmp_path}", "x.json", {"a": 2})
    assert store.read_json(str(tmp_path), "x.json") == {"a": 2} and store.files_in(str(tmp_path / "none")) == []
