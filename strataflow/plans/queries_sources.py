"""Round trips through the library's files as queries: what is written to the shared folder is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataflow.functions.scalar import rounded
from strataflow.operators.staging import fresh_folder
from strataflow.plans.wellview import WELL, WELLS_SQL, curve, r6, wells
from strataflow.plans.wellview import CURVE_SQL
from strataflow.sources import ordered, wellfiles

c = F.col
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = f"WITH {WELLS_SQL}, {CURVE_SQL} {sql}"
        return fn

    return add


_NUMBERS = ("md", "x", "y", "z", "tvt", "gr", "tvt_input")


@query(f"SELECT well_id, row_id, {', '.join(f'{r6(v)} AS {v}' for v in _NUMBERS)}, CAST(0 AS BIGINT) AS bad FROM w")
def well_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All wells written as a CSV file each and read again; line numbers are the row ids."""
    folder = fresh_folder(spark, "wells") + "/train"
    wellfiles.write_wells(wells(spark, sf_dir).select("well_id", "row_id", *_NUMBERS), folder)
    found = wellfiles.read_wells(spark, folder, dict.fromkeys(_NUMBERS, "double"))
    return found.select("well_id", "row_id", *(rounded(c(v)).alias(v) for v in _NUMBERS), F.coalesce(F.size("bad_cells"), F.lit(0)).cast("long").alias("bad"))


@query(f"""SELECT column_name, count(*) FILTER (bad) AS bad_cells, count(v) AS numbers, count(DISTINCT well_id) FILTER (bad) AS wells_hit, {r6('coalesce(avg(v), 0)')} AS mean FROM (
SELECT well_id, 'gr' AS column_name, row_id % 13 = 5 AS bad, CASE WHEN row_id % 13 <> 5 AND row_id % 7 <> 3 THEN gr END AS v FROM w
UNION ALL SELECT well_id, 'md', row_id % 17 = 4, CASE WHEN row_id % 17 <> 4 THEN md END FROM w
UNION ALL SELECT well_id, 'tvt', false, tvt FROM w) GROUP BY column_name""")
def well_csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with cells that are no numbers: what is counted as such, and what is left. Every thirteenth gr is a word, every seventeenth md has a comma; 'NaN' and blanks are gaps, not faults."""
    folder = fresh_folder(spark, "wells") + "/train"
    text = lambda v: c(v).cast("string")
    rows = wells(spark, sf_dir).select(
        "well_id",
        "row_id",
        F.when(c("row_id") % 13 == 5, F.concat(F.lit("bad "), text("row_id"))).when(c("row_id") % 7 == 3, F.when(c("row_id") % 2 == 0, "NaN").otherwise(" ")).otherwise(text("gr")).alias("gr"),
        F.when(c("row_id") % 17 == 4, F.regexp_replace(F.concat(text("md"), F.lit(".")), "\\.", ",")).otherwise(text("md")).alias("md"),
        text("tvt").alias("tvt"),
    )
    wellfiles.write_wells(rows, folder)
    found = wellfiles.read_wells(spark, folder, {"gr": "double", "md": "double", "tvt": "double"})
    each = found.select("well_id", F.explode(F.array(*(F.struct(F.lit(v).alias("column_name"), c(v).alias("v"), F.coalesce(F.array_contains(F.map_keys("bad_cells"), v), F.lit(False)).alias("bad")) for v in ("gr", "md", "tvt")))).alias("p")).select("well_id", "p.*")
    return each.groupBy("column_name").agg(F.count_if("bad").alias("bad_cells"), F.count("v").alias("numbers"), F.count_distinct(F.when(c("bad"), c("well_id"))).alias("wells_hit"), rounded(F.coalesce(F.avg("v"), F.lit(0.0))).alias("mean"))


@query(f"SELECT row_number() OVER (ORDER BY CAST(well_id AS BIGINT) DESC, row_id) - 1 AS place, well_id || '_' || row_id AS id, {r6('tvt')} AS tvt FROM w WHERE tvt_input IS NULL")
def ordered_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for every hidden row, written in its order by all tasks, joined into one CSV file and read with its line numbers."""
    hidden = wells(spark, sf_dir).filter("tvt_input is null").select("well_id", "row_id", "tvt")
    before = Window.orderBy(F.desc(c("well_id").cast("long"))).rowsBetween(Window.unboundedPreceding, -1)  # one row a well
    offsets = hidden.groupBy("well_id").agg(F.count("*").alias("k")).select("well_id", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    result = hidden.join(offsets, "well_id").select((c("offset") + F.row_number().over(WELL.window) - 1).alias("place"), F.concat_ws("_", "well_id", "row_id").alias("id"), "tvt")
    folder = fresh_folder(spark, "result")
    ordered.write_ordered(result, folder)
    return ordered.numbered(spark, ordered.joined(spark, folder), "id string, tvt double").select("place", "id", rounded(c("tvt")).alias("tvt"))


@query("SELECT 'train' AS split, kind, file_count FROM (SELECT 'horizontal' AS kind, count(DISTINCT well_id) AS file_count FROM w UNION ALL SELECT 'typewell', count(DISTINCT well_id) FROM c)")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of wells and of their curves in one split, counted by kind from the listing alone."""
    root = fresh_folder(spark, "wells") + "/train"
    wellfiles.write_wells(wells(spark, sf_dir).select("well_id", "row_id", "md", "tvt"), root)
    knots = curve(spark, sf_dir).select("well_id", F.row_number().over(Window.partitionBy("well_id").orderBy("ctvt")).cast("long").alias("row_id"), c("ctvt").alias("TVT"), c("cgr").alias("GR"))
    wellfiles.write_wells(knots, root, kind="typewell.csv")
    return wellfiles.counted(spark, root, {"horizontal": wellfiles.KIND, "typewell": "typewell.csv"}).select(F.lit("train").alias("split"), "kind", "file_count")
