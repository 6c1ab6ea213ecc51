"""CSV files of wells: one file a group, named <well>__horizontal_well.csv or <well>__typewell.csv below a split's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.sources import wellfiles

TOPS = ("ANCC", "ASTNU", "ASTNL", "EGFDU", "EGFDL", "BUDA")
TRAIN = "MD double, X double, Y double, Z double, " + ", ".join(f"{t} double" for t in TOPS) + ", TVT double, GR double, TVT_input double"
TEST = "MD double, X double, Y double, Z double, GR double, TVT_input double"
CURVE = "TVT double, GR double, Geology string"
#: Class numbers by label; any other label is -1.
GEOLOGY = ("ANCC", "ASTNU", "ASTNL", "EGFDU", "EGFDL", "LFHL", "LFGT", "LBHL", "MNSS", "BUDA")
KINDS = {"horizontal": "horizontal_well.csv", "typewell": "typewell.csv", "png": "*.png"}


def pattern(root: str, split: str, kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {sorted(KINDS)}")
    return f"{root}/{split}/" + (KINDS[kind] if kind == "png" else f"*__{KINDS[kind]}")


def read_wells(spark: SparkSession, root: str, split: str, columns: tuple[str, ...] | None = None) -> DataFrame:
    """well_id, row_id (line from 0), the file's columns (or those asked for) and bad_cells; an absent column is an error."""
    known = dict(f.split() for f in (TRAIN if split == "train" else TEST).split(", "))
    return wellfiles.read_wells(spark, f"{root}/{split}", {name: known[name] for name in columns or known})


def read_curves(spark: SparkSession, root: str, split: str) -> DataFrame:
    """well_id, TVT, GR, Geology and its class number."""
    rows = spark.read.schema(CURVE).option("header", True).option("enforceSchema", False).csv(pattern(root, split, "typewell"))
    codes = F.create_map(*(x for i, g in enumerate(GEOLOGY) for x in (F.lit(g), F.lit(i))))
    named = rows.withColumn("well_id", F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)__", 1))
    return named.select("well_id", "TVT", "GR", "Geology", F.coalesce(F.try_element_at(codes, F.col("Geology")), F.lit(-1)).alias("code"))


def inventory(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """split, kind, file_count, total_bytes; contents are not read."""
    out = None
    for split in splits:
        for kind in KINDS:
            files = spark.read.format("binaryFile").option("pathGlobFilter", KINDS[kind] if kind == "png" else f"*__{KINDS[kind]}").load(f"{root}/{split}").select("length")
            one = files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes")).select(F.lit(split).alias("split"), F.lit(kind).alias("kind"), "file_count", "total_bytes")
            out = one if out is None else out.unionByName(one)
    return out


def rejected_columns(rows: DataFrame, forbidden: tuple[str, ...] = (*TOPS, "TVT")) -> None:
    """Raises if a test table has columns that only training wells may have."""
    found = sorted(set(rows.columns) & set(forbidden))
    if found:
        raise ValueError(f"columns of training wells in test wells: {found}")
