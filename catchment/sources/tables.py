"""Typed reads and writes of tables and CSV files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from catchment import schemas
from catchment.functions.geometry import to_geojson, with_centroid, with_parts


# Column that holds a line which does not fit its schema.
REJECTED = "_rejected"


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A whole table by catalog name, or parquet files by path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def candidate_sites(spark: SparkSession, name: str = "candidate_sites") -> DataFrame:
    return read_table(spark, name)


def demographics(spark: SparkSession, name: str = "block_group_demographics") -> DataFrame:
    return read_table(spark, name)


def boundaries(spark: SparkSession, name: str = "block_group_boundaries") -> DataFrame:
    return read_table(spark, name)


def run_sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """Runs SQL text; ``{name}`` in it stands for a frame passed under that name."""
    return spark.sql(query, **frames)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and given types, so identifiers keep their leading zeros."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: str, out: str = REJECTED) -> DataFrame:
    """The same with the whole line in column ``out`` where a cell is not of its type or their number is wrong, else null there.

    All columns have to be read for that; a frame pruned to some columns sees the bad cells of those only.
    """
    reader = spark.read.schema(f"{schema}, {out} string").option("columnNameOfCorruptRecord", out)
    return reader.option("header", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_table(
    df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None, buckets: tuple[str, int] | None = None
) -> None:
    """Saves a table; ``append`` keeps the existing rows and may repeat keys.

    With ``buckets``, a key and a number, rows are stored by that key and sorted, so that joins of tables with equal
    buckets move no rows.
    """
    writer = df.write.mode(mode)
    if buckets is not None:
        key, number = buckets
        # One task per bucket writes one file, which the joins can then rely on to be sorted.
        writer = df.repartition(number, key).write.mode(mode).bucketBy(number, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def boundary_table(df: DataFrame, geojson: str = "geom_geojson") -> DataFrame:
    """Boundary rows with identifiers, degree-space centroid and GeoJSON text."""
    parsed = with_centroid(with_parts(df, geojson, "_parts"), "_parts")
    return parsed.withColumn("geom_geojson", to_geojson("_parts")).select(
        "geoid", "statefp", "countyfp", "tractce", "blkgrpce", "lat", "lon", "geom_geojson"
    )


def load_files(
    spark: SparkSession, entries: Mapping[str, tuple[str, str]], mode: str = "overwrite", folder: str | None = None
) -> DataFrame:
    """Loads CSV files into tables, passing over files that are not there.

    ``entries`` maps a table name to (path, schema); with ``folder`` the tables are
    stored below it.  Lines that do not fit the schema are no rows of the table; if there are any they go to
    ``<table>_rejected``, with the cells that could be read and the whole ``line``.  Returns one line per entry, with the rows loaded and the lines rejected.
    """
    found = {}
    for table, (path, schema) in entries.items():
        try:
            found[table] = read_csv_checked(spark, path, schema)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
                raise
    lines = []
    for table, (path, _) in entries.items():
        if table not in found:
            lines.append((table, path, "skipped", None, None))
            continue
        bad = F.col(REJECTED).isNotNull()
        counted = Observation(table)
        figures = F.count_if(~bad).alias("rows"), F.count_if(bad).alias("rejected")
        place = f"{folder}/{table}" if folder else None
        write_table(found[table].observe(counted, *figures).where(~bad).drop(REJECTED), table, mode, place)
        if counted.get["rejected"]:
            rejected = found[table].where(bad).withColumnRenamed(REJECTED, "line")
            write_table(rejected, f"{table}_rejected", mode, place and f"{place}_rejected")
        lines.append((table, path, "loaded", counted.get["rows"], counted.get["rejected"]))
    return spark.createDataFrame(lines, "table_name string, path string, status string, row_count bigint, rejected_count bigint")


def read_boundaries_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.BOUNDARIES)


def read_demographics_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.DEMOGRAPHICS)


def read_candidates_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CANDIDATE_POINTS)
