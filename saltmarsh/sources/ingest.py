"""Validated appends to catalog tables: one Spark write per batch, one snapshot per commit."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.errors import NotNullViolation, SaltmarshError, SchemaMismatch
from saltmarsh.functions.transforms import transform
from saltmarsh.functions.types import check_schema
from saltmarsh.sources.catalog import Catalog, Manifest, TableMetadata

#: Characters of a bound that is kept.
LONGEST_BOUND = 256
#: Files that a task writes at once; from as many partitions on, the rest of its rows is sorted by them. An open file takes up
#: to a row group of memory.
OPEN_FILES = 5
_NOT_NULL = "NULL in the NOT NULL column "


def enforced(df: DataFrame, table: TableMetadata) -> DataFrame:
    """The rows, failing while they are written if a NOT NULL column holds a NULL: no pass of its own."""
    out = []
    for f in table.schema:
        c = F.col(f"`{f.name}`")
        out.append(c if f.nullable else F.when(c.isNull(), F.raise_error(F.lit(_NOT_NULL + f.name))).otherwise(c).alias(f.name))
    return df.select(*out)


def statistics_columns(table: TableMetadata) -> list[str]:
    """Columns whose bounds are kept for each file: those that the table's property ``statistics`` names (separated by
    commas), and the sources of its partition spec. Types whose texts depend on the session have none."""
    names = [x.strip() for x in table.properties.get("statistics", "").split(",")] + [f.source for f in table.spec]
    bounded = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampNTZType)
    return [f.name for f in table.schema if f.name in names and isinstance(f.dataType, bounded)]


def unsorted(df: DataFrame) -> DataFrame:
    """The frame in a copy of its session, whose writes don't sort the rows of a task that has few partitions: such a sort
    takes memory for all rows, and a task gets as many as its input can't be divided below. The caller's session keeps its
    setting, as other threads may be writing."""
    spark = df.sparkSession
    own = spark._jsparkSession.cloneSession()
    own.conf().set("spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FILES))
    dataset = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset
    return DataFrame(dataset.ofRows(own, df._jdf.queryExecution().analyzed()), spark)


class Ingestor:
    """Appends frames to a table. With ``commit=False`` files wait for commit(), which publishes all in one snapshot."""

    def __init__(self, catalog: Catalog, name: str) -> None:
        self.catalog, self.name = catalog, name
        self.pending: list[Manifest] = []

    def write(self, df: DataFrame) -> Manifest:
        """Writes data files that no snapshot names yet. Rows are checked against the schema and divided by the latest
        partition spec; each partition's rows are written by as few tasks as hold them, a large one's by several (AQE
        splits the shuffle by size). NULL partition values go to the default partition."""
        table = self.catalog.load_table(self.name)
        check_schema(df.schema, table.schema)
        rows = enforced(df, table)
        keys = [f.column for f in table.spec]
        for f in table.spec:
            if f.column in df.columns:
                raise SchemaMismatch(f"partition column {f.column} is a column of the table")
            rows = rows.withColumn(f.column, transform(f, table.schema[f.source].dataType))
        folder = f"{table.location}/data/{uuid.uuid4().hex}"
        writer = unsorted(rows.hint("rebalance", *keys)).write.partitionBy(*keys) if keys else rows.write
        try:
            writer.parquet(folder)
        except PySparkException as e:
            self.catalog.storage.delete(folder)
            if _NOT_NULL in str(e):
                raise NotNullViolation(str(e).split(_NOT_NULL)[1].split()[0].strip("'\".")) from None
            raise
        return self.catalog.manifest(self.name, self._written(folder, table))

    def append(self, df: DataFrame, commit: bool = True, expected: int | None = None, once: tuple[str, int] | None = None) -> Manifest:
        """``expected`` and ``once`` are those of the catalog's create_snapshot()."""
        new = self.write(df)
        self.pending.append(new)
        if commit:
            self.commit(expected, once)
        return new

    def append_all(self, *frames: DataFrame, commit: bool = True) -> list[Manifest]:
        """Several batches in one snapshot."""
        new = [self.append(df, commit=False) for df in frames]
        if commit:
            self.commit()
        return new

    def overwrite(self, df: DataFrame, removed: Column | None = None, expected: int | None = None) -> TableMetadata:
        """Puts the rows in place of the table's, or of the files that the condition ``removed`` chooses, in one snapshot."""
        return self.catalog.create_snapshot(self.name, [self.write(df)], "overwrite", expected, () if removed is None else removed)

    def _written(self, folder: str, table: TableMetadata) -> DataFrame:
        """The files of a folder, with their counts, partition values and bounds; only the bounded columns are read."""
        kept = statistics_columns(table)
        schema = T.StructType([*table.schema, *(T.StructField(f.column, T.StringType()) for f in table.spec)])
        rows = self.catalog.spark.read.schema(schema).parquet(folder)
        # The path is percent-encoded; a plus stands for itself.
        path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
        pairs = [x for f in table.spec for x in (F.lit(f.column), F.first(F.col(f"`{f.column}`")))]
        values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")

        def bounds(of) -> Column:
            found = []
            for c in kept:
                text = of(F.col(f"`{c}`")).cast("string")
                found += [F.lit(c), F.when(F.length(text) <= LONGEST_BOUND, text)]
            return F.create_map(*found) if found else F.create_map().cast("map<string,string>")

        # The set of a file's one size lets Spark keep a buffer for each file. For bounds of strings it would else sort all rows.
        size = F.get(F.collect_set("_metadata.file_size"), F.lit(0))
        out = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.lit("parquet").alias("format"), values.alias("partition_values"), F.count("*").alias("record_count"),
            size.alias("file_size"), bounds(F.min).alias("lower"), bounds(F.max).alias("upper"),
        )
        return out.where("record_count > 0").withColumn("path", path)

    def commit(self, expected: int | None = None, once: tuple[str, int] | None = None) -> TableMetadata:
        """Publishes what is pending. With ``expected`` only if the table is still at that snapshot."""
        new, self.pending = self.pending, []
        try:
            return self.catalog.create_snapshot(self.name, new, expected=expected, once=once)
        except SaltmarshError:
            self.pending = new
            raise
