"""SQL over catalog snapshots: views for the tables that a statement names, then Catalyst."""

from __future__ import annotations

import contextlib
import io
import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.errors import InvalidArgument, SchemaMismatch, Unsupported
from saltmarsh.functions.types import split_statements
from saltmarsh.sources import pruning
from saltmarsh.sources.catalog import Catalog
from saltmarsh.sources.ingest import Ingestor
from saltmarsh.sources.json_rows import parse_array


_NAME = r"(`[^`]+`|[A-Za-z_][A-Za-z0-9_.$-]*)"
_VERSION = re.compile(rf"{_NAME}\s+(?:FOR\s+)?VERSION\s+AS\s+OF\s+(\d+)", re.I)
_DROP = re.compile(rf"\s*DROP\s+TABLE\s+(IF\s+EXISTS\s+)?{_NAME}\s*;?\s*", re.I)
_INSERT = re.compile(rf"\s*INSERT\s+(INTO|OVERWRITE)\s+(?:TABLE\s+)?{_NAME}\s+((?:SELECT|WITH|VALUES|\().*)", re.I | re.S)
_DELETE = re.compile(rf"\s*DELETE\s+FROM\s+{_NAME}(?:\s+WHERE\s+(.*?))?\s*;?\s*", re.I | re.S)


def _bare(name: str) -> str:
    return name.strip("`")


class Engine:
    """What a client needs: queries, table creation, changes, JSON ingest, plans."""

    def __init__(self, catalog: Catalog) -> None:
        self.catalog, self.spark = catalog, catalog.spark

    def query(self, text: str, snapshots: Mapping[str, int] | None = None) -> DataFrame:
        """One SELECT over the current snapshots, over those given by table, or over those that the text names
        (``orders VERSION AS OF 3``).

        The statement is planned twice: first over stand-ins without rows, whose filters, after Catalyst has pushed them
        down, choose the files of each table by their partition values and bounds; then over those files.
        """
        statements = split_statements(text)
        if len(statements) != 1:
            raise InvalidArgument("exactly one statement is expected")
        if not re.match(r"(SELECT|WITH|VALUES|\()", statements[0], re.I):
            raise Unsupported(statements[0].split()[0])
        known, wanted = set(self.catalog.list_tables()), {}

        def versioned(m: re.Match) -> str:
            if (name := _bare(m[1])) not in known:
                return m[0]
            wanted[f"{name}@{m[2]}"] = (name, int(m[2]))
            return f"`{name}@{m[2]}`"

        statement = _VERSION.sub(versioned, statements[0])
        words = set(re.findall(r"[A-Za-z0-9_.$-]+", statement)) | set(re.findall(r"`([^`]+)`", statement))
        wanted |= {name: (name, (snapshots or {}).get(name)) for name in known & words}
        tables = {view: self.catalog.load_table(name) for view, (name, _) in wanted.items()}
        empty = self.spark.sparkContext.emptyRDD()
        stand_ins = {view: self.spark.createDataFrame(empty, table.schema) for view, table in tables.items()}
        plan = self._over(stand_ins, statement)._jdf.queryExecution().optimizedPlan()
        frames = {}
        for view, (name, snapshot) in wanted.items():
            leaf = stand_ins[view]._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0)
            conditions = pruning.filters(plan, leaf.rdd().id())
            frames[view] = self.catalog.table(name, snapshot, where=pruning.Pruner(self.spark, tables[view]).files(conditions))
        return self._over(frames, statement)

    def _over(self, frames: Mapping[str, DataFrame], statement: str) -> DataFrame:
        """The statement over frames by name. Temporary views of the same names are put back afterwards."""
        before = {t.name.lower() for t in self.spark.catalog.listTables() if t.isTemporary}
        old = {name: self.spark.table(f"`{name}`") for name in frames if name.lower() in before}
        try:
            for name, df in frames.items():
                df.createOrReplaceTempView(f"`{name}`")
            return self.spark.sql(statement)
        finally:
            for name in frames:
                if name in old:
                    old[name].createOrReplaceTempView(f"`{name}`")
                else:
                    self.spark.catalog.dropTempView(name)

    def execute(self, text: str) -> DataFrame | None:
        """A query; or a CREATE TABLE, DROP TABLE, INSERT INTO, INSERT OVERWRITE or DELETE FROM, which give nothing."""
        if re.match(r"\s*CREATE\s+TABLE\b", text, re.I):
            self.catalog.sql(text)
        elif m := _DROP.fullmatch(text):
            if not m[1] or _bare(m[2]) in self.catalog.list_tables():
                self.catalog.drop_table(_bare(m[2]))
        elif m := _INSERT.fullmatch(text):
            into = Ingestor(self.catalog, _bare(m[2]))
            schema = self.catalog.load_table(into.name).schema
            rows = self.query(m[3])
            if len(rows.columns) != len(schema):
                raise SchemaMismatch(f"{len(rows.columns)} columns for a table of {len(schema)}")
            rows = rows.toDF(*schema.fieldNames()).select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema))
            into.append(rows) if m[1].upper() == "INTO" else into.overwrite(rows)
        elif m := _DELETE.fullmatch(text):
            self.delete(_bare(m[1]), m[2])
        else:
            return self.query(text)
        return None

    def delete(self, name: str, where: str | None = None) -> None:
        """Leaves out the rows for which a condition is true (all rows without one). Only files that may hold such rows are
        read and written anew; a change of the table meanwhile is a conflict."""
        table = self.catalog.load_table(name)
        if where is None:
            self.catalog.create_snapshot(name, operation="overwrite", expected=table.current_snapshot_id)
            return
        stand_in = self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), table.schema).where(where)
        plan = stand_in._jdf.queryExecution().optimizedPlan()
        leaves = plan.collectLeaves()
        conditions = pruning.filters(plan, leaves.apply(0).rdd().id()) if leaves.apply(0).getClass().getSimpleName() == "LogicalRDD" else None
        files = pruning.Pruner(self.spark, table).files(conditions)
        files = F.lit(True) if files is None else files
        kept = self.catalog.table(name, table.current_snapshot_id, where=files).where(~F.coalesce(F.expr(where), F.lit(False)))
        Ingestor(self.catalog, name).overwrite(kept, files, table.current_snapshot_id)

    def ingest_json(self, name: str, text: str) -> int:
        """Appends a JSON array of objects in one snapshot; the number of rows."""
        rows = parse_array(self.spark, text, self.catalog.load_table(name).schema)
        if not json.loads(text):
            return 0
        return Ingestor(self.catalog, name).append(rows).records

    def explain(self, text: str) -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self.query(text).explain("formatted")
        return out.getvalue()
