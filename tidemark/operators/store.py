"""Parquet store of the relations: batches that are there as a whole or not at all, deletes, logs, export and integrity.

A batch writes the rows of any relations to folders of its own, named by the batch, and is made visible by one commit
file, whose number nobody else can take. A batch that failed midway left no commit, so nobody reads its rows; run
again under its name it overwrites its folders, and once committed it is not run twice. Deletes are batches of keys
that hide earlier rows; compact() rewrites what is left. The number of files follows the number of batches and their
size, not the number of reports.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import compare
from tidemark.sources import html, sections
from tidemark.sources.shared import written

#: Relations that hold rows of reports.
CHILDREN = ("top_sqls", "efficiency_metrics", "load_profile", "database_stats", "cache_io_stats", "object_stats", "wait_events", "config_settings", "io_profile", "memory_stats", "sql_texts", "host_cpu", "sql_audit_issues")
#: What a deleted key hides: relations and their column that holds it.
DELETES = {
    "report": {"reports": "id", **dict.fromkeys(CHILDREN, "report_id")},
    "comparison": {"comparisons": "id", "sql_comparison_metrics": "comparison_id", "report_comparisons": "comparison_id", "comparison_rows": "comparison_id"},
    "plan": {"execution_plans": "id"},
}
#: Child relations of a whole report; the first two are single rows.
DOCUMENT = ("efficiency_metrics", "load_profile", "top_sqls", "object_stats", "cache_io_stats", "database_stats")
#: Sections of document_pieces() that hold the items of a list.
LIST_SECTIONS = {table: 2 * k + 1 for k, table in enumerate(DOCUMENT[2:])}


class Store:
    """Relations under one folder, which any file system that Spark knows can hold."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self, path: str) -> tuple:
        """The file system of a path, and the path, as Hadoop has them."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def commits(self) -> list[dict]:
        """The committed batches in order: number, batch and its tables. compact() bounds their number."""
        fs, folder = self._fs(f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        out = []
        for status in sorted(fs.listStatus(folder), key=lambda x: x.getPath().getName()):
            stream = fs.open(status.getPath())
            out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"number": int(status.getPath().getName())})
            stream.close()
        return out

    def batch(self, name: str, parts: dict[str, DataFrame | Callable[[], DataFrame]], replaces: bool = False) -> bool:
        """Write rows of relations as one batch; False if a batch of this name is committed already.

        Rows get the relation's columns in order; missing columns are null, extra ones are dropped. With replaces the
        batch takes the place of all before it.
        """
        if any(c["batch"] == name for c in self.commits()):
            return False
        for table, rows in parts.items():
            rows = rows() if callable(rows) else rows
            if table in schemas.TABLES:
                schema = schemas.empty(self.spark, table).schema
                rows = rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])
            rows.write.mode("overwrite").parquet(f"{self.path}/data/{table}/batch={name}")
        self._commit({"batch": name, "tables": list(parts), "replaces": replaces})
        return True

    def _commit(self, entry: dict) -> None:
        """Take the next free number; creating a file that exists fails, so two writers never share one."""
        while True:
            known = self.commits()
            if any(c["batch"] == entry["batch"] for c in known):
                return
            number = known[-1]["number"] + 1 if known else 1
            fs, file = self._fs(f"{self.path}/commits/{number:012d}")
            try:
                stream = fs.create(file, False)
            except Exception:
                if fs.exists(file):
                    continue
                raise
            stream.write(bytearray(json.dumps(entry).encode()))
            stream.close()
            return

    def _rows(self, table: str, commits: list[dict]) -> DataFrame | None:
        """Rows of a relation with the number of their batch, deletes not yet heeded; None if no batch has any."""
        mine = {c["batch"]: c["number"] for c in commits if table in c["tables"]}
        if not mine:
            return None
        reader = self.spark.read.option("basePath", f"{self.path}/data/{table}")
        if table in schemas.TABLES:
            reader = reader.schema(f"{schemas.TABLES[table]}, batch string")
        numbers = self.spark.createDataFrame(list(mine.items()), "batch string, number long")
        rows = reader.parquet(*[f"{self.path}/data/{table}/batch={b}" for b in mine])
        # as many rows as there are batches
        return rows.withColumn("batch", F.col("batch").cast("string")).join(F.broadcast(numbers), "batch").drop("batch")

    def read(self, table: str) -> DataFrame:
        """A relation, without deleted rows; an empty one where nothing is stored yet."""
        commits = self.commits()
        since = max((i for i, c in enumerate(commits) if c["replaces"]), default=0)
        commits = commits[since:]
        rows = self._rows(table, commits)
        if rows is None:
            return schemas.empty(self.spark, table)
        for kind, tables in DELETES.items():
            if table in tables and (gone := self._rows(f"deleted_{kind}", commits)) is not None:
                last = gone.groupBy(F.col("key").alias("_key")).agg(F.max("number").alias("_until"))
                rows = rows.join(last, F.col(tables[table]) == F.col("_key"), "left").filter(F.col("_until").isNull() | (F.col("number") > F.col("_until"))).drop("_key", "_until")
        return rows.drop("number")

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows of one relation, as a batch of its own."""
        self.batch(uuid.uuid4().hex, {table: rows})

    def delete(self, kind: str, keys: DataFrame, name: str | None = None) -> None:
        """Hide all rows of reports, comparisons or plans (see DELETES) that are stored now; keys: one column of ids."""
        self.batch(name or uuid.uuid4().hex, {f"deleted_{kind}": keys.select(F.col(keys.columns[0]).cast("long").alias("key")).distinct()})

    def delete_report(self, report_id: int) -> None:
        """A report and all rows that hang on it."""
        self.delete("report", self.spark.createDataFrame([(report_id,)], "id long"))

    def compact(self) -> None:
        """One batch with all rows that are left; readers of the old ones are served until clean()."""
        tables = {t for c in self.commits() for t in c["tables"] if not t.startswith("deleted_")}
        self.batch(f"compact-{uuid.uuid4().hex}", {t: self.read(t) for t in sorted(tables)}, replaces=True)

    def clean(self) -> None:
        """Delete the folders and commits that a compact() has replaced."""
        commits = self.commits()
        since = max((i for i, c in enumerate(commits) if c["replaces"]), default=0)
        for c in commits[:since]:
            # the commit goes last: what is left after a failure is cleaned the next time
            for t in c["tables"]:
                fs, folder = self._fs(f"{self.path}/data/{t}/batch={c['batch']}")
                fs.delete(folder, True)
            fs, file = self._fs(f"{self.path}/commits/{c['number']:012d}")
            fs.delete(file, False)

    def import_reports(self, pages: DataFrame, instance: str, created_at: str, name: str | None = None) -> None:
        """HTML reports (report_id, file_path, file_size, html) into the list and all child relations, as one batch.

        Pages are shredded once, into the shared folder; reports that are stored already are skipped, so an import can
        be repeated, under its name or another. Of pages that share an id the one with the least path counts. With a
        column part a page comes in pieces, whose sizes are those of the pieces; none is ever joined to a whole.
        """
        stored = self.read("reports").select(F.col("id").alias("report_id"))
        fresh = pages.join(stored, "report_id", "left_anti")
        if "part" in pages.columns:
            first = fresh.groupBy("report_id").agg(F.min("file_path").alias("file_path"))
            new = fresh.join(first, ["report_id", "file_path"], "left_semi")
            files = new.groupBy("report_id", "file_path").agg(F.sum("file_size").alias("file_size"))
        else:
            new = written(fresh.groupBy("report_id").agg(F.min_by(F.struct("file_path", "file_size", "html"), "file_path").alias("p")).select("report_id", "p.*"))
            files = new.drop("html")
        table_rows = written(html.table_rows(new))
        cells = html.cells_of(table_rows)
        unknown = F.lit("Unknown")
        meta = files.join(sections.snapshot(cells), "report_id", "left")
        reports = meta.select(F.col("report_id").alias("id"), F.lit(instance).alias("instance_name"), F.lit(created_at).alias("generation_time"), F.coalesce("snapshot_start", unknown).alias("snapshot_start"), F.coalesce("snapshot_end", unknown).alias("snapshot_end"), "file_path", "file_size", F.lit("SuccessfullyImported").alias("status"), F.lit(created_at).alias("created_at"))
        statements = sections.top_sql(table_rows).withColumn("id", F.xxhash64("report_id", "rank_by_time")).withColumn("is_hot_sql", F.col("rank_by_time") <= 20)
        shredded = {"efficiency_metrics": sections.efficiency, "load_profile": sections.load_profile, "database_stats": sections.database_stats, "cache_io_stats": sections.cache_io, "object_stats": sections.object_stats, "wait_events": sections.wait_events, "config_settings": sections.config, "io_profile": sections.io_profile, "memory_stats": sections.memory}
        self.batch(name or uuid.uuid4().hex, {"reports": reports, "top_sqls": statements, **{t: make(cells) for t, make in shredded.items()}})

    def create_comparison(self, pairs: DataFrame, metrics: DataFrame, reports: DataFrame, at: str) -> DataFrame:
        """source_report_id, target_report_id, success, message of each pair; comparisons of valid pairs are stored.

        A pair is valid if both reports exist. Summaries go to report_comparisons and the metrics of statements
        to comparison_rows, in one batch.
        """
        ids = reports.select("id")
        source = ids.select(F.col("id").alias("source_report_id"), F.lit(True).alias("has_source"))
        target = ids.select(F.col("id").alias("target_report_id"), F.lit(True).alias("has_target"))
        checked = pairs.join(source, "source_report_id", "left").join(target, "target_report_id", "left")
        missing = F.when(F.col("has_source").isNull(), F.concat(F.lit("Source report not found: "), F.col("source_report_id").cast("string"))).when(F.col("has_target").isNull(), F.concat(F.lit("Target report not found: "), F.col("target_report_id").cast("string")))
        valid = checked.filter(missing.isNull()).select("source_report_id", "target_report_id")
        key = ["source_report_id", "target_report_id"]
        id_ = F.xxhash64(*key, F.lit(at)).alias("comparison_id")
        kept = metrics.join(valid, key, "left_semi")
        summaries = written(compare.summaries(kept, reports).select(id_, "*", F.lit(at).alias("created_at")))
        self.batch(f"comparison-{uuid.uuid4().hex}", {"report_comparisons": summaries, "comparison_rows": kept.select(id_, "*")})
        saved = summaries.select(*key, "n_findings")
        done = F.concat(F.lit("Comparison created successfully with "), F.coalesce("n_findings", F.lit(0)).cast("string"), F.lit(" key findings"))
        return checked.join(saved, key, "left").select(*key, missing.isNull().alias("success"), F.coalesce(missing, done).alias("message"))

    def details(self, reports: DataFrame | None = None) -> DataFrame:
        """A row for each report (all, or those of the column id): the report with its single rows and lists nested.

        Lists are null where there is nothing. Only the rows of one report meet in a group.
        """
        of = (lambda df, c: df.join(reports.select(F.col("id").alias(c)), c, "left_semi")) if reports is not None else (lambda df, c: df)
        out = of(self.read("reports"), "id")
        for table in DOCUMENT[:2]:
            one = of(self.read(table), "report_id")
            out = out.join(one.groupBy(F.col("report_id").alias("id")).agg(F.first(F.struct(*[c for c in one.columns if c != "report_id"])).alias(table)), "id", "left")
        for table in DOCUMENT[2:]:
            many = of(self.read(table), "report_id")
            out = out.join(many.groupBy(F.col("report_id").alias("id")).agg(F.collect_list(F.struct(*[c for c in many.columns if c != "report_id"])).alias(table)), "id", "left")
        return out

    def document_pieces(self) -> DataFrame:
        """id, section, n, text: the documents of export_details() in pieces, whose texts in order of section and n are each report's document.

        Section 0 is the report with its single rows, odd sections (LIST_SECTIONS) hold an item of a list each, with a comma
        before all but the first, the others what stands between lists. No list is ever in memory whole.
        """
        reports = self.read("reports")
        heads = reports.select("id", F.struct(*reports.columns).alias("report"))
        for table in DOCUMENT[:2]:
            one = self.read(table)
            heads = heads.join(one.groupBy(F.col("report_id").alias("id")).agg(F.first(F.struct(*[c for c in one.columns if c != "report_id"])).alias(table)), "id", "left")
        json = F.to_json(F.struct("report", *DOCUMENT[:2]))
        piece = lambda section, text: F.struct(F.lit(section).alias("section"), F.lit(1).cast("long").alias("n"), text.alias("text"))
        names = DOCUMENT[2:]
        between = [piece(2 * k + 2, F.lit(f'],"{name}":[')) for k, name in enumerate(names[1:])]
        frame = [piece(0, F.concat(json.substr(F.lit(1), F.length(json) - 1), F.lit(f',"{names[0]}":['))), *between, piece(2 * len(names), F.lit("]}"))]
        out = heads.select("id", F.explode(F.array(*frame)).alias("p")).select("id", "p.*")
        for table in names:
            rows = self.read(table)
            items = rows.select(F.col("report_id").alias("id"), F.monotonically_increasing_id().alias("at"), F.to_json(F.struct(*[c for c in rows.columns if c != "report_id"])).alias("text")).join(reports.select("id"), "id", "left_semi")
            n = F.row_number().over(Window.partitionBy("id").orderBy("at")).cast("long")
            items = items.withColumn("n", n).select("id", F.lit(LIST_SECTIONS[table]).alias("section"), "n", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "text").alias("text"))
            out = out.unionByName(items)
        return out

    def detail(self, report_id: int) -> DataFrame:
        """The row of one report."""
        return self.details(self.spark.createDataFrame([(report_id,)], "id long"))

    def log(self, action: str, entity_type: str, entity_id: str, at: str, user_id: str = "system", details: str | None = None, success: bool = True, error: str | None = None) -> None:
        """One row of the audit log."""
        row = self.spark.createDataFrame([(at, user_id, action, entity_type, entity_id, success, error, details)], "timestamp string, user_id string, action string, entity_type string, entity_id string, success boolean, error_message string, details string")
        self.log_rows(row)

    def log_rows(self, rows: DataFrame) -> None:
        """Rows of the audit log, any number of them as one batch; without an id they get one of their own values."""
        named = rows if "id" in rows.columns else rows.withColumn("id", F.xxhash64("timestamp", "action", "entity_type", "entity_id"))
        self.append("audit_logs", named)

    def logged(self, limit: int, offset: int = 0) -> DataFrame:
        """A page of the audit log, newest first."""
        out = self.read("audit_logs").orderBy(F.desc("timestamp"), F.desc("id"))
        return (out.offset(offset) if offset else out).limit(limit)


def manifest(rows: DataFrame, kind: str, date: str, version: str = "1.0") -> DataFrame:
    """One row: version, date, type and number of items."""
    return rows.agg(F.count(F.lit(1)).alias("item_count")).select(F.lit(version).alias("version"), F.lit(date).alias("export_date"), F.lit(kind).alias("export_type"), "item_count")


def export_json(reports: DataFrame, sqls: DataFrame, date: str) -> DataFrame:
    """One JSON document for each report: manifest, the report and its statements."""
    lists = sqls.groupBy(F.col("report_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank_by_time", "id", "sql_id", "sql_text", "executions", "total_elapsed_time"))).alias("top_sqls"))
    r = reports.join(lists, "id", "left")
    head = F.struct(F.lit("1.0").alias("version"), F.lit(date).alias("export_date"), F.lit("Report").alias("export_type"), F.coalesce(F.size("top_sqls"), F.lit(0)).alias("item_count"))
    return r.select("id", F.to_json(F.struct(head.alias("manifest"), F.struct(*[c for c in reports.columns]).alias("report"), F.col("top_sqls"))).alias("document"))


def export_details(details: DataFrame) -> DataFrame:
    """id and document of each row of Store.details(): the report and its six child relations, empty lists where there is nothing."""
    own = [c for c in details.columns if c not in DOCUMENT]
    lists = [F.coalesce(F.col(c), F.array().cast(details.schema[c].dataType)).alias(c) for c in DOCUMENT[2:]]
    return details.select("id", F.to_json(F.struct(F.struct(*own).alias("report"), *DOCUMENT[:2], *lists)).alias("document"))


def export_csv(sqls: DataFrame) -> DataFrame:
    """The ten exported columns of statements, ranked from 1 in the order of time."""
    rank = F.row_number().over(Window.partitionBy("report_id").orderBy("rank_by_time", "id"))
    return sqls.select("report_id", rank.alias("rank"), "sql_id", "executions", "total_elapsed_time", "cpu_time", "io_time", "buffer_gets", "disk_reads", "rows_processed", "sql_text")


def check_import(documents: DataFrame) -> DataFrame:
    """document_id, ok, error of JSON documents: the root must be an object and hold a manifest."""
    v = F.try_parse_json("document")
    root = F.schema_of_variant(v)
    error = F.when(v.isNull(), "not JSON").when(~root.startswith("OBJECT"), "root is not an object").when(F.try_variant_get(v, "$.manifest", "variant").isNull(), "manifest is missing")
    return documents.select("document_id", error.isNull().alias("ok"), error.alias("error"))


def import_rows(rows: DataFrame, stored: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """The relation after an import: stored rows win, or with overwrite the imported ones."""
    if overwrite:
        return stored.join(rows.select(key), key, "left_anti").unionByName(rows)
    return stored.unionByName(rows.join(stored.select(key), key, "left_anti"))


def integrity(rows: DataFrame, key: str) -> DataFrame:
    """One row: number of rows, distinct keys and an order-free checksum of the rows as a multiset.

    The checksum holds the sums modulo 2^64 of the two halves of the MD5 of each row, so it tells a row from two of it
    and parts can be summed apart and added. A row's text has each value's length before it, and - for null, so nulls
    differ from empty strings and values can't run together.
    """
    text = lambda c: F.coalesce(F.concat(F.char_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    digest = F.md5(F.concat(*[text(F.col(c)) for c in rows.columns]))
    half = lambda at: F.expr(f"coalesce(sum(cast(conv(substr(_h, {at}, 16), 16, 10) AS decimal(20,0))), 0BD) % 18446744073709551616BD")
    out = rows.withColumn("_h", digest).agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct(key).alias("distinct_keys"), half(1).alias("_a"), half(17).alias("_b"))
    return out.select("record_count", "distinct_keys", F.concat_ws("-", F.col("_a").cast("decimal(20,0)").cast("string"), F.col("_b").cast("decimal(20,0)").cast("string")).alias("checksum"))


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    """Whether two relations have the same columns with the same types."""
    return [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
