"""A document store of Parquet tables in one folder.

Every insert writes its rows of each table under a batch of its own, and last a
row in `commits`: what no commit names isn't read, so a failed insert leaves
nothing behind that counts. Deletes write the ids to `deleted`; reads anti-join
them, and compact() rewrites what is left. No row is updated in place.

Schemas grow: columns that older batches lack are read as nulls (schema merging), or as their default
in DEFAULTS, a column of the others. Tables in DERIVED are made at read for batches that were
written before these were stored; compact() stores them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import retrieval

#: In the order in which they are written: a later one may be made of an earlier one.
TABLES = ("documents", "entries", "notes", "vectors", "sizes", "postings")
#: Tables that are written by the values of a column, after rows are dealt and sorted for it.
CLUSTERED = {"postings": ("slot", retrieval.clustered)}
#: Tables that another one determines, and how.
DERIVED = {"sizes": ("notes", retrieval.note_sizes), "postings": ("notes", retrieval.postings)}
#: Columns that a batch may lack, and what they are then.
DEFAULTS = {"notes": {"tokens": lambda: F.size(retrieval.tokens(F.col("text")))}, "documents": {"source_name": lambda: F.lit("unknown"), "assumed_year": lambda: F.lit(False)}}
#: Batches that a read names one by one, so that others' folders aren't opened; more are joined.
MOST_BATCHES = 2000


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _write(self, name: str, rows: DataFrame, batch: str) -> None:
        rows = rows.withColumn("inserted_at", F.current_timestamp())
        if name in CLUSTERED:
            column, dealt = CLUSTERED[name]
            dealt(rows).write.partitionBy(column).parquet(f"{self.path}/{name}/batch={batch}")
        else:
            rows.write.parquet(f"{self.path}/{name}/batch={batch}")

    def insert(self, tables: dict, expected: dict[str, int] | None = None) -> str:
        """Write one batch. A table is a DataFrame, or a function that makes it of the tables written before it:
        written("entries") reads these back, so that nothing is computed twice.

        Notes and vectors must be equally many; `expected` counts are checked as well.
        """
        batch, seconds = f"b{uuid.uuid4().hex}", []

        def written(name: str) -> DataFrame:
            return self.spark.read.parquet(f"{self.path}/{name}/batch={batch}").drop("inserted_at")

        for name in TABLES:
            if name in tables:
                began = time.perf_counter()
                rows = tables[name]
                self._write(name, rows if isinstance(rows, DataFrame) else rows(written), batch)
                seconds.append((batch, name, time.perf_counter() - began))
        counts = {name: self.spark.read.parquet(f"{self.path}/{name}/batch={batch}").count() for name in TABLES if name in tables}
        if "vectors" in counts and counts["vectors"] != counts.get("notes"):
            raise ValueError(f"{counts.get('notes')} notes but {counts['vectors']} vectors")
        if wrong := {k: n for k, n in (expected or {}).items() if counts.get(k) != n}:
            raise ValueError(f"expected {wrong}, wrote {counts}")
        names = ", ".join(f"'{name}'" for name in TABLES if name in tables)
        self.spark.sql(f"SELECT '{batch}' AS batch, current_timestamp() AS committed_at, array({names}) AS tables").write.mode("append").parquet(f"{self.path}/commits")
        self.spark.createDataFrame(seconds, "batch string, stage string, seconds double").coalesce(1).write.mode("append").parquet(f"{self.path}/timings")
        return batch

    def timings(self) -> DataFrame:
        """batch, stage, seconds, share of the batch: how long each table of an insert took."""
        rows = self._read("timings")
        if rows is None:
            return self.spark.createDataFrame([], "batch string, stage string, seconds double, share double")
        return rows.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy("batch")))

    def view(self) -> View | None:
        """What is committed and deleted now, read once for several tables; None before the first insert."""
        commits = self._read("commits")
        return None if commits is None else View(self, commits, self._read("deleted"))

    def table(self, name: str) -> DataFrame | None:
        """Committed rows of documents that aren't deleted; None before the first insert."""
        view = self.view()
        return None if view is None else view.table(name)

    def entries(self, doc_id) -> DataFrame:
        return self.table("entries").filter(F.col("doc_id") == doc_id).orderBy("idx")

    def notes(self, doc_id) -> DataFrame:
        return self.table("notes").filter(F.col("doc_id") == doc_id).orderBy("entry_idx", "part")

    def notes_by_id(self, ids: DataFrame) -> DataFrame:
        return self.table("notes").join(ids, "note_id", "left_semi")

    def text(self) -> DataFrame:
        """doc_id, text: entries joined by blank lines."""
        return document_text(self.table("entries"))

    def find(self, fingerprints: DataFrame) -> DataFrame:
        """fingerprint, doc_id of the newest document of each of these fingerprints."""
        return newest(self.table("documents").join(fingerprints.select("fingerprint").distinct(), "fingerprint"))

    def delete(self, ids: DataFrame) -> None:
        ids.select("doc_id").distinct().withColumn("deleted_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/deleted")

    def purge(self, now) -> int:
        """Delete documents that expired before now; returns how many."""
        old = self.table("documents").filter(F.col("expires_at") < F.lit(now)).select("doc_id").distinct()
        n = old.count()
        if n:
            self.delete(old)
        return n

    def counts(self) -> DataFrame:
        """name, rows of each table."""
        parts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name in TABLES if (t := self.table(name)) is not None]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compact(self, to: str) -> Store:
        """The live rows in a new store at `to`; the old one stays until it is removed."""
        new = Store(self.spark, to)
        new.insert({n: t.drop("batch", "inserted_at") for n in TABLES if (t := self.table(n)) is not None})
        return new


class View:
    """The tables of a store as they are committed when it is made."""

    def __init__(self, store: Store, commits: DataFrame, deleted: DataFrame | None):
        self.store, self.commits, self.deleted = store, commits, deleted
        if "tables" not in commits.columns:
            self.commits = commits.withColumn("tables", F.lit(None).cast("array<string>"))
        self.rows = self.commits.select("batch", "tables").limit(MOST_BATCHES + 1).collect()

    def _of(self, rows: DataFrame, lacking: str | None = None) -> DataFrame | None:
        """Rows of committed batches; of those that lack a table only. None if there is no such batch."""
        if len(self.rows) > MOST_BATCHES:
            wanted = self.commits if lacking is None else self.commits.filter(~F.coalesce(F.array_contains("tables", lacking), F.lit(False)))
            return rows.join(wanted.select("batch").distinct(), "batch", "left_semi")
        batches = [r["batch"] for r in self.rows if lacking is None or lacking not in (r["tables"] or ())]
        return rows.filter(F.col("batch").isin(batches)) if batches else None

    def _derived(self, name: str) -> DataFrame | None:
        """Rows of a derived table for the batches that lack it."""
        source, make = DERIVED[name]
        rows = self.store._read(source)
        rows = None if rows is None else self._of(rows, lacking=name)
        if rows is None or rows.isEmpty():
            return None
        rows = self._with_defaults(source, rows)
        when = rows.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max("inserted_at").alias("inserted_at"))
        return make(rows).join(when, "doc_id")

    @staticmethod
    def _with_defaults(name: str, rows: DataFrame) -> DataFrame:
        for column, value in DEFAULTS.get(name, {}).items():
            rows = rows.withColumn(column, F.coalesce(F.col(column), value()) if column in rows.columns else value())
        return rows

    def table(self, name: str) -> DataFrame | None:
        """Committed rows of documents that aren't deleted; None if there are none such."""
        rows = self.store._read(name)
        if rows is not None and (rows := self._of(rows)) is not None:
            rows = self._with_defaults(name, rows)
        if name in DERIVED and (more := self._derived(name)) is not None:
            rows = more if rows is None else rows.unionByName(more)
        if rows is not None and self.deleted is not None:
            later = self.deleted.groupBy("doc_id").agg(F.max("deleted_at").alias("deleted_at"))
            rows = rows.join(later, "doc_id", "left").filter(F.col("deleted_at").isNull() | (F.col("inserted_at") > F.col("deleted_at"))).drop("deleted_at")
        return rows


def newest(documents: DataFrame) -> DataFrame:
    """fingerprint, doc_id: the document of each fingerprint that was made last, the greater id among equals."""
    return documents.groupBy("fingerprint").agg(F.max_by("doc_id", F.struct("created_at", "doc_id")).alias("doc_id"))


def document_text(entries: DataFrame) -> DataFrame:
    """doc_id, text: entries joined by blank lines, in order."""
    rows = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("e"))
    return rows.select("doc_id", F.array_join(F.transform("e", lambda x: x["text"]), "\n\n").alias("text"))


def distinct_images(images: DataFrame) -> DataFrame:
    """images (doc_id, pos, url, caption) once for each URL and caption, the first seen."""
    w = Window.partitionBy("doc_id", "url", "caption").orderBy("pos")
    return images.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def without(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of a table less those of deleted documents."""
    return table.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
