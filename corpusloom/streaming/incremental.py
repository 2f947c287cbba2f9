"""A term index kept up to date from a stream of new and changed documents.

The index is a log of immutable runs. A run holds, sorted by document,

``versions/run=R``  documents with their version
``postings/run=R``  their postings

and in ``changes/run=R`` how document frequencies change. Every micro-batch adds a run of level 0.
When a level has ``FAN`` runs they are merged into one of the next level, in which outdated postings
are gone, so the number of live runs grows with the logarithm of the number of batches. The manifest
of a batch names the runs that are live after it; a repeated batch starts from the manifest before it
and replaces what it wrote.

A batch reads the versions of its own range of documents in the live runs, and postings of the runs
that hold older versions of its documents, no others.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators import weighting as wt
from corpusloom.operators.skew import last_per_key
from corpusloom.operators.tokens import words_only
from corpusloom.sources.shared import scratch_path

FAN = 8

_SCHEMAS = {
    "versions": "doc_id bigint, version bigint, seq bigint",
    "postings": "doc_id bigint, term string, tf int",
    "changes": "term string, change bigint",
}


class TermIndexLog:
    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path, fan
        self.last_batch = -1

    @classmethod
    def open(cls, spark: SparkSession, path: str, fan: int = FAN) -> TermIndexLog:
        """A log that was written before, as its newest manifest has it."""
        log = cls(spark, path, fan)
        newest = spark.read.text(f"{path}/manifest").agg(F.max("batch")).first()[0]
        log.last_batch = -1 if newest is None else int(newest)
        return log

    # runs and manifests

    def live_runs(self, batch: int | None = None) -> list[dict]:
        """``{"run", "level"}`` of the runs that are live after a batch, in order of age."""
        batch = self.last_batch if batch is None else batch
        if batch < 0:
            return []
        row = self.spark.read.text(f"{self.path}/manifest/batch={batch}").first()
        return json.loads(row[0])

    def _set_live(self, runs: list[dict], batch: int) -> None:
        line = self.spark.range(1).select(F.lit(json.dumps(runs)).alias("value"))
        line.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/batch={batch}")
        self.last_batch = batch

    def read(self, part: str, runs: list[str]) -> DataFrame:
        """A part of the given runs with the column ``run``; other folders are not even listed."""
        schema = f"{_SCHEMAS[part]}, run string"
        if not runs:
            return self.spark.createDataFrame([], schema)
        folders = [f"{self.path}/{part}/run={run}" for run in runs]
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}")
        return reader.parquet(*folders)

    def _write(self, df: DataFrame, part: str, run: str) -> DataFrame:
        names = [column.split()[0] for column in _SCHEMAS[part].split(", ")]
        rows = df.select(names)
        if "doc_id" in names:
            # later batches skip the row groups they do not touch
            rows = rows.sortWithinPartitions("doc_id")
        rows.write.mode("overwrite").parquet(f"{self.path}/{part}/run={run}")
        return self.read(part, [run])

    @staticmethod
    def _newest(versions: DataFrame) -> DataFrame:
        return last_per_key(versions, ["doc_id"], ["version", "seq"])

    # batches

    def known_versions(self, batch: DataFrame, runs: list[str]) -> DataFrame:
        """What the live runs know about the documents of a batch.

        The id range of the batch is pushed down to the Parquet scan; the join then keeps the
        documents in question.
        """
        low, high = batch.agg(F.min("doc_id"), F.max("doc_id")).first()
        log = self.read("versions", runs)
        if low is not None:
            log = log.filter(F.col("doc_id").between(low, high))
        return self._newest(log.join(batch.select("doc_id").distinct(), "doc_id", "left_semi"))

    def outdated_postings(self, known: DataFrame) -> DataFrame:
        """Postings of the given ``(doc_id, run)``, read from the runs that are named there."""
        runs = [row[0] for row in known.select("run").distinct().collect()]
        log = self.read("postings", runs)
        bounds = known.agg(F.min("doc_id"), F.max("doc_id")).first()
        if bounds[0] is not None:
            log = log.filter(F.col("doc_id").between(*bounds))
        return log.join(known.select("doc_id", "run"), ["doc_id", "run"], "left_semi")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Add one micro-batch of ``(doc_id, text, version)``; outdated versions are ignored."""
        live = self.live_runs(batch_id - 1)
        run = str(batch_id)
        latest = last_per_key(batch.select("doc_id", "text", "version"), ["doc_id"], ["version"])
        known = self.known_versions(batch, [r["run"] for r in live])
        old = known.select("doc_id", F.col("version").alias("_old"))
        fresh = latest.join(old, "doc_id", "left").filter(
            F.col("_old").isNull() | (F.col("version") > F.col("_old"))
        )
        stamped = fresh.withColumn("seq", F.lit(batch_id).cast("long"))
        touched = self._write(stamped, "versions", run).select("doc_id", "version")
        texts = latest.join(touched, ["doc_id", "version"], "left_semi")
        added = self._write(wt.term_frequencies(words_only(texts, "doc_id")), "postings", run)
        replaced = known.join(touched.select("doc_id"), "doc_id", "left_semi")
        gone = self.outdated_postings(replaced)
        change = (
            added.select("term", F.lit(1).alias("c"))
            .unionByName(gone.select("term", F.lit(-1).alias("c")))
            .groupBy("term")
            .agg(F.sum("c").alias("change"))
            .filter("change <> 0")
        )
        self._write(change, "changes", run)
        self._set_live(self._merged([*live, {"run": run, "level": 0}], batch_id), batch_id)

    def _merged(self, live: list[dict], batch_id: int) -> list[dict]:
        """The live runs after full levels are merged."""
        level = 0
        while True:
            full = [r for r in live if r["level"] == level]
            if len(full) < self.fan:
                return live
            run = f"{batch_id}-{level + 1}"
            runs = [r["run"] for r in full]
            newest = self._newest(self.read("versions", runs))
            current = self.read("postings", runs).join(
                newest.select("doc_id", "run"), ["doc_id", "run"], "left_semi"
            )
            sums = self.read("changes", runs).groupBy("term").agg(F.sum("change").alias("change"))
            self._write(newest.repartitionByRange("doc_id"), "versions", run)
            self._write(current.repartitionByRange("doc_id"), "postings", run)
            self._write(sums.filter("change <> 0"), "changes", run)
            # higher levels are older: the new run takes the place after them
            older = [r for r in live if r["level"] > level]
            younger = [r for r in live if r["level"] < level]
            live = [*older, {"run": run, "level": level + 1}, *younger]
            level += 1

    # the index

    def _live(self, part: str) -> DataFrame:
        return self.read(part, [r["run"] for r in self.live_runs()])

    def documents(self) -> DataFrame:
        return self._newest(self._live("versions"))

    def postings(self) -> DataFrame:
        current = self.documents().select("doc_id", "run")
        return self._live("postings").join(current, ["doc_id", "run"]).drop("run")

    def document_frequencies(self) -> DataFrame:
        sums = self._live("changes").groupBy("term").agg(F.sum("change").alias("df"))
        return sums.filter("df > 0")


def run_incremental_index(stream: DataFrame, fan: int = FAN) -> TermIndexLog:
    """Index everything a stream of ``(doc_id, text, version)`` has to offer."""
    spark = stream.sparkSession
    log = TermIndexLog(spark, scratch_path(spark, "term-index"), fan)
    query = (
        stream.writeStream.foreachBatch(log.apply)
        .option("checkpointLocation", scratch_path(spark, "term-index-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return log
