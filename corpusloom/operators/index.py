"""A stored term index: postings and weights laid out by document, and blocks of weights by term.

``StoredIndex`` keeps its tables below the shared folder. Postings and weights are bucketed and
sorted by document, so that whatever is grouped by document (norms, scores, matched terms) reads them
without an exchange. ``impacts`` holds the weights once more by term, in blocks of similar weight with
the largest of each, for searches that stop early. A manifest names the tables and their sizes; an
index can be opened from it in another session. ``indexes`` builds an index once for each state of
its source files in a session.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpusloom.operators import weighting
from corpusloom.operators.skew import fits
from corpusloom.sources.shared import materialise, scratch_path

# Documents of a bucket, and the most buckets that a table may have.
BUCKET_DOCUMENTS = 50_000
MOST_BUCKETS = 50_000
# Terms that may be sent to every executor with their statistics when weights are computed.
BROADCAST_TERMS = 2_000_000
# Documents that a block of weights of one term spans, and classes of weight per halving.
BLOCK_DOCUMENTS = 4096
CLASSES = 4

SCHEMAS = {
    "postings": "doc_id bigint, term string, tf int",
    "weights": "doc_id bigint, term string, weight double",
    "terms": "term string, df bigint",
    "impacts": "term string, class int, part bigint, most double, doc_ids array<bigint>, "
    "weights array<double>",
}
_BY_DOCUMENT = ("postings", "weights")


@dataclass(frozen=True)
class Manifest:
    """Where an index lies and what it holds."""

    folder: str
    documents: int
    buckets: int


class StoredIndex:
    """The tables of one index; each is written when it is first asked for."""

    def __init__(self, spark: SparkSession, manifest: Manifest, tokens: DataFrame | None = None):
        self.spark, self.manifest, self._tokens = spark, manifest, tokens
        self._names: dict[str, str] = {}

    @classmethod
    def build(cls, tokens: DataFrame, documents: DataFrame) -> StoredIndex:
        """An index of ``(doc_id, term)`` rows over the given documents."""
        spark = tokens.sparkSession
        n = documents.count()
        cores = spark.sparkContext.defaultParallelism
        buckets = min(max(cores, -(-n // BUCKET_DOCUMENTS)), MOST_BUCKETS)
        index = cls(spark, Manifest(scratch_path(spark, "index"), n, buckets), tokens)
        line = spark.range(1).select(F.lit(json.dumps(asdict(index.manifest))).alias("value"))
        line.coalesce(1).write.text(f"{index.manifest.folder}/manifest")
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> StoredIndex:
        """An index that a session built before; all its tables must have been written."""
        row = spark.read.text(f"{folder}/manifest").first()
        return cls(spark, Manifest(**json.loads(row[0])))

    @property
    def total(self) -> Column:
        return F.lit(self.manifest.documents)

    @cached_property
    def postings(self) -> DataFrame:
        def made() -> DataFrame:
            # one exchange: words are counted where the bucket of their document is written
            by_document = self._tokens.select("doc_id", "term").repartition(
                self.manifest.buckets, "doc_id"
            )
            return weighting.term_frequencies(by_document)

        return self._stored("postings", made)

    @cached_property
    def terms(self) -> DataFrame:
        """Document frequencies."""
        return self._stored("terms", lambda: weighting.document_frequencies(self.postings))

    @cached_property
    def weights(self) -> DataFrame:
        """Normalised weights that are not zero."""

        def made() -> DataFrame:
            idfs = weighting.inverse_document_frequencies(self.terms, self.total)
            if fits(self.terms, BROADCAST_TERMS):
                # the postings stay in their buckets, and so do the norms
                raw = self.postings.join(F.broadcast(idfs), "term").select(
                    "doc_id", "term", (F.col("tf") * F.col("idf")).alias("weight")
                )
            else:
                raw = weighting.raw_weights(self.postings, idfs, self.total)
                raw = raw.select("doc_id", "term", "weight").repartition(
                    self.manifest.buckets, "doc_id"
                )
            return weighting.normalise(raw).filter("weight <> 0").select("doc_id", "term", "weight")

        return self._stored("weights", made)

    @cached_property
    def impacts(self) -> DataFrame:
        """Weights by term in blocks: one class of weight and one range of documents each.

        The blocks of a term hold at most ``BLOCK_DOCUMENTS`` postings, so a term of all documents
        is many rows that many tasks make.
        """

        def made() -> DataFrame:
            weight_class = F.floor(-F.log2(F.abs("weight")) * CLASSES).cast("int")
            return (
                self.weights.withColumn("class", weight_class)
                .withColumn("part", F.floor(F.col("doc_id") / BLOCK_DOCUMENTS))
                .groupBy("term", "class", "part")
                .agg(F.collect_list(F.struct("doc_id", "weight")).alias("p"))
                .select(
                    "term",
                    "class",
                    "part",
                    F.array_max("p.weight").alias("most"),
                    F.col("p.doc_id").alias("doc_ids"),
                    F.col("p.weight").alias("weights"),
                )
                .sortWithinPartitions("term", "class", "part")
            )

        return self._stored("impacts", made)

    def _stored(self, kind: str, made: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.manifest.folder}/{kind}"
        if kind not in _BY_DOCUMENT:
            if self._tokens is not None:
                made().write.parquet(path)
            return self.spark.read.schema(SCHEMAS[kind]).parquet(path)
        name = self._names[kind] = f"corpusloom_{kind}_{uuid.uuid4().hex}"
        buckets = self.manifest.buckets
        if self._tokens is not None:
            # a bucket is one file: its rows are brought together before they are written
            rows = made().select(*[f.split()[0] for f in SCHEMAS[kind].split(", ")])
            rows.repartition(buckets, "doc_id").write.format("parquet").bucketBy(
                buckets, "doc_id"
            ).sortBy("doc_id", "term").option("path", path).saveAsTable(name)
        else:
            self.spark.sql(
                f"CREATE TABLE {name} ({SCHEMAS[kind]}) USING parquet CLUSTERED BY (doc_id) "
                f"SORTED BY (doc_id, term) INTO {buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(name)

    def drop(self) -> None:
        """Removes the tables and their files."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.manifest.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def state_of(spark: SparkSession, path: str) -> int:
    """A number that changes when files below a path are added, removed or written anew."""
    files = spark.read.format("binaryFile").load(path)
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return int(files.agg(F.coalesce(F.sum(mark), F.lit(0))).first()[0])


class IndexCatalog:
    """The indexes of a session: one for each kind of terms and state of the source files."""

    def __init__(self):
        self._found: dict[tuple, StoredIndex] = {}

    def get(self, spark: SparkSession, kind: str, path: str, build: Callable[[], StoredIndex]):
        key = (spark.sparkContext.applicationId, kind, path, state_of(spark, path))
        if key not in self._found:
            self._found[key] = build()
        return self._found[key]

    def drop_all(self) -> None:
        while self._found:
            self._found.popitem()[1].drop()


indexes = IndexCatalog()


# searches that stop early


@dataclass(frozen=True)
class Pruned:
    """What a search has left to look at: blocks with their query, and its candidates."""

    blocks: DataFrame
    candidates: DataFrame


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df) else df


def _opened(blocks: DataFrame) -> DataFrame:
    """The postings of blocks, with what each adds to the score of its document."""
    kept = [c for c in ("part", "others", "threshold") if c in blocks.columns]
    return blocks.select(
        "query_id", "q", *kept, F.inline(F.arrays_zip("doc_ids", "weights"))
    ).select(
        "query_id", *kept, F.col("doc_ids").alias("doc_id"),
        (F.col("q") * F.col("weights")).alias("score"),
    )


def _summed(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Scores of ``(query_id, doc_id, part)`` from blocks in the ranges of these documents."""
    ranges = documents.select("query_id", "part").distinct()
    return (
        _opened(blocks.join(_few(ranges), ["query_id", "part"], "left_semi"))
        .join(_few(documents.select("query_id", "doc_id")), ["query_id", "doc_id"])
        .groupBy("query_id", "doc_id")
        .agg(F.sum("score").alias("score"))
    )


def prune(
    vectors: DataFrame, impacts: DataFrame, k: int, seed_blocks: int = 8, slack: float = 2e-6
) -> Pruned:
    """Blocks and documents that can matter to the ``k`` best of each query.

    A term's bound is its query weight times its largest weight. A few blocks of the largest bounds
    name the first documents; the ``k``-th best score of these is the query's threshold. A
    block whose bound, together with the bounds of the query's other terms, stays below it holds no
    posting of a wanted document; terms whose bounds together do not reach it name no candidate.
    ``slack`` covers the rounding of scores. Weights must not be negative.
    """
    asked = vectors.select("query_id", "term", F.col("weight").alias("q"))
    blocks = impacts.join(_few(asked), "term").withColumn("bound", F.col("q") * F.col("most"))

    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term", "class", "part")
    seeds = blocks.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= seed_blocks)
    first = materialise(
        _opened(seeds).select("query_id", "doc_id", "part").distinct(), "search-seeds"
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"))
    thresholds = (
        _summed(blocks, first)
        .withColumn("n", F.row_number().over(ranked))
        .filter(F.col("n") == k)
        .select("query_id", (F.col("score") - slack).alias("threshold"))
    )
    bounds = blocks.groupBy("query_id", "term").agg(F.max("bound").alias("largest"))
    of_query = Window.partitionBy("query_id")
    up_to = F.sum("largest").over(of_query.orderBy("largest", "term"))
    rules = (
        bounds.join(thresholds, "query_id", "left")
        .withColumn("threshold", F.coalesce("threshold", F.lit(float("-inf"))))
        .withColumn("others", F.sum("largest").over(of_query) - F.col("largest"))
        .withColumn("names", up_to >= F.col("threshold"))
        .select("query_id", "term", "others", "threshold", "names")
    )
    rules = materialise(rules, "search-rules")
    alive = blocks.join(_few(rules), ["query_id", "term"]).filter(
        F.col("bound") + F.col("others") >= F.col("threshold")
    )
    candidates = (
        _opened(alive.filter("names"))
        .filter(F.col("score") + F.col("others") >= F.col("threshold"))
        .select("query_id", "doc_id", "part")
        .distinct()
    )
    return Pruned(alive, candidates)


def block_max_scores(vectors: DataFrame, impacts: DataFrame, k: int, **bounds) -> DataFrame:
    """``(query_id, doc_id, score)``: exact scores of all documents that can be among the ``k``
    best of a query. Blocks of ranges of documents without a candidate are not opened."""
    pruned = prune(vectors, impacts, k, **bounds)
    return _summed(pruned.blocks, materialise(pruned.candidates, "candidates"))
