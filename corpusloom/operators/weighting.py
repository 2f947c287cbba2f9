"""Term statistics and weights over long-form postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.operators.skew import join_term_stats, position_in_group


def row_count(df: DataFrame) -> Column:
    """The number of rows as a scalar subquery, evaluated with the query that uses it."""
    return df.select(F.count(F.lit(1)).alias("n")).scalar()


def term_frequencies(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    return tokens.groupBy(key, "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """Postings hold one row per document and term, so counting rows counts documents."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse_document_frequencies(dfs: DataFrame, total: Column) -> DataFrame:
    """``ln(N / df)``; an empty collection is an error."""
    checked = F.when(total > 0, total.cast("double")).otherwise(
        F.raise_error(F.lit("the collection has no documents")).cast("double")
    )
    return dfs.withColumn("idf", F.log(checked / F.col("df")))


def raw_weights(postings: DataFrame, idfs: DataFrame, total: Column) -> DataFrame:
    """``tf * idf``, 0 for a term without statistics."""
    joined = join_term_stats(postings, idfs, total)
    return joined.withColumn(
        "weight", F.col("tf") * F.coalesce(F.col("idf"), F.lit(0.0))
    ).drop("df", "idf")


def normalise(weights: DataFrame, key: str = "doc_id", column: str = "weight") -> DataFrame:
    """Divide by the Euclidean norm of the vector; a zero vector stays zero."""
    norm = F.sqrt(F.sum(F.col(column) * F.col(column)).over(Window.partitionBy(key)))
    return (
        weights.withColumn("_norm", norm)
        .withColumn(
            column,
            F.when(F.col("_norm") == 0, F.lit(0.0)).otherwise(
                F.try_divide(F.col(column), F.col("_norm"))
            ),
        )
        .drop("_norm")
    )


def tfidf_vectors(postings: DataFrame, total: Column, key: str = "doc_id") -> DataFrame:
    """``(key, term, weight)``, unit length per document, zero weights not kept."""
    idfs = inverse_document_frequencies(document_frequencies(postings), total)
    return (
        normalise(raw_weights(postings, idfs, total), key)
        .filter(F.col("weight") != 0)
        .select(key, "term", "weight")
    )


def binary_vectors(tokens: DataFrame, key: str) -> DataFrame:
    return tokens.select(key, "term").dropDuplicates().withColumn("weight", F.lit(1.0))


def modified_weights(postings: DataFrame, total: Column, key: str = "doc_id") -> DataFrame:
    """``0.5 * (1 + tf / max tf) * ln(N / df)``; N at least 1, a missing df counts as 1."""
    # the largest count is taken where the postings of a document still lie together
    peaks = postings.withColumn("_peak", F.max("tf").over(Window.partitionBy(key)))
    joined = join_term_stats(peaks, document_frequencies(postings), total)
    n = F.greatest(total, F.lit(1))
    return joined.withColumn(
        "weight",
        F.lit(0.5)
        * (1 + F.col("tf") / F.col("_peak"))
        * F.log(n / F.greatest(F.coalesce("df", F.lit(1)), F.lit(1))),
    ).drop("df", "_peak")


def extend_vocabulary(vocabulary: DataFrame, terms: DataFrame) -> DataFrame:
    """Append unseen ``(lang, term)`` pairs with ids after the largest one in use.

    Ids follow an md5 of the term, so that they can be numbered block by block.
    """
    fresh = terms.select("lang", "term").distinct().join(
        vocabulary, ["lang", "term"], "left_anti"
    )
    mark = F.md5(F.concat_ws("|", "lang", "term"))
    top = vocabulary.select(F.coalesce(F.max("term_id"), F.lit(0)).alias("m")).scalar()
    numbered = position_in_group(
        fresh.withColumn("_mark", mark), [], F.substring("_mark", 1, 3), [F.col("_mark")], "_at"
    )
    return vocabulary.select("term_id", "lang", "term").unionByName(
        numbered.select((top + F.col("_at")).alias("term_id"), "lang", "term")
    )
