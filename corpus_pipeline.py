"""From raw documents to packed token sequences.

STAGES are applied in order, each to all that its predecessor kept. All but the last return the columns of documents, byte for byte but for the text that line dedup cuts (and n_chars, which
follows it). Inside a stage other columns bear numbers for names, so none clashes with a stage's own, whatever it is called."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, named, table
from tessera.llm.decontaminate import contamination
from tessera.llm.jaccard import similar
from tessera.llm.linededup import dedup
from tessera.llm.packing import pack, pieces
from tessera.llm.quality import classify


def _plain(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with doc_id, text and all other columns under numbers, and the columns that give these their names back."""
    names = {c: c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(named(c).alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts get the score of the bias alone; repeated rows have the same score; an empty table stays empty."""
    plain, back = _plain(docs)
    return classify(plain, documents(spark, sf_dir, "labels")).where("predicted = 1").select(*back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines and runs that came earlier; those of which nothing is left go. No other document goes, so every word that is cut stands at its first place in what this stage returns.

    Null and empty texts lose nothing and stay; rows that repeat doc_id and text are one document and all stay."""
    plain, back = _plain(docs)
    out = dedup(plain).where("n_removed = 0 OR n_removed < n_words").select(*back)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs (of _plain) less the rows with a doc_id (null, too) and text of gone (doc_id, text_hash)."""
    g = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(g, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash")), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that with the least doc_id (rows without doc_id count last; ties by the text's hash); a row that repeats doc_id and text goes, too.

    Each text of a doc_id is a document of its own. Rows with neither doc_id nor words all stay, as do null and empty texts: they are linked with nothing."""
    docs, back = _plain(docs)
    found = table(similar(docs).where("family IS NOT NULL").select("family", "doc_id", "text_hash").distinct(), "families")
    first = found.groupBy("family").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("first"))
    gone = found.join(first, "family").where("NOT (doc_id <=> first.doc_id AND text_hash = first.text_hash)")
    kept = _without(docs, gone)
    key = kept.withColumn("_text", F.xxhash64("text", F.length("text"))).withColumn("_row",
        F.when(F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False)), F.monotonically_increasing_id()))
    return key.dropDuplicates(["doc_id", "_text", "_row"]).select(*back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; each row goes by its own text, with or without doc_id. Null and empty texts have no windows and stay."""
    docs, back = _plain(docs)
    state = contamination(docs, documents(spark, sf_dir, "benchmark"))
    hit = state.where("contaminated").select("doc_id", F.xxhash64("text").alias("text_hash"))
    return _without(docs, table(hit, "contaminated")).select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences; null and empty texts are the end id alone, repeated rows are packed each."""
    return pack(table(pieces(docs).drop("ids"), "pieces"))


STAGES = [("quality_classifier", quality), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination), ("best_fit_packing", packing)]

#: Trained models, signatures and a genetic algorithm are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
