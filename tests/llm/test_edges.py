"""Every operator over odd rows and over no rows."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, importance, jaccard, licenses, linededup, media, packing, pii, quality, secrets, tokencount, tokenfile, variants
from tessera.llm.common import table


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).where("doc_id < 8")


def bench(spark):
    return spark.createDataFrame([("i1", "quick brown fox jumps over the lazy dog and runs away"), ("i2", None), ("i3", ""), ("i4", "a"), ("i5", "a")], "item_id string, text string")


def pii_found(docs):
    spans = pii.candidates(docs)
    return pii.found(spans, pii.fitted(spans))


OPERATORS = {
    "dedup": lambda s, d: linededup.dedup(d),
    "decontaminate": lambda s, d: decontaminate.report(decontaminate.contamination(d, bench(s))),
    "media": lambda s, d: media.describe(media.store(d)),
    "jaccard": lambda s, d: jaccard.similar(d),
    "tokenfile": lambda s, d: tokenfile.read(tokenfile.write(d)),
    "quality": lambda s, d: quality.classify(d, labels(d)),
    "tokencount": lambda s, d: tokencount.edited(tokencount.trees(d).withColumn("edits", F.lit(None).cast(tokencount.EDITS))),
    "pii": lambda s, d: pii_found(d),
    "licenses": lambda s, d: licenses.scan(d),
    "secrets": lambda s, d: secrets.secrets(d),
    "importance": lambda s, d: importance.resampled(d, bench(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, odd, name):
    out = OPERATORS[name](spark, odd)
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, nothing, name):
    assert OPERATORS[name](spark, nothing).count() == 0


def test_packing_edges(spark, odd, nothing):
    out = packing.pack(table(packing.pieces(odd).drop("ids"), "p")).collect()
    assert {str(r.doc_id) for r in out} == {str(r.doc_id) for r in odd.collect()}
    assert packing.pack(table(packing.pieces(nothing).drop("ids"), "p")).count() == 0


def test_variants_edges(spark, odd, nothing):
    assert {r.word for r in variants.grouped(table(variants.vocabulary(odd, 4), "v")).collect()} == {"word"}
    assert variants.grouped(table(variants.vocabulary(nothing), "v")).count() == 0


def test_labels_that_are_no_class(spark, odd):
    with pytest.raises(ValueError, match="labels must be 0 to 1"):
        quality.classify(odd, odd.select("doc_id", F.lit(7).alias("quality")).where("doc_id < 8"))


def test_empty_benchmark(spark, odd):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.report(decontaminate.contamination(odd, none)).where("contaminated").count() == 0


CLASHES = ["score", "predicted", "n_removed", "n_runs", "ranges", "_text", "_id", "_hash", "a.b", "row", "c0", "class", "family", "key"]


def test_stages_keep_user_columns(spark, small):
    """Rows with ids that are null or repeated, and columns with clashing or dotted names, come out of each stage byte for byte, or not at all."""
    import corpus_pipeline as P

    texts = [f"plain words number {k} in a row that is like no other row of {k * 7} words, and so on and on" for k in range(12)]
    made = [(k if k % 3 else None, t, *(f"{c}-{k}" for c in CLASHES)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(made, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= set(made) and len(got) == len(set(got))
        if stage is not P.quality:
            assert len(got) == len(made)
