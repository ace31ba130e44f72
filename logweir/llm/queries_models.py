"""Queries opN over whole tables: models and searches."""

from logweir.llm.ann import nearest
from logweir.llm.common import table
from logweir.llm.neardup import near_duplicates
from logweir.llm.pii import pii_digest, train_pii
from logweir.llm.quality import quality
from logweir.llm.toxicity import toxicity


def op5_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_digest(docs, train_pii(docs))


def op7_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])


def op9_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), ["doc_id"])


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
