"""A training corpus from ``documents``: quality, near duplicates, personal data, mixing, packing.

Each stage works on all rows that the one before it kept, and all but the last
return the columns of ``documents``. run() writes each stage's rows as Parquet
in the shared folder and reads them again, so a lost executor repeats a stage
at most.

SQL can express neither the models nor the searches, so there is no oracle;
tests hold the stages against brute-force versions.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import discard, table, written
from logweir.llm.mixing import drawn_rows, mix_documents, shuffled_shards
from logweir.llm.neardup import keep_one
from logweir.llm.packing import place_pieces, tokenize_pieces
from logweir.llm.pii import redact_documents, train_pii
from logweir.llm.quality import THRESHOLD, score_quality, train_quality

ORACLE_SQL = None


NEEDED = ("doc_id", "text", "source")


def _narrow(docs: DataFrame) -> DataFrame:
    """The columns that stages work with; all others in one, so no name of theirs can clash."""
    extra = [F.col(f"`{c}`") for c in docs.columns if c not in NEEDED]
    return docs.select(*NEEDED, (F.struct(*extra) if extra else F.lit(None).cast("string")).alias("_extra"))


def _wide(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, with n_chars of the text as it is now."""
    kinds = dict(docs.dtypes)
    other = lambda c: F.length("text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col("_extra").getField(c).alias(c)
    return rows.select(*[F.col(c) if c in NEEDED else other(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    if model is None:  # nothing to learn from: nothing is rejected
        return docs
    scored = score_quality(_narrow(docs), model, [*NEEDED, "_extra"])
    return _wide(scored.filter(F.col("score") >= THRESHOLD), docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id."""
    return keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _wide(redact_documents(_narrow(docs), train_pii(docs)), docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per draw of the mix, in shards, shuffled within each."""
    return _wide(shuffled_shards(drawn_rows(mix_documents(_narrow(docs)))), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 4096."""
    pieces = written(tokenize_pieces(docs), "pack-pieces")
    return place_pieces(pieces, keep=("doc_id", "piece", "start", "ids"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_dup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
