"""Queries opN over whole tables: output, packing, mixing, media and sharding."""

from pyspark.sql import functions as F

from logweir.llm.common import table, word_count, written
from logweir.llm.media import analyse_media, encode_media
from logweir.llm.mixing import mix_documents
from logweir.llm.packing import place_pieces, tokenize_pieces
from logweir.llm.sharding import shard_documents
from logweir.llm.token_output import ids_digest, token_output


def op3_mixing(spark, sf_dir):
    # Texts are read once: what the mix goes by are word counts and hashes.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("_words_of"), F.xxhash64("doc_id", "text").alias("_ident"))
    mixed = mix_documents(written(docs, "mix-sizes"), size="_words_of", ident="_ident")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "draws")


def op10_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("bigint"))
    return shard_documents(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_token_output(spark, sf_dir):
    got = token_output(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ids_digest(got, ["doc_id", "start"]).select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op2_packing(spark, sf_dir):
    pieces = written(tokenize_pieces(table(spark, sf_dir, "documents").select("doc_id", "text")), "pack-pieces")
    placed = place_pieces(pieces, keep=("doc_id", "piece", "start", "ids_crc32"))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op4_media(spark, sf_dir):
    media = encode_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return analyse_media(media).drop("clips")
