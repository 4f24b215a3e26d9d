"""Registered queries: each applies one operator to its whole table.

``queries()`` and ``oracle_sql()`` are what the entry point adds to its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarnish.llm import bpe, embeddings, exact, lexical, lm, merkle, packing, preference, quality, secrets, simhash, sql, urls, warc

#: The tokenizer files, as this installation names them; operators take them as parameters.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 1


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = bpe.encode(_table(spark, folder, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    digests = encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return bpe.decode(digests, RANKS, keep=False).withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op3_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, folder, "embeddings"))


def _written_pairs(out: DataFrame) -> DataFrame:
    return out.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", preference.written(F.col("chosen_spans")).alias("chosen_spans"),
                      preference.written(F.col("rejected_spans")).alias("rejected_spans"))


def op4_preference(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations")
    return _written_pairs(preference.pairs(turns, preference.diverted(turns), "conv_id"))


def op4_preference_all(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations")
    return _written_pairs(preference.pairs(turns, preference.diverted_all(turns), "conv_id", whole=True))


def op5_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(_table(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_table(spark, folder, "documents"), TOKENIZER, END)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "segment", "n_loss")


def op8_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(_table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = warc.new_folder(spark)
    warc.write(_table(spark, folder, "pages"), archive)
    return warc.read(spark, archive, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(lexical.build(_table(spark, folder, "documents")), _table(spark, folder, "benchmark"), k=10)


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf_digest(*values[:3], F.col("n_chars") + 1, values[4]))
    proved = merkle.prove(docs, merkle.leaf_digest(*values), "lang", "doc_id", [F.col("doc_id"), tampered.alias("tampered")])
    again = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_exact(spark: SparkSession, folder: str) -> DataFrame:
    marked = exact.mark(_table(spark, folder, "documents").select("doc_id", "text"), digests=lambda body: {"text_sha256": F.sha2(body, 256)})
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, run in globals().items() if name.startswith("op") and callable(run)}


def oracle_sql() -> dict[str, str]:
    return {"op4_preference": sql.PREFERENCE, "op5_urls": sql.URLS, "op9_quality": sql.QUALITY, "op10_warc": sql.WARC,
            "op11_lexical": sql.LEXICAL, "op12_merkle": sql.MERKLE, "op13_exact": sql.EXACT}
