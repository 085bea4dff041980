"""The operators applied to whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, covertree, exponion, licenses, mixing, packing, quality, repeats, simhash, toxicity, turntrie, urls, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file stands on this machine and on executors alike."""
    if importlib.util.find_spec("public_tokenizers"):
        from public_tokenizers import path

        return path(name)
    return os.path.join("/opt/tokenizers", name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_embeddings(_read(spark, sf_dir, "embeddings"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("matches")


def held_out(doc_id: Column) -> Column:
    """Rows that no model of toxicity is fitted on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents")).drop("removed_chars")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.dedup_chunks(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_repeated", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.cluster(_read(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.pages(_read(spark, sf_dir, "pages"))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turntrie.trie(_read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_cover_tree": op2_cover_tree,
        "op3_licenses": op3_licenses,
        "op4_toxicity": op4_toxicity,
        "op5_simhash": op5_simhash,
        "op6_quality": op6_quality,
        "op7_packing": op7_packing,
        "op8_mixing": op8_mixing,
        "op9_chunks": op9_chunks,
        "op10_repeats": op10_repeats,
        "op11_exponion": op11_exponion,
        "op12_warc": op12_warc,
        "op13_turn_trie": op13_turn_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.ORACLE_SQL, "op11_exponion": exponion.ORACLE_SQL, "op12_warc": warc.ORACLE_SQL, "op13_turn_trie": turntrie.ORACLE_SQL}
