"""The queries opN_<name> and pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import centroids, fingerprint, htmlmain, infill, langid, mixing, ngramjoin, packing, paragraphs, pii, quality, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op2(_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op9(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op10(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op4(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op3(_table(spark, sf_dir, "documents"))


def op3_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op3_pages(_table(spark, sf_dir, "pages"), langid.fitted(_table(spark, sf_dir, "documents")))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.lloyd(_table(spark, sf_dir, "embeddings"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.op12(_table(spark, sf_dir, "documents"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pii": op2_pii,
    "op3_language_id": op3_language_id,
    "op3_language_id_pages": op3_language_id_pages,
    "op4_warc": op4_warc,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_fingerprints": op6_fingerprints,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_centroids": op11_centroids,
    "op12_infill": op12_infill,
    "op13_simhash": op13_simhash,
}
ORACLE = {
    "op1_quality_rules": quality.OP1_SQL,
    "op4_warc": warc.OP4_SQL,
    "op11_centroids": centroids.OP11_SQL,
    "op12_infill": infill.OP12_SQL,
}
