"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geostride.llm import embeddings, langid, mixing, ngram_join, packing, pii, records, spotsigs, toxicity, url_filter
from geostride.session import table


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_pii": pii.query,
    "op3_ngram_join": ngram_join.query,
    "op4_packing": packing.query,
    "op5_fingerprints": spotsigs.query,
    "op6_records": records.query,
    "op7_embeddings": embeddings.query,
    "op8_mixing": op8_mixing,
    "op9_langid": langid.query,
    "op10_toxicity": toxicity.query,
}
ORACLE_SQL = {
    "op1_url_filter": url_filter.ORACLE_SQL,
    "op3_ngram_join": ngram_join.ORACLE_SQL,
    "op7_embeddings": embeddings.ORACLE_SQL,
    "op8_mixing": mixing.ORACLE_SQL,
}
