"""The subpackage's queries: each operator over its whole table, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import bottomk, bpe, html_density, mixing, ngram_lm, pivot_index, rule_ensemble, simhash_bk, token_output, warc
from pagewright.workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """The byte-level vocabulary that is used where a caller names none."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


def op2_pivot_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(Workspace(spark, "op2"), table(spark, sf_dir, "embeddings"))


def op3_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_duplicates(Workspace(spark, "op3"), table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_bk.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_bottom_k_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.edited_likeness(Workspace(spark, "op4"), table(spark, sf_dir, "documents"))


def op5_mixing_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(Workspace(spark, "op5"), table(spark, sf_dir, "documents")).taken()


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.Model(Workspace(spark, "op6"), table(spark, sf_dir, "documents")).scores()


def op7_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(Workspace(spark, "op8"), table(spark, sf_dir, "pages"))
    return warc.read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.score(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")))


def op10_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_output.write_tokens(Workspace(spark, "op10"), table(spark, sf_dir, "documents"), vocabulary_path())
    return token_output.checksums(token_output.read_tokens(spark, manifest))


QUERIES = {f.__name__: f for f in (op1_composite_text_density, op2_pivot_permutation_index, op3_simhash_bk_trees, op4_bottom_k_sketches, op5_mixing_by_blocks, op6_deleted_interpolation, op7_bpe_pair_index, op8_seekable_warc, op9_rule_ensemble, op10_token_parquet)}

#: SQL where SQL can tell the whole result: base32 is SHA-1's hexadecimal digits by fives, each five four letters.
ORACLE_SQL: dict[str, str] = {
    "op8_seekable_warc": """
        WITH p AS (
          SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
          SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY h) AS last,
                 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1) for i in range(32)], '') AS payload_digest FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to FROM d""",
}
