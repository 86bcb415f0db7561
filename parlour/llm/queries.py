"""The operators applied to the given tables: ``QUERIES`` by name, and ``ORACLE``, DuckDB SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlour.llm.centroids import cluster, cluster_report
from parlour.llm.common import table
from parlour.llm.decontaminate import decontaminated
from parlour.llm.exact_dedup import exact_dedup
from parlour.llm.licenses import KNOWN, canonical_sql, licences
from parlour.llm.packing import pack
from parlour.llm.prefix_trie import prefix_trie
from parlour.llm.quality_crf import fit_quality, held_out, quality_scores
from parlour.llm.secret_scan import secret_report, secret_spans
from parlour.llm.simhash import near_dedup
from parlour.llm.suffix_dedup import remove_repeats, repeat_report
from parlour.llm.toxicity_kn import fit_toxicity, toxicity_scores
from parlour.llm.url_filter import filter_urls, fit_urls, labelled_urls
from parlour.llm.winnowing import document_fingerprints, fingerprint_report

QUALITY_THRESHOLD, TOXICITY_THRESHOLD = 0.3, 0.7


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(remove_repeats(table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), fit_urls(labelled_urls(spark)))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(secret_spans(table(spark, sf_dir, "documents")))


def quality_model(spark: SparkSession, sf_dir: str) -> dict:
    return fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 5, 0)))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 3, 1)))
    return toxicity_scores(docs, model, carry=["doc_id"]).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                                               (F.col("score") >= TOXICITY_THRESHOLD).cast("int").alias("predicted"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(*cluster(table(spark, sf_dir, "embeddings")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(document_fingerprints(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_suffix_array_dedup, op3_url_filter, op4_secret_scan, op5_quality_crf, op6_license_scan, op7_decontaminate,
                                 op8_toxicity_kneser_ney, op9_pack, op10_exact_dedup, op11_centroid_clustering, op12_prefix_trie, op13_winnowing)}

_TEXT = lambda t: "'" + t.replace("'", "''") + "'"

ORACLE = {
    "op6_license_scan": f"""
        WITH k AS (SELECT sha256({canonical_sql("t")}) AS digest, min(l) AS license FROM (VALUES {", ".join(f"({_TEXT(n)}, {_TEXT(t)})" for n, t in KNOWN)}) v(l, t) GROUP BY 1),
             d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
             s AS (SELECT r, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '\\n[ \\t]*\\n') AS blocks FROM d),
             u AS (SELECT r, unnest(lines) AS unit FROM s WHERE len(lines) > 1
                   UNION ALL SELECT r, unit FROM (SELECT r, unnest(blocks) AS unit FROM s WHERE len(blocks) > 1) WHERE contains(unit, chr(10))),
             m AS (SELECT r, license FROM u JOIN k ON k.digest = sha256({canonical_sql("unit")})),
             w AS (SELECT d.r, doc_id, sha256({canonical_sql("text")}) AS text_digest FROM d),
             x AS (SELECT w.*, k.license FROM w LEFT JOIN k ON k.digest = w.text_digest),
             e AS (SELECT r, license FROM m UNION ALL SELECT r, license FROM x WHERE license IS NOT NULL),
             a AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n FROM e GROUP BY r)
        SELECT doc_id, text_digest, license, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_matches FROM x LEFT JOIN a USING (r)""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)""",
}
