"""The registered queries of the corpus operators, one per operator, over whole tables, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import byte_bpe, conversations, exact_dedup, fingerprint, language_id, packing, runs, secret_scan, sentencepiece_codec, sharding, simhash_dedup, token_counts, url_filter


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.pieces(_docs(spark, sf_dir), context=2048, end=0), context=2048)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.lengths(_docs(spark, sf_dir)), limits=[512, 1024, 2048, 4096, 8192, 16384, 32768])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_docs(spark, sf_dir), shards=16, slots=4096)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(_docs(spark, sf_dir), shingle=3, radius=2).select("doc_id", "fingerprint", "component_id")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    language = secret_scan.learn_words(docs)
    model = secret_scan.train(secret_scan.synthetic_findings(spark, language=language), language)
    return secret_scan.scan(docs, model).drop("row")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(_docs(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.report(_docs(spark, sf_dir))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    docs = _docs(spark, sf_dir).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = language_id.learn(docs.filter("not held_out"))
    return language_id.predict(docs, model, carry=["doc_id", "held_out"])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(_docs(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(_docs(spark, sf_dir), edit=True)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_token_counts, op3_sharding, op4_simhash_dedup, op5_secret_scan, op6_document_fingerprints, op7_sentencepiece, op8_url_filter, op9_language_id, op10_exact_dedup, op11_byte_bpe, op12_periodic_runs, op13_conversation_repair)
}

def _quoted(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


_RULES = ", ".join(f"({_quoted(r.pattern)}, {_quoted(r.name)}, {_quoted(r.action)}, {r.weight}, {i})" for i, r in enumerate(url_filter.default_rules()))

ORACLE = {
    "op8_url_filter": rf"""
        with rules(pattern, name, action, weight, ord) as (values {_RULES}),
        p as (select row_number() over () as n, page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
            coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
        f as (select p.*, r.pattern, r.name, r.action from p left join rules r on regexp_matches(p.host || p.path, r.pattern) qualify row_number() over (partition by n order by weight desc, ord) = 1)
        select page_id, host, path, name as rule, coalesce(action, 'allow') as verdict, pattern from f
    """,
    "op10_exact_dedup": r"""
        with n as (
            select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents
        )
        select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size,
               doc_id = first_value(doc_id) over w as kept, sha256(t) as text_sha256
        from n window w as (partition by t order by n desc, doc_id)
    """,
}
