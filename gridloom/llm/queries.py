"""The operators' queries over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, html_text, licences, mixing, near_dedup, quality, substring_dedup, token_files, topk, warc
from gridloom.llm._shared import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored, score = quality.with_quality(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), F.col(score).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), every=50)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = mixing.MixConfig()
    rates = mixing.with_rates(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"), config)
    return rates.select("doc_id", "tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(config.domains)], F.round("rate", 6).alias("rate"), mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", licences.licence_column().alias("_l")).select("doc_id", "_l.*")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", html_text.text_column().alias("text"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    shards = token_files.write_shards(_table(spark, sf_dir, "documents"), folder, token_files.TokenFileConfig(tokenizer_path(), end_id=1))
    return token_files.read_shards(spark, folder, shards)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), folder)
    return warc.parsed(warc.read_archive(spark, folder)).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_top_k": op2_top_k,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_mixing": op5_mixing,
    "op6_licences": op6_licences,
    "op7_html_text": op7_html_text,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op2_top_k": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
        ), r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank" from s)
        select query_id, "rank", vec_id, score from r where "rank" <= 5""",
    "op3_substring_dedup": """
        with d as (
            select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
        ), g as (
            select doc_id, unnest(range(1, len(w) - 18)) as s, w from d where len(w) >= 20
        ), h as (select doc_id, s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) as k from g),
        r as (select doc_id, s, row_number() over (partition by k order by doc_id, s) as n from h),
        x as (select distinct doc_id, unnest(range(s, s + 20)) as i from r where n > 1),
        p as (select doc_id, unnest(w) as t, generate_subscripts(w, 1) as i from d),
        k as (
            select p.doc_id, string_agg(t, ' ' order by i) filter (where x.i is null) as kept, count(x.i) as gone
            from p left join x using (doc_id, i) group by p.doc_id
        )
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(gone, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from d left join k using (doc_id)""",
    "op10_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
        f as (select *, min(page_id) over (partition by d) as f from p)
        select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
            case when n >= 100 and page_id <> f then 'revisit' else 'response' end as record_type,
            case when n >= 100 and page_id <> f then f end as refers_to
        from f""",
}
