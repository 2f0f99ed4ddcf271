"""The thin queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm import chat, decontam, embeddings, html, langid, minhash, mixing, repair, tokens, warc

#: Documents whose crc32 of the id as text leaves this remainder by 4 are held out of the language model's fit.
HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.where(F.coalesce(~F.expr(HELD_OUT), F.lit(False))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    return found.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.with_copies(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.conversation_calls(_table(spark, sf_dir, "conversations"))
    linked = chat.link_tool_calls(calls, results, chat.TURN_SCHEMAS)
    return linked.select(F.col("conv").alias("conv_id"), F.col("call").alias("call_id"), "position", "level", "linked", "valid", "record")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.encode_and_read(_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, threshold=0.85)


OP4_SQL = r"""
with recursive asked as (
  select conv_id, turn, text, conv_id::VARCHAR || '-' || turn::VARCHAR as call_id, max(turn) over (partition by conv_id) as last
  from conversations where role = 'user'
), calls as (
  select *, case when conv_id % 2 = 0 and turn >= 2 then conv_id::VARCHAR || '-' || (turn - 2)::VARCHAR when conv_id % 2 = 1 and turn + 2 <= last then conv_id::VARCHAR || '-' || (turn + 2)::VARCHAR end as dep
  from asked
), uses as (
  select call_id, count(*) as uses from calls group by 1
), below(call_id, level) as (
  select call_id, 0 from uses union select c.call_id, b.level + 1 from below b join calls c on c.dep = b.call_id
), levels as (
  select call_id, max(level)::BIGINT as level from below group by 1
), answers as (
  select conv_id::VARCHAR || '-' || (turn - 1)::VARCHAR as call_id, min(text) as content from conversations where role = 'assistant' group by 1
)
select c.conv_id, c.call_id, c.turn as position, l.level, a.call_id is not null as linked,
  u.uses = 1 and c.text is not null and (c.dep is null or d.call_id is not null) as valid,
  '{"arguments":{' || case when c.text is null then '' else '"text":' || to_json(c.text)::VARCHAR || ',' end || '"turn":' || c.turn::VARCHAR || '},"call_id":"' || c.call_id || '","depends_on":['
    || case when c.dep is not null then '"' || c.dep || '"' else '' end || '],"name":"reply","result":' || coalesce(to_json(a.content)::VARCHAR, 'null') || '}' as record
from calls c join uses u on c.call_id = u.call_id join levels l on c.call_id = l.call_id left join answers a on c.call_id = a.call_id left join uses d on c.dep = d.call_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_embedding_neighbours, op2_language_id, op3_mix_sources, op4_tool_calls, op5_token_shards, op6_html_text, op7_token_counts, op8_warc, op9_decontaminate, op10_minhash]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixing.SQL, "op4_tool_calls": OP4_SQL}
