"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import _base as B
from . import ann, chat, lines, mixing, neardup, packing, shingles, tokens, toxicity


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ngram_jaccard_join(spark, sf_dir):
    return shingles.jaccard_join(_table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id", "n_links")


def chat_formatting(spark, sf_dir):
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def token_counts(spark, sf_dir):
    return tokens.count_table(_table(spark, sf_dir, "documents"))


def source_mixing(spark, sf_dir):
    return mixing.decide(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def token_files(spark, sf_dir):
    return tokens.token_files(_table(spark, sf_dir, "documents"), B.new_path(spark, "records")).select("doc_id", "start", "n_tokens", "ids_crc32")


def nearest_neighbours(spark, sf_dir):
    v = _table(spark, sf_dir, "embeddings")
    return ann.search(v, v.filter(F.col("vec_id") % 20 == 0))


def line_dedup(spark, sf_dir):
    d = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def embedding_near_dedup(spark, sf_dir):
    rows, recall = neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("audited_recall", F.lit(float(recall)))


def best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def toxicity_scores(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    d = toxicity.score(docs, model)
    return d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_ngram_jaccard_join": ngram_jaccard_join,
    "op2_chat_formatting": chat_formatting,
    "op3_token_counts": token_counts,
    "op4_source_mixing": source_mixing,
    "op5_token_files": token_files,
    "op6_nearest_neighbours": nearest_neighbours,
    "op7_line_dedup": line_dedup,
    "op8_embedding_near_dedup": embedding_near_dedup,
    "op9_best_fit_packing": best_fit_packing,
    "op10_toxicity": toxicity_scores,
}

ORACLE_SQL = {
    "op2_chat_formatting": """
        with turns as (
            select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos,
                   count(*) over (partition by conv_id) as n_turns, floor(coalesce(turn, -1024) / 1024) as span
            from conversations
        ), prefixes as (
            select conv_id, pos, n_turns, list([coalesce('r' || role, ''), coalesce('t' || text, '')]) over (partition by conv_id order by pos) as said from turns
        ), whole as (
            select said, n_turns, min(conv_id) as conv_id from prefixes where pos = n_turns group by said, n_turns
        ), maximal as (
            select conv_id from whole where not exists (select 1 from prefixes p where p.pos < p.n_turns and p.pos = whole.n_turns and p.said = whole.said)
        ), parts as (
            select conv_id, span, n_turns, string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' order by pos) as text
            from turns where conv_id in (select conv_id from maximal) group by conv_id, span, n_turns
        )
        select conv_id, cast(row_number() over (partition by conv_id order by span) - 1 as integer) as part, n_turns, text from parts""",
    "op7_line_dedup": r"""
        with split as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
        ), keyed as (
            select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from split
        ), repeated as (
            select key, min(doc_id) as first from keyed where length(key) >= 10 group by key having min(doc_id) < max(doc_id)
        ), marked as (
            select k.*, r.first is not null and k.doc_id <> r.first as gone from keyed k left join repeated r using (key)
        )
        select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from marked group by doc_id""",
}
