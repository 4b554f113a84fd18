"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daybook.llm import chat_format, embedding_dedup, filter_audit, html_extract, jaccard_join, lang_id, lm_scoring, mixing, piece_codec, quality_crf, topk_search, turn_repair, word_codec


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.with_probe(spark, _table(spark, sf_dir, "conversations")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(_table(spark, sf_dir, "documents"), piece_codec.default_model())


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.assign(_table(spark, sf_dir, "documents"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.similar_vectors(_table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired_conversations(turn_repair.damage(_table(spark, sf_dir, "conversations")))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_codec.round_trip(_table(spark, sf_dir, "documents"), word_codec.default_model())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = {name: f for name, f in globals().items() if name.startswith("op")}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return ORACLES


ORACLES = {
    # the chat template's length: markers, role, line end, and the text with its escapes
    "op3_chat_formatting": """
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role = 'assistant' as loss from conversations
            union all
            select -1, t, r, '</s>[INST] ok [/INST]', r = 'assistant' from (values (0, 'user'), (1, 'assistant')) as p(t, r)
        ), sized as (
            select *, length(role) + length(text) + 16
                + 2 * (length(text) - length(replace(text, '%', '')))
                + (length(text) - length(replace(text, '<|', ''))) + 2 * (length(text) - length(replace(text, '</s>', ''))) // 4
                + 2 * (length(text) - length(replace(text, '<s>', ''))) // 3 + 2 * (length(text) - length(replace(text, '[INST]', ''))) // 6
                + 2 * (length(text) - length(replace(text, '[/INST]', ''))) // 7 as n
            from turns
        )
        select conv_id, count(*) as n_turns,
            sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
            coalesce(sum(length(text)) filter (where loss), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where loss), '')) as loss_sha256,
            sum(n)::bigint as formatted_chars
        from sized group by conv_id
    """,
    "op6_topk_search": """
        with codes as (
            select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as z from embeddings where embedding is not null
        ), scored as (
            select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.z, c.z), lambda p: p[1] * p[2]))::bigint as score
            from codes q join codes c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
        ), ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
        )
        select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 5
    """,
    "op10_embedding_dedup": """
        with recursive v as (
            select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
        ), l as materialized (
            select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
            where list_cosine_similarity(a.e, b.e) >= 0.95
        ), walk(a, b) as (
            select vec_id, vec_id from v union select w.a, l.b from walk w join l on l.a = w.b
        ), roots as (select a, min(b) as root from walk group by a)
        select v.vec_id, (select count(*) from l where l.a = v.vec_id)::bigint as n_links, r.root as component_id, v.vec_id = r.root as kept
        from v join roots r on r.a = v.vec_id
    """,
    "op9_ngram_jaccard": """
        with recursive words as (
            select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w
            from documents
        ), sets as (
            select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                else list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) end as s
            from words
        ), items as (select doc_id, len(s) as n, unnest(s) as g from sets),
        pairs as (
            select a.doc_id as a, b.doc_id as b, a.n + b.n as total, count(*) as common
            from items a join items b on a.g = b.g and a.doc_id < b.doc_id and 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
            group by all
        ), half as (select a, b from pairs where 100 * common >= 90 * (total - common)),
        l as materialized (select a, b from half union all select b, a from half),
        walk(a, b) as (select doc_id, doc_id from sets union select w.a, l.b from walk w join l on l.a = w.b),
        roots as (select a, min(b) as root from walk group by a)
        select s.doc_id, coalesce(len(s.s), 0)::bigint as n_shingles, r.root as component_id from sets s join roots r on r.a = s.doc_id
    """,
    # masks and orders of the five filters; a document's mask has bit i for the i-th of ABCDE
    "op11_filter_audit": """
        with docs as (
            select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, min(doc_id) over (partition by coalesce(text, '')) as least
            from documents
        ), counted as (
            select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from docs
        ), own as (
            select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id
        ), masked as (
            select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
                (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
                + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
                + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(counted.doc_id > least, false)::int as mask
            from counted left join own on own.doc_id = counted.doc_id
        ), profile as (select part, mask, good, toxic, count(*) as n from masked group by all),
        f(name, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders as (
            select concat(a.name, b.name, c.name, d.name, e.name) as filter_order from f a, f b, f c, f d, f e
            where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
        ), steps as (
            select filter_order, step, f.bit, coalesce((select sum(g.bit) from f g where instr(filter_order, g.name) < step), 0)::int as before
            from orders, range(1, 6) as r(step), f where f.name = filter_order[step]
        ), cells as (
            select part, filter_order, step, n, good, toxic, mask & bit <> 0 as fails, mask & before <> 0 as gone, mask = bit as alone
            from profile, steps
        ), sums as (
            select part, filter_order, step::int as step, coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept,
                coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed, coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant,
                coalesce(sum(n) filter (alone), 0)::bigint as unique_fails, coalesce(sum(n) filter (fails and not gone and good), 0)::bigint as good_lost,
                coalesce(sum(n) filter (fails and not gone and toxic), 0)::bigint as toxic_lost
            from cells group by all
        )
        select sums.*, (sum(removed) over (partition by part, filter_order[step]))::bigint as shapley from sums
    """,
}
