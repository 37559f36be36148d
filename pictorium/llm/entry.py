"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, jaccard_join, mixing, packing, quality, suffix_dedup, token_binary, token_counts, toxicity
from .common import bound_arrow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_arrow(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_files(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.redacted_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=4096, end_id=1)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=200)


PLANTED = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.write_chat(c.unionByName(extra)))


OP3_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (
  select u as node, v as other from links union select r.node, l.v from reach r join links l on r.other = l.u
), comp as (select node, least(node, min(other)) as component_id from reach group by node)
select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component_id, e.vec_id) as component_id, coalesce(component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join (select u, count(*) as n from links group by u) k on k.u = e.vec_id left join comp on comp.node = e.vec_id
"""

OP10_SQL = r"""
with c as (
  select conv_id::bigint conv_id, turn::bigint turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7::bigint, 0::bigint, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), t as (
  select *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = '###'))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 as escaped,
    lag(role) over (partition by conv_id order by turn nulls first, role, text) as before
  from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + length(role) + 2 + escaped + 8) as bigint) as formatted_chars,
  bool_and(case when before is null then role in ('system', 'user') when before = 'system' then role = 'user' when before = 'user' then role = 'assistant' else role = 'user' end)
    and last(role order by turn nulls first, role, text) = 'assistant' as valid
from t group by conv_id
"""


def _op2_sql() -> str:
    bucket = lambda v: f"(({v} >> greatest(length(bin({v})) - 6, 0)) << greatest(length(bin({v})) - 6, 0))"
    each = " union all ".join(f"select lang_key, source_key, '{m}' as measure, {bucket(m)} as bucket from passed" for m in quality.MEASURES)
    fence = ", ".join(
        f"max(case when measure = '{m}' then total end) as rows_{m}, max(case when measure = '{m}' then q90 + {quality.SPREAD} * greatest(q90 - q50, q90 // {quality.RESOLUTION}) end) as high_{m}, max(case when measure = '{m}' then {f'q10 - {quality.SPREAD} * greatest(q50 - q10, q10 // {quality.RESOLUTION})' if low else '0'} end) as low_{m}"
        for m, low in quality.MEASURES.items()
    )
    level = lambda name, keys: f"""{name} as (
  select {keys}, {fence} from (
    select {keys}, measure, max(total) as total, {", ".join(f"min(case when upto * 100 >= total * {k} then bucket end) as q{k}" for k in (10, 50, 90))} from (
      select {keys}, measure, bucket, sum(n) over (partition by {keys}, measure order by bucket) as upto, sum(n) over (partition by {keys}, measure) as total
      from (select {keys}, measure, bucket, sum(n) as n from sketch group by all)) group by all) group by {keys})"""  # noqa: E731
    pick = lambda side, m: f"case when o.rows_{m} >= {quality.LEAST_ROWS} then o.{side}_{m} when l.rows_{m} >= {quality.LEAST_ROWS} then l.{side}_{m} else e.{side}_{m} end as {side}_{m}"
    picked = ", ".join(pick(side, m) for m in quality.MEASURES for side in ("high", "low"))
    inside = " and ".join(f"coalesce({m} between low_{m} and high_{m}, true)" for m in quality.MEASURES)
    return rf"""
with d as (
  select row_number() over () as r, doc_id::bigint as doc_id, lang, source, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
), win as (
  select r, unnest(range(0, len(words) - 2)) as i, unnest(list_transform(range(1, len(words) - 1), lambda k: words[k] || ' ' || words[k + 1] || ' ' || words[k + 2])) as g from w where len(words) >= 3
), win2 as (
  select r, i, count(*) over (partition by r, g) as n from win
), rep as (
  select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from win2 where n > 1) group by r
), f as (
  select r, doc_id, coalesce('=' || lang, '~') as lang_key, coalesce('=' || source, '~') as source_key, len(words)::bigint as n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join rep using (r)
), m as (
  select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, 1000 * n_symbols // greatest(word_chars, 1) as symbol_rate,
    100 * word_chars // greatest(n_words, 1) as word_length, 1000 * n_repeat_words // greatest(n_words, 1) as repeat_rate, 1000 * n_dup_lines // greatest(n_lines, 1) as line_rate
  from f
), passed as (select * from m where not base_failed), sketch as (
  select lang_key, source_key, 1 as every, measure, bucket, count(*) as n from ({each}) where bucket > 0 group by all
), {level("own", "lang_key, source_key")}, {level("lng", "lang_key")}, {level("cor", "every")}, t as (
  select o.lang_key, o.source_key, {picked} from own o join lng l using (lang_key) cross join cor e
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and {inside}) as kept
from m left join t using (lang_key, source_key)
"""


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality_rules": op2_quality_rules,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_mixing": op5_mixing,
        "op6_token_binary": op6_token_binary,
        "op7_token_counts": op7_token_counts,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_chat_format": op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _op2_sql(), "op3_embedding_dedup": OP3_SQL, "op10_chat_format": OP10_SQL}
