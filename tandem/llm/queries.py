"""The registered queries of the ten operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import bpe, embeddings, html_text, mixing, quality, simhash, token_counts, token_files, url_filter, warc

#: Rules of the URL filter.
BLOCK_RULES, ALLOW_RULES = ("com/en/", "example.net/de/8", "org/es/"), ("example.com/en/7", "net/de/")
#: Listed domains of the URL filter; they and all below them are blocked where no rule fits.
LISTED = ("cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org", "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org", "casino-win.example.com", "casino-win.example.net", "casino-win.example.org", "free-bets.example.com", "free-bets.example.net", "free-bets.example.org", "ads-track.example.com", "ads-track.example.net", "ads-track.example.org", "adult-x.example.com", "adult-x.example.net", "adult-x.example.org")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_amounts(_table(spark, sf_dir, "documents")).drop("source")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), BLOCK_RULES, ALLOW_RULES, listed).drop("url")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path()).withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MIXING = rf"""
with sized as (select doc_id, source, cast(len({_WORDS}) as bigint) as size from documents),
sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
  row_number() over (order by source nulls last) as place from sources),
ratios as (select *, 3 * source_size / weight as ratio from ranked),
shares as (select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as share
  from ratios window before as (order by ratio, place rows between unbounded preceding and 1 preceding)),
targets as (select source, source_size, case when share >= ratio then (3 * source_size)::double
  else (select arg_min(share, ratio) from shares where share < ratio) * weight end as target from shares),
keyed as (select *, coalesce(sum(size) over (partition by source order by md5('mix-1' || coalesce(doc_id::varchar, '')), doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from sized),
joined as (select doc_id, size, source_size, target, before, case when source_size > 0 then cast(floor(floor(target) / source_size) as bigint) else 0 end as whole
  from keyed join targets on keyed.source is not distinct from targets.source)
select doc_id, size, source_size, target, cast(whole * size + greatest(0, least(size, floor(target)::bigint - whole * source_size - before)) as bigint) as taken from joined
"""

_HOST = r"translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = ", ".join(f"('{r}', '{v}')" for v, rules in (("block", BLOCK_RULES), ("allow", ALLOW_RULES)) for r in rules)
_LISTED = ", ".join(f"('{x}')" for x in LISTED)
_URLS = rf"""
with rules(rule, says) as (values {_RULES}), listed(key) as (values {_LISTED}),
rests as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, {_HOST} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests),
fitting as (select page_id, arg_max(rule, length(rule) * 1000 + instr(rule, '/')) as rule from parts, rules
  where ('.' || host) like '%.' || split_part(rule, '/', 1) and starts_with(path, substr(rule, instr(rule, '/'))) group by page_id)
select parts.page_id, host, path, fitting.rule, coalesce(says, case when exists (select 1 from listed where ('.' || host) like '%.' || key) then 'block' else 'allow' end) as verdict
from parts left join fitting on parts.page_id = fitting.page_id left join rules on fitting.rule = rules.rule
"""

_n = lambda pattern, of: f"len(regexp_extract_all({of}, '{pattern}'))"
_PHRASES = " or ".join(f"contains(low, '{p}')" for p in quality.PHRASES)
_QUALITY = rf"""
with words as (select doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as nth from words),
counted as (select *, {_n(r'[^\x20\x09-\x0D]+', 'line')} as n, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from lines),
judged as (select *, 2 * {_n(quality.SYMBOLS, 'line')} > n or (n >= 4 and not regexp_matches(line, '{quality.MARKS}')) or 4 * {_n(quality.SHOUTS, 'line')} > n
  or ({_n(quality.SEPARATORS, 'line')} >= 3 and n <= 4 * ({_n(quality.SEPARATORS, 'line')} + 1)) or (n <= 40 and ({_PHRASES})) as fails,
  row_number() over (partition by doc_id, line order by nth) > 1 as again from counted where n > 0),
by_line as (select doc_id, cast(count(*) filter (again) as bigint) as n_dup_lines, cast(coalesce(sum(n) filter (fails), 0) as bigint) as lost from judged group by doc_id),
windows as (select doc_id, i, list_slice(w, i, i + 4) as win from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as times from windows) where times > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, range(5) r(k) group by doc_id),
base as (select words.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast({_n('[#*$%&|<>]', 'text')} as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words, coalesce(lost, 0) as lost_words
  from words left join by_line on words.doc_id = by_line.doc_id left join covered on words.doc_id = covered.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * lost_words <= 50 * n_words as kept, lost_words from base
"""

_WARC = """
with rows as (select page_id, coalesce(html, '') as html from pages),
digests as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest from rows),
firsts as (select *, min(page_id) over (partition by payload_digest) as first from digests)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first != page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and first != page_id then first end as refers_to from firsts
"""

_EMBEDDINGS = """
with recursive good as (select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from good a, good b where a.vec_id != b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) as (select vec_id, vec_id from good union select reach.a, links.b from reach join links on reach.b = links.a)
select vec_id, coalesce((select count(*) from links where links.a = vec_id), 0) as n_links, coalesce((select min(b) from reach where reach.a = vec_id), vec_id) as component_id,
  vec_id = coalesce((select min(b) from reach where reach.a = vec_id), vec_id) as kept from embeddings
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": _EMBEDDINGS, "op3_warc_normalise": _WARC, "op4_source_mixing": _MIXING, "op6_url_filter": _URLS, "op10_quality_rules": _QUALITY}
