"""The operators applied to whole tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm import alignment, exact_dedup, importance, language_id, mixing, packing, pieces, quality_crf, quality_rules, repeats, sharding, simhash, toxicity
from weftlog.llm.common import held_out, text_or_empty, written

TOKENIZER, BYTE_LEVEL, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
SHARDS = 24
#: Words of a repeated passage, at least.
PASSAGE_WORDS = 20
QUALITY_THRESHOLD, TOXIC_THRESHOLD = 0.3, 0.5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def not_in_fold(modulus: int, remainder: int):
    return lambda id_col: ~held_out(id_col, modulus, remainder)


def op1_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    thin = docs.select("doc_id", "source", (F.octet_length(text_or_empty()) + 8).cast("bigint").alias("size"), F.crc32(text_or_empty()).alias("text_crc32"))
    placed = sharding.interleave(thin, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path()).withColumnRenamed("doc", "doc_id")


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), not_in_fold(5, 0))
    scored = quality_crf.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir), radius=3, size=3)
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_units(documents(spark, sf_dir), "clause", PASSAGE_WORDS)
    return found.select(F.col("doc").alias("doc_id"), F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.lower(F.hex("digest")).alias("passage_md5"), F.col("keep_doc").alias("keep_doc_id"), F.col("keep_start").alias("keep_start_char"))


def op7_host_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    thin = written(documents(spark, sf_dir).select("doc_id", "source", mixing.n_words().alias("words")), "words")
    mixed = mixing.mix(thin, words=F.col("words"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = language_id.train(docs, where=not_in_fold(4, 2))
    found = language_id.identify(docs, profiles)
    return found.select(F.col("id").alias("doc_id"), held_out("id", 4, 2).alias("held_out"), "lang_pred", "score")


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), not_in_fold(5, 0))
    scored = toxicity.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "score", (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(documents(spark, sf_dir), tokenizer_path(PIECES), keep_ids=False).withColumnRenamed("id", "doc_id")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer_path(BYTE_LEVEL), tokenizer_path(PIECES)).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (
    op1_stratified_shards, op2_exact_dedup, op3_tier_packing, op4_quality_crf, op5_simhash_groups,
    op6_repeated_lines, op7_host_line_rules, op8_source_mix, op9_rank_order_language, op10_compression_toxicity,
    op11_importance_resampling, op12_sentencepiece, op13_tokenizer_alignment, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
KEY = "('0x' || substr(md5({seed} || ':' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint"

def crc_table() -> str:
    """The 256 steps of CRC-32 as an SQL list."""
    def step(i: int) -> int:
        for _ in range(8):
            i = i >> 1 ^ 0xEDB88320 if i & 1 else i >> 1
        return i

    return f"[{', '.join(str(step(i)) for i in range(256))}]::bigint[]"


CRC_TABLE = crc_table()

OP1_SQL = f"""
with base as (
  select doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 as size, hex(encode(coalesce(text, ''))) as hx,
    case when source is null then 'n' else 'v' || source end as s, {KEY.format(seed="'17'")} as k
  from documents
), ranked as (
  select *, (row_number() over (partition by s order by k, doc_id nulls first) - 1
    + ((('0x' || substr(md5(s), 1, 8))::bigint)::double + 0.5) / 4294967296.0) / count(*) over (partition by s) as f
  from base
), placed as (
  select *, row_number() over (order by f, s, k, doc_id nulls first) - 1 as pos, count(*) over () as n from ranked
)
select doc_id, size::bigint as size,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::bigint)),
    lambda a, x: xor(a >> 8, ({CRC_TABLE})[(xor(a, x) & 255) + 1])), 4294967295::bigint) as text_crc32,
  'rows' as law, (pos * {SHARDS} // n)::int as shard,
  (pos - ((pos * {SHARDS} // n) * n + {SHARDS - 1}) // {SHARDS})::bigint as slot, null::int as grown_shard, source
from placed
"""

OP2_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""

OP6_SQL = f"""
with cut as (
  select doc_id, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') as toks from documents
), toks as (
  select doc_id, length(regexp_extract(body, '^[\\x20\\x09-\\x0D]*')) as lead, unnest(toks) as tok, generate_subscripts(toks, 1) as i from cut
), words as (
  select doc_id, i, regexp_replace(tok, '[\\x20\\x09-\\x0D]+$', '') as word, lead + sum(length(tok)) over here - length(tok) as pos,
    case when regexp_matches(tok, '[.!?,;:][\\x20\\x09-\\x0D]+$') or contains(tok, chr(10)) then 1 else 0 end as last, lead(i) over here is null as final
  from toks window here as (partition by doc_id order by i)
), starts as (
  select * from (select *, coalesce(lag(last) over (partition by doc_id order by i), 1) as opens from words) where opens = 1
), ends as (
  select doc_id, i, pos + length(word) as end_char from words where last = 1 or final
), joined as (
  select s.doc_id, s.pos::bigint as start_char, e.end_char::bigint as end_char, s.i as first_word, e.i as last_word
  from starts s asof join ends e on s.doc_id = e.doc_id and s.i + {PASSAGE_WORDS - 1} <= e.i
), listed as (
  select doc_id, list(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') order by i) as ws from words group by doc_id
), units as (
  select j.doc_id, start_char, end_char, md5(array_to_string(ws[first_word:last_word], ' ')) as passage_md5 from joined j join listed l on j.doc_id = l.doc_id
), firsts as (
  select *, first_value(doc_id) over w as keep_doc_id, first_value(start_char) over w as keep_start_char, row_number() over w as r
  from units window w as (partition by passage_md5 order by doc_id nulls first, start_char)
)
select doc_id, start_char, end_char, passage_md5, keep_doc_id, keep_start_char from firsts where r > 1
"""

OP7_SQL = f"""
with docs as (
  select row_number() over () as rid, doc_id, coalesce('h' || source, 'none') as host, coalesce(text, '') as body, {WORDS} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as raw
  from documents
), windows as (
  select rid, i, array_to_string(w[i:i+7], ' ') as gram from (select rid, w, unnest(range(1, len(w) - 6)) as i from docs where len(w) > 8)
), twice as (
  select rid, i, lead(i) over (partition by rid order by i) - i as gap from (select *, count(*) over (partition by rid, gram) as n from windows) where n > 1
), repeated as (
  select rid, sum(least(8, coalesce(gap, 8)))::bigint as n from twice group by rid
), lines as (
  select distinct rid, host, line from (
    select rid, host, unnest(list_transform(string_split(regexp_replace(lower(body), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' '))) as line from docs
  ) where line <> ''
), occurrences as (
  select host, body, line, count(*) as times from (
    select host, body, unnest(list_transform(string_split(regexp_replace(lower(body), '[\\x20\\x09\\x0B-\\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' '))) as line
    from (select distinct host, body from docs)
  ) where line <> '' group by all
), hosts as (select host, count(*) as host_docs from docs group by host),
frequent as (
  select host, line from (select host, line, count(*) as n from lines group by all) join hosts using (host)
  where n > {quality_rules.LINE_DOCS} and n > {quality_rules.LINE_SHARE} * host_docs
), kept_share as (
  select o.host, o.body, sum(case when f.line is null then o.times * octet_length(encode(o.line)) else 0 end) / sum(o.times * octet_length(encode(o.line))) as left_share
  from occurrences o left join frequent f on o.host = f.host and o.line = f.line group by all
), judged as (
  select doc_id, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars, len(regexp_extract_all(d.body, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(raw) - len(list_distinct(raw)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(k.left_share, 1) as left_share
  from docs d left join repeated r using (rid) left join kept_share k on d.host = k.host and d.body = k.body
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words as base_failed,
  not (n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words) and left_share >= {quality_rules.MIN_LEFT} as kept
from judged
"""

OP8_SQL = f"""
with docs as (
  select doc_id, case when source is null then 'b' else 'a' || source end as s, {KEY.format(seed="'23'")} as k, len({WORDS})::bigint as size from documents
), sources as (
  select s, sum(size)::bigint as source_size, [3, 1, 2][(row_number() over (order by s) - 1) % 3 + 1]::bigint as w from docs group by s
), capped as (
  select *, 2 * source_size as cap, (2 * source_size)::double / w as ratio from sources
), sums as (
  select *, coalesce(sum(cap) over before, 0) as caps, coalesce(sum(w) over before, 0) as used, sum(w) over () as all_w, 3 * sum(source_size) over () as budget
  from capped window before as (order by ratio, s rows between unbounded preceding and 1 preceding)
), dealt as (
  select *, budget - 2 * caps as above, 2 * (all_w - used) as under from sums
), level as (
  select ratio, s, above, under from dealt where above * w <= cap * under order by ratio, s limit 1
), goals as (
  select d.s, d.source_size, case when l.s is not null and (d.ratio > l.ratio or (d.ratio = l.ratio and d.s >= l.s)) then (l.above * d.w)::double / l.under::double else d.cap::double end as target
  from dealt d left join level l on true
), passes as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as n from goals
), placed as (
  select d.*, p.source_size, p.target, p.n, p.target - p.n * p.source_size as rest, coalesce(sum(size) over (partition by d.s order by k range between unbounded preceding and 1 preceding), 0) as before,
    sum(size) over (partition by d.s, k) as here
  from docs d join passes p on d.s = p.s
)
select doc_id, size, source_size, target, (size * (n + case when before + here <= rest or (before <= rest and 2 * (rest - before) >= here) then 1 else 0 end))::bigint as taken from placed
"""


OP11_SQL = f"""
with texts as (
  select doc_id, 0 as aim, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w, row_number() over () as rid from documents
  union all
  select null, 1, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), row_number() over () from benchmark
), grams as (
  select aim, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as gram from texts
), counted as materialized (
  select aim, rid, gram, count(*) as n from grams group by all
), hashed as materialized (
  select gram, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::bigint)),
    lambda a, x: xor(a >> 8, ({CRC_TABLE})[(xor(a, x) & 255) + 1])), 4294967295::bigint) % {importance.BUCKETS} as bucket
  from (select distinct gram, hex(encode(gram)) as hx from counted)
), sums as (
  select bucket, coalesce(sum(n) filter (aim = 0), 0) as s, coalesce(sum(n) filter (aim = 1), 0) as t from counted join hashed using (gram) group by bucket
), gains as (
  select bucket, floor(1000 * ln((t + 1)::double * ((sum(s) over ()) + {importance.BUCKETS})::double / ((s + 1)::double * ((sum(t) over ()) + {importance.BUCKETS})::double)))::bigint as gain from sums
), weights as (
  select rid, sum(n * gain)::bigint as weight, sum(n)::bigint as n_features from counted join hashed using (gram) join gains using (bucket) where aim = 0 group by rid
), scored as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296.0)))::bigint as score
  from texts left join weights using (rid) where aim = 0
), placed as (
  select *, row_number() over (partition by n_words >= {importance.MIN_WORDS} order by score desc, doc_id nulls first) as place, count(*) over (partition by n_words >= {importance.MIN_WORDS}) as n from scored
)
select doc_id, n_features, weight, score, case when n_words >= {importance.MIN_WORDS} and place <= n * {importance.PERCENT} // 100 then place end::bigint as rank from placed
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; the others are tested against brute force."""
    import corpus_pipeline

    found = {"op1_stratified_shards": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op6_repeated_lines": OP6_SQL, "op7_host_line_rules": OP7_SQL, "op8_source_mix": OP8_SQL, "op11_importance_resampling": OP11_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
