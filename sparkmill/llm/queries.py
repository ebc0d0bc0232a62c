"""The queries of the training-data operators: thin digests of what each operator returns for whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm import bestfit_packing, bytelevel_bpe, conversation_trie, exact_dedup, importance, ngram_join, pii, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, toxicity, url_filters
from sparkmill.llm.common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the removed runs, and the text that stays (a character that a run cuts reads as U+FFFD)."""
    found = suffix_dedup.remove(documents(spark, sf_dir), length=400, keep="none", kept_text=True)
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filters.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_classifier.score(docs, quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.build(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_bytelevel_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytelevel_bpe.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_ngram_join, op4_sentencepiece, op5_exact_dedup, op6_quality_rules, op7_url_filters, op8_quality_classifier, op9_bestfit_packing, op10_pii, op11_prefix_trie, op12_importance, op13_bytelevel_bpe)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PATH = "case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end"

# CRC-32 by its table of 256 entries, over a list of bytes: the CTE names `steps` (table) and the expression of a list.
_STEPS = f"steps as (select {'list_transform(' * 8}range(256){', lambda c: xor(c >> 1, (c & 1) * 3988292384))' * 8} as t)"
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, {}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint)"

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
        with n as (select doc_id, length(coalesce(text, '')) as size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
        select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size, first_value(doc_id) over w = doc_id as kept, sha256(norm) as text_sha256
        from n window w as (partition by norm order by size desc, doc_id)""",
    "op6_quality_rules": rf"""
        with w as (select doc_id, coalesce(text, '') as t, {_WORDS} as words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from documents),
        tri as (select doc_id, unnest(range(1, len(words) - 1)) as i, words from w where len(words) >= 3),
        win as (select doc_id, i, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] as x from tri),
        twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, x) > 1),
        rep as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from twice) group by doc_id),
        m as (select w.doc_id, len(words) as n_words, length(array_to_string(words, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
              len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, len(lines) as n_lines,
              len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) as n_upper, len(regexp_extract_all(t, '!!')) as n_shouts,
              len(list_filter(regexp_extract_all(regexp_replace(t, '[\x20\n]', '\0\0', 'g'), '[\x20\n][^\x20\n]+[\x20\n]'), lambda s: substr(s, 2, length(s) - 2) in ({", ".join(f"'{x}'" for x in sorted(set(quality_rules.STOP_WORDS)))}))) as n_stop
              from w left join rep using (doc_id)),
        v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          not base_failed and word_chars / n_words between 2 and 30 and n_symbols / n_words <= 0.2 and n_stop / n_words >= 0.01
          and n_dup_lines / n_lines <= 0.5 and n_upper / word_chars <= 0.5 and n_shouts / n_words <= 0.3 and n_words / n_lines >= 1 as kept from v""",
    "op7_url_filters": rf"""
        with a as (select page_id, {_PATH} as rest from pages),
        b as (select page_id, lower(regexp_extract(rest, '^[^/?#]*')) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
        r(action, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        best as (select page_id, h || p as rule, action from b join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) qualify row_number() over (partition by page_id order by length(h || p) desc) = 1)
        select page_id, host, path, rule, coalesce(action, case when regexp_matches(host || path, '(^|[./-])(spam|link)-farm[./]|[./-](casino|porn|warez)[./-]') then 'block' else 'allow' end) as verdict from b left join best using (page_id)""",
    "op11_prefix_trie": rf"""
        with {_STEPS},
        turns as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as k from conversations where conv_id is not null),
        convs as (select c, c - c % 100 as s, {_CRC.format("list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)")} % 6 as h from (select distinct c from turns), steps),
        pieces as (select convs.c, 0 as own, turns.k, role, text from convs join turns on turns.c = s and k <= h union all select convs.c, 1, k, role, text from convs join turns using (c) where k > h),
        seqs as (select c, list(sha256(strlen(role) || ':' || role || text) order by own, k) as q, list(length(text) order by own, k) as sizes from pieces group by c),
        whole as (select c, coalesce(q, []) as q, coalesce(sizes, []) as sizes from convs left join seqs using (c)),
        pre as (select c, q[1:d] as q, d, coalesce(sizes[d], 0) as size, d = len(q) as last from (select c, q, sizes, unnest(range(0, len(q) + 1)) as d from whole)),
        nodes as (select q, min(d) as d, min(c) as conv, count(*) as n, min(size) as size, coalesce(string_agg(c::varchar, ',' order by c) filter (last), '') as ends from pre group by q),
        kids as (select q[1:d - 1] as q, count(*) as k from nodes where d > 0 group by 1),
        full_ as (select nodes.*, coalesce(kids.k, 0) as k from nodes left join kids using (q)),
        below as (select q[1:a] as q, sum((k = 0)::bigint) as leaves, sum((n - 1) * size) as saved from (select *, unnest(range(0, d + 1)) as a from full_) group by 1)
        select f.conv as conv_id, f.d as depth, p.conv as parent_conv_id, f.n as n_convs, f.k as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(f.ends) as ends_sha256
        from full_ f join below using (q) left join nodes p on f.d > 0 and p.q = f.q[1:f.d - 1]""",
    "op12_importance": rf"""
        with {_STEPS},
        texts as (select 0 as side, doc_id, {_FEATURES} as words from documents union all select 1, item_id, {_FEATURES} from benchmark),
        seen as (select distinct unnest(words) as w from texts),
        hashed as (select w, {_CRC.format("list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::bigint)")} % 10000 as bucket from seen, steps),
        used as (select side, doc_id, bucket from (select side, doc_id, unnest(words) as w from texts) join hashed using (w)),
        totals as (select count(*) filter (side = 0) as ns, count(*) filter (side = 1) as nt from used),
        counts as (select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t from used group by bucket),
        gain as (select bucket, floor(1000 * ln(((t + 1)::double * (ns + 10000)::double) / ((s + 1)::double * (nt + 10000)::double)))::bigint as g from counts, totals),
        weights as (select doc_id, sum(g)::bigint as weight from used join gain using (bucket) where side = 0 group by doc_id),
        scored as (select doc_id, len(words) as n_features, coalesce(weight, 0) as weight,
          coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score from texts left join weights using (doc_id) where side = 0),
        ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r from scored where n_features >= 20)
        select doc_id, n_features, weight, score, case when r <= (select count(*) * 10 // 100 from ranked) then r end as rank from scored left join ranked using (doc_id)""",
}
