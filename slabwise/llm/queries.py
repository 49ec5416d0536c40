"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, decontam, langid, linededup, ngramjoin, packing, pii, quality, resample, topk, toxicity, urlfilter
from .common import held_out, table

QUERIES, ORACLES = {}, {}


def _query(name, sql=None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


@_query("op1_best_fit_packing")
def op1(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


#: The fixed rules (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_URL_SQL = """
with u as (select page_id,
                  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
           from pages),
r(rhost, rpath, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (select page_id, host, path, rhost || rpath as rule, verdict,
                row_number() over (partition by page_id, host, path order by length(rhost || rpath) desc, length(rhost) desc) as n
         from u join r on (u.host = r.rhost or ends_with(u.host, '.' || r.rhost)) and starts_with(u.path, r.rpath))
select u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from u left join fits f on f.page_id = u.page_id and f.host = u.host and f.path = u.path and f.n = 1
"""


@_query("op2_url_filter", _URL_SQL)
def op2(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules).drop("matched")


@_query("op3_pii")
def op3(spark, sf_dir):
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    return found.drop("tkey").withColumn("spans", pii.listed("spans"))


@_query("op4_toxicity")
def op4(spark, sf_dir):
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
        F.size("spans").alias("n_toxic_words"),
        F.to_json("spans").alias("spans"),
    )


@_query("op5_decontamination")
def op5(spark, sf_dir):
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op6_line_dedup", linededup.line_dedup_sql())
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return linededup.drop_boilerplate(docs).select("doc_id", "text", "lines_dropped")


_TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda e: cast(floor(256 * e::double) as bigint)) as q from embeddings
           where embedding is not null and vec_id is not null and list_bool_and(list_transform(embedding, lambda e: e is not null and isfinite(e)))),
s as (select a.vec_id as query_id, b.vec_id,
             cast(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) as bigint) as score
      from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
t as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from t where rank <= 5
"""


@_query("op7_exact_topk", _TOPK_SQL)
def op7(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


@_query("op8_quality")
def op8(spark, sf_dir):
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= quality.KEEP).cast("int")})


@_query("op9_ngram_jaccard_join")
def op9(spark, sf_dir):
    found = ngramjoin.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_links", "n_texts")


@_query("op10_language_id")
def op10(spark, sf_dir):
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Words of a text in DuckDB.
_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# crc32 of the distinct words goes through its table of 256 remainders; floors of means are taken on integers
_RESAMPLE_SQL = f"""
with recursive crc(i, step, c) as (
  select i, 0, i from range(256) r(i)
  union all
  select i, step + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from crc where step < 8),
crc_table as (select list(c order by i) as t from crc where step = 8),
d as (select row_number() over () as doc, doc_id, {_WORDS.format("text")} as words from documents),
dw as (select doc, unnest(words) as word from d),
bw as (select unnest({_WORDS.format("text")}) as word from benchmark),
vocabulary as (select distinct word from (select word from dw union all select word from bw)),
bytes as (select word, list_transform(range(octet_length(encode(word))), lambda i: cast('0x' || hex(encode(word))[2 * i + 1 : 2 * i + 2] as bigint)) as b from vocabulary),
hashed as (select word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, crc_table),
db as (select doc, bucket from dw join hashed using (word)),
s as (select bucket, count(*) as s from db group by bucket),
t as (select bucket, count(*) as t from bw join hashed using (word) group by bucket),
sums as (select (select count(*) from dw)::double as s_all, (select count(*) from bw)::double as t_all),
gain as (select bucket, cast(floor(1000 * ln((coalesce(t, 0)::double + 1) * (s_all + 10000) / ((s::double + 1) * (t_all + 10000)))) as bigint) as gain from s left join t using (bucket), sums),
total as (select doc, count(*) as n, cast(sum(gain) as bigint) as g from db join gain using (bucket) group by doc),
w as (select doc, doc_id, coalesce(n, 0) as n, coalesce((g - ((g % n) + n) % n) // n, 0) as weight,
             cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h
      from d left join total using (doc)),
scored as (select *, weight + cast(floor(-1000 * ln(-ln((h::double + 0.5) / 4294967296))) as bigint) as score from w),
ranked as (select doc, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n_long from scored where n >= 20)
select doc_id, cast(n as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
       case when rank <= 10 * n_long // 100 then rank end as rank
from scored left join ranked using (doc)
"""


@_query("op11_importance_resampling", _RESAMPLE_SQL)
def op11(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op12_adaptive_dimension_scan")
def op12(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
