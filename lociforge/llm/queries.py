"""The corpus operators as queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fim, jaccard, mixing, multiindex, pieces, pii, pitmanyor, quality, sharding, topk, warc
from .common import scratch, table


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), n=3, percent=90).withColumnRenamed("id", "doc_id")


OP1_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (
  select doc_id, unnest(case when len(w) >= 3 then list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    when len(w) > 0 then [array_to_string(w, ' ')] else []::varchar[] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select x, y from i join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)),
r as (select doc_id as x, doc_id as y from documents union select r.x, l.y from r join l on l.x = r.y)
select d.doc_id, coalesce(max(n.n), 0)::bigint as n_shingles, min(r.y) as component_id, coalesce(max(k.c), 0)::bigint as n_links
from documents d left join n on n.doc_id = d.doc_id left join r on r.x = d.doc_id left join (select x, count(*) as c from l group by x) k on k.x = d.doc_id group by d.doc_id
"""


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The checksum is made at the scan, so that no text is moved for it.
    placed = sharding.shard_documents(docs.withColumn("text_crc32", F.crc32(F.encode("text", "utf-8"))), shards=8)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_rows(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = """
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select source, source_size, row_number() over (order by source nulls last) as i from s),
v as (select *, [5.0::double, 2.0::double, 1.0::double][((i - 1) % 3 + 1)::int] as wt from w),
c as (select *, 3.0::double * source_size as cap, (sum(source_size) over ())::double as total,
  (total - coalesce(sum(3.0::double * source_size) over (order by source_size / wt, i rows between unbounded preceding and 1 preceding), 0.0))
   / sum(wt) over (order by source_size / wt, i rows between current row and unbounded following) as share from v),
p as (select *, cap < share * wt as stop from c),
t as (select source, source_size, case when stop then cap else
   (total - sum(case when stop then cap else 0 end) over ()) / sum(case when stop then 0 else wt end) over () * wt end as target,
   ('0x' || substr(md5('0|' || coalesce('s' || source, 'null')), 1, 8))::bigint / 4294967296.0::double as u from p),
r as (select d.doc_id, d.size, t.source_size, t.target, t.u,
   case when t.source_size > 0 then t.target / t.source_size else 0.0 end as e,
   row_number() over (partition by d.source order by floor(ln(d.size + 1.0::double) * 8)::int, (('0x' || substr(md5(d.doc_id::varchar), 9, 6))::bigint) % 4096, d.size, d.doc_id) as k
   from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (least(floor(u + k * e) - floor(u + (k - 1) * e), 3) * size)::bigint as taken from r
"""


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    back = chat.read_back(chat.format_conversations(turns.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "utf-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "utf-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP4_SQL = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, (regexp_matches(text, '<<SYS>>|<</SYS>>|<s>|</s>|\\[/?INST\\]|\\[/?ROLE\\]|\\[SAYS\\]') or text like '%&amp;%' or text like '%&lt;%' or text like '%&lsqb;%') as odd,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') as esc,
    case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 19 + length(role) end as marks from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(marks + length(case when odd then esc else text end))::bigint as formatted_chars
from e group by conv_id
"""


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), verify=True).withColumnRenamed("id", "doc_id")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7
    scored = pitmanyor.score_documents(table(spark, sf_dir, "documents"), rest != 2)
    held = F.coalesce(F.crc32(F.encode(F.col("id").cast("string"), "utf-8")) % 7 == 2, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    found = warc.resolve(warc.captures(warc.read_warc(spark, path, payloads=False)))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b)::bigint as n, sha1(b) as h from p),
m as (select *, max(page_id) over (partition by h) as best from q)
select page_id, n as payload_bytes, h as payload_digest,
  case when n >= 1000 and page_id <> best then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> best then best end as refers_to from m
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9).withColumnRenamed("id", "vec_id")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *[count(kind) for kind in pii.KINDS],
        F.sha2(F.encode(told(F.filter("spans", lambda s: s.base)), "utf-8"), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"), unit="line", seed=7, rate=100, suffix_first=50)
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return made.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(fim.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP12_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id) as h from documents),
u as (select *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') as l, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
  ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, len(l)::bigint as n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) as a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) as b from u),
p as (select doc_id, t, n,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
  coalesce(array_to_string(l[1:a], ''), '') as x, coalesce(array_to_string(l[a + 1:b], ''), '') as y, coalesce(array_to_string(l[b + 1:], ''), '') as z from c)
select doc_id, n, form, case when form <> 'plain' then length(x)::bigint end as prefix_chars, case when form <> 'plain' then length(y)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""

QUERIES = {"op1_jaccard": op1_jaccard, "op2_shard": op2_shard, "op3_mix": op3_mix, "op4_chat": op4_chat, "op5_pieces": op5_pieces, "op6_lm": op6_lm, "op7_warc": op7_warc, "op8_quality": op8_quality, "op9_neardup": op9_neardup, "op10_topk": op10_topk, "op11_pii": op11_pii, "op12_fim": op12_fim}
ORACLE_SQL = {"op1_jaccard": OP1_SQL, "op3_mix": OP3_SQL, "op4_chat": OP4_SQL, "op7_warc": OP7_SQL, "op10_topk": OP10_SQL, "op12_fim": OP12_SQL}
