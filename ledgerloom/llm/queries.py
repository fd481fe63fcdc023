"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, exact_dedup, fim, html_text, mixing, neighbours, packing, pii, quality, sharding, simhash, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(_table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(_table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


_OPS = (
    op1_quality,
    op2_mixing,
    op3_simhash,
    op4_packing,
    op5_neighbours,
    op6_pii,
    op7_toxicity,
    op8_token_counts,
    op9_exact_dedup,
    op10_html_text,
    op11_sharding,
    op12_fim,
    op13_centroids,
)
QUERIES = {f.__name__: f for f in _OPS}

#: Of the clustering: one round (assignment of all vectors, new centroids), {i} and {j} being its numbers.
_ROUND = """
a{j} as materialized (select v.k, v.x, arg_min(c.c, struct_pack(d := {d}, c := c.c)) c, min({d}) d from v, c{i} c group by v.k, v.x),
c{j} as materialized (select c.c, case when s.n is null then c.x else list_transform(s.x, lambda t: (t - ((t % s.n) + s.n) % s.n) // s.n) end x
  from c{i} c left join (select c, max(n)::bigint n, list(t order by j) x from (select c, j, count(*) n, sum(x[j])::bigint t from a{j}, (select unnest(range(1, 65)) j) group by c, j) group by c) s using (c))"""
_FAR = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"

ORACLES = {
    "op2_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
             ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint h from documents),
s as (select source, sum(size)::bigint source_size, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] w from d group by source),
r as (select *, 2 * source_size lim, sum(2 * source_size) over o cum_lim, sum(w) over o cum_w, sum(w) over () all_w, 1.5 * (sum(source_size) over ())::double budget
      from s window o as (order by 2 * source_size / w, source nulls last rows between unbounded preceding and current row)),
g as (select source, source_size, least(lim::double, (select max(x) from (
        select (budget - (cum_lim - lim)::double) / (all_w - (cum_w - w))::double x, lim / w q from r) where x <= q) * w) target from r),
b as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end base from g),
u as (select source, h, sum(size)::bigint words from d group by all),
c as (select u.*, b.target - b.base * b.source_size rest, sum(words) over (partition by u.source order by h) upto
      from u join b on u.source is not distinct from b.source),
t as (select source, min(case when upto > rest then h + case when upto - rest < rest - (upto - words) then 1 else 0 end end) theta from c group by source)
select d.doc_id, d.size, b.source_size, b.target,
       ((b.base + case when d.h < coalesce(t.theta, 1152921504606846976) then 1 else 0 end) * d.size)::bigint taken
from d join b on d.source is not distinct from b.source join t on d.source is not distinct from t.source
""",
    "op6_pii": r"""
with d as (select doc_id, coalesce(text, '') t from documents),
k as (select * from (values (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'), (4, 'iban', '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}'),
  (5, 'ssn', '[0-9]{3}-[0-9]{2}-[0-9]{4}')) v(r, kind, p)),
m as (select doc_id, r, kind, regexp_extract_all(t, p) ms, string_split_regex(t, p) gs from d, k where regexp_matches(t, p)),
e as (select doc_id, r, kind, ms, gs, unnest(range(1, len(ms) + 1)) i from m),
s as (select doc_id, r, kind, ms[i] m, gs[i] g,
        (list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint a from e),
x as (select *, a + length(m) b, regexp_replace(m, '[^0-9]', '', 'g') n, substr(m, 5) || substr(m, 1, 4) mv, lower(right(g, 40)) before from s),
f as (select * from x where case kind
  when 'email' then true
  when 'ip' then len(list_filter(string_split(m, '.'), lambda q: length(ltrim(q, '0')) > 3 or coalesce(try_cast(substr(ltrim(q, '0'), 1, 3) as int), 0) > 255)) = 0
  when 'card' then length(n) between 12 and 19 and list_sum(list_transform(range(1, length(n) + 1), lambda j:
    case when j % 2 = 1 then n[-j]::int when n[-j]::int * 2 > 9 then n[-j]::int * 2 - 9 else n[-j]::int * 2 end)) % 10 = 0
  when 'phone' then length(n) between 9 and 15
  when 'iban' then list_reduce(list_prepend(0, list_transform(string_split(mv, ''), lambda c: case when c between '0' and '9' then ord(c) - 48 else ord(c) - 55 end)),
    lambda acc, v: (acc * (case when v > 9 then 100 else 10 end) + v) % 97) = 1
  else regexp_matches(before, 'ssn|social security') end),
j as (select doc_id, count(*) filter (kind = 'email') n_email, count(*) filter (kind = 'ip') n_ip, count(*) filter (kind = 'card') n_card, count(*) filter (kind = 'phone') n_phone,
  string_agg(kind || ':' || a || ':' || b, ',' order by a, r) filter (r < 4) base, string_agg(kind || ':' || a || ':' || b, ',' order by a, r) spans from f group by doc_id)
select d.doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone,
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join j using (doc_id)
""",
    "op9_exact_dedup": r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) text_sha256 from documents)
select doc_id, min(doc_id) over w keep_id, (count(*) over w)::bigint group_size, doc_id = min(doc_id) over w kept, text_sha256
from d window w as (partition by text_sha256)
""",
    "op12_fim": r"""
with d as (select doc_id, coalesce(text, '') t, sha256('42:' || coalesce(doc_id::varchar, '')) h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') u from documents),
n as (select *, len(u)::bigint n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) hs from d),
k as (select *, least(hs[1] % (n + 1), hs[2] % (n + 1)) lo, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) hi,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or hs[3] % 100 >= 50 then 'plain' when hs[4] % 100 < 80 then 'spm' else 'psm' end form from n),
p as (select *, array_to_string(u[1:lo], '') a, array_to_string(u[lo + 1:hi], '') m, array_to_string(u[hi + 1:], '') b from k)
select doc_id, n, form, case when form <> 'plain' then length(a) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || b || '<M>' || m else '<S>' || b || '<P>' || a || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from p
""",
    "op13_centroids": """
with v as materialized (select row_number() over () k, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), x) - 1 c, x from v where vec_id is not null order by c limit 40),"""
    + ",".join(_ROUND.format(i=i, j=i + 1, d=_FAR) for i in range(6))
    + """,
i as (select c, sum(d)::bigint n from a6 group by c)
select v.vec_id, a.c::int as "cluster", a.d distance, i.n cluster_inertia, (select sum(d) from a6)::bigint inertia, sha256(array_to_string(c.x, ',')) centroid_sha256
from a6 a join v using (k) join c5 c on a.c = c.c join i on a.c = i.c
""",
}
