"""Further queries, of landed files, views and display, in the catalogue's way; QUERIES and ORACLES are those of both modules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import values as vl
from ..operators import agenda, blocks, evaluation, evidence, graph, ranking, statements, tables, validation, views
from ..session import table
from ..sources import landed, sinks
from .catalogue import _FOLD, _RECORDS, _TRADE, _TURNS, ORACLES, QUERIES, _chain, _geo, _records, _trade, _turns, query
from .rounds import shared_dir

__all__ = ["ORACLES", "QUERIES"]


def _landing(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"


def _name(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


@query("""select o_orderstatus publisher, count(*) n, min((o_orderdate::date)::varchar) first_day from orders group by 1""")
def landed_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as manifests that have landed as arrays of JSON, read back with their row checks."""
    path, day = _landing(spark, "manifest"), F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = table(spark, sf, "orders").select(F.concat(F.lit("https://x.org/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("url"), _name("order ", "o_orderkey").alias("title"), F.col("o_orderstatus").alias("publisher"), day.alias("published_at"))
    arrays = rows.groupBy(F.floor(F.regexp_extract("title", r"\d+", 0).cast("long") / 5000).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    read = landed.checked_manifest(landed.read_json(spark, path, landed.MANIFEST), "2002-01-01").where(vl.within("published_at", "2002-01-01"))
    return read.groupBy("publisher").agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("first_day"))


@query(r"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') ls from documents)
select doc_id page_id, length(array_to_string(ls, chr(10)))::bigint n_chars, sha256(array_to_string(ls, chr(10))) sha256, case doc_id % 4 when 0 then '2024-03-01' when 1 then '2024-02-01' when 2 then '2024-02-29' end published from l""")
def published_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as pages with menus, scripts and dates, read back as text with the earliest valid date."""
    k = F.col("doc_id")
    meta = F.when(k % 4 == 0, '<meta property="article:published_time" content="2024-03-01T08:00:00Z">').when(k % 4 == 1, '<meta content="2024-02-01" property="article:modified_time"><time datetime="2024-05-05">May</time>').when(k % 4 == 2, "<time datetime='2024-02-29T00:00'>then</time><meta property='article:published_time' content='soon'>").otherwise('<meta property="og:title" content="2020-01-01">')
    body = F.regexp_replace(tx.escape_html("text"), "\n", "</p>\n<p>")
    page = F.concat(F.lit("<html><head>"), F.regexp_replace(meta, ">(May|then)</time>", "></time>"), F.lit("<script>var a = '<p>no</p>';</script><style>p { }</style></head><body><nav><div>Menu</div></nav><p>"), body, F.lit("</p><footer><p>Foot</p></footer></body></html>"))
    read = landed.page_text(table(spark, sf, "documents").select(k.alias("page_id"), page.alias("html")))
    return read.select("page_id", F.length("text").cast("long").alias("n_chars"), tx.sha256("text").alias("sha256"), "published")


@query("""with w as (select o_orderkey k, 'm' || o_orderkey % 3 model, sha256(o_orderkey::varchar) digest from orders), c as (select *, k % 5 <> 1 stop, k % 4 <> 2 and k % 6 <> 5 landed from w)
select case when stop and landed then 'reused' else 'wanted' end fate, count(*) n from c group by 1""")
def reused_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that have landed for orders, some cut off and some missing: which are used again and which are asked for."""
    k = F.col("o_orderkey")
    asked = [_m(k).alias("model"), tx.sha256(k.cast("string")).alias("digest")]
    wanted = table(spark, sf, "orders").select(*asked, F.array(k, k + 1).alias("source_ids"))
    answers = table(spark, sf, "orders").where("o_orderkey % 4 <> 2").select(*asked, F.when(k % 6 == 5, F.array(k)).otherwise(F.array(k, k + 1)).alias("source_ids"), F.when(k % 5 == 1, "length").otherwise("stop").alias("finish_reason"))
    good, missing = landed.reusable(answers, wanted)
    count = lambda rows, fate: rows.groupBy(F.lit(fate).alias("fate")).agg(F.count(F.lit(1)).alias("n"))
    return count(good, "reused").union(count(missing, "wanted"))


def _m(k):
    return F.concat(F.lit("m"), (k % 3).cast("string"))


@query("""with h as (select c_custkey k, c_nationkey q, row_number() over (partition by c_nationkey order by c_custkey) place from customer), f as (select * from h where k % 3 <> 1 and k % 5 <> 2 and k % 7 <> 3),
t as (select *, row_number() over (partition by q order by place) n from f)
select q query, place::int place, 'https://www.sse.com.cn/2024-0' || (k % 4 + 1) || '/2024-0' || (k % 4 + 1) || '-10/' || k || '.pdf' url from t where n <= 3 order by q, place limit 4""")
def gap_search_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Landed hits of a search for each nation: some seen before, some no official file, some later than the report."""
    k = F.col("c_custkey")
    month = F.concat(F.lit("2024-0"), (k % 4 + 1).cast("string"))
    late = F.when(k % 7 == 3, "2025-01-10").otherwise(F.concat(month, F.lit("-10")))
    url = F.concat(F.lit("https://"), F.when(k % 5 == 2, "other.org").otherwise("www.sse.com.cn"), F.lit("/"), month, F.lit("/"), late, F.lit("/"), k.cast("string"), F.lit(".pdf"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("query"), place.alias("place"), F.when(k % 2 == 0, url).alias("url"), F.when(k % 2 == 1, url).alias("link"), k.alias("k"))
    hits = landed.search_hits(rows)
    seen = hits.where("k % 3 = 1").select("url")
    return agenda.gap_hits(hits.select("query", "place", "url"), seen, ["sse.com.cn"], "2024-12-31").select("query", "place", "url")


@query("""with s as (select l_partkey chunk_id, l_suppkey question_id, sum(l_quantity::decimal(12,2)) score from lineitem group by 1, 2), r as (select *, row_number() over (partition by question_id order by score desc, chunk_id) n from s),
w as (select chunk_id, coalesce(sum(score) filter (n <= 2), max(score))::double weight from r group by 1)
select chunk_id, weight from w order by weight desc, chunk_id limit 20""")
def selected_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as chunks and suppliers as questions, which nominate their two best; the best twenty."""
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("question_id"), F.col("l_partkey").alias("chunk_id")).agg(F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("score"))
    return ranking.select_chunks(scores, 20).select("chunk_id", F.col("weight").cast("double").alias("weight"))


@query(_FOLD.format(most=2800) + r""",
n as (select doc_id, block, trim(regexp_replace(regexp_replace(raw, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g')) t from b),
v as (select doc_id, block, string_split(list_reduce(string_split(t, chr(10)), lambda a, x: case when length(string_split(a, chr(30))[-1]) + 1 + length(x) > 900 then a || chr(30) || x else a || chr(10) || x end), chr(30)) vs from n)
select doc_id, block::int block, unnest(range(1, len(vs) + 1))::int "view", len(vs)::int views, sha256(unnest(vs)) sha256 from v""")
def extraction_views(spark: SparkSession, sf: str) -> DataFrame:
    """The views of all source blocks, of 900 characters."""
    rows = blocks.source_blocks(table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text"))
    return blocks.extraction_views(rows, 900).select("doc_id", "block", "view", "views", tx.sha256("view_text").alias("sha256"))


@query(_FOLD.format(most=2800) + r""",
n as (select doc_id, block, trim(regexp_replace(regexp_replace(raw, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g')) t from b), k as (select *, string_split(t, chr(10)) ls from n),
o as (select *, case when len(ls) >= 2 and len(list_filter(ls, lambda s: len(regexp_extract_all(s, '[-+]?\d[\d,.]*(?:%|倍|元|亿|万)?')) >= 2)) >= greatest(1, len(ls) // 3) then 'table_like' else 'paragraph' end ty from k)
select doc_id, sha256(string_agg(format('[SOURCE_OBJECT id=SO_P001_B{:03d} page=1 type=', block) || ty || ']' || chr(10) || t, chr(10) || chr(10) order by block)) sha256 from o group by doc_id""")
def rendered_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks of every document, each under its header."""
    rows = blocks.source_blocks(table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text"))
    return blocks.render_chunk(rows, "doc_id").select("doc_id", tx.sha256("rendered").alias("sha256"))


@query(_TRADE + """, sp as (select p_brand spec_id, p_size % 2 = 0 even from part group by all), a as (select distinct s.p_brand spec_id, 's' || s_suppkey id from supplier, part s where s_nationkey = p_size % 25),
m as (select p_brand spec_id, 'p' || p_partkey id from part), r as (select a.spec_id, count(distinct source_id || '-' || target_id) n from tr join a on a.id = source_id join m on m.id = target_id and m.spec_id = a.spec_id where tr.n > 0 group by 1),
b as (select distinct p_brand spec_id from part)
select 'relations' category, count(*) filter (r.n > 0) passed, count(*) total, round_even(count(*) filter (r.n > 0) / count(*), 6) recall from b left join r using (spec_id)""")
def relation_recall(spark: SparkSession, sf: str) -> DataFrame:
    """A specification for each brand: a trade from suppliers of certain nations to parts of the brand."""
    parts = table(spark, sf, "part")
    specs = parts.select(F.col("p_brand").alias("spec_id")).distinct().withColumn("edge_types", F.array(F.lit("SUPPORTS"), F.lit("CAUSES"))).withColumn("category", F.lit("relations"))
    nations = parts.select(F.col("p_brand").alias("spec_id"), (F.col("p_size") % 25).alias("s_nationkey")).distinct()
    sources = table(spark, sf, "supplier").join(nations, "s_nationkey").select("spec_id", _name("s", "s_suppkey").alias("id"))
    targets = parts.select(F.col("p_brand").alias("spec_id"), _name("p", "p_partkey").alias("id"))
    edges = _trade(spark, sf).select(F.concat_ws("-", "source_id", "target_id").alias("id"), "source_id", "target_id", "edge_type", F.lit("active").alias("status"))
    return evaluation.recall(evaluation.verdicts(specs, evaluation.match_relations(edges, sources, targets, specs)))


@query(_TURNS + """, k as (select id from t where turn = 0 and conv_id % 3 = 0), h1 as (select target_id id from ch where source_id in (select id from k)), h2 as (select target_id id from ch where source_id in (select id from h1)),
n as (select id from k union select id from h1 union select id from h2)
select source_id, target_id from ch where source_id in (select id from n) and target_id in (select id from n)""")
def thesis_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of the viewer's thesis mode: core claims are the first turns of every third conversation."""
    core = F.when((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0), "core").otherwise("supporting")
    nodes = _turns(spark, sf).select("id", F.lit("Claim").alias("node_type"), core.alias("importance"), F.lit(False).alias("benchmarked"))
    return views.mode(nodes, _chain(spark, sf), "thesis")[1].select("source_id", "target_id")


@query("""with own as (select distinct 'p' || l_partkey node_id, l_orderkey source_id, l_returnflag quote from lineitem), ev as (select 's' || l_suppkey a, 'p' || l_partkey b, l_orderkey source_id, l_linestatus quote from lineitem),
every as (select * from own union select a, source_id, quote from ev union select b, source_id, quote from ev)
select node_id, count(*) n from every group by 1""")
def node_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of parts and suppliers: their own lines and those of their trade, once for each order and flag."""
    lines = table(spark, sf, "lineitem")
    own = lines.select(_name("p", "l_partkey").alias("node_id"), F.col("l_orderkey").alias("source_id"), F.col("l_returnflag").alias("quote"))
    at = lambda c: lines.select(c.alias("node_id"), F.col("l_orderkey").alias("source_id"), F.col("l_linestatus").alias("quote"))
    rows = views.node_evidence(own, at(_name("s", "l_suppkey")).union(at(_name("p", "l_partkey"))))
    return rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("""with n as (select p_size page, p_partkey id, p_partkey % 11 = 5 opaque, p_partkey % 13 c, p_partkey seq from part)
select page, id source_id from (select *, row_number() over (partition by page order by opaque desc, case when opaque then 0 else -c end, seq) k from n) where k = 1""")
def page_sources(spark: SparkSession, sf: str) -> DataFrame:
    """The source shown for each page: parts are sources, their sizes pages."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.col("p_size").alias("page"), k.alias("source_id"), F.when(k % 11 == 5, "OPAQUE").otherwise("EXTRACTED").alias("processing_status"), (k % 13).alias("candidate_count"), k.alias("sequence"))
    return views.page_source(rows).select("page", "source_id")


@query("""with e as (select l_orderkey evidence_id, l_suppkey source_id, l_linenumber seq from lineitem)
select evidence_id, source_id from (select *, row_number() over (partition by evidence_id order by seq, source_id) n from e) where n = 1""")
def first_citations(spark: SparkSession, sf: str) -> DataFrame:
    """The source that each order, as a piece of evidence, is cited from."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("seq"))
    return evidence.citation(rows).select("evidence_id", "source_id")


@query("""select l_suppkey source_id, l_partkey node_id, (row_number() over (partition by l_suppkey order by l_partkey))::int place from (select distinct l_suppkey, l_partkey from lineitem)""")
def source_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The parts that each supplier, as a source, is evidence of."""
    return views.nodes_of_sources(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("node_id"))).select("source_id", "node_id", "place")


@query("""with c as (select conv_id g, turn, conv_id || ':' || turn id, turn % 2 = 0 core, ['risk', 'forecast', 'interpretation', 'other'][conv_id % 4 + 1] r from conversations),
x as (select * from c where (core and r in ('forecast', 'interpretation')) or r = 'risk'), y as (select * from x union all select * from c where g not in (select g from x))
select id, ((row_number() over (partition by g order by turn, id) - 1) // 4 + 1)::bigint batch from y""")
def cross_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as claims: the targets of relations across chunks, in batches of four."""
    role = F.element_at(F.array(*map(F.lit, ("risk", "forecast", "interpretation", "other"))), (F.col("conv_id") % 4 + 1).cast("int"))
    claims = _turns(spark, sf).select(F.col("conv_id").alias("graph_id"), F.col("turn").alias("seq"), "id", F.when(F.col("turn") % 2 == 0, "core").otherwise("other").alias("importance"), role.alias("claim_role"))
    return views.cross_targets(claims, ["forecast", "interpretation"]).select("id", "batch")


@query("""with s as (select s_suppkey k, s_nationkey n from supplier), c as (select c_custkey k, c_nationkey n from customer)
select 'edge type' code, count(*) n from (select 1 from s union all select 1 from nation) union all select 'not traceable', count(*) from s where k % 3 = 0 having count(*) > 0
union all select 'span without claim', count(*) from c where k % 5 = 0 union all select 'span of a claim that does not hold', count(*) from c where k % 5 <> 0 and (k % (select count(*) from s)) % 3 = 0""")
def agenda_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as propositions, two thirds of which hold, and customers as report spans on them."""
    nodes, edges = _geo(spark, sf)
    edges = edges.where("edge_type <> 'IN_SECTION'")
    suppliers = table(spark, sf, "supplier")
    n = suppliers.agg(F.count(F.lit(1)).alias("n"))
    props = nodes.where("node_type = 'Proposition'").withColumn("status", F.lit("reportable"))
    spans = table(spark, sf, "customer").select(_name("x", "c_custkey").alias("id"), F.lit("ReportSpan").alias("node_type"), F.lit(None).cast("string").alias("status"))
    rest = nodes.where("node_type <> 'Proposition'").withColumn("status", F.lit(None).cast("string"))
    says = table(spark, sf, "customer").where("c_custkey % 5 <> 0").join(F.broadcast(n)).select(_name("x", "c_custkey").alias("source_id"), F.lit("EXPRESSES").alias("edge_type"), F.concat(F.lit("s"), (F.col("c_custkey") % F.col("n")).cast("string")).alias("target_id"))
    held = suppliers.where("s_suppkey % 3 <> 0").select(_name("s", "s_suppkey").alias("id"))
    found = agenda.graph_errors(props.unionByName(spans).unionByName(rest), edges.unionByName(says), held)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(r"""with e as (select event_id, round("value", 2)::decimal(18,2) v, case event_id % 4 when 0 then 'CNY' when 1 then 'CNY/share' when 2 then '%' else 'GB' end u, ([1, 1000, 1000000, 100000000])[event_id % 4 + 1] f from events),
x as (select event_id, u, case when u = 'CNY' then v * 10000 * (event_id % 3 * 5000 + 1) else v end y, v from e)
select event_id, case u when 'CNY' then case when abs(y) >= 100000000 then round_even(y / 100000000, 2)::decimal(38,2) || '亿元' when abs(y) >= 10000 then round_even(y / 10000, 2)::decimal(38,2) || '万元' else round_even(y, 2)::decimal(38,2) || '元' end
  when 'CNY/share' then y::decimal(38,2) || '元/股' when '%' then y::decimal(38,2) || '%' else y || 'GB' end display, least(greatest(v::double / 50, 0), 1) clamped, (v * 100)::double base from x""")
def display_values(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as numbers of four units: displayed, clamped and scaled."""
    k = F.col("event_id")
    v = vl.rounded(F.col("value")).cast("decimal(18,2)")
    unit = F.element_at(F.array(*map(F.lit, ("CNY", "CNY/share", "%", "GB"))), (k % 4 + 1).cast("int"))
    y = F.when(unit == "CNY", v * 10000 * (k % 3 * 5000 + 1).cast("decimal(10,0)")).otherwise(v).cast("decimal(30,2)")
    rows = table(spark, sf, "events").select("event_id", unit.alias("u"), y.alias("y"), v.alias("v"))
    return rows.select("event_id", vl.display_number("y", F.col("u"), double=True).alias("display"), vl.clamp(F.col("v").cast("double") / 50).alias("clamped"), vl.base_value(F.lit("100"), F.col("v").cast("string")).cast("double").alias("base"))


@query("""select o_orderstatus stage, count(*) calls, sum(o_orderkey % 100)::bigint "seconds", sum(case when o_orderkey % 3 <> 0 then o_custkey else 0 end)::bigint tokens from orders group by 1""")
def call_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as calls of runs, their status as stage, some without a token count."""
    return agenda.call_totals(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("stage"), (F.col("o_orderkey") % 100).alias("seconds"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("tokens")))


@query("""select s_suppkey code, 'org' || s_suppkey org, (select count(*) from customer where c_custkey <= 100) listed from supplier where 's' || s_suppkey = 's7'""")
def directory_match(spark: SparkSession, sf: str) -> DataFrame:
    """The one supplier of a code, and how many of the first customers were listed in time."""
    directory = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), _name("org", "s_suppkey").alias("org"))
    listed = agenda.listed(table(spark, sf, "customer").where("c_custkey <= 100").select(F.col("c_custkey").alias("id"), F.lit("1999-01-01").cast("date").alias("listed_on")), "2000-01-01")
    return landed.unique_match(directory, _name("s", "code") == "s7").join(F.broadcast(listed.agg(F.count("id").alias("listed"))))


@query("""select '1 Nodes' section, '- ' || node_type || ': ' || count(*) line from (select 'Section' node_type from nation union all select 'Source' from region union all select 'Proposition' from supplier union all select 'Question' from customer) group by node_type
union all select '2 Edges', '- ' || t || ': ' || count(*) from (select 'ABOUT' t from supplier union all select 'IN_SECTION' from customer union all select 'CONTAINS' from nation) group by t
union all select '3 Rejected', '- ' || o_orderstatus || ': ' || count(*) from orders group by o_orderstatus""")
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _geo(spark, sf)
    return sinks.summary(nodes, edges, table(spark, sf, "orders").select(F.col("o_orderstatus").alias("reason")))


@query("""with e as (select distinct 's' || l_suppkey a, 'p' || l_partkey b from lineitem where l_returnflag = 'R') select 'PREMISE_OF' edge_type, count(*) n from e union all select 'CONCLUDES', count(*) from e""")
def reasoning_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The two edges of a reasoning step for each relation that was admitted."""
    rel = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(_name("s", "l_suppkey").alias("source_id"), F.lit("SUPPORTS").alias("edge_type"), _name("p", "l_partkey").alias("target_id")).distinct()
    return graph.reasoning_steps(rel).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("""with n as (select 's' || s_suppkey id, 'Entity' node_type, case s_suppkey % 3 when 0 then 'core' when 1 then 'supporting' end importance from supplier union all select 'p' || p_partkey, 'Metric', case p_partkey % 3 when 0 then 'core' when 1 then 'supporting' end from part),
h as (select *, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(id, ''), lambda c: ord(c)::bigint)), lambda a, c: (xor(a, c) * 16777619) & 4294967295) h from n)
select id, (row_number() over (partition by node_type order by case importance when 'core' then 0 when 'supporting' then 1 else 2 end, h, id))::int place from h""")
def layout_order(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts in the order in which the viewer lays them out."""
    weight = lambda c: F.when(F.col(c) % 3 == 0, "core").when(F.col(c) % 3 == 1, "supporting").alias("importance")
    nodes = table(spark, sf, "supplier").select(_name("s", "s_suppkey").alias("id"), F.lit("Entity").alias("node_type"), weight("s_suppkey"))
    nodes = nodes.union(table(spark, sf, "part").select(_name("p", "p_partkey"), F.lit("Metric"), weight("p_partkey")))
    return views.layout_order(nodes).select("id", "place")


@query("""select o_orderkey, '{"document":{"id":' || o_custkey || '},"edges":' || case when o_orderkey % 3 = 0 then '[]' else '[' || o_orderkey || ']' end || ',"graph_id":' || case when o_orderkey % 2 = 0 then 'null' else '"g"' end || ',"nodes":[],"schema_version":"v1","source_objects":[{"a":1,"b":2}]}' payload from orders""")
def state_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as graph documents: what of them is state, whatever else they hold and in whatever order."""
    k = F.col("o_orderkey")
    parts = [F.lit('{"source_objects":[{"b":2,"a":1}],"extraction_run":{"x":1},"schema_version":"v1"'), F.when(k % 2 == 1, ',"graph_id":"g"').otherwise(""), F.when(k % 3 != 0, F.concat(F.lit(',"edges":['), k.cast("string"), F.lit("]"))).otherwise(""), F.lit(',"document":{"id":'), F.col("o_custkey").cast("string"), F.lit('},"state_hash":"h"}')]
    return table(spark, sf, "orders").select("o_orderkey", validation.state_payload(F.concat(*parts)).alias("payload"))


@query("""with p as (select event_id id, user_id, event_type, ts::date d, round("value")::bigint v from events where "value" is not null), x as (select user_id, event_type, d from p group by all having min(v) < max(v))
select id, event_type metric, d::varchar period_end from p join x using (user_id, event_type, d)""")
def conflict_members(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as facts on a day: those that give one kind different values."""
    value = F.round("value").cast("long").cast("string").alias("value")
    fixed = [F.lit(v).alias(c) for c, v in (("kind", "fact"), ("scope", "day"), ("unit", "CNY"))]
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("metric"), F.to_date("ts").cast("string").alias("period_end"), value, *fixed)
    return statements.conflict_members(rows).select("id", "metric", "period_end")


@query("""with b as (select user_id, ts, round("value", 2)::decimal(18,2) v from events where "value" is not null and ts < timestamp '2024-01-19 16:00:00' and ts >= timestamp '2024-01-19 16:00:00' - interval 60 day),
r as (select *, row_number() over (partition by user_id order by date_trunc('millisecond', ts) desc, v) n from b)
select user_id::varchar entity, v::double "value", v || '元/股' display, (ts + interval 8 hour)::date::varchar period_end from r where n = 1""")
def last_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of every user before the end of a Shanghai day, as a price."""
    bars = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("entity"), F.unix_millis(F.col("ts").cast("timestamp")).alias("date_ms"), F.round("value", 2).cast("decimal(18,2)").cast("string").alias("close_price"))
    return statements.prices(bars, "2024-01-19")[0].select("entity", F.col("value").cast("double").alias("value"), "display", "period_end")


@query(_RECORDS + r""", y as (select entity, "year", sum(volume)::bigint v from rec group by 1, 2), x as (select *, row_number() over (partition by entity order by "year") n, count(*) over (partition by entity) c from y),
p as (select entity, ("year" + 25) || 'E' period, v::varchar raw from x where n <= 5 and c >= 5),
i as (select *, 'ENT_' || upper(substr(sha256('company' || chr(31) || lower(entity)), 1, 16)) ent, 'MET_' || upper(substr(sha256('营业收入'), 1, 16)) met, 'PER_' || upper(substr(sha256(lower(period)), 1, 16)) per from p)
select 'DATA_' || upper(substr(sha256(concat_ws(chr(31), ent, met, per, 'scalar', raw, raw, 'None', 'None', 'forecast')), 1, 16)) id, '营业收入 ' || period || ' = ' || raw "label", 3::bigint mentions, 3::bigint evidence from i""")
def periodic_points(spark: SparkSession, sf: str) -> DataFrame:
    """Year tables of nations, each in two documents and twice in one of them, as nodes with merged evidence."""
    years = _records(spark, sf).groupBy("entity", "year").agg(F.sum("volume").cast("long").alias("v"))
    ordered = years.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("year", "v"))).alias("x"))
    head = F.array_join(F.transform("x", lambda r: F.concat((r["year"] + 25).cast("string"), F.lit("E"))), " ")
    row = F.concat(F.lit("营业收入 "), F.array_join(F.transform("x", lambda r: r["v"].cast("string")), " "))
    text = F.concat(head, F.lit("\n"), row)
    place = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(n).alias("sequence")) for d, n in (("a", 1), ("a", 2), ("b", 1))])).alias("at")
    docs = ordered.select("entity", text.alias("text"), place).select(F.concat_ws("-", "entity", "at.d").alias("doc_id"), "entity", F.lit(1).alias("page"), "at.sequence", F.lit("table_like").alias("object_type"), "text")
    nodes, proof = tables.periodic_nodes(tables.periodic(docs), docs.select("doc_id", F.col("entity").alias("issuer")).distinct())
    n = proof.groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("evidence"))
    return nodes.join(n, "id").select("id", "label", "mentions", "evidence")
