"""All queries by name, with the SQL that must give the same rows.

The driver's tables hold no graph; nodes, edges, facts and questions are derived from them: suppliers, customers and
parts are entities, order lines are financial records, conversations are argument chains, documents are sources and
benchmark passages are quotes.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import registered
from ..functions import text as tx
from ..functions import values as vl
from ..functions import variants as vr
from ..operators import agenda, audit, blocks, candidates, closure, cycles, evaluation, evidence, facts, graph, lexicon, payload, ranking, statements, tables, validation, views
from ..session import table
from ..plans.rounds import partitions, shared_dir, written
from ..sources import announcements, landed, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(r"""
with q as (select item_id, text quote, regexp_replace(text, '\s+', '', 'g') p from benchmark),
d as (select doc_id, text, regexp_replace(text, '\s+', '', 'g') pt from documents),
m as (select q.item_id, d.doc_id, case when contains(d.text, q.quote) then 'exact' else 'whitespace_normalized' end match_mode from q join d on contains(d.pt, q.p) where q.p <> '')
select q.item_id, m.doc_id, m.match_mode, sha256(q.quote) quote_sha256,
  case when trim(q.quote) = '' then 'empty quote' when m.doc_id is null then 'quote not in any source' end reject_reason from q left join m using (item_id)""")
def evidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    quotes = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    return evidence.gate(quotes, table(spark, sf, "documents"))


@query(r"""
with p as (select regexp_replace(text, '\s+', '', 'g') p, text quote, item_id from benchmark), d as (select doc_id, text t, regexp_replace(text, '\s+', '', 'g') pt from documents),
m as (select d.doc_id, p.item_id from p join d on contains(d.pt, p.p) where p.p <> ''),
c as (select doc_id, item_id from m union all select d.doc_id, b.item_id from d join benchmark b on d.doc_id = b.item_id union all select -1, item_id from benchmark),
r as (select c.doc_id || '-' || c.item_id candidate_id, d.t, d.pt, p.quote, p.p from c join p using (item_id) left join d on d.doc_id = c.doc_id)
select candidate_id, bool_and(coalesce(p <> '' and (contains(t, quote) or contains(pt, p)), false)) admitted, count(*) items from r group by 1""")
def evidence_cited(spark: SparkSession, sf: str) -> DataFrame:
    """Each passage cites all documents that hold it, the document of its own number and an unknown one."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    held = evidence.quote_matches(items, docs).select("doc_id", "item_id")
    own = items.select(F.col("item_id").alias("doc_id"), "item_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    named = held.union(own).union(items.select(F.lit(-1).cast("long"), "item_id")).join(items, "item_id")
    named = named.select(F.concat_ws("-", "doc_id", "item_id").alias("candidate_id"), "doc_id", "quote")
    return evidence.admitted(evidence.cited(named, docs))


_FOLD = r"""
with pg as (select doc_id, text, string_split_regex(text, '\n\s*\n') gs from documents),
l as (select doc_id, unnest(range(1, len(gs) + 1)) g, unnest(list_transform(gs, lambda x: list_filter(list_transform(string_split_regex(x, '\n'), lambda y: rtrim(y, E' \t\r\n')), lambda y: trim(y) <> ''))) ls from pg),
f as (select doc_id, g, list_reduce(ls, lambda a, x: case when length(string_split(a, chr(30))[-1]) + 1 + length(x) > {most} then a || chr(30) || x else a || chr(10) || x end) packed from l where len(ls) > 0),
u as (select doc_id, g, unnest(range(1, len(string_split(packed, chr(30))) + 1)) i, trim(unnest(string_split(packed, chr(30))), E' \t\n') raw from f),
b as (select doc_id, row_number() over (partition by doc_id order by g, i) block, raw from u)
"""


@query(_FOLD.format(most=2800) + r""",
n as (select *, trim(regexp_replace(regexp_replace(raw, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g')) t from b),
k as (select *, string_split(t, chr(10)) ls from n),
st as (select doc_id, list(struct_pack(first := split_part(raw, chr(10), 1), n := length(raw)) order by block) bs from b group by doc_id),
c as (select doc_id, list_reduce(list_prepend('0|', list_transform(bs, lambda x: x.first || chr(30) || x.n)), lambda a, x: case when strpos(substr(text, split_part(a, '|', 1)::int + 1), split_part(x, chr(30), 1)) > 0
    then (split_part(a, '|', 1)::int + strpos(substr(text, split_part(a, '|', 1)::int + 1), split_part(x, chr(30), 1)) - 1 + split_part(x, chr(30), 2)::int) || '|' || split_part(a, '|', 2) || ',' || (split_part(a, '|', 1)::int + strpos(substr(text, split_part(a, '|', 1)::int + 1), split_part(x, chr(30), 1)) - 1)
    else a || ',' end) o from st join pg using (doc_id)),
w as (select doc_id, string_split(split_part(o, '|', 2), ',') starts from c)
select doc_id, block::int block, format('SO_P001_B{:03d}', block) block_id, sha256(raw) sha256, length(t)::bigint n_chars, try_cast(starts[block + 1] as int) char_start, try_cast(starts[block + 1] as int) + length(raw)::int char_end, block::int as "sequence",
  case when regexp_matches(t, '法律主体声明|版权声明|分析师声明|评级说明') then 'legal' when regexp_matches(t, '^(?:图表|图)\s*\d+') then 'figure_caption'
       when len(ls) >= 2 and len(list_filter(ls, lambda s: len(regexp_extract_all(s, '[-+]?\d[\d,.]*(?:%|倍|元|亿|万)?')) >= 2)) >= greatest(1, len(ls) // 3) then 'table_like' else 'paragraph' end object_type from k join w using (doc_id)""")
def source_blocks(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    rows = blocks.sequenced(blocks.source_blocks(pages))
    return rows.select("doc_id", "block", "block_id", "sha256", F.length("normalized_text").cast("long").alias("n_chars"), "char_start", "char_end", "sequence", "object_type")


@query(_FOLD.format(most=2800) + r""",
n as (select doc_id, block, length(trim(regexp_replace(regexp_replace(raw, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'))) + 100 n from b),
s as (select doc_id, list(n order by block) ns, list(block order by block) os from n group by doc_id),
p as (select doc_id, os, list_reduce(list_transform(ns, lambda x: ['1', x::varchar, '1']), lambda a, x: case when a[2]::bigint + x[2]::bigint > 9000
  then [(a[1]::bigint + 1)::varchar, x[2], a[3] || ',' || (a[1]::bigint + 1)::varchar] else [a[1], (a[2]::bigint + x[2]::bigint)::varchar, a[3] || ',' || a[1]] end) r from s)
select doc_id, unnest(os)::bigint o, unnest(list_transform(string_split(r[3], ','), lambda x: x::bigint)) chunk from p""")
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    rows = blocks.source_blocks(pages).withColumn("n", F.length("normalized_text"))
    return blocks.pack_chunks(rows, "doc_id", "block", "n", identity="block_id").select("doc_id", "o", "chunk")


@query(r"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') ls from documents),
c as (select doc_id, flatten(list_transform(ls, lambda x: list_transform(range(0, ((length(x) - 1) // 2600 + 1)::bigint), lambda i: substr(x, (i * 2600 + 1)::bigint, 2600)))) cs from l where len(ls) > 0),
f as (select doc_id, string_split(list_reduce(cs, lambda a, x: case when length(string_split(a, chr(30))[-1]) + 1 + length(x) > 2600 then a || chr(30) || x else a || chr(10) || x end), chr(30)) ts from c)
select doc_id, i - 1 chunk, length(ts[i])::bigint n_chars, sha256(ts[i]) sha256 from (select doc_id, ts, unnest(range(1, len(ts) + 1)) i from f)""")
def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    out = blocks.text_chunks(table(spark, sf, "documents"))
    return out.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("chunk_text").cast("long").alias("n_chars"), tx.sha256("chunk_text").alias("sha256"))


def _entities(spark, sf):
    of = lambda t, c, kind: table(spark, sf, t).select(F.lit(kind).alias("entity_type"), F.col(c).alias("label"))
    return of("supplier", "s_name", "company").union(of("customer", "c_name", "company")).union(of("part", "p_name", "product")).union(of("nation", "n_name", "region")).union(of("region", "r_name", "region"))


@query(r"""
with e as (select 'company' entity_type, s_name label from supplier union all select 'company', c_name from customer union all select 'product', p_name from part
  union all select 'region', n_name from nation union all select 'region', r_name from region)
select 'ENTITY_' || upper(substr(sha256(entity_type || chr(31) || trim(lower(label))), 1, 16)) id, entity_type, min(label) label, count(*) mentions from e group by entity_type, trim(lower(label))""")
def stable_ids_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = _entities(spark, sf).withColumn("id", tx.stable_id("ENTITY", "entity_type", F.lower("label")))
    return rows.groupBy("id", "entity_type").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("mentions"))


def _records(spark, sf):
    """Quarterly revenue, discount, tax and quantity of each nation.

    Lines are summed by order before they meet the orders, and the few rows that result are written, as they are read several
    times.
    """
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    dims = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    exact = lambda c, t: F.col(c).cast(t)  # noqa: E731  decimals before products: the same sums everywhere
    price, off, tax = exact("l_extendedprice", "decimal(12,2)"), exact("l_discount", "decimal(4,2)"), exact("l_tax", "decimal(4,2)")
    parts = {"revenue": price, "cost": price * off, "research": price * tax, "volume": exact("l_quantity", "decimal(12,2)")}
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*[F.sum(x).alias(n) for n, x in parts.items()])
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(dims, F.col("o_custkey") == F.col("c_custkey"))
    keys = [F.col("n_name").alias("entity"), F.year("o_orderdate").cast("long").alias("year"), F.quarter("o_orderdate").cast("long").alias("quarter")]
    return written(rows.groupBy(*keys).agg(*[F.sum(n).cast("double").alias(n) for n in parts]), "records")


_RECORDS = """
with rec as (select n_name entity, year(o_orderdate)::bigint "year", quarter(o_orderdate)::bigint "quarter", sum(l_extendedprice::decimal(12,2))::double revenue,
  sum(l_extendedprice::decimal(12,2) * l_discount::decimal(4,2))::double "cost", sum(l_extendedprice::decimal(12,2) * l_tax::decimal(4,2))::double research, sum(l_quantity::decimal(12,2))::double volume
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all)"""


@query(_RECORDS + """ select entity, "year", "quarter", metric, round("value", 0) "value" from (unpivot rec on revenue, "cost", research, volume into name metric value "value")""")
def financial_facts_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return facts.unpivot(_records(spark, sf), ["entity", "year", "quarter"]).withColumn("value", F.round("value", 0))


@query(_RECORDS + """ select a.entity, a."quarter", a."year", a.volume "value", b.volume prior, round_even((a.volume - b.volume) / abs(b.volume) * 100, 2) yoy_pct from rec a join rec b on a.entity = b.entity and a."quarter" = b."quarter" and a."year" = b."year" + 1
  where b.volume <> 0 and a."year" = (select max("year") from rec c where c.entity = a.entity and c."quarter" = a."quarter")""")
def yoy_by_nation_quarter(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf).select("entity", "quarter", "year", F.col("volume").alias("value"))
    return facts.growth(rows, ["entity", "quarter"]).select("entity", "quarter", "year", "value", "prior", "yoy_pct")


@query(_RECORDS + """ select entity, "year", "quarter", round_even((revenue - "cost") / revenue * 100, 2) gross_margin_pct, round_even(research / revenue * 100, 2) research_ratio_pct from rec where revenue <> 0""")
def margin_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return facts.margins(_records(spark, sf), ["entity", "year", "quarter"])


@query("""select user_id, event_type, event_id, ts, "value" as "close" from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id) n from events
  where ts < timestamp '2024-01-20' and ts >= timestamp '2024-01-20' - interval 60 day and "value" is not null) where n = 1""")
def latest_bar_asof(spark: SparkSession, sf: str) -> DataFrame:
    bars = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", F.col("value").alias("close"))
    return facts.latest_bar(bars, ["user_id", "event_type"], "ts", F.lit("2024-01-20").cast("timestamp_ntz"), tie="event_id")


@query(_RECORDS + """, o as (select entity question_id, metric, "year", 'Q' || "quarter" fiscal_period, "year" * 10 + "quarter" period_end from (unpivot rec on revenue, volume into name metric value v)),
f as (select *, question_id || '|' || metric || '|' || period_end id from (select * from o union all select a.question_id, a.metric || '_yoy', a."year", a.fiscal_period, a.period_end from o a join o b on a.question_id = b.question_id and a.metric = b.metric and a.fiscal_period = b.fiscal_period and a."year" = b."year" + 1)),
n as (select * from (select *, row_number() over (partition by question_id, metric order by period_end desc, id) k from f where metric not like '%_yoy') where k = 1),
r as (select question_id, id, metric, 0 place from n union all select f.question_id, f.id, f.metric, 1 from f join n on f.question_id = n.question_id and f.metric = n.metric and f.fiscal_period = n.fiscal_period and f."year" = n."year" - 1
  union all select f.question_id, f.id, n.metric, 2 from f join n on f.question_id = n.question_id and f.metric = n.metric || '_yoy' and f.period_end = n.period_end)
select question_id, id, metric, place, row_number() over (partition by question_id order by metric, place, id)::int as "rank" from r""")
def metric_priority(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts.unpivot(_records(spark, sf), ["entity", "year", "quarter"], ["revenue", "volume"])
    rows = rows.select(F.col("entity").alias("question_id"), "metric", "year", F.concat(F.lit("Q"), F.col("quarter").cast("string")).alias("fiscal_period"), (F.col("year") * 10 + F.col("quarter")).alias("period_end"))
    years = Window.partitionBy("question_id", "metric", "fiscal_period").orderBy("year").rangeBetween(-1, -1)
    grown = F.when(F.count(F.lit(1)).over(years) > 0, F.concat("metric", F.lit("_yoy")))  # a growth where there is the year before
    both = rows.withColumn("names", F.array_compact(F.array("metric", grown)))
    every = both.withColumn("metric", F.explode("names")).drop("names")
    return facts.metric_priority(every.withColumn("id", F.concat_ws("|", "question_id", "metric", "period_end"))).select("question_id", "id", "metric", "place", "rank")


@query("""select l_orderkey, l_linenumber, count(*) facts, count(distinct l_extendedprice) distinct_values from lineitem group by 1, 2 having count(distinct l_extendedprice) >= 2""")
def structured_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return facts.conflicts(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice")


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    return c.withColumn("id", F.concat_ws(":", "conv_id", "turn"))


def _chain(spark, sf):
    """Each turn is a premise of the next one."""
    c = _turns(spark, sf)
    a = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("id").alias("source_id"))
    return a.join(c.select("conv_id", "turn", F.col("id").alias("target_id")), ["conv_id", "turn"]).select("source_id", F.lit("SUPPORTS").alias("edge_type"), "target_id", "conv_id")


_TURNS = """
with recursive t as (select conv_id, turn, conv_id || ':' || turn id, role, text from conversations),
ch as (select a.id source_id, b.id target_id, a.conv_id from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1)"""


@query(_TURNS + """, cl as (select source_id, target_id, 1 "depth" from ch union select cl.source_id, ch.target_id, cl."depth" + 1 from cl join ch on cl.target_id = ch.source_id)
select source_id, target_id, min("depth") "depth" from cl group by 1, 2""")
def argument_closure(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(_chain(spark, sf))


@query(_TURNS + """, e as (select source_id, target_id, conv_id from ch union all select b.id, a.id, a.conv_id from t a join t b on a.conv_id = b.conv_id and a.turn = 1 and b.turn = 2 where length(b.text) < length(a.text)),
cl as (select source_id, target_id from e union select cl.source_id, e.target_id from cl join e on cl.target_id = e.source_id),
cyc as (select source_id id from cl where source_id = target_id)
select distinct id from (select id from cyc union all select cl.source_id from cl join cyc on cl.target_id = cyc.id)""")
def dag_check(spark: SparkSession, sf: str) -> DataFrame:
    c = _turns(spark, sf).select("conv_id", "turn", "id", F.length("text").alias("n"))
    a = c.where("turn = 1").select("conv_id", F.col("id").alias("target_id"), F.col("n").alias("before"))
    back = c.where("turn = 2").join(a, "conv_id").where("n < before").select(F.col("id").alias("source_id"), "target_id")
    return graph.cyclic_nodes(_chain(spark, sf).select("source_id", "target_id").union(back))


@query(_TURNS + """, p as (select target_id id, source_id parent from ch), n as (select t.*, t.turn = 0 leaf, (t.turn = 3 and t.conv_id % 4 = 0) broken, (t.turn = 2 and t.conv_id % 5 = 0) unread from t)
select n.id from n where not n.leaf and not n.broken and (n.unread or exists (select 1 from n b where b.conv_id = n.conv_id and (b.broken or b.unread) and b.turn < n.turn)
  or not exists (select 1 from n z where z.conv_id = n.conv_id and z.leaf)
  or (select count(*) from t x where x.conv_id = n.conv_id and x.turn < n.turn) < n.turn)""")
def contested_propagation(spark: SparkSession, sf: str) -> DataFrame:
    broken = (F.col("turn") == 3) & (F.col("conv_id") % 4 == 0)
    unread = (F.col("turn") == 2) & (F.col("conv_id") % 5 == 0)
    props = _turns(spark, sf).select("id", F.when(F.col("turn") == 0, "fact").otherwise("analysis").alias("kind"), (F.col("turn") == 0).alias("grounded"), F.when(broken, "contested").otherwise("reportable").alias("status"), F.lit(None).cast("string").alias("formula"), F.when(~unread, "accepted").alias("review"))
    return facts.contested(props, _chain(spark, sf).select(F.col("target_id").alias("id"), F.col("source_id").alias("parent_id")))


def _trade(spark, sf):
    """Supplier to part edges of the order lines, with their dearest line's confidence."""
    lines = table(spark, sf, "lineitem")
    near = lines.repartition(partitions(lines), "l_suppkey", "l_partkey")
    return near.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), (1 - F.min("l_discount")).alias("confidence")).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.lit("SUPPORTS").alias("edge_type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_id"), "n", "confidence")


_TRADE = """
with tr as (select 's' || l_suppkey source_id, 'SUPPORTS' edge_type, 'p' || l_partkey target_id, count(*) n, 1 - min(l_discount) confidence from lineitem group by l_suppkey, l_partkey)"""


@query(_TRADE + """, h1 as (select distinct target_id id from tr where source_id in ('s1', 's2')), h2 as (select distinct source_id id from tr where target_id in (select id from h1))
select id, min(hops) hops from (select unnest(['s1', 's2']) id, 0 hops union all select id, 1 from h1 union all select id, 2 from h2) group by id""")
def khop_neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    seeds = spark.createDataFrame([("s1",), ("s2",)], "id string")
    return graph.neighbourhood(_trade(spark, sf), seeds, 2, ["SUPPORTS"])


def _geo(spark, sf):
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    nodes = n.select(key("n", "n_nationkey").alias("id"), F.lit("Section").alias("node_type")).union(r.select(key("r", "r_regionkey"), F.lit("Source"))).union(s.select(key("s", "s_suppkey"), F.lit("Proposition"))).union(c.select(key("c", "c_custkey"), F.lit("Question")))
    edges = s.select(key("s", "s_suppkey").alias("source_id"), F.lit("ABOUT").alias("edge_type"), key("n", "s_nationkey").alias("target_id")).union(c.select(key("c", "c_custkey"), F.lit("IN_SECTION"), key("n", "c_nationkey"))).union(n.select(key("n", "n_nationkey"), F.lit("CONTAINS"), key("r", "n_regionkey")))
    return nodes, edges


_GEO = """
with nd as (select 'n' || n_nationkey id, 'Section' node_type from nation union all select 'r' || r_regionkey, 'Source' from region union all select 's' || s_suppkey, 'Proposition' from supplier union all select 'c' || c_custkey, 'Question' from customer),
ed as (select 's' || s_suppkey source_id, 'ABOUT' edge_type, 'n' || s_nationkey target_id from supplier union all select 'c' || c_custkey, 'IN_SECTION', 'n' || c_nationkey from customer union all select 'n' || n_nationkey, 'CONTAINS', 'r' || n_regionkey from nation)"""


@query(_GEO + """ select source_id, edge_type, target_id from ed where source_id in (select id from nd where node_type in ('Section', 'Question', 'Proposition')) and target_id in (select id from nd where node_type in ('Section', 'Question', 'Proposition'))""")
def induced_view(spark: SparkSession, sf: str) -> DataFrame:
    return graph.view(*_geo(spark, sf), "agenda")[1].select("source_id", "edge_type", "target_id")


@query(_GEO + """ select source_id, edge_type, target_id, 'mistyped' code from ed where edge_type in ('ABOUT', 'CONTAINS')
union all select source_id, edge_type, target_id, 'EDGE_TARGET' from ed where target_id like 'r%' and target_id = 'r4'""")
def edge_integrity(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _geo(spark, sf)
    wrong = graph.mistyped(nodes, edges).select("source_id", "edge_type", "target_id", F.lit("mistyped").alias("code"))
    return wrong.union(graph.dangling(nodes.where("id <> 'r4'"), edges).select("source_id", "edge_type", "target_id", "code"))


@query("""select 's' || l_suppkey source_id, 'SUPPORTS' edge_type, 'p' || l_partkey target_id, min(l_orderkey) seq from lineitem group by l_suppkey, l_partkey""")
def distinct_edges(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.lit("SUPPORTS").alias("edge_type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_id"), F.col("l_orderkey").alias("seq"))
    return graph.distinct_edges(lines).select("source_id", "edge_type", "target_id", "seq")


@query("""with own as (select distinct l_orderkey node_id, l_suppkey source_id from lineitem where l_returnflag <> 'R'), ed as (select distinct l_orderkey node_id, l_suppkey source_id from lineitem where l_linestatus = 'F' or l_returnflag <> 'R')
select distinct node_id from (select * from own except select * from ed union all (select * from ed except select * from own))""")
def evidence_edge_parity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_suppkey").alias("source_id"), "l_returnflag", "l_linestatus")
    return validation.parity(rows.where("l_returnflag <> 'R'"), rows.where("l_linestatus = 'F' or l_returnflag <> 'R'"))


@query("""with p as (select l_suppkey || '-' || l_partkey proposal_id, max(l_discount) d, max(l_tax) t from lineitem group by l_suppkey, l_partkey),
v as (select proposal_id, case when t < 0.08 then 'accept' else 'reject' end verdict, 1 - d * 5 confidence from p where d > 0)
select p.proposal_id, coalesce(v.verdict, 'reject') verdict, coalesce(v.verdict = 'accept' and v.confidence >= 0.65, false) accepted from p left join v using (proposal_id)""")
def verification_gate(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").groupBy(F.concat_ws("-", "l_suppkey", "l_partkey").alias("proposal_id")).agg(F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    v = p.where("d > 0").select("proposal_id", F.when(F.col("t") < 0.08, "accept").otherwise("reject").alias("verdict"), (1 - F.col("d") * 5).alias("confidence"))
    return graph.verified(p.select("proposal_id"), v).select("proposal_id", "verdict", "accepted")


@query(r"""with refs as (select doc_id, count(*) n from documents d join benchmark b on contains(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g')) group by 1),
s as (select d.doc_id id, coalesce(n, 0) n, case when n > 0 then 'EXTRACTED' when l.quality = 0 then 'NO_CLAIM' else 'NEEDS_REVIEW' end st from documents d left join refs using (doc_id) left join labels l using (doc_id))
select st processing_status, count(*) sources, sum(n)::bigint candidates, round_even(count(*) / sum(count(*)) over (), 6) coverage from s group by 1""")
def coverage_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    refs = evidence.quote_matches(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote")), docs).select(F.col("doc_id").alias("source_id"))
    reviews = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("source_id"), F.lit("administrative").alias("classification"))
    rows = validation.dispositions(docs.select(F.col("doc_id").alias("id"), F.lit("paragraph").alias("object_type")), refs, reviews)
    by = rows.groupBy("processing_status").agg(F.count(F.lit(1)).alias("sources"), F.sum("candidate_count").alias("candidates"))
    return by.withColumn("coverage", validation.ratio(F.col("sources"), F.sum("sources").over(Window.partitionBy(F.lit(1)))))


@query("""select id, count(*) n from (select s_suppkey::varchar id from supplier union all select p_partkey::varchar from part union all select n_nationkey::varchar from nation) group by 1 having count(*) > 1""")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda t, c: table(spark, sf, t).select(F.col(c).cast("string").alias("id"))
    return validation.duplicates(of("supplier", "s_suppkey"), of("part", "p_partkey"), of("nation", "n_nationkey"))


@query(_TRADE + """, g as (select id, sum(o)::bigint out_degree, sum(i)::bigint in_degree, count(*) "degree" from (select source_id id, 1 o, 0 i from tr union all select target_id, 0, 1 from tr) group by 1),
k as (select *, substr(id, 1, 1) bucket from g)
select id, bucket, out_degree, in_degree, "degree", "rank" from (select *, row_number() over (partition by bucket order by "degree" desc, id)::int "rank" from k) where "rank" <= 12""")
def degree_rank(spark: SparkSession, sf: str) -> DataFrame:
    deg = graph.degree(_trade(spark, sf)).withColumn("bucket", F.substring("id", 1, 1))
    return views.label_ranks(deg, "bucket", "degree", "id", 12)


_TERMS = (("q1", ["the", "tion"]), ("q2", ["pour", "elle"]), ("q3", ["und", "der"]))


@query(r"""with q as (select * from (values ('q1', ['the', 'tion']), ('q2', ['pour', 'elle']), ('q3', ['und', 'der'])) v(question_id, terms)),
s as (select question_id, doc_id chunk_id, list_sum(list_transform(terms, lambda t: (3 + length(t)) * least((length(lower(text)) - length(replace(lower(text), t, ''))) // length(t), 4)))
  + 0.3::double * len(list_intersect(terms, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_]+')))) score from documents, q)
select question_id, chunk_id, round(score, 4) score, "rank" from (select *, row_number() over (partition by question_id order by round(score, 4) desc, chunk_id)::int "rank" from s where score > 0) where "rank" <= 16""")
def relevance_topk(spark: SparkSession, sf: str) -> DataFrame:
    questions = spark.createDataFrame(list(_TERMS), "question_id string, terms array<string>")
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    rows = ranking.scored(chunks, questions).withColumn("score", F.round("score", 4))
    return ranking.top(rows, 16, ["question_id"], F.desc("score"), "chunk_id")


@query(r"""with x as (select doc_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z]\d|\d[\d,]*(?:\.\d+)?'), lambda m: regexp_matches(m, '^\d')), lambda m: replace(m, ',', '')))) ns from documents)
select doc_id, array_to_string(ns, '|') numbers, len(ns)::bigint n from x""")
def number_support(spark: SparkSession, sf: str) -> DataFrame:
    n = tx.number_tokens("text")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(n), "|").alias("numbers"), F.size(n).cast("long").alias("n"))


@query(r"""with v as (select event_id, case event_id % 7 when 0 then round("value", 1) || '%' when 1 then round("value", 1) || '亿元' when 2 then round("value", 1) || '百万元' when 3 then round("value", 1) || '万元' when 4 then round("value", 1) || '元/股'
    when 5 then round("value", 1) || 'GB' else round("value", 1) || '' end raw from events),
u as (select event_id, raw, case when contains(raw, '%') then 'percent' when contains(raw, '亿元') or contains(raw, '百万元') or contains(raw, '万元') then 'CNY' when contains(raw, '元/股') then 'CNY/share' when contains(raw, 'GB') then 'GB' end unit,
  case when contains(raw, '%') then '0.01' when contains(raw, '亿元') then '100000000' when contains(raw, '百万元') then '1000000' when contains(raw, '万元') then '10000' when contains(raw, '元/股') or contains(raw, 'GB') then '1' end "scale",
  regexp_extract(raw, '[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?') number from v)
select event_id, unit, "scale", number::double number from u""")
def unit_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    n = F.round("value", 1).cast("string")
    k = F.col("event_id") % 7
    raw = F.concat(n, F.when(k == 0, "%").when(k == 1, "亿元").when(k == 2, "百万元").when(k == 3, "万元").when(k == 4, "元/股").when(k == 5, "GB").otherwise(""))
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    value = vl.canonical_value(F.lit("scalar"), "raw", F.regexp_extract("raw", tx.NUMBER, 0), F.lit(None), F.lit(None), F.lit(None))
    return rows.select("event_id", vl.value_unit("raw", F.lit("")).alias("u"), value.alias("v")).select("event_id", "u.unit", "u.scale", F.col("v.normalized").cast("double").alias("number"))


@query(r"""with sp as (select p_type spec_id, split_part(p_type, ' ', 1) w, 'data' category from part group by 1 union all select 'none', 'no such words', 'data'),
m as (select sp.spec_id, p.p_partkey from sp join part p on contains(regexp_replace(lower(p.p_type), '\s+', '', 'g'), regexp_replace(lower(sp.w), '\s+', '', 'g'))),
r as (select sp.spec_id, sp.category, count(distinct p_partkey) n from sp left join m using (spec_id) group by 1, 2)
select category, count(*) filter (n > 0) passed, count(*) total, round_even(count(*) filter (n > 0) / count(*), 6) recall from r group by 1""")
def gold_recall(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    kinds = parts.select(F.col("p_type").alias("spec_id")).distinct().select("spec_id", F.split_part("spec_id", F.lit(" "), F.lit(1)).alias("w")).union(spark.createDataFrame([("none", "no such words")], "spec_id string, w string"))
    null = F.lit(None)
    specs = kinds.select("spec_id", F.lit("data").alias("category"), null.cast("array<string>").alias("node_types"), F.array("w").alias("all_terms"), null.cast("array<array<string>>").alias("any_term_groups"))
    hits = evaluation.match_nodes(parts.select(F.col("p_partkey").alias("id"), F.lit("Entity").alias("node_type"), F.col("p_type").alias("text")), specs)
    return evaluation.recall(evaluation.verdicts(specs, hits))


@query("""select p_partkey id, p_name label from part where contains(lower(p_name || ' ' || p_type), 'widg') order by p_partkey limit 8""")
def search_nodes(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    return ranking.search(parts, F.concat_ws(" ", "p_name", "p_type"), " WIDG ", 8, "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))


@query()
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return landed.page_text(table(spark, sf, "pages")).select("page_id", F.length("text").cast("long").alias("n_chars"), tx.sha256("text").alias("sha256"), "published")


def _announcements(spark, sf):
    o = table(spark, sf, "orders")
    day = F.date_format(F.add_months("o_orderdate", 240), "yyyy-MM-dd")  # paths hold dates of this century
    k = F.col("o_orderkey") % 10
    told = F.unix_millis(F.to_timestamp(F.concat(day, F.lit(" 04:00:00"))))
    return o.select(F.col("o_orderkey").alias("seq"), F.when(k == 1, "X").otherwise("600").alias("secCode"), F.lit("org").alias("orgId"), F.when(k == 2, "bad.html").otherwise(F.concat(F.lit("finalpage/"), day, F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".PDF"))).alias("adjunctUrl"), F.when(k == 3, "0").otherwise(F.col("o_orderkey").cast("string")).alias("announcementId"), F.when(k == 4, None).when(k == 5, told + 86400000).otherwise(told).alias("announcementTime"), F.when(k == 6, "").otherwise(F.lit("title")).alias("announcementTitle"))


@query("""select case o_orderkey % 10 when 1 then 'identity_mismatch' when 2 then 'unsupported_pdf_path' when 3 then 'announcement_id_mismatch' when 4 then 'invalid_publication_time' when 5 then 'publication_date_mismatch'
  else case when o_orderdate not between timestamp '1996-01-01' and timestamp '2000-12-31' then 'publication_date_mismatch' when o_orderkey % 10 = 6 then 'missing_title' else 'usable' end end reason, count(*) n from orders group by 1""")
def reject_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = landed.announcement_reasons(_announcements(spark, sf), F.lit("600"), F.lit("org"), F.lit("2016-01-01").cast("date"), F.lit("2020-12-31").cast("date"))
    return rows.groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""with q as (select c_custkey question_id, case when c_custkey % 3 = 0 then 'fact' else 'analysis' end answer_mode, case when c_custkey % 2 = 0 then 'required' else 'optional' end priority from customer),
a as (select o_custkey question_id, count(*) n, bool_or(o_orderstatus = 'F') ok from orders group by 1),
s as (select q.*, case when n > 0 and answer_mode = 'fact' and ok then 'answered' when n > 0 then 'partial' else 'unanswered' end status, least(coalesce(n, 0), 12) n_answers from q left join a using (question_id))
select question_id, status, n_answers::bigint n_answers, case when priority = 'required' then 0 else 1 end a, case when status = 'unanswered' then 0 else 1 end b from s where status <> 'answered'""")
def question_gaps(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("question_id"), F.when(F.col("c_custkey") % 3 == 0, "fact").otherwise("analysis").alias("answer_mode"), F.when(F.col("c_custkey") % 2 == 0, "required").otherwise("optional").alias("priority"))
    answers = table(spark, sf, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("place"), (F.col("o_orderstatus") == "F").alias("sufficient"))
    aligned = agenda.align(c, answers).join(c.select("question_id", "priority"), "question_id")
    open_ = agenda.gaps(aligned, spark.createDataFrame([], "ref string"))
    return open_.join(aligned.select(F.col("question_id").cast("string").alias("ref"), "question_id", "status", "n_answers"), "ref").select("question_id", "status", "n_answers", "a", "b")


@query(_TURNS + """ select t.conv_id section_id, t.turn seq, coalesce(string_agg(r.ref::varchar, ',' order by r.ref), '') refs from t left join (select distinct b.conv_id, b.turn, a.turn * 10 ref from t a join t b on a.conv_id = b.conv_id and a.turn <= b.turn) r
  on r.conv_id = t.conv_id and r.turn = t.turn group by 1, 2""")
def section_citations(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations")
    spans = t.select(F.col("conv_id").alias("section_id"), F.col("turn").alias("seq"), "text", F.array(F.concat_ws(":", "conv_id", "turn")).alias("claims"))
    b = t.select("conv_id", F.col("turn").alias("upto"))
    ev = t.join(b, "conv_id").where("turn <= upto").select(F.concat_ws(":", "conv_id", "upto").alias("claim_id"), (F.col("turn") * 10).alias("evidence_id"))
    return agenda.sentences(spans, ev).select("section_id", "seq", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("refs"))


@query("""with recursive r as (select o_custkey graph_id, l_partkey s, l_suppkey t, bool_or(l_returnflag = 'R') ex, max(1 - l_discount) cf from lineitem join orders on l_orderkey = o_orderkey where l_partkey <> l_suppkey group by 1, 2, 3),
n as (select *, row_number() over (partition by graph_id order by ex desc, cf desc, s || '-' || t) i from r),
st as (select graph_id, 0::bigint i, [{'a': 0::bigint, 'b': 0::bigint}] cl, true ok from n group by graph_id union all
  select n.graph_id, n.i, case when list_contains(cl, {'a': n.t, 'b': n.s}) then cl else list_distinct(list_concat(cl, flatten(list_transform(list_append(list_transform(list_filter(cl, lambda p: p.b = n.s), lambda p: p.a), n.s),
    lambda x: list_transform(list_append(list_transform(list_filter(cl, lambda p: p.a = n.t), lambda p: p.b), n.t), lambda y: {'a': x, 'b': y}))))) end, not list_contains(cl, {'a': n.t, 'b': n.s})
  from st join n on n.graph_id = st.graph_id and n.i = st.i + 1)
select n.graph_id, n.s || '-' || n.t proposal_id, n.s source_id, n.t target_id, st.ok admitted from st join n using (graph_id, i)""")
def admit_acyclic(spark: SparkSession, sf: str) -> DataFrame:
    """A graph for each customer: parts lead to suppliers, whose numbers overlap, so some lines would close a cycle."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("graph_id"))
    rel = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("graph_id", F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), (F.col("l_returnflag") == "R").alias("explicit"), (1 - F.col("l_discount")).alias("confidence"))
    rel = rel.where("source_id <> target_id").groupBy("graph_id", "source_id", "target_id").agg(F.bool_or("explicit").alias("explicit"), F.max("confidence").alias("confidence"))
    return graph.admit_acyclic(rel.withColumn("proposal_id", F.concat_ws("-", "source_id", "target_id")))


@query("""with h as (select sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') h from orders)
select sha256(count(*) || ':' || list_aggregate([sum(('0x' || substr(h, 1, 8))::bigint), sum(('0x' || substr(h, 9, 8))::bigint), sum(('0x' || substr(h, 17, 8))::bigint), sum(('0x' || substr(h, 25, 8))::bigint),
  sum(('0x' || substr(h, 33, 8))::bigint), sum(('0x' || substr(h, 41, 8))::bigint), sum(('0x' || substr(h, 49, 8))::bigint), sum(('0x' || substr(h, 57, 8))::bigint)], 'string_agg', ':')) state_hash from h""")
def state_hash(spark: SparkSession, sf: str) -> DataFrame:
    return validation.state_hash(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


@query(_RECORDS + """, y as (select entity, "year", sum(volume) v from rec group by 1, 2), x as (select *, row_number() over (partition by entity order by "year") n, count(*) over (partition by entity) c from y)
select entity doc_id, '营业收入' metric, ("year" + 25) || 'E' period, v::bigint::varchar raw, v::bigint::double number, 'forecast' qualifier, 'CNY' unit from x where n <= 5 and c >= 5""")
def periodic_table(spark: SparkSession, sf: str) -> DataFrame:
    """Year tables written out per nation as text and read back by the table expansion."""
    years = _records(spark, sf).groupBy("entity", "year").agg(F.sum("volume").alias("v"))
    ordered = years.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("year", "v"))).alias("x"))
    head = F.array_join(F.transform("x", lambda r: F.concat((r["year"] + 25).cast("string"), F.lit("E"))), " ")
    row = F.concat(F.lit("营业收入 "), F.array_join(F.transform("x", lambda r: r["v"].cast("long").cast("string")), " "))
    doc = ordered.select(F.col("entity").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("sequence"), F.lit("table_like").alias("object_type"), F.concat(head, F.lit("\n"), row).alias("text"))
    return tables.periodic(doc).select("doc_id", "metric", "period", "raw", F.col("number").cast("double").alias("number"), "qualifier", "unit")


_CAPACITY = """
with p as (select p_partkey k, 'iPhone ' || p_size subject, '20' || (10 + p_partkey % 90) || '.' || lpad((p_partkey % 12 + 1)::varchar, 2, '0') period, p_size % 7 + 1 m, p_size % 9 + 64 s, p_size % 5 + 1 b, p_size % 7 + p_partkey % 2 + 1 a, p_partkey % 3 = 0 moved from part),
x as (select k, subject, period, '内存容量' metric, m n, 0 i, 'reported' endpoint from p union all select k, subject, period, '存储容量', s, 1, 'reported' from p
  union all select k, subject, period, '内存容量', b, 2, 'before' from p where moved union all select k, subject, period, '内存容量', a, 3, 'after' from p where moved)"""


@query(_CAPACITY + """ select k doc_id, subject, metric, period, n || 'GB' raw, arg_min(endpoint, i) endpoint, 1::bigint mentions, n::bigint number from x group by k, subject, metric, period, n""")
def capacity_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every part is a phone with a capacity row, every third one with a change of capacity; a change outside a row counts nothing."""
    k, size, gb = F.col("p_partkey"), F.col("p_size"), F.lit("GB")
    period = F.concat(F.lit("20"), (k % 90 + 10).cast("string"), F.lit("."), F.lpad((k % 12 + 1).cast("string"), 2, "0"))
    row = F.concat_ws(" ", F.lit("iPhone"), size, period, F.concat(size % 7 + 1, gb), F.concat(size % 9 + 64, gb))
    moved = F.concat(F.lit(" 内存容量：从 "), size % 5 + 1, gb, F.lit(" 向 "), size % 7 + k % 2 + 1, gb, F.lit("升级"))
    text = F.concat(F.lit("机型\n"), row, F.when(k % 3 == 0, moved).otherwise(""), F.lit("\n存储容量：从 1GB 向 2GB 升级"))
    return tables.capacity(table(spark, sf, "part").select(k.alias("doc_id"), F.lit(1).alias("sequence"), text.alias("text")))


@query("""select question_id, id, "rank" from (select o_custkey question_id, o_orderkey id, row_number() over (partition by o_custkey order by o_orderstatus = 'F' and o_orderkey % 7 = 0 desc, o_orderkey % 5 desc, o_orderkey % 2 = 0 desc, o_orderdate desc, o_orderkey)::int "rank" from orders) where "rank" <= 16""")
def question_facts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("question_id"), k.alias("id"), ((F.col("o_orderstatus") == "F") & (k % 7 == 0)).alias("priority"), (k % 5).alias("score"), (k % 2 == 0).alias("is_document"), F.col("o_orderdate").alias("period_end"))
    return agenda.question_facts(rows).select("question_id", "id", "rank")


@query("""select conv_id page_id, row_number() over (partition by conv_id order by turn, role, text) - 1 place, conv_id || ':' || turn id, role, turn::double create_time, text from conversations where text <> ''""")
def shared_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as flattened arrays into script calls of pages, and read back."""
    of = lambda *c: F.struct(*c)
    message = of(F.concat_ws(":", "conv_id", "turn").alias("id"), of("role").alias("author"), F.col("turn").cast("double").alias("create_time"), of(F.array("text").alias("parts")).alias("content"))
    turns = table(spark, sf, "conversations").where("text <> ''").select("conv_id", F.struct("turn", "role", "text").alias("at"), F.struct(message.alias("message")).alias("node"))
    flat = turns.groupBy("conv_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("at", "node"))), lambda x: x["node"])).alias("nodes"))
    array = F.concat(F.lit('[{"_1":2},"linear_conversation",'), "nodes", F.lit("]"))
    literal = F.regexp_extract(F.to_json(F.struct(array.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)
    pages = flat.select(F.col("conv_id").alias("page_id"), F.concat(F.lit("<html><script>enqueue("), literal, F.lit(")</script></html>")).alias("html"))
    return landed.shared_messages(pages)


_CLAIMS = r"""
with d as (select doc_id k, coalesce(text, '') t, coalesce(regexp_extract(text, '[A-Za-z]{3,}'), '') w, lead(doc_id) over (partition by doc_id // 10 order by doc_id) nx from documents),
ev as (select *, case when k % 7 = 0 then 'no such words at all' else w end q, case k % 3 when 0 then 'exact' when 1 then 'whitespace_normalized' else 'fuzzy' end m from d)"""


@query(_CLAIMS + r""",
e as (select 'SOURCE_HASH' code from d where k % 5 = 0 union all select 'SOURCE_STATUS' from d where k % 4 = 2 union all select 'SOURCE_ERROR' from d where k % 4 = 3 union all select 'NODE_LABEL' from d where k % 6 = 0
  union all select 'EVIDENCE_QUOTE' from ev where m = 'fuzzy' or (m = 'exact' and not contains(t, q)) or (m <> 'exact' and not contains(regexp_replace(t, '\s+', '', 'g'), regexp_replace(q, '\s+', '', 'g')))
  union all select 'EVIDENCE_EDGE_PARITY' from d where k % 10 = 1 union all select 'UNVERIFIED_INFERRED_EDGE' from d where nx is not null and k % 2 = 0 and k % 8 = 0
  union all select 'EXPLICIT_RELATION_EVIDENCE' from d where nx is not null and k % 2 = 1 and k % 9 = 0
  union all select 'EDGE_TARGET' from d where k % 11 = 0)
select code, count(*) errors from e group by code""")
def validator(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sources and as claims on their first word, each claim supporting the next of its ten; with faults by number."""
    k, word = F.col("doc_id"), F.coalesce(F.regexp_extract("text", "[A-Za-z]{3,}", 0), F.lit(""))
    docs = table(spark, sf, "documents")
    name = lambda prefix, c=k: F.concat(F.lit(prefix), c.cast("string"))
    text = F.coalesce("text", F.lit(""))
    sources = docs.select(name("S").alias("id"), F.lit("D").alias("document_id"), text.alias("raw_text"), text.alias("normalized_text"), F.when(k % 5 == 0, "0").otherwise(tx.sha256(text)).alias("sha256"), F.element_at(F.array(*map(F.lit, ("EXTRACTED", "NO_CLAIM", "ODD", "ERROR"))), (k % 4 + 1).cast("int")).alias("processing_status"))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    value = "struct<kind:string,raw:string,normalized_decimal:string,range_low:string,range_high:string,scale:string>"
    nodes = docs.select(name("C").alias("id"), F.lit("Claim").alias("node_type"), F.when(k % 6 == 0, " ").otherwise("says").alias("label"), F.lit("EXPLICIT").alias("assertion_level"), *[none("string", c) for c in ("subject_ref", "metric_ref", "period_ref")], none(value, "value"), none("array<string>", "premise_node_ids"), none("array<string>", "conclusion_claim_ids"))
    quote = F.when(k % 7 == 0, "no such words at all").otherwise(word)
    proof = docs.select(name("C").alias("node_id"), name("S").alias("source_id"), quote.alias("quote"), tx.sha256(quote).alias("quote_sha256"), F.element_at(F.array(*map(F.lit, ("exact", "whitespace_normalized", "fuzzy"))), (k % 3 + 1).cast("int")).alias("match_mode"))
    following = docs.select("doc_id", F.lead("doc_id").over(Window.partitionBy(F.floor(k / 10)).orderBy("doc_id")).alias("next")).where("next is not null")
    edge = lambda rows, i, t, a, b, level="EXPLICIT", verdict=none("string", "verdict"), sure=none("double", "verdict_confidence"), backed=F.lit(True): rows.select(i.alias("id"), F.lit(t).alias("edge_type"), a.alias("source_id"), b.alias("target_id"), (F.lit(level) if isinstance(level, str) else level).alias("assertion_level"), F.lit("active").alias("status"), verdict, sure, backed.alias("has_evidence"))
    edges = edge(docs.where(k % 10 != 1), name("e"), "EVIDENCED_BY", name("C"), name("S"))
    edges = edges.union(edge(following, name("s"), "SUPPORTS", name("C"), name("C", F.col("next")), F.when(k % 2 == 0, "INFERRED").otherwise("EXPLICIT"), F.lit("accept").alias("verdict"), F.when(k % 8 == 0, 0.6).otherwise(0.7).alias("verdict_confidence"), k % 9 != 0))
    edges = edges.union(edge(docs.where(k % 11 == 0), name("a"), "ASSUMES", name("C"), name("lost")))
    found = validation.errors(spark.createDataFrame([("D",)], "id string"), sources, nodes, edges, proof)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("errors"))


@query("""with sp as (select p_brand spec_id, lower(p_brand) b, split_part(min(p_type), ' ', 1) w from part group by 1),
m as (select spec_id, count(*) n from sp join part on contains(lower(replace(p_brand, ' ', '')), replace(b, ' ', '')) and contains(lower(replace(p_type, ' ', '')), lower(w)) and p_size <= 25 group by 1)
select spec_id, coalesce(n, 0) matches, case when n > 0 then 'PASS' else 'MISS' end status from sp left join m using (spec_id)""")
def data_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as points whose labels stand on other nodes (brands, types); a specification per brand asks for one kind of it."""
    parts = table(spark, sf, "part")
    null = lambda t: F.lit(None).cast(t)
    label = lambda c, kind: parts.select(F.concat(F.lit(kind), c).alias("id"), F.lit(kind).alias("node_type"), F.col(c).alias("label")).distinct()
    ends = label("p_brand", "Entity").union(label("p_type", "Metric"))
    points = parts.select(F.col("p_partkey").cast("string").alias("id"), F.lit("DataPoint").alias("node_type"), F.col("p_name").alias("label"), F.concat(F.lit("Entity"), "p_brand").alias("subject_ref"), F.concat(F.lit("Metric"), "p_type").alias("metric_ref"), F.struct(F.col("p_size").cast("string").alias("raw"), F.when(F.col("p_size") <= 25, "1").otherwise("1000").alias("scale")).alias("value"))
    nodes = points.unionByName(ends, allowMissingColumns=True).withColumns({c: null("string") for c in ("period_ref", "object_text", "predicate")})
    kinds = parts.groupBy(F.col("p_brand").alias("spec_id")).agg(F.split_part(F.min("p_type"), F.lit(" "), F.lit(1)).alias("w"))
    specs = kinds.select("spec_id", F.array("spec_id").alias("subject_terms"), *[null("array<string>").alias(c) for c in ("subject_any", "metric_any", "period_any", "raw_any")], F.array("w").alias("metric_terms"), F.lit("1").alias("scale"))
    return evaluation.verdicts(specs, evaluation.match_data(evaluation.data_points(evaluation.labelled_nodes(nodes)), specs))


@query("""with p as (select l_orderkey || '-' || l_linenumber proposal_id, 's' || l_suppkey source_id, 'p' || l_partkey target_id, case l_returnflag when 'R' then 'SUPPORTS' when 'A' then 'CAUSES' else 'ODD' end relation_type, 1.05 - l_discount * 5 confidence, l_partkey % 3 batch from lineitem),
g as (select p.* from p join part on target_id = 'p' || p_partkey and p_size > 10 and batch = p_partkey % 3 where l_ok(source_id) and relation_type <> 'ODD' and confidence between 0 and 1)
select source_id, relation_type, target_id, min(proposal_id) proposal_id from g group by 1, 2, 3""".replace("l_ok(source_id)", "substr(source_id, 2)::bigint % 4 <> 0"))
def proposals_ok(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    kind = F.when(F.col("l_returnflag") == "R", "SUPPORTS").when(F.col("l_returnflag") == "A", "CAUSES").otherwise("ODD")
    proposals = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("proposal_id"), key("s", "l_suppkey").alias("source_id"), key("p", "l_partkey").alias("target_id"), kind.alias("relation_type"), (1.05 - F.col("l_discount") * 5).alias("confidence"), (F.col("l_partkey") % 3).alias("batch"))
    nodes = table(spark, sf, "supplier").where("s_suppkey % 4 <> 0").select(key("s", "s_suppkey").alias("id"))
    targets = table(spark, sf, "part").where("p_size > 10").select(key("p", "p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("batch"))
    return views.proposals_ok(proposals, nodes, targets, ["SUPPORTS", "CAUSES"]).select("source_id", "relation_type", "target_id", "proposal_id")


@query("""select conv_id, string_agg('## ' || n || '. ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) order by turn, role, text) markdown from
  (select *, row_number() over (partition by conv_id order by turn, role, text) n from conversations) group by 1""")
def conversation_messages(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.conversation_markdown(table(spark, sf, "conversations"))


@query(_GEO + """ select 'node' kind, node_type name, count(*) n from nd group by 2 union all select 'edge', edge_type, count(*) from ed group by 2""")
def payload_counts(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _geo(spark, sf)
    return views.counts(nodes, edges)


@query(r"""select doc_id, case when length(t) > 88 then substr(t, 1, 87) || '…' else t end label, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') escaped
from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) t from documents)""")
def labels_escaped(spark: SparkSession, sf: str) -> DataFrame:
    t = tx.strip(F.regexp_replace("text", r"(?U)\s+", " "))
    return table(spark, sf, "documents").select("doc_id", tx.truncate("text").alias("label"), tx.escape_html(t).alias("escaped"))


@query("""select event_id, case when v >= 0 and v <= 1 then v end confidence from (select event_id, "value" / 100 v from events)""")
def confidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", vl.confidence((F.col("value") / 100).cast("string")).alias("confidence"))


@query("""select c_mktsegment section_id, c_custkey question_id, ((row_number() over (partition by c_mktsegment order by c_custkey) - 1) // 4 + 1)::bigint batch from customer""")
def question_batches(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("section_id"), F.col("c_custkey").alias("question_id"))
    return ranking.batches(c, ["section_id"], 4, "question_id")


@query("""select o_orderkey, (o_orderdate + interval 20 hour + interval 8 hour)::date shanghai_day, make_date(greatest(2000, year(o_orderdate)::int - 4), 1, 1) window_start from orders""")
def shanghai_days(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + 20 * 3600 * 1000
    return table(spark, sf, "orders").select("o_orderkey", vl.shanghai_date(ms).alias("shanghai_day"), vl.window_start(F.year("o_orderdate")).alias("window_start"))


@query("""with c as (select p_partkey k, p_brand b, p_retailprice::decimal(12,2)::varchar v, p_size, case when p_size % 5 = 0 then 'quote not in source' when p_size % 7 = 0 then 'metric or period missing' end reason, p_size % 3 <> 0 said from part),
g as (select * from c where reason is null), d as (select distinct b from c where reason is null or reason like 'metric%' or said), x as (select distinct b, v from g), k as (select * from c where said),
rel as (select *, case when p_size % 4 = 0 or reason is not null or not said then 'unknown relation type, reference or loop' when p_size % 11 = 0 then 'confidence is not a number from 0 to 1' end fault from c)
select 'node' kind, 'DataPoint' name, count(*) n from x union all select 'node', 'Claim', count(*) from k union all select 'node', 'Entity', count(*) from d union all select 'node', 'Metric', 1 from d having count(*) > 0 union all select 'node', 'Period', 1 from g having count(*) > 0
union all select 'edge', t, count(*) from x, (select unnest(['MEASURES', 'VALID_DURING']) t) group by t union all select 'edge', 'ABOUT', (select count(*) from x) + (select count(*) from k)
union all select 'edge', 'EVIDENCED_BY', (select count(*) from (select distinct b, v, k from g)) + (select count(*) from k) union all select 'edge', 'HAS_DATA', count(*) from k where reason is null
union all select 'rejected', reason, count(*) from (select reason from c where reason is not null union all select 'quote not in source' from c where not said union all select fault from rel where fault is not null) group by reason
union all select 'proposal', 'SUPPORTS', count(*) from rel where fault is null""")
def candidate_registration(spark: SparkSession, sf: str) -> DataFrame:
    """Each part is a source that states its price, a data point that quotes it (some wrongly, some without a period), a
    claim on it and a relation between the two (some of an unknown type, some with a confidence that is no number)."""
    price, size = F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.col("p_size")
    parts = table(spark, sf, "part").select((F.col("p_partkey") * 2).alias("seq"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("source_id"), price.alias("price"), "p_brand", "p_size", "p_name")
    sources = parts.select("source_id", F.concat("p_name", F.lit(" at a price of "), "price").alias("text"))
    proof = lambda quote: F.array(F.struct(F.col("source_id").alias("source_object_id"), quote.alias("quote")))
    value = F.from_json(F.to_json(F.struct(F.col("price").alias("raw"), F.col("price").alias("normalized_decimal"))), candidates.VALUE)
    quote = F.concat(F.when(size % 5 == 0, "cost of ").otherwise("price of "), F.col("price"))
    own = {"seq": F.col("seq"), "chunk_id": F.col("source_id"), "kind": F.lit("data_point"), "local_id": F.lit("d1"), "subject_name": F.col("p_brand"), "metric_name": F.lit("Price"), "period_label": F.when(size % 7 != 0, "2024A"), "value": value, "evidence": proof(quote)}
    says = {"seq": F.col("seq") + 1, "chunk_id": F.col("source_id"), "kind": F.lit("claim"), "local_id": F.lit("k1"), "text": F.concat("p_name", F.lit(" is dear")), "subject_name": F.col("p_brand"), "data_point_local_ids": F.array(F.lit("d1")), "evidence": proof(F.when(size % 3 == 0, "no such words").otherwise(F.lit("at a price")))}
    link = {"seq": F.col("seq"), "chunk_id": F.col("source_id"), "source_local_id": F.lit("d1"), "target_local_id": F.lit("k1"), "relation_type": F.when(size % 4 == 0, "LIKES").otherwise("SUPPORTS"), "confidence": F.when(size % 11 == 0, '"high"').otherwise("0.8")}
    of = lambda schema, *kinds: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [parts.select(*[c.alias(n) for n, c in k.items()]) for k in kinds], spark.createDataFrame([], schema))
    made = candidates.register(of(candidates.CANDIDATE, own, says), of(candidates.RELATION, link), sources, parts.select(F.col("source_id").alias("chunk_id"), "source_id"))
    count = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count(made.nodes, "node", "node_type").union(count(made.edges, "edge", "edge_type")).union(count(made.rejected, "rejected", "reason")).union(count(made.proposals, "proposal", "relation_type"))


#: Orders as propositions in chains of 64, each resting on the one before it, each 16th one on the one five before as well.
_CHAINS = """
with recursive o as (select o_orderkey k, o_custkey, o_orderstatus, o_orderkey // 64 g, row_number() over (partition by o_orderkey // 64 order by o_orderkey) p from orders),
e as (select a.k id, b.k parent from o a join o b on a.g = b.g and (b.p = a.p - 1 or (a.p % 16 = 0 and b.p = a.p - 5))),
r as (select k id, k anc from o union select r.id, e.parent from r join e on r.anc = e.id),
ln as (select distinct l_orderkey k, l_orderkey * 10 + l_linenumber evidence_id from lineitem)"""


def _chains(spark, sf):
    """(id, parent_id) of the orders' chains, and (id, evidence_id) of their lines."""
    g = F.floor(F.col("o_orderkey") / 64)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), g.alias("g"))
    o = o.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    back = F.explode(F.when(F.col("p") % 16 == 0, F.array(F.lit(1), F.lit(5))).otherwise(F.array(F.lit(1)))).alias("back")
    rests = o.select(F.col("k").alias("id"), "g", "p", back).select("id", "g", (F.col("p") - F.col("back")).alias("p"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"))
    return rests.join(o.select("g", "p", F.col("k").alias("parent_id")), ["g", "p"]).select("id", "parent_id"), lines


@query(_CHAINS + """ select r.id, count(distinct evidence_id) n from r join ln on r.anc = ln.k group by r.id""")
def evidence_closure(spark: SparkSession, sf: str) -> DataFrame:
    """How many pieces of evidence each proposition of chains 64 deep rests on."""
    rests, lines = _chains(spark, sf)
    return closure.sizes(closure.evidence_sets(rests, closure.numbered(lines)[0]))


@query(_CHAINS + """, c as (select * from (select c_nationkey section_id, k id, row_number() over (partition by c_nationkey order by o_custkey, k) n from o join customer on o_custkey = c_custkey where o_orderstatus <> 'P') where n <= 16),
v as (select distinct section_id, evidence_id from c join r using (id) join ln on r.anc = ln.k)
select section_id, evidence_id, place from (select *, row_number() over (partition by section_id order by evidence_id)::int place from v) where place <= 20""")
def section_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence baseline of sections (nations): the first claims (orders) that hold and answer its questions (customers)."""
    rests, lines = _chains(spark, sf)
    own, numbers = closure.numbered(lines)
    asked = table(spark, sf, "customer").select(F.col("c_nationkey").alias("section_id"), F.col("c_custkey").alias("question_id"), F.col("c_custkey").alias("place"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    claims = closure.section_claims(asked, orders.drop("o_orderstatus"), orders.where("o_orderstatus <> 'P'").select("id"))
    return closure.section_evidence(closure.evidence_sets(rests, own), numbers, claims)


#: Graphs of ten documents each, with faults by number: the tables of the validator, as SQL.
_AUDITED = r"""
with d as (select doc_id k, doc_id // 10 g, coalesce(text, '') t, coalesce(regexp_extract(text, '[A-Za-z]{3,}'), '') w, lead(doc_id) over (partition by doc_id // 10 order by doc_id) nx from documents),
src as (select g, case when k % 97 <> 5 then 'S' || k end id, case when k % 13 = 0 then 'DX' else 'D' || g end document_id, t, case when k % 5 = 0 then '0' else sha256(t) end sha, ['EXTRACTED', 'NO_CLAIM', 'ODD', 'ERROR'][k % 4 + 1] st from d),
ev as (select g, k, 'C' || k node, case when k % 14 = 1 then 'Snone' else 'S' || k end source, case when k % 7 = 0 then 'no such words at all' else w end q, k % 15 <> 2 hash_ok, case k % 3 when 0 then 'exact' when 1 then 'whitespace_normalized' else 'fuzzy' end m from d where k % 12 <> 11),
nd as (select g, 'C' || k id, 'Claim' ty, case when k % 6 = 0 then ' ' else 'says' end label, 'EXPLICIT' lv, k from d union all select g, 'P' || k, 'DataPoint', 'point', 'INFERRED', k from d union all select g, 'R' || k, 'ReasoningStep', 'step', 'INFERRED', k from d
  union all select g, 'O' || k, 'Thing', '', 'EXPLICIT', k from d where k % 21 = 8 union all select distinct g, unnest(['E', 'M', 'T']) || g, unnest(['Entity', 'Metric', 'Period']), 'x', 'EXPLICIT', null::bigint from d
  union all select distinct g, null, 'Entity', 'x', 'EXPLICIT', null::bigint from d where g % 12 = 0),
ed as (select g, 'e' || k id, 'EVIDENCED_BY' ty, 'C' || k a, 'S' || k b, 'EXPLICIT' lv, null::double sure, true backed from d where k % 10 <> 1
  union all select g, 'p' || k, 'PREMISE_OF', 'P' || k, 'R' || k, 'EXPLICIT', null, true from d where k % 22 <> 9 union all select g, 'r' || k, 'CONCLUDES', 'R' || k, 'C' || k, 'EXPLICIT', null, true from d
  union all select g, 's' || k, 'SUPPORTS', 'C' || k, 'C' || nx, case when k % 2 = 0 then 'INFERRED' else 'EXPLICIT' end, case when k % 8 = 0 then 0.6 else 0.7 end, k % 9 <> 0 from d where nx is not null
  union all select g, 'S' || k, 'ASSUMES', 'C' || k, 'lost', 'EXPLICIT', null, true from d where k % 11 = 0 union all select g, 'v' || k, 'EVIDENCED_BY', 'C' || k, 'Slost', 'EXPLICIT', null, true from d where k % 23 = 10
  union all select g, case when k % 2 = 0 then 'l' || k end, 'LIKES', 'C' || k, 'P' || k, 'EXPLICIT', null, true from d where k % 24 = 11 union all select g, 'g' || k, 'ABOUT', 'gone', 'E' || g, 'EXPLICIT', null, true from d where k % 25 = 12
  union all select g, 'q' || k, 'CONCLUDES', 'R' || k, 'C' || k, 'EXPLICIT', null, true from d where k % 26 = 13
  union all select g, 'b' || k, 'SUPPORTS', 'C' || nx, 'C' || k, 'EXPLICIT', null, true from d where nx is not null and k % 10 = 4 and g % 13 = 0),
gs as (select distinct g from d)"""


@query(_AUDITED + r""",
cl as (select g, a, b from ed where ty = 'SUPPORTS'), cyc as (select distinct g from d where nx is not null and k % 10 = 4 and g % 13 = 0),
semantic as (select * from nd where ty in ('Claim', 'DataPoint')), x as (
select g, 'SCHEMA_VERSION' code from gs where g % 7 = 0 union all select g, 'ROOT_FIELDS' from gs where g % 5 = 0 union all select g, 'STATE_HASH' from gs where g % 6 = 0 union all select g, 'SOURCE_FILE_EXISTS' from gs where g % 4 = 0
union all select g, 'SOURCE_FILE_HASH' from gs where g % 4 <> 0 and g % 9 = 1 union all select g, 'COVERAGE_STATUS_COUNTS' from gs where g % 8 = 0 union all select g, 'COVERAGE_TERMINAL' from gs where g % 10 = 3 union all select g, 'COVERAGE_EVIDENCE' from gs where g % 11 = 0
union all (select g, 'UNIQUE_IDS' from (select g, id from src union all select g, id from nd union all select g, id from ed union all select g, 'D' || g from gs) where id is not null group by g, id having count(*) > 1)
union all (select g, 'SOURCE_IDS' from src group by g, id having count(*) > 1 or id is null) union all (select g, 'NODE_IDS' from nd group by g, id having count(*) > 1 or id is null) union all (select g, 'EDGE_IDS' from ed group by g, id having count(*) > 1 or id is null)
union all select g, 'SOURCE_DOCUMENT' from src where document_id = 'DX' union all select g, 'SOURCE_HASH' from src where sha = '0' union all select g, 'SOURCE_STATUS' from src where st = 'ODD' union all select g, 'SOURCE_ERROR' from src where st = 'ERROR'
union all select g, 'EDGE_TYPE' from ed where ty = 'LIKES' union all select g, 'EDGE_SOURCE' from ed where a not in (select id from nd where id is not null) union all select g, 'EVIDENCE_TARGET' from ed where ty = 'EVIDENCED_BY' and b not in (select id from src where id is not null)
union all select g, 'EDGE_TARGET' from ed where ty <> 'EVIDENCED_BY' and b not in (select id from nd where id is not null) union all (select g, 'DUPLICATE_EDGE' from ed group by g, ty, a, b having count(*) > 1)
union all select g, 'UNVERIFIED_INFERRED_EDGE' from ed where ty = 'SUPPORTS' and lv = 'INFERRED' and sure < 0.65 union all select g, 'EXPLICIT_RELATION_EVIDENCE' from ed where ty = 'SUPPORTS' and lv = 'EXPLICIT' and not backed
union all select ev.g, 'NODE_EVIDENCE_REF' from ev where source not in (select id from src where id is not null)
union all select ev.g, 'EVIDENCE_QUOTE_HASH' from ev where source in (select id from src where id is not null) and not hash_ok
union all select ev.g, 'EVIDENCE_QUOTE' from ev join src on source = id where m = 'fuzzy' or (m = 'exact' and not contains(t, q)) or (m <> 'exact' and not contains(regexp_replace(t, '\s+', '', 'g'), regexp_replace(q, '\s+', '', 'g')))
union all (select g, 'EVIDENCE_EDGE_PARITY' from (select distinct coalesce(o.g, l.g) g, coalesce(o.node, l.a) n from ev o full join (select * from ed where ty = 'EVIDENCED_BY') l on o.node = l.a and o.source = l.b where o.node is null or l.a is null))
union all select g, 'NODE_TYPE' from nd where ty = 'Thing' union all select g, 'NODE_LABEL' from nd where ty <> 'Thing' and trim(label) = '' union all select g, 'EXPLICIT_NODE_EVIDENCE' from nd where ty = 'Claim' and k % 12 = 11
union all select g, 'DATA_CONTEXT' from d where k % 16 = 3 union all select g, 'DATA_CONTEXT' from d where k % 17 = 4 union all select g, 'DATA_RANGE' from d where k % 5 = 1 union all select g, 'DATA_VALUE_KIND' from d where k % 5 = 2 union all select g, 'DATA_DECIMAL' from d where k % 5 = 3
union all select g, 'DATA_RAW_EVIDENCE' from d where k % 2 = 0 union all select g, 'REASONING_SHAPE' from d where k % 18 = 5
union all select g, 'REASONING_PREMISE' from d where k % 18 <> 5 and (k % 19 = 6 or k % 22 = 9) union all select g, 'REASONING_CONCLUSION' from d where k % 20 = 7
union all select d.g, 'ARGUMENT_DAG' from d join cyc using (g) where k % 10 <= 5
union all select g, 'CORE_CLAIM_WITHOUT_ARGUMENT' from d where k % 3 = 0 and 'C' || k not in (select b from cl))
select code, count(*) n, count(distinct g) graphs from x group by code""")
def audit_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The whole validator over a graph for each ten documents, with faults of 35 kinds by number."""
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select(k.alias("k"), F.floor(k / 10).alias("g"), F.coalesce("text", F.lit("")).alias("t"), F.coalesce(F.regexp_extract("text", "[A-Za-z]{3,}", 0), F.lit("")).alias("w"))
    d = d.withColumn("nx", F.lead("k").over(Window.partitionBy("g").orderBy("k")))
    k, g = F.col("k"), F.col("g")
    of = lambda prefix, c=k: F.concat(F.lit(prefix), c.cast("string"))
    null, graph_id = F.lit(None).cast("string"), F.col("g").cast("string").alias("graph_id")
    pick = lambda by, *values: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))

    status = pick(k % 4, "EXTRACTED", "NO_CLAIM", "ODD", "ERROR").alias("processing_status")
    sources = d.select(graph_id, F.when(k % 97 != 5, of("S")).alias("id"), F.when(k % 13 == 0, "DX").otherwise(of("D", g)).alias("document_id"), F.col("t").alias("raw_text"), F.col("t").alias("normalized_text"), F.when(k % 5 == 0, "0").otherwise(tx.sha256("t")).alias("sha256"), status)

    told = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[F.count_if((k % 97 != 5) & (k % 4 == i)).alias(f"s{i}") for i in range(4)], F.count_if(k % 12 != 11).alias("backed"))
    counts = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(s), (F.col(f"s{i}") + F.when(g % 8 == 0, 1).otherwise(0)).alias("n")) for i, s in enumerate(("EXTRACTED", "NO_CLAIM", "ODD", "ERROR"))]), lambda e: e["n"] > 0))
    root = F.to_json(F.struct(*[F.lit(1).alias(f) for f in validation.ROOT_FIELDS if f != "coverage_manifest"], F.when(g % 5 != 0, 1).alias("coverage_manifest")))
    body = tx.sha256(of("body", g))
    headers = told.select(
        graph_id,
        root.alias("json"),
        F.when(g % 7 == 0, "old").otherwise("v1").alias("schema_version"),
        F.when(g % 6 == 0, "x").otherwise(body).alias("state_hash"),
        body.alias("computed"),
        of("D", g).alias("document_id"),
        of("f", g).alias("local_path"),
        F.when(g % 9 == 1, "x").otherwise(body).alias("sha256"),
        counts.alias("status_counts"),
        (F.col("n") + F.when(g % 10 == 3, 1).otherwise(0)).alias("terminal"),
        F.when(g % 11 == 0, 0.25).otherwise(F.bround(F.col("backed") / (2 * F.col("n")), 6)).alias("evidence_coverage"),
    )
    files = told.where("g % 4 <> 0").select(of("f", g).alias("local_path"), of("body", g).cast("binary").alias("content"))

    quote = F.when(k % 7 == 0, "no such words at all").otherwise(F.col("w"))
    proof = F.struct(F.when(k % 14 == 1, "Snone").otherwise(of("S")).alias("source_object_id"), quote.alias("quote"), F.when(k % 15 == 2, "x").otherwise(tx.sha256(quote)).alias("quote_sha256"), pick(k % 3, "exact", "whitespace_normalized", "fuzzy").alias("match_mode"))
    value = F.struct(pick(k % 5, "scalar", "range", "odd", "scalar", "text").alias("kind"), F.when(k % 2 == 0, "12").otherwise("some").alias("raw"), F.when(k % 5 == 3, "abc").otherwise("12").alias("normalized_decimal"), F.lit("5").alias("range_low"), F.lit("3").alias("range_high"), F.lit("1").alias("scale"))
    node = lambda rows, i, ty, label, level, **more: rows.select(graph_id, i.alias("id"), F.lit(ty).alias("node_type"), label.alias("label"), F.lit(level).alias("assertion_level"), *[c.alias(n) for n, c in more.items()])
    once = d.select("g").distinct()
    kinds = [
        node(d, of("C"), "Claim", F.when(k % 6 == 0, " ").otherwise("says"), "EXPLICIT", importance=F.when(k % 3 == 0, "core"), claim_role=F.lit("forecast"), evidence=F.when(k % 12 != 11, F.array(proof))),
        node(d, of("P"), "DataPoint", F.lit("point"), "INFERRED", subject_ref=of("E", g), metric_ref=F.when(k % 16 == 3, of("E", g)).otherwise(of("M", g)), period_ref=F.when(k % 17 != 4, of("T", g)), value=value),
        node(d, of("R"), "ReasoningStep", F.lit("step"), "INFERRED", premise_node_ids=F.when(k % 18 == 5, F.array().cast("array<string>")).otherwise(F.array(F.when(k % 19 == 6, "lost").otherwise(of("P")))), conclusion_claim_ids=F.array(F.when(k % 20 == 7, of("P")).otherwise(of("C")))),
        node(d.where("k % 21 = 8"), of("O"), "Thing", F.lit(""), "EXPLICIT"),
        *[node(once, of(t[0] if t != "Period" else "T", g), t, F.lit("x"), "EXPLICIT") for t in ("Entity", "Metric", "Period")],
        node(once.where("g % 12 = 0"), null, "Entity", F.lit("x"), "EXPLICIT"),
    ]
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kinds)

    def edge(rows, i, ty, a, b, level=F.lit("EXPLICIT"), sure=F.lit(None).cast("double"), backed=F.lit(True)):
        return rows.select(graph_id, i.alias("id"), F.lit(ty).alias("edge_type"), a.alias("source_id"), b.alias("target_id"), level.alias("assertion_level"), F.lit("active").alias("status"), F.lit("accept").alias("verdict"), sure.alias("verdict_confidence"), backed.alias("has_evidence"))

    following = d.where("nx is not null")
    edges = reduce(
        DataFrame.union,
        [
            edge(d.where(k % 10 != 1), of("e"), "EVIDENCED_BY", of("C"), of("S")),
            edge(d.where(k % 22 != 9), of("p"), "PREMISE_OF", of("P"), of("R")),
            edge(d, of("r"), "CONCLUDES", of("R"), of("C")),
            edge(following, of("s"), "SUPPORTS", of("C"), of("C", F.col("nx")), F.when(k % 2 == 0, "INFERRED").otherwise("EXPLICIT"), F.when(k % 8 == 0, 0.6).otherwise(0.7), k % 9 != 0),
            edge(d.where(k % 11 == 0), of("S"), "ASSUMES", of("C"), F.lit("lost")),
            edge(d.where(k % 23 == 10), of("v"), "EVIDENCED_BY", of("C"), F.lit("Slost")),
            edge(d.where(k % 24 == 11), F.when(k % 2 == 0, of("l")), "LIKES", of("C"), of("P")),
            edge(d.where(k % 25 == 12), of("g"), "ABOUT", F.lit("gone"), of("E", g)),
            edge(d.where(k % 26 == 13), of("q"), "CONCLUDES", of("R"), of("C")),
            edge(following.where((k % 10 == 4) & (g % 13 == 0)), of("b"), "SUPPORTS", of("C", F.col("nx")), of("C")),
        ],
    )
    found, _ = audit.audit(headers, files, sources, nodes, edges, "v1")
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("graph_id").alias("graphs"))


@query(_TRADE + r""", nodes as (select 's' || s_suppkey id, 'Entity' node_type, s_name "label", 'company' entity_type from supplier union all select 'p' || p_partkey, 'Entity', p_name, 'product' from part),
edges as (select source_id || '-' || target_id id, edge_type, source_id, target_id, 'EXPLICIT' assertion_level from tr),
ev as (select 'p' || l_partkey id, l_orderkey seq, {'source_object_id': 'o' || l_orderkey, 'quote': 'line ' || l_linenumber || ' of order ' || l_orderkey} x from lineitem),
m as (select 'p' || p_partkey id, {'id': p_brand, 'description': p_type, 'status': 'PASS'} x from part where p_size <= 25 union all select 'p' || p_partkey, {'id': 'size', 'description': p_size::varchar, 'status': 'MISS'} from part where p_size % 2 = 0),
le as (select id, count(*) n, list(x order by seq, to_json(x)) xs from ev group by id), lm as (select id, count(*) n, list(x order by x.id) xs from m group by id),
lk as (select e.id, count(*) n, list(x order by x.id) xs from (select unnest([source_id, target_id]) id, {'id': id, 'edge_type': edge_type, 'source_id': source_id, 'target_id': target_id, 'assertion_level': assertion_level} x from edges) e group by e.id)
select nodes.id, '{' || array_to_string(list_filter([substr(to_json({'id': nodes.id, 'node_type': node_type, 'label': "label", 'entity_type': entity_type})::varchar, 2, length(to_json({'id': nodes.id, 'node_type': node_type, 'label': "label", 'entity_type': entity_type})::varchar) - 2),
  '"n_evidence":' || coalesce(le.n, 0), '"n_benchmark_matches":' || coalesce(lm.n, 0), '"n_edges":' || coalesce(lk.n, 0),
  '"evidence":' || to_json(le.xs[1:3])::varchar, '"benchmark_matches":' || to_json(lm.xs[1:1])::varchar, '"edges":' || to_json(lk.xs[1:5])::varchar], lambda x: x is not null), ',') || '}' "json"
from nodes left join le on nodes.id = le.id left join lm on nodes.id = lm.id left join lk on nodes.id = lk.id""")
def payload_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts as nodes of the viewer, with lines as evidence, brands as benchmark items and trade as edges."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    suppliers, parts = table(spark, sf, "supplier"), table(spark, sf, "part")
    node = lambda rows, i, label, kind: rows.select(i.alias("id"), F.lit("Entity").alias("node_type"), F.col(label).alias("label"), F.lit(kind).alias("entity_type"))
    nodes = node(suppliers, key("s", "s_suppkey"), "s_name", "company").union(node(parts, key("p", "p_partkey"), "p_name", "product"))
    edges = _trade(spark, sf).select(F.concat_ws("-", "source_id", "target_id").alias("id"), "edge_type", "source_id", "target_id", F.lit("EXPLICIT").alias("assertion_level"))
    quote = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of order "), F.col("l_orderkey").cast("string"))
    proof = table(spark, sf, "lineitem").select(key("p", "l_partkey").alias("node_id"), F.col("l_orderkey").alias("seq"), key("o", "l_orderkey").alias("source_object_id"), quote.alias("quote"))
    item = lambda rows, i, description, status: rows.select(key("p", "p_partkey").alias("object_id"), i.alias("item_id"), description.alias("description"), F.lit(status).alias("status"))
    matches = item(parts.where("p_size <= 25"), F.col("p_brand"), F.col("p_type"), "PASS").union(item(parts.where("p_size % 2 = 0"), F.lit("size"), F.col("p_size").cast("string"), "MISS"))
    return payload.node_documents(nodes, proof, matches, edges, {"evidence": 3, "benchmark_matches": 1, "edges": 5})


@query("""with o as (select *, row_number() over (partition by c_nationkey order by o_orderkey) n, count(*) over (partition by c_nationkey) total from orders join customer on o_custkey = c_custkey),
r as (select c_nationkey nation, total, n, (n - 1) // 30 + 1 page, case o_orderkey % 10 when 1 then 'identity_mismatch' when 2 then 'unsupported_pdf_path' when 3 then 'announcement_id_mismatch' when 4 then 'invalid_publication_time' when 5 then 'publication_date_mismatch'
  else case when o_orderdate not between timestamp '1996-01-01' and timestamp '2000-12-31' then 'publication_date_mismatch' when o_orderkey % 10 = 6 then 'missing_title' end end reason from o),
e as (select nation, max(total) total, case when nation % 7 = 3 and max(page) > 1 then 'total changed between pages' when nation % 7 = 4 and max(page) > 1 then 'announcements have an unexpected shape' when nation % 7 = 5 then 'response is no object' when nation % 7 = 6 and max(page) > 1 then 'page was not landed' end error,
  least(max(page), 20) pages, count(*) filter (page <= 20 and reason is null) usable, count(*) filter (page <= 20 and reason is not null) unusable from r group by nation)
select nation::int nation, case when error is null then total end total_hits, case when error is null then pages end pages_read, case when error is null then pages * 30 < total end truncated, error,
  case when error is null then usable else 0 end usable, case when error is null then unusable else 0 end unusable from e""")
def announcement_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as announcements of nations, landed as pages of 30 (some nations' searches gone wrong), read back and checked."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    by = Window.partitionBy("c_nationkey")
    at = F.row_number().over(by.orderBy("o_orderkey"))
    o = o.withColumn("n", at).withColumn("total", F.count(F.lit(1)).over(by)).withColumn("page", F.floor((F.col("n") - 1) / announcements.PAGE_SIZE) + 1)
    hit = _announcements(spark, sf).withColumnRenamed("seq", "o_orderkey")
    k, code = F.col("c_nationkey"), F.lpad(F.col("c_nationkey").cast("string"), 6, "0")
    hit = o.select("o_orderkey", "c_nationkey", "n", "page", "total").join(hit, "o_orderkey").withColumn("secCode", F.when(F.col("secCode") == "X", "X").otherwise(code))
    fields = F.struct("secCode", "orgId", "adjunctUrl", "announcementId", "announcementTime", "announcementTitle")
    pages = hit.groupBy("c_nationkey", "page", "total").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", fields.alias("hit")))), lambda x: x["hit"]).alias("announcements"))
    second = F.col("page") == 2
    total = F.when(second & (k % 7 == 3), F.col("total") + 1).otherwise(F.col("total")).alias("totalAnnouncement")
    body = F.when(k % 7 == 5, F.lit("[]")).when(second & (k % 7 == 4), F.to_json(F.struct(total, F.lit("none").alias("announcements")))).otherwise(F.to_json(F.struct(total, "announcements")))
    form = F.to_json(F.struct(F.col("page").cast("string").alias("pageNum"), F.concat(code, F.lit(",org")).alias("stock"), F.lit("2016-01-01~2020-12-31").alias("seDate")))
    path = f"{shared_dir(spark)}/ledgerloom/landed-{uuid.uuid4().hex}"
    pages.where(~(second & (k % 7 == 6))).select(announcements.landed_line(form, body)).write.text(path)
    searches, found = announcements.scan(announcements.read_pages(spark, path), 20)
    n = found.groupBy("search").agg(F.count_if(F.col("reason").isNull()).alias("usable"), F.count_if(F.col("reason").isNotNull()).alias("unusable"))
    nation = F.get_json_object("search", "$.stock").substr(1, 6).cast("int").alias("nation")
    return searches.join(n, "search", "left").select(nation, "total_hits", "pages_read", "truncated", "error", F.coalesce("usable", F.lit(0)).alias("usable"), F.coalesce("unusable", F.lit(0)).alias("unusable"))


@query(r"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\r\n')), lambda x: x <> '') ls from documents),
c as (select doc_id, flatten(list_transform(ls, lambda x: list_transform(range(0, ((length(x) - 1) // 2600 + 1)::bigint), lambda i: substr(x, (i * 2600 + 1)::bigint, 2600)))) cs from l where len(ls) > 0),
f as (select doc_id, string_split(list_reduce(cs, lambda a, x: case when length(string_split(a, chr(30))[-1]) + 1 + length(x) > 2600 then a || chr(30) || x else a || chr(10) || x end), chr(30)) ts from c),
t as (select doc_id, i - 1 chunk, ts[i] x from (select doc_id, ts, unnest(range(1, len(ts) + 1)) i from f))
select 'SO_' || upper(substr(sha256(doc_id || chr(31) || chunk), 1, 16)) id, doc_id, chunk::int chunk, length(trim(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g')))::int n_chars,
  len(list_distinct(list_transform(list_filter(regexp_extract_all(x, '[A-Za-z]\d|\d[\d,]*(?:\.\d+)?'), lambda m: regexp_matches(m, '^\d')), lambda m: replace(m, ',', ''))))::int numbers,
  round(list_sum(list_transform(['the', 'tion'], lambda q: (3 + length(q)) * least((length(lower(x)) - length(replace(lower(x), q, ''))) // length(q), 4))) + 0.3::double * len(list_intersect(['the', 'tion'], list_distinct(regexp_extract_all(lower(x), '[a-z][a-z0-9_]+')))), 4) score from t""")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents with their id, length, numbers and relevance, as SQL text over the registered functions."""
    registered.register(spark)
    return spark.sql(
        """select stable_id('SO', array(cast(doc_id as string), cast(chunk as string))) id, doc_id, chunk, length(norm_text(chunk_text)) n_chars, size(number_tokens(chunk_text)) numbers,
           round(relevance_score(chunk_text, array('the', 'tion')), 4) score from {documents} d, lateral text_chunks(d.text, 2600)""",
        documents=table(spark, sf, "documents"),
    )


@query(_FOLD.format(most=2800) + r""" select doc_id, block::int block, format('SO_P001_B{:03d}', block) block_id, sha256(raw) sha256 from b""")
def sql_source_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Source blocks of all documents by the table function."""
    registered.register(spark)
    return spark.sql("select doc_id, block, block_id, sha256 from {documents} d, lateral source_blocks(1, d.text, 2800)", documents=table(spark, sf, "documents"))


#: Turns as messages of six shapes (a string, a text, parts, a list, a number, null) in answers of four: bare, in a fence, in prose, cut off.
_SHAPES = r"""with m as (select conv_id, turn, role, text, (turn % 6)::int shape, (conv_id % 4)::int wrap from conversations)"""


def _answers(spark, sf):
    k, wrap = F.col("turn") % 6, F.col("conv_id") % 4
    whole = F.to_json(F.struct(F.col("text").alias("a")))
    q = F.substring(whole, F.lit(6), F.length(whole) - 6)
    pointer = ',{"text":"more"},{"content_type":"image_asset_pointer","asset_pointer":"p1"},{"content_type":"audio"},7]}'
    shapes = (q, F.concat(F.lit('{"text":'), q, F.lit("}")), F.concat(F.lit('{"parts":['), q, F.lit(","), q, F.lit(pointer)), F.concat(F.lit("["), q, F.lit("]")), F.col("turn").cast("string"), F.lit("null"))
    content = F.coalesce(*[F.when(k == i, x) for i, x in enumerate(shapes)])
    body = F.concat(F.lit('{"id":"'), F.concat_ws(":", "conv_id", "turn"), F.lit('","content":'), content)
    forms = (("", "}"), ("```json\n", "}\n```"), ('As {asked} [1, see "x{": ', "} {end}"), ("no {braces that close: ", ""))
    answer = F.coalesce(*[F.when(wrap == i, F.concat(F.lit(a), body, F.lit(b))) for i, (a, b) in enumerate(forms)])
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.try_parse_json(vr.first_json(answer)).alias("v"))


@query(_SHAPES + r""" select conv_id, turn, role, case when wrap = 3 then [null, 'OBJECT', 'OBJECT', 'ARRAY', null, null][shape + 1] else ['STRING', 'OBJECT', 'OBJECT', 'ARRAY', 'NUMBER', 'VOID'][shape + 1] end kind,
  case when shape = 1 or (shape = 0 and wrap <> 3) then text when shape = 2 then trim(text || chr(10) || chr(10) || text || chr(10) || chr(10) || 'more' || chr(10) || chr(10) || '[Image attachment: p1]', E' \t\r\n') else '' end text from m""")
def variant_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The kind and the text of what answers hold as content; of an answer cut off, the first value in it that is whole."""
    content = F.coalesce(F.try_variant_get("v", "$.content", "variant"), F.col("v"))
    rows = _answers(spark, sf).select("conv_id", "turn", "role", content.alias("c"))
    return rows.select("conv_id", "turn", "role", vr.kind("c").alias("kind"), vr.content_text("c").alias("text"))


@query(_SHAPES + r""", p(shape, path, kind) as (values (0, '$.content', 'STRING'), (1, '$.content', 'OBJECT'), (2, '$.content', 'OBJECT'), (3, '$.content', 'ARRAY'), (4, '$.content', 'NUMBER'), (5, '$.content', 'VOID'),
  (1, '$.content.text', 'STRING'), (2, '$.content.parts', 'ARRAY'), (3, '$.content[0]', 'STRING'), (2, '$.content.parts[0]', 'STRING'), (2, '$.content.parts[1]', 'STRING'), (2, '$.content.parts[2]', 'OBJECT'), (2, '$.content.parts[3]', 'OBJECT'), (2, '$.content.parts[4]', 'OBJECT'), (2, '$.content.parts[5]', 'NUMBER')),
x as (select shape, '$.id' path, 'STRING' kind, conv_id || ':' || turn scalar from m where wrap <> 3 union all
  select shape, path, kind, case when kind = 'STRING' then text when path = '$.content' and kind = 'NUMBER' then turn::varchar when kind = 'NUMBER' then '7' end from m join p using (shape) where wrap <> 3)
select path, kind, count(*) n, sum(length(scalar))::bigint chars from x group by path, kind""")
def variant_entries(spark: SparkSession, sf: str) -> DataFrame:
    """What stands at each path of the whole answers, three levels deep."""
    rows = vr.entries(_answers(spark, sf).where("conv_id % 4 <> 3"), "v", 3)
    return rows.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("scalar")).alias("chars"))


_STATEMENTS = _RECORDS + r""",
t as (select entity, "year", "quarter", make_date("year"::int, ("quarter" * 3)::int, 1) pe, revenue, "cost", research, volume from rec),
ok as (select *, case when "quarter" = 2 then 2 when "quarter" = 4 then 4 else 1 end k from t where not ("quarter" = 1 and "year" % 3 = 0) and pe + interval 40 day < timestamp '2000-07-01' - interval 8 hour),
v as (select entity, pe, "year", 'Q' || "quarter" fp, 'operating_income' metric, revenue::decimal(18,2) x, 0 r from ok union all select entity, pe, "year", 'Q' || "quarter", 'operating_income', revenue::decimal(18,2) + 1000000, 1 from ok where "quarter" = 2
  union all select entity, pe, "year", 'Q' || "quarter", 'operating_costs', round("cost")::decimal(18,2), 0 from ok union all select entity, pe, "year", 'Q' || "quarter", 'research_and_development_expenses', round(research)::decimal(18,2), 0 from ok where entity < 'M'
  union all select entity, pe, "year", 'Q' || "quarter", 'total_assets', volume::decimal(18,2), 0 from ok),
f as (select *, 'fact' kind from v),
g as (select a.entity, a.pe, a."year", a.fp, 'total_assets_yoy' metric, round_even((a.x - b.x)::double / abs(b.x)::double * 100, 2) x, 'computed' kind from v a join v b on a.entity = b.entity and a.metric = b.metric and a.fp = b.fp and a."year" = b."year" + 1 where a.metric = 'total_assets'
  and a."year" = (select max("year") from v c where c.entity = a.entity and c.fp = a.fp and c.metric = 'total_assets')),
l as (select entity, pe, "year", fp, metric, arg_max(x, r) x from v group by all),
m as (select a.entity, a.pe, a."year", a.fp, 'gross_margin' metric, round_even((a.x - b.x)::double / a.x::double * 100, 2) x, 'computed' kind from l a join l b using (entity, pe) where a.metric = 'operating_income' and b.metric = 'operating_costs'
  union all select a.entity, a.pe, a."year", a.fp, 'rd_expense_ratio', round_even(b.x::double / a.x::double * 100, 2), 'computed' from l a join l b using (entity, pe) where a.metric = 'operating_income' and b.metric = 'research_and_development_expenses')"""


@query(_STATEMENTS + r"""
select entity, metric, kind, pe::varchar period_end, fp fiscal_period, "year"::bigint fiscal_year, x::double "value", case when metric in ('operating_income', 'gross_margin', 'rd_expense_ratio') and fp = 'Q2' then 'contested' else 'reportable' end status, 1::bigint evidence, 0::bigint inputs from f
union all select entity, metric, kind, pe::varchar, fp, "year", x, case when metric <> 'total_assets_yoy' and fp = 'Q2' then 'contested' else 'reportable' end, 0, 2 from (select * from g union all select * from m)""")
def statement_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Quarters of nations as three statement tables (second quarters restated, some undisclosed) to facts, growth and ratios."""
    money = lambda c: (F.round(c) if c in ("cost", "research") else F.col(c)).cast("decimal(18,2)")
    end = F.make_date(F.col("year").cast("int"), (F.col("quarter") * 3).cast("int"), F.lit(1))
    ms = F.unix_date(end).cast("long") * statements.DAY_MS
    late = F.when((F.col("quarter") == 1) & (F.col("year") % 3 == 0), None).otherwise(ms + 40 * statements.DAY_MS)
    head = ["entity", F.col("year").alias("fiscal_year"), F.concat(F.lit("Q"), F.col("quarter").cast("string")).alias("fiscal_period"), late.alias("report_date_ms"), ms.alias("period_end_ms")]
    base = _records(spark, sf)
    income = base.select(*head, money("revenue").alias("operating_income"), money("cost").alias("operating_costs"), F.when(F.col("entity") < "M", money("research")).alias("research_and_development_expenses"), F.lit(0).alias("record_index"))
    again = base.where("quarter = 2").select(*head, (money("revenue") + 1000000).alias("operating_income"), F.lit(None).cast("decimal(18,2)").alias("operating_costs"), F.lit(None).cast("decimal(18,2)").alias("research_and_development_expenses"), F.lit(1).alias("record_index"))
    income = income.withColumn("record_index", F.col("period_end_ms") * 2).unionByName(again.withColumn("record_index", F.col("period_end_ms") * 2 + 1))
    balance = base.select(*head, money("volume").alias("total_assets"), F.lit("see notes").alias("remark"), F.lit(True).alias("audited"))
    cash = base.select(*head, money("volume").alias("net_cash_flow_from_operating_activities"))
    plans = base.select("entity").distinct().select("entity", F.lit("q1").alias("question_id"), F.array(F.lit("total_assets"), F.lit("remark"), F.lit("unknown")).alias("metric_ids"), F.array(F.lit("gross_margin"), F.lit("rd_expense_ratio"), F.lit("total_assets_yoy"), F.lit("remark_yoy")).alias("derived_ids"))
    made, _, _ = statements.ingest([statements.records(n, t) for n, t in (("income", income), ("balance", balance), ("cashflow", cash))], plans, "2000-06-30")
    count = lambda t: made.edges.where(F.col("edge_type") == t).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias(t))
    rows = made.propositions.join(count("GROUNDED_IN"), "id", "left").join(count("CALCULATED_FROM"), "id", "left")
    return rows.select("entity", "metric", "kind", "period_end", "fiscal_period", "fiscal_year", F.col("value").cast("double").alias("value"), "status", F.coalesce("GROUNDED_IN", F.lit(0)).alias("evidence"), F.coalesce("CALCULATED_FROM", F.lit(0)).alias("inputs"))


@query(_TURNS + """, e as (select source_id, target_id, conv_id from ch union all select b.id, a.id, a.conv_id from t a join t b on a.conv_id = b.conv_id and a.turn = 1 and b.turn = 2 where length(b.text) < length(a.text)
  union all select b.id, a.id, a.conv_id from t a join t b on a.conv_id = b.conv_id and a.turn = 3 and b.turn = 5 where a.conv_id % 3 = 0 union all select id, id, conv_id from t where turn = 4 and conv_id % 5 = 0),
cl as (select source_id, target_id from e union select cl.source_id, e.target_id from cl join e on cl.target_id = e.source_id),
cyc as (select source_id id from cl where source_id = target_id)
select id, (select min(b.target_id) from cl b join cl c on b.source_id = c.target_id and b.target_id = c.source_id where b.source_id = cyc.id) component from cyc""")
def cycle_components(spark: SparkSession, sf: str) -> DataFrame:
    """The cycles among turns of conversations, some of which lead back, with their members."""
    c = _turns(spark, sf).select("conv_id", "turn", "id", F.length("text").alias("n"))
    at = lambda turn, i: c.where(F.col("turn") == turn).select("conv_id", F.col("id").alias(i), F.col("n").alias(f"n_{i}"))
    back = lambda a, b: at(b, "source_id").join(at(a, "target_id"), "conv_id")
    edges = _chain(spark, sf).select("source_id", "target_id")
    edges = edges.union(back(1, 2).where("n_source_id < n_target_id").select("source_id", "target_id")).union(back(3, 5).where("conv_id % 3 = 0").select("source_id", "target_id"))
    return cycles.components(edges.union(c.where("turn = 4 and conv_id % 5 = 0").select("id", "id")))


@query(r"""with w as (select unnest(list_concat(regexp_extract_all(text, '[A-Za-z]{4,}'), regexp_extract_all(text, '[A-Za-z]{4,} [A-Za-z]{4,}'), list_transform(regexp_extract_all(text, '[A-Za-z]{7,}'), lambda x: substr(x, 1, 4)))) n from benchmark),
l as (select lower(n) low, min(n) n from w group by 1), p as (select '(?i)' || string_agg(low, '|' order by length(low) desc, low) p from l),
m as (select doc_id, list_transform(regexp_extract_all(text, (select p from p)), lambda x: lower(x)) ms from documents),
e as (select doc_id, unnest(ms) low, unnest(range(1, len(ms) + 1)) i from m),
j as (select doc_id, count(*) hits, count(distinct n) names, sum(length(n))::bigint chars, sha256(string_agg(n, '|' order by i)) digest from e join l using (low) group by doc_id)
select doc_id, coalesce(hits, 0) hits, coalesce(names, 0) names, coalesce(chars, 0) chars, coalesce(digest, sha256('')) digest from documents left join j using (doc_id)""")
def lexicon_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Words, pairs of words and beginnings of words of all benchmark passages, as a lexicon, in all documents."""
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    heads = F.transform(found("[A-Za-z]{7,}"), lambda x: F.substring(x, F.lit(1), F.lit(4)))
    names = table(spark, sf, "benchmark").select(F.explode(F.concat(found("[A-Za-z]{4,}"), found("[A-Za-z]{4,} [A-Za-z]{4,}"), heads)).alias("name"))
    rows = lexicon.occurrences(table(spark, sf, "documents").select("doc_id", "text"), "text", names)
    spelt = F.transform("found", lambda m: m["name"])
    return rows.select("doc_id", F.size("found").cast("long").alias("hits"), F.size(F.array_distinct(spelt)).cast("long").alias("names"), F.aggregate("found", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"]).alias("chars"), tx.sha256(F.array_join(spelt, "|")).alias("digest"))


@query(r"""with d as (select doc_id k, 'Co' || doc_id % 5 company, coalesce(regexp_extract(text, '[A-Za-z]{3,}'), '') w, doc_id % 2 = 0 issuer from documents),
c as (select k, company, w, issuer, case when k % 6 = 4 then 'no such words' else w end q, case k % 6 when 0 then '公司披露：' || w when 2 then w || ' 77' when 3 then ' ' else w end st, case k % 4 when 0 then 'Elsewhere' when 1 then company when 2 then w else '' end en, case when k % 8 = 2 then '77' end pe, k % 6 = 5 lost from d),
r as (select *, case when trim(st) = '' then st when st like '公司披露%' then st when issuer then '公司披露：' || st else '来源称：' || st end said, case when lost then 'unknown chunk' when q = '' or k % 6 = 4 then 'quote not in source' when trim(st) = '' or en = '' then 'statement or entity missing'
  when k % 6 = 2 and pe is null then 'unsupported number' when en = 'Elsewhere' then 'entity not mentioned' end reason from c)
select reason name, count(*) n from r where reason is not null group by 1 union all select 'admitted', count(*) from r where reason is null union all select 'propositions', count(*) from (select distinct en, said, pe from r where reason is null)""")
def document_claims(spark: SparkSession, sf: str) -> DataFrame:
    """A claim on the first word of every document, with faults by number."""
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").withColumn("w", F.coalesce(F.regexp_extract("text", "[A-Za-z]{3,}", 0), F.lit(""))).withColumn("company", F.concat(F.lit("Co"), (k % 5).cast("string")))
    chunks = docs.select(k.alias("chunk_id"), "company", "text", F.when(k % 2 == 0, "issuer_disclosure").otherwise("other").alias("source_role"))
    said = F.when(k % 6 == 0, F.concat(F.lit("公司披露："), "w")).when(k % 6 == 2, F.concat("w", F.lit(" 77"))).when(k % 6 == 3, " ").otherwise(F.col("w"))
    whose = F.when(k % 4 == 0, "Elsewhere").when(k % 4 == 1, F.col("company")).when(k % 4 == 2, F.col("w")).otherwise("")
    claims = docs.select(F.when(k % 6 == 5, -1 - k).otherwise(k).alias("chunk_id"), k.alias("seq"), F.when(k % 6 == 4, "no such words").otherwise(F.col("w")).alias("quote"), said.alias("statement"), whose.alias("entity_name"), F.when(k % 8 == 2, "77").alias("period_end"))
    props, grounds, rejected = agenda.document_claims(claims, chunks)
    count = lambda rows, name: rows.groupBy(F.lit(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return rejected.groupBy(F.col("reason").alias("name")).agg(F.count(F.lit(1)).alias("n")).union(count(grounds, "admitted")).union(count(props, "propositions"))


@query(r"""with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) n from orders), f as (select o_custkey c, list(o_orderkey order by n) ids, bool_or(o_orderstatus = 'F') filter (n = 1 or (n = 2 and o_custkey % 7 <> 1)) att from o where n <= 8 group by 1),
p as (select c_custkey c, ids, att, case when c_custkey % 7 = 1 then ids[1:1] when c_custkey % 7 = 2 then list_append(ids[1:2], -1) else ids[1:2] end pre, case c_custkey % 5 when 0 then 'order ' || ids[1] when 1 then 'order 99999999' when 2 then ' ' else '公司披露 order ' || ids[1] end st, c_custkey % 11 = 3 bare from customer left join f on c_custkey = c)
select c proposal_id, case when ids is null then 'unknown question' when len(pre) < 2 then 'fewer than two premises' when list_contains(pre, -1) then 'unknown premise' when trim(st) = '' or bare then 'statement or warrant missing' when c % 5 = 1 then 'unsupported number'
  when att and st not like '公司披露%' then 'attribution missing' when c % 3 = 0 then 'reportable' else 'candidate' end outcome from p""")
def analysis_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A conclusion for every customer from its first orders, with faults by number."""
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    first = table(spark, sf, "orders").withColumn("n", turn).where("n <= 8")
    premises = first.select(F.col("o_custkey").alias("question_id"), F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("statement"), F.when(F.col("o_orderstatus") == "F", "attributed").otherwise("fact").alias("kind"))
    ids = first.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("ids"))
    c = F.col("c_custkey")
    two = F.slice("ids", 1, 2)
    given = F.when(c % 7 == 1, F.slice("ids", 1, 1)).when(c % 7 == 2, F.array_append(two, F.lit(-1).cast("long"))).otherwise(two)
    head = F.get("ids", 0).cast("string")
    said = F.when(c % 5 == 0, F.concat(F.lit("order "), head)).when(c % 5 == 1, "order 99999999").when(c % 5 == 2, " ").otherwise(F.concat(F.lit("公司披露 order "), head))
    rows = table(spark, sf, "customer").select("c_custkey").join(ids, "c_custkey", "left")
    proposals = rows.select(c.alias("proposal_id"), c.alias("question_id"), said.alias("statement"), given.alias("premise_ids"), F.when(c % 11 == 3, "").otherwise("w").alias("warrant"))
    verdicts = rows.where("c_custkey % 3 <> 2").select(c.alias("proposal_id"), F.when(c % 3 == 0, "accepted").otherwise("rejected").alias("verdict"))
    props, _, rejected = agenda.analyses(proposals, premises, verdicts)
    return props.select("proposal_id", F.col("status").alias("outcome")).union(rejected.select("proposal_id", "reason"))


@query(r"""with t as (select conv_id section_id, turn seq, case turn % 5 when 0 then 'turn ' || turn || '。' when 1 then 'two。three。' when 2 then 'turn 12345。' when 3 then '公司称 turn ' || turn || ' of 2024' else ' ' end x from conversations)
select section_id, seq, case when trim(x) = '' or seq % 5 = 1 or seq % 6 = 5 then 'not one sentence on claims of its section' when seq % 4 = 0 and seq % 5 <> 3 then 'attribution missing' when seq % 5 = 2 then 'unlicensed number' when section_id % 3 = 0 then 'not accepted' end reason from t""")
def report_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """A report sentence for every turn of every conversation, on the turn's own claim, with faults by number."""
    t, n = table(spark, sf, "conversations").select(F.col("conv_id").alias("section_id"), F.col("turn").alias("seq")), F.col("seq")
    number = n.cast("string")
    text = F.when(n % 5 == 0, F.concat(F.lit("turn "), number, F.lit("。"))).when(n % 5 == 1, "two。three。").when(n % 5 == 2, "turn 12345。").when(n % 5 == 3, F.concat(F.lit("公司称 turn "), number, F.lit(" of 2024"))).otherwise(" ")
    own = F.concat_ws(":", "section_id", "seq")
    sentences = t.select("section_id", "seq", text.alias("text"), F.when(n % 6 == 5, F.array(own, F.lit("other"))).otherwise(F.array(own, own)).alias("claim_ids"))
    claims = t.select("section_id", own.alias("id"), F.concat(F.lit("turn "), number).alias("statement"), F.when(n % 4 == 0, "attributed").otherwise("fact").alias("kind"), F.lit(None).cast("string").alias("display"), F.lit(None).cast("string").alias("period_end"))
    return agenda.reviewed_sentences(sentences, claims, t.select("section_id", "seq", (F.col("section_id") % 3 != 0).alias("accepted")), "600000 2024-06-30").select("section_id", "seq", "reason")


@query(r"""with p as (select s_suppkey k, s_suppkey % 5 + 2 n, s_suppkey % 7 f from supplier),
e as (select *, case when n < 3 then 'not 3 to 10 sections' when f = 3 then 'section without a title' when f = 4 then 'section without questions' when f = 5 then 'no question' end error from p)
select k plan_id, case when error is null then n else 0 end::bigint sections, case when error is null then n * 2 else 0 end::bigint questions, case when error is null then n else 0 end::bigint required, error from e""")
def seed_questions(spark: SparkSession, sf: str) -> DataFrame:
    """A plan of sections and questions for every supplier, some with a fault by number."""
    k, f = F.col("s_suppkey"), F.col("s_suppkey") % 7
    asked = lambda i, j: F.struct(F.concat(F.lit("Q"), i.cast("string"), F.lit(j)).alias("text"), F.lit("required" if j == "a" else "maybe").alias("priority"), F.when(f == 5, "guess").otherwise("fact" if j == "a" else "valuation").alias("answer_mode"), F.array(F.lit(" t "), F.lit(" ")).alias("search_terms"))
    unasked = lambda i: F.struct(F.lit("").alias("text"), F.lit("required").alias("priority"), F.lit("fact").alias("answer_mode"), F.array(F.lit("t")).alias("search_terms"))
    section = lambda i: F.struct(F.when((f == 3) & (i == 1), " ").otherwise("S").alias("title"), F.lit(None).cast("string").alias("purpose"), F.when(~((f == 4) & (i == 1)), F.array(asked(i, "a"), asked(i, "b"), unasked(i))).alias("questions"))
    plans = table(spark, sf, "supplier").select(k.alias("plan_id"), F.transform(F.sequence(F.lit(1), (k % 5 + 2).cast("int")), section).alias("sections"))
    sections, questions, wrong = agenda.seeded(plans)
    n = sections.groupBy("plan_id").agg(F.count(F.lit(1)).alias("sections"))
    q = questions.groupBy("plan_id").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("priority") == "required").alias("required"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return plans.select("plan_id").join(n, "plan_id", "left").join(q, "plan_id", "left").join(wrong, "plan_id", "left").select("plan_id", zero("sections"), zero("questions"), zero("required"), "error")
