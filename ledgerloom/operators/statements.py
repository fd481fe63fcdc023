"""Statement tables to facts: what columns there are is found in the data, a plan picks among them, and what follows from facts
(growth, ratios, the last price, conflicts) is worked out with its inputs as edges.

Propositions are rows of one table (PROPOSITION), evidence and sources others, and edges name them by content ids, so that a
rerun gives the same graph. Every step is a join, an aggregate or a window by entity and metric.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decimal_text, stable_id
from ..functions.values import display_number, shanghai_date
from ..plans.rounds import written
from .facts import contested

# Columns that are no metrics, labels of metrics, formulas with their inputs.
META_FIELDS = "thscode ticker period fiscal_year fiscal_period report_date_ms period_end_ms currency".split()
METRIC_LABELS = {
    "operating_income": "营业收入",
    "operating_costs": "营业成本",
    "operating_expenses": "营业总成本",
    "sales_fee": "销售费用",
    "manage_fee": "管理费用",
    "research_and_development_expenses": "研发费用",
    "operating_profit": "营业利润",
    "profit_total": "利润总额",
    "income_tax_expense": "所得税费用",
    "net_profit": "净利润",
    "parent_holder_net_profit": "归母净利润",
    "basic_eps": "基本每股收益",
    "total_assets": "总资产",
    "total_liabilities": "总负债",
    "total_equity": "所有者权益",
    "net_cash_flow_from_operating_activities": "经营活动现金流量净额",
    "net_cash_flow_from_investing_activities": "投资活动现金流量净额",
    "net_cash_flow_from_financing_activities": "筹资活动现金流量净额",
    "gross_margin": "毛利率",
    "rd_expense_ratio": "研发费用率",
}
RATIOS = {
    "gross_margin": ("operating_income", "operating_costs", "(operating_income - operating_costs) / operating_income * 100"),
    "rd_expense_ratio": ("operating_income", "research_and_development_expenses", "research_and_development_expenses / operating_income * 100"),
}
GROWTH = "(current - previous) / abs(previous) * 100"
SHANGHAI_MS, DAY_MS = 8 * 3_600_000, 86_400_000
_NUMBER = "decimal(28,6)"

PROPOSITION = "id entity kind status statement metric value unit display period_end fiscal_period fiscal_year scope formula seq".split()


@dataclass(frozen=True)
class Facts:
    """Tables of a fact graph: propositions (PROPOSITION), sources, evidence, edges (source_id, edge_type, target_id, role)."""

    propositions: DataFrame
    sources: DataFrame
    evidence: DataFrame
    edges: DataFrame


def cutoff_ms(as_of: str) -> Column:
    """The first millisecond after the Shanghai day as_of."""
    return (F.unix_date(F.lit(as_of).cast("date")).cast("long") + 1) * DAY_MS - SHANGHAI_MS


def records(name: str, wide: DataFrame, entity: str = "entity") -> DataFrame:
    """A statement table as rows: entity, statement, place (in the entity's records), the META_FIELDS that matter, fields.

    fields maps every other column that holds numbers, or text that may, to its text; columns of other types (booleans among
    them) are left out. place follows period_end_ms, then report_date_ms, unless the table has a column record_index.
    """
    fit = [c for c, t in wide.dtypes if c not in (*META_FIELDS, entity, "record_index") and t.split("(")[0] in ("double", "float", "decimal", "int", "bigint", "string")]
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text")) for c in fit]), lambda p: p["text"].isNotNull())
    order = Window.partitionBy(entity).orderBy("period_end_ms", "report_date_ms", *[F.col(c).cast("string") for c in fit])
    place = F.col("record_index") if "record_index" in wide.columns else F.row_number().over(order) - 1
    return wide.select(F.col(entity).alias("entity"), F.lit(name).alias("statement"), place.cast("long").alias("place"), "report_date_ms", "period_end_ms", F.col("fiscal_year").cast("long").alias("fiscal_year"), F.coalesce("fiscal_period", F.lit("")).alias("fiscal_period"), F.map_from_entries(pairs).alias("fields"))


def disclosed(rows: DataFrame, as_of: str) -> DataFrame:
    """Records with both dates that were disclosed by the end of the day as_of."""
    return rows.where(F.col("period_end_ms").isNotNull() & (F.col("report_date_ms") < cutoff_ms(as_of)))


def cells(rows: DataFrame) -> DataFrame:
    """A row for each field of each record whose text is a finite number: field and value (its plain text), fields gone."""
    rest = [c for c in rows.columns if c != "fields"]
    return rows.select(*rest, F.explode("fields").alias("field", "text")).select(*rest, "field", decimal_text("text").alias("value")).where("value is not null")


def planned(available: DataFrame, plans: DataFrame) -> DataFrame:
    """Entity, question_id, metric and derived of what plans (entity, question_id, metric_ids, derived_ids) may ask for.

    available: entity, field. A metric must be available; a formula needs all its inputs and brings them; a growth needs its
    metric and brings it. Everything else is left out; what is asked for twice counts once.
    """
    held = available.select("entity", F.col("field").alias("needs")).distinct()
    direct = plans.select("entity", "question_id", F.explode("metric_ids").alias("metric")).select("*", F.lit(False).alias("derived"), F.array("metric").alias("inputs"))
    asked = plans.select("entity", "question_id", F.explode("derived_ids").alias("metric"))
    known = reduce(lambda a, f: a.when(F.col("metric") == f, F.array(*map(F.lit, RATIOS[f][:2]))), RATIOS, F.when(F.lit(False), F.array().cast("array<string>")))
    grown = F.when(F.col("metric").endswith("_yoy"), F.array(F.regexp_replace("metric", "_yoy$", "")))
    derived = asked.select("*", F.lit(True).alias("derived"), F.coalesce(known, grown).alias("inputs")).where("inputs is not null")
    each = direct.union(derived).distinct().select("*", F.explode("inputs").alias("needs"))
    whole = each.join(held, ["entity", "needs"]).groupBy("entity", "question_id", "metric", "derived", "inputs").agg(F.count_distinct("needs").alias("n")).where("n = size(inputs)")
    inputs = whole.select("entity", "question_id", F.explode("inputs").alias("metric"), F.lit(False).alias("derived"))
    return whole.select("entity", "question_id", "metric", "derived").union(inputs).distinct()


def _label(metric: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in METRIC_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, metric), metric)


def _number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(_NUMBER)


def _fact_id(*parts: Column | str) -> Column:
    return stable_id("P", *parts)


def _firsts(rows: DataFrame) -> DataFrame:
    """PROPOSITION rows once for each entity, statement, kind and period: the first by seq."""
    key = ["id", "entity", "kind", "statement"]
    rest = [c for c in PROPOSITION if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("x")).select(*key, "x.*").select(*PROPOSITION)


def facts(values: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Cells to (propositions, sources, evidence, edges): a source for each record, a piece of evidence for each cell.

    Cells with the same statement (of an entity and period) are one proposition with several pieces of evidence.
    """
    day = shanghai_date("period_end_ms").cast("string")
    unit = F.when(F.col("field") == "basic_eps", "CNY/share").otherwise("CNY")
    rows = values.withColumn("period_end", day).withColumn("unit", unit).withColumn("display", display_number("value", F.col("unit")))
    said = F.concat("entity", F.lit("截至"), "period_end", F.lit("的"), "fiscal_period", F.lit("合并报表"), _label(F.col("field")), F.lit("为"), "display")
    source = stable_id("S", "entity", "statement", "place")
    rows = rows.withColumn("said", said).withColumn("source_id", source).withColumn("evidence_id", stable_id("E", "source_id", "field"))
    rows = written(rows.withColumn("id", _fact_id("entity", "said", F.lit("fact"), "period_end")), "facts")
    null = F.lit(None).cast("string")
    props = rows.select("id", "entity", F.lit("fact").alias("kind"), F.lit("reportable").alias("status"), F.col("said").alias("statement"), F.col("field").alias("metric"), "value", "unit", "display", "period_end", "fiscal_period", "fiscal_year", F.lit("consolidated").alias("scope"), null.alias("formula"), F.struct("statement", "place", "field").alias("seq"))
    sources = rows.select("source_id", "entity", "statement", "place", shanghai_date("report_date_ms").alias("published_at"), "period_end").distinct()
    locator = F.concat(F.lit("data.item["), F.col("place").cast("string"), F.lit("]."), F.col("field"))
    evidence = rows.select("evidence_id", "source_id", locator.alias("locator"), F.concat_ws("=", "field", "value").alias("text"))
    edge = lambda a, t, b: rows.select(a.alias("source_id"), F.lit(t).alias("edge_type"), b.alias("target_id"), null.alias("role"))
    edges = edge(F.col("id"), "GROUNDED_IN", F.col("evidence_id")).union(edge(F.col("source_id"), "CONTAINS", F.col("evidence_id"))).distinct()
    return _firsts(props), sources, evidence.distinct(), edges


def _computed(rows: DataFrame, metric: Column, value: Column, statement: Column, formula: str, *inputs: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Propositions and CALCULATED_FROM edges of rows with entity, period_end, fiscal_period, fiscal_year and inputs' ids (column, role)."""
    pct = F.bround(value, 2)
    made = rows.withColumn("metric", metric).withColumn("value", pct.cast("decimal(38,2)").cast("string")).where("value is not null")
    made = made.withColumn("display", display_number("value", F.lit("%"))).withColumn("said", statement)
    made = written(made.withColumn("id", _fact_id("entity", "said", F.lit("computed"), "period_end")), "computed")
    own = made.select("id", "entity", F.lit("computed").alias("kind"), F.lit("reportable").alias("status"), F.col("said").alias("statement"), "metric", "value", F.lit("%").alias("unit"), "display", "period_end", "fiscal_period", "fiscal_year", F.lit("consolidated").alias("scope"), F.lit(formula).alias("formula"), F.struct(F.lit("").alias("statement"), F.lit(0).cast("long").alias("place"), F.col("metric").alias("field")).alias("seq"))
    edges = [made.select(F.col("id").alias("source_id"), F.lit("CALCULATED_FROM").alias("edge_type"), F.col(c).alias("target_id"), F.lit(role).alias("role")) for c, role in inputs]
    return own, reduce(DataFrame.union, edges)


def growths(props: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Growth of each entity's CNY facts by metric and fiscal period, in the latest year, where it is requested.

    The year before must be there and not zero; of several facts of a year the last by seq counts.
    """
    wanted = requested.where("derived and metric like '%\\_yoy'").select("entity", F.regexp_replace("metric", "_yoy$", "").alias("metric")).distinct()
    fit = props.where("kind = 'fact' and unit = 'CNY' and fiscal_period <> '' and fiscal_year is not null").join(wanted, ["entity", "metric"], "left_semi")
    key = ["entity", "metric", "fiscal_period"]
    yearly = fit.groupBy(*key, "fiscal_year").agg(F.max_by(F.struct("id", "value", "period_end"), "seq").alias("x"))
    latest = F.max("fiscal_year").over(Window.partitionBy(*key))
    now = yearly.withColumn("latest", latest).where("fiscal_year = latest").select(*key, "fiscal_year", F.col("x.id").alias("current"), F.col("x.value").alias("new"), "x.period_end")
    then = yearly.select(*key, (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("x.id").alias("previous"), F.col("x.value").alias("old"))
    both = now.join(then, [*key, "fiscal_year"]).where(_number("old") != 0)
    delta = (_number("new") - _number("old")).cast("double") / F.abs(_number("old")).cast("double") * 100
    said = F.concat("entity", F.col("fiscal_year").cast("string"), F.lit("年"), "fiscal_period", _label(F.col("of")), F.lit("同比变动"), "display")
    return _computed(both.withColumn("of", F.col("metric")), F.concat("of", F.lit("_yoy")), delta, said, GROWTH, ("current", "current"), ("previous", "previous"))


def ratios(props: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requested ratios of every period that has both inputs, revenue not zero; metrics are pivoted by period.

    Of several facts of a metric and period the last by seq counts.
    """
    names = sorted({m for f in RATIOS.values() for m in f[:2]})
    rows = props.where("kind = 'fact'").where(F.col("metric").isin(*names))
    last = lambda m: F.max_by(F.struct("id", "value", "fiscal_period", "fiscal_year"), F.when(F.col("metric") == m, F.col("seq"))).alias(m)
    wide = rows.groupBy("entity", "period_end").agg(*map(last, names)).where("operating_income is not null").where(_number("operating_income.value") != 0)
    parts = []
    for metric, (whole, other, formula) in RATIOS.items():
        wanted = requested.where(F.col("derived") & (F.col("metric") == metric)).select("entity").distinct()
        fit = wide.join(wanted, "entity", "left_semi").where(F.col(other).isNotNull())
        fit = fit.select("entity", "period_end", F.col(f"{whole}.fiscal_period").alias("fiscal_period"), F.col(f"{whole}.fiscal_year").alias("fiscal_year"), F.col(f"{whole}.id").alias("revenue"), F.col(f"{other}.id").alias("part"), _number(f"{whole}.value").alias("w"), _number(f"{other}.value").alias("o"))
        upper = F.col("w") - F.col("o") if metric == "gross_margin" else F.col("o")
        said = F.concat("entity", F.lit("截至"), "period_end", F.lit("的"), "fiscal_period", F.lit(f"合并报表{METRIC_LABELS[metric]}为"), "display")
        parts.append(_computed(fit, F.lit(metric), upper.cast("double") / F.col("w").cast("double") * 100, said, formula, ("revenue", "revenue"), ("part", "cost_or_expense")))
    return reduce(DataFrame.union, [p for p, _ in parts]), reduce(DataFrame.union, [e for _, e in parts])


def prices(bars: DataFrame, as_of: str, days: int = 60) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The last close (entity, date_ms, close_price) in the days before the cutoff as a fact; of equal times the smaller."""
    end = cutoff_ms(as_of)
    fit = bars.where((F.col("date_ms") < end) & (F.col("date_ms") >= end - days * DAY_MS)).withColumn("value", decimal_text("close_price")).where("value is not null")
    last = fit.groupBy("entity").agg(F.max_by("value", F.struct("date_ms", -_number("value"))).alias("value"), F.max("date_ms").alias("date_ms"))
    day = shanghai_date("date_ms").cast("string")
    rows = last.withColumn("period_end", day).withColumn("display", display_number("value", F.lit("CNY/share")))
    rows = rows.withColumn("said", F.concat("entity", F.lit("在"), "period_end", F.lit("的未复权收盘价为"), "display")).withColumn("id", _fact_id("entity", "said", F.lit("fact"), "period_end"))
    rows = rows.withColumn("source_id", stable_id("S", "entity", F.lit("price"), "date_ms")).withColumn("evidence_id", stable_id("E", "source_id", F.lit("close_price")))
    null = F.lit(None).cast("string")
    props = rows.select("id", "entity", F.lit("fact").alias("kind"), F.lit("reportable").alias("status"), F.col("said").alias("statement"), F.lit("close_price").alias("metric"), "value", F.lit("CNY/share").alias("unit"), "display", "period_end", F.lit("").alias("fiscal_period"), F.lit(None).cast("long").alias("fiscal_year"), F.lit("security").alias("scope"), null.alias("formula"), F.struct(F.lit("price").alias("statement"), F.lit(0).cast("long").alias("place"), F.lit("close_price").alias("field")).alias("seq"))
    sources = rows.select("source_id", "entity", F.lit("price").alias("statement"), F.lit(0).cast("long").alias("place"), F.to_date("period_end").alias("published_at"), "period_end")
    locator = F.concat(F.lit("data.item[date_ms="), F.col("date_ms").cast("string"), F.lit("].close_price"))
    evidence = rows.select("evidence_id", "source_id", locator.alias("locator"), F.concat(F.lit("close_price="), "value").alias("text"))
    edges = rows.select(F.explode(F.array(F.struct(F.col("id").alias("source_id"), F.lit("GROUNDED_IN").alias("edge_type")), F.struct(F.col("source_id"), F.lit("CONTAINS").alias("edge_type")))).alias("e"), F.col("evidence_id").alias("target_id"))
    return props, sources, evidence, edges.select("e.source_id", "e.edge_type", "target_id", null.alias("role"))


def conflict_members(props: DataFrame) -> DataFrame:
    """conflict_id, id, metric, period_end of the facts of an entity that give one metric, period, scope and unit different values.

    A row for each member, however many there are; values are compared as numbers, so 1.0 and 1.00 agree.
    """
    key = ["entity", "metric", "period_end", "scope", "unit"]
    fit = props.where("kind = 'fact' and value is not null and metric <> '' and period_end <> ''")
    apart = fit.groupBy(*key).agg(F.min(_number("value")).alias("low"), F.max(_number("value")).alias("high")).where("low < high")
    return fit.join(apart.select(*key), key).select(stable_id("X", *key).alias("conflict_id"), "id", "metric", "period_end")


def settled(props: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Propositions with their status after conflicts, and the conflicts' members.

    Members are contested; so is what was computed or concluded from anything that no longer holds.
    """
    members = conflict_members(props)
    hit = members.select("id").distinct().withColumn("hit", F.lit(True))
    once = props.join(hit, "id", "left").withColumn("status", F.when(F.col("hit"), "contested").otherwise(F.col("status"))).drop("hit")
    grounded = edges.where("edge_type = 'GROUNDED_IN'").select(F.col("source_id").alias("id")).distinct().withColumn("grounded", F.lit(True))
    nodes = once.join(grounded, "id", "left").select("id", "kind", F.coalesce("grounded", F.lit(False)).alias("grounded"), "status", "formula", F.lit(None).cast("string").alias("review"))
    parents = edges.where("edge_type = 'CALCULATED_FROM'").select(F.col("source_id").alias("id"), F.col("target_id").alias("parent_id"))
    fallen = contested(nodes, parents).withColumn("fallen", F.lit(True))
    out = once.join(fallen, "id", "left").withColumn("status", F.when(F.col("fallen"), "contested").otherwise(F.col("status"))).drop("fallen")
    return out, members


def ingest(statements: list[DataFrame], plans: DataFrame, as_of: str, bars: DataFrame | None = None) -> tuple[Facts, DataFrame, DataFrame]:
    """Statement records (`records`) and plans to (facts, requested, conflicts' members).

    Cells, facts and propositions are written, as they are read several times. Only records disclosed by as_of count; only what plans select becomes a fact; growth and ratios follow where requested,
    and the last price if bars are given. Empty statements or plans give no facts. Nulls in a value, a date or a plan's list
    leave that cell, record or entry out.
    """
    values = written(cells(disclosed(reduce(DataFrame.union, statements), as_of)), "cells")
    requested = planned(values.select("entity", "field").distinct(), plans)
    chosen = values.join(requested.where("not derived").select("entity", F.col("metric").alias("field")).distinct(), ["entity", "field"], "left_semi").select(*values.columns)
    props, sources, evidence, edges = facts(chosen)
    grown, growth_edges = growths(props, requested)
    shares, share_edges = ratios(props, requested)
    every, links = props.union(grown).union(shares), edges.union(growth_edges).union(share_edges)
    if bars is not None:
        own, place, proof, more = prices(bars, as_of)
        every, sources, evidence, links = every.union(own), sources.union(place), evidence.union(proof), links.union(more)
    out, members = settled(written(every, "propositions"), links)
    return Facts(out.select(*PROPOSITION), sources, evidence, links), requested, members
