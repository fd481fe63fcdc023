"""Financial facts: unpivoting, as-of bars, growth, ratios, conflicts, metric priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import partitions
from .graph import reportable


def union_statements(*frames: DataFrame) -> DataFrame:
    """Statement tables with missing columns filled by nulls."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unpivot(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str] | None = None) -> DataFrame:
    """(keys, metric, value) of every numeric metric column; values that aren't numbers are left out."""
    kinds = dict(wide.dtypes)
    names = list(metrics or [c for c, t in kinds.items() if c not in keys and t.split("(")[0] in ("double", "float", "decimal", "int", "bigint", "string")])
    rows = wide.select(*keys, *[F.col(c).try_cast("double").alias(c) for c in names])
    return rows.unpivot(list(keys), names, "metric", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def before_cutoff(df: DataFrame, published: str, cutoff: Column) -> DataFrame:
    """Rows disclosed strictly before an exclusive cutoff instant."""
    return df.where(F.col(published) < cutoff)


def latest_bar(bars: DataFrame, keys: Sequence[str], ts: str, cutoff: Column, days: int = 60, tie: str = "seq") -> DataFrame:
    """Per key the last bar before the cutoff, at most `days` back, with a close; on ties the first by `tie`."""
    fit = bars.where((F.col(ts) < cutoff) & (F.col(ts) >= cutoff - F.expr(f"interval {days} days")) & F.col("close").isNotNull())
    rest = [c for c in bars.columns if c not in keys]
    return fit.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), -F.col(tie))).alias("x")).select(*keys, "x.*")


def growth(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Year-on-year growth in percent (half even, 2 places) of each key's latest year; needs the year before, not zero."""
    year = Window.partitionBy(*keys)
    prior = facts.select(*keys, (F.col("year") + 1).alias("year"), F.col("value").alias("prior"))
    last = facts.withColumn("last", F.max("year").over(year)).where("year = last").drop("last")
    pct = (F.col("value") - F.col("prior")) / F.abs("prior") * 100
    return last.join(prior, [*keys, "year"]).where("prior <> 0").select(*keys, "year", "value", "prior", F.bround(pct, 2).alias("yoy_pct"))


def margins(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gross margin and research ratio in percent of every period with non-zero revenue."""
    pct = lambda x: F.bround(x / F.col("revenue") * 100, 2)
    return wide.where("revenue <> 0").select(*keys, pct(F.col("revenue") - F.col("cost")).alias("gross_margin_pct"), pct(F.col("research")).alias("research_ratio_pct"))


def conflicts(facts: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Keys with two or more different values. The keys should name the entity as well, for tables of many.

    Facts go by keys and value first, so the values of a frequent key are told apart in many tasks.
    """
    n = partitions(facts)
    held = facts.select(*keys, value).where(F.col(value).isNotNull())
    each = held.repartition(n, *keys, value).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("facts"))
    return each.repartition(n, *keys).groupBy(*keys).agg(F.sum("facts").alias("facts"), F.count(F.lit(1)).alias("distinct_values")).where("distinct_values >= 2")


def contested(props: DataFrame, parents: DataFrame) -> DataFrame:
    """Ids of derived propositions that no longer hold, though they are marked reportable.

    props: id, kind, grounded, status, formula, review; parents: id, parent_id (inputs of computed ones, premises of the
    others). A computed one needs a formula and two inputs, an analysis or forecast an accepted review and a premise, and
    all that they rest on must hold.
    """
    live = props.where("status = 'reportable'")
    leaves = live.where("kind in ('fact', 'attributed') and grounded").select("id")
    derived = live.where("kind in ('computed', 'analysis', 'forecast')")
    fit = derived.where("if(kind = 'computed', coalesce(formula, '') <> '', review <=> 'accepted')")
    need = fit.select("id", F.when(F.col("kind") == "computed", 2).otherwise(1).alias("least"))
    return derived.select("id").join(reportable(need, parents, leaves), "id", "left_anti")


def metric_priority(facts: DataFrame, requested: DataFrame | None = None, limit: int = 16) -> DataFrame:
    """Per question and requested metric the newest fact, the same fiscal period a year before, and its growth.

    facts: question_id, id, metric, year, fiscal_period, period_end; requested: question_id, metric (all metrics that are
    no growth rates if none are named). The growth of a metric is the fact named `<metric>_yoy` at the newest one's period
    end. Places 0, 1 and 2 within a metric, metrics by name; a fact counts once.
    """
    own = facts.select("question_id", "id", "metric", "year", "fiscal_period", "period_end", F.col("metric").alias("of"), F.lit(False).alias("growth"))
    grown = own.where(F.col("metric").endswith("_yoy")).withColumns({"of": F.regexp_replace("metric", "_yoy$", ""), "growth": F.lit(True)})
    if requested is None:
        roles = own.where(~F.col("metric").endswith("_yoy")).union(grown)
    else:
        roles = own.union(grown).join(requested.select("question_id", F.col("metric").alias("of")).distinct(), ["question_id", "of"], "left_semi").select(*own.columns)
    by = Window.partitionBy("question_id", "of")
    at = lambda c, when: F.max(F.when(when, F.col(c))).over(by)
    roles = roles.withColumn("newest", at("period_end", ~F.col("growth")))
    now = ~F.col("growth") & (F.col("period_end") == F.col("newest"))
    roles = roles.withColumn("top", F.min(F.when(now, F.struct("id", "fiscal_period", "year"))).over(by))
    prior = ~F.col("growth") & (F.col("fiscal_period") == F.col("top.fiscal_period")) & (F.col("year") == F.col("top.year") - 1)
    roles = roles.withColumn("last", at("period_end", prior))
    place = F.when(now & (F.col("id") == F.col("top.id")), 0).when(prior & (F.col("period_end") == F.col("last")), 1).when(F.col("growth") & (F.col("period_end") == F.col("newest")), 2)
    first = roles.withColumn("place", place).where("place is not null").groupBy("question_id", "of", "place").agg(F.min("id").alias("id"))
    once = first.groupBy("question_id", "id").agg(F.min(F.struct(F.col("of").alias("metric"), "place")).alias("x")).select("question_id", "id", "x.*")
    order = Window.partitionBy("question_id").orderBy("metric", "place", "id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
