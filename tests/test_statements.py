"""Statement tables to facts, against the same rules in plain Python."""

from decimal import ROUND_HALF_EVEN, Decimal

from ledgerloom.operators import statements as st

WIDE = "entity string, fiscal_year int, fiscal_period string, report_date_ms long, period_end_ms long, record_index int, operating_income string, operating_costs double, research_and_development_expenses decimal(12,2), basic_eps string, note string, audited boolean"
DAY = st.DAY_MS
END = {2019: 18_261 * DAY, 2020: 18_627 * DAY}  # the last days of the years, 08:00 in Shanghai


def row(entity, year, at, income, costs, rd=None, eps=None, report=None, period="FY", end=None):
    return (entity, year, period, END[2020] + 30 * DAY if report is None else report, END[year] if end is None else end, at, income, costs, rd, eps, "text", True)


ROWS = [
    row("A", 2019, 0, "100", 40.0, Decimal("5.00"), "1.5"),
    row("A", 2020, 1, "1.50E+2", 70.0, Decimal("6.00"), "1.50"),
    row("A", 2020, 2, "150.000", 71.0),  # costs differ from record 1: a conflict; income agrees with it
    row("B", 2019, 0, "0", 10.0),
    row("B", 2020, 1, "300000000", 123_456.0, None, "n/a"),
    row("C", 2020, 0, "7", 7.0, report=-1),
    row("D", 2020, 0, "1", 1.0, report=10**15),
    ("E", 2020, "FY", None, END[2020], 0, "1", 1.0, None, None, None, None),
    ("F", 2020, "FY", 1, None, 0, "1", 1.0, None, None, None, None),
]
PLAN = "entity string, question_id string, metric_ids array<string>, derived_ids array<string>"


def ingest(spark, rows=ROWS, plans=None, bars=None, as_of="2021-06-30"):
    wide = spark.createDataFrame(rows, WIDE)
    plans = plans or [(e, "q", ["operating_costs", "basic_eps", "note", "none"], ["gross_margin", "rd_expense_ratio", "operating_costs_yoy", "operating_income_yoy", "gross_margin_yoy"]) for e in "ABCDEF"]
    return st.ingest([st.records("income", wide)], spark.createDataFrame(plans, PLAN), as_of, bars)


def pct(x, y):
    return str((Decimal(x) / Decimal(y) * 100).quantize(Decimal("0.01"), ROUND_HALF_EVEN))


def test_facts_growth_ratios_and_conflicts(spark):
    made, requested, members = ingest(spark)
    got = {}
    for r in made.propositions.collect():
        got.setdefault((r.entity, r.metric, r.fiscal_year), []).append((r.value, r.status))
    got = {k: sorted(v) for k, v in got.items()}
    assert got == {
        ("A", "operating_income", 2019): [("100", "reportable")],
        ("A", "operating_income", 2020): [("150", "reportable")],  # 150 and 150.000 say the same
        ("A", "operating_costs", 2019): [("40.0", "reportable")],
        ("A", "operating_costs", 2020): [("70.0", "contested"), ("71.0", "contested")],
        ("A", "research_and_development_expenses", 2019): [("5.00", "reportable")],
        ("A", "research_and_development_expenses", 2020): [("6.00", "reportable")],
        ("A", "basic_eps", 2019): [("1.5", "reportable")],
        ("A", "basic_eps", 2020): [("1.50", "reportable")],
        ("A", "operating_income_yoy", 2020): [(pct(50, 100), "reportable")],
        ("A", "operating_costs_yoy", 2020): [(pct(31, 40), "contested")],  # the last record of the year counts
        ("A", "gross_margin", 2019): [(pct(60, 100), "reportable")],
        ("A", "gross_margin", 2020): [(pct(79, 150), "contested")],
        ("A", "rd_expense_ratio", 2019): [(pct(5, 100), "reportable")],
        ("A", "rd_expense_ratio", 2020): [(pct(6, 150), "reportable")],
        ("B", "operating_income", 2019): [("0", "reportable")],
        ("B", "operating_income", 2020): [("300000000", "reportable")],
        ("B", "operating_costs", 2019): [("10.0", "reportable")],
        ("B", "operating_costs", 2020): [("123456.0", "reportable")],
        ("B", "operating_costs_yoy", 2020): [(pct(123446, 10), "reportable")],
        ("B", "gross_margin", 2020): [(pct(300000000 - 123456, 300000000), "reportable")],
        ("C", "operating_income", 2020): [("7", "reportable")],
        ("C", "operating_costs", 2020): [("7.0", "reportable")],
        ("C", "gross_margin", 2020): [("0.00", "reportable")],
    }
    said = {r.statement for r in made.propositions.collect()}
    assert {"A截至2020-12-31的FY合并报表营业成本为70.00元", "B截至2020-12-31的FY合并报表营业收入为3.00亿元", "A2020年FY营业收入同比变动50.00%", "A截至2020-12-31的FY合并报表基本每股收益为1.50元/股"} <= said
    assert {r.metric for r in members.collect()} == {"operating_costs"} and members.count() == 2
    edges = {(r.edge_type, r.role) for r in made.edges.collect()}
    assert edges == {("GROUNDED_IN", None), ("CONTAINS", None), ("CALCULATED_FROM", "current"), ("CALCULATED_FROM", "previous"), ("CALCULATED_FROM", "revenue"), ("CALCULATED_FROM", "cost_or_expense")}
    ids = {r.id: r for r in made.propositions.collect()}
    grounds = [r for r in made.edges.where("edge_type = 'GROUNDED_IN'").collect()]
    double = [r for r in grounds if ids[r.source_id].metric == "operating_income" and ids[r.source_id].entity == "A" and ids[r.source_id].fiscal_year == 2020]
    assert len(double) == 2
    proof = {r.evidence_id: r for r in made.evidence.collect()}
    assert {(proof[r.target_id].locator, proof[r.target_id].text) for r in double} == {("data.item[1].operating_income", "operating_income=150"), ("data.item[2].operating_income", "operating_income=150.000")}
    assert set(proof) == {r.target_id for r in grounds} and {r.source_id for r in made.sources.collect()} == {r.source_id for r in proof.values()}
    asked = {(r.entity, r.metric, r.derived) for r in requested.where("entity = 'A'").collect()}
    assert ("A", "operating_income", False) in asked and ("A", "gross_margin_yoy", True) not in asked and ("A", "note", False) not in asked


def test_nothing_asked_or_disclosed(spark):
    assert ingest(spark, plans=[("A", "q", None, None), ("Z", "q", ["operating_costs"], [])])[0].propositions.count() == 0
    assert ingest(spark, rows=[])[0].propositions.count() == 0
    assert ingest(spark, as_of="1960-01-01")[0].propositions.count() == 0


def test_cutoff_is_the_end_of_the_shanghai_day(spark):
    end = (18_628 * DAY) - st.SHANGHAI_MS  # midnight after 2020-12-31
    rows = [row("A", 2020, 0, "1", 1.0, report=end - 1), row("B", 2020, 0, "1", 1.0, report=end)]
    assert {r.entity for r in st.disclosed(st.records("x", spark.createDataFrame(rows, WIDE)), "2020-12-31").collect()} == {"A"}


def test_last_price(spark):
    end = (18_628 * DAY) - st.SHANGHAI_MS
    bars = spark.createDataFrame([("A", end - 1, "12.5"), ("A", end, "99"), ("A", end - DAY, "11"), ("B", end - 61 * DAY, "3"), ("C", end - 2, None), ("C", end - 9, "4")], "entity string, date_ms long, close_price string")
    made, _, _ = ingest(spark, rows=[], bars=bars, as_of="2020-12-31")
    got = {(r.entity, r.value, r.period_end, r.display, r.scope, r.status) for r in made.propositions.collect()}
    assert got == {("A", "12.5", "2020-12-31", "12.50元/股", "security", "reportable"), ("C", "4", "2020-12-31", "4.00元/股", "security", "reportable")}
    assert made.edges.count() == 4 and made.evidence.count() == 2 and made.sources.count() == 2


def test_records_are_read_from_files_written_once(spark, sf):
    from ledgerloom.plans import catalogue

    plan = catalogue._records(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "l_orderkey" not in plan


def test_plain_numbers_are_told_by_one_match(spark):
    from ledgerloom.functions.text import decimal_text

    got = [r.n for r in spark.createDataFrame([("1.50",), ("-0",), ("007",), ("5.",), ("12\n",), ("1e3",), ("-1.2E-3",), ("x",), (None,)], "x string").select(decimal_text("x").alias("n")).collect()]
    assert got == ["1.50", "-0", "7", "5", "12", "1000", "-0.0012", None, None]
    plan = spark.range(1).select(decimal_text("id"))._jdf.queryExecution().analyzed().toString()
    assert plan.index("RLIKE") < plan.index("regexp_extract")
