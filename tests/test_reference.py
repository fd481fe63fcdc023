"""Operators on small fixtures: text, values, blocks, tables, graphs, validation, sources."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.functions import values as vl
from ledgerloom.operators import agenda, blocks, evaluation, evidence, facts, graph, ranking, tables, validation, views
from ledgerloom.sources import landed, sinks


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def s(x):
    return F.lit(x).cast("string")


def test_text_functions(spark):
    r = one(
        spark, tx.norm_text(s("营 业 收 入 ， 好\r\n  a   b \n\n\n\nc ")), tx.norm_quote(s("a ，\n b")), tx.compact(s(" Straße X")), tx.number_tokens(s("1,234.5 and A7 and 88 88")),
        tx.terms(s("营业收入 Alpha_1 x")), tx.object_type(s("图表 3 x")), tx.object_type(s("a 1 2\nb 3 4")), tx.metric_occurrences(s("营业收入增速 5 营业收入 6 roe 7")), tx.truncate(s("x" * 90)), tx.escape_html(s("<a&'\">")),
        tx.stable_id("X", s("a"), F.lit(None)), tx.fnv1a(s("a")), tx.glyphs_present(s("1,200 GB"), s("is 1 ,200")), tx.glyphs_present(s("20%-30%"), s("20% to 30%")), tx.quote_in(s(" "), s("x")),
    )
    sid = hashlib.sha256("a\x1fNone".encode()).hexdigest()[:16].upper()
    assert list(r) == ["营业收入， 好\na b\n\nc", "a,b", "strassex", ["1234.5", "88"], ["营业", "业收", "收入", "alpha_1"], "figure_caption", "table_like", ["营业收入增速", "营业收入", "roe"], "x" * 87 + "…", "&lt;a&amp;&#39;&quot;&gt;", "X_" + sid, 0xE40C292C, True, False, False]


def test_relevance(spark):
    r = one(spark, tx.relevance(s("alpha beta alpha"), F.array(s("alpha"), s("x"))), tx.relevance(s("目录 alpha" + "." * 31), F.array(s("alpha"))))
    assert r[0] == pytest.approx(8 * 2 + 0.3) and r[1] == pytest.approx(0.83)


@pytest.mark.parametrize(("json", "want"), [("0.82", 0.82), ('"high"', None), ('"0.82"', None), ("", None), (None, None), ("true", None), ("-0.1", None), ("1.1", None), ("NaN", None), ("1", 1.0), ("1e-1", 0.1)])
def test_confidence_is_never_coerced(spark, json, want):
    assert one(spark, vl.confidence(s(json)))[0] == want


def test_values(spark):
    v = lambda *a: vl.canonical_value(*map(s, a))
    r = one(spark, v("scalar", "about 1,200.5 x", "9", None, None, "none"), v("range", "1-2", None, "1", None, None), v("text", "", None, None, None, None), v("scalar", "none here", "1", None, None, None), v("scalar", "5", "5", None, None, "x"))
    assert (float(r[0].normalized), r[0].reject_reason) == (1200.5, None)
    assert [x.reject_reason for x in r[1:]] == ["range value requires range_low and range_high", "invalid value kind or empty raw value", "scalar raw value has no numeric literal", "invalid scale"]
    u = one(spark, vl.value_unit(s("5"), s("百 万元")), vl.value_unit(s("5%"), s("亿元")), vl.value_unit(s("3gb"), s("")), vl.table_unit(s("市盈率"), F.array(s("3"))), vl.display_number(s("123456789"), s("CNY")), vl.base_value(s("10000"), s("1.5")), vl.clamp(F.lit(1.4)))
    assert (u[0].scale, u[1].unit, u[2].unit, u[3].unit, u[4], float(u[5]), u[6]) == ("1000000", "percent", "GB", "multiple", "1.23亿元", 15000.0, 1.0)
    errors = one(spark, vl.value_errors(s("range"), s(None), s("3"), s("2"), s(None)), vl.value_errors(s("odd"), s("1"), s(None), s(None), s("x")))
    assert errors[0] == ["DATA_RANGE"] and errors[1] == ["DATA_VALUE_KIND", "DATA_DECIMAL"]
    assert str(one(spark, vl.shanghai_date(F.lit(1704038400000)))[0]) == "2024-01-01"


def test_folds(spark):
    df = spark.createDataFrame([(1, 1, "aaa\nbbb\n\nccc\n" + "d" * 12)], "doc_id long, page int, text string")
    rows = blocks.source_blocks(df, 7).collect()
    assert [r.raw_text for r in rows] == ["aaa\nbbb", "ccc", "d" * 12] and rows[1].block_id == "SO_P001_B002" and rows[1].char_start == 9
    assert [r.chunk_text for r in blocks.text_chunks(df, 7).collect()] == ["aaa\nbbb", "ccc", "d" * 7, "d" * 5]
    b = spark.createDataFrame([(1, 1, 50, "x"), (1, 2, 30, "y"), (1, 3, 10, "y"), (1, 4, 90, "z")], "doc_id long, o long, n long, id string")
    assert [(r.o, r.chunk) for r in blocks.pack_chunks(b, "doc_id", "o", "n", 100, 0, "id").collect()] == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_block_places(spark):
    page = "  Head \nrow one  \n \n\n中 文 text\n\n \t\n  Head \n"
    rows = blocks.sequenced(blocks.source_blocks(spark.createDataFrame([(1, 1, page), (1, 2, None), (1, 3, "x")], "doc_id long, page int, text string"))).orderBy("sequence").collect()
    raws = ["Head\nrow one", "中 文 text", "Head", "x"]
    assert [(r.raw_text, r.normalized_text, r.sha256) for r in rows] == [(t, n, hashlib.sha256(t.encode()).hexdigest()) for t, n in zip(raws, ["Head\nrow one", "中文 text", "Head", "x"], strict=True)]
    assert [(r.page, r.block, r.sequence, r.char_start, r.char_end) for r in rows] == [(1, 1, 1, 2, 14), (1, 2, 2, page.index("中"), page.index("中") + 8), (1, 3, 3, page.rindex("Head"), page.rindex("Head") + 4), (3, 1, 4, 0, 1)]


def test_quotes_of_all_lengths(spark):
    texts = [(i, t) for i, t in enumerate(["the quick  brown fox jumps over the lazy dog and runs away", "brownfox", "x", None, "éè 中文 text"])]
    quotes = [(i, q) for i, q in enumerate(["quick brown fox jumps over", "brown fox", "x", " ", "中文", "quick  brown", "away from"])]
    got = evidence.quote_matches(spark.createDataFrame(quotes, "item_id int, quote string"), spark.createDataFrame(texts, "doc_id int, text string"), 20).collect()
    want = {(i, d, "exact" if q in t else "whitespace_normalized") for i, q in quotes for d, t in texts if t and q.strip() and "".join(q.split()) in "".join(t.split())}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_scores_follow_the_expression(spark):
    chunks = [(1, "Alpha beta alpha 营业收入 x"), (2, "目录 alpha" + "." * 40), (3, "none"), (4, None), (5, "ALPHABET 业收")]
    asked = [("a", ["alpha", "x"]), ("b", ["营业收入", "beta"]), ("c", [])]
    c, q = spark.createDataFrame(chunks, "chunk_id int, text string"), spark.createDataFrame(asked, "question_id string, terms array<string>")
    want = c.crossJoin(q).select("question_id", "chunk_id", tx.relevance("text", "terms").alias("score")).where("score > 0").collect()
    got = ranking.scored(c, q, 1).collect()
    assert {(r.question_id, r.chunk_id): round(r.score, 9) for r in got} == {(r.question_id, r.chunk_id): round(r.score, 9) for r in want} and len(want) > 3


def test_propositions_need_formula_and_review(spark):
    props = spark.createDataFrame([("f", "fact", None, None), ("g", "fact", None, None), ("ok", "computed", "f-g", None), ("bare", "computed", None, None), ("one", "computed", "f", None), ("said", "analysis", None, "accepted"), ("open", "analysis", None, "pending"), ("on", "forecast", None, "accepted")], "id string, kind string, formula string, review string")
    props = props.withColumns({"grounded": F.lit(True), "status": F.lit("reportable")})
    parents = spark.createDataFrame([("ok", "f"), ("ok", "g"), ("bare", "f"), ("bare", "g"), ("one", "f"), ("said", "ok"), ("open", "f"), ("on", "open")], "id string, parent_id string")
    assert {r.id for r in facts.contested(props, parents).collect()} == {"bare", "one", "open", "on"}


def test_labels_join_before_matching(spark):
    rows = [("E", "Entity", "ACME Inc", None, None, None, None), ("M", "Metric", "Net Profit", None, None, None, None), ("P", "Period", "2025E", None, None, None, None), ("D", "DataPoint", "d", "E", "M", "P", ("1,200", "1000000")), ("D2", "DataPoint", "d2", "E", "X", "P", ("1,200", "1"))]
    nodes = spark.createDataFrame(rows, "id string, node_type string, label string, subject_ref string, metric_ref string, period_ref string, value struct<raw:string,scale:string>").withColumns({"object_text": F.lit(None).cast("string"), "predicate": F.lit("grew")})
    full = evaluation.labelled_nodes(nodes)
    assert {r.id: r.text for r in full.collect()}["D"] == "d grew ACME Inc Net Profit 2025E"
    assert {(r.id, r.metric, r.point_scale) for r in evaluation.data_points(full).collect()} == {("D", "Net Profit", "1000000"), ("D2", None, "1")}


def test_decimal_text(spark):
    told = {"1E+3": "1000", "1.50": "1.50", "-0.00e2": "-0", "1.5e-3": "0.0015", "12.34e1": "123.4", ".5": "0.5", "x": None, "NaN": None, "007": "7"}
    assert {k: one(spark, tx.decimal_text(s(k)))[0] for k in told} == told


def test_gate(spark):
    src = spark.createDataFrame([("s", "ab  cd，e")], "doc_id string, text string")
    ev = spark.createDataFrame([("1", "s", "ab  cd"), ("2", "s", "abcd，e"), ("6", "s", "abcd,e"), ("3", "s", "zz"), ("4", "t", "ab"), ("5", "s", " "), ("1", "s", "zz")], "candidate_id string, doc_id string, quote string")
    rows = {(r.candidate_id, r.quote): r.match_mode or r.reject_reason for r in evidence.cited(ev, src).collect()}
    assert list(rows[k] for k in sorted(rows)) == ["exact", "quote not in source", "whitespace_normalized", "quote not in source", "unknown source", "empty quote", "quote not in source"]
    assert {r.candidate_id for r in evidence.admitted(evidence.cited(ev, src)).where("admitted").collect()} == {"2"}


def test_tables(spark):
    head = "项目 2023A 2024A 2025E 2026E 2027E"
    rows = [(1, 1, 1, "paragraph", head), (1, 1, 2, "legal", "ROE 1 2 3 4 5"), (1, 1, 3, "table_like", "营业收入 1,000 2 3 4 5 6 毛利率 10% 11% 12% 13% 14%\n净利润 1 2"), (1, 2, 1, "table_like", "ROE 1 2 3 4 5")]
    got = tables.periodic(spark.createDataFrame(rows, "doc_id int, page int, sequence int, object_type string, text string")).collect()
    assert len(got) == 10 and {(r.metric, r.unit) for r in got} == {("营业收入", "CNY"), ("毛利率", "percent")}
    assert {(r.period, r.raw, r.qualifier) for r in got if r.metric == "营业收入"} >= {("2023A", "1,000", "actual"), ("2027E", "5", "forecast")}
    cap = [(1, 1, "iPhone 14 2022.09 6GB 128GB 内存容量：从 4GB 向 6GB 升级"), (1, 2, "iPhone 15 2023.09 6GB 128GB\n内存容量：从 1GB 向 2GB 升级")]
    pts = tables.capacity(spark.createDataFrame(cap, "doc_id int, sequence int, text string")).where("metric = '内存容量'").collect()
    assert {(r.subject, r.raw, r.endpoint, r.mentions) for r in pts} == {("iPhone 14", "6GB", "reported", 1), ("iPhone 14", "4GB", "before", 1), ("iPhone 15", "6GB", "reported", 1)}


def edges(spark, pairs, kind="SUPPORTS"):
    return spark.createDataFrame([(a, kind, b) for a, b in pairs], "source_id string, edge_type string, target_id string")


def test_graph_fix_points(spark):
    loop = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    assert {r.id for r in graph.cyclic_nodes(loop).collect()} == {"a", "b", "c"}
    assert graph.cyclic_nodes(edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])).count() == 0
    assert graph.closure(loop).count() == 12
    assert graph.closure(loop.limit(0)).count() == 0
    chain = graph.closure(edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(30)]), spark.createDataFrame([("n0",)], "id string"))
    assert sorted(r.depth for r in chain.collect()) == list(range(1, 31))
    assert {(r.id, r.hops) for r in graph.neighbourhood(loop, spark.createDataFrame([("d",)], "id string"), 2).collect()} == {("d", 0), ("c", 1), ("a", 2), ("b", 2)}
    need = spark.createDataFrame([("x", 2), ("y", 1), ("z", 1), ("w", 1), ("o", 2)], "id string, least int")
    parents = spark.createDataFrame([("x", "f"), ("x", "g"), ("y", "x"), ("z", "w"), ("w", "z"), ("o", "f")], "id string, parent_id string")
    held = graph.reportable(need, parents, spark.createDataFrame([("f",), ("g",)], "id string"))
    assert {r.id for r in held.collect()} == {"f", "g", "x", "y"}
    rel = spark.createDataFrame([(1, "p1", "a", "b", True, 0.1), (1, "p2", "b", "a", False, 0.9), (1, "p3", "b", "c", False, 0.8), (2, "p4", "b", "a", False, 0.9)], "graph_id int, proposal_id string, source_id string, target_id string, explicit boolean, confidence double")
    assert {(r.proposal_id, r.admitted) for r in graph.admit_acyclic(rel).collect()} == {("p1", True), ("p2", False), ("p3", True), ("p4", True)}
    assert graph.reasoning_steps(edges(spark, [("a", "b")])).count() == 2
    with pytest.raises(ValueError):
        graph.view(need, loop, "none")


VALUE = "struct<kind:string,raw:string,normalized_decimal:string,range_low:string,range_high:string,scale:string>"


def tiny_graph(spark, quote="revenue was 12", level="EXPLICIT", period="P", mode=None, concludes="C"):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    text = "The revenue was 12 in 2024, so buy."
    doc = spark.createDataFrame([("D",)], "id string")
    src = spark.createDataFrame([("S", "D", text + " ", text, sha(text + " "), "EXTRACTED")], "id string, document_id string, raw_text string, normalized_text string, sha256 string, processing_status string")
    rows = [("E", "Entity", "e"), ("M", "Metric", "m"), ("P", "Period", "p"), ("X", "DataPoint", "x"), ("C", "Claim", "c"), ("R", "ReasoningStep", "r")]
    full = [(i, t, n, "EXPLICIT" if t in ("DataPoint", "Claim") else None, "E" if t == "DataPoint" else None, "M" if t == "DataPoint" else None, period if t == "DataPoint" else None, ("scalar", "12", "12", None, None, "1") if t == "DataPoint" else None, ["X"] if t == "ReasoningStep" else None, [concludes] if t == "ReasoningStep" else None, "core", "forecast") for i, t, n in rows]
    nodes = spark.createDataFrame(full, f"id string, node_type string, label string, assertion_level string, subject_ref string, metric_ref string, period_ref string, value {VALUE}, premise_node_ids array<string>, conclusion_claim_ids array<string>, importance string, claim_role string")
    ev = spark.createDataFrame([("X", "S", quote, sha(quote), mode), ("C", "S", "sobuy", sha("sobuy"), "whitespace_normalized")], "node_id string, source_id string, quote string, quote_sha256 string, match_mode string")
    e = [("e1", "EVIDENCED_BY", "X", "S"), ("e2", "EVIDENCED_BY", "C", "S"), ("e3", "PREMISE_OF", "X", "R"), ("e4", "CONCLUDES", "R", concludes), ("e5", "SUPPORTS", "X", "C")]
    eg = spark.createDataFrame([(i, t, a, b, level if t == "SUPPORTS" else "EXPLICIT", "active", None, None, True) for i, t, a, b in e], "id string, edge_type string, source_id string, target_id string, assertion_level string, status string, verdict string, verdict_confidence double, has_evidence boolean")
    return doc, src, nodes, eg, ev


@pytest.mark.parametrize(("change", "codes"), [({}, set()), ({"quote": "made up 12"}, {"EVIDENCE_QUOTE"}), ({"level": "INFERRED"}, {"UNVERIFIED_INFERRED_EDGE"}), ({"period": "nowhere"}, {"DATA_CONTEXT"}), ({"quote": "revenue was"}, {"DATA_RAW_EVIDENCE"}), ({"mode": "fuzzy"}, {"EVIDENCE_QUOTE"}), ({"quote": "revenuewas 12"}, {"EVIDENCE_QUOTE"}), ({"quote": "revenuewas 12", "mode": "whitespace_normalized"}, set()), ({"concludes": "X"}, {"REASONING_CONCLUSION"})])
def test_validator_mutations(spark, change, codes):
    g = tiny_graph(spark, **change)
    assert {r.code for r in validation.errors(*g).collect()} == codes
    if not change:
        assert validation.warnings(g[2], g[3]).count() == 0
        back = g[3].union(spark.createDataFrame([("e6", "SUPPORTS", "C", "X", "EXPLICIT", "active", None, None, True), ("e5", "SUPPORTS", "X", "C", "EXPLICIT", "active", None, None, True)], g[3].schema))
        assert {r.code for r in validation.errors(g[0], g[1], g[2], back, g[4]).collect()} == {"ARGUMENT_DAG", "DUPLICATE_EDGE", "UNIQUE_IDS", "EDGE_IDS"}


def test_state_hash_ignores_partitions(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    assert validation.state_hash(df.repartition(7)).first() == validation.state_hash(df.coalesce(1)).first() != validation.state_hash(df.where("id > 0")).first()


def test_facts(spark):
    rows = spark.createDataFrame([("a", 2022, 10.0), ("a", 2023, 15.0), ("b", 2023, 1.0), ("c", 2022, 0.0), ("c", 2023, 4.0)], "entity string, year int, value double")
    assert [(r.entity, r.yoy_pct) for r in facts.growth(rows, ["entity"]).collect()] == [("a", 50.0)]
    assert facts.margins(spark.createDataFrame([(1, 0.0, 1.0, 1.0), (2, 200.0, 50.0, 3.0)], "k int, revenue double, cost double, research double"), ["k"]).collect()[0][1:] == (75.0, 1.5)
    dec = spark.createDataFrame([("m", "1.0"), ("m", "1.00"), ("n", "1"), ("n", "2")], "k string, v string").select("k", F.col("v").cast("decimal(10,4)").alias("value"))
    assert [r.k for r in facts.conflicts(dec, ["k"]).collect()] == ["n"]
    wide = spark.createDataFrame([(1, "5", None), (2, "x", "7")], "k int, a string, b string")
    assert {tuple(r) for r in facts.unpivot(wide, ["k"]).collect()} == {(1, "a", 5.0), (2, "b", 7.0)}


def test_ranking_and_evaluation(spark):
    sc = spark.createDataFrame([("q1", 1, 9.0), ("q1", 2, 8.0), ("q1", 3, 7.0), ("q2", 1, 1.0), ("q2", 3, 5.0)], "question_id string, chunk_id int, score double")
    assert [(r.chunk_id, r.weight) for r in ranking.select_chunks(sc, 2).collect()] == [(1, 10.0), (2, 8.0)]
    pts = spark.createDataFrame([("d1", "ACME Inc", "Net Profit", "2025E", "1,200", "1000000")], "id string, subject string, metric string, period string, raw string, point_scale string")
    spec = "spec_id string, subject_terms array<string>, subject_any array<string>, metric_any array<string>, metric_terms array<string>, period_any array<string>, raw_any array<string>, scale string"
    specs = spark.createDataFrame([("ok", ["acme"], None, ["net profit"], None, ["2025e"], ["1,200"], "1000000"), ("no", None, None, None, ["loss"], None, None, None)], spec)
    hits = evaluation.match_data(pts, specs)
    assert [(r.spec_id, r.id) for r in hits.collect()] == [("ok", "d1")]
    assert evaluation.recall(evaluation.verdicts(specs.withColumn("category", F.lit("data")), hits)).first()[1:] == (1, 2, 0.5)


def test_agenda(spark):
    c = spark.createDataFrame([("A", "A grew 5", "grew  5", "", "it grew 5 fast"), ("A", "grew 6", "grew 5", "", "it grew 5"), ("B", "grew", "grew", "", "grew"), ("A", "x", "none", "", "grew")], "entity string, statement string, quote string, period string, text string")
    assert [r[0] for r in c.select(agenda.claim_reason("A")).collect()] == [None, "unsupported number", "entity not mentioned", "quote not in source"]
    hits = spark.createDataFrame([("q", 1, "https://a.cn/2024-01-02/x.PDF"), ("q", 2, "https://a.cn/2025-01-02/x.pdf"), ("q", 3, "https://b.com/2024-01-02/x.pdf"), ("q", 4, "https://s.a.cn/2024-01-01/y.pdf")], "query string, place int, url string")
    seen = spark.createDataFrame([("https://s.a.cn/2024-01-01/y.pdf",)], "url string")
    assert [r.url for r in agenda.gap_hits(hits, seen, ["a.cn"], "2024-06-30").collect()] == ["https://a.cn/2024-01-02/x.PDF"]


def test_sources(spark, tmp_path):
    ok = [("https://x/2024-01-02/a.pdf", "t", "p", "2024-01-02", None)]
    assert landed.checked_manifest(spark.createDataFrame(ok, landed.MANIFEST), "2024-01-02").count() == 1
    for bad in (("https://x/2024-01-03/a.pdf", "t", "p", "2024-01-02", None), ("https://x/a", "", "p", "2024-01-02", None), ("https://x/a", "t", "p", "2024-02-30", None), ("https://x/a", "t", "p", "2024-01-03", None)):
        with pytest.raises(Exception, match="bad manifest row"):
            landed.checked_manifest(spark.createDataFrame([bad], landed.MANIFEST), "2024-01-02").collect()
    r = one(spark, landed.recovered_json(s('```json\n{"a": 1}\n```')), landed.recovered_json(s('so: {"a": 1} ok')), landed.recovered_json(s("none")))
    assert list(r) == ['{"a": 1}', '{"a": 1}', None]
    page = "<html><head><meta property='article:published_time' content='2024-03-02T01:00'></head><nav>no</nav><p>A  b</p><div>c<time datetime='2024-03-01'>d</time></div></html>"
    got = landed.page_text(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert (got.text, got.published) == ("A b\ncd", "2024-03-01")
    flat = '[{\\"_1\\":2},\\"linear_conversation\\",[3],{\\"_4\\":5},\\"message\\",{\\"_6\\":7,\\"_8\\":9},\\"id\\",\\"m1\\",\\"content\\",{\\"_10\\":11},\\"text\\",\\"hello\\"]'
    html = f'<script>enqueue("not json")</script><script>enqueue("{flat}")</script>'
    msg = landed.shared_messages(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    assert [(m.id, m.text) for m in msg] == [("m1", "hello")]
    assert landed.content_text({"parts": ["a", {"text": "b"}, {"image": 1}, {"content_type": "image_asset_pointer", "asset_pointer": "f"}, " "]}) == "a\n\nb\n\n[Image attachment: f]"
    made = landed.hydrate([{"_3": 1, "self": 0, "_9": -5}, [2, -3, -4, -6, True, 99], "x", "key"])
    assert made[0]["key"] is made[1] and made[0]["self"] is made[0] and made[0]["_9"] is None
    assert made[1][0] == "x" and made[1][1] != made[1][1] and made[1][2:] == [float("inf"), -0.0, True, 99]
    cp = spark.createDataFrame([("m", "d1", "stop"), ("m", "d2", "length")], "model string, digest string, finish_reason string")
    good, miss = landed.reusable(cp, spark.createDataFrame([("m", "d1"), ("m", "d2")], "model string, digest string"))
    assert (good.count(), miss.first().digest) == (1, "d2")
    sinks.write_tables(str(tmp_path / "out"), nodes=cp)
    assert spark.read.parquet(str(tmp_path / "out/nodes")).count() == 2
    assert views.page_source(spark.createDataFrame([(1, 1, "EXTRACTED", 9), (1, 2, "OPAQUE", 0), (2, 1, "EXTRACTED", 1), (2, 2, "EXTRACTED", 5)], "page int, sequence int, processing_status string, candidate_count int")).select("sequence").collect() == [(2,), (2,)]


def test_streaming_extension(spark, tmp_path):
    from ledgerloom.streaming import incremental

    spark.range(10).selectExpr("id", "'a' as k").write.parquet(str(tmp_path / "in"))
    stream = incremental.landed(spark, str(tmp_path / "in"), "id long, k string")
    incremental.each_batch(stream, lambda df: df.groupBy("k").count(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["count"] == 10


def test_entry_queries_have_matching_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_display_values_divide_as_their_sql(spark, tmp_path):
    """Ties of exact decimals that double precision moves to either side (150 * 1.0001 = 150.015 and the like)."""
    import duckdb

    from ledgerloom.plans.further import ORACLES, QUERIES

    values = [150.0, 550.0, 650.0, 50.0, 0.145, 1.005, 149.996, 2.675]
    rows = [(12 * i + j, v) for i, v in enumerate(values) for j in range(12)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = [tuple(r) for r in QUERIES["display_values"](spark, str(tmp_path)).orderBy("event_id").collect()]
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert got == con.execute(f"select * from ({ORACLES['display_values']}) order by event_id").fetchall()
