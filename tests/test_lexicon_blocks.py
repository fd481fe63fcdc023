"""Lexicon occurrences against brute force, points of period tables as nodes, operators that work in many blocks."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.operators import evaluation, evidence, lexicon, ranking, tables


def brute(text, names):
    marks = [(m.start(), m.start() + len(n), n) for n in names if n for m in (re.match(re.escape(n), text[i:], re.IGNORECASE) and re.compile(re.escape(n), re.IGNORECASE).match(text, i) for i in range(len(text))) if m]
    out = []
    for m in sorted(marks, key=lambda m: (m[0], -m[1], m[2])):
        if not out or m[0] >= out[-1][1]:
            out.append(m)
    return out


NAMES = st.lists(st.text(alphabet="abAB率é", max_size=4), max_size=8)


@given(st.text(alphabet="abABé率 ", max_size=40), NAMES)
@settings(max_examples=300, deadline=None)
def test_trie_against_brute_force(text, names):
    trie = lexicon.Trie(names)
    assert lexicon.thinned(trie.marks(text)) == list(trie.marks(text, True)) == brute(text, names)


def test_lexicon_of_several_blocks(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["", None, "EV/EBITDA", "ev/ebit", "ROE", "roe"]
    texts = ["".join(rng.choice("abcABC ") for _ in range(80)) for _ in range(20)] + ["", None, "Roe EV/ebitda ev/EBITx"]
    rows = spark.createDataFrame(list(enumerate(texts)), "found int, text string").withColumn("row", F.lit("r"))
    lex = spark.createDataFrame([(n,) for n in names], "name string")
    known = [n for n in names if n]
    for most in (1 << 20, 40):
        got = {r.found_: [tuple(m) for m in r.hits] for r in lexicon.occurrences(rows, "text", lex, "hits", most).select(F.col("found").alias("found_"), "hits", "row").collect()}
        assert got == {i: brute(t or "", known) for i, t in enumerate(texts)}
    assert lexicon.occurrences(rows, "text", lex.limit(0), "hits").where("size(hits) > 0").count() == 0


def test_points_of_period_tables_as_nodes(spark):
    head = "2023A 2024A 2025E 2026E 2027E"
    rows = [(1, 1, 1, "table_like", f"{head}\nroe 1% 2% 3% 4% 5% 归母净利润增速 1 2 3 4 +5 EV/EBIT 1 2\n"), (1, 1, 2, "paragraph", "ROE 1% 2% 3% 4% 5%"), (1, 1, 3, "paragraph", "ROE 1% 2% 3% 4% 5%"), (2, 1, 1, "table_like", f"{head}\nROE 1% 2% 3% 4% 5%")]
    points = tables.periodic(spark.createDataFrame(rows, "doc_id int, page int, sequence int, object_type string, text string"))
    assert {r.metric for r in points.collect()} == {"ROE", "归母净利润增速"}
    nodes, proof = tables.periodic_nodes(points, spark.createDataFrame([(1, "Firm")], "doc_id int, issuer string"))
    got = {(r.label, r.subject_ref is not None): (r.mentions, r.value.unit, r.value.normalized_decimal) for r in nodes.collect()}
    assert got[("ROE 2023A = 1%", True)] == (3, "percent", "1") and got[("ROE 2023A = 1%", False)] == (1, "percent", "1")
    assert got[("归母净利润增速 2027E = +5", True)] == (1, "CNY", "5") and len(got) == 15
    assert proof.count() == 5 * (3 + 1 + 1) and {r.quote for r in proof.where("doc_id = 1 and sequence = 1").collect()} == {"roe 1% 2% 3% 4% 5%", "归母净利润增速 1 2 3 4 +5"}
    own = tables.periodic(spark.createDataFrame(rows, "doc_id int, page int, sequence int, object_type string, text string"), spark.createDataFrame([("Roe",), (head[:5],)], "name string"))
    assert {r.metric for r in own.collect()} == {"Roe"}


def size(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("\n")


def test_many_blocks_give_the_same_rows_and_no_larger_plan(spark):
    texts = spark.createDataFrame([(i, f"the quick {i} brown fox {i % 7} jumps") for i in range(40)], "doc_id int, text string")
    quotes = spark.createDataFrame([(i, f"quick  {i} brown" if i % 2 else f"fox {i} jumps") for i in range(30)], "item_id int, quote string")
    whole, cut, finer = (evidence.quote_matches(quotes, texts, block) for block in (1 << 20, 60, 30))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) == sorted(map(tuple, finer.collect()))
    assert size(cut) == size(finer)
    asked = spark.createDataFrame([(i, [f"{i}", "fox", f"brown{i}", "quick"]) for i in range(23)], "question_id int, terms array<string>")
    chunks = texts.withColumnRenamed("doc_id", "chunk_id")
    whole, cut, finer = (ranking.scored(chunks, asked, block) for block in (5000, 5, 2))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) == sorted(map(tuple, finer.collect()))
    assert size(cut) == size(finer)


def test_specifications_in_blocks(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}", "Claim", f"growth of unit {i % 9}") for i in range(30)], "id string, node_type string, text string")
    specs = spark.createDataFrame([(f"s{i}", None, [f"unit{i}"], None) for i in range(12)], "spec_id string, node_types array<string>, all_terms array<string>, any_term_groups array<array<string>>")
    whole = sorted(map(tuple, evaluation.match_nodes(nodes, specs).collect()))
    monkeypatch.setattr(evaluation, "SPEC_BLOCK", 4)
    assert sorted(map(tuple, evaluation.match_nodes(nodes, specs).collect())) == whole and len(whole) == 30


def test_texts_are_worked_on_in_parts_of_a_batch():
    import pyarrow as pa

    from ledgerloom.functions.batches import slices

    whole = pa.RecordBatch.from_pydict({"x": list(range(300))})
    parts = list(slices([whole, whole.slice(0, 0), whole.slice(5, 3)]))
    assert [p.num_rows for p in parts] == [128, 128, 44, 3]
    assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(300), 5, 6, 7]
