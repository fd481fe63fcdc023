"""The pipeline's stages on hostile rows: nulls in every column, empty and very long texts, repeated rows, clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import toxicity

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, file string, row long, doc string, h long, size long, best string, taken long, __file string"
ROWS = [
    (1, "a plain text of a few words"),
    (2, None),
    (3, ""),
    (3, ""),
    (None, "no id here"),
    (4, LONG),
    (5, " \t\n"),
    (6, "vile vile vile"),
    (7, "a plain text of a few words"),
    (None, None),
    (8, "the end"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, None if n % 2 else "en", None if n % 3 else "s", None, "f", n, None, 7, 7, None, None, "x") for n, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture
def model(monkeypatch):
    """A fitted model that knows one word, as the stage's own fit needs labels of both classes."""
    made = toxicity.Model({"vile": 0}, np.array([20.0]), np.array([5.0, 6.0, 7.0]))
    monkeypatch.setattr(toxicity, "fit", lambda *a, **k: made)


def key(rows):
    return sorted(((r.doc_id, r.text, r.row) for r in rows), key=str)


def test_stages_keep_columns_and_clean_rows(spark, sf, model):
    own = docs(spark)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, own, sf)
        assert out.columns == own.columns, name
        kept[name] = key(out.collect())
        assert stage(spark, own.limit(0), sf).count() == 0
    every = key(own.collect())
    assert kept["toxicity"] == [r for r in every if r[1] != "vile vile vile"]
    assert [r[:2] for r in kept["exact_dedup"]] == sorted([(1, ROWS[0][1]), (2, None), (None, "no id here"), (4, LONG), (5, " \t\n"), (6, "vile vile vile"), (8, "the end")], key=str)
    assert len(kept["near_copies"]) == 6 and (4, LONG, 5) in kept["near_copies"]
    assert set(kept["mixing"]) <= set(every) and max(map(kept["mixing"].count, every)) <= 2


def test_last_stage_packs_every_row(spark, sf):
    out = corpus_pipeline.STAGES[-1][1](spark, docs(spark), sf)
    whole = out.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in whole) == out.agg(F.max(F.col("sequence_id") * 1024 + F.col("offset") + F.col("length"))).first()[0]
    assert {r.doc_id for r in whole} == {i for i, _ in ROWS}


def test_neighbours_with_clashing_columns_and_repeated_ids(spark):
    from ledgerloom.llm import neighbours

    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(120)] + [(50, rng.normal(size=16).tolist()), (7, None), (8, [0.0] * 16)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (200, [float("nan")] * 16), (201, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, "s", 1, 2, "q", 3.0) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int, query_id int, v string, fix double")
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and np.isfinite(v).all() and np.any(v)]
    unit = lambda v: v / np.sqrt((v * v).sum())
    for block in (None, 2):
        got = {}
        for r in neighbours.search(frame, frame.where("vec_id % 50 = 0"), 5, block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == {0, 50, 100}
        for q in (0, 100):
            own = next(v for i, v in usable if i == q)
            best = {}
            for i, v in usable:
                if i != q and len(v) == len(own):
                    best[i] = max(best.get(i, -2), float(unit(own) @ unit(v)))
            want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
            assert [g[1] for g in sorted(got[q])] == [i for i, _ in want]
            assert np.allclose([g[2] for g in sorted(got[q])], [s for _, s in want])


def test_html_of_equal_containers_and_of_great_length():
    from ledgerloom.llm import html_text

    part = lambda w: f"<div><p>{w}, with commas, and enough of {w} to be a paragraph that counts, as it should.</p></div>"
    first = html_text.main_text(f"<body><div>{part('one')}</div><nav>x</nav><div>{part('two')}</div></body>")
    assert first.startswith("one,")
    long_ = "".join(f"<p>Paragraph {i}, with commas, and words enough to count, for a while.</p>" for i in range(20_000))
    text = html_text.main_text(f"<html><body><article>{long_}</article></body></html>")
    assert text.count("Paragraph") == 20_000 and text.endswith("for a while.")
