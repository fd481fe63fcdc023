"""Classifiers on held-out rows, token counts and PII against plain Python, HTML, neighbours, the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import html_text, neighbours, pii, quality, token_counts, toxicity

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, score double, spans string, toxic boolean"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 20_000), (4, "word " * 20_000), (None, "no id"), (5, "x" * 50_000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_on_held_out_rows(spark, small):
    model = quality.fit(*small)
    y = {r.doc_id: r.quality for r in small[1].collect()}
    rows = [r for r in quality.score(small[0], model).collect() if r.doc_id in y]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == y[r.doc_id] for r in held) / len(held) > 0.93
    odd = quality.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(docs(spark, []), model).count() == 0
    blank = quality.fit(small[0], small[1].limit(0))
    assert [r.score for r in quality.score(docs(spark, ODD[:1]), blank).collect()] == [0.5]


def test_quality_scores_by_hand(spark, small):
    """Pooling, network and temperature once more, word by word and unit by unit."""
    model = quality.fit(*small)
    rows = small[0].orderBy("doc_id").limit(25).select("doc_id", "text").collect() + [(-i, t) for i, t in enumerate(("", "word", "two words", None, "Zx9- Zx9- 12.5 \u00df"), 1)]
    got = {r.doc_id: r.score for r in quality.score(docs(spark, [tuple(r) for r in rows]), model).collect()}
    vector = lambda w: [float(x) for x in model.vectors[model.words.get(w) or model.shapes.get(quality.shape(w), 0)]]
    for i, text in rows:
        v = [vector(w) for w in (text or "").split()]
        n, dim = len(v), quality.DIM
        mean = [sum(x[d] for x in v) / max(1, n) for d in range(dim)]
        pair = [sum(a[d] * b[d] for a, b in zip(v, v[1:], strict=False)) / max(1, n - 1) * dim for d in range(dim)]
        x = [(f - m) / s for f, m, s in zip([*mean, *pair, math.log(1 + n)], model.mean, model.scale, strict=True)]
        hidden = [math.tanh(sum(a * w for a, w in zip(x, model.w1[:, h], strict=True)) + model.b1[h]) for h in range(quality.HIDDEN)]
        z = sum(a * w for a, w in zip(hidden, model.w2, strict=True)) + model.b2
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z / model.temperature)), rel=1e-3, abs=1e-6)


def test_toxicity_by_hand(spark, small):
    """Features, shared weight and ordered thresholds once more, feature by feature."""
    model = toxicity.fit(*small)
    toxic = [r.doc_id for r in small[1].where("toxic = 1").collect()]
    rows = small[0].where(F.col("doc_id").isin(toxic)).limit(20).union(small[0].limit(20)).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in toxicity.score(docs(spark, [tuple(r) for r in rows]), model).collect()}
    for i, text in rows:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        count = Counter(f for w in words for f in [w, *(w[:k] + "-" for k in (4, 5, 6) if len(w) > k)] if f in model.known)
        z = sum(model.weights[model.known[f]] * math.log(1 + n) for f, n in count.items())
        p = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        steps = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
        assert got[i].p_toxic == pytest.approx(p[0], abs=1e-9) and got[i].severity == pytest.approx(sum(k * x for k, x in enumerate(steps)), abs=1e-9)
        assert got[i].grade == steps.index(max(steps)) and got[i].toxic == (p[0] >= 0.5)


def test_toxicity_on_held_out_rows(spark, small):
    model = toxicity.fit(*small)
    assert all(np.diff(model.thresholds) > 0)
    y = {r.doc_id: r.toxic for r in small[1].collect()}
    held = [r for r in toxicity.score(*[small[0], model]).collect() if r.held_out and r.doc_id in y]
    assert all(not r.toxic for r in held if y[r.doc_id] == 0)
    assert sum(r.toxic for r in held if y[r.doc_id]) >= 0.8 * sum(y[r.doc_id] for r in held)
    odd = toxicity.score(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and not any(r.toxic for r in odd) and all(0 <= r.severity <= 3 for r in odd)
    kept = toxicity.reject(docs(spark, ODD), model)
    assert kept.count() == len(ODD) and kept.columns == docs(spark, ODD).columns
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_token_counts_equal_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    path = public.path("piece_bpe_32k.model")
    exact = Tokenizer(Unigram([list(p) if False else p for p in token_counts.vocabulary(path)], 0, True))
    count = lambda t: len(exact.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
    own = token_counts.counter(path)
    texts = ["", " ", "  a  b ", "a\nb", "ünïcode 日本語 😀", "▁▁ x", "<s> <0x0A> <unk>", "aaaaaaaaab", "1.2.3 !!", "x" * 300]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    rng = random.Random(4)
    texts += ["".join(rng.choice("abth e▁\n日é") for _ in range(40)) for _ in range(200)]
    for t in texts:
        assert own.count(t) == count(t), repr(t[:60])
    rows = {r.n_chars: r.n_tokens for r in token_counts.counts(docs(spark, ODD), path).collect()}
    assert rows[0] == 0 and len(rows) == 5
    assert token_counts.counts(docs(spark, []), path).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def test_pii_against_plain_python(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(("a", "B", "@", ".", "-", "_", "%", " ", "1", "4", "42", "255", "300", "+1", "(", ")", "😀", "é", "\n")) for _ in range(60)) for _ in range(150)]
    texts += [None, "", "call +1 (663) 555-6869 or 4111 1111 1111 1111, a@b.c_d@e.f", "1.2.3.4.5.6.7.8 001.02.3.0255", "9" * 30_000, "a" * 30_000 + "@", "x.y" * 9000, "GB82WEST12345698765432 DE00WEST12345698765432", "my ssn 078-05-1120, not 078-05-1120"]
    rows = {r.doc_id: r for r in pii.report(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want, r = plain_spans(t), rows[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), repr(t)[:80]
        n = Counter(x.split(":")[0] for x in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (n["email"], n["ip"], n["card"], n["phone"])
        assert set(want) <= set(r.spans.split(",")) | set()
    assert rows[len(texts) - 2].spans == "iban:0:22" and rows[len(texts) - 1].spans == "ssn:7:18"
    assert pii.report(docs(spark, [])).count() == 0
    assert pii.report(docs(spark, ODD)).count() == len(ODD)


BODY = "<p>First, a paragraph of some length, with commas, that reads like an article &amp; more.</p><p>Second one, just as <b>lo</b>ng, which goes on and on, until it is over, at last.<br>Line</p>"
WANT = "First, a paragraph of some length, with commas, that reads like an article & more. Second one, just as long, which goes on and on, until it is over, at last. Line"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><a href=x>Menu</a></nav><article>{BODY}</article><footer>foot</footer></body></html>",
        f"<body><header><h1>Site</h1></header><div id=content>{BODY}</div><div class='sidebar'><p>Side text that is long enough, surely, to count as one.</p></div></body>",
        f"<div class=page><div class=post>{BODY}<ul><li><a href=1>link one</a><li><a href=2>link two</a></ul></div><div class='comments'><p>A reader says, at some length, that this is wrong.</p></div></div>",
        f"<main><form><p>Subscribe, please, to our long letter, now</p><input></form>{BODY}<script>if (a<b) x('</p>')</script><style>p{{}}</style><aside>Aside</aside></main>",
        f"<div class=cookie-notice>We use cookies, as all do, for reasons.</div><section>{BODY}</section><div class='ad banner'>Buy, now, this thing here, cheap</div>",
        f"<article>{BODY}<!-- note <p>hidden</p> --><div style='display: none'>gone</div><div hidden>gone too</div></article>",
    ],
)
def test_main_text(page):
    assert html_text.main_text(page) == WANT


def test_html_hostile(spark):
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><nav><a>x</a></nav></html>") == ""
    assert html_text.main_text("just text") == "just text"
    deep = "<div>" * 20_000 + "deep text here that is long enough, really" + "</div>" * 20_000
    assert html_text.main_text(deep).startswith("deep text")
    for junk in ("<a href='x", "<" * 5000, "<p class=\"x>" * 50, "<!-- never closed", "</p></div>&#x;&bogus;", "<p>" * 3000):
        html_text.main_text(junk)
    pages = spark.createDataFrame([(1, None, None, 3), (1, None, None, 3), (None, "u", "<p>text of a page</p>", 4)], "page_id long, url string, html string, text int")
    rows = html_text.extract(pages).collect()
    assert [r.n_chars for r in rows] == [len(r.text) for r in rows] and len(rows) == 3
    assert html_text.extract(pages.limit(0)).count() == 0


def test_neighbours_recall_and_hostile_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 48))
    v = [(i, (centres[i % 20] + 0.4 * rng.standard_normal(48)).tolist()) for i in range(1500)]
    v += [(1500, v[0][1]), (1501, v[0][1])]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 48), (2003, [float("nan")] + [1.0] * 47), (2004, [float("inf")] * 48), (2050, [None] + [1.0] * 47), (None, [1.0] * 48), (2051, [1.0, 2.0]), (2100, [1e200] * 48), (2101, [1e-200] * 48)]
    df = spark.createDataFrame(v + odd, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 50 = 0"), block=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    m, ids = np.array([x for _, x in v] + [[1.0] * 48, [1.0] * 48]), np.array([i for i, _ in v] + [2100, 2101])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        c = u @ u[q]
        c[q] = -9
        want = ids[np.lexsort((ids, -np.round(c, 12)))[:5]].tolist()
        rows = sorted(got[ids[q]])
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        for _, i, s in rows:
            assert s == pytest.approx(c[np.flatnonzero(ids == i)[0]], abs=1e-9)
        hit += len({i for _, i, _ in rows} & set(want))
        total += 5
    assert hit / total >= 0.97 and not {2000, 2050, 2002} & got.keys()
    one = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:3] for r in neighbours.search(one, one.where("vec_id = 0")).collect()] == [(0, 1, 7)]
    assert neighbours.search(one.limit(0), one.limit(0)).count() == 0


def test_pipeline_against_plain_python(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_mixing_packing import hash_of, plain_mix, reference_ids
    from test_near_copies import brute_kept

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(table, model).collect() if r.toxic}
    rows = sorted((r.doc_id, r.text, r.source) for r in table.collect() if r.doc_id not in bad)
    first = {}
    for r in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    rows = sorted(first.values())
    kept = [rows[i] for i in brute_kept(rows)]  # near copies: five words, a similarity of 0.8 or more
    size, target = plain_mix(kept)
    tokens = Counter()
    for s in size:
        mine = sorted((hash_of(i), i, len(t.split())) for i, t, x in kept if x == s)
        base = int(target[s] // size[s]) if size[s] else 0
        rest, used = target[s] - base * size[s], 0
        for _, i, n in mine:
            extra = used is not None and (used + n <= rest or used + n - rest < rest - used)
            used = used + n if extra and used + n <= rest else None
            tokens[i] += base + extra
    texts = {i: t for i, t, _ in kept}
    want = Counter({i: n * (len(reference_ids(texts[i])) + 1) for i, n in tokens.items() if n})
    got = Counter()
    for r in pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
    assert got == want
