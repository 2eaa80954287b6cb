"""Search, extraction, classifiers and the pipeline."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest_rows import clean, sorted_rows
from pyspark.sql import functions as F

from fathomlog.llm import html_extract, quality, topk, toxicity
from fathomlog.llm.html_pages import labelled_pages
from fathomlog.llm.training import labelled_sample, remainder

# Search.


def plain_top(rows, k):
    real = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in real:
        if q % 20 == 0:
            scored = sorted((-sum(map(lambda a, b: a * b, v, w)), i) for i, w in real if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("blocks", [None, 50])
def test_top_k(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(topk, "CANDIDATES", blocks)
        monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 360)]  # ties
    rows += [(400, None), (420, []), (440, [float("nan")] * 6), (460, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (480, [float("inf")] * 6), (None, rows[0][1]), (500, [0.5, 0.5]), (501, [0.25, -0.5]), (20, rows[7][1]), (520, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<float>, id int, score int").repartition(3)
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20)
    got = [tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()]
    wide = {q: [] for q, *_ in got}
    for q, rank, i, s in got:
        wide[q].append((rank, s, i))
    single = [(i, v) for k, (i, v) in enumerate(rows) if not (i == 20 and k >= 300)]
    expected = [r for r in plain_top(single, 20) if r[0] != 20]
    # The repeated id 20 is two queries and two candidates; all others see one row more at most.
    assert {q for q, *_ in expected} | {20} == set(wide)
    once = topk.top_k(df.where("not (vec_id = 20 and embedding[0] = %r)" % rows[7][1][0]), F.col("vec_id") % 20 == 0, k=20)
    assert sorted_rows(tuple(r) for r in once.select("query_id", "rank", "vec_id", "score").collect()) == sorted_rows(plain_top(single, 20))


def test_threshold_stops_early_and_stays_exact():
    rng = np.random.default_rng(8)
    x = np.floor(64 * rng.normal(0, 0.2, (4000, 3)))
    x[:40] += 300  # a few vectors far ahead: a shallow scan is enough
    lists = topk.SortedLists(np.arange(4000), x)
    queries = np.array([[5.0, 3, 1], [0, 0, 2], [-4, 1, 0]])
    reads = []
    read = lists.read
    lists.read = lambda q, depth: reads.append(depth) or read(q, depth)
    best = lists.best(np.array([-1, -2, -3]), queries, 10)
    assert max(reads) < 1000
    for q, (ids, scores) in zip(queries, best, strict=True):
        full = x @ q
        order = np.lexsort((np.arange(4000), -full))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == full[order].tolist()


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


# Extraction.


@pytest.mark.parametrize("page", range(len(labelled_pages())))
def test_labelled_pages(page):
    before, main, after = labelled_pages()[page]
    text = html_extract.main_text(before + main + after)
    alone = html_extract.main_text(f"<article>{main}</article>")
    assert text == alone and text


WORDS = "plain words of an article that goes on for some time"
PAGES = [
    (None, ""), ("", ""), ("<html></html>", ""), ("   ", ""), ("<!-- only -->", ""), ("<script>var a = '<p>x</p>'</script>", ""),
    (f"<article><p>{WORDS}</p></article>", WORDS),
    (f"<article><h1>A&amp;B &#233;&nbsp;</h1><p>{WORDS}\n\n  more<br>end</p></article>", f"A&B é\n{WORDS} more end"),
    (f"<nav><a>Home</a></nav><main><p>{WORDS}</p><aside>Aside words here</aside><p>{WORDS}</p></main><footer>Foot</footer>", f"{WORDS}\n{WORDS}"),
    (f"<div class='cookie-notice'>We use cookies on this page for you</div><div><p>{WORDS}</p></div><section id=comments><p>{WORDS} said a reader</p></section>", WORDS),
    (f"<article><p>{WORDS}</p><div class='ad'>Buy now {WORDS}</div><form><label>Name</label><input></form><p>{WORDS}</p></article><div class='share'>Share</div>", f"{WORDS}\n{WORDS}"),
    (f"<article><p>{WORDS}<p><b>{WORDS}<br><p>{WORDS}</article><footer>x", f"{WORDS}\n{WORDS}\n{WORDS}"),
    (f"<article><header><h1>Title</h1></header><p>{WORDS}</p></article><header>Site</header>", f"Title\n{WORDS}"),
    (f"<article><p title=\"a > b\">{WORDS}</p><!-- x --><style>p{{}}</style></article>", WORDS),
    (f"<div role=navigation>{WORDS}</div><article><p>a < b {WORDS}</p></article>", f"a < b {WORDS}"),
    (f"<div class=ad>left open {WORDS}<article><p>{WORDS}</p></article>", WORDS),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    assert html_extract.main_text(page or "") == text


MORE = "further words of the same article that must not be lost"


@pytest.mark.parametrize("between", ["<svg width=1 />", "<iframe src=x />", "<video src=x>", "<audio src=x>", "<canvas>", "<object data=x>", "<video>Old browser</video>", "<svg><svg><text>x</text></svg></svg>", "<select><option>One<option>Two</select>"])
def test_text_after_embedded_elements_stays(between):
    page = f"<article><p>{WORDS}</p>{between}<p>{MORE}</p></article><footer>Foot</footer>"
    assert html_extract.main_text(page) == f"{WORDS}\n{MORE}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{WORDS} <math><mi>x</mi></math> <object>fallback</object></p></article>", f"{WORDS} x fallback"),
        (f"<article><p>{WORDS}</p><h2 id='discussion'>Discussion</h2><p>{MORE}</p><h2 id=related-work>Related</h2><p>{MORE}</p></article>", f"{WORDS}\nDiscussion\n{MORE}\nRelated\n{MORE}"),
        (f"<article><div class='post-header'><h1>Title</h1></div><p>{WORDS}</p></article>", f"Title\n{WORDS}"),
        (f"<div class='content has-sidebar'><p>{WORDS}</p><p>{MORE}</p></div>", f"{WORDS}\n{MORE}"),
        (f"<div class='sidebar-layout sidebar'><p>{WORDS}</p><p>{MORE}</p></div><div>x</div>", f"{WORDS}\n{MORE}"),
        (f"<article><ul><li class=ad>Buy<li>{WORDS}</ul><p>{MORE}</p></article>", f"{WORDS}\n{MORE}"),
        (f"<article><p class=ad>Buy<p>{WORDS}</article>", WORDS),
        (f"<article><div><div class=share>Share</article><p>{WORDS}</p>", WORDS),
    ],
)
def test_article_text_is_not_taken_for_something_else(page, text):
    assert html_extract.main_text(page) == text


def test_extract(spark):
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)] + [(None, None, PAGES[6][0]), (6, "u6", PAGES[6][0]), (99, "long", f"<article><p>{'word ' * 60000}</p></article>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(2)
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    texts = {r.page_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.count() == len(rows) and texts[99][1] == 5 * 60000 - 1
    assert all(texts[i] == (t, len(t)) for i, (_, t) in enumerate(PAGES))
    assert html_extract.extract(df.limit(0)).count() == 0


# Classifiers.


def labelled(n, seed=1):
    """Texts of made-up words; bad ones shout, toxic ones hold one of a few words."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioustrn") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(5, 150))]
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if bad:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            words[r.randrange(len(words))] = r.choice(["blarg", "zonk", "fleem"])
        rows.append((i, " ".join(words), "en", "s", len(" ".join(words)), int(not bad), int(toxic)))
    return rows


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    d = quality.BUCKETS + quality.STATISTICS
    model = quality.FactorisationMachine(0.3, rng.normal(0, 1, d).astype(np.float32), rng.normal(0, 0.3, (d, quality.RANK)).astype(np.float32), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    x = np.zeros((1, d), np.float32)
    x[0, [3, 70, 900, d - 1]] = [0.5, 0.2, 0.1, 1.0]
    z = model.prepared(x)[0]
    on = np.flatnonzero(z)
    pairs = sum(z[i] * z[j] * model.factors[i] @ model.factors[j] for a, i in enumerate(on) for j in on[:a])
    logit = 0.3 + z @ model.weights + pairs
    assert model.score(x)[0] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-4)


def test_network_gradients():
    net = toxicity.Network(["one", "two"], ["one", "rar", "rare"], seed=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    inputs = net.word_inputs(["one", "two", "rare"])
    places = np.array([[1, 2], [2, 3], [3, 0], [1, 0]])
    target, weight = np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        logits = net.forward(net.tables(net.embed(*inputs)), places).astype(np.float64)
        return float((weight * (np.logaddexp(0, logits) - target * logits)).mean())

    grads = net.gradients(inputs, places, target, weight)
    rng = np.random.default_rng(1)
    for k, g in grads.items():
        flat = net.p[k].reshape(-1)
        for i in rng.choice(np.flatnonzero(g.reshape(-1)), 4):
            held, step = flat[i], 1e-2
            flat[i] = held + step
            up = loss()
            flat[i] = held - step
            down = loss()
            flat[i] = held
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4), k


def test_windows_cover_every_word():
    for n in [0, 1, 31, 32, 33, 56, 57, 500]:
        document, start, length = toxicity.windows(np.array([10, 10 + n]))
        seen = {i for s, m in zip(start, length, strict=True) for i in range(s, s + m)}
        assert seen == set(range(10, 10 + n)) and set(document) == {0}
        assert all(b - a == toxicity.STRIDE for a, b in zip(start, start[1:], strict=False))


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_learn(spark, kind, tricky):
    rows = labelled(900)
    df = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").unionByName(tricky)
    labels = spark.createDataFrame([(r[0], r[5], r[6]) for r in rows] + [(None, 1, 1), (2, None, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    mod, out_of = (3, 1) if kind == "quality" else (5, 0)
    module = quality if kind == "quality" else toxicity
    model = module.train(df, labels, remainder(F.col("doc_id"), mod) != out_of)
    scores = module.score(df, model)
    assert scores.count() == df.count() and scores.where("score is null or score < 0 or score > 1").count() == 0
    held = scores.where(remainder(F.col("doc_id"), mod) == out_of).join(labels.where("doc_id > 100"), "doc_id")
    good = held.where((F.col("score") >= 0.5).cast("int") == F.col(kind)).count()
    assert good >= 0.9 * held.count()
    assert module.score(tricky.limit(0), model).count() == 0


def test_models_without_both_classes(spark, tricky, nothing):
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for module, allowed in ((quality, F.lit(True)), (toxicity, F.lit(True))):
        assert {round(r.score, 3) for r in module.score(tricky, module.train(tricky, labels, allowed)).collect()} == {1.0}
        assert {r.score for r in module.score(tricky, module.train(nothing, labels, allowed)).collect()} == {0.5}


def test_sample_is_bounded_and_holds_out(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = labelled_sample(df, labels, "quality", remainder(F.col("doc_id"), 3) != 1, per_class=10)
    assert [sum(r[0] == v for r in got) for v in (0, 1)] == [10, 10]
    import zlib

    assert all(zlib.crc32(r[1][1:].encode()) % 3 != 1 for r in got)


def test_scores_of_slices_don_t_depend_on_each_other():
    net = toxicity.fit([r[1] for r in labelled(120)], np.array([r[6] for r in labelled(120)], np.float32), rounds=1)
    texts = ["one two", "", "x " * 400, "blarg"]
    whole = net.score(pa.array(texts))
    assert np.allclose(whole, [net.score(pa.array([t]))[0] for t in texts], atol=1e-5)


# Pipeline.


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rows = labelled(300, 5)
    extra = [(1000 + i, rows[i][1], "en", "s", 1) for i in range(20)] + [(2000, None, "en", "s", None), (2001, "", "en", "s", 0)]
    spark.createDataFrame([r[:5] for r in rows] + extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], r[5], r[6]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4] and docs.select("doc_id").distinct().count() == seen[4]
    toxic = {r[0] for r in rows if r[6]}
    kept = {i for i, _ in clean(spark.read.parquet(str(tmp_path / "toxicity")))}
    assert len(kept & toxic) < 0.2 * len(toxic) and len(kept - toxic) > 0.9 * (len(rows) - len(toxic))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted_rows(whole.select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted_rows(docs.select("doc_id", "piece", "length", "ids_crc32").collect())


def test_repeated_rows_reach_the_packed_output_once(spark, tmp_path, tokenizer):
    """A row listed twice, a row listed often, and copies without ids: long texts that a later stage would remove from every copy."""
    import zlib

    import corpus_pipeline
    from tokenizers import Tokenizer

    texts = {i: t for i, t, *_ in labelled(40, 9) if len(t) > 300}
    (a, b, c), rest = list(texts)[:3], list(texts)[3:]
    rows = [(i, texts[i]) for i in rest] + [(a, texts[a])] * 2 + [(b, texts[b])] * 30 + [(1000 + b, texts[b])] * 3 + [(None, texts[c])] * 4
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        if name != "toxicity":
            docs = stage(spark, docs, str(tmp_path))
    encode = Tokenizer.from_file(tokenizer).encode
    expected = [(i, texts[i]) for i in (*rest, a)] + [(1000 + b, texts[b]), (None, texts[c])]
    packed = [(i, 0, zlib.crc32(np.array([*encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in expected]
    assert sorted_rows(docs.select("doc_id", "piece", "ids_crc32").collect()) == sorted_rows(packed)
