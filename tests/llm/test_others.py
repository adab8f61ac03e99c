"""Quality, mixing, scoring, language, decontamination, WARC and the pipeline."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import context_mixing, decontamination, language_id, mixing, quality, queries, spread, warc
from tests.llm import brute
from tests.llm.conftest import prose


def table(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


# quality ------------------------------------------------------------------


def check_quality(got, rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(repr((r["doc_id"], *(r[n] for n in names))) for r in got) == sorted(repr((d, *brute.base_quality(t))) for d, t in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(129)] + [(None, 1, 0), (3, 0, 1), (9999, 1, 0), (8, None, None)], "doc_id bigint, quality int, toxic int")


def test_quality(docs, rows, labels):
    check_quality(quality.judge(docs, labels).collect(), rows)


def test_quality_query(spark, sf):
    check_quality(queries.op2_quality_rules(spark, sf).collect(), table(spark, sf))


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 10, 15, 16, 17, 300, 5000) for k in (0, 1, 2, 5, 20, 60) for p in (0.004, 0.02, 0.3) if k <= n]
    df = spark.createDataFrame(cases, "n bigint, k bigint, p double")
    for r in df.withColumn("t", quality.binomial_tail(F.col("n"), F.col("k"), F.col("p"))).collect():
        n, k, p = r["n"], r["k"], r["p"]
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert r["t"] == 1 if k >= n * p else abs(r["t"] - exact) <= 1e-9 * exact


def test_certified_cutoffs(spark):
    """2000 good documents without symbols, 100 bad ones full of them: a strict cutoff is certified; 20 good ones prove nothing."""
    rng = random.Random(1)
    rows = [(i, prose(rng, 40), "en") for i in range(2000)] + [(2000 + i, prose(rng, 40) + " | # $" * 40, "en") for i in range(100)] + [(3000 + i, prose(rng, 40), "fr") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(d, int(not 2000 <= d < 3000)) for d, _, _ in rows], "doc_id bigint, quality int")
    feats = quality.features(docs, ["doc_id", "lang"])
    cuts = {r["_stratum"]: r["cuts"] for r in quality.certified(feats, labels, "lang").collect()}
    assert cuts["en"]["symbols"] == 0.005 and not cuts.get("fr")
    out = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(out[i] for i in range(2000)) and not any(out[2000 + i] for i in range(100)) and all(out[3000 + i] for i in range(20))


def test_quality_stage(spark, docs, rows, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = quality.stage(spark, docs, str(tmp_path))
    kept = [(r["doc_id"], r["text"]) for r in quality.judge(docs, labels).where("kept").join(docs.select("doc_id", "text").distinct(), "doc_id").collect()]
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in out.where("doc_id is not null").collect()} == set(kept)


# mixing -------------------------------------------------------------------


def test_mixing_meets_targets(spark, sf):
    mix = mixing.Mix(targets={"lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}})
    out = mixing.calibrated(spark.read.parquet(f"{sf}/documents.parquet"), mix).toPandas()
    total = out.n_tokens.sum()
    share = (out.n_tokens * out.weight).groupby(out.lang).sum() / total
    assert all(abs(share[k] - v) < 1e-3 for k, v in mix.targets["lang"].items())
    assert abs((out.n_tokens * out.probability).sum() / total - mix.budget) < 1e-6


def test_driver_and_cluster_fits_agree(spark):
    rng = random.Random(3)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", rng.randrange(0, 1000)) for i in range(6) for j in range(3) for k in range(2)], "source string, lang string, topic string, tokens bigint")
    mix = mixing.Mix()
    a = {tuple(r)[:3]: (r["weight"], r["probability"]) for r in mixing.cells_on_driver(cells, mix).collect()}
    b = {tuple(r)[:3]: (r["weight"], r["probability"]) for r in mixing.cells_on_cluster(cells, mix).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-4) for k in a)


def test_mixing_edges(docs, rows, empty):
    out = mixing.calibrated(docs).collect()
    assert len(out) == len(rows) and sorted(r["n_tokens"] for r in out) == sorted(len(brute.words(t)) for _, t in rows)
    drawn = {}
    for r in out:  # equal ids have one draw, so a cell decides alike
        if r["doc_id"] == 7:
            assert drawn.setdefault((r["source"], r["lang"], r["topic"]), r["sampled"]) == r["sampled"]
    assert mixing.calibrated(empty).count() == 0
    assert {r["source"] for r in out} == {"src0", "src1", ""}


def test_mixing_against_raking(spark, sf, monkeypatch):
    """Weights, probabilities and draws of an independent raking, on the driver and on the cluster."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    cells = {}
    for way in (mixing.DRIVER_CELLS, 0):
        monkeypatch.setattr(mixing, "DRIVER_CELLS", way)
        out = mixing.calibrated(d).toPandas()
        cells = out.groupby(["source", "lang", "topic"]).n_tokens.sum().to_dict()
        fitted = brute.raked(cells, [mixing.Mix().powers[m] for m in mixing.MARGINS])
        total = sum(cells.values())
        weight = {k: fitted[k] * total / v if v else 0.0 for k, v in cells.items()}
        c = brute.scaled(list(cells.values()), [weight[k] for k in cells], total / 2)
        key = list(zip(out.source, out.lang, out.topic))
        assert np.allclose(out.weight, [weight[k] for k in key], rtol=1e-6)
        assert np.allclose(out.probability, [min(1.0, c * weight[k]) for k in key], rtol=1e-6)
        assert abs(out.sampled.mean() - out.probability.mean()) < 0.12


def test_stage_names_that_clash(spark, docs):
    """Columns named as the stages' own stay as they are."""
    names = ["row", "lines", "same", "left", "stops", "_h", "_text", "_lines", "probability", "weight", "topic", "n_tokens", "component", "mix_topic", "_row"]
    odd = docs.drop("weight").withColumns({n: F.col("doc_id").cast("string") for n in names})
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns and out.where("doc_id is not null and (row <> cast(doc_id as string) or lines <> row or _lines <> row or component <> row)").count() == 0, name
    out = mixing.stage(spark, odd, "")
    assert out.columns == [c for c in odd.columns if c not in ("probability", "weight", "mix_topic")] + ["mix_topic", "weight", "probability"]
    assert out.where("n_tokens <> cast(doc_id as string) or topic <> cast(doc_id as string) or mix_topic <> topic").count() == 0 and out.count() > 0


def test_stages_on_awkward_and_empty_tables(spark, docs, empty, labels, tmp_path):
    """The pipeline's stages in a row on nulls, repeated rows, long and empty texts, and on no rows at all."""
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (None, "x"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, empty):
        now = start.drop("weight")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            names, before = now.columns, now.count()
            now = spread.cut(stage(spark, now, str(tmp_path)))
            assert now.count() <= before and (now.columns == names or i == 4)
            assert start is empty or before == 0 or now.count() > 0


def test_mixing_repeats(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a = {r["doc_id"] for r in mixing.calibrated(d).where("sampled").collect()}
    assert a == {r["doc_id"] for r in mixing.calibrated(d.repartition(5)).where("sampled").collect()}


# language model -----------------------------------------------------------


def in_training(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 != 0


def check_scores(got, rows):
    want = sorted(repr((d, *map(lambda x: round(x, 6), s))) for (d, _), s in zip(rows, brute.base_scores(rows, [r for r in rows if in_training(r[0])]), strict=True))
    assert sorted(repr((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


@pytest.mark.parametrize("top", [context_mixing.TOP, 40])
def test_scores(docs, rows, top, monkeypatch):
    """Also with few frequent words, so that most words meet the vocabulary by hash."""
    monkeypatch.setattr(context_mixing.most_frequent, "__defaults__", (top,))
    out = context_mixing.score(docs, docs.where(context_mixing.remainder() != 0)).collect()
    check_scores(out, rows)
    same = [r["score"] for r in out if r["doc_id"] == 7]
    assert len(same) == 3 and max(same) - min(same) < 1e-6


def test_score_query(spark, sf):
    rows = table(spark, sf)
    out = queries.op6_lm_scoring(spark, sf).collect()
    check_scores(out, rows)
    assert all(r["held_out"] == (not in_training(r["doc_id"])) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(-r["score"] for r in held) / math.log10(2) < 3.2 * sum(r["n_bytes"] for r in held)


def test_mixing_learns_from_distinct_texts(spark, monkeypatch):
    """A long text ends no sample, copies fill none, the sample grows with the corpus, and no copy of a text predicts it."""
    rng = random.Random(13)
    texts = [prose(rng, 20) for _ in range(300)] + ["copied text " * 9] * 500 + ["long " * 1_000_000]
    train = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(4)
    assert {r["text"]: r["copies"] for r in context_mixing.mixing_sample(train, len(texts)).collect()} == {t: 500 if t[:6] == "copied" else 1 for t in texts}
    monkeypatch.setattr(context_mixing, "MIX_DOCS", 1)
    monkeypatch.setattr(context_mixing, "MIX_SHARE", 4)
    assert 40 < context_mixing.mixing_sample(train, len(texts)).count() < 120
    tree = context_mixing.Tree.of(*context_mixing.huffman(np.ones((256, 256))))
    raw = np.frombuffer(b"copied text " * 9, np.uint8)
    off, bits = np.array([0, len(raw)]), context_mixing.table_bits(0)
    (d,) = context_mixing.decisions(raw, off, tree, bits)
    counts = [np.zeros((1 << b, 2), np.int64) for b in bits]
    for c, s in zip(counts, d.slots):
        np.add.at(c, (s, d.bit.astype(int)), 500)
    for data, at, n in ((raw, off, 1), (np.concatenate([raw, raw]), np.array([0, len(raw), 2 * len(raw)]), 2)):
        assert not any(x.any() for x, _ in context_mixing.features(data, at, tree, counts, np.full(n, 500)))
        assert all(x.all(axis=1).mean() > 0.9 for x, _ in context_mixing.features(data, at, tree, counts, np.full(n, 1)))


@pytest.mark.parametrize("most", [context_mixing.MIX_DOCS, 0])
def test_mixing_learns_from_every_text(spark, monkeypatch, most):
    """Every decision of every training text is in what the weights and the map learn from, in folds and in a small corpus."""
    monkeypatch.setattr(context_mixing, "MIX_DOCS", most)
    monkeypatch.setattr(context_mixing, "MIX_SHARE", 1 << 20)
    maps, made = [], context_mixing.refined
    monkeypatch.setattr(context_mixing, "refined", lambda seen, ones: maps.append((seen.sum(), ones.sum())) or made(seen, ones))
    rng = random.Random(5)
    texts = [prose(rng, 30, 40) for _ in range(200)] + ["long " * 20_000]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model, *_ = context_mixing.fit(train)
    seen = ones = 0
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        for d in context_mixing.decisions(raw, np.array([0, len(raw)]), model.tree, model.table_bits):
            seen, ones = seen + len(d), ones + int(d.bit.sum())
    assert maps == [(seen, ones)]
    again, *_ = context_mixing.fit(train.repartition(7))
    assert np.allclose(again.weights, model.weights, atol=1e-5) and np.allclose(again.refined, model.refined, atol=1e-3)


def test_grams_have_the_decisions_of_texts(monkeypatch):
    """Equal grams are looked at once and stand for all decisions of the texts, of every predictor; a long text goes run by run."""
    rng = random.Random(8)
    texts = [prose(rng, 30, 60) for _ in range(20)] + [None, "", "a", "bc", "NUL \x00 é Ab", "copied " * 3, "copied " * 3, "日本語 テキスト"]
    tree = context_mixing.Tree.of(*context_mixing.huffman(np.random.default_rng(2).integers(0, 1000, (256, 256))))
    bits = context_mixing.table_bits(0)
    for name, size in (("HELD", 700), ("PIECE", 400), ("RUN", 1000)):
        monkeypatch.setattr(context_mixing, name, size)
    for some in (texts, [prose(rng, 900, 300)]):
        fold = [i % 2 for i in range(len(some))]
        found = {0: [], 1: []}
        alone = {(f, k): [] for f in (0, 1) for k in range(len(bits))}
        for f, held in context_mixing.held_grams(iter([pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(fold, pa.int32())], ["text", "fold"])])):
            g, n = context_mixing.distinct(held)
            for rows, d in context_mixing.gram_decisions(g, tree, bits):
                found[f].append(np.repeat(np.stack([d.steps, *d.slots], axis=1), np.repeat(n[rows], np.diff(d.first)), axis=0))
            for k in range(len(bits)):
                for rows, d in context_mixing.gram_decisions(g, tree, bits, k):
                    alone[f, k].append(np.repeat(np.stack([d.steps, d.slots[0]], axis=1), np.repeat(n[rows], np.diff(d.first)), axis=0))
        for f in set(fold):
            want = []
            for t, i in zip(some, fold):
                raw = np.frombuffer((t or "").encode(), np.uint8)
                want += [np.stack([d.steps, *d.slots], axis=1) for d in context_mixing.decisions(raw, np.array([0, len(raw)]), tree, bits) if i == f]
            want = np.concatenate(want)
            got = np.concatenate(found[f])
            assert len(got) == len(want) and (np.unique(got, axis=0, return_counts=True)[1] == np.unique(want, axis=0, return_counts=True)[1]).all()
            assert (np.unique(got, axis=0) == np.unique(want, axis=0)).all()
            for k in range(len(bits)):
                for a, b in zip(np.unique(np.concatenate(alone[f, k]), axis=0, return_counts=True), np.unique(want[:, [0, 1 + k]], axis=0, return_counts=True)):
                    assert (a == b).all()


def test_counts_travel_in_few_bytes(spark, monkeypatch):
    """Tasks send about a byte for a context they have counted, not a table of words each, and the sums are exact, those over 16 bits too."""
    sent, by_bucket = [], spread.by_bucket
    monkeypatch.setattr(spread, "by_bucket", lambda df: sent.append(df) or by_bucket(df))
    rng = random.Random(31)
    texts = ["".join(rng.choices("abcdefghij ", k=6000)) for _ in range(120)] + ["long " * 20_000] * 5
    tree, bits = context_mixing.Tree.of(*context_mixing.huffman(np.ones((256, 256)))), context_mixing.table_bits(0)
    train = context_mixing.with_fold(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)).localCheckpoint()
    monkeypatch.setattr(context_mixing, "with_fold", lambda df: df)
    folds = context_mixing.context_counts(train, tree, bits)
    seen = 0
    want = [[np.zeros((1 << b, 2), np.int64) for b in bits] for _ in folds]
    for row in train.groupBy("fold", F.spark_partition_id().alias("task")).agg(F.collect_list("text").alias("texts")).collect():
        own = [np.zeros((1 << b, 2), np.int64) for b in bits]
        for t in row["texts"]:
            raw = np.frombuffer(t.encode(), np.uint8)
            for d in context_mixing.decisions(raw, np.array([0, len(raw)]), tree, bits):
                for c, s in zip(own, d.slots):
                    np.add.at(c, (s, d.bit.astype(int)), 1)
        seen += sum(np.count_nonzero(c) for c in own)
        for w, c in zip(want[row["fold"]], own):
            w += c
    assert all((a == b).all() for fold, w in zip(folds, want) for a, b in zip(fold, w)) and max(c.max() for w in want for c in w) > 1 << 16
    (packed,) = sent
    assert packed.select(sum(F.sum(F.length(c)) for c in packed.columns if c != "bucket")).first()[0] < 2 * seen


def test_weights_of_least_loss():
    rng = np.random.default_rng(3)
    x = np.rint(rng.normal(size=(20_000, 3)) * context_mixing.SCALE).astype(np.int8)
    y = rng.random(20_000) < 1 / (1 + np.exp(-x @ [0.9, -0.2, 0.5] / context_mixing.SCALE))
    w = np.full((8, 3), context_mixing.START)
    for _ in range(context_mixing.ROUNDS):
        w = context_mixing.stepped(w, context_mixing.curvature(x, (np.full(len(x), 7 << 4) | y).astype(np.uint8), w))
    assert np.abs(w[7] - [0.9, -0.2, 0.5]).max() < 0.1 and (w[:7] == context_mixing.START).all()


def test_scores_against_naive_mixing(spark):
    """Every count, mixed prediction and loss of a small model, one decision at a time; long texts run by run."""
    rng = random.Random(21)
    texts = [prose(rng, 12, 30) for _ in range(40)] + ["", "NUL \x00 é Ab", prose(rng, 30, 20)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model, *_ = context_mixing.fit(train)
    pairs = np.zeros((256, 256), np.int64)
    for t in texts:
        sym = [0] + [max(b, 1) for b in t.translate(brute.FOLD).encode()] + [0]
        for a, b in zip(sym, sym[1:]):
            pairs[a, b] += 1
    code, length = context_mixing.huffman(pairs)
    orders, bits = [o for o, *_ in context_mixing.ORDERS], model.table_bits
    counts = [{} for _ in orders]
    for t in texts:
        for before, node, _, bit in brute.paths(t, code, length):
            for c, o, b in zip(counts, orders, bits):
                s = brute.slot(before, node, o, b)[0] & ((1 << b) - 1)
                c.setdefault(s, [0, 0])[bit] += 1

    def stretched(n):
        x = math.log((n[1] + context_mixing.PRIOR) / (n[0] + context_mixing.PRIOR)) * context_mixing.SCALE
        return 0 if x == 0 else int(math.copysign(min(max(round(abs(x)), 1), 127), x))

    for t in ("never seen before", texts[0], "", "é!"):
        lost = 0.0
        for before, node, depth, bit in brute.paths(t, code, length):
            st = [stretched(c.get(brute.slot(before, node, o, b)[0] & ((1 << b) - 1), (0, 0))) for c, o, b in zip(counts, orders, bits)]
            gate = sum((x != 0) << k for k, x in enumerate(st))
            x = sum(w / context_mixing.SCALE * s for w, s in zip(model.weights[gate], st))
            at = int((min(max(x, -context_mixing.LIMIT), context_mixing.LIMIT) + context_mixing.LIMIT) * context_mixing.STEP)
            lost += float(model.refined[gate, min(depth, 7), at, bit])
        raw = np.frombuffer(t.encode(), np.uint8)
        assert abs(model.bits(raw, np.array([0, len(raw)]))[0] - lost) < 0.05 * max(lost, 1)
    raw = np.frombuffer((" ".join(texts) * 20).encode(), np.uint8)
    whole, run = model.bits(raw, np.array([0, len(raw)])), context_mixing.RUN
    try:
        context_mixing.RUN = 1000
        assert np.allclose(model.bits(raw, np.array([0, len(raw)])), whole)
    finally:
        context_mixing.RUN = run


def test_probabilities_sum_to_one():
    """Over all bytes after a context: the decisions of a tree are a proper code."""
    code, length = context_mixing.huffman(np.random.default_rng(1).integers(0, 1000, (256, 256)))
    assert np.allclose((0.5 ** length.astype(float)).sum(axis=1), 1) and length.max() <= 31
    tree = context_mixing.Tree.of(code, length)
    assert len(tree.steps) == int(length.sum())


def test_scores_without_training(docs, empty):
    out = context_mixing.score(docs, empty).collect()
    assert {r["train_tokens"] for r in out} == {0} and all(r["n_known"] == 0 for r in out)
    assert context_mixing.score(empty, docs).count() == 0


# language -----------------------------------------------------------------


def test_language_query(spark, sf):
    out = queries.op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 200 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)


def test_language_edges(spark, docs, empty):
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 + 4 = ?", "de"), (4, "日本語", "ja"), (5, "the the the", "en"), (6, "der die das", "de"), (7, "x" * 100_000, "en"), (None, "the", None)], "doc_id bigint, text string, lang string")
    odd = odd.unionByName(odd.where("doc_id = 5")).selectExpr("*", "0.5 score", "'x' lang_pred", "1 windows")
    net = language_id.fit(odd)
    assert sorted(r["lang_pred"] for r in language_id.identify(odd, net).where("doc_id = 5").collect()) == [language_id.identify(odd, net).where("doc_id = 5").first()["lang_pred"]] * 2
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, net).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] in net.langs and len(out) == 8 and language_id.identify(odd, net).count() == 9
    assert language_id.fit(empty) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(empty, net).count() == 0


def test_language_sample_takes_each_text_once(spark):
    """A text that is most of a language's rows is one of the sample, and only windows come back."""
    rng = random.Random(8)
    texts = [(f"{prose(rng, 300)} {i}", "en") for i in range(60)] + [(f"{prose(rng, 20)} x{i}", "de") for i in range(30)]
    rows = texts + [(texts[0][0], "en")] * 400 + [(texts[70][0], "de")] * 50 + [(texts[0][0], "de"), (None, "en"), ("", "en"), ("lost", None)]
    got = language_id.sample(spark.createDataFrame(rows, "text string, lang string").repartition(5), 40)
    assert [lang for lang, _ in got] == ["de"] * 20 + ["en"] * 20
    windows = {x.tobytes() for lang, x in got if lang == "en"}
    assert len(windows) == 20 and windows <= {language_id.spread_windows(np.frombuffer(t.encode(), np.uint8)).tobytes() for t, lang in texts if lang == "en"}
    assert all(x.shape[0] <= language_id.WINDOWS and x.shape[1] == language_id.WINDOW for _, x in got)
    everything = language_id.sample(spark.createDataFrame(rows, "text string, lang string"), 100_000)
    assert len(everything) == 60 + 31


def test_convolution_and_gradient():
    """Responses by plain loops, and gradients by finite differences."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(1, 256, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net = language_id.train(x, y, ["a", "b", "c"])
    loss = lambda: -net.log_probabilities(x, [[net.embed @ tap for tap in f] for f in net.filters])[np.arange(5), y].mean()
    for row in x[:2]:
        hidden = []
        for f in net.filters:
            for k in range(language_id.FILTERS):
                hidden.append(max(sum(float(net.embed[row[i + j]] @ f[j][:, k]) for j in range(len(f))) for i in range(len(row) - len(f) + 1)))
        z = np.maximum(np.array(hidden) + net.bias, 0) @ net.out + net.out_bias
        z -= z.max()
        assert np.allclose(net.log_probabilities(row[None], net.tables())[0], z - np.log(np.exp(z).sum()), atol=1e-4)
    params = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
    for p, g in zip(params, language_id.gradients(net, x, y)):
        flat, grad = p.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(grad))[:6]:
            keep, h = flat[i], 1e-5
            flat[i] = keep + h
            up = loss()
            flat[i] = keep - h
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * h) - grad[i]) < 1e-3 + 0.05 * abs(grad[i])


def test_gradient_learns():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(97, 105, (80, 64)), rng.integers(110, 120, (80, 64))]).astype(np.uint8)
    net = language_id.train(x, np.repeat([0, 1], 80), ["a", "b"])
    assert (net.log_probabilities(x, net.tables()).argmax(axis=1) == np.repeat([0, 1], 80)).mean() > 0.98


# decontamination ----------------------------------------------------------

ITEM = "If John Smith buys 12 apples and 3 pears for 5 dollars each, how much does John Smith pay to the shop of Anna in total?"


def found(spark, texts, items=((1, ITEM),), **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, spark.createDataFrame(list(items), "item_id bigint, text string")).collect()}


def test_templates(spark):
    rng = random.Random(9)
    texts = [
        f"{prose(rng, 50)} {ITEM} {prose(rng, 50)}",
        "If Mary Jane buys 40 apples and 7 pears for 9 dollars each, how much does Mary Jane pay to the shop of Bob in total?",
        ITEM.upper(),
        "If Mary buys 40 apples and 40 pears for 40 dollars each, then the slots don't fit and nothing else of it is here.",
        prose(rng, 500),
        None,
        "",
        ITEM[:30],
    ]
    got = found(spark, texts)
    assert got == {(0, 1), (1, 1), (2, 1)}


def test_names_of_any_script(spark):
    """Names start with a capital of whatever script; letters without case are no names."""
    item = "gdzie Łukasz Żak kupuje 12 jabłek i 3 gruszki po 5 zł, ile płaci Łukasz Żak w sklepie u Škoda razem?"
    texts = [
        "gdzie Marek Nowak kupuje 40 jabłek i 7 gruszki po 9 zł, ile płaci Marek Nowak w sklepie u Peter razem?",
        "gdzie Łucja Święta kupuje 4 jabłek i 8 gruszki po 2 zł, ile płaci Łucja Święta w sklepie u Šimon razem?",
        "gdzie Борис Жуков kupuje 4 jabłek i 8 gruszki po 2 zł, ile płaci Борис Жуков w sklepie u Ζωή razem?",
        "gdzie łucja święta kupuje 4 jabłek i 8 gruszki po 2 zł, lecz płaci łucja nic",
    ]
    assert found(spark, texts, ((1, item),)) == {(0, 1), (1, 1), (2, 1)}
    raw = np.frombuffer("aAéÉłŁжЖ日ǅ1".encode(), np.uint8)
    start = np.flatnonzero((raw & 0xC0) != 0x80)
    assert decontamination.starts_upper(raw, start).tolist() == [c.isupper() for c in "aAéÉłŁжЖ日ǅ1"]


def test_slots_that_become_equal_or_conflict(spark):
    """Different numbers may become equal; one altered of two equal numbers costs its own windows only."""
    rng = random.Random(10)
    long = f"{prose(rng, 30)} 12 {prose(rng, 30)} 12 {prose(rng, 30)}".replace(".", "")
    texts = [
        "If Mary Jane buys 4 apples and 4 pears for 9 dollars each, how much does Mary Jane pay to the shop of Bob in total?",
        long.replace(" 12 ", " 13 ", 1),
        long.replace(" 12 ", " 13 "),
        "If Mary buys 40 apples and 40 pears for 40 dollars each, then the slots don't fit and nothing else of it is here.",
    ]
    assert found(spark, texts, ((1, ITEM), (2, long))) == {(0, 1), (1, 2), (2, 2)}
    # equal values that meet different ones everywhere are still no match
    item = "then A took 7 big ones and 7 small ones and 7 red ones and 7 blue ones home"
    assert found(spark, [item.replace("7", "{}").format(1, 2, 3, 4)], ((1, item),)) == set()


def test_copies_of_numbers_and_short_items(spark):
    """What is mostly numbers, and what has few tokens, is found as a copy, and not with other numbers."""
    rng = random.Random(12)
    sums = "12 + 30 = 42; 7 + 8 = 15; 20 + 9 = 29; 3 + 4 = 7; 11 + 6 = 17"
    items = ((1, sums), (2, "2024-05-17"), (3, "Photosynthesis"), (4, "?!"), (5, "Name the Capital"))
    texts = [
        f"{prose(rng, 30)} {sums} {prose(rng, 30)}",
        sums.replace("2", "5").replace("7", "6"),
        f"{prose(rng, 9)} on 2024-05-17 {prose(rng, 9)}",
        "photosynthesis ?! on 2024-05-18",
        "NAME THE capital of it",
        "name its capital 2024-05",
    ]
    assert found(spark, texts, items) == {(0, 1), (2, 2), (3, 3), (4, 5)}


def test_leaks_against_naive_templates(spark):
    """Copies and altered copies among other text, as plain loops over templates find them."""
    rng = random.Random(31)
    names, kinds = ["Anna", "Bob", "Élise", "Carl May"], ["apples", "pears", "km", "hours"]
    made = lambda: " ".join(rng.choice(["the", "a", "of", "sold", "gave", "to", "then", "and.", "who", str(rng.randrange(30)) + " " + rng.choice(kinds), rng.choice(names), "3.5", "why?"]) for _ in range(rng.randrange(2, 30)))
    items = [(i, made()) for i in range(25)]
    texts = []
    for i in range(120):
        t = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            k = rng.randrange(len(t))
            t[k] = str(rng.randrange(30)) if t[k].isdigit() else rng.choice(["the", "Dora", "of", t[k]])
        texts.append(f"{made()} {' '.join(t)} {made()}" if i % 4 else " ".join(t))
    want = {(d, i) for d, t in enumerate(texts) for i, x in items if brute.leaks(t, x, set(decontamination.UNITS))}
    assert found(spark, texts, items) == want and len(want) > 60


def test_blocks_of_the_benchmark(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, prose(rng, 30)) for i in range(40)] + [(50, None), (51, "too short"), (52, "five words are quite enough"), (None, "nobody asks for this one item")]
    texts = [f"{prose(rng, 20)} {t} {prose(rng, 20)}" for _, t in items[:10]] + ["here five words are quite enough indeed"]
    one = found(spark, texts, items)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    assert found(spark, texts, items) == one == {(i, i) for i in range(10)} | {(10, 52)}


def test_leaks_query(spark, sf):
    import re

    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in table(spark, sf) for i, x in items if x in plain(t)}
    assert {(r["doc_id"], r["item_id"]) for r in queries.op7_benchmark_decontamination(spark, sf).collect()} == want


def test_leaks_edges(docs, rows, spark, empty):
    bench = spark.createDataFrame([(1, rows[5][1]), (1, rows[5][1])], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    assert {(5, 1), (110, 1), (115, 1)} <= got
    assert decontamination.leaks(docs, bench.where("false")).count() == 0 and decontamination.leaks(empty, bench).count() == 0


# WARC ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    out = [(i, f"https://WWW.host{i % 5}.example.org:443/p/{i % 9}?q={i}#top", f"<p>{prose(rng, 20)}</p>") for i in range(60)]
    out += [(100 + i, "http://hot.example.com/", "<b>same</b>") for i in range(40)]
    out += [(200, None, None), (201, "x", ""), (202, "http://a/\n", "é日本"), (None, "http://n/", "<b>same</b>"), (7, out[7][1], out[7][2]), (203, "http://big/", "<i>" + "long " * 200_000)]
    return spark.createDataFrame(out, "page_id bigint, url string, html string").withColumn("archive", F.lit("clash"))


def check_pages(got, rows):
    last = {}
    for p, _, h in rows:
        if p is not None:
            last[h or ""] = max(p, last.get(h or "", p))
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        of = last.get(h or "") if p is not None else None
        again = of is not None and of != p
        want.append(repr((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", of if again else None)))
    assert sorted(repr((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == sorted(want)


def test_warc_round_trip(pages):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pages.collect()]
    out = warc.history(pages).collect()
    check_pages(out, rows)
    keys = [(r["url_key"], r["captured_at"], -1 if r["page_id"] is None else r["page_id"]) for r in out]
    assert keys == sorted(keys)


def test_warc_query(spark, sf):
    check_pages(queries.op10_warc(spark, sf).collect(), [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()])


def test_warc_files(spark, pages, tmp_path):
    import gzip

    files = spread.cut(warc.archives(pages))
    assert warc.export(files, str(tmp_path)) == files.count()
    text = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.iterdir())
    assert text.count(b"WARC/1.1\r\n") == pages.count()
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\n\r\n")[:-4]))


def test_url_keys():
    assert warc.url_key("https://user@WWW2.Example.com:8080/A/b?C=d#x") == "com,example:8080)/a/b?c=d" and warc.url_key("http://x.org") == "org,x)/"


def test_loser_tree():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7, 16):
        rows = [sorted(((str(rng.randrange(5)), "t", rng.randrange(50), 0, "", "", None, f"a{i}", j, 0) for j in range(rng.randrange(9))), key=warc.order) for i in range(k)]
        assert list(warc.LoserTree(rows)) == sorted((x for r in rows for x in r), key=warc.order)


def test_warc_empty(pages):
    assert warc.history(pages.where("false")).count() == 0


# components and the pipeline ------------------------------------------------


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (7, 6), (6, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in spread.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for u, v in edges if u != v for x in (u, v)}
    assert spread.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_pipeline_against_its_stages(spark, sf):
    """Each stage on its own input does what its operator says; run() is the stages in order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in now.collect()]
        now = spread.cut(stage(spark, now, sf))
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert set(after) <= {d for d, _ in before}
        if i < 4:
            assert now.columns == names
        if i == 0:
            kept = {r["doc_id"] for r in queries.op2_quality_rules(spark, sf).where("kept").collect()}
            assert set(after) == kept
        if i == 1:
            gone = brute.removed_lines(before)
            for d, t in before:
                left = "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
                assert after.get(d, "") == (left if brute.words(left) or left == t else "")
        if i == 2:
            comp = brute.components(before, 80, 100)
            assert set(after) == {d for d, c in comp.items() if d == c}
        if i == 3:
            bad = {r["doc_id"] for r in decontamination.leaks(spark.createDataFrame(before, "doc_id bigint, text string"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert set(after) == {d for d, _ in before} - bad
    out = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == set(after) and "weight" in out.columns
