import random
import zlib

import numpy as np
import pytest

from keyloft.llm import quality, toxicity
from keyloft.llm.labelled import sample
from tests.llm.conftest import EDGES

D = "/root/testdata/sf0.01"


def area(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")


@pytest.mark.parametrize("module, label, folds, out", [(quality, "quality", 4, 2), (toxicity, "toxic", 3, 1)])
def test_held_out_rows(spark, tables, module, label, folds, out):
    docs, labels = tables
    model = module.fit(docs, labels)
    rows = module.judged(docs, model).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    s, y = np.array(held).T
    assert area(s, y) > 0.93 and ((s >= 0.7) == y).mean() > 0.93
    again = module.fit(docs.repartition(3), labels)
    assert {r["doc_id"]: r["score"] for r in module.judged(docs, again).collect()} == {r["doc_id"]: r["score"] for r in rows}


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels = tables
    kept = sample(docs, labels, "quality", 4, 2)
    texts = {r["text"].encode() for r in docs.join(labels, "doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    assert kept and all(t in texts for t, _ in kept)
    assert len(sample(docs, labels, "quality", 4, 2, per_class=5)) == 10
    assert sample(docs, labels.limit(0), "quality", 4, 2) == []


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edges(spark, edges, none, tables, module):
    model = module.fit(*tables)
    rows = module.judged(edges, model).collect()
    assert len(rows) == len(EDGES) and module.judged(none, model).count() == 0
    score = {str(r["doc_id"]): r["score"] for r in rows}
    assert score["1"] == score["5"] == score["6"] and score["2"] == score["3"]
    wide = module.score(edges, model, "mark")
    assert wide.columns == [*edges.columns, "mark"] and wide.count() == len(EDGES)
    clash = module.score(edges, model, "SCORE")
    assert [c for c in clash.columns if c.lower() == "score"] == ["SCORE"] and clash.count() == len(EDGES)
    kept = quality.score(edges, model, "mark", threshold=0.0) if module is quality else toxicity.score(edges, model, "mark", below=2.0)
    assert kept.columns == edges.columns and kept.count() == len(EDGES)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_one_class_or_none_is_no_error(spark, tables, edges, module):
    docs, labels = tables
    for some in (labels.limit(0), labels.where("quality = 1 and toxic = 1")):
        assert {0 <= r["score"] <= 1 for r in module.judged(edges, module.fit(docs, some)).collect()} == {True}


def test_quality_scores_do_not_depend_on_batches(monkeypatch):
    rnd = random.Random(1)
    rows = [(" ".join(rnd.choice(["good", "fine", "text"]) for _ in range(30)).encode(), 1) for _ in range(40)] + [(("JUNK!! " * 20).encode(), 0) for _ in range(40)]
    model = quality.train(rows)
    texts = [t for t, _ in rows] + [b"", b"a", b" ", "é".encode() * 50, b"x" * 3000]
    together = model.scores(texts)
    assert (together == np.array([model.scores([t])[0] for t in texts])).all()
    assert together[:40].min() > 0.9 and together[40:80].max() < 0.1
    monkeypatch.setattr(quality, "PIECE", 64)
    assert (model.scores(texts) == together).all()
    assert sum(map(len, quality.pieces(b"ab cd " * 100))) == 600


def plain_features(text):
    """Every feature of a text by its definition, as text: n-grams of marked words, words, and repeats."""
    words = text.decode("utf-8", "replace").split()
    out = []
    for k, w in enumerate(words):
        marked = quality.BEGIN + w + quality.END
        out += [("gram", marked[i : i + n]) for n in quality.GRAMS for i in range(len(marked) - n + 1)]
        out += [("word", w)] * quality.WORD_WEIGHT
        out += [("again", "")] * (quality.WORD_WEIGHT * (k > 0 and words[k - 1] == w))
    return out


def plain_bucket(kind, text):
    """The bucket of one feature, character by character."""
    if kind == "again":
        return quality.REPEAT
    if kind == "gram":
        code = 0
        for c in text:
            code = (code * 16777619 + ord(c)) % 2**32
        return int(quality._mix(np.array([code + len(text) * 0x9E3779B], np.uint64).astype(np.uint32), quality.GRAM_BITS)[0])
    code = sum((ord(c) + 1) * pow(16777619, i % 4096 + 1, 2**32) for i, c in enumerate(text)) % 2**32
    return int(quality._mix(np.array([code], np.uint32), quality.WORD_BITS)[0]) + (1 << quality.GRAM_BITS)


TEXTS = [b"ab ab\nc", b"", b"  ", "é é x 日本語 ß".encode(), b"\xff\xfe bad utf", b"a" * 5000 + b" tail tail", b"one two two two\tthree"]


def test_features_equal_the_definition():
    for t in TEXTS:
        assert sorted(quality.document_features(t).tolist()) == sorted(plain_bucket(*f) for f in plain_features(t))


def test_scores_equal_the_definition(monkeypatch):
    """The score of a text is that of the mean of its features' vectors, whatever the cuts; also of very long words and texts without white space."""
    rng = np.random.default_rng(1)
    table = rng.integers(-(1 << 14), 1 << 14, quality.BUCKETS).astype(np.int32)
    expected = []
    for t in TEXTS:
        ids = [plain_bucket(*f) for f in plain_features(t)]
        mean = int(table[ids].sum()) / quality.SCALE / max(1, len(ids)) if ids else 0.0
        expected.append(1 / (1 + np.exp(-(0.25 + mean))))
    for piece, chunk, long in ((1 << 20, 1 << 18, 64), (3, 7, 2), (1, 1 << 10, 5)):
        monkeypatch.setattr(quality, "PIECE", piece)
        monkeypatch.setattr(quality, "CHUNK", max(chunk, long))
        monkeypatch.setattr(quality, "LONG", long)
        assert np.allclose(quality.Model(table, 0.25).scores(TEXTS), expected, rtol=1e-12, atol=0)
    monkeypatch.setattr(quality, "MEMORY", 2)
    assert np.allclose(quality.Model(table, 0.25).scores(TEXTS), expected, rtol=1e-12, atol=0)


def plain_training(rows, epochs=8, rate=0.4, seed=1):
    """The same descent with loops over features instead of matrix products; log-odds of each bucket, and the bias."""
    labels = [y for _, y in rows]
    n1 = sum(labels)
    docs = []
    for text, _ in rows:
        share = {}
        for f in plain_features(text):
            b = plain_bucket(*f)
            share[b] = share.get(b, 0) + 1
        total = sum(share.values())
        docs.append({b: n / total for b, n in share.items()})
    random_ = np.random.default_rng(seed)
    vectors = random_.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM))
    out, bias = np.zeros((2, quality.DIM)), np.zeros(2)
    weight = [len(labels) / 2 / (len(labels) - n1), len(labels) / 2 / n1]
    step = 0
    for _ in range(epochs):
        for k in random_.permutation(len(docs)):
            h = sum((s * vectors[b] for b, s in docs[k].items()), np.zeros(quality.DIM))
            z = [float(out[c] @ h + bias[c]) for c in (0, 1)]
            p = np.exp(np.array(z) - max(z))
            p = p / p.sum()
            p[labels[k]] -= 1
            p = p * rate * (1 - step / (epochs * len(docs))) * min(4.0, weight[labels[k]])
            step += 1
            back = p[0] * out[0] + p[1] * out[1]
            for c in (0, 1):
                out[c] -= p[c] * h
                bias[c] -= 0.1 * p[c]
            for b, s in docs[k].items():
                vectors[b] -= min(1.0, s * len(docs[k])) * back
    return vectors @ (out[1] - out[0]), bias[1] - bias[0]


def test_training_equals_plain_loops():
    rnd = random.Random(5)
    rows = [(" ".join(rnd.choice(["good", "fine", "text", "of", "it"]) for _ in range(12)).encode(), 1) for _ in range(15)] + [(" ".join(rnd.choice(["JUNK", "!!", "$$"]) for _ in range(9)).encode(), 0) for _ in range(8)]
    model = quality.train(rows)
    table, bias = plain_training(rows)
    assert np.abs(model.table / quality.SCALE - table).max() < 2e-3 and abs(model.bias - bias) < 1e-4


def all_segments(s):
    """Maximal scoring segments by their recursive definition."""
    out = []

    def within(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > 0 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j + 1)
        if best:
            within(a, best[1])
            out.append((best[1], best[2]))
            within(best[2], b)

    within(0, len(s))
    return out


def test_segments_equal_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.integers(-5, 6, rng.integers(0, 16)) + rng.random(1) * 0.01
        s = s + rng.random(len(s)) * 0.01
        assert [x[:2] for x in toxicity.segments(s)] == all_segments(s)


def test_segments_take_linear_time():
    s = np.tile([1.0, -0.999], 200_000)
    assert len(toxicity.segments(s)) == 1
    assert len(toxicity.segments(-(np.arange(200_000) % 7) - 1.0)) == 0


def small_model():
    return toxicity.Model(toxicity.Odds({"bad": 5.0, "worse": 7.0}, [{}, {}]), 1.5, 0.01, 2.0, -3.0)


def test_every_copy_of_a_passage_is_found_and_counts_once():
    model, passage, gap = small_model(), ["you", "bad", "worse", "bad"], ["x"] * 40
    once, total = model.found([*gap, *passage, *gap])
    many, more = model.found([*gap, *passage, *gap, *passage, *gap, *passage, *gap])
    assert [(a, b) for a, b, *_ in once] == [(41, 44)] and [(a, b) for a, b, *_ in many] == [(41, 44), (85, 88), (129, 132)]
    assert len({round(s, 9) for _, _, s, _ in many}) == 1
    assert more == pytest.approx(model.surprise(once[0][2], 40 * 4 + 12)) and total > more
    repeated, counted = model.found(["bad"] * 50)
    assert [(a, b) for a, b, *_ in repeated] == [(0, 50)] and counted == pytest.approx(model.surprise(5.0 - toxicity.DRIFT, 50))


def plain_odds(rows):
    """Log-odds of every word by loops over sets of pairs."""
    texts = [(toxicity.tokens(t.decode()), y) for t, y in rows]
    pairs = [{(w[k - 1] if k else None, w[k]) for w, y in texts if y == c for k in range(len(w))} for c in (0, 1)]
    least = min(map(len, pairs))

    def count(cls, name, value):
        return len({a for a, b in pairs[cls] if name(b) == value}) * least / len(pairs[cls])

    out = {}
    for w in {b for p in pairs for _, b in p}:
        prior = 0.5
        for name in (lambda x: x[:4], lambda x: x[:5], lambda x: x):
            c, t = (count(k, name, name(w)) for k in (0, 1))
            prior = (t + toxicity.PRIOR * prior) / (c + t + toxicity.PRIOR)
        out[w] = np.log(prior / (1 - prior))
    return out


def random_rows(seed=3):
    rnd = random.Random(seed)
    plain = [f"w{i}" for i in range(30)] + ["badger", "badly"]
    rows = []
    for k in range(60):
        y = int(k % 4 == 0)
        w = [rnd.choice(plain) for _ in range(rnd.randint(5, 40))]
        for _ in range(3 * y):
            w.insert(rnd.randrange(len(w)), rnd.choice(["badword", "badworse", "nasty"]))
        rows.append((" ".join(w).encode(), y))
    return rows


def test_log_odds_equal_the_definition():
    rows = random_rows()
    counts = toxicity.Counts(t.decode() for t, _ in rows)
    own = counts.log_odds([k for k, r in enumerate(rows) if not r[1]], [k for k, r in enumerate(rows) if r[1]])[0]
    expected = plain_odds(rows)
    assert set(counts.names) == set(expected)
    assert all(own[k] == pytest.approx(expected[w]) for k, w in enumerate(counts.names))
    model = toxicity.train(rows)
    assert all(model.odds.of(w) + toxicity.DRIFT == pytest.approx(x, abs=0.06) for w, x in expected.items())
    assert model.odds.of("badwo") > model.odds.of("unknown") == -toxicity.DRIFT


def test_the_law_of_clean_text_equals_its_definition():
    rng = np.random.default_rng(2)
    s = np.round(rng.choice([-1.0, -0.4, 0.9], 5000, p=[0.5, 0.3, 0.2]), 3)
    x = toxicity.decay_of(s)
    assert np.exp(x * s).mean() == pytest.approx(1, abs=1e-6) and x > 0
    # segments of random text exceed a score about as often as the law says
    n, texts = 400, 400
    best = [max(v for *_, v in toxicity.segments(rng.choice([-1.0, -0.4, 0.9], n, p=[0.5, 0.3, 0.2]))) for _ in range(texts)]
    rate = np.exp(np.mean([x * b - np.log(n) for b in best]) - np.euler_gamma)
    level = np.quantile(best, 0.9)
    assert 1 - np.exp(-rate * n * np.exp(-x * level)) == pytest.approx(0.1, abs=0.06)


def test_the_link_is_the_maximum_of_its_likelihood():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 80), rng.normal(2, 1, 20)])
    y = np.repeat([0, 1], [80, 20])
    weight = np.where(y == 1, 100 / 2 / 20, 100 / 2 / 80)

    def cost(a, b, ridge=0.02):
        z = a * x + b
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() + ridge / 2 * (a * a + b * b))

    a, b = toxicity.logistic(x, y)
    assert all(cost(a, b) <= cost(a + da, b + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_a_score_equals_its_parts(spark):
    rows = random_rows()
    model = toxicity.train(rows)
    for text in ("w1 w2 badword nasty w3 badword nasty", "", "w1", "nasty " * 30, " ".join(["w1", "w2", "badword", "w5"] * 5)):
        words = toxicity.tokens(text)
        s = np.array([model.odds.of(w) for w in words])
        found = [(a, b) for a, b in all_segments(s) if model.surprise(s[a:b].sum(), len(words)) >= -np.log(toxicity.EXPECTED)]
        seen, total = set(), 0.0
        for a, b in found:
            fresh = s[a:b].copy()
            for k in range(a, b):
                if s[k] > 0:
                    pair = (words[k - 1] if k else None, words[k])
                    if pair in seen or pair[0] == pair[1]:
                        fresh[k - a] = -toxicity.DRIFT
                    seen.add(pair)
            total += sum(v for v in (model.surprise(fresh[c:d].sum(), len(words)) for c, d in all_segments(fresh)) if v >= -np.log(toxicity.EXPECTED))
        assert [x[:2] for x in model.found(words)[0]] == found
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-(model.slope * np.log1p(total) + model.shift))))


def test_passages(spark, tables, edges):
    model = toxicity.fit(*tables)
    docs, labels = tables
    toxic = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi")
    rows = toxicity.score(toxic, model, "t", passages=True).select("text", "t", "t_passages").collect()
    assert any(r["t_passages"] for r in rows)
    for r in rows:
        n = len(toxicity.tokens(r["text"]))
        assert all(0 <= p["start"] < p["stop"] <= n for p in r["t_passages"])
