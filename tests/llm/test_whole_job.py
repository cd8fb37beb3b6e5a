"""Cases where an operator once did less than the whole job."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import ann, decontaminate, html_text, maxent_lm


def nearest_by_brute_force(x, q, k):
    d = ((x - x[q]) ** 2).sum(1)
    d[q] = np.inf
    order = np.lexsort((np.arange(len(x)), d))[:k]
    return order[np.isfinite(d[order])].tolist()


@pytest.mark.parametrize("dims", [24, 64, 100])
@pytest.mark.parametrize("kind", ["groups", "copies only", "lone"])
def test_ann_scan_keeps_copies(kind, dims):
    for seed in range(8):
        rng = np.random.default_rng(seed)
        x = rng.standard_normal((600, dims)).astype(np.float32).astype(np.float64) * 10.0 ** rng.integers(-3, 4)
        if kind == "groups":
            x = x[np.concatenate([np.arange(200), rng.integers(200, 210, 400)])]
        elif kind == "copies only":
            x[:] = x[0]
        else:
            x = x[:1]
        rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        ids, asking = np.arange(len(x)), np.arange(0, len(x), 7)
        got = ann.scan(asking, x[asking], np.full(len(asking), np.inf), ids, x, rotation, 10)
        for q in asking:
            mine = got[got["query_id"] == q]["vec_id"].tolist()
            best = nearest_by_brute_force(x, q, 10)
            assert len(mine) == len(best)
            if ((x == x[q]).all(1)).sum() > 10:
                assert mine == best


def test_ann_of_copies_repeats_and_few_rows(spark):
    rng = np.random.default_rng(4)
    for dims in (24, 64, 128):
        x = rng.standard_normal((600, dims))
        x[100:140] = x[100]
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
        got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 50 == 0).collect())
        assert got == [(q, k + 1, n) for q in range(0, 600, 50) for k, n in enumerate(nearest_by_brute_force(x, q, 10))]
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [5.0, 1.0]), (2, [4.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id long, embedding array<double>, list string, score double")
    assert [tuple(r) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 3.0)]
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    many = spark.createDataFrame([(7 if i % 3 else i, rng.standard_normal(8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    got = ann.search(many, F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 20 and len({(r["query_id"], r["vec_id"]) for r in got}) == 20


def edited(text, share, rng):
    letters = list(text)
    for _ in range(int(share * len(text))):
        i, kind, c = rng.randrange(len(letters)), rng.randrange(3), rng.choice("abcdefghijklmnopqrstuvwxyz")
        letters[i : i + (kind != 1)] = [c, "", c][kind] if kind != 1 else [c]
    return "".join(letters)


@pytest.mark.parametrize("share", [0, 0.05, 0.1, 0.15, 0.2])
def test_decontamination_recall_of_edited_letters(share):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aaabcdeeefghiijklmnnooprrsttu") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(13 + i % 40))) for i in range(160)]
    docs = [" ".join([*(word() for _ in range(60)), edited(t, share, rng), *(word() for _ in range(60))]).encode() for _, t in items]
    hits = decontaminate.Items(items).hits(np.frombuffer(b"".join(docs), np.uint8).copy(), np.cumsum([0, *map(len, docs)]))
    found = {(row, item) for row, item, _, _ in hits}
    assert all(row == item for row, item in found)
    caught = np.array([(i, i) in found for i in range(160)])
    short = np.array([len(t) < 150 for _, t in items])
    least = decontaminate.RECALL if share == 0.2 else 0.99 if share else 1
    assert caught.mean() >= least and caught[short].mean() >= (0.85 if share == 0.2 else 0.95)


def test_decontamination_of_neighbouring_short_documents():
    rng = random.Random(12)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(12, 40)))) for i in range(200)]
    docs = [t.encode() for _, t in items]
    hits = decontaminate.Items(items).hits(np.frombuffer(b"".join(docs), np.uint8).copy(), np.cumsum([0, *map(len, docs)]))
    assert {(r, i) for r, i, _, d in hits if d == 0} == {(i, i) for i in range(200)}


def test_maxent_lm_trains_on_every_position(spark, monkeypatch):
    texts = ["a b c d e f g h i j k l m n o p", "q r", "", None, "s t u v w x y z"] * 5
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    words = sorted({w for t in texts for w in (t or "").split()})
    top = [(b"", 25), *[(w.encode(), 5) for w in words]]
    seen = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(maxent_lm, "learn", lambda model, squares, f, of: seen.add(len(of)))
    maxent_lm.train(docs, maxent_lm.Classes(top, np.zeros((len(top), maxent_lm.ANCHORS))))
    assert seen.value == sum(len((t or "").split()) + 1 for t in texts)


def test_maxent_lm_has_a_leaf_for_every_token():
    rng = np.random.default_rng(3)
    top = [(b"", 900), *[(f"w{i}".encode(), 800 - i // 3) for i in range(700)]]
    classes = maxent_lm.Classes(top, np.zeros((len(top), maxent_lm.ANCHORS)))
    classes.rest[: maxent_lm.LEAVES] = rng.integers(0, 4, maxent_lm.LEAVES)
    model = maxent_lm.Model(classes)
    f = np.repeat(rng.integers(0, 1 << 24, (maxent_lm.TEMPLATES, 1)), len(top), 1)  # one context for all tokens
    symbols = np.arange(len(top))
    below = np.exp(model.log_below(f, classes.decisions(symbols, classes.of)))
    assert np.allclose(below, classes.count / classes.size[classes.of], rtol=1e-4)  # untrained: the shares of counts
    model.third += rng.standard_normal(model.third.shape).astype(np.float32)
    below = np.exp(model.log_below(f, classes.decisions(symbols, classes.of)))
    assert np.allclose(np.bincount(classes.of, below)[np.unique(classes.of)], 1, atol=1e-4)
    at, node, child = classes.decisions(symbols, classes.of)
    paths = [(classes.of[i], *zip(node[at == i].tolist(), child[at == i].tolist())) for i in symbols]
    assert len(set(paths)) == len(top)
    f = np.repeat(f[:, :1], maxent_lm.LEAVES, 1)
    rest = maxent_lm.FREQUENT + np.arange(maxent_lm.LEAVES)
    leaves = np.exp(model.log_below(f, classes.decisions(rest, np.full(len(rest), maxent_lm.REST))))
    assert abs(leaves.sum() - 1) < 1e-4 and leaves[classes.rest[: maxent_lm.LEAVES] == 0].max() < 1e-6


def test_maxent_lm_predicts_tokens_beyond_a_class_commonest(spark, monkeypatch):
    """Which of two tokens of equal counts and of one tier, or of the rest, comes next depends on what is before."""
    monkeypatch.setattr(maxent_lm.commonest, "__defaults__", (33,))  # up, down, seen and lost are in the rest
    filler = " ".join(f"f{i}" for i in range(25))
    texts = [filler] * 1500 + ["left one two", "right six two"] * 700 + ["up seen two", "down lost two"] * 300 + [f"x{i} x{i}" for i in range(40)] * 13
    held = ["left one two", "left six two", "up seen two", "up lost two"]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(-1 - i, t, True) for i, t in enumerate(held)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean").repartition(1)
    got = {r["doc_id"]: r["score"] for r in maxent_lm.score(df, F.col("h")).where("held_out").collect()}
    assert got[-1] > got[-2] + 1 and got[-3] > got[-4] + 1


def test_maxent_lm_sums_gradients_by_bucket():
    """The sums of a step are those of a plain loop, for buckets met once, a few times and very often."""
    rng = np.random.default_rng(5)
    p = rng.standard_normal((5000, 16)).astype(np.float32)
    for row in (rng.integers(70, 4000, 5000), 9 + np.minimum(rng.zipf(1.3, 5000), 80_000), rng.integers(3, 9, 5000), np.full(5000, 7), np.arange(5000) * 40):
        keys, got = maxent_lm.summed(row, p)
        want = np.zeros((row.max() + 1, 16))
        np.add.at(want, row, p)
        assert sorted(keys) == sorted(set(row)) and np.abs(got - want[keys]).max() < 1e-3
    weights = np.array([[500.0, -500, 499, 0], [1, 2, 3, 4]], np.float32)  # powers of e beyond a float
    assert np.allclose(maxent_lm.chosen(weights, np.array([[0, 1]]), np.array([0, 3])), [-np.log(1 + np.exp(-1)), -np.log(np.exp(np.arange(-3, 1)).sum())], atol=1e-5)


def test_maxent_lm_near_counts_change_nothing(spark, monkeypatch):
    """The same rows whether workers have the counts of all tokens, of some, or only those with own symbols; a text that repeats a rare token too."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(400)], k=rng.randint(0, 80))) + f" once{i} again{i} again{i}" for i in range(300)] + [None, "", "new new new again7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).localCheckpoint()
    monkeypatch.setattr(maxent_lm.commonest, "__defaults__", (60,))
    got = []
    for near in (0, 150, 100_000):
        monkeypatch.setattr(maxent_lm, "NEAR", near)
        got.append({r["doc_id"]: r for r in maxent_lm.score(df, F.col("doc_id") % 10 == 0).collect()})
    assert len(got[0]) == len(texts)
    for other in got[1:]:
        for i, r in got[0].items():
            assert [r[x] for x in ("held_out", "n_tokens", "n_known", "train_tokens")] == [other[i][x] for x in ("held_out", "n_tokens", "n_known", "train_tokens")]
            assert abs(r["score"] - other[i]["score"]) < 1e-3 and abs(r["base_score"] - other[i]["base_score"]) < 1e-9


@pytest.mark.parametrize("broadcast", [0, 50_000])
def test_html_differences_inside_articles(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", broadcast)
    licence = "<p>Licensed to all."
    page = lambda i, more="": f"<div>top</div><article><p>Read our paper edition.<p>Own line {i}.{more}<p>Tell your friends.</article>"
    rows = [(i, f"http://a.example/{i}", page(i, licence if i in (3, 4) else "")) for i in range(8)]
    rows += [(8, "http://a.example/7b", page(7)), (9, "http://a.example/x", "<p>Tell your friends.<p>No article."), (10, "http://a.example/y", "<p>Tell your friends.<p>Nor here.")]
    rows += [(20 + i, f"http://b.example/{i}", page(i)) for i in range(2)]  # too few pages to tell
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    want = {i: f"Own line {i}." + ("\nLicensed to all." if i in (3, 4) else "") for i in range(8)} | {8: "Own line 7.", 9: "No article.", 10: "Nor here."}
    assert got == want | {20 + i: f"Read our paper edition.\nOwn line {i}.\nTell your friends." for i in range(2)}
