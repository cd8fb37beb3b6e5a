"""Operators against brute force and libraries on small, awkward tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skein.llm import ann, bpe, decontaminate, html_text, language_id, maxent_lm, simhash, token_counts, tool_calls, url_filter

LONG = "anoninth ther whtion, " * 3000
TEXTS = ["", None, "Hello WORLD's  the\tend\n\n", "héé ñandú Straße 12345 ½ x²", LONG, "the the", "the the", "   ", "a" * 700, "ab" * 100_000 + " xq" * 5, " ".join(f"zq{i % 7}v" for i in range(400)), "日本語のテキスト 😀😀 ok", "İΣΟΣ <|endoftext|> don't", "x\u0085y  z　"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["en", None, "fr"][i % 3], "s", 0, "clash") for i, t in enumerate(TEXTS)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_tiktoken(docs, none):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rows = bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), text[:40]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0


def test_token_counts_equal_library(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = token_counts.load(path)
    for r in token_counts.count_tokens(docs, path, 10).collect():
        text = TEXTS[r["doc_id"]] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 10), text[:40]
    assert token_counts.count_tokens(none, path).count() == 0


def test_language_model_code_lengths():
    from math import log2

    texts = [("a", "abab" * 20), ("b", "xyzz" * 20)]
    m = language_id.PPM(texts)

    def brute(model_text, data):
        train, bits = b"\0" * 4 + model_text.encode(), 0.0
        full = b"\0" * 4 + data
        for i in range(4, len(full)):
            for k in range(4, -2, -1):
                if k < 0:
                    bits += 8
                    break
                context = full[i - k : i]
                seen = [train[j] for j in range(4, len(train)) if train[j - k : j] == context]
                if not seen:
                    continue
                total, distinct = len(seen), len(set(seen))
                if full[i] in seen:
                    bits -= log2(seen.count(full[i]) / (total + distinct))
                    break
                bits -= log2(distinct / (total + distinct))
        return bits

    data = b"abaxyz!ab"
    got = m.score(np.frombuffer(data + data, np.uint8), np.array([0, len(data), len(data), 2 * len(data)]))
    for i, (_, t) in enumerate(texts):
        assert abs(got[0, i] - brute(t, data)) < 1e-3 and got[1, i] == 0 and abs(got[2, i] - got[0, i]) < 1e-6


def test_language_id_cases(docs, none):
    texts = [("en", "the and of to that with " * 30), ("fr", "le la des une avec pour être " * 30)]
    out = {r["doc_id"]: r for r in language_id.identify(docs, texts).collect()}
    assert len(out) == len(TEXTS) and out[0]["lang_pred"] == out[1]["lang_pred"] == out[7]["lang_pred"] == "und" and out[5]["lang_pred"] == "en" and out[5]["key"] == "clash"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language_id.identify(none, texts).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, []).collect()} == {"und"}
    assert len(language_id.training_sample(docs, F.lit(True), 2)) <= 4 and language_id.training_sample(none, F.lit(True)) == []


def test_maxent_lm(spark, docs, none):
    from collections import Counter
    from math import log10

    held = language_id.held_out(10) == 0
    rows = maxent_lm.score(docs, held).collect()
    assert len(rows) == len(TEXTS)
    train = Counter()
    for r in rows:
        if not r["held_out"]:
            train.update((TEXTS[r["doc_id"]] or "").encode().lower().split() + [b""])
    n, v = sum(train.values()), len(train)
    for r in rows:
        words = (TEXTS[r["doc_id"]] or "").encode().lower().split() + [b""]
        assert r["n_tokens"] == len(words) and r["train_tokens"] == n and r["n_known"] == sum(w in train for w in words)
        assert abs(r["base_score"] - sum(log10((train.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)) < 1e-6 * len(words)
        assert r["score"] < 0
    assert maxent_lm.score(none, held).count() == 0
    assert maxent_lm.score(docs, F.lit(True)).count() == len(TEXTS)


def test_simhash_equals_brute_force(spark, none):
    rng = random.Random(5)
    words = ["Ab", "cd", "eF", "gh", "ij"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 40]))) for _ in range(150)]
    for k in range(60):
        t = texts[rng.randrange(150)].split() or ["x"]
        t[rng.randrange(len(t))] = f"w{k}"
        texts.append(" ".join(t))
    texts += [None, "", texts[3], LONG]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    fps = [simhash.fingerprint((t or "").encode()) for t in texts]
    import xxhash

    for t, fp in zip(texts, fps):
        w = (t or "").lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        assert fp == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    up = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and up[i] != up[j]:
                    up[i] = up[j] = min(up[i], up[j])
                    changed = True
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert {i: (f"{fps[i]:016x}", up[i]) for i in range(len(texts))} == {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()}
    assert simhash.near_duplicates(none).count() == 0


def test_trie_links_connect_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    keys = np.unique(np.concatenate([base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 30)).astype(np.uint64)), base[:, None]], 1).ravel())
    forest = simhash.Forest(len(keys))
    for i, j in simhash.trie_links(keys):
        assert int(keys[i] ^ keys[j]).bit_count() <= 2
        forest.join(i, j)
    for i in range(0, len(keys), 7):
        for j in np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= 2):
            assert forest.root(i) == forest.root(int(j))


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[1000:1300] = x[1000]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (5300, [1.0]), (None, [1.0] * 24), (5400, [None] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    assert len(got) == 300
    hits = 0
    d = x.astype(np.float64)
    for q in range(0, 3000, 100):
        dist = np.sqrt(((d - d[q]) ** 2).sum(1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(3000), dist))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r["score"] - dist[r["vec_id"]]) < 1e-9 for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(best.tolist()))
        if q == 1000:
            assert [r["vec_id"] for r in mine] == best.tolist()
    assert hits >= 0.9 * 300
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_html(spark):
    page = lambda body, foot="f": f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li>menu</ul></nav><div class='ad x'>buy</div>{body}<footer>{foot}</footer></body></html>"
    rows = [
        (1, "http://A.example/x/1", page("<article><h1>A&amp;B</h1><p>one <b>two<br>three<p>four  &eacute;\n five<aside>no</aside><div class='comments'><p>c</p></div></article>")), (2, "http://a.example/x/2", page("<p>shared line</p><p>own two</p>")),
        (3, "http://a.example/x/3", page("<p>shared line</p><p>own three</p>")), (4, None, None), (5, "http://b.example/", ""), (6, "http://c.example/", page("<p>alone &#x41;&lt;</p><form>f</form><!-- c --><script>var t='</p>'</script>")), (6, "http://c.example/", "plain < text"),
    ]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = {1: "A&B\none two three\nfour é five", 2: "own two", 3: "own three", 4: "", 5: ""}
    assert all(t == want[i] for i, t, _ in got if i in want) and all(len(t) == n for _, t, n in got) and len(got) == 7
    assert {t for i, t, _ in got if i == 6} == {"alone A<", "plain < text"}
    a, b = list("abcbdab"), list("bdcaba")
    assert len(html_text.shared(a, b)) == 4
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_filter(spark):
    link = "<a href='http://bad.example.org/es/'>x</a>"
    rows = [(1, "http://Example.ORG/es/1", ""), (2, "http://a.org", None), (3, "http://a.org/x?q#f", "<a href=\"https://friend.net/\">"), (4, "https://x.com/de/1", ""), (5, "nourl", ""), (6, None, ""), (7, "http://friend.net/", ""), (8, "http://shady.net/p", link), (9, "http://sub.example.org/en/12", ""), (9, "http://bad.example.org/es/9", "")]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect() if r["page_id"] is not None)
    by = {g[0]: g[1:] for g in got if g[0] != 9}
    assert by[1] == ("example.org", "/es/1", "example.org/es/", "block") and by[2] == ("a.org", "", None, "allow") and by[3][2:] == ("org/", "allow") and by[4][2:] == ("com/de/", "block")
    assert by[5] == by[6] == ("", "", None, "allow") and by[7][2:] == (None, "allow") and by[8][2:] == (None, "block") and len(got) == 10
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decontamination(spark, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(30)] + [(90, None), (91, ""), (92, "two words")]
    clean = [" ".join(word() for _ in range(200)) for _ in range(60)]
    docs, want = [], {}
    for i, c in enumerate(clean):
        if i < 30:
            leak = items[i][1].split()
            if i % 3:
                for _ in range(3):
                    leak[rng.randrange(len(leak))] = word()
            leak = " ".join(leak).upper() if i % 2 else ",  ".join(leak)
            c, want[i] = c[:400] + " " + leak + " " + c[400:], i
        docs.append((i, c))
    docs += [(100, None), (101, ""), (102, LONG)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.find_leaks(d, b).collect()}
    assert got == want
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0 and decontaminate.find_leaks(none, b).count() == 0


def test_anywhere_is_edit_distance():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode() for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            old, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
        assert decontaminate.anywhere(a, b)[0] == min(row)


def test_tool_calls(spark):
    call = '{"tool_calls":[{"id":"c1","name":"search","arguments":{"query":"a","limit":3}},{"id":"c2","name":"fetch","arguments":{"url":"$c1","more":1}}]}'
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"c1","content":"found"}'), (1, 3, "tool", '{"tool_call_id":"zz","content":"?"}'), (2, 0, "assistant", "{broken"), (None, None, None, None)]
    got = {(r["conv_id"], r["turn"]): r for r in tool_calls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 6 and got[1, 0]["json"] == tool_calls.canonical({"content": "hi", "role": "user", "turn": 0})
    assert got[1, 1]["n_calls"] == 2 and got[1, 1]["level"] == 2 and got[1, 1]["problems"] == ["unanswered c2", "unexpected more"] and '"results":["found"]' in got[1, 1]["json"]
    assert got[1, 2]["level"] == 1 and got[1, 2]["n_linked"] == 1 and got[1, 3]["problems"] == ["no call zz"] and got[2, 0]["n_calls"] == 0
    assert tool_calls.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
