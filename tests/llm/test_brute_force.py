"""Links, links' ranks, page differencing and short items against brute force."""

import json
import random
from collections import Counter, defaultdict


import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F


import corpus_pipeline
from skein.llm import decontaminate, html_text, maxent_lm, token_counts, tool_calls, url_filter

TURNS = "conv_id long, turn long, role string, text string, id string, level int"


def linked(rows, schemas):
    """What link() should give, by loops."""
    kinds = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}
    calls, results = [], []
    for n, (conv, turn, role, text) in enumerate(rows):
        try:
            doc = json.loads(text or "")
        except ValueError:
            continue
        if role == "assistant" and isinstance(doc, dict) and doc.get("tool_calls"):
            calls += [(n, conv, c) for c in doc["tool_calls"]]
        if role == "tool" and isinstance(doc, dict) and doc.get("tool_call_id") is not None:
            results.append((n, conv, turn, doc))
    names = {(conv, c.get("id")) for _, conv, c in calls if conv is not None and c.get("id") is not None}

    def strings(v):
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            for x in v.values():
                yield from strings(x)
        elif isinstance(v, list):
            for x in v:
                yield from strings(x)

    needs = defaultdict(set)
    for _, conv, c in calls:
        if (conv, c.get("id")) in names:
            needs[conv, c["id"]] |= {(conv, s[1:]) for s in strings(c.get("arguments")) if s[:1] == "$" and (conv, s[1:]) in names}
    level = {x: 0 for x in names if not needs[x]}
    while new := {x: 2 + max(level[y] for y in needs[x]) for x in names if x not in level and needs[x] <= set(level)}:
        level |= new
    at = lambda conv, i: level.get((conv, i), -1) if (conv, i) in names else 0
    answers = lambda conv, i: sorted(((t, d.get("content")) for _, v, t, d in results if v == conv and v is not None and i is not None and d["tool_call_id"] == i), key=lambda x: (x[0] or 0, x[1] or ""))
    out = []
    for n, (conv, turn, role, text) in enumerate(rows):
        base = {k: v for k, v in (("role", role), ("turn", turn)) if v is not None}
        mine, own = [c for m, _, c in calls if m == n], [d for m, _, _, d in results if m == n]
        if mine:
            bad, items, got = [], [], 0
            for c in mine:
                found, i, args = answers(conv, c.get("id")), c.get("id"), c.get("arguments")
                got += len(found)
                bad += ["missing id"] if i is None else [] if found else [f"unanswered {i}"]
                fields = schemas.get(c.get("name"))
                if fields is None:
                    bad.append(f"unknown tool {c.get('name') or 'null'}")
                elif not isinstance(args, dict):
                    bad.append("arguments are not an object")
                else:
                    bad += [f"unexpected {k}" for k in args if k not in fields]
                    for f, (kind, required) in fields.items():
                        if f not in args:
                            bad += [f"missing {f}"] if required else []
                        elif not isinstance(args[f], kinds[kind]) or isinstance(args[f], bool) != (kind == "boolean"):
                            bad.append(f"{f} is not {kind}")
                items.append({k: v for k, v in (("arguments", args), ("id", i), ("name", c.get("name")), ("results", [x for _, x in found] or None)) if v is not None})
            lv = [at(conv, c.get("id")) for c in mine]
            out.append((conv, turn, role, len(mine), got, -1 if min(lv) < 0 else max(lv), sorted(bad), tool_calls.canonical(base | {"tool_calls": items})))
        elif own:
            i = own[0]["tool_call_id"]
            many = sum(v == conv and v is not None and c.get("id") == i for _, v, c in calls)
            lv = at(conv, i) if many else 0
            out.append((conv, turn, role, 0, many, lv + 1 if many and lv >= 0 else lv, [] if many else [f"no call {i}"], tool_calls.canonical(base | {k: v for k, v in own[0].items() if v is not None})))
        else:
            out.append((conv, turn, role, 0, 0, 0, [], tool_calls.canonical(base | ({"content": text} if text is not None else {}))))
    return out


def test_tool_calls_by_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for conv in (1, 2, 3, None):
        for turn in range(25):
            if rng.random() < 0.5:
                many = []
                for _ in range(rng.randint(1, 3)):
                    refs = [f"$c{rng.randrange(12)}" for _ in range(2)]
                    args = rng.choice([{"query": refs[0]}, {"query": "x \"q\" é", "limit": 3}, {"url": refs[0], "more": {"b": [refs[1], 1.5], "a": None}}, {"expression": True}, "text", None, {}])
                    call = {"name": rng.choice(["search", "fetch", "calculator", "other", None]), "id": rng.choice([None, *[f"c{i}" for i in range(12)]]), "arguments": args}
                    many.append({k: v for k, v in call.items() if v is not None})
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": many})))
            else:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rng.randrange(14)}", "content": rng.choice(["ok", "é\n", ""])})))
    rows += rows[:5] + [(1, 90, "user", "{not json"), (1, 91, "assistant", "{broken"), (None, None, None, None), (4, 0, "assistant", '{"tool_calls":[]}'), (4, 1, "tool", "{}"), (4, 2, "user", "a" * 300_000)]
    # a cycle, what is behind it, and a chain
    say = lambda i, on: json.dumps({"tool_calls": [{"id": i, "name": "fetch", "arguments": {"url": on}}]})
    rows += [(5, 0, "assistant", say("a", "$b")), (5, 1, "assistant", say("b", "$a")), (5, 2, "assistant", say("c", "$a")), (5, 3, "assistant", say("d", "u")), (5, 4, "assistant", say("e", "$d")), (5, 5, "assistant", say("f", "$e")), (5, 6, "tool", '{"tool_call_id":"f","content":"z"}')]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], TURNS).repartition(3)
    got = [tuple(r) for r in tool_calls.link(df).collect()]
    key = lambda r: tuple(map(str, r))
    want = linked(rows, tool_calls.SCHEMAS)
    # arguments of null values are kept as JSON nulls
    assert sorted(((*r[:6], tuple(r[6]), r[7]) for r in got), key=key) == sorted(((*r[:6], tuple(r[6]), r[7]) for r in want), key=key)


def test_page_rank_by_brute_force(spark):
    rng = random.Random(6)
    hosts = [f"h{i}.net" for i in range(12)] + ["a.org", "b.org", "x.com", "example.org"]
    rows = []
    for i in range(120):
        h = rng.choice(hosts[:3] if i % 3 == 0 else hosts)
        path = rng.choice(["/es/1", "/en/12", "/de/", "/fr/x", ""])
        links = "".join(f"<a href='http://{rng.choice(hosts)}/q'>" for _ in range(rng.randint(0, 3)))
        rows.append((i, f"http://{h}{path}", links, "clash"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string").repartition(3)
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(df).collect()}
    verdict, good, bad, edges = {}, Counter(), Counter(), Counter()
    for i, url, html, _ in rows:
        host, _, path = url[7:].partition("/")
        fits = [(len(h + p), v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and ("/" + path if _ else "").startswith(p)]
        verdict[i] = max(fits)[1] if fits else None
        good[host] += verdict[i] == "allow"
        bad[host] += verdict[i] == "block"
        for to in html.split("http://")[1:]:
            if to.split("/")[0] != host:
                edges[host, to.split("/")[0]] += 1

    def rank(seed, links):
        total = sum(good.values()) + sum(bad.values())
        start = {h: seed[h] / total for h in hosts}
        out, now = Counter(), dict(start)
        for (a, _), w in links.items():
            out[a] += w
        for _ in range(url_filter.ROUNDS):
            lost = sum(now[h] for h in hosts if not out[h]) / sum(start.values())
            new = {h: (1 - url_filter.DAMPING) * start[h] + url_filter.DAMPING * start[h] * lost for h in hosts}
            for (a, b), w in links.items():
                new[b] += url_filter.DAMPING * now[a] * w / out[a]
            now = new
        return now

    trust, distrust = rank(good, edges), rank(bad, Counter({(b, a): w for (a, b), w in edges.items()}))
    for i, url, *_ in rows:
        h = url[7:].partition("/")[0]
        assert got[i] == (verdict[i] or ("block" if distrust[h] > url_filter.RATIO * trust[h] else "allow")), (url, trust[h], distrust[h])
    assert len(got) == 120 and set(got.values()) == {"allow", "block"}
    import duckdb

    pages = df.toPandas()  # noqa: F841  read by the SQL
    assert got == {r[0]: r[4] for r in duckdb.sql(url_filter.judge_sql()).fetchall()}


PAGES = "page_id long, url string, html string, text string, lines int"


@pytest.fixture(scope="module")
def differing(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        host = "big.example" if i % 3 else f"s{i % 4}.example"
        body = "".join(f"<p>{x}</p>" for x in [f"top of {host}", "say", *(f"own {rng.randrange(1000)} line" for _ in range(rng.randint(0, 4))), "say", f"end of {host}"])
        rows.append((i, f"http://{host}/p/{rng.randrange(40):03}", body))
    rows += [(100 + k, f"http://big.example/q/{k}", rows[1][2]) for k in range(20)] + [rows[2], rows[2], (200, None, "<p>lone"), (201, "http://one.example/", "<p>a<p>b"), (202, "http://art.example/1", "<div>top</div><article>x</article>"), (203, "http://art.example/2", "<div>top</div><article>y</article>")]
    return rows


@pytest.mark.parametrize("partitions", ["1", "4", "8", "211"])
def test_differencing_by_brute_force(spark, differing, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.main_text(spark.createDataFrame([(*r, "clash", 1) for r in differing], PAGES).repartition(3)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

    def lcs(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    by_host = defaultdict(dict)
    for i, url, html in differing:
        if "<article>" not in html:
            host, path = (url or "").partition("://")[2].partition("/")[::2]
            own = tuple(x for x, _ in html_text.lines(html))
            by_host[host][own] = min(by_host[host].get(own, "~"), "/" + path if url else "")
    assert len(got) == len(differing)
    texts = defaultdict(set)
    for i, text, n in got:
        texts[i].add(text)
        assert n == len(text)
    assert all(len(t) == 1 for t in texts.values()) and texts[202] == {"x"} and texts[203] == {"y"} and texts[200] == {"lone"} and texts[201] == {"a\nb"}
    for i, url, html in differing:
        if i >= 200:
            continue
        own = tuple(x for x, _ in html_text.lines(html))
        host = url.split("/")[2]
        pages = by_host[host]
        kept = next(iter(texts[i])).split("\n") if next(iter(texts[i])) else []
        paths = sorted(pages.values())
        if len(set(paths)) < len(paths):
            continue  # two pages of one path: their order is by hash
        order = sorted(pages, key=pages.get)
        at = order.index(own)
        prev, next_ = (order[at - 1] if at else None), (order[at + 1] if at + 1 < len(order) else None)
        score = lambda o, own=own, pages=pages: html_text.common_start(pages[own], pages[o])
        other = next_ if prev is None or next_ is not None and score(next_) > score(prev) else prev
        assert len(own) - len(kept) == lcs(own, other) and list(Counter(kept) - Counter(own)) == []


def test_html_marks_and_broken_tags():
    texts = lambda page: [x for x, _ in html_text.lines(page)]
    assert texts("<p>one</p><svg/><p>two</p><p>three") == ["one", "two", "three"]
    assert texts('<article class="post has-comments"><p>x</p><div class="post-comments">c</div><div class="ad-slot">d</div></article>') == ["x"]
    assert texts('<main class="with-sidebar"><p>y</p></main><div class="site-footer">z</div>') == ["y"]
    assert texts("<p>a < b &lt;c&gt; &#x41;&amp;amp;</p><p>d <i>e</i>f<!-- g --> h<![CDATA[<i>]]></p>") == ["a < b <c> A&amp;", "d ef h<i>"]
    for bad in ('<a x="' * 200_000, "<b>" * 200_000 + "<p></p>" * 100_000, "<p><div>" + "<b>" * 200_000 + "<p>x</p>" * 50_000, "<a x=\"y='>" * 100_000):
        html_text.lines(bad)  # a megabyte in seconds
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(2))
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        found, rest = sorted(html_text.shared(a, b)), iter(b)
        assert len(found) == m[-1][-1] and all(any(y == a[i] for y in rest) for i in found)


def test_token_counts_of_strange_characters():
    path = public_tokenizers.path("word_bpe_49k.json")
    count = token_counts.Counts(path, token_counts.whole_tokens(path), token_counts.strange(path))
    for c in [*range(0x2000), 0x3000, 0xA7CB, 0xA7DC, 0x13808, 0x1385C, 0x13988, 0x1F600]:
        text = f"ab{chr(c)}cd {chr(c)}1 x"
        assert count(text) == len(count.tokenizer.encode(text, add_special_tokens=False).ids), hex(c)


def test_decontamination_of_short_items_and_unspaced_scripts(spark):
    items = [(1, "a bc"), (2, "yes"), (3, "un deux trois"), (4, "図書館で本を読むのが好きな学生は毎日そこへ行く"), (5, "日本"), (6, "!!"), (7, "short item of a few letters more")]
    docs = [(1, "zz A, BC zz"), (2, "yesterday"), (3, "Yes."), (4, "Un deux... TROIS"), (5, "昨日図書館で本を読むのが好きな学生は毎日そこへ行くと言った"), (6, "図書館で本を読むのが大好きな学生は毎日そこへ行く"), (7, "x short item of a fwe letters more y"), (8, None), (9, "a b c"), (None, "yes yes"), (3, "Yes.")]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, item_id int")
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == Counter({(1, 1): 1, (3, 2): 2, (4, 3): 1, (5, 4): 1, (5, 5): 0, (6, 4): 1, (7, 7): 1, (None, 2): 1}) - Counter({(5, 5): 0})


def test_pipeline_rows_without_or_with_equal_ids(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80))
    a, b, c, d, item = (text() for _ in range(5))
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, c), (2, d), (None, item + " x"), (7, "12 34")]
    spark.createDataFrame([(i, t, None, "s", 0, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.without_near_duplicates(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(1, a), (None, b), (2, c), (2, d), (None, item + " x"), (7, "12 34")])
    clean = corpus_pipeline.without_leaks(spark, docs, str(tmp_path))
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter(rows) - Counter([(None, item + " x")])


def test_pipeline_computes_each_stage_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "checkpoint", lambda df: seen.append(df) or df)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(i), lambda s, d, f: d) for i in range(4)])
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(seen) == 3




def test_maxent_score_by_brute_force(spark, monkeypatch):
    """Scores of a model with random weights, token by token, and that all events of a context add up to 1."""
    rng, had = random.Random(5), {}
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(90)], k=rng.randint(0, 60))) + f" once{i} Twice{i // 2}" for i in range(60)] + ["never seen", None, ""]

    def trained(docs, classes):
        model, r = maxent_lm.Model(classes), np.random.default_rng(1)
        model.first += r.standard_normal(model.first.shape).astype(np.float32)
        model.second += r.standard_normal(model.second.shape).astype(np.float32)
        had.update(model=model, classes=classes)
        return model

    monkeypatch.setattr(maxent_lm, "train", trained)
    monkeypatch.setattr(maxent_lm.commonest, "__defaults__", (50,))
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double").repartition(3)
    got = {r["doc_id"]: r for r in maxent_lm.score(df, F.col("doc_id") % 10 == 0).collect()}
    model, classes = had["model"], had["classes"]
    split = lambda t: maxent_lm.tokens((t or "").encode()) + [b""]
    counts = Counter(w for i, t in enumerate(texts) if i % 10 for w in split(t))
    rest = {g: {w: c for w, c in counts.items() if w not in classes.symbol and classes.group(w) == g} for g in range(maxent_lm.CLASSES)}
    assert 0 < len(classes.symbol) < len(counts)
    for i, t in enumerate(texts):
        own, total = split(t), 0.0
        symbols, of, _ = classes.coded(own)
        f = maxent_lm.features(symbols, np.array([0]))
        for k, w in enumerate(own):
            z = sum((model.first[f[j, k] % maxent_lm.BUCKETS + j * maxent_lm.BUCKETS] for j in range(3)), model.first[-1])
            p_class = np.exp(z.astype(float)) / np.exp(z.astype(float)).sum()
            everything = 0.0
            for g in range(maxent_lm.CLASSES):
                z = sum((model.second[(f[j, k] % maxent_lm.MEMBER_BUCKETS + j * maxent_lm.MEMBER_BUCKETS) * maxent_lm.CLASSES + g] for j in range(3)), model.second[g - maxent_lm.CLASSES])
                p = np.exp(z.astype(float)) / np.exp(z.astype(float)).sum() * p_class[g]
                mass = sum(rest[g].values())
                unknown = (sum(c == 1 for c in rest[g].values()) + 0.5) / (mass + 1) if mass else 1.0
                events = {x: p[m] * counts[x] / classes.size[g * maxent_lm.MEMBERS + m] for x, s in classes.symbol.items() for h, m in [divmod(int(classes.of[s]), maxent_lm.MEMBERS)] if h == g}
                events |= {x: p[-1] * (1 - unknown) * c / mass for x, c in rest[g].items()} | {None: p[-1] * unknown}
                # members without tokens keep the smoothing's mass
                everything += sum(events.values()) + sum(p[m] for m in range(maxent_lm.MEMBERS - 1) if not classes.size[g * maxent_lm.MEMBERS + m])
                if g == of[k] // maxent_lm.MEMBERS:
                    total += np.log10(events[w if w in counts else None])
            assert abs(everything - 1) < 1e-5
        assert abs(got[i]["score"] - total) < 1e-3 and got[i]["n_known"] == sum(w in counts for w in own)


def test_commonest_is_bounded(spark):
    rows = [(f"t{i}", c) for i, c in enumerate([9, 9, 7, 5, 5, 5, 1, 1, 1, 1])]
    v = spark.createDataFrame(rows, "token string, c long")
    assert [c for _, c in maxent_lm.commonest(v, 4)] == [9, 9, 7] and len(maxent_lm.commonest(v, 10)) == 10 and maxent_lm.commonest(v, 1) == [] and maxent_lm.commonest(v.limit(0), 5) == []
