"""The pipeline against a brute-force version on a small dataset."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from skein.llm import bpe, simhash


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    texts = [" ".join(word() for _ in range(120)) for _ in range(40)]
    texts += [texts[3], texts[3] + " end", None, "", "123 456", texts[7][:300] + " " + items[2][1] + " " + texts[7][300:]]
    rows = [(i, t, "en" if i % 5 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    fps = {r[0]: simhash.fingerprint(r[1].encode()) for r in kept}
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    kept = [r for r in kept if root[r[0]] == r[0] and not any(t in r[1] for _, t in items)]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = set()
    for r in kept:
        ids = enc.encode_ordinary(r[1])
        want.add((r[0], r[2], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["lang"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want and len(got) == len(want)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
