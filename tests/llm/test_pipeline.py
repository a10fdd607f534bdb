"""The whole pipeline against plain Python, stage by stage, on the smallest tables."""

import hashlib
import os
import re

import numpy as np
import pytest
from test_bpe import OWN
from test_simhash import brute_components, brute_fingerprint
from test_small_ops import brute_lines, slow_tiles

import corpus_pipeline
from panelrisk.llm import language

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def tokens(text):
    return re.findall(r"(?:[0-9a-z_]|[^\x00-\x7f])+", (text or "").lower())


def leaks(text, items):
    words = tokens(text)
    grams = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
    for item in items:
        own = tokens(item)
        if any(tuple(own[i:i + 5]) in grams for i in range(len(own) - 4)) and slow_tiles(own, words, 5) >= 0.8 * len(own):
            return True
    return False


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = language.fit(docs.filter(~language.held_out()))
    judge = language._Compressors(model)
    rows = [(i, t) for i, t in rows if not judge.classify(t)["rejected"]]
    rows = [(i, t) for i, t, _, _ in brute_lines(rows)]
    prints = {i: brute_fingerprint(t) for i, t in rows}
    root = brute_components(set(prints.values()), 4)
    first = {}
    for i, f in prints.items():
        first[root[f]] = min(first.get(root[f], i), i)
    rows = [(i, t) for i, t in rows if first[root[prints[i]]] == i]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not leaks(t, items)]
    want = []
    for i, t in rows:
        ids = OWN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
