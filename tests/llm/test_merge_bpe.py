import hashlib
import json

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelrisk.llm import merge_bpe as B

LIB = Tokenizer.from_file(B.default_file())
OWN = B.Tokenizer(B._read(None))
MATCHES = regex.compile(B.default_pattern()).findall
TEXTS = [None, "", " ", "\n", "a", "The cat's hat, isn't it?\nNew line", "two  blanks", " lead", "trail ", "a \nb", "a\n\nb",
         "tab\there and there", "über naïve 12 345 ½ 一二三 😀🏽 ​", "<|endoftext|> x", "x<|endoftext|><|endoftext|>", "<|endoftext",
         "x" * 3000, "ab" * 40_000, "a b " * 4000, "\r\nwin\r\n", "they'll we've 'S 's ' s", "dup", "dup", "\x1c \x85x", "word " + "　" + "wide",
         "new ࢏ letter 𑯀1", "﻿bom", "\x00zero"]


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_encode_and_decode_equal_the_library(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "id again"), (3, "id again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id.x")
    for size, column in ((B.BATCH_BYTES, None), (30, None), (30, "plain.text")):
        out = B.encode(docs, "id.x", "text", batch_bytes=size, decoded_col=column)
        out = (out if column else B.decode(out)).collect()
        assert sorted((str(r[0]), r[1], r[2]) for r in out) == sorted(
            (str(i), ids_of(t), LIB.decode(ids_of(t), skip_special_tokens=False)) for i, t in rows)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab Z9'st.,\n\t\r é一 \x1c\x85½<|>")), st.characters(codec="utf-8")),
                        max_size=30), max_size=4))
def test_any_text(texts):
    ids, ends = B.encode_batch(OWN, texts, MATCHES)
    for t, a, b in zip(texts, ends, ends[1:]):
        assert ids[a:b].tolist() == ids_of(t)
    assert OWN.decode([ids_of(t) for t in texts]) == texts


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50_300), max_size=12))
def test_decode_any_ids(ids):
    assert OWN.decode([ids]) == [LIB.decode(ids, skip_special_tokens=False)]


def slow(symbols, merges):
    """The definition: the lowest rank first, the leftmost of its pairs first."""
    while True:
        found = [(merges[a][b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if b in merges[a]]
        if not found:
            return symbols
        rank, k = min(found)
        symbols = [*symbols[:k], OWN.made[rank], *symbols[k + 2:]]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_merges_by_the_definition(word):
    assert OWN.merge(word) == slow([OWN.first[b] for b in word], OWN.merges)


def test_null_lists_clashing_columns_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", 7, 8, 9)], "doc_id long, text string, id int, ids int, decoded int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    r = B.op13_merge_bpe(spark, str(tmp_path)).collect()
    assert [tuple(x) for x in r] == [(1, 2, hashlib.sha256(",".join(map(str, ids_of("a b"))).encode()).hexdigest(),
                                      hashlib.sha256(b"a b").hexdigest())]
    assert B.encode(docs.filter("false")).collect() == []
    lists = spark.createDataFrame([([64, None, 65],), (None,), ([],), ([-1, 10 ** 6],)], "ids array<int>")
    assert [r["decoded"] for r in B.decode(lists).collect()] == ["ab", None, "", ""]


def test_other_files():
    data = json.loads(B._read(None))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**data["model"], "dropout": 0.1}}):
        with pytest.raises(ValueError, match="byte-level"):
            B.Tokenizer(json.dumps({**data, **change}).encode())
    old = {**data, "model": {**data["model"], "merges": [" ".join(m) for m in data["model"]["merges"]]}}
    assert B.Tokenizer(json.dumps(old).encode()).merges == OWN.merges


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in B.op13_merge_bpe(spark, sf).collect():
        ids = ids_of(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(LIB.decode(ids, skip_special_tokens=False))
