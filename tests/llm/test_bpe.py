import hashlib

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from panelrisk.llm import bpe

OWN = tiktoken.Encoding("own", pat_str=bpe.default_pattern(),
                        mergeable_ranks=bpe.read_ranks(open(bpe.default_ranks(), "rb").read()), special_tokens={})
TEXTS = [None, "", " ", "\n", "a", "The cat's hat, isn't it?\nNew line", "two  blanks", " lead", "trail ", "a \nb", "a\n\nb",
         "tab\there and there", "über naïve 12 345 ½ 一二三 😀🏽 ​", "<|endoftext|> x", "x" * 3000, "a b " * 4000,
         "\r\nwin\r\n", "they'll we've 'S 's ' s", "dup", "dup", "\x1c \x85x", "word " + "　" + "wide"]


def ids_of(text):
    return np.array(OWN.encode_ordinary(text or ""), "<u4").tobytes()


def test_encode_and_decode_equal_the_library(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "id again"), (3, "id again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "id.x")
    for size in (bpe.BATCH_BYTES, 30):
        out = bpe.decode(bpe.encode(docs, "id.x", "text", batch_bytes=size)).collect()
        assert sorted((str(r[0]), bytes(r[1]), bytes(r[2])) for r in out) == sorted(
            (str(i), ids_of(t), (t or "").encode()) for i, t in rows)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8, 9)], "doc_id long, text string, batch int, ids int, decoded int")
    r = bpe.digests(docs).collect()
    assert len(r) == 1 and r[0]["n_tokens"] == 2
    assert r[0]["ids_sha256"] == hashlib.sha256(ids_of("a b")).hexdigest()
    assert r[0]["decoded_sha256"] == hashlib.sha256(b"a b").hexdigest()
    assert bpe.digests(docs.filter("false")).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Z9'st.,\n\t\r é一 \x1c\x85½")), max_size=25), max_size=5))
def test_pre_tokens_equal_the_pattern(texts):
    import regex
    matches = regex.compile(bpe.default_pattern()).findall
    words, docs = bpe.number([None, *texts], matches)
    assert len(set(words)) == len(words) and len(docs[0]) == 0
    for t, d in zip(texts, docs[1:]):
        assert [words[k] for k in d.tolist()] == matches(t)
        assert sum((OWN.encode_ordinary(w) for w in matches(t)), []) == OWN.encode_ordinary(t)
    counts = np.bincount(np.concatenate(docs).astype(int), minlength=len(words))
    assert (np.diff(counts) <= 0).all()


def test_colliding_hashes_do_not_matter(monkeypatch):
    import regex
    matches = regex.compile(bpe.default_pattern()).findall
    monkeypatch.setattr(bpe, "mix", lambda h: h % np.uint64(2))
    words, docs = bpe.number(["a b c a", "d e\nf"], matches)
    assert [[words[k] for k in d.tolist()] for d in docs] == [matches("a b c a"), matches("d e\nf")]


@given(st.lists(st.integers(0, 524_535), max_size=50), st.sampled_from([300, 524_536, 600_000]))
def test_packing_round_trip(codes, n_words):
    x = np.array([c % n_words for c in codes], np.uint32)
    assert bpe.unpack(bpe.pack(x, n_words), len(x), n_words).tolist() == x.tolist()


def test_slices_share_their_words():
    import regex
    matches = regex.compile(bpe.default_pattern()).findall
    texts = ["a b\nc", None, "", "b  b a", "一 b", " lead", "c c c c c", ""]
    for size in (1, 6, bpe.SLICE_CHARS):
        words, docs = bpe.number(texts, matches, size)
        assert len(set(words)) == len(words) and words[0] == " c"
        assert [[words[k] for k in d.tolist()] for d in docs] == [matches(t or "") for t in texts]


def test_numbering_holds_a_bounded_multiple_of_a_batch():
    import random
    import tracemalloc

    import regex
    matches = regex.compile(bpe.default_pattern()).findall
    draw = random.Random(5)
    texts = [" ".join(draw.choices(["and", "some", "words", "of", "a", "text", "x1"], k=1_000)) for _ in range(1_600)]
    tracemalloc.start()
    words, docs = bpe.number(texts, matches)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, docs)) >= 1_600_000
    # four bytes a position and its few copies, and the arrays of one slice
    assert peak < 10 * sum(map(len, texts)), peak / sum(map(len, texts))
