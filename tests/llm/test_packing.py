import random

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from panelrisk.llm import bpe, packing as P

OWN = tiktoken.Encoding("own", pat_str=bpe.default_pattern(),
                        mergeable_ranks=bpe.read_ranks(open(bpe.default_ranks(), "rb").read()), special_tokens={})


def slow_best_fit(lengths, length):
    rooms, out = [], []
    for k, n in enumerate(lengths):
        fits = [r for r in rooms if r >= n]
        if not fits:
            rooms.append(length - n)
            out.append(length - n)
        else:
            i = rooms.index(min(fits))
            rooms[i] -= n
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 33), max_size=60), st.integers(33, 40))
def test_best_fit_equals_the_slow_search(sizes, length):
    sizes = sorted(sizes, reverse=True)
    got = P.best_fit(sizes, length)
    assert sorted(k for s in got for k in s) == list(range(len(sizes)))
    assert sorted(length - sum(sizes[k] for k in s) for s in got) == slow_best_fit(sizes, length)


def test_round_trip(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", "one"] + [" ".join(rng.choice(["alpha", "beta", "gammadelta", "x."]) for _ in range(rng.randint(1, 400)))
                                 for _ in range(120)] + ["long tail of words " * 900]
    rows = [*enumerate(texts), (5, texts[5]), (None, "no id here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pack", "2 as ids", "3 as start")
    P.write_packed(P.pack(docs, length=64, group_bytes=20_000), str(tmp_path / "packed"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        ids, pos = np.frombuffer(bytes(r["ids"]), "<u4"), np.frombuffer(bytes(r["positions"]), "<u4")
        cu = r["cu_seqlens"]
        assert len(ids) == len(pos) == 64 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 64
        assert (ids[cu[-1]:] == P.PAD_ID).all() and (pos[cu[-1]:] == 0).all()
        assert pos[:cu[-1]].tolist() == [x for a, b in zip(cu, cu[1:]) for x in range(b - a)]
        for d, s, a, b in zip(r["docs"], r["starts"], cu, cu[1:]):
            got.setdefault(d, []).append((s, ids[a:b].tolist()))
    want = {}
    for d, t in rows:
        ids = OWN.encode_ordinary(t or "")
        want.setdefault(d, []).extend((s, ids[s:s + 64]) for s in range(0, len(ids), 64))
    assert {d: sorted(v) for d, v in got.items()} == {d: sorted(v) for d, v in want.items() if v}
    assert P.pack(docs.filter("false")).collect() == []
    assert bpe.default_ranks().endswith("byte_bpe_50k.tiktoken")
