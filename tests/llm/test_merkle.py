import hashlib
import random
import zlib

import pytest

from panelrisk.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """(root, each node's list of (left, right) up to it)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, a in enumerate(at):
            first = a // 3 * 3
            paths[k].append(("".join(level[first:a]), "".join(level[a + 1:first + 3])))
        level = [h(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [a // 3 for a in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = lambda t: h(*map(field, (doc_id, source, lang, n, t)))
        torn = text if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 2 else text.replace("\n", "")
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf(text), leaf(torn), doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in order:
        groups[s].sort(key=lambda r: r[:3])
        subs.append(tree([r[2] for r in groups[s]]))
    root, tops = tree([s for s, _ in subs])
    out = []
    for s, (sub, paths), top in zip(order, subs, tops):
        for (_, _, leaf, torn, doc_id), path in zip(groups[s], paths):
            node = torn
            for left, right in path + top:
                node = h(left, node, right)
            out.append((doc_id, leaf, sub, root, h(*[x for p in path + top for x in p]), node, node == root))
    return sorted(out, key=str)


def run(spark, rows, tmp_path, name="t"):
    path = f"{tmp_path}/{name}"
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as g", "2 as pos", "3 as node", "4 as item", "5 as leaf", "6 as n") \
        .write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op11_merkle(spark, path).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3, "b": 1, None: 2}, {"a": 700, "b": 82, "é": 81, None: 4, "B": 1, "": 3}])
def test_equals_brute_force(spark, tmp_path, sizes):
    rng = random.Random(7)
    ids = rng.sample(range(10 ** 6), sum(sizes.values()))
    rows = [(ids.pop(), rng.choice(["x\ny", "one line", None, "", "ü\n" * 50]), rng.choice(["en", None]), s, rng.choice([None, 5]))
            for s, k in sizes.items() for _ in range(k)]
    got = run(spark, rows, tmp_path)
    assert got == brute(rows)
    assert any(r[-1] for r in got) or len(rows) < 5


def test_null_and_repeated_ids_many_groups(spark, tmp_path):
    rows = [(None, "a\nb", "en", "s", 3), (None, None, None, "s", None), (4, "p\nq", "en", "s", 1), (4, "p\nq", "en", "s", 1),
            (4, "other", "en", "s", 1)] + [(k, f"t\n{k}", None, f"group{k:04d}", k) for k in range(300)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_table_and_long_text(spark, tmp_path):
    assert run(spark, [], tmp_path) == []
    rows = [(2, "long\n" * 300_000, "en", "s", 1), (1, "", "en", "s", 0)]
    assert run(spark, rows, tmp_path, "u") == brute(rows)


def test_what_a_changed_row_breaks(spark, tmp_path):
    rows = [(k, "two\nlines" if k % 3 else "one line", "en", "s", 1) for k in range(200)]
    for r in run(spark, rows, tmp_path):
        assert r[-1] == (bool(zlib.crc32(str(r[0]).encode()) % 2) or r[0] % 3 == 0)
