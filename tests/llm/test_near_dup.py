import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from assertia.llm import near_dup as N
from assertia.llm.components import components


def shingles(text, k):
    w = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(n_groups, copies, seed):
    rng, rows = random.Random(seed), []
    for g in range(n_groups):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(200)}" for _ in range(rng.randrange(40, 120))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    rng.shuffle(rows)
    rows += [None, "", "   ", "One", "oNe", "two words", "two  WORDS", rows[0], "long " * 3000, "x " * 20000 + "tail"]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)] + [(1, rows[0]), (None, rows[1]), (None, "lonely none")]


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, k):
    rows = corpus(12, 12, k)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as th", "3 as id", "4 as comp")
    got = N.classes(df, shingle=k).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k)


def test_no_side_that_grows_is_broadcast(spark, broadcast_joins):
    rows = corpus(3, 9, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.classes(df, shingle=2).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 2)
    assert N.deduplicate(df, shingle=2).count() > 3
    assert broadcast_joins() == []


def test_block_comparison_finds_what_leaders_miss(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 7)
    rows = corpus(2, 60, 5)
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 2)


def test_texts_that_share_a_footer(spark, monkeypatch):
    """Unrelated texts with one footer of 60 words make one group of buckets, in which few share a bucket: compared bucket by bucket."""
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(8)
    footer = " ".join(f"foot{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(120)) + " " + footer) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + f" and{i}") for i in range(0, 400, 20)]
    seen = []

    def spied(candidates, sets, percent, rest=N._rest):
        seen.append(candidates.groupBy("unit").agg({"node": "count", "minor": "sum"}).collect())
        return rest(candidates, sets, percent)

    monkeypatch.setattr(N, "_rest", spied)
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 2)
    [units] = seen
    assert sum(u["sum(minor)"] * u["count(node)"] for u in units) < 400 * 400 / 8


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall_over_the_test_table(spark):
    """Every pair of texts at 0.8 or more, found by an inverted index in plain Python, is in one component."""
    from assertia.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {i: shingles(t, 2) for i, t in rows}
    holders = defaultdict(list)
    for i, own in sets.items():
        for x in own:
            holders[x].append(i)
    component = {r.doc_id: r.component_id for r in QUERIES["op8_minhash_near_dup"](spark, "/root/testdata/sf0.01").collect()}
    links = found = 0
    for i, own in sets.items():
        for j, n in Counter(j for x in own for j in holders[x] if j < i).items():
            if 100 * n >= 80 * (len(own) + len(sets[j]) - n):
                links += 1
                found += component[i] == component[j]
    assert links > 100 and found >= 0.99 * links


def test_deduplicate(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (2, "A b c d e f g"), (3, None), (3, None), (4, ""), (None, "p q r s t"), (1, "a b c d e f g"), (9, "alone here now then so")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'k' as __k", "2 as `__t`", "3 as `__id`", "4 as `__copies`", "5 as id", "6 as th", "7 as k", "8 as `row`", "9 as copies", "10 as `a.b`")
    out = N.deduplicate(df)
    assert out.columns == df.columns
    assert {tuple(r)[2:] for r in out.collect()} == {(1, "k", 2, 3, 4, 5, 6, 7, 8, 9, 10)}
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "p q r s t"), (1, "a b c d e f g"), (3, ""), (3, ""), (4, ""), (9, "alone here now then so")]
    assert N.deduplicate(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {(r.node, r.comp) for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {(x, root(x)) for x in list(parent)}


def test_components_plan_no_rounds_for_what_a_task_holds(spark, monkeypatch):
    from assertia.llm import components as C

    tables, write = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, label: tables.append(label) or write(df, label))
    names = list(range(300))
    random.Random(5).shuffle(names)
    pairs = [*zip(names, names[1:]), *((1000, 1000 + i) for i in range(1, 90)), (2001, 2000), (2000, 2001)]
    want = {(x, 0) for x in names} | {(1000 + i, 1000) for i in range(90)} | {(2000, 2000), (2001, 2000)}
    edges = spark.createDataFrame(pairs, "u long, v long")
    assert {(r.node, r.comp) for r in components(edges).collect()} == want
    assert len(tables) == 2  # star rounds write one each
    assert components(edges.limit(0)).count() == 0
    parts = components(edges, run=60).collect()  # what several runs leave apart
    assert len(parts) == len(want) and {(r.node, r.comp) for r in parts} == want


def test_sub_keys_follow_similarity():
    m = N.multipliers_of(10, 3)
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**64, 1000, np.uint64))
    other = np.unique(np.r_[base[:889], rng.integers(0, 2**64, 111, np.uint64)])
    assert 4 <= (N.sub_keys(base, m, 3) == N.sub_keys(other, m, 3)).sum() <= 17
