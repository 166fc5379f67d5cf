import hashlib
import re

from assertia.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, names = split(text), set(), set()
        for name, t in items:
            b = split(t)
            for k in range(max(1, len(b) - 12) if b else 0):
                win = b[k : k + 13]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit |= set(range(at, at + len(win)))
                        names.add(str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


ITEM = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, ITEM), (2, "Short Ümlaut item"), (3, None), (4, "..."), (10, ITEM.replace("w19", "zz")), (11, "a a a a a a a a a a a a a a")]
DOCS = [
    (1, "x " * 30 + ITEM + " y" * 300), (2, ITEM.upper().replace(" ", ",\n")), (3, " ".join(ITEM.split()[:12])), (4, None), (5, ""), (6, "short ümlaut ITEM " * 3 + "short Ümlaut"),
    (7, "a " * 40), (8, "w0 " + ITEM + " " + ITEM), (1, "x"), (None, ITEM), (9, "q " * 5000 + ITEM), (12, " ".join(ITEM.split()[7:])), (13, " ".join(ITEM.split()[:7])),
]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'e' as items", "0 as row"), spark.createDataFrame(ITEMS, "item_id long, text string")


def rows(df):
    return sorted((tuple(r)[:6] for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_against_brute_force(spark):
    docs, items = frames(spark)
    assert rows(D.contamination(docs, items)) == brute(DOCS, ITEMS)


def test_many_chunks_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_WINDOWS", 3)
    monkeypatch.setattr(D, "BLOCK_WORDS", 50)
    docs, items = frames(spark)
    assert rows(D.contamination(docs.coalesce(1), items)) == brute(DOCS, ITEMS)


def test_empty(spark):
    docs, items = frames(spark)
    assert D.contamination(docs.limit(0), items).count() == 0
    assert all(r[2] == 0 for r in rows(D.contamination(docs, items.limit(0))))


def near(docs, items, slack=2):
    """Items of which some window has every word within ``slack`` of its place, by trying every start."""
    out = []
    for i, text in docs:
        w, names = split(text), set()
        for name, t in items:
            b = split(t)
            for k in range(max(1, len(b) - 12) if b else 0):
                win = b[k : k + 13]
                if any(all(x in w[max(0, s + o - slack) : max(0, s + o + slack + 1)] for o, x in enumerate(win)) for s in range(-slack, len(w) + slack)):
                    names.add(str(name))
        out.append((i, len(names)))
    return sorted(out, key=str)


def test_proximity_against_brute_force(spark):
    words = ITEM.split()
    swapped = words[:3] + [words[4], words[3]] + words[5:]
    added = words[:6] + ["new"] + words[6:]
    docs = [*DOCS, (20, " ".join(swapped)), (21, " ".join(added)), (22, " ".join(words[::-1])), (23, " ".join(words[:5] + ["a", "b", "c", "d"] + words[5:])), (24, "item short Ümlaut"), (25, "short of Ümlaut"), (26, "Ümlaut item x short")]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), frames(spark)[1]
    got = sorted(((r.doc_id, r.n_near) for r in D.contamination(df.coalesce(1), items).collect()), key=str)
    assert got == near(docs, ITEMS)
    assert dict(got)[20] and dict(got)[21] and dict(got)[24] and not dict(got)[22] and not dict(got)[25]


def test_an_index_serves_any_phrases(spark):
    docs = spark.createDataFrame([(1, "the quick very brown fox"), (2, "brown the quick"), (3, "fox")], "doc_id long, text string")
    index = D.build_index(docs)
    assert {t for r in index.collect() for t in map(bytes, r.terms)} == {b"the", b"quick", b"very", b"brown", b"fox"}
    assert {(r.id, r.n_words) for r in D.indexed_rows(index).collect()} == {(1, 5), (2, 3), (3, 1)}
    found = {r.id: (r.items, r.near) for r in D.search(index, {(b"the", b"quick", b"brown"): ["p"]}, slack=1).collect()}
    assert found == {1: ([], ["p"])}
    exact = {r.id: [tuple(s) for s in r.spans] for r in D.search(index, {(b"quick", b"very"): ["p"], (b"very", b"brown"): ["q"]}).collect()}
    assert exact == {1: [(1, 4)]}
