import random
import re
from collections import defaultdict

import pytest

from assertia.llm.line_dedup import FIXED, LEAD, LONG, LONG_DOCS, MIN_DOCS, MIN_TOKENS, OPEN, dedup_lines


def brute(rows):
    """Rows of distinct ids, by the definition: every place and level counted in plain loops."""
    lines, same = {}, {}
    for doc, text in rows:
        if text is None:
            continue
        same[doc] = tuple(x for line in text.split("\n") if (x := re.sub(r"[ \t\r\f\v]+", " ", line).strip(" ")))
        for pos, line in enumerate(re.sub(r"[ \t\r\f\v]+", " ", text).split("\n")):
            w = tuple("*" if re.search("[0-9]", x) else x for x in line.strip(" ").split(" "))
            if len(w) >= MIN_TOKENS or (any(c.isalpha() for c in line) and "*" not in w):
                lines[doc, pos] = w
    texts = defaultdict(set)
    for (doc, _), w in lines.items():
        texts[w].add(same[doc])
    support, leaf_texts = defaultdict(int), defaultdict(set)
    for w, held in texts.items():
        leaf_texts[len(w), w[:LEAD]] |= held
        for i, x in enumerate(w):
            support[len(w), w[:LEAD], i, x] += len(held)
    templates = defaultdict(dict)
    for w in texts:
        n = len(w)
        templates[w]["whole", w] = min(LONG_DOCS, MIN_DOCS) if n > LONG else MIN_DOCS
        if n < MIN_TOKENS or len(leaf_texts[n, w[:LEAD]]) < MIN_DOCS:
            continue
        c = [support[n, w[:LEAD], i, x] for i, x in enumerate(w)]
        c = [x if x >= MIN_DOCS else 0 for x in c]
        for v in set(c):
            t = tuple(None if x <= v else word for x, word in zip(c, w, strict=True))
            if t.count(None) * OPEN <= n and sum(x not in (None, "*") for x in t) * FIXED >= n:
                templates[w]["level", w[:LEAD], t] = MIN_DOCS
    held = defaultdict(set)
    need = {}
    for (doc, _), w in lines.items():
        for t, least in templates[w].items():
            held[t].add(doc)
            need[t] = least
    keeper = {t: min(ds) for t, ds in held.items() if len({same[d] for d in ds}) >= need[t]}
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        split = text.split("\n")
        gone = {i for i in range(len(split)) if any(t in keeper and keeper[t] != doc and same[keeper[t]] != same[doc] for t in templates.get(lines.get((doc, i)), ()))}
        out.append((doc, "\n".join(x for i, x in enumerate(split) if i not in gone), len(split), len(gone)))
    return sorted(out, key=str)


BOILER = "Released under the MIT License."
FOOTER = "follow the project on our page\nwritten by volunteers of the club\n\nAll rights reserved.\nsend letters to the same address as ever"
LOG = "the user {} came in from {} at 12:0{} and stayed until late in the evening"
NAMES, PLACES = ["alice", "bob", "carol", "dan", "erin", "frank", "grace"], ["Rome", "Oslo", "Lima", "Cairo", "Quito", "Paris"]
PASSAGE = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
OWN = ["q" + chr(97 + i) for i in range(20)]
ROWS = [(i, f"own {i} words a{i} b c\n{BOILER}\nother line q{chr(97 + i)} z x v") for i in range(7)]
ROWS += [(100 + i, f"lead {chr(97 + i)}{chr(98 + i % 3)}\n" + LOG.format(NAMES[i % 7], PLACES[i // 7 % 6], i % 10)) for i in range(42)]  # each value often, each pair once
ROWS += [(20 + i, "a whole copied text of words\nwith a second line of words\nand a third one to end") for i in range(9)]
ROWS += [(200 + i, f"{OWN[i]} begins\nso it {OWN[i]} goes {OWN[i]}\n{FOOTER}") for i in range(20)]
ROWS += [(300, f"first of two\n{PASSAGE}\nends"), (301, f"another text\n{PASSAGE}\nwith another end"), (302, f"another  text\n{PASSAGE}  \n\nwith another end\n")]
ROWS += [(40, None), (41, ""), (42, "\n\n"), (43, f"{BOILER}\n" * 50), (44, "w" * 200_000 + "\n" + BOILER), (45, "short one\t\tx"), (46, "7 " * 30)]


def table(spark, rows):
    """With columns named like those that the operator works with."""
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'p' as pos", "1 as t", "map('a', 1) as first", "2 as `__t`", "3 as `row`", "4 as k", "5 as th", "6 as `a.b`", "7 as gone")


def outcome(df):
    return sorted(((r.doc_id, r.text, r["__lines"], r["__dropped"]) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    df = table(spark, ROWS)
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "__lines", "__dropped"]
    assert all((r.pos, r.t, r.first, r["__t"], r.row, r.k, r.th, r["a.b"], r.gone) == ("p", 1, {"a": 1}, 2, 3, 4, 5, 6, 7) for r in out.collect())
    got = outcome(out)
    assert got == brute(ROWS)
    by = {r[0]: r for r in got}
    assert BOILER in by[0][1] and BOILER not in by[1][1]  # the least id keeps the line
    assert sum(by[100 + i][3] for i in range(42)) == 41  # two fields without digits vary
    assert all(by[20 + i][3] == 0 for i in range(9))  # copies of whole texts are left
    assert [by[200 + i][3] for i in range(20)] == [0] + [4] * 19 and "\n\n" not in by[201][1]  # every line of a footer goes
    assert by[300][3] == 0 and by[301][3] == by[302][3] == 1  # a long passage recurs from two texts on; copies lose it alike


@pytest.mark.parametrize("seed", range(3))
def test_random_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = "the of log user host a b c d e f 7 8".split()
    base = [rng.choices(words, k=rng.randrange(1, 12)) for _ in range(12)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2))):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 6)))) for i in range(150)]
    rows += [(500 + i, rows[i][1]) for i in range(20)]
    assert outcome(dedup_lines(table(spark, rows))) == brute(rows)


def test_repeats_and_nulls(spark):
    rows = [(1, f"x\n{BOILER}\ny")] * 6 + [(None, f"n{i}\n{BOILER}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["__dropped"] == 0 for r in dedup_lines(df).collect())
    assert dedup_lines(df.limit(0)).count() == 0
    more = spark.createDataFrame(rows + [(10 + i, f"m{i}x\n{BOILER}") for i in range(4)], "doc_id long, text string")
    assert all(r["__dropped"] == (r.doc_id != 1) for r in dedup_lines(more, names=("__lines", "__dropped")).collect())
