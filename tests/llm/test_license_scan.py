import re

from assertia.llm.license_scan import TEMPLATES, THRESHOLD, scan_licenses


def grams(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()


def brute(text):
    text = text or ""
    lines = text.split("\n")
    blocks = [b.split("\n") for b in re.split(r"\n(?:[ \t\r\f\v]*\n)+", re.sub(r"(?m)^[ \t\r\f\v]+$", "", text)) if b.strip()]
    blocks = [[x for x in b if x.strip()] for b in blocks]
    keep = lambda b: "\n".join(x for x in b if not re.match(r"\W*copyright\b", x, re.I))
    spans = [x for x in lines] + [keep(b) for b in blocks if len(b) > 1] + ([keep([x for b in blocks for x in b])] if len(blocks) > 1 else [])
    best = []
    for s in spans:
        a = grams(s)
        scored = [(-2 * len(a & grams(t)) / (len(a) + len(grams(t))), n) for n, t in TEMPLATES if a]
        if scored and -min(scored)[0] >= THRESHOLD:
            best.append(min(scored))
    return (min(best)[1], -min(best)[0], len(best)) if best else (None, 0.0, 0)


APACHE, MIT = next(t for n, t in TEMPLATES if n == "Apache-2.0" and len(t) > 99), next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 99)
WRAPPED = re.sub(r"((?:\S+ ){9})", r"\1\n", MIT)
TEXTS = [
    "Some prose.\nLicensed under CC BY-NC 4.0.\nMore prose.", "Licensed under CC BY 4.0.", "RELEASED  under the mit license", "Copyright 2020 A\n" + WRAPPED + "\n\nother paragraph here",
    "intro\n\n" + APACHE.replace("you may not", "you can not"), None, "", "...", "license", "The licence of the land was under the sea.", "word " * 50_000, "Licensed under the Apache License, Version 2.0.\n" * 3,
    "This work is licensed under the GNU General Public License, version 2.", "a\n \nb\n\nc", "Copyright Released under the MIT License.",
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[1]), (0, TEXTS[0])], "doc_id long, text string").selectExpr("*", "'x' as license", "1 as i")
    got = sorted(((r.doc_id, r.license, round(r.dice, 12), r.n_matches) for r in scan_licenses(df).collect()), key=str)
    want = [(i, *brute(t)) for i, t in enumerate(TEXTS)] + [(None, *brute(TEXTS[1])), (0, *brute(TEXTS[0]))]
    assert got == sorted(((i, a, round(b, 12), c) for i, a, b, c in want), key=str)
    assert {r[1] for r in got} >= {"MIT", "Apache-2.0", "CC-BY-NC-4.0", "CC-BY-4.0", "GPL-2.0", None}
    assert scan_licenses(df.limit(0)).count() == 0


def test_spans_tell_where(spark):
    df = spark.createDataFrame([(1, "x and more words\ny has others too\nReleased under the MIT License.")], "doc_id long, text string")
    assert [tuple(m) for m in scan_licenses(df).first().matches] == [(2, 1, "MIT", 1.0)]
