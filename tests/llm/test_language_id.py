import math
import random
from collections import Counter

import numpy as np

from assertia.llm import language_id as L
from assertia.llm.common import bucket_of

WORDS = {"en": "the and that tion ing with shall".split(), "de": "der und dass ung keit nicht schön".split(), "fr": "le et que eau été nous".split(), "es": "el y que ción año señor".split()}


def rows(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randrange(4, 60))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_codewords():
    for n in (2, 3, 4, 6, 7, 30):
        code = L.codewords(n)
        assert set(np.unique(code)) == {-1.0, 1.0}
        distance = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert distance >= (2 ** (n - 2) if n <= L.EXHAUSTIVE else code.shape[1] // 5)
    assert L.codewords(4).shape == (4, 7)


def test_held_out_accuracy_and_edges(spark):
    data = rows(300) + [(1000, None, "en"), (1001, "", "de"), (1002, "123 !!! 456", "fr"), (None, "the and with", None), (5, "der und nicht ung", None), (1003, "the and " * 30000, "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "0 as `__lang_`", "2 as l", "3 as t", "4 as row", "5 as `a.b`")
    found = L.identify(df, bucket_of(df.doc_id, 4) != 2)
    assert found.columns == [*df.columns, "__lang", "__score", "__unsure"]
    out = {(r.doc_id, r.text): r for r in found.collect()}
    assert all((r.score, r["__lang_"], r.l, r.t, r.row, r["a.b"]) == (1, 0, 2, 3, 4, 5) for r in out.values())
    for i in (1000, 1001, 1002):
        got = next(r for k, r in out.items() if k[0] == i)
        assert (got["__lang"], got["__score"], got["__unsure"]) == ("und", 0.0, True)
    good = [r["__lang"] == r.lang for r in out.values() if r.lang and r.doc_id < 300]
    assert len(good) == 300 and np.mean(good) > 0.97
    assert out[5, "der und nicht ung"]["__lang"] == "de" and out[None, "the and with"]["__lang"] == "en"
    assert L.identify(df.limit(0), bucket_of(df.doc_id, 4) != 2).count() == 0


def test_few_languages(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "def", None)], "doc_id long, text string, lang string")
    assert {r["__lang"] for r in L.identify(df, bucket_of(df.doc_id, 4) != 9).collect()} == {"und"}
    one = df.selectExpr("doc_id", "text", "'xx' as lang")
    assert {(r["__lang"], r["__score"]) for r in L.identify(one, bucket_of(df.doc_id, 4) != 9).collect()} == {("xx", 1.0)}


def test_mixed_text_is_ambiguous():
    model = L.fit([(lang, L.sparse(t.encode())) for _, t, lang in rows(200)])
    half = (WORDS["de"] + WORDS["fr"]) * 10
    _, scores, unsure = model.predict([" ".join(half).encode(), " ".join(WORDS["de"] * 10).encode()])
    assert scores[0] < scores[1] and not unsure[1]


def plain_prediction(model, text):
    """Grams counted one by one, every bit's margin and every codeword's loss summed in plain loops."""
    letters = "".join(chr(b) for b in bytes(b + 32 if 65 <= b <= 90 else b for b in text) if 97 <= b <= 122 or b >= 128 or b <= 64 or 91 <= b <= 96)
    words = "".join(c if c.isascii() and c.isalpha() or ord(c) >= 128 else " " for c in letters).split(" ")
    data = [ord(c) for c in " " + " ".join(w for w in words if w) + " "]
    if len(data) < 3:
        counts = Counter()
    else:
        counts = Counter(((a << 8 | b) * 0x9E3779B1 & 0xFFFFFFFF) >> 20 for a, b in zip(data, data[1:]))
        counts += Counter(((a << 16 | b << 8 | c) * 0x85EBCA6B & 0xFFFFFFFF) >> 20 for a, b, c in zip(data, data[1:], data[2:]))
    total = sum(counts.values())
    margins = [float(model.bias[j]) + sum(math.sqrt(n / total) * float(model.weights[k, j]) for k, n in counts.items()) for j in range(model.code.shape[1])]
    losses = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margins, word)) for word in model.code.tolist()]
    best = min(losses)
    return model.languages[losses.index(best)], 1 / sum(math.exp(best - x) for x in losses)


def test_against_plain_decoding():
    data = rows(120, seed=3)
    model = L.fit([(lang, L.sparse(t.encode())) for _, t, lang in data], steps=40)
    tried = [t.encode() for _, t, _ in rows(40, seed=4)] + ["Schön, señor! 12 ÉTÉ".encode(), b"a", b"the  that\tTHAT"]
    names, scores, _ = model.predict(tried)
    for text, name, score in zip(tried, names, scores, strict=True):
        want = plain_prediction(model, text)
        assert name == want[0] and abs(score - want[1]) < 1e-4


def test_the_sample_is_bounded(spark):
    data = spark.createDataFrame(rows(900), "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    sample = L.training_rows(data, F.lit(True), id_col="doc_id", text_col="text", lang_col="lang", rows_per_language=50)
    assert 4 * 30 < sample.count() <= 2 * 50 * 4
    model = L.fitted(sample, 50)
    assert np.mean([n == lang for n, (_, _, lang) in zip(model.predict([t.encode() for _, t, _ in rows(200, 9)])[0], rows(200, 9))]) > 0.95
