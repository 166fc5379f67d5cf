"""The pipeline's stages on a small table with planted cases, and edge cases of each."""

import random

import pytest

import corpus_pipeline as P

WORDS = {lang: [f"{p}{s}{i}" for p in ps for s in ss for i in ("", "x", "q")] for lang, ps, ss in (("en", ["the", "wha", "ing"], ["th", "sh", "ou"]), ("fr", ["que", "eau", "é"], ["tion", "oi", "ç"]))}
BOILER = "all rights reserved by the site owner of this page"


def text(rng, lang, lines=4):
    return "\n".join(" ".join(rng.choices(WORDS[lang], k=rng.randrange(12, 20))) for _ in range(lines))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(6)
    rows = [(i, text(rng, lang), lang, f"src{i % 3}", 0) for i in range(60) for lang in [rng.choice(["en", "fr"])]]
    item = " ".join(rng.choices(WORDS["en"], k=40))
    rows += [(100 + i, rows[0][1], "en", "src0", 0) for i in range(3)]  # exact copies
    near = rows[1][1].split(" ")
    near[5] = "changed"
    rows += [(110, " ".join(near), "en", "src1", 0)]  # a near copy
    rows += [(120, item + "\n" + text(rng, "en", 1), "en", "src1", 0)]  # contaminated
    rows += [(130 + i, text(rng, "en", 2) + f"\n{BOILER}\n" + text(rng, "en", 2), "en", "src2", 0) for i in range(8)]  # a shared line
    rows += [(140, "12345 !!!", "en", "src2", 0), (141, None, None, None, None), (142, "", "en", "src2", 0), (None, text(rng, "fr"), "fr", None, 0)]
    rows += [(150, "long " * 5000 + "the end of it", "en", "src0", 0)]
    return rows, [(1, item), (2, None)]


@pytest.fixture(scope="module")
def folder(spark, planted, tmp_path_factory):
    docs, items = planted
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_on_what_came_before(spark, planted, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id for r in docs.collect()}
    gone = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        now = {r.doc_id for r in docs.collect()}
        assert now <= seen
        gone[name], seen = seen - now, now
    assert gone["language_id"] == {140, 141, 142}
    assert gone["line_dedup"] == set()
    assert gone["near_dedup"] == {100, 101, 102, 110}
    assert gone["decontamination"] == {120}
    rows = {r.doc_id: r for r in docs.collect()}
    assert sum(BOILER in rows[130 + i].text for i in range(8)) == 1 and all(rows[130 + i].n_chars in (0, len(rows[130 + i].text)) for i in range(8))
    name, mix = P.STAGES[-1]
    out = mix(spark, docs, folder).collect()
    assert {r.doc_id for r in out} <= seen and len(out) > 20
    assert sorted((r.doc_id or -1, r.copy) for r in P.run(spark, folder).collect()) == sorted((r.doc_id or -1, r.copy) for r in out)


def test_empty_tables_and_more_columns(spark, planted, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'x' as score", "1 as id", "2 as th", "3 as node")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        some = stage(spark, docs.where("doc_id < 20"), folder)
        assert set(docs.columns) <= set(some.columns)
        assert name == "source_mixing" or some.count() == 20


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "source_mixing"]
