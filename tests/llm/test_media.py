import hashlib
import zlib

from pyarrow import fs

from assertia.llm import media as M

ROWS = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 192), (5, "y" * 200_000 + "é"), (1, "héllo"), (None, "z"), (6, "héllo")]


def test_png_round_trip():
    for text in (b"", b"a", bytes(range(256)) * 31, b"q" * 500_001):
        payload = M.pad(text)
        assert len(payload) % 192 == 0 and payload.startswith(text)
        assert M.decode_png(M.encode_png(payload)) == payload


def test_store_and_read_back(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as shard")
    index, folder = M.store(df)
    got = sorted((r.asDict() for r in M.measured_columns(index, folder).collect()), key=str)
    assert len(got) == len(ROWS)
    want = {}
    for i, t in ROWS:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.setdefault(i, (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload) // 192))
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["height"]) == want[r["doc_id"]]
        assert r["payload_sha256"] == r["digest"] and r["media_bytes"] == r["length"]
    heads = {(r.doc_id, r.width, r.height, r.depth, r.colour) for r in M.header_columns(index, folder).collect()}
    assert heads == {(i, 64, x[4], 8, 2) for i, x in want.items()}
    places = M.catalog(index).collect()
    assert len(places) == len({x[2] for x in want.values()})
    files, path = fs.FileSystem.from_uri(folder)
    for p in places:
        with files.open_input_stream(f"{path}/{p.shard}") as f:
            members = M.as_tar(f.read())
        assert hashlib.sha256(M.decode_png(members[f"{p.digest[:2]}/{p.digest}.png"])).hexdigest() == p.digest
        assert hashlib.sha256(M.read_payload(folder, p.shard, p.offset, p.length)).hexdigest() == p.digest


def test_empty(spark):
    index, folder = M.store(spark.createDataFrame([], "doc_id long, text string"))
    assert M.measured_columns(index, folder).count() == 0


def test_measured_columns_take_headers_from_short_reads(spark, monkeypatch):
    index, folder = M.store(spark.createDataFrame(ROWS, "doc_id long, text string"))
    asked, own = [], M.header_columns
    monkeypatch.setattr(M, "header_columns", lambda *a: asked.append(a) or own(*a))
    got = M.measured_columns(index, folder).collect()
    assert len(asked) == 1 and {(r.width, r.depth, r.colour) for r in got} == {(64, 8, 2)}
