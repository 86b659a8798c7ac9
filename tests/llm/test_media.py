import hashlib
import io
import zlib

import numpy as np

from ripplegraph.llm import media


def test_formats_round_trip():
    r = np.random.default_rng(1)
    for shape in ((1, 64), (7, 64), (5, 3), (1, 1)):
        x = r.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_pgm(x)) == x).all() and (media.decode(media.encode_bmp(x)) == x).all()
    assert media.decode(b"P2 # note\n2 1 255\n7 9").tolist() == [[7, 9]]
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]


def test_area_means_equal_brute_force(monkeypatch):
    r = np.random.default_rng(2)
    monkeypatch.setattr(media, "BAND", 100)
    for h, w, rows, columns in ((12, 12, 3, 4), (7, 64, 8, 9), (1, 64, 8, 9), (301, 64, 32, 32)):
        x = r.integers(0, 256, (h, w)).astype(float)
        fine = np.repeat(np.repeat(x, rows, axis=0), columns, axis=1)
        want = fine.reshape(rows, h, columns, w).mean(axis=(1, 3))
        assert np.allclose(media.area_resized(x, rows, columns), want)


def test_texts(spark, odd):
    got = media.text_image_features(odd).collect()
    texts = {(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()}
    assert len(got) == odd.count()
    for i, t in texts:
        plain = (t or "").encode()
        payload = plain + bytes(-len(plain) % 64 or (0 if plain else 64))
        assert any(r["doc_id"] == i and r["n_bytes"] == len(plain) and r["payload_bytes"] == len(payload) and r["samples_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:]) and media.decode(r["media"]).tobytes() == payload for r in got)
    assert all(np.load(io.BytesIO(r["tile"])).shape == (media.TILE, media.TILE) for r in got)


def test_other_bytes_have_no_features(spark, none):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"GIF89a")), (4, bytearray(b"P5\n9 9\n255\nxx")), (5, bytearray(b"BM"))], "id bigint, media binary")
    assert all(r["feature"] is None for r in media.media_features(df).collect())
    assert media.text_image_features(none).collect() == []


def test_hostile_media_decode_to_nothing():
    huge = b"9" * 30
    for bad in (b"P5 " + huge + b" " + huge + b" 255\n", b"P4 " + huge + b" 2\n", b"P5 " + b"9" * 5000 + b" 1 255\n", b"P2 2 1 255\n1 300", b"P2 2 1 255\n-3 1", b"P2 1 1 65535\n65536", b"P2 1 1 255\nx", b"P5 1 1 0\n\0", b"P5 1 1 70000\n\0\0", b"P6 0 0 255\n", b"P5", b"BM", b"BM" + b"\xff" * 60, b"P5 #", None, b""):
        assert media.features(bad)["feature"] is None, bad
    assert media.features(b"P2 2 1 255\n255 0")["rows"] == 1
