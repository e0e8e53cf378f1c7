"""Pictures and archives: round trips, damage, both versions."""

import base64
import gzip
import hashlib
import struct
import zlib

import numpy as np
import pytest

from partloom.llm import media, warc


@pytest.mark.parametrize("which", ["odd_docs", "no_docs"])
def test_round_trip(which, request):
    docs = request.getfixturevalue(which)
    got = media.media_features(media.text_pictures(docs)).collect()
    assert len(got) == docs.count()
    texts = {}
    for r in docs.collect():
        raw = (r.text or "").encode()
        padded = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        texts.setdefault(r.doc_id, set()).add((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in texts[r.doc_id]
        assert r.media_error is None and len(r.feature) == 16


def filtered(samples, kinds):
    """Rows filtered by the format's own rules, to be undone."""
    height, width, n = samples.shape
    flat = samples.reshape(height, -1).astype(int)
    out = []
    for y, kind in enumerate(kinds):
        row = []
        for x in range(width * n):
            a = flat[y, x - n] if x >= n else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - n] if y and x >= n else 0
            p = [0, a, b, (a + b) // 2, None][kind]
            if kind == 4:
                e = a + b - c
                p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - c), 2, c))[2]
            row.append((flat[y, x] - p) % 256)
        out.append([kind, *row])
    return np.array(out, np.uint8).tobytes()


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_all_filters(channels):
    rng = np.random.default_rng(channels)
    samples = rng.integers(0, 256, (9, 7, channels)).astype(np.uint8)
    raw = filtered(samples, [4, 3, 2, 1, 0, 2, 2, 4, 1])
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    data = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 9, 8, colour, 0, 0, 0))
    packed = zlib.compress(raw)
    data += media._chunk(b"tEXt", b"note") + media._chunk(b"IDAT", packed[:20]) + media._chunk(b"IDAT", packed[20:]) + media._chunk(b"IEND", b"")
    assert (media.decode_png(data) == samples).all()
    assert (media.decode_png(media.encode_png(samples)) == samples).all()


def test_damage_is_told(spark):
    good = media.encode_png(np.zeros((2, 64, 3), np.uint8))
    flipped = good[:45] + bytes([good[45] ^ 1]) + good[46:]
    df = spark.createDataFrame([(1, good, "keep"), (2, flipped, "a"), (3, good[:-20], "b"), (4, None, "c"), (5, b"GIF", "d")], "doc_id long, media binary, feature string")
    got = {r.doc_id: r for r in media.media_features(df).collect()}
    assert got[1].media_error is None and got[1].payload_bytes == 384
    assert "checksum" in got[2].media_error and "cut off" in got[3].media_error and got[4].media_error == "null" and "signature" in got[5].media_error


def test_palettes_are_refused(spark):
    data = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 3, 0, 0, 0)) + media._chunk(b"PLTE", bytes([255, 0, 0, 0, 255, 0]))
    data += media._chunk(b"IDAT", zlib.compress(b"\0\0\1")) + media._chunk(b"IEND", b"")
    got = media.media_features(spark.createDataFrame([(1, data)], "doc_id long, media binary")).first()
    assert got.feature is None and "palette" in got.media_error


@pytest.mark.parametrize("shape", [(64, 64, 3), (3, 64, 3), (40, 33, 1), (1, 64, 3)])
def test_hash_against_plain_transform(shape):
    """The sum that defines each coefficient, over the mean of each of 32 x 32 parts."""
    samples = np.random.default_rng(sum(shape)).integers(0, 256, shape).astype(np.uint8)
    height, width, n = shape
    small = [[0.0] * 32 for _ in range(32)]
    for i in range(32):
        rows = range(i * height // 32, max(i * height // 32 + 1, (i + 1) * height // 32))
        for j in range(32):
            cols = range(j * width // 32, max(j * width // 32 + 1, (j + 1) * width // 32))
            values = [int(samples[y, x, 0]) if n < 3 else int(299 * int(samples[y, x, 0]) + 587 * int(samples[y, x, 1]) + 114 * int(samples[y, x, 2])) // 1000 for y in rows for x in cols]
            small[i][j] = sum(values) / len(values)
    cos = [[np.cos(np.pi * k * (2 * x + 1) / 64) for x in range(32)] for k in range(8)]
    low = [round(sum(small[y][x] * cos[u][y] * cos[v][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    assert media.cosine_hash(samples) == f"{int(''.join('1' if x > middle else '0' for x in low), 2):016x}"


def test_hash_is_steady():
    rng = np.random.default_rng(2)
    picture = np.kron(rng.integers(0, 256, (8, 8)), np.ones((16, 8))).astype(np.uint8)[..., None].repeat(3, axis=2)
    noisy = (picture.astype(int) + rng.integers(-3, 4, picture.shape)).clip(0, 255).astype(np.uint8)
    bits = lambda h: bin(int(h, 16)).count("1")
    a, b = media.cosine_hash(picture), media.cosine_hash(noisy)
    assert bits(f"{int(a, 16) ^ int(b, 16):x}") <= 4
    other = media.cosine_hash(rng.integers(0, 256, picture.shape).astype(np.uint8))
    assert bits(f"{int(a, 16) ^ int(other, 16):x}") > 10


@pytest.mark.parametrize("version", [b"1", b"2"])
def test_arc_and_warc_records(version):
    records = [("http://a/x y", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nmore"), ("dns:a", "-", "20010203", "text/dns", b"no head"), ("http://b", "-", "1", "text/html", b"")]
    data = warc.write_arc("name", version, records)
    back = list(warc.read_arc(data))
    assert [(r.ip, r.date, r.content_type, r.block) for r in back] == [r[1:] for r in records]
    assert back[0].url == "http://a/x%20y"
    made = b"".join(warc.to_warc("name", r) for r in back) + warc.to_warc("name", back[0], warc.Original("<urn:uuid:x>", 7, "http://o", "20010203"))
    read = list(warc.read_warc(made))
    assert [f["warc-type"] for f, _ in read] == ["response", "resource", "resource", "revisit"]
    assert [f["warc-date"] for f, _ in read[:3]] == ["2001-02-03T04:05:06Z", "2001-02-03T00:00:00Z", "1970-01-01T00:00:00Z"]
    assert [b for _, b in read[:3]] == [r.block for r in back]
    assert read[3][1] == b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n" and read[3][0]["warc-refers-to-page"] == "7"
    assert read[0][0]["warc-payload-digest"] == read[3][0]["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"body\nmore").digest()).decode()


def test_broken_archives():
    good = warc.write_arc("n", b"1", [("u", "i", "20010203", "t", b"block")])
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_arc(good[:-3]))
    with pytest.raises(ValueError, match="version"):
        list(warc.read_arc(gzip.compress(b"filedesc://x 0 0 t 5\n9 0 x\n")))
    with pytest.raises(ValueError, match="shorter"):
        list(warc.read_arc(good + gzip.compress(b"u i 20010203 t 99\nshort\n")))
    record = warc.to_warc("n", next(iter(warc.read_arc(good))))
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_warc(gzip.compress(gzip.decompress(record).replace(b"block", b"blick"))))


def test_broken_archives_stop_no_others(spark):
    good = warc.write_arc("good", b"1", [("u", "i", "20010203", "t", b"HTTP/1.0 200 OK\r\nX-Page: 4\r\nContent-Length: 5\r\n\r\nblock"), ("r", "i", "20010203", "text/dns", b"ten bytes!"), ("s", "i", "20010204", "text/dns", b"ten bytes!")])
    lost = warc.write_arc("lost", b"2", [("u", "i", "20010203", "t", b"HTTP/1.0 200 OK\r\n\r\nblock")])
    rows = [("good", good), ("cut", lost[:-4]), ("noise", b"noise"), ("none", b""), ("odd", good + gzip.compress(b"u i 20010203 t x\nshort\n"))]
    df = spark.createDataFrame(rows, "archive string, data binary").repartition(2)
    made = warc.convert(df)
    errors = {r.archive: r.error for r in made.collect()}
    assert errors["good"] is None and errors["none"] is None and all(errors[x] for x in ("cut", "noise", "odd"))
    got = warc.warc_pages(made).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.record_type)) for r in got if not r.error) == sorted(map(str, [(4, 5, "response"), (None, 10, "resource"), (None, 10, "revisit")]))
    assert len([r for r in got if r.error]) == 3
    data = next(r.data for r in made.collect() if r.archive == "good")
    fields = [f for f, _ in warc.read_warc(bytes(data))]
    assert [f["warc-type"] for f in fields] == ["warcinfo", "response", "revisit", "resource"]
    assert fields[2]["warc-refers-to-target-uri"] == "s" and fields[2]["warc-refers-to-date"] == "2001-02-04T00:00:00Z" and fields[2]["warc-refers-to"] == fields[3]["warc-record-id"]
    broken = spark.createDataFrame([("x", bytes(data)[:-9], None)], "archive string, data binary, error string")
    assert [bool(r.error) for r in warc.warc_pages(broken).collect()] == [True]


def test_reruns_agree(spark):
    df = spark.createDataFrame([(i % 3, f"http://{i}", "same" * (i % 4)) for i in range(50)], "page_id long, url string, html string").repartition(3)
    one, two = warc.convert(warc.arc_archives(df)), warc.convert(warc.arc_archives(df))
    assert sorted((r.archive, bytes(r.data)) for r in one.collect()) == sorted((r.archive, bytes(r.data)) for r in two.collect())


def test_pages(spark):
    big = "x" * 200_000
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://b c", big), (4, "u", None), (5, "u", ""), (None, "u", "same"), (7, "u", "é"), (8, "u", big), (8, "u", big)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, archive string").repartition(3)
    got = warc.pages_through_warc(df).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    top = {"same": 2, big: 8, "": 5, "é": 7}
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest)) for r in got) == sorted(str((p, len((t or "").encode()), digest(t))) for p, _, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.payload_digest, []).append(r)
    for t, page in top.items():
        kinds = [(r.record_type, r.page_id, r.refers_to) for r in by[digest(t)]]
        assert [k for k in kinds if k[0] == "response"] == [("response", page, None)]
        assert all(k[2] == page for k in kinds if k[0] == "revisit")
    assert warc.pages_through_warc(df.where("false")).collect() == []
