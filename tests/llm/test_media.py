import hashlib
import random
import zlib

import numpy as np
from edges import ALL_IDS, ROWS, edge, empty, ids

from millrace.llm import jpeg, media


def plain_frames(payloads):
    whole = [media.filled(p) for p in payloads]
    return whole, jpeg.encode(np.frombuffer(b"".join(whole), np.uint8).reshape(-1, media.SAMPLES), media.WIDTH, media.HEIGHT)


def test_frames_are_lossless():
    rng = random.Random(1)
    payloads = [b"", b"\xff" * 576, bytes(range(256)) * 9, bytes(rng.randrange(256) for _ in range(4000)), b"\x00\xff" * 600]
    whole, frames = plain_frames(payloads)
    assert b"".join(p.tobytes() for p in jpeg.decode(frames)) == b"".join(whole)


def test_both_decoders_agree():
    whole, frames = plain_frames([bytes(range(200)) * 3])
    one = jpeg.decode_one(frames[0])
    assert one.shape == (192, 192)
    blocks = one.reshape(24, 8, 24, 8)
    assert (blocks.min((1, 3)) == blocks.max((1, 3))).all()
    assert blocks[:, 0, :, 0].tobytes() == whole[0][:576]


def test_frames_with_detail_take_the_general_decoder():
    """A grey 8x8 frame with one AC coefficient, coded by hand: DC 0, then run 0, size 2, value 3 at u=1."""
    q = jpeg._segment(0xDB, bytes([0, *[16] * 64]))
    sof = jpeg._segment(0xC0, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    dht = jpeg._table(0, {0: 1}) + jpeg._table(0x10, {0: 1, 2: 2})
    sos = jpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    data = b"\xff\xd8" + q + sof + dht + sos + bytes([0b0_10_11_0_11]) + b"\x00"[:0] + b"\xff\xd9"
    expected = np.rint(128 + 48 * 0.5 * 8**-0.5 * np.cos((2 * np.arange(8) + 1) * np.pi / 16)).astype(np.uint8)
    assert (jpeg.decode_one(data) == expected).all()
    assert len(jpeg.decode([data])[0]) == 1


def test_files_with_and_without_index():
    _, frames = plain_frames([b"x" * 3000])
    data = media.avi(frames, 192, 192)
    assert media.parse_avi(data) == (40_000, frames)
    assert media.parse_avi(data[: data.rindex(b"idx1")]) == (40_000, frames)


def test_shots_are_cut_where_grey_changes():
    rng = np.random.default_rng(1)
    planes = np.concatenate([rng.integers(20 + 60 * k, 40 + 60 * k, (n, 576)) for k, n in enumerate((30, 5, 20))]).astype(np.uint8)
    assert media.cuts(planes).tolist() == [30, 35]
    assert [(a, b) for a, b, _ in media.shots(planes, 40_000)] == [(0, 1200), (1200, 1400), (1400, 2200)]


def plain_shots(payload):
    """Shots of a payload by plain counting, frame by frame."""
    frames = [payload[i : i + 576] for i in range(0, len(payload), 576)] or [b""]
    share = lambda f: [sum(1 for x in f if x >> 3 == b) / max(len(f), 1) for b in range(32)]
    shares = [share(f) for f in frames]
    changes = [sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 2 if 2 * len(f) >= 576 else 0.0 for a, b, f in zip(shares, shares[1:], frames[1:], strict=False)]
    begins = [0]
    for k in range(1, len(changes)):
        before = changes[max(0, k - 12) : k]
        mean = sum(before) / len(before)
        deviation = max(0.0, sum(x * x for x in before) / len(before) - mean**2) ** 0.5
        if changes[k] > 0.12 and changes[k] > mean + 3 * deviation + 1e-9:
            begins.append(k + 1)
    out = []
    for a, b in zip(begins, [*begins[1:], len(frames)], strict=True):
        own = b"".join(frames[a:b])
        out.append((a * 40, b * 40, sum(own) / len(own) if own else 0.0))
    return out


def test_clips_are_those_of_plain_counting(spark):
    rng = random.Random(4)
    texts = ["", "a" * 575, "a" * 576 * 3 + "zz", "b" * 576 * 4 + "~" * 200]
    for _ in range(12):
        texts.append("".join("".join(rng.choice(letters) for _ in range(rng.randint(300, 9_000))) for letters in rng.choices(["abcdef", "0123456789", "XYZ é", " .,"], k=3)))
    stored = media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3))
    got = {}
    for r in media.clips(stored).collect():
        got.setdefault(r.doc_id, []).append((r.clip, r.start_ms, r.end_ms, r.mean_level))
    features = {r.doc_id: r.feature for r in media.describe(stored).collect()}
    for k, t in enumerate(texts):
        want = plain_shots(t.encode())
        assert [(a, b) for _, a, b, _ in sorted(got[k])] == [(a, b) for a, b, _ in want]
        assert all(abs(x[3] - y[2]) < 1e-3 for x, y in zip(sorted(got[k]), want, strict=True))
        assert f"{len(want)} shots: " in features[k]
    assert max(map(len, got.values())) > 2 and len(got[2]) == len(got[3]) == 1  # what fills up a frame is no shot


def test_edge_rows(spark):
    stored = media.store(edge(spark))
    rows = media.describe(stored).collect()
    assert ids(rows) == ALL_IDS
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in rows:
        raw = texts[r.doc_id].encode()
        whole = media.filled(raw)
        assert len(whole) % 576 == 0 and whole.startswith(raw) and len(whole) > 0
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    by = {r.doc_id: (r.media_sha256, r.feature) for r in rows}
    assert by[1] == by[5] and by[2] == by[3]
    assert media.describe(media.store(empty(spark))).count() == 0
    clips = media.clips(stored).collect()
    assert {r.doc_id for r in clips} == set(texts) and all(r.end_ms > r.start_ms for r in clips)


def test_documents_are_not_cut_at_their_filler(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    frames = {r.doc_id: max(1, -(-len(r.text.encode()) // 576)) for r in docs.collect()}
    last = [r for r in media.clips(media.store(docs)).collect() if r.clip and r.end_ms == frames[r.doc_id] * 40 and r.end_ms - r.start_ms == 40]
    assert len(last) < 0.05 * len(frames)
