import base64
import os
import zlib
from pathlib import Path

import numpy as np
import pytest
import webp_slow as S
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grainsift.llm import webp as W


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 25), st.integers(1, 25), st.permutations([0, 1, 2]), st.integers(0, 3), st.sampled_from(["", "first", "last"]), st.integers(0, 7), st.sampled_from([0, 2, 3]), st.sampled_from(["noise", "few", "ramp", "runs"]))
def test_round_trip(seed, width, height, order, n, palette, cache, step, kind):
    rng = np.random.default_rng(seed)
    size = width * height
    noise = rng.integers(0, 1 << 32, size)
    pixels = {"noise": noise, "few": rng.choice(noise[: int(rng.integers(1, 40))], size), "ramp": np.arange(size) * 0x010203 | 0xFF000000, "runs": np.repeat(noise, 3)[:size]}[kind].astype(np.uint32)
    transforms = ([W.PALETTE] if palette == "first" else []) + list(order[:n]) + ([W.PALETTE] if palette == "last" else [])
    data = W.encode(pixels, width, transforms, cache, step, tuple(range(14)), int(rng.integers(0, 1 << 24)))
    got = W.decode(data)
    assert got[:2] == (width, height)
    assert (got[2] == pixels).all()
    assert S.decode(data) == (width, height, pixels.tolist())


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(60, 130), st.integers(1, 70), st.sampled_from([(0,), (2, 0), (1, 2), (0, 3), (2, 0, 1), (3,)]), st.sampled_from([tuple(range(14)), (11, 12), (13,), (5, 1)]))
def test_larger_images_against_brute_force(seed, width, height, transforms, modes):
    """So large that predictions are undone by waves, some in several bands."""
    rng = np.random.default_rng(seed)
    smooth = np.cumsum(rng.integers(-3, 4, (width * height, 4)), axis=0).astype(np.uint8)
    pixels = (smooth if transforms[-1] != 3 else smooth // 64).astype(np.uint8).view(np.uint32).ravel()
    data = W.encode(pixels, width, transforms, 2, 0, modes)
    old = W.WAVE_PIXELS, W.PART
    try:
        W.WAVE_PIXELS, W.PART = 0, int(rng.integers(64, 8000))
        got = W.decode(data)
    finally:
        W.WAVE_PIXELS, W.PART = old
    assert (got[2] == pixels).all()
    assert W.decode(data)[2].tolist() == S.decode(data)[2] == pixels.tolist()


def test_short_distances():
    """The table of near pixels by its rule: by distance, and of equals those with more
    rows above first, right before left. It is fixed by the format."""
    assert len(W.NEAR) == len(set(W.NEAR)) == 120
    assert {(x, y) for x, y in W.NEAR} == {(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0}
    assert W.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    size = [x * x + y * y for x, y in W.NEAR]
    assert size == sorted(size)
    for (x, y), (u, v) in zip(W.NEAR[:-1], W.NEAR[1:], strict=True):
        assert x * x + y * y < u * u + v * v or (-x, y) == (u, v) and x > 0 or y > v or abs(x) != abs(u)


def test_a_public_image_of_another_encoder():
    """The alpha plane of a 16 x 16 file in CPython's tests is a lossless stream
    without its header; the same picture there as PNG has the right values."""
    folder = Path(os.__file__).parent / "test"
    found = [p for p in (folder / "imghdrdata", folder / "test_email" / "data") if (p / "python.webp").exists()]
    if not found:
        pytest.skip("this Python has no test data")
    data = (found[0] / "python.webp").read_bytes()
    at = data.index(b"ALPH")
    size = int.from_bytes(data[at + 4 : at + 8], "little")
    assert data[at + 8] & 3 == 1 and data[at + 8] >> 2 & 3 == 0  # lossless, unfiltered
    stream = data[at + 9 : at + 8 + size]
    # given the header that such a stream lacks
    head = 0x2F | 15 << 8 | 15 << 22 | 1 << 36
    body = head.to_bytes(5, "little") + stream
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    width, height, pixels = W.decode(b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk)
    assert (width, height) == (16, 16)
    assert (pixels.tolist()) == S.decode(chunk)[2]
    png = (found[0] / "python.png").read_bytes()
    assert (pixels >> 8 & 255).tolist() == alpha_of(png)


def alpha_of(png):
    """The alpha values of a PNG of eight bits, with a palette or with four channels."""
    at, data, clear = 8, b"", b""
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        kind, part = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour = *[int.from_bytes(part[i : i + 4], "big") for i in (0, 4)], part[8], part[9]
            assert depth == 8 and colour in (3, 6)
        clear += part if kind == b"tRNS" else b""
        data += part if kind == b"IDAT" else b""
        at += 12 + n
    n = 4 if colour == 6 else 1
    raw, out, above = zlib.decompress(data), [], [0] * (n * width)
    for y in range(height):
        line = list(raw[y * (n * width + 1) : (y + 1) * (n * width + 1)])
        how, row = line[0], line[1:]
        for i in range(len(row)):
            a, b, c = (row[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row[i] = (row[i] + [0, a, b, (a + b) // 2, near][how]) % 256
        out += row[3::4] if colour == 6 else [clear[i] if i < len(clear) else 255 for i in row]
        above = row
    return out


def test_many_large_images_in_bounded_batches(spark):
    big = W.encode((np.arange(300 * 300, dtype=np.uint32) // 900) | np.uint32(0xFF000000), 300)
    images = spark.createDataFrame([(i, big if i % 2 else None) for i in range(9)], "image_id long, webp binary").coalesce(1)
    old, W.BATCH_PIXELS = W.BATCH_PIXELS, 100_000
    try:
        got = W.decode_images(images).select("image_id", "width", "error", F.size("pixels").alias("n")).collect()
    finally:
        W.BATCH_PIXELS = old
    assert sorted((r["image_id"], r["width"], r["n"]) for r in got) == [(i, 300 if i % 2 else None, 90_000 if i % 2 else None) for i in range(9)] or {r["n"] for r in got if not r["width"]} == {-1}


def test_the_largest_width():
    pixels = np.full(16_384 * 2, 0xFF010203, np.uint32)
    width, height, got = W.decode(W.encode(pixels, 16_384, (W.GREEN,)))
    assert (width, height) == (16_384, 2) and (got == pixels).all()


def test_a_public_file():
    # a lossless image of one transparent pixel, as used to test for support
    width, height, pixels = W.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert (width, height, pixels.tolist()) == (1, 1, [0])


def test_predictors():
    left, top, corner, right = 0x10203040, 0x50607080, 0x0A141E28, 0xFFFFFFFF
    assert W.predict(0, left, top, corner, right) == 0xFF000000
    assert [W.predict(m, left, top, corner, right) for m in (1, 2, 3, 4)] == [left, top, right, corner]
    assert W.predict(7, 0x01000000, 0x02000000, 0, 0) == 0x01000000
    assert W.predict(12, 0xF0F00000, 0x20200000, 0x00000000, 0) == 0xFFFF0000
    assert W.predict(13, 0x04000000, 0x04000000, 0x07000000, 0) == 0x03000000  # halves are cut towards zero
    assert W.predict(11, 0x64000000, 0x00000000, 0x00000000, 0) == 0x64000000
    assert len(set(W.NEAR)) == 120


def test_long_runs_and_large_images():
    pixels = np.zeros(300 * 200, np.uint32) | np.uint32(0xFF102030)
    pixels[7777] = 5
    data = W.encode(pixels, 300, (W.GREEN,), 0)
    assert len(data) < 400
    assert (W.decode(data)[2] == pixels).all()


def test_damage_is_told(spark):
    good = W.encode(np.arange(64, dtype=np.uint32) | np.uint32(0xFF000000), 8)
    rows = [(1, good), (2, None), (3, b""), (4, good[:30]), (5, b"RIFF\x00\x00\x00\x00WEBPVP8 \x00\x00\x00\x00"), (None, good), (1, good), (6, good[:20] + bytes([good[20] ^ 1]) + good[21:])]
    images = spark.createDataFrame([(*r, "e") for r in rows], "image_id long, webp binary, error string")
    got = W.decode_images(images).collect()
    assert len(got) == len(rows)
    by = {r["image_id"]: r for r in got}
    assert by[1]["width"] == 8 and by[1]["pixels"][1] == np.uint32(0xFF000001).view(np.int32) and by[1]["error"] is None
    assert by[2]["pixels"] is None and by[2]["error"] is None
    assert all(by[i]["pixels"] is None and by[i]["error"] for i in (3, 4, 5, 6))
    assert by[None]["width"] == 8
    assert W.decode_images(images.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_noise_never_crashes(seed):
    rng = np.random.default_rng(seed)
    good = bytearray(W.encode(rng.integers(0, 1 << 32, 400).astype(np.uint32), 20, (0, 1, 2), 3, 2))
    for _ in range(150):
        bad = bytearray(good)
        for k in rng.integers(21, len(bad), 3):
            bad[k] = int(rng.integers(0, 256))
        try:
            W.decode(bytes(bad))
        except (W.WebPError, IndexError):
            pass


def test_query_decodes_every_embedding(spark, sf_dir):
    got = W.op6_webp_pixels(spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    assert len(got) == len(rows)
    want = {r["vec_id"]: W.pixels_of(np.array(r["embedding"], np.float64)).view(np.int32).tolist() for r in rows}
    assert all(r["pixels"] == want[r["image_id"]] and r["error"] is None for r in got)
