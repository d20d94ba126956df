"""op4: exact round trips, and the platform's own codec as a second opinion on any progressive file."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearwin.llm import jpeg, media
from tests.llm import nasty


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 255), st.integers(0, 255), st.integers(0, 2**32)), min_size=1, max_size=5))
def test_round_trip(shapes):
    payloads = [np.random.default_rng(seed).integers(min(a, b), max(a, b) + 1, 64 * n, dtype=np.uint8).tobytes() for n, a, b, seed in shapes]
    batch = jpeg.Batch(jpeg.encode(payloads))
    assert [jpeg.payload(batch, i) for i in range(len(payloads))] == payloads


def test_new_coefficients_and_zero_runs():
    rng = np.random.default_rng(1)
    for p in ([0.97, 0.01, 0.01, 0.01], [0.5, 0.2, 0.2, 0.1], [0.999, 0.001, 0, 0]):
        payloads = [rng.choice(np.array([0, 255, 254, 140], np.uint8), 64 * n, p=p).tobytes() for n in (1, 7, 50, 333)]
        batch = jpeg.Batch(jpeg.encode(payloads))
        assert [jpeg.payload(batch, i) for i in range(4)] == payloads


def java_image(spark, data):
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    w, h = image.getWidth(), image.getHeight()
    rgb = np.array([[image.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])
    return np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], axis=2)


def java_progressive(spark, rgb, quality):
    jvm = spark._jvm
    h, w = rgb.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            image.setRGB(x, y, int(rgb[y, x, 0]) << 16 | int(rgb[y, x, 1]) << 8 | int(rgb[y, x, 2]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()  # modes: 1 the default, 2 explicit
    how.setProgressiveMode(1)
    how.setCompressionMode(2)
    how.setCompressionQuality(float(quality))
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.close()
    return bytes(out.toByteArray())


def test_our_files_are_jpeg(spark):
    some = np.random.default_rng(2).choice(np.frombuffer(jpeg.FREQUENT[:20], np.uint8), (54, 64))
    data = jpeg.encode([some.tobytes()])[0]
    ours = jpeg.Batch([data]).tensor(0).astype(int)
    theirs = java_image(spark, data)
    assert ours.shape == theirs.shape and np.abs(ours - theirs).max() <= 3


@pytest.mark.parametrize("quality", [0.3, 0.75, 1.0])
def test_their_files_are_decoded(spark, quality):
    """Sizes that are no multiple of a block, no restart markers, end-of-band runs and several scans of each bit."""
    y, x = np.mgrid[0:37, 0:53]
    rgb = np.stack([x * 4, y * 6, 255 - x * 2 - y], axis=2).clip(0, 255).astype(np.uint8)
    rgb[10:20, 10:30] = (200, 30, 60)
    data = java_progressive(spark, rgb, quality)
    assert b"\xff\xc2" in data
    ours, theirs = jpeg.Batch([data]).tensor(0).astype(int), java_image(spark, data)
    assert ours.shape == theirs.shape == (37, 53, 3)
    assert np.abs(ours - theirs).max() <= 4


def samples_by_rule(data):
    """RGB samples of a 4:2:0 file from its coefficients, sample by sample: plain cosine sums, chroma by thirds and quarters."""
    batch = jpeg.Batch([data])
    pic, planes = batch.pictures[0], []
    u = np.arange(8)
    c = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    for part in pic.parts:
        plane = np.zeros((part.high * 8, part.wide * 8), int)
        for i in range(part.wide * part.high):
            square = np.zeros(64)
            square[jpeg.ZIGZAG] = batch.blocks[part.base + i]
            y, x = divmod(i, part.wide)
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.clip(np.floor(c.T @ square.reshape(8, 8) @ c + 128.5), 0, 255)
        planes.append(plane)
    full = [planes[0]]
    for plane in planes[1:]:
        h, w = plane.shape
        big = np.zeros((2 * h, 2 * w), int)
        for y in range(2 * h):
            for x in range(2 * w):
                y2, x2 = min(max(y // 2 + (1 if y % 2 else -1), 0), h - 1), min(max(x // 2 + (1 if x % 2 else -1), 0), w - 1)
                near, beside = 3 * plane[y // 2, x // 2] + plane[y2, x // 2], 3 * plane[y // 2, x2] + plane[y2, x2]
                big[y, x] = (3 * near + beside + (7 if x % 2 else 8)) // 16
        full.append(big)
    y, cb, cr = full[0][: pic.height, : pic.width], *(p[: pic.height, : pic.width] - 128 for p in full[1:])
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(int)


def test_media_digests(spark):
    """All columns of every row from the texts: payloads by hashes, files and features by the same file made by itself."""
    want = []
    for doc, text, *_ in nasty.rows():
        raw = (text or "").encode()
        p = media.padded(raw)
        (file,) = jpeg.encode([p])
        rgb = jpeg.Batch([file]).tensor(0)
        sums = ":".join(str(int(rgb[:, :, k].astype(int).sum())) for k in range(3))
        feature = f"{rgb.shape[0]}x{rgb.shape[1]}:{zlib.crc32(rgb.tobytes()):08x}:{sums}"
        want.append((doc, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature))
    got = [tuple(r) for r in media.media_digests(nasty.frame(spark)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert media.media_digests(nasty.frame(spark, [])).count() == 0


def test_samples_by_rule():
    for text in (b"", b"a short text, stored in coefficients.", bytes(range(256)) * 9):
        (file,) = jpeg.encode([media.padded(text)])
        assert np.abs(jpeg.Batch([file]).tensor(0).astype(int) - samples_by_rule(file)).max() <= 3


def test_every_byte_has_a_coefficient_of_its_own():
    assert sorted(jpeg.COEFFICIENT.tolist()) == list(range(-128, 128))
    assert [int(jpeg.BYTE[v + 128]) for v in jpeg.COEFFICIENT] == list(range(256))


def test_tensors(spark):
    df = nasty.docs(spark, ["some text", None, "more " * 100])
    got = media.tensors(media.stored(df)).orderBy("doc_id").collect()
    assert [len(r["rgb"]) for r in got] == [r["height"] * r["width"] * 3 for r in got]
    empty = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert media.tensors(empty).first()["rgb"] is None
