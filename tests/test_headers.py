"""Sizes, orientation and lengths from headers, against decoded images and movies made here."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_review_and_store import _png

from twinlake import config as C
from twinlake.functions import signatures as S
from twinlake.sources import catalog, images
from twinlake.sources.headers import image_size, movie_size, orientation, upright


def reading(raw):
    return lambda at, n: raw[at : at + n]


def box(name, *parts):
    raw = b"".join(parts)
    return struct.pack(">I", 8 + len(raw)) + name + raw


def movie(seconds=12.5, w=1920, h=1080, matrix=(1, 0, 0, 1), long=False, media=b"vide", last=True, scale=600, fragments=None):
    """An MP4 file without samples."""
    n = 0 if fragments else round(seconds * scale)
    mvhd = box(b"mvhd", b"\x01\0\0\0" + bytes(16) + struct.pack(">IQ", scale, n) if long else bytes(12) + struct.pack(">II", scale, n), bytes(80))
    a, b, c, d = (round(x * 65536) for x in matrix)
    fixed = struct.pack(">9i", a, b, 0, c, d, 0, 0, 0, 1 << 30) + struct.pack(">II", w << 16, h << 16)
    tkhd = box(b"tkhd", b"\x01\0\0\0" + bytes(32 + 16) if long else bytes(24 + 16), fixed)
    sound = box(b"trak", box(b"tkhd", bytes(40), bytes(44)), box(b"mdia", box(b"hdlr", bytes(8), b"soun", bytes(13))))
    trak = box(b"trak", tkhd, box(b"mdia", box(b"mdhd", bytes(24)), box(b"hdlr", bytes(8), media, bytes(13))))
    more = [box(b"mvex", box(b"mehd", bytes(4), struct.pack(">I", fragments)))] if fragments else []
    moov = box(b"moov", mvhd, sound, trak, *more)
    data = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 16 + 5000) + bytes(5000)
    head = box(b"ftyp", b"isom", bytes(4))
    return head + (data + moov if last else moov + data)


@pytest.mark.parametrize("long", [False, True])
def test_movies(long):
    size = lambda raw: movie_size(reading(raw), len(raw))
    assert size(movie(long=long)) == (1920, 1080, 12.5)
    assert size(movie(long=long, last=False, matrix=(0, 1, -1, 0))) == (1080, 1920, 12.5)  # a quarter turn
    assert size(movie(long=long, matrix=(-1, 0, 0, -1))) == (1920, 1080, 12.5)
    assert size(movie(long=long, fragments=900)) == (1920, 1080, 1.5)
    assert size(movie(long=long, media=b"soun"))[:2] == (0, 0)
    assert size(movie(long=long, seconds=0)) == (0, 0, 0.0)
    raw = movie(long=long)
    for cut in (0, 7, 30, len(raw) - 10):
        assert size(raw[:cut]) == (0, 0, 0.0)
    rng = np.random.default_rng(1)
    for _ in range(300):  # damage is no error
        bad = bytearray(raw)
        for k in rng.integers(0, len(raw), 6):
            bad[int(k)] = int(rng.integers(0, 256))
        size(bytes(bad))


def jpeg(pixels, exif=None, java=None):
    """A JPEG file by the JVM's encoder, with EXIF data put behind its head."""
    h, w, _ = pixels.shape
    im = java.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in pixels[y, x])
            im.setRGB(x, y, r << 16 | g << 8 | b)
    out = java.java.io.ByteArrayOutputStream()
    java.javax.imageio.ImageIO.write(im, "jpg", out)
    raw = bytes(out.toByteArray())
    if exif is None:
        return raw
    order, said = exif
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HIH", 42, 8, 2) + struct.pack(f"{order}HHII", 0x010F, 2, 1, 0)
    tiff += struct.pack(f"{order}HHIHH", 0x0112, 3, 1, said, 0) + bytes(4)
    app = b"Exif\0\0" + tiff
    return raw[:2] + b"\xff\xe1" + struct.pack(">H", len(app) + 2) + app + raw[2:]


def test_a_folder_is_measured_without_decoding(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (24, 40, 3)).astype(np.uint8)
    _png(tmp_path / "a.png", x)
    (tmp_path / "b c.JPG").write_bytes(jpeg(x, java=spark._jvm))
    (tmp_path / "d.jpeg").write_bytes(jpeg(x, ("<", 6), spark._jvm))
    (tmp_path / "g.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 7, 9) + bytes(20))
    (tmp_path / "h.bmp").write_bytes(b"BM" + bytes(12) + struct.pack("<Iii", 40, 11, -13) + bytes(30))
    (tmp_path / "m.mp4").write_bytes(movie(matrix=(0, 1, -1, 0)))
    (tmp_path / "n.MOV").write_bytes(movie(seconds=3, w=640, h=480, last=False))
    (tmp_path / "bad.mp4").write_bytes(b"no movie")
    (tmp_path / "bad.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / ".m.mp4").write_bytes(movie())
    df = catalog.scan_folder(spark, str(tmp_path))
    got = {r.origin.split("/")[-1]: (r.kind, r.pixel_width, r.pixel_height, r.duration) for r in df.collect()}
    assert got == {
        "a.png": (C.PHOTO, 40, 24, 0.0), "b c.JPG": (C.PHOTO, 40, 24, 0.0), "d.jpeg": (C.PHOTO, 40, 24, 0.0), "g.gif": (C.PHOTO, 7, 9, 0.0),
        "h.bmp": (C.PHOTO, 11, 13, 0.0), "m.mp4": (C.VIDEO, 1080, 1920, 12.5), "n.MOV": (C.VIDEO, 640, 480, 3.0),
    }
    assert all(r.byte_size == (tmp_path / r.origin.split("/")[-1]).stat().st_size for r in df.collect())
    assert {r.origin.split("/")[-1] for r in catalog.scan_folder(spark, str(tmp_path), kinds=[C.VIDEO]).collect()} == {"m.mp4", "n.MOV"}
    sizes = spark.read.format("image").option("dropInvalid", True).load(str(tmp_path)).select("image.origin", "image.width", "image.height").collect()
    for r in sizes:
        name = r.origin.split("/")[-1].replace("%20", " ")
        assert got[name][1:3] == (r.width, r.height)


def test_eight_orientations_of_a_scene_have_one_hash(spark, tmp_path):
    rng = np.random.default_rng(5)
    scene = np.kron(rng.integers(0, 256, (6, 8, 3)), np.ones((16, 16, 1), int)).astype(np.uint8)
    for said in range(1, 9):
        # what upright() undoes: rows and columns are mirrored, then exchanged
        stored = next(s for s in (t[::a, ::b] for t in (scene, scene.swapaxes(0, 1)) for a in (1, -1) for b in (1, -1)) if s.shape[0] == (96 if said < 5 else 128) and np.array_equal(upright(s, said), scene))
        (tmp_path / f"{said}.jpg").write_bytes(jpeg(stored, ("<" if said % 2 else ">", said), spark._jvm))
        raw = (tmp_path / f"{said}.jpg").read_bytes()
        assert orientation(reading(raw)) == said and image_size(reading(raw)) == (stored.shape[1], stored.shape[0])
    prints = S.fingerprints(images.load_pixels(spark, str(tmp_path), edge=16).where(F.col("status") == "ready"))
    rows = prints.select("dhash", "mean_luma").collect()
    assert len(rows) == 8 and len({r.dhash for r in rows}) == 1
    assert orientation(reading(jpeg(scene, None, spark._jvm))) == 1 == orientation(reading(jpeg(scene, ("<", 77), spark._jvm)))
