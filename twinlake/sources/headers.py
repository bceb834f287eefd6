"""What files say of themselves in their headers: sizes of images, their orientation, lengths and sizes of movies."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

#: read(at, n): up to n bytes of a file from a place on.
Read = Callable[[int, int], bytes]
# ---- fixed values: markers of JPEG frames, and names of ISO media boxes that hold boxes ----
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
ALONE = frozenset([0x01, *range(0xD0, 0xD8)])
ORIENTATION = 0x0112
# ---- end of fixed values ----
#: Markers of a JPEG file, boxes of a level and bytes of a movie's description that are looked at; damaged files end there.
MARKERS, BOXES, MOVIE_BYTES = 1000, 10_000, 1 << 28


def _segments(read: Read):
    """(marker, place, length) of the segments of a JPEG file up to its pixels."""
    at = 2
    for _ in range(MARKERS):
        head = read(at, 4)
        if len(head) < 4 or head[0] != 0xFF:
            return
        if head[1] == 0xFF:  # filling
            at += 1
        elif head[1] in ALONE:
            at += 2
        elif head[1] == 0xDA or head[1] == 0xD9:
            return
        else:
            n = int.from_bytes(head[2:4], "big")
            yield head[1], at + 4, n - 2
            at += 2 + n


def image_size(read: Read) -> tuple[int, int]:
    """(width, height) of a PNG, JPEG, GIF or BMP file as it is stored; (0, 0) of others."""
    head = read(0, 32)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        if int.from_bytes(head[14:18], "little") == 12:
            return struct.unpack("<HH", head[18:22])
        w, h = struct.unpack("<ii", head[18:26])
        return max(w, 0), abs(h)  # rows can be stored from the top
    if head[:2] == b"\xff\xd8":
        for marker, at, n in _segments(read):
            if marker in FRAMES and n >= 5:
                h, w = struct.unpack(">HH", read(at + 1, 4).ljust(4, b"\0"))
                return w, h
    return 0, 0


def orientation(read: Read) -> int:
    """1 to 8: how a JPEG file's EXIF data says that its rows and columns lie; 1 where it does not say."""
    if read(0, 2) != b"\xff\xd8":
        return 1
    for marker, at, n in _segments(read):
        if marker != 0xE1 or n < 14 or read(at, 6) != b"Exif\0\0":
            continue
        t = read(at + 6, n - 6)
        order = {b"II": "<", b"MM": ">"}.get(t[:2])
        if order is None or len(t) < 8:
            return 1
        place = struct.unpack(f"{order}I", t[4:8])[0]
        count = struct.unpack(f"{order}H", t[place : place + 2].ljust(2, b"\0"))[0]
        for k in range(count):
            entry = t[place + 2 + 12 * k : place + 14 + 12 * k]
            if len(entry) < 12:
                break
            tag, kind = struct.unpack(f"{order}HH", entry[:4])
            if tag == ORIENTATION and kind == 3:
                said = struct.unpack(f"{order}H", entry[8:10])[0]
                return said if 1 <= said <= 8 else 1
        return 1
    return 1


def upright(pixels: np.ndarray, said: int) -> np.ndarray:
    """A raster (height, width, ...) as it is to be seen, from one stored with an orientation."""
    if said in (5, 6, 7, 8):
        pixels = pixels.swapaxes(0, 1)
    rows, columns = {1: (1, 1), 2: (1, -1), 3: (-1, -1), 4: (-1, 1), 5: (1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}[said]
    return pixels[::rows, ::columns]


def _boxes(read: Read, at: int, end: int):
    """(name, place, end) of the boxes in a range of an ISO media file."""
    for _ in range(BOXES):
        head = read(at, 16) if at + 8 <= end else b""
        if len(head) < 8:
            return
        n, first = int.from_bytes(head[:4], "big"), 8
        if n == 1 and len(head) == 16:
            n, first = int.from_bytes(head[8:16], "big"), 16
        elif n == 0:
            n = end - at  # the last box of a file may go to its end
        if n < first or at + n > end:
            return
        yield head[4:8], at + first, at + n
        at += n


def movie_size(read: Read, length: int) -> tuple[int, int, float]:
    """(width, height, seconds) of an MP4, M4V, MOV or 3GP file, turned as it is to be seen; zeros where it does not say.

    Only heads of boxes and the movie's description are read, wherever in the
    file that is; samples never are.
    """
    movie = next(((a, b) for name, a, b in _boxes(read, 0, length) if name == b"moov"), None)
    if movie is None or movie[1] - movie[0] > MOVIE_BYTES:
        return 0, 0, 0.0
    raw = read(movie[0], movie[1] - movie[0])
    inside: Read = lambda at, n: raw[at : at + n]
    scale, length, size = 0, 0, (0, 0)
    for name, a, b in _boxes(inside, 0, len(raw)):
        if name == b"mvhd":
            long = raw[a : a + 1] == b"\x01"
            t = raw[a + (20 if long else 12) : a + (32 if long else 20)]
            scale = int.from_bytes(t[:4], "big")
            length = length or int.from_bytes(t[4:], "big") * (t[4:] != b"\xff" * len(t[4:]))
        elif name == b"mvex":  # the whole length of a movie in fragments
            for other, c, d in _boxes(inside, a, b):
                if other == b"mehd" and not length:
                    length = int.from_bytes(raw[c + 4 : min(d, c + (12 if raw[c : c + 1] == b"\x01" else 8))], "big")
        elif name == b"trak" and size == (0, 0):
            size = _track_size(raw, inside, a, b)
    if not scale or not length:
        return 0, 0, 0.0
    return *size, length / scale


def _track_size(raw: bytes, read: Read, a: int, b: int) -> tuple[int, int]:
    """Turned size of a track, (0, 0) where it is no picture."""
    head = media = None
    for name, c, d in _boxes(read, a, b):
        if name == b"tkhd":
            head = raw[c:d]
        elif name == b"mdia":
            media = next((raw[e + 8 : e + 12] for n, e, _ in _boxes(read, c, d) if n == b"hdlr"), None)
    if head is None or media != b"vide":
        return 0, 0
    tail = head[-44:]  # nine numbers of a matrix, then width and height
    if len(tail) < 44:
        return 0, 0
    m = struct.unpack(">9i", tail[:36])
    w, h = (x / 65536 for x in struct.unpack(">II", tail[36:]))
    p, q, r, s = (x / 65536 for x in (m[0], m[1], m[3], m[4]))
    return int(abs(p * w + r * h)), int(abs(q * w + s * h))
