"""Images as arrays: decoding, scaling, sharpening, turning, and what a page's ink says of its layout.

PNG files of 8 bits a channel are read here; any other kind (JPEG) needs Pillow, and counts as not
readable without it.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

from . import pdf

# Grey below which a point is ink, the width and the grid that a page is looked at in, and angles that are tried.
INK, WIDEST, GRID, ANGLES = 200, 400, 64, range(-5, 6)


def decode(data: bytes) -> np.ndarray | None:
    """(height, width) of grey or (height, width, 3) of colours; None for what can't be read."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        from PIL import Image

        with Image.open(io.BytesIO(data)) as im:
            return np.asarray(im.convert("L" if im.mode in ("1", "L") else "RGB"))
    except (ImportError, OSError, ValueError, IndexError, struct.error, zlib.error):
        return None


def _png(data: bytes) -> np.ndarray:
    at, head, body = 8, b"", []
    while at + 8 <= len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + n]
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour, 0)
    if depth != 8 or interlaced or not channels:
        raise ValueError("not an image of 8 bits a channel")
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h + 1, w * channels + channels), np.uint8)  # a row and a point of zeros before
    for y in range(h):
        kind, line, up = rows[y, 0], rows[y, 1:].astype(np.int64), out[y].astype(np.int64)
        if kind == 2:
            line = line + up[channels:]
        elif kind == 1:
            line = line.reshape(w, channels).cumsum(0).ravel()
        elif kind in (3, 4):
            done = np.zeros(len(up), np.int64)
            for x in range(len(line)):
                a, b, c = done[x], up[x + channels], up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[x + channels] = (line[x] + guess) & 255
            line = done[channels:]
        out[y + 1, channels:] = line & 255
    image = out[1:, channels:].reshape(h, w, channels)
    return image[:, :, 0] if channels < 3 else image[:, :, :3]


def encode(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    return pdf.png(w, h, 3 if image.ndim == 3 else 1, np.ascontiguousarray(image, np.uint8).tobytes())


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return ((image.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def _box(x: np.ndarray) -> np.ndarray:
    return ((x > -0.5) & (x <= 0.5)).astype(float)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


_KERNELS = {"box": (_box, 0.5), "cubic": (_cubic, 2.0), "lanczos": (_lanczos, 3.0)}


def _weights(old: int, new: int, kind: str) -> np.ndarray:
    kernel, reach = _KERNELS[kind]
    scale = max(1.0, old / new)
    centre = (np.arange(new) + 0.5) * old / new
    w = kernel((np.arange(old)[None, :] + 0.5 - centre[:, None]) / scale)
    w[np.abs(np.arange(old)[None, :] + 0.5 - centre[:, None]) > reach * scale] = 0
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int, kind: str = "cubic") -> np.ndarray:
    """Scaled by a separable kernel, which widens when it shrinks."""
    x = image.astype(np.float64)
    x = np.tensordot(_weights(x.shape[1], width, kind), x, (1, 1)).swapaxes(0, 1)
    x = np.tensordot(_weights(x.shape[0], height, kind), x, (1, 0))
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def upscaled(image: np.ndarray, scale: int = 2) -> np.ndarray:
    return resize(image, image.shape[1] * scale, image.shape[0] * scale, "lanczos")


def sharpened(image: np.ndarray, radius: float = 2.0, percent: float = 150.0, threshold: int = 3) -> np.ndarray:
    """Unsharp mask: what a Gaussian blur takes away is added once more, where it is above the threshold."""
    n = int(3 * radius + 0.5)
    kernel = np.exp(-(np.arange(-n, n + 1) ** 2) / (2 * radius**2))
    kernel /= kernel.sum()
    x = image.astype(np.float64)
    soft = x
    for axis in (0, 1):
        padded = np.pad(soft, [(n, n) if k == axis else (0, 0) for k in range(x.ndim)], mode="edge")
        size = x.shape[axis]
        soft = sum(w * np.take(padded, np.arange(k, k + size), axis) for k, w in enumerate(kernel))
    gone = x - soft
    return np.clip(np.rint(np.where(np.abs(gone) > threshold, x + gone * percent / 100, x)), 0, 255).astype(np.uint8)


def turned(image: np.ndarray, degrees: float, grow: bool = False) -> np.ndarray:
    """A grey image turned counter-clockwise around its centre, white where nothing was; grow: nothing is cut off, and points are interpolated."""
    h, w = image.shape
    a = np.deg2rad(degrees)
    cos, sin = np.cos(a), np.sin(a)
    nh, nw = (int(np.ceil(abs(h * cos) + abs(w * sin))), int(np.ceil(abs(w * cos) + abs(h * sin)))) if grow else (h, w)
    y, x = np.mgrid[:nh, :nw]
    y, x = y + 0.5 - nh / 2, x + 0.5 - nw / 2
    sx, sy = x * cos - y * sin + w / 2 - 0.5, x * sin + y * cos + h / 2 - 0.5
    padded = np.pad(image.astype(np.float64), 1, constant_values=255)
    at = lambda r, c: padded[np.clip(r + 1, 0, h + 1), np.clip(c + 1, 0, w + 1)]
    if not grow:
        return at(np.rint(sy).astype(int), np.rint(sx).astype(int)).astype(np.uint8)
    r, c = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fr, fc = sy - r, sx - c
    out = (1 - fr) * ((1 - fc) * at(r, c) + fc * at(r, c + 1)) + fr * ((1 - fc) * at(r + 1, c) + fc * at(r + 1, c + 1))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _small(image: np.ndarray) -> np.ndarray:
    g = grey(image)
    return resize(g, WIDEST, max(1, g.shape[0] * WIDEST // g.shape[1])) if g.shape[1] > WIDEST else g


def _spread(x: np.ndarray) -> float:
    return float(np.var(np.rint(x)))


def geometry(image: np.ndarray) -> tuple[float, float, float]:
    """(share of ink, variance of the rows' means, variance of the columns' means) of a page."""
    g = _small(image)
    return float((resize(g, GRID, GRID, "box") < INK).mean()), _spread(g.mean(1)), _spread(g.mean(0))


def skew(image: np.ndarray) -> tuple[int, float, float]:
    """(the angle whose turn gives the rows' means the largest variance, that variance, the variance as it is)."""
    g = _small(image)
    spread = {a: _spread((turned(g, a) if a else g).mean(1)) for a in ANGLES}
    best = max(ANGLES, key=lambda a: spread[a])  # the first of the best
    return best, spread[best], spread[0]
