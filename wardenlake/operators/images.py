"""Image operators on decoded pixels: image_id, height, width, channels (int), pixels (binary, uint8, row by row).

Pixels need NumPy; images go through Python in Arrow batches, one at a time, so memory is one image. What doesn't need pixels stays in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAY = np.array([0.299, 0.587, 0.114])
SCHEMA = "height int, width int, channels int, pixels binary"


def array_of(height: int, width: int, channels: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, channels)


def rgb(image: np.ndarray) -> np.ndarray:
    return np.repeat(image[:, :, :1], 3, 2) if image.shape[2] < 3 else image[:, :, :3]


def gray(image: np.ndarray) -> np.ndarray:
    return rgb(image).astype(np.float64) @ GRAY


def correlate(g: np.ndarray, kernel: list[list[float]]) -> np.ndarray:
    """Valid 3 x 3 correlation."""
    h, w = g.shape[0] - 2, g.shape[1] - 2
    return sum(k * g[i : i + h, j : j + w] for i, row in enumerate(kernel) for j, k in enumerate(row) if k)


def saturation(c: np.ndarray) -> float:
    top, low = c.max(2) / 255.0, c.min(2) / 255.0
    return float(np.where(top > 1e-6, (top - low) / (top + 1e-6), 0.0).mean())


def color_cast(c: np.ndarray) -> float:
    """Length of the mean (a*, b*) in CIELAB, D65."""
    v = c / 255.0
    linear = np.where(v > 0.04045, ((v + 0.055) / 1.055) ** 2.4, v / 12.92)
    # sRGB to XYZ, and the white point.
    xyz = linear @ np.array([[0.4124564, 0.2126729, 0.0193339], [0.3575761, 0.7151522, 0.1191920], [0.1804375, 0.0721750, 0.9503041]]) / np.array([0.95047, 1.0, 1.08883])
    edge = 6 / 29
    f = np.where(xyz > edge**3, np.cbrt(xyz), xyz / (3 * edge**2) + 4 / 29)
    return float(math.hypot((500 * (f[..., 0] - f[..., 1])).mean(), (200 * (f[..., 1] - f[..., 2])).mean()))


def blockiness(g: np.ndarray) -> float:
    """Mean step over the borders of 8 x 8 blocks against that elsewhere."""
    if min(g.shape) < 16:
        return 1.0
    at, off = [], []
    for d in (np.abs(np.diff(g, axis=1)), np.abs(np.diff(g, axis=0)).T):
        border = np.arange(d.shape[1]) % 8 == 7
        at.append(d[:, border].mean())
        off.append(d[:, ~border].mean())
    a, b = sum(at) / 2, sum(off) / 2
    return float(a / b) if b >= 1e-4 else float(min(10.0, max(2.0, a / 1e-4))) if a > 1e-4 else 1.0


def quality(image: np.ndarray) -> dict[str, float]:
    """Sharpness, exposure, colour, noise, blocks, uniform regions, and a score of them all."""
    c, g = rgb(image).astype(np.float64), gray(image)
    small = min(g.shape) < 3
    blur = 0.0 if small else float(correlate(g, [[0, 1, 0], [1, -4, 1], [0, 1, 0]]).var())
    gx, gy = (0.0, 0.0) if small else (correlate(g, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]), correlate(g, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]))
    sharp = float(np.mean(gx**2 + gy**2))
    noise = 0.0 if small else math.sqrt(math.pi / 2) / (6.0 * (g.shape[1] - 2) * (g.shape[0] - 2)) * float(np.abs(correlate(g, [[1, -2, 1], [-2, 4, -2], [1, -2, 1]])).sum())
    mean, contrast = float(g.mean()), float(g.std())
    snr = 50.0 if small else 60.0 if noise < 1e-5 else min(100.0, max(-30.0, 20 * math.log10(max(1e-4, mean) / (noise + 1e-6))))
    under, over, blocks = float((g < 15).mean()), float((g > 240).mean()), blockiness(g)
    rows, cols = g.shape[0] // 16, g.shape[1] // 16
    flat = float((g[: rows * 16, : cols * 16].reshape(rows, 16, cols, 16).var(axis=(1, 3)) < 1).mean()) if rows and cols else 0.0
    exposure = max(0.0, 1 - max(0.0, under - 0.20) * 1.5 - max(0.0, over - 0.15) * 1.5)
    score = 0.25 * min(1, blur / 150) + 0.15 * min(1, contrast / 35) + 0.20 * exposure + 0.15 * max(0, 1 - noise**2 / 300) + 0.10 * max(0, 1 - max(0, blocks - 1.5) * 0.5) + 0.15 * (1 - flat)
    return {"blur_variance": blur, "tenengrad": sharp, "luminance": mean, "contrast": contrast, "under": under, "over": over, "saturation": saturation(c), "color_cast": color_cast(c), "noise_variance": noise**2, "snr_db": snr, "blockiness": blocks, "uniform": flat, "quality": min(1.0, max(0.0, score))}


def descriptors(image: np.ndarray) -> dict[str, float]:
    c, g = rgb(image).astype(np.float64), gray(image)
    share = np.bincount(np.clip(g, 0, 255).astype(int).ravel(), minlength=256) / g.size
    share = share[share > 0]
    out = {"width": float(g.shape[1]), "height": float(g.shape[0]), "channels": float(image.shape[2] if image.ndim == 3 else 1), "n_bytes": float(image.nbytes), "aspect_ratio": g.shape[1] / g.shape[0]}
    out |= {"mean_intensity": float(g.mean()), "std_intensity": float(g.std()), "brightness": float(g.mean()), "rms_contrast": float(g.std()), "entropy": float(-(share * np.log2(share)).sum())}
    out |= {f"{n}_mean": float(c[..., i].mean()) for i, n in enumerate("rgb")} | {f"{n}_std": float(c[..., i].std()) for i, n in enumerate("rgb")}
    lap = float(correlate(g, [[0, 1, 0], [1, -4, 1], [0, 1, 0]]).var()) if min(g.shape) >= 3 else 0.0
    return out | {"laplacian_variance": lap, "clipping": float(((g <= 0) | (g >= 255)).mean()), "mean_saturation": saturation(c)}


def _histogram(x: np.ndarray, bins: int) -> np.ndarray:
    """Counts in bins of one width from 0 to 256, which is a power of two; values outside count nowhere, 256 counts in the last."""
    x = x.ravel()
    x = x[(x >= 0) & (x <= 256)]
    return np.bincount(np.minimum((x * (bins / 256)).astype(np.int64), bins - 1), minlength=bins)


def visual_vector(image: np.ndarray) -> list[float]:
    """128 numbers of length 1: histograms of red, green, blue (32 each), saturation and value (16 each)."""
    c = rgb(image).astype(np.float64)
    top, low = np.maximum(np.maximum(c[..., 0], c[..., 1]), c[..., 2]), np.minimum(np.minimum(c[..., 0], c[..., 1]), c[..., 2])
    s = np.where(top > 0, (top - low) / np.maximum(top, 1e-9), 0) * 255
    v = np.concatenate([*(_histogram(c[..., i], 32) for i in range(3)), *(_histogram(x, 16) for x in (s, top))]).astype(np.float64)
    return (v / max(np.linalg.norm(v), 1e-12)).tolist()


def resize(image: np.ndarray, height: int, width: int, method: str = "bilinear") -> np.ndarray:
    """Centers of pixels aligned; float64."""
    a = image.astype(np.float64)
    ys, xs = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((height, a.shape[0]), (width, a.shape[1])))
    if method == "nearest":
        return a[np.clip(np.rint(ys), 0, a.shape[0] - 1).astype(int)][:, np.clip(np.rint(xs), 0, a.shape[1] - 1).astype(int)]
    y0, x0 = np.clip(np.floor(ys), 0, a.shape[0] - 1).astype(int), np.clip(np.floor(xs), 0, a.shape[1] - 1).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    wy, wx = np.clip(ys - y0, 0, 1), np.clip(xs - x0, 0, 1)
    shape = (-1, 1) + (1,) * (a.ndim - 2)
    left, right = (a[y0][:, x] * (1 - wy.reshape(shape)) + a[y1][:, x] * wy.reshape(shape) for x in (x0, x1))
    wx = wx.reshape((1, -1) + (1,) * (a.ndim - 2))
    return left * (1 - wx) + right * wx


_DCT = np.cos(np.pi * (2 * np.arange(32)[None, :] + 1) * np.arange(8)[:, None] / 64) * np.where(np.arange(8) == 0, math.sqrt(1 / 32), math.sqrt(2 / 32))[:, None]


def signed(bits: np.ndarray) -> int:
    n = int("".join("1" if b else "0" for b in bits), 2)
    return n - (1 << 64) if n >= 1 << 63 else n


def phash(image: np.ndarray) -> int:
    """64 bits: the 8 x 8 lowest DCT terms of the 32 x 32 image against the median of all but the first."""
    d = (_DCT @ np.rint(resize(gray(image), 32, 32)).T @ _DCT.T).ravel()
    return signed(d > np.median(d[1:]))


def dhash(image: np.ndarray) -> int:
    """64 bits: whether each pixel of the 9 x 8 image is less than its right neighbour."""
    g = np.rint(resize(gray(image), 8, 9))
    return signed((g[:, 1:] > g[:, :-1]).ravel())


# --- perturbations, triggers, preprocessing --------------------------------------------------------------------------


def _back(x: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(x, 0, 255)).astype(np.uint8)


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    a = np.pad(image.astype(np.float64), ((r, r), (r, r), (0, 0)), "reflect" if min(image.shape[:2]) > r else "edge")
    a = sum(w * a[i : i + image.shape[0]] for i, w in enumerate(k))
    return sum(w * a[:, i : i + image.shape[1]] for i, w in enumerate(k))


def blocks_dct(image: np.ndarray, level: float) -> np.ndarray:
    """Coarse quantization of 8 x 8 DCT blocks: the loss that JPEG makes, without its file format."""
    n = np.arange(8)
    m = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / 16) * np.where(n == 0, math.sqrt(1 / 8), 0.5)[:, None]
    step = 1 + (n[:, None] + n[None, :]) * level
    h, w = (-(-s // 8) * 8 for s in image.shape[:2])
    a = np.pad(image.astype(np.float64) - 128, ((0, h - image.shape[0]), (0, w - image.shape[1]), (0, 0)), "edge").reshape(h // 8, 8, w // 8, 8, -1)
    d = np.einsum("ui,aibjc,vj->aubvc", m, a, m)
    s = step[None, :, None, :, None]
    back = np.einsum("ui,aubvc,vj->aibjc", m, np.rint(d / s) * s, m).reshape(h, w, -1) + 128
    return back[: image.shape[0], : image.shape[1]]


PERTURBATIONS: dict[str, Callable[[np.ndarray, np.random.Generator], np.ndarray]] = {
    "gaussian_noise": lambda a, r: a + r.normal(0, 0.05 * 255, a.shape), "uniform_noise": lambda a, r: a + r.uniform(-0.1 * 255, 0.1 * 255, a.shape), "brightness": lambda a, r: a * 1.2,
    "contrast": lambda a, r: (a - a.mean()) * 1.3 + a.mean(), "blur": lambda a, r: blur(a, 1.0), "compression": lambda a, r: blocks_dct(a, 8.0), "translation": lambda a, r: np.roll(a, (2, 3), (0, 1)),
}


def perturb(image: np.ndarray, name: str, seed: int) -> np.ndarray:
    return _back(PERTURBATIONS[name](image.astype(np.float64), np.random.Generator(np.random.PCG64(seed))))


def patch(image: np.ndarray, kind: str, size: int = 6, row: int = 0, col: int = 0, alpha: float = 1.0, seed: int = 0) -> np.ndarray:
    """A trigger blended in: a checkered spatial patch, a colour patch, a texture grid over all, or noise in one place."""
    h, w, c = image.shape
    mask, fill = np.zeros((h, w, 1)), np.zeros(image.shape)
    y, x = np.mgrid[:h, :w]
    inside = (y >= row) & (y < row + size) & (x >= col) & (x < col + size)
    if kind == "spatial":
        mask[inside], fill = 1, np.repeat(((x + y) % 2 * 255.0)[..., None], c, 2)
    elif kind == "color":
        mask[inside], fill = 1, np.broadcast_to(np.array([255.0, 0, 255.0, 255.0])[:c], image.shape)
    elif kind == "texture":
        mask[(x % size == 0) | (y % size == 0)], fill = 1, np.full(image.shape, 128.0)
    elif kind == "localized":
        mask[inside], fill = 1, np.random.Generator(np.random.PCG64(seed)).uniform(0, 255, image.shape)
    else:
        raise ValueError(f"unknown trigger {kind}")
    return _back(image * (1 - alpha * mask) + fill * alpha * mask)


def preprocess(image: np.ndarray, steps: list[tuple]) -> np.ndarray:
    """Steps in order: ("resize", h, w, method), ("center_crop", h, w), ("pad", n, value), ("channels", n), ("scale", low, high), ("normalize", mean, std)."""
    a = image.astype(np.float64)
    for name, *p in steps:
        if name == "resize":
            a = resize(a, p[0], p[1], p[2] if len(p) > 2 else "bilinear")
        elif name == "center_crop":
            top, left = (a.shape[0] - p[0]) // 2, (a.shape[1] - p[1]) // 2
            if top < 0 or left < 0:
                raise ValueError("crop is larger than the image")
            a = a[top : top + p[0], left : left + p[1]]
        elif name == "pad":
            a = np.pad(a, ((p[0], p[0]), (p[0], p[0]), (0, 0)), constant_values=p[1])
        elif name == "channels":
            a = (rgb(a) @ GRAY)[..., None] if p[0] == 1 else rgb(a)
        elif name == "scale":
            a = a / 255.0 * (p[1] - p[0]) + p[0]
        elif name == "normalize":
            a = (a - np.array(p[0])) / np.array(p[1])
        else:
            raise ValueError(f"unknown step {name}")
    return a


# --- as DataFrames ----------------------------------------------------------------------------------------------------


def measure(images: DataFrame, function: Callable[[np.ndarray], dict], names: list[str], image_id: str = "image_id", kind: str = "double") -> DataFrame:
    """image_id and function's values of each image; null where pixels and sizes disagree."""

    def run(batches):
        for pdf in batches:
            rows = []
            for h, w, c, p in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["pixels"], strict=True):
                good = p is not None and h > 0 and w > 0 and c > 0 and len(p) == h * w * c
                rows.append(function(array_of(h, w, c, p)) if good else dict.fromkeys(names))
            yield pd.concat([pdf[[image_id]].reset_index(drop=True), pd.DataFrame(rows, columns=names).astype("Int64" if kind == "long" else "float64")], axis=1)

    return images.select(image_id, *(x.split()[0] for x in SCHEMA.split(", "))).mapInPandas(run, f"{image_id} {dict(images.dtypes)[image_id]}, " + ", ".join(f"{n} {kind}" for n in names))


_PROBE = np.zeros((16, 16, 3), np.uint8)


def image_quality(images: DataFrame, image_id: str = "image_id") -> DataFrame:
    return measure(images, quality, list(quality(_PROBE)), image_id)


def image_descriptors(images: DataFrame, image_id: str = "image_id") -> DataFrame:
    return measure(images, descriptors, list(descriptors(_PROBE)), image_id)


def perceptual_hashes(images: DataFrame, image_id: str = "image_id") -> DataFrame:
    return measure(images, lambda a: {"phash": phash(a), "dhash": dhash(a)}, ["phash", "dhash"], image_id, "long")


def quality_findings(measured: DataFrame, image_id: str = "image_id") -> DataFrame:
    """image_id, finding: what is wrong with an image by its measures."""
    rules = {"BLURRED": F.col("blur_variance") < 20, "UNDEREXPOSED": F.col("under") > 0.6, "OVEREXPOSED": F.col("over") > 0.6, "LOW_CONTRAST": F.col("contrast") < 8, "NOISY": F.col("noise_variance") > 200, "BLOCKY": F.col("blockiness") > 2.5, "UNIFORM": F.col("uniform") > 0.9}
    return measured.select(image_id, F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))).alias("finding"))


def transform(images: DataFrame, function: Callable[[np.ndarray, int], np.ndarray], image_id: str = "image_id") -> DataFrame:
    """images with function's pixels: function(image, seed), the seed from the image's id."""

    def run(batches):
        for pdf in batches:
            made = [function(array_of(h, w, c, p), int(s)) for h, w, c, p, s in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["pixels"], pdf["__seed"], strict=True)]
            yield pd.DataFrame({image_id: pdf[image_id], "height": [a.shape[0] for a in made], "width": [a.shape[1] for a in made], "channels": [a.shape[2] for a in made], "pixels": [a.astype(np.uint8).tobytes() for a in made]})

    seed = F.pmod(F.xxhash64(image_id), F.lit(2**31)).alias("__seed")
    return images.select(image_id, "height", "width", "channels", "pixels", seed).mapInPandas(run, f"{image_id} {dict(images.dtypes)[image_id]}, {SCHEMA}")


def perturbed(images: DataFrame, name: str, image_id: str = "image_id") -> DataFrame:
    return transform(images, lambda a, s: perturb(a, name, s), image_id)


def triggered(images: DataFrame, kind: str, size: int = 6, row: int = 0, col: int = 0, alpha: float = 1.0, image_id: str = "image_id") -> DataFrame:
    return transform(images, lambda a, s: patch(a, kind, size, row, col, alpha, s), image_id)
