"""Frame hashes over pixel arrays, as numpy functions and a pandas UDF.

Frames are RGB bytes with their width and height. Resampling is a separable windowed sinc (three
lobes) stretched by the scale when shrinking, clipped and rounded to bytes after each pass.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_SIDE, FACTOR, LOBES = 8, 4, 3.0
LUMA = np.array([0.299, 0.587, 0.114])


@lru_cache(64)
def resample_weights(source: int, target: int) -> np.ndarray:
    """target x source weights of the windowed sinc filter."""
    scale = source / target
    stretch = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    place = np.arange(source) + 0.5
    x = (place[None, :] - centre[:, None]) / stretch
    weights = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return weights / weights.sum(1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """image (rows, columns[, channels]) in the new size, as bytes."""
    across = np.clip(np.rint(np.einsum("wc,rc...->rw...", resample_weights(image.shape[1], width), image.astype(float))), 0, 255)
    return np.clip(np.rint(np.einsum("hr,rw...->hw...", resample_weights(image.shape[0], height), across)), 0, 255)


def luma(image: np.ndarray) -> np.ndarray:
    return np.rint(image[..., :3] @ LUMA)


@lru_cache(4)
def cosine_basis(n: int) -> np.ndarray:
    """Rows of the type II discrete cosine transform."""
    return np.cos(np.pi * np.arange(n)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))


def perceptual_hash(image: np.ndarray) -> str:
    """64 bits: low frequencies over the median of all but the constant one, row by row."""
    side = HASH_SIDE * FACTOR
    basis = cosine_basis(side)
    low = (basis @ resize(luma(image), side, side) @ basis.T)[:HASH_SIDE, :HASH_SIDE].ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def is_blank(image: np.ndarray, threshold: float = 4.0) -> bool:
    return float(luma(image).std()) < threshold


def color_signature(image: np.ndarray, bins: int = 4) -> str:
    """A hex digit per colour bin: its share of the pixels, 15 for all."""
    small = resize(image[..., :3], 32, 32)
    part = np.minimum((small / 256.0 * bins).astype(int), bins - 1)
    counts = np.bincount((part @ np.array([bins * bins, bins, 1])).ravel(), minlength=bins**3)
    return "".join(f"{int(15 * share):x}" for share in np.minimum(counts / counts.sum(), 1.0))


def safe_region(image: np.ndarray, top: float = 0.12, bottom: float = 0.12, side: float = 0.06) -> np.ndarray:
    h, w = image.shape[:2]
    return image[int(h * top) : int(h * (1 - bottom)), int(w * side) : int(w * (1 - side))]


def centre(image: np.ndarray, fraction: float = 0.8) -> np.ndarray:
    h, w = image.shape[:2]
    height, width = int(h * fraction), int(w * fraction)
    top, left = (h - height) // 2, (w - width) // 2
    return image[top : top + height, left : left + width]


def fingerprint_frame(image: np.ndarray, blank_threshold: float = 4.0) -> tuple[bool, str | None, str | None, str | None, str | None]:
    """(blank, hash, hash of the centre, hash of the mirror image, colour signature) of a frame."""
    safe = safe_region(image)
    if is_blank(safe, blank_threshold):
        return True, None, None, None, None
    return False, perceptual_hash(safe), perceptual_hash(centre(safe)), perceptual_hash(safe[:, ::-1]), color_signature(safe)


_FRAME = T.StructType(
    [T.StructField("blank", T.BooleanType())]
    + [T.StructField(n, T.StringType()) for n in ("phash", "phash_cropped", "phash_flipped", "color_sig")]
)


@F.pandas_udf(_FRAME)
def fingerprint_frames(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """RGB bytes of frames to their fingerprints, a batch at a time."""
    rows = [
        fingerprint_frame(np.frombuffer(p, np.uint8).reshape(int(h), int(w), 3)) if p is not None else (None,) * 5
        for p, w, h in zip(pixels, width, height)
    ]
    return pd.DataFrame(rows, columns=["blank", "phash", "phash_cropped", "phash_flipped", "color_sig"])
