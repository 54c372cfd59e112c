"""Image kernels on NumPy arrays (h, w, c), and an Arrow UDF that applies one to stored frames.

Random parameters come from a hash of a sample's name, so that all views and frames of a sample are
treated alike, wherever they are computed.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def to_uint8(x: np.ndarray) -> np.ndarray:
    """Floats of [0, 1] times 255; anything else is cast."""
    return (np.clip(x, 0, 1) * 255).astype(np.uint8) if np.issubdtype(x.dtype, np.floating) else x.astype(np.uint8)


def letterbox(x: np.ndarray, fill: int = 0) -> np.ndarray:
    """Padded to a square; an odd pixel goes to the bottom or right."""
    h, w = x.shape[:2]
    n = max(h, w)
    t, l = (n - h) // 2, (n - w) // 2
    out = np.full((n, n, *x.shape[2:]), fill, x.dtype)
    out[t : t + h, l : l + w] = x
    return out


def crop(x: np.ndarray, fraction: float, at: tuple[float, float] = (0.5, 0.5)) -> np.ndarray:
    """A part of int(side * fraction) pixels, at least 1, at a relative place; (0.5, 0.5) is the centre."""
    h, w = (max(1, int(s * fraction)) for s in x.shape[:2])
    t, l = int(at[0] * (x.shape[0] - h)), int(at[1] * (x.shape[1] - w))
    return x[t : t + h, l : l + w]


def resize(x: np.ndarray, h: int, w: int, linear: bool = False) -> np.ndarray:
    """Nearest pixels, or with `linear` between the four around each place, pixel centres being at halves."""
    if linear:
        at = lambda n, m: np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        i, j = at(h, x.shape[0]), at(w, x.shape[1])
        a, b = np.floor(i).astype(int), np.floor(j).astype(int)
        f, g = (i - a).reshape(-1, 1, *[1] * (x.ndim - 2)), (j - b).reshape(1, -1, *[1] * (x.ndim - 2))
        c, d = np.minimum(a + 1, x.shape[0] - 1), np.minimum(b + 1, x.shape[1] - 1)
        y = x.astype(np.float64)
        y = (y[a][:, b] * (1 - g) + y[a][:, d] * g) * (1 - f) + (y[c][:, b] * (1 - g) + y[c][:, d] * g) * f
        return np.round(y).astype(x.dtype) if np.issubdtype(x.dtype, np.integer) else y.astype(x.dtype)
    i = np.minimum((np.arange(h) + 0.5) * x.shape[0] / h, x.shape[0] - 1).astype(int)
    j = np.minimum((np.arange(w) + 0.5) * x.shape[1] / w, x.shape[1] - 1).astype(int)
    return x[i][:, j]


def resize_pad(x: np.ndarray, h: int, w: int, fill: int = 0) -> np.ndarray:
    """As large as fits with its aspect kept, centred on a canvas of h x w."""
    s = min(h / x.shape[0], w / x.shape[1])
    y = resize(x, max(1, round(x.shape[0] * s)), max(1, round(x.shape[1] * s)))
    out = np.full((h, w, *x.shape[2:]), fill, x.dtype)
    t, l = (h - y.shape[0]) // 2, (w - y.shape[1]) // 2
    out[t : t + y.shape[0], l : l + y.shape[1]] = y
    return out


def beside(*views: np.ndarray) -> np.ndarray:
    """Views side by side, at the least height, made even."""
    h = min(v.shape[0] for v in views)
    h = max(2, h - h % 2)
    return np.concatenate([resize(v, h, max(1, round(v.shape[1] * h / v.shape[0]))) for v in views], axis=1)


def masked_noise(x: np.ndarray, mask: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Noise where the mask is 0."""
    noise = rng.integers(0, 256, x.shape, dtype=np.uint8)
    return np.where(mask[..., None] > 0, x, noise)


def masked_tint(x: np.ndarray, mask: np.ndarray, colour: np.ndarray, strength: float) -> np.ndarray:
    """Blended with a colour where the mask is 0."""
    tinted = ((1 - strength) * x + strength * colour).astype(x.dtype)
    return np.where(mask[..., None] > 0, x, tinted)


def flip_vertical(x: np.ndarray) -> np.ndarray:
    return x[::-1]


def sample_rng(name: str, seed: int = 0) -> np.random.Generator:
    """A generator that depends on the sample alone."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{name}".encode()).digest()[:8], "little"))


def apply(frames: DataFrame, kernel: Callable[[np.ndarray, np.random.Generator], np.ndarray], sample: str, seed: int = 0) -> DataFrame:
    """Frames (.., h, w, c, dtype, data) treated by kernel(image, generator); one generator state per `sample`."""
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i).to_pylist() for i, n in enumerate(names)}
            for k in range(b.num_rows):
                x = np.frombuffer(cols["data"][k], cols["dtype"][k]).reshape(cols["h"][k], cols["w"][k], cols["c"][k])
                y = np.ascontiguousarray(kernel(x, sample_rng(str(cols[sample][k]), seed)))
                cols["h"][k], cols["w"][k] = y.shape[:2]
                cols["c"][k], cols["dtype"][k], cols["data"][k] = (y.shape[2] if y.ndim > 2 else 1), str(y.dtype), y.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(cols[n], b.schema.field(i).type) for i, n in enumerate(names)], names=names)

    return frames.mapInArrow(run, frames.schema)


def evaluation_pipeline(fraction: float, h: int, w: int) -> Callable[[np.ndarray, np.random.Generator], np.ndarray]:
    """The centre part, resized: the same whatever the generator."""
    return lambda x, _: resize(crop(x, fraction), h, w, linear=True)


def training_pipeline(fraction: float, h: int, w: int, brightness: float = 0.0, contrast: float = 0.0) -> Callable[[np.ndarray, np.random.Generator], np.ndarray]:
    """A part at a random place, resized, its brightness and contrast changed by factors of 1 +- the given; all from the sample's generator."""

    def run(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        y = resize(crop(x, fraction, (rng.random(), rng.random())), h, w, linear=True).astype(np.float64)
        b, c = 1 + brightness * rng.uniform(-1, 1), 1 + contrast * rng.uniform(-1, 1)
        y = (y * b - (y * b).mean()) * c + (y * b).mean()
        return np.clip(np.round(y), 0, 255).astype(np.uint8) if np.issubdtype(x.dtype, np.integer) else y.astype(x.dtype)

    return run
