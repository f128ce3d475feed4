"""Embedders of decoded images: the structural one, and models in ONNX files where onnxruntime and a file are there."""

from __future__ import annotations

import logging
from functools import cache
from typing import Protocol

import numpy as np

from . import imaging

log = logging.getLogger(__name__)

# The side of the crop, the short side before it, and the channels' means and deviations that image models are trained with.
CROP, SHORT = 224, 256
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


class Embedder(Protocol):
    """What a library takes; it is sent to workers, so it must pickle. Vectors carry its name and length."""

    name: str

    def embed_batch(self, images: list[np.ndarray]) -> np.ndarray:
        """A row for each image of red, green and blue."""
        ...


class Structural:
    name = "structure-456"

    def embed_batch(self, images: list[np.ndarray]) -> np.ndarray:
        return np.stack([imaging.embedding(x) for x in images]) if images else np.zeros((0, 456), np.float32)


def preprocessed(rgb: np.ndarray, crop: int = CROP, short: int = SHORT) -> np.ndarray:
    """Short side to short by cubic resampling, the middle crop x crop of it, standardised by channel; channels first."""
    height, width = rgb.shape[:2]
    scale = short / min(height, width)
    h, w = max(crop, round(height * scale)), max(crop, round(width * scale))
    down, across = imaging.resample_weights(height, h, "cubic"), imaging.resample_weights(width, w, "cubic").T
    top, left = (h - crop) // 2, (w - crop) // 2
    planes = [np.clip(np.rint(down @ rgb[:, :, i].astype(float) @ across), 0, 255)[top : top + crop, left : left + crop] for i in range(3)]
    return np.stack([(p / 255 - m) / d for p, m, d in zip(planes, MEAN, DEVIATION)]).astype(np.float32)


@cache
def _session(path: str):
    """One for each worker process."""
    import onnxruntime

    return onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])


class Model:
    """A model in a file that every worker can read. A first output of two dimensions is taken, else the first token of one with three."""

    def __init__(self, path: str, opened=_session):
        self.path, self.opened = path, opened
        self.name = f"model-{path.rstrip('/').rpartition('/')[2]}"

    def embed_batch(self, images: list[np.ndarray]) -> np.ndarray:
        session = self.opened(self.path)
        given = session.get_inputs()[0]
        fixed = given.shape[0] if isinstance(given.shape[0], int) else None
        pixels = np.stack([preprocessed(x) for x in images])
        step, parts = fixed or len(images), []
        for at in range(0, len(images), step):
            part = pixels[at : at + step]
            if len(part) < step:  # a fixed batch is filled up
                part = np.concatenate((part, np.zeros((step - len(part), *part.shape[1:]), np.float32)))
            outputs = session.run(None, {given.name: part})
            flat = next((x for x in outputs if x.ndim == 2), None)
            parts.append((outputs[0][:, 0] if flat is None else flat)[: len(images) - at])
        return np.concatenate(parts).astype(np.float32)


def load(path: str | None) -> Embedder:
    """The model at path; the structural embedder without one, or where it can't be run."""
    if path:
        try:
            own = Model(path)
            own.embed_batch([np.zeros((CROP, CROP, 3), np.uint8)])
            return own
        except Exception as e:  # no runtime, no file, or no such model
            log.warning("%s can't be used, the structural embedder is: %s", path, e)
    return Structural()
