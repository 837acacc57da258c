"""Model artefacts: listing, checking by digest, clearing, falling back, scoring.

A variant is a folder of files with ``digests.json``, the SHA-256 of each.  Variants
are tried in a given order; the first whose files are all there and as their digests
say is used, and without one the rules score.  A Python worker fetches and checks
the artefact once and scores batches with it.

The artefact here is a linear 3-class head over hashed words (``head.npz``); any
other goes by its own ``load``.
"""

from __future__ import annotations

import hashlib
import io
import json
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..operators.ensemble import Scorer, rule_scorer
from .landing import Folder
from .tables import MODEL_ORDER

# Classes in the order of the head's outputs.
CLASSES = ("open", "closed", "unclear")
DIGESTS, HEAD = "digests.json", "head.npz"
#: Rows of a scored batch.
ROWS = 1024
Predict = Callable[[list[str]], np.ndarray]


class BrokenModel(ValueError):
    """An artefact that isn't what its digests say."""


def _bytes(folder: Folder, name: str) -> bytes | None:
    try:
        with folder.system.open_input_stream(f"{folder.path}/{name}") as f:
            return f.read()
    except FileNotFoundError:
        return None


def save(path: str, variant: str, files: dict[str, bytes]) -> None:
    """Write a variant; its digests come last, so one that was cut short isn't complete."""
    folder = Folder(path)
    for name, body in files.items():
        folder.write(f"{variant}/{name}", body)
    folder.write(f"{variant}/{DIGESTS}", json.dumps({n: hashlib.sha256(b).hexdigest() for n, b in files.items()}).encode())


def problems(path: str, variant: str) -> list[str]:
    """What keeps a variant from use: files that are missing, or not as their digest says."""
    folder = Folder(path)
    try:
        wanted = folder.read(f"{variant}/{DIGESTS}")
    except ValueError:
        return [f"{DIGESTS}: broken"]
    if not wanted:
        return [f"{DIGESTS}: missing"]
    out = []
    for name, digest in sorted(wanted.items()):
        body = _bytes(folder, f"{variant}/{name}")
        if body is None or hashlib.sha256(body).hexdigest() != digest:
            out.append(f"{name}: {'missing' if body is None else 'broken'}")
    return out


def listing(path: str) -> list[tuple[str, int, bool]]:
    """(variant, bytes, usable) of all that is there."""
    folder = Folder(path)
    sizes = lambda v: sum(len(_bytes(folder, f) or b"") for f in folder.files(v))
    return [(v, sizes(v), not problems(path, v)) for v in folder.names()]


def clear(path: str, variant: str | None = None) -> list[str]:
    """Remove a variant, or all; the names of those removed."""
    folder = Folder(path)
    gone = [v for v in folder.names() if variant in (None, v)]
    for v in gone:
        folder.remove(v)
    return gone


def usable(path: str, order: tuple[str, ...] = MODEL_ORDER) -> str | None:
    """The first variant without a problem."""
    return next((v for v in order if not problems(path, v)), None)


# -------------------------------------------------------------------- scoring


def hashed(texts: list[str], width: int) -> np.ndarray:
    """Counts of lower-case words by their hash."""
    out = np.zeros((len(texts), width))
    for n, t in enumerate(texts):
        for w in (t or "").lower().split():
            out[n, zlib.crc32(w.encode()) % width] += 1
    return out


def head(weights: np.ndarray, bias: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.savez(held, weights=weights, bias=bias)
    return held.getvalue()


def load_head(files: dict[str, bytes]) -> Predict:
    """Probabilities of the classes from the linear head."""
    held = np.load(io.BytesIO(files[HEAD]))
    weights, bias = held["weights"], held["bias"]

    def predict(texts: list[str]) -> np.ndarray:
        logits = hashed(texts, len(weights)) @ weights + bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return predict


def fetched(path: str, variant: str) -> dict[str, bytes]:
    """Files of a variant, checked as they are read."""
    found = problems(path, variant)
    if found:
        raise BrokenModel(f"{variant}: {', '.join(found)}")
    folder = Folder(path)
    return {n: _bytes(folder, f"{variant}/{n}") for n in folder.read(f"{variant}/{DIGESTS}")}


def model_scorer(path: str, order: tuple[str, ...] = MODEL_ORDER, load: Callable[[dict[str, bytes]], Predict] = load_head, rows: int = ROWS) -> Scorer:
    """A scorer of the first usable variant; the rules where there is none."""
    variant = usable(path, order)
    if variant is None:
        return rule_scorer

    def make() -> Callable[[np.ndarray], np.ndarray]:
        predict = load(fetched(path, variant))  # once a worker
        return lambda texts: predict(["" if t is None else str(t) for t in texts.ravel().tolist()])

    probabilities = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=rows)

    def run(components: DataFrame) -> DataFrame:
        scored = components.withColumn("probabilities_", probabilities(F.coalesce("text", F.lit(""))))
        best = F.array_max("probabilities_")
        label = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.array_position("probabilities_", best).cast("int"))
        return scored.withColumns({"model_status": label, "model_confidence": best}).drop("probabilities_")

    return run
