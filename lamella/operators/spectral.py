"""Slices from raw spectra: noise, apodisation, dispersion, depth transform, averaging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The scale of the apodisation's root and of the dispersion's phase.
APODISATION_SCALE, DISPERSION_SCALE = 7e4, 3.78e-4


def shrinking_mean(a: np.ndarray, span: int) -> np.ndarray:
    """Centred mean over an odd ``span`` that shrinks evenly at both ends."""
    n = len(a)
    half = np.minimum(np.minimum(np.arange(n), np.arange(n)[::-1]), (max(span, 1) - 1) // 2)
    total = np.concatenate(([0.0], np.cumsum(a)))
    i = np.arange(n)
    return (total[i + half + 1] - total[i - half]) / (2 * half + 1)


def tukey(n: int, taper: float) -> np.ndarray:
    """A flat window with cosine tapers over the share ``taper`` of its length."""
    if taper <= 0 or n < 2:
        return np.ones(n)
    x = np.arange(n) / (n - 1)
    edge = np.minimum(x, 1 - x) / (min(taper, 1.0) / 2)
    return np.where(edge < 1, 0.5 * (1 - np.cos(np.pi * np.minimum(edge, 1))), 1.0)


def noise_removed(spectra: np.ndarray, width: int = 256) -> np.ndarray:
    """Spectra [element, scan] less the running mean of each scan's first percentile, zero beyond the ends."""
    low = np.percentile(spectra, 1, axis=0)
    total = np.concatenate((np.zeros(width // 2 + 1), np.cumsum(low), np.full(width, low.sum())))
    i = np.arange(len(low))
    return spectra - (total[i + width] - total[i]) / width


def depth_kernel(chirp: np.ndarray) -> np.ndarray:
    """``exp(2 pi i z chirp / N)`` for the depths z of half as many rows as there are elements."""
    n = len(chirp)
    return np.exp(2j * np.pi * np.outer(np.arange(n // 2), chirp) / n).astype(np.complex64)


def averaged(scans: np.ndarray, n: int, how: str) -> np.ndarray:
    """Amplitudes of groups of ``n`` columns: mean amplitude, amplitude of the mean, or the first column's."""
    groups = scans[:, : scans.shape[1] // n * n].reshape(len(scans), -1, n)
    if how == "incoherent":
        return np.abs(groups).mean(axis=2)
    return np.abs(groups.mean(axis=2)) if how == "coherent" else np.abs(groups[:, :, 0])


def reconstructed(spectra: np.ndarray, chirp: np.ndarray, offset: np.ndarray, n_apo: int, kernel: np.ndarray | None = None, taper: float = 0.9, dispersion: float = 0.0, scale: float = 1.0, n: int = 1, how: str = "coherent") -> np.ndarray:
    """Amplitudes [depth, scan] of one slice from its spectra [element, scan], whose first ``n_apo`` scans are for apodisation."""
    elements = len(chirp)
    kernel = depth_kernel(chirp) if kernel is None else kernel
    apo = spectra[:, :n_apo].mean(axis=1)
    span = elements // 32 - 1
    root = np.sqrt(np.maximum(shrinking_mean(apo, span), 1e-9)) / APODISATION_SCALE
    window = tukey(elements, taper)
    window = window / window.sum() / root
    phase = np.exp(1j * dispersion * DISPERSION_SCALE * chirp**2 / elements)
    prepared = (window * np.conj(phase))[:, None] * (noise_removed(spectra) - (apo + shrinking_mean(offset / scale, span))[:, None])
    return averaged((kernel @ prepared.astype(np.complex64))[:, n_apo:], n, how)


def grey_rows(amplitudes: np.ndarray, db_min: float, db_max: float, speckle: bool = False) -> np.ndarray:
    """Grey bytes of amplitudes; with ``speckle`` dark pixels become the median of five in their column, edges mirrored."""
    with np.errstate(divide="ignore"):
        grey = np.clip(255 * (20 * np.log10(amplitudes) - db_min) / (db_max - db_min), 0, 255)
    if speckle and len(grey):
        padded = np.pad(grey, ((2, 2), (0, 0)), mode="symmetric")
        five = np.stack([padded[i : i + len(grey)] for i in range(5)])
        grey = np.where(grey < 100, np.median(five, axis=0), grey)
    return grey.astype(np.uint8)


SCHEMA = "volume_id string, slice int, height int, width int, pixels binary"


def reconstruct(spectra: DataFrame, db_min: float = 30, db_max: float = 100, taper: float = 0.9, dispersion: float = 0.0, averaging: str = "coherent", speckle: bool = False) -> DataFrame:
    """Grey slices of raw slices ``volume_id, slice, spectra (int16, scan by scan), chirp, offsets (float32), n_apo, n_average, scale``.

    Slices are worked on one by one where they lie; a task keeps the depth kernel of the last chirp it saw.
    A slice whose bytes don't fill whole scans, or with a null, gives null pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kernel = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                size, pixels = (0, 0), None
                if None not in (r["spectra"], r["chirp"]) and len(r["chirp"]) >= 8 and len(r["spectra"]) % (len(r["chirp"]) // 2) == 0:
                    chirp = np.frombuffer(r["chirp"], dtype="<f4").astype(np.float64)
                    if r["chirp"] != seen:
                        seen, kernel = r["chirp"], depth_kernel(chirp)
                    offset = np.frombuffer(r["offsets"], dtype="<f4").astype(np.float64) if r["offsets"] else np.zeros(len(chirp))
                    raw = np.frombuffer(r["spectra"], dtype="<i2").astype(np.float64).reshape(-1, len(chirp)).T
                    grey = grey_rows(reconstructed(raw, chirp, offset, r["n_apo"], kernel, taper, dispersion, r["scale"] or 1.0, r["n_average"] or 1, averaging), db_min, db_max, speckle)
                    size, pixels = grey.shape, grey.tobytes()
                out.append((r["volume_id"], r["slice"], *size, pixels))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return spectra.select("volume_id", "slice", "spectra", "chirp", "offsets", "n_apo", "n_average", "scale").mapInArrow(run, SCHEMA)
