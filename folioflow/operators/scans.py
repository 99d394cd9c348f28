"""Scanned pages: images as pixel arrays prepared for OCR, rotation retries, correction by a model. The OCR engine is a function of the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .rollups import needs_correction

MODES = ("none", "grayscale", "threshold", "deskew")
ANGLES = tuple(a / 2 for a in range(-10, 11))


def grayscale(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image; a grey one stays."""
    return image if image.ndim == 2 else np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def binarized(image: np.ndarray, threshold: int) -> np.ndarray:
    return np.where(image > threshold, 255, 0).astype(np.uint8)


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise, on a canvas that holds all of it, white around; nearest pixels."""
    if degrees % 90 == 0:
        return np.rot90(image, int(degrees // 90) % 4)
    h, w = image.shape
    a = np.deg2rad(degrees)
    c, s = np.cos(a), np.sin(a)
    hh, ww = int(np.ceil(abs(h * c) + abs(w * s))), int(np.ceil(abs(w * c) + abs(h * s)))
    y, x = np.mgrid[0:hh, 0:ww]
    dx, dy = x - (ww - 1) / 2, y - (hh - 1) / 2
    sx, sy = np.rint(c * dx - s * dy + (w - 1) / 2).astype(int), np.rint(s * dx + c * dy + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full((hh, ww), 255, np.uint8)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def deskew_score(image: np.ndarray, angle: float, threshold: int) -> float:
    """Population variance of the dark pixels by row: lines of text that lie level give the most."""
    turned = rotated(image, angle)
    rows = (turned <= threshold).sum(1)
    return float(rows.var()) if turned.size and rows.any() else 0.0


def deskewed(image: np.ndarray, threshold: int) -> np.ndarray:
    best = max(ANGLES, key=lambda a: deskew_score(image, a, threshold))
    return image if abs(best) < 0.01 else rotated(image, best)


def prepared(image: np.ndarray, mode: str, threshold: int = 128) -> np.ndarray:
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "none":
        return image
    grey = grayscale(image)
    return grey if mode == "grayscale" else binarized(grey, threshold) if mode == "threshold" else deskewed(grey, threshold)


def oriented(image: np.ndarray, degrees: int, confidence: float, least: float = 1.5) -> np.ndarray:
    """Turned back by the detected orientation (clockwise degrees) if that is sure enough."""
    return rotated(image, -degrees % 360) if degrees % 360 and confidence >= least else image


def is_usable(confidence: Column, threshold: float) -> Column:
    return F.coalesce(confidence >= threshold, F.lit(False))


def rotation_choice(tries: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Of the tries (rotation, confidence, text) at 0, 90, 180 and 270 degrees the upright one if usable, else the most confident; null is least, the smaller rotation wins ties, a failed try (null text) is none."""
    done = tries.where("text IS NOT NULL OR rotation = 0")
    score = F.struct((F.col("rotation").eqNullSafe(0) & is_usable(F.col("confidence"), threshold)).alias("upright"),
        F.coalesce("confidence", F.lit(-1.0)).alias("c"), (-F.col("rotation")).alias("r"))
    return done.groupBy(*by).agg(F.max_by(F.struct("rotation", "confidence", "text"), score).alias("best")).select(*by, "best.*")


def read_pages(images: DataFrame, ocr: Callable[[np.ndarray], tuple[str, float | None]], by: list[str], mode: str = "none",
    threshold: int = 128, low_confidence: float = 60.0, retry: bool = True) -> DataFrame:
    """(by, text, confidence, rotation_degrees, error) of images (height, width, channels, pixels): prepared, read upright, and turned by 90, 180 and 270 degrees while no try is usable."""
    fields = ", ".join(f"{c} {images.schema[c].dataType.simpleString()}" for c in by)

    def one(h: int, w: int, channels: int, pixels: bytes) -> tuple:
        image = np.frombuffer(pixels, np.uint8).reshape((h, w) if channels == 1 else (h, w, channels))
        try:
            text, sure = ocr(prepared(image, mode, threshold))
        except Exception as e:  # one page must not fail the job
            return None, None, 0, str(e)
        best = (text, sure, 0, None)
        if retry and not (sure is not None and sure >= low_confidence):
            for degrees in (90, 180, 270):
                try:
                    text, sure = ocr(prepared(rotated(grayscale(image), degrees), mode, threshold))
                except Exception:  # a try that fails is none
                    continue
                if (-1.0 if sure is None else sure) > (-1.0 if best[1] is None else best[1]):
                    best = (text, sure, degrees, None)
        return best

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [one(*r) for r in zip(f["height"], f["width"], f["channels"], f["pixels"])]
            yield pd.DataFrame({**{c: f[c] for c in by}, "text": [g[0] for g in got], "confidence": [g[1] for g in got],
                    "rotation_degrees": [g[2] for g in got], "error": [g[3] for g in got]})

    return images.select(*by, "height", "width", "channels", "pixels").mapInPandas(run,
        f"{fields}, text string, confidence double, rotation_degrees int, error string")


def corrected(pages: DataFrame, model: Callable[[Column], Column], mode: str, threshold: float, most_chars: int = 100_000) -> DataFrame:
    """``pages`` (page_number, text, confidence) with text corrected by a model where the mode asks for it, raw_text, corrected, warnings and error.

    An answer that is empty, too long or nothing but artifacts leaves the page as it was, with the error.
    """
    asks = needs_correction(mode, F.col("confidence"), threshold) & (X.strip(F.coalesce("text", F.lit(""))) != "")
    prompt = F.concat(F.lit("Correct OCR text from PDF page "), F.col("page_number").cast("string"), F.lit(". Return only corrected text.\n\n"), F.col("text"))
    answered = pages.withColumn("_asks", asks).withColumn("_answer", X.strip(model(F.when(F.col("_asks"), prompt))))
    checked = answered.withColumn("_v", F.when(F.col("_asks") & (F.length("_answer") <= most_chars),
            X.validate(F.col("_answer"), F.length("text"), F.col("text"))))
    where = F.concat(F.lit(" for page "), F.col("page_number").cast("string"))
    error = F.when(~F.col("_asks"), None).when(F.length("_answer") > most_chars,
        F.concat(F.lit("correction is too long"), where)).when(F.coalesce("_v.text", F.lit("")) == "",
        F.concat(F.lit("correction returned empty text"), where))
    good = F.col("_asks") & error.isNull()
    return checked.withColumns({"raw_text": F.when(good, F.col("text")), "corrected": good,
            "warnings": F.when(good, F.col("_v.warnings")).otherwise(F.array().cast("array<string>")), "error": error,
            "text": F.when(good, F.col("_v.text")).otherwise(F.col("text"))}).drop("_asks", "_answer", "_v")


def mock_correction(prompt: Column) -> Column:
    """The deterministic stand-in: the text after the last blank line, on one line."""
    return X.squeeze(F.element_at(F.split(prompt, "\n\n"), -1))
