"""PDF and image ingestion. Extractors are plug-ins; without their libraries they raise a clear error."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import normalize as N
from lexloom.functions import predicates as P
from lexloom.sources.documents import join_pages, page_text

# File kinds by extension, and the recogniser's settings.
PDF, IMAGES = (".pdf",), (".png", ".jpg", ".jpeg", ".tiff", ".bmp")
RECOGNISER_PATHS = ("/usr/bin/tesseract", "/usr/local/bin/tesseract", "/opt/homebrew/bin/tesseract")
OCR_SETTINGS = "--oem 3 --psm 6 -c preserve_interword_spaces=1"


class MissingLibrary(RuntimeError):
    """An extractor's library isn't installed."""


def need(*modules: str) -> None:
    gone = [m for m in modules if importlib.util.find_spec(m) is None]
    if gone:
        raise MissingLibrary(f"this extractor needs {', '.join(gone)}")


@dataclass(frozen=True)
class PdfExtractor:
    """(native text, recognised text) of each page; recognition runs only where the native text is no valid text."""

    dpi: int = 200
    prefer_native: bool = True

    def __call__(self, content: bytes) -> list[tuple[str, str | None]]:
        need("fitz")
        import fitz

        out = []
        with fitz.open(stream=content, filetype="pdf") as pdf:
            for page in pdf:
                native = page.get_text("text").strip() if self.prefer_native else ""
                enough = len(native) >= 50 and sum(c in "aeiouAEIOU" for c in native) >= 0.05 * len(native)
                out.append((native, None if enough else recognise(page.get_pixmap(dpi=self.dpi).tobytes("png"))))
        return out


@dataclass(frozen=True)
class ImageExtractor:
    def __call__(self, content: bytes) -> list[tuple[str, str | None]]:
        return [("", recognise(content))]


def recogniser_path(paths: tuple[str, ...] = RECOGNISER_PATHS) -> str | None:
    """The first of these programs that a worker has."""
    return next((p for p in paths if os.path.exists(p)), None)


def recognise(image: bytes) -> str:
    """Text of an image: grey, contrast and sharpness doubled, then recognised."""
    need("PIL", "pytesseract")
    import io

    import pytesseract
    from PIL import Image, ImageEnhance

    if path := recogniser_path():
        pytesseract.pytesseract.tesseract_cmd = path
    picture = Image.open(io.BytesIO(image)).convert("L")
    picture = ImageEnhance.Sharpness(ImageEnhance.Contrast(picture).enhance(2)).enhance(2)
    return pytesseract.image_to_string(picture, config=OCR_SETTINGS)


def kind_of(path: Column) -> Column:
    low = F.lower(path)
    ends = lambda xs: F.lit(False) if not xs else ends(xs[:-1]) | low.endswith(xs[-1])
    return F.when(ends(PDF), "pdf").when(ends(IMAGES), "image")


def local_path(url: str) -> str:
    """file:/// URLs as plain paths, escapes undone."""
    return unquote(url.removeprefix("file://")) if url.startswith("file://") else url


def extract_pages(files: DataFrame, extractors: dict[str, Callable[[bytes], list[tuple[str, str | None]]]] | None = None) -> DataFrame:
    """(path, page, native, recognised) of binary files; other extensions fail, unreadable files give no page."""
    extractors = extractors or {"pdf": PdfExtractor(), "image": ImageExtractor()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, kind in zip(pdf["path"], pdf["content"], pdf["kind"], strict=True):
                if kind is None:
                    raise ValueError(f"unsupported file type: {path}")
                try:
                    found = extractors[kind](bytes(content))
                except MissingLibrary:
                    raise
                except Exception:  # a file that can't be read has no text
                    found = []
                rows += [(path, i, a, b) for i, (a, b) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "page", "native", "recognised"])

    return files.select("path", "content", kind_of(F.col("path")).alias("kind")).mapInPandas(run, "path string, page int, native string, recognised string")


def _recognised(files: DataFrame, extractors, ocr_fix: bool) -> DataFrame:
    """(path, modificationTime, length, text) of files with their content."""
    told = ["path", "modificationTime", "length"]
    pages = extract_pages(files, extractors).withColumn("text", page_text(F.col("native"), F.col("recognised")))
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    whole = pages.groupBy("path").agg(join_pages(F.transform(ordered, lambda p: p["text"])).alias("text"))
    every = files.select(*told).join(whole, "path", "left").withColumn("text", F.coalesce("text", F.lit("")))
    cleaned = N.ocr_clean(F.col("text"))
    return every.select(*told, (N.glyphs(cleaned) if ocr_fix else cleaned).alias("text"))


def read_binary(spark: SparkSession, path: str, extractors=None, ocr_fix: bool = True, cache: str | None = None) -> DataFrame:
    """(path, text, low_quality) of PDF and image files: valid native page text or else recognised, cleaned and corrected.

    cache: a folder that keeps texts by path, time of change and length. Only files that are not there are opened
    and recognised; an empty text is not kept, so such a file is tried again. The names of those files pass
    through the driver, which lists the folder anyway.
    """
    load = lambda at: spark.read.format("binaryFile").load(at).select("path", "modificationTime", "length", "content")
    place = local_path(path)
    low = ~P.text_valid(F.col("text"))
    if cache is None:
        return _recognised(load(place), extractors, ocr_fix).select("path", "text").withColumn("low_quality", low)
    key = ["path", "modificationTime", "length"]
    held = spark.read.format("binaryFile").load(place).select(*key)
    shape = "path string, modificationTime timestamp, length bigint, text string"
    root = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    known = spark.read.schema(shape).parquet(cache) if there else spark.createDataFrame([], shape)
    new = [r["path"] for r in held.join(known.select(*key), key, "left_anti").select("path").toLocalIterator()]
    if new:
        _recognised(load(new), extractors, ocr_fix).filter("text <> ''").write.mode("append").parquet(cache)
        known = spark.read.schema(shape).parquet(cache) if there or root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root) else known
    texts = known.groupBy(*key).agg(F.min("text").alias("text"))
    return held.join(texts, key, "left").select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("low_quality", low)
