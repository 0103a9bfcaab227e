"""Typed reading of files: kind by leading bytes, text and CSV content, headers, chunks, keyword flags."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scope

# Leading bytes (hex) of file kinds, brands of ISO media files, folders of office archives, families of kinds and of name endings.
SIGNATURES = {"25504446": "pdf", "504B0304": "zip", "89504E47": "png", "FFD8FF": "jpeg", "47494638": "gif", "424D": "bmp", "49492A00": "tiff", "4D4D002A": "tiff", "D0CF11E0": "ole", "52617221": "rar", "1F8B": "gzip", "41433130": "dwg"}
BRANDS = {"heic": ("heic", "heix", "hevc", "hevx", "heim", "heis", "hevm", "hevs", "mif1", "msf1"), "avif": ("avif", "avis")}
OFFICE = {"word/": "docx", "xl/": "xlsx", "ppt/": "pptx"}
KIND_FAMILIES = {"pdf": ("pdf",), "image": ("png", "jpeg", "gif", "bmp", "tiff", "webp", "heic", "avif"), "sheet": ("xlsx",), "doc": ("docx", "pptx"), "cad": ("dwg",)}
NAME_FAMILIES = {
    "pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "tif", "webp", "heic", "heif", "avif"),
    "sheet": ("xlsx", "xls", "csv"), "doc": ("docx", "doc", "pptx", "ppt"), "cad": ("dwg", "dxf", "rvt", "skp"),
}
FINANCIAL = ("工资", "薪资", "财务", "预算", "决算", "成本", "营收", "利润")
DRAWING = ("图纸", "施工图", "结构图", "竣工图", "图号")
CHUNK, CHUNKS = 1800, 10
HEADERS, HEADER_CHARS = 20, 200


def kind(content: Column) -> Column:
    """pdf, docx, heic, ... by the leading bytes, for archives by what they list; text where they look like text; else unknown."""
    head, mark = F.hex(F.substring(content, 1, 8)), F.hex(F.substring(content, 9, 4))
    found = [F.when(head.startswith(sign), F.lit(name)) for sign, name in SIGNATURES.items() if name != "zip"]
    zipped = head.startswith(next(sign for sign, name in SIGNATURES.items() if name == "zip"))
    found.append(F.when(zipped, archive_kind(F.when(zipped, content))))
    found.append(F.when(head.startswith(b"RIFF".hex().upper()) & (mark == b"WEBP".hex().upper()), "webp"))
    for name, brands in BRANDS.items():
        found.append(F.when((F.substring(head, 9, 8) == b"ftyp".hex().upper()) & mark.isin([b.encode().hex().upper() for b in brands]), name))
    return F.coalesce(*found, F.when(looks_textual(content), "text").otherwise("unknown"))


def _family(c: Column, families: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*(F.when(F.lower(c).isin(*names), F.lit(f)) for f, names in families.items()))


def mismatch(ext: Column, found: Column) -> Column:
    """Does the file's name promise another family than its bytes show? Endings of no family promise text; kinds of none are no evidence."""
    return F.coalesce(_family(found, KIND_FAMILIES) != F.coalesce(_family(ext, NAME_FAMILIES), F.lit("text")), F.lit(False))


@F.pandas_udf(T.StringType())
def archive_kind(content: pd.Series) -> pd.Series:
    """docx, xlsx or pptx by a folder in the archive's listing; zip for others and broken ones; null for null."""

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                names = z.namelist()
        except (zipfile.BadZipFile, ValueError, NotImplementedError):
            return "zip"
        return next((k for folder, k in OFFICE.items() if any(n.startswith(folder) for n in names)), "zip")

    return content.map(one)


@F.pandas_udf(T.BooleanType())
def looks_textual(content: pd.Series) -> pd.Series:
    """No NUL in the first 4096 bytes, and at most 5 % of them outside valid UTF-8."""

    def one(data: bytes | None) -> bool:
        head = bytes(data or b"")[:4096]
        return b"\0" not in head and head.decode("utf-8", "replace").count("�") <= 0.05 * max(1, len(head))

    return content.map(one)


def _rows(text: str, most: int) -> list[list[str]]:
    return [r for r, _ in zip((r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)), range(most))]


def header_row(rows: list[list[str]]) -> list[str]:
    """Header among the first five rows: with a financial word, or three cells, or two in the first; a lone title is skipped."""
    for n, row in enumerate(rows[:5]):
        cells = [c.strip() for c in row if c.strip()]
        if any(w in c for w in FINANCIAL for c in cells) and len(cells) > 1 or len(cells) >= 3 or (n == 0 and len(cells) >= 2):
            return [c[:HEADER_CHARS] for c in cells[:HEADERS]]
    return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def csv_headers(text: pd.Series) -> pd.Series:
    return text.map(lambda t: header_row(_rows(t or "", 5)))


def inspected(files: DataFrame) -> DataFrame:
    """name, ext, kind, mismatch, text, headers, chunks and flags of files (path, content). Only text is read as text."""
    rows = files.select(F.substring_index("path", "/", -1).alias("name"), "content").withColumn("ext", F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)))
    rows = rows.withColumn("kind", kind(F.col("content")))
    text = F.when(F.col("kind") == "text", F.make_valid_utf8(F.col("content").cast("string"))).otherwise("")
    rows = rows.withColumn("text", text)
    flag = lambda words: F.col("text").rlike("|".join(words))
    return rows.select(
        "name", "ext", "kind", mismatch(F.col("ext"), F.col("kind")).alias("mismatch"), "text", F.when(F.col("ext") == "csv", csv_headers(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("headers"),
        scope.chunks(F.col("text"), CHUNK, CHUNKS).alias("chunks"), flag(FINANCIAL).alias("financial"), flag(DRAWING).alias("drawing"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return inspected(spark.read.format("binaryFile").load(path).select("path", "content"))
