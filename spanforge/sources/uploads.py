"""Uploaded files: kind, limits, signatures; paragraphs of DOCX files. Zip contents need Python, the rest is native."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMITS = {"text": 512_000, "pdf": 25 << 20, "docx": 10 << 20, "image": 15 << 20}
KINDS = {".txt": "text", ".pdf": "pdf", ".docx": "docx", ".png": "image", ".jpg": "image", ".jpeg": "image"}
SIGNATURES = {".pdf": b"%PDF-", ".docx": b"PK", ".png": b"\x89PNG\r\n\x1a\n", ".jpg": b"\xff\xd8\xff", ".jpeg": b"\xff\xd8\xff"}
MOST_PIXELS = 40_000_000
ROUTES = {"text": "text", "pdf": "pdf_pages", "docx": "docx_text", "image": "ocr"}


def _pick(extension: Column, table: dict) -> Column:
    return F.coalesce(*[F.when(extension == k, F.lit(v)) for k, v in table.items()])


#: Segments of a JPEG that are walked at most on the way to its frame header.
JPEG_SEGMENTS = 4096
_FRAME = [f"FFC{x}" for x in "01235679ABDEF"]  # all but C4, C8 and CC


def jpeg_size(content: Column) -> Column:
    """(width, height) from a JPEG's frame header; null if the walk over its segments doesn't reach one.

    A fold over the segments, each a marker and a length that leads to the next: only their headers are read."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 2)), 16, 10).cast("int")
    at = lambda s: s["at"]
    state = lambda pos, w, h, over: F.struct(pos.cast("int").alias("at"), w.cast("int").alias("width"), h.cast("int").alias("height"), over.alias("over"))
    null, no, yes = F.lit(None), F.lit(False), F.lit(True)

    def step(s: Column, _: Column) -> Column:
        mark = F.hex(F.substring(content, at(s), 2))
        size = number(at(s) + 2)
        return (
            F.when(s["over"], s)
            .when(mark == "FFFF", state(at(s) + 1, null, null, no))  # fill
            .when(mark.isin("FF01", *[f"FFD{i}" for i in range(8)]), state(at(s) + 2, null, null, no))
            .when(mark.isin(*_FRAME), state(at(s), number(at(s) + 7), number(at(s) + 5), yes))
            .when(~F.coalesce(mark.rlike("^FF[0-9A-F]{2}$"), no) | mark.isin("FFD8", "FFD9", "FFDA") | (F.coalesce(size, F.lit(0)) < 2), state(at(s), null, null, yes))
            .otherwise(state(at(s) + 2 + size, null, null, no))
        )

    begin = state(F.lit(3), null, null, ~F.coalesce(F.hex(F.substring(content, 1, 2)) == "FFD8", no))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(JPEG_SEGMENTS)), begin, step)
    found = lambda s: F.when((s["width"] > 0) & (s["height"] > 0), F.struct(s["width"].alias("width"), s["height"].alias("height")))
    return F.get(F.transform(F.array(end), found), F.lit(0))


def inspected(files: DataFrame) -> DataFrame:
    """files (path, length, content) -> kind, extension, size_bytes, route and error."""
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    kind = _pick(ext, KINDS)
    signed = F.coalesce(*[F.when(ext == k, F.substring("content", 1, len(v)) == F.lit(v)) for k, v in SIGNATURES.items()], F.lit(True))
    side = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    png = F.when((ext == ".png") & (F.col("length") >= 24) & (F.substring("content", 13, 4) == F.lit(b"IHDR")), F.struct(side(17).alias("width"), side(21).alias("height")))
    # folded over only where it is a JPEG and small enough
    jpeg = F.when(ext.isin(".jpg", ".jpeg") & signed & (F.col("length") <= LIMITS["image"]), jpeg_size(F.col("content")))
    files = files.withColumn("__size", F.coalesce(png, jpeg.cast("struct<width:bigint,height:bigint>")))
    pixels = F.col("__size.width") * F.col("__size.height")
    error = (
        F.when(kind.isNull(), "unsupported file type").when(F.col("length") == 0, "the file is empty").when(F.col("length") > _pick(kind, LIMITS), "the file is too large")
        .when(~signed, "the content does not match the extension").when((kind == "image") & ~F.coalesce(pixels > 0, F.lit(False)), "the image has no readable size").when(pixels > MOST_PIXELS, "the image has too many pixels")
    )
    return files.select("path", kind.alias("kind"), ext.alias("extension"), F.col("length").alias("size_bytes"), _pick(kind, ROUTES).alias("route"), error.alias("error"), "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    return inspected(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


#: Inflated bytes of a DOCX body at most; larger ones count as damaged.
DOCX_INNER = 200 << 20


def docx_read(content: Column) -> Column:
    """text (paragraphs of a DOCX file joined by blank lines) and error: why there is none. One of them is null."""

    @F.pandas_udf("text string, error string")
    def paragraphs(s: pd.Series) -> pd.DataFrame:
        import io
        import zipfile
        import zlib
        from xml.etree import ElementTree

        word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

        def one(data):
            try:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    if "[Content_Types].xml" not in z.namelist() or "word/document.xml" not in z.namelist():
                        return None, "the archive is not a Word document"
                    with z.open("word/document.xml") as member:
                        inner = member.read(DOCX_INNER + 1)
                    if len(inner) > DOCX_INNER:
                        return None, "the document is too large when unpacked"
                    root = ElementTree.fromstring(inner)
            except RuntimeError:
                return None, "the document is encrypted"
            except (zipfile.BadZipFile, zlib.error, KeyError, TypeError, ValueError, EOFError, NotImplementedError, ElementTree.ParseError):
                return None, "the document is damaged or unreadable"
            text = ("".join(t.text or "" for t in p.iter(f"{word}t")).strip() for p in root.iter(f"{word}p"))
            joined = "\n\n".join(t for t in text if t).strip()
            return (joined, None) if joined else (None, "the document contains no extractable text")

        return pd.DataFrame([one(x) for x in s], columns=["text", "error"])

    return paragraphs(content)


def docx_text(content: Column) -> Column:
    """Paragraphs of a DOCX file joined by blank lines; null if it is not one or has no text."""
    return docx_read(content)["text"]
