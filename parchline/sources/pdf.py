"""Structure of PDF files without a renderer: pages, their sizes, and image streams with their filters.

Objects are found where they stand in the file, also within compressed object streams, so damaged cross-reference tables do no harm. Files are
read whole by executors, parsed in Arrow batches, and what cannot be read is told in ``errors`` and never ends a job."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)(?:\bendobj\b|\bstream\r?\n(.*?)\bendstream\b)", re.S)
_NAME = rb"/%s\s*/([^\s/<>\[\]()]+)"
_SIZE = re.compile(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s*\]")

SCHEMA = "path string, n_pages int, width_pt double, height_pt double, images array<struct<width_px: int, height_px: int, bpc: int, filter: string>>, errors array<string>"


def _value(body: bytes, key: bytes) -> bytes | None:
    m = re.search(_NAME % key, body)
    return m.group(1) if m else None


def _number(body: bytes, key: bytes) -> int | None:
    m = re.search(rb"/%s\s+(\d+)(?!\s+\d+\s+R)" % key, body)
    return int(m.group(1)) if m else None


def objects(data: bytes, errors: list[str]) -> dict[int, bytes]:
    """Dictionaries by object number; of an object that occurs again, the last."""
    out: dict[int, bytes] = {}
    for m in _OBJECT.finditer(data):
        number, body, stream = int(m.group(1)), m.group(2), m.group(3)
        out[number] = body
        if stream is not None and _value(body, b"Type") == b"ObjStm":
            try:
                plain = zlib.decompressobj().decompress(stream) if b"/FlateDecode" in body else stream
                first, n = _number(body, b"First") or 0, _number(body, b"N") or 0
                index = [int(x) for x in plain[:first].split()[: 2 * n]]
                ends = [*index[3::2], len(plain) - first]
                for k, (a, b) in enumerate(zip(index[1::2], ends, strict=True)):
                    out[index[2 * k]] = plain[first + a : first + b]
            except (ValueError, zlib.error) as e:
                errors.append(f"object stream {number}: {e}")
    return out


def scan(data: bytes | None) -> tuple[int | None, float | None, float | None, list[dict], list[str]]:
    """(pages, width and height of the first page box, images, errors) of a file's bytes; no pages where it is no PDF."""
    errors: list[str] = []
    if not data or b"%PDF-" not in data[:1024]:
        return None, None, None, [], ["no PDF header"]
    found = objects(data, errors)
    pages = sum(_value(b, b"Type") == b"Page" for b in found.values())
    boxes = [m for b in found.values() if (m := _SIZE.search(b))]
    wide, high = (abs(float(boxes[0].group(k + 2)) - float(boxes[0].group(k))) for k in (1, 2)) if boxes else (None, None)
    images = []
    for b in found.values():
        if _value(b, b"Subtype") == b"Image":
            f = re.search(rb"/Filter\s*(\[[^\]]*\]|/[^\s/<>\[\]()]+)", b)
            images.append({"width_px": _number(b, b"Width"), "height_px": _number(b, b"Height"), "bpc": _number(b, b"BitsPerComponent"), "filter": f.group(1).decode("latin-1") if f else None})
    if not pages:
        errors.append("no page objects")
    return pages, wide, high, images, errors


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """The columns of ``SCHEMA`` for every file below ``path``."""
    return scanned(spark.read.format("binaryFile").load(path).select("path", "content"))


def scanned(files: DataFrame) -> DataFrame:
    """Files (path, content) with what ``scan`` finds in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = pa.list_(pa.struct([("width_px", pa.int32()), ("height_px", pa.int32()), ("bpc", pa.int32()), ("filter", pa.string())]))
        types = [pa.int32(), pa.float64(), pa.float64(), image, pa.list_(pa.string())]
        for b in batches:
            rows = [scan(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=["path", "n_pages", "width_pt", "height_pt", "images", "errors"])

    return files.mapInArrow(run, SCHEMA)
