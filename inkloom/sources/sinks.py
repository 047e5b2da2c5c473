"""What leaves the archive as files: Arrow streams of frames, copies of page images, checked texts, encoded images.

Files of single pages are written where their rows are, straight to the shared file system, through a name of their own
and a rename, so that a task that is repeated writes the same file again.
"""

from __future__ import annotations

import base64
import io
import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import stem


def local(path: str) -> str:
    """A path of the shared file system as executors open it; other schemes are an error."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: single files are written to a mounted file system")
    return path.removeprefix("file://").removeprefix("file:")


def put(path: str, data: bytes) -> None:
    at = Path(local(path))
    at.parent.mkdir(parents=True, exist_ok=True)
    part = at.with_name(f".{at.name}.{os.getpid()}")
    part.write_bytes(data)
    part.replace(at)


def arrow_file(df: DataFrame) -> Iterator[bytes]:
    """The frame as one Arrow IPC file, piece by piece; batches come to the driver one after another, never all."""
    buffer = io.BytesIO()
    schema = df.limit(0).toArrow().schema
    sent = 0
    with pa.ipc.new_file(buffer, schema) as writer:
        rows: list = []

        def batch() -> None:
            writer.write_table(pa.Table.from_pylist(rows, schema=schema))
            rows.clear()

        for r in df.toLocalIterator(prefetchPartitions=True):
            rows.append(r.asDict(recursive=True))
            if len(rows) == 10_000:
                batch()
                data = buffer.getvalue()
                yield data[sent:]
                sent = len(data)
        if rows:
            batch()
    yield buffer.getvalue()[sent:]


def _write(df: DataFrame, column: str, folder: str) -> DataFrame:
    """df(name, <column>) written as files of a folder; gives (name, size) of each."""

    def run(batches):
        for b in batches:
            data = [x.encode() if isinstance(x, str) else bytes(x) for x in b[column]]
            for name, x in zip(b["name"], data):
                put(f"{folder}/{name}", x)
            yield pd.DataFrame({"name": b["name"], "size": [len(x) for x in data]})

    return df.select("name", column).mapInPandas(run, "name string, size bigint")


def copy_images(pages: DataFrame, out: str, processed: str | None = None) -> int:
    """Copies each page's image to out/images/<page_id>.jpg, the processed one where there is one, else the original;
    pages whose file is missing are left out. Gives the number of images."""

    def run(batches):
        for b in batches:
            done = []
            for page, source in zip(b["page_id"], b["source_path"]):
                tries = ([f"{processed}/{page}.jpg"] if processed else []) + ([local(source)] if isinstance(source, str) else [])
                at = next((x for x in tries if os.path.exists(local(x))), None)
                if at:
                    put(f"{out}/images/{page}.jpg", Path(local(at)).read_bytes())
                    done.append(page)
            yield pd.DataFrame({"page_id": done}, dtype=object)

    one = pages.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("source_path").alias("source_path"))
    return one.mapInPandas(run, "page_id string").count()


def promote(letters: DataFrame, pages: DataFrame, folder: str) -> int:
    """Writes each reviewed page's text to <folder>/<file name>.txt; gives their number. Pages that aren't registered are
    left out; of several files for one page the last by name gives the name."""
    p = pages.groupBy("page_id").agg(F.max(stem(F.col("filename"))).alias("stem"))
    r = letters.where("text_source = 'reviewed' AND text_final IS NOT NULL").groupBy("page_id").agg(F.max("text_final").alias("t"))
    out = r.join(p, "page_id").where("stem IS NOT NULL").select(F.concat("stem", F.lit(".txt")).alias("name"), F.concat("t", F.lit("\n")).alias("text"))
    return _write(out, "text", folder).count()


def png(image: np.ndarray) -> bytes:
    """A grey or RGB image of bytes as PNG."""
    x = np.ascontiguousarray(image, np.uint8)
    h, w = x.shape[:2]
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), x.reshape(h, -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if x.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def encode(image: np.ndarray, quality: int = 92) -> tuple[bytes, str]:
    """(bytes, media type) of a grey or RGB image: JPEG where an encoder is installed, else PNG."""
    try:
        from PIL import Image
    except ImportError:
        return png(image), "image/png"
    buffer = io.BytesIO()
    Image.fromarray(np.ascontiguousarray(image, np.uint8)).save(buffer, format="JPEG", quality=quality)
    return buffer.getvalue(), "image/jpeg"


def encode_image(image: np.ndarray, max_side: int = 2200, quality: int = 90) -> tuple[str, str]:
    """(base64, media type) of an image whose longer side is at most max_side, for a model's message."""
    from inkloom.operators.images import resize_long_side

    if max(image.shape[:2]) > max_side:
        image = resize_long_side(image, max_side)
    data, kind = encode(image, quality)
    return base64.b64encode(data).decode("ascii"), kind


def write_processed(processed: DataFrame, folder: str) -> int:
    """Writes preprocessed images (name, data) to a folder; gives their number."""
    return _write(processed, "data", folder).count()
