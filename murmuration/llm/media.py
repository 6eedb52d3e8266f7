"""Media columns: texts stored as baseline JPEG files, read back, with features."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import jpeg
from .common import slices_by_bytes, texts_of


def store_media(docs: DataFrame, path: str) -> None:
    """Write ``doc_id, n_bytes, media`` for every row at ``path``.

    A text's UTF-8 bytes, filled with spaces to a positive multiple of 192,
    are one JPEG file in the ``media`` column. One narrow pass. Null and empty
    texts are one unit of spaces; null doc_ids and repeated rows are stored
    like others, an empty table is stored empty, and further columns are left
    out. A very long text is one file, made in one piece.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for a, b in slices_by_bytes(offsets, 2 << 20):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
                files = jpeg.encode([t + b" " * (-len(t) % jpeg.UNIT if t else jpeg.UNIT) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary").write.parquet(path)


def media_features(media: DataFrame, slice_bytes: int = 2 << 20) -> DataFrame:
    """Decode a ``media`` column of JPEG files: payload digests, dimensions, thumbnail hash.

    ``feature`` is ``width x height : sha256 of the DC-only luminance
    thumbnail`` (first 16 hex digits) and its 64-bit average hash. Only bytes
    read from the column enter, so equal files have equal features. A null
    file gives null columns; a file that is no baseline JPEG does too, and says
    why in ``error``. Null doc_ids and repeated rows are rows like others, an
    empty table gives none, and further columns are not read.
    """
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            files = table.column("media").to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(f or b"") for f in files])]).astype(np.int64)
            for a, b in slices_by_bytes(offsets, slice_bytes):
                real, images, wrong = [], [], {}
                for i in range(a, b):
                    if files[i] is not None:
                        try:
                            images.append(jpeg.parse(files[i]))
                            real.append(i)
                        except (ValueError, IndexError) as e:
                            wrong[i] = str(e) or type(e).__name__
                rows = {}
                for i, image, values in zip(real, images, jpeg.coefficients(images), strict=True):
                    payload = jpeg.payload_of(image, values)
                    small = jpeg.thumbnail(image, values)
                    rows[i] = (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(files[i]),
                        hashlib.sha256(files[i]).hexdigest(),
                        f"{image.width}x{image.height}:{hashlib.sha256(small.tobytes()).hexdigest()[:16]}:{average_hash(small):016x}",
                    )
                columns = list(zip(*[rows.get(i, (None,) * 6) for i in range(a, b)], strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                part = table.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").combine_chunks(), part.column("n_bytes").combine_chunks(), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], pa.array([wrong.get(i) for i in range(a, b)], pa.string())],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"],
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string",
    )


def average_hash(pixels: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are brighter than the mean."""
    rows = np.arange(8) * pixels.shape[0] // 8
    columns = np.arange(8) * pixels.shape[1] // 8
    grid = pixels[np.ix_(rows, columns)].astype(np.int64)
    bits = (grid * 64 > grid.sum()).reshape(-1)
    return int("".join("1" if x else "0" for x in bits), 2)
