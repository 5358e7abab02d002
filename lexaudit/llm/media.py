"""Media columns: texts' bytes stored as progressive JPEG, read back through the scans, and RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm._util import small_batches
from lexaudit.llm.jpeg import decode_coefficients, encode_payload, payload_of, to_rgb


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text as UTF-8 filled up with zero bytes to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and the brightness of an 8 x 8 grid against its mean as 16 hex digits."""
    h, w = rgb.shape[:2]
    grid = rgb[:, :, 1].reshape(h, w // 8, 8).sum(axis=2, dtype=np.int64)
    cols = np.add.reduceat(grid, np.arange(8) * (w // 8) // 8, axis=1) if w >= 64 else np.repeat(grid, 8, axis=1)[:, :8]
    cells = np.add.reduceat(cols, np.arange(8) * h // 8, axis=0)
    bits = np.packbits(cells > cells.mean()).tobytes().hex()
    return f"{w}x{h}:" + ",".join(f"{m:.3f}" for m in rgb.reshape(-1, 3).mean(axis=0)) + f":{bits}"


def store_media(docs: DataFrame, *, text: str = "text", tensors: bool = False, keep_media: bool = True) -> DataFrame:
    """docs without text, with n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature.

    With keep_media the stored file is in ``media``; with tensors, ``height``, ``width`` and ``rgb`` hold the
    image of full resolution, row by row.  Columns of those names are replaced.  A null or empty text is 64
    zero bytes; repeated rows are stored one by one; an empty table gives an empty one.  A text may have up
    to 512 MiB.
    """
    small_batches(docs.sparkSession)
    new = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    new |= {"media": "binary"} if keep_media else {}
    new |= {"height": "int", "width": "int", "rgb": "binary"} if tensors else {}
    keep = [c for c in docs.columns if c.lower() not in (*new, text.lower())]
    src = docs.select(*keep, F.col(text).cast("string"))
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {c: [] for c in new}
            for t in b.column(b.num_columns - 1).to_pylist():
                n, payload = padded(t)
                media = encode_payload(payload)
                image = decode_coefficients(media)
                back, rgb = payload_of(image), to_rgb(image)
                got = {"n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature_of(rgb), "media": media, "height": rgb.shape[0], "width": rgb.shape[1]}
                if tensors:
                    got["rgb"] = rgb.tobytes()
                for c in new:
                    rows[c].append(got[c])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(rows[c], types[k]) for c, k in new.items())], [*keep, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), *(f"{c} {k}" for c, k in new.items())])
    return src.mapInArrow(run, schema)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_media=False)
