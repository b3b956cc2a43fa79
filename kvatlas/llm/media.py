"""Media columns: baseline JPEG images in a binary column, their dimensions and thumbnail hashes.

``store_texts`` writes one image for each text to the shared folder; ``media_features`` decodes any column
of baseline images. Bytes are decoded in slices of bounded size, so memory doesn't grow with a task's rows; a single
large text needs about seven times its own size (see jpeg).

Results for odd input: a null text is stored as an empty one, and an empty one as one block of 64 zero
bytes; long texts only make tall images; repeated rows are stored once each; an empty table gives an empty
result; a null image, or bytes that aren't a baseline image, give a row with nulls and the fault in
``error``. Extra columns are left out, so names can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvatlas.llm import jpeg
from kvatlas.llm.shared import stored, table

SLICE_BYTES = 1 << 20
FEATURES = (
    "doc_id long, n_bytes long, width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, error string"
)


def _slices(items: list, size) -> Iterator[slice]:
    start = total = 0
    for i, x in enumerate(items):
        if total and total + size(x) > SLICE_BYTES:
            yield slice(start, i)
            start, total = i, 0
        total += size(x)
    if items:
        yield slice(start, len(items))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: read back from the written table."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"]]
            for part in _slices(texts, len):
                own = texts[part]
                media = jpeg.encode_payloads([t + bytes((-len(t) % 64) or (0 if t else 64)) for t in own])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].astype("Int64"), "n_bytes": [len(t) for t in own], "media": media})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInPandas(encode, "doc_id long, n_bytes long, media binary"), "media")


def _features(images: list[bytes | None]) -> list[tuple]:
    """width, height, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error."""
    parsed: list = []
    for data in images:
        try:
            parsed.append(jpeg.parse(data) if data is not None else ValueError("null"))
        except (ValueError, IndexError, KeyError) as e:
            parsed.append(e)
    good = [m for m in parsed if isinstance(m, jpeg.Image)]
    try:
        decoded = jpeg.decode(good)
    except (ValueError, IndexError, KeyError):
        if len(images) > 1:  # one bad image must not spoil its slice
            return [row for data in images for row in _features([data])]
        parsed, decoded = [ValueError("the scan can't be decoded")], []
    found = iter(decoded)
    out = []
    for data, m in zip(images, parsed, strict=True):
        sums = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
        if not isinstance(m, jpeg.Image):
            out.append((None, None, None, None, None, *sums, None, str(m)))
            continue
        coefficients = next(found)
        feature = f"{m.width}x{m.height}:{jpeg.average_hash(jpeg.thumbnail(m, coefficients)):016x}"
        payload = (None, None, None)
        if m.comment.startswith(b"bytes="):  # an image of ours
            values = coefficients[next(iter(m.components))]
            raw = jpeg.BYTE[values.ravel() + 256].tobytes()[: int(m.comment[6:])]
            payload = (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        out.append((m.width, m.height, *payload, *sums, feature, None))
    return out


def media_features(media: DataFrame) -> DataFrame:
    """Decode ``media`` (doc_id, n_bytes, media): see FEATURES."""
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            images = [None if x is None else bytes(x) for x in batch["media"]]
            for part in _slices(images, lambda x: len(x or b"")):
                out = pd.DataFrame(_features(images[part]), columns=names[2:], dtype=object)
                out.insert(0, "n_bytes", batch["n_bytes"].iloc[part].to_numpy())
                out.insert(0, "doc_id", batch["doc_id"].iloc[part].astype("Int64").to_numpy(dtype=object, na_value=None))
                yield out

    return media.select("doc_id", "n_bytes", "media").mapInPandas(decode, FEATURES)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_texts(table(spark, sf_dir, "documents"))).drop("error")
