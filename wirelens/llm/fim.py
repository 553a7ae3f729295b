"""Fill-in-the-middle over seekable compressed frames.

``store`` keeps a text as independent zstandard frames of about ``FRAME_BYTES``,
cut at line ends where a line is not longer than that, with the number of units
(lines) that end before each frame. ``transform`` looks a cut up in these
numbers, decompresses only the frame that holds it and makes two of it; all
other frames change places as they are. ``restore`` finds the parts of an output
by its markers and puts the frames back in order. ``digests`` streams the frames
of both orders through SHA-256, one decompressed frame at a time.

A unit is ``[^\\n]*\\n|[^\\n]+``. The cuts, the form and whether a text is
transformed come from the SHA-256 of ``<seed>:<doc_id>``, so a text's form never
depends on the rows around it. A text with one of the markers in it stays plain:
its output could not be told apart again.

All steps work row by row and need no shuffle; the stored table is written once
to the shared folder. A row's memory is its text and its compressed frames.

Defined results: NULL and empty texts have no units, no frames and stay plain
(the digest is that of no bytes); a NULL doc_id is hashed as ``<seed>:``;
repeated rows give equal rows; empty tables work; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.frames import columns, cut

#: Bytes of text in a frame; a frame ends early at a line end.
FRAME_BYTES = 64 << 10
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The parts of an output in order, each after its marker.
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

FRAME = pa.struct([("first_unit", pa.int64()), ("units", pa.int32()), ("chars", pa.int32()), ("data", pa.binary())])
FRAMES_DDL = "frames array<struct<first_unit:bigint,units:int,chars:int,data:binary>>"


def _chars(data: bytes) -> int:
    """Code points: bytes that don't continue one."""
    import numpy as np

    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


class Codec:
    """Frames of a text; a frame is (units before it, units that end in it, code points, compressed bytes)."""

    def __init__(self):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.unpack = zstandard.ZstdDecompressor().decompress

    def frame(self, first: int, units: int, data: bytes) -> tuple[int, int, int, bytes]:
        return first, units, _chars(data), self.pack(data)

    def frames(self, data: bytes, size: int) -> list[tuple[int, int, int, bytes]]:
        out, at, first = [], 0, 0
        while at < len(data):
            end = len(data)
            if end - at > size:
                end = data.rfind(b"\n", at, at + size) + 1
                if not end:
                    end = at + size
                    while end > at + 1 and data[end] & 0xC0 == 0x80:
                        end -= 1
            part = data[at:end]
            units = part.count(b"\n") + (end == len(data) and part[-1:] != b"\n")
            out.append(self.frame(first, units, part))
            at, first = end, first + units
        return out

    def split(self, frames: list[tuple], k: int) -> tuple[list[tuple], list[tuple]]:
        """The frames up to the end of unit ``k`` and those after it; at most one is decompressed."""
        import numpy as np

        if k == 0:
            return [], frames
        j = bisect_left(frames, k, key=lambda f: f[0] + f[1])
        first, units, _, packed = frames[j]
        if k == first + units:
            # the last unit of a frame ends with the frame, unless a part of the next line follows
            data = self.unpack(packed) if j + 1 < len(frames) else b""
            end = data.rfind(b"\n") + 1
            if end == len(data):
                return frames[: j + 1], frames[j + 1 :]
        else:
            data = self.unpack(packed)
            end = int(np.flatnonzero(np.frombuffer(data, np.uint8) == 10)[k - first - 1]) + 1
        left, right = self.frame(first, k - first, data[:end]), self.frame(k, first + units - k, data[end:])
        return [*frames[:j], left], [right, *frames[j + 1 :]]


def _schema(like: DataFrame, *ddl: str) -> T.StructType:
    """``like``'s doc_id, whatever its type, and further columns."""
    return T.StructType([like.schema["doc_id"], *T.StructType.fromDDL(", ".join(ddl)).fields])


def _tuples(cell: pa.Scalar) -> list[tuple]:
    return [tuple(f.values()) for f in cell.as_py() or []]


def _lists(rows: list[list[tuple]]) -> pa.Array:
    names = [f.name for f in FRAME]
    return pa.array([[dict(zip(names, f, strict=True)) for f in row] for row in rows], pa.list_(FRAME))


def store(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """doc_id, units, chars, marked (a marker occurs in the text), frames of every row of ``docs`` (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            rows, marked = [], []
            for cell in batch.column(1):
                data = cell.as_py() or b""
                rows.append(codec.frames(data, frame_bytes))
                marked.append(any(m in data for m in (PREFIX, SUFFIX, MIDDLE)))
            units = pa.array([r[-1][0] + r[-1][1] if r else 0 for r in rows], pa.int64())
            chars = pa.array([sum(f[2] for f in r) for r in rows], pa.int64())
            arrays = [batch.column(0), units, chars, pa.array(marked, pa.bool_()), _lists(rows)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "units", "chars", "marked", "frames"])

    rows = columns(docs, "doc_id", "text")
    return rows.select("doc_id", F.col("text").cast("binary")).mapInArrow(work, _schema(rows, "units long, chars long, marked boolean", FRAMES_DDL))


def transform(stored: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and the output's frames of every stored text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    cuts = [h[i] % (F.col("units") + 1) for i in (0, 1)]
    plain = (F.col("chars") == 0) | F.col("marked") | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    planned = stored.select("doc_id", "units", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"), "frames")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        marks = {m: codec.frame(0, 0, m) for m in ORDERS["psm"]}
        for batch in batches:
            sizes, rows = [], []
            for form, a, b, cell in zip(*[c.to_pylist() for c in batch.columns[2:5]], batch.column(5), strict=True):
                frames = _tuples(cell)
                if form == "plain":
                    sizes.append((None, None))
                    rows.append(frames)
                    continue
                front, suffix = codec.split(frames, b)
                prefix, middle = codec.split(front, a)
                parts = {PREFIX: prefix, SUFFIX: suffix, MIDDLE: middle}
                sizes.append((sum(f[2] for f in prefix), sum(f[2] for f in middle)))
                rows.append([f for m in ORDERS[form] for f in (marks[m], *parts[m])])
            arrays = [*batch.columns[:3], *[pa.array([s[i] for s in sizes], pa.int64()) for i in (0, 1)], _lists(rows)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"])

    return planned.mapInArrow(work, _schema(stored, "n long, form string, prefix_chars long, middle_chars long", FRAMES_DDL))


def restored_frames(codec: Codec, form: str, frames: list[tuple]) -> list[tuple]:
    """The text's frames in order, from an output's frames and form alone.

    Only frames as long as a marker are decompressed; the markers come in the
    form's order and the text holds none, so the first match is the marker.
    """
    if form == "plain":
        return frames
    parts: dict[bytes, list[tuple]] = {}
    order = list(ORDERS[form])
    for f in frames:
        if len(parts) < 3 and f[2] == 3 and codec.unpack(f[3]) == order[len(parts)]:
            part = parts[order[len(parts)]] = []
        else:
            part.append(f)
    return [*parts[PREFIX], *parts[MIDDLE], *parts[SUFFIX]]


def restore(outputs: DataFrame) -> DataFrame:
    """doc_id and the text's frames, rebuilt from ``transform``'s form and frames."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            rows = [restored_frames(codec, form, _tuples(cell)) for form, cell in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(rows)], ["doc_id", "frames"])

    return outputs.select("doc_id", "form", "frames").mapInArrow(work, _schema(outputs, FRAMES_DDL))


def texts(frames: DataFrame) -> DataFrame:
    """doc_id and text of a table with doc_id and frames."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            rows = [b"".join(codec.unpack(f[3]) for f in _tuples(cell)) for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["doc_id", "text"])

    return frames.select("doc_id", "frames").mapInArrow(work, _schema(frames, "text binary")).withColumn("text", F.col("text").cast("string"))


def digests(outputs: DataFrame) -> DataFrame:
    """``transform``'s columns with output_sha256 and restored_sha256 in place of the frames."""

    def sha(codec: Codec, frames: list[tuple]) -> str:
        state = hashlib.sha256()
        for f in frames:
            state.update(codec.unpack(f[3]))
        return state.hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec()
        for batch in batches:
            rows = []
            for form, cell in zip(batch.column(2).to_pylist(), batch.column(5), strict=True):
                frames = _tuples(cell)
                rows.append((sha(codec, frames), sha(codec, restored_frames(codec, form, frames))))
            arrays = [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *arrays], [*batch.schema.names[:5], "output_sha256", "restored_sha256"])

    kept = "n long, form string, prefix_chars long, middle_chars long"
    return outputs.mapInArrow(work, _schema(outputs, kept, "output_sha256 string, restored_sha256 string"))


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row of ``docs``."""
    return digests(transform(cut(store(docs))))
