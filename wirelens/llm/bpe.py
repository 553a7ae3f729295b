"""Byte-pair encoding through a distinct-word table, and decoding through an id-to-piece table.

Words are ``[^\\x20\\x09-\\x0D]+``; the tokenizers this serves never merge
across such white space, so a text's ids are its words' ids one after another.

``encode`` works in blocks of at most ``BLOCK_ROWS`` rows of an input partition:

1. every block lists its distinct words, by word class (a hash);
2. the lists of a class meet in one place, where a table of distinct words
   encodes each of them once and looks it up for all blocks;
3. the ids go back to the blocks that asked, where they are joined to the
   words' positions.

So what is shuffled is the blocks' distinct words, not word occurrences, and
the texts once, all as compressed lists. A word that is in every document is
one entry per block; a block and its word table are bounded by its rows, and
the table of a class by ``TABLE_WORDS`` (beyond it the table starts anew). A
word that its block's table lacks (an input whose partitions change between two
reads) is encoded on the spot, so ids never depend on the blocks.

``decode`` looks every id up in the tokenizer's id-to-piece table, whose size
is the vocabulary's, and joins the pieces with blanks, as a tokenizer without a
decoder does. ``encode_and_decode`` does so where the ids are put together: a
decoding step behind that one would keep a second Python process for each task.

Defined results: a NULL or blank text has no ids and decodes to an empty text;
ids may be NULL or repeated, each row stays a row; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.frames import columns, give_back, released

#: Rows whose words are listed, and whose ids are put together, at a time.
BLOCK_ROWS = 4000
#: Words that the table of a class keeps.
TABLE_WORDS = 400_000
#: Words encoded in one call of the tokenizer.
CALL = 4096
#: Rows decoded at a time.
DECODE_ROWS = 256


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def word_encoder(path: str) -> Callable[[list[bytes]], list[bytes]]:
    """Words in UTF-8 to their ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    tok = _tokenizer(path)

    def encode(words: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(words), CALL):
            batch = tok.encode_batch([w.decode("utf-8") for w in words[at : at + CALL]], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in batch]
        return out

    return encode


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield part << 32 | n, batch.slice(at, BLOCK_ROWS)
            n += 1


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for block, batch in _blocks(batches):
        packed = pa.array([press.compress(t) for t in _texts(batch.column(1))], pa.binary())
        blocks = pa.array([block] * batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([blocks, batch.column(0), packed], ["block", "id", "packed"])


def _pack_ids(ids: list[bytes]) -> bytes:
    """Number of words, each one's number of bytes, all ids."""
    import numpy as np

    sizes = np.fromiter(map(len, ids), "<u4", len(ids))
    return b"".join([len(ids).to_bytes(4, "little"), sizes.tobytes(), *ids])


def _unpack_ids(data: bytes) -> list[bytes]:
    import numpy as np

    n = int.from_bytes(data[:4], "little")
    ends = (np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def id_decoder(path: str) -> Callable[[bytes | None], str]:
    """Ids as little-endian unsigned 32-bit integers to their text."""
    import numpy as np

    tok = _tokenizer(path)
    pieces = [tok.id_to_token(i) for i in range(tok.get_vocab_size())]

    def text_of(ids: bytes | None) -> str:
        return " ".join([pieces[i] for i in np.frombuffer(ids or b"", dtype="<u4").tolist()])

    return text_of


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", into: str | None = None) -> DataFrame:
    """``key``, ids (binary, little-endian unsigned 32-bit) and n_tokens of every row; ``into``: also the ids' text."""
    source = columns(docs, key, text).toDF("id", "text")
    kind = source.schema["id"].dataType
    classes = max(32, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for block, batch in _blocks(batches):
            seen: set[bytes] = set()
            for text in _texts(batch.column(1)):
                seen.update(text.split())
            lists: dict[int, list[bytes]] = {}
            for word in sorted(seen):
                lists.setdefault(zlib.crc32(word) % classes, []).append(word)
            packed = [press.compress(b"\n".join(w)) for w in lists.values()]
            arrays = [pa.array([block] * len(lists), pa.int64()), pa.array(list(lists), pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "class", "words"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct-word table of the classes that this task has."""
        import zstandard

        press, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        encoder, table = word_encoder(path), {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                words = unpack.decompress(row.column(2)[0].as_py()).split(b"\n")
                if len(table) > TABLE_WORDS:
                    table.clear()
                new = [w for w in words if w not in table]
                table.update(zip(new, encoder(new), strict=True))
                ids = press.compress(_pack_ids([table[w] for w in words]))
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(2), pa.array([ids], pa.binary())], ["block", "words", "ids"])

    decoder: list[Callable] = []  # of a task

    def assemble(tables: pa.Table, rows: pa.Table) -> pa.Table:
        import zstandard

        unpack, encoder = zstandard.ZstdDecompressor(), []
        known: dict[bytes, bytes] = {}
        for words, ids in zip(tables.column("words"), tables.column("ids"), strict=True):
            known.update(zip(unpack.decompress(words.as_py()).split(b"\n"), _unpack_ids(unpack.decompress(ids.as_py())), strict=True))

        def ids_of(words: list[bytes]) -> bytes:
            try:
                return b"".join(map(known.__getitem__, words))
            except KeyError:
                if not encoder:
                    encoder.append(word_encoder(path))
                new = sorted({w for w in words if w not in known})
                known.update(zip(new, encoder[0](new), strict=True))
                return b"".join(map(known.__getitem__, words))

        ids = [ids_of(unpack.decompress(p.as_py()).split()) for p in rows.column("packed")]
        arrays = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
        done = pa.table([rows.column("id"), *arrays], ["id", "ids", "n_tokens"])
        if into is None:
            return done
        known.clear()
        if not decoder:
            decoder.append(id_decoder(path))
        parts = [ids[at : at + DECODE_ROWS] for at in range(0, len(ids), DECODE_ROWS)]
        texts = pa.chunked_array([pa.array(map(decoder[0], part), pa.string()) for part in parts], pa.string())
        return done.append_column(into, texts)

    def assemble_and_release(tables: pa.Table, rows: pa.Table) -> pa.Table:
        done = assemble(tables, rows)
        give_back()
        return done

    asked = source.mapInArrow(released(list_words), "block long, class int, words binary")
    table = asked.repartition("class").mapInArrow(released(look_up), "block long, words binary, ids binary")
    packed_schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("id", kind), T.StructField("packed", T.BinaryType())])
    packed = source.mapInArrow(released(_pack_texts), packed_schema)
    out_schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    if into is not None:
        out_schema = out_schema.add(into, T.StringType())
    done = table.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(assemble_and_release, out_schema)
    return done.withColumnRenamed("id", key)


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in one more column."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())])
    at = encoded.columns.index(ids)

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = id_decoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(start, DECODE_ROWS)
                texts = [text_of(value.as_py()) for value in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema=pa.schema([*part.schema, ("d", pa.string())]))

    return encoded.mapInArrow(released(pieces_of), schema)


def encode_and_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``encode`` with the ids' text in the column decoded, made in the same tasks."""
    return encode(docs, path, key, text, into="decoded")


def digests(coded: DataFrame, key: str = "doc_id") -> DataFrame:
    return coded.select(
        key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
