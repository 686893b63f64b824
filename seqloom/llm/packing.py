"""Tokens of documents packed into fixed windows, with a bounded number of open windows a partition."""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.session import write_table

WINDOW = 1024
OPEN_WINDOWS = 64
END_ID = 0

#: Chunks kept encoded in a task. Of a full table those used again survive one more round, which changes no result.
CACHE_CHUNKS = 400_000

#: Characters whose classes all libraries agree on; other chunks go to the reference library itself.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")

#: Punctuation that may be cut from the end of a run of letters; an apostrophe may not.
_MARKS = ".,;:!?%&*$#|"

_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, window bigint, offset bigint, open_ids binary"


class ChunkEncoder(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of a space followed by the key.

    The pattern of this vocabulary starts a new token at a single space before
    a character that is no white space, makes a token of a single line feed
    between other characters, and ends a run of letters at punctuation. So a
    text may be cut there and its chunks encoded apart; a text with any other
    white space, or with a token that was added to the vocabulary, is encoded
    whole by the library.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.whole = Tokenizer.from_file(vocabulary)
        self.added = [token.content for token in self.whole.get_added_tokens_decoder().values()]
        self.old: dict[str, bytes] = {}
        self.newline = self.ids("\n")
        self.marks = lru_cache(4096)(self.ids)

    def ids(self, text: str) -> bytes:
        if not _PLAIN.fullmatch(text):
            return self.by_library(text)
        got = self.plain.encode_ordinary(text)
        return pack(f"<{len(got)}I", *got)

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            word = chunk.rstrip(_MARKS)
            if word != chunk and word.isalpha():
                return self[word] + self.marks(chunk[len(word) :])
            if not chunk or chunk[0].isspace():
                raise KeyError(chunk)
            got = self.ids(" " + chunk)
        if len(self) >= CACHE_CHUNKS:
            self.old = dict(self)
            self.clear()
        self[chunk] = got
        return got

    def by_library(self, text: str) -> bytes:
        got = self.whole.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(got)}I", *got)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.added):
            return self.by_library(text)
        out = []
        try:
            for number, line in enumerate(text.split("\n")):
                if number:
                    out.append(self.newline)
                head, *chunks = line.split(" ")
                if not head or head[0].isspace() or line[-1].isspace():
                    raise KeyError(line)
                out.append(self.ids(head))
                out.extend(map(self.__getitem__, chunks))
            return b"".join(out)
        except KeyError:
            return self.ids(text)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class OpenWindows:
    """Windows with room, at most ``most``; each is (fill, number, pieces)."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.number = size, most, [], 0

    def place(self, length: int, piece: dict) -> list[dict]:
        """Put a piece where it leaves the least room; if it fits nowhere and no window may open, the fullest goes out."""
        out: list[dict] = []
        at = bisect_left(self.open, (self.size - length + 1,)) - 1
        if at >= 0:
            fill, number, pieces = self.open.pop(at)
        else:
            if len(self.open) >= self.most:
                out = self.open.pop()[2]
            fill, number, pieces = 0, self.number, []
            self.number += 1
        piece |= {"window": number, "offset": fill}
        pieces.append(piece)
        if fill + length == self.size:
            return out + pieces
        insort(self.open, (fill + length, number, pieces), key=lambda w: w[:2])
        return out


def _pack_partition(size: int, most: int, files: tuple[str, str]):
    columns = [x.split(" ")[0] for x in _PIECE.split(", ")]
    kinds = [pa.binary() if x == "open_ids" else pa.int64() for x in columns]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(columns, kinds, strict=True)], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = ChunkEncoder(*files)
        windows = OpenWindows(size, most)
        base = TaskContext.get().partitionId() << 36
        end = np.array([END_ID], "<u4").tobytes()
        ready: list[dict] = []

        def closed(pieces: list[dict]) -> None:
            for p in pieces:
                ready.append(p | {"window": base + p["window"], "open_ids": None})

        for batch in batches:
            for row in range(batch.num_rows):
                ids = encoder.encode(batch.column(1)[row].as_py() or "") + end
                count, doc = len(ids) // 4, batch.column(0)[row].as_py()
                for start in range(0, count, size):
                    part = ids[4 * start : 4 * (start + size)]
                    length = len(part) // 4
                    piece = {"doc_id": doc, "start": start, "length": length, "ids_crc32": zlib.crc32(part), "doc_tokens": count, "open_ids": part}
                    closed(windows.place(length, piece))
                if len(ready) >= 8192:
                    yield batch_of(ready)
                    ready.clear()
        for _, _, pieces in windows.open:
            ready.extend(p | {"window": base + p["window"]} for p in pieces)
        if ready:
            yield batch_of(ready)

    return run


def _merge_partition(size: int):
    """Lay the leftover pieces end to end, cut them at the window's size, and cut the last stretch at powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (1 << 62) + (TaskContext.get().partitionId() << 36)
        waiting: list[list] = []
        held = 0

        def emit(limit: int) -> Iterator[tuple]:
            """The first ``limit`` waiting ids as one window."""
            nonlocal number, held
            offset = 0
            while offset < limit:
                doc, start, count, ids = waiting[0]
                take = min(limit - offset, len(ids) // 4)
                part = ids[: 4 * take]
                yield doc, start, take, zlib.crc32(part), count, number, offset
                offset += take
                if take == len(ids) // 4:
                    waiting.pop(0)
                else:
                    waiting[0] = [doc, start + take, count, ids[4 * take :]]
            number += 1
            held -= limit

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        for batch in batches:
            rows: list[tuple] = []
            for piece in batch.to_pylist():
                waiting.append([piece["doc_id"], piece["start"], piece["doc_tokens"], piece["open_ids"]])
                held += piece["length"]
                while held >= size:
                    rows += emit(size)
            if rows:
                yield batch_of(rows)
        rows = []
        while held:
            rows += emit(1 << (held.bit_length() - 1))
        if rows:
            yield batch_of(rows)

    return run


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    files: tuple[str, str] | None = None,
) -> DataFrame:
    """Pieces of tokenised documents in windows of at most ``size`` ids.

    A document is its ids and then id 0. It is cut at multiples of ``size``;
    each piece goes into the open window where it leaves the least room. A
    partition has at most ``open_windows`` of them: if a piece fits none, the
    fullest one is emitted and a new one opens. What is still open at the end
    of the partitions, at most that many windows each, is laid end to end in
    ``partitions / 64`` tasks and cut at ``size``, so that only their last
    stretch is short; it is cut at powers of two, which need no padding.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    a row a piece. Null and empty texts are the single id 0; a null id stays
    null; repeated rows are packed each. Sequence ids are unique, not gapless.
    """
    files = files or default_files()
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = write_table(source.mapInArrow(_pack_partition(size, open_windows, files), _PIECE), "packing-pieces")
    left = pieces.where("open_ids is not null")
    tasks = max(1, left.select(F.shiftright("window", 36).alias("p")).distinct().count() // 64)
    merged = (
        left.select("doc_id", "start", "length", "doc_tokens", "open_ids", "window", "offset")
        .repartition(tasks, "window")
        .sortWithinPartitions("window", "offset", "doc_id", "start")
        .drop("window", "offset")
        .mapInArrow(_merge_partition(size), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    )
    full = pieces.where("open_ids is null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset"
    )
    return full.union(merged)
