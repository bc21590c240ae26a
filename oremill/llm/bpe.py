"""Encoding of texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, where no other is given.
FOLDER = "/opt/tokenizers"
#: How byte_bpe_50k cuts a text before merging (fixed value, part of the vocabulary's definition).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(folder: str = FOLDER, name: str = "byte_bpe_50k") -> dict[bytes, int]:
    """The vocabulary: token bytes and their id, which is also the merge's rank. About 50,000 entries, the same for any data."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. Symbols are a doubly linked list over the bytes; a heap has the possible merges by (rank, place). An entry
    is stale, and skipped, if its left symbol is gone or one of both has grown since."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # where the symbol that starts here ends; 0 once it is gone
    before = list(range(-1, n - 1))  # start of the symbol before
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (b := before[i]) >= 0 and (r := ranks.get(piece[b:stop])) is not None:
            heappush(heap, (r, b, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes texts; pieces that were met before are looked up in a table, which is emptied at `most` entries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, most: int = 200_000) -> None:
        self.ranks, self.most = ranks, most
        self.find = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of the text as it stands; none for an empty and for a null text."""
        ids: list[int] = []
        if not text:
            return ids
        known, ranks = self.known, self.ranks
        for piece in self.find(text):
            found = known.get(piece)
            if found is None:
                found = merge(piece.encode("utf-8", "surrogatepass"), ranks)
                if len(known) >= self.most:
                    known.clear()
                if len(piece) <= 100:
                    known[piece] = found
            ids += found
        return ids


def decode(ids: list[int], tokens: dict[int, bytes]) -> str:
    """The text of a list of ids: the tokens' bytes in a row."""
    return b"".join(tokens[i] for i in ids).decode("utf-8", "surrogatepass")


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids) of every row: the text's ids in the vocabulary, without special tokens; a special token's string is ordinary text.

    A null and an empty text have an empty list; white space is encoded. Rows with a null key are kept, repeated rows too. The
    vocabulary is read on the driver and broadcast (about 1 MB at any size of the data). Rows are spread evenly before, as
    a file may hold a few very long texts next to each other.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(folder, name))
    kind = documents.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                ids = pa.array([encoder.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    rows = documents.select(key, text)
    width = max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(width, F.xxhash64(key, F.length(text))).mapInArrow(encode, f"{key} {kind}, ids array<int>")
