"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Documents become token ids, followed by one end id; only documents longer than a sequence are cut.
Pieces are dealt evenly to shards of bounded size, and each shard is packed on its own: pieces by
descending length, each into the open sequence with the least room that still holds it. The segment
tree counts the open sequences by remaining room, so that the tightest fit is found in logarithmic
time. A shard leaves at most a few sequences unfilled; shards are large, so that this does not show.
Ids never travel: a shard is dealt the lengths alone.

Ids are those of `tokenizers` with add_special_tokens=False: the literal of an added token of the
vocabulary file, as `<|endoftext|>`, is that token's id wherever it stands in a text.

Null texts are empty: one piece that holds the end id. Repeated rows are packed each. An empty table
gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.llm.common import by_batch, ratio_up, staged, texts

#: How the vocabulary splits text before its merges (the pattern of byte-level BPE, fixed).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """Token ids of texts without added tokens as little-endian 32-bit integers.

    Words are looked up in a cache of bounded size: outside of runs of white space, a text falls
    apart at single spaces and line ends without changing its tokens. Other texts are encoded whole.
    """

    def __init__(self, path: str, cached: int = 400_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        ranks = {
            bytes(map(letters.__getitem__, t)): n
            for t, n in vocabulary.items()
            if all(c in letters for c in t) and not t.startswith("<|")
        }
        encode = tiktoken.Encoding(
            "vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                # A word that starts with a line end stands without a space before it.
                ids = encode(word if word[:1] == "\n" else " " + word)
                made = np.array(ids, dtype="<u4").tobytes()
                if len(self) >= cached:
                    self.clear()
                self[word] = made
                return made

        self.encode, self.word = encode, Words().__getitem__
        self.joined = re.compile(r"\s\s")

    def __call__(self, text: str) -> bytes:
        if self.joined.search(text) or text[:1].isspace() or text[-1:].isspace():
            return np.array(self.encode(text), dtype="<u4").tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        return np.array(self.encode(first), dtype="<u4").tobytes() + b"".join(map(self.word, rest))


class WholeEncoder:
    """Token ids of whole texts; those that hold an added token's literal are left to `tokenizers`."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.path, self.plain, self.reference = path, Encoder(path), None

    def __call__(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            return self.plain(text)
        if self.reference is None:  # rarely needed, so loaded by the first such text of a task
            from tokenizers import Tokenizer

            self.reference = Tokenizer.from_file(self.path)
        return np.array(self.reference.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids (binary, little-endian 32-bit) of every document.

    A document longer than `capacity` is cut into pieces of that length; the first one holds what
    is over and may be shorter.
    """

    def work():
        encoder, end = WholeEncoder(vocabulary), np.array([end_id], dtype="<u4").tobytes()

        def each(batch):
            rows = []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                ids = encoder(text) + end
                n = len(ids) // 4
                cuts = list(range(n % capacity or capacity, n, capacity))
                for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, n], strict=True)):
                    rows.append((doc_id, k, a, b - a, ids[4 * a : 4 * b]))
            names = "doc_id", "piece", "start", "length", "ids"
            return dict(zip(names, list(zip(*rows, strict=True)) or [[]] * 5, strict=True))

        return each

    return by_batch(texts(docs), work, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


class Rooms:
    """Counts of open sequences by remaining room, as a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest room of at least `length` that is open."""
        count, at = self.count, length + self.size
        if count[at]:
            return length
        while at > 1:
            if at & 1 == 0 and count[at + 1]:  # the nearest larger rooms stand to the right
                at += 1
                while at < self.size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each length; lengths come in descending order."""
    rooms, open_by_room = Rooms(capacity), [[] for _ in range(capacity + 1)]
    sequences, offsets, made = [], [], 0
    for length in lengths:
        room = rooms.tightest(length)
        if room is None:
            room, sequence, made = capacity, made, made + 1
        else:
            sequence = open_by_room[room].pop()
            rooms.add(room, -1)
        sequences.append(sequence)
        offsets.append(capacity - room)
        if room > length:
            open_by_room[room - length].append(sequence)
            rooms.add(room - length, 1)
    return sequences, offsets


def pack(cut: DataFrame, capacity: int = 2048, shard_rows: int = 100_000) -> DataFrame:
    """The rows of `cut` (doc_id, piece, length and others, one row per piece) with sequence_id
    and offset."""
    cut = staged(cut, "pieces")
    shards = ratio_up(cut.count(), shard_rows)
    schema = f"{', '.join(f'`{n}` {t}' for n, t in cut.dtypes)}, sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # one shard
        if not held:
            return
        shard = pa.Table.from_batches(held).sort_by(
            [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
        )
        sequences, offsets = best_fit(shard.column("length").to_pylist(), capacity)
        base = TaskContext.get().partitionId() << 32
        shard = shard.append_column("sequence_id", pa.array([base + s for s in sequences], pa.int64()))
        shard = shard.append_column("offset", pa.array(offsets, pa.int64()))
        yield from shard.to_batches(max_chunksize=20_000)

    return cut.repartition(shards).mapInArrow(run, schema)


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """The columns of query op6: every piece with the checksum of its ids and its place."""
    cut = pieces(docs, vocabulary, capacity).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack(cut, capacity)
