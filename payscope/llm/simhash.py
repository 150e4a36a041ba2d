"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Two
fingerprints are linked if at most `radius` bits differ; documents fall into the components of all
links.

Equal fingerprints are one node, so exact copies cost one comparison. The 64 bits are cut into
`parts`; two linked fingerprints agree in at least parts - radius of them, so comparing within
buckets of equal bits, for each choice of that many parts, meets every link. More parts are taken
when there are more fingerprints, which keeps buckets small and changes no result. A bucket
beyond `chunk` fingerprints is cut into chunks, and each pair of chunks is compared on its own.

Within a bucket, bits are stored in planes: bit b of all fingerprints side by side, 64 to a word. A
query is compared with 64 fingerprints at once: its differing bits are added plane by plane into
carry-save counters (ones, twos, fours, and over for what passed the radius), and a block is
abandoned as soon as all of its fingerprints are over. Of the links found in a bucket only a
spanning forest leaves the task: it has the same components.

A null or empty text has fingerprint zero. Rows with a null doc_id take part; a component's id is the
smallest doc_id in it that is not null. Repeated rows share a component. An empty table gives an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.llm.common import by_batch, repeated, row_key, staged, texts
from payscope.llm.components import components

BITS = 64
SEED = 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, width: int = 4) -> int:
    """Unsigned fingerprint of a UTF-8 text by shingles of `width` words."""
    import xxhash

    words = text.translate(_LOWER).split()  # bytes split at space and U+0009 to U+000D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    last = len(words) - width + 1
    hashes = np.array(
        [digest(line[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[width - 1 :].tolist(), strict=True)],
        dtype=np.uint64,
    )
    counts = np.zeros(BITS, np.int64)
    for at in range(0, last, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, row key and fingerprint (fp, as a signed long) of every whole text."""

    def work():
        def each(batch):
            every = [fingerprint(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            made = {c: batch.column(c) for c in ("doc_id", "_doc", "_text")}
            return made | {"fp": pa.array(np.array(every, dtype=np.uint64).view(np.int64))}

        return each

    return by_batch(texts(docs, *row_key()), work, "doc_id bigint, _doc bigint, _text bigint, fp bigint")


def near(
    queries: np.ndarray, planes: np.ndarray, bits: list[int], radius: int, block: int = 8
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit-sliced comparison of queries with blocks of `block` words of 64 fingerprints each.

    `planes[b]` holds bit b of all fingerprints, 64 to a word; its length is a multiple of `block`.
    Returns query numbers, block numbers and the block's words, with a bit set for every
    fingerprint within the radius, for each query and block that has one.
    """
    planes = planes.reshape(len(planes), -1, block)
    q, at = (x.ravel() for x in np.indices((len(queries), planes.shape[1])))
    counters = [np.zeros((len(q), block), np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros((len(q), block), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for n, b in enumerate(bits):
        flip = ((queries >> np.uint64(b)) & np.uint64(1)) * full
        carry = planes[b][at] ^ flip[q][:, None]
        for c in counters:  # carry-save addition of one bit to each of the 64 counters of a word
            c ^= carry
            carry &= ~c
        over |= carry
        if n % 6 == 5 or n == len(bits) - 1:  # abandon blocks that are over as a whole
            over |= _beyond(counters, radius)
            keep = (over != full).any(axis=1)
            q, at, over = q[keep], at[keep], over[keep]
            counters = [c[keep] for c in counters]
            if not len(q):
                break
    return q, at, ~over


def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Words with a bit set where the counter is above the radius."""
    above = np.zeros_like(counters[0])
    same = ~above
    for n in reversed(range(len(counters))):
        if radius >> n & 1:
            same = same & counters[n]
        else:
            above |= same & counters[n]
            same = same & ~counters[n]
    return above


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of all values; the places after the last value stay zero."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def forest(values: np.ndarray, queries: np.ndarray, bits: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges (places in values) of a spanning forest of all links of queries (places) with values."""
    planes = bit_planes(values)
    block = min(8, planes.shape[1])
    planes = np.pad(planes, ((0, 0), (0, -planes.shape[1] % block)))
    label = np.arange(len(values))
    edges = []
    step = max(1, (1 << 18) // planes.shape[1])
    for start in range(0, len(queries), step):
        asked = queries[start : start + step]
        for q, at, row in zip(*near(values[asked], planes, bits, radius, block), strict=True):
            place = int(asked[q])
            close = np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little")) + int(at) * block * 64
            close = close[close < len(values)]
            labels = label[close]
            if (labels == label[place]).all():
                continue
            roots, first = np.unique(labels, return_index=True)
            edges += [(place, int(close[f])) for r, f in zip(roots, first, strict=True) if r != label[place]]
            roots = np.append(roots, label[place])
            label[np.isin(label, roots)] = roots.min()
    return edges


def parts_for(n: int, radius: int, bucket: int = 4096) -> int:
    """The fewest parts for which a bucket of n even fingerprints holds about `bucket` at most."""
    parts = radius + 1
    while n >> ((parts - radius) * (BITS // parts)) > bucket and parts < 2 * radius:
        parts += 1
    return parts


def links(distinct: DataFrame, radius: int = 4, chunk: int = 16384) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, with the components of all links."""
    parts = parts_for(distinct.count(), radius)
    cuts = [BITS * p // parts for p in range(parts + 1)]
    masks = []
    for chosen in combinations(range(parts), parts - radius):
        mask = sum(((1 << cuts[p + 1]) - (1 << cuts[p])) for p in chosen)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    keys = [F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(masks)]
    dealt = distinct.select("fp", F.inline(F.array(*keys)))
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    sequence = F.sequence(F.lit(0), chunks - 1)
    # A row of chunk c goes to every pair of chunks (i <= j) that c is part of.
    pairs = F.transform(
        sequence, lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j"), own.alias("c"))
    )
    groups = dealt.join(sizes, ["t", "key"]).select("fp", "t", "key", F.inline(pairs))
    spark = distinct.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = groups.repartition(n_parts, "t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", "c", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = [[b for b in range(BITS) if not m >> b & 1] for m in masks]

        def edges_of(rows: np.ndarray) -> list[tuple[int, int]]:
            """Edges of one group; columns are t, key, i, j, c, fp."""
            values = rows[:, 5].copy()
            mixed = rows[0, 2] != rows[0, 3]
            queries = np.flatnonzero(rows[:, 4] == rows[0, 2]) if mixed else np.arange(len(rows))
            found = forest(values.view(np.uint64), queries, free[rows[0, 0]], radius)
            return [(int(values[a]), int(values[b])) for a, b in found]

        def emit(made):
            columns = [pa.array([e[n] for e in made], pa.int64()) for n in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        held = np.zeros((0, 6), np.int64)
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "i", "j", "c", "fp")]
            held = np.concatenate([held, np.stack(columns, axis=1).astype(np.int64)])
            cuts = np.flatnonzero((held[1:, :4] != held[:-1, :4]).any(axis=1)) + 1
            made, at = [], 0
            for cut in cuts:
                made += edges_of(held[at:cut])
                at = cut
            held = held[at:]
            yield emit(made)
        if len(held):
            yield emit(edges_of(held))

    return placed.mapInArrow(run, "a bigint, b bigint")


def members(printed: DataFrame, radius: int = 4) -> DataFrame:
    """of (a fingerprint) and root (one for each component), from rows with `fp`."""
    nodes = staged(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left")
    return rooted.select(F.col("fp").alias("of"), "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row."""
    printed = staged(fingerprints(docs, width).select("doc_id", "fp"), "simhash")
    rooted = members(printed, radius)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(least, "root").select("of", "component_id")
    return printed.join(member, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id, then text hash."""
    printed = staged(fingerprints(docs, width), "simhash")
    keyed = printed.join(members(printed, radius), F.col("fp") == F.col("of"))
    chosen = keyed.groupBy("root").agg(F.min(F.struct("_doc", "_text")).alias("key")).select("key.*")
    rows = printed.groupBy("_doc", "_text").agg(F.count("*").alias("_rows"))
    return repeated(docs, rows.join(chosen, ["_doc", "_text"]).withColumn("_copies", F.lit(1)))


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op9."""
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
