"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

Leaves are sentences (pieces of at most `LONGEST` code points), their parents paragraphs (lines),
above them sections: a section ends at an empty line or at a paragraph whose own digest says so, so
that an insertion moves no boundary but its own. A node's digest is that of its children's digests
(for a leaf: of its text). Equal roots mean equal texts. To compare two trees, equal branches are
matched as multisets, level by level; only branches that differ are opened, down to the sentences
that differ. The likeness is the share of the text in matched branches (2 * shared / both).

The fingerprint of a text is its root and, for each section, paragraph and sentence, the first 32
bits of the digest; a sentence also has its length.

A null text is an empty one, with one defined root. Repeated rows have the same fingerprint.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from payscope.llm.common import by_batch, slices, texts

LONGEST = 96
_SENTENCE_END = re.compile(r"[.!?]+\s+")
_SECTION_STEP = 8  # one paragraph in so many ends a section

# A node is (digest, code points, children); a leaf has no children.
Node = tuple[bytes, int, tuple]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _parent(kind: bytes, children: list[Node]) -> Node:
    return (
        _digest(kind + b"".join([c[0] for c in children])),
        sum([c[1] for c in children]),
        tuple(children),
    )


def _leaves(line: str) -> list[Node]:
    cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(line)), len(line)]
    leaves = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        for at in range(a, b, LONGEST):
            piece = line[at : min(b, at + LONGEST)]
            leaves.append((_digest(b"t" + piece.encode("utf-8", "surrogatepass")), len(piece), ()))
    return leaves


def tree(text: str) -> Node:
    """The root of the Merkle tree of a text; line ends belong to their paragraph."""
    sections, paragraphs = [], []
    for line in text.split("\n"):
        # The end of line counts as a character, so that a paragraph always has weight.
        paragraph = _parent(b"p", [*_leaves(line), (b"\n", 1, ())])
        paragraphs.append(paragraph)
        if not line.strip() or paragraph[0][0] % _SECTION_STEP == 0:
            sections.append(_parent(b"s", paragraphs))
            paragraphs = []
    if paragraphs:
        sections.append(_parent(b"s", paragraphs))
    return _parent(b"r", sections)


def fingerprint(root: Node) -> str:
    """Root, then sections ('/'), paragraphs (';') and sentences (',' and length after '-')."""
    parts = [root[0].hex()]
    for section in root[2]:
        parts.append("/" + section[0][:4].hex())
        for paragraph in section[2]:
            parts.append(";" + paragraph[0][:4].hex())
            parts += [f",{d[:4].hex()}-{n:x}" for d, n, _ in paragraph[2][:-1]]
    return "".join(parts)


def unmatched(a: list[Node], b: list[Node]) -> tuple[list[Node], list[Node], int]:
    """The nodes without an equal partner, and the code points in pairs of equals."""
    waiting = defaultdict(list)
    for node in a:
        waiting[node[0]].append(node)
    rest, shared = [], 0
    for node in b:
        if waiting[node[0]]:
            shared += waiting[node[0]].pop()[1]
        else:
            rest.append(node)
    return [n for nodes in waiting.values() for n in nodes], rest, shared


def likeness(a: Node, b: Node) -> float:
    """Share of both texts in equal branches, 0 to 1; 1 if and only if the roots are equal."""
    if a[0] == b[0]:
        return 1.0
    left, right, shared = list(a[2]), list(b[2]), 0
    while left and right:
        left, right, more = unmatched(left, right)
        shared += more
        left = [c for n in left for c in n[2]]
        right = [c for n in right for c in n[2]]
    return min(2 * shared / (a[1] + b[1]), 1.0 - 1e-9)


def differing(a: Node, b: Node) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans (start, end) of the sentences of each text that are in no equal branch."""

    def spans(root: Node, other: Node) -> list[tuple[int, int]]:
        own, theirs = [root], [other]
        place = {id(root): 0}
        found = []
        while own:
            for node in own:
                at = place[id(node)]
                for child in node[2]:
                    place[id(child)] = at
                    at += child[1]
            own, theirs, _ = unmatched(
                [c for n in own for c in n[2]], [c for n in theirs for c in n[2]]
            )
            found += [(place[id(n)], place[id(n)] + n[1]) for n in own if not n[2]]
        return sorted(found)

    return spans(a, b), spans(b, a)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, root (hex) and fingerprint of every whole text."""

    def work():
        def each(batch):
            roots = [tree(t) for t in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"),
                "root": [r[0].hex() for r in roots],
                "fingerprint": [fingerprint(r) for r in roots],
            }

        return each

    return by_batch(texts(docs), work, "doc_id bigint, root string, fingerprint string")


def each_with_next(docs: DataFrame, make: Callable[[], Callable], ddl: str) -> DataFrame:
    """Apply a function to each document and the next one by descending doc_id.

    After the last document comes the first. Rows with the same doc_id are taken by text; a null
    doc_id is the lowest. `make()` returns, in each task, a pair of functions: one that prepares a
    text, once, and one that gets (doc_id, prepared, prepared next) and returns a row.

    Documents are dealt to ranges of doc_id by quantiles, and the first document of each range (one
    row per range) is also sent to the range before it: one shuffle of the texts, no global sort in
    one task.
    """
    spark = docs.sparkSession
    docs = texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(
        {int(b) for b in docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)}
    )
    steps = [1 << s for s in reversed(range(len(bounds).bit_length()))]
    listed = F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>")

    # The number of bounds below the id, by halving; ranges are numbered from the highest ids down.
    def further(low, step):
        is_below = F.coalesce(F.get(listed, low + step - 1) < F.col("doc_id"), F.lit(False))
        return F.when(is_below, low + step).otherwise(low)

    below = F.lit(0)
    if bounds:
        below = F.aggregate(F.array(*[F.lit(s) for s in steps]).cast("array<int>"), below, further)
    ranged = docs.withColumn("part", F.lit(len(bounds)) - below).withColumn("guest", F.lit(0))

    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head"), F.max(F.lit(1)).alias("any"))
    heads = {r["part"]: r["head"] for r in heads.collect()}  # one row per range
    order = sorted(heads)
    follows = {p: order[n - 1] for n, p in enumerate(order)}  # whose next is the head of p
    guests = None
    if order:
        rows = [(p, heads[p], follows[p]) for p in order]
        wanted = spark.createDataFrame(rows, "part int, head bigint, host int")
        same = F.col("doc_id").eqNullSafe(F.col("head"))
        guests = (
            ranged.join(F.broadcast(wanted), ["part"])
            .filter(same)
            .groupBy("host", "doc_id")
            .agg(F.min("text").alias("text"))
            .select("doc_id", "text", F.col("host").alias("part"), F.lit(1).alias("guest"))
        )
    both = ranged.unionByName(guests) if guests is not None else ranged
    placed = both.repartition(parts, "part").sortWithinPartitions(
        "part", "guest", F.col("doc_id").desc_nulls_last(), "text"
    )
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepare, row_of = make()
        held = None  # (part, doc_id, prepared)
        for batch in slices(batches):
            made = []
            columns = (batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))
            for part, guest, doc_id, text in zip(*columns, strict=True):
                ready = prepare(text)
                if held is not None and held[0] == part:
                    made.append(row_of(held[1], held[2], ready))
                held = None if guest else (part, doc_id, ready)
            columns = list(zip(*made, strict=True)) or [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
            )

    return placed.mapInArrow(run, schema)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """The columns of query op4: each text against its edited form and against the next document."""

    def make():
        def prepare(text):
            root = tree(text)
            return text, root, fingerprint(root)

        def row_of(doc_id, own, following):
            text, root, print_ = own
            cut = len(text) // 3
            edited = text[: len(text) - cut] + following[0][:cut]
            edited_root = tree(edited)
            return (
                doc_id,
                len(text),
                hashlib.sha256(edited.encode()).hexdigest(),
                print_,
                fingerprint(edited_root),
                likeness(root, edited_root),
                likeness(root, following[1]),
            )

        return prepare, row_of

    ddl = """doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string,
        edited_fingerprint string, near_edited double, near_next double"""
    return each_with_next(docs, make, ddl)
