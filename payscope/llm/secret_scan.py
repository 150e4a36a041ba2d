"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

Patterns give the base findings. The method adds strings that no pattern names: two character
Markov models are trained from labelled samples, one on random strings, one on ordinary
identifiers, and a string is a finding if its log-likelihood ratio speaks for the random model.

The labelled samples come from all texts: what the patterns find is random; another long run of
identifier characters is ordinary if it holds no digits within letters. Transitions are counted in
the tasks and summed by Spark, so what reaches the driver is one table of pairs of characters,
whatever the number of texts.

Null texts are empty and have no findings. Repeated rows are each scanned. An empty table gives an
empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.llm.common import by_batch, staged, texts

# The patterns of the base findings, with the least length of each.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LEAST = 20
HEX = r"[0-9a-f]+"
HEX_LEAST = 24
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
START = len(ALPHABET)


def _pairs(token: str) -> list[tuple[int, int]]:
    """Transitions of a token; the first one leaves the start state."""
    at = [START, *map(ALPHABET.index, token)]
    return list(zip(at, at[1:], strict=False))


def base_spans(text: str) -> list[tuple[int, str, int, int, int]]:
    """(start, kind, end, start and end of the secret itself), leftmost, non-overlapping by kind."""
    found = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_LEAST:
            found.append((m.start(), "assign", m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append((m.start(), "access", m.end(), m.start(), m.end()))
    for m in _LONG_HEX.finditer(text):
        found.append((m.start(), "hex", m.end(), m.start(), m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
# A run of hex digits is found whole or not at all, so its least length can be in the pattern.
_LONG_HEX = re.compile(HEX.replace("+", "{%d,}" % HEX_LEAST))

SCANNED = """doc_id bigint,
    spans array<struct<kind:string,start:int,stop:int>>,
    samples array<string>,
    candidates array<struct<start:int,stop:int,token:string>>"""


def scan(docs: DataFrame, least: int = 16) -> DataFrame:
    """One row per document: base spans, the secrets in them, and the strings left to judge.

    Candidates are runs of at least `least` identifier characters that touch no base span and
    are not made of digits and signs alone.
    """

    def work():
        runs = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % least)
        letter = re.compile("[A-Za-z]")

        def each(batch):
            spans, samples, candidates = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                spans.append([{"kind": k, "start": a, "stop": b} for a, k, b, _, _ in base])
                samples.append([text[a:b] for _, _, _, a, b in base])
                left = []
                # Candidates and base spans both come by start: the latest end of all spans that
                # start before a candidate's end says whether one of them reaches into it.
                ahead, reached = iter([*base, (len(text) + 1, "", 0, 0, 0)]), 0
                span = next(ahead)
                for m in runs.finditer(text):
                    a, b = m.span()
                    while span[0] < b:
                        reached, span = max(reached, span[2]), next(ahead)
                    token = m.group().strip("=.-_/+")
                    if reached <= a and letter.search(token):
                        a += m.group().index(token)
                        left.append({"start": a, "stop": a + len(token), "token": token})
                candidates.append(left)
            return {
                "doc_id": batch.column("doc_id"),
                "spans": spans,
                "samples": samples,
                "candidates": candidates,
            }

        return each

    return by_batch(texts(docs), work, SCANNED)


def samples(scanned: DataFrame) -> DataFrame:
    """Labelled samples (token, random): what the patterns found, and what looks like a name.

    Candidates with digits within letters teach neither model: secrets may be among them.
    """
    found = scanned.select(F.explode("samples").alias("token"), F.lit(True).alias("random"))
    rest = scanned.select(F.explode("candidates.token").alias("token"), F.lit(False).alias("random"))
    return found.unionByName(rest.filter(~F.col("token").rlike("[A-Za-z][0-9]+[A-Za-z]")))


def transition_counts(labelled: DataFrame) -> DataFrame:
    """(random, a, b, n): how often character b follows a, over all samples."""

    def work():
        def each(batch):
            counts: dict[tuple[bool, int, int], int] = {}
            columns = batch.column("token").to_pylist(), batch.column("random").to_pylist()
            for token, random in zip(*columns, strict=True):
                for a, b in _pairs(token or ""):
                    counts[random, a, b] = counts.get((random, a, b), 0) + 1
            keys = list(counts)
            return {
                "random": [k[0] for k in keys],
                "a": [k[1] for k in keys],
                "b": [k[2] for k in keys],
                "n": list(counts.values()),
            }

        return each

    counted = by_batch(labelled, work, "random boolean, a int, b int, n bigint")
    return counted.groupBy("random", "a", "b").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, smoothing: float = 0.5, backoff: float = 4.0, uniform: float = 0.5) -> list[list[float]]:
    """Log-likelihood ratio of each transition, random against ordinary.

    Rare transitions back off to how often the character occurs at all. The random model is a
    mixture of the trained one and of evenly distributed characters (`uniform` is the weight of the
    latter), as samples seldom hold every alphabet of secrets. The table has one row per character
    and one for the start: its size is fixed.
    """
    size = len(ALPHABET)
    counts = {r: [[0.0] * size for _ in range(size + 1)] for r in (True, False)}
    for row in transition_counts(labelled).toLocalIterator():
        counts[row["random"]][row["a"]][row["b"]] = float(row["n"])

    def chances(table: list[list[float]]) -> list[list[float]]:
        total = [sum(column) + smoothing for column in zip(*table, strict=True)]
        single = [n / sum(total) for n in total]
        return [
            [(n + backoff * p) / (sum(row) + backoff) for n, p in zip(row, single, strict=True)] for row in table
        ]

    return [
        [math.log((1 - uniform) * p + uniform / size) - math.log(q) for p, q in zip(chosen, plain, strict=True)]
        for chosen, plain in zip(chances(counts[True]), chances(counts[False]), strict=True)
    ]


def score(token: str, ratios: list[list[float]]) -> float:
    """Mean log-likelihood ratio per character; above 0 the token looks random."""
    pairs = _pairs(token)
    return sum(ratios[a][b] for a, b in pairs) / max(1, len(pairs))


def find(docs: DataFrame, least: int = 16, least_ratio: float = 1.0, least_kinds: int = 6) -> DataFrame:
    """doc_id and all spans (kind, start, stop) by start, then kind as listed in KINDS.

    A candidate is a finding if its mean ratio is at least `least_ratio` and it has at least
    `least_kinds` different characters (a run of one sign is no secret).
    """
    scanned = staged(scan(docs, least), "secrets")
    ratios = train(samples(scanned))

    def work():
        def each(batch):
            spans = []
            columns = batch.column("spans").to_pylist(), batch.column("candidates").to_pylist()
            for base, left in zip(*columns, strict=True):
                more = [
                    {"kind": "markov", "start": c["start"], "stop": c["stop"]}
                    for c in left
                    if len(set(c["token"])) >= least_kinds and score(c["token"], ratios) >= least_ratio
                ]
                spans.append(
                    sorted([*base, *more], key=lambda s: (s["start"], KINDS.index(s["kind"])))
                )
            return {"doc_id": batch.column("doc_id"), "spans": spans}

        return each

    ddl = "doc_id bigint, spans array<struct<kind:string,start:int,stop:int>>"
    return by_batch(scanned.select("doc_id", "spans", "candidates"), work, ddl)


def digest(found: DataFrame) -> DataFrame:
    """The columns of query op1 from the findings."""

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS if k != "markov"],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("markov"),
    )
