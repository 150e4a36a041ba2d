"""Language identification as a mixture: every document has proportions of the learned languages.

A language is a distribution of character triples within words (letters only, lower case, a border
before and after each word), hashed to `TRIPLES` numbers and counted over every labelled document;
`SHARED` of it is the average over all languages, so that a triple that no language has speaks for
none. A word's likelihood in a language is the product of its triples' probabilities.

A document's words are drawn from a mixture of languages. Expectation-maximisation over all languages
gives first proportions, whose order names the candidate sets: the first language, the first two and so
on. The proportions of each set are estimated anew, and a larger set is taken while the log-likelihood
less `penalty` * log(words) for each further language grows (the Bayesian information criterion at
0.5). Each document stops when none of its proportions moves by more than `TOLERANCE`, so a result does
not depend on the documents it is computed with.

Only text and lang of labelled documents teach: those with a lang, an id and a checksum remainder other
than 2. Counts are added up by Spark; what reaches the driver and the tasks is one number for each
language and triple at most. A document is `und` with score 0 and no languages if its text is null or
holds no letter, or if nothing was learned. Equal shares go by name. Repeated rows are documents of
their own. Rows without an id are held out. An empty table gives an empty result. Only doc_id, text and
lang are read, so further columns, whatever their names, change nothing.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payscope.llm.common import by_batch, portions, slices

TRIPLES = 1 << 16
SHARED = 0.02
TOLERANCE = 1e-3
ROUNDS = 200
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """One document in four by checksum of its id; a null id is, too."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


@functools.cache
def _letters() -> np.ndarray:
    """For each code point whether it belongs to words."""
    table = np.zeros(0x110000, bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table[np.frombuffer("".join(_WORD.findall(every)).encode("utf-32-le"), np.uint32)] = True
    return table


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the triples of all words of all texts, where each word begins, and its text."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[points]
    kept = np.where(inside, points, np.uint32(0))
    place = np.flatnonzero(inside)
    hashed = kept[place - 1] * np.uint32(0x9E3779B1) + kept[place] * np.uint32(0x85EBCA6B)
    hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0xC2B2AE35) + kept[place + 1] * np.uint32(0x27D4EB2F)
    hashed = (hashed ^ (hashed >> np.uint32(13))) * np.uint32(0x165667B1)
    begin = np.flatnonzero(~inside[place - 1])
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    return hashed >> np.uint32(16), begin, np.searchsorted(ends, place[begin], side="right")


@dataclass
class Model:
    languages: list[str]
    log_probability: np.ndarray  # (TRIPLES, languages)


def counted(labelled: DataFrame) -> DataFrame:
    """lang, triple, n: how often each triple occurs in all texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text")
            for part in portions(pc.binary_length(texts).to_pylist(), 4 << 20):
                said: dict[str, list[str]] = {}
                for n in part:
                    said.setdefault(langs[n], []).append(texts[n].as_py())
                for lang, own in said.items():
                    number, begin, _ = triples(own)
                    if len(begin):
                        sums.setdefault(lang, np.zeros(TRIPLES, np.int64))
                        sums[lang] += np.bincount(number, minlength=TRIPLES)
        for lang, counts in sums.items():
            seen_triples = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(seen_triples), pa.string()),
                    pa.array(seen_triples, pa.int32()),
                    pa.array(counts[seen_triples], pa.int64()),
                ],
                names=["lang", "triple", "n"],
            )

    parts = labelled.mapInArrow(run, "lang string, triple int, n long")
    return parts.groupBy("lang", "triple").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> Model | None:
    """Learn from every document with a text and a language that is not held out."""
    labelled = docs.filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    ).select("text", "lang")
    rows = counted(labelled).toArrow()  # at most one row for each language and triple
    if not rows.num_rows:
        return None
    languages = sorted(rows["lang"].unique().to_pylist())
    place = {lang: n for n, lang in enumerate(languages)}
    encoded = rows["lang"].combine_chunks().dictionary_encode()
    column = np.array([place[x] for x in encoded.dictionary.to_pylist()])[encoded.indices.to_numpy()]
    counts = np.zeros((TRIPLES, len(languages)))
    counts[rows["triple"].to_numpy(), column] = rows["n"].to_numpy()
    own = counts / counts.sum(axis=0)
    shared = 0.99 * own.mean(axis=1, keepdims=True) + 0.01 / TRIPLES
    return Model(languages, np.log((1 - SHARED) * own + SHARED * shared).astype(np.float32))


def mixture(likelihood: np.ndarray, begin: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Proportions by expectation-maximisation, from the given ones on.

    `likelihood` has a row for each word of each document (scaled by any factor of the row); the
    words of document d start at `begin[d]`. A proportion of zero stays zero.
    """
    share = share.copy()
    left = np.arange(len(begin))
    length = np.diff(np.append(begin, len(likelihood)))
    ones = np.ones(likelihood.shape[1])  # products with it are faster than sums of short rows
    for _ in range(ROUNDS):
        mixed = likelihood * np.repeat(share[left], length, axis=0)
        mixed /= (mixed @ ones)[:, None]
        new = np.add.reduceat(mixed, begin, axis=0) / length[:, None]
        moving = np.abs(new - share[left]).max(axis=1) > TOLERANCE
        share[left] = new
        if not moving.any():
            break
        if not moving.all():
            likelihood = likelihood[np.repeat(moving, length)]
            left, length = left[moving], length[moving]
            begin = np.cumsum(length) - length
    return share


def fit(scores: np.ndarray, begin: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions (documents, languages) of the language sets with the best penalised likelihood.

    `scores` has the log-likelihood of each word of each document in every language.
    """
    likelihood = np.exp(scores - functools.reduce(np.maximum, scores.T)[:, None])  # the factor is the same for all sets
    length = np.diff(np.append(begin, len(scores)))
    n_languages = scores.shape[1]
    whole = np.full((len(begin), n_languages), 1 / n_languages)
    order = np.argsort(-mixture(likelihood, begin, whole), axis=1, kind="stable")
    price = penalty * np.log(np.maximum(2, length))

    def fitness(likelihood: np.ndarray, begin: np.ndarray, share: np.ndarray) -> np.ndarray:
        length = np.diff(np.append(begin, len(likelihood)))
        sums = (likelihood * np.repeat(share, length, axis=0)) @ np.ones(likelihood.shape[1])
        return np.add.reduceat(np.log(np.maximum(sums, 1e-300)), begin)

    chosen = np.zeros_like(whole)
    chosen[np.arange(len(begin)), order[:, 0]] = 1
    value = fitness(likelihood, begin, chosen)
    places = np.arange(len(begin))  # documents that may still take one more language
    for k in range(2, n_languages + 1):
        share = np.zeros((len(places), n_languages))
        np.put_along_axis(share, order[places, :k], 1 / k, axis=1)
        share = mixture(likelihood, begin, share)
        now = fitness(likelihood, begin, share) - price[places] * (k - 1)
        better = now > value[places]
        chosen[places[better]], value[places[better]] = share[better], now[better]
        if not better.any():
            break
        likelihood = likelihood[np.repeat(better, length[places])]
        places = places[better]
        begin = np.cumsum(length[places]) - length[places]
    return chosen


def scorer(model: Model, penalty: float) -> Callable[[list[str]], np.ndarray]:
    """Proportions (texts, languages) of texts; a text without words has zeros."""

    def shares_of(every: list[str]) -> np.ndarray:
        result = np.zeros((len(every), len(model.languages)))
        triple, begin, of = triples(every)
        if len(begin):
            scores = np.add.reduceat(model.log_probability[triple], begin, axis=0).astype(float)
            spoken, first = np.unique(of, return_index=True)
            result[spoken] = fit(scores, first, penalty)
        return result

    return shares_of


def identify(docs: DataFrame, model: Model | None, penalty: float = 0.5) -> DataFrame:
    """doc_id, lang_pred, score (the share of that language) and languages (lang, share) of every row.

    `languages` is the chosen set, largest share first.
    """
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.when(has_letter, F.col("text")).alias("text"))

    def work():
        names = np.array(model.languages, dtype=object) if model else None
        shares_of = scorer(model, penalty) if model else None
        most = (32 << 20) // max(8, len(model.languages)) if model else 0

        def each(batch):
            every = batch.column("text")
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            lengths = pc.fill_null(pc.binary_length(every), 0).to_pylist()
            for part in portions(lengths, most) if model else []:
                spoken = [n for n in part if lengths[n]]
                if not spoken:
                    continue
                shares = shares_of([every[n].as_py() for n in spoken])
                order = np.argsort(-shares, axis=1, kind="stable")
                for n, share, by_size in zip(spoken, shares, order, strict=True):
                    found[n] = [
                        {"lang": names[x], "share": min(1.0, float(share[x]))} for x in by_size if share[x] > 0
                    ]
            return {
                "doc_id": batch.column("doc_id"),
                "lang_pred": [f[0]["lang"] if f else UNKNOWN for f in found],
                "score": [f[0]["share"] if f else 0.0 for f in found],
                "languages": found,
            }

        return each

    ddl = "doc_id bigint, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return by_batch(rows, work, ddl)


def classify(docs: DataFrame, penalty: float = 0.5) -> DataFrame:
    """The columns of query op11, and the chosen languages with their shares."""
    return identify(docs, learn(docs), penalty).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages"
    )
