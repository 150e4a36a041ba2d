"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Terms of a text (hashed words, triples of character classes, repetition) are weighted by
(1 + log count) * inverse document frequency and scaled to unit length in each of the three blocks.
A truncated singular value decomposition of labelled documents gives the latent space. Every document
is projected, its cosines with all labelled vectors are computed exactly, block by block, and the
labels of the `neighbours` nearest ones vote, weighted by a power of their similarity.

The labelled vectors are fitted on a bounded sample: at most `per_label` documents of each label,
those with the lowest hash of doc_id. So what is collected and broadcast has a fixed size. All
documents are scored, whole.

Null and empty texts have no terms and get a score
of 0.5: nothing speaks for either label. Labels that contradict each other for one doc_id are
left out; a doc_id that stands in several rows of documents teaches by its first text. Repeated rows
are scored each. With no label to learn from, every score is 0.5. An empty table gives an empty
result. Only doc_id and text of documents are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payscope.llm.common import by_batch, slices, texts
from payscope.llm.features import BLOCKS, TERMS, Terms

BLOCK_WEIGHTS = (0.3, 1.0, 0.7)
SALTS = 64


def held_out(doc_id: Column) -> Column:
    """Every fifth document by checksum of its id is kept from training; a null id is, too."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """text and label (0 or 1) of at most `per_label` documents of each label, none held out."""
    agreed = (
        labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .filter(F.col("label") == F.col("other"))
        .select(F.col("doc_id").cast("long").alias("labelled"), "label")
    )
    # Labels may be there for documents that are not: those are left out before the choice.
    present = agreed.join(docs.select("doc_id"), F.col("labelled") == F.col("doc_id"), "left_semi")
    # Cut within salted parts first, so that the last cut sees SALTS * per_label rows at most.
    hashed = present.withColumn("order", F.xxhash64("labelled"))
    hashed = hashed.withColumn("salt", F.pmod("order", F.lit(SALTS)))
    chosen = hashed
    for part in (["label", "salt"], ["label"]):
        order = Window.partitionBy(*part).orderBy("order", "labelled")
        chosen = chosen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_label)
    bounded = F.broadcast(chosen.select("labelled", "label"))  # at most 2 * per_label rows
    return (
        texts(docs)
        .join(bounded, F.col("doc_id") == F.col("labelled"))
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.first("label").alias("label"))
    )


@dataclass
class Model:
    projection: np.ndarray  # (terms, dimensions), already weighted by inverse document frequency
    vectors: np.ndarray  # (labelled documents, dimensions), unit length
    labels: np.ndarray
    weights: np.ndarray  # inverse document frequency


def _weighted(term: np.ndarray, value: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = value * idf[term]
    for (first, stop), weight in zip(BLOCKS, BLOCK_WEIGHTS, strict=True):
        a, b = np.searchsorted(term, (first, stop))
        norm = np.linalg.norm(value[a:b])
        if norm:
            value[a:b] *= weight / norm
    return value


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit(sample: DataFrame, dimensions: int = 64, seed: int = 7) -> Model | None:
    """The latent space and the labelled vectors; terms are taken in the tasks, not on the driver."""

    def work():
        terms = Terms()

        def each(batch):
            made = [terms(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            return {
                "doc_id": batch.column("doc_id"),
                "label": batch.column("label"),
                "term": [t for t, _ in made],
                "value": [v for _, v in made],
            }

        return each

    ddl = "doc_id bigint, label int, term array<int>, value array<float>"
    taken = by_batch(sample.select("doc_id", F.col("label").cast("int").alias("label"), "text"), work, ddl)
    rows = taken.toArrow().sort_by("doc_id").combine_chunks()  # at most 2 * per_label rows, in arrays
    rows = rows.filter(pc.greater(pc.list_value_length(rows["term"]), 0))
    if not rows.num_rows:
        return None
    labels = rows["label"].to_numpy().astype(np.float32)
    terms_of = [t.values.to_numpy() for t in rows["term"]]
    values_of = [v.values.to_numpy() for v in rows["value"]]
    frequency = np.zeros(TERMS)
    for term in terms_of:
        frequency[term] += 1
    idf = (np.log((1 + len(terms_of)) / (1 + frequency)) + 0.1).astype(np.float32)
    matrix = np.zeros((len(terms_of), TERMS), np.float32)
    for n, (term, value) in enumerate(zip(terms_of, values_of, strict=True)):
        matrix[n, term] = _weighted(term, value, idf)
    del rows, terms_of, values_of
    random = np.random.default_rng(seed)
    width = min(dimensions + 16, len(matrix))
    basis = np.linalg.qr(matrix @ random.standard_normal((TERMS, width)).astype(np.float32))[0]
    for _ in range(3):
        basis = np.linalg.qr(matrix @ (matrix.T @ basis))[0]
    right = np.linalg.svd(basis.T @ matrix, full_matrices=False)[2]
    projection = np.ascontiguousarray(right[:dimensions].T.astype(np.float32))
    return Model(projection, _unit(matrix @ projection), labels, idf)


def scorer(model: Model | None, neighbours: int = 15, power: int = 4, block: int = 512):
    """A function, for one task, from a column of texts to their scores."""
    terms = Terms()

    def votes(vectors: np.ndarray) -> np.ndarray:
        cosines = _unit(vectors) @ model.vectors.T
        k = min(neighbours, cosines.shape[1])
        nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosines, nearest, 1), 0, None) ** power
        total = weight.sum(axis=1)
        share = (weight * model.labels[nearest]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where(total > 0, share, 0.5)

    def scores_of(every: pa.Array) -> np.ndarray:
        every = every.cast(pa.binary())
        scores = np.full(len(every), 0.5)
        for at in range(0, len(every) if model else 0, block):
            part = every[at : at + block].to_pylist()
            vectors = np.zeros((len(part), model.projection.shape[1]), np.float32)
            for n, text in enumerate(part):
                term, value = terms(text or b"")
                if len(term):
                    vectors[n] = _weighted(term, value, model.weights) @ model.projection[term]
            scores[at : at + len(part)] = votes(vectors)
        return np.clip(scores, 0, 1)

    return scores_of


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every document."""

    def work():
        scores_of = scorer(model)
        return lambda batch: {"doc_id": batch.column("doc_id"), "score": pa.array(scores_of(batch.column("text")))}

    return by_batch(texts(docs), work, "doc_id bigint, score double")


def accepted(docs: DataFrame, labels: DataFrame, per_label: int = 1500, least: float = 0.3) -> DataFrame:
    """The rows of documents, with all their columns, whose score is at least `least`."""
    model = fit(labelled_sample(docs, labels, "quality", per_label))

    def run(batches):
        scores_of = scorer(model)
        for batch in slices(batches):
            yield batch.filter(pa.array(scores_of(batch.column("text")) >= least))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, per_label: int = 1500, least: float = 0.3) -> DataFrame:
    """The columns of query op7."""
    model = fit(labelled_sample(docs, labels, "quality", per_label))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
