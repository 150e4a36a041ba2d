"""Hard-negative mining with cover trees over norm-augmented candidates.

Every candidate x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that all lie
on one sphere and the angle t between x and an anchor q (with 0 there) gives the inner product
|q| * M * cos(t). A node of a cover tree has a centre and a covering angle a that holds all its
candidates, so their inner products lie between |q| * M * cos(t + a) and |q| * M * cos(t - a), t now the
centre's angle. On each level a node's children are a net of centres of half its covering angle; each
candidate belongs to the nearest one, and the covering angle is taken from the candidates it has.

An anchor's windows are ranges of scores of which the best k are asked: for the positives one window
without limits, for the negatives one window per positive. Descent is best first: nodes with the highest
bounds are opened first, nodes outside of every window or below its k-th best score so far, or without
the label asked for, are skipped, and the candidates of leaves are verified by exact integer products.

The tree has two parts. Its upper level is a bounded number of regions (`REGIONS` centres, chosen
farthest first from a sample of about `SAMPLE` rows; every row goes to its nearest one, and covering
angles are those of all rows). A region's rows are dealt to shards of about `SHARD` rows, each with a
tree of its own, which is stored once. An anchor first visits its nearest region, which gives
thresholds, then the other regions that its windows still meet. The candidates of a shard and its
anchors meet sorted in one partition, and the anchors are streamed past the tree, so neither a hot
region nor many anchors must fit into memory.

How much is skipped depends on the data: clusters narrower than the gaps between them are skipped as a
whole, but vectors spread evenly over many dimensions are all about a right angle apart, and no covering
angle separates them.

Rows with a null id, label or vector, or a null or non-finite component take no part. Only vectors of
equal length are compared. Ties go to the smaller vec_id. Repeated rows are rows of their own: an anchor
is kept from itself alone, and repeated anchors are each answered. An empty table gives an empty result.
Only the named columns are read, so further ones, whatever their names, change nothing. Scores must fit a
long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payscope.llm.common import ratio_up, staged

SHARD = 8192
REGIONS = 1024
SAMPLE = 8192
LEAF = 16  # candidates that are not divided further
PORTION = 8, 128  # nodes that are opened at once: at first, and after doubling
SLACK = 1e-7  # of an angle, for rounding

LOWEST = np.iinfo(np.int64).min // 4
HIGHEST = np.iinfo(np.int64).max // 4


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, vec (integer components) and dim of the rows that take part."""
    vector = F.col("embedding")
    sound = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    )
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vector.isNotNull()
    return embeddings.filter(whole & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("vec"),
        F.size(vector).alias("dim"),
    )


def augmented(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Points of the unit sphere: vectors over the largest norm, with what they lack as one more component."""
    points = vectors.astype(float) / norm
    lacking = np.sqrt(np.clip(1 - np.einsum("ij,ij->i", points, points), 0, None))
    return np.column_stack([points, lacking])


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def net(points: np.ndarray, angle: float, block: int = 512) -> np.ndarray:
    """Places of centres, more than `angle` apart, that leave no point farther than it from all of them.

    The first point is a centre.
    """
    near = np.cos(angle)
    centres = np.array([0])
    for at in range(0, len(points), block):
        part = points[at : at + block]
        open_ = np.flatnonzero((part @ points[centres].T).max(axis=1) < near)
        apart = part[open_] @ part[open_].T < near
        left = np.ones(len(open_), bool)
        chosen = []
        for n in range(len(open_)):
            if left[n]:
                chosen.append(at + open_[n])
                left &= apart[n]
        centres = np.append(centres, np.array(chosen, np.int64))
    return centres


def nearest(points: np.ndarray, centres: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """For each point the number of its nearest centre and the angle to it."""
    number, angle = np.zeros(len(points), np.int64), np.zeros(len(points))
    for at in range(0, len(points), block):
        cosines = points[at : at + block] @ centres.T
        best = cosines.argmax(axis=1)
        number[at : at + block] = best
        angle[at : at + block] = angles(cosines[np.arange(len(best)), best])
    return number, angle


NODE = ("centre", "child", "children", "begin", "stop", "least", "most")


@dataclass
class Tree:
    """Candidates in the order of the leaves, and nodes with their children side by side."""

    vectors: np.ndarray
    vec_id: np.ndarray
    row_id: np.ndarray
    label: np.ndarray
    nodes: np.ndarray  # (nodes, NODE): centre is a place among the candidates
    angle: np.ndarray  # covering angle of each node
    norm: float

    def __post_init__(self) -> None:
        self.centre, self.child, self.children, self.begin, self.stop, self.least, self.most = (
            np.ascontiguousarray(self.nodes.T)
        )
        # Products below 2**53 are exact as doubles, which are faster than longs.
        self.biggest = int(np.abs(self.vectors).max(initial=0))
        self.as_float = self.vectors.astype(float)
        self.centres = self.as_float[self.centre]

    def products(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.biggest * int(np.abs(query).max(initial=0)) * max(1, len(query)) < 1 << 53:
            return (self.as_float[places] @ query.astype(float)).astype(np.int64)
        return self.vectors[places] @ query


def build(vectors: np.ndarray, vec_id: np.ndarray, row_id: np.ndarray, label: np.ndarray, norm: float) -> Tree:
    """The cover tree of a shard; ids in leaves ascend."""
    points = augmented(vectors, norm)
    place = np.lexsort((row_id, vec_id))  # candidates, later in the order of the leaves
    nodes: list[list[int]] = [[0] * len(NODE)]
    cover = [0.0]
    # Node, its range of `place`, and its centre, breadth first so that children stand side by side.
    waiting = [(0, 0, len(place), int(place[0]))]
    while waiting:
        later = []
        for node, begin, stop, centre in waiting:
            own = place[begin:stop]
            reach = angles(points[own] @ points[centre])
            widest = float(reach.max())
            labels = label[own]
            row = [centre, 0, 0, begin, stop, int(labels.min()), int(labels.max())]
            if stop - begin > LEAF and widest > 4 * SLACK:
                first = np.concatenate([[centre], own[own != centre]])
                centres = first[net(points[first], widest / 2)]
                number, _ = nearest(points[own], points[centres])
                order = np.argsort(number, kind="stable")
                place[begin:stop] = own[order]
                used, cuts = np.unique(number[order], return_index=True)
                bounds = [*(cuts + begin).tolist(), stop]
                row[1:3] = [len(nodes), len(used)]
                for n, c in enumerate(used):
                    later.append((len(nodes), bounds[n], bounds[n + 1], int(centres[c])))
                    nodes.append([])
                    cover.append(0.0)
            nodes[node], cover[node] = row, 0.0 if widest <= SLACK else widest + SLACK
        waiting = later
    where = np.empty(len(place), np.int64)
    where[place] = np.arange(len(place))
    table = np.array(nodes, np.int64)
    table[:, 0] = where[table[:, 0]]
    return Tree(vectors[place], vec_id[place], row_id[place], label[place], table, np.array(cover), norm)


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, one range after the other."""
    return np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)


def reach(cosine: np.ndarray, angle: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score within `angle` (and the rounding) of a centre with that cosine."""
    at, wide = angles(cosine), angle + SLACK
    slack = 1e-9 * scale
    return (
        scale * np.cos(np.minimum(np.pi, at + wide)) - slack,
        scale * np.cos(np.maximum(0, at - wide)) + slack,
    )


def wanted(least: np.ndarray, most: np.ndarray, label: int, same: bool) -> np.ndarray:
    """Whether labels from least to most may hold the anchor's own one, or another one."""
    return (least <= label) & (label <= most) if same else (least != label) | (most != label)


def descend(
    tree: Tree, row: int, query: np.ndarray, label: int, same: bool, low: np.ndarray, high: np.ndarray,
    floor: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Windows, places and scores of the k best candidates of each window, and the number verified.

    A window takes scores from low to high; those below `floor` are known to be beaten already.
    """
    scale = tree.norm * float(np.sqrt((query.astype(float) ** 2).sum()))
    as_float = query.astype(float)
    floor = np.maximum(floor, low)
    places = [np.zeros(0, np.int64)] * len(low)
    scores = [np.zeros(0, np.int64)] * len(low)
    nodes = np.zeros(1, np.int64) if wanted(tree.least[0], tree.most[0], label, same) else np.zeros(0, np.int64)
    least, most = np.full(len(nodes), -np.inf), np.full(len(nodes), np.inf)
    verified, (portion, largest) = 0, PORTION
    while len(nodes):
        meets = ((least[:, None] <= high) & (most[:, None] >= floor) & (floor <= high)).any(axis=1)
        nodes, least, most = nodes[meets], least[meets], most[meets]
        if len(nodes) > portion:
            first = np.zeros(len(nodes), bool)
            first[np.argpartition(-np.minimum(most, high.max()), portion)[:portion]] = True
        else:
            first = np.ones(len(nodes), bool)
        portion = min(largest, 2 * portion)
        opened = nodes[first]
        nodes, least, most = nodes[~first], least[~first], most[~first]
        leaf = tree.children[opened] == 0
        here = opened[leaf]
        if len(here):
            at = _ranges(tree.begin[here], tree.stop[here] - tree.begin[here])
            at = at[((tree.label[at] == label) == same) & (tree.row_id[at] != row)]
            exact = tree.products(at, query)
            verified += len(at)
            for w in range(len(low)):
                fits = (exact >= floor[w]) & (exact <= high[w])
                if not fits.any():
                    continue
                place = np.concatenate([places[w], at[fits]])
                score = np.concatenate([scores[w], exact[fits]])
                best = np.lexsort((tree.row_id[place], tree.vec_id[place], -score))[:k]
                places[w], scores[w] = place[best], score[best]
                if len(best) == k:
                    floor[w] = max(floor[w], score[best[-1]])
        inner = opened[~leaf]
        if len(inner):
            kids = _ranges(tree.child[inner], tree.children[inner])
            if len(inner) == 1:
                product = tree.centres[kids[0] : kids[-1] + 1] @ as_float
            else:
                product = tree.centres[kids] @ as_float
            right = wanted(tree.least[kids], tree.most[kids], label, same)
            kids, product = kids[right], product[right]
            down, up = reach(product / (scale or 1.0), tree.angle[kids], scale)
            nodes = np.concatenate([nodes, kids])
            least, most = np.concatenate([least, down]), np.concatenate([most, up])
    window = np.repeat(np.arange(len(low)), [len(p) for p in places])
    return window, np.concatenate([*places]), np.concatenate([*scores]), verified


RECORD = "shard string, kind int, seq long, ints array<bigint>, angle double"


def _table(rows: pa.ListArray, width: int) -> np.ndarray:
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), width)


@dataclass
class Index:
    """The stored trees and their upper level."""

    trees: DataFrame  # RECORD: kind 0 candidates, kind 1 nodes
    shards: DataFrame  # dim, region, parts
    centres: dict[int, np.ndarray]  # by dim, augmented
    reach: dict[int, np.ndarray]  # by dim: covering angle, least and most label of each region
    norm: float


def _in_regions(rows: DataFrame, centres: dict[int, np.ndarray], norm: float) -> DataFrame:
    """The rows with the region (its nearest centre) and the angle to it; without a centre: -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            region, angle = np.full(len(dims), -1), np.full(len(dims), np.pi)
            for dim in set(dims.tolist()) & set(centres):
                own = np.flatnonzero(dims == dim)
                vectors = _table(batch.column("vec").take(pa.array(own)), dim)
                region[own], angle[own] = nearest(augmented(vectors, norm), centres[dim])
            columns = [*batch.columns, pa.array(region, pa.int32()), pa.array(angle)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "region", "angle"])

    ddl = "row_id long, vec_id long, label long, vec array<bigint>, dim int, region int, angle double"
    return rows.mapInArrow(run, ddl)


def _farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Places of n points, each the farthest from those before it; fewer if all others are equal to them."""
    chosen, closest = [0], points @ points[0]
    while len(chosen) < n:
        far = int(closest.argmin())
        if closest[far] > 1 - 1e-12:
            break
        chosen.append(far)
        closest = np.maximum(closest, points @ points[far])
    return np.array(chosen)


def _key() -> Column:
    return F.concat_ws("-", "dim", "region", "part")


def index(rows: DataFrame, shard_rows: int = SHARD) -> Index:
    """Trees over rows (row_id, vec_id, label, vec, dim)."""
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, largest = rows.agg(F.count("*"), F.max(square)).first()
    norm = float(largest or 0.0) ** 0.5 * (1 + 1e-12) or 1.0
    n_regions = min(REGIONS, ratio_up(n, shard_rows))
    few = F.pmod(F.xxhash64("row_id", F.lit("sample")), F.lit(ratio_up(n, SAMPLE))) == 0
    sample = rows.filter(few).select("dim", "vec").limit(2 * SAMPLE).toArrow()  # bounded
    centres = {}
    for dim in set(sample["dim"].to_pylist()) - {0}:
        vectors = _table(sample.filter(pc.equal(sample["dim"], dim))["vec"].combine_chunks(), dim)
        vectors = vectors[np.lexsort(vectors.T)]
        points = augmented(vectors, norm)
        share = max(1, n_regions * len(points) // sample.num_rows)
        centres[dim] = points[_farthest_first(points, share)]
    placed = staged(_in_regions(rows, centres, norm), "regions")
    regions = staged(
        placed.groupBy("dim", "region").agg(
            F.count("*").alias("rows"),
            F.max("angle").alias("angle"),
            F.min("label").alias("least"),
            F.max("label").alias("most"),
        ),
        "region-sizes",
    )
    shards = regions.select("dim", "region", F.ceil(F.col("rows") / shard_rows).cast("int").alias("parts"))
    covering = {dim: np.tile([0.0, 1, 0], (len(c), 1)) for dim, c in centres.items()}
    for r in regions.filter("region >= 0").collect():  # as many as there are centres
        covering[r["dim"]][r["region"]] = r["angle"] + SLACK, r["least"], r["most"]
    dealt = (
        placed.join(shards, ["dim", "region"])
        .withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int"))
        .select(_key().alias("shard"), "row_id", "vec_id", "label", "vec", "dim")
    )

    def plant(rows: pa.Table) -> pa.Table:
        dim = rows["dim"][0].as_py()
        own = [rows[c].to_numpy() for c in ("vec_id", "row_id", "label")]
        tree = build(_table(rows["vec"].combine_chunks(), dim), *own, norm)
        candidates = np.column_stack([tree.vec_id, tree.row_id, tree.label, tree.vectors])
        size, n_nodes = len(candidates), len(tree.nodes)

        def lists(table: np.ndarray) -> pa.Array:
            ends = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(table.ravel()))

        return pa.table(
            {
                "shard": pa.array([rows["shard"][0].as_py()] * (size + n_nodes)),
                "kind": pa.array(np.repeat([0, 1], [size, n_nodes]), pa.int32()),
                "seq": pa.array(np.concatenate([np.arange(size), np.arange(n_nodes)])),
                "ints": pa.concat_arrays([lists(candidates), lists(tree.nodes)]),
                "angle": pa.array(np.concatenate([np.zeros(size), tree.angle])),
            }
        )

    trees = staged(dealt.groupBy("shard").applyInArrow(plant, RECORD), "trees")
    return Index(trees, shards, centres, covering, norm)


def _visits(asked: DataFrame, made: Index, same: bool, first: bool) -> DataFrame:
    """Anchors with each region to visit: the nearest one, or the others that a window still meets."""
    centres, covering, norm = made.centres, made.reach, made.norm

    def of(dim: int, query: np.ndarray, label: int, low, high, floor) -> list[int]:
        if dim not in centres:
            return [-1] if first else []
        scale = norm * float(np.sqrt((query.astype(float) ** 2).sum()))
        cosine = centres[dim][:, :-1] @ query.astype(float) * (norm / (scale or 1.0))
        angle, least_label, most_label = covering[dim].T
        right = wanted(least_label, most_label, label, same) & (least_label <= most_label)
        nearest_one = int(np.argmax(np.where(right, cosine, -2)))
        if first:
            return [nearest_one] if right[nearest_one] else []
        least, most = reach(cosine, angle, scale)
        floor = np.maximum(floor, low)
        meets = ((least[:, None] <= high) & (most[:, None] >= floor) & (floor <= high)).any(axis=1) & right
        meets[nearest_one] = False
        return np.flatnonzero(meets).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ask = batch.to_pydict()
            every = [
                of(dim, np.array(vec, np.int64), label, np.array(low), np.array(high), np.array(floor))
                for dim, vec, label, low, high, floor in zip(
                    *(ask[c] for c in ("dim", "vec", "label", "low", "high", "floor")), strict=True
                )
            ]
            columns = [*batch.columns, pa.array(every, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "regions"])

    ddl = (
        "row_id long, vec_id long, label long, vec array<bigint>, dim int, low array<bigint>, "
        "high array<bigint>, floor array<bigint>, regions array<int>"
    )
    visits = asked.select("row_id", "vec_id", "label", "vec", "dim", "low", "high", "floor").mapInArrow(run, ddl)
    return (
        visits.withColumn("region", F.explode("regions"))
        .drop("regions")
        .join(made.shards, ["dim", "region"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("shard", _key())
    )


def _meet(visits: DataFrame, made: Index, same: bool, k: int) -> DataFrame:
    """anchor_row, window, row_id, vec_id and score of what each visited shard has to offer."""
    spark, norm = visits.sparkSession, made.norm
    none = F.lit(None).cast("array<bigint>")
    candidates = made.trees.select("*", none.alias("low"), none.alias("high"), none.alias("floor"))
    anchors = visits.select(
        "shard",
        F.lit(2).alias("kind"),
        F.col("row_id").alias("seq"),
        F.concat(F.array("vec_id", "row_id", "label"), "vec").alias("ints"),
        F.lit(0.0).alias("angle"),
        "low",
        "high",
        "floor",
    )
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = (
        candidates.unionByName(anchors).repartition(n_parts, "shard").sortWithinPartitions("shard", "kind", "seq")
    )
    names = ["anchor_row", "window", "row_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, {0: [], 1: []}, None

        def planted() -> Tree:
            rows = pa.concat_arrays([r for r, _ in held[0]])
            nodes = pa.concat_arrays([r for r, _ in held[1]])
            table = _table(rows, len(rows[0]))
            angle = np.concatenate([a for _, a in held[1]])
            vec_id, row_id, label = (np.ascontiguousarray(table[:, n]) for n in range(3))
            vectors = np.ascontiguousarray(table[:, 3:])
            return Tree(vectors, vec_id, row_id, label, _table(nodes, len(NODE)), angle, norm)

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            codes = batch.column("shard").dictionary_encode()
            code = codes.indices.to_numpy()
            edge = np.flatnonzero((code[1:] != code[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            made_here: list[list[np.ndarray]] = []
            for begin, stop in zip([0, *edge], [*edge, len(kinds)], strict=True):
                if begin == stop:
                    continue
                name, kind = codes.dictionary[code[begin]].as_py(), int(kinds[begin])
                if name != shard:
                    shard, held, tree = name, {0: [], 1: []}, None
                part = batch.slice(begin, stop - begin)
                if kind < 2:
                    held[kind].append((part.column("ints"), part.column("angle").to_numpy()))
                    continue
                if tree is None:
                    tree = planted()
                    held = {0: [], 1: []}
                asked = _table(part.column("ints"), tree.vectors.shape[1] + 3)
                windows = [part.column(c).to_pylist() for c in ("low", "high", "floor")]
                for n, row in enumerate(asked):
                    limits = [np.array(w[n], np.int64) for w in windows]
                    window, place, score, _ = descend(tree, int(row[1]), row[3:], int(row[2]), same, *limits, k)
                    own = np.full(len(place), row[1])
                    made_here.append([own, window, tree.row_id[place], tree.vec_id[place], score])
            columns = [np.concatenate([m[c] for m in made_here] or [np.zeros(0, np.int64)]) for c in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return together.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def best(asked: DataFrame, made: Index, same: bool, k: int) -> DataFrame:
    """anchor_row, window, place (from 1), row_id, vec_id and score: the k best of each anchor's windows.

    `asked` has row_id, vec_id, label, vec, dim and the windows as arrays low and high. Candidates have
    the anchor's label (`same`) or another one.
    """
    order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "vec_id", "row_id")

    def cut(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)

    open_ = asked.withColumn("floor", F.col("low"))
    first = staged(cut(_meet(_visits(open_, made, same, first=True), made, same, k)), "first")
    # The k-th best of a window so far; an anchor has few windows, so its map is small.
    reached = (
        first.filter(F.col("place") == k)
        .groupBy(F.col("anchor_row").alias("row_id"))
        .agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    )
    raised = F.transform("low", lambda x, w: F.coalesce(F.try_element_at("reached", w.cast("long")), x))
    later = open_.join(reached, "row_id", "left").withColumn(
        "floor", F.when(F.col("reached").isNull(), F.col("low")).otherwise(raised)
    )
    rest = _meet(_visits(later, made, same, first=False), made, same, k)
    return cut(first.drop("place").unionByName(rest))


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    least_percent: int = 30,
    most_percent: int = 90,
    shard_rows: int = SHARD,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `rows` has vec_id, label, vec and dim as made by `quantised`. An anchor's positives are its best
    other rows of the same label; for each of them the best rows of other labels are returned whose
    score is between `least_percent` and `most_percent` of the positive's.
    """
    rows = staged(
        rows.select(F.monotonically_increasing_id().alias("row_id"), "vec_id", "label", "vec", "dim"), "vectors"
    )
    made = index(rows, shard_rows)
    anchors = rows.filter(is_anchor)
    everything = anchors.withColumns(
        {"low": F.array(F.lit(LOWEST).cast("long")), "high": F.array(F.lit(HIGHEST).cast("long"))}
    )
    near = staged(best(everything, made, same=True, k=positives), "positives")

    def hundredth(x: Column) -> Column:
        """x / 100, rounded down."""
        return ((x - F.pmod(x, F.lit(100))) / 100).cast("long")

    # 100 * negative lies between percent * positive: the whole numbers between the bounds.
    low = F.transform("positives", lambda p: -hundredth(-p["score"] * least_percent))
    high = F.transform("positives", lambda p: hundredth(p["score"] * most_percent))
    per_anchor = near.groupBy(F.col("anchor_row").alias("row_id")).agg(
        F.array_sort(F.collect_list(F.struct("place", "score"))).alias("positives")
    )
    windows = anchors.join(per_anchor, "row_id").withColumns({"low": low, "high": high}).drop("positives")
    far = best(windows, made, same=False, k=negatives)
    answered = near.select(
        "anchor_row",
        (F.col("place") - 1).cast("long").alias("window"),
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    ).join(anchors.select(F.col("row_id").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    return far.join(answered, ["anchor_row", "window"]).select(
        "anchor_id",
        "positive_id",
        F.col("place").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
