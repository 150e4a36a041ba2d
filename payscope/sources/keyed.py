"""A stored table with one current row per record, changed by commits that appear whole or not at all.

The rows lie in buckets by a hash of their key. A merge reads and rewrites the buckets that its rows
fall into and no others, so a read is one scan of current rows, without any ranking of history. Sums
over the table (`views`) are kept beside it and changed by what changed: for each replaced row its old
values go out and the new ones come in, so a correction that moves a record to another group takes it out
of the old one, and a group without rows is gone.

A commit is one small file, `commits/<version>.json`, which names the folder that holds each bucket and
the views, and the last batch of every source. It gets its name last, when it is complete, and only if
that version is not there yet: a writer that breaks off before leaves folders that no commit names
(`vacuum` deletes them), readers keep the version they opened, and of two writers the second one finds
its version taken and merges again onto the new state. A batch that was applied is not applied again.
What is to be counted of the incoming rows is observed while they are written, and is part of the commit,
so it counts every batch once.

A bucket is the work of one task, so their number follows the table: a merge that could take it beyond
BUCKET_ROWS rows a bucket writes it all into new ones, with room for as many rows again, so such merges
are few. A commit holds one entry per bucket and source.

Besides the next version a merge needs disk for its new rows once aside and for the shuffle of one round:
it goes through its buckets in up to MOST_ROUNDS rounds, as many buckets at once as keep all cores busy,
and a round's shuffle files go with it. Versions stay until `retire` or `vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payscope.operators.upsert import latest
from payscope.session import shuffles_dropped
from payscope.sources.storage import CODEC, file_at, put_text

BUCKET = "bucket"
BATCH = "batch"
#: Rows of a bucket, at most on average.
BUCKET_ROWS = 1_000_000
#: Full buckets for each core in a round of a merge, and rounds at most: every round reads all new rows.
ROUND_BUCKETS = 2
MOST_ROUNDS = 16
#: Parts of the keys' hashes by which a record with very many new rows is noticed.
CELLS = 1_024


class Conflict(RuntimeError):
    """Another writer published this version first."""


@dataclass(frozen=True)
class Commit:
    version: int = 0
    schema: str = ""
    n_buckets: int = 0
    buckets: dict[str, str] = field(default_factory=dict)  # bucket: folder
    views: dict[str, list[str]] = field(default_factory=dict)  # name: columns of its groups
    sums: str = ""
    applied: dict[str, int] = field(default_factory=dict)  # source: last batch
    counts: dict[str, dict[str, int]] = field(default_factory=dict)  # source: what its batches counted
    n_rows: int | None = 0  # None: written before rows were counted


def _dims(commit: Commit) -> list[str]:
    """The columns of all views."""
    return list(dict.fromkeys(c for columns in commit.views.values() for c in columns))


@dataclass(frozen=True)
class KeyedTable:
    """`views` maps names to the columns that a sum of `measure` and a count of rows go by.

    They and `n_buckets` are those of a table that begins; later on its commits hold them, and the buckets
    grow in number with the rows.
    """

    spark: SparkSession
    path: str
    views: Mapping[str, Sequence[str]]
    key: str = "record_id"
    sequence: str = "ingest_seq"
    measure: str = "amount_usd"
    n_buckets: int = 0  # 0: as many as the session has shuffle partitions, when the table begins

    # --- commits ---------------------------------------------------------------------------------

    def _at(self, *parts: str):
        """File system and path of something below the table."""
        return file_at(self.spark, "/".join([self.path.rstrip("/"), *parts]))

    def _versions(self) -> list[int]:
        """Versions of which a file is there, newest first."""
        fs, folder = self._at("commits")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted((int(n[:-5]) for n in names if n.endswith(".json")), reverse=True)

    def commit(self, version: int | None = None) -> Commit:
        """A version, or the newest one."""
        version = version or max(self._versions(), default=0)
        if not version:
            partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            views = {name: list(columns) for name, columns in self.views.items()}
            return Commit(n_buckets=self.n_buckets or partitions, views=views)
        text = self.spark.read.text(f"{self.path}/commits/{version:020d}.json", wholetext=True).first()
        return Commit(**{"n_rows": None} | json.loads(text[0]))

    def publish(self, commit: Commit) -> None:
        """The switch: a complete file takes its name, unless another writer has taken it."""
        text = json.dumps(asdict(commit))
        try:
            put_text(self.spark, f"{self.path.rstrip('/')}/commits", f"{commit.version:020d}.json", text, replace=False)
        except FileExistsError as error:
            raise Conflict(f"version {commit.version} is there already") from error

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the folders that none of the `keep` newest versions names; returns them.

        Not for use while a merge is running: its folders are not named yet.
        """
        named = set()
        for version in self._versions()[:keep]:
            made = self.commit(version)
            named |= {*made.buckets.values(), made.sums}
        gone = []
        for kind in ("data", "views", "work"):
            fs, folder = self._at(kind)
            for found in fs.listStatus(folder) if fs.exists(folder) else []:
                name = found.getPath().getName()
                if name.removeprefix(f"{BATCH}=") not in named:
                    fs.delete(found.getPath(), True)
                    gone.append(f"{kind}/{name}")
        return gone

    def retire(self, version: int) -> None:
        """Delete the files of a version that the next one does not name; it and older ones cannot be read then."""
        if version < 1:
            return
        gone, stays = self.commit(version), self.commit(version + 1)
        folders = {f"data/{BATCH}={f}" for f in {*gone.buckets.values()} - {*stays.buckets.values()}}
        superseded = {
            f"data/{BATCH}={f}/{BUCKET}={b}"
            for b, f in gone.buckets.items()
            if stays.buckets.get(b) != f and f"data/{BATCH}={f}" not in folders
        }
        sums = {f"views/{gone.sums}"} if gone.sums and gone.sums != stays.sums else set()
        for folder in sorted(folders | superseded | sums):
            fs, path = self._at(folder)
            fs.delete(path, True)

    # --- reading ---------------------------------------------------------------------------------

    def rows(self, commit: Commit | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The current rows (of some buckets), with their sequence; None if there are none."""
        commit = commit or self.commit()
        wanted = commit.buckets if buckets is None else {str(b) for b in buckets} & commit.buckets.keys()
        if not wanted:
            return None
        folders = sorted(f"{self.path}/data/{BATCH}={commit.buckets[b]}/{BUCKET}={b}" for b in wanted)
        schema = T.StructType.fromJson(json.loads(commit.schema))
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)
        return found.select(*schema.names)

    def current(self) -> DataFrame | None:
        """One row per record, as of the newest commit; one scan. None before the first commit."""
        found = self.rows()
        return None if found is None else found.drop(self.sequence)

    def _sums(self, commit: Commit) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/views/{commit.sums}") if commit.sums else None

    def view(self, name: str) -> DataFrame | None:
        """The groups of one view with `total` and `rows`; None before the first commit."""
        commit = self.commit()
        columns, sums = commit.views[name], self._sums(commit)
        return None if sums is None else sums.filter(F.col("view") == name).select(*columns, "total", "rows")

    # --- writing ---------------------------------------------------------------------------------

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n)).cast("int")

    def _observed(self, rows: DataFrame, name: str) -> tuple[DataFrame, list[int], int]:
        """The rows, written aside, the buckets that they fall into and their number, found while writing."""
        seen = Observation()
        counted = rows.observe(seen, F.collect_set(BUCKET).alias("buckets"), F.count("*").alias("n"))
        counted.write.parquet(f"{self.path}/work/{name}", compression=CODEC)
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/work/{name}")
        return written, sorted(seen.get["buckets"]), seen.get["n"]

    def _n_rows(self, commit: Commit) -> int:
        if commit.n_rows is not None:
            return commit.n_rows
        before = self.rows(commit)
        return 0 if before is None else before.count()

    def _signed(self, changed: DataFrame, dims: list[str]) -> DataFrame:
        """New values of changed rows with sign 1 and, where a row was there, the old ones with -1."""
        columns = [*dims, self.measure]
        old = F.struct(*[F.col(f"_old.{c}").alias(c) for c in columns], F.lit(-1).alias("sign"))
        both = F.array(F.struct(*columns, F.lit(1).alias("sign")), F.when(F.col("_old").isNotNull(), old))
        return changed.select(F.explode(both).alias("v")).filter("v IS NOT NULL").select("v.*")

    def _next_sums(self, commit: Commit, changed: DataFrame) -> DataFrame:
        """All views after the change, in one aggregate: a row counts once in each view."""
        dims = _dims(commit)
        signed = self._signed(changed, dims)
        parts = [
            F.struct(
                F.lit(name).alias("view"),
                *[(F.col(d) if d in own else F.lit(None).cast(signed.schema[d].dataType)).alias(d) for d in dims],
            )
            for name, own in commit.views.items()
        ]
        amount = (F.col(self.measure) * F.col("sign")).cast("decimal(38,2)")
        delta = signed.select(
            F.inline(F.array(*parts)), amount.alias("total"), F.col("sign").cast("long").alias("rows")
        )
        before = self._sums(commit)
        every = delta if before is None else before.unionByName(delta)
        sums = every.groupBy("view", *dims).agg(
            F.sum("total").cast("decimal(38,2)").alias("total"), F.sum("rows").alias("rows")
        )
        return sums.filter("rows > 0")

    def merge(
        self,
        rows: DataFrame,
        source: str,
        batch: int | None = None,
        prepare: Callable[[DataFrame], DataFrame] | None = None,
        counts: Mapping[str, Column] | None = None,
        tries: int = 5,
    ) -> int:
        """Write rows over the table and publish the result; returns the version.

        Of several rows of a record the highest sequence wins, and a row that is older than the stored
        one does not replace it. `batch` numbers the merges of one `source`, ascending: one that is in
        already changes nothing. `counts` are aggregates over `rows`, added up by source; `prepare`
        turns what was counted into rows of the table.
        """
        batches = {} if batch is None else {source: batch}
        return self.merge_all(rows, batches, source, prepare, counts, tries)

    def merge_all(
        self,
        rows: DataFrame,
        batches: Mapping[str, int],
        counted_as: str,
        prepare: Callable[[DataFrame], DataFrame] | None = None,
        counts: Mapping[str, Column] | None = None,
        tries: int = 5,
    ) -> int:
        """The same for rows that are batches of several sources, which come in together."""
        for _ in range(tries):
            commit = self.commit()
            if batches and all(commit.applied.get(s, -1) >= b for s, b in batches.items()):
                return commit.version
            made = replace(commit, applied=commit.applied | batches)
            try:
                with shuffles_dropped(self.spark):
                    return self._merge_onto(made, rows, counted_as, prepare, counts or {})
            except Conflict:
                continue
        raise Conflict(f"no version was free in {tries} tries")

    def _dealt(self, rows: DataFrame, n_buckets: int) -> DataFrame:
        """Rows in their bucket's partition, which is its own if there are more than the session's."""
        if n_buckets <= int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            return rows.repartition(BUCKET)
        return rows.repartition(n_buckets, BUCKET)

    def _spread(self, incoming: DataFrame, n: int) -> bool:
        """Whether no record has a large part of the rows, so they need not be reduced before they are dealt."""
        if n <= BUCKET_ROWS:
            return False
        cell = F.pmod(F.xxhash64(self.key), F.lit(CELLS)).alias("cell")
        return incoming.groupBy(cell).count().agg(F.max("count")).first()[0] * CELLS <= 4 * n

    def _rounds(self, buckets: Sequence[int], n_rows: int) -> list[Sequence[int]]:
        """Buckets that hold that many rows, in parts."""
        at_once = ROUND_BUCKETS * BUCKET_ROWS * self.spark.sparkContext.defaultParallelism
        n = max(1, min(MOST_ROUNDS, -(-n_rows // at_once)))
        size = -(-len(buckets) // n)
        return [buckets[i : i + size] for i in range(0, len(buckets), size)]

    def _newest(
        self, commit: Commit, incoming: DataFrame, buckets: Sequence[int], n_buckets: int, spread: bool
    ) -> DataFrame:
        """One row for each record of consecutive ones of the touched buckets, in `n_buckets` buckets. Where
        it came in now, `_came` holds so and `_old` the values that it replaces.

        Rows go to their bucket's partition, which serves the window as well as the write. What was
        stored wins over an incoming row of the same sequence.
        """
        own = incoming.filter(F.col(BUCKET).between(min(buckets), max(buckets)))
        if not spread:  # a record's rows are cut before they meet in one task
            own = latest(own, self.key, self.sequence)
        own = own.withColumn("_came", F.lit(True))
        before = self.rows(commit, buckets)
        if before is not None:
            own = own.unionByName(before.withColumns({BUCKET: F.lit(0), "_came": F.lit(False)}))
        newest_first = Window.partitionBy(BUCKET, self.key).orderBy(F.col(self.sequence).desc(), "_came")
        whole = newest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        # Of a record one row at most was stored.
        stored = F.when(~F.col("_came"), F.struct(*_dims(commit), self.measure))
        ranked = self._dealt(own.withColumn(BUCKET, self._bucket(n_buckets)), n_buckets).withColumns(
            {"_nth": F.row_number().over(newest_first), "_old": F.last(stored, ignorenulls=True).over(whole)}
        )
        newest = ranked.filter("_nth = 1").drop("_nth")
        return newest.withColumn("_old", F.when(F.col("_came"), F.col("_old")))

    def _merge_onto(
        self,
        commit: Commit,
        rows: DataFrame,
        source: str,
        prepare: Callable[[DataFrame], DataFrame] | None,
        counts: Mapping[str, Column],
    ) -> int:
        name, seen = uuid.uuid4().hex, Observation()
        if counts:
            rows = rows.observe(seen, *[c.cast("long").alias(n) for n, c in counts.items()])
        if prepare:
            rows = prepare(rows)
        incoming, touched, n_incoming = self._observed(rows.withColumn(BUCKET, self._bucket(commit.n_buckets)), name)
        made = replace(commit, version=commit.version + 1)
        if counts:
            so_far = commit.counts.get(source, {})
            added = {n: so_far.get(n, 0) + value for n, value in seen.get.items()}
            made = replace(made, counts=commit.counts | {source: added})
        if touched:
            n_rows, n_buckets, others = self._n_rows(commit), commit.n_buckets, commit.buckets
            most = n_rows + n_incoming  # if all that come in are new
            met = n_incoming + n_rows * len(touched) // n_buckets
            if most > n_buckets * BUCKET_ROWS:
                touched, others, met = sorted({*touched, *map(int, commit.buckets)}), {}, most
                n_buckets = -(-2 * most // BUCKET_ROWS)
            spread, folder = self._spread(incoming, n_incoming), f"{self.path}/data/{BATCH}={name}"
            written, n_new = set(), 0
            is_new = F.col("_came") & F.col("_old").isNull()
            for some in self._rounds(touched, met):
                after, held = self._newest(commit, incoming, some, n_buckets, spread), Observation()
                watched = after.observe(held, F.collect_set(BUCKET).alias("buckets"), F.count_if(is_new).alias("new"))
                watched.write.mode("append").partitionBy(BUCKET).parquet(folder, compression=CODEC)
                written.update(held.get["buckets"])
                n_new += held.get["new"]
            changed = self.spark.read.schema(after.schema).parquet(folder).filter("_came")
            self._next_sums(commit, changed).write.parquet(f"{self.path}/views/{name}")
            made = replace(
                made,
                schema=rows.schema.json(),
                n_buckets=n_buckets,
                buckets=others | {str(b): name for b in sorted(written)},
                sums=name,
                n_rows=n_rows + n_new,
            )
        self.publish(made)
        fs, work = self._at("work", name)
        fs.delete(work, True)
        return made.version

    def copy_to(self, path: str, n_buckets: int) -> KeyedTable:
        """The current rows as the first version of a new table with other buckets.

        What was applied is known there too, so streams go on with the new table where they were.
        """
        commit = self.commit()
        target = replace(self, path=path, n_buckets=n_buckets)
        made = replace(commit, version=1, n_buckets=n_buckets, buckets={}, sums="")
        rows = self.rows(commit)
        if rows is not None:
            name = uuid.uuid4().hex
            dealt = self._dealt(rows.withColumn(BUCKET, self._bucket(n_buckets)), n_buckets)
            with shuffles_dropped(self.spark):
                dealt.write.partitionBy(BUCKET).parquet(f"{path}/data/{BATCH}={name}", compression=CODEC)
            self._sums(commit).write.parquet(f"{path}/views/{name}")
            held = self.spark.read.parquet(f"{path}/data/{BATCH}={name}").select(BUCKET).distinct()
            buckets = {str(r[0]): name for r in held.collect()}  # at most n_buckets rows
            made = replace(made, buckets=buckets, sums=name)
        target.publish(made)
        return target
