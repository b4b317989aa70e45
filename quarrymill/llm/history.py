"""New batches against everything accepted before, without going through the history again.

What is accepted is kept as appended tables (`History`): the keys a record holds (identity, blob, content, words), the
classes of its texts, and a pivot table: for each distinct text its distances to fixed pivots and its band keys. A batch
is turned into the same rows. Its texts meet the stored ones in a join that is partitioned by ranges of the distance to
the empty set (a partner lies in the same range or a neighbouring one) and by band; within a partition the other
distances prune by the triangle inequality, and what is left is verified with the true metric. Then the batch's own rows
are appended. No stored text is cut into words again, except those that have to be verified.

Bands are needed as well as ranges, because distances to pivots alone tell two texts of one language apart by little more
than their sizes; the README gives figures.

Who is accepted is decided in rounds over the candidates of a batch at once: a candidate that matches the history is a
case; of the rest, one that has no earlier undecided candidate among its matches is accepted; one that matches an
accepted earlier one is a case. Equal keys never become pairs: for each key only the smallest order that holds it counts.

Defined results: null, blank and wordless values match nothing; rows sent twice count once (the first arrival of a
record_id); a path that leaves the repository keeps no key; records are taken by batch_id, then record_id, a null
batch_id last; empty tables give no rows; other columns play no part.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import near, pivots
from quarrymill.llm.words import Weights, mix
from quarrymill.runtime import Stage


def file_path(path: str | None) -> str | None:
    """The one spelling of a path: separators, percent signs, blanks, empty and dot segments; letter case stays."""
    if path is None or not path.strip():
        return None
    text = path.strip()
    for _ in range(3):
        plain = unquote(text)
        if plain == text:
            break
        text = plain
    text = unicodedata.normalize("NFC", text.strip()).replace("\\", "/")
    out: list[str] = []
    for part in re.split(r"/+", text):
        if part in ("", "."):
            continue
        if part == "..":
            if out:
                out.pop()
            continue
        out.append(part)
    return "/".join(out) or None


def _hash(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.lower(F.trim(c)))


def _paths(df: DataFrame) -> DataFrame:
    """df with its column `path` in the one spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("path")
            yield batch.set_column(at, "path", pa.array([file_path(p) for p in batch.column(at).to_pylist()], pa.string()))

    return df.mapInArrow(run, df.schema)


#: Batches that wait are added together until they have this share of the texts held: a step has a cost of its own, and order within a step is kept.
TOGETHER = 1.0
#: The filter by which the stored rows of a join are sifted before they are shuffled has 8 to 16 bits for each key of the batch, within these bounds (32 MB at most). A full filter lets rows pass, it loses none.
SIEVE_BITS, SIEVE_LEAST, SIEVE_MOST = 8, 1 << 20, 1 << 28
_ONE_FILE = ["repository_id", "path", "git_blob_sha", "content_text"]


def _old(existing: DataFrame) -> DataFrame:
    return _paths(existing.select(
        F.col("record_id").alias("id"), F.lit(-1).alias("batch"), "repository_id", "path", _hash(F.col("git_blob_sha")).alias("blob"),
        _hash(F.col("content_sha256")).alias("sha"), F.col("content_text").alias("text"), F.lit(False).alias("new"),
    ).where("id IS NOT NULL").dropDuplicates(["id"]))


def _new(candidates: DataFrame) -> DataFrame:
    fields = ["batch_id", *_ONE_FILE]
    first = candidates.where("record_id IS NOT NULL").groupBy("record_id").agg(F.min_by(F.struct(*fields), F.struct("arrived_at", *fields)).alias("r")).select("record_id", "r.*")
    return _paths(first.select(
        F.col("record_id").alias("id"), F.coalesce("batch_id", F.lit(2**31 - 1)).cast("int").alias("batch"), "repository_id", "path", _hash(F.col("git_blob_sha")).alias("blob"),
        F.sha2(F.col("content_text").cast("binary"), 256).alias("sha"), F.col("content_text").alias("text"), F.lit(True).alias("new"),
    ))


def _key(kind: str, *c: Column) -> Column:
    return F.concat_ws("\u0001", F.lit(kind), *[x.cast("string") for x in c])


def _listed(records: DataFrame, sha: Column) -> DataFrame:
    """(id, batch, new, key) for each key of a record; a null column gives none."""
    path = F.when(F.col("repository_id").isNotNull() & F.col("path").isNotNull(), _key("p", F.col("repository_id"), F.col("path")))
    blob = F.when(F.col("blob").isNotNull(), _key("b", F.col("blob")))
    keys = F.filter(F.array(path, blob, F.when(sha.isNotNull(), _key("s", sha))), lambda x: x.isNotNull())
    return records.select("id", "batch", "new", F.explode(keys).alias("key"))


def _node(column: str) -> Column:
    return _key("n", F.col(column)).alias("key")


def holds_of(records: DataFrame, members: DataFrame) -> DataFrame:
    """What later records can match: identity, blob, words, and for the history the content hash."""
    said = F.when(~F.col("new"), F.col("sha"))
    return _listed(records, said).unionByName(members.join(records.select("id", "batch", "new"), "id").select("id", "batch", "new", _node("node")))


def seeks_of(records: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """The keys whose holders a candidate matches: its own, and those of the texts its text is linked with."""
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("l")).select("l.*")
    mine = members.join(records.where("new").select("id", "batch"), "id")
    own = _listed(records.where("new"), F.col("sha")).select("id", "batch", "key")
    return own.unionByName(mine.select("id", "batch", _node("node"))).unionByName(mine.join(both, "node").select("id", "batch", _node("other")))


def decide(holds: DataFrame, seeks: DataFrame, undecided: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(the repeated records of every case, the accepted candidates). holds, seeks and undecided (id, batch) are written tables."""
    order = F.struct("batch", "id")
    cases = seeks.join(holds.where("NOT new").select("key").distinct(), "key", "left_semi").select("id").distinct()
    undecided = stage.write(undecided.join(cases, "id", "left_anti"), "undecided")
    rounds = []
    while not undecided.isEmpty():
        open_holds = holds.where("new").join(undecided.select("id"), "id", "left_semi")
        open_seeks = seeks.join(undecided.select("id"), "id", "left_semi")
        # the smallest order that holds anything a candidate seeks; its own keys hold itself
        earliest = open_holds.groupBy("key").agg(F.min(order).alias("first"))
        best = open_seeks.join(earliest, "key").groupBy("id", "batch").agg(F.min("first").alias("first"))
        win = stage.write(undecided.join(best, ["id", "batch"], "left").where(F.col("first").isNull() | (F.col("first") >= order)).select("id", "batch"), "accepted")
        rounds.append(win)
        taken = holds.join(win.select("id"), "id", "left_semi").groupBy("key").agg(F.min(order).alias("first"))
        lost = open_seeks.join(taken, "key").where(F.col("first") < order).select("id")
        undecided = stage.write(undecided.join(win.select("id"), "id", "left_anti").join(lost, "id", "left_anti"), "undecided")
    accepted = undecided.select("id", "batch")  # empty now
    for win in rounds:
        accepted = accepted.unionByName(win)
    kept = holds.where("NOT new").unionByName(holds.where("new").join(accepted.select("id"), "id", "left_semi"))
    found = seeks.select(F.col("id").alias("record_id"), F.col("batch").alias("at"), "key").join(kept.select(F.col("id").alias("accepted_id"), "batch", "key"), "key")
    earlier = (F.col("batch") < F.col("at")) | (F.col("batch") == F.col("at")) & (F.col("accepted_id") < F.col("record_id"))
    return found.where(earlier).select("accepted_id", "record_id").distinct(), accepted


def repeated(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """(accepted_id, record_id): the records that every candidate repeats; arrivals of one batch or several, one after the other, against the stored history."""
    spark = existing.sparkSession
    stage = Stage(spark, "history")
    held = History(spark, f"{stage.root}/held")
    texts = held.start(existing)
    # a record belongs to the batch of its first arrival
    first = stage.write(_new(candidates), "candidates")
    waiting = [(r.batch, r["count"]) for r in first.groupBy("batch").count().orderBy("batch").collect()]  # one row for each batch that arrived
    found = None
    while waiting:
        arrival, size = [], 0
        while waiting and (not arrival or size < TOGETHER * texts):
            arrival.append(waiting[0][0])
            size += waiting.pop(0)[1]
        one = held.add_records(first.where(F.col("batch").isin(arrival)))
        texts += size
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], f"accepted_id {existing.schema['record_id'].dataType.simpleString()}, record_id {candidates.schema['record_id'].dataType.simpleString()}")
    return found


class History:
    """The accepted records as tables below a folder, to which batches are added one by one.

    Every step (the start, a batch) writes its rows into a folder of its own and is committed by one small file at its
    end; readers see committed steps only, so a step that failed can be run again. Stored are keys (id, batch, new, key),
    classes of texts (node, text, bag) and the pivot table (node, n, sketch, keys). The word weights, which decide the
    band keys, are those of the texts held when they were made; they are made again, and all band keys with them, when
    the number of texts has grown `REWEIGH`-fold, also from nothing. So their cost per text stays bounded.
    """

    REWEIGH = 4

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> list[dict]:
        """What each committed step says of itself, in order."""
        out = []
        while self._fs.exists(self._path(f"{self.root}/{len(out):06d}/COMMITTED")):
            stream = self._fs.open(self._path(f"{self.root}/{len(out):06d}/COMMITTED"))
            try:
                out.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return out

    def _commit(self, step: int, said: dict) -> None:
        part, final = (self._path(f"{self.root}/{step:06d}/{name}") for name in ("COMMITTING", "COMMITTED"))
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(said), "utf-8"))
        stream.close()
        if not self._fs.rename(part, final):
            raise OSError(f"could not commit step {step} of {self.root}")

    def _read(self, name: str, log: list[dict], since: int = 0) -> DataFrame:
        return self.spark.read.schema(log[0]["schemas"][name]).parquet(*[f"{self.root}/{k:06d}/{name}" for k in range(since, len(log))])

    def _write(self, df: DataFrame, step: int, name: str) -> DataFrame:
        path = f"{self.root}/{step:06d}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _weights(self, step: int) -> Weights:
        rows = self.spark.read.parquet(f"{self.root}/{step:06d}/weights").toArrow()  # bounded, see near.word_weights
        return Weights(rows.column("e").to_numpy(), rows.column("w").to_numpy())

    def _store_weights(self, nodes: DataFrame, step: int) -> Weights:
        weights = near.word_weights(nodes)
        rows = pa.table({"e": pa.array(weights.elements, pa.int64()), "w": pa.array(weights.weights, pa.float64())})
        self._write(self.spark.createDataFrame(rows), step, "weights")
        return weights

    def start(self, existing: DataFrame) -> int:
        """The first step: the history there is. It may be empty. Returns the number of its texts."""
        stage = Stage(self.spark, "history")
        records = stage.write(_old(existing), "records")
        bags = stage.write(near.bags(records.where("text IS NOT NULL"), "id", "text", 1), "bags")
        nodes = self._write(bags.groupBy("bag").agg(F.min("id").alias("node"), F.min_by("text", "id").alias("text")).select("node", "text", "bag"), 0, "nodes")
        members = bags.select("id", "bag").distinct().join(nodes.select("bag", "node"), "bag").select("id", "node")
        weights = self._store_weights(nodes, 0)
        made = {"nodes": nodes, "marks": self._write(near.marks(nodes, weights, pivots.Pivots), 0, "marks"), "holds": self._write(holds_of(records, members), 0, "holds")}
        texts = nodes.count()
        stage.drop(records)
        stage.drop(bags)
        ddl = {name: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) for name, df in made.items()}
        self._commit(0, {"texts": texts, "weighed": texts, "weights": 0, "schemas": ddl})
        return texts

    def add(self, batch: DataFrame) -> DataFrame:
        """(accepted_id, record_id) for the candidates of a batch that are held already; the others are accepted."""
        stage = Stage(self.spark, "arrived")
        return self.add_records(stage.write(_new(batch), "records"))

    def add_records(self, records: DataFrame) -> DataFrame:
        """As `add`, for a written table of records."""
        log = self._log()
        if not log:
            raise ValueError("the history was not started")
        step, said = len(log), log[-1]
        stage = Stage(self.spark, "batch")
        stored = self._read("nodes", log)
        bags = stage.write(near.bags(records.where("text IS NOT NULL"), "id", "text", 1), "bags")
        mine = bags.groupBy("bag").agg(F.min("id").alias("mine"), F.min_by("text", "id").alias("text"))
        # a class that is stored keeps its node
        placed = stage.write(mine.join(stored.select("bag", F.col("node").alias("held")), "bag", "left"), "placed")
        fresh = placed.where("held IS NULL").select(F.col("mine").alias("node"), "text", "bag")
        known = placed.where("held IS NOT NULL").select(F.col("held").alias("node"))
        members = bags.select("id", "bag").distinct().join(placed.select("bag", F.coalesce("held", "mine").alias("node")), "bag").select("id", "node")
        weights = self._weights(said["weights"]) if said["weighed"] else self._store_weights(fresh, step)
        old = self._read("marks", log, said["weights"])
        marked = near.marks(fresh, weights, pivots.Pivots).withColumn("fresh", F.lit(True))
        asked = stage.write(marked.unionByName(old.join(known, "node", "left_semi").withColumn("fresh", F.lit(False))), "asked")
        texts = stored.select("node", "text").unionByName(fresh.select("node", "text"))
        pairs, met = self._near(asked, old, stage)
        seeks = stage.write(seeks_of(records, members, near.verified(pairs, texts)), "seeks")
        stage.drop(met)
        before = self._read("holds", log).join(seeks.select("key").distinct(), "key", "left_semi").withColumn("new", F.lit(False))
        holds = stage.write(before.unionByName(holds_of(records, members)), "holds")
        found, accepted = decide(holds, seeks, records.select("id", "batch"), stage)
        found = stage.write(found, "found")
        # what was accepted is appended
        kept = members.join(accepted.select("id"), "id", "left_semi").select("node").distinct()
        added = self._write(fresh.join(kept, "node", "left_semi"), step, "nodes")
        self._write(holds.where("new").join(accepted.select("id"), "id", "left_semi"), step, "holds")
        count, weighed, at = said["texts"] + added.count(), said["weighed"], said["weights"]
        if not weighed or count >= self.REWEIGH * weighed:
            every = stored.select("node", "text").unionByName(added.select("node", "text"))
            weights, weighed, at = self._store_weights(every, step), count, step
            self._write(near.marks(every, weights, pivots.Pivots), step, "marks")
        else:
            self._write(asked.where("fresh").drop("fresh").join(added.select("node"), "node", "left_semi"), step, "marks")
        self._commit(step, {"texts": count, "weighed": weighed, "weights": at})
        for used in (bags, placed, asked, seeks, holds):
            stage.drop(used)
        return found

    def _near(self, asked: DataFrame, old: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
        """((a, b), the written table they come from): pairs of a text of the batch and another, stored or of the batch, that bands and pivots do not keep apart.

        asked: marks of the batch's texts, `fresh` or stored already; old: the stored marks.
        """
        kind = asked.schema["node"].dataType.simpleString()
        size = SIEVE_LEAST
        keys = asked.count() * near.BANDS * 2
        while size < SIEVE_MOST and size < SIEVE_BITS * keys:
            size *= 2

        def places(batch: pa.RecordBatch, of_asked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(row, band, range, hash of both) of a batch of marks."""
            n = batch.column("n").to_numpy().astype(np.float64)
            keys = batch.column("keys").flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), len(keys) // max(1, len(n)))
            at = pivots.reach(n) if of_asked else (pivots.cell(n),)
            rows, bands, cells = row, keys, at[0][row]
            if of_asked:
                two = (at[0] != at[1])[row]
                rows, bands, cells = np.concatenate([row, row[two]]), np.concatenate([keys, keys[two]]), np.concatenate([cells, at[1][row[two]]])
            return rows, bands, cells, (mix(bands.view(np.uint64) ^ mix(cells.view(np.uint64), 3), 5) & np.uint64(size - 1)).astype(np.int64)

        def spread(of_asked: bool, sieve: np.ndarray | None):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    row, band, cell, h = places(batch, of_asked)
                    if sieve is not None:
                        ok = (sieve[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) > 0
                        row, band, cell = row[ok], band[ok], cell[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(cell.astype(np.int32)), batch.column("node").take(pa.array(row)), pa.array(np.full(len(row), of_asked))], names=["band", "cell", "node", "new"])

            return run

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = places(batch, True)[3] if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h >> 6), pa.array((np.uint64(1) << (h & 63).astype(np.uint64)).view(np.int64))], names=["word", "mask"])

        shape = f"band bigint, cell int, node {kind}, new boolean"
        own = asked.select("node", "n", "keys").mapInArrow(spread(True, None), shape)
        # what the batch asks for, as a filter of fixed size: stored rows that it does not want are never shuffled
        words = asked.select("node", "n", "keys").mapInArrow(bits, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most SIEVE_MOST / 64 rows
        sieve = np.zeros(size // 64, dtype=np.uint64)
        sieve[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
        kept = self.spark.sparkContext.broadcast(sieve)  # `size` bits
        del words, sieve

        def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from spread(False, kept.value)(batches)

        # the range join: stored rows whose band and range the batch asks for
        theirs = old.select("node", "n", "keys").mapInArrow(sifted, shape).join(own.select("band", "cell").distinct(), ["band", "cell"], "left_semi")
        met = theirs.join(asked.where("NOT fresh").select("node"), "node", "left_anti").select("band", "cell", "node", "new")
        met = stage.write(own.unionByName(met), "met")
        kept.destroy()
        rows = near.shared(met, ["band", "cell"])
        mine, theirs = asked.select("node", "n", "sketch"), old.select("node", "n", "sketch")
        full = rows.where("new").join(mine, "node").unionByName(rows.where("NOT new").join(theirs, "node"))
        usual = full.where(F.col("c") <= near.TILE).withColumn("tile", F.lit(0).cast("long")).withColumn("block", F.lit(0))
        crowded = near.tiled(full.where(F.col("c") > near.TILE), near.TILE)
        columns = ["band", "cell", "tile", "block", "node", "n", "sketch", "new"]
        return near.compared(usual.select(*columns).unionByName(crowded.select(*columns)), ["band", "cell"], pivots.Pivots), met
