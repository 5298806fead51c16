"""A session over micro-batches with a progress table: lagging streams keep their rows, progress never goes back.

Each committed version has one progress document, one table of stream states and the results of its batch, under one
folder that all executors share.  The document is created only if its version is not there yet, so that of two writers
one fails; a batch that was committed before is not processed again but read back.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayring.config import Engine
from wayring.streaming.lifecycle import KEY, RESULTS, Gathered, Track, arrow_schema, columns_of, in_time, prepared, record_batch, runs, stirring, values_of
from wayring.streaming.route_steps import FIELDS, Route, RouteState

SCHEMA_VERSION = 1
ALGORITHM_VERSION = "wayring-3"
TRACK = "server_id long, vehicle_identifier long, last_us long, active boolean, passed int, last_look double, candidate boolean, " + ", ".join(f"{f} array<double>" for f in FIELDS) + ", " + Route.SCHEMA + ", " + RouteState.WATCH_SCHEMA
_WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"
_BOTH = RESULTS + ", " + ", ".join(f"t_{c.strip()}" for c in TRACK.split(",")[2:])


@dataclass(frozen=True)
class Progress:
    """What a version says: until when samples were processed, by which batch, and where its tables lie."""

    version: int
    processed_until_us: int
    batch_id: int | None
    folder: str
    schema_version: int
    algorithm_version: str
    config_sha256: str


class ProgressTable:
    """Progress documents by version in a folder; a commit of a version that exists is refused."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._files.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(""))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> Progress:
        return Progress(**json.loads(self.spark.read.text(f"{self.folder}/{version:012d}.json", wholetext=True).first().value))

    def newest(self) -> Progress | None:
        versions = self.versions()
        return self.read(versions[-1]) if versions else None

    def of_batch(self, batch_id: int) -> Progress | None:
        """The version that a batch committed, if it is among the last ones."""
        for version in reversed(self.versions()[-10:]):
            found = self.read(version)
            if found.batch_id == batch_id:
                return found
        return None

    def commit(self, progress: Progress) -> None:
        """Write the document under a name of its own and give it the version's name, which fails if there is one."""
        own, final = self._path(f"{uuid.uuid4().hex}.tmp"), self._path(f"{progress.version:012d}.json")
        out = self._files.create(own, False)
        out.write(bytearray(json.dumps(progress.__dict__, sort_keys=True).encode()))
        out.close()
        jvm = self.spark._jvm
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:  # without the option to overwrite
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, final, plain)
        except Exception as error:
            self._files.delete(own, False)
            raise RuntimeError(f"version {progress.version} was committed by another session") from error


class Session:
    """Micro-batches of samples in order, with the states of all streams between them.

    A sample counts if it is after the last one of its own stream, however far other streams are ahead.  After a batch
    the deadlines of all streams are passed up to ``observed_until``, by default the batch's newest sample; a time
    before what was processed is refused, before anything is written.  A restart is a new ``Session`` on the folder,
    which has to have the same schema, algorithm and configuration.  A batch rewrites the states, whose size is bounded
    by ``Detection.history_points`` for each stream.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Engine = Engine()) -> None:
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self.table = ProgressTable(spark, f"{self.folder}/progress")
        found = self.table.newest()
        if found is not None:
            for name, have, want in (("schema version", found.schema_version, SCHEMA_VERSION), ("algorithm version", found.algorithm_version, ALGORITHM_VERSION), ("configuration", found.config_sha256, config.fingerprint())):
                if have != want:
                    raise ValueError(f"the session was written with another {name}")

    @property
    def processed_until_us(self) -> int | None:
        found = self.table.newest()
        return None if found is None else found.processed_until_us

    def results(self, version: int) -> DataFrame:
        """The results of a committed version."""
        return self.spark.read.schema(_BOTH).parquet(f"{self.table.read(version).folder}").where("output <> 'state'").select(*columns_of(RESULTS))

    def states(self) -> DataFrame:
        """The states of all streams after the newest version."""
        found = self.table.newest()
        if found is None:
            return self.spark.createDataFrame([], TRACK)
        rows = self.spark.read.schema(_BOTH).parquet(found.folder).where("output = 'state'")
        return rows.select(*KEY, *(F.col(f"t_{c}").alias(c) for c in columns_of(TRACK)[2:]))

    def process_batch(self, samples: DataFrame, observed_until_us: int | None = None, batch_id: int | None = None, forward_only: bool = False) -> DataFrame:
        """Changes and frames of a batch; committed before they are returned.

        Without samples and ``observed_until_us`` nothing happens.  ``forward_only`` takes a time before what was
        processed as that, so that a batch of late rows alone changes their streams only.
        """
        if batch_id is not None and (known := self.table.of_batch(batch_id)) is not None:
            return self.results(known.version)
        before = self.table.newest()
        rows = prepared(samples)
        if observed_until_us is None:
            observed_until_us = rows.agg(F.max("at_us")).first()[0]
        if observed_until_us is None:
            return self.spark.createDataFrame([], RESULTS)
        if before is not None and observed_until_us < before.processed_until_us:
            if not forward_only:
                raise ValueError("observed_until cannot move backwards")
            observed_until_us = before.processed_until_us
        config, until = self.config, observed_until_us

        names = columns_of(TRACK)[2:]
        schema = arrow_schema(_BOTH)

        def states(ended: list[tuple[tuple, Track]]) -> Iterator[pa.RecordBatch]:
            if ended:
                values = list(zip(*(stored(track) for _, track in ended), strict=True))
                own = {c: [key[k] for key, _ in ended] for k, c in enumerate(KEY)} | {f"t_{c}": list(v) for c, v in zip(names, values, strict=True)}
                yield record_batch(schema, len(ended), {"output": ["state"] * len(ended), **own})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, track, found, ended = None, None, Gathered(config), []
            # a stream's state, where there is one, stands before its samples
            for batch in batches:
                rows, stirs, is_state = values_of(batch), stirring(batch, config), batch.column("is_state").to_numpy(zero_copy_only=False)
                held = batch.column("state").flatten() if is_state.any() else []
                for own, first, end in runs(batch):
                    if own != key:
                        if track is not None:
                            found.tell(key, track.pass_deadlines(until, config))
                            ended.append((key, track))
                        key, track = own, Track()
                    if is_state[first]:
                        track = restored({c: _value(column[first]) for c, column in zip(names, held, strict=True)})
                        first += 1
                    if first < end:
                        found.take(key, track, rows, first, end, stirs)
                yield from found.batches(batch, schema)
                yield from states([one for one in ended if one[1].last_us is not None])
                ended = []
            if track is not None:
                found.tell(key, track.pass_deadlines(until, config))
                yield from found.batches(None, schema)
                yield from states([(key, track)] if track.last_us is not None else [])

        version = 1 if before is None else before.version + 1
        folder = f"{self.folder}/results/{version:012d}-{uuid.uuid4().hex}"
        # a state is one column, so that samples are not shuffled and sorted beside dozens of nulls
        held = self.states().select(*KEY, F.lit(True).alias("is_state"), F.struct(*names).alias("state"))
        both = held.unionByName(rows.withColumn("is_state", F.lit(False)), allowMissingColumns=True)
        found = in_time(both.withColumn("is_sample", ~F.col("is_state")), "is_sample").mapInArrow(run, _BOTH)
        # results are of three kinds: a task writes them side by side instead of sorting its rows by kind
        before_conf = self.spark.conf.get(_WRITERS_CONF, None)
        self.spark.conf.set(_WRITERS_CONF, 4)
        try:
            found.write.partitionBy("output").parquet(folder)
        finally:
            self.spark.conf.unset(_WRITERS_CONF) if before_conf is None else self.spark.conf.set(_WRITERS_CONF, before_conf)
        self.table.commit(Progress(version, observed_until_us, batch_id, folder, SCHEMA_VERSION, ALGORITHM_VERSION, config.fingerprint()))
        return self.results(version)

    def sink(self, samples: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: a replayed micro-batch is not processed again, late rows do not stop the stream."""
        self.process_batch(samples, batch_id=batch_id, forward_only=True)

    def all_results(self) -> DataFrame:
        """The results of all versions."""
        parts = [self.results(v) for v in self.table.versions()]
        out = self.spark.createDataFrame([], RESULTS)
        for part in parts:
            out = out.unionByName(part)
        return out


def _value(scalar: pa.Scalar) -> object:
    """As ``as_py``, which takes lists apart one value after the other; NaN in lists stays."""
    if isinstance(scalar, pa.ListScalar) and scalar.is_valid and scalar.values.null_count == 0:
        return scalar.values.to_numpy(zero_copy_only=False).tolist()
    return scalar.as_py()


def stored(track: Track) -> tuple:
    """The values of ``TRACK`` behind the key."""
    r = track.routes
    return (track.last_us, track.active, track.passed, r.last_look, r.candidate, *(r.history[f] for f in FIELDS), *r.route_values(), *r.watch_values())


def restored(row: dict) -> Track:
    history = {f: row[f] for f in FIELDS}
    route = Route.of(*(row[c] for c in columns_of(Route.SCHEMA)))
    routes = RouteState(history, row["last_us"] / 1e6, float(row["last_look"]), bool(row["candidate"]), route is not None, route)
    routes.watch(*(row[c] for c in columns_of(RouteState.WATCH_SCHEMA)))
    return Track(row["last_us"], row["active"], row["passed"], routes)
