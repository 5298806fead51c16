"""Portable snapshots of stream states, with the gates that a restore has to pass, and report export."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wayring.config import Engine, Grouping, Timing
from wayring.operators.lifecycle import KEY, latest_state
from wayring.streaming.lifecycle import ROUTE_STATE, STATE_CHANGES, Track, columns_of

SCHEMA_VERSION = 2
ALGORITHM_VERSION = "wayring-2"
#: Times are written whole, to the microsecond.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
SAMPLE = "sample_time timestamp, server_id long, vehicle_number long, vehicle_identifier long, active boolean, latitude_deg double, longitude_deg double, velocity_north_mps double, velocity_east_mps double, reliability double, field_quality map<string,string>"
#: Routes as documents: what is missing of them takes its default, regions none.
ROUTE_DOCUMENT = "route_id string, family string, subtype string, topology string, canonical_points array<struct<x_m:double,y_m:double>>, center_latitude_deg double, center_longitude_deg double, length_m double, long_axis_a_m double, short_axis_b_m double, orientation_deg double, estimated_period_s double, direction string, detection_quality double, regions array<struct<kind:string,start_phase:double,end_phase:double,label:string>>"
GATE = "schema_version int, algorithm_version string, config_sha256 string, processed_until timestamp"
STATE = "server_id long, vehicle_identifier long, active boolean, sample_time timestamp, samples long"


def export_snapshot(samples: DataFrame, path: str, config: Engine = Engine(), routes: DataFrame | None = None) -> None:
    """One JSON line per stream with its newest state, beside a gate row; lines are written by the executors.

    The gate row also says until when samples were processed: the newest sample of all streams.  ``routes``
    (``route_states``) adds what the route lifecycle carries, a line per stream.
    """
    until = samples.agg(F.max(F.col("sample_time").cast("timestamp")).alias("processed_until"))
    gate = until.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(ALGORITHM_VERSION).alias("algorithm_version"), F.lit(config.fingerprint()).alias("config_sha256"), "processed_until")
    gate.coalesce(1).write.mode("overwrite").options(**TIMES).json(f"{path}/gate")
    json_lines(latest_state(samples)).write.mode("overwrite").text(f"{path}/states")
    if routes is not None:
        json_lines(routes).write.mode("overwrite").text(f"{path}/routes")


def passed_gate(spark: SparkSession, path: str, config: Engine = Engine()) -> Row:
    """The gate row of a snapshot; another schema, algorithm or configuration is refused."""
    gate = spark.read.schema(GATE).options(**TIMES).json(f"{path}/gate").first()
    for name, have, want in (("schema version", gate.schema_version, SCHEMA_VERSION), ("algorithm version", gate.algorithm_version, ALGORITHM_VERSION), ("configuration", gate.config_sha256, config.fingerprint())):
        if have != want:
            raise ValueError(f"the snapshot has another {name}")
    return gate


def restore_snapshot(spark: SparkSession, path: str, config: Engine = Engine()) -> DataFrame:
    """The newest state of each stream of a snapshot that passes the gate."""
    passed_gate(spark, path, config)
    return spark.read.text(f"{path}/states").select(F.from_json("value", STATE, TIMES).alias("s")).select("s.*")


def restore_routes(spark: SparkSession, path: str, config: Engine = Engine()) -> DataFrame:
    """The route states of a snapshot that passes the gate."""
    passed_gate(spark, path, config)
    return spark.read.text(f"{path}/routes").select(F.from_json("value", ROUTE_STATE, TIMES).alias("s")).select("s.*")


def resumed_changes(samples: DataFrame, states: DataFrame, processed_until: Column, no_data_seconds: int = Timing().no_data_seconds, expire_seconds: int = Grouping().hold_seconds) -> DataFrame:
    """State changes after a snapshot, which with those before it are the changes of a continuous run.

    A sample counts if it is after the last one of its own stream, even where other streams were processed further:
    the deadlines that had passed by ``processed_until`` were told before, and a lagging stream's return is told now.
    """
    config = Engine(timing=Timing(no_data_seconds=no_data_seconds), grouping=Grouping(hold_seconds=expire_seconds))
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("at_us")
    new = samples.where("sample_time is not null").select(*KEY, at("sample_time"), "active")
    until = new.agg(F.max("at_us").alias("newest")).select(F.unix_micros(processed_until.cast("timestamp")).alias("before_us"), F.greatest(F.unix_micros(processed_until.cast("timestamp")), F.col("newest")).alias("until_us"))
    again = lambda: until.select(*(F.col(c).alias(c) for c in until.columns))
    both = [rows.crossJoin(F.broadcast(again())) for rows in (new, states.select(*KEY, at("sample_time"), "active"))]  # one row

    def run(key: tuple, pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        plain = lambda x: None if x is None or pd.isna(x) else bool(x)
        track, out = Track(), []
        if len(held):
            row = held.iloc[0]
            track = Track(int(row["at_us"]), plain(row["active"]))
            track.pass_deadlines(int(row["before_us"]), config)
        for at_us, active in sorted(zip(pdf["at_us"].tolist(), map(plain, pdf["active"]), strict=True), key=lambda r: r[0]):
            out += [(at, kind) for at, kind, _ in track.take(at_us, (at_us / 1e6, active, *(None,) * 5), config) or ()]
        end = pdf if len(pdf) else held
        out += track.pass_deadlines(int(end["until_us"].iloc[0]), config)
        return pd.DataFrame([(*key, at, kind) for at, kind in out], columns=columns_of(STATE_CHANGES))

    found = both[0].groupBy(*KEY).cogroup(both[1].groupBy(*KEY)).applyInPandas(run, STATE_CHANGES)
    return found.select(F.timestamp_micros("at_us").alias("change_time"), "kind", *KEY)


def resumed_samples(samples: DataFrame, states: DataFrame) -> DataFrame:
    """Samples after their stream's snapshot; overlap with what the snapshot has seen is dropped."""
    seen = states.select("server_id", "vehicle_identifier", F.col("sample_time").alias("seen_until"))
    joined = samples.join(seen, ["server_id", "vehicle_identifier"], "left")
    return joined.where("seen_until is null or sample_time > seen_until").drop("seen_until")


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON document per row, in ``value``; nulls are left out, times without a zone are those of the session's."""
    zoned = [F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes]
    return rows.select(F.to_json(F.struct(*zoned), TIMES).alias("value"))


def from_json_lines(lines: DataFrame, schema: str = SAMPLE, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rows of JSON documents; what is missing takes its default: reliability 1, no field qualities, no regions, regions without a label an empty one."""
    rows = lines.select(F.from_json("value", schema, TIMES).alias("s")).select("s.*")
    none = {"reliability": F.lit(1.0), "field_quality": F.create_map().cast("map<string,string>")}
    if "regions" in rows.columns:
        region = lambda r: F.struct(r["kind"].alias("kind"), r["start_phase"].alias("start_phase"), r["end_phase"].alias("end_phase"), F.coalesce(r["label"], F.lit("")).alias("label"))
        rows = rows.withColumn("regions", F.transform("regions", region))
        none["regions"] = F.array().cast("array<struct<kind:string,start_phase:double,end_phase:double,label:string>>")
    given = defaults or {c: d for c, d in none.items() if c in rows.columns}
    return rows.withColumns({c: F.coalesce(F.col(c), default) for c, default in given.items()})


def retained(samples: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Samples within the retention; on tables partitioned by date the filter prunes folders."""
    return samples.where(F.col("sample_time") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Parquet by server and date."""
    samples.withColumn("date", F.to_date("sample_time")).write.mode("append").partitionBy("server_id", "date").parquet(path)


def report_json(events: DataFrame, server_id: int, start: str, end: str) -> DataFrame:
    """One JSON document: server, range and its events; the events of a report are a stated, small range."""
    if not start < end:
        raise ValueError("a range has to begin before it ends")
    chosen = events.where((F.col("server_id") == server_id) & (F.col("start") >= start) & (F.col("start") < end))
    return chosen.agg(F.to_json(F.struct(F.lit(server_id).alias("server"), F.lit(start).alias("from"), F.lit(end).alias("to"), F.sort_array(F.collect_list(F.struct(*events.columns))).alias("events"))).alias("report"))
