"""A streaming source that polls servers, most of which sleep.

A dormant server costs no read of its own: one probe for all of them asks, every few minutes, which have sent vehicle
identifiers.  A server that has is fetched as far back as it may have been missed and is awake from then on: fetched
every few seconds, until it sends no identifiers for a while.  What a poll does is decided on the driver, a few numbers
per server; the points are read by the executors, one partition a fetch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

POINTS = "server_id long, vehicle_number long, metric string, second long, value double"


@dataclass(frozen=True)
class Polling:
    """Seconds between polls of awake servers, between probes, without identifiers until sleep, and fetched on waking or return."""

    awake_seconds: int = 5
    probe_seconds: int = 300
    sleep_seconds: int = 300
    back_seconds: int = 300
    silence_seconds: int = 20


@dataclass
class Fetch(InputPartition):
    """Points of a server after one second up to another."""

    server: int
    after: int
    until: int


Newest = Callable[[list[int], int, int], dict[int, int]]


def polled(state: dict, now: int, servers: list[int], newest: Newest, cfg: Polling, wanted: tuple[int, ...] = ()) -> tuple[dict, list[Fetch]]:
    """The state after a poll at ``now`` and what it fetches.

    ``state`` holds ``probe`` (when the next one is due) and ``awake``: for each server the newest identifier seen and
    until when it was fetched.  ``newest`` tells the newest identifier of servers in a span, for those that have one.
    A server whose identifiers come back after silence is fetched anew for the last minutes, which takes in what came
    late; ``wanted`` servers wake at once.  Spans may overlap, points are told apart later.
    """
    awake = {int(k): dict(v) for k, v in state.get("awake", {}).items()}
    fetches = []
    found = newest(sorted(awake), min((a["until"] for a in awake.values()), default=now), now) if awake else {}
    for server, at in sorted(awake.items()):
        seen = found.get(server)
        back = seen is not None and seen > at["seen"] and seen - at["seen"] >= cfg.silence_seconds + cfg.awake_seconds
        fetches.append(Fetch(server, min(at["until"], now - cfg.back_seconds) if back else at["until"], now))
        at["until"] = now
        at["seen"] = max(at["seen"], seen or 0)
    awake = {k: v for k, v in awake.items() if now - v["seen"] < cfg.sleep_seconds}
    probe = state.get("probe", now)
    asked = [s for s in servers if s not in awake] if now >= probe else []
    waking = newest(asked, now - cfg.probe_seconds, now) if asked else {}
    for server in sorted({*waking, *(s for s in wanted if s not in awake)}):
        awake[server] = {"seen": waking.get(server, now), "until": now}
        fetches.append(Fetch(server, now - cfg.back_seconds, now))
    return {"awake": {str(k): v for k, v in awake.items()}, "probe": now + cfg.probe_seconds if now >= probe else probe}, fetches


class FolderServers:
    """Servers whose points lie as Parquet under one address that every executor can read."""

    def __init__(self, path: str) -> None:
        import pyarrow.dataset

        self._dataset = pyarrow.dataset.dataset(path, format="parquet")
        self._field = pyarrow.dataset.field

    def newest(self, servers: list[int], after: int, until: int) -> dict[int, int]:
        f = self._field
        own = f("server_id").isin(servers) & (f("metric") == "vehicle_identifier") & (f("second") > after) & (f("second") <= until)
        rows = self._dataset.to_table(columns=["server_id", "second"], filter=own).group_by("server_id").aggregate([("second", "max")])
        return dict(zip(rows["server_id"].to_pylist(), rows["second_max"].to_pylist(), strict=True))

    def points(self, fetch: Fetch) -> Iterator[pa.RecordBatch]:
        f = self._field
        names = [c.strip().split(" ")[0] for c in POINTS.split(",")]
        yield from self._dataset.to_batches(columns=names, filter=(f("server_id") == fetch.server) & (f("second") > fetch.after) & (f("second") <= fetch.until))


class PlanLog:
    """What every poll decided, by number, in a folder; a restart goes on behind the newest plan."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self._files, self._base = fs.FileSystem.from_uri(uri)
        self._files.create_dir(self._base, recursive=True)
        self._selector = fs.FileSelector

    def newest(self) -> int:
        return max((int(f.base_name[:-5]) for f in self._files.get_file_info(self._selector(self._base)) if f.base_name.endswith(".json")), default=0)

    def read(self, number: int) -> dict:
        with self._files.open_input_stream(f"{self._base}/{number:09d}.json") as file:
            return json.loads(file.read())

    def write(self, number: int, plan: dict) -> None:
        with self._files.open_output_stream(f"{self._base}/{number:09d}.part") as file:
            file.write(json.dumps(plan, sort_keys=True).encode())
        self._files.move(f"{self._base}/{number:09d}.part", f"{self._base}/{number:09d}.json")


class PollReader(DataSourceStreamReader):
    """An offset is the number of a plan; a plan holds some polls, and is written before its offset is given out."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.log = options["path"], PlanLog(options["plans"])
        self.servers = json.loads(options["servers"])
        self.start, self.end, self.polls = int(options["start"]), int(options["end"]), int(options.get("polls", "60"))
        self.cfg = Polling(**json.loads(options.get("polling", "{}")))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"plan": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        number = self.log.newest()
        plan = self.log.read(number) if number else {"now": self.start - self.cfg.awake_seconds, "state": {}, "fetches": []}
        now, state, fetches = plan["now"], plan["state"], []
        servers = FolderServers(self.path)
        for _ in range(self.polls):
            if now + self.cfg.awake_seconds > self.end:
                break
            now += self.cfg.awake_seconds
            state, found = polled(state, now, self.servers, servers.newest, self.cfg)
            fetches += [asdict(f) for f in found]
        if now == plan["now"]:
            return {"plan": number}
        self.log.write(number + 1, {"now": now, "state": state, "fetches": fetches})
        return {"plan": number + 1}

    def partitions(self, start: dict, end: dict) -> list[Fetch]:
        return [Fetch(**f) for number in range(start["plan"] + 1, end["plan"] + 1) for f in self.log.read(number)["fetches"]]

    def read(self, partition: Fetch) -> Iterator[pa.RecordBatch]:
        yield from FolderServers(self.path).points(partition)


class PolledServers(DataSource):
    """``spark.readStream.format("polled_servers")`` with ``path``, ``plans`` (a folder for plans), ``servers``, ``start``, ``end``, and perhaps ``polls`` a micro-batch and ``polling``."""

    @classmethod
    def name(cls) -> str:
        return "polled_servers"

    def schema(self) -> str:
        return POINTS

    def streamReader(self, schema) -> PollReader:  # noqa: N802
        return PollReader(dict(self.options))
