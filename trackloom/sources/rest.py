"""Trajectories from a REST service as a Python data source; credentials come from options, never from code."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str, dict], tuple[int, str]]


class Token:
    """OAuth2 client-credentials token, fetched again shortly before it ends."""

    def __init__(self, url: str, client_id: str, secret: str, fetch: Fetch, now: Callable[[], float] = time.time):
        self.url, self.form, self.fetch, self.now = url, {"grant_type": "client_credentials", "client_id": client_id, "client_secret": secret}, fetch, now
        self.value, self.ends = None, 0.0

    def get(self) -> str:
        if self.value is None or self.now() >= self.ends - 60:
            status, body = self.fetch(self.url, self.form)
            if status != 200:
                raise PermissionError(f"token request: status {status}")
            got = json.loads(body)
            self.value, self.ends = got["access_token"], self.now() + float(got.get("expires_in", 1800))
        return self.value


def http(url: str, form: dict | None = None, token: str | None = None, timeout: float = 30.0) -> tuple[int, str]:
    request = urllib.request.Request(url, urllib.parse.urlencode(form).encode() if form else None, {"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, ""


def checked(status: int, body: str) -> dict:
    """404 is an empty answer; refusals and limits are errors."""
    if status == 404:
        return {}
    if status in (401, 403, 429) or status >= 500:
        raise ConnectionError(f"service refused: status {status}")
    return json.loads(body or "{}")


def path_rows(payload: dict, icao: str) -> Iterator[tuple]:
    """Positional [time, lat, lon, altitude, ...] entries; entries without a position are left out."""
    callsign = (payload.get("callsign") or "").strip().upper() or icao
    for p in payload.get("path") or []:
        if len(p) > 3 and p[1] is not None and p[2] is not None:
            yield icao, callsign, float(p[0]), float(p[1]), float(p[2]), float(p[3] or 0.0)


def state_rows(payload: dict, asked: float) -> Iterator[tuple]:
    """Positional state vectors [icao24, callsign, , time, , lon, lat, altitude, ...] with a position."""
    for v in payload.get("states") or []:
        if len(v) > 7 and v[5] is not None and v[6] is not None:
            yield v[0].lower(), (v[1] or "").strip().upper(), float(v[3] or asked), float(v[6]), float(v[5]), float(v[7] or 0.0)


ROWS = "icao24 string, callsign string, time_unix double, lat double, lon double, alt_m double"


class _Reader(DataSourceReader):
    """Asks with the options' credentials: ``token``, or ``token_url``, ``client_id`` and ``client_secret``, with which every
    partition's task fetches its own."""

    def __init__(self, options: dict):
        self.options = options

    def get(self, url: str, **query) -> dict:
        o = self.options
        if "own" not in self.__dict__:
            self.own = Token(o["token_url"], o.get("client_id", ""), o.get("client_secret", ""), http).get if o.get("token_url") else lambda: o.get("token")
        return checked(*http(f"{url}?{urllib.parse.urlencode(query)}", token=self.own()))


class _Tracks(_Reader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x.strip().lower()) for x in self.options.get("icao24", "").split(",") if x.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from path_rows(self.get(self.options["url"], icao24=partition.value, time=self.options.get("begin", "0")), partition.value)


class _States(_Reader):
    def partitions(self) -> list[InputPartition]:
        o = self.options
        begin, end, step = (float(o.get(k, d)) for k, d in (("begin", 0), ("end", o.get("begin", 0)), ("step", 300)))
        return [InputPartition(begin + k * step) for k in range(int((end - begin) // step) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        query = {k: self.options[k] for k in ("icao24", "lamin", "lamax", "lomin", "lomax") if self.options.get(k)}
        if partition.value:
            query["time"] = int(partition.value)
        try:
            payload = self.get(self.options["url"], **query)
        except (OSError, ValueError):  # a moment that can't be had is left out, unless all must be
            if self.options.get("strict", "false") == "true":
                raise
            return
        yield from state_rows(payload, partition.value)


class TrackSource(DataSource):
    """``spark.read.format("rest_tracks")``; options ``url``, ``icao24`` (comma-separated), ``begin`` and credentials."""

    @classmethod
    def name(cls) -> str:
        return "rest_tracks"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Tracks(dict(self.options))


class StateSource(TrackSource):
    """``spark.read.format("rest_states")``: states of all aircraft at every ``step`` seconds from ``begin`` to ``end``, a
    partition for each; without them, now. Options ``url``, ``icao24``, ``lamin, lamax, lomin, lomax``, ``strict`` and
    credentials."""

    @classmethod
    def name(cls) -> str:
        return "rest_states"

    def reader(self, schema) -> DataSourceReader:
        return _States(dict(self.options))


def find_icao24(states: DataFrame, callsign: str) -> DataFrame:
    """``icao24, callsign`` of the first aircraft, by callsign, whose callsign contains the one asked for in any case."""
    found = states.filter(F.upper("callsign").contains(callsign.strip().upper()))
    return found.select(F.lower("icao24").alias("icao24"), "callsign").orderBy("callsign", "icao24").limit(1)


def tracks_or_states(tracks: DataFrame, states: DataFrame) -> DataFrame:
    """``tracks``, and for aircraft without any what was seen of them in ``states``."""
    return tracks.unionByName(states.join(tracks.select("icao24").distinct(), "icao24", "left_anti").select(*tracks.columns))
