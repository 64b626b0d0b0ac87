"""Remote record services as Spark data sources: chunks become partitions, the time filter and the selected fields go to the service.

Nothing is fetched on the driver. The fetch function is looked up by name on the executors, so saved responses can stand in for a service.
"""

from __future__ import annotations

import importlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RETRIES, LONGEST_WAIT = 3, 10


class Truncated(Exception):
    """The service cut its answer off."""


def with_retries(call: Callable[[], list], retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> list:
    """Try up to ``retries`` times, waiting min(2 ** n, 10) seconds between; truncation isn't retried."""
    for n in range(1, retries + 1):
        try:
            return call()
        except Truncated:
            raise
        except (OSError, ValueError, urllib.error.URLError):
            if n == retries:
                raise
            sleep(min(2**n, LONGEST_WAIT))
    return []


def halved(fetch: Callable[[int, int], list], start: int, end: int, limit: int | None = None) -> Iterator[dict]:
    """Records of [start, end): a truncated answer (or one of at least ``limit`` rows) is fetched again in halves; at an hour or less it is an error."""
    try:
        rows = fetch(start, end)
        cut = limit is not None and len(rows) >= limit
    except Truncated:
        rows, cut = [], True
    if not cut:
        yield from rows
        return
    if end - start <= 3600:
        raise RuntimeError(f"still truncated within an hour: {start}..{end}")
    middle = (start + end) // 2
    yield from halved(fetch, start, middle, limit)
    yield from halved(fetch, middle, end, limit)


def year_chunks(start: int, end: int) -> list[tuple[int, int]]:
    out, a = [], start
    while a < end:
        b = min(int(datetime(datetime.fromtimestamp(a, timezone.utc).year + 1, 1, 1, tzinfo=timezone.utc).timestamp()), end)
        out.append((a, b))
        a = b
    return out


def day_chunks(start: int, end: int, days: int) -> list[tuple[int, int]]:
    return [(a, min(a + days * 86400, end)) for a in range(start, end, days * 86400)]


def local_day_chunks(start: int, end: int, days: int, tz: str = "Europe/Paris") -> list[tuple[int, int]]:
    """Chunks of whole local days: their edges are local midnights, also on days of 23 and 25 hours."""
    zone = ZoneInfo(tz)
    day = datetime.fromtimestamp(start, zone).replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    out = []
    while True:
        a = int(day.replace(tzinfo=zone).timestamp())
        if a >= end:
            return out
        day += timedelta(days=days)
        out.append((a, min(int(day.replace(tzinfo=zone).timestamp()), end)))


class TokenClient:
    """Bearer tokens from client credentials: kept until 30 seconds before they end, renewed once on a 401. Secrets come from the environment only."""

    def __init__(self, token_url: str, id_variable: str, secret_variable: str, opener: Callable = urllib.request.urlopen):
        self.token_url, self.variables, self.open = token_url, (id_variable, secret_variable), opener
        self.token, self.until = "", 0.0

    def bearer(self) -> str:
        if time.time() >= self.until - 30:
            import base64

            pair = ":".join(os.environ[v] for v in self.variables)
            request = urllib.request.Request(self.token_url, data=b"", headers={"Authorization": "Basic " + base64.b64encode(pair.encode()).decode()})
            with self.open(request) as r:
                answer = json.load(r)
            self.token, self.until = answer["access_token"], time.time() + float(answer.get("expires_in", 0))
        return self.token

    def get(self, url: str) -> tuple[int, bytes]:
        for again in (False, True):
            try:
                with self.open(urllib.request.Request(url, headers={"Authorization": f"Bearer {self.bearer()}"})) as r:
                    return r.status, r.read()
            except urllib.error.HTTPError as e:
                if e.code != 401 or again:
                    raise
                self.until = 0.0
        raise RuntimeError("unreachable")


def export_url(base: str, dataset: str, fields: list[str], start: int, end: int, populated: str | None = None) -> str:
    """URL of an export that selects the fields and the time range, optionally only rows with a value in ``populated``."""
    iso = lambda t: datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    where = f"date_heure >= '{iso(start)}' AND date_heure < '{iso(end)}'"
    if populated:
        where = f"{populated} IS NOT NULL AND {where}"
    return f"{base}/catalog/datasets/{dataset}/exports/json?" + urllib.parse.urlencode({"select": ",".join(["date_heure", *fields]), "where": where, "timezone": "UTC"})


def http_export(options: dict, start: int, end: int) -> list[dict]:
    """Records of an open-data export."""
    url = export_url(options["base_url"], options["dataset"], options["fields"].split(","), start, end, options.get("populated"))
    with urllib.request.urlopen(url, timeout=float(options.get("timeout", "60"))) as r:
        if r.status == 206:
            raise Truncated
        return json.load(r)


_clients: dict[tuple, TokenClient] = {}


def token_api(options: dict, start: int, end: int) -> list[dict]:
    """Records of a service with client credentials: options ``url`` (with ``{start}`` and ``{end}`` for ISO instants), ``token_url``, ``id_variable``,
    ``secret_variable`` and ``field`` (the list in the answer). A worker keeps its token for the next chunk."""
    key = (options["token_url"], options["id_variable"], options["secret_variable"])
    client = _clients.setdefault(key, TokenClient(*key))
    iso = lambda t: urllib.parse.quote(datetime.fromtimestamp(t, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
    status, body = client.get(options["url"].format(start=iso(start), end=iso(end)))
    if status == 206:
        raise Truncated
    return json.loads(body)[options["field"]]


class Chunk(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def chunks(options: dict, start: int, end: int) -> list[Chunk]:
    """The span in the chunks that the option asks for, one partition each."""
    kind, _, n = options.get("chunk", "year").partition(":")
    cut = {"year": year_chunks, "days": lambda a, b: day_chunks(a, b, int(n)), "local_days": lambda a, b: local_day_chunks(a, b, int(n))}[kind]
    return [Chunk(a, b) for a, b in cut(start, end)]


def _fetcher(options: dict) -> Callable[[dict, int, int], list]:
    module, _, name = options.get("fetch", "emberline.sources.remote:http_export").partition(":")
    return getattr(importlib.import_module(module), name)


class RecordsSource(DataSource):
    """``spark.read.format("emberline_records")`` with options start, end (epoch seconds), chunk (``year``, ``days:N`` or ``local_days:N``), fetch
    (``module:function``) and what the fetch function needs; rows are ``t bigint, value string`` (the record as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "emberline_records"

    def schema(self) -> str:
        return "t bigint, value string"

    def reader(self, schema) -> DataSourceReader:
        return RecordsReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RecordsStream(dict(self.options))


class RecordsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.low, self.high = options, int(options["start"]), int(options["end"])

    def pushFilters(self, filters):
        """Bounds on ``t`` narrow the chunks that are fetched; every filter is also left to Spark."""
        from pyspark.sql.datasource import GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

        for f in filters:
            if getattr(f, "attribute", None) == ("t",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + 1)
            yield f

    def partitions(self):
        return chunks(self.options, self.low, self.high) or [Chunk(0, 0)]

    def read(self, partition):
        if partition.end <= partition.start:
            return
        fetch, o = _fetcher(self.options), self.options
        limit = int(o["limit"]) if "limit" in o else None
        for r in halved(lambda a, b: with_retries(lambda: fetch(o, a, b)), partition.start, partition.end, limit):
            stamp = r.get(o.get("time", "date_heure")) or r.get("timestamp")
            yield (int(datetime.fromisoformat(str(stamp).replace("Z", "+00:00")).timestamp()) if stamp else None, json.dumps(r, sort_keys=True))


class RecordsStream(DataSourceStreamReader):
    """Polls the service from the last instant read on; a trigger sets the refresh. The driver only names spans, executors fetch them."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"t": int(self.options["start"])}

    def latestOffset(self) -> dict:
        return {"t": max(int(self.options["start"]), int(self.options.get("now", time.time())))}

    def partitions(self, start: dict, end: dict):
        return chunks(self.options, start["t"], end["t"]) or [Chunk(0, 0)]

    def read(self, partition):
        return RecordsReader({"end": "0", **self.options}).read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to free: the service keeps its records."""


def register(spark) -> None:
    spark.dataSource.register(RecordsSource)
