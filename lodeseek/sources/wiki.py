"""A data source for the pages of a wiki's REST interface: as a table, and as a stream of changes."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Answers after which a read is tried again, and pages of one answer.
_AGAIN, _PAGE = (429, 500, 502, 503, 504), 25
_EXPLAINED = {401: "the token is refused", 403: "the token may not read this", 404: "there is no such page"}


def fetch(url: str, token: str, tries: int = 3, wait: float = 1.0) -> dict:
    """A JSON object by GET, with retries and readable errors."""
    for attempt in range(tries + 1):
        try:
            request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}", "Accept": "application/json"})
            with urllib.request.urlopen(request, timeout=30) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in _AGAIN or attempt == tries:
                raise RuntimeError(f"{url}: {_EXPLAINED.get(e.code, f'answer {e.code}')}") from e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:  # a lost connection may come back
            if attempt == tries:
                raise RuntimeError(f"{url}: can't be reached ({e})") from e
        except json.JSONDecodeError as e:
            raise RuntimeError(f"{url}: the answer isn't JSON") from e
        time.sleep(wait * 2**attempt)
    raise AssertionError


_SCHEMA = "root_ord int, pos int, id string, title string, space string, updated string, storage string"
_EXPAND = "body.storage,version,space"


class _Service:
    """Lists of pages of the service, which are read by offset."""

    def __init__(self, options):
        self.url, self.token, self.wait = options["url"].rstrip("/"), options.get("token", ""), float(options.get("wait", "1"))
        self.roots = [r.strip() for r in options["roots"].split(",")]
        self.range = max(1, int(options.get("rangePages", "250")) // _PAGE) * _PAGE

    def page(self, root: str) -> dict:
        return fetch(f"{self.url}/rest/api/content/{root}?expand={_EXPAND}", self.token, wait=self.wait)

    def listed(self, cql: str, start: int, limit: int = _PAGE) -> list[dict]:
        query = urllib.parse.urlencode({"cql": cql, "expand": _EXPAND, "limit": limit, "start": start})
        return fetch(f"{self.url}/rest/api/content/search?{query}", self.token, wait=self.wait)["results"]

    def ranges(self, cql: str) -> list[tuple[int, int | None]]:
        """Offsets that cut a list into ranges; their number is found by probing, in as many requests as it has bits. The last has no end."""
        there = lambda n: bool(self.listed(cql, n * self.range, 1))
        low, high = 0, 1
        while there(high):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        cuts = [n * self.range for n in range(low + 1)]
        return list(zip(cuts, [*cuts[1:], None], strict=True))

    def pages(self, cql: str, start: int, end: int | None) -> Iterator[tuple[int, dict]]:
        """(offset, page) of a range, up to the first short answer."""
        while end is None or start < end:
            some = self.listed(cql, start)
            yield from enumerate(some, start)
            if len(some) < _PAGE:
                return
            start += _PAGE


def _row(root: int, pos: int, p: dict) -> tuple:
    return (root, pos, p["id"], p.get("title", ""), p.get("space", {}).get("key", ""), p.get("version", {}).get("when", ""), p.get("body", {}).get("storage", {}).get("value", ""))


class WikiSource(DataSource):
    """Format ``wiki``: the pages below some roots, as a table or as a stream of changes.

    Options: url, token, roots (ids, comma-separated), rangePages (pages of a partition,
    250), wait (seconds before the first retry), dumpRaw (a file or address to which the
    first page goes as the service gives it, to look at). A stream starts with all pages, or, with
    the option since, with those changed after that time.
    """

    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WikiReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return WikiChanges(self.options)


class WikiReader(DataSourceReader):
    """Each root, then its descendants as the service lists them; a partition for each range of the list."""

    def __init__(self, options):
        self.service, self.dump = _Service(options), options.get("dumpRaw")

    def _cql(self, root: str) -> str:
        return f"ancestor={root} and type=page"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((k, *cut)) for k, root in enumerate(self.service.roots) for cut in self.service.ranges(self._cql(root))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        k, start, end = partition.value
        root = self.service.roots[k]
        if start == 0:
            first = self.service.page(root)
            if k == 0 and self.dump:
                fs, path = pafs.FileSystem.from_uri(self.dump if "://" in self.dump else f"file://{self.dump}")
                with fs.open_output_stream(path) as out:
                    out.write(json.dumps(first, ensure_ascii=False, indent=1).encode())
            yield _row(k, 0, first)
        for pos, page in self.service.pages(self._cql(root), start, end):
            yield _row(k, pos + 1, page)


def _instant(when: str) -> str:
    """A version's time in UTC, in a form whose order is that of time; empty where there is none."""
    try:
        return datetime.fromisoformat(when).astimezone(UTC).isoformat(timespec="microseconds")
    except (TypeError, ValueError):
        return ""


class WikiChanges(DataSourceStreamReader):
    """Pages by the time of their version: an offset is such a time, a batch has the pages changed after its start and up to its end.

    A page that changes again while a batch is read has a later time, so the next batch
    has it. Lists are in order of creation, which changes don't alter, so no page slips
    through between two requests. Pages without a time come with the first batch.
    """

    def __init__(self, options):
        self.service, self.since = _Service(options), _instant(options.get("since", ""))

    def _cql(self, root: str, start: str) -> str:
        # The service compares days in its own time zone; the exact time is compared in read.
        day = f' and lastmodified >= "{(datetime.fromisoformat(start) - timedelta(days=1)).date()}"' if start else ""
        return f"(id={root} or ancestor={root}) and type=page{day}"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": self.since}

    def latestOffset(self) -> dict:  # noqa: N802
        newest = [p for root in self.service.roots for p in self.service.listed(f"{self._cql(root, '')} order by lastmodified desc", 0, 1)[:1]]
        return {"until": max([self.since, *(_instant(p.get("version", {}).get("when", "")) for p in newest)])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["until"] >= end["until"]:
            return []
        lists = [(k, f"{self._cql(root, start['until'])} order by created") for k, root in enumerate(self.service.roots)]
        return [InputPartition((k, cql, *cut, start["until"], end["until"])) for k, cql in lists for cut in self.service.ranges(cql)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        k, cql, first, last, start, end = partition.value
        for pos, page in self.service.pages(cql, first, last):
            when = _instant(page.get("version", {}).get("when", ""))
            if start < when <= end or when == start == "":
                yield _row(k, pos, page)
