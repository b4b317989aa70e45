"""A paged listing as a Python data source: spark.read.format("paged_listing").

A page is a JSON file `<query>/<page>.json` below the option `root`, as an earlier run of a REST client left it: an object
with total, items and, optionally, headers. One partition reads one query, page after page, as far as the Link header of a page (or
the next file, where a page has none) leads. Beyond MOST_PAGES pages, or MOST_PAGE_BYTES in a page, it raises: nothing is
left out silently. A page that can't be read, or whose headers say that the limit is used up, is tried again after the pause
that the service asks for, else after growing ones. Nothing is fetched from a network.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator, Mapping

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "query string, page int, repository_id bigint, repository_full_name string, path string, git_blob_sha string, html_url string, private boolean"
MOST_PAGES, MOST_PAGE_BYTES, TRIES = 10, 8 * 1024 * 1024, 3


def integer(value: str | None) -> int | None:
    """A header's whole number, or None if it is malformed."""
    return int(value) if value is not None and re.fullmatch(r"[0-9]{1,18}", value.strip()) else None


def rate_limit(headers: Mapping[str, str]) -> dict[str, int | None]:
    low = {k.lower(): v for k, v in headers.items()}
    return {k: integer(low.get(f"x-ratelimit-{k}")) for k in ("limit", "remaining", "reset")} | {"retry_after": integer(low.get("retry-after"))}


def pause(attempt: int, headers: Mapping[str, str], now: float, most: float = 60.0) -> float:
    """Seconds to wait before a further attempt: what the service asks for, else twice as long each time."""
    limits = rate_limit(headers)
    if limits["retry_after"] is not None:
        return min(most, limits["retry_after"])
    if limits["remaining"] == 0 and limits["reset"] is not None:
        return min(most, max(0.0, limits["reset"] - now))
    return min(most, 0.5 * 2**attempt)


def next_page(link: str | None) -> str | None:
    """The address a Link header gives for the next page."""
    for part in (link or "").split(","):
        m = re.fullmatch(r'\s*<([^>]+)>\s*;.*?rel="?next"?.*', part)
        if m:
            return m.group(1)
    return None


class _Query(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.root = options["root"]
        self.pages = int(options.get("pages", MOST_PAGES))
        self.longest_pause = float(options.get("longest_pause", 60.0))
        if not 1 <= self.pages <= MOST_PAGES:
            raise ValueError(f"pages must be between 1 and {MOST_PAGES}")

    def partitions(self) -> list[_Query]:
        return [_Query(n) for n in sorted(os.listdir(self.root)) if os.path.isdir(os.path.join(self.root, n))]

    def _page(self, path: str) -> dict:
        for attempt in range(TRIES):
            headers: Mapping[str, str] = {}
            try:
                if os.path.getsize(path) > MOST_PAGE_BYTES:
                    raise ValueError(f"page too large: {path}")
                with open(path, encoding="utf-8") as f:
                    page = json.load(f)
                headers = page.get("headers", {})
                if "items" in page:
                    return page
                if page.get("status") not in (403, 429, 500, 502, 503, 504):
                    raise ValueError(f"not a page: {path}")
            except OSError:
                if attempt == TRIES - 1:
                    raise
            if attempt < TRIES - 1:
                time.sleep(pause(attempt, headers, time.time(), self.longest_pause))
        raise OSError(f"no page after {TRIES} tries: {path}")

    def read(self, partition: _Query) -> Iterator[tuple]:
        folder, number, path = os.path.join(self.root, partition.name), 1, "1.json"
        while path is not None and os.path.exists(os.path.join(folder, path)):
            if number > self.pages:
                if self.pages == MOST_PAGES:
                    raise ValueError(f"more than {MOST_PAGES} pages for {partition.name}")
                return
            page = self._page(os.path.join(folder, path))
            for item in page["items"]:
                repository = item["repository"]
                yield partition.name, number, repository["id"], repository["full_name"], item["path"], item["sha"], item["html_url"], bool(repository.get("private"))
            number += 1
            link = {k.lower(): v for k, v in page.get("headers", {}).items()}.get("link")
            path = f"{number}.json" if link is None else None if (following := next_page(link)) is None else os.path.basename(following)


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
