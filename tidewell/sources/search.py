"""Mall search over HTTP as a Python data source: a partition for each keyword.

    spark.dataSource.register(MallSearch)
    spark.read.format("mall_search").option("base_url", ...).option("keywords", "rtx 5080,rx 9070").load()

Rows are (keyword, url, status_code, html, crawled_at, error); a failed fetch is
a row with its error, so one keyword's failure is not the batch's.
"""

from __future__ import annotations

import datetime
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.dictionaries import ALWAYS_RETRY, BACKOFF_SECONDS, NEVER_RETRY

AGENT = "Mozilla/5.0 (compatible; tidewell)"


class FetchError(Exception):
    """kind: Timeout, HTTPError or RetryExhausted."""

    def __init__(self, kind: str, url: str, status: int | None = None, attempts: int = 1):
        super().__init__(f"{kind} for {url}" + (f" (status {status})" if status else ""))
        self.kind, self.url, self.status, self.attempts = kind, url, status, attempts


def retries(status: int) -> bool:
    """SRC-5."""
    return status not in NEVER_RETRY and (status in ALWAYS_RETRY or status >= 500)


def delay(attempt: int, delays: tuple[float, ...] = BACKOFF_SECONDS) -> float:
    """SRC-6."""
    return delays[min(attempt, len(delays) - 1)] if delays else 0.0


def _open(url: str, timeout: float) -> tuple[int, str, str]:
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:  # follows redirects
            return response.status, response.read().decode(response.headers.get_content_charset() or "utf-8", "replace"), response.url
    except urllib.error.HTTPError as e:
        return e.code, "", url


def fetch(url: str, timeout: float = 30.0, max_retries: int = 3, opener: Callable = _open, sleep: Callable = time.sleep) -> tuple[int, str, str]:
    """SRC-4, SRC-7: (status, text, final url) of a 200, else FetchError."""
    for attempt in range(max_retries + 1):
        last = attempt == max_retries
        try:
            status, text, final = opener(url, timeout)
        except (TimeoutError, socket.timeout):
            if last:
                raise FetchError("Timeout", url, attempts=attempt + 1) from None
        except (urllib.error.URLError, OSError) as e:
            timed_out = isinstance(getattr(e, "reason", None), TimeoutError)
            if last:
                raise FetchError("Timeout" if timed_out else "RetryExhausted", url, attempts=attempt + 1) from e
        else:
            if status == 200:
                return status, text, final
            if not retries(status):
                raise FetchError("HTTPError", url, status, attempt + 1)
            if last:
                raise FetchError("RetryExhausted", url, status, attempt + 1)
        sleep(delay(attempt))
    raise AssertionError("unreachable")


class _Keyword(InputPartition):
    def __init__(self, keyword: str):
        self.keyword = keyword


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base = options["base_url"]
        self.keywords = [k.strip() for k in options.get("keywords", "").split(",") if k.strip()]
        self.timeout, self.retries = float(options.get("timeout", "30")), int(options.get("max_retries", "3"))
        self.crawled_at = options.get("crawled_at") or datetime.datetime.now(datetime.UTC).isoformat()

    def partitions(self) -> list[InputPartition]:
        return [_Keyword(k) for k in self.keywords]

    def read(self, partition: _Keyword) -> Iterator[tuple]:
        url = f"{self.base}?{urllib.parse.urlencode({'target': 'all', 'query': partition.keyword})}"
        try:
            status, text, final = fetch(url, self.timeout, self.retries)
            yield partition.keyword, final, status, text, self.crawled_at, None
        except FetchError as e:
            yield partition.keyword, url, e.status, None, self.crawled_at, str(e)


class MallSearch(DataSource):
    """SRC-1, SRC-3."""

    @classmethod
    def name(cls) -> str:
        return "mall_search"

    def schema(self) -> str:
        return "keyword string, url string, status_code int, html string, crawled_at string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
