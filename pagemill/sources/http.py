"""Fetching pages over HTTP: redirects, retries, a size cap, charsets, robots and per-origin delays."""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import schema
from pagemill.functions import charset, robots, urls
from pagemill.functions.expressions import url_origin
from pagemill.options import Options

#: Bytes of a body at most, unpacked; retries of a retryable status; first pause in seconds, doubled each time.
MOST_BYTES, RETRIES, PAUSE = 128 << 20, 3, 0.25
#: Rows that a task reads ahead of the slowest origin.
MOST_WAITING = 10_000
USER_AGENT = "pagemill/1.0 (+robots: pagemill)"
FIELDS = [f.name for f in schema.RAW_PAGE.fields]


class FetchError(Exception):
    def __init__(self, kind: str, detail: str):
        super().__init__(f"{kind}: {detail}")
        self.kind, self.detail = kind, detail


def read_capped(stream, url: str, limit: int = MOST_BYTES) -> bytes:
    """All of a stream, or an error as soon as it holds more than limit bytes."""
    parts, size = [], 0
    while chunk := stream.read(1 << 16):
        size += len(chunk)
        if size > limit:
            raise FetchError(schema.TOO_LARGE, url)
        parts.append(chunk)
    return b"".join(parts)


def retryable(status: int) -> bool:
    return status == 429 or 500 <= status <= 599


class HttpEngine:
    def __init__(self, options: Options, sleep: Callable[[float], None] = time.sleep):
        self.timeout, self.sleep = options.timeout_ms / 1000, sleep
        self.opener = urllib.request.build_opener()

    def once(self, url: str) -> tuple[int, str, str | None, bytes]:
        """(status, final url, content type, body) of one request; an HTTP status is never an exception."""
        request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT, "Accept-Encoding": "gzip"})
        try:
            try:
                answer = self.opener.open(request, timeout=self.timeout)
            except urllib.error.HTTPError as e:
                answer = e
            with answer:
                packed = answer.headers.get("Content-Encoding", "").lower() == "gzip"
                body = read_capped(gzip.GzipFile(fileobj=answer) if packed else answer, url)
                return answer.status, answer.geturl(), answer.headers.get("Content-Type"), body
        except (OSError, ValueError, EOFError) as e:
            raise FetchError(schema.HTTP, f"{url}: {e}") from e

    def fetch(self, url: str) -> dict:
        """Retries a retryable status; transport errors aren't retried."""
        for attempt in range(RETRIES + 1):
            status, final, kind, body = self.once(url)
            if not retryable(status) or attempt == RETRIES:
                break
            self.sleep(PAUSE * 2**attempt)
        return {"final_url": urls.normalise(final), "status": status, "html": charset.decode(kind, body), "content_type": kind}


class BrowserEngine:
    """A back end that renders pages; none is built in."""

    def __init__(self, options: Options):
        raise FetchError(schema.HTTP, "this build has no browser engine; register one with use_browser()")


_browser: Callable[[Options], object] = BrowserEngine


def use_browser(factory: Callable[[Options], object]) -> None:
    """factory(options) makes an object with fetch(url) -> dict of final_url, status, html, content_type."""
    global _browser
    _browser = factory


def engine(options: Options):
    options = options.normalised()
    return _browser(options) if options.browser else HttpEngine(options)


class Origin:
    """Rules of one origin, fetched once, and when its next request may start."""

    def __init__(self, origin: str, options: Options):
        self.obeyed, self.rules, self.next = not options.ignore_robots, robots.Rules(), 0.0
        if self.obeyed:
            try:
                status, _, kind, body = HttpEngine(options).once(f"{origin}/robots.txt")
                if 200 <= status < 300:
                    self.rules = robots.parse(charset.decode(kind, body))
            except FetchError:
                pass
        self.delay = self.rules.delay or 0.0 if self.obeyed and not options.no_delay else 0.0

    def check(self, url: str) -> None:
        path = str(url).split("://", 1)[-1]
        path = "/" + path.partition("/")[2].partition("#")[0]
        if self.obeyed and not self.rules.allowed(path):
            raise FetchError(schema.ROBOTS, url)


def fetch_rows(rows: Iterator[dict], options: Options, origins: dict[str, Origin] | None = None) -> Iterator[dict]:
    """rows (page_id, url) -> RAW_PAGE rows as they are ready; options.concurrency requests in flight.

    Robots rules are fetched once per origin, before its first page. Requests of an origin with a delay start that far
    apart, and other origins go on meanwhile, as far as MOST_WAITING rows reach. origins holds what is known of origins;
    who passes it keeps rules and delays from call to call.
    """
    fetcher, origins, rows = engine(options), {} if origins is None else origins, iter(rows)
    lines: dict[str, deque] = {}  # what waits, by origin
    ready, due = deque(), []  # origins that may go on, and those that may at a time; an origin is in one place
    running, waiting, more = {}, 0, True

    def bare(row: dict) -> dict:
        return dict.fromkeys(FIELDS) | {"page_id": row["page_id"], "requested_url": row["url"]}

    def failed(row: dict, e: FetchError) -> dict:
        return bare(row) | {"error": {"kind": e.kind, "detail": e.detail}}

    def one(row: dict, target: str) -> dict:
        try:
            return bare(row) | fetcher.fetch(target)
        except FetchError as e:
            return failed(row, e)

    with ThreadPoolExecutor(options.concurrency) as pool:
        while more or waiting or running:
            while more and waiting < MOST_WAITING:
                if (row := next(rows, None)) is None:
                    more = False
                elif (target := urls.normalise(row["url"])) is None:
                    yield failed(row, FetchError(schema.PARSE, str(row["url"])))
                else:
                    origin, waiting = urls.parse(target).origin, waiting + 1
                    if origin not in lines:
                        lines[origin] = deque()
                        ready.append(origin)
                    lines[origin].append((row, target))
            while due and due[0][0] <= time.monotonic():
                ready.append(heappop(due)[1])
            while ready and len(running) < options.concurrency:
                origin = ready.popleft()
                home, line = origins.get(origin), lines[origin]
                if home is None:
                    running[pool.submit(Origin, origin, options)] = origin
                    continue
                if home.next > time.monotonic():
                    heappush(due, (home.next, origin))
                    continue
                (row, target), waiting = line.popleft(), waiting - 1
                try:
                    home.check(target)
                    home.next = time.monotonic() + home.delay
                    running[pool.submit(one, row, target)] = None
                except FetchError as e:
                    yield failed(row, e)
                if line:
                    ready.append(origin)
                else:
                    del lines[origin]
            pause = max(0.0, due[0][0] - time.monotonic()) if due else None
            if running:
                for found in wait(running, pause, FIRST_COMPLETED).done:
                    origin = running.pop(found)
                    if origin is None:
                        yield found.result()
                    else:
                        origins[origin] = found.result()
                        ready.append(origin)
            elif pause and not ready:
                time.sleep(pause)


def fetch_pages(targets: DataFrame, options: Options) -> DataFrame:
    """targets (page_id, url) -> raw pages with an error column. One partition per origin keeps delays exact."""
    options = options.normalised()
    arrow = pa.schema([("page_id", pa.int64()), ("requested_url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("html", pa.string()), ("content_type", pa.string()), ("error", pa.struct([("kind", pa.string()), ("detail", pa.string())]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        out = []
        for row in fetch_rows(rows, options):
            out.append(row)
            if len(out) >= 64:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    dealt = targets.select("page_id", "url").repartition(url_origin(F.col("url"))).sortWithinPartitions("page_id")
    return dealt.mapInArrow(run, schema.RAW_PAGE)


def ok_pages(raw: DataFrame) -> DataFrame:
    """Pages with a 2xx status and no error."""
    return raw.where("error IS NULL AND status BETWEEN 200 AND 299")
