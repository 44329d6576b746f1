"""Upstream API: requests with retries, a conditional cache, listings with safe paging, node batches, and a data source.

Requests go through a ``Transport``, so recorded responses stand for the network in tests.
"""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tries after failures of the server and after rate limits; seconds of the first wait; the longest wait that is borne.
TRIES, LIMITED_TRIES, FIRST_WAIT, LONGEST_WAIT = 3, 5, 60.0, 3660.0
BATCH = 50


@dataclass
class Response:
    status: int
    body: str = ""
    headers: dict[str, str] = field(default_factory=dict)

    def header(self, name: str) -> str:
        return next((v for k, v in self.headers.items() if k.lower() == name.lower()), "")


Transport = Callable[[str, str, dict[str, str], str], Response]  # method, url, headers, body


class ApiError(RuntimeError):
    pass


class Budget:
    """Requests that a run may still make, slots for those at a time, a pause that all keep to, and the first fatal error."""

    def __init__(self, most: int = 1 << 30, slots: int = 4, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.left, self.until, self.fatal = most, 0.0, None
        self.slots, self.lock, self.clock, self.sleep = threading.Semaphore(slots), threading.Lock(), clock, sleep

    def __enter__(self) -> Budget:
        self.slots.acquire()
        try:
            while True:
                with self.lock:
                    if self.fatal:
                        raise self.fatal
                    wait = self.until - self.clock()
                    if wait <= 0:
                        if self.left <= 0:
                            raise ApiError("the request budget is used up")
                        self.left -= 1
                        return self
                self.sleep(wait)
        except BaseException:
            self.slots.release()
            raise

    def __exit__(self, *_) -> None:
        self.slots.release()

    def pause(self, seconds: float) -> None:
        with self.lock:
            self.until = max(self.until, self.clock() + seconds)

    def fail(self, why: Exception) -> None:
        with self.lock:
            self.fatal = self.fatal or why


@dataclass
class Client:
    origin: str
    send: Transport
    budget: Budget = field(default_factory=Budget)
    cache: dict[str, tuple[str, str, dict]] = field(default_factory=dict)  # url: etag, body, headers
    now: Callable[[], float] = time.time

    def _waits(self, r: Response, tries: int) -> float | None:
        """Seconds to wait for a rate limit; None if it is none. Without a time given the wait doubles from FIRST_WAIT."""
        limited = r.status == 429 or r.status == 403 and (r.header("Retry-After") or r.header("X-RateLimit-Remaining") == "0" or "rate limit" in r.body.lower())
        if not limited:
            return None
        if after := r.header("Retry-After"):
            return float(after)
        if r.header("X-RateLimit-Remaining") == "0" and (at := r.header("X-RateLimit-Reset")):
            return max(0.0, float(at) - self.now())
        return FIRST_WAIT * 2**tries

    def request(self, url: str, method: str = "GET", body: str = "", headers: dict[str, str] | None = None) -> Response:
        failed = limited = 0
        while True:
            with self.budget:
                r = self.send(method, url, headers or {}, body)
            wait = self._waits(r, limited)
            if wait is not None:
                limited += 1
                if wait > LONGEST_WAIT or limited >= LIMITED_TRIES:
                    why = ApiError(f"{url}: the rate limit asks for {wait:.0f} s")
                    self.budget.fail(why)
                    raise why
                self.budget.pause(wait)
            elif r.status >= 500:
                failed += 1
                if failed >= TRIES:
                    raise ApiError(f"{url}: status {r.status}")
                self.budget.pause(2.0**failed)
            else:
                return r

    def get(self, url: str) -> Response:
        """With a known ETag the body may come from the cache; incremental listings (since=) are never kept."""
        keep = "since" not in dict(parse_qsl(urlsplit(url).query))
        known = self.cache.get(url) if keep else None
        r = self.request(url, headers={"If-None-Match": known[0]} if known else None)
        if r.status == 304 and known:
            return Response(200, known[1], known[2])
        if r.status == 200 and keep and r.header("ETag"):
            self.cache[url] = r.header("ETag"), r.body, r.headers
        return r

    def lookup(self, path: str) -> dict | None:
        """An object, None if it is gone or has moved."""
        r = self.get(self.origin + path)
        if r.status in (301, 404, 410):
            return None
        if r.status != 200:
            raise ApiError(f"{path}: status {r.status}")
        return json.loads(r.body)

    def links(self, r: Response, url: str) -> dict[str, str]:
        """Relations of a Link header; a link elsewhere, or two of a relation, is an error."""
        out: dict[str, str] = {}
        here = urlsplit(url)
        for target, rel in re.findall(r'<([^>]*)>\s*;\s*rel="([^"]*)"', r.header("Link")):
            at = urlsplit(target)
            if (at.scheme, at.netloc, at.path) != (here.scheme, here.netloc, here.path) or rel in out:
                raise ApiError(f"{url}: unsafe link {target}")
            out[rel] = target
        return out

    def pages(self, path: str) -> Iterator[list]:
        """The pages of a listing. If the first names a numbered last page the rest is that range; else next links are
        followed one by one, none of them twice."""
        url = self.origin + path
        seen = set()
        while url:
            if url in seen:
                raise ApiError(f"{url}: the listing repeats a page")
            seen.add(url)
            r = self.get(url)
            if r.status != 200:
                raise ApiError(f"{url}: status {r.status}")
            yield json.loads(r.body)
            url = self.links(r, url).get("next", "")

    def numbered(self, path: str) -> list[str] | None:
        """Urls of all pages if the listing has numbered ones, else None. Each can be fetched by itself."""
        first = self.origin + path
        links = self.links(self.get(first), first)
        if not links.get("next"):
            return [first]
        last, step = dict(parse_qsl(urlsplit(links.get("last", "")).query)), dict(parse_qsl(urlsplit(links["next"]).query))
        if step.get("page") != "2" or not last.get("page", "").isdigit():
            return None
        at = urlsplit(first)
        query = lambda n: urlencode([(k, v) for k, v in parse_qsl(at.query) if k != "page"] + [("page", str(n))])
        return [first, *(urlunsplit(at._replace(query=query(n))) for n in range(2, int(last["page"]) + 1))]

    def nodes(self, ids: list[str], query: str) -> dict[str, dict | None]:
        """Nodes by id, BATCH a request. An answer with other errors than NOT_FOUND, or of other nodes, is refused before
        anything of it counts; ids that aren't found are None."""
        out: dict[str, dict | None] = {}
        for i in range(0, len(ids), BATCH):
            some = ids[i : i + BATCH]
            r = self.request(f"{self.origin}/graphql", "POST", json.dumps({"query": query, "variables": {"ids": some}}))
            got = json.loads(r.body) if r.status == 200 else {}
            bad = [e for e in got.get("errors", []) if e.get("type") != "NOT_FOUND"]
            nodes = (got.get("data") or {}).get("nodes")
            if r.status != 200 or bad or not isinstance(nodes, list) or len(nodes) != len(some) or any(n and n.get("id") != x for n, x in zip(nodes, some, strict=True)):
                raise ApiError(f"nodes {i} to {i + len(some)}: {bad or r.status}")
            out |= {x: n or None for x, n in zip(some, nodes, strict=True)}
        return out


def connection(node: dict, name: str) -> tuple[list, str | None]:
    """Members of a nested connection and the cursor behind them; a connection that contradicts itself is an error."""
    c = node.get(name)
    info = (c or {}).get("pageInfo") or {}
    if not isinstance(c, dict) or not isinstance(c.get("nodes"), list) or "hasNextPage" not in info or info["hasNextPage"] and not info.get("endCursor"):
        raise ApiError(f"{name} is no whole connection")
    return [n for n in c["nodes"] if n], info["endCursor"] if info["hasNextPage"] else None


@dataclass
class PageOf(InputPartition):
    url: str

    def __init__(self, url: str):
        self.url = url


class ListingReader(DataSourceReader):
    """A partition a page where pages are numbered, else one for the listing."""

    def __init__(self, options: dict, connect: Callable[[dict], Client]):
        self.options, self.connect = options, connect

    def partitions(self) -> list[PageOf]:
        urls = self.connect(self.options).numbered(self.options["path"])
        return [PageOf(u) for u in urls] if urls else [PageOf("")]

    def read(self, partition: PageOf):
        client, path = self.connect(self.options), self.options["path"]
        if partition.url:
            r = client.get(partition.url)
            if r.status != 200:
                raise ApiError(f"{partition.url}: status {r.status}")
            bodies = [json.loads(r.body)]
        else:
            bodies = client.pages(path)
        for body in bodies:
            for item in body:
                yield partition.url or path, json.dumps(item)


def recorded(options: dict) -> Client:
    """A client over recorded responses: ``records`` is JSON of {url: [status, body, headers]}."""
    records = json.loads(options["records"])
    return Client(options["origin"], lambda method, url, headers, body: Response(*records.get(url, [404])))


class RecordedListing(DataSource):
    """``spark.read.format("listing")`` with options origin, path, records: (page, payload), a row an item."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "page string, payload string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(dict(self.options), recorded)
