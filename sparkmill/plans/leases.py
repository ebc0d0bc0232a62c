"""Permits and rate limits of a whole run: tasks lease every call from one small service beside the driver.

The service holds a provider's concurrency, its requests and its tokens of any 60 seconds; a share that one task leaves
unused is there for the others. A lease is asked for over a local socket when a call is about to be sent, and given back
with what the call took. An entry of the window stays from when the call was admitted until 60 seconds after it was sent,
so no 60 seconds at the provider hold more than the limit, however long a call waits on its way. A lease that nobody gives
back (its executor is lost) ends by itself after the longest time that a call may take.

With a gate, calls go in source order: a position is admitted when fewer than `concurrency` positions from the first one
that has no outcome lie before it. Tasks tell with each outcome whether it rejects the record; once more are rejected,
in order, than a policy allows, no further call is admitted, and the calls that wait end as `stopped`.

What the service keeps is bounded by the calls under way, the entries of 60 seconds and, with a gate, the outcomes that
came ahead of an earlier one. It is known to tasks by an address and a secret; neither is part of a plan or a report.
"""

from __future__ import annotations

import contextlib
import hmac
import json
import secrets
import socket
import socketserver
import threading
import time
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

WINDOW = 60.0
#: Seconds added to the window for what lies between a request that is written and one that the provider counts.
SLACK = 0.25
#: Seconds after which a call that waits for an earlier position goes when none is under way: the task that holds the
#: earlier one may be waiting for a place to run.
STALLED = 20.0
#: Seconds between two questions of a call that waits for a permit or its turn.
PAUSE = 0.02


@dataclass
class Gate:
    """The order of outcomes from position `first` on, and how many of them may be rejections."""

    first: int
    allowed: int | None
    rejected: int = 0
    ahead: dict[int, bool] = field(default_factory=dict)
    stopped_at: int | None = None

    def outcome(self, position: int, bad: bool) -> None:
        if position < self.first or position in self.ahead:
            return  # a task that ran again tells it once more
        self.ahead[position] = bad
        while self.first in self.ahead:
            self.rejected += self.ahead.pop(self.first)
            if self.allowed is not None and self.rejected > self.allowed and self.stopped_at is None:
                self.stopped_at = self.first
            self.first += 1


class Pool:
    """What calls of one provider share. `clock` may be a test's."""

    def __init__(self, concurrency: int, requests: int | None = None, tokens: int | None = None, lasts: float = 600.0, gate: Gate | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        if concurrency < 1 or requests == 0 or tokens == 0:
            raise ValueError("limits must be positive")
        self.concurrency, self.requests, self.tokens, self.lasts, self.gate, self.clock = concurrency, requests, tokens, lasts, gate, clock
        self.out: OrderedDict[str, list] = OrderedDict()  # lease: [admitted, tokens]
        self.past: deque[list] = deque()  # [sent, tokens], in the order they were given back
        self.lock = threading.Lock()
        self.moved = clock()

    def _expire(self, now: float) -> None:
        while self.out and next(iter(self.out.values()))[0] <= now - self.lasts:
            _, entry = self.out.popitem(last=False)
            self.past.append([now, entry[1]])  # it may have been sent at any time
        if any(t <= now - WINDOW - SLACK for t, _ in self.past):
            self.past = deque(e for e in self.past if e[0] > now - WINDOW - SLACK)

    def admit(self, tokens: int, position: int | None = None) -> dict:
        """{"lease"}, or {"wait"} in seconds, or {"never"} (larger than the limit), or {"stop"}."""
        with self.lock:
            now = self.clock()
            self._expire(now)
            gate = self.gate
            if gate is not None and gate.stopped_at is not None and (position is None or position > gate.stopped_at):
                return {"stop": gate.stopped_at}
            if self.tokens is not None and tokens > self.tokens:
                return {"never": self.tokens}
            if len(self.out) >= self.concurrency:
                return {"wait": PAUSE}
            if gate is not None and position is not None and position >= gate.first + self.concurrency and (self.out or now - self.moved < STALLED):
                return {"wait": PAUSE}
            busy = self.requests is not None and len(self.out) + len(self.past) >= self.requests
            dear = self.tokens is not None and sum(e[1] for e in self.out.values()) + sum(t for _, t in self.past) + tokens > self.tokens
            if busy or dear:
                return {"wait": max(PAUSE, min((t for t, _ in self.past), default=now + PAUSE - WINDOW - SLACK) + WINDOW + SLACK - now)}
            lease = secrets.token_hex(8)
            self.out[lease] = [now, tokens]
            self.moved = now
            return {"lease": lease}

    def back(self, lease: str, ago: float = 0.0, tokens: int | None = None) -> dict:
        """Gives a lease back; the call was sent `ago` seconds before, and took `tokens`."""
        with self.lock:
            now = self.clock()
            entry = self.out.pop(lease, None)
            if entry is not None and (self.requests is not None or self.tokens is not None):
                self.past.append([max(entry[0], now - max(0.0, ago)), entry[1] if tokens is None else tokens])
            self.moved = now
            return {}

    def outcomes(self, positions: list[int], bad: list[bool]) -> dict:
        with self.lock:
            if self.gate is not None:
                for p, b in zip(positions, bad, strict=True):
                    self.gate.outcome(p, b)
                self.moved = self.clock()
            return {}


@dataclass(frozen=True)
class Address:
    """How tasks reach the service and a pool of it."""

    host: str
    port: int
    secret: str = field(repr=False)
    name: str = ""

    def pool(self, name: str) -> Address:
        return Address(self.host, self.port, self.secret, name)


class Service:
    """Pools by name, behind a socket; `with` starts and ends it."""

    def __init__(self, host: str = "127.0.0.1", bind: str | None = None) -> None:
        self.pools: dict[str, Pool] = {}
        secret, pools = secrets.token_hex(16), self.pools

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                for line in self.rfile:
                    try:
                        told = json.loads(line)
                        good = hmac.compare_digest(str(told.pop("secret", "")), secret)
                        answer = getattr(pools[told.pop("pool")], told.pop("do"))(**told) if good and told.get("do") in ("admit", "back", "outcomes") else {"refused": True}
                    except (ValueError, TypeError, KeyError, AttributeError):
                        answer = {"refused": True}
                    self.wfile.write(json.dumps(answer).encode() + b"\n")

        class Server(socketserver.ThreadingTCPServer):
            allow_reuse_address, daemon_threads, request_queue_size = True, True, 256

        self.server = Server((bind or host, 0), Handler)
        self.address = Address(host, self.server.server_address[1], secret)

    def __enter__(self) -> Service:
        threading.Thread(target=self.server.serve_forever, kwargs={"poll_interval": 0.05}, daemon=True).start()
        return self

    def __exit__(self, *_: object) -> None:
        self.server.shutdown()
        self.server.server_close()

    def add(self, name: str, pool: Pool) -> Address:
        self.pools[name] = pool
        return self.address.pool(name)


@contextlib.contextmanager
def beside(spark: SparkSession) -> Iterator[Service]:
    """A service that executors of this session reach as they reach its driver."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local")
    host = "127.0.0.1" if local else conf.get("spark.driver.host", socket.gethostname())
    with Service(host, None if local else conf.get("spark.driver.bindAddress", host)) as service:
        yield service


class Leases:
    """A task's side: one connection for each of its threads."""

    def __init__(self, address: Address) -> None:
        self.address, self.own = address, threading.local()

    def ask(self, do: str, **told: object) -> dict:
        link = getattr(self.own, "link", None)
        if link is None:
            plug = socket.create_connection((self.address.host, self.address.port), timeout=60)
            link = self.own.link = (plug, plug.makefile("rb"))
        link[0].sendall(json.dumps({"secret": self.address.secret, "pool": self.address.name, "do": do, **told}).encode() + b"\n")
        answer = json.loads(link[1].readline() or b'{"refused": true}')
        if answer.get("refused"):
            raise ConnectionError("the lease service refused")
        return answer

    def admit(self, tokens: int, position: int | None = None) -> dict:
        return self.ask("admit", tokens=tokens, position=position)

    def back(self, lease: str, ago: float, tokens: int | None) -> None:
        self.ask("back", lease=lease, ago=ago, tokens=tokens)

    def outcomes(self, positions: list[int], bad: list[bool]) -> None:
        self.ask("outcomes", positions=positions, bad=bad)
