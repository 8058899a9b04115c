"""A polite HTTP client on the driver: spacing, retries, raw files with hash and size."""

from __future__ import annotations

import hashlib
import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable

RETRIED = frozenset({429, 500, 502, 503, 504})
MOST_RETRIES, LONGEST_WAIT = 5, 60.0


def backoff(attempt: int, retry_after: str | None = None, jitter: Callable[[], float] = lambda: random.uniform(0, 0.5)) -> float:
    """Seconds to wait: what the server asks for, else doubling with a jitter; a minute at most."""
    try:
        if retry_after is not None:
            return min(LONGEST_WAIT, max(0.0, float(retry_after)))
    except ValueError:
        pass
    return min(LONGEST_WAIT, 2.0**attempt) + jitter()


class Throttle:
    """Keeps calls at least ``1 / rate`` seconds apart."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.last = 1 / rate, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (rest := self.last + self.gap - self.clock()) > 0:
            self.sleep(rest)
        self.last = self.clock()


class Client:
    """``send(url, headers)`` gives ``(status, headers, body)``; by default it is urllib's."""

    def __init__(self, user_agent: str, max_rps: float = 8.0, send: Callable | None = None, sleep: Callable[[float], None] = time.sleep):
        self.headers = {"User-Agent": user_agent}
        self.throttle, self.send, self.sleep = Throttle(max_rps, sleep=sleep), send or _send, sleep

    def get(self, url: str) -> bytes:
        for attempt in range(MOST_RETRIES + 1):
            self.throttle.wait()
            try:
                status, headers, body = self.send(url, self.headers)
            except OSError:
                if attempt == MOST_RETRIES:
                    raise
                status, headers, body = 503, {}, b""
            if status < 400:
                return body
            if status not in RETRIED or attempt == MOST_RETRIES:
                raise urllib.error.HTTPError(url, status, "request failed", headers, None)
            self.sleep(backoff(attempt, headers.get("Retry-After")))
        raise AssertionError

    def json(self, url: str) -> dict:
        return json.loads(self.get(url))

    def download(self, url: str, to: str, write: Callable[[str, bytes], None]) -> tuple[str, int]:
        """Has the bytes written as they are; gives their SHA-256 and size."""
        body = self.get(url)
        write(to, body)
        return hashlib.sha256(body).hexdigest(), len(body)


def _send(url: str, headers: dict) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def submissions_url(base: str, cik: str | int) -> str:
    return f"{base.rstrip('/')}/submissions/CIK{int(str(cik).strip()):010d}.json"
