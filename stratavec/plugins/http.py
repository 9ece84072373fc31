"""Requests to providers, with their retry rule."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from stratavec.errors import EngineError

#: (url, headers, JSON body) -> (status, JSON answer)
Transport = Callable[[str, dict, object], tuple[int, object]]
#: Seconds before the first retry of a 429, doubled each time, and the most.
FIRST_DELAY, MOST_DELAY = 1.0, 30.0


def urllib_transport(url: str, headers: dict, body: object, timeout: float = 30.0) -> tuple[int, object]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return answer.status, json.load(answer)
    except urllib.error.HTTPError as e:
        return e.code, {"message": e.read(500).decode(errors="replace")}


def send_with_retry(transport: Transport, url: str, headers: dict, body: object, retries: int, family: str, sleep: Callable[[float], None] = time.sleep):
    """The answer; 429 is tried again ``retries`` times, everything else isn't."""
    delay = FIRST_DELAY
    for attempt in range(retries + 1):
        try:
            status, answer = transport(url, headers, body)
        except TimeoutError as e:
            raise EngineError(f"{family}_TIMEOUT", str(e)) from e
        except OSError as e:
            raise EngineError(f"{family}_UPSTREAM", str(e)) from e
        if status == 429 and attempt < retries:
            sleep(delay)
            delay = min(2 * delay, MOST_DELAY)
            continue
        if status == 429:
            raise EngineError(f"{family}_RATE_LIMITED", f"rate limited after {retries} retries")
        if status >= 300:
            raise EngineError(f"{family}_UPSTREAM", f"status {status}", upstream=answer)
        return answer
    raise AssertionError
