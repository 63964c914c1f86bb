"""Clients of language models for use within a partition: error classes, pacing, retries and failover. Time and sleep are parameters."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable

from auditloom.operators.findings import parse_reply


class ProviderError(Exception):
    """A call failed."""


class RateLimited(ProviderError):
    """Too many calls or tokens; `after` is the delay that the server asks for, if any."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


class TooLarge(ProviderError):
    """The request can't fit, whoever answers it."""


def classified(message: str, status: int | None = None) -> ProviderError:
    """The kind of error that a message and a status tell of."""
    low = message.lower()
    if status == 413 or "too large" in low or "context length" in low:
        return TooLarge(message)
    if status == 429 or "rate limit" in low or "rate_limit" in low:
        found = re.search(r"(?:try again|retry) (?:in|after) ([\d.]+)\s*s", low)
        return RateLimited(message, float(found[1]) if found else None)
    return ProviderError(message)


class Pacer:
    """Keeps the tokens of any `window` seconds under a limit. Partitions that run at once must divide the limit."""

    def __init__(self, per_window: int = 8000, window: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.limit, self.window, self.clock, self.sleep = per_window, window, clock, sleep
        self.spent: deque[tuple[float, int]] = deque()

    def wait(self, tokens: int) -> None:
        while True:
            now = self.clock()
            while self.spent and self.spent[0][0] <= now - self.window:
                self.spent.popleft()
            if not self.spent or sum(n for _, n in self.spent) + tokens <= self.limit:
                self.spent.append((now, tokens))
                return
            self.sleep(max(0.01, self.spent[0][0] + self.window - now))


def retried(call: Callable[[str], str], prompt: str, attempts: int = 4, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The answer to a prompt; rate limits are waited for, as long as the server says or twice as long each time."""
    for n in range(attempts):
        try:
            return call(prompt)
        except RateLimited as e:
            if n == attempts - 1:
                raise
            sleep(e.after if e.after is not None else base * 2**n)
    raise ProviderError("no attempt was allowed")


class Failover:
    """Asks providers in order. One that is rate-limited is benched for a while; a request too large for one goes to no other. If all are benched, the one that is free soonest is asked."""

    def __init__(self, providers: dict[str, Callable[[str], str]], cooldown: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.providers, self.cooldown, self.clock = providers, cooldown, clock
        self.free_at = dict.fromkeys(providers, 0.0)
        self.served = dict.fromkeys(providers, 0)

    def __call__(self, prompt: str) -> str:
        now = self.clock()
        ready = [n for n in self.providers if self.free_at[n] <= now] or [min(self.providers, key=lambda n: self.free_at[n])]
        last: Exception | None = None
        for name in ready:
            try:
                reply = self.providers[name](prompt)
            except TooLarge:
                raise
            except RateLimited as e:
                self.free_at[name], last = now + (e.after or self.cooldown), e
            except ProviderError as e:
                last = e
            else:
                self.served[name] += 1
                return reply
        raise last or ProviderError("no provider")


def answered(call: Callable[[str], str], prompt: str) -> str:
    """The JSON object of a reply, or an error."""
    payload, _, error = parse_reply(call(prompt))
    if error:
        raise ProviderError(error)
    return payload
