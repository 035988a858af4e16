"""What a command takes from outside, in one place: time and randomness, so that a run can be repeated."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Inputs:
    """clock gives the time; with a seed, random bytes follow from it, the purpose and the number of the request.

    taken lists (ordinal, purpose) of every request in order.
    """

    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)
    seed: bytes | None = None
    taken: list[tuple[int, str]] = field(default_factory=list)

    def _ordinal(self, purpose: str) -> int:
        self.taken.append((len(self.taken), purpose))
        return len(self.taken) - 1

    def now(self, purpose: str) -> dt.datetime:
        self._ordinal(purpose)
        return self.clock()

    def random(self, size: int, purpose: str) -> bytes:
        at = self._ordinal(purpose)
        if self.seed is None:
            return os.urandom(size)
        return hashlib.shake_256(self.seed + at.to_bytes(8, "big") + purpose.encode()).digest(size)

    def uuid7(self, purpose: str = "document id") -> str:
        """A time-ordered UUID."""
        ms = int(self.now(purpose).timestamp() * 1000)
        raw = bytearray(ms.to_bytes(6, "big") + self.random(10, purpose))
        raw[6], raw[8] = 0x70 | raw[6] & 0x0F, 0x80 | raw[8] & 0x3F
        return str(uuid.UUID(bytes=bytes(raw)))
