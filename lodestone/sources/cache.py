"""Cached values by key, with a time to live, in the driver's memory: lost on restart."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from .. import limits
from ..errors import fail
from ..functions import values as V

COMMANDS = ("cacheSet", "cacheGet", "cacheIncr")


@dataclass
class Cache:
    """key -> (value, when it expires or None). An entry whose time has come is gone, as expired rows are."""

    entries: dict[str, tuple[V.Value, dt.datetime | None]] = field(default_factory=dict)
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)

    def run(self, command: dict) -> dict:
        """{cacheSet: key, value, ttlSeconds?}, {cacheGet: key} or {cacheIncr: key, by?, ttlSeconds?}."""
        limits.check_tree(command)
        (name, key), *options = command.items()
        allowed = {"cacheSet": {"value", "ttlSeconds"}, "cacheGet": set(), "cacheIncr": {"by", "ttlSeconds"}}[name]
        for option, _ in options:
            if option not in allowed:
                fail("VAL_UNKNOWN_OPTION", option)
        if not isinstance(key, str) or not key:
            fail("VAL_INVALID_SHAPE", "a cache key is a string")
        now = self.clock()
        self._drop_expired(now)
        if name == "cacheGet":
            found = self.entries.get(key)
            return {"found": found is not None} | ({"value": found[0]} if found else {})
        expires = self._expiry(command.get("ttlSeconds"), now)
        if name == "cacheSet":
            if "value" not in command:
                fail("VAL_INVALID_SHAPE", "cacheSet takes a value")
            self.entries[key] = (V.literal(command["value"]), expires)
            return {"acknowledged": True}
        by = V.literal(command.get("by", 1))
        if by.type not in V.NUMERIC:
            fail("TYPE_MISMATCH", "cacheIncr adds a number")
        held = self.entries.get(key)
        # A counter keeps the time that it was made with.
        total, expires = (V.add(held[0], by), held[1]) if held else (by, expires)
        self.entries[key] = (total, expires)
        return {"acknowledged": True, "value": total}

    def _drop_expired(self, now: dt.datetime) -> None:
        for key in [k for k, (_, at) in self.entries.items() if at is not None and at <= now]:
            del self.entries[key]

    @staticmethod
    def _expiry(seconds: object, now: dt.datetime) -> dt.datetime | None:
        if seconds is None:
            return None
        if isinstance(seconds, bool) or not isinstance(seconds, (int, float)) or seconds <= 0:
            fail("VAL_INVALID_SHAPE", "ttlSeconds is a positive number")
        return now + dt.timedelta(seconds=seconds)
