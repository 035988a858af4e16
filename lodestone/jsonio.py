"""Strict JSON commands: UTF-8 without BOM, no repeated names, numbers kept exact, optional gzip."""

from __future__ import annotations

import gzip
import json
import zlib

from . import limits
from .errors import EngineError, fail


def _object(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        fail("VAL_DUPLICATE_FIELD", "a name occurs twice")
    return out


def _integer(token: str) -> int:
    n = int(token)
    if not -(2**63) <= n < 2**63:
        fail("VAL_INVALID_LITERAL", f"{token} is no 64-bit integer")
    return n


def _constant(token: str):
    fail("PAR_INVALID_JSON", f"{token} is no JSON")


def parse(raw: bytes | str, compression: str | None = None) -> object:
    """The command in raw; integers become int and other numbers float."""
    if isinstance(raw, str):
        raw = raw.encode()
    limits.check("command.raw_bytes", len(raw))
    if compression == "gzip":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error) as e:
            raise EngineError("PAR_COMPRESSION_FAILED", str(e)) from e
        limits.check("command.expanded_bytes", len(raw))
    elif compression:
        fail("CAP_UNSUPPORTED_FEATURE", f"compression {compression}")
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise EngineError("PAR_INVALID_UTF8", str(e)) from e
    if text.startswith("\ufeff"):
        fail("PAR_INVALID_JSON", "a byte order mark")
    try:
        out = json.loads(text, object_pairs_hook=_object, parse_int=_integer, parse_constant=_constant)
    except json.JSONDecodeError as e:
        raise EngineError("PAR_TRUNCATED_INPUT" if e.pos >= len(text.rstrip()) else "PAR_INVALID_JSON", str(e)) from e
    except RecursionError as e:
        raise EngineError("QUOTA_LIMIT_EXCEEDED", "ast.depth") from e
    limits.check_tree(out)
    return out
