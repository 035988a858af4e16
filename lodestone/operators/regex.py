"""A regular-language subset of patterns, checked before Java's engine sees them."""

from __future__ import annotations

import re

from .. import limits
from ..errors import fail

#: Escapes that stand for a class or a sign; others that are letters or digits are refused.
CLASSES = "dDwWsS"
SIGNS = "nrtfv0"


def _check(pattern: str) -> None:
    """No groups but plain and non-capturing ones, no backreferences, no lookaround, no possessive quantifiers."""
    k, depth, in_class, quantified = 0, 0, False, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            if k + 1 == len(pattern):
                fail("VAL_INVALID_LITERAL", "a trailing backslash")
            e = pattern[k + 1]
            if e.isalnum() and e not in CLASSES + SIGNS + "bBxu":
                fail("CAP_UNSUPPORTED_FEATURE", f"\\{e}")
            k, quantified = k + 2, False
            continue
        if in_class:
            if c == "[" or pattern.startswith("&&", k):
                fail("CAP_UNSUPPORTED_FEATURE", "nested classes")
            in_class = c != "]"
        elif c == "[":
            in_class = True
            k += pattern.startswith("^", k + 1)
            k += pattern.startswith("]", k + 1)
        elif c == "(":
            depth += 1
            if pattern.startswith("?", k + 1) and not pattern.startswith("?:", k + 1):
                fail("CAP_UNSUPPORTED_FEATURE", "only plain and non-capturing groups")
            k += 2 * pattern.startswith("?:", k + 1)
        elif c == ")":
            depth -= 1
        elif c == "+" and quantified:
            fail("CAP_UNSUPPORTED_FEATURE", "possessive quantifiers")
        quantified = not in_class and c in "*+?}"
        k += 1
        if depth < 0:
            break
    if depth or in_class:
        fail("VAL_INVALID_LITERAL", "unbalanced pattern")
    try:
        re.compile(pattern)
    except re.error as e:
        fail("VAL_INVALID_LITERAL", str(e))


def _java(pattern: str, multiline: bool) -> str:
    """$ outside multiline mode is the very end; Java's also stands before a final line break."""
    if multiline:
        return pattern
    out, k, in_class = [], 0, False
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out.append(pattern[k : k + 2])
            k += 2
            continue
        in_class = (in_class or c == "[") and c != "]"
        out.append(r"\z" if c == "$" and not in_class else c)
        k += 1
    return "".join(out)


def java_pattern(operand: object) -> str:
    """operand: a pattern, or {pattern, flags} with flags m and s. Unanchored, Unicode on."""
    if isinstance(operand, str):
        operand = {"pattern": operand}
    if not isinstance(operand, dict) or not isinstance(operand.get("pattern"), str) or set(operand) - {"pattern", "flags"}:
        fail("VAL_INVALID_SHAPE", "$regex takes a pattern or {pattern, flags}")
    pattern, flags = operand["pattern"], operand.get("flags", "")
    if not isinstance(flags, str) or set(flags) - set("ms") or len(set(flags)) != len(flags):
        fail("CAP_UNSUPPORTED_FEATURE", "flags are m and s")
    limits.check("regex.pattern_bytes", len(pattern.encode()))
    _check(pattern)
    return f"(?{''.join(sorted(flags))}u)" + _java(pattern, "m" in flags)
