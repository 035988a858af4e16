"""Structured errors: a stable code, its category, and whether a retry can help."""

from __future__ import annotations

#: The error codes by category.
CODES = {
    "parse": ("PAR_MALFORMED_ENVELOPE", "PAR_TRUNCATED_INPUT", "PAR_INVALID_JSON", "PAR_INVALID_CBOR", "PAR_INVALID_UTF8", "PAR_INVALID_TYPED_VALUE", "PAR_COMPRESSION_FAILED"),
    "validation": (
        "VAL_UNKNOWN_COMMAND", "VAL_UNKNOWN_OPTION", "VAL_UNKNOWN_OPERATOR", "VAL_INVALID_SHAPE", "VAL_INVALID_LITERAL", "VAL_INVALID_FIELD_NAME", "VAL_INVALID_PATH", "VAL_PROTECTED_FIELD",
        "VAL_DUPLICATE_FIELD", "VAL_CONFLICTING_PATHS", "VAL_SCHEMA_MISMATCH", "VAL_RESOURCE_NOT_FOUND", "VAL_UNSUPPORTED_COMBINATION",
    ),
    "type": ("TYPE_MISMATCH", "TYPE_COERCION_LOSS", "TYPE_NUMERIC_OVERFLOW", "TYPE_NUMERIC_UNDERFLOW", "TYPE_INVALID_SPECIAL", "TYPE_TEMPORAL_RANGE", "TYPE_VECTOR_DIMENSION", "TYPE_VECTOR_ZERO_NORM", "TYPE_EXPRESSION_MISSING"),
    "conflict": ("CON_WRITE_CONFLICT", "CON_IDEMPOTENCY_MISMATCH", "CON_TRANSACTION_STATE", "CON_SNAPSHOT_EXPIRED", "CON_CURSOR_STATE", "CON_STALE_EPOCH", "CON_RETRY_EXHAUSTED"),
    "uniqueness": ("UNQ_PRIMARY_DUPLICATE", "UNQ_SECONDARY_DUPLICATE", "UNQ_GENERATED_ID_EXHAUSTED"),
    "authorization": ("AUTH_UNAUTHENTICATED", "AUTH_CREDENTIAL_EXPIRED", "AUTH_FORBIDDEN", "AUTH_SCOPE_DENIED", "AUTH_POLICY_DENIED"),
    "capability": ("CAP_UNSUPPORTED_FEATURE", "CAP_UNSUPPORTED_VERSION", "CAP_HOST_UNAVAILABLE", "CAP_STORAGE_UNAVAILABLE", "CAP_GPU_UNAVAILABLE", "CAP_GPU_DEVICE_LOST", "CAP_CLOCK_UNSAFE", "CAP_FORMAT_UNSUPPORTED"),
    "quota": ("QUOTA_LIMIT_EXCEEDED", "QUOTA_RATE_LIMITED", "QUOTA_MEMORY", "QUOTA_STORAGE", "QUOTA_CONCURRENCY", "QUOTA_GPU", "QUOTA_RESULT"),
    "deadline": ("DEADLINE_EXCEEDED", "DEADLINE_CANCELLED", "DEADLINE_CURSOR_EXPIRED"),
    "durability": ("DUR_IO", "DUR_SYNC", "DUR_NO_SPACE", "DUR_CORRUPTION", "DUR_RECOVERY_REQUIRED", "DUR_ACK_UNKNOWN", "DUR_BACKUP_INVALID", "DUR_RESTORE_INVALID"),
    "internal": ("INT_INVARIANT", "INT_PANIC", "INT_SERIALIZATION", "INT_UNEXPECTED"),
}
CATEGORY = {code: category for category, codes in CODES.items() for code in codes}
#: The phase in which an error arises, by category, and where a code differs.
PHASES = {
    "parse": "decode", "validation": "validate", "type": "execute", "conflict": "execute", "uniqueness": "execute", "authorization": "authorize",
    "capability": "admit", "quota": "admit", "deadline": "execute", "durability": "commit", "internal": "internal",
}
OTHER_PHASES = {
    "CON_SNAPSHOT_EXPIRED": "snapshot", "CON_CURSOR_STATE": "cursor", "DEADLINE_CURSOR_EXPIRED": "cursor", "DUR_RECOVERY_REQUIRED": "recover",
    "DUR_ACK_UNKNOWN": "acknowledge", "DUR_BACKUP_INVALID": "backup", "DUR_RESTORE_INVALID": "restore",
}
#: What a retry has to wait for or bring; other errors come again.
RETRIES = {
    "new_snapshot": ("CON_WRITE_CONFLICT", "CON_SNAPSHOT_EXPIRED", "CON_STALE_EPOCH"),
    "same_idempotency_key": ("DUR_ACK_UNKNOWN",),
    "after_capability_change": ("CAP_HOST_UNAVAILABLE", "CAP_STORAGE_UNAVAILABLE", "CAP_GPU_UNAVAILABLE", "CAP_GPU_DEVICE_LOST"),
    "after_delay": ("QUOTA_RATE_LIMITED", "QUOTA_MEMORY", "QUOTA_CONCURRENCY", "QUOTA_GPU"),
    "after_operator_action": ("CAP_CLOCK_UNSAFE", "QUOTA_STORAGE", "DUR_IO", "DUR_SYNC", "DUR_NO_SPACE", "DUR_RECOVERY_REQUIRED", "DUR_BACKUP_INVALID", "DUR_RESTORE_INVALID"),
}


class EngineError(Exception):
    """An error with a stable code."""

    def __init__(self, code: str, message: str = "", **details: object):
        self.code, self.details = code, details
        self.category = CATEGORY.get(code, "internal")
        self.phase = OTHER_PHASES.get(code, PHASES[self.category])
        self.retry = next((scope for scope, codes in RETRIES.items() if code in codes), "never")
        self.outcome = "unknown" if code == "DUR_ACK_UNKNOWN" else "not_applicable"
        super().__init__(f"{code}: {message}" if message else code)


def fail(code: str, message: str = "", **details: object):
    raise EngineError(code, message, **details)


def from_spark(e: Exception) -> Exception:
    """A data-dependent failure as an engine error: a code that an expression raised, or ANSI overflow; else e itself."""
    text = str(e)
    for code in CATEGORY:
        if code in text:
            return EngineError(code, "raised by a row")
    return EngineError("TYPE_NUMERIC_OVERFLOW", "raised by a row") if "ARITHMETIC_OVERFLOW" in text else e
