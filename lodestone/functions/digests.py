"""BLAKE3 and CRC-32C of many messages at once, on arrays."""

from __future__ import annotations

import numpy as np

#: Fixed values of BLAKE3: the initial state, the order of message words after a round, flags, sizes.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
#: Fixed value: the reflected polynomial of CRC-32C.
CASTAGNOLI = 0x82F63B78


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x >> np.uint32(by) | x << np.uint32(32 - by)


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining values (8 x n) of n blocks: cv 8 x n, words 16 x n."""
    low, high = (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32)
    v = [*cv, *(np.broadcast_to(x, low.shape) for x in IV[:4]), low, high, size.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words)

    def mix(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        v[a] = v[a] + v[b] + x
        v[d] = _turned(v[d] ^ v[a], 16)
        v[c] = v[c] + v[d]
        v[b] = _turned(v[b] ^ v[c], 12)
        v[a] = v[a] + v[b] + y
        v[d] = _turned(v[d] ^ v[a], 8)
        v[c] = v[c] + v[d]
        v[b] = _turned(v[b] ^ v[c], 7)

    for turn in range(7):
        for k in range(4):  # columns, then diagonals
            mix(k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            mix(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
        if turn < 6:
            m = [m[p] for p in PERMUTATION]
    return np.stack([v[k] ^ v[8 + k] for k in range(8)])


def _chunks(parts: list[bytes], counter: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chaining values (8 x n) of chunks of at most CHUNK bytes; those that are a message by themselves end as roots."""
    size = np.array([len(p) for p in parts], np.int64)
    blocks = np.maximum(1, -(-size // BLOCK))
    most = int(blocks.max())
    data = np.frombuffer(b"".join(p.ljust(most * BLOCK, b"\0") for p in parts), "<u4").reshape(len(parts), -1, 16)
    cv = np.repeat(IV[:, None], len(parts), axis=1)
    for b in range(most):
        at = np.flatnonzero(blocks > b)
        last = blocks[at] == b + 1
        flags = (CHUNK_START if b == 0 else 0) + last * CHUNK_END + (last & alone[at]) * ROOT
        cv[:, at] = _compress(cv[:, at], data[at, b].T, counter[at], np.where(last, size[at] - b * BLOCK, BLOCK), flags)
    return cv


def _root(cvs: list[np.ndarray], top: bool = True) -> np.ndarray:
    """The value of a tree over chunks' chaining values: the left part is the largest power of two that leaves something right."""
    if len(cvs) == 1:
        return cvs[0]
    left = 1 << ((len(cvs) - 1).bit_length() - 1)
    words = np.concatenate([_root(cvs[:left], False), _root(cvs[left:], False)])[:, None]
    zero = np.zeros(1, np.uint64)
    return _compress(IV[:, None], words, zero, np.full(1, BLOCK), np.full(1, PARENT + (ROOT if top else 0)))[:, 0]


def blake3(messages: list[bytes]) -> list[bytes]:
    """The 32-byte default hash of each message."""
    if not messages:
        return []
    parts, counter, owner = [], [], []
    for k, m in enumerate(messages):
        for c in range(max(1, -(-len(m) // CHUNK))):
            parts.append(m[c * CHUNK : (c + 1) * CHUNK])
            counter.append(c)
            owner.append(k)
    owner = np.array(owner)
    number = np.bincount(owner)
    cv = _chunks(parts, np.array(counter, np.uint64), number[owner] == 1)
    first = np.cumsum(number) - number
    return [(cv[:, f] if n == 1 else _root([cv[:, f + j] for j in range(n)])).astype("<u4").tobytes() for f, n in zip(first.tolist(), number.tolist(), strict=True)]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(CASTAGNOLI), table >> np.uint32(1))
    return table


_TABLE = _crc_table()


def crc32c(messages: list[bytes]) -> list[int]:
    """The CRC-32C of each message; all go on together, byte by byte."""
    if not messages:
        return []
    size = np.array([len(m) for m in messages], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.zeros((int(size.max()), len(messages)), np.uint8)
    for column, k in enumerate(order.tolist()):
        data[: size[k], column] = np.frombuffer(messages[k], np.uint8)
    crc = np.full(len(messages), 0xFFFFFFFF, np.uint32)
    active = np.searchsorted(-size[order], -np.arange(len(data)), side="left")
    for byte, n in zip(data, active.tolist(), strict=True):
        crc[:n] = crc[:n] >> np.uint32(8) ^ _TABLE[(crc[:n] ^ byte[:n]) & np.uint32(0xFF)]
    out = np.empty(len(messages), np.uint32)
    out[order] = ~crc
    return out.tolist()
