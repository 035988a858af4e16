"""Exact byte-level BPE by dynamic programming over prefixes.

The unique BPE encoding of a piece ends, at every prefix, in one token: the one
whose predecessor is the last token of the shorter prefix and that stays
apart from it. Tokens that end at a place come from a suffix automaton of the
vocabulary; the pair test undoes the merges of both tokens from the latest to
the first and looks for one across the border that would have come earlier.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Unicode's White_Space property, as ranges.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]

LETTER, NUMBER, OTHER, SPACE, BORDER = 0, 1, 2, 3, 4
#: Lone surrogates can't occur in a text; they stand for the end of a document and, from SPECIAL on, for the special tokens.
END, SPECIAL, MOST_SPECIAL = "\ud800", 0xD801, 2000
#: Characters that are encoded at a time, and whose pieces are found at a time. A call has a fixed cost for its new words, so
#: larger ones are quicker, and smaller ones leave more memory to what else a worker has held.
CHUNK, PART = 1 << 23, 1 << 19
MOST_WORDS = 400_000
MOST_PAIRS = 1_000_000
PAIR_BITS = 20
LONG = 160


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def _special_tokens(added: list[dict]) -> dict[str, int]:
    """content -> id. Tokens that take spaces with them, stand for whole words only or overlap with each other are refused, as they would need more than replacement."""
    out = {x["content"]: x["id"] for x in added}
    if len(out) > MOST_SPECIAL or any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("special tokens with options, or too many of them")
    for a in out:
        for b in out:
            if a != b and (a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b))))):
                raise ValueError(f"special tokens {a!r} and {b!r} overlap")
    return out


def special_sign(k: int) -> str:
    """What stands for the k-th special token in a text."""
    return chr(SPECIAL + k)


class Lookup:
    """Many integer keys looked up at once, by open addressing; -1 for absent ones."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            _, first = np.unique(slot[left], return_index=True)
            first = left[first]
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = self.values[slot]
        off = np.flatnonzero((found != keys) & (found >= 0))
        out[found < 0] = -1
        while len(off):
            slot[off] = (slot[off] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[off]]
            out[off] = np.where(found == keys[off], self.values[slot[off]], -1)
            off = off[(found != keys[off]) & (found >= 0)]
        return out


class Vocabulary:
    """What workers need, as arrays whose size depends on the vocabulary file alone."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = _byte_chars(), spec["model"]["vocab"]
        raw = {t: bytes(chars[c] for c in t) for t in vocab if all(c in chars for c in t)}
        special = _special_tokens(spec["added_tokens"])
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        made = {a + b for a, b in merges}
        base = sorted((t for t in raw if t not in made and t not in special), key=vocab.get)
        order = {t: k for k, t in enumerate(base)}
        split = [(-1, -1)] * len(base)
        for a, b in merges:
            if a + b not in order:
                order[a + b] = len(split)
                split.append((order[a], order[b]))
        pairs = {}
        for a, b in merges:
            pairs.setdefault((order[a], order[b]), order[a + b])
        tokens = sorted(order, key=order.get)
        self.token_bytes = [raw[t] for t in tokens]
        self.ids = np.array([vocab[t] for t in tokens], np.int64)
        self.left, self.right = [a for a, _ in split], [b for _, b in split]
        self.pair = {a << 20 | b: c for (a, b), c in pairs.items()}
        self.special = special
        self._automaton()

    def apart(self, a: int, b: int) -> bool:
        """Whether the encoding of a's bytes followed by b's is [a, b]."""
        return self._apart(a, b, 1 << 40)

    def _apart(self, a: int, b: int, latest: int) -> bool:
        """Whether no merge older than latest joins a and b while they are built."""
        left, right, pair = self.left, self.right, self.pair
        while pair.get(a << 20 | b, latest) >= latest:
            if a > b:  # undo the later merge; of two alike, the right one is later
                latest, a = a, right[a]
                if a < 0:
                    return True
            else:
                latest, b = b + 1, left[b]
                if b < 0:
                    return True
        return False

    def _whole(self) -> list[bool]:
        """Whether each token's own bytes encode to it: its halves do, and meet only in its own merge."""
        out: list[bool] = []
        for t, (a, b) in enumerate(zip(self.left, self.right, strict=True)):
            out.append(a < 0 or (out[a] and out[b] and self._apart(a, b, t)))
        return out

    def _automaton(self) -> None:
        """A suffix automaton of all tokens; a token is always the longest string of its state."""
        step: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def clone(p: int, q: int, c: int) -> int:
            r = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = r
                p = link[p]
            link[q] = r
            return r

        token_at: dict[int, int] = {}
        ends = []
        for t in self.token_bytes:
            last = 0
            for c in t:
                q = step[last].get(c)
                if q is not None:
                    last = q if length[q] == length[last] + 1 else clone(last, q, c)
                    continue
                new = len(step)
                step.append({})
                link.append(0)
                length.append(length[last] + 1)
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    link[new] = q if length[q] == length[p] + 1 else clone(p, q, c)
                last = new
            ends.append(last)
        for k, t in enumerate(self.token_bytes):  # clones come later, so tokens are placed at the end
            s = 0
            for c in t:
                s = step[s][c]
            token_at[s] = k
        n = len(step)
        whole = self._whole()
        chain: list[tuple] = [()] * n  # the tokens that are suffixes of a state, longest first
        for s in sorted(range(1, n), key=length.__getitem__):
            t = token_at.get(s, -1)
            chain[s] = ((t, length[s]), *chain[link[s]]) if t >= 0 and whole[t] else chain[link[s]]
        self.link, self.length, self.chain = link, length, chain
        self.step = {s << 8 | c: q for s, x in enumerate(step) for c, q in x.items()}


class Encoder:
    """Encodes pieces; made once in each worker."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.step, self.chain, self.link, self.length = v.step, v.chain, v.link, v.length
        self.ids = v.ids.tolist()
        self.size = [len(t) for t in v.token_bytes]
        self.known_apart: dict[int, bool] = {}
        ints = lambda x: np.array(x, np.int32)
        self.left, self.right, self.size_of = ints(v.left), ints(v.right), ints(self.size)
        self.link_of, self.length_of = ints(v.link), ints(v.length)
        self.token_of = ints([x[0][0] if x and x[0][1] == n else -1 for x, n in zip(v.chain, v.length, strict=True)])
        self.above = np.full(len(v.link), -1, np.int32)
        for s in sorted(range(1, len(v.link)), key=v.length.__getitem__):
            p = v.link[s]
            self.above[s] = p if self.token_of[p] >= 0 else self.above[p]
        self.step_lookup = Lookup(np.fromiter(v.step, np.int64, len(v.step)), np.fromiter(v.step.values(), np.int32, len(v.step)))
        self.pair_lookup = Lookup(np.fromiter(v.pair, np.int64, len(v.pair)), np.fromiter(v.pair.values(), np.int32, len(v.pair)))
        self.kept = np.full(1 << PAIR_BITS, -2, np.int64)
        most = max([*self.ids, *v.special.values()]) + 1
        self.bytes_of, self.decimal = [b""] * most, [str(i) for i in range(most)]
        for i, t in zip(self.ids, v.token_bytes, strict=True):
            self.bytes_of[i] = t
        for t, i in v.special.items():
            self.bytes_of[i] = t.encode()
        self.classes = classes()
        self.words: dict[bytes, bytes] = {}

    def apart_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Vocabulary.apart for many pairs; answers are kept in a table with one place for each slot."""
        key = a.astype(np.int64) << 20 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        kept = self.kept[slot]
        out = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != key)
        if len(new):
            x, y, latest = a[new].astype(np.int64), b[new].astype(np.int64), np.full(len(new), 1 << 40, np.int64)
            at, answer = np.arange(len(new)), np.zeros(len(new), bool)
            while len(at):
                met = self.pair_lookup(x << 20 | y)
                go = (met < 0) | (met >= latest)
                at, x, y = at[go], x[go], y[go]
                later = x > y
                latest = np.where(later, x, y + 1)
                x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
                through = (x < 0) | (y < 0)
                answer[at[through]] = True
                at, x, y, latest = at[~through], x[~through], y[~through], latest[~through]
            out[new] = answer
            self.kept[slot[new]] = key[new] << 1 | answer
        return out

    def many(self, words: list[bytes]) -> list[bytes]:
        """The ids of many pieces of like lengths, four bytes each; the steps of piece() for all at once."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = (np.cumsum(size) - size)[order]
        size, most = size[order], int(size.max())
        # A word's row goes on into the next word; what lies behind its end is never looked at.
        data = raw.take(start[None, :] + np.arange(most)[:, None], mode="clip").astype(np.int64)
        last = np.full((most + 1, len(words)), -1, np.int32)
        state, matched = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        active = np.searchsorted(-size, -np.arange(most), side="left")  # pieces longer than k come first
        for end, n in enumerate(active.tolist(), 1):
            c, s, m = data[end - 1, :n], state[:n], matched[:n]
            to = self.step_lookup(s << 8 | c)
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                s[stuck] = self.link_of[s[stuck]]
                if (s[stuck] < 0).any():
                    raise ValueError("the vocabulary lacks a byte")
                m[stuck] = self.length_of[s[stuck]]
                to[stuck] = self.step_lookup(s[stuck] << 8 | c[stuck])
                stuck = stuck[to[stuck] < 0]
            s[:] = to
            m += 1
            own = (self.token_of[s] >= 0) & (self.length_of[s] == m)
            at, u = np.arange(n), np.where(own, s, self.above[s])
            while len(at):
                t, start = self.token_of[u], end - self.length_of[u]
                before = last[start, at]
                fits = start == 0
                ask = np.flatnonzero(~fits & (before >= 0))
                fits[ask] = self.apart_many(before[ask], t[ask])
                last[end, at[fits]] = t[fits]
                at, u = at[~fits], self.above[u[~fits]]
                at, u = at[u >= 0], u[u >= 0]
        place, at, found = size.copy(), np.arange(len(words)), []
        while len(at):
            t = last[place[at], at]
            found.append((at, t))
            place[at] -= self.size_of[t]
            at = at[place[at] > 0]
        owner = np.concatenate([x for x, _ in found][::-1])
        ids = self.v.ids[np.concatenate([t for _, t in found][::-1])].astype(np.uint32)
        ids = ids[np.argsort(owner, kind="stable")].tobytes()
        stops = (np.cumsum(np.bincount(owner, minlength=len(words))) * 4).tolist()
        out: list[bytes] = [b""] * len(words)
        for k, begin, stop in zip(order.tolist(), [0, *stops[:-1]], stops, strict=True):
            out[k] = ids[begin:stop]
        return out

    def piece(self, data: bytes) -> bytes:
        """The ids of one piece, four bytes each."""
        step, chain, known = self.step, self.chain, self.known_apart
        last = [-1] * (len(data) + 1)
        s = end = matched = 0
        for c in data:
            end += 1
            to = step.get(s << 8 | c)
            while to is None:
                s = self.link[s]
                if s < 0:
                    raise ValueError(f"the vocabulary has no token for byte {c}")
                matched = self.length[s]
                to = step.get(s << 8 | c)
            s = to
            matched += 1
            for t, size in chain[s]:
                if size > matched:
                    continue
                if size == end:
                    last[end] = t
                    break
                before = last[end - size]
                if before >= 0:
                    key = before << 20 | t
                    fits = known.get(key)
                    if fits is None:
                        fits = known[key] = self.v.apart(before, t)
                    if fits:
                        last[end] = t
                        break
        out, ids, size = [], self.ids, self.size
        while end:
            t = last[end]
            out.append(ids[t])
            end -= size[t]
        if len(known) > MOST_PAIRS:
            known.clear()
        out.reverse()
        return pack(f"{len(out)}I", *out)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty."""
        for ids, stops in self.encode_flat(texts, chunk=CHUNK // 4):
            begin = 0
            for stop in stops.tolist():
                yield ids[begin:stop]
                begin = stop

    def encode_flat(self, texts: list[str | None], end: int | None = None, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts in a row, where each text's ids stop) for all texts in order; with `end`, that id follows each text."""
        part: list[str] = []
        size = 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= chunk:
                yield self._encode(part, end)
                part, size = [], 0
        if part:
            yield self._encode(part, end)

    def _encode(self, texts: list[str], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        datas, offsets, at = [], [], 0
        k = 0
        while k < len(texts):  # pieces are found a part at a time, so that its arrays stay in the cache
            size, begin = 0, k
            while k < len(texts) and size < PART:
                size += len(texts[k])
                k += 1
            joined = END.join(texts[begin:k]) + END
            for j, name in enumerate(self.v.special):
                joined = joined.replace(name, special_sign(j))
            data = joined.encode("utf-8", "surrogatepass")
            offsets.append(pieces(joined, data, self.classes).astype(np.int32) + np.int32(at))
            datas.append(data)
            at += len(data)
        starts = np.concatenate([*offsets, np.array([at], np.int32)])
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(b"".join(datas))]).dictionary_encode()
        known = self.words
        if len(known) > MOST_WORDS:
            known.clear()
        border = END.encode("utf-8", "surrogatepass")
        known[border] = b"" if end is None else pack("I", end)
        for j, i in enumerate(self.v.special.values()):
            known[special_sign(j).encode("utf-8", "surrogatepass")] = pack("I", i)
        distinct = coded.dictionary.to_pylist()
        got = list(map(known.get, distinct))
        new = np.array([k for k, x in enumerate(got) if x is None], np.int64)
        size = pc.binary_length(coded.dictionary).to_numpy()
        new = new[np.argsort(size[new], kind="stable")]
        size = size[new]
        while len(new):
            if size[0] + 16 > LONG:  # these hardly come again
                for k in new.tolist():
                    got[k] = self.piece(distinct[k])
                break
            upto = int(np.searchsorted(size, size[0] + 16, side="right"))
            part = new[:upto].tolist()
            words = [distinct[k] for k in part]
            found = self.many(words)
            known.update(zip(words, found, strict=True))
            for k, ids in zip(part, found, strict=True):
                got[k] = ids
            new, size = new[upto:], size[upto:]
        index = coded.indices.to_numpy()
        count = np.fromiter(map(len, got), np.int32, len(got)) >> 2
        flat = np.frombuffer(b"".join(got), np.uint32)
        first = np.cumsum(count) - count
        n = count.take(index)
        ends = np.cumsum(n)
        place = np.repeat(first.take(index) - (ends - n), n)
        place += np.arange(ends[-1])
        return flat.take(place), ends[index == distinct.index(border)]

    def forget(self) -> None:
        """Give back what was kept of texts; a worker goes on with other work after its task."""
        self.words.clear()
        self.known_apart.clear()
        pa.default_memory_pool().release_unused()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for a, b in WHITE_SPACE:
        out[a : b + 1] = SPACE
    out[ord(END) : SPECIAL + MOST_SPECIAL] = BORDER
    return out


def pieces(text: str, data: bytes, table: np.ndarray) -> np.ndarray:
    """Where pieces start, in bytes of UTF-8 (data).

    A piece is a contraction ('s 't 're 've 'm 'll 'd), or a run of letters, of
    numbers or of other signs with one space before it if there is one, or
    white space: a run that something follows keeps its last character apart.
    BORDER characters stand alone and count as the end of the text.
    """
    wide = text.encode("utf-16-le", "surrogatepass")
    cp = np.frombuffer(wide, np.uint16) if len(wide) == 2 * len(text) else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = table.take(cp)
    new = np.empty(len(cp), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= kind == BORDER
    runs = np.flatnonzero(new)
    kinds = kind.take(runs)
    after = np.append(kinds[1:], np.uint8(BORDER))
    ends = np.append(runs[1:], len(cp))
    tail = ends.compress((kinds == SPACE) & (after != BORDER)) - 1
    new[tail] = True
    new[tail.compress(cp.take(tail) == 0x20) + 1] = False
    quote = runs.compress((kinds == OTHER) & (after == LETTER) & (ends - runs == 1))
    quote = quote[(cp[quote] == 0x27) & new[quote]]
    if len(quote):
        padded = np.append(cp, np.zeros(2, cp.dtype))
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & ((((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for q, k in ((quote[short], 2), (quote[long], 3)):
            new[q + 1] = False
            stop = q + k
            new[stop[stop < len(cp)]] = True
    starts = np.flatnonzero(new)
    if len(data) == len(cp):
        return starts
    first_bytes = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return first_bytes.take(starts)


_made: list[tuple[object, Encoder]] = []


def encoder(v: Vocabulary) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; made once."""
    if not _made or _made[0][0] is not v:
        _made[:] = [(v, Encoder(v))]
    return _made[0][1]


def share(spark: SparkSession, path: str):
    """The vocabulary as a broadcast; its size depends on the vocabulary file alone."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text and decode the ids again.

    path: a byte-level BPE file of the tokenizers library. Returns doc_id,
    n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded text in UTF-8), a row for each row of docs.
    A null text counts as empty and has no tokens; a null doc_id stays null;
    repeated rows stay; texts may be of any length; other columns are not read.
    Special tokens that stand in a text become their ids, as the library does it.
    """
    shared = share(docs.sparkSession, path)

    def run(batches):
        enc = encoder(shared.value)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in enc.encode(batch.column(1).to_pylist()):
                ids = ids.tolist()
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(enc.decimal.__getitem__, ids)).encode()))
                text_sha.append(sha(enc.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.forget()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str) -> DataFrame:
    """docs with a column ids (array<int>); null texts have an empty one. A column ids of docs is replaced."""
    shared = share(docs.sparkSession, path)
    docs = docs.drop("ids")
    where = docs.columns.index("text")

    def run(batches):
        enc = encoder(shared.value)
        for batch in batches:
            each = list(enc.encode(batch.column(where).to_pylist()))
            stops = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint32), *each]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
