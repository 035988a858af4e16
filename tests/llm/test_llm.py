"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lodestone.llm import bpe, components, embeds, entries, licenses, lines, mixing, quality, simhash, substrings, tokens, urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    line = "This line stands in Many documents, again and again."
    passage = prose(rng, 80, 5000)
    texts = [None, "", " \n\t ", "One", "a b c d e f g h " * 40, prose(rng, 30_000, 90_000) + ".", "Émile ÉTAIT là. Il n'y avait rien,\nrien du tout.\n"]
    base = prose(rng, 300, 50_000)
    texts += [base] * 3 + [base.replace(" w1", " W1", 1), base + " tail"]
    texts += [f"{prose(rng, 25)}.\n  {line.upper() if k % 2 else line}\t\n{prose(rng, 12)}.\n{line}" for k in range(7)]
    texts += [prose(rng, 60, 5000) + " " + passage + " " + prose(rng, 60, 5000) for _ in range(4)]
    texts += ["Home | About | Contact\n" * 6 + prose(rng, 10) + ".", "buy### now*** $$$cheap&&& " * 12, "Licensed under the Apache License, Version 2.0. MIT licence? mit\nLICENSE", "CC-BY 4.0 and cc by"]
    texts += [prose(rng, rng.randrange(20, 200)) + ".\n" + prose(rng, 30) + "." for _ in range(60)]
    sources = [None, "a", "b", "c", "d"]
    out = [(k, t, "en", sources[min(4, k % 9)], len(t or "")) for k, t in enumerate(texts)]
    return [*out, (None, "A row without an id, but with words of its own.", None, None, None), out[9]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def base_counts(text):
    ws = words(text)
    windows = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7))
    covered = {k + j for k in range(len(ws) - 7) if windows[tuple(ws[k : k + 8])] > 1 for j in range(8)}
    full = [x for x in (text or "").split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered)


def test_quality(docs, rows, nothing):
    out = quality.judge(docs.withColumnRenamed("lang", "kept")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    by_text = {r.text: r for r in out}
    assert not by_text[None].kept and by_text[None].cleaned_text is None
    assert all(not r.kept for r in out if r.text and (r.text.startswith("Home |") or r.text.startswith("buy###")))
    clean = [r for r in out if r.text and r.text.endswith(".") and r.n_words > 50 and not r.text.startswith("Home")]
    assert sum(r.kept for r in clean) > 50 and all((r.kept or r.base_failed) and r.n_failed_lines == 0 for r in clean)
    assert quality.judge(nothing).count() == 0
    assert quality.cleaned(docs).columns == docs.columns


def test_line_rules(spark):
    given = [("Prose that ends well.", False), ("Prose without an end", True), ("Home | About | Contact.", True), ("Please read our privacy policy.", True), ("Read more.", True), ("a# b# c.", True), ("WHAT!! IS!! THIS!!", True), ("He said: “yes.”", False), ("Weiterlesen", True), ("Zur vorherigen und zur NÄCHSTE SEITE.", True), ("Toda la PÁGINA SIGUIENTE.", True), ("Tous droits RÉSERVÉS par la maison.", True), ("Lies unsere Datenschutzerklärung.", True), ("Wir lesen auf der nächsten Seite weiter.", False)]
    df = spark.createDataFrame(given, "line string, fails boolean")
    from pyspark.sql import functions as F

    assert df.select("line").where(quality.line_fails(F.col("line")) != F.col("fails")).collect() == []


def test_line_dedup(docs, rows, nothing):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOW)
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(r[0])
    want = []
    for r in rows:
        ls = (r[1] or "").split("\n")
        gone = lambda x: len(holders.get(key(x), ())) >= 5 and max(i for i in holders[key(x)] if i is not None) != r[0]  # noqa: B023, E731
        kept = [x for x in ls if not gone(x)]
        want.append((r[0], len(ls), len(ls) - len(kept), "\n".join(kept)))
    out = lines.drop_repeated_lines(docs.withColumnRenamed("lang", "n_lines"))
    sort = lambda x: sorted(x, key=str)
    assert sort(tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == sort(want)
    assert sum(w[2] for w in want) > 5
    assert lines.drop_repeated_lines(nothing).count() == 0
    assert lines.deduplicated(docs).columns == docs.columns


@pytest.mark.parametrize("segments", [1, 8])
def test_twice_seen_never_misses(spark, segments):
    rng = np.random.default_rng(1)
    single, double, many = (rng.integers(-(2**62), 2**62, n) * 2 for n in (4000 * segments, 500, 100))
    values = [(v, False) for v in np.concatenate([single, double, double]).tolist()] + [(v, True) for v in many.tolist()]
    df = spark.createDataFrame(values, "h long, many boolean").repartition(6)
    bloom = {r.segment: np.frombuffer(r.bits, np.uint8) for r in lines.twice_seen(df, segments).collect()}

    def hit(x):
        u = x.view(np.uint64)
        segment = lines._segment(u, segments)
        return np.array([lines._seen(u[k : k + 1], bloom[int(s)])[0] for k, s in enumerate(segment)])

    assert len(bloom) == segments and hit(double).all() and hit(many).all() and hit(single).mean() < 0.02


def test_twice_seen_of_nothing(spark):
    assert lines.twice_seen(spark.createDataFrame([], "h long, many boolean"), 1).count() == 0


def test_line_dedup_without_broadcast(spark, docs, rows):
    """Lines that go to the filters' segments give the same as filters that are broadcast."""
    sort = lambda df: sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)
    assert sort(lines.drop_repeated_lines(docs, most_broadcast=0)) == sort(lines.drop_repeated_lines(docs))
    given = docs.selectExpr("doc_id", "text", "xxhash64(text) AS tag")
    hashes = given.select("text").collect()
    keys = [k for r in hashes for k in {x.strip(" \t\n\x0b\f\r").translate(LOW) for x in (r.text or "").split("\n")} if len(k) >= 40]
    seen = spark.createDataFrame([(xxhash.xxh64_intdigest(k.encode()) - (1 << 64 if xxhash.xxh64_intdigest(k.encode()) >> 63 else 0), False) for k in keys], "h long, many boolean")
    filters = lines.twice_seen(seen, 8).cache()
    a, b = (sorted(map(str, lines._suspects(given, filters, 8, 40, most).collect())) for most in (8, 0))
    assert a and set(a) == set(b)


def test_line_dedup_of_many_repeated_lines(spark):
    """Documents of 20,000 repeated lines, and lines of any length."""
    many = "\n".join(f"A line that many documents hold, number {k:06d}." for k in range(20_000))
    long = "x" * 300_000
    rows = [(k, f"{many}\nown line {k}\n{long}") for k in range(6)]
    out = {r.doc_id: r for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[k].kept_text == f"own line {k}" and out[k].n_dropped == 20_001 for k in range(5)) and out[5].kept_text == rows[5][1] and out[5].n_dropped == 0


def fingerprint(text):
    ws = words((text or "").translate(LOW))
    shingles = [" ".join(ws[k : k + 4]) for k in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash(docs, rows, nothing):
    fps = {r[1]: fingerprint(r[1]) for r in rows}
    groups = {f: {f} for f in fps.values()}
    for a in list(groups):
        for b in list(groups):
            if bin(a ^ b).count("1") <= 4 and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for x in groups[a]:
                    groups[x] = groups[a]
    least = lambda f: min(r[0] for r in rows if fps[r[1]] in groups[f] and r[0] is not None or False) if any(fps[r[1]] in groups[f] and r[0] is not None for r in rows) else None
    want = sorted(((r[0], f"{fps[r[1]]:016x}", least(fps[r[1]])) for r in rows), key=str)
    out = simhash.near_duplicates(docs)
    got = out.select("doc_id", simhash.hex_fingerprint(out.fp).alias("f"), "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[2] for w in want}


def near_fingerprints(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 8).astype(np.uint64)
    out = []
    for k in range(n):
        f = int(centres[k % 8])
        for b in rng.choice(64, rng.integers(0, 6), replace=False):
            f ^= 1 << int(b)
        out.append(f)
    return np.unique(np.array(out, np.uint64)).view(np.int64)


def partition(nodes, edges):
    parent = {int(n): int(n) for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(int(a)), find(int(b))
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("large", [32768, 20])
def test_golay_links_are_complete(spark, monkeypatch, large):
    """Also with groups that go the other way."""
    monkeypatch.setattr(simhash, "LARGE_GROUP", large)
    fp = near_fingerprints(300, 3)
    u = fp.view(np.uint64)
    want = partition(fp, [(fp[i], fp[j]) for i in range(len(fp)) for j in range(i) if int(u[i] ^ u[j]).bit_count() <= 4])
    df = spark.createDataFrame([(int(f),) for f in fp], "fp long")
    got = partition(fp, [(r.a, r.b) for r in simhash.linked(df).collect()])
    assert got == want


@pytest.mark.parametrize("most", [0, 1, 2, 3])
@pytest.mark.parametrize("large", [32768, 20])
def test_links_of_fewer_bits(spark, monkeypatch, most, large):
    """Any number of bits gives the same components, whichever way a group is linked."""
    monkeypatch.setattr(simhash, "LARGE_GROUP", large)
    fp = near_fingerprints(200, 5)
    u = fp.view(np.uint64)
    want = partition(fp, [(fp[i], fp[j]) for i in range(len(fp)) for j in range(i) if int(u[i] ^ u[j]).bit_count() <= most])
    df = spark.createDataFrame([(int(f),) for f in fp], "fp long")
    assert partition(fp, [(r.a, r.b) for r in simhash.linked(df, most).collect()]) == want


@pytest.mark.parametrize("most", [3, 4])
def test_ball_links(spark, most):
    fp = near_fingerprints(120, 8)
    u = fp.view(np.uint64)
    want = partition(fp, [(fp[i], fp[j]) for i in range(len(fp)) for j in range(i) if int(u[i] ^ u[j]).bit_count() <= most])
    df = spark.createDataFrame([(int(f),) for f in fp], "fp long")
    assert partition(fp, [(r.a, r.b) for r in simhash.ball_links(df, most).collect()]) == want


def test_links_in_one_group():
    """A group's forest against all pairs, with more comparisons than go at a time."""
    fp = near_fingerprints(3000, 9)
    key = (np.arange(len(fp)) >= 1500).astype(np.int32)
    u = fp.view(np.uint64)
    pairs = [(i, j) for lo, hi in ((0, 1500), (1500, len(fp))) for i, j in zip(*np.nonzero(np.bitwise_count(u[lo:hi, None] ^ u[None, lo:hi]) <= 4), strict=True) for i, j in [(i + lo, j + lo)] if i < j]
    want = partition(fp, [(fp[i], fp[j]) for i, j in pairs])
    assert partition(fp, zip(*(x.tolist() for x in simhash.links_in_groups(key, fp, 4)), strict=True)) == want


def test_golay_pairs_share_keys():
    rng = np.random.default_rng(2)
    fp = rng.integers(-(2**63), 2**63, 300)
    other = fp.copy().view(np.uint64)
    for k in range(len(other)):
        for b in rng.choice(64, 4, replace=False):
            other[k] ^= np.uint64(1) << np.uint64(b)
    keys = lambda x: set(simhash.golay_keys(np.array([x]))[1].tolist())
    assert all(keys(a) & keys(b) for a, b in zip(fp, other.view(np.int64), strict=True))


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (200, 300), (300, 200)]
    want = partition({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if sum(v == c for v in want.values()) > 1}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_star(spark, monkeypatch):
    """A node with most of the edges, whose rows are broadcast its least node."""
    from lodestone.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 100)
    edges = [(7, k) for k in range(1000, 3000)] + [(k, k + 1) for k in range(5000, 5050)] + [(2999, 5000)]
    want = partition({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.Vocabulary(entries.tokenizer_path()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(entries.tokenizer_path())


def test_bpe_is_exact(coder, library, rows):
    rng = random.Random(1)
    signs = "abst rvelmd'' \n\t é漢٣½😀.,!ABC123  aaaa\u00a0\u2003"
    odd = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    odd += ["<|endoftext|>", " <|endoftext|><|endoftext|> x", "a" * 5000, "漢字" * 300, "I'll 'll x've don'tx", "   ", "\n\n a", "x\n \n"]
    texts = odd + [r[1] for r in rows]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(texts)] == want
    assert all(coder.decode(w) == library.decode(w, skip_special_tokens=False) for w in want)
    words_only = {w.encode() for t in odd for w in t.split()}
    assert all(coder.piece(w) == coder.many([w])[0] for w in list(words_only)[:500])


def test_bpe_of_several_special_tokens(tmp_path, coder):
    """A vocabulary with two more special tokens, against the library; those with options are refused."""
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(entries.tokenizer_path(), encoding="utf-8"))
    most = max([*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])]) + 1
    plain = dict.fromkeys(("single_word", "lstrip", "rstrip", "normalized"), False) | {"special": True}
    spec["added_tokens"] += [{"id": most + k, "content": c} | plain for k, c in enumerate(("<a>", "[SEP]"))]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    library, mine = Tokenizer.from_file(str(tmp_path / "t.json")), bpe.Encoder(bpe.Vocabulary(str(tmp_path / "t.json")))
    texts = ["x <a> y", "<a>[SEP]<a>", " [SEP]  <|endoftext|>\n", "<a", "a><a>>", "no token", ""]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in mine.encode(texts)] == want
    assert [mine.decode(w) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]
    for bad in ({"content": "<b>", "lstrip": True}, {"content": "a><"}):
        (tmp_path / "u.json").write_text(json.dumps(spec | {"added_tokens": [*spec["added_tokens"], {"id": most + 9} | plain | bad]}))
        with pytest.raises(ValueError):
            bpe.Vocabulary(str(tmp_path / "u.json"))


def test_bpe_query(docs, rows, nothing, library):
    got = sorted((tuple(r) for r in bpe.round_trip(docs, entries.tokenizer_path()).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(nothing, entries.tokenizer_path()).count() == 0
    assert bpe.encode_column(docs, entries.tokenizer_path()).columns == [*docs.columns, "ids"]


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 40, n) * 1200
    m = tokens.WaveletMatrix(tokens.WaveletMatrix.pack(ids.astype(np.uint32)))
    assert m.unpack().tolist() == ids.tolist()
    for i in rng.integers(0, n, min(n, 40)).tolist():
        assert m.access(i) == ids[i]
    for v in (0, 1200, 36000, 5, 1 << 20):
        places = np.flatnonzero(ids == v)
        assert m.count(v) == len(places) and m.rank(v, n // 2) == (places < n // 2).sum()
        assert [m.select(v, k) for k in range(min(5, len(places)))] == places[:5].tolist() and m.select(v, len(places)) == -1


def test_token_shards(docs, rows, nothing, library, monkeypatch):
    got = [tuple(r) for r in tokens.token_digest(docs, entries.tokenizer_path()).collect()]
    ids = {(r[0], r[1]): [*library.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    want, at = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = ids[r[0], r[1]]
        want.append((r[0], at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokens.token_digest(nothing, entries.tokenizer_path()).count() == 0


def test_mixing(docs, rows, nothing):
    out = mixing.mix(docs).toPandas()
    assert int(out["rows"].sum()) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        aim = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        new = {s for s in names if s not in capped and aim[s] > 3 * size[s]}
        if not new:
            break
        capped |= new
    for s in names:
        mine = out[out.source.isna()] if s is None else out[out.source == s]
        assert np.allclose(mine.target, aim[s]) and (mine.source_size == size[s]).all() and (mine.copies <= 3).all()
        taken = (mine.copies * mine["size"] * mine["rows"]).sum()
        assert abs(taken - aim[s]) <= mine["size"].max() + 1
    again = mixing.mix(docs.repartition(2)).toPandas()
    key = ["doc_id", "row_hash"]
    assert out.sort_values(key)["copies"].tolist() == again.sort_values(key)["copies"].tolist()
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(docs).columns == docs.columns


def test_mixing_of_equal_rows(spark):
    """A source of equal rows comes near its target too: whole copies are spread over them; other columns may differ."""
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(1, text, "a", k % 7) for k in range(400)] + [(2 + k, "x " * 25, "b", 0) for k in range(120)] + [(None, text, None, 0)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int").repartition(3)
    out = mixing.mix(df).toPandas()
    assert int(out["rows"].sum()) == len(rows) and out.copies.max() <= 3
    taken = {}
    for s, g in out.groupby("source", dropna=False):
        taken[s] = (g.copies * g["size"] * g["rows"]).sum()
        assert abs(taken[s] - g.target.iloc[0]) <= g["size"].max(), s
    assert out[out.source == "a"].copies.nunique() == 2
    again = mixing.mixed(df)
    assert again.columns == df.columns
    sizes = Counter()
    for r in again.collect():
        sizes[r.source] += len(words(r.text))
    assert sizes == {s if isinstance(s, str) else None: n for s, n in taken.items() if n}


def test_mixing_in_many_blocks(spark, monkeypatch):
    """The tree has several levels and still meets its target."""
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rng = random.Random(3)
    df = spark.createDataFrame([(k, "w " * rng.randrange(1, 60), "s" if k % 3 else "t") for k in range(900)], "doc_id long, text string, source string")
    out = mixing.mix(df).toPandas()
    for _, g in out.groupby("source"):
        assert abs((g.copies * g["size"]).sum() - g.target.iloc[0]) < 0.03 * g.target.iloc[0]


def test_urls(spark):
    a = "https://WWW.Example.com/en/x?q"
    given = [
        (1, a, None, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "http://a.example.com/en/", "", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "x://a.net/es/1#y", "", "a.net", "/es/1", "net/es/", "block"), (4, "x://a.net/de", "", "a.net", "/de", None, "allow"), (5, None, "", "", "", None, "allow"), (6, "no scheme", "", "", "", None, "allow"),
        (7, "http://com/", "", "com", "/", "com/", "allow"), (8, "http://b.com", "", "b.com", "", None, "allow"), (9, "http://notnet/es/", "", "notnet", "/es/", None, "allow"),
        (10, "http://good.org/", "<a href='http://bad.net/fr/1'>", "good.org", "/", None, "block"), (11, "http://bad.net/fr/2", "<A HREF=//other.org/>", "bad.net", "/fr/2", "net/fr/", "block"), (1, a, None, "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ]
    df = spark.createDataFrame([g[:3] + ("clash",) for g in given], "page_id long, url string, html string, rule string")
    got = urls.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()
    want = [(g[0], *g[3:]) for g in given]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert urls.judge(df.limit(0)).count() == 0


def test_propagation(spark):
    rng = np.random.default_rng(0)
    m = (rng.random((12, 12)) < 0.2) & ~np.eye(12, dtype=bool)
    m[4] = m[:, 5] = False
    good, bad = np.zeros(12), np.zeros(12)
    good[:2], bad[-3:] = 0.5, 1 / 3
    w, r = m / np.maximum(1, m.sum(1, keepdims=True)), m / np.maximum(1, m.sum(0, keepdims=True))
    t, d = good.copy(), bad.copy()
    for _ in range(urls.ROUNDS):
        # What no link carries on returns to the seeds.
        t, d = (0.15 * t.sum() + 0.85 * t[m.sum(1) == 0].sum()) * good + 0.85 * (t @ w), (0.15 * d.sum() + 0.85 * d[m.sum(0) == 0].sum()) * bad + 0.85 * (r @ d)
    edges = spark.createDataFrame([(str(i), str(j), float(w[i, j]), float(r[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "src string, dst string, w double, r double")
    seeds = spark.createDataFrame([(str(k), float(good[k]), float(bad[k])) for k in range(12)], "host string, good double, bad double")
    got = {int(x.host): (x.trust, x.distrust) for x in urls.propagate(edges, seeds).collect()}
    assert np.allclose([got[k] for k in range(12)], np.stack([t, d], 1))
    assert np.isclose(t.sum(), 1) and np.isclose(d.sum(), 1) and (m.sum(1) == 0).any() and (m.sum(0) == 0).any()
    left = 0.85 * np.abs(t @ w - ((t - (0.15 * t.sum() + 0.85 * t[m.sum(1) == 0].sum()) * good) / 0.85)).sum()
    assert left < 1e-4  # the scores have settled


def test_host_that_most_pages_share(spark):
    """A hot host, very long html and links to hosts without pages."""
    long = "<p>" + "x " * 200_000 + "<a href='https://bad.net/fr/'>"
    given = [(k, f"https://hot.com/{k}", None) for k in range(500)] + [(1000, "https://bad.net/fr/1", None), (1001, "https://far.org/1", long), (1002, "https://far.org/2", "<a href=//nowhere.example/>")]
    df = spark.createDataFrame(given, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, round(r.trust, 6), round(r.distrust, 6)) for r in urls.judge(df).collect()}
    assert got[0] == ("allow", 3.0, 0.0) and got[1001][0] == got[1002][0] == "block" and got[1001][2] > 1


def test_licenses(docs, rows, nothing):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = licenses.scan(docs.withColumnRenamed("lang", "score")).collect()
    assert len(out) == len(rows)
    for r in out:
        text = (r.text or "").translate(LOW)
        ws, at, base, more, best = split.findall(text), [], set(), set(), 0.0
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            found = [k for k in range(len(ws)) if ws[k : k + len(p)] == p]
            at += found
            base |= {label} if found else set()
        for label, t in licenses.TEMPLATES:
            n, t = licenses.block_size(t), licenses._template_words(t)
            for k in (k for k, w in enumerate(ws) if w in t):
                share = len(t & set(ws[k : k + n]))
                if share >= 0.8 * len(t) - 1e-9:
                    more.add(label)
                    best = max(best, share / len(t))
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(at), min(at, default=None), max(at, default=None))
        assert (r.base_labels, r.labels, r.score) == (",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else best)
    assert {"apache,mit", "cc-by"} <= {r.labels for r in out}
    import textwrap

    for k, (label, text) in enumerate(licenses.TEMPLATES):  # notices as files carry them, among other words
        wrapped = "\n".join(" * " + x for x in textwrap.wrap(text, 40))
        given = [(k, prose(random.Random(k), 300) + "\n" + wrapped + "\n" + prose(random.Random(k + 1), 300)), (k + 100, " ".join(w + " " + prose(random.Random(3), 9) for w in text.split()))]
        got = {r.doc_id: (r.labels, r.score, r.blocks) for r in licenses.scan(docs.sparkSession.createDataFrame(given, "doc_id long, text string")).collect()} if k in (1, 9, 13) else None
        if got:
            assert label in got[k][0] and got[k][1] == 1.0 and any(x.word == 300 and x.score == 1 for x in got[k][2]) and got[k + 100][2] == []
    assert licenses.scan(nothing).count() == 0


def vectors_table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 16))
    x = np.concatenate([base, base[:80] + 0.25 * rng.standard_normal((80, 16)), np.repeat(base[:1], 40, 0) + 0.02 * rng.standard_normal((40, 16)), base[:3], 2 * base[:1]])
    label = rng.integers(0, 3, len(x))
    label[n : n + 80] = label[:80]
    label[n + 80 :] = label[0]
    rows = [(k, v.tolist(), int(c), "x") for k, (v, c) in enumerate(zip(x.astype(np.float32), label, strict=True))]
    odd = [(9000, None, 1, "x"), (9001, [0.0] * 16, 1, "x"), (9002, [float("nan")] * 16, 1, "x"), (9003, rows[0][1], None, "x"), (9004, [None] + [1.0] * 15, 1, "x"), (9005, [1.0, 2.0], 1, "x"), (9006, [2.0, 4.0], 1, "x"), rows[5]]
    return rows + odd


def test_embeddings(spark):
    rows = vectors_table(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string").repartition(4)
    got = sorted(tuple(r) for r in embeds.near_vectors(df).collect())
    links, edges = Counter(), []
    usable = [(k, r[0], np.array(r[1], float), r[2]) for k, r in enumerate(rows) if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    for k, i, a, c in usable:
        for m, j, b, e in usable:
            if k != m and c == e and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links[k] += 1
                edges.append((i, j))
    total = sum(links.values())
    by_id = defaultdict(list)
    for k, r in enumerate(rows):
        by_id[r[0]].append(links[k])
    assert len(got) == len(rows) and all(g[1] <= max(by_id[g[0]]) for g in got)
    assert sum(g[1] for g in got) >= 0.9 * total > 1000
    assert all(g[3] == (g[0] == g[2]) for g in got)
    part = partition([r[0] for r in rows], edges)
    assert sum(part[g[0]] == g[2] for g in got) >= 0.9 * len(got)
    assert embeds.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("mean", [0.0, 0.4, 0.6])
def test_borderline_embeddings(spark, mean):
    """Pairs of cosine 0.93 to 0.94 among vectors whose cosine is `mean` on average, against all pairs."""
    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    common = unit(rng.standard_normal((1, 64)))
    base = unit(np.sqrt(mean) * common + np.sqrt(1 - mean) * unit(rng.standard_normal((1000, 64))))
    noise = rng.standard_normal((1000, 64))
    noise = noise - (noise * base).sum(1, keepdims=True) * base
    c = 0.935
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * unit(noise)])
    near = x @ x.T >= embeds.THRESHOLD
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = sum(r.n_links for r in embeds.near_vectors(df).collect())
    assert near.sum() >= got >= 0.9 * near.sum()


def test_embedding_buckets(spark, monkeypatch):
    """Near copies that differ in their codes meet in blocks: no table has a row for each two of them, and no side of keys goes to all tasks."""
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(np.concatenate([unit(rng.standard_normal((500, 64))), unit(rng.standard_normal((1, 64))) + 0.012 * rng.standard_normal((1100, 64))]))
    near = x @ x.T >= embeds.THRESHOLD
    np.fill_diagonal(near, False)
    stored = []

    def cut(df):
        stored.append((df._jdf.queryExecution().executedPlan().toString(), out := real(df), out.count()))
        return out

    real = embeds.cut
    monkeypatch.setattr(embeds, "cut", cut)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeds.near_vectors(df).collect()}
    assert [got[k][0] for k in range(len(x))] == near.sum(1).tolist() and near.sum() > 1_000_000
    assert {got[k][1] for k in range(500, len(x))} == {500}
    assert max(n for _, _, n in stored) < 100 * len(x)
    assert not any("Generate" in plan and "Broadcast" in plan for plan, _, _ in stored)


def test_sample_of_many_partitions(spark):
    """What the fit's sample sends to the driver doesn't grow with the partitions: 60 of 500 vectors within 1 MB of results."""
    from pyspark.sql import functions as F

    df = spark.range(0, 30_000, 1, 60).select(F.lit(1).alias("label"), F.col("id").alias("node"), F.lit(16).alias("dim"), F.array(*[F.randn(k) for k in range(16)]).alias("v"))
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")
    try:
        _, tables = embeds._classes(df, 500, embeds.THRESHOLD)
    finally:
        conf.set("spark.driver.maxResultSize", before)
    assert list(tables) == [16]


def test_rotation_is_orthogonal():
    x = np.random.default_rng(0).standard_normal((500, 12))
    _, p = embeds.learn_rotation(x, 8)
    assert np.allclose(p.T @ p, np.eye(8), atol=1e-8)


def test_passages(docs, rows, nothing):
    out = substrings.shared_passages(docs).collect()
    text = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1] or ""):
        text.setdefault(r[0], words((r[1] or "").translate(LOW)))
    runs = defaultdict(set)
    for i, ws in text.items():
        for k in range(len(ws) - 49):
            runs[tuple(ws[k : k + 50])].add(i)
    must = set().union(*(v for v in runs.values() if len(v) > 1))
    found = {r.doc_id for r in out} | {r.other_id for r in out}
    assert must <= found
    for r in out:
        a, b = text[r.doc_id][r.start : r.end], text[r.other_id][r.other_start : r.other_end]
        assert r.other_id < r.doc_id and min(len(a), len(b)) >= 50
        common = len(a) if a == b else substrings._equal_in_gap(np.array([hash(w) for w in a]), np.array([hash(w) for w in b]))
        assert 0.8 * max(len(a), len(b)) <= r.n_equal <= common
    assert substrings.shared_passages(nothing).count() == 0


def test_chains_follow_gaps():
    x = np.array([0, 5, 10, 40, 200, 300])
    y = np.array([100, 105, 110, 141, 20, 120])
    got = sorted(map(tuple, substrings.chains(x, y)))
    assert (0, 1, 2, 3) in got and (4,) in got and (5,) in got


def test_passages_between_partial_holders(spark):
    """Documents 3 and 4 hold a passage of which the first and the last holders of any seed have too few words; 9 holds one twice."""
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.random()}" for _ in range(n)]
    p, twice = fresh(60), fresh(70)
    held = {1: p[:35], 2: p[25:], 3: p, 4: p, 5: p[:35], 6: p[25:], 8: twice, 9: twice + fresh(90) + twice}
    df = spark.createDataFrame([(k, " ".join(fresh(40) + v + fresh(40))) for k, v in held.items()], "doc_id long, text string")
    out = substrings.shared_passages(df).collect()
    assert {(r.doc_id, r.other_id, r.start, r.end) for r in out} == {(4, 3, 40, 100), (9, 8, 40, 110), (9, 8, 200, 270)}


def test_fuzzy_passages_are_found(spark):
    """Passages at and near the operator's threshold, 100 of a kind: share of changed words, least share that has to be found."""
    rng = random.Random(17)
    fresh = lambda n: [f"u{rng.random()}" for _ in range(n)]
    kinds, rows = ((52, 5, 0.97), (52, 8, 0.95), (50, 10, 0.9), (80, 12, 0.97)), []
    for k, (n, changed, _) in enumerate(kinds):
        for i in range(100):
            p = fresh(n)
            q = list(p)
            for at in rng.sample(range(n), changed):
                q[at] = fresh(1)[0]
            rows += [(1000 * k + 2 * i + j, " ".join(fresh(40) + v + fresh(40))) for j, v in enumerate((p, q))]
    out = substrings.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = Counter(r.doc_id // 1000 for r in out if r.doc_id == r.other_id + 1)
    shares = [got[k] / 100 for k in range(len(kinds))]
    assert all(share >= least for share, (_, _, least) in zip(shares, kinds, strict=True)), shares


@pytest.mark.parametrize("others", [3, 40])
def test_fuzzy_passages_among_holders_of_their_seeds(spark, others):
    """20 pairs share 60 words of which 6 differ; pieces of 12 words of them stand in many documents before, between and after."""
    rng = random.Random(23)
    fresh = lambda n: [f"u{rng.random()}" for _ in range(n)]
    held, pairs = {}, set()
    for k in range(20):
        p = fresh(60)
        q = [fresh(1)[0] if at in (9, 19, 29, 39, 49, 59) else w for at, w in enumerate(p)]
        base = 1000 * k
        for i in range(others):
            scattered = [w for at in rng.sample(range(0, 60, 10), 6) for w in p[at : at + 12] + fresh(9)]
            held |= {base + at + i: fresh(5) + scattered for at in (0, 200, 400)}
        held |= {base + 100: fresh(40) + p + fresh(40), base + 300: fresh(30) + q + fresh(40)}
        pairs.add((base + 300, base + 100))
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in held.items()], "doc_id long, text string")
    out = substrings.shared_passages(df).collect()
    assert pairs <= {(r.doc_id, r.other_id) for r in out}


def test_passage_at_a_middle_place(spark):
    """The first document has the seeds of a passage three times, with the passage around the second."""
    rng = random.Random(29)
    fresh = lambda n: [f"u{rng.random()}" for _ in range(n)]
    p = fresh(60)
    q = [fresh(1)[0] if at in (9, 19, 29, 39, 49, 59) else w for at, w in enumerate(p)]
    pieces = lambda: [w for _ in range(12) for at in (50, 20, 0, 40, 10, 30) for w in p[at : at + 9] + fresh(9)]
    rows = [(1, " ".join(pieces() + fresh(60) + p + fresh(60) + pieces())), (2, " ".join(fresh(20) + q + fresh(20)))]
    out = substrings.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.other_id) for r in out] == [(2, 1)]


def _places_of_a_run(docs):
    """(doc, words around, valid, edge) of the places of the seed of five zeros in docs, equal surroundings once."""
    seen, out = set(), []
    for k, words in enumerate(docs):
        padded = np.concatenate([np.zeros(45), words, np.zeros(50)]).astype(substrings.WORD)
        inside = np.concatenate([np.zeros(45, bool), np.ones(len(words), bool), np.zeros(50, bool)])
        at = [i for i in range(len(words) - 4) if not words[i : i + 5].any()]
        for i in at:
            around, valid = padded[i : i + 95], inside[i : i + 95]
            if (known := around.tobytes() + valid.tobytes()) not in seen:
                seen.add(known)
                out.append((k, around, valid, i - 1 not in at or i + 1 not in at))
    return [np.array(c) for c in zip(*out, strict=True)]


def test_places_of_a_very_common_seed_meet_quickly():
    """140 documents share a run of one word, between words of their own; 200 pairs of others have 70 words with a short run, 6 unlike.
    Looking at each pair of the 23,000 places is too slow."""
    rng = np.random.default_rng(31)
    fresh = lambda n: rng.integers(1, 1 << 16, n)
    docs = [np.concatenate([fresh(45), np.zeros(150, int), fresh(45)]) for _ in range(140)]
    for _ in range(200):
        p = np.concatenate([fresh(20), np.zeros(30, int), fresh(20)])
        q = p.copy()
        q[[3, 9, 15, 53, 59, 65]] = fresh(6)
        docs += [p, q]
    doc, around, valid, edge = _places_of_a_run(docs)
    assert len(doc) > 20_000
    begin = time.perf_counter()
    pairs = np.concatenate([np.stack(p) for p in substrings._connecting(doc, around, valid, edge, 50, 40)], axis=1)
    assert time.perf_counter() - begin < 12
    assert (doc[pairs[0]] < doc[pairs[1]]).all()
    runs = substrings._equal_runs(doc, around, valid, 50)
    group = substrings._joined(np.arange(len(docs)), np.concatenate([doc[runs], doc[pairs[0]]]), np.concatenate([doc, doc[pairs[1]]]))
    assert group.tolist() == [0] * 140 + [k - k % 2 for k in range(140, 540)]


def test_far_passage_hides_no_near_match():
    """300 common words, 100 unlike ones, then 80 words with 2 inserted: the last stay one chain."""
    x = np.concatenate([np.arange(0, 300, 8), np.arange(400, 480, 8)])
    y = np.where(x < 440, x, x + 2)
    late = set(np.flatnonzero(x >= 400).tolist())
    assert sum(bool(late & set(c)) for c in substrings.chains(x, y)) == 1


def test_pipeline_stages(spark, docs, nothing, tmp_path, library):
    """Every stage on what its predecessor kept, then run() on a table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "bpe_round_trip":
            want = sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in now.collect())
        out = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert stage(spark, nothing, str(tmp_path)).count() == 0
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in now.collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "bpe_round_trip"]


def test_operators_beside_clashing_columns(spark, rows):
    """Columns of the documents that are named like an operator's own don't disturb it."""
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(rows, COLUMNS)
    names = ["size", "copies", "rows", "one", "id", "node", "ids", "fp", "a", "b", "key", "start", "part", "doc", "at", "n", "w", "h"]
    extra = plain.withColumns({c: F.lit("clash") for c in names if c not in plain.columns})
    calls = (mixing.mix, simhash.near_duplicates, substrings.shared_passages, lambda d: bpe.round_trip(d, entries.tokenizer_path()), lambda d: tokens.token_digest(d, entries.tokenizer_path()))
    for call in calls:
        assert sorted(map(str, call(extra).collect())) == sorted(map(str, call(plain).collect()))


def test_passages_of_text_ids(spark):
    """Ids of any type, and copies as one document."""
    rng = random.Random(4)
    p = [f"u{rng.random()}" for _ in range(70)]
    fresh = lambda n: [f"v{rng.random()}" for _ in range(n)]
    rows = [("b", " ".join(p + fresh(30))), ("a", " ".join(fresh(20) + p)), ("c", " ".join(fresh(90))), (None, " ".join(p))]
    rows += [("copy2", rows[2][1]), ("copy1", rows[2][1])]
    out = substrings.shared_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    got = {(r.doc_id, r.other_id, r.start, r.end, r.other_start, r.other_end) for r in out}
    assert got == {("b", "a", 0, 70, 20, 90), ("copy1", "c", 0, 90, 0, 90), ("copy2", "c", 0, 90, 0, 90)}


def test_every_shared_run_is_linked(spark):
    """Brute force over all runs of 50 words: the documents that hold one are connected by passages that hold it, whatever
    pieces of it earlier documents have, and also where it stands in very many documents."""
    rng = random.Random(12)
    fresh = lambda n: [f"u{rng.random()}" for _ in range(n)]
    p, q, s, hot, stock = fresh(200), fresh(75), fresh(64), fresh(80), fresh(14)
    pieces = [p[k : k + 30] for k in range(0, 200, 30)]
    rng.shuffle(pieces)
    held = [sum(pieces, []), fresh(30) + p + fresh(30), fresh(20) + p + fresh(10), sum(pieces[::-1], []), fresh(25) + p[:120] + fresh(25) + p[60:] + fresh(5)]
    held += [fresh(5) + q[k : k + 25] + fresh(5) + q[k + 13 : k + 38] for k in range(0, 50, 5)] + [fresh(20) + q + fresh(9), q + fresh(40)]
    held += [fresh(9) + s[:40] + fresh(3), s[20:] + fresh(8), s + fresh(9), fresh(7) + s, fresh(60) + s]
    held += [fresh(rng.randrange(30)) + stock + fresh(10) + hot[k % 9 : 80 - k % 7] + fresh(12) + stock for k in range(45)]
    held += [fresh(40) + held[1] + fresh(3), held[1], held[-1]]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(held)], "doc_id long, text string").repartition(5)
    passages = substrings.shared_passages(df).collect()
    runs = defaultdict(lambda: defaultdict(list))
    for d, w in enumerate(held):
        for k in range(len(w) - 49):
            runs[tuple(w[k : k + 50])][d].append(k)
    shared = {r: at for r, at in runs.items() if len(at) > 1}
    assert len(shared) > 300
    inside = lambda at, a, b: any(a <= k and k + 50 <= b for k in at)
    for at in shared.values():
        edges = [(x.doc_id, x.other_id) for x in passages if x.doc_id in at and x.other_id in at and inside(at[x.doc_id], x.start, x.end) and inside(at[x.other_id], x.other_start, x.other_end)]
        assert len(set(partition(at, edges).values())) == 1
    for r in passages:
        a, b = held[r.doc_id][r.start : r.end], held[r.other_id][r.other_start : r.other_end]
        assert r.other_id < r.doc_id and min(len(a), len(b)) >= 50 and 0.8 * max(len(a), len(b)) <= r.n_equal <= min(len(a), len(b))


def test_pipeline_against_plain_python(spark, tmp_path, library):
    """run() on a small table against the stages written out in Python: which rows come out, how often, and their texts' ids."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    sentence = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n)).capitalize() + "."
    stock = "This very sentence stands in many of the documents of the table."
    rows = []
    for k in range(60):
        text = "\n".join([sentence(rng.randrange(15, 40)) for _ in range(rng.randrange(1, 5))] + ([stock] if k % 4 == 0 else []))
        rows.append((k, text, "en", rng.choice(["a", "b", None]), len(text)))
    rows += [(100 + k, rows[k][1], "en", "a", rows[k][4]) for k in range(5)] + [(200, None, None, None, None), (201, "", "en", "b", 0), (202, "Home | About | Contact\n" * 9, "en", "b", 9), (203, sentence(30) + "\nRead more", "en", "a", 9)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    def plain_fails(line):
        return not line.rstrip().endswith((".", "!", "?")) and not (len(line) >= 60 and ". " in line) or line.count("|") > 1

    docs = {}
    for i, text, _, source, _ in rows:  # quality rules
        n, _, _, _, again = base_counts(text)
        kept = [x for x in (text or "").split("\n") if not words(x) or not plain_fails(x)]
        lost = sum(len(w) for x in (text or "").split("\n") if words(x) and plain_fails(x) for w in words(x))
        if n >= 20 and 100 * again <= 30 * n and lost <= 0.5 * sum(map(len, words(text))):
            docs[i] = ("\n".join(kept), source)
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOW)
    holders = defaultdict(set)
    for i, (text, _) in docs.items():  # line dedup
        for x in text.split("\n"):
            holders[key(x)].add(i)
    gone = lambda i, x: len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and max(holders[key(x)]) != i
    docs = {i: ("\n".join(x for x in text.split("\n") if not gone(i, x)), source) for i, (text, source) in docs.items()}
    fps = {i: fingerprint(text) for i, (text, _) in docs.items()}  # SimHash near-dedup
    part = partition(docs, [(i, j) for i in docs for j in docs if i < j and (fps[i] ^ fps[j]).bit_count() <= 4])
    docs = {i: d for i, d in docs.items() if part[i] == i}
    size = Counter()
    for text, source in docs.values():  # mixing: how often each source's words are taken
        size[source] += len(words(text))
    assert set(i for i, _, _ in got) <= set(docs)
    taken = Counter()
    for (i, n, ids), times in got.items():
        want = library.encode(docs[i][0], add_special_tokens=False).ids
        assert n == len(want) and ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and times <= 3
        taken[docs[i][1]] += times * len(words(docs[i][0]))
    names = sorted(size, key=lambda x: (x is None, x or ""))
    weight, capped = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[x] for x in capped)
        aim = {x: 3 * size[x] if x in capped else rest * weight[x] / sum(weight[y] for y in names if y not in capped) for x in names}
        if not (new := {x for x in names if x not in capped and aim[x] > 3 * size[x]}):
            break
        capped |= new
    most = max(len(words(text)) for text, _ in docs.values())
    assert all(abs(taken[x] - aim[x]) <= most + 1 for x in names)
    share = {x: aim[x] / size[x] for x in names}
    times = Counter()
    for (i, _, _), n in got.items():
        times[i] += n
    assert all(int(share[s] + 1e-9) <= times[i] <= int(share[s] + 1e-9) + 1 for i, (text, s) in docs.items() if words(text))


def test_stages_keep_clashing_columns(spark, rows):
    """Columns of the documents that are named like an operator's own come through unchanged."""
    from pyspark.sql import functions as F

    extra = spark.createDataFrame(rows, COLUMNS).withColumn("kept", F.lit("mine")).withColumn("n_lines", F.lit("yours"))
    for stage in (quality.cleaned, lines.deduplicated, simhash.first_of_each, mixing.mixed):
        out = stage(extra)
        assert out.columns == extra.columns
        assert {(r.kept, r.n_lines) for r in out.select("kept", "n_lines").distinct().collect()} == {("mine", "yours")}, stage
