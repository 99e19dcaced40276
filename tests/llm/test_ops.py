"""The corpus operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandlake.llm import bpe, exact, lines, linking, minhash, packing, sharding, tokens, topk, toxicity, urls

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " \n\t", "a", "It's 1234 naïve\u0301 ΣΑΣ ΣΣ.", "x" * 3000 + " end", "a<|endoftext|>B<|", "\x1c\x1d y\x85z", "😀 日本語 \ua7cb", "one two three\n\n\nfour\n  five", "Don't  STOP\r\n\r\n now"]
SCHEMA = "doc_id long, text string, ids string, score string, block int"


def docs(spark, rows):
    """Rows of (doc_id, text), with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


def odd(spark):
    return docs(spark, [*enumerate(ODD), (3, "a"), (None, "b c"), (None, None)])


def text(n, rng, size=300):
    return " ".join("w%d" % rng.randrange(size) for _ in range(n))


# --- 1 -------------------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(600):
        bad = i % 6 == 0
        words = text(60, rng).split()
        if bad:
            words[rng.randrange(60)] = "vile%s" % rng.choice(["", "s", "est", "ly"])
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            marks.append((i, int(bad)))
    labels = spark.createDataFrame([*marks, (None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    d = docs(spark, rows)
    model = toxicity.train(d, labels)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 6 == 0) for i in held) >= 0.95 * len(held)
    # labels of the held-out fold change nothing
    other = labels.where("doc_id is null or doc_id = 9999").unionAll(spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in marks], "doc_id long, toxic int"))
    again = toxicity.train(d, other)
    assert all(np.array_equal(a[0], b[0]) and a[1] == b[1] for a, b in zip(model, again))
    long = docs(spark, [(1, text(20_000, rng) + " vilest"), (2, text(20_000, rng))])
    late = {r.doc_id: r.score for r in toxicity.score(long, model).collect()}
    assert late[1] >= 0.5 > late[2]
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i] < 0.5}


@pytest.mark.parametrize("share,hot", [(0.4, 0), (0.6, 0), (0.2, 0.3), (0.1, 0.5)])
def test_toxicity_many_toxic(spark, share, hot):
    """Toxic texts in any share of the documents, and a hot group of copies of one, are found and clean ones stay."""
    rng = random.Random(7)
    copy, rows = text(60, rng, 3000) + " vilest", []
    for i in range(900):
        r = rng.random()
        rows.append((i, copy if r < hot else text(60, rng, 3000) + (" vilest" if r < hot + share else ""), int(r < hot + share)))
    labels = spark.createDataFrame([(i, bad) for i, _, bad in rows if rng.random() < 0.6], "doc_id long, toxic int")
    d = docs(spark, [(i, t) for i, t, _ in rows])
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(d, toxicity.train(d, labels)).collect()}
    for bad in (0, 1):
        own = [got[i] for i, _, b in rows if b == bad]
        assert sum(x == bool(bad) for x in own) >= (0.9 if hot else 0.95) * len(own)


def test_toxicity_learns_late_words(spark):
    """Training reads whole texts: the evidence stands behind 2,000 other distinct words."""
    rng = random.Random(8)
    filler = " ".join("f%d" % i for i in range(2000))
    rows = [(i, filler + " " + text(20, rng, 3000) + (" vilest" if i % 6 == 0 else "")) for i in range(300)]
    d = docs(spark, rows)
    model = toxicity.train(d, spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert {r.doc_id for r in toxicity.score(d, model).collect() if r.score >= 0.5} == {i for i, _ in rows if i % 6 == 0}


@pytest.mark.parametrize("prior,shift", [(0.3, 1.0), (0.9, -1.0)])
def test_toxicity_risk_by_brute_force(prior, shift):
    """The risk is that of its definition, and the gradient is its slope, or that of the negated negative part."""
    rng = np.random.default_rng(15)
    is_p = np.arange(9) < 4
    share = np.where(is_p, 1 / 4, 1 / 5)
    z = rng.normal(0, 1, 9) + np.where(is_p, 0, shift)

    def parts(z):
        pos = [np.log(1 + np.exp(-x)) for x in z[:4]]
        as_negative = [np.log(1 + np.exp(x)) for x in z]
        return prior * np.mean(pos), np.mean(as_negative[4:]) - prior * np.mean(as_negative[:4])

    plus, rest, grad = toxicity.risk(z, is_p, share, prior, 4.0)
    assert np.allclose((plus, rest), parts(z)) and (rest < 0) == (shift < 0)
    for i in range(9):
        step = np.zeros(9)
        step[i] = 1e-6
        slope = [(b - a) / 2e-6 for a, b in zip(parts(z - step), parts(z + step))]
        assert np.isclose(grad[i], -slope[1] if rest < 0 else sum(slope), atol=1e-6)


def test_toxicity_repeated_id(spark):
    """A document that stands in the table often is sampled once."""
    rng = random.Random(16)
    rows = [(i, text(40, rng, 3000) + (" vilest" if i % 5 == 0 else "")) for i in range(300)]
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    hot = next(i for i in range(1, 300) if i % 5 and zlib.crc32(str(i).encode()) % 5)
    d, often = docs(spark, rows), docs(spark, rows + [rows[hot]] * 500)
    assert all(np.array_equal(a[0], b[0]) and a[1] == b[1] for a, b in zip(toxicity.train(d, marks), toxicity.train(often, marks)))


def test_toxicity_odd_rows(spark):
    model = toxicity.train(odd(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score(odd(spark), model).collect()
    assert len(out) == len(ODD) + 3 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs(spark, []), model).count() == 0


# --- 2 -------------------------------------------------------------------------------


def brute_topk(vecs, k):
    out = set()
    q = [(i, np.floor(64 * np.array(v, np.float64)).astype(int)) for i, v in vecs]
    for i, x in {a: b for a, b in q if a % 20 == 0}.items():
        best = sorted((-int(x @ y), j) for j, y in q if j != i)[:k]
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("rows", [16, 10_000])
def test_topk(spark, rows):
    rng = np.random.default_rng(3)
    vecs = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(150)]
    bad = [(1000, None), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1040, [float("nan")] * 6), (1060, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 7) for i, v in vecs + bad], "vec_id long, embedding array<float>, score int")
    got = topk.search(df, rows=rows).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute_topk(vecs, 20) and len(got) == 8 * 20
    assert topk.search(df.limit(0)).count() == 0
    few = topk.search(df.where("vec_id < 4")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]


def test_topk_large_components_and_repeats(spark):
    """Components and scores beyond 32 bits are exact, those beyond a long are its ends; rows that repeat a query's id aren't its own."""
    vecs = [(0, [4e7, -1.0]), (1, [4e7, 2.0]), (2, [-3e7, 0.5]), (3, [1e300, 0.0]), (4, [-1e300, 0.0]), (20, [0.5, 0.25]), (20, [0.5, 0.25]), (5, [])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    top, out = (1 << 63) - 1, set()
    scaled = [(i, [min(top, max(-top - 1, int(np.floor(64 * x)))) if abs(x) < 1e200 else (top if x > 0 else -top - 1) for x in v]) for i, v in vecs]
    for q, x in {i: v for i, v in scaled if i % 20 == 0}.items():
        score = [(-min(top, max(-top - 1, sum(a * b for a, b in zip(x, y)))), j) for j, y in scaled if j != q]
        out |= {(q, r + 1, j, -s) for r, (s, j) in enumerate(sorted(score)[:20])}
    assert {tuple(r) for r in topk.search(df).collect()} == out


def test_slices_add_up():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 700):
        m = rng.integers(-9, 40, (n, 7))
        index = topk.Slices(m)
        for _ in range(10):
            q = rng.integers(-9, 40, 7)
            rows, value = index.top(q, 20)
            want = np.lexsort((np.arange(n), -(m @ q)))[:20]
            assert (value == (m @ q)[rows]).all() and sorted(rows) == sorted(want)


# --- 3 -------------------------------------------------------------------------------


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(s, rng, n, letters="abc"):
    s = list(s)
    for _ in range(n):
        r, i = rng.random(), rng.randrange(len(s) + 1)
        if r < 0.33:
            s.insert(i, rng.choice(letters))
        elif r < 0.66 and s:
            s.pop(min(i, len(s) - 1))
        elif s:
            s[min(i, len(s) - 1)] = rng.choice(letters)
    return "".join(s)


def test_banded_distance():
    rng = random.Random(2)
    for _ in range(5000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(10)))
        b = edited(a, rng, rng.randrange(5), "ab")
        for k in (0, 1, 2, 3):
            assert lines.within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_segments_find_all_within_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(26, 60)))
        b = edited(a, rng, rng.randrange(1, 3))
        assert set(lines.keys_of(a)) & set(lines.keys_of(b))


def brute_lines(rows):
    at = sorted((i, n, x.strip()) for i, t in rows for n, x in enumerate(t.split("\n")) if x.strip())
    own = {x for _, _, x in at}
    root = {x: x for x in own}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    some = [x for x in own if len(x) >= lines.FUZZY]
    for p, x in enumerate(some):
        for y in some[p + 1 :]:
            if abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
                root[top(x)] = top(y)
    seen, gone = set(), set()
    for i, n, x in at:
        if top(x) in seen:
            gone.add((i, n))
        seen.add(top(x))
    return gone


@pytest.mark.parametrize("small,block", [(24, 128), (2, 3)])
def test_line_dedup(spark, monkeypatch, small, block):
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(linking, "BLOCK", block)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(24, 50))).strip() for _ in range(12)]
    rows = []
    for i in range(60):
        own = [edited(rng.choice(base), rng, rng.randrange(6), "abcdefgh") for _ in range(rng.randrange(1, 4))]
        rows.append((i, "\n".join([*own, "}", "" if i % 2 else "  }"])))
    d = docs(spark, rows)
    want = brute_lines(rows)
    assert {(r.doc_id, r.line_no) for r in lines.dropped(d).collect()} == want
    assert {(r.doc_id, n) for r in lines.report(d).collect() for n in r.dropped_lines} == want
    clean = {r.doc_id: r.text for r in lines.clean(d).collect()}
    assert clean == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want) for i, t in rows}


@pytest.mark.parametrize("small,block", [(24, 128), (2, 3)])
def test_line_dedup_one_word(spark, monkeypatch, small, block):
    """A line with one word replaced goes, wherever the word stands; one with two replaced stays."""
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(linking, "BLOCK", block)
    rng = random.Random(9)
    rows, want = [], set()
    for i, n in enumerate([8, 9, 27, 100]):
        words = text(n, rng, 10**6).split()
        rows.append((100 * i, " ".join(words)))
        for at in range(0, n, 3):
            rows.append((100 * i + 1 + at, " ".join([*words[:at], "replacement%d" % at, *words[at + 1 :]])))
            want.add((100 * i + 1 + at, 0))
        rows.append((1000 + i, " ".join(["another", *words[1:-1], "different"])))
    assert {(r.doc_id, r.line_no) for r in lines.dropped(docs(spark, rows)).collect()} == want


def test_line_dedup_repeated_and_null_ids(spark):
    """Rows that share an id lose their own lines only; null ids come last and lose what stands before."""
    rows = [(0, "a shared line"), (1, "a shared line\nkeep me"), (1, "totally different\nanother"), (None, "a shared line\nmine"), (None, "mine\nmine too"), (2, "twice"), (2, "twice")]
    d = docs(spark, rows).withColumnRenamed("ids", "gone_lines").withColumnRenamed("score", "gone_id")
    got = Counter((r.doc_id, r.text) for r in lines.clean(d).collect())
    assert got - Counter([(0, "a shared line"), (1, "keep me"), (1, "totally different\nanother"), (2, "twice"), (2, "twice")]) in (
        Counter([(None, "mine"), (None, "mine too")]), Counter([(None, ""), (None, "mine\nmine too")]))
    told = Counter((r.doc_id, r.n_dropped) for r in lines.report(d).collect())
    assert told[(0, 0)] == 1 and told[(1, 1)] == 1 and told[(1, 0)] == 1 and told[(2, 0)] == 2
    assert sum(n * k for (i, n), k in told.items() if i is None) == 2


def test_line_dedup_long_line(spark):
    """A line of a million characters takes part like any other."""
    rng = random.Random(14)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000)).strip()
    rows = [(1, long), (2, long[:500_000] + "z" + long[500_001:]), (3, long[:300_000])]
    assert {(r.doc_id, r.line_no) for r in lines.dropped(docs(spark, rows)).collect()} == {(2, 0)}


def test_line_dedup_odd_rows(spark):
    out = lines.report(odd(spark))
    assert out.count() == len(ODD) + 3
    assert lines.clean(odd(spark)).columns == odd(spark).columns
    assert lines.report(docs(spark, [])).count() == 0


# --- 4 -------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark):
    lib = Tokenizer.from_file(WORDS)
    rows = list(enumerate([*ODD, *(f"q{chr(c)}R {chr(c)}" for c in range(1, 0x3000, 11)), "ab" * 700]))
    encoded = bpe.encode(docs(spark, rows), WORDS)
    got = {r.doc_id: r for r in bpe.digests(bpe.decode(encoded, WORDS)).collect()}
    assert sorted(tuple(r) for r in bpe.digests(bpe.round_trip(docs(spark, rows).coalesce(1), WORDS)).collect()) == sorted(tuple(r) for r in got.values())
    assert bpe.decode(encoded.coalesce(1), WORDS).count() == len(rows)
    assert len(got) == len(rows)
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), t
    assert bpe.encode(odd(spark), WORDS).count() == len(ODD) + 3 and bpe.encode(docs(spark, []), WORDS).count() == 0


def test_rank_array_and_heap_agree():
    own, rng = bpe.encoder(WORDS), random.Random(5)
    for _ in range(300):
        symbols = [rng.choice("thein") for _ in range(rng.randrange(1, 60))]
        assert own._scan(symbols) == own._heap(symbols)


# --- 5 -------------------------------------------------------------------------------


def test_cuckoo_index_against_a_dict():
    rng, index, live = random.Random(6), exact.CuckooIndex(2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(30_000):
        k = rng.choice(keys)
        if rng.random() < 0.4:
            assert index.delete(k) == (live.pop(k, None) is not None)
        else:
            number = index.insert(k)
            assert live.setdefault(k, number) == number
        assert index.live == len(live)
    assert all(index.find(k) == live.get(k, -1) for k in keys)


@pytest.mark.parametrize("held", [3, 100_000])
def test_exact_dedup(spark, monkeypatch, held):
    monkeypatch.setattr(exact, "LIVE", held)
    rows = [*enumerate(["a b", "ab", "a  b", None, "", " \t\r\n\x0b\x0c", "é x", "éx ", "other", "a\xa0b"]), (20, "ab"), (21, "a  b"), (None, "ab"), (None, "solo")]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.dedup(docs(spark, rows)).collect())
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((i, t or ""))
    want = Counter()
    for g in groups.values():
        keep = min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        want.update((i, keep, len(g), i == keep) for i, _ in g)
    assert got == want
    assert exact.dedup(docs(spark, [])).count() == 0


# --- 6 -------------------------------------------------------------------------------


def test_sharding(spark, tmp_path):
    names = sharding.names(10)
    table = sharding.fill(names, 1009)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 10
    fewer = sharding.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 9)
    assert moved < 0.25 * 1009
    got = sharding.place(odd(spark), shards=names, slots=1009).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, table[slot])
    clash = odd(spark).withColumnRenamed("score", "shard").withColumnRenamed("block", "slot")
    sharding.write_shards(clash, f"{tmp_path}/shards", shards=names, slots=1009)
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in back) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in clash.collect())
    where = {r.doc_id: r.shard for r in got}
    assert all(r._shard == where[r.doc_id] for r in back)
    with pytest.raises(ValueError):
        sharding.fill(names, 1000)
    assert sharding.place(docs(spark, [])).count() == 0


# --- 7 -------------------------------------------------------------------------------


def check_pack(rows, pieces, window):
    lib, want = Tokenizer.from_file(WORDS), Counter()
    for i, t in rows:
        want[(i, tuple([*lib.encode(t or "", add_special_tokens=False).ids, 1]))] += 1
    by, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, len(r.ids) // 4))
    for s in sequences.values():
        end = 0
        for at, n in sorted(s):
            assert at == end and n > 0
            end += n
        assert end == window or end & (end - 1) == 0 and end < window
    got = Counter()
    for i, rs in by.items():
        rs.sort(key=lambda r: r.start)
        whole = b"".join(bytes(r.ids) for r in rs)
        assert len(whole) // 4 == rs[0].doc_tokens and [r.start for r in rs] == [sum(len(x.ids) // 4 for x in rs[:k]) for k in range(len(rs))]
        got[(i, tuple(np.frombuffer(whole, "<u4").tolist()))] += 1
    assert got == want


@pytest.mark.parametrize("pool", [1024, 8])
def test_packing(spark, monkeypatch, pool):
    monkeypatch.setattr(packing, "POOL", pool)
    rng = random.Random(7)
    rows = [*enumerate(ODD), *((100 + i, text(rng.randrange(200), rng)) for i in range(80)), (300, text(3000, rng))]
    pieces = packing.pack(docs(spark, rows).coalesce(2), WORDS, window=128).collect()
    check_pack(rows, pieces, 128)
    assert packing.described(packing.pack(odd(spark), WORDS)).agg({"length": "sum"}).first()[0] > 0
    assert packing.pack(docs(spark, []), WORDS).count() == 0


def test_subset_sum():
    rng = random.Random(8)
    for _ in range(300):
        sizes = [rng.randrange(1, 12) for _ in range(rng.randrange(9))]
        cap = rng.randrange(30)
        sums = {0}
        for s in sizes:
            sums |= {x + s for x in sums if x + s <= cap}
        took = packing.fill(cap, dict(Counter(sizes)))
        assert sum(s * n for s, n in took.items()) == max(sums) and all(n <= Counter(sizes)[s] for s, n in took.items())


# --- 8 -------------------------------------------------------------------------------


def brute_near(rows, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in (t or "").translate(str.maketrans(urls.UPPER, urls.LOWER)).replace("\t", " ").replace("\n", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {(i, len(sets[i]), top(i), top(i) == i) for i in sets}


@pytest.mark.parametrize("small,block", [(24, 128), (2, 4)])
def test_minhash(spark, monkeypatch, small, block):
    monkeypatch.setattr(linking, "SMALL", small)
    monkeypatch.setattr(linking, "BLOCK", block)
    rng = random.Random(9)
    passage = text(55, rng).split()
    rows = []
    for g in range(6):
        base = text(rng.randrange(60, 160), rng, 4000).split()
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "z%d" % rng.randrange(10**6)
            rows.append((len(rows), " ".join(w)))
    rows += [(100 + i, " ".join(text(60, rng, 4000).split() + passage)) for i in range(40)]
    rows += [(200, None), (201, ""), (202, "A b"), (203, "a  B"), (204, "a b c"), (205, text(20_000, rng, 10**6)), (206, " \n")]
    got = {tuple(r) for r in minhash.near(docs(spark, rows)).collect()}
    assert got == brute_near(rows, 85)


def test_minhash_odd_rows(spark):
    out = minhash.near(odd(spark)).collect()
    assert len(out) == len(ODD) + 3 and all(r.component_id == r.doc_id for r in out)
    assert minhash.near(docs(spark, [])).count() == 0
    assert minhash.drop_near(odd(spark)).columns == odd(spark).columns


@pytest.mark.parametrize("edges", [100_000, 40])
def test_components(spark, monkeypatch, edges):
    """By one task that holds all edges, and by stars over several."""
    monkeypatch.setattr(linking, "EDGES", edges)
    rng = random.Random(10)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    got = [(r.id, r.component) for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, top(x)) for x in root)


def test_minhash_repeated_ids(spark):
    """A document of two texts is linked by either of them, and links what is alike one of them."""
    rng = random.Random(12)
    one, two = text(60, rng, 10**6), text(60, rng, 10**6)
    rows = [(1, one), (5, one + " x"), (5, two), (7, two + " y"), (3, two), (9, text(60, rng, 10**6))]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near(docs(spark, rows)).collect())
    assert got == Counter([(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (3, 1, False), (9, 9, True)])
    clash = docs(spark, rows).withColumnRenamed("ids", "gone")
    assert sorted(r.doc_id for r in minhash.drop_near(clash).collect()) == [1, 9]


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_recall(percent):
    """Pairs exactly at the threshold nearly always agree in as many coordinates as are asked for."""
    rng = np.random.default_rng(13)
    common, each = (8 * percent, 4 * (100 - percent))  # of a union of 800
    lost = 0
    for _ in range(400):
        grams = rng.integers(0, 1 << 63, common + 2 * each, dtype=np.uint64)
        a, b = np.sort(grams[: common + each]), np.sort(np.concatenate([grams[:common], grams[common + each :]]))
        x, y = (minhash.values([minhash.signature(g).tobytes()])[0] for g in (a, b))
        lost += (x == y).sum() < minhash.least_matches(percent)
    assert lost == 0


# --- 9 -------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_counts(spark, rule):
    lib = Tokenizer.from_file(BYTES)
    rows = [*enumerate(ODD), (50, "a\n\n\n\nb \n \n\n  é\nc"), (51, "x\n" * 40)]
    got = defaultdict(dict)
    for r in tokens.count(docs(spark, rows), BYTES, rule=rule).collect():
        got[r.doc_id][r.section] = (r.start, r.length, r.n_tokens)
    for i, t in rows:
        t = t or ""
        starts = tokens.lines(t)
        ends = [*starts[1:], len(t)]
        want = [0] * len(starts)
        for a, b in lib.encode(t, add_special_tokens=False).offsets:
            parts = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends)]
            hit = [k for k, p in enumerate(parts) if p]
            want[hit[0] if rule == "start" else hit[-1] if rule == "end" else parts.index(max(parts))] += 1
        assert [got[i][k] for k in range(len(starts))] == [(s, e - s, n) for s, e, n in zip(starts, ends, want)], t
    assert tokens.count(docs(spark, []), BYTES).count() == 0


# --- 10 ------------------------------------------------------------------------------


def test_urls(spark):
    cases = [
        ("http://A.Example.com/en/7?x", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("http://b.com/en/x", "b.com", "/en/x", "com/en/", "block"),
        ("https://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
        ("https://x.example.net/de/80", "x.example.net", "/de/80", "example.net/de/8", "block"),
        ("https://myexample.net/de/80", "myexample.net", "/de/80", "net/de/", "allow"),
        ("ftp://o.org/es/#a", "o.org", "/es/", "org/es/", "block"),
        ("https://spam.org/en/1/?a#b", "spam.org", "/en/1/", None, "block"),
        ("https://www.spam.org/en/1", "www.spam.org", "/en/1", None, "block"),
        ("https://ok.org/en/1", "ok.org", "/en/1", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://h?p/://q", "h", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "z") for i, c in enumerate(cases)], "page_id long, url string, key string")
    listed = spark.createDataFrame([("spam.org/en/1",), ("spam.org/en/1",), (None,)], "listed string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, listed).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    # a filter of one block passes nearly everything; the exact join makes up for it
    full = spark.range(300).selectExpr("concat('u', id) AS listed").unionAll(listed)
    again = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, full, blocks=1).collect()}
    assert again == got
    assert [urls.blocks_for(n) for n in (0, 3, 4, 1000, 10**9)] == [1, 1, 2, 256, urls.MOST]
    twice = urls.judge(pages.unionAll(pages).withColumnRenamed("key", "bits"), listed)
    assert twice.count() == 2 * len(cases) and {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in twice.collect()} == got
    own = urls.junk_list(spark.createDataFrame([("http://m.Free-Bets.example.com/a/",), ("http://free-bets2.com/a",), (None,)], "url string"))
    assert [r.listed for r in own.collect()] == ["free-bets.example.com/a"]
    assert urls.judge(pages.limit(0), listed).count() == 0 and urls.judge(pages, listed.limit(0)).where("listed").count() == 0
