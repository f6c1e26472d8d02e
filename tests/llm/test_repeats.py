"""Periodic runs and passages shared between documents, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from siftwarden.llm import periodic, queries, substrings

SCHEMA = "doc_id bigint, text string, lang string, key string, runs string, h bigint, collapsed int, `a.b` int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", "r", 5, 1, 2) for i, t in rows], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def slow_runs(w, exponent=4, least=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def slow_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def nested(rng, depth):
    if not depth:
        return [rng.choice("ab") for _ in range(rng.randint(1, 4))]
    part = nested(rng, depth - 1)
    return rng.choice("abc") .split() * rng.randint(0, 2) + part * rng.randint(1, 6) + [rng.choice("abc")] * rng.randint(0, 7)


def repetitive(rng):
    base = [str(rng.randrange(rng.choice([2, 3, 50, 5000]))) for _ in range(rng.randint(1, 130))]
    out = []
    for _ in range(rng.randint(1, 4)):
        period = [str(rng.randrange(rng.choice([1, 2, 9, 900]))) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 100]))]
        times = rng.choice([3.9, 4, 4.1, 5, 9])
        n = int(len(period) * times + rng.choice([-1, 0, 1]))
        out += base[: rng.randint(0, len(base))] + [period[i % len(period)] for i in range(max(n, 0))]
    return out


def test_runs_of_all_periods():
    rng = random.Random(3)
    texts = [repetitive(rng) for _ in range(120)] + [nested(rng, rng.randint(0, 4)) for _ in range(120)]
    texts += [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 900, list("ab") * 3, list("ab") * 4, list("aab") * 4]
    texts += [[str((bin(i).count("1"))) for i in range(700)], [bin(i).count("1") % 2 for i in range(1 << 9)]]
    texts += [list(range(q)) * 4 for q in (5, 8, 9, 16, 17, 250, 256, 257)] + [(list(range(q)) * 4)[:-1] for q in (8, 9, 16, 17, 257)]
    names = {w: i for i, w in enumerate(sorted({str(w) for t in texts for w in t}))}
    codes = np.array([names[str(w)] for t in texts for w in t], np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = [(r, *run) for r, t in enumerate(texts) for run in slow_runs(t)]
    assert list(zip(*(c.tolist() for c in periodic.find_runs(codes, offsets)))) == want
    assert len({w[3] for w in want}) > 25 and max(w[3] for w in want) >= 257
    few = periodic.find_runs(codes, offsets, short=1)
    assert list(zip(*(c.tolist() for c in few))) == want
    higher = [(r, *run) for r, t in enumerate(texts) for run in slow_runs(t, 5, 9)]
    assert list(zip(*(c.tolist() for c in periodic.find_runs(codes, offsets, 5, 9)))) == higher
    with pytest.raises(ValueError):
        periodic.find_runs(codes, offsets, 3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(i, " ".join(repetitive(rng))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \t\n\x0b\x0c\r "), (None, "x " * 9), (103, "x\x1cy " * 8), (103, "x y  " * 8)]
    out += [(104, "  lead\n" * 7), (105, "one"), (105, "one"), (106, "é ü\r\n" * 12 + "ß"), (107, " ".join(map(str, range(40_000))) + " z" * 50_000)]
    return out


def test_collapse(spark, rows):
    got = periodic.collapse(make(spark, rows).repartition(3)).collect()
    want = []
    for i, t in rows:
        w = split(t)
        runs = slow_runs(w) if len(w) < 10_000 else [(40_000, 50_000, 1)]
        want.append((i, len(w), runs, " ".join(slow_collapse(w, runs))))
    have = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert periodic.collapse(make(spark, [])).count() == 0


def planted(i, w):
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[a + (j - a) % p] if j >= a else x for j, x in enumerate(w)]


def test_query(spark, rows, tmp_path):
    rng = random.Random(4)
    rows = rows[:-1] + [(200 + i, " ".join(str(rng.randrange(400)) for _ in range(rng.randint(0, 900)))) for i in range(300)]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    want, many = [], 0
    for i, t in rows:
        w = planted(i, split(t))
        runs = slow_runs(w)
        many += len(runs) > 0 and i is not None and i >= 200
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append(
            (i, len(runs), s, n, q, 1000 * n // q if n else None, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(slow_collapse(w, runs))))
        )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and many > 5
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2


def slow_cut(rows, window):
    first = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - window + 1 if i is not None else 0):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for j in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def shared_rows(rng, n):
    """Documents made of passages of a common stock, copied, edited, cut short or run on."""
    word = lambda k=3000: "w%d" % rng.randrange(k)
    stock = [[word() for _ in range(rng.choice([20, 49, 50, 51, 80, 300]))] for _ in range(25)] + [["la"] * 130, list("ab") * 90]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            part = list(rng.choice(stock))
            if rng.random() < 0.4 and len(part) > 60:
                part[rng.randrange(len(part))] = word()
            a = rng.randrange(len(part)) if rng.random() < 0.3 else 0
            w += [word() for _ in range(rng.choice([0, 0, 1, 30]))] + part[a:] + [word(4) for _ in range(rng.choice([0, 1, 20]))]
        rows.append((rng.randrange(n) - 5, rng.choice([" ", "\n", " \t"]).join(w)))
    long = [word() for _ in range(3000)]
    rows += [(n + 1, " ".join(long)), (n + 2, " ".join(long)), (n + 3, " ".join(long[100:])), (-99, " ".join(long[1000:1300]))]
    rows += [(n + 5, "la " * 5000), (n + 6, "la " * 700), (n + 7, "x " * 3 + "la " * 55)]
    rows += [(None, " ".join(stock[5] * 2)), (n + 8, None), (n + 9, ""), (n + 10, " \n"), (n + 11, "\x1c".join(long)), (None, None)]
    return rows + [(i, t) for i, t in rows[:15]] + [(n + 12 + i, t) for i, (_, t) in enumerate(rows[:15])]


@pytest.mark.parametrize("window,seed", [(50, 1), (50, 2), (7, 3), (62, 4)])
def test_cut_repeats(spark, window, seed):
    rows = shared_rows(random.Random(seed), 150)
    got = substrings.cut_repeats(make(spark, rows).repartition(5), window=window).collect()
    want = slow_cut(rows, window)
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(r[2] > 0 for r in want) > 40 and sum(r[2] == 0 for r in want) > 20


def test_cut_nothing(spark):
    assert substrings.cut_repeats(make(spark, [])).count() == 0
    got = substrings.cut_repeats(make(spark, [(1, None), (2, "a"), (None, "b " * 60)])).collect()
    assert {tuple(r) for r in got} == {(1, 0, 0, ""), (2, 1, 0, "a"), (None, 60, 0, " ".join("b" * 60))}


def test_symbols_are_cut_alike():
    """A symbol stands wherever the words that it depends on stand."""
    rng = np.random.default_rng(0)
    middle = rng.integers(0, 40, 300)
    texts = [np.concatenate([rng.integers(0, 40, k), middle, rng.integers(0, 40, 2 * k)]) for k in (0, 3, 17, 60)]
    h = substrings.words.mixed(np.concatenate(texts).astype(np.uint64) + np.uint64(9))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = substrings.recompressed(h, offsets, 5)
    inside = []
    for row, k in enumerate((0, 3, 17, 60)):
        base = offsets[row] + k
        mine = (found["row"] == row) & (found["low"] >= base) & (found["high"] <= base + 300)
        inside.append({(n, s - base, e - base) for n, s, e in zip(found["name"][mine], found["start"][mine], found["stop"][mine])})
    assert all(x == inside[1] for x in inside[1:]) and inside[0] >= inside[1] and len(inside[1]) > 40
    assert np.mean([e - s for _, s, e in inside[1]]) > 3
