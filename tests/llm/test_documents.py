"""Operators on documents, against brute force on small tables with odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftwarden.llm import exact, importance, langid, mixing, near, packing, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, row string, label string, h bigint, bucket int, good int, `my col-x` int, `a.b` int, hash int"
EN = "the of and to in is that for with this was from".split()
DE = "der die und das nicht mit ist auf ein für über straße".split()
RU = "это как для что его она они был при или".split()


def make(spark, rows):
    """Documents of (doc_id, text, lang) with further columns named as operators name theirs."""
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), 7, "r", "l", 5, 3, 1, 2, 3, 4) for i, t, g in rows], SCHEMA)


def prose(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "en", "ing", "lich"]) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    base = prose(rng, EN, 60)
    rows = [(i, prose(rng, EN if i % 2 else DE, 30 + i), "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, base, "en"), (101, base, "en"), (102, base + " one more", "en"), (103, base.replace(" ", "\t\n"), "en")]
    rows += [(104, None, "en"), (105, "", None), (106, " \n\t ", "de"), (107, "12 34 ..!", "en"), (108, "der", "de")]
    rows += [(109, prose(rng, DE, 30_000), "de"), (110, base, "en"), (110, base, "en"), (None, base, "en"), (None, None, None)]
    return rows + [(111, "ein sehr kurz", None), (112, "ein sehr kurz", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, odd_rows()).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_duplicates(docs, none):
    rows = odd_rows()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t, _ in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids)
        want[(i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    for digest in (exact.sha256, lambda c: exact.F.substring(c, 1, 3).cast("binary")):
        got = exact.duplicates(docs, digest=digest).collect()
        if digest is exact.sha256:
            assert Counter(tuple(r) for r in got) == want
        # A digest that many texts share changes nothing but itself.
        assert Counter(tuple(r)[:4] for r in got) == Counter(k[:4] for k in want.elements())
    assert exact.duplicates(none).count() == 0


def test_distinct_rows(docs, none):
    got = exact.distinct_rows(docs).collect()
    assert exact.distinct_rows(docs).columns == docs.columns
    assert Counter(norm(r.text) for r in got) == Counter({norm(t) for _, t, _ in odd_rows()})
    by = {norm(r.text): r.doc_id for r in got}
    assert by[norm(odd_rows()[40][1])] == 100 and by[""] == 104 and by["ein sehr kurz"] == 111
    texts = {t for _, t, _ in odd_rows()}
    assert all(r.text in texts for r in got)
    assert exact.distinct_rows(none).count() == 0


def test_shuffle(spark, docs, none):
    first = sharding.external_shuffle(docs, 3, seed=4, bucket_bytes=2000)
    assert first.columns == ["row", "shard", "slot"] and first.select("row.*").columns == docs.columns
    got = first.collect()
    assert Counter((r.row.doc_id, r.row.text) for r in got) == Counter((i, t) for i, t, _ in odd_rows())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == {0, 1, 2}
    again = sharding.external_shuffle(docs.repartition(2), 3, seed=4, bucket_bytes=2000).collect()
    assert {(r.row.doc_id, r.row.text, r.shard, r.slot) for r in again} == {(r.row.doc_id, r.row.text, r.shard, r.slot) for r in got}
    other = sharding.external_shuffle(docs, 3, seed=5, bucket_bytes=2000).collect()
    assert [(r.row.doc_id, r.shard, r.slot) for r in other] != [(r.row.doc_id, r.shard, r.slot) for r in got]
    assert sharding.external_shuffle(none, 3, seed=4).count() == 0
    repeated = make(spark, [(1, "same", "en")] * 5000)
    sizes = Counter(r.shard for r in sharding.external_shuffle(repeated, 4, seed=1).collect())
    assert sizes == {0: 1250, 1: 1250, 2: 1250, 3: 1250}
    path = sharding.write_shards(first)
    assert spark.read.parquet(path).count() == len(got)


def test_language(spark, none):
    rng = random.Random(1)
    rows = [(i, prose(rng, (EN, DE, RU)[i % 3], 40), ("en", "de", "ru")[i % 3]) for i in range(300)]
    train = make(spark, rows)
    model = langid.fit_documents(train)
    assert model.labels == ["de", "en", "ru"]
    mixed = " ".join([prose(rng, EN, 30), prose(rng, RU, 25)])
    odd = [(1000, None, None), (1001, "", "en"), (1002, "12 ..", "en"), (1003, mixed, None), (1004, prose(rng, DE, 30_000), None)]
    table = make(spark, rows + odd)
    got = {r.doc_id: r.a for r in table.select("doc_id", langid.identify(table, model).alias("a")).collect()}
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == ("en", "de", "ru")[i % 3] for i in out) >= 0.98 * len(out) > 30
    for i in (1000, 1001, 1002):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].spans == []
    assert [(s.lang, s.first_word, s.last_word) for s in got[1003].spans] == [("en", 0, 29), ("ru", 30, 54)]
    assert got[1004].lang_pred == "de" and got[1004].score > 0.99
    blank = langid.fit_documents(none)
    empty = [r.a for r in train.limit(3).select(langid.identify(train, blank).alias("a")).collect()]
    assert all(a.lang_pred == "und" for a in empty)
    assert none.select(langid.identify(none, model)).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    lengths = [0, 1, 5, 7, 3, 0, 6]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(offsets[-1], 3)).astype(np.float32)
    path = langid.viterbi(scores, offsets, 0.8)

    def value(s, p):
        return sum(s[t, x] for t, x in enumerate(p)) - 0.8 * sum(a != b for a, b in zip(p, p[1:]))

    for a, b in zip(offsets, offsets[1:]):
        s = scores[a:b]
        best = max((value(s, p) for p in np.ndindex(*[3] * (b - a))), default=0) if b > a else 0
        assert value(s, path[a:b].tolist()) == pytest.approx(best, abs=1e-4)


def test_more_labels_than_a_byte_counts():
    rng = np.random.default_rng(8)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, 12)) for _ in range(200)]
    bucket, owner, script = langid.features(np.array(names, dtype=object))
    counts = np.zeros((langid.BUCKETS + len(langid.SCRIPT_NAMES), 200))
    np.add.at(counts, (bucket, owner), 50)
    np.add.at(counts, (langid.BUCKETS + script, np.arange(200)), 1000)
    model = langid.Model([f"l{k:03}" for k in range(200)], counts)
    texts = pa.array([f"{w} {w} {w}" for w in names] + [f"{names[199]} " * 4 + f"{names[3]} " * 5])
    got = langid.label_texts(texts, model, langid.SWITCH).to_pylist()
    assert [g["lang_pred"] for g in got] == [*model.labels, "l003"]
    assert [(s["lang"], s["first_word"], s["last_word"]) for s in got[200]["spans"]] == [("l199", 0, 3), ("l003", 4, 8)]


def many_labels(n, seed=8):
    """A model in which each of n made-up words is a language of its own."""
    rng = np.random.default_rng(seed)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, 12)) for _ in range(n)]
    bucket, owner, script = langid.features(np.array(names, dtype=object))
    counts = np.zeros((langid.BUCKETS + len(langid.SCRIPT_NAMES), n))
    np.add.at(counts, (bucket, owner), 50)
    np.add.at(counts, (langid.BUCKETS + script, np.arange(n)), 1000)
    return names, langid.Model([f"l{k:03}" for k in range(n)], counts)


def test_long_texts_in_runs_of_words(monkeypatch):
    names, model = many_labels(600)
    rng = np.random.default_rng(2)
    texts = [" ".join(names[k] for k in rng.integers(0, 600, n) for _ in range(rng.integers(1, 4))) for n in (900, 1, 60, 200, 0, 7)]
    texts = pa.array([*texts, None, "12", f"{names[599]} " * 3])
    whole = langid.label_texts(texts, model, langid.SWITCH).to_pylist()
    for words in (1, 2, 50, 64, 100, 333):
        monkeypatch.setattr(langid, "CELLS", 600 * words)
        assert langid.label_texts(texts, model, langid.SWITCH).to_pylist() == whole
    assert whole[-1]["lang_pred"] == "l599" and len(whole[0]["spans"]) > 300


def test_long_texts_in_bounded_memory(monkeypatch):
    import tracemalloc

    names, model = many_labels(600)
    text = pa.array([" ".join(names[k] for k in np.random.default_rng(5).integers(0, 600, 60_000))])
    monkeypatch.setattr(langid, "CELLS", 1 << 20)
    tracemalloc.start()
    got = langid.label_texts(text, model, langid.SWITCH).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20 < 60_000 * 600 * 4  # the scores of all words would be 144 MB
    assert got[0]["spans"][-1]["last_word"] == 59_999


def test_words_are_scored_in_their_scripts_languages():
    names = np.array(["hello", "привет", "ok"], dtype=object)
    counts = np.zeros((langid.BUCKETS + len(langid.SCRIPT_NAMES), 3))
    bucket, owner, script = langid.features(names)
    np.add.at(counts, (bucket, owner), 50)
    np.add.at(counts, (langid.BUCKETS + script, np.arange(3)), 1000)
    model = langid.Model(["en", "ru", "xx"], counts)
    table = langid.word_scores(names, model)
    for w, admitted in enumerate(([0, 2], [1], [0, 2])):
        barred = [k for k in range(3) if k not in admitted]
        own = [model.scores[bucket[owner == w], k].sum() for k in admitted]
        assert table[w, admitted] == pytest.approx(own, rel=1e-4)
        assert table[w, barred] == pytest.approx(min(own) - 100, rel=1e-4)


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows):
    sets = {i: grams(t) for i, t in rows}
    links, top = Counter(), {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            both = len(sets[x] & sets[y])
            if both and both >= 0.8 * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                links[x] += 1
                links[y] += 1
                a, b = sorted((root(x), root(y)))
                top[b] = a
    return {i: (root(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [256, 4])
def test_near_join(spark, block):
    rng = random.Random(9)
    base = prose(rng, EN + DE + RU, 120).split()
    rows = [(i, prose(rng, EN + DE + RU, 80)) for i in range(200, 240)]
    for i in range(40):  # near copies of one text, some of each other only
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"new{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(100, "a b"), (101, "A  b"), (102, None), (103, ""), (104, "a b c"), (105, " ".join(base * 200))]
    docs = make(spark, [(i, t, "en") for i, t in rows])
    got = {r.doc_id: (r.class_id, r.links) for r in near.join(docs, block=block).collect()}
    assert got == brute_links(rows)
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in got.values()}


def test_near_join_odd_rows(docs, none):
    got = near.join(docs).collect()
    assert len(got) == len(odd_rows()) and sum(r.doc_id is None for r in got) == 2
    by = {r.doc_id: r for r in got}
    assert by[110].class_id == 100 and by[102].class_id == 100 and by[103].copies == 5 and by[104].links == 0
    assert near.join(none).count() == 0
    assert near.keep_one(docs).where("doc_id is null").count() == 2


def test_reused_keys_keep_each_their_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    base, alone = [[" ".join(word() for _ in range(80)) for _ in range(6)] for _ in range(2)]
    near_copy = [t + " more" for t in base]
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, t) for i, t in enumerate(near_copy)] + [(10 + i, t) for i, t in enumerate(alone)]
    rows += [(0, alone[0] + " " + alone[1]), (30, base[0] + " end of it"), (31, base[1]), (31, base[1])]
    twice = " ".join(word() for _ in range(80))
    table = make(spark, [(i, t, "en") for i, t in rows + [(40, twice), (40, twice + " more")]])
    got = near.join(table).collect()
    classes = Counter((r.doc_id, r.class_id, r.links) for r in got)
    assert len(got) == len(rows) + 2 and classes[(10, 0, 2)] == 1 and classes[(10, 10, 0)] == 1 and classes[(0, 0, 0)] == 1
    assert all(classes[(10 + i, i, 1)] == classes[(10 + i, 10 + i, 0)] == 1 for i in range(2, 6)) and classes[(40, 40, 1)] == 2
    kept = Counter((r.doc_id, r.text) for r in near.keep_one(table).collect())
    want = Counter([(i, t) for i, t in enumerate(base)] + [(10 + i, t) for i, t in enumerate(alone)] + [(0, alone[0] + " " + alone[1])])
    assert Counter({k: n for k, n in kept.items() if k[0] != 40}) == want and sum(n for k, n in kept.items() if k[0] == 40) == 1


def test_bands_reach_the_recall():
    bands, rows = near.banding(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= near.MOST_HASHES


def test_importance(spark, docs, none):
    rng = random.Random(2)
    rows = [(i, prose(rng, EN, 40) if i % 3 else " ".join("#$!%"[rng.randrange(4)] * 3 for _ in range(40)), "en") for i in range(300)]
    table = make(spark, rows)
    good = table.where("doc_id % 3 <> 0 and doc_id < 150").select("doc_id")
    ratios = importance.fit(table, good, good.count())
    got = importance.resample(table, ratios, 200 / 300).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(got) == 300 and len(kept) == 200 and sum(i % 3 != 0 for i in kept) >= 195
    keys = sorted((r.sampling_key for r in got), reverse=True)
    assert {r.doc_id for r in got if r.sampling_key >= keys[199]} == kept
    odd = {r.doc_id: r for r in importance.resample(docs, ratios, 0.5).collect()}
    assert odd[104].log_ratio == odd[105].log_ratio == odd[106].log_ratio == 0
    assert importance.resample(none, ratios, 0.5).count() == 0
    assert not importance.fit(docs, good.limit(0), 0).any() or abs(importance.fit(docs, good.limit(0), 0)).max() < 1e-9


def test_kth_largest(spark):
    rng = random.Random(8)
    values = [rng.choice([1.5, -2.0, rng.random()]) for _ in range(30_000)]
    table = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 500, 15_000, 29_999, 30_000):
        assert importance.kth_largest(table, "x", k) == sorted(values, reverse=True)[k - 1]


def test_mixing(spark, docs, none):
    rng = random.Random(4)
    rows = [(i, prose(rng, (EN, DE, RU)[i % 3], 30 + i % 50), None) for i in range(300)]
    table = make(spark, rows)
    labelled = spark.createDataFrame([(i, ("en", "de", "ru")[i % 3]) for i in range(0, 300, 2)] + [(None, "en"), (5, None)], "doc_id bigint, domain string")
    weights = {"en": 0.5, "de": 0.4, "ru": 0.1}
    mixed = mixing.mix(table, labelled, weights, "en")
    got = mixed.collect()
    names = sorted(weights)
    totals = np.array([[x * r.rate * r.tokens for x in r.p] for r in got]).sum(0)
    natural = sum(r.p[names.index("en")] * r.tokens for r in got)
    assert all(abs(totals[i] - weights[d] / weights["en"] * natural) < 2e-4 * natural / 0.5 for i, d in enumerate(names))
    assert all(r.rate >= 0 for r in got) and {r.tokens for r in got if r.row.doc_id == 7} == {37}
    again = mixing.realised(mixed)
    assert again.columns == table.columns
    assert abs(again.count() - sum(r.rate for r in got)) < 40
    odd = mixing.mix(docs, labelled, weights, "en").collect()
    assert len(odd) == len(odd_rows()) and all(np.isfinite(r.rate) for r in odd)
    assert mixing.mix(none, labelled, weights, "en").count() == 0
    one = mixing.mix(docs, labelled.limit(0), weights, "en").collect()
    assert len(one) == len(odd_rows()) and all(r.p == [1.0, 0.0, 0.0] for r in one)


def test_rates_of_many_domains(spark):
    """Ninety domains, two to a document: the nonnegative rates meet the targets, so no others come closer."""
    d, rng = 90, np.random.default_rng(6)
    p = np.zeros((900, d))
    for i in range(len(p)):
        a, b = i % d, rng.integers(0, d)
        p[i, a] += 0.9
        p[i, b] += 0.1
    tokens = rng.integers(20, 60, len(p))
    table = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens bigint, p array<double>")
    reached = tokens @ p
    targets = reached * rng.uniform(0.5, 1.5, d)
    got = mixing.with_rates(table, mixing.fit_rates(table, targets)).collect()
    w = np.array([r.rate for r in got])
    totals = sum(r.rate * r.tokens * np.array(r.p) for r in got)
    assert (w >= 0).all() and np.abs(totals - targets).max() <= mixing.CLOSE * targets.sum()


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


ODD_TEXTS = [
    "it's a 'sound.\"'s İx.İ É é <|endoftext|> a<|startoftext|>'ve don't x²³ yªº ﬁ", "", "日本語 テスト 한국어 नमस्ते", "'", "ábc é",
    "x'll'd''s..''t 12a3", None, "Σας ΣΑΣ", "a\x1cb\x0bc\x00d\u0085e\u00a0f", "The THE the.", "a" * 5000, " \n ",
]


def test_ids_are_the_tokenizers(tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    ids, bounds = packing.Encoder(tokenizer).ids(pa.array(ODD_TEXTS))
    for i, text in enumerate(ODD_TEXTS):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_of_another_tokenizer():
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    ids, bounds = packing.Encoder(path).ids(pa.array(ODD_TEXTS))
    for i, text in enumerate(ODD_TEXTS):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [0]


def test_packing(spark, docs, none, tokenizer):
    from tokenizers import Tokenizer

    cut = packing.pieces(docs, tokenizer, 64, with_ids=True)
    got = packing.pack(cut, 64, group=200).collect()
    plain = Tokenizer.from_file(tokenizer)
    want = Counter()
    for i, t, _ in odd_rows():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = ids[k : k + 64]
            want[(i, k // 64, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * -(-sum(r.length for r in got) // 64) + 3
    rows = packing.sequences(spark.createDataFrame(got, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, sequence_id bigint, offset bigint")).collect()
    assert len(rows) == len(bins) and all(len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack_documents(none, tokenizer).count() == 0


def test_search_leaves_what_cannot_combine():
    rng = random.Random(5)
    lengths = [rng.randrange(1025, 2040) for _ in range(5000)]
    start, took = packing.best_fit(lengths, 2048), time.process_time()
    assert packing.improve([list(b) for b in start], lengths, 2048) == start and len(start) == 5000
    assert time.process_time() - took < 5


def test_search_empties_bins():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.randrange(20, 60) for _ in range(120)]
        start = [[i] for i in range(120)]  # a bin each
        out = packing.improve([list(b) for b in start], lengths, 100)
        assert sorted(i for b in out for i in b) == list(range(120))
        assert all(sum(lengths[i] for i in b) <= 100 for b in out)
        assert len(out) <= 1.15 * -(-sum(lengths) // 100) + 1
        fitted = packing.best_fit(lengths, 100)
        improved = packing.improve([list(b) for b in fitted], lengths, 100)
        assert len(improved) <= len(fitted)
