"""Filters, media columns and WARC records."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import decontaminate, media_png, queries, secrets, toxicity, warc_revisit

WORDS = [a + b for a in "ka lo mi nu pe ra so ti".split() for b in "dan fer gol hin jun".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, score int, spans string")


# Decontamination

def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"{w}{k}" for w in WORDS for k in range(30)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 40))) + ". " + " ".join(rng.choice(vocabulary) for _ in range(4)) + ".") for k in range(60)]
    items += [(60, None), (61, "short")]
    rows = []
    for k in range(80):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 400))]
        for _ in range(k % 3):
            own = rng.choice(items[:60])[1]
            body.insert(rng.randint(0, len(body)), own.upper() if k % 2 else own.replace(" ", "\n"))
        rows.append((k, " ".join(body)))
    rows += [(None, items[3][1]), (90, None), (90, ""), (91, " ".join(x[1] for x in items[:60] if x[1]) + " " + prose(rng, 50_000))]
    found = decontaminate.find_leaks(docs_of(spark, rows), decontaminate.split_item(spark.createDataFrame(items, "item_id long, text string")))
    terms = lambda t: re.findall(r"[0-9A-Za-z]+", (t or "").lower())
    want = {(i, k) for i, t in rows for k, x in items[:60] if f" {' '.join(terms(x))} " in f" {' '.join(terms(t))} "}
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == want and (None, 3) in got


def test_search_finds_all_above_the_threshold():
    rng = random.Random(4)
    import pyarrow as pa

    questions = [" ".join(rng.choice(WORDS) for _ in range(15)) for _ in range(50)]
    index = decontaminate.build_index(list(range(50)), pa.array(questions), pa.array([""] * 50), 3, 0.2)
    text = pa.array([" ".join(rng.choice(WORDS) for _ in range(n)) for n in (0, 5, 100, 333)])
    hashed = decontaminate._terms(text)
    h, first = np.concatenate(hashed), np.concatenate([[0], np.cumsum([len(x) for x in hashed])])
    got = {(t, a, b, i): s for t, a, b, i, s in decontaminate.search(index, h, first, 0.4)}
    want = {}
    for t in range(4):
        for a in range(0, len(hashed[t]), index.longest):
            b = min(a + 2 * index.longest, len(hashed[t]))
            have = set(index.terms.find(hashed[t][a:b]))
            for i in range(50):
                lo = [(k, w) for k in range(len(index.rare)) for j, w in zip(index.post[index.post_from[k] : index.post_from[k + 1]], index.post_weight[index.post_from[k] : index.post_from[k + 1]]) if j == i and k in have]
                s = sum(w for _, w in lo)
                if s >= 0.4:
                    want[t, int(first[t] + a), int(first[t] + b), i] = s
    assert set(want) <= set(got) and all(got[k] == pytest.approx(s) for k, s in want.items())
    # Beyond the full passages there are only those that end a text.
    assert {k for k in got if k not in want} == set()


def test_wand_equals_scoring_every_item():
    import pyarrow as pa

    rng = random.Random(8)
    vocabulary = [f"{w}{k}" for w in WORDS for k in range(6)]
    pick = lambda n: " ".join(rng.choice(vocabulary if rng.random() < 0.7 else vocabulary[:12]) for _ in range(n))
    questions = [pick(rng.randint(6, 25)) for _ in range(130)]
    questions += questions[:5]  # ties
    index = decontaminate.build_index(list(range(135)), pa.array(questions), pa.array([None] * 135, pa.string()), 3, 0.2)
    assert 0 < index.rare.sum() < len(index.rare)
    texts = [pick(rng.randint(0, 120)) + " " + rng.choice(questions) + " " + pick(9) for _ in range(60)] + ["", None, questions[7]]
    hashed = decontaminate._terms(pa.array(texts))
    h, first = np.concatenate(hashed), np.concatenate([[0], np.cumsum([len(x) for x in hashed])])
    weights = np.zeros((len(index.rare), 135))
    for k in range(len(index.rare)):
        a, b = index.post_from[k : k + 2]
        weights[k, index.post[a:b]] = index.post_weight[a:b]
    for threshold in (0.45, 0.6, 0.9):
        got = {(t, a, b, i): s for t, a, b, i, s in decontaminate.search(index, h, first, threshold)}
        want = {}
        for t in range(len(texts)):
            for a in range(0, len(hashed[t]), index.longest):
                b = min(a + 2 * index.longest, len(hashed[t]))
                have = np.unique(index.terms.find(hashed[t][a:b]))
                score = weights[have[have >= 0]].sum(axis=0)
                want |= {(t, int(first[t] + a), int(first[t] + b), int(i)): score[i] for i in np.flatnonzero(score >= threshold)}
        assert set(got) == set(want) and all(got[k] == pytest.approx(s) for k, s in want.items()) and want


def test_pivots_skip_most_items():
    import pyarrow as pa

    rng = random.Random(8)
    vocabulary = [f"{w}{k}" for w in WORDS for k in range(99)]
    questions = [" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(400)]
    index = decontaminate.build_index(list(range(400)), pa.array(questions), pa.array([""] * 400), 3, 0.2)
    passage = np.unique(index.terms.find(decontaminate._terms(pa.array([f"{questions[9]} {questions[300]}"]))[0]))
    scored = [i for _, items in decontaminate.wand(index, np.zeros(len(passage), np.int64), passage, 0.6) for i in items.tolist()]
    assert scored == [9, 300]


def test_short_items_are_found_as_phrases(spark):
    items = spark.createDataFrame([(1, "Alpha beta."), (2, "日本語の文"), (3, "beta"), (4, "..."), (5, "ALPHA  beta"), (6, "a b c d e")], "item_id long, text string")
    rows = [(1, "x alpha\nBETA y alpha-beta"), (2, "alpha x beta"), (3, "日本語の文"), (4, "日本語"), (5, "a b c d"), (6, "e"), (7, "a b c d e f a b c d e"), (8, None), (9, "... alpha"), (9, "beta")]
    found = decontaminate.find_leaks(docs_of(spark, rows), decontaminate.split_item(items)).collect()
    got = sorted((r["doc_id"], r["item_id"], r["passages"]) for r in found)
    assert got == [(1, 1, 2), (1, 3, 2), (1, 5, 2), (2, 3, 1), (3, 2, 1), (7, 6, 2), (9, 3, 1)]


def test_indexes_in_slices_find_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(15))) for k in range(20)]
    docs = docs_of(spark, [(k, prose(rng, 30) + " " + items[k % 20][1]) for k in range(30)])
    listed = decontaminate.split_item(spark.createDataFrame(items, "item_id long, text string"))
    once = sorted(tuple(r)[:2] for r in decontaminate.find_leaks(docs, listed).collect())
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 6)
    assert sorted(tuple(r)[:2] for r in decontaminate.find_leaks(docs, listed).collect()) == once and len(once) == 30


def test_no_items_or_documents(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs_of(spark, [(1, "a b c")]), decontaminate.split_item(items)).count() == 0
    some = decontaminate.split_item(spark.createDataFrame([(1, "a b c d e f g. h i")], "item_id long, text string"))
    assert decontaminate.find_leaks(docs_of(spark, []), some).count() == 0


# Secrets

def test_random_strings_are_added_and_words_are_not(spark):
    rng = random.Random(2)
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    token = lambda n, a=digits: "".join(rng.choice(a) for _ in range(n))
    planted = {k: token(rng.choice([40, 64])) for k in range(30)}
    rows = [(k, f"{prose(rng, 30)} {planted.get(k, '')} {prose(rng, 10)}") for k in range(200)]
    long_word = "".join(rng.choice(WORDS) for _ in range(9))
    rows += [(300, long_word), (301, "=" * 60), (302, 'Secret = "' + token(20) + '"'), (303, "x AKIA" + token(16, "ABCDEF0123456789")), (304, token(40, "0123456789abcdef")), (305, None), (306, ""), (None, "token: short")]
    out = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs_of(spark, rows)).collect()}
    text = dict(rows)
    hit = sum(any(text[k][s["start"] : s["end"]] == v for s in out[k]) for k, v in planted.items())
    assert hit >= 27 and not any(out[k] for k in range(30, 200)) and out[300] == out[301] == out[305] == out[306] == out[None] == []
    assert [s["kind"] for k in (302, 303, 304) for s in out[k] if s["kind"] < 3] == [0, 1, 2]
    assert [s["kind"] for s in out[304]] == [2, 3]  # the pattern's match is confirmed


def brute_base(text):
    """The contract's spans, match by match and without any shortcut."""
    patterns = [
        (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), k, m.end()) for k, (p, good) in enumerate(patterns) for m in re.finditer(p, text, re.ASCII) if good(m)]
    return sorted(found)


def test_registered_secret_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    bits = ['password', ' = "', "token", "API_KEY", "apikey:", "'", "AKIA", "é", "\n", " ", ":", "=", "ſecret=", "abcdef0123456789", "ABCDEFGH12345678", "-._+/=", "Kelvin", "x" * 9, "0" * 33, "\u212a"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", "token=" + "a1" * 200_000 + " AKIA" + "Z" * 12]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7])]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_secrets(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    text = dict(rows)
    for r in got:
        want = brute_base(text[r["doc_id"]] or "")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in want) for x in range(3)]
        plain = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == [x for x in plain.split(",") if x]


def test_battery_against_random_strings_and_text():
    rng = random.Random(0)
    assert secrets.battery("a" * 40)[0] < 1e-6 and secrets.battery("ab" * 30)[0] < 1e-6
    random_ = [secrets.battery("".join(rng.choice("0123456789abcdef") for _ in range(64)))[0] for _ in range(300)]
    assert sum(p < 0.05 for p in random_) < 40
    place = {c: k for k, c in enumerate(secrets.LETTERS)}
    words = "".join(rng.choice(WORDS) for _ in range(20_000))
    pairs = np.zeros((secrets._SIDE, secrets._SIDE))
    np.add.at(pairs, ([place[c] for c in words[:-1]], [place[c] for c in words[1:]]), 1)
    nulls = secrets.text_nulls(pairs)
    against = lambda t: secrets.battery(t, nulls)[1]
    starts = [rng.randrange(len(words) - 64) for _ in range(2000)]
    assert sum(against(words[a : a + 40]) > 4 for a in starts) <= 4  # p-values of text are small as seldom as they should be
    digits = secrets.LETTERS[:62]
    short, long = ([against("".join(rng.choice(digits) for _ in range(n))) for _ in range(200)] for n in (24, 64))
    assert np.median(short) > 1.5 and np.median(long) > 2 * np.median(short) - 1  # sharper with length


def test_pairs_of_equal_letters_have_the_moments_of_the_formula():
    rng = np.random.default_rng(1)
    single = np.array([0.5, 0.3, 0.2])
    null = secrets.Null.of(single, np.outer(single, single))
    z = [secrets._deviations(secrets.statistics(rng.choice(3, 40, p=single), 3), 40, null) for _ in range(4000)]
    assert np.abs(np.mean(z, axis=0)).max() < 0.1 and np.abs(np.std(z, axis=0) - 1).max() < 0.15


def test_no_texts_have_no_secrets(spark):
    assert secrets.find_secrets(docs_of(spark, [])).count() == 0


def test_benjamini_hochberg_threshold():
    assert secrets._threshold([(0, 1000)], 0.01) == np.inf
    assert secrets._threshold([(0, 990), (200, 10)], 0.01) == pytest.approx(10.0)


# Toxicity

@pytest.mark.parametrize("stretch", [1, 2, 5, 64])
def test_stretches_of_long_chains_give_the_same_marginals(monkeypatch, stretch):
    rng = np.random.default_rng(5)
    first = np.concatenate([[0], np.cumsum([0, 1, 7, 64, 0, 65, 200, 5])])
    emission, t = rng.normal(0, 3, first[-1]), rng.normal(0, 2, (2, 2))
    monkeypatch.setattr(toxicity, "STRETCH", 1 << 20)
    want = toxicity.Chain(first).run(emission, t)
    monkeypatch.setattr(toxicity, "STRETCH", stretch)
    got = toxicity.Chain(first).run(emission, t)
    assert np.allclose(got, want, atol=1e-9) and toxicity.Chain(np.zeros(1, np.int64)).run(np.zeros(0), t)[0].shape == (0,)
    # Against all paths of a short chain.
    a, b = first[2:4]
    own = emission[a:b]
    odds = (want[0] + want[1])[a:b]
    score = {s: sum(own[k] * x for k, x in enumerate(s)) + sum(t[x, y] for x, y in zip(s, s[1:])) for s in itertools.product((0, 1), repeat=len(own))}
    for k in range(len(own)):
        on, off = (np.logaddexp.reduce([v for s, v in score.items() if s[k] == x]) for x in (1, 0))
        assert odds[k] == pytest.approx(on - off)


def test_a_very_long_text_is_scored_whole(spark):
    from tessel.llm.textbytes import word_hashes

    data = np.frombuffer(b"zarg", np.uint8)
    model = toxicity.Model(word_hashes(data, np.array([0]), np.array([4])), np.array([9.0]), -4.0, np.zeros((2, 2)), np.array([-3.0, 0, 0, 2.0, 0, 0]))
    text = "word " * 700_000 + "zarg zarg " + "word " * 10
    got = toxicity.score(docs_of(spark, [(1, text), (2, "word")]), model).collect()
    spans = next(r["spans"] for r in got if r["doc_id"] == 1)
    assert [(s["start"], s["end"]) for s in spans] == [(3_500_000, 3_500_009)]


def brute_marginals(emission, t):
    """All paths of a short chain."""
    import itertools

    n = len(emission)
    total, ones = 0.0, np.zeros(n)
    for path in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(emission[i] * y for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        total += w
        ones += w * np.array(path)
    return ones / total


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    first = np.array([0, 5, 5, 6, 13])
    emission, t = rng.normal(size=13), rng.normal(size=(2, 2))
    f, b = toxicity.Chain(first).run(emission, t)
    want = np.concatenate([brute_marginals(emission[a:z], t) for a, z in zip(first, first[1:]) if z > a])
    assert np.allclose(1 / (1 + np.exp(-(f + b))), want)


def test_toxic_texts_are_found(spark):
    rng = random.Random(6)
    bad = ["zarg", "plonk", "wurx"]
    rows = []
    for k in range(600):
        words = prose(rng, rng.randint(20, 120)).split()
        if k % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
    labels = spark.createDataFrame([(k, int(k % 4 == 0), None) for k in range(600)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    extra = [(700, None), (701, ""), (702, "You ZARG! " + "é" * 3), (None, "x"), (702, "You ZARG! " + "é" * 3)]
    docs = docs_of(spark, rows + extra)
    model = toxicity.train(docs, labels)
    out = [(r["doc_id"], r["score"], r["spans"]) for r in toxicity.score(docs, model).collect()]
    held = [(i, s) for i, s, _ in out if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.5) == (i % 4 == 0) for i, s in held]) > 0.95
    assert {s for i, s, _ in out if i in (700, 701)} == {next(s for i, s, _ in out if i == 700)}
    spans = [x for i, _, x in out if i == 702]
    assert spans[0] == spans[1] and [(x["start"], x["end"]) for x in spans[0]] == [(4, 8)]
    assert all(0 <= s <= 1 for _, s, _ in out)
    kept = toxicity.annotate(docs, model, score="score", spans="spans")
    assert kept.count() == docs.count() and dict(kept.dtypes)["score"] == "double"


def test_texts_for_training_are_bounded_in_bytes(spark, monkeypatch):
    rows = [(k, "word " * (10_000 if k == 3 else 40)) for k in range(40)]
    labels = spark.createDataFrame([(k, int(k % 2)) for k, _ in rows], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y, weight: seen.append((texts, y, weight)))
    toxicity.train(docs_of(spark, rows), labels)
    toxicity.train(docs_of(spark, rows), labels, max_bytes=2_000)
    (whole, _, _), (texts, y, weight) = seen
    assert len(whole) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(40))
    assert len(texts) == 10 and sum(len(t.as_py()) for t in texts) == 2_000 and sorted(y) == [0.0] * 5 + [1.0] * 5
    assert weight.sum() == pytest.approx(len(whole))


def test_no_labels_and_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of(spark, [(1, "a b")])
    model = toxicity.train(docs, labels)
    assert [r["score"] < 0.5 for r in toxicity.score(docs, model).collect()] == [True]
    assert toxicity.score(docs_of(spark, []), model).count() == 0


# Media

def filtered(rows, kinds, bpp):
    """Rows filtered as the specification says, sample by sample."""
    out, prior = [], bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        line = [kind]
        for x, v in enumerate(row):
            a, b, c = row[x - bpp] if x >= bpp else 0, prior[x], prior[x - bpp] if x >= bpp else 0
            guess = [0, a, b, (a + b) // 2, min((a, b, c), key=lambda z: (abs(a + b - c - z), (a, b, c).index(z)))][kind]
            line.append((v - guess) & 255)
        out.append(bytes(line))
        prior = row
    return b"".join(out)


def png_of(width, height, data, colour=2):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return media_png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")


def test_every_filter_is_taken_back():
    rng = random.Random(1)
    rows = [bytes(rng.randrange(256) for _ in range(15)) for _ in range(12)]
    kinds = [0, 4, 3, 2, 2, 1, 4, 4, 2, 3, 1, 0]
    pixels = media_png.decode(png_of(5, 12, zlib.compress(filtered(rows, kinds, 3))))
    assert pixels.tobytes() == b"".join(rows)


@pytest.mark.parametrize("harm", [lambda p: p[:-20], lambda p: p[:40] + bytes([p[40] ^ 1]) + p[41:], lambda p: b"x" + p[1:], lambda p: b""])
def test_damage_is_found(harm):
    png = media_png.encode(media_png.pixels_of(b"hello" * 100))
    with pytest.raises(media_png.PngError):
        media_png.decode(harm(png))


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def header(width=5, height=2, depth=8, colour=2, packing=0, filters=0, interlace=0):
    return chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, packing, filters, interlace))


_ROWS = zlib.compress(bytes(2 * 16))
_END, _DATA, _PALETTE = chunk(b"IEND", b""), chunk(b"IDAT", _ROWS), chunk(b"PLTE", bytes(6))


@pytest.mark.parametrize("parts", [
    [chunk(b"IHDR", bytes(12)), _DATA, _END], [chunk(b"IHDR", b""), _DATA, _END], [_DATA, header(), _END], [header(), header(), _DATA, _END],
    [header(packing=1), _DATA, _END], [header(filters=1), _DATA, _END], [header(depth=16), _DATA, _END], [header(colour=3), _PALETTE, _DATA, _END], [header(interlace=1), _DATA, _END],
    [header(width=0), _DATA, _END], [header(height=0), chunk(b"IDAT", zlib.compress(b"")), _END], [header(), chunk(b"PLTE", bytes(4)), _DATA, _END], [header(), _PALETTE, _PALETTE, _DATA, _END],
    [header(), _DATA, _PALETTE, _END], [header(colour=0), _PALETTE, chunk(b"IDAT", zlib.compress(bytes(12))), _END], [header(), chunk(b"IDAT", _ROWS[:5]), chunk(b"tEXt", b"a"), chunk(b"IDAT", _ROWS[5:]), _END],
    [header(), chunk(b"IDAT", zlib.compress(bytes(50_000_000))), _END], [header(), chunk(b"IDAT", _ROWS[:-6]), _END], [header(), chunk(b"IDAT", b"no zlib"), _END], [header(), _DATA], [header(), _END],
    [header(), chunk(b"ABCD", b""), _DATA, _END], [header(height=1 << 30, width=1 << 30), _DATA, _END],
])
def test_what_the_reader_refuses(parts):
    with pytest.raises(media_png.PngError):
        media_png.decode(media_png.SIGNATURE + b"".join(parts))


def test_a_palette_beside_true_colours_is_passed_over():
    png = media_png.SIGNATURE + header() + _PALETTE + chunk(b"IDAT", _ROWS[:9]) + chunk(b"IDAT", _ROWS[9:]) + chunk(b"tEXt", b"a") + _END
    assert media_png.decode(png).shape == (2, 5, 3)


def test_cosine_hash_equals_the_definition():
    rng = np.random.default_rng(3)
    for height, width in ((32, 32), (64, 96), (7, 64), (100, 33)):
        pixels = rng.integers(0, 256, (height, width, 3)).astype(np.uint8)

        def means(rows):
            cuts = [k * len(rows) // 32 for k in range(33)]
            return [rows[k * len(rows) // 32] if len(rows) < 32 else sum(rows[cuts[k] : cuts[k + 1]]) / (cuts[k + 1] - cuts[k]) for k in range(32)]

        grey = [np.array([sum(map(float, p)) / 3 for p in row]) for row in pixels]
        small = np.array(means(list(np.array(means(grey)).T))).T  # rows first, then columns
        low = [
            sum(small[y, x] * np.cos(np.pi * u * (2 * y + 1) / 64) * np.cos(np.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32))
            for u in range(8) for v in range(8)
        ]
        middle = np.median(low[1:])
        got = np.unpackbits(np.frombuffer(media_png.dct_hash(pixels), np.uint8))
        transposed = np.array(low).reshape(8, 8).T.reshape(-1)
        assert (got == (np.array(low) > middle)).sum() >= 63 or (got == (transposed > middle)).sum() >= 63


def test_round_trip_in_columns(spark):
    rows = [(1, None), (2, ""), (3, "aé" * 4000), (4, "x"), (4, "x"), (None, "y" * 192), (6, "".join(map(chr, range(32, 1000))) * 300)]
    out = media_png.media_columns(docs_of(spark, rows), with_payload=True).collect()
    assert len(out) == len(rows)
    for r in out:
        body = next((t or "").encode() for i, t in rows if i == r["doc_id"])
        assert r["payload"].rstrip(b" ") == body.rstrip(b" ") and len(r["payload"]) % 192 == 0 and r["n_bytes"] == len(body) and len(r["hash"]) == 8
    short = media_png.media_columns(docs_of(spark, rows)).collect()
    assert sorted(r["payload_sha256"] for r in short) == sorted(hashlib.sha256(r["payload"]).hexdigest() for r in out)
    assert media_png.media_columns(docs_of(spark, [])).count() == 0


def test_hash_is_stable_under_small_changes():
    rng = np.random.default_rng(0)
    image = np.kron(rng.integers(0, 256, (8, 8, 1)), np.ones((16, 16, 3))).astype(np.uint8)
    noisy = np.clip(image.astype(int) + rng.integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
    bits = lambda a: np.unpackbits(np.frombuffer(media_png.dct_hash(a), np.uint8))
    assert (bits(image) != bits(noisy)).sum() <= 4


# WARC

def test_canonical_urls(spark):
    rows = [("HTTP://WWW.Ex.org:80/a/?b=2&utm_source=x&a=1#top", "ex.org/a?a=1&b=2"), ("https://ex.org/a?ref=y", "ex.org/a"), ("https://ex.org", "ex.org"), (None, None), ("", "")]
    got = spark.createDataFrame(rows, "url string, want string").withColumn("got", warc_revisit.canonical_url(F.col("url"))).collect()
    assert all(r["got"] == r["want"] for r in got)


def record(i, kind, url, t, status=200, **headers):
    return (i, kind, url, t, status, {k.replace("_", "-"): v for k, v in headers.items()}, "x")


def test_revisits(spark):
    rows = [
        record("r1", "response", "http://a.org/x", 10, etag='"1"', content_length="5", cache_control="old", age="3"), record("r2", "response", "http://www.a.org/x/", 20, etag='"2"'),
        record("r3", "response", "http://a.org/x", 30, 404, etag='"2"'), record("v1", "revisit", "https://a.org/x#f", 15, 304, etag='W/"1"', cache_control="new", content_length="0"),
        record("v2", "revisit", "http://a.org/x", 20, 304, etag='"1"'), record("v3", "revisit", "http://a.org/x", 40, 304, etag='"1"'), record("v4", "revisit", "http://a.org/x", 40, 304),
        record("v5", "revisit", "http://b.org/", 40, 304, etag='"1"'), record("v6", "revisit", None, 40, 304), record("v7", "revisit", "http://a.org/x", None, 304, etag='"1"'),
        record("v8", "revisit", "http://a.org/x", 5, 304, etag='"1"'), record("v1", "revisit", "https://a.org/x#f", 15, 304, etag='W/"1"', cache_control="new", content_length="0"),
    ]
    df = spark.createDataFrame(rows, "record_id string, type string, url string, time long, status int, headers map<string,string>, canon string")
    out = warc_revisit.resolve_revisits(df).collect()
    got = {r["record_id"]: (r["resolution"], r["response_id"]) for r in out}
    assert len(out) == 9 and got == {
        "v1": ("resolved", "r1"), "v2": ("resolved", "r1"), "v3": ("validator_mismatch", None), "v4": ("unchecked", "r2"), "v5": ("no_earlier_response", None),
        "v6": ("no_url", None), "v7": ("no_earlier_response", None), "v8": ("no_earlier_response", None),
    }
    merged = next(r["headers"] for r in out if r["record_id"] == "v1")
    assert merged == {"etag": 'W/"1"', "content-length": "5", "cache-control": "new", "age": "3"}


RECORDS = "record_id string, type string, url string, time long, status int, headers map<string,string>, canon string"


def test_records_that_share_an_id_keep_their_own_headers(spark):
    rows = [record("r", "response", "http://a.org/", 10, etag='"1"', age="1"), record("r", "response", "http://a.org/", 20, etag='"2"', age="2")]
    rows += [record("v", "revisit", "http://a.org/", 15, 304, etag='"1"', via="x"), record("v", "revisit", "http://a.org/", 25, 304, etag='"2"', via="y"), record(None, "revisit", "http://a.org/", 30, 304, etag='"2"')]
    for parts in (1, 3, 7):
        out = warc_revisit.resolve_revisits(spark.createDataFrame(rows * 2, RECORDS).repartition(parts)).collect()
        got = sorted(((r["time"], r["response_time"], sorted(r["headers"].items())) for r in out), key=str)
        assert got == sorted([(15, 10, [("age", "1"), ("etag", '"1"'), ("via", "x")]), (25, 20, [("age", "2"), ("etag", '"2"'), ("via", "y")])] * 2 + [
            (30, 20, [("age", "2"), ("etag", '"2"')])] * 2, key=str) or {r["record_id"] for r in out} == {"v", None}
        assert [r["headers"].get("via") for r in sorted(out, key=lambda r: r["time"]) if r["record_id"]] == ["x", "x", "y", "y"]


def test_no_records(spark):
    assert warc_revisit.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0
    assert warc_revisit.read_records(spark.createDataFrame([], "raw string")).count() == 0


def test_reading_goes_on_behind_a_bad_record():
    good = lambda k: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {k}\r\nContent-Length: 9\r\n\r\n200\r\n\r\nab\r\n\r\n".encode()
    bad = [b"WARC/1.0\r\nContent-Length: x\r\n\r\nbody\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9999\r\n\r\nshort\r\n\r\n", b"junk WARC/ in a line\r\n\r\n", b"WARC/1.0\r\nContent-Length: 2\r\n\r\nmore than two\r\n\r\n"]
    for b in bad:
        assert [r["record_id"] for r in warc_revisit.parse_warc(good(1) + b + good(2) + good(3))] == ["1", "2", "3"]
    assert [r["record_id"] for r in warc_revisit.parse_warc(good(1) + good(2)[:-8])] == ["1"]


def test_one_url_over_many_ranges(spark):
    rows = [record(f"r{k}", "response", "http://a.org/", 10 * k, etag=f'"{k}"') for k in range(60)] + [record(f"v{k}", "revisit", "http://a.org/", 10 * k + 5, 304, etag=f'"{k}"') for k in range(0, 2000, 7)]
    out = warc_revisit.resolve_revisits(spark.createDataFrame(rows, "record_id string, type string, url string, time long, status int, headers map<string,string>, x string").repartition(5)).collect()
    for r in out:
        k = int(r["record_id"][1:])
        assert (r["resolution"], r["response_id"]) == (("resolved", f"r{k}") if k < 60 else ("validator_mismatch", None))


def test_records_round_trip(spark):
    body = F.lit("<p>\r\n\r\né</p>")
    raw = warc_revisit.write_record(F.lit("response"), F.lit("id:1"), F.lit("http://a.org/"), F.lit(100), "200 OK", [("ETag", F.lit('"1"')), ("X", F.lit(None).cast("string"))], body)
    df = spark.range(1).select(F.concat(raw, raw).alias("raw")).unionAll(spark.createDataFrame([(None,), ("junk",)], "raw string"))
    out = warc_revisit.read_records(df).collect()
    assert len(out) == 2 and out[0]["body"].decode() == "<p>\r\n\r\né</p>" and out[0]["headers"] == {"etag": '"1"'} and (out[0]["time"], out[0]["status"]) == (100, 200)
    assert list(warc_revisit.parse_warc(b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")) == []
