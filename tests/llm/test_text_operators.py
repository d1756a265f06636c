"""Deduplication, sharding and packing against brute-force versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessel.llm import graph, line_dedup, near_dedup, packing, sharding, suffix_dedup
from tessel.llm.suffix_array import suffix_array

SCHEMA = "doc_id long, text string, kept string, size string, __row string, offset int"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sigma tau ups".split()


def table(spark, rows):
    """Rows (doc_id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(8)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(8):  # near copies, with one or two words changed
        words = base[k % 3].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((20 + k, " ".join(words)))
    rows += [(40, base[0]), (41, base[0]), (42, None), (43, ""), (44, "  \n "), (45, "One"), (46, "one"), (47, "é" * 500), (48, prose(rng, 30_000)), (None, base[4]), (5, base[5])]
    rows += [(60 + k, f"head {k}\n  Shared LINE \ntail {k}\n") for k in range(12)]
    return rows


def test_suffix_array_of_small_texts():
    @given(st.lists(st.integers(1, 3), max_size=24))
    def check(symbols):
        text = [*symbols, 0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])

    check()


def brute_repeats(rows, length):
    seen = collections.Counter()
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bodies:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_equals_brute_force(spark, corpus):
    rows = [(i, t if t is None or len(t) < 20_000 else t[:20_000]) for i, t in corpus] + [(70, "ab" * 400), (71, "xab" * 200)]
    got = suffix_dedup.remove_repeats(table(spark, rows), 100).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in got), key=str) == brute_repeats(rows, 100)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_suffix_dedup_at_the_registered_length(spark):
    rng = random.Random(21)
    base = [prose(rng, 300) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)] + [(10 + k, prose(rng, 20) + base[k][100 : 499 + k] + prose(rng, 20)) for k in range(4)]  # 399 bytes don't match
    rows += [(20, base[5]), (21, base[5]), (22, "é" * 900), (23, "ab" * 700), (24, base[0][:700] + base[1][:700] + base[0][300:1100]), (25, None), (26, base[2][: 1 << 9])]
    got = suffix_dedup.remove_repeats(table(spark, rows), 400).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in got), key=str) == brute_repeats(rows, 400)


def test_shorter_passages_are_reported_and_stay(spark):
    rng = random.Random(23)
    base = [prose(rng, 200) for _ in range(9)]
    rows = list(enumerate(base)) + [(20 + k, prose(rng, 20) + base[k][100 : 100 + n] + prose(rng, 20)) for k, n in enumerate([249, 250, 300, 399, 400, 700])]
    rows += [(30, base[7][:300] + prose(rng, 9) + base[8][:300] + base[6][:500]), (31, base[7][50:330]), (32, None), (33, base[3][100:360]), (34, prose(rng, 100))]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(table(spark, rows), 400, with_kept=False, report=250).collect()}
    long, short = ({r[0]: r for r in brute_repeats(rows, n)} for n in (400, 250))
    for i, _ in rows:
        assert (got[i]["n_bytes"], got[i]["n_removed"], len(got[i]["removed"]), got[i]["kept_sha256"]) == long[i][1:]
        assert got[i]["n_passages"] == (long[i][3] or short[i][3])
    assert any(short[i][3] and not long[i][3] for i, _ in rows)


def test_anchors_of_very_long_texts_are_those_of_the_whole(monkeypatch):
    rng = random.Random(2)
    data = np.frombuffer((prose(rng, 900) + "a" * 3000 + prose(rng, 900)).encode(), np.uint8)
    whole = suffix_dedup.window_anchors(data, 400)[0]
    monkeypatch.setattr(suffix_dedup, "PLACE_BITS", 12)
    cut = suffix_dedup.window_anchors(data, 400)[0]
    # With fewer bits hashes are compared on more of theirs, so anchors may differ; equal windows still agree on theirs.
    for at in (whole, cut):
        assert len(at) == len(data) - 399 and ((at >= np.arange(len(at))) & (at <= np.arange(len(at)) + 400 - suffix_dedup.ANCHOR)).all()
        first: dict[bytes, int] = {}
        for k in range(len(at)):
            assert first.setdefault(data[k : k + 400].tobytes(), at[k] - k) == at[k] - k


def test_suffix_dedup_splits_hot_groups(spark, monkeypatch):
    rng = random.Random(5)
    passage = prose(rng, 40)[:150]
    rows = [(k, prose(rng, 10) + passage + prose(rng, 10)) for k in range(40)]
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setenv("PYTHONHASHSEED", "0")
    got = suffix_dedup.remove_repeats(table(spark, rows), 100).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in got), key=str) == brute_repeats(rows, 100)


def test_line_dedup_equals_brute_force(spark, corpus):
    rows = corpus + [(60, "head 0\n  Shared LINE \ntail 0\n")]  # a repeated row
    docs = collections.Counter()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for _, t in rows:
        docs.update({key(x) for x in (t or "").split("\n")})
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or docs[key(x)] < 10]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.drop_frequent_lines(table(spark, rows), 10)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()), key=str) == sorted(want, key=str)
    assert any(w[2] for w in want) and "__row" in out.columns


def test_line_runs_add_up_over_batches(spark):
    runs = line_dedup.LineRuns(spark, 4)
    for _ in range(5):
        runs.add(spark.createDataFrame([(1, 1), (2, 2)], "h1 long, h2 long"))
    runs.add(spark.createDataFrame([(3, 3)] * 3, "h1 long, h2 long"))
    assert sorted(r["h1"] for r in runs.finish().collect()) == [1, 2]


def test_line_runs_are_merged_without_an_exchange(spark):
    runs = line_dedup.LineRuns(spark, 4)
    runs.add(spark.range(50).selectExpr("id h1", "id h2"))
    a = runs.levels[0]
    plan = a.hint("merge").join(a.withColumnRenamed("docs", "more"), ["h1", "h2"], "full")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_line_dedup_of_one_very_long_text(spark):
    n = 200_000  # quadratic steps would take minutes
    rows = [(1, "\n".join(f"Line {k % 90_000}" for k in range(n)))] + [(k, "\n".join(f" line {i * 7}" for i in range(9_000)) + f"\n{k}") for k in range(2, 13)]
    rows.append((20, "only\n\nline 14"))
    gone = {f"line {i * 7}" for i in range(9_000)}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.drop_frequent_lines(table(spark, rows)).collect()}
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if x.strip().lower() not in gone]
        assert got[i] == (len(lines), len(lines) - len(kept), "\n".join(kept))


def brute_components(rows, percent):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[root(k)].append(i)
    return sorted(((i, len(sets[k]), min((x for x in groups[root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)), key=str)


def test_near_dedup_equals_brute_force(spark, corpus):
    got = near_dedup.link_near_copies(table(spark, corpus), 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(corpus, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_of_many_near_copies_of_one_text(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 200).split()
    rows = []
    for k in range(300):  # alike to the first text, less so to each other
        words = list(base)
        for _ in range(2 if k else 0):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(near_dedup, "REGION", 16)
    got = near_dedup.link_near_copies(table(spark, rows), 85).collect()
    want = brute_components(rows, 85)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)


def cloud(own, base, pairs=100):
    """Pairs of texts that differ in up to ``2 * own`` of 800 words, from one template; texts of two pairs differ in up to ``2 * base`` more."""
    rng = random.Random(17)
    template = prose(rng, 800).split()

    def changed(words, n):
        words = list(words)
        for k in rng.sample(range(0, 800, 5), n):
            words[k] = f"new{rng.random()}"
        return words

    rows = []
    for _ in range(pairs):
        start = changed(template, base)
        rows += [" ".join(changed(start, own)), " ".join(changed(start, own))]
    return list(enumerate(rows))


def test_near_dedup_of_pairs_in_a_dense_cloud(spark):
    rows = cloud(6, 2)
    got = near_dedup.link_near_copies(table(spark, rows), 85).collect()
    want = brute_components(rows, 85)
    assert 60 < len({c for _, _, c in want}) < 100
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(want)


def written(monkeypatch):
    """Gets the label of each table that is written to find components or roots."""
    labels = []
    for module in (graph, near_dedup):
        monkeypatch.setattr(module, "stage", lambda df, label, *by, real=module.stage: labels.append(label) or real(df, label, *by))
    return labels


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_take_few_rounds(spark, monkeypatch, shape):
    rng = random.Random(21)
    ids = [rng.randbytes(16) for _ in range(400)]
    pairs = {"chain": list(zip(ids, ids[1:])), "star": [(ids[0], x) for x in ids], "random": [tuple(rng.choices(ids, k=2)) for _ in range(300)]}[shape]
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for x in sorted(near):  # each least node first
        todo = [x] if x not in want else []
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    monkeypatch.setattr(graph, "EDGES", 32)  # as if the edges came in many parts
    labels = written(monkeypatch)
    got = sorted((bytes(r["node"]), bytes(r["root"])) for r in graph.components(spark.createDataFrame(pairs, "a binary, b binary").repartition(5)).collect())
    assert got == sorted((x, r) for x, r in want.items() if x != r)
    assert len(labels) <= 4


def test_later_links_go_through_roots_only(spark, monkeypatch):
    """A pass with 211 partitions takes seconds however few rows it has: found components are not worked out anew."""
    monkeypatch.setattr(near_dedup, "REGION", 16)
    labels = written(monkeypatch)
    rows = cloud(6, 2)
    got = near_dedup.link_near_copies(table(spark, rows), 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_components(rows, 85))
    assert labels.count("edges") <= 5


@pytest.mark.parametrize("percent", [10, 30, 50, 80, 82, 85, 95, 100])
def test_trees_follow_the_threshold(percent):
    trees, depth = near_dedup.shape(percent)
    assert trees * depth <= near_dedup.TREES * near_dedup.DEPTH and (1 - (percent / 100) ** depth) ** trees <= 2e-5


def test_what_sketches_and_first_rounds_drop_is_compared_with_its_text(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "far", lambda percent: -1)  # no centre or neighbour is near
    words = prose(random.Random(6), 200).split()
    rows = [(k, " ".join([*words[:-1], f"last{k}"])) for k in range(6)]
    assert {r["component_id"] for r in near_dedup.link_near_copies(table(spark, rows), 85).collect()} == {0}


def test_large_regions_keep_all_their_nodes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 4)
    common = b"".join(bytes([k] * 4) for k in range(4))
    nodes = [(bytes([k]), 9, 0, 0, 0, 0, [common + bytes([k] * 16)]) for k in range(20)]  # alone from the fifth value on
    nodes = spark.createDataFrame(nodes, "fp binary, n long, s0 long, s1 long, s2 long, s3 long, labels array<binary>")
    assert sorted(bytes(r["fp"])[0] for r in near_dedup._regions(nodes, 4).collect()) == list(range(20))


def test_neighbours_in_a_region_over_many_ranges(spark):
    rng = random.Random(13)
    nodes = [(bytes([k]), 9, 0, 0, 0, 0, [bytes(16) + bytes(rng.choices(range(4), k=16)), bytes([k % 2] * 32)]) for k in range(90)]
    schema = "fp binary, n long, s0 long, s1 long, s2 long, s3 long, labels array<binary>"
    forest = near_dedup._regions(spark.createDataFrame(nodes, schema), 4)
    got = {(bytes(r["a"])[0], bytes(r["b"])[0]) for r in near_dedup._neighbour_pairs(forest, 128, 1).collect()}
    want = set()
    for tree in (0, 1):
        order = sorted(range(90), key=lambda k: (nodes[k][6][tree], k))
        want |= {tuple(sorted(p)) for p in zip(order, order[1:]) if nodes[p[0]][6][tree][:16] == nodes[p[1]][6][tree][:16]}
    assert got == want


@pytest.mark.parametrize("shards", [4])
def test_sharding_law(spark, corpus, shards):
    rows = [(i, t) for i, t in corpus if i != 48] * 4 + [(100, "same text")] * 200
    got = sharding.histogram_shards(table(spark, rows), shards).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    most = max(len((t or "").encode()) + 1 for _, t in rows)
    assert set(size) == set(range(shards)) and max(size.values()) - min(size.values()) <= 2 * most
    for s in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_rows_go_to_the_range_of_the_found_splitters(spark):
    rng = random.Random(4)
    keys = [tuple(rng.randint(-(1 << 63), (1 << 63) - 1) for _ in range(3)) for _ in range(300)]
    keys += [(7, 7, k) for k in range(200)] + [(7, k, 0) for k in range(100)] + [(-7, -7, -7)] * 50  # hot texts, hot rows, one key for all
    sizes = [rng.randint(1, 30) for _ in keys]
    keyed = spark.createDataFrame([(*k, n) for k, n in zip(keys, sizes, strict=True)], "__k0 long, __k1 long, __k2 long, size long")
    borders = sharding.splitters(keyed, 12, 1e-4)
    whole = lambda k: sum((x % (1 << 64)) << (64 * (2 - i)) for i, x in enumerate(k))
    at = {k: sum(b <= whole(k) for b in borders) for k in keys}
    got = sharding._in_range(keyed, borders).collect()
    assert all(r["__range"] == at[r["__k0"], r["__k1"], r["__k2"]] for r in got) and len(got) == len(keys)
    share, most = sum(sizes) / 12, max(sizes)
    heavy = sum(n for k, n in zip(keys, sizes, strict=True) if k == (-7, -7, -7))  # can't be cut by any key
    for k, b in enumerate(borders, 1):
        below = sum(n for key, n in zip(keys, sizes, strict=True) if whole(key) < b)
        assert abs(below - k * share) <= max(most, heavy if whole((-7, -7, -7)) < b else 0, heavy)


def test_packing(spark, corpus):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    reference = Tokenizer.from_file(path)
    rows = corpus + [(80, "a  b\n \n c <|endoftext|> d　 e"), (81, " x\t y")]
    pieces = packing.token_pieces(table(spark, rows), path, 64, with_ids=True)
    got = packing.pack(pieces, 64).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for i, t in rows:
        if i in (5, None):
            continue
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == [sum(len(p["ids"]) for p in own[:k]) for k in range(len(own))]
        assert all(r["length"] == 64 for r in own[1:]) and (len(own) == 1) == (len(ids) <= 64)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= sum(r["length"] for r in got) / 64 + 2


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 9), max_size=12), st.sampled_from(["dot", "norm"]))
def test_plan_keeps_every_capacity(stock, score):
    bins = collections.defaultdict(list)
    for length, a, b, first, m, _ in packing.plan(stock, 50, 3, 1800 if max(stock, default=0) < 42 else 2500, score=score):
        for r in range(b - a):
            bins[first + r // m].append(length)
    assert sum(map(len, bins.values())) == sum(stock.values())
    limit = 1800 if max(stock, default=0) < 42 else 2500
    assert all(sum(b) <= 50 and len(b) <= 3 and sum(x * x for x in b) <= limit for b in bins.values())


@pytest.mark.parametrize("score", ["dot", "norm"])
def test_plan_with_capacities_that_bind(score):
    rng = random.Random(11)
    lengths = [rng.choice([2, 3, 5, 8, 13, 21, 34]) for _ in range(400)]
    tokens, documents, attention = 50, 4, 1300

    def one_by_one():
        """Sequence after sequence, the best of all pieces that still fit; no histogram."""
        left, bins, cap = sorted(lengths, reverse=True), [], np.array([tokens, documents, attention])
        while left:
            residual, own = cap.copy(), []
            while True:
                fits = [n for n in dict.fromkeys(left) if n <= residual[0] and residual[1] and n * n <= residual[2]]
                if not fits:
                    break
                share = {n: np.array([n, 1, n * n]) / cap for n in fits}
                w = np.array([1.0, 0.1, 0.1])
                best = max(fits, key=lambda n: share[n] @ (w * residual / cap)) if score == "dot" else min(fits, key=lambda n: (((residual / cap - share[n]) ** 2) * w).sum())
                left.remove(best)
                own.append(best)
                residual -= np.array([best, 1, best * best])
            bins.append(own)
        return bins

    bins = collections.defaultdict(list)
    for length, a, b, first, m, _ in packing.plan(dict(collections.Counter(lengths)), tokens, documents, attention, score=score):
        for r in range(b - a):
            bins[first + r // m].append(length)
    want = one_by_one()
    assert sorted(map(sorted, bins.values())) == sorted(map(sorted, want))
    bound = max(sum(lengths) / tokens, len(lengths) / documents, sum(n * n for n in lengths) / attention)
    stock = dict(collections.Counter(lengths))
    free = [packing.plan(stock, tokens, d, a, score=score) for d, a in ((10**6, attention), (documents, 10**6))]
    fewer = [max(first + (b - a) // m for _, a, b, first, m, _ in rows) for rows in free]
    assert all(n != len(want) for n in fewer)  # documents and attention both bind
    assert bound <= len(want) <= 1.3 * bound


def test_packing_keeps_columns_of_any_name(spark):
    names = ["piece", "n", "part", "at", "own", "base", "rank", "from", "to", "first", "m", "__part"]
    pieces = spark.createDataFrame([(5 + k % 3, *[k] * len(names), "old") for k in range(30)], ", ".join(["length long", *(f"`{n}` int" for n in names), "offset string"]))
    got = packing.pack(pieces, 16).collect()
    assert sorted(r["rank"] for r in got) == list(range(30)) and all(r[n] == r["__part"] for r in got for n in names)
    assert all(isinstance(r["offset"], int) for r in got)


def test_other_ways_of_splitting_are_left_to_the_tokenizer(tmp_path):
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    tokenizers = pytest.importorskip("public_tokenizers")
    with open(tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        whole = json.load(f)
    assert packing._plain_bytes(whole)
    whole["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(whole))
    encoder = packing.TextEncoder(str(tmp_path / "t.json"))
    assert encoder.as_file
    assert [list(x) for x in encoder.encode(pa.array(["hello world", None]))] == [Tokenizer.from_file(str(tmp_path / "t.json")).encode("hello world", add_special_tokens=False).ids, []]


def test_empty_tables(spark):
    docs = table(spark, [])
    assert suffix_dedup.remove_repeats(docs, 100).count() == 0
    assert sharding.histogram_shards(docs, 4).count() == 0
    assert line_dedup.drop_frequent_lines(docs).count() == 0
    assert near_dedup.link_near_copies(docs).count() == 0
    pieces = spark.createDataFrame([], "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert packing.pack(pieces).count() == 0
