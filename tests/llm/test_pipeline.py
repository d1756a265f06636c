"""The pipeline against what each stage must do to a small corpus, and the registered queries."""

import collections
import hashlib
import random
import re
import struct
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tessel.llm.queries import ORACLE_SQL, QUERIES
from test_text_operators import brute_repeats

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in "ka lo mi nu pe ra so ti".split() for b in "dan fer gol hin jun".split()]
BAD = ["zarg", "plonk", "wurx"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))
    rows, labels = [], []
    for k in range(400):
        words = prose(rng.randint(30, 90)).split()
        toxic = k % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        text = " ".join(words)
        rows.append((k, ("All rights reserved here\n" if k % 5 == 0 else "") + text))
        labels.append((k, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 4]
    item = "what did the harvester find beneath the orchard wall in spring. a rusted lantern with blue glass."
    rows += [(500, clean[0][1]), (501, clean[1][1] + " ending"), (502, prose(40) + " " + item + " " + prose(30)), (503, None), (504, ""), (499, clean[2][1]), (499, clean[2][1])]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, prose(20))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows)


def test_stages_decide_as_they_must(spark, folder):
    path, text = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, path)
        seen[name] = out.persist()
        assert name == "packing" or out.columns == docs.columns
        docs = out
    ids = lambda name: collections.Counter(r["doc_id"] for r in seen[name].collect())
    kept = {i for i in text if i >= 400 or i % 4}
    assert set(ids("toxicity")) == kept
    lines = {r["doc_id"]: r for r in seen["line_dedup"].collect()}
    assert set(lines) == kept
    for i, r in lines.items():
        want = (text[i] or "").removeprefix("All rights reserved here\n")
        assert r["text"] == want and r["n_chars"] == len(want)
    single = kept - {500, 501, 499}
    assert ids("near_dedup") == collections.Counter(single)
    assert ids("decontamination") == collections.Counter(single - {502})
    packed = seen["packing"].collect()
    assert {r["doc_id"] for r in packed} == single - {502}
    total = collections.Counter()
    for r in packed:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 1024


def test_near_copies_from_80_to_85_in_a_dense_cloud(spark):
    rng = random.Random(4)
    text = lambda words: " ".join(words)
    template = [f"{rng.choice(WORDS)}{rng.randint(0, 999)}" for _ in range(800)]

    def changed(words, n):
        words = list(words)
        for k in rng.sample(range(0, 800, 5), n):
            words[k] = f"new{rng.random()}"
        return words

    rows = []
    for k in range(100):
        start = changed(template, 5)
        rows += [text(changed(start, 6 + k % 3)), text(changed(start, 6 + k % 3))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, rows)]
    root = list(range(len(rows)))
    linked = [(a, b) for b in range(len(rows)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert {r["doc_id"] for r in got.collect()} == set(root) and 50 < len(set(root)) < 150


def test_run_gives_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


COLUMNS = {
    "op1": "doc_id n_bytes n_removed n_spans kept_sha256", "op2": "doc_id size text_crc32 law shard slot grown_shard",
    "op3": "doc_id piece start length ids_crc32 sequence_id offset", "op6": "doc_id n_lines n_dropped kept_sha256",
    "op7": "doc_id n_assign n_access n_hex base_sha256 spans", "op8": "doc_id n_shingles component_id kept", "op9": "doc_id held_out score predicted",
    "op10": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
}


def test_ten_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.fixture(scope="module")
def sf_rows():
    table = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'")
    return table.fetchall()


def test_registered_repeats_equal_brute_force(spark, sf_rows):
    got = QUERIES["op1_suffix_dedup"](spark, SF).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_repeats(sf_rows, 400) and any(r["n_removed"] for r in got)


def test_registered_shards_obey_the_law(spark, sf_rows):
    got = {r["doc_id"]: r for r in QUERIES["op2_sharding"](spark, SF).collect()}
    size = collections.Counter()
    for i, t in sf_rows:
        body = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(body) + 1, zlib.crc32(body), "bytes", None)
        size[got[i]["shard"]] += len(body) + 1
    share, most = sum(size.values()) / 16, max(r["size"] for r in got.values())
    assert all(abs(size[s] - share) <= most + 1 for s in range(16))
    slots = collections.defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_registered_packing_equals_the_tokenizer(spark, sf_rows):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows, bins = collections.defaultdict(dict), collections.defaultdict(list)
    for r in QUERIES["op3_packing"](spark, SF).collect():
        rows[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, t in sf_rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want = [(k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert [(k, r["start"], r["length"], r["ids_crc32"]) for k, r in sorted(rows[i].items())] == want
        total += len(ids)
    for b in bins.values():
        b.sort()
        assert [x for x, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024
    assert len(bins) <= total / 1024 * 1.02 + 1


def test_registered_near_copies_equal_brute_force(spark, sf_rows):
    got = QUERIES["op8_near_dedup"](spark, SF).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(i, " ".join(re.findall("[^\\x20\\x09-\\x0D]+", (t or "").translate(lower)))) for i, t in sf_rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (t.split(" ") if t else [] for _, t in words)]
    root = {i: i for i, _ in words}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(words):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((top(i), top(words[b][0])))
                root[y] = x
    assert sorted(tuple(r) for r in got) == sorted((i, len(sets[k]), top(i), top(i) == i) for k, (i, _) in enumerate(words))


def test_registered_toxicity_and_media_columns(spark, sf_rows):
    for r in QUERIES["op9_toxicity"](spark, SF).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    got = {r["doc_id"]: r for r in QUERIES["op10_media_png"](spark, SF).collect()}
    for i, t in sf_rows:
        body = (t or "").encode()
        payload = body + b" " * (max(192, -(-len(body) // 192) * 192) - len(body))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_pipeline_of_empty_tables(spark, tmp_path):
    kinds = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_over_its_whole_table(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert set(COLUMNS.get(name.split("_")[0], "").split()) <= set(df.columns)
    if name.split("_")[0] in ("op1", "op2", "op6", "op7", "op8", "op9", "op10"):
        assert sorted(r["doc_id"] for r in rows) == list(range(200))
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(ORACLE_SQL[name])
        at = [want.columns.index(c) for c in df.columns]
        assert sorted(map(str, (tuple(r) for r in rows))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
