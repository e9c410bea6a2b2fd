"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from tabspark.llm import (binpack, components, host_rules, impact_search, language, mixing, ngram_join, packing, repair, suffix_tree, tokens,
                          toxicity)
from tabspark.llm.common import joined, modulo, roomy

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, kept string, part int, owner bigint"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    """Words with A-Z lower-cased, and no other letters."""
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in words(text)]


def _texts():
    rng = np.random.default_rng(3)
    made = lambda n, seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 4000, n))
    base = made(200, 1).split()
    near = []
    for i in range(40):  # near copies of one text, in lists longer than the short ones
        copy = list(base)
        copy[int(rng.integers(0, 200))] = f"x{i}"
        near.append(" ".join(copy))
    far = " ".join([*base[:120], *made(90, 2).split()])
    line = "one line that very many of these documents share in full here"
    lined = [f"{line}\n{made(4 + i, 50 + i)}" for i in range(30)]
    return [None, "", " \n\t ", "one", "One two", "one two", "a b c d", "A b c D e", line, *near, near[0], near[0], far, *lined, made(30_000, 9),
            "same line here\nsame line here\nother # $ line", "é ß x  y", "spam spam spam spam spam spam spam spam spam spam spam spam"]


@pytest.fixture(scope="module")
def rows():
    out = []
    for i, t in enumerate(_texts()):
        out.append((i, t, None if i % 11 == 3 else "en", None if i % 7 == 2 else ("hot" if i % 3 else f"s{i % 4}"), None, i, "x", 0, None))
    return [*out, out[9], out[9]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).persist()
    df.count()
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# quality rules by host

def test_host_rules(docs, rows, empty):
    got = host_rules.host_rules(docs).collect()
    assert len(got) == len(rows) and host_rules.host_rules(empty).count() == 0
    text = {r[0]: r[1] for r in rows}
    for r in got:
        w = words(text[r["row"]["doc_id"]])
        grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
        lines = [x for x in (text[r["row"]["doc_id"]] or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (
            len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum((text[r["row"]["doc_id"]] or "").count(c) for c in "#*$%&|<>")
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert {r["kept"] for r in got if r["base_failed"]} == {False}


def test_bad_host_loses_all_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good + f" {i}", "good") for i in range(40)] + [(100 + i, "spam " * 30 if i else good, "bad") for i in range(40)]
    rows += [(200, good, "lone"), (201, "spam " * 30, "alone")]  # one document says little about a host
    kept = {r["doc_id"] for r in host_rules.kept_documents(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    assert kept == set(range(40)) | {200}


# mix

def _targets(sizes, total):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target = {s: i % 3 + 1 for i, s in enumerate(names)}, {}
    free, rest = list(names), total
    while free:
        share = rest / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s], rest = 3 * sizes[s], rest - 3 * sizes[s]
            free.remove(s)
    return target


def test_mix(spark, docs, rows, empty):
    report, mixed = mixing.mix(docs, block=4)
    got = report.collect()
    assert len(got) == len(rows) and mixing.mix(empty)[0].count() == 0
    size = {r[0]: len(words(r[1])) for r in rows}
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += size[r[0]]
    want, taken = _targets(sizes, sum(sizes.values())), collections.Counter()
    of = {r[0]: r[3] for r in rows}
    for r in got:
        s = of[r["row"]["doc_id"]]
        assert r["size"] == size[r["row"]["doc_id"]] and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"]
        assert math.isclose(r["target"], want[s], rel_tol=1e-9)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 4 * 4 + 0.01 * want[s] for s in want)
    again = mixing.mix(docs.repartition(5), block=4)[0].collect()
    assert sorted((r["row"]["doc_id"], r["taken"]) for r in again) == sorted((r["row"]["doc_id"], r["taken"]) for r in got)
    assert mixed.agg(F.sum("words")).first()[0] == sum(taken.values())
    assert mixing.mixed_documents(docs).columns == docs.columns


# shards

def test_shards(docs, rows, empty):
    got = binpack.shard(docs, shards=3, grain=50).collect()
    assert len(got) == len(rows) and binpack.shard(empty).count() == 0
    text, of = {r[0]: r[1] for r in rows}, collections.defaultdict(set)
    for r in got:
        raw = (text[r["row"]["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        of[text[r["row"]["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    for s in range(3):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))


def test_even_bins():
    rng = np.random.default_rng(1)
    sizes = [min(int(x), 100_000) for x in rng.pareto(1.5, 5000) * 1000 + 10] + [3_000_000]  # one item above the mean
    load = np.bincount(binpack.even_bins(sizes, 20), weights=sizes, minlength=20)
    rest = np.sort(load)[:-1]
    assert load.max() == 3_000_000 and rest.max() <= 1.002 * rest.mean() and rest.min() >= 0.99 * rest.mean()
    assert binpack.even_bins([5, 5], 4) is not None and binpack.best_fit([4, 3, 3], 5, 2) is None


# exact ids, packing and Re-Pair files

ODD = ["", " ", "a  b", "a  \n b", "  x\n\ny  ", "don't stop. It's 3.5x!!", "の b", "ΑΣ", "<|endoftext|> hi", "é. á́ ≮", "a\x01b \x01 c", "Ünï. Éa,b é.. ",
       "x\x1cy \x1d z", "\n", "a b", "a  \n b", "　　 x", "tab\tx\r\ny", "1234 56a7", "中文 文字. a", "a b   c  \n d", None, "a'b 'll 's. 'S"]


@pytest.mark.parametrize("path, spaced", [(BYTE, True), (WORD, False)])
def test_ids_are_those_of_whole_texts(path, spaced):
    own = tokens.Encoder(path, spaced)
    texts = ODD + [t for t in _texts()[:60]]
    want = [e.ids + [2] for e in own.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = [ids[b[i]:b[i + 1]].tolist() for low, high, ids, b in own.ids(pa.array(texts), 2, at_once=40) for i in range(high - low)]
    assert got == want


def _ids(path, text):
    return tokens.encoder(path, path == BYTE).tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_packing(docs, rows, empty):
    got = packing.pack(docs, BYTE, capacity=256).collect()
    assert packing.pack(empty, BYTE).count() == 0
    want = collections.Counter()
    for r in rows:
        ids = _ids(BYTE, r[1])
        n = -(-len(ids) // 256)
        edges = [0, *(len(ids) - 256 * (n - k) for k in range(1, n + 1))]
        want.update((r[0], k, edges[k], edges[k + 1] - edges[k], zlib.crc32(np.array(ids[edges[k]:edges[k + 1]], "<u4").tobytes())) for k in range(n))
    assert collections.Counter((r["row"]["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 256
    assert len(sequences) <= 1.02 * math.ceil(sum(r["length"] for r in got) / 256) + 1


@pytest.mark.parametrize("seed, count", [(1, 40), (2, 2000), (3, 100_000)])
def test_plan(seed, count):
    rng = np.random.default_rng(seed)
    lengths, numbers = np.unique(np.minimum(rng.lognormal(6, 1.2, count).astype(int) % 1024 + 1, 1024), return_counts=True)
    histogram = dict(zip(lengths.tolist(), numbers.tolist()))
    runs = packing.plan(histogram)
    sequences = max(s + b - a for _, a, b, s, _ in runs)
    fill, used = np.zeros(sequences, int), collections.defaultdict(list)
    for length, a, b, s, _ in runs:
        fill[s:s + b - a] += length
        used[length].append((a, b))
    assert fill.max() <= 1024 and sequences <= 1.01 * math.ceil(fill.sum() / 1024) + 1
    for length, n in histogram.items():
        stretches = sorted(used[length])
        assert stretches[0][0] == 0 and stretches[-1][1] == n and all(x[1] == y[0] for x, y in zip(stretches, stretches[1:]))


def test_repair_files(spark, docs, rows, empty):
    got = sorted(tuple(r) for r in repair.token_file(docs, WORD, 49408).collect())
    assert repair.token_file(empty, WORD, 49408).count() == 0
    want, start = [], 0
    for r in sorted(rows, key=lambda r: r[0]):
        ids = _ids(WORD, r[1])
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_repair_reads_any_place():
    rng = np.random.default_rng(5)
    docs = [np.append(np.tile(rng.integers(3, 40, 6), int(rng.integers(1, 60))), 2) for _ in range(50)]
    begin = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    raw = repair.pack_block(np.concatenate(docs).astype(np.uint32), begin, 49408)
    block = repair.Block(raw)
    assert len(block.rules) and len(raw) < 2 * begin[-1]
    for k, d in enumerate(docs):
        assert block.document(k).tolist() == d.tolist()
        a, b = sorted(rng.integers(0, len(d) + 1, 2).tolist())
        assert a == b or block.document(k, a, b).tolist() == d[a:b].tolist()


# language

def test_language(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    content = language.samples(docs.where(modulo(F.col("doc_id"), 3) != 1))
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "12 34 !", "en")], "doc_id bigint, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").where(modulo(F.col("doc_id"), 3) == 1).unionByName(odd)
    got = language.identify(rows, content, keep=("doc_id", "lang")).collect()
    told = [r for r in got if r["row"]["doc_id"] >= 0]
    assert np.mean([r["lang_pred"] == r["row"]["lang"] for r in told]) > 0.93
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in got if r["row"]["doc_id"] < 0} == {("und", 0.0, True)}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.samples(empty) == {} and language.known_documents(empty).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, {}).collect()} == {"und"}


# toxicity

def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(2)
    plain = lambda: " ".join(f"w{x}" for x in rng.integers(0, 60, 8)) + "."
    rows = []
    for i in range(400):
        lines = [plain() for _ in range(5)]
        if i % 4 == 0:
            lines[i % 5] = f"you are {'vile' if i % 8 else 'nastyling'} w1 w2!"
        rows.append((i, " ".join(lines), int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.learn(table.where("doc_id % 5 <> 0"), table.where("doc_id % 5 <> 0").select("doc_id", "toxic"))
    got = toxicity.score(table, model, keep=("doc_id", "toxic")).collect()
    held = [r for r in got if r["row"]["doc_id"] % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == r["row"]["toxic"] for r in held]) > 0.97
    assert all("vile" in s or "nasty" in s for r in got for s in r["offending"]) and sum(len(r["offending"]) for r in got) >= 95
    odd = toxicity.score(docs, model).collect()
    assert all(0 <= r["score"] < 0.5 for r in odd) and toxicity.score(empty, model).count() == 0
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    ones = toxicity.learn(docs, spark.createDataFrame([(9, 1), (9, 1), (10, 1), (None, 0), (11, None)], "doc_id bigint, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, ones).collect()} == {1.0}


# search

def test_search(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(0, 300)]
    vectors += [(300, vectors[50][1]), (301, vectors[50][1]), (350, [0.5]), (351, []), (352, None), (353, [None] * 8), (354, [float("nan")] * 8),
                (355, [float("inf")] * 8), (None, [1.0] * 8), (400, [0.0] * 8), (7, vectors[7][1])]
    got = impact_search.nearest(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>"), candidates=64, queries=3).collect()
    sound = [(i, np.array([math.floor(256 * float(np.float32(x))) for x in v] + [0] * (8 - len(v)))) for i, v in vectors
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in sound:
        if q % 50 == 0:
            best = sorted(((-int(v @ w), i) for i, w in sound if i != q))[:5]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert impact_search.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_blocks_of_queries_are_not_broadcast(spark):
    """Queries meet every group of candidates; the planner must not send them all through the driver."""
    vectors = [(i, [0.01 * i] * 3) for i in range(200)]
    found = impact_search.nearest(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>"), candidates=16, queries=2)
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    assert found.count() == 4 * 5


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-128, 128, (3000, 16))
    index, ids = impact_search.Index(vectors), np.arange(3000)
    for few in (0, 10, 10_000):
        got = impact_search.search(index, ids, vectors[:20], ids[:20], few=few)
        for q in range(20):
            exact = vectors @ vectors[q]
            exact[q] = -10**9
            order = np.lexsort((ids, -exact))[:5]
            assert [(i, s) for a, i, s in got if a == q] == [(int(i), int(exact[i])) for i in order]


# shingle join

def test_join(docs, rows, empty):
    got = {r["doc_id"]: r for r in ngram_join.jaccard_join(docs).collect()}
    sets = {r[0]: set(zip(*[lowered(r[1])[k:] for k in range(5)])) or {tuple(lowered(r[1]))} - {()} for r in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), root(i)) for i, s in sets.items()}
    assert ngram_join.jaccard_join(empty).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in sets if root(i) == i)


@pytest.mark.parametrize("block", [3_000, 1_000_000])
def test_links_inside_groups(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 4000, 200)]
    texts = [" ".join(base), " ".join(base), "one two three four five six", None]
    for i in range(40):  # near copies of different lengths, not all of them linked with each other
        copy = list(base[:200 - 2 * (i % 20)])
        for at in rng.integers(0, len(copy), i % 4):
            copy[int(at)] = f"x{i}"
        texts.append(" ".join(copy))
    sets = [set(zip(*[lowered(t)[k:] for k in range(5)])) for t in texts]
    classes = {frozenset(s) for s in sets if s}
    want = {i: sum(len(s & c) >= 0.8 * len(s | c) - 1e-9 for c in classes if c != s) if s else 0 for i, s in enumerate(sets)}
    assert len(set(want.values())) > 5
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: r["links"] for r in ngram_join.jaccard_join(rows).collect()} == want


def test_lookups_of_the_join_are_not_broadcast(spark, docs, monkeypatch):
    """However small they look on disk: only lookups whose cells were counted may pass through the driver."""
    plans, write, look_up = [], ngram_join.stored, ngram_join.joined

    def recorded(df, name):
        plans.append((name, df._jdf.queryExecution().toString()))
        return write(df, name)

    monkeypatch.setattr(ngram_join, "stored", recorded)
    monkeypatch.setattr(components, "stored", recorded)
    monkeypatch.setattr(ngram_join, "joined", lambda left, right, keys, how="left": look_up(left, right, keys, how, 0))
    ngram_join.jaccard_join(docs).count()
    assert len(plans) > 20 and not [n for n, p in plans if "Broadcast" in p]


@pytest.mark.parametrize("words", [1, 1 << 15])
def test_only_looked_up_texts_are_shuffled(spark, monkeypatch, tmp_path, words):
    """Texts that a lookup cannot meet stay where they are, however many ids it has; a crowded sieve loses none."""
    monkeypatch.setattr(ngram_join, "SIEVE_WORDS", words)
    texts = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("k"), F.col("id").cast("string").alias("text"))
    lookup = spark.range(1, 3000, 75).select(F.col("id").alias("k"), F.lit(7).alias("more"))
    texts.write.parquet(str(tmp_path / "texts"))
    lookup.write.parquet(str(tmp_path / "lookup"))
    texts, lookup = spark.read.parquet(str(tmp_path / "texts")), spark.read.parquet(str(tmp_path / "lookup"))
    wanted = {r["k"] for r in lookup.collect()}
    inner = ngram_join._looked_up(texts, lookup, "k", "inner")
    assert sorted((r["k"], r["text"], r["more"]) for r in inner.collect()) == sorted((k, str(k), 7) for k in wanted if k % 10)
    left = ngram_join._looked_up(texts, lookup, "k", "left")
    assert sorted((r["text"], r["k"], r["more"]) for r in left.collect()) == sorted(
        (str(i), i if i % 10 else None, 7 if i % 10 and i in wanted else None) for i in range(3000))
    plan = inner._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "sieve_word" in plan


def test_lookup_cells_are_counted(spark):
    """A lookup of few rows with long arrays is shuffled."""
    left = spark.range(50).withColumnRenamed("id", "k")
    right = spark.range(5).select(F.col("id").alias("k"), F.sequence(F.lit(1), F.lit(100)).alias("more"))
    got = joined(left, right, ["k"], "inner", 400)
    assert "Broadcast" not in got._jdf.queryExecution().toString() and got.count() == 5
    assert "Broadcast" in joined(left, right, ["k"], "inner", 600)._jdf.queryExecution().toString()


def test_null_ids_take_no_part(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f")]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, -1), (2, 2), (4, 2)]


def test_components(spark):
    chain = [(i + 1, i) for i in range(10, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {90: 90, 95: 90, 100: 90}


# suffix tree

def _brute_scores(texts, train):
    """Base and tree scores with plain counters."""
    lines = [lowered(t) + [None] for t in texts]
    grams = [collections.Counter() for _ in range(4)]
    for line, t in zip(lines, train):
        if t:
            for d in (1, 2, 3):
                grams[d].update(tuple(line[i:i + d]) for i in range(len(line) - d + 1))
    total, kinds, mu = sum(grams[1].values()), len(grams[1]), suffix_tree.MU

    def count(run):
        if len(run) > 1 and min(count(run[1:]), count(run[:-1])) < 2:
            return 0
        return grams[len(run)][run]

    def root_p(w, less=0):
        return (max(grams[1][(w,)] - less, 0) + 0.5) / (total + 0.5 * (kinds + 1))

    def state_p(state, w, parent, less=0):
        return (max(count((*state, w)) - less, 0) + mu * parent) / (max(count(state) - less, 0) + mu)

    gains = collections.Counter()
    for line, t in zip(lines, train):
        for i in range(1, len(line)) if t else ():
            state = (line[i - 1],)
            if count(state) >= 2:
                p = root_p(line[i], 1)
                gains[state] += math.log(state_p(state, line[i], p, 1) / p)
    kept = {s for s, g in gains.items() if g > suffix_tree.GAIN}

    def first_p(line, i, less=0):
        p = root_p(line[i], less)
        return state_p((line[i - 1],), line[i], p, less) if i and (line[i - 1],) in kept else p

    for line, t in zip(lines, train):
        for i in range(2, len(line)) if t else ():
            state = (line[i - 2], line[i - 1])
            if count(state) >= 2:
                p = first_p(line, i, 1)
                gains[state] += math.log(state_p(state, line[i], p, 1) / p)
    kept |= {s for s, g in gains.items() if len(s) == 2 and g > suffix_tree.GAIN}
    out = []
    for line in lines:
        score = 0.0
        for i in range(len(line)):
            p = first_p(line, i)
            if i > 1 and (line[i - 2], line[i - 1]) in kept:
                p = state_p((line[i - 2], line[i - 1]), line[i], p)
            score += math.log10(p)
        out.append((len(line), sum(grams[1][(w,)] > 0 for w in line), total, sum(math.log10(root_p(w)) for w in line), score))
    return out, kept


def test_suffix_tree(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK", 3000)
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    table = rows.collect()
    train = [zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1 for r in table]
    want, kept = _brute_scores([r["text"] for r in table], train)
    assert {len(s) for s in kept} == {1, 2}
    got = suffix_tree.score_texts(rows.repartition(3), modulo(F.col("doc_id"), 5) != 1).collect()
    mine = sorted((r["row"]["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    assert mine == sorted((r["doc_id"], n, k, t, round(b, 6), round(s, 6)) for r, (n, k, t, b, s) in zip(table, want))
    assert suffix_tree.score_texts(empty, F.lit(True)).count() == 0
    alone = suffix_tree.score_texts(docs.limit(3), F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in alone} == {(0, 0, 0.0)}


def _brute_whole(texts, train):
    """Scores with states of any length and all counts, and the retained states."""
    lines = [lowered(t) + [None] for t in texts]
    counts = collections.Counter(w for line, t in zip(lines, train) if t for w in line)
    total, kinds, mu = sum(counts.values()), len(counts), suffix_tree.MU
    p = [[[(max(counts[w] - less, 0) + 0.5) / (total + 0.5 * (kinds + 1)) for w in line] for line in lines] for less in (0, 1)]
    kept = set()
    for d in range(1, max(map(len, lines))):
        n, c, gains = collections.Counter(), collections.Counter(), collections.Counter()
        at = [(k, i, tuple(line[i - d:i])) for k, line in enumerate(lines) for i in range(d, len(line))]
        for k, i, state in at:
            n[state] += train[k]
            c[state, lines[k][i]] += train[k]
        new = [[list(x) for x in y] for y in p]
        for k, i, state in at:
            for less in (0, 1):
                new[less][k][i] = (max(c[state, lines[k][i]] - less, 0) + mu * p[less][k][i]) / (max(n[state] - less, 0) + mu)
            if train[k]:
                gains[state] += math.log(new[1][k][i] / p[1][k][i])
        good = {s for s, g in gains.items() if n[s] >= 2 and g > suffix_tree.GAIN}
        for k, i, state in at:
            if state in good:
                p[0][k][i], p[1][k][i] = new[0][k][i], new[1][k][i]
        kept |= good
    return [sum(math.log10(x) for x in line) for line in p[0]], kept


def test_gains_beyond_32_bits():
    c = object.__new__(suffix_tree.Coded)
    n = 300_000
    c.own, at = np.ones(n + 1, bool), np.arange(1, n + 1)
    found, parent = np.full(n + 1, n), np.full(n + 1, 1e-4)
    sent = c.gain("state1", np.array([7], np.uint64), np.zeros(n, np.int64), at, found, np.full(n, n), parent)
    assert sent.values[0] == pytest.approx(-n * math.log(1e-4) * suffix_tree.PARTS, rel=1e-4) and sent.values[0] > 2**31
    parcels = pa.Table.from_batches([suffix_tree._parcels(0, [sent], 1)])
    assert suffix_tree._unpacked(suffix_tree._added(parcels)["totals"][0].as_py(), "u1").tolist() == [1]


def test_lone_places_of_a_state_are_sent_as_one():
    c = object.__new__(suffix_tree.Coded)
    n = 50  # "a b c x0", "a b c x1", ...: what follows the run is found once each
    c.words = np.arange(1, n + 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c.codes = np.array([w for i in range(n) for w in (0, 1, 2, 3 + i)])
    c.place, c.own = np.tile(np.arange(4), n), np.repeat(np.arange(n) % 5 != 1, 4)
    o = np.zeros(n, suffix_tree.OPEN)
    o["at"], o["text"], o["depth"], o["n"], o["p0"], o["p1"] = np.arange(n) * 4 + 3, np.arange(n), 2, 40, 1e-4, 1e-4
    assert len(c.entries(o, 1, 4)[0]) == n
    o["lone"] = 1
    e, _, number, _, _ = c.entries(o, 1, 4)
    assert len(e) == 1 and e["count"].tolist() == [40] and not number.any()


def test_first_open_places_are_not_stored(spark, docs, monkeypatch):
    names, stored = [], suffix_tree.stored
    monkeypatch.setattr(suffix_tree, "stored", lambda df, name: names.append(name) or stored(df, name))
    assert suffix_tree.score_texts(docs, F.lit(True), whole=True).count() == docs.count()
    assert names[:6] == ["words", "pairs", "triples", "states", "told", "open"]


def _peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_one_long_entry_does_not_widen_its_range():
    n, wide = 20_000, 1500  # one entry with many words to the left among short ones
    e = np.zeros(n, suffix_tree.ENTRY)
    e["g"], e["w"], e["p1"], e["count"], e["reach"] = 1, np.arange(n) + 1, 1e-4, 1, 1
    e["g"][0], e["reach"][-1] = 7, wide
    table = pa.table({"kind": ["open"], "range": pa.array([0], pa.int32()), "block": pa.array([3], pa.int64()),
                      "keys": pa.array([suffix_tree._packed(e)], pa.binary()),
                      "amounts": pa.array([suffix_tree._packed(np.arange(wide - 1, dtype="<u8"))], pa.binary())})
    told = []
    assert _peak_mb(lambda: told.append(suffix_tree._deepened(table))) < 20  # padded to the longest: 240
    assert len(suffix_tree._unpacked(told[0]["totals"][0].as_py(), suffix_tree.TOLD)) >= n


def test_keys_that_share_their_first_bits_are_sorted():
    rng = np.random.default_rng(3)
    near = (np.uint64(5) << np.uint64(50)) + rng.integers(0, 4, 3000).astype(np.uint64)  # alike in all bits that are sorted
    for keys, width in ((near, suffix_tree.KEY_BITS), (rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2) + np.uint64(1), 64), (near[:1], 64), (near[:0], 64)):
        assert suffix_tree._order(keys, width).tolist() == np.argsort(keys, kind="stable").tolist()
        for got, want in zip(suffix_tree._distinct(keys, width), np.unique(keys, return_index=True, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_key_ranges_grow_with_the_words(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_tree, "RANGE_WORDS", 50)
    ranges = []
    monkeypatch.setattr(suffix_tree, "stored", lambda df, name, f=suffix_tree.stored: ranges.append((name, f(df, name))) or ranges[-1][1])
    scores = lambda: sorted(r["score"] for r in suffix_tree.score_texts(docs, F.lit(True), whole=True).collect())
    want = scores()
    words = sum(len(lowered(r["text"])) + 1 for r in docs.collect())
    assert words > 50 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dict(ranges)["words"].agg(F.max("range")).first()[0] > int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(suffix_tree, "RANGE_WORDS", 10**9)
    assert scores() == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("local", [3, 50_000])
def test_suffix_tree_of_any_depth(spark, monkeypatch, local):
    monkeypatch.setattr(suffix_tree, "BLOCK", 400)
    monkeypatch.setattr(suffix_tree, "LOCAL", local)
    rng = np.random.default_rng(5)
    texts = [None, "", "spam " * 60, "rare spam"]
    stem = [f"s{x}" for x in rng.integers(0, 9, 30)]
    for i in range(60):  # what follows the long run hangs on the word before it
        head, tail = ("left", "one") if i % 2 else ("right", "two")
        texts.append(" ".join([f"h{i}", head, *stem[:4 + i % 3 * 6], tail, f"t{i % 40}"]))
    for i in range(40):
        copy = list(stem)
        copy[int(rng.integers(0, 30))] = f"x{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 6, 60)) for _ in range(20)]
    train = [i % 5 != 1 for i in range(len(texts))]
    want, kept = _brute_whole(texts, train)
    assert max(map(len, kept)) > 12
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r["row"]["doc_id"]: r["score"] for r in suffix_tree.score_texts(rows, F.col("doc_id") % 5 != 1, whole=True).collect()}
    assert got == pytest.approx(dict(enumerate(want)), abs=1e-6)
    assert suffix_tree.score_texts(rows.limit(0), F.lit(True), whole=True).count() == 0


# pipeline

def test_pipeline(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mix", "pack"]
    got = corpus_pipeline.run(spark, FOLDER)
    load = got.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("n"), F.sum("n")).first()
    assert load[0] <= 1024 and load[1] <= 1.05 * math.ceil(load[2] / 1024) + 1


@pytest.mark.parametrize("path, spaced", [(BYTE, True), (WORD, False)])
def test_pieces_of_earlier_batches_are_looked_up(path, spaced, monkeypatch):
    own, coded = tokens.Encoder(path, spaced), []
    plain = own.encode
    monkeypatch.setattr(own, "encode", lambda found: coded.extend(found) or plain(found))
    texts = pa.array([t for t in ODD if t] + ["x" * 100 + " once more"])
    first = [(i.tolist(), b.tolist()) for _, _, i, b in own.ids(texts, 2)]
    before = len(coded)
    assert [(i.tolist(), b.tolist()) for _, _, i, b in own.ids(texts, 2)] == first
    assert before and [len(x) for x in coded[before:]] == [100]  # a long piece is not kept


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 5)
    own = tokens.Encoder(WORD, False)
    for k in range(6):
        texts = [f"qx{chr(97 + k + j)}v rest" for j in range(k + 1)]
        want = [e.ids + [2] for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
        got = [ids[b[i]:b[i + 1]].tolist() for low, high, ids, b in own.ids(pa.array(texts), 2) for i in range(high - low)]
        assert got == want and len(own.kept) <= 5 and own.kept_at.shape[1] == len(own.kept) and own.kept_at[1].sum() == len(own.kept_ids)


def test_steps_without_tokenizers_let_go_of_them():
    tokens.encoder(WORD, False)
    assert list(roomy(lambda batches: iter([tokens.encoder.cache_info().currsize]))(iter([]))) == [0]


def test_words_are_split_in_little_memory():
    import tracemalloc
    from tabspark.llm.texts import split_words
    texts = pa.array(["word and Another\nline of words "] * 32_000)
    tracemalloc.start()
    try:
        words = split_words(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert words.distinct.to_pylist() == ["word", "and", "another", "line", "of", "words"] and words.newline[:7].tolist() == [True, False, False, True, False, False, False]
    assert peak < 25 * texts.nbytes
