"""The transducer, the reversed search and the conversation repair against brute force and the tokenizer library."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from tabspark.llm import bpe_transducer, conversations, reversed_search

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
CLASHING = "doc_id bigint, text string, row string, ids string, decoded string, n bigint"


# byte-level BPE

@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe_transducer.Encoder(RANKS, PATTERN)


def _texts(count=400):
    rng = random.Random(5)
    letters = "aaabbcdeet  \n'sxyz0123éßабв中文🙂🙃‍ !?.,-_====     \t"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(count)]
    runs = [c * n for c in "a =-é中0\n" for n in (1, 2, 3, 7, 1000, 20001)]
    wide = ["".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(50)) for _ in range(50)]
    return [*made, *runs, *wide, "don't we'll I'M it's", " the  end ", "<|endoftext|>", "x" * 3 + "the" * 5000]


def test_ids_are_those_of_the_library(library, encoder):
    for text in _texts():
        assert encoder.encode(text) == library.encode_ordinary(text), text[:80]


def test_forgetting_changes_nothing(library):
    small = bpe_transducer.Encoder(RANKS, PATTERN)
    small.transducer = bpe_transducer.Transducer(small.transducer.ranks, arcs=40, pairs=20)
    for text in _texts(60):
        assert small.encode(text) == library.encode_ordinary(text), text[:80]
    assert len(small.transducer.arcs) <= 40 and len(small.transducer._fits) <= 20


def test_every_token_is_its_own_encoding_or_a_whole_match(encoder):
    tokens = list(encoder.transducer.ranks.items())
    for data, rank in tokens[::7]:
        assert encoder.transducer.encode(data) == [rank]


def test_output_waits_no_longer_than_the_longest_token(encoder):
    own = encoder.transducer
    longest = max(map(len, own.ranks))
    data, out, state = ("the" * 50 + "=" * 200).encode(), [], 0
    for i in range(len(data)):
        state = own.feed(state, data[i:i + 1], out)
        assert i + 1 - sum(len(own.token[t]) for t in out) <= 2 * longest
    assert out + list(own.rest(state)) == own.encode(data)


def test_new_words_need_few_new_states(library, monkeypatch):
    """What follows a place in the trie is built once, whatever the tokens before it."""
    rng = random.Random(3)
    syllables = [a + b for a in "bcdfglmnprstvzé" for b in ("a", "e", "i", "on", "er", "ï")]
    words = [" " + "".join(rng.choice(syllables) for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    own = bpe_transducer.Encoder(RANKS, PATTERN)
    assert [own.encode(w) for w in words] == [library.encode_ordinary(w) for w in words]
    assert len(own.transducer.states) < len(words) and len(own.transducer.arcs) < 3 * len(words)
    # matches read in slices give the same
    monkeypatch.setattr(bpe_transducer, "READ_BYTES", 3, raising=False)
    again = bpe_transducer.Encoder(RANKS, PATTERN)
    assert [again.encode(w) for w in words[:500]] == [own.encode(w) for w in words[:500]]


def test_transducer_needs_every_byte():
    with pytest.raises(ValueError):
        bpe_transducer.Transducer({b"a": 0, b"ab": 1})


def test_decoding_in_pieces(library, encoder):
    decoder, rng = bpe_transducer.Decoder(encoder.transducer.token), random.Random(1)
    for text in _texts(200):
        ids = library.encode_ordinary(text)
        cuts = sorted(rng.randint(0, len(ids)) for _ in range(5))
        decoder.restart()
        given = [decoder.feed(ids[a:b]) for a, b in zip([0, *cuts], [*cuts, len(ids)])]
        assert "".join(x.decode() for x in given) == text and decoder.finish() == b"" and decoder.broken == 0


def test_bytes_that_are_not_utf8(encoder):
    decoder, rng = bpe_transducer.Decoder(encoder.transducer.token), random.Random(2)
    for _ in range(3000):
        ids = [encoder.transducer.ranks[bytes([rng.choice((65, 0x80, 0xA0, 0xC3, 0xE0, 0xE2, 0xED, 0xF0, 0xF4, 0xFF))])] for _ in range(rng.randint(1, 9))]
        raw = b"".join(decoder.tokens[i] for i in ids)
        decoder.restart()
        assert decoder.feed(ids[:4]) + decoder.feed(ids[4:]) + decoder.finish() == raw
        try:
            raw.decode()
            assert decoder.broken == 0
        except UnicodeDecodeError:
            assert decoder.broken > 0


def test_encoded_and_decoded_rows(spark, library):
    texts = [None, "", " ", "a", "a", *_texts(30)]
    rows = [(i, t, "r", "i", "d", i) for i, t in enumerate(texts)] + [(3, "a", "r", "i", "d", 3), (None, "b c", None, None, None, None)]
    docs = spark.createDataFrame(rows, CLASHING).repartition(3)
    coded = bpe_transducer.decode(bpe_transducer.encode(docs, RANKS, PATTERN), RANKS, chunk=3)
    got = bpe_transducer.digests(coded).collect()
    want = []
    for row in rows:
        ids = library.encode_ordinary(row[1] or "")
        want.append((row, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest(), 0))
    key = lambda r: str(r)
    assert sorted([(tuple(r[0]), *r[1:]) for r in got], key=key) == sorted(want, key=key)
    both = bpe_transducer.digests(bpe_transducer.round_trip(docs, RANKS, PATTERN, chunk=2)).collect()
    assert sorted(map(str, both)) == sorted(map(str, got))
    empty = bpe_transducer.decode(bpe_transducer.encode(docs.limit(0), RANKS, PATTERN), RANKS)
    assert empty.count() == 0 and empty.columns == ["row", "ids", "decoded", "broken"]


# reversed search

def _terms(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def _ranked(docs, items, top=10):
    held = [(i, collections.Counter(_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for number, text in items:
        scored = []
        for doc, c in held:
            m = 25 + (75 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
                        for t in _terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(number, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.mark.parametrize("postings", [1 << 20, 5])
def test_reversed_search(spark, postings, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "é", "A1", "x-y", "中文"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, "-- !!"), (153, "w1 " * 5000), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (7, "w1 w2 w3"), *[(200 + i, "w5 w6 tie") for i in range(30)]]
    items = [(1, "w1 w2 w2 The THE"), (2, None), (3, ""), (4, "nowhere at all"), (5, "w5 tie"), (5, "w5 tie"), (6, " ".join(words)), (None, "é 中文"), (8, "A1, x-y")]
    monkeypatch.setattr(reversed_search, "CELLS", 700)
    left = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id bigint, text string, terms string, n int").repartition(4)
    right = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, number int").repartition(2)
    got = reversed_search.search(left, right, postings=postings).select("item.item_id", "rank", "doc_id", "score").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(_ranked(docs, items), key=key)
    assert reversed_search.search(left.limit(0), right).count() == 0
    assert reversed_search.search(left, right.limit(0)).count() == 0


def test_heaps_keep_the_best(rng=np.random.default_rng(1)):
    score, doc = rng.integers(1, 20, 500), rng.permutation(500)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for low in range(0, 500, 37):
        best = reversed_search.heap(best, score[low:low + 37], doc[low:low + 37], 10)
    want = sorted(zip((-score).tolist(), doc.tolist()))[:10]
    assert list(zip((-best[0]).tolist(), best[1].tolist())) == want


# conversations

def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        role, text, kind = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _best(rows):
    """All repairs by a search over (row, what was written last), the least (cost, letters) first."""
    import heapq
    queue, done = [(0, "", 0, "", ())], set()
    legal = lambda last, new: new == "u" and last in ("", "s", "a") or new == "a" and last == "u" or new == "s" and last == ""
    while queue:
        cost, letters, at, last, out = heapq.heappop(queue)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, letters, out
        for who in ("user", "assistant"):
            if legal(last, who[0]):
                heapq.heappush(queue, (cost + 2, letters + "I", at, who[0], (*out, f"{who}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 3, letters + "D", at + 1, last, out))
            if fault in (0, 3):
                more = fault == 3
                if legal(last, role[:1]):
                    heapq.heappush(queue, (cost + more, letters + "K", at + 1, role[0], (*out, f"{role}:{text}")))
                for who in ("user", "assistant"):
                    if legal(last, who[0]):
                        heapq.heappush(queue, (cost + 2 + more, letters + "R", at + 1, who[0], (*out, f"{who}:{text}")))


def _reported(rows):
    """(conv, ...) for rows (conv, turn, role, text) after damage."""
    out = {}
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest())
    for conv, group in itertools.groupby(sorted(rows, key=order), key=lambda r: r[0]):
        group, seen, faulty = list(group), set(), []
        for _, _, role, text in group:
            bare = text.strip("\t\n\v\f\r ")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[1] for r in group if r[1] is not None]
        cost, letters, said = _best(faulty)
        count = collections.Counter(f for _, _, f in faulty)
        bad = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count[1], count[2], count[3], bad, cost, letters,
                     hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def _talks():
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        turns = range(rng.randint(1, 3 if conv % 3 else 40))
        for turn in turns:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "s", "User"])
            text = rng.choice(["Yes.", "No", "Why?", " \n", "", None, "é!", "a. \t\n", "long " * 300 + "."]) if rng.random() < 0.6 else f"t{turn}."
            rows.append((conv, rng.choice([turn, turn, turn, None, turn - 2]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hm."), (100, None, "user", "Hi."), (100, None, "assistant", "Hi."), rows[3], rows[3], rows[40]]
    rows += [(101, i, ("user", "assistant")[i % 2], f"line {i}.") for i in range(300)]      # a long sound one
    rows += [(102, i, None, f"line {i}.") for i in range(300)]                              # vectors that never meet
    rows += [(103, i, "user", "same.") for i in range(100)]                                 # one row said again and again
    rows += [(104, 5, "user", "same.")] * 100
    rows += [(105, i, "assistant", f"line {i}") for i in range(101)]
    return rows


TALK = "conv_id bigint, turn bigint, role string, text string, part int, kinds string"


@pytest.mark.parametrize("size, span", [(4096, 64), (5, 2), (1, 3)])
def test_repairs_are_the_cheapest(spark, size, span):
    rows = _talks()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], TALK).repartition(3)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}} | _reported(_damaged(rows))
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.report(conversations.damage(df), size, span).collect()}
    assert got == want


def test_repaired_rows(spark):
    rows = _talks()
    df = conversations.damage(spark.createDataFrame([(*r, 0, "x") for r in rows], TALK))
    report = {r["conv_id"]: r for r in conversations.report(df, 7, 3).collect()}
    by = collections.defaultdict(list)
    for r in sorted(conversations.repaired(df, 7, 3).collect(), key=lambda r: r["step"]):
        by[r["conv_id"]].append(r)
    for conv, r in report.items():
        steps = by[conv]
        assert "".join(s["edit"] for s in steps) == r["audit"] and [s["step"] for s in steps] == list(range(len(steps)))
        kept = [f"{s['role']}:{s['text']}" for s in steps if s["edit"] != "D"]
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in kept))


def test_no_conversations(spark):
    empty = conversations.damage(spark.createDataFrame([], TALK))
    assert conversations.report(empty).count() == 0 and conversations.repaired(empty).count() == 0


def test_old_runs_hold_once_vectors_are_parallel():
    costs, rng = conversations.Costs(), random.Random(4)
    for _ in range(300):
        kinds = bytes(rng.choice([0, 1, 2, 3, 5, 6, 8]) for _ in range(rng.randint(1, 12)))
        old, new = costs.end, costs.of(rng.choice([(0, 4, 2, 0), (2, 2, 0, 2), (1, 1, 1, 0), (0, 2, 0, 0)]))
        more = costs.rerun(kinds, old, new)
        (a, grown), (b, other) = costs.back(kinds, old), costs.back(kinds, new)
        assert (more is None) == (a != b) and (more is None or other - grown == more)


def test_queries_of_streams_on_awkward_rows(spark, tmp_path):
    """The registered queries give one row for each document or conversation, whatever is null, empty or repeated."""
    from tabspark.llm.queries import QUERIES
    docs = [(0, None, "en", None, 0), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "one two. " * 2000, "en", "s", 1), (None, "x", None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, None, None), (None, None, "user", "x")], "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    assert len(QUERIES["op11_bpe_transducer"](spark, str(tmp_path)).collect()) == 5
    assert [tuple(r)[:3] for r in QUERIES["op12_reversed_search"](spark, str(tmp_path)).collect()] == [(1, 1, 2)]
    assert len(QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()) == 2


# what earlier operators make of rows that share a doc_id, or have no words

def _made(n, seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 4000, n))


def test_rows_that_share_a_doc_id(spark):
    from tabspark.llm import ngram_join
    a, b, u, p, q = (_made(100, s) for s in range(5))
    rows = [(1, a, "k"), (2, a, "k"), (2, u, "k"), (3, p, "k"), (3, q, "k"), (None, a, "k"), (3, p, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, number string").repartition(3)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter([(1, a), (2, u), (3, p), (3, q), (None, a)])
    near = lambda t, w: " ".join([*t.split()[:-1], w])
    rows = [(1, a), (1, b), (2, near(a, "x")), (3, near(b, "y")), (None, a), (4, None)]
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted([(1, 96, 1, 1), (1, 96, 1, 1), (2, 96, 1, 1), (3, 96, 1, 1), (None, 96, None, 0), (4, 0, 4, 0)], key=key)


def test_mix_of_documents_without_words(spark, tmp_path):
    from tabspark.llm.queries import QUERIES
    docs = [(0, None, "en", None, 0), (1, "", None, "s", 0), (2, " \n", "en", "s", 1), (3, "some words here", "en", "s", 1), (3, "some words here", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_source_schedule"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["size"], r["repeats"] is None) for r in got) == [(0, 0, True), (1, 0, True), (2, 0, True), (3, 3, False), (3, 3, False)]


def test_pieces_met_again_are_not_read_again(library, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "PIECES", 3)
    own, read = bpe_transducer.Encoder(RANKS, PATTERN), []
    plain = own.transducer.encode
    monkeypatch.setattr(own.transducer, "encode", lambda data: read.append(data) or plain(data))
    text = "often aqxvu often bqxvu often cqxvu often dqxvu often eqxvu often"
    assert own.encode(text) == library.encode_ordinary(text)
    assert read.count(b" often") == 1 and max(len(own.known), len(own.older)) <= 3
