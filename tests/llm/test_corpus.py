"""Groups, neighbours, tokens, mixtures and subjects: brute force, round trips and odd rows."""

import math
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import components, mixing, neighbours, subjects, tokens

PAIRS = "node_id_a bigint, node_id_b bigint, similarity float, group_id string"


def brute_groups(rows, threshold=0.7):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, s, *_ in rows:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None and s is not None and not math.isnan(s) and s >= threshold:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in parent}


def test_groups(spark):
    r = random.Random(5)
    rows = [(k, k + 1, 0.9, "x") for k in range(1, 60)]  # long and thin
    rows += [(500, k, 0.8, None) for k in range(501, 560)] + [(700 + r.randrange(40), 700 + r.randrange(40), r.choice([0.2, 0.75, float("nan"), None, 1.0000001]), None) for _ in range(60)]
    rows += [(9000, None, 0.9, None), (None, 9001, 0.9, None), (None, None, 0.9, None), (9002, 9002, 1.0, None), (9003, 9004, 0.1, None), (9003, 9004, 0.7, None), (9004, 9003, None, None), (2, 1, 0.9, None)]
    df = spark.createDataFrame(rows, PAIRS)
    assert {x.node_id: x.group_id for x in components.match_groups(spark, df).collect()} == {k: v for k, v in brute_groups(rows).items()}
    assert components.match_groups(spark, df.limit(0)).count() == 0


def test_neighbours_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 128))
    x = np.concatenate([centres[rng.integers(0, 20, 400)] + 0.3 * rng.normal(size=(400, 128)), rng.normal(size=(100, 128))]).round(3)
    x[1] = x[0]  # equal vectors: one class
    x[5:20] = x[5]
    rows = [(k, [float(a) for a in v], 2, 2, "m") for k, v in enumerate(x)]
    rows += [(0, [1.0] * 128, 1, 9, "old"), (600, None, 1, 1, ""), (601, [0.0] * 128, 1, 1, ""), (602, [1.0] * 64, 1, 1, ""), (603, [float("nan")] + [1.0] * 127, 1, 1, ""), (604, [float("inf")] + [1.0] * 127, 1, 1, ""), (3, rows[3][1], 2, 2, "m"), (None, [1.0] * 128, 1, 1, "")]
    df = spark.createDataFrame(rows, "node_id bigint, embedding array<float>, embedded_at int, ingested_at int, rank string")
    got = {(r.node_id_a, r.node_id_b) for r in neighbours.nearest_pairs(spark, df).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1, kind="stable")[:, :10]
    want = {(min(i, int(j)), max(i, int(j))) for i in range(len(x)) for j in top[i]}
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95
    assert {(5, k) for k in range(6, 16)} <= got  # ties: the smaller ids
    one = df.where("node_id = 7")
    assert neighbours.nearest_pairs(spark, one).count() == 0 == neighbours.nearest_pairs(spark, df.limit(0)).count()


def test_packed_vectors_are_exact():
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.zeros((9, 16), dtype=np.float32)
    x[0] = rng.integers(-127, 128, 16) / 128
    x[1] = x[0] * 2.0**-60
    x[2] = rng.integers(-2000, 2000, 16)
    x[3] = rng.normal(size=16)
    x[4, 2], x[5, 2], x[6, :2], x[7, 1] = 3e38, 1e-45, (-0.0, 1), 1
    x[8] = -1
    packed = neighbours._pack(x)
    assert (neighbours._unpack(packed, 16) == x).all()
    assert [len(p) for p in packed] == [17, 17, 32, 64, 64, 64, 17, 17, 17] and packed[6] == packed[7]


def test_neighbours_travel_in_waves_and_leave_no_shuffle_files(spark, monkeypatch):
    import time

    import numpy as np

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 400)] + 0.3 * rng.normal(size=(400, 16))).round(3)
    x[10:30] = x[10]
    df = spark.createDataFrame([(k, [float(a) for a in v], 2, 2) for k, v in enumerate(x)], "node_id bigint, embedding array<float>, embedded_at int, ingested_at int").localCheckpoint()
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {f for f in files.getAllFiles().mkString(" ").split() if f.endswith(".data")}
    before = held()
    once = {tuple(r) for r in neighbours.nearest_pairs(spark, df, 5, 16).toLocalIterator()}
    time.sleep(1)
    assert len(once) > 1000 and not [f for f in held() - before if os.path.getsize(f) > 10_000]
    monkeypatch.setattr(neighbours, "WAVE_ROWS", 1200)
    monkeypatch.setattr(neighbours, "WAVE_SHARE", 1)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 100)
    waves = {tuple(r) for r in neighbours.nearest_pairs(spark, df, 5, 16).toLocalIterator()}
    assert waves == once


needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoder():
    return tokens.Transducer(tokens.Vocabulary())


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return t


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t=aab'stré日🙂")), max_size=80))
def test_tokens_match_the_library(encoder, library, text):
    ids = encoder.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert "".join(encoder.decode(ids)) == text


@needs_vocabulary
def test_tokens_stream(encoder, library, monkeypatch):
    text = "a" * 5000 + " " + "ab" * 3000 + "=" * 3001 + " " * 2000 + "x'll <|endoftext|> don't " + "日本" * 500 + "\u200b\ufffd"
    want = library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == want
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 64)  # words longer than blocks, and cuts everywhere
    assert encoder.encode(text) == want
    raw = ("a" * 700 + "b" * 300).encode()
    for size in (1, 7, 64):
        assert list(encoder.encode_bytes([raw[k : k + size] for k in range(0, len(raw), size)])) == library.encode(raw.decode(), add_special_tokens=False).ids
    assert list(encoder.decode(encoder.encode("日")[:-1])) == ["\ufffd"]


@needs_vocabulary
def test_long_words_need_bounded_state(encoder, library, monkeypatch):
    """Words of a million letters: what is kept stays within a piece, the lookahead and the longest token, and every settling gets that far."""
    import random

    kept = []
    stable = encoder._stable
    monkeypatch.setattr(encoder, "_stable", lambda last, emitted, end: kept.append((len(last), end - (at := stable(last, emitted, end)))) or at)
    r = random.Random(1)
    for word in ("a" * 1_000_000, "".join(r.choice("abcdest") for _ in range(200_000)), "ÃÂ" * 20_000, "=" * 70_001, "ab" * 40_000 + "\u200b" * 3000):
        kept.clear()
        ids = list(encoder.encode_bytes(encoder._pieces(word)))
        assert b"".join(encoder.tokens[i] for i in ids) == word.encode()
        if len(word) < 300_000:
            assert ids == library.encode(word, add_special_tokens=False).ids
        most = 4 * tokens.PIECE_CHARS + encoder.lookahead + 2 * encoder.longest
        assert len(kept) > 5 and max(n for n, _ in kept) <= most and max(lag for _, lag in kept) <= encoder.lookahead + encoder.longest


def test_lookahead_of_small_merge_lists():
    """(a, a) alone: one pair decides. A chain of merges, each later, each with the product of the one before on its right."""

    class Small(tokens.Vocabulary):
        def __init__(self, letters, merges):
            self.tokens = [c.encode() for c in letters]
            self.merges, self.made = [], []
            for x, y in merges:
                at = [self.tokens.index(t.encode()) for t in (x, y)]
                self.merges.append(tuple(at))
                self.tokens.append((x + y).encode())
                self.made.append(len(self.tokens) - 1)
            self.longest = max(map(len, self.tokens))

    assert Small("a", [("a", "a")])._sufficient_lookahead() == 2
    assert Small("abc", [("b", "c"), ("a", "b")])._sufficient_lookahead() == 4
    assert Small("abcd", [("c", "d"), ("b", "c"), ("a", "b")])._sufficient_lookahead() == 6


@needs_vocabulary
def test_tokens_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "hi", 9), (3, "hi", 9)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in tokens.encoded(spark, df).collect())
    assert got[:2] == [(1, []), (2, [])] and len(got) == 4 and got[2] == got[3]
    assert tokens.round_trips(spark, df).where("NOT same").count() == 0
    assert tokens.encoded(spark, df.limit(0)).count() == 0


def test_flight_keeps_both_sums():
    import numpy as np

    rng = np.random.default_rng(0)
    size = rng.integers(1, 3000, 500).astype(float)
    pi = np.full(500, 0.3)
    out = mixing.flight(pi, size, rng)
    assert abs((out * size).sum() - (pi * size).sum()) < 1e-3 and abs(out.sum() - 150) < 1e-6
    assert ((out > 0) & (out < 1)).sum() <= 2
    done = mixing.balance(pi, size, rng, True)
    assert set(done) <= {0.0, 1.0} and abs((done * size).sum() - (pi * size).sum()) < 60
    mean = np.mean([mixing.flight(np.array([0.2, 0.5, 0.8, 0.5]), np.array([3.0, 5.0, 9.0, 2.0]), np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(mean - [0.2, 0.5, 0.8, 0.5]).max() < 0.05  # every document keeps its expected uses


@needs_vocabulary
def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 64)  # several rounds of blocks
    r = random.Random(1)
    docs = [(k, " ".join(r.choice("one two three four five six".split()) for _ in range(r.randint(1, 200))), r.choice(["A", " a", "A "]), 0) for k in range(600)]
    docs += [(1000 + k, "word " * r.randint(1, 40), "b", 0) for k in range(40)] + [(2000, None, "a", 0), (2001, "", "b", 0), (2002, "x y", None, 0), (2003, "x y", "zz", 0), (None, "x", "a", 0), (5, docs[5][1], "a", 0)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b ", 0.3, 4), ("none", 0.2, 2)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mixture(spark, spark.createDataFrame(docs, "doc_id bigint, text string, source string, uses int"), targets)
    used = {u.doc_id: u for u in uses.collect()}
    assert len(used) == 642 and 2002 not in used and used[2000].uses == used[2001].uses == 0
    assert max(u.uses for u in used.values() if u.source == "b") <= 4 and max(u.uses for u in used.values() if u.source == "a") <= 1
    shares = {x.source: x for x in report.collect()}
    assert abs(shares["a"].actual_share - 0.625) < 0.003 and abs(shares["b"].actual_share - 0.375) < 0.003 and shares["none"].tokens == 0
    assert shares["a"].tokens == sum(u.uses * u.tokens for u in used.values() if u.source == "a")
    nothing, empty = mixing.mixture(spark, spark.createDataFrame([], "doc_id bigint, text string, source string"), targets)
    assert nothing.count() == 0 and {x.actual_share for x in empty.collect()} == {0.0}


def test_sentences():
    text = "# Title\n\nThe *first* one ends here. `x()` is second! <p>Third</p>\nuser12: Fourth goes on\nin the next line.\n```sh\nskip me\n```\n  at foo (bar.py:3)\n- Fifth?"
    found = [s.strip() for s in subjects.sentences(text)]
    assert len(found) == 6 and found[-1] == "Fifth?" and not any("skip" in s or "bar" in s for s in found)
    assert subjects.sentences("") == [] and len(subjects.features("")) == 0


def test_subjects(spark):
    words = {"sport": "goal keeper match league referee".split(), "law": "court judge verdict plaintiff statute".split(), "music": "violin chord rehearsal tempo overture".split()}
    filler = ["Thanks for the quick answer!", "More details tomorrow.", "The old page is gone."]
    r = random.Random(7)

    def sentence(s):
        a, b = r.sample(words[s], 2)
        return f"The overview shows the {a} first and the {b} below it."

    docs, truth, labels = [], {}, []
    for k in range(400):
        own = r.sample(sorted(words), r.choice([0, 1, 1, 2]))
        lines = [sentence(s) for s in own for _ in range(r.randint(2, 5))] + r.sample(filler, 2)
        if r.random() < 0.3:  # a single passing sentence is no case
            other = [s for s in words if s not in own]
            lines.append(sentence(r.choice(other))) if other else None
        r.shuffle(lines)
        docs.append((k, " ".join(lines), "x"))
        truth[k] = set(own)
        if k < 200:
            labels += [(k, s) for s in own] or [(k, None)]
    docs += [(900, docs[0][1], "x"), (901, None, ""), (902, "  ", ""), (None, "x", "")]
    labels += [(3, "unknown"), (None, "law"), (77777, "law"), (0, "music")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    ls = spark.createDataFrame(labels, "doc_id bigint, subject string")
    subs = spark.createDataFrame([(s, "") for s in words] + [(None, "")], "subject string, description string")
    got = {}
    for row in subjects.subjects_of(spark, d, ls, subs).collect():
        got.setdefault(row.doc_id, set()).add(row.subject)
    held = [k for k in truth if k >= 200]
    right = sum(len(got.get(k, set()) & truth[k]) for k in held)
    assert right / sum(len(truth[k]) for k in held) > 0.95 and right / sum(len(got.get(k, set())) for k in held) > 0.95
    assert got.get(900) == got.get(0) and 901 not in got and 902 not in got
    assert subjects.subjects_of(spark, d, ls.limit(0), subs).count() == 0 == subjects.subjects_of(spark, d.limit(0), ls, subs).count()
