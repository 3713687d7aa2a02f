"""Near-duplicates, spans, search, mixture, the two learned operators and the pipeline."""

import itertools
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import AWKWARD, SCHEMA, clashing, docs, write

import corpus_pipeline
from hopline.llm import common, crf_language, exact_topk, factor_machine, mixing, queries, sentence_spans, simhash
from hopline.llm.components import components


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    write(spark, path)
    write(spark, path, [(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (77, 5)], "doc_id bigint, quality int", "labels")
    return path


# components


def plain_components(links):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


@pytest.mark.parametrize("links", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 1), (1, 5), (9, 9), (7, 5)], [(i, i * 7 % 50) for i in range(50)]])
def test_components(spark, links):
    df = spark.createDataFrame([*links, (None, 3), (4, None)], "a bigint, b bigint")
    got = {r.node: r.label for r in components(df).collect()}
    assert got == plain_components([x for x in links if x[0] != x[1]])
    assert components(df.limit(0)).collect() == []


# SimHash


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints():
    for _, text, *_ in AWKWARD:
        if len(text or "") < 100_000:
            assert simhash.fingerprint((text or "").encode()) == plain_print(text)
    assert simhash.fingerprint(b"word " * 50_000) == xxhash.xxh64_intdigest(b"word word word", 42)


def prints_fixture(seed=3, groups=6, near=40, alone=60):
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(alone)] + [0]
    for _ in range(groups):
        base = rnd.getrandbits(64)
        for _ in range(near):
            x = base
            for b in rnd.sample(range(64), rnd.randint(0, 3)):
                x ^= 1 << b
            out.append(x)
    return sorted(set(out))


def linked(prints, radius=3):
    return plain_components([(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= radius])


@pytest.mark.parametrize("tile, narrow", [(4096, 48), (8, 4), (3, 0)])
def test_links_lose_nothing(spark, monkeypatch, tile, narrow):
    prints = prints_fixture()
    monkeypatch.setattr(simhash, "NARROW", narrow)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    distinct = common.stage(spark.createDataFrame([(x,) for x in signed], "fingerprint bigint"), "t")
    got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(distinct, 3, tile).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in got)
    mine, want = plain_components(got), linked(prints)
    assert {frozenset(g) for g in _groups(mine)} == {frozenset(g) for g in _groups(want)}


def _groups(labels):
    out = {}
    for x, label in labels.items():
        out.setdefault(label, set()).add(x)
    return [g for g in out.values() if len(g) > 1]


def test_more_rows_take_more_blocks():
    assert simhash.key_plan(10, 3) == 4 and simhash.key_plan(10**9, 3) > 4
    # every plan finds pairs at the very radius
    rnd = random.Random(1)
    base = rnd.getrandbits(64)
    for blocks in (4, 5, 6):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        for bits in itertools.islice(itertools.combinations(range(64), 3), 0, 41664, 97):
            other = base ^ sum(1 << b for b in bits)
            same = [i for i in range(blocks) if (base ^ other) >> edges[i] & ((1 << (edges[i + 1] - edges[i])) - 1) == 0]
            assert len(same) >= blocks - 3


def test_narrow_runs_give_a_forest():
    keys = np.array([1, 1, 1, 2, 2, 3])
    prints = np.array([0, 1, 255, 7, 6, 7], dtype=np.uint64)
    rows, labels = simhash.narrow_forest(keys, prints, 3)
    assert list(zip(rows.tolist(), labels.tolist())) == [(1, 0), (4, 3)]


def test_simhash_query(spark, awkward):
    rows = queries.op7_simhash(spark, awkward).collect()
    texts = {i: t for i, t, *_ in AWKWARD}
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    for i in (1, 2, 3, 4, 5, 8, 9):
        assert by[i].fingerprint == f"{plain_print(texts[i]):016x}"
    assert by[1].component_id == by[2].component_id == 1
    # the null, the empty and the blank text share fingerprint zero, and so does a null text without an id
    assert {by[i].component_id for i in (3, 4, 5)} == {3}
    assert sorted((r.component_id or -1) for r in rows if r.doc_id is None) == [-1, 3]


@pytest.mark.parametrize("bits", [32 << 20, 2])
def test_one_of_each_group_stays(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "BITMAP_BITS", bits)
    df = clashing(docs(spark), "fingerprint", "cluster")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    # 3, 4, 5 and a null row are one group; 1 and both rows of 2 are one
    prints = {i: plain_print(t) for i, t, *_ in AWKWARD if len(t or "") < 100_000}
    near = (prints[1] ^ prints[9]).bit_count() <= 3
    want = [1, 3, 6, 7, 8, None] + ([] if near else [9])
    assert sorted(kept.collect(), key=str) and sorted([r.doc_id for r in kept.collect()], key=str) == sorted(want, key=str)
    twice = docs(spark, [(2, "b c d", "en", "s", 1), (2, "b c d", "de", "s", 1), (5, "b c d", "en", "s", 1)])
    assert [r.doc_id for r in simhash.keep_one(twice).collect()] == [2]
    assert simhash.keep_one(docs(spark, [])).collect() == []


# sentence spans


def plain_cut(text):
    """Sentences as lists of words, each word with its place: by going through the characters; long ones in pieces."""
    words, sentence, at = [], 0, 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        if end > at:
            words.append((text[at:end], at, sentence))
        stop = end > at and text[end - 1] in ".!?" and end < len(text)
        at = end
        while at < len(text) and text[at] in " \t\n\v\f\r":
            stop |= text[at] == "\n"
            at += 1
        sentence += stop
    pieces = []
    for _, own in itertools.groupby(words, key=lambda w: w[2]):
        own, piece, begins = list(own), [], True
        for w in own:
            piece.append(w)
            if len(own) > 24 and (zlib.crc32(w[0].encode()) % 8 == 0 or len(piece) == 24):
                pieces.append((piece, begins))
                piece, begins = [], False
        if piece:
            pieces.append((piece, begins))
    return pieces


def plain_dedup(rows, span, least):
    """(document, piece) of each piece that goes: every run is written out and compared with all others."""
    runs, pieces = [], {i: plain_cut(text) for i, text in rows}
    for i, own in pieces.items():
        for at in range(len(own)):
            for end in range(at + 1, len(own) + 1):
                some = own[at:end]
                sentences = {w[2] for piece, _ in some for w in piece}
                if len(sentences) >= span and sum(len(piece) for piece, _ in some) >= least:
                    runs.append((tuple(" ".join(w[0] for w in piece) for piece, _ in some), i, at, end))
                    break
    first = {}
    for key, i, at, _ in sorted(runs, key=lambda r: (r[1], r[2])):
        first.setdefault(key, (i, at))
    gone = {(i, n) for key, i, at, end in runs if first[key] != (i, at) for n in range(at, end)}
    return pieces, gone


@pytest.mark.parametrize("bits", [32 << 20, 64])
def test_spans_against_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "BITMAP_BITS", bits)
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefgh") * rnd.randint(1, 3)
    pool = [" ".join(word() for _ in range(rnd.randint(1, 8))) + rnd.choice([". ", "! ", ".\n", "? ", "\n"]) for _ in range(30)]
    pool += [" ".join(word() + str(rnd.randrange(9)) for _ in range(40)) + ". " for _ in range(3)]  # cut in pieces
    rows = [(i, "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 18)))) for i in range(60)]
    rows += [(100 + i, " ".join(f"own{i}x{j}" for j in range(60)) + ".") for i in range(40)]
    df = docs(spark, [(i, t, "en", "s", 1) for i, t in rows])
    out = sentence_spans.dedup(clashing(df, "n_removed", "clean_text"), span=2, min_words=5, anchored=False).collect()
    pieces, gone = plain_dedup(rows, 2, 5)
    texts = dict(rows)
    assert len(out) == len(rows) and {r.n_removed for r in out if r.doc_id >= 100} == {0}
    for r in out:
        own = pieces[r.doc_id]
        left = [w[0] for n, (piece, _) in enumerate(own) if (r.doc_id, n) not in gone for w in piece]
        assert (r.n_sentences, r.n_removed) == (len(own), sum(i == r.doc_id for i, _ in gone))
        assert r.clean_text.split() == left and r.words_removed == len(texts[r.doc_id].split()) - len(left)
    assert 50 < len(gone) < sum(map(len, pieces.values())) / 1.5


def test_one_long_sentence_holds_no_run():
    found = sentence_spans.sentences(("the " * 300).encode())
    assert len(found) > 10 and sentence_spans.runs(found, 2, 24) == []
    # but the last of its pieces and the sentence after it are two
    found = sentence_spans.sentences(("the " * 60 + ". Next one here.").encode())
    assert sentence_spans.runs(found, 2, 10)[-1] == len(found)


def test_repeats_of_words_within_a_text_stay(spark):
    rows = [(1, "Word salad " * 100, "en", "s", 1), (2, "other words here " * 80, "en", "s", 1), (3, "Word salad " * 100, "en", "s", 1)]
    out = {r.doc_id: r for r in sentence_spans.dedup(docs(spark, rows)).collect()}
    assert out[1].n_removed == out[2].n_removed == 0 and out[3].words_removed == 200


def test_sentences():
    text = "  One two. Three!\nFour  five\n\n?! 1.5 is no end."
    found = sentence_spans.sentences(text.encode())
    assert [x[3].decode() for x in found] == ["One two.", "Three!", "Four five", "?!", "1.5 is no end."]
    assert "".join(text[a:b] for a, b, *_ in found) == text
    long = sentence_spans.sentences(("the " * 300).encode())
    assert len(long) == -(-300 // sentence_spans.LONG) and sum(x[2] for x in long) == 300
    # without stops, a shared passage is cut alike whatever stands before it
    words = [f"w{i * i % 97}x{i}" for i in range(60)]
    cut = [{x[3] for x in sentence_spans.sentences(" ".join(before + words).encode())} for before in (["a"] * 7, ["b", "c"] * 20)]
    assert sum(len(x.split()) for x in cut[0] & cut[1]) > 25
    assert sentence_spans.sentences(b"") == [] and sentence_spans.sentences(b" \n ") == []


def test_anchored_spans_of_any_texts():
    rnd = random.Random(6)
    raws = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, n) for _ in range(size)).encode() for n, size in ((1, 0), (3, 50), (3, 51), (1, 300), (4, 700), (1, 51), (3, 52))] + [b"the " * 120]
    text, at, gram = (x.tolist() for x in sentence_spans.anchors(raws))
    size, all_words = sentence_spans.GRAM, sentence_spans.PASSAGE
    by, of = {}, {}
    for t, p, g in zip(text, at, gram):
        by.setdefault(t, {})[p] = g
        words = tuple(raws[t].split()[p : p + size])
        assert len(words) == size and of.setdefault(words, g) == g
    assert len(set(of.values())) == len(of)
    for t, raw in enumerate(raws):
        for i in range(len(raw.split()) - all_words + 1):
            assert any(p in by[t] for p in range(i, i + all_words - size + 1))
    assert 0 not in by and 1 not in by and len(by[7]) == 120 - size + 1


@pytest.mark.parametrize("stops", [True, False])
def test_every_unaligned_passage_is_caught(spark, stops):
    rnd = random.Random(9)

    def prose(n):
        return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) + ("." if stops and rnd.random() < 0.06 else "") for _ in range(n)]

    rows, shared = [], {}
    for i in range(300):
        shared[i] = passage = prose(51)
        for doc in (i, 1000 + i):
            rows.append((doc, " ".join(prose(rnd.randint(5, 90)) + passage + prose(rnd.randint(5, 90))), "en", "s", 1))
    out = {r.doc_id: r for r in sentence_spans.dedup(docs(spark, rows)).collect()}
    whole = {r[0]: r[1] for r in rows}
    for i, passage in shared.items():
        a, b = out[i], out[1000 + i]
        assert a.n_removed == 0 and a.clean_text == whole[i]
        gone = whole[1000 + i].split()
        left = b.clean_text.split()
        assert b.n_removed > 0 and len(gone) - len(left) == b.words_removed >= sentence_spans.GRAM
        assert all(w in set(passage) for w in gone if w not in set(left))  # nothing but the passage goes


def test_span_query_on_awkward_rows(spark, awkward):
    got = queries.op4_sentence_spans(spark, awkward).collect()
    assert len(got) == len(AWKWARD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].text is None and by[4][0].text == "" and by[3][0].n_sentences == 0
    # the copy loses everything; its repeated row is the same document
    assert [r.n_removed for r in by[2]] == [by[2][0].n_sentences] * 2 and by[2][0].text == ""
    assert by[1][0].n_removed == 4  # the prose repeats itself three times, each time two sentences of 25 words
    assert sentence_spans.dedup(docs(spark, [])).collect() == []


def test_bitmap_never_misses(spark, monkeypatch):
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([(i * 7, None if i % 5 == 0 else f"k{i}") for i in range(200)], "a bigint, b string")
    rows = spark.createDataFrame([(i, None if i % 35 == 0 else f"k{i // 7}") for i in range(3000)], "a bigint, b string")
    held = {tuple(r) for r in keys.collect()}
    for bits, most in ((32 << 20, 210), (4096, 400), (64, 3000)):
        monkeypatch.setattr(common, "BITMAP_BITS", bits)
        got = common.maybe_in(rows, common.bitmap(keys, F.col("a"), F.col("b")), F.col("a"), F.col("b")).collect()
        assert len(got) == 3000 and all(r[2] for r in got if (r[0], r[1]) in held) and sum(r[2] for r in got) <= most


# exact top-k


def brute_topk(rows, k=10):
    """Every row is a query and a candidate of its own, whatever its id."""
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows]
    out = []
    for at, (q, asked) in enumerate(whole):
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(asked, v)), i) for j, (i, v) in enumerate(whole) if j != at and len(v) == len(asked))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "ties", "large", "few", "repeated"])
def test_topk_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(exact_topk, "SEED", 50)
    monkeypatch.setattr(exact_topk, "TILE", 16)
    monkeypatch.setattr(exact_topk, "BLOCK", 3)
    monkeypatch.setattr(exact_topk, "RANGE", 60)
    rng = np.random.default_rng(8)
    n = {"few": 4}.get(kind, 500)
    make = {"normal": lambda: rng.normal(size=8) * rng.exponential(), "ties": lambda: rng.integers(-1, 2, 8) * 1.0, "large": lambda: rng.normal(size=8) * 1e5}.get(kind, lambda: rng.normal(size=8))
    rows = [(i % 40 * 25 if kind == "repeated" else i * 25, make().tolist()) for i in range(n)]
    rows += rows[:5]  # whole rows too
    bad = [(5001, None), (5100, [1.0, None] * 4), (5200, [float("nan")] * 8), (5300, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>")
    got = sorted(tuple(r) for r in exact_topk.topk(clashing(df, "x", "length", "d", "score", "row", "range", "block")).collect())
    assert got == brute_topk(rows)


def test_topk_keeps_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in exact_topk.topk(df).collect()) == [(0, 1, 1, 3 << 20), (0, 2, 1, 2 << 20), (0, 3, 2, 1 << 20)]


def test_topk_of_many_ranges_and_blocks(spark, monkeypatch):
    # lengths of a wide spread, so that most pairs of block and range are left out
    monkeypatch.setattr(exact_topk, "SEED", 20)
    monkeypatch.setattr(exact_topk, "TILE", 16)
    monkeypatch.setattr(exact_topk, "BLOCK", 4)
    monkeypatch.setattr(exact_topk, "SEED", 20)
    monkeypatch.setattr(exact_topk, "TILE", 16)
    rng = np.random.default_rng(3)
    rows = {i: ([0.0] * (i % 8) + [float(rng.integers(400, 404))] + [0.0] * (7 - i % 8) if i % 2 else (rng.normal(size=8) * rng.lognormal()).tolist()) for i in range(3000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id bigint, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        got = sorted(tuple(r) for r in exact_topk.topk(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_topk(list(rows.items()))


def test_topk_of_several_dimensions_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (100, [1.0]), (101, [2.0]), (200, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r)[:3] for r in exact_topk.topk(df).collect()) == [(0, 1, 1), (100, 1, 101)]
    assert exact_topk.topk(df.limit(0)).collect() == []


def test_search_skips_short_vectors():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(1000, 8)) * 100)
    rows = rows[np.argsort(-np.linalg.norm(rows, axis=1))]
    s = exact_topk.Search(np.array([-1]), np.floor(rng.normal(size=(1, 8)) * 100), exact_topk.rotation(rows), np.full(1, -np.inf), 5)
    for at in range(0, 1000, 50):
        if not s.tile(np.arange(at, at + 50), np.arange(at, at + 50), rows[at : at + 50]):
            break
    assert s.pairs_scored < 600


# mixture


def test_mixture_meets_weights_and_limit(spark):
    rows = [(i, "w " * (5 + i % 7), "en", src, 1) for i, src in enumerate(["big"] * 600 + ["mid"] * 200 + ["small"] * 40 + [None] * 10)]
    df = docs(spark, rows)
    out = mixing.mix(clashing(df, "epoch", "block"), max_repeats=3.0)
    assert out.columns == [*df.columns, "extra", *mixing.ADDED]
    got = out.collect()
    own = {s: sum(5 + i % 7 for i, _, _, t, _ in rows if t == s) for s in ("big", "mid", "small", None)}
    taken = {s: sum(r.n_tokens for r in got if r.source == s) for s in own}
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert taken["big"] == own["big"] and 2.9 * own[None] <= taken[None] <= 3 * own[None] + 1
    whole = sum(own.values())
    shares = {s: n / whole for s, n in own.items()}
    alpha = 1 - np.log(3) / np.log(max(shares.values()) / min(shares.values()))
    for s in own:
        assert taken[s] / own[s] == pytest.approx((max(shares.values()) / shares[s]) ** (1 - alpha), abs=0.06)
    # an epoch passes each text once, the last one a part
    for s in own:
        for epoch in range(1, 4):
            ids = [r.doc_id for r in got if r.source == s and r.epoch == epoch]
            assert len(ids) == len(set(ids))
    assert len({r.order_key for r in got}) == len(got)


def test_mixture_to_entropy_and_budget(spark):
    rows = [(i, "w " * 10, "en", s, 1) for i, s in enumerate(["a"] * 900 + ["b"] * 90 + ["c"] * 10)]
    df = docs(spark, rows)
    got = mixing.mix(df, target_entropy=0.8, max_repeats=None, budget=2000).collect()
    taken = np.array([sum(r.n_tokens for r in got if r.source == s) for s in "abc"], dtype=float)
    assert abs(taken.sum() - 2000) < 40
    p = taken / taken.sum()
    assert -(p * np.log(p)).sum() == pytest.approx(0.8, abs=0.03)
    assert mixing.exponent(df.limit(0).selectExpr("1.0D as share").unionByName(spark.createDataFrame([(0.5,), (0.5,)], "share double")), None, 2.0) == 0.0
    assert mixing.exponent(spark.createDataFrame([(0.9,), (0.1,)], "share double"), None, None) == 1.0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \t\n\x0b\x0c\rw$\\1\x1c\x85\xa0\u2003é\U0001f600"), max_size=30), min_size=1, max_size=20))
def test_words_are_counted_without_arrays(spark, texts):
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string").select("i", mixing.tokens(F.col("t")).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {-1: 0, **{i: len(re.findall("[^\x20\x09-\x0d]+", t)) for i, t in enumerate(texts)}}
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_staged_tables_have_no_checksum_files(spark):
    staged = common.stage(spark.range(100).repartition(3), "plain")
    assert staged.count() == 100
    folder = Path(staged._hopline_path.removeprefix("file:"))
    assert sum(1 for _ in folder.glob("part-*")) == 3 and not list(folder.rglob(".*.crc"))


def test_mixture_edges(spark):
    rows = [(1, None, "en", "none", 1), (2, "", "en", "none", 1), (None, "a b", "en", "s", 1), (3, "a b c", "en", "s", 1), (3, "a b c", "en", "s", 1)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert sorted(((r.doc_id or -1), r.n_tokens, r.epoch) for r in got) == [(-1, 2, 1), (1, 0, 1), (2, 0, 1), (3, 3, 1), (3, 3, 1)]


# factorisation machine


def test_pairwise_part_is_linear_in_time():
    rng = np.random.default_rng(0)
    size = factor_machine.WORDS + factor_machine.STATS + factor_machine.BUCKETS
    m = factor_machine.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, 3)), np.zeros(factor_machine.STATS), np.ones(factor_machine.STATS))
    rows = [factor_machine.features(t) for t in (b"one two three.\nfour", b"", b"a a b !! ##")]
    x = factor_machine.Sparse(rows, m.mean, m.scale)
    margin = x.margin(m)[0]
    for i in range(3):
        at = np.flatnonzero(x.row == i)
        want = m.bias + sum(m.w[x.places[a]] * x.values[a] for a in at)
        want += sum(float(m.v[x.places[a]] @ m.v[x.places[b]]) * x.values[a] * x.values[b] for a, b in itertools.combinations(at, 2))
        assert margin[i] == pytest.approx(want)


def test_quality_is_learned(spark, tmp_path):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["the", "river", "was", "calm", "and", "they", "slept"]) for _ in range(40)).capitalize() + "."
    junk = lambda: " ".join(rnd.choice(["BUY", "NOW", "$$$", "win", "###"]) + "!!" for _ in range(40))
    rows = [(i, junk() if i % 4 == 0 else good(), "en", "s", 1) for i in range(400)]
    write(spark, str(tmp_path), rows + [(1000, None, None, None, None), (1001, "", None, None, None)])
    write(spark, str(tmp_path), [(i, int(i % 4 != 0)) for i in range(400)] + [(5, None), (None, 1), (7, 9)], "doc_id bigint, quality int", "labels")
    got = queries.op6_factor_machine(spark, str(tmp_path)).collect()
    assert len(got) == 402
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.97


def test_quality_on_awkward_rows(spark, awkward):
    assert len(queries.op6_factor_machine(spark, awkward).collect()) == len(AWKWARD)
    df = docs(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    from pyspark.sql import functions as F

    machine = factor_machine.train(df, none, F.lit(True))
    assert {round(r.score, 3) for r in factor_machine.score(clashing(df, "score", "Predicted"), machine).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1), (9, 1)], "doc_id bigint, quality int")
    assert {r.predicted for r in factor_machine.score(df, factor_machine.train(df, ones, F.lit(True))).collect()} == {1}
    assert factor_machine.score(df.limit(0), machine).collect() == []


# language


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=4), st.integers(0, 10**6))
def test_forward_backward_against_enumeration(lengths, seed):
    rng = np.random.default_rng(seed)
    lengths, labels = np.array(lengths), 3
    words = rng.integers(0, 5, lengths.sum())
    scores, moves, start = rng.normal(size=(5, labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels)
    chains = crf_language.Chains(words, lengths)
    posterior, total, expected = chains.passes(scores[chains.words], moves, start, pairs=True)
    want, pairs, z, at = np.zeros((len(words), labels)), np.zeros((labels, labels)), 0.0, 0
    for n in lengths.tolist():
        own = words[at : at + n]
        paths = {y: np.exp(start[y[0]] + sum(scores[w, b] for w, b in zip(own, y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product(range(labels), repeat=n)} if n else {}
        s = sum(paths.values())
        z += np.log(s) if n else 0.0
        for y, p in paths.items():
            for i, b in enumerate(y):
                want[at + i, b] += p / s
            for a, b in zip(y, y[1:]):
                pairs[a, b] += p / s
        at += n
    if len(words):
        assert np.allclose(posterior[chains.slot], want) and np.allclose(expected, pairs) and total == pytest.approx(z)


SAMPLES = {
    "en": "the river was calm and they slept through the whole night without a sound",
    "de": "der Fluss war ruhig und sie schliefen die ganze Nacht ohne einen Laut",
    "fr": "la rivière était calme et ils dormaient toute la nuit sans un bruit",
}


def test_languages_are_learned(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        lang = ["en", "de", "fr"][i % 3]
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(rnd.choice(words) for _ in range(20)), lang, "s", 1))
    rows += [(900, None, "en", "s", 1), (901, "123 !!", None, "s", 1), (902, SAMPLES["de"] + " . " + SAMPLES["de"] + " the night", None, "s", 1)]
    write(spark, str(tmp_path), rows)
    got = {r.doc_id: r for r in queries.op10_crf_language(spark, str(tmp_path)).collect()}
    assert len(got) == 303
    for i in range(300):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [i for i in range(300) if got[i].held_out]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und")
    assert got[902].lang_pred == "de" and got[902].score < 1


def test_words_of_two_languages_switch():
    model = crf_language.fit([(lang, piece) for lang, t in SAMPLES.items() for piece in crf_language.pieces_of((t + " ") * 20)])
    known = crf_language.WordIds()
    words = crf_language.LETTERS.findall((SAMPLES["en"] + " " + SAMPLES["fr"]).lower())
    chains = crf_language.Chains(np.array([known[w] for w in words]), np.array([len(words)]))
    posterior, _, _ = chains.passes(model.word_scores(known)[chains.words], model.moves, model.start)
    best = [model.languages[i] for i in posterior.argmax(1)]
    n = len(SAMPLES["en"].split())
    assert best[2 : n - 2] == ["en"] * (n - 4) and best[n + 2 :] == ["fr"] * (len(words) - n - 2)
    assert (np.diag(model.moves) > model.moves.mean(1)).all()


def test_language_on_awkward_rows(spark, awkward):
    got = queries.op10_crf_language(spark, awkward).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    from pyspark.sql import functions as F

    df = docs(spark)
    nothing = crf_language.train(df.filter("false"), F.lit(True))
    assert {(r.lang_pred, r.score) for r in crf_language.predict(clashing(df, "lang_pred", "score"), nothing).collect()} == {("und", 0.0)}
    one = crf_language.train(df.filter("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in crf_language.predict(df, one).collect()} == {"en", "und"}
    assert crf_language.predict(df.limit(0), one).collect() == []


def test_pieces_come_from_all_over_a_text():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(10_000)]
    got = crf_language.pieces_of(" ".join(words))
    assert len(got) == crf_language.TEXT_PIECES and got[0] == words[:30] and words.index(got[-1][0]) > 9000
    assert crf_language.pieces_of("a b") == [["a", "b"]] and crf_language.pieces_of("1 2") == []


def test_language_sample_is_bounded(spark, monkeypatch):
    """A dirty column of languages, rows that are all alike, null ids and a very long text."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(crf_language, "LANGUAGES", 3)
    monkeypatch.setattr(crf_language, "SAMPLE_DOCS", 20)
    seen = []
    monkeypatch.setattr(crf_language, "fit", lambda pieces: seen.append(pieces))
    long = " ".join([SAMPLES["de"]] * 14_000)
    assert len(long) > 900_000
    rows = [(None, SAMPLES["en"], "en", "s", 1)] * 3000 + [(7, SAMPLES["fr"], "fr", "s", 1)] * 2000 + [(8, long, "de", "s", 1)] * 3 + [(i, "x y", f"l{i}", "s", 1) for i in range(10_000)]
    crf_language.train(docs(spark, rows), F.lit(True))
    by = Counter(lang for lang, _ in seen[0])
    assert by["en"] == by["fr"] == 20 and by["de"] == min(3 * crf_language.TEXT_PIECES, crf_language.PIECES) and len(by) == 3


def test_long_texts_train_too(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    monkeypatch.setattr(factor_machine, "fit", lambda rows, labels: seen.append((rows, labels)))
    df = docs(spark, [(1, "word " * 200_000, "en", "s", 1), (2, "short text", "en", "s", 1)])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    factor_machine.train(df, labels, F.lit(True))
    (rows, marks), = seen
    assert len(rows) == 2 and marks.tolist() == [1, 0]


def plain_machine(rows, labels):
    """The loss of a factorisation machine and its slopes, pair by pair."""
    m = factor_machine.fit(rows, labels)
    x = np.zeros((len(rows), factor_machine.WORDS + factor_machine.STATS + factor_machine.BUCKETS))
    for i, (words, stats, bucket) in enumerate(rows):
        for w in words:
            x[i, w] += 1 / np.sqrt(max(1, len(words)))
        x[i, factor_machine.WORDS : factor_machine.WORDS + factor_machine.STATS] = np.clip((np.array(stats) - m.mean) / m.scale, -4, 4) / np.sqrt(factor_machine.STATS)
        x[i, factor_machine.WORDS + factor_machine.STATS + bucket] = 0.5
    used = np.flatnonzero(x.any(0))
    x = x[:, used]
    pairs = sum((m.v[used[i]] @ m.v[used[j]]) * x[:, i] * x[:, j] for i in range(len(used)) for j in range(i + 1, len(used)))
    return m, 1 / (1 + np.exp(-(m.bias + x @ m.w[used] + pairs)))


def test_training_lowers_the_loss_and_scores_are_those_of_all_pairs():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["sun", "sea", "hill"] if i % 2 else ["spam", "win", "$$"]) + str(rnd.randrange(2)) for _ in range(8)) for i in range(40)]
    rows = [factor_machine.features(t.encode()) for t in texts]
    labels = np.array([i % 2 for i in range(40)], dtype=float)
    m, want = plain_machine(rows, labels)
    assert np.allclose(m.scores(rows), want, atol=1e-5)
    loss = -np.mean(labels * np.log(want) + (1 - labels) * np.log(1 - want))
    assert loss < 0.2 < np.log(2)


# columns that clash, and empty tables


def test_columns_of_the_same_names_are_replaced(spark):
    import public_tokenizers as P

    from hopline.llm import byte_bpe, secret_scan, token_counts

    df = docs(spark)
    model, ranks = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
    cases = {
        "count": (lambda x: token_counts.count(x, model), ["n_bytes", "N_Tokens", "over_limit"]),
        "scan": (secret_scan.scan, ["Spans"]),
        "encode": (lambda x: byte_bpe.encode(x, ranks, P.PATTERN, decoded="decoded"), ["Token_ids", "decoded"]),
        "prints": (simhash.fingerprints, ["Fingerprint"]),
    }
    for name, (run, added) in cases.items():
        plain, mine = run(df), run(clashing(df, *added))
        assert [c for c in mine.columns if c != "extra"] == plain.columns and "extra" in mine.columns, name
        key = lambda r: (str(r.doc_id), len(r.text or ""), str(r.text)[:99])
        assert sorted(map(str, mine.drop("extra", "text").collect())) == sorted(map(str, plain.drop("text").collect())), (name, key)
        assert run(clashing(df, *added).limit(0)).collect() == []
    prints = common.stage(simhash.fingerprints(df).drop("text"), "prints")
    plain, mine = simhash.classes(prints), simhash.classes(clashing(prints, "Cluster", "component_ID"))
    assert sorted(map(str, mine.drop("extra").collect())) == sorted(map(str, plain.collect())) and plain.count() == len(AWKWARD)
    assert simhash.classes(prints.limit(0)).collect() == []


def test_mixture_of_equal_rows(spark):
    """Rows alike in all: of those at the end of a quota as many pass as fit, and the whole is that of distinct rows."""
    rows = [(1, "a b c", "en", "small", 1)] * 40 + [(i, "a b c", "en", "big", 1) for i in range(100, 400)]
    out = mixing.mix(docs(spark, rows), max_repeats=2.0).collect()
    by = Counter((r.source, r.epoch) for r in out)
    assert by["big", 1] == 300 and by["small", 1] == 40 and sum(n for (s, _), n in by.items() if s == "small") <= 80
    assert [r for r in out if not 1 <= r.epoch <= 3] == []


# pipeline


def test_pipeline_against_its_parts(spark, tmp_path):
    rnd = random.Random(6)
    fresh = lambda: " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(2, 8))) for _ in range(80))
    texts = [fresh() for _ in range(12)]
    rows = [(i, t, "en", "big" if i < 9 else "small", len(t)) for i, t in enumerate(texts)]
    rows += [(50, texts[0], "en", "big", 1), (51, texts[1] + " end", "en", "big", 1), (52, "too short", "en", "big", 1), (53, None, "en", None, None)]
    rows += [(60, fresh() + " password=abcdef123456 done", "en", "small", 1)]
    path = str(tmp_path)
    write(spark, path, rows)
    seen = spark.read.parquet(f"{path}/documents.parquet")
    sizes = []
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, seen, path)
        if name != "byte-level BPE":
            assert out.columns == SCHEMA.replace(",", "").split()[::2]
        seen = common.stage(out, "t")
        sizes.append((name, {r.doc_id for r in seen.select("doc_id").collect()}))
    got = dict(sizes)
    assert got["quality rules"] == {*range(12), 50, 51, 60}
    near = {51} if (plain_print(texts[1]) ^ plain_print(texts[1] + " end")).bit_count() > 3 else set()
    assert got["SimHash near-dedup"] == got["secret scans"] == got["mixing sources"] == {*range(12), 60} | near
    final = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in final.collect()} == got["byte-level BPE"] == {*range(12), 60} | near
    assert set(final.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_nothing(spark, tmp_path):
    write(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_pipeline_of_awkward_rows(spark, awkward):
    assert corpus_pipeline.run(spark, awkward).count() == 0  # all are short or repeat themselves
