import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmill.llm import bpe, decontaminate, matroska, near_dedup, pieces, queries, recompress, token_files, toxicity
from strandmill.llm import words as words_
from strandmill.llm.words import ALNUM, SPACED, runs, words
from tests.llm.conftest import MORSE

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nabAB09é🎉.-'", max_size=40)), max_size=6)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_words(texts):
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    for inside, lower, pattern in ((SPACED, True, r"[^\x20\x09-\x0D]+"), (ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = words(pa.array(texts, pa.string()), inside, lower)
        got = [[low(bytes(w.data[a:b]).decode()) for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in zip(w.docs, w.docs[1:], strict=False)]
        want = [re.findall(pattern, low(t or "")) for t in texts]
        assert got == want
        flat = [x for t in want for x in t]
        assert len(set(zip(flat, w.hash.tolist(), strict=True))) == len(set(flat)) == len(set(w.hash.tolist()))
        h, at = runs(w.hash, w.docs, 2)
        assert len(h) == sum(max(0, len(t) - 1) for t in want)


PIECES = ["a", " ", "  ", "\n", "\t", "'s", " ", "é", "é", "Σ", "İ", "ﬁ", "<|endoftext|>", "<|startoftext|>", "1", "22", "\x1c", ".", "!!", "🎉", "word", " the", "\r\n", "가", "<|"]


def odd_texts(n):
    rng = random.Random(n)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def split(ids, count):
    at = np.concatenate([[0], np.cumsum(count)])
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


@pytest.mark.parametrize("chunk", [8, 128])
def test_bpe_equals_the_library(chunk):
    from tokenizers import Tokenizer

    texts = [*odd_texts(800), "x" * 5000, " " * 3000, ""]
    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    own = bpe.Coder(path, chunk)
    ids, count = own.encode(pa.array(texts))
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    assert split(ids, count) == [e.ids for e in want]
    assert [x.decode() for x in own.decode(ids, count)] == library.decode_batch([e.ids for e in want], skip_special_tokens=False)
    again, _ = own.encode(pa.array(texts))  # from the tables this time
    assert (again == ids).all()


def test_words_are_exact_pieces():
    from tokenizers import Tokenizer

    near = ["Word", "é", "É", "ß", "×", "÷", "µ", "'ll", ",", "...", "$%&", "#", "1", "²", "\u0301", "\u0338", "</w>", " ", "=", "日本", "-", "<|endoftext|>"]
    rng = random.Random(5)
    texts = [*odd_texts(800), *("".join(rng.choice(near) for _ in range(30)) for _ in range(2000)), "a," * 40_000, "a" * 70_000 + "," * 70_000, "", ","]
    path = queries.tokenizer("word_bpe_49k.json")
    ids, count = token_files.encoded(pa.array(texts), path, None)
    assert split(ids, count) == [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=60))
@settings(max_examples=60, deadline=None)
def test_packing(bits, ids):
    x = np.array([i % 2**bits for i in ids], np.uint32)
    assert (token_files.unpack(token_files.pack(x, bits), len(x), bits) == x).all()


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    counts = np.array([0, 5, 0, 40, 1, 100])
    ids = rng.integers(0, 5000, counts.sum()).astype(np.uint32)
    p = tmp_path / "a.smtb"
    p.write_bytes(token_files.to_bytes(np.arange(6), np.zeros(6, bool), counts, ids, 13, block=16))
    with p.open("rb") as f:
        r = token_files.Reader(f)
        for i in (5, 0, 3, 1):
            assert r.document(i).tolist() == ids[counts[:i].sum() : counts[: i + 1].sum()].tolist()
    with pytest.raises(ValueError, match="bits"):
        token_files.to_bytes(np.arange(1), np.zeros(1, bool), np.array([1]), np.array([9000], np.uint32), 13)


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(data):
    payload = matroska.padded(data)
    media = matroska.write(payload)
    m = matroska.parse(media)
    assert b"".join(media[p.offset : p.offset + p.size] for p in m.packets) == payload
    assert [c[2] for c in m.cues] == m.clusters and m.tracks == [(1, 2, "A_PCM/INT/LIT")]
    assert [p.time_ns for p in m.packets] == [72_000_000 * i for i in range(len(payload) // 576)] and all(p.key for p in m.packets)
    assert [c[0] * 1_000_000 for c in m.cues] == [next(p.time_ns for p in m.packets if p.cluster == i) for i in range(len(m.clusters))]
    # the same times follow from the samples, without a default duration
    plain = media.replace(matroska.element(matroska.EACH, (72_000_000).to_bytes(4, "big")), matroska.element(0xEC, b"\0" * 6))
    assert [p.time_ns for p in matroska.parse(plain).packets] == [p.time_ns for p in m.packets]


def test_lacing_groups_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 10, b"c" * 700, b"d"]
    e = matroska.element
    for lacing in (matroska.XIPH, matroska.EBML_LACING):
        body = matroska.block_body(3, -5, frames, lacing)
        cluster = e(matroska.TIME, b"\x64") + e(matroska.GROUP, e(matroska.BLOCK, body) + e(0x9B, b"\x08")) + e(matroska.GROUP, e(matroska.BLOCK, body) + e(0xFB, b"\x01"))
        one = b"\x1f\x43\xb6\x75\x01\xff\xff\xff\xff\xff\xff\xff" + cluster
        data = e(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + one + one
        got = matroska.parse(data)
        assert [data[p.offset : p.offset + p.size] for p in got.packets] == frames * 4
        # eight ticks shared by four packets; without a duration all have the block's time
        assert [(p.track, p.time_ns, p.key) for p in got.packets[:8]] == [(3, 95_000_000 + 2_000_000 * i, True) for i in range(4)] + [(3, 95_000_000, False)] * 4 and len(got.clusters) == 2
    with pytest.raises(ValueError, match="runs over|cut off"):
        matroska.parse(matroska.write(b"x" * 576)[:-20])


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    for n in (3, 40, 2000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        a, b = np.sort(base), np.sort(np.concatenate([base[n // 5 :], rng.integers(0, 2**63, n // 5, dtype=np.uint64)]))
        s = near_dedup.sketches(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        k = n - n // 5
        assert abs(near_dedup.estimate(s[:1], s[1:])[0] - k / (2 * n - k)) < 0.2


def test_landmarks_are_local():
    """Equal windows have equal landmarks whatever surrounds them."""
    rng = np.random.default_rng(5)
    for vocabulary in (2, 30, 10**6):
        inner = rng.integers(0, vocabulary, 120).astype(np.uint64)
        found = []
        for _ in range(6):
            a, b = (rng.integers(0, vocabulary, rng.integers(0, 60)).astype(np.uint64) for _ in range(2))
            h = np.concatenate([a, inner, b])
            found.append(recompress.landmarks(h, np.array([0, len(h)]), len(a) + np.arange(71), 50).tolist())
        assert all(f == found[0] for f in found)


def test_trees_and_isotonic():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 1)).astype(float)
    t = toxicity.Trees(rounds=30).fit(x[:2000], y[:2000])
    assert ((t.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    xs, ys = toxicity.isotonic(t.margin(x[:2000]), y[:2000])
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all() and 0 < ys[0] < ys[-1] < 1


@pytest.fixture
def weak(monkeypatch):
    """Hashes of three bits: nearly all collide."""
    whole = words_.hashes
    for module in (words_, pieces, bpe):
        monkeypatch.setattr(module, "hashes", lambda e, a, b: whole(e, a, b) & np.uint64(7))


def test_colliding_hashes_change_no_ids(weak):
    from tokenizers import Tokenizer

    texts = [*odd_texts(150), *MORSE, f"{MORSE[0]} and {MORSE[1]}", "the same the same tone"]
    path = queries.tokenizer("byte_bpe_50k.json")
    own = bpe.Coder(path, 32)
    own.words.table.clear()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    for known in (("", [], []), ("some", ["the same", " the"], [np.array([1169, 976]), np.array([262])])):
        assert split(*own.learn(known).encode(pa.array(texts))) == want
    path = queries.tokenizer("word_bpe_49k.json")
    pieces.encoder(path, "<|startoftext|>").table.clear()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    assert split(*token_files.encoded(pa.array(texts), path, None)) == want


def test_colliding_hashes_change_no_hits(weak):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(30)]
    items = pa.table({"item_id": pa.array([1, 2, 3]), "text": pa.array([" ".join(rng.choices(vocabulary, k=n)) for n in (20, 4, 15)])})
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(20)] + [f"a {t.as_py()} b" for t in items["text"]]
    w = decontaminate.Windows(items, 6, 2)
    keys = {k: decontaminate.Keys(h) for k, (h, _) in w.shingles.items()}
    index = decontaminate.Index(w, keys, {k: np.ones(len(x.sorted), np.int64) for k, x in keys.items()})
    t = words(pa.array(texts), ALNUM, lower=True)
    got = {(int(s), w.names[i]) for s, x in zip(*index.hits(t, t.docs), strict=True) for i in w.owner[w.owners[x] : w.owners[x + 1]]}
    want = set()
    for name, item in zip("123", items["text"].to_pylist(), strict=True):
        own = item.split()
        for s in range(max(1, len(own) - 5)):
            for d, text in enumerate(texts):
                there = text.split()
                want |= {(int(t.docs[d]) + i, name) for i in range(len(there)) if there[i : i + len(own[s : s + 6])] == own[s : s + 6]}
    assert got == want and len(want) >= 26


def test_collisions_are_seen(weak):
    assert words_.collide(words(pa.array(["a b c d e f g h i j"]), SPACED, True), 4)
    w = words(pa.array([f"x {m} y z" for m in MORSE]), SPACED, True)
    assert len(near_dedup._word_set(w, 0, 4) | near_dedup._word_set(w, 1, 4)) == 2


def test_hashes_tell_what_polynomials_do_not():
    w = words(pa.array([*MORSE, " ".join(MORSE[0]), " ".join(MORSE[1])]), SPACED, False)
    assert w.hash[0] != w.hash[1] and len({tuple(x) for x in words_.text_names(w).tolist()}) == 4 and not words_.collide(w, 4)
    flat, start, end = words_.joined(words(pa.array(["  A b ", None, "a\tB"]), SPACED, True))
    assert bytes(flat) == b"a ba b" and start.tolist() == [0, 2, 3, 5] and end.tolist() == [1, 3, 4, 6]
    one = words_.text_names(words(pa.array(["  A b ", None, "a\tB", " "]), SPACED, True))
    assert (one[0] == one[2]).all() and (one[1] == one[3]).all() and (one[0] != one[1]).any()
