"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

A lexicon is learned first: words, and word beginnings of 4 to 6 bytes, that labelled toxic training texts hold far more
often than clean ones. The dense features are lexicon densities (plain and after undoing obfuscation), closeness of lexicon
words to the second person, capitals, punctuation and obfuscation rates, and lengths. Lexicon and trees are fitted on three
quarters of the training sample, by a hash of doc_id, and the isotonic map from margins to probabilities on the rest, which
neither has seen.

The training sample has at most ``most_rows`` labelled documents, those with the smallest hashes of ``doc_id``; only they are
used for learning, and every text is scored. Labels, language, source and doc_id are no inputs of a score. Null texts score as
empty ones. Rows of labels whose doc_id or label is null or that match no document are left out before anything is counted; of
repeated labels of a document the largest counts, and of several texts of one doc_id the smallest is learned from; repeated
documents are scored alike, and empty tables give no rows. Without labels of both kinds every score is their share of toxic
ones (0 if there are none). Other columns are ignored, but ``keep`` carries them along: one with a name of the result's own
comes back with "_in" behind it. A text takes some 150 bytes of memory for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.words import ALNUM, SPACED, buffer, carried, hashes, sliced, small_batches, words
from strandmill.session import cut, ship, uncut

MOST_ROWS, THRESHOLD, LEXICON, LEAST_DOCS = 20_000, 0.3, 1000, 4
BEGINNINGS = (4, 5, 6)

# Second-person words of the four languages.
SECOND_PERSON = """
you your yours yourself yourselves thou thee thy u ur
du dich dir dein deine deinen deinem deiner ihr euch euer eure
tu te toi ton ta tes vous votre vos
tú ti tuyo tuya usted ustedes vosotros vuestro
""".split()

# Characters that often stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

FEATURES = [
    "log_words", "log_bytes", "word_length", "lexicon_rate", "lexicon_log_count", "lexicon_log_odds", "beginning_rate", "beginning_log_count", "beginning_log_odds",
    "plain_again_rate", "second_person_rate", "near_second_person", "capital_rate", "all_capitals_rate", "exclamation_rate", "question_rate", "punctuation_rate", "symbol_rate", "digit_rate", "mixed_word_rate", "repeated_letter_rate", "other_bytes_rate",
]


def _hashes(texts: list[str]) -> np.ndarray:
    return np.unique(words(pa.array(texts), ALNUM, lower=True).hash)


def _mapping() -> tuple[np.ndarray, np.ndarray]:
    to = np.arange(256, dtype=np.uint8)
    for a, b in STANDS_FOR.items():
        to[ord(a)] = ord(b)
    drop = np.zeros(256, bool)
    drop[[ord(c) for c in ".-_*'"]] = True
    return to, drop


_TO, _DROP = _mapping()


def terms(w) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes) of the whole words and of each length of beginnings."""
    size = w.end - w.start
    out = [(np.arange(len(w.hash)), w.hash)]
    for k in BEGINNINGS:
        at = np.flatnonzero(size > k)
        out.append((at, hashes(w.eight, w.start[at], w.start[at] + k) ^ np.uint64(k)))
    return out


@dataclass
class Lexicon:
    keys: list[np.ndarray]  # sorted hashes for each kind of term
    odds: list[np.ndarray]

    def find(self, kind: int, h: np.ndarray) -> np.ndarray:
        """The log-odds of each hash, 0 for those not in the lexicon."""
        keys = self.keys[kind]
        if not len(keys):
            return np.zeros(len(h))
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[i] == h, self.odds[kind][i], 0.0)


def _again(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """Texts with look-alike characters mapped to letters and separators within words dropped."""
    keep = ~_DROP[raw]
    ends = np.concatenate([[0], np.cumsum(keep)])[at]
    data = _TO[raw[keep]]
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


_second: np.ndarray | None = None


def features(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row for each text, a column for each of FEATURES."""
    global _second
    if _second is None:
        _second = _hashes(SECOND_PERSON)
    raw, at = buffer(column)
    d = len(at) - 1
    w = words(column, ALNUM, lower=True)
    doc = np.repeat(np.arange(d), w.count())
    n, size = np.maximum(w.count(), 1).astype(float), np.maximum(np.diff(at), 1).astype(float)
    per = lambda who, weight=None: np.bincount(doc[who], weight, minlength=d)
    x = np.zeros((d, len(FEATURES)))
    put = lambda name, value: x.__setitem__((slice(None), FEATURES.index(name)), value)
    put("log_words", np.log1p(w.count()))
    put("log_bytes", np.log1p(np.diff(at)))
    put("word_length", per(slice(None), (w.end - w.start).astype(float)) / n)
    kinds = terms(w)
    odds = lexicon.find(0, kinds[0][1])
    hit = np.flatnonzero(odds)
    put("lexicon_rate", per(hit) / n)
    put("lexicon_log_count", np.log1p(per(hit)))
    put("lexicon_log_odds", per(hit, odds[hit]) / n)
    best = np.zeros(len(w.hash))
    for i, (which, h) in enumerate(kinds[1:], 1):
        best[which] = np.maximum(best[which], lexicon.find(i, h))
    begins = np.flatnonzero(best)
    put("beginning_rate", per(begins) / n)
    put("beginning_log_count", np.log1p(per(begins)))
    put("beginning_log_odds", per(begins, best[begins]) / n)
    again = words(_again(raw, at), ALNUM, lower=True)
    put("plain_again_rate", np.bincount(np.repeat(np.arange(d), again.count()), lexicon.find(0, again.hash) > 0, minlength=d) / n)
    near = np.isin(w.hash, _second)
    put("second_person_rate", per(np.flatnonzero(near)) / n)
    close = np.zeros(len(w.hash) + 10)
    for i in range(11):  # five words to either side
        close[i : i + len(w.hash)] += near
    both = np.unique(np.concatenate([hit, begins]))
    put("near_second_person", per(both[close[both + 5] > 0]) / n)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    upper = (raw >= 65) & (raw <= 90)
    letter = upper | ((raw >= 97) & (raw <= 122))
    digit = (raw >= 48) & (raw <= 57)
    put("capital_rate", total(upper) / size)
    uppers = np.concatenate([[0], np.cumsum(upper)])
    length = w.end - w.start
    put("all_capitals_rate", per(np.flatnonzero((uppers[w.end] - uppers[w.start] == length) & (length > 1))) / n)
    put("exclamation_rate", total(raw == 33) / size)
    put("question_rate", total(raw == 63) / size)
    put("punctuation_rate", total((raw == 46) | (raw == 44) | (raw == 59) | (raw == 58)) / size)
    put("symbol_rate", total((raw > 32) & (raw < 127) & ~letter & ~digit) / size)
    put("digit_rate", total(digit) / size)
    spaced = words(column, SPACED, lower=False)
    letters, others = np.concatenate([[0], np.cumsum(letter)]), np.concatenate([[0], np.cumsum(digit | np.isin(raw, [64, 36, 33, 42, 124]))])
    inner = np.maximum(spaced.end - 1, spaced.start)
    mixed = (letters[spaced.end] - letters[spaced.start] >= 2) & (others[inner] - others[spaced.start] >= 1)
    put("mixed_word_rate", np.bincount(np.repeat(np.arange(d), spaced.count()), mixed, minlength=d) / n)
    same = np.zeros(len(raw), bool)
    same[2:] = letter[2:] & (raw[2:] == raw[1:-1]) & (raw[2:] == raw[:-2])
    put("repeated_letter_rate", total(same) / size)
    put("other_bytes_rate", total(raw >= 128) / size)
    return x.astype(np.float32).astype(float)  # as training rows are sent, so that equal values fall on one side of a split


class Trees:
    """Gradient boosting of the logistic loss on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        self.trees = []
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._walk(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.int16)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full binary tree: (feature, bin, value) of its nodes; feature -1 sends all rows left."""
        nodes = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            own = node - first
            best = np.full(width, 1e-6)
            for f in range(b.shape[1]):
                key = own * (self.bins + 1) + b[:, f]
                gs = np.bincount(key, g, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                hs = np.bincount(key, h, width * (self.bins + 1)).reshape(width, -1).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < self.least / 10) | (ht - hl < self.least / 10)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = f
                cut[first : first + width][better] = at[better]
            node = self._step(node, feature, cut, b)
        leaf = np.bincount(node, minlength=nodes)
        value = np.where(leaf > 0, -self.rate * np.bincount(node, g, nodes) / (np.bincount(node, h, nodes) + 1), 0)
        return feature, cut, value

    @staticmethod
    def _step(node: np.ndarray, feature: np.ndarray, cut: np.ndarray, b: np.ndarray) -> np.ndarray:
        f = feature[node]
        right = (f >= 0) & (b[np.arange(len(b)), np.maximum(f, 0)] > cut[node])
        return 2 * node + 1 + right

    def _walk(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        node = np.zeros(len(b), np.int64)
        for _ in range(self.depth):
            node = self._step(node, tree[0], tree[1], b)
        return tree[2][node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + sum((self._walk(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the points of a non-decreasing step map, for np.interp."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == a:
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([b, 1, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = last
    xs, ys = [], []
    for s, n, a, b in blocks:
        value = (s + 0.5 * 0.1) / (n + 0.5)  # drawn a little towards 0.1, so that no score is exactly 0 or 1
        xs += [a, b] if b > a else [a]
        ys += [value, value] if b > a else [value]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    points: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.share)
        m = self.trees.margin(features(column, self.lexicon))
        # a small slope keeps the order of margins within a step of the map
        return np.clip(np.interp(m, *self.points) + 1e-4 * np.tanh(m / 10), 0, 1)


def remainder(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def sample(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, toxic) of the training documents: those labelled whose remainder is not 2, at most most_rows, by the hash of
    doc_id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(F.coalesce(remainder("doc_id"), F.lit(2)) != 2)
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    return there.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)


def learn(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fit the model; the driver gets at most most_rows rows of features and the lexicon's top entries."""
    spark = docs.sparkSession
    ship(spark)
    chosen = spark.createDataFrame(sample(docs, labels, most_rows).collect(), "doc_id long, toxic int")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rest = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 3
    texts = small_batches(cut(joined.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text", rest.cast("int").alias("rest")), "sample"))
    totals = {(r.toxic, r.rest): r.n for r in texts.groupBy((F.col("toxic") > 0).cast("int").alias("toxic"), "rest").agg(F.count("*").alias("n")).collect()}
    n = sum(totals.values())
    share = (totals.get((1, 0), 0) + totals.get((1, 1), 0)) / max(1, n)
    empty = Lexicon([np.zeros(0, np.uint64)] * (1 + len(BEGINNINGS)), [np.zeros(0)] * (1 + len(BEGINNINGS)))
    if share in (0, 1):
        return Model(empty, None, None, share)
    # too few labels for two parts: all serve for both
    apart = all(totals.get((t, r), 0) for t in (0, 1) for r in (0, 1))
    fitted = texts.where("rest = 0") if apart else texts
    n_bad, n_good = (sum(x for (t, r), x in totals.items() if t == kind and (r == 0 or not apart)) for kind in (1, 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            w = words(b.column(1), ALNUM, lower=True)
            toxic = (b.column(0).to_numpy() > 0).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), w.count())
            for kind, (at, h) in enumerate(terms(w)):
                order = np.lexsort((doc[at], h))
                hs, ds = h[order], doc[at][order]
                new = np.ones(len(hs), bool)
                new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
                hs, ds = hs[new], ds[new]
                u, back = np.unique(hs, return_inverse=True)
                bad = np.bincount(back, toxic[ds], len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(bad), pa.array(np.bincount(back, minlength=len(u)) - bad)], ["kind", "term", "bad", "good"])

    odds = F.log(((F.col("bad") + 0.5) / (n_bad + 1)) / ((F.col("good") + 0.5) / (n_good + 1)))
    # of terms with these odds, few are there by chance: the score is odds times the root of what carries them
    top = (
        fitted.mapInArrow(count, "kind int, term long, bad long, good long").groupBy("kind", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(F.col("bad") >= LEAST_DOCS).withColumn("odds", odds).where("odds > 1.5")
        .orderBy((F.col("odds") * F.sqrt("bad")).desc(), "kind", "term").limit(LEXICON).collect()
    )
    keys, weights = [], []
    for kind in range(1 + len(BEGINNINGS)):
        own = sorted((r.term % 2**64, r.odds) for r in top if r.kind == kind)
        keys.append(np.array([k for k, _ in own], np.uint64))
        weights.append(np.array([o for _, o in own]))
    lexicon = Lexicon(keys, weights)
    sent = spark.sparkContext.broadcast(lexicon)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            x = features(b.column(1), sent.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["toxic", "rest", "x"])

    got = texts.mapInArrow(rows, "toxic int, rest int, x binary").collect()
    uncut(texts)
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float32).reshape(len(got), -1).astype(float)
    y, held = np.array([r.toxic > 0 for r in got], float), np.array([r.rest for r in got], bool)
    # rows come in any order; training must not depend on it
    order = np.lexsort((*x.T, y, held))
    x, y, held = x[order], y[order], held[order]
    fit = ~held if apart else np.ones(len(y), bool)
    trees = Trees().fit(x[fit], y[fit])
    after = held if apart else fit
    return Model(lexicon, trees, isotonic(trees.margin(x[after]), y[after]), share)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; keep: other columns to carry along."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns, names = carried(docs, keep, "doc_id, held_out, score, predicted, _text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "_text"):
            s = sent.value.score(b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *(b.column(c) for c in names)], ["doc_id", "score", "predicted", *names])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"), *columns)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names)
    out = small_batches(source).mapInArrow(task, "doc_id long, score double, predicted int" + kinds)
    return out.select("doc_id", F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out"), "score", "predicted", *names)
