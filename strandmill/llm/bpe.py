"""Byte-level BPE by content-defined chunks that are encoded once and joined again.

A rolling hash over bytes cuts each text into chunks (about ``CHUNK_BYTES`` each), so equal passages of different
documents fall into equal chunks wherever they stand. A chunk's body runs from its first safe cut to its last; a safe cut is a
single space or newline between two other characters, where the pre-tokenizer always parts and beyond which it does not look.

1. Spark counts the documents of each body over the whole corpus. The ``MOST_SHARED`` bodies that most documents share are
   encoded once for all, and their table, of bounded size, goes to every worker.
2. Bodies beyond these are encoded once a worker, their words once each, into tables that let the seldom used half go when
   they are full. A table is asked by hash and answers only where the bytes are the same; reuse never changes a result.
3. About each join of bodies a range is encoded anew: from one word before the first body's end to one word after the next
   one's start. It must part exactly at both ends of the gap, and its ids outside the gap must be those of the two bodies.
   Where they disagree the whole text is encoded anew.

Decoding maps ids to bytes, invalid UTF-8 becoming U+FFFD as the library's decoder does.

Null texts are empty and have no ids; repeated rows are kept, an empty table gives no rows, and other columns are ignored. A
text is worked on whole and takes some 60 bytes of memory for each of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm import pieces
from strandmill.llm.words import KEPT, U, buffer, eights, hashes, mix, sliced, small_batches
from strandmill.session import ship

CHUNK_BYTES = 256
#: Bodies that are encoded once for the whole corpus, and the bytes of each at most: 40 MB with their ids at worst, 5 as a rule.
MOST_SHARED, SHARED_BYTES = 1 << 13, 1024
SPECIAL = "<|endoftext|>"
_WINDOW = 8
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def chunk_cuts(raw: np.ndarray, texts: np.ndarray, chunk_bytes: int) -> np.ndarray:
    """Whether a chunk starts at each byte: the rolling hash of the eight bytes before it is a multiple of chunk_bytes."""
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n > _WINDOW:
        value = _BYTE_VALUES[raw]
        h = np.zeros(n - _WINDOW, np.uint64)
        for i in range(_WINDOW):
            h *= U(0x9E3779B97F4A7C17)
            h += value[i : i + n - _WINDOW]
        cut[_WINDOW:n] = mix(h) % U(chunk_bytes) == 0
    cut[texts] = True
    return cut


def safe_cuts(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Whether a safe cut stands before each byte; text ends are."""
    n = len(raw)
    safe = np.zeros(n + 1, bool)
    if n > 2:
        white = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
        mark = (raw == 0x20) | (raw == 0x0A)
        safe[1 : n - 1] = mark[1:-1] & ~white[:-2] & ~white[2:]
        # characters of two or three bytes may be white space by their first byte, and the four separators are too
        odd = (raw >= 0x1C) & (raw <= 0x1F)
        after = odd | (raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3))
        before = odd.copy()
        before[1:] |= (raw[:-1] == 0xC2) & (raw[1:] >= 0x80)
        before[2:] |= (raw[:-2] >= 0xE1) & (raw[:-2] <= 0xE3) & (raw[2:] >= 0x80)
        odd = np.flatnonzero(safe[1 : n - 1] & (before[:-2] | after[2:])) + 1
        if len(odd):
            text = raw.tobytes()
            near = [(_char_before(text, i), _char_at(text, i + 1)) for i in odd.tolist()]
            safe[odd] = [not (a.isspace() or b.isspace()) for a, b in near]
    edge = texts[(texts > 0) & (texts < n)]
    safe[edge - 1] = False  # what follows or precedes lies in another text
    safe[edge] = False
    safe[texts] = True
    return safe


def _char_before(text: bytes, i: int) -> str:
    j = i - 1
    while j > 0 and text[j] & 0xC0 == 0x80:
        j -= 1
    return text[j:i].decode("utf-8", "replace")


def _char_at(text: bytes, i: int) -> str:
    return text[i : i + 4].decode("utf-8", "ignore")[:1] or "x"


def bodies(raw: np.ndarray, texts: np.ndarray, chunk_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The safe cuts, and where the bodies of chunks start and end."""
    safe = np.flatnonzero(safe_cuts(raw, texts))  # sorted; holds 0 and n
    chunks = np.flatnonzero(chunk_cuts(raw, texts, chunk_bytes))
    first = safe[np.searchsorted(safe, chunks[:-1], "left")]
    last = safe[np.searchsorted(safe, chunks[1:], "right") - 1]
    full = first < last
    return safe, first[full], last[full]


class Coder:
    def __init__(self, path: str, chunk_bytes: int) -> None:
        self.words = pieces.encoder(path, SPECIAL)
        self.shared, self.bodies, self.joins = pieces.Table(), pieces.Table(pieces.MOST_BYTES // 4), pieces.Table(pieces.MOST_BYTES // 8)
        self.known = None
        self.chunk_bytes = chunk_bytes
        tokenizer = self.words.tokenizer
        back = {c: b for b, c in byte_letters().items()}
        table = []
        special = {i for i, t in tokenizer.get_added_tokens_decoder().items()}
        for i in range(tokenizer.get_vocab_size()):
            t = tokenizer.id_to_token(i)
            table.append(t.encode() if i in special else bytes(back[c] for c in t))
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_size = np.array([len(x) for x in table], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.words.token_size = self.token_size

    def learn(self, known: tuple[str, list[str], list[np.ndarray]]) -> Coder:
        """Take over bodies that are encoded already: a name for the set, texts and ids."""
        name, texts, ids = known
        if self.known != name:
            self.known = name
            self.shared.clear()
            raw, at = buffer(pa.array(texts, pa.string()))
            eight = eights(raw)
            keys, first = np.unique(hashes(eight, at[:-1], at[1:]), return_index=True)
            own = [np.array(ids[i], np.uint32) for i in first.tolist()]
            self.shared.add(keys, eight, at[first], at[first + 1], np.concatenate([*own, np.zeros(0, np.uint32)]), np.array([len(x) for x in own], np.int64))
        return self

    def _bodies(self, data: bytes, eight: np.ndarray, safe: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def make(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # the safe cuts within each range part it into pieces
            a, b = np.searchsorted(safe, p), np.searchsorted(safe, q)
            at, _ = pieces.take(np.arange(len(safe)), a, b - a)
            ids, size = self.words.ids(data, eight, safe[at], safe[at + 1])
            return ids, np.diff(np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(b - a)])])

        def alone(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
            ids, size = make(p, q)
            return np.split(ids, np.cumsum(size)[:-1])

        i, there, _ = self.shared.find(hashes(eight, start, end), eight, start, end)
        one, other = self.shared.gather(i[there]), pieces.looked_up(self.bodies, eight, start[~there], end[~there], make, alone)
        size = np.zeros(len(start), np.int64)
        size[there], size[~there] = one[1], other[1]
        ids = np.zeros(int(size.sum()), np.uint32)
        mine = np.repeat(there, size)
        ids[mine], ids[~mine] = one[0], other[0]
        return ids, size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text, one after another, and how many each has."""
        raw, texts = buffer(column)
        n = len(raw)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) - 1, np.int64)
        data, eight = raw.tobytes(), eights(raw)
        safe, start, end = bodies(raw, texts, self.chunk_bytes)
        ids, size = self._bodies(data, eight, safe, start, end)
        # gaps, empty ones too: what lies before, between and behind the bodies of a text
        p = np.sort(np.concatenate([texts[:-1], end]), kind="stable")
        q = np.sort(np.concatenate([texts[1:], start]), kind="stable")
        # a gap between two texts is none: texts give both a start and an end
        lead = np.searchsorted(start, p, "left")  # the body that follows
        inner = (p < q) | np.isin(p, end) & np.isin(q, start) & ~np.isin(p, texts)
        p, q, lead = p[inner], q[inner], lead[inner]
        has_left, has_right = ~np.isin(p, texts), ~np.isin(q, texts)
        a = safe[np.searchsorted(safe, p) - has_left]
        b = safe[np.searchsorted(safe, q) + has_right]
        text = lambda x, y: [data[i:j].decode() for i, j in zip(x.tolist(), y.tolist(), strict=True)]
        wide, wide_size = self.words.ids(data, eight, a, b, self.joins)
        # how many ids of each range lie before its gap, and up to the gap's end; exactly, or the range disagrees
        reach = np.concatenate([[0], np.cumsum(self.token_size[wide])])
        at = np.concatenate([[0], np.cumsum(wide_size)])
        begin, stop = reach[at[:-1]] + p - a, reach[at[:-1]] + q - a
        i, j = np.searchsorted(reach, begin), np.searchsorted(reach, stop)
        good = (reach[np.minimum(i, len(reach) - 1)] == begin) & (reach[np.minimum(j, len(reach) - 1)] == stop)
        ends = np.cumsum(size)
        good &= _equal(wide, at[:-1], ids, np.where(has_left, ends[np.maximum(lead - 1, 0)] if len(ends) else 0, 0) - (i - at[:-1]), i - at[:-1], good & has_left)
        good &= _equal(wide, j, ids, (ends - size)[np.minimum(lead, len(ends) - 1)] if len(ends) else j, at[1:] - j, good & has_right)
        gap, gap_size = pieces.take(wide, np.minimum(i, at[1:]), np.where(good, j - i, 0))
        # bodies and gaps in their order
        where, kind = np.concatenate([start, p]), np.concatenate([np.ones(len(start), np.int64), np.zeros(len(p), np.int64)])
        order = np.lexsort((kind, where))
        pool, total = np.concatenate([ids, gap]), np.concatenate([size, gap_size])
        from_ = np.concatenate([np.cumsum(size) - size, len(ids) + np.cumsum(gap_size) - gap_size])
        out, each = pieces.take(pool, from_[order], total[order])
        owner = np.searchsorted(texts, where[order], "right") - 1
        count = np.bincount(owner, each, len(texts) - 1).astype(np.int64)
        if not good.all():
            again = np.unique(np.searchsorted(texts, p[~good], "right") - 1)
            out, count = pieces.put(out, count, again, self.words.each(text(texts[again], texts[again + 1])))
        return out, count

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The decoded text of each run of ids, as UTF-8."""
        size = self.token_size[ids]
        data, _ = pieces.take(self.token_bytes, self.token_at[ids], size)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])].tolist()
        data = data.tobytes()
        out = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return [x if x.isascii() else x.decode("utf-8", "replace").encode() for x in out]


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Whether a[at : at + size] is b[bt : bt + size], for the rows in ``which``; true for the others."""
    out = np.ones(len(at), bool)
    k = np.flatnonzero(which)
    ok = (bt[k] >= 0) & (bt[k] + size[k] <= len(b))
    out[k[~ok]] = False
    k = k[ok]
    owner = np.repeat(k, size[k])
    out[owner[pieces.take(a, at[k], size[k])[0] != pieces.take(b, bt[k], size[k])[0]]] = False
    return out


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable letter for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_coders: dict[tuple[str, int], Coder] = {}
KEPT.append(_coders)


def coder(path: str, chunk_bytes: int = CHUNK_BYTES) -> Coder:
    """One for each Python worker, kept from task to task."""
    if (path, chunk_bytes) not in _coders:
        _coders[path, chunk_bytes] = Coder(path, chunk_bytes)
    return _coders[path, chunk_bytes]


def shared_bodies(docs: DataFrame, tokenizer: str, chunk_bytes: int = CHUNK_BYTES, most: int = MOST_SHARED) -> tuple[str, list[str], list]:
    """The bodies that most documents share, each encoded once: for ``Coder.learn``. At most ``most`` bodies of at most
    SHARED_BYTES bytes, by the number of their documents; documents are read twice, and hashes are shuffled."""
    ship(docs.sparkSession)
    texts = small_batches(docs.select("text"))

    def ranges(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        raw, at = buffer(b.column(0))
        if not len(raw):
            none = np.zeros(0, np.int64)
            return raw, at, none, none, np.zeros(0, np.uint64)
        _, start, end = bodies(raw, at, chunk_bytes)
        short = end - start <= SHARED_BYTES
        return raw, at, start[short], end[short], hashes(eights(raw), start[short], end[short])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", keep=True):
            _, at, start, _, h = ranges(b)
            doc = np.searchsorted(at, start, "right") - 1
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            u, n = np.unique(h[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int32))], ["body", "n"])

    counted = texts.mapInArrow(count, "body long, n int").groupBy("body").agg(F.sum("n").alias("n")).where("n > 1")
    top = np.array([r.body for r in counted.orderBy(F.col("n").desc(), "body").limit(most).collect()], np.int64).view(np.uint64)
    if not len(top):
        return "none", [], []
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(top))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(sent.value), bool)
        for b in sliced(batches, "text", keep=True):
            raw, _, start, end, h = ranges(b)
            i = np.minimum(np.searchsorted(sent.value, h), len(seen) - 1)
            at = np.flatnonzero((sent.value[i] == h) & ~seen[i])
            _, one = np.unique(h[at], return_index=True)
            at = at[one]
            seen[i[at]] = True
            if len(at):
                data = raw.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array([data[p:q].decode() for p, q in zip(start[at].tolist(), end[at].tolist(), strict=True)])], ["body", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pieces.encoder(tokenizer, SPECIAL).each(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], ["text", "ids"])

    once = texts.mapInArrow(contents, "body long, text string").groupBy("body").agg(F.min("text").alias("text")).select("text")
    rows = sorted(once.mapInArrow(encode, "text string, ids array<int>").collect())
    return hashlib.sha256("\0".join(r.text for r in rows).encode()).hexdigest(), [r.text for r in rows], [np.array(r.ids, np.uint16) for r in rows]


def encode_decode(docs: DataFrame, tokenizer: str, chunk_bytes: int = CHUNK_BYTES, keep_ids: bool = False, most_shared: int = MOST_SHARED) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids too."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(shared_bodies(docs, tokenizer, chunk_bytes, most_shared))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(tokenizer, chunk_bytes).learn(known.value)
        for b in sliced(batches, "text", 256 << 10, keep=True):
            ids, count = own.encode(b.column("text"))
            at = np.concatenate([[0], np.cumsum(count)])
            flat, ends = ids.astype("<u4").tobytes(), (4 * at).tolist()
            columns = [
                b.column("doc_id"),
                pa.array(count, pa.int64()),
                pa.array([hashlib.sha256(flat[p:q]).hexdigest() for p, q in zip(ends, ends[1:], strict=False)], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(ids, count)], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(task, schema)
