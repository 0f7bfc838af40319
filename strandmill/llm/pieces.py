"""Ids of text pieces, each distinct piece encoded once and kept in numpy arrays.

A piece is a byte range that a tokenizer encodes alone exactly as it does within its text. Unseen pieces are joined by a
special token, encoded by the tokenizers library in one call, and split at that token again. A table finds a piece by its hash
and then compares its bytes; a piece whose hash another one has is encoded by itself each time.
"""

from __future__ import annotations

import os

import numpy as np

from strandmill.llm.words import KEPT, clashes, firsts, hashes, same

#: Characters of one call to the library, and bytes of a table in a Python worker before it lets its seldom used half go.
CALL_CHARS, MOST_BYTES = 60_000, 32 << 20


def _grown(pool: np.ndarray, need: int) -> np.ndarray:
    if need <= len(pool):
        return pool
    out = np.zeros(max(len(pool) + len(pool) // 2, need), pool.dtype)
    out[: len(pool)] = pool
    return out


class Table:
    """Sorted hashes with pools of contents and ids; grows by merging, and lets what was used least go when it is full."""

    def __init__(self, most: int = MOST_BYTES) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int32)  # of the ids
        self.size = np.zeros(0, np.int32)
        self.place = np.zeros(0, np.int32)  # of the bytes
        self.length = np.zeros(0, np.int32)
        self.uses = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 14, np.uint32)
        self.data = np.zeros(1 << 16, np.uint8)
        self.used = self.filled = 0

    def full(self) -> bool:
        return 28 * len(self.keys) + 4 * self.used + self.filled > self.most

    def prune(self) -> None:
        """Keep the half that was used most; uses count half from now on."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: len(self.keys) // 2])
        ids, size = self.gather(keep)
        length = self.length[keep].astype(np.int64)
        data, _ = take(self.data, self.place[keep].astype(np.int64), length)
        keys, uses = self.keys[keep], self.uses[keep] // 2
        self.clear()
        self.pool, self.data = _grown(self.pool, len(ids)), _grown(self.data, len(data) + 8)
        self.pool[: len(ids)], self.data[: len(data)] = ids, data
        self.used, self.filled, self.keys, self.uses = len(ids), len(data), keys, uses
        self.at, self.size, self.place, self.length = (x.astype(np.int32) for x in (np.cumsum(size) - size, size, np.cumsum(length) - length, length))

    def _eight(self) -> np.ndarray:
        return np.ndarray((len(self.data) - 7,), "<u8", buffer=self.data.data, strides=(1,))

    def find(self, keys: np.ndarray, eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of each key, whether it is there with these bytes, and whether it is there with others."""
        none = np.zeros(len(keys), bool)
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), none, none
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[i] == keys
        equal = known & (self.length[i] == end - start)
        at = np.flatnonzero(equal)
        equal[at] = same(eight, start[at], self._eight(), self.place[i[at]].astype(np.int64), (end - start)[at])
        return i, equal, known & ~equal

    def add(self, keys: np.ndarray, eight: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """keys: sorted and absent."""
        length = end - start
        self.pool = _grown(self.pool, self.used + len(ids))
        self.pool[self.used : self.used + len(ids)] = ids
        total = int(length.sum())
        self.data = _grown(self.data, self.filled + total + 8)
        flat, _ = take(np.arange(len(eight)), start, length)
        self.data[self.filled : self.filled + total] = eight[flat].astype(np.uint8)
        new = (keys, self.used + np.cumsum(size) - size, size, self.filled + np.cumsum(length) - length, length)
        self.used += len(ids)
        self.filled += total
        i = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size, self.place, self.length = (np.insert(a, i, b) for a, b in zip((self.keys, self.at, self.size, self.place, self.length), new, strict=True))
        self.uses = np.insert(self.uses, i, 0)

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after another, and how many each has."""
        return take(self.pool, self.at[index].astype(np.int64), self.size[index].astype(np.int64))


def take(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool[at : at + size] of each, one after another."""
    total = int(size.sum())
    step = np.repeat(at - (np.cumsum(size) - size), size)
    step += np.arange(total)
    return pool[step], size


def put(ids: np.ndarray, size: np.ndarray, where: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids with those at ``where`` replaced by ``parts``."""
    out = np.split(ids, np.cumsum(size)[:-1])
    for i, p in zip(where.tolist(), parts, strict=True):
        out[i] = p
    return np.concatenate(out).astype(np.uint32), np.array([len(x) for x in out], np.int64)


def looked_up(table: Table, eight: np.ndarray, start: np.ndarray, end: np.ndarray, make, alone) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ranges, one after another, and how many each has.

    make(start, end) encodes ranges that are new to the table, alone(start, end) -> list those whose hash another one has.
    """
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    unique, first, back = firsts(hashes(eight, start, end))
    odd = clashes(eight, start, end, first, back)
    if table.full():
        table.prune()
    _, there, other = table.find(unique, eight, start[first], end[first])
    new = first[~there & ~other]
    if len(new):
        table.add(unique[~there & ~other], eight, start[new], end[new], *make(start[new], end[new]))
    odd = np.union1d(odd, np.flatnonzero(other[back]))
    index = np.searchsorted(table.keys, unique)
    table.uses[index] += np.bincount(back, minlength=len(index)).astype(np.int32)
    ids, size = table.gather(index[back])
    return put(ids, size, odd, alone(start[odd], end[odd])) if len(odd) else (ids, size)


def _of(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


#: Symbols that no tokenizer here composes, lower-cases or takes into a special token.
SYMBOLS = _of(",.!?;:$%&#")
LETTERS = _of("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS_DIGITS = LETTERS | _of("0123456789")


def one_word(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ranges (not empty) hold nothing but letters of Latin-1, or nothing but SYMBOLS."""
    if not len(start):
        return np.zeros(0, bool)
    flat, _ = take(raw, start, size)
    before = np.concatenate([[0], flat[:-1]])
    # C3 leads U+00C0 to U+00FF, of which 97 and B7 are no letters
    letter = LETTERS[flat] | (flat == 0xC3) | ((before == 0xC3) & (flat != 0x97) & (flat != 0xB7))
    first = np.cumsum(size) - size
    return np.logical_and.reduceat(letter, first) | np.logical_and.reduceat(SYMBOLS[flat], first)


class Encoder:
    def __init__(self, path: str, between: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.between, self.cut = between, self.tokenizer.token_to_id(between)
        self.table = Table()
        #: The bytes of each id, where ids stand for the bytes of a text one after another.
        self.token_size: np.ndarray | None = None
        #: For each id whether it ends a word, where the vocabulary tells.
        self.word_end: np.ndarray | None = None

    def ends_words(self, suffix: str) -> Encoder:
        """Tell the ends of words by a suffix of their last token."""
        if self.word_end is None:
            known = self.tokenizer.get_vocab()
            self.word_end = np.zeros(max(known.values()) + 1, bool)
            self.word_end[[i for token, i in known.items() if token.endswith(suffix)]] = True
        return self

    def each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and how many each has; many are encoded in one call."""
        odd = [i for i, t in enumerate(texts) if "<|" in t or len(t) > CALL_CHARS]
        skip, calls, own, chars = set(odd), [], [], 0
        for i, t in enumerate(texts):
            if i in skip:
                continue
            own.append(t)
            chars += len(t)
            if chars >= CALL_CHARS:
                calls.append(own)
                own, chars = [], 0
        if own:
            calls.append(own)
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for own in calls:  # one at a time: what the library makes of a text is many times its size
            (ids,) = self.each([self.between.join(own)])
            ends = np.flatnonzero(ids == self.cut)
            if len(ends) != len(own) - 1:
                raise ValueError("the separator was not kept apart")
            flat.append(ids[ids != self.cut])
            sizes.append(np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1)
        ids, size = np.concatenate(flat), np.concatenate(sizes)
        if odd:
            at = np.array(odd)
            size = np.insert(size, at - np.arange(len(at)), 0)
            ids, size = put(ids, size, at, self.each([texts[i] for i in odd]))
        return ids, size

    def adjoined(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``together`` for ranges of data, for byte-level tokenizers: ranges that begin with one blank or newline and neither
        go on nor end with white space are put one behind the other, where the pre-tokenizer parts them as in their text, and
        their ids are told apart by the bytes that they stand for."""
        raw = np.frombuffer(data, np.uint8)
        mark, size = (raw[start] == 0x20) | (raw[start] == 0x0A), end - start
        second, last = raw[np.minimum(start + 1, end - 1)], raw[end - 1]
        wide = (second == 0xC2) | ((second >= 0xE1) & (second <= 0xE3))
        ends_wide = (last >= 0x80) & ((raw[np.maximum(end - 2, 0)] == 0xC2) | ((raw[np.maximum(end - 3, 0)] >= 0xE1) & (raw[np.maximum(end - 3, 0)] <= 0xE3)))
        plain = mark & (size > 1) & (size < CALL_CHARS) & (second > 0x20) & ~wide & (last > 0x20) & ~ends_wide
        at = np.flatnonzero(plain)
        flat, _ = take(raw, start[at], size[at])
        stop = np.cumsum(size[at])
        cuts = np.unique(np.searchsorted(stop, np.arange(0, len(flat) + CALL_CHARS, CALL_CHARS), "left"))
        bounds = np.unique(np.concatenate([[0], stop[np.minimum(cuts, len(stop) - 1)]])).tolist() if len(at) else [0]
        text = flat.tobytes()
        ids = np.concatenate([*(self.each([text[p:q].decode()])[0] for p, q in zip(bounds, bounds[1:], strict=False)), np.zeros(0, np.uint32)])
        reach = np.concatenate([[0], np.cumsum(self.token_size[ids])])
        place = np.searchsorted(reach, stop)
        n = np.zeros(len(start), np.int64)
        if (place < len(reach)).all() and (reach[np.minimum(place, len(reach) - 1)] == stop).all():
            n[at] = np.diff(np.concatenate([[0], place]))
        else:  # ids do not part where the ranges do
            ids, plain = np.zeros(0, np.uint32), np.zeros(len(start), bool)
        return self._with_rest(data, start, end, plain, ids, n)

    def parted(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``together`` for ranges of data, for tokenizers that mark the end of each word they find: ranges of letters alone, or of
        SYMBOLS alone, are one such word each, so they go into a call with blanks between them."""
        raw, size = np.frombuffer(data + b" ", np.uint8), end - start
        plain = (size < CALL_CHARS) & one_word(raw, start, size)
        at = np.flatnonzero(plain)
        stop = np.cumsum(size[at] + 1)
        flat = take(raw, start[at], size[at] + 1)[0]
        flat[stop - 1] = 0x20
        cuts = np.searchsorted(stop, np.arange(0, len(flat) + CALL_CHARS, CALL_CHARS), "left")
        bounds = np.unique(np.concatenate([[0], stop[np.minimum(cuts, len(stop) - 1)]])).tolist() if len(at) else [0]
        text = flat.tobytes()
        ids = np.concatenate([*(self.each([text[p:q].decode()])[0] for p, q in zip(bounds, bounds[1:], strict=False)), np.zeros(0, np.uint32)])
        ends = np.flatnonzero(self.word_end[ids])
        n = np.zeros(len(start), np.int64)
        if len(ends) == len(at) and (not len(ids) or ends[-1] == len(ids) - 1):
            n[at] = np.diff(np.concatenate([[-1], ends]))
        else:
            ids, plain = np.zeros(0, np.uint32), np.zeros(len(start), bool)
        return self._with_rest(data, start, end, plain, ids, n)

    def _with_rest(self, data: bytes, start: np.ndarray, end: np.ndarray, plain: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ranges, one after another, and how many each has, from those of the ``plain`` ones."""
        odd, rest = np.flatnonzero(~plain), np.flatnonzero(plain)
        if not len(odd):
            return ids, n
        own, count = self.together([data[p:q].decode() for p, q in zip(start[odd].tolist(), end[odd].tolist(), strict=True)])
        n[odd] = count
        from_ = np.zeros(len(start), np.int64)
        from_[odd] = len(ids) + np.cumsum(count) - count
        from_[rest] = np.cumsum(n[rest]) - n[rest]
        return take(np.concatenate([ids, own]), from_, n)

    def ids(self, data: bytes, eight: np.ndarray, start: np.ndarray, end: np.ndarray, table: Table | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after another, and how many each has. eight: those of data; table: another than the own one."""
        text = lambda a, b: [data[p:q].decode() for p, q in zip(a.tolist(), b.tolist(), strict=True)]
        if self.token_size is not None:
            make = lambda a, b: self.adjoined(data, a, b)
        elif self.word_end is not None:
            make = lambda a, b: self.parted(data, a, b)
        else:
            make = lambda a, b: self.together(text(a, b))
        return looked_up(table or self.table, eight, start, end, make, lambda a, b: self.each(text(a, b)))


_encoders: dict[tuple[str, str], Encoder] = {}
KEPT.append(_encoders)


def encoder(path: str, between: str) -> Encoder:
    """One for each Python worker, kept from task to task."""
    key = (path, between)
    if key not in _encoders:
        _encoders[key] = Encoder(path, between)
    return _encoders[key]
