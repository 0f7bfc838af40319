"""DNA sequence functions as Column expressions; no Python code runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of the numeric code, digits of the packed code, and the digits of base-64 integers.
NUMBER_BASES, PACKED_BASES = "CTAG", "ATCG"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def kmer_to_number(kmer) -> Column:
    """A k-mer of at most 31 bases as a base-4 number, first base most significant; other input raises."""
    k = _col(kmer)
    code = F.conv(F.translate(k, NUMBER_BASES, "0123"), 4, 10).cast("long")
    return F.when(F.length(k) == 0, F.lit(0).cast("long")).when(k.rlike("^[ACGT]{1,31}$"), code).when(k.isNotNull(), F.raise_error(F.concat(F.lit("not a k-mer of at most 31 bases: "), k)).cast("long"))


def number_to_kmer(number, k: int) -> Column:
    """The inverse of kmer_to_number, k bases long."""
    return F.translate(F.lpad(F.conv(_col(number).cast("string"), 10, 4), k, "0"), "0123", NUMBER_BASES)


def reverse_complement(seq, strict: bool = False) -> Column:
    """Reverse with A-T and C-G exchanged, N kept. strict: any other character raises."""
    s = _col(seq)
    out = F.reverse(F.translate(s, "ACGT", "TGCA"))
    if strict:
        return F.when(s.rlike("^[ACGTN]*$"), out).when(s.isNotNull(), F.raise_error(F.concat(F.lit("not a base: "), s)).cast("string"))
    return out


def canonical_kmer(seq) -> Column:
    """The smaller of a sequence and its reverse complement."""
    s = _col(seq)
    return F.least(s, reverse_complement(s))


def in_bases(text, letters: str, bases: str) -> Column:
    """A text as a sequence: each letter, of either case, as its base, and all else as N."""
    return F.regexp_replace(F.translate(F.lower(_col(text)), letters, bases), "[^ACGT]", "N")


#: Windows that are cut from one part of a sequence: a place in a long string costs as many steps as it lies behind the start.
_PART = 256


def windows(seq, k: int, canonical: bool = False) -> Column:
    """Every window of k characters in order (none if the sequence is shorter)."""
    s = _col(seq)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - k) / _PART).cast("int")), lambda j: F.substring(s, j * _PART + 1, _PART + k - 1))
    if canonical:
        sides = F.transform(parts, lambda p: F.struct(p.alias("p"), reverse_complement(p).alias("r"), (F.length(p) - k + 1).alias("n")))
        made = F.transform(sides, lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda i: F.least(F.substring(x["p"], i, k), F.substring(x["r"], x["n"] - i + 1, k))))
    else:
        made = F.transform(parts, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - k + 1), lambda i: F.substring(p, i, k)))
    return F.when(F.length(s) >= k, F.flatten(made)).otherwise(F.expr("cast(array() as array<string>)"))


def _pieces(seq, errors: str) -> Column:
    """The parts of a sequence between any of the characters ``errors``, empties dropped."""
    s = _col(seq)
    if not errors:
        return F.filter(F.array(s), lambda p: F.length(p) > 0)
    return F.filter(F.split(s, "[" + "".join(c if c.isalnum() else "\\" + c for c in errors) + "]"), lambda p: F.length(p) > 0)


def generate_kmers(seq, k: int, errors: str = "N", canonical: bool = True) -> Column:
    """The set of k-mers of a read. Without ``canonical``, those of the reverse complement too.

    The set is made within the row, before anything is exploded or shuffled.
    """
    pieces = _pieces(seq, errors)
    if canonical:
        made = F.transform(pieces, lambda p: windows(p, k, True))
    else:
        made = F.transform(pieces, lambda p: F.concat(windows(p, k), windows(reverse_complement(p), k)))
    return F.array_distinct(F.flatten(made))


def generate_kmer_numbers(seq, k: int, errors: str = "N", canonical: bool = True) -> Column:
    return F.transform(generate_kmers(seq, k, errors, canonical), kmer_to_number)


def generate_kmers_in_order(seq, k: int, errors: str = "N", canonical: bool = True) -> Column:
    """Windows of the forward strand, repeats and order kept."""
    return F.flatten(F.transform(_pieces(seq, errors), lambda p: windows(p, k, canonical)))


def random_kmer(seq, k: int, seed: int) -> Column:
    """A window at a random place of a random strand; null if the sequence is no longer than k. Drawn by the MD5 of seed and
    sequence, so a task that runs again draws the same."""
    s = _col(seq)
    drawn = F.md5(F.concat(F.lit(f"{seed} "), s).cast("binary"))
    number = lambda a, n: F.conv(F.substring(drawn, a, n), 16, 10).cast("long")
    strand = F.when(number(9, 1) % 2 == 0, s).otherwise(reverse_complement(s))
    return F.when(F.length(s) > k, F.substr(strand, (F.pmod(number(1, 8), F.length(s) - k) + 1).cast("int"), F.lit(k)))


def read_pairs(reads, max_degree: int, seed: int = 0) -> Column:
    """Unordered pairs of an array of read ids: all of them up to ``max_degree`` ids, else ceil(max_degree / 2 * n) random
    picks, seeded by the array, with self-pairs dropped."""
    r = _col(reads)
    n = F.size(r)
    every = F.flatten(F.transform(r, lambda x, i: F.transform(F.slice(r, i + 2, n), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pick = lambda i, side: F.element_at(r, (F.pmod(F.xxhash64(r, i, F.lit(seed), F.lit(side)), n.cast("long")) + 1).cast("int"))
    drawn = F.transform(F.sequence(F.lit(1), F.ceil(F.lit(max_degree) / 2 * n).cast("int")), lambda i: F.struct(pick(i, 1).alias("x"), pick(i, 2).alias("y")))
    some = F.transform(F.filter(drawn, lambda p: p["x"] != p["y"]), lambda p: F.struct(F.least(p["x"], p["y"]).alias("a"), F.greatest(p["x"], p["y"]).alias("b")))
    none = F.filter(every, lambda p: F.lit(False))
    return F.when(n < 2, none).when(n <= max_degree, F.filter(every, lambda p: p["a"] != p["b"])).otherwise(some)


def fnv_hash(text) -> Column:
    """FNV-1a, 32 bits, over signed bytes; numbers are hashed as their decimal text."""
    s = _col(text).cast("string")
    pairs = F.hex(F.encode(s, "UTF-8"))
    at = F.when(F.length(pairs) > 0, F.sequence(F.lit(1), (F.length(pairs) / 2).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

    def step(h: Column, i: Column) -> Column:
        b = F.conv(F.substring(pairs, i * 2 - 1, 2), 16, 10).cast("long")
        signed = F.when(b > 127, b - 256).otherwise(b)
        x = h.bitwiseXOR(F.pmod(signed, F.lit(2**32)))
        # x * 16777619 modulo 2**32, in parts that fit a long
        return F.pmod(x * 403 + F.shiftleft(x.bitwiseAND(F.lit(255)), 24), F.lit(2**32))

    return F.aggregate(at, F.lit(2166136261).cast("long"), step)


def hash_string(text) -> Column:
    """The sum of a string's bytes."""
    pairs = F.hex(F.encode(_col(text), "UTF-8"))
    at = F.when(F.length(pairs) > 0, F.sequence(F.lit(1), (F.length(pairs) / 2).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a + F.conv(F.substring(pairs, i * 2 - 1, 2), 16, 10).cast("long"))


def long_to_base64(number) -> Column:
    """A non-negative number in base-64 digits, most significant first; 0 is A."""
    n = _col(number).cast("long")
    digits = F.transform(F.sequence(F.lit(60), F.lit(0), F.lit(-6)), lambda s: F.substring(F.lit(BASE64), F.pmod(F.call_function("shiftrightunsigned", n, s), F.lit(64)).cast("int") + 1, 1))
    text = F.regexp_replace(F.array_join(digits, ""), "^A+", "")
    return F.when(text == "", F.lit("A")).otherwise(text)


def base64_to_long(text) -> Column:
    """The inverse of long_to_base64; unknown characters count as 0."""
    s = _col(text)
    at = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.expr("cast(array() as array<int>)"))
    digit = lambda c: F.greatest(F.lit(0), F.instr(F.lit(BASE64), c) - 1)
    return F.aggregate(at, F.lit(0).cast("long"), lambda a, i: F.shiftleft(a, 6) + digit(F.substring(s, i, 1)))


def kmer_to_base64(kmer) -> Column:
    """Four bases to a byte (A 0, T 1, C 2, G 3; others 0), filled up with zeros, in standard base64."""
    k = F.translate(F.regexp_replace(_col(kmer), "[^ATCG]", "A"), PACKED_BASES, "0123")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(k) - 1) / 4).cast("int")), lambda i: F.lpad(F.conv(F.rpad(F.substring(k, i * 4 + 1, 4), 4, "0"), 4, 16), 2, "0"))
    return F.when(F.length(k) == 0, F.lit("")).otherwise(F.base64(F.unhex(F.array_join(parts, ""))))


def base64_encode(data) -> Column:
    """Standard base64 of a string's bytes or of a binary."""
    return F.base64(F.encode(_col(data), "UTF-8"))


def base64_length(n: int) -> int:
    """Characters that n bytes take in base64, with the closing zero byte that C strings have."""
    return (n + 2) // 3 * 4 + 1


def split_evenly(text, n: int) -> Column:
    """n pieces of one length with their offsets, the last with what remains; shorter texts raise."""
    s = _col(text)
    size = F.floor(F.length(s) / n).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((i * size).alias("offset"), F.when(i == n - 1, F.substr(s, i * size + 1, F.length(s))).otherwise(F.substr(s, i * size + 1, size)).alias("piece")))
    short = F.expr(f"cast(raise_error('a text of fewer than {n} characters') as array<struct<offset:int,piece:string>>)")
    return F.when(F.length(s) >= n, made).when(s.isNotNull(), short)
