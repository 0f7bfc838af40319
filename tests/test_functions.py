import base64

import pytest
from pyspark.sql import functions as F

from strandmill.functions import sequence as S
from strandmill.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("kmer", "number"), [("ATCG", 147), ("ATCGATC", 9444), ("ATCGACGTAACCACTGGTAC", 633736300504)])
def test_numbers(spark, kmer, number):
    assert one(spark, S.kmer_to_number(F.lit(kmer))) == number
    assert one(spark, S.number_to_kmer(F.lit(number), len(kmer))) == kmer


def test_number_of_other_letters_raises(spark):
    with pytest.raises(Exception, match="not a k-mer"):
        one(spark, S.kmer_to_number(F.lit("ACGN")))


def test_reverse_complement(spark):
    a, b = "GCAAAGAAAACGCTGGAAAACAGCGTGCTGG", "CCAGCACGCTGTTTTCCAGCGTTTTCTTTGC"
    assert one(spark, S.reverse_complement(F.lit(a))) == b
    assert one(spark, S.canonical_kmer(F.lit(a))) == one(spark, S.canonical_kmer(F.lit(b))) == min(a, b)
    with pytest.raises(Exception, match="not a base"):
        one(spark, S.reverse_complement(F.lit("acgt"), strict=True))


@pytest.mark.parametrize(("seq", "k", "canonical", "distinct", "ordered"), [("ATCG", 4, True, 1, 1), ("ATCG", 5, True, 0, 0), ("ATCGATC", 3, False, 4, 5), ("ATCGATC", 3, True, 2, 5), ("ATCGACGTNACNACTGGTAC", 5, True, 8, 8)])
def test_window_counts(spark, seq, k, canonical, distinct, ordered):
    assert one(spark, F.size(S.generate_kmers(F.lit(seq), k, "N", canonical))) == distinct
    assert one(spark, F.size(S.generate_kmers_in_order(F.lit(seq), k, "N", canonical))) == ordered


def test_windows_of_long_sequences(spark):
    seq = "".join("ACGT"[(i * i + i // 7) % 4] for i in range(1500))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = [seq[i : i + 9] for i in range(len(seq) - 8)]
    assert one(spark, S.windows(F.lit(seq), 9)) == want
    assert one(spark, S.windows(F.lit(seq), 9, True)) == [min(w, rc(w)) for w in want]


@pytest.mark.parametrize(("n", "pairs"), [(0, 0), (1, 0), (2, 1), (4, 6), (17, 136)])
def test_pairs(spark, n, pairs):
    got = one(spark, S.read_pairs(F.lit(list(range(n))) if n else F.expr("cast(array() as array<int>)"), 100))
    assert len(got) == pairs


def test_capped_pairs(spark):
    got = one(spark, S.read_pairs(F.lit(list(range(8))), 6, seed=3))
    assert 0 < len(got) <= 24 and all(p.a < p.b for p in got)


def test_base64(spark):
    assert one(spark, S.long_to_base64(F.lit(0))) == "A"
    for n in (1, 63, 64, 12358, 3223212358, 83223212358):
        assert one(spark, S.base64_to_long(S.long_to_base64(F.lit(n)))) == n
    for kmer, code in (("ATCG", "Gw=="), ("AAACC", "AoA="), ("CCAGCACGCTGTTTTCCAGCGTTTTCTTTGC", "o4udVo7VZXg=")):
        assert one(spark, S.kmer_to_base64(F.lit(kmer))) == code
    assert one(spark, S.base64_encode(F.lit("hello"))) == base64.b64encode(b"hello").decode()


def test_hashes(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ ((b - 256 if b > 127 else b) % 2**32)) * 16777619) % 2**32
        return h

    for s in ("", "a", "hello", "é", "ACGTACGTACGT"):
        assert one(spark, S.fnv_hash(F.lit(s))) == fnv(s)
        assert one(spark, S.hash_string(F.lit(s))) == sum(s.encode())


def test_split_and_trim(spark):
    assert one(spark, F.size(T.split(F.lit("  a b   c       d  e  "), " "))) == 5
    assert one(spark, F.size(T.split(F.lit("123,12 313,asdsaf,,"), ","))) == 3
    assert one(spark, F.size(T.split(F.lit(""), " "))) == 0
    assert one(spark, T.split(F.lit("a,,b,"), ",", keep_empty=True)) == ["a", "", "b"]
    assert one(spark, T.trim(F.lit(" \t\n AAA \r\f"))) == "AAA"
    pieces = one(spark, S.split_evenly(F.lit("abcdefgh"), 3))
    assert [(p.offset, p.piece) for p in pieces] == [(0, "ab"), (2, "cd"), (4, "efgh")]
    assert T.blocks([1, 2, 3, 4, 5], 2) == [[1, 2, 3], [4, 5]]


def test_vertex_random(spark):
    def first(seed):
        x = (seed % 2**32) * 65536 + 13070
        return (25214903917 * x + 11) % 2**48 / 2**48

    for v in (0, 1, 77, 123456789, 2**40):
        assert one(spark, T.vertex_random(F.lit(v), 12345)) == first(v + 12345)
