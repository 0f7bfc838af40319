"""Secrets in texts: fixed patterns, and strings that a character Markov model finds random rather than ordinary.

Two first-order Markov models over printable ASCII are trained from labelled samples, one of random strings and one of
ordinary identifiers with the words of all documents. Words are aggregated, then their transitions, to at most 94**2 rows for
each label and weight. A string of ``LEAST`` or more key
characters is a secret if the mean log-likelihood ratio of its transitions reaches ``THRESHOLD``; spans that overlap those of
the fixed patterns are left to them. Everything runs as column expressions; training shuffles distinct words, and the scan is
one pass over the texts with no shuffle.

Null and empty texts have no spans, repeated rows are kept, and an empty table gives no rows; the made samples train alone then.
Time and memory follow a text's length, however long its runs and however many its matches. Other columns are ignored, but
``keep`` carries them along: one with a name of the result's own comes back with "_in" behind it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.spans import apart, joined, let, matches, replaced, tagged
from strandmill.llm.words import carried

# The base patterns. The assigned value is checked after the match, the others' lengths within the pattern:
# a run that is too short holds no shorter match, so both ways drop the same ones.
ASSIGN = r"""(?i)(?=[pstaPSTA])(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
LEAST, THRESHOLD = 20, 0.55

_LOW, _WIDTH = 33, 94

# Words of ordinary identifiers.
COMMON = """
get set list map key value name type index count size path file line user data item node token error config option
default current previous next first last begin start end open close read write load store update delete insert create
build parse format print string number integer float boolean object array buffer stream event handler manager factory
service request response session context public private static final return import module package version internal
""".split()


def samples(docs: DataFrame, n: int = 4000, worth: int = 1000) -> DataFrame:
    """(text, random, weight): n labelled strings of either kind, and the words of all documents.

    Random ones are digests in several alphabets; ordinary ones are joined from common words, and the words stand beside them.
    Every document counts, all alike: beyond ``worth`` documents each weighs less, so that all together weigh as much as
    ``worth`` average ones and the made identifiers keep their share at every size.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    ids = spark.range(0, n, 1, 1)
    length = (F.lit(20) + F.pmod(F.xxhash64("id"), F.lit(20))).cast("int")
    b64 = F.base64(F.unhex(digest))
    kinds = [F.substring(digest, 1, 40), F.substr(b64, F.lit(1), length), F.substr(F.translate(F.upper(F.translate(b64, "+/=", "xyz")), "-", "A"), F.lit(1), length), F.substr(F.translate(b64, "+/=", "-_"), F.lit(1), length)]
    random = ids.select(F.element_at(F.array(*kinds), (F.pmod(F.col("id"), F.lit(4)) + 1).cast("int")).alias("text"), F.lit(True).alias("random"))
    words = F.array(*[F.lit(w) for w in COMMON])
    word = lambda i: F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(i)), F.lit(len(COMMON))) + 1).cast("int"))
    ordinary = [F.concat_ws("_", word(1), word(2), word(3), word(4)), F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)), F.initcap(word(4))), F.upper(F.concat_ws("_", word(1), word(2), word(3))), F.concat_ws("/", word(1), word(2), word(3), word(4)), F.concat(F.concat_ws("-", word(1), word(2), word(3)), F.lit("-"), F.pmod(F.col("id"), F.lit(100)).cast("string"))]
    plain = ids.select(F.element_at(F.array(*ordinary), (F.pmod(F.col("id"), F.lit(5)) + 1).cast("int")).alias("text"), F.lit(False).alias("random"))
    weight = worth / max(worth, docs.count())
    own = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z])[A-Za-z]{6,40}+"), F.lit(0))).alias("text"), F.lit(False).alias("random"))
    return random.union(plain).withColumn("weight", F.lit(1.0)).union(own.withColumn("weight", F.lit(weight)))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of transitions, for codes (a - 33) * 94 + (b - 33). A string counts by its weight, 1 if none is given."""
    code = lambda c: F.ascii(c) - _LOW
    weight = F.col("weight") if "weight" in labelled.columns else F.lit(1.0)
    strings = labelled.where(F.length("text") > 1).select("random", "text", weight.alias("weight")).groupBy("random", "text", "weight").agg(F.count("*").alias("n"))
    pairs = strings.select("random", "weight", "n", F.explode(F.expr("transform(sequence(1, length(text) - 1), i -> substring(text, i, 2))")).alias("p"))
    # whole counts until here, so sums do not depend on their order
    counted = pairs.groupBy("random", "p", "weight").agg(F.sum("n").alias("n")).select("random", code(F.substring("p", 1, 1)).alias("a"), code(F.substring("p", 2, 1)).alias("b"), "weight", "n")
    counts = {True: [[0.5] * _WIDTH for _ in range(_WIDTH)], False: [[0.5] * _WIDTH for _ in range(_WIDTH)]}
    for r in sorted(counted.where(f"a between 0 and {_WIDTH - 1} and b between 0 and {_WIDTH - 1}").collect()):
        counts[r.random][r.a][r.b] += r.weight * r.n
    out = []
    for a in range(_WIDTH):
        yes, no = sum(counts[True][a]), sum(counts[False][a])
        out += [math.log(counts[True][a][b] / yes) - math.log(counts[False][a][b] / no) for b in range(_WIDTH)]
    return out


def randomness(text: Column, ratios: list[float]) -> Column:
    """The mean log-likelihood ratio of the transitions of a string of ASCII characters; others count 0."""
    table = F.expr(f"cast(split('{','.join(f'{x:.4f}' for x in ratios)}', ',') as array<double>)")

    def scored(bytes_: Column) -> Column:
        n = F.octet_length(bytes_) - 1

        def step(total: Column, i: Column) -> Column:
            two = F.substr(bytes_, i, F.lit(2)).cast("string")
            a, b = F.ascii(two) - _LOW, F.ascii(F.substring(two, 2, 1)) - _LOW
            ok = (a >= 0) & (a < _WIDTH) & (b >= 0) & (b < _WIDTH)
            return total + F.when(ok, F.get(table, a * _WIDTH + b)).otherwise(F.lit(0.0))

        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), step) / n).otherwise(F.lit(0.0))

    # bytes are found at once, the code points of a string only from its start on
    return let(text.cast("binary"), scored)


def scanned(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and found (all spans), as array<struct<start, order, end, kind>> by start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN, 1), lambda s: F.length(s["value"]) >= 6)
    columns, names = carried(docs, [c for c in keep or [] if c != "doc_id"], "doc_id, base, found, _base, _long")
    step = docs.select(F.col("doc_id"), *columns, F.concat(tagged(assign, "assign", 0), tagged(matches(text, ACCESS, has="AKIA"), "access", 1), tagged(matches(text, HEX), "hex", 2)).alias("_base"), matches(text, CANDIDATE).alias("_long"))
    random = F.filter(F.col("_long"), lambda s: randomness(s["match"], ratios) >= threshold)
    found = apart(tagged(random, "random", 3), F.col("_base"))
    return step.select("doc_id", *names, F.array_sort("_base").alias("base"), F.array_sort(F.concat("_base", found)).alias("found"))


def secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The digest columns: counts and spans of every document."""
    ratios = train(labelled if labelled is not None else samples(docs))
    found = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratios, threshold)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with its spans (sorted by start, perhaps overlapping) replaced by ``mark``."""
    return replaced(text, spans, mark)
