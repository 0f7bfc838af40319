"""Personal data: base patterns, and identifiers found by bootstrapping lexical contexts.

Base matches are seeds. A token is a run of characters other than white space. Every token with ``DIGITS`` or more digits is an
instance, and the token before it, of whatever length and behind whatever white space, is its pattern: the empty string at a
text's start. Where a token begins with a name up to ':' or '=' and what follows has the digits, the name with its sign is the
pattern, and what follows is the instance. Patterns are compared in lower case.
Spark builds the bipartite graph of patterns and instances over all documents and scores it in rounds: a pattern's score is
the mean score of its distinct instances, damped by how few of them are positive, and an instance's score is that of its best
trusted pattern. Instances of trusted patterns that no base pattern matches are added as kind ``found``. All steps are
DataFrame operations; patterns as frequent as any word are pre-aggregated, and only instance rows are shuffled, not texts.

Null texts have no spans. Repeated rows are kept: rows are told apart by doc_id and the text's hash. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.spans import joined, matches, overlapping, tagged
from strandmill.session import cut

# The base patterns, without steps back.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
TOKEN = r"(?<!\S)(?=(?:[^\s0-9]*+[0-9]){%d})\S++"
LAST = r"(?<!\S)(\S++)\s*+\z"
NAMED = r"^([^\s0-9:=][^\s:=]*+[:=]++)\S"
KINDS = ("email", "ip", "card", "phone")

DIGITS, ROUNDS, TRUST, SUPPORT = 5, 3, 0.7, 5


def luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[ -]", ""))

    def step(total: Column, i: Column) -> Column:
        v = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return total + F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<start, order, end, kind>> of the base patterns' matches."""
    digits = lambda m: F.length(F.regexp_replace(m, "[^0-9]", ""))
    found = [
        matches(text, EMAIL, has="@"),
        F.filter(matches(text, IP), lambda s: s["match"].rlike(IP_PARTS)),
        F.filter(matches(text, CARD), lambda s: luhn(s["match"])),
        F.filter(matches(text, PHONE, has="+"), lambda s: digits(s["match"]).between(8, 15)),
    ]
    return F.concat(*[tagged(x, k, i) for i, (x, k) in enumerate(zip(found, KINDS, strict=True))])


def instances(docs: DataFrame, digits: int = DIGITS) -> DataFrame:
    """docs (with text, never null) with seen: array<struct<start, end, pattern, instance>> of all instances in their order."""
    token = TOKEN % digits
    found = matches(F.col("text"), token)
    # what lies before each token, since the one before it
    before = F.when(F.col("text").rlike(token), F.transform(F.split("text", token, -1), lambda x: F.regexp_extract(x, LAST, 1)))
    many = lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) >= digits

    def named(s: Column, i: Column) -> Column:
        name = F.regexp_extract(s["match"], NAMED, 1)
        rest = F.substr(s["match"], F.length(name) + 1)
        last = F.get("_before", i)
        # no token between: the one before is an instance itself, or there is none
        last = F.when(F.length(last) > 0, last).otherwise(F.coalesce(F.get("_tokens", i - 1)["match"], F.lit("")))
        own = (F.length(name) > 0) & many(rest)
        return F.struct(
            F.when(own, s["start"] + F.length(name)).otherwise(s["start"]).alias("start"), s["end"].alias("end"),
            F.lower(F.when(own, name).otherwise(last)).alias("pattern"), F.when(own, rest).otherwise(s["match"]).alias("instance"),
        )

    return docs.withColumns({"_tokens": found, "_before": before}).withColumn("seen", F.transform("_tokens", named)).drop("_tokens", "_before")


def bootstrapped(instances: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """Trusted patterns (pattern, score) of a graph of rows (pattern, instance, seed)."""
    edges = cut(instances.groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("int")).alias("seed")), "edges")
    # an instance is positive by itself (a seed) or by the best trusted pattern it stands with
    score = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    for i in range(rounds):
        seen = edges.select("pattern", "instance").join(score, "instance")
        patterns = seen.groupBy("pattern").agg(F.avg("score").alias("mean"), F.sum("score").alias("good")).select("pattern", (F.col("mean") * (1 - 1 / (1 + F.col("good")))).alias("trust"), "good")
        patterns = cut(patterns.where((F.col("trust") >= trust) & (F.col("good") >= support)).select("pattern", "trust"), "patterns")
        if i + 1 < rounds:
            best = edges.join(patterns, "pattern", "left").groupBy("instance").agg(F.greatest(F.max("seed").cast("double"), F.coalesce(F.max("trust"), F.lit(0.0))).alias("score"))
            score = cut(best, "scores")
    return patterns


def private_data(docs: DataFrame, digits: int = DIGITS, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """doc_id, base and found spans (array<struct<order, start, end, kind>>, by kind as listed, then start)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = instances(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), digits).select("doc_id", F.xxhash64("text").alias("key"), base_spans(F.col("text")).alias("base"), "seen")
    rows = cut(
        rows.select(
            "doc_id", "key",
            F.array_sort(F.transform("base", lambda s: F.struct(s["order"].alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("base"),
            "seen", overlapping(F.col("seen"), F.col("base")).alias("seeds"),
        ),
        "pii",
    )
    each = rows.where(F.size("seen") > 0).select("doc_id", "key", F.explode(F.arrays_zip(F.col("seen").alias("s"), F.col("seeds").alias("seed"))).alias("x")).select("doc_id", "key", "x.s.*", "x.seed")
    patterns = bootstrapped(each, rounds, trust, support)
    new = each.where(~F.col("seed")).join(patterns, "pattern").select("doc_id", "key", "start", "end").distinct()
    added = new.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct(F.lit(len(KINDS)).alias("order"), "start", "end", F.lit("found").alias("kind")))).alias("new"))
    slim = rows.select("doc_id", "key", "base")
    both = slim.join(added, (slim.doc_id.eqNullSafe(added.doc_id)) & (slim.key == added.key), "left").select(slim.doc_id, "base", "new")
    none = F.expr("cast(array() as array<struct<order:int,start:int,end:int,kind:string>>)")
    return both.select("doc_id", "base", F.concat("base", F.coalesce("new", none)).alias("found"))


def personal(docs: DataFrame) -> DataFrame:
    """The digest columns: counts and spans of every document."""
    found = private_data(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
