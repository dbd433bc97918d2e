"""Secret scan in DataFrame functions only: base patterns, and a randomness test battery.

Long runs of encoding characters are candidates. For each, the encoding is inferred; over its
alphabet three tests of randomness are made: chi-squared uniformity, runs about the middle, and
serial correlation. They are combined into one p by Simes' rule, which holds for independent tests
and for ones that depend on each other positively, as here runs and serial correlation do (both fall
when like follows like). A candidate that is not random by this p is none. For the others the
chi-squared value is held against what ordinary text of the same length and alphabet would show:
that probability falls with length, so a short string is weak evidence however even it looks. A
Benjamini-Hochberg bound per length class then controls the false discoveries.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lateralis.llm.shared import named, stage

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that have 16 characters or more
KINDS = ["assign", "access", "hex", "random"]
#: Runs of one of the two base64 alphabets: a whole run of the standard one, of the url-safe one, or the standard part of a mixed one
#: (so a url-safe key right behind a slash or plus is cut at its own - and _).
CANDIDATE = r"[A-Za-z0-9+/]{16,}+(?![_-])|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+(?![+/])|[A-Za-z0-9+/]{16,}"

HEXITS, DIGITS = "0123456789abcdef", string.digits
#: name, what it matches (tried in this order), alphabet, share of equal pairs in ordinary text of such characters;
#: for decimal that of leading digits by Benford's law.
ENCODINGS = [
    ("decimal", r"^[0-9]+$", DIGITS, 0.165),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", HEXITS, 0.1),
    ("lower", r"^[a-z]+$", string.ascii_lowercase, 0.065),
    ("upper", r"^[A-Z]+$", string.ascii_lowercase, 0.065),
    ("base32", r"^[A-Z2-7]+$", (string.ascii_uppercase + "234567").lower(), 0.065),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", DIGITS + string.ascii_lowercase, 0.065),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + string.ascii_letters, 0.065),
    ("base64", r"^[0-9A-Za-z+/]+$", DIGITS + string.ascii_letters + "+/", 0.065),
    ("base64url", r"^[0-9A-Za-z_-]+$", DIGITS + string.ascii_letters + "-_", 0.065),
]


def matches(text: Column, pattern: str, gate: Column) -> Column:
    """Array of (gap, size, found): the text between the previous match and this one, and the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    both = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("found")))
    return F.when(gate, both)


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(rid, doc_id, assign, access, hex, random): null where a kind has no match."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), named(key).cast("long").alias("doc_id"),
        F.coalesce(named(text), F.lit("")).alias("text"))
    t = F.col("text")
    candidates = matches(t, CANDIDATE, t.rlike(r"[A-Za-z0-9+/_-]{16}"))  # each candidate lies in such a run
    return rows.select(
        "rid", "doc_id",
        matches(t, ASSIGN, (t.contains("=") | t.contains(":")) & t.rlike(ASSIGN)).alias("assign"),
        matches(t, ACCESS, t.contains("AKIA")).alias("access"),
        matches(t, HEX, t.rlike(HEX)).alias("hex"),
        candidates.alias("random"),
    ).select(
        "rid", "doc_id", *[F.when(F.size(k) > 0, F.col(k)).alias(k) for k in KINDS])


def placed(rows: DataFrame) -> DataFrame:
    """(rid, kind, start, end, found): one row per match, in code points, end exclusive."""
    parts = None
    for i, kind in enumerate(KINDS):
        each = rows.filter(F.col(kind).isNotNull()).select("rid", F.lit(i).alias("kind"), F.posexplode(kind).alias("i", "m"))
        parts = each if parts is None else parts.unionByName(each)
    before = W.partitionBy("rid", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(before)
    out = parts.select("rid", "kind", end.alias("end"), F.col("m.size").alias("size"), F.col("m.found").alias("found"))
    value = F.length(F.regexp_extract("found", ASSIGN, 1))
    good = (
        F.when(F.col("kind") == 0, value >= 12).when(F.col("kind") == 1, F.col("size") >= 18)
        .when(F.col("kind") == 2, F.col("size") >= 16).otherwise(True))
    return out.filter(good).select("rid", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "found")


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by the logistic approximation of Page (error below 0.0002)."""
    c = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * c + F.lit(0.070566) * c * c * c))


def log_tail(z: Column) -> Column:
    """log10 of the upper tail of the normal distribution: by ``tail``, from 3 on by its continued fraction."""
    far = F.greatest(z, F.lit(3.0))
    fraction = far
    for k in range(12, 0, -1):
        fraction = far + F.lit(float(k)) / (far if k == 12 else fraction)
    log_far = -(far * far / 2 + F.lit(math.log(2 * math.pi) / 2) + F.log(fraction)) / F.lit(math.log(10))
    return F.when(z < 3, F.log10(tail(z))).otherwise(log_far)


def occurrences(text: Column, part: Column | str) -> Column:
    """How often ``part``, which cannot overlap itself, stands in ``text``."""
    part = F.lit(part) if isinstance(part, str) else part
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("double")


def simes(ascending: Column, n: int) -> Column:
    """One p of ``n`` ascending ones: the least of n * p(i) / i."""
    return F.least(*[F.get(ascending, F.lit(i)) * (n / (i + 1)) for i in range(n)])


def battery(candidates: DataFrame, level: float) -> DataFrame:
    """Adds size, encoding, p_random (of the three tests) and log_p: log10 of how likely ordinary text is to look so
    even; 0 if ``p_random`` is below ``level``, or without encoding.

    Counts come from string functions, a character of the alphabet at a time, so the work is in proportion to length.
    """
    name, alphabet, share = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for encoding, pattern, letters, equal in reversed(ENCODINGS):
        match = F.col("found").rlike(pattern)
        name = F.when(match, encoding).otherwise(name)
        alphabet = F.when(match, letters).otherwise(alphabet)
        share = F.when(match, F.lit(equal).cast("double")).otherwise(share)
    rows = candidates.withColumns({"encoding": name, "alphabet": alphabet, "share": share})
    folded = F.when(F.col("encoding").isin("hex", "upper", "base32", "base36"), F.lower("found")).otherwise(F.col("found"))
    rows = rows.withColumns({"folded": folded, "size": F.length("found").cast("double"), "letters": F.length("alphabet").cast("double")})
    rows = rows.withColumns({
        "codes": F.expr("transform(split(folded, ''), c -> cast(locate(c, alphabet) - 1 as double))"),
        "halves": F.expr("translate(folded, alphabet, repeat('0', int(letters / 2)) || repeat('1', int(letters - letters / 2)))"),
        "squares": F.expr("aggregate(split(alphabet, ''), 0D, (s, c) -> s + pow(length(folded) - length(replace(folded, c, '')), 2))"),
    })
    rows = rows.withColumns({
        "high": occurrences(F.col("halves"), "1"),
        "turns": 1 + occurrences(F.col("halves"), "01") + occurrences(F.col("halves"), "10"),
        "sum": F.expr("aggregate(codes, 0D, (s, x) -> s + x)"),
        "sum2": F.expr("aggregate(codes, 0D, (s, x) -> s + x * x)"),
        "next": F.expr("aggregate(zip_with(codes, slice(codes, 2, size(codes)), (a, b) -> a * b), 0D, (s, x) -> s + coalesce(x, 0D))"),
        "ends": F.expr("codes[0] + codes[size(codes) - 1]"),
    })
    # column by column, so that no formula holds another one many times over
    size, mean, df, chi, expected, excess = (F.col(c) for c in ("size", "mean", "df", "chi", "expected", "excess"))
    for made in (
        {"mean": F.col("sum") / size, "df": F.col("letters") - 1, "chi": F.col("letters") / size * F.col("squares") - size,
         "expected": 1 + 2 * F.col("high") * (size - F.col("high")) / size, "excess": (size - 1) * (F.col("letters") * F.col("share") - 1)},
        {"spread": F.col("sum2") - size * mean * mean, "variance": (expected - 1) * (expected - 2) / (size - 1),
         "lagged": F.col("next") - mean * (2 * F.col("sum") - F.col("ends")) + (size - 1) * mean * mean,
         "z_chi": (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)),
         "z_text": (df + excess - chi) / F.sqrt(2 * df + 4 * excess)},
        {"z_runs": F.abs(F.when(F.col("variance") > 0, (F.col("turns") - expected) / F.sqrt("variance")).otherwise(8.0)),
         "z_serial": F.abs(F.when(F.col("spread") > 1e-9, (F.col("lagged") / F.col("spread") + 1 / size) * F.sqrt(size)).otherwise(8.0))},
        {"ascending": F.array_sort(F.array(tail(F.col("z_chi")), 2 * tail(F.col("z_runs")), 2 * tail(F.col("z_serial")))),
         "as_text": log_tail(F.col("z_text"))},
        {"p_random": F.when(F.col("encoding").isNotNull(), simes(F.col("ascending"), 3))},
    ):
        rows = rows.withColumns(made)
    log_p = F.when(F.col("p_random") >= level, F.col("as_text")).otherwise(0.0)
    return rows.select(*candidates.columns, "encoding", size.cast("int").alias("size"), "p_random", log_p.alias("log_p"))


def discoveries(tested: DataFrame, rate: float) -> DataFrame:
    """The candidates that Benjamini-Hochberg accepts at ``rate`` within their length class (powers of two).

    Ranks come from a histogram of -log10 p in steps of 0.02: at most some 1,500 bins for each of at most
    31 classes, so the cumulative counts and the broadcast of one bound per class do not grow with the data.
    The last bin has all below 1e-30, which is below the bound of the first rank for any number of rows.
    """
    binned = tested.withColumns({
        "stratum": F.floor(F.log2("size")), "bin": F.floor(F.least(-F.col("log_p"), F.lit(30.0)) / 0.02)})
    bins = binned.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = W.partitionBy("stratum").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = bins.withColumns({"rank": F.sum("n").over(down), "all": F.sum("n").over(W.partitionBy("stratum"))})
    bound = ranked.filter(F.pow(F.lit(10.0), -0.02 * F.col("bin")) <= rate * F.col("rank") / F.col("all"))
    bound = bound.groupBy("stratum").agg(F.min("bin").alias("least"))
    return binned.join(F.broadcast(bound), "stratum").filter("bin >= least")


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = 0.1, level: float = 0.001) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, spans (array of start, kind, end).

    Spans are ordered by start, then kind as listed in ``KINDS``; kind is its place there. Base spans
    always stay; ``random`` ones are added and may lie over them. Null texts are empty; repeated
    documents each get their row; an empty table gives no rows.
    """
    rows = stage(scanned(docs, key, text), "secret-scan")
    none = F.coalesce("assign", "access", "hex", "random").isNull()
    spans = stage(placed(rows.filter(~none)), "secret-spans")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but long work
    tested = stage(battery(spans.filter("kind = 3").repartition(tasks, "rid", "start"), level), "secret-tests")
    random = discoveries(tested, rate)
    all_spans = spans.filter("kind < 3").select("rid", "kind", "start", "end").unionByName(
        random.select("rid", "kind", "start", "end"))
    listed = all_spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    some = rows.filter(~none).select("rid", "doc_id").join(listed, "rid", "left")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = rows.filter(none).select("doc_id", empty.alias("spans")).unionByName(
        some.select("doc_id", F.coalesce("spans", empty).alias("spans")))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, "spans")


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
