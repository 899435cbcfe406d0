"""Secret scans: fixed patterns and a battery of randomness tests. DataFrame operations only.

Patterns give spans by kind (assign, access, hex). The battery looks at long tokens that hold a letter and a digit, or
mixed case, or digits only. Tokens of letters in one case are left out: so few letters tell long words from random
tokens too badly (of 33 such words in the test data's 10,000 documents 2 passed). A token's encoding is inferred
(decimal, hex, base 32, base 36, base 64), and three tests of the hypothesis "uniformly random in this encoding" are
combined by Bonferroni's bound: chi-squared uniformity over the alphabet, the runs test over kinds of characters
(upper case, lower case, digits, signs; the alphabet's halves where it has one kind), and the lag-1 serial correlation. Random tokens have uniform p-values, text
has p-values near 0, of which fewer and fewer lie in each higher decade. False discoveries are controlled for each encoding
and length class by itself, since short tokens say little: how many text tokens lie above a threshold follows from the two
decades below 0.01, where hardly a random token falls, and the class's threshold is the least on a grid at which text is
at most ``fdr`` of what is reported; a class in which no threshold reaches that reports nothing. So one random token
among thousands of others is enough. Histograms for that cover all rows and have a fixed number of cells; a class of
fewer than ``least`` text tokens takes its share of text from its length in all encodings, and if these are too few as
well, from all classes together. The battery only adds spans, and none that overlaps a pattern's span.

Positions are code points, end exclusive. A null text counts as empty and has no spans. Rows are scanned one by one,
so repeated rows and hot keys change nothing; no row is shuffled. A long text with n matches takes n log n steps, and
is redacted by blocks, each read once. An empty table gives an empty result.
Further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table, text_or_empty, written

#: kind -> pattern, group to measure, least length (fixed values).
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
OPEN, SHUT = "\ue000", "\ue001"  #: marks around matches; a text's own are first changed to others of the same width
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: encoding -> the pattern that a token must match whole, its alphabet in order; the first that fits is inferred.
ENCODINGS = {
    "decimal": (r"[0-9]+", DIGIT),
    "hex": (r"[0-9a-f]+", DIGIT + LOWER[:6]),
    "HEX": (r"[0-9A-F]+", DIGIT + UPPER[:6]),
    "base32": (r"[A-Z2-7]+", UPPER + DIGIT[2:8]),
    "base36": (r"[a-z0-9]+", LOWER + DIGIT),
    "BASE36": (r"[A-Z0-9]+", UPPER + DIGIT),
    "base64": (r"[A-Za-z0-9+/]+", UPPER + LOWER + DIGIT + "+/"),
    "base64url": (r"[A-Za-z0-9+/_-]+", UPPER + LOWER + DIGIT + "-_"),
}
#: encoding -> where its alphabet goes from one kind of character to another; the middle where it has one kind.
CUTS = {"decimal": [5], "hex": [10], "HEX": [10], "base32": [26], "base36": [26], "BASE36": [26], "base64": [26, 52, 62], "base64url": [26, 52, 62]}
GRID = [1e-6, 1e-5, 1e-4, 1e-3, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5]
#: Before the names of helper columns; made anew by each driver, so no caller's column can have it.
P = f"__{uuid.uuid4().hex}_"
BLOCK = 1024


def bound(value: Column, make) -> Column:
    """make(value), with value computed once however often make names it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def running(values: Column, merge, none: Column) -> Column:
    """Running sums (or maxima) of an array of any length, by doubling: n log n steps."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int"))

    def doubled(now: Column, p: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), p)
        moved = F.concat(F.array_repeat(none, step), F.slice(now, F.lit(1), F.size(now) - step))
        return F.when(F.size(now) > step, F.zip_with(moved, now, lambda a, b: merge(a, b))).otherwise(now)

    return F.aggregate(rounds, values, doubled)


def find_all(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places. text must be free of the two marks."""
    parts = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{SHUT}"), f"[{OPEN}{SHUT}]")
    # Parts and matches alternate.
    ends = lambda x: running(F.transform(x, F.length), lambda a, b: a + b, F.lit(0))

    def places(s: Column) -> Column:
        stop = lambda k: F.get(s["ends"], k)
        each = F.transform(s["parts"], lambda x, k: F.struct((stop(k) - F.length(x)).alias("start"), stop(k).alias("stop"), x.alias("found"), (k % 2 == 1).alias("match")))
        return F.filter(each, lambda m: m["match"])

    return bound(parts, lambda x: bound(F.struct(x.alias("parts"), ends(x).alias("ends")), places))


def _long_enough(found: Column, pattern: str, group: int, least: int) -> Column:
    """The places of the matches whose group has at least so many characters."""
    long = F.filter(found, lambda m: F.length(F.regexp_extract(m["found"], pattern, group) if group else m["found"]) >= least)
    return F.transform(long, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop")))


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by a logistic approximation, whose error is under 0.0002."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), 1.5976 * z + 0.070565992 * z * z * z))))


def _battery(found: Column) -> Column:
    """struct(encoding, n, p) of a token."""
    body = F.rtrim(found, F.lit("="))

    def shape(name: str) -> Column:
        cuts, size = CUTS[name], len(ENCODINGS[name][1])
        share = [(b - a) / size for a, b in zip([0, *cuts], [*cuts, size])]
        change = 1 - sum(p * p for p in share)  # of the kind from one character to the next
        both = sum(p * (1 - p) ** 2 for p in share) - change**2
        three = [float(c) for c in (cuts + [size] * 3)[:3]]
        return F.struct(F.lit(name).alias("encoding"), F.lit(ENCODINGS[name][1]).alias("alphabet"), F.lit(change).alias("change"), F.lit(both).alias("both"), *(F.lit(c).alias(f"c{k}") for k, c in enumerate(three)))

    kind = shape("base64url")
    for name, (pattern, _) in reversed(ENCODINGS.items()):
        kind = F.when(body.rlike(f"^{pattern}$"), shape(name)).otherwise(kind)

    def measured(t: Column) -> Column:
        letters = F.split(t["body"], "")
        index = F.transform(letters, lambda c: F.greatest(F.lit(0), F.call_function("locate", c, t["kind"]["alphabet"]) - 1).cast("double"))
        return F.struct(t["kind"].alias("kind"), F.length(t["body"]).cast("double").alias("n"), F.length(t["kind"]["alphabet"]).cast("double").alias("k"), index.alias("x"))

    def tested(t: Column) -> Column:
        n, k, x = t["n"], t["k"], t["x"]
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda acc, v: acc + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))
        df = k - 1
        z1 = (F.cbrt(F.greatest(F.lit(0.0), (k / n * squares - n) / df)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mid = (k - 1) / 2
        pairs = F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), F.slice(x, F.lit(2), F.size(x) - 1).alias("b"))
        place = lambda v: sum((v >= t["kind"][f"c{i}"]).cast("int") for i in range(3))
        changes = F.size(F.filter(pairs, lambda p: place(p["a"]) != place(p["b"]))).cast("double")
        change = t["kind"]["change"]
        z2 = F.abs(changes - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change) + 2 * (n - 2) * t["kind"]["both"])
        products = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - mid) * (p["b"] - mid))
        z3 = F.abs(products / ((k * k - 1) / 12)) / F.sqrt(n - 1)
        p = F.least(F.lit(1.0), 3 * F.least(_upper_tail(z1), 2 * _upper_tail(z2), 2 * _upper_tail(z3)))
        return F.struct(t["kind"]["encoding"].alias("encoding"), n.cast("int").alias("n"), p.alias("p"))

    one = F.array(F.struct(body.alias("body"), kind.alias("kind")))
    return F.element_at(F.transform(F.transform(one, measured), tested), 1)


def _stratum(encoding: Column, n: Column) -> Column:
    """Encoding and length class: a class for each 8 characters up to 64, then one."""
    return F.concat(encoding, F.lit("/"), F.least(F.lit(8), F.floor(n / 8)).cast("string"))


def _apart(tokens: Column, known: Column) -> Column:
    """The tokens that overlap no known span: the known ones before end by then, and the next known one starts later."""
    of = lambda spans, own: F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(own).alias("own"), (m["found"] if own else F.lit("")).alias("found")))
    first, last = F.lit(-1), F.lit(2**31 - 1)

    def judged(every: Column) -> Column:
        ends = running(F.transform(every, lambda m: F.when(m["own"], first).otherwise(m["stop"])), F.greatest, first)
        starts = F.reverse(running(F.reverse(F.transform(every, lambda m: F.when(m["own"], last).otherwise(m["start"]))), F.least, last))
        return bound(
            F.struct(every.alias("every"), ends.alias("ends"), starts.alias("starts")),
            lambda s: F.filter(s["every"], lambda m, k: m["own"] & (F.get(s["ends"], k) <= m["start"]) & (F.get(s["starts"], k) >= m["stop"])),
        )

    return bound(F.array_sort(F.concat(of(known, False), of(tokens, True))), judged)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, the spans of each kind and the battery's candidates, of every row of docs (with the columns in keep)."""
    text = F.translate(text_or_empty(text_col), OPEN + SHUT, "")
    base = docs.select(*(F.col(c) for c in keep or [id_col]), text.alias(P + "text"))
    spans = {f"{P}{kind}": _long_enough(find_all(F.col(P + "text"), pattern), pattern, group, least) for kind, (pattern, group, least) in KINDS.items()}
    base = base.withColumns(spans | {P + "tokens": F.filter(find_all(F.col(P + "text"), TOKEN), lambda m: m["found"].rlike(r"[0-9]|[a-z][A-Z]") & m["found"].rlike("[A-Za-z]") | m["found"].rlike("^[0-9]+=*$"))})
    known = F.concat(*(F.col(f"{P}{k}") for k in KINDS))
    free = _apart(F.col(P + "tokens"), known)
    tested = F.transform(free, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), _battery(m["found"]).alias("t")))
    return base.drop(P + "text").withColumn(P + "candidates", tested).drop(P + "tokens")


def thresholds(scanned: DataFrame, fdr: float = 0.05, least: int = 20) -> dict[str, float]:
    """stratum -> least p-value that is reported; strata that report nothing are absent."""
    bucket = F.lit(0)
    for g in GRID:
        bucket = bucket + (F.col("c.t.p") >= g).cast("int")
    cells = scanned.select(F.explode(P + "candidates").alias("c")).select(_stratum(F.col("c.t.encoding"), F.col("c.t.n")).alias("stratum"), bucket.alias("bucket"))
    counts: dict[str, list[int]] = {}
    for r in cells.groupBy("stratum", "bucket").count().collect():  # encodings x length classes x grid at most
        counts.setdefault(r["stratum"], [0] * (len(GRID) + 1))[r["bucket"]] = r["count"]
    low = GRID.index(0.01) + 1  # cells below 0.01: text, but for a hundredth of the random tokens

    def text_above(c: list[int], g: float) -> float:
        """Text tokens with p >= g by the decades' decline: each higher decade has the same share of the one below.

        Text never rises, so what the last decade has beyond the one below it is random tokens.
        """
        below = c[low - 2]
        last = min(c[low - 1], below)
        share = last / below if below else 0.0
        if g < 0.01:
            return sum(c[GRID.index(g) + 1 : low - 1]) + last + last * share * (1 + share)
        return last * share ** (3 + math.log10(g)) * (1 + share)

    out = {}
    for stratum, own in sorted(counts.items()):
        whole = own
        for members in ([m for m in counts if m.split("/")[1] == stratum.split("/")[1]], list(counts)):
            if sum(whole[:low]) < least:  # too little text to estimate from
                whole = [sum(counts[m][k] for m in members) for k in range(len(GRID) + 1)]
        part = 1.0 if whole is own else sum(own) / max(1, sum(whole[:low]))
        for k, g in enumerate(GRID, 1):
            reported = sum(own[k:])
            if reported and part * text_above(whole, g) <= fdr * reported:
                out[stratum] = g
                break
    return out


def random_spans(limits: dict[str, float]) -> Column:
    """The candidates that the battery reports."""
    if not limits:
        return F.expr("cast(array() as array<struct<start:int,stop:int>>)")
    of = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))
    passed = F.filter(P + "candidates", lambda c: F.coalesce(c["t"]["p"] >= F.try_element_at(of, _stratum(c["t"]["encoding"], c["t"]["n"])), F.lit(False)))
    return F.transform(passed, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop")))


def _listed(kinds: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    def of(i: int, kind: str) -> Column:
        return F.transform(f"{P}{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    every = F.concat(*(of(i, kind) for i, kind in enumerate(kinds)))
    return F.array_join(F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans of every row of docs."""
    scanned = written(scan(docs))  # spans only: the texts are read once
    out = scanned.withColumn(P + "random", random_spans(thresholds(scanned, fdr)))
    return out.select(
        "doc_id",
        *(F.size(f"{P}{k}").cast("long").alias(f"n_{k}") for k in [*KINDS, "random"]),
        F.sha2(_listed(list(KINDS)), 256).alias("base_sha256"),
        _listed([*KINDS, "random"]).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[secret]", fdr: float = 0.05, text_col: str = "text") -> DataFrame:
    """docs with every secret in the text replaced by the mark; a null text stays null."""
    scanned = written(scan(docs, keep=docs.columns, text_col=text_col))  # each text is scanned once
    out = scanned.withColumn(P + "random", random_spans(thresholds(scanned, fdr)))
    every = F.array_sort(F.concat(*(F.col(f"{P}{k}") for k in [*KINDS, "random"])))
    text = F.col(text_col).cast("string")

    def pieces(s: Column) -> Column:
        block = lambda k: F.coalesce(F.get(s["blocks"], k), F.lit(""))

        def between(a: Column, b: Column) -> Column:
            i, j = (a / BLOCK).cast("int"), (b / BLOCK).cast("int")
            inner = F.array_join(F.slice(s["blocks"], i + 2, F.greatest(j - i - 1, F.lit(0))), "")
            across = F.concat(F.substring(block(i), a % BLOCK + 1, F.lit(BLOCK)), inner, F.substring(block(j), F.lit(1), b % BLOCK))
            return F.when(i == j, F.substring(block(i), a % BLOCK + 1, b - a)).otherwise(across)

        # What lies before a span, from the end of all spans before it; a span that begins inside another adds nothing.
        at = lambda k: F.coalesce(F.get(s["ends"], k - 1), F.lit(0))
        parts = F.transform(s["every"], lambda x, k: F.when(x["start"] >= at(k), F.concat(between(at(k), x["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), between(F.element_at(s["ends"], -1), s["length"]))

    ends = running(F.transform(every, lambda x: x["stop"]), F.greatest, F.lit(0))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    new = bound(F.struct(every.alias("every"), ends.alias("ends"), blocks.alias("blocks"), F.length(text).alias("length")), pieces)
    return out.withColumn(text_col, F.when(F.size(every) > 0, new).otherwise(F.col(text_col))).select(*docs.columns)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    return find_secrets(table(spark, sf_dir, "documents"))
