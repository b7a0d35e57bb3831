"""Secret scans with DataFrame functions: known shapes, and a randomness test battery with false-discovery control.

Method
------
Base kinds are patterns whose matches are kept with their places. Places come from the lengths of the matches and of the
text between them (prefix sums), in code points. The kind ``random`` covers other tokens of ``MIN_TOKEN`` or more characters:

* the encoding is inferred from the characters (decimal, hex, one-case letters or letters with digits, letters of both cases
  with digits, base64, base64url, else all of their symbols), which gives an alphabet of A symbols;
* three tests of the token being uniform over its alphabet give a p-value each: chi-squared on the symbol counts
  (Wilson and Hilferty), runs above and below the middle of the alphabet, and lag-1 serial correlation, all two-sided;
* the hypothesis to reject is that the token's characters are drawn like the characters of all texts. The evidence against it is an e-value: the likelihood ratio of
  uniform symbols to that model, divided by the number of encodings, times 4 p^3 for each of the three p-values. The tests depend on each other, so over
  uniform tokens the product of these factors has a mean above 1: from 1.26 to 1.88 by simulation, over all alphabets and lengths from ``MIN_TOKEN`` (a test repeats it).
  It is divided by ``TESTS_MEAN`` = 2, so the whole stays an e-value; sorted, repeated or
  patterned tokens lose by it what their symbols gain. The evidence grows with the length, so a short token needs improbable symbols;
* the e-value Benjamini-Hochberg procedure over all tokens of the table keeps the share of false discoveries below
  ``FALSE_DISCOVERIES``, however the tokens depend on each other.

The model of text has five classes of characters, whose shares are counted over all texts; the characters of a class share its probability evenly. Costs are rounded
down and have an upper bound for each class, both of which only lessen the evidence, so it stays an e-value.

Evidence is counted in whole 1/64 bits. One scan writes each document's spans and the evidence of its tokens; the threshold comes
from a histogram of evidence in whole bits.

Defined results: null text is empty and gives no span; null ids are kept. Repeated rows are scanned each and counted each, in the model of text and among the tests. Tokens of equal
evidence are all found or all left. Overlapping spans of different kinds are all reported. An empty table gives no rows. A very long text is scanned whole, as one row.
Extra columns are ignored by ``scan_secrets`` and passed on by ``redact_secrets``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import running
from .storage import Workspace


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + f"|{_any_case('api')}_?{_any_case('key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
MIN_TOKEN = 20
TOKEN = f"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": TOKEN}
MIN_VALUE = 6
#: (name, pattern of the whole token, symbols in order); the first that fits is inferred.
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex upper", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower with digits", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper with digits", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("letters with digits", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Classes of the characters of tokens; the frequent letters are a class of their own.
CLASSES = ("etaoinshrdlu", "bcfgjkmpqvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_-")
#: The most that a character of each class costs, in 1/64 bit: shares of 0.055, 0.0125, 0.002, 0.0095 and 0.0035. Where texts hold fewer digits or capitals, names and numbers still do.
MOST_COST = (268, 405, 574, 430, 522)
#: The factor of a p-value is (POWER + 1) * p ** POWER.
POWER = 3
TESTS_MEAN = 2.0
FALSE_DISCOVERIES = 0.01
MAX_BITS = 1000


def _tail_bits(z: str) -> str:
    """SQL of the 1/64 bits that a test adds whose statistic is ``z`` >= 0 on the normal scale: of (POWER + 1) * p ** POWER, with p = 2 / (1 + exp(1.5976 z + 0.07056 z^3))."""
    e = f"exp(least(700D, 1.5976D * {z} + 0.07056D * {z} * {z} * {z}))"
    return f"cast(floor(64 * ({math.log2(POWER + 1)}D + {POWER} * (1D - log2(1 + {e})))) as bigint)"


def _choose(value: str, cases: dict) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + " END"


def character_costs(docs: DataFrame, text: Column) -> list[int]:
    """The cost of a character of each class in ordinary text, in 1/64 bit, from all texts."""
    counts = docs.select(*(F.sum(F.length(text) - F.length(F.translate(text, c, ""))).alias(f"n{i}") for i, c in enumerate(CLASSES))).first()  # one row
    seen = [(n or 0) + 1 for n in counts]
    return [min(most, math.floor(-64 * math.log2(n / sum(seen) / len(c)))) for n, c, most in zip(seen, CLASSES, MOST_COST)]


def _battery(df: DataFrame, costs: list[int]) -> DataFrame:
    """``battery``: for each token its place and the bits of evidence against text."""
    alphabet = "CASE " + " ".join(f"WHEN t.token RLIKE '{p}' THEN '{s}'" for _, p, s in ENCODINGS if p) + f" ELSE '{ENCODINGS[-1][2]}' END"
    sizes = sorted({len(s) for _, _, s in ENCODINGS})
    bits = _choose("t.size", {a: round(64 * math.log2(a)) for a in sizes})
    cost = "CASE " + " ".join(f"WHEN instr('{c}', c) > 0 THEN {k}L" for c, k in zip(CLASSES[:-1], costs)) + f" ELSE {costs[-1]}L END"
    total = lambda array: f"aggregate({array}, 0L, (acc, v) -> acc + v)"
    squares = total("transform(array_distinct(t.y), s -> cast(size(filter(t.y, v -> v = s)) as bigint) * size(filter(t.y, v -> v = s)))")
    runs = "1 + size(filter(sequence(1, t.n - 1), i -> (t.y[i - 1] > 0) <> (t.y[i] > 0)))"
    neighbours = total("transform(sequence(1, t.n - 1), i -> cast(t.y[i - 1] as bigint) * t.y[i])")
    power = total("transform(t.y, v -> cast(v as bigint) * v)")
    evidence = f"{total(f'transform(t.chars, c -> {cost})')} - t.n * {bits} - {round(64 * math.log2(TESTS_MEAN * len(ENCODINGS)))}"
    chi = "abs(power((cast(t.size as double) * t.squares / t.n - t.n) / (t.size - 1), 1D / 3) - (1 - 2D / (9 * (t.size - 1)))) / sqrt(2D / (9 * (t.size - 1)))"
    even = "abs(2 * t.runs - t.n - 1) / sqrt(t.n - 1D)"
    independent = "abs(cast(t.neighbours as double)) * t.n / (t.power * sqrt(t.n - 1D))"
    tests = " + ".join((_tail_bits("t.chi"), _tail_bits("t.even"), _tail_bits("t.independent")))
    for step in (
        f"t.start, t.end, length(t.token) AS n, split(t.token, '') AS chars, {alphabet} AS alphabet",
        # y: places in the alphabet, doubled and centred, so that they stay whole numbers
        "t.start, t.end, t.n, length(t.alphabet) AS size, t.chars, transform(t.chars, c -> 2 * instr(t.alphabet, c) - 1 - length(t.alphabet)) AS y",
        f"t.start, t.end, t.n, t.size, {squares} AS squares, {runs} AS runs, {neighbours} AS neighbours, {power} AS power, {evidence} AS evidence",
        f"t.start, t.end, t.evidence, {chi} AS chi, {even} AS even, {independent} AS independent",
        f"t.start, t.end, cast(greatest(0, least({MAX_BITS}, (t.evidence + {tests}) div 64)) as int) AS bits",
    ):
        df = df.withColumn("battery", F.expr(f"transform({'battery' if 'battery' in df.columns else 'spans_random'}, t -> struct({step}))"))
    return df


def _scan(docs: DataFrame, text: Column, costs: list[int]) -> DataFrame:
    """``docs`` with arrays of spans of each kind, and the battery of the tokens."""
    df = docs.withColumn("body", F.coalesce(text, F.lit("")))
    for kind, pattern in KINDS.items():
        p = F.lit(pattern)
        has = F.col("body").rlike(pattern)
        none = F.array().cast("array<string>")
        df = df.withColumn(f"m_{kind}", F.when(has, F.regexp_extract_all("body", p, F.lit(0))).otherwise(none))
        df = df.withColumn(f"v_{kind}", F.when(has, F.regexp_extract_all("body", p, F.lit(2))).otherwise(none) if kind == "assign" else F.col(f"m_{kind}"))
        df = df.withColumn(f"g_{kind}", F.when(has, F.expr(f"transform(split(body, {_quoted(pattern)}, -1), g -> length(g))")).otherwise(F.array().cast("array<int>")))
    for kind in KINDS:
        m, g = f"m_{kind}", f"g_{kind}"
        df = df.withColumn(f"at_{kind}", F.expr(f"CASE WHEN size({m}) > 0 THEN zip_with({running(f'zip_with(slice({g}, 1, size({m})), {m}, (a, b) -> a + length(b))', 'acc + x', '0')}, {m}, (s, m) -> s - length(m)) ELSE array() END"))
        span = "struct(cast(at.start as bigint) AS start, cast(at.start + length(at.m) as bigint) AS end, at.m AS token, at.v AS value)"
        least = MIN_VALUE if kind == "assign" else 0
        zipped = f"zip_with(zip_with(at_{kind}, {m}, (s, m) -> struct(s AS start, m)), v_{kind}, (p, v) -> struct(p.start, p.m, v))"
        df = df.withColumn(f"spans_{kind}", F.expr(f"filter(transform({zipped}, at -> {span}), s -> length(s.value) >= {least})"))
    return _battery(df, costs)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _evidence_limit(found: DataFrame) -> int:
    """The fewest bits b with tokens * 2^-b <= FALSE_DISCOVERIES * (tokens of b bits or more)."""
    histogram = found.select(F.explode("battery").alias("t")).groupBy("t.bits").agg(F.count("*").alias("c")).collect()  # at most MAX_BITS + 1 rows
    tests = sum(r.c for r in histogram)
    reached, limit = 0, MAX_BITS + 1
    for r in sorted(histogram, key=lambda r: -r.bits):
        reached += r.c
        if tests * 2.0**-r.bits <= FALSE_DISCOVERIES * reached:
            limit = r.bits
    return limit


def _found(docs: DataFrame, keep: list[str], text_col: str, ws: Workspace) -> tuple[DataFrame, int]:
    spans = [F.expr(f"transform(spans_{k}, s -> struct(s.start, {i} AS kind, s.end))").alias(k) for i, k in enumerate(KINDS) if k != "random"]
    costs = character_costs(docs, F.coalesce(F.col(text_col), F.lit("")))
    found = ws.save(_scan(docs, F.col(text_col), costs).select(*keep, *spans, "battery"), "found")
    return found, _evidence_limit(found)


def _with_random(found: DataFrame, limit: int) -> DataFrame:
    kind = list(KINDS).index("random")
    return found.withColumn("random", F.expr(f"transform(filter(battery, t -> t.bits >= {limit}), t -> struct(t.start, {kind} AS kind, t.end))")).drop("battery")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, an array of (start, kind, end) for each kind, kind being the place in KINDS."""
    ws = Workspace(docs.sparkSession, "secrets")
    found, limit = _found(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text", ws)
    return _with_random(found, limit)


def span_text(spans: str) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat_ws(':', array({names})[s.kind], s.start, s.end)), ',')")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``; each run of overlapping spans in the text is replaced by ``mark``, and the column of lengths, if there is one, follows."""
    ws = Workspace(docs.sparkSession, "redact")
    kept = [f"`{c}`" for c in docs.columns]
    own = docs.select(F.struct(*kept).alias("doc"), F.col(text_col).alias("text"))
    found, limit = _found(own, ["doc"], "text", ws)
    df = _with_random(found, limit).withColumn("spans", F.expr(f"array_sort(concat({', '.join(KINDS)}))"))
    df = df.withColumn("reach", F.expr(running("transform(spans, s -> s.end)", "greatest(acc, x)", "0L")))
    # a run of overlapping spans starts where a span lies beyond all before it
    df = df.withColumn("heads", F.expr("CASE WHEN size(spans) > 0 THEN filter(sequence(0, size(spans) - 1), i -> i = 0 OR spans[i].start > reach[i - 1]) END"))
    df = df.withColumn("cuts", F.expr("zip_with(heads, concat(slice(heads, 2, size(heads)), array(size(spans))), (h, following) -> struct(spans[h].start AS a, reach[following - 1] AS b))"))
    body = f"doc.`{text_col}`"
    pieces = f"concat(transform(sequence(0, size(cuts) - 1), i -> concat(substring({body}, cast(CASE WHEN i = 0 THEN 0 ELSE cuts[i - 1].b END as int) + 1, cast(cuts[i].a - CASE WHEN i = 0 THEN 0 ELSE cuts[i - 1].b END as int)), '{mark}')), array(substring({body}, cast(element_at(cuts, -1).b as int) + 1)))"
    text = F.expr(f"CASE WHEN size(cuts) > 0 THEN array_join({pieces}, '') ELSE {body} END")
    df = df.withColumn("new", text)
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("new").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.size("cuts") > 0, F.length("new").cast(docs.schema[c].dataType)).otherwise(F.col(f"doc.`{c}`")).alias(c))
        else:
            out.append(F.col(f"doc.`{c}`").alias(c))
    return df.select(*out)
