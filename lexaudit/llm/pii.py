"""Personal data with DataFrame functions: known shapes, and information-theoretic sanitisation of the terms that reveal them.

Method
------
Base kinds (email, ip, card, phone) are patterns with a check of their digits. Each distinct value is a protected entity. The terms (runs of letters and digits,
``TERM_CHARS`` long) within ``WINDOW`` code points of its mentions are about it. Over all terms of all texts, with N terms, n_t of them the term t, n_e of
them about the entity e and n_et both, a term reveals

    PMI(e; t) / IC(e) = log(n_et N / (n_t n_e)) / log(N / n_e)

of the entity's information: 1 if it stands near that entity alone, 0 if it is independent of it. A term that reveals ``DISCLOSURE`` or more of any entity, by
``CONTEXTS`` different contexts or more (copies of one text are one context), is sanitised wherever it stands: generalised to its first
``STEM`` characters if those, counted over all terms that share them, stay below the threshold for every entity, and else removed.

Patterns are written so that matching takes time in the length of the text and no recursion: a separator that can't belong to a match is
replaced by a noncharacter first (a text's own noncharacter by another, so places stay the same), which leaves runs of one class of characters.

Scale. Texts are scanned row by row. Terms are counted with partial sums before the shuffle; pairs of entity and term come from the windows of mentions only.
The terms to sanitise are broadcast up to ``BROADCAST_TERMS`` of them, and joined by a shuffle beyond.

Defined results: null text is empty and has no span; null ids are kept. Repeated rows are scanned each, and their terms are counted each. Spans of different base kinds may
overlap; a term that overlaps one is left out. Spans that start together come in the order of KINDS. An empty table gives no rows.
Texts of any length are read whole, words in pieces of about ``PIECE_CHARS``. Extra columns are ignored by ``scan_pii`` and passed on by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import located, replaced
from .storage import Workspace

#: Noncharacters: the one that stands for a separator, and the one that stands for the first in a text that holds it.
_CUT, _OTHER = "\ufdd0", "\ufdd1"
_LOCAL = rf"[A-Za-z0-9._%+{_CUT}-]"
#: kind: (pattern of separators to replace, pattern of the kind, what a text must hold to be searched)
PATTERNS = {
    "email": (r"\.(?![A-Za-z0-9-])", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "@"),
    "ip": (None, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": (r"[\x20-](?![0-9])", r"[0-9][0-9\x20-]*[0-9]", r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": (None, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
KINDS = (*PATTERNS, "term")
WINDOW, TERM_CHARS, CONTEXTS, DISCLOSURE, STEM = 100, (3, 40), 3, 0.9, 3
BROADCAST_TERMS, PIECE_CHARS, _BUCKET = 200_000, 4_096, 64
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
REMOVED = "[REMOVED]"
_WORD = r"[\p{L}\p{N}]+"
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = "aggregate(sequence(1, length(d)), 0, (acc, i) -> acc + CASE WHEN i % 2 = 1 THEN cast(substring(d, length(d) - i + 1, 1) as int) ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring(d, length(d) - i + 1, 1) as int) + 1) END) % 10 = 0"
_BYTE = "0*([01]?[0-9]{1,2}|2[0-4][0-9]|25[0-5])"
CHECKS = {
    "email": "true",
    "ip": f"m RLIKE '^{_BYTE}([.]{_BYTE}){{3}}$'",
    "card": f"exists(array({_DIGITS}), d -> length(d) BETWEEN 12 AND 19 AND {_LUHN})",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}
ENTITY = {"email": "lower(m)", "ip": "m", "card": _DIGITS, "phone": _DIGITS}


def _terms(text: str) -> str:
    """SQL of the terms of a text."""
    words = f"regexp_extract_all({text}, '{_WORD.replace(chr(92), chr(92) * 2)}', 0)"
    return f"filter(transform({words}, w -> lower(w)), w -> length(w) BETWEEN {TERM_CHARS[0]} AND {TERM_CHARS[1]})"


def _scan(docs: DataFrame) -> DataFrame:
    """``docs``, which has ``body``, with an array of (start, kind, end) for each base kind, and ``mentions``: entity and the texts before and after."""
    df = docs.withColumn("_clean", F.translate("body", _CUT, _OTHER))
    mentions = []
    for i, (kind, (cut, pattern, guard)) in enumerate(PATTERNS.items()):
        text = F.regexp_replace("_clean", cut, _CUT) if cut else F.col("_clean")
        needed = F.contains("_clean", F.lit(guard)) if len(guard) == 1 else F.col("_clean").rlike(guard)
        df = df.withColumn("_needed", needed).withColumn("_searched", F.when(F.col("_needed"), text).otherwise(""))
        df = located(df, kind, "_searched", pattern, F.col("_needed"))
        left = f"CASE WHEN length({kind}_g[i]) > {WINDOW} THEN regexp_replace(right({kind}_g[i], {WINDOW}), '^[\\\\p{{L}}\\\\p{{N}}]+', '') ELSE {kind}_g[i] END"
        right = f"CASE WHEN length({kind}_g[i + 1]) > {WINDOW} THEN regexp_replace(left({kind}_g[i + 1], {WINDOW}), '[\\\\p{{L}}\\\\p{{N}}]+$', '') ELSE {kind}_g[i + 1] END"
        every = f"CASE WHEN size({kind}_m) > 0 THEN sequence(0, size({kind}_m) - 1) ELSE array() END"
        row = f"transform(array({kind}_m[i]), m -> struct(cast({kind}_at[i] as bigint) AS start, {i} AS kind, cast({kind}_at[i] + length(m) as bigint) AS end, {CHECKS[kind]} AS valid, concat('{kind}:', {ENTITY[kind]}) AS entity, {left} AS left, {right} AS right))[0]"
        df = df.withColumn(f"_{kind}", F.expr(f"filter(transform({every}, i -> {row}), s -> s.valid)"))
        df = df.withColumn(kind, F.expr(f"transform(_{kind}, s -> struct(s.start, s.kind, s.end))"))
        mentions.append(f"transform(_{kind}, s -> struct(s.entity, s.left, s.right))")
    return df.withColumn("mentions", F.expr(f"concat({', '.join(mentions)})")).select(*docs.columns, *PATTERNS, "mentions")


#: Pieces of a text end before or after a word; a run of letters longer than a piece is no term.
_PIECES = rf"(?s).{{1,{PIECE_CHARS}}}(?![\p{{L}}\p{{N}}])|.{{1,{PIECE_CHARS}}}"


def _words(found: DataFrame) -> DataFrame:
    """row, start, end and term of every term of ``body``."""
    pieces = located(found.select("row", "body"), "p", "body", _PIECES, F.col("body") != "").select("row", F.explode(F.arrays_zip(F.col("p_m").alias("piece"), F.col("p_at").alias("at"))).alias("x"))
    words = located(pieces.select("row", "x.at", "x.piece"), "w", "piece", _WORD, F.lit(True)).select("row", "at", F.explode(F.arrays_zip(F.col("w_m").alias("word"), F.col("w_at").alias("start"))).alias("w"))
    start = (F.col("at") + F.col("w.start")).cast("long")
    return words.select("row", start.alias("start"), (start + F.length("w.word")).alias("end"), F.lower("w.word").alias("term")).where(F.length("term").between(*TERM_CHARS))


def _counted(found: DataFrame) -> DataFrame:
    """How often each term stands in all texts."""
    pieces = found.select(F.explode(F.regexp_extract_all("body", F.lit(_PIECES), F.lit(0))).alias("piece"))
    words = pieces.select(F.explode(F.regexp_extract_all("piece", F.lit(_WORD), F.lit(0))).alias("word")).select(F.lower("word").alias("term"))
    return words.where(F.length("term").between(*TERM_CHARS)).groupBy("term").agg(F.count("*").alias("n_t"))


def revealing_terms(found: DataFrame, ws: Workspace) -> DataFrame:
    """term, disclosure (of the entity it reveals most of) and mark, for the terms to sanitise. ``found`` has ``body`` and ``mentions``."""
    counted = ws.save(_counted(found), "counted")
    total = counted.agg(F.coalesce(F.sum("n_t"), F.lit(0)).alias("n"))
    windows = found.select(F.explode("mentions").alias("x")).select("x.entity", F.expr(f"concat({_terms('x.left')}, {_terms('x.right')})").alias("terms"), F.xxhash64("x.left", "x.right").alias("context"))
    windows = ws.save(windows, "windows")
    about = windows.groupBy("entity").agg(F.sum(F.size("terms")).alias("n_e"))
    pairs = windows.select("entity", "context", F.explode("terms").alias("term"))
    near = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et"), F.countDistinct("context").alias("contexts"))
    share = F.expr("ln(least(n_et, n_t) * cast(n as double) / (cast(n_t as double) * n_e)) / ln(cast(n as double) / n_e)")
    revealed = near.where(F.col("contexts") >= CONTEXTS).join(counted, "term").join(about, "entity").crossJoin(F.broadcast(total)).withColumn("disclosure", share)  # total is one row
    terms = revealed.where(F.col("disclosure") >= DISCLOSURE).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    terms = ws.save(terms, "terms")
    stem = F.left("term", F.lit(STEM)).alias("stem")
    wanted = terms.where(F.length("term") > STEM).select(stem).distinct()
    stems = counted.groupBy(stem).agg(F.sum("n_t").alias("n_t")).join(wanted, "stem")
    near_stem = near.groupBy("entity", stem).agg(F.sum("n_et").alias("n_et")).join(wanted, "stem")
    open_stems = near_stem.join(stems, "stem").join(about, "entity").crossJoin(F.broadcast(total)).withColumn("disclosure", share).groupBy("stem").agg(F.max("disclosure").alias("most")).where(F.col("most") < DISCLOSURE)
    general = terms.join(open_stems, (F.left("term", F.lit(STEM)) == F.col("stem")) & (F.length("term") > STEM), "left")
    return ws.save(general.select("term", "disclosure", F.coalesce(F.concat("stem", F.lit("*")), F.lit(REMOVED)).alias("mark")), "revealing")


def _located_terms(found: DataFrame, ws: Workspace) -> DataFrame:
    """row and ``term``: an array of (start, kind, end, mark)."""
    terms = revealing_terms(found, ws).select("term", "mark")
    hits = _words(found).join(F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms, "term").select("row", "start", "end", "mark")
    hits = ws.save(hits, "hits")  # else the optimiser joins all words with the base spans first
    # a base span reaches the terms that start in its buckets of the text or in the one before
    base = found.select(F.col("row").alias("r"), F.explode(F.concat(*PATTERNS)).alias("s"))
    cover = base.select("r", "s.start", "s.end", F.explode(F.expr(f"sequence(s.start div {_BUCKET} - 1, (s.end - 1) div {_BUCKET})")).alias("bucket"))
    hits = hits.alias("h").join(cover.alias("c"), F.expr(f"h.row = c.r AND h.start div {_BUCKET} = c.bucket AND h.start < c.end AND h.end > c.start"), "left_anti")
    return hits.groupBy(F.col("row").alias("r")).agg(F.sort_array(F.collect_list(F.struct("start", F.lit(KINDS.index("term")).alias("kind"), "end", "mark"))).alias("term"))


def _found(docs: DataFrame, keep: list[str], ws: Workspace) -> DataFrame:
    found = ws.save(_scan(docs.withColumn("row", F.monotonically_increasing_id())).select("row", *keep, "body", *PATTERNS, "mentions"), "found")
    none = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint, mark: string>>)")
    return found.drop("mentions").join(_located_terms(found, ws), F.col("row") == F.col("r"), "left").withColumn("term", F.coalesce("term", none))


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, an array of (start, kind, end) for each base kind, and ``term`` with the marks of the terms as well."""
    ws = Workspace(docs.sparkSession, "pii")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return _found(docs.select(F.col(id_col).alias("doc_id"), body.alias("body")), ["doc_id"], ws).select("doc_id", *KINDS)


def span_text(spans: str):
    """kind:start:end of spans (start, kind, end), sorted and comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform(array_sort({spans}), s -> concat_ws(':', array({names})[s.kind], s.start, s.end)), ',')")


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``; base spans give way to the marks of their kinds, revealing terms to their generalisation or to ``REMOVED``. Null texts stay null."""
    ws = Workspace(docs.sparkSession, "sanitise")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    marks = ", ".join(f"'{MARKS[k]}'" for k in PATTERNS)
    spans = f"array_sort(concat({', '.join(f'transform({k}, s -> struct(s.start, s.end, array({marks})[s.kind] AS mark))' for k in PATTERNS)}, transform(term, s -> struct(s.start, s.end, s.mark))))"
    df = replaced(_found(own, ["doc"], ws).withColumn("spans", F.expr(spans)), "body", "spans", "new")
    text = F.when(F.col(f"doc.`{text_col}`").isNotNull(), F.col("new"))
    return df.select(*(text.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
