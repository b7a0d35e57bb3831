"""Places of pattern matches in whole texts, and replacement of spans, with built-in functions in time that grows with the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import running

#: Code points of the pieces by which spans are cut out of a text.
PIECE = 4_096
_NONE = "cast(array() as array<string>)"


def located(df: DataFrame, name: str, text: str, pattern: str, where: Column | None = None) -> DataFrame:
    """``df`` with the matches of ``pattern`` in column ``text`` (``<name>_m``), the texts around them (``_g``, one more) and their places from 0 (``_at``).

    Where ``where`` (by default: there is a match) is false, the arrays are empty.
    """
    has, p, none = F.col(text).rlike(pattern) if where is None else where, F.lit(pattern), F.expr(_NONE)
    df = df.withColumn(f"{name}_m", F.when(has, F.regexp_extract_all(text, p, F.lit(0))).otherwise(none))
    df = df.withColumn(f"{name}_g", F.when(has, F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn(f"{name}_n", F.expr(f"zip_with(slice({name}_g, 1, size({name}_m)), {name}_m, (a, b) -> length(a) + length(b))"))
    return df.withColumn(f"{name}_at", F.expr(f"zip_with({running(f'{name}_n', 'acc + x', '0')}, {name}_m, (s, m) -> s - length(m))")).drop(f"{name}_n")


def replaced(df: DataFrame, text: str, spans: str, out: str) -> DataFrame:
    """``df`` with column ``out``: the text whose spans, sorted (start, end, mark), are replaced by their marks; of a run of overlapping spans the first mark stands."""
    own = [*df.columns, out]
    df = df.withColumn("_ends", F.expr(f"transform({spans}, s -> s.end)"))
    df = df.withColumn("_reach", F.expr(running("_ends", "greatest(acc, x)", "0L")))
    df = df.withColumn("_heads", F.expr(f"CASE WHEN size({spans}) > 0 THEN filter(sequence(0, size({spans}) - 1), i -> i = 0 OR {spans}[i].start >= _reach[i - 1]) ELSE array() END"))
    last = f"zip_with(_heads, concat(slice(_heads, 2, size(_heads)), array(size({spans}))), (h, following) -> struct({spans}[h].start AS a, _reach[following - 1] AS b, {spans}[h].mark AS mark))"
    df = df.withColumn("_cuts", F.expr(f"CASE WHEN size(_heads) > 0 THEN {last} END"))
    df = df.withColumn("_pieces", F.when(F.size("_cuts") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    # the code points from a to b lie in one piece, or in the end of one, whole ones and the start of another
    before = f"concat(array(struct(0L AS a, 0L AS b, '' AS mark)), _cuts, array(struct(cast(length({text}) as bigint) AS a, 0L AS b, '' AS mark)))"
    df = df.withColumn("_cuts", F.expr(f"CASE WHEN size(_cuts) > 0 THEN {before} END"))
    kept = "struct(cast(_cuts[i - 1].b as int) AS a, cast(_cuts[i].a as int) AS b)"
    part = f"""CASE WHEN k.a div {PIECE} = k.b div {PIECE} THEN substring(coalesce(get(_pieces, cast(k.a div {PIECE} as int)), ''), k.a % {PIECE} + 1, k.b - k.a)
      ELSE concat(substring(coalesce(get(_pieces, cast(k.a div {PIECE} as int)), ''), k.a % {PIECE} + 1), array_join(slice(_pieces, cast(k.a div {PIECE} as int) + 2, cast(k.b div {PIECE} - k.a div {PIECE} as int) - 1), ''), left(coalesce(get(_pieces, cast(k.b div {PIECE} as int)), ''), k.b % {PIECE})) END"""
    parts = f"zip_with(transform(transform(sequence(1, size(_cuts) - 1), i -> {kept}), k -> {part}), slice(_cuts, 2, size(_cuts)), (t, c) -> concat(t, c.mark))"
    return df.withColumn(out, F.expr(f"CASE WHEN size(_cuts) > 0 THEN array_join({parts}, '') ELSE {text} END")).select(*dict.fromkeys(own))
