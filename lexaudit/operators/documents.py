"""Documents, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE, HEADER, MARKS, UNMARKED

#: Marks of headers.
_HEAD, _TAIL = MARKS
BLANK_LINE = r"(?U)\n\s*\n"


def with_metadata(docs: DataFrame) -> DataFrame:
    """document_type and the two sorted lists of mentions."""
    return docs.withColumns({
        "document_type": T.document_type(F.col("text")),
        "potential_data_mentions": T.data_mentions(F.col("text")),
        "compliance_indicators": T.compliance_words(F.col("text")),
    })


def sections(docs: DataFrame) -> DataFrame:
    """One row per section: doc_id, section_ord, title, text, level, and the other columns of ``docs``.

    Each header is marked in one pass of the pattern, and the text is split at the marks; a header takes its line ends, so a
    header on the very next line is not one. A text without headers is one section ``Document`` with the whole text.
    Noncharacters that mark headers become U+FFFD where a text holds them. Text before the first header, unless blank, is ``Introduction/Header`` with section_ord 0; headers count from 1.
    """
    marked = F.regexp_replace(F.translate("text", MARKS, UNMARKED), "(?Ud)" + HEADER, f"{_HEAD}$0{_TAIL}")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # has_headers comes with each piece: an expression beside the explode would search the whole text again for each section
    each = T.let(F.split(marked, _HEAD, -1), lambda pieces: F.transform(pieces, lambda p: F.struct(p.alias("piece"), (F.size(pieces) > 1).alias("has_headers"))))
    pieces = docs.select("doc_id", *rest, F.posexplode(each).alias("piece_ord", "v")).select("doc_id", *rest, "piece_ord", "v.*")
    header = F.substring_index("piece", _TAIL, 1)
    is_section = F.contains("piece", F.lit(_TAIL))
    # a header pattern that matches takes its first alternative that fits: numbered headers count their dots
    numbered = header.rlike(r"\A\n?\d+(?:\.\d+)*\.\s+[^\n]")
    level = F.when(is_section & numbered, F.regexp_count(header, F.lit(r"\."))).otherwise(0)
    title = F.when(~F.col("has_headers"), "Document").when(is_section, T.strip(header)).otherwise("Introduction/Header")
    body = F.when(F.col("has_headers"), T.strip(F.replace("piece", F.lit(_TAIL), F.lit("")))).otherwise(F.col("piece"))
    kept = pieces.select("doc_id", F.col("piece_ord").cast("int").alias("section_ord"), title.alias("title"), body.alias("text"), level.cast("int").alias("level"), *rest, "has_headers", is_section.alias("is_section"))
    return kept.where("is_section or not has_headers or text <> ''").drop("has_headers", "is_section")


def _packed(size: Column, overlap: Column) -> Column:
    """The chunks of a section longer than ``size``: an ordered fold of its paragraphs.

    A paragraph that would pass the size closes the chunk; the next chunk starts with the end of the last one, cut after its
    first sentence end. A paragraph is never cut itself.
    """
    paragraphs = F.filter(F.transform(F.split("text", BLANK_LINE, -1), T.strip), lambda p: p != "")
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        full = (F.length(cur) + F.length(p) + 2 > size) & (cur != "")
        tail = F.regexp_replace(F.right(cur, overlap), r"(?U)\A(?s:.*?[.!?])\s+", "")
        again = F.when((overlap > 0) & (F.length(cur) > overlap), F.concat(tail, F.lit("\n\n"), p)).otherwise(p)
        grown = F.when(cur != "", F.concat(cur, F.lit("\n\n"), p)).otherwise(p)
        return F.struct(F.when(full, again).otherwise(grown).alias("cur"), F.when(full, F.array_append(acc["out"], cur)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(paragraphs, start, step, lambda acc: F.when(acc["cur"] != "", F.array_append(acc["out"], acc["cur"])).otherwise(acc["out"]))


def chunk_parts(section_rows: DataFrame, size: Column | None = None, overlap: Column | None = None) -> DataFrame:
    """One row per chunk of each section, before the chunks of a document are numbered; part counts from 1."""
    size = F.lit(DEFAULT_CHUNK_SIZE) if size is None else size
    overlap = F.lit(DEFAULT_CHUNK_OVERLAP) if overlap is None else overlap
    whole = F.length("text") <= size
    texts = F.when(whole, F.array("text")).otherwise(_packed(size, overlap))
    rest = [c for c in section_rows.columns if c not in ("text", "title")]
    rows = section_rows.select(*rest, "title", whole.alias("whole"), F.posexplode(texts).alias("part", "text"))
    position = F.when(F.col("whole"), F.col("title")).otherwise(F.format_string("%s (Part %d)", F.col("title"), F.col("part") + 1))
    return rows.select(*rest, (F.col("part") + 1).cast("int").alias("part"), position.alias("position"), "text")


def chunks(section_rows: DataFrame, size: Column | None = None, overlap: Column | None = None) -> DataFrame:
    """doc_id, chunk_index, position, text, level, and the other columns of the sections. Chunks are numbered within a document."""
    parts = chunk_parts(section_rows, size, overlap)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_ord", "part")) - 1
    rest = [c for c in parts.columns if c not in ("doc_id", "section_ord", "part", "position", "text", "level")]
    return parts.withColumn("chunk_index", order.cast("int")).select("doc_id", "chunk_index", "position", "text", "level", *rest)
