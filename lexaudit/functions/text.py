"""Column functions over text. Patterns follow Unicode classes, and ``$`` stands for the end of the text or of its last line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import (
    CHUNK_TIERS,
    COMPLIANCE_WORDS,
    CONTENT_INDICATORS,
    DATA_MENTIONS,
    DEDUP_CHARS,
    DOCUMENT_TYPES,
    NO_QUOTE,
    PREVIEW_CHARS,
    REFERENCE_KINDS,
    REFERENCE_NUMBER,
    REGULATION_PHRASES,
    STOPWORDS,
    UNKNOWN_ARTICLE,
    UNKNOWN_REGULATION,
)

_KINDS = "|".join(REFERENCE_KINDS)
_SPACES = r"[\s\x1c-\x1f]"


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, also where f uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"(?U)\A{_SPACES}+|{_SPACES}+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){_SPACES}+", " ")


def whole_word(words, ignore_case: bool = False) -> str:
    """Pattern of any of these as a whole word; longer alternatives must come first where one starts another."""
    return f"(?{'i' if ignore_case else ''}U)\\b({'|'.join(words)})\\b"


def document_type(text: Column) -> Column:
    """The first document type in order whose pattern occurs."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(DOCUMENT_TYPES):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def distinct_words(text: Column, words) -> Column:
    """The sorted distinct whole-word matches in the lower-cased text; a match consumes what it covers."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(whole_word(words)), F.lit(1))))


def data_mentions(text: Column) -> Column:
    return distinct_words(text, DATA_MENTIONS)


def compliance_words(text: Column) -> Column:
    return distinct_words(text, COMPLIANCE_WORDS)


def content_indicator(text: Column, name: str) -> Column:
    return F.when(text.rlike(whole_word(CONTENT_INDICATORS[name], True)), "Yes").otherwise("No")


def content_indicators(text: Column) -> Column:
    """Map of the eight indicators."""
    return F.create_map(*(x for name in CONTENT_INDICATORS for x in (F.lit(name), content_indicator(text, name))))


def indicator_bullets(indicators: Column) -> Column:
    lines = F.transform(F.map_entries(indicators), lambda e: F.format_string("- Contains %s references: %s", F.replace(e["key"], F.lit("has_"), F.lit("")), e["value"]))
    return F.array_join(lines, "\n")


def chunk_parameters(n_bytes: Column, size: int, overlap: int) -> tuple[Column, Column]:
    """(chunk size, overlap) by the bytes of the document; the given ones for large documents."""
    best, around = F.lit(size), F.lit(overlap)
    for below, tier_size, tier_overlap in reversed(CHUNK_TIERS):
        best, around = F.when(n_bytes < below, tier_size).otherwise(best), F.when(n_bytes < below, tier_overlap).otherwise(around)
    return best, around


def preview(text: Column) -> Column:
    return F.concat(F.left(text, F.lit(PREVIEW_CHARS)), F.when(F.length(text) > PREVIEW_CHARS, "...").otherwise(""))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*\z", 0)


def file_kind(path: Column) -> Column:
    """pdf or text by the extension in any case; an error for other files."""
    ext = F.regexp_extract(F.lower(path), r"(\.[^./]+)\z", 1)
    return F.when(ext == ".pdf", "pdf").when(ext.isin(".txt", ".md"), "text").otherwise(F.raise_error(F.concat(F.lit("Unsupported file format: "), ext)))


def normalize_text(text: Column) -> Column:
    """Lower-cased, without stopwords and punctuation, with single spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), whole_word(STOPWORDS), "")
    return strip(collapse(F.regexp_replace(bare, r"(?U)[^\w\s]", "")))


def normalize_regulation(regulation: Column, compat: bool = True) -> Column:
    """The key part of a regulation reference. ``compat``: the number is written twice and the kind is left out."""
    bare = strip(collapse(F.regexp_replace(F.lower(regulation), r"(?U)[^\w\s]", "")))
    pattern = r"(?U)(article|regulation|section|rule)\s+(\d+)"
    number = F.regexp_extract(bare, pattern, 2)
    kind = number if compat else F.regexp_extract(bare, pattern, 1)
    return F.when(F.coalesce(regulation, F.lit("")) == "", "unknown").when(number != "", F.concat(kind, number)).otherwise(bare)


def dedup_key(regulation: Column, description: Column, compat: bool = True) -> Column:
    return F.concat_ws(":", normalize_regulation(regulation, compat), F.left(normalize_text(description), F.lit(DEDUP_CHARS)))


def first_quote(text: Column) -> Column:
    """The first quotation with its quotation marks, or an empty string."""
    return F.regexp_extract(text, '"([^"]+)"', 0)


def regulation_reference(text: Column) -> Column:
    """The first reference in parentheses, else the first bare one; a bare number in parentheses counts as a section."""
    inner = rf"(?i)\((?:({_KINDS})\s*)?({REFERENCE_NUMBER})\)"
    bare = rf"(?i)\b({_KINDS})\s*({REFERENCE_NUMBER})\b"
    kind = F.regexp_extract(text, inner, 1)
    by_inner = F.concat_ws(" ", F.when(kind != "", kind).otherwise("Section"), F.regexp_extract(text, inner, 2))
    by_bare = F.concat_ws(" ", F.regexp_extract(text, bare, 1), F.regexp_extract(text, bare, 2))
    return F.when(text.rlike(inner), by_inner).when(text.rlike(bare), by_bare).otherwise(UNKNOWN_REGULATION)


def describe_item(item: Column, dismissed: Column | str) -> Column:
    """The description of an answer's item: what stands before its quotation, joined with an explanation unless that starts with ``dismissed``."""
    if isinstance(dismissed, str):
        dismissed = F.lit(dismissed)

    def described(v: Column) -> Column:
        cut = lambda c: F.when((v["quote"] != "") & (F.instr(c, v["quote"]) > 0), strip(F.split_part(c, v["quote"], F.lit(1)))).otherwise(c)
        explained = (v["tail"] != "") & ~F.startswith(v["tail"], v["dismissed"])
        with_tail = lambda head: F.when(explained & ~F.endswith(head, F.lit(".")), F.concat(head, F.lit(". "), v["tail"])).otherwise(head)
        return F.when(v["n"] > 1, let(cut(v["head"]), with_tail)).otherwise(cut(v["item"]))

    parts = let(F.split(item, "(?i)EXPLANATION:", 2), lambda p: F.struct(F.size(p).alias("n"), strip(p[0]).alias("head"), strip(F.get(p, 1)).alias("tail"), first_quote(item).alias("quote"), item.alias("item"), dismissed.alias("dismissed")))
    return let(parts, described)


def format_article(article: Column) -> Column:
    """A reference in the form ``Article n``."""
    text = F.regexp_replace(F.regexp_replace(strip(article), r"\(+\z", ""), r":+\z", "")
    own = F.regexp_extract(text, r"\A(?i:Article|Art\.)\s*(\d+(?:\(\d+\))?(?:\((?i:[a-z])\))?)", 1)
    other = F.regexp_extract(text, r"\A(?i:Section|Rule|Standard|Requirement|Regulation|Part|Chapter)\s*(\d+(?:\.\d+)?(?:\(\d+\))?(?:\((?i:[a-z])\))?)", 1)
    number = F.regexp_extract(text, r"(\d+(?:\(\d+\))?(?:\([a-z]\))?)", 1)
    unknown = article.isNull() | article.isin("", "Unknown regulation", UNKNOWN_REGULATION) | ~text.rlike(r"\d")
    found = F.when(text.rlike(r"\A\d+\z"), text).when(own != "", own).when(other != "", other).otherwise(number)
    return F.when(unknown, UNKNOWN_ARTICLE).otherwise(F.concat(F.lit("Article "), found))


def is_document_citation(citation: Column) -> Column:
    """Whether a citation looks like text of the document, not of the regulation."""
    text = F.btrim(F.btrim(citation, F.lit('"')), F.lit("'"))
    return (F.length(text) >= 10) & ~F.lower(text).rlike("|".join(REGULATION_PHRASES))


def display_citation(citation: Column) -> Column:
    bare = strip(citation)
    quoted = F.startswith(citation, F.lit('"')) | F.endswith(citation, F.lit('"'))
    return F.when(bare.isin("None", ""), NO_QUOTE).when(quoted, citation).otherwise(F.concat(F.lit('"'), citation, F.lit('"')))


def display_sections(sections: Column) -> Column:
    """All of one or two sections, else two and the number of the rest."""
    more = F.format_string("%s, %s and %d more", F.get(sections, 0), F.get(sections, 1), F.size(sections) - 2)
    return F.when(F.size(sections) <= 2, F.array_join(sections, ", ")).otherwise(more)


def without_asterisks(text: Column) -> Column:
    return F.regexp_replace(text, r"\*+", "")


def confidence_rank(confidence: Column) -> Column:
    """3 to 1 for HIGH, MEDIUM, LOW in any case, else 0."""
    name = F.upper(confidence)
    return F.when(name == "HIGH", 3).when(name == "MEDIUM", 2).when(name == "LOW", 1).otherwise(0)


def summary_sentence(n_findings: Column, n_points: Column, framework: str) -> Column:
    return F.format_string("The document contains %d potential compliance issue(s) and %d compliance point(s) related to %s.", n_findings, n_points, F.lit(framework))
