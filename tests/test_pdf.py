import zlib

import pyarrow as pa
import pytest

from lexaudit.plans import corpus
from lexaudit.plans.corpus import make_pdf
from lexaudit.sources import pdf
from lexaudit.sources.pdf import Document, Lexer, inflate, page_text
from lexaudit.sources.readers import join_pages, read_files

PAGES = ["Hello (world) \\ <x>", "", "two\nlines\n\nand é ß 🙂 日本", "last\n"]


def objects(*bodies: bytes, root: int = 1, extra: bytes = b"") -> bytes:
    """A file of these objects with a cross-reference table."""
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\n"), []
    for i, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"xref\n0 1\n0000000000 65535 f \n1 %d\n%strailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF" % (len(places), table, len(places) + 1, root, extra, len(out)))


def one_page(content: bytes, entries: bytes = b"", font: bytes = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", **options) -> bytes:
    return objects(
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F#31 5 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>",
        b"<< /Length %d %s >>\nstream\r\n%s\nendstream" % (len(content), entries, content), font, **options,
    )


def texts(data: bytes) -> list[str]:
    doc, out = Document(data), []
    for page, resources in doc.pages():
        fonts = {n: doc.font(doc.get(f)) for n, f in doc.get(resources.get("Font"), {}).items()}
        contents = page.get("Contents")
        streams = [doc.get(c) for c in (contents if isinstance(contents, list) else [contents])]
        out.append(page_text(b"\n".join(doc.content(s) for s in streams), fonts))
    return out


def test_syntax():
    lexer = Lexer(b"%x\n<</A[1 -2.5 .5 true null(a\\(b\\)(c)\\\\\\101\\n\\53\\r)<4a4B5>]/B 3 0 R/C#20D/E>>(x\\\ny) q")
    items = []
    while (x := lexer.next()) is not None:
        items.append(x)
    assert items == [{"A": [1, -2.5, 0.5, True, None, b"a(b)(c)\\A\n+\r", b"JKP"], "B": 3, "C D": "E"}, b"xy", b"q"]


@pytest.mark.parametrize("packed", [False, True])
def test_made_files(packed):
    assert texts(make_pdf(PAGES, packed)) == PAGES
    assert texts(make_pdf([f"page {i}" for i in range(300)], packed)) == [f"page {i}" for i in range(300)]


def test_text_operators():
    content = b"BT /F1 12 Tf 10 700 Td (one) Tj 0 -14 Td [(t) 20 (w) -300 (o)] TJ 14 TL (three) ' 1 0 0 1 10 600 Tm (f\\366ur) Tj 1 0 0 1 50 600 Tm ( five) Tj 1 0 0 1 10 580 Tm (six) Tj ET BI /W 1 ID \x00(no)Tj\x01 EI BT 0 5 Td (end) Tj ET"
    want = "one\ntw o\nthree\nför five\nsix\nend".replace("för", "föur")
    assert texts(one_page(content)) == [want]
    squeezed = zlib.compress(content)
    assert texts(one_page(squeezed, b"/Filter [/FlateDecode]")) == [want]
    assert texts(one_page(squeezed.hex().encode() + b">", b"/Filter [/ASCIIHexDecode /FlateDecode] /DecodeParms [null null]")) == [want]
    named = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /b /uni20AC 70 /space] >> >>"
    assert texts(one_page(b"BT /F1 1 Tf (ABCF!) Tj ET", font=named)) == ["b€C !"]


def test_character_map_ranges():
    table = b"1 beginbfrange <0041> <0043> <0391> endbfrange 1 beginbfrange <0050> <0051> [<00660069> <D83DDE42>] endbfrange"
    assert pdf.character_map(table) == {0x41: "Α", 0x42: "Β", 0x43: "Γ", 0x50: "fi", 0x51: "🙂"}


def test_damaged_and_updated_files():
    good = one_page(b"BT (kept) Tj ET")
    assert texts(good.replace(b"startxref", b"startxxxx")) == ["kept"]  # objects are searched for
    assert texts(good.replace(b"/Length 16", b"/Length 99")) == ["kept"] or b"/Length 16" not in good
    newer = b"\n4 0 obj\n<< /Length 15 >>\nstream\nBT (new) Tj ET \nendstream\nendobj\n"
    place, last = len(good) + 1, int(good.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    updated = good + newer + b"xref\n4 1\n%010d 00000 n \ntrailer\n<< /Size 6 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (place, last, len(good) + len(newer))
    assert texts(updated) == ["new"]
    packed = make_pdf(PAGES, True)
    assert texts(packed.replace(b"startxref", b"startxxxx")) == PAGES
    with pytest.raises(ValueError, match="encrypted"):
        Document(one_page(b"", extra=b"/Encrypt 9 0 R"))
    for bad in (b"", b"no file", b"%PDF-1.4\nstartxref\n5\n%%EOF"):
        with pytest.raises(ValueError):
            Document(bad)


def test_predictors():
    rows = [bytes([k, *row]) for k, row in enumerate([[1, 2, 3], [1, 1, 1], [1, 1, 1], [2, 2, 2], [1, 0, 255]])]
    assert list(inflate(zlib.compress(b"".join(rows)), ["FlateDecode"], [{"Predictor": 15, "Columns": 3}])) == [1, 2, 3, 1, 2, 3, 2, 3, 4, 3, 5, 6, 4, 5, 5]


def test_on_executors(spark, tmp_path):
    folder = tmp_path / "some files"
    folder.mkdir()
    many = [f"page {i} of many" for i in range(1, 401)]
    for name, pages, packed in (("a.pdf", PAGES, False), ("b.PDF", many, True), ("none.pdf", [], False)):
        (folder / name).write_bytes(make_pdf(pages, packed))
    rows = pdf.read_pdf_pages(spark, str(folder)).collect()
    assert {(r.path.rsplit("/", 1)[1], r.page, r.text) for r in rows} == {("a.pdf", i, t) for i, t in enumerate(PAGES, 1)} | {("b.PDF", i, t) for i, t in enumerate(many, 1)}
    assert len(rows) == len(PAGES) + len(many)
    joined = {r.path.rsplit("/", 1)[1]: r.text for r in read_files(spark, [str(folder / "a.pdf"), str(folder / "b.PDF")]).collect()}
    assert joined["a.pdf"] == "".join(f"[Page {i}] {t}\n\n" for i, t in enumerate(PAGES, 1) if t)
    assert joined["b.PDF"].count("[Page ") == 400
    (folder / "bad.pdf").write_bytes(b"%PDF-1.4 nothing else")
    with pytest.raises(Exception, match="bad.pdf: not a readable PDF file"):
        pdf.read_pdf_pages(spark, str(folder / "bad.pdf")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        pdf.read_pdf_pages(spark, str(folder / "missing.pdf")).collect()
    assert join_pages(pdf.read_pdf_pages(spark, str(folder / "none.pdf"))).count() == 0


def test_pages_and_files_are_handed_on_in_small_batches(spark, tmp_path):
    """However many rows Spark puts into a batch, a worker holds a few files or pages as objects."""
    many = [f"page {i}" for i in range(500)]
    parts = list(pdf._take_apart(iter([pa.RecordBatch.from_pydict({"path": ["a"], "length": [1], "content": [make_pdf(many)]})])))
    decoded = list(pdf._decode(iter(parts)))
    assert len(parts) == 1 and max(map(len, decoded)) == pdf.RANGE_PAGES
    assert [t for b in decoded for t in b["text"].to_pylist()] == many
    rows = [(conv, turn, f"text {conv} {turn}") for conv in range(300) for turn in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    files = corpus.conversation_files(spark, str(tmp_path))
    assert {(r.doc_id, r.page, r.text) for r in pdf.pdf_pages(files).collect()} == {(f"{c}.pdf", t + 1, x) for c, t, x in rows}
