"""Files in and out: PDF files made by hand, collections, JSON documents, the inbox stream."""

import json
import zlib

import pytest
from pyspark.sql import functions as F

from docstruct.operators.outline import as_json, coded_failure_output
from docstruct.plans.outline import outline
from docstruct.sources import collections as src
from docstruct.sources import pdf, sinks
from docstruct.sources.pdffile import Document, PdfError, Reader, read
from docstruct.streaming.inbox import watch


def make_pdf(pages, packed=False, fonts=None, extra=b"", flate=True):
    """A PDF file of content streams; ``packed`` puts page objects into an object stream."""
    fonts = fonts or b"<</F1 <</Type/Font/Subtype/Type1/BaseFont/Helvetica-Bold/FirstChar 32/Widths[250]>>/F2 <</Type/Font/Subtype/Type1/BaseFont/ABCDEF+Times-Italic>>>>"
    objects, streams = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count %d/Kids[%s]/MediaBox[0 0 612 792]/Resources<</Font %s>>>>" % (len(pages), b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages))), fonts), 3: b"<</Title(A \\(small\\) file)/Author<FEFF00C9>>>"}, {}
    for k, content in enumerate(pages):
        objects[10 + 2 * k] = b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (11 + 2 * k)
        data = zlib.compress(content) if flate else content
        streams[11 + 2 * k] = (b"/Filter/FlateDecode" if flate else b"", data)
    if packed:
        body, heads = b"", b""
        for k, v in objects.items():
            heads += b"%d %d " % (k, len(body))
            body += v + b" "
        streams[900] = (b"/Type/ObjStm/N %d/First %d/Filter/FlateDecode" % (len(objects), len(heads)), zlib.compress(heads + body))
        objects = {}
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, v) for k, v in objects.items())
    out += b"".join(b"%d 0 obj\n<<%s/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (k, i, len(d), d) for k, (i, d) in streams.items())
    return out + b"trailer\n<</Root 1 0 R/Info 3 0 R" + extra + b">>\n%%EOF"


PAGE = b"BT /F1 24 Tf 72 700 Td (Title of the file) Tj ET BT /F2 10 Tf 1 0 0 1 72 650 Tm 12 TL (First line) Tj T* [(Sec)-20(ond)-600(line)] TJ (Quote \\251) ' ET"


@pytest.mark.parametrize("options", [{}, {"packed": True}, {"flate": False}])
def test_text_and_places(options):
    spans, pages, failed = read(make_pdf([PAGE, PAGE], **options))
    assert (pages, failed) == (2, 0) and [s.text for s in spans[:4]] == ["Title of the file", "First line", "Second line", "Quote ©"]
    assert [s.page for s in spans] == [1] * 4 + [2] * 4
    a, b = spans[0], spans[1]
    assert (a.size, a.font, a.flags) == (24.0, "Helvetica-Bold", 16) and (b.font, b.flags) == ("Times-Italic", 2)
    assert a.x0 == 72 and a.y0 == pytest.approx(792 - 700 - 0.8 * 24) and a.x1 > a.x0 and spans[2].y0 - b.y0 == pytest.approx(12)


def test_unicode_map():
    cmap = b"beginbfchar <0001> <00C9> endbfchar beginbfrange <0002> <0004> <0061> <0005> <0006> [<4E2D> <6587>] endbfrange"
    data = make_pdf([b"BT /F1 12 Tf 10 10 Td <000100020003000400050006> Tj ET"], fonts=b"<</F1 <</Type/Font/Subtype/Type0/BaseFont/X/ToUnicode 50 0 R/DescendantFonts[<</DW 500/W[1[600 700]]>>]>>>>")
    data = data.replace(b"trailer", b"50 0 obj\n<</Length %d>>\nstream\n%s\nendstream\nendobj\ntrailer" % (len(cmap), cmap))
    span = read(data)[0][0]
    assert span.text == "Éabc中文" and span.x1 - span.x0 == pytest.approx(12 * (0.6 + 0.7 + 4 * 0.5))


def test_transformed_and_nested():
    content = b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 5 5 Td (Large) Tj ET Q BI /W 1 ID \x01\x02 EI BT /F2 8 Tf 0 -3 Td (\\101\\\n(b)) Tj ET % (not this) Tj\n"
    a, b = read(make_pdf([content], flate=False))[0]
    assert (a.text, a.size, a.x0) == ("Large", 20.0, 10.0) and b.text == "A(b)"


@pytest.mark.parametrize("data, code", [(b"", "EMPTY_FILE"), (b"hello", "OPEN_FAILED"), (make_pdf([PAGE], extra=b"/Encrypt<<>>"), "PASSWORD_PROTECTED"), (make_pdf([]), "NO_PAGES"), (make_pdf([b"BT ET"]), "NO_TEXT_EXTRACTED"), (b"%PDF-1.4\n1 0 obj\n<</A [1 2", "CORRUPTED_FILE"), (b"%PDF-1.4\n", "PAGE_COUNT_FAILED")])
def test_errors(data, code):
    with pytest.raises(PdfError) as e:
        read(data)
    assert e.value.code == code


def test_time_limit_and_page_cap():
    with pytest.raises(PdfError) as e:
        read(make_pdf([PAGE]), seconds=-1)
    assert e.value.code == "PROCESSING_TIMEOUT"
    assert {s.page for s in read(make_pdf([PAGE] * 5), max_pages=2)[0]} == {1, 2}


def test_values():
    r = Reader(b"[1 -2.5 .5 (a\\(b\\)\\n) <4 1> /N#20x true null 3 0 R <</K[]>>]")
    assert r.next() == [1, -2.5, 0.5, bytearray(b"a(b)\n"), bytearray(b"A"[:0] + b"\x41"), "N x", True, None, (3,), {"K": []}]
    assert Document(make_pdf([PAGE])).metadata() == {"Title": "A (small) file", "Author": "É"}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.pdf", make_pdf([PAGE])), ("b.PDF", make_pdf([PAGE])), ("bad.pdf", b"x"), ("empty.pdf", b""), ("c.txt", b"t")):
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def test_pdf_tables(spark, folder):
    files = pdf.pdf_files(spark, f"file://{folder}/in")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.select("path").collect()) == ["a.pdf", "bad.pdf"]  # Spark leaves empty files out
    assert pdf.pdf_files(spark, f"file://{folder}/in/b.PDF").count() == 1
    decoded = pdf.decode_pdfs(files)
    assert [r.text for r in pdf.pdf_spans(decoded).orderBy("seq").collect()] == ["Title of the file", "First line", "Second line", "Quote ©"]
    errors = pdf.pdf_errors(decoded).union(pdf.empty_files(spark, f"file://{folder}/in"))
    assert {r.path.rsplit("/", 1)[1]: r.error_code for r in errors.collect()} == {"bad.pdf": "OPEN_FAILED", "empty.pdf": "EMPTY_FILE"}
    failed = coded_failure_output(errors, F.lit(1.5)).where("error_code = 'EMPTY_FILE'").select(as_json(F.col("title"), F.array().cast("array<struct<level:string,text:string,page:int>>"), F.col("error")).alias("j")).first().j
    assert json.loads(failed)["title"] == "Error: Failed to process empty.pdf" and json.loads(failed)["error"]["timestamp"] == 1.5
    asked = spark.createDataFrame([("nowhere.pdf",)], "path string")
    assert pdf.missing_files(asked, files).first().error_code == "FILE_NOT_FOUND"
    meta = {r.path.rsplit("/", 1)[1]: r for r in pdf.pdf_metadata(files).collect()}
    assert meta["a.pdf"].metadata["Title"] == "A (small) file" and meta["a.pdf"].page_count == 1 and not meta["bad.pdf"].is_pdf


def test_documents_are_written(spark, folder):
    rows = outline(pdf.pdf_spans(pdf.decode_pdfs(pdf.pdf_files(spark, f"file://{folder}/in"))))
    out = sinks.write_documents(rows, F.lit("a"), as_json(F.col("title"), F.col("outline")), f"file://{folder}/out").collect()
    assert [(r.name, r.error) for r in out] == [("a", None)]
    assert json.loads((folder / "out/a.json").read_text()) == {"title": "Untitled Document", "outline": []}
    sinks.write_outlines(rows, f"file://{folder}/lines")
    assert spark.read.json(f"file://{folder}/lines").first().title == "Untitled Document"
    bad = sinks.write_documents(spark.createDataFrame([("x", "{")], "n string, v string"), F.col("n"), F.col("v"), f"file://{folder}/out").first()
    assert bad.error and not (folder / "out/x.json").exists()


def test_collections(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"Collection {k}/PDFs").mkdir(parents=True)
        (tmp_path / f"Collection {k}/PDFs/f{k}.pdf").write_bytes(make_pdf([PAGE]))
        (tmp_path / f"Collection {k}/{src.INPUT_NAME}").write_text(json.dumps({"documents": [{"filename": f"f{k}.pdf", "title": "F"}], "persona": {"role": "Cook"}, "job_to_be_done": {"task": "Bake"}}, indent=1))
    rows = src.read_collections(spark, f"file://{tmp_path}").orderBy("collection").collect()
    assert [(r.collection, r.persona.role, r.challenge_info) for r in rows] == [("Collection 1", "Cook", None), ("Collection 2", "Cook", None)]
    assert sorted(r.filename for r in src.collection_files(spark, f"file://{tmp_path}").select("filename").collect()) == ["f1.pdf", "f2.pdf"]


def test_inbox(spark, folder):
    for _ in range(2):  # the second run finds nothing new
        watch(spark, f"file://{folder}/in", f"file://{folder}/stream", f"file://{folder}/checkpoint", once=True).awaitTermination()
    assert spark.read.parquet(f"file://{folder}/stream").count() == 1
