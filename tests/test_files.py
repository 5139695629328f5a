"""Folders of PDF files to JSON documents, collections to outputs, and the shell."""

import json
import time

import pytest
from pyspark.sql import functions as F

from docstruct import __main__ as shell
from docstruct.operators.relevance import batched
from docstruct.plans.outline import outline_files
from docstruct.plans.relevance import relevance_folder
from docstruct.sources import collections as src
from docstruct.sources.pdffile import PdfError, _unpack, read
from tests.conftest import rows
from tests.test_sources import PAGE, make_pdf

BOOK = b"BT /F1 24 Tf 72 700 Td (Chapter 1 The beginning) Tj ET BT /F2 10 Tf 72 650 Td (Some words of the body that are no heading at all, and go on for a while.) Tj ET"
DOT = b"BT /F2 10 Tf 72 650 Td (.) Tj ET"


def slow(data, cap, seconds):
    if b"SLOW" in data:
        raise PdfError("PROCESSING_TIMEOUT", "over 10.0 s")
    return read(data, cap, seconds)


def test_an_output_for_every_file(spark, tmp_path):
    there = tmp_path / "in"
    there.mkdir()
    for name, data in (("good", make_pdf([BOOK])), ("bad", b"x"), ("empty", b""), ("locked", make_pdf([PAGE], extra=b"/Encrypt<<>>")), ("blank", make_pdf([b"BT ET"])), ("dot", make_pdf([DOT])), ("slow", make_pdf([PAGE]) + b"\n%SLOW")):
        (there / f"{name}.pdf").write_bytes(data)
    done = outline_files(spark, f"file://{there}", f"file://{tmp_path}/out", f"file://{tmp_path}/work", decoder=slow)
    assert sorted(r.name for r in done.where("error is null").collect()) == ["bad", "blank", "dot", "empty", "good", "locked", "slow"]
    out = {p.stem: json.loads(p.read_text()) for p in (tmp_path / "out").glob("*.json")}
    assert "error" not in out["good"] and out["good"]["title"] != "Untitled Document"
    codes = {k: (v["error"]["type"], v["error"].get("error_code")) for k, v in out.items() if "error" in v}
    assert codes == {"bad": ("PDFProcessingError", "OPEN_FAILED"), "empty": ("PDFProcessingError", "EMPTY_FILE"), "locked": ("PDFProcessingError", "PASSWORD_PROTECTED"), "blank": ("PDFProcessingError", "NO_TEXT_EXTRACTED"), "dot": ("ProcessingError", None), "slow": ("TimeoutError", "PROCESSING_TIMEOUT")}
    assert out["dot"]["error"]["message"] == "No content after preprocessing" and out["slow"]["title"] == "Error: Processing timeout for slow.pdf" and all(out[k]["outline"] == [] for k in codes)


def collection(base, name, listed, there, config=None):
    (base / name / "PDFs").mkdir(parents=True)
    for f, data in there.items():
        (base / name / "PDFs" / f).write_bytes(data)
    text = json.dumps({"challenge_info": {"challenge_id": "c"}, "documents": [{"filename": f, "title": f} for f in listed], "persona": {"role": "Cook"}, "job_to_be_done": {"task": "Find words of the body"}}) if config is None else config
    (base / name / src.INPUT_NAME).write_text(text)


def test_collections_to_outputs(spark, tmp_path):
    collection(tmp_path, "Collection 1", ["b.pdf", "a.pdf", "none.pdf", "bad.pdf"], {"a.pdf": make_pdf([BOOK]), "b.pdf": make_pdf([BOOK, PAGE]), "bad.pdf": b"x", "unlisted.pdf": make_pdf([PAGE])})
    collection(tmp_path, "Collection 2", ["a.pdf"], {}, "{ not json")
    collection(tmp_path, "Collection 3", ["a.pdf"], {}, '{"documents": []}')
    collection(tmp_path, "Collection 4", ["a.pdf"], {})
    collection(tmp_path, "Collection 5", ["bad.pdf"], {"bad.pdf": b"x"})
    status = {r.collection[-1]: r for r in relevance_folder(spark, f"file://{tmp_path}", f"file://{tmp_path}/work", stamp=F.lit("2024-01-01T00:00:00")).collect()}
    assert {k: r.success for k, r in status.items()} == {"1": True, "2": False, "3": False, "4": False, "5": False}
    assert [status[k].error_message for k in "2345"] == ["Invalid JSON in input configuration", "Missing required keys in input configuration: challenge_info, job_to_be_done, persona", "PDF directory or files not found", "No sections extracted from any PDF files"]
    one = status["1"]
    assert (one.documents_processed, one.missing, one.failed) == (2, ["none.pdf"], ["bad.pdf"]) and one.sections_processed > 2
    out = json.loads((tmp_path / "Collection 1" / f"{src.OUTPUT_NAME}.json").read_text())
    assert out["metadata"] == {"input_documents": ["b.pdf", "a.pdf", "none.pdf", "bad.pdf"], "persona": "Cook", "job_to_be_done": "Find words of the body", "processing_timestamp": "2024-01-01T00:00:00"}
    found = out["extracted_sections"]
    assert [s["importance_rank"] for s in found] == list(range(1, one.sections_processed + 1)) and {s["document"] for s in found} == {"a.pdf", "b.pdf"}
    equal = [s["document"] for s in found if s["section_title"] == "Chapter 1 The beginning"]
    assert equal[:2] == ["b.pdf", "a.pdf"]  # equals come in the listed order
    assert out["subsection_analysis"] and set(out["subsection_analysis"][0]) == {"document", "refined_text", "page_number"}
    assert not (tmp_path / "Collection 4" / f"{src.OUTPUT_NAME}.json").exists()


def test_no_files_at_all(spark, tmp_path):
    collection(tmp_path, "Collection 1", [], {})
    assert [r.success for r in relevance_folder(spark, f"file://{tmp_path}", f"file://{tmp_path}/work").collect()] == [False]


def test_shell(spark, tmp_path, capsys):
    (tmp_path / "a.pdf").write_bytes(make_pdf([BOOK]))
    assert shell.main(["outline", str(tmp_path / "a.pdf"), str(tmp_path / "out"), "--work", str(tmp_path / "w")]) == 0
    assert json.loads((tmp_path / "out/a.json").read_text())["title"]
    collection(tmp_path, "Collection 1", ["a.pdf"], {}, "{")
    assert shell.main(["relevance", str(tmp_path)]) == 1
    assert "0 of 1 collections" in capsys.readouterr().out


def test_failed_batches_have_zero_vectors(spark):
    def load():
        def encode(texts):
            if "bad" in texts:
                raise RuntimeError("no vectors")
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["aa", "b", "bad", "cc", None, ""])], "k int, t string").coalesce(1)
    assert [r[1] for r in rows(df.select("k", batched(load, 2, batch_size=2)(F.col("t"))))] == [[2.0, 1.0], [1.0, 1.0], [0.0, 0.0], [0.0, 0.0], [0.0, 0.0], [0.0, 1.0]]


# the reader's newer parts


def form(number, content, extra=b""):
    return b"%d 0 obj\n<</Type/XObject/Subtype/Form/BBox[0 0 9 9]%s/Length %d>>\nstream\n%s\nendstream\nendobj\n" % (number, extra, len(content), content)


def test_forms():
    data = make_pdf([b"BT /F1 24 Tf 72 700 Td (Above) Tj ET q 2 0 0 2 0 0 cm /X Do Q BT /F2 10 Tf 72 600 Td (Below) Tj ET"])
    data = data.replace(b"/Resources<<", b"/Resources<</XObject <</X 60 0 R/Y 61 0 R>>")
    data = data.replace(b"trailer", form(60, b"q Q Q BT /F2 8 Tf 10 100 Td (Within) Tj ET /Y Do /X Do", b"/Matrix[1 0 0 1 5 0]") + form(61, b"BT /F1 6 Tf 1 1 Td (Deep) Tj ET") + b"trailer")
    spans = read(data)[0]
    assert [(s.text, s.size) for s in spans] == [("Above", 24.0), ("Within", 16.0), ("Deep", 12.0), ("Below", 10.0)] and spans[1].x0 == 30.0


def test_filters():
    def of(kind, data):
        return _unpack({"Filter": [kind]}, data)

    assert of("LZWDecode", bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert of("RunLengthDecode", b"\x02abc\xfex\x80zz") == b"abcxxx" and of("ASCIIHexDecode", b"61 6\n2 7>") == b"abp" and of("ASCII85Decode", b"<~87cUR\nDZ~>") == b"Hello"
    with pytest.raises(PdfError) as e:
        of("DCTDecode", b"")
    assert e.value.code == "UNSUPPORTED"
    for kind, bad in (("LZWDecode", b"\xff\xff\xff"), ("FlateDecode", b"no"), ("ASCIIHexDecode", b"zz"), ("ASCII85Decode", b"\x7f\x7f")):
        with pytest.raises(PdfError) as e:
            of(kind, bad)
        assert e.value.code == "CORRUPTED_FILE"


def test_a_page_that_takes_too_long_fails_alone():
    long = b"BT /F1 9 Tf (x) Tj ET " * 100_000
    began = time.monotonic()
    spans, pages, failed = read(make_pdf([PAGE, long, PAGE]), page_seconds=0.05)
    assert (pages, failed, {s.page for s in spans}) == (3, 1, {1, 3}) and time.monotonic() - began < 5
    with pytest.raises(PdfError) as e:
        read(make_pdf([long]), seconds=0.05)
    assert e.value.code == "PROCESSING_TIMEOUT"
