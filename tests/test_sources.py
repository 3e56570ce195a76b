"""Extractors and the data source on files made here: PDF, DOCX, DOC, text, and what cannot be read."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docmill.operators import extraction as X
from docmill.sources import extractors as E
from docmill.sources import files, pdf


def pdf_file(pages, packed=False, tree=True):
    """A PDF of pages, each (content stream, whether it shows an image)."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = []
    number = 10
    for content, image in pages:
        body = zlib.compress(content) if packed else content
        flate = b" /Filter /FlateDecode" if packed else b""
        objects[number + 1] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(body), flate, body)
        resources = b"<< /Font << /F1 5 0 R /F2 6 0 R >> %s >>" % (b"/XObject << /I1 7 0 R >>" if image else b"")
        objects[number] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources %s >>" % (number + 1, resources)
        kids.insert(0, number)  # the tree's order is not that of the numbers
        number += 2
    if tree:
        objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    objects[5] = b"<< /Type /Font /BaseFont /Helvetica >>"
    objects[6] = b"<< /Type /Font /ToUnicode 8 0 R >>"
    objects[7] = b"<< /Type /XObject /Subtype /Image /Length 3 >>\nstream\nxyz\nendstream"
    cmap = b"1 beginbfchar <0001> <0928> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"
    objects[8] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, b) for k, b in sorted(objects.items())) + b"%%EOF"


HEADINGS = rb"""BT /F1 20 Tf 72 700 Td (Annual \(2024\) Report) Tj ET
BT /F1 1 Tf 15 0 0 15 72 660 Tm (Budget) Tj ET
BT /F1 13 Tf 72 630 Td [(Spo) 20 (nsors) -400 (and fees)] TJ ET
BT /F1 10 Tf 12 TL 72 600 Td (First line of text) Tj T* (second line of it) Tj (end\041) ' ET
BT /F2 10 Tf 72 500 Td <000100100011> Tj ET"""
TABLE = b"".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET\n" % (x, y, t) for y, row in ((700, (b"Name", b"Role", b"Fee")), (688, (b"Ann", b"chair", b"100")), (676, (b"Bob", b"clerk", b"200")), (664, (b"Cy", b"cook", b"300"))) for x, t in zip((72, 200, 330), row, strict=True))
SCAN = b"q 600 0 0 800 0 0 cm /I1 Do Q"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(packed):
    found = pdf.read_pdf(pdf_file([(SCAN, True), (TABLE, False), (HEADINGS, False)], packed))
    assert [b[4] for b in found if b[0] == 1] == ["Annual (2024) Report", "Budget", "Sponsors and fees", "First line of text\nsecond line of it\nend!", "नAB"]
    assert [b[3] for b in found if b[0] == 1] == [20.0, 15.0, 13.0, 10.0, 10.0]
    assert [b[4].split("\n")[0] for b in found if b[0] == 2] == ["Name   Role   Fee"] and found[-1] == (3, 0, 0.0, 0.0, "", True)
    with pytest.raises(ValueError, match="not a PDF"):
        pdf.read_pdf(b"hello")


def test_pdf_objects_in_streams():
    head, bodies = b"20 0 21 39 ", b"<< /Type /Page /Contents 22 0 R      >>" + b"<< /Any /Thing >>"
    data = zlib.compress(head + bodies)
    content = b"%PDF-1.5\n" + b"3 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n" % (len(head), data) + b"22 0 obj\n<< >>\nstream\nBT /F1 9 Tf (packed page) Tj ET\nendstream\nendobj\n"
    assert [b[4] for b in pdf.read_pdf(content)] == ["packed page"]


@pytest.fixture
def folder(tmp_path):
    out = tmp_path / "in"
    (out / "sub").mkdir(parents=True)
    (out / "report.pdf").write_bytes(pdf_file([(SCAN, True), (TABLE, False), (HEADINGS, False)], True))
    (out / "sub/a.txt").write_text("plain text")
    (out / "sub/latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    (out / "empty.md").write_bytes(b"")
    (out / "x.bin").write_bytes(b"\x00")
    (out / "bad.docx").write_bytes(b"no zip")
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document><w:p><w:r><w:t>Fees &amp; sums &#60; 5</w:t></w:r></w:p><w:p></w:p><w:p w:x="1"><w:r><w:t xml:space="preserve">a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p></w:document>')
    (out / "good.docx").write_bytes(docx.getvalue())
    (out / "old.doc").write_bytes(b"\x00\x01".join(b"run %d" % k for k in range(900)))
    return out


def test_source_and_spark_files_agree(spark, folder):
    E.register_source(spark)
    source = spark.read.format("docmill_files").option("part_bytes", "600").load(str(folder))
    assert source.rdd.getNumPartitions() > 2
    name = F.element_at(F.split("path", "/"), -1)
    rows = lambda df: sorted((tuple(r) for r in df.select(name.alias("name"), "kind", "bytes", "page", "block", "size", "text", "image", "error").collect()), key=str)
    raw = files.raw_files(spark, str(folder))
    full = source.filter("bytes > 0")  # Spark's own reader leaves out files without a byte
    assert rows(full) == rows(E.blocks(raw)) and len(rows(source)) == len(rows(full)) + 1
    by = {r["name"]: r for r in E.texts(source).withColumn("name", name).collect()}
    assert by["a.txt"]["text"] == "plain text" and by["latin.txt"]["text"] == "café" and by["empty.md"]["text"] == ""
    assert by["good.docx"]["text"] == "Fees & sums < 5\n\na\tb\nc"
    assert by["old.doc"]["text"].split("\n") == [f"run {k}" for k in range(900)]  # all runs
    assert by["x.bin"]["text"] is None and "no extractor" in by["x.bin"]["error"] and "BadZipFile" in by["bad.docx"]["error"]
    assert {r["path"].rsplit("/", 1)[-1]: r["text"] for r in files.extract(raw).collect()} == {k: r["text"] for k, r in by.items() if k != "empty.md"}
    report = source.filter("kind = 'application/pdf'")
    assert [(r["page"], r["scanned"]) for r in E.pages(report).orderBy("page").collect()] == [(1, False), (2, False), (3, True)]
    assert [r["heading"] for r in E.marked(report).filter("page = 1").orderBy("block").collect()] == [1, 2, 3, 0, 0]
    tables = X.table_lines(report.withColumn("doc_id", F.concat_ws("#", "path", "page", "block")))
    assert [(r["rows"], r["columns"]) for r in tables.collect()] == [(4, 3)]


def test_options_are_answered_by_the_listing(spark, folder):
    opened = folder.parent / "opened"
    opened.mkdir()

    def traced(content):
        (opened / f"{len(content)}").write_bytes(b"")
        return E.text_blocks(content)

    E.register_source(spark, {"text/plain": traced, "text/markdown": traced})
    source = spark.read.format("docmill_files").option("kinds", "text/plain, application/pdf").option("least_bytes", 5).load(str(folder))
    assert [r["text"] for r in source.filter("error is null").collect()] == ["plain text"] and [f.name for f in opened.iterdir()] == ["10"]
    assert source.count() == 2  # a filter of one query is not left for the next
    E.register_source(spark)


def test_registration(spark, folder):
    before = E.registered()
    try:
        E.register("unknown")(lambda content: E.one_block(f"{len(content)} bytes"))
        got = E.texts(E.blocks(files.raw_files(spark, str(folder)).filter("kind = 'unknown'"))).collect()
        assert [(r["text"], r["error"]) for r in got] == [("1 bytes", None)]
    finally:
        E._EXTRACTORS.clear()
        E._EXTRACTORS.update(before)
