import io
import zipfile

from pyspark.sql import functions as F

from specforge.operators import matrices, requirements, retrieval, standards
from specforge.sources import documents, index, spreadsheets
from specforge.streaming import metrics

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(files: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def xlsx() -> bytes:
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Status</t></is></c></row><row r="2" hidden="1"><c r="A2"><v>1</v></c></row><row r="3"><c r="A3"><v>7</v></c><c r="C3"><v>9</v></c></row>'
    sheet = f'<worksheet {NS}><cols><col min="3" max="3" hidden="1"/></cols><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A3:B3"/></mergeCells></worksheet>'
    return zipped({
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {NS}><si><t>Req</t></si></sst>", "xl/worksheets/sheet1.xml": sheet,
    })


def ods(text: str) -> bytes:
    t = 'xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    cell = lambda v, more="": f"<table:table-cell {more}><text:p>{v}</text:p></table:table-cell>"
    rows = f'<table:table-row>{cell(text, "table:number-columns-repeated=" + chr(34) + "2" + chr(34))}</table:table-row><table:table-row table:visibility="filter">{cell("hidden")}</table:table-row>'
    rows += f'<table:table-row table:number-rows-repeated="2">{cell("x")}</table:table-row><table:table-row table:number-rows-repeated="99999"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    return zipped({"content.xml": f'<o:doc {t}><table:table table:name="S">{rows}</table:table></o:doc>'})


def test_spreadsheets(spark, tmp_path):
    assert spreadsheets.read_xlsx(xlsx()) == [("One", [["Req", "Status", ""], ["7", "7", ""]])]
    for text in ("ok", "a & b"):
        assert spreadsheets.read_ods(ods(text))[0][1][:3] == [[text, text], ["x"], ["x"]]
    (tmp_path / "a.xlsx").write_bytes(xlsx())
    (tmp_path / "b.ods").write_bytes(ods("ok"))
    (tmp_path / "c.xlsx").write_bytes(b"not a zip")
    got = spreadsheets.matrix_rows(spark, str(tmp_path)).collect()
    assert {(r.file_name, r.sheet_name) for r in got} == {("a.xlsx", "One"), ("b.ods", "S"), ("c.xlsx", "_corrupt")}


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in (("Id", "Text"), ("R1", "shall work"))) + "</w:tbl>"
    return zipped({"word/document.xml": f'<w:document {w}><w:body>{p("SCOPE", "Heading1")}{p("&lt;&lt;fill&gt;&gt;")}{table}{p("The end.")}{p("Contents ..... 12")}</w:body></w:document>'})


def test_word_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.txt").write_text("plain text")
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    kinds = [r.block_type for r in documents.blocks(spark, str(tmp_path / "a.docx")).orderBy("block_id").collect()]
    assert kinds == ["heading", "template_instruction", "paragraph", "table", "table_row", "table_end"]
    got = {r.file_name: r.text for r in documents.texts(spark, str(tmp_path)).collect()}
    assert got["b.txt"] == "plain text" and got["bad.docx"] == "" and "R1 | shall work" in got["a.docx"]


def test_index_round_trip(spark, tmp_path):
    v = spark.createDataFrame([("A", 0, "x", [1.0]), ("B", 0, "y", [2.0])], "source_code string, chunk_id int, text string, embedding array<float>")
    path = str(tmp_path / "i")
    index.save_index(v, path)
    index.add_new(v.union(spark.createDataFrame([("C", 0, "z", [3.0])], v.schema)), path)
    assert index.load_index(spark, path).count() == 3 and index.load_index(spark, path, ["C"]).count() == 1
    assert index.status(index.load_index(spark, path)).first().sources == ["A", "B", "C"]


def test_documents_are_indexed_and_searched(spark, tmp_path):
    texts = spark.createDataFrame([("STA20", "1 Noise of doors\n\nThe noise level of the door stays low in service."), ("N41", "2 Supply\n\nThe power supply of the unit is stable.")], "doc_id string, text string")
    path = str(tmp_path / "i")
    index.index_documents(texts, path)
    q = spark.createDataFrame([(1, "noise level of the door stays low")], "q_id int, question string").select("q_id", retrieval.embedded(F.col("question")).alias("embedding"))
    found = index.search_standards(q, index.load_index(spark, path), ["sta20", "n41"], threshold=0.5).collect()
    assert [r.chunk_key for r in found] == ["STA20#0"]
    assert index.search_standards(q, index.load_index(spark, path), ["N41"], threshold=0.5).count() == 0


def test_tables_of_a_document_give_requirements(spark, tmp_path):
    """From the file over blocks in document order to rows: two tables under their headings, the second is none of requirements."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    one = table([("Requirement number (v)", "Description", "Input requirement"), ("REF-A-1@x", "The unit shall open", "N/A"), ("", "", "")])
    two = table([("Mark", "Reference", "Title"), ("[STA20]", "98037030", "drawing")])
    (tmp_path / "a.docx").write_bytes(zipped({"word/document.xml": f'<w:document {w}><w:body>{p("DOORS", "Heading1")}{one}{p("DOCUMENTS", "Heading1")}{two}</w:body></w:document>'}))
    rows = documents.requirement_tables(documents.blocks(spark, str(tmp_path), "document"))
    got = [(r.table_index, r.section, r.req_id, r.description, r.input_requirement) for r in requirements.table_requirements(rows).collect()]
    assert got == [(0, "DOORS", "REF-A-1", "The unit shall open", "N/A")]


def test_from_spreadsheets_to_items(spark, tmp_path):
    """Files of three makes, through the readers: status beside comment with a verdict, columns headed OK and NOK, and one that is no matrix."""
    def book(rows):
        cells = lambda r, k: "".join(f'<c r="{chr(65 + n)}{k}" t="inlineStr"><is><t>{v}</t></is></c>' for n, v in enumerate(r) if v)
        sheet = f'<worksheet {NS}><sheetData>' + "".join(f'<row r="{k}">{cells(r, k)}</row>' for k, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
        return zipped({
            "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": sheet,
        })

    head = ["Requirement", "Ref", "Supplier status", "Supplier comments", "Statut Stellantis"]
    (tmp_path / "a.xlsx").write_bytes(book([["Title"], head, ["Template", "x"], ["REQ-1", "r", "OK", "validated", ""], ["REQ-2", "r", "SW", "v2", "ok"], ["", "", "", ""], ["BLOCK", "1"], ["REQ-3", "r", "/", "", "nok - late"], ["3.2 Part"]]))
    (tmp_path / "b.xlsx").write_bytes(book([["Requirement", "Ref", "OK", "NOK", "Supplier comments"], ["REQ-1", "r", "x", "", "one"], ["REQ-2", "r", "", "nok", "two"], ["REQ-3", "r", "", "n/a", ""], ["REQ-4", "r", "", "", ""]]))
    (tmp_path / "c.xlsx").write_bytes(book([["nothing", "here"]]))
    got = {(r.file_name, r.row_index): (r.req_id, r.category, r.conformity_raw, r.comment, r.version) for r in matrices.items(spreadsheets.matrix_rows(spark, str(tmp_path))).collect()}
    assert got == {
        ("a.xlsx", 3): ("REQ-1", "OK", "OK", "validated", ""), ("a.xlsx", 4): ("REQ-2", "OK", "ok", "", "v2"), ("a.xlsx", 5): ("", "EMPTY", "", "", ""), ("a.xlsx", 7): ("REQ-3", "NOK", "nok - late", "", ""),
        ("b.xlsx", 1): ("REQ-1", "EMPTY", "x", "one", ""), ("b.xlsx", 2): ("REQ-2", "NOK", "nok", "two", ""), ("b.xlsx", 3): ("REQ-3", "NA", "n/a", "", ""),
    }


def test_norm_files(spark):
    d = spark.createDataFrame([("A", [([("x", True), ("y", False)],), ([("z", True)],)])], "code string, translations array<struct<files:array<struct<name:string,is_published:boolean>>>>")
    r = standards.norm_files(d).first()
    assert (r.files, r.published) == (["x", "y", "z"], ["x", "z"])


def test_sinks_keep_versions(spark, tmp_path):
    """The newest events of a stream, and running counts; a batch that is run again changes nothing."""
    events = [spark.createDataFrame([(k, f"2024-01-01 00:{(k * 7) % 60:02d}:00") for k in ids], "event_id long, t string").withColumn("ts", F.to_timestamp("t")) for ids in (range(10), range(8, 30), range(5, 12))]
    write = metrics.last_events_sink(str(tmp_path / "e"), 12)
    for k, batch in enumerate(events):
        write(batch, k)
        write(batch, k)
    every = sorted(((k * 7) % 60, k) for k in range(30))[-12:]
    assert {r.event_id for r in metrics.latest(spark, str(tmp_path / "e")).collect()} == {k for _, k in every}
    d = spark.createDataFrame([("a", "OK"), ("a", "NOK"), ("b", "OK")], "file_name string, category string")
    count = metrics.counts_sink(str(tmp_path / "c"))
    for k in (0, 1, 1):
        count(d, k)
    assert {(r.file_name, r.category, r.n) for r in metrics.latest(spark, str(tmp_path / "c")).collect()} == {("a", "OK", 2), ("a", "NOK", 2), ("b", "OK", 2)}


def test_streams_equal_batches(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k // 4:02d}:{k % 4 * 10:02d}:00", k % 3, k % 5 == 0, False, True, "HIGH") for k in range(40)]
    e = spark.createDataFrame(rows, "event_id long, t string, user_id long, was_not_found boolean, was_refusal boolean, had_sources boolean, confidence string").withColumn("ts", F.to_timestamp("t")).drop("t")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    for make in (metrics.hourly_metrics, metrics.user_sessions):
        q = make(stream).writeStream.format("memory").queryName(make.__name__).outputMode("complete" if make is metrics.hourly_metrics else "append").option("checkpointLocation", str(tmp_path / make.__name__)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {tuple(r) for r in spark.table(make.__name__).collect()}
        want = {tuple(r) for r in make(e).collect()}
        assert got and got <= want and (make is not metrics.hourly_metrics or got == want)


def test_matrix_stream(spark, tmp_path):
    rows = [("a", 0, "s", k, ["R", ("ok", "nok", "n/a")[k % 3], ""]) for k in range(9)]
    d = spark.createDataFrame(rows, "file_name string, sheet_idx int, sheet_name string, row_index int, cells array<string>")
    d.write.parquet(str(tmp_path / "m"))
    q = metrics.status_counts(metrics.matrix_stream(spark, str(tmp_path / "m")), 1, 2).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.category, r.n) for r in spark.table("counts").collect()} == {("OK", 3), ("NOK", 3), ("NA", 3)}
