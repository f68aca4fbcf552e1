"""Workbook ingest from minimal hand-written .xlsx parts."""

import io
import os
import tempfile
import zipfile

from sheetwise.sources.workbooks import ingest_workbooks, read_xlsx

M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def make_xlsx(sheets):
    """sheets: [(name, [[(ref, type, value), ...], ...])]"""
    buf = io.BytesIO()
    shared = []
    with zipfile.ZipFile(buf, "w") as z:
        wb = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{M}" xmlns:r="{R}"><sheets>{wb}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i + 1}" Type="ws" Target="worksheets/sheet{i + 1}.xml"/>'
                       for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for i, (_, rows) in enumerate(sheets):
            xml_rows = []
            for rn, cells in enumerate(rows):
                cx = []
                for ref, t, v in cells:
                    if t == "s":
                        shared.append(v)
                        cx.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
                    elif t == "inlineStr":
                        cx.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
                    else:
                        cx.append(f'<c r="{ref}"><v>{v}</v></c>')
                xml_rows.append(f'<row r="{rn + 1}">{"".join(cx)}</row>')
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{M}"><sheetData>{"".join(xml_rows)}</sheetData></worksheet>')
        sst = "".join(f"<si><t>{s}</t></si>" for s in shared)
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{M}">{sst}</sst>')
    return buf.getvalue()


BOOK = [("S", [[("A1", "s", "府省庁"), ("B1", "s", "事業名"), ("C1", "s", "金額")],
               [("A2", "s", "総務省"), ("C2", "n", "12")],
               [("A3", "inlineStr", "財務省"), ("B3", "s", "a\nb"), ("C3", "n", "12.5")]]),
        ("T", [[("A1", "s", "x")]])]


def test_read_xlsx_values():
    got = dict(read_xlsx(make_xlsx(BOOK)))
    assert got["S"] == [["府省庁", "事業名", "金額"], ["総務省", "", "12"], ["財務省", "a\nb", "12.5"]]
    assert got["T"] == [["x"]]


def styled(sheet_xml, shared_xml="", styles_xml="", book_xml=""):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{M}" xmlns:r="{R}">{book_xml}<sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Type="ws" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{M}"><sheetData>{sheet_xml}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{M}">{shared_xml}</sst>')
        if styles_xml:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{M}">{styles_xml}</styleSheet>')
    return buf.getvalue()


def test_phonetic_runs_are_not_text():
    book = styled('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><r><t>事業</t></r><r><t>名</t></r><rPh sb="0" eb="2"><t>ジギョウ</t></rPh></is></c></row>',
                  '<si><t>府省庁</t><rPh sb="0" eb="3"><t>フショウチョウ</t></rPh></si>')
    assert dict(read_xlsx(book))["S"] == [["府省庁", "事業名"]]


def test_dates_are_date_text():
    styles = ('<numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;年&quot;m&quot;月&quot;"/><numFmt numFmtId="165" formatCode="0.0&quot;day&quot;"/></numFmts>'
              '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="20"/></cellXfs>')
    row = ('<row r="2"><c r="A2" s="1"><v>42461</v></c><c r="B2" s="2"><v>42461.5</v></c><c r="C2" s="3"><v>42461</v></c><c r="D2"><v>42461</v></c><c r="E2" s="4"><v>0.75</v></c></row>')
    assert dict(read_xlsx(styled(row, "", styles)))["S"] == [[""] * 5, ["2016-04-01 00:00:00", "2016-04-01 12:00:00", "42461", "42461", "18:00:00"]]
    early = styled('<row r="1"><c r="A1" s="1"><v>1</v></c></row>', "", styles, '<workbookPr date1904="1"/>')
    assert dict(read_xlsx(early))["S"] == [["1904-01-02 00:00:00"]]


def test_of_same_named_sheets_loose_workbooks_win(spark):
    d = tempfile.mkdtemp(prefix="sheetwise-wb-")
    one = lambda v: make_xlsx([("S", [[("A1", "s", "h")], [("A2", "s", v)]])])
    for name in ("database2016.xlsx", "database2018.xlsx"):
        with open(os.path.join(d, name), "wb") as f:
            f.write(one("alone"))
    for name, values in (("z.ZIP", ("first", "second")), ("a.zip", ("old", "older"))):
        with zipfile.ZipFile(os.path.join(d, name), "w") as z:
            for k, v in zip("ab", values, strict=True):
                z.writestr(f"{k}/database2016.xlsx", one(v))
                z.writestr(f"{k}/database2017.xlsx", one(v))
    rows = ingest_workbooks(spark, d).orderBy("source_file", "row_ordinal").collect()
    assert [(r["source_file"], r["cells"], r["workbook"]) for r in rows if r["row_ordinal"] == 1] == [
        ("database2016_S", ["alone"], "database2016.xlsx"),  # a loose workbook, whatever the zips' names
        ("database2017_S", ["second"], "z.ZIP"),             # the last zip, its later member
        ("database2018_S", ["alone"], "database2018.xlsx")]
    assert ingest_workbooks(spark, d, target_files=["none.xlsx"]).count() == 0
    only = ingest_workbooks(spark, d, target_files=["a.zip"]).where("row_ordinal = 1").collect()
    assert {(r["source_file"], r["cells"][0]) for r in only} == {("database2016_S", "older"), ("database2017_S", "older")}


def test_broken_sources_can_be_left_out(spark):
    import pytest

    from sheetwise.sources.workbooks import ingest_with_failures
    d = tempfile.mkdtemp(prefix="sheetwise-wb-")
    good = make_xlsx([("S", [[("A1", "s", "h")], [("A2", "s", "v")]])])
    with open(os.path.join(d, "good.xlsx"), "wb") as f:
        f.write(good)
    with open(os.path.join(d, "broken.xlsx"), "wb") as f:
        f.write(b"not a zip")
    with zipfile.ZipFile(os.path.join(d, "half.zip"), "w") as z:  # its first member is fine
        z.writestr("a.xlsx", good)
        z.writestr("b.xlsx", b"PK broken")
    rows, failed = ingest_with_failures(spark, d)
    assert {r["workbook"] for r in rows.collect()} == {"good.xlsx"}
    assert {r["workbook"] for r in failed.collect()} == {"broken.xlsx", "half.zip"}
    with pytest.raises(Exception, match="BadZipFile"):
        ingest_workbooks(spark, d)


def test_ingest_folder_with_zip(spark):
    d = tempfile.mkdtemp(prefix="sheetwise-wb-")
    with open(os.path.join(d, "database2016.xlsx"), "wb") as f:
        f.write(make_xlsx(BOOK))
    with zipfile.ZipFile(os.path.join(d, "bundle.zip"), "w") as z:
        z.writestr("database2015.xlsx", make_xlsx([("S", [[("A1", "s", "h")], [("A1", "s", "v")]])]))
        z.writestr("__MACOSX/database2015.xlsx", b"junk")
    rows = ingest_workbooks(spark, d).collect()
    files = sorted({r["source_file"] for r in rows})
    assert files == ["database2015_S", "database2016_S", "database2016_T"]
    s = sorted((r for r in rows if r["source_file"] == "database2016_S"), key=lambda r: r["row_ordinal"])
    assert s[2]["cells"] == ["財務省", "a<br>b", "12.5"]
    only = ingest_workbooks(spark, d, target_files=["bundle.zip"]).collect()
    assert {r["source_file"] for r in only} == {"database2015_S"}


def test_workbook_to_published_tables(spark):
    """S1 -> N11 -> U8/U3/U5 -> K7 through the stage job."""
    from sheetwise.plans.job import run_job
    from sheetwise.sinks import versions
    d = tempfile.mkdtemp(prefix="sheetwise-e2e-")
    header = ["府省庁", "事業名", "事業番号−1", "費目・使途-A.支払先費目-1", "費目・使途-A.支払先金額(百万円)-1",
              "予算額－2016年度予算の状況当初予算", "事業開始・終了(予定)年度"]
    row1 = ["総務省", "ＡＩ推進", "1", "委託", "12", "30", "平成25年度～29年度"]
    refs = "ABCDEFG"
    book = [("S", [[(f"{refs[i]}1", "s", h) for i, h in enumerate(header)],
                   [(f"{refs[i]}2", "s", v) for i, v in enumerate(row1)]])]
    with open(os.path.join(d, "database2016.xlsx"), "wb") as f:
        f.write(make_xlsx(book))
    rows = ingest_workbooks(spark, d)
    m = {r["table_name"]: r["row_count"] for r in run_job(spark, d + "/work", rows).collect()}
    assert m["business"] == 1 and m["fund_flow"] == 1 and m["budgets"] == 1
    b = versions.read_set(spark, d + "/work/tables")["business"].collect()[0]
    assert b["business_id"] == "2016-00001" and b["ministry_id"] == 13
    assert b["事業名"] == "AI推進" and b["事業番号-1"] == "1"
    assert b["事業開始終了年度"] == "2013年度～2017年度"
    f = versions.read_set(spark, d + "/work/tables")["fund_flow"].collect()[0]
    assert (f["block_id"], f["sequence"], f["支払先費目"], f["支払先金額(百万円)"]) == ("A", 1, "委託", "12")
    bu = versions.read_set(spark, d + "/work/tables")["budgets"].collect()[0]
    assert bu["予算の状況当初予算"] == "30"


def _same_rows_by_parsing(sheet_xml, shared_xml=""):
    """A sheet cut into pieces against the whole part parsed as one tree."""
    from xml.etree import ElementTree as ET
    root = ET.fromstring(f'<w xmlns="{M}">{sheet_xml}</w>')
    shared = ["".join(t.text or "" for t in si.iter(f"{{{M}}}t")) for si in ET.fromstring(f'<w xmlns="{M}">{shared_xml}</w>')]
    rows, at = [], 0
    for row in root.iter(f"{{{M}}}row"):
        n = int(row.get("r", at + 1))
        rows += [[]] * (n - at - 1)
        cells = {}
        for c in row.iter(f"{{{M}}}c"):
            text = "".join(t.text or "" for t in c.iter(f"{{{M}}}t"))
            v = c.find(f"{{{M}}}v")
            i = ord(c.get("r")[0]) - 65 if c.get("r") else max(cells, default=-1) + 1
            cells[i] = text if c.get("t") == "inlineStr" else shared[int(v.text)] if c.get("t") == "s" else v.text
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        at = n
    width = max(map(len, rows))
    return [r + [""] * (width - len(r)) for r in rows]


def test_a_sheet_in_many_pieces_has_the_same_rows(monkeypatch):
    from sheetwise.sources import workbooks as W
    shared = "".join(f"<si><t>text {i}</t></si>" for i in range(60))
    plain = "".join(f'<row r="{2 * i + 1}"><c r="A{2 * i + 1}" t="s"><v>{i}</v></c><c r="C{2 * i + 1}" t="inlineStr"><is><t xml:space="preserve"> a &amp; &#x3042;&lt;b </t></is></c>'
                    f'<c r="D{2 * i + 1}"><v>{i}</v></c></row>' for i in range(60))
    unnumbered = "".join(f'<row spans="1:2" ><c t="inlineStr"><is><t>{i}</t></is></c><c t="inlineStr"><is><r><t>x</t></r><r><t>y</t></r></is></c></row>' for i in range(40))
    for size in (64, 700, 1 << 20):
        monkeypatch.setattr(W, "PIECE_BYTES", size)
        for rows in (plain, unnumbered, '<row r="3"/><row/>' + unnumbered, plain + "<!-- </row><row> -->" + unnumbered):
            data = styled(rows, shared)
            assert dict(read_xlsx(data))["S"] == _same_rows_by_parsing(rows, shared)
    many = [p for _, p in W.iter_pieces(styled(plain, shared))]
    assert len(many) == 2  # one of rows, one empty


def test_malformed_rows_are_noticed(monkeypatch):
    import pytest

    from sheetwise.sources import workbooks as W
    monkeypatch.setattr(W, "PIECE_BYTES", 64)
    good = '<row><c t="inlineStr"><is><t>a</t></is></c></row>' * 9
    for bad in ("<row><c></row>", "<row>&no;</row>", '<row><c t="inlineStr"><is><t>&no;</t></is></c></row>', "</sheetData><row>", "a & b"):
        with pytest.raises(W._UNREADABLE):
            read_xlsx(styled(good + bad + good))


def test_workbooks_written_by_many_tasks(spark):
    """Written in pieces, read by pieces: every cell is there, in one file per book."""
    from pyspark.sql import functions as F

    from sheetwise.session import scratch_folder
    from sheetwise.sources import derived
    rows = spark.range(1, 40001).select(F.lit("b2016").alias("book"), F.when(F.col("id") % 2 == 0, "S").otherwise("T").alias("sheet"), F.col("id").alias("row_ordinal"),
                                        F.array(F.col("id").cast("string"), F.lit("<&>\n\"' 語"), F.lit(None).cast("string")).alias("cells"))
    for zipped in (False, True):
        folder = scratch_folder(spark, "books")
        assert derived.write_workbooks(rows, folder, zipped) == 1
        files = spark.read.format("binaryFile").load(folder).collect()
        data = bytes(files[0]["content"])
        if zipped:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                data = z.read("b2016.xlsx")
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None
        sheets = dict(read_xlsx(data))
        assert sheets["S"] == [[str(i), "<&>\n\"' 語", ""] for i in range(2, 40001, 2)] and len(sheets["T"]) == 20000
        got = ingest_workbooks(spark, folder)
        assert got.where("cells[0] = 39999").collect()[0]["row_ordinal"] == 19999
        assert got.where("size(cells) = 3 AND cells[1] = '<&><br>\"'' 語'").count() == 40000


def test_no_task_holds_a_whole_workbook(spark):
    """Files beyond any size that is read as one value; they are put together from splits at line feeds."""
    import random

    from pyspark.sql import functions as F

    from sheetwise.sources import workbooks as W
    d = tempfile.mkdtemp(prefix="sheetwise-wb-")
    noise = random.Random(3)
    lines = ["".join(chr(noise.randrange(0x4e00, 0x9fff)) for _ in range(9)) + "\n" * (i % 3) for i in range(3000)]
    book = make_xlsx([("S", [[("A1", "s", "h")]] + [[(f"A{i + 2}", "s", x)] for i, x in enumerate(lines)])])
    contents = {"database 2016.xlsx": book, "事業%41.xlsx": book, "feeds.xlsx": b"\n\n", "open.xlsx": b"PK\n" * 9000 + b"x"}
    for name, data in contents.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    with zipfile.ZipFile(os.path.join(d, "deflated.zip"), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("database2017.xlsx", book)
    for key, value in (("spark.sql.sources.binaryFile.maxLength", "10"), ("spark.sql.files.maxPartitionBytes", "9000"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "7")):
        spark.conf.set(key, value)
    try:
        found = W.list_files(spark, d + "/*.xlsx")
        for path, length, data in W._bytes_of_files(spark, found).groupBy("path").agg(
                F.max("length"), F.sort_array(F.collect_list(F.struct("block", "k", "data")))).collect():
            name = os.path.basename(W.unquote(path))
            assert b"".join(x["data"] or b"" for x in data)[:length] == contents[name] and length == len(contents[name])
        rows, failed = W.ingest_with_failures(spark, d)
        assert {x["workbook"] for x in failed.collect()} == {"feeds.xlsx", "open.xlsx"}
        got = {}
        for x in rows.orderBy("row_ordinal").collect():
            got.setdefault((x["workbook"], x["source_file"]), []).append(x["cells"][0])
        text = ["h"] + [x.replace("\n", "<br>") for x in lines]
        assert got == {("database 2016.xlsx", "database 2016_S"): text, ("事業%41.xlsx", "事業%41_S"): text, ("deflated.zip", "database2017_S"): text}
    finally:
        for key in ("spark.sql.sources.binaryFile.maxLength", "spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(key)


def test_plain_cells_and_others_give_the_same_rows():
    """The expression and the tree read the same cells; a comment sends a piece to the tree."""
    from sheetwise.sources import workbooks as W
    start = f'<rows xmlns="{M}" xmlns:y="y">'.encode()
    cells = ('<c r="B2" t="inlineStr"><is><t>a &lt;b</t></is></c><c t="inlineStr"><is><t xml:space="preserve"> </t></is></c><c/><c t="inlineStr"><is><t></t></is></c>'
             '<c t="inlineStr"><v>1</v></c><c t="n"><is><t>x</t></is></c><c s="1"><v>42461</v></c><c t="s"><v>3</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c r="A2"><v>7.0</v></c>')
    xml = f'<row r="2" y:z="1">{cells}</row><row/><row r="6" spans="1:2"><c r="C6"><v>5</v></c></row>'
    plain, tree = (W._parse_piece(0, -1, start, x.encode(), {3: "shared"}, {1}, False) for x in (xml, xml + "<!-- -->"))
    assert plain == tree == [[], ["7.0", "a <b", " ", "", "", "", "", "2016-04-01 00:00:00", "shared", "True", "#N/A"], [], [], [], ["", "", "5"]]
    assert W._plain_rows(W._Rows(), start, xml.encode(), {3: "shared"}, {1}, False) == plain
    assert W._plain_rows(W._Rows(), start, (xml + "<!-- -->").encode(), {3: "shared"}, {1}, False) is None


def test_shared_strings_are_read_as_they_come():
    from sheetwise.sources import workbooks as W
    xml = f'<sst xmlns="{M}"><si><t>a</t></si><si/><si><r><t>b</t></r><r><t>c</t></r><rPh sb="0" eb="1"><t>x</t></rPh></si><extLst><ext><si/></ext></extLst><si><t/></si></sst>'
    assert W._shared_strings(io.BytesIO(xml.encode())) == ["a", "", "bc", ""]


def test_steps_leave_no_shuffle_files(spark):
    from sheetwise.session import stored
    files = lambda: {f.getName() for f in _java(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    got = stored(spark.range(1000).repartition(3, "id"), "released")
    assert not files() - before
    assert got.count() == 1000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _java(seq):
    return [seq.apply(i) for i in range(seq.length())]
