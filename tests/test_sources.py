"""File-shape fixtures (FIXTURES.md section 2) written to a scratch folder."""

import datetime as dt
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from riskpanel import sources as src


def _write(d, name, text, encoding="utf-8"):
    p = os.path.join(d, name)
    with open(p, "w", encoding=encoding) as f:
        f.write(text)
    return p


MONTH_HEAD = "Year,Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec,Mean"


def test_header_search_and_unpivot(spark, tmpdir_path):
    rows = ["1900," + ",".join(str(m / 4) for m in range(12)) + ",0", "1901,***" + ",1.5" * 11 + ",***", "1902,7"]
    _write(tmpdir_path, "wide.csv", "Some station: monthly table\n\n  " + MONTH_HEAD + "\n" + "\n".join(rows) + "\n")
    wide = src.read_after_header(spark, tmpdir_path + "/wide.csv", "Year")
    assert wide.count() == 3
    got = {r.date: r.anomaly for r in src.gistemp_monthly(wide).collect()}
    want = {dt.date(1900, m + 1, 1): m / 4 for m in range(12)} | {dt.date(1901, m, 1): 1.5 for m in range(2, 13)}
    want |= {dt.date(1901, 1, 1): None, dt.date(1902, 1, 1): 7.0} | {dt.date(1902, m, 1): None for m in range(2, 13)}
    assert got == want  # a short row is filled with nulls


def test_each_file_has_its_own_header(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "folder")
    os.makedirs(d)
    _write(d, "a.csv", "title\nYear,Jan,Feb\n2000,1,2\n")
    _write(d, "b.csv", 'Year,Feb,Jan\n2001,"2,5",1\n')
    rows = {r.Year: (r.Jan, r.Feb) for r in src.read_after_header(spark, d, "Year").collect()}
    assert rows == {"2000": ("1", "2"), "2001": ("1", "2,5")}
    _write(d, "c.csv", "Year,Jan\n2002,1\n")
    with pytest.raises(ValueError, match="some files lack: .'Feb'"):
        src.read_after_header(spark, d, "Year")


def test_header_missing_raises(spark, tmpdir_path):
    _write(tmpdir_path, "bad.csv", "title\nfoo,bar\n1,2\n")
    with pytest.raises(ValueError, match="no line that starts with 'Year' in .*bad.csv"):
        src.read_after_header(spark, tmpdir_path + "/bad.csv", "Year")


def test_json_tables_by_their_own_headers(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "json")
    os.makedirs(d)
    _write(d, "a.json", '[["k","v"],["a1","1"],["a2"]]')
    _write(d, "b.json", '[["v","k"],["2","b1"]]')
    assert {(r.k, r.v) for r in src.read_json_table(spark, d).collect()} == {("a1", "1"), ("a2", None), ("b1", "2")}


def test_semicolon_daily(spark, tmpdir_path):
    _write(tmpdir_path, "ssn.csv", "# comment line\n2024;01;01;2024.001; 120;10.1;30;1\n2024;01;02;2024.004;  -1;-1;0;0\n")
    rows = src.read_semicolon_daily(spark, tmpdir_path + "/ssn.csv").orderBy("date").collect()
    assert [(r.date, r.value) for r in rows] == [(dt.date(2024, 1, 1), 120.0), (dt.date(2024, 1, 2), -1.0)]


def test_json_array_table(spark, tmpdir_path):
    _write(tmpdir_path, "f.json", '[["time_tag","flux"],["2025-01-01 20:00:00","150"],["2025-01-02 20:00:00","x"]]')
    rows = src.read_json_table(spark, tmpdir_path + "/f.json").orderBy("row_no").collect()
    assert [r.flux for r in rows] == ["150", "x"] and rows[0].time_tag.startswith("2025-01-01")


HTML = """<html><body><table><tr><th>a</th></tr><tr><td>1</td></tr></table>
<table><tr><th>Date</th><th>Time</th><th>Julian Day</th><th>Observed Flux</th><th>Adjusted Flux</th></tr>
<tr><td>2024-01-01</td><td>18:00:00</td><td>1</td><td>150.1</td><td>149</td></tr>
<tr><td>2024-01-01</td><td>20:00:00</td><td>1</td><td>151.5</td><td>150</td></tr>
<tr><td>2024-01-02</td><td>20:00:00</td><td>2</td><td>n/a</td><td>150</td></tr>
<tr><td>2024-01-02</td><td>22:00:00</td><td>2</td><td>152</td><td>150</td></tr></table></body></html>"""


def test_html_flux_table(spark):
    pages = spark.createDataFrame([(1, "u", HTML)], "page_id long, url string, html string")
    rows = src.flux_table(src.pick_html_table(src.html_tables(pages), "Observed Flux")).orderBy("date").collect()
    assert [(r.date, r.flux) for r in rows] == [(dt.date(2024, 1, 1), 150.0), (dt.date(2024, 1, 2), 150.0)]
    seen = src.flux_table(src.pick_html_table(src.html_tables(pages), "Observed Flux"), value_header="observed_flux").orderBy("date")
    assert [r.flux for r in seen.collect()] == [151.5, None]
    none = spark.createDataFrame([(2, "u", "<p>no tables</p>")], "page_id long, url string, html string")
    assert src.html_tables(none).count() == 0
    with pytest.raises(ValueError, match="page 2 has no table"):
        src.pick_html_table(src.html_tables(pages.union(none)), "Observed Flux", pages.union(none))


def test_cp1252_header_at_line_5(spark, tmpdir_path):
    text = "Title é\nline2\nline3\nline4\nDate,CPU_index\nApr-87,101.5\nMay-69,99\nbad,1\nJun-68,3\n"
    _write(tmpdir_path, "cpu.csv", text, encoding="cp1252")
    rows = src.cpu_monthly(spark, tmpdir_path + "/cpu.csv").orderBy("date").collect()
    assert [(r.date, r.cpu) for r in rows] == [(dt.date(1969, 5, 31), 99.0), (dt.date(1987, 4, 30), 101.5),
                                               (dt.date(2068, 6, 30), 3.0)]


def test_series_csv_folder(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "series")
    os.makedirs(d)
    _write(d, "vix.csv", "date,value\n2020-01-31,13.5\n2020-02-29,40\n")
    _write(d, "co2.csv", "date,value\n2020-01-31,410.1\n2020-02-29,***\n")
    got = {(r.series_id, r.date): r.value for r in src.read_series_csv(spark, d).collect()}
    assert got[("vix", dt.date(2020, 2, 29))] == 40.0 and got[("co2", dt.date(2020, 2, 29))] is None


def _xlsx(path):
    sheet = ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/'
             'spreadsheetml/2006/main"><sheetData>'
             '<row r="1"><c r="A1" t="inlineStr"><is><t>preamble</t></is></c></row>'
             '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c></row>'
             '<row r="4"><c r="A4" t="inlineStr"><is><t>01/02/2020</t></is></c><c r="C4"><v>1.5</v></c></row>'
             '</sheetData></worksheet>')
    shared = ('<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
              '<si><t>Date</t></si><si><t>Physical Risk Index (PRI)</t></si></sst>')
    wb = ('<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
          'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
          '<sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>')
    rels = ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type="x"/></Relationships>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)


def test_xlsx_cells(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "xl")
    os.makedirs(d)
    _xlsx(os.path.join(d, "risk.xlsx"))
    cells = src.read_xlsx_cells(spark, d, sheet="Data")
    t = src.cells_to_table(cells, header_row=3).collect()
    assert len(t) == 1 and t[0]["Date"] == "01/02/2020" and t[0]["Physical Risk Index (PRI)"] == "1.5"


@pytest.mark.parametrize("base, serial", [("", 43862), ('<workbookPr date1904="1"/>', 42400)])
def test_xlsx_dates(spark, tmpdir_path, base, serial):
    """Date cells are numbers with a date format, counted from the workbook's date base."""
    from riskpanel.sources import ingest
    from riskpanel.plans.compositions import climate_indices
    d = os.path.join(tmpdir_path, f"xl{serial}")
    os.makedirs(d)
    _xlsx(os.path.join(d, "plain.zip"))
    with zipfile.ZipFile(os.path.join(d, "plain.zip")) as old, zipfile.ZipFile(os.path.join(d, "risk.xlsx"), "w") as z:
        for name in old.namelist():
            text = old.read(name).decode()
            text = text.replace("<sheets>", base + "<sheets>").replace(
                '<c r="A4" t="inlineStr"><is><t>01/02/2020</t></is></c>', f'<c r="A4" s="1"><v>{serial}</v></c>').replace(
                "</sheetData>", f'<row r="5"><c r="A5" s="2"><v>{serial + 1}.5</v></c><c r="C5"><v>2.5</v></c></row></sheetData>')
            z.writestr(name, text)
        z.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                   '<numFmts><numFmt numFmtId="164" formatCode="[$-409]d\\-mmm\\-yy;@"/></numFmts><cellXfs><xf numFmtId="0"/>'
                   '<xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>')
    rep = climate_indices(src.read_xlsx_cells(spark, d, sheet="Data"), header_row=3, rename={"Physical Risk Index (PRI)": "pri"}, window=1)
    assert sorted((r.date, r.pri) for r in rep["table"].collect()) == [(dt.date(2020, 2, 1), 1.5), (dt.date(2020, 2, 2), 2.5)]
    assert [ingest._is_date_format(x) for x in ("yyyy", "h:mm", "[h]:mm:ss", '0.0" d"', "General", "mmm-yy")] == [True, False, False, False, False, True]
    assert ingest._serial_date("1", False) == "1900-01-01" and ingest._serial_date("60", False) == "60" and ingest._serial_date("61", False) == "1900-03-01"


def test_unparsable_dates_are_errors(spark, tmpdir_path):
    from riskpanel.plans.compositions import climate_indices
    cells = spark.createDataFrame([("f", "Data", 1, 1, "Date"), ("f", "Data", 1, 2, "pri"), ("f", "Data", 2, 1, "43862"), ("f", "Data", 2, 2, "1.5")],
                                  "file string, sheet string, row int, col int, value string")
    with pytest.raises(Exception, match="no date: 43862"):
        climate_indices(cells, header_row=1, window=1)["table"].collect()


def test_ensure_datasets(spark, tmpdir_path):
    df = spark.range(3)
    root = os.path.join(tmpdir_path, "processed")
    assert src.ensure_datasets(spark, {"a": df}, root) == ["a"]
    src.ensure_datasets(spark, {"a": spark.range(10)}, root)           # ignore: already there
    assert spark.read.parquet(root + "/a").count() == 3
    with pytest.raises(FileNotFoundError):
        src.ensure_datasets(spark, {}, root, required=["b"])


def test_datasets_are_whole_or_an_error(spark, tmpdir_path):
    """A lost file, a changed file, a dataset without a manifest and an absent one are told apart from a whole one."""
    root = os.path.join(tmpdir_path, "sets")
    df = spark.range(1000).withColumn("v", 1000 - F.col("id"))
    assert src.write_dataset(df, root, "a", order=["v"]) and not src.write_dataset(spark.range(1), root, "a")
    back = src.read_dataset(spark, root, "a")
    assert back.columns == ["id", "v"] and back.count() == 1000 and back.agg(F.sum("v")).first()[0] == 500500
    by_file = back.groupBy(F.col("_metadata.file_name")).agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("lo").collect()
    assert all(x.hi < y.lo for x, y in zip(by_file, by_file[1:]))          # files are ranges of the order
    assert not [n for n in os.listdir(root) if n.startswith("_pending")]
    src.write_dataset(spark.range(0), root, "none")
    assert src.read_dataset(spark, root, "none").count() == 0
    src.write_dataset(df.repartition(4), root, "b")
    data = sorted(n for n in os.listdir(root + "/b") if n.endswith(".parquet"))
    with open(f"{root}/b/{data[0]}", "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="not as it was written"):
        src.ensure_datasets(spark, {}, root, required=["b"])
    src.write_dataset(df.repartition(4), root, "c")
    lost = sorted(n for n in os.listdir(root + "/c") if n.endswith(".parquet"))[1]
    os.remove(f"{root}/c/{lost}")
    with pytest.raises(ValueError, match="not as it was written"):
        src.read_dataset(spark, root, "c")
    df.write.parquet(root + "/plain")
    assert src.ensure_datasets(spark, {}, root, required=["a", "plain"]) == []
    with pytest.raises(ValueError, match="no manifest"):
        src.read_dataset(spark, root, "plain")
    with pytest.raises(FileNotFoundError):
        src.read_dataset(spark, root, "absent")


def test_climate_indices_report(spark, tmpdir_path):
    from riskpanel.plans.compositions import climate_indices
    d = os.path.join(tmpdir_path, "xl2")
    os.makedirs(d)
    _xlsx(os.path.join(d, "risk.xlsx"))
    cells = src.read_xlsx_cells(spark, d, sheet="Data")
    rep = climate_indices(cells, header_row=3, rename={"Physical Risk Index (PRI)": "pri"}, window=1)
    t = rep["table"].collect()
    assert len(t) == 1 and t[0].date == dt.date(2020, 2, 1) and t[0].pri == 1.5 and t[0].pri_smooth == 1.5
    assert rep["monotonic"].first().monotonic
    assert rep["duplicates"].first().extra_copies == 0


def test_solar_daily(spark, tmpdir_path):
    from riskpanel.plans.compositions import solar_daily
    _write(tmpdir_path, "ssn.csv", "2025;01;01;2025.001; 120;10.1;30;1\n2025;01;02;2025.004; 99;9;20;1\n")
    _write(tmpdir_path, "flux.json",
           '[["time_tag","flux"],["2025-01-01 20:00:00","150"],["2025-01-01 18:00:00","1"],["2025-01-03 20:00:00","151"]]')
    got = {r.ts: (r.sunspot_number, r.f107_flux) for r in solar_daily(spark, tmpdir_path + "/ssn.csv",
                                                                       tmpdir_path + "/flux.json").collect()}
    T = dt.datetime
    assert got == {T(2025, 1, 1): (120.0, None), T(2025, 1, 2): (99.0, None), T(2025, 1, 1, 20): (None, 150.0),
                   T(2025, 1, 1, 18): (None, 1.0), T(2025, 1, 3, 20): (None, 151.0)}
    by_day = {r.ts: (r.sunspot_number, r.f107_flux) for r in solar_daily(
        spark, tmpdir_path + "/ssn.csv", tmpdir_path + "/flux.json", on="date").collect()}
    assert by_day[dt.date(2025, 1, 1)] == (120.0, 75.5)


def test_blank_header_cells_keep_their_columns(spark, tmpdir_path):
    _write(tmpdir_path, "blank.csv", "Year,,Jan, ,Feb,\n1900,x,1.5,y,2.5,z\n1901,,3,,4,\n")
    got = src.read_after_header(spark, tmpdir_path + "/blank.csv", "Year").orderBy("Year").collect()
    assert [(r.Year, r.Jan, r.Feb) for r in got] == [("1900", "1.5", "2.5"), ("1901", "3", "4")]
    _write(tmpdir_path, "b6.csv", "t\nDate,,CPU  index\nJan-90,q,7\n")
    assert src.read_header_at_line(spark, tmpdir_path + "/b6.csv", 1).first().cpu__index == "7"


def test_lines_of_a_file_in_many_splits(spark, tmpdir_path):
    """A file is read by many tasks and its lines keep their numbers."""
    from riskpanel.sources import ingest
    d = os.path.join(tmpdir_path, "big")
    os.makedirs(d)
    want = {}
    for name, n in (("a.txt", 6000), ("b.txt", 1), ("c.txt", 2500)):
        lines = [f"{name} {k} " + "x" * (k % 50) + ("\r" if k % 3 == 0 else "") for k in range(n)] + ["", "last"]
        _write(d, name, "\n".join(lines))
        want[name] = [x.rstrip("\r") for x in lines]
    _write(d, "empty.txt", "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = ingest._lines(spark, d)
        raw = spark.read.text(d)
        assert raw.rdd.getNumPartitions() > 30
        rows = {}
        for r in got.collect():
            rows.setdefault(os.path.basename(r.file), {})[r.line_no] = r.line
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {f: [x[k] for k in range(len(x))] for f, x in rows.items()} == want
    with pytest.raises(ValueError, match="empty.txt|b.txt|c.txt"):
        src.read_after_header(spark, d, "a.txt 5")


def test_missing_datasets_are_named_and_other_errors_show(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError, match="none"):
        src.ensure_datasets(spark, {}, tmpdir_path + "/nowhere", ["none"])
    _write(tmpdir_path, "broken", "no parquet at all")
    with pytest.raises(Exception) as e:
        src.ensure_datasets(spark, {}, tmpdir_path, ["broken"])
    assert not isinstance(e.value, FileNotFoundError)


def test_workbook_sheets_are_read_apart(spark):
    """Sheets of one workbook go to rows of their own; long sheets leave in batches; cells without a place count on."""
    from riskpanel.sources import ingest
    n = 2 * ingest.CELL_BATCH + 5
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="long" sheetId="1" r:id="a"/>'
                   '<sheet name="bare" sheetId="2" r:id="b"/><sheet name="lost" sheetId="3" r:id="c"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><r Id="a" Target="worksheets/s1.xml"/><r Id="b" Target="/xl/worksheets/s2.xml"/>'
                   '<r Id="c" Target="charts/c.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f'<sst {main}><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {main}><sheetData>" + "".join(
            f'<row r="{i}"><c r="AB{i}"><v>{i}</v></c></row>' for i in range(1, n + 1)) + "</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {main}><sheetData><row><c t="s"><v>0</v></c><c/></row>'
                   '<row><c r="C2" t="str"><v>x</v></c><c><v>7</v></c></row></sheetData></worksheet>')
    files = spark.createDataFrame([("f", bytearray(out.getvalue())), ("g", None), ("h", bytearray(b""))], "file string, content binary")
    cells = src.xlsx_cells(files)
    long = cells.where("sheet = 'long'").selectExpr("count(*) c", "sum(row) r", "sum(cast(value as long)) v", "min(col) a", "max(col) b").head()
    assert tuple(long) == (n, n * (n + 1) // 2, n * (n + 1) // 2, 28, 28)
    rest = sorted(tuple(r) for r in cells.where("sheet <> 'long'").collect())
    assert rest == [("f", "bare", 1, 1, "two runs"), ("f", "bare", 1, 2, None), ("f", "bare", 2, 3, "x"), ("f", "bare", 2, 4, "7")]
    assert src.xlsx_cells(files, "bare").count() == 4


def test_columns_by_file_and_place(spark):
    from riskpanel.operators import features as fx
    cells = spark.createDataFrame(
        [(f, "s", 1, c, n) for f in "ab" for c, n in enumerate(["z", "", "m", "a"], 1)]
        + [("a", "s", 2, 1, "1"), ("a", "s", 2, 2, "no name"), ("b", "s", 2, 3, "2"), ("b", "s", 3, 4, "3")],
        "file string, sheet string, row int, col int, value string")
    t = src.cells_to_table(cells, 1)
    assert t.columns == ["file", "sheet", "row", "z", "m", "a"]
    got = {r["file"]: r["filled"] for r in fx.filled_columns(t, ["z", "m", "a"], keys=["file"]).collect()}
    assert got == {"a": ["z"], "b": ["m", "a"]}
