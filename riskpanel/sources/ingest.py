"""File ingest.

Every reader keeps the file name (``_metadata.file_path``) so a folder of
files becomes one long DataFrame keyed by source file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskpanel.functions.calendar import MONTHS, make_month_date, month_end, parse_date
from riskpanel.functions.nulls import to_double
from riskpanel.functions.text import normalise_header
from riskpanel.session import materialize


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of every file under ``path``, empty ones too; nothing is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))


def _lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(file, line_no, line) for every line of every file under ``path``, line_no from 0.

    A file is read in splits by as many tasks as it has; lines are numbered by their place in the split and the number of
    lines in the file's splits before it (one row for each split). Lines end with a line feed, with or without a carriage
    return before it; the encoding must keep line feeds as single bytes."""
    rd = spark.read.option("lineSep", "\n")
    if encoding:
        rd = rd.option("encoding", encoding)
    raw = rd.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                               F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))
    raw = materialize(raw)  # splits are planned once: a second plan might cut the files elsewhere
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    splits = materialize(splits.select("file", "split", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift")))
    return raw.join(splits, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).cast("long").alias("line_no"), "line")


def _parsed(line: Column, sep: str, width: int) -> Column:
    """The cells of a delimited line (quotes respected); missing cells are null, surplus ones dropped."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    s = F.from_csv(line, F.lit(schema), {"sep": sep, "mode": "PERMISSIVE"})
    return F.array(*[F.trim(s[f"c{i}"]) for i in range(width)])


def _by_own_header(body: DataFrame, headers: DataFrame, clean) -> DataFrame:
    """(file, row_no, <columns>) from (file, row_no, cells) and each file's own
    header (file, hdr ARRAY): a cell is found by its name in its file's header,
    so files may order their columns differently; a file that lacks a column
    that another one has is an error. A blank header cell names no column, its
    cells are skipped. Only the distinct headers reach the driver."""
    headers = headers.withColumn("hdr", F.transform("hdr", lambda c: F.coalesce(c, F.lit(""))))
    distinct = [r.hdr for r in headers.select("hdr").distinct().collect()]
    sets = [{clean(c) for c in h if clean(c)} for h in distinct]
    names = [clean(c) for c in min(distinct, key=lambda h: (-len(h), h)) if clean(c)]
    lacking = sorted({n for s in sets for t in sets for n in s - t})
    if lacking:
        raise ValueError(f"columns that some files lack: {lacking}")
    places = F.create_map(*[x for h in distinct for x in (
        F.array(*[F.lit(c) for c in h]), F.array(*[F.lit([clean(c) for c in h].index(n)) for n in names]))])
    j = body.join(headers, "file").withColumn("at", places[F.col("hdr")])
    return j.select("file", "row_no", *[F.get("cells", F.col("at")[k]).alias(n) for k, n in enumerate(names)])


def _delimited(lines: DataFrame, hdr: DataFrame, sep: str, clean) -> DataFrame:
    """Rows below each file's header line, from (file, hdr_no, line of the header)."""
    width = max((r[0] for r in hdr.select(F.size(F.split("hdr_line", sep))).distinct().collect()), default=1)
    headers = hdr.select("file", _parsed(F.col("hdr_line"), sep, width).alias("hdr"))
    body = lines.join(hdr, "file").where((F.col("line_no") > F.col("hdr_no")) & (F.trim("line") != ""))
    body = body.select("file", (F.col("line_no") - F.col("hdr_no")).alias("row_no"), _parsed(F.col("line"), sep, width).alias("cells"))
    return _by_own_header(body, headers, clean)


def read_after_header(spark: SparkSession, path: str, header_prefix: str = "Year", *,
                      sep: str = ",", encoding: str | None = None) -> DataFrame:
    """Skip every line before the first whose stripped text starts with
    ``header_prefix``; that line is the file's header (an error if a file has
    none). Returns (file, row_no, <header columns as STRING>)."""
    lines = _lines(spark, path, encoding)
    hdr = lines.where(F.trim("line").startswith(header_prefix)).groupBy("file").agg(
        F.min("line_no").alias("hdr_no"), F.min_by("line", "line_no").alias("hdr_line"))
    without = _files(spark, path).join(hdr, "file", "left_anti").first()
    if without is not None:
        raise ValueError(f"no line that starts with {header_prefix!r} in {without.file}")
    return _delimited(lines, hdr, sep, lambda c: normalise_header(c, lower=False, underscore=False))


def read_header_at_line(spark: SparkSession, path: str, header_line: int, *, sep: str = ",",
                        encoding: str | None = None) -> DataFrame:
    """S6 helper: the header is line ``header_line`` (0-based) of every file."""
    lines = _lines(spark, path, encoding)
    hdr = lines.where(F.col("line_no") == header_line).select(
        "file", F.lit(header_line).alias("hdr_no"), F.col("line").alias("hdr_line"))
    without = _files(spark, path).join(hdr, "file", "left_anti").first()
    if without is not None:
        raise ValueError(f"no line {header_line} in {without.file}")
    return _delimited(lines, hdr, sep, normalise_header)


def gistemp_monthly(wide: DataFrame, *, year_col: str = "Year") -> DataFrame:
    """S1 + T4 + F4 + F6: wide year x month table -> (file, date, anomaly);
    '***' and other junk -> NULL (coerced, B13)."""
    present = [m for m in MONTHS if m in wide.columns]
    lg = wide.select("file", year_col, *present).unpivot(["file", year_col], present, "month", "raw")
    out = lg.select("file", make_month_date(F.col(year_col).try_cast("int"),
                                            F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.col("month")))
                    .alias("date"), to_double("raw").alias("anomaly"))
    return out.where(F.col("date").isNotNull())


def read_semicolon_daily(spark: SparkSession, path: str,
                         names: tuple[str, ...] = ("year", "month", "day", "decimal_date", "value", "std",
                                                   "n_obs", "definitive"),
                         keep: tuple[str, ...] = ("value",)) -> DataFrame:
    """S2: ';'-separated, headerless, '#' comments, fixed names; date from
    year/month/day; kept columns cast to double (coerced)."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = (spark.read.schema(schema).option("sep", ";").option("comment", "#").option("header", "false")
          .csv(path).withColumn("file", F.col("_metadata.file_path")))
    d = F.make_date(F.col("year").try_cast("int"), F.col("month").try_cast("int"), F.col("day").try_cast("int"))
    return df.select("file", d.alias("date"), *[to_double(F.trim(c)).alias(c) for c in keep])


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """S3: JSON array of arrays whose first element is the file's own header.
    Returns (file, row_no, <header names>) as strings; the caller coerces.
    Short rows are filled with nulls."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.from_json("value", "array<array<string>>").alias("a"))
    headers = raw.select("file", F.col("a")[0].alias("hdr"))
    rows = raw.select("file", F.posexplode("a").alias("row_no", "cells")).where(F.col("row_no") > 0)
    return _by_own_header(rows, headers, normalise_header)


_TABLE = r"(?is)<table\b.*?</table>"
_ROW = r"(?is)<tr\b.*?</tr>"
_CELL = r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"


def _strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), r"[\t\r\n\f]+", " "))


def html_tables(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """S4 (part 1): every table row of every page as (page, table_no, row_no,
    cells ARRAY<STRING>); tags stripped, whitespace collapsed."""
    t = pages.select(F.col(id_col).alias("page"), F.posexplode(F.regexp_extract_all(html_col, F.lit(_TABLE), 0))
                     .alias("table_no", "tbl"))
    r = t.select("page", "table_no", F.posexplode(F.regexp_extract_all("tbl", F.lit(_ROW), 0)).alias("row_no", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(_CELL), 1), _strip_tags)
    return r.select("page", "table_no", "row_no", cells.alias("cells"))


def pick_html_table(rows: DataFrame, header_contains: str, pages: DataFrame | None = None,
                    id_col: str = "page_id") -> DataFrame:
    """S4 (part 2): per page, the first table whose header row has a cell
    containing ``header_contains``; raises when a page has none. Give ``pages``
    so that pages without any table are known, too."""
    hdr = rows.where(F.col("row_no") == 0).where(F.exists("cells", lambda c: c.contains(header_contains)))
    first = hdr.groupBy("page").agg(F.min("table_no").alias("table_no"))
    listed = rows.select("page") if pages is None else pages.select(F.col(id_col).alias("page"))
    without = listed.distinct().join(first, "page", "left_anti").first()
    if without is not None:
        raise ValueError(f"page {without.page} has no table with a {header_contains!r} column")
    return rows.join(first, ["page", "table_no"])


def flux_table(rows: DataFrame, *, time_prefix: str = "20:00", date_fmt: str = "yyyy-MM-dd",
               value_header: str = "adjusted_flux") -> DataFrame:
    """S4 (part 3): header normalised (lower, '_'), keep rows whose time starts
    with ``time_prefix``, coerce date and value; one row per (page, date)."""
    hdr = rows.where(F.col("row_no") == 0).select(
        "page", "table_no", F.transform("cells", lambda c: F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")))
        .alias("hdr"))
    body = rows.where(F.col("row_no") > 0).join(hdr, ["page", "table_no"])
    pos = lambda name: F.array_position("hdr", F.lit(name)).cast("int")
    cell = lambda name: F.when(pos(name) > 0, F.element_at("cells", pos(name)))
    out = body.where(cell("time").startswith(time_prefix)).select(
        "page", parse_date(cell("date"), date_fmt).alias("date"), to_double(cell(value_header)).alias("flux"))
    return out.where(F.col("date").isNotNull())


def cpu_monthly(spark: SparkSession, path: str, header_line: int = 4, encoding: str = "windows-1252",
                date_col: str = "date", value_col: str = "cpu_index") -> DataFrame:
    """cp1252 CSV, header on the 5th line, dates like 'Apr-87' (two-digit
    year pivot: 69..99 -> 19xx), bad dates dropped, month-end index."""
    t = read_header_at_line(spark, path, header_line, encoding=encoding)
    d = parse_date(F.col(date_col), "MMM-yy", two_digit_year=True)
    out = t.select("file", month_end(d).alias("date"), to_double(value_col).alias("cpu"))
    return out.where(F.col("date").isNotNull())


def read_series_csv(spark: SparkSession, path: str, name_from_file: bool = True) -> DataFrame:
    """Processed one-series CSVs (date, value) -> long (series_id, date, value);
    the series id is the file name without extension."""
    df = (spark.read.option("header", "true").schema("date STRING, value STRING").csv(path)
          .withColumn("file", F.col("_metadata.file_name")))
    sid = F.regexp_replace("file", r"\.[^.]*$", "") if name_from_file else F.lit("value")
    return df.select(sid.alias("series_id"), F.to_date(F.try_to_timestamp("date")).alias("date"),
                     to_double("value").alias("value"))


def read_xlsx_cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Workbook cells (file, sheet, row, col, value) of the .xlsx files under ``path``, see ``xlsx_cells``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return xlsx_cells(files.select(F.col("path").alias("file"), "content"), sheet)


def xlsx_cells(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """(file, content) of .xlsx workbooks -> cells (file, sheet, row, col, value).

    A first pass opens each workbook and sends out one row for each sheet: its part as it lies packed in the archive,
    the packed text table if the sheet refers to one, and what its cell styles and date base say. A shuffle by
    (file, sheet) spreads the sheets, so those of one workbook are read in parallel; a sheet's XML is then parsed
    incrementally and its cells leave in batches, never the whole sheet at once.

    Numbers in a cell with a date format become ``yyyy-MM-dd`` (``yyyy-MM-dd HH:mm:ss`` with a time of day) by the
    workbook's date base (1900 or 1904). A null content or one of no bytes has no cells; what is no workbook raises.
    Legacy binary .xls is not read."""
    parts = files.select("file", "content").where(F.length("content") > 0).mapInPandas(
        lambda it: _sheet_parts(it, sheet), "file string, sheet string, part binary, texts binary, dates array<int>, base_1904 boolean")
    spread = parts.repartition("file", "sheet")
    return spread.mapInPandas(_sheet_cells, "file string, sheet string, row int, col int, value string")


CELL_BATCH = 20_000  # cells of a sheet that leave a task at once

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


_DATE_FORMATS = {14, 15, 16, 17, 22, *range(27, 32), 36, *range(50, 55), 57, 58}  # built-in, with a day, month or year


def _is_date_format(code: str) -> bool:
    """Whether a number format shows a day, month name or year (not a time of day or an elapsed time only)."""
    import re
    if re.search(r"(?i)\[(h+|m+|s+)\]", code):
        return False
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]', "", code.split(";")[0])
    return re.search(r"(?i)[dy]|mmm", plain) is not None


def _serial_date(text: str, base_1904: bool) -> str:
    """A date serial as text; what is no day of the calendar stays as it is."""
    import datetime as dt
    try:
        n = float(text)
        if base_1904:
            base = dt.datetime(1904, 1, 1)
        else:  # the 1900 base has a day 60 that never was
            base = dt.datetime(1899, 12, 30 if n >= 61 else 31)
        if n < (0 if base_1904 else 1) or (not base_1904 and 60 <= n < 61):
            return text
        when = base + dt.timedelta(seconds=round(n * 86400))
    except (ValueError, OverflowError):
        return text
    return when.strftime("%Y-%m-%d" if when.time() == dt.time() else "%Y-%m-%d %H:%M:%S")


def _packed(archive, name: str) -> bytes:
    """A member of an archive, packed anew by zlib piece by piece."""
    import zlib
    pack, out = zlib.compressobj(1), []
    with archive.open(name) as member:
        while piece := member.read(1 << 16):
            out.append(pack.compress(piece))
    return b"".join([*out, pack.flush()])


def _date_styles(archive) -> list[int]:
    """The positions of the cell styles that show a date."""
    import xml.etree.ElementTree as ET
    if "xl/styles.xml" not in archive.namelist():
        return []
    styles = ET.fromstring(archive.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iterfind(f"{_NS}numFmts/{_NS}numFmt")}
    formats = [int(xf.get("numFmtId") or 0) for xf in styles.iterfind(f"{_NS}cellXfs/{_NS}xf")]
    return [i for i, k in enumerate(formats) if (_is_date_format(own[k]) if k in own else k in _DATE_FORMATS)]


def _sheet_parts(frames, want: str | None):
    import io
    import posixpath
    import xml.etree.ElementTree as ET
    import zipfile

    import pandas as pd
    for pdf in frames:
        for file, content in zip(pdf["file"], pdf["content"]):
            archive = zipfile.ZipFile(io.BytesIO(content))
            book = ET.fromstring(archive.read("xl/workbook.xml"))
            props = book.find(f"{_NS}workbookPr")
            base_1904 = props is not None and props.get("date1904") in ("1", "true")
            rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
            dates = _date_styles(archive)
            texts = _packed(archive, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in archive.namelist() else None
            for sh in book.find(f"{_NS}sheets"):
                name = sh.get("name")
                part = posixpath.normpath(posixpath.join("/xl", rels[sh.get(f"{_REL}id")])).lstrip("/")
                if (want is None or name == want) and part in archive.namelist():
                    yield pd.DataFrame({"file": [file], "sheet": [name], "part": [_packed(archive, part)],
                                        "texts": [texts], "dates": [dates], "base_1904": [base_1904]})


def _elements(packed: bytes, tag: str):
    """The elements of one kind of a packed XML part, in order; each is dropped once read."""
    import xml.etree.ElementTree as ET
    import zlib
    parser, unpack, step = ET.XMLPullParser(["start", "end"]), zlib.decompressobj(), 1 << 16
    above, inside = [], 0
    data = packed
    while data or not unpack.eof:
        piece = unpack.decompress(data, step)
        data = unpack.unconsumed_tail
        if not piece:
            break
        parser.feed(piece)
        for event, e in parser.read_events():
            if event == "start":
                above.append(e)
                inside += e.tag == tag
                continue
            above.pop()
            if e.tag == tag:
                inside -= 1
                yield e
            if above and not inside:
                above[-1].remove(e)


def _written(e) -> str:
    """The text of a string item: its runs joined, without phonetic hints."""
    hints = {id(t) for h in e.iter(f"{_NS}rPh") for t in h.iter(f"{_NS}t")}
    return "".join(t.text or "" for t in e.iter(f"{_NS}t") if id(t) not in hints)


def _sheet_cells(frames):
    import re

    import pandas as pd
    place = re.compile(r"([A-Z]+)([0-9]+)")

    def cells(part, shared, dates, base_1904):
        row = col = 0
        for line in _elements(part, f"{_NS}row"):
            row, col = int(line.get("r") or row + 1), 0
            for c in line.iterfind(f"{_NS}c"):
                at = place.fullmatch(c.get("r") or "")
                col = col + 1 if at is None else 0
                for ch in at.group(1) if at else "":
                    col = col * 26 + ord(ch) - 64
                v, inline, kind = c.find(f"{_NS}v"), c.find(f"{_NS}is"), c.get("t")
                if inline is not None:
                    text = _written(inline)
                else:
                    text = None if v is None else v.text
                    if text is not None and kind == "s":
                        text = shared[int(text)]
                    elif text is not None and kind in (None, "n") and int(c.get("s") or 0) in dates:
                        text = _serial_date(text, base_1904)
                yield row, col, text

    for pdf in frames:
        for s in pdf.itertuples(index=False):
            shared = [_written(e) for e in _elements(s.texts, f"{_NS}si")] if s.texts is not None else []
            batch = []
            for cell in cells(s.part, shared, set(s.dates), s.base_1904):
                batch.append((s.file, s.sheet, *cell))
                if len(batch) == CELL_BATCH:
                    yield pd.DataFrame(batch, columns=["file", "sheet", "row", "col", "value"])
                    batch = []
            yield pd.DataFrame(batch, columns=["file", "sheet", "row", "col", "value"])


def cells_to_table(cells: DataFrame, header_row: int, columns: list[str] | None = None) -> DataFrame:
    """Cells -> table: row ``header_row`` (1-based) names the columns,
    earlier rows (preamble) are skipped, columns without a name are absent.
    Columns come in the order of their first place in any sheet."""
    hdr = cells.where(F.col("row") == header_row).select("file", "sheet", "col",
                                                          F.trim("value").alias("name"))
    names = columns
    if names is None:
        found = hdr.where(F.col("name") != "").groupBy("name").agg(F.min("col").alias("col"))
        names = [r["name"] for r in found.orderBy("col", "name").collect()]
    body = cells.where(F.col("row") > header_row).join(hdr, ["file", "sheet", "col"])
    wide = body.groupBy("file", "sheet", "row").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    return wide
