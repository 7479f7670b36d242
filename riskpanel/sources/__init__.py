"""Readers for the messy published files the reference ingests
and sinks (S10). Files are read by Spark (many files in parallel, one task
per small file); no file is parsed on the driver."""

from riskpanel.sources.ingest import (  # noqa: F401
    read_after_header, gistemp_monthly, read_semicolon_daily, read_json_table, html_tables, pick_html_table,
    flux_table, read_header_at_line, cpu_monthly, read_series_csv, read_xlsx_cells, xlsx_cells,
    cells_to_table,
)
from riskpanel.sources.sinks import ensure_datasets, read_dataset, write_dataset, write_sample, write_table  # noqa: F401
