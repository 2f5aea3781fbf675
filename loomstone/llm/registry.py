"""Queries of this subpackage, one for each operator and one for the pipeline, and their SQL where SQL can say it."""

from __future__ import annotations

from . import op01_imatch, op02_language, op03_warc, op04_packing, op05_lines, op06_licenses, op07_html, op08_mixing, op09_hamming, op10_jaccard

QUERIES = {
    "op1_imatch": op01_imatch.query,
    "op2_language_id": op02_language.query,
    "op3_warc": op03_warc.query,
    "op4_packing": op04_packing.query,
    "op5_line_dedup": op05_lines.query,
    "op6_licenses": op06_licenses.query,
    "op7_html": op07_html.query,
    "op8_mixing": op08_mixing.query,
    "op9_hamming": op09_hamming.query,
    "op10_jaccard": op10_jaccard.query,
}

SQL = {"op3_warc": op03_warc.SQL, "op5_line_dedup": op05_lines.SQL, "op8_mixing": op08_mixing.SQL, "op10_jaccard": op10_jaccard.SQL}
