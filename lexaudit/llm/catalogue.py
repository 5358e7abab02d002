"""The named queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

from lexaudit.llm import bpe, html_extract, license_scan, media, packing, panes, pii, simhash, toxicity, url_filter, variants, vector_dedup, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_pii": pii.op2_pii,
    "op3_packing": packing.op3_packing,
    "op4_bpe": bpe.op4_bpe,
    "op5_vector_dedup": vector_dedup.op5_vector_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_media": media.op7_media,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_warc": warc.op11_warc,
    "op12_spelling": variants.op12_spelling,
    "op13_panes": panes.op13_panes,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op10_license_scan": license_scan.OP10_SQL,
    "op11_warc": warc.OP11_SQL,
    "op12_spelling": variants.OP12_SQL,
    "op13_panes": panes.OP13_SQL,
}
