"""Drawing quantities on Spark: text spans and painted paths in, counted, priced and scored quantities out."""

from __future__ import annotations

import importlib

__version__ = "0.2.0"

#: The names offered here and the modules they live in; a module is loaded when one of its names is first used.
_NAMES = {
    "engine": ["count_drawings", "counted", "merged_items", "with_signatures", "marks", "VisionPass", "Takeoff"],
    "benchmark": ["run_bench", "shared_items", "Report"],
    "sources.drawings": ["read_drawings", "read_spans", "read_paths", "read_pages", "read_page_images", "png_size"],
    "sources.sets": ["discover_sets", "read_truth"],
    "sources.fixtures": ["write_sets"],
    "operators.legends": ["read_legends", "legend_items", "read_legend_file"],
    "operators.titleblock": ["read_title_blocks", "notes_boxes", "structural_boxes"],
    "operators.tags": ["match_tags", "without_twins", "tag_detections", "count_tags"],
    "operators.symbols": ["elements", "merge_hatch_bands", "glyphs", "signatures", "match_symbols", "symbol_detections", "symbol_stats"],
    "operators.items": ["item_counts", "merge_items", "merge_legends", "bill", "bill_totals"],
    "operators.scoring": ["engine_totals", "resolve", "score_items", "score_sets", "summary", "TOLERANCE", "PRICE_IN", "PRICE_OUT"],
    "operators.tiles": ["origins", "tiles", "dedupe", "second_look"],
    "operators.vision": ["ModelPass", "Settings", "SpendCapError", "Retry", "doubtful"],
    "functions.text": ["normalise", "is_tag_like", "section_of", "SECTIONS"],
    "sinks.results": ["result_documents", "write_results", "console_lines", "report_lines", "report_text", "report_document"],
    "sinks.workbook": ["write_bill", "bill_lines"],
    "sinks.overlay": ["overlays", "page_marks"],
}
_WHERE = {name: module for module, names in _NAMES.items() for name in names}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)
