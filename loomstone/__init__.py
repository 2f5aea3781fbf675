"""Web-page graph analytics and training-data preparation on PySpark. Names are loaded when first used."""

from __future__ import annotations

from importlib import import_module

#: Public names and the modules that hold them.
EXPORTS = {
    "Config": "config", "CONFIG": "config",
    "elements": "sources.elements", "html_elements": "sources.elements", "parsed_elements": "sources.elements", "html_page_elements": "sources.elements", "html_links": "sources.elements", "flow_layout": "sources.elements",
    "read_jsonl": "sources.stores", "read_snapshot": "sources.stores", "append_unseen": "sources.stores", "upserted": "sources.stores", "save_tile_images": "sources.stores",
    "build_tiles": "operators.tiling", "build_section_tiles": "operators.tiling", "pack_page": "operators.tiling",
    "split_sections": "operators.sectioning", "section_units": "operators.sectioning", "page_heights": "operators.spatial", "grid_bands": "operators.spatial", "text_chunks": "operators.spatial",
    "reading_order": "operators.graph", "edges": "operators.graph", "nodes": "operators.graph", "section_edges": "operators.graph", "to_xml": "operators.graph", "graph_json": "operators.graph",
    "page_graph": "operators.corpus", "corpus_edges": "operators.corpus", "crawl": "operators.corpus", "unit_slugs": "operators.corpus",
    "question_scores": "operators.scoring", "similar_pairs": "operators.scoring",
    "controller_log": "operators.controller", "run_controller": "operators.controller", "evidence": "operators.controller", "state_counts": "operators.controller",
    "hard_negatives": "operators.mining", "cross_page_negatives": "operators.mining", "contrastive": "operators.mining", "multihop": "operators.mining", "batch_offsets": "operators.mining",
    "recall_and_mrr": "operators.evaluation", "answer_metrics": "operators.evaluation",
    "answer": "operators.models", "asked": "operators.models", "generated_qa": "operators.models", "table_provider": "operators.models",
    "scaled_side": "functions.text", "ingest": "streaming.ingest",
}
__all__ = sorted(EXPORTS)


def __getattr__(name: str):
    if name not in EXPORTS:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{EXPORTS[name]}"), name)
