"""Schemas of the tables, as Spark DDL."""

LINK = "struct<href:string,anchor_text:string>"
ELEMENTS = f"unit string, seq int, tag string, x double, y double, width double, height double, depth int, text string, links array<{LINK}>"
TILES = f"unit string, tile_seq int, tile_id string, x int, y int, width int, height int, dom_tag string, text_preview string, source_ids array<int>, links array<{LINK}>"
NODES = "unit string, node_id string, pos int, type string, tag string, x long, y long, width long, height long, text string, url string, title string, state string"
EDGES = "unit string, src string, dst string, relation string, direction string, similarity double, anchor_text string"
QA_PAIRS = "id string, page_url string, page_slug string, tile_id string, question string, answer string, image_path string"
MANIFEST = "tile_id string, page_url string, page_slug string, image_path string, dom_tag string, text_preview string"
CONTRASTIVE = "qa_id string, page_url string, page_slug string, question string, answer string, positive_tile_id string, hard_negative_tile_ids array<string>"
MULTIHOP = "id string, question string, answer string, hop_type string, positive_tiles array<struct<page_slug:string,tile_id:string>>, hard_negative_tiles array<struct<page_slug:string,tile_id:string>>"
HOTPOT = "id string, question string, answer string, type string, supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>"
CONTROLLER_LOG = "question_id string, step int, node_id string, action string, score double, state_before string, state_after string"
