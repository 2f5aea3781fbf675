"""Constants of page analytics, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    max_tile_height: int = 2048
    min_tile_height: int = 80
    max_page_height: int = 10 * 2048
    min_overlap_ratio: float = 0.15
    containment_tolerance: float = 1.0
    row_tolerance: float = 20.0
    max_linked_tiles: int = 3
    max_crawled_pages: int = 3
    max_tiles_per_unit: int = 25
    semantic_threshold: float = 0.2
    max_semantic_neighbours: int = 3
    n_hard_negatives: int = 2
    band_height: int = 1024
    band_width: int = 1024
    chunk_chars: int = 400
    preview_chars: int = 200
    patch_px: int = 28
    budget: int = 5
    seed_top_k: int = 3
    open_threshold: float = 0.05
    activate_threshold: float = 0.05
    temperature: float = 0.05
    image_scale: float = 0.5


CONFIG = Config()

# Element tags, noise and stop words that results depend on.
NOISE_SELECTORS = (
    "nav", "footer", "header",
    "#mw-navigation", "#mw-panel", ".vector-header", ".vector-menu",
    ".navbox", ".mw-editsection", "#siteNotice", ".ambox", ".noprint",
    "script", "style", "noscript",
)
NOISE_TAGS = tuple(s for s in NOISE_SELECTORS if s[0] not in "#.")
HEADING_TAGS = ("h1", "h2", "h3", "h4")
ELEMENT_TAGS = ("h1", "h2", "h3", "h4", "p", "table", "figure", "img", "ul", "ol", "blockquote", "pre")
STOP_WORDS = tuple("a an the of to in and is are was were be been being for on with as by at from this that".split())
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
STATES = ("inactive", "active", "opened", "pruned")
