"""Explicit schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

METADATA = "struct<university:string,degree:string,subject:string,doc_type:string,taken_in:string,academic_year:string,professor:string>"
MANIFEST = f"user_id string, doc_id string, source string, rel_path string, size_bytes bigint, metadata {METADATA}, registered_at timestamp, updated_at timestamp"
STAGES = "user_id string, doc_id string, stage string, version string, output string, completed_at timestamp"
RAW_PAGES = "number int, width double, height double, text string, title string, image_count int"
PAGES = "user_id string, doc_id string, number int, width double, height double, title string, text string, char_count int, language string, image_count int, mostly_image boolean, thumbnail string"
THUMBNAILS = "user_id string, doc_id string, number int, png binary"
EXTRACTED = "user_id string, doc_id string, source string, rel_path string, extractor string, languages array<string>"
CHUNKS = "user_id string, doc_id string, chunk_id string, chunk_index int, page int, part int, title string, header string, text string, word_count int, language string"
REMOVED_LINES = "user_id string, doc_id string, text string, n_removed bigint"
CHUNKED = "user_id string, doc_id string, source string, rel_path string, chunker string"
POINTS = f"user_id string, doc_id string, source string, rel_path string, chunk_id string, chunk_index int, page int, part int, title string, header string, text string, language string, metadata {METADATA}, embedding array<float>"
FILES = "user_id string, source string, rel_path string, path string, size_bytes bigint, doc_id string"
