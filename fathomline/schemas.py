"""Schemas of the engine's tables; declared, never inferred."""

from __future__ import annotations

SUBSET = "struct<start:bigint,end:bigint>"
LEDGER = "filepath string, hash string, meta array<string>"
SOURCES = "root string, meta array<string>"
RULES = "extension string, ord int, rule_type string, value string"
CHUNKS = f"filepath string, meta array<string>, subset {SUBSET}, chunk string"
VECTORS = f"id bigint, filepath string, meta array<string>, subset {SUBSET}, block bigint, data array<float>"
EDGES = "layer int, src bigint, dst bigint, dist double"
QUERIES = "at bigint, text string"
REQUEST = "message_type string, payload struct<k:bigint,query:string,filters:array<string>,filepath:string>"
