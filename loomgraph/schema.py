"""Ontology, record schemas and display constants."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

# The ontology's names, display colours and default thresholds.
ENTITY_TYPES = ["person", "organization", "project", "topic", "meeting"]
CLAIM_TYPES = ["works_at", "reports_to", "works_on", "part_of", "discussed_in", "decided", "communicated_with", "attended", "assigned_to", "mentioned_in", "contradicts", "supersedes"]
NODE_COLOURS = {"person": "#4FC3F7", "organization": "#FF8A65", "project": "#81C784", "topic": "#CE93D8", "meeting": "#FFD54F"}
EDGE_COLOURS = {
    "WORKS_AT": "#90A4AE", "REPORTS_TO": "#F44336", "WORKS_ON": "#4CAF50", "PART_OF": "#FF9800", "DISCUSSED_IN": "#9C27B0", "DECIDED": "#E91E63",
    "COMMUNICATED_WITH": "#2196F3", "ATTENDED": "#FFC107", "ASSIGNED_TO": "#009688", "MENTIONED_IN": "#607D8B", "CONTRADICTS": "#F44336", "SUPERSEDES": "#795548",
}
OTHER_NODE, OTHER_EDGE = "#BDBDBD", "#999"
SCHEMA_VERSION, DEDUP_VERSION = "v1.0", "v1.0"
MIN_CONFIDENCE, FUZZY, DEFAULT_CONFIDENCE = 0.5, 0.90, 0.7


def _fields(**kinds) -> StructType:
    return StructType([StructField(k, v) for k, v in kinds.items()])


S, D, L, B, T = StringType(), DoubleType(), LongType(), BooleanType(), TimestampType()
MAIL_RAW = _fields(file=S, message=S)
ARTIFACT = _fields(id=S, message_id=S, file_path=S, sender=S, sender_name=S, recipients=ArrayType(S), cc=ArrayType(S), subject=S, date=T, body=S, body_hash=S, is_forward=B, is_reply=B)
ENTITY_ITEM = _fields(name=S, entity_type=S, aliases=ArrayType(S), properties=S)
CLAIM_ITEM = _fields(claim_type=S, subject=S, object=S, detail=S, excerpt=S, confidence=D)
EXTRACTION = _fields(artifact_id=S, message_id=S, file_path=S, sender=S, date=S, subject=S, extraction_version=S, model=S, extracted_at=S, entities=ArrayType(ENTITY_ITEM), claims=ArrayType(CLAIM_ITEM))
EVIDENCE = _fields(excerpt=S, confidence=D, artifact_id=S, date=S)
ENTITY = _fields(id=S, canonical_name=S, entity_type=S, aliases=ArrayType(S), mention_count=L, sources=ArrayType(S), properties=S)
CLAIM = _fields(id=S, claim_type=S, subject_id=S, subject_name=S, object_id=S, object_name=S, detail=S, evidence=ArrayType(EVIDENCE), confidence=D, mention_count=L)
