"""Contracts of the tables, as Spark schemas."""

AUDIT_LOGS = "audit_id string, document_id string, user_id string, timestamp string, change_type string, before_state string, after_state string, metadata string"
#: The separate audit table has the same columns, is keyed by audit_id and has indexes by document and by user.
AUDIT = AUDIT_LOGS
DOCUMENTS = "document_id string, status string, uploaded_at string, updated_at string, document_type string, unified_confidence_score double"
USER_SESSIONS = "session_id string, user_id string, login timestamp, logout timestamp, ttl_expiry bigint"
FEEDBACK_LOOP = "feedback_id string, document_id string, user_id string, timestamp string, category string, payload string"
OCR_PAGE = "Blocks array<struct<BlockType:string,Text:string,Confidence:double,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>>>"
ENTITY_RAW = "Entities array<struct<Id:int,Text:string,Category:string,Type:string,Score:double,BeginOffset:int,EndOffset:int,Traits:array<struct<Name:string,Score:double>>,SNOMEDCTConcepts:array<struct<Description:string,Code:string,Score:double>>>>"
ENTITY_CATEGORISED = "categorized_entities map<string,array<struct<text:string,snomed_code:string,description:string,confidence:double,source:string>>>, unified_confidence_score double, processing_time_seconds double"
PROFILE = "tier1_pages array<struct<latency_seconds:double>>, tier2_pages array<struct<latency_seconds:double>>, tier3_regions array<struct<latency_seconds:double>>, track_a_seconds double, track_b_seconds double, pipeline_total_seconds double"
