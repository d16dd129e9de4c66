"""Schemas of the engine's relations."""

from __future__ import annotations

NORMALIZED = "array<struct<db_name:string,db_id:string,db_match:string,db_pred_id:string,db_pred_match:string>>"
PASSAGE = "struct<id:string,type:string,text:array<string>,offsets:array<array<int>>>"
ENTITY = f"struct<id:string,type:string,text:array<string>,offsets:array<array<int>>,normalized:{NORMALIZED}>"
PAGE = f"id string, document_id string, passages array<{PASSAGE}>, entities array<{ENTITY}>"
ANNOTATION = "doc_id string, semantic_group string, start_span int, end_span int, mention string, gold_concept_code string, semantic_rel string, gold_concept_name string, mention_id string"
PREDICTION = "mention string, doc_id string, mention_id string, start_span int, end_span int, semantic_group string, gold_concept_code string, gold_concept_name string, pred_concept_name string, pred_concept_code string, score double, beam_score double, rank int"
TERMINOLOGY = "code string, title string, entity string, sem_name string, category string, grp string, is_main boolean, lang string, ambiguous_level int"
SEMANTIC_GROUP = "CATEGORY string, GROUP string, SEM_CODE string, SEM_NAME string"
CORRECTION = "code string, code_new string"
JUDGED = "raw string, label string"
