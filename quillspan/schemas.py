"""Schemas of the engine's contracts. Offsets are half-open code points of NFC text."""

from __future__ import annotations

SPAN = "struct<start:int,end:int,type:string,value:string,confidence:double,decision:string,source:string,notes:array<string>>"
SPANS = f"array<{SPAN}>"
DOCUMENT = f"id string, text string, metadata map<string,string>, spans {SPANS}"
SPAN_MAP = "map<string,array<array<int>>>"
OPF_RECORD = f"text string, spans {SPAN_MAP}, info struct<id:string,source:string>, example_id string"
RAW_CORPUS = """pii_types array<string>, records array<struct<id:string,input:struct<metadata:struct<source_type:string,language:string>>,
positive_sample:struct<text:string,labels:array<struct<start:int,end:int,type:string,value:string,confidence:double>>>,
hard_negatives:array<struct<text:string,note:string>>>>"""
TEACHER_RAW = "id string, prompt struct<span_value:string,context:string,context_type:string,ambiguity_group:string,candidate_labels:array<string>>, output_text string, status string, error string, elapsed_seconds double, retry_count int"
TAXONOMY = "name string, note string, data_classification string, category_type string"
