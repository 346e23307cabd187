"""Schemas of fragments and findings."""

from __future__ import annotations

FRAGMENT = "fragment_id string, raw string, start_line int, attributes map<string,string>"

MATCH = "struct<full:string,value:string,fingerprint:string,captures:map<string,string>,line:string,context:string>"
LOCATION = "struct<path:string,start_line:int,end_line:int,start_column:int,end_column:int>"
ANALYSIS = "struct<status:string,status_reason:string,status_metadata:string,reason:string,severity:string,identity:string,capabilities:array<string>,metadata:string>"
COMPONENT = f"struct<rule_id:string,rule_hash:string,optional:boolean,match:{MATCH},location:{LOCATION},encodings:array<string>,decode_depth:int>"
FINDING = (
    "fragment_id string, rule_id string, rule_hash string, description string, confidence string, encodings array<string>, decode_depth int, "
    f"match {MATCH}, attributes map<string,string>, location {LOCATION}, component_sets array<struct<components:array<{COMPONENT}>>>, component_sets_truncated boolean, tags array<string>"
)
