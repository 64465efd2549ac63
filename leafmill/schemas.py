"""Schemas of the tables the engine works on."""

from __future__ import annotations

SPANS = "doc_id string, page int, span_seq int, x double, y double, end_x double, font_size double, font string, text string"
PAGES = "doc_id string, page int, media_box array<double>, rotate int, n_spans int, error string"
DRAW_OPS = "doc_id string, page int, op_seq int, op string, args array<double>, text string, width double, height double"
HITS = "doc_id string, page int, hit_no int, text string, rect struct<x:double,y:double,width:double,height:double>, font_size double"
COLUMN = "struct<name:string,x:double>"
IMAGES = "doc_id string, page int, image_no int, width int, height int, matrix array<double>, opacity double, rgb binary, alpha binary"
