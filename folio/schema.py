"""Types, label sets and fixed limits of the data model. Offsets are Unicode code points, boxes 0..999."""

from __future__ import annotations

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
FLAG = "struct<kind:string,start:int,end:int,original:string,note:string>"
EDIT = "struct<start:int,end:int,new:string,kind:string,note:string>"
BLOCK = f"struct<label:string,box:{BOX},text:string,raw_text:string,flags:array<{FLAG}>>"
PAGE = f"struct<index:int,source:string,mode:string,width_px:int,height_px:int,rotation_applied:int,blocks:array<{BLOCK}>,raw:string,warnings:array<string>,seconds:double>"
DOCUMENT = f"source_path string, engine_id string, engine_revision string, app_version string, created string, pages array<{PAGE}>"

#: The labels that blocks may have, and the sets that rules name.
LABELS = ("title", "header", "text", "image", "figure", "image_caption", "table", "table_caption", "list", "formula", "page_number", "footer")
FURNITURE = ("page_number", "header", "footer")
NO_TEXT = ("image", "figure")
CAPTIONS = ("image_caption", "table_caption")
FIGURE_RUN = (*NO_TEXT, *CAPTIONS)
FLOW = ("text", "list")
SKIPPED = ("formula", *NO_TEXT)
HYPHEN_LABELS = (*FLOW, *CAPTIONS, "title")

PAGE_KEYS = ["doc_id", "page_index"]
BLOCK_KEYS = [*PAGE_KEYS, "block_no"]
