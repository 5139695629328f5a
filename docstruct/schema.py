"""Schemas and settings. Every operator takes and returns DataFrames of these columns; order is always a column."""

from __future__ import annotations

from dataclasses import dataclass

#: A positioned piece of text. ``seq`` is its place in reading order within the document.
SPANS = "doc_id bigint, seq int, text string, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, font_size double, font_name string, font_flags int"
OUTLINE = "title string, outline array<struct<level:string,text:string,page:int>>"
ERROR = "struct<type:string,message:string,details:string,error_code:string,timestamp:double,timeout_limit:int>"
COLLECTION = "challenge_info struct<challenge_id:string,test_case_name:string,description:string>, documents array<struct<filename:string,title:string>>, persona struct<role:string>, job_to_be_done struct<task:string>"
SECTIONS = "collection string, document string, seq bigint, section_title string, content string, page_number int, median_font_size double"


@dataclass(frozen=True)
class Settings:
    """The values that operators read."""

    max_pages: int = 50
    min_text_length: int = 3
    size_tolerance: float = 0.1
    line_tolerance: float = 2.0
    gap: float = 10.0
    default_size: float = 12.0
    page_width: float = 612.0
    page_height: float = 792.0
    confidence: float = 0.5
    header_factor: float = 1.2
    top_sections: int = 10
    max_sentences: int = 100
    top_sentences: int = 10
    section_chars: int = 5000
    query_chars: int = 1000
    dim: int = 384


SETTINGS = Settings()
