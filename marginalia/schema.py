"""Schemas of the tables that the operators pass on."""

from __future__ import annotations

PARAGRAPHS = "doc_id bigint, p_id string, idx int, text string, style_id string, style_name string, is_heading boolean, heading_level int"
RANGES = "array<struct<start:int,end:int>>"

#: Columns of findings. seq orders the findings of a rule within a document.
FINDING = ("doc_id", "rule", "category", "severity", "p_idx", "location", "original", "detail", "ranges", "seq")

# Labels of the categories and the order of severities.
CATEGORIES = {
    "format": "書式・提出形式",
    "writing": "誤字脱字・文章表現",
    "logic": "構成・論理展開",
    "figures": "図表",
    "citations": "引用・参考文献",
    "ethics": "研究倫理・個人情報",
    "completion": "研究内容・妥当性",
}
SEVERITIES = ("important", "warning", "info")
