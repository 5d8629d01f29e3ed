"""Personal data in texts: spans and masking."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.arrow import arrow_function

# Kinds of personal data and their patterns, in order.
EMAIL, PHONE, STUDENT = "メールアドレス", "電話番号", "学籍番号候補"
_EMAIL = re.compile(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", re.ASCII)
_PHONE = re.compile(r"(?:0(?:[789]0)[0-9]{8}|0[0-9]{1,4}[-－][0-9]{1,4}[-－][0-9]{3,4})")
_STUDENT = re.compile(r"\b[A-Z]?\d{7,10}\b", re.ASCII)
_STUDENT_CONTEXT = re.compile(r"学籍(?:番号|No\.?|ID)|学生番号|student\s*(?:number|no\.?|id)", re.IGNORECASE)
_REACH = 16
#: What every hit holds; texts without it don't travel to Python.
_POSSIBLE = r"@|0[0-9]{1,4}[-－][0-9]|[0-9]{7}"

SPANS = "array<struct<type:string,start:int,end:int,value:string>>"


def spans_of(text: str) -> list[tuple[str, int, int, str]]:
    """All hits on the text as it stands: by kind, then by place."""
    out = [(kind, m.start(), m.end(), m.group()) for kind, pattern in ((EMAIL, _EMAIL), (PHONE, _PHONE)) for m in pattern.finditer(text)]
    for m in _STUDENT.finditer(text):
        if _STUDENT_CONTEXT.search(text[max(0, m.start() - _REACH) : m.end() + _REACH]):
            out.append((STUDENT, m.start(), m.end(), m.group()))
    return out


def masked_text(text: str) -> str:
    """Hits replaced by their kind; of overlapping ones the first, then the longest."""
    out, upto = [], 0
    for kind, start, end, _ in sorted(spans_of(text), key=lambda x: (x[1], -x[2])):
        if start >= upto:
            out += [text[upto:start], f"[{kind}]"]
            upto = end
    return "".join(out) + text[upto:]


@arrow_function(SPANS)
def _spans(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [dict(zip(("type", "start", "end", "value"), s)) for s in spans_of(x or "")])


@arrow_function("string")
def _masked(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else masked_text(x))


def possible(text: Column) -> Column:
    """A test in the JVM that every text with a hit passes."""
    return text.rlike(_POSSIBLE)


def pii_spans(text: Column) -> Column:
    """All hits; none in a null text."""
    return _spans(F.when(possible(text), text))


def masked(text: Column) -> Column:
    return F.coalesce(_masked(F.when(possible(text), text)), text)
