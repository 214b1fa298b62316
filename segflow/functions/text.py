"""Cleaning and parsing of text columns."""

from __future__ import annotations

import html
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits, words and answers as they occur in the forms.
DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"
YES, NO = ("हाँ", "हां", "yes", "true"), ("नहीं", "no", "false")
NOT_APPLICABLE = ("लागू नहीं", "na", "n/a")
UNDERSTANDS, SAYS, SAYS_ONLY = "केवल समझता/समझती है", "समझता/समझती है और कहता/कहती है", "कहता/कहती है"
YEARS, MONTHS = ("year", "years", "yr", "yrs"), ("month", "months", "mo", "mos")
VTC_LABELS = {"FEM": "adult_female", "MAL": "adult_male", "KCHI": "key_child", "OCH": "other_child"}


def map_literal(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normalize_label(label: Column, backend: str, child_label: str = "key_child") -> Column:
    """Class name of a segment label without outer blanks. ``vtc``: four codes, others in lower case; ``xgb``: child and noise are renamed."""
    label = F.trim(label)
    if backend == "vtc":
        return F.coalesce(map_literal(VTC_LABELS)[label], F.lower(label))
    if backend == "xgb":
        return F.when(label == "child", child_label).when(label == "noise", "background").otherwise(label)
    raise ValueError(f"unknown backend {backend!r}")


def normalize_vtc_label(label: Column) -> Column:
    """Class name of a code in any case, null for unknown ones."""
    return map_literal(VTC_LABELS)[F.upper(F.trim(label))]


def normalize_text(text: Column, wide: bool = False) -> Column:
    """Null as empty, Devanagari digits as ASCII, white space (``wide``: of all scripts) collapsed and trimmed."""
    digits = F.translate(F.coalesce(text, F.lit("")), DEVANAGARI_DIGITS + "\u00a0", ASCII_DIGITS + " ")
    return F.trim(F.regexp_replace(digits, r"(?U)\s+" if wide else r"\s+", " "))


#: Texts that a worker holds as Python strings at once.
HELD = 256


@lru_cache
def unicode_form(form: str = "NFKC", unescape: bool = True):
    """An Arrow UDF for what Spark has no function for: HTML entities and Unicode normal forms. One object for each form, so that equal calls in a query are one pass.

    Batches stay Arrow; only HELD texts of one are Python strings at a time.
    """

    def fix(texts: pa.Array) -> pa.Array:
        done = [pa.array([], pa.string())]
        for at in range(0, len(texts), HELD):
            part = texts.slice(at, HELD).to_pylist()
            done.append(pa.array([t if t is None else unicodedata.normalize(form, html.unescape(t) if unescape else t) for t in part], pa.string()))
        return pa.concat_arrays(done)

    return F.arrow_udf(fix, "string")


def unicode_fixed(text: Column, form: str = "NFKC", unescape: bool = True) -> Column:
    """``unicode_form`` of a text; only texts with an ``&`` that may begin an entity or a character beyond ASCII are sent to Python."""
    pattern = "[&\\x{80}-\\x{10FFFF}]" if unescape else "[\\x{80}-\\x{10FFFF}]"
    return F.coalesce(unicode_form(form, unescape)(F.when(text.rlike(pattern), text)), text)


def normalize_full(text: Column, form: str = "NFKC") -> Column:
    """``normalize_text`` after entities and the Unicode form; ``NFC`` leaves digits alone.

    Only texts with an ``&`` or a character beyond ASCII are sent to Python.
    """
    text = F.coalesce(text, F.lit(""))
    fixed = unicode_fixed(text, form)
    return normalize_text(fixed, wide=True) if form == "NFKC" else F.trim(F.regexp_replace(fixed, "[\\s\u00a0]+", " "))


def parse_yes_no(text: Column) -> Column:
    word = F.lower(normalize_full(text))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def parse_percent(text: Column) -> Column:
    """A number, the middle of ``a से b``, or null for blanks and words that say there is none."""
    word = F.lower(normalize_full(text))
    low, high = (_number(word, r"(\d+(?:\.\d+)?)\s*से\s*(\d+(?:\.\d+)?)", g) for g in (1, 2))
    return F.when((word == "") | word.isin(*NOT_APPLICABLE), None).when(high.isNotNull(), (low + high) / 2).otherwise(_number(word, r"(\d+(?:\.\d+)?)"))


def parse_dates(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")) -> Column:
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def parse_timestamps(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm")) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_completed_months(text: Column) -> Column:
    """Whole months from a number of years, with those of months if there are any, or the first number."""
    word = F.lower(normalize_full(text))
    before = lambda units: _number(word, rf"(\d+(?:\.\d+)?)\s*(?:{'|'.join(units)})")
    years, months, plain = before(YEARS), before(MONTHS), _number(word, r"(\d+(?:\.\d+)?)")
    return F.when(years.isNotNull(), F.floor(years * 12 + F.coalesce(months, F.lit(0.0)))).otherwise(F.floor(plain)).cast("int")


def normalize_phone(text: Column) -> Column:
    return F.regexp_replace(normalize_full(text), " ", "")


def normalize_email(text: Column) -> Column:
    return F.lower(normalize_full(text))


def score_response(response: Column, form: int) -> Column:
    """(understand, produce, unknown) of an answer. Form 1 measures both, form 2 production alone."""
    word = normalize_full(response)
    null = F.lit(None).cast("int")
    if form == 1:
        understand = F.when(word == "", 0).when(word.isin(UNDERSTANDS, SAYS), 1)
        produce = F.when(word.isin("", UNDERSTANDS), 0).when(word == SAYS, 1)
    elif form == 2:
        understand, produce = null, F.when(word == "", 0).when(word == SAYS_ONLY, 1)
    else:
        raise ValueError("form is 1 or 2")
    return F.struct(understand.alias("understand"), produce.alias("produce"), produce.isNull().alias("unknown"))


def parse_item_id(text: Column, position: Column) -> Column:
    """The digits of an item id as a number, else the row's position."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("int"), position.cast("int"))


def membership_flags(text: Column, ranges: tuple[str, ...] = ("8_18", "19_36")) -> list[Column]:
    return [F.coalesce(F.contains(text, F.lit(r)), F.lit(False)).cast("int").alias(f"in_{r}") for r in ranges]
