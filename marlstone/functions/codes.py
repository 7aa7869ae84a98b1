"""Company codes in the ways they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width digits, stop, colon and letters that occur in exchange marks, and their plain forms.
WIDE, PLAIN = "０１２３４５６７８９．：ＳＨＺＢＪｓｈｚｂｊ", "0123456789.:SHZBJSHZBJ"
_SPELLED = r"^(?:(?:SH|SZ|BJ)[:.]?)?([0-9]{1,6})(?:[.]0+)?(?:[.:]?(?:SH|SZ|BJ))?$"


def squeezed(code: Column) -> Column:
    """Upper case, no white space of any kind, plain digits."""
    return F.upper(F.translate(F.regexp_replace(code, r"(?U)[\s​﻿]+", ""), WIDE, PLAIN))


def is_blank(code: Column) -> Column:
    return squeezed(code) == ""


def denoted_code(code: Column) -> Column:
    """The six-digit code a spelling stands for.

    Exchange prefixes and suffixes, white space, full-width signs, a trailing
    ``.0`` and lost leading zeros are undone. A spelling that stands for no
    six-digit code comes back squeezed, so it still is a key of its own. Null
    stays null and blank becomes the empty string.
    """
    plain = squeezed(code)
    digits = F.regexp_extract(plain, _SPELLED, 1)
    return F.when(digits == "", plain).otherwise(F.lpad(digits, 6, "0"))


#: The same for DuckDB; {c} is the column.
DENOTED_SQL = (
    "(CASE WHEN regexp_extract({p}, '^(?:(?:SH|SZ|BJ)[:.]?)?([0-9]{{1,6}})(?:[.]0+)?(?:[.:]?(?:SH|SZ|BJ))?$', 1) = '' THEN {p} "
    "ELSE lpad(regexp_extract({p}, '^(?:(?:SH|SZ|BJ)[:.]?)?([0-9]{{1,6}})(?:[.]0+)?(?:[.:]?(?:SH|SZ|BJ))?$', 1), 6, '0') END)"
)


def denoted_sql(column: str) -> str:
    squeezed_sql = f"upper(translate(regexp_replace({column}, '[\\s　 ]+', '', 'g'), '{WIDE}', '{PLAIN}'))"
    return DENOTED_SQL.format(p=squeezed_sql)


def family_key(family: Column) -> Column:
    """Case and all signs but letters and digits ignored."""
    return F.regexp_replace(F.upper(family), r"[^\p{L}\p{N}]+", "")
