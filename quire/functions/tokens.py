"""Classes of token texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sum of money or a plain number: sign and $ once each in either order, grouped or plain digits, loose parentheses, trailing minus.
NUMERIC = r"^\(?(\$-?|-\$?)?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)?(\.[0-9]*)?\)?-?$"
_DATE = r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"
#: A date of three numbers, or two such dates joined by a hyphen.
DATE = rf"^\(?{_DATE}(-{_DATE})?\)?$"


def _one_line(text: Column) -> Column:
    # Java's $ also matches before a last line break
    return ~text.contains("\n")


def is_numeric_token(text: Column) -> Column:
    return text.rlike(NUMERIC) & text.rlike("[0-9]") & _one_line(text)


def is_date_token(text: Column) -> Column:
    return text.rlike(DATE) & _one_line(text)
