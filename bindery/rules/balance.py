"""Self-checks of assembled text: tags that don't close, and records that end inside a tag."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

_TAG = re.compile(r"<(/?)([A-Za-z][\w:]*)[^<>]*?(/?)>")
#: Tags that have no end.
EMPTY = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


def unbalanced(text: str) -> list[str]:
    """Each end without a beginning and each beginning without an end, in order of discovery."""
    open_, wrong = [], []
    for m in _TAG.finditer(text):
        end, name, alone = m[1], m[2].lower(), m[3]
        if alone or name in EMPTY:
            continue
        if not end:
            open_.append(name)
        elif name in open_:
            while open_[-1] != name:
                wrong.append(open_.pop())
            open_.pop()
        else:
            wrong.append("/" + name)
    return wrong + open_[::-1]


@pandas_udf(ArrayType(StringType()))
def unbalanced_tags(x: pd.Series) -> pd.Series:
    return x.map(unbalanced, na_action="ignore")


def findings(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts: pkg_id, file, text -> pkg_id, file, tag of each tag that doesn't match."""
    return texts.select("pkg_id", "file", F.explode(unbalanced_tags(text)).alias("tag"))


def cut_tags(recs: DataFrame) -> DataFrame:
    """recs: pkg_id, rec_no, bytes -> the records that end inside a tag."""
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    return recs.where(F.locate("<", F.reverse(text)) > 0).where((F.locate(">", F.reverse(text)) == 0) | (F.locate("<", F.reverse(text)) < F.locate(">", F.reverse(text)))).select("pkg_id", "rec_no")
