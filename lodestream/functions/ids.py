"""Ids that arrive with blanks, tabs or quotes around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters stripped from both ends of an id.
ID_PADDING = ' \t"'


def clean_id(col: str | Column) -> Column:
    """The id without padding; null where it means "no id" (null, empty, the word ``None``)."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.btrim(c, F.lit(ID_PADDING))
    return F.when((bare != "") & (bare != "None"), bare)


def clean_id_sql(col: str) -> str:
    """The same as DuckDB SQL."""
    bare = f"trim({col}, chr(32) || chr(9) || chr(34))"
    return f"case when {bare} not in ('', 'None') then {bare} end"
