"""Arrow wrappers of the kernels, for what built-in expressions cannot say."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import kernels

DIFF = T.ArrayType(T.StructType([T.StructField("code", T.IntegerType()), T.StructField("text", T.StringType())]))
SIZES = T.StructType([T.StructField("removed", T.IntegerType()), T.StructField("added", T.IntegerType())])


def _both(f, none=None):
    return lambda a, b: pd.Series([none if x is None or y is None else f(list(x), list(y)) for x, y in zip(a, b)])


lcs_length = F.pandas_udf(lambda a, b: _both(kernels.lcs_length)(a, b).astype("Int32"), T.IntegerType())
fast_diff = F.pandas_udf(_both(lambda x, y: [{"code": c, "text": t} for c, t in kernels.fast_diff(x, y)]), DIFF)
similar = F.pandas_udf(
    lambda a, b, one, two: pd.Series([x is not None and y is not None and kernels.similar(list(x), list(y), p, q) for x, y, p, q in zip(a, b, one, two)], dtype=bool), T.BooleanType()
)
copy_edit = F.pandas_udf(
    lambda a, b, ts, us: pd.Series([None if x is None or y is None else kernels.copy_edit(x, y, list(t), list(u)) for x, y, t, u in zip(a, b, ts, us)], dtype=object), T.StringType()
)


@F.pandas_udf(SIZES)
def change_sizes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    got = [(None, None) if x is None or y is None else kernels.change_sizes(list(x), list(y)) for x, y in zip(a, b)]
    return pd.DataFrame(got, columns=["removed", "added"]).astype("Int32")


MARKED = T.StructType([T.StructField("old", T.StringType()), T.StructField("new", T.StringType())])


@F.pandas_udf(MARKED)
def mark_changes(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    got = [(None, None) if x is None or y is None else kernels.mark_changes(list(x), list(y)) for x, y in zip(a, b)]
    return pd.DataFrame(got, columns=["old", "new"])


LINE_DIFF = T.ArrayType(T.StructType([T.StructField(n, T.StringType() if n == "text" else T.IntegerType()) for n in ("code", "text", "p1", "s1", "p2", "s2")]))
#: The diff of two arrays of lines, in order, with the places of each line.
line_diff = F.pandas_udf(_both(lambda x, y: [dict(zip(("code", "text", "p1", "s1", "p2", "s2"), r)) for r in kernels.diff_rows(x, y)]), LINE_DIFF)
