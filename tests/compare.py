"""Order-free comparison of two result tables."""

import pandas as pd


def rows(df: pd.DataFrame):
    def cell(value):
        if value is None or (not isinstance(value, (list, tuple)) and pd.isna(value)):
            return ""
        return repr(float(value)) if isinstance(value, float) else str(value)

    columns = sorted(df.columns)
    return sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False, name=None))


def assert_same(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(expected.columns)
    left, right = rows(found), rows(expected)
    extra = sorted(set(left) - set(right))[:3]
    missing = sorted(set(right) - set(left))[:3]
    assert left == right, f"only found {extra}, only expected {missing}"
