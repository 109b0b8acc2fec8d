import math

import pandas as pd


def rows(df):
    """Rows as sorted tuples of strings, floats to nine digits, columns by name."""
    frame = df.toPandas() if hasattr(df, "toPandas") else df

    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, float):
            return f"{v:.7g}"
        return str(v)

    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))
