"""The physical plan of a frame as text."""

import io
from contextlib import redirect_stdout


def plan_of(df, mode: str = "formatted") -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
