"""Order-free comparison of rows of two engines."""

import math

import numpy as np


def plain(v):
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, float | np.floating):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, list | tuple | np.ndarray):
        return [plain(x) for x in v]
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)
