"""Outer contours of masks as polygons: the one operator that follows pixels in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Steps to the eight neighbours, clockwise from the left in image rows and columns.
AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def trace(cells: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The outer border of each 8-connected part, clockwise from its first cell in row order, with
    cells inside a straight run left out."""
    left, out = set(cells), []
    while left:
        part, todo = set(), [next(iter(left))]
        while todo:
            at = todo.pop()
            if at in left:
                left.discard(at)
                part.add(at)
                todo += [(at[0] + a, at[1] + b) for a, b in AROUND if (at[0] + a, at[1] + b) in left]
        out.append(_straight(_border(part)))
    return sorted(out)


def _border(part: set[tuple[int, int]]) -> list[tuple[int, int]]:
    first = min(part)
    walk, at, back = [first], first, 0
    seen = set()
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            near = (at[0] + AROUND[d][0], at[1] + AROUND[d][1])
            if near in part:
                break
        else:
            return walk
        if (at, d) in seen:
            return walk[:-1] if len(walk) > 1 and walk[-1] == first else walk
        seen.add((at, d))
        at, back = near, (d + 5) % 8 if d % 2 else (d + 6) % 8
        walk.append(at)


def _straight(walk: list[tuple[int, int]]) -> list[tuple[int, int]]:
    n = len(walk)
    if n < 3:
        return walk
    turn = lambda a, b, c: (b[0] - a[0], b[1] - a[1]) != (c[0] - b[0], c[1] - b[1])
    return [walk[i] for i in range(n) if turn(walk[i - 1], walk[i], walk[(i + 1) % n])]


def mask_polygons(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., mask_polygons): the outer contours of each mask as flat x, y lists.

    Contours of fewer than three corners are left out, and a mask without any other.  A group is
    one mask in one frame, so it is as large as a frame at most.
    """
    polygons = StructField("mask_polygons", ArrayType(ArrayType(DoubleType())))
    schema = StructType([*[pixels.schema[k] for k in keys], polygons])
    types = {f.name: to_arrow_type(f.dataType) for f in schema.fields}

    def run(table):
        import pyarrow as pa

        cells = set(zip(table.column("row").to_pylist(), table.column("col").to_pylist(), strict=True))
        lines = [c for c in trace(cells) if len(c) >= 3]
        flat = [[float(v) for r, c in line for v in (c, r)] for line in lines]
        rows = {k: [table.column(k)[0].as_py()] if lines else [] for k in keys}
        rows["mask_polygons"] = [flat] if lines else []
        return pa.table({n: pa.array(rows[n], t) for n, t in types.items()})

    return pixels.select(*keys, "row", "col").groupBy(*keys).applyInArrow(run, schema)
