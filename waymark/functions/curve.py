"""A space-filling curve: places near each other mostly have near numbers, so files sorted by it can be skipped by ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Bits of either coordinate, and ranges that a box is taken apart into at most.
BITS, RANGES = 20, 32


def _step(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor((value - low) / (high - low) * (1 << BITS)))).cast("long")


def _spread(x: Column) -> Column:
    """The bits of a number with a gap after each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def place_key(lon: Column, lat: Column) -> Column:
    """The number of a place on a Z-shaped curve over the earth, of 2 * BITS bits; null without a place."""
    return _spread(_step(lon, -180.0, 180.0)).bitwiseOR(F.shiftleft(_spread(_step(lat, -90.0, 90.0)), 1))


def _cell(value: float, low: float, high: float) -> int:
    return max(0, min((1 << BITS) - 1, int((value - low) // ((high - low) / (1 << BITS)))))


def box_ranges(box: tuple[float, float, float, float], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of ``place_key``, ``most`` at most, that together hold all places of a box (west, south, east, north), and as little else as so few can.

    The square of all places is split into four, again and again, where it is
    partly in the box; the coarsest cut that would need too many ranges is not
    made.
    """
    west, south, east, north = box
    if west > east or south > north:
        return []
    # a step to either side, so that rounding leaves nothing out
    x0, x1 = max(0, _cell(west, -180.0, 180.0) - 1), min((1 << BITS) - 1, _cell(east, -180.0, 180.0) + 1)
    y0, y1 = max(0, _cell(south, -90.0, 90.0) - 1), min((1 << BITS) - 1, _cell(north, -90.0, 90.0) + 1)

    def joined(squares: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for a, b in sorted((key, key + (1 << 2 * level) - 1) for key, level, _, _ in squares):
            if out and out[-1][1] + 1 == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    whole: list[tuple[int, int, int, int]] = []
    part = [(0, BITS, 0, 0)]  # first number, log of the width, corner
    best = joined(part)
    while part:
        level, next_part = part[0][1] - 1, []
        for key, _, x, y in part:
            for i in range(4):
                cx, cy, width = x + ((i & 1) << level), y + ((i >> 1) << level), 1 << level
                if cx > x1 or cx + width - 1 < x0 or cy > y1 or cy + width - 1 < y0:
                    continue
                square = (key + (i << 2 * level), level, cx, cy)
                (whole if x0 <= cx and cx + width - 1 <= x1 and y0 <= cy and cy + width - 1 <= y1 else next_part).append(square)
        found = joined(whole + next_part)
        if len(found) > most:
            break
        best, part = found, next_part if level else []
    return best


def in_ranges(key: Column, box: tuple[float, float, float, float], most: int = RANGES) -> Column:
    """Whether a key is in the ranges of a box: plain comparisons, which reach the files' statistics."""
    return reduce(lambda a, b: a | b, [key.between(a, b) for a, b in box_ranges(box, most)], F.lit(False))
