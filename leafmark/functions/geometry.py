"""Column functions over word boxes: visual lines, their text, and page layout features.

A word is struct<text,x0,x1,top,bottom,size>; a text line struct<top,words>.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmark.functions.rounding import round_half_even

WORD_TYPE = "struct<text:string,x0:double,x1:double,top:double,bottom:double,size:double>"
LINE_TYPE = f"struct<top:double,words:array<{WORD_TYPE}>>"

# Points within which lines are one, and gaps over font size that part words.
LINE_TOLERANCE, WORD_GAP, WIDE_GAP = 2.0, 0.1, 3.0

PAGE_FEATURES = ["line_count", "font_size_max_ratio", "line_density", "left_margin_mean", "left_margin_var", "first_text_vpos_fraction", "last_text_vpos_fraction"]


def _by(items: Column, *fields: str) -> Column:
    """Sort structs by fields, ties by place."""
    keyed = F.transform(items, lambda x, i: F.struct(*[_field(x, f).alias(f"k{n}") for n, f in enumerate(fields)], i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def _field(x: Column, path: str) -> Column:
    for part in path.split("."):
        x = F.get(x, F.lit(int(part))) if part.isdigit() else x[part]
    return x


def first_lines(tops: list[float | None]) -> list[int]:
    """Places of the lines that begin a group, in ascending ``tops`` (null or NaN ones last):
    from each the next is the first that lies more than the tolerance below it, found by search."""
    valid = next((i for i in range(len(tops) - 1, -1, -1) if tops[i] is not None and tops[i] == tops[i]), -1) + 1
    out, at = [], 0
    while at < valid:
        out.append(at)
        top = tops[at]
        at = bisect_right(tops, LINE_TOLERANCE, at + 1, valid, key=lambda t: t - top)  # noqa: B023
    return out + list(range(valid, len(tops)))


def _group_starts(tops: Column) -> Column:
    @F.pandas_udf("array<int>")
    def starts(batch: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else first_lines(list(t)) for t in batch], dtype=object)

    return starts(tops)


def visual_lines(text_lines: Column) -> Column:
    """array<array<word>>: lines within the tolerance of their group's first, words by x0.

    Groups are anchored at their first line, so the next group's place depends on this one's:
    the tops alone go to Arrow batches, and the groups are slices of the sorted lines, so a
    page of any number of lines takes time in proportion (but for sorting).
    """
    ordered = _by(text_lines, "top", "words.0.x0")
    starts = _group_starts(F.transform(ordered, lambda line: line["top"]))
    places = F.transform(starts, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    bound = F.struct(ordered.alias("l"), places.alias("p"), starts.alias("s"))

    def sliced(x: Column) -> Column:
        after = lambda p: F.coalesce(F.get(x["s"], p["i"] + 1), F.size(x["l"]))
        return F.transform(x["p"], lambda p: _by(F.flatten(F.transform(F.slice(x["l"], p["s"] + 1, after(p) - p["s"]), lambda line: line["words"])), "x0"))

    return _bound(bound, sliced)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is made once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def line_text(words: Column) -> Column:
    """Words joined by what their gaps call for: nothing, a space, or two for a wide gap."""
    return _bound(_by(words, "x0"), _join)


def _join(ordered: Column) -> Column:
    def joined(w: Column, i: Column) -> Column:
        before = F.get(ordered, i - 1)
        size = (before["size"] + w["size"]) / 2
        ratio = (w["x0"] - before["x1"]) / F.when(size == 0, F.lit(1.0)).otherwise(size)
        gap = F.when(i == 0, "").when(ratio >= WIDE_GAP, "  ").when(ratio >= WORD_GAP, " ").otherwise("")
        return F.concat(gap, w["text"])

    return F.array_join(F.transform(ordered, joined), "")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def _modal(values: Column) -> Column:
    """The commonest value; of equals, the first met."""
    seen = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), F.array_position(values, v).alias("at"), v.alias("v")))
    return F.get(F.array_sort(seen), F.lit(0))["v"]


def page_features(lines: str, height: str, width: str) -> Column:
    """struct of the seven page features and max_font_size, modal_font_size.

    ``lines``: visual lines. A page without lines, height or width is all zeros.
    Sizes are rounded to one place, ties to even, before the mode is taken.
    """
    ln, h, w = F.col(lines), F.col(height), F.col(width)
    sizes = F.transform(ln, lambda x: _mean(F.transform(x, lambda y: y["size"])))
    lefts = F.transform(ln, lambda x: F.array_min(F.transform(x, lambda y: y["x0"])) / w)
    n = F.size(ln)
    # Each step names what the one before has made: inside a lambda an expression would be
    # made again for each line.
    mean = lambda x: F.struct(_mean(x).alias("mean"), x.alias("x"))
    squares = lambda m: F.aggregate(m["x"], F.lit(0.0), lambda a, x: a + (x - m["mean"]) * (x - m["mean"]))
    margins = _bound(_bound(lefts, mean), lambda m: F.struct(m["mean"].alias("mean"), squares(m).alias("squares")))
    modal = lambda x: _bound(F.transform(x, lambda s: round_half_even(s, 1)), _modal)
    fonts = _bound(sizes, lambda x: F.struct(F.array_max(x).alias("top"), modal(x).alias("modal")))

    def made(b: Column) -> dict[str, Column]:
        top, modal, mean = b["fonts"]["top"], b["fonts"]["modal"], b["margins"]["mean"]
        return {
            "line_count": n.cast("double"),
            "font_size_max_ratio": F.when(modal != 0, top / modal).otherwise(F.lit(1.0)),
            "line_density": n / h,
            "left_margin_mean": mean,
            "left_margin_var": F.when(n > 1, b["margins"]["squares"] / (n - 1)).otherwise(F.lit(0.0)),
            "first_text_vpos_fraction": F.array_min(F.transform(ln, lambda x: F.array_min(F.transform(x, lambda y: y["top"])))) / h,
            "last_text_vpos_fraction": F.array_max(F.transform(ln, lambda x: F.array_max(F.transform(x, lambda y: y["bottom"])))) / h,
            "max_font_size": top,
            "modal_font_size": modal,
        }

    empty = (n <= 0) | (F.coalesce(h, F.lit(0.0)) == 0) | (F.coalesce(w, F.lit(0.0)) == 0)
    zeros = F.struct(*[F.lit(0.0).alias(k) for k in [*PAGE_FEATURES, "max_font_size", "modal_font_size"]])
    full = _bound(F.struct(fonts.alias("fonts"), margins.alias("margins")), lambda b: F.struct(*[v.alias(k) for k, v in made(b).items()]))
    return F.when(empty, zeros).otherwise(full)
