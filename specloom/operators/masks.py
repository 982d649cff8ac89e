"""Region masks as column segments, and their assignment to plate cells.

A mask is kept as rows ``(keys, c, r0, r1)``: the set rows r0..r1 of column c.  Area,
box, erosion and overlap are arithmetic on segments, so no pixel table is built.

Components and erosion gather a mask into one row and work on many masks at once, as
flat arrays ``(mask, c, r0, r1)`` of a batch of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle

MIN_CONTAINMENT = 0.50
MARKER_LABEL, RIM_LABEL = 100, 200


#: Rows of a batch worked on at once.
MASKS_AT_ONCE = 1000


def _numbers(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.int64)


def _lengths(lists: pa.Array) -> np.ndarray:
    return _numbers(pc.fill_null(pc.list_value_length(lists), 0))


def _within(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, place in it) of every element of lists laid end to end."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _cut(counts: pa.Array, tall: np.ndarray) -> tuple[np.ndarray, ...]:
    """Column segments (list, c, r0, r1) of run lengths: running sums, cut at column borders."""
    lengths, n = _lengths(counts), _numbers(counts.flatten())
    of, place = _within(lengths)
    end = np.cumsum(n)
    stop = np.cumsum(lengths)
    before = np.concatenate([[0], end])[stop - lengths]
    fore = (place % 2 == 1) & (n > 0)
    of = of[fore]
    first, last, h = (end - n)[fore] - before[of], end[fore] - 1 - before[of], tall[of]
    run, place = _within(last // h - first // h + 1)
    c = first[run] // h[run] + place
    r0 = np.where(place == 0, first[run] % h[run], 0)
    r1 = np.where(c == last[run] // h[run], last[run] % h[run], h[run] - 1)
    return of[run], c, r0, r1


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def decode_rle(masks: DataFrame, keys: Sequence[str], counts: str) -> DataFrame:
    """Column segments of run-length encoded masks; ``masks`` also holds the height ``h``.

    Run lengths alternate from background.  A mask is one row, so its running sum needs no shuffle.
    """
    names = [*keys, "c", "r0", "r1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            of, *segment = _cut(some.column("__n"), _numbers(some.column("__h")))
            yield pa.RecordBatch.from_arrays([some.column(k).take(pa.array(of)) for k in keys] + [pa.array(x) for x in segment], names=names)

    rows = masks.select(*keys, F.col(counts).cast("array<bigint>").alias("__n"), F.col("h").cast("bigint").alias("__h"))
    return rows.mapInArrow(run, f"{_kinds(masks, keys)}, c bigint, r0 bigint, r1 bigint")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, MASKS_AT_ONCE):
            yield batch.slice(start, MASKS_AT_ONCE)


def gather_rle(masks: DataFrame, keys: Sequence[str], counts: str) -> DataFrame:
    """One row per mask of run-length encoded ones: (keys, parts); rows of equal keys draw one mask."""
    part = F.struct(F.col(counts).cast("array<bigint>").alias("n"), F.col("h").cast("bigint").alias("h"))
    return masks.groupBy(*keys).agg(F.collect_list(part).alias("parts"))


def gather(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per mask of segments: (keys, parts)."""
    return segments.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(x).cast("bigint").alias(x) for x in ("c", "r0", "r1")])).alias("parts"))


def _segments(parts: pa.Array) -> tuple[np.ndarray, ...]:
    """Segments (mask, c, r0, r1) of gathered masks, by mask, column and row."""
    mask, _ = _within(_lengths(parts))
    each = parts.flatten()
    if each.type.get_field_index("n") >= 0:
        of, *rest = _cut(each.field("n"), _numbers(each.field("h")))
        mask = mask[of]
    else:
        rest = [_numbers(each.field(x)) for x in ("c", "r0", "r1")]
    return _sorted(mask, *rest)


def _sorted(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows by their first three columns; most come in order."""
    key = columns[0]
    for x in columns[1:3] if len(key) else ():
        low = int(x.min())
        key = key * (int(x.max()) - low + 1) + x - low
    if (np.diff(key) >= 0).all():
        return columns
    order = np.argsort(key, kind="stable")
    return tuple(x[order] for x in columns)


def _per_mask(gathered: DataFrame, keys: Sequence[str], columns: str, work: Callable) -> DataFrame:
    """``work`` on the rows of gathered masks, many at once: (keys, columns, c[], r0[], r1[]).

    It returns the ``columns`` of every mask of a batch, and segments; masks without components
    or, where they are not counted, without segments do not come back.
    """
    extra = f", {columns}" if columns else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            told, mask, *segment = work(some)
            n = np.bincount(mask, minlength=some.num_rows)
            go = np.flatnonzero(told.get("n_components", n))
            ends = pa.array(np.concatenate([[0], np.cumsum(n[go])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in segment]
            heads = [some.column(k).take(pa.array(go)) for k in keys]
            yield pa.RecordBatch.from_arrays([*heads, *[pa.array(v[go]) for v in told.values()], *lists], names=[*keys, *told, "c", "r0", "r1"])

    return gathered.mapInArrow(run, f"{_kinds(gathered, keys)}{extra}, c array<bigint>, r0 array<bigint>, r1 array<bigint>")


def spread(whole: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Segment rows of masks held as arrays (keys, c[], r0[], r1[]); a mask with a NULL key meets no other table."""
    return whole.select(*keys, F.inline(F.arrays_zip("c", "r0", "r1"))).dropna(subset=list(keys))


def mask_box(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area and inclusive bounding box per mask."""
    return segments.groupBy(*keys).agg(
        F.sum(F.col("r1") - F.col("r0") + 1).alias("area"),
        F.min("c").alias("c_min"),
        F.max("c").alias("c_max"),
        F.min("r0").alias("r_min"),
        F.max("r1").alias("r_max"),
    )


def merge_segments(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join touching or overlapping segments of a column into maximal ones."""
    by = Window.partitionBy(*keys, "c").orderBy("r0", "r1")
    before = F.max("r1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = segments.withColumn("__new", F.coalesce((F.col("r0") > before + 1).cast("int"), F.lit(1)))
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        starts.withColumn("__k", F.sum("__new").over(upto))
        .groupBy(*keys, "c", "__k")
        .agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"))
        .drop("__k")
    )


def ellipse_reach(px: int) -> list[int]:
    """Half-height of an elliptical (2px+1) window at column offsets -px..px."""
    half_width = [round(px * ((px * px - dy * dy) ** 0.5) / px) if px else 0 for dy in range(-px, px + 1)]
    return [max(abs(dy) for dy, w in zip(range(-px, px + 1), half_width) if w >= abs(dc)) for dc in range(-px, px + 1)]


def _merged(mask: np.ndarray, c: np.ndarray, r0: np.ndarray, r1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Touching or overlapping segments of a column as maximal ones; sorted on both sides."""
    if not len(c):
        return mask, c, r0, r1
    column = np.cumsum(np.r_[0, (np.diff(mask) != 0) | (np.diff(c) != 0)])
    wide = int(r1.max()) + 2
    top = np.maximum.accumulate(column * wide + r1)
    new = np.flatnonzero(np.r_[True, (np.diff(column) != 0) | (r0[1:] > top[:-1] - column[1:] * wide + 1)])
    return mask[new], c[new], r0[new], (top - column * wide)[np.r_[new[1:] - 1, len(c) - 1]]


def _eroded(mask: np.ndarray, c: np.ndarray, r0: np.ndarray, r1: np.ndarray, px: int, sizes: list) -> tuple[np.ndarray, ...]:
    """Segments that are left; ``sizes`` holds each mask's frames [(h, w)].

    Every column offset meets a frame of its own, as in a join: a mask with m frames comes once
    for each choice of frames.  Equal frames make one border.
    """
    offsets = range(-px, px + 1)
    choices = [list(product(s, repeat=len(offsets))) for s in sizes]
    # copy a mask's segments for each of its choices
    owner = np.repeat(np.arange(len(sizes)), [len(x) for x in choices])
    frames = np.array([x for some in choices for x in some], np.int64).reshape(len(owner), len(offsets), 3)
    mask, c, r0, r1 = _merged(mask, c, r0, r1)
    first, last = np.searchsorted(mask, owner, "left"), np.searchsorted(mask, owner, "right")
    copy, place = _within(last - first)
    c, r0, r1 = (x[first[copy] + place] for x in (c, r0, r1))
    if not len(c):
        return owner[copy], c, r0, r1
    wide, tall = int(c.max()) + 2 * px + 2, int(max(r1.max(), frames[:, :, 0].max())) + 2
    kept = None
    for k, (dc, reach) in enumerate(zip(offsets, ellipse_reach(px))):
        h, w, new = frames[copy, k].T
        lo, hi = np.where(r0 == 0, 0, r0 + reach), np.where(r1 == h - 1, r1, r1 - reach)
        some = lo <= hi
        part = [(copy * wide + c - dc + px)[some], lo[some], hi[some]]
        # Columns beyond the frame count as set.
        out = np.flatnonzero(((c + dc < 0) | (c + dc >= w)) & (h > 0) & (new > 0)) if dc else np.arange(0)
        column, at = np.unique((copy * wide + c + px)[out], return_index=True)
        edge = [column, np.zeros(len(column), np.int64), h[out][at] - 1]
        if kept is None:
            kept = [np.concatenate(x) for x in zip(part, edge)]
        else:
            kept = [np.concatenate(x) for x in zip(_meet(*kept, *part, tall), _meet(*kept, *edge, tall))]
        kept = _sorted(*kept)
    column, r0, r1 = kept
    return owner[column // wide], column % wide - px, r0, r1


def _meet(column: np.ndarray, r0: np.ndarray, r1: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray, tall: int) -> list[np.ndarray]:
    """Common rows of two lists of segments; the second is sorted and disjoint within a column."""
    lo = np.searchsorted(other * tall + b, column * tall + r0, "left")
    hi = np.searchsorted(other * tall + a, column * tall + r1, "right")
    mine, place = _within(np.maximum(hi - lo, 0))
    theirs = lo[mine] + place
    return [column[mine], np.maximum(r0[mine], a[theirs]), np.minimum(r1[mine], b[theirs])]


def _frames(gathered: DataFrame, keys: Sequence[str], size: DataFrame, how: str = "inner") -> DataFrame:
    """Gathered masks with their frames, as many as ``size`` (keys, h, w) has."""
    frame = F.struct(F.col("h").cast("bigint").alias("h"), F.col("w").cast("bigint").alias("w"))
    return gathered.join(size.groupBy(*keys).agg(F.collect_list(frame).alias("__size")), list(keys), how)


def _sizes(column: pa.Array) -> list:
    """Frames (h, w, whether it is the first of its kind) of every mask; an unknown size has no border."""
    plain = [[(-1, 1 << 40) if None in s.values() else (s["h"], s["w"]) for s in some or ()] for some in column.to_pylist()]
    return [[(*s, some.index(s) == k) for k, s in enumerate(some)] for some in plain]


def erode_gathered(gathered: DataFrame, keys: Sequence[str], px: int, size: DataFrame) -> DataFrame:
    """Eroded masks (keys, c[], r0[], r1[]) of gathered ones; see ``erode``."""

    def work(some: pa.RecordBatch):
        return {}, *_eroded(*_segments(some.column("parts")), px, _sizes(some.column("__size")))

    return _per_mask(_frames(gathered, keys, size), keys, "", work)


def erode(segments: DataFrame, keys: Sequence[str], px: int, size: DataFrame) -> DataFrame:
    """Shrink masks by an elliptical window; the frame border itself does not erode.

    ``size`` holds (keys, h, w).  A pixel survives if, at every column offset, its
    reach lies inside one segment: each offset gives a set of row intervals per column,
    and the sets are intersected.
    """
    return spread(erode_gathered(gather(segments, keys), keys, px, size), keys) if px > 0 else segments


def _components(c: np.ndarray, r0: np.ndarray, r1: np.ndarray) -> np.ndarray:
    """Component label per segment under 8-connectivity (segments sorted by column, row): its first segment."""
    n = len(c)
    tall = int(r1.max()) + 3 if n else 1
    edges = []
    for step in (0, 1):
        key = c * tall + r1
        lo = np.searchsorted(key, (c + step) * tall + np.maximum(r0 - 1, 0), side="left")
        hi = np.searchsorted(c * tall + r0, (c + step) * tall + r1 + 1, side="right")
        a, place = _within(np.maximum(hi - lo, 0))
        edges.append((a, lo[a] + place))
    a, b = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    label = np.arange(n)
    # Every root joins its smallest neighbour; only edges between different roots stay.
    while len(a):
        root = np.arange(n)
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        label, a, b = root[label], root[a], root[b]
        a, b = a[a != b], b[a != b]
    return label


def _labelled(mask: np.ndarray, c: np.ndarray, r0: np.ndarray, r1: np.ndarray) -> np.ndarray:
    """Components of many masks, each two columns away from the next."""
    return _components(mask * (int(c.max()) + 3 if len(c) else 1) + c, r0, r1)


def _largest(mask: np.ndarray, c: np.ndarray, r0: np.ndarray, r1: np.ndarray, n: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(counts of every mask, whether a segment belongs to its mask's largest component)."""
    label = _labelled(mask, c, r0, r1)
    roots, which = np.unique(label, return_inverse=True)
    px = np.bincount(which, r1 - r0 + 1, len(roots)).astype(np.int64)
    first = np.full(len(roots), np.iinfo(np.int64).max)
    np.minimum.at(first, which, r0 * (int(c.max()) + 1 if len(c) else 1) + c)
    order = np.lexsort((roots, first, -px, mask[roots]))
    of, at = np.unique(mask[roots][order], return_index=True)
    raw, top = np.bincount(mask[roots], px, n).astype(np.int64), np.zeros(n, np.int64)
    top[of] = px[order[at]]
    kept = np.zeros(len(roots), bool)
    kept[order[at]] = True
    return {"n_components": np.bincount(mask[roots], minlength=n), "raw_px": raw, "dropped_px": raw - top}, kept[which]


def label_components(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``component`` to every segment (8-connectivity): its number among the mask's segments."""

    names = [*keys, "c", "r0", "r1", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches):
            found = _segments(some.column("parts"))
            start = np.searchsorted(found[0], found[0], "left")
            told = [pa.array(x) for x in (*found[1:], _labelled(*found) - start)]
            yield pa.RecordBatch.from_arrays([some.column(k).take(pa.array(found[0])) for k in keys] + told, names=names)

    return gather(segments, keys).mapInArrow(run, f"{_kinds(segments, keys)}, c bigint, r0 bigint, r1 bigint, component bigint")


COUNTS = ["n_components", "raw_px", "dropped_px"]


def largest_gathered(gathered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_components, raw_px, dropped_px, c[], r0[], r1[]) of gathered masks; see ``largest_component``."""

    def work(some: pa.RecordBatch):
        found = _segments(some.column("parts"))
        told, kept = _largest(*found, some.num_rows)
        return told, *[x[kept] for x in found]

    return _per_mask(gathered, keys, ", ".join(f"{x} bigint" for x in COUNTS), work)


def largest_component(segments: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(segments of each mask's largest component, per-mask component count and dropped pixels).

    Ties go to the component whose first pixel comes first in row-major order.
    """
    done = largest_gathered(gather(segments, keys), keys)
    return spread(done, keys), done.select(*keys, *COUNTS)


def prepare_gathered(gathered: DataFrame, keys: Sequence[str], px: int, size: DataFrame) -> DataFrame:
    """(keys, n_components, dropped_px, raw_px, c[], r0[], r1[]) of gathered masks; see ``prepare``.

    A mask that erosion leaves nothing of keeps its counts and empty arrays.
    """
    def work(some: pa.RecordBatch):
        left = _segments(some.column("parts"))
        told, kept = _largest(*left, some.num_rows)
        left = tuple(x[kept] for x in left)
        if px > 0:
            left = _sorted(*_eroded(*left, px, _sizes(some.column("__size"))))
            _, kept = _largest(*left, some.num_rows)
            left = tuple(x[kept] for x in left)
        return {"n_components": told["n_components"], "dropped_px": told["dropped_px"], "raw_px": told["raw_px"] - told["dropped_px"]}, *left

    framed = _frames(gathered, keys, size, "left") if px > 0 else gathered
    return _per_mask(framed, keys, "n_components bigint, dropped_px bigint, raw_px bigint", work)


def prepare(segments: DataFrame, keys: Sequence[str], px: int, size: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Largest component, erosion by ``px``, largest component again: (segments, one row of counts per mask).

    Counts are (keys, n_components, dropped_px, raw_px), raw_px before the erosion.  Erosion can
    pinch a mask in two, hence the second pass.
    """
    done = prepare_gathered(gather(segments, keys), keys, px, size)
    return spread(done, keys), done.select(*keys, "n_components", "dropped_px", "raw_px")


def quad_segments(cells: DataFrame, keys: Sequence[str], h: str, w: str) -> DataFrame:
    """Rasterise convex quads: for every column the rows inside, borders included.

    Vertices are rounded first.  Input rows carry ``corners`` as (x = column, y = row)
    points plus the frame size; output (keys, c, r0, r1).
    """
    at = lambda i, k: F.rint(F.get(F.get("corners", F.lit(i)), F.lit(k)))
    flat = cells.select(
        *cells.columns, *[at(i, 0).alias(f"__x{i}") for i in range(4)], *[at(i, 1).alias(f"__y{i}") for i in range(4)]
    )
    x, y = [F.col(f"__x{i}") for i in range(4)], [F.col(f"__y{i}") for i in range(4)]
    lo, hi = F.greatest(F.least(*x), F.lit(0.0)), F.least(F.greatest(*x), F.col(w) - 1.0)
    cols = flat.where(lo <= hi).select("*", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))).alias("c"))
    c, lows, highs = F.col("c"), [], []
    for i in range(4):
        j = (i + 1) % 4
        spans = (F.least(x[i], x[j]) <= c) & (F.greatest(x[i], x[j]) >= c)
        along = y[i] + (y[j] - y[i]) * F.try_divide(c - x[i], x[j] - x[i])
        lows.append(F.when(spans, F.coalesce(along, F.least(y[i], y[j]))))
        highs.append(F.when(spans, F.coalesce(along, F.greatest(y[i], y[j]))))
    out = cols.select(
        *cells.columns,
        "c",
        F.greatest(F.ceil(F.least(*lows)), F.lit(0)).cast("bigint").alias("r0"),
        F.least(F.floor(F.greatest(*highs)), F.col(h) - 1).cast("bigint").alias("r1"),
    )
    return out.where("r0 <= r1")


def cell_labels(cell_segments: DataFrame, keys: Sequence[str], label: str, order: str) -> DataFrame:
    """One label per pixel where quads overlap: the later cell wins.

    Per (capture, column) the few segments are cut at each other's ends and every
    piece takes the last cell that covers it.
    """
    one = F.struct("r0", "r1", F.col(order).alias("o"), F.col(label).alias("lab"))
    cols = cell_segments.groupBy(*keys, "c").agg(F.collect_list(one).alias("s"))
    ends = F.array_sort(
        F.array_distinct(F.concat(F.transform("s", lambda x: x["r0"]), F.transform("s", lambda x: x["r1"] + 1)))
    )
    pieces = cols.withColumn("__e", ends).select(
        *keys, "c", "s", F.explode(F.arrays_zip(
            F.slice("__e", 1, F.size("__e") - 1).alias("a"), F.slice("__e", 2, F.size("__e") - 1).alias("b")
        )).alias("p")
    )
    over = F.filter("s", lambda x: (x["r0"] <= F.col("p")["a"]) & (x["r1"] >= F.col("p")["b"] - 1))
    top = F.array_max(F.transform(over, lambda x: F.struct(x["o"].alias("o"), x["lab"].alias("lab"))))
    return pieces.select(
        *keys, "c", F.col("p")["a"].alias("r0"), (F.col("p")["b"] - 1).alias("r1"), top["lab"].alias(label)
    ).where(F.col(label).isNotNull())


WHOLE = 0


def overlap(segments: DataFrame, labels: DataFrame, on: Sequence[str], mask: str) -> DataFrame:
    """Shared pixels per (capture, mask, cell label), in one pass over the segments.

    The few label pieces of a column travel as one array, so every segment meets one
    row and is never duplicated by the join.  Label 0 carries the mask's whole area.
    """
    pieces = labels.groupBy(*on, "c").agg(F.collect_list(F.struct("r0", "r1", "label")).alias("__p"))
    hit = segments.join(pieces, [*on, "c"], "left")
    shared = lambda p: F.least(F.col("r1"), p["r1"]) - F.greatest(F.col("r0"), p["r0"]) + 1
    part = F.transform("__p", lambda p: F.struct(p["label"].cast("int").alias("label"), shared(p).alias("px")))
    whole = F.array(F.struct(F.lit(WHOLE).alias("label"), (F.col("r1") - F.col("r0") + 1).alias("px")))
    none = F.array().cast("array<struct<label:int,px:bigint>>")
    each = hit.select(*on, mask, F.inline(F.concat(whole, F.coalesce(F.filter(part, lambda x: x["px"] > 0), none))))
    return each.groupBy(*on, mask, "label").agg(F.sum("px").alias("px"))


def assign(
    masks: DataFrame, segments: DataFrame, labels: DataFrame, captures: DataFrame, on: Sequence[str], mask: str,
    order: str, min_containment: float = MIN_CONTAINMENT,
) -> tuple[DataFrame, DataFrame]:
    """Match masks to kernel wells; returns (rows, problems).

    ``masks``     (on, mask, order, h, w): every annotation with the frame it was drawn on, and
                  optionally raw_px, its pixels before erosion
    ``segments``  (on, mask, c, r0, r1): its pixels
    ``labels``    (on, c, r0, r1, label): label = well index + 1, or a marker/rim sentinel
    ``captures``  (on, h, w, status, wells array<int>): the fitted plates and their labels
    """
    on = list(on)
    fitted = captures.select(*on, F.col("h").alias("__h"), F.col("w").alias("__w"), "status", "wells")
    good = captures.where("status <> 'fail'").select(*on, F.col("h").alias("__h"), F.col("w").alias("__w"))
    usable = masks.join(good, on).where((F.col("h") == F.col("__h")) & (F.col("w") == F.col("__w"))).drop("__h", "__w")
    raw = F.col("raw_px") if "raw_px" in masks.columns else F.lit(0)
    kernel = (F.col("label") > WHOLE) & (F.col("label") < MARKER_LABEL)
    stats = overlap(segments, labels, on, mask).groupBy(*on, mask).agg(
        F.max(F.when(F.col("label") == WHOLE, F.col("px"))).alias("npx"),
        F.min(F.when(kernel, F.struct((-F.col("px")).alias("loss"), F.col("label")))).alias("b"),
    )
    judged = usable.join(stats, [*on, mask], "left").select(
        *on, mask, order, "npx", F.col("b.label").alias("label"), raw.alias("raw_px"),
        F.try_divide((-F.col("b.loss")).cast("double"), F.col("npx").cast("double")).alias("containment"),
    )
    verdict = (
        F.when(F.col("npx").isNull() & (F.col("raw_px") > 0), "MASK_ERODED_AWAY")
        .when(F.col("npx").isNull(), "EMPTY_MASK")
        .when(F.col("label").isNull(), "MASK_OFF_LATTICE")
        .when(F.col("containment") < min_containment, "MASK_STRADDLES_CELLS")
    )
    # One row per mask behind the pass over all segments; several branches read it.
    judged = settle(judged.withColumn("problem", verdict).drop("raw_px"))
    fits = judged.where("problem IS NULL")
    claim = fits.groupBy(*on, "label").agg(F.min(F.struct(F.col(order).alias("o"), F.col(mask).alias("m"))).alias("first"))
    placed = fits.join(claim, [*on, "label"])
    mine = F.col("first.m") == F.col(mask)
    rows = placed.where(mine).select(*on, mask, (F.col("label") - 1).alias("cell_index"), "containment", "npx")
    shaped = masks.select(*on, "h", "w").distinct().join(fitted, on)
    bad_shape = (F.col("h") != F.col("__h")) | (F.col("w") != F.col("__w"))
    per_capture = shaped.select(
        *on,
        F.lit(None).cast(masks.schema[mask].dataType).alias(mask),
        F.when(bad_shape, "SHAPE_MISMATCH").when(F.col("status") == "fail", "FIT_FAILED").alias("problem"),
        F.lit(None).cast("int").alias("label"),
    ).where("problem IS NOT NULL")
    wells = shaped.where(~bad_shape & (F.col("status") != "fail")).select(*on, F.explode("wells").alias("label")).distinct()
    unclaimed = wells.join(claim.select(*on, "label"), [*on, "label"], "left_anti")
    parts = [
        judged.where("problem IS NOT NULL").select(*on, mask, "problem", F.col("label").cast("int").alias("label")),
        placed.where(~mine).select(*on, mask, F.lit("TWO_MASKS_ONE_CELL").alias("problem"), F.col("label").cast("int").alias("label")),
        unclaimed.select(
            *on, F.lit(None).cast(masks.schema[mask].dataType).alias(mask), F.lit("CELL_WITHOUT_MASK").alias("problem"),
            F.col("label").cast("int").alias("label"),
        ),
        per_capture,
    ]
    return rows, reduce(DataFrame.unionByName, parts)


def rederive_diff(stored: DataFrame, derived: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full compare of two assignments: rows on one side only or with another value."""
    a = stored.select(*keys, F.col(value).alias("stored"), F.lit(True).alias("__a"))
    b = derived.select(*keys, F.col(value).alias("derived"), F.lit(True).alias("__b"))
    both = a.join(b, list(keys), "full_outer")
    kind = (
        F.when(F.col("__b").isNull(), "only_stored")
        .when(F.col("__a").isNull(), "only_derived")
        .when(~F.col("stored").eqNullSafe(F.col("derived")), "changed")
    )
    return both.withColumn("kind", kind).where("kind IS NOT NULL").drop("__a", "__b")
