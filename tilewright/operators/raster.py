"""Rasters as chunks: one row holds a block of an image, one packed array per channel.

Steps that look at a neighbourhood get their block with a halo: every chunk sends only the strips its neighbours need,
and one shuffle by chunk brings a block and its strips together.  Array arithmetic stays inside a block, so memory follows
the chunk side, whatever the image; what spans an image (sums, percentiles, labels that meet across chunks) is a table
that Spark groups and joins.  Positions outside an image are NaN, and so are positions without a value.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.operators.components import CHUNK, EIGHT, FOUR, connect
from tilewright.operators.scale import attach, in_groups, names, spread_for_python, stored

PLACE = ["h", "w", "cy", "cx"]
ROWS_AT_ONCE = 20_000
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


@dataclass(frozen=True)
class Block:
    """A chunk's place and its channels, with ``halo`` positions around it; ``facts`` are its image's."""

    h: int
    w: int
    top: int
    left: int
    halo: int
    channels: dict[str, np.ndarray]
    facts: dict

    def __getitem__(self, name: str) -> np.ndarray:
        return self.channels[name]

    @property
    def core(self) -> tuple[slice, slice]:
        return slice(self.halo, -self.halo or None), slice(self.halo, -self.halo or None)

    def padded(self, halo: int, inputs) -> Block:
        """The block of an image that is one chunk, with a halo of absent positions."""
        return replace(self, halo=halo, channels={c: np.pad(self.channels[c], halo, constant_values=np.nan) for c in names(inputs)})

    def reflected(self, name: str) -> np.ndarray:
        """The channel with positions outside the image mirrored at its border pixels."""
        values = self.channels[name]

        def back(first: int, n: int, size: int) -> np.ndarray:
            place = np.abs(np.arange(first, first + n))
            period = max(1, 2 * (size - 1))
            place = place % period
            return np.where(place >= size, period - place, place) - first

        return values[np.ix_(back(self.top - self.halo, values.shape[0], self.h), back(self.left - self.halo, values.shape[1], self.w))]


def _side(size: int, at: int, chunk: int) -> int:
    return min(chunk, size - at * chunk)


def _block(row: dict, inputs, facts, chunk: int) -> Block:
    h, w, cy, cx = (int(row[c]) for c in PLACE)
    shape = _side(h, cy, chunk), _side(w, cx, chunk)
    found = {c: np.frombuffer(row[c], dtype=np.float64).reshape(shape) for c in inputs}
    return Block(h, w, cy * chunk, cx * chunk, 0, found, {f: row[f] for f in facts})


def _padded(row: dict, strips: pd.DataFrame, halo: int, inputs, facts, chunk: int) -> Block:
    """A chunk's block with what the chunks around it gave."""
    block = _block(row, inputs, facts, chunk)
    shape = block[inputs[0]].shape
    found = {c: np.pad(block[c], halo, constant_values=np.nan) for c in inputs}
    for strip in strips.to_dict("records"):
        sides = []
        for d, n, size, at in ((strip["dy"], shape[0], block.h, block.top), (strip["dx"], shape[1], block.w, block.left)):
            # From before: the last rows of a whole chunk.  From behind: the first rows, fewer in a last thin chunk.
            sides.append((halo, n) if d == 0 else (0, halo) if d == 1 else (halo + n, min(halo, size - at - n)))
        (y, rows), (x, cols) = sides
        for c in inputs:
            found[c][y:y + rows, x:x + cols] = np.frombuffer(strip[c], dtype=np.float64).reshape(rows, cols)
    return replace(block, halo=halo, channels=found)


def _together(places: pd.DataFrame, found: list[dict], at: list[np.ndarray]) -> pd.DataFrame:
    """One frame of the rows of several blocks, after their places."""
    out = places.iloc[np.concatenate(at)].reset_index(drop=True)
    for c in found[0]:
        parts = [f[c] for f in found if len(f[c])]
        arrays = parts and all(isinstance(p, np.ndarray) and p.ndim == 1 for p in parts)
        out[c] = np.concatenate(parts) if arrays else pd.Series([v for p in parts for v in p], dtype=object if parts and not np.isscalar(parts[0][0]) else None, index=out.index)
    return out


Work = Callable[[Block], dict[str, np.ndarray]]
TableWork = Callable[[Block], dict[str, np.ndarray | list]]


@dataclass(frozen=True)
class Raster:
    """Chunks of images: columns ``by``, h, w, cy, cx, one binary column per channel, and facts of the image.

    ``lone`` is set where every image is known to be one chunk: no step needs a neighbour then, so none shuffles for one.
    ``made`` tells how maps made ``frame`` (that frame, the raster before them, their work as one), so that maps and a table
    after one another run in one Python worker.
    """

    frame: DataFrame
    by: tuple[str, ...]
    channels: tuple[str, ...]
    facts: tuple[str, ...] = ()
    chunk: int = CHUNK
    lone: bool = False
    made: tuple[DataFrame, Raster, Callable[[Block], Block]] | None = None

    @property
    def keys(self) -> list[str]:
        return [*self.by, *PLACE]

    def _types(self, columns) -> str:
        types = {f.name: f.dataType.simpleString() for f in self.frame.schema.fields}
        return ", ".join(f"`{c}` {types[c]}" for c in columns)

    def settled(self) -> Raster:
        frame = stored(self.frame)
        return replace(self, frame=frame, lone=self.lone or frame.where((F.col("h") > self.chunk) | (F.col("w") > self.chunk)).isEmpty())

    def pick(self, *channels: str) -> Raster:
        return replace(self, frame=self.frame.select(*self.keys, *channels, *self.facts), channels=channels)

    def renamed(self, **names: str) -> Raster:
        """Channels under new names: ``new=old``."""
        back = {old: new for new, old in names.items()}
        return replace(self, frame=self.frame.withColumnsRenamed(back), channels=tuple(back.get(c, c) for c in self.channels))

    def with_facts(self, facts: DataFrame) -> Raster:
        """Adds columns of a table with at most one row per image (NULL without one)."""
        new = [c for c in facts.columns if c not in self.by]
        frame = attach(self.frame.drop(*[f for f in self.facts if f in new]), facts, list(self.by), "left")
        return replace(self, frame=frame, facts=(*[f for f in self.facts if f not in new], *new))

    def without_facts(self) -> Raster:
        return replace(self, frame=self.frame.drop(*self.facts), facts=()) if self.facts else self

    def map(self, work: Work, outputs, keep=None) -> Raster:
        """Adds or replaces ``outputs``, computed block by block; other channels pass through."""
        outputs = names(outputs)
        kept = [c for c in (self.channels if keep is None else keep) if c not in outputs]
        columns = [*self.keys, *kept, *self.facts, *outputs]
        schema = self._types(columns[:len(columns) - len(outputs)]) + "".join(f", `{c}` binary" for c in outputs)
        source, before = self._source()
        given, facts, chunk, own, channels = source.channels, self.facts, self.chunk, [*self.keys, *self.facts], [*kept, *outputs]

        def whole(block: Block) -> Block:
            block = before(block)
            found = work(block)
            return replace(block, channels={**{c: block[c] for c in kept}, **{c: np.ascontiguousarray(found[c], dtype=np.float64) for c in outputs}})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                packed = {c: [] for c in channels}
                for row in frame.to_dict("records"):
                    block = whole(_block(row, given, facts, chunk))
                    for c in channels:
                        packed[c].append(block[c].tobytes())
                yield frame[own].assign(**packed)[columns]

        frame = source.frame.mapInPandas(run, schema)
        return replace(self, frame=frame, channels=(*kept, *outputs), made=(frame, source, whole))

    def _source(self) -> tuple[Raster, Callable[[Block], Block]]:
        """The raster whose blocks a step reads, and what maps before it make of them: nothing, unless they made this very frame."""
        return self.made[1:] if self.made is not None and self.made[0] is self.frame else (self, lambda block: block)

    def table(self, work: TableWork, schema: str, place: bool = False) -> DataFrame:
        """Rows made from each block: ``by`` (with ``place`` also h, w, cy, cx) and the columns of ``schema``."""
        own = self.keys if place else list(self.by)
        source, before = self._source()
        channels, facts, chunk = source.channels, self.facts, self.chunk

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found, at = [], []
                for i, row in enumerate(frame.to_dict("records")):
                    found.append(work(before(_block(row, channels, facts, chunk))))
                    at.append(np.full(len(next(iter(found[-1].values()))), i))
                    if sum(map(len, at)) >= ROWS_AT_ONCE:
                        yield _together(frame[own], found, at)
                        found, at = [], []
                if found:
                    yield _together(frame[own], found, at)

        return source.frame.mapInPandas(run, f"{self._types(own)}, {schema}")

    def _strips(self, halo: int, inputs) -> DataFrame:
        """What each chunk gives to those around it."""
        chunk, by, facts = self.chunk, list(self.by), self.facts

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = []
                for row in frame.to_dict("records"):
                    block = _block(row, inputs, facts, chunk)
                    cy, cx = block.top // chunk, block.left // chunk
                    for dy, dx in AROUND:
                        if not (0 <= cy + dy <= (block.h - 1) // chunk and 0 <= cx + dx <= (block.w - 1) // chunk):
                            continue
                        cut = tuple({1: slice(max(0, n - halo), n), 0: slice(0, n), -1: slice(0, min(halo, n))}[d] for d, n in zip((dy, dx), block[inputs[0]].shape))
                        found.append([*[row[c] for c in by], cy + dy, cx + dx, dy, dx, *[np.ascontiguousarray(block[c][cut]).tobytes() for c in inputs]])
                yield pd.DataFrame(found, columns=[*by, "cy", "cx", "dy", "dx", *inputs])

        schema = f"{self._types([*by, 'cy', 'cx'])}, dy int, dx int" + "".join(f", `{c}` binary" for c in inputs)
        return self.frame.select(*self.keys, *inputs, *self.facts).mapInPandas(run, schema)

    def _with_halo(self, halo: int, inputs, own, finish, schema: str) -> DataFrame:
        if halo > self.chunk:
            raise ValueError("a halo reaches no farther than the next chunk")
        inputs, keys = names(inputs), [*self.by, "cy", "cx"]
        strips = spread_for_python(self._strips(halo, inputs), *keys).groupBy(*keys)
        columns = [*self.keys, *self.channels, *self.facts]
        facts, chunk = self.facts, self.chunk

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty:
                return pd.DataFrame(columns=own)
            row = left.to_dict("records")[0]
            return finish(row, _padded(row, right, halo, inputs, facts, chunk))

        # Fresh column instances: both sides come from one table.
        chunks = spread_for_python(self.frame.select(*columns), *keys).toDF(*columns).groupBy(*keys)
        return chunks.cogroup(strips).applyInPandas(run, schema)

    def stencil(self, halo: int, inputs, work: Work, outputs, keep=None) -> Raster:
        """As :meth:`map`, with blocks of ``inputs`` that reach ``halo`` positions over their borders; outputs have a block's own size."""
        outputs = names(outputs)
        if self.lone:
            return self.map(lambda block: work(block.padded(halo, inputs)), outputs, keep)
        kept = [c for c in (self.channels if keep is None else keep) if c not in outputs]
        columns = [*self.keys, *kept, *self.facts]

        def finish(row, block: Block) -> pd.DataFrame:
            found = work(block)
            return pd.DataFrame([[*[row[c] for c in columns], *[np.ascontiguousarray(found[c], dtype=np.float64).tobytes() for c in outputs]]], columns=[*columns, *outputs])

        frame = self._with_halo(halo, inputs, [*columns, *outputs], finish, self._types(columns) + "".join(f", `{c}` binary" for c in outputs))
        return replace(self, frame=frame, channels=(*kept, *outputs))

    def halo_table(self, halo: int, inputs, work: TableWork, schema: str) -> DataFrame:
        """As :meth:`table`, with blocks of ``inputs`` that reach ``halo`` positions over their borders."""
        by = self.by
        if self.lone:
            return self.table(lambda block: work(block.padded(halo, inputs)), schema)

        def finish(row, block: Block) -> pd.DataFrame:
            out = pd.DataFrame(work(block))
            for i, c in enumerate(by):
                out.insert(i, c, row[c])
            return out

        made = [part.split()[0].strip("`") for part in schema.split(", ")]
        return self._with_halo(halo, inputs, [*self.by, *made], finish, f"{self._types(self.by)}, {schema}")

    def pixels(self, *channels: str) -> DataFrame:
        """One row per position: ``by``, y, x and the channels (NULL for NaN)."""
        channels = channels or self.channels

        def rows(block: Block) -> dict:
            y, x = np.indices(block[channels[0]].shape)
            return {"y": (y + block.top).ravel().astype(np.int32), "x": (x + block.left).ravel().astype(np.int32), **{c: block[c].ravel() for c in channels}}

        frame = self.pick(*channels).without_facts().table(rows, "y int, x int" + "".join(f", `{c}` double" for c in channels))
        return frame.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in channels})


def to_chunks(pixels: DataFrame, channels, by="image_id", chunk: int = CHUNK) -> Raster:
    """Chunks of a pixel table: ``by``, y, x, h, w and numeric channels."""
    by, channels = names(by), names(channels)
    types = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    columns = [*by, "h", "w", "cy", "cx"]
    cells = pixels.select(
        *by, F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.floor(F.col("y") / chunk).cast("int").alias("cy"), F.floor(F.col("x") / chunk).cast("int").alias("cx"),
        (F.col("y") % chunk).cast("int").alias("y"), (F.col("x") % chunk).cast("int").alias("x"), *[F.col(c).cast("double").alias(c) for c in channels])

    def pack(frame: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        out = frame[columns].iloc[cuts].reset_index(drop=True)
        sides = [[_side(int(size), int(at), chunk) for size, at in zip(out[size], out[at])] for size, at in (("h", "cy"), ("w", "cx"))]
        y, x, values = frame["y"].to_numpy(), frame["x"].to_numpy(), {c: frame[c].to_numpy() for c in channels}
        packed = {c: [] for c in channels}
        for h, w, a, b in zip(*sides, cuts, [*cuts[1:], len(frame)]):
            for c in channels:
                block = np.full((h, w), np.nan)
                block[y[a:b], x[a:b]] = values[c][a:b]
                packed[c].append(block.tobytes())
        return out.assign(**packed)

    schema = ", ".join(f"`{k}` {types[k]}" for k in by) + ", h int, w int, cy int, cx int" + "".join(f", `{c}` binary" for c in channels)
    return Raster(in_groups(cells, columns, pack, schema), tuple(by), tuple(channels), (), chunk)


def swept(values: np.ndarray, footprint: dict[int, int], pick) -> np.ndarray:
    """Minimum (``np.fmin``) or maximum (``np.fmax``) over the footprint; absent positions take no part and stay absent."""
    reach = max(max(map(abs, footprint)), max(footprint.values()))
    padded, out = np.pad(values, reach, constant_values=np.nan), np.full_like(values, np.nan)
    h, w = values.shape
    for dy, half in footprint.items():
        for dx in range(-half, half + 1):
            out = pick(out, padded[reach + dy:reach + dy + h, reach + dx:reach + dx + w])
    return np.where(np.isnan(values), np.nan, out)


def opened_closed(values: np.ndarray, footprint: dict[int, int]) -> np.ndarray:
    for pick in (np.fmin, np.fmax, np.fmax, np.fmin):
        values = swept(values, footprint, pick)
    return values


def local_labels(values: np.ndarray, first: float, width: int, diagonal: bool) -> np.ndarray:
    """Label per position: the least index (y * width + x, from ``first``) of its part with equal value; NaN where the value is."""
    h, w = values.shape
    index = np.arange(h * w).reshape(h, w)
    pairs = []
    for dy, dx in EIGHT if diagonal else FOUR:
        here = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        there = (slice(dy, h), slice(max(0, dx), w - max(0, -dx)))
        same = values[here] == values[there]
        pairs.append(np.stack([index[here][same], index[there][same]]))
    left, right = np.concatenate(pairs, axis=1)
    label = np.arange(h * w)
    while True:
        low = np.minimum(label[left], label[right])
        moved = label.copy()
        np.minimum.at(moved, label[left], low)
        np.minimum.at(moved, label[right], low)
        while not np.array_equal(moved, moved[moved]):
            moved = moved[moved]
        if np.array_equal(moved, label):
            break
        label = moved
    label = label.reshape(h, w)
    return np.where(np.isnan(values), np.nan, first + (label // w) * width + label % w)


def labelled(raster: Raster, value: str, name: str, diagonal: bool = True) -> Raster:
    """Adds ``name``: the least position index (y * w + x) of the connected part of equal ``value``; NaN where that is.

    Parts are labelled inside chunks; only pairs of labels that meet across a border are joined, and only labels that change are sent back.
    """
    def inside(block: Block) -> dict:
        return {name: local_labels(block[value], block.top * block.w + block.left, block.w, diagonal)}

    rows = raster.map(inside, name).settled()
    if rows.lone:
        return rows

    def meeting(block: Block) -> dict:
        of, label = block[value], block[name]
        h, w = of.shape[0] - 2, of.shape[1] - 2
        pairs = []
        for dy, dx in ((dy, dx) for dy, dx in AROUND if diagonal or dy * dx == 0):
            mine, theirs = (slice(1, h + 1), slice(1, w + 1)), (slice(1 + dy, h + 1 + dy), slice(1 + dx, w + 1 + dx))
            outside = np.zeros((h, w), dtype=bool)
            if dy:
                outside[0 if dy < 0 else -1, :] = True
            if dx:
                outside[:, 0 if dx < 0 else -1] = True
            met = outside & (of[mine] == of[theirs])
            pairs.append(np.stack([label[mine][met], label[theirs][met]]))
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1).astype(np.int64)
        return {"a": a, "b": b}

    narrow = rows.without_facts().pick(value, name)
    many = replace(narrow, frame=narrow.frame.where((F.col("h") > raster.chunk) | (F.col("w") > raster.chunk)))
    if many.frame.isEmpty():
        return rows
    met = stored(many.halo_table(1, [value, name], meeting, "a long, b long").distinct())
    if met.isEmpty():
        return rows
    by = list(raster.by)
    roots = connect(met, by).select(*by, "node", "root")
    sizes = rows.frame.select(*by, "w").distinct()
    home = lambda p: F.floor(p / raster.chunk).cast("int")
    sent = roots.join(sizes, by).withColumns({"cy": home(F.floor(F.col("node") / F.col("w"))), "cx": home(F.pmod("node", "w"))})
    sent = sent.groupBy(*by, "cy", "cx").agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("_roots"))
    joined = replace(rows, frame=rows.frame.join(sent, [*by, "cy", "cx"], "left"), facts=(*rows.facts, "_roots"))

    def final(block: Block) -> dict:
        label, change = block[name], block.facts["_roots"]
        if change is None or not len(change):
            return {name: label}
        old, new = (np.array([r[f] for r in change], dtype=np.float64) for f in ("node", "root"))
        at = np.minimum(np.searchsorted(old, label), len(old) - 1)
        return {name: np.where(old[at] == label, new[at], label)}

    done = joined.map(final, name)
    return replace(done, frame=done.frame.drop("_roots"), facts=raster.facts).settled()


def without_small(raster: Raster, mask: str, minimum: int) -> Raster:
    """Unsets (0) set positions (1) of ``mask`` in 4-connected parts of fewer than ``minimum``."""
    if minimum <= 1:
        return raster
    if raster.lone:
        def left(block: Block) -> dict:
            part = local_labels(np.where(block[mask] == 1, 1.0, np.nan), 0, block.w, False)
            label, n = np.unique(part[~np.isnan(part)], return_counts=True)
            return {mask: np.where(np.isin(part, label[n < minimum]), 0.0, block[mask])}

        return raster.map(left, mask)
    rows = labelled(raster.map(lambda b: {"_set": np.where(b[mask] == 1, 1.0, np.nan)}, "_set"), "_set", "_part", diagonal=False)
    by = list(raster.by)

    def areas(block: Block) -> dict:
        label, n = np.unique(block["_part"][~np.isnan(block["_part"])], return_counts=True)
        return {"label": label.astype(np.int64), "n": n.astype(np.int64)}

    sizes = rows.without_facts().table(areas, "label long, n long", place=True)
    total = sizes.groupBy(*by, "label").agg(F.sum("n").alias("n")).where(F.col("n") < minimum).select(*by, "label")
    small = attach(sizes.drop("n"), total, [*by, "label"]).groupBy(*by, "cy", "cx").agg(F.collect_list("label").alias("_small"))
    joined = replace(rows, frame=rows.frame.join(small, [*by, "cy", "cx"], "left"), facts=(*rows.facts, "_small"))

    def drop(block: Block) -> dict:
        gone = block.facts["_small"]
        return {mask: block[mask] if gone is None else np.where(np.isin(block["_part"], np.asarray(gone, dtype=np.float64)), 0.0, block[mask])}

    done = joined.map(drop, mask, keep=raster.channels)
    return replace(done, frame=done.frame.drop("_small"), facts=raster.facts)


def percentiles(raster: Raster, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles per image (``by`` and one column per share); equal values of a chunk are merged before the shuffle."""
    def counts(block: Block) -> dict:
        v, n = np.unique(block[value][~np.isnan(block[value])], return_counts=True)
        return {"v": v, "n": n.astype(np.int64)}

    rows = raster.without_facts().pick(value).table(counts, "v double, n long")
    return stored(rows.groupBy(*raster.by).agg(*[F.percentile("v", s, F.col("n")).alias(name) for name, s in shares.items()]))


def _kernel(kind: str, n_in: int, n_out: int, low: int, high: int) -> tuple[int, np.ndarray]:
    """First target and weights (target x source) of source positions low..high-1."""
    scale = n_in / n_out
    if kind == "lanczos":
        wide = max(scale, 1.0)
        reach = 3.0 * wide
        targets = np.arange(n_out)
        centre = (targets + 0.5) * scale
        first = np.maximum((centre - reach + 0.5).astype(np.int64), 0)
        last = np.minimum((centre + reach + 0.5).astype(np.int64), n_in)
        some = np.flatnonzero((first < high) & (last > low))
        weights = np.zeros((len(some), high - low))
        for i, t in enumerate(some):
            at = (np.arange(first[t], last[t]) - centre[t] + 0.5) / wide
            share = np.where(np.abs(at) < 3.0, np.sinc(at) * np.sinc(at / 3.0), 0.0)
            share = np.floor(share / share.sum() * (1 << 22) + 0.5)
            a, b = max(low, first[t]), min(high, last[t])
            weights[i, a - low:b - low] = share[a - first[t]:b - first[t]]
        return int(some[0]) if len(some) else 0, weights
    source = np.arange(low, high)
    if kind == "area":
        targets = np.arange(int(low / scale), min(n_out, math.ceil(high / scale)))
        begin, end = targets[:, None] * scale, (targets[:, None] + 1) * scale
        return int(targets[0]), np.clip(np.minimum(end, source + 1) - np.maximum(begin, source), 0.0, None) / scale
    if kind == "linear":
        place = np.clip((np.arange(n_out) + 0.5) * scale - 0.5, 0.0, n_in - 1.0)
        weights = np.clip(1.0 - np.abs(place[:, None] - source), 0.0, None)
    else:
        weights = (np.minimum(np.floor((np.arange(n_out) + 0.5) * scale), n_in - 1)[:, None] == source).astype(float)
    some = np.flatnonzero(weights.any(axis=1))
    return (int(some[0]), weights[some[0]:some[-1] + 1]) if len(some) else (0, weights[:0])


def resampled(raster: Raster, height: str, width: str, kind: str) -> Raster:
    """Channels at the size that facts ``height`` and ``width`` give, which become h and w.

    Kinds: ``lanczos`` (8-bit channels; fixed-point weights, rounded after either direction), ``area``, ``linear``, ``nearest``.
    Each chunk adds its weighted share to the chunks of the target, and shares are summed there: one shuffle a direction
    for ``lanczos``, one for both otherwise.
    """
    if kind == "lanczos":
        return _resampled(_resampled(raster, None, width, kind), height, None, kind)
    return _resampled(raster, height, width, kind)


def _resampled(raster: Raster, height: str | None, width: str | None, kind: str) -> Raster:
    chunk, channels, by = raster.chunk, list(raster.channels), list(raster.by)
    facts = list(raster.facts)
    columns = [*by, "h", "w", "cy", "cx", *facts]

    def shares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                block = _block(row, channels, facts, chunk)
                out_h, out_w = int(row[height]) if height else block.h, int(row[width]) if width else block.w
                rows, cols = block[channels[0]].shape
                top, down = _kernel(kind, block.h, out_h, block.top, block.top + rows) if height else (block.top, None)
                left, across = _kernel(kind, block.w, out_w, block.left, block.left + cols) if width else (block.left, None)
                part = {c: block[c] for c in channels}
                if down is not None:
                    part = {c: down @ v for c, v in part.items()}
                if across is not None:
                    part = {c: v @ across.T for c, v in part.items()}
                shape = part[channels[0]].shape
                found = []
                for cy in range(top // chunk, (top + shape[0] - 1) // chunk + 1 if shape[0] else 0):
                    for cx in range(left // chunk, (left + shape[1] - 1) // chunk + 1 if shape[1] else 0):
                        y0, x0 = max(top, cy * chunk), max(left, cx * chunk)
                        cut = slice(y0 - top, (cy + 1) * chunk - top), slice(x0 - left, (cx + 1) * chunk - left)
                        pieces = [np.ascontiguousarray(part[c][cut]) for c in channels]
                        found.append([*[row[c] for c in by], out_h, out_w, cy, cx, *[row[f] for f in facts], y0 - cy * chunk, x0 - cx * chunk, pieces[0].shape[1], *[p.tobytes() for p in pieces]])
                yield pd.DataFrame(found, columns=[*columns, "y", "x", "n", *channels])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.to_dict("records")[0]
        shape = _side(int(first["h"]), int(first["cy"]), chunk), _side(int(first["w"]), int(first["cx"]), chunk)
        out = frame[columns].head(1).copy()
        for c in channels:
            total = np.zeros(shape)
            for y, x, n, data in zip(frame["y"], frame["x"], frame["n"], frame[c]):
                piece = np.frombuffer(data, dtype=np.float64).reshape(-1, n)
                total[y:y + piece.shape[0], x:x + n] += piece
            if kind == "lanczos":
                total = np.clip(np.floor((total + (1 << 21)) / (1 << 22)), 0, 255)
            out[c] = [total.tobytes()]
        return out

    kept = raster._types([*by, "h", "w", "cy", "cx", *facts])
    data = "".join(f", `{c}` binary" for c in channels)
    made = raster.frame.mapInPandas(shares, f"{kept}, y int, x int, n int{data}")
    grouped = spread_for_python(made, *by, "cy", "cx").groupBy(*by, "cy", "cx")
    return replace(raster, frame=grouped.applyInPandas(added, f"{kept}{data}"), lone=False)
