"""Image table transforms: one row is one image with ``pixels`` (row-major H, W, C), ``h``, ``w`` and ``c``.

Boxes are slices of rows, as expressions. What moves each pixel, or mixes pixels, runs in Arrow batches with NumPy, on stacks of the images of one
shape: flips, turns and patches are views of a stack that are copied once. Random draws and sides are columns, made by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.arrow import map_in_arrow
from ..functions.rand import hash_uniform


def validate_images(df: DataFrame, size: int, channels: int | None = None, observation: Observation | None = None) -> DataFrame:
    """``df`` if all images have the size; the first that has not is an error. The input is read once, as the result is.

    With an ``observation`` wrong images are counted on the way instead, as ``wrong`` beside ``images``; see ``check_observed``.
    """
    wrong = (F.col("h") != size) | (F.col("w") != size) | (F.size("pixels") != F.col("h") * F.col("w") * F.col("c"))
    if channels:
        wrong = wrong | (F.col("c") != channels)
    wrong = F.coalesce(wrong, F.lit(True))
    if observation is not None:
        return df.observe(observation, F.count_if(wrong).alias("wrong"), F.count("*").alias("images"))
    what = F.format_string(f"an image is not {size} x {size}: %s x %s", F.coalesce(F.col("h").cast("string"), F.lit("?")), F.coalesce(F.col("w").cast("string"), F.lit("?")))
    # A filter, as an error in a column that nobody asks for would be pruned.
    return df.where(F.when(wrong, F.raise_error(what).cast("boolean")).otherwise(F.lit(True)))


def check_observed(observation: Observation) -> int:
    """The number of images, after an action on what ``validate_images`` gave; an error if some were wrong."""
    found = observation.get
    if found["wrong"]:
        raise ValueError(f"{found['wrong']} of {found['images']} images have the wrong size")
    return found["images"]


def upscaled_size(h: Column, w: Column, size: int) -> tuple[Column, Column]:
    """Sides after scaling up so that the shorter one is ``size``; larger images stay. Half rounds to even."""
    short = F.least(h, w)
    scaled = lambda side: F.when(short >= size, side).otherwise(F.bround(side * (F.lit(size) / short), 0).cast("int"))
    return scaled(h), scaled(w)


def halved_size(h: Column, w: Column, size: int) -> tuple[Column, Column, Column]:
    """Sides after halving while the shorter one is at least twice ``size``, then scaling to it; and the number of halvings."""
    short = F.least(h, w)
    # Halving floors, so side after k halvings is floor(side / 2^k); k is the last with floor(short / 2^(k-1)) >= 2 size.
    times = F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.floor(short / F.pow(F.lit(2.0), k)) >= 2 * size), k + 1).otherwise(k))
    halved = lambda side: F.floor(side / F.pow(F.lit(2.0), times))
    scale = F.lit(size) / halved(short)
    final = lambda side: F.bround(halved(side) * scale, 0).cast("int")
    return final(h), final(w), times


def _boxed(df: DataFrame, size: int, columns: Iterable[str], top: Column, left: Column) -> DataFrame:
    """The box from (top, left): slices of rows; in an image without room for it pixel by pixel, with zeros outside."""
    side, h, w, c = F.lit(size), F.col("h"), F.col("w"), F.col("c")

    def rows(px: Column, w: Column, c: Column, top: Column, left: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda y: F.slice(px, (((y + top) * w + left) * c + 1).cast("int"), size * c)))

    def made(name: str) -> Column:
        loose = A.remap(name, h, w, c, side, side, lambda y, x, top, left: (y + top, x + left), top, left)
        return F.when((h >= size) & (w >= size), A.bind(rows, F.col(name), w, c, top, left)).otherwise(loose)

    return df.withColumns({name: made(name) for name in columns} | {"h": side.cast("int"), "w": side.cast("int")})


def center_crop(df: DataFrame, size: int, columns: Iterable[str] = ("pixels",)) -> DataFrame:
    """The middle ``size`` x ``size``, offsets rounded down; images that are smaller are filled with zeros right and below."""
    top, left = (F.greatest(F.lit(0), F.floor((F.col(s) - size) / 2).cast("int")) for s in "hw")
    return _boxed(df, size, columns, top, left)


def random_crop_pair(df: DataFrame, size: int, seed: int, columns: Iterable[str] = ("pixels",)) -> DataFrame:
    """One random box for all image columns; every place from 0 to side - size is as likely."""
    draw = lambda side, name: F.floor(hash_uniform(f"{seed}:{name}", F.col("id")) * (F.col(side) - size + 1)).cast("int")
    return _boxed(df, size, columns, draw("h", "top"), draw("w", "left"))


def _mirrored(df: DataFrame, coin: Column, across: bool, columns: Iterable[str]) -> DataFrame:
    def each(stacks, rows):
        import numpy as np

        turn = np.asarray(rows.column("__ft_coin").to_numpy(zero_copy_only=False), bool)
        for s in stacks:
            s[turn] = s[turn, :, ::-1] if across else s[turn, ::-1]
        return stacks

    return _each_shape(df.withColumn("__ft_coin", coin), each, list(columns)).drop("__ft_coin")


def hflip(df: DataFrame, seed: int, p: float = 0.5, columns: Iterable[str] = ("pixels",)) -> DataFrame:
    """Mirror left and right with probability p, all image columns alike."""
    return _mirrored(df, hash_uniform(f"{seed}:hflip", F.col("id")) < p, True, columns)


def vflip(df: DataFrame, seed: int, p: float = 0.5, columns: Iterable[str] = ("pixels",)) -> DataFrame:
    """Mirror top and bottom with probability p, all image columns alike."""
    return _mirrored(df, hash_uniform(f"{seed}:vflip", F.col("id")) < p, False, columns)


def random_hflip(df: DataFrame, seed: int) -> DataFrame:
    """The augmentation of image generation: mirror every second image."""
    return hflip(df, seed)


def quarter_turns(seed: int) -> Column:
    return F.floor(hash_uniform(f"{seed}:rot90", F.col("id")) * 4).cast("int")


def rot90(df: DataFrame, turns: Column | int, columns: Iterable[str] = ("pixels",)) -> DataFrame:
    """Quarter turns counter-clockwise; an odd number swaps the sides."""
    turns = F.lit(turns) if isinstance(turns, int) else turns

    def each(stacks, rows):
        import numpy as np

        return [np.rot90(s, rows.column("__ft_turns")[0].as_py(), (1, 2)) for s in stacks]

    turned = df.withColumn("__ft_turns", F.pmod(turns, F.lit(4)).cast("int"))
    return _each_shape(turned, each, list(columns), ("__ft_turns",)).drop("__ft_turns")


def swap_channels(df: DataFrame, columns: Iterable[str] = ("pixels",)) -> DataFrame:
    """RGB to BGR and back: the channels of each pixel in reverse."""
    return _each_shape(df, lambda stacks, rows: [s[..., ::-1] for s in stacks], list(columns))


def patchify(df: DataFrame, p: int, id_col: str = "id") -> DataFrame:
    """Rows ``id, patch, values``: the p x p patches in row-major order, each row-major with its channels.

    A rest of rows or columns that fills no patch is left out, and an image without pixels has none.
    """
    source = df.select(id_col, "h", "w", "c", F.col("pixels").cast("array<double>").alias("pixels"))
    target = source.select(id_col, F.lit(0).alias("patch"), F.col("pixels").alias("values")).schema

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        for rows, (stack,), _ in _stacks(batches, ["pixels"], ("h", "w", "c")):
            if stack is None:
                continue
            n, (down, across) = len(stack), (side // p for side in stack.shape[1:3])
            cells = stack[:, : down * p, : across * p].reshape(n, down, p, across, p, -1).transpose(0, 1, 3, 2, 4, 5)
            if cells.size:
                ids = rows.column(id_col).take(pa.array(np.repeat(np.arange(n), down * across)))
                patch = pa.array(np.tile(np.arange(down * across, dtype=np.int32), n))
                yield pa.RecordBatch.from_arrays([ids.cast(out.field(0).type), patch, _listed(cells.reshape(n * down * across, -1), out.field(2).type)], schema=out)

    return map_in_arrow(source, run, target)


def unpatchify(patches: DataFrame, p: int, channels: int, id_col: str = "id") -> DataFrame:
    """Images ``id, pixels, h, w, c`` from patches; their number must be a square. An image's patches, as many as it has, meet in one row."""
    gathered = patches.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("patch", "values"))).alias("ps"))
    flat = gathered.select(id_col, F.size("ps").alias("n"), F.flatten(F.transform("ps", lambda x: x["values"])).cast("array<double>").alias("pixels"))
    target = flat.select(id_col, "pixels", F.lit(0).alias("h"), F.lit(0).alias("w"), F.lit(0).alias("c")).schema

    def run(batches: Iterable) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(target)
        for batch in batches:
            counts = batch.column("n").to_numpy(zero_copy_only=False)
            for n in np.unique(counts):
                side = math.isqrt(int(n))
                if side * side != n:
                    raise ValueError("the number of patches is no square")
                rows = batch.take(pa.array(np.flatnonzero(counts == n)))
                cells = rows.column("pixels").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, side, side, p, p, channels)
                sides = [pa.array([k] * rows.num_rows, pa.int32()) for k in (side * p, side * p, channels)]
                yield pa.RecordBatch.from_arrays([rows.column(id_col).cast(out.field(0).type), _listed(cells.transpose(0, 1, 3, 2, 4, 5), out.field(1).type), *sides], schema=out)

    return map_in_arrow(flat, run, target)


def _kernel(x):
    """Cubic convolution with a = -0.5."""
    import numpy as np

    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


@cache
def _weights(size: int, out: int):
    """out x size matrix: the kernel, widened by the shrink factor, at each output's centre; rows sum to 1."""
    import numpy as np

    step = size / out
    wide = max(1.0, step)
    centre = (np.arange(out) + 0.5) * step
    w = _kernel((np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide)
    return w / w.sum(1, keepdims=True)


def resample(images, h: int, w: int):
    """Bicubic with antialiasing of (N, H, W, C) arrays of 0..255: across, then down, 8-bit between.

    Halves go up; a sum within 1e-9 of a half counts as one, so the order of addition does not matter.
    """
    import numpy as np

    def level(a):
        return np.clip(np.floor(a + (0.5 + 1e-9)), 0, 255)

    out = images.astype(float)
    if out.shape[2] != w:
        out = level(np.einsum("ow,nhwc->nhoc", _weights(out.shape[2], w), out))
    if out.shape[1] != h:
        out = level(np.einsum("oh,nhwc->nowc", _weights(out.shape[1], h), out))
    return out


@cache
def _areas(size: int):
    """size // 2 x size matrix of area means."""
    import numpy as np

    out = size // 2
    edges, i = np.arange(out + 1) * (size / out), np.arange(size)
    return np.clip(np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i), 0, None) / (size / out)


def halve(images, times: int):
    """``times`` rounds of 2 x 2 block means, to the nearest level; a last odd row or column is shared out as an area mean."""
    import numpy as np

    for _ in range(times):
        for spec, axis in (("ow,nhwc->nhoc", 2), ("oh,nhwc->nowc", 1)):
            images = np.floor(np.einsum(spec, _areas(images.shape[axis]), images) + 0.5)
    return images


def middle(images, size: int):
    """The middle ``size`` x ``size``, as ``center_crop`` has it."""
    import numpy as np

    out = np.zeros((len(images), size, size, images.shape[3]))
    top, left = (max(0, (side - size) // 2) for side in images.shape[1:3])
    part = images[:, top : top + size, left : left + size]
    out[:, : part.shape[1], : part.shape[2]] = part
    return out


def _stacks(batches: Iterable, columns: list[str], keys: Iterable[str]) -> Iterator:
    """Of each Arrow batch the rows of one key at a time (its first three parts are h, w and c), and their images as stacks (N, H, W, C).

    Rows without one of the images come by themselves, without stacks.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        gone = np.zeros(batch.num_rows, bool)
        for c in columns:
            gone |= pc.is_null(batch.column(c)).to_numpy(zero_copy_only=False)
        if gone.any():
            yield batch.filter(pa.array(gone)), [None] * len(columns), None
        there = np.flatnonzero(~gone)
        if not len(there):
            continue
        found, of = np.unique(np.stack([batch.column(k).to_numpy(zero_copy_only=False)[there] for k in keys], 1), axis=0, return_inverse=True)
        for k, key in enumerate(found.astype(int)):
            rows = batch.take(pa.array(there[of.ravel() == k]))
            yield rows, [rows.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *key[:3]) for c in columns], key


def _listed(stack, kind):
    """An Arrow list for each image of a stack."""
    import numpy as np
    import pyarrow as pa

    flat = np.ascontiguousarray(stack).reshape(len(stack), -1)
    ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()).cast(kind.value_type)).cast(kind)


def _each_shape(df: DataFrame, fn: Callable, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``fn(stacks, rows)`` to the images of one shape (and of equal ``keys``) at a time: a stack (N, H, W, C), its own to change, for each
    image column, and their rows as an Arrow batch. A row without one of the images stays as it is.

    Spark bounds an Arrow batch by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``), so large images come a few at a time.
    """
    names, schema = df.columns, df.schema

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for rows, stacks, _ in _stacks(batches, columns, ("h", "w", "c", *keys)):
            if stacks[0] is None:
                yield pa.RecordBatch.from_arrays([rows.column(n).cast(f.type) for n, f in zip(names, out, strict=True)], schema=out)
                continue
            made = fn(stacks, rows)
            new = {c: _listed(m, out.field(c).type) for c, m in zip(columns, made, strict=True)}
            for side, at in (("h", 1), ("w", 2)):
                new[side] = pa.array([made[0].shape[at]] * rows.num_rows, out.field(side).type)
            yield pa.RecordBatch.from_arrays([new[n] if n in new else rows.column(n).cast(f.type) for n, f in zip(names, out, strict=True)], schema=out)

    return map_in_arrow(df, run, schema)


def _to_sides(df: DataFrame, h: Column, w: Column, times: Column | None, fn: Callable, columns: Iterable[str]) -> DataFrame:
    """Halve ``times`` and resample each image to sides that Spark works out, then ``fn(stack)``."""
    sided = df.withColumns({"__ft_h": h, "__ft_w": w, "__ft_times": F.lit(0) if times is None else times.cast("int")})
    columns = list(columns)

    def each(stacks, rows):
        h, w, times = (rows.column(c)[0].as_py() for c in ("__ft_h", "__ft_w", "__ft_times"))  # the same for all of one shape
        return [fn(resample(halve(s, times), h, w)) for s in stacks]

    return _each_shape(sided, each, columns).drop("__ft_h", "__ft_w", "__ft_times")


def upscale_short_side(df: DataFrame, size: int, columns: Iterable[str] = ("pixels",)) -> DataFrame:
    """Bicubic to ``upscaled_size``."""
    return _to_sides(df, *upscaled_size(F.col("h"), F.col("w"), size), None, lambda s: s, columns)


def resize_square(df: DataFrame, n: int, columns: Iterable[str] = ("pixels",)) -> DataFrame:
    """Bicubic to n x n."""
    return _to_sides(df, F.lit(n), F.lit(n), None, lambda s: s, columns)


def _per_image(transform: Callable | None, images):
    """The caller's hook, image by image."""
    import numpy as np

    return np.stack([transform(i) for i in images]) if transform else images


def halving_center_crop(df: DataFrame, size: int, transform: Callable | None = None, columns: Iterable[str] = ("pixels",)) -> DataFrame:
    """Images by ``halved_size``, their middle, then the caller's ``transform(array) -> array``, in the same pass."""
    return _to_sides(df, *halved_size(F.col("h"), F.col("w"), size), lambda s: _per_image(transform, middle(s, size)), columns)


def prepare_pairs(
    df: DataFrame, size: int, train: bool, seed: int = 0, resize: int = 0, flip: bool = True, turn: bool = True, transform: Callable | None = None, columns: Iterable[str] = ("condition", "target")
) -> DataFrame:
    """Pairs as they are trained or evaluated on, in one pass.

    First a square resize (``resize`` > 0) or scaling up to ``size``; then in training one random box, flips and turns that the
    pair shares, in evaluation the middle. The random draws are columns, by id. ``transform`` comes last.
    """
    if resize and train and resize < size:
        raise ValueError("resize must not be below size: there is no box to crop")
    columns = list(columns)
    draws = {f"__ft_{n}": hash_uniform(f"{seed}:{n}", F.col("id")) for n in ("top", "left", "hflip", "vflip", "rot90")}
    h, w = (F.lit(resize), F.lit(resize)) if resize else upscaled_size(F.col("h"), F.col("w"), size)
    names = list(draws)

    def box(image, row):
        import numpy as np

        top, left = (int(row[f"__ft_{n}"] * (side - size + 1)) for n, side in zip(("top", "left"), image.shape[:2], strict=True))
        out = image[top : top + size, left : left + size]
        if flip:
            out = out[:: -1 if row["__ft_vflip"] < 0.5 else 1, :: -1 if row["__ft_hflip"] < 0.5 else 1]
        return np.rot90(out, int(row["__ft_rot90"] * 4)) if turn else out

    def each(stacks, rows):
        import numpy as np

        sides = [rows.column(c)[0].as_py() for c in ("__ft_h", "__ft_w")]
        scaled = [resample(s, *sides) for s in stacks]
        if train:
            marks = rows.select(names).to_pylist()  # a few numbers for each image
            scaled = [np.stack([box(i, m) for i, m in zip(s, marks, strict=True)]) for s in scaled]
        else:
            scaled = [middle(s, size) for s in scaled]
        return [_per_image(transform, s) for s in scaled]

    return _each_shape(df.withColumns(draws | {"__ft_h": h, "__ft_w": w}), each, columns).drop(*draws, "__ft_h", "__ft_w")
