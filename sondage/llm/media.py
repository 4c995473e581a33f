"""Cropped and edited copies of pictures by local descriptors.

Corners are found at several scales, each gets an orientation from the intensity centroid around it, and 256 brightness
comparisons, turned by that orientation, make a binary descriptor. Descriptors meet in Hamming tables: ``TABLES`` tables, each
keyed by its share of the bits, so descriptors that differ in fewer bits than there are tables meet in one at least. Each
meeting says which shift, turn and zoom would carry one picture onto the other; pictures are copies if enough corners agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm._io import Scratch, bit_filter, slot

SCALES = (1.0, 0.75, 0.5)
REACH = 9  # of the brightness comparisons
#: Hamming tables: one for each 64-bit word of a descriptor.
TABLES = 4
#: How far placements may lie apart that agree: in powers of two, radians and pixels.
ZOOM, TURN, SHIFT = 0.5, np.pi / 12, 6.0
_random = np.random.default_rng(7)
_TESTS = np.clip(np.rint(_random.normal(0, 4, (256, 2, 2))), -REACH + 2, REACH - 2)
_GRID = np.mgrid[-REACH : REACH + 1, -REACH : REACH + 1].reshape(2, -1)
_DISC = _GRID[:, (_GRID**2).sum(0) <= REACH**2]


def resize(image: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear."""
    if scale == 1:
        return image
    h, w = (max(1, int(n * scale)) for n in image.shape)
    y, x = (np.clip((np.arange(n) + 0.5) / scale - 0.5, 0, m - 1) for n, m in ((h, image.shape[0]), (w, image.shape[1])))
    y0, x0 = (np.minimum(v.astype(int), m - 2).clip(0) for v, m in ((y, image.shape[0]), (x, image.shape[1])))
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top, bottom = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx, image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + bottom * fy


def smooth(image: np.ndarray, k: int) -> np.ndarray:
    """Mean over (2k+1) x (2k+1), edges repeated."""
    p = np.pad(image, k, mode="edge")
    c = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    n = 2 * k + 1
    return (c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]) / (n * n)


def corners(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (y, x) of all local maxima of the smaller eigenvalue of the structure tensor above a share of the largest."""
    gy, gx = np.gradient(image)
    a, b, c = smooth(gx * gx, 2), smooth(gx * gy, 2), smooth(gy * gy, 2)
    least = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    inner = least[1:-1, 1:-1]
    best = np.max([least[dy : dy + inner.shape[0], dx : dx + inner.shape[1]] for dy in range(3) for dx in range(3)], axis=0)
    y, x = np.nonzero((inner == best) & (inner > 0.02 * max(least.max(), 1e-9)))
    y, x = y + 1, x + 1
    fits = (y >= REACH) & (x >= REACH) & (y < image.shape[0] - REACH) & (x < image.shape[1] - REACH)
    return y[fits], x[fits]


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 4) unsigned 64-bit descriptors and (n, 4) geometry: x, y at full size, scale, angle."""
    bits, geometry = [], []
    for scale in SCALES:
        own = resize(image.astype(np.float64), scale)
        if min(own.shape) <= 2 * REACH + 2:
            continue
        y, x = corners(own)
        if not len(y):
            continue
        patch = own[y[:, None] + _DISC[0], x[:, None] + _DISC[1]]
        angle = np.arctan2((patch * _DISC[0]).sum(1), (patch * _DISC[1]).sum(1))
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        ty, tx = _TESTS[None, :, :, 0], _TESTS[None, :, :, 1]
        dy, dx = (np.clip(np.rint(v), -REACH, REACH).astype(int) for v in (tx * sin + ty * cos, tx * cos - ty * sin))
        soft = smooth(own, 2)
        value = soft[y[:, None, None] + dy, x[:, None, None] + dx]
        bits.append(np.packbits(value[:, :, 0] < value[:, :, 1], axis=1))
        geometry.append(np.stack([(x + 0.5) / scale, (y + 0.5) / scale, np.full(len(x), scale), angle], axis=1))
    if not bits:
        return np.zeros((0, 4), np.uint64), np.zeros((0, 4))
    return np.ascontiguousarray(np.concatenate(bits)).view(np.uint64), np.concatenate(geometry)


def keys_of(bits: np.ndarray) -> np.ndarray:
    """(n, TABLES) table keys of descriptors: the words of each, hashed with the table's number."""
    own = bits ^ np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    own = (own ^ own >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)  # one-to-one, so equal keys are equal words
    return (own ^ own >> np.uint64(29)).view(np.int64)


def features(pictures: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """A row per corner and table: media_id, corner, key, x, y, scale, angle of (media_id, width, height, pixels); of keys
    outside ``wanted`` none."""
    held = pictures.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def each(batches):
        test = np.unpackbits(held.value).view(bool) if held else None
        for batch in batches:
            for at in range(0, len(batch), 64):
                part, found = batch.slice(at, 64), []
                for media_id, width, height, pixels in zip(*(part.column(c) for c in range(4)), strict=True):
                    image = np.frombuffer(pixels.as_buffer(), dtype=np.uint8).reshape(height.as_py(), width.as_py())
                    bits, geometry = describe(image)
                    keys = keys_of(bits)
                    corner, table = np.nonzero(test[slot(keys.ravel())].reshape(keys.shape) if held else np.ones(keys.shape, dtype=bool))
                    found.append((np.full(len(corner), media_id.as_py()), corner.astype(np.int32), keys[corner, table], *geometry[corner].T))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["media_id", "corner", "key", "x", "y", "scale", "angle"])

    return pictures.mapInArrow(each, "media_id long, corner int, key long, x double, y double, scale double, angle double")


def classes(pictures: DataFrame) -> DataFrame:
    """media_id, digest: equal where size and pixels are. Unusable pictures (null id or pixels, sizes that do not fit) have
    none."""
    return _fine(pictures).select("media_id", F.sha2(F.concat(F.col("pixels"), F.encode(F.concat_ws("x", "width", "height"), "utf-8")), 256).alias("digest"))


def _fine(pictures: DataFrame) -> DataFrame:
    return pictures.filter("media_id IS NOT NULL AND pixels IS NOT NULL AND width > 0 AND height > 0 AND length(pixels) = width * height")


def agreement(corner: np.ndarray, zoom: np.ndarray, turn: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> tuple[int, int]:
    """How many corners agree with the placement that most do, and which meeting has it (the first on ties). Each meeting's
    placement is tried, so none is cut off by a border of cells."""
    best = (0, 0)
    for i in range(len(corner)):
        away = np.abs(turn - turn[i]) % (2 * np.pi)
        near = (np.abs(zoom - zoom[i]) <= ZOOM) & (np.minimum(away, 2 * np.pi - away) <= TURN) & (np.abs(dx - dx[i]) <= SHIFT) & (np.abs(dy - dy[i]) <= SHIFT)
        n = len(np.unique(corner[near]))
        if n > best[0]:
            best = (n, i)
    return best


def consensus(met: DataFrame, least: int) -> DataFrame:
    """q, c, corners, zoom, turn, dx, dy: the placement that most corners of a pair agree on, if ``least`` do. The rows of one
    pair are at most the product of two pictures' corners."""

    def each(batches):
        held = None  # rows of the last pair, which the next batch may go on with
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            q, c = rows["q"].to_numpy(), rows["c"].to_numpy()
            cuts = np.flatnonzero((q[1:] != q[:-1]) | (c[1:] != c[:-1])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            held = rows.slice(last)
            yield judged(rows.slice(0, last), cuts[:-1])
        if held is not None:
            yield judged(held, np.zeros(0, dtype=np.int64))

    def judged(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        columns = [rows[c].to_numpy() for c in ("q", "c", "q_corner", "zoom", "turn", "dx", "dy")]
        out = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
            if b - a >= least:
                n, i = agreement(*(x[a:b] for x in columns[2:]))
                if n >= least:
                    out.append((columns[0][a], columns[1][a], n, *(float(x[a + i]) for x in columns[3:])))
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["q", "c", "corners", "zoom", "turn", "dx", "dy"])

    order = ["q", "c", "q_corner", "zoom", "turn", "dx", "dy"]
    dealt = met.select(*order).repartition("q", "c").sortWithinPartitions(*order)
    return dealt.mapInArrow(each, "q long, c long, corners int, zoom double, turn double, dx double, dy double")


def find_copies(pictures: DataFrame, queries: DataFrame, *, least: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """(membership: media_id, class_id; the queries' membership: query_id, query_class; links: query_class, class_id, corners,
    zoom, turn, dx, dy) and the folder that holds them. Close it when done.

    A link says that at least ``least`` corners of the query agree on one placement in the pictures of a class. Equal pictures
    are one class, named by the smallest id, so a picture with many copies is described and joined once, on both sides; a row
    that repeats an id with another picture is in the class of each. Pictures without corners, empty tables and unusable
    pictures (null id or pixels, sizes that do not fit) give no links, unusable ones no class; other columns are not read.
    """
    scratch = Scratch(pictures.sparkSession, "media")

    def grouped(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        marked = scratch.table(classes(df), f"{name}-marked")
        firsts = scratch.table(marked.groupBy("digest").agg(F.min("media_id").alias("class_id")), f"{name}-firsts")
        members = scratch.table(marked.join(firsts, "digest").select("media_id", "class_id").distinct(), f"{name}-members")
        rows = _fine(df.select("media_id", "width", "height", "pixels"))
        return members, rows.join(firsts.select(F.col("class_id").alias("media_id")).distinct(), "media_id", "left_semi")

    def spread(df: DataFrame, name: str, wanted: np.ndarray | None = None) -> DataFrame:
        return features(df, wanted).select("key", F.col("media_id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("corner", "x", "y", "scale", "angle")))

    members, shown = grouped(pictures, "c")
    asked, asking = grouped(queries, "q")
    q = scratch.table(spread(asking, "q"), "queries")
    # what no query can meet is held back where it is described; the join says the rest
    met = q.join(spread(shown, "c", bit_filter(q.select("key"))), "key")
    turn, ratio = F.col("c_angle") - F.col("q_angle"), F.col("q_scale") / F.col("c_scale")
    dx = F.col("c_x") - ratio * (F.col("q_x") * F.cos(turn) - F.col("q_y") * F.sin(turn))
    dy = F.col("c_y") - ratio * (F.col("q_x") * F.sin(turn) + F.col("q_y") * F.cos(turn))
    # corners that meet in several tables say the same
    placed = met.select("q", "c", "q_corner", "c_corner", F.log2(ratio).alias("zoom"), turn.alias("turn"), dx.alias("dx"), dy.alias("dy")).dropDuplicates(["q", "c", "q_corner", "c_corner"])
    links = consensus(placed, least).select(F.col("q").alias("query_class"), F.col("c").alias("class_id"), "corners", "zoom", "turn", "dx", "dy")
    return members, asked.select(F.col("media_id").alias("query_id"), F.col("class_id").alias("query_class")), scratch.table(links, "links"), scratch


def texture(seed: bytes, side: int = 64, cells: int = 22) -> np.ndarray:
    """A deterministic picture for a seed: a smooth random field, in 0..255."""
    random = np.random.default_rng(int.from_bytes(hashlib.sha256(seed).digest()[:8], "little"))
    coarse = random.integers(0, 256, (cells, cells)).astype(np.float64)
    return np.clip(resize(coarse, side / cells), 0, 255).astype(np.uint8)


def edited(image: np.ndarray, trim: int = 8) -> np.ndarray:
    """Cropped on two sides and with brightness and contrast changed."""
    return np.clip(image[trim:, : image.shape[1] - trim].astype(np.float64) * 0.85 + 18, 0, 255).astype(np.uint8)


def textures_of(vectors: DataFrame, id_col: str, vector_col: str, edit: bool = False) -> DataFrame:
    """media_id, width, height, pixels: a picture for each vector, equal for equal vectors. Stands in for a table of media."""

    def draw(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                ids, pixels = batch.column(0).slice(at, 256), []
                for vec in batch.column(1).slice(at, 256).to_pylist():
                    own = texture(np.asarray([np.nan if v is None else v for v in vec or ()], dtype="<f8").tobytes())
                    own = edited(own) if edit else own
                    pixels.append(own.tobytes())
                h, w = own.shape
                yield pa.RecordBatch.from_arrays([ids, pa.array([w] * len(ids), pa.int32()), pa.array([h] * len(ids), pa.int32()), pa.array(pixels, pa.binary())], names=["media_id", "width", "height", "pixels"])

    return vectors.select(F.col(id_col).cast("long"), vector_col).mapInArrow(draw, "media_id long, width int, height int, pixels binary")
