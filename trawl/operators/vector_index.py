"""Exact cosine top-k over an index of clustered tiles.

``similar_chunks_batch`` scores every chunk against every question.  Where one chunk table answers many batches of
questions, an index pays: it is written once and lets most (tile, question) pairs go unscored.

Build (:func:`build_index`):

1. Coarse centres are fitted by spherical k-means on a bounded sample (``SAMPLE`` vectors a centre, at most ``CENTRES``
   centres for each vector length).  They decide speed alone, never the result.
2. Every chunk gets its nearest and second nearest centre; one range shuffle sorts the chunks by them.  A hot cluster
   is split over many tasks, since the sort goes on with the chunk key.
3. Runs of at most ``tile_rows`` chunks of one centre are packed into tiles.  A tile carries its bound: the direction of
   its mean and the least cosine of its chunks with it (the angular radius).

Search (:func:`search_index`), for slices of questions of at most ``SLICE_BYTES``, the only thing that is broadcast:

1. The bounds alone are read: the cosine of a question with any chunk of a tile is at most cos(angle to the centre -
   radius).  The ``FIRST`` tiles with the best bounds are scored first; their k-th score is a floor for the question.
2. Every tile is met with the questions whose bound reaches their floor; a tile that no question can gain from is
   skipped undecoded.  The running k-th score of a task raises the floors as it goes.
3. A window ranks the few survivors.

Order and ties are those of ``similar_chunks_batch`` (similarity rounded to 1e-9, then the chunk key); bounds are
widened by ``SLACK``, so no tie is lost.  Chunks whose vector is NULL, empty, zero or not finite are not indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.operators.retrieve import ORDER_DECIMALS, SCORES, TILE_ROWS, _arrow_type, _ipc, _un_ipc, _unit_rows
from trawl.operators.util import spread
from trawl.session import checkpoint_dir, materialize

CENTRES = 1_024
SAMPLE = 32
SLICE_BYTES = 32 << 20
FIRST = 2
SLACK = 1e-7
NONE = np.iinfo(np.int64).min
_SCALE = 10 ** ORDER_DECIMALS

TILES = T.StructType([
    T.StructField("dim", T.IntegerType()), T.StructField("n", T.IntegerType()),
    T.StructField("centre", T.BinaryType()), T.StructField("radius", T.DoubleType()),
    T.StructField("cols", T.BinaryType()), T.StructField("vecs", T.BinaryType())])


def usable(vec: str):
    """True for vectors with a direction."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


# ---------------------------------------------------------------- build

def fit_centres(unit: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; centres without rows are left out."""
    centres = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = sums[length > 1e-9] / length[length > 1e-9, None]
    return centres


def _nearest_fn(centres: dict[int, np.ndarray], vec: str):
    """Adds the length and the nearest and second nearest centres of every vector."""
    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            near, dims = np.zeros((len(pdf), 2), np.int32), pdf[vec].map(len).to_numpy(np.int32)
            for d in np.unique(dims):
                if len(centres.get(int(d), ())) > 1:
                    at = np.flatnonzero(dims == d)
                    s = _unit_rows(np.stack(pdf[vec].to_numpy()[at])) @ centres[int(d)].T
                    two = np.argpartition(-s, 1, axis=1)[:, :2]
                    swap = np.take_along_axis(s, two, 1)
                    two[swap[:, 0] < swap[:, 1]] = two[swap[:, 0] < swap[:, 1]][:, ::-1]
                    near[at] = two
            yield pdf.assign(_dim=dims, _c1=near[:, 0], _c2=near[:, 1])
    return run


def bound_of(unit: np.ndarray) -> tuple[np.ndarray, float]:
    """The direction of the mean, and the widest angle of a row to it."""
    mean = unit.sum(axis=0)
    size = np.sqrt((mean * mean).sum())
    centre = mean / size if size > 1e-9 else unit[0]
    return centre, float(np.arccos(np.clip((unit @ centre).min(), -1, 1)))


def _tiles_fn(carry: list[str], vec: str, tile_rows: int, schema: pa.Schema):
    """Rows in (length, centre) order to tiles of at most ``tile_rows`` rows of one centre."""
    def emit(pdf: pd.DataFrame) -> dict:
        mat = np.stack(pdf[vec].to_numpy()).astype(np.float32)
        centre, radius = bound_of(_unit_rows(mat))
        return {"dim": mat.shape[1], "n": len(pdf), "centre": centre.tobytes(), "radius": radius,
                "cols": _ipc(pdf[carry], schema), "vecs": mat.tobytes()}

    def run(batches: Iterator[pd.DataFrame]):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            runs = [part for _, part in pdf.groupby(["_dim", "_c1"], sort=False)]
            out = [emit(r.iloc[a:a + tile_rows]) for r in runs[:-1] for a in range(0, len(r), tile_rows)]
            whole = len(runs[-1]) // tile_rows * tile_rows        # the last run may go on in the next batch
            out += [emit(runs[-1].iloc[a:a + tile_rows]) for a in range(0, whole, tile_rows)]
            rest = runs[-1].iloc[whole:] if whole < len(runs[-1]) else None
            if out:
                yield pd.DataFrame(out)
        if rest is not None:
            yield pd.DataFrame([emit(rest)])
    return run


def build_index(chunks: DataFrame, path: str | None = None, *, key_cols=("source_id", "chunk_number"), payload_cols=(),
                vector_col: str = "vector", tile_rows: int = TILE_ROWS, centres: int = CENTRES) -> DataFrame:
    """Write the index of ``chunks`` (to ``path``, or into the shared checkpoint folder) and read it back.

    The index holds the key and payload columns, so searches need the chunk table no more."""
    spark = chunks.sparkSession
    checkpoint_dir(spark)
    key_cols = list(key_cols)
    carry = key_cols + [c for c in payload_cols if c not in key_cols]
    rows = spread(chunks).select(*carry, F.col(vector_col).cast("array<float>").alias(vector_col)).where(usable(vector_col))
    total = rows.count()
    k = max(1, min(centres, -(-total // tile_rows)))
    place = F.pmod(F.xxhash64(*key_cols), F.lit(1 << 30))
    cut = min(1 << 30, int((1.2 * k * SAMPLE + 100) / max(1, total) * (1 << 30)))
    sample = rows.where(place < cut).select(vector_col, place.alias("p")).orderBy("p").limit(k * SAMPLE).collect()
    fitted: dict[int, np.ndarray] = {}
    for d in sorted({len(r[0]) for r in sample}):
        fitted[d] = fit_centres(_unit_rows(np.array([r[0] for r in sample if len(r[0]) == d])), k)
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.IntegerType()) for c in ("_dim", "_c1", "_c2")]])
    placed = rows.mapInPandas(_nearest_fn(fitted, vector_col), schema)
    order = ["_dim", "_c1", "_c2", *key_cols]
    arrow = pa.schema([pa.field(c, _arrow_type(rows.schema[c].dataType)) for c in carry])
    tiles = placed.repartitionByRange(*order).sortWithinPartitions(*order) \
        .mapInPandas(_tiles_fn(carry, vector_col, tile_rows, arrow), TILES) \
        .withColumn("tile", F.monotonically_increasing_id())
    if path is None:
        return materialize(tiles, "vector-index")
    tiles.write.parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- search

def bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(questions x tiles): what no chunk of the tile can exceed."""
    angle = np.arccos(np.clip(q @ centres.T, -1, 1))
    return np.cos(np.maximum(angle - radius[None, :] - SLACK, 0)) + SLACK


class Scan:
    """Tiles against a slice of questions; ``floor`` is the least rounded similarity that can still matter.

    ``scored`` and ``met`` count the pairs of a tile and a question that were scored, and all of them."""

    def __init__(self, numbers: np.ndarray, unit: np.ndarray, floor: np.ndarray, k: int | None):
        self.numbers, self.unit, self.floor, self.k = numbers, unit, floor.copy(), k
        self.best = None if k is None else np.full((len(unit), k), NONE)
        self.scored = self.met = 0

    def alive(self, centre: bytes, radius: float) -> np.ndarray:
        b = bounds(self.unit, np.frombuffer(centre, np.float64)[None, :], np.array([radius]))[:, 0]
        self.met += len(b)
        return np.flatnonzero(np.floor(b * _SCALE) + 1 >= self.floor)

    def raised(self, who: np.ndarray, order: np.ndarray) -> None:
        """Merge a tile's scores into the best k of the questions ``who``."""
        if self.k is None:
            return
        both = np.concatenate([self.best[who], order], axis=1)
        self.best[who] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k:]
        self.floor[who] = np.maximum(self.floor[who], self.best[who].min(axis=1))

    def tile(self, row, who: np.ndarray | None = None):
        """Blocks of (questions, chunks of the tile, similarity, rounded similarity) that reach the floors."""
        who = self.alive(row.centre, row.radius) if who is None else who
        self.scored += len(who)
        if not len(who):
            return
        chunks = _unit_rows(np.frombuffer(row.vecs, np.float32).reshape(row.n, row.dim)).T
        for a in range(0, len(who), max(1, SCORES // row.n)):
            own = who[a:a + max(1, SCORES // row.n)]
            s = self.unit[own] @ chunks
            order = np.rint(s * _SCALE).astype(np.int64)
            self.raised(own, order)
            q, c = np.nonzero(order >= self.floor[own][:, None])
            yield own[q], c, s[q, c], order[q, c]


def _best_tiles_fn(shared, first: int):
    """Of each question, the tiles with the best bounds among those of the task."""
    def run(batches):
        _, unit = shared.value
        bound, tile = np.full((len(unit), first), -np.inf), np.full((len(unit), first), -1)
        for pdf in batches:
            pdf = pdf[pdf["dim"] == unit.shape[1]]
            block = max(1, SCORES // len(unit))
            for a in range(0, len(pdf), block):
                part = pdf.iloc[a:a + block]
                b = bounds(unit, np.stack([np.frombuffer(x, np.float64) for x in part["centre"]]), part["radius"].to_numpy())
                bb = np.concatenate([bound, b], axis=1)
                tt = np.concatenate([tile, np.broadcast_to(part["tile"].to_numpy(), b.shape)], axis=1)
                top = np.argsort(-bb, axis=1, kind="stable")[:, :first]
                bound, tile = np.take_along_axis(bb, top, 1), np.take_along_axis(tt, top, 1)
        q, f = np.nonzero(tile >= 0)
        yield pd.DataFrame({"q": q, "tile": tile[q, f], "bound": bound[q, f]})
    return run


def _floors_fn(shared, k: int, floor: int):
    """The best k rounded similarities of each question in its first tiles."""
    def run(batches):
        numbers, unit = shared.value
        scan = Scan(numbers, unit, np.full(len(unit), floor), k)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                for _ in scan.tile(row, np.asarray(row.qs, np.int64)):
                    pass
        q, c = np.nonzero(scan.best > NONE)
        yield pd.DataFrame({"q": q, "ord": scan.best[q, c]})
    return run


def _scan_fn(shared, floors, k: int | None, out_cols: list[str]):
    def run(batches):
        numbers, unit = shared.value
        scan = Scan(numbers, unit, floors.value, k)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                for q, c, s, order in scan.tile(row) if row.dim == unit.shape[1] else ():
                    if len(q):
                        keep = _un_ipc(row.cols).iloc[c].reset_index(drop=True)
                        yield keep.assign(_qn=numbers[q], similarity=s, _ord=order)[out_cols]
    return run


def search_index(index: DataFrame, questions: DataFrame, k: int | None = 3, threshold: float | None = None, *,
                 key_cols=("source_id", "chunk_number"), payload_cols=(), schema: T.StructType | None = None,
                 q_cols=("q_id",), q_vector: str = "qvec", chunks: DataFrame | None = None,
                 slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per question, the ``k`` chunks of highest cosine similarity (>= threshold): the rows of ``similar_chunks_batch``.

    The types of the key and payload columns are taken from ``schema`` or from the schema of ``chunks``."""
    spark = index.sparkSession
    sc = spark.sparkContext
    checkpoint_dir(spark)
    key_cols, q_cols = list(key_cols), list(q_cols)
    carry = key_cols + [c for c in payload_cols if c not in key_cols]
    types = schema if schema is not None else chunks.schema
    asked = materialize(questions.select(*q_cols, F.col(q_vector).cast("array<float>").alias("_qvec")).where(usable("_qvec"))
                        .withColumn("_qn", F.monotonically_increasing_id()), "index-questions")
    sizes = asked.groupBy(F.size("_qvec").alias("d")).count().orderBy("d").collect()    # one row a vector length
    fields = [types[c] for c in carry]
    found_schema = T.StructType([*fields, T.StructField("_qn", T.LongType()), T.StructField("similarity", T.DoubleType()),
                                 T.StructField("_ord", T.LongType())])
    least = NONE if threshold is None else int(np.floor(threshold * _SCALE)) - 1
    parts = []
    for d, n in [(r["d"], r["count"]) for r in sizes]:
        slices = max(1, -(-n * d * 8 // slice_bytes))
        for s in range(slices):
            own = asked.where((F.size("_qvec") == d) & (F.pmod(F.xxhash64("_qn"), F.lit(slices)) == s)) \
                .select("_qn", "_qvec").collect()                 # at most about slice_bytes
            if not own:
                continue
            shared = sc.broadcast((np.array([r[0] for r in own], np.int64), _unit_rows(np.array([r[1] for r in own], np.float32))))
            floors = np.full(len(own), least)
            if k is not None:
                floors = np.maximum(floors, _first_floors(index, shared, len(own), k, least))
            parts.append(index.select("dim", "n", "centre", "radius", "cols", "vecs")
                         .mapInPandas(_scan_fn(shared, sc.broadcast(floors), k, found_schema.names), found_schema))
    if not parts:
        out = spark.createDataFrame([], found_schema)
    else:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
    if threshold is not None:
        out = out.where(F.col("similarity") >= threshold)
    w = Window.partitionBy("_qn").orderBy(F.col("_ord").desc(), *[F.col(c).asc() for c in key_cols])
    ranked = out.withColumn("rank", F.row_number().over(w))
    if k is not None:
        ranked = ranked.where(F.col("rank") <= k)
    return ranked.join(asked.drop("_qvec"), "_qn").select(*q_cols, *carry, "similarity", "rank")


def _first_floors(index: DataFrame, shared, n: int, k: int, least: int) -> np.ndarray:
    """The k-th rounded similarity of each question in its ``FIRST`` tiles; ``NONE`` where they hold fewer."""
    best = index.select("tile", "dim", "centre", "radius").mapInPandas(_best_tiles_fn(shared, FIRST), "q long, tile long, bound double")
    w = Window.partitionBy("q").orderBy(F.desc("bound"), "tile")
    first = best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= FIRST)
    visits = materialize(first.groupBy("tile").agg(F.collect_list("q").alias("qs")), "index-visits")
    scores = index.select("tile", "dim", "n", "vecs").join(visits, "tile") \
        .mapInPandas(_floors_fn(shared, k, least), "q long, ord long")
    w = Window.partitionBy("q").orderBy(F.desc("ord"))
    kth = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("q", "ord").collect()
    out = np.full(n, NONE)
    out[[r[0] for r in kth]] = [r[1] for r in kth]
    return out
