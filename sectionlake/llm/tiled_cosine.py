"""Near-duplicate vectors by PCA-ordered tiled comparison with suffix-norm bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.llm.common import components, written
from sectionlake.session import ship_package

LEAST = 0.98
#: Rows in a tile: a task holds two tiles, and the products of one with BLOCK rows of the other.
TILE, BLOCK = 2048, 512
#: Above so many strips their sizes are joined by a shuffle, not broadcast.
MOST_BROADCAST = 1_000_000
_SLACK = 1e-9


def second_moments(vectors: DataFrame, column: str) -> dict[int, np.ndarray]:
    """The sum of x xT of all unit vectors, by dimension; partial sums are made where the rows are."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in _stacked(batch.column(0)):
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["d", "m"])

    parts = vectors.select(column).mapInArrow(run, "d int, m array<double>")
    cells = parts.select("d", F.posexplode("m").alias("i", "x")).groupBy("d", "i").agg(F.sum("x").alias("x"))
    rows = cells.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).collect()  # d * d numbers for each dimension
    return {r["d"]: np.array([x["x"] for x in r["m"]]).reshape(r["d"], r["d"]) for r in rows}


def _stacked(lists: pa.Array) -> list[tuple[int, np.ndarray]]:
    """The vectors of a list column as unit rows, one matrix for each dimension, in order."""
    sizes = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        x = flat[(starts[at][:, None] + np.arange(d)).reshape(-1)].reshape(len(at), d)
        out.append((d, _unit(x)))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares finite and above zero
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotations(moments: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Principal axes as columns, the largest first."""
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in moments.items()}


def close_pairs(a: np.ndarray, b: np.ndarray, least: float, leading: int = 8):
    """Index pairs (i of a, j of b) whose rows' product is at least `least`, block by block of b.

    Rows are unit vectors in principal axes. The leading dimensions of a block are multiplied as a
    tile; what the others can add is at most the product of the two suffix norms, and pairs that
    can't reach `least` with it stop there. The rest go on dimension block by dimension block under
    the same bound, and those that are left have their whole product.
    """
    d = a.shape[1]
    cuts = sorted({min(d, leading * 2**k) for k in range(max(1, d).bit_length() + 1)})
    rest_a = {c: np.sqrt(np.maximum(0.0, (a[:, c:] ** 2).sum(axis=1))) for c in cuts}
    rest_b = {c: np.sqrt(np.maximum(0.0, (b[:, c:] ** 2).sum(axis=1))) for c in cuts}
    for low in range(0, len(b), BLOCK):
        part = b[low : low + BLOCK]
        first = cuts[0]
        product = a[:, :first] @ part[:, :first].T
        i, j = np.nonzero(product + rest_a[first][:, None] * rest_b[first][None, low : low + BLOCK] >= least - _SLACK)
        found = product[i, j]
        for start, end in zip(cuts, cuts[1:]):
            if not len(i):
                break
            more = np.empty_like(found)
            for at in range(0, len(i), 65_536):
                k = slice(at, at + 65_536)
                more[k] = np.einsum("ij,ij->i", a[i[k], start:end], part[j[k], start:end])
            found = found + more
            on = found + rest_a[end][i] * rest_b[end][low + j] >= least - _SLACK
            i, j, found = i[on], j[on], found[on]
        yield i, j + low


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (i, j)."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            return low


def similar_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", least: float = LEAST) -> DataFrame:
    """n_links, component_id and kept of every vector: links join vectors of one label with cosine >= `least`.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor do
    those with a null label; vectors of unlike length aren't compared. Each has n_links 0 and its own
    key as component_id. Equal vectors of a label are one class, compared once with its size (keys
    are whole numbers; rows that repeat one count as vectors of their own but share the component).
    Null keys link with nothing. An empty table gives no rows; other columns are not read.

    Classes are rotated to the principal axes of all vectors. A cosine of `least` bounds the distance
    of unit vectors, so their first coordinates differ by at most sqrt(2 - 2 least): strips of that
    width need comparing with themselves and the next one only. Strips are dealt to tiles of at most
    about TILE rows by a hash, and each pair of tiles is a task of its own, so a label with a third
    of all rows is many bounded tasks. A task counts the links of its rows and returns, instead of
    the links, a forest that connects the same rows; cosines are checked in double precision.
    """
    ship_package(vectors.sparkSession)
    x = F.col(vector).cast("array<double>")
    fine = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    group = F.col(label) if label else F.lit(0)
    rows = vectors.select(F.col(key).alias("_id"), group.alias("_label"), x.alias("_x")).where(fine & F.col("_id").isNotNull() & F.col("_label").isNotNull())
    rows = rows.select("_id", "_label", "_x", F.struct(F.xxhash64("_label", "_x"), F.xxhash64("_x", F.lit(1), "_label")).alias("_class"))
    classes = rows.groupBy("_class").agg(F.min(F.struct("_id", "_label")).alias("_r"), F.count("*").alias("_m"), F.any_value("_x").alias("_x"))
    classes = written(classes.select("_class", F.col("_r._id").alias("_rep"), F.col("_r._label").alias("_label"), "_m", "_x"), "classes")
    linked, forest = _linked_classes(classes, least)
    known = components(forest).select(F.col("node").alias("_rep"), F.col("component").alias("_low"))
    told = classes.select("_class", "_rep", "_m").join(linked, "_rep", "left").join(known, "_rep", "left")
    told = told.select("_class", (F.col("_m") - 1 + F.coalesce("_n", F.lit(0))).alias("_links"), F.coalesce("_low", "_rep").alias("_low"))
    own = rows.select("_id", "_class").join(told, "_class").groupBy("_id").agg(F.max("_links").alias("_links"), F.min("_low").alias("_low"))
    out = vectors.select(F.col(key).alias("_key")).join(own, F.col("_key") == F.col("_id"), "left")
    low = F.coalesce("_low", "_key")
    return out.select(F.col("_key").alias(key), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), low.alias("component_id"), (F.col("_key").isNull() | (low == F.col("_key"))).alias("kept"))


def _linked_classes(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(_rep, _n: rows of other classes linked) and forest links (a, b) of the classes."""
    axes = rotations(second_moments(classes, "_x"))
    width = float(np.sqrt(max(0.0, 2 - 2 * least))) * (1 + 1e-9) + 1e-12

    def rotate(batches):
        for batch in batches:
            x = batch.column("_x")
            sizes = np.asarray(x.value_lengths())
            coords, strip = [None] * len(x), np.zeros(len(x), dtype=np.int64)
            for d, unit in _stacked(x):
                at = np.flatnonzero(sizes == d)
                p = unit @ axes[d]
                strip[at] = np.floor(p[:, 0] / width).astype(np.int64)
                for i, row in zip(at.tolist(), p):
                    coords[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("_rep"), batch.column("_label"), batch.column("_m"), pa.array(sizes.astype(np.int32)), pa.array(strip), pa.array(coords, pa.list_(pa.float64()))], names=["_rep", "_label", "_m", "_d", "_strip", "_p"])

    kinds = dict(classes.dtypes)
    placed = classes.select("_rep", "_label", "_m", "_x").mapInArrow(rotate, f"_rep {kinds['_rep']}, _label {kinds['_label']}, _m long, _d int, _strip long, _p array<double>")
    placed = written(placed, "placed")
    strips = placed.groupBy("_label", "_d", "_strip").agg(F.count("*").alias("n"))
    tiles = written(strips.select("_label", "_d", "_strip", F.ceil(F.col("n") / TILE).cast("int").alias("_k")), "strips")
    above = tiles.select("_label", "_d", (F.col("_strip") - 1).alias("_strip"), F.col("_k").alias("_above"))
    below = tiles.select("_label", "_d", (F.col("_strip") + 1).alias("_strip"), F.col("_k").alias("_below"))
    sizes = tiles.join(above, ["_label", "_d", "_strip"], "left").join(below, ["_label", "_d", "_strip"], "left")
    small = tiles.count() <= MOST_BROADCAST
    rows = placed.join(F.broadcast(sizes) if small else sizes, ["_label", "_d", "_strip"])
    rows = rows.withColumn("_tile", F.pmod(F.xxhash64("_rep"), "_k").cast("int"))
    #: A row's units: its tile with each tile of its strip (the lower first), with those of the next strip, and with those of the one before.
    unit = lambda strip, a, to, b, side: F.struct(strip.alias("s"), a.alias("a"), to.alias("t"), b.alias("b"), side.alias("side"))
    here, tile = F.col("_strip"), F.col("_tile")
    inside = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: unit(here, F.least(o, tile), here, F.greatest(o, tile), F.when(tile <= o, 0).otherwise(1)))
    up = F.transform(F.sequence(F.lit(0), F.coalesce("_above", F.lit(0))), lambda o: F.when(o < F.coalesce("_above", F.lit(0)), unit(here, tile, here + 1, o, F.lit(0))))
    down = F.transform(F.sequence(F.lit(0), F.coalesce("_below", F.lit(0))), lambda o: F.when(o < F.coalesce("_below", F.lit(0)), unit(here - 1, o, here, tile, F.lit(1))))
    units = F.filter(F.concat(inside, up, down), lambda u: u.isNotNull())
    dealt = rows.select("_rep", "_m", "_label", "_d", "_p", F.explode(units).alias("_u"))

    rep_kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kinds["_rep"]]

    def compare(unit_rows: pa.Table) -> pa.Table:
        own = unit_rows.combine_chunks()
        side = own.column("side").to_numpy()
        rep, m = own.column("_rep").to_numpy(), own.column("_m").to_numpy()
        d = own.column("_d")[0].as_py()
        p = own.column("_p").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(right)
        if alone:
            right = left
        links, parts = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
        if len(left) and len(right):
            for i, j in close_pairs(p[left], p[right], least):
                if alone:
                    i, j = i[i < j], j[i < j]
                i, j = left[i], right[j]
                exact = np.empty(len(i), dtype=bool)
                for at in range(0, len(i), 65_536):
                    k = slice(at, at + 65_536)
                    exact[k] = np.einsum("ij,ij->i", p[i[k]], p[j[k]]) >= least
                i, j = i[exact], j[exact]
                links += np.bincount(i, weights=m[j], minlength=len(rep)).astype(np.int64) + np.bincount(j, weights=m[i], minlength=len(rep)).astype(np.int64)
                keep = parts[i] != parts[j]
                if keep.any():
                    low = _forest(len(rep), parts[i[keep]], parts[j[keep]])
                    parts = low[parts]
        told = np.flatnonzero(links > 0)
        return pa.table([pa.array(rep[told], rep_kind), pa.array(links[told], pa.int64()), pa.array(rep[parts[told]], rep_kind)], names=["_rep", "_n", "_with"])

    flat = dealt.select("_rep", "_m", "_label", "_d", "_p", "_u.s", "_u.a", "_u.t", "_u.b", "_u.side")
    # A unit that compares a tile with itself gets each row once, on side 0.
    key = ["_label", "_d", "s", "a", "t", "b"]
    done = flat.groupBy(*key).applyInArrow(compare, f"_rep {kinds['_rep']}, _n long, _with {kinds['_rep']}")
    done = written(done, "linked")
    return done.groupBy("_rep").agg(F.sum("_n").alias("_n")), done.select(F.col("_rep").alias("a"), F.col("_with").alias("b"))


def op7_tiled_cosine(spark, sf_dir: str) -> DataFrame:
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {LEAST}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, least(a, min(b)) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""

QUERIES = {"op7_tiled_cosine": op7_tiled_cosine}
ORACLE_SQL = {"op7_tiled_cosine": OP7_SQL}
