"""Near-duplicate documents: DartMinHash signatures of word shingles, banded candidates, exact similarity, classes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectionlake.llm.common import components, settled, spread_join, written
from sectionlake.llm.token_counts import slices
from sectionlake.session import ship_package

WORD = re.compile(r"[^\W_]+").findall
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, others unrelated ones."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class Darts:
    """DartMinHash for weighted sets.

    Each element has a plane of weight by rank, cut into regions: weights [2^v - 1, 2^(v+1) - 1) by
    ranks [2^r - 1, 2^(r+1) - 1), scaled so that the first is 1 by 1. Hashes of element and region
    throw a Poisson number of darts into it, at hashed places and onto a hashed coordinate. A set
    sees the darts below its elements' weights; of each coordinate's darts it keeps the one of least
    rank. Two sets agree on a coordinate with the probability of their weighted Jaccard similarity.
    Only ranks up to about k (ln k + 3) / (total weight) need darts, so a set of any size throws a
    few thousand; where a coordinate stays empty the bound is doubled for that set.
    """

    def __init__(self, coordinates: int = 130):
        self.k = coordinates
        self.first = coordinates * (np.log(coordinates) + 3)

    @staticmethod
    def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
        """Poisson numbers from uniform ones, by the inverse of the distribution."""
        most = int(mean + 12 * np.sqrt(mean) + 20)
        terms = -mean + np.arange(most) * np.log(mean) - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most)))])
        return np.searchsorted(np.cumsum(np.exp(terms)), u)

    def signatures(self, elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
        """k values for each of the sets; elements are 64-bit hashes, owner the (ascending) set of each."""
        out = np.zeros((sets, self.k), dtype=np.uint64)
        total = np.bincount(owner, weights=weights, minlength=sets)
        todo, bound = np.flatnonzero(total > 0), self.first
        while len(todo):
            chosen = np.zeros(sets, dtype=bool)
            chosen[todo] = True
            of = chosen[owner]
            e, w, o = elements[of], weights[of], owner[of]
            most_rank = bound / total
            keys, ranks, values = [], [], []
            for v in range(max(1, int(np.ceil(np.log2(w.max() + 1))))):
                low_w, wide = 2.0**v - 1, 2.0**v
                r = 0
                while True:
                    low_r, long = 2.0**r - 1, 2.0**r
                    here = np.flatnonzero((w > low_w) & (most_rank[o] > low_r))
                    if not len(here):
                        break
                    seed = mix(e[here] + np.full(1, v * 64 + r + 1, dtype=np.uint64) * _MULT[0])
                    n = self._poisson(_unit(mix(seed ^ _MULT[1])), wide * long)
                    which = np.repeat(np.arange(len(here)), n)
                    nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                    dart = mix(seed[which] + (nth + 1).astype(np.uint64) * _MULT[2])
                    rank = low_r + long * _unit(mix(dart ^ _MULT[3]))
                    seen = rank < most_rank[o[here[which]]]
                    if v or wide > 1 or w.min() < 1:
                        seen &= low_w + wide * _unit(mix(dart ^ _MULT[4])) < w[here[which]]
                    dart, rank, own = dart[seen], rank[seen], o[here[which[seen]]]
                    keys.append(own * self.k + (mix(dart) % np.uint64(self.k)).astype(np.int64))
                    ranks.append(rank)
                    values.append(dart)
                    r += 1
            key, rank, value = np.concatenate(keys), np.concatenate(ranks), np.concatenate(values)
            order = np.lexsort((rank, key))
            key = key[order]
            lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            filled = np.bincount(key[lead] // self.k, minlength=sets)
            whole = filled == self.k
            take = lead[whole[key[lead] // self.k]]
            out.reshape(-1)[key[take]] = value[order[take]]
            todo, bound = todo[~whole[todo]], bound * 2
        return out


#: Texts and bytes of text whose darts are thrown together, and the words whose hashes a worker remembers: they bound a task's memory.
TEXTS, TEXT_BYTES, MOST_WORDS = 256, 512 << 10, 120_000


def word_hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of words, remembered for the next text."""
    import xxhash

    if len(known) > MOST_WORDS:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter text is one run."""
    if not len(hashes):
        return hashes
    width_here = min(width, len(hashes))
    n = len(hashes) - width_here + 1
    out = np.full(n, min(len(hashes), width), dtype=np.uint64) * _MULT[0]
    for i in range(width_here):
        out = mix(out + hashes[i : i + n] * _MULT[1])
    return out


def counted(hashes: np.ndarray, width: int) -> np.ndarray:
    """Shingles as a sorted set in which the second occurrence of one is an element of its own, and so on.

    The Jaccard similarity of such sets is the weighted one of the shingles with their counts.
    """
    own, times = np.unique(shingles(hashes, width), return_counts=True)
    if len(own) and times.max() > 1:
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        own = np.repeat(own, times)
        own = np.where(nth > 0, mix(own + nth.astype(np.uint64) * _MULT[4]), own)
    return np.sort(own.view(np.int64))


def _text_slices(batch: pa.RecordBatch):
    for piece in slices(batch, TEXT_BYTES, 2):
        for low in range(0, piece.num_rows, TEXTS):
            yield piece.slice(low, TEXTS)


def _signed(docs: DataFrame, key: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """A row for each row: _id, _text (the text's MD5), _class (a hash of all words), _bands (one hash for each band), _sign (a byte of each coordinate), _size (shingles).

    _class and what follows are null for null keys and texts without words.
    """

    def run(batches):
        darts, known = Darts(bands * rows), {}
        for batch in batches:
            for piece in _text_slices(batch):
                classes, elements, weights, owner, at = [], [], [], [], []
                for i, (k, t) in enumerate(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist())):
                    h = word_hashes(WORD(t.lower()) if t and k is not None else [], known)
                    if not len(h):
                        classes.append(None)
                        continue
                    place = np.arange(1, len(h) + 1, dtype=np.uint64)
                    both = [np.bitwise_xor.reduce(mix(h * m + place * _MULT[2])) for m in _MULT[:2]]
                    own, times = np.unique(shingles(h, width), return_counts=True)
                    owner.append(np.full(len(own), len(at)))
                    elements.append(own)
                    weights.append(times)
                    at.append(i)
                    classes.append(b"".join(int(x).to_bytes(8, "little") for x in both))
                band_lists, signs_of, sizes = [None] * piece.num_rows, [None] * piece.num_rows, [None] * piece.num_rows
                if at:
                    w = np.concatenate(weights).astype(np.float64)
                    o = np.concatenate(owner)
                    signs = darts.signatures(np.concatenate(elements), w, o, len(at))
                    low = (mix(signs) & np.uint64(255)).astype(np.uint8)
                    signs = signs.reshape(len(at), bands, rows)
                    band = np.zeros((len(at), bands), dtype=np.uint64)
                    for r in range(rows):
                        band = mix(band + signs[:, :, r] * _MULT[3] + np.uint64(r))
                    total = np.bincount(o, weights=w, minlength=len(at)).astype(int).tolist()
                    for n, (i, own) in enumerate(zip(at, band.view(np.int64))):
                        band_lists[i], signs_of[i], sizes[i] = own, low[n].tobytes(), total[n]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(classes, pa.binary()), pa.array(band_lists, pa.list_(pa.int64())), pa.array(signs_of, pa.binary()), pa.array(sizes, pa.int64())],
                    names=["_id", "_text", "_class", "_bands", "_sign", "_size"],
                )

    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    return _keyed(docs, key, text).mapInArrow(run, f"_id {kind}, _text binary, _class binary, _bands array<long>, _sign binary, _size long")


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_id, _text (the MD5 of the text, null: of nothing) and _body."""
    return docs.select(F.col(key).alias("_id"), _digest(F.col(text)).alias("_text"), F.col(text).cast("string").alias("_body"))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _shingled(rows: DataFrame, width: int) -> DataFrame:
    """_node and the counted shingles of its text (_body), sorted."""

    def run(batches):
        known: dict[str, int] = {}
        for batch in batches:
            for piece in slices(batch, TEXT_BYTES):
                sets = [counted(word_hashes(WORD(t.lower()) if t else [], known), width) for t in piece.column(1).to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                flat = np.concatenate([*sets, np.zeros(0, np.int64)])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["_node", "_set"])

    return rows.select("_node", "_body").mapInArrow(run, "_node long, _set array<long>")


#: Members in a tile of a bucket, and the bytes of their sets: a task holds two tiles.
TILE, TILE_BYTES, BLOCK = 2048, 16 << 20, 256
#: Members that a head meets in one task.
MEMBERS = 256
_LINKS = "a long, b long"


def least_agreeing(coordinates: int, least: float) -> int:
    """So many equal coordinates that a pair at similarity `least` has fewer with a chance of 4 in a million."""
    return int(coordinates * least - 4.5 * np.sqrt(coordinates * least * (1 - least)))


def _lists(own: pa.Table, column: str = "_set") -> tuple[np.ndarray, np.ndarray]:
    """A list column as its values one after another, and where each list begins and ends."""
    lists = own.column(column).combine_chunks()
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)


def head_links(own: pa.Table, least: float) -> pa.Table:
    """(a, b) links of one head (side 0) with those members (side 1) of its buckets that are similar to it."""
    flat, ends = _lists(own)
    side, node = own.column("side").to_numpy(), own.column("_node").to_numpy()
    at = int(np.flatnonzero(side == 0)[0])
    head = flat[ends[at] : ends[at + 1]]
    hit = np.searchsorted(head, flat)
    hit = head[np.minimum(hit, len(head) - 1)] == flat
    running = np.concatenate([[0], np.cumsum(hit)])
    common, sizes = running[ends[1:]] - running[ends[:-1]], np.diff(ends)
    near = (side == 1) & (common >= (sizes + len(head) - common) * least - 1e-9)
    return pa.table([pa.array(np.full(int(near.sum()), node[at])), pa.array(node[near])], names=["a", "b"])


def tile_links(own: pa.Table, least: float, bands: int) -> pa.Table:
    """(a, b) links that connect, with those known before, all similar pairs of one pair of tiles.

    Rows have _node, _comp (what earlier links connect), _sign, _bands, _set, _band and side. A pair
    counts here if the tiles' band is the first that it shares, so that it is met once. Pairs of one
    component are skipped; of others the signatures are compared, a byte of each coordinate, and
    what agrees often enough is decided by the sets, the likeliest first.
    """
    ids = own.column("_node").to_numpy()
    comp = np.unique(own.column("_comp").to_numpy(), return_inverse=True)[1]
    sign = np.frombuffer(b"".join(own.column("_sign").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
    band = own.column("_bands").combine_chunks().flatten().to_numpy().reshape(len(ids), bands)
    before = int(own.column("_band")[0].as_py())
    side = own.column("side").to_numpy()
    flat, ends = _lists(own)
    sizes = np.diff(ends)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    right = left if alone else right
    group = np.arange(comp.max() + 1)
    enough = least_agreeing(sign.shape[1], least)
    out: list[tuple[int, int]] = []
    for low in range(0, len(left), BLOCK):
        rows = left[low : low + BLOCK]
        cols = right[low:] if alone else right
        open_ = group[comp[rows]][:, None] != group[comp[cols]][None, :]
        if alone:
            open_ &= rows[:, None] < cols[None, :]
        open_ &= (np.minimum(sizes[rows][:, None], sizes[cols][None, :]) >= np.maximum(sizes[rows][:, None], sizes[cols][None, :]) * least - 1e-9)
        for k in range(before):
            open_ &= band[rows, k][:, None] != band[cols, k][None, :]
        if not open_.any():
            continue
        agree = np.zeros(open_.shape, dtype=np.uint8)
        for k in range(sign.shape[1]):
            agree += sign[rows, k][:, None] == sign[cols, k][None, :]
        i, j = np.nonzero(open_ & (agree >= enough))
        order = np.argsort(-agree[i, j].astype(np.int16), kind="stable")
        for x, y in zip(rows[i[order]].tolist(), cols[j[order]].tolist()):
            if group[comp[x]] == group[comp[y]]:
                continue
            common = len(np.intersect1d(flat[ends[x] : ends[x + 1]], flat[ends[y] : ends[y + 1]], assume_unique=True))
            if common >= (sizes[x] + sizes[y] - common) * least - 1e-9:
                group[group == group[comp[x]]] = group[comp[y]]
                out.append((ids[x], ids[y]))
    return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _parts(count: str, size: str, most: int) -> Column:
    """Tiles of `most` members and TILE_BYTES for so many members with so many shingles in all."""
    return F.greatest(F.ceil(F.col(count) / most), F.ceil(F.col(size) * 8 / TILE_BYTES), F.lit(1)).cast("int")


def _head_links(star: DataFrame, classes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links of bucket heads (_head) with similar members (_node, _size): a head meets a bounded part of its members in a task."""
    heads = written(star.groupBy("_head").agg(F.count("*").alias("_m"), F.sum("_size").alias("_w")).withColumn("_k", _parts("_m", "_w", MEMBERS)), "heads")
    total = heads.agg(F.sum("_m")).first()[0] or 0
    rows = spread_join(star, heads.select("_head", "_m", "_k"), "_head", "_m", total, ["_node"])
    rows = rows.select("_head", F.pmod(F.xxhash64("_node"), "_k").cast("int").alias("_tile"), "_node", F.lit(1).alias("side"))
    own = heads.select("_head", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_tile"), F.col("_head").alias("_node"), F.lit(0).alias("side"))
    return rows.unionByName(own).join(sets, "_node").groupBy("_head", "_tile").applyInArrow(lambda own: head_links(own, least), _LINKS)


def _tiled_links(mixed: DataFrame, classes: DataFrame, sets: DataFrame, least: float, bands: int) -> DataFrame:
    """Links between the components that meet in buckets: each pair of a bucket's tiles is a task of its own."""
    data = sets.join(classes.select("_node", "_sign", "_bands"), "_node")
    weight = mixed.groupBy("_bucket").agg(F.count("*").alias("_m"), F.sum("_size").alias("_w"))
    tiles = written(weight.select("_bucket", "_m", _parts("_m", "_w", TILE).alias("_k")), "tiles")
    total = tiles.agg(F.sum("_m")).first()[0] or 0
    dealt = spread_join(mixed, tiles, "_bucket", "_m", total, ["_node"]).withColumn("_tile", F.pmod(F.xxhash64("_node"), "_k").cast("int"))
    units = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: F.struct(F.least(o, F.col("_tile")).alias("i"), F.greatest(o, F.col("_tile")).alias("j"), F.when(F.col("_tile") <= o, 0).otherwise(1).alias("side")))
    dealt = dealt.select("_bucket", "_band", "_node", "_comp", F.explode(units).alias("_u")).select("_bucket", "_band", "_node", "_comp", "_u.i", "_u.j", "_u.side")
    return dealt.join(data, "_node").groupBy("_bucket", "i", "j").applyInArrow(lambda own: tile_links(own, least, bands), _LINKS)


def _linked_rows(docs: DataFrame, key: str, text: str, width: int, least: float, bands: int, rows: int) -> DataFrame:
    """_id, _text, _class, _low (the first _id and _text of the row's component; null for rows that link with nothing)."""
    signed = written(_signed(docs, key, text, width, bands, rows), "signatures")
    worded = signed.where(F.col("_class").isNotNull())
    first = F.min(F.struct("_id", "_text")).alias("_first")
    classes = worded.groupBy("_class").agg(first, F.count("*").alias("_copies"), F.any_value("_bands").alias("_bands"), F.any_value("_sign").alias("_sign"), F.any_value("_size").alias("_size"))
    classes = written(classes.withColumn("_node", F.monotonically_increasing_id()), "classes")
    cells = classes.select("_node", "_size", F.posexplode("_bands").alias("_band", "_hash")).select("_node", "_size", "_band", F.xxhash64("_band", "_hash").alias("_bucket"))
    counts = written(cells.groupBy("_bucket").agg(F.count("*").alias("_n")).where("_n > 1"), "buckets")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    cells = written(spread_join(cells, counts, "_bucket", "_n", total, ["_node"]), "cells")
    central = cells.groupBy("_node").agg(F.sum("_n").alias("_c"))
    ranked = cells.select("_bucket", "_n", "_node").join(central, "_node")
    heads = written(ranked.groupBy("_bucket").agg(F.first("_n").alias("_n"), F.max_by("_node", F.struct("_c", -F.col("_node"))).alias("_head")), "heads")
    star = spread_join(cells.drop("_n"), heads, "_bucket", "_n", total, ["_node"]).where("_node <> _head")
    star = written(star.select("_head", "_node", "_size").distinct(), "star")
    needed = classes.join(cells.select("_node").distinct(), "_node", "left_semi").select("_node", F.col("_first._id").alias("_id"), F.col("_first._text").alias("_text"))
    # Rows that are equal in key and text give a node's set twice; one stays.
    sets = _shingled(_keyed(docs, key, text).join(needed, ["_id", "_text"]), width)
    again = worded.groupBy("_id", "_text").agg(F.count("*").alias("n")).where("n > 1")
    sets = written(sets if again.isEmpty() else sets.dropDuplicates(["_node"]), "sets")
    links = written(_head_links(star, classes, sets, least), "links")
    known = components(links)
    placed = cells.select("_bucket", "_band", "_node", "_size").join(known.withColumnRenamed("node", "_node"), "_node", "left")
    placed = written(placed.select("_bucket", "_band", "_node", "_size", F.coalesce("component", "_node").alias("_comp")), "placed")
    several = placed.groupBy("_bucket").agg(F.count("*").alias("_n"), F.min("_comp").alias("_least"), F.max("_comp").alias("_most")).where("_least <> _most").select("_bucket", "_n")
    several = written(several, "several")
    mixed = written(spread_join(placed, several, "_bucket", "_n", total, ["_node"], "left_semi"), "mixed")
    more = written(_tiled_links(mixed, classes, sets, least, bands), "more")
    known = components(links.union(more)).select(F.col("node").alias("_node"), F.col("component").alias("_comp"))
    grouped = written(classes.select("_node", "_class", "_first", "_copies").join(known, "_node", "left").withColumn("_comp", F.coalesce("_comp", "_node")), "grouped")
    lows = written(grouped.groupBy("_comp").agg(F.min("_first").alias("_low"), F.count("*").alias("_n")), "lows")
    n_classes = lows.agg(F.sum("_n")).first()[0] or 0
    told = written(spread_join(grouped, lows, "_comp", "_n", n_classes, ["_node"]).select("_class", "_copies", "_low"), "told")
    n_rows = told.agg(F.sum("_copies")).first()[0] or 0
    found = spread_join(worded.select("_id", "_text", "_class"), told, "_class", "_copies", n_rows, ["_id", "_text"]).select("_id", "_text", "_low")
    rest = signed.where(F.col("_class").isNull()).select("_id", "_text", F.lit(None).cast(found.schema["_low"].dataType).alias("_low"))
    return found.unionByName(rest)


def near_duplicate_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, bands: int = 26, rows: int = 5) -> DataFrame:
    """component_id (the smallest key reachable) and kept (whether the row is its component's first) for every row's key.

    Words are runs of letters and digits in lower case; two texts are near if the Jaccard similarity
    of their `width`-word shingles, weighed by how often each stands in the text, is at least `least`
    (a text with fewer words is one shingle). Texts with the same words are one class. Signatures of
    bands * rows coordinates make `bands` bucket keys; a pair at 0.8 shares none of 26 buckets of 5
    rows with a chance of 3 in 100,000.

    Buckets never give all their pairs to the shuffle. First every member meets its bucket's most
    central one (the member that shares buckets most often over all bands): an original meets its
    copies, a bounded part of them in a task. Verified pairs join into components. Buckets that still
    hold several components are dealt to tiles; a pair of tiles is compared in one task, by
    signatures and then real sets, and gives back only links between components. So every pair of a
    bucket is decided, and none within a component need be. Hot buckets, classes and nodes are dealt
    over several tasks in every join.

    Keys are whole numbers. Null keys, and null or empty texts and such without words, link with
    nothing: component_id is their own key, kept true. Texts of any length are read whole. Rows that
    repeat a key are texts of their own: a component's first row is the one with the smallest key,
    then the smallest MD5 of the text, and rows equal to it in both are kept too. An empty table
    gives no rows. Only the key and the text are read, so other columns can't clash.
    """
    found = settled(docs.sparkSession, lambda: _linked_rows(docs, key, text, width, least, bands, rows), "rows")
    kept = F.col("_low").isNull() | ((F.col("_low._id") == F.col("_id")) & (F.col("_low._text") == F.col("_text")))
    return found.select(F.col("_id").alias(key), F.coalesce("_low._id", "_id").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, bands: int = 26, rows: int = 5) -> DataFrame:
    """The first row of each component, see near_duplicate_classes, and all rows that link with nothing.

    Of rows that are equal in key and text one stays, whichever. Rows with null keys and texts without
    words all stay. Columns come back as they were, whatever their names.
    """
    found = settled(docs.sparkSession, lambda: _linked_rows(docs, key, text, width, least, bands, rows), "rows").where(F.col("_low").isNotNull())
    first = (F.col("_low._id") == F.col("_id")) & (F.col("_low._text") == F.col("_text"))
    gone = found.where(~first).select("_id", "_text").distinct()
    twice = found.where(first).groupBy("_id", "_text").agg(F.count("*").alias("n")).where("n > 1").select("_id", "_text")
    own = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_id"), _digest(F.col(text)).alias("_text"))
    left = own.join(gone, ["_id", "_text"], "left_anti")
    if not twice.isEmpty():
        twice = written(twice, "twice")
        left = left.join(twice, ["_id", "_text"], "left_anti").unionByName(left.join(twice, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]))
    return left.select("_row.*")


def op2_dart_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicate_classes(docs)


QUERIES = {"op2_dart_minhash": op2_dart_minhash}
ORACLE_SQL: dict[str, str] = {}
