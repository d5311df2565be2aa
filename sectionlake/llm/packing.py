"""Packing documents into token sequences by best-two-fit, planned over the histogram of lengths."""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sectionlake.session import ship_package
from sectionlake.llm.bpe import byte_alphabet, latin_classes
from sectionlake.llm.common import local_file, ship_file, written
from sectionlake.llm.token_counts import slices

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048


class WordIds:
    """Token ids of texts as little-endian unsigned 32-bit bytes, through a bounded memory of words.

    The library's own model encodes each word that isn't remembered. Splitting follows the file's
    rules; texts with signs beyond U+024F are split by the library's splitter.
    """

    def __init__(self, path: str, most_words: int = 500_000):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most_words
        self.alphabet = byte_alphabet()
        letters, numbers = latin_classes()
        white = "\\t-\\r \\x85\\xa0"
        self.plain = re.compile("[\\u0000-\\u024f]*").fullmatch
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{white}{letters}{numbers}]+|[{white}]+(?![^{white}])|[{white}]+").findall
        added = self.library.get_added_tokens_decoder()
        self.ends = {token.content: int(i).to_bytes(4, "little") for i, token in added.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(self.ends, key=len, reverse=True))))
        self.mapped: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _model(self, mapped: str) -> bytes:
        return np.array([t.id for t in self.library.model.tokenize(mapped)], dtype="<u4").tobytes()

    def _segment(self, text: str) -> bytes:
        if self.plain(text):
            words, look = self.words(text), self.known.__getitem__
            try:
                return b"".join(map(look, words))
            except KeyError:
                for w in [w for w in set(words) if w not in self.known]:
                    self.known[w] = self._model("".join([self.alphabet[b] for b in w.encode()]))
            return b"".join(map(look, words))
        out = []
        for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
            if w not in self.mapped:
                self.mapped[w] = self._model(w)
            out.append(self.mapped[w])
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if len(self.known) + len(self.mapped) > self.most:
            self.known.clear()
            self.mapped.clear()
        if "<|" not in text:
            return self._segment(text) if text else b""
        out, at = [], 0
        for hit in self.special.finditer(text):
            out += [self._segment(text[at : hit.start()]), self.ends[hit[0]]]
            at = hit.end()
        return b"".join([*out, self._segment(text[at:])])


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(df: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", end: int = 0, ids: bool = True) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of at most `capacity` tokens.

    Only longer documents are cut: all pieces but the first are full, and the first takes what is
    left over. token_ids holds little-endian unsigned 32-bit ids (left out without `ids`).
    """
    last = int(end).to_bytes(4, "little")
    fields = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"token_ids": pa.binary()} if ids else {})

    def run(batches):
        coder = word_ids(local_file(path))
        for batch in batches:
            for piece in slices(batch, 1 << 20):
                keys, rows = [], []
                for k, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    coded = coder.encode(t or "") + last
                    n = len(coded) // 4
                    first = (n - 1) % capacity + 1
                    for i, start in enumerate([0, *range(first, n, capacity)]):
                        length = first if i == 0 else capacity
                        own = coded[4 * start : 4 * (start + length)]
                        keys.append(k)
                        rows.append((i, start, length, zlib.crc32(own), own)[: len(fields)])
                columns = list(zip(*rows)) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(keys, piece.column(0).type), *map(pa.array, columns, fields.values())], names=[key, *fields])

    ship_package(df.sparkSession)
    ship_file(df.sparkSession, path)
    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", token_ids binary" * ids)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Bins for so many items of each length: (how many bins, the lengths in each), in order.

    A bin is filled greedily, each time with the longest unpacked item that fits. Then, while that
    fills the bin better, its smallest item is replaced by the two unpacked items that fit best into
    the gap that its removal leaves. Items of a length are alike, so a bin's filling repeats as long
    as every length in it lasts: packing N items takes as many steps as there are different fillings
    (a few for each length), however large N is. The result is that of packing bin by bin.
    """
    lengths = np.array(sorted(n for n, c in counts.items() if c > 0), dtype=np.int64)
    left = np.array([counts[n] for n in lengths.tolist()], dtype=np.int64)
    bins: list[tuple[int, list[int]]] = []
    while len(lengths):
        taken: dict[int, int] = {}
        gap = capacity

        def free(i: int) -> int:
            return int(left[i]) - taken.get(i, 0)

        top = len(lengths)
        while gap > 0:
            top = int(np.searchsorted(lengths[:top], gap, side="right"))
            while top and not free(top - 1):
                top -= 1
            if not top:
                break
            i = top - 1
            n = min(free(i), gap // int(lengths[i]))
            taken[i] = taken.get(i, 0) + n
            gap -= n * int(lengths[i])
        while gap > 0:
            small = min(taken)
            room = gap + int(lengths[small])
            have = left.copy()
            for i, n in taken.items():
                have[i] -= n
            able = np.flatnonzero((have > 0) & (lengths < room))
            sizes = lengths[able]
            if not len(able):
                break
            second = np.searchsorted(sizes, room - sizes, side="right") - 1
            same = second == np.arange(len(able))
            second = np.where(same & (have[able] < 2), second - 1, second)
            sums = np.where(second >= 0, sizes + sizes[second], -1)
            best = int(sums.argmax())
            if sums[best] <= lengths[small]:
                break
            taken[small] -= 1
            if not taken[small]:
                del taken[small]
            for i in (int(able[best]), int(able[second[best]])):
                taken[i] = taken.get(i, 0) + 1
            gap = room - int(sums[best])
        times = min(int(left[i]) // n for i, n in taken.items())
        bins.append((times, sorted((int(lengths[i]) for i, n in taken.items() for _ in range(n)), reverse=True)))
        for i, n in taken.items():
            left[i] -= times * n
        if not left.all():
            lengths, left = lengths[left > 0], left[left > 0]
    return bins


def placements(bins: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the r-th item of each length goes: (length, from r, to r, in a bin, first bin, offset)."""
    rows, used, first = [], {}, 0
    for times, filling in bins:
        offset = 0
        for length in sorted(set(filling), reverse=True):
            n = filling.count(length)
            at = used.get(length, 0)
            rows.append((length, at, at + times * n, n, first, offset))
            used[length] = at + times * n
            offset += n * length
        first += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Give every piece a sequence and its offset there (gapless from 0), in as few sequences as it can.

    Lengths are whole numbers from 1 to `capacity`. The plan is made on the driver from the histogram
    of lengths, at most `capacity` rows, and has a few rows for each length. A piece finds its place
    by its rank among the pieces of its length. Ranks come from groups of about sqrt(n) of the n
    pieces of a length, so that no length, however common, is ordered in one task: the place in the
    group plus the sizes of the groups before it. Adds sequence_id and offset.
    """
    spark = pieces.sparkSession
    sizes = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).count().collect()}  # capacity rows at most
    if any(not 1 <= n <= capacity for n in sizes):
        raise ValueError("a length lies outside 1..capacity")
    plan = spark.createDataFrame(placements(best_two_fit(sizes, capacity)), f"`{length}` long, _from long, _to long, _n long, _first long, _offset long")
    groups = spark.createDataFrame([(n, max(1, round(c**0.5))) for n, c in sizes.items()], f"`{length}` long, _groups long")
    dealt = pieces.join(F.broadcast(groups), length).withColumn("_group", F.pmod(F.xxhash64(*order), "_groups"))
    before = Window.partitionBy(length).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(length, "_group").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(length, "_group").orderBy(*order)) - 1)
    ranked = ranked.join(starts, [length, "_group"]).withColumn("_rank", F.col("_place") + F.col("_before"))
    # Every row of the plan is one length of one filling: a few thousand in all, whatever the number of pieces.
    placed = ranked.alias("p").join(F.broadcast(plan).alias("q"), (F.col(f"p.{length}") == F.col(f"q.{length}")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    here = F.col("_rank") - F.col("_from")
    return placed.select(*[F.col(f"p.{c}") for c in pieces.columns], (F.col("_first") + F.floor(here / F.col("_n"))).cast("long").alias("sequence_id"), (F.col("_offset") + here % F.col("_n") * F.col(f"p.{length}")).cast("long").alias("offset"))


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """Tokenise documents and pack them: a row for each piece, with its ids (if asked for) and its place.

    The pieces are written once to the shared folder, so that texts are tokenised once; the order of
    rows then moves only the columns that are asked for. Null and empty texts are an end id alone.
    Texts of any length are tokenised whole. Rows that repeat a key are documents of their own; null
    keys stay null. An empty table gives no rows. Only the key and the text are read, so other columns
    can't clash.
    """
    return pack(written(token_pieces(df, path, capacity, key, text, ids=ids), "pieces"), capacity, order=(key, "piece", "ids_crc32"))


def op4_best_two_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack_documents(docs, public_tokenizers.path(VOCABULARY), ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op4_best_two_fit": op4_best_two_fit}
ORACLE_SQL: dict[str, str] = {}
