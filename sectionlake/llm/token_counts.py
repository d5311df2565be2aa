"""Token counts by a compiled transducer: bytes drive a deterministic automaton whose transitions carry token counts."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.session import ship_package
from sectionlake.llm.common import local_file, ship_file
from sectionlake.llm.bpe import byte_alphabet, merge_table

VOCABULARY = "byte_bpe_50k.json"
_SPACES = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_EMPTY = ((0, -1, 0),)


def _kind(char: str) -> str:
    if char in _SPACES:
        return "S"
    major = unicodedata.category(char)[0]
    return major if major in "LN" else "O"


class CountingTransducer:
    """A deterministic transducer from UTF-8 bytes to token counts of a byte-level BPE vocabulary.

    After any byte, the counts summed so far are the number of tokens that the text up to there has
    by itself. A state holds what the rest of the text can still change: where the splitting rules
    are (run of letters, numbers, other signs or white space, apostrophe), and, for each place from
    which a vocabulary token could still reach on, the token that ends there and how many tokens
    back it is. Tokens have bounded length, so the states are finitely many. They are made when a
    text first reaches them; a full table starts anew, which changes no count.

    The last token of a prefix is the one whose predecessor at its start stays apart from it: a
    sequence of tokens is the result of merging just if all adjacent pairs are.
    """

    def __init__(self, path: str, most_states: int = 250_000):
        self.bpe = merge_table(path)
        self.most = most_states
        char_byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.child: dict[int, int] = {}
        self.token, self.branches = [-1], [0]
        for text, i in self.bpe.vocab.items():
            node = 0
            for b in (char_byte[c] for c in text):
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.branches.append(0)
                    self.branches[node] += 1
                node = self.child[key]
            if self.bpe.sound[i]:
                self.token[node] = i
        self._apart: dict[tuple[int, int], bool] = {}
        self.columns = np.zeros(256, dtype=np.int32)
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [("start",)]
        self.ids: dict[tuple, int] = {("start",): 0}
        self.columns[:] = 0
        self.n_columns = 1
        self.table = np.zeros((4096, 32), dtype=np.int32)

    # -- the merging part: runs of bytes

    def _feed(self, live: tuple, data: bytes) -> tuple[tuple, int]:
        """Tokens more (or fewer) after more bytes of one run, and where tokens can go on from."""
        total = 0
        for b in data:
            on, found = [], None
            for node, last, back in live:
                child = self.child.get(node << 8 | b)
                if child is None:
                    continue
                t = self.token[child]
                if found is None and t >= 0 and (last < 0 or self._stay(last, t)):
                    found = (t, back + 1)
                if self.branches[child]:
                    on.append((child, last, back))
            t, more = found
            live = (*((n, x, back - more) for n, x, back in on), (0, t, 0))
            total += more
        return live, total

    def _stay(self, a: int, b: int) -> bool:
        key = (a, b)
        if (known := self._apart.get(key)) is None:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            known = self._apart[key] = self.bpe.apart(a, b)
        return known

    def _alone(self, data: bytes) -> int:
        return self._feed(_EMPTY, data)[1]

    # -- the splitting part: characters

    def _char(self, state: tuple, char: str) -> tuple[tuple, int]:
        kind, data, at = _kind(char), char.encode(), state[0]
        if at == "apostrophe":
            if char in "stmd":
                return ("start",), self._alone(b"'" + data) - 1
            if char in "rvl":
                return ("contraction", char), self._alone(data)
            if kind == "O":
                live, n = self._feed(_EMPTY, b"'" + data)
                return ("run", "O", live), n - 1
        elif at == "contraction":
            if state[1] + char in ("re", "ve", "ll"):
                return ("start",), self._alone(b"'" + state[1].encode() + data) - 1 - self._alone(state[1].encode())
            state = ("run", "L", self._feed(_EMPTY, state[1].encode())[0])
            at = "run"
        if at == "run" and kind == state[1]:
            live, n = self._feed(state[2], data)
            return ("run", kind, live), n
        if at == "white":
            _, before, last = state
            whole, more = self._feed(before, last)
            if kind == "S":
                return ("white", whole, data), self._feed(whole, data)[1]
            if last == b" ":  # the last space goes with what follows
                live, n = self._feed(_EMPTY, last + data)
                return ("run", kind, live), n - more
            apart = self._alone(last) - more
            state, n = self._char(("start",), char)
            return state, n + apart
        if kind == "S":
            return ("white", _EMPTY, data), self._alone(data)
        if char == "'":
            return ("apostrophe",), 1
        live, n = self._feed(_EMPTY, data)
        return ("run", kind, live), n

    def _compile(self, s: int, byte: int) -> None:
        state = self.states[s]
        held, base = (state[1], state[2]) if state[0] == "bytes" else (b"", state)
        data = held + bytes([byte])
        need = 1 if data[0] < 0x80 else 2 if data[0] < 0xE0 else 3 if data[0] < 0xF0 else 4
        after, n = (("bytes", data, base), 0) if len(data) < need else self._char(base, data.decode("utf-8", "surrogatepass"))
        if (to := self.ids.get(after)) is None:
            to = self.ids[after] = len(self.states)
            self.states.append(after)
        if not self.columns[byte]:
            self.columns[byte], self.n_columns = self.n_columns, self.n_columns + 1
        rows, cols = self.table.shape
        if to >= rows or self.n_columns > cols:
            grown = np.zeros((max(rows, 2 * rows * (to >= rows)), max(cols, min(257, cols + 32) * (self.n_columns > cols))), dtype=np.int32)
            grown[:rows, :cols] = self.table
            self.table = grown
        self.table[s, self.columns[byte]] = to << 8 | n + 128

    def _renew(self, arrays: list[np.ndarray]) -> None:
        """A new, small table with the states that the arrays hold, whose ids there change with it."""
        held = [np.unique(x) for x in arrays]
        keys = {s: self.states[s] for s in np.unique(np.concatenate(held)).tolist() if s >= 0}
        self.reset()
        to: dict[int, int] = {}
        for s, key in keys.items():
            if key not in self.ids:
                self.ids[key] = len(self.states)
                self.states.append(key)
            to[s] = self.ids[key]
        while len(self.states) > len(self.table):
            self.table = np.zeros((2 * len(self.table), self.table.shape[1]), dtype=np.int32)
        for x, own in zip(arrays, held):
            new = np.array([to.get(s, -1) for s in own.tolist()], dtype=x.dtype)
            x[...] = new[np.searchsorted(own, x)]

    def run_chunks(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray, pinned: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and token count of chunks of a byte array, each from its entry state; all chunks step together.

        A table of more than `most` states is made anew with those in use; `pinned` names arrays of
        states that must stay valid then.
        """
        order = np.argsort(starts - ends, kind="stable")
        at, left = starts[order].astype(np.int64), (ends - starts)[order]
        state, counts = entry[order].astype(np.int64), np.zeros(len(order), dtype=np.int64)
        live, step = len(order), 0
        falling = -left
        while live := int(np.searchsorted(falling, -step, side="left")) if live else 0:
            if len(self.states) > self.most:
                self._renew([state, *pinned])
            byte = data[at[:live] + step]
            now = state[:live]
            move = self.table[now, self.columns[byte]]
            if not move.all():
                lost = np.flatnonzero(move == 0)
                for key in np.unique(now[lost] << 8 | byte[lost]).tolist():
                    self._compile(key >> 8, key & 255)
                move = self.table[now, self.columns[byte]]
            counts[:live] += (move & 255) - 128
            state[:live] = move >> 8
            step += 1
        out, exits = np.empty_like(counts), np.empty_like(state)
        out[order], exits[order] = counts, state
        return exits, out

    def count(self, data: np.ndarray, offsets: np.ndarray, chunk: int = 768, back: int = 48) -> np.ndarray:
        """Tokens of each text of a batch: UTF-8 bytes and the n + 1 places where texts begin and end.

        Texts are cut into chunks anywhere, in words and in characters too. A chunk's map sends entry
        states to exit states and token counts. It is a partial map of at most two entries: first the
        state that the `back` bytes before the chunk lead to from the start, then, if that was not the
        one, the state that comes in. Maps compose by a parallel prefix scan (`_scan`); where a text's
        composition runs into a map without the state that comes in, the map is extended by it, for
        all texts at once, and the scan is done again. The result is exact, whatever was guessed.
        """
        texts = len(offsets) - 1
        starts, ends, owner, plus = offsets[:-1], offsets[1:], np.arange(texts), np.zeros(texts, dtype=np.int64)
        raw = data.tobytes() if self.bpe.special else b""
        for special in self.bpe.special:
            mark = special.encode()
            if mark in raw:
                starts, ends, owner = self._parts(raw, mark, starts, ends, owner, plus)
        whole = np.maximum(1, (ends - starts) // chunk)
        part = np.repeat(np.arange(len(starts)), whole)
        place = np.arange(len(part)) - np.repeat(np.cumsum(whole) - whole, whole)
        begin = starts[part] + place * chunk
        last = np.append(part[1:] != part[:-1], True) if len(part) else np.zeros(0, dtype=bool)
        end = np.where(last, ends[part], begin + chunk)
        inner = np.flatnonzero(place > 0)
        look = begin[inner] - back
        for _ in range(3):  # to the start of a character
            look = look - ((data[look] & 0xC0) == 0x80)
        entry = np.full((len(part), 2), -1, dtype=np.int64)
        entry[:, 0] = 0
        entry[inner, 0] = self.run_chunks(data, look, begin[inner], np.zeros(len(inner), dtype=np.int64), [])[0]
        exits, counts = np.full_like(entry, -1), np.zeros_like(entry)
        exits[:, 0], counts[:, 0] = self.run_chunks(data, begin, end, entry[:, 0], [entry])
        todo = np.arange(len(part))  # the chunks of texts that aren't composed to their end yet
        while len(todo):
            lack, total = self._scan(entry[todo], exits[todo], counts[todo], place[todo])
            stuck = np.flatnonzero(lack >= 0)
            open_ = np.zeros(len(starts), dtype=bool)
            open_[part[todo[stuck]]] = True
            ready = last[todo] & ~open_[part[todo]]
            np.add.at(plus, owner[part[todo[ready]]], total[ready])
            more = todo[stuck]
            entry[more, 1] = lack[stuck]
            exits[more, 1], counts[more, 1] = self.run_chunks(data, begin[more], end[more], entry[more, 1], [entry, exits])
            todo = todo[open_[part[todo]]]
        return plus

    @staticmethod
    def _scan(entry: np.ndarray, exits: np.ndarray, counts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inclusive prefix scan of chunk maps by doubling, restarted at each text's first chunk (place 0).

        A map is a row of entry states (-1: none), exit states and counts. After the step of span s a
        row is the composition of the 2s chunks that end with its own. Returns for each chunk the
        state that its map lacks, if it is the first of its text to lack one (else -1), and the
        tokens of its text up to its end (of no use behind a lack).
        """
        rows = len(place)
        here = np.arange(rows)
        entry, exits, counts = entry.copy(), exits.copy(), counts.copy()
        span = 1
        while span <= place.max(initial=0):
            right = np.flatnonzero(place >= span)
            left = right - span
            # The exits of the left map, looked up among the entries of the right one.
            met = (exits[left][:, :, None] == entry[right][:, None, :]) & (entry[left] >= 0)[:, :, None]
            at, found = met.argmax(axis=2), met.any(axis=2)
            after = np.take_along_axis(exits[right], at, axis=1)
            plus = np.take_along_axis(counts[right], at, axis=1)
            entry[right], exits[right], counts[right] = np.where(found, entry[left], -1), np.where(found, after, -1), counts[left] + plus
            span *= 2
        # A text starts in state 0.
        at = (entry == 0).argmax(axis=1)
        whole = entry[here, at] == 0
        final = exits[here, at]
        stuck = ~whole & np.append(True, whole[:-1])[:rows] & (place > 0)
        lack = np.full(rows, -1, dtype=np.int64)
        lack[stuck] = final[np.flatnonzero(stuck) - 1]
        return lack, counts[here, at]

    def _parts(self, raw: bytes, mark: bytes, starts, ends, owner, plus):
        """Texts without the special strings in them; each such string is one token."""
        rows = []
        for s, e, o in zip(starts.tolist(), ends.tolist(), owner.tolist()):
            while (at := raw.find(mark, s, e)) >= 0:
                rows.append((s, at, o))
                plus[o] += 1
                s = at + len(mark)
            rows.append((s, e, o))
        return tuple(np.array(x, dtype=np.int64) for x in zip(*rows))


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> CountingTransducer:
    return CountingTransducer(path)


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the places where its values begin and end; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_bytes (UTF-8) and n_tokens of every whole text, as the byte-level BPE file at `path` gives them.

    No shuffle: each task streams its rows through the transducer in slices of a few MB of text, so
    memory is bounded by the slice and the state table, and a lost task is simply run again. A
    special string inside a text is one token. Null and empty texts have 0; repeated rows come out
    as often as they are there; an empty table gives no rows. Only the key and the text are read.
    """

    def run(batches):
        counter = transducer(local_file(path))
        for batch in batches:
            for piece in slices(batch, 8 << 20):
                data, offsets = utf8_of(piece.column(1))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(counter.count(data, offsets), pa.int64())],
                    names=[key, "n_bytes", "n_tokens"],
                )

    ship_package(df.sparkSession)
    ship_file(df.sparkSession, path)
    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long")


def slices(batch: pa.RecordBatch, n_bytes: int, column: int = 1):
    """Parts of a batch with about so many bytes of text each, at least a row."""
    _, offsets = utf8_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + n_bytes, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


LIMIT = 1024


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = token_counts(docs, public_tokenizers.path(VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE_SQL: dict[str, str] = {}
