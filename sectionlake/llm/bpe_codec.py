"""BPE encoding and decoding by speculation: longest matches are proposed, adjacent pairs checked, failures merged."""

from __future__ import annotations

import functools
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.session import ship_package
from sectionlake.llm.common import local_file, ship_file
from sectionlake.llm.bpe import byte_alphabet, latin_classes, merge_table
from sectionlake.llm.token_counts import slices

VOCABULARY = "word_bpe_49k.json"
#: Before a word that is in the alphabet of the vocabulary's bytes already; no valid text has this sign.
MAPPED = "\udfff"


class WordCodec:
    """Encoder and decoder for a lower-casing BPE file with word ends, equal to the tokenizers library.

    A word is proposed as a greedy sequence of longest vocabulary tokens. The proposals of all new
    words of a slice are checked at once: tokens must be sound and every adjacent pair must stay
    apart under merging, which together make the sequence the exact result. Words that fail are
    merged exactly. Words are remembered (a bounded number), so frequent ones cost a look-up.

    Normalising and splitting follow the file. Texts below U+0250 take a plain path here; any other
    text goes through the library's own normaliser and splitter.
    """

    def __init__(self, path: str, most_words: int = 500_000):
        from tokenizers import Tokenizer

        self.bpe = merge_table(path)
        self.library = Tokenizer.from_file(path)
        self.most, self.suffix = most_words, self.bpe.suffix
        self.alphabet = byte_alphabet()
        self.inner = {t: i for t, i in self.bpe.vocab.items() if not t.endswith(self.suffix)}
        self.final = {t[: -len(self.suffix)]: i for t, i in self.bpe.vocab.items() if t.endswith(self.suffix)}
        self.longest = max(map(len, self.final))
        self.reach: dict[str, int] = {}
        for token in self.inner:
            self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 1))
        letters, numbers = latin_classes()
        self.plain = re.compile("[\\u0000-\\u024f]*").fullmatch
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}\\t-\\r \\x85\\xa0]+").findall
        self.special = re.compile("|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))))
        self.ends = {self.bpe.tokens[i]: i for i in self.bpe.special.values()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.failed = self.seen = 0

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings, each in the alphabet of the vocabulary's bytes."""
        if text.isascii() or self.plain(text) and self._composed(text):
            return self.words(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return [MAPPED + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    @staticmethod
    def _composed(text: str) -> bool:
        import unicodedata

        return unicodedata.is_normalized("NFC", text)

    def propose(self, mapped: str) -> list[int]:
        out, at, n = [], 0, len(mapped)
        while at < n:
            if (i := self.final.get(mapped[at:]) if n - at <= self.longest else None) is not None:
                out.append(i)
                break
            end = min(n - 1, at + self.reach.get(mapped[at : at + 2], 1))
            while (i := self.inner.get(mapped[at:end])) is None:
                end -= 1
                if end <= at:  # only the word's last sign is left, or a sign the vocabulary lacks
                    raise ValueError("a byte is missing from the vocabulary")
            out.append(i)
            at = end
        return out

    def learn(self, words: list[str]) -> None:
        """Encode new words together."""
        mapped = [w[1:] if w[0] == MAPPED else "".join([self.alphabet[b] for b in w.encode("utf-8", "surrogatepass")]) for w in words]
        guesses = [self.propose(m) for m in mapped]
        sizes = np.array([len(g) for g in guesses])
        flat = np.fromiter((t for g in guesses for t in g), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        wrong = np.zeros(len(words), dtype=bool)
        wrong[owner[~self.bpe.sound[flat]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, dtype=np.int64)
        pairs, back = np.unique(flat[inside] * self.bpe.size + flat[inside + 1], return_inverse=True)
        apart = self.bpe.parted(pairs // self.bpe.size, pairs % self.bpe.size)
        wrong[owner[inside[~apart[back]]]] = True
        for i in np.flatnonzero(wrong).tolist():
            m = mapped[i]
            guesses[i] = self.bpe.merge([self.inner[c] for c in m[:-1]] + [self.final[m[-1]]])
        self.seen, self.failed = self.seen + len(words), self.failed + int(wrong.sum())
        self.known.update(zip(words, map(tuple, guesses)))

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, without added special tokens; special strings in a text are their ids."""
        split: list[list] = []
        marked: set[int] = set()
        for text in texts:
            if "<|" not in text:
                split.append(self.split(text))
                continue
            marked.add(len(split))
            parts, at = [], 0
            for hit in self.special.finditer(text):
                parts += [*self.split(text[at : hit.start()]), self.ends[hit[0]]]
                at = hit.end()
            split.append(parts + self.split(text[at:]))
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        if new := [w for w in set().union(*map(set, split)) if w not in known and isinstance(w, str)]:
            self.learn(new)
        look = known.__getitem__
        return [list(chain.from_iterable([known[w] if isinstance(w, str) else (w,) for w in parts] if i in marked else map(look, parts))) for i, parts in enumerate(split)]

    def decode(self, ids) -> str:
        """The tokens joined by spaces: the file names no decoder; special tokens stay."""
        tokens = self.bpe.tokens
        return " ".join([tokens[i] for i in ids])


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """token_ids (array of int) of every whole text and `decoded`, the text that decoding them gives.

    No shuffle; a task streams its rows in slices of at most a MB of text. Null and empty texts have
    no ids and decode to ''; repeated rows come out as often as they are there; an empty table gives
    no rows. Only the key and the text are read, so other columns can't clash.
    """

    def run(batches):
        coder = codec(local_file(path))
        for batch in batches:
            for piece in slices(batch, 1 << 20):
                ids = coder.encode_batch([t or "" for t in piece.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists, pa.array([coder.decode(x) for x in ids], pa.string())], names=[key, "token_ids", "decoded"])

    ship_package(df.sparkSession)
    ship_file(df.sparkSession, path)
    kind = dict(df.dtypes)[key]
    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, token_ids array<int>, decoded string")


def op10_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = encode_decode(docs, public_tokenizers.path(VOCABULARY))
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op10_bpe_codec": op10_bpe_codec}
ORACLE_SQL: dict[str, str] = {}
