"""The counting transducer over texts cut anywhere, its scan of state maps, and a state table that overflows."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sectionlake.llm import token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(1)
TEXTS = ["", "漢字仮名交じり文" * 300, "a" * 3000, "ab1" * 900, "x" * 767 + " " + "y'll" * 200, "é" * 900, " " * 1500, "\n \n" * 500, "😀" * 500, "<|endoftext|>" * 60]
TEXTS += ["".join(RNG.choice("ab '\n1é漢😀.l") for _ in range(RNG.randrange(1, 2500))) for _ in range(30)]


@pytest.mark.parametrize(("chunk", "back", "most"), [(768, 48, 250_000), (61, 8, 250_000), (97, 2, 250_000), (100, 8, 900)])
def test_chunks_cut_anywhere_count_as_the_library_does(chunk, back, most):
    library = Tokenizer.from_file(BYTES)
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in TEXTS]
    data, offsets = token_counts.utf8_of(pa.array(TEXTS))
    assert token_counts.CountingTransducer(BYTES, most).count(data, offsets, chunk, back).tolist() == want


def test_maps_that_lack_a_state_are_named_and_others_compose():
    entry = np.array([[0, -1], [5, -1], [7, 9], [0, -1], [4, -1]])
    exits = np.array([[5, -1], [9, -1], [3, 8], [4, -1], [6, -1]])
    counts = np.array([[1, 0], [10, 0], [100, 1000], [2, 0], [20, 0]])
    place = np.array([0, 1, 2, 0, 1])
    lack, total = token_counts.CountingTransducer._scan(entry, exits, counts, place)
    assert lack.tolist() == [-1] * 5 and total.tolist() == [1, 11, 1011, 2, 22]
    lack, _ = token_counts.CountingTransducer._scan(np.where(entry == 9, 6, entry), exits, counts, place)
    assert lack.tolist() == [-1, -1, 9, -1, -1]
