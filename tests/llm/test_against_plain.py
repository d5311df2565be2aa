"""Every operator against a plain version: brute force, the tokenizer libraries, round trips, held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sectionlake.llm import bpe_codec, catalogue, fingerprints, line_templates, near_duplicates, packing, tiled_cosine, token_counts, toxicity
from sectionlake.llm.common import components, in_ranges
from tests.conftest import MIDDLE, SMALL, check_against_sql

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", " ", "it's 'll we'LL", "a  b\t\n\n c ", "naïve café ÀÉ ß ſ İ", "漢字かな交じり文 한국어", "😀😃 é ​ x", "1234567890 3.14,15", "<|endoftext|> x<|endoftext|>", "<|startoftext|>hi", "!!??--__", "x" * 3000, "ab" * 700 + " " + "é" * 900, "\u0000\u0001\x85 end", "don't\nstop  'sam"]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_sql(spark, name):
    check_against_sql(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SMALL)


def documents(spark, sf_dir=SMALL):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTES)
    got = {r["doc_id"]: r for r in catalogue.QUERIES["op6_token_counts"](spark, SMALL).collect()}
    for k, text in documents(spark).items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_hard_texts_count_and_encode_as_the_libraries_do():
    lib_bytes, lib_words = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    counter, coder, ids = token_counts.CountingTransducer(BYTES), bpe_codec.WordCodec(WORDS), packing.WordIds(BYTES)
    import pyarrow as pa

    data, offsets = token_counts.utf8_of(pa.array(HARD))
    assert counter.count(data, offsets).tolist() == [len(lib_bytes.encode(t, add_special_tokens=False).ids) for t in HARD]
    want = [lib_words.encode(t, add_special_tokens=False).ids for t in HARD]
    assert coder.encode_batch(HARD) == want
    assert [coder.decode(x) for x in want] == [lib_words.decode(x, skip_special_tokens=False) for x in want]
    assert [np.frombuffer(ids.encode(t), "<u4").tolist() for t in HARD] == [lib_bytes.encode(t, add_special_tokens=False).ids for t in HARD]


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text_counts_and_encodes_as_the_libraries_do(texts):
    import pyarrow as pa

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    data, offsets = token_counts.utf8_of(pa.array(texts, pa.string()))
    lib_bytes, lib_words = _libraries()
    assert token_counts.transducer(BYTES).count(data, offsets).tolist() == [len(lib_bytes.encode(t, add_special_tokens=False).ids) for t in texts]
    assert bpe_codec.codec(WORDS).encode_batch(texts) == [lib_words.encode(t, add_special_tokens=False).ids for t in texts]


_held: list = []


def _libraries():
    if not _held:
        _held.extend([Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)])
    return _held


def test_codec_query_equals_the_library(spark):
    library = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: r for r in catalogue.QUERIES["op10_bpe_codec"](spark, SMALL).collect()}
    for k, text in documents(spark).items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing_is_whole_and_tight(spark):
    library = Tokenizer.from_file(BYTES)
    rows = catalogue.QUERIES["op4_best_two_fit"](spark, MIDDLE).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    total = 0
    for k, text in documents(spark, MIDDLE).items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for i, r in enumerate(own):
            assert r["start"] == at and (i == 0 or r["length"] == 2048) and (len(ids) > 2048 or len(own) == 1)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60))
def test_two_fit_never_loses_items_and_beats_first_fit(items):
    counts = {n: items.count(n) for n in set(items)}
    bins = packing.best_two_fit(counts, 40)
    packed = sorted(n for times, filling in bins for _ in range(times) for n in filling)
    assert packed == sorted(items) and all(sum(f) <= 40 for _, f in bins)
    open_: list[int] = []
    for n in sorted(items, reverse=True):
        at = next((i for i, used in enumerate(open_) if used + n <= 40), None)
        if at is None:
            open_.append(n)
        else:
            open_[at] += n
    assert sum(t for t, _ in bins) <= len(open_) + 1


def shingle_sets(texts):
    out = {}
    for k, t in texts.items():
        words = re.findall(r"[^\W_]+", t.lower())
        out[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return out


def brute_classes(texts, least=0.8):
    sets, holders = shingle_sets(texts), {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    near = {(a, b) for ks in holders.values() for a in ks for b in ks if a < b}
    for a, b in near:
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: find(k) for k in texts}


def test_near_duplicates_equal_brute_force(spark):
    want = brute_classes(documents(spark, MIDDLE))
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in catalogue.QUERIES["op2_dart_minhash"](spark, MIDDLE).collect()}
    assert got == {k: (c, c == k) for k, c in want.items()}


def test_chains_without_a_centre_are_found_in_tiles(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(60):  # each differs a little from the one before, the first and last have nothing in common
        for _ in range(3):
            words[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    near_duplicates.TILE, kept = 16, near_duplicates.TILE
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicate_classes(rows).collect()}
    finally:
        near_duplicates.TILE = kept
    assert got == brute_classes(texts)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    elements = rng.integers(0, 2**63, 400).astype(np.uint64)
    a, b = rng.uniform(0.5, 4, 400), rng.uniform(0.5, 4, 400)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    darts = near_duplicates.Darts(2000)
    signs = darts.signatures(np.concatenate([elements, elements]), np.concatenate([a, b]), np.repeat([0, 1], 400), 2)
    assert abs((signs[0] == signs[1]).mean() - want) < 0.05


def test_lines_recur_only_across_documents(spark):
    rng = random.Random(3)
    fresh = lambda: " ".join(f"u{rng.randrange(10**9)}" for _ in range(8)).replace("0", "x").translate(str.maketrans("123456789", "abcdefghi"))
    passage = "all rights are kept by the makers of this text and by nobody else in the world"
    texts = {i: "\n".join([fresh(), f"Page {i} of the great book of many tales", fresh(), passage, fresh()]) for i in range(20)}
    texts |= {100 + i: texts[0] for i in range(5)} | {200: "\n".join(fresh() for _ in range(5))}
    out = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i in range(20):
        lines = texts[i].split("\n")
        assert out[i]["text"] == "\n".join([lines[0], lines[2], lines[4]]) and out[i]["n_dropped"] == 2
    assert out[200]["text"] == texts[200] and not out[200]["changed"]


def test_cosines_equal_brute_force_in_many_tiles(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 16))
    x = np.vstack([base, base[rng.integers(0, 60, 400)] + rng.normal(scale=0.12, size=(400, 16)), base[:20] * 3])
    label = rng.integers(0, 3, len(x))
    rows = spark.createDataFrame([(i, v.tolist(), int(n)) for i, (v, n) in enumerate(zip(x, label))], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    low = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(low, np.where(near, low[None, :], len(x)).min(axis=1))
        if (new == low).all():
            break
        low = new
    tiled_cosine.TILE, kept = 40, tiled_cosine.TILE
    try:
        out = sorted(tiled_cosine.similar_vectors(rows).collect())
    finally:
        tiled_cosine.TILE = kept
    assert [(r["n_links"], r["component_id"]) for r in out] == list(zip(near.sum(axis=1).tolist(), low.tolist()))


def test_toxicity_on_held_out_rows(spark):
    out = {r["doc_id"]: r for r in catalogue.QUERIES["op5_string_kernel"](spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [k for k in labels if k in out and out[k]["held_out"]]
    assert all(out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in out)
    right = np.mean([out[k]["predicted"] == labels[k] for k in held])
    missed = sum(labels[k] == 1 and out[k]["predicted"] == 0 for k in held) / sum(labels[k] for k in held)
    wrong = sum(labels[k] == 0 and out[k]["predicted"] == 1 for k in held) / sum(1 - labels[k] for k in held)
    assert right > 0.96 and missed < 0.1 and wrong < 0.03
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_disguised_words_still_count():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["ba", "re", "to", "lin", "sa", "mo", "ke"]) for _ in range(rng.randint(1, 4)))
    plain = lambda: [word() for _ in range(60)]

    def with_insults(hide):
        words = plain()
        for at in rng.sample(range(60), 4):
            words[at] = hide(rng.choice(["idiot", "scumbag", "pathetic"]))
        return " ".join(words) + "."

    model = toxicity.fit([with_insults(str) for _ in range(80)], [" ".join(plain()) + "." for _ in range(160)], 0.3)
    clean = model.probability([" ".join(plain()) for _ in range(50)])
    assert (clean < 0.3).mean() > 0.95
    for hide in (str, str.upper, lambda w: "-".join(w), lambda w: " ".join(w), lambda w: w[:2] + "'" + w[2:], lambda w: w[:3] + w[2:]):
        scores = model.probability([with_insults(hide) for _ in range(30)])
        assert (scores >= 0.3).mean() > 0.9, hide("idiot")


def test_string_kernel_equals_its_definition():
    from itertools import combinations

    def slow(s, t, n):
        total = 0.0
        for i in combinations(range(len(s)), n):
            for j in combinations(range(len(t)), n):
                if all(s[a] == t[b] for a, b in zip(i, j)):
                    total += toxicity.GAP ** ((i[-1] - i[0] - n + 1) + (j[-1] - j[0] - n + 1))
        return total

    def common(s, t):
        return max((n for n in range(len(t) + 1) for x in combinations(t, n) if "".join(x) in {"".join(y) for y in combinations(s, n)}), default=0)

    for word in ("^idiot", "^xidxiot", "^stupid", "^idit", "^idi", "^toidi"):
        got = toxicity.word_features([word], ["^idiot", "stupid"])[0]
        own = slow(word, word, toxicity.LENGTH) or 1.0
        want = [(slow(word, mark, toxicity.LENGTH) / (own * slow(mark, mark, toxicity.LENGTH)) ** 0.5) ** toxicity.POWER * (common(word, mark) >= toxicity.COMMON * len(mark)) for mark in ("^idiot", "stupid")]
        assert np.allclose(got, want, rtol=1e-4), word


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 2000), (2000, 1500)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1500: 1000, 2000: 1000}


def test_ranges_give_every_successor(spark):
    rng = random.Random(4)
    keys = [rng.randrange(10**6) for _ in range(900)] + [5000] * 700  # one key fills many ranges
    rows = sorted((k, hashlib.md5(str(i).encode()).hexdigest()) for i, k in enumerate(keys))
    dealt = in_ranges(spark.createDataFrame(rows, "k long, t string"), "k", F.col("t"), per_range=50).cache()
    from pyspark.sql.window import Window

    order = Window.partitionBy("_range").orderBy("_copy", "_place", "_tie")
    got = sorted((r["k"], r["t"], r["n"]) for r in dealt.withColumn("n", F.lead("t").over(order)).where("not _copy").collect())
    assert got == [(k, t, after[1]) for (k, t), after in zip(rows, rows[1:] + rows[:1])]
    assert dealt.groupBy("_range").count().agg(F.max("count")).first()[0] < 200
    dealt.unpersist()


def test_fingerprints_tell_edits_from_strangers(spark):
    out = fingerprints.fingerprints_with_edits(spark.read.parquet(f"{MIDDLE}/documents.parquet")).select("near_edited", "near_next").toPandas()
    assert out.near_edited.mean() > 0.5 and out.near_next.mean() < 0.05
    assert (out.near_edited > out.near_next).mean() > 0.97


def test_unrelated_inserted_letters_are_caught():
    """Insults with a random letter at a random place, one or two in 60 words; clean texts are left alone."""
    rng = random.Random(11)
    insults = ["wretchard", "mudskull", "stinkpot", "graveler", "bonehead"]
    words = ["".join(rng.choice("aeioulnrstmd") for _ in range(rng.randrange(3, 10))) for _ in range(3000)]

    def text(n: int, hide: bool) -> str:
        out = [rng.choice(words) for _ in range(60)]
        for at in rng.sample(range(60), n):
            w = rng.choice(insults)
            i = rng.randrange(1, len(w))
            out[at] = w[:i] + rng.choice("abcdefghijklmnopqrstuvwxyz") + w[i:] if hide else w
        return " ".join(out)

    model = toxicity.fit([text(rng.randrange(1, 5), False) for _ in range(150)], [text(0, False) for _ in range(300)], 0.15)
    caught = lambda texts: float((model.probability(texts) >= toxicity.THRESHOLD).mean())
    for n in (1, 2, 4):
        assert caught([text(n, False) for _ in range(100)]) >= 0.95
        assert caught([text(n, True) for _ in range(200)]) >= 0.9
    assert caught([text(0, False) for _ in range(200)]) <= 0.02
