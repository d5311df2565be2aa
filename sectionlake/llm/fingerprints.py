"""Document fingerprints by I-Match: terms of an inverse-document-frequency band, hashed in randomised lexicon subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sectionlake.llm.common import in_ranges, text_of, written

#: Levels of randomised subsets, sparse ones first: an MD5 of term and subset starts with hex digits below the bound.
#: Each level has 16 subsets; the shares of the lexicon in one are 1/4096, 1/512, 1/64 and 1/8.
LEVELS = ("001", "008", "04", "2")
SHARES = (4096, 512, 64, 8)
PER_LEVEL = 16
#: A text enters a level while its distinct terms times the share are at most this; denser subsets hold too much of it.
MOST_HELD = 16
#: Two texts are compared over so many subsets, the sparsest that hold a term of either.
COMPARED = 16
#: The band: at least and at most such shares of all documents hold a term.
LOW_SHARE, HIGH_SHARE = 0.0005, 0.1
#: A larger lexicon is joined by a shuffle instead of a broadcast; an entry takes about 60 bytes there.
MOST_BROADCAST = 2_000_000
#: What an empty subset hashes to (the start of the MD5 of nothing).
_NOTHING = "d41d8c"


def distinct_terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters and digits in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def lexicon(docs: DataFrame, text: str = "text", low_share: float = LOW_SHARE, high_share: float = HIGH_SHARE) -> DataFrame:
    """term and bits (its subsets, as bits of a long) of all terms whose inverse document frequency is in the band.

    The band lies between ln(1 / high_share) and ln(1 / low_share). As every term of it stands in at
    least low_share of all documents, it has at most (mean distinct terms of a document) / low_share
    terms, however many documents there are.
    """
    n = docs.count()
    seen = docs.select(F.explode(distinct_terms(text_of(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = seen.where((F.col("df") >= n * low_share) & (F.col("df") <= max(n * high_share, 1.0)))
    bits = F.lit(0).cast("long")
    for level, bound in enumerate(LEVELS):
        for k in range(PER_LEVEL * level, PER_LEVEL * (level + 1)):
            inside = F.substring(F.md5(F.concat(F.col("term"), F.lit(f"|{k}"))), 1, len(bound)) < bound
            bits = bits.bitwiseOR(F.when(inside, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return band.select("term", bits.alias("bits"))


def _open_levels(n_terms: Column) -> Column:
    """The subsets of the levels that a text with so many distinct terms enters, as bits."""
    low = lambda levels: F.lit((1 << PER_LEVEL * levels) - 1 if levels < len(LEVELS) else -1).cast("long")
    out = low(1)
    for level in range(1, len(LEVELS)):
        out = F.when(n_terms <= MOST_HELD * SHARES[level], low(level + 1)).otherwise(out)
    return out


def _hashes(entries: Column) -> Column:
    """Of each subset: the start of the MD5 of its sorted distinct terms; '.' without any."""
    subsets = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(PER_LEVEL * len(LEVELS))])
    held = lambda subset: F.transform(F.filter(entries, lambda e: e["bits"].bitwiseAND(subset) != 0), lambda e: e["term"])
    fields = F.transform(subsets, lambda subset: F.substring(F.md5(F.array_join(held(subset), " ")), 1, 6))
    return F.replace(F.array_join(fields, " "), F.lit(_NOTHING), F.lit("."))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common terms (Dice, 0 to 1) of two fingerprints.

    Over the sparsest subsets that hold a term of either text, the share of equal hashes estimates the
    Jaccard similarity J, for a sparse subset mostly holds one term; 2J / (1 + J) is the share of
    terms in common. Fingerprints of whole texts (no term in the band) are alike only if equal.
    """
    pairs = F.arrays_zip(F.split(a, " ").alias("x"), F.split(b, " ").alias("y"))
    some = F.slice(F.filter(pairs, lambda p: (p["x"] != ".") | (p["y"] != ".")), 1, COMPARED)
    same = F.size(F.filter(some, lambda p: p["x"] == p["y"]))
    whole = a.startswith("=") | b.startswith("=") | (F.size(some) == 0)
    return F.when(a == b, F.lit(1.0)).when(whole, F.lit(0.0)).otherwise((2 * same / (same + F.size(some))).cast("double"))


def add_fingerprints(rows: DataFrame, texts: list[str], lex: DataFrame, group: list[str]) -> DataFrame:
    """The rows without their text columns, with <text>_fp for each of these.

    `group` names columns that no two rows share and by whose first one the rows are partitioned:
    bringing the terms of a row together moves nothing then. Each text's distinct terms meet the
    lexicon as a broadcast of checked size (a shuffle beyond MOST_BROADCAST entries). Texts without a
    term of the band get '=' and the MD5 of the whole text.
    """
    keep = [c for c in rows.columns if c not in texts and c not in group]
    small = lex.count() <= MOST_BROADCAST
    items, whole = [], []
    for i, c in enumerate(texts):
        items.append(F.struct(F.lit(i).alias("i"), F.col(f"_terms{i}").alias("terms"), _open_levels(F.size(f"_terms{i}")).alias("open")))
        whole += [F.lit(f"_w{i}"), F.concat(F.lit("="), F.md5(F.col(c)))]
    head = F.struct(F.lit(-1).alias("i"), F.array(F.lit(None).cast("string")).alias("terms"), F.lit(0).cast("long").alias("open"))
    own = F.named_struct(*[x for c in keep for x in (F.lit(c), F.col(c))], *whole)
    rows = rows.select(*rows.columns, *[distinct_terms(F.col(c)).alias(f"_terms{i}") for i, c in enumerate(texts)])
    each = rows.select(*group, own.alias("_own"), F.explode(F.array(head, *items)).alias("_t"))
    each = each.select(*group, F.when(F.col("_t.i") < 0, F.col("_own")).alias("_own"), F.col("_t.i").alias("_i"), F.col("_t.open").alias("_open"), F.col("_t.terms").alias("_terms"))
    each = each.select(*group, "_own", "_i", "_open", F.explode("_terms").alias("term"))
    met = each.join(F.broadcast(lex) if small else lex, "term", "left").where((F.col("_i") < 0) | (F.col("bits").bitwiseAND(F.col("_open")) != 0))
    entry = F.struct("term", F.col("bits").bitwiseAND(F.col("_open")).alias("bits"))
    gathered = [F.array_sort(F.collect_list(F.when(F.col("_i") == i, entry))).alias(f"_e{i}") for i in range(len(texts))]
    found = met.groupBy(*group).agg(F.first("_own", ignorenulls=True).alias("_own"), *gathered)
    told = [F.when(F.size(f"_e{i}") > 0, _hashes(F.col(f"_e{i}"))).otherwise(F.col(f"_own._w{i}")).alias(f"{c}_fp") for i, c in enumerate(texts)]
    return found.select(*group, *[F.col(f"_own.{c}") for c in keep], *told)


def fingerprints_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they and neighbours are.

    In the edited text the last floor(n_chars / 4) code points are replaced by the first as many (or
    all) of the next document's, by ascending key (the first one follows the last; rows that repeat a
    key follow one another by text). Texts move once, dealt to ranges of keys; a range's last row sees
    a copy of the next range's first. Null texts are empty, a null key comes first, an empty table
    gives no rows; other columns are not read.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    base = docs.select(F.col(key).alias("_id"), text_of(text).alias("_text"))
    dealt = in_ranges(base, "_id", F.md5("_text"))
    order = Window.partitionBy("_range").orderBy("_copy", "_place", "_tie")
    rows = dealt.select("_range", "_copy", "_id", "_text", F.row_number().over(order).alias("_row"), F.lead("_text").over(order).alias("_next"))
    n = F.length("_text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("_edited", F.when(F.col("_copy"), "").otherwise(F.concat(F.substring(F.col("_text"), F.lit(1), n - cut), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut))))
    rows = rows.select("_range", "_row", "_copy", "_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "_text", "_edited")
    told = add_fingerprints(rows, ["_text", "_edited"], written(lexicon(docs, text), "lexicon"), ["_range", "_row"])
    following = F.lead("_text_fp").over(Window.partitionBy("_range").orderBy("_row"))
    told = told.withColumn("_next_fp", following).where(~F.col("_copy"))
    return told.select(
        F.col("_id").alias(key), "n_chars", "edited_sha256", F.col("_text_fp").alias("fingerprint"), F.col("_edited_fp").alias("edited_fingerprint"),
        likeness(F.col("_text_fp"), F.col("_edited_fp")).alias("near_edited"), likeness(F.col("_text_fp"), F.col("_next_fp")).alias("near_next"),
    )


def op1_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    cases = [f"(CASE WHEN substr(md5(term || '|{k}'), 1, {len(b)}) < '{b}' THEN {1 << k}::HUGEINT ELSE 0 END)" for level, b in enumerate(LEVELS) for k in range(PER_LEVEL * level, PER_LEVEL * (level + 1))]
    bits = " + ".join(cases)
    levels = " ".join(f"WHEN len(terms) <= {MOST_HELD * SHARES[i]} THEN {(1 << PER_LEVEL * (i + 1)) - 1}::HUGEINT" for i in reversed(range(1, len(LEVELS))))
    last = PER_LEVEL * len(LEVELS)

    def like(a: str, b: str) -> str:
        some = f"list_filter(list_zip(string_split({a}, ' '), string_split({b}, ' ')), lambda p: p[1] <> '.' OR p[2] <> '.')[1:{COMPARED}]"
        return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} LIKE '=%' OR {b} LIKE '=%' OR len({some}) = 0 THEN 0.0 ELSE 2 * len(list_filter({some}, lambda p: p[1] = p[2]))::DOUBLE / (len(list_filter({some}, lambda p: p[1] = p[2])) + len({some})) END"

    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
ordered AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following,
              coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM docs WINDOW w AS (ORDER BY doc_id)),
edits AS (SELECT doc_id, n, text, next_id, substr(text, 1, n - n // 4) || substr(following, 1, n // 4) AS edited FROM ordered),
texts AS (SELECT doc_id, 0 AS i, text AS t FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
termed AS (SELECT doc_id, i, t, list_distinct(list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS terms FROM texts),
seen AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM termed WHERE i = 0) GROUP BY term),
lex AS (SELECT term, {bits} AS bits FROM seen, (SELECT count(*) AS n FROM docs) WHERE df >= n * {LOW_SHARE} AND df <= greatest(n * {HIGH_SHARE}, 1)),
entries AS (SELECT doc_id, i, term, bits, o FROM (SELECT doc_id, i, unnest(terms) AS term, CASE {levels} ELSE {(1 << PER_LEVEL) - 1}::HUGEINT END AS o FROM termed) JOIN lex USING (term)),
held AS (SELECT doc_id, i, k, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 6) AS h
  FROM entries, (SELECT unnest(range({last})) AS k) WHERE (bits >> k) % 2 = 1 AND (o >> k) % 2 = 1 GROUP BY doc_id, i, k),
fields AS (SELECT doc_id, i, map_from_entries(list((k, h))) AS m FROM held GROUP BY doc_id, i),
prints AS (SELECT termed.doc_id, termed.i, CASE WHEN m IS NULL THEN '=' || md5(t) ELSE array_to_string([coalesce(m[k], '.') FOR k IN range({last})], ' ') END AS fp
  FROM termed LEFT JOIN fields ON termed.doc_id = fields.doc_id AND termed.i = fields.i),
wide AS (SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, c.fp AS next_fp
  FROM edits e JOIN prints a ON a.doc_id = e.doc_id AND a.i = 0 JOIN prints b ON b.doc_id = e.doc_id AND b.i = 1 JOIN prints c ON c.doc_id = e.next_id AND c.i = 0)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, CAST({like('fingerprint', 'edited_fingerprint')} AS DOUBLE) AS near_edited, CAST({like('fingerprint', 'next_fp')} AS DOUBLE) AS near_next FROM wide
"""


QUERIES = {"op1_imatch_fingerprints": op1_imatch_fingerprints}
ORACLE_SQL = {"op1_imatch_fingerprints": _sql()}
