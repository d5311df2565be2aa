"""Line dedup by a log-template tree: fixed-depth parsing finds templates, and those that recur are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectionlake.llm.common import components, settled, spread_join, text_of, written

WILD = "<*>"
#: Near copies: sketches of so many values over shingles of so many words, compared where a band of them agrees, and alike from this share on.
BINS, BAND, SHINGLE, ALIKE = 64, 4, 5, 0.75


_WHITE = " \\t\\r\\f\\x0B"
_GAP = f"[{_WHITE}\\n]+"


def _masked(line: Column) -> Column:
    """A line in which every white-space token with a digit is <*>, a variable field from the start."""
    field = f"(?<![^{_WHITE}])[^{_WHITE}0-9]*+[0-9][^{_WHITE}]*+"
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, field, WILD)).otherwise(line)


def _odd(masked: Column) -> Column:
    """Whether anything but single spaces between tokens is white space in a line."""
    odd = masked.startswith(" ") | masked.endswith(" ") | F.contains(masked, F.lit("  ")) | (masked == "")
    for sign in "\t\r\f\x0b":
        odd = odd | F.contains(masked, F.lit(sign))
    return odd


def _tokens(masked: Column) -> Column:
    """White-space tokens; most lines have single spaces alone, for which a plain split does."""
    return F.when(_odd(masked), F.array_remove(F.split(masked, f"[{_WHITE}]+"), "")).otherwise(F.split(masked, " "))


def _leaf(masked: Column, leading: int) -> Column:
    """The hash of a line's number of tokens and its first ones, of which a plain line has no others made."""
    plain = F.octet_length(masked) - F.octet_length(F.replace(masked, F.lit(" "), F.lit(""))) + 1
    head = F.split(F.substring_index(masked, " ", leading), " ") if leading > 0 else F.slice(F.split(masked, " "), 1, leading)
    tokens = _tokens(masked)
    return F.when(_odd(masked), F.xxhash64(F.size(tokens), F.slice(tokens, 1, leading))).otherwise(F.xxhash64(plain, head))


def _template_lines(docs: DataFrame, key: str, text: str, leading: int) -> DataFrame:
    """A row for each line with a token: its place, its leaf, its hash and its masked text."""
    # The hash and the lines are made below the explode, once for a text; nothing here leaves generated code.
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text_of(text)).alias("_text"), F.split(text_of(text), "\n").alias("_lines"))
    rows = rows.select("_key", "_text", F.posexplode("_lines").alias("_pos", "_line")).where(F.ltrim("_line", F.lit(" \t\r\f\x0b")) != "")
    rows = rows.select("_key", "_text", "_pos", _masked(F.col("_line")).alias("_line"))
    return rows.select("_key", "_text", "_pos", F.xxhash64("_line").alias("_h"), _leaf(F.col("_line"), leading).alias("_leaf"), "_line")


def _sketches(docs: DataFrame, key: str, text: str, texts: DataFrame) -> DataFrame:
    """(_text, _sketch) of the `texts` (their hashes, and a _key of each).

    A sketch has, for each of BINS bounds, the smallest hash of a shingle at or above it (or the
    smallest of all), so that two sketches agree in about as many places as the shingle sets are
    alike (Jaccard). Shingles are rows, hashed and aggregated by ranges between bounds in generated
    code, in the tasks of the join, which has dealt them by key and text already.
    """
    own = docs.select(F.col(key).alias("_key"), F.xxhash64(text_of(text)).alias("_text"), text_of(text).alias("_body"))
    rows = own.join(texts.select("_key", "_text"), ["_key", "_text"], "left_semi").select("_key", "_text", F.split("_body", _GAP).alias("_words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - SHINGLE, F.lit(0)))
    rows = rows.select("_key", "_text", "_words", F.explode(starts).alias("_i"))
    rows = rows.select("_key", "_text", F.xxhash64(*[F.get("_words", F.col("_i") + j) for j in range(SHINGLE)]).alias("_s"))
    shift = 64 - (BINS.bit_length() - 1)
    rows = rows.groupBy("_key", "_text", (F.shiftright("_s", shift) + BINS // 2).cast("int").alias("_bin")).agg(F.min("_s").alias("_s"))
    rows = rows.groupBy("_key", "_text").agg(F.sort_array(F.collect_list(F.struct("_bin", "_s"))).alias("_first"))
    # A range's smallest hash stands for its own bound and those of the empty ranges before it.
    filled = F.transform("_first", lambda x, i: F.array_repeat(x["_s"], x["_bin"] - F.when(i > 0, F.get("_first", i - 1)["_bin"]).otherwise(-1)))
    rest = F.array_repeat(F.get("_first", F.lit(0))["_s"], F.lit(BINS - 1) - F.element_at("_first", -1)["_bin"])
    return rows.select("_text", F.concat(F.flatten(filled), rest).alias("_sketch"))


def _near_copies(docs: DataFrame, key: str, text: str, texts: DataFrame) -> DataFrame:
    """(_text, _class) of those of the `texts` (see `_sketches`) that have near copies among them.

    A text is compared with the first one of each band of its sketch that it shares, and classes are
    components of links between texts whose sketches agree.
    """
    sketches = written(_sketches(docs, key, text, texts), "sketches")
    bands = F.array(*[F.xxhash64(F.lit(i), *[F.get("_sketch", F.lit(i - 1 + j)) for j in range(BAND)]) for i in range(1, BINS + 1, BAND)])
    banded = sketches.select("_text", F.explode(bands).alias("_band"))
    shared = banded.groupBy("_band").agg(F.min("_text").alias("_other"), F.count("*").alias("_n")).where("_n > 1")
    total = sketches.count() * (BINS // BAND)
    pairs = written(spread_join(banded, shared, "_band", "_n", total, ["_text"]).where("_text <> _other").select("_text", "_other").distinct(), "pairs")
    hubs = pairs.groupBy("_other").agg(F.count("*").alias("_n")).join(sketches.select(F.col("_text").alias("_other"), F.col("_sketch").alias("_theirs")), "_other")
    pairs = spread_join(pairs.join(sketches, "_text"), hubs, "_other", "_n", total, ["_text"])
    agree = F.size(F.filter(F.zip_with("_sketch", "_theirs", lambda a, b: a == b), lambda x: x))
    links = pairs.where(agree >= ALIKE * BINS).select("_text", "_other")
    return components(links, "_text", "_other").select(F.col("node").alias("_text"), F.col("component").alias("_class"))


def recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least_docs: int = 3, leading: int = 3, fixed: float = 0.8) -> DataFrame:
    """The places (_key, _text, _pos) of lines whose template recurs across documents; _text is the text's hash.

    The tree has a level for the number of tokens and one for each of the first `leading` tokens;
    tokens with digits are variable (<*>) from the start. In a leaf with lines of `least_docs` texts,
    a token stays in the template where at least `least_docs` different lines (or one line of that
    many texts) have it in that position; other positions become <*>. A template counts if at least
    the share `fixed` of its tokens is left. It recurs if at least `least_docs` different texts have
    it of which no two are near copies (see `_near_copies`), each class of those counted once: the
    lines of a document's copies are left to the dedup of documents. A line may be of any length and
    stand anywhere, at the edges of its texts, between blank lines or in a block of fixed lines.

    Texts are parsed once, and lines counted by hash, so a line's many copies are one row from then
    on. Leaves, templates and classes that many lines have are dealt over several tasks.
    """

    def often_met() -> DataFrame:
        """The lines of leaves that enough texts have."""
        lines = written(_template_lines(docs, key, text, leading), "lines")
        leaves = lines.groupBy("_leaf", "_text").agg(F.count("*").alias("n")).groupBy("_leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs)
        leaves = written(leaves.select("_leaf", "n"), "leaves")
        return spread_join(lines, leaves, "_leaf", "n", leaves.agg(F.sum("n")).first()[0] or 0, ["_key", "_pos"], "left_semi")

    kept = settled(docs.sparkSession, often_met, "kept")  # the table of all lines goes then
    total = kept.count()
    words = kept.groupBy("_leaf", "_h", "_text").agg(F.count("*").alias("n"), F.min("_line").alias("_line")).groupBy("_leaf", "_h").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.min("_line").alias("_line"))
    unique = written(words.select("_leaf", "_h", "docs", "n", _tokens(F.col("_line")).alias("_tokens")), "unique")
    spread = unique.select("_leaf", "_h", "docs", F.size("_tokens").alias("_n"), F.posexplode("_tokens").alias("_i", "_t"))
    seen = spread.groupBy("_leaf", "_i", "_t").agg(F.count("*").alias("n"), F.max("docs").alias("docs"))
    firm = written(seen.where(((F.col("n") >= least_docs) | (F.col("docs") >= least_docs)) & (F.col("_t") != WILD)).select("_leaf", "_i", "_t", "n"), "firm")
    stays = spread_join(spread.drop("docs"), firm, ["_leaf", "_i", "_t"], "n", firm.agg(F.sum("n")).first()[0] or 0, ["_h"])
    shape = F.xxhash64("_leaf", F.array_sort(F.collect_list(F.struct("_i", "_t"))))
    templates = stays.groupBy("_leaf", "_h", "_n").agg(F.count("*").alias("_firm"), shape.alias("_template"))
    templates = templates.where(F.col("_firm") >= F.col("_n") * fixed).select("_leaf", "_h", "_template")
    templates = written(templates.join(unique.select("_leaf", "_h", "n"), ["_leaf", "_h"]), "templates")
    places = written(spread_join(kept.drop("_line"), templates, ["_leaf", "_h"], "n", total, ["_key", "_pos"]).select("_key", "_text", "_pos", "_template"), "places")
    held = written(places.groupBy("_template", "_text").agg(F.count("*").alias("n"), F.min("_key").alias("_key")), "held")
    often = held.groupBy("_template").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs).select("_template", F.col("docs").alias("_docs"), F.col("n").alias("_n"))
    often = written(often, "often")
    held = written(spread_join(held, often, "_template", "_docs", total, ["_text"]).select("_template", "_text", "_key", "_n"), "held")
    near = _near_copies(docs, key, text, held.groupBy("_text").agg(F.min("_key").alias("_key")))
    told = held.join(near, "_text", "left").select("_template", "_n", F.coalesce("_class", "_text").alias("_class")).distinct()
    recur = written(told.groupBy("_template").agg(F.count("*").alias("classes"), F.first("_n").alias("_n")).where(F.col("classes") >= least_docs).select("_template", "_n"), "recur")
    return spread_join(places, recur, "_template", "_n", total, ["_key", "_pos"], "left_semi").select("_key", "_text", "_pos").distinct()


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without the lines of recurring templates (see `recurring_lines`).

    Adds n_lines (0 for an empty text), n_dropped and changed; the text keeps the other lines in
    order, joined by newlines. No row goes: a document all of whose lines recur gets an empty text.
    Null texts stay null and null keys lose no lines; texts of any length are read whole; of rows that
    repeat a key, each loses its own text's lines. Columns of the added names in the input are
    replaced, others come back as they were. An empty table gives no rows.
    """
    places = settled(docs.sparkSession, lambda: recurring_lines(docs.where(F.col(key).isNotNull()), key, text, **options), "gone")
    gone = places.groupBy("_key", "_text").agg(F.collect_list("_pos").alias("_gone"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "changed")]
    rows = docs.select(F.struct(*own).alias("_row"), F.col(key).alias("_key"), F.xxhash64(text_of(text)).alias("_text"))
    joined = rows.join(gone, ["_key", "_text"], "left")
    joined = joined.select("_row", "_gone", F.coalesce(F.col("_row")[text].cast("string"), F.lit("")).alias("_whole"))
    lines = F.split("_whole", "\n")
    left = F.filter(lines, lambda line, i: ~F.array_contains("_gone", i))
    n = F.when(F.col("_whole") == "", F.lit(0)).otherwise(F.size(lines))
    dropped = F.coalesce(F.size("_gone"), F.lit(0))
    # In two steps: within one select Spark would take the new text for the old one inside a lambda.
    told = joined.select("_row", n.alias("n_lines"), dropped.alias("n_dropped"), (dropped > 0).alias("changed"), F.array_join(left, "\n").alias("_left"))
    columns = [(F.when(F.col("changed"), F.col("_left")).otherwise(F.col("_row")[c]) if c == text else F.col("_row")[c]).alias(c) for c in own]
    return told.select(*columns, "n_lines", "n_dropped", "changed")


def op9_line_templates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_recurring_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of(), 256).alias("text_sha256"))


_MASK = r"regexp_replace({}, '[^ \t\r\f\v]*[0-9][^ \t\r\f\v]*', '<*>', 'g')"
#: The same rules over texts and tokens themselves, in DuckDB; near copies by the exact likeness of all pairs with a common shingle.
OP9_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
masked AS (SELECT doc_id, text, list_transform(lines, lambda x: {_MASK.format('x')}) AS lines FROM docs),
exploded AS (SELECT doc_id, text, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM masked),
near AS (SELECT doc_id, text, pos, line, list_filter(regexp_split_to_array(line, '[ \\t\\r\\f\\v]+'), lambda t: t <> '') AS tokens FROM exploded),
leafed AS (SELECT *, len(tokens) AS n, tokens[1:3] AS lead FROM near WHERE len(tokens) > 0),
leaves AS (SELECT n, lead FROM leafed GROUP BY ALL HAVING count(DISTINCT text) >= 3),
kept AS (SELECT leafed.* FROM leafed JOIN leaves USING (n, lead)),
uniq AS (SELECT n, lead, line, first(tokens) AS tokens, count(DISTINCT text) AS docs FROM kept GROUP BY n, lead, line),
spread AS (SELECT n, lead, line, docs, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM uniq),
firm AS (SELECT n, lead, i, t FROM spread GROUP BY n, lead, i, t HAVING (count(*) >= 3 OR max(docs) >= 3) AND t <> '<*>'),
templates AS (
  SELECT n, lead, line, string_agg(i || ':' || t, chr(10) ORDER BY i) AS template
  FROM spread JOIN firm USING (n, lead, i, t) GROUP BY n, lead, line HAVING count(*) >= n * 0.8),
places AS (SELECT kept.*, md5(n || chr(1) || array_to_string(lead, ' ') || chr(1) || template) AS template FROM kept JOIN templates USING (n, lead, line)),
held AS MATERIALIZED (
  SELECT DISTINCT template, md5(text) AS t, text FROM places
  WHERE template IN (SELECT template FROM places GROUP BY template HAVING count(DISTINCT text) >= 3)),
worded AS (SELECT DISTINCT t, regexp_split_to_array(text, '[ \\t\\r\\f\\v\\n]+') AS w FROM held),
shingled AS MATERIALIZED (
  SELECT DISTINCT t, md5(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS s FROM (SELECT t, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM worded)),
sizes AS (SELECT t, count(*) AS n FROM shingled GROUP BY t),
common AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM shingled a JOIN shingled b ON a.s = b.s AND a.t < b.t GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.t = a JOIN sizes y ON y.t = b WHERE common.n >= {ALIKE} * (x.n + y.n - common.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
class AS (SELECT a AS t, least(a, min(b)) AS c FROM reach GROUP BY a),
recur AS (SELECT template FROM held LEFT JOIN class USING (t) GROUP BY template HAVING count(DISTINCT coalesce(c, t)) >= 3),
gone AS (SELECT doc_id, list(pos) AS gone FROM places WHERE template IN (SELECT template FROM recur) GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text = '' THEN 0 ELSE len(d.lines) END AS INTEGER) AS n_lines,
       CAST(coalesce(len(gone), 0) AS INTEGER) AS n_dropped,
       sha256(CASE WHEN gone IS NULL THEN d.text ELSE coalesce(array_to_string(
         [d.lines[i + 1] FOR i IN range(len(d.lines)) IF NOT list_contains(gone, i)], chr(10)), '') END) AS text_sha256
FROM docs d LEFT JOIN gone USING (doc_id)
"""

QUERIES = {"op9_line_templates": op9_line_templates}
ORACLE_SQL = {"op9_line_templates": OP9_SQL}
