"""Tokens, statistics and searches over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectionlake.functions import text
from sectionlake.operators import lexical
from sectionlake.queries import common as c
from sectionlake.session import ship_package, spread, table

#: The queries' words: frequent in the driver's documents.
PHRASE, WORDS, RARE = "of the", "the and ing", "idiot clown stupid"


def _sections(spark, sf_dir):
    return c.document_sections(spark, sf_dir)


def normalize_text(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.sha2(text.normalise(F.coalesce("text", F.lit(""))), 256).alias("normal_sha256"))


def tokenize_counts(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    tokens = text.query_tokens(F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", F.size(tokens).alias("n_tokens"), F.sha2(F.array_join(tokens, " "), 256).alias("tokens_sha256"))


def doc_token_lengths(spark, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir)
    size = lambda col: F.size(text.index_tokens(F.col(col)))
    return rows.select("id", size("heading_path").alias("heading_tokens"), size("text").alias("text_tokens"), text.token_estimate(F.col("text")).alias("estimate"))


def term_stats(spark, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir)
    if not lexical.repeated_ids(rows):
        return lexical.term_stats(rows)
    each = rows.select("id", F.explode(text.index_tokens(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def corpus_stats(spark, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir)
    n = (F.size(text.index_tokens(F.col("heading_path"))) + F.size(text.index_tokens(F.col("text")))).cast("long")
    return rows.agg(F.count("*").alias("sections"), F.sum(n).alias("tokens"), F.round(F.avg(n), 6).alias("mean_length"))


def postings(spark, sf_dir: str) -> DataFrame:
    sections = _sections(spark, sf_dir)
    rows = lexical.postings_of(sections, lexical.repeated_ids(sections))
    return rows.select("term", "id", "length", F.size("heading_at").alias("heading_hits"), F.size("text_at").alias("text_hits"), F.array_join(F.col("text_at").cast("array<string>"), ",").alias("text_at"))


def _search(spark, sf_dir: str, query: str, limit: int | None, within: list[str] | None = None, tiers: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    hits = lexical.search_sections(_sections(spark, sf_dir), lexical.words_of(query), text.path_filter(F.col("path"), within)).where(F.col("tier").isin(*tiers))
    best = lexical.top(hits, limit) if limit else hits
    return best.select("id", "path", "tier", F.round("score", 6).alias("score"))


def search_or(spark, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "idiot", None)


def search_and(spark, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, RARE, None, tiers=(1,))


def search_phrase(spark, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, PHRASE, 50, tiers=(0,))


def search_tiered(spark, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, WORDS, 50)


def search_scoped(spark, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "der die und", 20, ["de", "fr/src1?/*"])


def search_repeated_word(spark, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "Clown clown scum", 10)


def search_snippets(spark, sf_dir: str) -> DataFrame:
    """The ten best hits with their snippets, whose texts are read after the ranking."""
    best = _search(spark, sf_dir, RARE, 10)
    tokens = lexical.words_of(RARE)
    ship_package(spark)
    mark = F.udf(lambda body: lexical.snippet(body, tokens), "string", useArrow=True)
    # Ten rows lead the join.
    found = _sections(spark, sf_dir).join(F.broadcast(best), ["id", "path"])
    return found.select("id", "tier", "score", mark("text").alias("snippet"))


def search_batch(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item's whole text as a query, over all documents."""
    sections = _sections(spark, sf_dir)
    rows, tokens = lexical.corpus_size(sections)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("query"))
    best = lexical.search_batch(lexical.postings_of(sections, lexical.repeated_ids(sections)), rows, tokens / max(1, rows), queries, 5)
    return best.select("qid", "rank", "id", F.round("score", 6).alias("score"))


def acl_scoped_search(spark, sf_dir: str) -> DataFrame:
    """A search under an access list that is a table: sources with an even number; the list scopes rows, not statistics."""
    hits = lexical.search_sections(_sections(spark, sf_dir), lexical.words_of(RARE))
    allowed = table(spark, sf_dir, "documents").where(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 2 == 0).select(c.paths().alias("path")).distinct()
    best = lexical.top(hits.join(allowed, "path", "left_semi"), 20)
    return best.select("id", "tier", F.round("score", 6).alias("score"))


def _scores_sql(query: str) -> str:
    """Common table expressions up to `scored` (id, path, tier, score): every row that holds a word of the query."""
    tokens = [lexical.fold_token(t) for t in lexical.words_of(query)]
    spot = lambda field, t: f"list_count(list_transform({field}, lambda x: CASE WHEN x = '{t}' THEN 1 END))"
    phrase = lambda field: f"len(list_filter(range(len({field})), lambda i: {field}[i + 1 : i + {len(tokens)}] = {tokens!r}))"
    pairs = [(phrase("h"), phrase("b"))] if len(tokens) > 1 else []
    pairs += [(spot("h", t), spot("b", t)) for t in tokens]
    columns = ", ".join(f"{h} AS h{i}, {b} AS b{i}" for i, (h, b) in enumerate(pairs))
    dfs = ", ".join(f"count(*) FILTER (h{i} + b{i} > 0) AS n{i}" for i in range(len(pairs)))
    weights = ", ".join(f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END AS w{i}" for i in range(len(pairs)))
    part = [f"w{i} * (2.0 * h{i} + b{i}) * 2.2 / ((2.0 * h{i} + b{i}) + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(pairs))]
    first = len(pairs) - len(tokens)
    total, every, some = " + ".join(part[first:]), " AND ".join(f"h{i} + b{i} > 0" for i in range(first, len(pairs))), " OR ".join(f"h{i} + b{i} > 0" for i in range(first, len(pairs)))
    tier = f"CASE WHEN h0 + b0 > 0 THEN 0 WHEN {every} THEN 1 ELSE 2 END" if first else "2"
    score = f"CASE WHEN h0 + b0 > 0 THEN {part[0]} ELSE {total} END" if first else total
    return f"""
WITH {c.SECTIONS},
tokened AS (SELECT id, path, {c.sql_index_tokens("heading_path")} AS h, {c.sql_index_tokens("text")} AS b FROM sections),
counted AS (SELECT id, path, len(h) + len(b) AS length, {columns} FROM tokened),
sizes AS (SELECT count(*)::DOUBLE AS n, sum(length)::DOUBLE / count(*) AS mean, {dfs} FROM counted),
weights AS (SELECT mean, {weights} FROM sizes),
scored AS (SELECT id, path, CAST({tier} AS INTEGER) AS tier, round({score}, 12) AS score FROM counted, weights WHERE {some})"""


def _top_sql(query: str, limit: int | None, where: str = "true", columns: str = "id, path, tier, round(score, 6) AS score") -> str:
    order = f"ORDER BY tier, score DESC, id LIMIT {limit}" if limit else ""
    return f"{_scores_sql(query)}\nSELECT {columns} FROM (SELECT * FROM scored WHERE {where} {order})"


_POSTED = f"""
WITH {c.SECTIONS},
tokened AS (SELECT id, path, {c.sql_index_tokens("heading_path")} AS h, {c.sql_index_tokens("text")} AS b FROM sections),
placed AS (
  SELECT id, len(h) + len(b) AS length, unnest(h) AS term, 1 AS heading_hit, 0 AS text_hit, NULL AS place FROM tokened
  UNION ALL SELECT id, len(h) + len(b), unnest(b), 0, 1, unnest(range(len(b))) FROM tokened)"""

_BATCH = f"""
WITH {c.SECTIONS},
tokened AS (SELECT id, {c.sql_index_tokens("heading_path")} AS h, {c.sql_index_tokens("text")} AS b FROM sections),
lengths AS (SELECT id, len(h) + len(b) AS length FROM tokened),
sizes AS (SELECT count(*)::DOUBLE AS n, sum(length)::DOUBLE / count(*) AS mean FROM lengths),
hits AS (SELECT id, term, sum(x) AS hh, sum(y) AS bb FROM (
  SELECT id, unnest(h) AS term, 1 AS x, 0 AS y FROM tokened UNION ALL SELECT id, unnest(b), 0, 1 FROM tokened) GROUP BY id, term),
words AS (SELECT item_id AS qid, {c.sql_fold("unnest(" + c.sql_query_tokens("coalesce(text, '')") + ")")} AS term FROM benchmark),
asked AS (SELECT qid, term, count(*) AS times FROM words GROUP BY qid, term),
df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
weighed AS (SELECT qid, term, times * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS w FROM asked JOIN df USING (term), sizes),
totals AS (SELECT qid, id, round(sum(w * (2.0 * hh + bb) * 2.2 / ((2.0 * hh + bb) + 1.2 * (0.25 + 0.75 * length / mean))), 12) AS score
  FROM weighed JOIN hits USING (term) JOIN lengths USING (id), sizes GROUP BY qid, id)
SELECT qid, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM totals) WHERE rank <= 5
"""

QUERIES = {
    f.__name__: f
    for f in (normalize_text, tokenize_counts, doc_token_lengths, term_stats, corpus_stats, postings, search_or, search_and, search_phrase, search_tiered, search_scoped, search_repeated_word, search_snippets, search_batch, acl_scoped_search)
}
ORACLE_SQL = {
    "normalize_text": f"SELECT doc_id, sha256({c.sql_normalise("coalesce(text, '')")}) AS normal_sha256 FROM documents",
    "tokenize_counts": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, sha256(coalesce(array_to_string(t, ' '), '')) AS tokens_sha256 FROM (SELECT doc_id, {c.sql_query_tokens("coalesce(text, '')")} AS t FROM documents)",
    "doc_token_lengths": f"WITH {c.SECTIONS} SELECT id, CAST(len({c.sql_index_tokens('heading_path')}) AS INTEGER) AS heading_tokens, CAST(len({c.sql_index_tokens('text')}) AS INTEGER) AS text_tokens, CAST(ceil(length(text) / 4) AS INTEGER) AS estimate FROM sections",
    "term_stats": f"WITH {c.SECTIONS}, words AS (SELECT id, unnest({c.sql_index_tokens('text')}) AS term FROM sections) SELECT term, count(DISTINCT id) AS df, count(*) AS occurrences FROM words GROUP BY term",
    "corpus_stats": f"WITH {c.SECTIONS}, l AS (SELECT len({c.sql_index_tokens('heading_path')}) + len({c.sql_index_tokens('text')}) AS n FROM sections) SELECT count(*) AS sections, CAST(sum(n) AS BIGINT) AS tokens, round(avg(n), 6) AS mean_length FROM l",
    "postings": f"{_POSTED} SELECT term, id, CAST(length AS INTEGER) AS length, CAST(sum(heading_hit) AS INTEGER) AS heading_hits, CAST(sum(text_hit) AS INTEGER) AS text_hits, coalesce(string_agg(place, ',' ORDER BY place), '') AS text_at FROM placed GROUP BY term, id, length",
    "search_or": _top_sql("idiot", None),
    "search_and": _top_sql(RARE, None, "tier = 1"),
    "search_phrase": _top_sql(PHRASE, 50, "tier = 0"),
    "search_tiered": _top_sql(WORDS, 50),
    "search_scoped": _top_sql("der die und", 20, "path = 'de' OR starts_with(path, 'de/') OR path GLOB 'fr/src1?/*'"),
    "search_repeated_word": _top_sql("Clown clown scum", 10),
    "search_batch": _BATCH,
    "acl_scoped_search": _top_sql(RARE, 20, "path IN (SELECT concat_ws('/', coalesce(lang, ''), coalesce(source, ''), CAST(doc_id AS VARCHAR)) FROM documents WHERE try_cast(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 2 = 0)", "id, tier, round(score, 6) AS score"),
}
