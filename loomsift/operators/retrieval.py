"""Batch ranked retrieval: lexical scores, hashed vectors, boosts and top-k for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket_and_sign, bucket_and_sign_sql, hashed_cells
from ..functions.text import TOKEN, ascii_lower, ascii_lower_sql, tokens, tokens_sql
from ..registry import query
from ..sources.formats import stored
from ..sources.tables import sent, spread, table
from .blockmax import MOST_TERMS, TEXTS, batch_weights, block_index, block_topk, scored, term_weights
from .index import document_frequency, occurrences, postings

DIM = 384


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, token, qtf, terms (distinct terms of the query)."""
    each = occurrences(queries, id_col, text_col).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("qtf"))
    return each.withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy(id_col)))


def lexical_scores(posted: DataFrame, terms: DataFrame, n_docs: DataFrame, q: str = "item_id", d: str = "doc_id") -> DataFrame:
    """item_id, doc_id, score.  A term weighs ``idf * (1 + ln(1 + qtf))``; covering all terms adds 0.2.

    Postings are cut to the queries' tokens before anything is counted, so the frequency of no other
    token is shuffled.  What is left is dealt by document once: counting and scoring share that
    exchange, texts are split into tokens once, and a frequent token is in no one task."""
    wanted = terms.select("token").distinct()
    used = posted.join(sent(wanted, terms), "token", "left_semi").select(d, "token").repartition(d)
    weighted = terms.join(document_frequency(used), "token").crossJoin(F.broadcast(n_docs))
    idf = F.greatest(F.lit(0.0), F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    weighted = weighted.select(q, "token", "terms", (idf * (1 + F.log1p("qtf"))).alias("w"))
    out = used.join(sent(weighted, terms), "token").groupBy(q, d).agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("m"), F.first("terms").alias("t"))
    return out.select(q, d, (F.col("s") + 0.2 * F.col("m") / F.col("t")).alias("score"))


def top(scores: DataFrame, k: int, by: list[Column], q: str = "item_id") -> DataFrame:
    """The first k rows of each query, numbered from 1.  The bare number is compared, so that tasks keep
    their own first k rows before anything is shuffled."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(q).orderBy(*by)))
    return (ranked.where(F.col("rank") <= k) if k else ranked).withColumn("rank", F.col("rank").cast("long"))


def lexical_topk(docs: DataFrame, queries: DataFrame, k: int, text: str | Column = "text") -> DataFrame:
    """item_id, doc_id, score, by, rank: the first ``k`` rows of each query by ``lexical_scores`` (rounded: ``by``).

    Texts are split once, into a stored index of block-max postings; queries are sent to all tasks if they have at
    most ``MOST_TERMS`` terms, else every score is summed by shuffle."""
    return indexed_topk(stored(block_index(spread(docs), text), "blocks", TEXTS), queries, k)


def indexed_topk(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``lexical_topk`` over an index that ``block_index`` made."""
    terms = query_terms(queries)
    rows = terms.limit(MOST_TERMS + 1).toArrow()
    if rows.num_rows <= MOST_TERMS:
        found = block_topk(index, batch_weights(index, rows), k)
    else:
        found = scored(index, term_weights(index, terms)).withColumn("by", F.floor(F.col("score") * 1e6 + 0.5) / 1e6)
    return top(found, k, [F.desc("by"), F.col("doc_id")])


def bags(lists: pa.Array, dim: int = DIM) -> np.ndarray:
    """The normalized hashed bag of words of each list of tokens.  Distinct tokens are hashed once, all at a time."""
    code = lists.flatten().dictionary_encode()
    idx, sign = hashed_cells(code.dictionary, dim)
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    number = code.indices.to_numpy()
    v = np.bincount(row * dim + idx[number], sign[number], len(lists) * dim).reshape(len(lists), dim)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def dense_vectors(df: DataFrame, token_col: str, dim: int = DIM) -> DataFrame:
    """``df`` with ``v``: the normalized hashed bag of words of an array of tokens."""
    at = df.columns.index(token_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                column = pa.ListArray.from_arrays(np.arange(0, (part.num_rows + 1) * dim, dim, dtype=np.int32), bags(part[at], dim).ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, "v"])

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("array<double>").alias("v")).schema)


def hashed_vectors(occurs: DataFrame, id_col: str, dim: int = DIM) -> DataFrame:
    """id, idx, value: normalized hashed bag of words, sparse.  Each distinct token is hashed once."""
    counts = occurs.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))
    codes = occurs.select("token").distinct().select("token", bucket_and_sign(F.col("token"), dim).alias("h"))
    cells = counts.join(codes, "token").groupBy(id_col, F.col("h.idx").alias("idx")).agg(F.sum(F.col("n") * F.col("h.sign")).alias("v"))
    norm = F.greatest(F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(id_col))), F.lit(1e-12))
    return cells.select(id_col, "idx", (F.col("v") / norm).alias("value")).where("value <> 0")


_T = f"t AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({tokens_sql('text')}) AS token FROM benchmark) GROUP BY ALL)"


def _scores_sql(text: str) -> str:
    return (
        f"{_T}, p AS (SELECT DISTINCT doc_id, unnest({tokens_sql(text)}) AS token FROM documents), df AS (SELECT token, count(*) AS df FROM p GROUP BY token), "
        "n AS (SELECT count(DISTINCT doc_id) AS n FROM p), tc AS (SELECT item_id, count(*) AS terms FROM t GROUP BY item_id), "
        "s AS (SELECT item_id, doc_id, sum(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * (1 + ln(1 + qtf))) + 0.2 * count(*) / any_value(terms) AS score "
        "FROM t JOIN tc USING (item_id) JOIN p USING (token) JOIN df USING (token), n GROUP BY item_id, doc_id)"
    )


@query(f"WITH {_T} SELECT * FROM t")
def l1_query_tf(spark, sf_dir):
    return query_terms(table(spark, sf_dir, "benchmark")).drop("terms")


def lexical_search(docs: DataFrame, queries: DataFrame, text: str | Column = "text") -> DataFrame:
    """``lexical_scores`` of all documents (doc_id, text) for all queries (item_id, text)."""
    n = docs.where(F.rlike(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN))).agg(F.count(F.lit(1)).alias("n"))
    return lexical_scores(postings(spread(docs), text=text), query_terms(queries), n)


def _lexical(spark, sf_dir, text: str | Column = "text", queries: DataFrame | None = None) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark") if queries is None else queries, text)


@query(f"WITH {_scores_sql('text')} SELECT item_id, doc_id, round(score, 6) AS score FROM s")
def l2_lexical_score(spark, sf_dir):
    return _lexical(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {_scores_sql('text')} SELECT * FROM (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def l3_lexical_topk(spark, sf_dir):
    return lexical_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 5).select("item_id", "doc_id", F.col("by").alias("score"), "rank")


@query(
    f"WITH q AS (SELECT item_id, text FROM benchmark UNION ALL SELECT -1, 'zzqqxx'), t AS (SELECT DISTINCT item_id, unnest({tokens_sql('text')}) AS token FROM q), p AS (SELECT DISTINCT doc_id, unnest({tokens_sql('text')}) AS token FROM documents), "
    "hit AS (SELECT DISTINCT item_id, doc_id FROM t JOIN p USING (token)) SELECT item_id, count(*) AS candidates FROM (SELECT * FROM hit UNION ALL SELECT item_id, doc_id FROM q, documents WHERE item_id NOT IN (SELECT item_id FROM hit)) GROUP BY item_id"
)
def l4_fallback_candidates(spark, sf_dir):
    """Queries without a lexical hit get all rows as candidates; the queries are the small side."""
    docs = table(spark, sf_dir, "documents")
    queries = table(spark, sf_dir, "benchmark").select("item_id", "text").union(spark.createDataFrame([(-1, "zzqqxx")], "item_id long, text string"))
    hits = postings(docs).join(postings(queries, "item_id"), "token").select("item_id", "doc_id").distinct()
    missed = queries.select("item_id").join(hits.select("item_id").distinct(), "item_id", "left_anti")
    every = docs.agg(F.count(F.lit(1)).alias("candidates"))  # one row
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("candidates")).union(missed.join(F.broadcast(every), F.lit(True)).select("item_id", "candidates"))


_IDX, _SIGN = bucket_and_sign_sql("token", DIM)


def _vectors_sql(name: str, key: str, text: str, source: str) -> str:
    return (
        f"{name}_c AS (SELECT {key}, token, count(*) AS n FROM (SELECT {key}, unnest({tokens_sql(text)}) AS token FROM {source}) GROUP BY ALL), "
        f"{name}_h AS (SELECT token, {_IDX} AS idx, {_SIGN} AS sign FROM (SELECT DISTINCT token FROM {name}_c)), "
        f"{name}_v AS (SELECT {key}, idx, sum(n * sign)::DOUBLE AS v FROM {name}_c JOIN {name}_h USING (token) GROUP BY ALL), "
        f"{name} AS (SELECT {key}, idx, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY {key})), 1e-12) AS value FROM {name}_v WHERE v <> 0)"
    )


@query(f"WITH {_vectors_sql('q', 'item_id', 'text', 'benchmark')} SELECT item_id, idx, round(value, 5) AS value FROM q")
def k3_hashed_embedding(spark, sf_dir):
    return hashed_vectors(occurrences(table(spark, sf_dir, "benchmark"), "item_id"), "item_id").withColumn("value", F.round("value", 5))


_ALL_TEXT = "source || ' ' || lang || ' ' || text"
_HYBRID = (
    f"WITH {_scores_sql(_ALL_TEXT)}, c AS (SELECT item_id, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s) WHERE r <= 50 "
    "UNION ALL SELECT item_id, doc_id, 0 FROM benchmark, documents WHERE item_id NOT IN (SELECT item_id FROM s)), "
    f"cd AS (SELECT DISTINCT doc_id, source, lang, text FROM documents WHERE doc_id IN (SELECT doc_id FROM c)), {_vectors_sql('q', 'item_id', 'text', 'benchmark')}, {_vectors_sql('d', 'doc_id', _ALL_TEXT, 'cd')}, "
    "dots AS (SELECT item_id, doc_id, sum(q.value * d.value) AS dot FROM c JOIN q USING (item_id) JOIN d USING (doc_id, idx) GROUP BY ALL), "
    f"b AS (SELECT item_id, text AS q_text, {tokens_sql('text')} AS toks FROM benchmark), "
    "f AS (SELECT c.item_id, c.doc_id, source, round(c.score + coalesce(dot, 0) + CASE WHEN list_contains(toks, " + ascii_lower_sql("source") + ") THEN 2.0 ELSE 0 END + CASE WHEN upper(lang) IN ('OPTIONS', 'SYNOPSIS', 'EXAMPLES') THEN 0.25 ELSE 0 END "
    "+ CASE WHEN len(list_filter(toks, lambda t: starts_with(t, '-') AND contains(cd.text, t))) > 0 THEN 1.0 ELSE 0 END, 5) AS score "
    "FROM c JOIN cd USING (doc_id) JOIN b USING (item_id) LEFT JOIN dots ON dots.item_id = c.item_id AND dots.doc_id = c.doc_id) "
)


def hybrid(spark, sf_dir, lexical_k: int = 50, min_score: float = 0.0) -> DataFrame:
    return hybrid_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"), lexical_k, min_score)


def hybrid_search(docs: DataFrame, queries: DataFrame, lexical_k: int = 50, min_score: float = 0.0) -> DataFrame:
    """item_id, doc_id, source, score: lexical plus vector score plus boosts of the lexical candidates, of all
    rows for a query without one.

    ``docs`` has doc_id, source (the command), lang (the section) and text.  Texts are met again for the
    candidates alone.  The candidates, at most ``lexical_k`` rows a query, are stored."""
    whole = F.concat_ws(" ", "source", "lang", "text")
    candidates = stored(lexical_topk(docs, queries, lexical_k, whole).select("item_id", "doc_id", "score"), "candidates")
    # Queries without a lexical hit, which are few if any, are held against all rows.
    missed = stored(queries.select("item_id").join(candidates.select("item_id").distinct(), "item_id", "left_anti"), "missed")
    if not missed.isEmpty():
        candidates = candidates.unionByName(docs.select("doc_id").join(sent(missed), F.lit(True)).select("item_id", "doc_id", F.lit(0.0).alias("score")))
    # Texts meet the queries that want them where they are; what is sent is bounded by the candidates.
    wanted = candidates.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "score")).alias("items"))
    own = spread(docs).select("doc_id", "source", "lang", "text").join(sent(wanted, candidates), "doc_id")
    asked = dense_vectors(queries.select("item_id", tokens("text").alias("toks")), "toks").withColumnRenamed("v", "qv")
    rows = dense_vectors(own.withColumn("t", tokens(whole)), "t").drop("t").select("*", F.explode("items").alias("i")).drop("items")
    rows = rows.select("doc_id", "source", "lang", "text", "v", "i.item_id", "i.score").join(sent(asked, queries), "item_id")
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    boost = (
        F.when(F.array_contains("toks", ascii_lower("source")), 2.0).otherwise(0.0)
        + F.when(F.upper("lang").isin("OPTIONS", "SYNOPSIS", "EXAMPLES"), 0.25).otherwise(0.0)
        + F.when(F.exists("toks", lambda t: t.startswith("-") & F.contains(F.col("text"), t)), 1.0).otherwise(0.0)
    )
    score = F.round(F.col("score") + dot + boost, 5)
    return rows.select("item_id", "doc_id", "source", score.alias("score")).where(F.col("score") >= min_score)


@query(_HYBRID + "SELECT * FROM (SELECT item_id, doc_id, source, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source, doc_id) AS rank FROM f) WHERE rank <= 8")
def l11_hybrid_topk(spark, sf_dir):
    return top(hybrid(spark, sf_dir), 8, [F.desc("score"), F.col("source"), F.col("doc_id")])


@query(
    _HYBRID + ", r AS (SELECT item_id, doc_id, source, score, row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS k FROM f), "
    "o AS (SELECT r.item_id, r.doc_id, r.source, r.score, greatest(length(text) // 4, 1) AS tokens, sum(greatest(length(text) // 4, 1)) OVER (PARTITION BY r.item_id ORDER BY r.score DESC, r.doc_id ROWS UNBOUNDED PRECEDING) AS total "
    "FROM r JOIN documents USING (doc_id) WHERE k = 1) SELECT item_id, doc_id, source, score, CAST(tokens AS BIGINT) AS tokens FROM o WHERE total <= 2000"
)
def l15_injection_budget(spark, sf_dir):
    """Best hit per source (L14), as many by rank as a token budget holds."""
    best = Window.partitionBy("item_id", "source").orderBy(F.desc("score"), "doc_id")
    hits = hybrid(spark, sf_dir).withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")
    sized = hits.join(table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.floor(F.char_length("text") / 4), F.lit(1)).cast("long").alias("tokens")), "doc_id")
    total = F.sum("tokens").over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    return sized.withColumn("total", total).where("total <= 2000").select("item_id", "doc_id", "source", "score", "tokens")


@query(f"WITH {_scores_sql('text')} SELECT item_id, string_agg(line, chr(10) ORDER BY rank) AS rendered FROM (SELECT item_id, rank, format('{{}}. {{:.4f}} doc {{}}', rank, round(score, 4), doc_id) AS line FROM (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s) WHERE rank <= 5) GROUP BY item_id")
def l17_rendering(spark, sf_dir):
    line = F.format_string("%d. %.4f doc %d", "rank", F.round("score", 4), "doc_id")
    lines = l3_lexical_topk(spark, sf_dir).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    return lines.select("item_id", F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("rendered"))


@query(
    "WITH f AS (SELECT source, lang, doc_id, text, row_number() OVER (PARTITION BY source, lower(lang) ORDER BY doc_id) AS k FROM documents) "
    "SELECT source, sha256(string_agg('### ' || lang || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS digest, count(*) AS sections FROM f WHERE k = 1 GROUP BY source"
)
def l18_lookup(spark, sf_dir):
    """First chunk of each section of a command (here: source), in order, under headings."""
    first = Window.partitionBy("source", F.lower("lang")).orderBy("doc_id")
    rows = table(spark, sf_dir, "documents").withColumn("k", F.row_number().over(first)).where("k = 1")
    block = F.concat(F.lit("### "), F.col("lang"), F.lit("\n"), F.col("text"))
    parts = rows.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", block.alias("b")))).alias("x"))
    return parts.select("source", F.sha2(F.array_join(F.transform("x", lambda v: v["b"]), "\n\n").cast("binary"), 256).alias("digest"), F.size("x").cast("long").alias("sections"))


@query(
    "SELECT wanted, name, distance FROM (SELECT wanted, name, distance, row_number() OVER (PARTITION BY wanted ORDER BY distance, name) AS k FROM (SELECT w AS wanted, name, levenshtein(name, w) AS distance FROM (SELECT DISTINCT lower(p_name) AS name FROM part), (SELECT unnest(['part 1', 'pat 77', 'zzz']) AS w))) WHERE k <= 5"
)
def l20_suggestions(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    pairs = names.select("name", F.explode(F.array(*map(F.lit, ["part 1", "pat 77", "zzz"]))).alias("wanted")).select("wanted", "name", F.levenshtein("name", "wanted").cast("long").alias("distance"))
    return top(pairs, 5, [F.col("distance"), F.col("name")], "wanted").drop("rank")


# Commands that a cheat sheet lists first.
PRIORITY = ["src3", "src1", "src7", "missing"]


@query(
    "WITH p AS (SELECT unnest(['src3', 'src1', 'src7', 'missing']) AS source, unnest(range(4)) AS r), n AS (SELECT source, min_by(text, doc_id) AS text, min(doc_id) AS d FROM documents GROUP BY source) "
    "SELECT source, row_number() OVER (ORDER BY coalesce(r, 1000000000), d) AS pos, left(split_part(text, chr(10), 1), 90) AS synopsis FROM n LEFT JOIN p USING (source) ORDER BY pos LIMIT 12"
)
def l22_cheatsheet_rows(spark, sf_dir):
    """Priority names that are indexed first, then the others in index order, with a short synopsis."""
    ranks = spark.createDataFrame(list(zip(PRIORITY, range(len(PRIORITY)))), "source string, r int")
    names = table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("d"))
    rows = names.join(F.broadcast(ranks), "source", "left").orderBy(F.coalesce("r", F.lit(1_000_000_000)), "d").limit(12)
    pos = F.row_number().over(Window.orderBy(F.coalesce("r", F.lit(1_000_000_000)), "d")).cast("long")
    return rows.select("source", pos.alias("pos"), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 90).alias("synopsis"))


@query("SELECT doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS up, CAST(greatest(length(text) // 4, 1) AS BIGINT) AS down FROM documents")
def l26_token_estimates(spark, sf_dir):
    from ..functions.text import tokens_down, tokens_up

    return table(spark, sf_dir, "documents").select("doc_id", tokens_up("text").alias("up"), tokens_down("text").alias("down"))


def command_query(command: Column, prompt: Column) -> Column:
    """What a drafted command looks for: its name, its flags, then the prompt."""
    from .shell import flags

    return F.concat_ws(" ", F.split_part(F.trim(command), F.lit(" "), F.lit(1)), F.array_join(flags(command), " "), prompt)


@query(
    "WITH benchmark AS (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS item_id, source || ' -a -l --token show the files' AS text FROM documents), " + _HYBRID.removeprefix("WITH ")
    + "SELECT * FROM (SELECT item_id, doc_id, source, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source, doc_id) AS rank FROM f) WHERE rank <= 3"
)
def l16_command_retrieval(spark, sf_dir):
    """The best three rows for each drafted command with its flags, through the hybrid plan with all its boosts
    (L1-L11, L16); here a draft per source."""
    docs = table(spark, sf_dir, "documents")
    text = command_query(F.concat("source", F.lit(" -al --token=x /y")), F.lit("show the files"))
    drafts = docs.select("source").distinct().select(F.substring("source", 4, 20).cast("long").alias("item_id"), text.alias("text"))
    return top(hybrid_search(docs, stored(drafts, "drafts")), 3, [F.desc("score"), F.col("source"), F.col("doc_id")])


@query(f"WITH {_vectors_sql('q', 'item_id', 'prefixed', '(SELECT item_id, $$search_query: $$ || text AS prefixed FROM benchmark)')} SELECT item_id, idx, round(value, 5) AS value FROM q")
def l13_query_prefix(spark, sf_dir):
    """Vectors of queries with the embedder's prefix, which lexical terms never see."""
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("search_query: "), "text").alias("text"))
    return hashed_vectors(occurrences(queries, "item_id"), "item_id").withColumn("value", F.round("value", 5))
