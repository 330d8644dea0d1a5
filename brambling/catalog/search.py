"""Full text, BM25 and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import folded, text
from ..operators import counts, facets, neighbours, ranking
from ..operators.textindex import TextIndex, write_index
from ..sources.tables import shared_folder, spread
from .registry import Tables, query

_SQL_TOKENS = r"(SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS tok FROM documents)"


def _tokens(t: Tables):
    return spread(t.documents.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", text.vector(F.col("text")).alias("tok"))


def _folded(t: Tables):
    return folded.with_folded(spread(t.documents.select("doc_id", "lang", "source", "text")), F.col("text"), "words")


def _holds(w: str) -> str:
    return f"list_contains(tok, '{w}')"


def _follows(a: str, b: str, n: int) -> str:
    return f"len(list_filter(range(1, len(tok) + 1), lambda i: tok[i] = '{a}' AND tok[i + {n}] = '{b}')) > 0"


@query(
    "fts_boolean",
    f"""SELECT count(*) FILTER (WHERE {_holds('the')} AND {_holds('with')}) AS and_, count(*) FILTER (WHERE {_holds('der')} OR {_holds('les')}) AS or_,
    count(*) FILTER (WHERE {_holds('the')} AND NOT {_holds('with')}) AS and_not, count(*) FILTER (WHERE NOT {_holds('the')}) AS not_,
    count(*) FILTER (WHERE ({_holds('the')} OR {_holds('die')}) AND ({_holds('was')} OR {_holds('und')})) AS tree,
    count(*) FILTER (WHERE len(list_filter(tok, lambda w: starts_with(w, 'whth'))) > 0) AS prefix FROM {_SQL_TOKENS}""",
)
def fts_boolean(t: Tables):
    queries = {"and_": "the & with", "or_": "der | les", "and_not": "the & !with", "not_": "!The", "tree": "(the | die) & (was | und)", "prefix": "whth:*"}
    return counts.filtered_counts(_folded(t), {k: folded.matches(F.col("words"), q) for k, q in queries.items()})


@query(
    "fts_phrase",
    f"""SELECT count(*) FILTER (WHERE {_follows('of', 'the', 1)}) AS next_, count(*) FILTER (WHERE {_follows('the', 'and', 3)}) AS third,
    count(*) FILTER (WHERE len(list_filter(range(1, len(tok) + 1), lambda i: tok[i] = 'to' AND tok[i + 1] = 'the' AND (tok[i + 2] = 'of' OR tok[i + 2] = 'and'))) > 0) AS longer
    FROM {_SQL_TOKENS}""",
)
def fts_phrase(t: Tables):
    queries = {"next_": "of <-> the", "third": "the <3> and", "longer": "to <-> the <-> (of | and)"}
    return counts.filtered_counts(_folded(t), {k: folded.matches(F.col("words"), q) for k, q in queries.items()})


@query(
    "fts_weights",
    f"""SELECT count(*) FILTER (WHERE source = 'src3' OR {_holds('src5')}) AS a, count(*) FILTER (WHERE {_holds('the')}) AS d, count(*) FILTER (WHERE false) AS never FROM {_SQL_TOKENS}""",
)
def fts_weights(t: Tables):
    both = spread(t.documents.select("source", "text")).select(text.joined(text.vector(F.col("source"), "A"), text.vector(F.col("text"))).alias("tok"))
    tok = F.col("tok")
    return counts.filtered_counts(both, {"a": text.matches(tok, "src3:A | src5:D"), "d": text.matches(tok, "the:d"), "never": text.matches(text.strip(tok), "the:D")})


@query("fts_any", f"SELECT lang, count(*) AS n FROM {_SQL_TOKENS} WHERE {_holds('the')} AND {_holds('with')} OR {_holds('nicht')} GROUP BY 1")
def fts_any(t: Tables):
    return counts.group_counts(_folded(t), "lang", condition=folded.matches_any(F.col("words"), ["the & with", "nicht"]))


@query("facet_lexemes", f"SELECT key, count(*) AS n FROM (SELECT unnest(list_distinct(tok)) AS key FROM {_SQL_TOKENS} WHERE lang = 'en') GROUP BY 1 ORDER BY n DESC, key LIMIT 15")
def facet_lexemes(t: Tables):
    return facets.facets(_tokens(t), "tok", 15, "lang = 'en'", "tokens")


def _bm25_sql(terms: list[str], where: str = "true", match: str | None = None, k: int = 10) -> str:
    def tf(w: str) -> str:
        return f"CAST(len(list_filter(tok, lambda w: w = '{w}')) AS double)"

    parts = " + ".join(
        f"CASE WHEN {_holds(w)} THEN ln(1 + (nd - d{i} + 0.5) / (d{i} + 0.5)) * {tf(w)} * 2.2 / ({tf(w)} + 1.2 * (0.25 + 0.75 * len(tok) / avgdl)) ELSE 0 END" for i, w in enumerate(terms)
    )
    frequencies = ", ".join(f"count(*) FILTER (WHERE {_holds(w)}) AS d{i}" for i, w in enumerate(terms))
    test = match or " OR ".join(_holds(w) for w in terms)
    return f"""WITH t AS MATERIALIZED {_SQL_TOKENS}, s AS (SELECT count(*) FILTER (WHERE len(tok) > 0) AS nd, avg(len(tok)) FILTER (WHERE len(tok) > 0) AS avgdl, {frequencies} FROM t)
    SELECT doc_id, round({parts}, 6) AS score FROM t, s WHERE ({test}) AND {where} ORDER BY {parts} DESC, doc_id LIMIT {k}"""


def _rounded(df):
    return df.select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_topk", _bm25_sql(["with", "that", "nicht"]))
def bm25_topk(t: Tables):
    return _rounded(ranking.bm25(spread(t.documents.select("doc_id", "text")), "doc_id", F.col("text"), "with | that | nicht", 10))


@query("bm25_match", _bm25_sql(["that", "was"], match=f"{_holds('that')} AND {_holds('was')} AND NOT {_holds('with')}"))
def bm25_match(t: Tables):
    return _rounded(ranking.bm25(spread(t.documents.select("doc_id", "text")), "doc_id", F.col("text"), "that & was & !with", 10, match=True))


@query("bm25_filtered", _bm25_sql(["with", "that"], where="source = 'src3'", k=5))
def bm25_filtered(t: Tables):
    return _rounded(ranking.bm25(spread(t.documents.select("doc_id", "text", "source")), "doc_id", F.col("text"), "with | that", 5, condition=F.col("source") == "src3"))


def _index(t: Tables) -> TextIndex:
    """A lexeme index of all documents, made for one query here; callers with more keep its folder."""
    path = shared_folder(t.spark, "lexemes")
    write_index(spread(t.documents.select("doc_id", "text")), "doc_id", F.col("text"), path)
    return TextIndex(t.spark, path)


@query("bm25_indexed", _bm25_sql(["with", "that", "nicht"]))
def bm25_indexed(t: Tables):
    return _rounded(_index(t).bm25("with | that | nicht", 10).withColumnRenamed("key", "doc_id"))


@query("fts_indexed", f"SELECT doc_id FROM {_SQL_TOKENS} WHERE {_follows('of', 'the', 1)} AND NOT {_holds('with')} UNION ALL SELECT -1 - doc_id FROM {_SQL_TOKENS} WHERE NOT ({_holds('the')} OR {_holds('les')})")
def fts_indexed(t: Tables):
    index = _index(t)
    without = index.matching("!(the | les)").select((-1 - F.col("key")).alias("key"))
    return index.matching("of <-> the & !with").unionAll(without).withColumnRenamed("key", "doc_id")


# A fixed query vector of 64 numbers.
_QUERY = [((i * 37) % 23 - 11) / 50 for i in range(64)]
_SQL_QUERY = "CAST([" + ", ".join(map(repr, _QUERY)) + "] AS double[64])"
_SQL_VECTOR = "CAST(embedding AS double[64])"


def _knn_sql(function: str, where: str = "true", k: int = 10) -> str:
    return f"SELECT vec_id, round({function}({_SQL_VECTOR}, {_SQL_QUERY}), 6) AS distance FROM embeddings WHERE {where} ORDER BY {function}({_SQL_VECTOR}, {_SQL_QUERY}), vec_id LIMIT {k}"


def _near(df):
    return df.select("vec_id", F.round("distance", 6).alias("distance"))


@query("knn_l2", _knn_sql("array_distance"))
def knn_l2(t: Tables):
    return _near(neighbours.nearest(t.embeddings, "vec_id", "embedding", _QUERY, 10, "l2"))


@query("knn_ip", _knn_sql("array_negative_inner_product"))
def knn_ip(t: Tables):
    return _near(neighbours.nearest(t.embeddings, "vec_id", "embedding", _QUERY, 10, "ip"))


@query("knn_cosine", _knn_sql("array_cosine_distance"))
def knn_cosine(t: Tables):
    return _near(neighbours.nearest(t.embeddings, "vec_id", "embedding", _QUERY, 10, "cosine"))


@query("knn_filtered", _knn_sql("array_distance", "label IN (2, 5)", 7))
def knn_filtered(t: Tables):
    return _near(neighbours.nearest(t.embeddings, "vec_id", "embedding", _QUERY, 7, "l2", "label IN (2, 5)"))


@query("knn_within", f"SELECT label, count(*) AS n FROM embeddings WHERE array_cosine_distance({_SQL_VECTOR}, {_SQL_QUERY}) < 0.9 GROUP BY 1")
def knn_within(t: Tables):
    near = neighbours.within(t.embeddings, "vec_id", "embedding", _QUERY, 0.9, "cosine").select("vec_id")
    return t.embeddings.join(near, "vec_id", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


@query("knn_probed")
def knn_probed(t: Tables):
    centres = neighbours.fit_centroids(t.embeddings, "embedding", partitions=16)
    parts = neighbours.partitioned(t.embeddings, "embedding", centres)
    return _near(neighbours.nearest_probed(parts, "vec_id", "embedding", centres, _QUERY, 10, nprobe=6))
