"""Evidence search: token postings, phrase joins with slop, BM25, highlighting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.text import char_ngrams

#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
#: Fields of the taxonomy and what a match of their words counts.
FIELDS = {"dataset": 3.0, "metric": 1.0, "task": 1.0}
STOP_WORDS = tuple(
    "a be if of an in on no to or as is at it by and the are for was not but such with will then into this that they there these their".split()
)


def analyse(text: Column, stop_words: bool = False) -> Column:
    """EV3: lower-cased words, tags dropped, stop words too if asked (words are not stemmed)."""
    plain = F.lower(F.regexp_replace(text, "</?[a-zA-Z][^>]*>", " "))
    words = F.array_remove(F.split(plain, "[^\\p{L}\\p{N}]+"), "")
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS)) if stop_words else words


def postings(rows: DataFrame, keys: list[str], text: str = "text", stop_words: bool = False) -> DataFrame:
    """(keys, token, pos) of every word."""
    return rows.select(*keys, F.posexplode(analyse(F.col(text), stop_words)).alias("pos", "token"))


def phrase_matches(queries: DataFrame, fragments: DataFrame, slop: int) -> DataFrame:
    """EV2: (query_id, frag_id, score) of fragments that hold a phrase's words in order, within ``slop`` moves.

    ``queries`` are (query_id, text), ``fragments`` (frag_id, text). The rarest word of a
    phrase leads: only fragments at its postings are looked at, so no frequent word is
    joined by itself. A match is a place where all words stand at most ``slop`` from where
    the phrase would have them, all told; the score is the number of such places.
    """
    asked = queries.select("query_id", analyse(F.col("text")).alias("words")).where(F.size("words") > 0)
    terms = asked.select("query_id", "words", F.posexplode("words").alias("offset", "token"))
    held = fragments.select("frag_id", analyse(F.col("text")).alias("tokens"))
    # only words that are asked for leave their fragment
    places = held.select("frag_id", F.posexplode("tokens").alias("pos", "token")).join(terms.select("token").distinct(), "token", "left_semi")
    counts = places.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = terms.join(counts, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    lead = ranked.groupBy("query_id").agg(F.min_by(F.struct("token", "offset", "words"), F.struct("df", "offset")).alias("lead"))
    lead = lead.select("query_id", F.col("lead.token").alias("token"), F.col("lead.offset").alias("offset"), F.col("lead.words").alias("words"))
    # where the phrase would begin, by its lead; a fragment's words join once for each phrase that may be in it
    begins = places.join(lead.select("query_id", "token", "offset"), "token").groupBy("query_id", "frag_id").agg(F.collect_list(F.col("pos") - F.col("offset")).alias("starts"))
    met = begins.join(held, "frag_id").join(lead.select("query_id", "words"), "query_id")

    def cost(start: Column) -> Column:
        """How far the words of the phrase are from their places, all told; the nearest occurrence of each."""
        near = F.sequence(F.lit(0), F.lit(slop))

        def moved(word: Column, i: Column) -> Column:
            hit = F.filter(near, lambda d: F.coalesce(F.get("tokens", start + i + d) == word, F.lit(False)) | F.coalesce(F.get("tokens", start + i - d) == word, F.lit(False)))
            return F.coalesce(F.array_min(hit), F.lit(slop + 1))

        return F.aggregate(F.transform("words", moved), F.lit(0), lambda a, x: a + x)

    score = F.size(F.filter("starts", lambda s: cost(s) <= slop)).cast("long")
    return met.select("query_id", "frag_id", score.alias("score")).where("score > 0")


def top_hits(hits: DataFrame, limit: int) -> DataFrame:
    """TK2: the best fragments of every query; of equals the one with the smaller identifier."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "frag_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def bm25(queries: DataFrame, docs: DataFrame, key: str = "doc_id", terms: Callable[[Column], Column] = analyse, within: Column | None = None) -> DataFrame:
    """EV6: (query_id, key, score) by BM25 over words, or what ``terms`` makes of a text; documents that share none have no row.

    With ``within`` only the documents for which it holds are scored; how frequent words are is still that of all.
    """
    words, mine = (d.select(key, terms(F.col("text")).alias("w")) for d in (docs, docs if within is None else docs.where(within)))
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("token"))
    # only words that are asked for leave their document
    tokens = asked.select("token").distinct()
    held = mine.select(key, F.size("w").alias("len"), F.explode("w").alias("token")).join(tokens, "token", "left_semi")
    needed = held.groupBy(key, "len", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = words.select(F.explode(F.array_distinct("w")).alias("token")).join(tokens, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avg_len"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = needed.join(df, "token").crossJoin(F.broadcast(stats))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    parts = weighted.select("token", key, part.alias("part"))
    return asked.join(parts, "token").groupBy("query_id", key).agg(F.sum("part").alias("score"))


def ngram_terms(text: Column) -> Column:
    """EV5, EV6: the character n-grams (2 to 4) of all words."""
    return F.flatten(F.transform(analyse(text), lambda w: char_ngrams(w, 2, 4)))


def _length(text: Column) -> Column:
    """Into how many parts a text falls at signs, the signs among them."""
    return F.regexp_count(text, F.lit("[^a-zA-Z0-9]")) * 2 + 1


def clean_query(text: Column) -> Column:
    """EV6: a mention without the word 'dataset' and without signs around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "^[,\\- ]+|[,\\- ]+$", ""), "(?i)dataset", ""))


def field_scores(queries: DataFrame, taxonomy: DataFrame, fields: dict[str, float] = FIELDS, grams: bool = True) -> DataFrame:
    """EV6: (query_id, task, dataset, metric, score): of the fields of a taxonomy row the one that matches best, by boosted BM25.

    A field is matched by its words, and with ``grams`` by its character n-grams too (not boosted).
    """
    rows = taxonomy.select(*fields).distinct()
    keyed = rows.withColumn("row_id", F.sha1(F.concat_ws("\n", *fields)))
    ways = [(analyse, boost, f) for f, boost in fields.items()] + [(ngram_terms, 1.0, f) for f in fields if grams]
    each = [bm25(queries, keyed.select("row_id", F.col(f).alias("text")), "row_id", terms).withColumn("score", F.col("score") * boost) for terms, boost, f in ways]
    best = reduce(DataFrame.unionByName, each).groupBy("query_id", "row_id").agg(F.max("score").alias("score"))
    return best.join(keyed, "row_id").select("query_id", *sorted(fields), "score")


def taxonomy_search(mentions: DataFrame, taxonomy: DataFrame, top: int = 3, grams: bool = True) -> DataFrame:
    """EV6: (query_id, rank, task, dataset, metric, confidence): the taxonomy rows that a mention (query_id, text, caption) speaks of.

    A score counts by the length of the query; it is then weighed by how far the search for
    the found data set's own name sets its best hit apart from the second one (a name that
    finds one row alone keeps its score). Of equals the smaller names go first.
    """
    text = F.concat_ws(" ", clean_query(F.col("text")), F.nullif(F.substring(clean_query(F.coalesce("caption", F.lit(""))), 1, 400), F.lit("")))
    queries = mentions.select("query_id", text.alias("text"))
    order = W.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "task", "dataset", "metric")
    hits = field_scores(queries, taxonomy, grams=grams).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = hits.select(F.col("dataset").alias("query_id"), F.col("dataset").alias("text")).distinct()
    apart = field_scores(names, taxonomy, grams=grams).withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    apart = apart.groupBy(F.col("query_id").alias("dataset")).agg(F.max("score").alias("ok"), F.max(F.when(F.col("nth") == 2, F.col("score"))).alias("bad"))
    found = hits.join(apart, "dataset").join(queries, "query_id")
    plain = F.col("score") / _length(F.col("text"))
    factor = F.coalesce((F.col("ok") - F.col("bad")) / F.col("bad") / (F.col("ok") / _length(F.col("dataset"))), F.lit(1.0))
    return found.select("query_id", "rank", "task", "dataset", "metric", (plain * factor).alias("confidence"))


def evidences(cells: DataFrame, fragments: DataFrame, own_limit: int = 30, corpus_limit: int = 10) -> DataFrame:
    """EV1, EV9: fragments that speak of each cell: of its own paper first, then of others.

    ``cells`` are (ext_id, paper_id, cell_content, cell_reference), ``fragments`` (frag_id,
    paper_id, header, text). Cells without letters, and those that nothing of their own
    paper mentions, have one empty fragment of their own. Equal contents of one paper are
    searched for once.
    """
    from tabulith.functions.text import is_alpha_cell, query_cell

    asked = cells.withColumn("query", query_cell(F.col("cell_content")))
    texts = asked.where(is_alpha_cell(F.col("query"))).select(F.sha1("query").alias("query_id"), F.col("query").alias("text")).distinct()
    plain = fragments.select("frag_id", "text")
    by_text = phrase_matches(texts, plain, 2)
    refs = asked.where("cell_reference <> ''").select(F.sha1(F.concat(F.lit("xxref "), "cell_reference")).alias("query_id"), F.concat(F.lit("xxref "), "cell_reference").alias("text")).distinct()
    by_ref = phrase_matches(refs, plain, 1)
    home = fragments.select("frag_id", F.col("paper_id").alias("home"))
    keyed = asked.select("ext_id", "paper_id", F.sha1("query").alias("query_id"), F.sha1(F.concat(F.lit("xxref "), "cell_reference")).alias("ref_id"))
    text_hits = keyed.join(by_text.join(home, "frag_id"), "query_id").withColumn("own", F.col("home") == F.col("paper_id"))
    ref_hits = keyed.withColumn("query_id", F.col("ref_id")).join(by_ref.join(home, "frag_id"), "query_id").where("home = paper_id").withColumn("own", F.lit(True))
    # a reference's hits come after the text's, a fragment counts once
    hits = text_hits.withColumn("kind", F.lit(0)).unionByName(ref_hits.withColumn("kind", F.lit(1)))
    single = hits.groupBy("ext_id", "frag_id", "own").agg(F.min("kind").alias("kind"), F.max("score").alias("score"))
    order = W.partitionBy("ext_id", "own").orderBy("kind", F.desc("score"), "frag_id")
    chosen = single.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.when(F.col("own"), own_limit).otherwise(corpus_limit))
    found = chosen.join(fragments.select("frag_id", "header", "text"), "frag_id").select("ext_id", F.col("own").alias("this_paper"), "frag_id", "header", "text")
    lacking = cells.select("ext_id").join(found.where("this_paper").select("ext_id"), "ext_id", "left_anti")
    blank = lacking.select("ext_id", F.lit(True).alias("this_paper"), F.lit(None).cast(fragments.schema["frag_id"].dataType).alias("frag_id"), F.lit("").alias("header"), F.lit("").alias("text"))
    return found.unionByName(blank).withColumn("text_sha1", F.sha1("text"))
