"""Bibliographies: reference strings, their records, and merging of equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.functions.text import title_key
from tabulith.operators.tasks import spread

#: Longest identifier of a reference.
ID_LIMIT = 480
#: Characters of known records up to which they are broadcast.
BROADCAST_CHARACTERS = 16_000_000
#: Bytes of strings that one task looks up: each string has dozens of leads.
STRING_BYTES = 1 << 17


def bibliography(fragments: DataFrame) -> DataFrame:
    """The last unbroken run of fragments whose header begins a bibliography, last fragment first (nth 0)."""
    back = W.partitionBy("paper_id").orderBy(F.desc("order"))
    marked = fragments.withColumn("_bib", F.col("header").startswith("xxanchor-bib").cast("int"))
    # from the end: nothing before the run counts, and the first other fragment after it ends it
    seen = marked.withColumn("_seen", F.max("_bib").over(back))
    ended = seen.withColumn("_ended", F.max(F.when((F.col("_seen") == 1) & (F.col("_bib") == 0), 1).otherwise(0)).over(back))
    kept = ended.where("_bib = 1 AND _ended = 0")
    return kept.withColumn("nth", F.row_number().over(back) - 1).select("paper_id", "nth", "text")


def reference_lines(lines: DataFrame) -> DataFrame:
    """ref_id and ref_str of bibliography lines; other lines are left out."""
    pattern = "^\\s*(?:xxanchor-bib\\s)?xxanchor-([-A-Za-z0-9]+)\\s(.+)$"
    rows = lines.withColumn("ref_id", F.regexp_extract("text", pattern, 1)).where("ref_id <> ''")
    return rows.withColumn("ref_str", F.trim(F.regexp_extract("text", pattern, 2))).drop("text")


def reference_id(title):
    """RF3: the key under which references are merged."""
    return F.substring(title_key(title), 1, ID_LIMIT)


def merge_references(references: DataFrame) -> DataFrame:
    """RF3: one record a title: of every field the latest value that isn't null, the union of original strings.

    ``references`` have seen (an order), title, authors, idno, arxiv_id, orig_ref.
    """
    keyed = references.where("title IS NOT NULL").withColumn("uid", reference_id(F.col("title")))
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seen"))).alias(c) for c in ("title", "authors", "idno", "arxiv_id")]
    return keyed.groupBy("uid").agg(*latest, F.array_sort(F.collect_set("orig_ref")).alias("orig_refs"))


def lookup(strings: DataFrame, references: DataFrame) -> DataFrame:
    """RF4: (ref_str, uid): the longest record whose identifier is part of the normalised string.

    Candidates share the first three words of an identifier with the string, or all words of
    a shorter one, so that this is an equi-join; the substring test follows. Words are what
    '-' parts, and also runs of letters and digits, as a title may end at a full stop. Known
    leads of up to BROADCAST_CHARACTERS go to the strings, so that a lead that all strings
    share gathers nowhere; for more of them leads of strings are shuffled.
    """
    def kinds(key: str) -> list[Column]:
        return [F.split(key, "-"), F.array_remove(F.split(key, "[^a-z0-9]+"), "")]

    asked = spread(strings.select("ref_str"), "ref_str", each=STRING_BYTES).select("ref_str", title_key(F.col("ref_str")).alias("key"))
    parted = asked.select("ref_str", "key", F.explode(F.array(*kinds("key"))).alias("w")).where(F.size("w") > 0)
    starts = parted.select("ref_str", "key", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    sized = starts.select("ref_str", "key", "w", "i", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n"))
    grams = sized.select("ref_str", "key", F.array_join(F.slice("w", F.col("i"), F.col("n")), "-").alias("lead"))
    leads = references.select("uid", F.explode(F.array(*kinds("uid"))).alias("w")).where(F.size("w") > 0)
    known = leads.select("uid", F.array_join(F.slice("w", 1, 3), "-").alias("lead")).distinct()
    small = (known.agg(F.sum(F.length("uid") + F.length("lead") + 16)).first()[0] or 0) <= BROADCAST_CHARACTERS
    met = (grams.join(F.broadcast(known), "lead") if small else grams.distinct().join(known, "lead")).where(F.col("key").contains(F.col("uid")))
    return met.groupBy("ref_str").agg(F.max_by("uid", F.struct(F.length("uid"), "uid")).alias("uid"))


def parse_tei(records: DataFrame) -> DataFrame:
    """RF2: (ref_id, tei) to title, authors, year and identifiers by XPath; missing parts are null."""
    def one(path: str):
        return F.nullif(F.xpath_string("tei", F.lit(path)), F.lit(""))

    surnames = F.xpath("tei", F.lit("//author/persName/surname/text()"))
    return records.select("ref_id", one("//title[@level='a'][1]").alias("title"), surnames.alias("surnames"), one("//date/@when").alias("date"), one("//idno[@type='arXiv']").alias("arxiv_id"))
