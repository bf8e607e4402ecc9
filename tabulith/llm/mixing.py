"""Mixing documents to target domain weights, in DataFrame operations only.

A naive Bayes classifier, learnt from the label table over hashed words and over marks
of style, gives every document soft memberships of the domains. Projected gradient steps then fit a rate for
each document, 0 or more, whose expected domain token totals (tokens x membership x rate)
match the targets in the least-squares sense. A step needs only the domains' residuals,
so an iteration is one aggregation to a few numbers.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import cut, fresh, quoted, text_of

#: The domains and the share of all tokens that each shall have. The first sets the total: it keeps its own tokens.
TARGETS = {"good": 0.91, "low": 0.06, "toxic": 0.03}
#: Buckets that words are hashed to: the classifier is a table of that many rows.
BUCKETS = 1 << 14
#: Buckets of the marks of style, which follow those of the words.
STYLES = 1 << 12
#: A document's evidence is weighed as that of so many words at most, which keeps memberships soft.
WORDS = 60
#: Words, and documents, by whose number a domain's counts are smoothed towards those of all.
SMOOTH, MARK_SMOOTH = 10 * BUCKETS, 10
STEPS, CLOSE = 60, 1e-4
BROADCAST_LABELS = 2_000_000
#: What parts words: white space and ASCII signs.
_GAP = "[\\x00-/:-@\\[-`{-\\x7F]+"
#: Marks of style begin with a character that no word has.
_MARK = "\x00"


def _domain() -> Column:
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("low")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _GAP), "")


def _style(text: Column, words: Column) -> list[Column]:
    """What a text looks like, in steps: its signs, capitals, and how often it repeats words and lines."""
    length = F.greatest(F.length(text), F.lit(1))
    size = F.greatest(F.size(words), F.lit(1))
    lines = F.split(text, "\n")
    signs = F.greatest(length - F.length(F.array_join(words, " ")), F.lit(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [
        F.concat(F.lit("signs"), F.least(F.floor(signs * 40 / length), F.lit(12)).cast("string")),
        F.concat(F.lit("capitals"), F.least(F.floor(capitals * 20 / length), F.lit(12)).cast("string")),
        F.concat(F.lit("words"), F.floor(F.log2(size)).cast("string"), F.lit("/"), F.floor(F.size(F.array_distinct(words)) * 10 / size).cast("string")),
        F.concat(F.lit("lines"), F.floor(F.log2(F.size(lines))).cast("string"), F.lit("/"), F.floor(F.size(F.array_distinct(lines)) * 10 / F.size(lines)).cast("string")),
    ]


def _evidence(rows: DataFrame, *kept: str) -> DataFrame:
    """``kept``, tokens (the number of words) and a row for the bucket of every word and every mark of style."""
    split = rows.withColumn("_words", _words(text_of()))
    marks = F.array(*[F.concat(F.lit(_MARK), m) for m in _style(text_of(), F.col("_words"))])
    each = split.select(*kept, F.size("_words").alias("tokens"), F.explode(F.concat("_words", marks)).alias("_w"))
    hashed = F.xxhash64("_w")
    bucket = F.when(F.col("_w").startswith(_MARK), F.lit(BUCKETS) + F.pmod(hashed, F.lit(STYLES))).otherwise(F.pmod(hashed, F.lit(BUCKETS)))
    return each.select(*kept, "tokens", bucket.cast("int").alias("bucket"))


def train(docs: DataFrame, labels: DataFrame, domains: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """(bucket, one log-probability for each domain) and the log-priors, of all labelled rows but the held-out fifth."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").where(~held)
    known = known.select("doc_id", _domain().alias("_domain"))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    counted = _evidence(rows, "_domain").groupBy("bucket")
    counts = cut(counted.agg(*[F.count_if(F.col("_domain") == d).alias(d) for d in domains]))
    totals = counts.where(F.col("bucket") < BUCKETS).agg(*[F.sum(d).alias(d) for d in domains]).first().asDict()
    sizes = dict(known.groupBy("_domain").count().collect())
    n = sum(sizes.values())
    priors = {d: math.log((sizes.get(d, 0) + 1) / (n + len(domains))) for d in domains}
    # a word is smoothed towards its share in all domains together
    whole = sum((F.col(d) for d in domains), F.lit(0))
    total = sum(v or 0 for v in totals.values()) or 1

    def share(d: str) -> Column:
        words = F.log((F.col(d) + SMOOTH * whole / total) / ((totals[d] or 0) + SMOOTH))
        # a mark comes once in a document
        marks = F.log((F.col(d) + MARK_SMOOTH * whole / max(n, 1)) / (sizes.get(d, 0) + MARK_SMOOTH))
        return F.when(F.col("bucket") < BUCKETS, words).otherwise(marks).alias(d)

    return counts.select("bucket", *map(share, domains)), priors


def memberships(docs: DataFrame, model: DataFrame, priors: dict[str, float]) -> DataFrame:
    """doc_id, tokens (words) and p_<domain> of every row; a text without words has the priors."""
    domains = list(priors)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    # one row for each bucket: a table of bounded size
    met = _evidence(rows, "_row", "doc_id").join(F.broadcast(model), "bucket", "left")
    is_word = F.col("bucket") < BUCKETS
    parts = [F.sum(F.when(is_word, F.col(d))).alias(f"_{d}") for d in domains] + [F.sum(F.when(~is_word, F.col(d))).alias(f"_mark_{d}") for d in domains]
    sums = met.groupBy("_row", "doc_id", "tokens").agg(*parts)
    weight = F.least(F.col("tokens"), F.lit(WORDS)) / F.greatest(F.col("tokens"), F.lit(1))
    zero = F.lit(0.0)
    logits = [F.lit(priors[d]) + weight * F.coalesce(F.col(f"_{d}"), zero) + F.coalesce(F.col(f"_mark_{d}"), zero) for d in domains]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    odds = sums.select("doc_id", "tokens", *[F.exp(x - top).alias(d) for d, x in zip(domains, logits)])
    whole = sum((F.col(d) for d in domains), F.lit(0.0))
    return odds.select("doc_id", "tokens", *[(F.col(d) / whole).alias(f"p_{d}") for d in domains])


def _largest_eigenvalue(matrix: list[list[float]]) -> float:
    x = [1.0] * len(matrix)
    size = 1.0
    for _ in range(200):
        y = [sum(a * b for a, b in zip(row, x)) for row in matrix]
        size = max(map(abs, y)) or 1.0
        x = [v / size for v in y]
    return size


def fit_rates(members: DataFrame, targets: dict[str, float], repeat: bool = True) -> DataFrame:
    """``members`` with rate: the rates, starting from 1, whose domain totals match the targets.

    Minimises the sum over domains of (total - target)^2 / own tokens by projected gradient
    steps in the metric of the documents' tokens, until every total is within CLOSE of the
    tokens in all or after STEPS steps; then a warning says by how much each is missed. A
    target for a domain without tokens can't be met and is left out. Without ``repeat`` a domain that is short of its target keeps its own
    tokens in place of having its documents repeated.
    """
    domains = list(targets)
    p = {d: F.col(f"p_{d}") for d in domains}
    pairs = [(a, b) for a in domains for b in domains]
    sums = members.agg(*[F.sum(F.col("tokens") * p[a] * p[b]) for a, b in pairs], *[F.sum(F.col("tokens") * p[d]) for d in domains]).first()
    gram = {pair: sums[k] or 0.0 for k, pair in enumerate(pairs)}
    own = {d: sums[len(pairs) + k] or 0.0 for k, d in enumerate(domains)}
    domains = [d for d in domains if own[d] > 0]
    if not domains:
        return members.withColumn("rate", F.lit(1.0))
    share = sum(targets[d] for d in domains)
    total = own[domains[0]] / (targets[domains[0]] / share) if targets[domains[0]] else sum(own.values())
    wanted = {d: targets[d] / share * total for d in domains}
    if not repeat:
        wanted = {d: min(w, own[d]) for d, w in wanted.items()}
    least = 1.0 / _largest_eigenvalue([[gram[a, b] / math.sqrt(own[a] * own[b]) for b in domains] for a in domains])
    table, rate, before = members.withColumn("rate", F.lit(1.0)).withColumn("_before", F.lit(1.0)), F.col("rate"), F.col("_before")
    step, last = least, None
    for k in range(STEPS + 1):
        moved = F.sum(F.col("tokens") * (rate - before) * (rate - before))
        found = table.agg(*[F.sum(F.col("tokens") * p[d] * rate) for d in domains], moved).first()
        totals = {d: found[i] or 0.0 for i, d in enumerate(domains)}
        excess = {d: totals[d] - wanted[d] for d in domains}
        if max(map(abs, excess.values())) <= CLOSE * sum(own.values()):
            break
        if k == STEPS:
            warnings.warn(f"after {STEPS} steps the totals of tokens still miss their targets by " + ", ".join(f"{d}: {x:.0f}" for d, x in excess.items()), stacklevel=2)
            break
        if last is not None:
            # Barzilai and Borwein's length: what the last step moved, over what it changed; documents at 0 let it grow
            bent = sum((totals[d] - last[d]) ** 2 / own[d] for d in domains)
            step = min(max((found[len(domains)] or 0.0) / bent, least), 1e4 * least) if bent > 0 else least
        last = totals
        slope = sum((p[d] * F.lit(step * excess[d] / own[d]) for d in domains), F.lit(0.0))
        rate, before = F.greatest(F.lit(0.0), rate - slope), rate
        if k % 10 == 9:  # before the expression grows too long
            table = cut(table.withColumn("_next", rate).withColumn("_before", before).drop("rate").withColumnRenamed("_next", "rate"))
            rate, before = F.col("rate"), F.col("_before")
    return table.withColumn("rate", rate).drop("_before")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, repeat: bool = True) -> DataFrame:
    """doc_id, tokens, p_<domain>, rate and copies of every row of ``docs``.

    ``copies`` is the rate rounded up or down with the probability of its fraction, by a
    hash of doc_id, so that a document's copies are expected to be its rate. Reads
    ``doc_id`` and ``text`` of documents, ``doc_id``, ``quality`` and ``toxic`` of labels
    (rows with a null among them count for nothing), whatever else is there. Null, empty
    and wordless texts have no tokens and the priors as memberships. Without labels all
    memberships are equal. Repeated rows get rows of their own with the same rate.
    """
    model, priors = train(docs, labels, list(targets))
    members = cut(memberships(docs, model, priors))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return fit_rates(members, targets, repeat).withColumn("copies", F.floor(F.col("rate") + chance).cast("long"))


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, repeat: bool = True) -> DataFrame:
    """Each row of ``docs`` as often as mix() says (rows without doc_id once), all columns unchanged.

    Null, empty and wordless texts, missing labels and empty tables are as in mix(); rows
    that repeat a doc_id are repeated alike; columns may have any names.
    """
    copies, nth, key = fresh("copies"), fresh("nth"), fresh("key")
    rates = mix(docs, labels, targets, repeat).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(key)).agg(F.first("copies").alias(copies))
    times = F.coalesce(copies, F.lit(1).cast("long"))
    joined = docs.join(rates, F.col("doc_id") == F.col(key), "left").where(times > 0)
    repeated = joined.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return repeated.select(*map(quoted, docs.columns))
