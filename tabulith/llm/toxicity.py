"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, say how likely a word is after another. The
highest order of each has the discounted counts of the class's own word pairs. What the
discount takes goes to a back-off that both share: the pair counts of all labelled text,
tilted by how much likelier the word is in the class by its Kneser-Ney continuation
counts (the number of different words that it follows there), which are discounted in
turn towards the continuation counts of both classes. So a pair or a word that is rare
has the same odds in both. A text is judged by its toxic and ordinary log-likelihoods,
normalised by length: of the whole text, and of its most toxic expression. A logistic
curve fitted on labelled texts that the models haven't counted makes a score of these.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.llm.common import cut, forget, fresh, map_arrow, quoted, store, strings, text_of

#: What Kneser-Ney takes from every count: of word pairs, and of words' continuations.
PAIR_DISCOUNT, DISCOUNT = 10, 2
#: Words of the expressions whose likelihoods are compared besides the whole text's.
EXPRESSION = 1
#: Most entries of the models that the workers hold: 32 MB. Where there are more, the most
#: frequent are held, and texts meet the others in a shuffled join.
HELD = 1 << 21
#: Bits of the filter by which workers know what isn't in that join: 32 MB.
FILTER_BITS = 28
#: About the most labelled texts that the logistic curve is fitted on (two numbers each).
FITTED = 20_000
#: Labels up to this many are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Most words whose hashes a worker remembers.
CACHED = 100_000
#: Words of the texts that a worker reads at once.
CHUNK = 200_000
_WORD = re.compile(r"[^\W_]+")
_GOLD, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def keys_of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of all words and of the words before them (of no word at a text's begin), and where texts begin."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        word = np.fromiter((self[w] for t in texts for w in t), np.uint64, int(sizes.sum()))
        before = np.zeros(len(word), np.uint64)
        before[1:] = word[:-1]
        before[starts[sizes > 0]] = 0
        # another key than the same word's as a word; a bijection
        before = (before ^ _GOLD) * _M
        before = (before ^ (before >> np.uint64(32))) * _M
        return word, before ^ (before >> np.uint64(29)), starts


def _chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, int, list[list[str]]]]:
    """The words of consecutive texts: their batch, the place of the first in it, and a list for each; about CHUNK words at once."""
    for batch in batches:
        at, part, size = 0, [], 0
        for text in strings(batch.column(column)):
            part.append(words(text))
            size += len(part[-1])
            if size >= CHUNK:
                yield batch, at, part
                at, part, size = at + len(part), [], 0
        if part:
            yield batch, at, part


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, fold and toxic of labelled rows that aren't held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").where(fold(F.col("doc_id")) != 0).join(known, "doc_id")


def pair_counts(labelled: DataFrame) -> DataFrame:
    """before and word (keys), ordinary and toxic: how often the word follows the other in either class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch, at, texts in _chunks(batches):
            word, before, starts = hashes.keys_of(texts)
            if not len(word):
                continue
            toxic = np.array([t == 1 for t in batch.column("toxic").slice(at, len(texts)).to_pylist()])
            # both counts in one number
            n = np.where(toxic, np.int64(1) << 32, np.int64(1)).repeat(np.diff(np.r_[starts, len(word)]))
            order = np.argsort(word ^ before)
            word, before, n = word[order], before[order], n[order]
            first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (before[1:] != before[:-1])])
            columns = [before[first].view(np.int64), word[first].view(np.int64), np.add.reduceat(n, first)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["before", "word", "n"])

    pairs = map_arrow(labelled.select("text", "toxic"), run, "before long, word long, n long")
    n = F.sum("n")
    return pairs.groupBy("before", "word").agg(n.bitwiseAND(F.lit(0xFFFFFFFF)).alias("ordinary"), F.shiftright(n, 32).alias("toxic"))


def _model(pairs: DataFrame) -> tuple[DataFrame, float]:
    """The entries (key, n, odds) of the two models, and the odds of a word without any.

    Odds are log P(word | before, toxic) - log P(word | before, ordinary). Those of a pair
    that has an entry (more in all than the discount, key: both keys' exclusive or) are
    that entry's; those of any other pair are the sum of the odds of the word's entry, or
    of a word without one, and of the entry of the word before, if there is one: exactly
    what the formula gives for a pair whose counts the discount takes whole.
    """
    both = ("ordinary", "toxic")
    least = lambda c, d: F.least(F.col(c), F.lit(d))
    conts = cut(pairs.groupBy("word").agg(*[F.count_if(F.col(c) > 0).alias(c) for c in both]))
    totals = conts.agg(*[F.sum(c).alias(c) for c in both], *[F.sum(least(c, DISCOUNT)).alias(f"taken_{c}") for c in both]).first().asDict()
    size = {c: max(1.0, float(totals[c] or 0)) for c in both}
    weight = {c: max(float(totals[f"taken_{c}"] or 0), 1e-9) / size[c] for c in both}
    shared_size = max(1.0, float((totals["taken_ordinary"] or 0) + (totals["taken_toxic"] or 0)))
    unseen = math.log(weight["toxic"]) - math.log(weight["ordinary"])
    shared = F.greatest(sum((least(c, DISCOUNT) for c in both), F.lit(0)), F.lit(1)) / shared_size
    a = {c: F.greatest(F.col(c) - DISCOUNT, F.lit(0)) / size[c] + weight[c] * shared for c in both}
    ratios = conts.select("word", F.greatest(*both).alias("most"), sum(map(F.col, both), F.lit(0)).alias("n"), *[a[c].alias(f"a_{c}") for c in both])
    of_words = ratios.where(F.col("most") > DISCOUNT).select(F.col("word").alias("key"), "n", (F.log("a_toxic") - F.log("a_ordinary") - unseen).alias("odds"))

    whole = F.col("ordinary") + F.col("toxic")
    taken = [F.sum(least(c, PAIR_DISCOUNT)).alias(f"taken_{c}") for c in both] + [F.sum(F.least(whole, F.lit(PAIR_DISCOUNT))).alias("taken")]
    befores = cut(pairs.groupBy("before").agg(*[F.sum(c).alias(f"n_{c}") for c in both], *taken))
    # what a class's pairs hand to the back-off; all, where it has none after this word
    left = {c: F.when(F.col(f"n_{c}") > 0, F.col(f"taken_{c}") / F.col(f"n_{c}")).otherwise(F.lit(1.0)) for c in both}
    n_before = F.col("n_ordinary") + F.col("n_toxic")
    of_befores = befores.where(" OR ".join(f"taken_{c} < n_{c}" for c in both))
    of_befores = of_befores.select(F.col("before").alias("key"), n_before.alias("n"), (F.log(left["toxic"]) - F.log(left["ordinary"])).alias("odds"))

    telling = pairs.where(whole > PAIR_DISCOUNT).join(ratios.drop("n"), "word").join(befores, "before")
    middle = (F.col("a_ordinary") + F.col("a_toxic")) / 2
    pooled = (whole - PAIR_DISCOUNT) / n_before + F.col("taken") / n_before * middle

    def likelihood(c: str) -> Column:
        own = F.when(F.col(f"n_{c}") > 0, F.greatest(F.col(c) - PAIR_DISCOUNT, F.lit(0)) / F.col(f"n_{c}")).otherwise(F.lit(0.0))
        return own + left[c] * F.col(f"a_{c}") / middle * pooled

    of_pairs = telling.select(F.col("word").bitwiseXOR(F.col("before")).alias("key"), whole.alias("n"), (F.log(likelihood("toxic")) - F.log(likelihood("ordinary"))).alias("odds"))
    kinds = [(of_words, 0), (of_befores, 1), (of_pairs, 2)]
    words_, befores_, pairs_ = (e.select("key", F.lit(k).cast("byte").alias("kind"), F.col("n").cast("long").alias("n"), "odds") for e, k in kinds)
    return words_.unionByName(befores_).unionByName(pairs_), unseen


class Entries:
    """Entries of the models by key: of words and of words before (kind 0 and 1: parts of a sum), and of pairs (kind 2)."""

    def __init__(self, key: np.ndarray, kind: np.ndarray, odds: np.ndarray) -> None:
        self.parts = []
        for pair in (False, True):
            mine = np.flatnonzero((kind == 2) == pair)
            own = key[mine].astype(np.int64).view(np.uint64)
            order = np.argsort(own)
            # most keys aren't here: a bit for some of a key's bits says so at once
            bits = max(10, math.ceil(math.log2(max(len(own), 1))) + 4)
            seen = np.zeros(1 << bits, bool)
            seen[own & np.uint64((1 << bits) - 1)] = True
            self.parts.append((own[order], odds[mine][order], seen))

    def find(self, keys: np.ndarray, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        """The places of those keys that have an entry, and their odds."""
        own, odds, seen = self.parts[pairs]
        at = np.flatnonzero(seen[keys & np.uint64(len(seen) - 1)])
        place = np.minimum(np.searchsorted(own, keys[at]), max(len(own) - 1, 0))
        hit = own[place] == keys[at] if len(own) else np.zeros(len(at), bool)
        return at[hit], odds[place[hit]]


class Odds:
    """The entries that workers hold, the odds of a word without an entry, and a filter of the keys of all other entries."""

    def __init__(self, held: pa.Table, unseen: float, rest: np.ndarray | None = None) -> None:
        self.held = Entries(held["key"].to_numpy(), held["kind"].to_numpy(), held["odds"].to_numpy())
        self.unseen = unseen
        self.rest = rest

    def maybe_rest(self, keys: np.ndarray) -> np.ndarray:
        """Which keys may have an entry that isn't held."""
        bits = (64 * len(self.rest)).bit_length() - 1
        low = np.uint64((1 << bits) - 1)
        hit = np.ones(len(keys), bool)
        for place in (keys & low, (keys >> np.uint64(bits)) & low):
            hit &= (self.rest[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return hit

    def __call__(self, word: np.ndarray, before: np.ndarray, more: Entries | None = None) -> np.ndarray:
        """The odds of every word after the one before it."""
        odds = np.full(len(word), self.unseen)
        tables = [self.held] + [more] * (more is not None)
        for keys, pairs in ((word, False), (before, False), (word ^ before, True)):
            for table in tables:
                at, found = table.find(keys, pairs)
                odds[at] = found if pairs else odds[at] + found
        return odds


def train_odds(labelled: DataFrame) -> tuple[Odds, DataFrame | None]:
    """The models of all labelled texts of folds 1 to 3: what the workers hold, and the entries beyond that (key, kind, odds)."""
    spark = labelled.sparkSession
    pairs, path = store(pair_counts(labelled.where("fold < 4")))
    entries, unseen = _model(pairs)
    entries = cut(entries.withColumn("level", F.floor(F.log2("n") * 4)))
    forget(spark, path)
    # entries by frequency, a few hundred levels at most: the lowest down to which all can be held
    lowest, n = None, 0
    levels = sorted(((r["level"], r["count"]) for r in entries.groupBy("level").count().collect()), reverse=True)
    for level, size in levels:
        n += size
        if n > HELD:
            break
        lowest = level
    is_held = F.lit(False) if lowest is None else F.col("level") >= lowest
    held = entries.where(is_held).select("key", "kind", "odds").toArrow()
    if n <= HELD:
        return Odds(held, unseen), None
    rest = entries.where(~is_held).select("key", "kind", "odds")
    return Odds(held, unseen, _filter(rest)), rest


def _filter(rest: DataFrame) -> np.ndarray:
    """The bits of two places for every key, as 64-bit numbers: of fixed size, whatever the number of keys."""
    low = F.lit((1 << FILTER_BITS) - 1)
    places = F.array(F.col("key").bitwiseAND(low), F.shiftrightunsigned("key", FILTER_BITS).bitwiseAND(low))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    numbers = rest.select(F.explode(places).alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[numbers["at"].to_numpy()] = numbers["bits"].to_numpy().view(np.uint64)
    return bits


def features(odds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Length-normalised log-odds of texts that begin at ``starts``: of all their words, and of their most toxic expression; 0 without words."""
    sizes = np.diff(np.r_[starts, len(odds)])
    made = np.zeros((len(starts), 2))
    some = np.flatnonzero(sizes)
    if len(some):
        made[some, 0] = np.add.reduceat(odds, starts[some]) / sizes[some]
        window = odds
        if EXPRESSION > 1:
            sums = np.r_[0.0, np.cumsum(odds)]
            end = np.minimum(np.arange(len(odds)) + EXPRESSION, np.repeat(starts + sizes, sizes))
            window = (sums[end] - sums[:-1]) / EXPRESSION
        made[some, 1] = np.maximum.reduceat(window, starts[some])
    return made


def _rest_of_texts(keyed: DataFrame, odds: Broadcast, rest: DataFrame, text_key: str) -> DataFrame:
    """The digest of a text and _more: the entries that its words have in ``rest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch, at, texts in _chunks(batches):
            word, before, starts = hashes.keys_of(texts)
            keys = np.concatenate([word, before, word ^ before])
            owner = np.tile(np.repeat(np.arange(len(texts)), np.diff(np.r_[starts, len(word)])), 3)
            kept = np.flatnonzero(odds.value.maybe_rest(keys))
            owner, keys = owner[kept], keys[kept].view(np.int64)
            order = np.lexsort((keys, owner))
            owner, keys = owner[order], keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(text_key).take(pa.array(owner[new] + at)), pa.array(keys[new])], [text_key, "key"])

    unheld = map_arrow(keyed.select(text_key, "text"), run, T.StructType([keyed.schema[text_key], T.StructField("key", T.LongType())])).distinct()
    met = unheld.join(rest, "key")
    return met.groupBy(text_key).agg(F.collect_list(F.struct("key", "kind", "odds")).alias("_more"))


def _with_features(rows: DataFrame, trained: tuple[Odds, DataFrame | None], kept: list[str], made: str) -> DataFrame:
    """The columns ``kept`` and the features (``made``) of every row's text. One pass without a shuffle where all entries are held."""
    shipped, rest = rows.sparkSession.sparkContext.broadcast(trained[0]), trained[1]
    # names that mapInArrow can read
    safe = {k: "text" if k == "text" else f"c{i}" for i, k in enumerate(kept)}
    rows = rows.select(*(quoted(k).alias(s) for k, s in ({"text": "text"} | safe).items()))
    more_of = None
    if rest is not None:
        text_key, more_of = fresh("text"), fresh("more")
        keyed = rows.withColumn(text_key, F.unhex(F.md5(text_of().cast("binary"))))
        found = _rest_of_texts(keyed, shipped, rest, text_key).withColumnRenamed("_more", more_of)
        rows = keyed.join(found, text_key, "left").drop(text_key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes = shipped.value, _Hashes()
        for batch, at, texts in _chunks(batches):
            word, before, starts = hashes.keys_of(texts)
            if more_of is None:
                found = features(model(word, before), starts)
            else:
                parts, ends = [], np.r_[starts[1:], len(word)]
                for i, (begin, end) in enumerate(zip(starts, ends)):
                    more = batch.column(more_of)[at + i].as_py() or []
                    own = Entries(*(np.array([m[c] for m in more], kind) for c, kind in (("key", np.int64), ("kind", np.int8), ("odds", float))))
                    parts.append(features(model(word[begin:end], before[begin:end], own), np.zeros(1, np.int64)))
                found = np.concatenate(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * 2), pa.array(found.ravel()))
            here = batch.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([*(here.column(s) for s in safe.values()), lists], [*safe.values(), made])

    schema = T.StructType([*(rows.schema[s] for s in safe.values()), T.StructField(made, T.ArrayType(T.DoubleType()))])
    return map_arrow(rows, run, schema).select(*(F.col(s).alias(k) for k, s in safe.items()), made)


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve, the last of them constant; the base rate alone if y is all the same."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.1
        return np.r_[np.zeros(x.shape[1]), np.log(rate / (1 - rate))]
    x = np.c_[x, np.ones(len(x))]
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(b))
        step = np.linalg.solve(hessian, x.T @ (y - p) - 1e-3 * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score at least 0.5) of every row of ``docs``.

    Reads ``doc_id`` and ``text`` of documents, ``doc_id`` and ``toxic`` of labels, whatever
    else is there. Labels of held-out rows (fold 0) are never read; rows without a label
    count for nothing; a doc_id with several labels counts once for each. Null and empty
    texts, and those without words, get the score of a text without evidence; without
    labels every text gets the same low score, an empty table gives no rows. Very long
    texts are read whole. Repeated rows are scored each, and equal texts alike.
    """
    scored = _scored(docs, labels, ["doc_id"], "score")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _scored(docs: DataFrame, labels: DataFrame, kept: list[str], name: str) -> DataFrame:
    """The columns ``kept`` and the score (``name``) of every row of ``docs``."""
    labelled = _labelled(docs, labels)
    trained = train_odds(labelled)
    n = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) == 4).count()
    # about FITTED of more, by a hash of doc_id: no sort, and no texts in one place
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(math.ceil((1 << 20) * min(1.0, FITTED / max(n, 1))))
    tried = labelled.where("fold = 4").where(drawn)
    made = fresh("features")
    fitted = _with_features(tried, trained, ["doc_id", "toxic"], made).select("toxic", made).toArrow()
    x = np.array(fitted[made].to_pylist(), float).reshape(-1, 2)
    y = pc.equal(fitted["toxic"], 1).to_numpy().astype(float)
    curve = [float(v) for v in fit_curve(x, y)]
    logit = F.lit(curve[-1])
    for k, weight in enumerate(curve[:-1]):
        logit = logit + F.lit(weight) * F.col(made)[k]
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    return _with_features(docs, trained, kept, made).select(*map(quoted, kept), score.alias(name))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that toxicity() does not reject, all their columns unchanged.

    Each row is judged by its own text, whatever its doc_id: null, repeated and shared
    doc_ids, null and empty texts are as in toxicity(); an empty table stays empty.
    Columns may have any names.
    """
    name = fresh("score")
    return _scored(docs, labels, docs.columns, name).where(F.col(name) < 0.5).drop(name)
