"""Near-duplicate classes by DartMinHash signatures and banded joining.

Every unit of weight of a shingle is a region into which hashed darts fall at the ranks
of a Poisson process, the same in every text that has the unit. A text takes the darts
of its regions up to a rank that gives some k (ln k + c) of them, whatever its length,
and keeps the earliest dart of each of k coordinates: two texts agree in a coordinate
with the probability of their weighted Jaccard similarity. Texts that agree in all
coordinates of a band meet in a bucket and are compared there by their whole shingle
sets; links of enough similarity make classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import cut, fresh, join_groups, map_arrow, quoted, strings
from tabulith.llm.shingles import cells, mix, similarity

#: Bands and coordinates in a band: two texts of similarity 0.8 share a bucket with probability 0.9998.
BANDS, ROWS = 22, 5
SIMILAR = 0.8
#: Members of a bucket that are compared with all its others in the second round.
CENTRES = 8
#: Characters of text whose shingles a worker holds while it compares.
HELD = 1_500_000
#: Texts of up to so many pairs are found by a broadcast of their identifiers (16 MB at most), else by a shuffle.
BROADCAST_IDS = 500_000
#: Characters of text, and darts, whose signatures are made at once.
CHUNK, DARTS = 500_000, 300_000
#: Coordinates in which two texts must agree for their texts to be compared. At similarity
#: 0.8 the number is binomial with mean 88 and deviation 4.2: below 62 with probability 1e-8.
AGREED = 62
_STEP = np.uint64(0xD1B54A32D192ED03)


def dart_signatures(shingle: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The identifier of the earliest dart of each coordinate, for every text (0 where it has no cell)."""
    sizes = np.diff(starts)
    signature = np.zeros((len(sizes), k), np.uint64)
    todo = np.flatnonzero(sizes > 0)
    wanted = k * (np.log(k) + 3.0)
    while len(todo):
        n = sizes[todo]
        owner = np.repeat(np.arange(len(todo)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[todo], n)
        limit = (wanted / n)[owner]
        state, rank = mix(shingle[at] ^ _STEP), np.zeros(len(owner))
        throws: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(state):
            rank = rank - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            hit = rank <= limit
            state, rank, owner, limit = state[hit], rank[hit], owner[hit], limit[hit]
            dart = mix(state + _STEP)
            throws.append((owner * k + (dart % np.uint64(k)).astype(np.int64), rank, dart))
            state = mix(dart ^ state)
        place, ranks, darts = (np.concatenate(x) for x in zip(*throws))
        late_first = np.argsort(-ranks, kind="stable")
        earliest = np.zeros(len(todo) * k, np.uint64)
        earliest[place[late_first]] = darts[late_first] | np.uint64(1)
        earliest = earliest.reshape(len(todo), k)
        full = (earliest != 0).all(1)
        signature[todo[full]] = earliest[full]
        todo, wanted = todo[~full], wanted * 2  # more darts for texts with an empty coordinate
    return signature


def _chunks(texts: Iterator[str]) -> Iterator[list[str]]:
    """Consecutive texts, together of at most CHUNK characters and DARTS darts, or one text."""
    # a text has about so many darts, however short it is
    each = CHUNK * BANDS * ROWS * (math.log(BANDS * ROWS) + 3.0) / DARTS
    part: list[str] = []
    size = 0.0
    for text in texts:
        if part and size + len(text) + each > CHUNK:
            yield part
            part, size = [], 0.0
        part.append(text)
        size += len(text) + each
    if part:
        yield part


def _sketches(docs: DataFrame) -> DataFrame:
    """id, print (128 bits of the whole shingle multiset), weight, band hashes and 16 bits of every coordinate; texts without words left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _chunks(strings(batch.column("text"))):
                shingle, starts = cells(texts)
                weight = np.diff(starts)
                some = weight > 0
                ids = batch.column("id").slice(at, len(texts))
                at += len(texts)
                if not some.any():
                    continue
                signature = dart_signatures(shingle, starts, BANDS * ROWS).reshape(len(texts), BANDS, ROWS)
                band = np.zeros((len(texts), BANDS), np.uint64)
                for row in range(ROWS):
                    band = mix(band + _STEP) ^ signature[:, :, row]
                band = mix(band + np.arange(BANDS, dtype=np.uint64) * _STEP)
                first = starts[:-1][some]
                prints = np.stack([np.add.reduceat(shingle, first), np.add.reduceat(mix(shingle ^ _STEP), first)], 1)
                bands = pa.ListArray.from_arrays(np.arange(some.sum() + 1, dtype=np.int32) * BANDS, band[some].astype(np.int64).ravel())
                agree = signature[some].reshape(-1, BANDS * ROWS).astype(np.uint16)
                made = [pa.array([row.tobytes() for row in rows], pa.binary()) for rows in (prints, agree)]
                columns = [ids.filter(pa.array(some)), made[0], pa.array(weight[some]), bands, made[1]]
                yield pa.RecordBatch.from_arrays(columns, ["id", "print", "weight", "bands", "signature"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return map_arrow(rows, run, f"id {_kind(docs)}, print binary, weight long, bands array<long>, signature binary")


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


class _Cells:
    """The cells of the texts compared last, up to HELD characters of text."""

    def __init__(self) -> None:
        self.known: dict = {}
        self.size = 0

    def __call__(self, key, batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
        if key not in self.known:
            text = batch.column(column)[i].as_py() or ""
            self.size += len(text)
            if self.size > HELD:
                self.known.clear()
                self.size = len(text)
            self.known[key] = cells([text])[0]
        return self.known[key]


def _agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of ``pairs`` (low, high) that agree in AGREED coordinates or more: rows of a few hundred bytes, so texts needn't move for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS) for c in ("low_signature", "high_signature"))
            hit = pa.array((low == high).sum(1) >= AGREED)
            yield pa.RecordBatch.from_arrays([batch.column("low").filter(hit), batch.column("high").filter(hit)], ["low", "high"])

    both = pairs.join(signatures.select(F.col("id").alias("high"), F.col("signature").alias("high_signature")), "high")
    both = both.join(signatures.select(F.col("id").alias("low"), F.col("signature").alias("low_signature")), "low")
    return map_arrow(both.select("low", "high", "low_signature", "high_signature"), run, pairs.schema)


def _similar_pairs(pairs: DataFrame, texts: DataFrame, signatures: DataFrame, similar: float) -> DataFrame:
    """Those of ``pairs`` (low, high) whose whole texts are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Cells()
        for batch in batches:
            low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            hit = [similarity(held(a, batch, "low_text", i), held(b, batch, "high_text", i)) >= similar for i, (a, b) in enumerate(zip(low, high))]
            yield pa.RecordBatch.from_arrays([batch.column("low").filter(pa.array(hit)), batch.column("high").filter(pa.array(hit))], ["low", "high"])

    pairs = cut(_agreeing(pairs, signatures))
    need = pairs.select(F.explode(F.array("low", "high")).alias("id")).distinct()
    if pairs.count() <= BROADCAST_IDS:
        need = F.broadcast(need)
    own = texts.join(need, "id", "left_semi")
    # a text that very many are compared with is a skewed key, which adaptive execution splits
    both = pairs.join(own.select(F.col("id").alias("high"), F.col("text").alias("high_text")), "high")
    both = both.join(own.select(F.col("id").alias("low"), F.col("text").alias("low_text")), "low")
    return cut(map_arrow(both.select("low", "high", "low_text", "high_text"), run, pairs.schema))


def classes(members: DataFrame, texts: DataFrame, signatures: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """id and class_id of every text that is linked to another.

    ``members`` are (bucket, id, weight); ``texts`` are (id, text); ``signatures`` are (id, signature). A class is a connected
    component of the links between similar texts that share a bucket. Three rounds find
    them all without comparing the members of a class among themselves: each bucket's
    first member with its others; then CENTRES of its members with those of other classes;
    at last every member outside its bucket's largest class with all members of other
    classes. After that no pair of a bucket is left that is neither of one class nor
    compared. Texts whose weights alone forbid the similarity are never compared.

    A bucket of many members is a skewed key of these joins, which adaptive execution splits.
    """
    near = F.least("weight", "weight2") >= F.lit(similar - 1e-9) * F.greatest("weight", "weight2")

    def pairs_of(met: DataFrame) -> DataFrame:
        ends = met.where("id <> id2").where(near)
        return ends.select(F.least("id", "id2").alias("low"), F.greatest("id", "id2").alias("high")).distinct()

    shared = members.groupBy("bucket").agg(F.min(F.struct("id", "weight")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = shared.select("bucket", F.col("c.id").alias("id2"), F.col("c.weight").alias("weight2"))
    crowd = cut(members.join(shared, "bucket"))
    links = _similar_pairs(pairs_of(crowd), texts, signatures, similar)
    labels = components(links)
    for last in (False, True):
        placed = crowd.select("bucket", "id", "weight").join(labels, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
        mixed = placed.groupBy("bucket").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("bucket")
        crowd = cut(placed.join(mixed, "bucket"))
        other = crowd.select("bucket", F.col("id").alias("id2"), F.col("weight").alias("weight2"), F.col("class_id").alias("class2"))
        if last:
            sizes = crowd.groupBy("bucket", "class_id").agg(F.count(F.lit(1)).alias("n"))
            largest = sizes.groupBy("bucket").agg(F.max_by("class_id", F.struct("n", "class_id")).alias("largest"))
            chosen = other.join(largest, "bucket").where("class2 <> largest").drop("largest")
        else:
            part = F.pmod(F.xxhash64("id2"), F.lit(CENTRES))
            firsts = [F.min(F.when(part == j, F.struct("id2", "weight2", "class2"))) for j in range(CENTRES)]
            found = other.groupBy("bucket").agg(F.array_compact(F.array(*firsts)).alias("c"))
            chosen = found.select("bucket", F.inline("c"))
        met = crowd.join(chosen, "bucket").where("class_id <> class2")
        links = links.unionByName(_similar_pairs(pairs_of(met), texts, signatures, similar))
        labels = components(links)
    return labels


def components(edges: DataFrame) -> DataFrame:
    """id and class_id (its least member) of every identifier in ``edges`` (low, high).

    Alternating large-star and small-star steps: both keep the number of rows within that
    of the edges, and every step's rows are stored in the shared folder.
    """
    now = cut(edges.select("low", "high").where("low <> high").distinct())
    before = None
    while True:
        # both steps join a node's links to its one row: skewed keys, which adaptive execution splits
        both = now.union(now.select("high", "low")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = cut(both.where("b > a").join(least, "a").select(F.col("m").alias("low"), F.col("b").alias("high")).where("low <> high").distinct())
        up = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(up, "high").select(F.explode(F.array(F.struct(F.col("m").alias("low"), F.col("low").alias("high")), F.struct(F.col("m").alias("low"), "high"))).alias("e"))
        now = cut(small.select("e.low", "e.high").where("low <> high").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("high").alias("id"), F.col("low").alias("class_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size and kept (doc_id is class_id) of every row of ``docs``, whatever the type of doc_id.

    A class is a connected component of links between texts whose weighted sets of
    five-word shingles (words lower-cased, punctuation dropped) have a Jaccard similarity
    of at least 0.8; class_id is its least doc_id. Reads ``doc_id`` and ``text``, whatever
    else is there. Null texts, empty ones and texts without words are in no one's class
    but their own; so are rows with a null doc_id, whose class_id is null and which are
    kept. Rows that repeat a doc_id are in the class of that doc_id. Very long texts are
    compared whole; an empty table gives no rows.
    """
    sketches = cut(_sketches(docs))
    # texts with the same shingles are one text from here on
    one = F.struct("id", "weight", "bands", "signature")
    texts = sketches.groupBy("print").agg(F.min("id").alias("id"), F.any_value(one).alias("one"), F.count(F.lit(1)).alias("n"))
    texts = cut(texts.select("print", "id", "one.weight", "one.bands", "one.signature", "n"))
    members = texts.select(F.explode("bands").alias("bucket"), "id", "weight")
    whole = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    named = texts.join(classes(members, whole, texts.select("id", "signature")), "id", "left").select("print", "id", "n", F.coalesce("class_id", "id").alias("class_id"))
    placed = join_groups(sketches.select(F.col("id").alias("doc_id"), "print"), named.drop("id"), "print", "n", F.col("doc_id"))
    placed = cut(placed.groupBy("doc_id").agg(F.min("class_id").alias("class_id")))
    sizes = placed.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size"))
    sized = join_groups(placed, sizes, "class_id", "class_size", F.col("doc_id"))
    every = docs.select("doc_id").join(sized, "doc_id", "left")
    own = F.coalesce("class_id", "doc_id")
    return every.select("doc_id", own.alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one_of_each_class(docs: DataFrame) -> DataFrame:
    """Of every class of near-duplicates the row with the least doc_id, all its columns unchanged.

    Rows with a null doc_id stay, as near_duplicates() has it. Where rows share a doc_id,
    each is placed by its own text, and of those in one class one stays. Null, empty and
    wordless texts stay; an empty table stays empty; columns may have any names.
    """
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
    # stored, so that a row has the same number whenever it is read
    row = fresh("row")
    rows = cut(docs.withColumn(row, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    placed = cut(near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).where("doc_id IS NOT NULL").select(F.col("doc_id").alias(row), "class_id"))
    first = placed.join(rows.select(row, "doc_id"), row).groupBy("class_id").agg(F.min(F.struct("doc_id", row))[row].alias(row))
    gone = placed.select(row).join(first.select(row), row, "left_anti")
    return rows.join(gone, row, "left_anti").select(*map(quoted, docs.columns))
