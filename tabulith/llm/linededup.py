"""Reversible line deduplication.

The truth is a table of exact reference counts: for every line key the number of
documents that have it. A key that reaches the threshold enters the cuckoo filter of its
shard, and leaves it when deleted documents take its count below. Reading a corpus, the
filters (a few bytes for each frequent key) tell which lines might be frequent; only
those are looked up in the exact table. Small filters go to the lines, others get the
lines of their shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import cut, join_groups, map_arrow, strings, text_of

#: Documents that must have a key for its lines to go.
MIN_DOCS = 10
#: Shards of the filters: so many at least, and one for so many documents, which keeps a shard's frequent keys within a task's memory.
SHARDS, SHARD_DOCS = 64, 1_000_000
#: Filters of up to this many bytes together are broadcast; beyond, lines go to the filter of their shard.
BROADCAST_BYTES = 64 << 20
#: Parts of a shard's lines there, each with a copy of its filter: a very frequent line is spread over them.
SALTS = 32
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_SLOTS = 4


class CuckooFilter:
    """A set of 64-bit hashes with false positives (about 8 in 65,536) that can forget them again.

    Buckets of four 16-bit fingerprints; a fingerprint lives in one of two buckets, each of
    which is known from the other. It grows by being built again from its keys.
    """

    def __init__(self, keys: int, table: np.ndarray | None = None) -> None:
        buckets = 1
        while buckets * _SLOTS * 0.85 < keys:
            buckets *= 2
        self.table = np.zeros((buckets, _SLOTS), np.uint16) if table is None else table

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, np.uint16).reshape(-1, _SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        print_ = (hashes >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = hashes & mask
        return print_, first.astype(np.int64), (first ^ self._turn(print_)).astype(np.int64)

    def _turn(self, print_: np.ndarray) -> np.ndarray:
        x = print_.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)
        return (x ^ (x >> np.uint64(32))) & np.uint64(len(self.table) - 1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        print_, first, second = self._places(hashes)
        return ((self.table[first] == print_[:, None]) | (self.table[second] == print_[:, None])).any(1)

    def _fill(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Puts fingerprints into free slots of their buckets; says which found one."""
        order = np.argsort(buckets, kind="stable")
        at = buckets[order]
        begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
        free = self.table[at] == 0
        slot = free & (free.cumsum(1) == (nth + 1)[:, None])
        placed = slot.any(1)
        self.table[at[placed], slot[placed].argmax(1)] = prints[order[placed]]
        done = np.zeros(len(prints), bool)
        done[order[placed]] = True
        return done

    def insert(self, hashes: np.ndarray) -> bool:
        """False if there is no room left; then the filter must be built larger."""
        prints, firsts, seconds = self._places(hashes)
        left = np.flatnonzero(~self._fill(prints, firsts))
        left = left[~self._fill(prints[left], seconds[left])]
        for print_, at in zip(prints[left].tolist(), firsts[left].tolist()):
            for kick in range(500):
                slot = (print_ + kick) % _SLOTS
                print_, self.table[at, slot] = int(self.table[at, slot]), print_
                at ^= int(self._turn(np.array([print_], np.uint16))[0])
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = print_
                    break
            else:
                return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Forgets hashes that were inserted, each once."""
        for print_, first, second in zip(*(x.tolist() for x in self._places(hashes))):
            for bucket in (first, second):
                there = np.flatnonzero(self.table[bucket] == print_)
                if len(there):
                    self.table[bucket, there[0]] = 0
                    break


def _key(line: Column) -> Column:
    """The 128-bit digest of a line's key; null for an empty key."""
    key = F.translate(F.btrim(line, F.lit(_WHITE)), _UPPER, _LOWER)
    return F.when(key != "", F.unhex(F.md5(key)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def key_counts(docs: DataFrame) -> DataFrame:
    """key and n, the number of rows of ``docs`` that have a line with that key."""
    keys = F.array_distinct(F.transform(_lines(text_of()), _key))
    return docs.select(F.explode(keys).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


class State(NamedTuple):
    """Reference counts (key, n), filters (shard, filter), and the number of shards."""

    counts: DataFrame
    filters: DataFrame
    shards: int


def empty_state(spark, shards: int = SHARDS) -> State:
    """The state of no documents."""
    return State(spark.createDataFrame([], "key binary, n long"), spark.createDataFrame([], "shard int, filter binary"), shards)


def _shard(key: Column, shards: int) -> Column:
    """The last four bytes of the digest, modulo the number of shards."""
    return (F.conv(F.hex(F.substring(key, 13, 4)), 16, 10).cast("long") % shards).cast("int")


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)


def _update_filter(key: tuple, changes: pa.Table, filters: pa.Table) -> pa.Table:
    """One shard's filter after keys have become frequent (change 1), are no longer (-1) or stay (0)."""
    keys, change = changes["key"].to_pylist(), changes["change"].to_pylist()
    came, went, stay = ([k for k, c in zip(keys, change) if c == wanted] for wanted in (1, -1, 0))
    if filters.num_rows:
        found = CuckooFilter.from_bytes(filters["filter"][0].as_py())
        found.delete(_hashes(went))
        if found.table.size * 0.85 >= len(came) + len(stay) and found.insert(_hashes(came)):
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([found.to_bytes()], pa.binary())})
    room = len(came) + len(stay)
    while not (found := CuckooFilter(room)).insert(_hashes(came + stay)):
        room = max(8, room * 2)
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([found.to_bytes()], pa.binary())})


def change(state: State, docs: DataFrame, sign: int = 1, min_docs: int = MIN_DOCS) -> State:
    """The state after ``docs`` have been inserted (sign 1) or deleted (sign -1).

    Deleting what was inserted gives back the state before. Both tables are stored in the
    shared folder; keys that no document has any more leave the counts.
    """
    counts, filters, shards = state
    both = counts.select("key", "n", F.lit(0).cast("long").alias("d")).unionByName(
        key_counts(docs).select("key", F.lit(0).cast("long").alias("n"), (F.col("n") * sign).alias("d")))
    merged = cut(both.groupBy("key").agg(F.sum("n").alias("before"), F.sum(F.col("n") + F.col("d")).alias("n")))
    now, then = F.col("n") >= min_docs, F.col("before") >= min_docs
    changes = merged.where(now | then).select(
        _shard(F.col("key"), shards).alias("shard"), "key", (now.cast("int") - then.cast("int")).alias("change"))
    by_shard = changes.groupBy("shard").cogroup(filters.groupBy("shard"))
    new_filters = cut(by_shard.applyInArrow(_update_filter, "shard int, filter binary"))
    return State(merged.where("n > 0").select("key", "n"), new_filters, shards)


def _held_candidates(rows: DataFrame, state: State) -> DataFrame:
    """doc_id, digest, key and place of the lines that the filters hold to be frequent. One pass, no shuffle."""
    held, shards = state.filters.select("shard", "filter").toArrow(), state.shards
    shipped = rows.sparkSession.sparkContext.broadcast(dict(zip(held["shard"].to_pylist(), held["filter"].to_pylist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {s: CuckooFilter.from_bytes(f) for s, f in shipped.value.items()}
        for batch in batches:
            found, places, keys = [], [], []
            for i, text in enumerate(strings(batch.column("text"))):
                own = [line.strip(_WHITE).translate(_FOLD) for line in text.split("\n")]
                digests = {k: hashlib.md5(k.encode()).digest() for k in set(own) if k}
                at = [j for j, k in enumerate(own) if k]
                found += [i] * len(at)
                places += at
                keys += [digests[own[j]] for j in at]
            if not keys:
                continue
            hashes, maybe = _hashes(keys), np.zeros(len(keys), bool)
            shard = np.frombuffer(b"".join(k[12:] for k in keys), ">u4") % shards
            for number in np.unique(shard).tolist():
                if number in tables:
                    mine = np.flatnonzero(shard == number)
                    maybe[mine] = tables[number].contains(hashes[mine])
            at = np.flatnonzero(maybe)
            rows_ = pa.array(np.asarray(found)[at])
            columns = [batch.column("doc_id").take(rows_), batch.column("digest").take(rows_), pa.array([keys[i] for i in at], pa.binary()), pa.array(np.asarray(places, np.int32)[at])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "key", "place"])

    return map_arrow(rows, run, _candidate_schema(rows))


def _candidate_schema(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, key binary, place int"


def _sharded_candidates(rows: DataFrame, state: State) -> DataFrame:
    """The same, where lines go to their shard's filter: a task holds one filter and a batch of lines at a time."""
    lines = rows.select("doc_id", "digest", F.posexplode(F.transform(_lines(text_of()), _key)).alias("place", "key")).where("key IS NOT NULL")
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")
    lines = lines.select(_shard(F.col("key"), state.shards).alias("shard"), salt.alias("salt"), F.lit(None).cast("binary").alias("filter"), "doc_id", "digest", "key", "place")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    filters = state.filters.select("shard", salts.alias("salt"), "filter", *[F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("doc_id", "digest", "key", "place")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = table = None
        for batch in batches:
            shards, filters = batch.column("shard").to_pylist(), batch.column("filter")
            hit = np.zeros(len(shards), bool)
            begins = [i for i in range(len(shards)) if i == 0 or shards[i] != shards[i - 1] or filters[i].is_valid]
            for begin, end in zip(begins, [*begins[1:], len(shards)]):
                if filters[begin].is_valid:
                    here, table, begin = shards[begin], CuckooFilter.from_bytes(filters[begin].as_py()), begin + 1
                if begin < end and here == shards[begin]:
                    hit[begin:end] = table.contains(_hashes(batch.column("key").slice(begin, end - begin).to_pylist()))
            at = pa.array(np.flatnonzero(hit))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("doc_id", "digest", "key", "place")], ["doc_id", "digest", "key", "place"])

    # a shard's filter comes before its lines
    sorted_ = lines.unionByName(filters).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
    return map_arrow(sorted_, run, _candidate_schema(rows))


def drop_frequent_lines(docs: DataFrame, state: State, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and the kept text of every row of ``docs``.

    Lines whose key the state counts in ``min_docs`` documents or more are dropped. Null
    and empty texts are one empty line; empty keys are never frequent. Rows that repeat a
    doc_id, whatever their texts, are documents of their own in the counts and are
    returned each. Very long texts and lines are read whole; an empty table gives no rows.
    Reads ``doc_id`` and ``text``, whatever else is there.
    """
    frequent = cut(state.counts.where(F.col("n") >= min_docs))
    size = state.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
    rows = docs.select("doc_id", "text", F.unhex(F.md5(text_of().cast("binary"))).alias("digest"))
    maybe = (_held_candidates if size <= BROADCAST_BYTES else _sharded_candidates)(rows, state)
    hits = join_groups(maybe, frequent, "key", "n", F.struct("digest", "place"))
    by_doc = hits.groupBy(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")).agg(F.collect_set("place").alias("_places"))
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    lines = _lines(text_of())
    split = joined.select("doc_id", lines.alias("_lines"), "_places")
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_places"))
    kept = F.when(F.col("_places").isNull(), F.col("_lines")).otherwise(F.transform(places, lambda i: F.get("_lines", i)))
    cleaned = split.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), kept.alias("_kept"))
    text = F.array_join("_kept", "\n")
    return cleaned.select("doc_id", "n_lines", (F.col("n_lines") - F.size("_kept")).alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"), text.alias("kept"))


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """drop_frequent_lines() of a corpus by its own counts."""
    shards = max(SHARDS, docs.count() // SHARD_DOCS)
    state = change(empty_state(docs.sparkSession, shards), docs, 1, min_docs)
    return drop_frequent_lines(docs, state, min_docs)


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id
"""
