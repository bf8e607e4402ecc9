"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments, each indexed by its value. In round r a query
probes, in every segment, all values at distance r from its own. Two codes at distance
d < segments * (r + 1) differ by r or less in some segment, so once the k-th best of the
verified codes is that near, nothing better is left and the query is done; the others go
on with the next radius.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulith.llm.common import HOT_SHARE, cut, join_groups

BITS = 64
#: Neighbours of the registered query.
K = 10


def sign_codes(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and code: bit i says whether component i is above 0 (a missing or NaN one isn't).

    Rows with a null id or vector have no code and are left out; components beyond the
    64th are ignored.
    """
    bits = F.transform(
        F.slice(vector, 1, BITS),
        lambda x, i: F.when((x > 0) & ~F.isnan(x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")),
    )
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return vectors.where(f"`{id_column}` IS NOT NULL AND `{vector}` IS NOT NULL").select(F.col(id_column).cast("long").alias("id"), code.alias("code"))


def _segment(code: Column, s: int, width: int) -> Column:
    return F.shiftrightunsigned(code, s * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _masks(width: int, radius: int) -> list[int]:
    """All values of ``width`` bits of which ``radius`` are set: 2 ** width over all radii."""
    return [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]


def _spread(asked: DataFrame, index: DataFrame, sizes: DataFrame, total: int) -> DataFrame:
    """Probes with the entries of their buckets, inner-joined.

    A bucket with more than 1/HOT_SHARE of all entries (there are at most HOT_SHARE) is
    cut into parts of about that size, and its probes go to every part.
    """
    part = max(1000, -(-total // HOT_SHARE))
    hot = F.broadcast(sizes.where(F.col("n") > part).select("bucket", F.ceil(F.col("n") / part).alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    left = asked.join(hot, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    right = index.join(hot, "bucket", "left").withColumn("part", F.pmod(F.xxhash64("code"), parts)).drop("parts")
    return left.join(right, ["bucket", "part"])


def segments_for(rows: int) -> int:
    """The number of segments whose width is nearest to log2 of the rows; of 16 bits at most, which have 12,870 values at one distance at most."""
    return 16 if rows < 1 << 6 else 8 if rows < 1 << 12 else 4


def search(codes: DataFrame, queries: DataFrame, k: int = K, segments: int | None = None) -> DataFrame:
    """query_id, rank (1 to k), id and distance of the k nearest codes of every query.

    ``codes`` and ``queries`` are (id, code). Distances are Hamming distances, ties go to
    the smaller id; a query isn't its own neighbour, a row that repeats its id and code
    counts once, one with a null id or code doesn't count. Fewer than k rows come back only
    where there are fewer other codes; empty tables give none. Other columns are ignored,
    whatever their names. ``segments`` must divide 64; by default it follows the number of
    different codes.

    Equal codes are one index entry with their k + 1 smallest ids, which are all that k
    neighbours can need, and equal queries are asked once: copies fill no bucket.
    """
    wanted = k + 1
    nth = F.row_number().over(W.partitionBy("code").orderBy("id"))
    codes, queries = (x.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code") for x in (codes, queries))
    few = codes.distinct().withColumn("nth", nth).where(F.col("nth") <= wanted)
    entries = cut(few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n_entries, n_ids = entries.agg(F.count(F.lit(1)), F.sum(F.size("ids"))).first()
    segments = segments or segments_for(n_entries)
    width = BITS // segments

    def buckets(code: str) -> Column:
        """The entries of a code in the index: segment and bucket (value and segment in one number)."""
        return F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col(code), s, width).alias("v")) for s in range(segments)])

    index = entries.select(F.explode(buckets("code")).alias("at"), "code", "ids")
    index = cut(index.select((F.col("at.v") * segments + F.col("at.s")).alias("bucket"), "code", "ids"))
    sizes = cut(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    enough = min(wanted, n_ids or 0)
    asking = queries.distinct()
    active = cut(asking.select(F.col("code").alias("query")).distinct())
    best, done = None, []
    for radius in range(width + 1):
        masks = F.array(*[F.lit(m).cast("long") for m in _masks(width, radius)])
        asked = active.select("query", F.explode(buckets("query")).alias("at"))
        asked = asked.select("query", "at.s", F.explode(F.transform(masks, lambda m: F.col("at.v").bitwiseXOR(m))).alias("v"))
        asked = asked.select("query", "s", (F.col("v") * segments + F.col("s")).alias("bucket"))
        met = _spread(asked, index, sizes, n_entries * segments)
        difference = F.col("query").bitwiseXOR(F.col("code"))
        near = [F.bit_count(_segment(difference, s, width)) for s in range(segments)]
        # taken where it is found first: in the first segment of those that differ least
        found_first = reduce(
            lambda a, b: a & b,
            [F.when(F.lit(s) < F.col("s"), near[s] > radius).otherwise(near[s] >= radius) for s in range(segments)],
        )
        candidates = met.where(found_first).select("query", F.bit_count(difference).cast("int").alias("distance"), F.explode("ids").alias("id"))
        if best is not None:
            candidates = candidates.unionByName(best.join(active, "query", "left_semi"))
        order = F.row_number().over(W.partitionBy("query").orderBy("distance", "id"))
        best = cut(candidates.withColumn("rank", order).where(F.col("rank") <= wanted).select("query", "distance", "id"))
        reach = best.groupBy("query").agg(F.max("distance").alias("worst"), F.count(F.lit(1)).alias("n"))
        covered = reach.where((F.col("n") >= enough) & (F.col("worst") < segments * (radius + 1)))
        covered = cut((covered if radius < width else reach).select("query"))
        done.append(best.join(covered, "query", "left_semi"))
        active = cut(active.join(covered, "query", "left_anti"))
        if active.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done)
    nearest = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("all"))
    askers = asking.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    counted = askers.groupBy("query").agg(F.count(F.lit(1)).alias("askers"))
    answers = join_groups(askers, nearest.join(counted, "query"), "query", "askers", F.col("query_id"))
    others = F.slice(F.filter("all", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = answers.select("query_id", F.posexplode(others).alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.id", "hit.distance")


ORACLE_SQL = """
WITH c AS (
  SELECT vec_id AS id, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), p AS (
  SELECT q.id AS query_id, c.id, list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: abs(z[1] - z[2])))::INTEGER AS distance
  FROM (SELECT DISTINCT * FROM c WHERE id % 100 = 0) q, (SELECT DISTINCT * FROM c) c WHERE q.id <> c.id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank, id, distance
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 10
"""
