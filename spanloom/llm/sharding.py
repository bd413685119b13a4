"""Sharding by balanced label propagation under row quotas.

Documents start in the shard of their id's hash. In each round, one aggregation counts every link group's documents per
shard, a join tells each linked document its group's majority shard (the largest few for a group that no single shard can
hold), and documents elsewhere ask to move there. The requests are summed into a matrix of shards (its size follows the shard
count only); a move is granted as far as opposite moves balance it or the target's quota has room, whole groups at a time, or
document by document where a group alone would fill a noticeable part of a shard. Quotas of the rounds count linked documents:
those without links never take part, they fill up what is left.

A last step makes the law exact: rows are range-sorted by shard, linked ones first, which numbers them without gathering a
shard in one task, and each shard passes what exceeds its exact quota (unlinked rows first) to the shards that lack rows.

The law is ``rows``: row counts of any two shards differ by at most one. Slots count each shard's rows from 0.

Defined cases: a null text has size 1 and the CRC of the empty text, and is not linked to the empty text; a null doc_id is
sharded like any other value; repeated rows each get their own slot; fewer rows than shards leave the last shards empty; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, numbered, table

SHARDS = 16
ROUNDS = 6
WHOLE_GROUP = 0.1
_SCALE = 1 << 20


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and grp (equal texts share one)."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(
        "doc_id", (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.sha2(raw, 256)).alias("grp"),
    )


def _entry(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def grants(requests: dict[tuple[int, int], int], sizes: list[int], capacity: float) -> dict[tuple[int, int], float]:
    """Share of the requests from each shard to each other that may be granted."""
    shards = range(len(sizes))
    moved = {(i, j): min(requests.get((i, j), 0), requests.get((j, i), 0)) for i in shards for j in shards if i != j}
    for j in shards:  # what is not balanced by opposite moves shares the room that is left
        more = {i: requests.get((i, j), 0) - moved[i, j] for i in shards if i != j}
        room = max(0.0, capacity - sizes[j])
        share = min(1.0, room / total) if (total := sum(more.values())) else 0
        for i, n in more.items():
            moved[i, j] += n * share
    return {k: v / requests[k] for k, v in moved.items() if requests.get(k)}


def propagate(rows: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (doc_id, grp, ...) with ``shard``, nearly even, links kept together as far as the quotas allow."""
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(shards)).cast("int")
    groups = materialize(rows.groupBy("grp").agg(F.count("*").alias("group_rows")).where("group_rows > 1"), "shard-groups")
    placed = materialize(rows.withColumn("shard", start).join(groups.hint("merge"), "grp", "left"), "shard-round")
    single = placed.where("group_rows IS NULL")
    linked = placed.where("group_rows IS NOT NULL")
    capacity = max(1, rows.count() // shards)
    for t in range(rounds):
        count = {r[0]: r[1] for r in linked.groupBy("shard").count().collect()}
        sizes = [count.get(s, 0) for s in range(shards)]
        homes = F.least(F.ceil(F.col("rows") / capacity), F.lit(shards)).cast("int")  # shards that the group needs
        votes = linked.groupBy("grp", "shard").agg(F.count("*").alias("n"), F.max("group_rows").alias("rows")).groupBy("grp").agg(
            F.reverse(F.array_sort(F.collect_list(F.struct("n", F.pmod(F.xxhash64("grp", "shard"), F.lit(1009)).alias("tie"), "shard")))).alias("votes"), F.max("rows").alias("rows")
        )
        votes = votes.select("grp", F.transform(F.slice("votes", F.lit(1), homes), lambda v: v["shard"]).alias("homes"))
        wish = linked.join(materialize(votes, "shard-votes").hint("merge"), "grp")
        pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(t + 100)), F.size("homes").cast("bigint")).cast("int") + 1
        wish = wish.withColumn("target", F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(F.element_at("homes", pick))).drop("homes")
        wish = materialize(wish, "shard-wishes")
        asked = {(r[0], r[1]): r[2] for r in wish.where("shard <> target").groupBy("shard", "target").count().collect()}
        if not asked:
            linked = wish.drop("target")
            break
        share = grants(asked, sizes, capacity)
        flat = [int(share.get((i, j), 0) * _SCALE) for i in range(shards) for j in range(shards)]
        whole = F.col("group_rows") <= WHOLE_GROUP * capacity
        die = F.pmod(F.when(whole, F.xxhash64(F.col("grp"), F.lit(t))).otherwise(F.xxhash64(F.col("doc_id"), F.lit(t))), F.lit(_SCALE))
        go = die < _entry(flat, F.col("shard") * shards + F.col("target"))
        linked = materialize(wish.withColumn("shard", F.when(go, F.col("target")).otherwise(F.col("shard"))).drop("target"), "shard-round")
    return single.unionByName(linked)


def settle(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with exact quotas (counts at most one apart) and gapless slots."""
    # short keys: the driver samples some of them for the range bounds
    keyed = rows.withColumns({"_single": F.col("group_rows").isNull().cast("int"), "_group": F.xxhash64("grp")})
    ranked = numbered(keyed, ["shard", "_single", "_group", "doc_id"], "rank")
    have = {r[0]: r[1] for r in ranked.groupBy("shard").count().collect()}
    have = [have.get(s, 0) for s in range(shards)]
    n = sum(have)
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    before = [sum(have[:s]) for s in range(shards)]
    surplus = [max(0, h - q) for h, q in zip(have, quota, strict=True)]
    given = [sum(surplus[:s]) for s in range(shards)]
    lack = [max(0, q - h) for h, q in zip(have, quota, strict=True)]
    ends = [sum(lack[: s + 1]) for s in range(shards)]
    place = F.col("rank") - _entry(before, F.col("shard"))
    stays = place < _entry(quota, F.col("shard"))
    spare = place - _entry(quota, F.col("shard")) + _entry(given, F.col("shard"))  # number among all surplus rows
    to = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("_spare")))
    first = [e - x for e, x in zip(ends, lack, strict=True)]
    out = ranked.withColumns({"_place": place, "_stays": stays, "_spare": spare}).withColumn("_to", F.least(to, F.lit(shards - 1)))
    return out.withColumns({
        "slot": F.when(F.col("_stays"), F.col("_place")).otherwise(_entry(have, F.col("_to")) + F.col("_spare") - _entry(first, F.col("_to"))).cast("long"),
        "shard": F.when(F.col("_stays"), F.col("shard")).otherwise(F.col("_to")).cast("int"),
    }).drop("_place", "_stays", "_spare", "_to", "_single", "_group", "rank", "group_rows")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, grp, shard and slot for every row of ``docs``."""
    rows = materialize(described(docs), "shard-rows")
    return settle(propagate(rows, shards, rounds), shards)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
