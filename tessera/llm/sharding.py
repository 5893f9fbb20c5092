"""Resharding by minimum-cost flow.

Rows lie in old shards of uneven size; new shards have capacities. The flow network has one node per old and per
new shard and one hub: a byte that stays in its shard costs nothing, a byte that moves goes through the hub and
costs one. The cheapest flow moves the fewest bytes that the capacities allow. It is solved on the driver over
shard totals only: O(old + new) edges, whatever the number of rows.

The flow is then realised in blocks. A block is the rows of one old shard whose key hashes to one bucket. Each old
shard's blocks are laid in a row, and its outgoing flows cut this row into intervals. Blocks inside an interval move
whole; the few blocks under a cut are divided row by row. Rows that lie across a cut (one for each cut at most) are
dealt last, largest first, each to the shard with the most room.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from heapq import heapify, heapreplace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import fresh_dir, stage, utf8_size

ROW_OVERHEAD = 16
FILE_BYTES = 64 << 20  # text bytes that are dealt to one file of a shard
MOVE_COST = 1


@dataclass
class FlowNetwork:
    """Successive shortest paths with residual edges; capacities and costs are integers."""

    heads: list[int] = field(default_factory=list)
    room: list[int] = field(default_factory=list)
    cost: list[int] = field(default_factory=list)
    out: dict[int, list[int]] = field(default_factory=dict)

    def edge(self, a: int, b: int, capacity: int, cost: int) -> int:
        at = len(self.heads)
        for tail, head, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(tail, []).append(len(self.heads))
            self.heads.append(head)
            self.room.append(room)
            self.cost.append(price)
        return at

    def flow_on(self, edge: int) -> int:
        return self.room[edge ^ 1]

    def run(self, source: int, sink: int) -> int:
        """Send all that fits, cheapest paths first; returns the total cost."""
        total = 0
        while True:
            best, via, queue = {source: 0}, {}, [source]
            waiting = {source}
            while queue:  # label correcting, since residual edges have negative costs
                node = queue.pop(0)
                waiting.discard(node)
                for e in self.out.get(node, ()):
                    if self.room[e] and best[node] + self.cost[e] < best.get(self.heads[e], 1 << 62):
                        best[self.heads[e]], via[self.heads[e]] = best[node] + self.cost[e], e
                        if self.heads[e] not in waiting:
                            waiting.add(self.heads[e])
                            queue.append(self.heads[e])
            if sink not in best:
                return total
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.heads[via[node] ^ 1]
            sent = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= sent
                self.room[e ^ 1] += sent
            total += sent * best[sink]


def cheapest_transfers(old: dict[int, int], capacity: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """old shard -> [(new shard, bytes)] that moves the fewest bytes. Capacities must hold all bytes."""
    if sum(old.values()) > sum(capacity.values()):
        raise ValueError("the new capacities are smaller than the old shards")
    net, source, sink, hub = FlowNetwork(), "source", "sink", "hub"
    stays, leaves, enters = {}, {}, {}
    for i, size in sorted(old.items()):
        net.edge(source, ("old", i), size, 0)
        if i in capacity:
            stays[i] = net.edge(("old", i), ("new", i), size, 0)
        leaves[i] = net.edge(("old", i), hub, size, MOVE_COST)
    for j, size in sorted(capacity.items()):
        enters[j] = net.edge(hub, ("new", j), size, 0)
        net.edge(("new", j), sink, size, 0)
    net.run(source, sink)
    room = [(j, net.flow_on(e)) for j, e in enters.items() if net.flow_on(e)]
    plan: dict[int, list[tuple[int, int]]] = {}
    for i in sorted(old):  # what passes the hub has one price, so it is paired in order
        plan[i] = [(i, net.flow_on(stays[i]))] if i in stays and net.flow_on(stays[i]) else []
        left = net.flow_on(leaves[i])
        while left:
            j, free = room[0]
            sent = min(left, free)
            plan[i].append((j, sent))
            left -= sent
            room[0] = (j, free - sent)
            if free == sent:
                room.pop(0)
    return plan


def even_capacities(total: int, shards: int) -> dict[int, int]:
    return {j: total // shards + (j < total % shards) for j in range(shards)}


def _checksum(text: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))


def _bytes(text: str) -> Column:
    return utf8_size(F.col(text)) + ROW_OVERHEAD


def _bucket(key: str, crc: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, crc), F.lit(buckets)).cast("int")


def _old(old_shard: Column) -> Column:
    return F.coalesce(old_shard, F.lit(0)).cast("int")


def reshard(
    docs: DataFrame,
    old_shard: Column,
    shards: int = 40,
    old_shards: int = 32,
    buckets: int = 512,
    key: str = "doc_id",
    text: str = "text",
    capacities: dict[int, int] | None = None,
) -> DataFrame:
    """(key, size, text_crc32, old_shard, shard, slot): one row for each row of docs.

    old_shard: an int from 0 to old_shards - 1; null goes to 0. The driver holds old_shards * buckets block totals
    at most, so what it gathers and broadcasts does not grow with the rows.
    Null texts count 16 bytes and have the checksum of the empty text; null keys are rows like others; repeated rows
    all stay, each with a slot of its own; an empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("k"),
        _bytes(text).alias("size"),
        _checksum(text).alias("crc"),
        _old(old_shard).alias("old"),
    ).withColumn("bucket", _bucket("k", "crc", buckets))
    in_block = Window.partitionBy("old", "bucket").orderBy("k", "crc", "size")
    placed = stage(
        rows.withColumn("rn", F.row_number().over(in_block).cast("long")).withColumn(
            "upto", F.sum("size").over(in_block.rowsBetween(Window.unboundedPreceding, 0))
        ),
        "reshard",
    )
    blocks = placed.groupBy("old", "bucket").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    blocks.sort()
    totals: dict[int, int] = {}
    for b in blocks:
        totals[b.old] = totals.get(b.old, 0) + b.size
    capacity = capacities or even_capacities(sum(totals.values()), shards)
    plan = cheapest_transfers(totals, capacity)

    # pieces: the part of a block [lo, hi) in bytes of its old shard that goes to one new shard
    pieces, cuts = [], []
    ahead: dict[int, int] = {}
    bounds = {}
    for i, moves in plan.items():
        at, bounds[i] = 0, []
        for j, size in moves:
            bounds[i].append((at, at + size, j))
            at += size
    for b in blocks:
        lo = ahead.get(b.old, 0)
        ahead[b.old] = hi = lo + b.size
        inside = [(max(lo, x) - lo, min(hi, y) - lo, j) for x, y, j in bounds[b.old] if x < hi and y > lo]
        pieces += [(b.old, b.bucket, x, y, j) for x, y, j in inside]
        if len(inside) > 1:
            cuts += [(b.old, b.bucket, y) for _, y, _ in inside[:-1]]
    piece_schema = "old int, bucket int, lo long, hi long, shard int"
    pieces_df = spark.createDataFrame(pieces, piece_schema)
    start = F.col("upto") - F.col("size")
    whole = placed.join(F.broadcast(pieces_df), ["old", "bucket"]).where((start >= F.col("lo")) & (F.col("upto") <= F.col("hi")))

    # rows across a cut: as many as there are cuts at most
    cut_df = spark.createDataFrame(cuts, "old int, bucket int, cut long")
    across = (
        placed.join(F.broadcast(cut_df), ["old", "bucket"])
        .where((start < F.col("cut")) & (F.col("upto") > F.col("cut")))
        .select("old", "bucket", "rn", "size")
        .distinct()
        .collect()
    )
    split = spark.createDataFrame(sorted({(o, b) for o, b, _ in cuts}), "old int, bucket int")
    parts = (
        whole.join(F.broadcast(split), ["old", "bucket"], "left_semi")
        .groupBy("old", "bucket", "shard")
        .agg(F.min("rn").alias("first"), F.count("*").alias("n"), F.sum("size").alias("size"))
        .collect()
    )
    divided = {(p.old, p.bucket, p.shard): (p["first"], p.n, p.size) for p in parts}
    was_cut = {(o, b) for o, b, _ in cuts}
    sums = {(b.old, b.bucket): (1, b.n, b.size) for b in blocks}
    filled, taken, bases = dict.fromkeys(capacity, 0), dict.fromkeys(capacity, 0), []
    for o, b, _, _, j in pieces:
        first, n, size = divided.get((o, b, j), (1, 0, 0)) if (o, b) in was_cut else sums[(o, b)]
        if n:
            bases.append((o, b, j, taken[j] - first))
            taken[j] += n
            filled[j] += size
    heap = [(filled[j] - capacity[j], j) for j in sorted(capacity)]
    heapify(heap)
    late = []
    for r in sorted(across, key=lambda r: (-r.size, r.old, r.bucket, r.rn)):
        over, j = heap[0]
        late.append((r.old, r.bucket, r.rn, j, taken[j]))
        taken[j] += 1
        heapreplace(heap, (over + r.size, j))
    base_df = spark.createDataFrame(bases, "old int, bucket int, shard int, base long")
    late_df = spark.createDataFrame(late, "old int, bucket int, rn long, shard int, slot long")
    settled = whole.join(F.broadcast(base_df), ["old", "bucket", "shard"]).withColumn("slot", F.col("base") + F.col("rn"))
    dealt = placed.join(F.broadcast(late_df), ["old", "bucket", "rn"])
    columns = [F.col("k").alias(key), F.col("size"), F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), F.col("shard"), F.col("slot")]
    return settled.select(*columns).unionByName(dealt.select(*columns))


def affected_shards(assigned: DataFrame) -> DataFrame:
    """(shard): those whose rows change, because a row enters or leaves."""
    moved = assigned.where("old_shard <> shard")
    return moved.select("shard").union(moved.select(F.col("old_shard").alias("shard"))).distinct()


def rewrite_affected(
    docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id", text: str = "text", old_shard: Column | None = None, buckets: int = 512
) -> DataFrame:
    """Write the rows of affected shards anew, one folder for each shard, and return (shard).

    Shards that keep all their rows and get no others are not read for writing and stay as they are; folders of shards
    that lose all their rows are removed once the others are written. Rows are matched by key, text checksum and, where
    old_shard is given (as to reshard), old shard; equal rows are interchangeable. A block that goes to one shard whole
    takes its shard and first slot from a table of blocks, so texts are shuffled once; only rows of divided blocks are
    matched with assigned one by one. A shard's rows are dealt to several tasks and files by bytes, so that one large
    shard is not one task.
    """
    spark = docs.sparkSession
    shards = affected_shards(assigned)
    affected = {r.shard for r in shards.collect()}
    filled = {r.shard for r in assigned.select("shard").distinct().collect()}
    block, order = ["_old", "_bucket"], ["_k", "_crc", "_size"]
    goal = assigned.select(
        F.col(key).alias("_k"),
        F.col("text_crc32").alias("_crc"),
        F.col("size").alias("_size"),
        (F.lit(0) if old_shard is None else F.col("old_shard")).alias("_old"),
        F.col("shard").alias("_shard"),
        F.col("slot").cast("long").alias("_slot"),
    ).withColumn("_bucket", _bucket("_k", "_crc", buckets))
    have = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(key).alias("_k"),
        _checksum(text).alias("_crc"),
        _bytes(text).alias("_size"),
        (F.lit(0) if old_shard is None else _old(old_shard)).alias("_old"),
    ).withColumn("_bucket", _bucket("_k", "_crc", buckets))

    totals = goal.groupBy(*block).agg(
        F.min("_shard").alias("shard"), F.max("_shard").alias("last"), F.min("_slot").alias("first"), F.max("_slot").alias("end"), F.count("*").alias("n"), F.sum("_size").alias("size")
    )
    whole, divided, laid = [], [], {}
    for b in sorted(totals.collect(), key=lambda b: (b.shard, b.first)):
        if b.shard != b.last or b.end - b.first + 1 != b.n:
            divided.append((b._old, b._bucket))
        elif b.shard in affected:
            whole.append((b._old, b._bucket, b.shard, b.first, laid.get(b.shard, 0) // FILE_BYTES))
            laid[b.shard] = laid.get(b.shard, 0) + b.size
    whole_df = spark.createDataFrame(whole, "_old int, _bucket int, _shard int, _first long, _file long")
    divided_df = F.broadcast(spark.createDataFrame(divided, "_old int, _bucket int"))

    def numbered(rows: DataFrame, *more: str) -> DataFrame:
        return rows.join(divided_df, block, "left_semi").withColumn("_rn", F.row_number().over(Window.partitionBy(*block).orderBy(*order, *more)))

    one_by_one = numbered(goal, "_shard", "_slot").join(F.broadcast(shards.withColumnRenamed("shard", "_shard")), "_shard", "left_semi")
    parted = numbered(have).join(one_by_one.select(*block, "_rn", "_shard", "_slot"), [*block, "_rn"]).withColumn("_file", F.floor(F.col("_slot") / 100_000))
    full = have.join(F.broadcast(whole_df), block)
    kept = ["_row", *order, *block, "_shard", "_file"]
    rows = full.select(*kept, "_first", F.lit(None).cast("long").alias("_slot")).unionByName(parted.select(*kept, F.lit(None).cast("long").alias("_first"), "_slot"))
    nth = F.row_number().over(Window.partitionBy("_shard", "_file", *block).orderBy(*order))
    (
        rows.repartition("_shard", "_file")
        .withColumn("_slot", F.coalesce("_slot", F.col("_first") + nth - 1))
        .select("_row.*", "_shard", "_slot")
        .sortWithinPartitions("_shard", "_slot")
        .write.partitionBy("_shard")
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )
    folders = spark._jvm.org.apache.hadoop.fs.Path
    for j in sorted(affected - filled):
        gone = folders(f"{path.rstrip('/')}/_shard={j}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return shards


def resharded(docs: DataFrame, old_shard: Column, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, size, text_crc32, old_shard, shard, slot) as reshard gives, of the files that are written for it.

    The affected shards go to a fresh folder in the shared one, and what is returned of them is read from these files.
    Shards that stay as they are have no new files; their rows are those of the assignment.
    """
    spark = docs.sparkSession
    placed = stage(reshard(docs, old_shard, key=key, text=text, **options), "placed")
    path = fresh_dir(spark, "shards")
    shards = rewrite_affected(docs, placed, path, key, text, old_shard, options.get("buckets", 512))
    stored = StructType([*docs.schema.fields, StructField("_slot", LongType()), StructField("_shard", IntegerType())])
    files = spark.read.schema(stored).parquet(path)
    columns = [F.col(key), _bytes(text).alias("size"), _checksum(text).alias("text_crc32"), _old(old_shard).alias("old_shard"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot")]
    return files.select(*columns).unionByName(placed.join(F.broadcast(shards), "shard", "left_anti"))
