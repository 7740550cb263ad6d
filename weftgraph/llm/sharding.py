"""Sharding by jump consistent hashing.

A stable key and the number of shards decide the shard; no ring table is kept,
and one more shard takes rows only into itself (about 1/n of them).  The
generator of the jumps is the 64-bit linear congruential one of the paper by
Lamping and Veach, carried as two 32-bit halves so that no product leaves the
range of a long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import numbered, utf8_bytes

#: Fixed value: multiplier of the generator.
MULTIPLIER = 2862933555777941757
#: Rows of a shard are numbered in so many runs, one task's work each.
RUNS = 4096

_M32 = 0xFFFFFFFF
_C1, _C01, _C00 = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The generator's next state, key * MULTIPLIER + 1 modulo 2**64."""
    u = lo * _long(_C00) + _long(1)
    v = lo * _long(_C01)
    low = u + F.shiftleft(v.bitwiseAND(_long(0xFFFF)), 16)
    carry = F.shiftright(low, 32) + F.shiftright(v, 16)
    w = hi * _long(_C00) + F.shiftleft((hi * _long(_C01)).bitwiseAND(_long(0xFFFF)), 16)
    top = carry + (lo * _long(_C1)).bitwiseAND(_long(_M32)) + w.bitwiseAND(_long(_M32))
    return top.bitwiseAND(_long(_M32)), low.bitwiseAND(_long(_M32))


def _halves(key: Column) -> tuple[Column, Column]:
    key = F.coalesce(key.cast("long"), _long(0))
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(_long(_M32))


def jump_hash(key: Column, n: int) -> Column:
    """Shard of an integer key, 0 to n - 1; a null key counts as 0."""
    if n < 1:
        raise ValueError("n must be at least 1")
    hi, lo = _halves(key)
    start = F.struct(_long(-1).alias("b"), _long(0).alias("j"), hi.alias("hi"), lo.alias("lo"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(2.0**31) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(s["j"].alias("b"), j.cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
        return F.when(s["j"] < n, moved).otherwise(s)

    # each round moves on by one shard at least
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda s: s["b"].cast("int"))


def shard(docs: DataFrame, n: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into one of ``n`` shards by its id.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32
    (unsigned), law (always ``key``), shard, slot (gapless from 0 within a
    shard) and grown_shard (the shard with n + 1).  Null texts count as empty,
    a null id as 0; equal rows get slots of their own.  Ids that are no whole
    numbers go by their 64-bit hash.  Slots follow ``run``, a mix of id and
    checksum, then id, checksum and size: rows are numbered within runs, and the
    runs' sizes, at most ``RUNS`` a shard, give where each begins.  Equal rows
    are counted before, so one that is often repeated is one row of its run.
    An empty table gives an empty result.
    """
    size = utf8_bytes(F.col(text)) + 1
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"))
    whole = dict(rows.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    key = F.col("doc_id") if whole else F.xxhash64("doc_id")
    hi, lo = _next(*_halves(key))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("times"))
    rows = rows.select("*", jump_hash(key, n).alias("shard"), jump_hash(key, n + 1).alias("grown_shard"), (hi + F.col("text_crc32")).bitwiseAND(_long(RUNS - 1)).cast("int").alias("run"))
    begins = (
        rows.groupBy("shard", "run").agg(F.sum("times").alias("c"))
        .withColumn("begin", F.sum("c").over(Window.partitionBy("shard").orderBy("run")) - F.col("c"))
        .select("shard", "run", "begin")
    )
    within = Window.partitionBy("shard", "run").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    before = rows.withColumn("before", F.sum("times").over(within) - F.col("times"))
    # n * RUNS rows of 20 bytes at most; beyond what is safe to send, Spark chooses
    begins = F.broadcast(begins) if n * RUNS <= 1 << 20 else begins
    return numbered(before.join(begins, ["shard", "run"]), "times", "again").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("begin") + F.col("before") + F.col("again")).cast("long").alias("slot"), "grown_shard"
    )


def oracle(n: int = 8) -> str:
    """DuckDB SQL for :func:`shard` over ``documents``."""

    def jump(buckets: int) -> str:
        return f"""(with recursive go(b, j, k) as (
            select -1::bigint, 0::bigint, (case when key < 0 then key::hugeint + 18446744073709551616 else key end)::hugeint
            union all
            select j, floor((j + 1)::double * (2147483648::double / (((k * {MULTIPLIER} + 1) % 18446744073709551616) // 8589934592 + 1)::double))::bigint,
                (k * {MULTIPLIER} + 1) % 18446744073709551616
            from go where j < {buckets})
            select max(b) from go)"""

    return f"""
    with bits as (select list(t order by i) as crc_table from (
        select i, list_reduce(list_prepend(i, range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as t
        from (select unnest(range(256)) as i))),
    base as (select doc_id, coalesce(doc_id, 0) as key, hex(encode(coalesce(text, ''))) as x from documents),
    sums as (select doc_id, key, length(x) // 2 + 1 as size,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
            lambda a, b: xor(a >> 8, crc_table[xor(a & 255, b) + 1])), 4294967295::bigint) as text_crc32
        from base, bits),
    placed as (select *, {jump(n)}::int as shard, {jump(n + 1)}::int as grown_shard,
        ((((case when key < 0 then key::hugeint + 18446744073709551616 else key::hugeint end) * {MULTIPLIER} + 1) % 18446744073709551616 // 4294967296 + text_crc32) % {RUNS})::int as run
        from sums)
    select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard,
        (row_number() over (partition by shard order by run, doc_id nulls first, text_crc32, size) - 1)::bigint as slot, grown_shard
    from placed"""
