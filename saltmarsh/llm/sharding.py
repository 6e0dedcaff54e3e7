"""Extendible hashing of documents into shards of a byte limit, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import free_name, shared_dir, written

#: Bits of the row hash: the first 15 hex digits of an MD5.
BITS = 60
#: Directory bits beyond those that shards of equal size would need; each further level adds as many.
SPARE = 6
#: Shards' worth of equal rows that are numbered together.
PAGES = 64
LIMIT = 2 << 20


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(h: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - bits).cast("int") if isinstance(bits, Column) else F.lit(BITS - bits))


def directory(sizes: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Levels of (bits, table): each table has an entry for every prefix of that many bits it covers, with its
    bucket's depth, bytes and rows. A prefix whose bucket is still oversized at its level's bits has a null
    depth and goes on to the next level; at all 60 bits it is a bucket of equal rows (depth 60).

    ``sizes`` is a written table (h, n_bytes). A bucket splits on one more bit only while it holds more than
    ``limit`` bytes and more than one row; all other buckets keep their depth.
    """
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    low, bits = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    left, levels = sizes, []
    while True:
        cells = left.groupBy(_prefix(F.col("h"), bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        depths = F.explode(F.sequence(F.lit(low), F.lit(bits)))
        sums = cells.select("cell", "b", "n", depths.alias("d")).groupBy("d", F.expr(f"shiftright(cell, {bits} - d)").alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        sums = written(sums.withColumn("fits", (F.col("b") <= limit) | (F.col("n") == 1)), "shard-sums")
        above = sums.where("not fits").selectExpr("d + 1 d", "p up")
        inner = sums.withColumn("up", F.expr("shiftright(p, 1)")).join(above, ["d", "up"], "left_semi").where("fits")
        leaves = (inner.drop("up") if levels else inner.drop("up").unionByName(sums.where("d = 0 and fits"))).select("d", "p", "b", "n")
        over = sums.where(f"d = {bits} and not fits")
        first = F.expr(f"shiftleft(p, {bits} - d)")
        entries = leaves.select(F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {bits} - d)") - 1)).alias("cell"), F.col("d").cast("int").alias("depth"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"))
        full = F.lit(BITS if bits == BITS else None).cast("int").alias("depth")
        level = written(entries.unionByName(over.select(F.col("p").alias("cell"), full, F.col("b").alias("shard_bytes"), F.col("n").alias("shard_rows"))), "shard-directory")
        levels.append((bits, level))
        if bits == BITS or not over.limit(1).count():
            return levels
        left = left.withColumn("p", _prefix(F.col("h"), bits)).join(over.select("p"), "p", "left_semi").select("h", "n_bytes")
        low, bits = bits + 1, min(BITS, bits + SPARE)


def sharded(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, depth, shard, shard_bytes and shard_rows; any columns of these names are replaced, and all
    others stay, whatever their names.

    n_bytes is the text's length in UTF-8 (null: 0). The hash is over id and text, so a hot id spreads.
    Equal rows that exceed the limit together can't be told apart by any bit: they fill numbered pages of
    their bucket (shard ``<60 bits>-<group>-<page>``) of at most the limit each. A single row larger
    than the limit is alone in its shard. Null ids count as empty strings; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    own = ["n_bytes", "depth", "shard", "shard_bytes", "shard_rows"]
    docs = docs.drop(*own)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    sizes = written(docs.select(row_hash(id_col, text_col).alias("h"), size.alias("n_bytes")), "shard-sizes")
    levels = directory(sizes, limit)
    free = lambda x: free_name(f"sharding_{x}", [*docs.columns, *own])
    hidden, group, place, total, page_no = (free(x) for x in ("hash", "group", "place", "total", "page"))
    cell, field = (lambda i: free(f"cell{i}")), (lambda n, i: free(f"{n}{i}"))
    now = docs.withColumn("n_bytes", size).withColumn(hidden, row_hash(id_col, text_col))
    names = ["depth", "shard_bytes", "shard_rows"]
    for i, (bits, table) in enumerate(levels):
        entry = table.select(F.col("cell").alias(cell(i)), *(F.col(n).alias(field(n, i)) for n in names))
        now = now.join(entry, _prefix(F.col(hidden), bits) == F.col(cell(i)), "left")
    pick = lambda n: F.coalesce(*(F.when(F.col(field("depth", i)).isNotNull(), F.col(field(n, i))) for i in range(len(levels))))
    kept = docs.columns
    now = now.select(*(F.col(f"`{c}`") for c in kept), "n_bytes", hidden, *(pick(n).alias(n) for n in names))
    shard = F.substring(F.lpad(F.bin(hidden), BITS, "0"), F.lit(1), F.col("depth"))
    plain = now.withColumn("shard", shard)
    if levels[-1][0] < BITS or not levels[-1][1].where((F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)).limit(1).count():
        return plain.select(*(F.col(f"`{c}`") for c in kept), *own)
    packed = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    groups = F.ceil(F.col("shard_bytes") / (limit * PAGES))
    page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("n_bytes"))))
    many = plain.where(packed).withColumn(group, F.pmod(F.xxhash64(F.monotonically_increasing_id()), groups))
    same = Window.partitionBy(hidden, group)
    many = many.withColumn(place, F.row_number().over(same.orderBy(F.lit(1))) - 1).withColumn(total, F.count("*").over(same))
    many = many.withColumn(page_no, F.floor(F.col(place) / page))
    rows = F.least(page, F.col(total) - F.col(page_no) * page)
    name = F.concat_ws("-", "shard", F.col(group).cast("string"), F.col(page_no).cast("string"))
    many = many.withColumn("shard", name).withColumn("shard_rows", rows.cast("bigint"))
    many = many.withColumn("shard_bytes", (rows * F.col("n_bytes")).cast("bigint"))
    columns = [*(F.col(f"`{c}`") for c in kept), *map(F.col, own)]
    return plain.where(~packed).select(*columns).union(many.select(*columns))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes the documents as Parquet, a folder for each shard."""
    sharded(docs, limit).repartition("shard").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharded(docs).select("doc_id", "n_bytes", "depth", "shard", "shard_bytes", "shard_rows")


OP2_SQL = f"""
WITH rows_ AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
levels AS (SELECT r.*, CAST(d.d AS INTEGER) AS d, h >> ({BITS} - d.d) AS p FROM rows_ r, (SELECT unnest(range(0, 41)) AS d) d),
sums AS (SELECT d, p, CAST(sum(n_bytes) AS BIGINT) AS b, count(*) AS n FROM levels GROUP BY d, p),
found AS (SELECT doc_id, n_bytes, h, min(l.d) AS depth FROM levels l JOIN sums s ON l.d = s.d AND l.p = s.p WHERE s.b <= {LIMIT} OR s.n = 1 GROUP BY doc_id, n_bytes, h)
SELECT f.doc_id, f.n_bytes, f.depth,
  substr(lpad(bin(f.h), {BITS}, '0'), 1, f.depth) AS shard, s.b AS shard_bytes, s.n AS shard_rows
FROM found f JOIN sums s ON s.d = f.depth AND s.p = f.h >> ({BITS} - f.depth)
"""
