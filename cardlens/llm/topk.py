"""Exact top-k search by inner product with vector-approximation files.

* Vectors become integers ``floor(scale * x)``.  Equal vectors are one entry
  that carries its k + 1 smallest ids (a query may be one of them).
* The approximation file holds one byte per component: the cell of an
  equi-width grid per dimension.  The cell's edges bound the component, so they
  bound the inner product with a query from both sides.
* Scan.  Blocks of queries meet blocks of the approximation file.  Each block
  keeps the entries whose upper bound reaches the kth largest lower bound seen
  there, and a query's kth lower bound over all blocks prunes once more.
* Read.  Exact vectors are read in the order of their bound, best first, 2k a
  query; then all whose bound still reaches the kth exact score.  After that
  the result is certain.

Defined cases: vectors null or holding null or non-finite components take no
part; vectors are compared with queries of the same number of components; a
null id takes no part; rows with equal ids are separate candidates, none of
which is returned to a query of that id; ties go to the smaller id; with fewer
than k candidates all are returned; an empty table gives no rows; other
columns of the input are not read.  Products are exact: where they could leave
the range of a long they are summed as decimals, ranked as such, and reported as
the largest or smallest long.  Components whose integer is beyond 2^53 in size
count as 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.llm.common import read, stored

SCALE = 1024
#: Largest size of an integer component: all up to it are exact as a double.
MOST = 1 << 53
LONG = (1 << 63) - 1
CELLS = 256
#: Entries and queries of one block.
ENTRY_BLOCK, QUERY_BLOCK = 8192, 512


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def vectors(df: DataFrame, key: str, vec: str, scale: int = SCALE) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    number = F.transform(vec, lambda x: x.cast("double"))
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)
                     & (F.abs(x.cast("double")) < float("inf")))
    return (df.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).where(sound)
            .select(F.col(key).cast("long").alias("id"),
                    F.transform(number, lambda x: F.floor(F.least(F.greatest(
                        x * scale, F.lit(-float(MOST))), F.lit(float(MOST))))).alias("v"),
                    F.size(vec).alias("dim")))


def entries(points: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: (entry, dim, v, ids)."""
    smallest = W.partitionBy("v").orderBy("id")
    few = points.withColumn("_r", F.row_number().over(smallest)).where(F.col("_r") <= k + 1)
    return few.groupBy("v").agg(F.min("dim").alias("dim"),
                                F.sort_array(F.collect_list("id")).alias("ids")) \
        .withColumn("entry", F.monotonically_increasing_id())


def _grid(table: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per number of components: the least value and the cell width of each."""
    edges = (table.select("dim", F.posexplode("v").alias("j", "x")).groupBy("dim", "j")
             .agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
    out = {}
    for dim in {r["dim"] for r in edges}:
        own = sorted((r["j"], r["lo"], r["hi"]) for r in edges if r["dim"] == dim)
        lo = np.array([r[1] for r in own], np.float64)
        width = np.maximum(1, np.ceil((np.array([r[2] for r in own]) - lo + 1) / CELLS))
        out[dim] = (lo, width)
    return out


def search(df: DataFrame, key: str, vec: str, is_query, k: int = 10,
           scale: int = SCALE) -> DataFrame:
    """(query_id, rank, <key>, score) of the ``k`` largest inner products of
    every row that satisfies ``is_query`` with all rows of other ids."""
    spark = df.sparkSession
    points = vectors(df, key, vec, scale)
    table = stored(entries(points, k))
    queries = stored(vectors(df.where(is_query), key, vec, scale)
                     .dropDuplicates(["id", "v"])
                     .withColumn("q", F.monotonically_increasing_id()))
    grid = _grid(table)
    # the largest sum of products that bounds may form
    reach = max((float((np.maximum(np.abs(lo), np.abs(lo + width * CELLS)) ** 2).sum())
                 for lo, width in grid.values()), default=0.0)
    held = spark.sparkContext.broadcast(grid)

    def cells(batches):
        for b in batches:
            for dim in set(b.column("dim").to_pylist()):
                own = b.filter(pa.array([d == dim for d in b.column("dim").to_pylist()]))
                if dim:
                    lo, width = held.value[dim]
                    c = np.minimum((_matrix(own.column("v")) - lo) // width, CELLS - 1).astype(np.uint8)
                    raw = [x.tobytes() for x in c]
                else:
                    raw = [b""] * own.num_rows
                yield pa.RecordBatch.from_arrays(
                    [own.column("entry"), own.column("dim"), pa.array(raw, pa.binary()),
                     pa.array([len(x) for x in own.column("ids").to_pylist()], pa.int32())],
                    names=["entry", "dim", "cells", "copies"])
    file = stored(table.mapInArrow(cells, "entry long, dim int, cells binary, copies int"))
    n_entries, n_queries = file.count(), queries.count()
    entry_blocks, query_blocks = 1 + n_entries // ENTRY_BLOCK, 1 + n_queries // QUERY_BLOCK
    # every entry block meets every query block: the stated queries against all rows
    a = (file.withColumn("eb", F.pmod(F.xxhash64("entry", "cells"), F.lit(entry_blocks)))
         .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    b = (queries.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(query_blocks)).cast("int"))
         .withColumn("eb", F.explode(F.sequence(F.lit(0).cast("long"),
                                                F.lit(entry_blocks - 1).cast("long")))))

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        q_out, e_out, up_out, low_out = [], [], [], []
        for dim in set(right.column("dim").to_pylist()) if left.num_rows else ():
            own = left.filter(pa.array([d == dim for d in left.column("dim").to_pylist()]))
            ask = right.filter(pa.array([d == dim for d in right.column("dim").to_pylist()]))
            if not own.num_rows:
                continue
            e, q = own.column("entry").to_numpy(), ask.column("q").to_numpy()
            if dim:
                lo, width = held.value[dim]
                raw = b"".join(own.column("cells").to_pylist())
                c = np.frombuffer(raw, np.uint8).reshape(-1, dim)
                bottom = lo + c * width
                top = bottom + (width - 1)
                x = _matrix(ask.column("v"))
                plus, minus = np.maximum(x, 0), np.minimum(x, 0)
                upper = plus @ top.T + minus @ bottom.T
                lower = plus @ bottom.T + minus @ top.T
                if reach >= MOST:   # sums are rounded: widen by what rounding may take
                    slack = (np.abs(x) @ np.maximum(np.abs(top), np.abs(bottom)).T) * (
                        (dim + 4) * 2.0 ** -52)
                    upper, lower = upper + slack, lower - slack
            else:
                upper = lower = np.zeros((len(q), len(e)))
            copies = own.column("copies").to_numpy()
            for i in range(len(q)):
                # the query's own entry may fall away with one id: k + 1 entries are certain
                at = np.argsort(-lower[i], kind="stable")[:k + 1]
                floor = lower[i][at[-1]] if len(e) > k else -np.inf
                enough = np.cumsum(copies[at]) > k
                if enough.any():
                    floor = max(floor, lower[i][at[np.argmax(enough)]])
                keep = np.flatnonzero(upper[i] >= floor)
                q_out.append(np.full(len(keep), q[i]))
                e_out.append(e[keep])
                up_out.append(upper[i][keep])
                low_out.append(lower[i][keep])
        none = np.empty(0)
        return pa.table({
            "q": pa.array(np.concatenate([none, *q_out]).astype(np.int64)
                          if not q_out else np.concatenate(q_out)),
            "entry": pa.array(np.concatenate(e_out) if e_out else none.astype(np.int64)),
            "dim": pa.array(np.zeros(sum(map(len, q_out)), np.int32)),
            "upper": pa.array(np.concatenate([none, *up_out])),
            "lower": pa.array(np.concatenate([none, *low_out]))})
    bounds = stored(a.groupBy("eb", "qb").cogroup(b.groupBy("eb", "qb")).applyInArrow(
        scan, "q long, entry long, dim int, upper double, lower double"))
    by_low = W.partitionBy("q").orderBy(F.desc("lower"))
    floors = (bounds.withColumn("_r", F.row_number().over(by_low)).where(F.col("_r") <= k + 1)
              .groupBy("q").agg(F.min("lower").alias("floor"), F.count("*").alias("_n"))
              .select(F.col("q").alias("_q"),
                      F.when(F.col("_n") > k, F.col("floor")).otherwise(float("-inf"))
                      .alias("floor")))
    left = bounds.join(floors.hint("shuffle_merge"), F.col("q") == F.col("_q")) \
        .where("upper >= floor").select("q", "entry", "upper")
    by_bound = W.partitionBy("q").orderBy(F.desc("upper"), "entry")
    first = left.withColumn("_r", F.row_number().over(by_bound))
    todo = stored(first)

    def exact(pairs: DataFrame) -> DataFrame:
        got = (pairs.join(table.select(F.col("entry").alias("_e"), "v", "ids")
                          .hint("shuffle_merge"), F.col("entry") == F.col("_e"))
               .join(queries.select(F.col("q").alias("_q"), F.col("id").alias("query_id"),
                                    F.col("v").alias("x")).hint("shuffle_merge"),
                     F.col("q") == F.col("_q")))
        if reach < 2.0 ** 62:
            dot = F.aggregate(F.zip_with("v", "x", lambda s, t: s * t), F.lit(0).cast("long"),
                              lambda s, t: s + t)
        else:
            exact_sum, factor = "decimal(38,0)", "decimal(17,0)"
            dot = F.aggregate(F.zip_with("v", "x", lambda s, t: s.cast(factor) * t.cast(factor)),
                              F.lit(0).cast(exact_sum), lambda s, t: (s + t).cast(exact_sum))
        return got.where(F.size("v") == F.size("x")).select(
            "q", "query_id", "upper", dot.alias("score"),
            F.explode("ids").alias("id")).where("id <> query_id")

    def best(df: DataFrame) -> DataFrame:
        order = W.partitionBy("q").orderBy(F.desc("score"), "id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    one = stored(exact(todo.where(F.col("_r") <= 2 * k)))
    certain = (best(one).groupBy("q").agg(F.min("score").alias("kth"), F.count("*").alias("_n"))
               .select(F.col("q").alias("_q"), F.when(F.col("_n") == k, F.col("kth"))
                       .alias("kth")))
    rest = (todo.where(F.col("_r") > 2 * k).join(certain.hint("shuffle_merge"),
                                                 F.col("q") == F.col("_q"), "left")
            .where(F.col("kth").isNull()
                   | (F.col("upper") >= F.col("kth").cast("double") - F.abs(F.col("kth").cast("double"))
                      * F.lit(2.0 ** -52)))
            .select("q", "entry", "upper"))
    two = exact(rest)
    cols = ["q", "query_id", "score", "id"]
    score = F.least(F.greatest("score", F.lit(-LONG - 1)), F.lit(LONG)).cast("long")
    return best(one.select(*cols).unionByName(two.select(*cols))).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key),
        score.alias("score"))


def op6_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), "vec_id", "embedding",
                  F.col("vec_id") % 100 == 0)
