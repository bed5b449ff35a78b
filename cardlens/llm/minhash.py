"""Near duplicates by b-bit MinHash.

1. Each text's set of distinct 5-word shingles (hashes) gives 96 minima.  A few
   minima together are a band key, as many as the threshold allows (``bands``:
   19 bands of five at 0.85, 24 of four at 0.8); of every minimum the low 4
   bits are kept, packed into six longs.
2. Texts with equal sets form one class; classes, not copies, are compared.
3. In each band bucket every member is paired with the bucket's smallest
   member.  The similarity of a pair is estimated by counting equal 4-bit
   fields (xor and ``bit_count``), corrected for chance agreement, and pairs
   far below the threshold are dropped; the rest is confirmed on the full sets.
4. Confirmed links give components.  Buckets that still hold several
   components are compared once more across components, in blocks of bounded
   size: members of the largest component against the others, and the others
   among themselves, so a bucket full of copies of one text stays linear.
   These groups carry the full sets and return links that connect components
   only, fewer than they have members.

A pair at the threshold shares no band with probability (1 - 0.85^5)^19 =
1.5e-5 at 0.85 and (1 - 0.8^4)^24 = 3.2e-6 at 0.8; the estimate of a linked pair
falls below the cut with a probability under 2e-6.

Defined cases: null and empty texts have an empty set and link with nothing;
rows with a null doc_id take no part in links (component_id null, kept true);
rows with equal doc_id are separate texts under one id; an empty table gives no
rows; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardlens.llm.common import (U64, Words, arrow_map, fresh, mix, read, release, signed,
                                 small_batches, stored, text_bytes)
from cardlens.llm.common import own as own_columns
from cardlens.llm.components import components

SHINGLE = 5
HASHES, FIELD_BITS = 96, 4
LONGS = HASHES * FIELD_BITS // 64
#: The threshold of the corpus rule, and the one of op7's contract, in per cent.
RULE, CONTRACT = 80, 85
#: The share of pairs at the threshold that may have no band in common.
MISSED = 2e-5
#: How far below the threshold an estimate may lie before the pair is dropped,
#: in standard deviations of an estimate from ``HASHES`` fields.
DEVIATIONS = 5.3
#: Members of a bucket that are compared in one group.
BLOCK = 1024

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_NIBBLES = 0x1111111111111111


def bands(per_cent: int) -> tuple[int, int]:
    """(bands, minima of a band): the longest bands that miss at most ``MISSED``
    of the pairs at the threshold."""
    for size in range(HASHES, 1, -1):
        if (1 - (per_cent / 100) ** size) ** (HASHES // size) <= MISSED:
            return HASHES // size, size
    return HASHES, 1


def slack(threshold: float) -> float:
    """How far below the threshold the estimate of a linked pair may lie."""
    chance = 1 / (1 << FIELD_BITS)
    equal = threshold + (1 - threshold) * chance
    return DEVIATIONS * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def shingle_sets(words: Words, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text under ``n`` words
    has its whole sequence as one shingle."""
    g, at = words.grams(n)
    cut = np.searchsorted(words.row[at], np.arange(len(words.first)))
    out = []
    for i, count in enumerate(words.counts().tolist()):
        if count >= n:
            out.append(np.unique(g[cut[i]:cut[i + 1]]))
        elif count:
            h = U64(count)
            with np.errstate(over="ignore"):
                for x in words.hash[words.first[i]:words.first[i + 1]]:
                    h = mix(np.array([x ^ (h * U64(0x9E3779B97F4A7C15))], U64), 11)[0]
            out.append(np.array([h], U64))
        else:
            out.append(np.empty(0, U64))
    return out


def signatures(docs: DataFrame, per_cent: int, n: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set1, set2, bands, s0..s5) of every text."""
    count, band = bands(per_cent)
    sig = [f"s{i}" for i in range(LONGS)]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(Words(batch.column(1), lower=True), n)
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        minima = np.zeros((len(sets), HASHES), U64)
        marks = np.zeros((2, len(sets)), U64)
        if len(full):
            flat = np.concatenate([sets[i] for i in full])
            begin = np.r_[0, np.cumsum(sizes[full])[:-1]]
            with np.errstate(over="ignore"):
                for j in range(HASHES):
                    minima[full, j] = np.minimum.reduceat(flat * _A[j] + _B[j], begin)
                for k in range(2):
                    marks[k, full] = mix(np.add.reduceat(mix(flat, 21 + k), begin)
                                         + sizes[full].astype(U64), 31 + k)
        keys = np.zeros((len(sets), count), U64)
        with np.errstate(over="ignore"):
            for j in range(band):
                keys = mix(keys * U64(31) + minima[:, j:count * band:band], 41 + j)
            keys = mix(keys + np.arange(count, dtype=U64), 51)
        low = minima & U64((1 << FIELD_BITS) - 1)
        shift = (np.arange(64 // FIELD_BITS) * FIELD_BITS).astype(U64)
        packed = np.bitwise_or.reduce(low.reshape(len(sets), LONGS, -1) << shift, axis=2)
        buckets = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(np.where(sizes > 0, count, 0))].astype(np.int32)),
            pa.array(signed(np.ascontiguousarray(keys[full]).ravel())))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes), pa.array(signed(marks[0])),
             pa.array(signed(marks[1])), buckets,
             *(pa.array(signed(np.ascontiguousarray(packed[:, i]))) for i in range(LONGS))],
            names=["doc_id", "text_hash", "n_shingles", "set1", "set2", "bands", *sig])
    return arrow_map(docs.select(F.col("doc_id").cast("long"), text_bytes().alias("_t"),
                                 F.xxhash64("text").alias("_h")), rows,
                     "doc_id long, text_hash long, n_shingles long, set1 long, set2 long, "
                     "bands array<long>, " + ", ".join(f"{s} long" for s in sig))


def estimate():
    """Similarity from the packed fields ``x0..`` and ``y0..``: the share of
    equal fields, corrected for fields that agree by chance."""
    equal = F.lit(0)
    for i in range(LONGS):
        x = F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))
        some = x
        for k in range(1, FIELD_BITS):
            some = some.bitwiseOR(F.shiftrightunsigned(x, k))
        equal = equal + F.lit(64 // FIELD_BITS) - F.bit_count(some.bitwiseAND(F.lit(_NIBBLES)))
    chance = 1 / (1 << FIELD_BITS)
    return (equal / F.lit(float(HASHES)) - chance) / (1 - chance)


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes and estimate allow a link."""
    def side(name: str, letter: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{letter}"),
                            *(F.col(f"s{i}").alias(f"{letter}{i}") for i in range(LONGS)))
    return (pairs.join(side("a", "x").hint("shuffle_merge"), "a")
            .join(side("b", "y").hint("shuffle_merge"), "b")
            .where((F.least("nx", "ny") >= F.greatest("nx", "ny") * threshold)
                   & (estimate() >= threshold - slack(threshold)))
            .select("a", "b"))


def _confirm(pairs: DataFrame, texts: DataFrame, per_cent: int) -> DataFrame:
    """The pairs whose full sets are linked."""
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (shingle_sets(Words(batch.column(k), lower=True)) for k in (2, 3))
        keep = []
        for p, q in zip(x, y):
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= per_cent * (len(p) + len(q) - both))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    one = texts.select(F.col("node").alias("a"), F.col("_t").alias("_ta"))
    two = texts.select(F.col("node").alias("b"), F.col("_t").alias("_tb"))
    return arrow_map(pairs.join(one.hint("shuffle_merge"), "a")
                     .join(two.hint("shuffle_merge"), "b").select("a", "b", "_ta", "_tb"),
                     rows, "a long, b long")


def _texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, _t) of the classes ``wanted(node)``: the text of the class's
    smallest document."""
    wanted = stored(nodes.select("node", "doc_id").join(wanted.distinct(), "node"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("_t"))
    found = plain.join(wanted.hint("shuffle_merge"), "doc_id")
    if not wanted.groupBy("doc_id").count().where("count > 1").isEmpty() or not (
            plain.groupBy("doc_id").count().where("count > 1").isEmpty()):
        # ids that several rows share: take the row that has the class's set
        def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(Words(batch.column(1), lower=True))
            first = [mix(np.add.reduce(mix(s, 21), keepdims=True) + U64(len(s)), 31)[0]
                     if len(s) else U64(0) for s in sets]
            same = signed(np.array(first, U64)) == batch.column(0).to_numpy()
            return batch.filter(pa.array(same))
        found = arrow_map(found.select("node", "_t"), rows, "node long, _t binary")
        return found.groupBy("node").agg(F.min("_t").alias("_t"))
    return found.select("node", "_t")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum())


def _across(members: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame,
            per_cent: int) -> DataFrame | None:
    """Links (a, b) that join different components within one bucket, enough of
    them to connect what is connected; None if no bucket is mixed.

    ``members(bucket, node)``; nodes without a label are their own component.
    Groups carry the full sets, so links are confirmed in place: a group
    returns fewer links than it has members, and a pair that others of the
    group have connected meanwhile is not looked at.
    """
    sig, threshold = [f"s{i}" for i in range(LONGS)], per_cent / 100
    least = threshold - slack(threshold)
    lab = labels.select(F.col("node").alias("_n"), "label")
    named = (members.join(lab.hint("shuffle_merge"), members["node"] == lab["_n"], "left")
             .select("bucket", "node", F.coalesce("label", "node").alias("label")))
    parts = named.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    mixed = stored(parts.groupBy("bucket")
                   .agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("top"),
                        F.count("*").alias("parts"))
                   .where("parts > 1")
                   .select(F.col("bucket").alias("_b"), F.col("top.label").alias("main"),
                           F.ceil(F.col("top.c") / BLOCK).cast("int").alias("mains"),
                           F.ceil((F.col("m") - F.col("top.c")) / BLOCK).cast("int")
                           .alias("others")))
    if mixed.isEmpty():
        return None
    rows = stored(named.join(mixed.hint("shuffle_merge"), named["bucket"] == mixed["_b"])
                  .withColumn("is_main", F.col("label") == F.col("main"))
                  .withColumn("own", F.pmod(F.xxhash64("node"),
                                            F.when(F.col("is_main"), F.col("mains"))
                                            .otherwise(F.col("others"))).cast("int")))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(Words(batch.column(1), lower=True))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())],
            names=["node", "members"])
    sets = arrow_map(_texts_of(rows.select("node"), nodes, docs), pack,
                     "node long, members binary")
    held = stored(sets.join(nodes.select("node", *sig).hint("shuffle_merge"), "node"))

    def dealt(df: DataFrame, kind: int, i, j) -> DataFrame:
        return df.select("bucket", F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"),
                         F.col("node").alias("_n"), "label")
    zero = F.lit(0)
    own = F.col("own")
    main, other = rows.where("is_main"), rows.where("not is_main")
    turn = other.withColumn("t", F.explode(F.sequence(zero, F.col("others") - 1)))
    places = (dealt(main.withColumn("t", F.explode(F.sequence(zero, F.col("others") - 1))),
                    0, own, F.col("t"))
              .unionByName(dealt(other.withColumn("t", F.explode(
                  F.sequence(zero, F.col("mains") - 1))), 0, F.col("t"), own))
              .unionByName(dealt(turn, 1, F.least("own", "t"), F.greatest("own", "t"))))
    groups = held.join(places.hint("shuffle_merge"), held["node"] == F.col("_n")).drop("_n")

    def compare(table: pa.Table) -> pa.Table:
        node, label = (table.column(c).to_numpy() for c in ("node", "label"))
        left, right = [], []
        if (label != label[0]).any():
            s = np.stack([table.column(c).to_numpy() for c in sig], 1).view(U64)
            full = [np.frombuffer(x, "<u8") for x in table.column("members").to_pylist()]
            n = np.array([len(x) for x in full])
            place, part = np.unique(label, return_inverse=True)
            root = np.arange(len(place))  # of each component, kept flat
            for k in range(len(node) - 1):
                x = s[k] ^ s[k + 1:]
                some = (x | x >> U64(1) | x >> U64(2) | x >> U64(3)) & U64(_NIBBLES)
                same = (HASHES - np.bitwise_count(some).sum(1, dtype=np.int64)) / HASHES
                near = (same - 1 / 16) / (15 / 16) >= least
                near &= root[part[k + 1:]] != root[part[k]]
                near &= np.minimum(n[k + 1:], n[k]) >= threshold * np.maximum(n[k + 1:], n[k])
                for j in (np.flatnonzero(near) + k + 1).tolist():
                    a, b = root[part[j]], root[part[k]]
                    if a != b:
                        both = common(full[k], full[j])
                        if 100 * both >= per_cent * (n[k] + n[j] - both):
                            root[root == a] = b
                            left.append(node[k])
                            right.append(node[j])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})
    # dealt out by hand, since a group's work is far more than its bytes tell
    tasks = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (groups.repartition(tasks, "bucket", "kind", "i", "j")
            .groupBy("bucket", "kind", "i", "j").applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, per_cent: int = CONTRACT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept) for every row;
    component_id is the smallest doc_id linked, directly or over others."""
    spark, threshold = docs.sparkSession, per_cent / 100
    small_batches(spark)
    sig = [f"s{i}" for i in range(LONGS)]
    rows = stored(signatures(docs, per_cent))
    linked = rows.where("doc_id is not null and n_shingles > 0")

    # equal sets have equal signatures: any row of the class will do
    nodes = stored(linked.groupBy("set1", "set2").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"),
        *(F.min(s).alias(s) for s in sig)).withColumnRenamed("set1", "node").drop("set2"))

    firsts = nodes.select("node", F.col("doc_id").alias("_d"))
    member = stored(linked.join(firsts.hint("shuffle_merge"), (linked["set1"] == firsts["node"])
                                & (linked["doc_id"] == firsts["_d"]))
                    .select("node", F.explode("bands").alias("bucket")).distinct())
    centers = stored(member.groupBy("bucket").agg(F.min("node").alias("_c"),
                                                  F.count("*").alias("m"))
                     .where("m > 1").select(F.col("bucket").alias("_b"), "_c"))
    inside = stored(member.join(centers.hint("shuffle_merge"), member["bucket"] == centers["_b"])
                    .select("bucket", "node", "_c"))
    pairs = inside.where("node <> _c").select(F.col("_c").alias("a"),
                                              F.col("node").alias("b")).distinct()
    likely = stored(_likely(pairs, nodes, threshold))
    links = stored(_confirm(likely, _texts_of(_ends(likely), nodes, docs), per_cent))
    labels = components(links)
    more = _across(inside.select("bucket", "node"), nodes, labels, docs, per_cent)
    if more is not None:
        extra = stored(more)
        if not extra.isEmpty():
            labels = components(links.unionByName(extra))
    own = nodes.select("node", "doc_id")
    named = stored(own.join(labels.withColumnRenamed("node", "_n").hint("shuffle_merge"),
                            own["node"] == F.col("_n"), "left")
                   .select("node", "doc_id", F.coalesce("label", "node").alias("label")))
    smallest = named.groupBy(F.col("label").alias("_l")).agg(F.min("doc_id").alias("component_id"))
    final = stored(named.join(smallest.hint("shuffle_merge"), named["label"] == F.col("_l"))
                   .select(F.col("node").alias("_n"), "component_id"))
    out = rows.join(final.hint("shuffle_merge"), (rows["set1"] == final["_n"])
                    & (rows["n_shingles"] > 0), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce("component_id", "doc_id"))
    release(spark)
    return (out.withColumn("component_id", component)
            .select("doc_id", "text_hash", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
                    .alias("kept")))


def keep_one(docs: DataFrame, per_cent: int = RULE) -> DataFrame:
    """One document of each group of near duplicates, all columns.

    Rows that share id and text, and texts of one group under one id, leave one
    row as well; rows with a null id all stay.
    """
    found = stored(near_duplicates(docs, per_cent)).where("doc_id is not null")
    own = found.where("kept")
    first = own.groupBy(F.col("doc_id").alias("_d"), F.col("component_id").alias("_c")).agg(
        F.min("text_hash").alias("_m"), F.max("text_hash").alias("_x")).where("_m < _x")
    second = own.join(first, (F.col("doc_id") == F.col("_d")) & (F.col("component_id")
                                                                == F.col("_c"))
                      & (F.col("text_hash") > F.col("_m")))
    gone = stored(found.where("not kept").select("doc_id", "text_hash")
                  .union(second.select("doc_id", "text_hash")).distinct()
                  .select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")))
    i, t, n = fresh(docs, "_i", "_t", "_n")
    keyed = docs.select(*own_columns(docs), F.col("doc_id").cast("long").alias(i),
                        F.xxhash64("text").alias(t))
    d, h = fresh(keyed, "_d", "_h")
    gone = gone.select(F.col("_d").alias(d), F.col("_h").alias(h))
    left = keyed.join(gone.hint("shuffle_merge"), (F.col(i) == F.col(d))
                      & (F.col(t) == F.col(h)), "left_anti")
    if not own.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        # Spark prunes each task's rows to the first of a key before the shuffle
        turn = W.partitionBy(i, t).orderBy(t)
        left = left.where(F.col(i).isNull()).unionByName(
            left.where(F.col(i).isNotNull()).withColumn(n, F.row_number().over(turn))
            .where(F.col(n) == 1).drop(n))
    return left.select(*own_columns(docs))


def op7_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash")
