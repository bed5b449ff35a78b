"""Hash-chained decision log.

* H1/H2 are column expressions: the canonical payload text and its sha256
  (``payload_hash``) are computed in parallel for every record.  Every field is
  written with its length, nulls as ``-``, so different records have different
  texts; chain and ``seq`` are part of it.
* H3 links records: ``record_hash = sha256(prev_hash : pos : payload_hash)``.
  A chain is one card in one time slice, so the number of chains grows with
  the data.  Rows are hash-partitioned by chain once, sorted by ``seq`` and
  streamed through Python, which reads chain and payload hash, carries the last
  hash of one chain and passes the other columns on: give it only those that
  are wanted behind it.  A chain resumes from the head of a previous batch,
  which joins the stream as a seed row.
* H4 verification is fully parallel: recompute every hash, then compare each
  record with its predecessor by an equi-join on (chain, pos), null-safe; look
  for two records at one place; and, given the heads, for cut-off ends.  Hashes
  travel as bytes, half as long as their text.

Chains are self-consistent, not byte-compatible with JSON-based logs.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardlens.constants import DAY_US, FEATURE_NAMES, GENESIS_HASH
from cardlens.functions.text import pseudonym
from cardlens.operators.decide import fixed_text

SCORE_COLS = ("risk_score", "supervised_score", "anomaly_score", "sequence_score")
CHAIN_SLICE_US = 28 * DAY_US
TEXT_FIELDS = ("timestamp", "transaction_id", "card_hash", "model_version", "action")


def audit_payload(df: DataFrame, model_version: str, include_features: bool = True) -> DataFrame:
    """H1: the record body per decision (scores and features rounded to 6)."""
    snap = F.create_map(*[x for n in FEATURE_NAMES for x in (F.lit(n), F.round(F.col(n), 6))]) \
        if include_features else F.create_map().cast("map<string,double>")
    card = pseudonym(F.col("card_id"))
    return df.select(
        chain_of(card, F.col("event_us")).alias("chain_id"),
        F.date_format(F.timestamp_micros("event_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
         .alias("timestamp"),
        "transaction_id", "seq", card.alias("card_hash"),
        F.lit(model_version).alias("model_version"), "action",
        *[F.round(F.col(c), 6).alias(c) for c in SCORE_COLS],
        F.col("reasons").alias("reason_codes"), "triggered_rules",
        snap.alias("feature_snapshot"))


def chain_of(card_hash: Column, event_us: Column, slice_us: int = CHAIN_SLICE_US) -> Column:
    """Chain of a record: its card and time slice."""
    part = F.floor(event_us / slice_us).cast("string")
    return F.concat_ws("-", F.coalesce(card_hash, F.lit("none")), F.coalesce(part, F.lit("none")))


def _part(value: Column) -> Column:
    """A value with its length, so that neighbours cannot run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _parts(values: Column) -> Column:
    return F.coalesce(F.concat(F.lit("["), F.size(values).cast("string"), F.lit("]"),
                               F.array_join(F.transform(values, _part), "")), F.lit("-"))


def canonical_text() -> Column:
    """H2 input: fixed field order, 6-decimal numbers, nothing left out."""
    snapshot = [_part(fixed_text(F.element_at("feature_snapshot", F.lit(n)), 6))
                for n in FEATURE_NAMES]
    return F.concat(_part(F.col("chain_id")), _part(F.col("seq")),
                    *(_part(F.col(c)) for c in TEXT_FIELDS),
                    *(_part(fixed_text(F.col(c), 6)) for c in SCORE_COLS),
                    _parts(F.col("reason_codes")), _parts(F.col("triggered_rules")), *snapshot)


def payload_hash() -> Column:
    return F.sha2(canonical_text(), 256)


def _link(own: list[str]):
    """Link rows sorted by chain; a seed row only sets where its chain goes on."""
    def run(batches):
        chain, pos, last = None, 0, GENESIS_HASH
        for batch in batches:
            rows, places, before, hashes = [], [], [], []
            read = (batch.column(c).to_pylist() for c in ("chain_id", "payload_hash", "_pos", "_seed"))
            for i, (c, body, at, seed) in enumerate(zip(*read)):
                if c != chain:
                    chain, pos, last = c, 0, GENESIS_HASH
                if seed is not None:
                    pos, last = at, seed
                    continue
                pos += 1
                rows.append(i)
                places.append(pos)
                before.append(last)
                last = hashlib.sha256(f"{last}:{pos}:{body}".encode()).hexdigest()
                hashes.append(last)
            if rows:
                kept = batch.select(own)
                if len(rows) < batch.num_rows:
                    kept = kept.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(places, pa.int64()), pa.array(before), pa.array(hashes)],
                    names=[*own, *LINK])
    return run


LINK = ("pos", "prev_hash", "record_hash")


def unlinkable(records: DataFrame) -> DataFrame:
    """Records without a chain or a place in it: ``link_chain`` leaves them out."""
    return records.where(F.col("chain_id").isNull() | F.col("seq").isNull())


def link_chain(records: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """H3: add ``pos``, ``prev_hash`` and ``record_hash`` to records with
    ``chain_id``, ``seq`` and ``payload_hash``.  ``heads``: ``chain_heads`` of
    the batches before.  Equal records are linked one after the other, each at
    its own place; records without chain or ``seq`` take no place (see
    ``unlinkable``)."""
    key = ["chain_id", "seq", "payload_hash"]
    own = [*key, *(c for c in records.columns if c not in key)]
    records = records.where(F.col("chain_id").isNotNull() & F.col("seq").isNotNull()) \
        .withColumn("seq", F.col("seq").cast("long")).select(*own)
    rows = records.withColumns({"_pos": F.lit(0).cast("long"), "_seed": F.lit(None).cast("string")})
    if heads is not None:
        known = heads.join(records.select("chain_id").distinct(), "chain_id", "left_semi")
        rows = rows.unionByName(known.select(
            "chain_id", F.col("last_seq").cast("long").alias("seq"),
            F.col("last_pos").cast("long").alias("_pos"), F.col("last_hash").alias("_seed")),
            allowMissingColumns=True)
    ordered = rows.repartition("chain_id").sortWithinPartitions(
        "chain_id", F.col("_seed").isNull(), "seq", "payload_hash", "transaction_id")
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in records.schema]
                         + [T.StructField("pos", T.LongType()), T.StructField("prev_hash", T.StringType()),
                            T.StructField("record_hash", T.StringType())])
    return ordered.mapInArrow(_link(own), kinds)


def chain_heads(chained: DataFrame) -> DataFrame:
    """Last record hash per chain: the seed for the next batch (resume) and the
    proof against cut-off ends."""
    return chained.groupBy("chain_id").agg(
        F.max_by("record_hash", "pos").alias("last_hash"), F.max("seq").alias("last_seq"),
        F.max("pos").alias("last_pos"))


def _packed(text: Column) -> Column:
    """A hash as bytes, any other text as it is; different texts stay different."""
    return F.when(text.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(b"h"), F.unhex(text))) \
            .otherwise(F.concat(F.lit(b"t"), text.cast("binary")))


def verify_chain(chained: DataFrame, heads: DataFrame | None = None,
                 body_hash: Column | None = None) -> DataFrame:
    """H4: every broken record with a reason; all checks are joins/aggregates.
    ``body_hash``: ``payload_hash`` of each record as it is now, where it was taken
    as the bodies were read; without it the bodies are columns of ``chained``."""
    again = F.sha2(F.concat_ws(":", F.coalesce("prev_hash", F.lit("")),
                               F.coalesce(F.col("pos").cast("string"), F.lit("")),
                               payload_hash() if body_hash is None else body_hash), 256)
    rec = chained.select("chain_id", "seq", "transaction_id", "pos",
                         _packed(F.col("prev_hash")).alias("prev_hash"),
                         _packed(F.col("record_hash")).alias("record_hash"),
                         again.eqNullSafe(F.col("record_hash")).alias("intact"))

    def found(df: DataFrame, reason: str) -> DataFrame:
        return df.select("chain_id", "seq", "transaction_id", F.lit(reason).alias("reason"))

    broken = found(rec.where(~F.col("intact")), "hash_mismatch")
    lost = found(rec.where("pos is null or pos < 1 or chain_id is null"), "malformed")
    before = rec.select(F.col("chain_id").alias("_c"), (F.col("pos") + 1).alias("_p"),
                        F.col("record_hash").alias("_h"), F.col("seq").alias("_s"))
    linked = rec.where("pos >= 1").join(before, (rec["chain_id"] == F.col("_c"))
                                        & (rec["pos"] == F.col("_p")), "left")
    start = (F.col("pos") == 1) & ~F.col("prev_hash").eqNullSafe(_packed(F.lit(GENESIS_HASH)))
    later = (F.col("pos") > 1) & (F.col("_h").isNull()
                                  | ~F.col("prev_hash").eqNullSafe(F.col("_h")))
    orphans = found(linked.where(start | later), "missing_predecessor")
    order = found(linked.where("_s > seq"), "out_of_order")
    forks = (rec.groupBy("chain_id", "pos").agg(F.count("*").alias("_n"), F.max("seq").alias("seq"),
                                                F.max_by("transaction_id", "seq")
                                                .alias("transaction_id")).where("_n > 1"))
    out = broken.unionByName(lost).unionByName(orphans).unionByName(order) \
        .unionByName(found(forks, "fork")).distinct()
    if heads is not None:
        ends = rec.select("chain_id", F.col("pos").alias("last_pos"),
                          F.col("record_hash").alias("last_hash"))
        cut = heads.withColumn("last_hash", _packed(F.col("last_hash"))).join(ends, ["chain_id", "last_pos", "last_hash"], "left_anti").select(
            "chain_id", F.col("last_seq").alias("seq"),
            F.lit(None).cast("string").alias("transaction_id"), F.lit("missing_end").alias("reason"))
        out = out.unionByName(cut)
    return out


def first_breaks(breaks: DataFrame) -> DataFrame:
    """The first broken record per chain (by seq) and the number of breaks."""
    return breaks.groupBy("chain_id").agg(
        F.min_by("transaction_id", "seq").alias("first_broken_transaction_id"),
        F.min("seq").alias("first_broken_seq"),
        F.count(F.lit(1)).alias("n_broken"))


AUDIT_SCHEMA = (
    "chain_id string, seq long, payload_hash string, timestamp string, transaction_id string, "
    "card_hash string, model_version string, action string, "
    + ", ".join(f"{c} double" for c in SCORE_COLS)
    + ", reason_codes array<string>, triggered_rules array<string>, "
    "feature_snapshot map<string,double>, pos long, prev_hash string, record_hash string")


def read_audit_json(spark, path: str) -> DataFrame:
    """Scan an audit log written as JSON lines, by its declared schema."""
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def write_audit(chained: DataFrame, path: str) -> None:
    """Append-only write (JSON lines, one folder per batch)."""
    chained.write.mode("append").option("ignoreNullFields", "false").json(path)
