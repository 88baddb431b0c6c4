"""Audit trail: idempotent append, checks, hash chains, envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import ABSENT
from ..functions.variants import let
from ..session import join_small, materialize, on_same
from .dedupe import first_per_key
from .folds import settle
from .positions import with_position, with_previous

GENESIS = "GENESIS"
CHAIN_BLOCK = 1 << 14
#: Links that are appended one by one before they are added to those of the block.
CHAIN_PIECE = 1 << 7


def append(log: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Incoming records not in the log yet, one per key: what to append."""
    return first_per_key(incoming, key, order).join(log.select(*key), list(key), "left_anti")


def with_evicted(log: DataFrame, maximum: int, ts: str, tie: Sequence[str]) -> DataFrame:
    """Add ``evicted``: true for the oldest records beyond the ``maximum`` newest ones; no bound below 1.

    Records are ordered by time and ``tie``; an unreadable time is the oldest. Records are counted per hour first, which tells for whole
    hours whether they stay; only the hour that holds the bound is put in order, by a range shuffle.
    """
    if maximum < 1:
        return log.withColumn("evicted", F.lit(False))
    when = F.coalesce(F.try_to_timestamp(F.col(ts).cast("string")), F.timestamp_seconds(F.lit(0)))
    rows = log.withColumn("__when", when).withColumn("__hour", F.floor(F.unix_micros("__when") / 3_600_000_000))
    newer = Window.orderBy(F.col("__hour").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per hour
    hours = rows.groupBy("__hour").agg(F.count("*").alias("__n")).withColumn("__newer", F.coalesce(F.sum("__n").over(newer), F.lit(0)))
    rows = materialize(join_small(rows, hours, ["__hour"]))
    cut = (F.col("__newer") < maximum) & (F.col("__newer") + F.col("__n") > maximum)
    whole = rows.where(~cut).withColumn("evicted", F.col("__newer") >= maximum)
    order = [F.col("__when").desc(), *[F.col(c).desc() for c in tie]]
    edge = with_position(rows.where(cut), [], order, "__idx").withColumn("evicted", F.col("__newer") + F.col("__idx") >= maximum)
    return whole.select(*log.columns, "evicted").unionByName(edge.select(*log.columns, "evicted"))


def append_bounded(log: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str], maximum: int, ts: str) -> DataFrame:
    """The log after an append that keeps its ``maximum`` newest records."""
    grown = log.unionByName(append(log, incoming, key, order))
    return with_evicted(grown, maximum, ts, key).where(~F.col("evicted")).drop("evicted")


def verify_events(df: DataFrame, tenant: str, event: str, ts: str, action: str) -> DataFrame:
    """Rows with a missing field, an unreadable time or a repeated (tenant, event) id."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    repeats = df.groupBy(tenant, event).agg(F.count("*").alias("__n")).where("__n > 1").withColumn("__dup", F.lit(True))
    checked = df.join(repeats.drop("__n"), [tenant, event], "left")
    problems = F.array_compact(
        F.array(
            *[F.when(blank(c), F.lit(f"missing:{c}")) for c in (tenant, event, ts, action)],
            F.when(~blank(ts) & F.try_to_timestamp(F.col(ts).cast("string")).isNull(), F.lit("invalid:ts")),
            F.when(F.col("__dup"), F.lit("duplicate:event_id")),
        )
    )
    return checked.withColumn("problems", problems).where(F.size("problems") > 0).drop("__dup")


def link(previous: Column, canonical: Column) -> Column:
    """Hash of a record after the previous one; a record without a text is hashed as absent."""
    return F.sha2(F.concat(previous, F.lit("\n"), F.coalesce(canonical, F.lit(ABSENT))), 256)


def _links(texts: Column, entry: Column) -> Column:
    """``entry`` and the hashes of the texts chained from it on.

    An append copies the array, so links are appended to short pieces, and the pieces to the block.
    """
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(texts) - 1) / F.lit(CHAIN_PIECE)).cast("int")), lambda i: F.slice(texts, i * CHAIN_PIECE + 1, F.lit(CHAIN_PIECE)))
    grow = lambda links, text: F.concat(links, F.array(link(F.element_at(links, -1), text)))
    add = lambda links, piece: F.concat(links, F.slice(F.aggregate(piece, F.array(F.element_at(links, -1)), grow), F.lit(2), F.size(piece)))
    return F.aggregate(pieces, F.array(entry), add)


def chain_build(df: DataFrame, keys: Sequence[str], order: Sequence[str], canonical: Column, block: int = CHAIN_BLOCK) -> DataFrame:
    """Add ``prev_hash`` and ``hash``: each record's hash covers the one before it, per key.

    A hash chain is sequential by definition, so blocks of one key wait for each other, but no task
    holds more than one block and all keys advance together. Put a day into ``keys`` to let the
    days of a very long trail be chained independently.
    """
    keys = list(keys)
    rows = with_position(df.withColumn("__text", canonical), keys, order)
    blocked = rows.withColumn("blk", F.floor(F.col("idx") / F.lit(block)).cast("bigint"))
    packed = materialize(
        blocked.groupBy(*keys, "blk").agg(F.sort_array(F.collect_list(F.struct("idx", "__text"))).alias("rows"))
    )
    entries = packed.where("blk = 0").select(*keys, "blk", F.lit(GENESIS).alias("entry"))
    hashed = _links(F.col("rows.__text"), F.col("entry"))
    several = packed.where("blk > 0").limit(1).count() > 0
    last = lambda rows: rows.withColumn("exit", F.element_at(hashed, -1))
    settled = settle(packed, keys, on_same(packed, entries, [*keys, "blk"]), last) if several else entries
    pairs = let(hashed, lambda h: F.transform(F.slice(h, F.lit(2), F.size(h) - 1), lambda x, i: F.struct(F.get(h, i).alias("prev_hash"), x.alias("hash"))))
    # the outer form keeps the planner from hashing once more to filter empty blocks
    links = on_same(packed, settled, [*keys, "blk"]).select(*keys, "blk", F.posexplode_outer(pairs).alias("__p", "__link"))
    links = links.select(*keys, (F.col("blk") * block + F.col("__p")).alias("idx"), "__link.prev_hash", "__link.hash")
    return on_same(rows, links, [*keys, "idx"]).drop("__text")


def chain_verify(df: DataFrame, keys: Sequence[str], order: Sequence[str], canonical: Column) -> DataFrame:
    """Records whose hash or link does not hold. Every record is checked on its own, in parallel."""
    rows = with_position(df.withColumn("__text", canonical), list(keys), order)
    linked = with_previous(rows.withColumnRenamed("prev_hash", "__stored"), keys, ["hash"])
    before = F.coalesce(F.col("prev_hash"), F.lit(GENESIS))
    problems = F.array_compact(
        F.array(
            F.when(F.col("__stored") != before, F.lit("link")),
            F.when(F.col("hash") != link(F.col("__stored"), F.col("__text")), F.lit("hash")),
        )
    )
    checked = linked.withColumn("problems", problems).where(F.size("problems") > 0)
    return checked.drop("prev_hash", "__text").withColumnRenamed("__stored", "prev_hash")


def chain_heads(chained: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What to keep of a chain elsewhere: number of links and hash of the last one, per key."""
    return chained.groupBy(*keys).agg(F.count("*").alias("links"), F.max_by("hash", F.struct(*order)).alias("head"))


def verify_heads(df: DataFrame, keys: Sequence[str], order: Sequence[str], heads: DataFrame) -> DataFrame:
    """Chains that are not the ones whose heads were kept, with the problems.

    A log that is cut at its end or chained anew holds link by link; only its number of links and its
    head tell. ``chain_verify`` checks the links themselves.
    """
    now = chain_heads(df, keys, order).withColumnsRenamed({"links": "__links", "head": "__head"})
    marked = on_same(heads.withColumn("__kept", F.lit(True)), now.withColumn("__found", F.lit(True)), keys, "left")
    extra = on_same(now, heads.select(*keys), keys, "left_anti").select(*keys, F.array(F.lit("unknown")).alias("problems"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("__found").isNull(), F.lit("missing")),
            F.when(F.col("__links") < F.col("links"), F.lit("cut")),
            F.when(F.col("__links") > F.col("links"), F.lit("longer")),
            F.when((F.col("__links") == F.col("links")) & (F.col("__head") != F.col("head")), F.lit("head")),
        )
    )
    return marked.select(*keys, problems.alias("problems")).where(F.size("problems") > 0).unionByName(extra)


def envelope_hash(columns: Sequence[str], previous: str | None = None) -> Column:
    """SHA-256 of the row's canonical JSON, the previous hash included."""
    fields = sorted([*columns, *([previous] if previous else [])])
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def verify_envelope(df: DataFrame, columns: Sequence[str], stored: str, previous: str | None = None) -> DataFrame:
    """Rows whose stored envelope hash does not match."""
    return df.withColumn("computed", envelope_hash(columns, previous)).where(~F.col(stored).eqNullSafe(F.col("computed")))


def observation_id(fields: Sequence[Column], meta: Column) -> Column:
    """SHA-256 over the fields and the sorted ``name=value`` pairs of the metadata map."""
    pairs = F.transform(F.sort_array(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    parts = F.array(*[F.coalesce(f, F.lit(ABSENT)) for f in fields])
    return F.sha2(F.array_join(F.concat(parts, F.coalesce(pairs, F.array().cast("array<string>"))), "|", ABSENT), 256)
