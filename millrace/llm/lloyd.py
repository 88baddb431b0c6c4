"""Vector code compression: product codes from Lloyd's rounds whose members stay with their owners.

Vectors become integers ``floor(4096 * x)`` and are cut into ``PARTS`` equal parts. A part is a member of the codebook
entry it is assigned to; members live in files partitioned by (position, entry, salt), the owners. In a round every
owner looks at the members it holds: those that stay nearest to its entry are summed in place, and only the others are
dealt to the owner of their new entry, as the next generation of files. Files are never written again. A member has
left its file once one of the codebooks since then put it elsewhere, which the owner sees by trying them in turn. The
salts keep an owner near ``OWNED`` members, however many vectors share an entry.

An entry becomes the floor of its members' mean: the owners' sums of those that stayed and of the arrivals, added up in Spark
to one row per place of the codebooks, which hold ``ENTRIES`` times the vector's length at any input size. All arithmetic is
in integers. After the rounds a last scan of the vectors gives each its code and error, without a shuffle.

Defined cases: a vector that is null or holds a null or non-finite component is dropped; the first entries are those of
the smallest ids (null ids come last, ties are ordered by the vector), so fewer vectors than entries give fewer entries; ties go to the
lower entry; shorter vectors, and lengths that can't be cut evenly, are filled up with zeros; repeated rows each count;
an empty table gives no rows; other columns pass through, and columns of the added names are replaced. Squared distances that 64 bits
can't hold (components in the hundred thousands) raise ``OverflowError``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import join_small, materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Members of a (position, entry, salt) if one entry holds all vectors.
OWNED = 1000
MEMBERS = "position int, entry int, salt int, member boolean, n long, part binary"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.filter(F.col(column).isNotNull() & fine)


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """(rows, PARTS, width) integers of an Arrow array of vectors."""
    flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and not np.abs(flat).max() < 2.0**31:
        raise OverflowError("components are too large for squared distances in 64 bits")
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), PARTS * width), np.int64)
    begin = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(begin, sizes)] = flat.astype(np.int64)
    return out.reshape(len(vectors), PARTS, width)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of ``book`` (entries, width) next to each part (rows, width), the lower one on a tie, and its squared distance."""
    top = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    if parts.shape[1] * (2 * top) ** 2 >= 1 << 63:
        raise OverflowError("components are too large for squared distances in 64 bits")
    kind = np.float64 if parts.shape[1] * (2 * top) ** 2 < 1 << 53 else np.int64  # both are exact here, the first is faster
    x, c = parts.astype(kind), book.astype(kind)
    far = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    entry = far.argmin(axis=1)
    return entry, far[np.arange(len(far)), entry].astype(np.int64)


def _rows(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, n: np.ndarray, parts: np.ndarray, member: bool) -> pa.RecordBatch:
    size = parts.shape[1] * parts.dtype.itemsize
    offsets = pa.py_buffer((np.arange(len(parts) + 1, dtype=np.int64) * size).astype(np.int32))
    data = pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, offsets, pa.py_buffer(np.ascontiguousarray(parts))])
    flags = pa.array(np.full(len(parts), member))
    columns = [pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(salt, pa.int32()), flags, pa.array(n, pa.int64()), data]
    return pa.RecordBatch.from_arrays(columns, ["position", "entry", "salt", "member", "n", "part"])


def _values(parts: pa.Array, kind: type, width: int) -> np.ndarray:
    data = parts.buffers()[2]
    offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width) if len(parts) else np.zeros((0, width), kind)


def _first_members(kept: DataFrame, column: str, book: np.ndarray, salts: int) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            numbers = whole_numbers(batch.column(0), book.shape[2])
            salt = (seen + np.arange(len(numbers))) % salts
            seen += len(numbers)
            for p in range(PARTS):
                entry, _ = nearest(numbers[:, p], book[p])
                yield _rows(np.full(len(entry), p), entry, salt, np.ones(len(entry), np.int64), numbers[:, p].astype(np.int32), True)

    return kept.select(column).mapInArrow(deal, MEMBERS)


def _next_members(generations: list[DataFrame], books: list[np.ndarray], salts: int) -> DataFrame:
    """What the owners give away under the last of ``books``, and a row per task and entry that sums what they keep."""
    width, last = books[0].shape[2], len(books) - 1
    held = generations[0].filter("member").withColumn("since", F.lit(0))
    for g, generation in enumerate(generations[1:], 1):
        held = held.unionAll(generation.filter("member").withColumn("since", F.lit(g)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((PARTS, books[0].shape[1], width + 1), np.int64)
        moved = 0
        for batch in batches:
            parts = _values(batch.column("part"), np.int32, width).astype(np.int64)
            position, entry, since = (batch.column(c).to_numpy() for c in ("position", "entry", "since"))
            for p in np.unique(position):
                here = np.flatnonzero(position == p)
                for k in range(int(since[here].min()) + 1, last):
                    still = (since[here] >= k) | (nearest(parts[here], books[k][p])[0] == entry[here])
                    here = here[still]
                now, _ = nearest(parts[here], books[last][p])
                stays = now == entry[here]
                np.add.at(kept[p, :, 0], now[stays], 1)
                np.add.at(kept[p, :, 1:], now[stays], parts[here[stays]])
                goes = here[~stays]
                salt = (moved + np.arange(len(goes))) % salts
                moved += len(goes)
                if len(goes):
                    yield _rows(np.full(len(goes), p), now[~stays], salt, np.ones(len(goes), np.int64), parts[goes].astype(np.int32), True)
        position, entry = np.nonzero(kept[:, :, 0])
        if len(position):
            sums = kept[position, entry]
            yield _rows(position, entry, np.zeros(len(sums), np.int64), sums[:, 0], sums[:, 1:], False)

    return held.mapInArrow(step, MEMBERS)


def _updated(generation: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after a round, from what the owners kept and what arrived."""
    width = book.shape[2]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, book.shape[1], width + 1), np.int64)
        for batch in batches:
            for member, kind in ((True, np.int32), (False, np.int64)):
                some = batch.filter(pa.array(batch.column("member").to_numpy(zero_copy_only=False) == member))
                at = some.column("position").to_numpy(), some.column("entry").to_numpy()
                np.add.at(total[:, :, 0], at, some.column("n").to_numpy())
                np.add.at(total[:, :, 1:], at, _values(some.column("part"), kind, width).astype(np.int64))
        position, entry = np.nonzero(total[:, :, 0])
        place = np.tile(np.arange(width), len(position))
        n = np.repeat(total[position, entry, 0], width)
        columns = [np.repeat(position, width), np.repeat(entry, width), place, n, total[position, entry, 1:].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["position", "entry", "place", "n", "sum"])

    sums = generation.mapInArrow(add, "position long, entry long, place long, n long, sum long")
    new = book.copy()
    for r in sums.groupBy("position", "entry", "place").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).collect():  # a codebook
        new[r["position"], r["entry"], r["place"]] = r["sum"] // r["n"]
    return new


def fit(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (PARTS, entries, width) after ``rounds`` rounds over all usable vectors."""
    kept = usable(vectors, column)
    size = kept.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("longest")).first()
    if not size["n"]:
        return np.zeros((PARTS, 0, 0), np.int64)
    width = max(-(-size["longest"] // PARTS), 1)
    salts = -(-size["n"] // OWNED)
    first = kept.select(id, F.col(column).cast("array<double>").alias("v")).orderBy(F.col(id).asc_nulls_last(), "v").limit(ENTRIES).collect()
    books = [np.ascontiguousarray(whole_numbers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), width).transpose(1, 0, 2))]
    generations: list[DataFrame] = []
    for _ in range(rounds):
        members = _next_members(generations, books, salts) if generations else _first_members(kept, column, books[0], salts)
        generations.append(materialize(members.repartition("position", "entry", "salt")))
        books.append(_updated(generations[-1], books[-1]))
    return books[-1]


def encode(vectors: DataFrame, books: np.ndarray, column: str = "embedding", names: tuple[str, str] = ("code", "error")) -> DataFrame:
    """The usable rows with their code (two hex digits a part) and squared distance to it under ``names``."""
    rows = usable(vectors, column).drop(*names)
    schema = StructType([*rows.schema.fields, StructField(names[0], StringType()), StructField(names[1], LongType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = whole_numbers(batch.column(column), books.shape[2])
            found = [nearest(numbers[:, p], books[p]) for p in range(PARTS)]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            texts = pa.array([row.tobytes().hex() for row in codes], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts, pa.array(sum(far for _, far in found), pa.int64())], [*batch.schema.names, *names])

    return rows.mapInArrow(look, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = fit(vectors)
    coded = materialize(encode(vectors, books).select("vec_id", "label", "code", "error"))
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = join_small(coded, by_label, ["label"])
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    floor_mean = "((sum(q) - ((sum(q) % count(*)) + count(*)) % count(*)) // count(*))::bigint"
    rounds = ""
    for k in range(ROUNDS + 1):
        rounds += f""",
far{k} as materialized (
  select r, pos, entry, sum((q - v) * (q - v))::bigint as far from cut join book{k} using (pos, i) group by all),
at{k} as materialized (
  select * from far{k} qualify row_number() over (partition by r, pos order by far, entry) = 1)"""
        if k < ROUNDS:
            rounds += f""",
mean{k} as (select pos, entry, i, {floor_mean} as v from cut join at{k} using (r, pos) group by all),
book{k + 1} as materialized (
  select b.pos, b.entry, b.i, coalesce(m.v, b.v) as v from book{k} b left join mean{k} m using (pos, entry, i))"""
    return f"""
with kept as materialized (
  select *, row_number() over (order by vec_id nulls last, embedding) - 1 as r from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
flat as (
  select r, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as spot, ((select max(len(embedding)) from kept) + {PARTS - 1}) // {PARTS} as width from kept),
cut as materialized (select r, spot // width as pos, spot % width as i, floor({SCALE} * x)::bigint as q from flat),
book0 as (select pos, r as entry, i, q as v from cut where r < {ENTRIES}){rounds},
coded as (
  select r, string_agg(format('{{:02x}}', entry), '' order by pos) as code, sum(far)::bigint as error from at{ROUNDS} group by r)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
  (select sha256(string_agg(v::varchar, ',' order by pos, entry, i)) from book{ROUNDS}) as codebooks_sha256
from coded join kept using (r)
"""


SQL = _sql()
