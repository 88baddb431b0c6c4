"""Source divergence audit: how far the sources of a language are from each other, and which terms set them apart.

Terms are counted per slice of the texts and added up per (lang, source, term) behind one shuffle by (lang, term), where the
terms that too few documents hold go. What is left is the term-major index: a term with the sources that use it. It is cut
into blocks of about ``POSTINGS`` postings, and the groups (sources of a language) into blocks whose accumulators hold
about ``CELLS`` numbers. A task has one block of terms, one of groups: it turns its terms' rows around, and every group of
its block scatters its terms through the index into a dense accumulator with a place per peer (Gustavson's row product).
No pair of postings is ever a row.

An accumulator starts from what two groups without these terms would have. With f(p, q) for a term's two shares, p0 and q0
the shares of a term that a group lacks, the sum over all V terms is::

    V f(p0, q0) + sum over a's terms of f(p, q0) - f(p0, q0) + sum over b's terms of f(p0, q) - f(p0, q0)
                + sum over common terms of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The first three depend on counts alone, so they are taken once per distinct count; only common terms are walked.

Defined cases: null text, lang and source are empty texts; every (lang, source) that occurs is a group, also without a
term; in a language without kept terms all values are 0; repeated rows are documents of their own; doc_id and other columns
are not looked at; an empty table gives no rows. Counts are exact at any size: shares are formed with Python's integers where
64 bits would not do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import join_small, materialize
from .common import documents, whole

LEAST_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
#: Bytes of text whose terms are counted at a time, unless one text is longer.
CHUNK = 12_000_000
POSTINGS = 500_000
CELLS = 1 << 21

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = 0
        for at, n in enumerate(sizes):
            if size + n > CHUNK and (size or at > begin):
                yield pa.Table.from_batches([*held, batch.slice(begin, at - begin)])
                held, size, begin = [], 0, at
            size += int(n)
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def _runs(changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs, given where a sorted row differs from the one before, and the runs' lengths."""
    first = np.flatnonzero(changed)
    return first, np.diff(np.append(first, len(changed)))


def _changed(keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    out[1:] = keys[1:] != keys[:-1]
    return out


def _count(table: pa.Table) -> pa.RecordBatch | None:
    """One row per (lang, term) of a chunk: its sources, and the occurrences and documents in each."""
    texts = pa.concat_arrays(table.column("text").chunks).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _LETTER[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edge = offsets[1:-1][offsets[1:-1] < len(raw)]
    starts[edge] |= inside[edge]
    begin = np.flatnonzero(starts)
    if not len(begin):
        return None
    row = np.searchsorted(offsets, begin, side="right") - 1
    ends = np.append(np.cumsum(inside)[begin] - 1, inside.sum())  # places of the terms among the letters
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[raw[inside]])])
    words = words.dictionary_encode()
    del inside, starts, raw
    lang, source = (pa.chunked_array(table.column(c).chunks).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    n_terms, n_sources = len(words.dictionary), len(source.dictionary)
    term = words.indices.to_numpy().astype(np.int64)
    group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
    # (term, row) sorted: equal neighbours are one document's occurrences
    key = np.sort(term * len(texts) + row)
    first, n = _runs(_changed(key))
    term, at = np.divmod(key[first], len(texts))
    cell = (group[at] // n_sources * n_terms + term) * n_sources + group[at] % n_sources
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    first, docs = _runs(_changed(cell))
    n = np.add.reduceat(n, first)
    lang_term, of = np.divmod(cell[first], n_sources)
    head, size = _runs(_changed(lang_term))
    at_lang, at_term = np.divmod(lang_term[head], n_terms)
    stops = pa.array(np.append(head, len(lang_term)), pa.int32())
    lists = [
        pa.ListArray.from_arrays(stops, source.dictionary.take(pa.array(of))),
        pa.ListArray.from_arrays(stops, pa.array(n, pa.int64())),
        pa.ListArray.from_arrays(stops, pa.array(docs, pa.int64())),
    ]
    names = [lang.dictionary.take(pa.array(at_lang)), words.dictionary.take(pa.array(at_term)).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*names, *lists], ["lang", "term", "sources", "counts", "docs"])


def term_index(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, n, sources, counts): the terms that at least ``least_docs`` documents of the language hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            counted = _count(table)
            if counted is not None:
                yield from pa.Table.from_batches([counted]).to_batches(20_000)
            del table, counted
            pa.default_memory_pool().release_unused()

    rows = docs.select(whole("lang").alias("lang"), whole("source").alias("source"), whole().alias("text"))
    counted = rows.mapInArrow(count, "lang string, term string, sources array<string>, counts array<long>, docs array<long>")
    each = counted.repartition("lang", "term").select("lang", "term", F.explode(F.arrays_zip("sources", "counts", "docs")).alias("p"))
    each = each.groupBy("lang", "term", F.col("p.sources").alias("source")).agg(F.sum("p.counts").alias("n"), F.sum("p.docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("p"))
    return terms.filter(F.col("docs") >= least_docs).select(
        "lang", "term", "n", F.col("p.source").alias("sources"), F.col("p.n").alias("counts")
    )


def groups_of(docs: DataFrame, index: DataFrame) -> DataFrame:
    """A row per (lang, source): its number in the language, occurrences, and the language's groups, occurrences, terms and postings."""
    seen = docs.select(whole("lang").alias("lang"), whole("source").alias("source")).distinct()
    used = index.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("p"))
    used = used.groupBy("lang", F.col("p.sources").alias("source")).agg(F.sum("p.counts").alias("n"), F.count("*").alias("postings"))
    of_lang = index.groupBy("lang").agg(F.count("*").alias("terms"))
    all_of = Window.partitionBy("lang")
    rows = seen.join(used, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "postings", "terms"])
    return materialize(
        rows.select(
            "lang", "source", "n", "terms",
            (F.row_number().over(all_of.orderBy("source")) - 1).alias("place"),
            F.count("*").over(all_of).alias("peers"),
            F.sum("n").over(all_of).alias("lang_n"),
            F.sum("postings").over(all_of).alias("postings"),
        )
    )


def shares(counts: np.ndarray, n: np.ndarray | int, terms: int) -> np.ndarray:
    """p = 1 + floor(UNIT * (count + 1) / (n + terms)) of counts, exact."""
    if max(int(counts.max(initial=0)), 0) < 9_000_000_000:
        return 1 + UNIT * (counts.astype(np.int64) + 1) // (n + terms)
    of = np.broadcast_to(n, counts.shape).tolist()
    return np.array([1 + UNIT * (c + 1) // (t + terms) for c, t in zip(counts.tolist(), of, strict=True)], np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _by_count(at: np.ndarray, counts: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, count) of the groups lo to hi, and how many terms have them."""
    some = (at >= lo) & (at < hi)
    at, counts = at[some], counts[some]
    order = np.lexsort((counts, at))
    at, counts = at[order], counts[order]
    first, n = _runs(_changed(at) | _changed(counts)) if len(at) else (np.zeros(0, np.int64),) * 2
    return at[first], counts[first], n


def accumulate(at: np.ndarray, term: np.ndarray, counts: np.ndarray, n: np.ndarray, terms: int, lo: int, hi: int, with_base: bool) -> np.ndarray:
    """Sums of f over a block of terms for the groups lo to hi (rows) and all peers: postings (at, term, counts), terms ascending."""
    absent = shares(np.zeros(len(n), np.int64), n, terms)
    base = divergence(absent[lo:hi, None], absent[None, :])
    sums = base * terms if with_base else np.zeros_like(base)
    for g, count, times in zip(*_by_count(at, counts, lo, hi), strict=True):  # terms of the row's group, as if no peer had them
        p = shares(np.array([count]), int(n[g]), terms)[0]
        sums[g - lo] += times * (divergence(p, absent) - base[g - lo])
    for g, count, times in zip(*_by_count(at, counts, 0, len(n)), strict=True):  # terms of a peer, as if the row's group had none
        q = shares(np.array([count]), int(n[g]), terms)[0]
        sums[:, g] += times * (divergence(absent[lo:hi], q) - base[:, g])
    p = shares(counts, n[at], terms)
    heads = np.append(np.flatnonzero(_changed(term)), len(term))  # the index: places of each term's postings
    of = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    mine = np.flatnonzero((at >= lo) & (at < hi))
    mine = mine[np.argsort(at[mine], kind="stable")]
    for row in np.split(mine, np.flatnonzero(_changed(at[mine]))[1:]) if len(mine) else []:
        g = at[row[0]]
        sizes = heads[of[row] + 1] - heads[of[row]]
        step = np.cumsum(sizes) - sizes
        peers = np.arange(sizes.sum()) - np.repeat(step - heads[of[row]], sizes)  # all postings of the row's terms, term by term
        a, b, q0 = np.repeat(p[row], sizes), p[peers], absent[at[peers]]
        values = divergence(a, b) - divergence(a, q0) - divergence(absent[g], b) + divergence(absent[g], q0)
        np.add.at(sums[g - lo], at[peers], values)
    return sums


def _leading(values: np.ndarray, at: np.ndarray, term: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` postings of each group by value, then by term; terms are numbered in their order."""
    order = np.lexsort((term, -values, at))
    first, n = _runs(_changed(at[order])) if len(order) else (np.zeros(0, np.int64),) * 2
    return order[np.arange(len(order)) - np.repeat(first, n) < top]


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): the peers of each group (``pair``) and its leading terms (``term``)."""
    index = materialize(term_index(docs, least_docs))
    groups = groups_of(docs, index)
    rows_of = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("peers")))
    cuts = groups.groupBy("lang").agg(
        F.ceil(F.greatest(F.max("postings"), F.lit(1)) / F.lit(POSTINGS)).alias("term_blocks"),
        F.max(rows_of).cast("long").alias("rows"),
        F.ceil(F.max("peers") / F.max(rows_of)).alias("group_blocks"),
    )
    cells = F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1))
    left = join_small(index, cuts, ["lang"]).withColumn("tb", F.pmod(F.xxhash64("term"), F.col("term_blocks"))).withColumn("gb", cells)
    left = left.select("lang", "tb", "gb", "term", "n", "sources", "counts")
    right = join_small(groups, cuts, ["lang"]).withColumn("gb", cells)
    right = right.withColumn("tb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)))
    right = right.select("lang", "tb", "gb", "source", "place", "n", "terms", "lang_n", "rows")

    def block(key: tuple, held: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("place")
        held = held.sort_by("term")
        tb, gb = key[1].as_py(), key[2].as_py()
        source, n = known.column("source").combine_chunks(), known.column("n").to_numpy()
        terms, lang_n, rows = (known.column(c)[0].as_py() for c in ("terms", "lang_n", "rows"))
        lo, hi = gb * rows, min((gb + 1) * rows, len(n))
        sources, counts = held.column("sources").combine_chunks(), held.column("counts").combine_chunks().flatten().to_numpy()
        sizes = sources.value_lengths().to_numpy(zero_copy_only=False)
        at = pc.index_in(sources.flatten(), source).to_numpy(zero_copy_only=False).astype(np.int64)
        term = np.repeat(np.arange(len(sizes)), sizes)
        sums = accumulate(at, term, counts, n, terms, lo, hi, with_base=tb == 0)
        own, other = np.divmod(np.arange(sums.size), len(n))
        own, other = own[own + lo != other], other[own + lo != other]
        mine = np.flatnonzero((at >= lo) & (at < hi))
        p, q = shares(counts[mine], n[at[mine]], terms), shares(held.column("n").to_numpy()[term[mine]], lang_n, terms)
        mine, value = mine[p > q], divergence(p, q)[p > q]
        best = _leading(value, at[mine], term[mine], top)
        ids = np.concatenate([own + lo, at[mine[best]]])
        items = pa.concat_arrays([source.take(pa.array(other)), held.column("term").combine_chunks().take(pa.array(term[mine[best]]))])
        parts = pa.array(np.repeat(["pair", "term"], [len(own), len(best)]).tolist(), pa.string())
        values = pa.array(np.concatenate([sums[own, other], value[best]]), pa.int64())
        lang = pa.array([key[0].as_py()] * len(ids), pa.string())
        return pa.Table.from_arrays([lang, source.take(pa.array(ids)), parts, items, values], ["lang", "source", "part", "item", "value"])

    keys = ["lang", "tb", "gb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, "lang string, source string, part string, item string, value long")
    # a term is in one block, a pair in one per block of terms
    whole_rows = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return whole_rows.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir).select("text", "lang", "source")).select("lang", "source", "part", "item", "value", "rank")


SQL = rf"""
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
words as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
counted as materialized (
  select lang, source, term, count(*)::hugeint as n, count(distinct r) as d from words group by all),
kept as materialized (select lang, term, sum(n)::hugeint as n from counted group by all having sum(d) >= {LEAST_DOCS}),
sizes as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by all),
used as materialized (select c.lang, c.source, c.term, c.n from counted c join kept using (lang, term)),
groups as materialized (
  select g.lang, g.source, coalesce(u.n, 0)::hugeint as n from (select distinct lang, source from docs) g
  left join (select lang, source, sum(n)::hugeint as n from used group by all) u using (lang, source)),
shares as materialized (
  select g.lang, g.source, k.term, coalesce(u.n, 0)::hugeint as c, 1::hugeint + {UNIT}::hugeint * (coalesce(u.n, 0) + 1) // (g.n + s.v) as p
  from groups g join kept k using (lang) join sizes s using (lang) left join used u using (lang, source, term)),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from shares a join shares b using (lang, term) where a.source <> b.source group by all),
apart as (
  select h.lang, h.source, h.term as item, (h.p - q) * (h.p - q) // q as value
  from shares h join (select k.lang, k.term, 1::hugeint + {UNIT}::hugeint * (k.n + 1) // (s.n + s.v) as q from kept k join sizes s using (lang)) using (lang, term)
  where c > 0 and h.p > q),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all select lang, source, 'term', item, value from apart),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}
"""
