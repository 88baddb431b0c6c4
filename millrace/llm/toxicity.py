"""Toxicity by a support vector machine over a subsequence string kernel with Nystrom landmarks.

Units. A text is cut into runs of letters, folded to lower case without accents. Besides the runs, the letters of a token that signs or
digits cut apart (``id-iot``, ``l0s3r``) and of single letters in a row (``i d i o t``) are joined; what is longer than ``LONGEST``
letters is looked at in overlapping windows. A mark before the first and after the last letter counts as a letter.

Kernel. Two units are compared by the letter triples they share as subsequences; every letter skipped within a triple costs a
factor ``DECAY``, up to ``REACH`` letters in all, so inserted and left-out letters lower the value but don't end it. Values
are divided by the norm of a unit of that length.

Machine. Units map to their kernel values with a few hundred landmark units, times the inverse root of the landmarks' own kernel
matrix (Nystrom); there a linear machine with squared hinge loss is fitted. Its training rows are labelled sentences: all sentences
of clean documents are clean, and of a toxic document those with a unit above the margin are toxic. As only the documents are labelled,
the choice is made anew after each fit, starting from units with four letters that toxic documents' sentences hold significantly more often. A
sentence is as toxic as its worst unit, a document as its worst sentence. Documents left out of the fit calibrate the score (Platt).

As the kernel is a product over triples, landmarks and weights fold into one weight per triple. Scoring looks these
up, for each distinct unit of a batch once, and needs neither a shuffle nor a landmark.

``fit`` learns from at most about ``train_docs`` toxic and twice as many clean labelled documents with at most ``train_chars`` characters (all of them
where there are fewer; picked by a hash of the id). That bounds what comes to the driver; every text is scored whole.

Defined cases: a text that is null, empty or has no unit scores as a text of clean units does at best, near 0; without documents of both
classes every score is 0; labels other than 0 and 1, and ids with both, are not learned from; repeated rows score alike; other columns
pass through, and columns of the added names are replaced.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents
from .wordhash import slices

DECAY = 0.7
REACH = 6
LONGEST = 12
STRIDE = 4
#: Codes of characters: 1 to 30 are letters, 31 stands before the first and after the last letter of a unit.
EDGE, SPACE, ACCENT = 31, 32, 33
N_TRIPLES = 1 << 15
THRESHOLD = 0.7
#: Weight of all clean units in the fit, with that of the toxic ones as 1: a document has many units, and any of them could give it away.
CLEAN_WEIGHT = 60.0
#: Disguised copies of each toxic unit in the fit.
VARIANTS = 10
#: Standard errors by which toxic documents' sentences must hold four letters more often for units with them to be taken as toxic at first:
#: chance exceeds it in few of a hundred thousand, so toxic labels on texts without a sign of it are left aside.
SIGNIFICANT = 4.0
#: How many times as many of their sentences must hold it.
ODDS = 10.0
#: Where a sentence ends.
SENTENCE = r"(?<=[.!?…。！？])\s+|\n+"


@dataclass
class Machine:
    """A weight per letter triple, the offset, and the calibration's slope and offset; no weights without labels."""

    weights: np.ndarray | None
    offset: float
    slope: float
    shift: float


@cache
def alphabet() -> np.ndarray:
    """Code of each code point: a to z are 1 to 26 whatever their case and accents, other letters share 27 to 30."""
    codes = np.zeros(0x110000, np.uint8)
    codes[0x3040:0x1F000] = codes[0x20000:] = 1
    codes[0xD800:0xE000] = codes[0xE000:0xF900] = codes[0xFE00:0xFE10] = 0
    codes[codes == 1] = 27 + np.flatnonzero(codes) % 4
    for point in (*range(0x3000), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)):
        base = unicodedata.normalize("NFKD", chr(point)).lower()[:1]
        codes[point] = SPACE if base.isspace() else 1 + ord(base) - ord("a") if "a" <= base <= "z" else 27 + point % 4 if base.isalpha() else 0
        if unicodedata.combining(chr(point)):
            codes[point] = ACCENT  # of its own: no letter and no gap
    return codes


def _slices(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of at most LONGEST of the slices, and the slice of each."""
    size = end - begin
    n = 1 + np.maximum(-(-(size - LONGEST) // STRIDE), 0)
    of = np.repeat(np.arange(len(begin)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    first = np.minimum(begin[of] + STRIDE * nth, np.maximum(end[of] - LONGEST, begin[of]))
    return first, np.minimum(end[of], first + LONGEST), of


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Packed units (5 bits a letter) of the texts, in any order, and the text of each."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
    whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts), pa.scalar("\n", pa.large_string()))
    points = np.frombuffer(whole[0].as_py().encode("utf-32-le"), np.uint32)
    codes = alphabet()[points]
    ends = np.cumsum(sizes + 1) - 1  # places of the line feeds between texts
    plain = codes != ACCENT
    codes, ends = codes[plain], ends - np.concatenate([[0], np.cumsum(~plain)])[np.minimum(ends, len(plain))]
    letter = (codes > 0) & (codes < SPACE)
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    place = np.concatenate([[0], np.cumsum(letter)])
    begin = np.flatnonzero(starts)
    stops = letter.copy()
    stops[:-1] &= ~letter[1:]
    stop = np.flatnonzero(stops) + 1
    text = np.searchsorted(ends, begin, side="right")
    token = np.cumsum(codes == SPACE)[begin]
    a, b = place[begin], place[stop]
    joined = np.zeros(len(a), bool)  # a run that goes on with the run before it
    joined[1:] = (token[1:] == token[:-1]) & (text[1:] == text[:-1])
    single = b - a == 1
    spelled = np.zeros(len(a), bool)
    spelled[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    pieces = [(a, b, text)]
    for chain in (joined, spelled):
        head = np.flatnonzero(~chain)
        last = np.append(head[1:], len(chain)) - 1 if len(head) else head
        many = last > head
        pieces.append((a[head[many]], b[last[many]], text[head[many]]))
    a, b, text = (np.concatenate(c) for c in zip(*pieces, strict=True))
    long = b - a >= 3
    begin, end, text = a[long], b[long] + 2, text[long]  # with a place for each edge
    a, b, of = _slices(begin, end)
    held = np.concatenate([codes[letter], np.zeros(LONGEST + 2, np.uint8)])
    keys = np.zeros(len(a), np.uint64)
    for i in range(LONGEST):
        at = a + i
        code = np.where((at == begin[of]) | (at == end[of] - 1), EDGE, held[at - 1])
        keys |= np.where(at < b, code, 0).astype(np.uint64) << np.uint64(5 * i)
    return keys, text[of]


def triples(keys: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each way to take three letters: the triples (0 where the unit ends before) and their weight."""
    letters = [((keys >> np.uint64(5 * i)) & np.uint64(31)).astype(np.int32) for i in range(LONGEST)]
    for i in range(LONGEST - 2):
        for j, k in itertools.combinations(range(i + 1, min(i + REACH, LONGEST)), 2):
            last = letters[k]
            yield np.where(last > 0, letters[i] << 10 | letters[j] << 5 | last, 0), DECAY ** (k - i - 2)


@cache
def _norms() -> np.ndarray:
    """Norm of a unit by its length, as if its triples all differed."""
    out = np.ones(LONGEST + 1)
    for size in range(3, LONGEST + 1):
        ways = ((k - i - 2) for i in range(size) for j in range(i + 1, size) for k in range(j + 1, size) if k - i < REACH)
        out[size] = np.sqrt(sum(DECAY ** (2 * gap) for gap in ways))
    return out


def norms(keys: np.ndarray) -> np.ndarray:
    size = np.zeros(len(keys), np.int64)
    for i in range(LONGEST):
        size += ((keys >> np.uint64(5 * i)) & np.uint64(31)) > 0
    return _norms()[size]


def margins(keys: np.ndarray, weights: np.ndarray, offset: float) -> np.ndarray:
    """Value of the machine for each unit."""
    total = np.zeros(len(keys))
    for triple, weight in triples(keys):
        total += weight * weights[triple]
    return total / norms(keys) + offset


def features(keys: np.ndarray) -> np.ndarray:
    """The units as rows of triple weights over their norm: (units, N_TRIPLES)."""
    out = np.zeros((len(keys), N_TRIPLES), np.float32)
    rows = np.arange(len(keys))
    for triple, weight in triples(keys):
        np.add.at(out, (rows, triple), weight)
    out[:, 0] = 0
    return out / norms(keys)[:, None].astype(np.float32)


def _linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps; the last column of x is the offset."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        active = y * (x @ w) < 1
        xa = x[active]
        left = xa.T @ (xa * weight[active, None]) + ridge * np.eye(x.shape[1])
        new = np.linalg.solve(left, xa.T @ (weight[active] * y[active]))
        done = np.allclose(new, w, atol=1e-6)
        w = new
        if done:
            break
    return w


def disguised(keys: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The units with one letter put in at a place and of a kind drawn at random, between the edges."""
    size = sum((((keys >> np.uint64(5 * i)) & np.uint64(31)) > 0).astype(np.int64) for i in range(LONGEST))
    keys, size = keys[(size < LONGEST) & (size > 5)], size[(size < LONGEST) & (size > 5)]
    at = np.uint64(5) * rng.integers(2, size - 1).astype(np.uint64) if len(keys) else keys
    low = (np.uint64(1) << at) - np.uint64(1)
    return (keys & low) | (rng.integers(1, 27, len(keys)).astype(np.uint64) << at) | ((keys & ~low) << np.uint64(5))


def _machine(landmarks: np.ndarray, positive: np.ndarray, times: np.ndarray, negative: np.ndarray, often: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Triple weights and offset of a machine fitted in the landmarks' Nystrom space."""
    basis = features(landmarks)
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    good = values > 1e-5 * values.max()
    to_space = basis.T @ (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)  # triples to Nystrom features
    keys = np.concatenate([positive, negative])
    to_space[0] = 0
    x = np.ones((len(keys), to_space.shape[1] + 1))
    for part in np.array_split(np.arange(len(keys)), len(keys) // 2000 + 1):
        x[part, :-1] = sum(np.float32(weight) * to_space[triple] for triple, weight in triples(keys[part])) / norms(keys[part])[:, None]
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    weight = np.concatenate([times / times.sum(), CLEAN_WEIGHT * often / often.sum()])
    w = _linear(x, y, weight, ridge)
    return to_space @ w[:-1], float(w[-1])


def pieces(keys: np.ndarray) -> list[np.ndarray]:
    """Each unit's first, second, ... four letters in a row, 0 where it ends before."""
    cut = [((keys >> np.uint64(5 * i)) & np.uint64(0xFFFFF)).astype(np.int64) for i in range(LONGEST - 3)]
    return [np.where(piece >> 15 > 0, piece, 0) for piece in cut]


def _best(at: np.ndarray, value: np.ndarray, n: int, least: float) -> np.ndarray:
    out = np.full(n, least)
    np.maximum.at(out, at, value)
    return out


def _platt(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the score 1 / (1 + exp(-(slope * margin + offset))) by Newton steps, classes weighing alike."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    goal = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(toxic, 0.5 / max(n1, 1), 0.5 / max(n0, 1))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        left = x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-4 * np.eye(2)
        step = np.linalg.solve(left, x.T @ (weight * (goal - p)) - 1e-4 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def train(
    toxic: tuple[np.ndarray, np.ndarray, np.ndarray], clean: tuple[np.ndarray, np.ndarray, np.ndarray], landmarks: int = 256, rounds: int = 6, ridge: float = 3e-4, seed: int = 7
) -> Machine:
    """From the (document, sentence, unit) rows of toxic and of clean documents; equal sentences have equal numbers."""
    rng = np.random.default_rng(seed)
    names, at = np.unique(np.concatenate([toxic[2], clean[2]]), return_inverse=True)
    at1, at0 = at[: len(toxic[2])], at[len(toxic[2]) :]
    (docs1, doc1), (docs0, doc0) = (np.unique(side[0], return_inverse=True) for side in (toxic, clean))
    fit1, fit0 = docs1 % 4 > 0, docs0 % 4 > 0  # a quarter of the documents calibrates
    n_names, sentence1 = len(names), np.unique(toxic[1], return_inverse=True)[1]
    cut = pieces(names)
    held, n = [], []
    for row_doc, sentence, row_at, fitted in ((doc1, toxic[1], at1, fit1), (doc0, clean[1], at0, fit0)):
        row = np.flatnonzero(fitted[row_doc])
        _, sentence = np.unique(sentence[row], return_inverse=True)
        some = np.unique(np.concatenate([sentence << 20 | piece[row_at[row]] for piece in cut]))
        held.append(np.bincount(some & 0xFFFFF, minlength=1 << 20))
        n.append(max(int(sentence.max(initial=0)) + 1, 1))
    share = (held[0] + held[1]) / sum(n)
    excess = (held[0] - n[0] * share) / np.sqrt(n[0] * share * (1 - share) + 1)  # by how many errors toxic sentences hold a piece more often
    excess[(held[0] / n[0] < ODDS * (held[1] + 1) / n[1]) | (np.arange(len(excess)) == 0)] = -np.inf
    value = np.max([excess[piece] for piece in cut], axis=0)
    held0 = np.bincount(at0[fit0[doc0]], minlength=n_names)
    negative = np.flatnonzero(held0)
    weights, offset, chosen = np.zeros(N_TRIPLES), 0.0, None
    least = min(SIGNIFICANT, value.max() / 2)
    for _ in range(rounds):
        rows = np.flatnonzero(fit1[doc1] & (value[at1] > least))  # toxic sentences, by the units that make them so
        found = np.unique(sentence1[rows] * n_names + at1[rows])
        positive, times = np.unique(found % n_names, return_counts=True)
        times = np.sqrt(times)
        if not len(positive) or (chosen is not None and np.array_equal(chosen, positive)):
            break
        chosen = positive
        hard = negative[np.argsort(-value[negative], kind="stable")[:6000]]
        others = np.unique(np.concatenate([hard, rng.choice(negative, min(len(negative), 6000), replace=False)]))
        common = positive[np.argsort(-times, kind="stable")[: landmarks // 2]]
        marks = np.unique(np.concatenate([common, rng.choice(others, min(len(others), landmarks - len(common)), replace=False)]))
        variants = disguised(np.repeat(names[positive], VARIANTS), rng)
        shown, weight = np.concatenate([names[positive], variants]), np.concatenate([times / times.sum(), np.full(len(variants), 1 / max(len(variants), 1))])
        weights, offset = _machine(names[marks], shown, weight, names[others], np.sqrt(held0[others]), ridge)
        value, least = margins(names, weights, offset), 0.0
    quiet = min(offset, -1.0)
    top1, top0 = _best(doc1, value[at1], len(docs1), quiet), _best(doc0, value[at0], len(docs0), quiet)
    toxic_rows = np.concatenate([np.ones((~fit1).sum(), bool), np.zeros((~fit0).sum(), bool)])
    slope, shift = _platt(np.concatenate([top1[~fit1], top0[~fit0]]), toxic_rows)
    return Machine(weights, offset, slope, shift)


def score(model: Machine, texts: pa.Array) -> np.ndarray:
    """Score of each text, 0 to 1."""
    if model.weights is None:
        return np.zeros(len(texts))
    keys, text = units(texts)
    names, at = np.unique(keys, return_inverse=True)
    top = _best(text, margins(names, model.weights, model.offset)[at], len(texts), min(model.offset, -1.0))
    return 1 / (1 + np.exp(-np.clip(model.slope * top + model.shift, -500, 500)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 1500, train_chars: int = 20_000, label: str = "toxic") -> Machine:
    """Learn from the labelled documents: (doc_id, text) and (doc_id, ``label`` 0 or 1)."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Machine(None, 0.0, 0.0, 0.0)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("y") == 1, min(1.0, train_docs / sizes[1])).otherwise(min(1.0, 2 * train_docs / sizes[0]))
    sample = known.filter(place < share).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top")
    texts = docs.select("doc_id", "text").filter(F.length("text") <= train_chars).join(F.broadcast(sample), "doc_id")  # about 3 train_docs rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, text = units(batch.column("text"))
            names = ["doc", "y", "sentence"]
            columns = [batch.column(c).take(pa.array(text)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys.view(np.int64))], [*names, "unit"])

    doc = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("doc")
    sentences = texts.select(doc, "y", F.explode(F.split("text", SENTENCE)).alias("text")).withColumn("sentence", F.xxhash64("text"))
    rows = sentences.mapInArrow(cut, "doc long, y int, sentence long, unit long").distinct()
    sides = []
    for y in (1, 0):  # units of so many texts of at most train_chars characters
        table = rows.filter(F.col("y") == y).drop("y").toArrow()
        doc, sentence, unit = (table.column(c).to_numpy() for c in ("doc", "sentence", "unit"))
        order = np.lexsort((unit, sentence, doc))
        sides.append((doc[order], sentence[order], unit[order].view(np.uint64)))
        del table
    if not len(sides[0][0]) or not len(sides[1][0]):
        return Machine(None, 0.0, 0.0, 0.0)
    return train(*sides)


def rate(docs: DataFrame, model: Machine, name: str = "score", column: str = "text") -> DataFrame:
    """``docs`` with the score of ``column`` under ``name``; nothing else is looked at."""
    rows = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(shared.value, batch.column(column)))], [*batch.schema.names, name])

    return rows.mapInArrow(look, schema)


def toxic_sentences(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, sentence, text, score): the sentences at or above ``threshold``, numbered from 0 in their document."""
    cut = docs.select("doc_id", F.posexplode(F.split("text", SENTENCE)).alias("sentence", "text"))
    return rate(cut, model).filter(F.col("score") >= threshold)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()))
    rated = rate(docs, model)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return rated.select("doc_id", held_out().alias("held_out"), "score", predicted)
