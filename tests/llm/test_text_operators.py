"""Mixing, substrings, Jaccard join, decontamination and token ids against brute force on tricky rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import decontaminate, jaccard, mixing, substrings, tokens, wordhash

from .conftest import SCHEMA, prose, tricky_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return WORD.findall(text or "")


# --- substrings ---------------------------------------------------------------------------------


def removed_words(rows, size):
    """(n_words, kept) per row: windows that start earlier, by doc_id and place, are removed; one id is one place."""
    first = {}
    order = lambda d: -1 if d is None else d
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - size + 1):
            at = (order(doc), i)
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, at), at)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (order(doc), i):
                gone.update(range(i, i + size))
        out.append((doc, len(w), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("size", [20, 8])
def test_substrings_equal_brute_force(crowded, size):
    rows = [r[:2] for r in tricky_rows()]
    got = substrings.deduplicate(crowded, size).collect()
    assert Counter((r["doc_id"], r["n_words"], r["kept"]) for r in got) == Counter(removed_words(rows, size))
    assert all(r["n_removed"] == r["n_words"] - len(words(r["kept"])) for r in got)


def test_substrings_on_random_repeats(spark):
    rng = random.Random(3)
    pool = [prose(100 + i, 25) for i in range(6)]
    rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.6 else prose(1000 * i + k, 9) for k in range(6))) for i in range(40)]
    rows += [(100 + i, "a b " * 30) for i in range(3)]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((r["doc_id"], r["n_words"], r["kept"]) for r in got.collect()) == sorted(removed_words(rows, 20))


def test_substring_spans_name_their_source(spark):
    shared = prose(7, 30)
    docs = spark.createDataFrame([(1, f"x y {shared} z", 11), (2, f"{shared} q", 22)], "doc_id long, text string, text_id long")
    spans = substrings.repeated_spans(docs, docs.select("doc_id", "text_id")).collect()
    assert [(s["doc_id"], s["start"], s["n_words"], s["source"]) for s in spans] == [(2, 0, 30, 1)]


@pytest.mark.parametrize("size", [128, 256, 1024, 4096])
def test_long_words_that_differ_are_not_equal(spark, size):
    """The Thue-Morse word and its complement collide in every sum of byte times power modulo 2**64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
    pair = [a, a.translate(str.maketrans("ab", "ba"))]
    hashes = wordhash.words(pa.array(pair)).hashes
    assert hashes[0] != hashes[1]
    rest = " ".join(f"w{i}" for i in range(19))
    frame = spark.createDataFrame([(i, f"{rest} {w}", None, None, 0) for i, w in enumerate(pair)], SCHEMA)
    assert {r["n_removed"] for r in substrings.deduplicate(frame).collect()} == {0}


def test_copies_of_a_text_do_not_fill_one_buffer(spark, monkeypatch):
    plans, write = [], substrings.materialize
    monkeypatch.setattr(substrings, "materialize", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, *a))[1])
    base = prose(8, 60)
    rows = [(i, base) for i in range(300)] + [(1000, f"{prose(9, 30)} {base}"), (1001, prose(10, 50))]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["kept"]) for r in got) == sorted(removed_words(rows, 20))
    assert any("collect_set(anchor" in p for p in plans) and not any("collect_list(anchor" in p for p in plans)


def test_substrings_of_nothing(no_documents):
    assert substrings.deduplicate(no_documents).collect() == []


# --- Jaccard join -------------------------------------------------------------------------------


def classes(rows):
    """(doc_id, class_id, n_links) by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    order = lambda d: -1 if d is None else d
    group, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    least = {g: min((order(rows[i][0]) for i in range(len(rows)) if group[i] == g)) for g in set(group)}
    return Counter((rows[i][0], None if least[group[i]] == -1 else least[group[i]], links[i]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [512, 2])
def test_jaccard_equals_brute_force(crowded, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = jaccard.near_duplicates(crowded).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == classes([r[:2] for r in tricky_rows()])


@pytest.mark.parametrize("unit", [8192, 400])
def test_jaccard_loses_no_link_of_a_large_group(spark, monkeypatch, unit):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "UNIT", unit)
    rng = random.Random(5)
    base, rows = prose(50, 150).split(), []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == classes(rows)


def test_one_document_of_each_class_stays(crowded):
    kept = jaccard.representatives(crowded)
    assert kept.columns == crowded.columns
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert ids == Counter([1, 4, 5, 6, 7, 8, 9, 10, 12, 12, None, 15, 16, 17])


def test_bands_are_as_long_as_the_recall_allows():
    assert jaccard.depth_for(0.8, 0.9999) == 6 and jaccard.depth_for(0.8, 0.5) > 6
    assert 1 - (1 - 0.8**6) ** jaccard.TREES >= 0.9999


def test_jaccard_of_nothing(no_documents):
    assert jaccard.near_duplicates(no_documents).collect() == []
    assert jaccard.representatives(no_documents).collect() == []


# --- decontamination ----------------------------------------------------------------------------


def plain(text):
    return [w for w in (re.sub(r"[\W_]+", "", x.lower()) for x in words(text)) if w]


def fewest_edits(item, doc):
    row = [0] * (len(doc) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(300 + i, n)) for i, n in enumerate([6, 10, 15, 30, 45, 70])] + [(90, None), (91, ""), (92, "too short"), (93, prose(303, 30))]
    docs = []
    for k in range(60):
        item = rng.choice(items[:6])[1].split()
        for _ in range(rng.randrange(0, 8)):
            at = rng.randrange(len(item))
            item[at : at + rng.randrange(0, 2)] = [f"odd{rng.randrange(999)}"] * rng.randrange(0, 2)
        text = f"{prose(k, 20)} {' '.join(item)} {prose(k + 500, 20)}"
        docs.append((k, text.upper() if k % 5 == 0 else text.replace(" ", "!! ") if k % 7 == 0 else text))
    docs += [(100, None), (101, ""), (102, " ".join(["lo"] * 3000))]
    want = set()
    for doc, text in docs:
        for item, other in items:
            w = plain(other)
            if len(w) >= 5 and (edits := fewest_edits(w, plain(text))) <= int(0.1 * len(w)):
                want.add((doc, item, edits))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 3):
        got = decontaminate.contaminated(frame.repartition(3), bench, block_items=block).collect()
        assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in got) == Counter(want)
    clean = decontaminate.clean(frame.withColumn("at", F.lit(1)), bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _, _ in want} and clean.columns == ["doc_id", "text", "at"]


def test_short_items_and_scripts_without_spaces(spark):
    rng = random.Random(4)
    long = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(40))
    thai = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(12))
    items = [(1, long + "。"), (2, "two words"), (3, thai), (4, "日本"), (5, "!!"), (6, prose(3, 20))]
    docs = [(1, f"前文{long}后文"), (2, f"文{long[:10]}错{long[11:20]}{long[21:]}"), (3, f"{long[:8]}错错错错错{long[13:]}"), (4, "here are Two words."), (5, "two, other words; swords two"), (6, f"ก{thai}ก"), (7, "一日\n本一"), (8, None)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"], r["budget"]) for r in got} == {(1, 1, 0, 4), (2, 1, 2, 4), (4, 2, 0, 0), (6, 3, 0, 1), (7, 4, 0, 0)} and len(got) == 5


def test_myers_distance():
    rng = random.Random(1)
    for _ in range(50):
        p, t = ([rng.randrange(3) for _ in range(rng.randrange(1, n))] for n in (80, 60))
        assert min(decontaminate.myers(p, t), default=len(p)) >= fewest_edits(p, t) >= 0
        if t:
            assert min(min(decontaminate.myers(p, t)), len(p)) == fewest_edits(p, t)


def test_decontamination_of_nothing(crowded, no_documents, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(crowded, none).collect() == []
    assert decontaminate.clean(crowded, none).count() == len(tricky_rows())
    assert decontaminate.contaminated(no_documents, spark.createDataFrame([(1, prose(1, 20))], "item_id long, text string")).collect() == []


# --- token ids ----------------------------------------------------------------------------------

ODD = ["ÅB,́c it's 'tis x,'s a…, b", "HEED!! (X)y#z", "x <|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "ΣΑΣ Σας", "日本 語 1234 a1b2"]


def test_words_encode_like_texts():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = [r[1] or "" for r in tricky_rows()] + ODD
    assert tokens.encode_by_words(TOKENIZER, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert len(tokens.encode_by_words(TOKENIZER, [])) <= 1 and other


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_chunks_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert (tokens.unpack(tokens.pack(ids, bits)) == ids).all()
    with pytest.raises(ValueError):
        tokens.unpack(b"something else")


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_round_trip(spark, crowded, monkeypatch, bits):
    monkeypatch.setattr(tokens, "BLOCK", 1 << 10)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in tricky_rows()))
    want, at = [], 0
    for known, doc, text in rows:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, tokens.END_ID], "<u4")
        want.append((doc if known else None, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = tokens.tokens(spark, crowded, TOKENIZER, bits=bits, partitions=3).orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_token_files_of_nothing(spark, no_documents):
    assert tokens.tokens(spark, no_documents, TOKENIZER).collect() == []


# --- mixing -------------------------------------------------------------------------------------


def levels(sizes, weights, share, epochs):
    """Water-filling in rounds: clamp what is above its cap, share the rest again."""
    cap, target, open_ = {s: epochs * n for s, n in sizes.items()}, {}, set(sizes)
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] >= cap[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: float(cap[s]) for s in over}
        left -= sum(cap[s] for s in over)
        open_ -= over
    return target


def test_mixing_meets_its_targets(crowded):
    sizes = Counter()
    for _, text, _, source, _ in tricky_rows():
        sizes[source] += len(words(text))
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = levels(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(ordered)}, 1.5, 2)
    got = mixing.mix(crowded).collect()
    assert len(got) == len(tricky_rows())
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["copies"] in (0, 1, 2) and r["size"] == len(words(r["text"]))
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = Counter((r["doc_id"], r["text"], r["copies"]) for r in mixing.mix(crowded.repartition(5)).collect())
    assert again == Counter((r["doc_id"], r["text"], r["copies"]) for r in got)
    rows = mixing.mixed(crowded)
    assert rows.columns == crowded.columns and rows.count() == sum(r["copies"] for r in got)


def test_mixing_comes_near_every_target(spark):
    rows = [(i, prose(i, 20 + i % 50), f"s{min(i % 11, 4)}") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    for r in got.collect():
        assert abs(r["taken"] - r["target"]) <= 70


def test_mixing_of_nothing(no_documents, spark):
    assert mixing.mix(no_documents).collect() == []
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["target"], r["copies"] * r["size"]) for r in mixing.mix(empty).collect()} == {(0.0, 0)}


def test_kept_text_digests(crowded):
    got = substrings.deduplicate(crowded, of=lambda t: F.sha2(t, 256))
    whole = {(r["doc_id"], hashlib.sha256((r["kept"] or "").encode()).hexdigest()) for r in substrings.deduplicate(crowded).collect()}
    assert {(r["doc_id"], r["kept"]) for r in got.collect()} == whole


assert SCHEMA
