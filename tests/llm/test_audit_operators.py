"""Toxicity, source divergence and vector codes against brute force and labelled rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import divergence, lloyd, toxicity

from .conftest import SCHEMA, WORDS, prose, tricky_rows

# --- toxicity -----------------------------------------------------------------------------------

INSULTS = ["zumpkin", "drogface", "wexhole", "mugbrain"]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def rated(spark):
    """600 documents, a sixth of them with insults from a list or of a family of endings; the last 200 are not labelled."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        words, toxic = prose(1000 + i, rng.randrange(20, 120)).split(), i % 6 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            bad = rng.choice(INSULTS) if i % 12 else "blorf" + rng.choice(WORDS)
            words.insert(rng.randrange(len(words)), bad)
        rows.append((i, ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)), "en", "a", 0))
        if i < 400:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    return docs, model


def test_unlabelled_documents_are_told_apart(rated):
    docs, model = rated
    out = toxicity.rate(docs.filter("doc_id >= 400"), model).collect()
    found = {r["doc_id"]: r["score"] >= toxicity.THRESHOLD for r in out}
    toxic = [i for i in found if i % 6 == 0]
    assert sum(found[i] for i in toxic) >= 0.95 * len(toxic)
    assert sum(found[i] for i in found if i % 6) <= 0.01 * len(found)


def test_gaps_signs_and_inserted_letters_are_tolerated(rated):
    _, model = rated
    hidden = ["so z u m p k i n there", "so w.e.x.h.o.l.e there", "so mug-brain there", "so DROGFÁCE there", "so drogxface there", "so mugbxrain there", "so zumqpkin there"]
    plain = toxicity.score(model, pa.array(["", "karaloring", "so so there", prose(77, 400)]))
    assert (toxicity.score(model, pa.array(hidden)) > 0.5).sum() >= 6
    assert (plain < 0.3).all()


def test_toxic_sentences(rated, spark):
    _, model = rated
    docs = spark.createDataFrame([(1, "karaloring miratve. You wexhole there! nerasu.", "en", "a", 1), (2, None, "en", "a", 1)], SCHEMA)
    assert [(r["doc_id"], r["sentence"], r["text"]) for r in toxicity.toxic_sentences(docs, model, 0.5).collect()] == [(1, 1, "You wexhole there!")]


def test_units_are_runs_joined_tokens_and_spelled_words():
    def names(text):
        keys, _ = toxicity.units(pa.array([text]))
        code = [[int(k) >> 5 * i & 31 for i in range(toxicity.LONGEST)] for k in keys]
        return Counter("".join("|" if c == 31 else chr(96 + c) for c in row if c) for row in code)

    assert names("Éa don't i d i o t") == Counter(["|don|", "|dont|", "|tidiot|"])  # single letters go on over words
    assert names("abc​def") == Counter(["|abc|", "|def|", "|abcdef|"])
    windows = names("abcdefghijklmnopq")
    assert set(windows) == {"|abcdefghijk", "defghijklmno", "ghijklmnopq|"} | {w for w in windows if len(w) == 12}
    assert names("") == names("a b") == names("12 ... !") == Counter()


def test_folded_weights_equal_the_kernel():
    """A machine's value by triples equals the sum over landmarks of kernel values."""
    keys, _ = toxicity.units(pa.array([prose(5, 300)]))
    keys = np.unique(keys)
    x = toxicity.features(keys).astype(float)
    kernel = x[:40] @ x[40:].T
    part = np.random.default_rng(1).normal(size=40)
    weights = x[:40].T @ part
    assert np.allclose(toxicity.margins(keys[40:], weights, 0.25), part @ kernel + 0.25, atol=1e-4)


def test_toxicity_of_nothing(spark, rated, crowded, no_documents):
    _, model = rated
    none = spark.createDataFrame([], LABELS)
    empty = toxicity.fit(no_documents, none)
    assert toxicity.rate(no_documents, model).count() == 0
    assert {r["score"] for r in toxicity.rate(crowded, empty).collect()} == {0.0}
    out = toxicity.rate(crowded, model)
    assert out.columns == [c for c in crowded.columns if c != "score"] + ["score"] and out.count() == crowded.count()
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    odd = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 7), (None, 1, 1), (9, 1, 0)], LABELS)
    assert toxicity.fit(crowded, odd).weights is None


# --- divergence ---------------------------------------------------------------------------------


def brute_audit(rows):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, docs, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        found = Counter(term.findall((text or "").translate(lower)))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    for lang in {g[0] for g in counts}:
        kept = [t for t, d in docs[lang].items() if d >= 3]
        groups = sorted(g[1] for g in counts if g[0] == lang)
        of = {s: counts[lang, s] for s in groups}
        whole = Counter()
        for c in of.values():
            whole.update(c)

        def p(c, lang_kept=kept):
            n = sum(c[t] for t in lang_kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(lang_kept)) for t in lang_kept}

        shares, q = {s: p(c) for s, c in of.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pair = [(sum(f(shares[s][t], shares[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(shares[s][t], q[t]), t) for t in kept if of[s][t] and shares[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(items, 1) if part == "pair" or k <= 200]
    return sorted(out)


def audited(frame, **options):
    return sorted(tuple(r) for r in divergence.audit(frame, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("small", [False, True])
def test_audit_equals_brute_force(spark, monkeypatch, small):
    rng = random.Random(3)
    rows = [(r[1], r[2], r[3]) for r in tricky_rows()]
    for i in range(400):
        words = prose(i, rng.randrange(0, 60)).split() + [rng.choice(["Ärger", "é́", "日本語", "X" + WORDS[i % 40]]) for _ in range(4)]
        rows.append((" ".join(words), rng.choice(["en", "en", "de", None]), f"s{int(rng.random() ** 3 * 9)}"))
    rows += [("zzz zzz", "xx", "only"), (None, "yy", "a"), (None, "yy", "b")]
    if small:
        monkeypatch.setattr(divergence, "CHUNK", 2000)
        monkeypatch.setattr(divergence, "POSTINGS", 40)
        monkeypatch.setattr(divergence, "CELLS", 25)
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert audited(frame) == brute_audit(rows)


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 10**10, 5 * 10**17])
    got = divergence.shares(counts, np.array([10**18] * 3), 12345)
    assert got.tolist() == [1 + 10**9 * (c + 1) // (10**18 + 12345) for c in counts.tolist()]


def test_audit_of_nothing(no_documents, crowded):
    assert audited(no_documents) == []
    assert audited(crowded) == brute_audit([(r[1], r[2], r[3]) for r in tricky_rows()])


# --- vector codes -------------------------------------------------------------------------------


def brute_codes(rows):
    """(vec_id, vector) rows to (code, error) in their order, and the digest."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v in kept), default=0) // 8)
    cut = []
    for _, v in kept:
        q = [math.floor(4096 * x) for x in v] + [0] * (8 * width - len(v))
        cut.append([tuple(q[p * width : (p + 1) * width]) for p in range(8)])
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], kept[k][1]))[:16]
    books = [[list(cut[k][p]) for k in first] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(6):
        for p in range(8):
            members = defaultdict(list)
            for parts in cut:
                members[near(parts[p], books[p])].append(parts[p])
            for e, parts in members.items():
                books[p][e] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    out = []
    for (i, _), parts in zip(kept, cut, strict=True):
        entries = [near(parts[p], books[p]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for e in entries), sum(far(parts[p], books[p][e]) for p, e in enumerate(entries))))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(out, key=repr), digest


def coded(frame):
    books = lloyd.fit(frame)
    out = lloyd.encode(frame, books).select("vec_id", "code", "error").collect()
    return sorted((tuple(r) for r in out), key=repr), lloyd.digest(books)


@pytest.mark.parametrize("owned", [1000, 7])
def test_codes_equal_brute_force(spark, monkeypatch, owned):
    monkeypatch.setattr(lloyd, "OWNED", owned)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.3) for _ in range(19)] for _ in range(25)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third of all in one place
    rows += [(3, rows[5][1]), (None, rows[6][1]), (5000, None), (5001, [None] * 19), (5002, [float("nan")] * 19), (5003, [float("inf")] + [0.0] * 18), (5004, [1.0, -1.0]), (5005, [])]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert coded(frame) == brute_codes(rows)


def test_only_parts_that_change_entry_are_dealt_again(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(i % 5, 0.01) for _ in range(16)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    book = np.ascontiguousarray(lloyd.whole_numbers(pa.array([r[1] for r in rows[:16]]), 2).transpose(1, 0, 2))
    first = lloyd._first_members(frame, "embedding", book, 1).cache()
    books = [book, lloyd._updated(first, book)]
    second = lloyd._next_members([first], books, 1)
    moved = second.filter("member").count()
    parts = lloyd.whole_numbers(pa.array([r[1] for r in rows]), 2)
    want = sum(int((lloyd.nearest(parts[:, p], books[0][p])[0] != lloyd.nearest(parts[:, p], books[1][p])[0]).sum()) for p in range(8))
    assert moved == want < 1600
    assert second.agg(F.sum("n")).first()[0] == 1600  # kept, as sums, and moved


def test_codes_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, since int"
    assert coded(spark.createDataFrame([], schema))[0] == []
    assert coded(spark.createDataFrame([(1, None, 1, "x", 2)], schema))[0] == []
    out = lloyd.encode(spark.createDataFrame([(1, [0.5] * 8, 1, "x", 2)], schema), np.zeros((8, 1, 1), np.int64))
    assert out.columns == ["vec_id", "embedding", "label", "since", "code", "error"]
    assert out.first()["error"] == 8 * 2048**2
    with pytest.raises(OverflowError):
        lloyd.whole_numbers(pa.array([[1e30]]), 1)
