"""Fingerprints, the filter audit and the divergence audit against plain versions of themselves."""

import base64
import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest_rows import sorted_rows
from pyspark.sql import functions as F

from fathomlog.llm import divergence as dv
from fathomlog.llm import filter_audit as fa
from fathomlog.llm import fingerprints as fp
from fathomlog.llm import queries

# Fingerprints.


def plain_bin(window: bytes) -> int:
    """In millionths of n log2 n, as the operator reckons."""
    g = lambda n: round(n * math.log2(n) * 1e6) if n else 0
    return 1000 * (g(fp.WIDTH) - sum(g(n) for n in Counter(window).values())) // g(fp.WIDTH)


def windows_of(raw: bytes) -> list[bytes]:
    return [raw[i : i + fp.WIDTH] for i in range(len(raw) - fp.WIDTH + 1)]


def plain_ranks(texts: list[bytes]) -> list[int]:
    counted = Counter(plain_bin(w) for t in texts for w in windows_of(t))
    order = sorted(range(fp.WEAK, fp.BINS), key=lambda b: (counted[b], b))
    return [order.index(b) if b in order else -1 for b in range(fp.BINS)]


def plain_hash(feature: bytes) -> int:
    mask = (1 << 64) - 1
    h = 0x9E3779B97F4A7C15
    for j in range(0, fp.WIDTH, 8):
        h ^= int.from_bytes(feature[j : j + 8], "little")
        h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ (h >> 27)) * 0x94D049BB133111EB & mask
        h = (h ^ (h >> 31)) + 0x9E3779B97F4A7C15 & mask
    return h


def plain_fingerprint(raw: bytes, ranks: list[int]) -> list[int]:
    """Filters as integers."""
    if 0 < len(raw) < fp.WIDTH:
        features = [raw[j : j + fp.SHORT].ljust(fp.WIDTH, b"\0") for j in range(max(1, len(raw) - fp.SHORT + 1))]
    else:
        windows = windows_of(raw)
        rank = [ranks[plain_bin(w)] for w in windows]
        points = Counter()
        for s in range(len(windows) - fp.SPAN + 1):
            span = [(rank[i] if rank[i] >= 0 else fp.BINS, i) for i in range(s, s + fp.SPAN)]
            points[min(span)[1]] += 1
        features = [w for i, w in enumerate(windows) if rank[i] >= 0 and (points[i] >= fp.POINTS or len(windows) <= fp.SPAN)]
    filters, hashes = [], list(dict.fromkeys(map(plain_hash, features)))
    for at in range(0, len(hashes), fp.FILL):
        bits = 0
        for h in hashes[at : at + fp.FILL]:
            for j in range(fp.HASHES):
                bits |= 1 << (h >> 12 * j) % fp.BITS
        filters.append(bits)
    return filters


def plain_likeness(x: list[int], y: list[int]) -> float:
    if not x or not y:
        return float(len(x) == len(y))
    as_bytes = lambda f: b"".join(b.to_bytes(fp.BITS // 8, "little") for b in f)
    if (sum(b.bit_count() for b in x), as_bytes(x)) > (sum(b.bit_count() for b in y), as_bytes(y)):
        x, y = y, x
    total = 0.0
    for a in x:
        best = 0.0
        for b in y:
            most, chance = min(a.bit_count(), b.bit_count()), a.bit_count() * b.bit_count() / fp.BITS
            floor = chance + fp.SLACK * (most - chance)
            best = max(best, min(1.0, ((a & b).bit_count() - floor) / max(most - floor, 1e-9)))
        total += max(best, 0) * a.bit_count()
    return total / sum(a.bit_count() for a in x)


def as_filters(text: str) -> list[int]:
    raw = base64.b64decode(text)
    return [int.from_bytes(raw[i : i + fp.BITS // 8], "little") for i in range(0, len(raw), fp.BITS // 8)]


@pytest.mark.parametrize("buffer", [fp.BUFFER, 700])
def test_fingerprints_equal_plain_ones(spark, sf_dir, monkeypatch, buffer):
    """Of a real table; with a small buffer, long texts are worked off in pieces."""
    monkeypatch.setattr(fp, "BUFFER", buffer)
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf_dir}/documents.parquet' WHERE length(text) < 4000 ORDER BY doc_id LIMIT 40").fetchall()
    texts = [t for _, t in rows] + ["", "a", "short text", "x" * 300, "né" * 40, "The quick brown fox jumps over the lazy dog, twice."]
    raw = [t.encode() for t in texts]
    ranks = plain_ranks(raw)
    counted = fp.count_bins(raw)
    assert counted.sum() == sum(max(0, len(r) - fp.WIDTH + 1) for r in raw) and all(counted[b] == n for b, n in Counter(plain_bin(w) for t in raw for w in windows_of(t)).items())
    prints = [fp.filters_of(h) for h in fp.selected(raw, np.array(ranks))]
    plain = [plain_fingerprint(r, ranks) for r in raw]
    assert [as_filters(fp.written_as(x)) for x in prints] == plain
    assert all(np.array_equal(fp.read_from(fp.written_as(x)), x) for x in prints)
    for i, j in itertools.product(range(0, len(raw), 3), range(1, len(raw), 5)):
        assert fp.likeness(prints[i], prints[j]) == pytest.approx(plain_likeness(plain[i], plain[j]))
    assert all(fp.likeness(x, x) == 1 for x in prints)


def test_neighbours_over_tasks(spark, tricky):
    """Ids in order over several tasks, nulls first, repeated ids by their texts, the last one with the first."""
    ranks = fp.entropy_ranks(tricky)
    docs = [(r.doc_id, r.text or "", r.h) for r in tricky.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    assert ranks == plain_ranks([t.encode() for _, t, _ in docs])
    got = fp.neighbours(tricky, ranks).collect()
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[2]))
    expected = defaultdict(list)
    for (i, text, _), (_, following, _) in zip(docs, docs[1:] + docs[:1], strict=True):
        changed = fp.edited(text, following)
        seen = None
        if len(text) < 3000 > len(following):  # plain ones of long texts take long
            own, other, after = (plain_fingerprint(t.encode(), ranks) for t in (text, changed, following))
            seen = own, other, round(plain_likeness(own, other), 9), round(plain_likeness(own, after), 9)
        expected[i, len(text), hashlib.sha256(changed.encode()).hexdigest()].append(seen)
    assert len(got) == len(docs)
    for r in got:
        seen = expected[r.id, r.n_chars, r.edited_sha256].pop(0)
        if seen is not None:
            assert seen == (as_filters(r.fingerprint), as_filters(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9))
    assert fp.neighbours(tricky.where("doc_id = 3 and n_chars > 1"), ranks).count() == 1


def test_fingerprints_tell_edited_texts(spark, sf_dir):
    rows = queries.op11_fingerprints(spark, sf_dir).toPandas()
    assert rows.columns.tolist() == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert (rows.near_edited > rows.near_next).mean() > 0.97 and rows.near_edited.between(0, 1).all() and rows.near_next.between(0, 1).all()
    assert rows[rows.n_chars > 200].near_edited.min() > 0.3 and rows.near_next.median() < 0.05


# Filters.


def plain_audit(rows, names):
    """rows: (part, failed letters, good, toxic)."""
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        table = {}
        for order in itertools.permutations(names):
            left = own
            for step, letter in enumerate(order):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                table["".join(order), step + 1] = (letter, len(left), len(gone), sum(letter in r[1] for r in own) - len(gone), sum(r[1] == {letter} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone))
        shapley = Counter()
        for letter, _, removed, *_ in table.values():
            shapley[letter] += removed
        out += [(part, order, step, *v[1:], shapley[v[0]]) for (order, step), v in table.items()]
    return sorted(out)


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_filters_in_all_orders(spark, tricky, labelled):
    text = F.coalesce(F.col("text"), F.lit(""))
    filters = {"A": fa.too_few_words(text), "B": fa.repetitive(text), "C": fa.many_capitals(text), "D": fa.has_symbols(text)}
    part = F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.coalesce("lang", F.lit("")))
    docs, known = tricky.collect(), defaultdict(lambda: [0, 0])
    for r in labelled.collect():
        if r.doc_id is not None:
            known[r.doc_id] = [max(known[r.doc_id][0], int(r.quality == 1)), max(known[r.doc_id][1], int(r.toxic == 1))]
    rows = []
    for r in docs:
        t = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": r.doc_id is not None and any(o.doc_id is not None and o.doc_id < r.doc_id and (o.text or "") == t for o in docs)}
        good, toxic = known[r.doc_id] if r.doc_id is not None else (0, 0)
        rows.append(("x" if r.doc_id is not None and r.doc_id % 3 == 0 else r.lang or "", {k for k, v in tests.items() if v}, good, toxic))
    for df in (tricky, tricky.select("*", *(F.lit(1).alias(n) for n in ("id", "part", "digest", "flags", "good", "toxic", "is_first")))):
        got = fa.audit(fa.flagged(df, labelled, filters, "E", part), "ABCDE").collect()
        assert sorted(map(tuple, got)) == plain_audit(rows, "ABCDE")


def test_bitsets_of_many_parts(spark):
    rows = [(f"p{i % 37}", i * 7 % 32) for i in range(5000)]
    df = spark.createDataFrame(rows, "part string, flags int").repartition(3)
    got = {(r.part, r.subset): (r.kept, r.good, r.toxic) for r in fa.subset_counts(df, 3).collect()}
    for (part, subset), counts in got.items():
        kept = [f for p, f in rows if p == part and not f & subset]
        assert counts == (len(kept), sum(f >> 3 & 1 for f in kept), sum(f >> 4 & 1 for f in kept))
    assert len(got) == 37 * 8


def test_audits_of_nothing(spark, nothing, labelled):
    text = F.col("text")
    assert fa.audit(fa.flagged(nothing, labelled, {"A": fa.too_few_words(text)}, "E", F.col("lang")), "AE").count() == 0
    assert dv.divergence(nothing).count() == 0
    assert fp.entropy_ranks(nothing)[fp.WEAK] == 0 and fp.neighbours(nothing, fp.entropy_ranks(nothing)).count() == 0


# Divergence.


def plain_divergence(docs, least, top):
    docs = [tuple(x or "" for x in d) for d in docs]
    split = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    out = []
    for lang in {d[0] for d in docs}:
        own = [(s, split(t)) for k, s, t in docs if k == lang]
        held = Counter(w for _, t in own for w in set(t))
        kept = [w for w, n in held.items() if n >= least]
        counts = defaultdict(Counter)
        for s, t in own:
            counts[s].update(t)
            counts[None].update(t)
        shares = {s: {w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c[x] for x in kept) + len(kept)) for w in kept} for s, c in counts.items()}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in counts.keys() - {None}:
            pairs = sorted((-sum(f(shares[s][w], shares[o][w]) for w in kept), o.encode()) for o in counts.keys() - {None, s})
            terms = sorted((-f(shares[s][w], shares[None][w]), w.encode()) for w in kept if counts[s][w] and shares[s][w] > shares[None][w])
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)] + [(lang, s, "term", w.decode(), -v, i + 1) for i, (v, w) in enumerate(terms[:top])]
    return sorted_rows(out)


@pytest.mark.parametrize("held", [dv.HELD, 5])
def test_divergence_equals_a_plain_one(spark, sf_dir, monkeypatch, tricky, held):
    monkeypatch.setattr(dv, "HELD", held)
    monkeypatch.setattr(dv, "PIECE", 50)
    rows = duckdb.sql(f"SELECT lang, source, text FROM '{sf_dir}/documents.parquet' WHERE doc_id < 60").fetchall()
    rows += [("en", "src1", None), ("en", "bare", "123 !!"), (None, None, "one two"), ("zz", "p", "Éa ÉA éa"), ("zz", "q", "éA"), ("zz", "q", ""), ("zz", "r", "éa éa"), ("zz", "p", "ab"), ("zz", "q", "AB ab éa"), ("zz", "r", "ab,ab;aB"), ("solo", "one", "x y z")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    clashing = df.select("*", *(F.lit(1).alias(n) for n in ("term", "n", "docs", "cells", "total", "terms", "a", "b")))
    expected = plain_divergence(rows, 3, 20)
    assert sorted_rows(dv.divergence(df, top=20).collect()) == expected and sorted_rows(dv.divergence(clashing, top=20).collect()) == expected
    assert {r[0] for r in expected} >= {"zz"} and any(r[0] == "zz" and r[4] > 0 for r in expected)


def test_counts_beyond_a_long(spark):
    """A billion times ten billion occurrences passes 2**63."""
    row = spark.sql("SELECT 10000000000L AS n, 30000000000L AS total, 1000000L AS terms").select(dv.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert row == 1 + 1_000_000_000 * 10_000_000_001 // 30_001_000_000


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_divergence"])
def test_audit_queries_equal_their_sql(spark, sf_dir, duck, name):
    ours = queries.queries()[name](spark, sf_dir).toPandas()
    theirs = duck.execute(queries.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and sorted_rows(ours[columns].values.tolist()) == sorted_rows(theirs[columns].values.tolist())
