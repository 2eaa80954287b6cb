"""The operators on documents, on awkward rows, against plain versions of themselves."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from conftest_rows import clean, sorted_rows

from fathomlog.llm import exact_dedup, packing, sharding, simhash, substring_dedup, word_bpe


@pytest.fixture(params=["tricky", "clashing"])
def docs(request):
    return request.getfixturevalue(request.param)


def collected(df):
    return [tuple(r) for r in df.collect()]


# Sharding.


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_are_even_and_gapless(docs, shards):
    out = sharding.shard_rows(docs, shards=shards).collect()
    rows = clean(docs)
    counts = collections.Counter(r.shard for r in out)
    assert max(counts.values()) - min([*counts.values(), *[0] * (len(counts) < shards)]) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    expected = sorted_rows((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted_rows((r.doc_id, r.size, r.text_crc32) for r in out) == expected


def test_one_more_shard_moves_few_rows(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text")
    where = [{r.doc_id: r.shard for r in sharding.shard_rows(df, shards=n).collect()} for n in (16, 17)]
    moved = sum(where[0][i] != where[1][i] for i in where[0])
    assert moved < 0.5 * 4000  # modulo placement would move 16 of 17


def test_a_hot_text_is_spread_evenly(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same', concat('t', id)) as text")
    counts = collections.Counter(r.shard for r in sharding.shard_rows(df, shards=16).collect())
    assert sorted(set(counts.values())) == [187, 188]


@pytest.mark.parametrize("shards", [1, 5, 16])
@pytest.mark.parametrize("n, hot", [(3, 1), (40, 2), (3000, 3), (3000, 1)])
def test_places_are_those_of_a_plain_walk(spark, shards, n, hot):
    df = spark.range(n).selectExpr("id as doc_id", f"if(id % {hot} = 0, 'the same', concat('t', id)) as text")
    owners = {slot: (arc, shard) for slot, arc, shard in sharding.ring_owners(shards, 32)}
    own, over, places = collections.defaultdict(list), collections.defaultdict(list), {}
    for i, h, g in df.selectExpr("doc_id", "xxhash64(text)", "xxhash64(doc_id)").collect():
        ring = (h & (2**64 - 1)) >> 52
        arc, shard = owners[ring]
        own[shard].append((arc, ring, g % sharding.SALTS, h, g, i))
    bound = [n // shards + (s < n % shards) for s in range(shards)]
    for shard, rows in own.items():
        for rank, (arc, *_, i) in enumerate(sorted(rows)):
            if rank < bound[shard]:
                places[i] = (shard, rank)
            else:
                over[arc].append(i)
    load = [min(len(own[s]), bound[s]) for s in range(shards)]
    waiting = collections.deque()
    for lap in (0, 1):
        for arc, shard in sorted(set(owners.values())):
            waiting.extend(over[arc] if lap == 0 else ())
            while waiting and load[shard] < bound[shard]:
                places[waiting.popleft()] = (shard, load[shard])
                load[shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(df, shards=shards).collect()} == places


# Exact dedup.


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("memtables", [1, 6])
def test_exact_groups(docs, keep, memtables):
    rows = clean(docs)
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: (max if keep == "max" else min)((i for i in v if i is not None), default=None) for t, v in groups.items()}
    expected = sorted_rows((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).digest()) for i, t in rows)
    out = exact_dedup.exact_groups(docs, keep=keep, memtables=memtables).collect()
    assert sorted_rows((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in out) == expected


def test_colliding_digests_are_told_apart_by_bytes(docs):
    from pyspark.sql import functions as F

    short = exact_dedup.exact_groups(docs, digest=lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)))
    full = exact_dedup.exact_groups(docs)
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    assert sorted_rows(collected(short.select(*columns))) == sorted_rows(collected(full.select(*columns)))


def test_beyond_the_broadcast_bound(tricky, monkeypatch):
    full = sorted_rows(collected(exact_dedup.exact_groups(tricky)))
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", -1)
    assert sorted_rows(collected(exact_dedup.exact_groups(tricky))) == full


def test_drop_copies_keeps_columns(clashing):
    left = exact_dedup.drop_copies(clashing)
    assert left.columns == clashing.columns
    texts = [r.text or "" for r in left.collect()]
    known = {t or "" for _, t in clean(clashing)}
    assert set(texts) == known


# SimHash.


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    counts = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        counts += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(pairs):
    """Smallest id reachable; pairs of (id, fingerprint)."""
    parent = {f: f for _, f in pairs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = list(parent)
    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f, least.get(root(f), i)) for i, f in pairs]


@pytest.mark.parametrize("words", [3, 5])
def test_near_groups(docs, words):
    out = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_groups(docs, words=words).collect()]
    assert sorted_rows(out) == sorted_rows(plain_components([(i, plain_fingerprint(t or "", words)) for i, t in clean(docs)]))


@pytest.mark.parametrize("dense", [2, 48])
def test_links_of_crowded_cells_are_complete(spark, monkeypatch, dense):
    """Fingerprints around a few centres, close enough that cells are crowded, resolved by pairs and by single-bit neighbours."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(dense)
    prints = set()
    for centre in rng.integers(0, 2**64, 6, np.uint64).tolist() + [0, 2**64 - 1, 1 << 63]:
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            prints.add(x)
    pairs = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in pairs], "doc_id long, fp long")
    roots = {r.node: r.root for r in simhash.connected_components(simhash.links(df.select("fp"))).collect()}
    signed = {f: (f - 2**64 if f >= 2**63 else f) for f in prints}
    groups = collections.defaultdict(set)
    for f in prints:
        groups[roots.get(signed[f], signed[f])].add(f)
    expected = collections.defaultdict(set)
    for i, f, c in plain_components(pairs):
        expected[c].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def plain_shingles(text, words):
    got = text.encode().lower().split()
    k = min(words, len(got))
    return {tuple(got[i : i + k]) for i in range(len(got) - k + 1)} if got else set()


def plain_near(rows, words, similarity):
    """Pairs of rows that share ``similarity`` of their shingles or differ in 2 bits of their fingerprints."""
    fps, sets = [plain_fingerprint(t or "", words) for _, t in rows], [plain_shingles(t or "", words) for _, t in rows]
    both = lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    return {(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2 or both(a, b)}


def plain_groups(n, pairs):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def test_keep_one(clashing):
    left = simhash.keep_one(clashing, words=5)
    assert left.columns == clashing.columns
    rows = sorted(clean(clashing), key=lambda r: (r[0] is None, r[0] or 0))
    groups = plain_groups(len(rows), plain_near(rows, 5, 0.8))
    # Repeated rows are one document, as are rows of one id in a group.
    expected = [r for r, g in zip(rows, groups, strict=True) if r[0] == rows[g][0]]
    assert sorted_rows(clean(left)) == sorted_rows(expected)


@pytest.mark.parametrize("leaders", [1, 8])
def test_keep_one_of_large_groups(spark, monkeypatch, leaders):
    monkeypatch.setattr(simhash, "LEADERS", leaders)
    r = random.Random(leaders)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    # Groups around a text, a chain of ever later copies, texts that share a passage only, and strangers.
    for size, changes in ((60, 2), (25, 4)):
        base = [word() for _ in range(120)]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randrange(changes)):
                own[r.randrange(len(own))] = word()
            texts.append(own)
    own = [word() for _ in range(150)]
    for k in range(20):
        own = list(own)
        own[7 * k : 7 * k + 3] = [word() for _ in range(3)]
        texts.append(own)
    passage = [word() for _ in range(40)]
    texts += [[word() for _ in range(15)] + passage + [word() for _ in range(15)] for _ in range(30)] + [[word() for _ in range(80)] for _ in range(30)]
    r.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = plain_near(rows, 5, 0.8)
    assert not [p for p in pairs if p[0] in kept and p[1] in kept]
    groups = plain_groups(len(rows), pairs)
    assert {groups[i] for i in kept} == set(groups) and all(g in kept for g in groups)
    assert len(kept) < 110


def brute_force_kept(rows):
    groups = plain_groups(len(rows), plain_near(rows, 5, 0.8))
    return {rows[g][0] for g in groups}


@pytest.mark.parametrize("leaders", [1, 8])
def test_keep_one_of_groups_held_together_by_one_member(spark, monkeypatch, leaders):
    """Stars whose copies are similar to their base only, and a text whose only link is to one that fingerprints drop."""
    monkeypatch.setattr(simhash, "LEADERS", leaders)
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))

    def changed(base, at):
        return [word() if i in at else w for i, w in enumerate(base)]

    texts = []
    for size, middle in ((40, 20), (30, 29), (25, 1)):
        base = [word() for _ in range(120)]
        star = [changed(base, {r.randrange(0, 55), r.randrange(62, 118)}) for _ in range(size)]
        texts += star[:middle] + [base] + star[middle:]
    for k in range(3):
        while True:
            one = [word() for _ in range(200)]
            two = changed(one, {100})
            three = changed(two, {20, 50, 140, 170})
            a, b, c = (plain_fingerprint(" ".join(t), 5) for t in (one, two, three))
            if (a ^ b).bit_count() <= 2 < min((a ^ c).bit_count(), (b ^ c).bit_count()):
                break
        texts += [one, two, three]
    texts += [[word() for _ in range(80)] for _ in range(5)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_force_kept(rows)


def test_keep_one_compares_copies_of_one_text_with_few(spark, monkeypatch):
    """Copies similar to their base only, and texts that are no copies but share much with it: neither meet in pairs."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]

    def changed(step):
        return [word() if i % step == at else w for at in [r.randrange(step)] for i, w in enumerate(base)]

    texts = [changed(50) for _ in range(150)] + [base] + [changed(23) for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    compared, seen = simhash._compared, []

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(simhash, "_compared", counted)
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_force_kept(rows)
    assert sum(seen) < 2500


def test_keep_one_deals_texts_with_a_common_passage_by_rare_shingles(spark, monkeypatch):
    """Texts that share a passage and meet in bands, without being copies, are not compared in pairs; copies among them are found."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(150)]
    texts = [passage + [word() for _ in range(50)] for _ in range(120)]
    texts += [[*t[:170], word(), *t[171:]] for t in texts[10:15]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    compared, seen = simhash._compared, []

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(simhash, "_compared", counted)
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_force_kept(rows) == set(range(120))
    assert sum(seen) < 2000


@pytest.mark.parametrize("size", [1, 4, 5, 9, 40])
def test_similar_sets_share_a_rare_shingle(spark, size):
    """Sets that are similar to the very bound meet by their rarest shingles."""
    r = random.Random(size)
    common = [r.getrandbits(64) for _ in range(4 * size)]
    rows = [(i, np.array(sorted([*common, *(r.getrandbits(64) for _ in range(own))]), np.uint64).tobytes()) for i, own in enumerate((size, 0))]
    rows += [(i, np.array(sorted(r.getrandbits(64) for _ in range(50)), np.uint64).tobytes()) for i in range(2, 12)]
    got = simhash._by_rare_shingles(spark.createDataFrame(rows, "o long, s binary"), 0.8).collect()
    assert {x.bucket for x in got if x.o == 0} & {x.bucket for x in got if x.o == 1}


# Substrings.


def plain_repeats(rows, length):
    count = collections.Counter()
    for _, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            count[raw[i : i + length]] += 1
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "kgram"), [(200, 50), (40, 12)])
def test_repeats(docs, length, kgram):
    out = substring_dedup.remove_repeats(docs, length=length, kgram=kgram)
    assert sorted_rows(collected(out)) == sorted_rows(plain_repeats(clean(docs), length))


def test_repeats_in_small_blocks_and_many_shards(tricky, monkeypatch):
    """Long documents in overlapping blocks, and anchors dealt over shards that are merged."""
    monkeypatch.setattr(substring_dedup, "BLOCK", 3000)
    monkeypatch.setattr(substring_dedup, "SHARD_SLICES", 1)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 500)
    texts = [r for r in tricky.collect()]
    run = substring_dedup.slices_of
    data = (texts[0].text or "x" * 500).encode()
    assert len(run(np.frombuffer(data * 3, np.uint8), np.array([0, len(data) * 3]), 40, 12)[0]) >= 0
    out = substring_dedup.remove_repeats(tricky, length=40, kgram=12)
    assert sorted_rows(collected(out)) == sorted_rows(plain_repeats(clean(tricky), 40))


def test_a_shard_in_little_memory():
    """Shards of two workers beside an executor's heap: a few tens of bytes to a byte sorted."""
    rng = np.random.default_rng(5)
    slices = [rng.integers(97, 101, 350, np.uint8).tobytes() for _ in range(1500)]
    slices += [x[:-1] + b"!" for x in slices[:300]]
    windows = np.full(len(slices), 151)
    windows[7] = 1
    substring_dedup.repeats_in_shard(slices[:10], windows[:10], 200)
    tracemalloc.start()
    position, group, bounds = substring_dedup.repeats_in_shard(slices, windows, 200)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60 * bounds[-1]
    held = [(int(np.searchsorted(bounds, p, "right")) - 1, int(p)) for p in position]
    assert sorted(p for _, p in held) == [int(bounds[i]) + k for i, n in enumerate(windows) for k in range(n)]
    content = [slices[i][p - bounds[i] : p - bounds[i] + 200] for i, p in held]
    assert content == sorted(content) and [a != b for a, b in zip(content, content[1:], strict=False)] == list(np.diff(group) > 0)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for n, letters in [(1, 2), (50, 2), (300, 3), (400, 1)]:
        text = rng.integers(1, letters + 1, n)
        sa = substring_dedup.suffix_array(text)
        raw = bytes(text.astype(np.uint8))
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        lcp = substring_dedup.kasai(text, sa, np.array([0, n // 2, n]), 10)
        for k in range(1, n):
            a, b = raw[sa[k - 1] :], raw[sa[k] :]
            common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(10, common)


def test_kept_text_is_the_rest(clashing):
    out = substring_dedup.remove_repeats(clashing, length=40, kgram=12, keep_text=True)
    assert out.columns == clashing.columns and out.count() == clashing.count()
    digests = collections.Counter(r[4] for r in plain_repeats(clean(clashing), 40))
    ours = collections.Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in out.collect())
    assert sum((digests & ours).values()) >= out.count() - 1  # a cut through a character drops it


# Packing and BPE.


def token_ids(tokenizer, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    return t, [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, tokenizer, capacity):
    out = packing.pack_documents(docs, tokenizer, capacity=capacity).collect()
    expected = []
    for i, ids in token_ids(tokenizer, clean(docs))[1]:
        ids = np.array([*ids, 0], "<u4")
        expected += [(i, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    assert sorted_rows((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted_rows(expected)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1 + 1.15 * sum(r.length for r in out) / capacity


def test_plan_places_everything():
    rng = np.random.default_rng(6)
    for trial in range(30):
        capacity = int(rng.integers(3, 60))
        histogram = {int(n): int(rng.integers(1, 40)) for n in rng.integers(1, capacity + 1, 12)}
        fill, taken = collections.Counter(), {n: set() for n in histogram}
        for length, rank0, count, first, each, offset in packing.plan(histogram, capacity):
            assert count % each == 0 or each == count
            for k in range(count):
                assert rank0 + k not in taken[length]
                taken[length].add(rank0 + k)
                assert fill[first + k // each] == offset + (k % each) * length, trial
                fill[first + k // each] += length
        assert all(taken[n] == set(range(c)) for n, c in histogram.items()) and max(fill.values()) <= capacity
        large = collections.Counter()
        for length, _, count, first, each, _ in packing.plan(histogram, capacity):
            if 3 * length > capacity:
                for k in range(count):
                    large[first + k // each] += 1
        assert not large or max(large.values()) <= 2


def test_bpe_digests_and_ids(docs, tokenizer):
    t, ids = token_ids(tokenizer, clean(docs))
    expected = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids]
    assert sorted_rows(collected(word_bpe.encode_digests(docs, tokenizer))) == sorted_rows(expected)
    whole = [(i, x, t.decode(x, skip_special_tokens=False)) for i, x in ids]
    assert sorted_rows((r.doc_id, list(r.ids), r.decoded) for r in word_bpe.encode_documents(docs, tokenizer).collect()) == sorted_rows(whole)


def test_bpe_of_more_text_than_buckets_and_parts(spark, tricky, tokenizer, monkeypatch):
    """Buckets beyond what Spark writes hold more chunks each, parts beyond the most are made of spans of chunks; nothing stays in the catalog."""
    expected = sorted_rows(collected(word_bpe.encode_digests(tricky, tokenizer)))
    for name, value in {"BUCKET_TEXT": 1, "PART_TEXT": 2000, "MOST_PARTS": 4, "CHUNK_TEXT": 5000, "MOST_BUCKETS": 20}.items():
        monkeypatch.setattr(word_bpe, name, value)
    assert sorted_rows(collected(word_bpe.encode_digests(tricky, tokenizer))) == expected
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]


def test_encoder_forgets_and_stays_right(tokenizer, monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 20)
    encode = word_bpe.WordEncoder(tokenizer)
    words = [f"word{i}x's" for i in range(60)] + ["ÀÉß", "<|endoftext|>x", "naïve!", "ẖ", "ẖ"]
    expected = [encode.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    for at in range(0, len(words), 7):
        assert encode(words[at : at + 7]) == expected[at : at + 7]


# Empty tables.


def test_empty_tables(nothing, tokenizer):
    assert sharding.shard_rows(nothing).count() == 0
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0
    assert simhash.near_groups(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert packing.pack_documents(nothing, tokenizer).count() == 0
    assert word_bpe.encode_digests(nothing, tokenizer).count() == 0
