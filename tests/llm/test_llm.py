"""The training-data operators against brute force, on small tables with nulls, empties, ties, copies and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewright.llm import blocks, decontam, graph, imatch, langid, license_rules, quality, simhash, substring_dedup, token_counts, token_packs, vector_packing
from scorewright.llm.queries import SUBSTRING_SQL, license_sql, queries, table, tokenizer_path
from scorewright.llm.tokens import byte_bpe

SF = "/root/testdata/sf0.001"
BPE = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, kept string, row int, p int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared, base = prose(30), prose(200)
    texts = [prose(rng.randint(1, 120)) for _ in range(30)] + [f"{prose(20)} {shared}\n{prose(15)}" for _ in range(6)] + [base] * 4 + [base.replace(" ", "  ", 3), f"{base} more", base.upper()]
    texts += [None, "", " \n\t ", "one", "a b c", "???", "日本語 テキスト 😀", "<|endoftext|> x  y z", prose(9000), "x " * 700, prose(13), "A" * 3000]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, base), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", 1, "f", "k", 2, 3) for i, t in rows], SCHEMA).repartition(5)


def empty(docs):
    return docs.where("false")


def brute_fp(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    import xxhash

    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows) and simhash.near_duplicates(empty(docs)).count() == 0
    nodes = [(i, brute_fp(t)) for i, t in rows]
    label = {}
    for i, f in nodes:
        group, todo = {f}, [f]
        while todo:
            x = todo.pop()
            new = {g for _, g in nodes if (g ^ x).bit_count() <= 4} - group
            group |= new
            todo += new
        label[f] = min(j for j, g in nodes if g in group and j is not None)
    want = sorted((str(i), format(f, "016x"), label[f]) for i, f in nodes)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_simhash_with_the_code_for_large_tables(docs, monkeypatch):
    """The code on all 64 bits, from end to end, gives the same components."""
    want = sorted(map(str, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "FINE_FROM", 0)
    assert sorted(map(str, simhash.near_duplicates(docs).collect())) == want


@pytest.mark.parametrize("parts", [simhash.HALVES, simhash.WHOLE])
def test_anchors_meet(parts):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    b = a.copy()
    for k in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64)
    ra, ka = simhash.anchors(a, parts)
    rb, kb = simhash.anchors(b, parts)
    assert all(set(ka[ra == i]) & set(kb[rb == i]) for i in range(len(a)))


def test_group_links_span_large_groups():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(170)]))
    for banded, limit in ((True, 4096), (False, 4096)):
        links = [np.stack(x) for x in simhash.group_links(np.zeros(len(fp), np.uint64), fp, np.arange(len(fp)), banded)]
        par = list(range(len(fp)))

        def find(x):
            while par[x] != x:
                x = par[x]
            return x

        for a, b in np.concatenate(links, axis=1).T:
            par[max(find(a), find(b))] = min(find(a), find(b))
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
        assert all(find(i) == find(j) for i, j in zip(*np.nonzero(near), strict=True))
    assert len(fp) > limit


def test_hot_anchors_are_split(spark):
    """A family of many different near copies is dealt to blocks; its components stay whole."""
    rng = np.random.default_rng(4)
    base, bit = rng.integers(0, 1 << 63, 3, dtype=np.uint64), lambda n: np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    fp = np.unique(np.concatenate([base[0] ^ bit(500) ^ bit(500) ^ bit(500), base[1] ^ bit(60), base[2:], rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    points = spark.createDataFrame(list(zip(fp.view(np.int64).tolist(), range(len(fp)), strict=True)), "fp long, node long").repartition(4)
    hot, salts = simhash.hot_cells(points, 4, simhash.HALVES, 32)
    assert len(hot) and salts.min() > 1
    cells = simhash.part_of(simhash.mix(simhash.anchors(fp)[1]), 4 * simhash.CELLS)
    true = np.bincount(cells, minlength=4 * simhash.CELLS)
    assert set(np.flatnonzero(true > 32).tolist()) <= set(hot.tolist())
    assert all(2 * true[c] / s <= 32 for c, s in zip(hot, salts, strict=True))
    _, keys = simhash.salted(*simhash.anchors(fp), fp, 4 * simhash.CELLS, hot, salts)
    assert np.unique(keys, return_counts=True)[1].max() < 64 < np.unique(simhash.anchors(fp)[1], return_counts=True)[1].max()
    got = {r.node: r.component for r in graph.components(simhash.links(points, hot=32)).collect()}
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    for i in range(len(fp)):
        group, todo = {i}, [i]
        while todo:
            new = set(np.flatnonzero(near[todo.pop()]).tolist()) - group
            group |= new
            todo += new
        assert got.get(i, i) == min(group)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201)], "a long, b long")
    for hot in (None, 5):
        got = {r.node: r.component for r in graph.components(links, hot=hot).collect()}
        assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert graph.components(links.where("false")).count() == 0


def test_hot_keys_are_not_gathered(spark):
    rows = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("u"), F.col("id").alias("v"))
    table_ = rows.groupBy("u").agg(F.max("v").alias("m"), F.count("*").alias("n"))
    got = blocks.looked_up(rows, table_, "u", "m", 100)
    assert sorted(map(tuple, got.select("u", "v", "m").collect())) == sorted((7, i, 2999) if i < 3000 else (i, i, i) for i in range(4000))
    assert got.where("u = 7").select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] <= 500


def test_substring_dedup(docs, rows):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((str(i), len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    got = substring_dedup.digest(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    full = substring_dedup.remove_repeats(docs).select("row.*", F.col("kept.spans").alias("cut"), F.col("kept.n_removed").alias("gone")).collect()
    assert {r.kept for r in full} == {"k"} and all(sum(s.length for s in r.cut) == r.gone for r in full)
    assert substring_dedup.digest(empty(docs)).count() == 0


def test_substring_dedup_across_blocks(docs):
    one, many = (sorted(map(str, substring_dedup.digest(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_substring_dedup_over_groups_of_partitions(docs, monkeypatch):
    """With many partitions blocks go over groups of them; the result is the same."""
    want = sorted(map(str, substring_dedup.digest(docs).collect()))
    for fan, n in ((2, 23), (1, 4)):
        monkeypatch.setattr(substring_dedup, "FAN", fan)
        monkeypatch.setattr(substring_dedup, "MIDDLE", 2)
        monkeypatch.setattr(substring_dedup, "partitions", lambda df, mb, n=n: n)
        route = substring_dedup.Route.to(n)
        assert route.width > 1 and route.first * route.width >= n
        assert sorted(map(str, substring_dedup.digest(docs).collect())) == want
    assert substring_dedup.digest(empty(docs)).count() == 0
    assert substring_dedup.Route(2_000_000, 1414, 88).first < 2_000_000 / 15


def test_substring_sql(docs, rows):
    import duckdb

    c = duckdb.connect()
    c.sql("create table documents(doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    got = substring_dedup.digest(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, c.sql(SUBSTRING_SQL).fetchall()))


def test_imatch_of_short_texts(spark):
    real = table(spark, SF, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = [w.strip(".,") for r in real.where("length(text) > 500").orderBy("doc_id").limit(40).collect() for w in r.text.split()[:6]]
    texts = list(dict.fromkeys(" ".join(sorted({w.lower() for w in words[3 * i : 3 * i + 3]})) for i in range(80)))
    short = spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*texts, texts[0].upper(), "?!", ""])], "doc_id long, text string")
    n = len(texts)
    fp = {r.doc_id: r.fingerprint for r in imatch.fingerprints(real.unionByName(short)).where("doc_id < 0").collect()}
    assert fp[-1] == fp[-1 - n] and fp[-2 - n] == fp[-3 - n]
    assert all(fp[-1 - i] != fp[-2 - n] for i in range(n)) and len({fp[-1 - i] for i in range(n)}) >= 0.9 * n
    bare = imatch.fingerprint(short, "text", "fp", (F.array_repeat(F.lit(0).cast("long"), imatch.LEAST_BITS // 64), imatch.LEAST_BITS)).collect()  # no lexicon: all terms count
    assert len({tuple(r.fp) for r in bare}) == n + 1


def unigram(pieces, byte_fallback=True):
    """The tokenizers library's Unigram over the same pieces, whole texts at once."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    lowest = min(s for _, s in pieces)
    byte = [(f"<0x{b:02X}>", lowest) for b in range(256)] if byte_fallback else []
    t = Tokenizer(models.Unigram([("<unk>", lowest), *byte, *pieces], unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def test_token_counts(spark, docs, rows):
    path = tokenizer_path("piece_bpe_32k.model")
    pieces = token_counts.vocabulary(path)
    assert sum("▁" in p[1:] for p, _ in pieces) == 14  # runs of blanks are kept
    exact = unigram(pieces)
    more = ["def f():\n        return  1", "  two before", "after  ", " ", "   ", "a  b   c    d", "\t x", "x" * 5000 + "  " + "é" * 300, "▁meta▁▁signs"]
    table_ = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = {(r.doc_id, r.n_chars): r.n_tokens for r in token_counts.token_counts(table_, path).collect()}
    for i, text in [*rows, *((1000 + i, t) for i, t in enumerate(more))]:
        if text and "<" not in text:
            assert got[i, len(text)] == exact(text), (i, text[:50])
    assert got[rows[-1][0], 0] == 0 and token_counts.token_counts(empty(docs), path).count() == 0


@pytest.mark.parametrize("fallback", [True, False])
def test_token_counts_of_made_vocabularies(fallback):
    """Ties, runs of blanks and unknown characters, for vocabularies where pieces of several blanks win."""
    rng = random.Random(6)
    for _ in range(40):
        names = {"▁", "▁▁", "▁▁▁", "a", "b"} | {"▁" * rng.randrange(3) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(15)}
        pieces = [(p, float(-rng.randrange(1, 6))) for p in sorted(names)]
        count, exact = token_counts.Counter(pieces, fallback), unigram(pieces, fallback)
        for _ in range(40):
            t = "".join(rng.choice("aabbc   é") for _ in range(rng.randint(1, 25)))
            assert count.text(t)[0] == exact(t), (t, pieces)
    with pytest.raises(ValueError, match="go on after a blank"):
        token_counts.Counter([("a▁b", -1.0)])


def ids_of(text):
    return byte_bpe(BPE).exact.encode(text or "", add_special_tokens=False).ids


def test_fast_ids_are_the_tokenizers():
    rng = random.Random(5)
    b = byte_bpe(BPE)
    for _ in range(400):
        t = "".join(rng.choice(["ab", " ", " ", "\n", "  ", "é", "'s", "7", ".", "\t", "|", "ß", " ", "It's", "<|endoftext|>", "日"]) for _ in range(rng.randint(0, 30)))
        assert b.ids(t).tolist() == ids_of(t), t


def test_vector_packing(docs, rows):
    limits = vector_packing.Limits()
    got = vector_packing.pack(docs, BPE).collect()
    assert vector_packing.pack(empty(docs), BPE).count() == 0
    pieces = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, np.frombuffer(r.ids, np.uint32).tolist()))
    for i, t in rows:
        if [j for j, _ in rows].count(i) == 1:
            mine = sorted(pieces[i])
            assert sum((p[2] for p in mine), []) == [*ids_of(t), 0]
            assert [p[0] for p in mine] == np.r_[0, np.cumsum([p[1] for p in mine])[:-1]].tolist()
    assert sum(r.length for r in got) == sum(len(ids_of(t)) + 1 for _, t in rows)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        total = sum(n for _, n in s)
        assert [o for o, _ in s] == np.r_[0, np.cumsum([n for _, n in s])[:-1]].tolist() and total <= limits.tokens and len(s) <= limits.segments and total & total - 1 == 0


def test_vector_packing_limits():
    out = vector_packing.Packer(vector_packing.Limits(64, 3, 40), 0, True)
    rng = np.random.default_rng(1)
    for d in range(200):
        n = int(rng.integers(1, 150))
        out.add(d, np.arange(n, dtype=np.uint32), rng.integers(0, 2, n))
    out.finish()
    seqs = {}
    for doc, _, n, _, _, seq, _, loss, _ in out.out:
        seqs.setdefault(seq, []).append((n, loss))
    assert all(sum(n for n, _ in s) <= 64 and len(s) <= 3 and sum(x for _, x in s) <= 40 for s in seqs.values())


def test_example_with_the_largest_dot_product_is_taken():
    """Bins of small examples against the plain rule, with all three limits binding."""
    rng = np.random.default_rng(5)
    limits = vector_packing.Limits(60, 4, 30)
    packer = vector_packing.Packer(limits, 0, False)
    loss = [rng.integers(0, 2, int(rng.integers(1, 16))) for _ in range(300)]
    for d, x in enumerate(loss):
        packer.put((d, np.arange(len(x), dtype=np.uint32), np.r_[0, np.cumsum(x)], 0))
    cap, waiting = np.array([60, 4, 30.0]), list(range(300))
    for _ in range(20):
        seen = len(packer.out)
        packer.fill()
        room, want = cap.copy(), []
        while waiting and room[0] > 0 and room[1] > 0:
            need = {d: np.array([len(loss[d]), 1, loss[d].sum()]) for d in waiting}
            fits = [d for d in waiting if (need[d] <= room).all()]
            if not fits or (room[1] == 1 and max(need[d][0] for d in fits) < room[0]):
                break  # from here on examples are cut
            best = max(need[d] @ (room / cap / cap) for d in fits)
            want.append(best)
            taken = packer.out[seen + len(want) - 1][0]
            assert need[taken] @ (room / cap / cap) == pytest.approx(best)
            room -= need[taken]
            waiting.remove(taken)
        for row in packer.out[seen + len(want) :]:  # what was cut leaves a rest behind: the comparison goes on without it
            if row[0] in waiting:
                waiting.remove(row[0])
        packer.items = [x for x in packer.items if x[3] == 0]
        packer.need[:, : len(packer.items)] = np.array([(len(x[1]), 1, loss[x[0]].sum()) for x in packer.items]).T
        assert sorted(x[0] for x in packer.items) == sorted(waiting)


def test_limits_bind(spark, docs, rows):
    limits = vector_packing.Limits(256, 3, 200)
    got = vector_packing.pack(docs, BPE, limits, loss="predicted").collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    sums = [(sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in seqs.values()]
    assert all(a <= 256 and b <= 3 and c <= 200 for a, b, c in sums) and max(b for _, b, _ in sums) == 3 and max(c for _, _, c in sums) == 200
    assert sum(r.length - r.loss_tokens for r in got) == len(rows) and sum(r.length for r in got) == sum(len(ids_of(t)) + 1 for _, t in rows)
    nothing = vector_packing.Packer(vector_packing.Limits(8, 2, 0), 0, True)
    nothing.put((1, np.arange(3, dtype=np.uint32), np.array([0, 1, 2, 3]), 0))
    with pytest.raises(ValueError, match="needs more"):
        nothing.fill()


def test_written_packs_are_read_back(spark, docs, rows, tmp_path):
    packs = token_packs.pack_ids(docs, BPE, width=64)
    token_packs.write_packs(packs, str(tmp_path / "packs"))
    back = spark.read.parquet(str(tmp_path / "packs"))
    assert sorted(map(str, token_packs.digest(back).collect())) == sorted(map(str, token_packs.digest(packs).collect()))
    one = back.orderBy("row_id").first()
    ids, cu = np.frombuffer(one.ids, "<u4"), one.cu_seqlens
    text = dict((i, t) for i, t in rows)[one.doc_ids[0]]
    assert ids[: cu[1]].tolist() == [*ids_of(text), 50256][one.starts[0] : one.starts[0] + cu[1]]
    sums = [(np.frombuffer(r.ids, "<u4") != 0).sum() for r in back.collect()]
    assert len(sums) == back.count() and back.agg(F.sum("n_tokens")).first()[0] == sum(len(ids_of(t)) + 1 for _, t in rows)


def test_token_packs(docs, rows):
    got = token_packs.pack_ids(docs, BPE, width=128).collect()
    assert token_packs.pack_ids(empty(docs), BPE).count() == 0
    pieces = []
    for r in got:
        ids, pos = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(pos) == 128 and r.cu_seqlens[-1] == r.n_tokens <= 128
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert pos[a:b].tolist() == list(range(b - a))
            pieces.append((str(d), s, ids[a:b].tolist()))
    whole = {i: [*ids_of(t), 50256] for i, t in rows if [j for j, _ in rows].count(i) == 1}
    for i, w in whole.items():
        assert sum((p for d, _, p in sorted(x for x in pieces if x[0] == str(i))), []) == w
    assert sum(len(p) for _, _, p in pieces) == sum(len(ids_of(t)) + 1 for _, t in rows)


def test_best_fit_is_best_fit():
    rng = random.Random(4)
    lengths = [rng.randint(1, 50) for _ in range(400)]
    rooms, want = [], []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms[rooms.index(min(fit))] -= n
        else:
            rooms.append(50 - n)
    got = token_packs.best_fit(lengths, 50)
    want = sorted(50 - r for r in rooms)
    assert sorted(sum(lengths[k] for k in row) for row in got) == want and sorted(k for row in got for k in row) == list(range(400))


def test_decontamination(spark, docs):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice((10, 20, 40))))) for k in range(12)] + [(None, "a b c d e f g h"), (99, None), (98, "")]
    rows, want = [], set()
    for k in range(12):
        w = items[k][1].split()
        noise = lambda n: [rng.choice(vocab) for _ in range(n)]
        rows.append((k, " ".join([*noise(50), *w, *noise(30)])))
        want.add((k, k))
        bad = list(w)
        for p in range(6, len(bad) - 2, 9):
            bad[p] = "changed"
        rows.append((100 + k, " ".join([*noise(5), *[x.upper() + "," for x in bad]])))
        if sum(a == b for a, b in zip(w, bad, strict=True)) >= 8:
            want.add((100 + k, k))
        rows.append((200 + k, " ".join([*w[:5], *noise(60)])))
    rows += [(300, None), (301, ""), (None, items[3][1])]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()}
    assert got == want | {(None, 3)}
    old, decontam.SHARD = decontam.SHARD, 60  # several shards give the same
    try:
        assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()} == got
    finally:
        decontam.SHARD = old
    assert decontam.contaminated(empty(docs), b).count() == 0 and decontam.contaminated(d, b.where("false")).count() == 0


def test_language_id(spark, docs):
    real = table(spark, SF, "documents").select("doc_id", "text", "lang")
    got = queries()["op1_language_id"](spark, SF).join(real, "doc_id").where("held_out")
    n, good = got.count(), got.where("lang = lang_pred").count()
    assert good >= 0.97 * n
    model = langid.learn(real, F.lit(True))
    r = {x.doc_id: x for x in langid.identify(docs, model).where("doc_id is not null").collect()}
    und = [x for x in r.values() if x.lang_pred == "und"]
    assert len(und) == 4 and all(x.rejected and x.score == 0 for x in und)
    assert langid.identify(empty(docs), model).count() == 0
    none = langid.learn(real.where("false"), F.lit(True))
    assert {x.lang_pred for x in langid.identify(docs, none).collect()} == {"und"}


def test_language_id_without_letters(spark):
    bare = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 345", "en"), (4, "?!", "en"), (5, "0", "en"), (6, "7", "en"), (None, " ", "en")], "doc_id long, text string, lang string").coalesce(1)
    assert all(len(x) == 0 for x in langid.grams([None, "", "12 345"])[:2]) and langid.grams([None, "", "12 345"])[2].tolist() == [0, 0, 0]
    learned = langid.learn(table(spark, SF, "documents"), F.lit(True))
    same = spark.createDataFrame([(i, "same", "en") for i in range(9)], "doc_id long, text string, lang string")
    for model in (learned, langid.learn(bare, F.lit(True)), langid.learn(bare.union(same), F.lit(True))):
        got = langid.identify(bare, model).collect()
        assert len(got) == 7 and all((r.lang_pred, r.score, r.rejected) == ("und", 0, True) for r in got)
    long = spark.createDataFrame([(1, "the way of the water " * 30_000), (2, "12")], "doc_id long, text string").coalesce(1)
    assert [r.lang_pred == "und" for r in sorted(langid.identify(long, learned).collect())] == [False, True]


def test_language_rejection(spark):
    import corpus_pipeline

    rng = random.Random(5)
    real = table(spark, "/root/testdata/sf0.01", "documents")
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (30, 100, 300, 1000, 5000) for _ in range(8)]
    junk += ["Привет, как дела? Это русский текст о погоде и о людях.", "这是一个中文句子，我们在这里测试"]
    junk = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    model = langid.learn(real, F.lit(True))
    assert langid.identify(junk, model).where("not rejected").count() == 0
    assert langid.identify(real, model).where("rejected").count() <= 0.01 * real.count()
    for lang in ("de", "en"):
        without = langid.learn(real, F.col("lang") != lang)
        assert langid.identify(real.where(F.col("lang") == lang), without).where("not rejected").count() <= 0.05 * real.where(F.col("lang") == lang).count()
        assert langid.identify(real.where(F.col("lang") != lang), without).where("rejected").count() <= 0.01 * real.count()
    kept = corpus_pipeline.language_id(spark, real.unionByName(junk, allowMissingColumns=True), "")
    assert kept.where("doc_id < 0").count() == 0 and kept.count() >= 0.99 * real.count()


def test_stages_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    real = table(spark, SF, "documents")
    clean = [r.text for r in real.where("lang = 'en' and length(text) between 500 and 3000").orderBy("doc_id").limit(3).collect()]
    leak = max((r.text for r in table(spark, SF, "benchmark").collect()), key=len)
    bad = {"language_id": "xqzj wvkq zzxq jjkw qqvx " * 20, "decontamination": f"{clean[0]} {leak}"}
    for name, text in bad.items():
        rows = [(-7, text), (-7, clean[0]), (None, text), (None, clean[1]), (-8, clean[2]), (-8, clean[2])]
        planted = spark.createDataFrame(rows, "doc_id long, text string")
        stage = dict(corpus_pipeline.STAGES)[name]
        base = real.where("lang is not null") if name == "language_id" else real.where("false")
        got = stage(spark, base.unionByName(planted, allowMissingColumns=True), SF)
        assert got.columns == real.columns
        want = [r for r in rows if r[1] != text] if name == "language_id" else [r for r in rows if r[1] != text and not decontam.contaminated(planted.where(F.col("text") == r[1]), table(spark, SF, "benchmark")).count()]
        assert sorted(map(str, got.where("doc_id < 0 or doc_id is null").select("doc_id", "text").collect())) == sorted(map(str, spark.createDataFrame(want, "doc_id long, text string").collect())), name


def test_one_of_each(spark, docs, rows):
    """One row of each component stays: the smallest doc_id, then the smallest hash of the text; nulls last."""
    import xxhash

    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    h = lambda t: 42 if t is None else signed(t)
    repeated = [*rows, *rows[30:33], (None, "one"), (None, "one"), (7, "q r s"), (7, rows[0][1]), (None, "only without id")]
    nodes = [(i, t, brute_fp(t)) for i, t in repeated]
    want = set()
    for _, _, f in nodes:
        group, todo = {f}, [f]
        while todo:
            x = todo.pop()
            new = {g for _, _, g in nodes if (g ^ x).bit_count() <= 4} - group
            group |= new
            todo += new
        want.add(min(((i is None, i or 0, h(t), t or "", i, t) for i, t, g in nodes if g in group), key=lambda r: r[:4])[4:])
    table_ = spark.createDataFrame([(i, t, "xx", "s", 1, "f", "k", 2, 3) for i, t in repeated], SCHEMA).repartition(3)
    got = simhash.one_of_each(table_)
    assert got.columns == table_.columns and sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    assert simhash.one_of_each(empty(docs)).count() == 0


@pytest.mark.parametrize("k", [2, 3, 4, 7, 9, 20])
def test_codewords(k):
    c = langid.codewords(k)
    assert len(np.unique(c, axis=0)) == k and (np.abs(c.sum(axis=0)) < k).all()


def test_quality(spark, docs):
    sf = "/root/testdata/sf0.01"
    got = queries()["op10_quality"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    assert got.where("quality = predicted").count() >= 0.95 * got.count()
    labels = spark.createDataFrame([(0, 1), (3, 0), (0, 1), (None, 1), (6, None), (9999, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels, F.lit(True))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in quality.score(docs, model).collect())
    assert {r.score for r in quality.score(docs, quality.learn(docs, labels.where("false"), F.lit(True))).collect()} == {0.5}
    assert quality.score(empty(docs), model).count() == 0


def test_isotonic():
    s, v = quality.pool(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert v.tolist() == [0, 0.5, 1] and s.tolist() == [1, 2, 4]


def test_license_scan(spark, docs):
    import duckdb

    c = duckdb.connect()
    c.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    got = queries()["op9_license_scan"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, c.sql(license_sql()).fetchall()))
    assert license_rules.scan(docs).where("license is not null").count() == 0 and license_rules.scan(docs).count() == docs.count()
    t = "Intro.\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. Licensed under CC BY 4.0."
    r = license_rules.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert r.license == "isc" and r.licenses == ["isc", "cc-by-4.0"]
    assert all(any(h in form for h in license_rules.HINTS) for forms in license_rules.SENTENCES.values() for form in forms)


def test_pipeline(spark):
    import corpus_pipeline

    before = table(spark, SF, "documents")
    n = before.count()
    docs = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == before.columns, name
        assert 0.5 * n < docs.count() <= n
        if name == "simhash_dedup":
            assert simhash.near_duplicates(docs).where("doc_id <> component_id").count() == 0
        if name == "substring_dedup":
            assert docs.where("n_chars <> char_length(text)").count() == 0
    assert decontam.contaminated(docs, table(spark, SF, "benchmark")).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.collect()}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
NAME = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file."""
WRAPPED = [("mit", MIT), ("bsd-2-clause", BSD), ("bsd-3-clause", BSD + NAME), ("isc", ISC), ("gpl-3.0-or-later", GPL), ("gpl-2.0-or-later", GPL.replace("version 3", "version 2")), ("apache-2.0", APACHE), ("mpl-2.0", MPL)]


def test_wrapped_licenses(spark):
    rows = []
    for name, t in WRAPPED:
        for prefix in ("", "// ", " * ", "# ", "dnl ", "REM "):
            rows.append((name, "\n".join((prefix + x).rstrip() for x in t.split("\n"))))
        rows += [(name, t.replace("\n", "\r\n")), (name, f"Copyright (c) 2020 Some One\n{t}"), (name, "Some code.\n\n/*\n" + t + "\n*/\nx = 1")]
    rows += [(None, ISC.replace("any\npurpose", "any\n\npurpose")), (None, ISC.replace("fee", "some fee")), ("mit", "Title\nReleased under the MIT License\nmore text")]
    got = {r.doc_id: r for r in license_rules.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [(i, got[i].license) for i in range(len(rows))] == [(i, name) for i, (name, _) in enumerate(rows)]
    assert got[[n for n, _ in rows].index("apache-2.0")].sentence_ids == ["APACHE_NOTICE", "APACHE_LIMIT", "APACHE_COPY", "APACHE_BASIS"]


def test_every_rule_fires(spark):
    """Each rule's sentences as a text: one a line, wrapped at 30 columns, and wrapped within comments."""
    import textwrap

    rows = []
    for name, ids in license_rules.RULES:
        for which in (0, -1):
            sentences = [license_rules.SENTENCES[i][which].replace("~", "program").replace("*", "the Foo Inc").capitalize() + "." for i in ids]
            wrapped = "\n\n".join(textwrap.fill(x, 30, break_long_words=False) for x in sentences)
            rows += [(name, "Code.\n" + "\n".join(sentences)), (name, wrapped.upper()), (name, "/*\n" + "\n".join(f" * {x}" for x in wrapped.split("\n")) + "\n */\nint x;")]
    rows += [("mit", "// SPDX-License-Identifier: MIT\nx"), ("gpl-2.0-only", "# SPDX-License-Identifier: GPL-2.0-only"), ("bsd-4-clause", BSD + "\n3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n x")]
    rows += [("zlib", "This software is provided 'as-is', without any express or implied\nwarranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:")]
    rows += [("lgpl-2.1-or-later", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.")]
    got = {r.doc_id: r for r in license_rules.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert [(i, n) for i, (n, _) in enumerate(rows) if n not in got[i].licenses] == []
    assert license_rules.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert len(license_rules.SENTENCES) >= 75 and len({f for forms in license_rules.SENTENCES.values() for f in forms}) == sum(map(len, license_rules.SENTENCES.values()))


def test_rows_without_id_do_not_gather(spark):
    """Half of the rows have no doc_id: they stay in their tasks and keep all their words."""
    long = "a b c d e f g h i j k l m n o p"
    rows = [(k if k % 2 else None, f"{k} {long}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = substring_dedup.remove_repeats(docs)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1000
    got = out.select("row.doc_id", "kept.n_removed").collect()
    assert all((r.n_removed == 0) == (r.doc_id in (None, 1)) for r in got)


def test_instruction_packs_keep_three_limits(spark):
    """Prompts bear no loss; every limit holds and binds, on odd rows and on all conversations."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice(["a", "bank", "holds", "capital"]) for _ in range(n))
    rows = [(k, words(rng.choice([5, 60])), words(rng.choice([0, 3, 50]))) for k in range(200)] + [(None, None, None), (1, "", "x"), (1, "", "x"), (300, words(500), words(500)), (301, words(400), None)]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, answer string").repartition(3)
    limits = vector_packing.Limits(128, 3, 64)
    got = vector_packing.pack_pairs(df, BPE, limits).collect()
    bpe = byte_bpe(BPE)
    want = sorted((i if i is not None else -1, len(bpe.ids(q)) + len(bpe.ids(a)) + 1, len(bpe.ids(a)) + 1) for i, q, a in rows)
    whole = {}
    for r in got:
        key = r.doc_id if r.doc_id is not None else -1
        n, loss = whole.get(key, (0, 0))
        whole[key] = (n + r.length, loss + r.loss_tokens)
    assert whole == {i: tuple(sum(w[k] for w in want if w[0] == i) for k in (1, 2)) for i, *_ in want}
    hold(got, limits)
    assert vector_packing.pack_pairs(df.limit(0), BPE, limits).count() == 0
    from scorewright.llm.queries import INSTRUCTIONS

    full = hold(queries()["instruction_packs"](spark, "/root/testdata/sf0.01").collect(), INSTRUCTIONS)
    assert all(n > 0 for n in full)


def hold(pieces, limits):
    """Sequences that are at each limit (within a hundredth); none is above one."""
    sequences, full = {}, [0, 0, 0]
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rs in sequences.values():
        used = (sum(r.length for r in rs), len(rs), sum(r.loss_tokens for r in rs))
        assert used[0] <= limits.tokens and used[1] <= limits.segments and used[2] <= limits.loss
        for k, (u, most) in enumerate(zip(used, (limits.tokens, limits.segments, limits.loss), strict=True)):
            full[k] += u > 0.99 * most
    return full
