"""The operators against brute force, exact round trips, held-out labels, and awkward rows."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import audio, fingerprint, html, jaccard, langid, mixing, packing, quality, sharding, tokens
from loomwork.llm.shingles import shingle_hashes

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, size string, score string"


def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows, ties, columns with clashing names."""
    long = "word " * 30_000
    texts = [None, "", " \n\t", "a", "a b c", "x" * 70_000, long, "same text of some words here", "same text of some words here", "한국어 문장 <|endoftext|> ok", "!!! ??? 123"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "q", None, "z", "w") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_token_counts_equal_the_library(spark, docs, local):
    tok = library()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(docs).collect()}
    for i, t in zip(local.doc_id, local.text):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 512)
    odd = awkward(spark)
    want = Counter((r["doc_id"], len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(odd).collect()) == want
    assert tokens.count_tokens(empty(spark)).count() == 0


def test_slices_do_not_change_ids():
    text = "It's  a\n\ntest of 12 words, don't you  think? " * 50
    e = tokens.encoder(tokens.default_tokenizer())
    assert "".join(tokens.slices(text, 40)) == text
    assert b"".join(e.batch(tokens.slices(text, 40))) == e.batch([text])[0]


class Counting:
    """A tokenizer that counts the characters that its batch call is given."""

    def __init__(self, tok):
        self.tok, self.given = tok, 0

    def encode_batch_fast(self, texts, **options):
        self.given += sum(map(len, texts))
        return self.tok.encode_batch_fast(texts, **options)


def lengths(e, texts):
    return list(e.lengths(texts, np.array([len(x.encode()) for x in texts])))


def test_counts_encode_equal_slices_of_a_batch_once():
    e, rng = tokens.Encoder(tokens.default_tokenizer()), random.Random(3)
    words = [f"w{i}rd" for i in range(200)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(100)]
    e.tok = Counting(e.tok)
    assert lengths(e, texts) == [len(x.ids) for x in library().encode_batch(texts, add_special_tokens=False)]
    assert e.tok.given < 0.05 * sum(map(len, texts))
    e.tok.given, texts = 0, [" ".join(f"{i}x{j}" for j in range(100)) for i in range(100)]
    assert lengths(e, texts) == [len(x.ids) for x in library().encode_batch(texts, add_special_tokens=False)]
    assert e.tok.given == sum(map(len, texts))


def test_counts_of_slices_are_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_NEW", 1)
    e, tok, rng = tokens.Encoder(tokens.default_tokenizer()), library(), random.Random(11)
    assert e.by_slice
    units = ["a", "Bc", "é", "한", "я", "9", "'s", "'", ".", "<|endoftext|>", "\u0301", "\u200b", *"     \n\t\r\x0b\x1c\x1f\x85\xa0\u1680\u2028\u3000\0"]
    texts = ["".join(rng.choices(units, k=rng.randrange(30))) for _ in range(20_000)]
    assert lengths(e, texts) == [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def test_counts_cut_no_texts_of_tokenizers_that_join_words(tmp_path):
    from tokenizers import AddedToken, normalizers, pre_tokenizers

    texts = ["a  b <x>  c  d", "  a b", "one two  one two"] * 3
    odd = [library() for _ in range(3)]
    odd[0].add_special_tokens([AddedToken("<x>", rstrip=True)])
    odd[1].normalizer = normalizers.Replace("  ", "_")
    odd[2].pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    for k, tok in enumerate(odd):
        tok.save(str(tmp_path / f"{k}.json"))
        e = tokens.Encoder(str(tmp_path / f"{k}.json"))
        assert not e.by_slice
        assert lengths(e, texts) == [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_words_are_those_of_whole_texts():
    e, tok, rng = tokens.encoder(tokens.default_tokenizer()), library(), random.Random(7)
    assert e.by_word
    letters = "abcXYZ 's'tre've   \n\t\r\x0b\x0c\x1c\x1f\x00 .,;!?0123456789éàÿſĀ'\"-_~^|=>"
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(4000)]
    texts += ["".join(rng.choices(letters + "<|endoftext|>×÷한я\u2028\xa0\x85", k=rng.randrange(1, 40))) for _ in range(1000)]
    want = [x.ids for x in tok.encode_batch(texts, add_special_tokens=False)]
    assert [memoryview(x).cast("I").tolist() for x in e.encode(texts)] == want


@pytest.mark.parametrize("unit", [" ", "\n", "x", "9", "'", "é", " \n", "\u3000", "한"])
def test_long_runs(unit):
    text = unit * (2_000_000 // len(unit)) + "end"
    got = next(iter(tokens.encoder(tokens.default_tokenizer()).encode([text])))
    assert memoryview(got).cast("I").tolist() == library().encode(text, add_special_tokens=False).ids


def test_known_words_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 10)
    e = tokens.Encoder(tokens.default_tokenizer())
    texts = [f"word{i} other{i} " + "z" * 100 for i in range(50)]
    assert [e.batch([t])[0] for t in texts] == tokens.Encoder(tokens.default_tokenizer()).batch(texts)
    assert len(e.known) < 20


def check_packing(spark, df, capacity):
    tok = library()
    got = packing.pack_documents(df, capacity=capacity).toPandas()
    want = Counter()
    for r in df.collect():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k, (s, n) in enumerate(packing.cut_document(len(ids), capacity)):
            want[(r["doc_id"] if r["doc_id"] is not None else -1, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
    have = Counter(zip(got.doc_id.fillna(-1).astype(int), got.piece, got.start, got.length, got.ids_crc32))
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = np.cumsum(g.length.to_numpy())
        assert ends[-1] <= capacity and (g.offset.to_numpy() == ends - g.length.to_numpy()).all()
    return got


def test_packing(spark, docs):
    got = check_packing(spark, docs, 2048)
    assert got.sequence_id.nunique() <= 1.02 * got.length.sum() / 2048 + 1
    check_packing(spark, awkward(spark), 64)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_plan_places_every_piece():
    rng = np.random.default_rng(1)
    for _ in range(5):
        counts = np.zeros(257, np.int64)
        np.add.at(counts, rng.integers(1, 257, 400), 1)
        groups = packing.plan(counts, 256)
        placed = sum(q * np.bincount(row, minlength=257) for q, row in groups)
        assert (placed == counts).all() and all(sum(row) <= 256 for _, row in groups)
        assert sum(q for q, _ in groups) <= 1.1 * (np.arange(257) * counts).sum() / 256 + 1


def fewest(items, capacity):
    """The least number of sequences, by trying everything."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(items):
            best[0] = len(room)
            return
        for k, r in enumerate(room):
            if r >= items[i] and r not in room[:k]:
                room[k] -= items[i]
                go(i + 1, room)
                room[k] += items[i]
        room.append(capacity - items[i])
        go(i + 1, room)
        room.pop()

    go(0, [])
    return best[0]


def test_plan_against_the_optimum():
    rng, more = np.random.default_rng(4), 0
    for _ in range(40):
        items = rng.integers(1, 65, 10)
        more += sum(q for q, _ in packing.plan(np.bincount(items, minlength=65), 64)) - fewest(items.tolist(), 64)
    assert 0 <= more <= 2


def test_nnls_solves_a_known_system():
    a = np.array([[1.0, 0, 1], [0, 1, 1], [1, 1, 0]])
    x = np.array([2.0, 0, 3])
    assert np.allclose(packing.nnls(a, a @ x, 20), x)


def brute_components(rows, words, num, den):
    sets, root = {}, {}
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    for i, text in rows:
        w = (text or "").encode().translate(lower).split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_equals_brute_force(spark, docs, local):
    for words, num in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, words=words, num=num).collect()}
        assert got == brute_components(list(zip(local.doc_id, local.text)), words, num, 100)


def test_jaccard_small_sets_and_chains(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):  # short texts of all sizes, edits of few bases, and a chain of gradual edits
        n = rng.choice([3, 4, 8, 12, 16, 20, 24, 30, 40])
        w = base[:n]
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(n)] = f"v{rng.randrange(5)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(120, 150):
        chain[i - 120] = f"d{i}"
        rows.append((i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, words=2, num=70).collect()}
    assert got == brute_components(rows, 2, 70, 100)


def test_jaccard_awkward(spark):
    got = jaccard.jaccard_components(awkward(spark), words=4, num=85).collect()
    assert len(got) == 14
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[0] == (0, 0) and by[1] == (0, 1) and by[8][1] == 7 and by[3] == (1, 3)
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_both_halves_of_the_join(spark, monkeypatch):
    """Many small sets over few words, so their lists are long and subsets pay, and large ones beside them."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.sample([f"w{j}" for j in range(9)], rng.choice([7, 8])))) for i in range(300)]
    for i in range(300, 360):
        w = [f"x{(i % 4) * 100 + j}" for j in range(60)]
        w[rng.randrange(60)] = f"y{i}"
        rows.append((i, " ".join(w)))
    chosen, old = [], jaccard.boundary
    monkeypatch.setattr(jaccard, "boundary", lambda *a: chosen.append(old(*a)) or chosen[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, words=1, num=85).collect()}
    assert got == brute_components(rows, 1, 85, 100) and chosen[0] > 0
    for rounds, meet in ((6, 0), (0, 0)):  # every round against pivots, and none
        monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
        monkeypatch.setattr(jaccard, "MEET", meet)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, words=1, num=85).collect()} == got


def test_components_end_with_stars(spark, monkeypatch):
    """Stars take one step, without another to see that nothing changes; chains and rings come out whole."""
    steps, old = [], jaccard.shared_checkpoint
    monkeypatch.setattr(jaccard, "shared_checkpoint", lambda df: steps.append(1) or old(df))
    star = spark.createDataFrame([(i, 0) for i in range(1, 50)], "a long, b long")
    assert {tuple(r) for r in jaccard.components(star).collect()} == {(i, 0) for i in range(1, 50)} and len(steps) == 1
    odd = spark.createDataFrame([(i, i + 1) for i in range(10, 30)] + [(41, 42), (42, 43), (43, 41), (50, 50)], "a long, b long")
    assert {tuple(r) for r in jaccard.components(odd).collect()} == {(i, 10) for i in range(11, 31)} | {(42, 41), (43, 41)}


def test_linking_sets_share_parts():
    rng = np.random.default_rng(2)
    for num, base in ((70, 12), (80, 40), (85, 300), (85, 5)):
        sets = []
        for _ in range(12):
            one = rng.integers(0, 2**64, base, np.uint64)
            for _ in range(6):  # copies with a few elements replaced, left out and added
                k = rng.integers(0, max(2, base // 8))
                sets.append(np.unique(np.concatenate((one[k:], rng.integers(0, 2**64, rng.integers(0, k + 1), np.uint64)))))
        n = np.array([len(x) for x in sets])
        keys = [[set(), set()] for _ in sets]
        found = jaccard.part_keys(np.concatenate(sets), n, num, 100)
        for t, (owner, key, _) in enumerate(found):
            for o, k in zip(owner, key):
                keys[o][t].add(int(k))
        links = 0
        for a in range(len(sets)):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b]))
                if 100 * common >= num * (n[a] + n[b] - common) and common < max(n[a], n[b]):
                    links += 1
                    assert any((k := len(keys[a][t] & keys[b][v])) >= found[t][2][a] and k >= found[v][2][b] for t in (0, 1) for v in (0, 1))
        assert links > 5 or base == 5


def test_candidates_grow_in_proportion(spark, monkeypatch):
    seen, old = [], jaccard.prefix_keys
    monkeypatch.setattr(jaccard, "prefix_keys", lambda m, *a: seen.append(m.count()) or old(m, *a))
    share = []
    for sf in ("0.01", "0.1"):
        found = jaccard.jaccard_components(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"), words=4, num=85)
        share.append(seen[-1] / found.filter("component_id <> doc_id").count())  # rows that have an earlier copy
    assert share[1] <= 1.5 * share[0]


def test_jaccard_null_and_repeated_ids(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(1, a), (1, b), (2, a), (None, b), (None, b), (None, "alone here by itself now"), (3, ""), (None, None)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, num=85).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter([(1, 4, 1), (1, 2, 1), (2, 4, 1), (None, 2, 1), (None, 2, 1), (None, 2, None), (3, 0, 3), (None, 0, None)])


def test_boundary_follows_cost():
    assert jaccard.boundary({20: 1000}, [3000] * 25, 85, 100) < 20
    assert jaccard.boundary({13: 1000}, [500_000 - 20_000 * s for s in range(25)], 85, 100) >= 13


def test_sharding(spark, docs):
    rows = docs.select("doc_id", "text")
    got = sharding.shard_rows(rows, shards=8).toPandas()
    assert sorted(got.doc_id) == sorted(docs.toPandas().doc_id)
    sizes = got.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s))))
    assert sizes.all() and np.ptp(got.groupby("shard").size()) <= 1
    again = sharding.shard_rows(rows, shards=8).toPandas()
    assert set(zip(got.doc_id, got.shard, got.slot)) == set(zip(again.doc_id, again.shard, again.slot))
    assert abs(np.corrcoef(got.sort_values(["slot", "shard"]).doc_id, np.arange(len(got)))[0, 1]) < 0.3
    odd = sharding.shard_rows(awkward(spark), shards=3)
    assert odd.count() == 14 and odd.columns == [*awkward(spark).columns, "shard", "slot"]
    assert sharding.shard_rows(empty(spark), shards=3).count() == 0


def test_one_key_of_many_rows(spark):
    """20,000 rows that share a null id, half of them equal, go over all buckets, and reruns agree whatever the settings."""
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 10_000, "same words").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source"), F.lit(9).alias("shard"), F.lit(9).alias("position"))
    got = sharding.shard_rows(rows, shards=8)
    assert got.columns == ["doc_id", "text", "source", "position", "shard", "slot"]
    first = Counter(map(tuple, got.collect()))
    bags = sharding.counted_in_parts(rows)
    assert bags.agg(F.max("_n"), F.sum("_n")).first()[:] == (64, 20_000)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert Counter(map(tuple, sharding.shard_rows(rows.repartition(3), shards=8).collect())) == first
        assert sharding.shuffled_positions(rows).agg(F.countDistinct("position"), F.max("position")).first()[:] == (20_000, 19_999)
        mixed = [tuple(r) for r in mixing.mix(rows).select("size", "copies").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(mixed) == 20_000 and abs(sum(s * c for s, c in mixed) - 60_000) <= 2  # 1.5 times 40,000 words
    assert Counter(mixed) == Counter(tuple(r) for r in mixing.mix(rows).select("size", "copies").collect())


def test_buckets_follow_bytes_and_maps_travel(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text"), F.create_map(F.lit("k"), F.col("id"), F.lit("a"), F.lit(1)).alias("m"), F.array(F.struct("id")).alias("list"))
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 100_000)
    seen = []
    keep = type(rows).repartitionById
    monkeypatch.setattr(type(rows), "repartitionById", lambda self, n, *c: seen.append(n) or keep(self, n, *c))
    got = sharding.shard_rows(rows, shards=5).collect()
    assert 30 <= seen[0] <= 40  # 3 MB of text
    assert {(r["doc_id"], r["m"]["k"], r["list"][0]["id"]) for r in got} == {(i, i, i) for i in range(3000)}
    assert sorted((r["shard"], r["slot"]) for r in got) == [(k, i) for k in range(5) for i in range(600)]
    with pytest.raises(ValueError):
        sharding.shard_rows(rows.select(F.array("m").alias("x")), shards=2)


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_sharding_query_moves_whole_records(spark, docs, local, monkeypatch, tmp_path):
    """The shards that the query writes hold all columns of all documents, and its rows are those of the shards."""
    monkeypatch.setattr(sharding, "scratch_folder", lambda spark, name: str(tmp_path / name))
    got = sharding.op3_sharding(spark, DATA).collect()
    files = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(map(tuple, files.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    texts = dict(zip(local.doc_id, [(t or "").encode() for t in local.text]))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in files.collect()}
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "rows", None) for r in got)


def test_targets(spark):
    rows = [("a", 100, 1), ("b", 1000, 1), (None, 50, 1), ("c", 10, 1)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long, n_docs long")).collect()}
    sizes, weights = {s: n for s, n, _ in rows}, {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}
    want, left, capped = {}, 1.5 * 1160, set()
    while True:  # by the wording: share, stop at the cap, reshare the excess
        open_ = [s for s in sizes if s not in capped]
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            capped.add(s)
            left -= want[s]
    assert got == pytest.approx(want)


def test_mixing(spark, docs):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count() and (got.copies >= 0).all() and (got.copies <= 2).all()
    assert all(g["size"].sum() == g.source_size.iloc[0] for _, g in got.groupby("source", dropna=False))
    again = mixing.mix(docs).toPandas()
    assert set(zip(got.doc_id, got.copies)) == set(zip(again.doc_id, again.copies))
    odd = mixing.mix(awkward(spark)).toPandas()
    assert len(odd) == 14 and mixing.mix(empty(spark)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixing_meets_its_targets(spark, sf):
    """Every source within 0.1 % of its target, or half of its shortest document, and each copy count next to the rate."""
    got = mixing.mix(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).toPandas()
    for _, g in got.groupby("source", dropna=False):
        target, rate = g.target.iloc[0], g.target.iloc[0] / g.source_size.iloc[0]
        assert abs((g["size"] * g.copies).sum() - target) <= max(0.001 * target, g["size"][g["size"] > 0].min() / 2 + 1)
        assert g.copies[g["size"] > 0].between(np.floor(rate - 1e-9), np.ceil(rate + 1e-9)).all()


def test_menders_leave_as_little_as_the_best_of_all_changes(spark):
    docs = [(600, 1), (300, 1), (100, 0), (40, 0), (7, 1), (3, 0)]
    settled = spark.createDataFrame([("s", u, u, w, 0, bit) for u, (w, bit) in enumerate(docs)], "source string, u long, id long, w long, base long, bit long")
    for missed in (310, -103, 2, -33, 260, 900, -200):
        p = -missed / 10_000 if missed < 0 else 1 - missed / 10_000  # rounded down, or up
        last = spark.createDataFrame([("s", 99, 99, 10_000, 0, p)], "source string, u long, id long, w long, base long, p double")
        turned = {r["u"]: r["turn"] for r in mixing._menders(settled, last).collect()}
        assert all(t == 1 - 2 * docs[u][1] for u, t in turned.items())
        best = min(abs(missed + sum(docs[u][0] * (1 - 2 * docs[u][1]) for u in range(6) if k >> u & 1)) for k in range(64))
        assert abs(missed + sum(docs[u][0] * t for u, t in turned.items())) <= best + 10, missed


def test_html():
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='cookie-notice'>We use cookies, accept them, please, now.</div><article><h1>Head &amp; line</h1><p>One,\n two<br>three.<p><b>Four</b> &eacute;</p><div class=ad>Buy</div><section id=comments><p>Nice, nice, nice, nice!</p></section></article><aside>More</aside><footer>&copy; x</footer></body></html>"
    assert html.main_text(page) == "Head & line\n\nOne, two three.\n\nFour é"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
    body = "".join(f"<p>Sentence {i}, with a comma, and some more words to count.</p>" for i in range(5))
    assert html.main_text(f"<div id=menu>{body}</div><div>{body}</div><div><a href=y>links, links, links</a></div>").count("\n\n") == 4
    assert html.main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_html_keeps_wrappers_and_siblings():
    body = [f"Sentence {i}, with a comma, and some more words to count." for i in range(6)]
    ps = "".join(f"<p>{x}</p>" for x in body)
    reader = "<div id=comments><article class=comment><p>Nice, nice, nice!</p></article></div>"
    for wrap in ("site has-sidebar", "no-sidebar", "post comments-open", "page has-footer", "widget"):
        for inner in (ps, f"<article>{ps}</article>", f"<main>{ps}</main>", f"<div class='page has-sidebar'>{ps}</div>"):
            page = f"<body><div class='{wrap}'>{inner}{reader if inner[1] in 'am' else ''}</div><div class=share><p>Share it</p></div></body>"
            assert html.main_text(page) == "\n\n".join(body), (wrap, inner[:9])
    mixed = f"<body><div><div>{ps}</div><h4>More</h4><ul><li>first thing</li><li>second</li></ul><table><tr><td>cell</td></tr></table><dl><dt>word</dt><dd>sense</dd></dl><ul><li><a href=x>link</a></li></ul><div>Short end</div><div class=menu><p>Menu</p></div></div></body>"
    assert html.main_text(mixed) == "\n\n".join([*body, "More", "first thing", "second", "cell", "word", "sense", "Short end"])


def test_html_words_of_classes_and_depth():
    ps = "".join(f"<p>Sentence {i}, with a comma, and some more words to count.</p>" for i in range(5))
    for kept in ("side-by-side", "related", "alert-free", "notice-board-history", "shareholder", "skip-level"):
        if kept != "related":
            assert html.main_text(f"<article>{ps}<div class='{kept}'><p>Inner text, kept.</p></div></article>").endswith("Inner text, kept."), kept
    for cut in ("related", "related-links", "share-buttons", "cookie-notice", "notice", "left-sidebar", "comments", "reply-form", "ad"):
        assert not html.main_text(f"<article>{ps}<div class='{cut}'><p>Inner text, cut.</p></div></article>").endswith("cut."), cut
    deep = "<div>" * 5000 + "<script>var x = 1;</script><p>deep, text</p>" + "</div>" * 5000
    assert html.main_text(deep) == "deep, text"
    assert html.main_text("<div>" * 50_000 + "<p>a, b</p>" + "</section></i>" * 50_000) == "a, b"


def test_html_keeps_pages_in_forms_and_bare_text():
    ps = "".join(f"<p>Sentence {i}, with a comma, and some more words to count.</p>" for i in range(5))
    want = html.main_text(f"<article>{ps}</article>")
    menu = "<nav><a href=x>Home</a></nav><form id=search><p>Search, here</p><input name=q></form>"
    for inner in (f"<article>{ps}</article>", f"<main>{ps}</main>", f"<div>{ps}</div>"):
        for wrap in ("<form id=aspnetForm>{}</form>", "<fieldset>{}</fieldset>", "<aside>{}</aside>", "<div style='display: none'>{}</div>", "<div hidden>{}</div>", "<div role=dialog>{}</div>", "<form><div class=page><form>{}</form></div></form>"):
            assert html.main_text(wrap.format(menu + inner + "<select><option>one</option></select>")) == want, (wrap, inner[:9])
        assert html.main_text(f"{inner}<form><p>Your mail, please</p></form><aside><p>More, more</p></aside><div hidden><p>x, y</p></div>") == want
    teasers = "<aside>" + "<article><h3><a href=x>Another, page</a></h3><p>More</p></article>" * 2 + "</aside>"
    assert html.main_text(f"<div>{ps}</div>{teasers}") == html.main_text(f"<form><div>{ps}</div>{teasers}</form>") == want
    around = f"<div>Intro text <div>{ps}</div> closing <b>text</b></div>"
    assert html.main_text(around) == f"Intro text\n\n{want}\n\nclosing text"
    assert html.main_text(f"<div>First <div><div>{ps}</div></div> last</div>") == f"First\n\n{want}\n\nlast"
    assert html.main_text(f"<div><a href=x>Home</a> <a href=y>About</a><div>{ps}</div></div>") == want
    lines = "<br>".join(f"Line {i}, of an article, that has no paragraphs" for i in range(6))
    flat = " ".join(f"Line {i}, of an article, that has no paragraphs" for i in range(6))
    assert html.main_text(f"{menu}<div class=text>{lines}</div><footer>Foot</footer>") == flat
    assert html.main_text(f"<table><tr><td><a href=x>Home</a></td><td>{ps}</td></tr></table>").endswith(want)


def slow_article(page):
    """What the pages of the test tables hold as article, by cutting strings: blocks between the tags of the article."""
    import html as escapes
    import re

    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->|<div class=.ad.>.*?</div>", "", inner, flags=re.S)
    blocks = re.split(r"</?(?:p|h1|h2|ul|ol|li|div|blockquote)\b[^>]*>", inner)
    texts = [" ".join(escapes.unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_html_equals_a_slow_extractor(spark):
    got = html.op5_html_extraction(spark, DATA).toPandas().set_index("page_id").text
    pages = spark.read.parquet(f"{DATA}/pages.parquet").toPandas()
    for i, page in zip(pages.page_id, pages.html):
        assert got[i] == slow_article(page), i


def test_html_awkward(spark):
    rows = [(1, None, "m"), (2, "", "m"), (3, "<p>a, b</p>", "m"), (3, "<p>a, b</p>", "m"), (None, "x", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, main_text string")
    assert Counter(map(tuple, html.extract(df).collect())) == Counter([(1, None, ""), (2, "", ""), (3, "<p>a, b</p>", "a, b"), (3, "<p>a, b</p>", "a, b"), (None, "x", "x")])
    assert html.extract(df.limit(0)).count() == 0


def test_html_query(spark):
    got = html.op5_html_extraction(spark, DATA).toPandas()
    assert (got.n_chars == got.text.str.len()).all() and (got.n_chars > 0).all()


def test_audio_round_trip(spark):
    odd = awkward(spark)
    got = audio.audio_digest(audio.store_audio(odd)).collect()
    want = {}
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        pay = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[r["doc_id"]] = (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
    assert len(got) == 14 and all((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[r["doc_id"]] for r in got)
    media = audio.store_audio(odd).unionByName(spark.createDataFrame([(99, 0, b"junk"), (98, 0, None)], "doc_id long, n_bytes long, media binary"))
    pcm = {r["doc_id"]: r for r in audio.to_pcm(media).collect()}
    assert pcm[99]["pcm"] is None and pcm[99]["error"] and pcm[98]["pcm"] is None
    fmt, data = audio.read_wav(pcm[3]["pcm"])
    assert fmt["rate"] == 16000 and len(data) == 2 * 128


def test_audio_query_equals_brute_force(spark, local):
    got = {r["doc_id"]: r for r in audio.op7_media_audio(spark, DATA).collect()}
    assert len(got) == len(local)
    for i, t in list(zip(local.doc_id, local.text))[:40]:
        raw = (t or "").encode()
        pay = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = audio.write_wav(pay)
        pcm = audio.MULAW_LINEAR[np.frombuffer(pay, np.uint8)].astype(float)
        up = np.rint(np.interp(np.arange(2 * len(pcm)) / 2, np.arange(len(pcm)), pcm)).astype("<i2")
        x = up.astype(np.int64)
        feature = f"rate=16000;n={len(up)};peak={abs(x).max()};rms={(int((x * x).sum()) / len(up)) ** 0.5:.3f};zcr={int(((x[1:] < 0) != (x[:-1] < 0)).sum()) / len(up):.5f}"
        want = (len(media), hashlib.sha256(media).hexdigest(), feature, 2 * len(up), hashlib.sha256(up.tobytes()).hexdigest())
        assert tuple(got[i][c] for c in ("media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256")) == want


def test_audio_query_keeps_its_pcm(spark, local, monkeypatch, tmp_path):
    """The query writes the resampled PCM of every text; broken media and several batches give what audio_digest gives."""
    monkeypatch.setattr(audio, "scratch_folder", lambda spark, name: str(tmp_path / name))
    got = {r["doc_id"]: r for r in audio.op7_media_audio(spark, DATA).collect()}
    files = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "pcm")).collect()}
    assert len(files) == len(local) == len(got)
    for i, r in got.items():
        fmt, data = audio.read_wav(bytes(files[i]["pcm"]))
        assert (fmt["codec"], fmt["rate"], fmt["bits"]) == (audio.PCM, 16_000, 16)
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r["pcm_bytes"], r["pcm_sha256"]) and len(data) == 4 * r["payload_bytes"]
    monkeypatch.setattr(audio, "BATCH_BYTES", 1000)
    bad = spark.createDataFrame([(98, 3, None), (99, 3, b"\0" * 99)], "doc_id long, n_bytes long, media binary")
    odd = audio.store_audio(awkward(spark)).unionByName(bad)
    assert Counter(audio.pcm_features(audio.convert_audio(odd)).collect()) == Counter(audio.audio_digest(odd).collect())


def test_audio_query_stores_media_and_pcm_once(spark, monkeypatch, tmp_path):
    """All that is stored, checksums and all, is media and PCM of every text, in less than 1.5 times the documents' file."""
    monkeypatch.setattr(audio, "scratch_folder", lambda spark, name: str(tmp_path / name))
    data = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in audio.op7_media_audio(spark, data).collect()}
    files = spark.read.parquet(str(tmp_path / "pcm")).drop("pcm").collect()
    assert len(files) == len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all((len(r["media"]), hashlib.sha256(r["media"]).hexdigest()) == (got[r["doc_id"]]["media_bytes"], got[r["doc_id"]]["media_sha256"]) for r in files)
    stored = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    assert stored <= 1.5 * os.path.getsize(f"{data}/documents.parquet")


def test_pcm_that_are_not_those_of_the_media(spark):
    rows = {r["doc_id"]: r.asDict() for r in audio.convert_audio(audio.store_audio(spark.createDataFrame([(i, "abc" * 30) for i in range(6)], "doc_id long, text string"))).collect()}
    pcm = bytes(rows[0]["pcm"])
    for i, p in ((1, pcm[:-1] + b"x"), (2, audio.write_wav(pcm[-256:], codec=audio.PCM, rate=16000, bits=16)), (3, audio.write_wav(pcm[-512:] + b"ab", codec=audio.PCM, rate=16000, bits=16)), (4, None), (5, b"junk")):
        rows[i]["pcm"] = p
    changed = spark.createDataFrame([tuple(r.values()) for r in rows.values()], "doc_id long, n_bytes long, media binary, pcm binary, error string")
    got = {r["doc_id"]: r for r in audio.pcm_features(changed).collect()}
    assert got[0]["error"] is None and got[0]["pcm_bytes"] == 512
    assert all(got[i]["feature"] is None and got[i]["error"] for i in range(1, 6))


def test_digest_of_null_and_broken_media(spark):
    good = audio.store_audio(spark.createDataFrame([(1, "abc")], "doc_id long, text string"))
    bad = spark.createDataFrame([(2, 3, None), (3, 3, b""), (4, 3, b"RIFFxxxxWAVEfmt "), (5, 3, b"\0" * 99)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in audio.audio_digest(good.unionByName(bad)).collect()}
    assert got[1]["payload_bytes"] == 64 and got[1]["error"] is None
    assert all(got[i]["payload_sha256"] is None and got[i]["n_bytes"] == 3 and got[i]["error"] for i in (2, 3, 4, 5))


def test_resampling_in_slices(monkeypatch):
    fmt = {"codec": audio.MULAW, "rate": 8000, "block": 1, "bits": 8}
    data = memoryview(np.random.default_rng(1).integers(0, 256, 10_007, np.uint8).tobytes())
    for to in (16_000, 11_025, 4000, 8000):
        whole = np.concatenate(list(audio.resampled(fmt, data, to)))
        pcm = audio.MULAW_LINEAR[np.frombuffer(data, np.uint8)].astype(float)
        exact = np.interp(np.arange(len(whole)) * (8000 / to), np.arange(len(pcm)), pcm)
        assert np.abs(whole - exact).max() <= 0.51
        monkeypatch.setattr(audio, "FEATURE_SAMPLES", 97)
        assert (np.concatenate(list(audio.resampled(fmt, data, to))) == whole).all()
        monkeypatch.undo()


def test_long_audio_takes_little_memory():
    import tracemalloc

    data = memoryview(bytes(24 << 20))
    tracemalloc.start()
    n = audio.pcm_digest({"codec": audio.MULAW, "rate": 8000, "block": 1, "bits": 8}, data, 16_000)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4 * len(data) and peak < 200 << 20


def test_audio_codecs():
    assert [int(audio.MULAW_LINEAR[c]) for c in (0x00, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(audio.ALAW_LINEAR[c]) for c in (0x55, 0xD5, 0x2A, 0xAA)] == [-8, 8, -32256, 32256]
    block = bytes([100, 0, 0, 0]) + bytes([0x77, 0x8F]) * 30
    one = audio.decode_adpcm(block, 64)
    assert len(one) == 121 and one[0] == 100 and (audio.decode_adpcm(block * 3, 64) == np.tile(one, 3)).all()
    now, index, slow = 100, 0, [100]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.IMA_STEPS[index])
            diff = step // 8 + (code & 1) * (step // 4) + (code >> 1 & 1) * (step // 2) + (code >> 2 & 1) * step
            now = max(-32768, min(32767, now - diff if code & 8 else now + diff))
            index = max(0, min(88, index + int(audio.IMA_INDEX[code & 7])))
            slow.append(now)
    assert one.tolist() == slow


def test_fingerprints(spark, docs, local):
    got = fingerprint.op8_fingerprints(spark, DATA).toPandas().set_index("doc_id")
    order = local.sort_values("doc_id", ascending=False)
    texts = order.text.fillna("").tolist()
    error = []
    for i, a, b in zip(order.doc_id, texts, texts[1:] + texts[:1]):
        e = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        assert got.edited_sha256[i] == hashlib.sha256(e.encode()).hexdigest()
        x, y = set(shingle_hashes(a, 5).tolist()), set(shingle_hashes(e, 5).tolist())
        error.append(got.near_edited[i] - (len(x & y) / len(x | y) if x | y else 1))
    assert len(got) == len(local) and abs(np.mean(error)) < 0.02 and np.abs(error).max() < 0.25
    odd = fingerprint.fingerprints(awkward(spark)).collect()
    assert len(odd) == 14 and fingerprint.fingerprints(empty(spark)).count() == 0
    assert fingerprint.likeness(b"", b"") == 1.0 and fingerprint.likeness(b"", fingerprint.fingerprint("a b")) == 0.0


def brute_neighbours(rows):
    """(doc_id, text, next text) by the order that the query states."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = sorted(df.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), -r["h"], r["text"]))
    return [(r["doc_id"], r["text"], order[(i + 1) % len(order)]["text"]) for i, r in enumerate(order)]


@pytest.mark.parametrize("kind", ["awkward", "one", "none", "same id"])
def test_fingerprint_query_on_awkward_tables(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(fingerprint, "STRETCH_DOCS", 4)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(50)]
    some = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 30)))
    rows = {"one": [(5, "only this one here, long enough")], "none": [], "same id": [(7, some()) for _ in range(60)] + [(8, "b"), (6, None)]}.get(kind)
    if rows is None:
        rows = [(i // 2, some()) for i in range(60)] + [(None, some()) for _ in range(40)] + [(3, None), (3, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op8_fingerprints(spark, str(tmp_path)).collect()
    want = Counter()
    for i, a, b in brute_neighbours(rows) if rows else []:
        e = fingerprint.edited(a, b)
        x, y, z = map(fingerprint.fingerprint, (a, e, b))
        want[(i, len(a), hashlib.sha256(e.encode()).hexdigest(), x.hex(), y.hex(), fingerprint.likeness(x, y), fingerprint.likeness(x, z))] += 1
    assert Counter(map(tuple, got)) == want


def test_trees_equal_a_slow_walk_and_search():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)).round(1)
    y = (x[:, 1] + x[:, 3] ** 2 + rng.normal(size=400) > 1).astype(float)
    model = quality.fit(x, y)
    assert len(model["leaf"]) == quality.TREES

    def walk(row):
        total = float(model["base"])
        for feature, threshold, leaf in zip(model["feature"], model["threshold"], model["leaf"]):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(quality.predict(model, x), [walk(r) for r in x])
    # the first split is the best of all cuts at the edges of the bins
    p = 1 / (1 + np.exp(-float(model["base"])))
    g, h = p - y, np.full(400, p * (1 - p))
    best = (-1.0, 0, 0.0)
    for f in range(5):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            left = x[:, f] <= cut
            if h[left].sum() >= 1 and h[~left].sum() >= 1:
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + quality.LAMBDA) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + quality.LAMBDA)
                best = max(best, (gain, -f, -cut))
    assert (model["feature"][0, 0], model["threshold"][0, 0]) == (-best[1], -best[2])
    assert ((quality.predict(model, x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_quality_and_language_of_null_and_repeated_ids(spark, tmp_path):
    rows = [(i % 40, "some plain words, and more of them. " * (i % 7 + 1), "en", "s", 1) for i in range(80)] + [(None, "no id", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (quality.op9_quality_classifier, langid.op10_language_id):
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == 81 and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in got)
    twice = langid.predict(spark.createDataFrame([("a", 1.0)], "text string, lang_score double"), langid.Model({}))
    assert twice.columns == ["text", "lang_pred", "lang_score"] and twice.first()[:] == ("a", "und", 0.0)


def test_quality(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality.op9_quality_classifier(spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert np.mean([(good > b).mean() for b in bad]) > 0.95
    model = quality.train(big, labels)
    odd = quality.score(awkward(spark), model).collect()
    assert len(odd) == 14 and all(0 <= r["score"] <= 1 for r in odd)
    none = quality.train(empty(spark), labels.limit(0))
    assert quality.score(docs.select("doc_id", "text"), none).count() == docs.count()


def test_language(spark):
    got = langid.op10_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.95
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    by = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.predict(awkward(spark), model).collect()}
    assert by[0] == by[1] == by[2] == by[10] == ("und", 0.0) and by[9][0] != "und"
    assert {r["lang_pred"] for r in langid.predict(awkward(spark), langid.train(empty(spark))).collect()} == {"und"}


def slow_phrases(text, known):
    """Longest matches, one after the other; a symbol that is not known is a phrase of its own."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in known:
            end += 1
        n, at = n + 1, end
    return n


@pytest.mark.parametrize("cells", [1 << 24, 0])
def test_cross_parsing_equals_brute_force(monkeypatch, cells):
    monkeypatch.setattr(langid, "DENSE_CELLS", cells)
    rng = random.Random(cells)
    words = {"x": "the cat sat on mat and dog log", "y": "le chat est sur la table et chien aussi", "z": "kot je na stole a pes také"}
    texts = {k: " ".join(rng.choices(w.split(), k=150)) for k, w in words.items()}
    model = langid.Model(texts)
    model.build()
    assert (model.parsers[0].table is None) == (cells == 0)
    probes = ["le d chat d sur d la d table d le d chien", "chatdchatd" * 9, "zzz the", "a", "", "?", "ж", "жж the ж"]
    probes += ["".join(rng.choices("abcdefghijlmnotuwxyzéж  .", k=rng.randrange(300))) for _ in range(150)]
    probes += [" ".join(rng.choices(" ".join(words.values()).split(), k=rng.randrange(80))) for _ in range(150)]
    codes = [model.alphabet.codes(t) for t in probes]
    known = ["".join(chr(200 + c) for c in model.alphabet.codes(t)) for t in model.texts.values()]
    want = [[slow_phrases("".join(chr(200 + x) for x in c), k) for k in known] for c in codes]
    assert model.phrases(codes).tolist() == want


def test_language_tells_scripts_apart():
    rng = random.Random(5)
    for lo, hi in ((0x430, 0x450), (0x5D0, 0x5EB), (0x905, 0x94D), (0x4E00, 0x5600), (0xAC00, 0xB800), (0x1EA0, 0x1EF9)):
        letters = [chr(c) for c in range(lo, hi)]
        words = {x: ["".join(rng.choices(letters, k=rng.choice([2, 3, 5]))) for _ in range(60)] for x in ("x", "y")}
        text = lambda x, n=60: " ".join(rng.choices(words[x], k=n))
        sample = [(x, text(x)) for x in words for _ in range(40)]
        model = langid.fit(sample)
        probes = [(x, text(x, 20)) for x in words for _ in range(50)]
        got = model.predict([t for _, t in probes])
        assert np.mean([x == g for (x, _), (g, _) in zip(probes, got)]) > 0.95, hex(lo)


def test_large_alphabets_give_the_same_phrases(monkeypatch):
    rng = random.Random(6)
    texts = {x: "".join(chr(rng.choice([0x20, 0x41, 0x2019, rng.randrange(0x4E00, 0x5000)])) for _ in range(3000)) for x in "xy"}
    dense, keyed = langid.Model(texts), langid.Model(texts)
    dense.build()
    monkeypatch.setattr(langid, "DENSE_CELLS", 0)
    keyed.build()
    assert dense.parsers[0].table is not None and keyed.parsers[0].table is None
    codes = [dense.alphabet.codes(texts["x"][i : i + 700] + "яz") for i in range(0, 3000, 500)]
    assert (dense.phrases(codes) == keyed.phrases(codes)).all()
    assert dense.alphabet.codes("“a—b”").tolist() == [*dense.alphabet.codes("a b "[:3]).tolist(), 0]
    assert [g[0] for g in dense.predict(["“—”", "\u0301\ufe0f"])] == ["und", "und"]


def test_every_language_is_learned_from_whole_texts(spark):
    """300 languages; the telling words stand at the end of long texts."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(9)
    own = {f"l{i:03d}": ["".join(rng.choices(letters, k=6)) for _ in range(8)] for i in range(300)}
    # ids whose remainder is 2 are left out of training
    rows = [(20 * i + k, "start of all texts " * 20 + " ".join(rng.choices(ws, k=120)), x) for i, (x, ws) in enumerate(own.items()) for k in range(6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 300
    few = list(own)[::30]
    got = model.predict([" ".join(rng.choices(own[x], k=40)) for x in few])
    assert np.mean([g == x for (g, _), x in zip(got, few)]) > 0.9


def test_near_duplicates_of_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(1, a), (1, b), (2, a), (None, b), (None, b), (None, "alone here by itself now"), (3, ""), (4, ""), (1, a)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in p.near_duplicates(spark, df, DATA).collect())
    assert got == Counter([(1, a), (1, b), (None, "alone here by itself now"), (3, ""), (4, "")])
    mixed = p.mixture(spark, df, DATA).collect()
    assert mixed and {(r["doc_id"], r["text"]) for r in mixed} <= set(rows)


def test_pipeline(spark):
    import corpus_pipeline as p

    source = spark.read.parquet(f"{DATA}/documents.parquet")
    out = p.run(spark, DATA).toPandas()
    assert set(out.doc_id) <= {r["doc_id"] for r in source.select("doc_id").collect()} and len(out)
    kept = p.near_duplicates(spark, source, DATA).toPandas()
    brute = brute_components([(r["doc_id"], r["text"]) for r in source.collect()], 5, 80, 100)
    assert sorted(kept.doc_id) == sorted(i for i, (_, c) in brute.items() if c == i) and list(kept.columns) == p.COLUMNS
    mixed = p.mixture(spark, source, DATA).toPandas()
    ids = {r["_row"]: r["doc_id"] for r in p.keyed(source).collect()}
    taken = {ids[r["_row"]]: r["copies"] for r in mixing.mix(p.keyed(source), id_col="_row").collect()}
    assert len(ids) == source.count() and Counter(mixed.doc_id) == Counter({i: n for i, n in taken.items() if n})
    odd = awkward(spark)
    known = {(r["doc_id"], r["text"]) for r in odd.collect()}
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, odd, DATA)
        assert got.columns == p.COLUMNS and {(r["doc_id"], r["text"]) for r in got.collect()} <= known, name
    assert p.pack(spark, odd, DATA).count() >= 14
    groups = defaultdict(int)
    for r in out.itertuples():
        groups[r.sequence_id] += r.length
    assert max(groups.values()) <= 2048
