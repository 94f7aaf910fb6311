"""Phrase collocations, hard negatives and chat formatting against brute force, their SQL, and awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, collocation, negatives, registry, tokens

DATA = "/root/testdata/sf0.001"
NEW = ["op11_collocations", "op12_hard_negatives", "op13_chat_formatting"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [x[0] for x in want.description]
    got = registry.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


# --- collocations


def slow_collocations(rows, max_words, min_count, top, held):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            for i in range(len(ws)):
                for k in range(1, max_words + 1):
                    if i + k <= len(ws):
                        f[lang or "und"][tuple(ws[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        found = {g: c for g, c in count.items() if len(g) > 1 and c >= min_count}
        best = []
        for g, a in found.items():
            inside = any(len(x) > len(g) and 100 * c >= held * a and any(x[i : i + len(g)] == g for i in range(len(x))) for x, c in found.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (count[g[:k]] * count[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), count[g[:k]], count[g[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return Counter(out)


def mined(docs, **kw):
    return Counter(map(tuple, collocation.mine_collocations(docs, **kw).collect()))


@pytest.mark.parametrize("pairs", [4_000_000, 0])
@pytest.mark.parametrize(("max_words", "min_count", "top", "held"), [(5, 3, 7, 100), (3, 2, 50, 60), (2, 1, 9, 100)])
def test_collocations_equal_brute_force(spark, monkeypatch, pairs, max_words, min_count, top, held):
    monkeypatch.setattr(collocation, "BROADCAST_PAIRS", pairs)
    rng = random.Random(max_words)
    words = ["a", "B", "c", "de", "　x", "é", "É", "q\x00r", "a\xa0b"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "\r", "\x0b", "!? "]) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None])) for _ in range(40)]
    rows += [(None, "en"), ("", None), (" \t", "fr"), ("...", "en"), ("one same row of words", "en")] + [("one same row of words", "en")] * 5
    docs = spark.createDataFrame([(t, x, "q", "w", 1) for t, x in rows], "text string, lang string, phrase string, f string, w0 long")
    kw = {"max_words": max_words, "min_count": min_count, "top": top, "held_percent": held}
    assert mined(docs, **kw) == slow_collocations(rows, max_words, min_count, top, held)


def test_collocations_of_a_very_long_text_and_of_none(spark):
    docs = spark.createDataFrame([("new york city " * 40_000, "en"), ("x. " * 1000, None)], "text string, lang string")
    got = {r["phrase"]: (r["a"], r["n"]) for r in collocation.mine_collocations(docs).collect()}
    assert got == {"new york city": (40_000, 120_000), "new york city new york": (39_999, 120_000), "york city new york city": (39_999, 120_000), "city new york city new": (39_998, 120_000)}
    assert collocation.mine_collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    with pytest.raises(ValueError):
        collocation.mine_collocations(docs, max_words=1)


def test_products_beyond_64_bits_are_exact(spark):
    counts = spark.createDataFrame([("en", "a", 3_000_000_019), ("en", "b", 2_000_000_011), ("en", "a b", 1_000_000_007)], "lang string, phrase string, f long")
    sizes = spark.createDataFrame([("en", 99_999_999_999_999_997)], "lang string, n long")
    got = collocation.scored(counts, sizes, 100).first()
    assert got["score"] == 1000 * 1_000_000_007 * 99_999_999_999_999_997 // (3_000_000_019 * 2_000_000_011)


# --- hard negatives

VECTORS = "vec_id long, label int, vector array<bigint>, id string, key string, score string, anchor string"


def slow_negatives(rows, positives=5, most=5, low=80, high=100):
    rows = sorted({(i, x, tuple(v)) for i, x, v in rows if i is not None and x is not None and v is not None and None not in v}, key=str)

    def dot(v, w):
        return sum(p * q for p, q in zip(v, w))

    out = Counter()
    for a in rows:
        if a[0] % 10:
            continue
        scored = [(-dot(a[2], r[2]), r[0], r[1]) for r in rows]
        best = sorted(s[:2] for s, r in zip(scored, rows) if r[1] == a[1] and r[0] != a[0])[:positives]
        for p, pid in best:
            found = sorted(s[:2] for s in scored if s[2] != a[1] and low * -p <= 100 * -s[0] <= high * -p)[:most]
            out.update((a[0], pid, k, nid, -p, -n) for k, (n, nid) in enumerate(found, 1))
    return out


def negatives_of(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y", "z", "q") for r in rows], VECTORS)
    return Counter(map(tuple, negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect()))


def cluster(seed, n, width, big=60):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-big, big, (5, width))
    return [(i, int(rng.integers(0, 3)), (centres[rng.integers(0, 5)] + rng.integers(-9, 9, width)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("rows", "anchors", "chunk"), [(8192, 1024, 2048), (40, 7, 16)])
def test_negatives_equal_brute_force(spark, monkeypatch, rows, anchors, chunk):
    for name, value in (("ROW_BLOCK", rows), ("ANCHOR_BLOCK", anchors), ("CHUNK", chunk)):
        monkeypatch.setattr(negatives, name, value)
    data = cluster(3, 300, 8)
    assert negatives_of(spark, data) == slow_negatives(data)
    assert negatives_of(spark, data, positives=2, negatives=3, low=50, high=90) == slow_negatives(data, 2, 3, 50, 90)


def test_negatives_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_BLOCK", 20)
    data = cluster(4, 60, 3) + [(None, 1, [1, 2, 3]), (70, None, [1, 2, 3]), (71, 1, None), (80, 1, [1, None, 3]), (90, 1, []), (91, 2, [4]), (100, 1, [9, 9, 9, 9])]
    data += [(200 + i, i % 3, [5, 5, 5]) for i in range(60)]  # one vector for many rows
    data += [data[0]] * 9 + [(0, 1, [7, 7, 7]), (10, 2, [0, 0, 0])]  # repeated rows, an id with several vectors
    assert negatives_of(spark, data) == slow_negatives(data)
    assert negatives_of(spark, []) == Counter()
    assert negatives_of(spark, [(1, 1, [1])]) == Counter()


def test_large_scores_are_exact(spark):
    rng = random.Random(5)
    data = [(i, i % 2, [rng.randrange(2**29, 2**30) for _ in range(3)]) for i in range(30)]
    assert negatives_of(spark, data) == slow_negatives(data)
    with pytest.raises(ValueError):
        negatives_of(spark, [(0, 1, [2**40])])


def test_brackets_hold_and_prune():
    data = np.array([v for _, _, v in cluster(6, 400, 16, 200)])
    pivots = negatives.Pivots(data[::4], (data.astype(float) ** 2).sum(1).max())
    q, x = data[:50], data
    least, greatest = pivots.brackets(q, pivots.of_anchors(q), pivots.of_rows(x))
    s = q @ x.T
    assert (least <= s).all() and (s <= greatest).all()
    best = np.sort(s, 1)[:, -5:-4]
    assert (greatest < best).mean() > 0.3  # these are not multiplied out


def test_cell_blocks():
    first, parts, n = negatives.cell_blocks({0: 3, 1: 4, 3: 25, 4: 1}, 5, 10)
    assert (first, parts, n) == ([0, 0, 0, 1, 4], [1, 1, 1, 3, 1], 5)


# --- chat


def test_escapes_are_reversible():
    rng = random.Random(8)
    pieces = [*chat.CONTROL, "\\", "[", "<", "[\\INST]", "[\\\\/INST]", "INST]", "/s>", "a", "\n", "한"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)
    turns = [("".join(rng.choices(pieces, k=3)), "".join(rng.choices(pieces, k=5))) for _ in range(300)]
    assert chat.turns_of(chat.render(turns)[0]) == turns


def test_masks_equal_a_walk_over_characters():
    rng = random.Random(9)
    enc = chat.ChatEncoder(tokens.default_tokenizer())
    for _ in range(100):
        turns = [(rng.choice(["user", "assistant", "", "system"]), "".join(rng.choices(["word", " ", "\n", "  ", "é", "🙂", "한글", *chat.CONTROL], k=rng.randrange(6)))) for _ in range(rng.randrange(6))]
        text, spans = chat.render(turns)
        ids, starts, ends = enc.encode(text)
        inside = np.zeros(len(text) + 1, bool)
        for a, b in spans:
            inside[a:b] = True
        mask = chat.mask_tokens(spans, starts, ends)
        assert mask.tolist() == [bool(inside[a:b].any()) for a, b in zip(starts, ends)]
        assert mask.tolist() == [bool(inside[a:b].all()) and b > a for a, b in zip(starts, ends)]  # none reaches over an end
        assert enc.learned(ids, mask) == [t for r, t in turns if r == "assistant" and t]
        assert b"".join(enc.bytes[i] for i in ids).decode() == text


def test_slices_of_long_turns_give_the_same_ids(monkeypatch):
    enc = chat.ChatEncoder(tokens.default_tokenizer())
    text, _ = chat.render([("user", "some words, more words " * 9000), ("assistant", "x" * 200_000)])
    ids, starts, ends = enc.encode(text)
    want = enc.tok.encode(text, add_special_tokens=False)
    assert ids.tolist() == want.ids and list(zip(starts.tolist(), ends.tolist())) == want.offsets


CHAT = "conv_id long, turn long, role string, text string, pid string, segment string, whole string"


def slow_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = Counter()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        size = sum(len(chat.escape(r)) + len(chat.escape(x)) + 17 for *_, r, x in turns)
        out[c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size] += 1
    return out


@pytest.mark.parametrize("segment", [1 << 20, 40])
def test_chat_of_awkward_rows(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT_CHARS", segment)
    rng = random.Random(11)
    texts = [None, "", "a", "two words", " lead", "\n\n", "[INST]", "</s>[\\INST] ok", "<|endoftext|>", "한국어 🙂", "é" * 50]
    rows = [(rng.choice([None, 1, 2, 3, 7]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "assistant", None, "ro[INST]le"]), rng.choice(texts)) for _ in range(200)]
    rows += [rows[0]] * 5 + [(50, t, "assistant" if t % 2 else "user", f"turn {t} " * 20) for t in range(300)] + [(60, 0, "assistant", "long " * 60_000)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CHAT).repartition(5)
    chat.format_conversations(df).write.parquet(f"{tmp_path}/chat")
    got = Counter(map(tuple, chat.read_back(spark.read.schema(chat.FORMATTED).parquet(f"{tmp_path}/chat")).collect()))
    assert got == slow_chat(rows)
    none = chat.format_conversations(df.limit(0))
    assert none.count() == 0 and chat.read_back(none).count() == 0


def test_segments_end_between_turns():
    batch = pa.RecordBatch.from_pydict({"conv_id": [1, 1, 1, 2, 2, None], "role": ["user"] * 6, "text": ["x" * 30, "y", "z", "a", "b", "c"]})
    old, chat.SEGMENT_CHARS = chat.SEGMENT_CHARS, 20
    try:
        got = [(c, len(t), a, b) for c, t, a, b in chat._segments(iter([batch, batch.slice(0, 0)]))]
    finally:
        chat.SEGMENT_CHARS = old
    assert got == [(1, 1, True, False), (1, 2, False, True), (2, 2, True, True), (None, 1, True, True)]
