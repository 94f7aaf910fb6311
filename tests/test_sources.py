"""Decoding of many texts at once against one at a time, subtitle files, dictionaries, and cascades."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomwork.operators import catalogue, terms
from loomwork.sources import tables


def one_by_one(raw, charsets, need):
    if raw is None:
        return None
    said = re.search(rb"charset=[\"']?([\w-]+)", raw[:2048], re.I)
    for name in [*([said[1].decode()] if said else []), *charsets]:
        try:
            text = raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        if re.search(need, text):
            return text
    return raw.decode("utf-8", "replace")


def test_batches_decode_as_single_texts():
    rng = random.Random(1)
    bits = [b"", b"abc", "한글".encode(), "한글".encode("cp949"), "똠방".encode("cp949"), b"\xff", b"\xe0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\n\0\n", b"charset=euc-kr ", b"charset=none ", "é🙂".encode(), b"\xc3"]
    for _ in range(300):
        raws = [rng.choice([None, b"".join(rng.choices(bits, k=rng.randrange(4)))]) for _ in range(rng.randrange(9))]
        for charsets, need in ((("utf-8", "euc-kr", "cp949"), "[가-힣]"), (("utf-8-sig", "utf-8", "cp949"), "")):
            assert tables.decode_batch(raws, charsets, need) == [one_by_one(r, charsets, need) for r in raws]


def test_masks_tell_utf8():
    rng = random.Random(2)
    raws = [bytes(rng.choices([0x41, 0x80, 0xBF, 0xC2, 0xC1, 0xE0, 0xA0, 0xED, 0x9F, 0xEE, 0xF0, 0x90, 0xF4, 0x8F, 0xF5], k=rng.randrange(6))) for _ in range(20_000)]

    def valid(r):
        try:
            r.decode()
        except UnicodeDecodeError:
            return False
        return True

    sizes = np.array([len(r) for r in raws])
    starts = np.cumsum(sizes + 3) - sizes - 3
    got = tables.valid_utf8(np.frombuffer(b"\n\n\n".join([*raws, b""]), np.uint8), starts, starts + sizes)
    assert got.tolist() == [valid(r) for r in raws] and 0.05 < got.mean() < 0.95


def test_subtitle_files_round_trip(spark, tmp_path):
    rows = [("a", "1\n00:00:01,000 --> 00:00:02,000\n가"), ("b c", "one line"), ("d", "")]
    tables.write_files(spark.createDataFrame(rows, "video string, srt string"), f"{tmp_path}/out", name="video", text="srt")
    assert sorted((r["video"], r["text"].rstrip("\n")) for r in tables.read_files(spark, f"{tmp_path}/out", "video").collect()) == sorted(rows)


def test_terms_of_a_table(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choices("abc한글 🙂", k=rng.randrange(60)))) for i in range(80)] + [(80, None), (81, ""), (5, "zzz abcab"), (82, "ab" * 40_000)]
    words = ["".join(rng.choices("abc한글 🙂", k=rng.randrange(1, 9))) for _ in range(200)] + ["zzz", "nowhere", "", None, "ababababab", "🙂"]
    want = {(i, w) for i, x in texts for w in words if x and w and w in x}
    t, d = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "w string")
    for most in (500_000, 0):
        monkeypatch.setattr(terms, "BROADCAST_KEYS", most)
        got = terms.contained_terms(t, d, key="id", text="text", term="w")
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
        assert {tuple(r) for r in got.collect()} == want
    assert terms.contained_terms(t, d.limit(0), key="id", text="text", term="w").collect() == []
    assert terms.contained_terms(t.limit(0), d, key="id", text="text", term="w").collect() == []


def test_texts_are_not_exploded_by_character(spark):
    """Of a text only the asked substrings leave its task: no row for each place is made."""
    t = spark.createDataFrame([(1, "abcdefgh" * 50_000 + "needle"), (1, "hay"), (2, "hay 한국어"), (3, None)], "id long, text string")
    d = spark.createDataFrame([("needle",), ("hay",), ("국어",), ("fghab",), ("none",), (None,), ("",)], "w string")
    found = terms.contained_terms(t, d, key="id", text="text", term="w")
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, "fghab"), (1, "hay"), (1, "needle"), (2, "hay"), (2, "국어")]


def test_cascade_asks_later_tiers_only_for_what_lacks(spark):
    rng = random.Random(4)
    tiers = [([(rng.randrange(6), rng.randrange(30)) for _ in range(n)], cap) for n, cap in ((12, None), (30, 3), (50, None))]
    needs = {g: g * 2 for g in range(7)}
    want = []
    for g, need in needs.items():
        seen = []
        for i, (rows, cap) in enumerate(tiers, 1):
            room = need - len(seen)
            offered = sorted({k for x, k in rows if x == g} - {k for k, _ in seen})
            seen += [(k, i) for k in offered[: room if cap is None else min(room, cap)]]
        want += [(g, k, i, p) for p, (k, i) in enumerate(seen, 1)]
    frames = [(spark.createDataFrame(rows, "g long, k long"), cap) for rows, cap in tiers]
    demand = spark.createDataFrame(list(needs.items()), "g long, need long")
    got = catalogue.cascade(demand, frames, group="g", key="k", need="need", order=[F.asc("k")])
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_blocks_of_rows_give_all_near_pairs(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.randrange(2**12), rng.randrange(2**8)) for i in range(150)] + [(500, 0, 0), (501, 0, 0)]
    df = spark.createDataFrame(rows, "k long, w1 long, w2 long")
    dist = lambda a, b: bin(a[1] ^ b[1]).count("1") + bin(a[2] ^ b[2]).count("1")
    want = sorted((a[0], b[0], dist(a, b)) for a in rows for b in rows if a[0] < b[0] and dist(a, b) <= 6)
    for block in (4096, 20):
        monkeypatch.setattr(catalogue, "PAIR_BLOCK", block)
        got = catalogue.hamming_pairs(df, 6, key="k", words=["w1", "w2"])
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.collect())) == want
    assert catalogue.hamming_pairs(df.limit(0), 6, key="k", words=["w1", "w2"]).count() == 0


def test_feeds_of_one_item_and_of_none(spark, tmp_path):
    for name, items in (("one", "<item><title>a</title><link>l</link></item>"), ("none", "")):
        (tmp_path / f"{name}.xml").write_text(f"<rss><channel><title>t</title>{items}</channel></rss>")
    assert [(r["place"], r["title"]) for r in tables.feed_items(spark, str(tmp_path / "one.xml")).collect()] == [(0, "a")]
    assert tables.feed_items(spark, str(tmp_path / "none.xml")).collect() == []
