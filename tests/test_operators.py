"""Operators and Column functions on small fixtures and at the edges of every band."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import article
from loomwork.functions import grounding as g
from loomwork.functions import media as m
from loomwork.functions import scoring as s
from loomwork.functions import text as t
from loomwork.operators import catalogue as c
from loomwork.sources import tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_hash_of_missing_content_uses_the_path(spark):
    df = spark.createDataFrame([(b"x", "A\\b"), (None, "A\\b"), (None, "a/B")], "content binary, path string")
    a, b, d = [r[0] for r in df.select(tables.content_hash(F.col("content"), F.col("path"))).collect()]
    assert len(a) == 64 and a != b and b == d


def test_get_or_create(spark):
    known = spark.createDataFrame([(1, "Lim", ["Hero"]), (4, "Ann", [])], "id long, name string, aliases array<string>")
    got = {r["name"]: r["id"] for r in c.get_or_create(spark.createDataFrame([("LIM",), ("hero",), ("New",)], "name string"), known).collect()}
    assert got == {"LIM": 1, "hero": 1, "New": 5}


def test_merge_fills_only_what_is_missing(spark):
    old = spark.createDataFrame([("h1", 1, None, "web"), ("h2", 2, "en", None)], "h string, id long, lang string, source string")
    new = spark.createDataFrame([("h1", 9, "fr", "api"), ("h3", 3, "de", "api"), ("h3", 4, "es", "x")], "h string, id long, lang string, source string")
    got = {r["h"]: tuple(r)[1:] for r in c.merge_content(old, new, hash_col="h", patch=["lang", "source"], tie="id").collect()}
    assert got == {"h1": (1, "fr", "web", True, True), "h2": (2, "en", None, True, False), "h3": (3, "de", "api", False, False)}


def test_order_list_is_checked():
    with pytest.raises(ValueError):
        c.order_columns([("id; drop", "asc")], {"id"})


def test_blocked_pairs_equal_all_pairs(spark):
    bits = spark.range(60).select(F.col("id").alias("k"), (F.xxhash64("id") % 64).alias("w")).withColumn("w", F.abs("w"))
    bits = bits.select("k", "w", *[F.shiftright("w", 2 * i).bitwiseAND(3).alias(f"b{i}") for i in range(3)])
    plain = c.hamming_pairs(bits, 2, key="k", words=["w"]).collect()
    assert sorted(plain) == sorted(c.hamming_pairs(bits, 2, key="k", words=["w"], blocks=["b0", "b1", "b2"]).collect())


def test_sentences(spark):
    assert value(spark, t.sentences(F.lit("One. Two!!\n\n  three"))) == ["One.", "Two!!", "three"]
    assert value(spark, t.sentences(F.lit("?!"))) == []


def test_captions(spark):
    words = F.split(F.lit("aa bb cc dd ee. ff"), " ")
    assert value(spark, t.pack_captions(words, 100, 3)) == ["aa bb cc", "dd ee.", "ff"]
    assert value(spark, t.pack_captions(F.array().cast("array<string>"))) == []


def test_times(spark):
    assert value(spark, t.srt_time(F.lit(3661.5))) == "01:01:01,500"
    assert value(spark, t.parse_srt_time(F.lit("01:01:01,500"))) == 3661.5


def test_lenient_json(spark):
    for raw, want in (('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('so {"a":1} ok', '{"a":1}'), ("no", None), ("{bad", None)):
        assert value(spark, t.lenient_json(F.lit(raw))) == want


def test_gap_and_cursor(spark):
    times = F.array(*[F.lit(float(x)) for x in (10, 0, 11, 12, 1.4)])
    assert value(spark, t.greedy_gap(times, 1.5, 10)) == [10.0, 0.0, 12.0]
    got = value(spark, t.rounded_cursor(F.array(F.lit(2.0), F.lit(0.0), F.lit(5.0), F.lit(1.0)), 6.0))
    assert [tuple(x) for x in got] == [(0.0, 2.0), (2.0, 6.0)]


@pytest.mark.parametrize("n,short,blog", [(0, 2, 4), (349, 2, 4), (350, 1, 4), (399, 1, 4), (400, 0, 4), (550, 0, 4), (551, 1, 4), (1799, 1, 4), (1800, 1, 2), (2160, 1, 0), (2900, 1, 0), (2901, 1, 1)])
def test_length_bands(spark, n, short, blog):
    assert value(spark, s.shorts_band(F.lit(n))) == short and value(spark, s.blog_band(F.lit(n))) == blog


@pytest.mark.parametrize("sim,want", [(0.49, 0), (0.5, 1.5), (0.7, 1.5), (0.71, 4), (0.85, 5)])
def test_hook_bands(spark, sim, want):
    assert value(spark, s.hook_penalty(F.lit(sim))) == want


@pytest.mark.parametrize("total,critical,reviewed,want", [(69.9, False, True, "FAIL"), (70.0, False, True, "WARNING"), (90.0, False, True, "PASS"), (95.0, True, True, "FAIL"), (95.0, False, False, "WARNING")])
def test_verdict(spark, total, critical, reviewed, want):
    assert value(spark, s.verdict(F.lit(total), F.lit(critical), F.lit(reviewed))) == want


def test_listing_and_decoding(spark, tmp_path):
    (tmp_path / "singer-A_live.mp4").write_bytes(b"1")
    (tmp_path / "temp_x.mp4").write_bytes(b"2")
    files = tables.list_files(spark, str(tmp_path), "*.mp4")
    assert [r["tags"] for r in files.collect()] == [["singer", "a", "live"]]
    known = spark.createDataFrame([], "file_path string, file_hash string")
    assert tables.new_files(files, known).count() == 1 and tables.new_files(files, files).count() == 0
    raw = spark.createDataFrame([("한글".encode("euc-kr"),), ("한글".encode(),), (b"\xff",), (None,)], "raw binary")
    assert [r["text"] for r in tables.decode_text(raw, "raw").collect()] == ["한글", "한글", "�", None]


def test_subtitles_feeds_and_sinks(spark, tmp_path):
    raw = spark.createDataFrame([("1\n자막".encode("utf-8-sig"),), ("자막".encode("cp949"),), (b"plain",), (None,)], "raw binary")
    assert [r["text"] for r in tables.subtitle_text(raw, "raw").collect()] == ["1\n자막", "자막", "plain", None]
    (tmp_path / "feed.xml").write_text("<rss><channel><title>t</title>" + "".join(f"<item><title>n{i}</title><link>l{i}</link></item>" for i in range(7)) + "</channel></rss>")
    assert [(r["place"], r["title"], r["link"]) for r in tables.feed_items(spark, str(tmp_path / "feed.xml")).collect()] == [(i, f"n{i}", f"l{i}") for i in range(5)]
    df = spark.createDataFrame([(1, "가"), (2, None)], "a int, b string")
    tables.write_json(df, str(tmp_path / "j"))
    assert sorted(spark.read.json(str(tmp_path / "j")).select("a", "b").collect()) == sorted(df.collect())
    tables.write_lines(df, "a", str(tmp_path / "l"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["1", "2"]
    roles = spark.createDataFrame([("C:\\x\\Clips\\a.png",), ("/m/stock/b.mp4",), ("/m/c.MOV",), ("/m/d.jpg",)], "p string")
    assert [r[0] for r in roles.select(tables.media_role(F.col("p"))).collect()] == ["stage_clip", "general_broll", "stage_clip", "singer_photo"]


def test_usage_windows(spark):
    from loomwork.streaming import usage

    events = spark.createDataFrame([("2024-01-01 01:00:00", 1), ("2024-01-01 23:00:00", 1), ("2024-01-02 00:00:00", 1), ("2024-01-01 05:00:00", 2)], "ts string, user_id int").withColumn("ts", F.col("ts").cast("timestamp"))
    got = usage.usage_windows(events, key="user_id").collect()
    assert sorted((r["user_id"], r["n"]) for r in got) == [(1, 1), (1, 2), (2, 1)]


def test_evolution_and_json_lines(spark):
    df = tables.evolve(spark.createDataFrame([(1, "x")], "id int, file_path string"), tables.MEDIA)
    assert df.schema == tables.MEDIA and df.first()["file_path"] == "x"
    lines = spark.createDataFrame([('{"a": 1}',), ("",), ("oops",), ('{"a": 2}',)], "line string")
    assert [r["a"] for r in tables.json_lines(lines, "line", "a int").collect()] == [1, 2]


def test_stream_equals_batch(spark, tmp_path):
    from loomwork.streaming import usage

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = usage.deduplicated(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), keys=["event_id"])
    q = stream.writeStream.format("memory").queryName("dedup_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dedup_out").count() == events.dropDuplicates(["event_id"]).count()


def test_semi_join_and_pushdown(spark):
    from loomwork import registry

    plan = registry.QUERIES["tag_search_semi"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "PushedFilters: [IsNotNull(p_size), LessThanOrEqual(p_size,30)" in plan


def test_quantities(spark):
    text = "1,300만 뷰, 100억 원과 5월 12일, TOP 3위, 1위, 1위, 7, 60초, 2024년 5월"
    got = [tuple(q) for q in value(spark, g.quantities(F.lit(text)))]
    assert got == [("5월 12일", "5월 12일", "date"), ("2024년 5월", "2024년 5월", "date"), ("TOP 3위", "3", "rank"), ("1위", "1", "rank"), ("1,300만 뷰", "1300만", "뷰"), ("100억 원", "100억", "원")]
    assert value(spark, g.quantities(F.lit(None).cast("string"))) == [] == value(spark, g.quantities(F.lit("")))


def test_quantities_that_an_article_lacks(spark):
    missing = lambda script, article: [q["token"] for q in value(spark, g.ungrounded_quantities(F.lit(script), F.lit(article)))]
    assert missing("1300만 뷰와 100억 원, 1위", "3000석 공연") == ["1위", "1300만 뷰", "100억 원"]
    assert missing("1300만 뷰, 1위, 2등", "1,300 만 조회, 우승, 2 위") == []
    assert missing("95%", None) == ["95%"]
    major = value(spark, F.transform(g.quantities(F.lit("1위 100억 30만 명 40만 곡 9%")), g.major_claim))
    assert major == [True, True, True, False, False]


@pytest.mark.parametrize("name,want", [("병원", "hospital"), (" 큰병원 ", "hospital"), ("Money", "money"), ("#!", "audience"), ("스마트폰", "smartphone"), ("", "audience")])
def test_canonical_category(spark, name, want):
    assert value(spark, g.canonical_category(F.lit(name))) == want


@pytest.mark.parametrize("sentence,want", [("관객들이 박수를 보냈다", "audience"), ("눈물을 흘렸다", "emotion"), ("병원에 입원했다", "hospital"), ("10억 원을 기부했다", "money"), ("유튜브 조회수", "smartphone"), ("콘서트 무대", "concert"), ("전속계약을 했다", "business"), ("기억", None)])
def test_best_category(spark, sentence, want):
    assert value(spark, g.best_category(F.lit(sentence))) == want


def test_reviewed(spark):
    one = lambda raw: value(spark, g.reviewed(F.lit(raw).cast("string")))
    assert one(None)["not_run"] and one('{"score": null}')["not_run"] and one('{"score": "x"}')["status"] == "AI_QA_NOT_RUN"
    fenced = one('```json\n{"score": 30, "issues": []}\n```')
    assert (fenced["score"], fenced["status"]) == (25.0, "PASS")
    bad = one('[{"score": 20.0, "status": "pass", "issues": [{"type": "error", "message": "m"}, {"message": " "}]}]')
    assert (bad["score"], bad["status"], bad["n_issues"]) == (14.5, "FAIL", 1)
    assert one('{"score": 16, "status": "?", "issues": [{"message": "m"}], "recommendations": ["a", " "]}')["status"] == "WARNING"


def test_news_article(spark):
    page = "<html><head><title>T</title></head><body><div class=submenu><p>menu</p></div><h2 id=title_area>A title here</h2><div id=dic_area><p>First line of the text.</p><p>short</p><script>x</script><p>mail a@b.co for more text</p><p>▶ see also other pages</p><p>Second line of &amp; text.<br>Third line of the text.</p></div><footer><p>foot</p></footer></body></html>"
    title, body = article.news_article(page)
    assert title == "A title here"
    assert value(spark, g.article_lines(F.lit(body))) == ["First line of the text.", "Second line of & text.", "Third line of the text."]
    assert article.news_article(None) == article.news_article("") == ("", "")
    assert article.news_article("<body>" + "<div>" * 3000 + "deep")[1] == "deep"
    known = "<body><div><p>a</p><p>b</p></div><div class='x article_view'>Known place</div>"
    assert article.news_article(known)[1] == "Known place"


@pytest.mark.parametrize("a,b,want", [("00", "ff", 8), ("f" * 16, "0" * 16, 64), ("8000000000000001", "1", 1), (None, "1", 64), ("zz", "1", 64), ("", "", 64), (" A ", "a", 0)])
def test_hamming_hex(spark, a, b, want):
    assert value(spark, m.hamming_hex(F.lit(a).cast("string"), F.lit(b).cast("string"))) == want


def test_rising_bits(spark):
    falling = [float(9 - i % 9) for i in range(72)]
    assert value(spark, m.rising_bits(F.lit(falling))) == "f" * 16
    assert value(spark, m.rising_bits(F.lit(falling[::-1]))) == "0" * 16
    assert value(spark, m.rising_bits(F.lit([1.0, 2.0]))) is None


def test_probe(spark):
    report = "Duration: 00:01:15.50, start\n Stream #0:0: Video: h264, 1080x1920, 29.97 fps\n Stream #0:1: Audio: aac"
    assert tuple(value(spark, m.probe(F.lit(report)))) == (75.5, True, True, 1080, 1920, 29.97)
    assert tuple(value(spark, m.probe(F.lit("nothing")))) == (None, False, False, None, None, None)


def test_crop_window(spark):
    crop = lambda *v: tuple(value(spark, m.crop_window(*map(F.lit, v))))
    assert crop(1600, 900, 1590, 10) == (1094, 0, 506, 900)
    assert crop(900, 3200, 450, 1000) == (0, 520, 900, 1600)


def test_small_formats(spark):
    assert value(spark, m.subtitle_colour(F.lit("#a1b2c3"))) == "&H00C3B2A1" and value(spark, m.subtitle_colour(F.lit("red"))) == "&H0000FFFF"
    assert value(spark, m.video_id(F.lit("https://x/watch?v=abcdefghi-1&t=2"))) == "abcdefghi-1" and value(spark, m.video_id(F.lit("none"))) is None
    base = F.lit("https://h.org/a/b")
    assert [value(spark, m.absolute_url(F.lit(u), base)) for u in ("//c.d/e", "/f", "http://g")] == ["https://c.d/e", "https://h.org/f", "http://g"]
    assert value(spark, m.repair(F.lit("x"), F.lit("rephrase_script"), F.lit("factual"))) == "shorten_script"
    assert value(spark, m.repair(F.lit("x"), F.lit(None).cast("string"), F.lit("factual"))) is None


def test_subtitles(spark):
    srt = "1\n00:00:01,500 --> 00:00:03,000\n<i>One</i>\n\n2\n00:00:03,000 --> 01:00:04,999\nTwo\nlines\n\n3\n00:00:05,000 --> 00:00:06,000\nA<br>B"
    assert [tuple(c) for c in value(spark, m.cues(F.lit(srt)))] == [("One", False), ("Two\nlines", True), ("AB", True)]
    assert value(spark, m.cues(F.lit(None).cast("string"))) == []
    half = value(spark, m.rescaled(F.lit(srt), 2.0))
    assert "00:00:00,750 --> 00:00:01,500" in half and "--> 00:30:02,500" in half and half.count("\n") == srt.count("\n")
    assert value(spark, m.rescaled(F.lit(srt), 1.0005)) == srt


def test_round_robin_and_padding(spark):
    rows = spark.createDataFrame([("g", k, i) for k, n in (("stage", 2), ("cc", 3), ("stock", 1), ("broll", 1)) for i in range(n)], "g string, kind string, i long")
    got = c.round_robin(rows, ["cc", "broll", "stage"], group="g", kind="kind", order=[F.col("i")]).orderBy("place").collect()
    assert [(r["kind"], r["i"]) for r in got] == [("cc", 0), ("broll", 0), ("stage", 0), ("cc", 1), ("stage", 1), ("cc", 2), ("stock", 0)]
    ranked = spark.createDataFrame([("a", "x", 1), ("b", "y", 1), ("b", "x", 2), ("b", "z", 3)], "g string, k string, place long")
    defaults = spark.createDataFrame([("x", 1), ("y", 2), ("w", 3)], "k string, place long")
    assert sorted(map(tuple, c.padded(ranked, defaults, 3, group="g", key="k").collect())) == [("a", "w", 3), ("a", "x", 1), ("a", "y", 2), ("b", "x", 2), ("b", "y", 1), ("b", "z", 3)]


def test_fact_check(spark):
    def one(title, content, script, blog=None, name=None):
        return value(spark, g.fact_check(*[F.lit(x).cast("string") for x in (title, content, script, blog, name)]))

    mixed = one("임영웅 2억 원 기부", "가수 임영웅이 2억 원을 쾌척했다.", "가수 영탁이 2억 원을 기부했다.", None, "임영웅")
    assert mixed["entity"] == 0 and mixed["critical"] and not mixed["passed"]
    rumour = one("이찬원 신곡", "가수 이찬원이 감사의 뜻을 전했다.", "전 국민 충격! 이찬원이 은퇴를 선언했다. 발칵 뒤집혔고 비보에 오열했다.", None, "이찬원")
    assert rumour["terms"] == 0 and rumour["critical"] and not rumour["passed"]
    fair = one("송가인 전국투어", "가수 송가인의 콘서트가 전석 매진을 기록했다.", "송가인이어라! 가인님의 콘서트가 전석 매진되었습니다!")
    assert tuple(fair) == ("송가인", 8.0, 10.0, 8.0, 4.0, 28.0, False, True)
    blog = one("송가인 전국투어", "가수 송가인의 콘서트", "송가인의 콘서트", "[사진 1] 파문 [사진 2] 가인 [사진 3]")
    assert blog["blog"] == 0 and blog["critical"]
    odd = one(None, None, "‘없는 제목’ 1300만 뷰와 100억 원, 미스트롯")
    assert (odd["artist"], odd["entity"], odd["numbers"], odd["critical"]) == (None, 8.0, 4.0, True)
    known = one("송가인", "노래", '송가인이 "모르는 노래“를 미스트롯에서', None, None)
    assert known["entity"] == 8 - 1 - 1.5
    assert value(spark, g.detected_artist(F.lit("x"), F.lit("영탁 송가인 영탁 송가인"), F.lit(" "))) == "영탁"
