"""Phrase collocations: n-grams as DataFrame rows, counted per language, scored in exact decimals.

1. All single words and pairs of neighbours are exploded and hash-aggregated per language.
2. Longer n-grams are exploded and aggregated likewise.  A phrase is at most as frequent as any pair of
   neighbours inside it, so where the frequent pairs are few enough to be sent to all executors (their
   number is counted), only runs of frequent pairs are exploded.  The pairs travel as 64-bit hashes: two that
   collide let a few more rows through, which the exact counts of strings sort out.
3. Cuts of each candidate are joined with the counts of both parts and scored with integer division of decimals.
4. An anti-join drops phrases that a phrase of one word more holds in all their places.  Longer ones need no look:
   a count never rises as a phrase grows, so between the two there is always one of one word more.
5. A window ranks each language; parts of a language are ranked and cut first, so no task gets a whole language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, load, shared_checkpoint

PIECE_ENDS, WORD_GAPS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
MAX_WORDS, MIN_COUNT, TOP, HELD_PERCENT = 5, 100, 2000, 100
#: More frequent pairs than these are not broadcast (8 bytes each); then every longer n-gram is exploded.
BROADCAST_PAIRS = 4_000_000
#: More languages than these are joined by a shuffle.
BROADCAST_LANGS = 100_000
#: Parts of a language that are ranked side by side.
PARTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def worded_pieces(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, words): the words of each piece that has any."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    text = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    pieces = docs.select(lang, F.explode(F.split(text, PIECE_ENDS)).alias("piece")).select("lang", F.btrim("piece", F.lit(" \t")).alias("piece"))
    return pieces.filter("piece != ''").select("lang", F.split("piece", WORD_GAPS).alias("words"))


def neighbours(pieces: DataFrame, width: int) -> DataFrame:
    """(lang, w0, w1, ...): each word with the words after it, null beyond the piece."""
    shifted = [F.slice("words", k + 1, F.size("words")) if k else F.col("words") for k in range(width)]
    return pieces.select("lang", F.inline(F.arrays_zip(*shifted)).alias(*[f"w{k}" for k in range(width)]))


def gram(k: int) -> Column:
    """The first ``k`` words as a phrase, null if the piece ends before."""
    return F.concat(*[x for i in range(k) for x in ([F.lit(" ")] if i else []) + [F.col(f"w{i}")]])


def counted(grams: DataFrame) -> DataFrame:
    return grams.filter("phrase is not null").groupBy("lang", "phrase").agg(F.count("*").alias("f"))


def short_counts(pieces: DataFrame, min_count: int) -> DataFrame:
    """Frequent words and pairs; all other words of a language are summed up as the phrase ''."""
    all_counts = counted(neighbours(pieces, 2).select("lang", F.explode(F.array(gram(1), gram(2))).alias("phrase")))
    named = F.when(F.col("f") >= min_count, F.col("phrase")).when(~F.contains("phrase", F.lit(" ")), F.lit(""))
    return all_counts.select("lang", named.alias("phrase"), "f").filter("phrase is not null").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def long_counts(pieces: DataFrame, pairs: DataFrame, max_words: int, min_count: int) -> DataFrame:
    """Frequent phrases of three to ``max_words`` words."""
    rows = neighbours(pieces, max_words).filter("w2 is not null")
    frequent: list[Column] = [F.lit(True)] * max_words
    if pairs.count() <= BROADCAST_PAIRS:
        part = F.split("phrase", " ")
        hashes = pairs.select(F.xxhash64("lang", part[0], part[1]).alias("h")).distinct()
        for k in range(max_words - 1):
            known = F.broadcast(hashes.withColumnRenamed("h", f"h{k}"))
            rows = rows.join(known, F.xxhash64("lang", f"w{k}", f"w{k + 1}") == F.col(f"h{k}"), "inner" if k < 2 else "left")
            frequent[k] = F.col(f"h{k}").isNotNull()
    grams, run = [], frequent[0]
    for k in range(3, max_words + 1):
        run = run & frequent[k - 2]
        grams.append(F.when(run, gram(k)))
    return counted(rows.select("lang", F.explode(F.array(*grams)).alias("phrase"))).filter(F.col("f") >= min_count)


def scored(counts: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that no longer one holds."""
    words = F.split("phrase", " ")
    candidates = counts.filter(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"), words.alias("ws"))
    parts = F.array(F.array_join(F.slice("ws", 1, F.size("ws") - 1), " "), F.array_join(F.slice("ws", 2, F.size("ws")), " "))
    longer = candidates.filter(F.size("ws") > 2).select("lang", F.explode(parts).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.alias("c").join(longer.alias("x"), (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase")) & (100 * F.col("x.longer") >= percent * F.col("c.a")), "left_anti")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("ws", 1, F.col("k")), " ").alias("head"), F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws")), " ").alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.join(few(sizes, BROADCAST_LANGS), "lang")
    score = F.expr("{a} * {n} * 1000BD div ({l} * {r})".format(**{c: f"cast({c} as decimal(17,0))" for c in "alrn"}))
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a", "n").agg(best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    some = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", first).filter(F.col("rank") <= top).drop("part", "rank")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def mine_collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, held_percent: int = HELD_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of two to ``max_words`` words of each language.

    Null texts and texts without words give nothing; null languages are ``und``; a repeated row counts each time;
    a table without candidates gives no rows; other columns, whatever their names, are not read.  Equal scores go by
    count, then by the phrase's bytes; of cuts with equal scores the first counts.  Counts below 10^17 are exact.
    """
    if max_words < 2:
        raise ValueError("max_words must be at least 2")
    pieces = worded_pieces(docs, text_col, lang_col)
    counts = shared_checkpoint(short_counts(pieces, min_count))
    sizes = counts.filter(~F.contains("phrase", F.lit(" "))).groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counts.filter((F.col("phrase") != "") & (F.col("f") >= min_count))
    if max_words > 2:
        pairs = frequent.filter(F.contains("phrase", F.lit(" ")))
        frequent = frequent.unionByName(shared_checkpoint(long_counts(pieces, pairs, max_words, min_count)))
    return ranked(scored(frequent, sizes, held_percent), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(load(spark, sf_dir, "documents"))


_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^ \\t]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
counts AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k) WHERE len(w) >= k)
  GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM counts WHERE f >= {MIN_COUNT}),
candidates AS (
  SELECT lang, phrase, k AS words, f AS a, string_split(phrase, ' ') AS w FROM frequent c
  WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM frequent x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.f >= {HELD_PERCENT} * c.f AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score, c.k AS cut
  FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates) c
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')
  JOIN sizes s ON s.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
WHERE rank <= {TOP}
"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": _SQL}
