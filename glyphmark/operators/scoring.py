"""From the assignment to one score row per image.

An image that isn't crowded can be scored from one row, its board, that holds its tokens and words:
it is paired, assigned and counted where it is, so the boxes are dealt by image once and no step
after that shuffles them.  Crowded images go through `matched_tokens`, spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmark.functions.text import cer, normalize, normalize_all, strip, wer
from glyphmark.operators.assignment import taken
from glyphmark.operators.matching import match
from glyphmark.operators.overlaps import overlaps_of

#: What a board keeps of a token and of a word, in the order that breaks ties.
TOKEN = ("x0", "y0", "x1", "y1", "token_text", "label", "g")
WORD = ("x0", "y0", "x1", "y1", "text", "unsure", "sure", "w")
COUNTS = ("gt_total", "found_count", "omission_count", "keep_total", "keep_exact_match_count", "false_redaction_count", "keep_chars_total", "keep_chars_censored", "word_total")


def matched_tokens(gt: DataFrame, pred: DataFrame, allowed: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every token with found, exact, allow_listed, confidence of its word."""
    pairs = match(gt, pred, threshold, "text", "confidence").select("image_id", "g", "text", F.col("confidence").alias("word_confidence"), F.lit(True).alias("found"))
    out = gt.join(pairs, ["image_id", "g"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    out = out.withColumn("exact", F.coalesce(F.col("found") & (normalize(F.col("text")) == normalize(F.col("token_text"))), F.lit(False)))
    if allowed is None:
        return out.withColumn("allow_listed", F.lit(True))
    listed = allowed.select(normalize(F.col("token_text")).alias("__listed")).distinct()
    return out.join(listed, normalize(F.col("token_text")) == F.col("__listed"), "left").withColumn("allow_listed", F.col("__listed").isNotNull()).drop("__listed")


def _measured(per: DataFrame) -> DataFrame:
    """cer and wer of what was wanted and read."""
    measured = lambda measure: F.when(F.col("want") != "", measure(F.col("want"), F.col("read")))
    return per.withColumn("cer", measured(cer)).withColumn("wer", measured(wer)).drop("want", "read")


def image_counts(tokens: DataFrame, pred: DataFrame) -> DataFrame:
    """image_id, COUNTS, cer and wer of the images with tokens or words, from `matched_tokens`."""
    keep = F.col("label") == "KEEP"
    redacted = keep & ~(F.col("exact") & F.col("allow_listed"))
    chars = F.length(normalize(F.col("token_text")))
    pair = F.struct("x0", "y0", "x1", "y1", "token_text", "label", "g", normalize(F.col("token_text")).alias("want"), normalize(F.col("text")).alias("read"))
    per = tokens.groupBy("image_id").agg(
        F.count("*").alias("gt_total"), F.count_if("found").alias("found_count"), F.count_if(~F.col("found")).alias("omission_count"),
        F.count_if(keep).alias("keep_total"), F.count_if(keep & F.col("exact")).alias("keep_exact_match_count"), F.count_if(redacted).alias("false_redaction_count"),
        F.sum(F.when(keep, chars)).alias("keep_chars_total"), F.sum(F.when(redacted, chars)).alias("keep_chars_censored"), F.array_sort(F.collect_list(F.when(F.col("found"), pair))).alias("pairs"),
    )
    joined = lambda side: strip(F.array_join(F.transform("pairs", lambda p: p[side]), " "))
    per = per.withColumn("want", joined("want")).withColumn("read", joined("read")).drop("pairs")
    words = pred.groupBy("image_id").agg(F.count("*").alias("word_total"))
    return _measured(per).join(words, "image_id", "full").select("image_id", *COUNTS, "cer", "wer")


def token_struct() -> Column:
    return F.struct(*[F.col(c).cast("long").alias(c) if c == "g" else F.col(c) for c in TOKEN])


def word_struct() -> Column:
    own = {"unsure": F.col("confidence").isNull(), "sure": F.coalesce("confidence", F.lit(0.0)), "w": F.col("w").cast("long")}
    return F.struct(*[own.get(c, F.col(c)).alias(c) for c in WORD])


def boards(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """image_id, tokens, words: a row for each image, for those that aren't crowded."""
    tokens = gt.groupBy("image_id").agg(F.collect_list(token_struct()).alias("tokens"))
    words = pred.groupBy("image_id").agg(F.collect_list(word_struct()).alias("words"))
    return tokens.join(words, "image_id", "full").withColumns({c: F.coalesce(c, F.array()) for c in ("tokens", "words")})


def unlisted(gt: DataFrame, allowed: DataFrame) -> DataFrame:
    """image_id, unlisted: the KEEP texts of an image that the allowlist lacks; no row where it has all.

    Each different text is looked up once; only those that are missing meet the tokens."""
    keep = gt.where("label = 'KEEP' AND token_text IS NOT NULL").select("image_id", "token_text")
    listed = allowed.select(normalize(F.col("token_text")).alias("__listed")).distinct()
    texts = keep.select("token_text").distinct()
    missing = texts.join(listed, normalize(F.col("token_text")) == F.col("__listed"), "left_anti")
    return keep.join(missing, "token_text", "left_semi").groupBy("image_id").agg(F.collect_set("token_text").alias("unlisted"))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """image_id and the columns, worked out once for each row; plain projections would be merged and repeat them at each use."""
    return rows.select("image_id", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def board_counts(boards: DataFrame, unlisted: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """What `image_counts` gives, from boards; every text is listed where there is no `unlisted`."""
    rows = boards.withColumn("unlisted", F.array().cast("array<string>")) if unlisted is None else boards.join(unlisted, "image_id", "left")
    texts = F.concat(F.transform("tokens", lambda t: t["token_text"]), F.transform("words", lambda w: w["text"]))
    listed = F.coalesce("unlisted", F.array().cast("array<string>"))
    rows = _once(rows, unlisted=listed, tokens=F.col("tokens"), words=F.col("words"), plain=normalize_all(texts))
    with_text = lambda side, names, start, name: F.zip_with(side, F.slice("plain", start, F.size(side)), lambda x, text: F.struct(*[x[c].alias(c) for c in names], text.alias(name)))
    rows = _once(rows, unlisted=F.col("unlisted"), tokens=with_text("tokens", TOKEN, F.lit(1), "want"), words=with_text("words", WORD, F.size("tokens") + 1, "read"))
    types = {c: rows.schema[c].dataType.elementType.simpleString() for c in ("tokens", "words")}
    kind = f"struct<g:bigint,w:bigint,token:{types['tokens']},word:{types['words']}>"
    edge = lambda overlap, t, w: F.struct((-overlap).alias("order"), t.alias("token"), w.alias("word"), overlap.alias("iou"))
    row = lambda e: F.struct(e["token"]["g"].alias("g"), e["word"]["w"].alias("w"), e["token"].alias("token"), e["word"].alias("word"))
    edges = F.array_sort(overlaps_of(F.col("tokens"), F.col("words"), threshold, edge))
    kept, want = lambda t: t["label"] == "KEEP", lambda m: m["token"]["want"]
    rows = _once(rows, unlisted=F.col("unlisted"), n=F.size("tokens"), m=F.size("words"), keep=F.transform(F.filter("tokens", kept), lambda t: t["want"]), found=taken(edges, kind, row))
    exact = F.filter("found", lambda m: kept(m["token"]) & (want(m) == m["word"]["read"]))
    pairs = F.array_sort(F.transform("found", lambda m: F.struct(m["token"].alias("token"), m["word"]["read"].alias("read"))))
    rows = _once(rows, unlisted=F.col("unlisted"), n=F.col("n"), m=F.col("m"), keep=F.col("keep"), n_found=F.size("found"), exact=F.transform(exact, lambda m: m["token"]), pairs=F.transform(pairs, lambda p: F.struct(p["token"]["want"].alias("want"), p["read"].alias("read"))))
    good = F.transform(F.filter("exact", lambda t: ~F.array_contains("unlisted", t["token_text"])), lambda t: t["want"])
    chars = lambda texts: F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + F.coalesce(F.length(t), F.lit(0)))
    joined = lambda side: strip(F.array_join(F.transform("pairs", lambda p: p[side]), " "))
    n, keep, found = F.col("n"), F.size("keep"), F.col("n_found")
    per = _once(
        rows, gt_total=n, found_count=found, omission_count=n - found, keep_total=keep, keep_exact_match_count=F.size("exact"), false_redaction_count=keep - F.size(good),
        keep_chars_total=chars("keep"), keep_chars_censored=chars("keep") - chars(good), word_total=F.col("m"), want=joined("want"), read=joined("read"),
    )
    return _measured(per).select("image_id", *[F.col(c).cast("long").alias(c) for c in COUNTS], "cer", "wer")


def scored(images: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per image of the dimension table; an image without tokens is a negative control.  Found and added counts stay apart.

    cer and wer, a diagnosis and no ranking signal, compare the found tokens, joined in content
    order, with what was read for them; an image where nothing was found has none.
    """
    out = images.join(counts, "image_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in COUNTS})
    added = F.col("word_total") - F.col("found_count")
    blank = F.col("gt_total") == 0
    return out.withColumns({"added_count": added, "negative_control": blank, "floor_count": F.when(blank, added).otherwise(F.lit(0)).cast("long"), "keep_exact_match_all": (F.col("keep_total") > 0) & (F.col("keep_exact_match_count") == F.col("keep_total"))}).drop("word_total")


def image_scores(images: DataFrame, tokens: DataFrame, pred: DataFrame) -> DataFrame:
    """`scored` from the matched tokens."""
    return scored(images, image_counts(tokens, pred))
