"""Pairing predictions with ground truth: box-overlap join and greedy one-to-one assignment."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmark.functions.text import nfc, normalize
from glyphmark.operators.assignment import assign, many_edged
from glyphmark.operators.overlaps import crowded, overlapping

GT = ("g", "token_text", "x0", "y0", "x1", "y1", "label")


def candidates(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, g, w, iou and both sides' fields, for pairs of one image at or above the threshold."""
    return _candidates(gt, pred, threshold, crowded(gt, pred))


def _candidates(gt: DataFrame, pred: DataFrame, threshold: float, crowd: DataFrame | None) -> DataFrame:
    return overlapping(gt, pred, threshold, crowd).select(
        "image_id", "a.g", "b.w", "iou", "a.token_text", "a.label", "b.text", "b.confidence",
        F.struct(*[F.col(f"a.{c}") for c in ("x0", "y0", "x1", "y1", "token_text", "label", "g")]).alias("gt_key"),
        F.struct(*[F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1", "text")], F.col("b.confidence").isNull().alias("unsure"), F.coalesce("b.confidence", F.lit(0.0)).alias("sure"), F.col("b.w")).alias("word_key"),
    )


def _ranked(found: DataFrame, *carried: str) -> DataFrame:
    """Best overlap first, ties by content."""
    rank = F.struct((-F.col("iou")).alias("order"), "gt_key", "word_key")
    return found.select("image_id", F.col("g").cast("long").alias("g"), F.col("w").cast("long").alias("w"), "iou", *carried, rank.alias("rank"))


def greedy(found: DataFrame) -> DataFrame:
    """image_id, g, w, iou of the pairs taken from candidates; every token and word at most once."""
    edges = _ranked(found)
    return assign(edges, many_edged(edges))


def match(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, *carried: str) -> DataFrame:
    """The same from both sides, with carried columns of the candidates; images are counted once."""
    crowd = crowded(gt, pred)
    return assign(_ranked(_candidates(gt, pred, threshold, crowd), *carried), crowd)


def omissions(gt: DataFrame, matches: DataFrame) -> DataFrame:
    return gt.join(matches, ["image_id", "g"], "left_anti")


def hallucinations(pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Unmatched words, those without a box among them."""
    return pred.join(matches, ["image_id", "w"], "left_anti")


def blobs(pred: DataFrame) -> DataFrame:
    """image_id, blob: an image's words joined in content order."""
    key = F.struct("text", F.coalesce("confidence", F.lit(0.0)).alias("sure"), "w")
    return pred.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["text"]), " ").alias("blob"))


def boxfree(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """image_id, g, found: a token is found if the image's words, joined in content order, contain it.

    An image's tokens come first and make an automaton; its words then stream through it, so nothing is
    joined or searched again for each token: the time follows words plus tokens, and only the tokens
    of one image are held.  A token without text is found wherever there are words.
    """
    none = F.lit(None).cast("string")
    tokens = gt.select("image_id", F.lit(0).alias("kind"), none.alias("key"), F.lit(0.0).alias("sure"), F.col("g").cast("long").alias("number"), normalize(F.col("token_text")).alias("text"))
    words = pred.select("image_id", F.lit(1).alias("kind"), F.col("text").alias("key"), F.coalesce("confidence", F.lit(0.0)).alias("sure"), F.col("w").cast("long").alias("number"), nfc(F.col("text")).alias("text"))
    rows = tokens.unionByName(words).repartition("image_id").sortWithinPartitions("image_id", "kind", "key", "sure", "number")
    kind = gt.schema["image_id"].dataType.simpleString()
    return rows.select("image_id", "kind", "number", "text").mapInArrow(_found, f"image_id {kind}, g long, found boolean")


class _Image:
    """The tokens of one image and which of them its words have shown so far."""

    def __init__(self, image_id):
        self.image_id, self.tokens, self.found, self.search, self.words, self.open = image_id, [], set(), None, 0, 0

    def word(self, text: str | None) -> None:
        if text is None:
            return
        if self.search is None:
            automaton = ahocorasick.Automaton()
            for _, token in self.tokens:
                if token:
                    automaton.add_word(token, token)
            self.open = len(automaton)
            if self.open:
                automaton.make_automaton()
                self.search = automaton.iter("")
        # Every word but the first follows a blank; the automaton stays where the last one left it.
        if self.open > 0:
            self.search.set((" " if self.words else "") + text, False)
            for _, token in self.search:
                if token not in self.found:
                    self.found.add(token)
                    self.open -= 1
        self.words += 1

    def rows(self):
        for g, token in self.tokens:
            yield self.image_id, g, bool(self.words) and (token == "" or token in self.found)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    image, out = None, []
    for batch in batches:
        kind = batch.schema.field("image_id").type
        emit = lambda rows, kind=kind: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (kind, pa.int64(), pa.bool_()), strict=True)], names=["image_id", "g", "found"])
        for image_id, what, number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if image is None or image.image_id != image_id:
                out += image.rows() if image else []
                image = _Image(image_id)
            if what:
                image.word(text)
            else:
                image.tokens.append((number, text))
        if out:
            yield emit(out)
            out = []
    if image and image.tokens:
        yield emit(list(image.rows()))
