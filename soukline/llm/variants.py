"""Spelling variants by a relational trie: a frontier of (word, node, rest) states is joined with the edge table.

The words stand in two tries, one of the words and one of the words reversed. A node is a prefix; only nodes where words
part or end are kept, and an edge carries the letters to the next such node, so a trie has at most two nodes a word and
any depth is crossed in as many joins as there are partings, not letters. Both tries are one distributed table of edges.
One edit lies in the first or in the second half of a word, so the first half is taken as given in one of the tries: a
word's own path is known, and it leaves that path once, at a node of its second half, by another letter (replacement) or
by leaving its letter out (deletion; an insertion is a deletion seen from the longer word). Each such state then goes on
letter for letter, level by level, until it ends on a word (a neighbour) or finds no edge. An equal run of letters is left
at its last letter only, a replacement is followed towards the greater letter only: each pair is found about once, from
one side. A node has one edge per letter, so a state meets few edges however many words share its node; rows of a
frequent node are spread by the skew join.

A node's id is a 64-bit hash of its prefix; should two prefixes share one, the states meet edges too many, and every pair
is checked by its edit distance in the end. Nothing else is approximate, and there are no caps.

Defined results: a null text has no words; a null doc_id is written as nothing in the damage; repeated rows count again.
Words shorter than MIN_LENGTH or rarer than MIN_COUNT are no words at all. Equal counts are settled by code-point order.
Texts are counted about 4 MB at a time; a longer text in pieces cut between words. An empty table gives an empty result.
Other columns than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soukline.llm.common import cut
from soukline.llm.words import hashes, mix, slices

MIN_LENGTH = 6
MIN_COUNT = 5
FAVOUR = 5
DAMAGE = 199
# No edit of a word's second half lies before this letter, in either direction.
FIRST_DEPTH = MIN_LENGTH // 2
PIECE = 1 << 20
_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile("[^a-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        stop = _GAP.search(text, at + PIECE)
        to = stop.start() if stop else len(text)
        yield text[at:to]
        at = to


def damage(word: str, name: bytes) -> str:
    """op12's damage: ``name`` is ``doc_id:``."""
    h = zlib.crc32(word.encode(), zlib.crc32(name))
    return word if h % DAMAGE else word[: h % len(word)] + word[h % len(word) + 1:]


def vocabulary(docs: DataFrame, changed: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """(word, n): every word of ``docs`` (doc_id, text) that is long and frequent enough, and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            total: Counter[str] = Counter()
            for k, doc in enumerate(batch.column(0).to_pylist()):
                found: Counter[str] = Counter()
                for piece in _pieces(texts.raw(k).lower().decode(errors="replace")):
                    found.update(_RUN.findall(piece))
                # a word is damaged by its document and itself, so its occurrences in one text go together
                name = f"{'' if doc is None else doc}:".encode()
                for word, n in found.items():
                    word = changed(word, name) if changed else word
                    if len(word) >= MIN_LENGTH:
                        total[word] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
            )

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wid, back, depth, node, next) for each prefix of FIRST_DEPTH letters or more; next is empty at the word's end."""
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for back in (False, True):
            data, starts, ends, wid, depth, nexts = bytearray(), [], [], [], [], []
            for i, word in zip(ids, words, strict=True):
                word = word[::-1] if back else word
                start = len(data)
                for k, letter in enumerate(word):
                    if k >= FIRST_DEPTH:
                        ends.append(len(data))
                        nexts.append(letter)
                    data += letter.encode()
                ends.append(len(data))
                nexts.append("")
                n = max(0, len(word) - FIRST_DEPTH) + 1
                starts += [start] * n
                wid += [i] * n
                depth += range(len(word) - n + 1, len(word) + 1)
            node = hashes(np.frombuffer(bytes(data), np.uint8), np.array(starts, np.int64), np.array(ends, np.int64))
            node = mix(node + np.uint64(1)) if back else node
            yield pa.RecordBatch.from_arrays(
                [pa.array(wid, pa.int64()), pa.array([back] * len(wid), pa.bool_()), pa.array(depth, pa.int32()),
                 pa.array(node.view(np.int64)), pa.array(nexts, pa.string())],
                names=["wid", "back", "depth", "node", "next"],
            )


def paths(words: DataFrame) -> DataFrame:
    """(wid, back, letters, size, points): each word in both directions, with the nodes on its path as (depth, node)."""
    steps = cut(words.select("wid", "word").mapInArrow(_prefixes, "wid long, back boolean, depth int, node long, next string"))
    parted = F.col("low") != F.col("high")
    nodes = steps.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high")).filter(parted | (F.col("low") == ""))
    points = (
        steps.join(nodes.select("node"), "node", "left_semi")
        .groupBy("wid", "back").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("points"))
    )
    letters = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    return points.join(words, "wid").select("wid", "back", letters.alias("letters"), F.length("word").alias("size"), "points")


def edges(ways: DataFrame) -> DataFrame:
    """(node, first, label, child, ends): the letters from a node to the next, and the word that ends there, if any."""
    last = F.size("points")
    pairs = F.arrays_zip(F.slice("points", F.lit(1), last - 1).alias("a"), F.slice("points", F.lit(2), last - 1).alias("b"))
    steps = ways.filter(last > 1).select("wid", "letters", "size", F.explode(pairs).alias("p"))
    label = F.substr("letters", F.col("p.a.depth") + 1, F.col("p.b.depth") - F.col("p.a.depth"))
    told = steps.select(
        F.col("p.a.node").alias("node"), label.alias("label"), F.col("p.b.node").alias("child"),
        F.when(F.col("p.b.depth") == F.col("size"), F.col("wid")).alias("wid"),
    )
    return told.groupBy("node", "label", "child").agg(F.max("wid").alias("ends")).withColumn("first", F.substring("label", 1, 1))


def _starts(ways: DataFrame, table: DataFrame) -> DataFrame:
    """(wid, at, ends, rest): the states one edit away from a word's own path."""
    half = F.floor(F.col("size") / 2)
    least = F.when(F.col("back"), F.col("size") - half).otherwise(half)
    off = (
        ways.select("wid", "letters", "size", least.alias("least"), F.explode("points").alias("p"))
        .filter((F.col("p.depth") >= F.col("least")) & (F.col("p.depth") < F.col("size")))
        .select("wid", F.col("p.node").alias("node"), F.substr("letters", F.col("p.depth") + 1).alias("own"))
    )
    own, two = F.substring("own", 1, 1), F.substring("own", 2, 1)
    after = F.substr("own", F.lit(2))
    tail = F.substr("label", F.lit(2))
    replaced = (F.col("first") > own) & F.startswith(after, tail)
    deleted = (own != two) & (two == F.col("first")) & F.startswith(after, F.col("label"))
    cost = F.length("label") + F.when(replaced, 1).otherwise(2)
    turned = (
        off.join(table, "node").filter(replaced | deleted)
        # a letter that is both the greater one and the next is two edits with two outcomes
        .withColumn("edits", F.filter(F.array(F.when(replaced, 1), F.when(deleted, 2)), lambda x: x.isNotNull()))
        .select("wid", F.col("child").alias("at"), "ends", F.explode("edits").alias("edit"), "own", F.length("label").alias("n"))
        .select("wid", "at", "ends", F.substr("own", F.col("n") + F.col("edit")).alias("rest"))
    )
    tips = ways.select(F.element_at("points", -1)["node"].alias("node"), F.col("wid").alias("ends"))
    short = off.filter(F.length("own") == 1).join(tips, "node")
    return turned.union(short.select("wid", F.col("node").alias("at"), "ends", F.lit("").alias("rest")))


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b): ids of all pairs of ``words`` (wid, word; each word once) one edit apart, each pair once."""
    ways = cut(paths(words))
    table = cut(edges(ways))
    state = cut(_starts(ways, table))
    found = None
    while True:
        here = state.filter("rest = '' AND ends IS NOT NULL").select("wid", "ends")
        found = here if found is None else found.union(here)
        left = state.filter("rest <> ''").select("wid", F.col("at").alias("node"), "rest", F.substring("rest", 1, 1).alias("first"))
        if left.isEmpty():
            break
        met = left.join(table, ["node", "first"]).filter(F.startswith("rest", F.col("label")))
        state = cut(met.select("wid", F.col("child").alias("at"), "ends", F.substr("rest", F.length("label") + 1).alias("rest")))
    pairs = found.select(F.least("wid", "ends").alias("a"), F.greatest("wid", "ends").alias("b")).distinct()
    named = words.select("wid", "word")
    both = pairs.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
    return both.filter(F.levenshtein("x", "y", 1) == 1).select("a", "b")


def _rooted(forms: DataFrame) -> DataFrame:
    """(wid, root) of words with a form: the last word that following forms leads to, by pointer doubling.

    A form is FAVOUR times as frequent as its word, so ways are short and there are no rings.
    """
    now = cut(forms.select("wid", F.col("form_id").alias("root")))
    while True:
        jump = now.select(F.col("wid").alias("root"), F.col("root").alias("far"))
        after = cut(now.join(jump, "root", "left").select("wid", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        now = after.select("wid", "root")
        if after.filter("moved").isEmpty():
            return now


def grouped(counts: DataFrame) -> DataFrame:
    """op12's columns for ``counts`` (word, n; each word once)."""
    words = cut(counts.select("word", "n").withColumn("wid", F.monotonically_increasing_id()))
    pairs = cut(neighbours(words))
    other = words.select(F.col("wid").alias("b"), F.struct((-F.col("n")).alias("less"), "word", "wid").alias("best"))
    # a neighbour's word and count meet each pair once from either side; the best is found before rows are dealt out
    best = (
        pairs.union(pairs.select("b", "a")).join(other, "b")
        .groupBy(F.col("a").alias("wid")).agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    )
    told = cut(words.join(best, "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= FAVOUR * F.col("n"), F.col("best")).alias("best"),
    ))
    roots = _rooted(told.filter("best IS NOT NULL").select("wid", F.col("best.wid").alias("form_id")))
    named = roots.join(words.select(F.col("wid").alias("root"), F.col("word").alias("root_word")), "root").select("wid", "root_word")
    return told.join(named, "wid", "left").select(
        "word", F.col("best.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near",
        (-F.col("best.less")).alias("form_n"),
    )


def op12(docs: DataFrame) -> DataFrame:
    return grouped(vocabulary(docs, damage))
