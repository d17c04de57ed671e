"""Packing documents into training sequences under several limits at once.

Documents are tokenized word by word through a cache, cut into full sequences, and what is left
of each document is packed with others: a vector bin packing by dot products, in which a
sequence takes the piece whose needs point most in the direction of the room it has left.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchwell.llm.common import kept, written

END_ID = 1
#: Pieces that are packed with each other, on average.
GROUP_PIECES = 8192


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a cache of white-space words.

    The tokenizer drops white space and lets no token cross it, so a text's ids are those of its
    words, one after the other. A word that is not known yet is split once more into runs of
    small letters and others, which are words too; runs of small letters skip the tokenizer's
    normalizer, which leaves them as they are. The cache has two generations of half of
    ``cache_words`` each: what a batch needs moves to the younger one, and when that is full the
    older one goes, so frequent words stay and rare ones are forgotten."""

    #: White space in the tokenizer's and in Python's eyes; other kinds stay inside a word.
    SPACE = re.compile(r"[ \t\n\r]+")
    OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    #: Words of characters that no normal form changes and whose small forms do not depend on
    #: their neighbours; without the apostrophe, which the tokenizer joins to some letters.
    LATIN = re.compile(r"[\x00-&(-\x7fÀ-ÖØ-öø-ÿ]*")
    PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
    RUNS = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+")

    def __init__(self, path: str, cache_words: int = 600_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cache_words = cache_words
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.SPACE.split(x) if self.OTHER_SPACE.search(x) else x.split() for x in texts]
        if 2 * len(self.words) > self.cache_words:
            self.older, self.words = self.words, {}
        new = set().union(*split).difference(self.words)
        known = new.intersection(self.older)
        self.words.update((word, self.older[word]) for word in known)
        new -= known
        if new:
            self._learn(new)
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _learn(self, words: set[str]) -> None:
        plain, other, splits = set(), set(), []
        for word in words:
            if self.PLAIN.fullmatch(word):
                plain.add(word)
            elif self.LATIN.fullmatch(word) and "<|" not in word:
                splits.append((word, self.RUNS.findall(word.lower())))
            else:
                other.add(word)
        for _, runs in splits:
            for x in runs:
                if x in self.older:
                    self.words[x] = self.older[x]
                elif x not in self.words:
                    (plain if self.PLAIN.match(x) else other).add(x)
        # the byte-level form of an ASCII word is the word itself, which the model takes as it is
        pieces, ascii_words = self.bare.model.tokenize, {x for x in plain if x.isascii()}
        for word in ascii_words:
            self.words[word] = array("I", [piece.id for piece in pieces(word)]).tobytes()
        for some, tokenizer in ((list(plain - ascii_words), self.bare), (list(other), self.full)):
            for at in range(0, len(some), 10_000):
                part = some[at : at + 10_000]
                for word, found in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    self.words[word] = array("I", found.ids).tobytes()
        for word, runs in splits:
            self.words[word] = b"".join([self.words[x] for x in runs])


PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str | None = None, size: int = 2048, ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids of each document: full ones, then what is left.

    ``doc_id`` comes as a string, as pandas has no whole numbers with nulls. With ``ids`` the ids
    themselves are a column too. A null text is empty and is its end id alone;
    so every document has a piece."""
    path = path or tokenizer_path()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = kept(f"words of {path}", lambda: WordTokenizer(path))
        for batch in batches:
            texts = [x or "" for x in batch["text"]]
            for group, keys in _portions(texts, batch["doc_id"].tolist()):
                rows = []
                for key, raw in zip(keys, tokenizer.encode(group)):
                    raw += end
                    total = len(raw) // 4
                    for at in range(0, total, size):
                        piece = raw[4 * at : 4 * (at + size)]
                        rows.append((key, at, len(piece) // 4, zlib.crc32(piece), total, piece)[: 6 if ids else 5])
                names = [x.strip().split(" ")[0] for x in schema.split(",")]
                yield pd.DataFrame(rows, columns=names)

    schema = PIECES + (", ids binary" if ids else "")
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, schema)


def _portions(texts: list[str], keys: list, limit: int = 4 << 20) -> Iterator[tuple[list[str], list]]:
    first = size = 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > limit:
            yield texts[first:k], keys[first:k]
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield texts[first:], keys[first:]


def pack_group(needs: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bin of each item. ``needs``: items by resources, none above ``room``.

    Bins are filled one after the other. Each opens with the item of the largest needs and takes,
    of the items that fit, the one with the greatest dot product of its needs and the room left,
    both as shares of a full bin. Equal items are interchangeable, so different needs are looked
    at once, with their counts; equal products go to the larger, then the earlier needs."""
    kinds, which, counts = np.unique(needs, axis=0, return_inverse=True, return_counts=True)
    which = which.reshape(-1)
    share = kinds / room
    large = np.argsort(-share.sum(axis=1), kind="stable")
    kinds, share, counts = kinds[large], share[large], counts[large]
    place = np.empty(len(large), np.int64)
    place[large] = np.arange(len(large))
    of_kind = np.split(np.argsort(place[which], kind="stable"), np.cumsum(counts)[:-1])
    taken = np.zeros(len(kinds), np.int64)
    bins = np.full(len(needs), -1, np.int64)
    number = first = 0
    left = counts.copy()
    while first < len(kinds):
        rest = room.astype(float)
        k = first
        while k >= 0:
            bins[of_kind[k][taken[k]]] = number
            taken[k] += 1
            left[k] -= 1
            rest = rest - kinds[k]
            fits = (left[first:] > 0) & (kinds[first:] <= rest).all(axis=1)
            score = np.where(fits, share[first:] @ (rest / room), -1.0)
            best = int(score.argmax()) if len(score) else 0
            k = first + best if len(score) and score[best] >= 0 else -1
        number += 1
        while first < len(kinds) and not left[first]:
            first += 1
    return bins


def pack(rows: DataFrame, limits: Limits = Limits(), group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id, start, length, loss_tokens``.

    Pieces go to groups of a bounded size by a hash of what they are, each group is packed by
    itself, and the groups' numbers of sequences make the ids gapless. So neither a hot source nor
    a large input meets in one task, and only a group's last sequence is left half empty."""
    rows = written(rows, "pieces")
    n = rows.count()
    groups = max(1, round(n / group_pieces))
    room = np.array([limits.tokens, limits.segments, limits.loss_tokens])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=False, kind="stable").reset_index(drop=True)
        needs = np.stack([pdf["length"], np.ones(len(pdf), np.int64), pdf["loss_tokens"]], axis=1)
        full = (needs >= room).any(axis=1)
        bins = np.empty(len(pdf), np.int64)
        bins[full] = np.arange(full.sum())
        if (~full).any():
            bins[~full] = pack_group(needs[~full], room) + full.sum()
        pdf["_bin"] = bins
        pdf = pdf.sort_values("_bin", kind="stable")
        pdf["offset"] = pdf.groupby("_bin")["length"].cumsum() - pdf["length"]
        return pdf

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    packed = written(dealt.groupBy("_group").applyInPandas(run, f"{schema}, _bin long, offset long"), "packed")
    counts = packed.groupBy("_group").agg((F.max("_bin") + 1).alias("_bins"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # a row for each group
    first = counts.select("_group", F.coalesce(F.sum("_bins").over(before), F.lit(0)).alias("_first"))
    numbered = packed.join(first, "_group").withColumn("sequence_id", F.col("_first") + F.col("_bin"))
    return numbered.drop("_group", "_bin", "_first")


def pack_documents(docs: DataFrame, limits: Limits = Limits(), path: str | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, a row for each piece.

    All ids of a document bear loss. Null texts are empty: their end id alone. Rows with null or
    repeated ids are documents of their own; an empty table gives no rows; other columns are
    ignored."""
    size = min(limits.tokens, limits.loss_tokens)
    rows = pieces(docs, path, size).withColumn("loss_tokens", F.col("length"))
    packed = pack(rows, limits).drop("loss_tokens")
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))
