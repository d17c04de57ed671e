"""Scores of documents by a unigram model over subwords, summed over all segmentations.

A text is its words, each with a space before it, then an end. Pieces of an existing vocabulary
are drawn one after the other, the end among them; a word's probability is the sum over all ways
to write it in pieces, by a forward recursion in log space over the lattice of its bytes. The
vocabulary's order gives first scores (Zipf's law over its ranks), and expected counts over
the lattices of all training words give the scores used.

Words are counted and scored once each, not once for each occurrence: blocks of documents send
lists of their different words to ranges of words, and get a list of numbers back.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchwell.llm.common import block_count, block_of, kept, mix, utf8, written

EM_ROUNDS = 4
#: Weight of the vocabulary's own scores against the expected counts, in pieces.
PRIOR_PIECES = 1000.0
BLOCK_TEXT = 16 << 20
#: Different words that a task gathers before it passes their counts on.
_FLUSH_WORDS = 400_000
#: Cells of a lattice that are worked on at once.
_CELLS = 1 << 20


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str) -> list[tuple[bytes, float]]:
    """Pieces as bytes with first scores (natural logs): those that can occur in lower-cased
    words, merged where two have the same bytes; every single byte is one."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for rank in range(model.get_piece_size()):
        if model.is_control(rank) or model.is_unknown(rank) or model.is_unused(rank):
            continue
        piece = model.id_to_piece(rank)
        raw = bytes([int(piece[3:5], 16)]) if model.is_byte(rank) else piece.replace("▁", " ").encode()
        if any(65 <= b <= 90 for b in raw) or b" " in raw[1:] or any(9 <= b <= 13 for b in raw):
            continue
        weight[raw] = weight.get(raw, 0.0) + 1 / (1 - model.get_score(rank))
    total = sum(weight.values())
    return [(piece, float(np.log(w / total))) for piece, w in sorted(weight.items())]


class Lattice:
    """Finds all pieces in words, and sums over all paths through them."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.n = len(pieces)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for number, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append((int(self._codes(np.frombuffer(piece, np.uint8)[None], len(piece))[0, 0]), number))
        self.tables = {}
        for length, own in sorted(by_length.items()):
            own.sort()
            codes = np.array([x[0] for x in own], np.uint64)
            if len(np.unique(codes)) < len(codes):
                raise ValueError("two pieces with one code")
            seen = np.zeros(1 << 19, bool)
            seen[mix(codes) >> np.uint64(45)] = True
            self.tables[length] = (codes, np.array([x[1] for x in own]), seen, pieces)

    @staticmethod
    def _codes(words: np.ndarray, length: int) -> np.ndarray:
        """Of each place the next ``length`` bytes as a number: exact up to eight, then hashed."""
        places = words.shape[1] - length + 1
        out = np.zeros((len(words), places), np.uint64)
        for k in range(length):
            out = out << np.uint64(8) if k < 8 else out * np.uint64(0x9E3779B97F4A7C15)
            out ^= words[:, k : k + places]
        return out

    def edges(self, words: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, row, place, piece) of all pieces in words of one length, by piece length."""
        out = []
        for length, (codes, numbers, seen, pieces) in self.tables.items():
            if length > words.shape[1]:
                break
            found = self._codes(words, length)
            row, place = np.nonzero(seen[mix(found) >> np.uint64(45)])
            own = found[row, place]
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            hit = codes[at] == own
            row, place, number = row[hit], place[hit], numbers[at[hit]]
            if length > 8:  # hashed: compare the bytes
                same = np.fromiter((words[r, p : p + length].tobytes() == pieces[k] for r, p, k in zip(row, place, number)), bool, len(row))
                row, place, number = row[same], place[same], number[same]
            if len(row):
                out.append((length, row, place, number))
        return out

    @staticmethod
    def forward(n: int, width: int, edges: list, scores: np.ndarray) -> tuple[np.ndarray, list]:
        """Log sums over all paths from the start to each place, and the edges' dense scores."""
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0.0
        dense = []
        for length, row, place, number in edges:
            score = np.full((n, width - length + 1), -np.inf)
            score[row, place] = scores[number]
            dense.append((length, score))
        with np.errstate(invalid="ignore"):
            for end in range(1, width + 1):
                for length, score in dense:
                    if length <= end:
                        alpha[:, end] = np.logaddexp(alpha[:, end], alpha[:, end - length] + score[:, end - length])
        return alpha, dense

    def batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices and bytes of words of one length, in portions."""
        sizes = np.array([len(x) for x in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for same in np.split(order, cuts) if len(order) else []:
            width = int(sizes[same[0]]) + 1
            step = max(1, _CELLS // width)
            for at in range(0, len(same), step):
                some = same[at : at + step]
                raw = b" " + b" ".join([words[i] for i in some])
                yield some, np.frombuffer(raw, np.uint8).reshape(len(some), width)

    def marginals(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability over all segmentations."""
        out = np.zeros(len(words))
        for some, matrix in self.batches(words):
            alpha, _ = self.forward(*matrix.shape, self.edges(matrix), scores)
            out[some] = alpha[:, -1]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Expected number of each piece in words that occur so many times."""
        total = np.zeros(self.n)
        for some, matrix in self.batches(words):
            n, width = matrix.shape
            edges = self.edges(matrix)
            alpha, dense = self.forward(n, width, edges, scores)
            beta = np.full((n, width + 1), -np.inf)
            beta[:, -1] = 0.0
            with np.errstate(invalid="ignore"):
                for start in range(width - 1, -1, -1):
                    for length, score in dense:
                        if start + length <= width:
                            beta[:, start] = np.logaddexp(beta[:, start], beta[:, start + length] + score[:, start])
            for length, row, place, number in edges:
                log = alpha[row, place] + scores[number] + beta[row, place + length] - alpha[row, -1]
                total += np.bincount(number, np.exp(log) * counts[some][row], self.n)
        return total


@dataclass
class Model:
    """``scores`` of the pieces and the end (natural logs), and the counts of the base score."""

    pieces: list[bytes]
    scores: np.ndarray
    end_score: float
    tokens: int
    types: int
    ends: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def _lattice(pieces: list[bytes]) -> Lattice:
    """Built once in a worker process for each vocabulary."""
    return kept(f"lattice of {hash(tuple(pieces))}", lambda: Lattice(pieces))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only, ASCII white space only


def held_out(doc_id: Column) -> Column:
    """Documents kept from training; a null id counts as empty."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(5)) == 1


# --- counting -------------------------------------------------------------------------------


def _ranges(words: list[bytes], ranges: int) -> list[np.ndarray]:
    """Indices of the words of each range, in their order."""
    where = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % ranges
    order = np.argsort(where, kind="stable")
    return np.split(order, np.searchsorted(where[order], np.arange(1, ranges))) if ranges > 1 else [order]


def _table(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.table([pa.array(x, t) for x, t in zip(columns, types)], names=names)


def count_words(docs: DataFrame, ranges: int) -> DataFrame:
    """``_range, _words, _counts``: the different words of each range in one packet, with counts."""
    names, types = ["_range", "_words", "_counts"], [pa.int32(), pa.binary(), pa.binary()]

    def packets(counter: Counter) -> pa.Table:
        words = list(counter)
        counts = np.fromiter(counter.values(), np.int64, len(words))
        rows = [
            (r, b" ".join([words[i] for i in own]), counts[own].tobytes())
            for r, own in enumerate(_ranges(words, ranges))
            if len(own)
        ]
        return _table(names, types, rows)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter: Counter = Counter()
        for batch in batches:
            for text in batch.column("_utf8"):
                counter.update(words_of(text.as_py()))
                if len(counter) > _FLUSH_WORDS:
                    yield from packets(counter).to_batches()
                    counter = Counter()
        yield from packets(counter).to_batches()

    def add(packets_: pa.Table) -> pa.Table:
        counter: Counter = Counter()
        for words, counts in zip(packets_.column("_words").to_pylist(), packets_.column("_counts").to_pylist()):
            for word, n in zip(words.split(b" "), np.frombuffer(counts, np.int64).tolist()):
                counter[word] += n
        words = list(counter)
        counts = np.fromiter(counter.values(), np.int64, len(words)).tobytes()
        return _table(names, types, [(packets_.column("_range")[0].as_py(), b" ".join(words), counts)])

    schema = "_range int, _words binary, _counts binary"
    return docs.select("_utf8").mapInArrow(count, schema).groupBy("_range").applyInArrow(add, schema)


def train(words: DataFrame, ends: int, path: str, rounds: int = EM_ROUNDS) -> Model:
    """Scores from the packets of :func:`count_words`: so many rounds of expected counts. What
    reaches the driver is one number for each piece of the vocabulary."""
    known = vocabulary(path)
    pieces = [x[0] for x in known]
    prior = np.exp(np.array([x[1] for x in known]))
    scores, end_score = np.log(prior), 0.0

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.frombuffer(x, np.int64) for x in batch.column("_counts").to_pylist()]
            rows = [(len(x), int(x.sum())) for x in counts]
            yield from _table(["types", "tokens"], [pa.int64()] * 2, rows).to_batches()

    total = words.mapInArrow(sizes, "types long, tokens long").agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = (total[0] or 0) + (ends > 0), (total[1] or 0) + ends
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((pieces, scores))  # as large as the vocabulary

        def expect(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, scores = shared.value
            lattice = _lattice(pieces)
            sums = np.zeros(len(pieces))
            for batch in batches:
                for own, counts in zip(batch.column("_words").to_pylist(), batch.column("_counts").to_pylist()):
                    sums += lattice.expected(own.split(b" "), np.frombuffer(counts, np.int64), scores)
            used = np.flatnonzero(sums)
            yield from pa.table({"piece": used, "n": sums[used]}).to_batches()

        found = words.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n")).collect()
        counts = np.zeros(len(pieces))
        for piece, n in found:
            counts[piece] = n
        weight = counts.sum() + ends + PRIOR_PIECES
        scores = np.log((counts + prior * (PRIOR_PIECES - 1)) / weight)
        end_score = float(np.log((ends + 1) / weight))
    return Model(pieces, scores, end_score, tokens, types, ends)


# --- scoring --------------------------------------------------------------------------------


def _block_words(docs: pa.Table, ranges: int) -> tuple[list[int], list[list[bytes]], dict[bytes, int], list[np.ndarray]]:
    """The documents of a block in a fixed order, their words, and the different words by range."""
    ids, texts = docs.column("_id").to_pylist(), docs.column("_utf8").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    words = [words_of(texts[i]) for i in order]
    index: dict[bytes, int] = {}
    for own in words:
        for word in own:
            index.setdefault(word, len(index))
    return order, words, index, _ranges(list(index), ranges)


def score(docs: DataFrame, path: str | None = None, rounds: int = EM_ROUNDS, block_bytes: int = BLOCK_TEXT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every document.

    Null and empty texts are an end alone. Rows with null or repeated ids are documents of their
    own; an empty table gives no rows; other columns are ignored. Without training documents no
    token is known and the vocabulary's own scores hold."""
    path = path or vocabulary_path()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        utf8("text").alias("_utf8"),
    )
    blocks = block_count(rows, "_utf8", block_bytes)
    training = rows.where(~F.col("held_out"))
    known = written(count_words(training, blocks), "words")
    model = train(known, training.count(), path, rounds)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary
    dealt = rows.withColumn("_block", block_of("_id", blocks))

    def ask(docs: pa.Table) -> pa.Table:
        block = docs.column("_block")[0].as_py()
        _, _, index, own = _block_words(docs, blocks)
        words = list(index)
        packets = [(r, block, b" ".join([words[i] for i in some])) for r, some in enumerate(own) if len(some)]
        return _table(["_range", "_block", "_words"], [pa.int32(), pa.int32(), pa.binary()], packets)

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        model = shared.value
        names, types = ["_block", "_range", "_data"], [pa.int32(), pa.int32(), pa.binary()]
        if not asked.num_rows:
            return _table(names, types, [])
        lists = [x.split(b" ") for x in asked.column("_words").to_pylist()]
        words = list(dict.fromkeys(w for own in lists for w in own))
        counts: dict[bytes, int] = {}
        for own, n in zip(known.column("_words").to_pylist(), known.column("_counts").to_pylist()):
            counts.update(zip(own.split(b" "), np.frombuffer(n, np.int64).tolist()))
        log = dict(zip(words, _lattice(model.pieces).marginals(words, model.scores).tolist()))
        rows = []
        range_ = asked.column("_range")[0].as_py()
        for block, own in zip(asked.column("_block").to_pylist(), lists):
            n = np.array([counts.get(w, 0) for w in own], np.int64)
            rows.append((block, range_, pickle.dumps((n, np.array([log[w] for w in own])), protocol=5)))
        return _table(names, types, rows)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def total(docs: pa.Table, answers: pa.Table) -> pa.Table:
        model = shared.value
        order, words, index, own = _block_words(docs, blocks)
        counts, logs = np.zeros(len(index), np.int64), np.zeros(len(index))
        for r, data in zip(answers.column("_range").to_pylist(), answers.column("_data").to_pylist()):
            counts[own[r]], logs[own[r]] = pickle.loads(data)
        base, logs, seen = model.base(counts), logs / np.log(10), counts > 0
        end_base = float(model.base(np.array([model.ends]))[0])
        ids, held = docs.column("doc_id").to_pylist(), docs.column("held_out").to_pylist()
        rows = []
        for row, text in zip(order, words):
            at = np.fromiter(map(index.__getitem__, text), np.int64, len(text))
            known = int(seen[at].sum()) + (model.ends > 0)
            sums = float(base[at].sum()) + end_base, float(logs[at].sum()) + model.end_score / np.log(10)
            rows.append((ids[row], held[row], len(text) + 1, known, model.tokens, *map(float, sums)))
        return _table(names, kinds, rows)

    asked = dealt.groupBy("_block").applyInArrow(ask, "_range int, _block int, _words binary")
    answers = asked.groupBy("_range").cogroup(known.groupBy("_range")).applyInArrow(answer, "_block int, _range int, _data binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(total, schema)
