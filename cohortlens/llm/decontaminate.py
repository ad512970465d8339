"""Benchmark decontamination: latent semantic candidates, then subsequence and answer checks.

Documents are read in passages of ``PASSAGE`` words, every ``STEP`` words. Words are hashed to
``SLOTS`` slots and weighted by TF-IDF; the document frequencies are counted over all documents. A
randomised singular value decomposition gives the latent space: all words of all documents, in
passages that follow one another, are multiplied with random vectors and back in one distributed pass,
which gives a factor of the documents' part (Nystroem); the benchmark's passages are multiplied as
they are. The factors, whose size is fixed, are orthogonalised on the driver. Every passage of every
document that has enough of an item's rarer words around it to hold the item is projected (``Rare``
loses no pair that would be confirmed), and the benchmark items of cosine ``COSINE`` or more are its candidates.
Items that share ``GRAM`` words in a row with a passage are its candidates, too, so a copy is found
however common its words are and whatever stands beside it.

A candidate is decided on words: the longest common subsequence of the item and the text around the
passage must hold ``COVERED`` of the item's words, in a stretch not much longer than the item, and
when an item has an answer (the words after ``answer:``), all of it must stand there, too.

Benchmark items are taken in blocks, so any number of them works; what travels to the executors is
fixed by ``SLOTS``, ``RANK`` and ``BLOCK``. Null and empty texts and items match nothing, items
of fewer than ``LEAST`` words must occur word for word and are looked up by their words, repeated rows are judged each, equal
items are all reported, extra columns are left alone, and empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.common import WORD_BYTES, double, lean, long, plain_words, trim_memory, small_batches
from cohortlens.session import cut_lineage

PASSAGE, STEP = 32, 16
SLOTS = 1 << 15
RANK, MORE = 64, 16
#: Random vectors that the passages of all documents are multiplied with.
PROBES = 32
#: Words that are multiplied at once.
FIT_WORDS = 1 << 15
#: Benchmark items that share a latent space.
BLOCK = 256
COSINE = 0.42
#: Words in a row that make an item a candidate without the latent space.
GRAM = 4
#: The least weight of a word; words of all documents would count nothing otherwise.
LIGHTEST = 0.1
COVERED = 0.6
STRETCH = 1.6
LEAST = 6
#: Share of an item's words that must stand near a passage among the item's rarer ones.
RARE = 0.2
#: How much more the benchmark's passages weigh in the fit than those of all documents together.
EMPHASIS = 4.0
SENT_ROWS = 1_000_000
#: Texts that are Python objects at a time.
SLICE = 64


#: Bytes that are hashed at once; longer texts are cut at a blank, and words longer than this, too.
CHUNK = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_POWERS = np.multiply.accumulate(np.full(CHUNK + 1, _BASE, dtype=np.uint64))
_INVERSES = np.multiply.accumulate(np.full(CHUNK + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64))


def word_slots(texts: list[bytes]) -> list[np.ndarray]:
    """The slot of each word of each text, hashed in one go over the bytes of many texts."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for text in texts:
        if size + len(text) >= CHUNK and group:
            out += _hashed(group)
            group, size = [], 0
        if len(text) >= CHUNK:
            parts = [_hashed([part])[0] for part in _cut(text.translate(WORD_BYTES))]
            out.append(np.concatenate(parts))
        else:
            group.append(text)
            size += len(text) + 1
    return out + _hashed(group)


def _cut(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at >= CHUNK:
        end = text.rfind(b" ", at, at + CHUNK - 1)
        end = end if end > at else at + CHUNK - 1
        yield text[at:end]
        at = end
    yield text[at:]


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    if not texts:
        return []
    data = np.frombuffer(b" ".join([*texts, b""]).translate(WORD_BYTES), dtype=np.uint8)
    if not len(data):
        return [np.empty(0, dtype=np.int64)]
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    # A word's polynomial is a difference of prefix sums, shifted to begin at power one.
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(data * _POWERS[: len(data)], dtype=np.uint64)])
    value = (sums[ends] - sums[starts]) * _INVERSES[starts]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    slots = (value >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
    offsets = np.cumsum([len(t) + 1 for t in texts])[:-1]
    return np.split(slots, np.searchsorted(starts, offsets))


def lcs(item: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence of two word lists, a bit for each word of ``item``."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    ones = (1 << len(item)) - 1
    state = ones
    for w in text:
        hit = state & places.get(w, 0)
        state = ((state + hit) | (state - hit)) & ones
    return len(item) - state.bit_count()


@dataclass(frozen=True)
class Item:
    number: int
    words: list[bytes]
    answer: list[bytes]


def read_item(number: int, text: str) -> Item:
    question, _, answer = text.partition("Answer:") if "Answer:" in text else text.partition("answer:")
    return Item(number, plain_words(text.encode()), plain_words(answer.encode()))


def _place(words: list[bytes], part: list[bytes]) -> int | None:
    """Where ``part`` stands word for word."""
    n = len(part)
    return next((i for i in range(len(words) - n + 1) if words[i : i + n] == part), None)


def confirmed(item: Item, words: list[bytes], at: int) -> tuple[float, int, int] | None:
    """Share of the item's words found around the passage at ``at``, and where; None if too few."""
    n = len(item.words)
    low, high = max(0, at - n), min(len(words), at + PASSAGE + n)
    around = words[low:high]
    exact = _place(around, item.words)
    if exact is not None:
        return 1.0, low + exact, low + exact + n
    if n < LEAST:
        return None
    need = int(np.ceil(COVERED * n))
    if lcs(item.words, around) < need:
        return None
    known = set(item.words)
    best: tuple[int, int, int] | None = None
    width = int(STRETCH * n)
    # Stretches begin with a word of the item; a few steps apart is close enough to pass the test.
    starts = [i for i, w in enumerate(around) if w in known]
    for start in starts[:: max(1, n // 12)]:
        stretch = around[start : start + width]
        found = lcs(item.words, stretch)
        if best is None or found > best[0]:
            best = (found, low + start, low + start + len(stretch))
    if best is None or best[0] < need:
        return None
    if item.answer and lcs(item.answer, words[best[1] : best[2] + len(item.answer)]) < len(item.answer):
        return None
    return best[0] / n, best[1], best[2]


def passage_starts(n: int) -> range:
    """Where passages begin: every ``STEP`` words, the last one reaching the end of the text."""
    return range(0, max(1, n - PASSAGE + STEP), STEP)


# ---- fitting the space


def slots_once(slots: np.ndarray) -> np.ndarray:
    ranked = np.sort(slots)
    return ranked[np.concatenate([[True], ranked[1:] != ranked[:-1]])]


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that use each slot, and their number; one addition per slot and task."""
    out = T.StructType([T.StructField("slot", T.IntegerType()), long("n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(SLOTS, dtype=np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for slots in word_slots(batch.column(0).slice(at, SLICE).to_pylist()):
                    if len(slots):
                        total[slots_once(slots)] += 1
                        texts += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(used, -1).astype(np.int32)),
                pa.array(np.append(total[used], texts)),
            ],
            schema=to_arrow_schema(out),
        )

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")
    counted = small_batches(docs).select(text).mapInArrow(lean(run), out).groupBy("slot").agg(F.sum("n").alias("n"))
    found = {r["slot"]: r["n"] for r in counted.collect()}  # SLOTS + 1 rows at most
    texts = found.pop(-1, 0)
    total = np.zeros(SLOTS)
    if found:
        total[list(found)] = list(found.values())
    return total, texts


def _weights(frequency: np.ndarray, texts: int) -> np.ndarray:
    """Inverse document frequencies, ``LIGHTEST`` at least."""
    return np.maximum(np.log((texts + 1) / (frequency + 1)), LIGHTEST).astype(np.float32)


def _item_slots(items: list[Item]) -> list[np.ndarray]:
    return word_slots([b" ".join(i.words) for i in items])


def _rows(ids: np.ndarray, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and unit-length TF-IDF weights of each passage of a text."""
    out = []
    for start in passage_starts(len(ids)):
        slots, counts = np.unique(ids[start : start + PASSAGE], return_counts=True)
        weight = counts * idf[slots]
        norm = float(np.sqrt((weight**2).sum()))
        if norm > 0:
            out.append((slots, weight / norm))
    return out


def _random(width: int) -> np.ndarray:
    """Random vectors, the same in every task."""
    return np.random.default_rng(7).standard_normal((SLOTS, width)).astype(np.float32)


def _in_rows(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of texts, each begun in a row of its own of ``width`` words and filled up with ``SLOTS``,
    and how many rows each text has."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    rows = -(-sizes // width)
    filled = np.full(int(rows.sum()) * width, SLOTS, dtype=np.int64)
    begin = np.cumsum(rows) - rows
    filled[np.arange(sizes.sum()) + np.repeat(begin * width - (np.cumsum(sizes) - sizes), sizes)] = np.concatenate(texts)
    return filled.reshape(-1, width), rows


def _filled(table: np.ndarray) -> np.ndarray:
    """``table`` with one more row, of zeros, for the slot that fills rows up."""
    return np.concatenate([table, np.zeros_like(table[:1])])


def _norms(slots: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Length of each row's vector of counts times weights; ``idf`` has the filling slot."""
    ranked = np.sort(slots.astype(np.uint16), axis=1).ravel()
    width, squares = slots.shape[1], idf.astype(np.float64) ** 2
    out = np.take(squares, slots).sum(axis=1)
    # A word that occurs c times makes c (c - 1) / 2 pairs, and c + c (c - 1) is the square of c.
    for step in range(1, width):
        at = np.flatnonzero(ranked[step:] == ranked[:-step])
        at = at[(at % width < width - step) & (ranked[at] < SLOTS)]
        if not len(at):
            break
        out += 2 * np.bincount(at // width, squares[ranked[at]], len(out))
    return np.sqrt(out)


def _add_products(total: np.ndarray, random: np.ndarray, texts: list[np.ndarray], idf: np.ndarray) -> int:
    """Adds ``A^T (A random)`` of the texts' passages to ``total``, a row for each random vector; how
    many passages they have. The words' weights are in ``random`` already and are still to be
    multiplied to ``total``; ``random`` and ``idf`` have the slot that fills passages up."""
    slots, _ = _in_rows(texts, PASSAGE)
    words = np.take(random, slots, axis=0, mode="clip")
    there = np.einsum("pwr->rp", words) / _norms(slots, idf) ** 2
    flat = slots.ravel()
    for column, products in zip(total, there, strict=True):
        column += np.bincount(flat, np.repeat(products, PASSAGE), SLOTS + 1)
    return len(slots)


def _multiplied(docs: DataFrame, idf: np.ndarray) -> tuple[np.ndarray, int]:
    """``A^T (A random)`` over the passages of all documents, and their number."""
    out = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("v", T.BinaryType())])
    width = PROBES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = _filled(idf)
        random = filled[:, None] * _filled(_random(width))
        total, n = np.zeros((width, SLOTS + 1)), 0
        waiting: list[np.ndarray] = []
        words = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for ids in word_slots(batch.column(0).slice(at, SLICE).to_pylist()):
                    # Whole passages at a time, so a long text needs no more memory than a short one.
                    for low in range(0, len(ids), FIT_WORDS):
                        waiting.append(ids[low : low + FIT_WORDS])
                        words += -(-len(waiting[-1]) // PASSAGE) * PASSAGE
                        if words >= FIT_WORDS:
                            n += _add_products(total, random, waiting, filled)
                            waiting, words = [], 0
        if waiting:
            n += _add_products(total, random, waiting, filled)
        total = (total[:, :SLOTS] * idf).T.astype(np.float32)
        used = np.flatnonzero(total.any(axis=1))
        rows = [total[i].tobytes() for i in used] + [np.full(width, n, dtype=np.float32).tobytes()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int32)), pa.array(rows, pa.binary())],
            schema=to_arrow_schema(out),
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(v, dtype=np.float32)
                total[slot] = total[slot] + part if slot in total else part
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(total), pa.int32()),
                pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary()),
            ],
            schema=to_arrow_schema(out),
        )

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")
    # At most SLOTS rows a task, added up by slot before the driver gets SLOTS rows.
    parts = small_batches(docs).select(text).mapInArrow(lean(run), out).repartition("slot").mapInArrow(lean(added), out)
    total, n = np.zeros((SLOTS, width), dtype=np.float32), 0
    for r in parts.collect():
        v = np.frombuffer(bytes(r["v"]), dtype=np.float32)
        if r["slot"] < 0:
            n = int(v[0])
        else:
            total[r["slot"]] = v
    return total, n


def document_factor(docs: DataFrame, idf: np.ndarray) -> np.ndarray:
    """F (SLOTS x PROBES at most) so that ``F F^T`` is nearly the mean of the outer products of all
    passages of all documents."""
    total, n = _multiplied(docs, idf)
    small = _random(PROBES).T.astype(np.float64) @ total
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    kept = values > 1e-5 * max(values.max(), 1e-30)
    trim_memory()
    return (total @ (vectors[:, kept] / np.sqrt(values[kept] * max(n, 1)))).astype(np.float32)


def latent_space(factor: np.ndarray, items: list[Item], idf: np.ndarray) -> np.ndarray:
    """An orthonormal basis (SLOTS x RANK) of the leading right singular vectors."""
    own = [row for ids in _item_slots(items) for row in _rows(ids, idf)]
    weight = EMPHASIS / max(1, len(own))

    def product(right: np.ndarray) -> np.ndarray:
        total = factor @ (factor.T @ right)
        for slots, w in own:
            total[slots] += weight * w[:, None] * (w @ right[slots])
        return total

    basis = _random(RANK + MORE)
    for _ in range(2):
        basis = np.linalg.qr(product(basis))[0].astype(np.float32)
    # Within the basis the squared singular values and their directions are those of a small matrix.
    small = basis.T.astype(np.float64) @ product(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    trim_memory()
    return (basis @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)


# ---- search

_FLAGS = 20


def _codes(slots: np.ndarray, size: int) -> np.ndarray:
    """A number for each ``size`` words in a row; equal numbers are equal slots."""
    n = max(0, len(slots) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out = (out << np.uint64(SLOTS.bit_length() - 1)) | slots[i : i + n].astype(np.uint64)
    return out


def _flag(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(_BASE)) >> np.uint64(64 - _FLAGS)).astype(np.int64)


class Grams:
    """Which items hold words in a row of a text; flags spare most words the search."""

    def __init__(self, item_slots: list[np.ndarray]):
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, slots in enumerate(item_slots):
            size = min(len(slots), GRAM)
            parts.setdefault(size, []).append((np.unique(_codes(slots, size)), i))
        self.tables = []
        for size, found in parts.items():
            codes = np.concatenate([c for c, _ in found])
            owners = np.repeat([i for _, i in found], [len(c) for c, _ in found])
            order = np.argsort(codes, kind="stable")
            flags = np.zeros(1 << _FLAGS, dtype=bool)
            flags[_flag(codes)] = True
            self.tables.append((size, codes[order], owners[order], flags))

    def met(self, slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Places of words in a row, for each an item that has them, and how many words."""
        for size, codes, owners, flags in self.tables:
            here = _codes(slots, size)
            places = np.flatnonzero(flags[_flag(here)])
            low, high = (np.searchsorted(codes, here[places], side) for side in ("left", "right"))
            for step in range(int((high - low).max(initial=0))):
                more = low + step < high
                yield places[more], owners[low[more] + step], size


class Rare:
    """Bounds the subsequence of an item and a passage's surroundings by the item's rarer words.

    An item of n words needs ``COVERED`` of them. Without its most frequent ones, so many of the rest
    are still needed; fewer near a passage rule the pair out, so no pair that would be confirmed is
    lost.
    """

    def __init__(self, item_slots: list[np.ndarray], idf: np.ndarray):
        holders: list[tuple[np.ndarray, int]] = []
        least, reach = [], []
        for i, slots in enumerate(item_slots):
            n, need = len(slots), int(np.ceil(COVERED * len(slots)))
            ranked = np.sort(idf[slots])[::-1]
            chosen = slots[idf[slots] >= ranked[min(n, n - need + max(1, int(RARE * n))) - 1]]
            least.append(need - (n - len(chosen)))
            reach.append(-(-n // STEP))
            holders.append((np.unique(chosen), i))
        found = np.concatenate([s for s, _ in holders])
        owners = np.repeat([i for _, i in holders], [len(s) for s, _ in holders])
        order = np.argsort(found, kind="stable")
        self.owners = owners[order]
        self.first = np.searchsorted(found[order], np.arange(SLOTS + 2))
        self.least, self.reach = np.array(least), np.array(reach)

    def halves(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The half passage of each word that a listed item holds, and the item."""
        n = self.first[slots + 1] - self.first[slots]
        here = np.flatnonzero(n)
        n = n[here]
        at = np.repeat(self.first[slots[here]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(here // STEP, n), self.owners[at]

    def near(
        self, half: np.ndarray, item: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Passages, by the half they begin at, and items, each once, that may have enough words among
        those at ``half``; ``text`` is each half's text, ``first`` and ``last`` are its passages."""
        # Words of two items are further apart than any item reaches.
        size = len(text) + 2 * int(self.reach.max()) + 2
        codes = np.sort(item * size + half)
        item, half = np.divmod(codes, size)
        least = self.least[item]
        end = np.minimum(np.arange(len(codes)) + least - 1, len(codes) - 1)
        found = np.flatnonzero(
            (np.arange(len(codes)) + least <= len(codes))
            & (codes[end] - codes < 2 + 2 * self.reach[item])
            & (text[half[end]] == text[half])
        )
        item, begin, end = item[found], half[end[found]] - 1, half[found]
        owner = text[end]
        begin = np.maximum(begin - self.reach[item], first[owner])
        end = np.minimum(end + self.reach[item], last[owner])
        # Neither end falls within an item and text, so a stretch goes on where the one before it ends.
        same = (item[1:] == item[:-1]) & (owner[1:] == owner[:-1])
        begin[1:] = np.where(same, np.maximum(begin[1:], end[:-1] + 1), begin[1:])
        n = np.maximum(end + 1 - begin, 0)
        passage = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        codes = np.sort(passage * len(self.least) + np.repeat(item, n))
        return codes // len(self.least), codes % len(self.least)

    def possible(
        self, words: list[tuple[np.ndarray, np.ndarray]], half: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray
    ) -> np.ndarray:
        """Whether enough of the item's words stand around the passage that begins at ``half``;
        ``low`` and ``high`` are the ends of its text, all counted over the texts of ``words``."""
        size = int(high.max(initial=0)) + 1
        codes = np.sort(np.concatenate([i * size + h for h, i in words] or [np.zeros(0, np.int64)]))
        begin = np.maximum(half - self.reach[item], low)
        end = np.minimum(half + 2 + self.reach[item], high)
        near = np.searchsorted(codes, item * size + end) - np.searchsorted(codes, item * size + begin)
        return near >= self.least[item]


def _blocks(benchmark: DataFrame) -> Iterator[list[Item]]:
    """The benchmark's items, ``BLOCK`` at a time."""
    block: list[Item] = []
    wanted = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    for r in wanted.toLocalIterator():
        item = read_item(r["item_id"], r["text"])
        if item.words:
            block.append(item)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def _searched(docs: DataFrame, items: list[Item], idf: np.ndarray, space: np.ndarray) -> DataFrame:
    """(doc_id, item_id, cosine, covered, first_word, last_word) of confirmed candidates."""
    out = T.StructType(
        [
            long("doc_id"),
            long("item_id"),
            double("cosine"),
            double("covered"),
            long("first_word"),
            long("last_word"),
        ]
    )
    weighted = idf[:, None] * space
    item_slots = _item_slots(items)
    targets = np.array([weighted[ids].sum(0) for ids in item_slots], dtype=np.float32)
    targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-9)
    table = weighted.astype(np.float16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projected = _filled(table.astype(np.float32))
        wanted = [ids.tolist() for ids in item_slots]
        grams, rare = Grams(item_slots), Rare(item_slots, idf)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                ids = batch.column(0).slice(at, SLICE).to_pylist()
                texts = batch.column(1).slice(at, SLICE).to_pylist()
                hits = _hits(ids, texts, projected, targets, items, wanted, grams, rare)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[i] for h in hits], f.type) for i, f in enumerate(to_arrow_schema(out))],
                    schema=to_arrow_schema(out),
                )

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t")
    return small_batches(docs).select(F.col("doc_id").cast("long"), text).mapInArrow(lean(run), out)


def _candidates(slots_of, projected, targets, grams, rare) -> tuple[np.ndarray, ...]:
    """(text, first word of the passage, item, cosine) of what is to be looked at, by passage and item."""
    rows, halves = _in_rows(slots_of, STEP)
    slots, text = rows.ravel(), np.repeat(np.arange(len(slots_of)), halves)
    high = np.cumsum(halves)
    low = high - halves
    # The last half of a text begins a passage only if it is the only one.
    last = np.maximum(high - 2, low)
    half, numbers = rare.halves(slots)
    passage, item = rare.near(half, numbers, text, low, last)
    owner = text[passage]
    kept = rare.possible([(half, numbers)], passage, low[owner], high[owner], item)
    passage, item = passage[kept], item[kept]

    # Only the passages that are left are projected; each is two halves, of which the second may be missing.
    used, back = np.unique(passage, return_inverse=True)
    second = np.minimum(used + 1, len(rows) - 1)
    there = (used + 1 < high[text[used]])[:, None]
    places = np.concatenate([rows[used], np.where(there, rows[second], SLOTS)], axis=1)
    sums = np.empty((len(used), projected.shape[1]), dtype=np.float32)
    for at in range(0, len(used), 1024):
        sums[at : at + 1024] = np.einsum("pwr->pr", np.take(projected, places[at : at + 1024], axis=0, mode="clip"))
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    cosine = np.einsum("pr,pr->p", sums[back], targets[item])

    shared = [np.zeros(0, np.int64)]
    for at, numbers, size in grams.met(slots):
        end = at + size - 1
        at, numbers = (v[(text[at // STEP] == text[end // STEP]) & (slots[end] < SLOTS)] for v in (at, numbers))
        shared.append(np.minimum(at // STEP, last[text[at // STEP]]) * len(targets) + numbers)
    kept = (cosine >= COSINE) | np.isin(passage * len(targets) + item, np.concatenate(shared))
    passage, item, cosine = passage[kept], item[kept], cosine[kept]
    owner = text[passage]
    return owner, (passage - low[owner]) * STEP, item, cosine


def _hits(ids, texts, projected, targets, items, item_slots, grams, rare) -> list[tuple]:
    slots_of = word_slots(texts)
    if not sum(map(len, slots_of)):
        return []
    best: dict[tuple[int, int], tuple[float, float, int, int]] = {}
    reach = max(len(i.words) for i in items)
    need = [COVERED * len(i.words) for i in items]
    seen_at, nearby = None, set().__contains__
    listed: dict[int, list[bytes]] = {}
    found_at = _candidates(slots_of, projected, targets, grams, rare)
    for k, start, i, cosine in zip(*(v.tolist() for v in found_at), strict=True):
        known = best.get((k, i))
        if known and known[1] == 1.0:
            continue
        if (k, start) != seen_at:
            seen_at = k, start
            nearby = set(slots_of[k][max(0, start - reach) : start + PASSAGE + reach].tolist()).__contains__
        # The item's words that occur near the passage bound the subsequence from above.
        if sum(map(nearby, item_slots[i])) < need[i]:
            continue
        if k not in listed:
            listed[k] = plain_words(texts[k])
        found = confirmed(items[i], listed[k], start)
        if found and (known is None or found[0] > known[1]):
            best[k, i] = (cosine, *found)
    return [(ids[k], items[i].number, *v) for (k, i), v in best.items()]


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, cosine, covered, first_word, last_word): documents that hold an item."""
    frequency, texts = _document_frequencies(docs)
    idf = _weights(frequency, texts)
    factor: np.ndarray | None = None
    out: DataFrame | None = None
    for items in _blocks(benchmark):
        factor = document_factor(docs, idf) if factor is None else factor
        found = _searched(docs, items, idf, latent_space(factor, items, idf))
        out = found if out is None else out.unionByName(found)
    if out is None:
        shape = "doc_id long, item_id long, cosine double, covered double, first_word long, last_word long"
        return docs.sparkSession.createDataFrame([], shape)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    leaks = cut_lineage(matches(docs, benchmark).where("doc_id is not null").select("doc_id").distinct())
    few = leaks.count() <= SENT_ROWS
    return docs.join(F.broadcast(leaks) if few else leaks, "doc_id", "left_anti")
