"""Alignment of two tokenizers' ids over the same texts, and how often two ids meet in a corpus.

Tokenizer A is a byte-level model, B a SentencePiece model. Both read a text behind one blank; the
bytes of their tokens are compared place by place.

1. Full tokenisation. Texts are cut at blanks that neither tokenizer's tokens can cross (a single
   blank between a visible character and another character), and the ids of each distinct piece of
   text are remembered, so the ids of a text are the ids of its pieces in order.
2. Anchors. Tokens of both sides end before such a blank and the next tokens of both are marked with
   it, so these blanks are anchors: they cut the two id sequences into windows, one a piece.
3. Windows are aligned once, all new ones of some texts together. Inside a window every shared end
   closes a group, and each stretch between neighbouring ends of either side is one link, the pair of
   the two tokens that cover it.
4. Counts. Tasks count their windows, so a link is counted once a window and task, and the counts of
   id pairs are summed over the corpus. Every text's links are stored (packed) next to its sizes. The
   ``LISTED`` most frequent pairs are sent to the tasks; links of all other pairs are joined.

Null and empty texts, and texts whose tokens do not spell them (the mark character itself, say), have
no tokens: zeros and an empty digest. Repeated rows and ids are counted and returned each; an empty
table gives an empty table; extra columns are ignored, columns that are kept may have any name but
those of the results. Very long texts are read whole; what a task remembers is bounded by
``REMEMBERED`` windows and ``REMEMBERED_LINKS`` links plus those of ``SLICE`` texts.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from zstandard import ZstdCompressor, ZstdDecompressor

from cohortlens.llm.common import SLICE, lean, long, small_batches, string
from cohortlens.session import cut_lineage, shared_folder

#: Windows and links that a worker remembers before it starts anew.
REMEMBERED = 300_000
REMEMBERED_LINKS = 3_000_000
#: Longest piece of text whose windows are remembered under the text.
LONGEST = 64
#: Most frequent id pairs whose counts every task gets (20 bytes each); all others are joined.
LISTED = 1_000_000
#: Pieces that are given to the tokenizers in one text.
TOGETHER = 500
#: Bytes of a link where links are stored.
PACKED = 6
#: Number of a piece of text that its tokens do not spell.
UNSPELLED = -1

#: White space before a blank: a blank there may belong to the token that begins before it.
_CROSSED = re.compile("[\\s\\u180e\\u200b] ")
_WHITES = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) | {"\u180e", "\u200b"}
#: Texts that are not simply cut at every blank, as Arrow's expressions say it.
_ODD = r"\A\z|\A | \z|▁|[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(_WHITES)) + "] "


class Tokenizers:
    """Both models, and the bytes of each id."""

    def __init__(self, byte_level: str, piece_model: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_model)
        signs = _byte_signs()
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [
            bytes(signs.get(c, 63) for c in names.get(i, "")) for i in range(max(names) + 1)
        ]
        self.b_bytes, pieces = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            pieces.append(piece)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                self.b_bytes.append(b"")
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode())
        self.a_stored, self.b_stored = (
            pa.array(side, pa.large_binary()) for side in (self.a_bytes, self.b_bytes)
        )
        #: Whether no piece holds a mark behind another character, so that blanks cut B's tokens.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def pieces_of(self, text: str) -> list[str]:
        """Parts of a text, each without the blank before it, that are tokenised on their own."""
        if not self.cuts or "▁" in text:
            return [text]
        parts = text.split(" ")
        if parts[0] and parts[-1] and not _CROSSED.search(text):
            return parts
        out = [parts[0]]
        for part in parts[1:]:
            if part and out[-1] and out[-1][-1] not in _WHITES:
                out.append(part)
            else:
                out[-1] += " " + part
        return out

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts one after another, and how many each text has."""
        odd = np.ones(len(texts), bool)
        if self.cuts:
            odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        if odd.any():
            others = [self.pieces_of(t) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
            places = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]))
            lists = pa.concat_arrays([lists, pa.array(others, lists.type)]).take(pa.array(places))
        return lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)

    def ids(self, pieces: Sequence[str]) -> tuple[list[int], list[int]]:
        """Ids of both sides of all pieces, one after another.

        Pieces that a common text of theirs is cut into again are given to the tokenizers in that text.
        """
        texts = []
        for start in range(0, len(pieces), TOGETHER):
            some = list(pieces[start : start + TOGETHER])
            text = " ".join(some)
            texts += [text] if self.pieces_of(text) == some else some
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        b = self.b.encode(texts, num_threads=1)
        return [i for e in a for i in e.ids], [i for ids in b for i in ids]


def _byte_signs() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for
    themselves, the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return signs | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Aligned:
    """Windows one after another: counts per window, and the links and written groups of all.

    ``sizes`` has tokens of A, tokens of B, groups and links of each window. ``links`` holds a pair of
    ids (three bytes each) for each two tokens whose bytes overlap, ``written`` each window's groups as
    ``a1,a2|b1;a3|b2;``, which end at ``written_ends``.
    """

    sizes: np.ndarray
    links: np.ndarray
    written: np.ndarray
    written_ends: np.ndarray


@dataclass(frozen=True)
class Side:
    """Ids of one tokenizer's tokens one after another, where the bytes of each end, and the bytes."""

    ids: np.ndarray
    ends: np.ndarray
    spelled: memoryview

    @classmethod
    def of(cls, ids: Sequence[int], stored: pa.Array) -> Side:
        ids = np.array(ids, np.int64)
        ends, spelled = _entries(stored, ids)
        return cls(ids, ends[1:], spelled)


def align_windows(a: Side, b: Side, window_ends: np.ndarray) -> Aligned:
    """Windows of bytes up to these ends, where tokens of both sides end; both sides spell the same."""
    of_a, of_b = np.zeros((2, len(a.spelled) + 1), bool)
    of_a[a.ends] = of_b[b.ends] = True
    shared, either = of_a & of_b, of_a | of_b
    # how many end up to a byte offset; the next token's place is the number of those that end before
    a_upto, b_upto, groups, links = (np.cumsum(x, dtype=np.int32) for x in (of_a, of_b, shared, either))
    at = np.flatnonzero(either)
    pairs = np.stack([a.ids[a_upto[at] - of_a[at]], b.ids[b_upto[at] - of_b[at]]], axis=1)
    # a token of A stands behind the tokens of B of earlier groups, one of B behind A's of its own
    stops = np.flatnonzero(shared)
    a_place = np.arange(len(a.ids)) + np.append(0, b_upto[stops])[groups[a.ends] - shared[a.ends]]
    b_place = np.arange(len(b.ids)) + a_upto[stops][groups[b.ends] - shared[b.ends]]
    ids, signs = np.empty(len(a.ids) + len(b.ids), np.int64), np.empty(len(a.ids) + len(b.ids), np.uint8)
    ids[a_place], signs[a_place] = a.ids, np.where(shared[a.ends], ord("|"), ord(","))
    ids[b_place], signs[b_place] = b.ids, np.where(shared[b.ends], ord(";"), ord(","))
    digits, widths = _numerals()
    rows, widths = digits[ids], widths[ids]
    rows[np.arange(len(ids)), widths] = signs
    written = rows[np.arange(rows.shape[1]) <= widths[:, None]]
    tokens = a_upto[window_ends] + b_upto[window_ends]
    upto = np.stack([x[window_ends] for x in (a_upto, b_upto, groups, links)], axis=1)
    sizes = np.diff(upto, axis=0, prepend=np.zeros((1, 4), upto.dtype))
    return Aligned(sizes, _narrow(pairs), written, np.cumsum(widths + 1)[tokens - 1])


@functools.cache
def _numerals() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of ids below 2 ** 17 with room for a sign behind them, and how many there are."""
    made = [str(i).encode() for i in range(1 << 17)]
    digits = np.array(made, "S7").view(np.uint8).reshape(-1, 7)
    return digits, np.array([len(d) for d in made])


def _entries(stored: pa.Array, numbers: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """Bytes of so many entries one after another, and where they start and the last one ends."""
    _, ends, data = stored.take(pa.array(numbers)).buffers()
    ends = np.frombuffer(ends, np.int64)[: len(numbers) + 1] if len(numbers) else np.zeros(1, np.int64)
    return ends, memoryview(data or b"").cast("B")[: ends[-1]]


class Windows:
    """Aligned windows by number, and the numbers of pieces of text."""

    def __init__(self, models: Tokenizers):
        self.models = models
        self.clear()

    def clear(self) -> None:
        self.by_piece: dict[str, int] = {}
        self.sizes = array("q")
        self.written, self.written_ends = bytearray(), array("q", [0])
        self.links, self.link_ends = bytearray(), array("q", [0])
        self.counts = np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.link_ends) - 1

    def full(self) -> bool:
        return max(len(self), len(self.by_piece)) > REMEMBERED or len(self.links) > PACKED * REMEMBERED_LINKS

    def of_texts(self, texts: Sequence[str]) -> list[list[int]]:
        """Numbers of each text's pieces in order; none for a text that tokens do not spell."""
        flat, stops = self.numbers(pa.array(texts, pa.string()))
        return [flat[i:j].tolist() for i, j in zip([0, *stops], stops, strict=False)]

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same numbers of all texts one after another, and where each text's end."""
        pieces, counts = self.models.cut(texts)
        coded = pieces.dictionary_encode()
        flat = self._of_pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        unspelled = _between((flat == UNSPELLED)[:, None].astype(np.int64), np.cumsum(counts))[:, 0] > 0
        if unspelled.any():
            flat = flat[~np.repeat(unspelled, counts)]
            counts[unspelled] = 0
        return flat, np.cumsum(counts)

    def _of_pieces(self, pieces: Sequence[str]) -> np.ndarray:
        """Numbers of different pieces of text."""
        found = list(map(self.by_piece.get, pieces))
        fresh = [p for p, n in zip(pieces, found, strict=True) if n is None]
        if fresh:
            self._add(fresh)
            known = self.by_piece
            found = [known[p] if n is None else n for p, n in zip(pieces, found, strict=True)]
            for piece in fresh:
                if len(piece) > LONGEST:
                    del known[piece]
        return np.array(found, np.int64)

    def _add(self, fresh: Sequence[str]) -> None:
        """Tokenises and aligns pieces of text, all of them at once."""
        alone = [p for p in fresh if p[-1] in _WHITES or " " in p or "▁" in p]
        if alone:
            self._add_alike(alone)
            fresh = [p for p in fresh if p not in self.by_piece]
        if fresh:
            self._add_alike(fresh)

    def _add_alike(self, fresh: Sequence[str]) -> None:
        m = self.models
        a_ids, b_ids = m.ids(fresh)
        a, b = Side.of(a_ids, m.a_stored), Side.of(b_ids, m.b_stored)
        spelled = (" " + " ".join(fresh)).encode("utf-8", "replace")
        if not spelled == a.spelled == b.spelled:
            if len(fresh) == 1:
                self.by_piece[fresh[0]] = UNSPELLED
            else:  # look for the pieces that tokens do not spell
                half = len(fresh) // 2
                self._add_alike(fresh[:half])
                self._add_alike(fresh[half:])
            return
        lengths = np.array([len(p.encode("utf-8", "replace")) + 1 for p in fresh])
        made = align_windows(a, b, np.cumsum(lengths))
        self.by_piece.update(zip(fresh, range(len(self), len(self) + len(fresh)), strict=True))
        self.sizes.frombytes(made.sizes.astype(np.int64).tobytes())
        ends = len(self.links) + PACKED * np.cumsum(made.sizes[:, 3], dtype=np.int64)
        self.link_ends.frombytes(ends.tobytes())
        self.written_ends.frombytes((len(self.written) + made.written_ends).astype(np.int64).tobytes())
        self.links += made.links.tobytes()
        self.written += made.written.tobytes()

    def sizes_of(self, flat: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.sizes, np.int64).reshape(-1, 4)[flat]

    def links_of(self, flat: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """Packed links of windows one after another, and where they start and the last one ends."""
        return _entries(_stored(self.links, self.link_ends), flat)

    def written_of(self, flat: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """Written groups of windows one after another, and where they start and the last one ends."""
        return _entries(_stored(self.written, self.written_ends), flat)

    def count(self, flat: np.ndarray) -> None:
        """Adds occurrences of windows to the counts."""
        counts = np.bincount(flat, minlength=len(self))
        counts[: len(self.counts)] += self.counts
        self.counts = counts

    def counted_links(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct id pairs and how many links of the counted windows hold them; counts restart."""
        counts, self.counts = self.counts, np.zeros(0, np.int64)
        weights = np.repeat(counts, np.diff(self.link_ends)[: len(counts)] // PACKED)
        codes = _widened(self.links)[: len(weights)]
        return summed(codes[weights > 0], weights[weights > 0])


def _stored(data: bytearray, ends: array) -> pa.Array:
    """Entries of bytes as Arrow sees them, nothing copied; let go of them before ``data`` grows."""
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(data)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, buffers)


def summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of the weights of each."""
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1)) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(weights, first) if len(first) else first


@dataclass(frozen=True)
class Listed:
    """Counts of id pairs, sorted by pair, and whether a pair's count is the highest of its B id."""

    pairs: np.ndarray
    counts: np.ndarray
    best: np.ndarray

    def look_up(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.pairs):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        hit = self.pairs[at] == codes
        return np.where(hit, self.counts[at], 0), hit & self.best[at]


_WINDOWS: dict[tuple[str, str], Windows] = {}


def _windows(names: tuple[str, str]) -> Windows:
    """The windows this worker remembers; counts belong to one task."""
    if names not in _WINDOWS:
        _WINDOWS[names] = Windows(Tokenizers(*map(SparkFiles.get, names)))
    _WINDOWS[names].counts = np.zeros(0, np.int64)
    return _WINDOWS[names]


def _shipped(df: DataFrame, paths: Sequence[str]) -> tuple[str, str]:
    for p in paths:
        df.sparkSession.sparkContext.addFile(p)
    return tuple(p.rsplit("/", 1)[-1] for p in paths)


def _texts(docs: DataFrame, *keep: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).alias("__text")
    return small_batches(docs).select(*keep, text)


def _read(
    df: DataFrame,
    schema: T.StructType,
    names: tuple[str, str],
    work: Callable[[Windows, pa.RecordBatch, np.ndarray, np.ndarray], list],
    last: Callable[[Windows], list] | None = None,
) -> DataFrame:
    """Rows that ``work`` makes of some texts at a time, and ``last`` before windows are forgotten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        windows = _windows(names)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                flat, stops = windows.numbers(part.column(part.num_columns - 1))
                yield _batch(types, work(windows, part, flat, stops))
                if windows.full():
                    if last:
                        yield _batch(types, last(windows))
                    windows.clear()
        if last:
            yield _batch(types, last(windows))

    return df.mapInArrow(lean(run), schema)


def _batch(types: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [
        c.cast(k) if isinstance(c, pa.Array) else pa.array(c, type=k)
        for c, k in zip(columns, types.types, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=types)


def groups(
    docs: DataFrame, byte_level: str, piece_model: str, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``groups`` of every text: ids of A and ids of B between neighbouring shared ends."""
    ids = T.ArrayType(T.IntegerType())
    group = T.StructType([T.StructField("a", ids), T.StructField("b", ids)])
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("groups", T.ArrayType(group))])

    def spell(windows: Windows, part: pa.RecordBatch, flat: np.ndarray, stops: np.ndarray) -> list:
        ends, written = windows.written_of(flat)
        texts = [str(written[i : max(i, j - 1)], "ascii") for i, j in _spans(ends[stops])]
        made = [
            [
                {"a": [int(i) for i in a.split(",")], "b": [int(i) for i in b.split(",")]}
                for a, b in (g.split("|") for g in text.split(";") if g)
            ]
            for text in texts
        ]
        return [*part.columns[: len(keep)], made]

    return _read(_texts(docs, *keep), schema, _shipped(docs, (byte_level, piece_model)), spell)


_SIZES = ("n_a", "n_b", "n_groups", "n_links")
_PAIR = [T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), long("n")]


def aligned(docs: DataFrame, byte_level: str, piece_model: str) -> tuple[DataFrame, DataFrame]:
    """Every document's sizes, digest of groups and packed links; and ``a``, ``b``, ``n``: how many
    links of all texts hold two ids.

    The texts are read once. Both tables are written to the shared folder.
    """
    fields = [docs.schema["doc_id"], *[long(c) for c in _SIZES], string("groups_sha256")]
    packed = T.StructField("_links", T.BinaryType())
    schema = T.StructType([*fields, packed, *_PAIR])

    def read(windows: Windows, part: pa.RecordBatch, flat: np.ndarray, stops: np.ndarray) -> list:
        windows.count(flat)
        sums = _between(windows.sizes_of(flat), stops)
        ends, written = windows.written_of(flat)
        hashes = [sha256(written[i : j - 1]).hexdigest() if j > i else "" for i, j in _spans(ends[stops])]
        ends, links = windows.links_of(flat)
        pack = ZstdCompressor(level=1).compress
        blobs = [pack(links[i:j]) if j > i else b"" for i, j in _spans(ends[stops])]
        none = pa.nulls(len(stops))
        return [part.column(0), *sums.T, hashes, blobs, none, none, none]

    def emit(windows: Windows) -> list:
        pairs, n = windows.counted_links()
        return [*[pa.nulls(len(n))] * (len(fields) + 1), pairs >> 32, pairs & 0xFFFFFFFF, n]

    made = _read(_texts(docs, "doc_id"), schema, _shipped(docs, (byte_level, piece_model)), read, emit)
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/alignment/{uuid.uuid4().hex}"
    made.write.parquet(folder)
    rows = spark.read.schema(schema).parquet(folder)
    counts = rows.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return rows.filter("a IS NULL").drop("a", "b", "n"), cut_lineage(counts)


def _between(table: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Sums of a table's rows from each stop to the next."""
    upto = np.concatenate([np.zeros((1, table.shape[1]), np.int64), np.cumsum(table, axis=0)])
    return np.diff(upto[stops], axis=0, prepend=upto[:1])


def _spans(stops: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each stretch up to a stop."""
    ends = stops.tolist()
    return list(zip([0, *ends], ends, strict=False))


def _narrow(pairs: np.ndarray) -> np.ndarray:
    """Pairs of ids, A's before B's, each in three bytes."""
    return pairs.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]


def _widened(data: bytes | bytearray) -> np.ndarray:
    wide = np.zeros((len(data) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    pairs = wide.reshape(-1).view("<u4").astype(np.int64).reshape(-1, 2)
    return pairs[:, 0] << 32 | pairs[:, 1]


def digests(
    docs: DataFrame, byte_level: str, piece_model: str, *, listed: int = LISTED
) -> DataFrame:
    """Per document: tokens, groups, links, how its links rank in the corpus, and a hash of groups.

    ``listed`` pairs at most travel to the tasks; which ones they are decides only how counts reach a
    document.
    """
    rows, counts = aligned(docs, byte_level, piece_model)
    highest = counts.groupBy("b").agg(F.max("n").alias("_highest"))  # one row an id of B
    ranked = counts.join(F.broadcast(highest), "b").select(
        "a", "b", "n", (F.col("n") == F.col("_highest")).alias("best")
    )
    top = ranked.orderBy(F.col("n").desc(), "a", "b").limit(listed).toPandas()  # ``listed`` rows at most
    codes = top["a"].to_numpy(np.int64) << 32 | top["b"].to_numpy(np.int64)
    by = np.argsort(codes)
    sent = docs.sparkSession.sparkContext.broadcast(
        (codes[by], top["n"].to_numpy(np.int64)[by], top["best"].to_numpy(bool)[by])
    )
    kept = [c for c in rows.columns if c != "_links"]
    fields = [rows.schema[c] for c in kept]
    rest = T.StructField("_rest", T.ArrayType(T.StructType(_PAIR)))
    schema = T.StructType([*fields, long("n_best"), long("count_sum"), rest])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, table = to_arrow_schema(schema), Listed(*sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield _batch(types, [*part.columns[:-1], *_ranked(part.column(len(kept)), table)])

    judged = small_batches(rows).select(*kept, "_links").mapInArrow(lean(judge), schema)
    order = ["doc_id", *_SIZES, "n_best", "count_sum", "groups_sha256"]
    if len(top) < listed:
        return judged.select(*order)
    last = top.iloc[-1]
    n, a, b = int(last["n"]), int(last["a"]), int(last["b"])
    same_n = (F.col("n") == n) & ((F.col("a") > a) | ((F.col("a") == a) & (F.col("b") > b)))
    later = ranked.filter((F.col("n") < n) | same_n)
    numbered = cut_lineage(judged.withColumn("_row", F.monotonically_increasing_id()))
    return _with_rest(numbered, later).select(*order)


def _ranked(packed: pa.Array, table: Listed) -> list:
    """Per document: links that are the best of their B id, summed counts, links not listed."""
    unpack = ZstdDecompressor().decompress
    links = [_widened(unpack(p) if p else b"") for p in packed.to_pylist()]
    stops = np.cumsum([len(x) for x in links])
    distinct, back = np.unique(np.concatenate([np.zeros(0, np.int64), *links]), return_inverse=True)
    counts, best = table.look_up(distinct)
    sums = _between(np.stack([best, counts, counts == 0], axis=1).astype(np.int64)[back], stops)
    rest = []
    for codes, n in zip(links, sums[:, 2], strict=True):
        found = np.unique(codes[table.look_up(codes)[0] == 0], return_counts=True) if n else ((), ())
        rest.append(
            [{"a": int(c) >> 32, "b": int(c) & 0xFFFFFFFF, "n": int(k)} for c, k in zip(*found, strict=True)]
        )
    return [sums[:, 0], sums[:, 1], rest]


def _with_rest(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds what the pairs that were not listed contribute; each is rarer than any listed one."""
    open_links = rows.select("_row", F.explode("_rest").alias("_l"))
    met = open_links.select("_row", "_l.a", "_l.b", F.col("_l.n").alias("_times")).join(counts, ["a", "b"])
    more = met.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("_best"),
        F.sum(F.col("_times") * F.col("n")).alias("_sum"),
    )
    plus = {
        "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
    }
    return rows.join(more, "_row", "left").withColumns(plus)
