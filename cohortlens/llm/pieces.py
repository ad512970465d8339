"""SentencePiece encoding and decoding with a given model file.

Blanks become marks, the text is cut into marked words (a run of marks and what follows it), and the
distinct words of a few hundred texts are sorted. Sorted words are the depth-first order of their
trie: a word shares the forward state of every prefix it has in common with the word before it, so
each edge of the trie is computed once. A forward state says for each prefix which piece its best
segmentation ends with; the ids are read off backwards.

The forward step depends on the kind of model. For ``unigram`` it is Viterbi's: the piece with the
largest sum of scores. For ``bpe`` it is the one piece that stands last in the merged prefix: a
sequence of pieces is what merging yields exactly if each neighbouring pair is left alone by merging
the pair's text, so the last piece is the one that the prefix before it ends compatibly with.
Characters without a piece become byte pieces (or ``<unk>`` in models without them).

Null and empty texts have no ids. Decoding undoes encoding up to the mark character itself, which a
text cannot be told from a blank. Repeated rows are encoded each; extra columns are ignored; null or
empty id lists decode to empty texts; ids outside the model raise an error.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortlens.llm.common import lean, small_batches

MARK = "▁"

#: Words whose ids, and pairs whose compatibility, a Python worker remembers (of words twice as many
#: at most, for the last full set of them is kept, too).
REMEMBERED = 200_000

_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def _words(text: str) -> list[str]:
    """Marked words of a text, each without its first mark."""
    if not text:
        return []
    if MARK not in text:
        words = text.split(" ")
        if "" not in words:
            return words
    return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]


class Pieces:
    """A vocabulary of scored pieces: id by piece, score by id, and the byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]], kind: str, special: set[int] = frozenset()):
        if kind not in ("bpe", "unigram"):
            raise ValueError("kind is bpe or unigram")
        self.kind = kind
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if i not in special}
        self.scores = [s for _, s in pieces]
        self.unknown = next((i for i, (p, _) in enumerate(pieces) if p == "<unk>"), 0)
        self.byte_ids = [self.ids.pop(f"<0x{b:02X}>", None) for b in range(256)]
        self.runs = {p: i for p, i in self.ids.items() if len(p) > 1 and not p.strip(MARK)}
        # A trie of the pieces read backwards; "" holds (length, id) of the pieces that end a text
        # which ends on the node's path, the longest first.
        self.backwards: dict = {"": ()}
        usable = [(p, i) for p, i in self.ids.items() if kind == "unigram" or p not in self.runs]
        for piece, i in sorted(usable, key=lambda x: len(x[0])):
            node = self.backwards
            for c in reversed(piece):
                node = node.setdefault(c, {"": None})
            node[""] = i
        todo = list(self.backwards.items())
        ways: list[tuple[dict, int, tuple]] = [(n, 1, ()) for c, n in todo if c]
        while ways:
            node, length, found = ways.pop()
            if node[""] is not None:
                found = ((length, node[""]), *found)
            node[""] = found
            ways += [(n, length + 1, found) for c, n in node.items() if c]
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.remembered: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.text_of = [p for p, _ in pieces]
        self.pairs: dict[int, bool] = {}
        self.run_ids = functools.lru_cache(4096)(self._run_ids)

        self.bytes_of = [p.replace(MARK, " ").encode() for p, _ in pieces]
        for b, i in enumerate(self.byte_ids):
            if i is not None:
                self.bytes_of[i] = bytes([b])
        for i in special:
            self.bytes_of[i] = b""

    @classmethod
    def load(cls, path: str, kind: str | None = None) -> Pieces:
        """From a model file; without ``kind`` it is bpe if all scores are whole numbers."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(n)]
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        kind = kind or ("bpe" if all(s == int(s) for _, s in pieces) else "unigram")
        return cls(pieces, kind, special)

    def spelled(self, character: str) -> list[int]:
        """Ids of a character that is no piece."""
        ids = [self.byte_ids[b] for b in character.encode()]
        return [self.unknown] if None in ids else ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of two neighbouring pieces gives just these two."""
        one, two = self.text_of[left], self.text_of[right]
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        fits = self.pairs[left << 32 | right] = self.merged(one + two) == [one, two]
        return fits

    def merged(self, word: str) -> list[str]:
        """Pieces after repeatedly merging the best pair, the leftmost among equals."""
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                joined = parts[i] + parts[i + 1]
                if joined in self.ids and joined not in self.runs:
                    score = self.scores[self.ids[joined]]
                    if best is None or score > best:
                        best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _run_ids(self, n: int) -> tuple[int, ...]:
        """Ids of ``n`` marks alone: pieces of marks score alike, so the leftmost pair merges."""
        parts, at = [1] * n, 0
        while at < len(parts) - 1:
            if MARK * (parts[at] + parts[at + 1]) in self.runs:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                at = max(0, at - 1)
            else:
                at += 1
        return tuple(self.ids[MARK * k] for k in parts)

    def _forward(self, word: str, done: int, starts: list[int], last: list, totals: list[float]) -> None:
        """Adds the forward states of all prefixes longer than ``done``: start and id of the last piece."""
        root, pairs, bpe = self.backwards, self.pairs, self.kind == "bpe"
        for end in range(done + 1, len(word) + 1):
            node, at = root, end
            while at:
                further = node.get(word[at - 1])
                if further is None:
                    break
                node, at = further, at - 1
            found = node[""]
            # A character that is no piece is one by itself.
            start, i = end - 1, found[-1][1] if found and found[-1][0] == 1 else None
            if bpe:
                # Exactly one candidate fits, so the shortest one needs no test when all others fail.
                for length, piece in found:
                    if length == 1:
                        break
                    before = last[end - length]
                    if before is not None:
                        fits = pairs.get(before << 32 | piece)
                        if fits is None:
                            fits = self.compatible(before, piece)
                        if not fits:
                            continue
                    # Nothing stands before, or a character that never merges.
                    start, i = end - length, piece
                    break
            else:
                best = totals[start] + (self.least if i is None else self.scores[i])
                for length, piece in found:
                    total = totals[end - length] + self.scores[piece]
                    if total > best:
                        best, start, i = total, end - length, piece
                totals.append(best)
            starts.append(start)
            last.append(i)

    def encode_words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of marked words, these and others. A word is given without its first mark."""
        if len(self.remembered) > REMEMBERED:
            self.older, self.remembered = self.remembered, {}
        known, older = self.remembered, self.older
        fresh: list[str] = []
        runs: list[str] = []
        for word in words:
            if word not in known:
                if word in older:
                    known[word] = older[word]
                elif word.startswith(MARK) and self.kind == "bpe":
                    # Only the last mark of a run can be part of a longer piece.
                    runs.append(word)
                    core = word.lstrip(MARK)
                    if core not in known:
                        fresh.append(core)
                else:
                    fresh.append(word)
        starts, last, totals, before = [0], [None], [0.0], ""
        for key in sorted(fresh):
            word = MARK + key
            shared = 5 if word[:5] == before[:5] and len(before) > 5 else 0
            for a, b in zip(before[shared:], word[shared:], strict=False):
                if a != b:
                    break
                shared += 1
            del starts[shared + 1 :], last[shared + 1 :], totals[shared + 1 :]
            self._forward(word, shared, starts, last, totals)
            before = word
            ids, at = [], len(word)
            while at:
                i = last[at]
                if i is None:
                    ids += self.spelled(word[at - 1])[::-1]
                else:
                    ids.append(i)
                at = starts[at]
            ids.reverse()
            known[key] = tuple(ids)
        for word in runs:
            rest = word.lstrip(MARK)
            ids = known[rest]
            # A mark that joined no piece belongs to the run before it.
            alone = ids[0] == self.ids.get(MARK)
            known[word] = (*self.run_ids(len(word) - len(rest) + alone), *ids[alone:])
        return known

    def encode(self, texts: list[str]) -> tuple[array, np.ndarray]:
        """Ids of all texts in one row, and where each text's ids end."""
        split = [_words(t) for t in texts]
        found = self.encode_words(set().union(*split)).__getitem__
        flat, ends = array("i"), np.zeros(len(texts) + 1, dtype=np.int32)
        for i, words in enumerate(split):
            flat.extend(chain.from_iterable(map(found, words)))
            ends[i + 1] = len(flat)
        return flat, ends

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        if ids and (min(ids) < 0 or max(ids) >= len(table)):
            raise ValueError("an id is outside the model")
        joined = b"".join(map(table.__getitem__, ids))
        return joined.removeprefix(b" ").decode("utf-8", "replace")


_LOADED: dict[tuple[str, str | None], Pieces] = {}


def _model(name: str, kind: str | None) -> Pieces:
    if (name, kind) not in _LOADED:
        _LOADED[name, kind] = Pieces.load(SparkFiles.get(name), kind)
    return _LOADED[name, kind]


def _shipped(df: DataFrame, path: str) -> str:
    """Sends the model file to all executors; its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(
    docs: DataFrame, path: str, kind: str | None = None, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``ids``, ``n_tokens`` and ``round_trip`` (decoding gives the text back) of every text."""
    name = _shipped(docs, path)
    out = T.StructType(
        [
            *[docs.schema[c] for c in keep],
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        pieces = _model(name, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(n).to_pylist()
                flat, ends = pieces.encode(texts)
                same = [
                    pieces.decode(flat[ends[i] : ends[i + 1]]) == t.replace(MARK, " ")
                    for i, t in enumerate(texts)
                ]
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, dtype=np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i).cast(schema.types[i]) for i in range(n)],
                        ids.cast(schema.types[n]),
                        pa.array(np.diff(ends).astype(np.int64)),
                        pa.array(same),
                    ],
                    schema=schema,
                )

    text = F.coalesce(F.col("text"), F.lit("")).alias("__text")
    return small_batches(docs).select(*keep, text).mapInArrow(lean(run), out)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``text`` of the ``ids`` of every row."""
    name = _shipped(encoded, path)
    out = T.StructType([*[encoded.schema[c] for c in keep], T.StructField("text", T.StringType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(out)
        pieces = _model(name, None)
        for batch in batches:
            texts = [pieces.decode(ids or []) for ids in batch.column(n).to_pylist()]
            kept = [batch.column(i).cast(schema.types[i]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], schema=schema)

    return encoded.select(*keep, "ids").mapInArrow(lean(run), out)
