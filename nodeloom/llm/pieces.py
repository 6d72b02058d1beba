"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file:

- the normaliser: white space becomes the mark U+2581, one mark is put in front (as the
  model's normaliser says), and a mark that is in the text already becomes its bytes, so that
  decoding gives back the very text;
- the pieces, as a trie of arcs from a position to the end of each piece that begins there,
  and byte fallback: an arc over one character that is no piece, which emits its bytes;
- the junction acceptor. In a unigram model each arc weighs its piece's negative score and
  junctions weigh nothing. In a BPE model arcs weigh nothing and a junction of two pieces
  weighs 0 if merging their characters again gives the same two pieces, else infinity: BPE
  output is exactly the path all of whose junctions are of that kind.

Each input is composed with them lazily and its tropical shortest path is taken: position by
position, the least sum, where the prefix's best path is all that a position has to remember.
No piece goes on over the beginning of a run of marks (checked when compiling), so paths of
the chunks between such beginnings are taken one by one and those of short chunks are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, packed, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Paths of chunks (twice as many at most) and junctions that a worker keeps, about 300 MB; the longest chunk kept.
KEEP, KEEP_LENGTH = (400_000, 1_500_000), 32

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the file
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, model: bytes, keep: tuple[int, int] = KEEP):
        self.keep_chunks, self.keep_junctions = keep
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.kind_of_model, self.prefix, self.squeeze, self.bytes_at = UNIGRAM, True, True, {}
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                self.kind_of_model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("this normaliser has a character map; only white space rules are compiled")
                self.prefix, self.squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
        if self.kind_of_model not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are compiled")
        self.unknown = next(i for i, k in enumerate(kinds) if k == UNKNOWN)
        self.bytes_at = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        usable = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (NORMAL, USER) and p}
        self.at, self.kinds = usable, kinds
        self.cuts = not any(MARK in p.lstrip(MARK) for p in usable)
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if self.cuts else lambda text: [text] if text else []
        # The trie: a dictionary of children for each state; state 0 is the root.
        self.trie: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for p, i in usable.items():
            state = 0
            for c in p:
                if c not in self.trie[state]:
                    self.trie[state][c] = len(self.trie)
                    self.trie.append({})
                    self.final.append(-1)
                state = self.trie[state][c]
            self.final[state] = i
        self.weight = [0.0 if self.kind_of_model == BPE else -s for s in self.scores]
        self.rank = self.scores
        self.penalty = -min(self.scores, default=0.0) + 10.0
        self.junctions: dict[int, bool] = {}
        self.paths: dict[str, bytes] = {}  # of short chunks met lately, and
        self.older: dict[str, bytes] = {}  # of those before, which are dropped when paths is full again
        self.surface = [self._surface(i, k) for i, k in enumerate(kinds)]

    def _surface(self, i: int, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return b"" if kind in (CONTROL, UNKNOWN) else self.pieces[i].replace(MARK, " ").encode()

    def merged(self, text: str) -> list[str]:
        """The pieces that merging the characters of a short text gives: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                i = self.at.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] > best):
                    best, where = self.rank[i], k
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def joins(self, a: int, b: int) -> bool:
        """The junction of pieces a and b weighs 0 (a: -1 at the beginning of a chunk)."""
        key = a * 1_048_576 + b
        got = self.junctions.get(key)
        if got is None:
            if len(self.junctions) >= self.keep_junctions:
                self.junctions.clear()
            x, y = self.pieces[a] if a >= 0 else "", self.pieces[b]
            got = self.junctions[key] = self.merged(x + y) == ([x, y] if x else [y])
        return got

    def shortest(self, chunk: str) -> list[int]:
        """Piece ids of the least path over a chunk."""
        n, infinite, bpe = len(chunk), float("inf"), self.kind_of_model == BPE
        dist, back, last = [infinite] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        dist[0] = 0.0
        trie, final, weight, known = self.trie, self.final, self.weight, self.junctions
        for i in range(n):
            d, own, state = dist[i], last[i], 0
            if d == infinite:
                continue
            for j in range(i, n):
                state = trie[state].get(chunk[j], -1)
                if state < 0:
                    break
                p = final[state]
                if p < 0 or d + weight[p] >= dist[j + 1]:
                    continue
                if bpe and own != -2:
                    fits = known.get(own * 1_048_576 + p)
                    if not (self.joins(own, p) if fits is None else fits):
                        continue
                elif bpe and not self.joins(-1, p):
                    continue
                dist[j + 1], back[j + 1], last[j + 1] = d + weight[p], i, p
            if trie[0].get(chunk[i]) is None or final[trie[0][chunk[i]]] < 0:
                step = d + (0.0 if bpe else self.penalty)
                if step < dist[i + 1]:
                    dist[i + 1], back[i + 1], last[i + 1] = step, i, -2  # no piece: merges with nothing
        out: list[int] = []
        i = n
        while i > 0:
            if last[i] == -2:
                out.extend(reversed(self._bytes(chunk[back[i]])))
            else:
                out.append(last[i])
            i = back[i]
        out.reverse()
        return out

    def _bytes(self, char: str) -> list[int]:
        return [self.bytes_at.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")] if self.bytes_at else [self.unknown]

    def _path(self, chunk: str) -> bytes:
        got = self.older.get(chunk) or np.array(self.shortest(chunk), "<i4").tobytes()
        if len(chunk) <= KEEP_LENGTH:
            if len(self.paths) >= self.keep_chunks:
                self.older, self.paths = self.paths, {}
            self.paths[chunk] = got
        return got

    def packed(self, text: str) -> bytes:
        """Piece ids of a whole text, four bytes each."""
        if not text:
            return b""
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        path, parts = self._path, []
        for k, plain in enumerate(text.split(MARK)):
            if k:
                parts.append(np.array(self._bytes(MARK), "<i4").tobytes())
            marked = plain.replace(" ", MARK)
            chunks = self.chunks(MARK + marked if self.prefix and not k else marked)
            parts += [self.paths.get(c) or path(c) for c in chunks]
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        """Piece ids of a whole text."""
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; bytes that are no UTF-8 become U+FFFD."""
        surface = self.surface
        out = b"".join([surface[i] for i in ids])
        return (out[1:] if self.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(model: bytes, keep: tuple[int, int] = KEEP) -> Transducer:
    """The machines of a model file's bytes, compiled once in each process."""
    return Transducer(model, keep)


def model_bytes(docs: DataFrame, path: str) -> bytes:
    """The bytes of a model file, read on the driver only (half a megabyte)."""
    if "://" in path:
        return bytes(docs.sparkSession.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, model: str = MODEL, keep: tuple[int, int] = KEEP) -> DataFrame:
    """``row`` (struct of the columns ``carry``, all by default), ``token_ids``, ``n_tokens``, ``round_trip``.

    round_trip says that decoding the ids gave the very text. Null and empty texts have no
    tokens, and round_trip is true. Extra columns travel inside ``row`` only. Texts are encoded
    whole, whatever their length. ``keep`` bounds a worker's memory, not the results.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model_bytes(docs, model))
    plain = docs.select(packed(docs, carry).alias("row"), docs[text_col].cast("string").alias("text"))
    schema = plain.select("row", F.expr("cast(array() as array<int>)").alias("token_ids"), F.lit(0).alias("n_tokens"), F.lit(True).alias("round_trip")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shipped.value, keep)
        surface = pa.array(machine.surface, pa.binary())
        for batch in batches:
            for i in range(0, len(batch), 256):
                texts = batch.column(1).slice(i, 256).fill_null("")
                ids = [machine.packed(t) for t in texts.to_pylist()]
                size = np.array([len(x) // 4 for x in ids], np.int32)
                at, flat = pa.array(np.r_[np.int32(0), np.cumsum(size, dtype=np.int32)]), pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(at, flat)
                back = pc.binary_join(pa.ListArray.from_arrays(at, surface.take(flat)), b"")
                plain_text = texts.cast(pa.binary())
                if machine.prefix:
                    plain_text = pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(plain_text), 0), b"", b" "), plain_text, b"")
                same = pc.equal(back, plain_text)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), lists, pa.array(size), same], schema.names)
        give_back()

    return plain.mapInArrow(run, schema)


def decoded(rows: DataFrame, ids_col: str = "token_ids", carry: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """``row`` and ``text`` of each row's piece ids; null ids give a null text."""
    shipped = rows.sparkSession.sparkContext.broadcast(model_bytes(rows, model))
    plain = rows.select(packed(rows, carry).alias("row"), rows[ids_col].cast("array<int>").alias("ids"))
    schema = plain.select("row", F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(shipped.value)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema.names)

    return plain.mapInArrow(run, schema)


def op9_sentencepiece(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, token_ids, n_tokens, round_trip of every document."""
    got = encoded(docs, carry=["doc_id"], model=model)
    return got.select("row.doc_id", "token_ids", "n_tokens", "round_trip")
