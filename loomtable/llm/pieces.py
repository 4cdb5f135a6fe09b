"""SentencePiece encoding and decoding (byte-pair models) by vectorised merge rounds.

Encoding replaces the best-ranked neighbouring pair of symbols, the leftmost of equals, until no pair forms a piece.  Texts are cut into
words where no piece can reach across: before a space that follows another character, and between any two characters that stand side
by side in no piece.  The distinct words of a chunk lie as symbols in one flat array.  A round looks up the rank of every
neighbouring pair, takes each word's minimum by a segmented reduction, merges all its non-overlapping occurrences from the left and
compacts the arrays; words without a pair leave.  A merge may make a pair that ranks no worse than itself (runs of spaces do, as
may single pieces of a vocabulary): then only the word's leftmost occurrence is merged in that round, so the order is always that of
one merge at a time.  Where pieces of spaces alone rank last and alike, and merging as many spaces as the longest has gives that piece,
longer runs are cut at its multiples: the leftmost block is complete before any pair beyond it is the leftmost.

Characters without a piece become the pieces of their bytes.  Decoding joins the bytes of the pieces and drops the space that
encoding put before the text.

The model is read once on the driver; its tables (a few MB, the size of the vocabulary) are broadcast, so executors need no model file.
Models must be of the kind described: byte pairs, no normalising of characters, a space put before the text, byte pieces.

Defined results: a null text counts as the empty one; an empty text has only the begin and end ids; a null list of ids decodes to the
empty text; ids that are not in the vocabulary raise an error; bytes that are not UTF-8 decode to U+FFFD.  Rows are encoded one by one, so
repeated rows give repeated results, and empty tables an empty one.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from loomtable.llm.tables import columns
from loomtable.llm.words import batches_of_bytes

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
_NONE = np.iinfo(np.int64).max
_SIDE = 21
_CHUNK = 2 << 20


def read_model(path: str) -> dict:
    """Plain arrays of a model file: what each piece is, and the pairs that form pieces."""
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
    kinds = type(proto.pieces[0])
    norm, train = proto.normalizer_spec, proto.trainer_spec
    if (train.model_type != train.BPE or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not train.byte_fallback
            or not norm.escape_whitespaces or train.treat_whitespace_as_suffix or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces)):
        raise ValueError("only byte-pair models with byte pieces, a space before the text and no normalising are supported")
    special = {p.piece: i for i, p in enumerate(proto.pieces)}
    text = [p.piece.replace(SPACE, " ") if p.type == kinds.NORMAL else "" for p in proto.pieces]
    raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else t.encode() for p, t in zip(proto.pieces, text)]
    normal = {t: i for i, t in enumerate(text) if t}
    symbol = dict(normal)
    for t in normal:  # characters that are no pieces but stand in one
        for c in t:
            symbol.setdefault(c, len(proto.pieces) + len(symbol) - len(normal))
    score = {t: proto.pieces[i].score for t, i in normal.items()}
    rank = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
    pairs, early = {}, set()
    for t, i in normal.items():
        for k in range(1, len(t)):
            a, b = symbol.get(t[:k]), symbol.get(t[k:])
            if a is not None and b is not None:
                pairs[a << _SIDE | b] = (i, rank[score[t]])
                early |= {x for x in (a, b) if x < len(raw) and len(text[x]) > 1 and rank[score[text[x]]] >= rank[score[t]]}
    keys = np.array(sorted(pairs), np.int64)
    beside = {ord(x) << _SIDE | ord(y) for t in normal for x, y in zip(t, t[1:])}
    runs = [t for t in normal if not t.strip(" ") and len(t) > 1]
    level = {score[t] for t in runs}
    last = len(level) == 1 and all(score[t] > max(level) and "  " not in t for t in normal if t.strip(" "))
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) for b in raw], out=at[1:])
    chars = sorted((ord(t), i) for t, i in symbol.items() if len(t) == 1)
    return {
        "keys": keys, "merged": np.array([pairs[k][0] for k in keys.tolist()], np.int64), "rank": np.array([pairs[k][1] for k in keys.tolist()], np.int64),
        "early": np.array(sorted(early), np.int64), "beside": np.array(sorted(beside), np.int64), "run": max(map(len, runs)) if last else 0,
        "char": np.array([c for c, _ in chars], np.int64), "char_symbol": np.array([i for _, i in chars], np.int64), "size": len(raw),
        "byte": np.array([special[f"<0x{b:02X}>"] for b in range(256)], np.int64), "begin": train.bos_id, "end": train.eos_id,
        "raw": np.frombuffer(b"".join(raw), np.uint8), "raw_at": at}


def spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... counts[i] of them, for all i."""
    ends = np.cumsum(counts)
    return np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Pieces:
    """The tables of a model, ready for look-ups."""

    def __init__(self, model: dict):
        self.__dict__.update(model)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[self.char] = self.char_symbol
        self.comes_early = np.zeros(self.size + len(self.char) + 1, bool)
        self.comes_early[self.early] = True
        x, y = self.beside >> _SIDE, self.beside & ((1 << _SIDE) - 1)
        self.common_beside = np.zeros(1 << 20, bool)
        self.common_beside[(x << 10 | y)[(x < 1024) & (y < 1024)]] = True
        # pairs by open addressing: a slot keeps the index of its pair, one more look finds a pair that was displaced
        self.bits = max(4, int(len(self.keys) * 4).bit_length())
        self.slots = np.full((1 << self.bits) + 64, len(self.keys), np.int64)
        left, step = np.arange(len(self.keys)), 0
        home = self._home(self.keys)
        while len(left):
            slot = home[left] + step
            free = self.slots[slot] == len(self.keys)
            self.slots[slot[free][::-1]] = left[free][::-1]
            left, step = left[self.slots[slot] != left], step + 1
        self.probes = step
        self.keys = np.append(self.keys, -1)
        self.merged, self.rank = np.append(self.merged, -1), np.append(self.rank, _NONE)
        if self.run and len(self._merged(np.full(self.run, self.symbol_of[32], np.int64), np.zeros(self.run, np.int64))[0]) > 1:
            self.run = 0

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among the pairs that form pieces, the last index if it forms none."""
        key = left << _SIDE | right
        key[(left < 0) | (right < 0)] = -2
        home, none = self._home(key), len(self.keys) - 1
        at = self.slots[home]
        at = np.where(self.keys[at] == key, at, none)
        rest = np.flatnonzero((at == none) & (key >= 0))
        for step in range(1, self.probes):
            if not len(rest):
                break
            found = self.slots[home[rest] + step]
            hit = self.keys[found] == key[rest]
            at[rest[hit]] = found[hit]
            rest = rest[~hit & (found != none)]
        return at

    def encoded_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first[]) of distinct words given as UTF-8 with spaces."""
        data = b"".join(words.to_pylist())
        points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.zeros(len(words) + 1, np.int64)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=lead[1:])
        np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), out=sizes[1:])
        first = lead[sizes]
        n = len(points)
        symbol = self.symbol_of[points].astype(np.int64)
        symbol[symbol < 0] = -1 - points[symbol < 0]
        # parts that no piece crosses
        opens = np.zeros(n, bool)
        opens[first[:-1]] = True
        common = (points[:-1] < 1024) & (points[1:] < 1024)
        touch = self.common_beside[(points[:-1] << 10 | points[1:]) & 0xFFFFF] & common
        rare = np.flatnonzero(~common)
        touch[rare] = np.isin(points[rare] << _SIDE | points[rare + 1], self.beside)
        opens[1:] |= ~touch
        if self.run:
            space = points == 32
            begins = np.flatnonzero(space & (opens | ~np.concatenate([[False], space[:-1]])))
            index = np.arange(n)
            since = index - begins[np.maximum(np.searchsorted(begins, index, side="right") - 1, 0)] if len(begins) else index
            opens |= space & (since % self.run == 0)
        part = np.cumsum(opens) - 1
        ids, owner = self._merged(symbol, part)
        # words, not parts, own the ids
        word_of_part = np.searchsorted(first, np.flatnonzero(opens), side="right") - 1
        ids, counts = self._bytes_of_unknown(ids, np.bincount(word_of_part[owner], minlength=len(words)), word_of_part[owner])
        out = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=out[1:])
        return ids, out

    def _merged(self, symbol: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left when no pair merges, and the part of each, in the order of the parts."""
        done_symbol, done_part = [], []
        at = self._pairs(symbol, part)
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            rank = self.rank[at]
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbol)))
            live = np.repeat(least != _NONE, lengths)
            if not live.all():
                done_symbol.append(symbol[~live])
                done_part.append(part[~live])
                symbol, part, at, rank = symbol[live], part[live], at[live], rank[live]
                keep = least != _NONE
                least, lengths = least[keep], lengths[keep]
                starts = np.cumsum(lengths) - lengths
                if not len(symbol):
                    break
            hit = rank == np.repeat(least, lengths)
            places = np.flatnonzero(hit)
            # of overlapping occurrences, every second from the left
            fresh = np.flatnonzero(np.concatenate([[True], np.diff(places) > 1]))
            turn = places - np.repeat(places[fresh], np.diff(np.append(fresh, len(places))))
            places = places[turn % 2 == 0]
            made = self.merged[at[places]]
            early = self.comes_early[made]
            if early.any():
                owner = np.searchsorted(starts, places, side="right") - 1
                alone = np.zeros(len(starts), bool)
                alone[owner[early]] = True
                leftmost = np.concatenate([[True], owner[1:] != owner[:-1]])
                take = leftmost | ~alone[owner]
                places, made = places[take], made[take]
            symbol[places] = made
            keep = np.ones(len(symbol), bool)
            keep[places + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[places] = True
            changed[np.maximum(places - 1, 0)] = True
            changed[np.maximum(places - 2, 0)] = True  # the pair before may have lost its right symbol
            symbol, part, at, changed = symbol[keep], part[keep], at[keep], np.flatnonzero(changed[keep])
            after = np.minimum(changed + 1, len(symbol) - 1)
            at[changed] = self.pair(symbol[changed], np.where((part[after] == part[changed]) & (after > changed), symbol[after], -1))
        if not done_symbol:
            return symbol, part
        symbol, part = np.concatenate(done_symbol), np.concatenate(done_part)
        order = np.argsort(part, kind="stable")
        return symbol[order], part[order]

    def _pairs(self, symbol: np.ndarray, part: np.ndarray) -> np.ndarray:
        at = np.full(len(symbol), len(self.keys) - 1, np.int64)
        inner = np.flatnonzero(part[1:] == part[:-1])
        at[inner] = self.pair(symbol[inner], symbol[inner + 1])
        return at

    def _bytes_of_unknown(self, ids: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the pieces of their bytes."""
        odd = np.flatnonzero((ids < 0) | (ids >= self.size))
        if not len(odd):
            return ids, counts
        point_of = dict(zip(self.char_symbol.tolist(), self.char.tolist()))
        spelled = [chr(-1 - s if s < 0 else point_of[s]).encode() for s in ids[odd].tolist()]
        size = np.ones(len(ids), np.int64)
        size[odd] = [len(b) for b in spelled]
        out = np.repeat(ids, size)
        ends = np.cumsum(size)
        out[spread(ends[odd] - size[odd], size[odd])] = self.byte[np.frombuffer(b"".join(spelled), np.uint8)]
        return out, np.bincount(owner, weights=size, minlength=len(counts)).astype(np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first[]) of whole texts, with begin and end ids."""
        lines = [b" " + t.replace(_SPACE_BYTES, b" ") if t else b"" for t in texts]
        data = b"".join(lines)
        at = np.zeros(len(lines) + 1, np.int64)
        np.cumsum([len(t) for t in lines], out=at[1:])
        raw = np.frombuffer(data, np.uint8)
        counts, ids, first, index = np.zeros(len(lines), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        word_first = np.zeros(len(lines) + 1, np.int64)
        if len(data):
            space = raw == 32
            opens = space & ~np.concatenate([[False], space[:-1]])
            opens[at[:-1][at[:-1] < len(data)]] = True
            starts = np.flatnonzero(opens)
            words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data)])
            coded = words.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False)
            ids, first = self.encoded_words(coded.dictionary)
            word_first = np.searchsorted(starts, at)
            sums = np.concatenate([[0], np.cumsum(np.diff(first)[index])])
            counts = np.diff(sums[word_first])
        flat = ids[spread(first[index], np.diff(first)[index])] if len(index) else ids
        ends = np.cumsum(counts + 2)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
        inner = np.ones(len(out), bool)
        inner[ends - 1], inner[ends - counts - 2] = False, False
        out[inner], out[ends - 1], out[ends - counts - 2] = flat, self.end, self.begin
        return out, np.concatenate([[0], ends])

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of lists of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not in the vocabulary")
        size = np.diff(self.raw_at)[ids]
        data = self.raw[spread(self.raw_at[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[first]
        out = []
        for a, b, i in zip(at[:-1].tolist(), at[1:].tolist(), first[:-1].tolist()):
            out.append((data[a + 1:b] if data[a:a + 1] == b" " else data[a:b]).decode(errors="replace"))
        return out


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids: all ids of each text as little-endian unsigned 32-bit integers, begin and end included."""
    given = columns(docs, id=id_col, text=text_col)
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        for batch in batches:
            for at, texts in batches_of_bytes(batch.column(1), _CHUNK):
                ids, first = pieces.encode(texts)
                lists = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(np.diff(first)), lists], names=["id", "n_tokens", "ids"])
            pa.default_memory_pool().release_unused()

    out = given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, model_path: str, carry: list[str], ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The carried columns, the ids and the text that the ids spell."""
    given = tokens.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{ids_col}`"))
    model = tokens.sparkSession.sparkContext.broadcast(read_model(model_path))
    schema = given.withColumn(text_col, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        for batch in batches:
            for at, lists in batches_of_bytes(batch.column(len(carry))):
                first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])])
                texts = pieces.decode(np.frombuffer(b"".join(lists), "<u4").astype(np.int64), first)
                part = batch.slice(at, len(lists))
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*schema.names])
            pa.default_memory_pool().release_unused()

    return given.mapInArrow(run, schema)
