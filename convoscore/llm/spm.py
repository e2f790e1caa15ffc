"""SentencePiece encoding and decoding, driven by an Aho-Corasick automaton over the pieces.

One pass over a text: at each position the automaton gives, by its output links, every piece that ends there, and each
relaxes the state of that position from the state where the piece begins.

* Unigram vocabularies: plain Viterbi.  The state is the best sum of scores; ties go to the longest last piece.
* BPE vocabularies (the public one here is one): scores are merge ranks, and the segmentation of highest sum is not what
  the merges give.  There a piece relaxes a position only if the merges leave the border between it and the piece before
  alone - exactly one piece does.  The check of such a pair is remembered.  The ids are then the library's own.

Characters without a piece become byte pieces (or the unknown id).  No piece holds a space mark after another character,
so texts split before runs of spaces, and the encoding of a unit is remembered in each worker process.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Units in each of the two generations that a worker remembers; an eighth of that for units that no space comes before.
REMEMBERED = 150_000
#: Longer units are not remembered.
LONGEST = 64
PUBLIC_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class _Units(dict):
    """The ids of a unit as packed numbers, remembered in two generations: a full one becomes the old one, and what is
    asked for again comes back from there, so frequent units stay."""

    def __init__(self, codec: Codec, before: str, most: int):
        super().__init__()
        self.codec, self.before, self.most, self.old = codec, before, most, {}

    def __missing__(self, unit: str) -> bytes:
        found = self.old.pop(unit, None)
        if found is None:
            found = array(self.codec.kind, self.codec._unit(self.before + unit)).tobytes()
        if len(unit) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[unit] = found
        return found


class Codec:
    """Encoder and decoder of one model, given as the bytes of a SentencePiece model file."""

    def __init__(self, model: bytes, unigram: bool | None = None):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.unknown = sp.unk_id()
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (i in self.silent or i in self.byte_of or i == self.unknown or sp.is_unused(i))}
        self.unigram = _is_unigram(model) if unigram is None else unigram
        self.no_score = min(self.scores) - 10.0
        self.pairs: dict[int, bool] = {}
        usable = [p for p in self.ids if self.unigram or len(p) == 1 or self._merge(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in usable:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        self.single = frozenset(p for p in usable if len(p) == 1)
        self.width = [len(p) for p in self.pieces]
        #: Whether no piece crosses the border before a run of space marks, or a line feed.
        self.splits = not any(MARK in p.lstrip(MARK) or "\n" in p and p != "\n" for p in self.ids)
        self.runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.kind = "H" if n <= 1 << 16 else "I"
        self.bare, self.spaced = _Units(self, "", REMEMBERED // 8), _Units(self, MARK, REMEMBERED)
        #: What decoding writes for an id: text, or None for a byte.
        self.texts = [None if i in self.byte_of else "" if i in self.silent else " ⁇ " if i == self.unknown else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]

    def _merge(self, text: str) -> list[str]:
        """The merges of BPE, best score first, leftmost among equals; quadratic, for pieces and pairs of pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                at = self.ids.get(parts[i] + parts[i + 1])
                if at is not None and (best is None or self.scores[at] > best):
                    best, where = self.scores[at], i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def _fits(self, key: int) -> bool:
        left, right = divmod(key, len(self.pieces))
        if len(self.pairs) >= 2 * REMEMBERED:
            self.pairs.clear()
        two = [self.pieces[left], self.pieces[right]] if left < len(self.pieces) else []
        known = self.pairs[key] = not two or self._merge("".join(two)) == two
        return known

    def _segment(self, unit: str) -> list[int]:
        """Ids for a unit all of whose characters have a piece: one pass, longest piece first at each position.

        Every piece that ends at a position relaxes its best score from where the piece begins.  In a BPE vocabulary only
        if the merges leave the border before the piece alone; as exactly one piece does, the first that fits settles the
        position, and no scores need to be compared.  The state of position -1, before the first character, is kept at
        the end of the lists."""
        if not unit:
            return []
        n, out = len(unit), []
        if self.unigram:
            best, last, scores = [float("-inf")] * n + [0.0], [(0, 0)] * n, self.scores
            for end, found in self.automaton.iter(unit):
                value = best[end - found[0]] + scores[found[1]]
                if value > best[end]:
                    best[end], last[end] = value, found
            end = n - 1
            while end >= 0:
                size, at = last[end]
                out.append(at)
                end -= size
            return out[::-1]
        base, fits, width = len(self.pieces), self.pairs.get, self.width
        state: list = [None] * n + [base * base]  # what fits before any piece
        for end, (size, at) in self.automaton.iter(unit):
            if state[end] is None:
                left = state[end - size]
                if left is not None and (fit := fits(left + at)) is not False and (fit or self._fits(left + at)):
                    state[end] = at * base
        end = n - 1
        while end >= 0:
            at = state[end] // base
            out.append(at)
            end -= width[at]
        return out[::-1]

    def _unit(self, unit: str) -> list[int]:
        """Ids for a unit.  A character without a piece never merges, so it parts the unit."""
        if self.single.issuperset(unit):
            return self._segment(unit)
        out: list[int] = []
        begin = 0
        for i, c in enumerate(unit):
            if c not in self.single:
                out += self._segment(unit[begin:i])
                begin = i + 1
                if self.bytes:
                    out += [self.bytes[b] for b in c.encode("utf-8", "replace")]
                elif not (out and out[-1] == self.unknown):
                    out.append(self.unknown)
        return out + self._segment(unit[begin:])

    def packed(self, text: str) -> bytes:
        """The ids of a text as packed numbers; the model puts one space before it, escapes spaces and changes nothing else."""
        if not text:
            return b""
        if not self.splits:
            return array(self.kind, self._unit(MARK + text.replace(" ", MARK))).tobytes()
        out: list[bytes] = []
        first, spaced, bare = self.spaced, self.spaced.__getitem__, self.bare
        for k, line in enumerate(text.replace(MARK, " ").split("\n")):
            if k:
                out.append(bare["\n"])
                first = bare
            words = line.split(" ")
            if "" in words:
                out += map(bare.__getitem__, self.runs((MARK if first is self.spaced else "") + line.replace(" ", MARK)))
            else:
                out.append(first[words[0]])
                del words[0]
                out += map(spaced, words)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array(self.kind, self.packed(text)).tolist()

    def decode(self, ids) -> str:
        try:
            text = "".join(map(self.texts.__getitem__, ids))
        except TypeError:  # there are byte pieces: runs of them are characters together
            parts, run, byte_of = [], bytearray(), self.byte_of
            for i, part in zip(ids, map(self.texts.__getitem__, ids), strict=True):
                if part is None:
                    run.append(byte_of[i])
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run.clear()
                parts.append(part)
            if run:
                parts.append(run.decode("utf-8", "replace"))
            text = "".join(parts)
        return text[1:] if text[:1] == " " else text


def _is_unigram(model: bytes) -> bool:
    """trainer_spec (field 2) . model_type (field 3) of the model file: 1 is unigram, 2 is BPE; unigram by default."""

    def fields(buf: bytes):
        at = 0

        def number():
            nonlocal at
            value = shift = 0
            while True:
                byte = buf[at]
                at += 1
                value |= (byte & 0x7F) << shift
                shift += 7
                if byte < 0x80:
                    return value

        while at < len(buf):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            elif key & 7 == 2:
                size = number()
                yield key >> 3, buf[at : at + size]
                at += size
            else:
                size = 8 if key & 7 == 1 else 4
                yield key >> 3, buf[at : at + size]
                at += size

    for field, value in fields(model):
        if field == 2:
            return next((v for f, v in fields(value) if f == 3), 1) == 1
    return True


def _cached(cache: dict, model) -> Codec:
    key = ("spm", hash(model.value))
    if key not in cache:
        cache[key] = Codec(model.value)
    return cache[key]


def model_bytes(path: str = PUBLIC_MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, text_col: str = "text", model_path: str = PUBLIC_MODEL, ids_col: str = "ids", count_col: str = "n_tokens", check_col: str | None = "round_trip") -> DataFrame:
    """``docs`` without its text, with the piece ids of the whole text, their number, and whether decoding them gives the
    text again (a literal space mark comes back as a space, as in any SentencePiece model; everything else must agree).

    Null and empty texts have no ids; very long ones are encoded whole, unit by unit.  Rows that repeat are encoded each,
    nulls in other columns stay, columns that are named like a new one give way to it, and an empty table gives an empty
    result.  The model file, of a few MB, is read on the driver and broadcast.
    """
    from pyspark.sql import types as T

    from .common import pieces, utf8, worker_cache

    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(count_col, T.LongType())] + ([T.StructField(check_col, T.BooleanType())] if check_col else [])
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in {f.name.lower() for f in new} - {text_col.lower()}))
    kept = [f for f in docs.schema.fields if f.name != text_col]
    at = docs.columns.index(text_col)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        codec = _cached(worker_cache(), model)
        for batch in pieces(batches):
            ends, flat, same = [0], [], []
            for raw in utf8(batch.column(at)):
                text = raw.decode("utf-8", "replace")
                ids = codec.packed(text)
                if check_col:
                    same.append(codec.decode(array(codec.kind, ids)) == text.replace(MARK, " "))
                flat.append(np.frombuffer(ids, codec.kind))
                ends.append(ends[-1] + len(flat[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat).astype(np.int32) if flat else [], pa.int32()))
            cols = [c for i, c in enumerate(batch.columns) if i != at] + [lists, pa.array(np.diff(ends), pa.int64())] + ([pa.array(same, pa.bool_())] if check_col else [])
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in kept + new])

    return docs.mapInArrow(encode, T.StructType(kept + new))


def decode_documents(encoded: DataFrame, ids_col: str = "ids", text_col: str = "text", model_path: str = PUBLIC_MODEL) -> DataFrame:
    """``encoded`` with the text of its ids as one more column, in place of one of that name; null ids give the empty text."""
    from pyspark.sql import types as T

    from .common import worker_cache

    model = encoded.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    encoded = encoded.select(*(f"`{c}`" for c in encoded.columns if c.lower() != text_col.lower()))
    at = encoded.columns.index(ids_col)

    def decode(batches):
        import pyarrow as pa

        codec = _cached(worker_cache(), model)
        for batch in batches:
            texts = [codec.decode(ids or ()) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return encoded.mapInArrow(decode, T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())]))
