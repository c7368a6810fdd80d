"""SentencePiece models run by the tokenizers library.

The model file is read as plain protobuf fields; from them the tokenizer is rebuilt: normaliser (character map, spaces),
metaspace marker, unigram scores or the merges that BPE scores imply, byte fallback. ``Codec`` encodes batches, which the
library spreads over its threads, and decodes by joining the bytes of pieces.

When no piece holds a marker after another character, and none a line feed, merges never cross from one word into the
next marker, nor a line feed. A text is then cut there and every distinct unit is encoded once per worker; each new
unit is compared with the original library, so parity is verified on everything that was encoded. Otherwise whole
texts are encoded and compared. Where the two differ the original's ids are taken, and ``parity`` is false. The store of
units is emptied when full, which bounds memory and changes no result.

Defined cases: a null text is empty and has no ids; a marker character in a text reads back as the space it stands for;
repeated rows give equal rows; an empty table gives an empty result; carried columns keep their names and the names of
the results begin with the caller's ``prefix``, which can avoid a clash.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

from fluxloom.llm.text import whole

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
FULL = 400_000
LINE = 512
AT_ONCE = 512
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes):
    """(number, value) of a protobuf message: whole numbers, raw 4 or 8 bytes, or the bytes of a nested field."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Model:
    """What the file says, with the defaults of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    character_map: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def read_model(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for inner, x in fields(value):
                if inner == 1:
                    piece = x.decode()
                elif inner == 2:
                    score = struct.unpack("<f", x)[0]
                elif inner == 3:
                    kind = x
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for inner, x in fields(value):
                if inner == 3:
                    model.kind = x
                elif inner == 35:
                    model.byte_fallback = bool(x)
        elif number == 3:
            for inner, x in fields(value):
                if inner == 2:
                    model.character_map = x
                elif inner == 3:
                    model.add_dummy_prefix = bool(x)
                elif inner == 4:
                    model.remove_extra_spaces = bool(x)
                elif inner == 5:
                    model.escape_spaces = bool(x)
    return model


def rebuilt(model: Model) -> Tokenizer:
    """The tokenizers-library form; its normaliser does all that the file asks for."""
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = [
            (p[:cut], p[cut:]) for p in sorted(score, key=lambda p: -score[p]) for cut in range(1, len(p))
            if p[:cut] in score and p[cut:] in score
        ]
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges, fuse_unk=True,
                          unk_token=model.pieces[unknown][0], byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(model.character_map)] if model.character_map else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    return tokenizer


class Codec:
    """Encodes and decodes; ``wrong`` holds units whose ids differ from the original library's."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.model = read_model(file.read())
        self.original = SentencePieceProcessor(model_file=path)
        self.whole = rebuilt(self.model)
        self.kind = np.dtype("<u2" if len(self.model.pieces) <= 1 << 16 else "<u4")
        self.bytes = [self._bytes_of(*piece) for piece in self.model.pieces]
        normal = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED)]
        self.by_unit = (
            self.model.kind == BPE and self.model.byte_fallback and self.model.add_dummy_prefix and self.model.escape_spaces
            and not self.model.remove_extra_spaces and not self.model.character_map
            and not any("\n" in p or MARK in p.lstrip(MARK) for p in normal)
        )
        self.line_feed = self.whole.token_to_id("<0x0A>")
        self.mark = self.whole.token_to_id(MARK)
        self.units = rebuilt(self.model)
        self.units.normalizer = normalizers.Sequence([])
        self.units.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
        self.known: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.wrong: set[str] = set()

    @staticmethod
    def _bytes_of(piece: str, _: float, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(MARK, " ").encode()

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of units without line feeds, many to a call."""
        lines = [parts[at : at + LINE] for at in range(0, len(parts), LINE)]
        out = []
        for line, code in zip(lines, self.units.encode_batch_fast(["\n".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(code.ids, self.kind)
            raw, size = ids.tobytes(), self.kind.itemsize
            stops = np.append(np.flatnonzero(ids == self.line_feed), len(ids))
            starts = np.append(0, stops[:-1] + 1)
            if len(stops) != len(line):
                raise ValueError("a unit holds a line feed")
            out += [raw[a:z] for a, z in zip((starts * size).tolist(), (stops * size).tolist())]
        return out

    def _learn(self, new: list[str]) -> None:
        if len(self.parts) > FULL:
            self.parts.clear()
        cut = [unit.split("\n") for unit in new]
        parts = list({p for unit in cut for p in unit if p}.difference(self.parts))
        self.parts.update(zip(parts, self._ids(parts)))
        self.parts[""] = b""
        feed = np.array([self.line_feed], self.kind).tobytes()
        for unit, pieces in zip(new, cut):
            self.known[unit] = feed.join([self.parts[p] for p in pieces])
        true = self.original.encode([unit[1:].replace(MARK, " ") for unit in new], num_threads=1)
        for unit, ids in zip(new, true):
            right = np.array(ids if unit != MARK else [self.mark], self.kind).tobytes()
            if self.known[unit] != right:
                self.wrong.add(unit)
                self.known[unit] = right

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of every text, and whether the original library gives the same."""
        if not self.by_unit:
            coded = self.whole.encode_batch_fast(texts, add_special_tokens=False)
            true = self.original.encode(texts, num_threads=1)
            return [(np.array(b, self.kind).tobytes(), a.ids == b) for a, b in zip(coded, true)]
        split = []
        for text in texts:
            plain = text and "  " not in text and text[0] != " " and text[-1] != " " and MARK not in text
            if plain:
                split.append((MARK + text.replace(" ", " " + MARK)).split(" "))
            else:
                split.append(UNIT.findall(MARK + text.replace(" ", MARK)) if text else [])
        distinct = set().union(*split)
        new = distinct.difference(self.known)
        if len(self.known) + len(new) > FULL:
            self.known.clear()
            new = distinct
        if new:
            self._learn(list(new))
        get = self.known.__getitem__
        return [(b"".join(map(get, units)), not self.wrong or self.wrong.isdisjoint(units)) for units in split]

    def decode(self, raw: bytes) -> str:
        """Text of ids as ``encode`` gives them."""
        joined = b"".join(map(self.bytes.__getitem__, np.frombuffer(raw, self.kind).tolist()))
        if self.model.add_dummy_prefix and joined.startswith(b" "):
            joined = joined[1:]
        return joined.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process and model file; the library gets as many threads as the task has cores."""
    context = TaskContext.get()
    if context:
        os.environ.setdefault("RAYON_NUM_THREADS", str(context.cpus()))
    return Codec(path)


def encoded(docs: DataFrame, carry: list[str], model: str, ids: str | None = None, prefix: str = "") -> DataFrame:
    """Carried columns, ``n_tokens``, ``ids_crc32``, ``parity`` and ``round_trip``; the ids too if ``ids`` names them.

    ``prefix`` goes before the names of the four.
    """
    kept = [T.StructField(c, docs.schema[c].dataType) for c in carry]
    made = [T.StructField(prefix + "n_tokens", T.LongType()), T.StructField(prefix + "ids_crc32", T.LongType()),
            T.StructField(prefix + "parity", T.BooleanType()), T.StructField(prefix + "round_trip", T.BooleanType())]
    if ids:
        made.append(T.StructField(ids, T.ArrayType(T.IntegerType())))

    def run(batches):
        code = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                piece = batch.slice(at, AT_ONCE)
                texts = piece.column(piece.num_columns - 1).to_pylist()
                raws = code.encode(texts)
                lengths = [len(raw) // code.kind.itemsize for raw, _ in raws]
                wide = [np.frombuffer(raw, code.kind).astype("<i4") for raw, _ in raws]
                columns = [*piece.columns[:-1], pa.array(lengths, pa.int64()),
                           pa.array([zlib.crc32(x) for x in wide], pa.int64()), pa.array([same for _, same in raws]),
                           pa.array([code.decode(raw) == text.replace(MARK, " ") for (raw, _), text in zip(raws, texts)])]
                if ids:
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    values = np.concatenate(wide) if wide else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept + made])

    chosen = docs.select(*[docs[c] for c in carry], whole(docs["text"]).alias("_text"))
    return chosen.mapInArrow(run, T.StructType(kept + made))
