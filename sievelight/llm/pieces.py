"""SentencePiece encoding that keeps its place in the source, and decoding.

A text is normalised here, by the longest prefixes that the model's compiled character map knows; for each byte of the
result the place in the source is kept. The library then cuts the normalised text into pieces, and each piece is led back
over the kept places to the bytes of the source that it stands for.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

MARK = "▁"
#: The replacement character, which stands for each byte that is no UTF-8.
BROKEN = "�".encode()
#: Longer normalised texts go to the library in chunks of about so many bytes, where the model allows a cut.
CHUNK_BYTES = 1 << 18


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """Source to result of a compiled character map: four bytes of length, a double array of 32-bit units, then results
    that end in zero. Walks all branches of the array once."""
    if not blob:
        return {}
    length = int.from_bytes(blob[:4], "little")
    units, results = np.frombuffer(blob[4:4 + length], "<u4").tolist(), blob[4 + length:]
    step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
    out, open_ = {}, [(step(units[0]), b"")]
    while open_:
        base, path = open_.pop()
        for label in range(1, 256):
            at = base ^ label
            if at >= len(units) or units[at] & 0x800000FF != label:
                continue
            key, below = path + bytes((label,)), at ^ step(units[at])
            if units[at] >> 8 & 1:
                start = units[below] & 0x7FFFFFFF
                out[key] = results[start:results.index(b"\0", start)]
            open_.append((below, key))
    return out


class Normaliser:
    """What the model does to a text before it is cut: (normalised bytes, for each of them and the end its place in the source)."""

    def __init__(self, spec, suffix: bool = False, defined: Iterable[str] = ()) -> None:
        self.map = character_map(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, suffix
        self.space = MARK.encode() if spec.escape_whitespaces else b" "
        # what the model defines as symbols passes as it is and goes before the map
        self.map |= {d.encode(): d.encode() for d in defined}
        by_first: dict[bytes, set[int]] = {}
        for key in self.map:
            by_first.setdefault(key[:1], set()).add(len(key))
        self.lengths = {k: sorted(v, reverse=True) for k, v in by_first.items()}
        first = b"".join(re.escape(k) for k in sorted(by_first))
        self.starts = re.compile(b"[" + first + b"]") if first else None

    def chunks(self, data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
        """(start, end, result) of what the map replaces, by the longest prefix at each place; None: stays as it is."""
        at = begun = 0
        while self.starts is not None and (found := self.starts.search(data, at)):
            at = found.start()
            for n in self.lengths[data[at:at + 1]]:
                if data[at:at + n] in self.map:
                    if begun < at:
                        yield begun, at, None
                    yield at, at + n, self.map[data[at:at + n]]
                    at = begun = at + n
                    break
            else:
                at += 1  # no key begins inside a character, as keys are whole characters
        if begun < len(data):
            yield begun, len(data), None

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, np.int64)
        parts: list[bytes] = []
        places: list[np.ndarray] = []
        after_space, end, first = self.squeeze, 0, None
        for start, stop, result in self.chunks(data):
            if result is None:
                got, place = data[start:stop], _starts(data[start:stop]) + start
                if self.squeeze:
                    b = np.frombuffer(got, np.uint8) == 32
                    keep = ~(b & np.concatenate(([after_space], b[:-1])))
                    got, place = np.frombuffer(got, np.uint8)[keep].tobytes(), place[keep]
            else:
                got = result.lstrip(b" ") if after_space else result
                place = np.full(len(got), start)
            if first is None and got:
                first = int(place[0])
            if got:
                after_space = self.squeeze and got.endswith(b" ")
                parts.append(got)
                places.append(place)
        if first is None:  # nothing but spaces that are left out
            return b"", np.zeros(1, np.int64)
        text, place, end = b"".join(parts), np.concatenate(places), len(data)
        width = len(self.space)
        repeats = np.where(np.frombuffer(text, np.uint8) == 32, width, 1) if width > 1 else 1
        text, place = text.replace(b" ", self.space), np.repeat(place, repeats)
        if self.dummy and not self.suffix:
            text, place = self.space + text, np.concatenate((np.full(width, first), place))
        keep = len(text)
        while self.squeeze and text.endswith(self.space, 0, keep):
            keep -= width
        if keep < len(text):
            text, place, end = text[:keep], place[:keep], int(place[keep])
        if self.dummy and self.suffix:
            text, place = text + self.space, np.concatenate((place, np.full(width, end)))
        return text, np.concatenate((place, [end]))


def _starts(data: bytes) -> np.ndarray:
    """For each byte the place at which its character begins."""
    b = np.frombuffer(data, np.uint8)
    return np.maximum.accumulate(np.where(b & 0xC0 != 0x80, np.arange(len(b)), 0))


def whole_characters(data: bytes) -> tuple[bytes, np.ndarray | None]:
    """Bytes in which each byte that is no UTF-8 is the replacement character, and their places (None: nothing changed)."""
    try:
        data.decode()
        return data, None
    except UnicodeDecodeError:
        out, places, at = [], [], 0
        while at < len(data):
            try:
                data[at:].decode()
                bad = len(data)
            except UnicodeDecodeError as e:
                bad = at + e.start
            out.append(data[at:bad])
            places.append(np.arange(at, bad))
            if bad < len(data):
                out.append(BROKEN)
                places.append(np.full(len(BROKEN), bad))
            at = bad + 1
        return b"".join(out), np.concatenate([*places, [len(data)]])


class Pieces:
    """A model: its normaliser, and the library on texts that are normalised already."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        read = proto.ModelProto.FromString(model)
        kinds = proto.ModelProto.SentencePiece
        self.normalise = Normaliser(read.normalizer_spec, read.trainer_spec.treat_whitespace_as_suffix,
                                    [p.piece for p in read.pieces if p.type == kinds.USER_DEFINED])
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        bare = read.normalizer_spec
        bare.name, bare.precompiled_charsmap, bare.add_dummy_prefix, bare.remove_extra_whitespaces = "identity", b"", False, False
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=read.SerializeToString())
        self.byte = np.array([p.type == kinds.BYTE for p in read.pieces])
        value = [int(p.piece[3:5], 16) if p.type == kinds.BYTE else 0 for p in read.pieces]
        self.leads = np.array([b & 0xC0 != 0x80 for b in value])  # byte pieces that begin a character
        self.widths = np.where(self.byte, 1, [len(p.piece.encode()) for p in read.pieces])
        # a text may be cut before a mark that follows something else if no piece reaches over such a place
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.cuttable = bool(self.byte.any()) and not any(inner.search(p.piece) for p in read.pieces)

    def chunks(self, text: bytes) -> Iterator[str]:
        mark, at = MARK.encode(), 0
        while self.cuttable and len(text) - at > CHUNK_BYTES:
            cut = text.find(mark, at + CHUNK_BYTES)
            while cut > 0 and text[cut - len(mark):cut] == mark:
                cut = text.find(mark, cut + len(mark))
            if cut < 0:
                break
            yield text[at:cut].decode()
            at = cut
        yield text[at:].decode()

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with begin and end, and for each the bytes of the source [start, end)."""
        whole, moved = whole_characters(data)
        text, place = self.normalise(whole)
        if moved is not None:
            place = moved[place]
        if self.byte.any():
            ids = np.concatenate([np.asarray(self.cutter.encode(c), np.int64) for c in self.chunks(text)])
            stops = np.cumsum(self.widths[ids])
            starts = stops - self.widths[ids]
            # the last byte piece of a character stands for all of it, those before for nothing
            byte = self.byte[ids]
            if byte.any():
                opens = np.maximum.accumulate(np.where(byte & ~self.leads[ids], 0, np.arange(len(ids))))
                last = byte & ~np.concatenate((byte[1:] & ~self.leads[ids[1:]], [False]))
                starts = np.where(byte, starts[opens], starts)
                stops = np.where(byte & ~last, starts, stops)
        else:  # runs of unknown characters are one piece of any width
            spans = self.cutter.encode(text.decode(), return_type="proto").pieces
            ids = np.array([p.id for p in spans], np.int64)
            starts, stops = (np.array(x, np.int64) for x in ([p.begin for p in spans], [p.end for p in spans]))
        if len(stops) and stops[-1] != len(text):
            raise ValueError("pieces don't cover the text")
        sp = self.decoder
        edge = lambda i, at: ([i], [at]) if i >= 0 else ([], [])
        (bos, zero), (eos, end) = edge(sp.bos_id(), 0), edge(sp.eos_id(), len(data))
        return (np.concatenate((bos, ids, eos)).astype("<u4"), np.concatenate((zero, place[starts], end)).astype(np.int32),
                np.concatenate((zero, place[stops], end)).astype(np.int32))

    def decode(self, ids: np.ndarray) -> str:
        return self.decoder.decode(ids.tolist())


_models: dict[int, Pieces] = {}


def _model(shared) -> Pieces:
    """One for each worker process and broadcast model."""
    if shared.value[0] not in _models:
        _models[shared.value[0]] = Pieces(shared.value[1])
    return _models[shared.value[0]]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), kind))


def broadcast_model(spark: SparkSession, path: str):
    """The model's bytes (some 100 KB to a few MB, however large the tables are), sent to the workers."""
    with open(path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast((hash((path, data)), data))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`; ids, starts, ends: of each token, in order, its id and the bytes [start, end) of the text in UTF-8 that it
    stands for; packed: the ids as little-endian 32-bit numbers. path: a SentencePiece model file, read by the driver.

    Begin and end ids stand at the text's ends and cover nothing, nor does a mark put before the text. The byte pieces of a
    character that the model doesn't know: the last covers it, those before nothing. Null texts are empty; empty texts have begin and end
    ids alone. Bytes that are no UTF-8 are read as the replacement character. Texts of any length are encoded whole: long ones in
    chunks between which no piece can reach. Each row is encoded by itself, so ties can't arise, and repeated rows
    and null keys give rows of their own. Only `key` and `text` are read: other columns can't clash. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = broadcast_model(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for b in batches:
            if b.num_rows:
                done = [model.encode(t.as_py() or b"") for t in b.column(1)]
                ids, starts, ends = (list(x) for x in zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0), _lists([i.view("<i4") for i in ids], pa.int32()), _lists(starts, pa.int32()),
                    _lists(ends, pa.int32()), pa.array([i.tobytes() for i in ids], pa.binary())], [key, "ids", "starts", "ends", "packed"])
    kind = docs.select(key).dtypes[0][1]
    return docs.select(F.col(key), F.col(text).cast("binary")).mapInArrow(run,
        f"`{key}` {kind}, ids array<int>, starts array<int>, ends array<int>, packed binary")


def decode(encoded: DataFrame, path: str, packed: str = "packed") -> DataFrame:
    """Adds `decoded`, the text of the library's decode(ids): bytes that make no character become the replacement character, begin
    and end ids vanish. Null ids give null, none an empty text; rows stay as they are otherwise, repeated ones too. An
    empty table gives an empty one. A column `decoded` must not be there already."""
    spark = encoded.sparkSession
    small_batches(spark)
    shared, names = broadcast_model(spark, path), encoded.columns
    if "decoded" in [n.lower() for n in names]:
        raise ValueError("there is a column `decoded` already")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at = _model(shared), names.index(packed)
        for b in batches:
            texts = [None if x is None else model.decode(np.frombuffer(x, "<u4")) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "decoded"])
    return encoded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded string")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """covered_bytes: what all tokens of a text stand for, which is the text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(table(spark, sf_dir, "documents"), path)
    covered = F.array_max("ends").cast("long")
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "packed", covered.alias("covered_bytes"))
    return decode(coded, path).select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), "covered_bytes")
