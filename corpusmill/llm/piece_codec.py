"""Subword pieces with offsets, and back.

A text is normalised by the longest prefix that the model's compiled character map knows, at each place, and every
byte of the normalised text remembers the source byte it came from. The normalised text is cut where no piece of the
vocabulary can cross, each different part is segmented once, and every piece is projected through the alignment to a
span of source bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.spancache import SpanCache, groups
from corpusmill.llm.text import whole_text

MARK = "▁"
_NORMAL, _USER, _BYTE = 1, 4, 6


def read_character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie over UTF-8 keys, then the replacements."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    values = blob[4 + size:]
    rules: dict[str, str] = {}
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    stack = [(0, b"")]
    while stack:
        node, key = stack.pop()
        base = node ^ offset(units[node])
        if units[node] >> 8 & 1 and base < len(units):
            at = units[base] & 0x7FFFFFFF
            rules[key.decode("utf-8", "surrogateescape")] = values[at:values.index(b"\0", at)].decode("utf-8")
        for byte in range(1, 256):
            child = base ^ byte
            if child < len(units) and units[child] & 0x800000FF == byte:
                stack.append((child, key + bytes([byte])))
    return rules


class Normaliser:
    """Longest-prefix normalisation that records where each byte of its result comes from."""

    def __init__(self, rules: dict[str, str], dummy_prefix: bool = True, remove_extra: bool = False, escape: bool = True, suffix: bool = False):
        self.rules, self.dummy, self.remove_extra, self.escape, self.suffix = rules, dummy_prefix, remove_extra, escape, suffix
        by_first: dict[str, int] = {}
        for key in rules:
            by_first[key[0]] = max(by_first.get(key[0], 0), len(key))
        self.longest = by_first
        self.special = re.compile("[" + "".join(re.escape(c) for c in [*by_first, *([" "] if remove_extra else [])]) + "]") if by_first or remove_extra else None

    def _prefixes(self, text: str) -> Iterator[tuple[str, str]]:
        """(normalised, source) prefix by prefix; what no rule touches comes in runs."""
        at, n = 0, len(text)
        while at < n:
            m = self.special.search(text, at)
            if m is None or m.start() > at:
                end = n if m is None else m.start()
                yield text[at:end], text[at:end]
                at = end
                continue
            for k in range(min(self.longest.get(text[at], 0), n - at), 0, -1):
                if (to := self.rules.get(text[at:at + k])) is not None:
                    yield to, text[at:at + k]
                    at += k
                    break
            else:
                yield text[at], text[at]
                at += 1

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte."""
        space = MARK if self.escape else " "
        if not text:
            return "", np.zeros(1, np.int64)
        if self.special is None:
            out = text
            data = np.frombuffer(text.encode(), np.uint8)
            lead = (data & 0xC0) != 0x80
            start = np.flatnonzero(lead)[np.cumsum(lead) - 1]  # each byte belongs to the start of its character
            if self.escape:
                start = np.repeat(start, np.where(data == 32, 3, 1))
                out = text.replace(" ", MARK)
            end = len(data)
            align = start
        else:
            parts, chunks = [], []
            previous, at = self.remove_extra, 0
            for to, source in self._prefixes(text):
                width = len(source.encode())
                shown = to
                if previous:
                    shown = shown.lstrip(" ")
                if shown:
                    data = np.frombuffer(shown.encode(), np.uint8)
                    if to == source and shown == to:
                        lead = (data & 0xC0) != 0x80
                        where = at + np.flatnonzero(lead)[np.cumsum(lead) - 1]
                    else:
                        where = np.full(len(data), at, np.int64)
                    if self.escape:
                        where = np.repeat(where, np.where(data == 32, 3, 1))
                        shown = shown.replace(" ", MARK)
                    parts.append(shown)
                    chunks.append(where)
                    previous = self.remove_extra and to.endswith(" ")
                at += width
            out = "".join(parts)
            align = np.concatenate(chunks) if chunks else np.zeros(0, np.int64)
            end = at
            if self.remove_extra:
                bare = out.rstrip(space)
                if len(bare) < len(out):
                    cut = len(bare.encode())
                    end = int(align[cut])
                    align, out = align[:cut], bare
            if not out:
                return "", np.zeros(1, np.int64)
        if self.dummy:
            width = len(space.encode())
            edge = np.full(width, align[0] if not self.suffix and self.remove_extra else (end if self.suffix else 0), np.int64)
            out = out + space if self.suffix else space + out
            align = np.concatenate([align, edge] if self.suffix else [edge, align])
        return out, np.concatenate([align, [end]])


@dataclass
class Encoded:
    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    written: str  #: ids in decimal, joined by commas


class PieceCodec:
    """Encodes and decodes with the vocabulary file at ``path``."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        spec = model.normalizer_spec
        if any(p.type == _USER for p in model.pieces):
            raise ValueError("vocabularies with user-defined pieces are not supported")
        self.normalise = Normaliser(read_character_map(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, model.trainer_spec.treat_whitespace_as_suffix)
        pieces = [p for p in model.pieces if p.type == _NORMAL]
        fallback = any(p.type == _BYTE for p in model.pieces)
        crossing = any(MARK in p.piece.lstrip(MARK) for p in pieces)
        whole = model.trainer_spec.model_type != 2 or crossing or not spec.escape_whitespaces
        alone = "" if not fallback or any("\n" in p.piece for p in pieces) else "\n"
        #: Parts that no piece crosses: marks and what follows them; a line end is in no piece.
        self.parts = re.compile(r"(?s).+") if whole else re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+") if alone else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.width = np.array([1 if p.type == _BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.exact = fallback  # no unknown pieces, so a piece is as wide as it is written
        self.cache: SpanCache[tuple[bytes, str]] = SpanCache(self._segment)

    def _segment(self, parts: list[str]) -> list[tuple[bytes, str]]:
        found = self.bare.encode(parts, num_threads=1)
        data = np.fromiter(chain.from_iterable(found), "<i4").tobytes()
        ends = list(accumulate(map(len, found)))
        return [(data[4 * (e - len(ids)):4 * e], ",".join(map(str, ids))) for ids, e in zip(found, ends)]

    def encode(self, texts: Sequence[str | None]) -> Iterator[Encoded]:
        """For each whole text its ids and the span of source bytes of each: none for a missing or empty text."""
        for run in groups([t or "" for t in texts]):
            normal = [self.normalise(t) for t in run]
            if not self.exact:
                for out, align in normal:
                    pieces = self.bare.encode(out, return_type="proto").pieces if out else []
                    yield self._projected(np.array([p.id for p in pieces], np.int32), ",".join(str(p.id) for p in pieces), np.array([len(p.surface.encode()) for p in pieces], np.int64), align)
                continue
            for (out, align), found in zip(normal, self.cache.values([self.parts.findall(out) for out, _ in normal])):
                a, b = zip(*found) if found else ((), ())
                ids = np.frombuffer(b"".join(a), "<i4")
                yield self._projected(ids, ",".join(b), self.width[ids], align)

    @staticmethod
    def _projected(ids: np.ndarray, written: str, widths: np.ndarray, align: np.ndarray) -> Encoded:
        edges = np.concatenate([[0], np.cumsum(widths)])
        spans = align[edges]
        return Encoded(ids, spans[:-1], spans[1:], written) if len(ids) else Encoded(ids, np.zeros(0, np.int64), np.zeros(0, np.int64), "")

    def decode(self, ids: np.ndarray) -> str:
        return self.plain.decode(ids.tolist())


@lru_cache(maxsize=2)
def _codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, begins, ends) for each row of ``docs``: pieces of the whole text, with spans of its UTF-8 bytes.

    A missing text counts as empty; an empty text has no pieces. Repeated rows and missing ids come out as they are.
    Only doc_id and text are read, whatever else the table has. ``path`` is where executors find the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            rows = list(codec.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([r.ids for r in rows], pa.list_(pa.int32())),
                pa.array([r.begins for r in rows], pa.list_(pa.int64())), pa.array([r.ends for r in rows], pa.list_(pa.int64()))],
                ["doc_id", "ids", "begins", "ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode(pieces: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for rows (doc_id, ids); missing ids give a missing text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            texts = [None if ids is None else codec.plain.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of encoding each whole text and decoding it again, in one pass: what ``encode`` and ``decode`` give.

    doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, spans_crc32 (of the begins and ends as 64-bit integers).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            rows = []
            for e in codec.encode(batch.column(1).to_pylist()):
                back = codec.decode(e.ids)
                rows.append((len(e.ids), hashlib.sha256(e.written.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), int(e.ends[-1]) if len(e.ends) else 0, zlib.crc32(np.ascontiguousarray(e.ends), zlib.crc32(np.ascontiguousarray(e.begins)))))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "spans_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint, spans_crc32 bigint")
