"""BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortwell.llm.arrow import sliced
from sortwell.session import evenly, map_arrow, table

#: A chunk ends where the rolling hash of the last 32 bytes has this many low zero bits, MIN_CHUNK bytes after its start at least.
CHUNK_BITS = 10
MIN_CHUNK = 256
#: Bytes that the chunks which a task keeps may take, with their ids, in each of two generations; a longer chunk than KEEP_CHUNK is not kept.
KEEP_BYTES, KEEP_CHUNK = 6 << 20, 64 << 10

#: Fixed values of byte-level vocabularies: the pattern of their pre-tokeniser.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where a piece ends and the next one begins, whatever surrounds it: before a single space between characters
#: that are no white space, and between a letter and a mark or line end. Bytes of ASCII, of two, three and four bytes;
#: lead bytes under which there is white space are left out, or the white space is.
_SOLID = rb"[!-~]|[\xc3-\xdf]|[\xe0\xe4-\xef]|\xe3[\x81-\xbf]|[\xf0-\xf4]"
_SPACE = rb" (?:(?<=[!-~] )|(?<=[\xc3-\xdf][\x80-\xbf] )|(?<=[\xe0\xe4-\xef][\x80-\xbf][\x80-\xbf] )|(?<=\xe3[\x81-\xbf][\x80-\xbf] )|(?<=[\xf0-\xf4][\x80-\xbf][\x80-\xbf][\x80-\xbf] ))(?=" + _SOLID + rb")"
_LETTER = [rb"[A-Za-z]", rb"\xe3\x81[\x81-\xbf]", rb"[\xe5-\xe9\xeb\xec][\x80-\xbf][\x80-\xbf]"]
_after = lambda mark: b"(?:" + b"|".join(b"(?<=" + x + mark + b")" for x in _LETTER) + b")"
SURE = re.compile(_SPACE + rb"|[,.;:\n]" + _after(rb"[,.;:\n]") + rb"|\xe3\x80[\x81\x82]" + _after(rb"\xe3\x80[\x81\x82]") + rb"|\xef\xbc[\x8c\x9a\x9b]" + _after(rb"\xef\xbc[\x8c\x9a\x9b]"))

_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data``; never inside a UTF-8 character."""
    if len(data) <= 2 * MIN_CHUNK:
        return [len(data)]
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for width in (1, 2, 4, 8, 16):  # the hash of 2w bytes from two hashes of w bytes
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    low = np.uint32((1 << CHUNK_BITS) - 1)
    # bits above the window's age hold the whole window
    ends = np.flatnonzero(((h[:-1] >> np.uint32(31 - CHUNK_BITS)) & low == 0) & ((raw[1:] & 0xC0) != 0x80)) + 1
    out, last = [], 0
    for end in ends.tolist():
        if end - last >= MIN_CHUNK:
            out.append(end)
            last = end
    if not out or len(data) - last < MIN_CHUNK:
        out = out[:-1]
    return [*out, len(data)]


def _sure(data: bytes, start: int = 0, end: int | None = None) -> Iterator[int]:
    """Sure boundaries from ``start`` on and before ``end``."""
    found = SURE.finditer(data, start) if end is None else SURE.finditer(data, start, end + 3)  # what follows a boundary takes three bytes at most
    return (m.start() for m in found if end is None or m.start() < end)


def _sure_backwards(data: bytes) -> Iterator[int]:
    end = len(data)
    while end > 0:
        start = max(0, end - MIN_CHUNK)
        yield from reversed(list(_sure(data, start, end)))
        end = start


class ChunkCoder:
    """Encodes texts of one byte-level BPE vocabulary by chunks; decodes ids.

    Every distinct chunk is encoded once and kept (bounded in bytes, two generations). At a
    join, the text from the last sure piece boundary of the left chunk to the first
    one of the right chunk is encoded anew and replaces the tokens on both sides
    that the chunks have there. How many tokens those are comes from encoding each
    side's end alone: it has to agree with the chunk's own tokens, else the next
    boundary further in is tried, and a chunk in which none agrees is encoded
    together with its neighbours.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or (spec.get("post_processor") or {}).get("type", "ByteLevel") != "ByteLevel":
            raise ValueError("a byte-level BPE tokenizer without normaliser is needed")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; the others follow from 256 on
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or match whole words are not supported")
        ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        made = [ranks[bytes(shown[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if made != sorted(made):
            raise ValueError("ids have to follow the order of merges")
        self.coding = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.splitter = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.seen = self.reused = self.held = 0

    def _encode(self, data: bytes) -> np.ndarray:
        return self.coding.encode_to_numpy(data.decode(), disallowed_special=())

    def _chunk(self, data: bytes) -> tuple:
        """(ids, head bytes, head tokens, tail bytes, tail tokens); head bytes is None where no boundary agrees."""
        self.seen += 1
        got = self.young.get(data)
        if got is None:
            got = self.old.get(data)
            if got is not None:
                self.reused += 1
            else:
                ids, got = self._encode(data), None
                head = next(((at, len(x)) for at in _sure(data) for x in (self._encode(data[:at]),) if np.array_equal(ids[: len(x)], x)), None)
                tail = next(((at, len(x)) for at in _sure_backwards(data) for x in (self._encode(data[at:]),) if np.array_equal(ids[len(ids) - len(x) :], x)), None)
                got = (ids, None, 0, 0, 0) if head is None or tail is None else (ids, *head, len(data) - tail[0], tail[1])
            if len(data) <= KEEP_CHUNK:
                took = len(data) + got[0].nbytes + 400  # and what Python adds to them
                if self.held + took > KEEP_BYTES:
                    self.old, self.young, self.held = self.young, {}, 0
                self.young[data] = got
                self.held += took
        else:
            self.reused += 1
        return got

    def _plain(self, data: bytes) -> list[np.ndarray]:
        ends = cuts(data)
        if len(ends) == 1:
            return [self._chunk(data)[0]]
        out, start, open_ = [], 0, []  # open_: text at the last join that isn't encoded yet
        for i, end in enumerate(ends):
            part = data[start:end]
            ids, head, n_head, tail, n_tail = self._chunk(part)
            first, last, start = i == 0, i == len(ends) - 1, end
            if head is None:
                open_.append(part)
                continue
            if first:
                lead = 0
            else:
                out.append(self._encode(b"".join([*open_, part[:head]])))
                lead = n_head
            out.append(ids[lead:] if last else ids[lead : len(ids) - n_tail])
            open_ = [] if last else [part[len(part) - tail :]]
        if open_:
            out.append(self._encode(b"".join(open_)))
        return out

    def encode(self, text: str) -> np.ndarray:
        out, at = [], 0
        if self.splitter is not None:
            for m in self.splitter.finditer(text):
                if m.start() > at:
                    out += self._plain(text[at : m.start()].encode())
                out.append(np.array([self.special[m[0]]], np.uint32))
                at = m.end()
        if at < len(text):
            out += self._plain(text[at:].encode())
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.coding.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def coder(path: str) -> ChunkCoder:
    return ChunkCoder(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col, ids array<int>, decoded string``.

    ``ids`` are those of the tokenizer file at ``path`` (on every executor) without
    added special tokens; strings of its special tokens in a text become their ids.
    ``decoded`` is the text of the ids, special tokens included. Null and empty texts
    have no ids and decode to the empty string. Rows are independent: nothing is
    shuffled, repeated rows give repeated results, other columns are not read, and a
    text is handled whole however long. Chunks are reused within a task, in bounded
    memory, so a lost task is recomputed from its own input alone.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in sliced(batches):
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            decoded = [c.decode(x) for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {id_type}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(evenly(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json")))
