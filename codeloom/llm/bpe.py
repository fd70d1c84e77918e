"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts longer than a chunk are cut into overlapping chunks that tasks pre-tokenise in parallel, each from its own start. Where
a boundary of the true sequence is also a boundary of the next chunk, both agree from there on, since a match depends only on
what follows its start; the stitch changes over at the first such place. The pieces are then encoded by rank, and decoding
concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import shipped, texts

#: Code points of a chunk, and of the overlap that follows it.
CHUNK, OVERLAP = 32_768, 512
#: A pre-token that ends this close to a chunk's end is not sure: fixed alternatives of the pattern, like contractions, look this far at most.
GUARD = 8
#: Pieces whose ids a worker remembers, and code points of the longest one of these.
KNOWN_PIECES, KNOWN_LENGTH = 300_000, 128


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def char_class(holds: Callable[[str], bool]) -> str:
    """The characters of the basic plane for which ``holds``, as ranges of a pattern's character class."""
    out, begin = [], None
    for c in range(0x10001):
        inside = c < 0x10000 and holds(chr(c))
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            out.append(f"\\u{begin:04x}-\\u{c - 1:04x}")
            begin = None
    return "".join(out)


class PreTokeniser:
    """A pattern with Unicode properties, compiled twice: in full, and with plain character classes for texts of the basic plane.

    White space is the Unicode property, as the tokeniser libraries mean it. Both forms give the same matches.
    """

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.plain = None
        if set(re.findall(r"\\(?:[pP]\{\w+\}|.)", pattern)) <= {r"\p{L}", r"\p{N}", r"\s", r"\S"} and r"[\S" not in pattern:
            letter, number, space = (char_class(regex.compile(rf"\p{{{x}}}").match) for x in ("L", "N", "White_Space"))
            inner = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", letter).replace(r"\p{N}", number).replace(r"\s", space), pattern)
            self.plain = re.compile(inner.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))

    def of(self, text: str) -> re.Pattern | regex.Pattern:
        basic = self.plain is not None and (text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text))
        return self.plain if basic else self.full

    def findall(self, text: str) -> list[str]:
        return self.of(text).findall(text)

    def finditer(self, text: str) -> Iterator:
        return self.of(text).finditer(text)


@cache
def pre_tokeniser(pattern: str) -> PreTokeniser:
    return PreTokeniser(pattern)


@cache
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes pieces by the ranks of one vocabulary file; the ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        self.split = pre_tokeniser(pattern)
        ranks = vocabulary(path)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.known: dict[str, bytes] = {}

    def encode(self, pieces: list[str]) -> bytes:
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        known, single, long = self.known, self.core._encode_single_piece, []
        for piece in set(pieces):
            if piece not in known:
                known[piece] = np.array(single(piece), "<u4").tobytes()
                if len(piece) > KNOWN_LENGTH:
                    long.append(piece)
        out = b"".join(map(known.__getitem__, pieces))
        for piece in long:
            del known[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def boundaries(chunk: str, split: PreTokeniser) -> list[int]:
    """The starts of the chunk's pre-tokens, and its end."""
    return [m.start() for m in split.finditer(chunk)] + [len(chunk)]


def stitched(chunks: list[str], starts: list[list[int]], size: int, split: PreTokeniser) -> Iterator[list[str]]:
    """Overlapping chunks (each begins ``size`` after the one before) and their boundaries -> the text's true pre-tokens.

    A pre-token near a chunk's end is not sure, as what follows might lengthen or change it. If the overlap holds no
    common sure boundary, what is left of this chunk is joined to the next one and pre-tokenised anew.
    """
    text, cuts, offset, at = chunks[0], starts[0], 0, 0  # offset: of ``text`` in the whole; at: the first true cut's index
    for k in range(1, len(chunks)):
        begin = k * size
        theirs = starts[k]
        sure = bisect_right(cuts, len(text) - GUARD) - 1  # the last cut that is sure
        i = max(at, bisect_left(cuts, begin - offset))
        j = -1
        while i <= sure:
            place = cuts[i] + offset - begin
            j = bisect_left(theirs, place)
            if j < len(theirs) - 1 and theirs[j] == place:
                break
            i, j = i + 1, -1
        if j >= 0:
            yield [text[a:b] for a, b in zip(cuts[at:i], cuts[at + 1 : i + 1])]
            text, cuts, offset, at = chunks[k], theirs, begin, j
        else:
            upto = max(at, sure)
            yield [text[a:b] for a, b in zip(cuts[at:upto], cuts[at + 1 : upto + 1])]
            offset, text = offset + cuts[upto], text[cuts[upto] :] + chunks[k][len(text) + offset - begin :]
            cuts, at = boundaries(text, split), 0
    yield [text[a:b] for a, b in zip(cuts[at:], cuts[at + 1 :])]


def _outcome(codec_: Codec, parts: Iterator[list[str]]) -> tuple[int, str, str, bytes]:
    ids, decoded, n, last = hashlib.sha256(), hashlib.sha256(), 0, b""
    for pieces in parts:
        last = codec_.encode(pieces)
        n += len(last) // 4
        ids.update(last)
        decoded.update(codec_.decode(last))
    return n, ids.hexdigest(), decoded.hexdigest(), last


RESULT = ["n_tokens", "ids_sha256", "decoded_sha256"]


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids: array<int>]), one row per input row.

    ``path``: a rank file on every executor. Null text counts as empty: no token, the hashes of nothing. Repeated rows and rows
    without doc_id are encoded one by one; further columns are ignored. Only texts over ``chunk`` code points are shuffled.
    """
    path, pattern = path or vocabulary_path(), pattern or default_pattern()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = docs.select("doc_id", "text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out: list[tuple] = []
            for text in texts(batch.column(1)):
                n, ids, decoded, raw = _outcome(own, iter([own.split.findall(text)]))
                out.append((n, ids, decoded, np.frombuffer(raw, "<u4").tolist()) if with_ids else (n, ids, decoded))
            columns = list(zip(*out)) or [()] * (3 + with_ids)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *RESULT, *["ids"] * with_ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(texts(batch.column(2))):
                n = -(-len(text) // chunk)
                for first in range(0, n, 256):
                    part = range(first, min(n, first + 256))
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(part), batch.column(0).type), pa.array([batch.column(1)[k].as_py()] * len(part), pa.int64()), pa.array(part, pa.int32()), pa.array([text[i * chunk : (i + 1) * chunk + overlap] for i in part])], names=["doc_id", "row", "part", "chunk"])

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokeniser(pattern)
        for batch in batches:
            starts = [np.array(boundaries(x, split), "<i4").tobytes() for x in texts(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.binary())], names=["doc_id", "row", "part", "chunk", "starts"])

    def stitch(group: pd.DataFrame) -> pd.DataFrame:
        own, group = codec(path, pattern), group.sort_values("part")
        if with_ids:
            pieces = [[p for part in stitched(list(group["chunk"]), [np.frombuffer(x, "<i4").tolist() for x in group["starts"]], chunk, own.split) for p in part]]
        else:
            pieces = stitched(list(group["chunk"]), [np.frombuffer(x, "<i4").tolist() for x in group["starts"]], chunk, own.split)
        n, ids, decoded, raw = _outcome(own, iter(pieces))
        out = {"doc_id": group["doc_id"].iloc[:1], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}
        frame = pd.DataFrame(out)
        if with_ids:
            frame["ids"] = [np.frombuffer(raw, "<u4").astype("i4")]
        return frame

    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    whole = shipped(rows).where(~is_long).mapInArrow(short, schema)
    numbered = rows.where(is_long).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    parts = shipped(numbered).mapInArrow(cut, f"doc_id {kind}, row long, part int, chunk string").repartition("row", "part")
    marked = parts.mapInArrow(pre_tokenise, f"doc_id {kind}, row long, part int, chunk string, starts binary")
    return whole.unionByName(marked.groupBy("row").applyInPandas(stitch, schema))


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns, by the ranks of the public vocabulary."""
    return encode_texts(docs)
