"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, ordered by the score of the piece they would make and then by
place; the best pair is merged and its neighbours enter the agenda, until no pair makes a piece. What is left over
becomes pieces, or bytes where a character has none.

No piece has the space mark after another character, a (Latin) letter before what is none, or a line feed in it, so no
merge crosses such a place: a text is cut there and each part is merged once and remembered. Parts that are met for the first time are checked against the
sentencepiece library, batch by batch; a difference is an error. A map without shuffle, with bounded memory.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim_memory, sliced

MARK = "▁"
#: Parts of so many characters keep their agenda in a list. NEVER is the cost of a pair that makes no piece.
SHORT, NEVER = 24, float("inf")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PARTS = re.compile(f"{MARK}*[^{_LETTERS}{MARK}\n]*[{_LETTERS}]+|{MARK}*[^{_LETTERS}{MARK}\n]+|{MARK}+|\n")
_CUT = re.compile(f"[{_LETTERS}](?=[^{_LETTERS}])|[^{MARK}](?={MARK})|\n")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Parts(dict):
    """Parts met of late; a missing one comes from the generation before, or is merged. One beyond `longest` characters isn't kept."""

    longest = 64

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, part: str) -> tuple[bytes, bytes]:
        found = self.codec.older.get(part) or self.codec.learn(part)
        if len(part) <= self.longest:
            self[part] = found
        return found


class Codec:
    """Encoder and decoder of one model file.

    Remembers up to twice `most` parts, and those of one batch, as (ids as bytes of decimals, bytes they decode to); as parts
    that are kept are short, that is some 600 bytes a part at most.
    """

    def __init__(self, path: str, most: int = 200_000, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.library, self.library.get_piece_size()
        self.byte_id = [0] * 256
        self.piece_id: dict[str, int] = {}
        self.as_bytes: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.as_bytes[i] = bytes([int(piece[3:5], 16)])
            elif sp.is_unknown(i):
                self.as_bytes[i] = " \u2047 ".encode()
            elif not (sp.is_control(i) or sp.is_unused(i)):
                self.piece_id[piece] = i
                self.as_bytes[i] = piece.replace(MARK, " ").encode()
        if any(map(_CUT.search, self.piece_id)):
            raise ValueError("a piece joins what this codec cuts apart")
        self.bytes_ids = set(self.byte_id)
        self.marked = {i for p, i in self.piece_id.items() if p[0] == MARK}
        self.cost = {p: -sp.get_score(i) for p, i in self.piece_id.items() if len(p) > 1}
        self.most, self.check = most, check
        self.known, self.older = _Parts(self), {}
        self.new: list[tuple[str, list[int]]] = []

    def merge(self, part: str) -> list[int]:
        """Ids of a part, in which spaces are marks already."""
        s = list(part)
        s = self._merge_short(s) if len(s) <= SHORT else self._merge_long(s)
        ids, piece_id = [], self.piece_id
        for x in s:
            if x in piece_id:
                ids.append(piece_id[x])
            else:
                ids.extend(self.byte_id[b] for b in x.encode())
        return ids

    def _merge_short(self, s: list[str]) -> list[str]:
        """The agenda as a list of costs by place: its least is soon found, and the first of equals is the leftmost."""
        get = self.cost.get
        costs = [get(a + b, NEVER) for a, b in zip(s, s[1:])]
        while costs and (least := min(costs)) < NEVER:
            i = costs.index(least)
            s[i] += s.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = get(s[i] + s[i + 1], NEVER)
            if i:
                costs[i - 1] = get(s[i - 1] + s[i], NEVER)
        return s

    def _merge_long(self, s: list[str | None]) -> list[str]:
        """The agenda as a heap, with symbols in a linked list; entries whose symbols have changed are passed over."""
        n, agenda, get = len(s), [], self.cost.get
        for i, pair in enumerate(map(str.__add__, s, s[1:])):
            if (c := get(pair)) is not None:
                agenda.append((c, i, pair))
        heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, pair = heappop(agenda)
            left, j = s[i], after[i]
            if left is None or j >= n or len(left) + len(s[j]) != len(pair):
                continue
            s[i], s[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (c := get(more := pair + s[k])) is not None:
                    heappush(agenda, (c, i, more))
            if (k := before[i]) >= 0 and (c := get(more := s[k] + pair)) is not None:
                heappush(agenda, (c, k, more))
        return [x for x in s if x is not None]

    def learn(self, part: str) -> tuple[bytes, bytes]:
        ids = self.merge(part)
        if self.check:
            self.new.append((part, ids))
        return b"%d" % ids[0] if len(ids) == 1 else ",".join(map(str, ids)).encode(), b"".join([self.as_bytes[i] for i in ids])

    def coded(self, text: str) -> list[tuple[bytes, bytes]]:
        if not text:
            return []
        return list(map(self.known.__getitem__, _PARTS.findall(MARK + text.replace(" ", MARK))))

    def end_batch(self) -> None:
        """Holds new parts against the library; forgets, when there are too many."""
        if self.new:
            told = self.library.encode([(p[1:] if p[0] == MARK else "\n" + p).replace(MARK, " ") if p != MARK else "\n" for p, _ in self.new])
            newline = [self.piece_id[MARK], self.byte_id[10]]
            for (part, ids), want in zip(self.new, told):
                got = newline if part == MARK and ids == newline[:1] else ids if part[0] == MARK else newline + ids
                if got != want:
                    raise ValueError(f"{part!r}: {ids}, but the library has {want}")
            self.new.clear()
        if len(self.known) > self.most:
            self.older, self.known = self.known, _Parts(self)

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids, _ in self.coded(text) for x in ids.split(b",")]

    def decode(self, ids: list[int]) -> str:
        """As the library does: one leading space goes, bytes that aren't UTF-8 become U+FFFD each."""
        out, run = [], b""
        for i in [*ids, -1]:
            if i in self.bytes_ids:
                run += self.as_bytes[i]
                continue
            out += [run.decode("utf-8", "each byte"), self.as_bytes[i].decode() if i >= 0 else ""]
            run = b""
        text = "".join(out)
        return text[1:] if next((i for i in ids if self.as_bytes[i]), -1) in self.marked else text


codecs.register_error("each byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One a process."""
    claim_memory("pieces", _codecs.clear)
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _digests(c: Codec, text: str | None) -> tuple[int, bytes, bytes]:
    parts = c.coded(text or "")
    ids = b",".join([p[0] for p in parts])
    data = b"".join([p[1] for p in parts])
    return (ids.count(b",") + 1 if ids else 0), ids, data[1:]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded (text that the ids give back) for each row of docs (doc_id, text).

    Null text: like empty, no ids. Other columns are not looked at; equal rows give equal rows; no rows, no rows.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in sliced(batches, most_bytes=2 << 20):
            n, ids, data = zip(*(_digests(c, t) for t in batch.column("text").to_pylist()))
            c.end_batch()
            lists = [[int(x) for x in i.split(b",")] if i else [] for i in ids]
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array([d.decode() for d in data], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    plain = docs.select("doc_id", "text")
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() without shipping ids and texts out of the workers."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in sliced(batches, most_bytes=2 << 20):
            n, ids, data = [], [], []
            for text in batch.column("text").to_pylist():
                a, b, d = _digests(c, text)
                n.append(a)
                ids.append(hashlib.sha256(b).hexdigest())
                data.append(hashlib.sha256(d).hexdigest())
            c.end_batch()
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select(F.col("doc_id"), F.col("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
