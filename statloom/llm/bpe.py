"""Byte-level BPE by prefix dynamic programming, with exact appends and re-encoding near edits.

Every prefix of a piece has one valid encoding, and that encoding ends in one token. The table of
these last tokens is all the state there is: the last token at byte ``i`` is the token ``t`` ending
at ``i`` for which the last token before ``t`` and ``t`` stay apart when merged by rank. Reading the
table from the end gives the tokens. An append extends the table; an edit recomputes it from the
changed byte until it agrees with the old one over a span as long as the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from statloom.llm.text import small_batches

ID = "i"  # ids are packed as C integers
SCHEMA = "n_tokens long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class PrefixVocabulary:
    """Tokens with what the table needs: which of them end in given bytes, and the merge that makes each."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        by_ending: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                by_ending.setdefault(token[-3:], {1, 2}).add(len(token))
        self.lengths_by_ending = {end: tuple(sorted(found, reverse=True)) for end, found in by_ending.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[int, bool] = {}  # by left * 2^32 + right

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if it is one byte or no merge makes it."""
        if rank not in self._halves:
            token = self.bytes_of[rank]
            parts = merge_all(token, self.ranks, below=rank) if len(token) > 1 else [token]
            self._halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[rank]

    def reachable(self, rank: int) -> bool:
        return len(self.bytes_of[rank]) == 1 or self.halves(rank) is not None

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= 250_000:
                self._apart.clear()
            known = self._apart[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        """Undo the merges of both sides, latest first: no merge across the border may come earlier."""
        bytes_of, ranks = self.bytes_of, self.ranks
        undone: float = float("inf")
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < undone and self.halves(across) == (left, right):
                return False
            left_halves, right_halves = self.halves(left), self.halves(right)
            # among equal ranks the left one merges first, so the right one is undone first
            if left_halves and (left > right or not right_halves):
                undone, left = left, left_halves[1]
            elif right_halves:
                undone, right = right + 1, right_halves[0]
            else:
                return True


def merge_all(data: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """Merge adjacent parts, lowest rank first and leftmost among equals; only for token-sized input."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (below is None or rank < below) and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def extend_table(vocabulary: PrefixVocabulary, data: bytes, offset: int, last: list[int], end: int) -> None:
    """Add the entries up to ``end``; data[0] is byte ``offset`` of the piece, at least a longest token back."""
    get, pairs, endings = vocabulary.ranks.get, vocabulary._apart.get, vocabulary.lengths_by_ending.get
    for at in range(len(last), end + 1):
        here = at - offset
        for length in endings(data[here - 3 : here], (2, 1)) if here > 2 else (2, 1):
            if length > at:
                continue
            token = get(data[here - length : here])
            if token is None:
                continue
            if length == at:
                if vocabulary.reachable(token):
                    last.append(token)
                    break
                continue
            stays = pairs(last[at - length] << 32 | token)
            if stays is None:
                stays = vocabulary.reachable(token) and vocabulary.apart(last[at - length], token)
            if stays:
                last.append(token)
                break
        else:
            raise ValueError(f"no token ends at byte {at}")


class PrefixEncoder:
    """The last-token table of one growing piece of text."""

    def __init__(self, vocabulary: PrefixVocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = [-1]  # last[i]: last token of the encoding of the first i bytes
        self.append(data)

    def _extend(self, end: int) -> None:
        offset = max(0, len(self.last) - 1 - self.vocabulary.longest - 3)
        extend_table(self.vocabulary, bytes(self.data[offset:end]), offset, self.last, end)

    def append(self, data: bytes) -> None:
        self.data += data
        self._extend(len(self.data))

    def edit(self, start: int, end: int, replacement: bytes) -> int:
        """Replace bytes start..end; returns how many table entries were computed anew."""
        old_last, shift = self.last, len(replacement) - (end - start)
        self.data[start:end] = replacement
        self.last = old_last[: start + 1]
        changed_to, computed, same = start + len(replacement), 0, 0
        while len(self.last) <= len(self.data):
            at = len(self.last)
            self._extend(at)
            computed += 1
            before = at - shift
            same = same + 1 if at > changed_to and old_last[before] == self.last[at] else 0
            if same >= self.vocabulary.longest:  # entries that agree over a longest token fix all that follow
                self.last.extend(old_last[before + 1 :])
                break
        return computed

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.bytes_of[token])
        return out[::-1]


# Below this code point a character set written out serves the standard matcher, which is much faster.
LATIN_END = 0x250


def latin_pattern(pattern: str) -> str:
    """The pattern for texts of characters below LATIN_END, with \\p{L}, \\p{N} and \\s written out."""
    sets = {"p{L}": "", "p{N}": "", "s": ""}
    for code in range(LATIN_END):
        kind, char = unicodedata.category(chr(code)), f"\\u{code:04x}"
        sets["p{L}"] += char * (kind[0] == "L")
        sets["p{N}"] += char * (kind[0] == "N")
        sets["s"] += char * (kind[0] == "Z" or code in (9, 10, 11, 12, 13, 0x85))
    out, inside, i = "", False, 0
    while i < len(pattern):
        name = next((n for n in sets if pattern.startswith("\\" + n, i)), None)
        if name:
            out += sets[name] if inside else f"[{sets[name]}]"
            i += 1 + len(name)
        elif pattern.startswith("\\S", i) and not inside:
            out += f"[^{sets['s']}]"
            i += 2
        else:
            step = 2 if pattern[i] == "\\" else 1
            inside = (inside or pattern[i] == "[") and pattern[i] != "]"
            out += pattern[i : i + step]
            i += step
    return out


class Codec:
    """Encodes texts piece by piece; pieces and their beginnings recur, so short ones are remembered.

    A worker process keeps its codec while later jobs run in it, so what is remembered stays small: ids are
    packed, and of pieces and beginnings there are two halves. When the newer half is full it becomes the
    older one, whose entries are forgotten unless they are met again.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 200_000):
        self.vocabulary = PrefixVocabulary(ranks)
        self.pieces = regex.compile(pattern).findall
        self.latin_pieces = re.compile(latin_pattern(pattern)).findall
        self.beyond_latin = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]").search
        self.half = max(1, remembered // 2)
        self.known: dict[str, bytes] = {}  # ids of a piece, packed
        self.known_before: dict[str, bytes] = {}
        self.last_of: dict[bytes, int] = {}  # last token of each beginning of a piece met so far
        self.last_of_before: dict[bytes, int] = {}
        self.packed = {rank: array(ID, [rank]).tobytes() for rank in ranks.values()}  # of pieces that are tokens
        self.written = {rank: str(rank) for rank in ranks.values()}

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one piece; a piece that is a token stays whole."""
        rank = self.vocabulary.ranks.get(piece)
        if rank is not None:
            return [rank]
        if len(piece) > 64:
            return PrefixEncoder(self.vocabulary, piece).tokens()
        if len(self.last_of) >= self.half:
            self.last_of_before, self.last_of = self.last_of, {}
        last, newer, older = [-1], self.last_of, self.last_of_before
        for end in range(1, len(piece)):
            token = newer.get(piece[:end])
            if token is None:
                token = older.get(piece[:end])
                if token is None:
                    break
                newer[piece[:end]] = token
            last.append(token)
        fresh = len(last)
        extend_table(self.vocabulary, piece, 0, last, len(piece))
        for end in range(fresh, len(piece)):
            newer[piece[:end]] = last[end]
        out, at, bytes_of = [], len(piece), self.vocabulary.bytes_of
        while at:
            out.append(last[at])
            at -= len(bytes_of[last[at]])
        return out[::-1]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))

    def _encode_new(self, piece: str) -> bytes:
        entry = self.known.get(piece) or self.known_before.get(piece)
        if entry is None:
            ids = self.encode_piece(piece.encode())
            entry = self.packed[ids[0]] if len(ids) == 1 else array(ID, ids).tobytes()
        if len(piece) <= 64:
            if len(self.known) >= self.half:
                self.known_before, self.known = self.known, {}
            self.known[piece] = entry
        return entry

    def _encode_pieces(self, text: str) -> list[bytes]:
        known, new = self.known.get, self._encode_new
        split = self.pieces if self.beyond_latin(text) else self.latin_pieces
        return [known(p) or new(p) for p in split(text)]

    def encode_ids(self, text: str) -> list[int]:
        """The ids of the text."""
        return array(ID, b"".join(self._encode_pieces(text))).tolist()

    def joined(self, ids: Sequence[int]) -> str:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.written.__getitem__, ids))

    def encode(self, text: str) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids joined by commas, decoded bytes) of each piece of the text."""
        each = [array(ID, entry) for entry in self._encode_pieces(text)]
        return [(len(ids), self.joined(ids), self.decode(ids)) for ids in each]


_CODECS: dict[tuple[str, str], Codec] = {}


def shared_codec(ranks: dict[bytes, int], key: str, pattern: str) -> Codec:
    """One codec a worker process: what it remembers serves every task that the process runs."""
    if (key, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[key, pattern] = Codec(ranks, pattern)
    return _CODECS[key, pattern]


def encode_texts(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep_ids: bool = True,
    keep_others: bool = False,
) -> DataFrame:
    """Encode and decode every text; one row per input row.

    The rank file is read once on the driver and its bytes, bounded by the vocabulary, travel with the
    tasks. Columns: the id (or, with ``keep_others``, all input columns, before which columns of the
    same names as the new ones give way), n_tokens, ids (null without ``keep_ids``), ids_sha256,
    decoded, decoded_sha256. Null and empty texts have no tokens and an empty decoding; repeated rows,
    null ids and other columns do no harm. ``decoded`` is null without ``keep_ids``.
    """
    ranks = read_ranks(ranks_path)
    with open(ranks_path, "rb") as file:
        key = hashlib.sha256(file.read()).hexdigest()
    fresh = [f.split()[0] for f in SCHEMA.split(", ")]
    kept = [c for c in docs.columns if c not in fresh] if keep_others else [id_column]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared_codec(ranks, key, pattern)
        for batch in small_batches(batches, 128):
            counts, ids, id_hashes, texts, text_hashes = [], [], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = codec.encode_ids(text or "")
                joined = codec.joined(found)
                decoded = codec.decode(found)
                counts.append(len(found))
                ids.append(np.array(found, np.int32) if keep_ids else None)
                id_hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(decoded.decode("utf-8", "replace") if keep_ids else None)
                text_hashes.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(counts, pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(id_hashes, pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array(text_hashes, pa.string()),
                ],
                names=[*kept, *fresh],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    source = docs.select(*[f"`{c}`" for c in kept], docs[text_column].alias("__text"))
    return source.mapInArrow(encode, ", ".join(filter(None, [schema, SCHEMA])))
