"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Merging byte pairs by rank gives every byte string one encoding, and every
prefix of an encoding is the encoding of a prefix of the string.  So a prefix
has one valid last token: the token ``t`` that ends there and that stays apart
from the last token of the prefix before it when both are merged alone.  One
integer per byte therefore holds the encodings of all prefixes; the ids are
read off backwards.  An automaton lists the tokens that end at a byte.

A piece is one match of the split pattern; pieces are encoded separately.
``TextEncoding`` keeps the prefix tables of a text: appending continues the last
pieces' tables, and an edit splits and encodes again only from shortly before
the edit to the first piece boundary behind it that was one before.
"""

from __future__ import annotations

import base64
import bisect
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
KNOWN_PIECES, KNOWN_LENGTH = 1 << 19, 32  # encodings of short pieces that a worker remembers
KNOWN_PAIRS = 1 << 19  # pairs of tokens for which it remembers whether they are merged
STREAMED = 1 << 20  # characters from which a text's pieces are not listed all at once


class Vocabulary:
    """Ranks of byte strings, the pattern that splits texts, and what encoding needs of both."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
        self.endings.make_automaton()
        self.history = lru_cache(len(ranks))(self._history)
        self._known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}  # what is known of ``stays``

    def _history(self, token: int) -> tuple[list[tuple[int, bytes, bytes]], bool]:
        """How the token's bytes merge alone: (rank of the next merge, first part, last part) of every state.

        Each step merges the pair of lowest rank, leftmost first; the last state's
        rank is past all ranks.  Also whether one part is left: a token that
        merging does not give is met as a whole piece only.
        """
        data, past = self.tokens[token], len(self.ranks)
        parts, states = [data[i:i + 1] for i in range(len(data))], []
        while True:
            found = [self.ranks.get(a + b, past) for a, b in zip(parts, parts[1:])]
            least = min(found, default=past)
            states.append((least, parts[0], parts[-1]))
            if least == past:
                return states, len(parts) == 1
            at = found.index(least)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def continue_table(self, last: list[int], data: str, start: int = 0) -> list[int]:
        """Append the valid last token of every further prefix; ``data`` holds a piece's bytes from ``start`` on as characters."""
        pairs, stays, done = self.pairs, self.stays, len(last)
        for end, (token, length) in self.endings.iter(data):  # by end, longer tokens first
            size = start + end + 1
            if size > done:
                if size > length:
                    pair = last[size - length - 1] << 32 | token
                    valid = pairs.get(pair)
                    if valid is None:
                        valid = stays(pair)
                    if valid:
                        last.append(token)
                        done = size
                elif size == length and self.history(token)[1]:
                    last.append(token)
                    done = size
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The ids of a piece, read off its table from the end."""
        found, lengths, size = [], self.lengths, len(last)
        while size:
            token = last[size - 1]
            found.append(token)
            size -= lengths[token]
        found.reverse()
        return found

    def stays(self, pair: int) -> bool:
        """Whether two tokens that follow one another are not merged across their border.

        Merging both at once takes each one's own steps in their own order, the
        lower rank next, until a pair across the border has the lowest.
        """
        if len(self.pairs) >= KNOWN_PAIRS:
            self.pairs.clear()
        self.pairs[pair] = answer = self._apart(pair >> 32, pair & 0xFFFFFFFF)
        return answer

    def _apart(self, left: int, right: int) -> bool:
        a, (b, whole), past, i, j = self.history(left)[0], self.history(right), len(self.ranks), 0, 0
        if not whole:
            return False
        while True:
            (next_a, _, x), (next_b, y, _) = a[i], b[j]
            across = self.ranks.get(x + y, past)
            if across < next_a and across <= next_b and across < past:
                return False
            if next_a == past == next_b:
                return True
            if next_a <= next_b:  # on equal ranks the left pair
                i += 1
            else:
                j += 1

    def matches(self, text: str) -> Iterator[str]:
        if len(text) < STREAMED:
            return iter(self.split.findall(text))
        return (m.group() for m in self.split.finditer(text))

    def piece_ids(self, piece: str) -> bytes:
        """Ids of one piece, little-endian."""
        data = piece.encode("utf-8", "surrogatepass")
        made = _little([self.ranks[data]] if data in self.ranks else self.walk(self.continue_table([], data.decode("latin-1"))))
        if len(piece) <= KNOWN_LENGTH:
            if len(self._known) >= KNOWN_PIECES:
                self._known.clear()
            self._known[piece] = made
        return made

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        known = self._known
        return b"".join([known.get(piece) or self.piece_ids(piece) for piece in self.matches(text)])

    def decode(self, ids: bytes) -> bytes:
        """Bytes that the ids stand for."""
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def _little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a rank file, once per process."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, public_tokenizers.PATTERN)


class PrefixTable:
    """The valid last token of every prefix of one piece."""

    def __init__(self, vocab: Vocabulary, data: bytes = b""):
        self.vocab, self.data, self.last = vocab, bytearray(), []
        self.extend(data)

    def extend(self, data: bytes) -> None:
        """Append bytes; what is stored of the prefixes before stays as it is."""
        known = len(self.data)
        start = max(0, known - self.vocab.longest + 1)
        self.data += data
        self.vocab.continue_table(self.last, self.data[start:].decode("latin-1") if known else data.decode("latin-1"), start)

    def truncate(self, size: int) -> None:
        """Forget all bytes after the first ``size``."""
        del self.data[size:], self.last[size:]

    def ids(self) -> list[int]:
        """The encoding: a piece that is a token is that token."""
        if bytes(self.data) in self.vocab.ranks:
            return [self.vocab.ranks[bytes(self.data)]]
        return self.vocab.walk(self.last)


class TextEncoding:
    """Encoding of a text that can be appended to and edited; the ids are always those of the whole text."""

    def __init__(self, text: str = "", vocab: Vocabulary | None = None):
        self.vocab = vocab or vocabulary()
        self.text, self.starts, self.tables = "", [], []
        self.encoded_bytes = 0  # bytes that the tables were extended by so far
        self.append(text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> None:
        """Put ``text`` in the place of the characters from ``start`` to ``end``.

        A match looks at two characters behind it at most, and at three from
        its start on, so the pieces for which all of these lie before the edit
        stay.  Matching depends on nothing before a piece, so the rest stays
        from the first new boundary on that was a boundary behind the edit.
        """
        old_text, shift = self.text, len(text) - (end - start)
        self.text = old_text[:start] + text + old_text[end:]
        ends = self.starts[1:] + [len(old_text)] if self.starts else []
        first = bisect.bisect_right(self.starts, start)
        while first and max(ends[first - 1] + 2, self.starts[first - 1] + 3) > start:
            first -= 1
        at = self.starts[first] if first < len(self.starts) else len(old_text)
        at = min(at, start)
        starts, tables = [], []
        until = len(self.starts)
        while at < len(self.text):
            if at - shift >= end:
                same = bisect.bisect_left(self.starts, at - shift)
                if same < len(self.starts) and self.starts[same] == at - shift:
                    until = same
                    break
            piece = self.vocab.split.match(self.text, at).group()
            starts.append(at)
            tables.append(self._table(piece.encode("utf-8", "surrogatepass"), self._at(at)))
            at += len(piece)
        behind = range(until, len(self.starts))
        self.starts[first:] = starts + [self.starts[i] + shift for i in behind]
        self.tables[first:] = tables + [self.tables[i] for i in behind]

    def _at(self, start: int) -> PrefixTable | None:
        """The table of the old piece that begins there."""
        found = bisect.bisect_left(self.starts, start)
        return self.tables[found] if found < len(self.starts) and self.starts[found] == start else None

    def _table(self, data: bytes, old: PrefixTable | None) -> PrefixTable:
        """Table of the bytes, continued from the old table's common prefix."""
        made, common = PrefixTable(self.vocab), 0
        if old is not None:
            size = min(len(data), len(old.data))
            common = next((i for i in range(size) if data[i] != old.data[i]), size)
            made.data, made.last = old.data[:common], old.last[:common]
        made.extend(data[common:])
        self.encoded_bytes += len(data) - common
        return made

    def ids(self) -> list[int]:
        return [i for table in self.tables for i in table.ids()]


def _mapped(frame: DataFrame, schema: T.StructType, column: str, made) -> DataFrame:
    """Columns of ``schema`` after the first, made of one column's value row by row; the first is kept."""
    names = schema.names

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [made(value.as_py()) for value in batch.column(column)]
            columns = list(zip(*rows)) or [()] * (len(names) - 1)
            arrays = [pa.array(c, pa.binary() if f.dataType == T.BinaryType() else pa.int64())
                      for c, f in zip(columns, schema.fields[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return frame.mapInArrow(batches, schema)


def encode_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ids are little-endian unsigned 32-bit integers.

    No special tokens: their strings are ordinary text.  Null and empty texts
    have no id.  Texts of any length are encoded whole, in time proportional to
    their bytes.  Repeated rows stay, ids may be null, other columns do not take
    part, an empty table gives an empty result.  No shuffle.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType())])

    def made(value: str | None) -> tuple[int, bytes]:
        ids = vocabulary(name).encode(value or "")
        return len(ids) // 4, ids

    return _mapped(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), schema, "text", made)


def decode_ids(encoded: DataFrame, id_column: str = "doc_id", ids: str = "ids", name: str = VOCABULARY) -> DataFrame:
    """(doc_id, decoded): the bytes that each row's ids stand for.

    Null ids decode to no bytes; an id outside the vocabulary is an error.
    """
    schema = T.StructType([T.StructField("doc_id", encoded.schema[id_column].dataType), T.StructField("decoded", T.BinaryType())])
    return _mapped(encoded.select(F.col(id_column).alias("doc_id"), F.col(ids).alias("ids")), schema, "ids",
                   lambda value: (vocabulary(name).decode(value or b""),))


def encode_and_decode(docs: DataFrame, id_column: str = "doc_id", text: str = "text", name: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the encoding of every row and what it decodes to, in one pass; see ``encode_texts``."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def made(value: str | None) -> tuple[int, bytes, bytes]:
        ids = vocabulary(name).encode(value or "")
        return len(ids) // 4, ids, vocabulary(name).decode(ids)

    return _mapped(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), schema, "text", made)


def encode_revisions(docs: DataFrame, id_column: str = "doc_id", before: str = "before", after: str = "after",
                     name: str = VOCABULARY) -> DataFrame:
    """(doc_id, before_ids, after_ids, encoded_bytes) of rows that hold two versions of a text.

    The second version is the first with one edit, from the first to the last
    character in which they differ; only its neighbourhood is encoded again, and
    ``encoded_bytes`` says how many bytes that took.  Null counts as empty.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("before_ids", T.BinaryType()),
                           T.StructField("after_ids", T.BinaryType()), T.StructField("encoded_bytes", T.LongType())])

    def made(pair: dict) -> tuple[bytes, bytes, int]:
        old, new = pair["before"] or "", pair["after"] or ""
        text = TextEncoding(old, vocabulary(name))
        first, used = _little(text.ids()), text.encoded_bytes
        size = min(len(old), len(new))
        head = next((i for i in range(size) if old[i] != new[i]), size)
        tail = next((i for i in range(size - head) if old[-1 - i] != new[-1 - i]), size - head)
        text.replace(head, len(old) - tail, new[head:len(new) - tail])
        return first, _little(text.ids()), text.encoded_bytes - used

    both = F.struct(F.col(before).alias("before"), F.col(after).alias("after"))
    return _mapped(docs.select(F.col(id_column).alias("doc_id"), both.alias("versions")), schema, "versions", made)
