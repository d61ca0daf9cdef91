"""Operator 13, byte-level BPE: a lazily determinised transducer encodes, a UTF-8 state machine decodes.

The tokens of a prefix of a piece are known once the last of them is: it is the one suffix token
that fits behind the tokens of what it leaves over, and two tokens fit if the merges of their bytes
give them back. So a machine that reads bytes only has to know, of each earlier boundary that a
token of the vocabulary could still reach over, the last token before it. That and the longest
suffix read that begins some token are its state. States and their steps are made when a text first
needs them and forgotten all at once when there are too many. A token leaves once all boundaries in
reach have it behind them: that is as many bytes behind as the longest token has, and a fixed
number more, whatever the length of the piece.

Decoding maps ids to bytes, and bytes to characters by a state machine for UTF-8 that may stop after
any byte. Whole tokens are steps of it, so only tokens that end inside a character are walked.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.words import slices

#: States, and pieces of text with their ids, that a worker keeps before it forgets them.
MAX_STATES, MAX_PIECES = 1 << 18, 1 << 20
#: Bytes of a piece whose ids are kept.
KEPT_BYTES = 48

_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_chars_decoded", T.LongType()), T.StructField("valid_utf8", T.BooleanType())])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by the bytes of a token, of a file with a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Ids of pieces by the ranks of a vocabulary that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary must hold all 256 bytes")
        if max(map(len, ranks)) > 255:
            raise ValueError("tokens of at most 255 bytes")
        self.ranks, self.max_states = ranks, max_states
        self.ahead = 4 * max(map(len, ranks)) + 64  # bytes that are held at most
        self.begins = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.edges: dict[tuple[bytes, bool], list[bytes] | None] = {}
        self._forget()

    def _forget(self) -> None:
        # a state: (longest suffix that begins a token, ((bytes since a boundary, last token before it), ...))
        self.start = (b"", ((0, None),))
        self.number: dict[tuple, int] = {self.start: 0}
        self.states: list[tuple] = [self.start]
        #: by state << 8 | byte: next state << 8 | bytes of the last token
        self.steps: dict[int, int] = {}
        self.fits.clear()

    def merged(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The merges themselves, lowest rank and then leftmost first, of a few bytes; they stop at ``least`` parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: bytes, right: bool) -> list[bytes] | None:
        """What holds the last (first) byte of a token while it is merged, in order; None if no merges make it."""
        key = (token, right)
        if key not in self.edges:
            if len(token) == 1:
                self.edges[key] = [token]
            else:
                halves = self.merged(token, 2)
                inner = self._edge(halves[right], right) if len(halves) == 2 else None
                self.edges[key] = None if inner is None else [*inner, token]
        return self.edges[key]

    def _follows(self, left: bytes | None, token: bytes) -> bool:
        """Whether merges make ``token``, and leave it apart from ``left`` before it."""
        if left is None:
            return self._edge(token, False) is not None
        pair = (left, token)
        if pair not in self.fits:
            self.fits[pair] = self._apart(left, token)
        return self.fits[pair]

    def _apart(self, left: bytes, right: bytes) -> bool:
        """Whether the merges of both leave the bytes between them unmerged, in order of ranks.

        Only what holds the last byte of the left one and the first of the right one can merge
        over the border: at any time those two, before either grows.
        """
        a, b = self._edge(left, True), self._edge(right, False)
        if a is None or b is None:
            return False
        grow_a, grow_b = ([self.ranks[t] for t in x[1:]] for x in (a, b))
        if grow_a != sorted(grow_a) or grow_b != sorted(grow_b):  # a part that ranks after its whole: no order of time
            return self.merged(left + right) == [left, right]
        i = j = 0
        never = 1 << 62
        while True:
            own, other = grow_a[i] if i < len(grow_a) else never, grow_b[j] if j < len(grow_b) else never
            over = self.ranks.get(a[i] + b[j], never)
            if over < own and over <= other and over < never:  # of equal ranks the leftmost merges first
                return False
            if own == other == never:
                return True
            if own <= other:
                i += 1
            else:
                j += 1

    def _step(self, state: int, byte: int) -> int:
        """Next state << 8 | bytes of the last token, after one more byte; made once a state and byte."""
        suffix, behind = self.states[state]
        suffix += bytes([byte])
        while suffix not in self.begins:
            suffix = suffix[1:]
        back = {age + 1: last for age, last in behind}
        for n in range(1, len(suffix) + 1):
            token = suffix[len(suffix) - n :]
            if n in back and token in self.ranks and self._follows(back[n], token):
                break
        else:
            raise AssertionError("each prefix has tokens, as all bytes have")
        key = (suffix, ((0, token), *((age, last) for age, last in back.items() if age <= len(suffix) and suffix[len(suffix) - age :] in self.begins)))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        self.steps[state << 8 | byte] = step = self.number[key] << 8 | n
        return step

    def _kept(self, state: int) -> int:
        """The number of ``state`` after too many states were forgotten, but for this one."""
        key = self.states[state]
        self._forget()
        if key != self.start:
            self.number[key] = 1
            self.states.append(key)
        return self.number[key]

    def stream(self, piece: Iterable[int]) -> Iterator[int]:
        """Ids of the bytes of one piece; few bytes are held, and those not much longer than a token."""
        state, held, sizes = 0, bytearray(), [0]  # the bytes that have not left, and the last token's size at each
        for byte in piece:
            if len(self.states) > self.max_states:
                state = self._kept(state)
            step = self.steps.get(state << 8 | byte) or self._step(state, byte)
            state = step >> 8
            held.append(byte)
            sizes.append(step & 255)
            if len(held) >= self.ahead:
                done = self._settled(sizes, self.states[state][1])
                yield from self._ids(held, sizes, done)
                del held[:done], sizes[:done]
        yield from self._ids(held, sizes, len(held))

    @staticmethod
    def _settled(sizes: list[int], behind: tuple) -> int:
        """The last boundary that the tokens up to all boundaries in reach share."""
        at = [len(sizes) - 1 - age for age, _ in behind]
        while len(set(at)) > 1:
            k = max(range(len(at)), key=at.__getitem__)
            at[k] -= sizes[at[k]]
        return at[0]

    def _ids(self, held: bytes | bytearray, sizes: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(self.ranks[bytes(held[end - sizes[end] : end])])
            end -= sizes[end]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a piece; one that is a token is that token, even if no merges lead there."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > self.ahead:
            return list(self.stream(piece))
        if len(self.states) > self.max_states:
            self._forget()
        step, sizes, known = 0, [0], self.steps.get
        for byte in piece:
            at = (step >> 8) << 8 | byte
            step = known(at) or self._step(at >> 8, byte)
            sizes.append(step & 255)
        return self._ids(piece, sizes, len(piece))


#: Bytes that may follow, by the state of a character that has begun: 0 between characters, 1 to 3 bytes
#: to come, 4 to 7 the same after a first byte that narrows the second, 8 once bytes can't be UTF-8.
_NARROW = {0xE0: (4, 0xA0, 0xBF), 0xED: (5, 0x80, 0x9F), 0xF0: (6, 0x90, 0xBF), 0xF4: (7, 0x80, 0x8F)}
_AFTER = {4: 1, 5: 1, 6: 2, 7: 2}
BAD = 8


@lru_cache(maxsize=1)
def utf8_steps() -> np.ndarray:
    """Next state by state and byte (9 x 256), from the ranges of well-formed UTF-8."""
    t = np.full((9, 256), BAD, np.uint8)
    t[0, :0x80], t[0, 0xC2:0xE0], t[0, 0xE1:0xF0], t[0, 0xF1:0xF4] = 0, 1, 2, 3
    for first, (state, lo, hi) in _NARROW.items():
        t[0, first] = state
        t[state, lo : hi + 1] = _AFTER[state]
    for left in (1, 2, 3):
        t[left, 0x80:0xC0] = left - 1
    return t


class StreamDecoder:
    """Text of ids as they come: characters leave once they are complete, what is no UTF-8 as U+FFFD."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens, self.state, self.open = tokens, 0, b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.open + b"".join(self.tokens[i] for i in ids)
        steps, state, done = utf8_steps(), self.state, 0
        out: list[str] = []
        for k in range(len(self.open), len(data)):
            new = int(steps[state, data[k]])
            if new == BAD and state:  # what was open can't go on: it is replaced, this byte starts anew
                out += [data[done : self._start(data, done, k)].decode(), "�"]
                done, new = k, int(steps[0, data[k]])
            if new == BAD:
                out += [data[done:k].decode(), "�"]
                done, new = k + 1, 0
            state = new
        keep = self._start(data, done, len(data)) if state else len(data)
        out.append(data[done:keep].decode())
        self.state, self.open = state, data[keep:]
        return "".join(out)

    @staticmethod
    def _start(data: bytes, done: int, k: int) -> int:
        """Where the character that is open before ``k`` begins."""
        k -= 1
        while k > done and 0x80 <= data[k] < 0xC0:
            k -= 1
        return k

    def finish(self) -> str:
        """What is left when no more ids come."""
        rest, self.state, self.open = self.open, 0, b""
        return "�" if rest else ""


class TokenSteps:
    """What each token does to the UTF-8 machine: the state it leads to from each state, and its characters."""

    def __init__(self, tokens: list[bytes]) -> None:
        steps = utf8_steps()
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.to = np.tile(np.arange(9, dtype=np.uint8), (len(tokens), 1))
        for k in range(int(size.max())):
            on = np.flatnonzero(size > k)
            self.to[on] = steps[self.to[on], flat[at[on] + k][:, None]]
        starts = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])  # bytes that begin a character
        self.chars = starts[at[1:]] - starts[at[:-1]]

    def run(self, ids: np.ndarray) -> tuple[int, bool]:
        """(characters of the decoded bytes, whether they are UTF-8)."""
        moves, i = np.flatnonzero(self.to[ids, 0] != 0), 0  # between characters other tokens stay there
        while i < len(moves):
            k = int(moves[i])
            state = 0
            while True:
                state = int(self.to[ids[k], state])
                k += 1
                if state in (0, BAD) or k == len(ids):
                    break
            if state:
                return int(self.chars[ids].sum()), False
            i = int(np.searchsorted(moves, k))
        return int(self.chars[ids].sum()), True


class _Pieces(dict):
    """Ids of pieces of text, made by the transducer when first asked for."""

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: str) -> list[int]:
        data = piece.encode()
        ids = self.machine.encode(data)
        if len(data) <= KEPT_BYTES:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes texts as their pieces' ids, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(Transducer(ranks))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        self.steps = TokenSteps(self.tokens)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for ids in map(self.pieces.__getitem__, self.split(text)):
            out += ids
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process and vocabulary."""
    return Codec(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int): the tokens of each text; a null text has none.

    ``path``: a file of ranks that every worker can read; ``pattern``: splits a text into pieces, each
    of which is merged alone. What no piece covers has no tokens. Texts are taken whole, whatever
    their length; rows that repeat a doc_id and null ids keep their rows, other columns are ignored.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for lo, hi in slices(b.column(1), 1 << 20):
                ids = [c.encode(t or "") for t in b.column(1)[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(ids, pa.list_(pa.int32()))], schema.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ids (array of int): the streaming decoder, U+FFFD for what is no UTF-8.

    Null ids give an empty text; an id that the vocabulary lacks raises.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = codec(path, "").tokens
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                d = StreamDecoder(tokens)
                texts.append(d.feed(ids or []) + d.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema.names)

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars_decoded, valid_utf8 of each text, encoded and decoded again.

    Digests: of the decimal ids joined by commas, and of the decoded bytes. A null text counts as
    empty; null and repeated ids keep their rows; other columns are ignored; an empty table gives
    no row. A long text is encoded whole, a slice of short ones at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for lo, hi in slices(b.column(1), 1 << 20):
                rows = []
                for text in b.column(1)[lo:hi].to_pylist():
                    ids = c.encode(text or "")
                    chars, valid = c.steps.run(np.asarray(ids, np.int64))
                    rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(c.decode_bytes(ids)).hexdigest(), chars, valid))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *[pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)]], _OUT.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)
