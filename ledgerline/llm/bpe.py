"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by an incremental UTF-8 machine.

The tokens of a piece are the one sequence in which every two neighbours, encoded together, give these two tokens again.
So a nondeterministic transducer can read bytes along the tokens' prefixes and emit a token at its end if it fits behind
the one before. Determinised, a state is the set of paths still open: the tokens that a path has pending, the last one,
and the bytes read of the next. What all paths agree on is emitted, so a token leaves after a lookahead of bounded length.
States and moves are made when a text first needs them and kept up to a bound.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, partial
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import chunks, extended, runs
from .files import filesystem
from .shared import only

#: What cuts a text into pieces that are encoded separately, over characters folded to classes: letters (those of
#: contractions stand for themselves), numbers, white space and the rest. (A fixed value of the vocabulary.)
PIECES = re.compile(rb"'(?:[stmd]|re|ve|ll)| ?[Lstrevmld]+| ?N+| ?[O']+|[ W]+(?![^ W])|[ W]+")
KEPT = b"strevmld '"
#: The same over ASCII as it is.
PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+", re.ASCII)
#: Where a long text may be cut, and after how many characters it is.
CUT, BLOCK = re.compile(rb"[^ W](?=[ W])"), 1 << 19
NEVER = 1 << 62


@dataclass(frozen=True)
class Bpe:
    """The rank file (at the same path on every executor, or in a store that all reach), and what a task keeps of moves
    and of pieces met before."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    max_states: int = 300_000
    max_pieces: int = 200_000
    piece_chars: int = 48


@cache
def _folds() -> np.ndarray:
    """The class of each code point, by the Unicode tables of the tokenizer library: not by those of this language."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    table = np.full(0x110000, ord("O"), np.uint8)
    for pattern, mark in ((r"\p{L}+", "L"), (r"\p{N}+", "N"), (r"\s+", "W")):
        only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for block in range(0, 0x110000, 0x1000):
            if not 0xD800 <= block < 0xE000:
                found = only.encode_ordinary("".join(map(chr, range(block, block + 0x1000))))
                table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), "<u4")] = ord(mark)
    table[list(KEPT)] = list(KEPT)
    return table


def pieces(text: str) -> Iterator[list[str]]:
    """The pieces of a text in order, some at a time; together they are the text. (No piece goes on from anything but
    white space into white space, so a text may be cut there.)"""
    folded = _folds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].tobytes()
    start = 0
    while start < len(folded):
        cut = CUT.search(folded, start + BLOCK)
        stop = cut.end() if cut else len(folded)
        if text.isascii():
            yield PLAIN.findall(text, start, stop)
        else:
            ends = list(accumulate(map(len, PIECES.findall(folded, start, stop)), initial=start))
            yield [text[a:b] for a, b in pairwise(ends)]
        start = stop


class Vocabulary:
    """Ranks by bytes, bytes by rank, and all beginnings of tokens as a tree: children of a node by byte, and the token that
    a node is (-1: none)."""

    def __init__(self, path: str):
        store, inner = filesystem(path)
        with store.open_input_stream(inner) as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for data, rank in self.ranks.items():
            node = 0
            for byte in data:
                below = self.children[node]
                node = below.get(byte, 0)
                if not node:
                    node = below[byte] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
            self.token[node] = rank

        self.histories: dict[int, tuple[list, list]] = {}

    def merged(self, data: bytes) -> Iterator[tuple[int, list[int]]]:
        """The plain rule: while two neighbours are a token together, join those of the lowest rank, the first of equals.
        (rank, where parts begin and end) after each join."""
        cuts = list(range(len(data) + 1))
        pair = [self.ranks.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while pair:
            best = min((r for r in pair if r is not None), default=None)
            if best is None:
                return
            i = pair.index(best)
            del cuts[i + 1], pair[i]
            if i < len(pair):
                pair[i] = self.ranks.get(data[cuts[i] : cuts[i + 2]])
            if i:
                pair[i - 1] = self.ranks.get(data[cuts[i - 1] : cuts[i + 1]])
            yield best, cuts

    def history(self, token: int) -> tuple[list[int], list[tuple[bytes, bytes]]]:
        """How a token's bytes become the token: the rank of each join, the first and the last part before it; the parts
        at the end come last. A token that its bytes do not become has no parts."""
        found = self.histories.get(token)
        if found is None:
            data, ranks = self.tokens[token], []
            parts, cuts = [(data[:1], data[-1:])], []
            for rank, cuts in self.merged(data):
                ranks.append(rank)
                parts.append((data[: cuts[1]], data[cuts[-2] :]))
            whole = len(data) == 1 or len(cuts) == 2
            found = self.histories[token] = ranks, parts if whole else []
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes, one behind the other, become these two: both histories run side by side, and
        at no time is the join over the border the next one."""
        (left_ranks, left_parts), (right_ranks, right_parts) = self.history(left), self.history(right)
        if not left_parts or not right_parts or self.tokens[left] + self.tokens[right] in self.ranks:
            return False
        i = j = 0
        while True:
            over = self.ranks.get(left_parts[i][1] + right_parts[j][0], NEVER)
            next_left = left_ranks[i] if i < len(left_ranks) else NEVER
            next_right = right_ranks[j] if j < len(right_ranks) else NEVER
            if over < next_left and over <= next_right and over < NEVER:
                return False
            if next_left <= next_right:
                if next_left == NEVER:
                    return True
                i += 1
            else:
                j += 1


class Transducer:
    """Moves by state and byte, made when first asked for. A path is the node of the next token and the tokens pending; where
    none are, -2 less the last token emitted (-1 at the beginning)."""

    START = ((0, -1),)

    def __init__(self, vocabulary: Vocabulary, max_states: int):
        self.v, self.max_states = vocabulary, max_states
        self.fitting: dict[int, bool] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, tuple]]] = []
        self._forget()

    def _forget(self) -> None:
        for kept in (self.ids, self.states, self.moves):
            kept.clear()
        self._state(self.START)

    def _state(self, paths: tuple) -> int:
        found = self.ids.get(paths)
        if found is None:
            found = self.ids[paths] = len(self.states)
            self.states.append(paths)
            self.moves.append({})
        return found

    def fits(self, last: int, token: int) -> bool:
        """Whether both tokens, one behind the other, are encoded as themselves (last -1: a token at the beginning)."""
        key = (last + 1) << 32 | token
        found = self.fitting.get(key)
        if found is None:
            if len(self.fitting) > 2 * self.max_states:
                self.fitting.clear()
            found = self.fitting[key] = self.v.apart(last, token) if last >= 0 else bool(self.v.history(token)[1])
        return found

    def _move(self, state: int, byte: int) -> tuple[int, tuple]:
        paths, ended, children, tokens = [], None, self.v.children, self.v.token
        for path in self.states[state]:
            node = children[path[0]].get(byte)
            if node is None:
                continue
            if ended is None:
                token = tokens[node]
                if token >= 0:
                    last = path[-1]
                    if self.fits(last if last >= 0 else -2 - last, token):
                        ended = (0, token) if last < 0 else (0, *path[1:], token)
            if children[node]:
                paths.append((node, *path[1:]))
        paths.append(ended)
        shared, out = 1, ()
        if all(path[1] >= 0 for path in paths):
            for column in zip(*[path[1:] for path in paths]):
                if column.count(column[0]) < len(column):
                    break
                shared += 1
            out = ended[1:shared]
            if out:
                paths = [(path[0], *(path[shared:] or (-2 - out[-1],))) for path in paths]
        after = tuple(paths)
        to = self.ids.get(after)
        if to is None:
            if len(self.states) >= self.max_states:
                self._forget()
                return self._state(after), out
            to = self._state(after)
        found = self.moves[state][byte] = to, out
        return found

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The tokens of one piece."""
        state, moves, ids = 0, self.moves, ()
        for byte in data:
            found = moves[state].get(byte)
            state, out = found if found is not None else self._move(state, byte)
            if out:
                ids += out
        return ids + self._rest(state)

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """The tokens of one piece, each as soon as no further byte can change it."""
        state = 0
        for byte in data:
            found = self.moves[state].get(byte)
            state, out = found if found is not None else self._move(state, byte)
            if out:
                yield from out
        yield from self._rest(state)

    def _rest(self, state: int) -> tuple[int, ...]:
        """What is pending where a piece ends: of the one path that ends a token there."""
        return next((path[1:] if path[-1] >= 0 else ()) for path in reversed(self.states[state]) if not path[0])


class Pieces(dict):
    """Tokens by piece, those of the last pieces met and of the ones before. A piece that is a token as a whole is that token,
    whatever its bytes would merge to; long ones are encoded as they are read and not kept."""

    def __init__(self, transducer: Transducer, bpe: Bpe):
        self.transducer, self.bpe = transducer, bpe
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> Iterable[int]:
        found = self.older.get(piece)
        if found is not None:
            self[piece] = found
            return found
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.transducer.v.ranks.get(data)
        if len(piece) > self.bpe.piece_chars:
            return self.transducer.stream(data) if whole is None else (whole,)
        found = self.transducer.encode(data) if whole is None else (whole,)
        if len(self) >= self.bpe.max_pieces:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Whole texts to ids; pieces met before are looked up."""

    def __init__(self, bpe: Bpe):
        self.v = vocabulary(bpe.vocabulary)
        self.known = Pieces(Transducer(self.v, bpe.max_states), bpe)

    def encode(self, text: str) -> np.ndarray:
        look = self.known.__getitem__
        return np.concatenate([np.empty(0, np.uint32), *[np.fromiter(chain.from_iterable(map(look, block)), np.uint32) for block in pieces(text)]])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@cache
def encoder(bpe: Bpe = Bpe()) -> Encoder:
    """One for each Python worker, so what one batch has taught serves the next. Garbage is not looked for in the vocabulary."""
    made = Encoder(bpe)
    gc.freeze()
    return made


class Utf8:
    """Bytes to characters as they come: `open` are the bytes of a character that has begun. Wrong bytes become U+FFFD,
    one for the longest beginning of a character that they are."""

    def __init__(self):
        self.open = b""
        self.left = self.low = self.high = 0
        self.replaced = 0

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.left:
                if self.low <= byte <= self.high:
                    self.open += bytes([byte])
                    self.left, self.low, self.high = self.left - 1, 0x80, 0xBF
                    if not self.left:
                        out.append(self._character())
                    continue
                out.append(self._wrong())
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.open, self.left = bytes([byte]), 1 + (byte >= 0xE0) + (byte >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            else:
                out.append(self._wrong())
        return "".join(out)

    def _character(self) -> str:
        code = self.open[0] & (0x3F >> (len(self.open) - 1))
        for byte in self.open[1:]:
            code = code << 6 | byte & 0x3F
        self.open = b""
        return chr(code)

    def _wrong(self) -> str:
        self.open, self.left = b"", 0
        self.replaced += 1
        return "�"

    def close(self) -> str:
        return self._wrong() if self.left else ""


class Decoder:
    """Ids to text, token by token; the text of tokens that are whole characters by themselves is looked up."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.closed: dict[int, str] = {}
        for token, data in v.tokens.items():
            machine = Utf8()
            text = machine.feed(data)
            if not machine.left and not machine.replaced:
                self.closed[token] = text

    def decode(self, ids: np.ndarray, machine: Utf8) -> str:
        """An id that the vocabulary lacks counts as one wrong byte."""
        tokens = ids.tolist()
        whole = list(map(self.closed.get, tokens))
        if None in whole:
            for i, token in enumerate(tokens):
                if machine.left or whole[i] is None:
                    whole[i] = machine.feed(self.v.tokens.get(token, b"\xff"))
        return "".join(whole) + machine.close()


@cache
def decoder(path: str) -> Decoder:
    return Decoder(vocabulary(path))


def packed(ids: np.ndarray) -> bytes:
    """Ids as unsigned 32-bit numbers, little end first."""
    return np.asarray(ids, "<u4").tobytes()


Batches = Iterator[pa.RecordBatch]


def _encoded(bpe: Bpe, batches: Batches) -> Batches:
    """(id, text) to (id, n_tokens, ids)."""
    coder = encoder(bpe)
    for batch, texts in chunks(batches):
        ids = [packed(coder.encode((t or b"").decode("utf-8", "replace"))) for t in texts]
        yield extended(batch, ["id"], n_tokens=pa.array([len(i) // 4 for i in ids], pa.int64()), ids=pa.array(ids, pa.binary()))


def _decoded(bpe: Bpe, keep: list[str], ids: str, text: str, batches: Batches) -> Batches:
    """Batches with the text of a column of ids."""
    d = decoder(bpe.vocabulary)
    for batch in batches:
        all_ids = batch.column(ids).to_pylist()
        for start, stop in runs(all_ids):
            texts, wrong = [], []
            for data in all_ids[start:stop]:
                machine, data = Utf8(), data or b""
                texts.append(d.decode(np.frombuffer(data[: len(data) // 4 * 4], "<u4"), machine))
                wrong.append(machine.replaced)
            yield extended(batch.slice(start, stop - start), keep, **{text: pa.array(texts, pa.string()), "n_replaced": pa.array(wrong, pa.int64())})


def encode_documents(docs: DataFrame, bpe: Bpe = Bpe(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for each row: ids packed as training reads them, 4 bytes each.

    Null texts count as empty and have no ids. Bytes that are no UTF-8 are read as U+FFFD. Repeated rows and null ids
    stay, extra columns are dropped; an empty table gives no rows.
    """
    plain = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(partial(_encoded, bpe), f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id)


def decode_documents(encoded: DataFrame, bpe: Bpe = Bpe(), ids: str = "ids", text: str = "decoded") -> DataFrame:
    """encoded with the text of its packed ids and how often wrong bytes were replaced (n_replaced).

    Null ids are an empty text; bytes beyond the last whole id are not read; an unknown id is replaced.
    """
    names = [c for c in encoded.columns if c not in (text, "n_replaced")]
    given = encoded.select(*[encoded[c] for c in names])
    kinds = ", ".join(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in names)
    return given.mapInArrow(partial(_decoded, bpe, names, ids, text), f"{kinds}, `{text}` string, n_replaced long")


def round_trip(docs: DataFrame, bpe: Bpe = Bpe(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """decode_documents(encode_documents(docs)) in one pass of Python."""
    plain = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    both = lambda batches: _decoded(bpe, ["id", "n_tokens", "ids"], "ids", "decoded", _encoded(bpe, batches))
    return plain.mapInArrow(both, f"id {kind}, n_tokens long, ids binary, decoded string, n_replaced long").withColumnRenamed("id", id)


def bpe_report(docs: DataFrame, bpe: Bpe = Bpe(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, and digests of the ids and of the text decoded from them."""
    out = round_trip(only(docs, id, text), bpe, id, text)
    return out.select(id, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
