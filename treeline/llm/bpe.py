"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly when each token encodes to itself and each
adjacent pair of tokens encodes to that pair. So the nondeterministic transducer has a state for each
(last token, place in the trie of tokens), and reading a byte either moves along the trie or also
completes a token that may follow the last one. Its determinisation keeps the live hypotheses with
the tokens on which they still differ; what all of them share is emitted at once, so the delay is
bounded by the longest token. Subsets and transitions are built on first use and dropped together
when their number passes a bound, which changes no result.

Texts are cut by the pattern as the library cuts them. What Python's tables call unassigned may be a letter or a number in
the library's: such a character's class is asked of the library when it is first met, and texts that hold one are cut with
characters of these classes in their places.

Nulls count as empty texts; an empty text has no tokens. Rows repeated give a row each, as do those without an identifier;
an empty table gives an empty result. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeline.llm._common import held, stretches, strings, table, trimmed

ROOT = 0


class Transducer:
    """encode(piece) gives the ids of one pre-token, as a rank-ordered merge of its bytes would.

    A state of the determinised machine is the tuple of live (last token, trie node) hypotheses. Reading a byte gives the
    one token that may end there; tokens are settled as soon as all live hypotheses go back to one boundary."""

    #: Bytes between two looks for settled tokens; a longer piece is never held whole as unsettled.
    SETTLE = 512

    def __init__(self, ranks: dict[bytes, int], most_transitions: int = 500_000):
        self.ranks, self.most = ranks, most_transitions
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = [0] * (max(self.bytes_of) + 1)
        self.children: list[dict[int, int]] = [{}]
        self.token_at, self.depth = [-1], [0]
        for token, rank in ranks.items():
            self.length[rank] = len(token)
            node = ROOT
            for byte in token:
                nxt = self.children[node].get(byte)
                if nxt is None:
                    nxt = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token_at[node] = rank
        assert len(self.children) < 1 << 24
        self.parts: dict[int, tuple[int, int, int] | None] = {}
        self.follows: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        #: A hypothesis is (last token + 1) << 24 | node. State 0 has just the empty one.
        self.states: list[tuple[int, ...]] = [(0,)]
        self.state_ids = {self.states[0]: 0}
        self.moves: dict[int, int] = {}

    def merge(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Lowest rank first, leftmost on ties: the definition, used on tokens and pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def made_of(self, token: int) -> tuple[int, int, int] | None:
        """(when made, left part, right part); None if the token's bytes don't merge to it, or not in order of rank."""
        if token in self.parts:
            return self.parts[token]
        data, out = self.bytes_of[token], None
        if len(data) == 1:
            out = (-1, -1, -1)
        else:
            two = self.merge(data, 2)
            if len(two) == 2:
                left, right = self.ranks[two[0]], self.ranks[two[1]]
                if (x := self.made_of(left)) and (y := self.made_of(right)) and max(x[0], y[0]) < token:
                    out = (token, left, right)
        self.parts[token] = out
        return out

    def may_follow(self, last: int, token: int) -> bool:
        """Whether the token encodes to itself and (last, token) to that pair: undoing both tokens' merges latest first,
        no merge over their boundary may have come before the one just undone."""
        b = self.made_of(token)
        if b is None:
            return self._odd(last, token)
        if last < 0:
            return True
        a = self.made_of(last)
        if a is None:
            return self._odd(last, token)
        get, data, left, right = self.ranks.get, self.bytes_of, last, token
        limit = 1 << 62
        while True:
            rank = get(data[left] + data[right])
            if rank is not None and rank < limit:
                return False
            if a[0] > b[0]:
                limit, left = a[0], a[2]
                a = self.parts[left]
            elif b[0] >= 0:
                limit, right = b[0] + 1, b[1]
                b = self.parts[right]
            else:
                return True

    def _odd(self, last: int, token: int) -> bool:
        """By the definition, for tokens that are not merged in order of rank."""
        own = self.bytes_of[token]
        if self.merge(own) != [own]:
            return False
        return last < 0 or self.merge(self.bytes_of[last] + own) == [self.bytes_of[last], own]

    def move(self, state: int, byte: int) -> int:
        """The transition of the determinised machine, built on first use: the token that ends here << 32 | the next state."""
        live, ended = [], -1
        children, token_at, follows = self.children, self.token_at, self.follows
        for hypothesis in self.states[state]:
            nxt = children[hypothesis & 0xFFFFFF].get(byte)
            if nxt is None:
                continue
            last = hypothesis >> 24
            if children[nxt]:
                live.append(last << 24 | nxt)
            token = token_at[nxt]
            if token >= 0 and ended < 0:
                pair = last << 24 | token
                if (ok := follows.get(pair)) is None:
                    if len(follows) >= self.most:
                        follows.clear()
                    ok = follows[pair] = self.may_follow(last - 1, token)
                if ok:
                    ended = token
        if ended < 0:
            raise ValueError(f"the vocabulary lacks byte {byte}")
        live.append((ended + 1) << 24)
        key = tuple(live)
        if (to := self.state_ids.get(key)) is None:
            to = self.state_ids[key] = len(self.states)
            self.states.append(key)
        out = self.moves[state << 8 | byte] = ended << 32 | to
        return out

    def encode(self, piece: bytes) -> array:
        if (whole := self.ranks.get(piece)) is not None:
            return array("I", (whole,))
        if len(self.moves) > self.most:
            self.reset()
        out = array("I")
        state, get, ends, length = 0, self.moves.get, [], self.length
        for i in range(0, len(piece), self.SETTLE):
            for byte in piece[i : i + self.SETTLE]:
                if (step := get(state << 8 | byte)) is None:
                    step = self.move(state, byte)
                ends.append(step)
                state = step & 0xFFFFFFFF
            at = len(ends)
            if i + self.SETTLE < len(piece):  # else the end settles all
                starts = {at - self.depth[h & 0xFFFFFF] for h in self.states[state]}
                while len(starts) > 1:
                    last = max(starts)
                    starts.remove(last)
                    starts.add(last - length[ends[last - 1] >> 32])
                at = starts.pop()
                if len(self.moves) > self.most:
                    key = self.states[state]
                    self.reset()
                    get = self.moves.get
                    state = self.state_ids.setdefault(key, 1)
                    self.states.append(key)
            settled, back = at, []
            while at:
                back.append(ends[at - 1] >> 32)
                at -= length[back[-1]]
            out.extend(back[::-1])
            del ends[:settled]
        return out


#: States of the UTF-8 machine: continuation bytes still due, and the range of the next one.
_LEADS = {**dict.fromkeys(range(0xC2, 0xE0), (1, 0x80, 0xBF)), 0xE0: (2, 0xA0, 0xBF), **dict.fromkeys(range(0xE1, 0xF0), (2, 0x80, 0xBF)), 0xED: (2, 0x80, 0x9F), 0xF0: (3, 0x90, 0xBF), **dict.fromkeys(range(0xF1, 0xF4), (3, 0x80, 0xBF)), 0xF4: (3, 0x80, 0x8F)}


class Utf8Machine:
    """Incremental UTF-8: feed() gives the text that is complete so far and keeps at most three bytes of an open
    character; ill-formed bytes become U+FFFD, as in a decoding of the whole."""

    def __init__(self):
        self.open = b""

    @staticmethod
    def open_tail(data: bytes) -> int:
        """How many bytes at the end begin a character that may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            if byte not in _LEADS:
                return 0
            due, low, high = _LEADS[byte]
            rest = data[len(data) - back + 1 :]
            return back if due > len(rest) and all((low if k == 0 else 0x80) <= c <= (high if k == 0 else 0xBF) for k, c in enumerate(rest)) else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data) - self.open_tail(data)
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.open = self.open.decode("utf-8", "replace"), b""
        return out


@functools.cache
def unassigned() -> re.Pattern:
    """Finds a character that Python's tables call unassigned."""
    odd = [k for k in range(0x110000) if unicodedata.category(chr(k)) == "Cn"]
    ends = [k for k, nxt in zip(odd, [*odd[1:], -1], strict=True) if nxt != k + 1]
    starts = [k for k, before in zip(odd, [-1, *odd[:-1]], strict=True) if before != k - 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


class Encoder:
    """Texts to ids and back. Pre-tokens are cut by the pattern; whole pieces between single spaces are remembered."""

    #: A space before white space or the end: only then can a match reach over a space.
    _ODD = re.compile(r" (?:\s|\Z)")
    #: Where a match always begins.
    _CUT = re.compile(r"(?<=\S) (?=\S)")
    #: Characters of a text that are cut at once.
    STEP = 1 << 20

    def __init__(self, path: str, pattern: str, most_pieces: int = 160_000):
        import regex

        with open(path, "rb") as f:
            self.machine = Transducer({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.pattern, self.split = pattern, regex.compile(pattern).findall
        self.plain: dict[str, str] = {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most_pieces
        assert array("I").itemsize == 4 and sys.byteorder == "little"
        tokens = [self.machine.bytes_of.get(i, b"") for i in range(max(self.machine.bytes_of) + 1)]
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def _ids(self, pretoken: str) -> bytes:
        """Ids of a pre-token, as packed little-endian 32-bit integers; two generations bound the memory."""
        if (out := self.new.get(pretoken)) is None:
            if (out := self.old.get(pretoken)) is None:
                out = self.machine.encode(pretoken.encode()).tobytes()
            self._keep(pretoken, out)
        return out

    def _keep(self, key: str, ids: bytes) -> None:
        if len(key) <= 64:
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[key] = ids

    def _piece(self, piece: str) -> bytes:
        core = piece.rstrip(".,;:!?")
        if (core[1:] if core[:1] == " " else core).isalpha():  # one match of the pattern, and one of the marks
            if len(core) == len(piece):
                return self._ids(core)
            known = core in self.new
            out = self._ids(core) + self._ids(piece[len(core) :])
            if known:  # words seen once would only fill the memory
                self._keep(piece, out)
            return out
        return b"".join([self._ids(x) for x in self.split(piece)])

    def _like(self, char: str) -> str:
        """A character that all tables know, of the class that the library's have the given one in."""
        if (out := self.plain.get(char)) is None:
            import tiktoken

            whole = {kind: (kind + char).encode() for kind in "a1"}
            ranks = {bytes([k]): k for k in range(256)} | {b: 256 + k for k, b in enumerate(whole.values())}
            library = tiktoken.Encoding("classes", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            one = [kind for kind in "a1" if len(library.encode_ordinary(kind + char)) == 1]
            out = self.plain[char] = {"a": "é", "1": "7"}[one[0]] if one else "§"
        return out

    def encode(self, text: str) -> bytes:
        if len(text) <= self.STEP:
            return self._encode(text)
        out, lo = [], 0
        while lo < len(text):
            cut = self._CUT.search(text, lo + self.STEP)
            hi = cut.start() if cut else len(text)
            out.append(self._encode(text[lo:hi]))
            lo = hi
        return b"".join(out)

    def _encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")  # all assigned
        except UnicodeEncodeError:
            if unassigned().search(text):
                out, lo = [], 0
                for piece in self.split(unassigned().sub(lambda m: self._like(m[0]), text)):
                    out.append(self._ids(text[lo : lo + len(piece)]))
                    lo += len(piece)
                return b"".join(out)
        if self._ODD.search(text):
            pieces = self.split(text)
        else:
            pieces = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.split(text)
        out = list(map(self.new.get, pieces))
        slow = self._piece
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = slow(pieces[i])
        return b"".join(out)

    def decode(self, packed: bytes, at_once: int = 65536) -> Iterator[tuple[bytes, str]]:
        """Streams (bytes, text): the bytes of no more than at_once tokens are held."""
        ids, machine = np.frombuffer(packed, "<u4"), Utf8Machine()
        for i in range(0, len(ids), at_once):
            some = ids[i : i + at_once]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            data = self.flat[np.repeat(self.starts[some] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()
            yield data, machine.feed(data)
        yield b"", machine.finish()


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, text: bool = False) -> DataFrame:
    """Encodes every whole text and streams it back. Gives id_col, n_tokens, ids_sha256, decoded_sha256, and on request
    ids (array of int) and decoded_text. One pass without a shuffle; memory is bounded by a batch of texts."""
    schema = f"`{id_col}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded_text string" * text

    key = ("bpe", path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held(key, lambda: Encoder(path, pattern))
        for batch in batches:
            for lo, some in stretches(batch.column(1), read=strings):
                rows: dict[str, list] = {"n": [], "a": [], "b": [], "ids": [], "text": []}
                for t in some:
                    packed = codec.encode(t)
                    digest, parts = hashlib.sha256(), []
                    for data, part in codec.decode(packed):
                        digest.update(data)
                        if text:
                            parts.append(part)
                    rows["n"].append(len(packed) // 4)
                    rows["a"].append(hashlib.sha256(packed).hexdigest())
                    rows["b"].append(digest.hexdigest())
                    if ids:
                        rows["ids"].append(np.frombuffer(packed, "<u4").astype(np.int32))
                    if text:
                        rows["text"].append("".join(parts))
                out = [batch.column(0).slice(lo, len(some)).cast(pa.int64()), pa.array(rows["n"], pa.int64()), pa.array(rows["a"], pa.string()), pa.array(rows["b"], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    out.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                if text:
                    out.append(pa.array(rows["text"], pa.string()))
                    names.append("decoded_text")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return df.select(id_col, text_col).mapInArrow(trimmed(run, key), schema)


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), *tokenizer())
