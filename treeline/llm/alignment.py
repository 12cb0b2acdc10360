"""Alignment of two tokenizers' tokens by bytes, over whole Arrow batches at once.

All texts of a stretch of a batch are laid end to end with one space before each; a document is a range of bytes. The last
bytes of both tokenizers' tokens are counted per byte once (bincount); where both are, the text is cut into groups.
Prefix sums over these marks, read at the documents' ends, give every document its counts, and read at the marks the index
of the token of either side that covers a byte. Each stretch of bytes between marks of either kind is one link: one pair of
overlapping tokens. So there is no loop over documents or tokens but that over a document's digest.

Tokens are had word by word: both tokenizers give the same tokens for the words of a text, cut before a space that follows
no space and precedes no white space, as for the text. Words met before are remembered, up to `most_words`.

A first pass writes a row for each document with its distinct links; counts of documents per pair of ids come from there by
numpy inside tasks and one sum. They are as many as the vocabularies have overlapping pairs: up to `most_pairs` they are
broadcast as two arrays, beyond they are joined by key, hot pairs apart.

Texts that are null or empty, or whose joined token bytes differ from space + text in either tokenizer, have no tokens:
zeros, and an empty string for the digest. Rows repeated count as documents each, as do rows without an identifier. An
empty table gives an empty result. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm._common import discard, held, lookup, materialise, no_cycles, stretches, strings, table, trimmed


class Tokenizer(NamedTuple):
    """encode gives the ids of each of some words that follow a space, together those of words that a sure cut parts, but
    for words that are `odd`; data has each id's bytes."""

    encode: Callable[[list[str]], list[list[int]]]
    together: Callable[[list[str]], list[int]]
    odd: Callable[[str], bool]
    data: list[bytes]


#: Characters whose class no Unicode table has changed since long: two libraries cut them alike.
_OLD = re.compile(r"[^\x00-\u0377\u0400-\u052f\u1e00-\u1fff\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
#: Words beside which a cut is not sure: they begin or end with white space, or have the sign that one side writes spaces as.
_UNSURE = re.compile(r"\A\s|\s\Z|\u2581")


def byte_level(path: str, pattern: str) -> Tokenizer:
    """A byte-level BPE file of the tokenizers library. Short words of old characters are encoded by tiktoken with the same
    ranks, which is faster and gives the same, all others by the library itself."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    import tokenizers

    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    signs = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = spec["model"]["vocab"]
    data = [b""] * (max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    special = {t["id"] for t in spec["added_tokens"]}
    for token, i in vocabulary.items():
        data[i] = token.encode() if i in special else bytes(signs[c] for c in token)
    quick = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(data) if b and i not in special}, special_tokens={})

    def encode(words: list[str]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch([" " + w for w in words], add_special_tokens=False)]

    def together(words: list[str]) -> list[int] | None:
        return quick.encode_ordinary(" " + " ".join(words))

    return Tokenizer(encode, together, lambda w: len(w) > 200 or bool(_OLD.search(w)), data)


def pieces(path: str) -> Tokenizer:
    """A sentencepiece model that puts a space before each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    data = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        data.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokenizer(lambda words: model.encode(words, num_threads=1), lambda words: list(itertools.chain.from_iterable(model.encode(words, num_threads=1))), lambda w: False, data)


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.data, self.n = np.zeros(1 << 16, dtype), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(more)), self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Side:
    """The tokens of all words met, one after the other."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.lengths = tokenizer, np.array([len(d) for d in tokenizer.data], np.int32)
        self.clear()
        assert len(tokenizer.data) < 10**7
        #: Each id's decimal digits as the low bytes of a number, and how many they are.
        self.digits = np.array([int.from_bytes(str(i).encode(), "little") for i in range(len(tokenizer.data))], np.uint64)
        self.size = np.array([len(str(i)) for i in range(len(tokenizer.data))], np.int64)

    def clear(self) -> None:
        self.ids, self.first, self.count = Grown(np.int32), Grown(np.int64), Grown(np.int32)

    def add(self, words: list[str], texts: list[bytes]) -> np.ndarray:
        """Remembers words; says of which the tokens' bytes are those of the text."""
        whole = b"".join(texts)
        ids = np.array(self.tokenizer.together(words), np.int32)
        if b"".join(map(self.tokenizer.data.__getitem__, ids.tolist())) != whole:
            return self.add_each(words, texts)
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(t) for t in texts])) + 1
        self._extend(ids, np.diff(ends, prepend=0))
        return np.ones(len(words), bool)

    def add_each(self, words: list[str], texts: list[bytes]) -> np.ndarray:
        new, data = self.tokenizer.encode(words), self.tokenizer.data
        counts = np.fromiter(map(len, new), np.int64, len(new))
        self._extend(np.fromiter((i for ids in new for i in ids), np.int32, int(counts.sum())), counts)
        return np.array([b"".join([data[i] for i in ids]) == t for ids, t in zip(new, texts, strict=True)], bool)

    def _extend(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.first.extend(self.ids.n + np.cumsum(counts) - counts)
        self.count.extend(counts)
        self.ids.extend(ids)

    def of(self, words: np.ndarray) -> np.ndarray:
        counts = self.count.data[words].astype(np.int64)
        ends = np.cumsum(counts)
        return self.ids.data[np.repeat(self.first.data[words] - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Aligned(NamedTuple):
    """For each of some documents; links are codes (id of a * ids of b + id of b), distinct[at[k]:at[k + 1]] those of k."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    distinct: np.ndarray
    times: np.ndarray
    at: np.ndarray


class Aligner:
    #: A space before white space or the end: only then is a cut not before every space.
    _ODD = re.compile(r" (?:\s|\Z)")
    _CUT = re.compile(r"(?<! ) (?=\S)")

    def __init__(self, a: Tokenizer, b: Tokenizer, most_words: int = 400_000):
        self.a, self.b, self.most = Side(a), Side(b), most_words
        self.codes = len(b.data)
        self._clear()

    def _clear(self) -> None:
        self.a.clear()
        self.b.clear()
        self.place: dict[str, int] = {}
        self.bytes, self.same = Grown(np.int64), Grown(np.bool_)

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the one space before it."""
        if not text:
            return []
        whole = " " + text
        if not self._ODD.search(whole):
            return whole.split(" ")[1:]
        out = self._CUT.split(whole)
        return [out[0][1:], *out[1:]] if out[0] else out[1:]

    def _places(self, words: list[str]) -> np.ndarray:
        if len(self.place) > self.most:
            self._clear()
        found = list(map(self.place.get, words))
        missing = [k for k, p in enumerate(found) if p is None]
        if missing:
            new = dict.fromkeys([words[k] for k in missing])
            kinds: dict[tuple[bool, ...], list[str]] = {}
            for w in new:
                unsure = bool(_UNSURE.search(w))
                kinds.setdefault((unsure or self.a.tokenizer.odd(w), unsure or self.b.tokenizer.odd(w)), []).append(w)
            for odd, some in kinds.items():
                texts = [(" " + w).encode() for w in some]
                self.place.update(zip(some, range(len(self.place), len(self.place) + len(some)), strict=True))
                self.bytes.extend(np.fromiter(map(len, texts), np.int64, len(texts)))
                self.same.extend(np.logical_and(*((side.add_each if o else side.add)(some, texts) for side, o in zip((self.a, self.b), odd, strict=True))))
            for k in missing:
                found[k] = self.place[words[k]]
        return np.array(found, np.int64)

    def align(self, texts: list[str]) -> Aligned:
        split = [self.words(t) for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        words = self._places([w for s in split for w in s])
        bad = np.zeros(len(texts), bool)
        bad[np.repeat(np.arange(len(texts)), counts)[~self.same.data[words]]] = True
        words, counts = words[~np.repeat(bad, counts)], np.where(bad, 0, counts)
        sides = [(s, s.of(words)) for s in (self.a, self.b)]
        ends = np.concatenate([[0], np.cumsum(self.bytes.data[words])])[np.concatenate([[0], np.cumsum(counts)])]
        total = int(ends[-1])
        marks = [np.bincount(np.cumsum(s.lengths[ids]) - 1, minlength=total) for s, ids in sides]
        cut = marks[0] & marks[1]
        upto = [np.concatenate([[0], np.cumsum(m)]) for m in (*marks, cut)]  # before each byte
        n_a, n_b, n_groups = (np.diff(u[ends]) for u in upto)
        links = np.flatnonzero(marks[0] | marks[1])
        codes = sides[0][1][upto[0][links]].astype(np.int64) * self.codes + sides[1][1][upto[1][links]]
        n_links = n_a + n_b - n_groups
        keys, times = np.unique(np.repeat(np.arange(len(texts)), n_links) * (self.codes * len(self.a.lengths)) + codes, return_counts=True)
        doc, distinct = np.divmod(keys, self.codes * len(self.a.lengths))
        return Aligned(n_a, n_b, n_groups, n_links, self._digests(sides, marks, cut, upto, n_a + n_b), distinct, times, np.searchsorted(doc, np.arange(len(texts) + 1)))

    def _digests(self, sides: list, marks: list, cut: np.ndarray, upto: list, sizes: np.ndarray) -> list[str]:
        """All documents' groups in decimal as one array of bytes: tokens are put in order of their group, side and place."""
        cuts, n = np.flatnonzero(cut), int(sizes.sum())
        text, size = np.zeros(n, "<u8"), np.zeros(n, np.int64)
        for k, (side, ids) in enumerate(sides):
            last = np.flatnonzero(marks[k])
            # of the other side, a token of a comes after those of the groups before, and of b after its group's too
            at = np.arange(len(ids)) + np.concatenate([[0], upto[1 - k][cuts + 1]])[upto[2][last] + k]
            sign = np.where(cut[last] > 0, np.uint64(ord("|;"[k])), np.uint64(ord(",")))
            size[at] = side.size[ids] + 1
            text[at] = side.digits[ids] | sign << (8 * side.size[ids]).astype(np.uint64)
        flat = text.view(np.uint8)
        flat = flat[flat > 0].tobytes()
        to = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [hashlib.sha256(flat[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(to[:-1], to[1:], strict=True)]


def wide(a_ids: int, b_ids: int) -> type:
    """What codes are packed as."""
    return np.uint32 if a_ids * b_ids < 1 << 32 else np.int64


def _packed(values: np.ndarray, at: np.ndarray, dtype: type) -> pa.Array:
    """The parts of values as an Arrow column of bytes."""
    values = values.astype(dtype)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


_DOC = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


def aligned(df: DataFrame, make: Callable[[], tuple[Tokenizer, Tokenizer]], key: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its counts and digest, its distinct links (codes, packed as `wide` says) and how
    often it has each (times, 32 bits). One pass without a shuffle. key tells the pair of tokenizers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(("alignment", *key), lambda: Aligner(*make()))
        for batch in batches:
            for lo, texts in stretches(batch.column(1), 1 << 20, strings):
                with no_cycles():
                    out = aligner.align(texts)
                columns = [batch.column(0).slice(lo, len(texts)).cast(pa.int64()), *(pa.array(c) for c in out[:4]), pa.array(out.digests, pa.string()), _packed(out.distinct, out.at, wide(len(aligner.a.lengths), aligner.codes)), _packed(out.times, out.at, np.int32)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])

    return df.select(id_col, text_col).mapInArrow(trimmed(run, ("alignment", *key)), f"`{id_col}` bigint, {_DOC}, codes binary, times binary")


def _column(values: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of bytes, and where those of each row end."""
    sizes = pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(values.to_pylist()), dtype), np.cumsum(sizes) // np.dtype(dtype).itemsize


def document_counts(docs: DataFrame, ids: tuple[int, int], most_held: int = 1_000_000) -> DataFrame:
    """code, n (documents that have it linked), best (whether no other pair of its A id has more). Counted inside tasks
    first; a task holds most_held codes, more are given out and counted on. ids: how many A and B have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

        for batch in batches:
            found, times = np.unique(_column(batch.column(0), wide(*ids))[0], return_counts=True)
            both, back = np.unique(np.concatenate([codes, found.astype(np.int64)]), return_inverse=True)
            codes, n = both, np.bincount(back, np.concatenate([n, times]), len(both)).astype(np.int64)
            if len(codes) > most_held:
                yield out()
                codes, n = codes[:0], n[:0]
        yield out()

    sums = docs.select("codes").mapInArrow(trimmed(run), "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.floor(F.col("code") / ids[1]))  # at most as many as B has ids
    return sums.withColumn("best", F.col("n") == F.max("n").over(own))


_SUMS = ["n_best", "count_sum"]


def _summed(docs: DataFrame, counts: DataFrame, ids: tuple[int, int]) -> DataFrame:
    """docs with n_best and count_sum, with the counts broadcast as arrays. No shuffle."""
    local = counts.orderBy("code").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((local["code"].to_numpy(), local["n"].to_numpy(), local["best"].to_numpy().astype(bool)))
    del local
    own = [c for c in docs.columns if c not in ("codes", "times", "row")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = shared.value
        for batch in batches:
            found, ends = _column(batch.column(len(own)), wide(*ids))
            times = _column(batch.column(len(own) + 1), np.int32)[0].astype(np.int64)
            at = np.searchsorted(codes, found.astype(np.int64))
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (times * best[at], times * n[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *map(pa.array, sums)], names=[*own, *_SUMS])

    return docs.select(*own, "codes", "times").mapInArrow(trimmed(run), f"{schema}, n_best bigint, count_sum bigint")


def _joined(docs: DataFrame, counts: DataFrame, ids: tuple[int, int]) -> DataFrame:
    """The same by a join on the code, for more counts than may be broadcast."""

    def unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends = _column(batch.column(1), wide(*ids))
            rows = np.repeat(batch.column(0).to_numpy(), np.diff(ends, prepend=0))
            times = _column(batch.column(2), np.int32)[0].astype(np.int64)
            for lo in range(0, len(codes), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 17)].astype(np.int64)) for x in (rows, codes, times)], names=["row", "code", "times"])

    links = docs.select("row", "codes", "times").mapInArrow(trimmed(unfolded), "row bigint, code bigint, times bigint")
    sums = lookup(links, counts, ["code"], "n").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return docs.drop("codes", "times").join(sums, "row", "left").fillna(0, _SUMS).drop("row")


def align(df: DataFrame, make: Callable[[], tuple[Tokenizer, Tokenizer]], key: tuple, ids: tuple[int, int], id_col: str = "doc_id", text_col: str = "text", most_pairs: int = 4_000_000) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document. ids: how many ids A and B
    have; make gives both tokenizers inside a task, key tells them from others."""
    docs = materialise(aligned(df, make, key, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = materialise(document_counts(docs, ids), "pair-counts")
    out = materialise((_summed if counts.count() <= most_pairs else _joined)(docs, counts, ids), "alignment")
    discard(docs, counts)
    return out.select(id_col, "n_a", "n_b", "n_groups", "n_links", *_SUMS, "groups_sha256")


def tokenizers() -> tuple[Tokenizer, Tokenizer]:
    """The pair of the registered query."""
    import public_tokenizers

    return byte_level(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), pieces(public_tokenizers.path("piece_bpe_32k.model"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = tokenizers()
    return align(table(spark, sf_dir, "documents"), tokenizers, ("byte_bpe_50k", "piece_bpe_32k"), (len(a.data), len(b.data)))
