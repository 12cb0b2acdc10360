"""Token counts by a whole-token shortcut.

Before any text is read, every vocabulary string that ends a word is encoded alone; those that give one token are
proven. A pre-token that is a proven string counts one without merging; only the rest is merged, lowest rank first, and
its count remembered. Nulls count as empty texts, which have no tokens. Rows repeated give a row each, as do those without
an identifier; an empty table gives an empty result.

Characters on which the library's Unicode tables and Python's disagree (scripts newer than one of them) are found by
probing the library once; texts that hold one are normalised and split by the library itself, then counted as the others.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treeline.llm._common import held, stretches, strings, table, trimmed

_NEVER = 1 << 60


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes for themselves,
    the others in order from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


class Counter:
    """Counts for a vocabulary file with NFC, white-space folding, lower case, a split pattern and end-of-word merges."""

    _CONTROLS = re.compile("[\\x1c-\\x1f]")

    def __init__(self, path: str, most: int = 200_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or model.get("ignore_merges") or not split["invert"]:
            raise ValueError("this kind of tokenizer isn't supported")
        self.path, self.split = path, regex.compile(split["pattern"]["Regex"]).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.chars = {b: vocab.get(c) for b, c in enumerate(byte_chars())}
        self.ends = {b: vocab.get(c + self.suffix) for b, c in enumerate(byte_chars())}
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left] << 20 | vocab[right]] = rank << 20 | vocab[left + right]
        self.proven = self._prove(vocab)
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.most = most

    def merge(self, word: bytes) -> int:
        """How many tokens a pre-token has."""
        syms = [self.chars[b] for b in word]
        syms[-1] = self.ends[word[-1]]
        get = self.pairs.get
        if len(syms) > 256:
            return self._merge_long(syms)
        ranks = [get(a << 20 | b, _NEVER) for a, b in zip(syms, syms[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            syms[i] = best & 0xFFFFF
            del syms[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(syms[i - 1] << 20 | syms[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(syms[i] << 20 | syms[i + 1], _NEVER)
        return len(syms)

    def _merge_long(self, syms: list[int]) -> int:
        """The same by a heap, for words whose length squared would take too long."""
        get, n, left = self.pairs.get, len(syms), len(syms)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(k, i) for i in range(n - 1) if (k := get(syms[i] << 20 | syms[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            k, i = heapq.heappop(heap)
            j = after[i]
            if syms[i] < 0 or j >= n or get(syms[i] << 20 | syms[j]) != k:
                continue  # one of the two has been merged since
            syms[i], syms[j], after[i], left = k & 0xFFFFF, -1, after[j], left - 1
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (k := get(syms[a] << 20 | syms[after[a]])) is not None:
                    heapq.heappush(heap, (k, a))
        return left

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def doubtful(self):
        """Finds a character that the library classes, composes or orders unlike Python or the regex module."""
        import regex
        from tokenizers import Regex, normalizers

        chars = [chr(c) for c in (*range(0x80, 0xD800), *range(0xF900, 0x40000), *range(0xE0000, 0xE1000))]
        found = set()

        def probe(normalizer, own, strings: list[str]) -> None:
            theirs = normalizer.normalize_str("|".join(strings)).split("|")
            found.update(c for c, s, t in zip(chars, strings, theirs, strict=True) if own(s) != t)

        nfc = functools.partial(unicodedata.normalize, "NFC")
        for shape in ("{}", "a{}\u0334", "a\u0301{}"):
            probe(normalizers.NFC(), nfc, [shape.format(c) for c in chars])
        probe(normalizers.Lowercase(), lambda c: "σ" if c == "Σ" else c.lower(), chars)
        for kind, same in ((r"\p{L}", str.isalpha), (r"\p{N}", None), (r"\s", str.isspace)):
            match = regex.compile(kind).match
            probe(normalizers.Replace(Regex(kind), "="), lambda c, m=match: "=" if m(c) else c, chars)
            found.update(c for c in chars if same and same(c) != bool(match(c)))
        spans: list[list[int]] = []
        for c in sorted(map(ord, found)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]" if spans else "(?!)")

    def by_library(self, text: str) -> int:
        back = {c: b for b, c in enumerate(byte_chars())}
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return sum(self.pretoken(bytes(back[c] for c in part).decode()) for part, _ in parts)

    def _prove(self, vocab: dict[str, int]) -> frozenset[str]:
        back = {c: b for b, c in enumerate(byte_chars())}
        out = set()
        for string in vocab:
            if string.endswith(self.suffix) and len(string) > len(self.suffix):
                word = bytes(back[c] for c in string[: -len(self.suffix)])
                try:
                    text = word.decode()
                except UnicodeDecodeError:
                    continue  # part of a character: never a pre-token
                if self.split(text) == [text] and self.merge(word) == 1:
                    out.add(text)
        return frozenset(out)

    def pretoken(self, word: str) -> int:
        if word in self.proven:
            return 1
        if (n := self.new.get(word)) is None:
            if (n := self.old.get(word)) is None:
                n = self.merge(word.encode())
            self._keep(word, n)
        return n

    def _keep(self, word: str, n: int) -> None:
        if len(word) <= 64:
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[word] = n

    def run(self, word: str) -> int:
        """Tokens of a run without white space."""
        core = word.rstrip(".,;:!?")
        if core.isalpha():
            if len(core) == len(word):
                return self.pretoken(core)
            known = core in self.proven or core in self.new
            n = self.pretoken(core) + self.pretoken(word[len(core) :])
            if known:
                self._keep(word, n)
            return n
        return sum(map(self.pretoken, self.split(word)))

    def plain(self, text: str) -> int:
        if not text.isascii():
            if self.doubtful.search(text):
                return self.by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a sigma is lowered without a look at its place
        text = text.lower()
        if self._CONTROLS.search(text):  # white space to str.split() only
            return sum(map(self.pretoken, self.split(text)))
        runs, proven, new, rest, n = text.split(), self.proven, self.new.get, self.run, 0
        for r in runs:
            if r in proven:
                n += 1
            elif (k := new(r)) is not None:
                n += k
            else:
                n += rest(r)
                new = self.new.get
        return n

    def count(self, text: str) -> int:
        """Special strings count as one token each, and part the text, as is the library's default."""
        if self.special is None or "<|" not in text:
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


def counter(path: str) -> Counter:
    """One for each Python worker."""
    return held(("counter", path), lambda: Counter(path))


def token_counts(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit of every whole text: one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for lo, texts in stretches(batch.column(1), read=strings):
                n = [own.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(texts)).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return df.select(id_col, text_col).mapInArrow(trimmed(run, ("counter", path)), f"`{id_col}` bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
