"""Token counts by byte-pair merging with a heap of pairs and a linked list of symbols.

A word's count is the number of its initial symbols less the merges made; no identifier is emitted.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: A word whose bytes are their own symbols, and the pre-tokens of such a word in lower case.
_PRINTABLE = re.compile("[!-~]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class WordCounter(dict):
    """Tokens of each word between ASCII white space. A dict, so that a repeated word costs one look-up."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        ids = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids = ids
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[ids[a] << 32 | ids[b]] = rank, ids[a + b]
        if odd := [t["content"] for t in spec["added_tokens"] if not t["special"] or t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")]:
            raise ValueError(f"added tokens that this counter doesn't know: {odd}")
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.hints = tuple({x[:2].encode() for x in added})
        tok = Tokenizer.from_file(path)
        self.normalize, self.pre = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str

    def __missing__(self, word: bytes) -> int:
        n = self.of_word(word)
        if len(word) <= common.TABLE_CHARS:
            if len(self) >= common.TABLE_ENTRIES:
                self.clear()
            self[word] = n
        return n

    def of_word(self, word: bytes) -> int:
        if self.special and any(x in word for x in self.hints):
            text = word.decode()
            found = len(self.special.findall(text))
            return found + sum(self.plain(x) for x in self.special.split(text) if x)
        return self.plain(word.decode())

    def plain(self, text: str) -> int:
        if _PRINTABLE.fullmatch(text):
            parts = _ASCII.findall(text.lower())
        else:
            parts = [x for x, _ in self.pre(self.normalize(text))]
        return sum(map(self.merged, parts))

    def merged(self, part: str) -> int:
        """The symbols that are left of one pre-token: the pair of lowest rank, the leftmost of equals, merges first."""
        ids, merges = self.ids, self.merges
        symbols = [ids[c] for c in part[:-1]]
        symbols.append(ids[part[-1] + self.end])
        n = left = len(symbols)
        if n == 1:
            return 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if m := merges.get(symbols[i] << 32 | symbols[i + 1]):
                heap.append((m[0], i, m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            if symbols[i] < 0 or (j := after[i]) >= n:
                continue
            m = merges.get(symbols[i] << 32 | symbols[j])
            if m is None or m[1] != made:  # a neighbour has changed since
                continue
            symbols[i], symbols[j] = made, -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(made << 32 | symbols[k]):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merges.get(symbols[h] << 32 | made)):
                heapq.heappush(heap, (m[0], h, m[1]))
        return left


_counters: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated rows, a null id stays null,
    an empty table gives an empty one, and other columns are ignored. A text of any length is counted whole.
    No shuffle: each task keeps a bounded table of words already counted.
    """
    path = common.vocabulary_path(vocabulary)

    def make():
        words = counter(path)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, counts = [], []
            for text in common.texts(batch):
                raw = text.encode()
                sizes.append(len(raw))
                counts.append(sum(map(words.__getitem__, raw.split())))
            return pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return f

    return common.map_batches(common.keyed(docs, id_col, text_col), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
