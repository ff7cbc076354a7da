"""Byte-level BPE encoding and decoding from a public ``tokenizer.json``.

Each word of the pre-tokenizer is merged by a priority queue of merge ranks over a doubly linked
list of symbols: the best pair is popped, checked for staleness against the symbols now in its
places, merged, and the two new neighbour pairs are pushed.  Words repeat, so each Python worker
keeps a bounded memo of word -> ids.  Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import quoted, table

MEMO_WORDS = 1_000_000
ARROW = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
#: The pre-tokenizer's split; ``\\s`` is spelt out because libraries differ on control characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class _Memo(dict):
    """word -> its packed ids, merged when first asked for; emptied when full, very long words kept out."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self._merge = bpe.merge

    def __missing__(self, word: str) -> bytes:
        ids = self._merge(word.encode("utf-8"))
        made = pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = made
        return made


class ByteBpe:
    """One byte-level BPE vocabulary with its added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        vocab: dict[str, int] = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        self.bytes_of: dict[int, bytes] = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.start = [vocab[c] for c in byte_chars()]
        #: left id << 32 | right id -> rank, and by rank that pair and the id it becomes.
        self.ranks: dict[int, int] = {}
        self.pair_of, self.id_of = [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            key = vocab[left] << 32 | vocab[right]
            self.ranks[key] = rank
            self.pair_of.append(key)
            self.id_of.append(vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"added token {t['content']!r} needs rules that are not supported")
            self.bytes_of[t["id"]] = t["content"].encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self._added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self._words = regex.compile(SPLIT).findall
        self._memo = _Memo(self)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word.

        A queue entry is rank << 32 | place of the left symbol.  It is stale, and skipped, where the
        symbols that now stand there are not the pair of its rank.
        """
        ids = [self.start[b] for b in word]
        n = len(ids)
        ranks, pair_of, id_of = self.ranks, self.pair_of, self.id_of
        queue = [ranks[pair] << 32 | at for at in range(n - 1) if (pair := ids[at] << 32 | ids[at + 1]) in ranks]
        if not queue:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            at, rank = entry & 0xFFFFFFFF, entry >> 32
            right = after[at]
            if right >= n or ids[at] < 0 or ids[at] << 32 | ids[right] != pair_of[rank]:
                continue
            ids[at] = new = id_of[rank]
            ids[right] = -1
            after[at] = end = after[right]
            if end < n:
                before[end] = at
                if (pair := new << 32 | ids[end]) in ranks:
                    push(queue, ranks[pair] << 32 | at)
            if (first := before[at]) >= 0 and (pair := ids[first] << 32 | new) in ranks:
                push(queue, ranks[pair] << 32 | first)
        return [i for i in ids if i >= 0]

    def packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; strings of added tokens
        inside it become those tokens."""
        if self._added is None or not any(t in text for t in self.added):
            return b"".join(map(self._memo.__getitem__, self._words(text)))
        out = []
        for k, part in enumerate(self._added.split(text)):
            out += [pack("<I", self.added[part])] if k % 2 else map(self._memo.__getitem__, self._words(part))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Concatenated vocabulary strings, special tokens included; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One vocabulary for each Python worker."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """One row per row of ``docs``: the id, n_tokens, digests of ids and decoded text; with
    ``keep`` also ``ids`` (ARRAY<INT>) and ``decoded``.  A null text counts as empty, whose ids are
    empty; nothing is dropped, cut or reordered, and other columns are not touched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            made: dict[str, list] = {name: [] for name in ("n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if keep else ()))}
            for text in batch.column("text"):
                packed = bpe.packed(text.as_py() or "")
                ids = np.frombuffer(packed, dtype="<u4")
                decoded = bpe.decode(ids.tolist())
                made["n_tokens"].append(len(ids))
                made["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                made["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if keep:
                    made["ids"].append(ids.astype(np.int32))
                    made["decoded"].append(decoded)
            # The id stays an Arrow column: pandas would make floats of longs beside a null.
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, ARROW[name]) for name, x in made.items())], ["id", *made])

    source = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of the whole ``documents`` table, encoded and decoded again."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=False)
