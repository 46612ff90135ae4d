"""BPE encoding and decoding by a pair occurrence index.

The pre-tokens of a chunk of texts are laid out once each in flat arrays of
symbols with links to the next and previous symbol. An index maps the rank of
every pair that can merge to all its positions in the chunk. Ranks are applied
in ascending order from a heap, each to all its positions in one array
operation; only the lists of the pairs beside a merge change. A pre-token's
merges never depend on another's, so this gives what the usual greedy
algorithm gives for each pre-token.

Texts are taken in chunks of bounded size and the pre-tokens already encoded
are kept in a map of bounded entries and characters, so memory does not grow with the input (a single
text longer than a chunk is a chunk of its own). A task keeps nothing that
another needs: a lost executor costs the rerun of its tasks.

Defined cases: a null text counts as empty; an empty text has no tokens and
decodes to the empty text; special tokens inside a text become their own id;
repeated rows give repeated results; an empty table gives an empty result;
other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens of the byte-level scheme; white space is the Unicode property.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"
#: Characters of text in a chunk; pre-tokens, and characters of them, remembered between chunks.
CHUNK_CHARS = 12_000_000
REMEMBERED, REMEMBERED_CHARS = 300_000, 6_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte: itself where printable, else one from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file (JSON)."""

    def __init__(self, definition: str) -> None:
        parsed = json.loads(definition)
        ids, alphabet = parsed["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.token_bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in token) for token, i in ids.items() if token not in self.special}
        self.token_bytes |= {i: token.encode() for token, i in self.special.items()}
        first = np.zeros(256, dtype=np.int64)
        for c, b in alphabet.items():
            first[b] = ids[c]
        self.byte_ids = first
        pairs = [m if isinstance(m, list) else m.split(" ") for m in parsed["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.size = max(self.token_bytes) + 1
        keys = self.left * self.size + self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it does not merge."""
        wanted = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.by_key[at], -1) if len(self.keys) else np.full(len(a), -1)


class PairIndex:
    """Rank -> positions of its pair, with the ranks in a heap."""

    def __init__(self) -> None:
        self.at: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        found = ranks >= 0
        ranks, positions = ranks[found], positions[found]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
        ends = [*starts[1:].tolist(), len(ranks)]
        for rank, i, j in zip(ranks[starts].tolist(), starts.tolist(), ends, strict=True):
            if rank in self.at:
                self.at[rank].append(positions[i:j])
            else:
                self.at[rank] = [positions[i:j]]
                heapq.heappush(self.active, rank)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        lists = self.at.pop(rank)
        return rank, np.unique(np.concatenate(lists))


def merge_all(vocabulary: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each word (non-empty byte strings)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n = int(lengths.sum())
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
    ends = np.cumsum(lengths)
    following = np.arange(1, n + 1)
    following[ends - 1] = -1
    before = np.arange(-1, n - 1)
    before[ends - lengths] = -1

    index = PairIndex()
    inner = np.flatnonzero(following >= 0)
    index.add(vocabulary.ranks(symbols[inner], symbols[inner + 1]), inner)
    while index.active:
        rank, at = index.pop()
        a, b = vocabulary.left[rank], vocabulary.right[rank]
        at = at[symbols[at] == a]
        second = following[at]
        fits = second >= 0
        fits[fits] = symbols[second[fits]] == b
        at, second = at[fits], second[fits]
        if a == b and len(at) > 1:
            # of a run of equal symbols every other position merges, from its start
            runs = np.concatenate(([True], second[:-1] != at[1:]))
            start = np.maximum.accumulate(np.where(runs, np.arange(len(at)), 0))
            every_other = (np.arange(len(at)) - start) % 2 == 0
            at, second = at[every_other], second[every_other]
        if not len(at):
            continue
        after = following[second]
        symbols[at] = vocabulary.merged[rank]
        symbols[second] = -1
        following[at] = after
        has_after = after >= 0
        before[after[has_after]] = at[has_after]
        left = before[at]
        left = left[left >= 0]
        kept = at[has_after]
        beside = np.concatenate((left, kept))
        index.add(vocabulary.ranks(symbols[beside], symbols[following[beside]]), beside)

    alive = symbols >= 0
    count = np.add.reduceat(alive, ends - lengths) if n else np.zeros(0, dtype=np.int64)
    return np.split(symbols[alive], np.cumsum(count)[:-1])


class Codec:
    """Encodes texts to ids and decodes ids to texts.

    form says what is remembered of a pre-token's ids; by default the ids as 32-bit numbers.
    """

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED, form: Callable[[list[int]], Any] | None = None) -> None:
        self.vocabulary, self.remembered = vocabulary, remembered
        self.form = form or (lambda ids: np.array(ids, dtype=np.int32).tobytes())
        self.pretoken = regex.compile(PRETOKEN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.known: dict[str, Any] = {}
        self.held = 0

    def pretokens(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.pretoken.findall(text)
        found, at = [], 0
        for m in self.special.finditer(text):
            found += self.pretoken.findall(text[at : m.start()])
            found.append(m[0])
            at = m.end()
        return found + self.pretoken.findall(text[at:])

    def learn(self, wanted: Iterable[str]) -> None:
        """Makes self.known hold every distinct word wanted."""
        wanted = list(wanted)
        new = [w for w in wanted if w not in self.known]
        self.held += sum(map(len, new))
        if len(self.known) + len(new) > self.remembered or self.held > REMEMBERED_CHARS:
            # what this chunk needs is bounded by its characters
            self.known = {w: self.known[w] for w in wanted if w in self.known}
            self.held = sum(map(len, wanted))
        plain = [w for w in new if w not in self.vocabulary.special]
        for w in new:
            if w in self.vocabulary.special:
                self.known[w] = self.form([self.vocabulary.special[w]])
        if plain:
            for w, ids in zip(plain, merge_all(self.vocabulary, [w.encode() for w in plain]), strict=True):
                self.known[w] = self.form(ids.tolist())

    def encode_split(self, texts: list[str]) -> list[list[str]]:
        """The pre-tokens of each text, all of them learnt; equal ones are one object."""
        same: dict[str, str] = {}
        split = []
        for t in texts:
            words = self.pretokens(t)
            split.append(list(map(same.setdefault, words, words)))
        self.learn(same)
        return split

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = self.encode_split(texts)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=np.int32).tolist() for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def load_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def vocabulary_of(definition: str) -> Vocabulary:
    """The vocabulary of a definition, parsed once by each Python worker."""
    return Vocabulary(definition)


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(first column, texts of the second column) of bounded chunks; null texts are empty."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            if texts and held + len(text) > limit:
                yield keys, texts
                keys, texts, held = [], [], 0
            keys.append(key)
            texts.append(text)
            held += len(text)
    if texts:
        yield keys, texts


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids: the ids of each text of docs (doc_id, text)."""
    definition = docs.sparkSession.sparkContext.broadcast(load_definition(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary_of(definition.value))
        for keys, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(codec.encode_batch(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, text: the texts of rows (doc_id, ids); null ids decode to the empty text."""
    definition = encoded.sparkSession.sparkContext.broadcast(load_definition(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary_of(definition.value))
        for batch in batches:
            texts = [codec.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and decoded again, as digests."""
    definition = docs.sparkSession.sparkContext.broadcast(load_definition(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(definition.value)
        token_bytes = vocabulary.token_bytes
        # of each pre-token: its ids as text, and the bytes that they decode to
        codec = Codec(vocabulary, form=lambda ids: (",".join(map(str, ids)), b"".join([token_bytes[i] for i in ids])))
        for keys, texts in chunks(batches):
            split = codec.encode_split(texts)
            known, counts, of_ids, of_text = codec.known, [], [], []
            for words in split:
                parts = [known[w] for w in words]
                ids = ",".join([p[0] for p in parts])
                counts.append(ids.count(",") + 1 if words else 0)
                of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                text = b"".join([p[1] for p in parts]).decode("utf-8", "replace")
                of_text.append(hashlib.sha256(text.encode()).hexdigest())
            del split
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every text of documents with the public 50k byte-level vocabulary."""
    import public_tokenizers

    from .common import table

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
