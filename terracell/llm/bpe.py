"""Byte-pair encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over all tokens' bytes finds the longest token at every place of a piece.
The encoder takes the longest token that is compatible with the one before: two neighbours are
compatible when undoing their merges from the last one backwards never shows a merge across their
border that would have come first. Where no token fits, it steps back and marks the place as dead,
so every place is left at most once and the time is linear in the piece. The result is exactly what
merging in rank order gives.

Decoding gathers the tokens' bytes from one string by a table of offsets, a batch at a time.

Everything is per row: rows stream through Arrow batches in tasks that Spark deals out, no shuffle.
Pieces of up to 64 characters are remembered in tables of bounded size, their ids packed. Batches are small, so that
a worker's memory is that of its tables.

Defined results: a null text counts as empty and has no ids; null ids decode to the empty text; an id
outside the vocabulary raises; bytes that are no UTF-8 decode to the replacement character. Texts of
any length are read whole. Extra columns pass through, a column named like the result is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from terracell.llm.common import fresh, in_small_batches, replace_columns, whole

#: Rule that cuts a text into pieces (fixed value of byte-level vocabularies).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the rule above means it (Unicode's property, fixed value).
BLANK = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A first cut at places where the rule above always cuts: white space, with the one space before a
#: word, and a stop after a letter or digit.
RUNS = rf" ?[^{BLANK}.,;!?|]+(?<=[A-Za-z0-9])(?=[.,;!?|])| ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
#: Bounds of what a worker remembers: runs, pieces of runs, pairs of tokens.
REMEMBERED = 400_000
REMEMBERED_PIECES = 60_000
REMEMBERED_PAIRS = 200_000
#: Documents, and ids, that are worked on at a time.
SLICE_ROWS = 500
GATHERED = 200_000
LONGEST_REMEMBERED = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: itself if visible, else the next
    unused one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Remembered(dict):
    """Packed ids by string, computed when missing; of two halves the older one goes when the younger is full."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most // 2
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.encode(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class BytePairs:
    """Tables of one vocabulary: token bytes, merges, last merge of each token."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        letters = byte_letters()
        self.added = added
        self.token = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if i not in added.values()}
        self.id_of = {b: i for i, b in self.token.items()}
        self.rank = dict.fromkeys(self.token, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = both
            if self.rank[both] < 0:
                self.rank[both], self.halves[both] = r, (left, right)
        self.fit: dict[tuple[int, int], bool] = {}
        self.pieces = Remembered(lambda piece: self.packed(self.encode_piece(piece.encode("utf-8"))), REMEMBERED_PIECES)
        self.runs = Remembered(self.encode_run, REMEMBERED)
        self.automaton = None
        self.cut = None

    @classmethod
    def from_json(cls, text: str) -> BytePairs:
        d = json.loads(text)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"]]
        return cls(d["model"]["vocab"], merges, {t["content"]: t["id"] for t in d["added_tokens"]})

    def ready(self) -> None:
        """Builds what only encoding needs."""
        if self.automaton is not None:
            return
        import ahocorasick
        import regex

        self.automaton = ahocorasick.Automaton()
        for i, b in self.token.items():
            if b and (len(b) == 1 or i in self.halves):
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size = [len(self.token.get(i, b"")) for i in range(max(self.token) + 1)]
        self.alone = [array("i", [i]).tobytes() for i in range(max(self.token) + 1)]
        self.shorter = self.prefixes()
        self.cut, self.cut_runs = regex.compile(PIECES), re.compile(RUNS)
        self.apart = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")

    def prefixes(self) -> list[int | None]:
        """By id: the longest token that is a proper prefix of the token."""
        out: list[int | None] = [None] * (max(self.token) + 1)
        for i, b in self.token.items():
            for n in range(len(b) - 1, 0, -1):
                j = self.id_of.get(b[:n])
                if j is not None and (n == 1 or j in self.halves):
                    out[i] = j
                    break
        return out

    def compatible(self, a: int, b: int) -> bool:
        """``stay_apart``, remembered."""
        if len(self.fit) >= REMEMBERED_PAIRS:
            self.fit.clear()
        known = self.fit[a, b] = self.stay_apart(a, b)
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging in rank order leaves the border between ``a`` and ``b`` alone.

        Of two equal ranks the left merge comes first: one across the border comes before an equal
        one in ``b`` and after an equal one in ``a``.
        """
        bound = float("inf")
        while True:
            across = self.merged.get((a, b))
            if across is not None and self.rank[across] < bound:
                return False
            in_a, in_b = self.rank[a], self.rank[b]
            if in_a < 0 and in_b < 0:
                return True
            if in_a > in_b:
                bound, a = in_a, self.halves[a][1]
            else:
                bound, b = in_b + 1, self.halves[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole_token = self.id_of.get(piece)
        if whole_token in self.halves:
            return [whole_token]  # the longest token at the start, with none before it
        n = len(piece)
        longest: list[int | None] = [None] * (n + 1)
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - self.size[i]
            # matches come by rising end, so the last one that starts here is the longest
            longest[start] = i
        size, shorter, fit = self.size, self.shorter, self.fit
        out: list[int] = []
        dead = bytearray(n + 1)
        at, last, token = 0, -1, longest[0]
        while token is not None:
            end = at + size[token]
            if not dead[end]:
                fits = last < 0 or fit.get((last, token))
                if fits is None:
                    fits = self.compatible(last, token)
                if fits:
                    out.append(token)
                    at, last, token = end, token, longest[end]
                    continue
            token = shorter[token]
            if token is None:
                # no token fits here: the one before has to end elsewhere
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
        return out

    def packed(self, ids: list[int]) -> bytes:
        """Ids as bytes, four each: less than half of a list's memory, and one object for all that is a single token."""
        return self.alone[ids[0]] if len(ids) == 1 else array("i", ids).tobytes()

    def encode_run(self, run: str) -> bytes:
        if (run[1:] if run[0] == " " else run).isalpha():
            return self.packed(self.encode_piece(run.encode("utf-8")))  # letters only are one piece
        return b"".join(map(self.pieces.__getitem__, self.cut.findall(run)))

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.runs.__getitem__, self.cut_runs.findall(text)))

    def encoded(self, text: str) -> np.ndarray:
        """The ids of ``text`` as 32-bit numbers."""
        if not self.apart.search(text):
            return np.frombuffer(self.encode_plain(text), dtype=np.int32)
        parts, at = [], 0
        for m in self.apart.finditer(text):
            parts += [self.encode_plain(text[at : m.start()]), array("i", [self.added[m.group()]]).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*parts, self.encode_plain(text[at:])]), dtype=np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encoded(text).tolist()


def offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All token bytes in the order of ids, and where each id starts; no merges are kept."""
    d, letters = json.loads(text), byte_letters()
    by_id = {i: bytes(letters.get(c, 0) for c in t) for t, i in d["model"]["vocab"].items()}
    by_id |= {t["id"]: t["content"].encode("utf-8") for t in d["added_tokens"]}
    parts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    starts = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=starts[1:])
    return np.frombuffer(b"".join(parts), dtype=np.uint8), starts


@lru_cache(maxsize=2)
def tables(text: str) -> BytePairs:
    """One set of tables for each Python worker and vocabulary."""
    return BytePairs.from_json(text)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def encode_batches(batches: Iterator[pa.RecordBatch], vocabulary, text_col: str, ids_col: str):
    model = tables(vocabulary.value)
    model.ready()
    for batch in sliced(batches):
        texts = batch.column(batch.schema.get_field_index(text_col))
        ids = [model.encoded(t.as_py()) for t in texts]
        offsets = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        kept = [i for i, name in enumerate(batch.schema.names) if name != text_col]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), column], names=[*(batch.schema.names[i] for i in kept), ids_col]
        )


def gathered(ids: np.ndarray, blob: np.ndarray, starts: np.ndarray) -> bytes:
    """The bytes of some ids: each byte's place is its token's start plus its place in the token."""
    sizes = starts[ids + 1] - starts[ids]
    ends = np.cumsum(sizes)
    return blob[np.arange(sizes.sum()) + np.repeat(starts[ids] - (ends - sizes), sizes)].tobytes()


def decode_batches(batches: Iterator[pa.RecordBatch], table, ids_col: str, text_col: str):
    blob, starts = table.value
    for batch in sliced(batches):
        column = batch.column(batch.schema.get_field_index(ids_col))
        lists = pa.concat_arrays([column.cast(pa.list_(pa.int32()))])
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(starts) - 1):
            raise ValueError("an id is not in the vocabulary")
        ends = np.concatenate([[0], np.cumsum(starts[ids + 1] - starts[ids])])
        raw = b"".join(gathered(ids[i : i + GATHERED], blob, starts) for i in range(0, len(ids), GATHERED))
        borders = ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        texts = pa.array(
            [raw[a:b].decode("utf-8", "replace") for a, b in zip(borders[:-1], borders[1:])], pa.string()
        )
        kept = [i for i, name in enumerate(batch.schema.names) if name != ids_col]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), texts], names=[*(batch.schema.names[i] for i in kept), text_col]
        )


def digest_batches(batches: Iterator[pa.RecordBatch], vocabulary, table, text_col: str, names: list[str]):
    """Encodes and decodes a slice at a time; of ids and texts only counts and digests leave the task."""
    model = tables(vocabulary.value)
    model.ready()
    blob, starts = table.value
    numbers = [b"%d," % i for i in range(len(starts) - 1)]
    number_starts = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
    number_blob = np.frombuffer(b"".join(numbers), dtype=np.uint8)

    def told(ids: np.ndarray) -> tuple[int, str, str]:
        of_ids, of_text = hashlib.sha256(), b""
        parts = []
        for i in range(0, len(ids), GATHERED):
            some = ids[i : i + GATHERED]
            digits = gathered(some, number_blob, number_starts)
            of_ids.update(digits if i + GATHERED < len(ids) else digits[:-1])
            parts.append(gathered(some, blob, starts))
        of_text = b"".join(parts).decode("utf-8", "replace").encode("utf-8")
        return len(ids), of_ids.hexdigest(), hashlib.sha256(of_text).hexdigest()

    for batch in sliced(batches):
        texts = batch.column(batch.schema.get_field_index(text_col))
        rows = [told(model.encoded(t.as_py())) for t in texts]
        kept = [i for i, name in enumerate(batch.schema.names) if name != text_col]
        made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), *made], names=[*(batch.schema.names[i] for i in kept), *names]
        )


def digests(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256 and decoded_sha256 of ``encode`` and ``decode`` in place of the text, in one pass.

    One Python worker a task holds the tables, and neither ids nor decoded texts are handed over.
    """
    in_small_batches(df.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    with open(path, encoding="utf-8") as f:
        table = df.sparkSession.sparkContext.broadcast(offsets(f.read()))
    vocabulary = shared_vocabulary(df, path)
    text = whole(text_col)
    work = fresh(df, "text_to_encode")
    df = replace_columns(df.withColumn(work, text).drop(text_col), names)
    fields = [f for f in df.schema.fields if f.name != work] + [
        StructField("n_tokens", LongType(), False), StructField("ids_sha256", StringType(), False), StructField("decoded_sha256", StringType(), False)
    ]
    return df.mapInArrow(lambda batches: digest_batches(batches, vocabulary, table, work, names), StructType(fields))


def shared_vocabulary(df: DataFrame, path: str):
    """The vocabulary file's text, read on the driver; its size is that of the file."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of ``text_col`` (array of int)."""
    in_small_batches(df.sparkSession)
    vocabulary = shared_vocabulary(df, path)
    df = replace_columns(df, [ids_col]) if ids_col != text_col else df
    work = fresh(df, "text_to_encode")
    fields = [*df.schema.fields, StructField(ids_col, ArrayType(IntegerType(), False), False)]
    return df.withColumn(work, whole(text_col)).mapInArrow(
        lambda batches: encode_batches(batches, vocabulary, work, ids_col), StructType(fields)
    )


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col``."""
    in_small_batches(df.sparkSession)
    with open(path, encoding="utf-8") as f:
        table = df.sparkSession.sparkContext.broadcast(offsets(f.read()))
    df = replace_columns(df, [text_col]) if ids_col != text_col else df
    work = fresh(df, "ids_to_decode")
    fields = [*df.schema.fields, StructField(text_col, StringType(), False)]
    return df.withColumn(work, F.col(ids_col)).mapInArrow(
        lambda batches: decode_batches(batches, table, work, text_col), StructType(fields)
    )
