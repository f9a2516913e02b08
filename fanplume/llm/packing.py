"""Packing of tokenised documents into training sequences of equal cost."""

from __future__ import annotations

import importlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanplume.llm.common import sliced


def vocabulary_path(file: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary `file` lies on this machine."""
    return importlib.import_module("public_tokenizers").path(file)


#: Fixed value: how byte-level pre-tokenizers cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The byte that each character of a byte-level token's name stands for (the rule of public byte-level vocabularies:
    printable Latin-1 stands for itself, the other bytes for the code points from 256 on)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TextEncoder:
    """Token ids of whole texts, as bytes of little-endian uint32: those that the library `tokenizers` gives for the
    vocabulary file without added special tokens, so control strings in a text that the file lists become their ids.

    Where the file is a plain byte-level BPE whose ids follow the order of its merges, `tiktoken` encodes by the same
    merges in a third of the time (the tests compare the two over all code points); any other file is left to
    `tokenizers` itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = _by_merges(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.merges is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [self._merged(t) for t in texts]

    def _merged(self, text: str) -> bytes:
        try:
            ids = self.merges.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # white space of about a million characters is more than its pattern can step back over
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        return ids.astype("<u4", copy=False).tobytes()


def _by_merges(path: str):
    """The vocabulary as a tiktoken encoding, or None where it isn't a plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cut, added = file["model"], file.get("pre_tokenizer") or {}, file.get("added_tokens", [])
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and file.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if not plain or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        return None
    special = {a["content"]: a["id"] for a in added}
    names = byte_names()
    ranks = {bytes(map(names.__getitem__, token)): i for token, i in model["vocab"].items() if token not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in pairs]
    if order != sorted(order) or len(set(order)) != len(order) or len(ranks) != 256 + len(order) or min(order, default=256) < 256:
        return None  # ids must tell which merge comes first
    import tiktoken

    return tiktoken.Encoding("of file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


_tokenizers: dict[str | None, TextEncoder] = {}


def tokenizer_at(path: str | None) -> TextEncoder:
    """One tokenizer per Python worker. Without a path, the place of the public vocabulary is looked up where it runs."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    if path not in _tokenizers:
        _tokenizers[path] = TextEncoder(path or vocabulary_path())
    return _tokenizers[path]


@dataclass(frozen=True)
class Cost:
    """Attention cost of a piece of n tokens: linear * n + quadratic * n^2."""

    linear: float = 1.0
    quadratic: float = 1.0 / 1024

    def of(self, n):
        return self.linear * n + self.quadratic * n * n


def capacities(tokens: int, length: int) -> list[int]:
    """Sequence sizes that hold exactly `tokens`: full ones, then the powers of two of what is left."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_block(sizes: np.ndarray, length: int, cost: Cost) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, size, sequence, offset) of documents of the given sizes.

    Documents come in descending size; whole sequences are cut off the front of longer ones. Each goes to the
    sequence of least cost so far among those with room for all of it. Where none has room, the sequence with the
    most room is filled and the rest of the document goes on. Sequences are as many as the tokens need; the rest of a
    block that fills no whole sequence goes to shorter ones, each a power of two, so no token is padding.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    start = np.zeros(len(sizes), np.int64)
    sequence = 0
    for d in np.flatnonzero(sizes >= length):
        for _ in range(int(sizes[d]) // length):
            pieces.append((int(d), int(start[d]), length, sequence, 0))
            start[d] += length
            sequence += 1
    left = sizes - start
    room = np.array(capacities(int(left.sum()), length), np.int64)
    spent = np.zeros(len(room))
    used = np.zeros(len(room), np.int64)
    for d in np.argsort(-left, kind="stable"):
        need, at = int(left[d]), int(start[d])
        while need:
            fits = np.where(room >= need, spent, np.inf)
            k = int(fits.argmin())
            if room[k] < need:
                k = int(room.argmax())
            n = min(need, int(room[k]))
            pieces.append((int(d), at, n, sequence + k, int(used[k])))
            room[k] -= n
            used[k] += n
            spent[k] += cost.of(n)
            need, at = need - n, at + n
    return pieces


PIECES = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 1,
    tokenizer_path: str | None = None,
    block_tokens: int = 2_000_000,
    cost: Cost = Cost(),
    with_ids: bool = True,
) -> DataFrame:
    """Pack whole documents, each followed by `end_id`, into sequences of at most `length` tokens of balanced cost.

    Every task packs its own rows in blocks of about `block_tokens`, so nothing is shuffled and memory doesn't grow
    with the input; a task that is run again on the same rows gives the same pieces. Each block ends in at most
    log2(length) sequences shorter than `length`. A sequence id holds the number of the partition above its lowest 36
    bits.

    Returns a row per piece: the id, start (tokens of the document before it), length, ids (little-endian uint32;
    null without `with_ids`), ids_crc32, doc_tokens (with the end id), sequence_id and offset (place in the sequence,
    gapless from 0). Other columns are not returned. Null and empty texts are the end id alone; rows that repeat an
    id are packed one by one; a null id stays null.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), *PIECES.fields, T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        ids: list = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, tokens, held, sequence
            sizes = np.array([len(x) // 4 for x in tokens], np.int64)
            pieces = pack_block(sizes, length, cost)
            cut = [tokens[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            d, s, n, q, o = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            out = [
                pa.concat_arrays(ids).take(pa.array(d)), pa.array(s), pa.array(n), pa.array(cut if with_ids else [None] * len(cut), pa.binary()),
                pa.array(sizes[d]), pa.array(sequence + q), pa.array(o), pa.array([zlib.crc32(x) for x in cut], pa.int64()),
            ]
            sequence += int(q.max()) + 1
            ids, tokens, held = [], [], 0
            return pa.RecordBatch.from_arrays(out, schema.names)

        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                new = [x + end for x in tokenizer.encode([t or "" for t in texts[at : at + 256]])]
                ids.append(batch.column(0).slice(at, len(new)))
                tokens += new
                held += sum(map(len, new)) // 4
                if held >= block_tokens:
                    yield flush()
        if tokens:
            yield flush()

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
