"""Operator 10: cost-balanced packing of documents into token sequences."""

from __future__ import annotations

import json
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Words whose ids a worker remembers: the first ones it meets, among them the frequent ones.
CACHED_WORDS = 800_000
#: Documents that are packed together. A group's remainder is cut into powers of two, so its size only sets how many short sequences there are.
GROUP_DOCS = 4096
GROUP_TOKENS = 4_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, sequence_cost double"


class WordCache(dict):
    """Ids (uint32 bytes) by lower-cased word. White space separates tokens in this tokenizer family, so a text's ids are its words' ids in order.

    A word of letters is one unit for the tokenizer's merges. These are applied by tiktoken's byte-pair coder, which is
    faster on one word: an end byte marks the word's end, the merges' order gives the ranks. All else, and a text that may
    hold special tokens, goes to the tokenizer itself.
    """

    END = b"\xff"  # in no UTF-8 text
    TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # not the apostrophe, which starts contractions

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
        char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        byte = {c: b for b, c in char.items()}
        coded = lambda x: bytes(byte[c] for c in x.removesuffix(suffix)) + self.END * x.endswith(suffix)
        pieces = [(bytes([b]), char[b]) for b in range(256)] + [(bytes([b]) + self.END, char[b] + suffix) for b in range(255)]
        pieces += [(coded(x), x) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]) for x in [a + b]]
        pieces = list(dict(pieces).items())
        self.id_of_rank = np.array([vocab.get(x, 0) for _, x in pieces], dtype="<u4")
        ranks = {x: i for i, (x, _) in enumerate(pieces)}
        self.coder = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    @classmethod
    def here(cls, path: str) -> WordCache:
        """This process's cache for a vocabulary, which outlives the task: Python workers run many."""
        held = sys.modules.setdefault("_word_caches", types.ModuleType("_word_caches")).__dict__
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def ids(self, text: str) -> bytes:
        data = text.encode()
        if b"<|" in data:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, data.lower().split()))  # at ASCII white space, as on bytes

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        stem = text.rstrip(self.TAIL)
        if len(stem) < len(text) and stem.isalpha():
            out = self[stem.encode()] + self[text[len(stem) :].encode()]
        else:
            plain = text if word.isalpha() else "".join(c.lower() for c in unicodedata.normalize("NFC", text))
            if text.isalpha() and plain.isalpha():
                out = self.id_of_rank[self.coder.encode_single_piece(plain.encode() + self.END)].tobytes()
            else:
                out = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self) < CACHED_WORDS:
            self[word] = out
        return out


def cost(lengths, linear: float, quadratic: float):
    """Of one document's piece in a sequence: attention is quadratic within the piece, the rest linear."""
    return linear * lengths + quadratic * lengths * lengths


def pack(tokens: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[float]]:
    """Pieces (document, start, length, sequence, offset) that hold each token once, then the sequences' lengths and costs.

    Whole chunks of `capacity` are sequences. The rests, longest first, each go to the sequence of lowest cost that has
    room for them; a rest for which none has is cut over the sequences with room, the cheapest first. There are just as
    many sequences as the tokens fill; what is over fills sequences whose lengths are powers of two, which need no padding.
    """
    pieces, rests = [], []
    for d, t in enumerate(tokens):
        whole = t - t % capacity
        pieces += [(d, start, capacity, k, 0) for k, start in enumerate(range(0, whole, capacity), len(pieces))]
        if t > whole:
            rests.append((t - whole, d, whole))
    n, total = len(pieces), sum(r[0] for r in rests)
    lengths = [capacity] * (total // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if total % capacity >> b & 1]
    room, spent, cut = np.array(lengths), np.zeros(len(lengths)), []

    def put(s: int, d: int, start: int, length: int) -> None:
        pieces.append((d, start, length, n + s, lengths[s] - int(room[s])))
        room[s] -= length
        spent[s] += cost(length, linear, quadratic)

    for length, d, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        s = int(np.argmin(np.where(room >= length, spent, np.inf)))
        if room[s] >= length:
            put(s, d, start, length)
        else:
            cut.append((length, d, start))
    with_room = iter(np.argsort(np.where(room > 0, spent, np.inf), kind="stable").tolist())
    s = next(with_room, None)
    for length, d, start in cut:
        while length:
            if not room[s]:
                s = next(with_room)
            put(s, d, start, take := min(length, int(room[s])))
            start, length = start + take, length - take
    return pieces, [capacity] * n + lengths, [float(cost(capacity, linear, quadratic))] * n + spent.tolist()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 2048) -> DataFrame:
    """Packs every document of docs (doc_id, text) into sequences of at most `capacity` tokens; a row per piece.

    A document's tokens are its text's ids, without special tokens, then end_id; a null or empty text has end_id alone, a
    null doc_id stays null and repeated rows are packed each by itself. Documents are packed in groups of up to
    GROUP_DOCS documents or GROUP_TOKENS tokens, in the order in which a task reads them: no shuffle, and a task holds one
    group. A group's sequences are filled to the brim, so only sequences of a power of two fall short of the capacity.
    sequence_id has the task's partition in its upper bits. An empty table gives no rows. The other columns of docs,
    whatever their names, are not read.
    """
    if capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, base = WordCache.here(tokenizer), TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4").tobytes()
        doc_ids, streams, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, streams, held, base
            tokens = [len(x) // 4 for x in streams]
            pieces, lengths, costs = pack(tokens, capacity, linear, quadratic)
            d, start, length, sequence, offset = map(list, zip(*pieces, strict=True))
            crc = [zlib.crc32(streams[i][4 * a : 4 * (a + n)]) for i, a, n in zip(d, start, length, strict=True)]
            arrays = [[doc_ids[i] for i in d], start, length, crc, [tokens[i] for i in d], [base + s for s in sequence], offset, [lengths[s] for s in sequence]]
            out = [pa.array(x, pa.int64()) for x in arrays] + [pa.array([costs[s] for s in sequence], pa.float64())]
            base += len(lengths)
            doc_ids, streams, held = [], [], 0
            return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                streams.append((cache.ids(text.as_py()) if text.is_valid else b"") + end)
                doc_ids.append(d)
                held += len(streams[-1]) // 4
                if len(streams) >= GROUP_DOCS or held >= GROUP_TOKENS:
                    yield flush()
        if streams:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
