"""Operator 8, best-fit packing: token, document-count and attention capacities choose the bin by residual norm.

Map tasks tokenize whole texts (each white-space-separated chunk once, through a cache) and cut only what is longer than a
sequence. Pieces are dealt to blocks of some thousand sequences by place, so that no key can fill a block; each
block packs its pieces in descending order of length into the feasible bin whose weighted residual (tokens, documents,
attention cost as the sum of squared lengths) has the smallest norm. Every constraint holds in every bin; with the default Capacity
the token limit implies the other two, which bind where a caller sets them lower. Another split of the input deals pieces otherwise. A block leaves about one
bin short, which bounds the loss at one sequence in a thousand.

Defined cases: a null or empty text is its end token alone; repeated rows are packed as rows of their own; a text of any
length is tokenized whole; of bins with equal norms the one that stands first takes the piece, and pieces of equal length
go by key and place; a key is an integer, or a text of one (others are an error); an empty table gives an empty result; columns
other than the key and the text are left out, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.session import ship_package

TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Bytes of text that one packing block aims at: some 2.5 million tokens, 10 MB of ids.
BLOCK_BYTES = 8 << 20
#: Blocks that one task packs one after the other, where the session's partitions are too few.
BLOCKS_A_TASK = 16
#: Chunks in a generation of a worker's cache of token ids: some 90 MB.
CACHE_CHUNKS = 450_000


@dataclass(frozen=True)
class Capacity:
    """Limits of a sequence; weights are those of the residual norm. The defaults bind on tokens alone."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)


def default_tokenizer() -> str:
    """Path of the public tokenizer that production uses."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Ids:
    """Token ids of texts as little-endian 32-bit integers, chunk by chunk through a cache.

    No token spans ASCII white space in a tokenizer that drops it, so that chunks can be tokenized apart. The cache has two
    generations: what is used moves to the young one, and once that is full, the old one goes. It lives as long as the
    worker, so that later tasks start warm.
    """

    _shared: tuple[str, Ids] | None = None

    def __init__(self, definition: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old = Tokenizer.from_str(definition), {}, {}
        parsed = json.loads(definition)
        self.ends = _word_ends(parsed)
        if self.ends is not None:
            # plain words in lower case need neither the normalizer nor the pattern
            parsed["normalizer"] = None
            parsed["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            self.bare = Tokenizer.from_str(json.dumps(parsed))

    @classmethod
    def shared(cls, definition: str) -> Ids:
        if cls._shared is None or cls._shared[0] != definition:
            cls._shared = (definition, cls(definition))
        return cls._shared[1]

    def of(self, texts: list[str | None]) -> list[bytes]:
        chunks = list(map(self._chunks, texts))
        if len(self.young) > CACHE_CHUNKS:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for c in set().union(*chunks).difference(young):
            data = old.get(c)
            if data is None:
                new.append(c)
            else:
                young[c] = data
        self._encode(new)
        return [b"".join(itemgetter(*x)(young)) if len(x) > 1 else b"".join(map(young.__getitem__, x)) for x in chunks]

    def _chunks(self, text: str | None) -> list[bytes]:
        """Parts whose ids follow each other as the text's do. Where words of letters are known, a mark that ends one stands apart."""
        if not text:
            return []
        if self.ends is None:
            return text.encode().split()
        if "<|" in text:  # could become a special token in lower case
            return END_MARK.sub(r" \g<0>", text).encode().split()
        return END_MARK.sub(r" \g<0>", text).encode().lower().split()

    def _encode(self, chunks: list[bytes]) -> None:
        """Adds to the cache what it lacks.

        Where the tokenizer takes each run of letters for a word and marks the last token of a word, distinct words are tokenized
        in one text and parted at their marks; the rest chunk by chunk.
        """
        young, texts = self.young, [c.decode() for c in chunks]
        words = [PLAIN_WORD.fullmatch(t) is not None for t in texts] if self.ends is not None else [False] * len(texts)
        some, keys = [t for t, w in zip(texts, words, strict=True) if w], [c for c, w in zip(chunks, words, strict=True) if w]
        if some:
            ids = np.array(self.bare.encode_batch_fast([" ".join(some).lower()], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) != len(some):
                raise ValueError("the tokenizer's words are not those that its definition promises")
            young.update(zip(keys, map(ids.tobytes().__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
        rest = [(c, t) for c, t, w in zip(chunks, texts, words, strict=True) if not w]
        for (c, _), e in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            young[c] = np.array(e.ids, "<u4").tobytes()


#: Letters that normalisation and lower case leave single letters: ASCII and Latin without the dotted capital I.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
PLAIN_WORD = re.compile(f"[{LETTERS}]+")
#: A mark right behind such a letter and before white space: a word of its own to a tokenizer of letter runs.
END_MARK = re.compile(f"[.,;:!?](?=\\s)(?<=[{LETTERS}][.,;:!?])")
#: Fixed value: the pattern of a word-level tokenizer, one of whose alternatives is a run of letters and another a run of marks.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _word_ends(definition: dict) -> np.ndarray | None:
    """For each id, whether it ends a word; None where words of letters can't be told from the definition."""
    suffix = definition["model"].get("end_of_word_suffix")
    if not suffix or LETTER_RUNS not in json.dumps(definition.get("pre_tokenizer"), ensure_ascii=False).replace("\\\\", "\\") or "Lowercase" not in json.dumps(definition.get("normalizer")):
        return None
    vocabulary = definition["model"]["vocab"]
    ends = np.zeros(max(vocabulary.values()) + 1 + len(definition.get("added_tokens", [])), bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return ends


PIECES = "key long, piece int, start long, length long, token_ids binary, block int"


def _pieces(definition: str, most: int, end: bytes, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, seen = Ids.shared(definition), TaskContext.get().partitionId(), 0
        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                out = {n: [] for n in ("key", "piece", "start", "length", "token_ids", "block")}
                for key, data in zip(b.column("key").to_pylist(), ids.of(b.column("text").to_pylist()), strict=True):
                    data += end
                    for piece, start in enumerate(range(0, len(data), 4 * most)):
                        cut = data[start : start + 4 * most]
                        # dealt by place in the input, which a rerun finds again; any key spreads over all blocks
                        for n, x in zip(out, (key, piece, start // 4, len(cut) // 4, cut, (part * 40_503 + seen) % blocks), strict=True):
                            out[n].append(x)
                        seen += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[n], t) for n, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], list(out)
                )

    return run


def best_fit(lengths: np.ndarray, capacity: Capacity) -> np.ndarray:
    """The bin of each piece; lengths in descending order. Opens a bin only where no open one has room in every dimension."""
    full = (capacity.tokens, capacity.documents, capacity.attention)
    by_tokens, by_documents, by_attention = (w / f**2 for w, f in zip(capacity.weights, full, strict=True))
    # what each bin has left; open bins stand first, closed ones are overwritten by the last
    tokens, documents, attention = np.empty(len(lengths)), np.empty(len(lengths)), np.empty(len(lengths))
    name = np.empty(len(lengths), np.int64)
    n_open, bins, out = 0, 0, np.empty(len(lengths), np.int64)
    smallest = int(lengths.min()) if len(lengths) else 0
    for i, length in enumerate(lengths.tolist()):
        cost = length * length
        if length > full[0] or cost > full[2] or full[1] < 1:
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        at = -1
        if n_open:
            t = tokens[:n_open] - length
            fits = np.flatnonzero(t >= 0)
            if len(fits):
                t, d, a = t[fits], documents[fits] - 1, attention[fits] - cost
                norm = by_tokens * t * t + by_documents * d * d + by_attention * a * a
                norm[(d < 0) | (a < 0)] = np.inf
                best = int(norm.argmin())
                at = int(fits[best]) if norm[best] < np.inf else -1
        if at < 0:
            at, n_open = n_open, n_open + 1
            tokens[at], documents[at], attention[at], name[at] = *full, bins
            bins += 1
        out[i] = name[at]
        tokens[at] -= length
        documents[at] -= 1
        attention[at] -= cost
        if tokens[at] < smallest or documents[at] < 1 or attention[at] < smallest * smallest:  # nothing fits any more
            n_open -= 1
            for x in (tokens, documents, attention, name):
                x[at] = x[n_open]
    return out


PACKED = "key long, piece int, start long, length long, token_ids binary, sequence_id long, offset long"


def _pack(capacity: Capacity):
    def run(group: pa.Table) -> pa.Table:
        length = np.asarray(group.column("length").combine_chunks())
        key = np.asarray(group.column("key").combine_chunks().fill_null(np.iinfo(np.int64).max))
        order = np.lexsort((np.asarray(group.column("piece").combine_chunks()), key, -length))
        bins = best_fit(length[order], capacity)
        by_bin = np.argsort(bins, kind="stable")
        order, bins = order[by_bin], bins[by_bin]
        length = length[order]
        before = np.cumsum(length) - length
        first = np.searchsorted(bins, bins, "left")
        block = int(group.column("block")[0].as_py())
        group = group.take(pa.array(order)).drop_columns(["block"])
        return group.append_column("sequence_id", pa.array((block << 32) + bins)).append_column("offset", pa.array(before - before[first]))

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: Capacity = Capacity(), end_id: int = END_ID) -> DataFrame:
    """(key, piece, start, length, token_ids, sequence_id, offset): the pieces of all documents with their ids and places."""
    ship_package(docs.sparkSession)
    definition = Path(tokenizer or default_tokenizer()).read_text(encoding="utf-8")
    total = docs.agg(F.sum(F.octet_length(F.coalesce(text, F.lit(""))) + 8)).first()[0] or 0
    blocks = max(1, round(total / BLOCK_BYTES))
    made = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        _pieces(definition, capacity.tokens, end_id.to_bytes(4, "little"), blocks), PIECES
    )
    # blocks are dealt evenly by their number, to partitions that grow with them
    parts = max(min(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-blocks // BLOCKS_A_TASK))
    return made.repartitionById(parts, "block").groupBy("block").applyInArrow(_pack(capacity), PACKED).withColumnRenamed("key", key)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "sequence_id", "offset")
