"""BPE encoding and decoding with forced-boundary splitting."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfuse.llm.common import table

#: How a byte-level vocabulary's pre-tokenizer cuts text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pieces whose ids a worker remembers; the memory starts anew when full, which changes no result.
REMEMBERED = 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def check_supported(spec: dict) -> None:
    """Raises on a tokenizer file with a feature that would need other cuts or merges than these."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    problems = {
        "a model other than BPE": model.get("type", "BPE") != "BPE",
        "a normalizer": spec.get("normalizer") is not None,
        "a pre-tokenizer other than byte level": pre.get("type") != "ByteLevel" or pre.get("add_prefix_space", True) or not pre.get("use_regex", True),
        "a decoder other than byte level": (spec.get("decoder") or {}).get("type") != "ByteLevel",
        "dropout": bool(model.get("dropout")),
        "an unknown token, affixes, byte fallback or ignored merges": any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "fuse_unk")),
        "added tokens that strip, stand alone or are normalized": any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")),
    }
    if found := [k for k, bad in problems.items() if bad]:
        raise ValueError(f"tokenizer file has {'; '.join(found)}")


class ByteBpe:
    """One worker's view of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        check_supported(spec)
        self.model = Tokenizer.from_file(path).model
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        #: Byte pairs that occur inside a token; between any other two bytes no merge can reach across, so a cut there is certain.
        self.joint: set[str] = set()
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
            self.joint.update(token[k : k + 2] for k in range(len(token) - 1))
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.letters = {b: c for b, c in enumerate(letters)}
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, tuple[int, ...]] = {}

    def fragments(self, piece: str) -> list[str]:
        """The piece in byte letters, cut wherever its byte pair occurs in no token."""
        s = piece.encode().decode("latin-1").translate(self.letters)
        cuts = [0, *(k + 1 for k in range(len(s) - 1) if s[k : k + 2] not in self.joint), len(s)]
        return [s[a:b] for a, b in zip(cuts, cuts[1:])]

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            ids = tuple(t.id for f in self.fragments(piece) for t in self.model.tokenize(f))
            if len(piece) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        parts = self.cut_added.split(text) if self.cut_added else [text]
        runs = (((self.added[p],),) if p in self.added else map(self.piece_ids, self.pieces.findall(p)) for p in parts)
        return np.fromiter(chain.from_iterable(chain.from_iterable(runs)), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                ids = [bpe.encode(t.as_py() or "") for t in batch.column(1)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)) if ids else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return run


def _decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [bpe.decode(x.values.to_numpy()) if x.is_valid else "" for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every whole text, as the tokenizer file's own library gives them without special tokens added.

    docs: doc_id, text; other columns are not read. Null text counts as empty and has no ids; repeated rows each have theirs; an empty
    table gives an empty result. The string of an added token inside a text becomes that token, as in the library. A narrow map: no
    shuffle, and memory for one slice of 256 texts at a time. path must be readable on every executor.
    """
    return docs.select("doc_id", "text").mapInArrow(_encoder(path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded`, the text of the ids; bytes that are no UTF-8 become replacement characters, null ids an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    out = decode(encode(docs, path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_path())
