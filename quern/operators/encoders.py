"""Texts into vectors: the protocol, a hashing encoder, and static token embeddings read from a model's files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import IDENTIFIER, SYNONYMS

#: Texts that are encoded at once.
BATCH = 1024
#: Tokens of a text that count.
TOKENS = 512
FILES = ("tokenizer.json", "model.safetensors", "config.json")


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """One row of ``dim`` numbers per text."""


_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[A-Z][a-z])")


def _parts(word: str) -> list[str]:
    low = word.lower()
    pieces = [p for p in low.split("_") if p] if "_" in word else [p.lower() for p in _CAMEL.split(word)]
    return [low, *pieces]


def _variants(t: str) -> list[str]:
    out = [t]
    # Most tokens have none of the endings, which their last letter tells.
    if t[-1:] in "sgd":
        for least, end, makes in ((4, "ies", ("y",)), (4, "es", ("",)), (3, "s", ("",)), (5, "ing", ("", "e")), (4, "ed", ("", "e"))):
            if len(t) > least and t.endswith(end):
                out += [t[: -len(end)] + x for x in makes]
    if "seriali" in t:
        out += [t.replace(a, b) for a, b in (("serialis", "serializ"), ("serializ", "serialis")) if a in t]
    return out + ([SYNONYMS[t]] if t in SYNONYMS else [])


def tokenize(text: str) -> list[str]:
    """The distinct tokens of a text, as the index makes them."""
    words = re.findall(IDENTIFIER, text)
    return list(dict.fromkeys(v for w in words for p in _parts(w) for v in _variants(p)))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows that are next to zero stay as they are."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms > 1e-8, norms, 1.0)


class HashingEncoder:
    """Signed counts of hashed tokens, the same as the engine's built-in vectors."""

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for t in tokenize(text):
                h = hashlib.md5(t.encode()).hexdigest()
                row[int(h[:8], 16) % self.dim] += 1 if h[8] < "8" else -1
        return unit_rows(out)


def model_status(folder: str) -> dict:
    """Which of a model's files are there, and a digest of them all if none is missing."""
    found = {n: os.path.isfile(os.path.join(folder, n)) for n in FILES}
    digest = hashlib.sha256(folder.encode())
    if all(found.values()):
        for n in FILES:
            with open(os.path.join(folder, n), "rb") as f:
                digest.update(n.encode() + f.read())
    return {"folder": folder, "files": found, "available": all(found.values()), "fingerprint": digest.hexdigest() if all(found.values()) else None}


def read_tensors(path: str) -> dict[str, np.ndarray]:
    """The tensors of a safetensors file: eight bytes of length, a JSON header, the data."""
    kinds = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "U64": "<u8", "U32": "<u4"}
    with open(path, "rb") as f:
        (size,) = struct.unpack("<Q", f.read(8))
        header, data = json.loads(f.read(size)), f.read()
    out = {}
    for name, entry in header.items():
        if name != "__metadata__":
            if entry["dtype"] not in kinds:
                raise ValueError(f"unsupported tensor type {entry['dtype']}")
            a, b = entry["data_offsets"]
            out[name] = np.frombuffer(data[a:b], dtype=kinds[entry["dtype"]]).reshape(entry["shape"])
    return out


class StaticEncoder:
    """The weighted mean of token embeddings.  Tokens come from the model's tokenizer; unknown ones do not count."""

    def __init__(self, folder: str) -> None:
        status = model_status(folder)
        if not status["available"]:
            raise FileNotFoundError(f"model files missing in {folder}: {[n for n, there in status['files'].items() if not there]}")
        from tokenizers import Tokenizer

        self.folder, self.fingerprint = folder, status["fingerprint"]
        self.tokenizer = Tokenizer.from_file(os.path.join(folder, FILES[0]))
        tensors = read_tensors(os.path.join(folder, FILES[1]))
        self.table = tensors["embeddings"].astype(np.float32)
        if self.table.ndim != 2:
            raise ValueError("embeddings must be a matrix")
        self.weights = tensors["weights"].astype(np.float32).ravel() if "weights" in tensors else None
        self.mapping = tensors["mapping"].astype(np.int64).ravel() if "mapping" in tensors else None
        with open(os.path.join(folder, FILES[2]), encoding="utf-8") as f:
            self.normalize = json.load(f).get("normalize", True)
        lengths = sorted(len(t.encode()) for t in self.tokenizer.get_vocab(False))
        self.letters = TOKENS * (lengths[len(lengths) // 2] if lengths else 1)
        unknown = (json.loads(self.tokenizer.to_str()).get("model") or {}).get("unk_token")
        self.unknown = self.tokenizer.token_to_id(unknown) if unknown is not None else None
        if unknown is not None and self.unknown is None:
            raise ValueError(f"unknown token {unknown!r} is not in the vocabulary")
        self.dim = self.table.shape[1]

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, e in zip(out, self.tokenizer.encode_batch([t[: self.letters] for t in texts], add_special_tokens=False)):
            ids = np.array([i for i in e.ids if i != self.unknown][:TOKENS], dtype=np.int64)
            rows = ids
            if self.mapping is not None:
                known = ids < len(self.mapping)
                rows = np.where(known, self.mapping[np.where(known, ids, 0)], ids)
            inside = rows < len(self.table)
            if inside.any():
                scale = np.ones(len(ids), dtype=np.float32)
                if self.weights is not None:
                    weighed = ids < len(self.weights)
                    scale[weighed] = self.weights[ids[weighed]]
                row[:] = (self.table[rows[inside]] * scale[inside, None]).sum(axis=0) / inside.sum()
        return unit_rows(out) if self.normalize else out


def encode_texts(rows: DataFrame, encoder: Encoder, key: str, text: str) -> DataFrame:
    """``(key, v)``: unit vectors of the texts, ``BATCH`` at a time; a null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                v = unit_rows(np.asarray(encoder.encode([t or "" for t in part.column(1).to_pylist()]), dtype=np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(np.arange(0, v.size + 1, encoder.dim, dtype=np.int32), v.ravel())], names=[key, "v"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"{key} {kind}, v array<double>")
