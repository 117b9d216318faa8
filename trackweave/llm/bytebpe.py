"""Byte-level BPE over Arrow batches: ids, character offsets, and back to bytes.

A vocabulary of ranked byte strings becomes a model of the tokenizers library: bytes are written in its printable byte alphabet,
and every pair of tokens that joins to a token is a merge with that token's rank.  A text is cut by the pattern; each piece is
encoded by itself, once per distinct piece of a task (about `KNOWN` are remembered at most).  Decoding looks up the bytes of
each id, so characters split over several tokens come back whole; bytes that are not UTF-8 stay as they are.

Defined cases: a null text is empty; an empty text has no ids; an id outside the vocabulary is an error; output columns replace
input columns of the same name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from trackweave.llm.words import Remembered, encoded, slices, span_hashes, text_buffer

KNOWN = 1 << 17


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next free one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    own, letter = ranks(path), byte_alphabet()
    text = {token: "".join(letter[b] for b in token) for token in own}
    merges = [(text[token[:i]], text[token[i:]]) for token in sorted(own, key=own.get) for i in range(1, len(token)) if token[:i] in own and token[i:] in own]
    made = Tokenizer(models.BPE({text[token]: rank for token, rank in own.items()}, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made


@lru_cache(2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in a row by id, and where each starts."""
    own = sorted((rank, token) for token, rank in ranks(path).items())
    size = np.zeros(own[-1][0] + 2, np.int64)
    size[np.array([rank for rank, _ in own]) + 1] = [len(token) for _, token in own]
    return np.frombuffer(b"".join(token for _, token in own), np.uint8), np.cumsum(size)


#: After a space these bytes never start white space, so a piece of the pattern starts at the space.
STARTS = np.zeros(256, bool)
STARTS[[*range(0x21, 0x7F), *range(0xC3, 0xE0)]] = True


def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of runs of whole pieces: texts cut before every space that certainly starts a piece."""
    edge = np.zeros(len(buf) + 1, bool)
    edge[:-2] = (buf[:-1] == 0x20) & STARTS[buf[1:]] if len(buf) > 1 else False
    edge[offsets] = True
    start = np.flatnonzero(edge[:-1])
    return start, np.append(start[1:], len(buf))[:len(start)], np.searchsorted(offsets, start, "right") - 1


def _encoded(path: str, pattern: str, offsets: bool, back: bool = False):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, cut = tokenizer(path), regex.compile(pattern)
        def work(strings: list[bytes]) -> list[list[int]]:
            parts = [cut.findall(s.decode()) for s in strings]
            distinct = list({p for own in parts for p in own})
            pieces = dict(zip(distinct, encoded(model, distinct)))
            return [pieces[own[0]] if len(own) == 1 else [i for p in own for i in pieces[p]] for own in parts]

        known = Remembered(work, KNOWN)
        for text in texts:
            values, counts, chars = [np.zeros(0, np.int32)], [], [np.zeros(0, np.int32)]
            for part in slices(pa.record_batch({"text": text})):
                buf, bounds = text_buffer(part.column("text"))
                start, end, own = units(buf, bounds)
                size, ids = known.lists(buf, start, end, span_hashes(buf, start, end))
                count = np.bincount(own, weights=size, minlength=part.num_rows).astype(np.int64)
                values.append(ids)
                counts.append(count)
                if offsets:
                    cuts = np.append(0, np.cumsum(count))
                    chars += [char_starts(path, ids[a:b], t) for a, b, t in zip(cuts[:-1], cuts[1:], part.column("text").to_pylist())]
            at = np.append(0, np.cumsum(np.concatenate(counts) if counts else [])).astype(np.int32)
            out = {"ids": pa.ListArray.from_arrays(at, np.concatenate(values))}
            if offsets:
                out["char_start"] = pa.ListArray.from_arrays(at, np.concatenate(chars))
            if back:
                out["decoded"] = decoded_lists(path, out["ids"])
            yield pa.StructArray.from_arrays(list(out.values()), names=list(out))
    return run


def char_starts(path: str, ids: np.ndarray, text: str | None) -> np.ndarray:
    """The character in which each token's first byte lies."""
    start = byte_table(path)[1]
    first = np.append(0, np.cumsum(start[ids + 1] - start[ids]))[:-1]
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return (np.cumsum((raw & 0xC0) != 0x80) - 1)[first].astype(np.int32) if len(ids) else np.zeros(0, np.int32)


def decoded_lists(path: str, column: pa.Array) -> pa.Array:
    """The bytes of every list of ids, about a million ids at a time."""
    data, start = byte_table(path)
    column = pc.fill_null(column, [])
    ids, bounds = np.asarray(column.flatten()), np.asarray(column.offsets).astype(np.int64)
    bounds = bounds - bounds[0]
    out, a = [], 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + (1 << 20), "right")) - 1)
        own = ids[bounds[a]:bounds[b]].astype(np.int64)
        size = start[own + 1] - start[own]
        total = np.append(0, np.cumsum(size))
        raw = data[np.arange(total[-1]) + np.repeat(start[own] - total[:-1], size)].tobytes()
        edge = total[bounds[a:b + 1] - bounds[a]]
        out += [raw[x:y] for x, y in zip(edge[:-1], edge[1:])]
        a = b
    return pa.array(out, pa.binary())


def _decoded(path: str):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield decoded_lists(path, column)
    return run


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", offsets: bool = True, back: bool = False) -> DataFrame:
    """All rows and columns of `docs` with ids (array of int) and, if asked for, char_start (array of int) and, decoded from the
    ids in the same task, decoded (binary)."""
    types = {"ids": "array<int>"} | ({"char_start": "array<int>"} if offsets else {}) | ({"decoded": "binary"} if back else {})

    def read(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _encoded(path, pattern, offsets, back)(it)

    done = F.arrow_udf(read, f"struct<{', '.join(f'{n}: {t}' for n, t in types.items())}>")
    return docs.withColumn("__tw_ids", done(column)).select(*[c for c in docs.columns if c not in types], *[F.col(f"__tw_ids.{n}").alias(n) for n in types])


def decode(ids: Column | str, path: str) -> Column:
    """The bytes of an array of ids; no bytes for null."""
    def read(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _decoded(path)(it)

    return F.arrow_udf(read, "binary")(ids)
