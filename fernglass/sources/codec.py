"""Compressed bodies (A7, A8): zstd frames with trained dictionaries, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

LEVEL = 12
MAGIC = b"\x28\xb5\x2f\xfd"
HARD_FLOOR, MIN_SAMPLES = 8, 20
LADDER = (64 * 1024, 128 * 1024, 256 * 1024, 512 * 1024, 1024 * 1024)


def compress(data: bytes, dictionary: bytes | None = None, level: int = LEVEL) -> bytes:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=held).compress(data)


def expand(frame: bytes, dictionaries: dict[int, bytes] | None = None) -> bytes:
    """The bytes of a frame; what is no frame comes back as it is. A frame of a dictionary that is not held raises."""
    if frame[:4] != MAGIC:
        return frame
    number = zstandard.get_frame_parameters(frame).dict_id
    held = None
    if number:
        if number not in (dictionaries or {}):
            raise KeyError(f"no dictionary {number}")
        held = zstandard.ZstdCompressionDict(dictionaries[number])
    return zstandard.ZstdDecompressor(dict_data=held).decompressobj().decompress(frame)


@dataclass(frozen=True)
class Trained:
    dict_id: int
    body: bytes
    sample_count: int
    sample_bytes: int


def train(samples: list[bytes], ladder: tuple[int, ...] = LADDER) -> Trained | None:
    """The newest sample (the first) is held out; of the sizes that train, the one that makes it smallest wins, if
    it beats no dictionary. Too few samples, or none that trains, give None."""
    if len(samples) < max(MIN_SAMPLES, HARD_FLOOR):
        return None
    held, rest = samples[0], samples[1:]
    best, least = None, len(compress(held))
    for size in ladder:
        try:
            d = zstandard.train_dictionary(size, rest)
        except zstandard.ZstdError:
            continue
        n = len(compress(held, d.as_bytes()))
        if n < least:
            best, least = d, n
    return None if best is None else Trained(best.dict_id(), best.as_bytes(), len(rest), sum(map(len, rest)))


def compressed(df: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, frame, raw_bytes, stored_bytes) of every body; null stays null."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            frames = [compress(bytes(x)) if x is not None else None for x in b["_b"]]
            yield pd.DataFrame({key: b[key], "frame": frames, "raw_bytes": [len(x) if x is not None else None for x in b["_b"]], "stored_bytes": [len(f) if f is not None else None for f in frames]})

    return df.select(key, F.col(body).alias("_b")).mapInPandas(run, f"{key} {kind}, frame binary, raw_bytes long, stored_bytes long")


def trained(samples: DataFrame, key: str, order: list[str], body: str = "body") -> DataFrame:
    """A8 for every key: (key, dict_id, dictionary, sample_count, sample_bytes). ``samples`` holds at most a hundred
    bodies of each key (``sweeps.samples``), newest first by ``order``, so a group is small by construction."""
    kind = samples.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=False)
        t = train([bytes(x) for x in pdf[body]])
        rows = [] if t is None else [(pdf[key].iloc[0], t.dict_id, t.body, t.sample_count, t.sample_bytes)]
        return pd.DataFrame(rows, columns=[key, "dict_id", "dictionary", "sample_count", "sample_bytes"])

    return samples.groupBy(key).applyInPandas(run, f"{key} {kind}, dict_id long, dictionary binary, sample_count long, sample_bytes long")
