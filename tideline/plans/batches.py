"""Batches for a model: entities packed by padded size, and their tokens as arrays of equal length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Entities, and cells with padding, that one call of a model gets at most; a longer sequence is a batch of its own.
MOST_ITEMS = 64
MOST_CELLS = 1 << 17
#: Ids of names and texts; 0 is the padding's and that of what is not there.
VOCABULARY = 1 << 16


def packed(lengths: np.ndarray, most_items: int = MOST_ITEMS, most_cells: int = MOST_CELLS) -> Iterator[np.ndarray]:
    """Places of the sequences of each batch. Sequences of like length go together, so padding stays small."""
    batch: list[int] = []
    for k in np.argsort(lengths, kind="stable").tolist():
        if batch and (len(batch) >= most_items or (len(batch) + 1) * int(lengths[k]) > most_cells):
            yield np.array(batch)
            batch = []
        batch.append(k)
    if batch:
        yield np.array(batch)


def name_id(name: str | None, vocabulary: int = VOCABULARY) -> int:
    """The same id for a name in every process."""
    return 0 if name is None else 1 + zlib.crc32(name.encode()) % (vocabulary - 1)


def collated(batch: pd.DataFrame, vocabulary: int = VOCABULARY) -> dict[str, np.ndarray]:
    """(entities, longest) arrays of a batch of token lists: ``mask``, ``code`` (-1 where padded), ``table``, ``column`` and ``text``
    ids, ``z`` (0 where there is no number) and ``target``, which marks the target's token."""
    n, longest = len(batch), max((len(x) for x in batch["code"]), default=0)
    out = {
        "mask": np.zeros((n, longest), bool), "code": np.full((n, longest), -1, np.int8), "z": np.zeros((n, longest), np.float32),
        "target": np.zeros((n, longest), bool), **{c: np.zeros((n, longest), np.int32) for c in ("table", "column", "text")},
    }
    for i, row in enumerate(batch.itertuples(index=False)):
        k = len(row.code)
        out["mask"][i, :k] = True
        out["code"][i, :k] = row.code
        out["z"][i, :k] = np.nan_to_num(np.array(row.z, np.float32))
        out["target"][i, :k] = [x == "target" for x in row.kind]
        out["table"][i, :k] = [name_id(t, vocabulary) for t in row.tbl]
        out["column"][i, :k] = [name_id(f"{t}.{c}", vocabulary) for t, c in zip(row.tbl, row.col, strict=True)]
        out["text"][i, :k] = [name_id(t, vocabulary) for t in row.text]
    return out
