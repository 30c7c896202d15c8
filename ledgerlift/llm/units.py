"""Token counts of whole texts by the tokenizers library, remembered per unit.

A text is cut at single spaces between two characters that are no white space; a unit keeps the space before it. There a new piece of a
byte-level pattern starts, so a unit has the same tokens in any text and each distinct one is encoded once. Texts with other white space
beside a space, with an added token's string or a NUL are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlift.llm.common import on_workers

KEPT_UNITS = 1_000_000  # whose counts a worker remembers
JOINED = 5_000          # new units that are encoded as one text
SLICE = 500             # texts that are counted at once


class UnitCounts:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = ["\0", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        # byte-level entries have a character per byte
        self.lens = np.array([len(self.tokenizer.id_to_token(k) or "") for k in range(self.tokenizer.get_vocab_size())], np.int64)
        self.seen: dict[str, int] = {}  # tokens of a unit; -1 if a text that holds it is to be encoded whole

    def _learn(self, units: set[str]) -> None:
        if len(self.seen) + len(units) > KEPT_UNITS:
            self.seen.clear()
        new = [u for u in units if u not in self.seen]
        words = [u[1:] if u[0] == " " else u for u in new]
        loose = [not w or w[0].isspace() or w[-1].isspace() for w in words]
        self.seen.update((u, -1) for u in compress(new, loose))
        inner = [u for u, no in zip(new, loose) if not no and u[0] == " "]
        self._alone([u for u, no in zip(new, loose) if not no and u[0] != " "])
        for at in range(0, len(inner), JOINED):  # one after the other they are a text that is cut at the same spaces
            part = inner[at:at + JOINED]
            whole = "".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum(self.lens[ids])
            mine = np.cumsum(np.fromiter((len(u.encode()) for u in part), np.int64, len(part)))
            last = np.searchsorted(ends, mine)
            if ends[-1] == mine[-1] and (ends[last] == mine).all():
                self.seen.update(zip(part, np.diff(last, prepend=-1).tolist()))
            else:
                self._alone(part)

    def _alone(self, units: list[str]) -> None:
        self.seen.update((u, len(e.ids)) for u, e in zip(units, self.tokenizer.encode_batch_fast(units, add_special_tokens=False)))

    def count(self, texts: list[str | None]) -> np.ndarray:
        units = [[] if not t or any(w in t for w in self.whole) else t.replace(" ", "\0 ").removeprefix("\0").split("\0") for t in texts]
        self._learn(set(chain.from_iterable(units)))
        n = np.fromiter(map(len, units), np.int64, len(units))
        counts = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(units)), np.int64, int(n.sum()))
        ends = np.cumsum(n)
        sums, loose = (np.concatenate(([0], np.cumsum(x))) for x in (counts, counts < 0))
        out = sums[ends] - sums[ends - n]
        alone = [k for k, t in enumerate(texts) if t and (not n[k] or loose[ends[k]] > loose[ends[k] - n[k]])]
        for k in alone:
            out[k] = len(self.tokenizer.encode(texts[k], add_special_tokens=False).ids)
        return out


@cache
def unit_counts(path: str) -> UnitCounts:
    return UnitCounts(path)


def with_token_counts(rows: DataFrame, path: str) -> DataFrame:
    """rows (their column `text` holds texts) with n_tokens and without text."""
    on_workers(rows.sparkSession)
    names = [c for c in rows.columns if c != "text"]
    schema = rows.select(*names).schema.add("n_tokens", "long")

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = unit_counts(path)
        for rb in tables:
            texts = rb.column("text")
            n = [counts.count(texts.slice(at, SLICE).to_pylist()) for at in range(0, rb.num_rows, SLICE)]
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in names), pa.array(np.concatenate([[], *n]).astype(np.int64))], [*names, "n_tokens"])

    return rows.mapInArrow(run, schema)
