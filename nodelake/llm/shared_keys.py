"""Which 64-bit keys occur with two or more owners.

Used as the first digit of a join or sort over very many keys: most keys have one owner and are
closed here, so that only the rest goes on. Keys travel packed (6 bytes each and the owners of a
batch once), dealt to buckets by their high half; the low half tells keys apart within a bucket (callers
let the number of buckets follow the size of the corpus, so that a bucket holds some million keys). Two
keys that agree in both only make a candidate that a later exact step refuses; an owner's keys are
counted before they are coded.

A key that many owners of one batch share is sent once for the batch, with its count; its owners are
told at once. So a key that a third of all rows hold costs one record for a batch, in any bucket.

Answers may go back packed as well (``packed``, ``delivered``): a record for each bucket and part of the owners
in place of a row for each bucket and owner, and one row for each owner at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SENT = "bucket int, owner long, keys binary, at binary, owners binary, counts binary"
FOUND = "owner long, keys binary, counts binary"

#: (owner of each key, key): int64 and uint64 arrays of one length.
Keys = Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]


def code(keys: np.ndarray, buckets: int) -> np.ndarray:
    """What is kept of a key: its bucket in the high half, its own low half."""
    return ((keys >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (keys & np.uint64(0xFFFFFFFF))


def runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, and the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.array([0])


def per_owner(owner: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """owner and the bytes of its part of each array."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], [v[order] for v in values]
    cut = runs(owner)
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        yield int(owner[lo]), *[v[lo:hi].tobytes() for v in values]


#: Answers on their way: the owners of a part, how many values each has, and the values.
ANSWERS = "part int, kind int, owners binary, sizes binary, values binary"
ANSWER_NAMES, ANSWER_TYPES = [x.split()[0] for x in ANSWERS.split(", ")], [pa.int32(), pa.int32(), *[pa.binary()] * 3]
#: kind of a row without an owner.
ALL = -1


def packed(owner: np.ndarray, values: np.ndarray, parts: int, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """Answers to owners (hashes), a record for each part of them."""
    part = (owner.astype(np.int64).view(np.uint64) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((owner, part))
    owner, values, part = owner[order], values[order], part[order]
    cut = runs(part)
    out = []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        own = runs(owner[lo:hi])
        out.append((int(part[lo]), kind, owner[lo:hi][own[:-1]].astype("<i8").tobytes(), np.diff(own).astype("<u4").tobytes(), values[lo:hi].tobytes()))
    for lo in range(0, len(out), 1000):
        yield _rows(out[lo : lo + 1000], ANSWER_NAMES, ANSWER_TYPES)


def delivered(answers: DataFrame, parts: int, kinds: dict[int, np.dtype]) -> DataFrame:
    """owner, kind, values: one row for each owner and kind; rows of kind ALL as they are, without an owner.

    ``kinds`` has the type of each kind's values.
    """
    names, types = ["owner", "kind", "values"], [pa.int64(), pa.int32(), pa.binary()]

    def unpack(batches):
        gathered: dict[int, list] = {}
        for batch in batches:
            for _, kind, owners, sizes, values in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if kind == ALL:
                    yield _rows([(None, ALL, values)], names, types)
                else:
                    gathered.setdefault(kind, []).append((np.repeat(np.frombuffer(owners, "<i8"), np.frombuffer(sizes, "<u4")), np.frombuffer(values, kinds[kind])))
        for kind in list(gathered):
            owner, values = (np.concatenate(x) for x in zip(*gathered.pop(kind), strict=True))
            out = []
            for own, value in per_owner(owner, values):
                out.append((own, kind, value))
                if len(out) == 5000:
                    yield _rows(out, names, types)
                    out = []
            if out:
                yield _rows(out, names, types)

    return answers.repartitionById(parts, "part").mapInArrow(unpack, "owner long, kind int, values binary")


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def shared_keys(rows: DataFrame, keys_of: Keys, buckets: int, hot: int | None = None, by_owner: bool = False) -> DataFrame:
    """owner, keys (codes of its keys that another owner has too); an owner may get several rows.

    With ``hot``, rows with a null owner hold the codes (and counts of owners) of the keys that more
    than ``hot`` owners have. With ``by_owner``, as ``delivered`` gives them: one row for each owner, with
    the low halves of its codes; rows without an owner hold whole codes.
    """
    sent_names, sent_types = ["bucket", "owner", "keys", "at", "owners", "counts"], [pa.int32(), pa.int64(), *[pa.binary()] * 4]

    def send(batches):
        for batch in batches:
            for owner, key in keys_of(batch):
                if not len(key):
                    continue
                known, at = np.unique(owner, return_inverse=True)
                codes = code(key, buckets)
                order = np.lexsort((at, key, codes))
                codes, key, at = codes[order], key[order], at[order]
                # By the whole key: two keys of one owner with one code count as two.
                once = np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])])
                codes, at = codes[once], at[once]
                cut = runs(codes)
                counts = np.diff(cut)
                many = np.repeat(counts > 1, counts)
                out = [((o * 31) % buckets, o, k, None, None, None) for o, k in per_owner(known[at[many]], codes[many])]
                codes, at = codes[cut[:-1]], at[cut[:-1]]
                split = np.searchsorted(codes, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
                for b in np.flatnonzero(np.diff(split)):
                    part = slice(split[b], split[b + 1])
                    own, local = np.unique(at[part], return_inverse=True)
                    out.append((int(b), None, codes[part].astype("<u4").tobytes(), local.astype("<u4" if len(own) > 65535 else "<u2").tobytes(), known[own].astype("<i8").tobytes(), np.minimum(counts[part], 65535).astype("<u2").tobytes()))
                for lo in range(0, len(out), 1000):
                    yield _rows(out[lo : lo + 1000], sent_names, sent_types)

    def find(batches):
        gathered: dict[int, list] = {}
        for batch in batches:
            told = []
            for bucket, owner, keys, at, owners, counts in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if at is None:
                    told.append((owner, keys, None))
                    continue
                keys, owners = np.frombuffer(keys, "<u4"), np.frombuffer(owners, "<i8")
                local = np.frombuffer(at, "<u4" if len(owners) > 65535 else "<u2")
                gathered.setdefault(bucket, []).append((keys, owners[local], np.frombuffer(counts, "<u2")))
            if told and by_owner:
                yield from packed(np.repeat(np.array([o for o, _, _ in told], np.int64), [len(k) // 8 for _, k, _ in told]), np.frombuffer(b"".join([k for _, k, _ in told]), "<u8").astype("<u4"), buckets)
            elif told:
                yield _rows(told, ["owner", "keys", "counts"], [pa.int64(), pa.binary(), pa.binary()])
        for bucket in list(gathered):
            keys, owner, counts = (np.concatenate(x) for x in zip(*gathered.pop(bucket), strict=True))
            order = np.argsort(keys, kind="stable")
            keys, owner, counts = keys[order], owner[order], counts[order].astype(np.int64)
            cut = runs(keys)
            low, high = np.minimum.reduceat(owner, cut[:-1]), np.maximum.reduceat(owner, cut[:-1])
            total, most = np.add.reduceat(counts, cut[:-1]), np.maximum.reduceat(counts, cut[:-1])
            whole = np.uint64(bucket << 32) | keys.astype(np.uint64)
            out = []
            if hot is not None and (over := total > hot).any():
                out.append((None, whole[cut[:-1]][over].tobytes(), total[over].astype("<i8").tobytes()))
            # Where the count is over 1, the owners of that batch have been told.
            tell = np.repeat((low != high) | (most > 1), np.diff(cut)) & (counts == 1)
            if by_owner:
                yield from packed(owner[tell], keys[tell], buckets)
                if out:
                    yield _rows([(0, ALL, None, None, out[0][1])], ANSWER_NAMES, ANSWER_TYPES)
                continue
            out += [(o, k, None) for o, k in per_owner(owner[tell], whole[tell])]
            for lo in range(0, len(out), 1000):
                yield _rows(out[lo : lo + 1000], ["owner", "keys", "counts"], [pa.int64(), pa.binary(), pa.binary()])

    sent = rows.mapInArrow(send, SENT).repartitionById(buckets, "bucket")
    if by_owner:
        return delivered(sent.mapInArrow(find, ANSWERS), buckets, {0: np.dtype("<u4")})
    return sent.mapInArrow(find, FOUND)
