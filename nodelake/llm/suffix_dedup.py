"""Removal of byte strings that repeat an earlier document, by a depth-limited radix sort of suffixes.

Suffixes are ordered through ``width`` bytes only, most significant digit first; suffixes that are
equal to that depth are exactly the repeated windows. The digits of a window are taken from its
anchor on, the 16-byte string with the least hash in it: equal windows have equal anchors at equal
places, so all windows of one anchor (a zone of at most twice the width) move as one record.

0. Of equal texts (told by 128 bits of hash) the one with the least doc_id goes on; every byte of the
   others goes.
1. First digit: the anchor. Anchors that occur in one text only are closed (``shared_keys``).
2. The open anchors' zones are told apart by a hash (with the anchor's, 96 bits) that is dealt by anchor
   in their stead. Of equal zones all but those of the least doc_id are marked whole. An anchor with a
   single distinct zone is closed: all its windows are equal. So is a zone that has neither side of its anchor
   (33 bytes or more, of which each of its windows holds one) in common with a different zone.
3. Of the others, one zone of each kind is dealt with its bytes. Its windows are sorted by them, eight at a
   pass; a group is closed as soon as it has one window, and what stays together to the end is equal.
   Every comparison here is of whole bytes.
4. Each group's smallest doc_id is compared with the others', and the marks go back to the documents.

Answers go back packed by parts of the documents, so a document gets one row of them.

An anchor that more than max(``hot_docs``, a ten-thousandth of all documents, a thousandth of a bucket's bytes)
documents hold is dealt by its zone and one of SALTS salts in step 2, whose least go on, and by its windows in step 3, so a passage that a
third of the corpus shares lands in many tasks; equal zones within a batch are sent once. There are at most ten thousand times the anchors of a mean document of
such anchors, whatever the size of the corpus, which bounds what is broadcast.

Defined results: a null text is empty; a row with a null doc_id keeps all its bytes and takes none from
others; rows of one doc_id never take from each other, so repeated rows give equal rows; an empty
table gives an empty table; other columns are carried only if asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodelake.llm.shared_keys import ANSWERS, code, delivered, packed, per_owner, runs, shared_keys
from nodelake.session import scratch, small_batches, stored

ANCHOR = 16
CHUNK = 2_000_000
#: Zones at a time, and bytes of zones that a task holds to find equal ones.
SLICE, HELD = 20_000, 12_000_000
#: Parts into which the holders of a hot zone are dealt.
SALTS = 16
#: An anchor is hot from one document for so many bytes of a bucket on.
HOT_BYTES = 1000
#: Bytes of different texts for each bucket.
BUCKET = 128_000_000
ODD = 0x9E3779B97F4A7C15
MARK = np.dtype([("lo", "<u4"), ("mask", "<u8")])
#: Kinds of answers: marks, and low halves of the codes of open zones.
MARKED, OPEN = 1, 2
ANSWER_KINDS = {MARKED: MARK, OPEN: np.dtype("<u4")}
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31)) ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base to each exponent, modulo 2**64."""
    out, left = np.ones(len(exponents), np.uint64), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(base), out)
        base, left = base * base % 2**64, left >> np.uint64(1)
    return out


def zones(data: np.ndarray, ends: np.ndarray, width: int, whole: bool = False) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: document, first window, last window and anchor hash of each zone.

    With ``whole``, then a hash of all its bytes (a polynomial over the hashes of its 16-byte strings) and, in one
    number, 16 bits of hash for each side of the anchor: what all its windows hold that begin half a span or more
    before the anchor, and what all the others hold. 0: it has no such windows.
    """
    none = np.zeros(0, np.int64)
    empty = (none, none, none, none.astype(np.uint64)) + whole * (none.astype(np.uint64), none.astype(np.uint32))
    if len(data) < width:
        return empty
    h, power, n = data.astype(np.uint64), ODD, 1
    while n < ANCHOR:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power % 2**64, 2 * n
    h = mixed(h, 1)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span, n = width - ANCHOR + 1, 1
    while 2 * n <= span:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    if span > n:
        low = np.minimum(low[: len(low) - (span - n)], low[span - n :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of the window that starts here
    starts = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= width
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - width + 1, -1)
    window = np.flatnonzero(np.cumsum(valid)[: len(at)] > 0)
    if not len(window):
        return empty
    doc = np.searchsorted(ends, window, side="right")
    cut = np.flatnonzero((at[window][1:] != at[window][:-1]) | (doc[1:] != doc[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(window)]]) - 1
    anchor = at[window[first]]
    found = doc[first], window[first], window[last], mixed(h[anchor], 2)
    if not whole:
        return found
    del low, at, doc, window
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(np.full(len(h), ODD, np.uint64)))])
    hashed = (total[found[2] + span] - total[found[1]]) * powers(pow(ODD, -1, 2**64), found[1])
    half, scale = span // 2, powers(pow(ODD, -1, 2**64), anchor)
    side = lambda lo, hi: (mixed((total[np.minimum(hi, len(total) - 1)] - total[np.maximum(lo, 0)]) * scale, 7) >> np.uint64(48)).astype(np.uint32) | np.uint32(1)
    left = np.where(anchor - found[1] >= half, side(anchor - half, anchor + 1), 0)
    right = np.where(anchor - found[2] < half, side(anchor, anchor + span - half + 1), 0)
    return *found, mixed(hashed + (found[2] - found[1]).astype(np.uint64), 5), (left << np.uint32(16) | right).astype(np.uint32)


def chunks(keys: list, texts: list, width: int, whole: bool = False) -> Iterator[tuple]:
    """Rows in groups of at most CHUNK bytes (or one text): their zones."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size += len(texts[hi])
            hi += 1
        data = np.frombuffer(b"".join(texts[lo:hi]), np.uint8)
        ends = np.cumsum([len(t) for t in texts[lo:hi]])
        yield lo, hi, data, ends, zones(data, ends, width, whole)
        lo = hi


def smallest(data: np.ndarray, start: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    """For each window data[start : start + width]: the least ``value`` among the windows equal to it.

    A radix sort by most significant digits of eight bytes; groups of one are closed at each pass.
    """
    out = value.copy()
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    digit = np.zeros(len(data), np.uint64)
    for j in range(8):
        digit = digit << np.uint64(8) | padded[j : j + len(data)]
    live, group = np.arange(len(start)), np.zeros(len(start), np.int64)
    for depth in range(0, width, 8):
        d = digit[start[live] + depth]
        if width - depth < 8:
            d = d >> np.uint64(8 * (8 - width + depth))
        order = np.lexsort((d, group))
        live, group, d = live[order], group[order], d[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (d[1:] != d[:-1])]) if len(live) else np.zeros(0, bool)
        group = np.cumsum(new)
        open_ = np.bincount(group, minlength=1)[group] > 1
        live, group = live[open_], group[open_]
    cut = runs(group)
    if len(live):
        out[live] = np.repeat(np.minimum.reduceat(value[live], cut[:-1]), np.diff(cut))
    return out


def settle(codes: np.ndarray, zone: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """An order of zones by code, hash and doc_id; in it: has it an equal of smaller doc_id, has its code other zones."""
    order = np.lexsort((ids, zone, codes))
    codes, zone, ids = codes[order], zone[order], ids[order]
    new_code = np.concatenate([[True], codes[1:] != codes[:-1]])
    new = new_code | np.concatenate([[True], zone[1:] != zone[:-1]])
    at, of = np.cumsum(new) - 1, np.cumsum(new_code) - 1
    return order, ids > ids[new][at], np.bincount(of, weights=new)[of] > 1


def windows_hash(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each string data[start : start + width]."""
    out = np.zeros(len(start), np.uint64)
    for j in range(width):
        out = out * np.uint64(ODD) + data[start + j]
    return mixed(out, 4)


def strings(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings data[start : start + size] as one Arrow array."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def marked(lo: np.ndarray, mask: np.ndarray) -> np.ndarray:
    packed_ = np.zeros(len(lo), MARK)
    packed_["lo"], packed_["mask"] = lo, mask
    return packed_


def packed_marks(key: np.ndarray, lo: np.ndarray, mask: np.ndarray) -> list[tuple]:
    """key and the packed marks of each document."""
    return list(per_owner(key, marked(lo, mask)))


def first_copies(docs: DataFrame, width: int) -> DataFrame:
    """key, text_hash, n_bytes of the document with the least id of each distinct text of ``width`` bytes or more."""
    long = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    hashed = long.select("doc_id", "key", F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit(1), "text").alias("check"), F.octet_length("text").cast("long").alias("n_bytes"))
    return hashed.groupBy("text_hash", "check").agg(F.min(F.struct("doc_id", "key", "n_bytes")).alias("first")).select("first.key", "text_hash", "first.n_bytes")


def wanted(doc: np.ndarray, codes: np.ndarray, opened: list) -> np.ndarray:
    """The zones whose code (its low half) their document has among its open ones.

    Documents and codes are compared as one number each; a wrong match only sends a zone that none shares.
    """
    owner = np.repeat(np.arange(len(opened), dtype=np.uint64), [len(x) // 4 for x in opened])
    low = np.frombuffer(b"".join(opened), "<u4").astype(np.uint64)
    return np.flatnonzero(np.isin(doc.astype(np.uint64) << np.uint64(32) | codes & np.uint64(0xFFFFFFFF), owner << np.uint64(32) | low))


def shares_side(codes: np.ndarray, zone: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which zones have a side in common with a different zone of their code: the only ones that can share a window."""
    out = np.zeros(len(codes), bool)
    for side in (sides >> np.uint32(16), sides & np.uint32(0xFFFF)):
        own = np.flatnonzero(side)
        if not len(own):
            continue
        own = own[np.lexsort((zone[own], side[own], codes[own]))]
        new = np.concatenate([[True], (codes[own][1:] != codes[own][:-1]) | (side[own][1:] != side[own][:-1])])
        kind = new | np.concatenate([[True], zone[own][1:] != zone[own][:-1]])
        out[own[np.bincount(at := np.cumsum(new) - 1, weights=kind)[at] > 1]] = True
    return out


def by_zone(chosen: DataFrame, width: int, buckets: int, hot_codes) -> DataFrame:
    """owner (key), kind, values: MARKED zones that a smaller doc_id has too, OPEN ones that must be compared by bytes.

    Zones travel as columns packed for each bucket: code, hash, sides, document, first window and number of windows.
    """
    columns = ["codes", "zones", "sides", "at", "lo", "count"]
    kinds = ["<u8", "<u8", "<u4", "<u2", "<u4", "u1"]
    schema = pa.schema([("bucket", pa.int32()), *[(f"known_{c}", pa.binary()) for c in ("owners", "marks")], ("hot", pa.bool_()), ("owners", pa.binary()), ("ids", pa.binary()), *[(c, pa.binary()) for c in columns]])

    def whole(lo, count):
        return marked(lo, np.uint64(2**64 - 1) >> (64 - count).astype(np.uint64))

    def send(batches):
        salt = np.uint64(TaskContext.get().partitionId() % SALTS * 0x9E37)
        for batch in batches:
            keys, ids, texts, opened = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy(), batch.column("text").to_pylist(), batch.column("open").to_pylist()
            for lo, hi, _, ends, (doc, first, last, h, zone, sides) in chunks(keys, texts, width, whole=True):
                codes = code(h, buckets)
                chosen_ = wanted(doc, codes, opened[lo:hi])
                if not len(chosen_):
                    continue
                doc, codes, zone, sides, first, count = doc[chosen_], codes[chosen_], zone[chosen_], sides[chosen_], first[chosen_], (last - first)[chosen_] + 1
                first = first - np.concatenate([[0], ends[:-1]])[doc]
                order, known, _ = settle(codes, zone, ids[lo + doc])
                doc, codes, zone, sides, first, count = (x[order] for x in (doc, codes, zone, sides, first, count))
                out = [{"bucket": int(keys[lo]) % buckets, "known_owners": keys[lo + doc[known]].tobytes(), "known_marks": whole(first[known], count[known]).tobytes()}] if known.any() else []
                sent = ~known
                is_hot = np.isin(codes, hot_codes.value)
                bucket = np.where(is_hot, ((zone >> np.uint64(32)) + salt) % np.uint64(buckets), codes >> np.uint64(32)).astype(np.int64)
                for hot in (False, True):
                    some = np.flatnonzero(sent & (is_hot == hot))
                    some = some[np.argsort(bucket[some], kind="stable")]
                    cut = runs(bucket[some])
                    for i, j in zip(cut[:-1], cut[1:], strict=True):
                        for part in np.split(some[i:j], range(50_000, j - i, 50_000)):
                            own, at = np.unique(doc[part], return_inverse=True)
                            values = codes[part] if hot else codes[part].astype("<u4"), zone[part], sides[part], at.astype("<u2"), first[part].astype("<u4"), count[part].astype("u1")
                            out.append({"bucket": int(bucket[part[0]]), "hot": hot, "owners": keys[lo + own].tobytes(), "ids": ids[lo + own].tobytes(), **dict(zip(columns, (v.tobytes() for v in values), strict=True))})
                for i in range(0, len(out), 1000):
                    yield pa.RecordBatch.from_pylist(out[i : i + 1000], schema)

    def find(batches):
        gathered: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.filter(batch.column("hot").is_null()).to_pylist():
                yield from packed(np.frombuffer(r["known_owners"], "<i8"), np.frombuffer(r["known_marks"], MARK), buckets, MARKED)
            for r in batch.filter(batch.column("hot").is_valid()).to_pylist():
                codes, zone, sides, at, lo, count = (np.frombuffer(r[c], k if c != "codes" or r["hot"] else "<u4") for c, k in zip(columns, kinds, strict=True))
                gathered.setdefault((r["bucket"], r["hot"]), []).append((codes, zone, sides, np.frombuffer(r["owners"], "<i8")[at], np.frombuffer(r["ids"], "<i8")[at], lo, count))
        for bucket, hot in list(gathered):
            codes, zone, sides, owner, ids, lo, count = (np.concatenate(x) for x in zip(*gathered.pop((bucket, hot)), strict=True))
            order, known, differs = settle(codes, zone, ids)
            codes, zone, sides, owner, lo, count = (x[order] for x in (codes, zone, sides, owner, lo, count))
            yield from packed(owner[known], whole(lo[known], count[known]), buckets, MARKED)
            go_on = np.flatnonzero(~known & (differs | hot))
            if not hot:
                go_on = go_on[shares_side(codes[go_on], zone[go_on], sides[go_on])]
            yield from packed(owner[go_on], codes[go_on].astype("<u4"), buckets, OPEN)

    ddl = "bucket int, known_owners binary, known_marks binary, hot boolean, owners binary, ids binary, codes binary, zones binary, sides binary, at binary, lo binary, count binary"
    return delivered(chosen.mapInArrow(send, ddl).repartitionById(buckets, "bucket").mapInArrow(find, ANSWERS), buckets, ANSWER_KINDS)


def marks_of(docs: DataFrame, firsts: DataFrame, width: int, buckets: int, hot_docs: int) -> DataFrame:
    """key, marks: windows to remove from ``firsts``, packed as (first window, bits of it and those after)."""
    span = width - ANCHOR + 1
    if not 1 <= span <= 64:
        raise ValueError(f"width must be from {ANCHOR} to {ANCHOR + 63}")
    rows = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))

    def anchors(batch):
        owners = np.array(batch.column("text_hash").to_pylist(), np.int64)
        for lo, _, _, _, (doc, _, _, h) in chunks(owners, batch.column("text").to_pylist(), width):
            yield owners[lo + doc], h

    n = docs.count()
    by_text = rows.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    bytes_of = rows.select("key", "doc_id", F.col("text").cast("binary").alias("text"))
    with scratch(docs.sparkSession):
        open_anchors = stored(shared_keys(by_text, anchors, buckets, hot=max(hot_docs, n // 10_000), by_owner=True), "suffix-anchors")
        hot = [np.frombuffer(r[0], "<u8") for r in open_anchors.where(F.col("owner").isNull()).select("values").toLocalIterator()]
        hot_codes = docs.sparkSession.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, "<u8"), *hot])))
        open_of = open_anchors.where(F.col("owner").isNotNull()).select(F.col("owner").alias("text_hash"), F.col("values").alias("open"))
        open_of = firsts.join(open_of, "text_hash").select("key", "open")
        told_apart = stored(by_zone(bytes_of.join(open_of, "key"), width, buckets, hot_codes), "suffix-zones", keep=True)
    of_kind = lambda df, kind, name: df.where(F.col("kind") == kind).select(F.col("owner").alias("key"), F.col("values").alias(name))
    open_of = of_kind(told_apart, OPEN, "open")
    sent_schema = "deal long, zone binary, doc_id long, key long, lo int, marks binary"
    names, types = [x.split()[0] for x in sent_schema.split(", ")], [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def once(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Zones in order of doc_id: the first of equal ones is sent, the others are marked here."""
        zone = pa.chunked_array([p[0] for p in parts], pa.binary()).combine_chunks()
        deal_, ids, keys, lo, count = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
        same = zone.dictionary_encode().indices.to_numpy()
        _, first = np.unique(same, return_index=True)
        known = ids[first][same] < ids
        send = np.flatnonzero(~known)
        for at in range(0, len(send), 20_000):
            own = send[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(deal_[own]), zone.take(pa.array(own)), pa.array(ids[own]), pa.array(keys[own]), pa.array(lo[own], pa.int32()), pa.nulls(len(own), pa.binary())], names)
        whole = (np.uint64(2**64 - 1) >> (64 - count[known]).astype(np.uint64)) if known.any() else np.zeros(0, np.uint64)
        marks = packed_marks(keys[known], lo[known], whole)
        for at in range(0, len(marks), 20_000):
            some = marks[at : at + 20_000]
            own = pa.array([k for k, _ in some], pa.int64())
            yield pa.RecordBatch.from_arrays([own, pa.nulls(len(some), pa.binary()), pa.nulls(len(some), types[2]), own, pa.nulls(len(some), types[4]), pa.array([m for _, m in some], pa.binary())], names)

    def deal(batches):
        for batch in batches:
            batch = pa.Table.from_batches([batch]).sort_by("doc_id").combine_chunks().to_batches()[0] if batch.num_rows else batch
            keys, ids, texts, opened = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy(), batch.column("text").to_pylist(), batch.column("open").to_pylist()
            del batch
            held, size = [], 0
            for lo, hi, data, ends, (doc, first, last, h) in chunks(keys, texts, width):
                codes, begin = code(h, buckets), np.concatenate([[0], ends[:-1]])
                zone = wanted(doc, codes, opened[lo:hi])
                is_hot = np.isin(codes[zone], hot_codes.value)
                for at in range(0, len(zone), SLICE):
                    z, each = zone[at : at + SLICE], is_hot[at : at + SLICE]
                    n_parts = np.where(each, last[z] - first[z] + 1, 1)
                    z, each = np.repeat(z, n_parts), np.repeat(each, n_parts)
                    start = first[z] + np.where(each, np.arange(len(z)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts), 0)
                    count = np.where(each, 1, last[z] - first[z] + 1)
                    deal_ = h[z]
                    deal_[each] = windows_hash(data, start[each], width)
                    held.append((strings(data, start, count + width - 1), deal_.view(np.int64), ids[lo + doc[z]], keys[lo + doc[z]], start - begin[doc[z]], count))
                    size += held[-1][0].nbytes
                    if size > HELD:
                        yield from once(held)
                        held, size = [], 0
            if held:
                yield from once(held)

    def sort(batches):
        parts = []
        for batch in batches:
            passed = batch.filter(batch.column("zone").is_null())
            if passed.num_rows:
                marks = passed.column("marks").to_pylist()
                yield from packed(np.repeat(passed.column("key").to_numpy(), [len(m) // MARK.itemsize for m in marks]), np.frombuffer(b"".join(marks), MARK), buckets, MARKED)
            if passed.num_rows < batch.num_rows:
                parts.append(batch.filter(batch.column("zone").is_valid()))
        if not parts:
            return
        deals, doc_ids, keys, los = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("deal", "doc_id", "key", "lo"))
        coded = pa.chunked_array([p.column("zone") for p in parts]).combine_chunks().dictionary_encode()
        del parts
        zone_at, zone = coded.indices.to_numpy(), coded.dictionary
        begin = np.frombuffer(zone.buffers()[1], np.int32)[: len(zone) + 1].astype(np.int64)
        data = np.frombuffer(zone.buffers()[2], np.uint8)[: begin[-1]]
        n_windows = np.diff(begin) - width + 1
        least, zone_deal = np.full(len(zone), np.iinfo(np.int64).max), np.zeros(len(zone), np.int64)
        np.minimum.at(least, zone_at, doc_ids)
        zone_deal[zone_at] = deals
        first_window = np.concatenate([[0], np.cumsum(n_windows)])
        value = np.repeat(least, n_windows)
        _, group, members = np.unique(zone_deal, return_inverse=True, return_counts=True)
        pick = np.repeat(members[group] > 1, n_windows)
        start = (np.repeat(begin[:-1] - first_window[:-1], n_windows) + np.arange(len(value)))[pick]
        value[pick] = smallest(data, start, value[pick], width)
        mask = np.zeros(len(zone_at), np.uint64)
        for j in range(int(n_windows.max())):
            there = np.flatnonzero(n_windows[zone_at] > j)
            smaller = value[first_window[zone_at[there]] + j] < doc_ids[there]
            mask[there] |= smaller.astype(np.uint64) << np.uint64(j)
        some = mask > 0
        yield from packed(keys[some], marked(los[some], mask[some]), buckets, MARKED)

    dealt = bytes_of.join(open_of, "key").mapInArrow(deal, sent_schema).repartition(buckets, "deal")
    return of_kind(delivered(dealt.mapInArrow(sort, ANSWERS), buckets, ANSWER_KINDS).union(told_apart), MARKED, "marks")


def removed(text: bytes, marks: list[bytes], width: int) -> np.ndarray:
    """Which bytes of a text its marks cover."""
    edge = np.zeros(len(text) + 1, np.int64)
    packed = np.frombuffer(b"".join(marks), MARK)
    for at in range(0, len(packed), SLICE):
        some = packed[at : at + SLICE]
        row, bit = np.nonzero((some["mask"][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
        window = some["lo"][row] + bit
        edge += np.bincount(window, minlength=len(edge)) - np.bincount(window + width, minlength=len(edge))
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, *, width: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False, buckets: int | None = None, hot_docs: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``, then ``keep``.

    ``with_text`` adds kept_text, the bytes left as text (parts of cut characters are left out).
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)])
    plain = plain.withColumn("key", F.xxhash64("doc_id", "text"))
    firsts = stored(first_copies(plain, width), "suffix-texts")
    n_bytes = firsts.agg(F.sum("n_bytes")).collect()[0][0] or 0
    buckets = buckets or max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_bytes // BUCKET)
    hot_docs = max(hot_docs, n_bytes // buckets // HOT_BYTES)
    with scratch(docs.sparkSession):
        marks = stored(marks_of(plain, firsts, width, buckets, hot_docs), "suffix-marks", keep=True)
    marks = marks.groupBy("key").agg(F.collect_list("marks").alias("marks"))
    judged = firsts.select("key").distinct().join(marks, "key", "left").select("key", F.coalesce("marks", F.array().cast("array<binary>")).alias("marks"))
    joined = plain.withColumn("text", F.col("text").cast("binary")).join(judged, "key", "left").drop("key")
    kinds = dict(joined.dtypes)
    extra = [f"kept_{i}" for i in range(len(keep))]
    names = [x.split()[0] for x in RESULT.split(", ")] + (["kept_text"] if with_text else [])

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text, marks in zip(*(batch.column(c) for c in ("doc_id", "text", "marks")), strict=True):
                text, marks = text.as_py(), marks.as_py()
                left, gone, spans = text, 0, 0
                if marks is None and doc_id.is_valid and len(text) >= width:  # a copy of a document with a smaller id
                    left, gone, spans = b"", len(text), 1
                elif marks:
                    covered = removed(text, marks, width)
                    gone, spans = int(covered.sum()), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
                    left = np.frombuffer(text, np.uint8)[~covered].tobytes()
                out.append((len(text), gone, spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            arrays = [batch.column("doc_id"), *[pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64()] * 3 + [pa.string()] * (1 + with_text))]]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(c) for c in extra], names + extra)

    schema = RESULT + ", kept_text string" * with_text + "".join(f", {c} {kinds[c]}" for c in extra)
    done = joined.mapInArrow(cut, schema)
    return done.select(*names, *[F.col(x).alias(c) for x, c in zip(extra, keep, strict=True)])
