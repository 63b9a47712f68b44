"""Bolts of a part's neighbours, counted exactly: sets of bolts travel packed, and one slice of the bolts at a time.

Parts are dealt to groups. A slice of the bolts (a remainder of their ids) goes from parts to their assemblies, as one set
a part and group, and the assemblies' unions go back, as one set an assembly and group. Only numbers and ends are kept of
a slice, so what is shuffled at once is the whole divided by the number of slices. Whole sets stand in a list of bytes, as
gaps between sorted ids of seven bits a byte; numpy works on all sets of a group together.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import _removed, _stored
from .ragged import picked, places, rows, starts

#: Slices of tables of more than AT_ONCE rows; others go at once. A prime, as ids may come in steps.
SLICES, AT_ONCE = 7, 2_000_000
#: Rows of a group of parts, and bolts that are spread out at once.
SHARE, SPREAD = 400_000, 4_000_000
MEMBER, LINK = 1, 2
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

FOLDED = "s int, ids binary, nameless boolean, member_sizes binary, members binary, bolt_sizes binary, bolts binary"
MESSAGE = "own boolean, t int, s int, n int, heads binary, sizes binary, members binary, lengths binary, sets binary"
STATE = "s int, ids binary, nameless boolean, n binary, low binary, high binary"
_NAMES = [f.split(" ")[0] for f in MESSAGE.split(", ")]


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of whole numbers, seven bits each, all but the last of a number with the high bit; bytes of each number."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    most = int(values.max()) if len(values) else 0
    for k in range(1, 10):
        if most >> (7 * k) == 0:
            break
        sizes += values >= np.uint64(1 << (7 * k))
    at, out = starts(sizes), np.empty(int(sizes.sum()), np.uint8)
    some = slice(None)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        some = np.flatnonzero(sizes > k) if k else some
        more = (sizes[some] > k + 1).astype(np.uint8) << 7
        out[at[some] + k] = ((values[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, sizes


def unpacked(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    first = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    sizes = ends - first + 1
    values = (data[first] & 127).astype(np.uint64)
    for k in range(1, int(sizes.max()) if len(sizes) else 0):
        some = np.flatnonzero(sizes > k)
        values[some] |= (data[first[some] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return values


def gaps(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of sorted lists, each value's distance from the one before it; the first values stay."""
    out = values.copy()
    out[1:] -= values[:-1]
    first = starts(sizes)[sizes > 0]
    out[first] = values[first]
    return out


def summed(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lists whose gaps are given. Unsigned sums may wrap; their differences don't."""
    total = np.cumsum(steps, dtype=np.uint64)
    first = starts(sizes)
    before = np.where(first > 0, total[np.maximum(first - 1, 0)] if len(total) else 0, 0).astype(np.uint64)
    return total - np.repeat(before, sizes)


def _pack(values: np.ndarray) -> bytes:
    return packed(values)[0].tobytes()


def _whole(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64)


def _sets(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sorted lists as bytes, and the bytes of each list."""
    raw, of_value = packed(gaps(values, sizes))
    ends = np.concatenate(([0], np.cumsum(of_value)))
    first = starts(sizes)
    return raw, ends[first + sizes] - ends[first]


def _picks(which: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the values of chosen lists, list after list."""
    return np.repeat(starts(sizes)[which], sizes[which]) + places(sizes[which])


def _distinct(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each of n keys, and their number."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    return values[new], np.bincount(keys[new], minlength=n)


def _table(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({n: pa.array(v, kinds[n]) for n, v in columns.items()})


def _kinds(schema: str) -> dict[str, pa.DataType]:
    of = {"int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64()}
    return {f.split(" ")[0]: of[f.split(" ")[1]] for f in schema.split(", ")}


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 where there is none, and which there are."""
    c = table[name].combine_chunks()
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.fill_null(0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False)


def folding(least_assembly: int, least_bolt: int):
    """Rows of a group of parts as sorted lists of assemblies and bolts a part; a part without an id is the last."""

    def fold(table: pa.Table) -> pa.Table:
        (part, named), (assembly, held), (bolt, known) = (_column(table, c) for c in ("part", "assembly", "bolt"))
        kind = table["kind"].to_numpy()
        ids, at = np.unique(part[named], return_inverse=True)
        nameless = not named.all()
        n = len(ids) + nameless
        place = np.full(len(part), len(ids), np.int64)
        place[named] = at
        joined, linked = ((kind & MEMBER) > 0) & held, (kind & LINK) > 0
        # whole numbers from 0, from 1 for bolts: 0 is the bolt without an id
        assemblies, member_sizes = _distinct(place[joined], assembly[joined].astype(np.uint64) - np.uint64(least_assembly % 2**64), n)
        numbered = np.where(known, bolt.astype(np.uint64) - np.uint64(least_bolt % 2**64) + np.uint64(1), np.uint64(0))
        bolts, bolt_sizes = _distinct(place[linked], numbered[linked], n)
        row = {
            "s": [table["s"][0].as_py()], "ids": [ids.astype(np.int64).tobytes()], "nameless": [nameless], "member_sizes": [_pack(member_sizes)], "members": [_sets(assemblies, member_sizes)[0].tobytes()],
            "bolt_sizes": [_pack(bolt_sizes)], "bolts": [_sets(bolts, bolt_sizes)[0].tobytes()],
        }
        return _table(row, _kinds(FOLDED))

    return fold


def _messages(out: list[dict], to: np.ndarray, head: np.ndarray | None, owner: np.ndarray, members: np.ndarray, values_of: np.ndarray, raw: np.ndarray, raw_sizes: np.ndarray, **fixed) -> None:
    """Appends a message for each place in `to`, which rows of (to, owner, members) are sorted by; owners' sets go along once."""
    if not len(to):
        return
    new = np.ones(len(to), bool)
    new[1:] = (to[1:] != to[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    group_to, group_owner, group_size = to[at], owner[at], np.diff(np.append(at, len(to)))
    cut = np.append(np.flatnonzero(np.concatenate(([True], group_to[1:] != group_to[:-1]))), len(group_to))
    ends = np.concatenate(([0], np.cumsum(group_size)))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        o = group_owner[a:b]
        out.append({
            **fixed, "to": int(group_to[a]), "n": b - a, "heads": b"" if head is None else _pack(gaps(head[o].astype(np.uint64), np.array([b - a]))), "sizes": _pack(group_size[a:b]), "members": _pack(members[ends[a] : ends[b]]),
            "lengths": _pack(values_of[o]), "sets": raw[_picks(o, raw_sizes)].tobytes(),
        })


def _rows(out: list[dict]) -> pa.Table:
    return _table({n: [r[n] for r in out] for n in _NAMES}, _kinds(MESSAGE))


def sending(slices: int, k: int, groups: int):
    """Messages from parts to the groups of their assemblies: one set of the slice's bolts a part and group. Parts without
    an assembly or an id send theirs back to themselves."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[dict] = []
                member_sizes, bolt_sizes = _whole(unpacked(row["member_sizes"])), _whole(unpacked(row["bolt_sizes"]))
                assemblies, bolts = summed(unpacked(row["members"]), member_sizes), summed(unpacked(row["bolts"]), bolt_sizes)
                keep = bolts % np.uint64(slices) == k
                kept, sizes = bolts[keep] // np.uint64(slices), picked(keep, bolt_sizes)
                raw, raw_sizes = _sets(kept, sizes)
                alone = sizes * (member_sizes == 0)
                if row["nameless"]:
                    alone[-1] = sizes[-1]
                alone = np.flatnonzero(alone)
                _messages(out, np.full(len(alone), row["s"]), None, alone, alone, sizes, raw, raw_sizes, own=True)
                if row["nameless"]:
                    sizes[-1], raw_sizes[-1] = 0, 0  # no link's part is equal to a part without an id
                to = ((assemblies * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(groups)
                order = np.argsort(to, kind="stable")
                _messages(out, to[order], np.arange(len(member_sizes)), rows(member_sizes)[order], assemblies[order], sizes, raw, raw_sizes, own=False)
                if out:
                    yield from _rows([r | {"t": r["to"], "s": row["s"]} for r in out]).to_batches()

    return send


def _read(table: pa.Table, heads: bool) -> tuple[np.ndarray, ...]:
    """Of all messages: groups of each, heads, members of each group, all members, bolts of each group, all bolts."""
    joined = lambda c: unpacked(b"".join(table[c].to_pylist()))
    groups = table["n"].to_numpy().astype(np.int64)
    head = _whole(summed(joined("heads"), groups)) if heads else None
    lengths = _whole(joined("lengths"))
    return groups, head, _whole(joined("sizes")), joined("members"), lengths, summed(joined("sets"), lengths)


def _parted(work: np.ndarray, same: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches of rows with work of about `most`; rows of equal `same`, which are neighbours, stay together."""
    if not len(work):
        return []
    ends = np.append(np.flatnonzero(same[1:] != same[:-1]) + 1, len(same))
    done = np.cumsum(work)[ends - 1] // most
    cuts = ends[np.append(np.flatnonzero(done[1:] != done[:-1]), len(ends) - 1)]
    return list(zip([0, *cuts[:-1]], cuts, strict=True))


def _united(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """`_distinct` for keys from 0 to n, by one sort of single numbers where they fit."""
    width = int(values.max()) + 1 if len(values) else 1
    if n * width >= 2**62:
        return _distinct(keys, values, n)
    both = np.sort(keys.astype(np.int64) * width + values.astype(np.int64))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return (both % width).astype(np.uint64), np.bincount(both // width, minlength=n)


def uniting(table: pa.Table) -> pa.Table:
    """Messages back from a group of assemblies: to each group of parts one union of bolts an assembly."""
    own = table["own"].to_numpy(zero_copy_only=False).astype(bool)
    mine = table.filter(pa.array(own)).select(_NAMES)
    table = table.filter(pa.array(~own))
    out: list[dict] = []
    if len(table):
        groups, head, sizes, members, lengths, bolts = _read(table, True)
        source = np.repeat(table["s"].to_numpy(), groups)
        group = rows(sizes)
        names, assembly = np.unique(members, return_inverse=True)
        order = np.argsort(assembly, kind="stable")
        work = lengths[group[order]]
        values, counts = [], np.zeros(len(names), np.int64)
        for a, b in _parted(work, assembly[order], SPREAD):
            at = order[a:b]
            low = assembly[at[0]]
            v, c = _united(np.repeat(assembly[at] - low, work[a:b]), bolts[_picks(group[at], lengths)], int(assembly[at[-1]] - low) + 1)
            values.append(v)
            counts[low : low + len(c)] += c
        raw, raw_sizes = _sets(np.concatenate(values), counts)
        there = np.flatnonzero(counts[assembly] > 0)
        order = there[np.lexsort((assembly[there], source[group[there]]))]
        _messages(out, source[group[order]], None, assembly[order], head[group[order]], counts, raw, raw_sizes, own=False)
    return pa.concat_tables([mine, _rows([r | {"t": 0, "s": r["to"]} for r in out])]) if out else mine


def counting(slices: int, k: int, least_bolt: int):
    """Adds the slice's bolts to each part's number, least and greatest one. Bolts are marked in a row of flags a part as
    wide as its own first to last bolt, or sorted where these would be sparse."""

    def count(messages: pa.Table, state: pa.Table) -> pa.Table:
        state = state.to_pylist()[0]
        size = len(state["ids"]) // 8 + state["nameless"]
        empty = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        n, low, high = (np.frombuffer(state[c], np.int64).copy() if state[c] is not None else np.full(size, v, np.int64) for c, v in (("n", 0), ("low", empty[0]), ("high", empty[1])))
        if len(messages):
            _, _, sizes, members, lengths, bolts = _read(messages, False)
            members, group = _whole(members), rows(sizes)
            if k == 0:  # the bolt without an id counts, but is neither first nor last
                named = bolts > 0
                without = np.bincount(rows(lengths)[~named], minlength=len(lengths)) > 0
                n[np.unique(members[without[group]])] += 1
                bolts, lengths = bolts[named], picked(named, lengths)
            order = np.argsort(members, kind="stable")
            order = order[lengths[group[order]] > 0]
            members, group = members[order], group[order]
            first = starts(lengths)
            for a, b in _parted(lengths[group], members, SPREAD):
                new = np.flatnonzero(np.concatenate(([True], members[a + 1 : b] != members[a : b - 1])))
                part, g = members[a:b][new], group[a:b]
                least, most = np.minimum.reduceat(bolts[first[g]], new), np.maximum.reduceat(bolts[first[g] + lengths[g] - 1], new)
                at = np.repeat(np.arange(len(new)), np.diff(np.append(new, b - a)))
                found, of = bolts[_picks(g, lengths)], np.repeat(at, lengths[g])
                width = most - least + np.uint64(1)
                if float(width.astype(np.float64).sum()) <= 64 * len(found) + 2**20:
                    place = np.cumsum(width.astype(np.int64)) - width.astype(np.int64)
                    flags = np.zeros(int(width.sum()), np.uint8)
                    flags[(found - least[of]).astype(np.int64) + place[of]] = 1
                    n[part] += np.add.reduceat(flags, place, dtype=np.int64)
                else:
                    n[part] += _united(of, found, len(new))[1]
                real = lambda q: (q * np.uint64(slices) + np.uint64(k) - np.uint64(1) + np.uint64(least_bolt % 2**64)).astype(np.int64)
                low[part], high[part] = np.minimum(low[part], real(least)), np.maximum(high[part], real(most))
        row = {"s": [state["s"]], "ids": [state["ids"]], "nameless": [state["nameless"]], "n": [n.tobytes()], "low": [low.tobytes()], "high": [high.tobytes()]}
        return _table(row, _kinds(STATE))

    return count


def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each part that has a bolt."""
    for batch in batches:
        for r in batch.to_pylist():
            ids, n, low, high = (np.frombuffer(r[c], np.int64) for c in ("ids", "n", "low", "high"))
            if r["nameless"]:
                ids = np.append(ids, 0)
            no_id = np.zeros(len(ids), bool)
            no_id[len(ids) - r["nameless"] :] = True
            some = n > 0
            real = low <= high
            columns = {"part_id": pa.array(ids[some], mask=no_id[some]), "n_bolts": pa.array(n[some]), "first_bolt": pa.array(low[some], mask=~real[some]), "last_bolt": pa.array(high[some], mask=~real[some])}
            yield pa.RecordBatch.from_pydict(columns)


@contextmanager
def _swept(spark: SparkSession):
    """Shuffle files go with the job that wrote them; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)


def summary(touches: DataFrame, slices: int | None = None) -> DataFrame:
    """(part_id, n_bolts, first_bolt, last_bolt) of touches(part, assembly, bolt, kind); whole numbers as ids.

    kind says what a row is: MEMBER (the assembly has the part), LINK (the bolt links the part) or their sum. Rows may repeat.
    """
    spark = touches.sparkSession
    total = touches.agg(F.count(F.lit(1)), F.min("assembly"), F.min("bolt")).first()
    groups = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total[0] // SHARE)) if total[0] > SHARE else 1
    slices = slices or (SLICES if total[0] > AT_ONCE else 1)
    dealt = touches.withColumn("s", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int"))
    with _swept(spark):
        folded = _stored(dealt.groupBy("s").applyInArrow(folding(total[1] or 0, total[2] or 0), FOLDED), "touches-of-parts")[0]
        none = F.lit(None).cast("binary")
        state, old = folded.select("s", "ids", "nameless", none.alias("n"), none.alias("low"), none.alias("high")), None
        for k in range(slices):
            sent = folded.drop("ids").mapInArrow(sending(slices, k, groups), MESSAGE)
            back = sent.groupBy("t").applyInArrow(uniting, MESSAGE)
            counted = back.groupBy("s").cogroup(state.groupBy("s")).applyInArrow(counting(slices, k, total[2] or 0), STATE)
            state, path = _stored(counted, "bolts-of-parts")
            if old:
                _removed(spark, old)
            old = path
    return state.mapInArrow(telling, "part_id long, n_bolts long, first_bolt long, last_bolt long")
