"""Assignment of mentions to slots per query: registered kernels, run as grouped maps.

A query has a handful of slots and mentions, so a kernel sees one small group; queries are
spread over the cluster by key.  All modes of a run share one pass.  Kernels are pure
functions of a score matrix, with a fixed order: slots by position, mentions by position.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mentions import let

IMPOSSIBLE = -1e9
#: Beyond so many slots the exact bitmask search gives way to the greedy one.
EXACT_SLOTS = 15

Scores = list[list[float]]  # slots x mentions
Assignment = dict[int, int]  # slot -> mention


#: Results of a kernel that a task keeps.
REMEMBERED = 4096


def remembered(kernel: Callable[[Scores], Assignment]) -> Callable[[Scores], Assignment]:
    """``kernel`` run once for each distinct matrix of a task: queries whose mentions are of the same kinds share one."""
    known = lru_cache(REMEMBERED)(lambda rows: kernel([list(r) for r in rows]))

    @wraps(kernel)
    def run(scores: Scores) -> Assignment:
        return dict(known(tuple(map(tuple, scores))))

    return run


def preference(slot_type: str, kind: str, value: float | None) -> int:
    """2 for the slot's own kinds, 1 for kinds that may stand for it, 0 else."""
    v = value if value is not None else math.nan
    if slot_type == "percent":
        return 2 if kind == "percent" else 1 if 0 < v <= 1 else 0
    if slot_type == "int":
        return 2 if kind == "int" else 1 if v == v and v == int(v) else 0
    if slot_type == "currency":
        return 2 if kind == "currency" else 1 if kind in ("int", "float") else 0
    return 2 if kind in ("float", "int") else 1 if kind == "currency" else 0


def typed_greedy(slots: list[dict], mentions: list[dict]) -> Assignment:
    """Slots in order take the free mention of best (preference, magnitude, text); the first of equals."""
    free, out = list(range(len(mentions))), {}
    for i, s in enumerate(slots):
        if not free:
            break
        key = lambda j: (preference(s["slot_type"], mentions[j]["kind"], mentions[j]["value"]), abs(mentions[j]["value"] or 0.0), mentions[j]["raw"])  # noqa: B023, E731
        best = max(free, key=key)
        out[i] = best
        free.remove(best)
    return out


def untyped(slots: list[dict], mentions: list[dict]) -> Assignment:
    """Slots take mentions in order."""
    return {i: i for i in range(min(len(slots), len(mentions)))}


def type_scores(slots: list[dict], mentions: list[dict]) -> Scores:
    """Type bonus 3, half for a loose match, impossible between per cent and others, overlap of context 0.7, unit 2."""
    words = lambda xs: frozenset(xs or ())
    return [list(r) for r in _type_scores(tuple((s["slot_type"], words(s.get("words"))) for s in slots), tuple((m["kind"], words(m.get("context"))) for m in mentions))]


@lru_cache(REMEMBERED)
def _type_scores(slots: tuple, mentions: tuple) -> Scores:
    out = []
    for t, words in slots:
        row = []
        for k, context in mentions:
            if (t == "percent") != (k == "percent") and k != "unknown":
                row.append(IMPOSSIBLE)
                continue
            full = t == k or (t == "float" and k == "int") or (t == "currency" and k in ("int", "float"))
            loose = not full and k in ("currency", "float") and t in ("int", "float")
            score = 3.0 * full + 1.5 * loose + 2.0 * (k in ("percent", "currency"))
            score += 0.7 * len(words & context)
            row.append(score if score > 0 else score - 1.0)
        out.append(row)
    return out


@remembered
def greedy_best_first(scores: Scores) -> Assignment:
    """Highest positive score first, each slot and mention once; ties by slot, then mention."""
    pairs = sorted((-s, i, j) for i, row in enumerate(scores) for j, s in enumerate(row) if s > 0)
    out, used = {}, set()
    for _, i, j in pairs:
        if i not in out and j not in used:
            out[i] = j
            used.add(j)
    return out


@remembered
def bitmask(scores: Scores) -> Assignment:
    """Exact best total over positive scores by dynamic programming over sets of slots; greedy beyond ``EXACT_SLOTS``."""
    n = len(scores)
    if not n or n > EXACT_SLOTS:
        return greedy_best_first(scores)
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for j in range(len(scores[0]) if scores else 0):
        grown = dict(best)
        for mask, (total, taken) in best.items():
            for i in range(n):
                s = scores[i][j]
                if s > 0 and not mask >> i & 1:
                    to, new = mask | 1 << i, total + s
                    if to not in grown or new > grown[to][0]:
                        grown[to] = (new, (*taken, (i, j)))
        best = grown
    return dict(max(best.values(), key=lambda x: (round(x[0], 9), [-a for a, _ in x[1]]))[1])


@remembered
def hungarian(scores: Scores) -> Assignment:
    """Exact best total by successive shortest augmenting paths; a slot may stay empty at no cost."""
    n, m = len(scores), len(scores[0]) if scores else 0
    if not n or not m:
        return {}
    # each slot may also take a column of its own worth nothing
    width = m + n
    cost = [[-scores[i][j] if scores[i][j] > 0 else 0.0 if j >= m else 1e6 for j in range(m)] + [0.0] * n for i in range(n)]
    u, v, match = [0.0] * (n + 1), [0.0] * (width + 1), [0] * (width + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, back, seen = [math.inf] * (width + 1), [0] * (width + 1), [False] * (width + 1)
        while match[j0]:
            seen[j0] = True
            row, delta, j1 = match[j0], math.inf, 0
            for j in range(1, width + 1):
                if not seen[j]:
                    d = cost[row - 1][j - 1] - u[row] - v[j]
                    if d < least[j]:
                        least[j], back[j] = d, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(width + 1):
                if seen[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    return {match[j] - 1: j - 1 for j in range(1, m + 1) if match[j] and scores[match[j] - 1][j - 1] > 0}


def beam(scores: Scores, width: int = 8, prune: float = -0.5, coverage: float = 0.8) -> Assignment:
    """Slots in order extend the ``width`` best partial assignments by a mention or by none; filled slots earn ``coverage``."""
    states: list[tuple[float, tuple]] = [(0.0, ())]
    for i, row in enumerate(scores):
        grown = [(t, a) for t, a in states]
        for total, taken in states:
            used = {j for _, j in taken}
            grown += [(total + s + coverage, (*taken, (i, j))) for j, s in enumerate(row) if s > prune and j not in used]
        states = sorted(grown, key=lambda x: (-round(x[0], 9), x[1]))[:width]
    return dict(states[0][1])


def swap_bounds(slots: list[dict], mentions: list[dict], chosen: Assignment) -> Assignment:
    """Exchange the values of a min and a max slot of one stem where they are the wrong way round."""
    out = dict(chosen)
    stem = lambda s: tuple(w for w in s.get("words") or () if w not in ("min", "minimum", "max", "maximum"))
    for i, a in enumerate(slots):
        for k, b in enumerate(slots):
            low, high = set(a.get("words") or ()) & {"min", "minimum"}, set(b.get("words") or ()) & {"max", "maximum"}
            if low and high and stem(a) == stem(b) and i in out and k in out:
                x, y = mentions[out[i]]["value"], mentions[out[k]]["value"]
                if x is not None and y is not None and x > y:
                    out[i], out[k] = out[k], out[i]
    return out


def normalized_margin(row: list[float]) -> tuple[float, float]:
    """(margin of the best two, entropy) of a slot's scores clamped to [0, 1] by 12; 0 and 1 without candidates."""
    s = sorted((min(1.0, max(0.0, x / 12)) for x in row if x > IMPOSSIBLE / 2), reverse=True)
    if not s:
        return 0.0, 1.0
    margin = (s[0] - s[1]) / max(abs(s[0]), 1e-9) if len(s) > 1 else 1.0
    total = sum(s)
    h = -sum(x / total * math.log(x / total) for x in s if x > 0) / math.log(len(s)) if total > 0 and len(s) > 1 else 0.0
    return margin, h


@remembered
def default_beam(scores: Scores) -> Assignment:
    return beam(scores)


@remembered
def default_abstaining(scores: Scores) -> Assignment:
    return abstaining(scores)


def abstaining(scores: Scores, most_entropy: float = 0.9, least_margin: float = 0.2) -> Assignment:
    """The beam's choice without slots that are ambiguous."""
    chosen = default_beam(scores)
    return {i: j for i, j in chosen.items() if (m := normalized_margin(scores[i])) and m[1] <= most_entropy and m[0] >= least_margin}


#: mode -> kernel of (slots, mentions).
MODES: dict[str, Callable[[list[dict], list[dict]], Assignment]] = {
    "typed": typed_greedy,
    "untyped": untyped,
    "constrained": lambda s, m: bitmask(type_scores(s, m)),
    "max_weight_matching": lambda s, m: hungarian(type_scores(s, m)),
    "semantic_repair": lambda s, m: swap_bounds(s, m, hungarian(type_scores(s, m))),
    "best_first": lambda s, m: greedy_best_first(type_scores(s, m)),
    "global_consistency": lambda s, m: swap_bounds(s, m, default_beam(type_scores(s, m))),
    "ambiguity_abstain": lambda s, m: default_abstaining(type_scores(s, m)),
}


def assign(groups: DataFrame, modes: list[str] | None = None, key: str = "query_id") -> DataFrame:
    """query_id, mode, slot_name, value of filled slots, all modes in one pass.

    ``groups``: key, slots array<struct<slot_name,slot_type,words>>, mentions array<struct<raw,value,kind,...>>.
    """
    modes = modes or list(MODES)
    if unknown := set(modes) - set(MODES):
        raise ValueError(f"unknown modes {sorted(unknown)}")
    kind = groups.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keys, names, slot_names, values = [], [], [], []
            for k, slots, found in zip(*(batch.column(c).to_pylist() for c in (key, "slots", "mentions")), strict=True):
                s, m = slots or [], found or []
                for mode in modes:
                    for i, j in sorted(MODES[mode](s, m).items()):
                        keys.append(k)
                        names.append(mode)
                        slot_names.append(s[i]["slot_name"])
                        values.append(None if m[j]["value"] is None else float(m[j]["value"]))
            columns = [pa.array(keys, batch.column(key).type), pa.array(names, pa.string()), pa.array(slot_names, pa.string()), pa.array(values, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "mode", "slot_name", "value"])

    return groups.select(key, "slots", "mentions").mapInArrow(run, f"`{key}` {kind}, mode string, slot_name string, value double")


# The two simple modes as rows: mentions meet slots by rank, or take them one window after another.


def by_rank(groups: DataFrame, key: str = "query_id") -> DataFrame:
    """key, slot_name, value: the k-th slot takes the k-th mention."""
    both = F.slice(F.arrays_zip("slots", "mentions"), 1, F.least(F.size("slots"), F.size("mentions")))
    return groups.select(key, F.explode(both).alias("x")).select(key, F.col("x.slots.slot_name").alias("slot_name"), F.col("x.mentions.value").alias("value"))


def preferred(slot_type: Column, kind: Column, value: Column) -> Column:
    """:func:`preference` as a column."""
    whole = F.coalesce(value == F.floor(value), F.lit(False))
    return (
        F.when(slot_type == "percent", F.when(kind == "percent", 2).when((value > 0) & (value <= 1), 1).otherwise(0))
        .when(slot_type == "int", F.when(kind == "int", 2).when(whole, 1).otherwise(0))
        .when(slot_type == "currency", F.when(kind == "currency", 2).when(kind.isin("int", "float"), 1).otherwise(0))
        .otherwise(F.when(kind.isin("float", "int"), 2).when(kind == "currency", 1).otherwise(0))
    )


def by_type(groups: DataFrame, slots: int | None = None, key: str = "query_id") -> DataFrame:
    """key, slot_name, value: as :func:`typed_greedy`; a group may have any number of slots, so their most, ``slots``, need not be given.

    A slot takes the free mention that is largest by (preference, magnitude, text), the first of
    equals: a fold over the slots inside the group's row, so that nothing moves or is sorted.
    """
    numbered = F.transform("mentions", lambda m, i: F.struct(m["value"].alias("value"), m["kind"].alias("kind"), m["raw"].alias("raw"), i.alias("at")))

    def taken(found):
        def take(got, s):
            free = F.filter(found, lambda m: ~F.exists(got, lambda g: g["at"] == m["at"]))
            rank = lambda m: F.struct(preferred(s["slot_type"], m["kind"], m["value"]).alias("p"), F.abs(F.coalesce(m["value"], F.lit(0.0))).alias("v"), F.coalesce(m["raw"], F.lit("")).alias("r"), (-m["at"]).alias("a"), m["value"].alias("value"))
            own = lambda b: F.struct(s["slot_name"].alias("slot_name"), (-b["a"]).alias("at"), b["value"].alias("value"))
            return let(F.array_max(F.transform(free, rank)), lambda b: F.when(b.isNull(), got).otherwise(F.concat(got, F.array(own(b)))))

        return F.aggregate("slots", F.array().cast("array<struct<slot_name:string,at:int,value:double>>"), take)

    return groups.select(key, F.explode(let(numbered, taken)).alias("x")).select(key, "x.slot_name", "x.value")
