"""Texts combined into containers of fixed capacity, by minimum bin slack.

Containers are not planned item by item: how full a container gets depends on lengths only, and a length is a
number up to the capacity. So the plan is made on the histogram of lengths, whose size is bounded by the
capacity however many texts there are, and says how often which multiset of lengths is packed. Items
then find their container from their rank among the items of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morbiscope.llm import tree_tokenizer as T
from morbiscope.runtime import spread, written

#: Lengths a window's subset sum begins with: the longest that fit, and as many spread over the rest; then come all others.
LONGEST, SPREAD = 64, 64
MAX_CAPACITIES, MAX_CAPACITY = 100, 1 << 20


def fill_window(counts: np.ndarray, lengths: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of lengths (length -> copies) whose sum is closest to ``room`` without exceeding it.

    Bit ``s`` of ``sums`` tells that the lengths so far can sum to ``s``. Copies of one length are added in
    binary portions; the state before each portion is kept, so that counts are found by walking back. Lengths
    are taken in the order given, until the sum is reached that none can exceed: the largest multiple of their
    common divisor up to ``room``. So the answer is exact over all lengths, and most windows need a few.
    """
    most = room - room % int(np.gcd.reduce(lengths)) if lengths.size else 0
    mask, sums, goal = (1 << (room + 1)) - 1, 1, 1 << most
    steps: list[tuple[int, int, int]] = []
    for length in lengths.tolist():
        copies, portion = min(int(counts[length]), room // length), 1
        while copies > 0 and not sums & goal:
            take = min(portion, copies)
            steps.append((length, take, sums))
            sums |= (sums << (take * length)) & mask
            copies, portion = copies - take, portion * 2
        if sums & goal:
            break
    at, chosen = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= take * length
    return chosen


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, multiset of lengths) until every item of ``histogram`` has a place.

    Each pattern holds the longest length left, and what fills the rest best; it is used as often as the
    counts allow, so at least one of its lengths runs out (or falls below its need) each time.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    plan = []
    while True:
        left = np.flatnonzero(counts)
        if not left.size:
            return plan
        anchor = int(left[-1])
        counts[anchor] -= 1
        room = capacity - anchor
        fit = left[: np.searchsorted(left, room, side="right")]
        fit = fit[counts[fit] > 0][::-1]
        rest = fit[LONGEST:]
        spread = np.unique(np.linspace(0, rest.size - 1, SPREAD).astype(int)) if rest.size else np.zeros(0, int)
        window = np.concatenate([fit[:LONGEST], rest[spread], np.delete(rest, spread)])
        chosen = fill_window(counts, window, room) if room and window.size else {}
        counts[anchor] += 1
        chosen[anchor] = chosen.get(anchor, 0) + 1
        times = min(int(counts[length]) // n for length, n in chosen.items())
        for length, n in chosen.items():
            counts[length] -= n * times
        plan.append((times, chosen))


def _placements(plan: list[tuple[int, dict[int, int]]], first: int) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Per length: first rank, copies per container and first container of each pattern that uses it."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    for times, chosen in plan:
        for length, n in chosen.items():
            rows.setdefault(length, []).append((used.get(length, 0), n, first))
            used[length] = used.get(length, 0) + n * times
        first += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in rows.items()}, first  # type: ignore[misc]


def pack_documents(docs: DataFrame, capacities: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str = T.TOKENIZER_DIR, vocabulary: str = T.VOCABULARY) -> DataFrame:
    """Every piece of every text with its container, for each capacity.

    Columns: ``capacity_name``, ``capacity_tokens``, ``container_id`` (from 0, without holes, per capacity),
    ``id_col``, ``piece`` (0, unless the text alone exceeds the capacity), ``first_token``, ``n_tokens``.
    A text longer than the capacity is cut into full pieces and one rest; no other text is cut.

    Defined cases: null and empty texts need no room and are listed in container 0 with 0 tokens; ties and
    repeated rows are packed like any other rows; capacities that are null or below 1 hold nothing and are
    left out; equal capacities under two names are packed separately; no capacity, or no text, gives an
    empty result; other columns are not read.

    Scale: one pass tokenises and writes (id, length, rank within its task); ranks become global by prefix
    sums over (length, task); no window orders the items of one length, however many they are. The driver
    sees one histogram per capacity, bounded by the capacity (at most MAX_CAPACITY lengths).
    """
    listed = capacities.where("capacity_tokens >= 1").select("capacity_name", "capacity_tokens").distinct().orderBy("capacity_tokens", "capacity_name").take(MAX_CAPACITIES + 1)
    sizes = [(r[0], int(r[1])) for r in listed]
    if len(sizes) > MAX_CAPACITIES or any(c > MAX_CAPACITY for _, c in sizes):
        raise ValueError(f"at most {MAX_CAPACITIES} capacities of at most {MAX_CAPACITY} tokens")
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = T.tokenizer(folder, vocabulary), TaskContext.get().partitionId()
        seen = [np.zeros(c + 1, np.int64) for _, c in sizes]
        for batch in batches:
            for piece in T.slices(batch, 1):
                n = np.array([len(tok.encode(t)) for t in piece.column(1).to_pylist()], np.int64)
                for at, (_, c) in enumerate(sizes):
                    # Full pieces first, then the rest; a text that fits is its own rest.
                    full = np.maximum(n - 1, 0) // c
                    doc = np.repeat(np.arange(n.size), full + 1)
                    number = np.arange(doc.size) - np.repeat(np.cumsum(full + 1) - (full + 1), full + 1)
                    length = np.minimum(n[doc] - number * c, c)
                    order = np.argsort(length, kind="stable")
                    ordered = length[order]
                    starts = np.r_[0, np.flatnonzero(np.diff(ordered)) + 1] if ordered.size else np.zeros(0, int)
                    within = np.arange(ordered.size) - np.repeat(starts, np.diff(np.r_[starts, ordered.size]))
                    rank = np.empty_like(length)
                    rank[order] = within + seen[at][ordered]
                    seen[at] += np.bincount(length, minlength=c + 1)
                    m = doc.size
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column(0).take(pa.array(doc)),
                            pa.array(np.full(m, at, np.int32)),
                            pa.array(number.astype(np.int32)),
                            pa.array(length.astype(np.int32)),
                            pa.array(np.full(m, part, np.int32)),
                            pa.array(rank),
                        ],
                        names=["id", "cap", "piece", "length", "part", "rank"],
                    )

    items = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(measure, f"id {kind}, cap int, piece int, length int, part int, rank bigint")
    items = written(items, "packing-items")
    per_part = items.groupBy("cap", "length", "part").agg((F.max("rank") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cap", "length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(per_part.select("cap", "length", "part", "n", before.alias("offset")), "packing-offsets")
    histograms: list[dict[int, int]] = [{} for _ in sizes]
    for r in offsets.where("length > 0").groupBy("cap", "length").agg(F.sum("n").alias("n")).collect():  # bounded by the capacities
        histograms[r["cap"]][r["length"]] = r["n"]
    places = [_placements(plan_patterns(h, c), 0)[0] for h, (_, c) in zip(histograms, sizes)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cap, length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3, 4))
            container = np.zeros(batch.num_rows, np.int64)
            order = np.lexsort((length, cap))
            edges = np.flatnonzero(np.diff(cap[order]) | np.diff(length[order])) + 1
            for run in np.split(order, edges):
                if run.size and length[run[0]] > 0:
                    start, n, first = places[cap[run[0]]][int(length[run[0]])]
                    use = np.searchsorted(start, rank[run], side="right") - 1
                    container[run] = first[use] + (rank[run] - start[use]) // n[use]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(container)], names=["id", "cap", "piece", "length", "container_id"])

    ranked = items.join(offsets.select("cap", "length", "part", "offset"), ["cap", "length", "part"]).select("id", "cap", "piece", "length", (F.col("rank") + F.col("offset")).alias("rank"))
    packed = ranked.mapInArrow(assign, f"id {kind}, cap int, piece int, length int, container_id bigint")
    names = F.array(*[F.lit(n) for n, _ in sizes]) if sizes else F.array(F.lit(None).cast("string"))
    tokens = F.array(*[F.lit(c) for _, c in sizes]) if sizes else F.array(F.lit(None).cast("int"))
    return packed.select(
        names[F.col("cap")].alias("capacity_name"),
        tokens[F.col("cap")].alias("capacity_tokens"),
        "container_id",
        F.col("id").alias(id_col),
        "piece",
        (F.col("piece").cast("long") * tokens[F.col("cap")]).alias("first_token"),
        F.col("length").alias("n_tokens"),
    )
