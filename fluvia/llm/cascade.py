"""Quarantine and cascading release: turns wait for the turn they answer; what hangs below a dead turn is blocked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluvia.llm.common import in_arrow, memo, merged, stored

#: Attempts of a turn before it is dead; after attempt a the next one comes FIRST_WAIT * 2 ** (a - 1) seconds later.
ATTEMPTS, FIRST_WAIT = 6, 10
_WAITED = [FIRST_WAIT * (2**a - 1) for a in range(ATTEMPTS)]
#: Turns of a conversation that one task takes together.
BLOCK = 128
#: Parts whose sums are added up together, level by level.
FAN = 1024
LEVELS = 2
DELIVERED, DEAD, BLOCKED = 1, 2, 3
NAMES = {DELIVERED: "delivered", DEAD: "dead", BLOCKED: "blocked"}
OTHERS, KNOWN, LOST = 1, 2, 3  # a parent in another block: not yet known, delivered, dead or blocked


def forest(parent: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Depth-first order of a forest, and for each node its place in it and the end of its subtree's places.

    ``parent`` has a node's parent or -1. Children are adjacent in one array (compressed rows), and a stack
    takes the place of recursion. The subtree of v holds the places enter[v] to leave[v], the latter excluded.
    """
    n = len(parent)
    children = np.argsort(parent, kind="stable")
    start = np.searchsorted(parent[children], np.arange(-1, n + 1))  # of -1 (the roots), 0, 1 and so on
    child, first = children.tolist(), start.tolist()
    order, above = [], parent.tolist()
    stack = child[first[0] : first[1]][::-1]
    while stack:
        v = stack.pop()
        order.append(v)
        if first[v + 1] != first[v + 2]:
            stack += child[first[v + 1] : first[v + 2]][::-1]
    enter = np.empty(n, np.int64)
    enter[order] = np.arange(n)
    size = [1] * n
    for v in reversed(order):
        if above[v] >= 0:
            size[above[v]] += size[v]
    return order, enter, enter + np.array(size, np.int64)


def outcomes(parent: np.ndarray, arrival: np.ndarray, repair: np.ndarray, fails: np.ndarray, outer: np.ndarray, outer_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(status, attempts, first, last) of turns; status 0: not yet known.

    ``repair`` is the second from which attempts of a faulty turn may succeed, -1 for a turn without
    fault; bit a - 1 of ``fails`` is set if attempt a of a faulty turn fails anyway. ``outer``: what is known of a parent that isn't
    among these turns (0: there is none), ``outer_at``: when it was delivered.
    """
    n = len(parent)
    order, enter, leave = forest(parent)
    above, came, fixed, bad, far, far_at = (x.tolist() for x in (parent, arrival, repair, fails, outer, outer_at))
    got, tries, first, last = [0] * n, [0] * n, [-1] * n, [-1] * n
    for v in order:
        u, at = above[v], came[v]
        if u >= 0:
            if got[u] != DELIVERED:
                continue
            at = max(at, last[u])
        elif far[v] == KNOWN:
            at = max(at, far_at[v])
        elif far[v]:
            continue
        first[v] = at
        if fixed[v] < 0:
            got[v], tries[v], last[v] = DELIVERED, 1, at
            continue
        for a in range(ATTEMPTS):
            if at + _WAITED[a] >= fixed[v] and not bad[v] >> a & 1:
                got[v], tries[v], last[v] = DELIVERED, a + 1, at + _WAITED[a]
                break
        else:
            got[v], tries[v], last[v] = DEAD, ATTEMPTS, at + _WAITED[-1]
    status = np.array(got, np.int8)

    def below(roots: np.ndarray, own: int) -> np.ndarray:
        """Whether a turn is in the subtree of one of ``roots``; ``own`` 1: not as the root itself."""
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, enter[roots] + own, 1)
        np.add.at(change, leave[roots], -1)
        return (np.cumsum(change[:n]) > 0)[enter]

    blocked = below(np.flatnonzero(status == DEAD), 1) | below(np.flatnonzero((parent < 0) & (outer == LOST)), 0)
    waiting = below(np.flatnonzero((parent < 0) & (outer == OTHERS)), 0)
    status[blocked] = BLOCKED
    status[waiting] = 0
    return status, np.array(tries, np.int32), np.array(first, np.int64), np.array(last, np.int64)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)


def replayed(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (conv, p, status, attempts, first_at, last_at) of turns (conv, p, parent, arrival, repair, fails): numbers
    p from 0 within a conversation (any bigint, not null), the parent's p (null, not in 0 to p - 1: none), and what :func:`outcomes` takes
    (repair null: no fault).

    A task takes ``block`` neighbouring turns of a conversation, so that a long one is shared out. What
    hangs on a turn of an earlier block waits for the next round, in which the outcomes of such parents
    are joined to them; there are as many rounds as a chain of answers crosses blocks.
    """
    number = F.floor(F.col("p") / block).cast("bigint")
    at = F.when((F.col("parent") >= 0) & (F.col("parent") < F.col("p")), F.col("parent"))
    todo = turns.select("conv", "p", at.alias("parent"), "arrival", F.coalesce("repair", F.lit(-1)).cast("bigint").alias("repair"), "fails", F.lit(0).cast("tinyint").alias("outer"), F.lit(-1).cast("bigint").alias("outer_at"))
    todo = todo.withColumn("outer", F.when(F.floor(F.col("parent") / block) < number, F.lit(OTHERS)).otherwise(F.lit(0)).cast("tinyint"))
    names = todo.columns

    def run(batches):
        memo(None)
        held = None

        def settled(rows):
            conv, p, parent, arrival, repair, fails, outer, outer_at = (rows.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in names)
            unit = p // block
            head = np.flatnonzero(_same(conv, unit))
            start = np.repeat(head, np.diff(np.append(head, len(p))))
            local = np.where((parent >= 0) & (outer == 0), start + parent - p[start], -1)
            # Numbers of a block can have gaps, if earlier rounds have settled some of its turns.
            if len(p) and (p != p[start] + np.arange(len(p)) - start).any():
                key = {(c, k): i for i, (c, k) in enumerate(zip(conv.tolist(), p.tolist(), strict=True))}
                inside = (parent >= 0) & (outer == 0)
                local = np.array([key[c, k] if x else -1 for c, k, x in zip(conv.tolist(), parent.tolist(), inside.tolist(), strict=True)], np.int64)
            status, tries, first, last = outcomes(local.astype(np.int64), arrival, repair, fails, outer, outer_at)
            none = lambda x, kind: pa.array(x, kind, mask=x < 0)
            more = [pa.array(status.astype(np.int32)), pa.array(tries), none(first, pa.int64()), none(last, pa.int64())]
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *more], [*names, "status", "attempts", "first_at", "last_at"])

        for batch in merged(batches, 20_000):
            batch = batch if held is None else pa.concat_batches([held, batch])
            conv, unit = batch.column("conv").to_numpy(zero_copy_only=False), batch.column("p").to_numpy() // block
            cut = int(np.flatnonzero(_same(conv, unit))[-1])
            if cut:
                yield settled(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None:
            yield settled(held)

    schema = "conv bigint, p bigint, parent bigint, arrival bigint, repair bigint, fails int, outer tinyint, outer_at bigint, status int, attempts int, first_at bigint, last_at bigint"
    done = None
    while True:
        dealt = todo.repartition("conv", number).sortWithinPartitions("conv", "p")
        now = stored(dealt.transform(in_arrow, run, schema), "outcomes")
        settled = now.where("status > 0").select("conv", "p", "status", "attempts", "first_at", "last_at")
        done = settled if done is None else done.union(settled)
        rest = now.where("status = 0")
        if rest.isEmpty():
            return done
        parents = done.select(F.col("conv").alias("c"), F.col("p").alias("q"), F.when(F.col("status") == DELIVERED, KNOWN).otherwise(LOST).cast("tinyint").alias("is"), F.col("last_at").alias("at"))
        asked = rest.where(F.col("outer") == OTHERS).join(parents.hint("merge"), (F.col("conv") == F.col("c")) & (F.col("parent") == F.col("q")), "left")
        asked = asked.withColumn("outer", F.coalesce("is", "outer")).withColumn("outer_at", F.coalesce(F.when(F.col("is") == KNOWN, F.col("at")), "outer_at"))
        todo = stored(asked.select(names).union(rest.where(F.col("outer") != OTHERS).select(names)), "waiting")


def running(rows: DataFrame, order: list[str], weight: str, block_rows: int | None = None) -> DataFrame:
    """``rows`` (conv and others) with fl_no, a row's number from 1 within its conversation by ``order``, and
    fl_state, the sum of number times ``weight`` (a bigint) up to it.

    Rows are range-partitioned by conversation and order, so that a long conversation spreads over partitions.
    Each partition numbers what it has; the partitions' own sums of a conversation that goes on from one to
    the next are added up in groups of FAN, the groups' sums again, and so on, and only rows of
    such a conversation take what came before them.
    """
    count = block_rows and max(1, -(-rows.count() // block_rows))
    ranged = (rows.repartitionByRange(count, "conv", *order) if count else rows.repartitionByRange("conv", *order)).sortWithinPartitions("conv", *order)
    names = rows.columns

    def run(batches):
        memo(None)
        part, key, base = TaskContext.get().partitionId(), None, (0, 0, 0)
        for batch in merged(batches, 20_000):
            conv = batch.column("conv").to_numpy(zero_copy_only=False)
            w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            head = np.flatnonzero(_same(conv, conv))
            size = np.diff(np.append(head, len(conv)))
            before = np.zeros((3, len(head)), np.int64)
            if key is not None and conv[0] == key:
                before[:, 0] = base
            no = np.arange(len(conv)) - np.repeat(head, size) + 1 + np.repeat(before[0], size)
            sums = np.cumsum(w)
            light = sums - np.repeat(sums[head] - w[head], size) + np.repeat(before[1], size)
            sums = np.cumsum(no * w)
            state = sums - np.repeat(sums[head] - (no * w)[head], size) + np.repeat(before[2], size)
            key, base = conv[-1], (no[-1], light[-1], state[-1])
            more = [pa.array(np.full(len(conv), part, np.int64)), *(pa.array(x) for x in (no, light, state))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], [*names, "fl_part", "fl_no", "fl_light", "fl_state"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", fl_part bigint, fl_no bigint, fl_light bigint, fl_state bigint"
    parted = stored(ranged.transform(in_arrow, run, schema), "parted")
    each = parted.groupBy("conv", "fl_part").agg(F.max(F.struct("fl_no", "fl_light", "fl_state")).alias("own"))
    each = each.select("conv", "fl_part", "own.*").toDF("conv", "part", "n", "light", "state")
    several = each.groupBy("conv").agg(F.count("*").alias("parts")).where("parts > 1").select("conv")
    sums = stored(each.join(several.hint("merge"), "conv", "left_semi"), "sums")
    if sums.isEmpty():
        return parted.select(*names, "fl_no", "fl_state")
    before = stored(_before(sums), "before").toDF("c", "q", "n0", "light0", "state0")
    open_ = parted.join(before.hint("merge"), (F.col("conv") == F.col("c")) & (F.col("fl_part") == F.col("q")), "left")
    n0 = F.coalesce("n0", F.lit(0))
    state = _wrapped(_wide("fl_state") + _wide(F.coalesce("state0", F.lit(0))) + _wide(n0) * _wide("fl_light"))
    return open_.select(*names, (F.col("fl_no") + n0).alias("fl_no"), F.when(n0 == 0, F.col("fl_state")).otherwise(state).alias("fl_state"))


def _wide(col):
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(19,0)")


def _wrapped(x):
    """A sum as a long that goes round beyond 64 bits, as the sums within a partition do."""
    half = F.lit(2).cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(20,0)")
    return (F.pmod(x + half, half * 2) - half).cast("bigint")


def _before(sums: DataFrame) -> DataFrame:
    """Rows (conv, part, n, light, state) of the sums of all parts before a part, from each part's own.

    What comes before a part is what comes before its group of FAN parts, then what the group's earlier parts hold:
    after n rows, numbers are n larger, so that the state of what follows grows by n times its weight.
    """
    levels = []
    now = sums
    for level in range(LEVELS):
        unit = F.floor(F.col("part") / FAN).cast("bigint")
        window = Window.partitionBy("conv", "unit") if level < LEVELS - 1 else Window.partitionBy("conv")
        earlier = window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        own = now.withColumn("unit", unit).withColumn("n0", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        own = own.withColumn("moved", _wrapped(_wide("state") + _wide("n0") * _wide("light")))
        wide_sum = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(19,0)")).over(earlier), F.lit(0).cast("decimal(29,0)"))
        own = own.withColumn("light0", _wrapped(wide_sum("light"))).withColumn("state0", _wrapped(wide_sum("moved")))
        own = stored(own, "level") if level else own
        levels.append(own.select("conv", "part", "unit", "n0", "light0", "state0"))
        if level < LEVELS - 1:
            now = own.groupBy("conv", "unit").agg(F.sum("n").alias("n"), _wrapped(F.sum(F.col("light").cast("decimal(19,0)"))).alias("light"), _wrapped(F.sum(F.col("moved").cast("decimal(19,0)"))).alias("state")).withColumnRenamed("unit", "part")
    out = levels[-1].drop("unit")
    for own in reversed(levels[:-1]):
        up = out.toDF("c", "q", "n1", "light1", "state1")
        both = own.join(up.hint("merge"), (F.col("conv") == F.col("c")) & (F.col("unit") == F.col("q")))
        state = _wrapped(_wide("state1") + _wide("state0") + _wide("n1") * _wide("light0"))
        out = both.select("conv", "part", (F.col("n0") + F.col("n1")).alias("n0"), _wrapped(_wide("light0") + _wide("light1")).alias("light0"), state.alias("state0"))
    return out.toDF("conv", "part", "n", "light", "state")


def released(turns: DataFrame, block: int = BLOCK, block_rows: int | None = None) -> DataFrame:
    """Rows (conv, p, status, attempts, first_at, last_at, release_no, state) of turns (conv, p, parent, arrival, repair,
    fails, weight), with whatever other columns ``turns`` has (not of these names, nor beginning with fl_).

    status: delivered, dead (after ATTEMPTS failures) or blocked (below a dead turn: 0 attempts, no times). Delivered
    turns are numbered from 1 in their conversation by last_at and p; state is the sum of number times ``weight`` up to
    a turn, modulo 2 ** 64 as a signed number. Others have neither. conv and p are bigints that aren't null, p unique in its
    conversation; a null weight counts as 0. An empty table gives none.
    """
    own = turns.drop("parent", "arrival", "repair", "fails").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("bigint"))
    done = stored(replayed(turns, block).join(own.hint("merge"), ["conv", "p"]), "replayed")
    numbered = running(done.where(F.col("status") == DELIVERED), ["last_at", "p"], "weight", block_rows)
    names = F.element_at(F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv)), F.col("status"))
    some = ["conv", "p", *(c for c in own.columns if c not in ("conv", "p", "weight")), names.alias("status"), "attempts", "first_at", "last_at"]
    none = F.lit(None).cast("bigint")
    rest = done.where(F.col("status") != DELIVERED).select(*some, none.alias("release_no"), none.alias("state"))
    return numbered.select(*some, F.col("fl_no").alias("release_no"), F.col("fl_state").alias("state")).union(rest)


def positions(turns: DataFrame, order: list[str], block_rows: int | None = None) -> DataFrame:
    """``turns`` (conv and others) with p, a turn's place in its conversation by ``order``, from 0; nulls come first."""
    numbered = running(turns.withColumn("fl_none", F.lit(0).cast("bigint")), order, "fl_none", block_rows)
    return numbered.withColumn("p", F.col("fl_no") - 1).drop("fl_none", "fl_no", "fl_state")
