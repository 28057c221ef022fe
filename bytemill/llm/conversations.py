"""Conversation structure repair by lazily determinised weighted automata.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. A row is kept (K, 0), given another role (R to
user or assistant, 1) or deleted (D, 2; the only choice for blank and duplicate rows); an empty row can be put in
anywhere (I, 5); a truncated row that stays costs 5 more. What it costs to go on from each state of the pattern, less
the least of these costs, is one state of a deterministic automaton; its arcs are made when they are first met and kept
in a table. Reading a conversation from its end over this table gives the costs; going back over the arcs read, from the
first row on, always by the letter that is least in ASCII among those that lose nothing, gives the audit and the rows.

Rows are dealt to tasks by ranges of (conversation, turn, role, beginning of the text), so that a conversation of any
length is spread. A task repairs the conversations that lie inside it. Those at its borders, and those longer than CHUNK
rows, become chunks: duplicates among them are found by hash, each chunk gives the least costs from state to state, these
are chained for each conversation, and every chunk is then traced from its own state. Only the digest of such a
conversation, which is serial by its nature, streams in one task.

Faults: blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated (the
last character that isn't white space is none of ``.!?``); the first that holds counts. Rows stand in the order of turn
(nulls first), then role and text. A null role or text is one space, as is a null id or turn where damage is drawn. Rows
without a conv_id are one conversation. Repeated rows are duplicates. Conversations without rows after damage have zeros
and an empty audit. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, scratch, written

#: Rows and bytes of text of a chunk at most (one row at least); characters of a text that ranges are cut by.
CHUNK, CHUNK_BYTES, PREFIX = 2048, 8 << 20, 64
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the pattern: before all, after s, after u, after a; where each initial leads. Users and assistants can be put in.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
FREE = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
INITIALS = "sua"
LEGAL = ((0, 1), (1, 2), (2, 1))
SOUND, BLANK, CUT, DROPPED = range(4)
MUST_GO = 8
_WHITE = "".join(map(chr, SEPARATORS))
_INF = float("inf")
_TURNS = pa.struct([("role", pa.string()), ("text", pa.string())])
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Repairs:
    """The automaton of cost vectors. ``arcs[state][symbol]``: the state before the row, its weight, and for each state of
    the pattern the letters, the roles of the rows that go out (None: the row's own) and the state after the row."""

    def __init__(self) -> None:
        self.ids: dict[tuple[float, ...], int] = {}
        self.vectors: list[tuple[float, ...]] = []
        self.arcs: list[list[tuple | None]] = []
        self.end = self.state([0.0 if q in ACCEPTING else INSERT * (3 - q) for q in range(4)])[0]

    def state(self, costs: list[float]) -> tuple[int, float]:
        """The state of these costs, and what was taken off all of them."""
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.ids:
            self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.arcs.append([None] * (MUST_GO + 1))
        return self.ids[vector], least

    def arc(self, state: int, symbol: int) -> tuple:
        made = self.arcs[state][symbol]
        if made is None:
            after = self.vectors[state]
            best = []
            for q, steps in enumerate(STEPS):
                ways = [(DELETE + after[q], "D", (), q)]
                if symbol != MUST_GO:
                    more, initial = TRUNCATED * (symbol & 1), (INITIALS + "?")[symbol >> 1]
                    if initial in steps:
                        ways.append((more + after[steps[initial]], "K", (None,), steps[initial]))
                    to = steps[FREE[q]]
                    ways.append((RETYPE + more + after[to], "R", (ROLES[FREE[q]],), to))
                best.append(min(ways, key=lambda w: w[:2]))
            for _ in range(3):
                for q in range(4):
                    cost, letters, roles, to = best[STEPS[q][FREE[q]]]
                    best[q] = min(best[q], (INSERT + cost, "I" + letters, (ROLES[FREE[q]], *roles), to), key=lambda w: w[:2])
            before, weight = self.state([w[0] for w in best])
            made = self.arcs[state][symbol] = (before, weight, tuple(w[1:] for w in best))
        return made

    def scan(self, symbols: list[int], state: int) -> tuple[list[tuple], int, float]:
        """The arcs of the rows, from the last to the first and given in their order, the state before them, and the sum of the weights."""
        arcs, table, total = [None] * len(symbols), self.arcs, 0.0
        for i in range(len(symbols) - 1, -1, -1):
            arc = table[state][symbols[i]] or self.arc(state, symbols[i])
            arcs[i] = arc
            state = arc[0]
            total += arc[1]
        return arcs, state, total

    def costs(self, symbols: list[int]) -> list[float]:
        """The least costs from each state before the rows to each state after them, row by row of the matrix."""
        matrix = []
        for to in range(4):
            _, state, total = self.scan(symbols, self.state([0.0 if q == to else _INF for q in range(4)])[0])
            matrix.append([c + total for c in self.vectors[state]])
        return [matrix[to][q] for q in range(4) for to in range(4)]


@lru_cache(1)
def automaton() -> Repairs:
    return Repairs()


def trace(arcs: list[tuple], q: int, ending: bool) -> tuple[str, list[tuple[int, str | None]], int]:
    """The audit, the rows that go out (number of the row or -1, role or None for its own) and the last state."""
    audit, out = [], []
    for i, arc in enumerate(arcs):
        letters, roles, q = arc[2][q]
        audit.append(letters)
        for k, role in enumerate(roles, 1):
            out.append((i if k == len(roles) and letters[-1] != "D" else -1, role))
    while ending and q not in ACCEPTING:
        audit.append("I")
        out.append((-1, ROLES[FREE[q]]))
        q = STEPS[q][FREE[q]]
    return "".join(audit), out, q


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``dropped`` of the damaged rows, by crc32 of ``conv_id:turn``: of each 20 numbers, 0 drops a
    row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it a user's. Nulls are one space. Dropped rows stay, marked."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), kind.alias("kind"))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with the number of their role's initial and their own fault."""
    bare = F.btrim("text", F.lit(_WHITE))
    fault = F.when(F.col("dropped"), DROPPED).when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT)
    first = F.substring("role", 1, 1)
    initial = F.coalesce(*(F.when(first == c, i) for i, c in enumerate(INITIALS)), F.lit(len(INITIALS)))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", initial.cast("int").alias("initial"), fault.cast("int").alias("fault"))


def _turn_figures(turns: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last turn and number of different turns of each stretch of sorted rows; nulls first and left out (none: 0 of them)."""
    valid = turns.is_valid().to_numpy(zero_copy_only=False)
    values = turns.fill_null(0).to_numpy()
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (values[1:] != values[:-1])
    fresh[starts[:-1][starts[:-1] < len(values)]] = valid[starts[:-1][starts[:-1] < len(values)]]
    upto = np.append(0, np.cumsum(fresh))
    n = upto[starts[1:]] - upto[starts[:-1]]
    places = np.flatnonzero(fresh)
    low, high = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    some = n > 0
    low[some] = values[places[upto[starts[:-1]][some]]]
    high[some] = values[starts[1:][some] - 1]
    return low, high, n


def _symbols(initial: np.ndarray, fault: np.ndarray, again: np.ndarray) -> np.ndarray:
    return np.where((fault == BLANK) | again, MUST_GO, 2 * initial + (fault == CUT))


def _turn_lists(table: pa.Table, out: list[list[tuple[int, str | None]]], starts: np.ndarray) -> pa.Array:
    """The rows that go out of each stretch, with their roles and texts."""
    rows = table.num_rows
    texts = pa.concat_arrays([*table.column("text").chunks, pa.array([""])])
    own = table.column("role").to_pylist()
    places, roles = [], []
    for start, part in zip(starts.tolist(), out, strict=False):
        for i, role in part:
            places.append(start + i if i >= 0 else rows)
            roles.append(own[start + i] if role is None else role)
    turns = pa.StructArray.from_arrays([pa.array(roles, pa.string()), texts.take(pa.array(places, pa.int64()))], fields=list(_TURNS))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), turns)


_FIRST = pa.schema(
    [("conv_id", pa.int64()), ("alone", pa.bool_()), ("part", pa.int64()), ("seq", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("turns", pa.list_(_TURNS)), ("rows", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("initial", pa.int32()), ("fault", pa.int32())])))]
)
_FIRST_SQL = f"conv_id long, alone boolean, part long, seq long, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, turns array<struct<role:string,text:string>>, rows array<struct<turn:bigint,role:string,text:string,initial:int,fault:int>>"


def _alone(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """The repaired conversations of a sorted table, which holds them whole."""
    repairs = automaton()
    first = table.column("conv_id").take(pa.array(starts[:-1])).combine_chunks()
    here = table.column("fault").to_numpy() != DROPPED
    starts = np.append(0, np.cumsum(here))[starts]
    table = table.filter(pa.array(here)).combine_chunks()
    n = len(starts) - 1
    initial, fault = (table.column(c).to_numpy() for c in ("initial", "fault"))
    owner = np.repeat(np.arange(n), np.diff(starts))
    codes = [table.column(c).combine_chunks().dictionary_encode() for c in ("role", "text")]
    keys = (owner * max(1, len(codes[0].dictionary)) + codes[0].indices.to_numpy()) * max(1, len(codes[1].dictionary)) + codes[1].indices.to_numpy()
    again = np.ones(len(keys), bool)
    again[np.unique(keys, return_index=True)[1]] = False
    low, high, different = _turn_figures(table.column("turn").combine_chunks(), starts)
    count = lambda mask: np.bincount(owner[mask], minlength=n)
    legal = np.zeros((4, 4), bool)
    legal[tuple(zip(*LEGAL, strict=True))] = True
    apart = np.append(~legal[initial[:-1], initial[1:]] & (owner[1:] == owner[:-1]), False) if len(owner) else np.zeros(0, bool)
    counts = [np.where(different > 0, high - low + 1 - different, 0), count(fault == BLANK), count(again & (fault != BLANK)), count((fault == CUT) & ~again), count(apart)]
    symbols = _symbols(initial, fault, again).tolist()
    costs, audits, outs = [], [], []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        arcs, state, total = repairs.scan(symbols[a:b], repairs.end)
        costs.append(int(total + repairs.vectors[state][0]))
        audit, out, _ = trace(arcs, 0, True)
        audits.append(audit)
        outs.append(out)
    columns = [first, pa.array(np.ones(n, bool)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *(pa.array(c, pa.int64()) for c in (*counts, costs)), pa.array(audits, pa.string()), _turn_lists(table, outs, starts[:-1]), pa.nulls(n, _FIRST.field("rows").type)]
    return pa.RecordBatch.from_arrays(columns, schema=_FIRST)


def _chunks(table: pa.Table, part: int, seq: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows of one conversation, in chunks of bounded size."""
    conv = table.column("conv_id")[0].as_py()
    sizes = np.cumsum(pc.binary_length(table.column("text")).to_numpy().astype(np.int64))
    at, n = 0, table.num_rows
    while at < n:
        before = sizes[at - 1] if at else 0
        to = min(n, at + chunk, max(at + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, side="right"))))
        rows = table.slice(at, to - at).combine_chunks()
        here = rows.filter(pa.array(rows.column("fault").to_numpy() != DROPPED)).combine_chunks()
        kind = _FIRST.field("rows").type.value_type
        values = pa.StructArray.from_arrays([here.column(f.name).combine_chunks().cast(f.type) for f in kind], fields=list(kind))
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([False]), pa.array([part], pa.int64()), pa.array([seq], pa.int64()), *(pa.nulls(1, f.type) for f in list(_FIRST)[4:-1]), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)],
            schema=_FIRST,
        )
        at, seq = to, seq + 1


def _first_pass(chunk: int):
    """Sorted rows of a range: conversations inside it are repaired, those at its borders and long ones come as chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: pa.Table | None = None
        begun, of = True, None  # whether rows of the conversation that is open lie elsewhere; its id, as a list of one
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            ids = table.column("conv_id").combine_chunks()
            values, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            starts = np.append(0, 1 + np.flatnonzero((values[1:] != values[:-1]) | (null[1:] != null[:-1])))
            begun = begun and of in (None, [ids[0].as_py()])
            whole = 0
            if begun and len(starts) > 1:
                for made in _chunks(table.slice(0, starts[1]), part, seq, chunk):
                    yield made
                    seq += 1
                whole = 1
            if len(starts) - 1 > whole:
                yield _alone(table.slice(starts[whole], starts[-1] - starts[whole]), starts[whole:] - starts[whole])
            begun, of = begun and len(starts) == 1, [ids[len(ids) - 1].as_py()]
            held = table.slice(starts[-1])
            if held.num_rows > chunk or held.nbytes > CHUNK_BYTES:
                for made in _chunks(held, part, seq, chunk):
                    yield made
                    seq += 1
                held, begun = None, True
        if held is not None and held.num_rows:
            yield from _chunks(held, part, seq, chunk)

    return run


_FIGURES = "conv_id long, part long, seq long, costs array<double>, low long, high long, different long, first int, last int, blank long, duplicate long, truncated long, illegal long"


def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: costs from state to state, turns, initials at both ends, faults."""
    names = [x.split()[0] for x in _FIGURES.split(", ")]
    for batch in batches:
        made = []
        for row in batch.to_pylist():
            rows, symbols = row["rows"], row["symbols"]
            turns = [r["turn"] for r in rows if r["turn"] is not None]
            initials = [r["initial"] for r in rows]
            gone = sum(s == MUST_GO for s in symbols)
            blank = sum(r["fault"] == BLANK for r in rows)
            cut = sum(r["fault"] == CUT and s != MUST_GO for r, s in zip(rows, symbols, strict=True))
            apart = sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False))
            ends = (initials[0], initials[-1]) if rows else (None, None)
            made.append([row["conv_id"], row["part"], row["seq"], automaton().costs(symbols), turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), *ends, blank, gone - blank, cut, apart])
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], names)


_CHAINED = f"part long, seq long, state array<double>, ending boolean, {', '.join(f'{c} long' for c in _COUNTS)}"


def _chain(table: pa.Table) -> pa.Table:
    """Of each chunk of a conversation: the costs of going on after it. The conversation's figures stand at its first chunk."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    repairs = automaton()
    at = list(repairs.vectors[repairs.end])
    base, states = 0.0, []
    for r in reversed(rows):
        states.append(at)
        new = [min(r["costs"][4 * q + to] + at[to] for to in range(4)) for q in range(4)]
        base += min(new)
        at = [c - min(new) for c in new]
    total = dict.fromkeys(_COUNTS, 0) | {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["cost"] = int(base + at[0])
    last = before = None
    different = 0
    for r in rows:
        if r["first"] is not None:
            total["illegal"] += last is not None and (last, r["first"]) not in LEGAL
            last = r["last"]
        if r["different"]:
            different += r["different"] - (before == r["low"])
            before = r["high"]
    lows = [r["low"] for r in rows if r["different"]]
    total["gaps"] = before - lows[0] + 1 - different if lows else 0
    columns = {"part": [r["part"] for r in rows], "seq": [r["seq"] for r in rows], "state": states[::-1], "ending": [i == len(rows) - 1 for i in range(len(rows))]}
    columns |= {c: [total[c] if i == 0 else 0 for i in range(len(rows))] for c in _COUNTS}
    return pa.table(columns)


def _arcs(row: dict) -> list[tuple]:
    repairs = automaton()
    return repairs.scan(row["symbols"], repairs.state(row["state"])[0])[0]


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: the state that its trace ends in, from each state that it may begin in."""
    for batch in batches:
        rows = batch.to_pylist()
        ends = [[trace(_arcs(r), q, False)[2] for q in range(4)] for r in rows]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("seq"), pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "part", "seq", "exits"])


def _entries(table: pa.Table) -> pa.Table:
    q, made = 0, []
    for r in sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"])):
        made.append((r["part"], r["seq"], q))
        q = r["exits"][q]
    return pa.table(dict(zip(("part", "seq", "entry"), map(list, zip(*made, strict=True)), strict=True)))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, row in enumerate(batch.to_pylist()):
            audit, out, _ = trace(_arcs(row), row["entry"], row["ending"])
            turns = [{"role": r["role"] if role is None else role, "text": r["text"]} if k >= 0 else {"role": role, "text": ""} for k, role in out for r in [row["rows"][k] if k >= 0 else {}]]
            columns = [batch.column(c).slice(i, 1) for c in ("conv_id", "part", "seq", *_COUNTS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([audit], pa.string()), pa.array([turns], pa.list_(_TURNS))], ["conv_id", "part", "seq", *_COUNTS, "audit", "turns"])


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Repaired conversations (of rows with conv_id, turn, role, text, dropped, as ``damage`` gives them) in pieces.

    conv_id, alone, part, seq, figures, audit, turns: a piece that is alone is a whole conversation; others follow each
    other by part and seq, and their figures add up. Conversations of dropped rows only have one empty piece or more.
    """
    spark = rows.sparkSession
    order = ["conv_id", "turn", "role", F.substring("text", 1, PREFIX).alias("beginning")]
    # Equal rows are told apart by their place in the scan, so that many of them are spread as well.
    dealt = _marked(rows).withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
    dealt = dealt.repartitionByRange(*order, "place").sortWithinPartitions("conv_id", "turn", "role", "text").drop("place")
    at = scratch(spark, "conversations")
    dealt.mapInArrow(_first_pass(chunk), _FIRST_SQL).write.partitionBy("alone").parquet(at)
    made = spark.read.schema(_FIRST_SQL).parquet(at)
    keys = ["part", "seq"]
    chunks = made.filter("NOT alone").select("conv_id", *keys, "rows")
    each = chunks.select("conv_id", *keys, F.posexplode("rows").alias("i", "r")).select("conv_id", *keys, "i", F.xxhash64("r.role", "r.text").alias("h1"), F.xxhash64(F.lit(7), "r.text", "r.role").alias("h2"))
    firsts = each.groupBy("conv_id", "h1", "h2").agg(F.min(F.struct(*keys, "i")).alias("x")).groupBy("x.part", "x.seq").agg(F.collect_list("x.i").alias("firsts"))
    symbol = lambda r, i: F.when((r["fault"] == BLANK) | ~F.coalesce(F.array_contains("firsts", i), F.lit(False)), MUST_GO).otherwise(2 * r["initial"] + (r["fault"] == CUT).cast("int"))
    marked = chunks.join(firsts, keys, "left").withColumn("symbols", F.transform("rows", symbol)).drop("firsts")
    marked = written(marked, f"{at}-marked")
    chained = written(marked.mapInArrow(_figures, _FIGURES).groupBy("conv_id").applyInArrow(_chain, _CHAINED), f"{at}-chained")
    with_state = marked.join(chained, keys)
    exits = with_state.select("conv_id", *keys, "symbols", "state").mapInArrow(_exits, "conv_id long, part long, seq long, exits array<int>")
    entries = written(exits.groupBy("conv_id").applyInArrow(_entries, "part long, seq long, entry long"), f"{at}-entries")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    traced = with_state.join(entries, keys).mapInArrow(_traced, f"conv_id long, part long, seq long, {counts}, audit string, turns array<struct<role:string,text:string>>")
    alone = made.filter("alone").drop("rows")
    return alone.unionByName(traced.withColumn("alone", F.lit(False)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures, audit and hash of each conversation, from its pieces in order; only its audit is held."""
    types = [pa.int64(), *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    open_: list | None = None

    def closed() -> pa.RecordBatch:
        row = [open_[0], *open_[1], "".join(open_[2]), open_[3].hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    for batch in batches:
        for row in batch.to_pylist():
            if open_ is None or open_[0] != row["conv_id"]:
                if open_ is not None:
                    yield closed()
                open_ = [row["conv_id"], [0] * len(_COUNTS), [], hashlib.sha256(), False]
            open_[1] = [a + row[c] for a, c in zip(open_[1], _COUNTS, strict=True)]
            open_[2].append(row["audit"])
            for turn in row["turns"]:
                open_[3].update((("\n" if open_[4] else "") + f"{turn['role']}:{turn['text']}").encode())
                open_[4] = True
    if open_ is not None:
        yield closed()


def digest(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, figures, audit, repaired_sha256 (of ``role:text``, joined by newlines)."""
    alone = pieces.filter("alone")
    lines: Column = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = alone.select("conv_id", *_COUNTS, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    rest = pieces.filter("NOT alone").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").drop("alone")
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return whole.unionByName(rest.mapInArrow(_digests, f"conv_id long, {counts}, audit string, repaired_sha256 string"))


def turns(pieces: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, part, seq, place in the piece, role, text."""
    return pieces.select("conv_id", "part", "seq", F.posexplode("turns").alias("place", "t")).select("conv_id", "part", "seq", "place", "t.role", "t.text")
