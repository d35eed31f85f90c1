"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in turns, ending with the assistant.
Dynamic programming over that automaton gives each turn a role at least total cost: a turn may be
relabelled (4; 2 if its role is unknown), merged into the message before it (1), or preceded, or at the
end followed, by inserted empty messages (3 each). Ties go to the option listed first: as it is,
merged, inserted. The repaired sequence is rendered in segments, one for each given turn, whose concatenation
in order is the conversation's text; so no conversation needs to fit one row or task.

All turns are numbered in order of conversation, turn (null last), role, hash of the text; range partitions do that, so a conversation of any
size, or one turn number that repeats, is no single task. Long conversations are cut into blocks of BLOCK
turns. Each block's least costs from every state to every other are
a small matrix; the matrices of a conversation, chained, fix the states between its blocks, in which
each block then finds its own path. A null conv_id is a
conversation, ids that aren't whole numbers are told apart as strings, a null or unknown role is one to be relabelled, a null text is empty. Marks of the format
within a text are broken up. Repeated rows are repeated turns. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tokenloom.llm.common import cut, ship, split_join
from tokenloom.llm.sharding import number_rows

BLOCK = 1024
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 4, 2, 1, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: From a state to the next message's state: (cost, merged, inserted roles), best first; what isn't here is illegal.
MOVES = {
    (START, SYSTEM): (0, False, ()), (START, USER): (0, False, ()), (START, ASSISTANT): (INSERT, False, ("user",)),
    (SYSTEM, SYSTEM): (MERGE, True, ()), (SYSTEM, USER): (0, False, ()), (SYSTEM, ASSISTANT): (INSERT, False, ("user",)),
    (USER, USER): (MERGE, True, ()), (USER, ASSISTANT): (0, False, ()),
    (ASSISTANT, USER): (0, False, ()), (ASSISTANT, ASSISTANT): (MERGE, True, ()),
}
_STEPS = [(p, q, cost) for (p, q), (cost, _, _) in MOVES.items()]
#: What ends a conversation from a state: (cost, inserted roles).
ENDS = {SYSTEM: (2 * INSERT, ("user", "assistant")), USER: (INSERT, ("assistant",)), ASSISTANT: (0, ())}


def state_of(role: object) -> int | None:
    """The state of a message with this role, or None for an unknown role."""
    name = role.strip().lower() if isinstance(role, str) else ""
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else None


def _relabel(given: int | None, to: int) -> int:
    return 0 if given == to else RELABEL_UNKNOWN if given is None else RELABEL


def step(costs: list[int], given: int | None) -> tuple[list[int], list[int]]:
    """Least costs of the states after a turn, and the states they come from."""
    after, back = [NEVER] * 4, [0] * 4
    relabel = [0, *[_relabel(given, q) for q in (SYSTEM, USER, ASSISTANT)]]
    for p, q, cost in _STEPS:
        total = costs[p] + cost + relabel[q]
        if total < after[q]:
            after[q], back[q] = total, p
    return after, back


def matrix(roles: list[object]) -> list[int]:
    """Least costs from each state (16 numbers, row by row) over a block's turns."""
    out = []
    for p in range(4):
        costs = [0 if s == p else NEVER for s in range(4)]
        for role in roles:
            costs, _ = step(costs, state_of(role))
        out += [min(c, NEVER) for c in costs]
    return out


def chain(matrices: list[list[int]]) -> list[int]:
    """The states between blocks, START first, of a cheapest legal conversation."""
    costs, backs = [0, NEVER, NEVER, NEVER], []
    for m in matrices:
        after, back = [NEVER] * 4, [0] * 4
        for p in range(4):
            for q in range(4):
                if costs[p] + m[4 * p + q] < after[q]:
                    after[q], back[q] = costs[p] + m[4 * p + q], p
        costs = after
        backs.append(back)
    state = min(ENDS, key=lambda s: (costs[s] + ENDS[s][0], -s))
    states = [state]
    for back in reversed(backs):
        states.append(back[states[-1]])
    return states[::-1]


def path(roles: list[object], enter: int, leave: int) -> list[int]:
    """The states after each turn of a cheapest way through a block between two states."""
    costs, backs = [0 if s == enter else NEVER for s in range(4)], []
    for role in roles:
        costs, back = step(costs, state_of(role))
        backs.append(back)
    states = [leave]
    for back in reversed(backs[1:]):
        states.append(back[states[-1]])
    return states[::-1]


def _open(role: str) -> str:
    return f"<|im_start|>{role}\n"


CLOSE = "<|im_end|>\n"


def segments(roles: list[object], texts: list[object], enter: int, leave: int, last: bool) -> list[tuple[str, str, list[str], list[str], int, str]]:
    """For each turn: role, action, roles inserted before and after, cost and rendered segment."""
    out = []
    state = enter
    for i, (role, text, to) in enumerate(zip(roles, texts, path(roles, enter, leave), strict=True)):
        cost, merged, before = MOVES[state, to]
        given = state_of(role)
        cost += _relabel(given, to)
        after: tuple[str, ...] = ()
        if last and i + 1 == len(roles):
            extra, after = ENDS[to]
            cost += extra
        body = text if isinstance(text, str) else ""
        body = body.replace("<|im_start|>", "<|im_start |>").replace("<|im_end|>", "<|im_end |>")
        parts = ["\n"] if merged else [CLOSE if state != START else "", *[_open(r) + CLOSE for r in before], _open(ROLES[to - 1])]
        parts.append(body)
        if last and i + 1 == len(roles):
            parts += [CLOSE, *[_open(r) + CLOSE for r in after]]
        action = "+".join([*["relabel"] * (given != to), *["merge"] * merged, *["insert"] * bool(before or after)]) or "keep"
        out.append((ROLES[to - 1], action, list(before), list(after), cost, "".join(parts)))
        state = to
    return out


KEYS = ["none", "conv"]
FLUSH = 4000  # output rows that make a batch


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Key and columns, as lists, of each run of rows with equal keys."""
    held: dict[str, list] = {}
    last: tuple | None = None
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        rows = list(zip(*[columns[k] for k in keys], strict=True))
        at = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[at]:
                continue
            if last is not None and rows[at] != last:
                yield last, held
                held = {}
            for name, values in columns.items():
                held.setdefault(name, []).extend(values[at:i])
            last, at = rows[at], i
    if last is not None:
        yield last, held


def _emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows, so that small groups share one."""
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buffer, strict=True), schema, strict=True)], schema=schema)
            buffer = []
    if buffer:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buffer, strict=True), schema, strict=True)], schema=schema)


def _keys(conv: pa.DataType) -> list[tuple[str, pa.DataType]]:
    return [("none", pa.int32()), ("conv", conv), ("block", pa.int64())]


def _matrices(batches: Iterator[pa.RecordBatch], conv: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows = ((*key, matrix(g["role"])) for key, g in groups(batches, [*KEYS, "block"]))
    return _emit(rows, pa.schema([*_keys(conv), ("costs", pa.list_(pa.int64()))]))


def _chains(batches: Iterator[pa.RecordBatch], conv: pa.DataType) -> Iterator[pa.RecordBatch]:
    def rows():
        for key, g in groups(batches, KEYS):
            states = chain(g["costs"])
            for i, block in enumerate(g["block"]):
                yield *key, block, states[i], states[i + 1], i + 1 == len(g["block"])

    return _emit(rows(), pa.schema([*_keys(conv), ("enter", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())]))


_OUT = [("turn", pa.int64()), ("role", pa.string()), ("place", pa.int64()), ("new_role", pa.string()), ("action", pa.string()), ("inserted_before", pa.list_(pa.string())), ("inserted_after", pa.list_(pa.string())), ("cost", pa.int32()), ("segment", pa.string())]


def _repaired(batches: Iterator[pa.RecordBatch], conv: pa.DataType) -> Iterator[pa.RecordBatch]:
    def rows():
        for key, g in groups(batches, [*KEYS, "block"]):
            found = segments(g["role"], g["text"], g["enter"][0], g["leave"][0], g["last"][0])
            for i, segment in enumerate(found):
                yield *key, g["turn"][i], g["role"][i], i, *segment

    return _emit(rows(), pa.schema([*_keys(conv), *_OUT]))


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, block and place (its order), turn, role, new_role, action, inserted roles, cost, segment."""
    spark = conversations.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that small bytes but long work aren't put together
    whole = isinstance(conversations.schema["conv_id"].dataType, IntegralType)
    kind, arrow = ("long", pa.int64()) if whole else ("string", pa.string())
    conv = conversations["conv_id"].cast(kind)
    text = conversations["text"].cast("string")
    rows = conversations.select(
        conv.isNull().cast("int").alias("none"), F.coalesce(conv, F.lit(0 if whole else "")).alias("conv"),
        conversations["turn"].try_cast("long").alias("turn"), conversations["role"].cast("string").alias("role"), text.alias("text"),
        F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("id"),
    )
    order = ["none", "conv", F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), "hash", "id"]
    numbered = number_rows(rows, [F.col(c).asc() if isinstance(c, str) else c for c in order]).select("none", "conv", "turn", "role", "text", "row")
    first = cut(numbered.groupBy(*KEYS).agg(F.min("row").alias("start"), F.count("*").alias("turns")), "starts")
    placed = split_join(numbered, first, KEYS, "turns").withColumn("block", F.expr(f"(row - start) div {BLOCK}"))
    key = [*KEYS, "block"]
    slim = placed.select(*key, "row", "role").repartition(tasks, *key).sortWithinPartitions(*key, "row")
    names = f"none int, conv {kind}, block long"
    costs = cut(slim.mapInArrow(partial(_matrices, conv=arrow), f"{names}, costs array<long>"), "matrices")
    states = costs.repartition(tasks, *KEYS).sortWithinPartitions(*key).mapInArrow(partial(_chains, conv=arrow), f"{names}, enter int, leave int, last boolean")
    states = cut(states, "states")
    ready = placed.join(states, key).repartition(tasks, *key).sortWithinPartitions(*key, "row")
    schema = f"{names}, turn long, role string, place long, new_role string, action string, inserted_before array<string>, inserted_after array<string>, cost int, segment string"
    done = ready.select(*key, "turn", "role", "text", "enter", "leave", "last").mapInArrow(partial(_repaired, conv=arrow), schema)
    return done.select(F.when(F.col("none") == 0, F.col("conv")).alias("conv_id"), "block", "place", "turn", "role", "new_role", "action", "inserted_before", "inserted_after", "cost", "segment")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, cost and whole text; for conversations of which each fits one row."""
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "segment")))
    return repair(conversations).groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda x: x["segment"]), "").alias("text"))


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
