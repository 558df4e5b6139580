"""Operator 12: repair of conversation structure by a Viterbi over chunks that runs in parallel until ranks converge.

Turns lie in ranges of (conversation, turn), so a conversation may hold any share of the rows; within a range they
are cut to chunks of one conversation with at most ``CHUNK`` turns, one row each.  A role sequence is read by four states (start,
after system, after user, after assistant).  The cost of finishing from each state runs backwards through a chunk from the costs
behind it.  Chunks of conversations with one chunk start from the true end.  In longer ones every chunk starts
from a guess; then those whose right neighbour gave a vector that differs from what they used by more
than a constant run again, until none does: edits are cheap, so a chunk forgets what lies behind it
and one pass is usual.  With the vectors stitched, each chunk maps a state before it to one after it, the maps are composed along the
conversation, and each chunk traces its part of the least audit: the least letter at each step that keeps to the optimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from dossier.llm.shared import written

CHUNK = 4096
#: Bytes of text after which a chunk is closed.
CHUNK_BYTES = 4 << 20
SPACE = " \t\n\x0b\x0c\r"
RETYPE, DELETE, INSERT, CUT = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of finishing where nothing follows.
END = (0, 10, 5, 0)
FAR = 1 << 20
INITIALS = "sua"
_AFTER_INSERT = (USER, USER, ASSISTANT, USER)
_KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LEGAL = {"su", "ua", "au"}

Moves = tuple[tuple[str, int, int], ...]


def code_of(initial: str, forced: bool, cut: bool) -> int:
    """A turn as far as costs are concerned: the role's initial, whether it must go, whether it is truncated."""
    return 12 if forced else 4 * cut + (INITIALS.find(initial) if initial else -1) % 4


@lru_cache(maxsize=1 << 16)
def step(code: int, behind: tuple[int, ...]) -> tuple[tuple[int, ...], Moves]:
    """Costs of finishing from before a turn, less their least, and for each state the least letters, the next state and what they cost."""
    options: list[dict[str, tuple[int, int]]] = []
    for q in range(4):
        may = {"D": (DELETE, q)}
        if code < 12:
            cut = CUT if code >= 4 else 0
            kept = _KEPT.get(((INITIALS + "-")[code % 4], q))
            if kept is not None:
                may["K"] = (cut, kept)
            may["R"] = (RETYPE + cut, ASSISTANT if q == USER else USER)
        options.append(may)
    used = [min(cost + behind[to] for cost, to in may.values()) for may in options]
    best = list(used)
    best[USER], best[ASSISTANT] = min(used[USER], INSERT + used[ASSISTANT]), min(used[ASSISTANT], INSERT + used[USER])
    for q in (START, SYSTEM):
        best[q] = min(used[q], INSERT + best[USER])
    moves = []
    for q in range(4):
        letters, cost, now = "", 0, q
        while True:
            may = dict(options[now]) | {"I": (INSERT, -1)}
            for letter in sorted(may):
                paid, to = may[letter]
                rest = best[_AFTER_INSERT[now]] if letter == "I" else behind[to]
                if paid + rest == best[now]:
                    break
            letters, cost, now = letters + letter, cost + paid, _AFTER_INSERT[now] if letter == "I" else to
            if letter != "I":
                break
        moves.append((letters, now, cost))
    least = min(best)
    return tuple(b - least for b in best), tuple(moves)


def backward(codes: bytes, behind: tuple[int, ...], keep: bool = False) -> tuple[tuple[int, ...], list[Moves]]:
    """The cost vector before a chunk, less its least, and the moves of each turn if they are to be kept."""
    kept: list[Moves] = []
    for code in reversed(codes):
        behind, moves = step(code, behind)
        if keep:
            kept.append(moves)
    return behind, kept[::-1]


def lay_out(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk of a conversation: its id, the chunk's number (ascending along it), facts on its turns, their roles and texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    stripped = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    blank, cut = F.length(stripped) == 0, ~F.right(stripped, F.lit(1)).isin(".", "!", "?")
    rows = rows.withColumns({"flaw": F.when(blank, 2).when(cut, 1).otherwise(0), "d1": F.xxhash64("role", "text"), "d2": F.xxhash64(F.lit("second"), "role", "text"), "tie": F.monotonically_increasing_id()})
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2"), F.col("tie")]
    laid = rows.repartitionByRange(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("tie")
    kind = rows.schema["conv"].dataType.simpleString()
    lists = ["turn", "role", "text", "flaw", "d1", "d2"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        rest: list[pa.RecordBatch] = []

        def closed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal number
            t = pa.Table.from_batches(parts)
            number += 1
            one = pa.array([0, t.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays([t.column("conv")[:1].combine_chunks(), pa.array([number])] + [pa.ListArray.from_arrays(one, t.column(c).combine_chunks()) for c in lists], names=["conv", "chunk", *lists])

        held = rows_held = 0
        for batch in batches:
            conv = batch.column("conv").to_pylist()
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            last = rest[-1].column("conv")[-1].as_py() if rest else None
            start = 0
            for i, c in enumerate(conv):
                if (rest or i > start) and (c != last or rows_held >= chunk or held >= CHUNK_BYTES):
                    if i > start:
                        rest.append(batch.slice(start, i - start))
                    yield closed(rest)
                    rest, start, held, rows_held = [], i, 0, 0
                last, held, rows_held = c, held + sizes[i], rows_held + 1
            if start < len(conv):
                rest.append(batch.slice(start))
        if rest:
            yield closed(rest)

    return laid.mapInArrow(chunks, f"conv {kind}, chunk long, turn array<long>, role array<string>, text array<string>, flaw array<int>, d1 array<long>, d2 array<long>")


def _codes(row: dict, known: set[tuple[int, int]]) -> tuple[bytes, list[int]]:
    """Codes of a chunk's turns, and how many are blank, repeated and truncated; ``known`` has what earlier chunks hold."""
    faults, out = [0, 0, 0], bytearray()
    for role, flaw, key in zip(row["role"], row["flaw"], zip(row["d1"], row["d2"])):
        again = flaw != 2 and key in known
        known.add(key)
        if flaw == 2 or again or flaw:
            faults[0 if flaw == 2 else 1 if again else 2] += 1
        out.append(code_of(role[:1], flaw == 2 or again, flaw == 1))
    return bytes(out), faults


def _pairs(row: dict) -> set[tuple[int, int]]:
    return set(zip(row.get("known1") or (), row.get("known2") or ()))


def stitched(chunks: DataFrame, convs: DataFrame) -> DataFrame:
    """``(chunk, behind, state, known1, known2)`` for chunks of the conversations ``convs(conv)``, which have several: the
    costs behind each chunk, the state before it, and the turns of earlier chunks that it repeats."""
    spark = chunks.sparkSession
    long = chunks.select("conv", "chunk", "role", "flaw", "d1", "d2").join(convs, F.col("conv").eqNullSafe(F.col("long_conv")), "left_semi")
    held = long.select("conv", "chunk", F.explode(F.arrays_zip("d1", "d2")).alias("d")).select("conv", "chunk", "d.*").groupBy("conv", "d1", "d2", "chunk").agg(F.lit(1).alias("one"))
    first = held.groupBy(F.col("conv").alias("c"), F.col("d1").alias("e1"), F.col("d2").alias("e2")).agg(F.min("chunk").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = held.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))).where("chunk > first")
    known = again.groupBy("chunk").agg(F.collect_list(F.struct("d1", "d2")).alias("k")).select("chunk", F.col("k.d1").alias("known1"), F.col("k.d2").alias("known2"))  # as long as a chunk at most
    known = written(known, "repeated-turns")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array([_codes(r, _pairs(r))[0] for r in rows], pa.binary())], names=["conv", "chunk", "codes"])

    kind = chunks.schema["conv"].dataType.simpleString()
    coded = written(long.join(known, "chunk", "left").mapInArrow(code, f"conv {kind}, chunk long, codes binary"), "turn-codes")
    along = Window.partitionBy("conv").orderBy("chunk")
    order = written(coded.select("conv", "chunk", F.lead("chunk").over(along).alias("next")), "chunk-order")
    end = F.array(*[F.lit(e) for e in END])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = [list(backward(c, tuple(v))[0]) for c, v in zip(batch.column("codes").to_pylist(), batch.column("behind").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("behind"), pa.array(before, pa.list_(pa.int32()))], names=["chunk", "behind", "before"])

    schema = "chunk long, behind array<int>, before array<int>"
    now = written(coded.select("chunk", "codes", end.alias("behind")).mapInArrow(run, schema), "cost-vectors")  # a guess, but for last chunks
    while True:
        given = order.join(now.select(F.col("chunk").alias("next"), F.col("before").alias("given")), "next").select("chunk", "given")
        stale = written(now.join(given, "chunk").where("behind != given").select("chunk", F.col("given").alias("behind")), "stale-chunks")
        if not stale.take(1):
            break
        fixed = coded.join(stale, "chunk").select("chunk", "codes", "behind").mapInArrow(run, schema)
        now = written(now.join(stale, "chunk", "left_anti").unionByName(fixed), "cost-vectors")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), START
        for batch in batches:
            states = []
            for conv, to in zip(batch.column("conv").to_pylist(), batch.column("to").to_pylist()):
                state = START if conv != last else state
                states.append(state)
                last, state = conv, to[state]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(states, pa.int32())], names=["chunk", "state"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, behind in zip(batch.column("codes").to_pylist(), batch.column("behind").to_pylist()):
                to = list(range(4))
                for moves in backward(codes, tuple(behind), True)[1]:
                    to = [moves[q][1] for q in to]
                out.append(to)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(out, pa.list_(pa.int32()))], names=["conv", "chunk", "to"])

    mapped = coded.join(now.select("chunk", "behind"), "chunk").select("conv", "chunk", "codes", "behind").mapInArrow(maps, f"conv {kind}, chunk long, to array<int>")
    states = mapped.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(chain, "chunk long, state int")
    ends = order.where("next is null").select("chunk", F.lit(True).alias("is_last"))
    return now.select("chunk", "behind").join(states, "chunk").join(known, "chunk", "left").join(ends, "chunk", "left")


REPAIRED = "chunk long, long boolean, first_turn long, last_turn long, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, cost long, audit string, roles array<string>, texts array<string>, actions array<string>"


def repaired_chunks(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """For each chunk: its conversation, faults, costs, the part of the audit, and the repaired roles and texts (see ``REPAIRED``)."""
    chunks = written(lay_out(turns, conv_col, turn_col, role_col, text_col, chunk), "conversation-chunks")
    several = written(chunks.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("long_conv")), "long-conversations")
    if several.take(1):
        info = written(stitched(chunks, several), "stitched-chunks")
        chunks = chunks.join(info, "chunk", "left")
    else:
        none = {"behind": "array<int>", "state": "int", "known1": "array<long>", "known2": "array<long>", "is_last": "boolean"}
        chunks = chunks.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    names = ["conv", *(x.split()[0] for x in REPAIRED.split(", "))]

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            begin = texts.offsets.to_pylist() if isinstance(texts, pa.ListArray) else []
            picked: list[int | None] = []  # the text of each repaired turn, none of an inserted one
            made, ends = [], [0]
            for row, first in zip(batch.drop_columns(["text"]).to_pylist(), begin):
                made.append(traced(row, first, picked))
                ends.append(len(picked))
            if made:
                told = texts.values.take(pa.array(picked, pa.int64())).fill_null("")
                columns = {"texts": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)}
                yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.array([m[f.name] for m in made], f.type) for f in out], schema=out)

    def traced(row: dict, first: int, picked: list[int | None]) -> dict:
        codes, faults = _codes(row, _pairs(row))
        single = row["behind"] is None
        _, moves = backward(codes, END if single else tuple(row["behind"]), True)
        q, cost, audit = START if single else row["state"], 0, []
        roles, actions = [], []
        for at, (may, role) in enumerate(zip(moves, row["role"]), first):
            letters, to, paid = may[q]
            cost += paid
            audit.append(letters)
            for letter in letters:
                if letter != "D":
                    roles.append(role if letter == "K" else "assistant" if q == USER else "user")
                    picked.append(None if letter == "I" else at)
                    actions.append(letter)
                q = _AFTER_INSERT[q] if letter == "I" else to
        if single or row["is_last"]:
            while q not in (START, ASSISTANT):
                roles.append("assistant" if q == USER else "user")
                picked.append(None)
                actions.append("I")
                audit.append("I")
                q, cost = _AFTER_INSERT[q], cost + INSERT
        turns = [t for t in row["turn"] if t is not None]
        distinct = sum(a != b for a, b in zip(turns[1:], turns)) + bool(turns)
        initials = [r[:1] for r in row["role"]]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        facts = [row["chunk"], not single, turns[0] if turns else None, turns[-1] if turns else None, min(turns, default=None), max(turns, default=None), distinct, *faults, illegal, initials[0], initials[-1], cost, "".join(audit), roles, None, actions]
        return dict(zip(names, [row["conv"], *facts]))

    kind = chunks.schema["conv"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    array = lambda t: pa.list_(t)
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": array(pa.string())}
    out = pa.schema([("conv", to_arrow_type(kind)), *((x.split()[0], types[x.split()[1]]) for x in REPAIRED.split(", "))])
    return chunks.drop("d", "n").mapInArrow(trace, f"conv {kind.simpleString()}, {REPAIRED}")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``(conv_id, chunk, at, action, role, text)``: the repaired turns; (chunk, at) orders them; actions are Keep, Rerole, Insert.

    Role sequences become ``(s?(ua)+)?`` by initials with the cheapest edits: Rerole 1, Delete 2 (blank and repeated turns must go),
    Insert 5, and 5 for a truncated turn that stays; ties take the least audit.  Null roles and texts are one
    space, null turns come first, turns of one number are ordered by a digest.  Repeated rows are duplicates.  A null id is a
    conversation like others.  Long texts move once.  An empty table gives no rows; other columns are not read.
    """
    done = repaired_chunks(turns, conv_col, turn_col, role_col, text_col, chunk)
    rows = done.select(F.col("conv").alias("conv_id"), "chunk", F.posexplode(F.arrays_zip("actions", "roles", "texts")).alias("at", "turn"))
    return rows.select("conv_id", "chunk", "at", F.col("turn.actions").alias("action"), F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of each conversation that has turns.

    ``repair`` says what nulls, ties and repeated rows give.  SHA-256 takes a conversation's repaired ``role:text`` lines in order:
    those of one with several chunks pass through one task as they come, chunk by chunk, and are not held there.
    """
    done = repaired_chunks(turns, conv_col, turn_col, role_col, text_col, chunk)
    order = F.col("conv").asc_nulls_first()
    done = written(done, "repaired-chunks")
    single = done.where("not long")
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"])), "\n")
    gaps = lambda low, high, distinct: F.coalesce(high - low + 1 - distinct, F.lit(0)).cast("long")
    out = [F.col("conv").alias("conv_id"), gaps(F.col("low"), F.col("high"), F.col("distinct")).alias("gaps"), *COUNTS[1:], "audit", F.sha2(lines, 256).alias("repaired_sha256")]
    kind = done.schema["conv"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def ended(column: pa.DataType) -> pa.RecordBatch:
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["distinct"]
            values = [now["conv"], gaps, *(now[c] for c in COUNTS[1:]), "".join(now["audit"]), now["sha"].hexdigest()]
            types = [column, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            column = batch.schema.field("conv").type
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if now is None or now["conv"] != row["conv"]:
                    if now is not None:
                        yield ended(column)
                    now = row | {"audit": [], "sha": hashlib.sha256(), "any": False}
                else:
                    now["illegal"] += row["illegal"] + (now["last_role"] + row["first_role"] not in LEGAL)
                    now["distinct"] += row["distinct"] - (row["first_turn"] is not None and now["last_turn"] == row["first_turn"])
                    now["low"] = row["low"] if now["low"] is None else now["low"]
                    now["high"] = now["high"] if row["high"] is None else row["high"]
                    now["last_role"] = row["last_role"]
                    now["last_turn"] = now["last_turn"] if row["last_turn"] is None else row["last_turn"]
                    for c in ("blank", "duplicate", "truncated", "cost"):
                        now[c] += row[c]
                now["audit"].append(row["audit"])
                for role, text in zip(row["roles"], row["texts"]):
                    now["sha"].update((("\n" if now["any"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    now["any"] = True
        if now is not None:
            yield ended(column)

    long = done.where("long").drop("long", "actions").repartition("conv").sortWithinPartitions(order, "chunk").mapInArrow(join, schema)
    return single.select(*out).unionByName(long)


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``: turns with a fault in every fourth or so, by the CRC-32 of ``conv_id:turn``; nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text: Column = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(fault == 4, "user").otherwise(word("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1)))
    return conversations.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
