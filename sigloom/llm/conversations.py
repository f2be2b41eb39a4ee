"""Conversation structure repair: cheapest edits to alternating turns, by branch and bound over blocks of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.llm.staging import shuffle_files_dropped, small_batches, stage

BLOCK = 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
OK, GONE, CUT = 0, 1, 2
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. The end of a conversation is one more.
START, SYSTEM, USER, ASSISTANT, END = range(5)
_KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_TRAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_LEGAL = ("su", "ua", "au")
_ROLES = {USER: "user", ASSISTANT: "assistant"}

_BLOCKS = "c string, part int, block long, rows array<long>, initials array<string>, illegal long, ways array<struct<entry: int, exit: int, cost: long, audit: string>>"


def suffix_bounds(turns: list[tuple[str, int]]) -> tuple[list[int], list[bool]]:
    """For the turns from each on the least that their edits cost, and whether one of them is a system turn, which is free after nothing.

    A faulty turn costs 2 or more, one of another role 1, and so does one of any two sound turns in a row (but for
    faulty ones between) of the same role; each turn is in one such pair at most.
    """
    low, system, waiting = [0] * (len(turns) + 1), [False] * (len(turns) + 1), ""
    for i in range(len(turns) - 1, -1, -1):
        role, fault = turns[i]
        low[i], system[i] = low[i + 1], system[i + 1] or role == "s" and fault != GONE
        if fault != OK:
            low[i] += DELETE
        elif role not in ("u", "a"):
            low[i] += REROLE
            waiting = ""
        elif role == waiting:
            low[i] += REROLE
            waiting = ""
        else:
            waiting = role
    return low, system


def cheapest(turns: list[tuple[str, int]], entry: int, goal: int) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state ``entry`` to state ``goal``, of equal ones the ASCII-least; None if there are none.

    ``turns``: (role's initial, fault). Depth first with a stack: a prefix is left if with the suffix bound it cannot beat the best
    found so far, or if its node (turns read, state) has been reached no worse. Two prefixes of a node and of one cost differ before either
    ends, so what follows cannot change their order. ``END`` allows insertions after the last turn, other goals don't.
    """
    low, system = suffix_bounds(turns)
    n, found = len(turns), None
    reached, stack = {(0, entry): (0, "")}, [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if reached[i, state] < (cost, audit):
            continue
        least = cost + low[i] - (state == START and system[i])
        if found and (least > found[0] or least == found[0] and audit > found[1][: len(audit)]):
            continue
        if i == n and (state == goal or goal == END and state in (START, ASSISTANT)):
            if not found or (cost, audit) < found:
                found = (cost, audit)
            continue
        moves = [(i, _NEXT[state], cost + INSERT, audit + "I")] if i < n or goal == END else []
        if i < n:
            role, fault = turns[i]
            moves.append((i + 1, state, cost + DELETE, audit + "D"))
            if fault != GONE:
                more = TRUNCATED if fault == CUT else 0
                if (state, role) in _KEEPS:
                    moves.append((i + 1, _KEEPS[state, role], cost + KEEP + more, audit + "K"))
                moves.append((i + 1, _NEXT[state], cost + REROLE + more, audit + "R"))
        for move in sorted(moves, key=lambda m: (m[2] + low[m[0]], m[3]), reverse=True):
            known = reached.get(move[:2])
            if known is None or move[2:] < known:
                reached[move[:2]] = move[2:]
                stack.append(move)
    return found


def _block(c: str, part: int, block: int, rows: list[tuple[int, str, int]], opens: bool, ends: bool) -> dict:
    turns = [(initial, fault) for _, initial, fault in rows]
    ways = []
    for entry in (START,) if opens else (START, SYSTEM, USER, ASSISTANT):
        for goal in (END,) if ends else (START, SYSTEM, USER, ASSISTANT):
            if found := cheapest(turns, entry, goal):
                ways.append({"entry": entry, "exit": goal, "cost": found[0], "audit": found[1]})
    illegal = sum(a + b not in _LEGAL for (a, _), (b, _) in zip(turns, turns[1:], strict=False))
    return {"c": c, "part": part, "block": block, "rows": [r[0] for r in rows], "initials": [t[0] for t in turns], "illegal": illegal, "ways": sorted(ways, key=lambda w: (w["entry"], w["audit"]))}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_WAY = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_BLOCK_SCHEMA = pa.schema([("c", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("rows", pa.list_(pa.int64())), ("initials", pa.list_(pa.string())), ("illegal", pa.int64()), ("ways", pa.list_(_WAY))])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs on sorted (c, row, initial, fault): blocks of up to ``BLOCK`` turns with the cheapest edits for each way in and out.

    A conversation that begins or ends with the partition may go on in another, so its blocks there have all ways.
    """
    part, held, c, number, opens, first = TaskContext.get().partitionId(), [], None, 0, False, True
    for batch in batches:
        out = []
        for name, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            new = name != c or first
            if held and (new or len(held) == BLOCK):
                out.append(_block(c, part, number, held, opens and number == 0, new))
                held, number = [], 0 if new else number + 1
            if new:
                c, number, opens, first = name, 0, not first, False
            held.append(tuple(row))
        if out:
            yield _batch(out, _BLOCK_SCHEMA)
    if held:
        yield _batch([_block(c, part, number, held, opens and number == 0, False)], _BLOCK_SCHEMA)


_ONWARD = pa.schema([("c", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("onward", pa.list_(pa.int32())), ("final", pa.bool_())])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs on (c, part, block, first, last, ways), last blocks first: for each state before a block the state after it on the cheapest way to the end."""
    c, after = None, {}
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            final = row["c"] != c
            if final:
                c, after = row["c"], {t: INSERT * len(x) for t, x in _TRAIL.items()} | {END: 0}
            best: dict[int, tuple[int, int, int]] = {}
            for rank, way in enumerate(row["ways"]):  # in the order of their audits
                if way["exit"] in after:
                    value = (way["cost"] + after[way["exit"]], rank, way["exit"])
                    best[way["entry"]] = min(best.get(way["entry"], value), value)
            after = {entry: value[0] for entry, value in best.items()}
            out.append({k: row[k] for k in ("c", "part", "block", "first", "last")} | {"onward": [best[e][2] if e in best else -1 for e in range(END)], "final": final})
        yield _batch(out, _ONWARD)


_CHOSEN = pa.schema([("c", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("trail", pa.string()), ("broken", pa.int64())])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs on what ``_backward`` gives, first blocks first: the chosen way through each block, what is inserted after the last, and whether the turns on both sides of its start are illegal."""
    c, state, last = None, START, ""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            new = row["c"] != c
            c, state = row["c"], START if new else state
            exit_ = row["onward"][state]
            out.append({"c": c, "part": row["part"], "block": row["block"], "entry": state, "exit": exit_, "trail": _TRAIL.get(exit_, "") if row["final"] else "", "broken": int(not new and last + row["first"] not in _LEGAL)})
            state, last = exit_, row["last"]
        yield _batch(out, _CHOSEN)


_EDITS = pa.schema([("c", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("seq", pa.int32()), ("row", pa.int64()), ("role", pa.string())])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs on (c, part, block, rows, initials, entry, audit): what each block's audit leaves; ``role`` is null where a turn keeps its own, ``row`` where one is inserted."""
    for batch in batches:
        out = []
        for block in batch.to_pylist():
            state, turns = block["entry"], zip(block["rows"], block["initials"], strict=True)
            for seq, edit in enumerate(block["audit"]):
                row, initial = (None, None) if edit == "I" else next(turns)
                if edit == "D":
                    continue
                state = _KEEPS[state, initial] if edit == "K" else _NEXT[state]
                out.append({"c": block["c"], "part": block["part"], "block": block["block"], "seq": seq, "row": row, "role": None if edit == "K" else _ROLES[state]})
        yield _batch(out, _EDITS)


def key(conv) -> Column:
    """A conversation's id as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) after faults by the CRC-32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.

    A null conversation, turn, role or text reads as one space; ``conv`` and ``turn`` themselves stay null.
    """
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(read(conv_col), F.lit(":"), read(turn_col)).cast("binary")) % 20
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), read(role_col).alias("role"), read(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    left = rows.filter("kind <> 0").select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return left.drop("copy")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (conv, turn, role, text): one row per conversation, and the repaired turns.

    The first: ``c`` (the conversation as a key that is never null, see ``key``), ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.
    The second: ``c``, ``part``, ``block``, ``seq`` (in this order), ``role``, ``text``.

    Turns come by ``turn`` (nulls first), then role, then the SHA-256 of role and text; null roles and texts read as one space. A turn's first fault counts: blank, duplicate
    (role and text seen earlier), truncated (its last visible character is none of ``.!?``). Edits and their costs are those of ``cheapest``; a role without
    an initial is never kept. Extra columns are not read; an empty table gives no rows.

    A conversation is searched in blocks of 64 turns, for every state before and after a block, and the blocks' costs are put together by
    streaming over them from last to first and back, so that one with a third of all rows is many tasks, and none holds it.
    """
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark), shuffle_files_dropped(spark):
        own = lambda c: F.coalesce(F.col(c), F.lit(" "))
        rows = turns.select(key("conv").alias("c"), F.col("turn").cast("long").alias("turn"), own("role").alias("role"), own("text").alias("text"))
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
        trimmed = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
        digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
        light = rows.select("c", "turn", "role", "row", digest.alias("digest"), trimmed.alias("visible"))
        light = stage(light.withColumns({"blank": F.col("visible") == "", "cut": ~F.col("visible").isin(".", "!", "?")}).drop("visible"), "light")
        firsts = light.groupBy("c", "digest").agg(F.min(F.struct("turn", "row")).alias("f")).select(F.col("f.row").alias("__row"))
        marked = light.join(firsts, F.col("row") == F.col("__row"), "left")
        fault = F.when(F.col("blank"), "blank").when(F.col("__row").isNull(), "duplicate").when(F.col("cut"), "truncated")
        marked = stage(marked.select("c", "turn", "role", "digest", "row", fault.alias("fault")), "marked")
        order = ["c", "turn", "role", "digest", "row"]
        kind = F.when(F.col("fault").isNull(), OK).when(F.col("fault") == "truncated", CUT).otherwise(GONE)
        sorted_ = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        blocks = stage(sorted_.select("c", "row", F.substring("role", 1, 1).alias("initial"), kind.alias("kind")).mapInArrow(_search, _BLOCKS), "blocks")
        along = blocks.select("c", "part", "block", F.get("initials", F.lit(0)).alias("first"), F.element_at("initials", -1).alias("last"), F.transform("ways", lambda w: w.dropFields("audit")).alias("ways"))
        back = along.repartition(parts, "c").sortWithinPartitions("c", F.desc("part"), F.desc("block"))
        onward = stage(back.mapInArrow(_backward, "c string, part int, block long, first string, last string, onward array<int>, final boolean"), "onward")
        forth = onward.repartition(parts, "c").sortWithinPartitions("c", "part", "block")
        chosen = stage(forth.mapInArrow(_forward, "c string, part int, block long, entry int, exit int, trail string, broken long"), "chosen")
        chosen = chosen.withColumnsRenamed({x: f"__{x}" for x in ("c", "part", "block")})
        met = blocks.join(chosen, (F.col("c") == F.col("__c")) & (F.col("part") == F.col("__part")) & (F.col("block") == F.col("__block")))
        way = F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["exit"] == F.col("exit")))[0]
        done = met.withColumn("way", way).withColumns({"audit": F.concat("way.audit", "trail"), "cost": F.col("way.cost") + INSERT * F.length("trail"), "illegal": F.col("illegal") + F.col("broken")})
        done = stage(done.select("c", "part", "block", "rows", "initials", "entry", "audit", "cost", "illegal"), "done")
        counts = marked.groupBy("c").agg(
            *[F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")], F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count_distinct("turn").alias("turns")
        )
        audits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "block", "audit"))), lambda s: s["audit"]), "")
        told = done.groupBy(F.col("c").alias("__c")).agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), audits.alias("audit"))
        gaps = F.coalesce(F.try_subtract(F.try_add(F.try_subtract("hi", "lo"), F.lit(1)), F.col("turns")), F.lit(0).cast("long"))
        summary = counts.join(told, F.col("c") == F.col("__c")).select("c", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
        summary = stage(summary, "repairs")
        edits = done.select("c", "part", "block", "rows", "initials", "entry", "audit").mapInArrow(_edits, "c string, part int, block long, seq int, row long, role string")
        edits = stage(edits.withColumnsRenamed({"c": "__c", "row": "__row", "role": "__role"}), "edits")
        kept = rows.join(edits.filter("__row IS NOT NULL"), F.col("row") == F.col("__row")).select("c", "part", "block", "seq", F.coalesce("__role", "role").alias("role"), "text")
        added = edits.filter("__row IS NULL").select(F.col("__c").alias("c"), "part", "block", "seq", F.col("__role").alias("role"), F.lit("").alias("text"))
    return summary, kept.unionByName(added)


_DIGESTS = pa.schema([("c", pa.string()), ("sha256", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs on sorted (c, role, text): the SHA-256 of each conversation's ``role:text`` lines, a line at a time."""
    c, state = None, None
    for batch in batches:
        out = []
        for name, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            line = f"{role}:{text}".encode()
            if name == c:
                state.update(b"\n" + line)
                continue
            if state:
                out.append({"c": c, "sha256": state.hexdigest()})
            c, state = name, hashlib.sha256(line)
        if out:
            yield _batch(out, _DIGESTS)
    if state:
        yield _batch([{"c": c, "sha256": state.hexdigest()}], _DIGESTS)


def digests(repaired: DataFrame) -> DataFrame:
    """(c, sha256) of repaired turns (see ``repair``), in order; a conversation streams through one task, as its hash has to, and none is held."""
    spark = repaired.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark):
        dealt = repaired.repartition(parts, "c").sortWithinPartitions("c", "part", "block", "seq")
        return stage(dealt.select("c", "role", "text").mapInArrow(_hashed, "c string, sha256 string"), "digests")
