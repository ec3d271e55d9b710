"""Repair of the turn structure of conversations at least cost.

Every row is kept (0), given the role user or assistant (1) or deleted (2; blank rows and repeats must go), and
turns without text may be put in anywhere (5); a truncated row that stays costs 5 more. What is left must read
`(s?(ua)+)?` by role initials. Of the cheapest edits the ASCII-least string of initials (D, I, K, R) holds.

Rows are laid in one global order and cut into blocks of equally many rows; conversations inside a block are
bucketed by length and solved together, time-major: one numpy step a turn updates the costs of four states for
all of them, backwards, and a second sweep traces the edits. A conversation that crosses a block's end is a chain of
fragments, each summed up as a 4 x 4 min-plus matrix, so that no task sees more of a long one than a block and
its matrices (16 numbers a block).

Defined cases: a null role or text is one space; rows order by turn (nulls first), then role, then text, and
rows equal in all of these stand in one partition; a null conv_id is a conversation; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._spark import durable, read, release, settled

#: States after what has been put out: nothing, a leading system turn, a user turn, an assistant turn.
START, LED, ASKED, ANSWERED = range(4)
NEXT = np.array([ASKED, ASKED, ANSWERED, ASKED])
#: State after a kept row by (state, class of role: s, u, a, other); -1 where it may not stand.
KEPT = np.array([[LED, ASKED, -1, -1], [-1, ASKED, -1, -1], [-1, -1, ANSWERED, -1], [-1, ASKED, -1, -1]])
FAULTS = ["", "blank", "duplicate", "truncated"]
INSERT, DELETE, CUT, FAR, PAD = 5, 2, 5, 1 << 40, 16
FINISH = np.array([0, 2 * INSERT, INSERT, 0], np.int64)  # cost of ending in each state
LEGAL = {(0, 1), (1, 2), (2, 1)}
BATCH = 1 << 16
SPACE = " \t\n\x0b\x0c\r"


def _steps() -> np.ndarray:
    """[code, state, state]: cost of one row with the turns put in before it. A code is class + 4 * fault; PAD is no row."""
    step = np.full((PAD + 1, 4, 4), FAR, np.int64)
    step[PAD, range(4), range(4)] = 0
    for code in range(PAD):
        role, fault = code % 4, code // 4
        for s in range(4):
            step[code, s, s] = DELETE
            if fault in (0, 3):
                extra = CUT if fault == 3 else 0
                step[code, s, NEXT[s]] = min(step[code, s, NEXT[s]], 1 + extra)
                if KEPT[s, role] >= 0:
                    step[code, s, KEPT[s, role]] = min(step[code, s, KEPT[s, role]], extra)
    led = step.copy()
    led[:PAD] = np.minimum(np.minimum(step[:PAD], INSERT + step[:PAD][:, NEXT]), 2 * INSERT + step[:PAD][:, NEXT[NEXT]])
    return led


STEPS = _steps()
_rows = np.arange(PAD + 1)
_EXTRA = np.where(_rows // 4 == 3, CUT, 0)
_STAYS = (_rows // 4 == 0) | (_rows // 4 == 3)


def backward(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[turn, conversation, state] of cheapest costs to the end; codes is [turn, conversation], ends [conversation, state]."""
    costs = np.empty((len(codes) + 1, *ends.shape), np.int64)
    costs[-1] = ends
    for t in range(len(codes) - 1, -1, -1):
        costs[t] = (STEPS[codes[t]] + costs[t + 1][:, None, :]).min(2)
    return costs


def matrices(codes: np.ndarray) -> np.ndarray:
    """[conversation, state, state]: cheapest cost from a state before the first row to a state after the last."""
    found = np.broadcast_to(STEPS[PAD], (codes.shape[1], 4, 4)).copy()
    for t in range(len(codes) - 1, -1, -1):
        found = (STEPS[codes[t]][:, :, :, None] + found[:, None, :, :]).min(2)
    return np.minimum(found, FAR)


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """([turn, conversation] of edits, state at the end). An edit is 12 * turns put in before + 3 * state before + (0 D, 1 K, 2 R)."""
    n, state = np.arange(codes.shape[1]), state.copy()
    edits = np.zeros(codes.shape, np.int8)
    for t, code in enumerate(codes):
        now, after, before, added = costs[t], costs[t + 1], state.copy(), np.zeros(len(n), np.int8)
        letter = np.zeros(len(n), np.int8)
        open_ = code != PAD
        for _ in range(3):
            best = now[n, state]
            drop = open_ & (DELETE + after[n, state] == best)
            put = open_ & ~drop & (INSERT + now[n, NEXT[state]] == best)
            rest = open_ & ~drop & ~put
            kept = KEPT[state, code % 4]
            keep = rest & _STAYS[code] & (kept >= 0) & (_EXTRA[code] + after[n, kept] == best)
            name = rest & ~keep
            letter[keep], letter[name] = 1, 2
            added[put] += 1
            state = np.where(keep, kept, np.where(put | name, NEXT[state], state))
            open_ = put
            if not open_.any():
                break
        edits[t] = 12 * added + 3 * before + letter
    return edits, state


def time_major(code: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, [turn, conversation] codes) by buckets of at most twofold lengths; runs are code[first:first + size]."""
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for b in np.unique(bucket):
        which = np.flatnonzero(bucket == b)
        at = first[which] + np.arange(size[which].max())[:, None]
        yield which, np.where(np.arange(len(at))[:, None] < size[which], code[np.minimum(at, len(code) - 1)], PAD)


def solve(code: np.ndarray, first: np.ndarray, size: np.ndarray, ends: np.ndarray, start: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The edits of each run and its state at the end, from its start state and its costs at the end."""
    edits, last = [np.zeros(0, np.int8)] * len(first), np.zeros(len(first), np.int64)
    for which, codes in time_major(code, first, size):
        found, last[which] = trace(codes, backward(codes, ends[which]), start[which])
        for i, w in enumerate(which):
            edits[w] = found[: size[w], i]
    return edits, last


def _runs(bits: int, conv: pa.DataType):
    """Solves what lies inside a block, and sums up what crosses its ends."""
    schema = pa.schema([("conv_id", conv), ("first_row", pa.int64()), ("edits", pa.list_(pa.int8())), ("tail", pa.int32()), ("illegal", pa.int64()), ("codes", pa.list_(pa.int8())), ("matrix", pa.list_(pa.int64()))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < BATCH:
                continue
            whole = pa.Table.from_batches(held)
            block = whole.column("row").to_numpy() >> bits
            cut = int(np.searchsorted(block, block[-1]))
            if cut:
                yield whole.slice(0, cut)
                held, n = whole.slice(cut).to_batches(), whole.num_rows - cut
        if n:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            row, code = t.column("row").to_numpy(), t.column("code").to_numpy().astype(np.int64)
            ids = t.column("conv_id").combine_chunks()
            who = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new = np.ones(len(row), bool)
            edge = np.ones(len(row), bool)
            edge[1:] = row[1:] >> bits != row[:-1] >> bits
            new[1:] = (who[1:] != who[:-1]) | edge[1:]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(row)))
            leads = edge[first]
            crosses = leads | np.append(leads[1:], True)
            role = code % 4
            legal = np.zeros((4, 4), bool)
            legal[tuple(zip(*LEGAL, strict=True))] = True
            bad = np.zeros(len(row) + 1, np.int64)
            bad[2:] = np.cumsum(~legal[role[:-1], role[1:]] & ~new[1:])
            illegal = bad[first + size] - bad[first + 1]
            inner, outer = np.flatnonzero(~crosses), np.flatnonzero(crosses)
            edits, last = solve(code, first[inner], size[inner], np.broadcast_to(FINISH, (len(inner), 4)), np.zeros(len(inner), np.int64))
            sums = np.zeros((len(outer), 16), np.int64)
            for which, codes in time_major(code, first[outer], size[outer]):
                sums[which] = matrices(codes).reshape(-1, 16)
            none = lambda n: [None] * n
            order = np.concatenate([inner, outer])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(first[order])),
                    pa.array(row[first[order]]),
                    pa.array(edits + none(len(outer)), schema.field("edits").type),
                    pa.array([*(FINISH[last] // INSERT), *none(len(outer))], pa.int32()),
                    pa.array(illegal[order]),
                    pa.array(none(len(inner)) + [code[first[i] : first[i] + size[i]] for i in outer], schema.field("codes").type),
                    pa.array(none(len(inner)) + list(sums), schema.field("matrix").type),
                ],
                schema=schema,
            )

    return run


def _ends(part: pd.DataFrame) -> pd.DataFrame:
    """Costs at the end of each fragment of a conversation, and whether it joins the next one by an illegal pair."""
    part = part.sort_values("first_row", ignore_index=True)
    cost, ends = FINISH, []
    for m in reversed(part["matrix"].tolist()):
        ends.append(cost)
        cost = (np.asarray(m).reshape(4, 4) + cost).min(1)
    pairs = zip(part["last_class"].tolist(), part["first_class"].tolist()[1:], strict=False)
    part = part.assign(ends=ends[::-1], crossing=[*(int(p not in LEGAL) for p in pairs), 0])
    return part[["first_row", "ends", "crossing"]]


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits and the last state of each fragment for each state it may start from."""
    for batch in batches:
        t = batch.to_pydict()
        size = np.repeat([len(c) for c in t["codes"]], 4)
        code = np.concatenate([np.asarray(c, np.int64) for c in t["codes"]]) if t["codes"] else np.zeros(0, np.int64)
        first = np.repeat(np.cumsum([0, *(len(c) for c in t["codes"])])[:-1], 4)
        edits, last = solve(code, first, size, np.repeat(np.array(t["ends"], np.int64).reshape(-1, 4), 4, 0), np.tile(np.arange(4), len(t["codes"])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("first_row"), pa.array([[x.tolist() for x in edits[i : i + 4]] for i in range(0, len(edits), 4)], pa.list_(pa.list_(pa.int8()))), pa.array(last.reshape(-1, 4).tolist(), pa.list_(pa.int64()))],
            names=["conv_id", "first_row", "by_start", "exits"],
        )


def _starts(part: pd.DataFrame) -> pd.DataFrame:
    """The state each fragment starts from, and after the last one the turns to put in."""
    part = part.sort_values("first_row", ignore_index=True)
    state, starts = START, []
    for exits in part["exits"].tolist():
        starts.append(state)
        state = int(exits[state])
    return pd.DataFrame({"first_row": part["first_row"], "start": starts, "tail": [0] * (len(part) - 1) + [int(FINISH[state] // INSERT)]})


def lay_out(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, row, code): all rows in one order, stored. Long texts are compared whole but only their
    beginnings bound the ranges, so bounds stay small."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    t = t.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    known = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.lit("\n"), F.length("role"), F.lit("\n"), "role", "text")
    t = durable(t.withColumn("row", F.monotonically_increasing_id()).withColumn("same", F.unhex(F.md5(known.cast("binary")))), "laid-out")
    again = t.groupBy("same").agg(F.min("row").alias("seen"), F.count("*").alias("n")).filter("n > 1").select(F.col("same").alias("key"), "seen")
    body = F.btrim("text", F.lit(SPACE))
    kind = F.substring("role", 1, 1)
    klass = F.when(kind == "s", 0).when(kind == "u", 1).when(kind == "a", 2).otherwise(3)
    cut = ~F.substring(body, -1, 1).isin(".", "!", "?")
    fault = F.when(body == "", 1).when(F.col("row") > F.col("seen"), 2).when(cut, 3).otherwise(0)
    out = t.join(again, F.col("same") == F.col("key"), "left").select("conv_id", "turn", "role", "text", "row", (klass + 4 * fault).cast("tinyint").alias("code"))
    out._stored = t._stored
    return out


def _fields(names: str) -> list[T.StructField]:
    return T.StructType.fromDDL(names).fields


def plan_edits(laid: DataFrame, block_bits: int = 12) -> DataFrame:
    """(conv_id, first_row, edits, tail, illegal), stored: the edits of each run of rows from first_row on."""
    ids = laid.select("conv_id").schema.fields
    schema = T.StructType(ids + _fields("first_row long, edits array<tinyint>, tail int, illegal long, codes array<tinyint>, matrix array<long>"))
    kind = to_arrow_schema(T.StructType(ids)).field(0).type
    light = laid.select("conv_id", "row", "code").repartition(F.shiftright("row", block_bits)).sortWithinPartitions("row")
    runs = durable(light.mapInArrow(_runs(block_bits, kind), schema), "runs")
    parts = runs.filter("codes IS NOT NULL")
    cuts = parts.select("conv_id", "first_row", "matrix", (F.element_at("codes", 1) % 4).cast("int").alias("first_class"), (F.element_at("codes", -1) % 4).cast("int").alias("last_class"))
    ends = durable(cuts.groupBy("conv_id").applyInPandas(_ends, "first_row long, ends array<long>, crossing long"), "ends")
    known = parts.select("conv_id", "first_row", "codes").join(ends, "first_row").select("conv_id", "first_row", "codes", "ends")
    solved = durable(known.mapInArrow(_fragments, T.StructType(ids + _fields("first_row long, by_start array<array<tinyint>>, exits array<long>"))), "fragments")
    starts = solved.select("conv_id", "first_row", "exits").groupBy("conv_id").applyInPandas(_starts, "first_row long, start int, tail int")
    chosen = solved.join(starts, "first_row").select("first_row", F.element_at("by_start", F.col("start") + 1).alias("edits"), "tail")
    joined = parts.select("conv_id", "first_row", "illegal").join(chosen, "first_row").join(ends.select("first_row", "crossing"), "first_row")
    out = runs.filter("codes IS NULL").select("conv_id", "first_row", "edits", "tail", "illegal").unionByName(joined.select("conv_id", "first_row", "edits", "tail", (F.col("illegal") + F.col("crossing")).alias("illegal")))
    out = durable(out, "edits")
    release(runs, ends, solved)
    return out


def _by_edit(values: list[Column]) -> Column:
    return F.element_at(F.array(*values), F.col("edit_code") + 1)


def apply_edits(laid: DataFrame, runs: DataFrame) -> DataFrame:
    """(conv_id, row, step, edit, role, text, cost): the edits in order, and the turn that each leaves (none for D)."""
    names = [F.lit("user"), F.lit("assistant")]
    puts, roles = [], []
    for code in range(36):
        state, added = code // 3 % 4, []
        for _ in range(code // 12):
            added.append(names[int(state == ASKED)])
            state = NEXT[state]
        puts.append(F.array(*added) if added else F.array().cast("array<string>"))
        roles.append(names[int(state == ASKED)] if code % 3 == 2 else F.lit(None).cast("string"))
    each = runs.select("first_row", F.posexplode("edits").alias("i", "edit_code")).select((F.col("first_row") + F.col("i")).alias("at"), "edit_code")
    each = each.select("at", _by_edit(puts).alias("put"), _by_edit(roles).alias("renamed"), (F.col("edit_code") % 3).alias("letter"))
    rows = laid.join(each, F.col("row") == F.col("at"))
    cut = F.floor(F.col("code") / 4) == 3
    empty = F.lit("")
    own = F.struct(
        F.lit(2).alias("step"),
        F.element_at(F.array(F.lit("D"), F.lit("K"), F.lit("R")), F.col("letter") + 1).alias("edit"),
        F.when(F.col("letter") > 0, F.coalesce("renamed", "role")).alias("role"),
        F.when(F.col("letter") > 0, F.col("text")).alias("text"),
        (F.when(F.col("letter") == 0, DELETE).otherwise(F.col("letter") - 1 + F.when(cut, CUT).otherwise(0))).cast("long").alias("cost"),
    )
    put = lambda steps: F.transform(steps[0], lambda r, i: F.struct((i + steps[1]).alias("step"), F.lit("I").alias("edit"), r.alias("role"), empty.alias("text"), F.lit(INSERT).cast("long").alias("cost")))
    out = rows.select("conv_id", "row", F.inline(F.concat(put((F.col("put"), 0)), F.array(own))))
    last = F.when(F.col("tail") == 2, F.array(*names)).otherwise(F.array(names[1]))
    ends = runs.filter("tail > 0").select("conv_id", (F.col("first_row") + F.size("edits") - 1).alias("row"), F.inline(put((last, 3))))
    return out.unionByName(ends)


def repair(turns: DataFrame, block_bits: int = 12) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows as laid out with their faults, edits in order with the turns they leave, illegal pairs a run of rows)."""
    laid = lay_out(turns)
    runs = plan_edits(laid, block_bits)
    return laid, apply_edits(laid, runs), runs.select("conv_id", "illegal")


def damage(turns: DataFrame) -> DataFrame:
    """The faults of the contract, by crc32 of `conv_id:turn`."""
    gap = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), gap), F.lit(":"), F.coalesce(F.col("turn").cast("string"), gap))
    t = turns.select("conv_id", "turn", F.coalesce("role", gap).alias("role"), F.coalesce("text", gap).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("k")).filter("k <> 0")
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def summary(turns: DataFrame, damaged: DataFrame, block_bits: int = 12) -> DataFrame:
    """The digest columns of the contract. One conversation is hashed as a whole, so only here its turns meet in one row."""
    laid, edits, runs = repair(damaged, block_bits)
    fault = F.floor(F.col("code") / 4)
    by_turn = laid.groupBy("conv_id", "turn").agg(*[F.count_if(fault == i).alias(FAULTS[i]) for i in (1, 2, 3)])
    sums = [F.sum(c).alias(c) for c in FAULTS[1:]]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    stats = by_turn.groupBy("conv_id").agg(*sums, gaps.alias("gaps"))
    line = F.when(F.col("edit") != "D", F.concat("role", F.lit(":"), "text"))
    ordered = F.array_sort(F.collect_list(F.struct("row", "step", "edit", line.alias("line"))))
    text = F.array_join(F.filter(F.transform("all", lambda x: x["line"]), lambda x: x.isNotNull()), "\n")
    done = edits.groupBy("conv_id").agg(ordered.alias("all"), F.sum("cost").alias("cost")).select("conv_id", "cost", F.array_join(F.transform("all", lambda x: x["edit"]), "").alias("audit"), F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
    parts = turns.select("conv_id").distinct()
    for p in (stats, done, runs.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"))):
        parts = parts.unionByName(p, allowMissingColumns=True)
    nil = F.sha2(F.lit("").cast("binary"), 256)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return parts.groupBy("conv_id").agg(*[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), nil).alias("repaired_sha256"))


@settled
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return summary(turns, damage(turns))


#: crc32 of an ASCII text, bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), ch -> ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)".replace("ch ->", "lambda ch:")

OP11_SQL = (
    r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         CRC % 20 AS k
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE k WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM t WHERE k <> 0
), n AS (
  SELECT *, row_number() OVER w AS pos, left(role, 1) AS init, lag(left(role, 1)) OVER w AS prev,
         trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), f AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
                 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM n
), nxt(s, z, r) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')
), kp(s, i, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ins(s, z, c, a, o) AS (
  SELECT s, s, 0, '', []::VARCHAR[] FROM nxt
  UNION ALL SELECT s, z, 5, 'I', [r || ':'] FROM nxt
  UNION ALL SELECT x.s, y.z, 10, 'II', [x.r || ':', y.r || ':'] FROM nxt x JOIN nxt y ON x.z = y.s
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM f
  UNION ALL
  SELECT conv_id, pos, s, cost, audit, lines FROM (
    SELECT f.conv_id, f.pos, e.z AS s, w.cost + ins.c + e.c AS cost, w.audit || ins.a || e.a AS audit, list_concat(list_concat(w.lines, ins.o), e.o) AS lines
    FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN ins ON ins.s = w.s,
    LATERAL (
      SELECT ins.z AS z, 2 AS c, 'D' AS a, []::VARCHAR[] AS o
      UNION ALL SELECT kp.z, CASE WHEN f.fault = 3 THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text] FROM kp WHERE kp.s = ins.z AND kp.i = f.init AND f.fault IN (0, 3)
      UNION ALL SELECT nxt.z, CASE WHEN f.fault = 3 THEN 6 ELSE 1 END, 'R', [nxt.r || ':' || f.text] FROM nxt WHERE nxt.s = ins.z AND f.fault IN (0, 3)
    ) e
    QUALIFY row_number() OVER (PARTITION BY f.conv_id, e.z ORDER BY w.cost + ins.c + e.c, w.audit || ins.a || e.a) = 1
  )
), best AS (
  SELECT w.conv_id, w.cost + ins.c AS cost, w.audit || ins.a AS audit, array_to_string(list_concat(w.lines, ins.o), chr(10)) AS out
  FROM walk w JOIN (SELECT conv_id, max(pos) AS pos FROM f GROUP BY 1) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.pos = w.pos JOIN ins ON ins.s = w.s AND ins.z IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + ins.c, w.audit || ins.a) = 1
), st AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
         count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
         count(*) FILTER (WHERE pos > 1 AND prev || init NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(out, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""
).replace("CRC", CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))
