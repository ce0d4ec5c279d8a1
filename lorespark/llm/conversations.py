"""Conversation structure repair by A* on the edit lattice.

The rows of a conversation, by turn, are brought to the role pattern ``(s?(ua)+)?`` (initials
of system, user, assistant) by the cheapest edits: Keep costs 0, Rerole to user or assistant 1,
Delete 2, Insert of an empty user or assistant row 5; blank rows and rows whose role and text
came before must be deleted, and a truncated row that stays is charged 5. A node of the lattice
is (rows used, state of the pattern). The search takes nodes by (cost + heuristic, audit), where
the audit is the edits' initials so far and the heuristic is the sum over the rows left of 2 for
each that must be deleted and of 2 for each truncated one, which pays 2 or 5. It never
overestimates, and no step lowers cost plus heuristic; so the first time a node is taken its
cost and then its audit are least, and the first goal is the answer. The pattern has one
user-or-assistant step out of each state, so an audit says which rows come out.

A conversation of at most ``LONG_ROWS`` rows and ``LONG_BYTES`` is searched whole in one row.
A longer one is never in one task: its rows are range-partitioned in order and cut into blocks;
each block is searched from every state to every state; the blocks' costs, sixteen numbers each,
are summed up from the end, which gives the cost to go behind every block; then each block is
searched for the least (cost, audit) from every state, whose ends are chained from the start.
Inserts between two blocks belong to the later one, so audits of blocks concatenate to the least
audit. Repeats in a long conversation are found by a grouped minimum over 128-bit digests
of role and text. Only the digest of a long conversation's repaired rows passes over them in
order, streamed block by block.

Defined cases: nulls in any column count as one space where they are text, and as an initial of
no role; null turns come first; rows of one turn are ordered by role and text; a null conv_id is
a conversation of its own; of equal rows all but the first are duplicates; texts of any length
are taken whole; a conversation without rows has zeros, an empty audit and no repaired row;
columns besides the four are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, enable_workers

LONG_ROWS, LONG_BYTES = 512, 4 << 20
SPACE = " \t\n\v\f\r"
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
# States: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a; what a row of each role leads to, and where the text may end.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
OWED = (0, 2, 1, 0)  # inserts that a state needs to end
NAMES = {"u": "user", "a": "assistant"}
FREE = "u", "u", "a", "u"  # the role that a rerole or an insert gives in a state
PARTS = "n_rows: long, blank: long, duplicate: long, truncated: long, illegal: long"
REPAIR = "cost: long, edits: string, repaired: array<struct<role: string, text: string>>"


def search(roles: str, faults: str, start: int, ends: dict[int, int]) -> tuple[int, str, int] | None:
    """(cost, audit, end) of the least (cost, audit) from a state through all rows; ends: cost to go of each state there.

    faults has a letter a row: d must be deleted, t is truncated, other rows are sound. Null where no end can be reached.
    """
    n = len(roles)
    ahead = [min(ends.values())] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (2 if faults[i] in "dt" else 0)
    heap = [(ahead[0], "", 0, start, 0)]
    taken = set()
    while heap:
        total, audit, at, state, cost = heapq.heappop(heap)
        if at > n:
            return total, audit, state
        if (at, state) in taken:
            continue
        taken.add((at, state))
        if at == n:
            if state in ends:
                heapq.heappush(heap, (cost + ends[state], audit, n + 1, state, cost))
            continue
        moves = [("D", 2, at + 1, state)]
        step, free = STEPS[state], FREE[state]
        if faults[at] != "d":
            charge = TRUNCATED if faults[at] == "t" else 0
            if roles[at] in step:
                moves.append(("K", charge, at + 1, step[roles[at]]))
            if roles[at] != free:
                moves.append(("R", 1 + charge, at + 1, step[free]))
        moves.append(("I", 5, at, step[free]))
        for edit, price, to, then in moves:
            if (to, then) not in taken:
                heapq.heappush(heap, (cost + price + ahead[to], audit + edit, to, then, cost + price))
    return None


def edited(roles: list[str], texts: list[str], faults: str, audit: str, state: int) -> tuple[int, list[tuple[str, str]], int]:
    """(cost, repaired rows, state behind them) of an audit from a state."""
    cost, out, at = 0, [], 0
    for edit in audit:
        cost += COST[edit]
        if edit == "D":
            at += 1
            continue
        letter = roles[at][:1] if edit == "K" else FREE[state]
        state = STEPS[state][letter]
        if edit == "I":
            out.append((NAMES[letter], ""))
            continue
        cost += TRUNCATED * (faults[at] == "t")
        out.append((roles[at] if edit == "K" else NAMES[letter], texts[at]))
        at += 1
    return cost, out, state


def fault_of(text: str, repeated: bool) -> str:
    """b blank, r repeated, t truncated, k sound: the first that fits."""
    body = text.rstrip(SPACE)
    return "b" if not body else "r" if repeated else "k" if body[-1] in ".!?" else "t"


def initials(roles: list[str]) -> str:
    """A letter a row; a role of no known initial is x."""
    return "".join(r[0] if r[:1] in ("s", "u", "a") else "x" for r in roles)


def illegal_pairs(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def counts(roles: list[str], faults: str) -> dict[str, int]:
    return {"n_rows": len(roles), "blank": faults.count("b"), "duplicate": faults.count("r"), "truncated": faults.count("t"), "illegal": illegal_pairs(roles)}


def _hard(faults: str) -> str:
    return faults.replace("b", "d").replace("r", "d")


def repair_rows(rows: list[tuple[str, str]]) -> dict:
    """Counts and repair of a whole conversation of (role, text)."""
    roles, texts = [r for r, _ in rows], [t for _, t in rows]
    seen, faults = set(), []
    for row in rows:
        faults.append(fault_of(row[1], row in seen))
        seen.add(row)
    marks = "".join(faults)
    _, audit, end = search(initials(roles), _hard(marks), 0, {s: 5 * n for s, n in enumerate(OWED)})
    audit += "I" * OWED[end]
    cost, out, _ = edited(roles, texts, marks, audit, 0)
    return counts(roles, marks) | {"cost": cost, "edits": audit, "repaired": [{"role": r, "text": t} for r, t in out]}


def _arrow(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


def _mapped(ddl: str, f, *args: Column) -> Column:
    """f of Python values of the columns, row by row over Arrow batches; f gives a value of the type."""
    kind = _arrow(ddl)

    @F.arrow_udf(ddl)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = [c.to_pylist() for c in (batch if isinstance(batch, tuple) else (batch,))]
            yield pa.array([f(*row) for row in zip(*columns, strict=True)], type=kind)

    return run(*args)


def prepared(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with one space for null texts and roles; copies is 1 unless the column is there."""
    copies = F.col("copies") if "copies" in conversations.columns else F.lit(1)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), copies.cast("long").alias("copies"))


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations of bounded size, a row each."""

    def one(listed: list[dict]) -> dict:
        return repair_rows([(r["role"], r["text"]) for r in listed for _ in range(r["copies"])])

    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("rows"))
    found = _mapped(f"struct<{PARTS}, {REPAIR}>", one, F.col("rows"))
    turns = F.transform(F.filter("rows", lambda r: (r["copies"] > 0) & r["turn"].isNotNull()), lambda r: r["turn"])
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0).cast("long"))
    return listed.select("conv_id", gaps.alias("gaps"), found.alias("found")).select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("no"), "gaps", "found.*")


BLOCK = "conv_id {id}, part int, no int, roles array<string>, texts array<string>, faults string"


def _blocks(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Rows of long conversations in order, cut into blocks of bounded rows and bytes."""
    digest = [F.xxhash64("role", "text"), F.xxhash64(F.lit("2"), "text", "role")]
    keyed = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    keyed = keyed.withColumn("k", F.struct(*digest)).withColumn("t", F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0).cast("long"))))
    first = keyed.groupBy(F.col("conv_id").alias("c"), F.col("k").alias("first_k")).agg(F.min("t").alias("first_t"), F.count("*").alias("times"))
    first = first.where("times > 1")
    marked = keyed.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k") == F.col("first_k")), "left")
    marked = marked.select("conv_id", "turn", "role", "text", "copies", F.coalesce(F.col("first_t") < F.col("t"), F.lit(False)).alias("later"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartitionByRange(parts, *order, F.col("text")).sortWithinPartitions(*order, "text")
    kind = dict(rows.dtypes)["conv_id"]
    schema = BLOCK.format(id=kind)
    arrow = pa.schema(list(_arrow(f"struct<{schema}>")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, str]] = []
        whose, part, no, size = None, 0, 0, 0

        def block() -> pa.RecordBatch:
            row = {"conv_id": whose, "part": part, "no": no, "roles": [r for r, _, _ in held], "texts": [t for _, t, _ in held], "faults": "".join(f for _, _, f in held)}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                part = r["part"]
                for i in range(r["copies"]):
                    if held and (r["conv_id"] != whose or len(held) >= block_rows or size >= block_bytes):
                        yield block()
                        no, size = no + 1, 0
                        held.clear()
                    whose = r["conv_id"]
                    held.append((r["role"], r["text"], fault_of(r["text"], r["later"] or i > 0)))
                    size += len(r["text"])
        if held:
            yield block()

    return dealt.select(F.spark_partition_id().alias("part"), "*").mapInArrow(cut, schema)


def _long(work: Work, rows: DataFrame, ids: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Conversations of any size, a row a block; one without rows has one empty block."""
    blocks = work.save(_blocks(rows, block_rows, block_bytes), "blocks")
    letters = F.array_join(F.transform("roles", lambda r: F.when(F.substring(r, 1, 1).isin("s", "u", "a"), F.substring(r, 1, 1)).otherwise("x")), "")
    hard = F.translate("faults", "br", "dd")

    def crossed(roles: str, faults: str) -> list[int]:
        found = [search(roles, faults, a, {b: 0}) for a in range(4) for b in range(4)]
        return [-1 if f is None else f[0] for f in found]

    def behind(listed: list[dict]) -> list[dict]:
        """The cost to go behind each block, and whether the seam before it is illegal, from the blocks of a conversation in order."""
        ahead, out = [5 * n for n in OWED], []
        for i in range(len(listed) - 1, -1, -1):
            b = listed[i]
            seam = i > 0 and listed[i - 1]["last"] + b["first"] not in ("su", "ua", "au")
            out.append({"part": b["part"], "no": b["no"], "ahead": ahead, "seam": int(seam), "final": i == len(listed) - 1})
            ahead = [min(b["costs"][4 * s + e] + ahead[e] for e in range(4) if b["costs"][4 * s + e] >= 0) for s in range(4)]
        return out

    def best(roles: str, faults: str, ahead: list[int]) -> list[dict]:
        found = [search(roles, faults, s, dict(enumerate(ahead))) for s in range(4)]
        return [{"edits": f[1], "end": f[2]} for f in found]

    def chained(listed: list[dict]) -> list[dict]:
        state, out = 0, []
        for b in listed:
            out.append({"part": b["part"], "no": b["no"], "state": state})
            state = b["ends"][state]
        return out

    def by_conversation(df: DataFrame, ddl: str, f, *values) -> DataFrame:
        """f of each conversation's blocks in order, which are small here, as rows again."""
        listed = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "no", *values))).alias("l"))
        return listed.select(F.col("conv_id").alias("c"), F.explode(_mapped(f"array<struct<part: int, no: int, {ddl}>>", f, F.col("l"))).alias("v")).select("c", F.col("v.part").alias("p"), F.col("v.no").alias("n"), *[f"v.{x.split(':')[0].strip()}" for x in ddl.split(", ")])

    def with_blocks(df: DataFrame, more: DataFrame) -> DataFrame:
        return df.join(more, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("no") == F.col("n"))).drop("c", "p", "n")

    edge = lambda at: F.substring(F.element_at("roles", at), 1, 1)
    costs = blocks.select("conv_id", "part", "no", _mapped("array<long>", crossed, letters, hard).alias("costs"), edge(1).alias("first"), edge(-1).alias("last"))
    ahead = work.save(by_conversation(costs, "ahead: array<long>, seam: long, final: boolean", behind, "costs", "first", "last"), "ahead")
    kind = "array<struct<edits: string, end: int>>"
    plans = with_blocks(blocks.select("conv_id", "part", "no", letters.alias("letters"), hard.alias("hard")), ahead)
    plans = work.save(plans.select("conv_id", "part", "no", "seam", "final", _mapped(kind, best, F.col("letters"), F.col("hard"), F.col("ahead")).alias("plans")), "plans")
    states = by_conversation(plans.select("conv_id", "part", "no", F.col("plans.end").alias("ends")), "state: int", chained, "ends")
    chosen = with_blocks(plans, states).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("no").alias("n"), "state", "seam", "final", F.get("plans", "state").alias("plan"))

    def finish(roles: list[str], texts: list[str], faults: str, state: int, seam: int, final: bool, plan: dict) -> dict:
        audit = plan["edits"] + ("I" * OWED[plan["end"]] if final else "")
        cost, out, _ = edited(roles, texts, faults, audit, state)
        found = counts(roles, faults) | {"cost": cost, "edits": audit, "repaired": [{"role": r, "text": t} for r, t in out]}
        return found | {"illegal": found["illegal"] + seam}

    done = with_blocks(blocks, chosen)
    found = _mapped(f"struct<{PARTS}, {REPAIR}>", finish, *[F.col(c) for c in ("roles", "texts", "faults", "state", "seam", "final", "plan")])
    done = done.select("conv_id", "part", "no", found.alias("found")).select("conv_id", "part", "no", "found.*")
    turns = rows.where("copies > 0").groupBy(F.col("conv_id").alias("c")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    full = ids.join(turns, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(F.col("conv_id").alias("c"), F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"))
    joined = full.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    number = lambda c, t: F.coalesce(c, F.lit(0)).cast(t).alias(c)
    return joined.select(
        F.col("c").alias("conv_id"), number("part", "int"), number("no", "int"), "gaps", *[number(c, "long") for c in ("n_rows", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("edits", F.lit("")).alias("edits"), F.coalesce("repaired", F.array().cast("array<struct<role: string, text: string>>")).alias("repaired"),
    )


def repair(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> tuple[DataFrame, DataFrame]:
    """The repaired conversations in blocks: (those of one block, those of many).

    Columns: conv_id, part and no (order of the blocks of a conversation), gaps (of the whole conversation, on each
    block), n_rows, blank, duplicate, truncated, illegal, cost, edits, repaired (rows of role and text). A column
    ``copies`` of conversations, if there, says how often a row stands in a row; 0 drops it and keeps its conversation.
    """
    spark: SparkSession = conversations.sparkSession
    enable_workers(spark)
    work = Work(spark, "conversations")
    rows = prepared(conversations)
    size = rows.groupBy("conv_id").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.octet_length("text") * F.col("copies")).alias("bytes"))
    ids = work.save(size.where(f"n > {long_rows} or bytes > {long_bytes}").select("conv_id"), "long")
    if not ids.take(1):
        whole = _whole(rows)
        return whole, whole.limit(0)
    mine = lambda how: rows.join(ids.select(F.col("conv_id").alias("long_id")), F.col("conv_id").eqNullSafe(F.col("long_id")), how)
    return _whole(mine("left_anti")), work.save(_long(work, mine("left_semi").where("copies > 0"), ids, long_rows, long_bytes), "repaired")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with the contract's faults, by the checksum of ``conv_id:turn``; see ``repair`` for copies."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(kind == 4, "user").otherwise(said("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _streamed_digest(blocks: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations of many blocks: each is read in order, a block at a time."""
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    said = blocks.where(F.size("repaired") > 0).select("conv_id", "part", "no", lines.alias("lines"))
    schema = f"conv_id {dict(blocks.dtypes)['conv_id']}, repaired_sha256 string"
    arrow = pa.schema(list(_arrow(f"struct<{schema}>")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, running = None, None
        row = lambda: pa.RecordBatch.from_pylist([{"conv_id": whose, "repaired_sha256": running.hexdigest()}], schema=arrow)
        for batch in batches:
            for r in batch.to_pylist():
                if running is None or r["conv_id"] != whose:
                    if running is not None:
                        yield row()
                    whose, running = r["conv_id"], hashlib.sha256(r["lines"].encode())
                else:
                    running.update(b"\n" + r["lines"].encode())
        if running is not None:
            yield row()

    return said.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(digest, schema)


def op13_conversation_repair(spark, sf_dir: str, long_rows: int = LONG_ROWS) -> DataFrame:
    """Every conversation, damaged as the contract says: its faults, least cost, audit and digest of the repaired rows."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    one, many = repair(damaged(conversations), long_rows)
    numbers = ["blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    short = one.select("conv_id", "gaps", *numbers, F.col("edits").alias("audit"), F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    edits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "no", "edits"))), lambda b: b["edits"]), "")
    summed = many.groupBy("conv_id").agg(F.first("gaps").alias("gaps"), *[F.sum(c).alias(c) for c in numbers], edits.alias("audit"))
    digests = _streamed_digest(many).withColumnRenamed("conv_id", "c")
    full = summed.join(digests, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return short.union(full.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))).select(*short.columns))
