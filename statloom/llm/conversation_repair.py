"""Conversation structure repair by an integer-minimum DAG program with scalar big-integer weights.

A conversation is repaired into the role shape ``(s?(ua)+)?`` (role initials: an optional system
turn, then user/assistant pairs) by the cheapest edits: Keep (0), Rerole to user or assistant (3),
Delete (4, the only edit of a blank or duplicate row), Insert an empty user or assistant turn (3);
a truncated row that is not deleted adds 3.

Each path's weight is one integer: the cost in the high digits and the audit (the edits' initials,
in order) in fixed-width base-5 low digits, one digit a position (D=1, I=2, K=3, R=4, ASCII order)
and 0 as end padding. So the smallest integer is the cheapest repair and, among equal costs, the
ASCII-least audit; ordinary integer minimum over the DAG of (row, inserts so far, shape state)
decides everything, and the audit is read back from the winning weight's low digits.

Faults are found by Spark (windows per conversation); the program runs once per conversation in a
pandas function over batches of conversations. Two inserts in a row never pay, so the inserts
up to a row are at most one more than the rows before it, and a conversation of n rows takes O(n^2) states.

Defined cases: rows go by turn (nulls first), then role and text, so ties and repeated rows have one
order; a null role or text must be filled by the caller (``damage`` uses one space); a row's first
fault counts (blank, then duplicate, then truncated); a role whose initial is not s, u or a can
only be rerolled or deleted; a conversation without rows costs 0 with an empty audit and an empty
repair. Null ``conv_id`` is a conversation of its own. Other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

# Edit costs, letters and the shape automaton of (s?(ua)+)?.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CODE = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {v: k for k, v in CODE.items()}
BASE = 5
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
FULL = {"u": "user", "a": "assistant"}
SPACE = "[\\x20\\x09-\\x0D]"
BLANK, DUPLICATE, TRUNCATE = "blank", "duplicate", "truncated"

def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by crc32('conv_id:turn') % 20: 0 drops the row, 1 empties its text,
    2 removes its '.', '!' and '?', 3 repeats it (same turn), 4 sets role user. Nulls in the key,
    role and text are one space; turn keeps its null for ordering."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    code = F.pmod(F.crc32(key), F.lit(20))
    text = F.coalesce(F.col("text"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        code.alias("code"),
    ).where(F.col("code") != 0)
    copies = F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("_copy")).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """Rows in conversation order (``pos``) with their first fault (null when none) and role initial."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    conv = Window.partitionBy("conv_id")
    placed = rows.withColumn("pos", F.row_number().over(conv.orderBy(*order)) - 1)
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("pos")
    last = F.regexp_extract(F.col("text"), f"([^\\x20\\x09-\\x0D]){SPACE}*$", 1)
    fault = (
        F.when(~F.col("text").rlike(f"[^\\x20\\x09-\\x0D]"), F.lit(BLANK))
        .when(F.row_number().over(seen) > 1, F.lit(DUPLICATE))
        .when(~last.isin(".", "!", "?"), F.lit(TRUNCATE))
    )
    initial = F.substring(F.col("role"), 1, 1)
    pair = F.concat(F.lag(initial).over(conv.orderBy("pos")), initial)
    return placed.select(
        "conv_id", "turn", "pos", "role", "text", fault.alias("fault"),
        (pair.isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"),
    )


def best_repair(roles: list[str], fault: list[str | None]) -> tuple[int, str, list[tuple[str, int | None]]]:
    """(cost, audit, repaired) of one conversation; repaired holds (role, row index or None if inserted)."""
    n = len(roles)
    width = 2 * n + 1
    place = [BASE ** (width - 1 - p) for p in range(width)]
    high = BASE**width
    layer: dict[tuple[int, int], int] = {(0, 0): 0}
    for i in range(n + 1):
        for j in range(0, i + 1):
            for q in range(4):
                here = layer.get((j, q))
                if here is None:
                    continue
                for r in "ua":
                    to = STEP.get((q, r))
                    if to is not None:
                        w = here + INSERT * high + CODE["I"] * place[i + j]
                        if w < layer.get((j + 1, to), w + 1):
                            layer[(j + 1, to)] = w
        if i == n:
            break
        following: dict[tuple[int, int], int] = {}
        must_go = fault[i] in (BLANK, DUPLICATE)
        penalty = TRUNCATED if fault[i] == TRUNCATE else 0
        own = roles[i][:1]
        for (j, q), here in layer.items():
            moves = [("D", DELETE, q)]
            if not must_go:
                if (q, own) in STEP:
                    moves.append(("K", KEEP + penalty, STEP[(q, own)]))
                for r in "ua":
                    if r != own and (q, r) in STEP:
                        moves.append(("R", REROLE + penalty, STEP[(q, r)]))
            for letter, cost, to in moves:
                w = here + cost * high + CODE[letter] * place[i + j]
                if w < following.get((j, to), w + 1):
                    following[(j, to)] = w
        layer = following
    best = min(w for (j, q), w in layer.items() if q in ACCEPT)
    cost, low = divmod(best, high)
    audit = []
    for p in range(width):
        digit = (low // place[p]) % BASE
        if digit == 0:
            break
        audit.append(LETTER[digit])
    return cost, "".join(audit), _replay(roles, audit)


def _replay(roles: list[str], audit: list[str]) -> list[tuple[str, int | None]]:
    out: list[tuple[str, int | None]] = []
    q, i = 0, 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        if letter == "K":
            out.append((roles[i], i))
            q = STEP[(q, roles[i][:1])]
            i += 1
            continue
        r = "a" if q == 2 else "u"
        out.append((FULL[r], i if letter == "R" else None))
        q = STEP[(q, r)]
        i += letter == "R"
    return out


PROGRAM = T.StructType(
    [
        T.StructField("cost", T.LongType()),
        T.StructField("audit", T.StringType()),
        T.StructField("kept", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("at", T.IntegerType())]))),
    ]
)


@F.pandas_udf(PROGRAM)
def _programs(roles: pd.Series, fault: pd.Series) -> pd.DataFrame:
    """The program of every conversation of an Arrow batch; texts stay in Spark."""
    costs, audits, kept = [], [], []
    for these, faults in zip(roles, fault):
        cost, audit, rows = best_repair(list(these), [f if isinstance(f, str) else None for f in faults])
        costs.append(cost)
        audits.append(audit)
        kept.append([{"role": role, "at": at} for role, at in rows])
    return pd.DataFrame({"cost": costs, "audit": audits, "kept": kept})


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, non-null role and text): gaps, the
    counts of first faults (blank, duplicate, truncated), illegal adjacent role pairs, and the
    cheapest repair: cost, audit, repaired (array of role and text).

    One aggregation per conversation gathers the counts and its rows in order; only the roles and
    faults go to Python, and the repaired texts are picked from the gathered rows by Spark.
    """
    found = faults(rows)
    gathered = found.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count(F.when(F.col("fault") == f, 1)).cast("long").alias(f) for f in (BLANK, DUPLICATE, TRUNCATE)],
        F.count(F.when(F.col("illegal"), 1)).cast("long").alias("illegal"),
        F.array_sort(F.collect_list(F.struct("pos", "role", "text", "fault"))).alias("_rows"),
    )
    program = _programs(F.transform("_rows", lambda r: r["role"]), F.transform("_rows", lambda r: r["fault"]))
    solved = gathered.withColumn("_p", program)
    repaired = F.transform(
        "_p.kept",
        lambda k: F.struct(
            k["role"].alias("role"),
            F.when(k["at"].isNull(), F.lit("")).otherwise(F.element_at("_rows", k["at"] + 1)["text"]).alias("text"),
        ),
    )
    return solved.select(
        "conv_id", "gaps", BLANK, DUPLICATE, TRUNCATE, "illegal",
        F.col("_p.cost").alias("cost"), F.col("_p.audit").alias("audit"), repaired.alias("repaired"),
    )
