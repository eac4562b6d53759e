"""Conversation structure repair: cheapest edits to (s?(ua)+)? by grammar-compressed min-plus products.

Every row after damage becomes one terminal symbol: its role class (s, u, a, or x for any other role) and
its first fault (none, truncated, or must go: blank or duplicate). Re-Pair, run over the symbol strings of
all conversations together, replaces the most frequent adjacent pairs by rule symbols for a bounded number
of rounds. Each symbol, terminal or rule, has one transfer matrix over the four states of the role automaton
(start, after s, after u, after a): entry (p, q) is the least cost of taking the rows it stands for from p
to q, with the ASCII-least edit audit of that cost. Terminal matrices include up to two inserts before the
row; rule matrices are min-plus products of their two parts, computed bottom-up once and shared by every
conversation that uses the rule.

Audits of equal row counts compare unit by unit (a unit is I*K, I*R or I*D, and no unit is a prefix of
another), so keeping only the least audit per entry is exact under concatenation; inserts after the last
row are added at the very end.

Spark plan: damage, faults, first occurrences and counts are JVM aggregates (no window over a conversation);
rows are cut into blocks of BLOCK_TURNS turn numbers, so a long conversation is spread over many tasks;
Re-Pair rounds count pairs per task and add them up; blocks are multiplied out in tasks, and each
conversation folds its block matrices as a balanced tree and streams its repaired rows into the hash.
"""

import hashlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.scratch import written

BLOCK_TURNS = 64
ROUNDS = 6
PAIRS_PER_ROUND = 32
_FIRST_BLOCK = -(2**63)
_RULE_BASE = 0xE000
INF = float("inf")

# Fixed values of the contract: edit costs, damage codes, legal adjacent role initials.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
DAMAGE_KINDS = 20
DROP, EMPTY, UNPUNCTUATE, REPEAT, TO_USER = 0, 1, 2, 3, 4
LEGAL_PAIRS = ("su", "ua", "au")
SPACE = "[\\x20\\x09-\\x0D]"

# States of the role automaton for (s?(ua)+)?.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A,
         (AFTER_A, "u"): AFTER_U}
_ACCEPT_TAIL = {START: "", AFTER_A: "", AFTER_U: "I", AFTER_S: "II"}
_ROLE_NAME = {"u": "user", "a": "assistant"}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows after damage; nulls are read as one space first."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(DAMAGE_KINDS))
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_k")).where(
        F.col("_k") != DROP).select(
        "conv_id", "turn",
        F.when(F.col("_k") == TO_USER, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_k") == EMPTY, F.lit("")).when(F.col("_k") == UNPUNCTUATE, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(F.col("_k") == REPEAT, 2).otherwise(1).cast("long").alias("copies"))


def _blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE[1:-1]}]")


def _truncated(text: Column) -> Column:
    return ~text.rlike(f"[.!?]{SPACE}*$")


def faulted(conversations: DataFrame) -> DataFrame:
    """Distinct damaged rows (conv_id, turn, role, text) with mult (their copies) and flags of the first copy.

    Later copies of a row are duplicates of it (or blank). `dup` is whether (role, text) occurs at an
    earlier turn of the conversation (null turns first).
    """
    rows = damaged(conversations).groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("mult"))
    order = F.struct(F.col("turn").isNotNull().alias("t0"), F.col("turn").alias("t1"))
    first = rows.groupBy("conv_id", "role", "text").agg(F.min(order).alias("_first")).withColumnsRenamed(
        {"conv_id": "_c", "role": "_r", "text": "_t"})
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r"))
                       & (F.col("text") == F.col("_t")))
    return joined.select(
        "conv_id", "turn", "role", "text", "mult", (order != F.col("_first")).alias("dup"),
        _blank(F.col("text")).alias("blank"), _truncated(F.col("text")).alias("trunc"))


def _symbol(role: Column, blank: Column, dup: Column, trunc: Column) -> Column:
    initial = F.substring(role, 1, 1)
    cls = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(blank | dup, F.lit("M")).when(trunc, F.upper(cls)).otherwise(cls)


# ---- transfer matrices ----------------------------------------------------

def _better(a: tuple, b: tuple) -> bool:
    return a[0] < b[0] or (a[0] == b[0] and a[1] < b[1])


def _empty() -> list[list[tuple]]:
    return [[(INF, "")] * 4 for _ in range(4)]


def terminal(symbol: str) -> list[list[tuple]]:
    """Matrix of one row: up to two inserts before it, then keep, rerole or delete."""
    cls, trunc = symbol.lower(), symbol.isupper() and symbol != "M"
    extra = TRUNCATED if trunc else 0
    out = _empty()
    for p in range(4):
        ways = [(p, 0, "")]
        state = p
        for j in range(2):
            role = "a" if state == AFTER_U else "u"
            state = _STEP[(state, role)]
            ways.append((state, INSERT * (j + 1), "I" * (j + 1)))
        for mid, cost, audit in ways:
            options = [(mid, DELETE, "D")]
            if symbol != "M":
                if (mid, cls) in _STEP:
                    options.append((_STEP[(mid, cls)], KEEP + extra, "K"))
                for role in ("u", "a"):
                    if (mid, role) in _STEP:
                        options.append((_STEP[(mid, role)], REROLE + extra, "R"))
            for q, c, letter in options:
                cand = (cost + c, audit + letter)
                if _better(cand, out[p][q]):
                    out[p][q] = cand
    return out


def product(a: list[list[tuple]], b: list[list[tuple]]) -> list[list[tuple]]:
    """Min-plus product with the least audit among equal costs."""
    out = _empty()
    for p in range(4):
        for m in range(4):
            ca, sa = a[p][m]
            if ca == INF:
                continue
            for q in range(4):
                cb, sb = b[m][q]
                if cb == INF:
                    continue
                cand = (ca + cb, sa + sb)
                if _better(cand, out[p][q]):
                    out[p][q] = cand
    return out


def identity() -> list[list[tuple]]:
    out = _empty()
    for p in range(4):
        out[p][p] = (0, "")
    return out


class Grammar:
    """Rule symbols -> pairs, and the matrix of every symbol, built bottom-up."""

    def __init__(self, rules: list[tuple[str, str]], matrices: bool = True):
        self.rules = rules
        self.matrix = {s: terminal(s) for s in "sSuUaAxXM"} if matrices else {}
        for symbol, pair in rules if matrices else ():
            self.matrix[symbol] = product(self.matrix[pair[0]], self.matrix[pair[1]])

    def compress(self, seq: str) -> str:
        for symbol, pair in self.rules:
            if pair in seq:
                seq = seq.replace(pair, symbol)
        return seq

    def evaluate(self, seq: str) -> list[list[tuple]]:
        return fold([self.matrix[s] for s in self.compress(seq)])


def fold(matrices: list) -> list[list[tuple]]:
    """Product of matrices in order, as a balanced tree."""
    if not matrices:
        return identity()
    while len(matrices) > 1:
        matrices = [product(*matrices[i:i + 2]) if i + 1 < len(matrices) else matrices[i]
                    for i in range(0, len(matrices), 2)]
    return matrices[0]


def _pair_counts(frames):
    for frame in frames:
        counts = Counter()
        for seq in frame["seq"]:
            counts.update(seq[i:i + 2] for i in range(len(seq) - 1))
        if counts:
            yield pd.DataFrame({"pair": list(counts), "n": list(counts.values())})


def learn_rules(blocks: DataFrame, rounds: int = ROUNDS, per_round: int = PAIRS_PER_ROUND):
    """Re-Pair over the `seq` column of all blocks: at most rounds * per_round rules, each pair seen twice or more."""
    rules: list[tuple[str, str]] = []
    current = blocks.select("seq")
    for _ in range(rounds):
        top = (current.mapInPandas(_pair_counts, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
               .where("n >= 2").orderBy(F.desc("n"), "pair").limit(per_round).collect())
        if not top:
            break
        fresh = [(chr(_RULE_BASE + len(rules) + i), r["pair"]) for i, r in enumerate(top)]
        rules += fresh
        grammar = Grammar(fresh, matrices=False)
        squeeze = F.pandas_udf(lambda s: s.map(grammar.compress), "string")
        current = written(current.select(squeeze("seq").alias("seq")), "repair-seq")
    return Grammar(rules)


# ---- per block and per conversation ----------------------------------------

def _block_rows(rows: DataFrame) -> DataFrame:
    row = F.struct(F.col("turn").isNotNull().alias("t0"), F.col("turn").alias("t1"), "role", "text", "mult", "_sym")
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(_FIRST_BLOCK)).cast("long")
    placed = rows.withColumn("_sym", _symbol(F.col("role"), F.col("blank"), F.col("dup"), F.col("trunc")))
    grouped = placed.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    seq = F.array_join(F.transform("rows", lambda r: F.concat(r["_sym"], F.repeat(F.lit("M"), (r["mult"] - 1).cast("int")))), "")
    return grouped.withColumn("seq", seq)


def _block_matrix(grammar: Grammar):
    def run(seqs: pd.Series) -> pd.DataFrame:
        costs, audits = [], []
        for seq in seqs:
            m = grammar.evaluate(seq)
            costs.append([-1 if m[p][q][0] == INF else int(m[p][q][0]) for p in range(4) for q in range(4)])
            audits.append([m[p][q][1] for p in range(4) for q in range(4)])
        return pd.DataFrame({"costs": costs, "audits": audits})

    return run


def _initials(role: str) -> str:
    return role[:1] if role else "\0"


def _conversation(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("block", kind="stable")
    matrices = [[[(INF if c < 0 else c, a) for c, a in zip(cs[4 * p:4 * p + 4], au[4 * p:4 * p + 4], strict=True)]
                 for p in range(4)] for cs, au in zip(frame["costs"], frame["audits"], strict=True)]
    whole = fold(matrices)
    best = (INF, "")
    for q in range(4):
        cost, audit = whole[START][q]
        if cost < INF:
            tail = _ACCEPT_TAIL[q]
            cand = (cost + INSERT * len(tail), audit + tail)
            if _better(cand, best):
                best = cand
    # Adjacent role initials of the damaged rows, and the repaired rows streamed into the hash.
    illegal, before = 0, None
    digest, first_line = hashlib.sha256(), True
    letters, at, state = best[1], 0, START

    def emit(role, text):
        nonlocal first_line
        digest.update(((("" if first_line else "\n") + f"{role}:{text}")).encode())
        first_line = False

    for rows in frame["rows"]:
        for row in rows:
            init = _initials(row["role"])
            for _ in range(int(row["mult"])):
                if before is not None and before + init not in LEGAL_PAIRS:
                    illegal += 1
                before = init
                while letters[at] == "I":
                    role = "a" if state == AFTER_U else "u"
                    emit(_ROLE_NAME[role], "")
                    state, at = _STEP[(state, role)], at + 1
                letter = letters[at]
                at += 1
                if letter == "K":
                    emit(row["role"], row["text"])
                    state = _STEP[(state, init)]
                elif letter == "R":
                    role = "a" if state == AFTER_U else "u"
                    emit(_ROLE_NAME[role], row["text"])
                    state = _STEP[(state, role)]
    while at < len(letters):
        role = "a" if state == AFTER_U else "u"
        emit(_ROLE_NAME[role], "")
        state, at = _STEP[(state, role)], at + 1
    conv_id = frame["conv_id"].iloc[0]
    return pd.DataFrame({"conv_id": pd.array([None if pd.isna(conv_id) else int(conv_id)], dtype="Int64"), "illegal": [illegal], "cost": [int(best[0])],
                         "audit": [best[1]], "repaired_sha256": [digest.hexdigest()]})


_RESULT = "conv_id long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(conversations: DataFrame, rounds: int = ROUNDS, per_round: int = PAIRS_PER_ROUND) -> DataFrame:
    """One row per original conv_id (null included): gaps, blank, duplicate, truncated, illegal, cost (longs),
    audit and repaired_sha256, as the module docstring defines them.

    Rows are damaged first (see `damaged`); a conversation with no rows after damage gives zeros, an empty
    audit and the hash of the empty string. Ties in edits go to the ASCII-least audit; rows equal in turn,
    role and text are interchangeable copies. Other input columns are not carried.
    """
    conv = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = written(faulted(conv), "repair-rows")
    blocks = written(_block_rows(rows), "repair-blocks")
    grammar = learn_rules(blocks, rounds, per_round)
    matrix = F.pandas_udf(_block_matrix(grammar), "costs array<long>, audits array<string>")
    evaluated = blocks.select("conv_id", "block", "rows", matrix("seq").alias("m")).select(
        "conv_id", "block", "rows", "m.costs", "m.audits")
    repaired = evaluated.groupBy("conv_id").applyInPandas(_conversation, _RESULT)

    first_copy_trunc = F.col("trunc") & ~F.col("blank") & ~F.col("dup")
    counts = rows.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("mult")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("mult") - 1 + F.col("dup").cast("long"))).alias("duplicate"),
        F.sum(first_copy_trunc.cast("long")).alias("truncated"))
    ids = conv.select("conv_id").distinct()
    out = ids.join(counts, ids["conv_id"].eqNullSafe(counts["conv_id"]), "left").drop(counts["conv_id"])
    out = out.join(repaired, out["conv_id"].eqNullSafe(repaired["conv_id"]), "left").drop(repaired["conv_id"])
    return out.select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
