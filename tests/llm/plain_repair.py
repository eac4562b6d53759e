"""The repair contract in plain Python, one conversation at a time, by a backward DP over rows."""

import hashlib
import re
import sys
import zlib
from functools import lru_cache

COST = {"K": 0, "R": 3, "D": 4, "I": 3}
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAME = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role = " " if role is None else role
        text = " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub(r"[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (2 if k == 3 else 1)
    return out


def solve(rows):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif not re.search(r"[.!?][\x20\x09-\x0D]*$", text):
            faults.append("truncated")
        else:
            faults.append(None)
        seen.add((role, text))
    inits = [(r[1][:1] or "\0") for r in rows]
    illegal = sum(1 for x, y in zip(inits, inits[1:]) if x + y not in ("su", "ua", "au"))
    n = len(rows)
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * n + 1000))

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        """(cost, audit) from row i in state; `inserted` inserts made since the last row (at most 2)."""
        options = []
        if i == n:
            tail = {0: "", 3: "", 2: "I", 1: "II"}[state]
            return (3 * len(tail), tail)
        if inserted < 2:
            role = "a" if state == 2 else "u"
            c, a = best(i, STEP[(state, role)], inserted + 1)
            options.append((c + 3, "I" + a))
        f = faults[i]
        c, a = best(i + 1, state, 0)
        options.append((c + 4, "D" + a))
        if f not in ("blank", "duplicate"):
            extra = 3 if f == "truncated" else 0
            init = inits[i]
            if (state, init) in STEP:
                c, a = best(i + 1, STEP[(state, init)], 0)
                options.append((c + extra, "K" + a))
            for role in "ua":
                if (state, role) in STEP:
                    c, a = best(i + 1, STEP[(state, role)], 0)
                    options.append((c + 3 + extra, "R" + a))
        return min(options)

    cost, audit = best(0, 0, 0) if n else (0, "")
    lines, state, i = [], 0, 0
    for letter in audit:
        if letter == "I":
            role = "a" if state == 2 else "u"
            lines.append(f"{NAME[role]}:")
            state = STEP[(state, role)]
            continue
        _, r, text = rows[i]
        i += 1
        if letter == "K":
            lines.append(f"{r}:{text}")
            state = STEP[(state, inits[i - 1])]
        elif letter == "R":
            role = "a" if state == 2 else "u"
            lines.append(f"{NAME[role]}:{text}")
            state = STEP[(state, role)]
    counts = [sum(f == k for f in faults) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: result tuple}, every original conv_id."""
    ids = {r[0] for r in rows}
    after = {}
    for conv_id, turn, role, text in damage(rows):
        after.setdefault(conv_id, []).append((turn, role, text))
    return {c: solve(after.get(c, [])) for c in ids}
