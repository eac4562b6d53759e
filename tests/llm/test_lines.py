"""Line deduplication against a plain Python version."""

import random
from collections import defaultdict

from txnlens.llm.lines import dedup_lines

BLANKS = " \t\n\x0b\x0c\r"


def _plain(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    held = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            held[key(line)].add(r[0])
    low = float("-inf")
    out = []
    for r in rows:
        parts = (r[1] or "").split("\n")
        stay = [x for x in parts if not (
            len(key(x)) >= 20 and len(held[key(x)]) >= 3
            and max(held[key(x)], key=lambda i: low if i is None else i) != r[0])]
        out.append((r[0], "\n".join(stay), len(parts), len(parts) - len(stay)))
    return sorted(out, key=repr)


def _got(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=repr)


def test_against_plain(spark, docs_of):
    rng = random.Random(1)
    pool = [c * 25 for c in "abcdÉ"] + ["A" * 25, " \t" + "b" * 25 + "\r", "short", "", "x" * 19, "İ" * 20, "\xa0" + "a" * 25]
    rows = [(rng.choice([i, i, None, 3]), "\n".join(rng.choices(pool, k=rng.randint(1, 9)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (3, rows[0][1]), (3, rows[0][1])]
    df = docs_of(rows)
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert _got(out) == _plain(rows)


def test_empty_table_and_long_text(docs_of):
    assert dedup_lines(docs_of([])).count() == 0
    rows = [(i, "y" * 30 + "\n" + "z" * 2_000_000 + "\nq") for i in range(3)]
    assert _got(dedup_lines(docs_of(rows))) == _plain(rows)
