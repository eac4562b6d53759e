"""Chat formatting: a role automaton and a declarative template give text segments with loss flags.

Turns are cut into blocks of consecutive turn numbers, so a conversation of any length is formatted
by many tasks. A block knows, for every state it could be entered in, the state it leaves in and its
first illegal turn; folding those small summaries in block order validates the whole conversation.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 64
_FIRST_BLOCK = -(2**63)


@dataclass(frozen=True)
class Template:
    """Marks, titles and legal orders. `titles` maps a role to its printed title; `learned` roles carry loss.

    A role without a title is printed as `@` and the hexadecimal digits of its UTF-8 bytes.
    """

    open: str = "### "
    after_title: str = ": "
    close: str = "</turn>"
    titles: dict[str, str] = field(default_factory=lambda: {
        "system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    learned: frozenset[str] = frozenset({"assistant"})
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user", "tool": "tool"},
        "tool": {"assistant": "assistant", "tool": "tool"},
    })
    accepting: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        for mark in self.controls:
            if "\\" in mark or len(mark) < 2:
                raise ValueError(f"a control string has two characters or more and no backslash: {mark!r}")
            if any(mark.endswith(mark[:k]) for k in range(1, len(mark))):
                raise ValueError(f"a control string must not overlap itself: {mark!r}")
        for title in self.titles.values():
            if self.after_title in title or title.startswith("@") or not title:
                raise ValueError(f"a title must not be empty, start with @ or hold {self.after_title!r}: {title!r}")
        if len(set(self.titles.values())) != len(self.titles):
            raise ValueError("two roles share a title")

    @property
    def controls(self) -> list[str]:
        """Strings that never occur in an escaped text."""
        heads = [self.open + title + self.after_title.rstrip() for title in [*self.titles.values(), "@"]]
        return [self.close, *heads]

    @property
    def states(self) -> list[str]:
        return list(self.moves)

    def header(self, role: Column) -> Column:
        title = F.concat(F.lit("@"), F.hex(F.encode(role, "UTF-8")))
        for name, text in self.titles.items():
            title = F.when(role == name, F.lit(text)).otherwise(title)
        return F.concat(F.lit(self.open), title, F.lit(self.after_title))

    def escape(self, text: Column) -> Column:
        """Double every backslash, then break each control string after its first character."""
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for mark in self.controls:
            text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
        return text

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    def carries_loss(self, role: Column) -> Column:
        return role.isin(sorted(self.learned))

    def next_state(self, state: Column, role: Column) -> Column:
        """The index of the state after `role`, or -1."""
        known = sorted({r for steps in self.moves.values() for r in steps})
        code = F.lit(len(known))
        for k, name in enumerate(known):
            code = F.when(role == name, F.lit(k)).otherwise(code)
        table = [
            F.array(*[F.lit(self.states.index(self.moves[s][r]) if r in self.moves[s] else -1) for s in self.states])
            for r in known
        ] + [F.array(*[F.lit(-1)] * len(self.states))]
        return F.get(F.get(F.array(*table), code), state)


def format_turns(turns: DataFrame, template: Template) -> DataFrame:
    """(conv_id, block, turns, paths, segments): one row per block of a conversation.

    `turns` has conv_id, turn, role and text; other columns are ignored. Null roles and texts count
    as empty, null turn numbers come first, equal turn numbers go by role and text, repeated rows are
    kept, rows without conv_id form one conversation. `paths[s]` is where the block leads when it is
    entered in state s: the state after it and the first illegal turn (-1: none).
    """
    rows = turns.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(_FIRST_BLOCK)).alias("block"),
        F.struct(
            F.col("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def step(done, turn):
        def move(path):
            nxt = template.next_state(path["state"], turn["role"])
            moved = F.struct(
                F.when(nxt < 0, path["state"]).otherwise(nxt).alias("state"),
                F.when(nxt < 0, done["turns"]).otherwise(F.lit(-1)).alias("bad"),
            )
            return F.when(path["bad"] >= 0, path).otherwise(moved)

        return F.struct((done["turns"] + 1).alias("turns"), F.transform(done["paths"], move).alias("paths"))

    entered = F.struct(
        F.lit(0).alias("turns"),
        F.array(*[
            F.struct(F.lit(k).alias("state"), F.lit(-1).alias("bad")) for k in range(len(template.states))
        ]).alias("paths"),
    )

    def segment(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))

    pieces = F.flatten(F.transform("ts", lambda t: F.array(
        segment(template.header(t["role"]), F.lit(False)),
        segment(template.escape(t["text"]), template.carries_loss(t["role"])),
        segment(F.lit(template.close + "\n"), F.lit(False)),
    )))
    return blocks.withColumn("fold", F.aggregate("ts", entered, step)).select(
        "conv_id", "block", F.col("fold.turns").alias("turns"), F.col("fold.paths").alias("paths"),
        pieces.alias("segments"))


def join_blocks(blocks: DataFrame, template: Template) -> DataFrame:
    """(conv_id, formatted, segments, bad_turn, valid): one row per conversation.

    `bad_turn` is the position of the first turn that the automaton refuses (-1: none); `valid` also
    asks for an accepting last state. Every conversation is formatted, valid or not. One row holds one
    whole conversation, so its text is bounded by what a row can hold (2 GB).
    """
    whole = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "turns", "paths", "segments"))).alias("bs"))

    def step(done, block):
        path = F.get(block["paths"], done["state"])
        return F.struct(
            (done["turns"] + block["turns"]).alias("turns"),
            F.when(done["bad"] < 0, path["state"]).otherwise(done["state"]).alias("state"),
            F.when((done["bad"] < 0) & (path["bad"] >= 0), done["turns"] + path["bad"])
            .otherwise(done["bad"]).alias("bad"),
        )

    start = F.struct(
        F.lit(0).alias("turns"),
        F.lit(template.states.index("start")).alias("state"),
        F.lit(-1).alias("bad"),
    )
    accepted = [k for k, s in enumerate(template.states) if s in template.accepting]
    return (
        whole.withColumn("verdict", F.aggregate("bs", start, step))
        .withColumn("segments", F.flatten(F.transform("bs", lambda b: b["segments"])))
        .select(
            "conv_id",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            "segments",
            F.col("verdict.bad").alias("bad_turn"),
            ((F.col("verdict.bad") < 0) & F.col("verdict.state").isin(accepted)).alias("valid"),
        )
    )


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Formatted conversations with their segments; see `format_turns` and `join_blocks`."""
    template = template or Template()
    return join_blocks(format_turns(turns, template), template)


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted text as an array of (role, text), unescaped."""
    template = template or Template()
    chunks = F.split(formatted, r"\Q" + template.close + "\n" + r"\E", -1)
    by_title = F.create_map(*[F.lit(x) for role, title in template.titles.items() for x in (title, role)])

    def turn(chunk):
        title = F.substring_index(F.substr(chunk, F.lit(len(template.open) + 1)), template.after_title, 1)
        spelled = F.decode(F.unhex(F.substr(title, F.lit(2))), "UTF-8")
        body = F.substr(chunk, F.length(title) + len(template.open) + len(template.after_title) + 1)
        return F.struct(
            F.when(title.startswith("@"), spelled).otherwise(F.try_element_at(by_title, title)).alias("role"),
            template.unescape(body).alias("text"),
        )

    return F.transform(F.slice(chunks, F.lit(1), F.size(chunks) - 1), turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, in order."""
    template = template or Template()
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: template.unescape(s["text"])), "")
