"""Chat formatting: roles of a raw transcript by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines. States are (role, opening line) and (role, later line) for each role; what
is seen of a line are its speaker marker (none, one of a role's, an unknown name, a dash), whether it ends in a
question mark, its length, and whether the line before it is blank. Viterbi's best path gives the roles; a turn begins
at each opening line, its marker is cut off, blank lines at its end go, and turns are rendered as ``<|role|>`` blocks,
in which ``<|`` of a text is escaped (``escaped``), so no text can pose as a marker. Start, transition and emission
probabilities are smoothed counts over all conversations that aren't held out, counted in the tasks; what a unit's first
line follows comes from the unit before it, so neither counts nor paths depend on where units are cut.

Transcripts come in eight styles, by a hash of the conversation's id: five name the speakers' roles (but one turn in
eight has a dash only), one has people's names, one has dashes only, and one has no markers, only blank lines
between turns. Roles of the latter three must come from order and lines.

The table of conversations is turned into transcripts first, and equal rows are merged before they meet. Units of
work are pages of ``PAGE`` turns; a page of more than ``MOST_ROWS`` rows is cut into parts of ``PAGE`` rows by rank, so
rows that turns don't tell apart are bounded work too (a unit's size is that of its rows' texts). Decoding is exact for the whole conversation: each unit gives
the best scores from a state of its first line to a state of the next unit's (max-plus matrices), these are combined
in order, and units are decoded between the states so found. The renderings of a conversation's units, in order of
page and part, join to the rendering of the whole.

Results for odd input: a null text is an empty line; a null role is ``user`` when a transcript is written and
isn't learned from (where a whole unit has no known role, neither is the step behind it); repeated rows count once; turns that tie are ordered by role and text; rows without turn
are on page 0; a long text is lines like any other; an empty table gives an empty result. Extra columns are
left out, so names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvatlas.llm.langid import fold
from kvatlas.llm.shared import stored, table

ROLES, PAGE = ("system", "user", "assistant"), 64
MOST_ROWS, BLOCK = 16 * PAGE, 4096  # rows of an undivided page; units whose matrices are combined at once
#: Names that mark a speaker, by role.
NAMES = {
    "system": ("system", "instructions", "context", "note"),
    "user": ("user", "human", "q", "question", "customer", "me"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "agent", "model"),
}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
#: How transcripts mark speakers: (system, user, assistant), and what stands behind a turn.
STYLES = (
    ("System: ", "User: ", "Assistant: ", ""),
    ("### Instructions: ", "### Human: ", "### AI: ", ""),
    ("Note: ", "Q: ", "A: ", ""),
    ("[system] ", "[user] ", "[assistant] ", ""),
    ("<|system|> ", "<|user|> ", "<|assistant|> ", ""),
    ("Setting: ", "Robin: ", "Kim: ", ""),
    ("- ", "- ", "- ", ""),
    ("", "", "", "\n"),
)
NAMED, PEOPLE = 5, 5  # the first five styles name roles; people's names are dealt to roles by conversation
MARKER = re.compile(r"\s*(?:#{1,6}\s+|\*\*|\[|<\|?)?(\w{1,14})(?:\]|\|?>)?(?::\*\*|:|(?<=[\]>]))\s?")
DASH = re.compile(r"\s*[-*>]\s+")
NONE, UNKNOWN, DASHED = len(ROLES), len(ROLES) + 1, len(ROLES) + 2


#: What Python takes for white space, as a regular expression's line.
BLANK_LINE = r"^[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*$"


def observe(lines: list[str], gap: int = 1) -> list[tuple[int, int, int, int, int]]:
    """Marker, question, length class, whether a blank line comes before (``gap``: before the first line; so it does at
    a conversation's start), and where the text behind the marker starts, of each line."""
    out = []
    for line in lines:
        kind, start = NONE, 0
        if m := MARKER.match(line):
            name = m.group(1).lower()
            kind, start = (ROLES.index(ROLE_OF[name]) if name in ROLE_OF else UNKNOWN), m.end()
        elif m := DASH.match(line):
            kind, start = DASHED, m.end()
        n, bare = len(line), line.rstrip()
        out.append((kind, int(bare.endswith("?")), int(bool(bare)) + int(n > 60) + int(n > 200), gap, start))
        gap = int(not bare)
    return out


class Model:
    """Log probabilities: start (S), step (S x S), and of each feature (S x 6, 2, 4 and 2).

    State 2 r opens a turn of role r, state 2 r + 1 goes on with it.
    """

    def __init__(self, start, step, *features) -> None:
        self.start, self.step, self.features = start, step, features

    def emit(self, seen: list[tuple[int, int, int, int, int]]) -> np.ndarray:
        values = np.array(seen).T
        return sum(f[:, v] for f, v in zip(self.features, values, strict=False))

    def path(self, seen: list[tuple[int, int, int, int, int]], first: int | None = None, after: int | None = None) -> list[int]:
        """Viterbi's best states; ties go to the lower state.

        ``first`` is the first line's state where it is known, ``after`` that of the line behind the last.
        """
        emit = self.emit(seen)
        best, back = (self.start if first is None else np.where(np.arange(len(self.start)) == first, 0.0, -np.inf)) + emit[:, 0], []
        for t in range(1, emit.shape[1]):
            options = best[:, None] + self.step
            back.append(options.argmax(0))
            best = options.max(0) + emit[:, t]
        out = [int((best if after is None else best + self.step[:, after]).argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def span(self, seen: list[tuple[int, int, int, int, int]]) -> np.ndarray:
        """S x (S + 1) best scores from each state of the first line: to each state behind the last line, and to the end."""
        emit = self.emit(seen)
        best = np.where(np.eye(len(self.start), dtype=bool), emit[:, 0], -np.inf)
        for t in range(1, emit.shape[1]):
            best = (best[:, :, None] + self.step).max(1) + emit[:, t]
        return np.column_stack([(best[:, :, None] + self.step).max(1), best.max(1)])


def joined(spans: list[np.ndarray]) -> np.ndarray:
    """The span of consecutive spans."""
    out = spans[-1]
    for m in reversed(spans[:-1]):
        out = (m[:, :-1, None] + out[None, :, :]).max(1)
    return out


def firsts(spans: list[np.ndarray], first: int | None, rest: np.ndarray | None, start: np.ndarray) -> list[tuple[int, np.ndarray | None]]:
    """For consecutive spans: the best first state, and the scores to go behind it (None at the end).

    ``first`` is None at a conversation's start; ``rest`` holds the scores to go behind the last span.
    """
    go = [rest]
    for m in reversed(spans):
        go.append(m[:, -1] if go[-1] is None else (m[:, :-1] + go[-1]).max(1))
    go.reverse()
    out, state = [], int((start + go[0]).argmax()) if first is None else first
    for i, m in enumerate(spans):
        out.append((state, go[i + 1]))
        if go[i + 1] is not None:
            state = int((m[state, :-1] + go[i + 1]).argmax())
    return out


SHAPES = ((2 * len(ROLES),), (2 * len(ROLES),) * 2, *((2 * len(ROLES), n) for n in (len(ROLES) + 3, 2, 4, 2)))


def counted(page: list[tuple[str, list[str]]], counts: list[np.ndarray], opens: bool = True, gap: int = 1, before: int | None = None) -> None:
    """Add a page of (role, lines) to counts of SHAPES. ``opens``: its first line opens a conversation; else ``before`` is the state before it."""
    seen = observe([x for _, lines in page for x in lines], gap)
    states = [2 * ROLES.index(role) + (i > 0) for role, lines in page for i in range(len(lines))]
    if states and opens:
        counts[0][states[0]] += 1
    elif states and before is not None:
        counts[1][before, states[0]] += 1
    np.add.at(counts[1], (states[:-1], states[1:]), 1)
    for k, values in enumerate(list(zip(*seen, strict=True))[:4]):
        np.add.at(counts[2 + k], (states, list(values)), 1)


def model_of(counts: list[np.ndarray]) -> Model:
    """Smoothed counts as a model: a turn goes on with its own role only."""
    start, step = counts[0] + 1.0, counts[1] + 0.5
    features = [counts[2] + 0.5, *(c + 1.0 for c in counts[3:])]
    for r in range(len(ROLES)):
        step[:, 2 * r + 1] *= [float(k // 2 == r) for k in range(len(start))]
        start[2 * r + 1] = 0
    with np.errstate(divide="ignore"):
        return Model(*[np.log(x / x.sum(-1, keepdims=True)) for x in (start, step, *features)])


def fit(pages: list[list[tuple[str, list[str]]]]) -> Model:
    """From whole conversations of (role, lines)."""
    counts = [np.zeros(s) for s in SHAPES]
    for page in pages:
        counted(page, counts)
    return model_of(counts)


def parse(transcript: str, model: Model, seen: list[tuple[int, int, int, int, int]] | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn. ``seen`` is what is seen of the lines, if not that of one unit."""
    lines = transcript.split("\n")
    seen = seen or observe(lines)
    turns: list[tuple[str, list[str]]] = []
    for line, what, state in zip(lines, seen, model.path(seen), strict=True):
        if state % 2 == 0 or not turns:
            turns.append((ROLES[state // 2], [line[what[-1] :]]))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(text).rstrip("\n")) for role, text in turns]


def escaped(text: str) -> str:
    """``<|`` as ``<\\|``, and ``<\\`` as ``<\\\\``: no text holds a marker, and texts can be told apart."""
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return text.replace("<\\|", "<|").replace("<\\\\", "<\\")


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{escaped(text)}\n<|end|>\n" for role, text in turns)


def piece(transcript: str, model: Model, first: int | None = None, after: int | None = None, gap: int = 1) -> tuple[list[str], str]:
    """Roles of the turns that begin in a unit, and its part of the rendering.

    A unit may go on with the turn before it, and the unit after it with its last turn.
    """
    lines = transcript.split("\n")
    seen = observe(lines, gap)
    roles: list[str] = []
    out: list[str] = []

    def end() -> None:
        while out and out[-1] == "\n":  # blank lines at the end of a turn
            out.pop()
        out.append("<|end|>\n")

    for i, (line, what, state) in enumerate(zip(lines, seen, model.path(seen, first, after), strict=True)):
        if state % 2 == 0:
            if i:
                end()
            roles.append(ROLES[state // 2])
            out.append(f"<|{roles[-1]}|>\n{escaped(line[what[-1] :])}\n")
        else:
            out.append(escaped(line) + "\n")
    if after is None or after % 2 == 0:
        end()
    return roles, "".join(out)


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``rank``, from 0, within ``by``: by a sort over all tasks and sums of counts, so a hot group is split."""
    ordered = stored(df.orderBy(*by, *order).withColumn("_i", F.monotonically_increasing_id()), "ranks").withColumn("_run", F.shiftright("_i", 33))
    runs = ordered.groupBy(*by, "_run").agg(F.min("_i").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_run").alias("_at"), (F.col("_least") - before).alias("_zero"))
    same = F.col("_run") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return ordered.join(runs, same).select(*df.columns, (F.col("_i") - F.col("_zero")).alias("rank"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, page, part, style, turns: array of (turn, role, line with marker), in order."""
    rows = conversations.select("conv_id", "turn", "role", "text").distinct()  # merged in the tasks first
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int").alias("style")
    marks = F.array(*[F.array(*[F.lit(m) for m in s]) for s in STYLES])
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 2).otherwise(1)
    swapped = (F.col("style") == PEOPLE) & (F.pmod(F.xxhash64("conv_id", F.lit(5)), F.lit(2)) == 1)
    which = F.when(swapped & (role > 0), 3 - role).otherwise(role)
    lost = (F.col("style") < NAMED) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0)
    own = F.element_at(marks, F.col("style") + 1)
    mark = F.when(lost, F.lit("- ")).otherwise(F.element_at(own, which + 1))
    rows = rows.withColumn("style", style)
    page = F.coalesce(F.floor(F.col("turn") / PAGE), F.lit(0)).cast("long").alias("page")
    line = F.concat(mark, F.coalesce("text", F.lit("")), F.element_at(own, 4)).alias("line")
    rows = rows.select("conv_id", page, "style", "turn", "role", line)
    hot = rows.groupBy("conv_id", "page").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ROWS).select(F.col("conv_id").alias("hot_id"), F.col("page").alias("hot_page"))
    hot = stored(hot, "hot")
    own = F.col("conv_id").eqNullSafe(F.col("hot_id")) & (F.col("page") == F.col("hot_page"))
    parts = rows.withColumn("part", F.lit(0).cast("long"))
    if not hot.isEmpty():
        large = ranked(rows.join(F.broadcast(hot), own, "left_semi"), ["conv_id", "page"], ["turn", "role", "line"])
        small = parts.join(F.broadcast(hot), own, "left_anti")
        parts = small.unionByName(large.withColumn("part", F.floor(F.col("rank") / PAGE)).drop("rank"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "line"))).alias("turns")
    return parts.groupBy("conv_id", "page", "part", "style").agg(turns)


def conv_key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("conv")


def neighbours(units: DataFrame, columns: list[str]) -> DataFrame:
    """conv, page, part, goes_on (a unit follows), follows, and ``columns`` of the unit before, for conversations of several units."""
    rows = units.select("conv", "page", "part", *columns)
    several = stored(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    if several.isEmpty():
        return rows.limit(0).withColumn("goes_on", F.lit(False)).withColumn("follows", F.lit(False))
    own = ranked(rows.join(several.select("conv"), "conv", "left_semi"), ["conv"], ["page", "part"])
    before = own.select("conv", (F.col("rank") + 1).alias("rank"), *columns)
    after = own.select("conv", (F.col("rank") - 1).alias("rank"), F.lit(True).alias("goes_on"))
    found = own.drop(*columns).join(before, ["conv", "rank"], "left").join(after, ["conv", "rank"], "left")
    return found.select("conv", "page", "part", *columns, F.coalesce("goes_on", F.lit(False)).alias("goes_on"), (F.col("rank") > 0).alias("follows"))


def _last_blank(lines: Column) -> Column:
    return F.element_at(lines, -1).rlike(BLANK_LINE).cast("int")


def known_before(pages: DataFrame) -> DataFrame:
    """``pages`` with ``opens``, and of the last line with a known role in the unit before: ``gap`` (it is blank) and ``before`` (its state)."""
    role = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, 2 * i)]), F.col("known.role"))
    rows = pages.select(conv_key(), "page", "part", F.try_element_at(F.filter("turns", lambda t: t["role"].isin(*ROLES)), F.lit(-1)).alias("known"))
    lines = F.split("known.line", "\n")
    rows = rows.select("conv", "page", "part", _last_blank(lines).alias("gap"), (role + (F.size(lines) > 1).cast("int")).alias("before"))
    found = pages.withColumn("conv", conv_key()).join(neighbours(rows, ["gap", "before"]), ["conv", "page", "part"], "left")
    return found.select("turns", (~F.coalesce("follows", F.lit(False))).alias("opens"), "gap", "before")


def units_of(pages: DataFrame) -> DataFrame:
    """unit, conv_id, page, part, style, transcript, true_roles, gap (the line before is blank).

    Blank lines at a unit's end go to the next unit, which can tell whether they end a turn; a unit of nothing else keeps its own.
    """
    rows = pages.select(
        conv_key(), "conv_id", "page", "part", "style",
        F.array_join(F.transform("turns", lambda t: t["line"]), "\n").alias("transcript"),
        F.array_join(F.transform("turns", lambda t: F.coalesce(t["role"], F.lit("user"))), ",").alias("true_roles"),
    )
    bare = F.when(F.col("transcript").rlike(r"[^\n]"), F.regexp_replace("transcript", r"\n+\z", "")).otherwise(F.col("transcript"))
    rows = rows.withColumn("bare", bare)
    ends = rows.select("conv", "page", "part", _last_blank(F.split("bare", "\n")).alias("gap"), (F.length("transcript") - F.length("bare")).alias("moved"))
    rows = rows.join(neighbours(ends, ["gap", "moved"]), ["conv", "page", "part"], "left")
    own = F.when(F.coalesce("goes_on", F.lit(False)), F.col("bare")).otherwise(F.col("transcript"))
    return rows.select(
        F.monotonically_increasing_id().alias("unit"), "conv_id", "page", "part", "style",
        F.concat(F.repeat(F.lit("\n"), F.coalesce("moved", F.lit(0))), own).alias("transcript"), "true_roles", F.coalesce("gap", F.lit(1)).alias("gap"),
    )


def train(pages: DataFrame) -> Model:
    """From all ``pages``: each task counts, Spark adds up, and the counts (under 100) come to the driver."""
    sizes = [int(np.prod(x)) for x in SHAPES]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [np.zeros(x) for x in SHAPES]
        for batch in batches:
            for opens, gap, before, turns in zip(batch["opens"], batch["gap"], batch["before"], batch["turns"], strict=True):
                own = [(t["role"], t["line"].split("\n")) for t in turns if t["role"] in ROLES]
                counted(own, counts, opens, 1 if pd.isna(gap) else int(gap), None if pd.isna(before) else int(before))
        flat = np.concatenate([c.ravel() for c in counts])
        yield pd.DataFrame({"k": np.arange(len(flat)), "n": flat})[flat > 0]

    rows = known_before(pages).mapInPandas(count, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(sum(sizes))
    flat[[r["k"] for r in rows]] = [r["n"] for r in rows]
    return model_of([x.reshape(shape) for x, shape in zip(np.split(flat, np.cumsum(sizes)[:-1]), SHAPES, strict=True)])


def boundaries(units: DataFrame, model: Model) -> DataFrame:
    """unit, first, after: states of the first line and of the line behind, for conversations of several units."""
    count = units.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("long_id"))
    count = stored(count, "long")
    if count.isEmpty():
        return units.sparkSession.createDataFrame([], "unit long, first int, after int")
    own = units.join(count, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")

    def span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [model.span(observe(t.split("\n"), g)).tobytes() for t, g in zip(b["transcript"], b["gap"], strict=True)]
            yield b[["conv", "page", "part", "unit"]].assign(span=spans)

    rows = own.select(conv_key(), "page", "part", "unit", "transcript", "gap").mapInPandas(span, "conv string, page long, part long, unit long, span binary")
    spans = stored(ranked(rows, ["conv"], ["page", "part"]).withColumn("block", F.floor(F.col("rank") / BLOCK)), "spans")
    shape = (len(model.start), len(model.start) + 1)
    read = lambda x: [np.frombuffer(b).reshape(shape) for b in x]

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("rank")
        return g[["conv", "block"]].head(1).assign(span=[joined(read(g["span"])).tobytes()])

    def between(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("block")
        found = firsts(read(g["span"]), None, None, model.start)
        return g[["conv", "block"]].assign(first=[f for f, _ in found], rest=[None if r is None else r.tobytes() for _, r in found])

    def within(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("rank")
        rest = g["rest"].iloc[0]
        found = firsts(read(g["span"]), int(g["first"].iloc[0]), None if rest is None else np.frombuffer(rest), model.start)
        first = [f for f, _ in found]
        last = None if rest is None else int((read(g["span"].tail(1))[0][first[-1], :-1] + found[-1][1]).argmax())
        return pd.DataFrame({"unit": g["unit"].to_numpy(), "first": first, "after": pd.array([*first[1:], last], dtype="Int32")})

    blocks = spans.groupBy("conv", "block").applyInPandas(whole, "conv string, block long, span binary")
    edges = blocks.groupBy("conv").applyInPandas(between, "conv string, block long, first int, rest binary")
    return spans.join(edges, ["conv", "block"]).groupBy("conv", "block").applyInPandas(within, "unit long, first int, after int")


def formatted(units: DataFrame, model: Model) -> DataFrame:
    """conv_id, page, part, n_turns, roles, rendered: from ``transcript``, without a look at the true roles.

    ``first`` and ``after`` are null where a conversation begins and ends.
    """
    state = lambda x: None if pd.isna(x) else int(x)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [piece(t, model, state(f), state(a), g) for t, f, a, g in zip(batch["transcript"], batch["first"], batch["after"], batch["gap"], strict=True)]
            yield pd.DataFrame(
                {
                    "conv_id": batch["conv_id"].astype("Int64"),
                    "page": batch["page"],
                    "part": batch["part"],
                    "n_turns": [len(x) for x, _ in found],
                    "roles": [",".join(x) for x, _ in found],
                    "rendered": [x for _, x in found],
                    "true_roles": batch["true_roles"],
                    "style": batch["style"],
                }
            )

    return units.mapInPandas(read, "conv_id long, page long, part long, n_turns int, roles string, rendered string, true_roles string, style int")


def decoded(pages: DataFrame, model: Model) -> DataFrame:
    """``formatted`` of what ``transcripts`` gives, with whole conversations' best paths."""
    units = stored(units_of(pages), "units")
    return formatted(units.join(boundaries(units, model), "unit", "left"), model)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = stored(transcripts(table(spark, sf_dir, "conversations")), "pages")
    rows = decoded(pages, train(pages.where(~fold("conv_id", 4, 2))))
    right = (F.col("roles") == F.col("true_roles")).alias("roles_right")
    return rows.select(
        "conv_id", "page", "part", "style", fold("conv_id", 4, 2).alias("held_out"), "n_turns", "roles", right, "rendered", F.sha2("rendered", 256).alias("sha256")
    )
