"""Conversation structure repair: the cheapest edits after which a conversation alternates.

A repaired conversation is empty, or an optional system turn followed by pairs of a user's and an assistant's turn.
Keeping a turn costs nothing, giving it another role or inserting an empty turn 3, deleting it 4; blank and repeated
turns must go, and a truncated turn that stays costs 3. Of equally cheap repairs the one whose edits' initials come
first as ASCII text is taken.

The edits are found by a Viterbi search over the four states of that pattern. Survivors hang in a tree of
backpointers that counts references; as soon as all survivors share an ancestor, the edits above it are emitted and
freed, so memory holds only what is unresolved. Ties are settled by comparing the whole unresolved edits of both
survivors.

Turns are ordered by one range shuffle, so that a conversation of any length is divided among tasks. Chunks of
divided conversations are first summarised: the cost from each state to each state, and the order of the survivors'
edits. Two survivors' edits never are a prefix of each other where a turn ends, so that order settles every later
tie, and the summaries of a conversation chain into the states in which each chunk begins and ends.

Defined cases: a null conversation id is one conversation; a null turn number comes first; null roles and texts are
one space; turns of one number are ordered by role, then by the MD5 of the text; equal turns are counted, not kept
apart; ``copies`` 0 names a conversation without giving a turn. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.batches import bounded
from tillflow.session import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"

#: States: nothing yet, after a system turn, after a user's turn, after an assistant's turn.
STATES = range(4)
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
#: The one state an inserted or changed turn leads to, and the role it has.
FORCED = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
#: Inserted turns that close a conversation in each state.
CLOSING = {0: "", 1: "ua", 2: "a", 3: ""}
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 60
#: What it costs at most to go on from the first state as from the second one: inserted turns that lead there, a
#: system turn deleted that the second state could keep, or the turns that close a conversation.
BRIDGE = {(0, 1): 0, (0, 2): 3, (0, 3): 0, (1, 0): 6, (1, 2): 3, (1, 3): 6, (2, 0): 7, (2, 1): 3, (2, 3): 3,
          (3, 0): 4, (3, 1): 0, (3, 2): 3}


def moves(initial: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, str, str]]]:
    """Per state reached: (state before, cost, edits, roles) of one turn with the turns inserted before it."""
    best: dict[tuple[int, int], tuple[int, str, str]] = {}
    stay = TRUNCATED if truncated else 0
    for start in STATES:
        state, inserted = start, ""
        # A third inserted turn leads back to a state that was left already.
        for _ in range(3):
            before, paid = "I" * len(inserted), INSERT * len(inserted)
            options = [(state, DELETE, "D", "-")]
            if not must_go:
                to, role = FORCED[state]
                options.append((to, REROLE + stay, "R", role))
                if initial in NEXT[state]:
                    options.append((NEXT[state][initial], KEEP + stay, "K", "="))
            for to, cost, edit, role in options:
                found = (paid + cost, before + edit, inserted + role)
                best[start, to] = min(found, best.get((start, to), found))
            state, role = FORCED[state]
            inserted += role
    out: list[list[tuple[int, int, str, str]]] = [[] for _ in STATES]
    for (start, to), (cost, edits, roles) in sorted(best.items()):
        out[to].append((start, cost, edits, roles))
    return out


class Node:
    """A turn's edits on the way of a survivor; ``uses`` counts children and the survivor that ends here."""

    __slots__ = ("parent", "edits", "roles", "uses")

    def __init__(self, parent: Node | None, edits: str, roles: str):
        self.parent, self.edits, self.roles, self.uses = parent, edits, roles, 0
        if parent is not None:
            parent.uses += 1


def unresolved(a: Node, b: Node) -> tuple[str, str]:
    """The edits of two survivors below their last common ancestor."""
    left, right = [], []
    while a is not b:
        left.append(a.edits)
        right.append(b.edits)
        a, b = a.parent, b.parent
    return "".join(reversed(left)), "".join(reversed(right))


class Search:
    """Viterbi search from one state; :meth:`add` returns the edits that the new turn settles, oldest first."""

    def __init__(self, start: int = 0):
        self.root = Node(None, "", "")
        self.ends: dict[int, tuple[int, Node]] = {start: (0, self.root)}
        self.root.uses = 1

    def add(self, steps: list[list[tuple[int, int, str, str]]]) -> list[tuple[str, str]]:
        ends: dict[int, tuple] = {}
        for to in STATES:
            best = None
            for start, cost, edits, roles in steps[to]:
                if start not in self.ends:
                    continue
                total, node = self.ends[start][0] + cost, self.ends[start][1]
                if best is None or total < best[0] or (total == best[0] and self._before(node, edits, best)):
                    best = (total, node, edits, roles)
            if best:
                ends[to] = best
        # A survivor that another one outdoes whatever follows is no survivor, else nothing would ever be settled.
        ends = {to: (best[0], Node(best[1], best[2], best[3])) for to, best in ends.items()
                if all(ends[s][0] + BRIDGE[s, to] >= best[0] for s in ends if s != to)}
        for _, node in ends.values():
            node.uses += 1
        for _, node in self.ends.values():
            self._release(node)
        self.ends = ends
        return self._settled()

    @staticmethod
    def _before(node: Node, edits: str, best: tuple) -> bool:
        ours, theirs = unresolved(node, best[1])
        return ours + edits < theirs + best[2]

    @staticmethod
    def _release(node: Node | None) -> None:
        while node is not None:
            node.uses -= 1
            if node.uses:
                return
            node = node.parent

    def _settled(self) -> list[tuple[str, str]]:
        """Move the root to the last common ancestor of the survivors; the edits on the way are settled.

        The newest turn stays open, since turns that close the conversation may follow it.
        """
        if self.root.uses != 1:
            return []
        way = []
        node = next(iter(self.ends.values()))[1]
        while node is not self.root:
            way.append(node)
            node = node.parent
        out = []
        while len(way) > 1 and self.root.uses == 1:
            self.root = way.pop()
            self.root.parent = None
            out.append((self.root.edits, self.root.roles))
        return out

    def order(self) -> list[int]:
        """The states that survivors end in, by their edits as text."""
        ways = {}
        for state, (_, node) in self.ends.items():
            way = []
            while node is not self.root:
                way.append(node.edits)
                node = node.parent
            ways[state] = "".join(reversed(way))
        return sorted(ways, key=ways.get)

    def closed(self) -> int:
        """The state to end in: the cheapest one when closed; of equals, that of the first edits."""
        return min(self.order(), key=lambda s: self.ends[s][0] + INSERT * len(CLOSING[s]))

    def rest(self, state: int) -> list[tuple[str, str]]:
        """The unsettled edits of the survivor in ``state``."""
        out, node = [], self.ends[state][1]
        while node is not self.root:
            out.append((node.edits, node.roles))
            node = node.parent
        return out[::-1]


class Steps:
    """:func:`moves`, made once per kind of turn."""

    def __init__(self):
        self.made: dict[tuple, list] = {}

    def __call__(self, initial: str, must_go: bool, truncated: bool) -> list:
        kind = (initial if initial in ("s", "u", "a") else "", must_go, truncated and not must_go)
        if kind not in self.made:
            self.made[kind] = moves(*kind)
        return self.made[kind]


def turns_of(initial, blank, again, truncated, count, steps):
    """The steps of a run of ``count`` equal turns: all but the first repeat it."""
    yield steps(initial, blank or again, truncated)
    for _ in range(count - 1):
        yield steps(initial, True, False)


def summarise(table: pa.Table) -> pa.Table:
    """One chunk of a divided conversation: costs between states and the order of the survivors of each start."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("place", "initial", "blank", "again", "truncated", "n"))))
    steps, costs, ranks = Steps(), [], []
    for start in STATES:
        search = Search(start)
        for _, *run in rows:
            for step in turns_of(*run, steps):
                search.add(step)
        order = search.order()
        costs += [search.ends[s][0] if s in search.ends else FAR for s in STATES]
        ranks += [order.index(s) if s in order else len(order) for s in STATES]
    first = table.slice(0, 1)
    return pa.table({"conv": first["conv"], "part": first["part"], "costs": pa.array([costs], pa.list_(pa.int64())),
                     "ranks": pa.array([ranks], pa.list_(pa.int64())), "last_initial": pa.array([rows[-1][1]], pa.string())})


def chain(chunks: pd.DataFrame) -> pd.DataFrame:
    """The states in which each chunk of one conversation begins and ends."""
    chunks = chunks.sort_values("part")
    cost, rank, back = {0: 0}, {0: 0}, []
    for costs, ranks in zip(chunks["costs"], chunks["ranks"]):
        best = {}
        for to in STATES:
            found = [(cost[s] + int(costs[4 * s + to]), rank[s], s) for s in cost if costs[4 * s + to] < FAR]
            if found:
                best[to] = min(found)
        back.append({to: s for to, (_, _, s) in best.items()})
        order = sorted(best, key=lambda to: (best[to][1], int(ranks[4 * best[to][2] + to])))
        cost, rank = {to: best[to][0] for to in best}, {to: order.index(to) for to in best}
    state = min(cost, key=lambda s: (cost[s] + INSERT * len(CLOSING[s]), rank[s]))
    begins, ends = [], []
    for came in reversed(back):
        ends.append(state)
        state = came[state]
        begins.append(state)
    last = [None, *chunks["last_initial"][:-1]]
    return pd.DataFrame({"conv": chunks["conv"], "part": chunks["part"], "begins": begins[::-1], "ends": ends[::-1],
                         "before": last, "closes": [False] * (len(chunks) - 1) + [True]})


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


EDITED = ("conv string, turn long, role string, h string, place long, edits string, roles string, cost long, "
          "illegal long, blank long, duplicate long, truncated long")
_CARRIED = ("conv", "turn", "role", "h", "place")
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]


def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of every run of turns, in order of place within parts; only unresolved turns are held."""
    steps, names = Steps(), [field.split()[0] for field in EDITED.split(", ")]
    waiting: deque = deque()
    done: list[tuple] = []
    search, here, plan, last = Search(), None, None, None

    def settle(edits: str, roles: str) -> None:
        run = waiting[0]
        run["edits"].append(edits)
        run["roles"].append(roles)
        run["open"] -= 1
        if not run["open"]:
            finish(waiting.popleft())

    def finish(run: dict) -> None:
        edits = "".join(run["edits"])
        stays = "K" in edits or "R" in edits
        cost = INSERT * edits.count("I") + REROLE * edits.count("R") + DELETE * edits.count("D")
        cost += TRUNCATED if run["faults"][3] and stays else 0
        done.append((*run["row"], edits, "".join(run["roles"]), cost, *run["faults"]))

    def close() -> None:
        if here is None:
            return
        state = search.closed() if plan[1] is None else plan[1]
        rest = search.rest(state)
        if plan[2]:
            end = CLOSING[state]
            rest[-1] = (rest[-1][0] + "I" * len(end), rest[-1][1] + end)
        for found in rest:
            settle(*found)

    def ready() -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[]] * len(_TYPES)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)

    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        for i in range(batch.num_rows):
            key = (columns["part"][i], columns["conv"][i])
            if key != here:
                close()
                here = key
                divided = columns["begins"][i] is not None
                plan = (columns["begins"][i], columns["ends"][i], columns["closes"][i]) if divided else (0, None, True)
                search, last = Search(plan[0]), columns["before"][i]
            initial, blank, again = columns["initial"][i], columns["blank"][i], columns["again"][i]
            truncated, count = columns["truncated"][i], columns["n"][i]
            illegal = int(last is not None and not legal(last, initial)) + (count - 1) * (not legal(initial, initial))
            last = initial
            faults = (illegal, count if blank else 0, 0 if blank else count - (not again),
                      int(truncated and not blank and not again))
            waiting.append({"row": [columns[c][i] for c in _CARRIED], "open": count, "edits": [], "roles": [],
                            "faults": faults})
            for step in turns_of(initial, blank, again, truncated, count, steps):
                for found in search.add(step):
                    settle(*found)
        yield ready()
    close()
    yield ready()


def runs_of(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """Equal turns counted, with what the search needs to know of them; counted before anything is shuffled."""
    rows = bounded(df).select(
        F.col(conv).cast("string").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        (F.col(copies) if copies else F.lit(1)).cast("long").alias("n"))
    bare = F.rtrim("text", F.lit(SPACE))
    return materialise(rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumns({
        "h": F.md5(F.col("text").cast("binary")), "initial": F.substring("role", 1, 1), "blank": bare == "",
        "truncated": (bare != "") & ~F.right(bare, F.lit(1)).isin(*STOPS)}), "runs")


def ordered(runs: DataFrame) -> DataFrame:
    """The turns without their texts, in order, each with its place, the part of its place, and whether it repeats."""
    turns = runs.filter("n > 0").drop("text")
    at = F.struct("turn")
    seen = turns.groupBy("conv", "role", "h").agg(F.min(at).alias("first"), F.max(at).alias("last")) \
        .filter("first <> last").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h").alias("k"), "first")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k"))
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    order = ["conv", "turn", "role", "h"]
    lined = turns.join(seen, same, "left").withColumn("again", again).drop("c", "r", "k", "first") \
        .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return materialise(lined.withColumn("part", F.shiftright("place", 33)), "turns")


def edits_of(lined: DataFrame) -> DataFrame:
    """``EDITED`` rows: per run of equal turns its edits, one initial each, and the roles of what they leave."""
    # Each border between parts divides one conversation at most, so these tables are no longer than the parts.
    divided = lined.groupBy("conv").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi") \
        .select(F.col("conv").alias("c"))
    pieces = lined.join(divided, F.col("conv").eqNullSafe(F.col("c")), "left_semi") \
        .select("conv", "part", "place", "initial", "blank", "again", "truncated", "n")
    summaries = pieces.groupBy("conv", "part").applyInArrow(
        summarise, "conv string, part long, costs array<long>, ranks array<long>, last_initial string")
    plans = materialise(summaries.groupBy("conv").applyInPandas(
        chain, "conv string, part long, begins int, ends int, before string, closes boolean"), "plans")
    planned = plans.withColumnsRenamed({"conv": "c", "part": "p"})
    here = F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    return materialise(lined.join(planned, here, "left").drop("c", "p").repartition("part")
                       .sortWithinPartitions("part", "place").mapInArrow(edit, EDITED), "edits")


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", copies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per run of equal turns with its edits, text and faults; ids of conversations without turns).

    The columns of the first are those of ``EDITED`` and text, which is null where the turn goes: conv as text,
    place (its order), edits (an initial each), roles (as long as edits: a role's initial, ``=`` for the turn's own
    role, ``-`` for none), cost, illegal (neighbours that break the pattern, counted at the later turn), and the
    turns whose first fault is blank, duplicate or truncated. The second has one column, conv.
    """
    runs = runs_of(df, conv, turn, role, text, copies)
    edits = edits_of(ordered(runs))
    texts = runs.filter("n > 0").select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"),
                                        F.col("h").alias("k"), "text")
    same = (F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
            & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k")) & F.col("edits").rlike("[KR]"))
    none = runs.groupBy("conv").agg(F.sum("n").alias("n")).filter("n = 0").select("conv")
    return edits.join(texts, same, "left").drop("c", "t", "r", "k", "h"), none


def repaired_turns(edited: DataFrame) -> DataFrame:
    """``conv, place, step, edit, role, text``: the turns of the repaired conversations, in order of place and step."""
    at = F.posexplode(F.split("edits", "(?!$)")).alias("step", "edit")
    turns = edited.select("conv", "place", "role", "roles", "text", at).filter("edit <> 'D'")
    name = F.substring("roles", F.col("step") + 1, F.lit(1))
    names = F.when(name == "=", F.col("role")).when(name == "u", NAMES["u"]).otherwise(NAMES["a"])
    return turns.select("conv", "place", "step", "edit", names.alias("role"),
                        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
