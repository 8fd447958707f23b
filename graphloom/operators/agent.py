"""State machines: steps over a state, checkpoints per thread, interrupts and histories."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "end"
CHECKPOINT = "thread_id string, step int, node string, state string"


@dataclass
class Interrupt(Exception):
    """Raised by a node that waits for somebody's answer."""

    question: str


@dataclass
class Machine:
    """Nodes change parts of a state; routes name the next node. Runs end at END, at an interrupt, or after ``max_steps``."""

    start: str
    nodes: dict[str, Callable[[dict], dict]]
    routes: dict[str, str | Callable[[dict], str]]
    max_steps: int = 100
    checkpoints: list[tuple[str, int, str, str]] = field(default_factory=list)

    def run(self, thread: str, state: dict, at: str | None = None, step: int = 0) -> Iterator[tuple[str, dict]]:
        """(node, state) after each step, kept as checkpoints."""
        node = at or self.start
        for n in range(step, step + self.max_steps):
            if node == END:
                return
            try:
                state = state | self.nodes[node](state)
            except Interrupt as wait:
                self.checkpoints.append((thread, n, node, json.dumps(state | {"waiting": wait.question})))
                return
            self.checkpoints.append((thread, n, node, json.dumps(state)))
            yield node, state
            way = self.routes[node]
            node = way(state) if callable(way) else way

    def resume(self, thread: str, answer: dict) -> Iterator[tuple[str, dict]]:
        """Go on from the last checkpoint of a thread with an answer in the state."""
        last = max((c for c in self.checkpoints if c[0] == thread), key=lambda c: c[1])
        state = json.loads(last[3])
        waiting = state.pop("waiting", None)
        way = self.routes[last[2]]
        node = last[2] if waiting is not None else way(state) if callable(way) else way
        return self.run(thread, state | answer, node, last[1] + (0 if waiting is not None else 1))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.checkpoints, CHECKPOINT)


def stops(complete: bool, round_: int, max_rounds: int, new_facts: int) -> bool:
    """Whether an interview is over: complete, out of rounds, or nothing new in a later round."""
    return complete or round_ >= max_rounds or (round_ > 0 and new_facts == 0)


def history(states: DataFrame) -> DataFrame:
    """One row per (thread_id, step), its repeated deliveries aside, with the number of later steps."""
    one = states.groupBy("thread_id", "step").agg(F.min("node").alias("node"), F.min("state").alias("state"))
    w = Window.partitionBy("thread_id").orderBy(F.desc("step"))
    return one.withColumn("later", (F.row_number().over(w) - 1).cast("int"))


def transitions(states: DataFrame) -> DataFrame:
    """(thread_id, step, node, previous_node, gap): consecutive states of a thread, oldest first."""
    one = states.groupBy("thread_id", "step").agg(F.min("node").alias("node"))
    w = Window.partitionBy("thread_id").orderBy("step")
    return one.select("thread_id", "step", "node", F.lag("node").over(w).alias("previous_node"), (F.col("step") - F.lag("step").over(w)).cast("int").alias("gap"))


def lookup(keys: DataFrame, table: DataFrame, key: str, value: str, missing: str = "not found") -> DataFrame:
    """A key-value tool: the value of each key, or a note that there is none."""
    return keys.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def next_gaps(gaps: DataFrame, addressed: DataFrame, each: int = 10) -> DataFrame:
    """The most urgent gaps not yet addressed (rule_id, entity_desc), each description once; a question round takes the first ``each``."""
    from graphloom.ontology import priority_rank

    keys = ["rule_id", "entity_desc"]
    # a gap without a description is addressed by one without
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    left = gaps.alias("g").join(addressed.select(*keys).distinct().alias("a"), same, "left_anti").withColumn("rank", priority_rank(other=3))
    one = left.groupBy("gap_description").agg(F.min(F.struct("rank", "rule_id", "label", "entity_desc", "priority")).alias("best")).select("gap_description", "best.*")
    return one.orderBy("rank", "rule_id", "gap_description").limit(each)


def follow_up(gap: dict, writer: Callable[[str], str] | None = None) -> str:
    """A question about a gap by an injected writer, or a plain one where it has none."""
    plain = f"Can you tell us more? {gap['gap_description']}."
    return (writer(gap["gap_description"]) or plain).strip() if writer else plain


def says_nothing(answer):
    """Whether an answer brings no information."""
    return F.lower(F.trim(F.coalesce(answer, F.lit("")))).rlike(r"^(?:|i )?(?:do(?:es)? ?n[o']t know|don't know|dont know|no idea|not sure|unknown|n/?a|none|no|skip)?[.!]*$")


def normalised_label(label, known: tuple[str, ...], default: str):
    """A classifier's label without case and blanks, the default where it is none of the known ones."""
    plain = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(plain.isin(*known), plain).otherwise(default)


def transcript(states: DataFrame) -> DataFrame:
    """(thread_id, step, line): the questions and answers of interviews as lines."""
    s = states.select("thread_id", "step", F.from_json("state", "questions array<struct<question:string>>, user_answers array<string>").alias("s"))
    both = F.arrays_zip(F.transform("s.questions", lambda q: q["question"]).alias("q"), F.col("s.user_answers").alias("a"))
    return s.select("thread_id", "step", F.explode(both).alias("p")).select("thread_id", "step", F.concat(F.lit("Q: "), F.coalesce("p.q", F.lit("")), F.lit("\nA: "), F.coalesce("p.a", F.lit(""))).alias("line"))
