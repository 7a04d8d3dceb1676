"""Chat formatting of reply trees: root-to-leaf paths by self-joins, branches ranked by score, each chosen path as one conversation under a reversible template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamworks.llm.shared import materialize, release
from loamworks.operators.relational import top_per_key
from loamworks.operators.sequences import before_in_blocks

#: Turns of a part: a conversation of more is formatted in parts, so that no task holds all of a very long one.
PART_TURNS = 256
#: Turns of a block when rows are linked into chains.
CHAIN_TURNS = 1024


@dataclass(frozen=True)
class Template:
    """How a turn is written: before, role, middle, text, after. Within roles and texts, ``control`` strings are broken up after their first character, reversibly."""

    before: str = "<|turn|>"
    middle: str = "\n"
    after: str = "<|end|>\n"
    control: tuple[str, ...] = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: str = "assistant"

    def escape(self, c: Column) -> Column:
        r"""``\`` becomes ``\\``, and a control string gets ``\.`` after its first character, overlapping ones too."""
        heads = "|".join(f"{re.escape(s[0])}(?={re.escape(s[1:])})" for s in self.control)
        return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), heads, r"$0\\.")

    def escape_role(self, c: Column) -> Column:
        r"""``escape``, and a line feed becomes ``\n``: a role ends at ``middle``."""
        return F.replace(self.escape(c), F.lit("\n"), F.lit("\\n"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: {"\\": "\\", "n": "\n"}.get(m[1], ""), text)

    def read_back(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of the turns of a formatted part."""
        out = []
        for turn in formatted.split(self.after)[:-1]:
            role, text = turn.removeprefix(self.before).split(self.middle, 1)
            out.append((self.unescape(role), self.unescape(text)))
        return out


TEMPLATE = Template()


def chains(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(tree, node, parent, role, text): conversations of rows by turn as reply trees without branches, each message the reply to the one before.

    Rows of one turn go by role, then text; null turns come last. Rows with a null conversation are one conversation.
    """
    told = rows.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    told = materialize(told.withColumn("node", F.monotonically_increasing_id()))
    keyed = told.withColumns({"_null": F.col("tree").isNull(), "_tree": F.coalesce("tree", F.lit(0)), "_late": F.col("turn").isNull()})
    block = F.coalesce(F.floor(F.col("turn") / CHAIN_TURNS), F.lit((1 << 62)))
    linked = before_in_blocks(keyed.select("_null", "_tree", "_late", "turn", "role", F.md5("text").alias("own"), "text", "node", "tree"), "node", ["_null", "_tree"], block, ["_late", "turn", "role", "text", "node"], "parent")
    return linked.select("tree", "node", "parent", "role", "text")


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, depth, total) of every node that a root leads to, depth from 1 and total the scores from the root on; and the ancestors (node, to) 1, 2, 4, ... steps up.

    Each round joins the table with itself on where its nodes have got to, so depths up to 2^r take r rounds, however long the paths.
    """
    first = materialize(nodes.select("node", F.col("parent").alias("to"), F.lit(1).cast("bigint").alias("depth"), F.col("score").alias("total")))
    # only what hasn't reached a root is carried on
    count, ended, now, levels = first.count(), first.filter("to IS NULL"), first.filter("to IS NOT NULL"), []
    while (1 << len(levels)) <= count and not now.isEmpty():
        levels.append(now.select("node", "to"))
        above = ended.unionByName(now).select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        joined = now.join(above, "to")
        after = materialize(joined.select("node", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total")))
        ended, now = ended.unionByName(after.filter("to IS NULL")), after.filter("to IS NOT NULL")
    # what still has somewhere to go after more steps than there are nodes hangs on a circle
    return ended.select("node", "depth", "total"), levels


def branch_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, branch, rank bigint, score double, at bigint, node): the messages of the chosen root-to-leaf paths, ``at`` from 1 at the root.

    messages: tree, node (unique, bigint), parent (null at a root), score (double). A branch is named by its leaf; its score is the mean of its messages'. Of each
    tree, the ``branches`` with the highest scores are taken, equal ones by smaller leaf; None takes all. A message whose parent isn't among the messages is a
    root; messages on or under a circle of replies are on no path. Null scores count as 0. No rows give no rows.
    """
    known = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    there = known.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    nodes = materialize(known.join(there, "parent", "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), "score"))
    ends, levels = _climb(nodes)
    parents = nodes.select(F.col("parent").alias("node")).filter("node IS NOT NULL").distinct()
    leaves = nodes.select("tree", "node").join(parents, "node", "left_anti").join(ends, "node")
    leaves = leaves.select("tree", F.col("node").alias("branch"), "depth", (F.col("total") / F.col("depth")).alias("score"))
    order = [F.desc("score"), F.col("branch")]
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order)).cast("bigint")) if branches is None else top_per_key(leaves, ["tree"], order, branches, "rank")
    paths = materialize(ranked.select("tree", "branch", "rank", "score", F.col("depth").alias("at"), F.col("branch").alias("node")))
    # a message d steps above the leaf is met once: by the powers of two in d, the largest first
    for k in reversed(range(len(levels))):
        up = paths.join(levels[k], "node").select("tree", "branch", "rank", "score", (F.col("at") - (1 << k)).alias("at"), F.col("to").alias("node"))
        before, paths = paths, materialize(paths.unionByName(up))
        release(before)
    return paths


def format_trees(messages: DataFrame, branches: int | None = 1, template: Template = TEMPLATE, part_turns: int = PART_TURNS) -> DataFrame:
    """(tree, branch, rank, score, part bigint, n_turns bigint, formatted, spans array<struct<start, end: bigint>>) for the chosen paths of all reply trees.

    messages: tree, node (unique, bigint), parent, role, text, score; other columns are not read. See ``branch_paths`` for what is chosen. Null roles and texts are
    empty ones. A path of up to ``part_turns`` turns is one row; longer ones are several, whose formatted texts by part make up the conversation's. Spans are
    the loss mask of the part: places of code points, from start up to before end, of the texts of ``template.learned`` turns, as they stand there. No rows give no rows.
    """
    paths = branch_paths(messages, branches)
    said = messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(template.before), template.escape_role(F.col("role")), F.lit(template.middle))
    turns = paths.join(said, "node").withColumns({"part": F.floor((F.col("at") - 1) / part_turns), "learned": F.col("role") == template.learned, "head": head, "body": template.escape(F.col("text"))})
    turns = turns.withColumn("size", (F.char_length("head") + F.char_length("body") + len(template.after)).cast("bigint"))
    earlier = Window.partitionBy("branch", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.char_length("head")
    placed = turns.select("tree", "branch", "rank", "score", "part", "at", F.concat("head", "body", F.lit(template.after)).alias("turn"), start.alias("start"), (start + F.char_length("body")).alias("end"), "learned")
    # a part has part_turns turns at most
    grouped = placed.groupBy("branch", "part").agg(
        F.first("tree").alias("tree"), F.first("rank").alias("rank"), F.first("score").alias("score"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("at", "turn"))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("learned"), F.struct("start", "end")))).alias("spans"),
    )
    return grouped.select("tree", "branch", "rank", "score", "part", "n_turns", F.array_join(F.col("turns")["turn"], "").alias("formatted"), "spans")


def digests(formatted: DataFrame, template: Template = TEMPLATE, name: str = "tree") -> DataFrame:
    """(name, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) for each branch, read back from its formatted parts and masks, a part after the other."""
    kind = formatted.schema["tree"].dataType.simpleString()
    ordered = formatted.select("branch", "part", "tree", "formatted", "spans").repartition("branch").sortWithinPartitions("branch", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch, told, done = None, None, []

        def result() -> None:
            if told:
                done.append((told[0], told[1], told[2].hexdigest(), told[3], told[4].hexdigest(), told[5]))

        for batch in batches:
            tree_type = batch.schema.field(2).type
            for b, _, tree, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                if b != branch:
                    result()
                    branch, told = b, [tree, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = template.read_back(text)
                told[1] += len(turns)
                told[2].update("".join(f"{role}\n{said}\n" for role, said in turns).encode("utf-8", "surrogatepass"))
                learned = "".join(template.unescape(text[s["start"] : s["end"]]) for s in spans)
                told[3] += len(learned)
                told[4].update(learned.encode("utf-8", "surrogatepass"))
                told[5] += len(text)
        result()
        if done:
            kinds = (tree_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=[name, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return ordered.mapInArrow(run, f"`{name}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
