"""Chat formatting with a prefix tree.

Conversations that share their first turns become one sequence: a prefix tree whose nodes are turns, written depth
first, with the text of a shared turn once. Each node carries the position of its first token (its path goes on from
its parent's end), the intervals of the sequence that it may attend to (its ancestors and itself), and the interval
under the loss mask (an assistant's text). Tokens are the characters of the formatted text.

Template: ``<|turn|>`` role ``<|sep|>`` text ``<|end|>``. Inside roles and texts each ``<`` with bars after it gets one
more bar, so no control string can come up in them, and unescaping takes that bar away again.

Conversations are range-partitioned by their first turn and then by their whole path, so those that share turns lie
together; a sequence ends when the first turn changes, or when what follows its first turn has ``window`` tokens, or as
many as that turn if that is longer. A shared turn of any length is thus written once for the conversations that follow
it; a turn that a large part of all conversations share is spread over many sequences and partitions, each of which
holds at least as much that is new, and memory holds one sequence at a time.

Cases: a null role or text is empty; turns are in the order of ``turn`` (nulls first), equal ones by role and text, and
repeated rows are turns of their own; rows without conv_id form the conversation without id; a long text or a long
conversation stays whole in one sequence; an empty table gives no sequences; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SEP, END = "<|turn|>", "<|sep|>", "<|end|>"
BARS, MORE_BARS = re.compile(r"<(\|+)"), re.compile(r"<\|(\|+)")
#: Tokens behind its first turn after which a sequence takes no further conversation.
WINDOW = 32_768

SCHEMA = (
    "sequence_id string, text string, "
    "nodes array<struct<start:int,end:int,position:int,parent:int,loss_start:int,loss_end:int,attends:array<struct<start:int,end:int>>>>, "
    "conversations array<struct<conv_id:long,leaf:int>>"
)
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
NODE = pa.struct([*((x, pa.int32()) for x in ("start", "end", "position", "parent", "loss_start", "loss_end")), ("attends", pa.list_(SPAN))])
LEAF = pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())])


def escape(text: str) -> str:
    return BARS.sub(r"<|\1", text)


def unescape(text: str) -> str:
    return MORE_BARS.sub(r"<\1", text)


def segment(role: str, text: str) -> tuple[str, str]:
    """A turn's text up to its content, and the content with the end mark."""
    return f"{TURN}{escape(role)}{SEP}", f"{escape(text)}{END}"


class PrefixTree:
    """Turns of conversations that are added in sorted order, so that the tree grows depth first."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []
        self.leaves: list[dict] = []

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        shared = 0
        while shared < min(len(self.path), len(turns)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if self.path else {"position": 0, "start": 0, "end": 0, "attends": []}
            head, body = segment(*turn)
            content = self.size + len(head)
            end = content + len(body)
            loss = (content, end - len(END)) if turn[0] == "assistant" else (-1, -1)
            # an ancestor's interval that this node goes on from directly grows by the node
            attends = list(above["attends"])
            if attends and attends[-1]["end"] == self.size:
                attends[-1] = {"start": attends[-1]["start"], "end": end}
            else:
                attends.append({"start": self.size, "end": end})
            self.nodes.append({"start": self.size, "end": end, "position": above["position"] + above["end"] - above["start"], "parent": parent, "loss_start": loss[0], "loss_end": loss[1], "attends": attends})
            self.parts += [head, body]
            self.size = end
            self.path.append((turn, len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv_id, "leaf": self.path[-1][1] if self.path else -1})


def format_conversations(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row per sequence: its text, the tree's nodes in depth-first order, and the last node of each conversation."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    whole = whole.withColumn("root", F.xxhash64(F.col("turns")[0])).withColumn("path", F.transform("turns", lambda t: F.xxhash64(t)))
    whole = whole.repartitionByRange("root", "path", "conv_id").sortWithinPartitions("root", "path", "conv_id")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, root, first = PrefixTree(), None, None

        def done() -> pa.RecordBatch:
            whole_text = "".join(tree.parts)
            name = hashlib.md5(f"{first}:{whole_text}".encode("utf-8", "surrogatepass")).hexdigest()
            columns = [pa.array([name]), pa.array([whole_text]), pa.array([tree.nodes], pa.list_(NODE)), pa.array([tree.leaves], pa.list_(LEAF))]
            return pa.RecordBatch.from_arrays(columns, ["sequence_id", "text", "nodes", "conversations"])

        for batch in batches:
            for row in batch.to_pylist():
                own = [(t["role"], t["text"]) for t in row["turns"]]
                shared = tree.nodes[0]["end"] if tree.nodes else 0
                if tree.leaves and (own[:1] != root or tree.size - shared >= max(window, shared)):
                    yield done()
                    tree = PrefixTree()
                if not tree.leaves:
                    root, first = own[:1], row["conv_id"]
                tree.add(row["conv_id"], own)
        if tree.leaves:
            yield done()

    return whole.select("conv_id", "turns").mapInArrow(over, SCHEMA)


def read_back(sequences: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars) of each conversation, from the formatted text and the nodes alone."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, nodes, out = row["text"], row["nodes"], []
                for leaf in row["conversations"]:
                    at, path = leaf["leaf"], []
                    while at >= 0:
                        path.append(nodes[at])
                        at = nodes[at]["parent"]
                    path.reverse()
                    turns, loss = [], []
                    for n in path:
                        head, _, body = text[n["start"] + len(TURN) : n["end"] - len(END)].partition(SEP)
                        turns.append({"role": unescape(head), "text": unescape(body)})
                        if n["loss_start"] >= 0:
                            loss.append(unescape(text[n["loss_start"] : n["loss_end"]]))
                    out.append((leaf["conv_id"], turns, "".join(loss), sum(n["end"] - n["start"] for n in path)))
                kinds = [pa.int64(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], ["conv_id", "turns", "loss", "formatted_chars"])

    return sequences.mapInArrow(over, "conv_id long, turns array<struct<role:string,text:string>>, loss string, formatted_chars long")


def conversation_digests(read: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what was read back."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
