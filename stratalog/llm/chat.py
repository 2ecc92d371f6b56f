"""Conversations from reply trees.

Messages form trees by their parents. Paths from a root are enumerated by self-joins that double their reach each round:
after round k a message knows its ancestor 2^k replies up and the score of the stretch between, so a tree of depth d takes
log d rounds of one join and one table each. Each leaf ends a branch; branches rank by score, and the chosen branch is marked by walking the same
doubled links back down. Only then are the texts fetched and each chosen path formatted as one conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import done_with, materialise, text_of

#: The template: each turn is HEAD, role, ": ", text, TAIL, line end.
HEAD, TAIL = "### ", " </turn>"
#: Messages to a file of the tables of links, which are numbers only.
FILE_ROWS = 50_000

_ESCAPE = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPED = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
_PLAIN = {v[1]: k for k, v in _ESCAPED.items()}
_ROLE = re.compile(r"[\\#<:\n]")
_TURN = re.compile(r"### ([^:]*): (.*?) </turn>\n", re.S)


def escape(text: str) -> str:
    """Without the control strings "###" and "</turn>"; `unescape` gives the text back."""
    return _ESCAPE.sub(lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation and its loss mask: (start, end) of each text of the role to learn, in code points."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head = f"{HEAD}{_ROLE.sub(lambda m: _ESCAPED[m[0]], role)}: "
        body = escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{TAIL}\n")
        at += len(out[-1])
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """What `format_turns` was given."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def chosen_paths(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(tree, node, place, branch_score) for the messages of each tree's best branch, place counting from its leaf up.

    nodes: tree, node, parent (bigint), score (double); (tree, node) is unique. A message whose parent is not there is a
    root. Branches rank by the sum of their scores, then by length, then by the smaller leaf. Messages whose parents run
    in a circle belong to no branch and are left out.
    """
    written = hasattr(nodes, "_stratalog_path")  # no need to write again what can be read again
    nodes = nodes.select("tree", "node", "parent", "score")
    if not written:
        nodes = materialise(nodes, "nodes")
    files = -(-nodes.count() // FILE_ROWS)  # a table has a row a message at most
    there = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    linked = nodes.join(there, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n")), "left")
    # a round's table says of each message what message its stretch ends before (null: it reaches the root), and the stretch's score and length
    reach = [materialise(linked.select("tree", "node", F.col("n").alias("up"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("length")), "reach", files)]
    still_open = _open(reach[0]).count()
    while still_open:
        if len(reach) > rounds:
            raise RuntimeError(f"trees deeper than 2^{rounds}")
        last = reach[-1]
        far = last.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("far"), F.col("total").alias("more"), F.col("length").alias("longer"))
        doubled = _open(last).join(far, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")))
        grown = doubled.select("tree", "node", F.col("far").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("longer")).alias("length"))
        reach.append(materialise(grown.unionByName(last.filter("up IS NULL")), "reach", files))
        now_open = _open(reach[-1]).count()
        if now_open == still_open:
            break  # of what a tree has open, the uppermost half always ends, so only circles are left
        still_open = now_open
    parents = nodes.select("tree", F.col("parent").alias("node")).distinct()
    leaves = reach[-1].filter("up IS NULL").join(parents, ["tree", "node"], "left_anti")
    best = leaves.groupBy("tree").agg(F.max(F.struct("total", "length", (-F.col("node")).alias("last"))).alias("b"))
    path = materialise(best.select("tree", (-F.col("b.last")).alias("node"), F.lit(0).cast("bigint").alias("place"), F.col("b.total").alias("branch_score")), "path", files)
    for k in reversed(range(len(reach))):
        step = _open(reach[k]).select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = path.join(step, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", F.col("up").alias("node"), (F.col("place") + (1 << k)).alias("place"), "branch_score")
        longer, shorter = materialise(path.unionByName(more), "path", files), path
        path = longer
        done_with(shorter)
        done_with(reach[k])
    done_with(nodes)
    return path


def _open(reach: DataFrame) -> DataFrame:
    return reach.filter("up IS NOT NULL")


def reply_chains(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations by turn as reply trees: each message answers the one before it. tree, node, parent, score, role, text.

    Messages number by turn (null turns first), role and text; of repeated turns each answers the one before. Rows with a
    null conversation id belong to none and are left out; null roles and texts are empty.
    """
    rows = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("tree"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    n = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("bigint")
    rows = rows.withColumn("node", n)
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_conversations(nodes: DataFrame, learn: str = "assistant") -> DataFrame:
    """(tree, formatted, loss_spans, n_turns, branch_score) for each tree of nodes (tree, node, parent, score, role, text): its best branch as one conversation. Loss spans are (start, end) in code points.

    (tree, node) is unique, as it is in what `reply_chains` gives; ties between branches go by length, then by the smaller
    leaf. Messages in a circle are in no branch, and a tree of nothing else gives no row. An empty table gives an empty one.
    Other columns are not read. A conversation's turns meet in one task, since it is one row of the output.
    """
    nodes = materialise(nodes, "messages")
    path = chosen_paths(nodes)
    turns = path.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
    whole = turns.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct((-F.col("place")).alias("p"), "role", "text"))).alias("turns"), F.first("branch_score").alias("branch_score"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [format_turns([(x["role"], x["text"]) for x in t], learn) for t in b["turns"]]
            yield pd.DataFrame(
                {"tree": b["tree"], "formatted": [m[0] for m in made], "loss_spans": [[{"start": s, "end": e} for s, e in m[1]] for m in made], "n_turns": [len(t) for t in b["turns"]], "branch_score": b["branch_score"]}
            )

    return whole.mapInPandas(work, "tree long, formatted string, loss_spans array<struct<start:long,end:long>>, n_turns long, branch_score double")


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted conversations hold, read back from them, a row each; an empty table gives none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for b in batches:
            rows = []
            for tree, text, spans in zip(b["tree"], b["formatted"], b["loss_spans"], strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((tree, len(turns), sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), len(loss), sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            yield pd.DataFrame(rows, columns=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInPandas(work, f"{id_col} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
