"""Moves and refinement of communities by tasks that run together (``together``).

The rounds are those of ``graph._local_moves`` and ``graph._refined``: each task finds the best moves of its own nodes
and tells the others; all tasks hold the community and the part of every node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homologrid.operators.ordering import dense_codes
from homologrid.operators.together import Exchange, edges, hash_of_int, ids, numbers, run_together
from homologrid.staging import StageArea


def rounded(values: np.ndarray) -> np.ndarray:
    """To 12 digits; larger values have no more."""
    return np.where(np.abs(values) < 4096, np.rint(values * 1e12) / 1e12, values)


def _sums(node: np.ndarray, group: np.ndarray, amount: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum per node and group, in their order."""
    key = node * width + group
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    return key[starts] // width, key[starts] % width, np.add.reduceat(amount[order], starts) if len(starts) else np.empty(0)


def _best(node: np.ndarray, group: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Places of the largest gain of every node, ties to the larger group."""
    order = np.lexsort((group, gain, node))
    return order[np.r_[node[order][1:] != node[order][:-1], True][: len(order)]]


def _apart(moves: np.ndarray) -> np.ndarray:
    """Of ``node, now, new, more`` those that gain most in both of their communities; ties go to the larger node."""
    if not len(moves):
        return moves
    node, community = np.tile(moves[:, 0], 2), np.concatenate([moves[:, 1], moves[:, 2]])
    first = _best(community, node, np.tile(moves[:, 3], 2))
    won = np.bincount(first % len(moves), minlength=len(moves))
    return moves[won == 2]


class _Nodes:
    """The nodes of a task with their edges, and what is known of all nodes."""

    def __init__(self, columns: dict, exchange: Exchange, width: int, scale: float):
        self.exchange, self.width, self.scale = exchange, width, scale
        self.codes, self.hashes = (numbers(columns[c], np.int64) for c in ("code", "hash"))
        self.row, self.other, self.weight = edges(columns["others"], columns["weights"])
        got = exchange.share(
            np.column_stack([self.codes, numbers(columns["label"]), numbers(columns["strength"])])
        )
        self.every = got[:, 0].astype(np.int64)
        self.community = np.zeros(width, np.int64)
        self.community[self.every] = got[:, 1].astype(np.int64)
        self.strength = np.zeros(width)
        self.strength[self.every] = got[:, 2]
        # Sums over all nodes go by code, whatever task holds them.
        self.every = np.sort(self.every)

    def coin(self, number: int) -> np.ndarray:
        return hash_of_int(self.hashes, number) & 1

    def move(self, guard: int, patience: int) -> None:
        """``graph._local_moves``."""
        quiet = 0
        pair, least, restless, alone = 0, None, 0, False
        own = np.arange(len(self.codes))
        for number in range(guard):
            volume = np.bincount(self.community[self.every], self.strength[self.every], self.width)
            moving = np.ones(len(own), bool) if alone else self.coin(number // 2) == number % 2
            linked = moving[self.row]
            now = self.community[self.codes]
            node, group, link = _sums(
                np.concatenate([self.row[linked], own[moving]]),
                np.concatenate([self.community[self.other[linked]], now[moving]]),
                np.concatenate([self.weight[linked], np.zeros(int(moving.sum()))]),
                self.width,
            )
            strength = self.strength[self.codes][node]
            stays = group == now[node]
            gain = rounded(link - self.scale * strength * (volume[group] - np.where(stays, strength, 0.0)))
            stay = np.zeros(len(own))
            stay[node[stays]] = gain[stays]
            best = _best(node, group, gain)
            best = best[gain[best] > stay[node[best]] + 1e-12]
            who = node[best]
            moves = self.exchange.share(
                np.column_stack([self.codes[who], now[who], group[best], gain[best] - stay[who]])
            )
            if alone:
                moves = _apart(moves)
            self.community[moves[:, 0].astype(np.int64)] = moves[:, 2].astype(np.int64)
            moved = len(moves)
            quiet = quiet + 1 if moved == 0 else 0
            if quiet == (1 if alone else 2):
                return
            pair += moved
            if not alone and number % 2:
                restless = 0 if least is None or pair < least else restless + 1
                least = pair if least is None else min(least, pair)
                pair, alone = 0, restless == patience
                quiet = 0 if alone else quiet
        raise RuntimeError(f"nodes still moved after {guard} rounds")

    def refine(self, guard: int) -> np.ndarray:
        """``graph._refined``: the part of every node of this task."""
        inner = self.community[self.codes[self.row]] == self.community[self.other]
        row, other, weight = self.row[inner], self.other[inner], self.weight[inner]
        part = np.arange(self.width)
        hashes = np.zeros(self.width, np.int64)
        got = self.exchange.share(np.column_stack([self.codes, self.hashes >> 32, self.hashes & 0xFFFFFFFF]))
        hashes[got[:, 0].astype(np.int64)] = (got[:, 1].astype(np.int64) << 32) | got[:, 2].astype(np.int64)
        for number in range(guard):
            volume = np.bincount(part[self.every], self.strength[self.every], self.width)
            members = np.bincount(part[self.every], minlength=self.width)
            lone = members[part] == 1
            turn = (hash_of_int(hashes, 1000 + number) & 1) == 0
            still = ~(lone & turn)
            moving = lone[self.codes][row]
            node, group, link = _sums(row[moving], part[other[moving]], weight[moving], self.width)
            # A part in which a lone node takes its turn is that node.
            rests = still[group] | (members[group] > 1)
            gain = rounded(link - self.scale * self.strength[self.codes][node] * volume[group])
            wanted = gain > 0
            wishes = len(np.unique(node[wanted]))
            open_ = wanted & rests & turn[self.codes][node]
            node, group, gain = node[open_], group[open_], gain[open_]
            best = _best(node, group, gain)
            told = self.exchange.share(
                np.concatenate([[[-1.0, wishes]], np.column_stack([self.codes[node[best]], group[best]])])
            )
            moves = told[told[:, 0] >= 0].astype(np.int64)
            part[moves[:, 0]] = moves[:, 1]
            if not told[told[:, 0] < 0, 1].sum():
                return part[self.codes]
        raise RuntimeError(f"lone nodes still moved after {guard} rounds")


def settled(
    area: StageArea, graph: DataFrame, nodes: DataFrame, scale: float, tasks: int, guard: int, patience: int
) -> DataFrame:
    """Written ``node, strength, community, part`` after the moves and the refinement of a level.

    Nodes (``node, strength, community``) are neither null nor repeated; ``scale`` is the resolution over the total weight.
    """
    kind = nodes.schema["node"].dataType.simpleString()
    # Codes go up with the ids, so ties fall as they do between ids.
    names = nodes.select(F.explode(F.array("node", "community")).alias("node"))
    codes = area.write(dense_codes(names, "node"), "codes")
    width = codes.count()
    ends = (
        graph.where(F.col("src") != F.col("dst"))
        .join(codes.select(F.col("node").alias("dst"), F.col("code").alias("other")), "dst")
        .groupBy(F.col("src").alias("node"))
        .agg(F.sort_array(F.collect_list(F.struct("other", "w"))).alias("links"))
    )
    rows = (
        nodes.join(codes, "node")
        .join(codes.select(F.col("node").alias("community"), F.col("code").alias("label")), "community")
        .join(ends, "node", "left")
        .select(
            "node", "strength", "code", "label", F.xxhash64("node").alias("hash"),
            F.col("links.other").alias("others"), F.col("links.w").alias("weights"),
        )
    )

    def work(columns: dict, exchange: Exchange) -> pa.RecordBatch:
        held = _Nodes(columns, exchange, width, scale)
        held.move(guard, patience)
        part = held.refine(guard)
        return pa.RecordBatch.from_arrays(
            [ids(columns["node"]), pa.array(numbers(columns["strength"])), pa.array(held.community[held.codes]), pa.array(part)],
            names=["node", "strength", "label", "into"],
        )

    schema = f"node {kind}, strength double, label long, into long"
    found = run_together(rows, work, schema, tasks, area, "settled")
    parts = area.write(
        found.join(codes.select(F.col("node").alias("community"), F.col("code").alias("label")), "label")
        .join(codes.select(F.col("node").alias("part"), F.col("code").alias("into")), "into")
        .select("node", "strength", "community", "part"),
        "parts",
    )
    area.forget(found)
    area.forget(codes)
    return parts
