"""Dependency trees: the root's component of each sentence, in preorder, with cycles cut by childless copies."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


NODE = "sent_id long, node int, parent int, dep string, lemma string, depth int, pre int, up int, terminal boolean"
SCHEMA = pa.schema([("sent_id", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("dep", pa.string()), ("lemma", pa.string()), ("depth", pa.int32()), ("pre", pa.int32()), ("up", pa.int32()), ("terminal", pa.bool_())])

#: Tokens whose trees are built at once, and levels up to which many sentences are gone through together.
AT_ONCE = 100_000
LEVELS = 200


def root(tokens: Column) -> Column:
    """1-based place of the first token that is a root or its own head; null where there is none."""
    at = F.transform(tokens, lambda t, i: F.when((t["dep"] == "root") | (t["head"] == i + 1), i + 1))
    return F.array_min(F.filter(at, lambda x: x.isNotNull()))


def root_error(tokens: Column) -> Column:
    return F.when(root(tokens).isNull(), "No root token found in tokenization")


def preorder(heads: list[int], first: int, dotted: bool = False) -> Iterator[tuple[int, int | None, int, int, int | None, bool, str | None]]:
    """(node, parent, depth, number, parent's number, terminal, path) from the root down, numbered from 0 as they are met.

    As each token has one head, only the root can be met again below itself; that copy has no children. The path is null
    unless it is asked for; only those of nodes whose children are still to come are kept.
    """
    children: dict[int, list[int]] = {}
    for i, h in enumerate(heads, 1):
        if h != i and 0 < h <= len(heads):
            children.setdefault(h, []).append(i)
    stack: list[tuple[int, int | None, int, int | None, bool, str]] = [(first, None, 0, None, False, "")]
    number = 0
    while stack:
        node, parent, depth, up, terminal, above = stack.pop()
        path = f"{above}{node}" if dotted else None
        yield node, parent, depth, number, up, terminal, path
        if not terminal and node in children:
            above = f"{path}." if dotted else ""
            stack += [(c, node, depth + 1, number, c == first, above) for c in reversed(children[node])]
        number += 1


def _levels(heads: np.ndarray, ends: np.ndarray, first: np.ndarray, dotted: bool) -> tuple[dict[str, pa.Array | np.ndarray], np.ndarray]:
    """preorder() of many sentences at once, level by level; and the sentences of more than LEVELS levels, which are left out.

    heads: of one sentence after another, of which each ends before ``ends``; first: their roots, 0 where there is none.
    ``sentence`` and ``token`` are places from 0.
    """
    starts = np.concatenate(([0], ends[:-1]))
    sentence = np.repeat(np.arange(len(ends)), ends - starts)
    local = np.arange(len(heads)) - starts[sentence] + 1
    inner = (heads != local) & (heads > 0) & (heads <= (ends - starts)[sentence])
    head = np.where(inner, starts[sentence] + heads - 1, -1)
    children = np.argsort(head, kind="stable")[len(heads) - inner.sum() :]
    count = np.bincount(head[inner], minlength=len(heads))
    begin = np.cumsum(count) - count
    root = starts + first - 1

    def down(of: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """(tokens, place of the parent in the level above, terminal) of each level, and the sentences that go on."""
        levels = [(root[of], np.zeros(len(of), np.int64), np.zeros(len(of), bool))]
        while len(levels[-1][0]):
            token, _, terminal = levels[-1]
            n = np.where(terminal, 0, count[token])
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            below = children[np.repeat(begin[token], n) + k]
            if len(levels) == LEVELS and len(below):
                return levels, np.unique(sentence[below])
            levels.append((below, np.repeat(np.arange(len(token)), n), below == root[sentence[below]]))
        return levels[:-1] or levels, np.empty(0, np.int64)

    some = np.flatnonzero(first > 0)
    levels, deep = down(some)
    if len(deep):
        some = np.setdiff1d(some, deep)
        levels, _ = down(some)
    sizes = [np.ones(len(token), np.int64) for token, _, _ in levels]
    for d in range(len(levels) - 1, 0, -1):
        sizes[d - 1] += np.bincount(levels[d][1], weights=sizes[d], minlength=len(sizes[d - 1])).astype(np.int64)
    numbers, out = [np.zeros(len(some), np.int64)], {"up": [np.full(len(some), -1)], "parent": [np.zeros(len(some), np.int64)]}
    paths = [pc.cast(pa.array(local[levels[0][0]]), pa.string())] if dotted else []
    for d in range(1, len(levels)):
        token, up, _ = levels[d]
        before = np.cumsum(sizes[d]) - sizes[d]
        opens = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))  # siblings stand together
        eldest = np.repeat(before[opens], np.diff(np.append(opens, len(up))))
        numbers.append(numbers[d - 1][up] + 1 + before - eldest)
        out["up"].append(numbers[d - 1][up])
        out["parent"].append(local[levels[d - 1][0]][up])
        if dotted:
            paths.append(pc.binary_join_element_wise(paths[-1].take(pa.array(up)), pc.cast(pa.array(local[token]), pa.string()), "."))
    token, pre = np.concatenate([x[0] for x in levels]), np.concatenate(numbers)
    whole = np.zeros(len(ends), np.int64)
    whole[some] = sizes[0]
    order = np.empty(len(token), np.int64)
    order[(np.cumsum(whole) - whole)[sentence[token]] + pre] = np.arange(len(token))
    found = {"token": token, "pre": pre, "terminal": np.concatenate([x[2] for x in levels]), "depth": np.repeat(np.arange(len(levels)), [len(x[0]) for x in levels])}
    found = {k: v[order] for k, v in (found | {k: np.concatenate(v) for k, v in out.items()}).items()}
    found |= {"sentence": sentence[found["token"]], "node": local[found["token"]]}
    if dotted:
        found["path"] = pa.concat_arrays(paths).take(pa.array(order))
    return found, deep


def _one(heads: list[int], first: int, sentence: int, start: int, dotted: bool) -> Iterator[dict[str, pa.Array | np.ndarray]]:
    """As _levels(), of one sentence, in pieces."""
    rows: list[tuple] = []
    held = 0

    def piece() -> dict[str, pa.Array | np.ndarray]:
        node, parent, depth, pre, up, terminal, path = zip(*rows, strict=True)
        found = {"node": np.array(node), "parent": np.array([p or 0 for p in parent]), "depth": np.array(depth), "pre": np.array(pre), "up": np.array([-1 if u is None else u for u in up]), "terminal": np.array(terminal)}
        found |= {"token": start + found["node"] - 1, "sentence": np.full(len(node), sentence)}
        return found | ({"path": pa.array(path, pa.string())} if dotted else {})

    for row in preorder(heads, first, dotted):
        rows.append(row)
        held += 100 + len(row[-1] or "")
        if held > 8 << 20:
            yield piece()
            rows.clear()
            held = 0
    if rows:
        yield piece()


def _roots(heads: np.ndarray, ends: np.ndarray, deps: pa.Array) -> np.ndarray:
    """As root(), 0 where there is none."""
    starts = np.concatenate(([0], ends[:-1]))
    sentence = np.repeat(np.arange(len(ends)), ends - starts)
    local = np.arange(len(heads)) - starts[sentence] + 1
    at = np.flatnonzero(pc.fill_null(pc.equal(deps, "root"), False).to_numpy(zero_copy_only=False) | (heads == local))
    found = np.zeros(len(ends), np.int64)
    found[sentence[at[::-1]]] = local[at[::-1]]  # the first is written last
    return found


def _build(batches: Iterator[pa.RecordBatch], dotted: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = {c: batch.column(c) for c in batch.schema.names}
        offsets = {c: column[c].offsets.to_numpy().astype(np.int64) for c in ("heads", "lemmas", "deps")}
        bounds, i = offsets["heads"], 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + AT_ONCE, "right")) - 1)
            heads = column["heads"].values.slice(bounds[i], bounds[j] - bounds[i]).to_numpy().astype(np.int64)
            ends = bounds[i + 1 : j + 1] - bounds[i]
            first = _roots(heads, ends, column["deps"].values.slice(offsets["deps"][i], len(heads)))
            found, deep = _levels(heads, ends, first, dotted)
            starts = bounds[i:j] - bounds[i]
            alone = (x for k in deep.tolist() for x in _one(heads[starts[k] : ends[k]].tolist(), int(first[k]), k, int(starts[k]), dotted))
            for x in itertools.chain([found], alone):
                if len(x["node"]):
                    top = x["depth"] == 0
                    at = {c: pa.array(x["token"] + offsets[c][i]) for c in ("lemmas", "deps")}
                    yield pa.RecordBatch.from_arrays(
                        [
                            column["sent_id"].take(pa.array(x["sentence"] + i)), pa.array(x["node"], pa.int32()), pa.array(x["parent"], pa.int32(), mask=top), column["deps"].values.take(at["deps"]), column["lemmas"].values.take(at["lemmas"]),
                            pa.array(x["depth"], pa.int32()), pa.array(x["pre"], pa.int32()), pa.array(x["up"], pa.int32(), mask=top), pa.array(x["terminal"]), *([x["path"]] if dotted else []),
                        ],
                        [*SCHEMA.names, *(["path"] if dotted else [])],
                    )
            i = j


def build(sentences: DataFrame, id_col: str = "sent_id", dotted: bool = False) -> DataFrame:
    """Rows (sent_id, node, parent, dep, lemma, depth, pre, up, terminal), with ``dotted`` also path, the nodes from the root down as text.

    ``pre`` numbers a sentence's nodes in preorder and is their identity, as a cycle's copy repeats ``node``; ``up`` is the
    parent's number. A sentence is one row, so its tree is built where it is: one pass, no shuffle and no limit of depth,
    while a recursive query would join and shuffle at each level. Sentences without a root have no rows.
    """
    t = F.col("tokens")
    rows = sentences.select(F.col(id_col).cast("long").alias("sent_id"), t["head"].alias("heads"), t["lemma"].alias("lemmas"), t["dep"].alias("deps"))
    return rows.mapInArrow(partial(_build, dotted=dotted), NODE + ", path string" * dotted)


def paths(nodes: DataFrame) -> DataFrame:
    """Adds ``path``, the nodes from the root down: for those who want to see it, as a deep tree's paths take the square of its size."""
    steps = F.array_sort(F.collect_list(F.struct("pre", "up", "node")))
    trees = nodes.groupBy("sent_id").agg(steps.alias("t"))
    # in preorder a parent comes before its children
    grown = F.aggregate("t", F.array().cast("array<array<int>>"), lambda a, x: F.concat(a, F.array(F.when(x["up"].isNull(), F.array(x["node"])).otherwise(F.concat(F.get(a, x["up"]), F.array(x["node"]))))))
    found = trees.select("sent_id", F.posexplode(grown).alias("pre", "path"))
    return nodes.join(found, ["sent_id", "pre"])


def as_patterns(nodes: DataFrame, label: str | None = None) -> DataFrame:
    """Trees as tree patterns, numbered by sentence id; a pattern's nodes are numbered in preorder."""
    name = F.col("sent_id").cast("string") if label is None else F.lit(label)
    return nodes.select(
        F.col("sent_id").cast("int").alias("pattern_index"), name.alias("label"), F.col("pre").alias("pnode"), F.col("up").alias("pparent"),
        F.when(F.col("up").isNotNull(), F.col("dep")).alias("pdep"), "lemma",
    )
