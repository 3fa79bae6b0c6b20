"""Main text of web pages: boosted trees over DOM features, decoded on the tree.

Each element gets the log-odds of being main text from its subtree's density of
text and links, the learned weights of the words in its attributes and its
ancestors', its depth and its place among its siblings.  The decoder labels every
element in, out or mixed such that all below an element that is in (out) is in
(out) too; only mixed elements have both below them.  It is the best such labelling
by summed log-likelihood of the texts, found bottom-up in one pass, so an ancestor
and a descendant never contradict each other.

The fitted model is the file ``main_text_model.json`` beside this module, made by
``python -m millrace.llm.main_text_model``; nothing is trained at query time.

Defined cases: null or empty html gives an empty text; text without any tag is one
block of main text; a page of any length takes time and memory in proportion to it,
its elements being scored some at a time; repeated or null ids are rows of their
own; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.dom import Node, blocks, features, parse, walk, weights
from millrace.llm.trees import BoostedTrees
from millrace.plans.scratch import bounded_arrow_batches

MODEL = Path(__file__).with_name("main_text_model.json")
#: What a mixed element costs, in units of log-likelihood.
MIXED = 0.5
#: Elements that are scored together, but for those of one page.
TOGETHER = 1 << 15


def decode(nodes: list[Node], odds: np.ndarray, weight: np.ndarray) -> set[int]:
    """ids of the elements whose own text is main text."""
    n = len(nodes)
    number = {id(x): k for k, x in enumerate(nodes)}
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    w = np.sqrt(weight) + 0.05
    all_in, all_out = w * yes, w * no
    own_best = np.maximum(all_in, all_out)
    best = np.zeros(n)
    mixed = own_best - MIXED
    choice = np.zeros(n, dtype=np.int8)
    for k in range(n - 1, -1, -1):
        options = (all_out[k], all_in[k], mixed[k] if nodes[k].children else -np.inf)
        choice[k] = int(np.argmax(options))
        best[k] = options[choice[k]]
        if k:
            p = number[id(nodes[k].parent)]
            all_in[p] += all_in[k]
            all_out[p] += all_out[k]
            mixed[p] += best[k]
    state = np.zeros(n, dtype=np.int8)
    kept = set()
    for k, x in enumerate(nodes):
        above = state[number[id(x.parent)]] if k else 2
        state[k] = choice[k] if above == 2 else above
        if state[k] == 1 or state[k] == 2 and odds[k] > 0:
            kept.add(id(x))
    return kept


@dataclass(frozen=True)
class MainText:
    """The trees, and what words in attributes say."""

    trees: BoostedTrees
    words: dict[str, float]

    def log_odds(self, pages: list[list[Node]]) -> list[np.ndarray]:
        """Of every element of each page, some elements at a time."""
        out: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0
        for nodes in pages:
            for rows in features(nodes, self.words) if nodes else ():
                held.append(rows)
                size += len(rows)
                if size >= TOGETHER:
                    out.append(self.trees.log_odds(np.concatenate(held)))
                    held, size = [], 0
        if held:
            out.append(self.trees.log_odds(np.concatenate(held)))
        joined = np.concatenate(out) if out else np.zeros(0)
        return np.split(joined, np.cumsum([len(nodes) for nodes in pages])[:-1])


@lru_cache(maxsize=1)
def trained() -> MainText:
    saved = json.loads(MODEL.read_text(encoding="utf-8"))
    return MainText(BoostedTrees.of(saved["trees"]), saved["words"])


def extract(pages: list[str | None], model: MainText) -> list[str]:
    """Main text of each page."""
    out: list[str] = []
    held: list[list[Node]] = []
    size = 0
    for page in pages:
        held.append(walk(parse(page)) if page else [])
        size += len(held[-1])
        if size >= TOGETHER:
            out += _texts(held, model)
            held, size = [], 0
    return out + (_texts(held, model) if held else [])


def _texts(trees: list[list[Node]], model: MainText) -> list[str]:
    out = []
    for nodes, odds in zip(trees, model.log_odds(trees)):
        if not nodes:
            out.append("")
        elif len(nodes) == 1:
            out.append("\n".join(blocks(nodes[0], {id(nodes[0])})))
        else:
            out.append("\n".join(blocks(nodes[0], decode(nodes, odds, weights(nodes)))))
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    spark = pages.sparkSession
    bounded_arrow_batches(spark)
    model = spark.sparkContext.broadcast(trained())
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = extract(b.column(2).to_pylist(), model.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
