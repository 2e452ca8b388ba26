"""Benchmark decontamination: pigeonhole edit matching.

A test item of ``m`` normalised characters may stand in a document with up to
``floor(rate * m)`` edits.  Split into one piece more than that, at least one
piece must stand there unchanged (pigeonhole).  All pieces of a block of items
are looked up in one pass over a document (Aho-Corasick); every hit's window
is verified with Myers' bit-parallel distance.

Items come in blocks of bounded size, so what is shipped to tasks does not
grow with the benchmark; each block is one pass over the documents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import materialize
from .shared import short_batches

SCHEMA = "doc_id long, item_id long, distance int, start long, end long"


def normal(text: str | None) -> str:
    """Lower case, white space runs to one space."""
    return " ".join((text or "").lower().split())


def pieces_of(item: str, budget: int):
    """``(offset, piece)`` of ``budget + 1`` nearly equal pieces."""
    k = budget + 1
    cuts = [i * len(item) // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _scan(masks: dict, m: int, text: str, limit: int):
    """``(distance, end)``: fewest edits of the pattern against a substring, its first end; None above ``limit``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at, get = full, 0, m, limit + 1, -1, masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        gain, loss = down | (full & ~(diag | up)), up & diag
        if gain & top:
            score += 1
        elif loss & top:
            score -= 1
        if score < best:
            best, at = score, i + 1
            if not best:
                break
        gain = (gain << 1) & full
        loss = (loss << 1) & full
        xv = eq | down
        up, down = loss | (full & ~(xv | gain)), gain & xv
    return (best, at) if at >= 0 else None


def _masks(item: str) -> dict:
    masks: dict = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(item: str, window: str, limit: int):
    """``(distance, start, end)`` of the best place of ``item`` in ``window``, or None."""
    hit = _scan(_masks(item), len(item), window, limit)
    if hit is None:
        return None
    best, end = hit
    back = _scan(_masks(item[::-1]), len(item), window[:end][::-1][:len(item) + best], best)
    return best, end - back[1], end


class Block:
    """The pieces of some items in one automaton (built once per task)."""

    def __init__(self, items, rate: float, least: int):
        import ahocorasick
        self.items = [(i, t, int(rate * len(t)) if len(t) >= least else 0) for i, t in items]
        self.auto, at = ahocorasick.Automaton(), {}
        for k, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces_of(text, budget):
                at.setdefault(piece, []).append((k, offset))
        for piece, where in at.items():
            self.auto.add_word(piece, (len(piece), where))
        if at:
            self.auto.make_automaton()
        self.masks = [_masks(t) for _, t, _ in self.items]
        self.least = least

    def find(self, text: str):
        """``(item_id, distance, start, end)``: the best place of every item found in a normalised text."""
        if not len(self.auto):
            return
        done, best = {}, {}
        for end, (size, where) in self.auto.iter(text):
            for k, offset in where:
                _, item, budget = self.items[k]
                start = end + 1 - size - offset
                near = done.setdefault(k, {})
                if any(near.get(g, -1) >= 0 and abs(near[g] - start) <= budget
                       for g in range(start // (budget + 1) - 1, start // (budget + 1) + 2)):
                    continue
                near[start // (budget + 1)] = start
                lo = max(0, start - 2 * budget)
                window = text[lo:start + len(item) + 2 * budget]
                hit = _scan(self.masks[k], len(item), window, budget)
                if hit and (k not in best or hit[0] < best[k][0]):
                    if len(item) < self.least and not self._whole(text, start, start + len(item)):
                        continue
                    best[k] = (hit[0], lo, window)
        for k, (limit, lo, window) in best.items():
            d, a, b = myers(self.items[k][1], window, limit)
            yield self.items[k][0], d, lo + a, lo + b

    @staticmethod
    def _whole(text, a, b):
        return not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())


def _match(docs: DataFrame, items, rate: float, least: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        block = Block(shared.value, rate, least)
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                out += [(doc, *hit) for hit in block.find(normal(text.as_py()))]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                  names=["doc_id", "item_id", "distance", "start", "end"])
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def blocks_of(benchmark: DataFrame, block_chars: int):
    """Lists of ``(item_id, normalised text)`` of about ``block_chars`` characters."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator():
        text = normal(r["text"])
        if text:
            held.append((r["item_id"], text))
            size += len(text)
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, least: int = 32,
                 block_chars: int = 4_000_000) -> DataFrame:
    """``doc_id, item_id, distance, start, end``: every benchmark item that stands in a document.

    ``distance`` is the fewest edits, ``start`` and ``end`` the place of that
    match in the normalised text (lower case, single spaces).  Items shorter
    than ``least`` characters have no error budget and must stand as whole
    words.  NULL and empty texts and items match nothing; repeated documents
    and items match each on their own; a NULL doc_id or item_id is carried.
    Other columns are ignored.
    """
    short_batches(docs.sparkSession)
    found = None
    for items in blocks_of(benchmark, block_chars):
        if found is not None:
            found = materialize(found, "contaminated")
        hits = _match(docs, items, rate, least)
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, least: int = 32, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item stands, with all their columns.

    Each row is judged by its own text, in one pass and without a shuffle: a row
    with a NULL or repeated doc_id stays or goes like any other.
    """
    short_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def without(shared):
        def run(batches):
            block = Block(shared.value, rate, least)
            for b in batches:
                stays = [next(iter(block.find(normal(text.as_py()))), None) is None for text in b.column(at)]
                yield b.filter(pa.array(stays, pa.bool_()))
        return run
    out = docs
    for items in blocks_of(benchmark, block_chars):
        out = out.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return out


__all__ = ["clean", "contaminated", "myers", "normal", "pieces_of"]
