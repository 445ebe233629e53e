"""Measures the recall of decontamination by share and kind of edit, number of items and their length: python tests/llm/recall.py [seed]."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import numpy as np  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402

from factloom.llm import op01_decontaminate as op1  # noqa: E402

KINDS = {"replaced": (0,), "deleted": (1,), "inserted": (2,), "mixed": (0, 1, 2)}


def edited(line: str, share: float, kinds: tuple, rng) -> str:
    """`line` with that share of its characters, drawn at random, replaced, deleted or preceded by another."""
    c = list(line)
    for p in sorted(rng.choice(len(c), int(share * len(c)), replace=False).tolist(), reverse=True):
        kind, x = rng.choice(kinds), "abcdefghijklmnopqrstuvwxyz "[rng.integers(0, 27)]
        c[p : p + 1] = [x] if kind == 0 else [] if kind == 1 else [x, c[p]]
    return "".join(c)


def recall(bench: list[tuple], share: float, kinds: tuple, rng, draws: int, part=lambda t: t) -> float:
    """Of the edited items that an exact search finds within the threshold, the share that is found."""
    bench = [(i, part(op1.normal(t).decode())) for i, t in bench]
    items, found, n = op1.Items(bench), 0, 0
    for i, t in bench:
        texts = [f"what stands before it {edited(t, share, kinds, rng)} and what comes after it" for _ in range(draws)]
        masks = {c: sum(1 << p for p, x in enumerate(t) if x == c) for c in set(t)}
        for text, f in zip(texts, items.search_all(texts)):
            if op1.distance_within(masks, len(t), op1.normal(text).decode())[0] <= int((1 - op1.SIMILARITY) * len(t) + 1e-9):
                found += any(x[0] == i for x in f)
                n += 1
    return found / max(1, n)


if __name__ == "__main__":
    rng = np.random.default_rng(int(sys.argv[1]) if len(sys.argv) > 1 else 1)
    for sf in ("sf0.01", "sf0.1"):
        rows = [(r["item_id"], r["text"]) for r in pq.read_table(f"/root/testdata/{sf}/benchmark.parquet").to_pylist()]
        for kind, kinds in KINDS.items():
            print(sf, len(rows), "items,", kind, {share: round(recall(rows, share, kinds, rng, 600 // len(rows)), 3) for share in (0.05, 0.1, 0.15, 0.18, 0.2)}, flush=True)
    for size in (30, 45, 60, 81, 113):
        print("items cut to", size, "characters, mixed", {share: round(recall(rows, share, KINDS["mixed"], rng, 3, lambda t: t[:size].strip()), 3) for share in (0, 0.1, 0.2)}, flush=True)
