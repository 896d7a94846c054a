"""Decontamination against the overlap rule itself: every alignment is compared, no seeds."""

import math
import random
from itertools import combinations

from tradeloom.llm import decontaminate


def test_masks_hit_every_window_that_meets_the_rule():
    for width in range(1, decontaminate.WIDTH + 1):
        most = width - math.ceil(width * decontaminate.SHARE)
        for missed in combinations(range(width), most):
            assert any(all(mask[k] == "0" or at + k not in missed for k in range(len(mask))) for mask in decontaminate.masks(width) for at in range(width - len(mask) + 1)), (width, missed)


def _agree(doc, item):
    width, best = min(13, len(item)), 0
    for shift in range(-len(item) + 1, len(doc)):
        same = [item[j] == doc[j + shift] for j in range(max(0, -shift), min(len(item), len(doc) - shift))]
        best = max([best, *(sum(same[k : k + width]) for k in range(len(same) - width + 1))])
    return best if width and best >= math.ceil(width * 0.8) else 0


def test_overlaps_are_the_rule_on_all_alignments(spark):
    chance = random.Random(9)
    items = [[f"i{n}t{k}" for k in range(n)] for n in (*range(1, 16), 20, 40)] + [["a", "b"] * 7, []]
    docs = [[], ["x"], [w if k % 5 else "x" for k, w in enumerate(items[-3], 1)]]
    docs += [[w if k not in missed else "x" for k, w in enumerate(items[12])] for missed in combinations(range(13), 2)]
    for _ in range(150):
        item = chance.choice(items[:-1])
        own = [w if chance.random() > 0.14 else "x" for w in item]
        docs.append(["y"] * chance.randrange(4) + own[: len(own) - chance.randrange(2)] + ["z"] * chance.randrange(4))
    text = lambda rows: spark.createDataFrame([(k, " ".join(r)) for k, r in enumerate(rows)], "id long, text string")
    found = decontaminate.overlaps(text(docs).withColumnRenamed("id", "doc_id"), text(items).withColumnRenamed("id", "item_id"))
    got = {(r["doc_id"], r["item_id"]): r["agree"] for r in found.collect()}
    assert got == {(d, i): a for d, doc in enumerate(docs) for i, item in enumerate(items) if (a := _agree(doc, item))}
    assert {d for d, _ in got} >= set(range(2, 3 + 78))
