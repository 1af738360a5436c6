"""Brute-force counterparts used by several tests."""

import math
from collections import Counter
from itertools import combinations

DATA = "/root/testdata/sf0.001"


def random_baskets(rng, n, items=12, longest=6):
    return [sorted(rng.sample(range(items), rng.randint(1, longest))) for _ in range(n)]


def brute_itemsets(baskets, min_count, max_len=None):
    counts = Counter(
        combo
        for basket in baskets
        for size in range(1, (max_len or len(basket)) + 1)
        for combo in combinations(sorted(set(basket)), size)
    )
    return {combo: n for combo, n in counts.items() if n >= min_count}


def brute_blocks(rows, min_support, max_len=None, rounding=math.floor):
    """{(block, items): count} for rows of (block, basket)"""
    found = {}
    for block in {b for b, _ in rows}:
        mine = [basket for b, basket in rows if b == block]
        limit = max(1, rounding(len(mine) * min_support))
        for combo, n in brute_itemsets(mine, limit, max_len).items():
            found[block, combo] = n
    return found
