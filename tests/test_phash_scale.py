"""Near pairs of hashes: rows written out per choice of blocks are shuffled, not broadcast."""

import random

from candorframe.operators import hamming as hm


def test_rows_per_choice_are_not_broadcast(spark):
    rng = random.Random(4)
    some = [rng.getrandbits(62) for _ in range(300)]
    near = [h ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for h in some[:40]]
    q = spark.createDataFrame([(i, h) for i, h in enumerate(some)] + [(900, some[0]), (901, None)], "item_id long, hash long")
    refs = spark.createDataFrame([(i, h) for i, h in enumerate(near + some[250:] + near[:3])], "ref_id long, hash long")
    got = hm.phash_match(q, refs)
    want = sorted(
        (a, b, bin(a ^ b).count("1"), 2 if a == some[0] else 1, 2 if b in near[:3] else 1) for a in some for b in set(near + some[250:]) if bin(a ^ b).count("1") <= 6
    )
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) >= 90
    # The plan as carried out, after Spark has seen the sizes.
    pairs = hm.hamming_pairs(q, refs, 6)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin [choice" in plan and "BroadcastHashJoin [choice" not in plan
