"""Frames of clips that may match: reference hashes written out with their changes are shuffled, not sent through the driver."""

import random

from candorframe.operators import hamming as hm


def test_changed_reference_hashes_are_not_broadcast(spark):
    rng = random.Random(5)
    turned = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(63), n))
    refs = [rng.getrandbits(63) for _ in range(300)]
    frames = [turned(refs[i], i % 12) for i in range(120)] + [rng.getrandbits(63) for _ in range(300)] + [refs[7], refs[7], None]
    left = spark.createDataFrame([(i, h) for i, h in enumerate(frames)], "clip_id long, hash long")
    right = spark.createDataFrame([(i, h) for i, h in enumerate([*refs, refs[3], None])], "ref_id long, hash long")
    near = {h for h in frames if h is not None and any(bin(h ^ r).count("1") <= 8 for r in refs)}
    found = hm.may_have_near(left, right, 8)
    got = [r.hash for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == near and 90 <= len(near) <= 120
    # The plan as carried out, after Spark has seen the sizes.
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Join" in x and "bit_count" in x]
    assert joins and all("SortMergeJoin [block" in x for x in joins)
    # Block values that many rows share are not looked into: nothing near is lost.
    assert near <= {r.hash for r in hm.may_have_near(left, right, 8, hot=1).collect()}
