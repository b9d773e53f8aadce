import itertools
import random

import numpy as np

from morbiscope.llm import packing as P
from morbiscope.llm import tree_tokenizer as T


def test_window_is_as_full_as_possible():
    rng = random.Random(2)
    for _ in range(150):
        room = rng.randrange(5, 60)
        lengths = sorted(rng.sample(range(1, 40), rng.randrange(1, 6)), reverse=True)
        counts = np.zeros(100, np.int64)
        for x in lengths:
            counts[x] = rng.randrange(1, 4)
        got = P.fill_window(counts, np.array([x for x in lengths if x <= room]), room)
        assert all(n <= counts[x] for x, n in got.items())
        sums = {sum(x * k for x, k in zip(lengths, ks)) for ks in itertools.product(*[range(counts[x] + 1) for x in lengths])}
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def test_plan_places_every_item_once():
    rng = random.Random(3)
    hist = {rng.randrange(1, 129): rng.randrange(1, 30) for _ in range(60)}
    used, plan = {}, P.plan_patterns(hist, 128)
    for times, chosen in plan:
        assert times > 0 and sum(x * n for x, n in chosen.items()) <= 128
        for x, n in chosen.items():
            used[x] = used.get(x, 0) + n * times
    room = []  # first fit decreasing, for comparison
    for x in sorted((x for x, n in hist.items() for _ in range(n)), reverse=True):
        at = next((i for i, r in enumerate(room) if r >= x), None)
        if at is None:
            room.append(128 - x)
        else:
            room[at] -= x
    assert used == hist and sum(t for t, _ in plan) <= len(room)
    assert len(P.plan_patterns({k: v * 10**9 for k, v in hist.items()}, 128)) < 2000  # bounded by the lengths, not by the items


def test_frame(spark):
    rng = random.Random(4)
    texts = ["word " * rng.randrange(0, 90) for _ in range(400)] + ["same text here"] * 300 + [None, "", " ", "long " * 700]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, container_id string").repartition(5)
    caps = spark.createDataFrame([("s", 64), ("m", 256), ("twin", 256), ("bad", 0), (None, None)], "capacity_name string, capacity_tokens int")
    out = P.pack_documents(df, caps).toPandas()
    tok = T.tokenizer()
    size = {i: len(tok.encode(t)) for i, t in enumerate(texts)}
    for (name, cap), own in out.groupby(["capacity_name", "capacity_tokens"]):
        assert own.groupby("container_id").n_tokens.sum().max() <= cap
        assert set(own.container_id) == set(range(own.container_id.max() + 1))
        per = own.groupby("doc_id")
        assert per.n_tokens.sum().to_dict() == size
        for doc, pieces in per:
            k = max(1, -(-size[doc] // cap))
            assert sorted(pieces.piece) == list(range(k)) and (pieces.first_token == pieces.piece * cap).all()
        assert own.n_tokens.sum() / (cap * (own.container_id.max() + 1)) > 0.95
    assert set(out.capacity_name) == {"s", "m", "twin"}
    assert P.pack_documents(df.limit(0), caps).count() == 0 and P.pack_documents(df, caps.limit(0)).count() == 0
