"""The login limiter as a stream, held against a plain run; its state."""

import numpy as np
from cardloom.plans.streams import in_batches
from cardloom.streaming import segments, streams
from pyspark.sql import functions as F

SCHEMA = "client long, at double, ok boolean"
LIMITS = {"failures": 3, "seconds": 60, "locked": 200}


def plain(attempts):
    out, state = [], {}
    for client, at, ok in sorted(attempts, key=lambda a: a[1]):
        recent, until = state.get(client, ([], 0.0))
        refused = at < until
        if not refused:
            recent = [] if ok else [x for x in recent if x >= at - LIMITS["seconds"]] + [at]
            if len(recent) >= LIMITS["failures"]:
                recent, until = [], at + LIMITS["locked"]
        state[client] = (recent, until)
        out.append((client, at, ok, refused))
    return sorted(out, key=str)


def made(clients, n, seed):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.choice(4000, n, replace=False)) + 1_700_000_000.25
    return [(clients[int(rng.integers(len(clients)))], float(t), bool(rng.random() < 0.2)) for t in at]


def test_limiter_in_batches_is_a_plain_run(spark):
    """Cuts through windows and lockouts; ids beyond 2^53, and attempts without a client."""
    attempts = made([1, 2, 3, 2**62 + 1, 2**62 + 3, -7, None], 900, 5)
    rows = spark.createDataFrame(attempts, SCHEMA)
    low = attempts[0][1]
    cuts = [0, 700, 705, 1900, 5000]
    parts = [rows.where((F.col("at") >= low + a) & (F.col("at") < low + b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    got = in_batches(spark, parts, lambda s: streams.lockouts(s, **LIMITS))
    want = plain(attempts)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert 0.05 < np.mean([w[3] for w in want]) < 0.9


def test_limiter_keeps_no_state_of_clients_that_have_nothing_to_remember(spark, tmp_path):
    """State is asked for by group, not by client, and clients without recent failures or a lock leave none."""
    for k, v in segments.STATE_STORE.items():
        spark.conf.set(k, v)
    spark.createDataFrame([(c, 1000.0 + c / 1000, True) for c in range(900)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.lockouts(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), **LIMITS)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    state = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]]
    assert sum(state) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 900
