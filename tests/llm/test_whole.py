"""Operators on inputs that no block by turn number would divide."""

import numpy as np
from pyspark.sql import functions as F

from spotlattice.llm import chat, decontaminate


def test_chat_cuts_a_conversation_of_null_and_repeated_turns(spark, monkeypatch):
    rows = [(None, None if i % 3 else 7, f"User: {i}?" if i % 2 else "Assistant: " + "word " * (i % 40)) for i in range(900)] + [(1, None, "same")] * 600
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    model = chat.fit(turns.withColumn("role", F.when(F.col("text").startswith("User"), "user").otherwise("assistant")).withColumn("conv_id", F.coalesce("conv_id", F.lit(2))))
    kept = {}
    monkeypatch.setattr(chat, "materialise", lambda s, df, name: kept.setdefault(name, df.localCheckpoint()))
    got = sorted((r.conv_id or 0, r.turn or 0, r.role_pred, r.rendered) for r in chat.recover(spark, turns, model).collect())
    blocks = kept["chat-places"].groupBy("conv_id", F.floor(F.col("place") / chat.BLOCK)).count()
    assert blocks.agg(F.max("count")).first()[0] <= chat.BLOCK
    want = []
    for conv in (None, 1):
        part = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(part)], "k long, conv_id long, turn long, text string").select("*", chat.body(F.col("text")).alias("body"), *(c.alias(n) for n, c in chat.features(F.col("text")).items()))
        seen = [r.asDict() for r in df.orderBy("k").collect()]
        e = chat.emissions(model, seen)
        first, last = chat.borders(model, [chat.best_matrix(model, e)])[0]
        for r, s in zip(seen, chat.decode(model, e, first, last), strict=True):
            role = chat.ROLES[s]
            want.append((r["conv_id"] or 0, r["turn"] or 0, role, f"<|{role}|>\n{r['body']}\n<|end|>"))
    assert got == sorted(want) and len(np.unique([r[2] for r in got])) > 1


def test_one_shingle_items_are_never_missed():
    # the item's shingle meets a lesser one of its bin in the same block of two
    mine, lesser, other = (np.uint64(h << 32 | 5) for h in (900, 100, 700))
    index = decontaminate.Index([(7, np.array([mine])), (8, np.sort(np.array([mine, other])))])
    docs = np.array([lesser, mine, other, lesser], np.uint64)
    assert index.candidates(docs, np.array([2, 2])).tolist() == [[0, 0], [0, 1], [1, 1]]
    assert decontaminate.Index([]).candidates(docs, np.array([4])).tolist() == []
    r = np.random.default_rng(1)
    texts = r.integers(0, 1 << 63, 40_000, dtype=np.uint64)
    items = [(i, texts[i : i + 1]) for i in range(40_000)]
    assert len(decontaminate.Index(items).candidates(texts, np.array([20_000, 20_000]))) == 40_000
