import hashlib
import json
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from shelfmark.llm import chat, knn, queries

DATA = "/root/testdata/sf0.001"


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices("abcdefghijk", k=rng.randrange(2, 9))) for _ in range(rng.randrange(20, 200))]
        good = i % 4 != 0
        text = " ".join(words) if good else (" ".join(w.upper() + "!!" for w in words) if i % 8 else " ".join([words[0]] * 80))
        rows.append((i, text))
        labels.append((i, int(good)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")
    got = knn.judged(docs, lab).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    truth = dict(labels)
    held = got[got.held_out & got.doc_id.isin(truth)]
    assert len(held) > 50 and np.mean([truth[int(d)] == p for d, p in zip(held.doc_id, held.predicted, strict=True)]) > 0.95
    assert got[got.doc_id == 1].score.nunique() == 1
    assert knn.judged(docs.where("false"), lab).count() == 0
    assert set(knn.judged(docs, lab.where("false")).toPandas().score) == {0.5}


def test_scores_do_not_depend_on_the_batch(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab c!D", k=200)) for _ in range(120)]
    model = knn.fit(knn.terms(texts[:60]), np.array([i % 2 for i in range(60)], float))
    assert np.allclose(model.scores(texts), np.concatenate([model.scores([t]) for t in texts]), atol=1e-3)


def test_scores_against_all_cosines():
    """Every text against every labelled vector, in plain loops."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefg h!D\n", k=rng.randrange(1, 300))) for _ in range(90)] + ["", None, "x" * 200000, "y"]
    fit = texts[:70]
    model = knn.fit(knn.terms(fit), np.array([float(i % 3 > 0) for i in range(70)]), neighbours=7)
    for text, score in zip(texts, model.scores(texts), strict=True):
        if not text:
            assert score == round(model.prior, 6)
            continue
        own = model.project(knn.terms([text]))[0].astype(float)
        cosines = [sum(a * b for a, b in zip(own.tolist(), v.tolist(), strict=True)) for v in model.vectors.astype(float)]
        best = sorted(range(70), key=lambda i: (round(cosines[i], 5), i))[-7:]
        votes = [max(round(cosines[i], 5), 0) ** 4 + 1e-9 for i in best]
        assert abs(score - sum(v * model.labels[i] for v, i in zip(votes, best, strict=True)) / sum(votes)) < 2e-3


def test_columns_that_clash_with_scores(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 7, "T")], ["doc_id", "text", "score", "n", "up"]).toDF("doc_id", "text", "score", "predicted", "TEXT")
    model = knn.fit(knn.terms(["a b c", "D!"]), np.array([1.0, 0.0]))
    out = knn.scored(docs, model)
    assert out.columns == ["doc_id", "text", "score", "predicted", "TEXT", "score_1", "predicted_1"]
    row = out.first()
    assert tuple(row)[:5] == (1, "a b c", "s", 7, "T") and 0 <= row["score_1"] <= 1
    assert knn.judged(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 1


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0], t[1], t[2]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


LIST_LIKE = '[{"a": 1}]'
SHAPES = [
    [("user", LIST_LIKE), ("assistant", "null")], [("user", "p"), ("assistant", "{}")], [("user", "a"), ("user", LIST_LIKE), ("assistant", "c")],
    [("system", "s"), ("user", '"q"'), ("assistant", "\u0000\u2028\\")], [("user,assistant", "one turn")], [("human", "h"), ("gpt", "g")], [("user", ""), ("assistant", "x")],
    [("assistant", "x"), ("user", "[]"), ("assistant", LIST_LIKE), ("system", "")],
]


def test_the_query_meets_many_layouts(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text")
    records = chat.mixed_records(chat.grouped_turns(rows))
    assert records.select(chat.record_fingerprint(F.col("record"))).distinct().count() >= 4
    known = [layout.fingerprint for layout in chat.LAYOUTS]
    assert records.where(~chat.record_fingerprint(F.col("record")).isin(known)).count() == 0


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "", None, "\ue000\ue001 [INST", "[IN[INST]ST]", "<<s>", "</s", "é😀\n\n", "\ue000\ue002</s>\ue000", "a\\b</s></s>", "x" * 50000]
    rows = [(c, t, "assistant" if t % 2 else "user", odd[(c + t) % len(odd)]) for c in range(11) for t in range(4)]
    rows += [(50, 0, None, "no role"), (50, 0, "we[INST]ird</s>", "tie"), (50, None, "assistant", "first"), (51, 0, "assistant", "twice"), (51, 0, "assistant", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.formatted(chat.grouped_turns(df))).collect()}
    assert got == brute(rows)
    assert chat.read_back(chat.formatted(chat.grouped_turns(df.where("false")))).count() == 0
    extra = [(100 + i, t, r, x) for i in range(160) for t, (r, x) in enumerate(SHAPES[i % len(SHAPES)])]
    mixed = chat.mixed_records(chat.grouped_turns(spark.createDataFrame(rows + extra, "conv_id long, turn long, role string, text string")))
    assert mixed.schema["record"].dataType.simpleString() == "string"
    assert mixed.select(chat.record_fingerprint(F.col("record"))).distinct().count() == len(chat.LAYOUTS)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(chat.formatted(mixed)).collect()}
    assert got == brute(rows + extra)
    assert chat.mixed_records(chat.grouped_turns(df.where("false"))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = queries.op10_chat(spark, DATA)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_layouts(spark):
    records = [
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None}]}, [("system", "s"), ("user", "")]),
        ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, [("user", "h"), ("assistant", "g")]),
        ({"unknown": 1}, []),
        ([1], []),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(records)] + [(90, None), (91, "{broken")]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in df.select("conv_id", chat.turns_of_records(F.col("record")).alias("t")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(records)} | {90: [], 91: []}
    assert chat.formatted(df).count() == len(rows)
