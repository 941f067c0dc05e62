import random
import zlib

import numpy as np

from rulesieve.llm import quality

LABELS = "doc_id bigint, quality int, toxic int"


def _case(n=260):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.6
        text = " ".join(word() if good else word().upper() + "!!" for _ in range(rnd.randint(5, 200)))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = _case()
    extra = [(1000, None), (1001, ""), (1002, "x" * 200_000), (None, "abc"), (1001, "")]
    table = spark.createDataFrame([*labels, (5000, 1, 0), (7, None, 0), (8, 3, 0), (None, 1, 1)], LABELS)
    got = quality.query(docs(rows + extra), table).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95


def test_no_labels_one_class_and_empty_tables(spark, docs):
    rows = docs([(1, "a b"), (2, None)])
    assert [round(r["score"], 6) for r in quality.query(rows, spark.createDataFrame([], LABELS)).collect()] == [0.5, 0.5]
    assert all(r["score"] > 0.99 for r in quality.query(rows, spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)).collect())
    assert quality.query(docs([]), spark.createDataFrame([], LABELS)).collect() == []


def test_chunks_cover_the_text():
    for n in (0, 1, 512, 513, 900, 960, 961, 5000):
        data = bytes(np.random.default_rng(n).integers(1, 256, n, np.uint8))
        own = quality.chunks_of(data)
        assert own.shape[1] == quality.CHUNK and own[0, : min(n, quality.CHUNK)].tobytes() == data[: quality.CHUNK]
        assert n <= quality.CHUNK or own[-1].tobytes() == data[-quality.CHUNK :]
        assert len(own) >= n / quality.CHUNK


def test_gradients():
    net, rng = quality.Network(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    docs = [rng.integers(0, 256, (k, quality.CHUNK), np.uint8) for k in (1, 3, 2)]
    labels, weights = np.array([0.0, 1.0, 1.0]), np.array([1.0, 0.5, 2.0])
    starts = np.array([0, 1, 4])

    def loss():
        logit = net.logits(net.responses(np.concatenate(docs))[0], starts)
        return float((weights * (np.logaddexp(0, logit) - labels * logit)).sum() / 3)

    grads = net.gradients(docs, labels, weights)
    for k, g in grads.items():
        flat = net.p[k].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old, eps = flat[i], 1e-5
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[i]) < 1e-3, k


def _naive(net, text):
    """The forward pass by loops over bytes."""
    data = (text or "").encode()
    starts, at = [], 0
    while at < len(data) - quality.CHUNK:
        starts.append(at)
        at += quality.CHUNK - quality.OVERLAP
    starts.append(max(0, len(data) - quality.CHUNK))
    best, total = [0.0] * quality.FILTERS, [0.0] * quality.FILTERS
    for start in starts:
        own = data[start : start + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        for f in range(quality.FILTERS):
            top = -1e9
            for place in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP):
                top = max(top, sum(float(net.p["bytes"][own[place + i]][d]) * float(net.p["filters"][i * quality.DIM + d][f]) for i in range(quality.WIDTH) for d in range(quality.DIM)))
            act = max(0.0, top + float(net.p["bias"][f]))
            best[f], total[f] = max(best[f], act), total[f] + act
    pooled = best + [t / len(starts) for t in total]
    return 1 / (1 + np.exp(-(sum(a * float(b) for a, b in zip(pooled, net.p["out"], strict=True)) + float(net.p["base"][0]))))


def test_scores_are_those_of_loops_over_bytes(docs, monkeypatch):
    for name, value in (("CHUNK", 64), ("OVERLAP", 8), ("WIDTH", 4), ("FILTERS", 5)):
        monkeypatch.setattr(quality, name, value)
    net, rnd = quality.Network(3), random.Random(4)
    net.p["bias"] = np.linspace(-0.2, 0.2, 5).astype(np.float32)
    texts = ["".join(rnd.choice("abcé🙂 \n!Z") for _ in range(n)) for n in (0, 1, 10, 63, 64, 65, 120, 121, 400)] + [None]
    assert np.allclose(net.scores(texts), [_naive(net, t) for t in texts], atol=1e-5)


def test_the_sample_is_bounded_and_whole(spark, docs):
    rows = [(i, f"t{i} " * (i + 1)) for i in range(40)] + [(3, "again"), (3, "again")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 1, 0)], LABELS)
    got = quality._sampled(docs(rows), labels.select("doc_id", "quality"), 15, 10**6)
    texts = {i: {t for j, t in rows if j == i} for i in range(40)}
    assert len(got) == 30 and all(text in texts[i] for _, i, text in got)
    few = quality._sampled(docs(rows), labels.select("doc_id", "quality"), 15, 300)
    assert 0 < len(few) < 30 and set(few) <= set(got) and all(sum(len(t) for q, _, t in few if q == k) <= 300 for k in (0, 1))


def test_long_texts_score_as_in_one_go():
    net = quality.Network()
    text = "".join(random.Random(2).choice("abc !") for _ in range(3_000_000))
    whole = net.responses(quality.chunks_of(text.encode()))[0]
    logit = net.logits(whole, np.array([0]))[0]
    assert abs(net.scores([text, "", None])[0] - 1 / (1 + np.exp(-logit))) < 1e-6
