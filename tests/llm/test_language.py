import zlib

import numpy as np

from seriesmill.llm import language as L


def test_held_out_texts_are_recognised(docs, rows):
    got = L.identify(docs).collect()
    assert len(got) == len(rows)
    known = {r[0]: r for r in rows if r[0] is not None}
    right = total = 0
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is None:
            assert r["held_out"] is False
            continue
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        text, lang = known[r["doc_id"]][1:3]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["held_out"] and lang and len(text) > 100:
            total += 1
            right += r["lang_pred"] == lang
    assert total > 15 and right >= 0.95 * total


def test_filter_keeps_clean_rows_and_columns(docs):
    kept = L.drop_unidentified(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {95, 96, 97, 98} and set(range(0, 95)) <= ids


def test_nothing_to_learn_from(nothing, docs):
    assert L.identify(nothing).collect() == []
    unlabelled = docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {(r["lang_pred"], r["score"]) for r in L.identify(unlabelled).collect()} == {("und", 0.0)}
    assert L.drop_unidentified(unlabelled).filter("doc_id = 98").count() == 0


def test_gradients_match_differences():
    """Backpropagation through time against finite differences of the loss."""
    draw = np.random.default_rng(1)
    x = draw.integers(97, 101, (6, 5)).astype(np.uint8)
    length, label = np.array([5, 5, 4, 3, 2, 1]), np.array([0, 1, 0, 1, 0, 1])

    def loss(net):
        reverse, active = L._both_ways(x, length)
        ahead, _ = L._run(net.ahead, x, active, False)
        back, _ = L._run(net.back, reverse, active, False)
        total = 0.0
        for t, n in enumerate(active):
            for s in range(n):
                scores = ahead[t][s] @ net.ahead.out + back[length[s] - 1 - t][s] @ net.back.out + net.bias
                total += np.log(np.exp(scores).sum()) - scores[label[s]]
        return total / length.sum()

    def wide(net):
        for side in (net.ahead, net.back):
            side.table, side.recurrent, side.out = (w.astype(np.float64) for w in (side.table, side.recurrent, side.out))
        net.bias = net.bias.astype(np.float64)
        return net

    captured = {}
    original = L._back_through

    def spy(side, *rest):
        out = original(side, *rest)
        captured[id(side)] = out
        return out

    net = wide(L.new_network(["a", "b"], hidden=3))
    untouched = wide(L.new_network(["a", "b"], hidden=3))
    L._back_through = spy
    try:
        L.train(net, x, length, label, epochs=1, batch=6)
    finally:
        L._back_through = original
    for side, clean in ((net.ahead, untouched.ahead), (net.back, untouched.back)):
        table, recurrent = captured[id(side)]
        for grad, weight in ((table, clean.table), (recurrent, clean.recurrent)):
            for at in [(97, 0), (98, 4), (99, 7)] if weight is clean.table else [(0, 0), (1, 5), (2, 8)]:
                keep = weight[at]
                weight[at] = keep + 1e-3
                up = loss(untouched)
                weight[at] = keep - 1e-3
                down = loss(untouched)
                weight[at] = keep
                assert abs((up - down) / 2e-3 - grad[at]) < 2e-4


def slow_probabilities(net, sequence):
    """Label probabilities at every byte of one sequence, a byte and a gate at a time."""

    def states(side, data):
        hidden = side.recurrent.shape[0]
        h, out = np.zeros(hidden), []
        for byte in data:
            given, own = side.table[byte].astype(float), h @ side.recurrent.astype(float)
            z, r = (1 / (1 + np.exp(-(given[k * hidden : (k + 1) * hidden] + own[k * hidden : (k + 1) * hidden]))) for k in (0, 1))
            candidate = np.tanh(given[2 * hidden :] + r * own[2 * hidden :])
            h = z * h + (1 - z) * candidate
            out.append(h)
        return out

    ahead, back = states(net.ahead, sequence), states(net.back, sequence[::-1])[::-1]
    scores = [np.exp(a @ net.ahead.out + b @ net.back.out + net.bias) for a, b in zip(ahead, back)]
    return [s / s.sum() for s in scores]


def sequences(text):
    """Words with the space before them, cut at the bytes of a segment."""
    for word in text.encode().split():
        word = b" " + word
        yield from (word[k : k + L.SEGMENT] for k in range(0, len(word), L.SEGMENT))


TEXTS = ["one two two", "", "日本語の文章は空白を使わないので一つの長い単語になる。" * 3, "x" * 23 + " " + "y" * 24 + " " + "z" * 100, "  lead and trail \n"]


def test_pooled_probabilities_equal_a_walk_over_bytes():
    import pyarrow as pa

    net = L.new_network(["a", "b", "c"], hidden=5, seed=3)
    got = L._pooled(net, *L.utf8(pa.array(TEXTS)))
    for text, own in zip(TEXTS, got):
        each = [p for s in sequences(text) for p in slow_probabilities(net, s)]
        want = np.mean(each, axis=0) if each else np.zeros(3)
        assert np.allclose(own, want, atol=1e-5)
