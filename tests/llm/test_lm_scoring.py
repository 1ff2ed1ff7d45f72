import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brinewave.llm import lm_scoring as L

from .conftest import words


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = L.Network(rng.normal(0, 0.3, L.Network.SIZE))
    classes, targets = (rng.integers(0, L.CLASSES, (2, L.WINDOW)) for _ in range(2))
    live = rng.random((2, L.WINDOW)) < 0.5
    net.MASK = L.Network.MASK.astype(float)
    loss = lambda: -net.log_probs(net.attend(classes)[0][live], targets[live], np.ones(L.CLASSES))[0].mean()
    g = net.gradient(classes, targets, live)
    for k in rng.choice(L.Network.SIZE, 60, replace=False).tolist() + list(range(L.Network.SIZE - 3 * L.CLASSES, L.Network.SIZE, 7)):
        e, keep = 1e-5, net.flat[k]
        net.flat[k] = keep + e
        up = loss()
        net.flat[k] = keep - e
        down = loss()
        net.flat[k] = keep
        assert abs(g[k] - (up - down) / (2 * e)) < 1e-6 + 1e-3 * abs(g[k])


def test_attention_is_causal():
    rng = np.random.default_rng(1)
    net = L.Network(rng.normal(0, 0.3, L.Network.SIZE).astype(np.float32))
    a = rng.integers(0, L.CLASSES, (1, L.WINDOW))
    b = a.copy()
    b[0, 20:] = 3
    assert np.allclose(net.attend(a)[0][0, :20], net.attend(b)[0][0, :20], atol=1e-5)


@pytest.mark.parametrize("lengths", [[1], [31, 32, 33], [2 * L.WINDOW - L.OVERLAP, 2 * L.WINDOW - L.OVERLAP + 1, 5], [500, 1, 2]])
def test_each_place_is_scored_once(lengths):
    first, size, skip = L.windows(np.array(lengths))
    seen = np.zeros(sum(lengths), int)
    for f, s, o in zip(first, size, skip, strict=True):
        assert s >= 1
        seen[f + o : f + s] += 1
    assert (seen == 1).all()


def test_probabilities_sum_to_one():
    """Over a closed vocabulary with mixed classes: all ids that can follow in a context have the probability 1 together."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, 400).astype(float)
    class_of = L.learn_classes(counts, {(int(a), int(b)): 3 for a, b in rng.integers(0, 400, (900, 2))})
    starts = rng.random(400) < 0.4
    starts[-1] = True
    side, share, log_class, begins = L.within(counts, class_of, starts)
    assert abs(np.exp(log_class).sum() - 1) < 1e-5 and 0 < begins[class_of[0]] <= 1
    inner = np.flatnonzero(~starts)
    keys = np.unique(rng.integers(0, 400, 600) << 20 | rng.choice(inner, 600))
    f = L.Fixed.of(class_of, side, share, keys, np.arange(1.0, len(keys) + 1))
    net = L.Network(rng.normal(0, 0.5, L.Network.SIZE).astype(np.float32))
    hidden = net.attend(rng.integers(0, L.INPUTS, (1, L.WINDOW)))[0][0, -1:]
    found = np.array([net.log_probs(hidden, np.array([c]), begins)[0][0] for c in range(L.CLASSES)])
    border = np.exp(net.log_probs(hidden, np.array([0]), begins)[1][0])
    first = np.flatnonzero(starts)
    one = f.words(first.astype(np.int32), np.arange(len(first)), np.ones(len(first), int))
    assert abs(np.exp(found[class_of[first]] + one).sum() - border) < 1e-5
    for before in (7, 11, int(keys[0] >> 20)):
        pairs = np.stack([np.full(len(inner), before), inner], axis=1).ravel().astype(np.int32)
        two = f.words(pairs, np.arange(len(inner)) * 2, np.full(len(inner), 2)) - side[before] - share[before]
        assert abs(np.exp(found[class_of[inner]] + two).sum() - (1 - border)) < 1e-5


def test_score_by_hand(spark, monkeypatch):
    """The whole score from its definition: one window, one attention and one count at a time."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(12)] + ["the", "Über", "naïveté", "antidisestablishmentarianism", "x!y?z"]
    rows = [(k, " ".join(rng.choice(vocabulary, n))) for k, n in enumerate([0, 1, 5, 40, 90, 3, 8, 60, 25, 13])] + [(99, None)]
    net, seen = L.Network(rng.normal(0, 0.4, L.Network.SIZE).astype(np.float32)), []
    monkeypatch.setattr(L, "train", lambda documents, class_of, *_: seen.append(class_of) or net)
    got = {r.doc_id: r for r in L.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    class_of, bpe = seen[0], L.coder(*L.default_vocabulary())
    end, low = bpe.base, lambda t: [w.encode().lower().decode() for w in (t or "").split()]
    ids_of = lambda w: [i for p in bpe.pattern.findall(f" {w}") for i in bpe.encode_pieces([p.encode()])[p.encode()]]
    starts = lambda i: i == end or bpe.bytes_of[i].startswith(b" ")
    count, pair, word = Counter(), Counter(), Counter()
    for i, t in rows:
        if not got[i].held_out:
            word.update([*low(t), None])
            count[end] += 1
            for w in low(t):
                own = ids_of(w)
                count.update(own)
                pair.update(zip(own, own[1:]))  # noqa: B905
    total = sum(word.values())
    n = lambda i: count[i] + L.FRACTION
    members = {c: np.flatnonzero(class_of == c).tolist() for c in set(class_of.tolist())}
    sides = {(c, s): sum(n(i) for i in m if starts(i) == s) for c, m in members.items() for s in (True, False)}
    begins = np.array([sides.get((c, True), 0.0) / max(sides.get((c, True), 0.0) + sides.get((c, False), 0.0), 1e-9) for c in range(L.CLASSES)])

    def classes_after(ids, i):
        stride = L.WINDOW - L.OVERLAP
        at = max(0, -(-(i + 1 - L.WINDOW) // stride)) * stride
        x = np.stack([net.part("e")[j % L.INPUTS] + net.part("p")[k] for k, j in enumerate(ids[at : i + 1])]).astype(float)
        q, k, v = np.split(x @ net.part("qkv"), 3, axis=1)
        a = np.exp(k @ q[-1] / math.sqrt(L.WIDTH))
        h = x[-1] + (a / a.sum()) @ v @ net.part("o")
        h = h + np.maximum(h @ net.part("u"), 0) @ net.part("v")
        p = np.exp(h @ net.part("w") + net.part("b")[0])
        return p / p.sum()

    def chance(p, i, before=None):
        c, s = class_of[i], starts(i)
        share = n(i) / sides[c, s]
        if before is not None:
            share = (pair[before, i] + L.BACKOFF * share) / (sum(pair[before, j] for j in members[c]) + L.BACKOFF)
        return p[c] * (begins[c] if s else 1 - begins[c]) * share

    for i, t in rows:
        ids, score = [end], 0.0
        for w in low(t):
            own, p = ids_of(w), classes_after(ids, len(ids) - 1)
            log = -math.log(p @ begins)
            for k, j in enumerate(own):
                log += math.log(chance(p, j, own[k - 1] if k else None))
                ids.append(j)
                p = classes_after(ids, len(ids) - 1)
            log += math.log(p @ begins)
            assert log < 0
            score += math.log10(L.MIX * word[w] / total + (1 - L.MIX) * math.exp(log))
        p = classes_after(ids, len(ids) - 1)
        score += math.log10(L.MIX * word[None] / total + (1 - L.MIX) * chance(p, end) / (p @ begins))
        assert abs(score - got[i].score) < 1e-3 + 1e-4 * abs(score), (i, score, got[i].score)


def test_base_and_counts_by_hand(spark, docs, texts, empty):
    rows = L.score(docs).collect()
    assert len(rows) == len(texts)
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    low = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(t)]
    counts: Counter = Counter()
    for i, t in texts:
        if not held(i):
            counts.update([*low(t), None])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t in texts:
        tokens = [*low(t), None]
        expected[(i, held(i), len(tokens), sum(x in counts for x in tokens), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert L.score(empty).count() == 0


def test_rare_words_by_the_join(docs, texts, monkeypatch):
    all_ = sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in L.score(docs).collect())
    monkeypatch.setattr(L, "TOP_WORDS", 5)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in L.score(docs).collect()) == all_


def test_attention_and_classes_see_every_training_text(docs, texts, monkeypatch):
    seen, neighbours = [], []
    learn = L.learn_classes
    monkeypatch.setattr(L, "train", lambda documents, *_: seen.extend(r.text for r in documents.collect()) or L.Network(np.zeros(L.Network.SIZE, np.float32)))
    monkeypatch.setattr(L, "learn_classes", lambda counts, *how: neighbours.append((counts.sum(), how)) or learn(counts, *how))
    out = L.score(docs)
    assert Counter(seen) == Counter(r.text for r in docs.withColumn("h", L.held_out()).where("not h").collect())
    (total, how), = neighbours
    assert how[-1].sum() >= 2 * (total - len(seen)) > 0  # every id but the ends is a neighbour on two sides
    assert out.count() == len(texts)


def test_pairs_beyond_those_that_travel_count_too(docs, monkeypatch):
    monkeypatch.setattr(L, "train", lambda *_: L.Network(np.zeros(L.Network.SIZE, np.float32)))
    monkeypatch.setattr(L, "TOP_WORDS", 40)
    take = lambda: sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in L.score(docs).collect())
    whole = take()
    monkeypatch.setattr(L, "PAIRS", 10)
    for a, b in zip(whole, take(), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 * abs(a[4])


def test_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for k in range(120)] + [(500 + k, "the very same text") for k in range(40)] + [(None, "no id")] * 3 + [(900, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: (x[0] is None, x[0] or 0)
    one, eight = (sorted(((r.doc_id, r.score) for r in L.score(d.repartition(n)).collect()), key=key) for n in (1, 8))
    assert [i for i, _ in one] == [i for i, _ in eight]
    assert np.allclose([s for _, s in one], [s for _, s in eight], rtol=1e-5, atol=1e-5)


def test_shards_and_their_mean(spark, docs, monkeypatch):
    """More shards than one, whatever the table's partitions; the mean by hand; every training row in one round and shard."""
    ids = 100_000.0
    assert L.plan_of(2 * L.SHARD_IDS * 3 + 1) == (4, 1) and L.plan_of(0.0) == (1, L.PASSES) and L.plan_of(2 * 3 * 96 * 32 * 100.0)[1] == 2
    monkeypatch.setattr(L, "SHARD_IDS", ids / 2 / 3)
    monkeypatch.setattr(L, "PASSES", 1)
    seen, mean = [], L.mean_weights

    def held(weights, shards):
        rows = weights.collect()
        seen.append((shards, [(r.shard, r.steps) for r in rows]))
        flat = mean(weights, shards)
        by_hand = sum(np.frombuffer(r.flat, np.float32).astype(float) * r.steps for r in rows) / sum(r.steps for r in rows)
        assert np.allclose(flat, by_hand, atol=1e-6)
        return flat

    monkeypatch.setattr(L, "mean_weights", held)
    class_of, share = np.zeros(L.coder(*L.default_vocabulary()).base + 1, np.int64), np.full(L.CLASSES, -math.log(L.CLASSES), np.float32)
    nets = [L.train(docs.repartition(n), class_of, share, L.default_vocabulary(), ids) for n in (1, 6)]
    assert np.allclose(nets[0].flat, nets[1].flat, atol=1e-5)
    assert [s for s, _ in seen] == [3] * 4 and sorted(seen[0][1]) == sorted(seen[2][1]) and sorted(seen[1][1]) == sorted(seen[3][1])


ODD_WORDS = ["The \t the\x0b\x0cOF  don't x!y?z 3.5% Über u\u0308", "a\u00a0! \u3000b \x1cq \x85r 日本語。テスト ok\u2028", "", " \n ", "the " * 5 + "w" * 300, "one two  three the of"]


def test_words_are_encoded_together_and_once(monkeypatch):
    """Ids are those of each word by itself, by the pattern; a frequent word isn't encoded again when others are forgotten."""
    monkeypatch.setattr(L, "CACHE", 3)
    e, seen = L.Encoder(*L.default_vocabulary(), None, {b"the": 7, b"of": 2}), []
    together = e.together
    monkeypatch.setattr(e, "together", lambda some: seen.append(list(some)) or together(some))
    own = lambda w: [i for p in e.bpe.pattern.findall(f" {w}") for i in e.bpe.encode_pieces([p.encode()])[p.encode()]]
    for texts in [ODD_WORDS, ODD_WORDS[:2], ODD_WORDS, ["the of"]]:
        expected = [[e.end, *(i for w in words(t) for i in own(w.encode().lower().decode()))] for t in texts]
        ids, lengths = e.texts(pa.array(texts))
        assert ids.tolist() == [i for x in expected for i in x] and lengths.tolist() == list(map(len, expected))
        slots = e.slots(*L.split(pa.array(texts)))
        assert [c for c in e.count[slots].tolist() if c > 0] == [{"the": 7.0, "of": 2.0}[w] for t in texts for w in words(t.lower()) if w in ("the", "of")]
    assert len(seen) > 2 and not any({b"the", b"of"} & set(some) for some in seen)


def test_words_and_counts_by_batches(monkeypatch):
    """Groups cross batches; counts are those of all words, also where a task gives them in parts."""
    texts = [None, *ODD_WORDS] * 7
    batches = lambda: (pa.RecordBatch.from_arrays([pa.array(texts[k : k + 5], pa.string())], ["text"]) for k in range(0, len(texts), 5))
    groups = [g.to_pylist() for g in L.text_groups((b.column("text") for b in batches()), 400)]
    assert [t for g in groups for t in g] == [t or "" for t in texts] and len(groups) > 2
    assert all(sum(map(len, g)) >= 400 > sum(map(len, g[:-1])) for g in groups[:-1])
    monkeypatch.setattr(L, "GROUP_CHARS", 30)
    got: Counter = Counter()
    for b in L.count_words(batches()):
        for r in b.to_pylist():
            got[r["word"]] += r["n"]
    assert got == Counter(w.encode().lower() for t in texts for w in words(t))
    assert list(L.count_words(iter([]))) == []


def test_hidden_states_past_a_place_are_those_of_the_whole_window():
    rng = np.random.default_rng(6)
    net = L.Network(rng.normal(0, 0.3, L.Network.SIZE).astype(np.float32))
    inputs = rng.integers(0, L.INPUTS, (3, L.WINDOW))
    assert np.allclose(net.attend(inputs, L.OVERLAP)[0], net.attend(inputs)[0][:, L.OVERLAP :], atol=1e-6)
