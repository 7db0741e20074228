from itertools import product

import numpy as np

from tidemark.llm import crf


def all_paths(emit, transit):
    n, k = emit.shape
    paths = list(product(range(k), repeat=n))
    score = np.array([sum(emit[i, y] for i, y in enumerate(p)) + sum(transit[a, b] for a, b in zip(p, p[1:])) for p in paths])
    return paths, score


def test_in_step_matches_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5, 3, 4, 1, 5])
    emit, transit = rng.normal(size=(lengths.sum(), 3)) * 2, rng.normal(size=(3, 3))
    best = crf.viterbi(emit, lengths, transit)
    prob, pairs = crf.posteriors(emit, lengths, transit, pairs=True)
    at, expected = 0, np.zeros((3, 3))
    for n in lengths:
        paths, score = all_paths(emit[at : at + n], transit)
        assert tuple(best[at : at + n]) == paths[score.argmax()]
        w = np.exp(score - score.max())
        w /= w.sum()
        want = np.zeros((n, 3))
        for p, x in zip(paths, w):
            want[np.arange(n), p] += x
            for a, b in zip(p, p[1:]):
                expected[a, b] += x
        assert np.allclose(prob[at : at + n], want)
        at += n
    assert np.allclose(pairs, expected)


def test_learns_transitions():
    rng = np.random.default_rng(0)
    lengths = rng.integers(5, 15, 200)
    labels = np.concatenate([np.sort(rng.integers(0, 2, n)) for n in lengths])  # 0s, then 1s
    seen = np.where(rng.random(len(labels)) < 0.7, labels, 1 - labels)  # a noisy view
    weight, transit = crf.fit([seen], lengths, labels, 2, 2, epochs=60)
    got = crf.viterbi(crf.emissions(weight, [seen]), lengths, transit)
    assert transit[1, 0] < min(transit[0, 0], transit[1, 1]) - 2
    assert np.mean(got == labels) > np.mean(seen == labels) + 0.05


def test_no_sequences():
    none = np.zeros((0, 2))
    assert crf.viterbi(none, np.zeros(0, int), np.zeros((2, 2))).shape == (0,)
    assert crf.posteriors(none, np.zeros(0, int), np.zeros((2, 2)))[0].shape == (0, 2)
